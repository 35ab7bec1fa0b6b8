"""Every training-data query with an SQL text gives that text's rows; the contracts of the others hold row by row."""

import hashlib
import zlib

import duckdb
import pytest

from cohortwise.llm.queries import ORACLES, PROBE_TEXT, QUERIES

TABLES = ["documents", "benchmark", "labels", "conversations", "embeddings"]


@pytest.fixture(scope="module")
def db(folder):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return connection


@pytest.fixture(scope="module")
def texts(db):
    return dict(db.execute("SELECT doc_id, text FROM documents").fetchall())


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, folder, db, name):
    df = QUERIES[name](spark, folder)
    result = db.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), columns)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name, parts, rest", [
    ("op1_language_id", 5, 0), ("op3_quality_classifier", 3, 1), ("op4_toxicity", 4, 2)])
def test_scorers_cover_all_documents(spark, folder, texts, name, parts, rest):
    rows = QUERIES[name](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % parts == rest)
        assert 0 <= r["score"] <= 1


def test_token_counts_are_those_of_the_library(spark, folder, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op8_token_counts"](spark, folder).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        n = len(tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 1024, len(texts[r["doc_id"]].encode()))


def test_probe_conversation(spark, folder):
    row = QUERIES["op10_chat_formatting"](spark, folder).filter("conv_id = -7").first()
    turns = f"user\n{PROBE_TEXT}\nassistant\n{PROBE_TEXT}\n".encode()
    assert row["turns_sha256"] == hashlib.sha256(turns).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256(PROBE_TEXT.encode()).hexdigest()
    assert (row["n_turns"], row["loss_chars"]) == (2, len(PROBE_TEXT))
