"""Every stage of the corpus pipeline against brute force on its own input."""

import math

import corpus_pipeline as P
import pytest

from cohortwise.llm import decontaminate, simhash
from cohortwise.session import materialize
from test_decontaminate import plain as plain_overlaps
from test_lines import plain as plain_lines
from test_simhash import classes, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(materialize(stage(spark, out[-1], folder), name))
    return out


def texts(df):
    return sorted((r["doc_id"], r["text"]) for r in df.collect())


def test_columns_stay(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert [n for n, _ in P.STAGES] == ["language_id", "line_dedup", "simhash_near_dedup", "decontamination", "source_mixing"]


def test_language_stage_keeps_what_has_a_language(stages):
    assert [i for i, _ in texts(stages[1])] == [i for i, t in texts(stages[0]) if any(c.isalpha() for c in t)]


def test_line_stage(stages):
    want = plain_lines(texts(stages[1]))
    assert texts(stages[2]) == [(i, "\n".join(want[i, t])) for i, t in texts(stages[1])]
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_near_duplicate_stage(stages):
    given = dict(texts(stages[2]))
    prints = {i: plain_fingerprint(t) for i, t in given.items()}
    ids = sorted(given)
    near = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= simhash.BITS_APART]
    assert [i for i, _ in texts(stages[3])] == sorted(set(classes(near, ids).values()))


def test_benchmark_stage(spark, folder, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    items = [x for x in items if len(decontaminate.words_of(x[1])) >= 13]
    gone = {i for i, _ in plain_overlaps(texts(stages[3]), items)}
    assert gone and [i for i, _ in texts(stages[4])] == [i for i, _ in texts(stages[3]) if i not in gone]


def test_mixing_stage(stages):
    kept, rows = dict(texts(stages[4])), stages[5].collect()
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    assert all(r["text"] == kept[r["doc_id"]] for r in rows)
    assert len({(r["doc_id"], r["pass"]) for r in rows}) == len(rows)
    total = sum(len(t.split()) for t in kept.values())
    assert math.isclose(sum(r["n_words"] for r in rows), 1.5 * total, rel_tol=0.1)


def test_stages_take_odd_rows(spark, folder):
    rows = [(None, "some words of a text that is long enough\nx", None, None, 1), (1, None, "en", "a", 2), (2, "", "en", "a", 3), (3, "the words of it", None, "b", 4),
            (3, "the words of it", None, "b", 4), (3, "other words that are here for good", "en", "b", 4), (4, "12 34", "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, _key int")
    for given in (docs, docs.limit(0)):
        for name, stage in P.STAGES:
            given = materialize(stage(spark, given, folder), name)
        assert given.columns[-5:] == docs.columns
    for _, stage in P.STAGES:
        stage(spark, docs, folder).collect()
