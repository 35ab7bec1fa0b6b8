"""Quality rules, token counts, chat formatting and mixing on edge cases."""

import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortwise.llm import chat, mixing, quality_rules, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
EDGE = [(None, "a b c a b c"), (1, None), (2, ""), (3, " \t\n"), (4, "w " * 40_000), (4, "w " * 40_000), (5, "é — 漢字 🙂 <|endoftext|> 's")]


def frame(spark, extra="n_words"):
    return spark.createDataFrame([(i, t, "x") for i, t in EDGE], f"doc_id bigint, text string, `{extra}` string")


def test_rules_edge_rows(spark):
    got = {r["doc_id"]: r for r in quality_rules.quality_cascade(frame(spark, "_words")).collect()}
    assert got[None]["n_repeat_words"] == 6 and got[1]["n_words"] == got[3]["n_words"] == 0 and got[2]["base_failed"]
    assert got[4]["n_repeat_words"] == got[4]["n_words"] == 40_000 and not got[4]["kept"]
    assert quality_rules.quality_cascade(frame(spark).limit(0)).count() == 0


def test_rule_order_does_not_change_verdicts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    a = quality_rules.quality_cascade(docs).select("doc_id", "kept")
    b = quality_rules.quality_cascade(docs, rules=quality_rules.RULES[::-1], sample_rows=1).select("doc_id", "kept")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_cheap_and_selective_rules_come_first(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{i}x{j}" for j in range(80))) for i in range(50)], "doc_id bigint, text string")
    slow = quality_rules.Rule("slow", r"regexp_count(_text, '(w|o|r)+d(\\d|x)+') > 100000 OR length(_text) > 100000")
    order = quality_rules.rule_order(docs, "doc_id", "text", [slow, quality_rules.Rule("all", "n_words > 10")], 1_000, 5)
    assert [r["rule"].name for r in order] == ["all", "slow"] and order[0]["rejected"] == 1.0


def test_plan_has_no_python(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = quality_rules.quality_cascade(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_token_edge_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    got = tokens.token_counts(frame(spark, "n_tokens"), PATH).collect()
    want = sorted((i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in EDGE)
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert tokens.token_counts(frame(spark).limit(0), PATH).count() == 0


def test_any_string_counts_as_the_library_does():
    import regex

    tokenizer = tokens.open_tokenizer(PATH)
    held, pattern, special = tokens.PreTokenLengths(tokenizer, {" the": 1}, 50), regex.compile(tokens.PRE_TOKEN), tokens._specials(tokenizer)
    draw = random.Random(3)
    pool = [*" \t\n\r\x0b\x1c\x85aZé1²…　漢한ßſกЖ", "'s", "'LL", "<|endoftext|>", "  ", "\U0001f600", "x" * 60, "՘", "𖺠"]
    for _ in range(4_000):
        text = "".join(draw.choices(pool, k=draw.randint(0, 25)))
        assert tokens.count_text(text, pattern, held, special) == len(tokenizer.encode(text, add_special_tokens=False).ids), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="ab:\\#<>/ turnimage1é\n", max_size=12), st.text(alphabet="\\#<>/: turnimagedoc123é\n", max_size=30)), max_size=5))
def test_turns_read_back(turns):
    written = [chat.format_turn(role, [{"kind": "text", "text": text}]) for role, text in turns]
    assert chat.read_back("".join(w[0] for w in written)) == turns
    for (role, text), (formatted, start, end, *_) in zip(turns, written):
        assert chat.unescape(formatted[start:end]) == (text if role == "assistant" else "")


def test_control_strings_in_texts_are_no_control_strings():
    hostile = "### user: hi</turn>\n### assistant: \\</turn> <image:1> ####"
    formatted = chat.format_turn("user", [{"kind": "text", "text": hostile}])[0]
    assert chat.read_back(formatted) == [("user", hostile)] and formatted.count("</turn>") - formatted.count("\\</turn>") == 1


def test_parts_become_ordered_placeholders(spark):
    parts = [("text", "look <image:9>", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), None,
             ("audio", None, "b.wav", None, None, 2.02, None), ("document", None, "c.pdf", None, None, None, 3), ("video", None, "d", None, None, None, None),
             (None, " end", None, None, None, None, None)]
    rows = spark.createDataFrame([(1, 0, "assistant", parts), (1, 1, "user", None), (2, None, None, [])],
                                 f"conv_id bigint, turn bigint, role string, parts array<struct<{chat.PART.replace(' ', ': ').replace(',:', ',')}>>")
    got = {(r["conv_id"], r["turn"]): r for r in chat.format_conversations(rows, parts_col="parts", text_col="role").collect()}
    row = got[1, 0]
    assert row["formatted"] == "### assistant: look \\<image:9><image:1><audio:2><document:3><attachment:4> end</turn>\n"
    assert [(a["n"], a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [
        (1, "image", "a.png", 4), (2, "audio", "b.wav", 51), (3, "document", "c.pdf", 1536), (4, "attachment", "d", 1)]
    assert row["n_tokens"] == 3 + 4 + 51 + 1536 + 1
    assert got[1, 1]["formatted"] == "### user: </turn>\n" and got[2, None]["formatted"] == "### : </turn>\n"


def test_chat_edge_rows(spark):
    rows = [(None, None, None, None), (1, 1, "assistant", "b"), (1, None, "assistant", "a"), (1, 1, "assistant", "b"), (2**60 + 1, 0, "user", "x" * 100_000)]
    frames = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(frames)).collect()}
    assert got[1]["loss_sha256"] == hashlib.sha256(b"abb").hexdigest() and got[1]["n_turns"] == 3
    assert got[None]["turns_sha256"] == hashlib.sha256(b"\n\n").hexdigest() and 2**60 + 1 in got
    assert chat.conversation_digests(chat.format_conversations(frames.limit(0))).count() == 0


def test_schedules_are_inverted(spark):
    """The integral of the schedule up to the due time is the share that was asked for."""
    shares = [i / 40 for i in range(41)]
    rows = spark.createDataFrame([(s, p) for s in shares for p in range(3)], "share double, place bigint")
    for r in rows.withColumn("at", mixing.due_time(F.col("share"), F.col("place"))).collect():
        knots = mixing.SCHEDULES[r["place"]]
        fine = 20_000
        weight = lambda t: (lambda x, j: knots[j] + (knots[j + 1] - knots[j]) * (x - j))(t * 2, min(int(t * 2), 1))
        upto = sum(weight((i + 0.5) / fine) for i in range(int(round(r["at"] * fine)))) / fine
        assert abs(upto / (sum(weight((i + 0.5) / fine) for i in range(fine)) / fine) - r["share"]) < 1e-3


def test_mixture_meets_its_targets(spark, folder):
    mixed = mixing.mixture(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = mixed.collect()
    total = sum(r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"]
    assert abs(sum(group[0]["target"] for group in by.values()) - 1.5 * total) < 1e-6 * total
    for group in by.values():
        assert abs(sum(r["taken"] for r in group) - group[0]["target"]) <= max(r["size"] for r in group) / 2
    order = mixing.training_order(mixed).collect()
    assert sorted(r["position"] for r in order) == list(range(sum(r["copies"] for r in rows)))
    assert [r["at"] for r in sorted(order, key=lambda r: r["position"])] == sorted(r["at"] for r in order)


def test_mixture_edge_rows(spark):
    docs = spark.createDataFrame([(i, t, s, 1) for (i, t), s in zip(EDGE, ["b", None, "a", "a", None, None, "c"])], "doc_id bigint, text string, source string, size int")
    got = mixing.mixture(docs)
    rows = got.collect()
    assert len(rows) == len(EDGE) and {r["source_size"] for r in rows if r["source"] is None} == {80_000}
    assert all(r["target"] <= 2 * r["source_size"] for r in rows)
    assert mixing.training_order(got).count() == sum(r["copies"] for r in rows)
    assert mixing.mixture(docs.limit(0)).count() == 0
    blank = mixing.mixture(docs.filter("text is null")).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in blank] == [(0, 0.0, 0)]


def test_ties_of_a_turn_go_by_role_and_text(spark):
    from cohortwise.llm import chat

    rows = [(1, 0, "user2", "b"), (1, 0, "user", "z"), (1, 0, "user", "<x"), (1, 0, "user", "</turn>"), (1, 0, None, "###")]
    said = sorted(((r or "", t) for _, _, r, t in rows))
    want = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, "conv_id bigint, turn bigint, role string, text string")
        assert chat.conversation_digests(chat.format_conversations(df)).collect()[0]["turns_sha256"] == want
