"""Language, quality and toxicity: held-out accuracy on the given labels, and what the parts promise."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwise.llm import language, quality_model, toxicity
from cohortwise.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"


def landmarks(*spans):
    return toxicity.Landmarks.of(list(spans), len(spans))


def held_out_labels(spark, name, label, table="labels"):
    truth = spark.read.parquet(f"{LARGER}/{table}.parquet").select("doc_id", F.col(label).alias("truth"))
    return QUERIES[name](spark, LARGER).filter("held_out").join(truth, "doc_id").collect()


def test_language_on_held_out_documents(spark):
    rows = held_out_labels(spark, "op1_language_id", "lang", "documents")
    assert np.mean([r["lang_pred"] == r["truth"] for r in rows]) > 0.97


def test_quality_on_held_out_documents(spark):
    rows = held_out_labels(spark, "op3_quality_classifier", "quality")
    assert np.mean([r["predicted"] == r["truth"] for r in rows]) > 0.9
    good, bad = ([r["score"] for r in rows if r["truth"] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_toxicity_on_held_out_documents(spark):
    rows = held_out_labels(spark, "op4_toxicity", "toxic")
    assert np.mean([r["predicted"] == r["truth"] for r in rows]) > 0.9
    assert np.mean([r["predicted"] for r in rows if r["truth"] == 1]) > 0.55  # a few dozen toxic documents to learn from


def test_filter_returns_all_languages_of_an_ngram():
    texts = {"en": "the quick brown fox and the dog", "de": "der schnelle braune fuchs und the hund", "fr": "le renard brun"}
    members = {k: np.unique(language.grams(t)) for k, t in texts.items()}
    model = language.LanguageFilter.build(members, list(texts), 12)
    for i, t in enumerate(texts.values()):
        assert (model.languages_of(language.grams(t))[:, 0] >> np.uint64(i) & np.uint64(1)).all()
    the = language.grams("the")[[1]]  # "the" with a blank behind it
    assert int(model.languages_of(the)[0, 0]) & 0b11 == 0b11
    assert [model.predict(t)[0] for t in texts.values()] == list(texts)
    assert model.predict(None) == model.predict(" 12 !") == ("und", 0.0)


def test_more_languages_than_a_word_has_bits():
    draw = random.Random(1)
    texts = {f"l{i:03d}": "".join(draw.choices("abcdefghijklmnopqrstuvwxyz ", k=400)) for i in range(130)}
    model = language.LanguageFilter.build({k: np.unique(language.grams(t)) for k, t in texts.items()}, list(texts), 16)
    assert model.slots.shape[1] == 3
    assert all(model.predict(t)[0] == k for k, t in texts.items())


def test_false_positives_are_taken_off():
    draw = random.Random(2)
    known = {k: np.unique(language.grams("".join(draw.choices(k, k=3000)))) for k in ("abcdefgh", "ijklmnop")}
    model = language.LanguageFilter.build(known, list(known), 11)  # far too small a table
    assert model.false_positive.min() > 0.2
    other = model.shares(language.grams("".join(draw.choices("qrstuvwx", k=4000))))
    assert other.max() < 0.08


def test_follow_the_leader_separates():
    leader = quality_model.Leader(4, 0.5, 1.0, 0.01, 0.01)
    for _ in range(200):
        leader.update(np.array([0, 1]), np.array([1.0, 1.0]), 1)
        leader.update(np.array([0, 2]), np.array([1.0, 1.0]), 0)
    w = leader.weights()
    assert w[1] > 1 and w[2] < -1 and w[3] == 0


def test_features_are_of_the_whole_text():
    known = quality_model.Tokens()
    short, long = (quality_model.features(t, 18, known)[0] for t in ("a b c", "a b c " * 5_000 + "zebra"))
    assert set(long) > set(short) and len(quality_model.features(None, 18, known)[0]) == 1
    assert quality_model.features("a b", 18, known)[1][1:] @ quality_model.features("a b", 18, known)[1][1:] == pytest.approx(1)


def best(model, word):
    return max(float(model.kernel_matrix([s]).max()) for s in toxicity.spans_of(word))


def test_kernel_tolerates_gaps_and_inserted_characters():
    model = landmarks("stupid", "worthless")
    for changed in ("stuxpid", "s.tupid", "s-t-u-p-i-d", "stupidd", "wor*thless", "worthlesss"):
        assert best(model, changed) > 3 * max(best(model, w) for w in ("student", "stupendous", "without", "tired")), changed
    assert "idiot" in toxicity.words_of("you i d i o t there")


def test_kernel_is_what_its_definition_says():
    """Weights of common subsequences of three characters, summed; the table only stores them by code."""
    def plain(a, b):
        def table(s):
            s, out = f"\x02{s}\x03", {}
            weights = []
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, min(len(s), i + toxicity.REACH)):
                        w = toxicity.DECAY ** (k - i + 1)
                        weights.append(w)
                        out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0) + w
            return out, np.sqrt(np.sum(np.square(weights)))
        (x, n), (y, m) = table(a), table(b)
        return sum(w * y.get(c, 0) for c, w in x.items()) / (n * m)

    words = ["moron", "mooron", "moroon", "moron!x"]
    model = landmarks("moron")
    for w, got in zip(words, model.kernel_matrix(words)[:, 0]):
        assert got == pytest.approx(min(plain(w, "moron"), 1.5) ** 3, rel=1e-3)


EDGE = [(None, "the dog and the cat"), (1, None), (2, ""), (3, "1234 !!"), (4, "z" * 60_000), (4, "z" * 60_000), (5, "a")]


def test_edge_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in EDGE], "doc_id bigint, text string, score string")
    langs = spark.createDataFrame([(9, "the dog and the cat", "en"), (10, "x", None), (11, None, "en")], "doc_id bigint, text string, lang string")
    found = language.identify(docs, language.fit_language_filter(langs)).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in found) == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (5, "en")]
    nothing = language.fit_language_filter(langs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}
    rows = spark.createDataFrame([(1, "fine words here", 1), (2, None, 0), (2, "BAD!! BAD!!", 0)], "doc_id bigint, text string, label int")
    for train in (rows, rows.limit(0), rows.filter("label = 1")):
        weights = quality_model.fit_quality(train)
        assert quality_model.score_quality(docs, weights).count() == len(EDGE)
        scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(train)).collect()
        assert len(scored) == len(EDGE) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality_model.score_quality(docs.limit(0), weights).count() == 0
    assert language.identify(docs.limit(0), nothing).count() == 0


def test_changed_insults_are_near_their_landmark():
    model = landmarks("loser")
    for changed in ("loxqser", "loqxser", "lqosxer", "loxer"):  # two letters inserted, the middle one changed
        assert best(model, changed) > 0, changed


def test_no_language_without_a_letter(spark):
    langs = spark.createDataFrame([(9, "the dog and the cat", "en")], "doc_id bigint, text string, lang string")
    model = language.fit_language_filter(langs)
    assert model.predict("\u0301\u0301 12") == ("und", 0.0) and model.predict("e\u0301t")[0] == "en"


def test_more_evidence_never_lowers_a_chance():
    draw = np.random.default_rng(3)
    first = draw.normal(size=400)
    x = np.column_stack([np.ones(400), first, first - 0.1, np.log1p(first > 0)])
    y = (x[:, 2] + 0.3 * draw.normal(size=400) > 0.8).astype(float)
    curve = toxicity._rising_curve(x, y)
    assert (curve[1:] >= 0).all() and curve[1:].max() > 0 and (toxicity._rising_curve(-x * [-1, 1, 1, 1], y)[1:] == 0).all()
