"""Spaced seeds: what the masks promise, and the join against laying every item over every document."""

import itertools
import random

from cohortwise.llm import decontaminate as D


def test_masks_meet_two_substitutions_in_thirteen_words():
    for off in itertools.combinations(range(13), 2):
        free = [
            mask for mask in D.MASKS for at in range(13 - D.SPAN + 1)
            if all(not (0 <= o - at < D.SPAN and mask[o - at] == "1") for o in off)
        ]
        assert free, off


def plain(docs, items, window=13, similarity=0.8):
    found = set()
    for i, t in docs:
        words = D.words_of(t)
        for j, x in items:
            item = D.words_of(x)
            if len(item) < D.SPAN:
                continue
            for shift in range(-len(item), len(words)):
                if D.overlap(words, 0, item, shift, window, similarity) is not None:
                    found.add((i, j))
                    break
    return found


def made(seed=2):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 6))) for _ in range(300)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(j, text(draw.randint(4, 60))) for j in range(40)]
    docs = []
    for i in range(120):
        words = text(draw.randint(0, 120))
        if i % 3 == 0:
            _, item = draw.choice(items)
            cut = item[draw.randrange(max(1, len(item) - 12)) :] if i % 2 else list(item)
            cut = [draw.choice(vocabulary) if draw.random() < draw.choice([0, 0.1, 0.2]) else w for w in cut]
            at = draw.randint(0, len(words))
            words[at:at] = cut
        docs.append((i, ", ".join(w.upper() if draw.random() < 0.2 else w for w in words)))
    return docs, [(j, " ".join(x)) for j, x in items]


def test_against_every_alignment(spark):
    docs, items = made()
    got = D.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5),
                         spark.createDataFrame(items, "item_id bigint, text string")).collect()
    long_items = {j for j, x in items if len(D.words_of(x)) >= 13}
    want = plain(docs, items)
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert {p for p in found if p[1] in long_items} == {p for p in want if p[1] in long_items}
    assert found <= want and len(found) == len(got) and len(found) > 20


def test_small_bitmap_loses_nothing(spark):
    docs, items = made(5)
    frames = [spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")]
    wide, narrow = [D.contaminated(*frames, most_bits=b).collect() for b in (26, 8)]
    assert sorted(map(tuple, wide)) == sorted(map(tuple, narrow))


def test_edge_rows(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "a"), (None, passage, "a"), (4, "x " * 30_000 + passage, "a"), (4, "nothing", "a"), (5, passage, "a"), (5, passage, "a")],
        "doc_id bigint, text string, item_id string",
    )
    items = spark.createDataFrame([(1, passage), (1, passage), (None, passage), (3, None), (4, "too short")], "item_id bigint, text string")
    got = D.contaminated(docs, items)
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in got.collect()) == sorted((d, i) for d in (0, 4, 5) for i in (0, 1, 1))
    assert {r["n_words"] for r in got.collect()} == {15}
    left = D.without_contaminated(docs, got)
    assert left.columns == docs.columns and sorted((r["doc_id"], r["text"]) for r in left.collect() if r["text"]) == [(4, "nothing")]
    assert left.count() == 3
    assert D.contaminated(docs.limit(0), items).count() == 0 and D.contaminated(docs, items.limit(0)).count() == 0


def test_masks_of_short_items_meet_every_allowed_pattern():
    for n in range(1, 13):
        wide, off = D.kind_of(n, 13, 0.8)
        assert (wide, off) == (n, 0 if n < 8 else n // 5)
        for gone in itertools.combinations(range(n), off):
            assert any(not set(gone) & set(places) for places in D.masks_for(wide, off)), (n, gone)
        assert n < 8 or min(map(len, D.masks_for(wide, off))) >= 4


def plain_of_any_length(docs, items):
    parted = [(j, D.words_of(x)) for j, x in items]
    return {
        (i, j) for i, t in docs for words in [D.words_of(t)] for j, item in parted
        if item and any(D.overlap(words, 0, item, shift, 13, 0.8) for shift in range(-len(item), len(words)))
    }


def test_items_of_every_length_against_every_alignment(spark):
    draw = random.Random(8)
    word = lambda: "".join(draw.choices("abcdefgh", k=draw.randint(3, 6)))
    items = [(j, [word() for _ in range(1 + j % 16)]) for j in range(64)]
    docs = []
    for i in range(512):
        _, item = items[i % 64]
        cut = list(item)
        for at in draw.sample(range(len(cut)), min(len(cut), draw.randint(0, 3))):
            cut[at] = word()
        docs.append((i, " ".join([word() for _ in range(draw.randint(0, 9))] + cut + [word() for _ in range(draw.randint(0, 9))])))
    items = [(j, " ".join(x)) for j, x in items]
    got = D.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), least_words=1)
    want = plain_of_any_length(docs, items)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == sorted(want)
    assert {len(dict(items)[j].split()) for _, j in want} == set(range(1, 17))


def test_unspaced_scripts_and_the_first_place_of_a_short_item(spark):
    han = "床前明月光疑是地上霜举头望明月低头思故乡"
    docs = spark.createDataFrame([(1, f"引言,{han[:9]}x{han[10:]}完"), (2, han[:7]), (3, "so red, so red: so red"), (4, "red so")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, han), (2, "So red")], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"], r["first_word"], r["n_words"], r["n_equal"]) for r in D.contaminated(docs, items, least_words=1).collect())
    assert got == [(1, 1, 2, 20, 19), (3, 2, 0, 2, 2)]
