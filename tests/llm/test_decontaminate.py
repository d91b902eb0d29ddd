import random

import pyarrow as pa
import pytest

from kinlink.llm import decontaminate as D

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "nu", "per", "st") for b in ("an", "er", "in", "ou") for c in ("", "d", "th", "ly")]


def text(rng, n):
    return " ".join(rng.choice(("the", "of", "and") if rng.random() < 0.3 else WORDS) for _ in range(n))


def distance(item, doc):
    """Edit distance in words to the best stretch, by the plain table."""
    prev = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        cur = [i]
        for j, y in enumerate(doc, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return min(prev)


def test_stretch_matches_plain_table():
    rng = random.Random(3)
    for _ in range(200):
        item = [rng.randrange(6) for _ in range(rng.randrange(1, 30))]
        doc = [rng.randrange(6) for _ in range(rng.randrange(0, 40))]
        masks = {}
        for i, x in enumerate(item):
            masks[x] = masks.get(x, 0) | 1 << i
        assert D.best_stretch(masks, len(item), doc)[0] == distance(item, doc)


def test_recall_against_brute_force(spark):
    rng = random.Random(5)
    items = [(k, text(rng, rng.randrange(14, 60))) for k in range(30)]
    docs = []
    for d in range(240):
        words = text(rng, rng.randrange(5, 300)).split()
        if d % 2:
            w = items[d % 30][1].split()
            for _ in range(int(len(w) * rng.choice((0, 0, 0.05, 0.1, 0.15)))):
                p, how = rng.randrange(len(w)), rng.random()
                w[p : p + (how < 0.67)] = [rng.choice(WORDS)] if how > 0.33 else []
            at = rng.randrange(len(words))
            words[at:at] = w
        docs.append((d, " ".join(words)))
    want = {}
    for d, t in docs:
        for k, s in items:
            item = s.split()
            e = distance(item, t.split())
            if e <= int(len(item) * 0.2 + 1e-9):
                want[d, k] = e
    got = D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]): r["edit_distance"] for r in got}
    assert set(found) <= set(want)
    assert len(found) >= 0.98 * len(want) and sum(found[k] == want[k] for k in found) >= 0.98 * len(found)


def test_case_and_punctuation_do_not_matter(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa."
    docs = [(1, "before ALPHA  beta;\ngamma*** 'delta' epsilon -- zeta eta theta iota kappa after"), (2, "alpha beta gamma only"), (3, None), (4, ""), (5, item), (5, item)]
    df = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, text string, item_id long, edit_distance int")
    got = D.find(df, spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "two words")], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edit_distance"]) for r in got) == [(1, 7, 0), (5, 7, 0), (5, 7, 0)]
    left = D.clean(df, spark.createDataFrame([(7, item)], "item_id long, text string"))
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4]


def test_empty_tables_and_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    items = spark.createDataFrame([(k, f"a b c d e f g h i j k l m n o{k}") for k in range(20)], "item_id long, text string")
    assert D.find(docs.limit(0), items).count() == 0 and D.find(docs, items.limit(0)).count() == 0
    monkeypatch.setattr(D, "BLOCK_WORDS", 20)
    assert D.find(docs, items).count() == 20


def test_very_long_document(spark):
    rng = random.Random(8)
    item = text(rng, 40)
    doc = text(rng, 200_000) + " " + item + " " + text(rng, 100)
    got = D.find(spark.createDataFrame([(1, doc)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["edit_distance"], r["end_word"]) for r in got] == [(0, 200_040)]


def edited(rng, item, edits):
    """The item with so many word edits, spread evenly: the worst case for runs of unchanged words."""
    w = list(item)
    for i in reversed(range(edits)):
        p, how = (2 * i + 1) * len(w) // (2 * edits), rng.randrange(3)
        w[p : p + (how != 0)] = [] if how == 2 else [f"new{rng.randrange(10**6)}"]
    return w


def test_every_copy_is_found_at_every_length_edit_rate_and_position(spark):
    rng = random.Random(12)
    items, docs, want = [], [], set()
    for n in range(1, 41):
        for rate in (0.0, 0.1, 0.2):
            item = [f"w{rng.randrange(10**9)}" if rng.random() < 0.7 else rng.choice(WORDS) for _ in range(n)]
            items.append((len(items), " ".join(item)))
            for before in range(8):
                words = text(rng, before).split() + edited(rng, item, int(n * rate + 1e-9)) + text(rng, 6).split()
                docs.append((len(docs), " ".join(words)))
                if distance(item, words) <= int(n * 0.2 + 1e-9):
                    want.add((docs[-1][0], items[-1][0]))
    assert len(want) > 900
    got = {(r["doc_id"], r["item_id"]) for r in D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert not want - got


def test_items_of_one_to_three_words_match_word_for_word(spark):
    docs = [(1, "we ask: what NOW, then"), (2, "what then now"), (3, "日本語の文です。次の文"), (4, "a b c x d"), (5, "x a b c"), (6, "now")]
    items = [(1, "What now?"), (2, "日本語の文です"), (3, "a b c"), (4, "Now")]
    got = D.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["edit_distance"]) for r in got) == [(1, 1, 0), (1, 4, 0), (2, 4, 0), (3, 2, 0), (4, 3, 0), (5, 3, 0), (6, 4, 0)]


def _recall(rng, lo, hi, change, n=300):
    vocabulary = [f"v{i}" for i in range(2000)]
    some = lambda k: [vocabulary[int(2000 * rng.random() ** 3)] for _ in range(k)]
    items = [some(rng.randint(lo, hi)) for _ in range(n)]
    index = D._Index(list(range(n)), [" ".join(w) for w in items], 0.8, D.RECALL)
    docs = [" ".join(some(40) + change(rng, w, D.most_edits(len(w), 0.8)) + some(40)) for w in items]
    h, at = D.words_of(pa.array(docs))
    found = {(d, i) for d, i, _, _ in D._leaks(index, h, at)}
    return sum((k, k) in found for k in range(n)) / n


def mixed(rng, item, edits):
    w = list(item)
    for _ in range(edits):
        p, how = rng.randrange(len(w)), rng.randrange(3)
        w[p : p + (how != 0)] = [] if how == 2 else [f"new{rng.randrange(10**6)}"]
    return w


@pytest.mark.parametrize("lo,hi", [(1, 4), (5, 5), (6, 7), (8, 13), (14, 29), (30, 79), (80, 160)])
def test_recall_by_length_at_the_most_edits(lo, hi):
    rng = random.Random(lo)
    assert _recall(rng, lo, hi, edited) >= 0.99 and _recall(rng, lo, hi, mixed) >= 0.99


def test_more_recall_takes_more_walks_or_fewer_steps():
    for n in range(5, 200):
        (s1, w1), (s2, w2) = D.plan(n, 0.8, 0.9), D.plan(n, 0.8, 0.9999)
        assert s2 < s1 or (s2 == s1 and w2 >= w1)


def test_null_and_integer_ids(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(None, item), (2, item)], "doc_id int, text string")
    items = spark.createDataFrame([(None, item), (5, "one two"), (6, "gamma delta")], "item_id int, text string")
    got = D.find(docs, items)
    assert dict(got.dtypes)["item_id"] == "int" and dict(got.dtypes)["doc_id"] == "int"
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(d, i) for d in (None, 2) for i in (None, 6)}


def test_quotes_and_dashes_of_any_kind_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "so “what’s the answer” — he asked… «then» nothing")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "\"what's the answer\" - he asked... 'then'")], "item_id long, text string")
    assert [r["edit_distance"] for r in D.find(docs, items).collect()] == [0]
