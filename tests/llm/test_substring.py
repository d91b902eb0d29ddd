import hashlib
import random
from collections import Counter

import pytest

from kinlink.llm import substring
from kinlink.llm.words import hash_words, portions


def brute(rows, window):
    docs = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in docs for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, docs):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    passages = [[f"p{rng.randrange(50)}" for _ in range(rng.randrange(20, 60))] for _ in range(6)]
    rows = []
    for d in range(n):
        w = [f"w{rng.randrange(2000)}" for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(passages)
        if rows and rng.random() < 0.2:
            w = (rng.choice(rows)[1] or "").split()
            if w:
                w[rng.randrange(len(w))] = "changed"
        rows.append((d, rng.choice((" ", "\n", "  ")).join(w)))
    return rows + [(900, None), (901, ""), (902, "same " * 80), (903, "a b " * 40), (904, "Äö " * 20), (905, "x")]


def run(spark, rows, window):
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in rows], "doc_id long, text string, n_words int, ranges string").repartition(4)
    return sorted((tuple(r) for r in substring.remove_repeats(df, window).collect()), key=str)


@pytest.mark.parametrize("seed,window", [(1, 35), (2, 12), (3, 9)])
def test_matches_brute_force(spark, seed, window):
    rows = corpus(seed)
    assert run(spark, rows, window) == brute(rows, window)


def test_small_flushes_and_a_full_bitmap(spark, monkeypatch):
    monkeypatch.setattr(substring, "MAX_BITS", 4)
    monkeypatch.setattr(substring, "FLUSH_WORDS", 300)
    monkeypatch.setattr(substring, "FLUSH_ANCHORS", 50)
    rows = corpus(4)
    assert run(spark, rows, 20) == brute(rows, 20)


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(substring, "SEGMENT", 64)
    rows = corpus(5, 25)
    import pyarrow as pa

    h, at = hash_words(pa.array([t for _, t in rows], pa.string()))
    for window in (9, 35):
        windows = sorted((int(d), int(w)) for d, f, e, _ in substring._runs(h, at, window) for d, a, b in zip(d, f, e) for w in range(a, b + 1))
        assert windows == sorted((d, i) for d in range(len(rows)) for i in range(at[d], at[d + 1] - window + 1))


def test_repeated_rows_texts_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text), (1, text), (1, "other text"), (None, text + " tail"), (2, "short")]
    got = run(spark, rows, 35)
    assert got == brute(rows, 35)
    assert run(spark, [], 35) == []
    kept = {r["doc_id"]: r["kept_text"] for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 35, with_text=True).collect()}
    assert kept[None] == "tail" and kept[2] == "short"


def test_words_match_split():
    import pyarrow as pa

    rng = random.Random(0)
    texts = [None, "", " ", "a", "x" * 3_000_000, "a " * 700_000] + ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1cé\u2003Z") for _ in range(rng.randrange(40))) for _ in range(300)]
    column = pa.array(texts, pa.string())
    h, at = hash_words(column)
    known = {}
    for t, a, b in zip(texts, at, at[1:]):
        words = (t or "").encode().split()
        assert len(words) == b - a
        for w, x in zip(words[:1000], h[a : a + 1000].tolist()):
            assert known.setdefault(x, w) == w
    assert len(set(known.values())) == len(known)
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    assert sum((p.column("text").to_pylist() for p in portions([batch], most=64)), []) == texts


@pytest.mark.parametrize("flush", [300, 2_000_000])
def test_heavy_anchors_are_dealt_by_whole_windows(spark, monkeypatch, flush):
    monkeypatch.setattr(substring, "HEAVY", 2)
    monkeypatch.setattr(substring, "FLUSH_WORDS", flush)
    rng = random.Random(11)
    common = [f"c{i}" for i in range(30)]  # shorter than the window: repeats only with equal words beside it
    rows = [(i, " ".join([f"w{rng.randrange(9)}" for _ in range(rng.randrange(40))] + common + [f"v{rng.randrange(3)}" for _ in range(20)])) for i in range(80)]
    rows += [(200 + i, " ".join(common * 2)) for i in range(9)] + corpus(6, 20)
    assert run(spark, rows, 35) == brute(rows, 35)


def test_rows_with_a_null_id_and_equal_text(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text)] * 5 + [(None, "short"), (3, text + " end")]
    assert run(spark, rows, 35) == brute(rows, 35)
