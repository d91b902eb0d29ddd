import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from kinlink.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 1]


def check(rows, got, size):
    seqs = defaultdict(list)
    pieces = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= size
    for i, t in rows:
        want = ids(t)
        for r in pieces[i]:
            part = np.array(want[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["start"] == r["piece"] * size and len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
    return len(seqs)


def test_token_bytes_match_the_library():
    rng = random.Random(1)
    tokenizer = Tokenizer.from_file(PATH)
    letters = "aAbzZ 09'\"-.,;!?\t\n\rßÀÖØöÿéÑªº²½¿¡«»“”‘’–…€sStTdDlLmMrReEvV"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["İstanbul ΣΑΣ", "a b", "x\x1cy", "<|endoftext|> hi", "你好 мир", "é", "", "don't we'll"]
    for t in texts:
        assert np.frombuffer(packing.token_bytes(t, PATH), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_cache_turns(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3 * (packing.ENTRY + 2))  # three strings of one letter
    made = []
    k = packing._Known(lambda x: made.append(x) or x.encode())
    for x in "abcabcdabcdeab":
        assert k[x] == x.encode()
    assert len(k) <= 3 and len(k.older) <= 3 and len(made) < 14
    long = "x" * (packing.LONG + 1)
    assert k[long] == long.encode() and long not in k and long not in k.older


def test_packing(spark):
    rows = [(i, "word " * (i * 7 % 90)) for i in range(300)] + [(1000, None), (1001, ""), (1002, "x " * 500), (1003, "y " * 127), (1004, "y " * 128)]
    df = spark.createDataFrame([(*r, 5, "q") for r in rows], "doc_id long, text string, piece int, offset string")
    got = packing.pack(df, PATH, size=128).collect()
    n = check(rows, got, 128)
    total = sum(len(ids(t)) for _, t in rows)
    assert sum(r["length"] for r in got) == total and n <= -(-total // 128) + 3
    empty = [r for r in got if r["doc_id"] in (1000, 1001)]
    assert [r["length"] for r in empty] == [1, 1]
    assert [r["length"] for r in got if r["doc_id"] == 1003] == [128]
    assert sorted(r["length"] for r in got if r["doc_id"] == 1004) == [1, 128]


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c")] * 5 + [(None, "a b c")], "doc_id long, text string")
    got = packing.pack(df, PATH, size=8).collect()
    assert len(got) == 6 and len({(r["sequence_id"], r["offset"]) for r in got}) == 6
    assert packing.pack(df.limit(0), PATH).count() == 0


def brute_plan(histogram, size):
    """Best two fit, bin by bin."""
    left = Counter(histogram)
    bins = []
    while +left:
        def longest(most):
            return max((x for x, n in left.items() if n and x <= most), default=0)

        b, free = [], size
        while x := longest(free):
            b.append(x)
            left[x] -= 1
            free -= x
        if free and len(b) > 1:
            gap = free + b[-1]
            pair = max(((x, y) for x in left for y in left if x >= y and x + y <= gap and left[x] > 0 and left[y] > (x == y)), key=lambda p: (p[0] + p[1], p[0]), default=None)
            if pair and sum(pair) > b[-1]:
                left[b[-1]] += 1
                b[-1:] = pair
                left.subtract(pair)
        bins.append(b)
    return bins


def test_plan_packs_everything_as_well_as_bin_by_bin():
    rng = random.Random(4)
    for _ in range(60):
        size = rng.choice((20, 64, 100))
        h = Counter(rng.randrange(1, size + 1) for _ in range(rng.randrange(1, 120)))
        plan = packing.plan(dict(h), size)
        used = Counter()
        for times, b in plan:
            assert times > 0 and sum(b) <= size
            for x in b:
                used[x] += times
        assert used == h
        assert sum(t for t, _ in plan) <= len(brute_plan(h, size)) * 1.05 + 1


def test_plan_size_does_not_grow_with_the_pieces():
    rng = random.Random(9)
    h = Counter(int(rng.expovariate(1 / 60)) % 256 + 1 for _ in range(5000))
    small, large = packing.plan(dict(h), 256), packing.plan({k: n * 10_000 for k, n in h.items()}, 256)
    assert len(large) < 4 * len(small)
