import zlib

import numpy as np

from kinlink.llm import langid

DATA = "/root/testdata/sf0.01/documents.parquet"


def brute_vector(text):
    """Trigram vectors bundled one at a time."""
    v = np.random.default_rng(langid.SEED).integers(0, 2, (langid.LETTERS, langid.DIM), dtype=np.int8).astype(int) * 2 - 1
    table = langid._letter_table()
    x = [0]
    for c in text.lower():
        k = int(table[ord(c)])
        if k or x[-1]:
            x.append(k)
    if x[-1]:
        x.append(0)
    out = np.zeros(langid.DIM, int)
    if any(x):
        for a, b, c in zip(x, x[1:], x[2:]):
            out += np.roll(v[a], 2) * np.roll(v[b], 1) * v[c]
    return out


def test_vectors_match_brute_force():
    texts = ["Hello, World!  äöü ß", "a", "", None, "1234 !!", "привет мир", " x y ", "The quick brown fox"]
    got = langid.vectors(texts)
    for t, row in zip(texts, got):
        assert (row == brute_vector(t or "")).all(), t


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0}
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, "the cat and the hat", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", None), (5, "12 !!", "de"), (6, "the and the", None), (6, "the and the", None), (None, "und die der", "de"), (8, "the " * 300_000, "en")]
    df = spark.createDataFrame([(*r, "zz", 9.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert by[3] == by[4] == by[5] == ("und", 0.0)
    assert by[6][0] == "en" and by[8][0] == "en"
    assert langid.identify(df.limit(0)).count() == 0


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.identify(df).collect()] == ["und"]


def test_label_is_no_input(spark):
    docs = spark.read.parquet(DATA).limit(50)
    p = langid.learn(docs)
    other = docs.withColumn("lang", docs["source"])
    a, b = (sorted((r["doc_id"], r["lang_pred"]) for r in langid.predict(d, p).collect()) for d in (docs, other))
    assert a == b


def test_cuts_of_long_texts_change_nothing(monkeypatch):
    text = "  Ein l\u00e4ngerer Text, 12 mit L\u00fccken --  und   W\u00f6rtern. " * 7
    whole = langid.vectors([text, " 1 ", "a"])
    for n in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "BLOCK_CHARS", n)
        assert (langid.vectors([text, " 1 ", "a"]) == whole).all()
