"""Language identification by hyperdimensional profiles.

Every letter has a random +1/-1 vector.  A trigram's vector binds (multiplies) its letters'
vectors, each permuted (rolled) by its place.  A text's vector bundles (adds) those of its trigrams; a
language's prototype bundles the vectors of all texts labelled with it.  A text gets the language
whose prototype has the largest cosine with its vector.

Letters: a-z and U+00DF-U+00FF have vectors of their own; all other letters share 68 by their
code point modulo 68, so alphabets of up to 68 consecutive letters stay distinct.  Everything
else is a gap; runs of gaps count once.

Defined cases: null text, or text without a letter, gives ``und`` with score 0; with nothing to
learn from, every prediction is ``und``; ties go to the first language by name; labels that
are null are not learnt from; repeated rows are treated alike; an empty table gives no rows; other
columns are not looked at, whatever their names.  Work per task is bounded by the
block size, whatever the length of a text: long texts are counted piece by piece.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.words import portions
from kinlink.plans.scratch import ship

DIM = 1024
SEED = 20_11
LETTERS = 128  # 0 is the gap
UND = "und"
#: Texts vectorised together, and code points looked at together.
BLOCK_ROWS = 256
BLOCK_CHARS = 1 << 20
#: Kinds of trigrams whose vectors are made together.
BLOCK_KINDS = 2048


@functools.cache
def _letter_table() -> np.ndarray:
    """Letter index of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if not 0xD800 <= cp <= 0xDFFF and chr(cp).isalpha():
            table[cp] = cp - 96 if 97 <= cp <= 122 else cp - 0xDF + 27 if 0xDF <= cp <= 0xFF else 60 + cp % 68
    return table


@functools.cache
def _letter_vectors() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of the letters in the first, second and third place."""
    v = np.random.default_rng(SEED).integers(0, 2, (LETTERS, DIM), dtype=np.int8) * 2 - 1
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


def _codes(text: str) -> Iterator[np.ndarray]:
    """Trigram codes of the text piece by piece, a gap at both ends included; none if it has no letter.

    A piece begins with the last two letters or gaps of the one before, so a cut adds and loses nothing.
    """
    before = np.zeros(1, np.int32)
    for at in range(0, len(text), BLOCK_CHARS):
        cp = np.frombuffer(text[at : at + BLOCK_CHARS].lower().encode("utf-32-le", "replace"), np.uint32)
        x = np.concatenate((before, _letter_table()[cp], [0] if at + BLOCK_CHARS >= len(text) else [])).astype(np.int32)
        keep = np.ones(len(x), bool)
        keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
        x = x[keep]
        if len(x) > 2:
            yield (x[:-2] * LETTERS + x[1:-1]) * LETTERS + x[2:]
        before = x[-2:]


def vectors(texts: list[str | None]) -> np.ndarray:
    """A row of DIM sums for each text; zeros where it has no letter."""
    first, second, third = _letter_vectors()
    out = np.zeros((len(texts), DIM), np.float32)
    place = np.empty(LETTERS**3, np.int32)
    for a in range(0, len(texts), BLOCK_ROWS):
        pieces: list[tuple[int, np.ndarray]] = []
        chars = 0

        def add() -> None:
            codes = np.concatenate([c for _, c in pieces])
            rows = np.concatenate([np.full(len(c), i, np.int64) for i, c in pieces])
            lo, hi = pieces[0][0], pieces[-1][0] + 1
            seen = np.zeros(LETTERS**3, bool)
            seen[codes] = True
            kinds = np.flatnonzero(seen)
            place[kinds] = np.arange(len(kinds), dtype=np.int32)
            counts = np.bincount((rows - lo) * len(kinds) + place[codes], minlength=(hi - lo) * len(kinds)).reshape(hi - lo, len(kinds))
            for k in range(0, len(kinds), BLOCK_KINDS):
                part = kinds[k : k + BLOCK_KINDS]
                bound = (first[part // LETTERS**2] * second[part // LETTERS % LETTERS] * third[part % LETTERS]).astype(np.float32)
                out[lo:hi] += counts[:, k : k + BLOCK_KINDS].astype(np.float32) @ bound
            pieces.clear()

        for i, text in enumerate(texts[a : a + BLOCK_ROWS], a):
            for codes in _codes(text or ""):
                pieces.append((i, codes))
                chars += len(codes)
                if chars > BLOCK_CHARS:
                    add()
                    chars = 0
        if pieces:
            add()
    return out


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language.  Sums are made per task, then per dimension: what reaches the
    driver is DIM numbers a language, however many texts there are."""
    ship(labelled.sparkSession)
    rows = labelled.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in portions(batches):
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            v = vectors(texts)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + v[[i for i, x in enumerate(langs) if x == lang]].sum(0, dtype=np.float64)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)], ["lang", "dim", "value"])

    sums = rows.mapInArrow(run, "lang string, dim int, value double").groupBy("lang", "dim").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():
        out.setdefault(r["lang"], np.zeros(DIM))[r["dim"]] = r["value"]
    return {k: out[k] / (np.linalg.norm(out[k]) or 1.0) for k in sorted(out) if out[k].any()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` plus ``lang_col`` and ``score_col`` (cosine, 0 to 1); columns of those names are replaced."""
    spark = docs.sparkSession
    ship(spark)
    names = list(prototypes)
    matrix = np.stack([prototypes[k] for k in names]).astype(np.float32) if names else np.zeros((0, DIM), np.float32)
    base = docs.drop(*[c for c in (lang_col, score_col) if c != text_col])
    schema = base.select("*", F.lit("").alias(lang_col), F.lit(0.0).alias(score_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, text_col):
            v = vectors(b.column(text_col).to_pylist())
            norm = np.linalg.norm(v, axis=1)
            none = (norm == 0) | (not names)
            cosine = v @ matrix.T / np.where(norm == 0, 1, norm)[:, None]
            best = cosine.argmax(1) if names else np.zeros(len(v), int)
            langs = [UND if z else names[k] for z, k in zip(none, best)]
            scores = [0.0 if z else min(1.0, max(0.0, float(cosine[i, best[i]]))) for i, z in enumerate(none)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, lang_col, score_col])

    return base.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id's text has remainder 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the rows that aren't held out, predict all: id, held_out, lang_pred, score."""
    prototypes = learn(docs.filter(~held_out(id_col)), text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("__kl_id"), F.col(text_col).alias("__kl_text"), held_out(id_col).alias("held_out"))
    return predict(rows, prototypes, "__kl_text").select(F.col("__kl_id").alias(id_col), "held_out", "lang_pred", "score")
