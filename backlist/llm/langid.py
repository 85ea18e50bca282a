"""Language identification with error-correcting output codes.

Every language gets a codeword of +1 and -1.  One binary linear classifier
per code bit is fitted on hashed byte n-grams (one to three bytes, ASCII
letters in lower case); a text's language is the codeword with the least
weighted loss over the bits, each bit weighted by how well its classifier
separates left-out rows.  Texts whose two nearest codewords are close are
flagged as ambiguous.

The classifiers are fitted on at most ``TRAIN_ROWS`` training rows: of each
language the same number, those whose ids hash lowest (rare ones enter with all
their rows, and every one with a row at least); predictions read every whole
text.

Defined cases: null text or text without a letter is ``und`` with score 0;
without training rows all is ``und``; one learned language is always
predicted; of equally near codewords the language that sorts first is; repeated
rows are predicted row by row; rows with null lang are predicted, not learned
from; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backlist.llm.common import blocks, encoded, map_arrow, mix

DIM = 1 << 12
TRAIN_ROWS = 2_000
BLOCK = 1 << 20
AMBIGUOUS = 0.2  # least gap of the losses of the two nearest codewords
NO_LANGUAGE = "und"


def ngram_vectors(texts: list[bytes]) -> np.ndarray:
    """One row per text: square roots of the hashed n-gram counts, unit length."""
    out = np.zeros((len(texts), DIM), dtype=np.float32)
    for k, t in enumerate(texts):
        n, padded = np.zeros(DIM, dtype=np.int64), b" " + t.lower() + b" "
        for lo in range(0, len(t), BLOCK):  # blocks overlap by two bytes; grams that start in the block count
            b = np.frombuffer(padded[lo:lo + BLOCK + 2], dtype=np.uint8).astype(np.uint32)
            code = b[:BLOCK]
            n += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
            for size in (1, 2):
                code = code[:len(b) - size] + (b[size:size + len(code)] << np.uint32(8 * size))
                n += np.bincount((code * np.uint32(2654435761) + np.uint32(size * 0x51ED270B)) >> np.uint32(20),
                                 minlength=DIM)
        out[k] = np.sqrt(n)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def codewords(n: int) -> np.ndarray:
    """``n`` codewords of +1 and -1 that differ in many bits; no constant bit."""
    if n == 1:
        return np.ones((1, 1), dtype=np.int8)
    bits = 15 if n <= 16 else 63
    rng, best, far = np.random.Generator(np.random.PCG64(n)), None, -1
    for _ in range(300):
        c = rng.integers(0, 2, (n, bits)).astype(np.int8) * 2 - 1
        if (abs(c.sum(axis=0, dtype=np.int64)) == n).any():
            for b in np.flatnonzero(abs(c.sum(axis=0, dtype=np.int64)) == n):
                c[rng.integers(n), b] *= -1
        gap = min(int((c[i] != c[j]).sum()) for i in range(n) for j in range(i))
        if gap > far:
            best, far = c, gap
    return best


class Model:
    """Codewords, one weight vector per bit, and the bits' weights."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        self.langs = sorted(set(langs))
        self.code = codewords(len(self.langs)) if self.langs else np.zeros((0, 1), np.int8)
        if len(self.langs) < 2:
            self.w, self.weight = np.zeros((DIM, 1), np.float32), np.ones(1)
            return
        y = self.code[[self.langs.index(v) for v in langs]].astype(np.float64)
        x = x.astype(np.float64)
        # ridge regression in its dual form; the hat matrix gives left-out predictions
        k = x @ x.T
        inv = np.linalg.inv(k + 0.05 * np.trace(k) / len(k) * np.eye(len(k)))
        alpha = inv @ y
        left_out = y - alpha / np.diag(inv)[:, None]
        self.w = (x.T @ alpha).astype(np.float32)
        right = ((left_out > 0) == (y > 0)).mean(axis=0)
        self.weight = np.log((right + 1e-3) / (1 - right + 1e-3)).clip(0.01)
        self.weight /= self.weight.sum()

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(index of the language, score, ambiguous)`` of each row."""
        margin = (x @ self.w)[:, None, :] * self.code[None]
        loss = (np.maximum(0, 1 - margin) ** 2) @ self.weight
        p = np.exp(-4 * loss)
        p /= p.sum(axis=1, keepdims=True)
        two = np.sort(loss, axis=1)[:, :2]
        unclear = two[:, 1] - two[:, 0] < AMBIGUOUS if two.shape[1] > 1 else np.zeros(len(x), bool)
        best = loss.argmin(axis=1)
        return best, p[np.arange(len(x)), best], unclear


def _has_letter(t: bytes) -> bool:
    return any(chr(c).isalpha() for c in t[:64] if c < 128) or any(c.isalpha() for c in t.decode())


def fit(docs: DataFrame, learn_from: Column) -> Model:
    """The model of the rows that ``learn_from`` admits."""
    rows = docs.where(learn_from & F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("id"), "lang", "text")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n:
        return Model(np.zeros((0, DIM)), [])
    share = F.create_map(*[F.lit(v) for lang, k in sorted(n.items())
                           for v in (lang, min(1.0, 1.1 * TRAIN_ROWS / len(n) / k))])
    drawn = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)) < share[F.col("lang")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            x = ngram_vectors(encoded(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([v.tobytes() for v in x], pa.binary())],
                                             ["id", "lang", "x"])

    # the draw leaves few rows more than the limit of each language; the window sees those alone
    own = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    sample = rows.where(drawn).withColumn("k", F.row_number().over(own)).where(F.col("k") <= max(1, TRAIN_ROWS // len(n)))
    got = map_arrow(sample.drop("k"), run, "id long, lang string, x binary").collect()  # at most TRAIN_ROWS vectors
    got = sorted(got, key=lambda r: (r["lang"], r["id"] is None, r["id"] or 0))
    x = np.stack([np.frombuffer(bytes(r["x"]), dtype=np.float32) for r in got])
    return Model(x, [r["lang"] for r in got])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score, ambiguous)`` of every row."""
    names = np.array([*model.langs, NO_LANGUAGE], dtype=object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            for lo in range(0, batch.num_rows, 512):
                b = batch.slice(lo, 512)
                texts = encoded(b.column(1))
                none = ~np.array([_has_letter(t) for t in texts]) | (not model.langs)
                k, score, unclear = (np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts), bool))
                if model.langs:
                    k, score, unclear = model.predict(ngram_vectors(texts))
                k, score, unclear = np.where(none, -1, k), np.where(none, 0.0, score), unclear & ~none
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[k], pa.string()), pa.array(score, pa.float64()),
                                                  pa.array(unclear)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run,
                     "doc_id long, lang_pred string, score double, ambiguous boolean")


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def identify(docs: DataFrame) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, ambiguous)``: learns from the
    documents whose remainder by 5 isn't 0, predicts all."""
    held = F.coalesce(remainder(5) == 0, F.lit(False))
    model = fit(docs, ~held)
    return predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
