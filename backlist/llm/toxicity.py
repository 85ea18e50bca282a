"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

At most ``LABELLED_ROWS`` labelled documents (both classes evenly, ids that
hash lowest) are the examples.  They are indexed over all their terms, with
inverse document frequencies counted over all documents; a document's terms
that no example has weigh as those of no document, and count in its norm.
Postings stand in blocks of at most ``BLOCK`` examples that are alike (parted
again and again along their first principal direction), with each heavy term's
largest weight per block: a search adds up the short lists of the rarer terms,
visits the two blocks of the largest upper bounds, then those whose bound
reaches the k-th best similarity so far, so it finds exactly the k nearest
(ties to the smaller doc_id).  The neighbours are returned as evidence.

The score has two votes, weighted by similarity: of these neighbours, and of
the nearest under the chosen terms alone, whose chi-square against the label is
significant after Bonferroni's correction and that stand in ``SUPPORT`` of a
class's examples, at most ``TERMS`` of them.  A logistic curve, fitted on
left-out votes of the examples with the classes' true shares, calibrates them.

Defined cases: a text without any term of the examples (null and empty ones
too) has no neighbours and a vote of 0; without labelled rows of both classes
every score is the labelled share of toxic rows (0 without any); very long
texts are scored whole; repeated rows are scored row by row; contradicting
labels of a doc_id count as toxic; equal votes give equal scores; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backlist.llm.common import blocks, encoded, map_arrow, word_hashes
from backlist.llm.text import HashIndex, units

LABELLED_ROWS = 4_000
TERMS = 1_024
SUPPORT = 0.01  # a term stands in this share of one class's examples at least
NEIGHBOURS = 15
BLOCK = 256
AT_ONCE, POSTINGS = 64, 1 << 20  # documents searched together, and their short lists' postings but for one document
ABOVE = 1 + 1e-9  # above all rounding
HEAVY = 1 / 16  # the share of the examples from which a term's list is read by blocks
DIRECTIONS = 1_024  # the terms, heaviest first, by which examples are judged alike
THRESHOLD = 0.3


def term_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(hash of the term, document)`` of every term occurrence."""
    buf, start, end, first = units(texts)
    return word_hashes(buf, start, end), np.repeat(np.arange(len(texts)), np.diff(first))


def _chosen(sets: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Hashes of the terms that tell the classes apart, the strongest first."""
    term, at = np.unique(np.concatenate(sets), return_inverse=True)
    y = np.repeat(toxic, [len(s) for s in sets])
    a, b = np.bincount(at, y, len(term)), np.bincount(at, ~y, len(term))
    c, d = toxic.sum() - a, (~toxic).sum() - b
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = len(toxic) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    chi = np.nan_to_num(chi)
    level = 0.05 / max(len(term), 1)
    # the 1 - level quantile of chi-square with one degree, from above
    least = 2 * (math.log(1 / level))
    fit_ = (chi > least) & (np.maximum(a / max(toxic.sum(), 1), b / max((~toxic).sum(), 1)) >= SUPPORT)
    order = np.lexsort((term, -chi))
    return term[order[fit_[order]][:TERMS]]


def alike(example: np.ndarray, term: np.ndarray, w: np.ndarray, n: int, block: int) -> list[np.ndarray]:
    """The n examples in blocks of at most so many, each of alike ones."""
    heavy = np.argsort(-np.bincount(term, w * w), kind="stable")[:DIRECTIONS]
    place = np.full(int(term.max()) + 1, -1)
    place[heavy] = np.arange(len(heavy))
    x = np.zeros((n, len(heavy)), dtype=np.float32)
    some = place[term] >= 0
    x[example[some], place[term[some]]] = w[some]
    out, todo = [], [np.arange(n)]
    while todo:
        part = todo.pop()
        if len(part) <= block:
            out.append(part)
            continue
        c = x[part] - x[part].mean(axis=0)
        v = c[int(np.argmax((c * c).sum(axis=1)))]
        for _ in range(12):  # power iteration towards the first principal direction
            v = c.T @ (c @ v)
            v = v / max(float(np.sqrt(v @ v)), 1e-30)
        along = c @ v
        order = np.argsort(along, kind="stable")
        # at the widest gap, an eighth of the part away from its ends
        lo = max(len(part) // 8, 1)
        cut = lo + int(np.argmax(np.diff(along[order])[lo - 1:len(part) - lo]))
        todo += [part[order[cut:]], part[order[:cut]]]
    return out


def _largest(x: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row, -1 where a row is shorter."""
    at = x.shape[-1] - k
    return np.partition(x, at, axis=-1)[..., at] if at >= 0 else np.full(x.shape[:-1], -1.0)


class Index:
    """Block-max inverted index of the examples' TF-IDF vectors.

    Terms in fewer than ``HEAVY`` of the examples have short lists, which a
    search adds up whole.  Those of the heavy terms stand block by block with
    their largest weights, and are read only where these, with the sums so far,
    can reach the k-th best.
    """

    def __init__(self, terms: np.ndarray, idf: np.ndarray, ids: np.ndarray, toxic: np.ndarray,
                 example: np.ndarray, term: np.ndarray, tf: np.ndarray, blocks: np.ndarray, unseen: float = 0.0) -> None:
        """``blocks`` has each example's block, ascending; ``unseen`` is the
        weight of a term that stands in no document."""
        self.terms, self.idf, self.ids, self.toxic, self.unseen = terms, idf, ids, toxic, unseen
        w = (1 + np.log(tf)) * idf[term]
        norm = np.sqrt(np.bincount(example, w * w, len(ids)))
        w = w / norm[example]
        self.n_blocks = int(blocks[-1]) + 1
        self.edge = np.searchsorted(blocks, np.arange(self.n_blocks + 1))
        df = np.bincount(term, minlength=len(terms))
        self.heavy = np.full(len(terms), -1)
        big = np.flatnonzero(df >= HEAVY * len(ids))
        self.heavy[big] = np.arange(len(big))
        at = self.heavy[term]
        self.dense = np.zeros((len(big), len(ids)))
        self.dense[at[at >= 0], example[at >= 0]] = w[at >= 0]
        self.top = np.maximum.reduceat(self.dense, self.edge[:-1], axis=1)
        example, term, w = example[at < 0], term[at < 0], w[at < 0]
        order = np.lexsort((example, term))
        self.example, self.w = example[order], w[order]
        self.begin = np.searchsorted(term[order], np.arange(len(terms) + 1))
        self.known = None
        self.searches = self.visited = 0  # blocks visited, by all searches

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each term, -1 where the index hasn't it."""
        if self.known is None:
            self.known = HashIndex(1 << max(14, (2 * len(self.terms)).bit_length()))
            self.known.add(self.terms)
        return self.known.find(hashes)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def queries(self, hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``(terms, counts, begin of each document, sum of squares of the terms
        that the index hasn't)`` of n documents."""
        k = self.find(hashes)
        pair, tf = np.unique(doc[k >= 0] * len(self.terms) + k[k >= 0], return_counts=True)
        return pair % len(self.terms), tf, np.searchsorted(pair, np.arange(n + 1) * len(self.terms)), \
            self.strange(hashes[k < 0], doc[k < 0], n) if self.unseen else np.zeros(n)

    def strange(self, hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Sum of squares, for each document, of terms that no example has."""
        order = np.lexsort((hashes, doc))
        h, d = hashes[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        at = np.flatnonzero(new)
        tf = np.diff(np.append(at, len(h)))
        return np.bincount(d[at], ((1 + np.log(tf)) * self.unseen) ** 2, n)

    def vectors(self, term: np.ndarray, tf: np.ndarray, cut: np.ndarray, strange: np.ndarray) -> np.ndarray:
        """The weights of the documents' terms, in vectors of length 1."""
        w = (1 + np.log(tf)) * self.idf[term]
        doc = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
        return w / np.sqrt(np.bincount(doc, w * w, len(cut) - 1) + strange)[doc]

    def vector(self, term: np.ndarray, tf: np.ndarray, strange: float = 0.0) -> np.ndarray:
        return self.vectors(term, tf, np.array([0, len(term)]), np.array([strange]))

    def nearest(self, term: np.ndarray, w: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """``(examples, similarities)`` of one document's k nearest, nearest first."""
        return self.nearest_of(term, w, np.array([0, len(term)]), k, np.array([but]))[0]

    def nearest_of(self, term: np.ndarray, w: np.ndarray, cut: np.ndarray, k: int,
                   but: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of the documents whose terms ``cut`` parts, each without
        the example that ``but`` names (-1: none)."""
        n, out, i = len(cut) - 1, [], 0
        but = np.full(n, -1) if but is None else but
        short = np.where(self.heavy[term] < 0, self.begin[term + 1] - self.begin[term], 0)
        total = np.append(0, np.cumsum(short))[cut]
        while i < n:
            j = max(i + 1, min(i + AT_ONCE, int(np.searchsorted(total, total[i] + POSTINGS, side="right")) - 1))
            out += self._nearest(term, w, cut[i:j + 1], k, but[i:j])
            i = j
        return out

    def _nearest(self, term: np.ndarray, w: np.ndarray, cut: np.ndarray, k: int, but: np.ndarray) -> list:
        n, m = len(cut) - 1, len(self.ids)
        term, w, cut = term[cut[0]:cut[-1]], w[cut[0]:cut[-1]], cut - cut[0]
        doc, at = np.repeat(np.arange(n), np.diff(cut)), self.heavy[term]
        big = at >= 0
        heavy = np.zeros((n, len(self.dense)))
        heavy[doc[big], at[big]] = w[big]
        # the short lists, whole
        lo = self.begin[term[~big]]
        size = self.begin[term[~big] + 1] - lo
        p = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        sums = np.bincount(np.repeat(doc[~big] * m, size) + self.example[p], self.w[p] * np.repeat(w[~big], size), n * m)
        sums = sums.reshape(n, m)
        bound = (np.maximum.reduceat(sums, self.edge[:-1], axis=1) + heavy @ self.top) * ABOVE
        # the two most promising blocks, then all that the k-th best leaves in reach
        first = np.argsort(-bound, axis=1, kind="stable")[:, :2]
        todo = np.zeros((n, self.n_blocks), dtype=bool)
        todo[np.arange(n)[:, None], first] = True
        todo &= bound > 0
        full, own = np.full((n, m), -1.0), np.flatnonzero(but >= 0)
        self.searches += n
        for rest in (~todo, None):
            self.visited += int(todo.sum())
            for b in np.flatnonzero(todo.any(axis=0)).tolist():
                some, part = np.flatnonzero(todo[:, b]), slice(self.edge[b], self.edge[b + 1])
                full[some, part] = sums[some, part] + heavy[some] @ self.dense[:, part]
            full[own, but[own]] = -1
            if rest is not None:
                place = self.edge[first][:, :, None] + np.arange(np.diff(self.edge).max())
                seen = np.where(place < self.edge[first + 1][:, :, None],
                                full[np.arange(n)[:, None, None], np.minimum(place, m - 1)], -1).reshape(n, -1)
                least = np.maximum(_largest(seen, k) / ABOVE, 0)
                todo = rest & (bound >= least[:, None]) & (bound > 0)
        out = []
        for d in range(n):
            e = np.flatnonzero(full[d] >= max(least[d], np.finfo(float).tiny))
            if len(e) > 2 * k:
                e = e[full[d, e] >= _largest(full[d, e], k) / ABOVE]
            # once more term by term, so that equal examples have equal sums
            mine = slice(cut[d], cut[d + 1])
            own_at, own_w = at[mine][big[mine]], w[mine][big[mine]]
            s = sums[d, e] + (self.dense[own_at[:, None], e] * own_w[:, None]).sum(axis=0)
            rank = np.lexsort((self.ids[e], -s))[:k]
            out.append((e[rank], np.minimum(s[rank], 1.0)))
        return out

    def vote(self, best: np.ndarray, sim: np.ndarray) -> float:
        """Share of toxic ones among the neighbours, by similarity, in -1..1."""
        return float((sim * (2.0 * self.toxic[best] - 1)).sum() / sim.sum()) if len(best) else 0.0


class Model:
    """The index over all terms, the one over the chosen terms (or None), and
    the calibration of their votes."""

    def __init__(self, index: Index, chosen: Index | None, sets: list[np.ndarray], counts: list[np.ndarray],
                 prior: float) -> None:
        self.index, self.chosen = index, chosen
        toxic = index.toxic
        # each example's left-out votes
        x = [self.features(*f) for f in zip(*(self.left_out(i, sets, counts) for i in (index, chosen)))]
        x, y = np.array(x), toxic.astype(float)
        size = np.array([(~toxic).sum(), toxic.sum()], dtype=float)
        cost = np.array([1 - prior, prior]) / np.maximum(size, 1)  # undoes the even draw of the classes
        weight = np.where(toxic, cost[1], cost[0])
        weight = weight / weight.sum()

        def loss(a: np.ndarray) -> float:
            z = x @ a
            return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 5e-4 * (a @ a))

        self.a = np.zeros(x.shape[1])
        for _ in range(200):  # Newton's steps with a small ridge, shortened until they gain
            p = 1 / (1 + np.exp(-(x @ self.a)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(self.a))
            step = np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-3 * self.a)
            while loss(self.a - step) > loss(self.a) and abs(step).max() > 1e-9:
                step = step / 2
            if abs(step).max() <= 1e-9:
                break
            self.a = self.a - step

    @staticmethod
    def left_out(index: Index | None, sets: list[np.ndarray], counts: list[np.ndarray]) -> list:
        """Each example's nearest among the others."""
        if not index:
            return [None] * len(sets)
        k, tf = index.find(np.concatenate(sets)), np.concatenate(counts)
        cut = np.append(0, np.cumsum(k >= 0))[np.cumsum([0] + [len(h) for h in sets])]
        term, tf = k[k >= 0].astype(np.int64), tf[k >= 0]
        # an example's own terms are all known to the index of the whole vocabulary
        w = index.vectors(term, tf, cut, np.zeros(len(sets)))
        return index.nearest_of(term, w, cut, NEIGHBOURS, np.arange(len(sets)))

    def features(self, near: tuple, told: tuple | None) -> list[float]:
        told = told or ((), ())
        return [1.0, self.index.vote(*near), self.index.vote(*told), float(len(told[0]) > 0)]

    def score(self, near: tuple, told: tuple | None) -> float:
        return float(1 / (1 + math.exp(-float(np.dot(self.features(near, told), self.a)))))


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column) -> Index | float:
    """The whole-vocabulary index of ``learn``'s model."""
    model = learn(docs, labels, learn_from)
    return model.index if isinstance(model, Model) else model


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column) -> Model | float:
    """The model over the labelled documents that ``learn_from`` admits, or
    the toxic share where a class is missing."""
    judged = (labels.where(learn_from & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").alias("toxic")))
    seen, bad = judged.agg(F.count(F.lit(1)), F.sum((F.col("toxic") == 1).cast("int"))).first()
    if not seen or not bad or bad == seen:
        return (bad or 0) / seen if seen else 0.0
    half = LABELLED_ROWS // 2
    drawn = [judged.where(F.col("toxic") == v).orderBy(F.xxhash64("id"), "id").limit(half) for v in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            h, doc = term_counts(encoded(b.column(1)))
            one, n = np.unique(np.stack([doc.astype(np.uint64), h]), axis=1, return_counts=True)
            cut = np.searchsorted(one[0], np.arange(b.num_rows + 1, dtype=np.uint64))
            pack = [(one[1][i:j].tobytes(), n[i:j].astype(np.int32).tobytes()) for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array(x, pa.binary()) for x in zip(*pack)]],
                                             ["id", "toxic", "h", "n"])

    # at most LABELLED_ROWS ids, and so documents but for repeated ids, whose first one counts
    sample = texts.join(F.broadcast(drawn[0].union(drawn[1])), "id")
    sample = sample.groupBy("id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = sorted(map_arrow(sample, run, "id long, toxic int, h binary, n binary").collect(), key=lambda r: r["id"])
    if len({r["toxic"] for r in rows}) < 2:
        return bad / seen
    sets = [np.frombuffer(bytes(r["h"]), dtype=np.uint64) for r in rows]
    counts = [np.frombuffer(bytes(r["n"]), dtype=np.int32) for r in rows]
    terms = np.unique(np.concatenate(sets))
    if not len(terms):
        return bad / seen
    idf, unseen = _idf(docs, terms)

    def postings(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = np.argsort(some)
        place = np.full(len(terms), -1)
        place[np.searchsorted(terms, some[own])] = own
        k = place[np.searchsorted(terms, np.concatenate(sets))]
        example = np.repeat(np.arange(len(sets)), [len(h) for h in sets])
        return example[k >= 0], k[k >= 0], np.concatenate(counts)[k >= 0]

    # blocks hold examples that are alike
    example, term, tf = postings(terms)
    groups = alike(example, term, (1 + np.log(tf)) * idf[term], len(rows), BLOCK)
    order, of = np.concatenate(groups), np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    rows, sets, counts = ([x[i] for i in order] for x in (rows, sets, counts))
    toxic, ids = np.array([r["toxic"] == 1 for r in rows]), np.array([r["id"] for r in rows])

    def indexed(some: np.ndarray, unseen: float) -> Index:
        return Index(some, idf[np.searchsorted(terms, some)], ids, toxic, *postings(some), of, unseen)

    chosen = _chosen(sets, toxic)
    # among the chosen terms a norm changes no vote, so theirs counts no others
    return Model(indexed(terms, unseen), indexed(chosen, 0.0) if len(chosen) else None, sets, counts, bad / seen)


def _idf(docs: DataFrame, terms: np.ndarray) -> tuple[np.ndarray, float]:
    """Inverse document frequencies over all documents, and that of a term
    which stands in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df, n = HashIndex(1 << max(14, (2 * len(terms)).bit_length())), np.zeros(len(terms), dtype=np.int64), 0
        known.add(terms)
        for b in blocks(batches):
            h, doc = term_counts(encoded(b.column(0)))
            k = known.find(h)
            pair = np.unique(doc[k >= 0] * len(terms) + k[k >= 0])
            df += np.bincount(pair % len(terms), minlength=len(terms))
            n += b.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, at)), pa.array(np.append(n, df[at]))], ["term", "n"])

    n = np.zeros(len(terms) + 1)
    for r in map_arrow(docs.select("text"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        n[r["term"] + 1] = r["n"]  # one row per term of the examples
    return np.log((1 + n[0]) / (1 + n[1:])) + 1, float(np.log(1 + n[0]) + 1)


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """``(doc_id, score, predicted, evidence)`` of every row; evidence lists
    the neighbours' ``(doc_id, similarity, toxic)``, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            n, none = b.num_rows, (np.zeros(0, np.int64), np.zeros(0))
            out, near = [model] * n, [none] * n
            if isinstance(model, Model):
                h, doc = term_counts(encoded(b.column(1)))
                found = []
                for index in (model.index, model.chosen):
                    found.append([none] * n)
                    if index:
                        term, tf, cut, strange = index.queries(h, doc, n)
                        found[-1] = index.nearest_of(term, index.vectors(term, tf, cut, strange), cut, NEIGHBOURS)
                near = found[0]
                out = [model.score(*x) for x in zip(*found)]
            best, sim = np.concatenate([x for x, _ in near]), np.concatenate([x for _, x in near])
            ids, toxic = (model.index.ids, model.index.toxic) if isinstance(model, Model) else (best, best > 0)
            why = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0] + [len(x) for x, _ in near]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(ids[best], pa.int64()), pa.array(sim), pa.array(toxic[best])],
                                           ["doc_id", "similarity", "toxic"]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out, pa.float64()), pa.array([int(s >= THRESHOLD) for s in out], pa.int32()), why],
                ["doc_id", "score", "predicted", "evidence"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run,
                     "doc_id long, score double, predicted int, "
                     "evidence array<struct<doc_id: long, similarity: double, toxic: boolean>>")


def remainder(n: int) -> Column:
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, evidence)``: learns from labels
    whose doc_id's remainder by 4 isn't 2, scores all documents."""
    held = F.coalesce(remainder(4) == 2, F.lit(False))
    model = learn(docs, labels, ~held)
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "evidence")
