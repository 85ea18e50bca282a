"""Suffix dedup, whitening and hard negatives against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from backlist.llm import negatives, registry, suffixes, whitening
from tests.conftest import SF001
from tests.llm.conftest import text

NAN, INF = float("nan"), float("inf")

# ---- suffix dedup


def brute_suffixes(rows):
    """``(doc_id, bytes, removed, spans, digest)`` of every row: equal rows are
    one document, rows of one id stand in the order of their hash."""
    seen, out = {}, []
    for _, (i, data) in sorted(rows, key=lambda r: r[0]):
        gone = np.zeros(len(data) + 1, dtype=bool)
        for s in range(len(data) - 99):
            w = data[s:s + 100]
            if seen.setdefault(w, (i, data, s)) != (i, data, s):
                gone[s:s + 100] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        out.append((i, len(data), int(gone.sum()), spans,
                    hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def in_order(docs):
    """``((doc, u), (id, bytes))`` of every row, by the operator's order."""
    rows = suffixes._identified(docs).collect()
    return [((r.doc, r.u), (r.doc_id, (r.text or "").encode())) for r in rows]


def got_digests(docs):
    return sorted(map(str, (tuple(r) for r in suffixes.digests(docs).collect())))


def passages(n, seed):
    rng = random.Random(seed)
    shared = [text(rng, rng.randint(12, 60)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [text(rng, rng.randint(0, 40)) for _ in range(3)]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randrange(4), rng.choice(shared)[rng.randint(0, 30):])
        rows.append((i, rng.choice(["", " ", "é", "\n"]).join(parts)))
    return rows


@pytest.mark.parametrize("bucket", [4 << 20, 3000])
def test_suffixes_equal_brute_force(spark, monkeypatch, bucket):
    """Also with buckets so small that splitters part equal windows."""
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", bucket)
    docs = spark.createDataFrame(passages(150, 4), "doc_id long, text string").repartition(3)
    want = brute_suffixes(in_order(docs))
    assert sum(w[2] for w in want) > 5000
    assert got_digests(docs) == sorted(map(str, want))


def test_suffixes_planes(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(suffixes, "RANGES", 3)
    docs = spark.createDataFrame(passages(100, 9), "doc_id long, text string").repartition(2)
    assert got_digests(docs) == sorted(map(str, brute_suffixes(in_order(docs))))


def test_boundaries_are_compared(spark, monkeypatch):
    """One passage in every document: its anchor's suffixes fill many buckets."""
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 1500)
    rng = random.Random(8)
    line = text(rng, 40)[:130]
    docs = spark.createDataFrame([(i, text(rng, 8) + " " + line + " " + text(rng, 8)) for i in range(150)],
                                 "doc_id long, text string")
    want = brute_suffixes(in_order(docs))
    assert sum(w[2] for w in want) >= 149 * 130
    assert got_digests(docs) == sorted(map(str, want))


def test_suffixes_odd_rows(odd_docs, no_docs):
    docs = odd_docs.where("coalesce(length(text), 0) < 20000")
    extra = docs.sparkSession.createDataFrame(
        [(200, "x" * 5000), (201, "ab" * 700), (202, "x" * 150), (203, "abc " * 300), (204, "x" * 100), (205, "x" * 99)],
        "doc_id long, text string")
    docs = docs.unionByName(extra, allowMissingColumns=True)
    assert got_digests(docs) == sorted(map(str, brute_suffixes(in_order(docs))))
    assert suffixes.digests(odd_docs).count() == odd_docs.count()
    assert suffixes.digests(no_docs).count() == 0


def test_multikey_groups_equal_plain_comparison():
    rng = random.Random(2)
    data = ("".join(rng.choices("ab", k=600)) + "ab" * 150 + "a" * 200).encode() + b"\0" * 8
    starts = np.arange(len(data) - 108)
    group = suffixes.multikey_groups(np.frombuffer(data, np.uint8), starts)
    where = {}
    for s in starts.tolist():
        where.setdefault(data[s:s + 100], []).append(s)
    for same in where.values():
        assert len({int(group[s]) for s in same}) == 1 and (group[same[0]] >= 0) == (len(same) > 1)
    assert len(set(group[group >= 0].tolist())) == sum(len(v) > 1 for v in where.values())


def test_removed_spans_merge_what_touches():
    hits = [{"place": 10 << 7 | 3, "mask": 0b101}, {"place": 112 << 7 | 1, "mask": 1}, {"place": 400 << 7 | 2, "mask": 0b10}]
    assert suffixes.removed_spans(hits) == [(10, 212), (401, 501)]
    assert suffixes.removed_spans(None) == []


# ---- whitening

def brute_whitening(rows):
    """By numpy's own covariance of the distinct vectors."""
    x = {i: np.floor(256 * np.array(v, dtype=float)).astype(np.int64) for i, v in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    v = np.cov(fit.T.astype(float), bias=True)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    n, s = len(fit), fit.sum(axis=0)
    return {i: (n, int(((n * y - s) ** 2).sum()), (y - fit.mean(axis=0)) @ u / np.sqrt(e), e / e.sum()) for i, y in x.items()}


def test_whitening_equals_brute_force(spark):
    vectors = spark.read.parquet(f"{SF001}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute_whitening(rows)
    got = whitening.whiten(vectors.unionByName(vectors.where("vec_id < 50").withColumn("vec_id", F.col("vec_id") + 1000)))
    got = got.collect()
    assert len(got) == 4 * (len(rows) + 50)
    sign = {}
    for r in got:
        n, dev, w, share = want[r.vec_id - 1000 if r.vec_id >= 1000 else r.vec_id]
        assert (r.n, r.deviation) == (n, dev) and r.explained == pytest.approx(share[r.component - 1], rel=1e-9)
        sign.setdefault(r.component, np.sign(r.whitened * w[r.component - 1]))
        assert r.whitened == pytest.approx(sign[r.component] * w[r.component - 1], abs=1e-9)
        assert r.identity_error < 1e-9


def test_whitening_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.0, 1.0]), (2, None), (3, [NAN, 1.0]), (4, [INF, 0.0]),
            (5, [None, 1.0]), (6, []), (7, [3.0]), (8, [1.0, 2.0, 3.0]), (9, [2.0, 4.0, 6.0])]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, n long, x int")
    got = whitening.whiten(df).collect()
    two = [r for r in got if r.vec_id in (0, 1, None)]
    assert len(two) == 8 and {r.n for r in two} == {3} and all(r.identity_error < 1e-9 for r in two)
    # one vector of its length has no variance; two make one component
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got if r.vec_id == 7] == [(1, 0, None, None, None)]
    three = sorted((r for r in got if r.vec_id in (8, 9)), key=lambda r: (r.vec_id, r.component))
    assert [r.whitened is None for r in three] == [False, True, True] * 2
    assert abs(three[0].whitened) == pytest.approx(1) and three[0].explained == pytest.approx(1)
    assert whitening.whiten(df.limit(0)).count() == 0


def test_whitening_is_exact_beyond_a_long(spark):
    """Entries whose squares and sums a long can't hold."""
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) * 1e13, rng.uniform(-1, 1) * 1e12]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(df).collect()}
    x = np.array([[int(np.floor(256 * c)) for c in v] for _, v in rows], dtype=object)
    e = np.linalg.eigvalsh(np.cov((x - x.sum(axis=0) // 40).astype(float).T, bias=True))[::-1]
    assert all(r.deviation is None for r in got.values())
    assert got[0, 1].explained == pytest.approx(e[0] / e.sum(), rel=1e-9) and got[0, 1].identity_error < 1e-6


# ---- hard negatives

def brute_negatives(rows, is_anchor):
    """``rows`` are (vec_id, label, integer vector); scores are Python's integers."""
    out = []
    for a, (i, label, x) in enumerate(rows):
        if not is_anchor(i):
            continue
        scores = [(-sum(p * q for p, q in zip(x, y)), j, k, m) for k, (j, m, y) in enumerate(rows) if k != a and len(y) == len(x)]
        scores.sort()
        for p, j, _, m in [s for s in scores if s[3] == label][:5]:
            near = [s for s in scores if s[3] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:10]
            out += [(i, j, r + 1, s[1], -p, -s[0]) for r, s in enumerate(near)]
    return sorted(out)


def mined(df, every):
    return sorted(tuple(r) for r in negatives.mine(negatives.labelled(df), F.col("vec_id") % every == 0).collect())


def clustered(n, seed, dim=16):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, dim)) * 4
    return [(i, int(rng.integers(0, 5)), [float(c) for c in centre[i % 12] + rng.normal(size=dim) * 0.2]) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_negatives_equal_brute_force(spark, monkeypatch, small):
    """Also over several shards, blocks and chunks."""
    if small:
        for name, n in (("SHARD_ROWS", 40), ("BLOCK_ANCHORS", 9), ("CHUNK", 16)):
            monkeypatch.setattr(negatives, name, n)
    rows = clustered(400, 3)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    whole = [(i, m, [int(np.floor(256 * c)) for c in v]) for i, m, v in rows]
    want = brute_negatives(whole, lambda i: i % 10 == 0)
    assert len(want) > 200 and mined(df, 10) == want


def test_bounds_spare_scores():
    """With clustered vectors most scores are never computed."""
    rows = clustered(6000, 5)
    x = np.floor(256 * np.array([r[2] for r in rows])).astype(np.int64)
    t = {"x": x, "row": np.arange(len(x)), "vec_id": np.arange(len(x)), "label": np.array([r[1] for r in rows])}
    a = {k: v[::100] for k, v in t.items()}
    windows = [[negatives.Best(-(1 << 62), 1 << 62, 5)] for _ in range(len(a["x"]))]
    scored = negatives.search(t, a, windows, True)
    assert scored < 0.5 * len(x) * len(a["x"])
    for k, (w,) in enumerate(windows):
        same = (t["label"] == a["label"][k]) & (t["row"] != a["row"][k])
        s = x[same] @ a["x"][k]
        assert w.score.tolist() == np.sort(s)[::-1][:5].tolist()


def test_tree_spans_and_edges_are_distances():
    x = np.random.default_rng(2).integers(-50, 50, (40, 5))
    order, parent, edge = negatives.spanning_tree(x)
    at = np.argsort(order)
    assert sorted(order.tolist()) == list(range(40)) and parent[order[0]] == -1
    for k in order[1:]:
        assert at[parent[k]] < at[k] and edge[k] == pytest.approx(np.linalg.norm(x[k] - x[parent[k]]))


def test_negatives_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.0]), (0, 1, [1.0, 0.0]), (0, 2, [0.5, 0.5]), (1, 1, [0.9, 0.1]), (2, 2, [0.5, 0.0]), (3, 2, [0.5, 0.0]),
            (4, None, [1.0, 1.0]), (5, 3, None), (6, 3, [NAN, 1.0]), (7, 3, [None, 1.0]), (8, 3, []), (9, 4, [1.0]), (10, 4, [0.5]),
            (None, 2, [0.6, 0.0]), (11, 5, [0.3, 0.0]), (20, 6, [-1.0, 0.0]), (12, 6, [1.0, 0.0]), (13, 5, [1e3, -INF])]
    df = spark.createDataFrame([(i, m, v, 1) for i, m, v in rows], "vec_id long, label int, embedding array<double>, row int")
    whole = [(i, m, [int(np.floor(256 * c)) for c in v]) for i, m, v in rows
             if i is not None and m is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    assert mined(df, 10) == brute_negatives(whole, lambda i: i % 10 == 0)
    assert mined(df.limit(0), 10) == []


def test_scores_beyond_floats(spark):
    """Scores that a double can't hold exactly."""
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.uniform(0.2, 1) * 2.0 ** 20 for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    whole = [(i, m, [int(np.floor(256 * c)) for c in v]) for i, m, v in rows]
    assert mined(df, 10) == brute_negatives(whole, lambda i: i % 10 == 0)


def test_registered_negatives_shift_labels(spark):
    got = sorted(tuple(r) for r in registry.op13_hard_negatives(spark, SF001).collect())
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [int(np.floor(256 * c)) for c in r.embedding])
            for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    assert got == brute_negatives(rows, lambda i: i % 100 == 0)
