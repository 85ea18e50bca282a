"""Quality, toxicity, language ID, WARC, nearest neighbours, the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from backlist.llm import forest, langid, quality, toxicity, warc
from backlist.llm.components import connected_components
from tests.conftest import SF01, SF001, SF0001
from tests.llm.conftest import text

import corpus_pipeline


def held(i, n, r):
    return zlib.crc32(str(i).encode()) % n == r


# ---- quality

def test_quality_keeps_the_share_and_the_good(spark):
    docs, labels = (spark.read.parquet(f"{SF001}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.resample(docs, labels).join(labels.select("doc_id", "quality"), "doc_id", "left").collect()
    share = np.mean([r.quality for r in got if r.quality is not None])
    assert abs(sum(r.selected for r in got) / len(got) - min(1, share + quality.RESERVE)) < 0.002
    good = [r.selected for r in got if r.quality == 1]
    bad = [r.selected for r in got if r.quality == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.4
    assert quality.keep_good(docs, labels).count() == sum(r.selected for r in got)


def test_quality_odd_rows(odd_docs, odd_rows, labels, no_docs, no_labels):
    got = quality.resample(odd_docs, labels).collect()
    assert len(got) == len(odd_rows) and [r.log_weight for r in got if r.n_words == 0] == [0.0] * 3
    assert quality.keep_good(odd_docs, labels).schema == odd_docs.schema
    assert quality.keep_good(odd_docs, no_labels).count() == len(odd_rows)
    assert quality.resample(no_docs, labels).count() == quality.keep_good(no_docs, no_labels).count() == 0


def test_weights_equal_brute_force(spark):
    """Counts of words and pairs in plain dictionaries."""
    rng = random.Random(9)
    rows = [(i, text(rng, rng.randint(0, 60)).replace("ba", "Ba")) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.resample(docs, labels).collect()}

    def bag(t):
        w = t.lower().split()
        return Counter([*w, *zip(w, w[1:])])

    def bucket(g):
        b, _, _ = quality.features([(g if isinstance(g, str) else " ".join(g)).encode()])
        return int(b[-1])

    raw, good = Counter(), Counter()
    for i, t in rows:
        for g, n in bag(t).items():
            raw[bucket(g)] += n
            good[bucket(g)] += n * (i < 60 and i % 2 == 1)
    size = quality.BUCKETS
    total = [sum(c.values()) + size for c in (raw, good)]
    for i, t in rows:
        want = sum(n * np.log((good[bucket(g)] + 1) / total[1] / ((raw[bucket(g)] + 1) / total[0])) for g, n in bag(t).items())
        assert got[i].log_weight == pytest.approx(want, abs=1e-9)
    keep = round((0.5 + quality.RESERVE) * len(rows))
    assert sum(r.selected for r in got.values()) == keep
    assert min(r.score for r in got.values() if r.selected) >= max(r.score for r in got.values() if not r.selected)


def test_kth_largest(spark):
    rng = random.Random(1)
    vals = [rng.getrandbits(64) - (1 << 63) for _ in range(500)] + [7] * 20 + [-1, 0, 1]
    df = spark.createDataFrame([(v,) for v in vals], "key long")
    for k in (1, 2, 250, 271, len(vals)):
        assert quality.kth_largest(df, k) == sorted(vals, reverse=True)[k - 1]
    assert quality.kth_largest(df, len(vals) + 1) is None


# ---- toxicity

def toxic_docs(spark, n=400):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        words = text(rng, rng.randint(20, 120)).split()
        bad = rng.random() < 0.2
        for _ in range(3 * bad):
            words[rng.randrange(len(words))] = rng.choice(["Vile", "nasty,", "rotten"])
        rows.append((i, " ".join(words), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_docs(spark)
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    out = [r for r in got if r.held_out]
    assert len(out) > 60 and np.mean([r.predicted == r.toxic for r in out]) > 0.95


def weights(index):
    """All of an index's weights, as ``w[example, term]``."""
    w = np.zeros((len(index.ids), len(index.terms)))
    for t in range(len(index.terms)):
        at = slice(index.begin[t], index.begin[t + 1])
        w[index.example[at], t] = index.w[at]
        if index.heavy[t] >= 0:
            w[:, t] = index.dense[index.heavy[t]]
    return w


def test_equal_examples_by_id(spark):
    """Of many equal examples, over several blocks, the smallest ids are the neighbours."""
    rng = random.Random(8)
    own = [" ".join(rng.choices([a + b for a in "abcdefgh" for b in "mnopqrst"], k=30)) for _ in range(3)]
    rows = [(i, own[rng.randrange(3)], int(i % 3 == 0)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(3)
    m = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    for x in own:
        h, doc = toxicity.term_counts([x.encode()])
        term, tf, cut, strange = m.queries(h, doc, 1)
        best, sim = m.nearest(term, m.vectors(term, tf, cut, strange), 15)
        assert np.allclose(sim, 1) and m.ids[best].tolist() == [i for i, y, _ in rows if y == x][:15]


def test_nearest_examples_are_exact(spark):
    docs, labels = toxic_docs(spark)
    m = toxicity.fit(docs, labels, F.lit(True))
    w = weights(m)
    rng = np.random.default_rng(3)
    for _ in range(100):
        t = rng.choice(len(m.terms), rng.integers(1, len(m.terms) + 1), replace=False)
        q = m.vector(t, rng.integers(1, 5, len(t)))
        best, sim = m.nearest(t, q, 15)
        s = w[:, t] @ q
        assert np.allclose(np.sort(s)[::-1][:len(sim)], sim) and (len(sim) == 15 or (np.sort(s)[::-1][len(sim):] < 1e-12).all())


def test_toxicity_evidence_is_over_the_whole_vocabulary(spark):
    """Every document with words has the neighbours that plain TF-IDF cosine has."""
    docs, labels = toxic_docs(spark)
    got = toxicity.toxicity(docs, labels).collect()
    texts = {r.doc_id: r.text.lower().replace(",", " , ").split() for r in docs.collect()}
    examples = [i for i in texts if not held(i, 4, 2)]
    known = {w for i in examples for w in texts[i]}
    df = Counter(w for t in texts.values() for w in set(t))
    words = sorted(df)
    # a word that no example has weighs as one of no document
    idf = np.log((1 + len(texts)) / (1 + np.array([df[w] if w in known else 0 for w in words]))) + 1
    v = {}
    for i, t in texts.items():
        n = Counter(t)
        x = np.array([1 + np.log(n[w]) if n[w] else 0.0 for w in words]) * idf
        v[i] = x / np.linalg.norm(x)
    for r in got:
        sims = np.sort([v[r.doc_id] @ v[e] for e in examples])[::-1][:15]
        assert np.allclose([x.similarity for x in r.evidence], sims)
        assert all(abs(x.similarity - v[r.doc_id] @ v[x.doc_id]) < 1e-9 for x in r.evidence)


def test_blocks_are_skipped(spark):
    """Examples of four vocabularies: a search leaves out most blocks, and finds
    what a search of all would."""
    rng, rows = random.Random(6), []
    for i in range(3000):
        own = ["abcd"[i % 4] + "rstuvw"[k // 50] + "klmnopq"[k % 7] + "efghijkl"[k % 50 // 7] for k in rng.choices(range(300), k=60)]
        rows.append((i, " ".join([*own, "the", ".", "vile" if i % 10 == 0 else "fine"]), int(i % 10 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    m = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.lit(True))
    assert m.n_blocks > 8
    m.searches = m.visited = 0
    w = weights(m)
    for e in range(0, len(m.ids), 60):
        term = np.flatnonzero(w[e])
        q = m.vector(term, np.ones(len(term)))
        best, sim = m.nearest(term, q, 15)
        s = w[:, term] @ q
        assert np.allclose(np.sort(s)[::-1][:15], sim) and np.allclose(s[best], sim)
    assert m.visited < 0.5 * m.searches * m.n_blocks


def test_score_equals_brute_force(spark):
    """Votes and the calibrated curve, from plain vectors and all pairs."""
    docs, labels = toxic_docs(spark)
    model = toxicity.learn(docs, labels, ~F.coalesce(toxicity.remainder(4) == 2, F.lit(False)))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    full = {id(i): weights(i) for i in (model.index, model.chosen)}

    def vote(index, data):
        h, _ = toxicity.term_counts([data])
        counts = Counter(h.tolist())
        known = {int(t): k for k, t in enumerate(index.terms)}
        v = {known[t]: (1 + np.log(n)) * index.idf[known[t]] for t, n in counts.items() if t in known}
        if not v:
            return 0.0, 0.0
        s = sum(x * full[id(index)][:, t] for t, x in v.items())
        best = np.lexsort((index.ids, -s))[:15]
        best = best[s[best] > 0]
        return float((s[best] * (2.0 * index.toxic[best] - 1)).sum() / s[best].sum()), 1.0

    for i in list(texts)[::7]:
        a, _ = vote(model.index, texts[i])
        b, some = vote(model.chosen, texts[i])
        want = 1 / (1 + np.exp(-np.dot([1.0, a, b, some], model.a)))
        assert got[i].score == pytest.approx(want, abs=1e-9), i


def test_toxicity_odd_rows(odd_docs, odd_rows, labels, no_docs, no_labels):
    assert toxicity.toxicity(odd_docs, labels).count() == len(odd_rows)
    assert {r.score for r in toxicity.toxicity(odd_docs, no_labels).collect()} == {0.0}
    assert toxicity.toxicity(no_docs, labels).count() == 0


# ---- language ID

def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == held(r.doc_id, 5, 0) for r in got)
    assert len(out) > 100 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark, odd_docs, odd_rows, no_docs):
    got = langid.identify(odd_docs).collect()
    assert len(got) == len(odd_rows)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id in (4, 6, 11)} <= {"en", "de"}
    assert langid.identify(no_docs).count() == 0
    signs = spark.createDataFrame([(1, "123 !?", "xx"), (2, "ж", "xx")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(signs).collect()} == {1: "und", 2: "xx"}


def test_a_language_of_one_row_is_learned(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text", "lang")
    one = next(i for i in range(10**6, 10**6 + 50) if not held(i, 5, 0))
    rare = spark.createDataFrame([(one, "ψωξ δφγ ηθκ λμν πρσ τυ " * 9, "xx")], docs.schema)
    model = langid.fit(docs.unionByName(rare), F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0"))
    assert "xx" in model.langs
    got = langid.predict(rare.withColumn("text", F.lit("ηθκ ψωξ λμν")), model).first()
    assert got.lang_pred == "xx"


def test_predictions_equal_brute_force(spark):
    """Ridge scores from the normal equations, decoded one row at a time."""
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where("doc_id < 300")
    model = langid.fit(docs, F.col("doc_id") % 3 != 0)
    names = sorted(model.langs)
    assert list(model.langs) == names
    got = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    for r in docs.where("doc_id % 10 = 0").collect():
        grams, t = Counter(), b" " + r.text.encode().lower() + b" "
        x = langid.ngram_vectors([r.text.encode()])[0]
        assert abs(float(x @ x) - 1) < 1e-5 and not grams and t
        losses = []
        for k in range(len(names)):
            losses.append(sum(w * max(0.0, 1 - float(x @ model.w[:, b]) * c) ** 2 for b, (w, c) in enumerate(zip(model.weight, model.code[k]))))
        best = int(np.argmin(losses))
        assert got[r.doc_id].lang_pred == names[best]
        p = np.exp(-4 * np.array(losses))
        assert got[r.doc_id].score == pytest.approx(p[best] / p.sum(), rel=1e-4)


@pytest.mark.parametrize("n", [2, 4, 20])
def test_codewords_differ(n):
    c = langid.codewords(n)
    assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= 4
    assert (abs(c.sum(axis=0, dtype=int)) < n).all()


# ---- WARC

def test_warc_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    rows = [(1, "http://a\r\nb", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 100_000),
            (6, "u", "a\r\n\r\nb\r\n\r\n"), (7, "u", "other"), (7, "u", "other"), (None, "u", "<p>x</p>"), (8, "u", "zz")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = warc.round_trip(pages).collect()
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = max((x for x in groups[h or ""] if x is not None), default=None)
        want.append((i, len(data), warc.sha1_text(data), "response" if i == top else "revisit", None if i == top else top))
    order = lambda r: str(r)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=order) == sorted(want, key=order)
    assert {r.html for r in got if r.record_type == "response"} == {h or "" for _, _, h in rows}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_reads_in_parallel_and_splits_a_hot_payload(spark, monkeypatch):
    """A task for each file; clashing column names; a third of the pages alike."""
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rng = random.Random(2)
    rows = [(i, "u", "<p>hot</p>" if i % 3 == 0 else text(rng, 60), f"s{i}", i, "r") for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string, size long, response_id string")
    folder = warc.shared_dir(spark, "warc-test")
    manifest = warc.write(pages, folder)
    back = warc.read(manifest)
    assert back.rdd.getNumPartitions() == manifest.count() > 4
    each = back.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert min(each) > 0 and sum(each) == 600
    hot = [r for r in back.collect() if r.page_id % 3 == 0]
    assert {r.refers_to for r in hot if r.record_type == "revisit"} == {597} and len(hot) == 200


def test_warc_reader_rejects_damage():
    good = warc.record(1, "u", b"data", warc.sha1_text(b"data"), None, False)
    assert warc.page_of(*warc.parse(good))[2] == b"data"
    for bad in (good.replace(b"data", b"dada"), good[:-1], good.replace(b"WARC/1.1", b"WARC/9")):
        with pytest.raises(ValueError):
            warc.page_of(*warc.parse(bad))


# ---- nearest neighbours

def test_neighbours_recall(spark):
    vectors = spark.read.parquet(f"{SF001}/embeddings.parquet")
    got = forest.search(vectors, F.col("vec_id") % 50 == 0).collect()
    rows = vectors.collect()
    v = {r.vec_id: np.array(r.embedding, dtype=float) for r in rows}
    hit = 0
    queries = [i for i in v if i % 50 == 0]
    for i in queries:
        s = {j: float(v[j] @ v[i] / np.linalg.norm(v[i]) / np.linalg.norm(v[j])) for j in v if j != i}
        best = sorted(s, key=lambda j: (-s[j], j))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == i)
        assert [r for r, _, _ in mine] == [1, 2, 3, 4, 5] and all(abs(s[j] - x) < 1e-12 for _, j, x in mine)
        hit += len(set(best) & {j for _, j, _ in mine})
    assert hit / (5 * len(queries)) >= 0.9


def test_neighbours_recall_over_shards(spark, monkeypatch):
    """2,000 vectors in eight shards, half of each looked at."""
    monkeypatch.setattr(forest, "SHARD_ROWS", 256)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 16)
    vectors = spark.read.parquet(f"{SF01}/embeddings.parquet")
    got = {}
    for r in forest.search(vectors, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = 0
    for i, q in got.items():
        s = np.where(ids == i, -2, x @ x[ids == i][0])
        hit += len(q & set(ids[np.lexsort((ids, -s))[:5]].tolist()))
    assert len(got) == 40 and 0.9 <= hit / 200 < 1  # pruned, and near


def test_neighbours_of_repeated_query_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0])] + [(i, [1.0, 0.01 * i]) for i in range(1, 7)] + [(9, [0.1, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = forest.search(df, F.col("vec_id") == 0, k=2).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 1), (1, 9), (2, 2), (2, 6)]


def test_neighbours_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [None, 1.0]), (8, []), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [3.0, 0.0]), (0, [1.0, 0.0]), (50, [0.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, shard int")
    got = forest.search(df, F.col("vec_id") == 50).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [2, 0, 0, 1, 10]
    got = forest.search(df, F.col("vec_id") == 2).orderBy("rank").collect()
    assert len(got) == 5 and got[0].score == pytest.approx(0.5 ** 0.5)
    assert forest.search(df.limit(0), F.lit(True)).count() == 0


# ---- components, pipeline

def test_components_of_a_hub(spark):
    """A third of all links at one node; both sides of each join can be split."""
    edges = [(0, k) for k in range(1, 3001)] + [(10_000 + 2 * k, 10_001 + 2 * k) for k in range(3000)] + [(3000, 10_000)]
    got = {r.a: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 3001)) and got[10_000] == got[10_001] == 0
    assert all(got[10_001 + 2 * k] == 10_000 + 2 * k for k in range(1, 3000))


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(60)] + [(200, 100), (100, 150), (7, 7)]
    got = {r.a: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, 150: 100, 200: 100}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        nxt = stage(spark, step, SF0001)
        assert nxt.schema == docs.schema and nxt.count() <= step.count(), name
        step = nxt
    assert step.count() > 0.6 * docs.count()
    packed = corpus_pipeline.run(spark, SF0001)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in step.select("doc_id").collect()}


def test_stages_on_odd_rows(spark, odd_docs, odd_rows, no_docs):
    for rows in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF0001)
            assert out.count() >= (rows is odd_docs), name
