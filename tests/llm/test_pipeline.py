"""The pipeline's rows against a brute-force version of every stage."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from backlist.llm import quality, registry
from tests.llm.conftest import text
from tests.llm.test_texts import brute_fingerprint, brute_leaks, kept

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    """Documents with copies, near copies, shared and benchmark passages, odd
    texts; labels; a benchmark."""
    rng = random.Random(21)
    items = [(k, text(rng, n)) for k, n in enumerate((13, 18, 30))]
    shared, docs = [text(rng, 50) for _ in range(3)], []
    for i in range(140):
        t = text(rng, rng.randint(50, 140))
        if i % 9 == 4:
            t = f"{t} {rng.choice(shared)} {text(rng, 8)}"
        if i % 20 == 7:
            t = f"{text(rng, 12)} {rng.choice(items)[1]} {t}"
        if i % 17 == 16:
            w = docs[i - 3][1].split()
            w[rng.randrange(len(w))] = "other"
            t = " ".join(w)
        docs.append((i, docs[i - 5][1] if i % 25 == 24 else t))
    docs += [(500, None), (501, ""), (502, "one"), (503, text(rng, 9000)), (None, text(rng, 80)), (504, docs[3][1].upper())]
    rows = [(i, t, "en", "web", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def first_of_groups(docs):
    fps = [brute_fingerprint(t) for _, t in docs]
    root = list(range(len(fps)))
    for _ in range(len(fps)):
        before = list(root)
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    first = {}
    for k, r in enumerate(root):
        i = docs[k][0]
        if r not in first or (i is None, i) < (docs[first[r]][0] is None, docs[first[r]][0]):
            first[r] = k
    return [docs[k] for k in sorted(first.values())]


def test_pipeline_equals_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = tables(spark, folder)
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    # the weights have a brute-force test of their own
    scores = quality.resample(read("documents"), read("labels")).where("selected").collect()
    good = {r.doc_id for r in scores}
    left = [d for d in docs if d[0] in good]
    assert 0 < len(left) < len(docs)
    after = {"quality classifier": list(left)}
    left = first_of_groups(left)
    after["simhash near-dedup"] = list(left)
    left = [(i, t if not g else b" ".join(k).decode()) for (i, t), (_, g, k) in zip(left, kept([t for _, t in left]))]
    after["substring dedup"] = list(left)
    leaks = {i for i, _ in brute_leaks(left, items)}
    left = [d for d in left if d[0] not in leaks]
    after["benchmark decontamination"] = list(left)
    step, order = read("documents"), (lambda r: (r[0] is None, r))
    sizes = [len(docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, folder)
        got = step.collect()
        assert sorted([(r.doc_id, r.text) for r in got], key=order) == sorted(after[name], key=order), name
        assert all(r.n_chars == len(r.text or "") and (r.lang, r.source) == ("en", "web") for r in got), name
        sizes.append(len(got))
    assert sizes[1] < sizes[0] and sizes[2] < sizes[1] and sizes[3] == sizes[2] and sizes[4] < sizes[3]
    assert after["substring dedup"] != after["simhash near-dedup"]
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(registry.PACK["path"])
    want = []
    for i, t in left:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want += [(i, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    packed = corpus_pipeline.run(spark, folder)
    assert sorted([tuple(r)[:5] for r in packed.collect()], key=order) == sorted(want, key=order)
    ends = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert ends.where("n <> end or n > 4096").count() == 0
