"""Packing, substring dedup, SimHash, decontamination and token counts against
brute force on odd documents."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash

from backlist.llm import decontaminate, fm_index, packing, simhash, substring, wordpiece
from tests.llm.conftest import text

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("byte_bpe_50k.json")


def key(row):
    return tuple((x is None, x) for x in row)


# ---- packing

def test_packing_round_trip(odd_docs, odd_rows):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(PATH)
    got = packing.pack(odd_docs, PATH).collect()
    want = []
    for i, t in odd_rows:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want += [(i, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes()), len(ids)) for s in range(0, len(ids), 4096)]
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        assert sum(n for _, n in parts) <= 4096


def test_packing_no_rows(no_docs):
    assert packing.pack(no_docs, PATH).count() == 0


def test_histogram_packing_places_every_piece_once():
    rng = random.Random(1)
    for _ in range(50):
        counts = {n: rng.randint(1, 40) for n in rng.sample(range(1, 101), rng.randint(1, 60))}
        patterns = packing.pack_histogram(dict(counts), 100)
        used = Counter()
        for packs, parts in patterns:
            assert sum(n * c for n, c in parts) <= 100
            for n, c in parts:
                used[n] += packs * c
        assert used == counts


# ---- substring dedup

def kept(texts):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k:k + 35]) for w in words for k in range(len(w) - 34))
    out = []
    for w in words:
        gone = set()
        for k in range(len(w) - 34):
            if seen[tuple(w[k:k + 35])] > 1:
                gone.update(range(k, k + 35))
        out.append((len(w), len(gone), [x for k, x in enumerate(w) if k not in gone]))
    return out


def test_substring_dedup(odd_docs, odd_rows):
    got = sorted([tuple(r) for r in substring.repeated(odd_docs).collect()], key=key)
    want = [(i, n, g, hashlib.sha256(b" ".join(k)).hexdigest())
            for (i, _), (n, g, k) in zip(odd_rows, kept([t for _, t in odd_rows]))]
    assert got == sorted(want, key=key)


def test_substring_dedup_as_a_filter(odd_docs, odd_rows):
    out = substring.without_repeats(odd_docs)
    assert out.schema == odd_docs.schema
    want = [(i, t if not g else b" ".join(k).decode()) for (i, t), (_, g, k) in zip(odd_rows, kept([t for _, t in odd_rows]))]
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=key) == sorted(want, key=key)


def test_substring_dedup_hot_line(spark):
    """A frequent line between different neighbours, and its copies in a row."""
    rng = random.Random(9)
    line = text(rng, 40)
    rows = [(k, f"{text(rng, 30)} {line} {text(rng, 30)}") for k in range(150)] + [(900, f"{line} {line} {line}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(substring.frequent_grams(docs))
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.repeated(docs).collect()}
    assert got == {i: (n, g) for (i, _), (n, g, _) in zip(rows, kept([t for _, t in rows]))}


def test_substring_dedup_no_rows(no_docs):
    assert substring.repeated(no_docs).count() == 0
    assert substring.without_repeats(no_docs).schema == no_docs.schema


def test_fm_index_matching_statistics():
    rng = np.random.default_rng(2)
    seqs = [rng.integers(1, 4, rng.integers(1, 40)) for _ in range(30)]
    weight = rng.integers(1, 3, 30)
    words = np.concatenate([np.append(s, 0) for s in seqs])
    index = fm_index.FMIndex(words, np.repeat(weight, [len(s) + 1 for s in seqs]))
    begin = np.cumsum([0] + [len(s) + 1 for s in seqs])[:-1]

    def times(p):
        return sum(int(w) for s, w in zip(seqs, weight) for k in range(len(s) - len(p) + 1) if (s[k:k + len(p)] == p).all())

    for s, b in zip(seqs, begin):
        got = index.matching_statistics(b + np.arange(len(s)), np.arange(len(s)) + 1)
        for e in range(len(s)):
            want = max((n for n in range(e + 2) if n == 0 or times(s[e + 1 - n:e + 1]) >= 2), default=0)
            assert got[e] == want


# ---- SimHash

def brute_fingerprint(t, shingle=3):
    words = (t or "").encode().lower().split()
    grams = [b" ".join(words[k:k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(odd_docs, odd_rows):
    got = sorted([(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()], key=key)
    fps = [brute_fingerprint(t) for _, t in odd_rows]
    root = list(range(len(fps)))
    for _ in fps:  # settle
        for a in range(len(fps)):
            for b in range(len(fps)):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    root[a] = root[b] = min(root[a], root[b])
    ids = {}
    for (i, _), r in zip(odd_rows, root):
        ids.setdefault(r, []).append(i)
    want = [(i, f"{f:016x}", min((x for x in ids[r] if x is not None), default=None)) for (i, _), f, r in zip(odd_rows, fps, root)]
    assert got == sorted(want, key=key)


@pytest.mark.parametrize("cell", [2048, 16])
def test_simhash_links_in_split_cells(spark, cell, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell)
    rng = random.Random(4)
    center = rng.getrandbits(64)
    fps = {center ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)}
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps | {rng.getrandbits(64) for _ in range(100)})
    pairs = [(a, b) for k, a in enumerate(fps) for b in fps[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = [(r.a, r.b) for r in simhash.links(df, 3).collect()]

    def groups(edges):
        root = {x: x for x in fps}
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in edges:
            root[find(a)] = find(b)
        return {frozenset(y for y in fps if find(y) == find(x)) for x in fps}

    assert groups(got) == groups(pairs)


def test_simhash_keeps_one_of_each_group(odd_docs, odd_rows, no_docs):
    out = simhash.keep_first(odd_docs)
    assert out.schema == odd_docs.schema
    got = [r.doc_id for r in out.collect()]
    # id 6 stands for two different texts, each the first of its group
    groups = {r.component_id for r in simhash.near_duplicates(odd_docs).where("component_id is not null").collect()}
    assert set(got) - {None} == groups and len([i for i in got if i is not None]) == len(groups) + 1
    assert simhash.keep_first(no_docs).count() == simhash.near_duplicates(no_docs).count() == 0


# ---- decontamination

def brute_leaks(docs, items):
    out = set()
    for i, t in docs:
        w = (t or "").lower().split()
        for item, it in items:
            b = (it or "").lower().split()
            n = min(13, len(b))
            if not b:
                continue
            for s in range(-len(b) + 1, len(w)):
                m = [0 <= s + k < len(w) and w[s + k] == x for k, x in enumerate(b)]
                if any(sum(m[k:k + n]) >= -(-n * 8 // 10) for k in range(len(b) - n + 1)):
                    out.add((i, item))
                    break
    return out


def test_decontamination(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(7)
    items = [(k, text(rng, n)) for k, n in enumerate((13, 15, 20, 40, 60, 12))] + [(6, None), (7, "")]
    items.append((8, items[3][1]))  # the same words again: reported as item 3
    planted = []
    for k, (item, t) in enumerate(items[:5]):
        words = t.split()
        planted.append((1000 + k, f"{text(rng, k)} {t.upper()} {text(rng, 30)}"))
        for at in range(6, len(words), 9):
            words[at] = "zzz"
        planted.append((2000 + k, f"{text(rng, 11 + k)} {' '.join(words)}\n{text(rng, 5)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, t, None, None, 0, "w", 1, None) for i, t in planted]
    docs = odd_docs.union(spark.createDataFrame(rows, odd_docs.schema))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    want = {(i, item) for i, item in brute_leaks(odd_rows + planted, items) if item != 8}
    assert got == want and {i for i, _ in got} == {i for i, _ in planted}
    clean = decontaminate.keep_clean(docs, bench)
    assert clean.schema == docs.schema
    assert sorted([(r.doc_id, r.text) for r in clean.collect()], key=key) == sorted(odd_rows, key=key)
    assert decontaminate.contaminated(no_docs, bench).count() == 0
    assert decontaminate.keep_clean(odd_docs, bench.limit(0)).count() == len(odd_rows)


def test_decontamination_finds_every_substitution(spark):
    """All overlaps of 13 words and more that the rule accepts, at any place."""
    rng = random.Random(11)
    items = [(k, text(rng, n)) for k, n in enumerate((13, 13, 15, 20, 26))]
    docs = []
    for k in range(400):
        words = rng.choice(items)[1].split()
        for at in rng.sample(range(len(words)), rng.randint(1, len(words) // 5)):
            words[at] = "zzz"
        docs.append((k, f"{text(rng, rng.randint(0, 9))} {' '.join(words)} {text(rng, rng.randint(0, 9))}"))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"))
    want = brute_leaks(docs, items)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) > 200


def test_rows_without_id_share_no_hits(spark):
    """A third of the rows under null id: each has its own text's hits alone."""
    rng = random.Random(12)
    items = [(k, text(rng, 20)) for k in range(30)]
    docs = [(None if k % 3 == 0 else k, f"{text(rng, 5)} {items[k % 40][1] if k % 40 < 30 else text(rng, 20)}", "x", "y") for k in range(240)]
    docs += [(None, docs[0][1], "x", "y")] * 60
    df = spark.createDataFrame(docs, "doc_id long, text string, u1 string, candidates string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    judged = decontaminate.judged(df, bench).collect()
    assert len(judged) == 300 and max(len(r.hits) for r in judged) == 1
    clean = decontaminate.keep_clean(df, bench)
    assert clean.columns == df.columns
    assert sorted(r.text for r in clean.collect()) == sorted(t for k, (_, t, _, _) in enumerate(docs) if k < 240 and k % 40 >= 30)


def test_repeated_hot_rows_go_once_to_a_shard(spark, monkeypatch):
    """4,000 equal rows without id: the searched groups hold distinct segments."""
    rng = random.Random(13)
    hot, sizes = text(rng, 120), []
    real = substring.mark_shard

    def seen(texts, windows, weight):
        assert len(set(texts)) == len(texts)
        return real(texts, windows, weight)

    monkeypatch.setattr(substring, "mark_shard", seen)
    rows = [(None, hot)] * 4000 + [(k, text(rng, 50)) for k in range(40)] + [(99, hot[:len(hot) // 2])]
    got = substring.repeated(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sum(r.n_removed == 120 for r in got) == 4000 and not sizes
    assert all(r.n_removed == 0 for r in got if r.doc_id is not None and r.doc_id < 40)


def test_decontamination_masks_fit_beside_all_substitutions():
    for n, masks in decontaminate.MASKS.items():
        for gone in combinations(range(n), n - -(-n * 8 // 10)):
            assert any(all(at + k not in gone for k, c in enumerate(m) if c == "1")
                       for m in masks for at in range(n - len(m) + 1)), (n, gone)


def test_decontamination_of_short_items(spark):
    rng = random.Random(12)
    items = [(n, " ".join(f"q{n}w{k}" for k in range(n))) for n in range(1, 14)]
    docs = []
    for n, t in items:
        for k in range(8):
            words = t.split()
            for at in rng.sample(range(n), min(n, k % 4)):
                words[at] = "zzz"
            docs.append((100 * n + k, f"{text(rng, k)} {' '.join(words)} {text(rng, 6)}"))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                     spark.createDataFrame(items, "item_id long, text string"))
    want = {(i, i // 100) for i, _ in docs if i % 4 <= i // 100 - -(-(i // 100) * 8 // 10)}
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_decontamination_without_broadcast(spark, odd_docs, monkeypatch):
    bench = spark.createDataFrame([(1, text(random.Random(3), 40))], "item_id long, text string")
    want = decontaminate.contaminated(odd_docs, bench).collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert want and sorted(decontaminate.contaminated(odd_docs, bench).collect(), key=key) == sorted(want, key=key)


def test_decontamination_runs_no_python(odd_docs, spark):
    bench = spark.createDataFrame([(1, text(random.Random(3), 40))], "item_id long, text string")
    plan = decontaminate.contaminated(odd_docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# ---- token counts

def test_word_piece_counts(odd_docs, odd_rows, no_docs):
    initial, continuing = map(set, wordpiece.vocabulary(PIECES))
    longest = max(map(len, initial | continuing))

    def pieces(word):
        n, at, vocabulary = 0, 0, initial
        while at < len(word):
            end = next((e for e in range(min(len(word), at + longest), at, -1) if word[at:e] in vocabulary), None)
            if end is None:
                return None
            n, at, vocabulary = n + 1, end, continuing
        return n

    want = []
    for i, t in odd_rows:
        each = [pieces(w) for w in (t or "").encode().split()]
        want.append((i, len(each), sum(n or 1 for n in each), sum(n is None for n in each)))
    assert sorted([tuple(r) for r in wordpiece.token_counts(odd_docs, PIECES).collect()], key=key) == sorted(want, key=key)
    assert wordpiece.token_counts(no_docs, PIECES).count() == 0


def test_automaton_with_gaps_in_the_vocabulary():
    rng = random.Random(8)
    for _ in range(200):
        initial = {bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 6))}
        continuing = {bytes(rng.choices(b"abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 6))}
        automaton = wordpiece.Automaton(sorted(initial), sorted(continuing))
        for _ in range(30):
            word = bytes(rng.choices(b"abcd", k=rng.randint(1, 9)))
            n, at, vocabulary = 0, 0, initial
            while at < len(word):
                end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
                if end is None:
                    n = 0
                    break
                n, at, vocabulary = n + 1, end, continuing
            assert automaton.count(word) == n
