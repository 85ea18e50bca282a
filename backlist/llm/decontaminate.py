"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

A document is contaminated where at least ``SHARE`` of ``WINDOW`` consecutive
places of an item agree with its words (of the whole item, if it is shorter).
A mask picks some of a few consecutive words and ignores the others.  Seeds are
taken at every word of items and documents; the masks are lossless: wherever as
many words are substituted as the share allows (two of 13), one of them fits
beside these, so every overlap that the rule accepts shares a seed.  Shorter
items have masks of their own, which documents are read with only if the
benchmark has such items.  Items' and documents' seeds are joined; around each hit, item and document words are
compared place by place.

Only the benchmark's seeds are broadcast, and only after they were counted
(``BROADCAST_SEEDS``); a larger benchmark is joined by shuffle with the same
result.

Hits are gathered by the row, told by two hashes of id and text: rows without
id, or of one id, share none.

Defined cases: words are runs without ASCII white space, in lower case; null
texts have none; very long texts are searched whole; items of any length are
searched (up to four words as they stand), those without words are not; items
of equal words count as one and report their smallest id; of equal overlaps
with an item the first is reported; repeated rows and rows without doc_id are
judged row by row; without documents or items there are no overlaps; columns
of any other name pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backlist.llm.common import materialize

SPAN = 8  # of the mask for items of WINDOW words and more
STRIDE = 1
# By least(WINDOW, words of the item): masks of which one fits beside any
# substitutions that the share allows.
MASKS = {13: ("11010011",), 12: ("11101",), 11: ("11101",), 10: ("11101", "1111"), 9: ("1111",), 8: ("1111",),
         7: ("111",), 6: ("111",), 5: ("11",), 4: ("1111",), 3: ("111",), 2: ("11",), 1: ("1",)}
WINDOW = 13
SHARE = 0.8
BROADCAST_SEEDS = 1_000_000


def words(text: Column) -> Column:
    """Lower-case words of a text; an empty array if there are none."""
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+"))


def seeds(hashes: Column, masks: dict[str, Column]) -> Column:
    """``array<struct<pos, seed>>``: the seed at every place, of every mask
    whose condition holds."""
    none = F.array().cast("array<struct<pos:int,seed:bigint>>")

    def of(mask, condition):
        last = F.size(hashes) - len(mask)
        places = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(STRIDE))
        each = F.transform(places, lambda i: F.struct(i.alias("pos"), F.xxhash64(
            F.lit(mask), *[F.get(hashes, i + k) for k in range(len(mask)) if mask[k] == "1"]).alias("seed")))
        return F.when(condition & (last >= 0), each).otherwise(none)

    return F.concat(*[of(*m) for m in masks.items()]) if len(masks) > 1 else of(*[*masks.items()][0])


def _seed_rows(df: DataFrame, keys: list[str], masks: dict[str, Column]) -> DataFrame:
    """``keys, pos, seed``: one row per place and mask; df has ``words``."""
    hashed = df.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    # in the generator itself: a filter on an array column of its own would be
    # pushed below and hash all words again at every place
    one = hashed.select(*keys, F.explode(seeds(F.col("h"), masks)).alias("s"))
    return one.select(*keys, "s.pos", "s.seed")


def items_of(benchmark: DataFrame) -> DataFrame:
    """``(item_id, words)``: one row per distinct item that has words."""
    each = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words"))
    return each.where(F.size("words") > 0).groupBy("words").agg(F.min("item_id").alias("item_id"))


def _item_seeds(items: DataFrame) -> tuple[DataFrame, list[str]]:
    """``(item_id, item_pos, seed)`` and the masks in use."""
    size = F.least(F.size("words"), F.lit(WINDOW))
    sizes = {r[0] for r in items.select(size).distinct().collect()} or {WINDOW}
    masks = sorted({m for n in sizes for m in MASKS[n]})
    of_size = F.least(F.size("h"), F.lit(WINDOW))
    out = _seed_rows(items, ["item_id"], {m: of_size.isin([n for n in MASKS if m in MASKS[n]]) for m in masks})
    return out.withColumnRenamed("pos", "item_pos"), masks


def _agreement(doc: Column, item: Column, shift: Column) -> Column:
    """1 where the item's k-th word is the document's word at ``shift + k``."""
    def same(k):
        place = shift + k
        return F.when((place >= 0) & (F.get(doc, place) == F.get(item, k)), 1).otherwise(0)

    return F.transform(F.sequence(F.lit(0), F.size(item) - 1), same)


def _verified(doc: Column, candidates: Column) -> Column:
    """The candidates whose words agree in some window, with the counts."""
    def check(c):
        return F.struct(c["item_id"].alias("item_id"), c["shift"].alias("start"), F.size(c["words"]).alias("item_words"),
                        _agreement(doc, c["words"], c["shift"]).alias("same"))

    def enough(c):
        size = F.least(F.lit(WINDOW), c["item_words"])
        need = F.ceil(size * SHARE)
        return F.exists(F.sequence(F.lit(1), c["item_words"] - size + 1),
                        lambda k: F.aggregate(F.slice(c["same"], k, size), F.lit(0), lambda a, x: a + x) >= need)

    return F.filter(F.transform(candidates, check), enough)


def judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(row, hits)``: every row of ``docs`` as a struct with the verified
    overlaps, ``array<struct<item_id, start, item_words, matched>>``."""
    spark = docs.sparkSession
    items = items_of(benchmark)
    item_seeds, masks = _item_seeds(items)
    n = item_seeds.count()
    item_seeds = item_seeds.distinct()
    if n <= BROADCAST_SEEDS:
        item_seeds = F.broadcast(item_seeds)
    identity = [F.xxhash64("doc_id", "text").alias("u1"), F.xxhash64(F.lit(1), "text", "doc_id").alias("u2")]
    texts = docs.select(*identity, words(F.col("text")).alias("words"))
    hits = (_seed_rows(texts, ["u1", "u2"], {m: F.lit(True) for m in masks}).join(item_seeds, "seed")
            .select("u1", "u2", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct())
    # a list has one text's hits; written, so that both sides of the join come
    # straight from a shuffle and the rows of one text can be split
    found = materialize(hits.join(items, "item_id").groupBy("u1", "u2")
                        .agg(F.collect_list(F.struct("item_id", "shift", "words")).alias("candidates")), "seed-hits")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *identity)
    joined = rows.join(found.hint("merge"), ["u1", "u2"], "left")  # by the same plan at every size
    some = _verified(F.col("words"), F.col("candidates"))
    hit = F.transform(some, lambda c: F.struct(c["item_id"].alias("item_id"), c["start"].alias("start"),
                                               c["item_words"].alias("item_words"),
                                               F.aggregate(c["same"], F.lit(0), lambda a, x: a + x).alias("matched")))
    empty = F.array().cast("array<struct<item_id:bigint,start:int,item_words:int,matched:int>>")
    return (joined.withColumn("words", F.when(F.col("candidates").isNotNull(), words(F.col("row.text"))))
            .select("row", F.when(F.col("candidates").isNotNull(), hit).otherwise(empty).alias("hits")))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, start, item_words, matched)``: the best overlap of
    each contaminated document with each item; start is the place of the
    item's first word among the document's words (negative: before it)."""
    hits = judged(docs, benchmark).where(F.size("hits") > 0)
    each = hits.select(F.col("row.doc_id").cast("long").alias("doc_id"), F.explode("hits").alias("h"))
    best = F.max(F.struct(F.col("h.matched"), -F.col("h.start"), F.col("h.item_words")))
    return (each.groupBy("doc_id", F.col("h.item_id").alias("item_id")).agg(best.alias("b"))
            .select("doc_id", "item_id", (-F.col("b.col2")).alias("start"), F.col("b.item_words").alias("item_words"),
                    F.col("b.matched").alias("matched")))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without an overlap, with all their columns."""
    return judged(docs, benchmark).where(F.size("hits") == 0).select("row.*")
