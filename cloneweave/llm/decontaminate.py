"""Benchmark decontamination with SimHash windows, in DataFrame expressions only.

Words are runs of letters and digits, lower-cased; shingles have five words
(an item of fewer words is one shingle).  A document holds an item if one of
its windows, of as many words as the item, has a weighted Jaccard similarity
of at least ``least`` with it: the sum of the smaller over that of the larger
of each shingle's weights, a weight being how often the shingle stands there.
A document shorter than the item is one window.

1. Hits: of each document, every ``stride``-th shingle is looked up among the
   items' shingles.  The stride is so small that a window of the required
   similarity has a hit whatever the document: it misses too few shingles.
   Only positions and hashes take part, no text.
2. Hits of an item that a window could hold together are a run.  The texts of
   documents with runs are read again, and a run keeps its shingles' hashes:
   of as many as the run is long and two windows, whatever its number of hits.
3. Every window of a run gets a 64-bit SimHash of its weighted shingles.
4. Multi-index Hamming blocks: fingerprints are cut into radius + 1 blocks;
   two within the radius agree in a block, so equal blocks of windows and of
   the item of their run give all pairs within it.  A window meets no item of
   which it holds no shingle.
5. The exact weighted similarity of these pairs decides.

At a similarity of 0.8 exactly, 2 in a million windows or fewer are past the
radius of 24 bits (items of 27 shingles and more, all shingles different; at
20 bits it was 1 to 3 in 10,000); ``radius=64`` lets none pass unseen.

Defined results: null and blank texts hold nothing; items without words are
ignored; equal items under several ids are each reported; rows that repeat an
id give one row for each item; an empty table gives no rows; of equally
similar windows the first counts; extra columns aren't read; texts and items
may have any length.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloneweave.llm.common import staged


@dataclass(frozen=True)
class LeakParams:
    k: int = 5
    least: float = 0.8
    radius: int = 24  # of 64; a similarity of 0.8 is at 9.7 on average, with a deviation of 2.9
    broadcast_rows: int = 1 << 20  # of item shingles, or of runs, at most; beyond it the joins are shuffled


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def hashed(tokens: Column, at: Column, k: int) -> Column:
    """Hash of the k words from position ``at`` (0-based)."""
    return F.xxhash64(*[F.get(tokens, at + j) for j in range(k)])


def grams_of(tokens: Column, first: Column, last: Column, k: int) -> Column:
    """Hashes of the k-word shingles from positions first to last."""
    return F.transform(F.sequence(first, last), lambda i: hashed(tokens, i, k))


def shared_weight(a: Column, b: Column) -> Column:
    """Sum of the smaller weights of the shingles that both have; where one side repeats none, their number."""
    both = F.array_intersect(a, b)
    times = lambda s, h: F.size(F.filter(s, lambda x: x == h))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(plain, F.size(both)).otherwise(F.aggregate(both, F.lit(0), lambda n, h: n + F.least(times(a, h), times(b, h))))


def stride(m: int, least: float) -> int:
    """How many shingles may be stepped over so that a window similar to an item of m shingles has a hit."""
    steps = [m]
    for w in range(max(1, ceil(least * m - 1e-9)), m + 1):
        overlap = ceil(least * (m + w) / (1 + least) - 1e-9)
        steps.append(w // (w - overlap + 1) if overlap <= w else m)
    return max(1, min(steps))


def fingerprint(rows: DataFrame, keys: list[str], h: str) -> DataFrame:
    """SimHash of the hashes of each group: bit q is set where most hashes have it (repeats count).

    Two bits are counted in one sum, in the halves of a long.
    """
    pair = F.lit(0x0000000100000001)
    sums = [F.sum(F.shiftrightunsigned(F.col(h), q).bitwiseAND(pair)).alias(f"_{q}") for q in range(32)]
    got = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"), *sums)
    fp = F.lit(0).cast("long")
    for q in range(32):
        low, high = F.col(f"_{q}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"_{q}"), 32)
        fp = fp.bitwiseOR(F.shiftleft((2 * low > F.col("_m")).cast("long"), q)).bitwiseOR(F.shiftleft((2 * high > F.col("_m")).cast("long"), q + 32))
    return got.select(*keys, fp.alias("fp"))


def blocked(rows: DataFrame, radius: int) -> DataFrame:
    """A row for each of the radius + 1 blocks of the fingerprint."""
    n = radius + 1
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [F.struct(F.lit(i).alias("i"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("v")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    return rows.withColumn("_b", F.explode(F.array(*blocks))).withColumns({"i": F.col("_b.i"), "v": F.col("_b.v")}).drop("_b")


def _hits(documents: DataFrame, known: DataFrame, k: int, step: int, small: bool) -> DataFrame:
    """Hits of k-word shingles: where (p) which item's shingle stands, in a document of s shingles."""
    docs = documents.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w")).withColumn("s", F.size("w") - k + 1).filter("s > 0")
    spots = F.transform(F.sequence(F.lit(0), F.floor((F.col("s") - 1) / step).cast("int")), lambda i: F.struct((i * step).alias("p"), hashed(F.col("w"), i * step, k).alias("h")))
    found = docs.select("doc_id", "th", "s", F.explode(spots).alias("x")).select("doc_id", "th", "s", F.col("x.p").alias("p"), F.col("x.h").alias("h"))
    return found.join(F.broadcast(known) if small else known, "h").select(*ITEM, "m", "k", "s", "p")


ITEM = ["doc_id", "th", "item_id", "ih"]  # a document's text and an item
RUN = [*ITEM, "low"]


def _same(a: str, b: str, columns: list[str]) -> Column:
    """Equality of the columns of two aliased tables, null with null."""
    found = F.lit(True)
    for c in columns:
        found = found & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return found


def _runs(hits: DataFrame) -> DataFrame:
    """low, high: the first and the last window of hits less than a window apart."""
    order = Window.partitionBy(*ITEM).orderBy("p")
    cut = F.col("p") - F.lag("p").over(order) > F.col("m")
    rows = hits.withColumn("_cut", F.coalesce(cut, F.lit(False)).cast("int")).withColumn("_run", F.sum("_cut").over(order))
    runs = rows.groupBy(*ITEM, "m", "k", "s", "_run").agg(F.min("p").alias("first"), F.max("p").alias("last"))
    low, high = F.greatest(F.lit(0), F.col("first") - F.col("m") + 1), F.least(F.col("last"), F.greatest(F.lit(0), F.col("s") - F.col("m")))
    return runs.select(*ITEM, "m", "k", "s", low.alias("low"), high.alias("high")).filter("low <= high")


def _with_grams(runs: DataFrame, documents: DataFrame, ks: list[int], small: bool) -> DataFrame:
    """Runs with the hashes of the shingles from their first window's begin to their last one's end."""
    docs = documents.withColumn("th", F.xxhash64("text")).alias("d")
    some = (F.broadcast(runs) if small else runs).alias("r")
    both = docs.join(some, _same("d", "r", ["doc_id", "th"])).select("r.*", words(F.col("d.text")).alias("w"))
    last = F.least(F.col("s"), F.col("high") + F.col("m")) - 1
    near = F.lit(None).cast("array<bigint>")
    for k in ks:
        near = F.when(F.col("k") == k, grams_of(F.col("w"), F.col("low"), last, k)).otherwise(near)
    return both.select(*runs.columns, near.alias("near")).dropDuplicates(RUN)


def leaks(documents: DataFrame, items: DataFrame, params: LeakParams | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, similarity, first_word of the best window of every document that holds an item."""
    p = params or LeakParams()
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    bench = items.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("w")).withColumn("n", F.size("w")).filter("n > 0").distinct()
    bench = bench.withColumn("k", F.least(F.lit(p.k), F.col("n"))).withColumn("m", F.col("n") - F.col("k") + 1)
    whole = None
    for k in range(1, p.k + 1):
        at = grams_of(F.col("w"), F.lit(0), F.col("m") - 1, k)
        some = bench.filter(F.col("k") == k).select("item_id", "m", "k", F.xxhash64("w").alias("ih"), at.alias("grams"))
        whole = some if whole is None else whole.union(some)
    whole = staged(whole, "items")
    grams = whole.select("item_id", "m", "k", "ih", F.explode("grams").alias("h"))
    sizes = grams.select("k", "m").distinct().collect()  # the items' lengths
    known = grams.select("h", "m", "k", "item_id", "ih").distinct()
    ks = sorted({r["k"] for r in sizes})
    hits = None
    for k in ks:
        mine = known.filter(F.col("k") == k)
        some = _hits(docs, mine, k, min(stride(r["m"], p.least) for r in sizes if r["k"] == k), mine.count() <= p.broadcast_rows)
        hits = some if hits is None else hits.union(some)
    if hits is None:
        return docs.join(bench.select("item_id"), F.lit(False)).select("doc_id", "item_id", F.lit(0.0).alias("similarity"), F.lit(0).alias("first_word"))
    runs = staged(_runs(hits.distinct()), "runs")
    runs = staged(_with_grams(runs, docs, ks, runs.count() <= p.broadcast_rows), "grams")
    each = runs.select(*RUN, "m", "high", F.posexplode("near").alias("i", "h")).withColumn("i", F.col("i") + F.col("low"))
    # a shingle is part of the windows that begin up to m - 1 before it
    at = F.sequence(F.greatest(F.col("low"), F.col("i") - F.col("m") + 1), F.least(F.col("high"), F.col("i")))
    prints = fingerprint(each.withColumn("at", F.explode(at)), [*RUN, "at"], "h")
    marks = blocked(fingerprint(grams, ["item_id", "ih"], "h").withColumnRenamed("fp", "fp_item").withColumn("fp", F.col("fp_item")), p.radius).drop("fp")
    near = blocked(prints, p.radius).alias("n").join(marks.alias("i"), _same("n", "i", ["item_id", "ih", "i", "v"])).filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_item"))) <= p.radius)
    near = near.select(*(F.col(f"n.{c}").alias(c) for c in [*RUN, "at"])).distinct()
    own = near.alias("n").join(runs.alias("r"), _same("n", "r", RUN)).select("n.*", "r.m", F.slice("r.near", F.col("n.at") - F.col("n.low") + 1, F.col("r.m")).alias("own"))
    small = whole.count() <= p.broadcast_rows // 64
    of = whole.select("item_id", "ih", "grams")
    both = own.alias("o").join((F.broadcast(of) if small else of).alias("i"), _same("o", "i", ["item_id", "ih"])).select("o.*", "i.grams")
    overlap = shared_weight(F.col("own"), F.col("grams"))
    found = both.withColumn("_o", overlap).withColumn("similarity", F.col("_o") / (F.size("own") + F.col("m") - F.col("_o"))).filter(F.col("similarity") >= p.least)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("at")).alias("back"))).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("first_word"))
