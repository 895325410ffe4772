"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is cut into blocks of equal token counts.  Blocks go to sources by
highest quotients (votes: the sources' targets), then each source's blocks to
its shards the same way (votes: the shards' sizes), which gives an integer
quota for every shard.  A shard is a seeded hash class of the source's
documents, so a hot source has many shards and no window holds a source.
Within a shard the documents stand in a seeded order on a line of words, cut
into blocks; whole passes over the line come first, then the quota's rest
takes blocks that follow each other in that order, so each document gives the
words of it that taken blocks cover.

A source whose target is less than half a block, so that no block is its, gets
one block cut to its target.  The driver holds one row a source; quotas of
shards are made in tasks, a source each.

Defined results: null and blank texts have size 0 and give nothing; a null
source is a source of its own and comes last; repeated rows are separate
documents; equal hashes stand by id, then size; an empty table gives no rows;
extra columns aren't read; a document of any length is cut into blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloneweave.llm.common import WORD, staged


@dataclass(frozen=True)
class MixParams:
    weights: tuple[float, ...] = (3.0, 1.0, 2.0)  # by the sources' order, repeating
    total: float = 1.5  # of all sizes
    most: float = 2.0  # a source's target, of its size
    block: int = 64  # tokens
    shard_words: int = 1 << 17
    shards: int = 4096  # of one source at most; larger sources have larger shards
    seed: int = 17


def targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """Shares of ``total`` by weight, none above ``most`` times its size; excess goes to the others by weight."""
    out, open_ = np.zeros(len(sizes)), np.ones(len(sizes), dtype=bool)
    left = float(total)
    while open_.any():
        share = left * weights / weights[open_].sum()
        over = open_ & (share > most * sizes)
        if not over.any():
            out[open_] = share[open_]
            break
        out[over] = most * sizes[over]
        left -= float(out[over].sum())
        open_ &= ~over
    return out


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients votes / (2 s + 1), none above ``most``; ties go to the first.

    Equal to handing the seats out one by one: a divisor is found by bisection
    that gives nearly all of them at once, the rest follow singly.
    """
    votes = np.asarray(votes, dtype=np.float64)
    most = np.full(len(votes), seats, dtype=np.int64) if most is None else np.asarray(most, dtype=np.int64)
    most = np.where(votes > 0, most, 0)
    seats = min(int(seats), int(most.sum()))
    given = np.zeros(len(votes), dtype=np.int64)
    if seats <= 0:
        return given
    low, high = 0.0, float(votes.max()) * 2 + 1  # quotient thresholds: at ``high`` none is given
    at = lambda q: np.minimum(most, np.maximum(0, np.floor((votes / q + 1) / 2).astype(np.int64)))
    low = float(votes[votes > 0].min()) / (2 * seats + 3)
    while at(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if at(mid).sum() <= seats:
            high = mid
        else:
            low = mid
    given = at(high)
    while (more := seats - int(given.sum())) > 0:  # equal quotients: one each, the first ones first
        quotient = np.where(given < most, votes / (2 * given + 1), -1.0)
        top = quotient.max()
        given[np.flatnonzero(quotient == top)[:more]] += 1
    return given


def sized(documents: DataFrame, p: MixParams, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size of every row."""
    return documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def plan(sized_rows: DataFrame, p: MixParams) -> pd.DataFrame:
    """One row a source: size, target, shards, seats, most (words of a source without a block of its own)."""
    per = sized_rows.groupBy("source").agg(F.sum("size").alias("size")).toPandas()
    keys = [(s is None, (s or "").encode()) for s in per["source"].where(per["source"].notna(), None)]
    per = per.iloc[sorted(range(len(per)), key=keys.__getitem__)].reset_index(drop=True)
    sizes = per["size"].to_numpy(dtype=np.float64)
    weights = np.array([p.weights[i % len(p.weights)] for i in range(len(per))])
    per["target"] = targets(sizes, weights, p.total * sizes.sum(), p.most) if len(per) else np.zeros(0)
    per["shards"] = np.clip(np.ceil(sizes / p.shard_words), 1, p.shards).astype(np.int64)
    seats = sainte_lague(per["target"].to_numpy(), int(round(per["target"].sum() / p.block)))
    none = (seats == 0) & (per["target"].to_numpy() >= 0.5)
    per["seats"] = np.where(none, 1, seats)
    per["most"] = np.where(none, np.round(per["target"].to_numpy()).astype(np.int64), np.iinfo(np.int64).max)
    per["_s"] = np.arange(len(per))
    return per


def mix(documents: DataFrame, params: MixParams | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    p = params or MixParams()
    spark = documents.sparkSession
    rows = staged(sized(documents, p, id_col, text_col, source_col), "sizes")
    per = plan(rows, p)
    kinds = "_s int, source string, source_size long, target double, shards long, _seats long, _most long"
    sources = spark.createDataFrame([(int(r["_s"]), None if pd.isna(r["source"]) else r["source"], int(r["size"]), float(r["target"]), int(r["shards"]), int(r["seats"]), int(r["most"])) for _, r in per.iterrows()], kinds)
    spot = F.xxhash64(F.lit(p.seed), F.col("doc_id"))
    dealt = rows.withColumnRenamed("source", "_source").join(sources, F.col("_source").eqNullSafe(F.col("source"))).withColumn("_spot", spot).withColumn("_shard", F.pmod(F.xxhash64(F.lit(p.seed + 1), F.col("doc_id"), F.col("size")), F.col("shards")))

    def quota(shards: pd.DataFrame) -> pd.DataFrame:
        """The quotas of a source's shards."""
        shards = shards.sort_values("_shard")
        votes = shards["shard_size"].to_numpy(dtype=np.int64)
        # a block over the end of the second pass is cut there
        shards["quota"] = sainte_lague(votes, int(shards["_seats"].iloc[0]), np.ceil(p.most * votes / p.block).astype(np.int64))
        return shards[["_s", "_shard", "shard_size", "quota", "_most"]]

    shards = dealt.groupBy("_s", "_shard", "_seats", "_most").agg(F.sum("size").alias("shard_size"))
    quotas = staged(shards.groupBy("_s").applyInPandas(quota, "_s int, _shard long, shard_size long, quota long, _most long"), "quotas")
    w = Window.partitionBy("_s", "_shard").orderBy("_spot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    words = F.least(F.col("quota") * p.block, (F.col("shard_size") * p.most).cast("long"), F.col("_most"))
    passes = F.floor(words / F.col("shard_size"))
    rest = words - passes * F.col("shard_size")
    part = F.greatest(F.lit(0), F.least(F.col("_end"), rest) - (F.col("_end") - F.col("size")))
    out = dealt.drop("_most").withColumn("_end", F.sum("size").over(w)).join(quotas, ["_s", "_shard"])
    return out.select("doc_id", "size", "source_size", "target", F.when(F.col("size") == 0, F.lit(0)).otherwise(passes * F.col("size") + part).cast("long").alias("taken"))
