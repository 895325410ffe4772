"""Exact Jaccard similarity join of word shingle sets, for components of links.

1. One pass gives each document its set's size and fingerprint, and sums
   document frequencies of shingles into a sketch of fixed size.  Documents of
   equal sets become one node.
2. A second pass gives each node its prefix: the shingles that come first when
   rare ones (by the sketch) stand before common ones.  Two sets that reach the
   threshold share a shingle of their prefixes.
3. Nodes that share a prefix shingle meet in tiles.  Hashed bitmap signatures
   (the parity of shingles in each of W bits) bound a pair's overlap from
   above: bits that differ are elements that only one set has.  A tile returns
   what the pairs the bound lets pass connect, as stars around smallest ids;
   the components of all stars are clusters, and every linked pair lies within one.
4. A cluster's nodes meet with their whole texts.  Pairs not yet connected
   whose sizes and bit counts allow a link are decided by exact intersection of
   sorted arrays.

Nodes that meet are one tile; many are dealt in two rounds.  First each is
compared with a few pivots of its group, in chunks that hold the pivots and
every node once.  Then what the pivots have not connected with the group's
largest part meets all of the group, in tiles of neighbouring size bands and
pairs of chunks.  So a group of near copies is dealt about once however large
it is; only where most of a large group is unlike its pivots, the rest meets
itself in pairs of chunks.

Links inside what a tile has already connected are not looked for, so groups
of near copies cost about a comparison a document, and components are exact.

Defined results: a text without words has size 0 and is alone; rows that share
an id are one node; a row of null id joins only rows of an equal set (its
component is null otherwise); an empty table gives no rows; extra columns
aren't read; texts of any length are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloneweave.llm import textkernel as tk
from cloneweave.llm.common import staged
from cloneweave.llm.components import components


@dataclass(frozen=True)
class JoinParams:
    """Two sets link when ``den`` * intersection >= ``num`` * union."""

    k: int = 4
    num: int = 85
    den: int = 100
    sketch_bits: int = 20
    slice_bits: int = 14
    tile: int = 2048  # nodes of a tile's side at most
    pivots: int = 8  # of a group of several tiles
    tile_shingles: int = 1 << 21
    least_bits: int = 64
    most_bits: int = 4096
    broadcast_rows: int = 1 << 18  # dealt to tiles at most; beyond it their texts are joined by a shuffle


def prefix_length(n: int, p: JoinParams) -> int:
    """Shingles of a set of n of which a linked set must hold one."""
    return n - -(-p.num * n // p.den) + 1


def width(n: int, p: JoinParams) -> int:
    """Bits of a signature: a power of two, at least twice the set's size within the limits."""
    return min(p.most_bits, max(p.least_bits, 1 << max(1, 2 * n - 1).bit_length()))


def signature(s: np.ndarray, bits: int) -> np.ndarray:
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8))


def folded(sig: np.ndarray, bits: int) -> np.ndarray:
    """Signatures (rows of bytes) at a smaller width: parities of bits that fall together."""
    while sig.shape[1] * 8 > bits:
        half = sig.shape[1] // 2
        sig = sig[:, :half] ^ sig[:, half:]
    return sig


def levels(sigs: list[bytes]) -> dict[int, np.ndarray]:
    """Signatures at each width that occurs, by row; of rows of that width or more, the others are 0.

    So a short text in a tile does not blur the signatures of long ones.
    """
    bits = np.array([len(s) * 8 for s in sigs], dtype=np.int64)
    out = {}
    for b in np.unique(bits).tolist():
        out[b] = np.zeros((len(sigs), b >> 3), dtype=np.uint8)
        for wide in np.unique(bits[bits >= b]).tolist():
            at = np.flatnonzero(bits == wide)
            out[b][at] = folded(np.frombuffer(b"".join(sigs[i] for i in at.tolist()), dtype=np.uint8).reshape(len(at), -1), b)
    return out


def allowed(n: int, sizes: np.ndarray, apart: np.ndarray | int, p: JoinParams) -> np.ndarray:
    """Whether sets of ``sizes`` with at least ``apart`` elements of only one side can link with one of size n."""
    overlap = np.minimum((n + sizes - apart) // 2, np.minimum(n, sizes))
    return p.den * overlap >= p.num * (n + sizes - overlap)


def forest(sizes: np.ndarray, sigs: list[bytes], p: JoinParams, able=None, exact=None, labels: np.ndarray | None = None):
    """A number for each row, the same for rows that allowed (and, if given, ``exact``) pairs connect; rows are in size order.

    A pair is compared at the width of the smallest set that may link with its larger one.
    ``able(i, j...)`` may forbid pairs that another tile compares; rows of equal ``labels`` are connected from the start.
    """
    root = np.arange(len(sizes)) if labels is None else np.unique(labels, return_index=True, return_inverse=True)[1:]
    root = root if labels is None else root[0][root[1]]
    tables = {b: x.view(np.uint64) if x.shape[1] % 8 == 0 else x for b, x in levels(sigs).items()}
    for i in range(1, len(sizes)):
        low = int(np.searchsorted(sizes, -(-p.num * int(sizes[i]) // p.den)))
        j = low + np.flatnonzero(root[low:i] != root[i])
        if able is not None and len(j):
            j = j[able(i, j)]
        if not len(j):
            continue
        bits = tables[min(len(sigs[low]), len(sigs[i])) * 8]
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
        j = j[allowed(int(sizes[i]), sizes[j], apart, p)]
        while len(j):
            at = int(j[-1])
            if exact is None or exact(i, at):
                root[root == root[at]] = root[i]
                j = j[root[j] != root[i]]
            else:
                j = j[:-1]
    return root


def describe(documents: DataFrame, p: JoinParams, id_col: str, text_col: str) -> DataFrame:
    """Of each document kind 0 (id, n, fingerprint h1 h2, signature); of each task kind 1: its sketch in slices."""
    per = 1 << p.slice_bits

    def run(batches):
        sketch = np.zeros(1 << p.sketch_bits, dtype=np.uint32)
        mask = np.uint64(len(sketch) - 1)
        for b in batches:
            n, h1, h2, sig = [], [], [], []
            for _, s in tk.shingles(b.column(1), p.k):
                sketch[(s & mask).astype(np.int64)] += 1
                n.append(len(s))
                h1.append(int(tk.mix(s).sum(dtype=np.uint64).view(np.int64)))
                h2.append(int(tk.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)))
                sig.append(signature(s >> np.uint64(20), width(len(s), p)).tobytes() if len(s) else None)
            m = len(n)
            yield pa.record_batch([pa.array([0] * m, pa.int32()), b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], ["kind", "id", "n", "h1", "h2", "sig"])
        if sketch.any():
            m = len(sketch) // per
            none = pa.nulls(m, pa.int64())
            yield pa.record_batch([pa.array([1] * m, pa.int32()), none, pa.array(range(m), pa.int64()), none, none, pa.array([sketch[i * per : (i + 1) * per].tobytes() for i in range(m)], pa.binary())], ["kind", "id", "n", "h1", "h2", "sig"])

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return staged(rows.mapInArrow(run, "kind int, id long, n long, h1 long, h2 long, sig binary"), "sets")


def rarity(described: DataFrame, p: JoinParams) -> np.ndarray:
    """The sketch as one byte a bin, a logarithm of its count: of a size that does not depend on the input."""
    per = 1 << p.slice_bits

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, x in zip(b.column("n").to_pylist(), b.column("sig").to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(x, dtype=np.uint32).astype(np.int64)
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array([np.minimum(255, np.round(8 * np.log2(1.0 + x))).astype(np.uint8).tobytes() for x in total.values()], pa.binary())], ["n", "x"])

    out = np.zeros(1 << p.sketch_bits, dtype=np.uint8)
    for r in described.filter("kind = 1").select("n", "sig").repartition("n").mapInArrow(add, "n long, x binary").collect():
        out[r["n"] * per : (r["n"] + 1) * per] = np.frombuffer(r["x"], np.uint8)
    return out


def prefixes(documents: DataFrame, order: np.ndarray, p: JoinParams, id_col: str, text_col: str) -> DataFrame:
    """id, keys: the prefix of every document's set."""
    shared = documents.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        rank, mask = shared.value, np.uint64(len(shared.value) - 1)
        for b in batches:
            lists, bounds = [], [0]
            for _, s in tk.shingles(b.column(1), p.k):
                if len(s):
                    take = prefix_length(len(s), p)
                    lists.append(s[np.lexsort((s, rank[(s & mask).astype(np.int64)]))[:take]])
                bounds.append(bounds[-1] + (take if len(s) else 0))
            keys = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(keys.view(np.int64)))], ["id", "keys"])

    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, keys array<long>")


def _groups(batches, keys: list[str]):
    """Row lists of equal keys from sorted batches, one at a time."""
    group, now = [], None
    for b in batches:
        for r in b.to_pylist():
            at = tuple(r[k] for k in keys)
            if at != now and group:
                yield now, group
                group = []
            now = at
            if not group or r != group[-1]:  # repeated rows stand side by side
                group.append(r)
    if group:
        yield now, group


TILE = ["_g", "_c1", "_c2"]


def _count(p: JoinParams, rows: Column | None = None):
    """Tiles that so many rows need."""
    one, n = (F.lit(1), F.col("n")) if rows is None else (F.when(rows, 1), F.when(rows, F.col("n")))
    return F.greatest(F.ceil(F.count(one) / p.tile), F.ceil(F.sum(n) / p.tile_shingles))


def counted(rows: DataFrame, group: str, p: JoinParams) -> DataFrame:
    """Rows (group, node, n) with _all, the tiles that their group needs.

    Only groups of several tiles are joined, so that no group's rows are brought together for it.
    """
    whole = rows.groupBy(F.col(group).alias("_w")).agg(_count(p).alias("_all")).filter("_all > 1")
    return rows.join(_light(staged(whole, "large"), p), F.col(group) == F.col("_w"), "left").drop("_w").withColumn("_all", F.coalesce("_all", F.lit(1)))


def _light(rows: DataFrame, p: JoinParams) -> DataFrame:
    """A table about large groups, of far fewer rows than they have: broadcast while its size allows."""
    return F.broadcast(rows) if rows.count() <= p.broadcast_rows else rows


def _tile(rows: DataFrame, group: str, g, c1, c2, side, high=None, label=None) -> DataFrame:
    long = lambda c: c if isinstance(c, Column) else F.lit(c).cast("long")
    return rows.select(group, "node", "n", long(g).alias("_g"), long(c1).alias("_c1"), long(c2).alias("_c2"), F.lit(side).alias("_side"), (F.lit(False) if high is None else high).alias("_high"), (F.col("node") if label is None else label).alias("_label"))


def single_tiles(marked: DataFrame, group: str) -> DataFrame:
    """The groups that are one tile."""
    return _tile(marked.filter("_all = 1"), group, -1, 0, 0, 0)


def pivot_tiles(large: DataFrame, group: str, p: JoinParams) -> DataFrame:
    """Chunks of the groups of several tiles: each row once (side 2), and the group's pivots in each chunk (side 1)."""
    order = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(3), "node"), "node", "n")
    some = large.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= p.pivots)
    some = some.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_all") - 1)))
    return _tile(large, group, -2, F.pmod(F.xxhash64("node"), F.col("_all")), 0, 2).unionByName(_tile(some, group, -2, F.col("_o"), 0, 1))


def rest_tiles(large: DataFrame, group: str, roots: DataFrame, p: JoinParams) -> DataFrame:
    """What is not connected with its group's largest part (side 1) and all of the group (side 2), by size bands that a link can't skip.

    Tiles of a band hold its rows and the next band's; each pair of chunks meets once.
    """
    rows = large.drop("_all").join(roots.select(F.col("node").alias("_node"), F.col("root").alias("_root")), F.col("node") == F.col("_node"), "left")
    rows = rows.withColumn("_label", F.coalesce("_root", "node")).drop("_node", "_root")
    parts = rows.groupBy(F.col(group).alias("_w"), F.col("_label").alias("_v")).agg(F.count(F.lit(1)).alias("_m"))
    parts = parts.groupBy("_w").agg(F.max(F.struct("_m", "_v")).alias("_x")).select("_w", F.col("_x._v").alias("_main"))
    rows = rows.join(_light(staged(parts, "parts"), p), F.col(group) == F.col("_w")).withColumn("_rest", F.col("_label") != F.col("_main")).drop("_w", "_main")
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(p.den / p.num))
    both = F.array(F.struct(band.alias("g"), F.lit(False).alias("high")), F.struct((band - 1).alias("g"), F.lit(True).alias("high")))
    rows = rows.withColumn("_b", F.explode(both)).withColumns({"_g": F.col("_b.g"), "_high": F.col("_b.high")}).drop("_b")
    chunks = rows.groupBy(F.col(group).alias("_w"), F.col("_g").alias("_v")).agg(_count(p).alias("_all"), F.coalesce(_count(p, F.col("_rest")), F.lit(0)).alias("_some")).filter("_some > 0")
    rows = rows.join(_light(staged(chunks, "chunks"), p), (F.col(group) == F.col("_w")) & (F.col("_g") == F.col("_v"))).drop("_w", "_v")
    mine = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    every = rows.withColumns({"_mine": mine("_all"), "_o": each("_some")})
    some = rows.filter("_rest").withColumns({"_mine": mine("_some"), "_o": each("_all")})
    tile = lambda t, c1, c2, side: _tile(t, group, F.col("_g"), F.col(c1), F.col(c2), side, F.col("_high"), F.col("_label"))
    return tile(every, "_o", "_mine", 2).unionByName(tile(some, "_mine", "_o", 1))


def arranged(dealt: DataFrame, group: str) -> DataFrame:
    """Tiles one after the other, rows by size."""
    return dealt.repartition(group, *TILE).sortWithinPartitions(group, *TILE, "n", "node")


def met(rows: DataFrame, group: str, p: JoinParams, judged) -> DataFrame:
    """Components of the edges that ``judged`` finds in the tiles of rows (group, node, n)."""
    marked = staged(counted(rows, group, p), "counted")
    large = marked.filter("_all > 1")
    if large.isEmpty():
        return components(judged(single_tiles(marked, group)))
    roots = components(judged(single_tiles(marked, group).unionByName(pivot_tiles(large, group, p))))
    rest = staged(rest_tiles(large, group, roots, p), "rest")
    if rest.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(judged(rest)))


def _able(rows: list[dict]):
    """Pairs that a tile compares: of different sides where it has sides; not both of the higher band."""
    high = np.array([r["_high"] for r in rows])
    side = np.array([r["_side"] for r in rows])
    return lambda i, j: ~(high[i] & high[j]) & ((side[i] == 0) | (side[j] != side[i]))


def _labels(rows: list[dict]) -> np.ndarray:
    return np.array([r["_label"] for r in rows], dtype=np.int64)


def _stars(nodes: list[int], root: np.ndarray) -> list[tuple[int, int]]:
    """Edges from the smallest node of each connected set to its others: a long chain would take many rounds of components."""
    centre: dict[int, int] = {}
    for node, r in zip(nodes, root.tolist()):
        centre[r] = min(node, centre.get(r, node))
    return [(node, centre[r]) for node, r in zip(nodes, root.tolist()) if node != centre[r]]


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x[0] for x in pairs], pa.int64()), pa.array([x[1] for x in pairs], pa.int64())], ["a", "b"])


def _candidates(batches, p: JoinParams):
    out = []
    for _, rows in _groups(batches, ["key", *TILE]):
        sizes = np.array([r["n"] for r in rows], dtype=np.int64)
        out += _stars([r["node"] for r in rows], forest(sizes, [r["sig"] for r in rows], p, _able(rows), None, _labels(rows)))
        if len(out) > 8192:
            yield _edges(out)
            out = []
    yield _edges(out)


def _verified(batches, p: JoinParams):
    out = []
    for _, rows in _groups(batches, ["root", *TILE]):
        sets = [s for _, s in tk.shingles(pa.array([r["text"] for r in rows], pa.large_string()), p.k)]
        mine = [i for i, r in enumerate(rows) if r["n"] == len(sets[i])]  # an id of several texts meets all their sizes
        if not mine:
            continue
        rows, sets = [rows[i] for i in mine], [sets[i] for i in mine]
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        bits = width(int(sizes.max()), p)
        sigs = [signature(s >> np.uint64(20), bits).tobytes() for s in sets]

        def exact(i, j):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            return p.den * both >= p.num * (len(sets[i]) + len(sets[j]) - both)

        out += _stars([r["node"] for r in rows], forest(sizes, sigs, p, _able(rows), exact, _labels(rows)))
        if len(out) > 8192:
            yield _edges(out)
            out = []
    yield _edges(out)


SPOTS = 1 << 23


def _bitmap(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap of fixed size over hashes of the keys: where its bit is 0, a key is not among them."""
    spots = F.pmod(F.xxhash64(key), F.lit(SPOTS))
    marks = keys.select(F.floor(spots / 32768).alias("i"), (spots % 32768).alias("j")).groupBy("i").agg(F.bitmap_construct_agg("j").alias("m"))
    bitmap = bytearray(SPOTS >> 3)
    for r in marks.collect():  # 256 rows at most
        bitmap[r["i"] * 4096 : (r["i"] + 1) * 4096] = r["m"]
    return np.frombuffer(bytes(bitmap), dtype=np.uint8)


def _marked(bitmap: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return ((bitmap[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1).astype(bool)


def _meetings(lists: DataFrame, keys: DataFrame) -> DataFrame:
    """key, node of the prefixes' keys that may be among ``keys``: most others stay out of the shuffle."""
    shared = lists.sparkSession.sparkContext.broadcast(_bitmap(keys, "key"))
    rows = lists.select(F.col("id").alias("node"), F.explode("keys").alias("key")).withColumn("spot", F.pmod(F.xxhash64("key"), F.lit(SPOTS)))

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(_marked(shared.value, b.column("spot").to_numpy()))).select(["key", "node"])

    return rows.mapInArrow(keep, "key long, node long")


def _members(documents: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text of the documents that may be among ``nodes``; the join decides."""
    shared = documents.sparkSession.sparkContext.broadcast(_bitmap(nodes, "node"))

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(_marked(shared.value, b.column("spot").to_numpy()))).select(["id", "text"])

    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    return rows.withColumn("spot", F.pmod(F.xxhash64("id"), F.lit(SPOTS))).mapInArrow(keep, "id long, text string")


def join_components(documents: DataFrame, params: JoinParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    p = params or JoinParams()
    described = describe(documents, p, id_col, text_col)
    sets = described.filter("kind = 0").drop("kind")
    same = ["n", "h1", "h2"]
    nodes = staged(sets.filter("n > 0").groupBy(*same).agg(F.min("id").alias("node"), F.first("sig").alias("sig")).filter("node is not null"), "nodes")
    order = rarity(described, p)
    lists = prefixes(documents, order, p, id_col, text_col).join(nodes.select("node").distinct(), F.col("id") == F.col("node"), "left_semi")
    lists = staged(lists.dropDuplicates(["id", "keys"]), "prefixes")
    shared = lists.select(F.explode("keys").alias("key"), F.col("id").alias("node"))
    # sums of hashes, not their xor: a node of several texts can stand at a key more than once
    low, high = F.xxhash64("node").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.xxhash64("node"), 32)
    group = shared.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("a"), F.max("node").alias("b"), F.sum(low).alias("x"), F.sum(high).alias("y")).filter("m > 1 and a <> b")
    group = staged(group.groupBy("m", "a", "b", "x", "y").agg(F.min("key").alias("key")), "keys")  # one key of those with the same nodes
    rows = _meetings(lists, group.select("key"))
    many = rows.join(group.select(F.col("key").alias("_k")), F.col("key") == F.col("_k"), "left_semi")
    many = staged(many.join(nodes.select(F.col("node").alias("_node"), "n"), F.col("node") == F.col("_node")).drop("_node"), "meetings")
    bits = nodes.select(F.col("node").alias("_node"), "sig", F.col("n").alias("_n"))

    def candidates(dealt: DataFrame) -> DataFrame:
        signed = dealt.join(bits, (F.col("node") == F.col("_node")) & (F.col("n") == F.col("_n"))).drop("_node", "_n")
        return arranged(signed, "key").mapInArrow(lambda b: _candidates(b, p), "a long, b long")

    clusters = met(many, "key", p, candidates)
    placed = clusters.union(clusters.select(F.col("root").alias("node"), "root").distinct())
    placed = staged(placed.join(nodes.select(F.col("node").alias("_node"), "n"), F.col("node") == F.col("_node")).drop("_node").distinct(), "clusters")

    def links(dealt: DataFrame) -> DataFrame:
        dealt = staged(dealt, "dealt")
        small = dealt.count() <= p.broadcast_rows  # of what is broadcast itself, copies and all
        texts = _members(documents, dealt, id_col, text_col).join(F.broadcast(dealt) if small else dealt, F.col("id") == F.col("node")).drop("id")
        return arranged(texts, "root").mapInArrow(lambda b: _verified(b, p), "a long, b long")

    roots = met(placed, "root", p, links)
    label = nodes.join(roots.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(*(F.col(c).alias(f"_{c}") for c in same), F.coalesce("root", "node").alias("label"))
    out = sets.drop("sig").join(label, (F.col("n") == F.col("_n")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("label", "id").alias("component_id"))
