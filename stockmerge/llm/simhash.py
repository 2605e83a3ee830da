"""SimHash fingerprints, BK-trees over shards of them, and the components of fingerprints within a Hamming radius of 2.

Equal fingerprints are one class, so copies cost one row.  Two fingerprints that differ in at most RADIUS bits agree in one of
RADIUS + 1 blocks of bits, so each class stands in that many shards: those that share the block's bits.  In a shard the
fingerprints form a BK-tree: a node's children are keyed by their integer Hamming distance to it, and a search follows only the
edges that lie within the radius of the query's own distance to the node.

A shard of more than PART fingerprints is too much for one task.  While all such shards together hold at most SENT
fingerprints, their trees are broadcast and searched from every task.  Beyond that they are cut anew by blocks of the bits that are
still free; with twelve free bits a shard holds at most 4096 fingerprints, so that ends, and no fingerprint has more than 3 ** 5 rows.
Trees of all shards are never sent anywhere: they would grow with the documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, slices, texts_of
from .jaccard import _edges, _whole, components

RADIUS = 2
PART, SENT = 4096, 1 << 16
STEP = 1 << 15  # shingles, or queries of a search, at a time
SEED = 42


def shingle_hashes(text: str | None, words: int = 3):
    """XXH64 of every word n-gram in order, repeats included, in arrays of at most STEP; a shorter text is one n-gram."""
    # of bytes, lower() changes A-Z alone and split() cuts at ASCII white space alone
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return
    k = min(words, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    starts, ends = starts[: len(found) - k + 1], ends[k - 1 :]
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(starts), STEP):
        part = zip(starts[i : i + STEP].tolist(), ends[i : i + STEP].tolist(), strict=True)
        yield np.fromiter((digest(joined[s:e], SEED) for s, e in part), np.uint64, min(STEP, len(starts) - i))


def simhash(text: str | None, words: int = 3) -> int:
    """The unsigned 64-bit fingerprint: a bit is 1 if it is set in over half the n-grams' hashes; 0 without words."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row of doc_id and text; fp is the fingerprint as a signed long."""

    def run(batches):
        for batch in slices(batches):
            fps = np.array([simhash(t, words) for t in texts_of(batch)], np.uint64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class Trees:
    """BK-trees of several shards in arrays.  Rows of one shard are neighbours, and its first row is the root.  ``edges`` holds
    node * 65 + distance for every edge, sorted, and ``child`` the node it leads to."""

    def __init__(self, fps: np.ndarray, shards: np.ndarray):
        self.fps = fps
        first = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]) if len(fps) else np.zeros(0, np.int64)
        self.root = np.repeat(first, np.diff(np.r_[first, len(fps)]))
        row = np.setdiff1d(np.arange(len(fps)), first)
        node, edges, child = self.root[row], [], []
        while len(row):  # all rows go down one edge; the first row to come to a new edge becomes its node
            key = node * 65 + self.distance(row, node)
            found, at, which = np.unique(key, return_index=True, return_inverse=True)
            edges.append(found)
            child.append(row[at])
            on = np.ones(len(row), bool)
            on[at] = False
            row, node = row[on], row[at][which[on]]
        edges, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (edges, child))
        order = np.argsort(edges)
        self.edges, self.child = edges[order], child[order]

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fps[a] ^ self.fps[b]).astype(np.int64)

    def within(self, radius: int, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query row, other row) of one shard that differ in at most ``radius`` bits.  All queries go down level by level."""
        query, node, found = queries, self.root[queries], []
        while len(query):
            d = self.distance(query, node)
            hit = (d <= radius) & (query != node)
            found.append((query[hit], node[hit]))
            low = np.searchsorted(self.edges, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edges, node * 65 + np.minimum(d + radius, 64), "right") - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            query, node = np.repeat(query, n), self.child[at]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2

    def stars(self, queries: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
        """Edges (fingerprints) with the same components as the links of the queries: at most one for each row."""
        label = np.arange(len(self.fps))
        step = max(256, STEP // 8)
        for k in range(0, len(queries), step):
            a, b = self.within(radius, queries[k : k + step])
            while len(a):
                low = np.minimum(label[a], label[b])
                far = label[a] != label[b]
                if not far.any():
                    break
                a, b, low = a[far], b[far], low[far]
                np.minimum.at(label, label[a], low)
                np.minimum.at(label, label[b], low)
                while (label[label] != label).any():
                    label = label[label]
        moved = np.flatnonzero(label != np.arange(len(label)))
        fps = self.fps.view(np.int64)
        return list(zip(fps[moved].tolist(), fps[label[moved]].tolist(), strict=True))


def blocks(mask: int, radius: int = RADIUS) -> list[int]:
    """``mask`` with one more block of fixed bits, for each of radius + 1 blocks of its free bits."""
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << int(i) for i in part) for part in np.array_split(free, radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def in_shards(rows: DataFrame, masks: list[int]) -> DataFrame:
    """(shard, mask, fp): every row of mask and fp once for each block of the bits that its mask leaves free."""
    finer = {_signed(m): [_signed(b) for b in blocks(m)] for m in masks}
    of = F.create_map(*[F.lit(x) if isinstance(x, int) else F.array(*map(F.lit, x)) for item in finer.items() for x in item])
    found = rows.select("fp", F.explode(F.element_at(of, F.col("mask"))).alias("mask"))
    return found.select(F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("shard"), "mask", "fp")


def tree_links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links inside shards of at most PART rows (shard, fp).  A task builds and searches the trees of some shards at a time."""
    dealt = rows.select("shard", "fp").repartition("shard").sortWithinPartitions("shard")

    def run(batches):
        for part in _whole(batches, "shard"):
            shard, fps = column(part, "shard").to_numpy(), column(part, "fp").to_numpy().view(np.uint64)
            same = shard[1:] == shard[:-1]
            keep = np.r_[False, same] | np.r_[same, False]
            trees = Trees(fps[keep], shard[keep])
            yield _edges(trees.stars(np.arange(len(trees.fps)), radius))

    return dealt.mapInArrow(run, "a long, b long")


def broadcast_links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links inside the shards of at most SENT rows in all; their trees go to every task, and each task searches for its rows."""
    held = rows.select("shard", "fp").toPandas().sort_values(["shard", "fp"])
    spark = rows.sparkSession
    shards, fps = held["shard"].to_numpy(np.int64), held["fp"].to_numpy(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast((Trees(fps, shards), shards))

    def run(batches):
        trees, of = shared.value
        for batch in batches:
            if batch.num_rows:
                low, n = column(batch, "id").to_numpy() * STEP // 64, STEP // 64
                rows = (low[:, None] + np.arange(n)).ravel()
                yield _edges(trees.stars(rows[rows < len(of)], radius))

    tasks = -(-len(fps) * 64 // STEP)
    return spark.range(0, tasks, 1, max(1, tasks)).mapInArrow(run, "a long, b long")


def links(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the distinct fingerprints ``fp``, as far as their components need them."""
    masks, edges = [0], []
    rows = classes.select("fp", F.lit(0).cast("long").alias("mask"))
    while True:
        rows = in_shards(rows, masks)
        masks = [b for m in masks for b in blocks(m)]
        crowded = cut(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > PART))
        total = crowded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not total:
            return _union([*edges, tree_links(rows, radius)])
        edges.append(tree_links(rows.join(crowded, "shard", "left_anti"), radius))
        rows = cut(rows.join(crowded, "shard", "left_semi"))
        if total <= SENT:
            return _union([*edges, broadcast_links(rows, radius)])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def cluster(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id for every row: the smallest doc_id reachable over
    fingerprints that differ in 2 bits or fewer, itself included.

    Words are runs without ASCII white space with A-Z lower-cased; n-grams of whole texts count as often as they occur; fewer words
    are one n-gram.  Null, empty and blank texts have fingerprint zero and are linked like any other.  Rows with
    a null id have a fingerprint and take part in links; their component_id is the smallest id reachable, null if there is none.
    Repeated rows and different texts with one id are rows of their own.  An empty table gives an empty result.  Only
    doc_id and text are read.
    """
    rows = cut(fingerprints(docs, words))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low")))
    edges = cut(links(classes))
    nodes = edges.select(F.col("a").alias("key")).union(edges.select("b")).distinct()
    comps = components(edges, nodes.select("key", F.col("key").alias("comp")))
    placed = classes.join(comps.withColumnRenamed("key", "fp"), "fp", "left").select("fp", "low", F.coalesce("comp", "fp").alias("comp"))
    first = placed.groupBy("comp").agg(F.min("low").alias("component_id"))
    of = placed.join(first, "comp").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
