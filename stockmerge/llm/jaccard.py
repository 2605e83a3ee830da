"""Jaccard self-join on word n-grams by vertical partitioning, and the components of its links.

All n-grams stand in one global order (rare first, then by hash), which is cut into PIECES fragments of about equal mass.

1.  Equal sets form a class; everything below works on classes, so copies cost one row.
2.  Two linked sets share an n-gram among the first few of each (prefix filter).  Classes that share such an n-gram and
    have compatible sizes meet in a bucket.
3.  Classes that are to be compared are dealt into tiles of bounded size.  Every set is cut into its fragments, and each fragment of
    a tile is counted on its own, in rows and tasks of its own: it gives the partial overlaps of all pairs of the tile
    as one array.  The arrays of a tile's fragments are summed, pair by pair, and the sums decide the links.

Components need no pair inside a component that is known already.  So a bucket first links its members with its
leader (linear), and only members of different components are then compared with each other, all of them.  Before that a
pair is bounded by coarse counts: its overlap is at most the sum of the smaller counts in SKETCH pieces (more for long sets, as
many as it takes to tell them apart), and before that in as few pieces as a set's size allows, so that the rows of the buckets stay narrow.
Pairs are never rows: tiles hold arrays, and of the links of a tile a spanning forest is sent.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Codes, bitmap_of, column, cut, mix, slices, texts_of, windows

SKETCH, PIECES = 256, 8  # least pieces of a set for bounds; fragments of the global order
COUNTERS, SLICE = 1 << 18, 1 << 13
TILE, TILE_ELEMENTS = 256, 1 << 20  # most classes on one side of a tile, and about so many n-grams
BITS = 1 << 24


@dataclass(frozen=True)
class Rule:
    words: int = 5
    least: Fraction = Fraction(4, 5)

    def overlap(self, n, m):
        """Least overlap of linked sets of n and m elements: ceil(t (n + m) / (1 + t))."""
        a, b = self.least.numerator, self.least.denominator
        return -(-(a * (n + m)) // (a + b))

    def prefix(self, n: int) -> int:
        """A linked partner shares at least ceil(t n) elements, so one of any n - ceil(t n) + 1."""
        return n - -(-n * self.least.numerator // self.least.denominator) + 1


# kept between the tasks of a Python worker; few, as a hash costs little
_CODES = Codes(lambda word: xxhash.xxh3_64_intdigest(word) - (1 << 63), limit=200_000)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams; a shorter text is one n-gram; no words, no n-grams."""
    # of bytes, lower() changes A-Z alone and split() cuts at ASCII white space alone
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, np.uint64)
    codes = _CODES.array(found)
    return np.unique(windows(codes, min(words, len(found))))


def sketch(s: np.ndarray, width: int = SKETCH) -> np.ndarray:
    """How many n-grams lie in each of ``width`` pieces (low bits of the hash; the global order uses the high ones)."""
    return np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width)


def packed(counts: np.ndarray) -> bytes:
    """A sketch in bytes, or with counts beyond them in four bytes each.  Which it is, the sum tells: the counts add up to the set's size."""
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def counter(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(46)).astype(np.int64)


def set_key(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


@dataclass(frozen=True)
class Order:
    """The global order of n-grams: by ``level`` of their counter (rare first), then by hash; and where it is cut."""

    level: np.ndarray
    cuts: np.ndarray

    def first(self, s: np.ndarray, n: int) -> np.ndarray:
        level = self.level[counter(s)]
        return s[:n] if not level.any() else s[np.argsort(level, kind="stable")[:n]]

    def fragments(self, s: np.ndarray) -> list[bytes]:
        """A sorted set cut at the same places of the order as every other set."""
        at = (self.level[counter(s)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
        piece = np.searchsorted(self.cuts, at, "right")
        order = np.argsort(piece, kind="stable")
        ends = np.cumsum(np.bincount(piece, minlength=PIECES))
        dealt = s[order]
        return [dealt[i:j].tobytes() for i, j in zip(np.r_[0, ends[:-1]], ends, strict=True)]


def describe(docs: DataFrame, words: int, rule: Rule = Rule()) -> DataFrame:
    """One row for each document (kind 0: doc_id, text_id, key, n, its sketch) and, for each task, slices of its
    n-gram counters (kind 1: key is the slice)."""

    def run(batches):
        seen = np.zeros(COUNTERS, np.int32)
        for batch in slices(batches):
            keys, ns, counts = [], [], []
            for text in texts_of(batch):
                s = shingles(text, words)
                keys.append(set_key(s))
                ns.append(len(s))
                counts.append(packed(sketch(s, max(SKETCH, int(widths(rule, len(s)))))))
                if len(s):
                    np.add.at(seen, counter(s), 1)
            yield _rows([0] * len(ns), column(batch, "doc_id"), column(batch, "text_id"), keys, ns, counts)
        parts = [(i, p) for i, p in enumerate(seen.reshape(-1, SLICE)) if p.any()]
        none = pa.nulls(len(parts), pa.int64())
        yield _rows([1] * len(parts), none, none, [i for i, _ in parts], [0] * len(parts), [p.tobytes() for _, p in parts])

    return docs.mapInArrow(run, "kind int, doc_id long, text_id long, key long, n int, counts binary")


def _rows(kind, ids, text_ids, keys, ns, counts):
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), ids, text_ids, pa.array(keys, pa.int64()), pa.array(ns, pa.int32()), pa.array(counts, pa.binary())],
        ["kind", "doc_id", "text_id", "key", "n", "counts"],
    )


def global_order(described: DataFrame) -> Order:
    """Levels are how often n-grams fall on each counter, as a power of two, over all data: COUNTERS numbers whatever the
    data's size.  Only the order depends on them, never the result.  The cuts leave about equal mass between them."""

    def add(pdf):
        import pandas as pd

        total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in pdf["counts"])
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "counts": [total.tobytes()]})

    out = np.zeros(COUNTERS, np.int64)
    parts = described.where("kind = 1").groupBy("key").applyInPandas(add, "key long, counts binary")
    for key, counts in parts.toLocalIterator():
        out[key * SLICE : (key + 1) * SLICE] = np.frombuffer(counts, np.int64)
    level = np.ceil(np.log2(np.maximum(out, 1) / max(1.0, float(np.mean(out)) * 2))).clip(0, 60).astype(np.uint8)
    mass = np.cumsum(np.r_[0, np.bincount(level, out, 64)]).astype(float)
    wanted = mass[-1] * np.arange(1, PIECES) / PIECES
    at = np.clip(np.searchsorted(mass, wanted, "right") - 1, 0, 62)
    share = (wanted - mass[at]) / np.maximum(mass[at + 1] - mass[at], 1)
    inside = [min((1 << 58) - 1, int(x * (1 << 58))) for x in share]
    return Order(level, np.array([(int(a) << 58) + b for a, b in zip(at, inside, strict=True)], np.uint64))


def prefixes(docs: DataFrame, rule: Rule, order: Order) -> DataFrame:
    """(gram, key, n) for the first n-grams of every set in the global order; a task sends equal sets once."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        sent = set()
        for batch in slices(batches):
            grams, keys, ns = [], [], []
            for text in texts_of(batch):
                s = shingles(text, rule.words)
                if not len(s) or set_key(s) in sent:
                    continue
                sent.add(set_key(s))
                if len(sent) > 100_000:
                    sent.clear()
                first = shared.value.first(s, rule.prefix(len(s)))
                grams.append(first)
                keys.append(np.full(len(first), set_key(s), np.int64))
                ns.append(np.full(len(first), len(s), np.int32))
            if grams:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(ns))], ["gram", "key", "n"])

    return docs.mapInArrow(run, "gram long, key long, n int")


def shared_grams(rows: DataFrame, rule: Rule) -> DataFrame:
    """(bucket, lead, key, often) for the buckets with at least two classes; lead is the first of a bucket.  A task walks its n-grams by set
    size and holds one row; a part ends where two neighbouring sizes are too far apart for any link across.

    Near copies share most of their n-grams, and so many buckets with the same members.  A bucket that lies within a batch is named by the
    hash of its members: such buckets become one, with ``often``, their number.  (Should two hashes meet, more pairs are looked at.)"""
    a, b = rule.least.numerator, rule.least.denominator
    dealt = rows.repartition("gram").sortWithinPartitions("gram", "n", "key")

    def run(batches):
        last, part = None, 0  # gram, n, key, whether it was sent, lead of its bucket
        for batch in batches:
            gram, n, key = (column(batch, c).to_numpy() for c in ("gram", "n", "key"))
            sent = np.zeros(len(gram), bool)
            if last is not None:  # equal rows are neighbours
                gram, n, key, sent = np.r_[last[0], gram], np.r_[last[1], n], np.r_[last[2], key], np.r_[last[3], sent]
            if not len(gram):
                continue
            fresh = np.r_[True, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1])]
            gram, n, key, sent = gram[fresh], n[fresh].astype(np.int64), key[fresh], sent[fresh]
            joined = (gram[1:] == gram[:-1]) & (n[1:] * a <= n[:-1] * b)
            parts = part + np.cumsum(np.r_[0, ~joined])
            own = np.maximum.accumulate(np.where(np.r_[True, ~joined], np.arange(len(gram)), 0))
            lead = np.where(own == 0, key[0] if last is None else last[4], key[own])
            keep = (np.r_[False, joined] | np.r_[joined, False]) & ~sent
            last, part = (gram[-1], n[-1], key[-1], bool(keep[-1] or sent[-1]), lead[-1]), int(parts[-1])
            bucket = mix(gram.view(np.uint64) + parts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            start = np.flatnonzero(np.r_[True, ~joined])
            named = np.repeat(mix(np.add.reduceat(mix(key.view(np.uint64)), start)), np.diff(np.r_[start, len(key)]))
            bucket = np.where((own > 0) & (own < start[-1]), named, bucket).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(lead[keep]), pa.array(key[keep])], ["bucket", "lead", "key"])

    found = dealt.mapInArrow(run, "bucket long, lead long, key long")
    return found.groupBy("bucket", "lead", "key").agg(F.count("*").alias("often"))


class Sketches:
    """Sketches of the sets of a batch; two of different widths are compared at the smaller one."""

    def __init__(self, rule: Rule, n: np.ndarray, blobs: list[bytes]):
        self.rule, self.n, self.tables = rule, n, {}
        self.width, self.at = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        size, parts = np.array([len(c) for c in blobs], np.int64), {}
        for length in np.unique(size).tolist():
            rows = np.flatnonzero(size == length)
            counts = np.frombuffer(b"".join([blobs[i] for i in rows.tolist()]), np.uint8).reshape(-1, length)
            bytes_ = counts.sum(1, dtype=np.int64) == n[rows]
            for some, own in ((bytes_, counts), (~bytes_, counts.view(np.uint32))):
                if some.any():
                    parts.setdefault(own.shape[1], []).append((rows[some], own[some]))
        for w, found in parts.items():
            rows = np.concatenate([r for r, _ in found])
            self.width[rows], self.at[rows] = w, np.arange(len(rows))
            self.tables[w] = np.concatenate([c for _, c in found])

    def folded(self, rows: np.ndarray, width: int) -> np.ndarray:
        """The sketches of rows of one width, folded to ``width`` pieces (low bits again)."""
        counts = self.tables[int(self.width[rows[0]])][self.at[rows]]
        return counts if counts.shape[1] == width else counts.reshape(len(rows), -1, width).sum(1, dtype=np.int32)

    def likely(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs (i, j) have sizes and sketches that allow a link."""
        need = self.rule.overlap(self.n[i], self.n[j])
        out = need <= np.minimum(self.n[i], self.n[j])
        for a in self.tables:
            for b in self.tables:
                at = np.flatnonzero(out & (self.width[i] == a) & (self.width[j] == b))
                step = max(1, (1 << 22) // max(a, b))
                for k in range(0, len(at), step):
                    part = at[k : k + step]
                    both = [self.folded(x[part], min(a, b)) for x in (i, j)]
                    out[part] = np.minimum(*both).sum(1, dtype=np.int32) >= need[part]
        return out


_TILE = "tile long, split int, keys array<long>, ns array<int>"


def leader_tiles(members: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """Tiles of a leader and the classes that share most buckets with it, if their sketches allow a link.  A leader with many
    followers heads several tiles."""
    met = members.where("lead <> key").groupBy("lead", "key").agg(F.sum("often").alias("often"))
    pairs = met.groupBy("key").agg(F.max_by("lead", F.struct("often", "lead")).alias("lead"))
    side = lambda p, key: classes.select(F.col("key").alias(key), F.col("n").alias(f"n_{p}"), F.col("counts").alias(f"counts_{p}"))

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if m:
                n = np.r_[column(batch, "n_a").to_numpy(), column(batch, "n_b").to_numpy()].astype(np.int64)
                both = Sketches(rule, n, column(batch, "counts_a").to_pylist() + column(batch, "counts_b").to_pylist())
                fits = pa.array(both.likely(np.arange(m), np.arange(m, 2 * m)))
                yield pa.RecordBatch.from_arrays([column(batch, c).filter(fits) for c in ("lead", "n_a", "key", "n_b")], ["lead", "n_a", "key", "n_b"])

    near = cut(pairs.join(side("a", "lead"), "lead").join(side("b", "key"), "key").mapInArrow(run, "lead long, n_a int, key long, n_b int"))
    salts = near.groupBy("lead").agg(F.ceil(F.greatest(F.count("*") / (TILE * 0.8), F.sum("n_b") / TILE_ELEMENTS)).cast("int").alias("salts"))
    dealt = near.join(salts, "lead").groupBy("lead", F.pmod(F.xxhash64("key"), F.col("salts")).alias("salt"))
    found = dealt.agg(F.first("n_a").alias("n_a"), F.collect_list(F.struct("key", "n_b")).alias("rest"))
    return found.select(
        F.xxhash64("lead", "salt").alias("tile"),
        F.lit(0).alias("split"),
        F.concat(F.array("lead"), F.col("rest.key")).alias("keys"),
        F.concat(F.array("n_a"), F.col("rest.n_b")).alias("ns"),
    )


def cells(members: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """(cell, bucket, side, cross, key, comp): members of the buckets that hold more than one component, dealt into cells of
    about two ``block`` rows at most.  A component of ``block`` members or more has blocks of its own, the others of a bucket
    share theirs; each two blocks that can hold different components meet in one cell, as side 0 and 1.  So a large
    component meets the others once, in any number of tasks, and is never compared with itself.  Buckets are
    renumbered, those with many members first."""
    placed = cut(members.select("bucket", "key").join(labels, "key"))
    per = placed.groupBy("bucket", "comp").agg(F.count("*").alias("c"))
    large = F.col("c") >= block
    dealt = lambda n: F.ceil(n / block).cast("int")
    several = (
        per.groupBy("bucket")
        .agg(
            F.min("comp").alias("low"),
            F.max("comp").alias("high"),
            F.sum("c").alias("size"),
            F.collect_list(F.when(large, F.struct(F.lit(True).alias("own"), F.col("comp").alias("of"), dealt(F.col("c")).alias("blocks")))).alias("groups"),
            F.sum(F.when(~large, F.col("c"))).alias("rest"),
        )
        .where("low < high")
    )
    rest = F.when(F.col("rest").isNull(), F.array().cast("array<struct<own:boolean,of:bigint,blocks:int>>")).otherwise(
        F.array(F.struct(F.lit(False).alias("own"), F.lit(0).cast("long").alias("of"), dealt(F.col("rest")).alias("blocks")))
    )
    rank = F.shiftleft(F.lit(62).cast("long") - F.floor(F.log2("size")), 57).bitwiseOR(F.col("bucket").bitwiseAND(F.lit((1 << 57) - 1)))
    groups = several.select("bucket", rank.alias("rank"), F.concat("groups", rest).alias("groups"))
    joined = placed.join(groups, "bucket")
    found = F.filter("groups", lambda g: g["own"] & (g["of"] == F.col("comp")))
    own = F.coalesce(F.get(found, F.lit(0)), F.get(F.filter("groups", lambda g: ~g["own"]), F.lit(0)))
    joined = joined.withColumn("group", own)
    block_id = lambda g, i: F.xxhash64(g["own"], g["of"], i)
    others = F.filter("groups", lambda g: ~g["own"] | (g["own"] != F.col("group.own")) | (g["of"] != F.col("group.of")))
    met = F.flatten(F.transform(others, lambda g: F.transform(F.sequence(F.lit(0), g["blocks"] - 1), lambda i: block_id(g, i))))
    at = block_id(F.col("group"), F.pmod(F.xxhash64("key"), F.col("group.blocks")).cast("int"))
    joined = joined.select("bucket", "rank", "key", "comp", at.alias("at"), F.explode(met).alias("other"))
    cell = F.xxhash64("bucket", F.least("at", "other"), F.greatest("at", "other"))
    return joined.select(
        cell.alias("cell"), F.col("rank").alias("bucket"), F.when(F.col("at") > F.col("other"), 1).otherwise(0).alias("side"), (F.col("at") != F.col("other")).alias("cross"), "key", "comp"
    )


EARLY = 8


def bucket_tiles(members: DataFrame, classes: DataFrame, labels: DataFrame, rule: Rule, near: int = 48, block: int = 1024) -> DataFrame:
    """Tiles that hold every pair of members of one bucket in different components whose sketches allow a link.
    members: bucket, key.  All such pairs are looked at, in arrays of two ``block`` rows or so: first at folded sketches, then, where
    these allow a link, at whole ones.

    Two classes that share several buckets have their whole sketches looked at in the first of them: each class carries its EARLY
    largest buckets of those in which it has a partner, and a pair that has one before this in common was there.  (A pair whose common buckets come later in
    its lists may be looked at again, which costs time but changes nothing.)"""
    dealt = cut(possible(cells(members, labels, block), classes, rule, near))
    early = dealt.groupBy("key").agg(F.slice(F.sort_array(F.collect_set("bucket")), 1, EARLY).alias("early"))
    rows = dealt.join(early, "key").join(classes.select("key", "n", "counts"), "key")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "side", "key")

    def run(batches):
        for part in _whole(batches, "cell"):
            if not part.num_rows:
                continue
            batch = _Sketched(part, rule)
            pairs = batch.near_pairs(near)
            used = np.unique(np.concatenate([x for p in pairs for x in p])) if pairs else np.zeros(0, np.int64)
            tiles = [(int(batch.cell[g[0]]), 0, g) for g in np.split(used, np.flatnonzero(np.diff(batch.cell[used])) + 1) if len(g)]
            tiles = [t for tile, _, g in tiles for t in _split(batch, tile, g, g)]
            for s, i, j in batch.crowded_pairs(near):
                if batch.cross[s]:
                    tiles += _split(batch, int(batch.cell[s]), np.unique(i), np.unique(j), list(zip(i, j, strict=True)) if len(i) < 1000 else None)
                else:
                    both = np.unique(np.r_[i, j])
                    tiles += _split(batch, int(batch.cell[s]), both, both)
            yield _tile_rows(batch, tiles)

    return rows.mapInArrow(run, _TILE)


_CELL = "cell long, bucket long, side int, cross boolean, key long, comp long"


def possible(dealt: DataFrame, classes: DataFrame, rule: Rule, near: int = 48) -> DataFrame:
    """The rows of ``cells`` that have a partner in their cell by a first look at folded sketches.  Whole sketches then travel for these rows
    alone, not for every member of every bucket.  Folding only raises the bound of a pair, so no link is lost."""
    rows = dealt.join(folded(classes, rule), "key").select(*(c.split()[0] for c in _CELL.split(", ")), "n", "few")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "side", "key")

    def run(batches):
        for part in _whole(batches, "cell"):
            if part.num_rows:
                batch, found = _Folded(part, rule), np.zeros(part.num_rows, bool)
                for i, j in batch.near_pairs(near):
                    found[i] = found[j] = True
                for _, i, j in batch.crowded_pairs(near):
                    found[i] = found[j] = True
                yield part.drop_columns(["n", "few"]).filter(pa.array(found))

    return rows.mapInArrow(run, _CELL)


def widths(rule: Rule, n: np.ndarray) -> np.ndarray:
    """How many pieces the sketch of a set of n n-grams has: the fewest (a power of two) that tell unlike sets apart.  With m n-grams
    a piece, the bound of two random sets falls short of their size by 0.566 / sqrt(m), with a deviation of 0.424 / sqrt(m * pieces);
    it is to lie 3.3 deviations below the least overlap."""
    short = max(1e-3, float((1 - rule.least) / (1 + rule.least)))
    choices = 1 << np.arange(4, 25)
    most = choices * ((0.566 - 1.4 / np.sqrt(choices)) / short) ** 2
    return choices[np.minimum(np.searchsorted(most, n), len(choices) - 1)]


def folded(classes: DataFrame, rule: Rule) -> DataFrame:
    """(key, n, few): the sketches of the classes, folded to ``widths`` pieces."""

    def run(batches):
        for batch in slices(batches, 4096):
            n = column(batch, "n").to_numpy().astype(np.int64)
            own, few = Sketches(rule, n, column(batch, "counts").to_pylist()), [b""] * len(n)
            width = np.minimum(widths(rule, n), own.width)
            for w, whole in np.unique(np.c_[width, own.width], axis=0).tolist():
                at = np.flatnonzero((width == w) & (own.width == whole))
                for i, c in zip(at.tolist(), own.folded(at, w), strict=True):
                    few[i] = packed(c)
            yield pa.RecordBatch.from_arrays([column(batch, "key"), column(batch, "n"), pa.array(few, pa.binary())], ["key", "n", "few"])

    return classes.select("key", "n", "counts").mapInArrow(run, "key long, n int, few binary")


class _Cells:
    """The columns of a batch of whole cells, and the pairs of a cell that ``fits`` lets pass."""

    def __init__(self, batch, rule):
        self.take, self.rule = lambda c: column(batch, c).to_numpy(zero_copy_only=False), rule
        self.cell, self.bucket, self.side, self.cross, self.key, self.comp = map(self.take, ("cell", "bucket", "side", "cross", "key", "comp"))
        self.n = self.take("n").astype(np.int64)
        self.start = np.flatnonzero(np.r_[True, self.cell[1:] != self.cell[:-1]])
        self.size = np.diff(np.r_[self.start, len(self.cell)])

    def kept(self, i, j):
        far = self.comp[i] != self.comp[j]
        i, j = i[far], j[far]
        fits = self.fits(i, j)
        return i[fits], j[fits]

    def near_pairs(self, near: int) -> list:
        """Kept pairs of the cells of ``near`` rows at most, one distance of two rows at a time."""
        small = np.repeat(self.size <= near, self.size)
        at, end = np.arange(len(small)), np.repeat(self.start + self.size, self.size)
        return [self.kept(i, i + d) for d in range(1, min(near, int(self.size.max()))) for i in [at[small & (at + d < end)]] if len(i)]

    def crowded_pairs(self, near: int):
        """The first row of each larger cell and the cell's kept pairs."""
        for s, k in zip(self.start[self.size > near].tolist(), self.size[self.size > near].tolist(), strict=True):
            half = s + int((self.side[s : s + k] == 0).sum()) if self.cross[s] else s
            yield s, *self.all_pairs((s, half if self.cross[s] else s + k), (half, s + k))

    def all_pairs(self, a, b):
        """Kept pairs of two ranges of rows, or of one range with itself, a few rows at a time."""
        out, step = [], max(1, (1 << 16) // max(1, b[1] - b[0]))
        for s in range(a[0], a[1], step):
            i, j = np.meshgrid(np.arange(s, min(a[1], s + step)), np.arange(*b), indexing="ij")
            i, j = i.ravel(), j.ravel()
            if a == b:
                i, j = i[i < j], j[i < j]
            out.append(self.kept(i, j))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2


class _Folded(_Cells):
    """With folded sketches."""

    def __init__(self, batch, rule):
        super().__init__(batch, rule)
        self.fits = Sketches(rule, self.n, column(batch, "few").to_pylist()).likely


class _Sketched(_Cells):
    """With whole sketches; pairs that met in an earlier bucket are left out."""

    def __init__(self, batch, rule):
        super().__init__(batch, rule)
        self.sketches = Sketches(rule, self.n, column(batch, "counts").to_pylist())
        lists = column(batch, "early")
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        self.early = np.full((len(lengths), EARLY), np.iinfo(np.int64).max)
        row = np.repeat(np.arange(len(lengths)), lengths)
        self.early[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = lists.flatten().to_numpy()

    def fits(self, i, j):
        out = ~self.met_before(i, j)
        at = np.flatnonzero(out)
        out[at] = self.sketches.likely(i[at], j[at])
        return out

    def met_before(self, i, j):
        now = self.bucket[i]
        out = (self.early[i, 0] == self.early[j, 0]) & (self.early[i, 0] < now)
        left = np.flatnonzero(~out & (np.maximum(self.early[i, 0], self.early[j, 0]) < now))
        for k in range(0, len(left), 1 << 14):
            part = left[k : k + (1 << 14)]
            x, y = self.early[i[part]], self.early[j[part]]
            out[part] = ((x[:, :, None] == y[:, None, :]) & (x < now[part, None])[:, :, None]).any((1, 2))
        return out


def _split(batch, tile: int, a: np.ndarray, b: np.ndarray, pairs: list | None = None) -> list:
    """(tile, split, rows) for the rows ``a`` against ``b``, or among themselves if both are the same: parts of at most TILE rows
    and TILE_ELEMENTS n-grams or so on each side.  With ``pairs``, parts that hold none of them are left out."""
    if not len(a) or not len(b):
        return []
    width = max(1, min(TILE, TILE_ELEMENTS // max(1, int(max(batch.n[a].max(), batch.n[b].max())))))
    same, out = a is b, []
    a, b = ([x[k : k + width] for k in range(0, len(x), width)] for x in (a, b))
    wanted = None if pairs is None else {(next(x for x, g in enumerate(a) if g[0] <= i <= g[-1]), next(y for y, g in enumerate(b) if g[0] <= j <= g[-1])) for i, j in pairs}
    for x, g in enumerate(a):
        for y, h in enumerate(b):
            if same and y < x or wanted is not None and (x, y) not in wanted:
                continue
            alone = same and x == y
            out.append((tile + 0x9E3779B97F4A7C15 * (x * len(b) + y), 0 if alone else len(g), g if alone else np.r_[g, h]))
    return out


def _tile_rows(batch, tiles):
    ids = np.array([t & ((1 << 64) - 1) for t, _, _ in tiles], np.uint64).view(np.int64)
    rows = np.concatenate([g for _, _, g in tiles]) if tiles else np.zeros(0, np.int64)
    offsets = pa.array(np.cumsum([0, *(len(g) for _, _, g in tiles)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (batch.key[rows], batch.n[rows].astype(np.int32))]
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([s for _, s, _ in tiles], pa.int32()), *lists], ["tile", "split", "keys", "ns"])


def _whole(batches, by: str):
    """Batches cut at the borders of ``by``, so that no group lies in two.  Groups are of bounded size."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = column(batch, by).to_numpy()
        if held and column(held[-1], by)[-1].as_py() == key[0] and key[0] == key[-1]:
            held.append(batch)
            continue
        change = np.flatnonzero(key[1:] != key[:-1]) + 1
        first = 0 if held and column(held[-1], by)[-1].as_py() != key[0] else int(change[0]) if held else 0
        last = int(change[-1]) if len(change) else 0
        ready = [*held, batch.slice(0, max(first, last))] if held or last else []
        if sum(b.num_rows for b in ready):
            yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0]
        held = [batch.slice(max(first, last))]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def cut_sets(tiles: DataFrame, docs: DataFrame, classes: DataFrame, rule: Rule, order: Order) -> DataFrame:
    """(tile, split, m, piece, pos, grams): the fragments of the sets of all members of the tiles.  Only documents that some tile
    needs are cut: a bitmap of fixed size keeps the others at home (what it lets through in error, the join drops)."""
    wanted = tiles.select("tile", "split", F.size("keys").alias("m"), F.posexplode("keys").alias("pos", "key")).join(classes.select("key", "doc_id"), "key")
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(BITS)).cast("int").alias("spot")
    spark = docs.sparkSession
    bitmap, shared = spark.sparkContext.broadcast(bitmap_of(wanted.select(spot), BITS)), spark.sparkContext.broadcast(order)

    def cut_up(batches):
        keep = np.unpackbits(bitmap.value).view(bool)
        for batch in batches:
            for part in slices([batch.filter(pa.array(keep[column(batch, "spot").to_numpy()]))]):
                sets = [shingles(t, rule.words) for t in texts_of(part)]
                pieces = [shared.value.fragments(s) for s in sets]
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), pa.array([set_key(s) for s in sets], pa.int64()), pa.array(pieces, pa.list_(pa.binary()))], ["doc_id", "key", "pieces"])

    found = docs.select("doc_id", "text", spot).mapInArrow(cut_up, "doc_id long, key long, pieces array<binary>")
    # a merge join at every size: what travels then grows with the input, and no size turns it into another plan
    met = found.join(wanted.hint("merge"), ["doc_id", "key"])
    return met.select("tile", "split", "m", "pos", F.posexplode("pieces").alias("piece", "grams")).where(F.length("grams") > 0)


def partial_overlaps(fragments: DataFrame) -> DataFrame:
    """(tile, piece, counts): how many n-grams of one fragment the pairs of a tile share, as an array over its pairs."""
    dealt = fragments.repartition("tile", "piece").sortWithinPartitions("tile", "piece", "pos")

    def groups(batches):
        now, held = None, []
        for batch in batches:
            for tile, piece, split, m, pos, grams in zip(*(column(batch, c).to_pylist() for c in ("tile", "piece", "split", "m", "pos", "grams")), strict=True):
                if (tile, piece) != now:
                    if len(held) > 1:
                        yield (*now, *shape, held)
                    now, shape, held = (tile, piece), (split, m), []
                if not held or held[-1][0] != pos:  # the same document may be there twice
                    held.append((pos, grams))
        if len(held) > 1:
            yield (*now, *shape, held)

    def run(batches):
        out, size = ([], [], []), 0
        for tile, piece, split, m, held in groups(batches):
            counts = fragment_counts(held, split, m)
            if counts is None:
                continue
            for o, v in zip(out, (tile, piece, counts.astype("<i4").tobytes()), strict=True):
                o.append(v)
            size += counts.nbytes
            if size > 1 << 24:
                yield _partial(out)
                out, size = ([], [], []), 0
        yield _partial(out)

    return dealt.mapInArrow(run, "tile long, piece int, counts binary")


def _partial(out):
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], ["tile", "piece", "counts"])


def fragment_counts(held: list[tuple[int, bytes]], split: int, m: int, columns: int = 4096) -> np.ndarray | None:
    """Partial overlaps of the first ``split`` members with the others, or of all with all (split 0), by products of incidence
    matrices over ``columns`` n-grams at a time; None if nothing is shared."""
    grams = np.frombuffer(b"".join(g for _, g in held), np.uint64)
    row = np.repeat([p for p, _ in held], [len(g) // 8 for _, g in held])
    order = np.argsort(grams)
    grams, row = grams[order], row[order]
    again = grams[1:] == grams[:-1]
    keep = np.r_[again, False] | np.r_[False, again]
    if not keep.any():
        return None
    place = (np.cumsum(np.r_[True, ~again]) - 1)[keep]
    place, row = np.cumsum(np.r_[0, place[1:] != place[:-1]]), row[keep]
    out, n = 0, int(place[-1]) + 1
    for c in range(0, n, columns):
        part = slice(*np.searchsorted(place, (c, c + columns)))
        there = np.zeros((m, min(columns, n - c)), np.float32)
        there[row[part], place[part] - c] = 1
        out = out + (there[:split] @ there[split:].T if split else there @ there.T)
    return out


def summed_links(partial: DataFrame, tiles: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): a spanning forest of the links in each tile.  The partial overlaps of a tile's fragments are added up, pair by pair,
    and the sums are held against the least overlap that the sizes of a pair ask for."""
    meta = tiles.select("tile", F.lit(-1).alias("piece"), F.lit(None).cast("binary").alias("counts"), "split", "keys", "ns")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("split", "int"), ("keys", "array<long>"), ("ns", "array<int>"))]
    rows = meta.unionByName(partial.select("tile", "piece", "counts", *nothing)).repartition("tile").sortWithinPartitions("tile", "piece")

    def forest(split, keys, ns, total):
        n, k = np.array(ns, np.int64), np.array(keys, np.int64)
        a, b = (slice(0, split), slice(split, None)) if split else (slice(None), slice(None))
        linked = total.reshape(len(n[a]), len(n[b])) >= rule.overlap(n[a][:, None], n[b][None, :])
        if not split:
            np.fill_diagonal(linked, False)
        for i, j in spanning(linked, split):
            yield int(k[i]), int(k[j])

    def run(batches):
        now, total, out = None, None, []
        for batch in batches:
            for tile, counts, split, keys, ns in zip(*(column(batch, c).to_pylist() for c in ("tile", "counts", "split", "keys", "ns")), strict=True):
                if keys is not None:
                    if total is not None:
                        out += forest(*now[1:], total)
                    now, total = (tile, split, keys, ns), None
                else:
                    assert tile == now[0]
                    part = np.frombuffer(counts, "<i4")
                    total = part.astype(np.int64) if total is None else total + part
            yield _edges(out)
            out = []
        yield _edges([*forest(*now[1:], total)] if total is not None else [])

    return rows.mapInArrow(run, "a long, b long")


def _edges(pairs):
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def spanning(linked: np.ndarray, split: int) -> list[tuple[int, int]]:
    """Edges (positions) of a forest with the same components as the links; with ``split`` rows are the first members and
    columns the others."""
    if not linked.any():
        return []
    m = linked.shape[0] + (linked.shape[1] if split else 0)
    full = linked
    if split:
        full = np.zeros((m, m), bool)
        full[:split, split:] = linked
    full = full | full.T
    new, out = np.ones(m, bool), []
    for root in range(m):
        if not new[root] or not full[root].any():
            continue
        new[root], queue = False, [root]
        while queue:
            i = queue.pop()
            found = np.flatnonzero(full[i] & new)
            new[found] = False
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
    return out


def links(tiles: DataFrame, docs: DataFrame, classes: DataFrame, rule: Rule, order: Order) -> DataFrame:
    """(a, b): links of the tiles' classes, as far as components need them."""
    return summed_links(partial_overlaps(cut_sets(tiles, docs, classes, rule, order)), tiles, rule)


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, comp) for the keys of ``nodes`` (key, comp: labels to start from): the least label in the component.
    Every round takes the least label of the neighbours and then the label of that label; the
    number of rounds grows with the logarithm of the longest path in practice."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(nodes.select("key", "comp"))
    if both.isEmpty():
        return labels
    while True:
        near = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        new = labels.join(near.withColumnRenamed("a", "key"), "key", "left").select("key", "comp", F.least("comp", F.coalesce("near", "comp")).alias("new"))
        # a label that has moved takes along all that carried it
        hooks = new.where("new < comp").groupBy("comp").agg(F.min("new").alias("hook"))
        moved = new.join(hooks, "comp", "left").select("key", F.least("new", F.coalesce("hook", "new")).alias("comp"), (F.least("new", F.coalesce("hook", "new")) < F.col("comp")).alias("changed"))
        moved = cut(moved)
        labels = moved.select("key", "comp")
        if moved.where("changed").isEmpty():
            return labels


def grouped(docs: DataFrame, words: int = 5, least: Fraction | str = "4/5", leaders: bool = True) -> DataFrame:
    """(doc_id, text_id, n, first_id, first_text) for every row of doc_id, text_id and text: the size of its set, and the least
    (doc_id, text_id) of its component.  Rows without n-grams or id have no first."""
    rule = Rule(words, Fraction(least))
    described = cut(describe(docs, words, rule))
    rows = described.where("kind = 0").select("doc_id", "text_id", "key", "n", "counts")
    place = F.struct("doc_id", "text_id")
    classes = cut(rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min(place).alias("place"), F.first("n").alias("n"), F.first("counts").alias("counts")))
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    order = global_order(described)
    members = cut(shared_grams(prefixes(known, rule, order), rule))
    labels = members.select("key").distinct().select("key", F.col("key").alias("comp"))
    if leaders:
        labels = components(cut(links(cut(leader_tiles(members, classes, rule)), known, classes, rule, order)), labels)
    more = cut(bucket_tiles(members, classes, labels, rule))
    if not more.isEmpty():
        labels = components(cut(links(more, known, classes, rule, order)), labels)
    comp = classes.select("key", "place").join(labels, "key", "left").select("key", "place", F.coalesce("comp", "key").alias("comp"))
    first = comp.groupBy("comp").agg(F.min("place").alias("first"))
    comp = comp.join(first, "comp").select("key", "first")
    own = F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("first"))
    return rows.join(comp, "key", "left").select("doc_id", "text_id", "n", own["doc_id"].alias("first_id"), own["text_id"].alias("first_text"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")


def cluster(docs: DataFrame, words: int = 5, least: Fraction | str = "4/5", **options) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: the size of its set of distinct word n-grams (A-Z lower-cased, words
    are runs without ASCII white space, whole texts) and the smallest doc_id reachable by links, itself included.
    Documents are linked if their sets' Jaccard similarity is at least ``least``.

    A text with fewer words than n is one n-gram.  Null, empty and blank texts have no n-gram and are linked with
    nothing.  Equal sets are linked.  Null ids are left out of the links: n_shingles is given and component_id is null.
    Different texts with one id are documents of their own that share the id.  Only
    doc_id and text are read.  Sets and n-grams are compared by 64-bit hashes.
    """
    out = grouped(_keyed(docs), words, least, **options)
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("first_id", "doc_id").alias("component_id"))


def keep_first(docs: DataFrame, words: int = 5, least: Fraction | str = "4/5", **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their component: the smallest doc_id, and of its texts the
    one with the least hash.  Of rows equal in doc_id and text one stays.  Rows with a null id and texts without words stay."""
    groups = cut(grouped(_keyed(docs), words, least, **options).where("first_id IS NOT NULL").drop("n"))
    same = (F.col("doc_id") == F.col("first_id")) & (F.col("text_id") == F.col("first_text"))
    late = groups.where(~same).select(F.col("doc_id").alias("late_id"), F.col("text_id").alias("late_text")).distinct()
    at = lambda ids, i, t: (docs["doc_id"].cast("long") == ids[i]) & (F.xxhash64(docs["text"]) == ids[t])
    left = docs.join(late, at(late, "late_id", "late_text"), "left_anti")
    twice = groups.where(same).groupBy("doc_id", "text_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("twice_id"), F.col("text_id").alias("twice_text"))
    if twice.isEmpty():
        return left
    again = at(twice, "twice_id", "twice_text")
    return left.join(twice, again, "left_anti").unionByName(left.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))


#: DuckDB SQL for ``cluster`` with three words and 9/10.
SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
  FROM words
), flat AS (
  SELECT doc_id, unnest(g) AS gram FROM grams
), sizes AS (
  SELECT doc_id, len(g)::BIGINT AS n FROM grams
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM flat x JOIN flat y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2
), edges AS (
  SELECT a, b FROM common JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * o >= 90 * (sa.n + sb.n - o)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION
  SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b
)
SELECT sizes.doc_id, n AS n_shingles, min(reach.b) AS component_id FROM sizes JOIN reach ON reach.a = sizes.doc_id GROUP BY 1, 2
"""
