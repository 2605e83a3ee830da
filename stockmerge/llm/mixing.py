"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

A source with weight w owns blocks 1, 2, ...; block j is released at slot floor((j-1)/w) and due by slot
ceil(j/w).  Earliest deadline first meets every deadline when the weights sum to 1, so after any number of slots each
source is less than one block away from its target.  ``run`` does so over the whole mix with the exact (rational)
weights, whatever their sizes: nothing is rounded to a period.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import isqrt, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 8


def run(weights: dict[str, float], blocks: dict[str, int]) -> Iterator[tuple[str, int, int, bool]]:
    """(source, block, slot, on target) of the whole mix in order of slots; earliest deadline first, equal deadlines by name.

    As long as no source has run out, each has less than one block of deviation from slot * weight / sum of weights.  From the
    slot that a source without blocks would get, the others go on with their weights among themselves.  Sources of
    weight 0 come last.  It holds one entry for each source, whatever the number of blocks."""
    exact = {s: Fraction(weights[s]) for s in blocks}
    if min(exact.values(), default=0) < 0:
        raise ValueError("a weight is negative")
    done, slot, on_target = dict.fromkeys(blocks, 0), 0, True
    while left := [s for s in blocks if done[s] < blocks[s]]:
        live = {s: exact[s] for s in left if exact[s]} or dict.fromkeys(left, Fraction(1))
        scale = lcm(*(w.denominator for w in live.values()))
        part = {s: int(w * scale) for s, w in live.items()}
        total, start, first = sum(part.values()), slot, {s: done[s] for s in live}
        later = [(0, s) for s in sorted(live)]
        ready: list[tuple[int, str]] = []
        while True:
            while later and later[0][0] <= slot - start:
                _, s = heapq.heappop(later)
                heapq.heappush(ready, (-(-(done[s] - first[s] + 1) * total // part[s]), s))
            due, s = heapq.heappop(ready)
            if done[s] == blocks[s]:
                break
            assert slot - start < due
            yield s, done[s], slot, on_target
            done[s] += 1
            slot += 1
            heapq.heappush(later, ((done[s] - first[s]) * total // part[s], s))
        on_target = False


def _run_rows(weights: dict[str, float], blocks: dict[str, int], size: int = 1 << 14):
    """``run`` as a function for mapInArrow."""

    def rows(batches):
        for _ in batches:
            pass
        kept: list[tuple[str, int, int, bool]] = []
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept, strict=True), types, strict=True)], ["source", "block", "slot", "on"])
        for row in run(weights, blocks):
            kept.append(row)
            if len(kept) == size:
                yield batch()
                kept.clear()
        if kept:
            yield batch()

    return rows


MIX = ["mix_block", "mix_slot", "mix_rank", "on_target"]


def interleave(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """``docs`` with mix_block (block of its source), mix_slot (place of the block in the mix), mix_rank (place in
    the block) and on_target (no source had run out before this slot, so the target weights hold up to here).

    Every row gets exactly one place; nothing is dropped or repeated.  A source's rows are in the order of the MD5 of
    doc_id.  Without ``weights`` a source weighs the square root of its row count (in thousandths).  A source absent from
    ``weights`` weighs as little as the least one.  A null source is the source ''.  Rows with equal ids get places of their own, in any
    order among them; rows with null ids stand in the order of a hash of all their columns.  An empty table gives an empty result.
    Other columns pass, whatever their names; those named as the four results are replaced.

    Before any source runs out each is less than one block from its target; then the others go on among themselves.

    Ranks within a source come from counts of 4096 hash ranges, so no task holds a whole source.  One task makes the slots, one
    row for each block, and holds one entry for each source, as the driver does; a range gets its own slots as an array.
    """
    names = [c for c in docs.columns if c not in MIX]
    everything = F.struct(*[F.col(f"`{c}`") for c in names])
    own = F.coalesce(F.col("doc_id").cast("string"), F.xxhash64(everything).cast("string"))
    rows = docs.select(everything.alias("rest"), F.coalesce("source", F.lit("")).alias("source"), "doc_id", F.md5(own).alias("hash")).withColumn("range", F.substring("hash", 1, 3))
    counts = rows.groupBy("source", "range").agg(F.count("*").alias("n"))
    sizes = {r[0]: r[1] for r in counts.groupBy("source").agg(F.sum("n")).toLocalIterator()}
    if weights is None:
        weights = {s: isqrt(n * 1_000_000) for s, n in sizes.items()}
    least = min(weights.values(), default=1)
    weights = {s: weights.get(s, least) for s in sizes}
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most 4096 rows
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = _placed(rows, offsets, sizes, weights, block)
    return placed.select(*[F.col(f"rest.`{c}`").alias(c) for c in names], "mix_block", at_slot("slot").alias("mix_slot"), (F.col("rank") % block).alias("mix_rank"), at_slot("on").alias("on_target"))


def at_slot(field: str):
    return F.get("slots", (F.col("mix_block") - F.col("first")).cast("int"))[field]


def _placed(rows: DataFrame, offsets: DataFrame, sizes: dict[str, int], weights: dict[str, float], block: int) -> DataFrame:
    blocks = {s: -(-n // block) for s, n in sizes.items()}
    slots = rows.sparkSession.range(0, 1, 1, 1).mapInArrow(_run_rows(weights, blocks), "source string, block long, slot long, on boolean")
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("n") - 1) / block)
    spans = offsets.select("source", "range", "offset", first.alias("first"), F.explode(F.sequence(first, last)).alias("block"))
    own = spans.join(slots, ["source", "block"]).groupBy("source", "range").agg(
        F.first("offset").alias("offset"), F.first("first").alias("first"), F.array_sort(F.collect_list(F.struct("slot", "on"))).alias("slots")
    )  # a later block of a source has a later slot
    within = Window.partitionBy("source", "range").orderBy("hash", "doc_id")
    ranked = rows.withColumn("rn", F.row_number().over(within)).join(own, ["source", "range"]).withColumn("rank", F.col("offset") + F.col("rn") - 1)
    return ranked.withColumn("mix_block", F.floor(F.col("rank") / block))


#: DuckDB SQL for (doc_id, source, mix_block, mix_slot, mix_rank, on_target) with the default weights: earliest deadline
#: first, one step for each block, all in whole numbers.
SQL = """
WITH RECURSIVE sizes AS (
  SELECT coalesce(source, '') AS source, count(*) AS n FROM documents GROUP BY 1
), parts AS (
  SELECT source, (n + 7) // 8 AS blocks, floor(sqrt(n * 1000000.0))::BIGINT AS w, row_number() OVER (ORDER BY source) AS i FROM sizes
), lists AS (
  SELECT list(w ORDER BY i) AS w, list(blocks ORDER BY i) AS b, count(*) AS k FROM parts
), edf AS (
  SELECT 0::BIGINT AS slot, list_transform(w, lambda x: 0::BIGINT) AS done, list_transform(w, lambda x: 0::BIGINT) AS first, 0::BIGINT AS start, 0::BIGINT AS pick, true AS on_target
  FROM lists
  UNION ALL
  SELECT CASE WHEN out THEN slot ELSE slot + 1 END,
    CASE WHEN out THEN done ELSE list_transform(range(1, k + 1), lambda i: done[i] + CASE WHEN i = next THEN 1 ELSE 0 END) END,
    CASE WHEN out THEN done ELSE first END, CASE WHEN out THEN slot ELSE start END, CASE WHEN out THEN 0 ELSE next END, on_target AND NOT out
  FROM (
    SELECT *, done[next] = b[next] AS out FROM (
      SELECT *, list_min(list_transform(
          list_filter(range(1, k + 1), lambda i: first[i] < b[i] AND ((done[i] - first[i]) * total) // w[i] <= slot - start),
          lambda i: (((done[i] - first[i] + 1) * total + w[i] - 1) // w[i]) * 100000 + i)) % 100000 AS next
      FROM (
        SELECT edf.*, w, b, k, list_sum(list_transform(range(1, k + 1), lambda i: CASE WHEN first[i] < b[i] THEN w[i] ELSE 0 END))::BIGINT AS total
        FROM edf, lists WHERE slot < list_sum(b)
      )
    )
  )
), slots AS (
  SELECT pick AS i, done[pick] - 1 AS j, slot - 1 AS slot, on_target FROM edf WHERE pick > 0
), ranked AS (
  SELECT doc_id, documents.source, coalesce(documents.source, '') AS s,
    row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS rank
  FROM documents
)
SELECT doc_id, ranked.source, rank // 8 AS mix_block, slot AS mix_slot, rank % 8 AS mix_rank, on_target
FROM ranked JOIN parts ON parts.source = ranked.s JOIN slots ON slots.i = parts.i AND slots.j = rank // 8
"""

#: The same with one weight for every source.
SQL_EQUAL = SQL.replace("floor(sqrt(n * 1000000.0))::BIGINT AS w", "1::BIGINT AS w")
