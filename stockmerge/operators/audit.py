"""Hash-linked audit chains."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

FIELDS = ["user_id", "action", "entity_type", "entity_id", "ts_text", "old_value", "new_value"]


def with_text(events: DataFrame) -> DataFrame:
    """The one text form of a time that goes into hashes: seconds and six digits, always."""
    return events.withColumn("ts_text", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


def payload(prev: Column, legacy: bool = False) -> Column:
    names = [c for c in FIELDS if not (legacy and c == "old_value")]
    return F.concat_ws("|", prev, *[F.coalesce(F.col(c).cast("string"), F.lit("0" if c.endswith("_id") else "")) for c in names])


def append(events: DataFrame, legacy: bool = False) -> DataFrame:
    """events(chain, audit_id, ...) with prev_hash and row_hash.  A hash needs the one before it, so a chain is sequential by nature:
    it is walked in order of id within one task, batch by batch with only the last hash in memory; chains run side by side."""
    rows = with_text(events).where(F.col("entity_type").isin(C.AUDIT_ENTITIES)).withColumn("body", F.substring(payload(F.lit(""), legacy), 2, 1 << 30))
    shape = rows.drop("body").schema.add("prev_hash", "string").add("row_hash", "string")

    def link(batches):
        chain, prev = None, C.GENESIS
        for batch in batches:
            before, own = [], []
            for c, body in zip(batch.column("chain").to_pylist(), batch.column("body").to_pylist(), strict=True):
                if c != chain:
                    chain, prev = c, C.GENESIS
                before.append(prev)
                prev = hashlib.sha256(f"{prev}|{body}".encode()).hexdigest().upper()
                own.append(prev)
            kept = [name for name in batch.schema.names if name != "body"]
            yield pa.RecordBatch.from_arrays([*[batch.column(name) for name in kept], pa.array(before, pa.string()), pa.array(own, pa.string())], [*kept, "prev_hash", "row_hash"])

    return rows.repartition("chain").sortWithinPartitions("chain", "audit_id").mapInArrow(link, shape)


def verify(rows: DataFrame, legacy: bool = False, ranges: int = 1024) -> DataFrame:
    """(chain, checked, first_broken, reason, head): a link that does not continue is found before changed content.

    A chain is checked in ranges of audit_id between quantiles, so a long one is the work of many tasks: contents by themselves, links
    inside each range, and the first link of a range by the last hash of the one before it, one row for each range."""
    edges = rows.approxQuantile("audit_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []  # at most ranges numbers
    cuts = [-float("inf"), *sorted(set(edges)), float("inf")]
    keyed = rows.withColumn("_id", F.col("audit_id").cast("double"))
    cut = Bucketizer(splits=cuts, inputCol="_id", outputCol="_part", handleInvalid="keep").transform(keyed) if len(cuts) > 2 else keyed.withColumn("_part", F.lit(0.0))
    w = Window.partitionBy("chain", "_part").orderBy("audit_id")
    own = F.upper(F.sha2(payload(F.col("prev_hash"), legacy), 256))
    t = cut.drop("_id").withColumns({"_n": F.row_number().over(w), "_lag": F.lag("row_hash").over(w), "own": own})
    ends = t.groupBy("chain", "_part").agg(F.max_by("row_hash", "audit_id").alias("_end"))
    before = ends.select(F.col("chain").alias("_chain"), F.col("_part").alias("_p"), F.lag("_end", 1, C.GENESIS).over(Window.partitionBy("chain").orderBy("_part")).alias("_before"))
    t = t.join(before, F.col("chain").eqNullSafe(F.col("_chain")) & (F.col("_part") == F.col("_p")))
    link = F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag"))
    t = t.withColumn("reason", F.when(~F.col("prev_hash").eqNullSafe(link), "broken link").when(~F.col("own").eqNullSafe(F.col("row_hash")), "changed content"))
    bad = F.when(F.col("reason").isNotNull(), F.struct("audit_id", "reason"))
    out = t.groupBy("chain").agg(F.count("*").alias("checked"), F.min(bad).alias("bad"), F.max_by("row_hash", "audit_id").alias("head"))
    return out.select("chain", "checked", F.col("bad.audit_id").alias("first_broken"), F.col("bad.reason").alias("reason"), "head")
