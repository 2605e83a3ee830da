"""Document fingerprints from content-defined chunks, and their likeness by weighted containment."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_points, slices

_SPACE = re.compile(r"\s+")
FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def chunks_of(text: str, smallest: int = 32, bits: int = 6) -> dict[str, int]:
    """digest -> length in bytes for the distinct chunks of a text after lower-casing and collapsing white space.
    Chunk borders depend on the 32 bytes before them, so an insertion changes the chunks around it only."""
    data = _SPACE.sub(" ", text.lower()).strip().encode("utf-8", "replace")
    out, start = {}, 0
    for end in cut_points(np.frombuffer(data, np.uint8), smallest, bits).tolist():
        out[xxhash.xxh3_64_hexdigest(data[start:end])[:12]] = end - start
        start = end
    return out


def pack(chunks: dict[str, int]) -> str:
    """Sorted ``digest:length`` pairs; empty for a text without visible characters."""
    return ",".join(f"{d}:{n:x}" for d, n in sorted(chunks.items()))


def likeness(a: dict[str, int], b: dict[str, int]) -> float:
    """Mean of both containments, by bytes of shared chunks: 1 for equal fingerprints, 0 if nothing is shared.
    Two empty fingerprints are alike (1); an empty one and another are not (0)."""
    if not a or not b:
        return float(not a and not b)
    shared = sum(n for d, n in a.items() if d in b)
    return (shared / sum(a.values()) + shared / sum(b.values())) / 2


_REST = (1 << 20) - 1  # of the ids of a range those that are not split


def dealt_in_order(docs: DataFrame, per_bucket: int = 2000, most: int = 20_000) -> tuple[DataFrame, list]:
    """docs with ``u`` (31 bits of the text's hash) and a bucket; and [(bucket, its first doc_id, its first u or null)] in the order of
    fingerprints().  Buckets are ranges of ids after their quantiles, at most ``most`` of them.  An id that fills several ranges,
    and the null ids, are dealt over as many buckets by ranges of u; only then does this read more than the ids."""
    ids = docs.select("doc_id")
    rows, known = ids.agg(F.count("*"), F.count("doc_id")).first()
    ranges = lambda n: max(1, min(most, -(-n // per_bucket)))
    buckets, lost = ranges(known), ranges(rows - known)
    often = Counter(int(c) for c in ids.approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)) if buckets > 1 else Counter()
    edges = np.array(sorted(often), np.int64)
    parts = np.array([often[int(e)] for e in edges] + [1], np.int64)  # buckets for the id of an edge itself, if more than one
    split = bool((parts > 1).any()) or lost > 1

    @F.pandas_udf("long")
    def place(v: pd.Series, u: pd.Series) -> pd.Series:
        i = np.searchsorted(edges, v.to_numpy("int64"), "left")
        hot = (np.r_[edges, 0][i] == v.to_numpy("int64")) & (parts[i] > 1)
        return pd.Series((i << 20) + np.where(hot, u.to_numpy("int64") * parts[i] >> 31, _REST))

    def dealt(u):
        null = F.lit(-(1 << 20)) + F.shiftright(u * lost, 31)
        known = place(F.coalesce("doc_id", F.lit(0)), u) if len(edges) else F.lit(_REST).cast("long")
        return F.when(F.col("doc_id").isNull(), null).otherwise(known).cast("long")

    u = F.shiftrightunsigned(F.xxhash64("text"), 33)
    out = docs.withColumn("u", u).withColumn("bucket", dealt(F.col("u")))
    if split:
        first = out.groupBy("bucket").agg(F.max("doc_id"), F.min("u")).collect()  # a row for each bucket
    else:
        first = ids.select("doc_id", dealt(F.lit(0).cast("long")).alias("bucket")).groupBy("bucket").agg(F.max("doc_id"), F.lit(None)).collect()
    firsts = [(r[0], r[1], None if r[0] & _REST == _REST else r[2]) for r in first]
    return out, sorted(firsts, key=lambda r: (-(r[0] >> 20), r[0] & _REST))


def fingerprints(docs: DataFrame, **options) -> DataFrame:
    """For every row: its fingerprint, that of its edited text (the last half of its code points replaced by as many
    first ones of the next row in descending order of doc_id; the last row's next is the first), and likenesses.

    Null texts count as empty.  Null ids come after all others; equal ids are ordered by a hash of the text, then by text.  An
    empty table gives an empty result, and a single row is its own next.  Only doc_id and text are read.

    Each text is shuffled once: rows are dealt to ranges of that order, and the first row of a range goes to the
    preceding range too, so every task walks its ranges in order holding two rows at a time.  Rows that are equal in id
    and text are of one range.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt, firsts = dealt_in_order(docs, **options)
    spark = docs.sparkSession
    if not firsts:
        return spark.createDataFrame([], FIELDS)
    extra = [(b, top, u, firsts[i - 1][0]) for i, (b, top, u) in enumerate(firsts)]  # one for each bucket
    halo = F.broadcast(spark.createDataFrame(extra, "bucket long, top long, first long, before long"))
    own = F.struct("bucket", F.lit(False).alias("halo"))
    leads = F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("first").isNull() | (F.col("first") == F.col("u")))
    both = dealt.join(halo, "bucket").select(
        F.explode(F.when(leads, F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("halo")))).otherwise(F.array(own))).alias("at"),
        "doc_id",
        "u",
        "text",
    ).select("at.bucket", "at.halo", "doc_id", "u", "text")
    rows = both.repartition("bucket").sortWithinPartitions("bucket", "halo", F.col("doc_id").desc_nulls_last(), "u", "text").drop("u")

    def run(batches):
        at, last = None, None  # the bucket, and the row that waits for its next
        for batch in slices(batches, 256):
            out = []
            for bucket, is_halo, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at:
                    at, last = bucket, None
                elif last is None:  # the bucket is closed
                    continue
                own = chunks_of(text)
                if last is not None:
                    out.append(describe(*last, text, own))
                last = None if is_halo else (doc_id, text, own)
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return rows.mapInArrow(run, FIELDS)


_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def describe(doc_id, text: str, own: dict[str, int], following: str, other: dict[str, int]) -> dict:
    changed = edit(text, following)
    print_ = chunks_of(changed)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(changed.encode("utf-8", "replace")).hexdigest(),
        "fingerprint": pack(own),
        "edited_fingerprint": pack(print_),
        "near_edited": likeness(own, print_),
        "near_next": likeness(own, other),
    }
