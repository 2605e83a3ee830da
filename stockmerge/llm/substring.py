"""Substring dedup: content-defined chunks by a gear rolling hash, repeated runs of chunks removed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, cut_points, elsewhere, leads, mix, slices, texts_of

_CHUNK = "hi long, lo long, doc_id long, text_id long, idx int, start int, size int, late boolean"


def chunks(docs: DataFrame, smallest: int = 24, bits: int = 5) -> DataFrame:
    """One row for each chunk of the UTF-8 bytes of every text: its 128-bit digest (hi, lo), its place, and whether it is known to stand
    earlier, in this text or in another of those that the task holds at once.  Such a row gets a digest of its own, so
    a chunk of a third of all texts does not meet in one task.  A border depends on the 32 bytes before it and the
    minimum size, so after an insertion the old borders come back within a few chunks.  docs: doc_id, text_id, text."""

    def run(batches):
        for batch in slices(batches):
            doc, own, idx, start, size, digest = [], [], [], [], [], []
            for key, text_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text_id").to_pylist(), texts_of(batch), strict=True):
                data = text.encode("utf-8", "replace")
                ends = cut_points(np.frombuffer(data, np.uint8), smallest, bits).tolist()
                begins = [0, *ends[:-1]]
                digest += [xxhash.xxh3_128_digest(data[s:e]) for s, e in zip(begins, ends, strict=True)]
                idx += range(len(ends))
                start += begins
                size += [e - s for s, e in zip(begins, ends, strict=True)]
                doc += [key] * len(ends)
                own += [text_id] * len(ends)
            hi, lo = np.frombuffer(b"".join(digest), ">i8").astype("=i8").reshape(-1, 2).T.copy()
            doc, own, idx = np.array(doc, np.int64), np.array(own, np.int64), np.array(idx, np.int32)
            late = np.zeros(len(doc), bool)
            if len(doc):
                order = np.lexsort((idx, own, doc, lo, hi))
                late[order] = elsewhere(order[leads(hi[order], lo[order])], order, doc, own, idx)
                hi[late] = mix(own[late].view(np.uint64) + idx[late].astype(np.uint64)).view(np.int64)
                lo[late] = doc[late]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (hi, lo, doc, own, idx, np.array(start, np.int32), np.array(size, np.int32), late)], "hi lo doc_id text_id idx start size late".split())

    return docs.where("doc_id IS NOT NULL AND length(text) > 0").select("doc_id", "text_id", "text").mapInArrow(run, _CHUNK)


def repeated(rows: DataFrame) -> DataFrame:
    """(doc_id, text_id, idx, start, size) of the chunks that stand earlier too.  Each task walks its sorted digests and holds one row; texts
    are cut once and chunks shuffled once."""
    dealt = rows.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "late", "doc_id", "text_id", "idx")

    def run(batches):
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            late = column(batch, "late").to_numpy(zero_copy_only=False)
            own = [column(batch, c).to_numpy() for c in ("hi", "lo", "doc_id", "text_id", "idx")]
            own = own if last is None else [np.r_[x, y] for x, y in zip(last, own, strict=True)]
            first = leads(own[0], own[1])
            other = elsewhere(first, np.arange(len(first)), *own[2:])
            last = [x[first[-1]] for x in own]
            keep = pa.array(late | other[len(other) - len(late) :])
            names = ["doc_id", "text_id", "idx", "start", "size"]
            yield pa.RecordBatch.from_arrays([column(batch, c).filter(keep) for c in names], names)

    return dealt.mapInArrow(run, "doc_id long, text_id long, idx int, start int, size int")


def spans(docs: DataFrame, least: int = 100, **options) -> DataFrame:
    """(doc_id, text_id, start, size) in bytes: maximal runs of chunks that all occur earlier (a smaller doc_id, or before in the same
    document), of at least ``least`` bytes together.  Shorter repeats, as common phrases, stay."""
    seen = repeated(chunks(docs, **options)).distinct()
    w = Window.partitionBy("doc_id", "text_id").orderBy("idx")
    runs = seen.withColumn("run", F.col("idx") - F.row_number().over(w)).groupBy("doc_id", "text_id", "run")
    return runs.agg(F.min("start").alias("start"), F.sum("size").alias("size")).where(F.col("size") >= least).select("doc_id", "text_id", "start", "size")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (``start+size`` joined by commas) for every row.

    Null text has 0 bytes.  Null ids take no part.  Different texts with one doc_id stand in the order of a hash of the text, so
    each chunk is kept once; rows equal in both are one document and do not empty each other.  Only doc_id and text are read.
    """
    rows = _keyed(docs)
    found = spans(rows, **options).groupBy("doc_id", "text_id").agg(F.sum("size").alias("n_removed"), F.count("*").alias("n_spans"), F.sort_array(F.collect_list(F.struct("start", "size"))).alias("all"))
    own = rows.select("doc_id", "text_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return own.join(found, ["doc_id", "text_id"], "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce(F.array_join(F.transform("all", lambda s: F.concat_ws("+", s["start"], s["size"])), ","), F.lit("")).alias("spans"),
    )


def remove(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the repeated runs cut out of ``text``; bytes of a character cut in two are dropped.  Other columns pass, whatever their
    names."""
    found = spans(_keyed(docs), **options).groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("spans"))

    @F.pandas_udf("string")
    def cut(text, all_spans):
        out = []
        for t, found_ in zip(text, all_spans, strict=True):
            if t is None or found_ is None:
                out.append(t)
                continue
            data, kept, at = t.encode("utf-8", "replace"), [], 0
            for s in found_:
                kept.append(data[at : s["start"]])
                at = s["start"] + s["size"]
            out.append(b"".join([*kept, data[at:]]).decode("utf-8", "ignore"))
        import pandas as pd

        return pd.Series(out, dtype=object)

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    joined = docs.select(rest.alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text").join(found, ["doc_id", "text_id"], "left")
    return joined.select(*[cut("text", "spans").alias("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
