"""Suffix dedup: every byte covered by a string of LENGTH bytes that also starts earlier.

The suffixes of all texts would be sorted by their first LENGTH bytes and equal neighbours compared.  Sorting them all is not
affordable (one row for each byte), so the sort is done blockwise over a cover sample:

*  The cover.  A place is sampled if the hash of its next BLOCK bytes is the least among the block hashes of some
   LENGTH-byte string that contains the block.  Like a difference cover, it has a sample place within a bounded
   distance of any place, at the same distance for equal strings; unlike an arithmetic one (12 % of the places for this
   length, by measured bytes a row 5.4 x input of samples where 4 x are allowed; the README has the figures) it needs about 3 %.
*  The buckets.  A sample's block is the bucket of all suffixes that reach it; one bucket after another is sorted.
*  The ranks.  Samples of a bucket are first told apart by their whole neighbourhood (48 bits of the block's hash and 64 of
   the neighbourhood's).  Equal neighbourhoods (long ties) are settled without looking at bytes: all but the earliest are covered.
   For the first of each neighbourhood, in buckets with several, what follows the block's start is sorted by its bytes, and
   so is what precedes it, read backwards.  Ranks of both for every length settle the ties of the suffixes: two strings are
   equal if and only if the ranks of their parts before and from the block are.  No bytes are compared by hash here.
*  Crowded buckets are dealt over parts of PART rows; strings that are the first of their part meet those of the other
   parts by 128-bit hashes.

Everything is one plan without a switch: rows that are settled early flow through the later steps.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, elsewhere, leads, mix, slices, texts_of, with_long_id

LENGTH, BLOCK, PART = 100, 32, 2000
REACH = LENGTH - BLOCK  # bytes on either side of a block that a string through it can have
WIDTH = REACH + BLOCK + REACH
_PAD = 256
_VALUES = mix(np.arange(1, 258, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(77))
_BASE, _OTHER = 0x5851F42D4C957F2D, 0x2545F4914F6CDD1D
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def blocks(values: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Hash of the BLOCK values from every place of the last axis, by doubling the span (polynomial modulo 2**64, then scrambled)."""
    h, power, span = _VALUES[values], base, 1
    while span < BLOCK:
        h = h[..., :-span] * np.uint64(power) + h[..., span:]
        power, span = power * power % (1 << 64), span * 2
    return mix(h)


def _extreme(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over ``width`` values from every place."""
    span = 1
    out = a
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    return pick(out[: len(a) - width + 1], out[width - span : width - span + len(a) - width + 1])


def sample(h: np.ndarray) -> np.ndarray:
    """Sample places, given the block hashes of a text: the least of any REACH + 1 neighbouring ones, with ties."""
    width = REACH + 1
    if len(h) < width:
        return np.zeros(0, np.int64)
    least = _extreme(h, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_extreme(np.r_[edge, least, edge], width, np.maximum) == h)


def padded(data: bytes) -> np.ndarray:
    """Bytes as int16 with REACH marks on both sides that equal no byte."""
    edge = np.full(REACH, _PAD, np.int16)
    return np.r_[edge, np.frombuffer(data, np.uint8).astype(np.int16), edge]


def around(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the neighbourhood of sample places, from block hashes of the padded text."""
    out = np.zeros(len(at), np.uint64)
    for step in (0, 32, 64, 96, 128, 2 * REACH):
        out = mix(out * _GOLD + h[at + step])
    return out


def samples(docs: DataFrame) -> DataFrame:
    """(bucket, near, doc_id, text_id, spot): the sample of every text.  bucket is the low 48 bits of the block's hash (the upper ones
    of a least hash say little), over 16 zeros that cost nothing when compressed; blocks that share it are told apart by their bytes.  spot is twice the place, plus 1 if the same
    neighbourhood is known to stand earlier, in this text or in another of those that the task holds at once.  Such rows
    have nothing to do in their bucket and get another, so a passage of a third of all texts does not meet in one task."""

    def run(batches):
        for batch in slices(batches):
            out = [], [], [], [], []
            for key, own_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text_id").to_pylist(), texts_of(batch), strict=True):
                data = text.encode("utf-8", "replace")
                if len(data) < LENGTH:
                    continue
                h = blocks(padded(data))
                own = h[REACH : len(h) - REACH]
                at = sample(own)
                for o, v in zip(out, (own[at], around(h, at), np.full(len(at), key, np.int64), np.full(len(at), own_id, np.int64), at.astype(np.int32) * 2), strict=True):
                    o.append(v)
            if out[0]:
                bucket, near, doc, text_id, spot = map(np.concatenate, out)
                order = np.lexsort((spot, text_id, doc, near, bucket))
                lead = order[leads(bucket[order], near[order])]
                late = order[elsewhere(lead, order, doc, text_id, spot)]
                spot[late] += 1
                bucket[late] = mix(near[late] + doc.view(np.uint64)[late] * _GOLD + spot[late].astype(np.uint64))
                bucket <<= np.uint64(16)
                yield _batch((bucket.view(np.int64), near.view(np.int64), doc, text_id, spot), "bucket near doc_id text_id spot")

    return docs.mapInArrow(run, "bucket long, near long, doc_id long, text_id long, spot int")


def _batch(arrays, names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], names.split())


_PLACE = "doc_id long, text_id long, at int, bucket long, part int"


def ranked(rows: DataFrame) -> DataFrame:
    """(doc_id, text_id, at, bucket, part): samples whose whole neighbourhood stands earlier (bucket null), and the first of every
    neighbourhood in buckets with several, dealt over parts.  Others leave nothing.  Part -1 says that part 0
    of its bucket is not alone (of a place in it).  A task walks its sorted buckets and holds one row."""
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "near", "doc_id", "text_id", "spot")

    def run(batches):
        last = None  # bucket, near, how many neighbourhoods of the bucket so far, and the first places of both
        for batch in batches:
            bucket, near, doc, text_id, spot = (column(batch, c).to_numpy() for c in ("bucket", "near", "doc_id", "text_id", "spot"))
            late = spot % 2 == 1
            yield _places(doc[late], text_id[late], spot[late] // 2)
            bucket, near, doc, text_id, at = bucket[~late], near[~late], doc[~late], text_id[~late], spot[~late] // 2
            if not len(bucket):
                continue
            new_bucket = np.r_[last is None or last[0] != bucket[0], bucket[1:] != bucket[:-1]]
            first = new_bucket | np.r_[last is None or last[1] != near[0], near[1:] != near[:-1]]
            lead = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
            place = [doc[lead], text_id[lead], at[lead]]
            if not first[0]:
                for p, v in zip(place, last[4], strict=True):
                    p[: int(first.argmax()) if first.any() else len(first)] = v
            covered = np.any([p != own for p, own in zip(place, (doc, text_id, at), strict=True)], 0)
            yield _places(doc[covered], text_id[covered], at[covered])
            count = np.cumsum(first)
            begin = np.maximum.accumulate(np.where(new_bucket, np.arange(len(bucket)), -1))
            before = np.where(begin < 0, 0 if last is None else -last[2], count[begin] - 1)
            nth = count - before - 1  # of the neighbourhood in its bucket
            f = np.flatnonzero(first)
            followed = np.r_[bucket[f][1:] == bucket[f][:-1], False]
            if last is not None and last[2] == 1 and len(f) and not new_bucket[f[0]]:
                yield _places(*([x] for x in last[3]), [last[0]], [0])  # it has waited for a second
            out = f[(nth[f] > 0) | followed]
            yield _places(doc[out], text_id[out], at[out], bucket[out], nth[out] // PART)
            own = [np.where(begin < 0, last[3][i] if last is not None else 0, c[begin]) for i, c in enumerate((doc, text_id, at))]
            more = f[nth[f] == PART]
            yield _places(*(c[more] for c in own), bucket[more], np.full(len(more), -1))
            last = bucket[-1], near[-1], int(nth[-1]) + 1, [c[-1] for c in own], [p[-1] for p in place]

    return dealt.mapInArrow(run, _PLACE)


def _places(doc, text_id, at, bucket=None, part=None):
    n = len(doc)
    return _batch(
        (np.asarray(doc, np.int64), np.asarray(text_id, np.int64), np.asarray(at, np.int32), pa.nulls(n, pa.int64()) if bucket is None else np.asarray(bucket, np.int64), pa.nulls(n, pa.int32()) if part is None else np.asarray(part, np.int32)),
        "doc_id text_id at bucket part",
    )


_NEAR = "bucket long, part int, doc_id long, text_id long, at int, stop int, bytes binary"


def neighbourhoods(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(bucket, part, doc_id, text_id, at, stop, bytes): what stands around each place with a bucket; and byte ranges (at, stop) that
    the places without one cover, with bytes null and a bucket of their own.  A row without a doc_id says that part 0 of its
    bucket is not alone."""
    grouped = found.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("at", "bucket", "part")).alias("places"))

    def run(batches):
        for batch in slices(batches, 64):
            out = [], [], [], [], [], [], []
            for key, own_id, text, places in zip(column(batch, "doc_id").to_pylist(), column(batch, "text_id").to_pylist(), texts_of(batch), column(batch, "places").to_pylist(), strict=True):
                data = text.encode("utf-8", "replace")
                values = padded(data)
                for p in places:
                    if p["part"] == -1:
                        row = p["bucket"], 0, None, None, -1, 0, None
                    elif p["part"] is not None:
                        row = p["bucket"], p["part"], key, own_id, p["at"], 0, pack(values[p["at"] : p["at"] + WIDTH])
                    else:
                        continue
                    for o, v in zip(out, row, strict=True):
                        o.append(v)
                for s, e in merged([(max(0, p["at"] - REACH), p["at"] + LENGTH) for p in places if p["bucket"] is None], len(data)):
                    for o, v in zip(out, (own_id ^ s, 0, key, own_id, s, e, None), strict=True):
                        o.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield _batch([pa.array(o, t) for o, t in zip(out, types, strict=True)], "bucket part doc_id text_id at stop bytes")

    return docs.join(grouped, ["doc_id", "text_id"]).select("doc_id", "text_id", "text", "places").mapInArrow(run, _NEAR)


def pack(values: np.ndarray) -> bytes:
    """How many marks lead (one byte), then the bytes without marks."""
    real = np.flatnonzero(values != _PAD)
    return bytes([real[0]]) + values[real].astype(np.uint8).tobytes()


def unpack(blobs: list[bytes]) -> np.ndarray:
    out = np.full((len(blobs), WIDTH), _PAD, np.int16)
    for row, blob in zip(out, blobs, strict=True):
        row[blob[0] : blob[0] + len(blob) - 1] = np.frombuffer(blob, np.uint8, offset=1)
    return out


def _rank(group: np.ndarray, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For every row its ranks, in byte order, among the beginnings of ``lengths`` bytes of the rows (uint8) of all groups in order."""
    wide = np.zeros((len(data), -(-data.shape[1] // 8) * 8), np.uint8)
    wide[:, : data.shape[1]] = data
    order = np.lexsort((*wide.view(">u8").astype(np.uint64).T[::-1], group))
    a = data[order]
    unlike = np.c_[a[1:] != a[:-1], np.ones(len(a) - 1, bool)] if len(a) > 1 else np.zeros((0, data.shape[1] + 1), bool)
    shared = unlike.argmax(1)  # length of the common beginning with the row before
    shared[group[order][1:] != group[order][:-1]] = -1
    ranks = np.zeros((len(data), len(lengths)), np.int64)
    ranks[order[1:]] = np.cumsum(shared[:, None] < lengths[None, :], 0)
    return ranks


def string_ranks(group: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for the LENGTH-byte string from each of the first REACH + 1 places of every row, equal for equal strings of one group and
    place; and whether the string lies inside the text.  Keys are pairs of the ranks of the part from the block on and of the
    part before it read backwards."""
    mark = values == _PAD
    data = np.where(mark, 0, values).astype(np.uint8)
    step = np.arange(REACH + 1)
    after = _rank(group, np.ascontiguousarray(data[:, REACH:]), BLOCK + step)
    before = _rank(group, np.ascontiguousarray(data[:, REACH - 1 :: -1]), REACH - step)
    n = len(values)
    marks = np.c_[np.zeros(n, np.int32), np.cumsum(mark, 1, dtype=np.int32)]
    return (step[None, :] * n + before) * n + after, marks[:, LENGTH : LENGTH + REACH + 1] == marks[:, : REACH + 1]


def hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of the LENGTH bytes from each of the first REACH + 1 places of every row."""
    out = []
    for base in (_BASE, _OTHER):
        h, x = blocks(values, base), np.zeros((len(values), REACH + 1), np.uint64)
        for step in (0, 32, 64, REACH):
            x = mix(x * _GOLD + h[:, step : step + REACH + 1])
        out.append(x)
    return out[0], out[1]


_SPAN = "high long, low long, doc_id long, text_id long, start int, stop int, settled boolean"


def sorted_buckets(rows: DataFrame) -> DataFrame:
    """(high, low, doc_id, text_id, start, stop, settled): ranges that start earlier too (settled), by sorting one bucket after another; and
    for crowded buckets the strings that are the first of their part, by their hashes (not settled)."""
    dealt = rows.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "doc_id", "text_id", "at")

    def judge(batch, shared: set):
        doc, text_id, at, stop, bucket, part = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_id", "at", "stop", "bucket", "part"))
        blobs = column(batch, "bytes")
        done = blobs.is_null().to_numpy(zero_copy_only=False)
        if done.any():
            yield _spans(doc[done], text_id[done], at[done], stop[done])
        todo = np.flatnonzero(~done)
        if not len(todo):
            return
        doc, text_id, at, bucket, part = doc[todo], text_id[todo], at[todo].astype(np.int64), bucket[todo], part[todo]
        values = unpack(blobs.filter(pa.array(~done)).to_pylist())
        group = np.cumsum(np.r_[0, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])])
        key, inside = string_ranks(group, values)
        row, step = np.nonzero(inside)
        key = key[row, step]
        order = np.argsort(key, kind="stable")  # rows of a bucket come in the order of their places
        late = np.zeros(len(key), bool)
        late[order] = elsewhere(row[order[leads(key[order])]], row[order], doc, text_id, at) if len(key) else False
        p = at[row] + step - REACH
        low, high = np.full(len(doc), np.iinfo(np.int64).max), np.full(len(doc), -1)
        np.minimum.at(low, row[late], p[late])
        np.maximum.at(high, row[late], p[late])
        hit = high >= 0  # all strings of a row contain its block, so they leave no gap
        yield _spans(doc[hit], text_id[hit], low[hit].astype(np.int32), (high[hit] + LENGTH).astype(np.int32))
        crowded = (part > 0) | np.isin(bucket, list(shared))
        if crowded.any():
            open_ = crowded[row] & ~late
            row, step, p = row[open_], step[open_], p[open_].astype(np.int32)
            high, low = hashes(values[crowded])
            at_row = (np.cumsum(crowded) - 1)[row]
            yield _batch((high[at_row, step].view(np.int64), low[at_row, step].view(np.int64), doc[row], text_id[row], p, p + np.int32(LENGTH), np.zeros(len(p), bool)), "high low doc_id text_id start stop settled")

    def run(batches):
        for batch in _whole(batches):
            doc = column(batch, "doc_id")
            shared = set(column(batch, "bucket").filter(doc.is_null()).to_pylist())
            real = batch.filter(doc.is_valid())
            bucket, part = (column(real, c).to_numpy() for c in ("bucket", "part"))
            starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])]) if len(bucket) else np.zeros(0, np.int64)
            begin = 0
            for s in [*starts[1:].tolist(), len(bucket)]:  # some PART rows of whole buckets
                if s - begin >= PART or s == len(bucket):
                    if s > begin:
                        yield from judge(real.slice(begin, s - begin), shared)
                    begin = s

    return dealt.mapInArrow(run, _SPAN)


def _spans(doc, text_id, start, stop):
    """Settled ranges, with a hash of their own so that they are dealt evenly."""
    own = mix(text_id.view(np.uint64) + start.astype(np.uint64) * _GOLD).view(np.int64)
    return _batch((own, own, doc, text_id, start.astype(np.int32), stop.astype(np.int32), np.ones(len(doc), bool)), "high low doc_id text_id start stop settled")


def joined_parts(rows: DataFrame) -> DataFrame:
    """(doc_id, text_id, start, stop): the settled ranges, and all but the earliest of equal strings of crowded buckets."""
    dealt = rows.repartition("high", "low").sortWithinPartitions("high", "low", "settled", "doc_id", "text_id", "start")

    def run(batches):
        last = None  # hashes and first place of the last string
        for batch in batches:
            names = ("high", "low", "doc_id", "text_id", "start", "settled")
            *rows, settled = (column(batch, c).to_numpy(zero_copy_only=False) for c in names)
            if not len(settled):
                continue
            if last is not None:
                rows = [np.r_[x, y] for x, y in zip(last, rows, strict=True)]
            high, low, *place = rows
            first = leads(high, low)
            other = elsewhere(first, np.arange(len(first)), *place)  # a string may be there twice, by two samples
            keep = pa.array(settled | other[len(other) - len(settled) :])
            last = [x[first[-1]] for x in rows]
            yield _batch([column(batch, c).filter(keep) for c in ("doc_id", "text_id", "start", "stop")], "doc_id text_id start stop")

    return dealt.mapInArrow(run, "doc_id long, text_id long, start int, stop int")


def _whole(batches):
    """Batches cut at the borders of (bucket, part), so that none lies in two; a part has PART rows or so."""
    held: list = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        bucket, part = (column(batch, c).to_numpy() for c in ("bucket", "part"))
        change = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1])) + 1
        if len(change):
            held[-1] = batch.slice(0, int(change[-1]))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [batch.slice(int(change[-1]))]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def spans(known: DataFrame, dealt: DataFrame) -> DataFrame:
    """(doc_id, text_id, start, stop): byte ranges, perhaps overlapping, whose union is what starts earlier too.  known: doc_id, text_id
    and text; ``dealt`` is the same dealt by (doc_id, text_id)."""
    return joined_parts(sorted_buckets(neighbourhoods(dealt, ranked(samples(known)))))


def merged(found: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Maximal runs of the union, cut at n."""
    out: list[list[int]] = []
    for s, e in sorted((s, min(n, e)) for s, e in found):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,stop:int>>"


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, stop in bytes) for every row.

    Each byte goes that is covered by a LENGTH-byte string which also starts earlier: in a smaller doc_id, or before in
    the same document, overlaps included; strings are judged on the input.  Null and empty texts have 0 bytes.  Rows
    with null ids take no part and keep all.  Different texts with one doc_id stand in the order of a hash of the
    text, so each string is kept once; rows that are equal in both are taken for one place and do not remove each other.
    Only doc_id and text are read.

    Texts are shuffled once, by id: both joins with what is found use the same exchange.
    """
    docs = with_long_id(docs)
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("text_id"), "text")
    dealt = known.repartition("doc_id", "text_id")
    found = spans(known, dealt).groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("start", "stop")).alias("found"))

    def run(batches):
        for batch in slices(batches):
            out = []
            for key, text, places in zip(column(batch, "doc_id").to_pylist(), texts_of(batch), column(batch, "found").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "replace")
                runs = merged([(p["start"], p["stop"]) for p in places or []], len(data))
                kept, at = hashlib.sha256(), 0
                for s, e in runs:
                    kept.update(data[at:s])
                    at = e
                kept.update(data[at:])
                out.append({"doc_id": key, "n_bytes": len(data), "n_removed": sum(e - s for s, e in runs), "n_spans": len(runs), "kept_sha256": kept.hexdigest(), "spans": [{"start": s, "stop": e} for s, e in runs]})
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    rest = docs.where("doc_id IS NULL OR text IS NULL").withColumn("found", F.lit(None).cast("array<struct<start:int,stop:int>>"))
    return dealt.join(found, ["doc_id", "text_id"], "left").select("doc_id", "text", "found").unionByName(rest).mapInArrow(run, _RESULT)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))]
)
