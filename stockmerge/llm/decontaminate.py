"""Benchmark decontamination by templates.

A text becomes template tokens: numbers, names and units turn into typed placeholders, other words are
lower-cased.  A capitalised word that begins a sentence may be a name or not, so windows that hold one are there in both
readings.  Windows of template tokens are hash-joined with the benchmark's windows.  Matches of one item in one region of a
document count together, whatever words were put in or left out between them, as far as they fill the slots as most of
them do: one benchmark value always stands for one document value.  A re-parameterised question (other numbers, other
names) is therefore caught; a chance mix is not.

Items that differ in the values of their slots alone, with equal values at the same places, are held by the same documents in
the same windows.  They are one class, which is matched once, under its smallest item_id; ``item_classes`` has the members.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Codes, bitmap_of, column, cut, mix, slices, texts_of, word_code

# fixed values: units that become a placeholder after a number
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet mile miles meter meters metre metres kilometer kilometers g kg mg lb lbs oz gram grams "
    "kilogram kilograms pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons s sec second seconds min minute "
    "minutes h hr hour hours day days week weeks month months year years dollar dollars euro euros cent cents percent mph kmh"
).split()
_NUMBER = re.compile(r"[$€£+-]*\d[\d.,:/]*$")
_GLUED = re.compile(r"(?<=\d)(?=[^\W\d_])")
_EDGE = "\"'`.,;:!?()[]{}*&%#<>«»“”’…"
_UNIT = frozenset(UNITS)
#: Low bits of a packed word: it ends a sentence, may be a name, a unit, a number, is punctuation alone, or other white space alone.
ENDS, NAME, UNIT, NUM, EMPTY, SPACE = 1, 2, 4, 8, 16, 32
_BITS = 63
_NAME_CODE, _UNIT_CODE, _NUM_CODE = (word_code(x) & ~_BITS for x in ("<name>", "<unit>", "<num>"))


def pack(raw: str) -> int:
    """The hash of a word's plain form, with what it may stand for in the low bits."""
    if raw.isspace():
        return SPACE
    word = raw.strip(_EDGE)
    low = word.lower()
    bits = ENDS * (raw[-1] in ".!?:\n")
    if not word:
        return word_code("") & ~_BITS | bits | EMPTY
    if _NUMBER.match(low):
        bits |= NUM
    elif low in _UNIT:
        bits |= UNIT
    if word[0] != low[0] and (len(word) == 1 or word[1:] == low[1:]):
        bits |= NAME
    return word_code(low) & ~_BITS | bits


_KNOWN = Codes(pack)  # kept between the tasks of a Python worker


def template(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(words, template codes, is a slot).  A name is a capitalised word that does not begin a sentence or a line and is
    not all capitals; a unit is a known unit word after a number; a number and letters stuck to it are two words."""
    return readings(text)[:3]


def readings(text: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``template`` with the capitalised words that begin a sentence or a line, and the codes of all words as they stand."""
    if any(map(text.__contains__, "0123456789")):
        text = _GLUED.sub(" ", text)
    words = list(filter(None, text.replace("\n", " .\n ").split(" ")))
    packed = _KNOWN.array(words)
    other = packed == SPACE
    if other.any():
        words, packed = [w for w, o in zip(words, other.tolist(), strict=True) if not o], packed[~other]
    fresh = np.ones(len(packed), bool)
    np.greater(packed[:-1] & ENDS, 0, out=fresh[1:])
    real = (packed & EMPTY) == 0
    if not real.all():
        words = [w for w, r in zip(words, real.tolist(), strict=True) if r]
        packed, fresh = packed[real], fresh[real]
    number = (packed & NUM) > 0
    unit = (packed & UNIT) > 0
    unit[1:] &= number[:-1]
    unit[:1] = False
    capital = ((packed & NAME) > 0) & ~number & ~unit
    name = capital & ~fresh
    plain = packed & ~np.int64(_BITS)
    codes = plain.copy()
    codes[number], codes[unit], codes[name] = _NUM_CODE, _UNIT_CODE, _NAME_CODE
    return words, codes, number | unit | name, capital & fresh, plain


_BASE = 0x9E3779B97F4A7C15


def window_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """uint64 hash of every window of n codes: a polynomial modulo 2**64, put together from windows of half the length, then scrambled."""
    c, spans, power = codes.view(np.uint64), {}, {1: _BASE}
    spans[1], k = c, 1
    while 2 * k <= n:
        h = spans[k]
        spans[2 * k] = h[:-k] * np.uint64(power[k]) + h[k:]
        power[2 * k] = power[k] * power[k] % (1 << 64)
        k *= 2
    out, done = spans[k], k
    while done < n:  # the rest of n, largest part first
        k = max(x for x in spans if x <= n - done)
        m = len(c) - done - k + 1
        out = out[:m] * np.uint64(power[k]) + spans[k][done : done + m]
        done += k
    return mix(out + np.uint64(n))


def _windows(text, size: int, least_plain: int, literal: bool | None):
    """(places, hashes, is a slot) for each reading of ``readings``: windows with at least ``least_plain`` plain words, then
    those of them that hold a capitalised sentence start as a name.  Windows with fewer plain words are taken word by word if
    ``literal``, or, if that is None, when the text has no others.  A shorter text has one window, itself."""
    _, codes, slot, loose, plain = text
    if not len(codes):
        return
    n = min(size, len(codes))

    def within(flags):
        c = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=c[1:])
        return c[n:] - c[:-n]

    enough = within(~slot) >= min(least_plain, n)
    at = np.flatnonzero(enough)
    if len(at):
        yield at, window_hashes(codes, n)[at], slot
    if loose.any():
        either = slot | loose
        more = np.flatnonzero((within(loose) > 0) & (within(~either) >= min(least_plain, n)))
        if len(more):
            yield more, window_hashes(np.where(loose, _NAME_CODE, codes), n)[more], either
    if literal or literal is None and not len(at):
        few = np.flatnonzero(~enough)
        if len(few):
            yield few, window_hashes(plain, n)[few], np.zeros(len(slot), bool)


_WINDOW = "id long, part long, at int, h long, slots array<string>"
BITS = 1 << 23


def _spots(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(41)).view(np.int64)  # window hashes are scrambled already


def kind_of(text: str, size: int, least_plain: int) -> int:
    """A hash of all that matching depends on: the template's codes in both readings, and which slots hold equal values; the words
    themselves if the text is taken word by word."""
    _, codes, slot, loose, plain = read = readings(text)
    words = read[0]
    seen: dict[str, int] = {}
    same = [seen.setdefault(words[i].strip(_EDGE).lower(), len(seen)) for i in np.flatnonzero(slot | loose).tolist()]
    n = min(size, len(codes))
    enough = any(len(at) and kind is slot for at, _, kind in _windows(read, size, least_plain, False)) if n else True
    parts = [codes.tobytes(), slot.tobytes(), loose.tobytes(), np.array(same, np.int64).tobytes(), b"" if enough else plain.tobytes()]
    if loose.any():  # those words are read as they stand, too
        parts.append(plain[loose].tobytes())
    return xxhash.xxh3_64_intdigest(b"|".join(parts)) - (1 << 63)


def item_classes(benchmark: DataFrame, size: int = 8, least_plain: int = 4) -> DataFrame:
    """(item_id, class_id, kind, text) for every item with an id and a text: class_id is the smallest item_id of its class."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")

    def run(batches):
        for batch in slices(batches):
            kinds = [kind_of(t, size, least_plain) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([column(batch, "item_id"), pa.array(kinds, pa.int64()), column(batch, "text")], ["item_id", "kind", "text"])

    rows = cut(items.mapInArrow(run, "item_id long, kind long, text string"))
    return rows.join(rows.groupBy("kind").agg(F.min("item_id").alias("class_id")), "kind").select("item_id", "class_id", "kind", "text")


def template_windows(rows: DataFrame, size: int, least_plain: int, sizes: list[int], only: np.ndarray | None = None) -> DataFrame:
    """(id, part, at, h, slots) of every window of rows (id, part, text) in each of its readings; part tells texts of one id
    apart, slots holds ``offset=value`` items.  ``sizes`` are the window lengths to make (short benchmark items need
    their own); ``only`` is a bitmap of fixed size over hashes of wanted windows: what it lets through in error, the join
    drops.  With it, all windows with few plain words are there word by word; without, those of texts that have no others."""
    shared = rows.sparkSession.sparkContext.broadcast(only) if only is not None else None
    literal = True if shared else None

    def run(batches):
        keep = np.unpackbits(shared.value).view(bool) if shared else None
        for batch in slices(batches):
            ids, parts, ats, hs, fills = [], [], [], [], []
            for key, part, text in zip(column(batch, "id").to_pylist(), column(batch, "part").to_pylist(), texts_of(batch), strict=True):
                if not text:
                    continue
                read = readings(text)
                words = read[0]
                for n in sizes:
                    if n != size and len(words) < n:
                        continue
                    for at, h, slot in _windows(read, n, least_plain, literal):
                        if keep is not None:
                            hit = keep[_spots(h)]
                            at, h = at[hit], h[hit]
                        for a, x in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                            ids.append(key)
                            parts.append(part)
                            ats.append(a)
                            hs.append(x)
                            fills.append([f"{i - a}={words[i].strip(_EDGE).lower()}" for i in range(a, min(a + n, len(words))) if slot[i]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(parts, pa.int64()), pa.array(ats, pa.int32()), pa.array(hs, pa.int64()), pa.array(fills, pa.list_(pa.string()))],
                ["id", "part", "at", "h", "slots"],
            )

    return rows.mapInArrow(run, _WINDOW)


def item_sizes(benchmark: DataFrame, size: int) -> list[int]:
    """Window lengths that benchmark items need: ``size``, and for shorter items their own length (at most ``size`` values)."""

    def run(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([min(size, len(template(t or "")[0])) for t in texts_of(batch)], pa.int32())], ["n"])

    found = benchmark.select("text").mapInArrow(run, "n int").distinct().collect()
    return sorted({r[0] for r in found} - {0} | {size})


def matches(docs: DataFrame, benchmark: DataFrame, size: int = 8, least_plain: int = 4) -> DataFrame:
    """(doc_id, text_id, item_id, n_windows, item_windows, coverage): how many windows of an item one region of the document holds
    with one filling of the slots.  text_id (XXH64) tells texts of one doc_id apart; item_id stands for its class.  The bitmap made from the
    benchmark has a fixed size (1 MB), so the documents' side of the join is small whatever the benchmark's size, and both sides may be
    shuffled."""
    classes = item_classes(benchmark, size, least_plain)
    owners = classes.groupBy("kind").agg(F.min("class_id").alias("item_id"))
    items = cut(classes.groupBy(F.col("kind").alias("id")).agg(F.lit(0).cast("long").alias("part"), F.min_by("text", F.struct("item_id", "text")).alias("text")))
    sizes = item_sizes(items, size)
    wanted = template_windows(items, size, least_plain, [size])
    bitmap = bitmap_of(wanted.select("h").distinct().mapInArrow(_spot_rows, "spot long"), BITS)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("part"), "text").where("id IS NOT NULL AND text IS NOT NULL")
    found = cut(template_windows(rows, size, least_plain, sizes, bitmap))  # few rows; the texts are read once
    totals = wanted.groupBy("id").agg(F.count_distinct("at").alias("item_windows"), (F.max("at") - F.min("at") + 1).alias("span"))
    # equal windows of an item are one row, so a document that repeats them does not meet each of them each time
    kinds = wanted.groupBy(F.col("id").alias("kind"), "h", "slots").agg(F.min("at").alias("b"), F.count_distinct("at").cast("int").alias("n"))
    pairs = (
        found.select(F.col("id").alias("doc_id"), "part", F.col("at").alias("d"), "h", F.col("slots").alias("values"))
        .join(kinds, "h")
        .withColumn("fills", F.zip_with("slots", "values", lambda s, v: F.struct(_slot(s, "b"), F.substring_index(v, "=", -1).alias("value"))))
    )
    hits = pairs.groupBy("doc_id", "part", "kind").agg(F.collect_set(F.struct("d", "b", "n", "fills")).alias("hits"))  # of one text and class
    return (
        hits.join(totals.withColumnRenamed("id", "kind"), "kind")
        .mapInArrow(_held(size), "doc_id long, part long, kind long, item_windows long, n_windows long")
        .join(owners, "kind")
        .groupBy("doc_id", F.col("part").alias("text_id"), "item_id")
        .agg(F.max_by(F.struct("n_windows", "item_windows"), F.col("n_windows") / F.col("item_windows")).alias("best"))
        .select("doc_id", "text_id", "item_id", "best.n_windows", "best.item_windows", (F.col("best.n_windows") / F.col("best.item_windows")).alias("coverage"))
    )


def consistent_windows(hits: list[tuple[int, int, int, tuple]]) -> int:
    """How many windows of an item are held by hits (d, b, n, fills) that fill each slot as most of them do; b and n are
    the first place and the number of equal windows of the item, of which each place d of the document holds one."""
    votes: dict[str, Counter] = defaultdict(Counter)
    for _, _, _, fills in hits:
        for slot, value in set(fills):
            votes[slot][value] += 1
    most = {slot: min(v, key=lambda x: (-v[x], x)) for slot, v in votes.items()}
    places: dict[tuple[int, int], set[int]] = defaultdict(set)
    for d, b, n, fills in hits:
        if all(most[slot] == value for slot, value in fills):
            places[b, n].add(d)
    return sum(min(len(p), n) for (_, n), p in places.items())


def best_region(hits: list[tuple[int, int, int, tuple]], span: int, size: int) -> int:
    """The most consistent windows in one region of the document, which may be a quarter and two windows longer than the
    item, or at one shift.  Regions begin a quarter of the item apart at most, so one holds any copy as a whole."""
    hits = sorted(hits, key=lambda x: x[0])
    ds = [x[0] for x in hits]
    width, step = span + span // 2 + 2 * size, max(1, span // 4)
    best, end, last, shifts = 0, 0, None, defaultdict(list)
    for i, hit in enumerate(hits):
        shifts[hit[0] - hit[1]].append(hit)
        if last is not None and ds[i] < last + step:
            continue
        last = ds[i]
        while end < len(hits) and ds[end] < last + width:
            end += 1
        best = max(best, consistent_windows(hits[i:end]))
    return max(best, *(consistent_windows(x) for x in shifts.values() if len(x) > best), 0, 0)


def _held(size: int):
    def run(batches):
        for batch in batches:
            for piece in slices([batch], 64):
                spans, totals, lists = (column(piece, c).to_pylist() for c in ("span", "item_windows", "hits"))
                held = []
                for span, total, hits in zip(spans, totals, lists, strict=True):
                    rows = [(x["d"], x["b"], x["n"], tuple((f["slot"], f["value"]) for f in x["fills"])) for x in hits]
                    held.append(min(total, best_region(rows, span, size)))
                yield pa.RecordBatch.from_arrays(
                    [*(column(piece, c) for c in ("doc_id", "part", "kind", "item_windows")), pa.array(held, pa.int64())],
                    ["doc_id", "part", "kind", "item_windows", "n_windows"],
                )

    return run


def _slot(slot, start: str):
    """The benchmark's value is what a slot is named by, so the same value at two places must be filled the same way."""
    return F.substring_index(slot, "=", -1).alias("slot")


def _spot_rows(batches):
    for batch in batches:
        h = column(batch, "h").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(_spots(h))], ["spot"])


def flag(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """doc_id, contaminated, n_items, items (ids, ascending), coverage (of the best item, also where it is below ``least``) for every row.

    A row is contaminated if one region of it holds, consistently filled, at least the share ``least`` of an item's windows.  Of items that
    differ in their slots' values alone the smallest id is given (``item_classes`` has the others).  Null, empty and null-id rows and
    an empty benchmark give false, 0 items, coverage 0.  An item of fewer than ``size`` tokens is one window; an item without any is
    never matched.  An item without enough plain words is matched word by word.  Texts of one id have verdicts of their own, and
    so have texts of one item_id, of which the best counts; repeated rows have the same.
    """
    hit = F.col("coverage") >= least
    verdicts = matches(docs, benchmark, **options).groupBy("doc_id", "text_id").agg(
        F.count(F.when(hit, 1)).alias("n_items"), F.sort_array(F.collect_list(F.when(hit, F.col("item_id")))).alias("items"), F.max("coverage").alias("coverage")
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"))
    return ids.join(verdicts, ["doc_id", "text_id"], "left").select(
        "doc_id",
        (F.coalesce("n_items", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.coalesce("items", F.array().cast("array<bigint>")).alias("items"),
        F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
    )


def remove(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns; texts of one id are judged one by one."""
    found = matches(docs, benchmark, **options).where(F.col("coverage") >= least)
    bad = found.select(F.col("doc_id").alias("_bad_id"), F.col("text_id").alias("_bad_text")).distinct()
    same = (docs["doc_id"].cast("long") == bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["_bad_text"])
    return docs.join(bad, same, "left_anti")
