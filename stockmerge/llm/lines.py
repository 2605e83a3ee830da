"""Line dedup: content-defined chunks of lines, repeated multi-line chunks removed.  Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MULTIPLIER, MODULUS = 31, 1_000_003


def line_hash(line: Column) -> Column:
    """The first 32 bits of a line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long")


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns worked out once for each row.  A later lambda that reads a projected column would have its whole
    expression put inside the lambda and evaluated for every element; a generator in between stops that."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def chunked(docs: DataFrame, window: int = 2, divisor: int = 4) -> DataFrame:
    """``docs`` with ``_chunks``, an array of (idx, n_lines, chunk).  A chunk ends after a line where the rolling hash of
    the last ``window`` line hashes is 0 modulo ``divisor``, and with the text; so borders move with inserted lines."""
    roll = lambda h, i: sum((F.coalesce(F.get(h, i - k), F.lit(0)) * MULTIPLIER**k for k in range(1, window)), F.get(h, i))
    ends = F.filter(
        F.sequence(F.lit(1), F.size("_lines")),
        lambda i: (i == F.size("_lines")) | ((roll(F.col("_hashes"), i - 1) % MODULUS) % divisor == 0),
    )

    def chunk(end: Column, j: Column) -> Column:
        start = F.when(j == 0, F.lit(0)).otherwise(F.get("_ends", j - 1))
        return F.struct(
            j.alias("idx"),
            (end - start).alias("n_lines"),
            F.array_join(F.slice("_lines", start + 1, end - start), "\n").alias("chunk"),
        )

    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    out = computed(docs, _lines=lines, _hashes=F.transform(lines, line_hash))
    out = computed(out, _ends=ends)
    return computed(out, _chunks=F.transform("_ends", chunk)).drop("_lines", "_hashes", "_ends")


def repeated(docs: DataFrame, runs: bool = False, **options) -> DataFrame:
    """(doc_id, row, _drop): indexes of the chunks of at least two lines that occur earlier, in a smaller doc_id or before in
    the same document.  With ``runs`` also a chunk of one line goes if it occurs earlier together with its neighbour chunk.
    row is a hash of the text; it tells texts of one id apart and orders them.

    Hashes are counted first, without texts; only chunks whose hash repeats are grouped by hash *and* bytes, which is
    the byte comparison.  Grouping combines on the map side, so a chunk in a third of all rows is one row for each task.
    Neighbours are compared by the first places of their bytes, so they need no texts.
    """
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "row", "text")
    chunks = (
        chunked(known, **options)
        .select("doc_id", "row", F.explode("_chunks").alias("c"))
        .select("doc_id", "row", F.col("c.idx").alias("idx"), F.col("c.n_lines").alias("n_lines"), F.col("c.chunk").alias("chunk"))
        .where("n_lines > 1" if not runs else "true")
        .withColumn("h", F.xxhash64("chunk"))
    )
    often = chunks.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    some = cut(chunks.join(often, "h", "left_semi"))  # both uses below read the repeated chunks, not all texts again
    place = F.struct("doc_id", "row", "idx")
    first = some.groupBy("h", "chunk").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1")
    same = some.join(first, ["h", "chunk"]).select("doc_id", "row", "idx", "n_lines", "f")
    same = cut(same) if runs else same
    drops = same.where("n_lines > 1").where(place > F.col("f")).select("doc_id", "row", "idx")
    if runs:
        drops = drops.unionByName(_repeated_neighbours(same))
    return drops.groupBy("doc_id", "row").agg(F.collect_set("idx").alias("_drop"))


def _repeated_neighbours(same: DataFrame) -> DataFrame:
    """(doc_id, row, idx) of both of two neighbour chunks, one of them of one line, that occur earlier as neighbours and without
    an overlap.  same: doc_id, row, idx, n_lines and the first place f of the chunk's bytes."""
    order = Window.partitionBy("doc_id", "row").orderBy("idx")
    following = F.lead(F.struct("idx", "n_lines", "f")).over(order)
    pairs = same.distinct().withColumn("next", following).where("next.idx = idx + 1 AND (n_lines = 1 OR next.n_lines = 1)")
    pairs = pairs.select("doc_id", "row", "idx", "f", F.col("next.f").alias("next_f"))
    first = pairs.groupBy("f", "next_f").agg(F.min(F.struct("doc_id", "row", "idx")).alias("p"), F.count("*").alias("n")).where("n > 1")
    other = F.struct("doc_id", "row") > F.struct("p.doc_id", "p.row")
    own = (F.struct("doc_id", "row") == F.struct("p.doc_id", "p.row")) & (F.col("idx") > F.col("p.idx") + 1)
    later = pairs.join(first, ["f", "next_f"]).where(other | own)
    return later.select("doc_id", "row", F.explode(F.array(F.col("idx"), F.col("idx") + 1)).alias("idx"))


COUNTS = ["n_lines", "n_chunks", "removed_chunks", "removed_lines"]


def _judged(docs: DataFrame, runs: bool, **options) -> DataFrame:
    """(rest, text, kept, counts): the other columns of ``docs`` as one struct, so that no name of theirs meets a name of ours; the text
    before and after; and COUNTS as a struct."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    rows = docs.select(rest.alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))
    drops = repeated(rows, runs, **options)
    whole = chunked(rows.join(drops, ["doc_id", "row"], "left"), **options)
    kept = F.filter("_chunks", lambda c: ~F.array_contains(F.col("_drop"), c["idx"]))
    out = computed(whole, _kept=F.when(F.col("_drop").isNull(), F.col("_chunks")).otherwise(kept))
    lines = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, c: s + c["n_lines"])
    text = F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_kept", lambda c: c["chunk"]), "\n"))
    counts = (lines("_chunks"), F.size("_chunks"), F.size("_chunks") - F.size("_kept"), lines("_chunks") - lines("_kept"))
    known = F.col("text").isNotNull()
    counts = F.struct(*[F.when(known, v).otherwise(0).cast("long").alias(c) for c, v in zip(COUNTS, counts, strict=True)])
    return out.select("rest", "text", text.alias("kept"), counts.alias("counts"))


def _columns(docs: DataFrame, names: list[str]):
    return [F.col("kept").alias("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in names]


def dedup(docs: DataFrame, runs: bool = False, **options) -> DataFrame:
    """``docs`` with ``text`` replaced by what is kept, and n_lines, n_chunks, removed_chunks, removed_lines.

    The earliest copy of a repeated multi-line chunk stays; single-line chunks stay too, or with ``runs=True`` go where they
    repeat together with a neighbour chunk, so that nothing of a later copy of several lines stays.  Lines are split at ``\\n`` alone
    and compared byte by byte.  An empty text is one empty line.  Null text or null doc_id: the row comes
    back unchanged (null text has 0 lines).  Different texts with one doc_id stand in the order of a hash of the text, so each
    chunk is kept once; rows equal in both are one document and do not empty each other.  Other columns pass, whatever their names; those
    named like the four counts are replaced.
    """
    out = _judged(docs, runs, **options)
    return out.select(*_columns(docs, [c for c in docs.columns if c not in COUNTS]), *[F.col(f"counts.{c}").alias(c) for c in COUNTS])


def clean(docs: DataFrame, runs: bool = True, **options) -> DataFrame:
    """``docs`` with the texts that ``dedup`` keeps and no further column; documents of which lines were removed and nothing but white space
    is left go."""
    emptied = (F.col("counts.removed_lines") > 0) & (F.length(F.trim(F.regexp_replace("kept", r"\s", " "))) == 0)
    out = _judged(docs, runs, **options).where(~F.coalesce(emptied, F.lit(False)))
    return out.select(*_columns(docs, docs.columns))


#: DuckDB SQL for the digest columns of ``dedup``.
SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), hashed AS (
  SELECT doc_id, line, i, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h, count(*) OVER (PARTITION BY doc_id) AS n FROM lines
), ends AS (
  SELECT doc_id, line, i, (i = n OR ((h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 1000003) % 4 = 0)::INT AS e
  FROM hashed
), placed AS (
  SELECT doc_id, line, i, coalesce(sum(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx
  FROM ends
), chunks AS (
  SELECT doc_id, idx, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY i) AS chunk FROM placed GROUP BY doc_id, idx
), judged AS (
  SELECT *, n_lines > 1 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, idx) > 1 AS gone FROM chunks
)
SELECT doc_id, sum(n_lines)::BIGINT AS n_lines, count(*) AS n_chunks, sum(gone::INT)::BIGINT AS removed_chunks,
  sum(CASE WHEN gone THEN n_lines ELSE 0 END)::BIGINT AS removed_lines,
  md5(coalesce(string_agg(chunk, chr(10) ORDER BY idx) FILTER (WHERE NOT gone), '')) AS kept_md5
FROM judged GROUP BY doc_id
"""
