"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words as the similarity operators see them: maximal runs without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; only Spark opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_long_id(docs: DataFrame) -> DataFrame:
    """doc_id as a long, and text.  A long id stays as it is: renamed, two uses of one shuffle would not be seen as one."""
    return docs.select("doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id"), "text")


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


class Codes(dict):
    """word -> int64 hash, remembered; forgotten as a whole at ``limit`` words to bound memory.  A process remembers the words of the one it
    used last: a Python worker goes from stage to stage, and what the last stage remembered is of no use to the next.  Long words are not remembered."""

    longest = 128
    filled: Codes | None = None  # of this process

    def __init__(self, code=None, limit: int = 400_000):
        super().__init__()
        self.code, self.limit = code or word_code, limit

    def __missing__(self, word: str) -> int:
        value = self.code(word)
        if len(word) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[word] = value
        return value

    def array(self, words: list[str]) -> np.ndarray:
        if Codes.filled is not self:
            if Codes.filled is not None:
                Codes.filled.clear()
            Codes.filled = self
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def word_code(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(codes: np.ndarray, k: int) -> np.ndarray:
    """uint64 hash of every window of k codes (k rounds of multiply, add, scramble over whole arrays)."""
    c = codes.view(np.uint64)
    n = len(c) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = mix(c[:n] + np.uint64(k))
    for i in range(1, k):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + c[i : i + n])
    return out


def leads(*keys: np.ndarray) -> np.ndarray:
    """For every row of sorted keys the first row with the same ones."""
    new = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], 0)]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def elsewhere(lead: np.ndarray, own: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Whether the rows ``own`` stand at another place than the rows ``lead`` (a text may be there twice, with one id)."""
    return np.any([p[own] != p[lead] for p in place], 0)


def least_hashed(rows: DataFrame, by: str, most: int, *keys: str) -> DataFrame:
    """At most ``most`` different rows (doc_id, by and ``keys``) for each value of ``by``: those whose id has the least hash (of one id, those with the
    least keys), with ``rn``.  Ranked in 64 parts first, so that no task ranks all rows of a frequent value; texts stay out of it."""
    ids = rows.select("doc_id", by, *keys).distinct().withColumn("_h", F.xxhash64("doc_id"))
    order = ("_h", "doc_id", *keys)
    part = Window.partitionBy(by, F.pmod(F.xxhash64("_h", *keys), F.lit(64))).orderBy(*order)
    some = ids.withColumn("rn", F.row_number().over(part)).where(F.col("rn") <= most).drop("rn")
    return some.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rn") <= most).drop("_h")


def sampled_texts(rows: DataFrame, by: str, most: int) -> DataFrame:
    """(by, rn, doc_id, text) of at most ``most`` different rows (doc_id, by, text) for each value of ``by``, however often ids or rows repeat:
    those whose id has the least hash, and of one id those whose text has.  Texts of one id are told apart by a 64-bit hash."""
    rows = rows.withColumn("text_id", F.xxhash64("text"))
    chosen = F.broadcast(least_hashed(rows, by, most, "text_id"))  # most rows for each value
    return rows.join(chosen, ["doc_id", by, "text_id"]).groupBy(by, "rn").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))


def bitmap_of(spots: DataFrame, bits: int) -> np.ndarray:
    """The packed bitmap (as ``np.packbits``) of a column ``spot`` of numbers below ``bits``.  Executors fold spots into
    words of 64, so at most bits / 64 rows come to the driver."""
    word = F.shiftright("spot", 6).alias("word")
    bit = F.expr("shiftleft(1L, cast(spot & 63 AS int))")
    found = spots.groupBy(word).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return np.packbits(np.unpackbits(out.view(np.uint8), bitorder="little"))


def gear_table(seed: int = 0x5EED) -> np.ndarray:
    """256 fixed pseudo-random uint32 values."""
    return (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) >> np.uint64(32)).astype(np.uint32)


_GEAR = gear_table()


def gear(data: np.ndarray) -> np.ndarray:
    """The gear rolling hash after every byte: h = (h << 1) + G[b] modulo 2**32, so it depends on
    the last 32 bytes alone; computed for all places at once by doubling the span five times."""
    h = _GEAR[data]
    for span in (1, 2, 4, 8, 16):
        if len(h) <= span:
            break
        g = h.copy()
        g[span:] += h[:-span] << np.uint32(span)
        h = g
    return h


def cut_points(data: np.ndarray, smallest: int, bits: int) -> np.ndarray:
    """End offsets of content-defined chunks: a place ends a chunk where the top ``bits`` bits of the gear
    hash are zero and the chunk has at least ``smallest`` bytes; the last ends with the text."""
    n = len(data)
    ends = (np.flatnonzero(gear(data) < np.uint32(1 << (32 - bits))) + 1).tolist()
    out, last = [], 0
    for e in ends:
        if e - last >= smallest:
            out.append(e)
            last = e
    if last < n:
        out.append(n)
    return np.array(out, np.int64)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batches, rows: int = 256):
    """Arrow batches in pieces of a few rows, so that what Python holds at once stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors see.  Where it is unset, a session on one machine gets one folder of its
    own; on a cluster it is an error."""
    global _own_folder
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder and _own_folder is None:
        import tempfile

        _own_folder = tempfile.mkdtemp(prefix="checkpoint-")
    return folder or _own_folder


_own_folder: str | None = None


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint in ``shared_folder``."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows of ``df`` from Parquet files at ``path``, which are written unless a whole set of them is there."""
    spark = df.sparkSession
    if not finished(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(spark: SparkSession, path: str) -> bool:
    files, at = _at(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def removed(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)
