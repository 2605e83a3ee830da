"""Corpus pipeline: language, repeated lines, near duplicates, benchmark leaks, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents``.  Null ids, null and empty texts, repeated rows and further columns
are handled as the operators' docstrings say; a document without a language goes in the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockmerge.llm import decontaminate, jaccard, language, lines, mixing
from stockmerge.llm.common import finished, removed, shared_folder, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: they have a letter, and some language scores at least 0.8 of what all but one in a hundred of the
    labelled texts that were not learned from reach."""
    model = language.fit(docs)
    return language.keep(docs, model, least=0.8 * model.least)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of multi-line chunks, and of one-line chunks next to a chunk, go from the texts; so do documents of which nothing but white space is left."""
    out = lines.clean(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles with similarity 0.8 or more, the smallest doc_id stays."""
    return jaccard.keep_first(docs, words=5, least="4/5")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item's windows go."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its place in the mix; a source weighs the square root of its size."""
    return mixing.interleave(docs)


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources", mix_sources),
]

#: Kernel regression and template windows have no SQL form; tests compare the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages over ``documents``.  Every stage but the last is written as Parquet below ``folder`` and read again; with a folder of an earlier
    run, stages that it has finished are not run anew.  Without one, a new folder in ``spark.checkpoint.dir`` is used, and a
    stage's files go when the next one is written."""
    own = folder is None
    folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = lambda i: f"{folder}/stage-{i}"
    done = max((i for i in range(len(STAGES) - 1) if finished(spark, path(i))), default=-1)
    docs = spark.read.parquet(path(done)) if done >= 0 else table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[done + 1 :], done + 1):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, path(i))
            if own and i:
                removed(spark, path(i - 1))
    return docs
