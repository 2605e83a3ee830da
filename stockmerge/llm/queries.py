"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str, runs: bool = False) -> DataFrame:
    """One-line chunks stay, as the query's SQL has it; op1_line_dedup_runs removes them with their neighbours."""
    from pyspark.sql import functions as F

    from .lines import dedup

    out = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), runs=runs)
    return out.select("doc_id", "n_lines", "n_chunks", "removed_chunks", "removed_lines", F.md5("text").alias("kept_md5"))


def op1_line_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_line_dedup(spark, sf_dir, runs=True)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import cluster

    return cluster(table(spark, sf_dir, "documents"), words=3, least="9/10")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import interleave

    return interleave(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_mixing_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source weighs the same, which with three sources is exactly a third each."""
    from .mixing import interleave

    return interleave(table(spark, sf_dir, "documents").select("doc_id", "source"), weights={})


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import dedup

    return dedup(table(spark, sf_dir, "documents")).drop("spans")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import report

    return report(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import flag

    return flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .language import fit, held_out_part, predict

    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs))
    return out.select("doc_id", (held_out_part() == 2).alias("held_out"), "lang_pred", "score")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import cluster

    return cluster(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import repaired

    return repaired(table(spark, sf_dir, "conversations"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_line_dedup, op1_line_dedup_runs, op2_ngram_jaccard, op3_quality, op4_decontaminate, op5_mixing, op5_mixing_exact, op6_suffix_dedup, op7_substring_dedup, op8_token_counts, op9_fingerprints, op10_language, op11_simhash, op12_conversation_repair, op13_whitening, pipeline)}


def oracle_sql() -> dict[str, str]:
    from . import conversations, jaccard, lines, mixing

    return {"op1_line_dedup": lines.SQL, "op2_ngram_jaccard": jaccard.SQL, "op5_mixing": mixing.SQL, "op5_mixing_exact": mixing.SQL_EQUAL, "op12_conversation_repair": conversations.SQL}
