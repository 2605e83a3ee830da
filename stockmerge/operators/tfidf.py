"""TF-IDF in long form (id, term, weight): one aggregation for frequencies, joins on terms for cosines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import top_k
from .scratch import checkpointed


def word_terms(c: Column) -> Column:
    """Words of two characters or more and their bigrams."""
    w = F.expr(r"regexp_extract_all(lower(_t), '(\\w\\w+)', 1)") if c is None else F.regexp_extract_all(F.lower(c), F.lit(r"(\w\w+)"), 1)
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return F.when(F.size(w) > 1, F.concat(w, pairs)).otherwise(w)


def char_terms(c: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside words, each word with a space on both sides."""
    words = F.transform(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    grams = lambda p, n: F.when(F.length(p) >= n, F.transform(F.sequence(F.lit(1), F.length(p) - n + 1), lambda i: F.substr(p, i, F.lit(n)))).otherwise(F.array(p))
    return F.flatten(F.transform(words, lambda p: F.concat(*[grams(p, n) for n in range(low, high + 1)])))


def counts(docs: DataFrame, terms: Column) -> DataFrame:
    """docs(id, ...) -> (id, term, tf)"""
    return docs.select("id", F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def fit(docs: DataFrame, terms: Column, least: int = 2, copies: str | None = None) -> DataFrame:
    """(term, df, idf) with idf = ln((1 + n) / (1 + df)) + 1 over the terms in ``least`` documents or more.  A row stands for as many documents
    as its column ``copies`` says."""
    docs = docs.withColumn("_copies", F.col(copies) if copies else F.lit(1).cast("long"))
    n = docs.agg(F.coalesce(F.sum("_copies"), F.lit(0).cast("long")).alias("n"))
    df = docs.select("_copies", F.explode(F.array_distinct(terms)).alias("term")).groupBy("term").agg(F.sum("_copies").alias("df")).where(F.col("df") >= least)
    return df.join(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def transform(docs: DataFrame, terms: Column, vocabulary: DataFrame) -> DataFrame:
    """(id, term, weight) of unit length"""
    raw = counts(docs, terms).join(vocabulary, "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return raw.join(length, "id").select("id", "term", (F.col("w") / F.col("l")).alias("weight"))


def cosine(pairs: DataFrame, weights: DataFrame, name: str = "cosine") -> DataFrame:
    """pairs(a, b) with their cosine, 0 if no term is shared"""
    x = weights.select(F.col("id").alias("a"), "term", F.col("weight").alias("wa"))
    y = weights.select(F.col("id").alias("b"), "term", F.col("weight").alias("wb"))
    dots = pairs.select("a", "b").distinct().join(x, "a").join(y, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias(name))
    return pairs.join(dots, ["a", "b"], "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


_CLOSE = 1e-7  # what rounding may add to a bound


def prefilter(weights: DataFrame, blocks: DataFrame, k: int = 25) -> DataFrame:
    """(a, b, cosine, rank): exactly the k best others of a's block, by shared terms, ties to the smaller id; blocks(id, block).

    Equal vectors of a block are one class, which is worked with once and expands to at most k + 1 members.
    """
    w = weights.join(blocks, "id")
    vector = F.md5(F.array_sort(F.collect_list(F.struct("term", "weight"))).cast("string")).alias("vector")
    keyed = checkpointed(w.groupBy("id", "block").agg(vector))
    classes = keyed.groupBy("block", "vector").agg(F.min("id").alias("class"))
    member = checkpointed(keyed.join(classes, ["block", "vector"]).select("id", "class", "block"))
    leads = member.where("id = class").select("id", "block")
    others = best_others(weights.join(leads, "id"), k)
    own = leads.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("cosine"))
    # the k + 1 best classes are enough: each has at least one member; and of a class its k + 1 smallest ids
    best = top_k(others.unionByName(own), "a", [F.desc("cosine"), "b"], k + 1, "n").select("a", F.col("b").alias("class"), "cosine")
    small = top_k(member, "class", ["id"], k + 1, "n").select("class", F.col("id").alias("b"))
    few = top_k(best.join(small, "class"), "a", [F.desc("cosine"), "b"], k + 1, "n").select(F.col("a").alias("class"), "b", "cosine")
    out = member.select(F.col("id").alias("a"), "class").join(few, "class").where("a <> b").select("a", "b", "cosine")
    return top_k(out, "a", [F.desc("cosine"), "b"], k)


def best_others(w: DataFrame, k: int, rare: int = 2, listed: int = 48) -> DataFrame:
    """(a, b, cosine), rounded to nine digits: others of a's block that share terms, the k best of each a and perhaps more; w(id, block, term, weight).

    Each a first meets up to ``listed`` others of each of its ``rare`` rarest terms; the k-th best of these bounds what is wanted from below.
    Terms stand rare first.  Who shares only terms from some place on has a cosine of at most the length of a's vector from there on, so only
    the terms before that place are joined; and of those met, who can still reach the bound (shared so far, plus what both have left) is
    scored in full.  The frequent terms of a uniform block are hardly ever joined.
    """
    near, w = may_reach(w, k, rare, listed)
    return cosine(near, w).withColumn("cosine", F.round("cosine", 9))


def may_reach(w: DataFrame, k: int, rare: int = 2, listed: int = 48) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) that ``best_others`` scores in full, and the vectors."""
    w = checkpointed(w)
    often = w.groupBy("block", "term").agg(F.count("*").alias("df"))
    inner = Window.partitionBy("id").orderBy("df", "term")
    left_over = F.sum(F.col("weight") * F.col("weight")).over(inner.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = checkpointed(w.join(often, ["block", "term"]).withColumns({"place": F.row_number().over(inner), "tail": left_over}))
    lists = top_k(w, ["block", "term"], [F.xxhash64("id"), "id"], listed, "n").select("block", "term", F.col("id").alias("b"))
    seeds = ranked.where(F.col("place") <= rare).select(F.col("id").alias("a"), "block", "term").join(lists, ["block", "term"]).where("a <> b").select("a", "b").distinct()
    bound = top_k(cosine(seeds, w), "a", [F.desc("cosine")], k).groupBy("a").agg(F.when(F.count("*") == k, F.min("cosine") - _CLOSE).otherwise(0.0).alias("bound"))
    x = ranked.withColumnRenamed("id", "a").join(bound, "a", "left").withColumn("bound", F.greatest(F.coalesce("bound", F.lit(0.0)), F.lit(0.0)))
    x = x.where(F.col("tail") >= F.col("bound") * F.col("bound"))
    rest = x.groupBy("a").agg(F.greatest(F.min("tail") - F.min_by(F.col("weight") * F.col("weight"), "tail"), F.lit(0.0)).alias("rest"), F.first("bound").alias("bound"))
    y = w.select(F.col("id").alias("b"), "block", "term", F.col("weight").alias("wb"))
    met = x.select("a", "block", "term", F.col("weight").alias("wa")).join(y, ["block", "term"]).where("a <> b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.sum(F.col("wb") * F.col("wb")).alias("seen"))
    reach = F.col("dot") + F.sqrt(F.col("rest") * F.greatest(1 - F.col("seen"), F.lit(0.0)))
    return met.join(rest, "a").where(reach + _CLOSE >= F.col("bound")).select("a", "b"), w
