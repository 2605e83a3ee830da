"""Text normalisation and similarity as column expressions; Python only for edit distances."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that are worked out once for each row.  Projections are merged, so a costly expression would be
    evaluated anew for every use above; a generator in between stops that."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def content_key(*columns: str) -> Column:
    """MD5 of the columns' values; nulls differ from empty texts."""
    return F.md5(F.to_json(F.struct(*columns)))


def per_content(df: DataFrame, columns: list[str], work, cut=lambda d: d) -> DataFrame:
    """What ``work`` adds to rows of ``columns``, worked out once for each distinct content of them and joined to all rows; so repeated texts cost
    a join and no more.  ``cut`` may checkpoint the distinct rows, if ``work`` reads them more than once."""
    keyed = df.withColumn("content_key_", content_key(*columns))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few rows, but each may be costly
    few = work(cut(keyed.select("content_key_", *columns).dropDuplicates(["content_key_"]).repartition(tasks)))
    return keyed.join(few.drop(*[c for c in df.columns if c in few.columns]), "content_key_").drop("content_key_")


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalize_text(c) -> Column:
    """Upper case; what is neither letter, digit, underscore nor space becomes a space; spaces collapse."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(text(c)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def alnum_key(c) -> Column:
    return F.regexp_replace(F.upper(text(c)), r"[^A-Z0-9]", "")


def tokens(c) -> Column:
    """Distinct upper-case tokens between white space and , ; / -."""
    return F.array_distinct(F.filter(F.split(F.upper(c), r"[\s,;/\-]+"), lambda t: t != ""))


def set_jaccard(a: Column, b: Column) -> Column:
    """1 for two empty sets, 0 for one; null counts as no similarity."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), 0.0).when(either == 0, 1.0).otherwise(both / either)


def token_jaccard(a, b) -> Column:
    return set_jaccard(tokens(a), tokens(b))


def trigrams(c) -> Column:
    """Distinct trigrams of lower-cased words, each padded by two spaces in front and one behind."""
    words = F.filter(F.split(F.lower(text(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a, b) -> Column:
    return set_jaccard(trigrams(a), trigrams(b))


def length_ratio(a, b) -> Column:
    low, high = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when(high == 0, 1.0).otherwise(low / high)


def surface_features(c) -> dict[str, Column]:
    t = text(c)
    n = F.greatest(F.length(t), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(t, pattern, "")) / n
    return {
        "n_chars": F.length(t),
        "n_tokens": F.size(F.filter(F.split(t, r"\s+"), lambda w: w != "")),
        "digit_ratio": share("[^0-9]"),
        "upper_ratio": share("[^A-Z]"),
        "punct_ratio": share(r"[\p{L}\p{N}\s]"),
    }


def clamp_decimal(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)).cast("decimal(5,4)")


def tier(score) -> Column:
    from ..config import HIGH, MEDIUM

    score = F.col(score) if isinstance(score, str) else score
    return F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")


def parse_price(c) -> Column:
    return F.expr("1") if c is None else F.regexp_replace(text(c), r"[^0-9.\-]", "").try_cast("decimal(14,2)")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence; rows of the table are bits of one integer."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for ch in b:
        u = s & where.get(ch, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def indel(a: str, b: str) -> float:
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of its length in the longer; windows may hang over both ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    n, best = len(a), 0.0
    known = set(a)
    for start in range(1 - n, len(b)):
        window = b[max(0, start) : start + n]
        if start >= 0 and start + n <= len(b) and window[-1] not in known and best:
            continue  # moving on by one can't be worse
        best = max(best, indel(a, window))
        if best == 1.0:
            break
    return best


def _in_batches(f):
    """A column function over two texts that runs ``f`` on Arrow batches (made on the driver, when a session is there)."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([f(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=float)

    return F.pandas_udf(run, "double")


def indel_ratio(a, b) -> Column:
    return _in_batches(indel)(a, b)


def partial_ratio(a, b) -> Column:
    return _in_batches(partial)(a, b)


def sorted_tokens(c) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != "")), " ")


def token_sort_ratio(a, b) -> Column:
    return indel_ratio(sorted_tokens(a), sorted_tokens(b))
