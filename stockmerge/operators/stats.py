"""Dashboard and catalog aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def count_where(condition):
    return F.count_if(F.coalesce(condition, F.lit(False)))


def dashboard(materials: DataFrame, groups: DataFrame, mappings: DataFrame, enterprises: DataFrame) -> DataFrame:
    from .joins import unmatched

    m = materials.agg(F.count("*").alias("materials"))
    g = groups.agg(count_where(F.col("status") == "ACTIVE").alias("active_groups"))
    p = mappings.agg(*[count_where(F.col("status") == s).alias(s.lower()) for s in ("CONFIRMED", "PENDING", "REJECTED")])
    u = unmatched(materials, mappings).agg(F.count("*").alias("unmatched"))
    e = enterprises.agg(F.count("*").alias("enterprises"))
    out = m
    for one in (g, p, u, e):  # single rows
        out = out.join(F.broadcast(one))
    return out


def enterprise_breakdown(materials: DataFrame, mappings: DataFrame) -> DataFrame:
    confirmed = mappings.where("status = 'CONFIRMED'").select("material_id").distinct().withColumn("mapped", F.lit(1))
    return materials.join(confirmed, "material_id", "left").groupBy("enterprise").agg(F.count_distinct("material_id").alias("materials"), F.count_distinct(F.when(F.col("mapped") == 1, F.col("material_id"))).alias("mapped"))


def category_distribution(materials: DataFrame) -> DataFrame:
    return materials.groupBy(F.upper(F.coalesce("category", F.lit("GENERAL"))).alias("category")).agg(F.count("*").alias("n"))


def duplicates_consolidated(mappings: DataFrame, groups: DataFrame) -> DataFrame:
    per = mappings.where("status = 'CONFIRMED'").join(groups.where("status IN ('PROPOSED', 'ACTIVE')").select("group_id"), "group_id").groupBy("group_id").agg(F.count("*").alias("n")).where("n > 1")
    return per.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("consolidated"))


def deduplication_rate(mappings: DataFrame, groups: DataFrame) -> DataFrame:
    reviewed = mappings.agg(count_where(F.col("status").isin("CONFIRMED", "REJECTED")).alias("reviewed"))
    rate = F.when(F.col("reviewed") == 0, 0.0).otherwise(F.floor(F.col("consolidated") / F.col("reviewed") * 1000 + 0.5) / 10)
    return duplicates_consolidated(mappings, groups).join(F.broadcast(reviewed)).select("consolidated", "reviewed", rate.alias("rate"))


def mapped_percent(breakdown: DataFrame) -> DataFrame:
    return breakdown.withColumn("percent", F.when(F.col("materials") == 0, 0).otherwise(F.floor(100 * F.col("mapped") / F.col("materials") + 0.5)).cast("long"))


def group_summary(mappings: DataFrame, materials: DataFrame) -> DataFrame:
    rows = mappings.join(materials.select("material_id", "enterprise"), "material_id")
    out = rows.groupBy("group_id").agg(count_where(F.col("status") == "CONFIRMED").alias("confirmed"), F.count_distinct(F.when(F.col("status") == "CONFIRMED", F.col("enterprise"))).alias("enterprises"))
    return out.withColumn("state", F.when(F.col("confirmed") > 0, "HARMONIZED").otherwise("PENDING_REVIEW"))


def next_serials(groups: DataFrame) -> DataFrame:
    """A null category is a class of its own."""
    return groups.groupBy("category").agg(F.max("code_serial").alias("last_serial")).withColumn("next_serial", F.coalesce("last_serial", F.lit(0)) + 1)


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    return pairs.groupBy("truth").pivot("predicted", labels).agg(F.count(F.lit(1))).na.fill(0)


def classification_report(pairs: DataFrame) -> DataFrame:
    """truth, predicted -> precision, recall, f1 and support of each label; 0 where there is nothing to divide by."""
    cells = pairs.groupBy("truth", "predicted").agg(F.count("*").alias("n"))
    long = cells.select(F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.lit(0).cast("long").alias("hit")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")))).alias("x")).select("x.*")
    sums = long.groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    out = sums.withColumns({"precision": ratio(F.col("hit"), F.col("said")), "recall": ratio(F.col("hit"), F.col("support"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "precision", "recall", "f1", "support")


def binary_metrics(pairs: DataFrame, positive: list[str]) -> DataFrame:
    t, p = F.col("truth").isin(positive), F.col("predicted").isin(positive)
    out = pairs.agg(count_where(t & p).alias("tp"), count_where(~t & p).alias("fp"), count_where(t & ~p).alias("fn"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def false_merge_rate(pairs: DataFrame, positive: list[str], negative: list[str]) -> DataFrame:
    rows = pairs.where(F.col("truth").isin(negative))
    return rows.agg(F.coalesce(F.avg(F.col("predicted").isin(positive).cast("int")), F.lit(0.0)).alias("false_merge_rate"), F.count("*").alias("n"))


def threshold_sweep(scored: DataFrame, low: int = 30, high: int = 95) -> DataFrame:
    """score (hundredths are enough), is_same -> precision, recall, f1 at each threshold.  Rows are first counted by
    hundredth; only those counts meet the thresholds, and a running sum takes the place of a product."""
    bins = scored.groupBy(F.floor(F.col("score") * 100 + 1e-9).cast("int").alias("h")).agg(count_where(F.col("is_same")).alias("same"), F.count("*").alias("n"))
    grid = scored.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("h"), F.lit(0).cast("long").alias("same"), F.lit(0).cast("long").alias("n"))
    both = bins.withColumn("grid", F.lit(False)).unionByName(grid.withColumn("grid", F.lit(True))).groupBy("h").agg(F.sum("same").alias("same"), F.sum("n").alias("n"), F.max("grid").alias("grid"))
    w = Window.orderBy(F.desc("h"))  # at most 101 hundredths
    run = both.withColumns({"tp": F.sum("same").over(w), "said": F.sum("n").over(w)}).withColumn("all", F.sum("same").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    out = run.where("grid").select((F.col("h") / 100).alias("threshold"), ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("all")).alias("recall"))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def policy_faults(policy: DataFrame) -> DataFrame:
    ok = (F.col("review_threshold") >= 0) & (F.col("review_threshold") < F.col("auto_threshold")) & (F.col("auto_threshold") <= 1) & F.col("min_margin").between(0, 1)
    return policy.agg(count_where(~ok).alias("violations"), F.count("*").alias("policies"))


def price_spread(mappings: DataFrame, materials: DataFrame) -> DataFrame:
    """Spread of prices inside each group's confirmed members, over enterprises."""
    rows = mappings.where("status = 'CONFIRMED'").select("group_id", "material_id").distinct().join(materials.select("material_id", "enterprise", "nominal_price"), "material_id")
    out = rows.groupBy("group_id").agg(F.min("nominal_price").alias("low"), F.max("nominal_price").alias("high"), F.count_distinct("enterprise").alias("enterprises"))
    return out.withColumn("spread", F.col("high") - F.col("low"))
