"""Filters, searches and small projections of the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import tier


def has(column: str, q: str) -> Column:
    return F.coalesce(F.lower(F.col(column)).contains(q.lower()), F.lit(False))


def resolve_category(df: DataFrame, column: str = "category") -> DataFrame:
    """Canonical category: exact name whatever the case, else a display name, else GENERAL_MRO."""
    spark = df.sparkSession
    names = spark.createDataFrame([(c.lower(), c) for c in C.COMMODITY_CODES] + [(a, c) for c, al in C.CATEGORY_ALIASES.items() for a in al], "name string, resolved string")
    key = F.lower(F.trim(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"\s+", " ")))
    return df.withColumn("name", key).join(F.broadcast(names), "name", "left").withColumn("resolved", F.coalesce("resolved", F.lit("GENERAL_MRO"))).drop("name")


def infer_category(c: Column) -> Column:
    out = None
    for code, words in C.KEYWORD_RULES:
        hit = F.upper(c).rlike(f"(^|[^A-Z])({'|'.join(words)})([^A-Z]|$)")
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def catalog_search(groups: DataFrame, members: DataFrame, q: str, status: str | None = None, category: str | None = None) -> DataFrame:
    """Groups that match themselves or through a member (group_id, local_code, description); newest first."""
    found = members.where(has("local_code", q) | has("description", q)).select("group_id").distinct().withColumn("member_hit", F.lit(True))
    own = has("canonical_code", q) | has("std_description", q) | has("draft_ref", q)
    out = groups if status is None else groups.where(F.col("status") == status)
    out = out if category is None else out.where(F.col("category") == category)
    return out.join(found, "group_id", "left").where(own | F.col("member_hit").isNotNull()).drop("member_hit").orderBy(F.desc("group_id"))


def material_search(materials: DataFrame, q: str, enterprise_id: int | None = None) -> DataFrame:
    out = materials.where(has("description", q) | has("local_code", q))
    return out if enterprise_id is None else out.where(F.col("enterprise_id") == enterprise_id)


def my_materials(materials: DataFrame, q: str) -> DataFrame:
    return materials.where(has("local_code", q) | has("description", q) | has("specification", q))


def resolve_code(groups: DataFrame, codes: DataFrame) -> DataFrame:
    """codes(code) -> the group by canonical code, else by draft reference; only ACTIVE and SUPERSEDED groups."""
    wanted = codes.select("code", F.upper(F.trim("code")).alias("_key"))
    live = groups.where(F.col("status").isin("ACTIVE", "SUPERSEDED"))
    keys = live.select(F.col("canonical_code").alias("_key"), "group_id", F.lit(1).alias("_kind")).unionByName(live.select(F.col("draft_ref").alias("_key"), "group_id", F.lit(2).alias("_kind")))
    hits = wanted.join(keys.where("_key IS NOT NULL"), "_key")
    w = Window.partitionBy("code").orderBy("_kind", "group_id")
    return hits.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("code", "group_id", F.when(F.col("_kind") == 1, "CODE").otherwise("DRAFT").alias("matched_by"))


def review_queue(mappings: DataFrame, assignments: DataFrame, reviewer_id: int, status: str = "PENDING") -> DataFrame:
    """Mappings (with category) in the reviewer's categories; a reviewer without assignments sees all."""
    own = assignments.where(F.col("reviewer_id") == reviewer_id).select("category").distinct()
    rows = mappings.where(F.col("status") == status)
    return rows if own.isEmpty() else rows.join(F.broadcast(own), "category", "left_semi")


def review_filter(rows: DataFrame, q: str, tier_name: str | None = None, enterprise_id: int | None = None, columns=("local_code", "description", "specification", "category", "enterprise")) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | has(c, q)
    out = rows.where(hit)
    out = out if tier_name is None else out.where(tier(F.col("score").cast("double")) == tier_name)
    return out if enterprise_id is None else out.where(F.col("enterprise_id") == enterprise_id)


def tenant_scope(df: DataFrame, enterprise_id: int | None) -> DataFrame:
    """An operator sees the rows of their own enterprise; None sees all."""
    return df if enterprise_id is None else df.where(F.col("enterprise_id") == enterprise_id)


def page(df: DataFrame, number: int, size: int, key: str, ident: str) -> DataFrame:
    """One page, newest first; number is at least 0, size between 1 and 100."""
    size = max(1, min(100, size))
    return df.orderBy(F.desc(key), F.desc(ident)).offset(max(0, number) * size).limit(size)


def audit_filter(rows: DataFrame, q: str, actions: list[str] | None = None, entities: list[str] | None = None) -> DataFrame:
    out = rows if actions is None else rows.where(F.col("action").isin(actions))
    out = out if entities is None else out.where(F.col("entity_type").isin(entities))
    hit = F.lit(False)
    for c in ("action", "entity_type", "new_value", "old_value"):
        hit = hit | has(c, q)
    for c in ("audit_id", "user_id", "entity_id"):
        hit = hit | F.coalesce(F.col(c).cast("string").contains(q), F.lit(False))
    return out.where(hit)


def repair_routing(mappings: DataFrame) -> DataFrame:
    """Decision source and routing as they follow from status and score."""
    source = F.when(F.col("status") == "PENDING", None).when(F.col("decision_source").isNull(), "LEGACY").otherwise(F.col("decision_source"))
    routing = F.when(F.col("status") == "PENDING", "REVIEW_REQUIRED").when((F.col("status") == "CONFIRMED") & (F.col("decision_source") == "AUTO"), "AUTO_CONFIRM").when(F.col("score") < C.LEAST_MATCH, "NOVEL").otherwise("REVIEW_REQUIRED")
    return mappings.withColumns({"decision_source": source, "routing": routing})


def backfill_surrogates(groups: DataFrame) -> DataFrame:
    """Signature, draft reference and serial for rows without them."""
    digest = F.md5(F.col("group_id").cast("string"))
    return groups.withColumns(
        {
            "signature": F.coalesce("signature", F.upper(F.concat(digest, digest))),
            "draft_ref": F.coalesce("draft_ref", F.concat(F.lit("LEGACY-"), F.lpad(F.col("group_id").cast("string"), 10, "0"))),
            "serial": F.coalesce("code_serial", F.regexp_extract("draft_ref", r"(\d+)$", 1).try_cast("bigint")),
        }
    )
