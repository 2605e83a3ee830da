"""Uploads: reading, header resolution, row rules, and catalog sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.text import parse_price
from ..operators.stats import count_where


def scan_catalog_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All columns as text; first line is the header; values trimmed; quotes doubled inside quotes; lines without
    any value are dropped."""
    df = spark.read.csv(path, header=True, sep=sep, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, enforceSchema=False)
    named = df.toDF(*[c.strip().lower() for c in df.columns])
    return named.where(F.coalesce(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in named.columns]).isNotNull())


def scan_catalog_delimited(spark: SparkSession, path: str) -> DataFrame:
    """csv, tsv or txt: the delimiter is the one that the first line has most of."""
    first = spark.read.text(path).limit(1).collect()
    line = first[0][0] if first else ","
    return scan_catalog_csv(spark, path, max([",", "\t", ";", "|"], key=line.count))


def resolve_header_aliases(df: DataFrame) -> DataFrame:
    """The seven canonical columns: the first non-blank value among a field's aliases, else the value at the field's
    position, else ''.  Both are decided row by row."""
    names = {c.lower(): c for c in df.columns}
    out = []
    for place, (field, aliases) in enumerate(C.HEADER_ALIASES.items()):
        found = [names[a] for a in aliases if a in names] + df.columns[place : place + 1]
        values = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in found]
        out.append(F.coalesce(*values, F.lit("")).alias(field))
    return df.select(*out)


def automap_headers(columns: list[str]) -> dict[str, str]:
    """field -> header: lower case, spaces and dashes as _, substring match; the first header wins a field, and a header
    serves one field."""
    norm = [(c, c.strip().lower().replace(" ", "_").replace("-", "_")) for c in columns]
    out: dict[str, str] = {}
    for field, aliases in C.HEADER_ALIASES.items():
        for c, n in norm:
            if c not in out.values() and any(a == n or a in n for a in aliases):
                out[field] = c
                break
    return out


def infer_enterprise(explicit: Column, code: Column, own: str | None = None) -> Column:
    """The operator's own enterprise, else the given name, else the code's prefix before the first -, else _, else /;
    else GENERAL."""
    if own:
        return F.lit(own.upper())
    given = F.upper(F.trim(explicit))
    named = F.when(given.isNull() | given.isin("", "FROM_CSV", "AUTO_DETECT"), None).otherwise(given)
    prefix = lambda sep: F.nullif(F.regexp_extract(F.trim(code), f"^([^{sep}]{{2,}}){sep}.", 1), F.lit(""))
    usable = lambda p: F.when(~p.rlike(r"^\d+$"), p)
    return F.upper(F.coalesce(named, usable(prefix("-")), usable(prefix("_")), usable(prefix("/")), F.lit("GENERAL")))


def normalise_rows(df: DataFrame, number: Column) -> DataFrame:
    """Canonical upload columns -> typed rows; ``rejected`` marks blank descriptions."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    return df.withColumns(
        {
            "row_number": number.cast("long"),
            "rejected": blank("description"),
            "local_code": F.when(blank("local_code"), F.concat(F.lit("MAT-ROW-"), number.cast("string"))).otherwise(F.trim("local_code")),
            "uom": F.when(blank("uom"), "NOS").otherwise(F.upper(F.trim("uom"))),
            "category": F.when(blank("category"), "GENERAL_MRO").otherwise(F.trim("category")),
            "nominal_price": parse_price("price"),
        }
    )


def upsert_materials(stored: DataFrame, incoming: DataFrame, active: DataFrame, key=("enterprise_id", "local_code")) -> DataFrame:
    """(key, ..., outcome): incoming rows, the last of each key by row_number: SKIPPED if the stored row has an active
    mapping, UPDATED if it has none, else INSERTED."""
    key = list(key)
    w = Window.partitionBy(*key).orderBy(F.desc("row_number"))
    last = incoming.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    known = stored.join(active.select("material_id").distinct().withColumn("mapped", F.lit(True)), "material_id", "left").groupBy(*key).agg(F.max("mapped").alias("mapped"), F.lit(True).alias("stored"))
    out = last.join(known, key, "left")
    return out.withColumn("outcome", F.when(F.col("stored").isNull(), "INSERTED").when(F.col("mapped"), "SKIPPED").otherwise("UPDATED")).drop("mapped", "stored")


def counters(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), *[count_where(F.col(column) == v).alias(v.lower()) for v in values])


def diagnostics(rows: DataFrame, most: int = 100) -> DataFrame:
    """Messages of rejected rows; the first hundred by row number (a report)."""
    return rows.where("rejected").select("row_number", F.concat(F.lit("Row "), F.col("row_number").cast("string"), F.lit(": description is blank")).alias("message")).orderBy("row_number").limit(most)


def preflight(df: DataFrame) -> DataFrame:
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    incomplete = blank("description") | blank("local_code")
    unsupported = ~F.upper(F.coalesce("category", F.lit(""))).isin(list(C.COMMODITY_CODES))
    return df.agg(
        F.count("*").alias("total"),
        count_where(~incomplete & ~unsupported).alias("valid"),
        count_where(incomplete).alias("incomplete"),
        count_where(unsupported).alias("unsupported"),
        count_where(blank("specification") | blank("uom")).alias("warnings"),
    )


def cross_reference(materials: DataFrame, active: DataFrame, groups: DataFrame) -> DataFrame:
    """One row for each material, mapped or not."""
    g = groups.select("group_id", "canonical_code", "draft_ref", "std_description", F.col("category").alias("class"), "std_uom")
    out = materials.join(active.select("material_id", "group_id", "status", "tier", "score"), "material_id", "left").join(g, "group_id", "left")
    return out.select(
        "enterprise", "local_code", "description", F.coalesce("canonical_code", F.lit("")).alias("canonical_code"), F.coalesce("draft_ref", F.lit("")).alias("draft_ref"),
        F.coalesce("std_description", F.lit("")).alias("std_description"), F.coalesce("class", F.lit("")).alias("class"), F.coalesce("std_uom", F.lit("")).alias("uom"),
        F.coalesce("status", F.lit("UNMAPPED")).alias("mapping_status"), F.coalesce("tier", F.lit("NONE")).alias("tier"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    )


def master_catalog(groups: DataFrame, mappings: DataFrame, materials: DataFrame) -> DataFrame:
    m = mappings.join(materials.select("material_id", "enterprise"), "material_id").groupBy("group_id").agg(F.count_distinct("enterprise").alias("enterprises"), F.count("*").alias("members"))
    return groups.join(m, "group_id", "left").select("group_id", "canonical_code", "draft_ref", "std_description", "category", "status", F.coalesce("enterprises", F.lit(0)).alias("enterprises"), F.coalesce("members", F.lit(0)).alias("members"))


def erp_template(groups: DataFrame) -> DataFrame:
    return groups.select(F.coalesce("canonical_code", F.lit("")).alias("material"), F.col("std_description").alias("description"), F.col("std_uom").alias("base_uom"), F.col("category").alias("material_class"), F.col("draft_ref").alias("catalog_ref"))


def write_csv(df: DataFrame, path: str, bom: bool = False, quote_all: bool = False) -> None:
    """A folder of CSV parts with headers.  With ``bom`` one small part that begins with a byte order mark (a template for
    one program to open)."""
    out = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]).coalesce(1) if bom else df
    out.write.option("header", True).option("quoteAll", quote_all).option("escape", '"').mode("overwrite").csv(path)


def write_datasets(records: DataFrame, pairs: DataFrame, canonicals: DataFrame, path: str) -> None:
    write_csv(records, f"{path}/records")
    write_csv(pairs, f"{path}/pairs")
    canonicals.write.mode("overwrite").json(f"{path}/canonicals")


def write_metrics_report(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def seed_categories(spark: SparkSession) -> DataFrame:
    """The level-3 categories with codes and default policy."""
    rows = [(name, *parts, C.HIGH, C.MEDIUM, C.MARGIN, True) for name, parts in C.COMMODITY_CODES.items()]
    return spark.createDataFrame(rows, "name string, code_segment string, code_family string, code_class string, auto_threshold double, review_threshold double, min_margin double, auto_enabled boolean")
