"""Labelled pair corpora: neighbours, copies, negatives, equivalents, missing attributes, and leak-free splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions.text import alnum_key, once
from .harmonize import checkpointed
from .joins import top_k

# fixed values: illustrative equivalences (category, one side, other side)
EQUIVALENCE_RULES = [
    ("PIPE", {"material": "CS", "grade": "GrB", "standard": "ASTM A106"}, {"material": "CS", "grade": "GrB", "standard": "IS 1239"}),
    ("VALVE", {"valve_type": "GATE", "body_material": "CS", "standard": "API 600"}, {"valve_type": "GATE", "body_material": "CS", "standard": "IS 780"}),
    ("FLANGE", {"flange_type": "WELDNECK", "material": "CS", "standard": "ASME B16.5"}, {"flange_type": "WELDNECK", "material": "CS", "standard": "IS 6392"}),
    ("CABLE", {"conductor": "COPPER", "standard": "IS 1554"}, {"conductor": "COPPER", "standard": "IS 7098"}),
]


def draw(*cols) -> Column:
    """A fixed pseudo-random order that both engines agree on."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def items(records: DataFrame) -> DataFrame:
    """records(material_id, category, attributes) -> one item for each set of critical attributes: (id, category, crit)."""
    keys = A.keys_of(F.col("category"), 0, 1)
    crit = F.transform(keys, lambda k: F.concat(k, F.lit("="), F.coalesce(F.try_element_at("attributes", k), F.lit(""))))
    return once(records, crit=crit).groupBy("category", "crit").agg(F.min("material_id").alias("id"))


def attribute_neighbours(canon: DataFrame, k: int = 2) -> DataFrame:
    """(id, other, attribute): items of one category that differ in exactly one critical attribute, at most k for an item.
    Each item is keyed by what is left without one attribute; equal keys meet in a join."""
    left_out = canon.select("id", "category", F.posexplode("crit").alias("pos", "own"), "crit")
    keyed = left_out.select("id", F.substring_index("own", "=", 1).alias("attribute"), "own", "category", F.array_join(F.array_except("crit", F.array("own")), ";").alias("rest"))
    other = keyed.select(F.col("id").alias("other"), "attribute", F.col("own").alias("their"), "category", "rest")
    hits = keyed.join(other, ["category", "attribute", "rest"]).where("own <> their")
    return top_k(hits, "id", [draw("id", "other"), "other"], k).select("id", "other", "attribute")


def within_group_pairs(rows: DataFrame, group: str, members: int = 4) -> DataFrame:
    """Pairs a < b inside a group: all of its first ``members`` rows in drawn order, so six pairs for four (a sample)."""
    few = top_k(rows.where(F.col(group).isNotNull()), group, [draw("material_id"), "material_id"], members).select(group, "material_id")
    return few.withColumnRenamed("material_id", "a").join(few.withColumnRenamed("material_id", "b"), group).where("a < b").select(group, "a", "b")


def negative_pairs(rows: DataFrame, block: str, other: str, most: int, seed: int = 42) -> DataFrame:
    """Pairs of rows with equal ``block`` and different ``other``: each row draws one of 64 cells of its block and pairs with
    the next row of the cell; at most ``most`` in drawn order (a sample)."""
    cells = rows.select(block, other, "material_id").withColumn("h", draw("material_id", F.lit(str(seed))))
    w = Window.partitionBy(block, F.translate(F.substring("h", 1, 2), "4567cdef", "012389ab")).orderBy("h", "material_id")
    nxt = cells.withColumns({"b": F.lead("material_id").over(w), "their": F.lead(other).over(w)})
    return nxt.where(F.col("b").isNotNull() & ~F.col(other).eqNullSafe(F.col("their"))).orderBy("h", "material_id").limit(most).select(F.col("material_id").alias("a"), "b")


def equivalence_twins(records: DataFrame, rules=EQUIVALENCE_RULES) -> DataFrame:
    """(a, b): items that fit both sides of a rule and agree in all other attributes; records(material_id, category, attributes)."""
    squeeze = lambda c: F.replace(F.upper(c), F.lit(" "), F.lit(""))
    found = []
    for category, left, right in rules:
        rest = F.array_join(F.array_sort(F.transform(F.map_entries(F.map_filter("attributes", lambda k, v: ~k.isin(*left, *right))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
        rows = once(records.where(F.col("category") == category).select("material_id", "attributes"), rest=rest)
        fit = lambda side: reduce(lambda x, y: x & y, [squeeze(F.try_element_at("attributes", F.lit(k))) == v.upper().replace(" ", "") for k, v in side.items()])  # noqa: B023, E731
        x, y = rows.where(fit(left)).groupBy("rest").agg(F.min("material_id").alias("a")), rows.where(fit(right)).groupBy("rest").agg(F.min("material_id").alias("b"))
        found.append(x.join(y, "rest").select("a", "b"))
    return reduce(DataFrame.unionByName, found)


def missing_attribute_pairs(records: DataFrame) -> DataFrame:
    """(a, b, attribute): a full record and one that agrees but lacks exactly one critical attribute."""
    canon = items(records)
    part = canon.select("id", "category", F.filter("crit", lambda c: ~c.endswith("=")).alias("has"), F.filter("crit", lambda c: c.endswith("=")).alias("lacks"))
    full = part.where("size(lacks) = 0").select(F.col("id").alias("a"), "category", F.explode("has").alias("own"), "has")
    full = full.select("a", "category", F.substring_index("own", "=", 1).alias("attribute"), F.array_join(F.array_except("has", F.array("own")), ";").alias("rest"))
    bare = part.where("size(lacks) = 1").select(F.col("id").alias("b"), "category", F.substring_index(F.element_at("lacks", 1), "=", 1).alias("attribute"), F.array_join("has", ";").alias("rest"))
    return full.join(bare, ["category", "attribute", "rest"]).select("a", "b", "attribute")


def broken_references(pairs: DataFrame, records: DataFrame) -> DataFrame:
    ids = records.select(F.col("material_id").alias("_id"))
    return pairs.join(ids, F.col("a") == F.col("_id"), "left_anti").unionByName(pairs.join(ids, F.col("b") == F.col("_id"), "left_anti")).distinct()


def split(ids: DataFrame, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """(id, part) by where the id's hash falls; the share of ids follows the cut points at any size."""
    return ids.select("id", part(F.col("id").cast("string"), train, validation).alias("part"))


def part(key: Column, train: float = 0.70, validation: float = 0.15) -> Column:
    """train, val or test by where the hash of ``key`` falls; a null key is held out (test)."""
    place = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / 2**32
    return F.when(place < train, "train").when(place < train + validation, "val").otherwise("test")


def text_part(description: str = "description") -> Column:
    """The part of a record by its text, so that equal texts (but for case and punctuation) are never on both sides."""
    return part(alnum_key(F.col(description)))


def split_pairs(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """pairs with part: kept only if both ids are in it, else 'cross'."""
    x, y = parts.select(F.col("id").alias("a"), F.col("part").alias("pa")), parts.select(F.col("id").alias("b"), F.col("part").alias("pb"))
    return pairs.join(x, "a").join(y, "b").withColumn("part", F.when(F.col("pa") == F.col("pb"), F.col("pa")).otherwise("cross")).drop("pa", "pb")


def corpus(records: DataFrame, same: int = 6000, other: int = 2000) -> DataFrame:
    """(a, b, label) of the six families; records(material_id, category, description, specification, attributes)."""
    records = checkpointed(records)  # every family reads it
    key = records.select("material_id", alnum_key(F.concat("description", "specification")).alias("key"))
    canon = checkpointed(items(records))
    names = lambda i: F.when(F.array_contains(A.keys_of(F.col("category"), 0), F.col(i)), "NOT_A_MATCH").otherwise("VARIANT")
    near = attribute_neighbours(canon).join(canon.select("id", "category"), "id").select(F.col("id").alias("a"), F.col("other").alias("b"), names("attribute").alias("label"))
    crit = once(records, crit=F.array_join(F.transform(A.keys_of(F.col("category"), 0, 1), lambda k: F.coalesce(F.try_element_at("attributes", k), F.lit(""))), ";")).withColumn("item", F.concat_ws("|", "category", "crit"))
    within = within_group_pairs(crit, "item").join(key.select(F.col("material_id").alias("a"), F.col("key").alias("ka")), "a").join(key.select(F.col("material_id").alias("b"), F.col("key").alias("kb")), "b")
    within = within.select("a", "b", F.when(F.col("ka") == F.col("kb"), "EXACT_DUPLICATE").otherwise("NEAR_DUPLICATE").alias("label"))
    no = lambda d: d.select("a", "b", F.lit("NOT_A_MATCH").alias("label"))
    parts = [near, within, no(negative_pairs(crit, "category", "item", same)), no(negative_pairs(crit.withColumn("all", F.substring(draw("material_id"), 1, 1)), "all", "category", other)),
             equivalence_twins(records).select("a", "b", F.lit("FUNCTIONALLY_EQUIVALENT").alias("label")), missing_attribute_pairs(records).select("a", "b", F.lit("NEEDS_REVIEW").alias("label"))]
    return reduce(DataFrame.unionByName, parts)
