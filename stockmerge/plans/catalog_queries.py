"""Sources, searches, joins, statistics and rankings over the catalog views."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import attributes as A
from ..functions import text as X
from ..operators import joins as J
from ..operators import search as S
from ..operators import stats as D
from ..sources import ingest as I
from ..operators.harmonize import shared_folder
from .registry import query
from .text_queries import CRITICAL, FLAT, GRAMS, MATERIAL, SIGNATURE, SIZE

MEMBERS = "SELECT group_id, local_code, description, material.category AS category, enterprise, mapping_id, mapping.material_id AS material_id FROM mapping JOIN material ON mapping.material_id = material.material_id"
has = lambda c, q: f"coalesce(contains(lower({c}), '{q}'), false)"


def members(t):
    return t.mapping.join(t.material.select("material_id", "local_code", "description", "category", "enterprise"), "material_id")


# --- sources and sinks
def scratch(t, name: str) -> str:
    """A new folder below the one that all executors share."""
    return f"{shared_folder(t.spark)}/{name}-{uuid4().hex}"


FIELDS = ["local_code", "description", "specification", "uom", "category"]


def drop_files(t, sep: str) -> str:
    """The catalog as files with the headers of an upload."""
    path = scratch(t, "upload")
    t.catalog.select(*FIELDS).toDF("Mat_No", "Short_Text", "Spec_Grade", "Base_UOM", "Matkl").write.option("header", True).option("sep", sep).option("escape", '"').csv(path)
    return path


SCANNED = "SELECT local_code AS mat_no, description AS short_text, nullif(specification, '') AS spec_grade, uom AS base_uom, category AS matkl FROM catalog"


@query("a01_scan_catalog_csv", SCANNED)
def _(t):
    return I.scan_catalog_csv(t.spark, drop_files(t, ","))


@query("a02_scan_catalog_delimited", SCANNED)
def _(t):
    return I.scan_catalog_delimited(t.spark, drop_files(t, ";"))


@query("a05_automap_headers", "SELECT local_code, description, coalesce(specification, '') AS specification, uom, category FROM catalog")
def _(t):
    raw = I.scan_catalog_csv(t.spark, drop_files(t, "|"), "|")
    found = I.automap_headers(raw.columns)
    return raw.select(*[F.coalesce(F.col(found[c]), F.lit("")).alias(c) for c in FIELDS])


@query("a18_write_datasets", "SELECT 'records' AS part, count(*) AS n FROM catalog UNION ALL SELECT 'pairs', count(*) FROM pairs UNION ALL SELECT 'canonicals', count(*) FROM (SELECT DISTINCT category, description FROM catalog)")
def _(t):
    path = scratch(t, "datasets")
    I.write_datasets(t.catalog, t.pairs, t.catalog.groupBy("category", "description").agg(F.min("material_id").alias("id")), path)
    read = {"records": I.scan_catalog_csv(t.spark, f"{path}/records"), "pairs": I.scan_catalog_csv(t.spark, f"{path}/pairs"), "canonicals": t.spark.read.json(f"{path}/canonicals")}
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, d in read.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("a19_write_metrics_report", "SELECT category, count(*) AS n, count(DISTINCT description) AS distinct_descriptions FROM catalog GROUP BY 1")
def _(t):
    path = scratch(t, "metrics")
    I.write_metrics_report(t.catalog.groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("description").alias("distinct_descriptions")), path)
    return t.spark.read.schema("category string, n long, distinct_descriptions long").json(path)


@query("a03_count_records", "SELECT count(*) AS n FROM catalog")
def _(t):
    return t.catalog.agg(F.count("*").alias("n"))


def upload(t):
    """Customer rows as a messy upload: odd blanks in code, unit and category."""
    blank = lambda c, n: F.when(F.col("material_id") % n == 0, " ").otherwise(c)
    return t.material.select(
        "material_id", F.lit("").alias("enterprise"), blank(F.col("local_code"), 6).alias("local_code"), blank(F.col("description"), 11).alias("description"), "specification",
        blank(F.lit(" each "), 4).alias("uom"), blank(F.col("category"), 5).alias("category"), F.concat(F.lit("Rs. "), F.col("nominal_price").cast("string"), F.lit(" /-")).alias("price"),
    )


UPLOAD = """SELECT material_id, CASE WHEN material_id % 6 = 0 THEN ' ' ELSE local_code END AS local_code, CASE WHEN material_id % 11 = 0 THEN ' ' ELSE description END AS description, specification,
  CASE WHEN material_id % 4 = 0 THEN ' ' ELSE ' each ' END AS uom, CASE WHEN material_id % 5 = 0 THEN ' ' ELSE category END AS category, nominal_price FROM material"""


@query(
    "a04_resolve_header_aliases",
    f"SELECT '' AS enterprise, trim(local_code) AS local_code, trim(description) AS description, specification, trim(uom) AS uom, trim(category) AS category, 'Rs. ' || nominal_price::VARCHAR || ' /-' AS price FROM ({UPLOAD}) u",
)
def _(t):
    u = upload(t).drop("material_id")
    return I.resolve_header_aliases(u.toDF("cpse", "matnr", "short_text", "spec_grade", "base_uom", "matkl", "rate"))


@query(
    "a06_normalise_ingest_rows",
    f"""SELECT material_id AS row_number, trim(description) = '' AS rejected, CASE WHEN trim(local_code) = '' THEN 'MAT-ROW-' || material_id::VARCHAR ELSE trim(local_code) END AS local_code,
    CASE WHEN trim(uom) = '' THEN 'NOS' ELSE upper(trim(uom)) END AS uom, CASE WHEN trim(category) = '' THEN 'GENERAL_MRO' ELSE category END AS category FROM ({UPLOAD}) u""",
)
def _(t):
    return I.normalise_rows(upload(t), F.col("material_id")).select("row_number", "rejected", "local_code", "uom", "category")


@query(
    "a07_infer_enterprise",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) WHEN p_partkey % 4 = 1 THEN upper(split_part(p_type, '-', 1)) WHEN p_partkey % 4 = 2 THEN 'GENERAL' ELSE upper(split_part(p_type, '_', 1)) END AS enterprise FROM part""",
)
def _(t):
    p = t.part
    k = F.col("p_partkey") % 4
    given = F.when(k == 0, F.col("p_name")).when(k == 1, "AUTO_DETECT").otherwise("")
    code = F.when(k == 1, F.concat("p_type", F.lit("-1"))).when(k == 2, F.concat(F.lit("12-"), "p_type")).otherwise(F.concat("p_type", F.lit("_9")))
    return p.select("p_partkey", I.infer_enterprise(given, code).alias("enterprise"))


@query("a08_parse_price", "SELECT material_id, CASE WHEN material_id % 9 = 0 THEN NULL ELSE nominal_price END AS price FROM catalog")
def _(t):
    raw = F.when(F.col("material_id") % 9 == 0, "on request").otherwise(F.concat(F.lit("INR "), F.format_number("nominal_price", 2)))
    return t.catalog.select("material_id", X.parse_price(raw).alias("price"))


@query(
    "a09_upsert_materials",
    """WITH inc AS (SELECT material_id AS row_number, enterprise_id, CASE WHEN material_id % 3 = 0 THEN 'NEW-' || (material_id % 50)::VARCHAR ELSE local_code END AS local_code FROM material),
    last AS (SELECT enterprise_id, local_code, max(row_number) AS row_number FROM inc GROUP BY 1, 2)
    SELECT last.*, CASE WHEN m.material_id IS NULL THEN 'INSERTED' WHEN a.material_id IS NOT NULL THEN 'SKIPPED' ELSE 'UPDATED' END AS outcome
    FROM last LEFT JOIN material m ON m.enterprise_id = last.enterprise_id AND m.local_code = last.local_code LEFT JOIN active a ON a.material_id = m.material_id""",
)
def upserts(t):
    code = F.when(F.col("material_id") % 3 == 0, F.concat(F.lit("NEW-"), (F.col("material_id") % 50).cast("string"))).otherwise(F.col("local_code"))
    incoming = t.material.select(F.col("material_id").alias("row_number"), "enterprise_id", code.alias("local_code"))
    return I.upsert_materials(t.material.select("material_id", "enterprise_id", "local_code"), incoming, t.active)


@query("a10_ingest_counters", "SELECT count(*) AS total, count(*) FILTER (WHERE status = 'CONFIRMED') AS confirmed, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'REJECTED') AS rejected FROM mapping")
def _(t):
    return I.counters(t.mapping, "status", ["CONFIRMED", "PENDING", "REJECTED"])


@query("a11_row_diagnostics", f"SELECT material_id AS row_number, 'Row ' || material_id::VARCHAR || ': description is blank' AS message FROM ({UPLOAD}) u WHERE trim(description) = '' ORDER BY 1 LIMIT 100")
def _(t):
    return I.diagnostics(I.normalise_rows(upload(t), F.col("material_id")))


@query(
    "a12_preflight_profile",
    """SELECT count(*) AS total, count(*) FILTER (WHERE trim(description) <> '' AND category <> 'VALVE') AS valid, count(*) FILTER (WHERE trim(description) = '') AS incomplete, count(*) FILTER (WHERE category = 'VALVE') AS unsupported,
    count(*) FILTER (WHERE specification = '') AS warnings FROM catalog""",
)
def _(t):
    return I.preflight(t.catalog.withColumn("category", F.when(F.col("category") == "VALVE", "VALVES?").otherwise(F.col("category"))))


@query("a13_canonical_csv", f"SELECT trim(local_code) AS local_code, trim(description) AS description, specification, CASE WHEN trim(uom) = '' THEN 'NOS' ELSE 'EACH' END AS uom, CASE WHEN trim(category) = '' THEN 'GENERAL_MRO' ELSE category END AS category FROM ({UPLOAD}) u WHERE trim(description) <> '' AND trim(local_code) <> ''")
def _(t):
    rows = I.normalise_rows(I.resolve_header_aliases(upload(t).drop("material_id")), F.lit(0)).where("NOT rejected AND local_code NOT LIKE 'MAT-ROW-%'")
    return rows.select("local_code", "description", "specification", "uom", "category")


@query(
    "a14_export_cross_reference",
    """SELECT enterprise, local_code, description, coalesce(canonical_code, '') AS canonical_code, coalesce(draft_ref, '') AS draft_ref, coalesce(std_description, '') AS std_description, coalesce(g.category, '') AS class, coalesce(std_uom, '') AS uom,
    coalesce(a.status, 'UNMAPPED') AS mapping_status, coalesce(tier, 'NONE') AS tier, coalesce(score::DOUBLE, 0.0) AS score FROM material m LEFT JOIN active a ON a.material_id = m.material_id LEFT JOIN material_group g ON g.group_id = a.group_id""",
)
def _(t):
    return I.cross_reference(t.material, t.active, t.material_group)


@query(
    "a15_export_master_catalog",
    f"""SELECT g.group_id, canonical_code, draft_ref, std_description, g.category, status, count(DISTINCT enterprise) AS enterprises, count(m.mapping_id) AS members
    FROM material_group g LEFT JOIN ({MEMBERS}) m ON m.group_id = g.group_id GROUP BY ALL""",
)
def _(t):
    return I.master_catalog(t.material_group, t.mapping, t.material)


@query("a16_export_erp_template", "SELECT coalesce(canonical_code, '') AS material, std_description AS description, std_uom AS base_uom, category AS material_class, draft_ref AS catalog_ref FROM material_group")
def _(t):
    return I.erp_template(t.material_group)


@query("a17_export_audit_csv", "SELECT audit_id, action, entity_type, replace(new_value, '\"', '\"\"') AS new_value FROM audit WHERE action = 'purchase'")
def _(t):
    rows = S.audit_filter(t.audit, "", actions=["purchase"])
    return rows.select("audit_id", "action", "entity_type", F.replace("new_value", F.lit('"'), F.lit('""')).alias("new_value"))


@query("a20_seed_dimensions", "SELECT name, count(material_id) AS materials, max(v.code) AS code FROM (VALUES " + ", ".join(f"('{k}', '{'-'.join(v)}')" for k, v in C.COMMODITY_CODES.items()) + ") v(name, code) LEFT JOIN catalog ON category = name GROUP BY name")
def _(t):
    d = I.seed_categories(t.spark).select("name", F.concat_ws("-", "code_segment", "code_family", "code_class").alias("code"))
    n = t.catalog.groupBy(F.col("category").alias("name")).agg(F.count("*").alias("materials"))
    return F.broadcast(d).join(n, "name", "left").select("name", F.coalesce("materials", F.lit(0)).alias("materials"), "code")


# --- searches
ALIAS = "CASE lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) " + " ".join(f"WHEN '{a}' THEN '{c}'" for c, al in C.CATEGORY_ALIASES.items() for a in al) + " " + " ".join(f"WHEN '{c.lower()}' THEN '{c}'" for c in C.COMMODITY_CODES) + " ELSE 'GENERAL_MRO' END"
RAW = "SELECT material_id, CASE material_id % 3 WHEN 0 THEN lower(category) || ' ' WHEN 1 THEN CASE category WHEN 'PIPE' THEN 'Pipes  &  Tubes' WHEN 'MOTOR' THEN 'Electric Motors' ELSE category END ELSE category || '?' END AS raw FROM catalog"


@query("b01_resolve_category", f"SELECT material_id, {ALIAS} AS resolved FROM ({RAW}) r")
def _(t):
    k, c = F.col("material_id") % 3, F.col("category")
    raw = F.when(k == 0, F.concat(F.lower(c), F.lit(" "))).when(k == 1, F.when(c == "PIPE", "Pipes  &  Tubes").when(c == "MOTOR", "Electric Motors").otherwise(c)).otherwise(F.concat(c, F.lit("?")))
    return S.resolve_category(t.catalog.select("material_id", raw.alias("category"))).select("material_id", "resolved")


@query("b02_infer_category_keywords", "SELECT material_id, CASE " + " ".join(f"WHEN regexp_matches(upper(description), '(^|[^A-Z])({w})([^A-Z]|$)') THEN '{c}'" for c, words in C.KEYWORD_RULES for w in ['|'.join(words)]) + " END AS inferred FROM catalog")
def _(t):
    return t.catalog.select("material_id", S.infer_category(F.col("description")).alias("inferred"))


@query("b03_catalog_search", f"SELECT group_id, status FROM material_group g WHERE status = 'ACTIVE' AND ({has('canonical_code', '12')} OR {has('std_description', '12')} OR {has('draft_ref', '12')} OR EXISTS (SELECT 1 FROM ({MEMBERS}) m WHERE m.group_id = g.group_id AND ({has('local_code', '12')} OR {has('description', '12')})))")
def _(t):
    return S.catalog_search(t.material_group, members(t).select("group_id", "local_code", "description"), "12", status="ACTIVE").select("group_id", "status")


@query("b04_material_search", f"SELECT material_id FROM catalog WHERE enterprise_id = 2 AND ({has('description', 'flange')} OR {has('local_code', 'flange')})")
def _(t):
    return S.material_search(t.catalog, "Flange", 2).select("material_id")


@query("b05_my_materials_search", f"SELECT material_id FROM catalog WHERE {has('description', '12')} OR {has('local_code', '12')} OR {has('specification', '12')}")
def _(t):
    return S.my_materials(t.catalog, "12").select("material_id")


CODES = "SELECT CASE WHEN group_id % 2 = 0 THEN ' ' || lower(coalesce(canonical_code, draft_ref)) ELSE draft_ref END AS code FROM material_group"


@query("b06_resolve_code", f"SELECT code, group_id, CASE WHEN upper(trim(code)) = canonical_code THEN 'CODE' ELSE 'DRAFT' END AS matched_by FROM ({CODES}) c JOIN material_group g ON status IN ('ACTIVE', 'SUPERSEDED') AND (upper(trim(code)) = canonical_code OR upper(trim(code)) = draft_ref)")
def _(t):
    code = F.when(F.col("group_id") % 2 == 0, F.concat(F.lit(" "), F.lower(F.coalesce("canonical_code", "draft_ref")))).otherwise(F.col("draft_ref"))
    return S.resolve_code(t.material_group, t.material_group.select(code.alias("code")))


QUEUE = "SELECT mapping_id FROM mapping JOIN material ON mapping.material_id = material.material_id WHERE status = 'PENDING'"


@query("b07_review_queue", f"SELECT mapping_id, 1 AS reviewer FROM ({QUEUE} AND category IN ('BUILDING', 'FURNITURE')) q UNION ALL SELECT mapping_id, 5 AS reviewer FROM ({QUEUE}) q")
def _(t):
    rows = members(t)
    return S.review_queue(rows, t.assignment, 1).select("mapping_id", F.lit(1).alias("reviewer")).unionByName(S.review_queue(rows, t.assignment, 5).select("mapping_id", F.lit(5).alias("reviewer")))


@query("b08_review_queue_filter", f"SELECT mapping_id FROM mapping JOIN material ON mapping.material_id = material.material_id WHERE enterprise_id = 3 AND score >= 0.85 AND ({has('description', '3')} OR {has('local_code', '3')} OR {has('enterprise', '3')} OR {has('category', '3')})")
def _(t):
    return S.review_filter(t.mapping.join(t.material.drop("nominal_price"), "material_id"), "3", "HIGH", 3, ("local_code", "description", "enterprise", "category")).select("mapping_id")


@query("b09_tenant_scope", "SELECT material_id, local_code FROM material WHERE enterprise_id = 7")
def _(t):
    return S.tenant_scope(t.material, 7).select("material_id", "local_code")


@query("b10_catalog_categories", "SELECT DISTINCT category FROM material_group WHERE status = 'ACTIVE'")
def _(t):
    return t.material_group.where("status = 'ACTIVE'").select("category").distinct().orderBy("category")


@query("b11_high_confidence_pending", "SELECT mapping_id FROM mapping WHERE status = 'PENDING' AND tier = 'HIGH'")
def _(t):
    return t.mapping.where("status = 'PENDING' AND tier = 'HIGH'").select("mapping_id")


@query("b12_confidence_tier", "SELECT mapping_id, CASE WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM mapping")
def _(t):
    return t.mapping.select("mapping_id", X.tier(F.col("score")).alias("tier"))


@query("b13_audit_log_filter", f"SELECT audit_id FROM audit WHERE action IN ('click', 'purchase') AND entity_type IN ('MATERIAL', 'GROUP') AND ({has('action', '42')} OR {has('entity_type', '42')} OR {has('new_value', '42')} OR contains(audit_id::VARCHAR, '42') OR contains(user_id::VARCHAR, '42') OR contains(entity_id::VARCHAR, '42'))")
def _(t):
    return S.audit_filter(t.audit, "42", ["click", "purchase"], ["MATERIAL", "GROUP"]).select("audit_id")


@query("b14_entity_history", "SELECT audit_id, ts FROM audit WHERE entity_type = 'MATERIAL' AND entity_id = 8")
def _(t):
    return t.audit.where("entity_type = 'MATERIAL' AND entity_id = 8").orderBy(F.desc("ts")).select("audit_id", "ts")


@query("b15_page", "SELECT mapping_id, (SELECT count(*) FROM mapping) AS total FROM mapping ORDER BY created_at DESC, mapping_id DESC LIMIT 100 OFFSET 200")
def _(t):
    return S.page(t.mapping, 2, 1000, "created_at", "mapping_id").select("mapping_id").join(F.broadcast(t.mapping.agg(F.count("*").alias("total"))))


@query("b16_repair_routing_metadata", """SELECT mapping_id, CASE WHEN status = 'PENDING' THEN NULL ELSE decision_source END AS decision_source,
  CASE WHEN status = 'PENDING' THEN 'REVIEW_REQUIRED' WHEN status = 'CONFIRMED' AND decision_source = 'AUTO' THEN 'AUTO_CONFIRM' WHEN score < 0.3 THEN 'NOVEL' ELSE 'REVIEW_REQUIRED' END AS routing FROM mapping""")  # fmt: skip
def _(t):
    return S.repair_routing(t.mapping).select("mapping_id", "decision_source", "routing")


@query("b17_backfill_surrogates", "SELECT group_id, coalesce(signature, upper(md5(group_id::VARCHAR) || md5(group_id::VARCHAR))) AS signature, draft_ref, coalesce(code_serial, regexp_extract(draft_ref, '(\\d+)$', 1)::BIGINT) AS serial FROM material_group")
def _(t):
    return S.backfill_surrogates(t.material_group).select("group_id", "signature", "draft_ref", "serial")


# --- joins
KEYED = f"SELECT material_id, category, description, coalesce(CAST({SIZE} AS VARCHAR), '') AS dimension, coalesce({MATERIAL}, '') AS material_type FROM catalog"
SIM = f"(len(list_intersect({GRAMS('a.description')}, {GRAMS('b.description')})) / len(list_distinct(list_concat({GRAMS('a.description')}, {GRAMS('b.description')}))))"


def keyed(t):
    full = A.full_text()
    return t.catalog.select("material_id", "category", "description", F.coalesce(A.size_mm(full).cast("string"), F.lit("")).alias("dimension"), F.coalesce(A.material_type(full), F.lit("")).alias("material_type"))


@query(
    "c01_candidate_retrieval",
    f"""WITH k AS ({KEYED}), u AS (SELECT DISTINCT category, description, dimension, material_type FROM k),
    s AS (SELECT a.category, a.description AS da, a.dimension AS xa, a.material_type AS ma, b.description AS db, b.dimension AS xb, b.material_type AS mb, {SIM} AS similarity,
      (a.dimension <> '' AND a.dimension = b.dimension)::INT AS d, (a.material_type <> '' AND a.material_type = b.material_type)::INT AS m FROM u a JOIN u b ON a.category = b.category),
    p AS (SELECT x.material_id, y.material_id AS candidate_id, similarity, 0.35::DOUBLE * d + 0.20::DOUBLE * m + similarity AS score FROM s
      JOIN k x ON x.category = s.category AND x.description = da AND x.dimension = xa AND x.material_type = ma JOIN k y ON y.category = s.category AND y.description = db AND y.dimension = xb AND y.material_type = mb
      WHERE x.material_id <> y.material_id AND (similarity >= 0.3 OR d + m > 0))
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY score DESC, candidate_id DESC) AS rank FROM p) WHERE rank <= 50""",
)
def candidates(t):
    return J.candidate_retrieval(keyed(t))


@query("c02_candidate_fallback", "SELECT * FROM (SELECT a.material_id, b.material_id AS candidate_id, row_number() OVER (PARTITION BY a.material_id ORDER BY b.material_id) AS rank FROM (SELECT *, CASE WHEN material_id % 10 = 0 THEN NULL ELSE category END AS c FROM catalog) a JOIN catalog b ON (a.c IS NULL OR a.c = b.category) AND a.material_id <> b.material_id) WHERE rank <= 50")
def _(t):
    c = t.catalog.select("material_id", "category")
    return J.candidate_fallback(c.withColumn("category", F.when(F.col("material_id") % 10 != 0, F.col("category"))), c).select("material_id", "candidate_id", "rank")


@query("c03_category_block_join", """WITH c AS (SELECT upper(category) AS block, description, min(material_id) AS representative, count(*) AS members FROM catalog GROUP BY 1, 2)
  SELECT c.block, 'member' AS kind, representative, material_id AS other, members - 1 AS links FROM catalog m JOIN c ON c.block = upper(m.category) AND c.description = m.description
  UNION ALL SELECT x.block, 'pair', x.representative, y.representative, x.members * y.members FROM c x JOIN c y ON x.block = y.block AND x.representative < y.representative""")  # fmt: skip
def _(t):
    return J.category_links(t.catalog)


@query("c04_signature_match_join", f"SELECT s.material_id, s.signature, g.group_id FROM ({SIGNATURE}) s JOIN (SELECT signature, min(material_id) AS group_id FROM ({SIGNATURE}) x WHERE signature IS NOT NULL GROUP BY 1) g ON g.signature = s.signature")
def _(t):
    c = A.extract_attributes(t.catalog)
    s = c.select("material_id", A.attribute_signature(F.col("attributes"), F.col("category")).alias("signature"))
    return J.signature_match(s, s.withColumnRenamed("material_id", "group_id")).select("material_id", "signature", "group_id")


@query("c05_active_mapping_join", "SELECT m.material_id, a.mapping_id, a.group_id, a.status FROM material m LEFT JOIN active a ON a.material_id = m.material_id")
def _(t):
    return J.active_mapping(t.material.select("material_id"), t.mapping)


@query("c06_catalog_members", "SELECT g.group_id, p.mapping_id, m.local_code, m.enterprise, p.status, s_name AS reviewer FROM material_group g JOIN mapping p ON p.group_id = g.group_id JOIN material m ON m.material_id = p.material_id LEFT JOIN supplier ON s_suppkey = p.reviewer_id")
def _(t):
    rows = t.mapping.join(t.material.select("material_id", "local_code", "enterprise"), "material_id").join(t.material_group.select("group_id"), "group_id")
    return rows.join(t.supplier.select(F.col("s_suppkey").alias("reviewer_id"), F.col("s_name").alias("reviewer")), "reviewer_id", "left").select("group_id", "mapping_id", "local_code", "enterprise", "status", "reviewer")


@query("c07_related_groups", "SELECT DISTINCT e.group_id, related_id, relation_type, canonical_code AS related_code FROM (SELECT group_x AS group_id, group_y AS related_id, relation_type FROM group_relation UNION ALL SELECT group_y, group_x, relation_type FROM group_relation) e JOIN material_group g ON g.group_id = related_id AND status = 'ACTIVE'")
def _(t):
    return J.related_groups(t.group_relation, t.material_group)


TREE = "SELECT 'R' || r_regionkey::STRING AS category_id, r_name AS name, NULL AS parent_id FROM region UNION ALL SELECT 'N' || n_nationkey::STRING, n_name, 'R' || n_regionkey::STRING FROM nation UNION ALL SELECT 'C' || c_custkey::STRING, c_name, 'N' || c_nationkey::STRING FROM customer"


@query("c08_category_path", f"WITH tree AS ({TREE}) SELECT a.category_id, concat_ws(' > ', c.name, b.name, a.name) AS path FROM tree a LEFT JOIN tree b ON b.category_id = a.parent_id LEFT JOIN tree c ON c.category_id = b.parent_id")
def _(t):
    level = lambda df, p, k, n, up=None: df.select(F.concat(F.lit(p), F.col(k).cast("string")).alias("category_id"), F.col(n).alias("name"), (F.concat(F.lit(up[0]), F.col(up[1]).cast("string")) if up else F.lit(None).cast("string")).alias("parent_id"))
    tree = level(t.region, "R", "r_regionkey", "r_name").unionByName(level(t.nation, "N", "n_nationkey", "n_name", ("R", "n_regionkey"))).unionByName(level(t.customer, "C", "c_custkey", "c_name", ("N", "c_nationkey")))
    upper = tree.where("category_id NOT LIKE 'C%'")  # the two upper levels are small whatever the catalog's size
    one = F.broadcast(upper.select(F.col("category_id").alias("i1"), F.col("name").alias("n1"), F.col("parent_id").alias("p1")))
    two = F.broadcast(upper.select(F.col("category_id").alias("i2"), F.col("name").alias("n2")))
    return tree.join(one, F.col("parent_id") == F.col("i1"), "left").join(two, F.col("p1") == F.col("i2"), "left").select("category_id", F.concat_ws(" > ", "n2", "n1", "name").alias("path"))


@query("c09_unmatched_materials", "SELECT material_id FROM material m WHERE NOT EXISTS (SELECT 1 FROM mapping p WHERE p.material_id = m.material_id AND status <> 'REJECTED')")
def _(t):
    return J.unmatched(t.material, t.mapping).select("material_id")


@query("c10_policy_lookup", "SELECT material_id, coalesce(auto_threshold, 0.85) AS auto_threshold, coalesce(review_threshold, 0.60) AS review_threshold, coalesce(min_margin, 0.10) AS min_margin, coalesce(auto_enabled, true) AS auto_enabled FROM material m LEFT JOIN policy p ON p.category = m.category")
def _(t):
    return J.policy_lookup(t.material, t.policy).select("material_id", "auto_threshold", "review_threshold", "min_margin", "auto_enabled")


@query("c18_category_consensus_fix", f"SELECT g.group_id, CASE WHEN status = 'PROPOSED' AND n = 1 THEN shared ELSE g.category END AS category FROM (SELECT * REPLACE ('UNKNOWN' AS category) FROM material_group) g LEFT JOIN (SELECT group_id, count(DISTINCT category) AS n, min(category) AS shared FROM ({MEMBERS}) m GROUP BY 1) m ON m.group_id = g.group_id")
def _(t):
    return J.category_consensus(t.material_group.withColumn("category", F.lit("UNKNOWN")), members(t).select("group_id", "category")).select("group_id", "category")


@query("c19_relation_dedup", "SELECT min(relation_id) AS relation_id, least(group_x, group_y) AS group_a, greatest(group_x, group_y) AS group_b, relation_type FROM group_relation WHERE group_x <> group_y GROUP BY 2, 3, 4")
def _(t):
    return J.relation_dedup(t.group_relation)


# --- aggregates
@query("d01_dashboard_stats", """SELECT (SELECT count(*) FROM material) AS materials, (SELECT count(*) FROM material_group WHERE status = 'ACTIVE') AS active_groups, count(*) FILTER (WHERE status = 'CONFIRMED') AS confirmed, count(*) FILTER (WHERE status = 'PENDING') AS pending,
  count(*) FILTER (WHERE status = 'REJECTED') AS rejected, (SELECT count(*) FROM material WHERE material_id NOT IN (SELECT material_id FROM mapping WHERE status <> 'REJECTED')) AS unmatched, (SELECT count(*) FROM enterprise) AS enterprises FROM mapping""")  # fmt: skip
def _(t):
    return D.dashboard(t.material, t.material_group, t.mapping, t.enterprise)


BREAKDOWN = "SELECT enterprise, count(DISTINCT m.material_id) AS materials, count(DISTINCT CASE WHEN p.material_id IS NOT NULL THEN m.material_id END) AS mapped FROM material m LEFT JOIN (SELECT DISTINCT material_id FROM mapping WHERE status = 'CONFIRMED') p ON p.material_id = m.material_id GROUP BY 1"


@query("d02_enterprise_breakdown", BREAKDOWN)
def _(t):
    return D.enterprise_breakdown(t.material, t.mapping)


@query("d03_category_distribution", "SELECT upper(category) AS category, count(*) AS n FROM material GROUP BY 1")
def _(t):
    return D.category_distribution(t.material)


CONSOLIDATED = "SELECT coalesce(sum(n - 1), 0)::BIGINT AS consolidated FROM (SELECT p.group_id, count(*) AS n FROM mapping p JOIN material_group g ON g.group_id = p.group_id WHERE p.status = 'CONFIRMED' AND g.status IN ('PROPOSED', 'ACTIVE') GROUP BY 1 HAVING count(*) > 1)"


@query("d04_duplicates_consolidated", CONSOLIDATED)
def _(t):
    return D.duplicates_consolidated(t.mapping, t.material_group)


@query("d05_deduplication_rate", f"SELECT consolidated, reviewed, floor(consolidated / reviewed * 1000 + 0.5) / 10 AS rate FROM ({CONSOLIDATED}), (SELECT count(*) AS reviewed FROM mapping WHERE status IN ('CONFIRMED', 'REJECTED'))")
def _(t):
    return D.deduplication_rate(t.mapping, t.material_group)


@query("d06_mapped_percent", f"SELECT *, floor(100 * mapped / materials + 0.5)::BIGINT AS percent FROM ({BREAKDOWN}) b")
def _(t):
    return D.mapped_percent(D.enterprise_breakdown(t.material, t.mapping))


@query("d07_group_member_summary", "SELECT p.group_id, count(*) FILTER (WHERE status = 'CONFIRMED') AS confirmed, count(DISTINCT enterprise) FILTER (WHERE status = 'CONFIRMED') AS enterprises, CASE WHEN count(*) FILTER (WHERE status = 'CONFIRMED') > 0 THEN 'HARMONIZED' ELSE 'PENDING_REVIEW' END AS state FROM mapping p JOIN material m ON m.material_id = p.material_id GROUP BY 1")
def _(t):
    return D.group_summary(t.mapping, t.material)


@query("d08_max_serial_per_category", "SELECT CASE WHEN group_id % 9 = 0 THEN NULL ELSE category END AS category, max(code_serial) AS last_serial, coalesce(max(code_serial), 0) + 1 AS next_serial FROM material_group GROUP BY 1")
def _(t):
    return D.next_serials(t.material_group.withColumn("category", F.when(F.col("group_id") % 9 != 0, F.col("category"))))


@query("d16_batch_outcome_counts", "SELECT mapping_id // 500 AS batch, count(*) FILTER (WHERE status = 'CONFIRMED') AS auto_confirm, count(*) FILTER (WHERE status = 'PENDING') AS review_required, count(*) FILTER (WHERE status = 'REJECTED') AS failed FROM mapping GROUP BY 1")
def _(t):
    s = lambda v, n: D.count_where(F.col("status") == v).alias(n)
    return t.mapping.groupBy(F.floor(F.col("mapping_id") / 500).alias("batch")).agg(s("CONFIRMED", "auto_confirm"), s("PENDING", "review_required"), s("REJECTED", "failed"))


@query("d18_policy_consistency", "SELECT count(*) FILTER (WHERE NOT (review_threshold >= 0 AND review_threshold < auto_threshold AND auto_threshold <= 1 AND min_margin BETWEEN 0 AND 1)) AS violations, count(*) AS policies FROM (SELECT * REPLACE (auto_threshold - CASE category WHEN 'BUILDING' THEN 0.5 ELSE 0 END AS auto_threshold) FROM policy)")
def _(t):
    return D.policy_faults(t.policy.withColumn("auto_threshold", F.col("auto_threshold") - F.when(F.col("category") == "BUILDING", 0.5).otherwise(0)))


# --- rankings
@query("e05_allocate_serials", "SELECT group_id, category, coalesce((SELECT max(code_serial) FROM material_group x WHERE x.category = g.category), 0) + row_number() OVER (PARTITION BY category ORDER BY group_id) AS serial FROM material_group g WHERE status = 'PROPOSED'")
def _(t):
    from ..operators.governance import allocate_serials

    return allocate_serials(t.material_group.where("status = 'PROPOSED'"), t.material_group).select("group_id", "category", "serial")


@query("e06_latest_audit", "SELECT audit_id, ts FROM audit WHERE entity_type = 'GROUP' ORDER BY ts DESC, audit_id DESC LIMIT 500")
def _(t):
    return t.audit.where("entity_type = 'GROUP'").orderBy(F.desc("ts"), F.desc("audit_id")).limit(500).select("audit_id", "ts")


@query("e07_latest_jobs", "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def _(t):
    return J.top_k(t.orders, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 3).select("o_orderkey", "o_custkey")


@query("e08_exact_duplicate_rows", "SELECT material_id FROM catalog QUALIFY row_number() OVER (PARTITION BY category, description, specification ORDER BY material_id) > 1")
def _(t):
    w = Window.partitionBy("category", "description", "specification").orderBy("material_id")
    return t.catalog.withColumn("rn", F.row_number().over(w)).where("rn > 1").select("material_id")


@query("e09_sla_bucket", "SELECT audit_id, greatest(1, date_diff('second', ts, TIMESTAMP '2024-01-10 00:00:00') // 3600) AS hours, CASE WHEN greatest(1, date_diff('second', ts, TIMESTAMP '2024-01-10 00:00:00') // 3600) > 72 THEN 'Overdue' WHEN greatest(1, date_diff('second', ts, TIMESTAMP '2024-01-10 00:00:00') // 3600) > 24 THEN 'Warning' ELSE 'Fresh' END AS bucket FROM audit")
def _(t):
    from ..operators.governance import sla_bucket

    return sla_bucket(t.audit, "ts", "2024-01-10 00:00:00").select("audit_id", "hours", "bucket")


# --- sets
@query("f02_all_canonical_ids", "SELECT id_a AS id FROM pairs UNION SELECT id_b FROM pairs")
def _(t):
    return t.pairs.select(F.col("id_a").alias("id")).union(t.pairs.select("id_b")).distinct()


@query("f04_training_text_union", "SELECT description_a AS text, count(*) AS n FROM (SELECT description_a FROM pairs UNION ALL SELECT description_b FROM pairs) GROUP BY 1")
def _(t):
    return t.pairs.select(F.col("description_a").alias("text")).union(t.pairs.select("description_b")).groupBy("text").agg(F.count("*").alias("n"))


@query("x01_enterprise_price_variance", "SELECT group_id, min(nominal_price) AS low, max(nominal_price) AS high, count(DISTINCT enterprise) AS enterprises, max(nominal_price) - min(nominal_price) AS spread FROM (SELECT DISTINCT group_id, material_id FROM mapping WHERE status = 'CONFIRMED') p JOIN material m ON m.material_id = p.material_id GROUP BY 1")
def _(t):
    return D.price_spread(t.mapping, t.material)


CHECK_CHARS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@query("x02_iso7064_check_char", f"""SELECT canonical_code, substr('{CHECK_CHARS}', ((37 - list_reduce(list_concat([36::BIGINT], list_transform(list_filter(string_split(regexp_replace(upper(canonical_code), '[^0-9A-Z]', '', 'g'), ''), lambda c: c <> ''), lambda c: strpos('{CHECK_CHARS}', c) - 1)),
  lambda p, v: ((CASE WHEN (p + v) % 36 = 0 THEN 36 ELSE (p + v) % 36 END) * 2) % 37)) % 36 + 1)::INT, 1) AS check_char FROM material_group WHERE canonical_code IS NOT NULL""")  # fmt: skip
def _(t):
    return t.material_group.where("canonical_code IS NOT NULL").select("canonical_code", A.check_char(F.col("canonical_code")).alias("check_char"))
