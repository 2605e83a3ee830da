"""Views of the given tables in the shape of the catalog tables, in SQL that Spark and DuckDB both run.

Spark fills ``{table}`` with a DataFrame, DuckDB reads the table of that name; views may use earlier views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "catalog_base": """
SELECT p_partkey AS material_id, p_partkey % 5 AS enterprise_id, p_retailprice AS price,
  split_part(p_name, ' ', 1) AS adj, split_part(p_name, ' ', 2) AS noun, CAST(split_part(p_brand, '#', 2) AS INT) AS n,
  CASE p_size % 4 WHEN 0 THEN '25' WHEN 1 THEN '50' WHEN 2 THEN '80' ELSE '100' END AS size,
  CASE p_size % 4 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '1.5' ELSE '5' END AS inches,
  CASE CAST(split_part(p_brand, '#', 2) AS INT) % 3 WHEN 0 THEN 'CS' WHEN 1 THEN 'SS304' ELSE 'PTFE' END AS mat,
  CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN '150' WHEN p_type IN ('LARGE', 'MEDIUM') THEN '300' ELSE '600' END AS rating,
  CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN '40' WHEN p_type IN ('LARGE', 'MEDIUM') THEN '80' ELSE '160' END AS sch
FROM {part}""",
    "catalog": """
SELECT material_id, enterprise_id, 'MAT-' || CAST(material_id AS STRING) AS local_code,
  CASE noun WHEN 'rod' THEN 'PIPE' WHEN 'plate' THEN 'FLANGE' WHEN 'ring' THEN 'GASKET' WHEN 'gear' THEN 'BEARING' WHEN 'bolt' THEN 'FASTENER'
    WHEN 'anvil' THEN 'VALVE' WHEN 'gizmo' THEN CASE n % 2 WHEN 0 THEN 'MOTOR' ELSE 'CABLE' END
    WHEN 'widget' THEN CASE n % 3 WHEN 0 THEN 'PUMP' WHEN 1 THEN 'FILTER' ELSE 'GENERAL_MRO' END ELSE 'GENERAL_MRO' END AS category,
  CASE noun WHEN 'rod' THEN mat || ' PIPE ' || size || 'MM SCH' || sch
    WHEN 'plate' THEN CASE n % 2 WHEN 0 THEN 'BLIND' ELSE 'WELD NECK' END || ' FLANGE ' || mat || ' ' || size || ' MM CLASS ' || rating
    WHEN 'ring' THEN 'SPIRAL WOUND GASKET ' || mat || ' DN' || size || ' CLASS ' || rating
    WHEN 'gear' THEN 'DEEP GROOVE BALL BEARING 62' || lpad(CAST(n AS STRING), 2, '0') || CASE n % 2 WHEN 0 THEN ' 2RS' ELSE ' ZZ' END || ' BORE ' || size || 'MM'
    WHEN 'bolt' THEN CASE n % 4 WHEN 0 THEN 'HEXAGONAL NUT' ELSE 'HEX BOLT' END || ' M' || CAST(8 + n % 5 * 2 AS STRING) || ' GRADE ' || CASE n % 2 WHEN 0 THEN '8.8' ELSE '4.6' END
    WHEN 'anvil' THEN CASE n % 4 WHEN 0 THEN 'Gate' WHEN 1 THEN 'Globe' WHEN 2 THEN 'Ball' ELSE 'Check' END || ' Valve ' || mat || ' ' || inches || CASE n % 2 WHEN 0 THEN ' inch' ELSE '"' END || ' ' || rating || '#'
    WHEN 'gizmo' THEN CASE n % 2 WHEN 0 THEN 'INDUCTION MOTOR ' || CAST(n % 7 + 1 AS STRING) || '.5 KW 415V 3 PHASE ' || CAST(960 + n % 3 * 480 AS STRING) || 'RPM'
      ELSE 'COPPER CABLE ' || CAST(n % 4 + 1 AS STRING) || 'C X ' || CAST(n % 6 + 1 AS STRING) || '.5 SQ MM 1.1KV' END
    WHEN 'widget' THEN CASE n % 3 WHEN 0 THEN 'CENTRIFUGAL PUMP ' || CAST(n % 9 + 1 AS STRING) || ' H.P. 1-PH' WHEN 1 THEN 'AIR FILTER ' || size || ' MICRON NB ' || size || ' CM'
      ELSE adj || ' ' || noun || ' stainless steel TYPE 304 TX-' || CAST(n AS STRING) || '-A' END
    ELSE adj || ' ' || noun || ' ' || mat || ' ' || size || 'MM IS ' || CAST(n AS STRING) END AS description,
  CASE WHEN noun = 'rod' THEN 'ASTM A106 GR' || CASE n % 2 WHEN 0 THEN ' A' ELSE ' B' END WHEN material_id % 7 = 0 THEN '' ELSE 'IS ' || CAST(1200 + n AS STRING) END AS specification,
  CASE WHEN material_id % 3 = 0 THEN 'MTR' ELSE 'NOS' END AS uom, CAST(price AS DECIMAL(14,2)) AS nominal_price
FROM {catalog_base}""",
    "enterprise": "SELECT CAST(r_regionkey AS BIGINT) AS enterprise_id, r_name AS name FROM {region}",
    "material": """
SELECT c_custkey AS material_id, CAST(c_nationkey AS BIGINT) AS enterprise_id, n_name AS enterprise, c_name AS local_code, c_mktsegment AS category,
  CAST(c_acctbal AS DECIMAL(14,2)) AS nominal_price, c_mktsegment || ' ITEM ' || n_name || ' ' || CAST(c_custkey % 90 AS STRING) AS description,
  'IS ' || CAST(c_custkey % 50 AS STRING) AS specification
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""",
    "mapping": """
SELECT o_orderkey AS mapping_id, o_custkey AS material_id, o_custkey % 400 AS group_id,
  CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'P' THEN 'PENDING' ELSE 'REJECTED' END AS status,
  CAST((o_orderkey % 101) / 100.0 AS DECIMAL(5,4)) AS score,
  CASE WHEN o_orderkey % 101 >= 85 THEN 'HIGH' WHEN o_orderkey % 101 >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS tier,
  CAST(o_orderdate AS TIMESTAMP) AS created_at, o_orderkey % 7 AS reviewer_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'AUTO' WHEN '2-HIGH' THEN 'LEGACY' ELSE 'HUMAN' END AS decision_source,
  CASE WHEN o_orderkey % 11 = 0 THEN '{{"conflicts":["Size conflict (variant_critical): 1 vs 2"]}}' WHEN o_orderkey % 13 = 0 THEN '{{"conflicts":["Grade conflict (minor): A vs B"]}}'
    WHEN o_orderkey % 17 = 0 THEN 'not json' ELSE NULL END AS explanation
FROM {orders}""",
    "active": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY material_id ORDER BY created_at DESC, mapping_id DESC) AS rn FROM {mapping} WHERE status IN ('PENDING', 'CONFIRMED')) t WHERE rn = 1""",
    "material_group": """
SELECT group_id, min(category) AS category, count(DISTINCT category) AS n_categories,
  CASE group_id % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'ACTIVE' WHEN 2 THEN 'PROPOSED' ELSE 'DEPRECATED' END AS status,
  'DRAFT-' || lpad(CAST(group_id AS STRING), 6, '0') AS draft_ref,
  CASE WHEN group_id % 4 < 2 THEN 'STM-401407-' || lpad(CAST(group_id AS STRING), 6, '0') ELSE NULL END AS canonical_code,
  CASE WHEN group_id % 4 < 2 THEN group_id ELSE NULL END AS code_serial,
  'GROUP ' || CAST(group_id AS STRING) || ' ' || min(category) AS std_description, 'NOS' AS std_uom,
  CASE WHEN group_id % 5 = 0 THEN NULL ELSE 'SIG' || CAST(group_id % 90 AS STRING) END AS signature
FROM (SELECT material_id % 400 AS group_id, category FROM {material}) t GROUP BY group_id""",
    "group_relation": """
SELECT s_suppkey AS relation_id, s_suppkey * 7 % 400 AS group_x, CAST(s_nationkey * 13 % 400 AS BIGINT) AS group_y,
  CASE s_suppkey % 2 WHEN 0 THEN 'VARIANT' ELSE 'FUNCTIONALLY_EQUIVALENT' END AS relation_type FROM {supplier}""",
    "policy": """
SELECT category, CAST(0.80 + 0.02 * row_number() OVER (ORDER BY category) AS DOUBLE) AS auto_threshold, CAST(0.60 AS DOUBLE) AS review_threshold,
  CAST(0.05 AS DOUBLE) AS min_margin, category <> 'FURNITURE' AS auto_enabled
FROM (SELECT DISTINCT c_mktsegment AS category FROM {customer} WHERE c_mktsegment <> 'MACHINERY') t""",
    "assignment": "SELECT DISTINCT c_custkey % 7 AS reviewer_id, c_mktsegment AS category FROM {customer} WHERE c_custkey % 7 < 3 AND c_mktsegment IN ('BUILDING', 'FURNITURE')",
    "audit": """
SELECT event_id AS audit_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type AS action, CASE event_id % 3 WHEN 0 THEN 'MATERIAL' WHEN 1 THEN 'MAPPING' ELSE 'GROUP' END AS entity_type,
  user_id AS entity_id, CAST(NULL AS STRING) AS old_value, props AS new_value FROM {events}""",
    "texts": "SELECT doc_id AS material_id, source AS enterprise, lang AS category, text AS description, '' AS specification FROM {documents}",
    "pairs": """
SELECT p.id_a, p.id_b, a.category AS category, a.description AS description_a, a.specification AS specification_a,
  b.description AS description_b, b.specification AS specification_b
FROM (SELECT DISTINCT least(material_id, other) AS id_a, greatest(material_id, other) AS id_b FROM (
    SELECT material_id, lead(material_id) OVER (PARTITION BY category, description ORDER BY material_id) AS other FROM {catalog}
    UNION ALL SELECT material_id, lead(material_id, 1) OVER (PARTITION BY category, substr(md5(description), 1, 1) ORDER BY md5(CAST(material_id AS STRING)), material_id) AS other FROM {catalog}
    UNION ALL SELECT material_id, lead(material_id, 2) OVER (PARTITION BY category, substr(md5(description), 1, 1) ORDER BY md5(CAST(material_id AS STRING)), material_id) AS other FROM {catalog}) n
  WHERE other IS NOT NULL) p
JOIN {catalog} a ON a.material_id = p.id_a JOIN {catalog} b ON b.material_id = p.id_b""",
}


def used(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    tables = {n: view(spark, sf_dir, n) for n in used(sql)}
    if name == "catalog_base":  # a million parts are a file of a few MB, which one task would read and work all rules on
        tables["part"] = tables["part"].repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.sql(sql, **tables)


def sql_with(sql: str) -> str:
    """DuckDB SQL with the views that ``sql`` names put before it."""
    needed: list[str] = []

    def add(text: str, own: str = "") -> None:
        for name in VIEWS:
            if name != own and name not in needed and (re.search(rf"\{{{name}\}}", text) if own else re.search(rf"\b{name}\b", text)):
                add(VIEWS[name], name)
                needed.append(name)

    add(sql)
    order = [n for n in VIEWS if n in needed]
    plain = lambda s: re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", s).replace("{{", "{").replace("}}", "}")
    ctes = ", ".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE') :]}"
    return f"WITH {ctes}, {body[4:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
