"""Harmonisation, governance, audit chains and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import attributes as A
from ..operators import audit as U
from ..operators import governance as G
from ..operators import harmonize as H
from ..operators.joins import unmatched
from .catalog_queries import MEMBERS
from .registry import query
from .text_queries import COMMODITY, SIGNATURE, FLAT, _template_sql

CRITICAL = "coalesce(contains(explanation, 'variant_critical') OR contains(explanation, 'identity_critical'), false)"


@query("g33_critical_conflict_flag", f"SELECT mapping_id, {CRITICAL} AS critical FROM mapping")
def _(t):
    return t.mapping.select("mapping_id", G.critical_conflict("explanation").alias("critical"))


@query("g35_parse_diagnostics", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 1 END AS n FROM events")
def _(t):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.concat(F.lit('["'), "event_type", F.lit('", "b", " "]'))).when(k == 1, F.concat("event_type", F.lit("\n\nline two"))).otherwise(F.col("event_type"))
    return t.events.select("event_id", F.size(G.parse_diagnostics(raw)).alias("n"))


GROUPS = f"""WITH s AS ({SIGNATURE}), k AS (SELECT c.*, s.signature, coalesce(s.signature, '#' || c.material_id::VARCHAR) AS key FROM catalog c JOIN s ON s.material_id = c.material_id),
  g AS (SELECT min(material_id) AS group_id, count(*) AS members, any_value(signature) AS signature FROM k GROUP BY key),
  flat AS ({FLAT}), d AS (SELECT c.material_id, {_template_sql()} AS std FROM catalog c LEFT JOIN flat f ON f.material_id = c.material_id GROUP BY 1)
  SELECT g.group_id, g.members, g.signature, d.std AS std_description, c.specification AS std_specification, c.uom AS std_uom, c.category, 'PROPOSED' AS status FROM g JOIN catalog c ON c.material_id = g.group_id JOIN d ON d.material_id = g.group_id"""


@query("i04_form_groups", GROUPS)
def _(t):
    return H.form_groups(H.describe(t.catalog))


@query("i03_novel_auto_register", f"SELECT c.material_id, s.signature IS NOT NULL AND c.category <> 'GENERAL_MRO' AND trim(c.specification) <> '' AS registerable FROM catalog c JOIN ({SIGNATURE}) s ON s.material_id = c.material_id")
def _(t):
    return H.describe(t.catalog).select("material_id", H.novel_auto_register(F.col("signature")).alias("registerable"))


LABEL = "CASE mapping_id % 5 WHEN 0 THEN 'EXACT_DUPLICATE' WHEN 1 THEN 'NEAR_DUPLICATE' WHEN 2 THEN 'VARIANT' ELSE 'NOT_A_MATCH' END"


@query("i02_route", f"""SELECT mapping_id, CASE WHEN coalesce(auto_enabled, true) AND g.status = 'ACTIVE' AND label IN ('EXACT_DUPLICATE', 'NEAR_DUPLICATE') AND score >= coalesce(auto_threshold, 0.85) AND (mapping_id % 20) / 100.0::DOUBLE >= coalesce(min_margin, 0.1) AND NOT {CRITICAL} THEN 'AUTO_CONFIRM'
  WHEN score >= coalesce(review_threshold, 0.6) OR label IN ('EXACT_DUPLICATE', 'NEAR_DUPLICATE', 'VARIANT') THEN 'REVIEW_REQUIRED' WHEN mapping_id % 2 = 0 THEN 'AUTO_CONFIRM' ELSE 'REVIEW_REQUIRED' END AS routing
  FROM (SELECT m.mapping_id, m.group_id, m.score::DOUBLE AS score, m.explanation, x.category, {LABEL.replace('mapping_id', 'm.mapping_id')} AS label FROM mapping m JOIN material x ON x.material_id = m.material_id) r LEFT JOIN policy p ON p.category = r.category JOIN material_group g ON g.group_id = r.group_id""")  # fmt: skip
def _(t):
    k = F.col("mapping_id") % 5
    label = F.when(k == 0, "EXACT_DUPLICATE").when(k == 1, "NEAR_DUPLICATE").when(k == 2, "VARIANT").otherwise("NOT_A_MATCH")
    rows = t.mapping.join(t.material.select("material_id", "category"), "material_id").join(t.material_group.select("group_id", (F.col("status") == "ACTIVE").alias("approved")), "group_id")
    rows = rows.select("mapping_id", "category", F.col("score").cast("double").alias("score"), label.alias("label"), ((F.col("mapping_id") % 20) / 100.0).alias("margin"), G.critical_conflict("explanation").alias("conflict"), "approved", (F.col("mapping_id") % 2 == 0).alias("registerable"))
    return H.route(rows, t.policy).select("mapping_id", "routing")


@query("i05_upsert_mappings", """SELECT n.material_id, n.group_id, a.mapping_id AS old_id, CASE WHEN a.status IS NULL THEN 'INSERT' WHEN a.status = 'CONFIRMED' AND a.decision_source = 'AUTO' AND n.auto AND a.group_id = n.group_id THEN 'KEEP' WHEN a.status = 'PENDING' THEN 'OVERWRITE' ELSE 'SUPERSEDE' END AS action,
  CASE WHEN n.auto THEN 'CONFIRMED' ELSE 'PENDING' END AS status FROM (SELECT material_id, CASE WHEN material_id % 4 = 0 THEN material_id % 399 ELSE material_id % 400 END AS group_id, material_id % 3 > 0 AS auto FROM material) n LEFT JOIN active a ON a.material_id = n.material_id""")  # fmt: skip
def _(t):
    m = F.col("material_id")
    new = t.material.select("material_id", F.when(m % 4 == 0, m % 399).otherwise(m % 400).alias("group_id"), (m % 3 > 0).alias("auto"))
    return H.upsert_mappings(new, t.active)


@query("i06_group_relations", """WITH e AS (SELECT least(group_x, group_y) AS group_a, greatest(group_x, group_y) AS group_b, relation_type, (relation_id % 10) / 10.0::DOUBLE AS score FROM group_relation WHERE group_x <> group_y)
  SELECT group_a, group_b, relation_type, score FROM e WHERE NOT EXISTS (SELECT 1 FROM group_relation k WHERE relation_id % 4 = 0 AND least(group_x, group_y) = group_a AND greatest(group_x, group_y) = group_b) QUALIFY row_number() OVER (PARTITION BY group_a, group_b ORDER BY score DESC, relation_type DESC) = 1""")  # fmt: skip
def _(t):
    e = t.group_relation.select(F.col("group_x").alias("x"), F.col("group_y").alias("y"), "relation_type", ((F.col("relation_id") % 10) / 10.0).alias("score"))
    old = t.group_relation.where("relation_id % 4 = 0").select(F.least("group_x", "group_y").alias("group_a"), F.greatest("group_x", "group_y").alias("group_b"))
    return H.group_relations(e, old)


ACTIVATED = f"""SELECT group_id, serial, 'STM-' || {COMMODITY} || '-' || lpad(serial::VARCHAR, 6, '0') AS canonical_code, 'ACTIVE' AS status FROM (SELECT g.group_id, g.category, coalesce((SELECT max(code_serial) FROM material_group x WHERE x.category = g.category), 0) + row_number() OVER (PARTITION BY g.category ORDER BY g.group_id) AS serial
  FROM material_group g WHERE g.status = 'PROPOSED' AND g.group_id IN (SELECT group_id FROM mapping WHERE status = 'CONFIRMED')) s"""


@query("i07_activate_groups", ACTIVATED)
def _(t):
    return G.activate_groups(t.material_group, t.mapping.where("status = 'CONFIRMED'"))


DECISION = "CASE mapping_id % 4 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'rejected' WHEN 2 THEN 'CONFIRMED' ELSE 'maybe' END"
APPLIED = f"""SELECT m.mapping_id, m.reviewer_id, m.group_id, CASE WHEN reason IS NULL THEN CASE WHEN m.mapping_id % 4 = 1 THEN 'REJECTED' ELSE 'CONFIRMED' END ELSE m.status END AS status, reason, CASE WHEN reason IS NULL THEN 'APPLIED' ELSE 'REJECTED_INPUT' END AS outcome
  FROM (SELECT p.*, CASE WHEN p.mapping_id % 4 = 3 THEN 'unknown decision' WHEN p.status <> 'PENDING' THEN 'already decided' WHEN p.reviewer_id IN (SELECT reviewer_id FROM assignment) AND NOT EXISTS (SELECT 1 FROM assignment a WHERE a.reviewer_id = p.reviewer_id AND a.category = x.category) THEN 'category not assigned' END AS reason
  FROM mapping p JOIN material x ON x.material_id = p.material_id) m"""


def applied(t):
    k = F.col("mapping_id") % 4
    d = t.mapping.select("mapping_id", "reviewer_id", F.when(k == 0, "APPROVE").when(k == 1, "rejected").when(k == 2, "CONFIRMED").otherwise("maybe").alias("decision"))
    m = t.mapping.join(t.material.select("material_id", "category"), "material_id")
    return G.apply_decisions(m, d, t.assignment)


@query("i08_apply_decisions", APPLIED)
def _(t):
    return applied(t)


@query("i13_feedback_log", f"SELECT mapping_id, reviewer_id, status AS decision FROM ({APPLIED}) a WHERE outcome = 'APPLIED'")
def _(t):
    return G.feedback_log(applied(t))


@query("i09_cascade_group_status", "SELECT g.group_id, CASE WHEN live = 0 AND status = 'ACTIVE' THEN 'DEPRECATED' WHEN live = 0 AND status = 'PROPOSED' THEN 'REJECTED' ELSE status END AS status FROM material_group g LEFT JOIN (SELECT group_id, count(*) FILTER (WHERE status IN ('CONFIRMED', 'PENDING') AND mapping_id % 6 = 0) AS live FROM mapping GROUP BY 1) m ON m.group_id = g.group_id")
def _(t):
    return G.cascade_group_status(t.material_group, t.mapping.withColumn("status", F.when(F.col("mapping_id") % 6 == 0, F.col("status")).otherwise("REJECTED"))).select("group_id", "status")


@query("i10_apply_edits", "WITH e AS (SELECT group_id, max(mapping_id) AS m FROM mapping WHERE status = 'PENDING' GROUP BY 1) SELECT g.group_id, CASE WHEN status = 'PROPOSED' AND m IS NOT NULL THEN 'EDIT ' || m::VARCHAR ELSE std_description END AS std_description, CASE WHEN status = 'PROPOSED' AND m IS NOT NULL AND m % 2 = 0 THEN 'KG' ELSE std_uom END AS std_uom FROM material_group g LEFT JOIN e ON e.group_id = g.group_id")
def _(t):
    e = t.mapping.select("mapping_id", F.concat(F.lit(" edit "), F.col("mapping_id").cast("string"), F.lit(" ")).alias("description"), F.when(F.col("mapping_id") % 2 == 0, "kg").otherwise(" ").alias("uom"))
    return G.apply_edits(t.material_group, e, t.mapping).select("group_id", "std_description", "std_uom")


@query("i11_bulk_approve", f"SELECT mapping_id, group_id, CASE WHEN {CRITICAL} THEN 'SKIPPED' ELSE 'APPROVED' END AS outcome FROM mapping WHERE status = 'PENDING' AND tier = 'HIGH'")
def _(t):
    return G.bulk_approve(t.mapping)


@query("i12_supersede", """WITH v AS (SELECT *, (SELECT max(mapping_id) FROM mapping) + 1 + mapping_id AS new_id, CASE WHEN mapping_id % 2 = 0 THEN 'CONFIRMED' ELSE 'REJECTED' END AS decision FROM mapping WHERE status IN ('CONFIRMED', 'REJECTED') AND mapping_id % 3 > 0)
  SELECT mapping_id, material_id, group_id, 'SUPERSEDED' AS status, NULL::BIGINT AS supersedes_id, new_id AS superseded_by_id FROM v UNION ALL SELECT new_id, material_id, group_id, decision, mapping_id, NULL FROM v""")  # fmt: skip
def _(t):
    o = t.mapping.select("mapping_id", F.when(F.col("mapping_id") % 2 == 0, "CONFIRMED").otherwise("REJECTED").alias("decision"), F.when(F.col("mapping_id") % 3 > 0, "wrong group").otherwise("no").alias("reason"))
    return G.supersede(t.mapping, o).drop("notes")


def batch(t):
    described = H.checkpointed(H.describe(t.catalog))  # read by retrieval, scoring and the decision
    groups = H.form_groups(described).where("signature IS NOT NULL").select(F.concat(F.lit("G-"), F.col("group_id").cast("string")).alias("group_id"), "signature", F.when(F.col("group_id") % 2 == 0, "ACTIVE").otherwise("PROPOSED").alias("status"), F.col("group_id").alias("lead"))
    return described, groups.where("lead % 3 > 0").drop("lead")


def stored_records(t):
    """Which group of the catalog holds a record before the batch: its active mapping."""
    status = t.material_group.select("group_id", F.col("status").alias("group_status"))
    m = t.active.select("material_id", "group_id").join(status, "group_id")
    return m.select("material_id", F.concat(F.lit("M-"), F.col("group_id").cast("string")).alias("group_id"), F.col("group_status").alias("status"))


@query("i01_harmonize")
def harmonized(t):
    described, groups = batch(t)
    return H.harmonize(described, groups, t.policy, stored_records(t))


@query("i01_signature_decisions", f"""WITH s AS ({SIGNATURE}), g AS (SELECT signature, min(material_id) AS lead, min(material_id) % 2 = 0 AS approved FROM s WHERE signature IS NOT NULL GROUP BY 1)
  SELECT material_id, 'G-' || lead::VARCHAR AS group_key, 1.0::DOUBLE AS score, 'HIGH' AS tier, CASE WHEN approved THEN 'AUTO_CONFIRM' ELSE 'REVIEW_REQUIRED' END AS routing, CASE WHEN approved THEN 'CONFIRMED' ELSE 'PENDING' END AS status
  FROM s JOIN g USING (signature) WHERE lead % 3 > 0""")  # fmt: skip
def _(t):
    """Of all decisions those that a known signature makes."""
    return harmonized(t).where("basis = 'DETERMINISTIC_SIGNATURE'").select("material_id", "group_key", "score", "tier", "routing", "status")


@query("i01_relations")
def _(t):
    described, groups = batch(t)
    top, stored = H.checkpointed(H.top_matches(described)), H.checkpointed(stored_records(t))
    decided = H.checkpointed(H.harmonize(described, groups, t.policy, stored, top=top))
    existing = t.group_relation.select(*[F.concat(F.lit("M-"), F.col(f"group_{c}").cast("string")).alias(f"group_{n}") for c, n in (("x", "a"), ("y", "b"))])
    return H.relations(decided, top, existing, stored)


@query("i14_harmonize_unmatched")
def _(t):
    described, groups = batch(t)
    return H.harmonize(unmatched(described, t.mapping), groups, t.policy, stored_records(t), pool=described)


UPLOAD = "cpse string, matnr string, short_text string, spec_grade string, base_uom string, matkl string, rate string"


def uploaded(t):
    """The catalog as an upload with headers of another system; every eleventh description is missing."""
    text = F.when(F.col("material_id") % 11 == 0, F.lit("")).otherwise(F.col("description"))
    return t.catalog.select(F.lit("").alias("cpse"), F.col("local_code").alias("matnr"), text.alias("short_text"), F.col("specification").alias("spec_grade"), F.col("uom").alias("base_uom"), F.lower("category").alias("matkl"), F.col("nominal_price").cast("string").alias("rate"))


def number(c: str = "matnr"):
    return F.substring(c, 5, 20).cast("long")


@query("i15_ingest_and_harmonize")
def _(t):
    """A third of the catalog is harmonised before; then all of it is uploaded."""
    from ..operators.store import Store, ingest_and_harmonize, mapped_records

    store, rows = Store(t.spark, folder(t)), uploaded(t)
    ingest_and_harmonize(rows.where(number() % 3 == 0), store, 0, t.policy)
    ingest_and_harmonize(rows, store, 1, t.policy)
    m = mapped_records(store)
    return m.select(number("local_code").alias("material_id"), "group_id", "basis", "score", "routing", "tier", "status", "group_status", "batch")


# --- audit chains: one for each user
CHAIN = """WITH RECURSIVE rows_ AS (SELECT user_id AS chain, audit_id, row_number() OVER (PARTITION BY user_id ORDER BY audit_id) AS rn,
    coalesce(user_id::VARCHAR, '0') || '|' || action || '|' || entity_type || '|' || entity_id::VARCHAR || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || '|' || {old} coalesce(new_value, '') AS body FROM audit),
  linked AS (SELECT chain, audit_id, rn, repeat('0', 64) AS prev_hash, upper(sha256(repeat('0', 64) || '|' || body)) AS row_hash FROM rows_ WHERE rn = 1
    UNION ALL SELECT r.chain, r.audit_id, r.rn, l.row_hash, upper(sha256(l.row_hash || '|' || r.body)) FROM linked l JOIN rows_ r ON r.chain = l.chain AND r.rn = l.rn + 1)"""


def chained(t, legacy=False):
    return U.append(t.audit.withColumn("chain", F.col("user_id")), legacy)


OLD = "coalesce(old_value, '') || '|' ||"


@query("j01_audit_append", CHAIN.replace("{old}", OLD) + " SELECT chain, audit_id, prev_hash, row_hash FROM linked")
def _(t):
    return chained(t).select("chain", "audit_id", "prev_hash", "row_hash")


@query("j03_audit_rebuild", CHAIN.replace("{old}", "") + " SELECT chain, audit_id, row_hash FROM linked")
def _(t):
    return chained(t, legacy=True).select("chain", "audit_id", "row_hash")


@query("j02_audit_verify", CHAIN.replace("{old}", OLD) + " SELECT chain, count(*) AS checked, min(audit_id) FILTER (WHERE audit_id % 997 = 5) AS first_broken, CASE WHEN count(*) FILTER (WHERE audit_id % 997 = 5) > 0 THEN 'changed content' END AS reason, max_by(row_hash, audit_id) AS head FROM linked GROUP BY 1")
def _(t):
    touched = F.when(F.col("audit_id") % 997 == 5, "tampered").otherwise(F.col("new_value"))
    return U.verify(chained(t).withColumn("new_value", touched))


# --- streams over the event table
def stream(t):
    spark = t.spark
    return spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)


def folder(t) -> str:
    import uuid

    return f"{H.shared_folder(t.spark)}/{uuid.uuid4().hex}"


def in_time_order(t, out: str, files: int = 4):
    """The events as a stream of files, one a micro-batch, each later than the one before; the first file's events of even users come once more in the
    second."""
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    rows = t.events.withColumn("_s", second)
    edges = rows.approxQuantile("_s", [i / files for i in range(1, files)], 0.001)
    place = sum((F.when(F.col("_s") > e, 1).otherwise(0) for e in edges), F.lit(0))
    again = rows.where((place == 0) & (F.col("user_id") % 2 == 0)).withColumn("ts", F.timestamp_seconds(F.lit(edges[0] + 1)).cast(dict(t.events.dtypes)["ts"])) if edges else rows.limit(0)
    for i in range(files):
        part = rows.where(place == i)
        (part.unionByName(again) if i == 1 else part).drop("_s").coalesce(1).write.parquet(f"{out}/drops/{i}")
    options = {"maxFilesPerTrigger": 1, "recursiveFileLookup": True}
    return t.spark.readStream.schema(t.events.schema).options(**options).parquet(f"{out}/drops")


def progressed(t):
    from ..streaming.ingest import run_with_progress

    out = folder(t)
    odd = F.coalesce(F.count_if(F.col("user_id") % 2 == 1), F.lit(0))
    return run_with_progress(in_time_order(t, out), "event_type", out, f"progress_{out[-32:]}", odd_users=odd, last_event=F.max("event_id"))


@query("k03_stream_progress", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    from ..streaming.ingest import run_with_progress

    out = folder(t)
    return run_with_progress(stream(t), "event_type", out, f"progress_{out[-32:]}")[0]


@query("k03_stream_counters", "SELECT 4 AS batches, true AS agree, true AS in_order, max(event_id) AS last_event FROM events")
def _(t):
    """What the listener heard of each micro-batch adds up to the running counts."""
    counts, batches = progressed(t)
    total = counts.agg(F.sum("n").alias("n"))
    heard = batches.agg(F.count("*").alias("batches"), F.sum("rows").alias("rows"), F.sum("input_rows").alias("input"), (F.max("batch") + 1).alias("numbers"), F.max("last_event").alias("last_event"))
    return heard.join(F.broadcast(total)).select("batches", ((F.col("rows") == F.col("n")) & (F.col("input") == F.col("n"))).alias("agree"), (F.col("numbers") == F.col("batches")).alias("in_order"), "last_event")


@query("k02_stream_skip_existing", "SELECT DISTINCT user_id, event_type FROM events WHERE user_id % 5 <> 3 OR event_type <> 'purchase'")
def _(t):
    """Keys that are stored before, that came in an earlier file, or that repeat within the watermark are left out."""
    from ..streaming.ingest import ingest_new, without_repeats

    key, out = ["user_id", "event_type"], folder(t)
    stored = t.events.where((F.col("user_id") % 5 == 3) & (F.col("event_type") == "purchase")).select(*key).distinct()
    rows = without_repeats(in_time_order(t, out).select("ts", *key), "ts", key, "1 day")
    return ingest_new(rows, out, key, stored).select(*key)


@query(
    "k01_stream_ingest",
    """WITH u AS (SELECT material_id AS m, local_code, material_id % 11 = 0 AS rejected FROM catalog)
    SELECT 3 AS batches, count(*) + count(*) FILTER (WHERE m % 8 = 0) AS imported, count(*) FILTER (WHERE rejected) + count(*) FILTER (WHERE rejected AND m % 8 = 0) AS rejected, count(*) FILTER (WHERE NOT rejected AND m % 8 = 0) AS skipped,
      count(*) FILTER (WHERE NOT rejected) AS inserted, count(*) FILTER (WHERE NOT rejected) AS decided, count(*) FILTER (WHERE NOT rejected) AS mapped, 0 AS without_group, 0 AS split_signatures FROM u""",
)
def _(t):
    """Three files of uploads: two halves of the catalog, then an eighth of it once more."""
    from ..operators.store import mapped_records
    from ..streaming.ingest import harmonize_drops, read_drops

    out, rows = folder(t), uploaded(t)
    for i, part in enumerate((number() % 2 == 0, number() % 2 == 1, number() % 8 == 0)):
        rows.where(part).coalesce(1).write.option("header", True).option("escape", '"').csv(f"{out}/drops/{i}")
    store = harmonize_drops(read_drops(t.spark, f"{out}/drops", UPLOAD), out, t.policy)
    total = lambda c: F.sum(c).alias(c)
    counted = store.log().agg(F.count("*").alias("batches"), *map(total, ("imported", "rejected", "skipped", "inserted")), (F.sum("auto_confirmed") + F.sum("review")).alias("decided"))
    m = H.checkpointed(mapped_records(store))
    split = m.where("signature IS NOT NULL").groupBy("signature").agg(F.count_distinct("group_id").alias("n")).agg(F.coalesce(F.count_if(F.col("n") > 1), F.lit(0)).alias("split_signatures"))
    kept = m.agg(F.count("*").alias("mapped"), F.coalesce(F.count_if(F.col("group_status").isNull()), F.lit(0)).alias("without_group"))
    return counted.join(F.broadcast(kept)).join(F.broadcast(split))  # one row each
