"""Catalog operators on small frames."""

import pytest
from pyspark.sql import functions as F

from stockmerge.functions import attributes as A
from stockmerge.functions import text as X
from stockmerge.operators import audit, governance, harmonize, joins, matching, stats
from stockmerge.sources import ingest


def one(spark, description, specification="", category="PIPE"):
    df = spark.createDataFrame([(1, description, specification, category)], "material_id long, description string, specification string, category string")
    return A.extract_attributes(df).first()


def test_pipe_attributes(spark):
    r = one(spark, "CS PIPE 50MM SCH40", "ASTM A106 GRB")
    assert r["attributes"] == {"material": "CS", "nominal_size_mm": "50.0", "grade": "B", "standard": "ASTMA106", "schedule": "SCH40"}
    assert r["identity_complete"] and r["missing_identity_keys"] == []


def test_unknown_category(spark):
    r = one(spark, "SS316 PRESSURE TRANSMITTER PTX-500 50MM", "IEC 61508", "INSTRUMENT")
    assert (r["attributes"]["material"], r["attributes"]["nominal_size_mm"], r["attributes"]["model"], r["attributes"]["standard"]) == ("SS316", "50.0", "PTX-500", "IEC61508")


@pytest.mark.parametrize("text,size", [("2 inch", 50.0), ('1.5" X', 40.0), ("3.5 inch", 88.9), ("DN 80", 80.0), ("25.4mm", 25.4), ("NB 5 CM", 50.0), ("OD 7", 7.0), ("12 CM", 120.0), ("none", None)])
def test_sizes(spark, text, size):
    assert spark.range(1).select(A.size_mm(F.lit(text)).alias("s")).first()[0] == size


@pytest.mark.parametrize("text,grade", [("Grade 8.8", "8.8"), ("Gr. B", "B"), ("GRB", "B"), ("TYPE 304", "TP304"), ("TP316", "TP316"), ("class 150", "CLASS150"), ("plain", None)])
def test_grades(spark, text, grade):
    assert spark.range(1).select(A.grade(F.lit(text)).alias("s")).first()[0] == grade


def test_signature(spark):
    sig = lambda m, c="PIPE": spark.range(1).select(A.attribute_signature(F.create_map(*[F.lit(x) for kv in m for x in kv]), F.lit(c))).first()[0]
    full = [("material", "cs"), ("nominal_size_mm", "50.0"), ("schedule", "SCH40"), ("grade", "B")]
    assert sig(full) == sig([(k, v.upper()) for k, v in reversed(full)]) and len(sig(full)) == 64
    assert sig(full[:3]) is None
    assert sig(full) != sig([*full[:3], ("grade", "A")])


def test_reference_and_tiers(spark):
    r = spark.range(1).select(A.catalog_reference(F.lit("PIPE"), F.lit(42)), *[X.tier(F.lit(s)) for s in (0.8499, 0.85, 0.5999, 0.60)]).first()
    assert r[0].endswith("-401407-000042") and list(r[1:]) == ["MEDIUM", "HIGH", "LOW", "MEDIUM"]


def test_edit_ratios():
    assert X.indel("", "") == 1 and X.indel("a", "") == 0
    assert X.indel("abcd", "abxd") == 0.75
    assert X.lcs("AGGTAB", "GXTXAYB") == 4
    assert X.partial("abc", "xxabcxx") == 1


def test_deduplication_rate(spark):
    m = spark.createDataFrame([(1, 1, "CONFIRMED"), (2, 1, "CONFIRMED"), (3, 1, "CONFIRMED"), (4, 2, "CONFIRMED"), (5, 2, "CONFIRMED"), (6, 3, "REJECTED"), (7, 3, "REJECTED"), (8, 3, "REJECTED"), (9, 3, "PENDING")], "mapping_id long, group_id long, status string")
    g = spark.createDataFrame([(1, "ACTIVE"), (2, "PROPOSED"), (3, "ACTIVE")], "group_id long, status string")
    assert tuple(stats.deduplication_rate(m, g).first()) == (3, 8, 37.5)
    assert stats.deduplication_rate(m.limit(0), g).first()["rate"] == 0


def test_audit_chain(spark):
    events = spark.createDataFrame([(c, i, 1, "EDIT", "MATERIAL", i, None, f"v{i}") for c in (1, 2) for i in range(1, 8)], "chain long, audit_id long, user_id long, action string, entity_type string, entity_id long, old_value string, new_value string")
    rows = audit.append(events.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp")))
    assert all(r["first_broken"] is None and r["checked"] == 7 for r in audit.verify(rows).collect())
    bad = rows.withColumn("new_value", F.when((F.col("chain") == 2) & (F.col("audit_id") == 4), "x").otherwise(F.col("new_value")))
    assert {r["chain"]: (r["first_broken"], r["reason"]) for r in audit.verify(bad).collect()} == {1: (None, None), 2: (4, "changed content")}
    cut = rows.where("NOT (chain = 1 AND audit_id = 3)")
    assert {r["chain"]: (r["first_broken"], r["reason"]) for r in audit.verify(cut).collect()}[1] == (4, "broken link")


def test_scan_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Mat_No,Short_Text,Spec_Grade,Base_UOM\n" A-1 ","He said ""hi""\nthere",X,\n,,,\nB-2,,Y,KG\n')
    raw = ingest.scan_catalog_csv(spark, str(tmp_path / "a.csv"))
    assert raw.columns == ["mat_no", "short_text", "spec_grade", "base_uom"] and raw.count() == 2
    rows = sorted(map(tuple, ingest.resolve_header_aliases(raw).select("local_code", "description", "specification", "uom").collect()))
    assert rows[0] == ("A-1", 'He said "hi"\nthere', "X", "") and rows[1][0] == "B-2"
    (tmp_path / "b.txt").write_text("code;desc\n1;x\n")
    assert ingest.scan_catalog_delimited(spark, str(tmp_path / "b.txt")).columns == ["code", "desc"]
    assert ingest.automap_headers(["Mat No", "Short-Text", "Unit"])["local_code"] == "Mat No"


def test_erp_template_has_a_byte_order_mark(spark, tmp_path):
    ingest.write_csv(spark.createDataFrame([("1", "x")], "material string, description string"), str(tmp_path / "o"), bom=True)
    part = next((tmp_path / "o").glob("part-*.csv"))
    assert part.read_bytes()[:3] == b"\xef\xbb\xbf"


def test_page_clamps(spark):
    from stockmerge.operators.search import page

    df = spark.range(300).select(F.col("id"), F.lit(1).alias("k"))
    assert page(df, 0, 5000, "k", "id").count() == 100 and page(df, -3, 0, "k", "id").first()["id"] == 299


def test_review_queue_without_assignments_is_everything(spark):
    from stockmerge.operators.search import review_queue

    m = spark.createDataFrame([(1, "A", "PENDING"), (2, "B", "PENDING"), (3, "A", "CONFIRMED")], "mapping_id long, category string, status string")
    a = spark.createDataFrame([(7, "A")], "reviewer_id long, category string")
    assert [r[0] for r in review_queue(m, a, 7).select("mapping_id").collect()] == [1]
    assert review_queue(m, a, 8).count() == 2


def test_size_variants_are_no_duplicates(spark):
    p = spark.createDataFrame([(1, 2, "PIPE", "CS PIPE 50MM SCH40", "ASTM A106", "CS PIPE 200MM SCH40", "ASTM A106"), (1, 3, "PIPE", "CS PIPE 50MM SCH40", "", "SS PIPE 50MM SCH40", "")], "a long, b long, category string, description_a string, specification_a string, description_b string, specification_b string")
    r = {x["b"]: x for x in matching.explain(matching.compared(p)).collect()}
    assert any("variant_critical" in c for c in r[2]["conflicts"]) and any("identity_critical" in c for c in r[3]["conflicts"])
    assert {x["b"]: x["score"] for x in matching.heuristic_compare(p).collect()}[3] <= 0.25


def test_critical_conflict(spark):
    df = spark.createDataFrame([('{"conflicts":["x (identity_critical): a vs b"]}',), ('{"conflicts":["x (minor): a vs b"]}',), ("oops",), (None,)], "e string")
    assert [r[0] for r in df.select(governance.critical_conflict("e")).collect()] == [True, False, False, False]


def test_components(spark):
    nodes = spark.range(12).select("id")
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 8)] + [(10, 9)], "a long, b long")
    assert {r["id"]: r["root"] for r in harmonize.components(nodes, edges).collect()} == {**{i: 0 for i in range(9)}, 9: 9, 10: 9, 11: 11}


def catalog(spark, rows):
    return spark.createDataFrame([(*r, "ASTM A106", "NOS") for r in rows], "material_id long, category string, description string, specification string, uom string")


def test_harmonize(spark):
    d = harmonize.describe(catalog(spark, [(1, "PIPE", "CS PIPE 50MM SCH40 GRADE B"), (2, "PIPE", "cs pipe 50mm sch40 grade b"), (3, "PIPE", "PVC PIPE 200MM"), (4, "MOTOR", "MOTOR")]))
    sig = d.where("material_id = 1").first()["signature"]
    policy = spark.createDataFrame([], "category string, auto_threshold double, review_threshold double, min_margin double, auto_enabled boolean")
    none = spark.createDataFrame([], "group_id string, signature string, status string")
    out = {r["material_id"]: r for r in harmonize.harmonize(d, none, policy).collect()}
    assert len(out) == 4 and out[1]["group_key"] == out[2]["group_key"] == "NEW-1" and out[3]["group_key"] == "NEW-3"
    assert out[1]["routing"] == "REVIEW_REQUIRED"
    known = spark.createDataFrame([("G9", sig, "ACTIVE")], none.schema)
    out = {r["material_id"]: r for r in harmonize.harmonize(d, known, policy).collect()}
    assert (out[2]["group_key"], out[2]["basis"], out[2]["status"]) == ("G9", "DETERMINISTIC_SIGNATURE", "CONFIRMED")


def test_harmonize_against_the_stored_catalog(spark):
    """The four outcomes: a known signature, a duplicate of a stored record, a related record with a group of its own, a novel one."""
    # without a dimension no signature is complete, so matches decide
    d = harmonize.describe(catalog(spark, [(1, "PIPE", "CARBON STEEL PIPE SEAMLESS LINE"), (2, "FILTER", "PIPE SEAMLESS CARBON STEEL LINE"), (3, "PIPE", "CS PIPE 50MM SCH40 GRADE B"), (4, "MOTOR", "ODD THING"), (5, "VALVE", "X")]))
    pool = harmonize.describe(catalog(spark, [(101, "PIPE", "CARBON STEEL PIPE SEAMLESS LINE"), (102, "PIPE", "BRASS TUBE")]))
    sig = d.where("material_id = 3").first()["signature"]
    groups = spark.createDataFrame([("G3", sig, "ACTIVE"), ("G1", None, "ACTIVE")], "group_id string, signature string, status string")
    policy = spark.createDataFrame([("PIPE", 0.5, 0.3, 0.0, True)], "category string, auto_threshold double, review_threshold double, min_margin double, auto_enabled boolean")
    stored = spark.createDataFrame([(101, "G1", "ACTIVE"), (102, "G2", "PROPOSED")], "material_id long, group_id string, status string")
    top = harmonize.checkpointed(harmonize.top_matches(d, pool=pool))
    best = {r["a"]: r for r in top.collect()}
    assert best[1]["b"] == 101 and set(best) <= {1, 2, 3, 4, 5}
    out = {r["material_id"]: r for r in harmonize.harmonize(d, groups, policy, stored, pool, top).collect()}
    assert len(out) == 5
    assert (out[1]["group_key"], out[1]["basis"], out[1]["routing"]) == ("G1", "ML_PROPOSED", "AUTO_CONFIRM")
    assert (out[3]["group_key"], out[3]["basis"]) == ("G3", "DETERMINISTIC_SIGNATURE")
    assert out[4]["group_key"] == "NEW-4" and out[4]["basis"].startswith("NOVEL")
    # forced matches: a chain reaches a stored group through a record of the batch; a variant gets an edge
    forced = spark.createDataFrame([(2, 1, 0.9, "EXACT_DUPLICATE", 0.5, False), (1, 101, 0.9, "EXACT_DUPLICATE", 0.5, False), (4, 101, 0.7, "VARIANT", 0.1, False), (5, 4, 0.2, "VARIANT", 0.1, False)], "a long, b long, score double, label string, margin double, conflict boolean")
    decided = harmonize.harmonize(d, groups, policy, stored, pool, forced)
    out = {r["material_id"]: r for r in decided.collect()}
    assert out[2]["group_key"] == out[1]["group_key"] == "G1" and out[4]["group_key"] == "NEW-4" and out[4]["routing"] == "REVIEW_REQUIRED"
    none = spark.createDataFrame([], "group_a string, group_b string")
    assert [tuple(r) for r in harmonize.relations(decided, forced, none, stored).collect()] == [("G1", "NEW-4", "VARIANT", 0.7)]


def test_ingest_new(spark, tmp_path):
    from stockmerge.streaming.ingest import ingest_new, run_to_files

    for i, rows in enumerate([[(1, "a"), (1, "b"), (2, "c")], [(2, "d"), (3, "e"), (9, "s")]]):
        spark.createDataFrame(rows, "k long, v string").coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    stream = lambda: spark.readStream.schema("k long, v string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stored = spark.createDataFrame([(9, "old")], "k long, v string")
    out = ingest_new(stream(), str(tmp_path / "out"), ["k"], stored)
    assert sorted(r["k"] for r in out.collect()) == [1, 2, 3]
    counts = run_to_files(stream().groupBy("k").count(), str(tmp_path / "counts"), "complete")
    assert {r["k"]: r["count"] for r in counts.collect()} == {1: 2, 2: 2, 3: 1, 9: 1}
    assert run_to_files(stream(), str(tmp_path / "all")).count() == 6


def test_codes_are_unique(spark):
    g = spark.createDataFrame([(i, c, "PROPOSED", None) for i, c in enumerate(["PIPE", "PIPE", "GASKET", None, "FILTER"])], "group_id long, category string, status string, code_serial long")
    out = governance.activate_groups(g, g.select("group_id")).collect()
    assert len({r["canonical_code"] for r in out if r["group_id"] != 3}) == 4


def test_candidates_share_something(spark):
    d = harmonize.describe(catalog(spark, [(1, "PIPE", "CS PIPE 50MM"), (2, "PIPE", "CS PIPE 50MM"), (3, "PIPE", "BRASS TUBE 80MM"), (4, "VALVE", "CS PIPE 50MM")]))
    out = {(r["material_id"], r["candidate_id"]) for r in joins.candidate_retrieval(d).collect()}
    assert {(1, 2), (2, 1)} <= out and not any(4 in p for p in out)


def test_serials_continue_over_ranges(spark):
    new = spark.createDataFrame([(i, c) for i in range(0, 60, 3) for c in ("PIPE", None)], "group_id long, category string").withColumn("group_id", F.when(F.col("category").isNull(), F.col("group_id") + 1).otherwise(F.col("group_id")))
    groups = spark.createDataFrame([("PIPE", 7), ("PIPE", 3), ("PUMP", 90)], "category string, code_serial long")
    for ranges in (1, 4, 1000):
        out = governance.allocate_serials(new, groups, ranges).collect()
        assert [r["serial"] for r in sorted(out, key=lambda r: r["group_id"]) if r["category"] == "PIPE"] == list(range(8, 28))
        assert [r["serial"] for r in sorted(out, key=lambda r: r["group_id"]) if r["category"] is None] == list(range(1, 21))


def test_audit_chain_goes_on_over_batches(spark):
    events = spark.range(1, 60).select((F.col("id") % 3).alias("chain"), F.col("id").alias("audit_id"), F.lit(1).alias("user_id"), F.lit("EDIT").alias("action"), F.lit("MATERIAL").alias("entity_type"), F.col("id").alias("entity_id"), F.lit(None).cast("string").alias("old_value"), F.col("id").cast("string").alias("new_value"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        rows = audit.append(events).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for chain in range(3):
        own = sorted((r for r in rows if r["chain"] == chain), key=lambda r: r["audit_id"])
        assert [r["prev_hash"] for r in own] == ["0" * 64, *[r["row_hash"] for r in own[:-1]]] and len({r["row_hash"] for r in own}) == len(own)


def test_tfidf_cosine_by_hand(spark):
    import math

    from stockmerge.operators import tfidf

    docs = spark.createDataFrame([(1, "aa bb"), (2, "aa cc"), (3, "dd dd"), (4, "dd")], "id long, text string")
    idf = {"aa": math.log(5 / 3) + 1, "dd": math.log(5 / 3) + 1}  # terms of one document go
    terms = tfidf.word_terms(F.col("text"))
    assert {r["term"]: round(r["idf"], 9) for r in tfidf.fit(docs, terms).collect()} == {k: round(v, 9) for k, v in idf.items()}
    pairs = spark.createDataFrame([(1, 2), (3, 4), (1, 3)], "a long, b long")
    got = {(r["a"], r["b"]): round(r["cosine"], 9) for r in tfidf.cosine(pairs, tfidf.transform(docs, terms, tfidf.fit(docs, terms))).collect()}
    assert got == {(1, 2): 1.0, (3, 4): 1.0, (1, 3): 0.0}


def test_pair_features_and_forest(spark, tmp_path):
    from stockmerge.operators import model

    rows = [("CS PIPE 50MM SCH40", "CS PIPE 50MM SCH40", "EXACT_DUPLICATE"), ("CS PIPE 50MM SCH40", "PVC PIPE 80MM SCH80", "NOT_A_MATCH"), ("", "PVC PIPE 80MM SCH80", "NOT_A_MATCH")]
    pairs = spark.createDataFrame([(i, "PIPE", a, "", b, "", label) for i, (a, b, label) in enumerate(rows * 6)], "k long, category string, description_a string, specification_a string, description_b string, specification_b string, label string")
    corpus = spark.createDataFrame([(t, "") for t in ("CS PIPE 50MM SCH40", "CS PIPE 80MM SCH80", "PVC PIPE 80MM SCH80")], "description string, specification string")
    features = model.pair_features(pairs, corpus).cache()
    assert features.count() == len(pairs.collect()) and len(model.FEATURES) == 17
    first = {r["k"]: r for r in features.where("k < 3").collect()}
    assert round(first[0]["word_cosine"], 9) == round(first[0]["char_cosine"], 9) == 1 and 0 < first[1]["char_cosine"] < 1 and first[2]["word_cosine"] == 0
    fitted = model.train(features.select("label", *model.FEATURES), trees=3, depth=3)
    scored = {r["k"]: r for r in model.guard(model.score(features, fitted)).where("k < 3").collect()}
    assert scored[0]["predicted"] == "EXACT_DUPLICATE" and scored[1]["predicted"] == "NOT_A_MATCH" and (scored[2]["predicted"], scored[2]["match_probability"]) == ("NEEDS_REVIEW", 0.0)
    model.register(fitted, {"f1": 1.0}, "v1", str(tmp_path / "models"), spark)
    known = model.register(fitted, {"f1": 0.5}, "v2", str(tmp_path / "models"), spark).collect()
    assert {r["version"]: r["active"] for r in known} == {"v1": False, "v2": True}


def test_pairs_view_reaches_every_repeated_description(spark):
    from stockmerge.plans.views import view

    catalog, pairs = (view(spark, "/root/testdata/sf0.001", n) for n in ("catalog", "pairs"))
    often = {r["material_id"] for r in catalog.join(catalog.groupBy("category", "description").count().where("count > 1"), ["category", "description"]).collect()}
    found = pairs.collect()
    assert often <= {i for r in found for i in (r["id_a"], r["id_b"])} and all(r["id_a"] < r["id_b"] for r in found)
    assert len({(r["id_a"], r["id_b"]) for r in found}) == len(found) <= 3 * catalog.count()
