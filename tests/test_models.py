"""Comparison, registry, outliers, audit ranges and streams."""

import random

import pytest
from pyspark.sql import functions as F

from stockmerge.operators import audit, model

SIDES = "description_a string, specification_a string, description_b string, specification_b string"


@pytest.fixture(scope="module")
def trained(spark):
    """A small forest and the corpus it reads."""
    same = [(f"CS PIPE {s}MM SCH{h}", f"CS PIPE {s}MM SCH{h}", "EXACT_DUPLICATE") for s in (25, 50, 80) for h in (40, 80)]
    other = [(f"CS PIPE {s}MM SCH40", "PVC PIPE 100MM SCH160", "NOT_A_MATCH") for s in (25, 50, 80)] * 2
    pairs = spark.createDataFrame([("PIPE", a, "", b, "", label) for a, b, label in (same + other) * 2], f"category string, {SIDES}, label string")
    corpus = spark.createDataFrame([(a, "") for a, _, _ in same] + [("PVC PIPE 100MM SCH160", ""), ("ODD BRACKET TX-7 STEEL", ""), ("ODD BRACKET TX-7 STEEL PLATE", "")], "description string, specification string").cache()
    features = model.pair_features(pairs, corpus).select("label", *model.FEATURES)
    return model.train(features, trees=10, depth=4), corpus


def test_compare_routes_and_explains(spark, trained):
    fitted, corpus = trained
    rows = [
        (1, "PIPE", "PIPE", "CS PIPE 50MM SCH40", "", "CS PIPE 50MM SCH40", ""),
        (2, "PIPE", "PIPE", "CS PIPE 50MM SCH40", "", "PVC PIPE 100MM SCH160", ""),
        (3, "GENERAL_MRO", "GENERAL_MRO", "ODD BRACKET TX-7 STEEL", "", "odd bracket, TX-7 steel", ""),
        (4, "GENERAL_MRO", "PIPE", "ODD BRACKET TX-7 STEEL", "", "ODD BRACKET TX-7 STEEL", ""),
        (5, "PIPE", "PIPE", " ", "x", "CS PIPE 50MM SCH40", ""),
        (6, None, "PIPE", None, None, "CS PIPE 50MM SCH40", None),
        (7, None, None, "ODD BRACKET", None, "CS PIPE 50MM SCH40", None),
    ]
    got = {r["k"]: r for r in model.compare(spark.createDataFrame(rows, f"k long, category string, category_b string, {SIDES}"), corpus, fitted, "v9").collect()}
    assert len(got) == 7 and {r["model_version"] for r in got.values()} == {"v9"}
    assert [got[k]["scorer"] for k in range(1, 8)] == ["forest", "forest", "open_domain", "open_domain", "none", "none", "open_domain"]
    assert got[1]["predicted"] == "EXACT_DUPLICATE" and got[1]["match_probability"] > 0.5 and got[2]["predicted"] == "NOT_A_MATCH"
    assert got[2]["critical_conflicts"] and all("identity_critical" in c for c in got[2]["critical_conflicts"]) and not got[1]["conflicts"]
    assert (got[3]["predicted"], got[3]["match_probability"], got[3]["tier"]) == ("EXACT_DUPLICATE", 1.0, "HIGH")
    assert (got[4]["predicted"], got[4]["match_probability"]) == ("FUNCTIONALLY_EQUIVALENT", 0.65) and "GENERAL_MRO / PIPE" in got[4]["conflicts"][0]
    for k in (5, 6):
        assert (got[k]["predicted"], got[k]["match_probability"], got[k]["tier"]) == ("NEEDS_REVIEW", 0.0, "LOW")
    assert got[7]["predicted"] == "NOT_A_MATCH"
    e = got[3]["evidence"]
    assert e["modelProbability"] == 1.0 and e["lexicalSimilarity"] == pytest.approx(1.0) and e["categoryCompatibility"] == 1.0
    assert got[4]["evidence"]["categoryCompatibility"] == 0.0


def test_registry_switches_and_loads(spark, trained, tmp_path):
    fitted, corpus = trained
    path = str(tmp_path / "models")
    assert not model.registered(spark, path, "a")
    for v in ("a", "b"):
        model.register(fitted, {"trees": 10.0}, v, path, spark)
    assert model.registered(spark, path, "a") and {r["version"]: r["active"] for r in model.registry(spark, path).collect()} == {"a": False, "b": True}
    model.activate(spark, path, "a")
    assert {r["version"]: r["active"] for r in model.registry(spark, path).collect()} == {"a": True, "b": False}
    loaded, version = model.load(spark, path)
    assert version == "a" and model.load(spark, path, "b")[1] == "b"
    pairs = spark.createDataFrame([("PIPE", "CS PIPE 50MM SCH40", "", "PVC PIPE 100MM SCH160", "")], f"category string, {SIDES}")
    features = model.pair_features(pairs, corpus).cache()
    a, b = model.score(features, fitted).first(), model.score(features, loaded, version).first()
    assert a["match_probability"] == b["match_probability"] and b["model_version"] == "a"


def test_find_matches_by_the_forest(spark, trained):
    from stockmerge.operators import harmonize
    from stockmerge.operators.matching import find_matches

    fitted, corpus = trained
    rows = [(1, "CS PIPE 50MM SCH40"), (2, "CS PIPE 50MM SCH40"), (3, "PVC PIPE 100MM SCH160")]
    described = harmonize.describe(spark.createDataFrame([(i, "PIPE", d, "", "NOS") for i, d in rows], "material_id long, category string, description string, specification string, uom string"))
    top = {r["a"]: r for r in find_matches(harmonize.top_matches(described, scorer=model.scorer(corpus, fitted, "v"))).collect()}
    assert (top[1]["b"], top[1]["label"]) == (2, "EXACT_DUPLICATE") and (top[2]["b"], top[2]["label"]) == (1, "EXACT_DUPLICATE")


def test_outliers_by_row(spark):
    rng = random.Random(1)
    rows = [(i, rng.gauss(50, 5), rng.gauss(8, 2)) for i in range(3000)] + [(9000 + i, 900.0 + 40 * i, 90.0) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, x double, y double").repartition(3)
    out = model.outliers(df, "id", ["x", "y"], trees=60).collect()
    assert [r["score"] for r in out] == sorted((r["score"] for r in out), reverse=True)
    flagged = {r["id"] for r in out if r["outlier"]}
    assert {9000 + i for i in range(5)} <= flagged and abs(len(flagged) / len(rows) - 0.01) <= 0.002
    equal = spark.range(5000).select(F.lit(1).alias("id"), F.lit(2.0).alias("x"), F.lit(3.0).alias("y"))
    got = model.outliers(equal, "id", ["x", "y"], trees=5)
    assert got.count() == 5000 and not got.where("outlier").count()
    assert model.outliers(df.limit(0), "id", ["x", "y"], trees=3).count() == 0


@pytest.mark.parametrize("ranges", [1, 7, 500])
def test_audit_ranges(spark, ranges):
    events = spark.range(1, 400).select(F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 2).alias("chain"), F.when(F.col("id") == 399, 2**60).otherwise(F.col("id")).cast("long").alias("audit_id"), F.lit(1).alias("user_id"), F.lit("EDIT").alias("action"), F.lit("MATERIAL").alias("entity_type"), F.col("id").alias("entity_id"), F.lit(None).cast("string").alias("old_value"), F.col("id").cast("string").alias("new_value"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    rows = audit.append(events).cache()
    whole = {r["chain"]: r for r in audit.verify(rows, ranges=ranges).collect()}
    assert {c: (r["checked"], r["first_broken"]) for c, r in whole.items()} == {0: (160, None), 1: (160, None), None: (79, None)}
    touched = rows.withColumn("new_value", F.when(F.col("audit_id") == 203, "x").otherwise(F.col("new_value")))
    cut = rows.where("audit_id <> 202")
    assert {r["chain"]: (r["first_broken"], r["reason"]) for r in audit.verify(touched, ranges=ranges).collect()}[1] == (203, "changed content")
    assert {r["chain"]: (r["first_broken"], r["reason"]) for r in audit.verify(cut, ranges=ranges).collect()}[0] == (204, "broken link")
    assert audit.verify(rows.limit(0), ranges=ranges).count() == 0


def test_stream_leaves_out_repeats(spark, tmp_path):
    from stockmerge.streaming.ingest import ingest_new, run_with_progress, without_repeats

    schema = "ts timestamp, k long, v string"
    files = [[("2024-01-01 00:00:00", 1), ("2024-01-01 00:10:00", 1), ("2024-01-01 00:20:00", 2)], [("2024-01-01 00:30:00", 2), ("2024-01-03 00:00:00", 1), ("2024-01-03 00:01:00", 9)], [("2024-01-03 00:02:00", 3)]]
    for i, rows in enumerate(files):
        spark.createDataFrame([(t, k, "x") for t, k in rows], "ts string, k long, v string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    stored = spark.createDataFrame([(9,)], "k long")
    out = ingest_new(without_repeats(stream(), "ts", ["k"], "1 hour"), str(tmp_path / "out"), ["k"], stored)
    assert sorted(r["k"] for r in out.collect()) == [1, 2, 3]
    counts, batches = run_with_progress(stream(), "k", str(tmp_path / "progress"), "seen", largest=F.max("k"))
    assert {r["k"]: r["n"] for r in counts.collect()} == {1: 3, 2: 2, 3: 1, 9: 1}
    assert [(r["batch"], r["rows"], r["input_rows"], r["largest"]) for r in batches.orderBy("batch").collect()] == [(0, 3, 3, 2), (1, 3, 3, 9), (2, 1, 1, 3)]


def test_measured_on_unseen_pairs(spark, trained):
    fitted, corpus = trained
    rows = [("CS PIPE 50MM SCH40", "CS PIPE 50MM SCH40", "EXACT_DUPLICATE")] * 3 + [("CS PIPE 50MM SCH40", "PVC PIPE 100MM SCH160", "NOT_A_MATCH")] * 2 + [("CS PIPE 80MM SCH40", "CS PIPE 80MM SCH40", "VARIANT")]
    pairs = spark.createDataFrame([("PIPE", a, "", b, "", label) for a, b, label in rows], f"category string, {SIDES}, label string")
    got = model.measured(model.pair_features(pairs, corpus), fitted)
    # five of six are right; the label that was never learnt has F1 0, and EXACT_DUPLICATE one false hit
    assert got == {"held_out_pairs": 6.0, "held_out_accuracy": pytest.approx(5 / 6), "held_out_macro_f1": pytest.approx((6 / 7 + 1 + 0) / 3)}
    assert model.measured(model.pair_features(pairs.limit(0), corpus), fitted) == {"held_out_pairs": 0.0, "held_out_accuracy": 0.0, "held_out_macro_f1": 0.0}


def test_equal_texts_lie_in_one_part(spark):
    from stockmerge.operators import pairs as P

    rows = [(f"CS PIPE {i}MM",) for i in range(400)] + [(f"cs pipe, {i} mm",) for i in range(400)] + [(None,), ("",)]
    got = spark.createDataFrame(rows, "description string").withColumn("part", P.text_part()).collect()
    parts = {r["description"]: r["part"] for r in got}
    assert all(parts[f"CS PIPE {i}MM"] == parts[f"cs pipe, {i} mm"] for i in range(400))
    assert 0.6 < sum(p == "train" for p in parts.values()) / len(parts) < 0.8 and set(parts.values()) == {"train", "val", "test"}


def test_partial_ratio_by_two_methods():
    """The SQL reads every window off one table of starts; the function compares window by window."""
    import duckdb

    from stockmerge.functions.text import partial
    from stockmerge.plans.text_queries import sql_partial

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("AB1 ") for _ in range(n))
    rows = [("", ""), ("", "A"), ("A", ""), ("AB", "AB"), ("ABC", "XXABCXX"), ("ÄB", "AÄBA")] + [(word(rng.randint(0, 9)), word(rng.randint(0, 14))) for _ in range(300)]
    db = duckdb.connect()
    db.execute("CREATE TABLE t (na VARCHAR, nb VARCHAR)")
    db.executemany("INSERT INTO t VALUES (?, ?)", rows)
    got = {(a, b): x for a, b, x in db.execute(f"SELECT * FROM {sql_partial('na', 'nb')}").fetchall()}
    assert len(got) == len(set(rows)) and all(got[a, b] == pytest.approx(partial(a, b)) for a, b in rows)
