"""Work that is done once for each distinct text, and links of a category."""

from itertools import combinations

from pyspark.sql import functions as F

from stockmerge.functions import attributes as A
from stockmerge.functions import text as X
from stockmerge.operators import harmonize as H
from stockmerge.operators import joins as J
from stockmerge.operators import matching as M
from stockmerge.operators import model

RECORD = "material_id long, category string, description string, specification string"


def test_matches_are_scored_once_for_each_pair_of_texts(spark):
    rows = [(100 * t + i, "PIPE", f"CS PIPE {s}MM SCH40", "ASTM A106") for t, s in enumerate((50, 80)) for i in range(60)]
    seen = []

    def scorer(pairs):
        seen.append(pairs.count())
        return M.heuristic_compare(pairs)

    top = {r["a"]: r["b"] for r in H.top_matches(H.describe(spark.createDataFrame(rows, RECORD)), scorer=scorer).collect()}
    # before: 25 pairs for each of 120 records
    assert seen == [2]
    # of 25 equal texts with the greatest ids the least one, never the record itself
    assert top == {100 * t + i: 100 * t + (34 if i >= 35 else 35) for t in (0, 1) for i in range(60)}


def test_targets_match_the_pool(spark):
    rows = [(i, "PIPE", f"CS PIPE {50 + 30 * (i % 2)}MM SCH40", None) for i in range(8)]
    d = H.describe(spark.createDataFrame(rows, RECORD))
    every = {r["a"]: r for r in H.top_matches(d).collect()}
    some = {r["a"]: r for r in H.top_matches(d.where("material_id IN (1, 6)"), pool=d).collect()}
    assert len(every) == 8 and some == {i: every[i] for i in (1, 6)}


def test_content_is_worked_with_once(spark):
    rows = spark.createDataFrame([(i, "a" if i % 2 else None, "") for i in range(10)], "id long, x string, y string")
    seen = []
    out = X.per_content(rows, ["x", "y"], lambda few: few.withColumn("n", F.coalesce(F.col("x"), F.lit("none"))), lambda few: seen.append(few.count()) or few)
    assert seen == [2] and {(r["id"], r["x"], r["n"]) for r in out.collect()} == {(i, "a", "a") if i % 2 else (i, None, "none") for i in range(10)}


def test_pairs_are_compared_once_for_each_pair_of_texts(spark):
    rows = [(i, "PIPE", "CS PIPE 50MM", None, f"CS PIPE {50 + i % 2}MM", "x") for i in range(10)]
    pairs = spark.createDataFrame(rows, "id long, category string, description_a string, specification_a string, description_b string, specification_b string")
    seen = []
    out = model.per_pair(pairs, lambda few: seen.append(few.count()) or few.withColumn("n", F.length("description_b"))).collect()
    assert seen == [2] and len(out) == 10 and out[0]["description_a"] == "CS PIPE 50MM"


def test_fallback_does_not_move_targets(spark):
    pool = spark.createDataFrame([(i, "AB"[i % 2]) for i in range(9)], "material_id long, category string")
    targets = pool.withColumn("category", F.when(F.col("material_id") != 4, F.col("category")))
    out = J.candidate_fallback(targets, pool, 3)
    got = {}
    for r in out.orderBy("rank").collect():
        got.setdefault(r["material_id"], []).append(r["candidate_id"])
    assert got == {i: ([0, 1, 2] if i == 4 else [j for j in range(9) if j % 2 == i % 2 and j != i][:3]) for i in range(9)}
    assert "hashpartitioning(material_id" not in out._jdf.queryExecution().executedPlan().toString()


def test_references_of_seven_digits_are_those_of_the_sql(spark):
    from stockmerge.plans import load

    part = [(i, "red rod", "Brand#12", "SMALL", 4, 1.0) for i in (7, 999999, 1234567)]
    folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/references"
    spark.createDataFrame(part, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.mode("overwrite").parquet(f"{folder}/part.parquet")
    got = {r["material_id"]: r["code"][-7:] for r in load()[0]["g24_catalog_reference"](spark, folder).collect()}
    assert got == {7: "-000007", 999999: "-999999", 1234567: "-123456"}
    assert spark.range(1).select(A.catalog_reference(F.lit("PIPE"), F.lit(1234567))).first()[0].endswith("-1234567")  # serials stay distinct


def test_links_of_a_category_reach_different_texts(spark):
    rows = [(i, "pipe" if i % 3 else "PIPE", f"text {i % 7}") for i in range(40)] + [(99, "VALVE", "text 1")]
    links = J.category_links(spark.createDataFrame(rows, "material_id long, category string, description string"), tile=2).collect()
    members = {}
    for r in links:
        if r["kind"] == "member":
            members.setdefault(r["representative"], []).append(r["other"])
    found = [p for m in members.values() for p in combinations(sorted(m), 2)]
    found += [tuple(sorted((x, y))) for r in links if r["kind"] == "pair" for x in members[r["representative"]] for y in members[r["other"]]]
    assert sorted(found) == list(combinations(range(40), 2))
    assert all(r["links"] == len(members[r["representative"]]) * len(members[r["other"]]) for r in links if r["kind"] == "pair")
