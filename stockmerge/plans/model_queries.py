"""Pair corpora, splits, features, forests and odd rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import config as C
from ..functions import attributes as A
from ..functions import text as X
from ..operators import model as M
from ..operators import pairs as P
from ..operators import stats as D
from ..operators.matching import find_matches
from ..operators.scratch import checkpointed, shared_folder
from .registry import query
from .matching_queries import CHARS, FEATURES, TERMS, TEXT_PLACE, train
from .text_queries import CRITICAL, FLAT, SQL_NORMAL, SQL_SORTED, sql_partial, sql_ratio


def records(t):
    return A.extract_attributes(t.catalog)


CRIT = f"""flat AS ({FLAT}), crit AS (SELECT c.material_id, c.category, i.key, coalesce(f.value, '') AS value FROM catalog c JOIN {CRITICAL} ON i.category = c.category LEFT JOIN flat f ON f.material_id = c.material_id AND f.key = i.key),
  sets AS (SELECT material_id, any_value(category) AS category, string_agg(key || '=' || value, ';' ORDER BY key) AS s FROM crit GROUP BY 1), item AS (SELECT min(material_id) AS id, category, s FROM sets GROUP BY 2, 3)"""
LEFT_OUT = "lo AS (SELECT item.id, item.category, x.key, x.value, string_agg(y.key || '=' || y.value, ';' ORDER BY y.key) AS rest FROM item JOIN crit x ON x.material_id = item.id LEFT JOIN crit y ON y.material_id = item.id AND y.key <> x.key GROUP BY 1, 2, 3, 4)"


NEIGHBOURS = "SELECT a.id, b.id AS other, a.key AS attribute FROM lo a JOIN lo b ON a.category = b.category AND a.key = b.key AND a.rest IS NOT DISTINCT FROM b.rest AND a.value <> b.value QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY md5(a.id::VARCHAR || '|' || b.id::VARCHAR), b.id) <= 2"


@query("c11_attribute_neighbours", f"WITH {CRIT}, {LEFT_OUT} {NEIGHBOURS}")
def _(t):
    return P.attribute_neighbours(P.items(records(t)))


@query("c12_within_group_pairs", "WITH m AS (SELECT material_id, category || '|' || description AS item FROM catalog QUALIFY row_number() OVER (PARTITION BY category, description ORDER BY md5(material_id::VARCHAR), material_id) <= 4) SELECT x.item, x.material_id AS a, y.material_id AS b FROM m x JOIN m y ON x.item = y.item AND x.material_id < y.material_id")
def _(t):
    return P.within_group_pairs(t.catalog.withColumn("item", F.concat_ws("|", "category", "description")), "item")


NEGATIVES = lambda rows, block, other, most: f"""SELECT material_id AS a, b FROM (SELECT material_id, h, {other} AS own, lead(material_id) OVER w AS b, lead({other}) OVER w AS their
  FROM (SELECT *, md5(material_id::VARCHAR || '|42') AS h FROM {rows}) n WINDOW w AS (PARTITION BY {block}, translate(substr(h, 1, 2), '4567cdef', '012389ab') ORDER BY h, material_id)) m
  WHERE b IS NOT NULL AND own IS DISTINCT FROM their ORDER BY h, material_id LIMIT {most}"""  # noqa: E731
ANY = "substr(md5(material_id::VARCHAR), 1, 1)"


@query("c13_negative_pairs_same_category", NEGATIVES("catalog", "category", "description", 6000))
def _(t):
    return P.negative_pairs(t.catalog, "category", "description", 6000)


@query("c14_negative_pairs_cross_category", NEGATIVES("catalog", ANY, "category", 2000))
def _(t):
    return P.negative_pairs(t.catalog.withColumn("all", F.substring(P.draw("material_id"), 1, 1)), "all", "category", 2000)


RULES = [("FASTENER", {"grade": "8.8"}, {"grade": "4.6"}), ("BEARING", {"seal_type": "2RS"}, {"seal_type": "ZZ"}), ("MOTOR", {"rpm": "960.0"}, {"rpm": "1440.0"})]
TWIN = " UNION ALL ".join(
    f"SELECT a, b FROM (SELECT rest, min(material_id) AS a FROM r WHERE category = '{c}' AND key = '{k}' AND value = '{v}' GROUP BY 1) x JOIN (SELECT rest, min(material_id) AS b FROM r WHERE category = '{c}' AND key = '{k}' AND value = '{y[k]}' GROUP BY 1) z ON x.rest IS NOT DISTINCT FROM z.rest"
    for c, x, y in RULES for k, v in x.items()
)


@query("c15_equivalence_twin_pairs", f"WITH flat AS ({FLAT}), r AS (SELECT x.material_id, x.category, x.key, x.value, string_agg(y.key || '=' || y.value, ';' ORDER BY y.key) AS rest FROM flat x LEFT JOIN flat y ON y.material_id = x.material_id AND y.key <> x.key WHERE x.key IN ('grade', 'seal_type', 'rpm') GROUP BY 1, 2, 3, 4) {TWIN}")
def _(t):
    return P.equivalence_twins(records(t), RULES)


LACK = "lack AS (SELECT id, count(*) FILTER (WHERE value = '') AS n FROM lo GROUP BY 1)"
MISSING = "SELECT a.id AS a, b.id AS b, a.key AS attribute FROM lo a JOIN lack la ON la.id = a.id AND la.n = 0 JOIN lo b ON b.category = a.category AND b.key = a.key AND b.rest IS NOT DISTINCT FROM a.rest AND b.value = '' JOIN lack lb ON lb.id = b.id AND lb.n = 1"


@query("c16_missing_attribute_pairs", f"WITH {CRIT}, {LEFT_OUT}, {LACK} {MISSING}")
def _(t):
    return P.missing_attribute_pairs(records(t))


PAIR = "SELECT id_a AS a, id_b AS b FROM pairs"


@query("c17_broken_reference_check", "SELECT id_a AS a, id_b AS b FROM pairs WHERE id_a NOT IN (SELECT s_suppkey * 7 FROM supplier) OR id_b NOT IN (SELECT s_suppkey * 7 FROM supplier)")
def _(t):
    return P.broken_references(t.pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), t.supplier.select((F.col("s_suppkey") * 7).alias("material_id")))


PLACE = "(('0x' || substr(md5(material_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
PARTS = f"parts AS (SELECT material_id AS id, CASE WHEN {PLACE} < 0.70::DOUBLE THEN 'train' WHEN {PLACE} < 0.85::DOUBLE THEN 'val' ELSE 'test' END AS part FROM catalog)"


def parts(t):
    return P.split(t.catalog.select(F.col("material_id").alias("id")))


@query("h05_canonical_group_split", f"WITH {PARTS} SELECT id_a AS a, id_b AS b, CASE WHEN x.part = y.part THEN x.part ELSE 'cross' END AS part FROM pairs JOIN parts x ON x.id = id_a JOIN parts y ON y.id = id_b")
def _(t):
    return P.split_pairs(t.pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), parts(t))


@query("f03_split_disjointness", f"""WITH {PARTS}, kept AS (SELECT id_a, id_b, x.part FROM pairs JOIN parts x ON x.id = id_a JOIN parts y ON y.id = id_b WHERE x.part = y.part),
  ends AS (SELECT id_a AS id, part FROM kept UNION SELECT id_b, part FROM kept), twice AS (SELECT id FROM ends GROUP BY 1 HAVING count(DISTINCT part) > 1)
  SELECT part, count(*) AS pairs, (SELECT count(DISTINCT id) FROM ends e WHERE e.part = kept.part) AS n, (SELECT count(*) FROM ends e JOIN twice USING (id) WHERE e.part = kept.part) AS shared FROM kept GROUP BY 1""")  # fmt: skip
def _(t):
    """Of the pairs that the split keeps, which ids stand in more than one part."""
    kept = checkpointed(P.split_pairs(t.pairs.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), parts(t)).where("part <> 'cross'"))
    ends = kept.select(F.col("a").alias("id"), "part").union(kept.select("b", "part")).distinct()
    twice = ends.groupBy("id").agg(F.count_distinct("part").alias("k"))
    per = ends.join(twice, "id").groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("k") > 1).alias("shared"))
    return kept.groupBy("part").agg(F.count("*").alias("pairs")).join(per, "part").select("part", "pairs", "n", "shared")


@query("d15_structural_checks", "SELECT count(*) - count(DISTINCT category || '|' || description || '|' || specification) AS duplicates, count(*) FILTER (WHERE trim(description) = '') AS blank, count(*) FILTER (WHERE material_id IS NULL) AS no_id, count(*) FILTER (WHERE specification = '') AS no_specification FROM catalog")
def _(t):
    blank = lambda c: D.count_where(F.trim(c) == "")
    distinct = F.count_distinct(F.concat_ws("|", "category", "description", "specification"))
    return t.catalog.agg((F.count("*") - distinct).alias("duplicates"), blank("description").alias("blank"), D.count_where(F.col("material_id").isNull()).alias("no_id"), blank("specification").alias("no_specification"))


def _fit(category: str, side: dict[str, str], both: set[str]) -> str:
    """Least id of each rest of attributes among the records that fit one side of a rule."""
    hits = " OR ".join(f"key = '{k}' AND replace(upper(value), ' ', '') = '{v.upper().replace(' ', '')}'" for k, v in side.items())
    other = "key NOT IN (" + ", ".join(f"'{k}'" for k in sorted(both)) + ")"
    return f"""SELECT rest, min(material_id) AS id FROM (SELECT material_id, coalesce(string_agg(key || '=' || value, ';' ORDER BY key) FILTER (WHERE {other}), '') AS rest
      FROM flat WHERE category = '{category}' GROUP BY 1 HAVING count(*) FILTER (WHERE {hits}) = {len(side)}) GROUP BY 1"""


EQUIVALENT = " UNION ALL ".join(f"SELECT x.id AS a, y.id AS b FROM ({_fit(c, left, {*left, *right})}) x JOIN ({_fit(c, right, {*left, *right})}) y ON x.rest = y.rest" for c, left, right in P.EQUIVALENCE_RULES)
IDENTITY = "(" + ", ".join(f"('{c}', '{k}')" for c, s in [*C.CATEGORY_SCHEMAS.items(), ("GENERAL_MRO", C.OPEN_SCHEMA)] for k in s[0]) + ")"
ALNUM = lambda t: f"regexp_replace(upper({t}.description || {t}.specification), '[^A-Z0-9]', '', 'g')"
CORPUS = f"""{CRIT}, {LEFT_OUT}, {LACK}, near AS ({NEIGHBOURS}),
  few AS (SELECT * FROM sets QUALIFY row_number() OVER (PARTITION BY category, s ORDER BY md5(material_id::VARCHAR), material_id) <= 4),
  corpus AS (SELECT near.id AS a, other AS b, CASE WHEN (category, attribute) IN {IDENTITY} THEN 'NOT_A_MATCH' ELSE 'VARIANT' END AS label FROM near JOIN item ON item.id = near.id
    UNION ALL SELECT x.material_id, y.material_id, CASE WHEN {ALNUM('cx')} = {ALNUM('cy')} THEN 'EXACT_DUPLICATE' ELSE 'NEAR_DUPLICATE' END FROM few x JOIN few y ON x.category = y.category AND x.s = y.s AND x.material_id < y.material_id
      JOIN catalog cx ON cx.material_id = x.material_id JOIN catalog cy ON cy.material_id = y.material_id
    UNION ALL SELECT a, b, 'NOT_A_MATCH' FROM ({NEGATIVES('sets', 'category', "category || '|' || s", 6000)})
    UNION ALL SELECT a, b, 'NOT_A_MATCH' FROM ({NEGATIVES('sets', ANY, 'category', 2000)})
    UNION ALL SELECT a, b, 'FUNCTIONALLY_EQUIVALENT' FROM ({EQUIVALENT})
    UNION ALL SELECT a, b, 'NEEDS_REVIEW' FROM ({MISSING}))"""


@query("f01_pair_corpus_union", f"WITH {CORPUS} SELECT a, b, label FROM corpus")
def corpus(t):
    return P.corpus(records(t))


@query("h17_build_pair_corpus", f"WITH {CORPUS} SELECT label, count(*) AS n FROM corpus GROUP BY 1")
def _(t):
    return corpus(t).groupBy("label").agg(F.count("*").alias("n"))


def labelled(t):
    side = lambda s, c: t.catalog.select(F.col("material_id").alias(c), *([F.col("category")] if s == "a" else []), F.col("description").alias(f"description_{s}"), F.col("specification").alias(f"specification_{s}"))
    return checkpointed(corpus(t).join(side("a", "a"), "a").join(side("b", "b"), "b"))  # read by the features and by both cosines


def content(t) -> str:
    """A name for what the catalog holds, so that a saved model is used for these rows alone."""
    n, h = t.catalog.agg(F.count("*"), F.sum(F.xxhash64(*t.catalog.columns).cast("decimal(38,0)"))).first()
    return f"{n}-{h or 0}".replace("--", "-m")


def models(t) -> str:
    return f"{shared_folder(t.spark)}/models/{content(t)}-train"


def learned(t):
    """The distinct texts that vocabularies may learn from."""
    return train(t.catalog.select("description", "specification").distinct())


def registered(t, trees: int = 300, depth: int = 18, path: str | None = None):
    """(model, version): fitted and registered by the first who asks for it, loaded by all others.  It learns from pairs with both texts in
    the training part and is measured on those with both in the test part."""
    path, version = path or models(t), f"forest-{trees}x{depth}"
    if not M.registered(t.spark, path, version):
        part = lambda s: P.text_part(f"description_{s}")
        features = checkpointed(M.pair_features(labelled(t), learned(t)).select("label", F.when(part("a") == part("b"), part("a")).otherwise("cross").alias("part"), *M.FEATURES))
        learnt, unseen = features.where("part = 'train'"), features.where("part = 'test'")
        model = M.train(learnt, trees, depth)
        M.register(model, {"trees": float(trees), "depth": float(depth), "pairs": float(learnt.count()), **M.measured(unseen, model)}, version, path, t.spark)
    return M.load(t.spark, path, version)


@query("h06_train_classifier")
def _(t):
    return M.importances(registered(t)[0], t.spark).where("importance > 0")


@query("h06_held_out_metrics")
def _(t):
    """How the registered forest does on pairs of texts that neither it nor the vocabulary has seen."""
    registered(t)
    return M.registry(t.spark, models(t)).where("active").select("version", F.explode("metrics").alias("metric", "value"))


@query("d17_feature_importance")
def _(t):
    return M.importances(registered(t)[0], t.spark)


@query("h07_score_pairs")
def _(t):
    return M.score_pairs(t.pairs, learned(t), *registered(t)).select("id_a", "id_b", "predicted", "match_probability", "label_probability", "tier", "model_version")


def compared(t):
    return M.compare(t.pairs, learned(t), *registered(t))


@query("h12_compare_pairs")
def _(t):
    texts = [F.array_join(c, "; ").alias(c) for c in ("checks", "warnings", "conflicts", "critical_conflicts")]
    evidence = [F.col("evidence")[k].alias(n) for k, n in (("lexicalSimilarity", "lexical_similarity"), ("attributeCompatibility", "attribute_compatibility"), ("categoryCompatibility", "category_compatibility"))]
    return compared(t).select("id_a", "id_b", "predicted", "match_probability", "tier", "scorer", *texts, *evidence, "model_version")


WORDS = lambda x: TERMS(f"regexp_extract_all(lower({x}), '\\w\\w+')")


def sql_cosine(name: str, terms) -> str:
    """The cosines of the distinct pairs of texts (na, nb) of ``t``, with the vocabulary of ``corpus``, the training part."""
    return f"""{name}_v AS (SELECT term, ln((1 + (SELECT count(*) FROM corpus)) / (1 + count(*))) + 1 AS idf FROM (SELECT unnest(list_distinct({terms("text")})) AS term FROM corpus) GROUP BY 1 HAVING count(*) >= 2),
  {name}_r AS (SELECT text, term, count(*) * any_value(idf) AS w FROM (SELECT text, unnest({terms("text")}) AS term FROM (SELECT na AS text FROM t UNION SELECT nb FROM t)) JOIN {name}_v USING (term) GROUP BY 1, 2),
  {name}_u AS (SELECT text, term, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS w FROM {name}_r),
  {name} AS (SELECT na, nb, coalesce(sum(x.w * y.w), 0) AS cosine FROM (SELECT DISTINCT na, nb FROM t) LEFT JOIN {name}_u x ON x.text = na LEFT JOIN {name}_u y ON y.text = nb AND y.term = x.term GROUP BY 1, 2)"""


TEXTS = f"""t AS (SELECT *, {SQL_NORMAL("a")} AS na, {SQL_NORMAL("b")} AS nb, {SQL_SORTED(SQL_NORMAL("a"))} AS sa, {SQL_SORTED(SQL_NORMAL("b"))} AS sb FROM pairs WHERE %s),
  corpus AS (SELECT DISTINCT {SQL_NORMAL("a").replace("description_a", "description").replace("specification_a", "specification")} AS text FROM catalog WHERE {TEXT_PLACE("description")} < 0.70::DOUBLE)"""
UNKNOWN = "category NOT IN (" + ", ".join(f"'{c}'" for c in M.KNOWN) + ")"


@query("h12_open_domain", f"""WITH {TEXTS % UNKNOWN}, {sql_cosine("word", WORDS)}, {sql_cosine("chars", CHARS)},
  o AS (SELECT id_a, id_b, round(0.40::DOUBLE * word.cosine + 0.25::DOUBLE * chars.cosine + 0.20::DOUBLE * s.ratio + 0.15::DOUBLE * r.ratio, 4) AS match_probability, 0.40::DOUBLE * word.cosine + 0.25::DOUBLE * chars.cosine + 0.20::DOUBLE * s.ratio + 0.15::DOUBLE * r.ratio AS score
    FROM t JOIN word ON word.na = t.na AND word.nb = t.nb JOIN chars ON chars.na = t.na AND chars.nb = t.nb JOIN {sql_ratio("na", "nb")} r ON r.ta = t.na AND r.tb = t.nb JOIN {sql_ratio("sa", "sb")} s ON s.ta = t.sa AND s.tb = t.sb)
  SELECT id_a, id_b, match_probability, CASE WHEN score >= 0.85::DOUBLE THEN 'EXACT_DUPLICATE' WHEN score >= 0.75::DOUBLE THEN 'NEAR_DUPLICATE' WHEN score >= 0.60::DOUBLE THEN 'FUNCTIONALLY_EQUIVALENT' WHEN score >= 0.35::DOUBLE THEN 'NEEDS_REVIEW' ELSE 'NOT_A_MATCH' END AS predicted,
    CASE WHEN match_probability >= 0.85 THEN 'HIGH' WHEN match_probability >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS tier, 'forest-300x18' AS model_version FROM o""")  # fmt: skip
def _(t):
    """Of all comparisons those of categories without a schema."""
    return compared(t).where("scorer = 'open_domain'").select("id_a", "id_b", "match_probability", "predicted", "tier", "model_version")


@query("h04_text_features", f"""WITH {TEXTS % "true"}, {sql_cosine("word", WORDS)}, {sql_cosine("chars", CHARS)}
  SELECT id_a, id_b, round(word.cosine, 9) AS word_cosine, round(chars.cosine, 9) AS char_cosine, round(r.ratio, 9) AS fuzz_ratio, round(s.ratio, 9) AS fuzz_token_sort,
    CASE WHEN greatest(length(t.na), length(t.nb)) = 0 THEN 1.0::DOUBLE ELSE least(length(t.na), length(t.nb)) / greatest(length(t.na), length(t.nb)) END AS len_ratio
  FROM t JOIN word ON word.na = t.na AND word.nb = t.nb JOIN chars ON chars.na = t.na AND chars.nb = t.nb JOIN {sql_ratio("na", "nb")} r ON r.ta = t.na AND r.tb = t.nb JOIN {sql_ratio("sa", "sb")} s ON s.ta = t.sa AND s.tb = t.sb""")  # fmt: skip
def _(t):
    """The text part of the feature vector but for the partial ratio; h03 is the attribute part."""
    rounded = [F.round(c, 9).alias(c) for c in ("word_cosine", "char_cosine", "fuzz_ratio", "fuzz_token_sort")]
    return M.pair_features(t.pairs, learned(t)).select("id_a", "id_b", *rounded, "len_ratio")


INTEGRAL = [f for f in M.FEATURES if f.startswith("n_") or f.endswith(("_conflict", "_missing")) or f == "same_category"]


@query("h04_pair_features", f"""WITH {TEXTS % "true"}, {sql_cosine("word", WORDS)}, {sql_cosine("chars", CHARS)}, f AS MATERIALIZED ({FEATURES})
  SELECT t.id_a, t.id_b, {", ".join(f"{c}::DOUBLE AS {c}" for c in INTEGRAL)}, round(frac_agree::DOUBLE, 9) AS frac_agree, round(word.cosine, 9) AS word_cosine, round(chars.cosine, 9) AS char_cosine, round(r.ratio, 9) AS fuzz_ratio,
    round(s.ratio, 9) AS fuzz_token_sort, round(q.partial, 9) AS fuzz_partial, round(CASE WHEN greatest(length(t.na), length(t.nb)) = 0 THEN 1.0::DOUBLE ELSE least(length(t.na), length(t.nb)) / greatest(length(t.na), length(t.nb)) END, 9) AS len_ratio
  FROM t JOIN f ON f.id_a = t.id_a AND f.id_b = t.id_b JOIN word ON word.na = t.na AND word.nb = t.nb JOIN chars ON chars.na = t.na AND chars.nb = t.nb JOIN {sql_ratio("na", "nb")} r ON r.ta = t.na AND r.tb = t.nb
    JOIN {sql_ratio("sa", "sb")} s ON s.ta = t.sa AND s.tb = t.sb JOIN {sql_partial("na", "nb")} q ON q.ta = t.na AND q.tb = t.nb""")  # fmt: skip
def _(t):
    return M.pair_features(t.pairs, learned(t)).select("id_a", "id_b", *[F.round(c, 9).alias(c) for c in M.FEATURES])


@query("h13_find_matches")
def _(t):
    """For every record the best of its candidates, scored by the registered forest."""
    from ..operators import harmonize as H

    described = checkpointed(H.describe(t.catalog))
    return find_matches(H.top_matches(described, scorer=M.scorer(learned(t), *registered(t))))


@query("h18_model_registry", "SELECT v.version, 'random forest' AS algorithm, v.active, CASE WHEN v.active THEN (SELECT count(*) FROM pairs) ELSE 0 END AS scored FROM (VALUES ('forest-20x8', true), ('forest-10x6', false)) v(version, active)")
def _(t):
    """Two versions; the newer takes over, then the older is made active again and scores."""
    path = f"{shared_folder(t.spark)}/models/{uuid.uuid4().hex}"
    for trees, depth in ((20, 8), (10, 6)):
        registered(t, trees, depth, path)
    M.activate(t.spark, path, "forest-20x8")
    scored = M.score_pairs(t.pairs, learned(t), *M.load(t.spark, path)).groupBy(F.col("model_version").alias("version")).agg(F.count("*").alias("scored"))
    return M.registry(t.spark, path).join(scored, "version", "left").select("version", "algorithm", "active", F.coalesce("scored", F.lit(0)).alias("scored"))


@query("h16_anomaly_scan")
def _(t):
    f = t.texts.select("material_id", *[c.cast("double").alias(k) for k, c in X.surface_features("description").items()])
    return M.outliers(f, "material_id", ["n_chars", "n_tokens", "digit_ratio", "upper_ratio", "punct_ratio"]).select("material_id", "score", "outlier")
