"""TF-IDF retrieval, pair comparison, ranking and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as X
from ..operators import matching as M
from ..operators import pairs as P
from ..operators import stats as D
from ..operators import tfidf as T
from .registry import query
from .text_queries import FLAT, HEURISTIC, NORMALS, SIMILAR, TOKEN_JACCARD, _normal, sql_ratio

TERMS = lambda w: f"list_concat({w}, list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
#: where the hash of a text falls, from 0 to 1; texts below 0.7 are the training part
TEXT_PLACE = lambda d: f"(('0x' || substr(md5(regexp_replace(upper({d}), '[^A-Z0-9]', '', 'g')), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
#: distinct (category, description): id, category; terms of each; idf of the training part; unit weights.
TFIDF = f"""docs AS (SELECT min(material_id) AS id, category, description FROM catalog GROUP BY 2, 3),
  terms AS (SELECT id, unnest({TERMS("regexp_extract_all(lower(description), '\\w\\w+')")}) AS term FROM docs),
  train AS (SELECT id FROM docs WHERE {TEXT_PLACE("description")} < 0.70::DOUBLE),
  vocab AS (SELECT term, count(DISTINCT id) AS df, ln((1 + (SELECT count(*) FROM train)) / (1 + count(DISTINCT id))) + 1 AS idf FROM terms JOIN train USING (id) GROUP BY 1 HAVING count(DISTINCT id) >= 2),
  raw AS (SELECT id, term, count(*) * any_value(idf) AS w FROM terms JOIN vocab USING (term) GROUP BY 1, 2),
  unit AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM raw)"""
TOP = """dots AS (SELECT a, b, round(cosine, 9) AS cosine FROM (SELECT x.id AS a, y.id AS b, sum(x.weight * y.weight) AS cosine FROM unit x JOIN docs dx ON dx.id = x.id JOIN unit y ON y.term = x.term JOIN docs dy ON dy.id = y.id AND dy.category = dx.category WHERE x.id <> y.id GROUP BY 1, 2)),
  top AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM dots QUALIFY rank <= 25)"""
RANKED = "ranked AS (SELECT a, b, cosine AS score, row_number() OVER (PARTITION BY a ORDER BY cosine DESC, b) AS rank FROM top WHERE cosine >= 0.3 QUALIFY rank <= 5)"


def docs(t):
    return t.catalog.groupBy("category", "description").agg(F.min("material_id").alias("id"))


def train(d):
    """The texts that vocabularies and forests may learn from."""
    return d.where(P.text_part() == "train")


def unit(t):
    d, terms = docs(t), T.word_terms(F.col("description"))
    return d, T.transform(d, terms, T.fit(train(d), terms))


@query("h01_tfidf_fit", f"WITH {TFIDF} SELECT term, df, round(idf, 9) AS idf FROM vocab")
def _(t):
    return T.fit(train(docs(t)), T.word_terms(F.col("description"))).withColumn("idf", F.round("idf", 9))


_GRAMS = lambda n: f"CASE WHEN length(p) >= {n} THEN list_transform(range(1, length(p) - {n} + 2), lambda i: substr(p, i::INT, {n})) ELSE [p] END"
CHARS = lambda x: f"flatten(list_transform(list_transform(list_filter(regexp_split_to_array(lower({x}), '\\s+'), lambda w: w <> ''), lambda w: ' ' || w || ' '), lambda p: list_concat({_GRAMS(2)}, {_GRAMS(3)}, {_GRAMS(4)})))"


@query("h01_tfidf_fit_chars", f"""WITH d AS (SELECT DISTINCT category, description FROM catalog WHERE {TEXT_PLACE("description")} < 0.70::DOUBLE)
  SELECT term, count(*) AS df, round(ln((1 + (SELECT count(*) FROM d)) / (1 + count(*))) + 1, 9) AS idf FROM (SELECT unnest(list_distinct({CHARS("description")})) AS term FROM d) GROUP BY 1 HAVING count(*) >= 2""")  # fmt: skip
def _(t):
    return T.fit(train(docs(t)), T.char_terms(F.col("description"))).withColumn("idf", F.round("idf", 9))


PAIR_IDS = "SELECT DISTINCT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM pairs p JOIN docs x ON x.category = p.category AND x.description = description_a JOIN docs y ON y.category = p.category AND y.description = description_b WHERE x.id <> y.id"


def class_pairs(t, d):
    side = lambda s, n: d.select("category", F.col("description").alias(f"description_{s}"), F.col("id").alias(n))
    p = t.pairs.join(side("a", "x"), ["category", "description_a"]).join(side("b", "y"), ["category", "description_b"]).where("x <> y")
    return p.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


COSINES = f"cosines AS (SELECT p.a, p.b, coalesce(sum(x.weight * y.weight), 0) AS cosine FROM ({PAIR_IDS}) p LEFT JOIN unit x ON x.id = p.a LEFT JOIN unit y ON y.id = p.b AND y.term = x.term GROUP BY 1, 2)"


@query("h02_tfidf_cosine", f"WITH {TFIDF}, {COSINES} SELECT a, b, round(cosine, 9) AS cosine FROM cosines")
def _(t):
    d, w = unit(t)
    return T.cosine(class_pairs(t, d), w).withColumn("cosine", F.round("cosine", 9))


def top25(t):
    d, w = unit(t)
    return T.prefilter(w, d.select("id", F.col("category").alias("block")))


@query("e01_prefilter_top25", f"WITH {TFIDF}, {TOP} SELECT a, b, cosine, rank FROM top")
def _(t):
    return top25(t)


def ranked(t):
    return M.rank_matches(top25(t).select("a", "b", F.col("cosine").alias("score")))


@query("e02_rank_matches", f"WITH {TFIDF}, {TOP}, {RANKED} SELECT a, b, score, rank FROM ranked")
def _(t):
    return ranked(t)


@query("e03_candidate_margin", f"WITH {TFIDF}, {TOP}, {RANKED} SELECT a, b, rank, coalesce(lead(score) OVER w, 0) AS second_best, round(greatest(0, score - coalesce(lead(score) OVER w, 0)), 4) AS margin FROM ranked WINDOW w AS (PARTITION BY a ORDER BY rank)")
def _(t):
    return M.margins(ranked(t)).select("a", "b", "rank", "second_best", "margin")


@query("e04_candidate_evidence", f"WITH {TFIDF}, {TOP}, {RANKED} SELECT a, b, rank, active.group_id FROM ranked LEFT JOIN active ON active.material_id = b")
def _(t):
    return ranked(t).join(t.active.select(F.col("material_id").alias("b"), "group_id"), "b", "left").select("a", "b", "rank", "group_id")


NUM = ", ".join(f"'{k}'" for k in M.NUMERIC)
FIELDS = "(VALUES " + ", ".join(f"('{c}', '{k}', {i}, '{'identity_critical' if k in C.CATEGORY_SCHEMAS[c][0] else 'variant_critical' if k in C.CATEGORY_SCHEMAS[c][1] else 'minor'}')" for c, f in C.CATEGORY_FIELDS.items() for i, k in enumerate(f)) + ") AS f(category, key, pos, severity)"
CMP = f"""flat AS ({FLAT}), cmp AS MATERIALIZED (SELECT p.id_a, p.id_b, f.key, f.pos, f.severity, x.value AS a, y.value AS b,
    CASE WHEN f.key IN ({NUM}) THEN abs(x.value::DOUBLE - y.value::DOUBLE) < 0.6 ELSE replace(upper(x.value), ' ', '') = replace(upper(y.value), ' ', '') END AS agree
  FROM pairs p LEFT JOIN {FIELDS} ON f.category = p.category LEFT JOIN flat x ON x.material_id = id_a AND x.key = f.key LEFT JOIN flat y ON y.material_id = id_b AND y.key = f.key)"""
COUNT = lambda c: f"count(*) FILTER (WHERE {c})"
FEATURES = f"""WITH {CMP} SELECT id_a, id_b, 1.0 AS same_category, {COUNT('agree IS NOT NULL')} AS n_attrs_compared, {COUNT('agree')} AS n_attrs_agree, {COUNT('NOT agree')} AS n_attrs_conflict,
  CASE WHEN {COUNT('agree IS NOT NULL')} > 0 THEN {COUNT('agree')} / {COUNT('agree IS NOT NULL')} ELSE 0.5 END AS frac_agree,
  ({COUNT("NOT agree AND severity = 'identity_critical'")} > 0)::INT AS identity_critical_conflict, ({COUNT("NOT agree AND severity = 'variant_critical'")} > 0)::INT AS variant_critical_conflict, ({COUNT("NOT agree AND severity <> 'minor'")} > 0)::INT AS any_type_conflict,
  ({COUNT("(a IS NULL) <> (b IS NULL) AND severity = 'identity_critical'")} > 0)::INT AS identity_critical_missing, ({COUNT("(a IS NULL) <> (b IS NULL) AND severity = 'variant_critical'")} > 0)::INT AS variant_critical_missing,
  {COUNT("(a IS NULL) <> (b IS NULL) AND severity <> 'minor'")} AS n_critical_missing FROM cmp GROUP BY 1, 2"""


@query("h03_attribute_comparison", FEATURES)
def _(t):
    return M.attribute_features(t.pairs).select("id_a", "id_b", *M.ATTRIBUTE_FEATURES)


AGREE = f"SELECT id_a, id_b, key, agree FROM cmp WHERE agree IS NOT NULL"


@query("g32_values_agree", f"WITH {CMP} {AGREE}")
def _(t):
    return M.compared(t.pairs).select("id_a", "id_b", F.explode("cmp").alias("c")).where("c.agree IS NOT NULL").select("id_a", "id_b", "c.key", "c.agree")


JOINED = lambda text, cond: f"coalesce(string_agg({text}, '; ' ORDER BY pos) FILTER (WHERE {cond}), '')"
LABEL = "replace(key, '_', ' ')"
EXPLAIN = f"""WITH {CMP} SELECT id_a, id_b, {JOINED(LABEL + " || ' agrees: ' || a", 'agree')} AS checks,
  {JOINED("'no two values of ' || " + LABEL, "agree IS NULL AND severity <> 'minor'")} AS warnings, {JOINED("severity || ' difference in ' || " + LABEL + " || ': ' || a || ' / ' || b", 'NOT agree')} AS conflicts FROM cmp GROUP BY 1, 2"""


@query("h10_explain_pair", EXPLAIN)
def _(t):
    return M.explain(M.compared(t.pairs)).select("id_a", "id_b", *[F.array_join(c, "; ").alias(c) for c in ("checks", "warnings", "conflicts")])


RATIO_A, RATIO_B = "description_a", "description_b"


@query("h11_score_evidence", f"""WITH f AS ({FEATURES}), s AS (SELECT id_a, id_b, {TOKEN_JACCARD(RATIO_A, RATIO_B)} AS tj, least(length(description_a), length(description_b)) / greatest(length(description_a), length(description_b)) AS lr FROM pairs)
  SELECT f.id_a, f.id_b, round(tj, 4) AS model_probability, round((tj + lr) / 2, 4) AS lexical_similarity, round(frac_agree, 4) AS attribute_compatibility FROM f JOIN s ON s.id_a = f.id_a AND s.id_b = f.id_b""")  # fmt: skip
def _(t):
    f = M.attribute_features(t.pairs)
    tj, lr = X.token_jaccard(F.col("description_a"), F.col("description_b")), X.length_ratio("description_a", "description_b")
    e = X.once(f, e=M.evidence([tj, lr], tj, F.col("frac_agree"), F.col("same_category")))
    return e.select("id_a", "id_b", F.col("e")["modelProbability"].alias("model_probability"), F.col("e")["lexicalSimilarity"].alias("lexical_similarity"), F.col("e")["attributeCompatibility"].alias("attribute_compatibility"))


H = f"h AS ({HEURISTIC})"
EQ = lambda k: f"upper(x.{k}) = upper(y.{k})"
HKEYS = ["material", "nominal_size_mm", "grade", "schedule"]
HN = " + ".join(f"({EQ(k)} IS NOT NULL)::INT" for k in HKEYS)
HA = " + ".join(f"coalesce({EQ(k)}, false)::INT" for k in HKEYS)
HSCORE = f"""{H}, hs AS (SELECT id_a, id_b, {TOKEN_JACCARD(RATIO_A, RATIO_B)} AS lexical, {HN} AS n, {HA} AS agree, coalesce(NOT ({EQ('material')}), false) AS mc,
    coalesce(NOT ({EQ('material')}), false)::INT + coalesce(NOT ({EQ('nominal_size_mm')}), false)::INT + coalesce(NOT ({EQ('standard')}), false)::INT AS n_conflicts
  FROM pairs JOIN h x ON x.material_id = id_a JOIN h y ON y.material_id = id_b),
  hr AS (SELECT *, 0.5::DOUBLE * lexical + 0.4::DOUBLE * CASE WHEN n > 0 THEN agree / n ELSE 0.5::DOUBLE END + 0.1::DOUBLE AS raw FROM hs),
  ho AS (SELECT id_a, id_b, n_conflicts, round(least(1.0::DOUBLE, CASE WHEN mc THEN least(raw, 0.25::DOUBLE) ELSE raw END), 4) AS score FROM hr),
  hl AS (SELECT *, CASE WHEN score >= 0.85 THEN 'NEAR_DUPLICATE' WHEN score >= 0.6 THEN 'FUNCTIONALLY_EQUIVALENT' ELSE 'NOT_A_MATCH' END AS label, CASE WHEN score >= 0.85 THEN 'HIGH' WHEN score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM ho)"""


@query("h15_heuristic_compare", f"WITH {HSCORE} SELECT id_a, id_b, score, label, tier, n_conflicts FROM hl")
def heuristic(t):
    return M.heuristic_compare(t.pairs).select("id_a", "id_b", "score", "label", "tier", "n_conflicts")


@query("h14_recommended_route", f"""WITH {HSCORE}, r AS (SELECT *, greatest(0, score - coalesce(lead(score) OVER (PARTITION BY id_a ORDER BY score DESC, id_b), 0)) AS margin FROM hl)
  SELECT id_a, id_b, CASE WHEN label = 'NEAR_DUPLICATE' AND score >= 0.85 AND round(margin, 4) >= 0.1 AND n_conflicts = 0 THEN 'AUTO_CONFIRM' WHEN score >= 0.6 OR label = 'FUNCTIONALLY_EQUIVALENT' THEN 'REVIEW_REQUIRED' ELSE 'NOVEL' END AS route FROM r""")  # fmt: skip
def _(t):
    from pyspark.sql import Window

    h = heuristic(t).withColumn("a", F.col("id_a"))
    r = h.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "id_b")))
    m = M.margins(r)
    return m.select("id_a", "id_b", M.recommended_route(F.col("label"), F.col("score"), F.col("margin"), F.col("n_conflicts") > 0).alias("route"))


ALNUM = lambda s: f"regexp_replace(upper(description_{s} || specification_{s}), '[^A-Z0-9]', '', 'g')"
JUDGED = f"{HSCORE}, judged AS (SELECT hl.id_a, hl.id_b, score, label AS predicted, CASE WHEN {ALNUM('a')} = {ALNUM('b')} THEN 'NEAR_DUPLICATE' WHEN description_a = description_b THEN 'FUNCTIONALLY_EQUIVALENT' ELSE 'NOT_A_MATCH' END AS truth FROM hl JOIN pairs p ON p.id_a = hl.id_a AND p.id_b = hl.id_b)"


def judged(t):
    key = lambda s: X.alnum_key(F.concat(f"description_{s}", f"specification_{s}"))
    truth = F.when(key("a") == key("b"), "NEAR_DUPLICATE").when(F.col("description_a") == F.col("description_b"), "FUNCTIONALLY_EQUIVALENT").otherwise("NOT_A_MATCH")
    return M.heuristic_compare(t.pairs.withColumn("truth", truth)).select("id_a", "id_b", "score", "truth", F.col("label").alias("predicted"))


SHOWN = ["NEAR_DUPLICATE", "FUNCTIONALLY_EQUIVALENT", "NOT_A_MATCH"]


@query("d09_confusion_matrix", f"WITH {JUDGED} SELECT truth, " + ", ".join(f"{COUNT(f'predicted = {chr(39)}{s}{chr(39)}')} AS {s.lower()}" for s in SHOWN) + " FROM judged GROUP BY 1")
def _(t):
    return D.confusion(judged(t), SHOWN).toDF("truth", *[s.lower() for s in SHOWN])


RATIO = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE {a} / {b} END"


@query("d10_classification_report", f"""WITH {JUDGED}, c AS (SELECT label, {COUNT('truth = label')} AS support, {COUNT('predicted = label')} AS said, {COUNT('truth = label AND predicted = label')} AS hit FROM judged, (SELECT DISTINCT unnest([truth, predicted]) AS label FROM judged) GROUP BY 1),
  p AS (SELECT *, {RATIO('hit', 'said')} AS precision, {RATIO('hit', 'support')} AS recall FROM c) SELECT label, precision, recall, {RATIO('2 * precision * recall', '(precision + recall)')} AS f1, support FROM p""")  # fmt: skip
def _(t):
    return D.classification_report(judged(t))


@query("d11_binary_match_metrics", f"""WITH {JUDGED}, c AS (SELECT {COUNT("truth = 'NEAR_DUPLICATE' AND predicted = 'NEAR_DUPLICATE'")} AS tp, {COUNT("truth <> 'NEAR_DUPLICATE' AND predicted = 'NEAR_DUPLICATE'")} AS fp, {COUNT("truth = 'NEAR_DUPLICATE' AND predicted <> 'NEAR_DUPLICATE'")} AS fn FROM judged),
  p AS (SELECT *, {RATIO('tp', '(tp + fp)')} AS precision, {RATIO('tp', '(tp + fn)')} AS recall FROM c) SELECT *, {RATIO('2 * precision * recall', '(precision + recall)')} AS f1 FROM p""")  # fmt: skip
def _(t):
    return D.binary_metrics(judged(t), C.SAME_ITEM)


@query("d12_false_merge_rate", f"WITH {JUDGED} SELECT avg((predicted = 'NEAR_DUPLICATE')::INT) AS false_merge_rate, count(*) AS n FROM judged WHERE truth = 'NOT_A_MATCH'")
def _(t):
    return D.false_merge_rate(judged(t), C.SAME_ITEM, ["VARIANT", "NOT_A_MATCH"])


SWEEP = f"""{JUDGED}, sw AS (SELECT h / 100 AS threshold, {COUNT("truth = 'NEAR_DUPLICATE' AND floor(score * 100 + 1e-9) >= h")} AS tp, {COUNT('floor(score * 100 + 1e-9) >= h')} AS said, {COUNT("truth = 'NEAR_DUPLICATE'")} AS pos FROM judged, range(30, 96) r(h) GROUP BY h),
  sp AS (SELECT threshold, {RATIO('tp', 'said')} AS precision, {RATIO('tp', 'pos')} AS recall FROM sw), sf AS (SELECT *, {RATIO('2 * precision * recall', '(precision + recall)')} AS f1 FROM sp)"""


def sweep(t):
    return D.threshold_sweep(judged(t).select("score", (F.col("truth") == "NEAR_DUPLICATE").alias("is_same")))


@query("d13_threshold_sweep", f"WITH {SWEEP} SELECT * FROM sf")
def _(t):
    return sweep(t)


@query("h08_baseline_classifier", f"WITH {SWEEP} SELECT threshold, f1 FROM sf ORDER BY f1 DESC, threshold LIMIT 1")
def _(t):
    return D.best_threshold(sweep(t)).select("threshold", "f1")


@query("d14_label_distribution", f"WITH {JUDGED} SELECT truth AS label, count(*) AS n FROM judged GROUP BY 1")
def _(t):
    return judged(t).groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("n"))


@query("f06_valid_label_set", f"WITH {JUDGED} SELECT count(*) AS n, count(*) AS valid FROM judged")
def _(t):
    return judged(t).agg(F.count("*").alias("n"), D.count_where(F.col("truth").isin(C.LABELS)).alias("valid"))


OPEN = f"""{NORMALS}, open AS (SELECT id_a, id_b, 0.40::DOUBLE * {TOKEN_JACCARD("description_a", "description_b")} + 0.25::DOUBLE * {SIMILAR("description_a", "description_b")} + 0.20::DOUBLE * s.ratio + 0.15::DOUBLE * r.ratio AS score
  FROM t JOIN {sql_ratio("na", "nb")} r ON r.ta = na AND r.tb = nb JOIN {sql_ratio("sa", "sb")} s ON s.ta = sa AND s.tb = sb)"""


@query("h09_open_domain_score", f"""WITH {OPEN} SELECT id_a, id_b, round(score, 4) AS score, CASE WHEN score >= 0.85::DOUBLE THEN 'EXACT_DUPLICATE' WHEN score >= 0.75::DOUBLE THEN 'NEAR_DUPLICATE'
  WHEN score >= 0.60::DOUBLE THEN 'FUNCTIONALLY_EQUIVALENT' WHEN score >= 0.35::DOUBLE THEN 'NEEDS_REVIEW' ELSE 'NOT_A_MATCH' END AS label FROM open""")  # fmt: skip
def _(t):
    a, b = _normal("a"), _normal("b")
    likeness = lambda few: X.once(few, r=X.indel_ratio(a, b), s=X.token_sort_ratio(a, b), j=X.token_jaccard(F.col("description_a"), F.col("description_b")), g=X.trigram_similarity("description_a", "description_b"))
    p = X.per_content(t.pairs, [f"{c}_{s}" for c in ("description", "specification") for s in "ab"], likeness)
    score, label = M.open_domain(F.col("j"), F.col("g"), F.col("s"), F.col("r"), F.lit(True))
    return p.select("id_a", "id_b", F.round(score, 4).alias("score"), label.alias("label"))
