"""Forest over pair features, and an isolation forest for odd rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions import attributes as A
from ..functions import text as X
from . import tfidf
from .joins import top_k
from .matching import ATTRIBUTE_FEATURES, attribute_features, evidence, explain, open_domain
from .scratch import checkpointed

TEXT_FEATURES = ["fuzz_ratio", "fuzz_token_sort", "fuzz_partial", "len_ratio", "word_cosine", "char_cosine"]
FEATURES = ATTRIBUTE_FEATURES + TEXT_FEATURES


def _normal(side: str = "") -> Column:
    return X.normalize_text(A.full_text(f"description{side}", f"specification{side}"))


def per_pair(pairs: DataFrame, work) -> DataFrame:
    """What ``work`` adds to pairs(category, [category_b,] description_a, specification_a, ..._b), worked out once for each distinct pair of texts."""
    texts = [c for c in ("category", "category_b", "description_a", "specification_a", "description_b", "specification_b") if c in pairs.columns]
    return X.per_content(pairs, texts, work, checkpointed)


def cosines(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """(a, b, word_cosine, char_cosine) of the distinct texts that ``pairs`` compare, by TF-IDF of words and of characters; a and b are
    the MD5 of the normalised texts.  corpus(description, specification) gives the vocabularies."""
    keys = lambda d, s="": d.select(F.md5(_normal(s)).alias("id"), _normal(s).alias("text")).distinct()
    distinct = pairs.select(F.md5(_normal("_a")).alias("a"), F.md5(_normal("_b")).alias("b")).distinct()
    texts, fitted = keys(pairs, "_a").union(keys(pairs, "_b")).distinct(), keys(corpus)
    for name, terms in (("word_cosine", tfidf.word_terms(F.col("text"))), ("char_cosine", tfidf.char_terms(F.col("text")))):
        distinct = tfidf.cosine(distinct, tfidf.transform(texts, terms, tfidf.fit(fitted, terms)), name)
    return distinct


def pair_features(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """pairs(category, description_a, specification_a, ..._b) with the 17 features, worked out once for each distinct pair of texts.  The cosines
    use the vocabulary of ``corpus``; edit distances alone run in Python, on normalised texts, in Arrow batches."""
    return per_pair(pairs, lambda few: distinct_features(few, corpus))


def distinct_features(pairs: DataFrame, corpus: DataFrame) -> DataFrame:
    """``pair_features`` row by row."""
    p = X.once(attribute_features(pairs), ta=_normal("_a"), tb=_normal("_b"))
    p = p.withColumns({"fuzz_ratio": X.indel_ratio("ta", "tb"), "fuzz_token_sort": X.token_sort_ratio(F.col("ta"), F.col("tb")), "fuzz_partial": X.partial_ratio("ta", "tb")})
    p = X.once(p, len_ratio=X.length_ratio("ta", "tb"), ka=F.md5("ta"), kb=F.md5("tb")).join(cosines(pairs, corpus).toDF("ka", "kb", "word_cosine", "char_cosine"), ["ka", "kb"])
    return p.withColumns({c: F.col(c).cast("double") for c in FEATURES}).drop("ta", "tb", "ka", "kb")


def train(features: DataFrame, trees: int = 300, depth: int = 18, seed: int = 42):
    """label and FEATURES -> fitted pipeline; classes weigh n / (k n_c)."""
    n = features.groupBy("label").agg(F.count("*").alias("nc"))  # one row for each of six labels
    total = n.agg(F.sum("nc").alias("n"), F.count("*").alias("k"))
    weighted = features.join(F.broadcast(n), "label").join(F.broadcast(total)).withColumn("weight", F.col("n") / (F.col("k") * F.col("nc")))
    steps = [StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=FEATURES, outputCol="x")]
    return Pipeline(stages=[*steps, RandomForestClassifier(featuresCol="x", labelCol="y", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)]).fit(weighted)


def score_pairs(pairs: DataFrame, corpus: DataFrame, model, version: str) -> DataFrame:
    """``pair_features`` and ``score``, each distinct pair of texts once."""
    return per_pair(pairs, lambda few: score(distinct_features(few, corpus), model, version))


def measured(features: DataFrame, model) -> dict[str, float]:
    """Accuracy, macro F1 over the labels that occur, and the number of pairs, for labelled features that the model has not seen.  No pairs
    give zeros."""
    cells = score(features, model).groupBy("label", "predicted").agg(F.count("*").alias("n")).collect()  # at most the square of six labels
    n = sum(r["n"] for r in cells)
    hit = {r["label"]: r["n"] for r in cells if r["label"] == r["predicted"]}
    total = {name: sum(r["n"] for r in cells if r["label"] == name) + sum(r["n"] for r in cells if r["predicted"] == name) for name in {r["label"] for r in cells}}
    f1 = [2 * hit.get(name, 0) / k for name, k in total.items()]
    return {"held_out_pairs": float(n), "held_out_accuracy": sum(hit.values()) / max(1, n), "held_out_macro_f1": sum(f1) / max(1, len(f1))}


def importances(model, spark) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray()
    return spark.createDataFrame(sorted(((f, float(v)) for f, v in zip(FEATURES, values, strict=True)), key=lambda r: -r[1]), "feature string, importance double")


def score(features: DataFrame, model, version: str | None = None) -> DataFrame:
    """Adds predicted, match_probability (of the labels that mean the same item or its equivalent), label_probability and tier, and with
    ``version`` the model_version that has scored."""
    labels = model.stages[0].labels
    scored = model.stages[-1].transform(model.stages[1].transform(features))
    p = X.once(scored, p=vector_to_array("probability")).drop("x", "probability", "rawPrediction")
    good = [i for i, name in enumerate(labels) if name in C.SAME_ITEM or name == "FUNCTIONALLY_EQUIVALENT"]
    out = p.withColumns({"predicted": F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("prediction") + 1).cast("int")), "match_probability": F.round(sum((F.get("p", F.lit(i)) for i in good), F.lit(0.0)), 4), "label_probability": F.round(F.array_max("p"), 4)})
    out = out.withColumn("tier", X.tier("match_probability")).drop("p", "prediction")
    return out if version is None else out.withColumn("model_version", F.lit(version))


KNOWN = list(C.CATEGORY_FIELDS)


def compare(pairs: DataFrame, corpus: DataFrame, model, version: str) -> DataFrame:
    """The whole comparison of pairs(category, [category_b,] description_a, specification_a, ..._b): predicted, match_probability, label_probability,
    tier, scorer, evidence, checks, warnings, conflicts, critical_conflicts and model_version.

    Pairs of known categories are scored by the forest; if either category is unknown, by weighted text likeness (scorer ``open_domain``),
    which another category lowers.  Attributes are compared within one category.  An empty description gives NEEDS_REVIEW, 0 and
    LOW (scorer ``none``).  Nulls count as empty.  Each distinct pair of texts is compared once."""
    return per_pair(pairs, lambda few: _compare(few, corpus, model, version))


def _compare(pairs: DataFrame, corpus: DataFrame, model, version: str) -> DataFrame:
    other = F.upper(F.coalesce("category_b", F.lit("UNKNOWN"))) if "category_b" in pairs.columns else F.upper(F.coalesce("category", F.lit("UNKNOWN")))
    own = F.upper(F.coalesce("category", F.lit("UNKNOWN")))
    texts = {f"{c}_{s}": F.coalesce(f"{c}_{s}", F.lit("")) for c in ("description", "specification") for s in "ab"}
    p = pairs.withColumns({**texts, "_own": own, "_other": other})
    p = p.withColumn("category", F.when(F.col("_own") == F.col("_other"), F.col("_own")).otherwise(F.lit("")))
    f = explain(distinct_features(p, corpus)).withColumn("same_category", (F.col("_own") == F.col("_other")).cast("double"))
    scored = score(f, model, version)
    likeness, label = open_domain(F.col("word_cosine"), F.col("char_cosine"), F.col("fuzz_token_sort"), F.col("fuzz_ratio"), F.col("same_category") == 1)
    scored = X.once(scored, _score=F.round(likeness, 4), _label=label)
    empty = (F.trim("description_a") == "") | (F.trim("description_b") == "")
    open_ = ~(F.col("_own").isin(KNOWN) & F.col("_other").isin(KNOWN))
    pick = lambda none, text, forest: F.when(empty, none).when(open_, text).otherwise(forest)
    shared = F.filter(F.map_keys("attrs_a"), lambda k: F.try_element_at("attrs_a", k) == F.try_element_at("attrs_b", k))
    agree = F.transform(shared, lambda k: F.concat(F.replace(k, F.lit("_"), F.lit(" ")), F.lit(" agrees: "), F.try_element_at("attrs_a", k)))
    families = F.when(F.col("_own") == F.col("_other"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("other material family: "), "_own", F.lit(" / "), "_other")))
    nothing = F.array().cast("array<string>")
    out = X.once(
        scored,
        _predicted=pick(F.lit("NEEDS_REVIEW"), F.col("_label"), F.col("predicted")),
        _match=pick(F.lit(0.0), F.col("_score"), F.col("match_probability")),
        _certain=pick(F.lit(0.0), F.col("_score"), F.col("label_probability")),
        _checks=pick(nothing, agree, F.col("checks")),
        _warnings=pick(F.array(F.lit("a description is empty")), F.array(F.lit("compared by text alone")), F.col("warnings")),
        _conflicts=pick(nothing, families, F.concat("conflicts", families)),
        scorer=pick(F.lit("none"), F.lit("open_domain"), F.lit("forest")),
    )
    renamed = {"predicted": F.col("_predicted"), "match_probability": F.col("_match"), "label_probability": F.col("_certain"), "checks": F.col("_checks"), "warnings": F.col("_warnings"), "conflicts": F.col("_conflicts")}
    out = out.withColumns({**renamed, "tier": X.tier(F.col("_match")), "critical_conflicts": F.filter("_conflicts", lambda c: F.contains(c, F.lit("identity_critical")))})
    lexical = [F.col(c) for c in ("word_cosine", "char_cosine", "fuzz_token_sort", "fuzz_ratio")]
    out = out.withColumn("evidence", evidence(lexical, F.col("match_probability"), F.col("frac_agree"), F.col("same_category")))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def scorer(corpus: DataFrame, model, version: str):
    """What ``top_matches`` needs of ``compare``: score, label and the number of conflicts that matter most."""

    def scored(pairs: DataFrame) -> DataFrame:
        c = compare(pairs, corpus, model, version)
        return c.withColumns({"score": F.col("match_probability"), "label": F.col("predicted"), "n_conflicts": F.size("critical_conflicts")})

    return scored


def guard(scored: DataFrame) -> DataFrame:
    """Pairs with an empty description go to review with score 0."""
    empty: Column = (F.trim("description_a") == "") | (F.trim("description_b") == "")
    return scored.withColumns({"predicted": F.when(empty, "NEEDS_REVIEW").otherwise(F.col("predicted")), "match_probability": F.when(empty, 0.0).otherwise(F.col("match_probability")), "tier": F.when(empty, "LOW").otherwise(F.col("tier"))})


def _path(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def isolation_scores(df: DataFrame, key: str, columns: list[str], trees: int = 200, size: int = 256, seed: int = 7) -> DataFrame:
    """Adds score (near 1: odd), after Liu, Ting and Zhou (2008).  Every tree is grown in a group of its own from at
    most ``size`` rows, drawn by a hash of ``key`` and the tree; the trees (bounded by both numbers) are broadcast and rows scored in batches.
    Rows that are equal, or repeat a key, fill a tree no further than that."""
    keyed = df.select(*columns, F.xxhash64(key, *columns).alias("h"))
    n = max(1, keyed.count())
    at = lambda i: F.pmod(F.xxhash64("h", i, F.lit(seed)), F.lit(1 << 30))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda i: at(i) < int(min(1.0, 2 * size / n) * (1 << 30)))
    draws = top_k(keyed.withColumn("tree", F.explode(drawn)), "tree", [at(F.col("tree")), "h"], 2 * size, "n").drop("n")  # only hits become rows

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(int(pdf["tree"].iloc[0]) + seed)
        x = pdf.sort_values("h")[columns].to_numpy(float)
        x = x[rng.permutation(len(x))[:size]]
        limit, nodes = int(np.ceil(np.log2(max(2, len(x))))), []

        def node(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, 0, 0, depth + _path(len(rows))])
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
            if depth < limit and len(spread):
                c = int(rng.choice(spread))
                cut = rng.uniform(rows[:, c].min(), rows[:, c].max())
                low = rows[:, c] < cut
                nodes[at][:4] = [c, cut, node(rows[low], depth + 1), node(rows[~low], depth + 1)]
            return at

        node(x, 0)
        return pd.DataFrame({"tree": int(pdf["tree"].iloc[0]), "n": len(x), "nodes": [[list(map(float, r)) for r in nodes]]})

    grown = draws.groupBy("tree").applyInPandas(grow, "tree int, n int, nodes array<array<double>>").toPandas()
    forest = [(np.array([list(r) for r in t])) for t in grown["nodes"]]
    norm = _path(float(grown["n"].mean())) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def odd(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(float) for c in cols])
        total = np.zeros(len(x))
        for t in shared.value:
            at = np.zeros(len(x), int)
            while True:
                inner = t[at, 0] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                c = t[at[rows], 0].astype(int)
                low = x[rows, c] < t[at[rows], 1]
                at[rows] = np.where(low, t[at[rows], 2], t[at[rows], 3]).astype(int)
            total += t[at, 4]
        return pd.Series(2 ** (-total / max(1, len(shared.value)) / norm))

    return df.withColumn("score", odd(*columns))


def outliers(df: DataFrame, key: str, columns: list[str], share: float = 0.01, **options) -> DataFrame:
    """``isolation_scores`` with ``outlier``, the rows whose score is above the (1 - share) percentile (approximate; ties with it stay), the oddest
    first."""
    scored = checkpointed(isolation_scores(df, key, columns, **options))
    cut = scored.agg(F.percentile_approx("score", 1 - share, 100_000).alias("_cut"))
    return scored.join(F.broadcast(cut)).withColumn("outlier", F.col("score") > F.col("_cut")).drop("_cut").orderBy(F.desc("score"), key)


def register(model, metrics: dict[str, float], version: str, path: str, spark) -> DataFrame:
    """Saves the pipeline under path/version with its row in path/registry, and makes it the active one."""
    model.write().overwrite().save(f"{path}/{version}")
    row = spark.createDataFrame([(version, "random forest", metrics)], "version string, algorithm string, metrics map<string,double>")
    row.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("overwrite").parquet(f"{path}/registry/of={version}")
    activate(spark, path, version)
    return registry(spark, path)


def activate(spark, path: str, version: str) -> None:
    """From now on ``version`` scores; every switch is a row of path/switches."""
    spark.createDataFrame([(version,)], "version string").withColumn("switched_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{path}/switches")


def registry(spark, path: str) -> DataFrame:
    """(version, algorithm, metrics, created_at, active)"""
    active = spark.read.parquet(f"{path}/switches").agg(F.max_by("version", "switched_at").alias("_active"))
    return spark.read.parquet(f"{path}/registry").drop("of").join(F.broadcast(active)).withColumn("active", F.col("version") == F.col("_active")).drop("_active")


def registered(spark, path: str, version: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/registry/of={version}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def load(spark, path: str, version: str | None = None) -> tuple[PipelineModel, str]:
    """A saved model and its version: the given one, or the active one."""
    version = version or registry(spark, path).where("active").first()["version"]
    return PipelineModel.load(f"{path}/{version}"), version
