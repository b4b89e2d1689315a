"""Model arms on Spark ML: linear and boosted classifiers, two-sample tests, latent clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardspan.evaluation.metrics import ranked_metrics
from wardspan.session import cut_lineage


def _features(numbers: Sequence[str], categories: Sequence[str], scale: bool) -> list:
    stages = [Imputer(inputCols=list(numbers), outputCols=[f"{c}__i" for c in numbers], strategy="median")]
    inputs = [f"{c}__i" for c in numbers]
    if categories:
        stages.append(StringIndexer(inputCols=list(categories), outputCols=[f"{c}__x" for c in categories], handleInvalid="keep"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__x" for c in categories], outputCols=[f"{c}__o" for c in categories]))
        inputs += [f"{c}__o" for c in categories]
    stages.append(VectorAssembler(inputCols=inputs, outputCol="__raw", handleInvalid="keep"))
    if scale:
        stages.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=True))
    else:
        stages[-1] = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep")
    return stages


def balanced(df: DataFrame, y: str = "y") -> DataFrame:
    """Row weights that give both classes the same total."""
    n = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("double")).alias("p")).withColumn("__one", F.lit(1))
    d = df.withColumn("__one", F.lit(1)).join(F.broadcast(n), "__one")
    w = F.when(F.col(y) == 1, F.col("n") / (2 * F.col("p"))).otherwise(F.col("n") / (2 * (F.col("n") - F.col("p"))))
    return d.withColumn("weight", w).drop("__one", "n", "p")


def fit_arm(
    train: DataFrame, arm: str, numbers: Sequence[str], categories: Sequence[str] = (), y: str = "y", seed: int = 0,
    steps: int = 2000, trees: int = 200, depth: int = 4,
) -> PipelineModel:
    """``logistic`` (imputed, scaled, one-hot) or ``boosted`` trees, both class-balanced; trained with the study's settings by default."""
    if arm == "logistic":
        est = LogisticRegression(featuresCol="features", labelCol=y, weightCol="weight", maxIter=steps)
        return Pipeline(stages=[*_features(numbers, categories, True), est]).fit(balanced(train, y))
    est = GBTClassifier(featuresCol="features", labelCol=y, weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*_features(numbers, categories, False), est]).fit(balanced(train, y))


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    p = vector_to_array("probability")[1]
    return model.transform(df).withColumn("score", p)


def cross_validate(
    df: DataFrame, folds: DataFrame, group: str, arm: str, numbers: Sequence[str], categories: Sequence[str] = (), y: str = "y",
    **settings: int,
) -> DataFrame:
    """Out-of-fold scores: (row columns, repeat, fold, score). One fit per (repeat, fold)."""
    pairs = folds.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()
    # every fit reads the rows several times: store them once in the shared folder
    rows = cut_lineage(df.join(folds, group))
    out = None
    for p in pairs:
        mine = rows.filter(F.col("repeat") == p["repeat"])
        model = fit_arm(mine.filter(F.col("fold") != p["fold"]), arm, numbers, categories, y, **settings)
        part = predict(model, mine.filter(F.col("fold") == p["fold"])).select(group, y, "repeat", "fold", "score")
        out = part if out is None else out.unionByName(part)
    return out


def top_features(model: PipelineModel, numbers: Sequence[str], k: int) -> list[str]:
    """Names of the numeric features with the largest gain."""
    imp = model.stages[-1].featureImportances.toArray()[: len(numbers)]
    return [n for _, n in sorted(zip(-imp, numbers))[:k]]


def importance_overlap(a: Sequence[str], b: Sequence[str]) -> float:
    return len(set(a) & set(b)) / max(len(a), 1)


def two_sample_test(real: DataFrame, synth: DataFrame, cols: Sequence[str], seed: int = 0, **settings: int) -> DataFrame:
    """AUROC of telling real from synthetic rows on a held-out half, and how alike they are."""
    u = real.select(*cols, F.lit(1).alias("y")).unionByName(synth.select(*cols, F.lit(0).alias("y")))
    half = F.pmod(F.xxhash64(*cols, F.col("y")), F.lit(2))
    train, test = u.filter(half == 0), u.filter(half == 1)
    scored = predict(fit_arm(train, "boosted", list(cols), seed=seed, **settings), test).withColumn("__g", F.lit(1))
    m = ranked_metrics(scored.select("__g", "y", "score"), ["__g"])
    return m.select("auroc", (100 * (1 - F.abs(F.col("auroc") - 0.5) * 2)).alias("pct_similar"))


def latent_clusters(real: DataFrame, synth: DataFrame, vec: str, components: int, k: int = 20, variance: float = 0.9, seed: int = 0) -> DataFrame:
    """Log mean squared deviation of the real share over clusters in principal-component space."""
    u = real.select(vec, F.lit(1.0).alias("real")).unionByName(synth.select(vec, F.lit(0.0).alias("real")))
    from pyspark.ml.functions import array_to_vector

    u = u.withColumn("__v", array_to_vector(F.col(vec).cast("array<double>")))
    pca = PCA(k=components, inputCol="__v", outputCol="__p").fit(u)
    share, use = 0.0, components
    for i, e in enumerate(pca.explainedVariance.toArray()):
        share += float(e)
        if share >= variance:
            use = i + 1
            break
    cut = F.slice(vector_to_array("__p"), 1, use)
    u = pca.transform(u).withColumn("features", array_to_vector(cut))
    km = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(u)
    per = km.transform(u).groupBy("cluster").agg(F.avg("real").alias("share"), F.count(F.lit(1)).alias("n"), F.sum("real").alias("nr"))
    tot = per.agg((F.sum("nr") / F.sum("n")).alias("expected")).withColumn("__one", F.lit(1))
    j = per.withColumn("__one", F.lit(1)).join(F.broadcast(tot), "__one")
    msd = F.avg(F.pow(F.col("share") - F.col("expected"), 2))
    return j.agg(F.ln(F.greatest(msd, F.lit(2.2250738585072014e-308))).alias("score"), F.count(F.lit(1)).alias("clusters"))
