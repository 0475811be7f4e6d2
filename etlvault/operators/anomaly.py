"""Anomaly flags and the weak-label classifier on MLlib; the isolation forest on grouped pandas tasks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from etlvault.functions.columns import col
from etlvault.operators.profile import exact_quantiles
from etlvault.session import cut_lineage

# Fixed values of the detectors.
TREES, SAMPLE_ROWS, CONTAMINATION, SEED = 100, 256, 0.05, 42
ERROR_PERCENTILE, TRAIN_SHARE = 0.95, 0.8
_TREE_SCHEMA = "tree int, node int, feature int, split double, size int"


def fit_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> PipelineModel:
    """Standardised numerics and one-hot categoricals with one level dropped, as vector ``features``.

    Fill numerics and bucket wide categoricals first: the levels are held by the driver.
    """
    indexed, hot = [f"{c}__i" for c in categorical], [f"{c}__h" for c in categorical]
    stages = [
        StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True, handleInvalid="keep"),
        VectorAssembler(inputCols=list(numeric), outputCol="__n"),
        StandardScaler(inputCol="__n", outputCol="__s", withMean=True, withStd=True),
        VectorAssembler(inputCols=["__s", *hot], outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(df)


def feature_names(model: PipelineModel, numeric: Sequence[str], categorical: Sequence[str]) -> list[str]:
    """Name of every slot of ``features``."""
    labels = model.stages[0].labelsArray
    return list(numeric) + [f"{c}={v}" for c, values in zip(categorical, labels) for v in values]


def _uniform(*parts: Column) -> Column:
    """Number in [0, 1) from a hash, the same on every run and after a lost executor."""
    return F.pmod(F.xxhash64(*parts), F.lit(2 ** 52)).cast("double") / F.lit(float(2 ** 52))


def tree_samples(df: DataFrame, row_id: str, trees: int = TREES, rows: int = SAMPLE_ROWS, seed: int = SEED) -> DataFrame:
    """About ``rows`` sampled rows per tree: the bounded input every tree is grown on.

    Every tree draws every row with the same chance, whatever the table's size; a row is
    repeated only for the trees that drew it.
    """
    share = min(1.0, rows / max(df.count(), 1))
    # the test after the generator is compiled, which a lambda over the trees' numbers is not
    offered = df.withColumn("__key", col(row_id).cast("string")).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    return offered.filter(_uniform(F.lit(seed), F.col("__key"), F.col("tree")) < share).drop("__key")


def _grow(seed: int):
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed + tree)
        x = np.stack(pdf.sort_values("h")["x"].to_list())
        limit = max(1, int(np.ceil(np.log2(len(x)))))  # deeper nodes cannot change the ranking
        out, todo = [], [(0, np.arange(len(x)), 0)]
        while todo:
            node, at, depth = todo.pop()
            part = x[at]
            low, high = part.min(axis=0), part.max(axis=0)
            open_features = np.flatnonzero(high > low)
            if depth >= limit or len(at) <= 1 or not len(open_features):
                out.append((tree, node, -1, 0.0, len(at)))
                continue
            f = int(rng.choice(open_features))
            split = float(rng.uniform(low[f], high[f]))
            out.append((tree, node, f, split, len(at)))
            left = part[:, f] < split
            todo += [(2 * node + 1, at[left], depth + 1), (2 * node + 2, at[~left], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "split", "size"])
    return grow


def grow_forest(df: DataFrame, row_id: str, features: str = "features", trees: int = TREES, rows: int = SAMPLE_ROWS,
                seed: int = SEED) -> DataFrame:
    """Isolation trees as rows (tree, node, feature, split, size); a leaf has feature -1, node 0 the tree's whole sample."""
    sample = tree_samples(df, row_id, trees, rows, seed)
    narrow = sample.select("tree", F.xxhash64(F.lit(seed), col(row_id).cast("string")).alias("h"), vector_to_array(col(features)).alias("x"))
    return narrow.groupBy("tree").applyInPandas(_grow(seed), _TREE_SCHEMA)


def _expected_path(n: np.ndarray) -> np.ndarray:
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def isolation_score(spark: SparkSession, forest: DataFrame):
    """Pandas UDF scoring an array of features by path lengths, against those expected of the trees' own samples.

    The forest is read to the driver and broadcast: a few small nodes per sampled row of
    each tree, whatever the size of the data.
    """
    nodes = forest.toPandas()
    trees = sorted(nodes["tree"].unique())
    depth_limit = int(np.log2(nodes["node"].max() + 1)) if len(nodes) else 0
    width = 2 ** (depth_limit + 1)
    # a leaf leads to itself, as no value reaches its split
    feature, left = np.zeros((len(trees), width), dtype=np.intp), np.tile(np.arange(width), (len(trees), 1))
    split, size, length = np.full((len(trees), width), np.inf), np.ones((len(trees), width)), np.zeros((len(trees), width))
    for i, t in enumerate(trees):
        part = nodes[nodes["tree"] == t]
        at, inner = part["node"].to_numpy(), part["feature"].to_numpy() >= 0
        size[i, at] = part["size"]
        feature[i, at[inner]], split[i, at[inner]] = part["feature"][inner], part["split"][inner]
        left[i, at[inner]] = 2 * at[inner] + 1
        length[i, at] = np.floor(np.log2(at + 1)) + _expected_path(size[i, at])
    shared = spark.sparkContext.broadcast((feature, left, split, length))
    normal = max(float(_expected_path(size[:, 0]).sum()), 1e-9)

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        feature, left, split, length = shared.value
        x = np.stack(values.to_list())
        if np.isnan(x).any() or np.isposinf(x).any():  # these pass no split, or the one of a leaf
            x = np.nan_to_num(x, nan=-np.inf, posinf=np.finfo(float).max)
        flat, first, total = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x))
        for t in range(len(feature)):
            node = np.zeros(len(x), dtype=np.intp)
            for _ in range(depth_limit):
                node = left[t].take(node) + (flat.take(first + feature[t].take(node)) >= split[t].take(node))
            total += length[t].take(node)
        return pd.Series(2.0 ** (-total / normal))

    return score


def _flag_above(df: DataFrame, value: str, share: float, flag: str) -> DataFrame:
    """1 for values above the exact percentile."""
    cut = exact_quantiles(df, [value], [share]).select(F.col("q")[0].alias("c")).scalar()
    return df.withColumn(flag, (col(value) > cut).cast("int"))


def isolation_flags(df: DataFrame, row_id: str, features: str = "features", trees: int = TREES, rows: int = SAMPLE_ROWS,
                    contamination: float = CONTAMINATION, seed: int = SEED) -> DataFrame:
    """Add ``if_score`` and ``if_anomaly``."""
    score = isolation_score(df.sparkSession, grow_forest(df, row_id, features, trees, rows, seed))
    # read twice, for the cut and for the flags, while scoring is the costly step
    scored = cut_lineage(df.withColumn("if_score", score(vector_to_array(col(features)))))
    return _flag_above(scored, "if_score", 1 - contamination, "if_anomaly")


def reconstruction_flags(df: DataFrame, components: int, features: str = "features",
                         percentile: float = ERROR_PERCENTILE) -> DataFrame:
    """Add ``ae_error``, the mean squared distance to the principal subspace, and ``ae_anomaly``."""
    centre = StandardScaler(inputCol=features, outputCol="__c", withMean=True, withStd=False).fit(df)
    centred = centre.transform(df)
    projected = PCA(k=components, inputCol="__c", outputCol="__p").fit(centred).transform(centred)

    def squares(name: str) -> Column:
        return F.aggregate(vector_to_array(col(name)), F.lit(0.0), lambda total, v: total + v * v)

    width = F.size(vector_to_array(col("__c")))
    error = F.greatest(F.lit(0.0), squares("__c") - squares("__p")) / width
    return _flag_above(projected.withColumn("ae_error", error).drop("__c", "__p"), "ae_error", percentile, "ae_anomaly")


def weak_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", F.greatest("if_anomaly", "ae_anomaly"))


def split(df: DataFrame, row_id: str, share: float = TRAIN_SHARE, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Train and test parts by a hash of the row id, so that a recomputed task splits alike."""
    draw = _uniform(F.lit(seed), col(row_id).cast("string"))
    return df.filter(draw < share), df.filter(draw >= share)


def fit_classifier(train: DataFrame, label: str = "label", features: str = "features", iterations: int = 20, depth: int = 5):
    return GBTClassifier(labelCol=label, featuresCol=features, maxIter=iterations, maxDepth=depth, seed=SEED).fit(train)


def predict(model, df: DataFrame) -> DataFrame:
    """Add ``prediction`` and the probability of the positive class as ``score``."""
    return model.transform(df).withColumn("score", vector_to_array(F.col("probability"))[1])


def feature_importance(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    """Global importance per feature slot."""
    rows = [(n, float(model.featureImportances[i])) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def comparison(evaluations: dict[str, DataFrame]) -> DataFrame:
    """Metrics by method, one column per method."""
    long = None
    for method, frame in evaluations.items():
        row = frame.select(F.lit(method).alias("method"), F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in ("precision", "recall", "auroc")])))
        long = row if long is None else long.unionByName(row)
    return long.groupBy("metric").agg(*[F.max(F.when(F.col("method") == m, F.col("value"))).alias(m) for m in evaluations])
