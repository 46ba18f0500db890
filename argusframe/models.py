"""Training, calibration and scoring of binary classifiers with pyspark.ml.

Trees are fitted on train and stopped on val; a logistic calibrator is fitted on the margins of cal; thresholds
come from cal as well; test is read once. Scores are Catalyst expressions over the margin, so a plan with a
model in it still filters, prunes and generates code around it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argusframe.functions.columns import sigmoid


def is_whole(rows: DataFrame, features: list[str]) -> bool:
    """Whether one column holds all features, as an array or a vector."""
    return len(features) == 1 and isinstance(rows.schema[features[0]].dataType, (T.ArrayType, VectorUDT))


def with_vector(rows: DataFrame, features: list[str], kept: list[int] | None = None) -> DataFrame:
    """``rows`` with _x: one column that is an array or a vector of all features, or a column each. Of these only the
    ``kept`` places, if given."""
    if kept is not None:
        return VectorSlicer(inputCol="_all", outputCol="_x", indices=kept).transform(with_vector(rows, features).withColumnRenamed("_x", "_all")).drop("_all")
    if is_whole(rows, features):
        whole = F.col(features[0])
        return rows.withColumn("_x", whole if isinstance(rows.schema[features[0]].dataType, VectorUDT) else array_to_vector(whole.cast("array<double>")))
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(rows)


def varying(rows: DataFrame, features: list[str]) -> list[int]:
    """The places at which some rows differ, or hold NaN; the first where none does. Trees can split nowhere else."""
    found = with_vector(rows, features).agg(Summarizer.metrics("min", "max", "sum").summary(F.col("_x")).alias("s")).select("s.*").first()
    low, high, total = (np.zeros(1) if v is None or not v.size else v.toArray() for v in (found["min"], found["max"], found["sum"]))
    return np.flatnonzero((low != high) | np.isnan(total)).tolist() or [0]


@dataclass
class Detector:
    """``kept`` are the places of a whole vector that the trees were given."""

    features: list[str]
    trees: GBTClassificationModel
    slope: float
    intercept: float
    kept: list[int] | None = None

    def margins(self, rows: DataFrame) -> DataFrame:
        """``rows`` with margin; a missing feature column is an error, whatever else the table holds."""
        missing = [c for c in self.features if c not in rows.columns]
        if missing:
            raise ValueError(f"features missing: {missing}")
        ready = with_vector(rows, self.features, self.kept)
        out = self.trees.setFeaturesCol("_x").setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("_hit").transform(ready)
        return out.withColumn("margin", vector_to_array("_raw")[1]).drop("_x", "_raw", "_hit")

    def score(self, rows: DataFrame) -> DataFrame:
        """``rows`` with margin and score, the calibrated probability."""
        return self.margins(rows).withColumn("score", sigmoid(F.col("margin") * self.slope + self.intercept))

    def fingerprint(self) -> str:
        told = self.trees.toDebugString + ("" if self.kept is None else str(self.kept))
        return hashlib.sha256(told.encode()).hexdigest()[:16]

    def save(self, path: str) -> None:
        self.trees.write().overwrite().save(f"{path}/trees")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame(
            [(self.features, self.slope, self.intercept, self.kept)], CALIBRATION
        ).write.mode("overwrite").json(f"{path}/calibration")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Detector:
        meta = spark.read.json(f"{path}/calibration", schema=CALIBRATION).first()
        return Detector(list(meta.features), GBTClassificationModel.load(f"{path}/trees"), meta.slope, meta.intercept, meta.kept)


#: What is saved beside the trees; ``kept`` is missing in older files.
CALIBRATION = "features array<string>, slope double, intercept double, kept array<int>"


def train(rows: DataFrame, features: list[str], rounds: int = 20, depth: int = 4, rate: float = 0.1, balanced: bool = True, seed: int = 42) -> Detector:
    """Fit on ``rows`` (label, split in train, val, cal, and features). Of a whole vector only those places are binned and
    kept in memory at which rows of train differ; the trees are the same."""
    kept = varying(rows.where("split = 'train'"), features) if is_whole(rows, features) else None
    parts = rows.where(F.col("split").isin("train", "val")).withColumn("_val", F.col("split") == "val")
    sizes = {r.label: r.n for r in parts.where("NOT _val").groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = F.when(F.col("label") == 1, sizes.get(0, 0) / max(sizes.get(1, 0), 1)).otherwise(1.0) if balanced else F.lit(1.0)
    ready = with_vector(parts.withColumn("_w", weight).withColumn("label", F.col("label").cast("double")), features, kept)
    trees = GBTClassifier(
        featuresCol="_x", labelCol="label", weightCol="_w", validationIndicatorCol="_val", maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed
    ).fit(ready)
    raw = Detector(features, trees, 1.0, 0.0, kept)
    margins = VectorAssembler(inputCols=["margin"], outputCol="_m").transform(
        raw.margins(rows.where("split = 'cal'")).withColumn("label", F.col("label").cast("double"))
    )
    platt: LogisticRegressionModel = LogisticRegression(featuresCol="_m", labelCol="label", regParam=0.0).fit(margins)
    return Detector(features, trees, float(platt.coefficients[0]), float(platt.intercept), kept)


class SequenceNet:
    """Forward pass of a sequence classifier in numpy: embedding and place, convolutions with their normalisation,
    attention of several heads, and a mean over real tokens into two dense layers. Padding (id 0) is no key of the
    attention and has no share in the mean, so how much of it follows does not matter beyond the last convolution's
    reach. Weights are a mapping of arrays, such as ``initial`` gives or a saved file holds."""

    KERNELS = (3, 5, 7, 3)
    CHANNELS = (128, 256, 128, 128)

    def __init__(self, weights: dict, heads: int = 4):
        self.w, self.heads = weights, heads

    @classmethod
    def initial(cls, vocabulary: int, length: int = 100, width: int = 64, heads: int = 4, seed: int = 0) -> SequenceNet:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.normal(0, scale, shape)).astype(np.float32)
        w = {"embedding": normal(vocabulary, width, scale=0.02), "place": normal(length, width, scale=0.02)}
        w["embedding"][0] = 0
        before = width
        for i, (kernel, channels) in enumerate(zip(cls.KERNELS, cls.CHANNELS, strict=True)):
            w |= {
                f"conv{i}": normal(kernel, before, channels, scale=(2 / (kernel * before)) ** 0.5), f"bias{i}": np.zeros(channels, np.float32),
                f"gain{i}": np.ones(channels, np.float32), f"shift{i}": np.zeros(channels, np.float32)
            }
            before = channels
        spread = lambda a, b: (2 / (a + b)) ** 0.5
        w |= {
            "qkv": normal(before, 3 * before, scale=spread(before, 3 * before)), "qkv_bias": np.zeros(3 * before, np.float32),
            "out": normal(before, before, scale=spread(before, before)), "out_bias": np.zeros(before, np.float32)
        }
        w |= {
            "norm_gain": np.ones(before, np.float32), "norm_shift": np.zeros(before, np.float32), "dense": normal(before, 64, scale=spread(before, 64)),
            "dense_bias": np.zeros(64, np.float32), "last": normal(64, scale=spread(64, 1)), "last_bias": np.zeros(1, np.float32)
        }
        return cls(w, heads)

    def attended(self, ids: np.ndarray) -> np.ndarray:
        """The states (rows, places, channels) after attention."""
        w, real = self.w, ids != 0
        x = w["embedding"][ids] + w["place"][: ids.shape[1]]
        for i, kernel in enumerate(self.KERNELS):
            half = kernel // 2
            wide = np.pad(x, ((0, 0), (half, half), (0, 0)))
            x = sum(wide[:, j : j + ids.shape[1]] @ w[f"conv{i}"][j] for j in range(kernel)) + w[f"bias{i}"]
            x = np.maximum(x * w[f"gain{i}"] + w[f"shift{i}"], 0)
        n, s, c = x.shape
        q, k, v = ((x @ w["qkv"] + w["qkv_bias"]).reshape(n, s, 3, self.heads, c // self.heads).transpose(2, 0, 3, 1, 4))
        scores = q @ k.transpose(0, 1, 3, 2) / (c // self.heads) ** 0.5
        keys = real[:, None, None, :] | ~real.any(1)[:, None, None, None]  # a row of padding alone attends to it
        scores = np.where(keys, scores, -np.inf)
        shares = np.exp(scores - scores.max(-1, keepdims=True))
        mixed = (shares / shares.sum(-1, keepdims=True) @ v).transpose(0, 2, 1, 3).reshape(n, s, c)
        y = mixed @ w["out"] + w["out_bias"] + x
        centred = y - y.mean(-1, keepdims=True)
        return centred / np.sqrt((centred**2).mean(-1, keepdims=True) + 1e-5) * w["norm_gain"] + w["norm_shift"]

    def classify(self, pooled: np.ndarray) -> np.ndarray:
        w = self.w
        return np.maximum(pooled @ w["dense"] + w["dense_bias"], 0) @ w["last"] + w["last_bias"][0]

    def margins(self, ids: np.ndarray) -> np.ndarray:
        """One margin a row of token ids."""
        real = (ids != 0)[:, :, None]
        states = self.attended(ids)
        return self.classify((states * real).sum(1) / np.maximum(real.sum(1), 1))

    def score(self, rows: DataFrame, ids: str = "ids", batch: int = 256) -> DataFrame:
        """``rows`` with margin and score; null ids give null. The weights are broadcast once."""
        shared = rows.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def margin(column: pd.Series) -> pd.Series:
            out = pd.Series(np.nan, column.index).astype("Float64")
            known = np.flatnonzero(column.notna().to_numpy())
            for i in range(0, len(known), batch):
                some = known[i : i + batch]
                out.iloc[some] = shared.value.margins(np.stack(column.iloc[some].to_list())).astype(float)
            return out

        return rows.withColumn("margin", margin(F.col(ids))).withColumn("score", sigmoid(F.col("margin")))


#: Strengths of regularisation tried in turn by ``train_sequences``, and how many may fail to improve in a row.
STRENGTHS = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003, 0.001)
PATIENCE = 2


@dataclass
class SequenceDetector:
    """A trained classifier of token sequences: hashed runs of tokens into a logistic regression."""

    runs: int
    buckets: int
    model: LogisticRegressionModel
    strength: float
    losses: list[float]

    def score(self, rows: DataFrame, tokens: str = "tokens") -> DataFrame:
        """``rows`` with margin and score; null tokens count as none."""
        out = self.model.setProbabilityCol("").setPredictionCol("").transform(hashed_runs(rows, tokens, self.runs, self.buckets))
        return out.withColumn("margin", vector_to_array("rawPrediction")[1]).withColumn("score", sigmoid(F.col("margin"))).drop("_x", "rawPrediction")


def hashed_runs(rows: DataFrame, tokens: str, runs: int, buckets: int) -> DataFrame:
    """``rows`` with _x: how often each run of one to ``runs`` tokens occurs, hashed into buckets."""
    own = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    run = lambda n: F.transform(F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(own, i, n), " "))
    ready = rows.withColumn("_runs", F.concat(*[run(n) for n in range(1, runs + 1)]))
    return HashingTF(inputCol="_runs", outputCol="_x", numFeatures=buckets).transform(ready).drop("_runs")


def log_loss(rows: DataFrame, weight: float) -> float:
    """Mean loss of score against label, positives weighted."""
    p = F.greatest(F.least("score", F.lit(1 - 1e-12)), F.lit(1e-12))
    one = F.when(F.col("label") == 1, -F.ln(p) * weight).otherwise(-F.ln(1 - p))
    return rows.agg(F.avg(one)).first()[0] or 0.0


def train_sequences(rows: DataFrame, tokens: str = "tokens", runs: int = 3, buckets: int = 1 << 14, iterations: int = 50) -> SequenceDetector:
    """Fit on ``rows`` (label, split in train and val, tokens). Positives weigh as many times as they are rarer;
    regularisation is eased step by step until the loss on val has not improved PATIENCE times in a row, and the best
    model is kept. Rows of other splits are not looked at."""
    train_rows, val_rows = rows.where("split = 'train'"), rows.where("split = 'val'")
    sizes = {r.label: r.n for r in train_rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weight = sizes.get(0, 0) / max(sizes.get(1, 0), 1) or 1.0
    ready = hashed_runs(train_rows, tokens, runs, buckets).select(
        "_x", F.col("label").cast("double").alias("label"), F.when(F.col("label") == 1, weight).otherwise(1.0).alias("_w")
    ).cache()
    best, least, losses, worse = None, float("inf"), [], 0
    for strength in STRENGTHS:
        model = LogisticRegression(featuresCol="_x", weightCol="_w", regParam=strength, maxIter=iterations, standardization=False).fit(ready)
        now = SequenceDetector(runs, buckets, model, strength, losses)
        losses.append(log_loss(now.score(val_rows, tokens), weight))
        best, least, worse = (now, losses[-1], 0) if losses[-1] < least else (best, least, worse + 1)
        if worse >= PATIENCE:
            break
    ready.unpersist()
    return best
