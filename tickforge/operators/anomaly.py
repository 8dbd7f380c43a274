"""The anomaly ladder: robust z-scores, a calibrated threshold, an autoencoder, and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FEATURES
from .features import MAD_SCALE

THRESHOLD, TARGET_RATE = 5.0, 0.05


def robust_stats(rows: DataFrame) -> DataFrame:
    """symbol and, for each feature, its median and scale (1.4826 times the median absolute deviation)."""
    medians = rows.groupBy("symbol").agg(*(F.expr(f"percentile({f}, 0.5D)").alias(f"{f}_median") for f in FEATURES))
    near = rows.join(medians, "symbol")
    scales = near.groupBy("symbol").agg(*(F.expr(f"percentile(abs({f} - {f}_median), 0.5D) * {MAD_SCALE}D").alias(f"{f}_scale") for f in FEATURES))
    return medians.join(scales, "symbol")


def with_robust_stats(rows: DataFrame, where: str = "true") -> DataFrame:
    """rows with the medians and scales of robust_stats(rows.where(where)) beside each row.

    Two windows by symbol, which share the exchange of the windows that the features came from: nothing is computed
    twice and nothing joined.
    """
    of = lambda e: f"percentile(case when {where} then {e} end, 0.5D) over (partition by symbol)"
    placed = rows.withColumns({f"{f}_median": F.expr(of(f)) for f in FEATURES})
    return placed.withColumns({f"{f}_scale": F.expr(f"{of(f'abs({f} - {f}_median)')} * {MAD_SCALE}D") for f in FEATURES})


def robust_z(rows: DataFrame, stats: DataFrame | None = None, threshold: float | Column = THRESHOLD, where: str = "true") -> DataFrame:
    """rows with score (the largest absolute z), worst_feature (the first that has it) and is_anomaly (score > threshold).

    stats has a row for each symbol; the optimizer broadcasts it where it is small enough. Without stats, those of the
    rows themselves, as far as where holds, count; symbols without such rows go, as they would in the join.
    """
    zs = [F.expr(f"case when {f}_scale > 0 then abs({f} - {f}_median) / {f}_scale else 0D end") for f in FEATURES]
    beside = with_robust_stats(rows, where).where(f"{FEATURES[0]}_median is not null") if stats is None else rows.join(stats, "symbol")
    joined = beside.withColumn("_zs", F.array(*zs)).withColumn("score", F.array_max("_zs"))
    limit = threshold if isinstance(threshold, Column) else F.lit(threshold)
    names = F.array(*(F.lit(f) for f in FEATURES))
    kept = [c for c in rows.columns]
    return joined.select(*kept, "score", F.element_at(names, F.array_position("_zs", F.col("score")).cast("int")).alias("worst_feature"), (F.col("score") > limit).cast("int").alias("is_anomaly"))


def top(scored: DataFrame, n: int = 15) -> DataFrame:
    return scored.orderBy(F.desc("score"), "symbol", "start_ns").limit(n)


def calibrated_threshold(scores: DataFrame, rate: float = TARGET_RATE) -> DataFrame:
    """One row: the interpolated quantile at 1 - rate of score; infinite for no rows."""
    return scores.agg(F.coalesce(F.expr(f"percentile(score, {1 - rate}D)"), F.lit(float("inf"))).alias("threshold"))


def calibrated(split: DataFrame, rate: float = TARGET_RATE) -> DataFrame:
    """Scores by the statistics of the fit and calibrate folds; is_anomaly by a threshold from the calibrate fold."""
    scored = robust_z(split, where="fold <> 'test'")
    limit = calibrated_threshold(scored.where("fold = 'calibrate'"), rate)
    return scored.drop("is_anomaly").join(F.broadcast(limit)).withColumn("is_anomaly", (F.col("score") > F.col("threshold")).cast("int"))  # one row


def confusion(rows: DataFrame, predicted: str = "is_anomaly", truth: str = "label") -> DataFrame:
    p, y = F.col(predicted) == 1, F.col(truth) == 1
    counts = rows.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    over = lambda a, b: F.expr(f"case when {b} = 0 then 0D else ({a}) / ({b}) end")
    rated = counts.select("*", over("tp", "tp + fp").alias("precision"), over("tp", "tp + fn").alias("recall"), over("tp + fp", "tp + fp + fn + tn").alias("flag_rate"))
    return rated.withColumn("f1", F.expr("case when precision + recall = 0 then 0D else 2 * precision * recall / (precision + recall) end"))


def auc(rows: DataFrame, score: str = "score", truth: str = "label") -> DataFrame:
    """One row: the chance that a positive outscores a negative, ties counting half; NaN without both classes.

    Rows are summed by score, and the different scores dealt out by range. Each range counts within itself; what lies
    below it comes from the sums of the ranges, of which there are as many as partitions.
    """
    by = rows.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) != 1).alias("neg"))
    ranges = by.repartitionByRange("s").withColumn("part", F.spark_partition_id())
    inside = ranges.withColumn("under", F.expr("coalesce(sum(neg) over (partition by part order by s rows between unbounded preceding and 1 preceding), 0)"))
    sums = inside.groupBy("part").agg(F.sum(F.expr("pos * (under + neg / 2D)")).alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    below = sums.withColumn("under", F.expr("coalesce(sum(neg) over (order by part rows between unbounded preceding and 1 preceding), 0)"))
    total = below.agg(F.sum(F.expr("wins + pos * cast(under as double)")).alias("wins"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return total.select(F.expr("case when n_pos > 0 and n_neg > 0 then wins / (cast(n_pos as double) * n_neg) else double('NaN') end").alias("auc"))


def standardization(rows: DataFrame) -> DataFrame:
    """One row: mean and population deviation of each feature, 1 in place of 0."""
    return rows.agg(*(F.avg(f).alias(f"{f}_mean") for f in FEATURES), *(F.expr(f"case when stddev_pop({f}) = 0 then 1D else stddev_pop({f}) end").alias(f"{f}_std") for f in FEATURES))


class Autoencoder:
    """7-16-4-16-7 with ReLU, trained by Adam on the whole batch; scores are mean squared errors of standardised rows."""

    SIZES = (len(FEATURES), 16, 4, 16, len(FEATURES))

    def __init__(self, seed: int = 0, epochs: int = 400, rate: float = 1e-3):
        rng = np.random.default_rng(seed)
        self.epochs, self.rate = epochs, rate
        self.layers = [(rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)) for a, b in zip(self.SIZES, self.SIZES[1:], strict=False)]
        self.mean, self.std = np.zeros(self.SIZES[0]), np.ones(self.SIZES[0])

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        outs = [x]
        for k, (w, b) in enumerate(self.layers):
            x = x @ w + b
            outs.append(np.maximum(x, 0) if k < 3 else x)
            x = outs[-1]
        return outs

    def fit(self, rows: np.ndarray) -> Autoencoder:
        self.mean, self.std = rows.mean(axis=0), rows.std(axis=0)
        self.std[self.std == 0] = 1
        x = (rows - self.mean) / self.std
        moments = [[np.zeros_like(p) for p in layer] + [np.zeros_like(p) for p in layer] for layer in self.layers]
        for t in range(1, self.epochs + 1):
            outs = self.forward(x)
            grad = 2 * (outs[-1] - x) / x.size
            for k in range(len(self.layers) - 1, -1, -1):
                if k < 3:
                    grad = grad * (outs[k + 1] > 0)
                w, b = self.layers[k]
                grads = (outs[k].T @ grad, grad.sum(axis=0))
                grad = grad @ w.T
                new = []
                for j, (p, g) in enumerate(zip((w, b), grads, strict=True)):
                    m = moments[k][j] = 0.9 * moments[k][j] + 0.1 * g
                    v = moments[k][2 + j] = 0.999 * moments[k][2 + j] + 0.001 * g * g
                    new.append(p - self.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8))
                self.layers[k] = tuple(new)
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = (rows - self.mean) / self.std
        return ((self.forward(x)[-1] - x) ** 2).mean(axis=1)


#: Rows that train the autoencoder, at most; drawn by a hash, so the driver holds a bounded sample.
FIT_ROWS = 50_000


def autoencoder_scores(split: DataFrame, seed: int = 0, epochs: int = 400) -> DataFrame:
    """split with ae_score, from a model fitted on (a bounded sample of) the fit fold and sent to the executors."""
    sample = split.where("fold = 'fit'").orderBy(F.xxhash64("symbol", "start_ns")).limit(FIT_ROWS).select(*FEATURES).toPandas().to_numpy()
    model = Autoencoder(seed, epochs)
    if len(sample):
        model.fit(sample)
    places = [split.columns.index(f) for f in FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in places]) if batch.num_rows else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x), pa.float64())], names=[*batch.schema.names, "ae_score"])

    return split.mapInArrow(run, split.withColumn("ae_score", F.lit(0.0)).schema)


def ladder(bars: DataFrame, features: DataFrame, seed: int = 0) -> DataFrame:
    """rung, auc of the baseline and of the autoencoder on the test fold, for features with a column label."""
    scored = autoencoder_scores(calibrated(features), seed)
    test = scored.where("fold = 'test'")
    return auc(test).select(F.lit("robust_z").alias("rung"), "auc").unionByName(auc(test, "ae_score").select(F.lit("autoencoder").alias("rung"), "auc"))
