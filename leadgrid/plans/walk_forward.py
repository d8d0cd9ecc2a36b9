"""Walk-forward training of gradient-boosted trees with MLlib.

Fits are distributed jobs over the stored feature table; the driver holds only
fold dates and models.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadgrid.config import PitConfig
from leadgrid.functions.temporal import ntz
from leadgrid.operators.scoring import (
    BASELINE,
    MODEL,
    ablation_difference,
    score_by_lead,
    with_baseline,
    with_legal_anchor,
)
from leadgrid.operators.tiling import Fold, fold_membership, membership_violations
from leadgrid.sources.storage import stored

# What a model may see. Provenance columns are never features.
FEATURES = (
    "hour", "day", "lead_days", "is_holiday", "temperature_2m", "heating_degrees",
    "cooling_degrees", "demand_lag_mw", "lag_7d", "lag_14d",
)
WEATHER_FEATURES = ("temperature_2m", "heating_degrees", "cooling_degrees")
NON_WEATHER_FEATURES = tuple(f for f in FEATURES if f not in WEATHER_FEATURES)
TARGET = "demand_mw"

# Category levels of the nominal features.
NOMINAL = {"hour": range(24), "day": range(1, 8)}
NULLABLE = ("temperature_2m", "heating_degrees", "cooling_degrees", "lag_7d", "lag_14d")

# What a stored prediction carries.
PREDICTION_COLUMNS = (
    "lead_days", "demand_mw", "target_ts", MODEL, BASELINE, "is_holiday", "temperature_2m",
    "hour", "day",
)


@dataclass(frozen=True)
class TreeParams:
    """Boosting parameters; depth 5 bounds a tree to 32 leaves."""

    trees: int = 500
    step: float = 0.05
    depth: int = 5
    min_rows: int = 20
    bins: int = 255
    row_share: float = 1.0
    feature_share: str = "all"
    seed: int = 42


PARAMS = TreeParams()
BAGGED = replace(PARAMS, row_share=0.8, feature_share="0.8")


def _encoded(name: str) -> list[Column]:
    """Model inputs for one feature.

    Nominal features carry their levels as column metadata, so no pass over
    the data is needed to index them. Trees here take no nulls: a missing
    value becomes 0 beside a flag that says so, and no row is lost.
    """
    value = F.col(name).cast("double")
    if name in NOMINAL:
        levels = NOMINAL[name]
        attribute = {"type": "nominal", "name": f"x_{name}", "vals": [str(v) for v in levels]}
        return [(value - levels[0]).alias(f"x_{name}", metadata={"ml_attr": attribute})]
    if name in NULLABLE:
        missing = value.isNull().cast("double").alias(f"x_{name}_missing")
        return [F.coalesce(value, F.lit(0.0)).alias(f"x_{name}"), missing]
    return [value.alias(f"x_{name}")]


def input_columns(features: Iterable[str]) -> list[str]:
    return [c for f in features for c in [f"x_{f}", *([f"x_{f}_missing"] if f in NULLABLE else [])]]


def encoded_frame(mart: DataFrame, cfg: PitConfig) -> DataFrame:
    """The mart with its baseline and encoded model inputs."""
    inputs = [c for f in FEATURES for c in _encoded(f)]
    keep = [*cfg.series, *(c for c in PREDICTION_COLUMNS if c != MODEL)]
    return with_baseline(mart, cfg).select(*keep, *inputs)


def training_frame(mart: DataFrame, cfg: PitConfig) -> DataFrame:
    """``encoded_frame``, stored once for all folds to read."""
    return stored(encoded_frame(mart, cfg), "training")


def estimator(features: Iterable[str], params: TreeParams) -> Pipeline:
    assembler = VectorAssembler(inputCols=input_columns(features), outputCol="features")
    trees = GBTRegressor(
        labelCol=TARGET, featuresCol="features", predictionCol=MODEL, lossType="squared",
        maxIter=params.trees, stepSize=params.step, maxDepth=params.depth, maxBins=params.bins,
        minInstancesPerNode=params.min_rows, subsamplingRate=params.row_share,
        featureSubsetStrategy=params.feature_share, seed=params.seed, checkpointInterval=10,
    )
    return Pipeline(stages=[assembler, trees])


def between(rows: DataFrame, lo: dt.date | None, hi: dt.date | dt.datetime) -> DataFrame:
    """Half-open range ``[lo, hi)`` of target times."""
    rows = rows.where(F.col("target_ts") < ntz(hi))
    return rows if lo is None else rows.where(F.col("target_ts") >= ntz(lo))


def fit(train: DataFrame, features: Iterable[str], params: TreeParams) -> PipelineModel:
    return estimator(features, params).fit(train.where(F.col(TARGET).isNotNull()))


def predicted(model: PipelineModel, rows: DataFrame, cfg: PitConfig) -> DataFrame:
    return model.transform(rows).select(*cfg.series, *PREDICTION_COLUMNS)


def check_folds(frame: DataFrame, folds: list[Fold], train_start: dt.date | None = None) -> None:
    bad = membership_violations(fold_membership(frame, folds, train_start)).collect()
    if bad:
        raise ValueError(f"folds with an empty or overlapping side: {bad}")


class Variant(NamedTuple):
    """One way to train: its name in the results, features and parameters."""

    run: str
    features: tuple[str, ...]
    params: TreeParams


def walk_forwards(
    frame: DataFrame,
    folds: list[Fold],
    cfg: PitConfig,
    variants: list[Variant],
    train_start: dt.date | None = None,
    parallelism: int = 1,
    checked: bool = False,
) -> DataFrame:
    """Out-of-sample predictions of every variant and fold, in one table that
    is keyed by ``run``.

    Each fold trains on ``[train_start, train_end)`` and predicts
    ``[test_start, test_end)``. All fits share one pool, ``parallelism`` at a
    time, so none waits for a variant to end. Predictions are stored, so scoring
    them does not evaluate the models again. Folds are checked first, in a pass
    over the frame, unless they are ``checked``.
    """
    if not checked:
        check_folds(frame, folds, train_start)

    def one(job: tuple[Variant, Fold]) -> DataFrame:
        variant, fold = job
        model = fit(between(frame, train_start, fold.train_end), variant.features, variant.params)
        rows = predicted(model, between(frame, fold.test_start, fold.test_end), cfg)
        return stored(rows.withColumn("run", F.lit(variant.run)), "fold")

    jobs = [(variant, fold) for variant in variants for fold in folds]
    one = inheritable_thread_target(frame.sparkSession)(one)
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        parts = pool.map(one, jobs, chunksize=1)
    return stored(reduce(DataFrame.unionByName, parts), "predictions")


def walk_forward(
    frame: DataFrame,
    folds: list[Fold],
    cfg: PitConfig,
    features: Iterable[str] = FEATURES,
    params: TreeParams = PARAMS,
    **how,
) -> DataFrame:
    """Out-of-sample predictions of every fold, in one table; see ``walk_forwards``."""
    return walk_forwards(frame, folds, cfg, [Variant("", tuple(features), params)], **how).drop("run")


def _ablations(frame: DataFrame, folds: list[Fold], cfg: PitConfig, params: dict[str, TreeParams], **how) -> dict[str, DataFrame]:
    """For each named parameters the scores per lead with all features and
    without weather, on the same rows."""
    sides = {"full": FEATURES, "ablated": NON_WEATHER_FEATURES}
    variants = [Variant(f"{name} {side}", names, p) for name, p in params.items() for side, names in sides.items()]
    rows = with_legal_anchor(walk_forwards(frame, folds, cfg, variants, **how))
    scores = {
        v.run: score_by_lead(rows.where(F.col("run") == v.run), MODEL) for v in variants
    }
    return {name: ablation_difference(scores[f"{name} full"], scores[f"{name} ablated"]) for name in params}


def ablation(frame: DataFrame, folds: list[Fold], cfg: PitConfig, params=PARAMS, **how) -> DataFrame:
    """Scores per lead with all features and without weather, on the same rows."""
    return _ablations(frame, folds, cfg, {"one": params}, **how)["one"]


def seed_sweep(
    frame: DataFrame, folds: list[Fold], cfg: PitConfig, seeds=(42, 0, 1, 2, 3), params=BAGGED, **how
) -> DataFrame:
    """The ablation once per seed, bagged, as one table keyed by seed and lead;
    all fits of all seeds share one pool."""
    runs = _ablations(frame, folds, cfg, {str(seed): replace(params, seed=seed) for seed in seeds}, **how)
    return reduce(DataFrame.unionByName, [run.withColumn("seed", F.lit(int(seed))) for seed, run in runs.items()])


def noise_floor(sweep: DataFrame, measures: Iterable[str] = ("rmse_pct_full", "rmse_pct_ablated", "pct_diff")) -> DataFrame:
    """Per lead and measure what changing the seed alone does: number of seeds,
    mean, standard deviation (of a sample), least, greatest and spread, and
    whether all seeds have one sign.

    An effect is real if it is large next to the spread and of one sign.
    """
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in measures]))
    rows = sweep.select("lead_days", each.alias("x")).select("lead_days", "x.measure", "x.value")
    value = F.col("value")
    return rows.groupBy("lead_days", "measure").agg(
        F.count(value).alias("n_seeds"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
        (F.max(value) - F.min(value)).alias("spread"),
        (F.min(F.signum(value)) == F.max(F.signum(value))).alias("one_sign"),
    )
