"""Feature tables, regression models, their comparison and the forecast export."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litrewise.operators.history import (
    ORDER,
    complete,
    drop_incomplete,
    lag_name,
    rolling_name,
)
from litrewise.operators.metrics import evaluate_side_by_side
from litrewise.operators.reports import station_series, with_department
from litrewise.plans.history import MAX_SERIES_ROWS, series_sizes, with_history
from litrewise.plans.trees import BoostedTrees, Forest
from litrewise.sources.stages import write_stage


class FeatureSet(NamedTuple):
    """Row lags to compute and the columns a model is given."""

    lags: tuple[int, ...]
    columns: tuple[str, ...]


# The three feature lists.
FEATURES_A = FeatureSet(
    (1, 7),
    ("price_lag_1", "price_lag_7", "rolling_avg_7", "day_of_week", "month", "lat", "long"),
)
FEATURES_B = FeatureSet(
    (1, 2, 3, 7),
    (
        "price_lag_1", "price_lag_2", "price_lag_3", "price_lag_7", "rolling_avg_7",
        "week", "month", "year", "lat", "long",
    ),
)
FEATURES_C = FeatureSet(
    (1, 2, 7),
    (
        "price_lag_1", "price_lag_2", "price_lag_7", "rolling_avg_7",
        "week", "month", "year", "lat", "long",
    ),
)

# Seed and sizes of the compared models.
SEED = 42
FOREST_TREES = 30
FOREST_DEPTH = 10
BOOSTING_ROUNDS = 20


def complete_history(
    df: DataFrame,
    sizes: DataFrame | None = None,
    *,
    keep: Sequence[str],
    lags: Sequence[int] = (1, 7),
    rolling: int | None = 7,
    order: Sequence[str] = ORDER,
    max_series_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """`keep` and the history columns of the rows that lack no value, in whatever column.

    Null and NaN count as lacking. Whether the incoming columns are all there is decided
    before the window and carried as one flag, so only what is kept is shuffled. Rows are
    dropped after the past has been read: they are part of it. `sizes` (rows of each
    series) spares a pass that counts them.
    """
    types = dict(df.dtypes)
    narrow = df.select(*keep, complete(df.columns, types).alias("_present"))
    sizes = series_sizes(df) if sizes is None else sizes
    rows = with_history(
        narrow, sizes, lags=lags, rolling=rolling, order=order, max_series_rows=max_series_rows
    )
    added = [lag_name(k) for k in lags] + ([rolling_name(rolling)] if rolling is not None else [])
    return drop_incomplete(rows.filter("_present"), added).drop("_present")


def feature_table(
    df: DataFrame,
    features: FeatureSet,
    sizes: DataFrame | None = None,
    *,
    order: Sequence[str] = ORDER,
    max_series_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """Observations with the features of their series' past; incomplete rows are dropped (see
    `complete_history`). `day_of_week` counts from 1 for Sunday."""
    rows = complete_history(
        df, sizes, keep=df.columns, lags=features.lags, order=order, max_series_rows=max_series_rows
    )
    if "day_of_week" in features.columns:
        rows = rows.withColumn("day_of_week", F.dayofweek("day_date"))
    return rows


def assemble(df: DataFrame, feature_cols: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(feature_cols), outputCol="features").transform(df)


def linear_regression(label: str = "prix") -> LinearRegression:
    return LinearRegression(labelCol=label)


def random_forest(
    label: str = "prix", *, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH, seed: int = SEED
) -> RandomForestRegressor:
    return Forest(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)


def boosted_trees(label: str = "prix", *, iterations: int = BOOSTING_ROUNDS, depth: int = 5, seed: int = SEED) -> GBTRegressor:
    return BoostedTrees(labelCol=label, maxIter=iterations, maxDepth=depth, seed=seed)


def fit(train: DataFrame, estimator: Estimator, feature_cols: Sequence[str]) -> PipelineModel:
    """Fit assembler and estimator as one pipeline.

    Only the features and the label are kept while the solver iterates over them.
    """
    return fit_all(train, {"model": estimator}, feature_cols)["model"]


def fit_all(
    train: DataFrame, estimators: Mapping[str, Estimator], feature_cols: Sequence[str]
) -> dict[str, PipelineModel]:
    """Fit several estimators on one training frame that is computed once.

    It is kept on disk: the estimators read it a few times only, and need the executors' memory
    for the rows they bin and go over at every level of a tree.
    """
    labels = {e.getLabelCol() for e in estimators.values()}
    narrow = train.select(*feature_cols, *sorted(labels - set(feature_cols)))
    narrow = narrow.persist(StorageLevel.DISK_ONLY)
    try:
        models = {}
        for name, estimator in estimators.items():
            assembler = VectorAssembler(inputCols=list(feature_cols), outputCol="features")
            models[name] = Pipeline(stages=[assembler, estimator]).fit(narrow)
        return models
    finally:
        narrow.unpersist()


def predict(model: PipelineModel, test: DataFrame) -> DataFrame:
    return model.transform(test).drop("features")


def predict_all(models: Mapping[str, PipelineModel], test: DataFrame) -> DataFrame:
    """One `prediction_<name>` column per model, all from one pass over `test`."""
    scored = test
    for name, model in models.items():
        scored = predict(model, scored).withColumnRenamed("prediction", f"prediction_{name}")
    return scored


def compare_models(
    train: DataFrame,
    test: DataFrame,
    estimators: Mapping[str, Estimator],
    feature_cols: Sequence[str],
    *,
    label: str = "prix",
) -> DataFrame:
    """RMSE, MAE and R² of each estimator on the same split."""
    scored = predict_all(fit_all(train, estimators, feature_cols), test)
    columns = {name: f"prediction_{name}" for name in estimators}
    return evaluate_side_by_side(scored, columns, label=label)


def default_models(label: str = "prix") -> dict[str, Estimator]:
    """The three regressors that are compared by default."""
    return {
        "linear_regression": linear_regression(label),
        "random_forest": random_forest(label),
        "boosted_trees": boosted_trees(label),
    }


def forecast_rows(predictions: DataFrame) -> DataFrame:
    return with_department(predictions).select("day_date", "name", "dept", "prix", "prediction")


def export_forecast(predictions: DataFrame, path: str) -> None:
    write_stage(forecast_rows(predictions), path)


def first_station_series(predictions: DataFrame, *, tiebreak: Sequence[str] = ()) -> DataFrame:
    """`station_series` of the smallest station. Its number is fetched first: as a literal it
    reaches the scan, and only that station's rows are computed again."""
    station = predictions.agg(F.min("id").alias("id")).first()["id"]
    return station_series(predictions, station, tiebreak=tiebreak)
