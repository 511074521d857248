"""One query per implemented operator, each over the whole driver tables; where a filter, a
sample, a limit or one target fuel is the operator's own feature, that is what is left out."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.session import prepared
from checks.tables import FIRST_YEAR, TIES, gas_raw
from litrewise.functions import department
from litrewise.operators import (
    calendar_history,
    cubes,
    folds,
    history,
    indices,
    metrics,
    prepare,
    reports,
    sketches,
    splits,
    tiles,
)
from litrewise.placement import settle, shared_folder
from litrewise.plans import forecasting, group_regression, indexed
from litrewise.plans.history import with_history
from litrewise.sources import (
    RAW_SCHEMA,
    materialize,
    read_price_files,
    read_price_files_checked,
    read_stage,
    refresh_stage,
    register_view,
    stage_sketches,
    write_clustered_stage,
    write_sketched_stage,
    write_stage,
)
from litrewise.sources.incremental import FILE

FUEL = "MEDIUM"
OTHER_FUELS = ["ECONOMY", "LARGE"]
CUT = "2000-06-01"
CUTS = ["1998-03-01", "1999-09-01", CUT]
ORDER = ["day_date", *TIES]
KEYS = ["id", "name", "day_date", *TIES]

Query = Callable[[SparkSession, str], DataFrame]
_registry: dict[str, Query] = {}


def query(run: Query) -> Query:
    def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(prepared(spark), sf_dir)

    _registry[run.__name__] = in_utc
    return run


def registered() -> dict[str, Query]:
    return dict(_registry)


# Bases shared by the queries


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.clean_prices(gas_raw(spark, sf_dir))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed.kept_observations(gas_raw(spark, sf_dir))


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed.weekly_observations(gas_raw(spark, sf_dir), first_year=FIRST_YEAR)


def with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed.indexed_observations(gas_raw(spark, sf_dir), first_year=FIRST_YEAR)


def weekly_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indices.add_week_index(cleaned(spark, sf_dir), FIRST_YEAR)
    return reports.average_without_rare_fuels(
        rows, ["week_index", "name"], "prix", "avg_weekly_price", settle=settle
    )


def index_in_hundredths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rounded index as whole numbers, so that its sums are exact in any order."""
    hundredths = F.round(F.col("price_index") * 100)
    return with_index(spark, sf_dir).withColumn("price_index", hundredths)


def rescaled(averages: DataFrame) -> DataFrame:
    return averages.withColumn("avg_index", F.col("avg_index") / 100)


def past_of(raw: DataFrame, lags: tuple[int, ...], rolling: int | None, *extra: str) -> DataFrame:
    rows, found = indexed.surveyed_observations(raw)
    keep = [*KEYS, "prix", *extra]
    return forecasting.complete_history(
        rows, found.sizes, keep=keep, lags=lags, rolling=rolling, order=ORDER
    )


def past(
    spark: SparkSession, sf_dir: str, lags: tuple[int, ...], rolling: int | None, *extra: str
) -> DataFrame:
    """Kept observations with lag columns, incomplete rows dropped."""
    return past_of(gas_raw(spark, sf_dir), lags, rolling, *extra)


def last_price_forecast(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    """The previous price as prediction: checks reports on predictions without a model."""
    return past(spark, sf_dir, (1, 7), 7, *extra).withColumn("prediction", F.col("price_lag_1"))


def features(spark: SparkSession, sf_dir: str, which: forecasting.FeatureSet) -> DataFrame:
    rows, found = indexed.surveyed_observations(gas_raw(spark, sf_dir))
    rows = indexed.index_surveyed(rows, found.daily, first_year=FIRST_YEAR)
    return forecasting.feature_table(rows, which, found.sizes, order=ORDER)


def feature_columns(df: DataFrame, which: forecasting.FeatureSet) -> DataFrame:
    return df.select(*KEYS, "prix", "price_index", "week_index", *which.columns)


def model_rows(spark: SparkSession, sf_dir: str, which: forecasting.FeatureSet) -> DataFrame:
    """The feature table as a written stage: split, fit and prediction all read it."""
    rows = features(spark, sf_dir, which)
    return settle(rows.select(*KEYS, "cp", "prix", *which.columns))


# Sources and sinks


@query
def src_csv_gz(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    rows = gas_raw(spark, sf_dir).select(*RAW_SCHEMA.names)
    rows.write.option("sep", ";").option("compression", "gzip").csv(path)
    read = read_price_files(spark, f"{path}/*.csv.gz")
    return read.withColumn("prix", F.col("prix").try_cast("double"))


@query
def src_csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    rows = gas_raw(spark, sf_dir).select(*RAW_SCHEMA.names)
    rows.write.option("sep", ";").option("compression", "gzip").csv(path)
    read = read_price_files(spark, f"{path}/*.csv.gz", infer_schema=True)
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields]
    return read.select(*typed).withColumn("prix", F.col("prix").try_cast("double"))


@query
def src_multi_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    rows = gas_raw(spark, sf_dir).select(*RAW_SCHEMA.names)
    yearly = rows.withColumn("file_year", F.substring("date", 1, 4)).write.partitionBy("file_year")
    yearly.option("sep", ";").option("compression", "gzip").csv(path)
    read = prepare.clean_prices(read_price_files(spark, f"{path}/file_year=*/*.csv.gz"))
    return read.groupBy("year").agg(F.count(F.lit(1)).alias("n_rows"))


@query
def sink_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    df = cleaned(spark, sf_dir).select(*KEYS, "prix", "lat", "long")
    write_stage(df, path, partition_by=["name"])
    return read_stage(spark, path, schema=df.schema)


@query
def stage_materialize(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    materialize(spark, path, lambda: kept(spark, sf_dir).select(*KEYS, "prix"))
    return materialize(spark, path, lambda: gas_raw(spark, sf_dir))


@query
def src_csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some lines lack a field, have one too many or a station that is no number: all lines by
    outcome, with a checksum of the rejected lines' text."""
    path = shared_folder(spark)
    rows = gas_raw(spark, sf_dir)
    station = F.when(F.col("l_orderkey") % 61 == 0, F.concat(F.lit("x"), F.col("id"))).otherwise(F.col("id").cast("string"))
    fields = [station, *[F.col(c).cast("string") for c in ("cp", "pop", "lat", "long", "date", "type", "name")]]
    price = F.col("prix").cast("decimal(18,0)").cast("string")
    line = F.concat_ws(";", *fields, F.when(F.col("l_orderkey") % 53 != 0, price), F.when(F.col("l_orderkey") % 59 == 0, "more"))
    rows.select(line.alias("value")).write.option("compression", "gzip").text(path)
    found = read_price_files_checked(spark, f"{path}/*.gz", shared_folder(spark))
    accepted = found.accepted.select(
        F.lit("accepted").alias("outcome"), F.lit(len(RAW_SCHEMA)).alias("n_fields"), F.col("prix").try_cast("double").cast("long").alias("checksum")
    )
    rejected = found.rejected.select(F.col("reason").alias("outcome"), "n_fields", F.length("line").cast("long").alias("checksum"))
    lines = accepted.unionByName(rejected).groupBy("outcome", "n_fields")
    return lines.agg(F.count(F.lit(1)).alias("n_lines"), F.sum("checksum").alias("checksum"))


@query
def stage_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage by years is built from yearly files; then 1998 has new prices, 2001 is gone and a
    late file has rows of 1996: rows of each year, and whether its files were replaced."""
    source, path = shared_folder(spark), shared_folder(spark)
    rows = gas_raw(spark, sf_dir)
    yearly = rows.select(*RAW_SCHEMA.names).withColumn("file_year", F.substring("date", 1, 4))
    yearly.write.partitionBy("file_year").option("sep", ";").option("compression", "gzip").csv(f"{source}/yearly")
    years = [r[0] for r in yearly.select("file_year").distinct().collect()]

    def build(raw: DataFrame) -> DataFrame:
        return prepare.clean_prices(raw).select(FILE, "id", "name", "day_date", "prix", "year")

    def files(kept: list[str]) -> list[str]:
        return [f"{source}/yearly/file_year={y.replace('/', '%2F')}/*.csv.gz" for y in kept]

    first = refresh_stage(spark, files(years), path, build).stage
    before = settle(first.select("year", F.col("_metadata.file_name").alias("old")).distinct())
    again = yearly.filter("file_year = '1998'").drop("file_year").withColumn("prix", F.col("prix") + 100)
    again.write.mode("overwrite").option("sep", ";").option("compression", "gzip").csv(f"{source}/yearly/file_year=1998")
    late = rows.filter(F.col("date").startswith("1996") & (F.col("l_orderkey") % 50 == 0)).select(*RAW_SCHEMA.names)
    late.write.option("sep", ";").option("compression", "gzip").csv(f"{source}/late")
    now = [*files([y for y in years if y != "2001"]), f"{source}/late/*.csv.gz"]
    stage = refresh_stage(spark, now, path, build).stage
    after = stage.select("year", "prix", F.col("_metadata.file_name").alias("new"))
    known = after.join(before.withColumnRenamed("year", "old_year"), (F.col("new") == F.col("old")) & (F.col("year") == F.col("old_year")), "left")
    return known.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("prix").alias("total"), F.max(F.col("old").isNull()).alias("rewritten")
    )


@query
def station_context_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of some stations, read from a stage that is clustered by station."""
    path = shared_folder(spark)
    write_clustered_stage(kept(spark, sf_dir).select(*KEYS, "prix"), path, order=["day_date", *TIES])
    return reports.station_context(read_stage(spark, path), [1, 3, 5, 7, 9], "1998-10-01", "1999-01-15", tiebreak=TIES)


@query
def sql_year_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_view(cleaned(spark, sf_dir), "gas_prices")
    return reports.yearly_average_sql(spark, "gas_prices")


@query
def forecast_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark)
    _, test = splits.split_by_date(last_price_forecast(spark, sf_dir, "cp"), CUT)
    forecasting.export_forecast(test, path)
    return read_stage(spark, path)


# Projections and filters


@query
def clean_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir)


@query
def drop_rare_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.fuel_counts(kept(spark, sf_dir))


@query
def not_a_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices spelled NaN or Infinity are lacking prices, also in the past of later rows."""
    spelled = F.when(F.col("l_orderkey") % 89 == 0, "NaN").when(F.col("l_orderkey") % 83 == 0, "Infinity")
    raw = gas_raw(spark, sf_dir).withColumn("prix", F.coalesce(spelled, F.col("prix").cast("string")))
    return past_of(raw, (1, 7), 7)


@query
def filter_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.filter_fuel(cleaned(spark, sf_dir), FUEL).select(*KEYS, "prix")


@query
def filter_year_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare.filter_years_and_fuels(cleaned(spark, sf_dir), [1997, 1998], OTHER_FUELS)
    return rows.select(*KEYS, "year", "prix")


@query
def station_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(spark, sf_dir)
    return reports.station_context(rows, [1, 3, 5, 7, 9], "1998-10-01", "1999-01-15", tiebreak=TIES)


@query
def price_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_index(spark, sf_dir).select(
        *KEYS, "prix", "avg_day_price_france", "price_index", "week_index"
    )


@query
def week_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir).select(*KEYS, "year", "week", "week_index")


@query
def week_index_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(spark, sf_dir)
    return indices.add_week_index(rows, FIRST_YEAR, iso=True).select(*KEYS, "week_index")


@query
def dept_of_cp(spark: SparkSession, sf_dir: str) -> DataFrame:
    dept = department(F.col("cp")).alias("dept")
    rows = cleaned(spark, sf_dir).groupBy("id", "cp", dept)
    return rows.agg(F.count(F.lit(1)).alias("n_rows"))


@query
def sample_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.sample_rows(gas_raw(spark, sf_dir), ["id", *TIES], 0.05, 42)
    return rows.select("id", "name", "prix", *TIES)


# Joins


@query
def join_national_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = indexed.with_national_average(kept(spark, sf_dir))
    return rows.select(*KEYS, "prix", "avg_day_price_france")


@query
def dept_map_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = spark.range(1, 96).select(F.lpad(F.col("id").cast("string"), 2, "0").alias("dept"))
    averages = rescaled(reports.department_average(index_in_hundredths(spark, sf_dir)))
    return reports.department_map(areas, averages, FUEL)


# Aggregations


@query
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.fuel_counts(cleaned(spark, sf_dir))


@query
def rare_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.rarest_fuels(cleaned(spark, sf_dir), 2)


@query
def national_daily_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(spark, sf_dir)
    return reports.average_without_rare_fuels(rows, indices.DAY_AND_FUEL, "prix", indices.AVERAGE, settle=settle)


@query
def weekly_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly_averages(spark, sf_dir).orderBy("week_index", "name")


@query
def daily_avg_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare.filter_years_and_fuels(kept(spark, sf_dir), [1996, 1999], ["LARGE", FUEL])
    return reports.daily_average(rows)


@query
def dept_avg_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescaled(reports.department_average(index_in_hundredths(spark, sf_dir)))


@query
def coord_avg_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rescaled(reports.coordinate_average(index_in_hundredths(spark, sf_dir)))


@query
def heat_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = rescaled(reports.coordinate_average(index_in_hundredths(spark, sf_dir)))
    return reports.heat_points(averages, 90.0)


@query
def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare.filter_years_and_fuels(cleaned(spark, sf_dir), [1997, 1998], OTHER_FUELS)
    return reports.headline_numbers(rows)


@query
def kpis_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare.filter_years_and_fuels(cleaned(spark, sf_dir), [1890], OTHER_FUELS)
    return reports.headline_numbers(rows)


@query
def kpis_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline numbers of several selections from a stage of the cube; stations by a sketch."""
    path = shared_folder(spark)
    write_stage(cubes.headline_cube(cleaned(spark, sf_dir)), path)
    cube = read_stage(spark, path)
    selections = {
        "all": None,
        "none": cubes.years_and_fuels([1890], OTHER_FUELS),
        "one_fuel": F.col("name") == FUEL,
        "two_years": cubes.years_and_fuels([1997, 1998], OTHER_FUELS),
    }
    rows = [cubes.cube_headlines(cube, s).withColumn("selection", F.lit(n)) for n, s in selections.items()]
    return reduce(DataFrame.unionByName, rows)


@query
def heat_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of all zoom levels, the index in hundredths so that sums are exact."""
    found = tiles.heat_tiles(index_in_hundredths(spark, sf_dir), zoom=10, floor=9000.0)
    return found.select("name", "zoom", "tile", "n_rows", "total", "weight")


@query
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.filter_options_without_rare_fuels(cleaned(spark, sf_dir), settle=settle)


@query
def peak_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.peak_week(weekly_averages(spark, sf_dir))


@query
def earliest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["date", "id", "name", *TIES]
    columns = ["id", "name", "prix", "year", "week"]
    return reports.first_rows(kept(spark, sf_dir), order, 5, columns)


@query
def explorer_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prepare.filter_years_and_fuels(cleaned(spark, sf_dir), [1997, 1998], OTHER_FUELS)
    return reports.first_rows(rows, KEYS, 1000, [*KEYS, "prix", "week"])


# Windows and feature tables


@query
def features_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return past(spark, sf_dir, (1, 7), None)


@query
def features_lag_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return past(spark, sf_dir, (1, 2, 3, 7), None)


@query
def features_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, found = indexed.surveyed_observations(gas_raw(spark, sf_dir))
    rows = rows.select(*KEYS, "prix")
    return with_history(rows, found.sizes, lags=(), rolling=7, order=ORDER)


@query
def features_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = history.daily_means(kept(spark, sf_dir))
    return history.add_history(days, lags=(1, 7), rolling=7, order=["day_date"])


@query
def features_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices one and seven calendar days ago and of the last seven days; gaps are null."""
    rows = calendar_history.add_calendar_history(kept(spark, sf_dir).select(*KEYS, "prix"))
    return rows.select(*KEYS, "prix", "price_1d_ago", "price_7d_ago", "avg_last_7d")


@query
def features_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = forecasting.FEATURES_A
    return feature_columns(features(spark, sf_dir, which), which)


@query
def features_set_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = forecasting.FEATURES_B
    return feature_columns(features(spark, sf_dir, which), which)


@query
def features_set_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = forecasting.FEATURES_C
    return feature_columns(features(spark, sf_dir, which), which)


# Splits


@query
def split_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.quantile_day(past(spark, sf_dir, (1, 7), 7), 0.8)


@query
def split_quantile_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cut by the sketches beside a stage, merged from fuels and by one sketch of all rows,
    against the exact one: whether its rank is within 0.001."""
    stage = write_sketched_stage(past(spark, sf_dir, (1, 7), 7), path := shared_folder(spark), by=["name"])
    merged = sketches.merged_sketch(stage_sketches(spark, path))
    forms = {"merged": merged, "whole": sketches.merged_sketch(sketches.day_sketches(stage))}
    exact = splits.quantile_day(stage, 0.8).withColumnRenamed("cut", "exact_cut")
    rows = []
    for form, sketch in forms.items():
        bounds = sketches.rank_bounds(stage, sketches.sketched_day(sketch, 0.8))
        within = (F.col("before") <= 0.8 + 0.001) & (F.col("upto") >= 0.8 - 0.001)
        rows.append(bounds.select(F.lit(form).alias("form"), "n_rows", within.alias("is_within")))
    return reduce(DataFrame.unionByName, rows).join(F.broadcast(exact))


@query
def split_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.with_part(past(spark, sf_dir, (1,), None), CUT)


@query
def split_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, test = splits.split_by_quantile(settle(past(spark, sf_dir, (1, 7), 7)), 0.8)
    return test


@query
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_counts(past(spark, sf_dir, (1, 7), 7), CUT)


# Predictions and their evaluation


@query
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = metrics.evaluate(last_price_forecast(spark, sf_dir))
    return values.select(*[F.round(m, 4).alias(m) for m in metrics.METRICS])


@query
def eval_by_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price as forecast, evaluated after each of three cuts in one pass."""
    values = folds.evaluate_by_cut(last_price_forecast(spark, sf_dir), CUTS)
    return values.select("cut", "horizon", "n_train", "n_test", *[F.round(m, 4).alias(m) for m in metrics.METRICS])


@query
def pred_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.value_range(last_price_forecast(spark, sf_dir))


@query
def pred_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.sample_rows(last_price_forecast(spark, sf_dir), ["id", *TIES], 0.05, 42)
    return rows.select(*KEYS, "prix", "prediction")


@query
def station_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, test = splits.split_by_date(last_price_forecast(spark, sf_dir), CUT)
    return forecasting.first_station_series(test, tiebreak=TIES)


# Models


@query
def assemble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = forecasting.FEATURES_A
    rows = forecasting.assemble(features(spark, sf_dir, which), which.columns)
    rows = rows.withColumn("elements", vector_to_array("features"))
    elements = [F.get("elements", i).alias(c) for i, c in enumerate(which.columns)]
    return rows.select(*KEYS, "prix", *elements)


@query
def model_lr_univariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(past(spark, sf_dir, (1, 7), 7))
    train, test = splits.split_by_date(rows, CUT)
    model = forecasting.fit(train, forecasting.linear_regression(), ["price_lag_1"])
    predicted = forecasting.predict(model, test)
    return predicted.select(*KEYS, "prix", F.round("prediction", 2).alias("prediction"))


@query
def model_lr_by_fuel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regression on the last price for every fuel, all from one aggregation."""
    train, test = splits.split_by_date(settle(past(spark, sf_dir, (1, 7), 7)), CUT)
    models = group_regression.fit_by_group(train, ["price_lag_1"])
    predicted = group_regression.predict_by_group(test, models, ["price_lag_1"])
    return predicted.select(*KEYS, "prix", F.round("prediction", 2).alias("prediction"))


@query
def model_lr_bivariate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features, checked against the closed form."""
    train, test = splits.split_by_date(settle(past(spark, sf_dir, (1, 7), 7)), CUT)
    columns = ["price_lag_1", "price_lag_7"]
    model = forecasting.fit(train, forecasting.linear_regression(), columns)
    predicted = forecasting.predict(model, test)
    return predicted.select(*KEYS, "prix", F.round("prediction", 2).alias("prediction"))


@query
def model_lr_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit of all seven features is the best one: its residual on the training rows is
    correlated with none of them and has mean 0."""
    which = forecasting.FEATURES_A
    train, _ = splits.split_by_date(model_rows(spark, sf_dir, which), CUT)
    model = forecasting.fit(train, forecasting.linear_regression(), which.columns)
    rows = forecasting.predict(model, train).withColumn("residual", F.col("prix") - F.col("prediction"))
    measured = [
        F.struct(F.lit(c).alias("feature"), (F.round(F.abs(F.corr("residual", c)), 6) + 0.0).alias("correlation"))
        for c in which.columns
    ]
    mean = F.struct(F.lit("mean").alias("feature"), (F.round(F.abs(F.avg("residual")) / F.avg("prix"), 6) + 0.0).alias("correlation"))
    return rows.agg(F.explode(F.array(*measured, mean)).alias("m")).select("m.*")


@query
def model_rf_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree with one split on the month: the split of least variance."""
    train, test = splits.split_by_date(settle(past(spark, sf_dir, (1, 7), 7, "month")), CUT)
    stump = forecasting.random_forest(trees=1, depth=1).setBootstrap(False).setFeatureSubsetStrategy("all")
    predicted = forecasting.predict(forecasting.fit(train, stump, ["month"]), test)
    return predicted.select(*KEYS, "prix", F.round("prediction", 2).alias("prediction"))


@query
def model_gbt_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boosted model of one round and one split on the month."""
    train, test = splits.split_by_date(settle(past(spark, sf_dir, (1, 7), 7, "month")), CUT)
    stump = forecasting.boosted_trees(iterations=1, depth=1)
    predicted = forecasting.predict(forecasting.fit(train, stump, ["month"]), test)
    return predicted.select(*KEYS, "prix", F.round("prediction", 2).alias("prediction"))


@query
def forecast_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two forecasts without a model, the last price and the rolling mean, side by side."""
    rows = past(spark, sf_dir, (1, 7), 7)
    columns = {"last_price": "price_lag_1", "rolling_mean": "rolling_avg_7"}
    values = metrics.evaluate_side_by_side(rows, columns)
    return values.select("model", *[F.round(m, 4).alias(m) for m in metrics.METRICS])


@query
def model_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = forecasting.FEATURES_A
    train, test = splits.split_by_quantile(model_rows(spark, sf_dir, which), 0.8)
    model = forecasting.fit(train, forecasting.linear_regression(), which.columns)
    return forecasting.predict(model, test).select(*KEYS, "prix", "prediction")


@query
def model_rf(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = forecasting.FEATURES_C
    train, test = splits.split_by_date(model_rows(spark, sf_dir, which), CUT)
    model = forecasting.fit(train, forecasting.random_forest(trees=50), which.columns)
    return forecasting.predict(model, test).select(*KEYS, "prix", "prediction")


@query
def model_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = forecasting.FEATURES_B
    train, test = splits.split_by_date(model_rows(spark, sf_dir, which), CUT)
    model = forecasting.fit(train, forecasting.boosted_trees(), which.columns)
    return forecasting.predict(model, test).select(*KEYS, "prix", "prediction")


@query
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models are compared for one target fuel, whose rows alone are read: that is the feature."""
    which = forecasting.FEATURES_A
    observed, found = indexed.surveyed_observations(gas_raw(spark, sf_dir))
    fuel = prepare.filter_fuel(indexed.index_surveyed(observed, found.daily, first_year=FIRST_YEAR), FUEL)
    sizes = prepare.filter_fuel(found.sizes, FUEL)
    rows = forecasting.feature_table(fuel, which, sizes, order=ORDER)
    rows = settle(rows.select(*KEYS, "prix", *which.columns))
    train, test = splits.split_by_date(rows, CUT)
    return forecasting.compare_models(train, test, forecasting.default_models(), which.columns)
