"""Configuration documents and the asset dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PARAMS = "struct<fast_window:int,slow_window:int,leverage_factor:double,stop_loss_pct:double,process_noise:double,measurement_noise:double>"
CONFIG_SCHEMA = f"map<string,map<string,{_PARAMS}>>"

# Parameters that a document may leave out.
DEFAULTS = {"fast_window": 15, "slow_window": 80, "leverage_factor": 5.0, "stop_loss_pct": 0.15, "process_noise": 0.3, "measurement_noise": 3.0}


def flatten_configs(docs: DataFrame, body: str = "body", keep=()) -> DataFrame:
    """Group -> asset -> parameters documents as one row per (group, asset), defaults filled in."""
    d = docs.select(*keep, F.explode(F.from_json(body, CONFIG_SCHEMA)).alias("group", "assets"))
    d = d.select(*keep, "group", F.explode("assets").alias("asset", "p"))
    return d.select(*keep, "group", "asset", *[F.coalesce(F.col(f"p.{k}"), F.lit(v)).alias(k) for k, v in DEFAULTS.items()])


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """A scan of configuration files, one document per file: file (its path), group, asset, parameters, and malformed.

    A file that is no such document is one row with its text in ``malformed`` and nothing else; an empty document gives no rows.
    """
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    d = docs.withColumn("parsed", F.from_json("value", CONFIG_SCHEMA))
    broken = F.when(F.col("parsed").isNull(), F.col("value"))
    d = d.select("file", broken.alias("malformed"), F.explode_outer("parsed").alias("group", "assets"))
    d = d.select("file", "malformed", "group", F.explode_outer("assets").alias("asset", "p")).where("malformed is not null or asset is not null")
    return d.select("file", "group", "asset", *[F.when(F.col("asset").isNotNull(), F.coalesce(F.col(f"p.{k}"), F.lit(v))).alias(k) for k, v in DEFAULTS.items()], "malformed")


ASSET_SCHEMA = (
    "name string, symbol string, lot_size int, initial_capital double, buy_cost_bps double, sell_cost_bps double, leverage double, fast int, slow int, "
    "stop double, dqn_exit boolean, timeframe_params map<string,struct<leverage:double,fast:int,slow:int,stop:double,dqn_exit:boolean>>"
)


def asset_dimension(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, ASSET_SCHEMA)


def with_asset(bars: DataFrame, assets: DataFrame) -> DataFrame:
    """All bars with their symbol's parameters: those of the timeframe where given, else the asset's own; NULL for unknown symbols.
    The dimension is joined without a hint, so Spark broadcasts it only while its size allows."""
    d = bars.join(assets, "symbol", "left")
    tf = F.element_at("timeframe_params", F.col("timeframe"))
    return d.withColumns({f"cfg_{k}": F.coalesce(tf[k], F.col(k)) for k in ("leverage", "fast", "slow", "stop", "dqn_exit")}).drop("timeframe_params")


def unknown_symbols(bars: DataFrame, assets: DataFrame) -> DataFrame:
    return bars.select("symbol").distinct().join(assets, "symbol", "left_anti")


def write_report(df: DataFrame, path: str) -> None:
    """JSON lines, one file per task."""
    df.write.mode("overwrite").json(path)


def nested_report(metrics: DataFrame, by: str, id_col: str, cols) -> DataFrame:
    """One nested document per ``by``: its configs with their metrics, ordered by id. The list is as long as the config list."""
    entry = F.struct(F.col(id_col), F.struct(*cols).alias("metrics"))
    return metrics.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("results"))
