"""Readers and writers of the raw and derived tables."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META_SCHEMA = "asin string, title string, brand string, categories array<array<string>>, price double, description string"


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(user_id, items) from lines ``user item item ...`` with ids from 1; ids become 0-based. Blank lines are left out."""
    ids = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.try_cast("bigint") - 1)
    rows = spark.read.text(path).filter(F.trim("value") != "").select(ids.alias("ids"))
    return rows.select(F.get("ids", F.lit(0)).alias("user_id"), F.slice("ids", F.lit(2), F.size("ids") - 1).alias("items"))


def read_id_map(spark: SparkSession, path: str, field: str = "item2id") -> DataFrame:
    """(asin, item_id) from a JSON object that maps names to 1-based ids."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<{field}:map<string,string>>")[field].alias("m"))
    return rows.select(F.explode("m").alias("asin", "id")).select("asin", (F.col("id").try_cast("bigint") - 1).alias("item_id"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Item metadata from lines that each hold a dict with single or double quotes; nothing is evaluated. Unreadable lines give null columns."""
    options = {"allowSingleQuotes": "true", "allowUnquotedFieldNames": "true", "allowBackslashEscapingAnyCharacter": "true", "mode": "PERMISSIVE"}
    return spark.read.text(path).filter(F.trim("value") != "").select(F.from_json("value", META_SCHEMA, options).alias("m")).select("m.*")


def unreadable_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n_lines, n_unreadable) of a metadata file: how many lines give no ``asin`` and so no item."""
    return read_metadata(spark, path).agg(F.count("*").alias("n_lines"), F.count_if(F.col("asin").isNull()).alias("n_unreadable"))


def read_config(path: str, kind: type) -> Any:
    """A dataclass from a JSON file of its fields; unknown fields are an error."""
    with open(path) as f:
        return kind(**json.load(f))


def items_with_text(meta: DataFrame, ids: DataFrame) -> DataFrame:
    """(item_id, asin, item_text): metadata joined to ids by asin."""
    from quantloom.operators.sequences import item_text

    joined = meta.join(ids, "asin").withColumn("category", F.array_join(F.coalesce(F.get("categories", F.lit(0)), F.array().cast("array<string>")), ", "))
    return item_text(joined, "title", "brand", "category", "price").select("item_id", "asin", "item_text")


def split_filter(items: DataFrame, which: str = "all", flag: str = "is_train") -> DataFrame:
    """train, eval (not train) or all items; a null flag is neither."""
    if which not in ("train", "eval", "all"):
        raise ValueError(which)
    return items if which == "all" else items.filter(F.col(flag) if which == "train" else ~F.col(flag))


def write_once(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Write a table unless it is there already, and read it back."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if force or not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_samples(samples: DataFrame, path: str, meta: dict[str, Any]) -> None:
    """Samples by split, so a reader prunes, with their metadata beside them."""
    samples.write.mode("overwrite").partitionBy("split").parquet(f"{path}/samples")
    samples.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").write.mode("overwrite").json(f"{path}/meta")


def read_samples(spark: SparkSession, path: str, split: str | None = None) -> tuple[DataFrame, dict[str, Any]]:
    rows = spark.read.parquet(f"{path}/samples")
    meta = json.loads(spark.read.schema("meta string").json(f"{path}/meta").first().meta)
    return (rows.filter(F.col("split") == split) if split else rows), meta


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def log_metrics(spark: SparkSession, path: str, step: int, values: dict[str, float]) -> None:
    """Append a step's metrics to a table (step, metric, value)."""
    spark.createDataFrame([(step, k, float(v)) for k, v in values.items()], "step long, metric string, value double").coalesce(1).write.mode("append").parquet(path)
