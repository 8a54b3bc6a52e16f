"""Metrics of codes, predictions and lengths, as aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions.vector import l2sq
from quantloom.session import distributed_rank

PERCENTILES = (25, 50, 75, 90, 95, 99)


def unique_share(codes: DataFrame, column: str = "codes", by: Sequence[str] = ()) -> DataFrame:
    """n, n_unique and p_unique = distinct tuples / rows, of all rows or for each batch. Null tuples are left out."""
    rows = codes.filter(F.col(column).isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(column).alias("n_unique")).withColumn("p_unique", F.try_divide("n_unique", "n"))


def level_entropy(codes: DataFrame, column: str = "codes") -> DataFrame:
    """(level, n_codes, entropy) with natural logarithms; null and negative codes are left out."""
    counts = codes.select(F.posexplode(column).alias("level", "code")).filter("code >= 0").groupBy("level", "code").agg(F.count("*").alias("c"))
    total = counts.groupBy("level").agg(F.sum("c").alias("n"))
    p = F.col("c") / F.col("n")
    return counts.join(F.broadcast(total), "level").groupBy("level").agg(F.count("*").alias("n_codes"), F.sum(-p * F.ln(p)).alias("entropy"))  # one total a level


def reconstruction_error(df: DataFrame, vector: str, rebuilt: str) -> DataFrame:
    """Mean squared error over all elements of all rows with both vectors of one length."""
    rows = df.filter(F.size(vector) == F.size(rebuilt)).select(l2sq(vector, rebuilt).alias("e"), F.size(vector).alias("d"))
    return rows.agg(F.try_divide(F.sum("e"), F.sum("d")).alias("mse"), F.count("*").alias("n"))


def recall_at(predictions: DataFrame, pred: str, truth: str, cuts: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """Share of rows whose true item (or code tuple) is among the first predictions; null predictions miss."""
    hit = lambda c: F.coalesce(F.array_contains(F.slice(pred, 1, c), F.col(truth)), F.lit(False)).cast("double")
    return predictions.agg(F.count("*").alias("n"), *[F.avg(hit(c)).alias(f"recall_at_{c}") for c in cuts])


def perplexity(losses: DataFrame, loss: str = "loss", tokens: str = "n_tokens") -> DataFrame:
    return losses.agg(F.exp(F.try_divide(F.sum(F.col(loss) * F.col(tokens)), F.sum(tokens))).alias("perplexity"))


def length_stats(df: DataFrame, length: str, by: Sequence[str] = (), total: bool = False) -> DataFrame:
    """count, min, max, mean, population standard deviation and interpolated percentiles; with ``total`` a row over all groups too (null groups)."""
    ps = [F.percentile(length, F.lit(p / 100)).alias(f"p{p}") for p in PERCENTILES]
    return (df.filter(F.col(length).isNotNull()).rollup(*by) if total else df.filter(F.col(length).isNotNull()).groupBy(*by)).agg(F.count("*").alias("n"), F.min(length).alias("min"), F.max(length).alias("max"), F.avg(length).alias("mean"), F.stddev_pop(length).alias("std"), *ps)


def stats_delta(stats: DataFrame, by: str, left: str, right: str) -> DataFrame:
    """(metric, a, b, delta, percent) of two rows of ``length_stats``."""
    names = [c for c in stats.columns if c != by]
    flat = stats.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v")) for c in names])).alias("m")).select(by, "m.*")
    a = flat.filter(F.col(by) == left).select("metric", F.col("v").alias("a"))
    b = flat.filter(F.col(by) == right).select("metric", F.col("v").alias("b"))
    return a.join(b, "metric").withColumn("delta", F.col("b") - F.col("a")).withColumn("percent", F.try_divide(100 * F.col("delta"), F.col("a")))


def total_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """One row (edge): the exact interpolated quantile of a column, null without values.

    The two neighbours of the quantile are found by a distributed rank, so no task gets all values.
    """
    values = df.filter(F.col(column).isNotNull()).select(F.lit(0).alias("_g"), F.col(column).cast("double").alias("_v"))
    ranked = distributed_rank(values, ["_g"], ["_v"], "_r")
    place = (F.col("_n") - 1) * F.lit(q)
    near = ranked.crossJoin(F.broadcast(ranked.agg(F.count("*").alias("_n")))).withColumn("_w", 1 - F.abs(F.col("_r") - place)).filter("_w > 0")  # one row on the right
    return near.agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("edge"))


def quantile_flag(df: DataFrame, column: str, q: float = 0.8, out: str = "is_low") -> DataFrame:
    """Whether a value lies at or below the exact interpolated quantile of the column."""
    edge = total_quantile(df, column, q).select(F.col("edge").alias("_edge"))
    return df.crossJoin(F.broadcast(edge)).withColumn(out, F.col(column) <= F.col("_edge")).drop("_edge")  # the right side is one row


def batch_mean(df: DataFrame, batch: str, value: str) -> DataFrame:
    """(value, n_batches): the mean of the means of batches; a smaller last batch weighs as much as the others."""
    each = df.groupBy(batch).agg(F.avg(value).alias("_m")).filter("_m is not null")
    return each.agg(F.avg("_m").alias(value), F.count("*").alias("n_batches"))


def level_losses(df: DataFrame, residuals: Sequence[str], beta: float = 0.25, learnable: bool = False) -> DataFrame:
    """One row: the loss of each level (loss_0, ...) and their sum ``loss``, 0 without levels.

    ``residuals``: for each level the column of what its code leaves over. With moving averages the loss
    is beta times the mean square; with learnable codes (1 + beta) times the mean over rows of the sum of squares.
    """
    square = [F.aggregate(F.col(c), F.lit(0.0), lambda s, x: s + x * x) for c in residuals]
    each = [(F.avg(q) * (1 + beta)) if learnable else F.try_divide(F.sum(q), F.sum(F.when(F.col(c).isNotNull(), F.size(c)))) * beta for q, c in zip(square, residuals)]
    rows = df.agg(F.count("*").alias("n"), *[e.alias(f"loss_{i}") for i, e in enumerate(each)])
    total = F.lit(0.0)
    for i in range(len(residuals)):
        total = total + F.col(f"loss_{i}")
    return rows.withColumn("loss", total)


def evaluate(predictions: DataFrame, truth: str, losses: DataFrame | None = None, pred: str = "pred", cuts: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """One row: n and recall_at_..., with the perplexity of ``losses`` (loss, n_tokens) beside it if given. Items may be ids or code tuples."""
    out = recall_at(predictions, pred, truth, cuts)
    return out.crossJoin(perplexity(losses)) if losses is not None else out  # one row each


def pivot(df: DataFrame, row: str, column: str, values: Sequence, value: str) -> DataFrame:
    """A table of ``row`` by ``column``: the first ``value`` of each pair; ``values`` names the columns, so no pass looks for them."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.first(value))
