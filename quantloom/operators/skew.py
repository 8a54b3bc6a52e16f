"""Per-key results that stay balanced when a few keys hold most rows.

``keyed_quantiles`` selects exact per-key quantiles by refining value histograms: every round
adds up mergeable bucket counts per key (partial sums before the shuffle), keeps the bucket that
holds the wanted rank and refines inside it. A hot key contributes at most ``2 ** BITS + 1``
counts per round and task; its values are never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.session import BROADCAST_BYTES, stage

#: log2 of the histogram buckets of a round.
BITS = 10
#: A key is hot with this share of the rows or more, so there are at most 1024 hot keys.
HOT_SHARE = 1 / 1024
#: Salts of a hot key when the state is too large to broadcast.
SALTS = 64


def keyed_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Sequence[float] = (0.5, 0.9, 0.99),
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Counts and exact discrete quantiles of a whole-number column for each key.

    Columns: ``keys``, ``n_rows`` (rows of the key), ``n_values`` (its non-null values),
    ``min_value``, ``max_value`` and ``q0``, ``q1``, ... for ``probs``: the value of rank
    ``max(1, ceil(p * n_values))`` in ascending order.

    Without ``probs`` the counts alone are computed. A column that does not hold whole numbers is refused,
    never truncated. Null keys form a key of their own. Null values count in ``n_rows`` only; a key without values
    has null quantiles. Ties and repeated rows count as often as they occur. An empty table gives
    no rows. Other columns, also with clashing names, are left out before anything is computed.
    """
    if any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probs must be numbers from 0 to 1")
    kind = df.select(value).schema[0].dataType
    if not isinstance(kind, T.IntegralType | T.NullType):
        raise TypeError(f"{value} holds {kind.simpleString()}, not whole numbers")
    names = [f"_key{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("long").alias("_v"))
    # Equal values of a key collapse before and after the shuffle; hashing on key and value spreads a hot key.
    weighted = stage(rows.groupBy(*names, "_v").agg(F.count("*").alias("_w")))
    totals = stage(
        weighted.groupBy(*names).agg(
            F.sum("_w").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))), F.lit(0)).alias("n_values"),
            F.min("_v").alias("min_value"),
            F.max("_v").alias("max_value"),
        )
    )
    if not probs:
        return totals.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "n_rows", "n_values", "min_value", "max_value")
    weighted = weighted.filter(F.col("_v").isNotNull())
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n_values") - F.lit(1e-9))).cast("long").alias("rank")) for i, p in enumerate(probs)])
    state = (
        totals.filter("n_values > 0")
        .withColumn("_p", F.explode(ranks))
        .select(*names, F.col("_p.i").alias("_i"), F.col("_p.rank").alias("_rank"), F.col("min_value").alias("_lo"), F.col("max_value").alias("_hi"), F.lit(0).cast("long").alias("_below"))
    )
    state = stage(state)
    done = []
    while True:
        done.append(state.filter("_lo = _hi"))
        active = state.filter("_lo < _hi")
        # Text keys count with their bytes, others with a word each.
        bytes_ = F.lit(0).cast("long")
        for n in names:
            bytes_ = bytes_ + F.coalesce(F.octet_length(F.col(n).cast("string")).cast("long"), F.lit(0)) + 24
        n_active, n_bytes = active.agg(F.count("*"), F.coalesce(F.sum(bytes_), F.lit(0))).first()
        if not n_active:
            break
        state = stage(_refine(weighted, active, totals, names, n_bytes + 48 * n_active <= broadcast_bytes))
    resolved = done[0]
    for part in done[1:]:
        resolved = resolved.unionByName(part)
    picked = resolved.groupBy(*names).agg(*[F.max(F.when(F.col("_i") == i, F.col("_lo"))).alias(f"q{i}") for i in range(len(probs))])
    out = totals.alias("t").join(picked.alias("p"), [F.col(f"t.{n}").eqNullSafe(F.col(f"p.{n}")) for n in names], "left")
    return out.select(*[F.col(f"t.{n}").alias(k) for k, n in zip(keys, names)], "n_rows", "n_values", "min_value", "max_value", *[f"q{i}" for i in range(len(probs))])


def _refine(weighted: DataFrame, active: DataFrame, totals: DataFrame, names: list[str], small: bool) -> DataFrame:
    """One round: the range of each unresolved rank shrinks by ``2 ** BITS``."""
    span = F.col("_hi").cast("double") - F.col("_lo").cast("double") + 1
    active = active.withColumn("_shift", F.greatest(F.lit(0), F.ceil(F.log2(span / F.lit(float(1 << BITS))))).cast("int"))
    same = [F.col(f"w.{n}").eqNullSafe(F.col(f"s.{n}")) for n in names]
    inside = (F.col("w._v") >= F.col("s._lo")) & (F.col("w._v") <= F.col("s._hi"))
    if small:
        matched = weighted.alias("w").join(F.broadcast(active.alias("s")), [*same, inside])
    else:
        limit = totals.agg(F.sum("n_rows")).first()[0] * HOT_SHARE
        # At most 1 / HOT_SHARE keys.
        hot = F.broadcast(totals.filter(F.col("n_rows") >= limit).select(*names, F.lit(SALTS).alias("_salts")))

        def salted(side: DataFrame) -> DataFrame:
            return side.alias("x").join(hot.alias("h"), [F.col(f"x.{n}").eqNullSafe(F.col(f"h.{n}")) for n in names], "left").select("x.*", F.coalesce("_salts", F.lit(1)).alias("_salts"))

        left = salted(weighted).withColumn("_salt", F.pmod(F.xxhash64("_v"), F.col("_salts")).cast("int"))
        right = salted(active).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
        matched = left.alias("w").join(right.alias("s"), [*same, F.col("w._salt") == F.col("s._salt"), inside])
    histogram = matched.groupBy(*[F.col(f"s.{n}").alias(n) for n in names], "s._i", "s._rank", "s._lo", "s._hi", "s._below", "s._shift", F.expr("shiftright(w._v, s._shift)").alias("_bucket")).agg(F.sum("w._w").alias("_n"))
    by = Window.partitionBy(*names, "_i").orderBy("_bucket")  # at most 2 ** BITS + 1 rows in a partition
    upto = F.col("_below") + F.sum("_n").over(by)
    first = F.expr("shiftleft(_bucket, _shift)")
    last = F.expr("shiftleft(_bucket, _shift) | (shiftleft(1L, _shift) - 1)")
    return (
        histogram.withColumn("_upto", upto)
        .filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank")))
        .select(*names, "_i", "_rank", F.greatest("_lo", first).alias("_lo"), F.least("_hi", last).alias("_hi"), (F.col("_upto") - F.col("_n")).alias("_below"))
    )


def heavy_keys(per_key: DataFrame, group: Sequence[str], total: DataFrame, share: str) -> DataFrame:
    """Keys of a ``keyed_quantiles`` result whose ``n_rows`` reach ``share`` (a column of ``total``) of ``total.n``.

    ``total`` has one row per ``group``, so it is small by construction. Empty inputs give no rows.
    """
    return per_key.join(F.broadcast(total), list(group)).filter(F.col("n_rows") >= F.col(share) * F.col("n"))


def arrival_delays(interactions: DataFrame) -> DataFrame:
    """One row per interaction and item: (key_value, value) with value = microseconds from ts to arrived_at.

    Redelivered rows count once, with their smallest delay. Rows without an interaction, or with a
    null or negative item, are left out; a null time gives a null value.
    """
    micros = F.unix_micros(F.col("arrived_at").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        interactions.filter("interaction_id is not null and item_id >= 0")
        .select("interaction_id", F.col("item_id").alias("key_value"), micros.alias("value"))
        .groupBy("interaction_id", "key_value")
        .agg(F.min("value").alias("value"))
    )


def first_level_codes(codes: DataFrame) -> DataFrame:
    """One row per item and first-level code: (item_id, key_value, value) with value = second-level code.

    Null and empty codes, negative first levels and null items are left out; a missing or negative
    second level gives a null value; redelivered rows count once.
    """
    second = F.try_element_at("codes", F.lit(2))
    return (
        codes.select("item_id", F.try_element_at("codes", F.lit(1)).cast("long").alias("key_value"), F.when(second >= 0, second).cast("long").alias("value"))
        .filter("item_id is not null and key_value >= 0")
        .groupBy("item_id", "key_value")
        .agg(F.min("value").alias("value"))
    )
