"""Items that appear together: stripes per item, merged by key, with log-likelihood ratios.

A mapper keeps one associative array (stripe) of neighbours per item for the sessions it sees;
stripes are shuffled by item and neighbour block and merged there as sorted streams, so no task
holds more than one block of one item. Sessions with many items are cut into blocks that meet
pairwise in different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.session import BROADCAST_BYTES, broadcast_if_small, stage

#: Items of a block of a session; sessions up to this size are one block.
BLOCK_ITEMS = 256
#: Blocks that the neighbours of an item are spread over, so that a hot item is merged by many tasks: at
#: least so many, and one for each so many distinct items, up to so many.
LEAST_BLOCKS, BLOCK_NEIGHBOURS, MOST_BLOCKS = 16, 8_192, 4_096
#: An item is hot with this share of all places in baskets, so there are at most 1,024; and salts of a hot item in joins.
HOT_SHARE, SALTS = 1 / 1_024, 64
#: Pairs a mapper combines at a time.
COMBINE_PAIRS = 1_000_000

_STRIPE = "item_a long, block int, neighbours array<long>, counts array<long>"


def _combined(a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal pairs, in the order of (block of b, a, b) within a."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    if n is None:
        counts = np.diff(np.append(starts, len(a)))
    else:
        counts = np.add.reduceat(n[order], starts) if len(a) else n
    return a[starts], b[starts], counts.astype(np.int64)


def _block(b: np.ndarray, blocks: int) -> np.ndarray:
    return ((b * 0x9E3779B1) >> 7) % blocks


def _stripes(a: np.ndarray, b: np.ndarray, blocks: int) -> pa.RecordBatch:
    a, b, n = _combined(a, b)
    block = _block(b, blocks)
    order = np.lexsort((b, block, a))
    a, b, n, block = a[order], b[order], n[order], block[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (block[1:] != block[:-1])
    starts = np.flatnonzero(new)
    offsets = pa.array(np.append(starts, len(a)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(block[starts].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(b)), pa.ListArray.from_arrays(offsets, pa.array(n))], names=["item_a", "block", "neighbours", "counts"])


def _map_stripes(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """Rows (lhs, rhs): pairs within lhs if rhs is null, else between the two; both hold distinct items of one session."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        lhs, rhs = batch.column(0), batch.column(1)
        values, offsets = lhs.values.to_numpy(zero_copy_only=False), lhs.offsets.to_numpy()
        lengths = np.diff(offsets)
        alone = np.asarray(rhs.is_null().to_numpy(zero_copy_only=False))
        for m in np.unique(lengths[alone]):
            if m < 2:
                continue
            rows = np.flatnonzero(alone & (lengths == m))
            i, j = np.triu_indices(m, 1)
            step = max(1, COMBINE_PAIRS // len(i))
            for k in range(0, len(rows), step):
                items = np.sort(values[offsets[rows[k : k + step]][:, None] + np.arange(m)], axis=1)
                held.append((items[:, i].ravel(), items[:, j].ravel()))
                size += len(held[-1][0])
                if size >= COMBINE_PAIRS:
                    yield _stripes(*map(np.concatenate, zip(*held)), blocks)
                    held, size = [], 0
        for r in np.flatnonzero(~alone):
            x, y = lhs[int(r)].values.to_numpy(), rhs[int(r)].values.to_numpy()
            p, q = np.repeat(x, len(y)), np.tile(y, len(x))
            held.append((np.minimum(p, q), np.maximum(p, q)))
            size += len(p)
            if size >= COMBINE_PAIRS:
                yield _stripes(*map(np.concatenate, zip(*held)), blocks)
                held, size = [], 0
    if held:
        yield _stripes(*map(np.concatenate, zip(*held)), blocks)


def _merger(min_count: int, blocks: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stripes sorted by item and block; the last key of a batch may go on in the next."""
        kept: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

        def out(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            ok = n >= min_count
            return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok]), pa.array(n[ok])], names=["item_a", "item_b", "n_ab"])

        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                lists = part.column(2)
                a = np.repeat(part.column(0).to_numpy(), lists.value_lengths().to_numpy())
                b, n = lists.flatten().to_numpy(), part.column(3).flatten().to_numpy()
                if kept is not None:
                    a, b, n = np.concatenate([kept[0], a]), np.concatenate([kept[1], b]), np.concatenate([kept[2], n])
                if not len(a):
                    continue
                last_a, last_block = a[-1], _block(b[-1:], blocks)[0]
                a, b, n = _combined(a, b, n)
                open_ = (a == last_a) & (_block(b, blocks) == last_block)
                yield out(a[~open_], b[~open_], n[~open_])
                kept = a[open_], b[open_], n[open_]
        if kept is not None:
            yield out(*kept)

    return merge


def cooccurring_items(interactions: DataFrame, basket: str = "session_id", item: str = "item_id", min_count: int = 1, min_share: float = 0.0, min_lift: float = 0.0, min_llr: float = 0.0) -> DataFrame:
    """Pairs of items that occur in the same basket.

    Columns: ``item_a`` < ``item_b``, ``n_ab`` (baskets with both), ``n_a``, ``n_b`` (baskets with
    each), ``n`` (all baskets), ``lift`` = n_ab * n / (n_a * n_b), ``llr`` = the log-likelihood ratio
    of the two-by-two table. With ``min_llr`` only pairs that occur together significantly more often
    than chance come out: those with a lift over 1 and that ratio or more (10.83: one in a thousand by chance).

    Rows with a null basket, or a null or negative item, are left out; an item counts once in a
    basket however often it is repeated. Only pairs with ``n_ab >= min_count``,
    ``n_ab >= n * min_share`` and ``lift >= min_lift`` come out. These limits also bound each item
    (n_ab cannot exceed n_a or n_b, so n_a must reach the count and n / n_a the lift), and items
    beyond that bound are set aside before pairs are made: no pair within the limits is lost. An empty table gives no rows. Other
    columns are never read.
    """
    rows = interactions.select(F.col(basket).alias("basket"), F.col(item).cast("long").alias("item")).filter("basket is not null and item >= 0")
    pairs = stage(rows.distinct())
    sizes = pairs.groupBy("basket").agg(F.count("*").alias("m"))
    n = sizes.count()
    items = stage(pairs.groupBy("item").agg(F.count("*").alias("n_x")))
    least = max(min_count, n * min_share)
    bound = (F.col("n_x") >= F.lit(least)) & (F.lit(float(n)) >= F.lit(float(min_lift)) * F.col("n_x"))
    kept = pairs.join(items.filter(bound).select("item"), "item", "left_semi")
    kept = stage(kept) if least > 1 or min_lift > 0 else pairs
    sizes = kept.groupBy("basket").agg(F.ceil(F.count("*") / F.lit(BLOCK_ITEMS)).cast("int").alias("blocks"), F.count("*").alias("m")).filter("m > 1")
    large = stage(sizes.filter("blocks > 1").select("basket", "blocks"))
    # Small baskets: one row each. Large ones: blocks by a hash of the item, all pairs of blocks.
    small = kept.join(large, "basket", "left_anti").groupBy("basket").agg(F.collect_list("item").alias("lhs")).filter("size(lhs) > 1").select("lhs", F.lit(None).cast("array<long>").alias("rhs"))
    # A hot basket is cut by item hash before it is grouped.
    cut = kept.join(large, "basket").withColumn("k", F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")).groupBy("basket", "blocks", "k").agg(F.collect_list("item").alias("items"))
    cut = stage(cut)
    within = cut.filter("size(items) > 1").select(F.col("items").alias("lhs"), F.lit(None).cast("array<long>").alias("rhs"))
    left = cut.withColumn("other", F.explode(F.expr("sequence(k, blocks - 1)"))).filter("other > k")
    across = left.alias("l").join(cut.alias("r"), (F.col("l.basket") == F.col("r.basket")) & (F.col("l.other") == F.col("r.k"))).select(F.col("l.items").alias("lhs"), F.col("r.items").alias("rhs"))
    work = small.unionByName(within).unionByName(across)
    able = items.filter(bound)  # only these are in pairs
    n_items, places = able.agg(F.count("*"), F.coalesce(F.sum("n_x"), F.lit(0))).first()
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, n_items // BLOCK_NEIGHBOURS))
    stripes = work.mapInArrow(lambda batches: _map_stripes(batches, blocks), _STRIPE)
    merged = stripes.repartition("item_a", "block").sortWithinPartitions("item_a", "block").mapInArrow(_merger(int(np.ceil(least)), blocks), "item_a long, item_b long, n_ab long")
    counted = (
        _with_count(_with_count(merged, able, n_items, places, "item_a", "item_b", "n_a"), able, n_items, places, "item_b", "item_a", "n_b")
        .withColumn("n", F.lit(n).cast("long"))
        .withColumn("lift", F.col("n_ab") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b")))
        .filter((F.col("n_ab") >= F.lit(least)) & (F.col("n_ab") * F.col("n") >= F.lit(float(min_lift)) * F.col("n_a") * F.col("n_b")))
    )
    out = counted.select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", "lift", log_likelihood().alias("llr"))
    return out.filter((F.col("llr") >= min_llr) & (F.col("lift") > 1)) if min_llr > 0 else out


def _with_count(pairs: DataFrame, items: DataFrame, n_items: int, places: int, key: str, other: str, out: str) -> DataFrame:
    """Add the count of one item of each pair. The table of items is broadcast if it is small; else hot items are salted by the other item."""
    counts = items.select(F.col("item").alias(key), F.col("n_x").alias(out))
    if n_items * 24 <= BROADCAST_BYTES:
        return pairs.join(broadcast_if_small(counts, n_items, 24), key)
    hot = F.broadcast(items.filter(F.col("n_x") >= places * HOT_SHARE).select(F.col("item").alias(key), F.lit(SALTS).alias("_salts")))  # at most 1 / HOT_SHARE rows
    salts = F.coalesce("_salts", F.lit(1))
    left = pairs.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(other), salts).cast("int")).drop("_salts")
    right = counts.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return left.join(right, [key, "_salt"]).drop("_salt")


def log_likelihood():
    """Twice the log of how much likelier dependence makes the table of n_ab, n_a, n_b and n; 0 for independence."""

    def xlogx(c):
        return F.when(c > 0, c * F.ln(c.cast("double"))).otherwise(F.lit(0.0))

    ab, a, b, n = F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n")
    cells = xlogx(ab) + xlogx(a - ab) + xlogx(b - ab) + xlogx(n - a - b + ab)
    margins = xlogx(a) + xlogx(n - a) + xlogx(b) + xlogx(n - b)
    return F.greatest(F.lit(0.0), 2 * (cells + xlogx(n) - margins))
