"""Filling containers of fixed capacity: first-fit decreasing over a tournament tree, in randomised groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.encode import VOCABULARY, encode_documents
from quantloom.session import stage

#: Tokens of a container.
CAPACITY = 8_192
#: Documents of a randomised group, about: the bound of what one task holds.
GROUP_ROWS = 8_192


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, numbered from 0; ties go in the given order. No size may exceed ``capacity``.

    A complete binary tree holds in each node the largest free space below it, so the first
    container that an item fits is found in log2(n) comparisons.
    """
    n = len(sizes)
    where = np.zeros(n, dtype=np.int64)
    if not n:
        return where
    if sizes.max() > capacity:
        raise ValueError("an item is larger than a container")
    leaves = 1 << max(1, (n - 1).bit_length())
    free = [capacity] * (2 * leaves)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node <<= 1
            if free[node] < size:
                node += 1
        where[i] = node - leaves
        free[node] -= size
        node >>= 1
        while node:
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
            node >>= 1
    return where


def pack_sizes(sizes: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, seed: int = 42) -> DataFrame:
    """Assign (doc_id, n_tokens) rows to containers.

    Columns: ``doc_id``, ``part`` (from 0), ``n_parts``, ``first_token`` (from 0), ``n_tokens`` of
    the part, ``container_id``. A document over ``capacity`` fills whole containers of its own; its
    rest is packed with the others. No other document is divided. Documents without tokens (null and
    empty texts) take no container: one row with ``container_id`` null. Null sizes count as 0. Null or
    repeated ids are packed as separate rows. Containers of different groups never share an id.
    Groups are drawn by a hash of id, size and the row's place in the staged table, so neither sorted
    ids nor copies crowd a group.
    """
    if capacity < 1 or group_rows < 1:
        raise ValueError("capacity and group_rows must be positive")
    rows = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens"))
    rows = stage(rows)
    n = rows.filter("n_tokens > 0").count()
    groups = max(1, -(-n // group_rows))
    # The rows are read from a table already written, so their places do not change if a task is run again.
    grouped = rows.withColumn("_salt", F.monotonically_increasing_id()).filter("n_tokens > 0").withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "n_tokens", "_salt"), F.lit(groups)).cast("long")).drop("_salt")

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("n_tokens", "ascending")])
        size = table.column("n_tokens").to_numpy()
        ids = table.column("doc_id").combine_chunks()
        full, rest = size // capacity, size % capacity
        exact = (rest == 0).astype(np.int64)  # a document that fills its containers has no rest
        parts = full + 1 - exact
        row = np.repeat(np.arange(len(size)), parts)
        part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        length = np.where(part < full[row], capacity, rest[row])
        place = np.full(len(row), -1, dtype=np.int64)
        open_ = np.flatnonzero(length < capacity)
        place[open_] = first_fit_decreasing(length[open_], capacity)
        used = int(place.max()) + 1 if len(open_) else 0
        whole = np.flatnonzero(length == capacity)
        place[whole] = used + np.arange(len(whole))
        return pa.table(
            {
                "doc_id": ids.take(pa.array(row)),
                "part": pa.array(part, pa.int64()),
                "n_parts": pa.array(parts[row], pa.int64()),
                "first_token": pa.array(part * capacity, pa.int64()),
                "n_tokens": pa.array(length, pa.int64()),
                "container_id": pa.array((key[0].as_py() << 32) + place, pa.int64()),
            }
        )

    packed = grouped.groupBy("grp").applyInArrow(pack, "doc_id long, part long, n_parts long, first_token long, n_tokens long, container_id long")
    none = rows.filter("n_tokens = 0").select("doc_id", F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("n_parts"), F.lit(0).cast("long").alias("first_token"), "n_tokens", F.lit(None).cast("long").alias("container_id"))
    return packed.unionByName(none)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, vocabulary: str = VOCABULARY, seed: int = 42) -> DataFrame:
    """``pack_sizes`` of documents measured in tokens of a public vocabulary; whole texts are counted."""
    return pack_sizes(encode_documents(docs, id_col, text_col, vocabulary, counts_only=True), capacity, group_rows, seed)
