"""Similarity clusters by bisecting k-means.

1. The upper tree: the nodes of largest dispersion are bisected together, pass by pass over the whole
   table; only sums of the nodes of a pass reach the driver. A node that is compact (all members within
   half the limit angle of one point, so any two are similar) is a leaf at any size; copies and
   near-copies that make up a large part of the table are never gathered.
2. Nodes of a bounded size are bisected further inside one task each, down to compact leaves. A cut can
   run through a group, so the leaves of a node are mended: their centres are bisected again from other
   starts, and leaves that are each other's nearest and compact together become one.
3. Groups cut by the upper tree: the leaves are bisected as a forest of further trees with other starts.
   Leaves that meet at the bottom of a tree are compared by centre and radius; pairs that this does not
   decide are compared member by member. A cluster is complete if all its members see the same neighbours.

The cost of every step is linear in the number of items, times the depth of the trees. No pair of
leaves is compared that no tree put together; the README gives the recall.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.session import broadcast_if_small, stage

#: Length of a vector and cosine of similar items.
DIMENSIONS, SIMILARITY = 64, 0.82
#: Items of a node that is bisected inside one task.
NODE_ITEMS = 8_192
#: Nodes that are bisected in one pass over the table; bounds the driver's state and what a task is sent.
PASS_NODES = 2_048
#: Reassignments of a bisection inside a task.
ROUNDS = 2
#: Trees of the forest of leaves, and leaves of a node in which all are compared.
TREES, MEET_LEAVES = 12, 512
#: Rounds of mending inside a task, and leaves of a node of a round.
MEND_ROUNDS, MEND_LEAVES = 4, 256
#: Members of an undecided leaf in a block of the comparison.
BLOCK_ITEMS = 2_048
#: Slack of angles in radians: of double numbers, and of centres kept in half precision.
SLACK, HALF_SLACK = 1e-6, 4e-3

_ITEM = "item_id long, h long, vec array<float>"
#: Set in the ids of leaves whose members lie in many tasks.
_WIDE = 1 << 31


def unit_vectors(items: DataFrame, item: str = "item_id", vector: str = "embedding", moment: str = "loaded_at", dimensions: int = DIMENSIONS) -> DataFrame:
    """(item_id, h, vec): one vector for each item, and a hash of the item.

    Only vectors of ``dimensions`` finite numbers that are not all zero count; of an item's usable
    rows the latest wins, ties by content. Rows without an item or a usable vector are left out.
    Vectors stay in single precision, as stored; unit length is taken in double precision wherever they are used.
    """
    usable = (F.size(vector) == dimensions) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    rows = items.filter(F.col(item).isNotNull() & F.col(vector).isNotNull()).filter(usable)
    vec = F.col(vector)
    if items.schema[vector].dataType.elementType.typeName() != "float":
        top = F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))  # no overflow or underflow
        vec = F.transform(F.arrays_zip(vec.alias("x"), F.array_repeat(top, dimensions).alias("t")), lambda z: (z["x"].cast("double") / z["t"]).cast("float"))
    best = rows.groupBy(F.col(item).cast("long").alias("item_id")).agg(F.max(F.struct(F.col(moment).alias("at"), vec.alias("vec"))).alias("b"))
    return best.select("item_id", F.xxhash64("item_id").alias("h"), F.col("b.vec").alias("vec"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _vectors(column: pa.Array, d: int) -> np.ndarray:
    return _unit(_matrix(column, d).astype(np.float64))


def _list(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(n > 0, n, 1.0)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _start(node: int, centre: np.ndarray, seed: int) -> np.ndarray:
    """A random direction at right angles to the centre: the hyperplane runs through the middle of the node."""
    a = np.random.default_rng([seed, node]).normal(size=len(centre))
    return _unit(a - (a @ centre) * centre)


# --- The upper tree ---------------------------------------------------------------------------------------


@dataclass
class _Splits:
    """The splits since items were last written with their nodes: sorted node ids, first children, axes."""

    ids: list[int] = field(default_factory=list)
    child: list[int] = field(default_factory=list)
    axis: list[np.ndarray] = field(default_factory=list)

    def add(self, node: int, child: int, axis: np.ndarray) -> None:
        self.ids.append(node)
        self.child.append(child)
        self.axis.append(axis)

    def arrays(self, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(self.ids)
        return np.array(self.ids, dtype=np.int64)[order], np.array(self.child, dtype=np.int64)[order], np.array(self.axis).reshape(-1, d)[order]


def _route(x: np.ndarray, node: np.ndarray, splits: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The node that each vector comes to from the node it is in."""
    ids, child, axis = splits
    node, open_ = node.copy(), np.arange(len(x))
    while len(ids) and len(open_):
        k = np.minimum(np.searchsorted(ids, node[open_]), len(ids) - 1)
        inner = ids[k] == node[open_]
        open_, k = open_[inner], k[inner]
        node[open_] = child[k] + (np.einsum("ij,ij->i", x[open_], axis[k]) > 0)
    return node


def _pass(rows: DataFrame, trees: int, splits: tuple, trial: dict[int, np.ndarray], centres: dict[int, np.ndarray], d: int) -> dict[tuple[int, int], tuple[int, np.ndarray, float]]:
    """Per node and side of its trial axis: members, their sum, and the lowest cosine to the side's centre (given by ``centres`` of 2 * place + side).

    Sums leave each task once and are added up in the tasks of a second stage, in a fixed order; at most
    two rows for each of PASS_NODES nodes reach the driver. Tables without nodes begin at the roots of ``trees`` trees.
    """
    ids = np.array(sorted(trial), dtype=np.int64)
    axis = np.array([trial[int(k)] for k in ids]).reshape(-1, d)
    middle = np.array([centres.get((int(k), s), np.zeros(d)) for k in ids for s in (0, 1)]).reshape(-1, d) if centres else None
    has_node = "node" in rows.columns

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, total, low = np.zeros(2 * len(ids), dtype=np.int64), np.zeros((2 * len(ids), d)), np.full(2 * len(ids), 2.0)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _vectors(batch.column(0), d)
            for t in range(1 if has_node else trees):
                node = batch.column(1).to_numpy() if has_node else np.full(len(x), t, dtype=np.int64)
                node = _route(x, node, splits)
                k = np.minimum(np.searchsorted(ids, node), len(ids) - 1)
                mine = np.flatnonzero(ids[k] == node)
                k = k[mine]
                place = 2 * k + (np.einsum("ij,ij->i", x[mine], axis[k]) > 0)
                order = np.argsort(place, kind="stable")
                place, part = place[order], x[mine[order]]
                first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(place) else np.zeros(0, dtype=np.int64)
                at = place[first]
                n[at] += np.diff(np.append(first, len(place)))
                if len(first):
                    total[at] += np.add.reduceat(part, first, axis=0)
                    if middle is not None:
                        low[at] = np.minimum(low[at], np.minimum.reduceat(np.einsum("ij,ij->i", part, middle[place]), first))
        seen = np.flatnonzero(n)
        if len(seen):
            task = np.full(len(seen), TaskContext.get().partitionId(), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(task), pa.array(n[seen]), pa.array(low[seen]), _list(total[seen])], names=["place", "task", "n", "low", "total"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([("place", "ascending"), ("task", "ascending")]).combine_chunks()
        place = table.column("place").to_numpy()
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        total = np.add.reduceat(_matrix(table.column("total").combine_chunks(), d), first, axis=0)
        n, low = np.add.reduceat(table.column("n").to_numpy(), first), np.minimum.reduceat(table.column("low").to_numpy(), first)
        yield pa.RecordBatch.from_arrays([pa.array(place[first]), pa.array(n), pa.array(low), _list(total)], names=["place", "n", "low", "total"])

    sums = rows.select("vec", *(["node"] if has_node else [])).mapInArrow(partial, "place long, task int, n long, low double, total array<double>")
    merged = sums.repartition("place").mapInArrow(added, "place long, n long, low double, total array<double>")
    return {(int(ids[r.place // 2]), r.place % 2): (r.n, np.array(r.total), r.low) for r in merged.collect()}


def grow(rows: DataFrame, keys: Sequence[str], compact: float, node_items: int, d: int, trees: int = 1, seed: int = 0, pass_nodes: int | None = None) -> DataFrame:
    """Bisect until every node has at most ``node_items`` rows, or is compact: all rows have a cosine of ``compact`` or more to one point.

    Gives (keys, vec, node, state) with state = 0 in compact nodes and -1 in others, ``trees`` rows for each
    row of ``rows`` (keys, vec). Nodes of largest dispersion come first. If more than ``pass_nodes`` nodes
    are open, the rows are written with their nodes in parts, and each part goes on alone and reads its own rows only.
    """
    pass_nodes = pass_nodes or PASS_NODES
    number = trees
    schema = f"{', '.join(f'{k} {rows.schema[k].dataType.simpleString()}' for k in keys)}, vec array<float>, node long, state long"
    finished: list[DataFrame] = []
    # A part: its rows, and its open nodes with members and centre (unknown at first).
    parts: list[tuple[DataFrame, dict[int, tuple[int, np.ndarray | None]]]] = [(rows.select(*keys, "vec"), {t: (0, None) for t in range(trees)})]
    while parts:
        table, open_ = parts.pop()
        splits, state = _Splits(), {}
        while open_ and len(open_) <= pass_nodes:
            known = splits.arrays(d)
            unknown = {k: np.zeros(d) for k, (_, c) in open_.items() if c is None}
            if unknown:  # all members of a node are on one side of a zero axis: gives the centres
                found = _pass(table, trees, known, unknown, {}, d)
                for k in unknown:
                    n, total, _ = found.get((k, 0), (0, np.zeros(d), 0.0))
                    open_[k] = (n, _unit(total))
                for k in [k for k, (n, _) in open_.items() if n <= node_items]:
                    state[k] = -1
                    del open_[k]
                if not open_:
                    break
            axes = {k: _start(k, c, seed) for k, (_, c) in open_.items()}
            sides = first = _pass(table, trees, known, axes, {}, d)
            good = {k: _unit(_unit(first[k, 1][1]) - _unit(first[k, 0][1])) if (k, 0) in first and (k, 1) in first else axes[k] for k in open_}
            middles = {(k, s): _unit(v[1]) for (k, s), v in first.items()}
            sides = _pass(table, trees, known, good, middles, d)
            grown: dict[int, tuple[int, np.ndarray]] = {}
            dispersion: dict[int, float] = {}
            for k in open_:
                axis, both = good[k], sides
                if (k, 0) not in sides or (k, 1) not in sides:  # the refined axis parts nothing, perhaps the first one does
                    axis, both = axes[k], first
                if (k, 0) not in both or (k, 1) not in both:
                    state[k] = 0 if compact <= 1 else -1  # equal up to rounding: nothing can part them
                    continue
                splits.add(k, number, axis)
                for s in (0, 1):
                    n, total, low = both[k, s]
                    if n <= node_items:
                        state[number + s] = -1
                    elif both is sides and low >= compact:
                        state[number + s] = 0
                    else:
                        grown[number + s] = (n, _unit(total))
                        dispersion[number + s] = n - float(total @ total) / n
                number += 2
            open_ = {k: grown[k] for k in sorted(grown, key=lambda k: (-dispersion[k], k))}
        known = splits.arrays(d)
        chunk = max(1, pass_nodes // 8)
        order = list(open_)
        flag = {**state, **{k: 1 + i // chunk for i, k in enumerate(order)}}  # 1, 2, ...: parts that go on
        ids = np.array(sorted(flag), dtype=np.int64)
        flags = np.array([flag[int(k)] for k in ids], dtype=np.int64)

        def routed(batches: Iterator[pa.RecordBatch], known=known, ids=ids, flags=flags) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _vectors(batch.column("vec"), d)
                has_node = "node" in batch.schema.names
                for t in range(1 if has_node else trees):
                    node = _route(x, batch.column("node").to_numpy() if has_node else np.full(len(x), t, dtype=np.int64), known)
                    yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("vec"), pa.array(node), pa.array(flags[np.searchsorted(ids, node)])], names=[*keys, "vec", "node", "state"])

        out = table.mapInArrow(routed, schema)
        if not order:
            finished.append(out)
            continue
        written = stage(out, "state")
        finished.append(written.filter("state <= 0"))
        for i in range(-(-len(order) // chunk), 0, -1):
            parts.append((written.filter(F.col("state") == i).drop("state"), {k: open_[k] for k in order[(i - 1) * chunk : i * chunk]}))
    result = finished[0]
    for part in finished[1:]:
        result = result.unionByName(part)
    return result


# --- Inside a task ----------------------------------------------------------------------------------------


def _means(y: np.ndarray, group: np.ndarray, count: int) -> np.ndarray:
    """Unit mean of each group; zero for empty groups."""
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(count))
    present = np.append(starts[1:], len(order)) > starts
    out = np.zeros((count, y.shape[1]))
    if len(order):
        out[present] = np.add.reduceat(y[order], starts[present], axis=0)
    return _unit(out)


def _halves(y: np.ndarray, p: np.ndarray, centre: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Side of each row in the bisection of its part, from the given starting axes; no part is left whole."""
    parts = len(centre)
    for k in range(ROUNDS + 1):
        side = np.einsum("ij,ij->i", y, axis[p]) > 0
        if k < ROUNDS:
            both = _means(y, 2 * p + side, 2 * parts)
            ones, count = np.bincount(p, side, parts), np.bincount(p, minlength=parts)
            good = (ones > 0) & (ones < count)
            axis = np.where(good[:, None], _unit(both[1::2] - both[::2]), axis)
    # A part on one side only (its members are all but equal) is halved by the order of its distances instead.
    count, ones = np.bincount(p, minlength=parts), np.bincount(p, side, parts)
    stuck = ((ones == 0) | (ones == count))[p]
    if stuck.any():
        rows = np.flatnonzero(stuck)
        order = rows[np.lexsort((np.einsum("ij,ij->i", y[rows], centre[p[rows]]), p[rows]))]
        starts = np.searchsorted(p[order], np.arange(parts))
        side[order] = (np.arange(len(order)) - starts[p[order]]) * 2 < count[p[order]]
    return side


def _local_leaves(x: np.ndarray, half: float) -> np.ndarray:
    """Bisect a bounded set of unit vectors until every part is compact; all parts of a level at once. Returns part numbers."""
    part, done = np.zeros(len(x), dtype=np.int64), np.full(len(x), -1, dtype=np.int64)
    open_, finished = np.arange(len(x)), 0
    while len(open_):
        ids, p = np.unique(part[open_], return_inverse=True)
        y = x[open_]
        centre = _means(y, p, len(ids))
        low = np.einsum("ij,ij->i", y, centre[p])
        order = np.lexsort((low, p))
        far = order[np.searchsorted(p[order], np.arange(len(ids)))]
        compact = (low[far] >= half + SLACK) | np.all(np.abs(y[far] - centre) < 1e-12, axis=1)
        ready = compact[p]
        done[open_[ready]] = finished + p[ready]
        finished += len(ids)
        axis = _unit(y[far] - centre)
        open_, y, p = open_[~ready], y[~ready], p[~ready]
        if len(open_):
            part[open_] = 2 * p + _halves(y, p, centre, axis)
    return np.unique(done, return_inverse=True)[1]


def _bottoms(c: np.ndarray, most: int, seed: int) -> np.ndarray:
    """Bisect centres from random starts until no part holds more than ``most``. Returns part numbers."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(c), dtype=np.int64)
    while True:
        ids, part = np.unique(part, return_inverse=True)
        large = np.bincount(part) > most
        open_ = np.flatnonzero(large[part])
        if not len(open_):
            return part
        ids, p = np.unique(part[open_], return_inverse=True)
        centre = _means(c[open_], p, len(ids))
        a = rng.normal(size=(len(ids), c.shape[1]))
        axis = _unit(a - np.einsum("ij,ij->i", a, centre)[:, None] * centre)
        side = _halves(c[open_], p, centre, axis)
        part = 2 * part
        part[open_] += side


def _mend(x: np.ndarray, part: np.ndarray, half: float) -> np.ndarray:
    """Put leaves together again that a cut has parted: pairs that are each other's nearest and compact as one."""
    for k in range(MEND_ROUNDS):
        bottom = None
        while True:
            ids, part = np.unique(part, return_inverse=True)
            c = _means(x, part, len(ids))
            if bottom is None:
                bottom = _bottoms(c, MEND_LEAVES, k)
            else:
                bottom = bottom[ids]
            near, cosine = np.full(len(ids), -1, dtype=np.int64), np.full(len(ids), -2.0)
            order = np.argsort(bottom, kind="stable")
            edges = np.flatnonzero(np.append(True, np.diff(bottom[order]) > 0))
            for a, b in zip(edges, np.append(edges[1:], len(order))):
                rows = order[a:b]
                if len(rows) > 1:
                    g = c[rows] @ c[rows].T
                    np.fill_diagonal(g, -2)
                    best = g.argmax(1)
                    near[rows], cosine[rows] = rows[best], g[np.arange(len(rows)), best]
            i = np.arange(len(ids))
            mutual = np.flatnonzero((near >= 0) & (near[near] == i) & (i < near) & (cosine >= 2 * half**2 - 1))
            if not len(mutual):
                break
            new = i.copy()
            new[near[mutual]] = mutual
            merged = new[part]
            touched = np.zeros(len(ids), dtype=bool)
            touched[mutual] = True
            rows = np.flatnonzero(touched[merged])
            c = _means(x[rows], merged[rows], len(ids))
            low = np.full(len(ids), 2.0)
            np.minimum.at(low, merged[rows], np.einsum("ij,ij->i", x[rows], c[merged[rows]]))
            bad = mutual[low[mutual] < half + SLACK]
            new[near[bad]] = near[bad]
            if len(bad) == len(mutual):
                break
            part = new[part]
    return part


# --- Leaves -----------------------------------------------------------------------------------------------


def assign_leaves(vectors: DataFrame, similarity: float = SIMILARITY, node_items: int | None = None, d: int = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, h, vec, leaf) and leaves (leaf, n, least, hx, low, centre): size, smallest item, combined hash, lowest cosine to the centre."""
    half = float(np.cos(np.arccos(similarity) / 2))
    routed = grow(vectors, ["item_id", "h"], half, node_items or NODE_ITEMS, d)
    extra = "n long, least long, hx long, low double, centre array<float>"
    schema = f"{_ITEM}, leaf long, {extra}"

    def lower(key: tuple, table: pa.Table) -> pa.Table:
        """The leaves of a node; the first row of a leaf carries the leaf's figures."""
        table = table.sort_by("item_id").combine_chunks()
        x = _vectors(table.column("vec").combine_chunks(), d)
        part = _mend(x, _local_leaves(x, half), half)
        order = np.argsort(part, kind="stable")
        table, x, part = table.take(pa.array(order)), x[order], part[order]
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        centre = _unit(np.add.reduceat(x, first, axis=0))
        n = np.diff(np.append(first, len(part)))
        low = np.minimum.reduceat(np.einsum("ij,ij->i", x, np.repeat(centre, n, axis=0)), first)
        place = np.full(len(part), -1, dtype=np.int64)
        place[first] = np.arange(len(first))
        at = pa.array(place, mask=place < 0)
        put = lambda v: pa.array(v).take(at)
        hx = np.bitwise_xor.reduceat(table.column("h").to_numpy(), first)
        leaf = (key[0].as_py() << 32) + part
        return pa.table([*[table.column(c) for c in ("item_id", "h", "vec")], pa.array(leaf), put(n), put(table.column("item_id").to_numpy()[first]), put(hx), put(low), _list(centre.astype(np.float32)).take(at)], names=["item_id", "h", "vec", "leaf", "n", "least", "hx", "low", "centre"])

    small = routed.filter("state < 0").groupBy("node").applyInArrow(lower, schema)
    large = routed.filter("state = 0").select("item_id", "h", "vec", (F.shiftleft("node", 32) + _WIDE).alias("leaf"), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in extra.split(", "))])
    rows = stage(small.unionByName(large))
    items = rows.select("item_id", "h", "vec", "leaf")
    figures = rows.filter("n is not null").select("leaf", "n", "least", "hx", "low", "centre")
    wide = _wide_leaves(items.filter(_is_wide()), d)  # compact nodes of any size, spread over tasks
    return items, stage(figures.unionByName(wide))


def _is_wide():
    return F.col("leaf").bitwiseAND(F.lit(_WIDE)) != 0


def _join_uneven(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """``rows`` joined to one row for each key, which is a staged table. Keys with more than NODE_ITEMS rows are few and go to the rows if small; the others are even."""
    hot = table.filter(F.col(size) > NODE_ITEMS)
    n = hot.count()
    if not n:
        return rows.join(table, key)
    few = broadcast_if_small(hot, n, 1_024)
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(table.filter(F.col(size) <= NODE_ITEMS), key))


def _wide_leaves(items: DataFrame, d: int) -> DataFrame:
    """The same figures of leaves whose members lie in many tasks."""
    sums = stage(_leaf_sums(items, d))

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = np.einsum("ij,ij->i", _vectors(batch.column("vec"), d), _vectors(batch.column("centre"), d))
                yield pa.RecordBatch.from_arrays([batch.column("leaf"), batch.column("item_id"), batch.column("h"), pa.array(c)], names=["leaf", "item_id", "h", "c"])

    low = _join_uneven(items, sums, "leaf", "n").select("leaf", "item_id", "h", "vec", "centre").mapInArrow(cosine, "leaf long, item_id long, h long, c double")
    figures = low.groupBy("leaf").agg(F.count("*").alias("n"), F.min("item_id").alias("least"), F.bit_xor("h").alias("hx"), F.min("c").alias("low"))
    return figures.join(sums.select("leaf", F.col("centre").cast("array<float>").alias("centre")), "leaf").select("leaf", "n", "least", "hx", "low", "centre")


def _leaf_sums(items: DataFrame, d: int, by: str = "leaf") -> DataFrame:
    """(by, n, centre): sums leave each task once per group and 4,096 groups, so a large group is summed up where it lies."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            group, x = batch.column(0).to_numpy(), _vectors(batch.column(1), d)
            order = np.argsort(group, kind="stable")
            group, x = group[order], x[order]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            for k, n, t in zip(group[first].tolist(), np.diff(np.append(first, len(group))).tolist(), np.add.reduceat(x, first, axis=0)):
                old = held.setdefault(k, [0, 0.0])
                old[0] += n
                old[1] = old[1] + t
            if len(held) >= 4_096:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    def out(held: dict[int, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([v[0] for v in held.values()], pa.int64()), _list(np.stack([v[1] for v in held.values()]))], names=[by, "n", "total"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).sort_by([(by, "ascending"), ("n", "ascending")]).combine_chunks()
        group = table.column(by).to_numpy()
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        total = np.add.reduceat(_matrix(table.column("total").combine_chunks(), d), first, axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(group[first]), pa.array(np.add.reduceat(table.column("n").to_numpy(), first)), _list(_unit(total))], names=[by, "n", "centre"])

    sums = items.select(by, "vec").mapInArrow(partial, f"{by} long, n long, total array<double>")
    return sums.repartition(by).mapInArrow(added, f"{by} long, n long, centre array<double>")


def leaf_pairs(leaves: DataFrame, similarity: float = SIMILARITY, d: int = DIMENSIONS, trees: int | None = None, node_items: int | None = None) -> DataFrame:
    """(a, b, similar): pairs a < b of leaves that meet at the bottom of a tree of the forest and may hold similar items.

    ``similar``: every member of one is similar to every member of the other, by the triangle inequality
    of centres and radii; pairs that it rules out are left out.
    """
    theta, trees = float(np.arccos(similarity)), trees or TREES
    rows = leaves.select("leaf", "low", F.col("centre").alias("vec"))
    routed = grow(rows, ["leaf", "low"], 2.0, node_items or NODE_ITEMS, d, trees, seed=1)

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch.column("vec"), d).astype(np.float16)
                raw = pa.Array.from_buffers(pa.binary(2 * d), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("leaf"), batch.column("low"), raw], names=["node", "id", "low", "raw"])

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids, reach = table.column("id").to_numpy(), _angle(table.column("low").to_numpy())
        c = np.frombuffer(b"".join(table.column("raw").to_pylist()), dtype=np.float16).reshape(-1, d).astype(np.float32)
        c /= np.linalg.norm(c, axis=1, keepdims=True)
        bottom = _bottoms(c.astype(np.float64), MEET_LEAVES, 1_000 + key[0].as_py())
        order = np.argsort(bottom, kind="stable")
        edges = np.flatnonzero(np.append(True, np.diff(bottom[order]) > 0))
        left, right, whole = [], [], []
        for a, b in zip(edges, np.append(edges[1:], len(order))):
            rows = np.sort(order[a:b])
            g, r = c[rows] @ c[rows].T, reach[rows]
            u, v = np.nonzero(np.triu(g >= np.cos(np.minimum(np.pi, theta + r + r.max() + HALF_SLACK))[:, None], 1))  # a first look
            angle, both = _angle(g[u, v].astype(np.float64)), r[u] + r[v]
            maybe = angle <= theta + both + HALF_SLACK
            u, v, angle, both = u[maybe], v[maybe], angle[maybe], both[maybe]
            left.append(ids[rows[u]])
            right.append(ids[rows[v]])
            whole.append(angle + both <= theta - HALF_SLACK)
        return pa.table([pa.array(np.concatenate(left)), pa.array(np.concatenate(right)), pa.array(np.concatenate(whole))], names=["a", "b", "similar"])

    packed = routed.mapInArrow(half, "node long, id long, low double, raw binary")
    return packed.groupBy("node").applyInArrow(meet, "a long, b long, similar boolean").groupBy("a", "b").agg(F.max("similar").alias("similar"))


def _member_pairs(items: DataFrame, unsure: DataFrame, similarity: float, d: int) -> DataFrame:
    """(item_id, n1, least1, h1): number, smallest and combined hash of the similar members of the leaves opposite, in blocks of bounded size."""
    ends = unsure.select(F.explode(F.array("a", "b")).alias("leaf")).distinct()
    parts = items.join(ends, "leaf", "left_semi")
    sizes = parts.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(BLOCK_ITEMS)).cast("int").alias("blocks"))
    cut = parts.join(sizes, "leaf").withColumn("k", F.pmod("h", F.col("blocks")).cast("int"))
    # A block holds about BLOCK_ITEMS items.
    cut = stage(cut.groupBy("leaf", "k").agg(F.collect_list(F.struct("item_id", "h", "vec")).alias("m")))
    both = unsure.join(cut.select(F.col("leaf").alias("a"), F.col("m").alias("x")), "a").join(cut.select(F.col("leaf").alias("b"), F.col("m").alias("y")), "b").select("x", "y")
    most = np.iinfo(np.int64).max

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, least, mixed = [], [], [], []
            for r in range(batch.num_rows):
                sides = []
                for c in (0, 1):
                    m = batch.column(c)[r].values
                    sides.append((m.field("item_id").to_numpy(), m.field("h").to_numpy(), _vectors(m.field("vec"), d)))
                (i, hi, x), (j, hj, y) = sides
                near = x @ y.T >= similarity
                for own, other, h, hit in ((i, j, hj, near), (j, i, hi, near.T)):
                    rows = np.flatnonzero(hit.any(1))
                    if len(rows):
                        ids.append(own[rows])
                        counts.append(hit[rows].sum(1))
                        least.append(np.where(hit[rows], other[None, :], most).min(1))
                        mixed.append(np.bitwise_xor.reduce(np.where(hit[rows], h[None, :], 0), axis=1))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (ids, counts, least, mixed)], names=["item_id", "n", "least", "h"])

    links = both.mapInArrow(compare, "item_id long, n long, least long, h long")
    return links.groupBy("item_id").agg(F.sum("n").alias("n1"), F.min("least").alias("least1"), F.bit_xor("h").alias("h1"))


def similarity_clusters(items: DataFrame, similarity: float = SIMILARITY, node_items: int | None = None, dimensions: int = DIMENSIONS, item: str = "item_id", vector: str = "embedding", moment: str = "loaded_at", centred: bool = True, trees: int | None = None) -> DataFrame:
    """(item_id, cluster_id, size, cosine, complete) of every item with a usable vector.

    Items fall into one cluster if their leaves hold similar items only, and cut groups of similar
    items are put together again. ``complete``: all members of the cluster have a cosine of
    ``similarity`` or more with each other and less with every other item that a tree of the forest
    brings near them; ``cluster_id`` is then its smallest item. The members of a leaf whose
    surroundings are not that clear keep the leaf as their cluster, named by its smallest item.
    ``cosine`` is the one to the centre of the item's cluster, whatever leaves it was cut into; it is
    left out, and costs nothing, without ``centred``. Copies of a vector under different items count
    as different members; a single item is a cluster of one. Items without a usable vector (null,
    short, not finite, all zero) are left out; an empty table gives no rows.
    """
    d = dimensions
    vectors = stage(unit_vectors(items, item, vector, moment, d))
    rows, leaves = assign_leaves(vectors, similarity, node_items, d)
    pairs = stage(leaf_pairs(leaves, similarity, d, trees, node_items))
    figures = leaves.select("leaf", "n", "least", "hx")
    # Each leaf's share of its members' neighbourhoods, from pairs of leaves that are decided as a whole.
    sure = pairs.filter("similar")
    sure = sure.select("a", "b").unionByName(sure.select(F.col("b").alias("a"), F.col("a").alias("b")))
    whole = sure.join(figures.withColumnRenamed("leaf", "b"), "b").groupBy("a").agg(F.sum("n").alias("nw"), F.min("least").alias("least_w"), F.bit_xor("hx").alias("hw")).withColumnRenamed("a", "leaf")
    around = stage(figures.join(whole, "leaf", "left"))
    single = _member_pairs(rows, pairs.filter("not similar").select("a", "b"), similarity, d)
    near = _join_uneven(rows.select("item_id", "h", "leaf"), around, "leaf", "n").join(single, "item_id", "left")
    zero = F.lit(0).cast("long")
    near = stage(
        near.select(
            "item_id",
            F.col("h").alias("own"),
            F.col("least").alias("leaf_least"),
            F.col("n").alias("leaf_size"),
            (F.col("n") + F.coalesce("nw", zero) + F.coalesce("n1", zero)).alias("seen"),
            F.least("least", F.coalesce("least_w", "least"), F.coalesce("least1", "least")).alias("first"),
            F.col("hx").bitwiseXOR(F.coalesce("hw", zero)).bitwiseXOR(F.coalesce("h1", zero)).alias("mix"),
        )
    )
    # A group is complete if all of those that share a smallest neighbour see the same neighbours, and are as many as they see.
    groups = near.groupBy("first").agg(F.count("*").alias("members"), F.min("seen").alias("lo"), F.max("seen").alias("hi"), F.min("mix").alias("s0"), F.max("mix").alias("s1"), F.bit_xor("own").alias("s2"))
    groups = stage(groups.select("first", "members", ((F.col("members") == F.col("lo")) & (F.col("lo") == F.col("hi")) & (F.col("s0") == F.col("s1")) & (F.col("s0") == F.col("s2"))).alias("complete")))
    # If a member's group is complete so is its leaf's, so the others are whole leaves.
    named = _join_uneven(near, groups, "first", "members").select("item_id", F.when(F.col("complete"), F.col("first")).otherwise(F.col("leaf_least")).alias("cluster_id"), F.when(F.col("complete"), F.col("members")).otherwise(F.col("leaf_size")).alias("size"), "complete")
    return _with_cluster_centres(named, vectors, d) if centred else named


def _with_cluster_centres(named: DataFrame, vectors: DataFrame, d: int) -> DataFrame:
    """Items with the size of their cluster and the cosine to its centre; sums of a cluster leave each task once."""

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c = np.einsum("ij,ij->i", _vectors(batch.column(4), d), _vectors(batch.column(5), d))
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], pa.array(c), batch.column(3)], names=["item_id", "cluster_id", "size", "cosine", "complete"])

    # A complete and another cluster may have the same name, so both are part of the key.
    key = (2 * F.col("cluster_id") + F.col("complete").cast("long")).alias("k")
    rows = stage(named.join(vectors, "item_id").select("item_id", "cluster_id", "size", "complete", key, "vec"))
    joined = _join_uneven(rows, stage(_leaf_sums(rows, d, "k")), "k", "n").select("item_id", "cluster_id", "size", "complete", "vec", "centre")
    return joined.mapInArrow(cosine, "item_id long, cluster_id long, size long, cosine double, complete boolean")


def describe_clusters(clusters: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster_id, complete, size, typical_items): the members nearest to their centres, ties by item_id.

    The order is kept by a bounded window: only ``typical`` rows of a cluster survive in each task.
    """
    from pyspark.sql import Window

    first = Window.partitionBy("cluster_id", "complete").orderBy(F.desc("cosine"), "item_id")
    top = clusters.withColumn("cosine", F.round("cosine", 9)).withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= typical)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_r", "item_id"))), lambda x: x["item_id"])
    return top.groupBy("cluster_id", "complete").agg(F.max("size").alias("size"), listed.alias("typical_items"))
