"""Splitting oversized token and id lists at natural boundaries, with an overlap.

Boundaries are where a turn, sentence, line, item block or session ends. Among the boundaries in the
reach of a piece, lexical cohesion decides: sliding blocks of tokens before and after each boundary
are compared, and the piece ends in the deepest similarity valley.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.session import broadcast_if_small, distributed_rank, stage

#: Limits, overlaps and cohesion blocks of the two kinds of lists.
SAMPLE_LIMIT, SAMPLE_OVERLAP, SAMPLE_BLOCK = 256, 32, 32
HISTORY_LIMIT, HISTORY_OVERLAP, HISTORY_BLOCK = 20, 4, 4
#: Boundaries whose blocks are compared at a time; bounds the memory of a very long list.
CHUNK = 512
#: Special id ranges that the driver reads; a larger table raises an error.
MOST_ROLES = 10_000

_PIECES = "piece int, start int, tokens array<long>"


def cohesion(tokens: np.ndarray, places: np.ndarray, block: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> np.ndarray:
    """Cosine of the token counts of the ``block`` tokens before and behind each place.

    ``low`` and ``high`` bound the record that each place lies in, so many records can be looked at in one
    flat array. Equal tokens are counted place by place in small windows; memory does not grow with a list.
    """
    out = np.zeros(len(places))
    low = np.zeros(len(places), dtype=np.int64) if low is None else low
    high = np.full(len(places), len(tokens), dtype=np.int64) if high is None else high
    step = np.arange(block)
    for k in range(0, len(places), CHUNK):
        at = places[k : k + CHUNK, None]
        i, j = at - 1 - step, at + step
        there, here = i >= low[k : k + CHUNK, None], j < high[k : k + CHUNK, None]
        last = max(len(tokens) - 1, 0)
        # Places outside the record hold numbers that no token has and that differ between the sides.
        left = np.where(there, tokens[np.clip(i, 0, last)], -(10**12)) if len(tokens) else np.full(i.shape, -(10**12))
        right = np.where(here, tokens[np.clip(j, 0, last)], -(10**12) - 1) if len(tokens) else np.full(j.shape, -(10**12) - 1)
        same = lambda a, b: (a[:, :, None] == b[:, None, :]).sum((1, 2))
        norm = np.sqrt(((same(left, left) - (~there).sum(1) ** 2) * (same(right, right) - (~here).sum(1) ** 2)).astype(np.float64))
        out[k : k + CHUNK] = np.where(norm > 0, same(left, right) / np.maximum(norm, 1e-12), 0.0)
    return out


def valley_depths(similarity: np.ndarray) -> np.ndarray:
    """How far each place lies below the peaks that are reached going uphill on either side."""

    def peaks(values: np.ndarray) -> np.ndarray:
        rises = np.flatnonzero(np.append(True, values[1:] > values[:-1]))  # the peak behind is where the descent began
        return values[rises[np.searchsorted(rises, np.arange(len(values)), side="right") - 1]]

    if not len(similarity):
        return similarity
    return peaks(similarity) + peaks(similarity[::-1])[::-1] - 2 * similarity


def split_points(tokens: np.ndarray, ends: np.ndarray, limit: int, overlap: int, block: int, atoms: np.ndarray | None = None, depth: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(start, end) of each piece. ``ends``: sorted positions behind which a natural unit ends.

    A piece ends at the deepest valley among the ends in the second half of its reach, else among all
    ends in its reach that leave room for the overlap (ties: the later one), else at the limit, but not
    inside an item block: ``atoms`` gives, for each position, where the block around it begins.
    ``depth``: the valley depths of the ends, if they are known already.
    """
    n = len(tokens)
    if n <= limit:
        return [(0, n)]
    if depth is None:
        depth = valley_depths(cohesion(tokens, ends, block))
    out, start, done = [], 0, overlap
    while n - start > limit:
        reach = start + limit
        lo, mid, hi = np.searchsorted(ends, [done, start + limit // 2, reach], side="right")
        mid = max(lo, mid)
        if mid == hi:
            mid = lo
        if mid < hi:
            at = depth[mid:hi]
            end = int(ends[mid + len(at) - 1 - int(np.argmax(at[::-1]))])
        else:
            end = reach
            if atoms is not None and done < atoms[reach] < reach:
                end = int(atoms[reach])
        out.append((start, end))
        start, done = end - overlap, end
    out.append((start, n))
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of a list column (nulls as -1), which of them are there, and the offsets of the rows."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = column.flatten()
    return values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), values.is_valid().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _splitter(limit: int, overlap: int, block: int, prepare):
    """Rows (key columns, tokens, extra): ``prepare(tokens, extra)`` gives for each row its tokens, natural ends and atoms."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                records = prepare(part.column(len(names) - 2), part.column(len(names) - 1))
                sizes = np.array([len(t) for t, _, _ in records])
                first = np.cumsum(sizes) - sizes
                tokens = np.concatenate([t for t, _, _ in records])
                n_ends = np.array([len(e) for _, e, _ in records])
                row = np.repeat(np.arange(len(records)), n_ends)
                places = np.concatenate([e for _, e, _ in records]).astype(np.int64) + first[row]
                similar = cohesion(tokens, places, block, first[row], first[row] + sizes[row])
                rows, pieces, starts, lengths, values, at = [], [], [], [], [], 0
                for i, (own, ends, atoms) in enumerate(records):
                    depth = valley_depths(similar[at : at + len(ends)])
                    at += len(ends)
                    for j, (s, e) in enumerate(split_points(own, ends, limit, overlap, block, atoms, depth)):
                        rows.append(i)
                        pieces.append(j)
                        starts.append(s)
                        lengths.append(e - s)
                        values.append(own[s:e])
                take = pa.array(rows, pa.int64())
                offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c).take(take) for c in range(len(names) - 2)], pa.array(pieces, pa.int32()), pa.array(starts, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values).astype(np.int64)))],
                    names=[*names[:-2], "piece", "start", "tokens"],
                )

    return split


def token_ranges(roles: DataFrame) -> dict[str, tuple[int, int]]:
    """The special id ranges: a fixed table of a few rows; a table of more than ``MOST_ROLES`` is refused, not cut."""
    rows = roles.select("token_role", "first_id", "last_id").limit(MOST_ROLES + 1).collect()
    if len(rows) > MOST_ROLES:
        raise ValueError(f"more than {MOST_ROLES} special id ranges")
    return {r.token_role: (r.first_id, r.last_id) for r in rows}


def _sample_ends(ranges: dict[str, tuple[int, int]]):
    pad = ranges["pad"]
    closing = [ranges[r] for r in ("turn_end", "period", "newline", "item_end") if r in ranges]
    opening, item_end = ranges.get("item_start", (-1, -2)), ranges.get("item_end", (-1, -2))
    width = 2 + sum(1 for r in ranges if r.startswith("item_level_"))

    def within(tokens: np.ndarray, bounds: tuple[int, int]) -> np.ndarray:
        return (tokens >= bounds[0]) & (tokens <= bounds[1])

    def one(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        real = np.flatnonzero(~within(tokens, pad))
        tokens = tokens[real[0] : real[-1] + 1] if len(real) else tokens[:0]
        ends = np.zeros(len(tokens) + 1, dtype=bool)
        for bounds in closing:
            ends[1:] |= within(tokens, bounds)
        atoms = np.arange(len(tokens) + 1)
        begin, stops = np.flatnonzero(within(tokens, opening)), np.flatnonzero(within(tokens, item_end))
        if len(begin) and len(stops):
            k = np.searchsorted(stops, begin, side="right")
            stop = np.where(k < len(stops), stops[np.minimum(k, len(stops) - 1)], len(tokens) + width)
            begin, stop = begin[stop < begin + width], stop[stop < begin + width]
            for step in range(width - 1, -1, -1):
                inside = begin + step <= stop
                atoms[begin[inside] + step] = begin[inside]
        return tokens, np.flatnonzero(ends), atoms

    def prepare(lists: pa.Array, _) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        values, _, at = _flat(lists)
        return [one(values[at[i] : at[i + 1]]) for i in range(len(lists))]

    return prepare


def _places(items: list, seen: dict[int, int]) -> np.ndarray:
    """Position among the user's interactions (``seen``: position to item) of each element that is not null.

    A null stands for one interaction or for none, whichever lets more of the elements name the same
    item as their interaction; on ties for one. Between two nulls all elements keep one distance.
    """
    known = np.array([x is not None for x in items], dtype=bool)
    values = np.array([x for x in items if x is not None], dtype=np.int64)
    nulls, at = np.cumsum(~known)[known], np.arange(len(values))
    if not len(values) or not nulls[-1]:
        return at
    there = np.full(len(items) + 1, -1, dtype=np.int64)
    for p, x in seen.items():
        if p < len(items):
            there[p] = x
    starts = np.flatnonzero(np.append(True, nulls[1:] != nulls[:-1]))
    ends = np.append(starts[1:], len(values))
    # best[s]: most matches so far if s of the nulls stand for an interaction; came[j][s]: s of the run before.
    best, came, before = np.zeros(1), [], 0
    for lo, hi in zip(starts, ends):
        count = int(nulls[lo])
        new, source = np.full(count + 1, -1.0), np.zeros(count + 1, dtype=np.int64)
        for more in range(count - before + 1):
            part = slice(more, more + len(best))
            better = best >= new[part]
            new[part] = np.where(better, best, new[part])
            source[part] = np.where(better, np.arange(len(best)), source[part])
        for k in range(count + 1):
            new[k] += (there[lo + k : hi + k] == values[lo:hi]).sum()
        came.append(source)
        best, before = new, count
    shift = len(best) - 1 - int(np.argmax(best[::-1]))
    out = at.copy()
    for lo, hi, source in zip(starts[::-1], ends[::-1], came[::-1]):
        out[lo:hi] += shift
        shift = int(source[shift])
    return out


def _session_ends(values: np.ndarray, known: np.ndarray, pos: np.ndarray, item: np.ndarray, session: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray, None]:
    """A history with its nulls; of its interactions the position, item and session, and whether the session is told."""
    if known.all():
        places = np.arange(len(values))
    else:
        places = _places([v if k else None for v, k in zip(values.tolist(), known)], dict(zip(pos.tolist(), item.tolist())))
    kept = values[known]
    order = np.argsort(pos, kind="stable")
    pos, item, session, told = pos[order], item[order], session[order], told[order]
    k = np.minimum(np.searchsorted(pos, places), max(len(pos) - 1, 0))
    if not len(pos):
        return kept, np.zeros(0, dtype=np.int64), None
    sure = (pos[k] == places) & (item[k] == kept) & told[k]
    change = sure[1:] & sure[:-1] & (session[k][1:] != session[k][:-1])
    return kept, np.flatnonzero(change) + 1, None


def _history_ends(lists: pa.Array, found: pa.Array) -> list[tuple[np.ndarray, np.ndarray, None]]:
    values, known, at = _flat(lists)
    lengths = found.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    edge = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    flat = found.flatten()
    column = lambda name: flat.field(name).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    pos, item, session, told = column("pos"), column("item"), column("session_id"), flat.field("session_id").is_valid().to_numpy(zero_copy_only=False)
    out = []
    for i in range(len(lists)):
        own, there = slice(at[i], at[i + 1]), slice(edge[i], edge[i + 1])
        out.append(_session_ends(values[own], known[own], pos[there], item[there], session[there], told[there]))
    return out


def split_samples(samples: DataFrame, roles: DataFrame, limit: int = SAMPLE_LIMIT, overlap: int = SAMPLE_OVERLAP, block: int = SAMPLE_BLOCK) -> DataFrame:
    """(rec_id, split, piece, start, tokens) of each sample, padding on either side removed.

    A sample within the limit is one piece; a null, empty or all-padding list gives one empty piece.
    Null tokens inside a list become -1. Redelivered rows (same sample_id and split) count once, the
    longest list wins, ties by content. Rows without sample_id have no identity and are left out.
    ``start`` counts from the first token that is not padding.
    """
    _check(limit, overlap)
    rows = _once(samples.filter("sample_id is not null").select(F.col("sample_id").cast("long").alias("rec_id"), "split", F.col("input_ids").cast("array<long>").alias("ids")))
    ranges = token_ranges(roles)
    low, high = ranges["pad"]
    short = F.size(F.coalesce("ids", F.array().cast("array<long>"))) <= limit
    whole = rows.filter(short)
    real = F.transform(F.coalesce("ids", F.array().cast("array<long>")), lambda t: F.coalesce(t, F.lit(-1).cast("long")))
    whole = whole.select("rec_id", "split", F.lit(0).alias("piece"), F.lit(0).alias("start"), real.alias("tokens"))
    is_pad = lambda t: (t >= low) & (t <= high)
    places = F.filter(F.transform("tokens", lambda t, i: F.when(~is_pad(t), i)), lambda i: i.isNotNull())
    whole = whole.withColumn("_at", places).withColumn("tokens", F.when(F.size("_at") == 0, F.array().cast("array<long>")).otherwise(F.slice("tokens", F.coalesce(F.get("_at", F.lit(0)), F.lit(0)) + 1, F.greatest(F.lit(0), F.coalesce(F.array_max("_at") - F.array_min("_at") + 1, F.lit(0)))))).drop("_at")
    cut = rows.filter(~short).select("rec_id", "split", "ids", F.lit(None).cast("int").alias("extra"))
    cut = cut.mapInArrow(_splitter(limit, overlap, block, _sample_ends(ranges)), f"rec_id long, split string, {_PIECES}")
    return whole.unionByName(cut)


def split_history(history: DataFrame, interactions: DataFrame, limit: int = HISTORY_LIMIT, overlap: int = HISTORY_OVERLAP, block: int = HISTORY_BLOCK) -> DataFrame:
    """(rec_id, split, piece, start, tokens) of each history list, without nulls and fillers.

    The sessions of a long list come from the user's interactions in order of ts (and
    interaction_id): the k-th element is the user's k-th valid interaction where both name the same
    item; elsewhere no session end is assumed. Fillers are no elements; a null holds the place of an
    interaction unless more elements agree without it. Redelivered rows (same user_id and split, or
    same interaction_id) count once. Null lists give one empty piece; rows without user_id are left out.
    """
    _check(limit, overlap)
    places = F.filter(F.coalesce("items", F.array().cast("array<long>")), lambda i: i.isNull() | (i >= 0))
    rows = history.filter("user_id is not null").select(F.col("user_id").cast("long").alias("rec_id"), "split", F.filter(places, lambda i: i.isNotNull()).alias("ids"), places.alias("places"))
    rows = _once(rows, "places")
    whole = rows.filter(F.size("ids") <= limit).select("rec_id", "split", F.lit(0).alias("piece"), F.lit(0).alias("start"), F.col("ids").alias("tokens"))
    long = rows.filter(F.size("ids") > limit)
    seen = interactions.filter("user_id is not null and item_id >= 0").select("user_id", "interaction_id", "ts", F.col("item_id").cast("long").alias("item_id"), "session_id")
    seen = seen.join(long.select(F.col("rec_id").alias("user_id")).distinct(), "user_id", "left_semi").dropDuplicates(["user_id", "interaction_id", "ts", "item_id"])
    ranked = distributed_rank(seen, ["user_id"], ["ts", "interaction_id", "item_id"], "pos").select(F.col("user_id").alias("rec_id"), "pos", F.col("item_id").alias("item"), "session_id")
    elements = long.select("rec_id", "split", F.explode(F.sequence(F.lit(0).cast("long"), (F.size("places") - 1).cast("long"))).alias("pos"))
    sessions = elements.join(ranked, ["rec_id", "pos"]).groupBy("rec_id", "split").agg(F.collect_list(F.struct("pos", "item", "session_id")).alias("found"))
    # One list of sessions a record, no longer than the record itself.
    sessions = sessions.select(F.col("rec_id").alias("_rec"), F.col("split").alias("_split"), F.col("found").alias("extra"))
    cut = long.join(sessions, (F.col("rec_id") == F.col("_rec")) & F.col("split").eqNullSafe(F.col("_split")), "left").select("rec_id", "split", "places", "extra")
    cut = cut.mapInArrow(_splitter(limit, overlap, block, _history_ends), f"rec_id long, split string, {_PIECES}")
    return whole.unionByName(cut)


def _check(limit: int, overlap: int) -> None:
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap has to be less than half the limit")


def _once(rows: DataFrame, *more: str) -> DataFrame:
    """One list for each record, with the columns ``more`` of its row: the longest, ties by content.

    Only records that come more than once are compared; a count by key, combined in the mapper,
    finds them, so the lists of the others are neither sorted nor moved.
    """
    repeated = stage(rows.groupBy("rec_id", "split").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("rec_id").alias("_rec"), F.col("split").alias("_split")))
    same = (F.col("rec_id") == F.col("_rec")) & F.col("split").eqNullSafe(F.col("_split"))
    size = repeated.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_split")), F.lit(0))).first()
    repeated = broadcast_if_small(repeated, 1, 64 * size[0] + size[1])
    alone = rows.join(repeated, same, "left_anti")
    best = F.struct(F.size(F.coalesce("ids", F.array().cast("array<long>"))).alias("n"), F.xxhash64("ids").alias("h"), F.col("ids").alias("ids"), *more)
    again = rows.join(repeated, same, "left_semi").withColumn("_best", best).groupBy("rec_id", "split").agg(F.max("_best").alias("_best"))
    return alone.select("rec_id", "split", "ids", *more).unionByName(again.select("rec_id", "split", "_best.ids", *[f"_best.{c}" for c in more]))


def split_records(samples: DataFrame, history: DataFrame, interactions: DataFrame, roles: DataFrame) -> DataFrame:
    """Pieces of both kinds of records: (src, rec_id, split, piece, start, tokens)."""
    a = split_samples(samples, roles).withColumn("src", F.lit("samples"))
    b = split_history(history, interactions).withColumn("src", F.lit("history"))
    return a.unionByName(b).select("src", "rec_id", "split", "piece", "start", "tokens")
