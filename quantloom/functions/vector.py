"""Column functions on arrays: vectors, id lists and mixed-radix codes. All stay in the JVM; nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def doubles(v: ColumnOrName) -> Column:
    """A float array as doubles, before any arithmetic."""
    return _c(v).cast("array<double>")


def finite(v: ColumnOrName) -> Column:
    """Whether every element is a finite number; null for a null array."""
    return F.forall(doubles(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: ColumnOrName, b: ColumnOrName) -> Column:
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2sq(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Squared Euclidean distance."""
    return _total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def vadd(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def vsub(a: ColumnOrName, b: ColumnOrName) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def vscale(a: ColumnOrName, k: ColumnOrName) -> Column:
    return F.transform(doubles(a), lambda x: x * _c(k))


def l2_normalize(v: ColumnOrName, eps: float = 1e-12) -> Column:
    """Unit vector; an all-zero vector stays zero."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(eps))
    return F.transform(doubles(v), lambda x: x / norm)


def last_token_pool(states: ColumnOrName, mask: ColumnOrName) -> Column:
    """State of the last position whose mask is 1, null if there is none."""
    places = F.filter(F.transform(_c(mask), lambda m, i: F.when(m == 1, i + 1)), lambda i: i.isNotNull())
    return F.try_element_at(_c(states), F.coalesce(F.array_max(places), F.lit(2**31 - 1)))


def flat_ids(codes: ColumnOrName, base: ColumnOrName | int) -> Column:
    """Mixed-radix number of a code tuple, first level most significant."""
    radix = F.lit(base) if isinstance(base, int) else _c(base)
    return F.aggregate(_c(codes), F.lit(0).cast("long"), lambda acc, c: acc * radix.cast("long") + c)


def largest_base(codes: ColumnOrName) -> Column:
    """An aggregate: the base of ``flat_ids`` if none is given, the largest code plus one."""
    return F.max(F.array_max(_c(codes))) + 1


def strip_padding(ids: ColumnOrName) -> Column:
    """Without nulls and fillers."""
    return F.filter(_c(ids), lambda i: i.isNotNull() & (i >= 0))


def tail(ids: ColumnOrName, k: int) -> Column:
    """The last k elements; all of a shorter list."""
    a = _c(ids)
    return F.slice(a, F.greatest(F.size(a) - k + 1, F.lit(1)), k)


def pad_right(ids: ColumnOrName, n: ColumnOrName | int, value: int = -1) -> Column:
    a, width = _c(ids), F.lit(n) if isinstance(n, int) else _c(n)
    return F.concat(a, F.array_repeat(F.lit(value).cast("long"), F.greatest(width - F.size(a), F.lit(0)).cast("int")))


def pad_left(ids: ColumnOrName, n: ColumnOrName | int, value: int = -1) -> Column:
    a, width = _c(ids), F.lit(n) if isinstance(n, int) else _c(n)
    return F.concat(F.array_repeat(F.lit(value).cast("long"), F.greatest(width - F.size(a), F.lit(0)).cast("int")), a)


def sid_string(codes: ColumnOrName) -> Column:
    """Text form of an item: start mark, one token a level, end mark."""
    levels = F.transform(_c(codes), lambda c, i: F.format_string("<item_L%d_C%d>", i, c))
    return F.concat(F.lit("<|item_start|>"), F.array_join(levels, ""), F.lit("<|item_end|>"))


def hash_uniform(*parts: ColumnOrName | int) -> Column:
    """A reproducible number in (0, 1) from a hash of the parts."""
    h = F.xxhash64(*[F.lit(p) if isinstance(p, int) else _c(p) for p in parts])
    return (F.pmod(h, F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def gumbel(u: Column) -> Column:
    return -F.ln(-F.ln(u + 1e-10) + 1e-10)
