"""Vector quantization: nearest codes, mini-batch k-means, residual quantization.

Codebooks are tables of at most levels x codes rows whatever the data's size, so they are collected
and shipped with the Arrow functions; vectors stay distributed. Every argmin takes the lowest code on ties.
Null vectors, those of another length and those with an element that is null or not finite are
unusable: they get no code and move no centre.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.vector import finite, l2sq, vsub

CODEBOOK_SCHEMA = "level int, code int, vec array<double>"


def codebook_arrays(codebook: DataFrame) -> list[np.ndarray]:
    """A (codes, dimensions) array per level; codes have to be 0, 1, 2, ... in each level."""
    rows = codebook.select("level", "code", F.col("vec").cast("array<double>").alias("vec")).orderBy("level", "code").collect()
    levels: dict[int, list] = {}
    for r in rows:
        if r.code != len(levels.setdefault(r.level, [])):
            raise ValueError(f"level {r.level}: code {len(levels[r.level])} is missing")
        levels[r.level].append(r.vec)
    return [np.array(levels[k]) for k in sorted(levels)]


def codebook_table(spark: SparkSession, levels: Sequence[np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(i, k, v.tolist()) for i, c in enumerate(levels) for k, v in enumerate(c)], CODEBOOK_SCHEMA)


def nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Lowest code of smallest squared distance."""
    return np.argmin((codes**2).sum(1)[None, :] - 2 * x @ codes.T, axis=1)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), d)


def usable_rows(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a list column are vectors of ``d`` finite numbers, and those as a matrix."""
    fits = np.asarray(column.value_lengths().fill_null(-1)) == d
    x = _matrix(column.filter(pa.array(fits)), d)
    good = np.isfinite(x).all(1)
    fits[np.flatnonzero(fits)[~good]] = False
    return fits, x[good]


def code_lists(ok: np.ndarray, codes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column with a row of ``codes`` for each true place of ``ok`` and nulls elsewhere."""
    offsets = np.concatenate([[0], np.cumsum(ok * codes.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(codes).ravel(), kind), mask=pa.array(~ok))


def find_nearest(df: DataFrame, vector: str, codes: np.ndarray, out: str = "code") -> DataFrame:
    """Add the nearest code of each vector; rows with an unusable vector get null."""
    return encode(df, vector, [codes], out).withColumn(out, F.get(out, F.lit(0)))


def assign(df: DataFrame, vector: str, codebook: DataFrame, out: str = "code", most: int = 1_024) -> DataFrame:
    """The nearest code of a one-level codebook (level, code, vec) by the cheaper plan: up to ``most`` numbers in
    the codebook as one expression without Python, else as matrix products in Arrow batches. Both give the same codes."""
    book = codebook_arrays(codebook)[0]
    return find_nearest_sql(df, vector, codebook, out) if book.size <= most else find_nearest(df, vector, book, out)


def top_dot(df: DataFrame, vector: str, codes: np.ndarray, k: int, out: str = "top") -> DataFrame:
    """Add the k codes of largest dot product as array<struct<code, score>>, ties to the lower code; null for unusable vectors."""
    d, k = codes.shape[1], min(k, len(codes))

    @F.arrow_udf("array<struct<code:int,score:double>>")
    def best(column: pa.Array) -> pa.Array:
        ok, x = usable_rows(column, d)
        score = x @ codes.T
        order = np.argsort(-score, axis=1, kind="stable")[:, :k]
        flat = pa.StructArray.from_arrays([pa.array(order.ravel().astype(np.int32)), pa.array(np.take_along_axis(score, order, 1).ravel())], names=["code", "score"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(ok * k)]).astype(np.int32)), flat, mask=pa.array(~ok))

    return df.withColumn(out, best(F.col(vector).cast("array<double>")))


def find_nearest_sql(df: DataFrame, vector: str, codebook: DataFrame, out: str = "code") -> DataFrame:
    """The same as one expression over a one-row codebook; the plain baseline for small codebooks."""
    packed = codebook.agg(F.array_sort(F.collect_list(F.struct("code", "vec"))).alias("_cb"))
    best = F.array_min(F.transform("_cb", lambda c: F.struct(l2sq(F.col(vector), c["vec"]).alias("d"), c["code"].alias("code"))))["code"]
    fits = (F.size(vector) == F.size(F.col("_cb")[0]["vec"])) & finite(vector)
    return df.crossJoin(F.broadcast(packed)).withColumn(out, F.when(fits, best)).drop("_cb")


def encode(df: DataFrame, vector: str, levels: Sequence[np.ndarray], out: str = "codes") -> DataFrame:
    """Add residual codes (array<int>, one a level) of each vector; null for unusable vectors."""
    d = levels[0].shape[1]

    @F.arrow_udf("array<int>")
    def residual_codes(column: pa.Array) -> pa.Array:
        ok, r = usable_rows(column, d)
        found = np.zeros((len(r), len(levels)), dtype=np.int32)
        for k, c in enumerate(levels):
            found[:, k] = nearest(r, c)
            r = r - c[found[:, k]]
        return code_lists(ok, found, pa.int32())

    return df.withColumn(out, residual_codes(F.col(vector).cast("array<double>")))


def decode(df: DataFrame, codes: str, codebook: DataFrame, out: str = "vec") -> DataFrame:
    """Add the sum of the codebook vectors of each code tuple; null if a code is null, negative or unknown.

    The codebook (levels x codes rows) comes to each row as one array a level, read by index.
    """
    book = codebook.filter("level >= 0 and code >= 0").select(F.col("level").cast("int").alias("level"), F.col("code").cast("int").alias("code"), F.col("vec").cast("array<double>").alias("vec"))
    dense = lambda known, most: F.transform(F.sequence(F.lit(0), most), lambda c: F.try_element_at(known, c))
    level = book.groupBy("level").agg(F.map_from_entries(F.collect_list(F.struct("code", "vec"))).alias("m"), F.max("code").alias("most")).select("level", dense(F.col("m"), F.col("most")).alias("a"))
    packed = level.agg(F.map_from_entries(F.collect_list(F.struct("level", "a"))).alias("m"), F.coalesce(F.max("level"), F.lit(0)).alias("most")).select(dense(F.col("m"), F.col("most")).alias("_cb"))
    found = F.transform(codes, lambda c, i: F.get(F.get(F.col("_cb"), i), c))
    total = F.aggregate(F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), F.get(found, F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    known = F.forall(found, lambda v: v.isNotNull())
    return df.crossJoin(F.broadcast(packed)).withColumn(out, F.when((F.size(codes) > 0) & known, total)).drop("_cb")  # the right side is one row


def quantize(df: DataFrame, vector: str, codebook: DataFrame, level: int = 0) -> DataFrame:
    """Add ``code``, ``quantized`` (its vector) and ``residual`` (what is left over); null for unusable vectors."""
    own = codebook.filter(F.col("level") == level).select(F.lit(0).alias("level"), "code", "vec")
    coded = find_nearest(df, vector, codebook_arrays(own)[0])
    out = decode(coded.withColumn("_c", F.when(F.col("code").isNotNull(), F.array("code"))), "_c", own, "quantized").drop("_c")
    return out.withColumn("residual", vsub(vector, "quantized"))


def overwrite_codes(codebook: DataFrame, new: DataFrame) -> DataFrame:
    """The codebook (level, code, vec) with the vectors of ``new`` (level, code, vec) in place of its own; unknown codes of ``new`` are left out, a repeated one is an error of the caller."""
    fresh = new.select("level", "code", F.col("vec").cast("array<double>").alias("_new"))
    return codebook.join(fresh, ["level", "code"], "left").select("level", "code", F.coalesce("_new", F.col("vec").cast("array<double>")).alias("vec"))


def restart_dead(codebook: DataFrame, idle: DataFrame, batch: DataFrame, vector: str, order: str, after: int = 20) -> DataFrame:
    """(level, code, vec, idle): codes idle for ``after`` steps or more start again at rows of the batch.

    ``idle``: (level, code, idle). The i-th dead code takes the i-th usable row in order of ``order``, from
    the beginning again if there are fewer rows; ``order`` decides, so a hash gives a seeded random choice.
    """
    known = codebook.join(idle, ["level", "code"]).select("level", "code", F.col("vec").cast("array<double>").alias("vec"), "idle")
    dead = known.filter(F.col("idle") >= after)
    k = dead.count()  # a codebook has levels x codes rows
    rows = batch.filter(F.col(vector).isNotNull() & finite(vector)).orderBy(order).select(F.col(order).alias("_o"), F.col(vector).cast("array<double>").alias("_new")).limit(k)
    rows = rows.withColumn("_i", F.row_number().over(Window.orderBy("_o")) - 1)  # no more rows than codes
    n = rows.count()
    if not n:
        return known
    place = dead.withColumn("_i", (F.row_number().over(Window.orderBy("level", "code")) - 1) % n).join(rows, "_i").select("level", "code", "_new")
    return known.join(place, ["level", "code"], "left").select("level", "code", F.coalesce("_new", "vec").alias("vec"), F.when(F.col("_new").isNotNull(), 0).otherwise(F.col("idle")).alias("idle"))


def partial_sums(df: DataFrame, vector: str, levels: Sequence[np.ndarray], level: int) -> DataFrame:
    """(code, n, total): count and vector sum of the residuals of ``level`` for each code that occurs.

    Partial sums leave each task once, so at most tasks x codes rows are shuffled.
    """
    d = levels[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(levels[level]), np.zeros(len(levels[level]), dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            r = _matrix(batch.column(0), d)
            for c in levels[:level]:
                r = r - c[nearest(r, c)]
            code = nearest(r, levels[level])
            np.add.at(total, code, r)
            count += np.bincount(code, minlength=len(count))
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(count[seen]), pa.array(total[seen].tolist(), pa.list_(pa.float64()))], names=["code", "n", "total"])

    usable = df.filter((F.size(vector) == d) & finite(vector)).select(F.col(vector).cast("array<double>").alias("v"))
    parts = usable.mapInArrow(sums, "code int, n long, total array<double>")
    return parts.groupBy("code").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(d)]).alias("total"))


def kmeans_plus_plus(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Seeds by squared distance; with fewer points than k the rest repeats random points."""
    rng = np.random.default_rng(seed)
    if not len(x):
        raise ValueError("no vectors to seed from")
    chosen = [int(rng.integers(len(x)))]
    best = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        p = best / best.sum() if best.sum() > 0 else np.full(len(x), 1 / len(x))
        chosen.append(int(rng.choice(len(x), p=p)))
        best = np.minimum(best, ((x - x[chosen[-1]]) ** 2).sum(1))
    chosen += [int(i) for i in rng.integers(len(x), size=k - len(chosen))]
    return x[chosen].copy()


def running_mean(codes: np.ndarray, counts: np.ndarray, n: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and counts after a batch; codes without members keep their centre."""
    new = counts + n
    active = n > 0
    out = codes.copy()
    out[active] = (codes[active] * counts[active, None] + total[active]) / new[active, None]
    return out, new


def ema_update(size: np.ndarray, total: np.ndarray, codes: np.ndarray, n: np.ndarray, batch: np.ndarray, decay: float = 0.99) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponential moving averages of size and sum for the codes of a batch; others stay."""
    active = n > 0
    size, total, codes = size.copy(), total.copy(), codes.copy()
    size[active] = decay * size[active] + (1 - decay) * n[active]
    total[active] = decay * total[active] + (1 - decay) * batch[active]
    codes[active] = total[active] / np.maximum(size[active], 1e-5)[:, None]
    return size, total, codes


@dataclass
class ResidualKMeans:
    """Residual k-means: each level quantizes what the levels before it left over.

    ``fit_step`` sees a batch as a distributed table: the first one seeds each level from at most
    ``seed_rows`` of its rows, and every one, the first too, moves the centres to running means.
    Level l + 1 is fit on residuals of the centres just updated.
    """

    levels: int = 3
    codes: int = 256
    seed: int = 0
    seed_rows: int = 16_384
    books: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)

    def fit_step(self, batch: DataFrame, vector: str = "embedding") -> ResidualKMeans:
        usable = batch.filter(F.col(vector).isNotNull() & finite(vector)).select(F.col(vector).cast("array<double>").alias("v"))
        first = not self.books
        if first:
            seeds = usable.orderBy(F.xxhash64(F.lit(self.seed), "v"), "v").limit(self.seed_rows).collect()  # a bounded sample, for seeding only
            if not seeds:
                raise ValueError("an empty batch")
            lengths = [len(r.v) for r in seeds]
            d = max(set(lengths), key=lambda n: (lengths.count(n), n))  # vectors of another length are left out
            left = np.array([r.v for r in seeds if len(r.v) == d])
        for k in range(self.levels):
            if first:
                self.books.append(kmeans_plus_plus(left, self.codes, self.seed + k))
                self.counts.append(np.zeros(self.codes, dtype=np.int64))
            n, total = np.zeros(self.codes, dtype=np.int64), np.zeros_like(self.books[k])
            for r in partial_sums(usable, "v", self.books[: k + 1], k).collect():  # one row a code
                n[r.code], total[r.code] = r.n, r.total
            if not n.sum():
                raise ValueError("an empty batch")
            self.books[k], self.counts[k] = running_mean(self.books[k], self.counts[k], n, total)
            if first:
                left = left - self.books[k][nearest(left, self.books[k])]
        return self

    def fit(self, df: DataFrame, vector: str = "embedding", epochs: int = 3) -> ResidualKMeans:
        for _ in range(epochs):
            self.fit_step(df, vector)
        return self

    def _fitted(self) -> None:
        if not self.books:
            raise RuntimeError("fit first")

    def transform(self, df: DataFrame, vector: str = "embedding", out: str = "codes") -> DataFrame:
        """Works on streaming tables as well."""
        self._fitted()
        return encode(df, vector, self.books, out)

    def inverse_transform(self, df: DataFrame, codes: str = "codes", out: str = "vec") -> DataFrame:
        self._fitted()
        return decode(df, codes, codebook_table(df.sparkSession, self.books), out)

    def save(self, spark: SparkSession, path: str) -> None:
        self._fitted()
        codebook_table(spark, self.books).write.mode("overwrite").parquet(f"{path}/codebook")
        params = {k: v for k, v in asdict(self).items() if k not in ("books", "counts")} | {"counts": [c.tolist() for c in self.counts]}
        spark.createDataFrame([(json.dumps(params),)], "params string").write.mode("overwrite").json(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ResidualKMeans:
        params = json.loads(spark.read.schema("params string").json(f"{path}/params").first().params)
        counts = [np.array(c) for c in params.pop("counts")]
        return cls(**params, books=codebook_arrays(spark.read.parquet(f"{path}/codebook")), counts=counts)


def fit_batches(model: ResidualKMeans, batches: Sequence[DataFrame], vector: str = "embedding", on_step: Callable[[int, ResidualKMeans], None] | None = None) -> ResidualKMeans:
    """Ordered mini-batches, with a hook after each."""
    for i, batch in enumerate(batches):
        model.fit_step(batch, vector)
        if on_step:
            on_step(i, model)
    return model
