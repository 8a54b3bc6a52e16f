"""Residual-quantized autoencoder: small dense networks in numpy, trained and applied in Arrow batches.

Training reads every row: in each epoch the tasks start from the same weights, train on mini-batches of
their own rows, and the driver takes the mean of what they return, weighted by rows. Only the first codes
are drawn from a bounded sample (``seed_rows``).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.vector import finite
from quantloom.operators.quantize import code_lists, ema_update, kmeans_plus_plus, nearest, usable_rows


@dataclass
class AutoencoderConfig:
    """``layers``: dense layers of the encoder and of the decoder, two at least. ``learnable``: codes follow
    the gradient of their own loss; else moving averages, with a restart of codes idle for ``restart_after`` steps."""

    input_dim: int = 64
    hidden_dim: int = 64
    latent_dim: int = 16
    levels: int = 3
    codes: int = 64
    layers: int = 2
    beta: float = 0.25
    decay: float = 0.99
    restart_after: int = 20
    learnable: bool = False
    learning_rate: float = 1e-3
    batch: int = 256
    epochs: int = 10
    seed_rows: int = 16_384
    seed: int = 0


class Autoencoder:
    """Encoder and decoder around ``levels`` residual codebooks."""

    def __init__(self, config: AutoencoderConfig) -> None:
        self.config = c = config
        if c.layers < 2:
            raise ValueError("two layers at least")
        rng = np.random.default_rng(c.seed)
        self.w: dict[str, np.ndarray] = {}
        for side, first, last in (("e", c.input_dim, c.latent_dim), ("d", c.latent_dim, c.input_dim)):
            sizes = [first, *[c.hidden_dim] * (c.layers - 1), last]
            for k, (a, b) in enumerate(zip(sizes, sizes[1:])):
                self.w[f"{side}{k}"], self.w[f"b{side}{k}"] = rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)
        self.books: list[np.ndarray] = []
        self.state: dict[str, np.ndarray] = {}
        self.losses: list[float] = []

    def _forward(self, x: np.ndarray, side: str) -> list[np.ndarray]:
        """The input of each layer and the output."""
        out = [x]
        for k in range(self.config.layers):
            y = out[-1] @ self.w[f"{side}{k}"] + self.w[f"b{side}{k}"]
            out.append(np.maximum(y, 0) if k < self.config.layers - 1 else y)
        return out

    def _backward(self, values: list[np.ndarray], d: np.ndarray, side: str, grads: dict[str, np.ndarray]) -> np.ndarray:
        for k in range(self.config.layers - 1, -1, -1):
            grads[f"{side}{k}"], grads[f"b{side}{k}"] = values[k].T @ d, d.sum(0)
            d = d @ self.w[f"{side}{k}"].T
            if k:
                d = d * (values[k] > 0)
        return d

    def latent(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x, "e")[-1]

    def rebuild(self, z: np.ndarray) -> np.ndarray:
        return self._forward(z, "d")[-1]

    def quantize(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of each level, the sum of their vectors, and the loss of each level.

        With moving averages the loss is beta times the mean squared residual; with learnable codes the mean
        over rows of the squared residual's sum, once for the codes and beta times for the encoder.
        """
        if not self.books:
            raise RuntimeError("fit first")
        left, codes, losses = z.copy(), [], []
        for book in self.books:
            codes.append(nearest(left, book))
            left = left - book[codes[-1]]
            square = left**2
            losses.append((1 + self.config.beta) * square.sum(1).mean() if self.config.learnable else self.config.beta * square.mean())
        return np.stack(codes, 1).astype(np.int32), z - left, np.array(losses)

    def forward(self, x: np.ndarray) -> dict[str, object]:
        """Reconstruction, loss, codes and the share of distinct tuples of a batch."""
        codes, q, losses = self.quantize(self.latent(x))
        out = self.rebuild(q)
        return {"rebuilt": out, "loss": float(((out - x) ** 2).mean() + losses.sum()), "codes": codes, "p_unique": len(np.unique(codes, axis=0)) / len(codes)}

    def seed_codes(self, x: np.ndarray) -> None:
        left = self.latent(x)
        for k in range(self.config.levels):
            self.books.append(kmeans_plus_plus(left, self.config.codes, self.config.seed + k))
            left = left - self.books[-1][nearest(left, self.books[-1])]

    def fit(self, df: DataFrame, vector: str = "embedding") -> Autoencoder:
        c = self.config
        usable = df.filter((F.size(vector) == c.input_dim) & finite(vector)).select(F.col(vector).cast("array<double>").alias("v"))
        if not self.books:
            rows = usable.orderBy(F.xxhash64(F.lit(c.seed), "v"), "v").limit(c.seed_rows).collect()  # a bounded sample, for the first codes only
            if not rows:
                raise ValueError("no usable vectors")
            self.seed_codes(np.array([r.v for r in rows]))
        for _ in range(c.epochs):
            self._epoch(usable)
        return self

    def _epoch(self, usable: DataFrame) -> None:
        model, d = self, self.config.input_dim

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, losses = 0, []
            for batch in batches:
                if batch.num_rows:
                    _, x = usable_rows(batch.column(0), d)
                    losses += model.fit_array(x).losses[-1:]
                    n += len(x)
            if n:
                arrays = model._arrays()
                yield pa.RecordBatch.from_arrays([pa.array(list(arrays)), pa.array([n] * len(arrays)), pa.array([losses[-1]] * len(arrays)), pa.array([v.ravel().tolist() for v in arrays.values()], pa.list_(pa.float64()))], names=["name", "n", "loss", "v"])

        # One row for each array of weights and task.
        rows = usable.mapInArrow(train, "name string, n long, loss double, v array<double>").collect()
        if not rows:
            raise ValueError("no usable vectors")
        mean = {}
        for k, old in self._arrays().items():
            own = sorted((r for r in rows if r.name == k), key=lambda r: (r.n, r.v))
            mean[k] = (sum(r.n * np.array(r.v) for r in own) / sum(r.n for r in own)).reshape(old.shape)
        self._put(mean)
        self.losses.append(float(np.average([r.loss for r in rows], weights=[r.n for r in rows])))

    def _arrays(self) -> dict[str, np.ndarray]:
        return {**self.w, **self.state, **{f"book{i}": b for i, b in enumerate(self.books)}}

    def _put(self, arrays: dict[str, np.ndarray]) -> None:
        self.w = {k: arrays[k] for k in self.w}
        self.state = {k: v for k, v in arrays.items() if k not in self.w and not k.startswith("book")}
        self.books = [arrays[f"book{i}"] for i in range(self.config.levels) if f"book{i}" in arrays]

    def fit_array(self, x: np.ndarray) -> Autoencoder:
        """One pass over the rows of an array in mini-batches."""
        if not self.books:
            self.seed_codes(x)
        rng = np.random.default_rng(self.config.seed + 1 + int(self.state.get("step", np.zeros(1))[0]))
        order = rng.permutation(len(x))
        for k in range(0, len(x), self.config.batch):
            self.losses.append(self.fit_step(x[order[k : k + self.config.batch]], rng))
        return self

    def fit_step(self, b: np.ndarray, rng: np.random.Generator) -> float:
        """One mini-batch; returns its reconstruction loss."""
        c, s = self.config, self.state
        for i, book in enumerate(self.books):
            s.setdefault(f"size{i}", np.ones(c.codes))
            s.setdefault(f"total{i}", book.copy())
            s.setdefault(f"idle{i}", np.zeros(c.codes))
        step = s["step"] = s.get("step", np.zeros(1)) + 1
        enc = self._forward(b, "e")
        z = enc[-1]
        left, commit, grads = z.copy(), np.zeros_like(z), {}
        for k, book in enumerate(self.books):
            code = nearest(left, book)
            n, sums, rest = np.bincount(code, minlength=c.codes), np.zeros_like(book), left - book[code]
            np.add.at(sums, code, left)
            if c.learnable:
                commit += 2 * c.beta * rest / len(left)
                grads[f"book{k}"] = np.zeros_like(book)
                np.add.at(grads[f"book{k}"], code, -2 * rest / len(left))
            else:
                commit += 2 * c.beta * rest / left.size
                s[f"size{k}"], s[f"total{k}"], self.books[k] = ema_update(s[f"size{k}"], s[f"total{k}"], book, n, sums, c.decay)
                s[f"idle{k}"] = np.where(n > 0, 0, s[f"idle{k}"] + 1)
                dead = np.flatnonzero(s[f"idle{k}"] >= c.restart_after)
                if len(dead):  # unused codes start again at rows of the batch
                    self.books[k][dead] = left[rng.integers(len(left), size=len(dead))]
                    s[f"size{k}"][dead], s[f"total{k}"][dead], s[f"idle{k}"][dead] = 0, 0, 0
            left = rest
        dec = self._forward(z - left, "d")
        error = dec[-1] - b
        d_z = self._backward(dec, 2 * error / error.size, "d", grads) + commit  # straight through the codes
        self._backward(enc, d_z, "e", grads)
        for k, g in grads.items():
            m, v = 0.9 * s.get(f"m_{k}", 0.0) + 0.1 * g, 0.999 * s.get(f"v_{k}", 0.0) + 0.001 * g * g
            s[f"m_{k}"], s[f"v_{k}"] = m, v
            move = c.learning_rate * (m / (1 - 0.9 ** step[0])) / (np.sqrt(v / (1 - 0.999 ** step[0])) + 1e-8)
            if k.startswith("book"):
                self.books[int(k[4:])] = self.books[int(k[4:])] - move
            else:
                self.w[k] = self.w[k] - move
        return float((error**2).mean())

    def transform(self, df: DataFrame, vector: str = "embedding", out: str = "codes") -> DataFrame:
        """Add the codes of every row; null for null, misshapen and not finite vectors."""
        if not self.books:
            raise RuntimeError("fit first")
        model, d = self, self.config.input_dim

        @F.arrow_udf("array<int>")
        def codes(column: pa.Array) -> pa.Array:
            ok, x = usable_rows(column, d)
            return code_lists(ok, model.quantize(model.latent(x))[0], pa.int32())

        return df.withColumn(out, codes(F.col(vector).cast("array<double>")))

    def inverse_transform(self, df: DataFrame, codes: str = "codes", out: str = "vec") -> DataFrame:
        model = self

        @F.arrow_udf("array<double>")
        def rebuilt(column: pa.Array) -> pa.Array:
            ok, rows = usable_rows(column.cast(pa.list_(pa.float64())), len(model.books))
            rows = rows.astype(np.int64)
            valid = ((rows >= 0) & (rows < model.config.codes)).all(1)
            ok[np.flatnonzero(ok)[~valid]] = False
            rows = rows[valid]
            z = sum((book[rows[:, k]] for k, book in enumerate(model.books)), np.zeros((len(rows), model.config.latent_dim)))
            return code_lists(ok, model.rebuild(z), pa.float64())

        return df.withColumn(out, rebuilt(F.col(codes)))

    def save(self, spark: SparkSession, path: str) -> None:
        arrays = self._arrays()
        spark.createDataFrame([(k, list(v.shape), v.ravel().tolist()) for k, v in arrays.items()], "name string, shape array<int>, v array<double>").write.mode("overwrite").parquet(f"{path}/weights")
        spark.createDataFrame([(json.dumps(asdict(self.config)),)], "params string").write.mode("overwrite").json(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Autoencoder:
        model = cls(AutoencoderConfig(**json.loads(spark.read.schema("params string").json(f"{path}/params").first().params)))
        arrays = {r.name: np.array(r.v).reshape(r.shape) for r in spark.read.parquet(f"{path}/weights").collect()}
        model._put(arrays)
        return model
