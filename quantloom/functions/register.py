"""The engine's functions for SQL: expressions that stay in the JVM, an encoder and a table function."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quantloom.operators.quantize import code_lists, nearest, usable_rows

EXPRESSIONS = {
    "vec_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "vec_l2sq": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "strip_padding": ("ids ARRAY<BIGINT>", "ARRAY<BIGINT>", "filter(ids, i -> i >= 0)"),
    "flat_ids": ("codes ARRAY<INT>, base BIGINT", "BIGINT", "aggregate(codes, 0L, (s, c) -> s * base + c)"),
    "sid_string": ("codes ARRAY<INT>", "STRING", "concat('<|item_start|>', array_join(transform(codes, (c, i) -> concat('<item_L', i, '_C', c, '>')), ''), '<|item_end|>')"),
}


class _Tokens:
    """(pos, kind, token, code) of each id of a sequence; kind is text, item or mark."""

    def eval(self, ids: list, text_size: int, levels: int, codes: int):
        for pos, t in enumerate(ids or []):
            kind = "text" if t is None or t < text_size else "item" if t < text_size + levels * codes else "mark"
            yield pos, kind, t, (t - text_size) % codes if kind == "item" else None


def register(spark: SparkSession, levels: Sequence[np.ndarray] | None = None) -> None:
    """Register the functions; with codebooks (an array a level) also ``encode_codes(vector)``."""
    for name, (arguments, kind, body) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("sequence_tokens", F.udtf(_Tokens, returnType="pos int, kind string, token int, code int"))
    if levels:
        d = levels[0].shape[1]

        @F.arrow_udf("array<int>")
        def encode_codes(column: pa.Array) -> pa.Array:
            ok, r = usable_rows(column.cast(pa.list_(pa.float64())), d)
            found = np.zeros((len(r), len(levels)), dtype=np.int32)
            for k, c in enumerate(levels):
                found[:, k] = nearest(r, c)
                r = r - c[found[:, k]]
            return code_lists(ok, found, pa.int32())

        spark.udf.register("encode_codes", encode_codes)
