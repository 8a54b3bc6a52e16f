"""Column functions on texts: ids of texts, prefixes and token lists."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def char_ids(text: Column | str) -> Column:
    """The code point of each character; an empty list for an empty text."""
    t = F.col(text) if isinstance(text, str) else text
    return F.transform(F.filter(F.split(t, ""), lambda c: c != ""), F.ascii)


@lru_cache(maxsize=4)
def _bpe(path: str, pattern: str):
    from tiktoken import Encoding
    from tiktoken.load import load_tiktoken_bpe

    return Encoding("public", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})


def bpe_ids(path: str, pattern: str):
    """A function from a text column to its ids by a public rank file, which every executor has at ``path``; null gives null."""

    @F.arrow_udf("array<int>")
    def ids(texts):
        import pyarrow as pa

        bpe = _bpe(path, pattern)
        return pa.array([None if t is None else bpe.encode_ordinary(t) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return lambda text: ids(F.col(text) if isinstance(text, str) else text)


def instruction(task: str, text: Column | str) -> Column:
    """A query with its instruction, as embedding models expect it."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery:"), text)


def ordered_union(*lists: Column | str) -> Column:
    """The elements of several lists in order of first appearance."""
    return F.array_distinct(F.concat(*lists))


def hashed_embedding(text: Column | str, dimensions: int = 64) -> Column:
    """A unit vector of hashed word counts, where no embedding model is at hand; zero for a text without words, null for null."""
    from quantloom.functions.vector import l2_normalize

    t = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dimensions)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    return l2_normalize(F.when(t.isNotNull(), counts))
