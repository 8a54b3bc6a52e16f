"""What the engine asks of quantizers, codebooks and tokenizers; any class with these methods fits."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Codebook(Protocol):
    """Rows (level, code, vec): look vectors up, overwrite some of them."""

    def lookup(self, df: DataFrame, codes: str, out: str) -> DataFrame: ...

    def update(self, new: DataFrame) -> Codebook: ...


@runtime_checkable
class Quantizer(Protocol):
    """Fit to vectors, then give codes."""

    def fit(self, df: DataFrame, vector: str) -> Quantizer: ...

    def transform(self, df: DataFrame, vector: str, out: str) -> DataFrame: ...


@runtime_checkable
class Tokenizer(Quantizer, Protocol):
    """A quantizer that also rebuilds vectors from codes."""

    def inverse_transform(self, df: DataFrame, codes: str, out: str) -> DataFrame: ...


class Online:
    """Base of models that may be fit batch by batch; without an own ``fit_step`` a batch changes nothing."""

    def fit_step(self, batch: DataFrame, vector: str = "embedding") -> Online:
        return self


class TableCodebook:
    """A codebook held as a table."""

    def __init__(self, table: DataFrame) -> None:
        self.table = table

    def lookup(self, df: DataFrame, codes: str, out: str = "vec") -> DataFrame:
        from quantloom.operators.quantize import decode

        return decode(df, codes, self.table, out)

    def update(self, new: DataFrame) -> TableCodebook:
        from quantloom.operators.quantize import overwrite_codes

        return TableCodebook(overwrite_codes(self.table, new))
