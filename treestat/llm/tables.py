"""Reading the tables that the operators take, and applying a function of texts batch by batch."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_HELD: dict = {}


def held(key, make: Callable[[], object]):
    """What a Python worker keeps between tasks: one object, the last one asked for.

    Workers serve one stage after another; what an earlier stage kept goes before the next one's is made.
    """
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Give back what an earlier stage has left in this worker; for functions that keep nothing themselves."""
    if _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def add_columns(df: DataFrame, keep: list[str], take: list[str], f: Callable[..., list[list]], new: dict[str, str]) -> DataFrame:
    """The ``keep`` columns as they are and ``new`` columns (name: type), computed from the ``take`` columns.

    ``f`` gets a list of values for each taken column and returns a list for each new one. Values that are only
    carried never leave Arrow, so NULLs and large numbers stay exact.
    """
    added = T.StructType.fromDDL(", ".join(f"{c} {kind}" for c, kind in new.items()))
    schema = T.StructType([*(df.schema[c] for c in keep), *added])
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = f(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in take))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *(pa.array(x, k) for x, k in zip(made, kinds))], [*keep, *new])

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, text: str, f: Callable[[list[str]], list[bool]]) -> DataFrame:
    """The rows for whose texts (NULL: empty) ``f`` says so, all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield b.filter(pa.array(f(texts), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def by_group(df: DataFrame, key: str, f: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Apply ``f`` to frames that hold whole groups of ``key`` only, many small groups at once.

    Groups must be of bounded size. Rows come sorted by the key, so that a frame's last group waits for the next one.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            cut = int(np.searchsorted(pdf[key].to_numpy(), pdf[key].iloc[-1], side="left"))
            rest = pdf.iloc[cut:].reset_index(drop=True)
            if cut:
                yield from f(pdf.iloc[:cut])
        if rest is not None and len(rest):
            yield from f(rest)

    return df.repartition(key).sortWithinPartitions(key).mapInPandas(run, schema)
