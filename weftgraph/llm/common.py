"""What several operators share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# A word is a run of anything but these ASCII white space characters.
WORD = "[^\\x20\\x09-\\x0D]+"
#: Rows that one Arrow batch may hold: bounds a Python worker by texts, not by tables.
BATCH_ROWS = 512

#: White space in a row from which the faster encoder's pattern may run out of stack.
BLANK_RUN = 1 << 15
_BLANKS = re.compile(r"\s{256,}")


def has_long_blank(text: str) -> bool:
    """Whether ``text`` holds ``BLANK_RUN`` white space characters in a row."""
    return len(text) >= BLANK_RUN and any(m.end() - m.start() >= BLANK_RUN for m in _BLANKS.finditer(text))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Texts can be long, so Python workers get few rows at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows as they are: a null does not turn a column of longs into doubles."""
    return pd.DataFrame(rows, columns=names, dtype=object)


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """``mapInPandas`` with exact longs: where a column has nulls its numbers are objects, not doubles."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.to_pandas(integer_object_nulls=True) for b in batches):
            yield pa.RecordBatch.from_pandas(out, schema=arrow, preserve_index=False)

    return df.mapInArrow(mapped, schema)


def apply_frames(groups: GroupedData, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``applyInPandas`` with exact longs."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def applied(table: pa.Table) -> pa.Table:
        return pa.Table.from_pandas(run(table.to_pandas(integer_object_nulls=True)), schema=arrow, preserve_index=False)

    return groups.applyInArrow(applied, schema)


def word_count(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sampled(df: DataFrame, key: Column, n: int, total: int | None = None) -> DataFrame:
    """At most ``n`` rows: all, or those of smallest ``key`` (a 64-bit hash), about 95 of 100 that ``n`` allows.

    A plain filter on the hash, so no task sends more than its share of them.
    """
    total = df.count() if total is None else total
    if total > n:
        bound = int(-(2**63) + 0.95 * n / total * 2**64)
        df = df.filter(key < F.lit(bound))
    return df.limit(n)
