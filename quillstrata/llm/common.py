"""Helpers shared by the corpus operators: shared storage, checked broadcasts, word splitting."""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.scratch import discard, shared_dir, small, spool

__all__ = ["ascii_lower", "discard", "fresh", "give_back", "lean", "let", "row_key", "sample", "shared_dir", "small", "split_words", "spool", "table"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of the two word definitions, for Java's regex.
SPACE = r"[\x20\x09-\x0D]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return the memory that a Python worker has freed to the system: workers are used again by other stages, beside which they'd keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc
    if trim:
        trim(0)


def lean(f: Callable) -> Callable:
    """f, and then give_back: for what grouped Arrow functions run on each group."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return f(table)
        finally:
            give_back()

    def two(table: pa.Table, other: pa.Table) -> pa.Table:
        try:
            return f(table, other)
        finally:
            give_back()

    return one if len(inspect.signature(f).parameters) == 1 else two


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once per row and use it in body: a lambda over a captured expression would redo it for each element."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separators: str = SPACE) -> Column:
    """Words between separators; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    held = {c.lower() for c in df.columns}
    while name in held:
        name += "_"
    return name


def row_key(*cols: str) -> Column:
    """Tells rows apart that share an id but not their text; identical rows share it."""
    return F.xxhash64(*cols)


def sample(df: DataFrame, k: int, *by: str) -> DataFrame:
    """Up to k rows, those of lowest hash of `by`.  A threshold on the hash leaves some 2 k rows before they are ordered, so tasks send the driver little however many they are."""
    n, space = df.count(), 1 << 40
    h = F.pmod(F.xxhash64(*by), F.lit(space))
    few = df if n <= 4 * k else df.filter(h < int(space * 2 * k / n))
    return few.orderBy(h, *by).limit(k)
