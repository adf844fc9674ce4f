"""Telling most rows whose key is not among some keys, without a shuffle.

Every key sets one of ``BITS`` bits by its hash, and the bits, ten megabytes
whatever the number of keys, are sent to all tasks.  A row whose bit is not set
has none of the keys; one whose bit is set has to be joined to know.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 1 << 26
# A row of the sent table holds so many numbers of 64 bits.
_WORDS = 8


def _place(rows: DataFrame, key: Sequence[str], folded: bool) -> Column:
    """The bit of a row's key; equal keys have one whatever their integer type."""

    def plain(name: str) -> Column:
        kind = rows.schema[name].dataType
        if isinstance(kind, T.IntegralType):
            return F.col(name).cast("long")
        return F.lower(name) if folded and isinstance(kind, T.StringType) else F.col(name)

    return F.pmod(F.xxhash64(*[plain(n) for n in key]), F.lit(BITS))


def _placed(rows: DataFrame, key: Sequence[str], folded: bool = False, tag: str = "") -> DataFrame:
    """Rows with the place of their key's bit: row, word and bit in it, each computed once."""
    place = rows.withColumn(f"_place{tag}", _place(rows, key, folded))
    own = F.col(f"_place{tag}")
    return place.select(
        *rows.columns,
        F.shiftright(own, 9).alias(f"_at{tag}"), F.shiftright(own, 6).bitwiseAND(_WORDS - 1).cast("int").alias(f"_word{tag}"),
        own.bitwiseAND(63).cast("int").alias(f"_bit{tag}"),
    )


def marks(keys: DataFrame, key: Sequence[str]) -> DataFrame:
    """The bits of all keys, to be sent to all tasks."""
    own = _placed(keys.select(*key), key).select("_at", "_word", F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit")).alias("_one"))
    words = [F.coalesce(F.bit_or(F.when(F.col("_word") == i, F.col("_one"))), F.lit(0).cast("long")).alias(f"_w{i}") for i in range(_WORDS)]
    return F.broadcast(own.groupBy(F.col("_at").alias("_row")).agg(*words))


def _is_set(tag: str = "", of: str = "") -> Column:
    word = F.col(f"_word{tag}")
    held = reduce(lambda chain, i: chain.when(word == i, F.col(f"_w{i}{of}")), range(1, _WORDS), F.when(word == 0, F.col(f"_w0{of}")))
    return F.call_function("shiftright", held, F.col(f"_bit{tag}")).bitwiseAND(F.lit(1).cast("long")) == 1


def where_marked(rows: DataFrame, key: Sequence[str], marked: DataFrame, *, folded: bool = False) -> DataFrame:
    """Rows with one of the keys, and few others; ``folded``: the keys are lower-case, the rows' are not."""
    placed = _placed(rows, key, folded)
    return placed.join(marked, (F.col("_at") == F.col("_row")) & _is_set(), "left_semi").select(*rows.columns)


def split_marked(rows: DataFrame, *keys: tuple[Sequence[str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(some, others)``: others have none of the keys, in any of the columns given; both read the rows."""
    found, names = rows, []
    for i, (key, marked) in enumerate(keys):
        own = marked.select(F.col("_row").alias(f"_row{i}"), *[F.col(f"_w{w}").alias(f"_w{w}_{i}") for w in range(_WORDS)])
        joined = _placed(found, key, tag=str(i)).join(F.broadcast(own), F.col(f"_at{i}") == F.col(f"_row{i}"), "left")
        found = joined.select(*rows.columns, *names, F.coalesce(_is_set(str(i), f"_{i}"), F.lit(False)).alias(f"_marked{i}"))
        names.append(f"_marked{i}")
    some = reduce(lambda a, b: a | b, [F.col(n) for n in names])
    return found.where(some).select(*rows.columns), found.where(~some).select(*rows.columns)
