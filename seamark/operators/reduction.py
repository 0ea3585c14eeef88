"""Joins that first drop rows without a partner, so that they never reach the shuffle.

The keys of the smaller table are hashed into a Bloom filter in blocks: a key sets a few bits in
one block of 4096, so a block is one row, and testing a row is one lookup in a broadcast
table of blocks. The filter's size follows from the counted keys and is checked; beyond the bound the
join is Spark's alone. A row may pass without a partner (below 1 % do), none with a partner is
stopped, and the join that follows is exact, so results don't depend on the filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamark.session import write_out

#: Bits of a block, in 64 words of 64, and what is set of them: 5 times 12 bits of one hash.
BLOCK = 4096
PROBES = 5
#: Bits of the filter for each key; with five probes 0.5 % of rows without a partner pass.
BITS = 12
#: Largest filter that is broadcast, enough for 89 million keys.
MOST_BYTES = 128 << 20
SEED = 0x5EA


@dataclass(frozen=True)
class Sieve:
    """The blocks of a filter as (block, words array<long>), and what it was made of.

    ``blocks`` is None where the filter would be larger than the bound: then all rows pass.
    ``keys`` are the distinct keys without null, written once.
    """

    on: tuple[str, ...]
    keys: DataFrame
    blocks: DataFrame | None
    n_keys: int
    n_blocks: int


def _places(on: Sequence[str], n_blocks: int) -> list[Column]:
    """The block of a key, and the hash that tells its bits."""
    return [F.pmod(F.xxhash64(*on), F.lit(n_blocks)).alias("_block"), F.xxhash64(F.lit(SEED), *on).alias("_probes")]


def _whole(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows without a null in the key; not-a-number is a key like any other, as joins have it."""
    return df.where(reduce(and_, [F.col(c).isNotNull() for c in on]))


def _probe(i: int) -> Column:
    return F.shiftrightunsigned("_probes", 12 * i).bitwiseAND(F.lit(BLOCK - 1))


def sieve(keys: DataFrame, on: Sequence[str], most_bytes: int = MOST_BYTES, bits: int = BITS) -> Sieve:
    """A filter of the keys in the columns ``on``.

    Keys are made distinct and written once, counted from the files, and their bits added up with
    map-side combining. Keys with a null equal nothing and are left out. No key at all makes
    a filter that nothing passes.
    """
    known = write_out(_whole(keys, on).select(*on).distinct(), "sieve-keys")
    n_keys = known.count()
    n_blocks = max(1, -(-n_keys * bits // BLOCK))
    if n_blocks * BLOCK // 8 > most_bytes:
        return Sieve(tuple(on), known, None, n_keys, n_blocks)
    at = F.explode(F.array(*[_probe(i) for i in range(PROBES)])).alias("_at")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_at").bitwiseAND(F.lit(63)).cast("int"))
    set_bits = (
        known.select(*_places(on, n_blocks)).select("_block", at)
        .groupBy("_block", F.shiftright("_at", 6).alias("_word")).agg(F.bit_or(bit).alias("_bits"))
    )
    # At most 64 words come together here.
    words = F.map_from_entries(F.collect_list(F.struct("_word", "_bits")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda w: F.coalesce(F.try_element_at("_words", w.cast("long")), F.lit(0).cast("long")))
    blocks = set_bits.groupBy("_block").agg(words.alias("_words")).select(F.col("_block").alias("block"), dense.alias("words"))
    return Sieve(tuple(on), known, blocks, n_keys, n_blocks)


def _split(df: DataFrame, filter_: Sieve, on: Sequence[str], how: str) -> DataFrame:
    passed = F.lit(True)
    for i in range(PROBES):
        word = F.col("words")[F.shiftright(_probe(i), 6).cast("int")]
        passed = passed & (F.call_function("shiftright", word, _probe(i).bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    placed = df.select("*", *_places(on, filter_.n_blocks))
    met = (F.col("_block") == F.col("block")) & passed
    return placed.join(F.broadcast(filter_.blocks), met, how).drop("_block", "_probes")


def _same_types(df: DataFrame, on: Sequence[str], other: DataFrame, names: Sequence[str]) -> None:
    """Values of different types are hashed differently even where a join finds them equal."""
    for a, b in zip(on, names, strict=True):
        if df.schema[a].dataType != other.schema[b].dataType:
            raise ValueError(f"{a} is {df.schema[a].dataType.simpleString()}, {b} is {other.schema[b].dataType.simpleString()}: cast one of them")


def sift(df: DataFrame, filter_: Sieve, on: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``df`` whose key may be among the filter's; all that are, and below 1 % of the others.

    ``on`` names the key's columns in ``df`` where they are called otherwise. Rows with a null in the key go.
    """
    on = list(on or filter_.on)
    _same_types(df, on, filter_.keys, filter_.on)
    there = _whole(df, on)
    return there if filter_.blocks is None else _split(there, filter_, on, "left_semi")


def semi_join(df: DataFrame, keys: DataFrame, on: Sequence[str], **limits: int) -> DataFrame:
    """Rows of ``df`` whose key is one of the keys."""
    filter_ = sieve(keys, on, **limits)
    return sift(df, filter_).join(filter_.keys, list(on), "left_semi").select(*df.columns)


def anti_join(df: DataFrame, keys: DataFrame, on: Sequence[str], **limits: int) -> DataFrame:
    """Rows of ``df`` whose key is none of the keys, rows with a null in the key among them.

    Rows that the filter stops are results as they are read; only the others are compared.
    """
    filter_ = sieve(keys, on, **limits)
    _same_types(df, on, filter_.keys, on)
    if filter_.blocks is None:
        return df.join(filter_.keys, list(on), "left_anti").select(*df.columns)
    doubtful = _split(df, filter_, on, "left_semi").join(filter_.keys, list(on), "left_anti")
    return _split(df, filter_, on, "left_anti").unionByName(doubtful.select(*df.columns))


def join(df: DataFrame, other: DataFrame, on: Sequence[str], columns: Sequence[str], how: str = "inner", **limits: int) -> DataFrame:
    """Every row of ``df`` with the ``columns`` of every row of ``other`` that has its key.

    With ``how`` left, rows without a partner stay, with nulls; those that the filter stops aren't shuffled either.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"inner or left, not {how!r}")
    filter_ = sieve(other, on, **limits)
    _same_types(df, on, filter_.keys, on)
    partners = other.select(*on, *columns)
    out = [*df.columns, *columns]
    if how == "inner":
        return sift(df, filter_).join(partners, list(on), "inner").select(*out)
    if filter_.blocks is None:
        return df.join(partners, list(on), "left").select(*out)
    alone = _split(df, filter_, on, "left_anti")
    alone = alone.select(*df.columns, *[F.lit(None).cast(other.schema[c].dataType).alias(c) for c in columns])
    met = _split(df, filter_, on, "left_semi").join(partners, list(on), "left").select(*out)
    return met.unionByName(alone)
