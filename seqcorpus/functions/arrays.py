"""Array helpers built on higher-order functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def empty_array(element_type: str) -> Column:
    return F.array().cast(f"array<{element_type}>")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once however often the body uses it.

    Sub-expressions are not shared inside higher-order functions; a lambda variable is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def offsets(lengths: Column, block: int = 64) -> Column:
    """Exclusive running sum of an int array: where each element starts.

    ``aggregate`` copies its whole state at every step, so a growing array in it costs n * n. Here sums
    of blocks are added up first and every element then adds the part of its own block.
    """

    def total(arr: Column) -> Column:
        return F.aggregate(arr, F.lit(0), lambda a, x: a + x)

    def with_blocks(values: Column) -> Column:
        count = F.ceil(F.size(values) / block).cast("int")
        sums = F.transform(span(count), lambda b: total(F.slice(values, b * block + 1, F.lit(block))))
        before = bind(sums, lambda t: F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b))))
        return bind(
            before,
            lambda p: F.transform(
                values,
                lambda _, i: F.get(p, F.floor(i / block).cast("int"))
                + total(F.slice(values, i - i % block + 1, i % block)),
            ),
        )

    return bind(lengths, with_blocks)


def running_max(values: Column, block: int = 64) -> Column:
    """Largest element so far, at each place; by blocks, as :func:`offsets`."""

    def with_blocks(arr: Column) -> Column:
        count = F.ceil(F.size(arr) / block).cast("int")
        tops = F.transform(span(count), lambda b: F.array_max(F.slice(arr, b * block + 1, F.lit(block))))
        before = bind(tops, lambda t: F.transform(t, lambda _, b: F.array_max(F.slice(t, F.lit(1), b))))
        return bind(before, lambda p: F.transform(arr, lambda _, i: F.greatest(
            F.get(p, F.floor(i / block).cast("int")), F.array_max(F.slice(arr, i - i % block + 1, i % block + 1)))))

    return bind(values, with_blocks)


def array_total(arr: Column, as_type: str = "bigint") -> Column:
    return F.aggregate(arr, F.lit(0).cast(as_type), lambda a, x: a + x.cast(as_type))


def count_below(ordered: Column, key: Column, most: int) -> Column:
    """How many elements of an ascending array of at most ``most`` are not above ``key``, by binary search."""
    strides = [1 << i for i in reversed(range(max(most, 1).bit_length()))]

    def search(arr: Column, wanted: Column) -> Column:
        return F.aggregate(
            F.lit(strides), F.lit(0),
            lambda at, stride: F.when(F.get(arr, at + stride - 1) <= wanted, at + stride).otherwise(at),
        )

    return bind(ordered, lambda arr: bind(key, lambda wanted: search(arr, wanted)))


def count_true(arr: Column) -> Column:
    """Number of true elements of a boolean array."""
    return F.size(F.filter(arr, lambda x: x)).cast("bigint")


def distinct_structs(arr: Column) -> Column:
    """Distinct structs in ascending order, by sorting: ``array_distinct`` compares each struct with all before it."""
    return bind(F.sort_array(arr), lambda rows: F.filter(rows, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(rows, i - 1))))


def span(length: Column) -> Column:
    """0 .. length-1, empty for length 0 (``sequence`` alone would count down)."""
    return F.when(length > 0, F.sequence(F.lit(0), (length - 1).cast("int"))).otherwise(empty_array("int"))


def joined(arr: Column, sep: str = ",") -> Column:
    """Numbers or strings as one delimited string."""
    return F.array_join(arr.cast("array<string>"), sep)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with extra columns that are evaluated exactly once per row.

    Catalyst moves filters below projections by copying the filtered expression, which would run a
    costly in-row computation once per use. Filters on a generator's output stay above it.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(packed)))
