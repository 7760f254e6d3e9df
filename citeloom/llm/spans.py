"""Places of all matches of a pattern in a text, as column functions, in time linear in the text."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Running sums are built in lists of so many numbers, and those lists are summed in lists again.
FAN = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also where lambdas of ``body`` use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _short_sums(numbers: Column) -> Column:
    """Running sums by appending: the list is copied at each step, so it has to be short."""
    first = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("sums"))

    def step(held: Column, number: Column) -> Column:
        total = held["sum"] + number
        return F.struct(total.alias("sum"), F.concat(held["sums"], F.array(total)).alias("sums"))

    return F.aggregate(numbers, first, step, lambda held: held["sums"])


def running_sums(numbers: Column, levels: int = 3) -> Column:
    """Sums of the first 1, 2, ... of an array<int>; each level shortens the list to be summed ``FAN`` times."""
    if not levels:
        return _short_sums(numbers)

    def summed(numbers: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(numbers), F.lit(1)), F.lit(FAN))
        lists = F.transform(firsts, lambda at: _short_sums(F.slice(numbers, at, FAN)))
        return let(lists, shifted)

    def shifted(lists: Column) -> Column:
        lasts = F.transform(lists, lambda sums: F.coalesce(F.element_at(sums, -1), F.lit(0)))
        before = F.concat(F.array(F.lit(0)), running_sums(lasts, levels - 1))
        moved = F.zip_with(
            lists,
            F.slice(before, 1, F.size(lists)),
            lambda sums, by: F.transform(sums, lambda x: x + by),
        )
        return F.flatten(moved)

    return F.when(F.size(numbers) <= FAN, let(numbers, _short_sums)).otherwise(let(numbers, summed))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, body>> of all matches from left to right, in code points, end exclusive.

    A text split at a pattern, and the matches of the pattern, add up to the
    text, so the lengths of both give the places. The pattern must not match
    the empty string.
    """
    none = F.array().cast("array<struct<start:int,end:int,body:string>>")

    def placed(bodies: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        both = F.zip_with(F.slice(gaps, 1, F.size(bodies)), bodies, lambda gap, body: F.length(gap) + F.length(body))
        ends = running_sums(both)
        return F.zip_with(
            ends,
            bodies,
            lambda end, body: F.struct((end - F.length(body)).alias("start"), end.alias("end"), body.alias("body")),
        )

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(found, lambda bodies: F.when(F.size(bodies) > 0, placed(bodies)).otherwise(none))
