"""Small building blocks for work on arrays inside one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    A plain column reference may be inlined into a lambda and evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _count_up(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def indexes(arr: Column) -> Column:
    """0-based indexes of ``arr``; an empty array has none (``sequence`` would count down)."""
    return _count_up(F.size(arr))


def _running_in_blocks(arr: Column) -> Column:
    """Inclusive running sum inside each block of 16: first inside groups of 4, then over the groups before."""
    def plus(a: Column, at: Column, when: Column) -> Column:
        return F.when(when, F.get(a, at)).otherwise(0)

    def in_groups(a: Column) -> Column:
        return F.transform(a, lambda x, i: x + plus(a, i - 1, i.bitwiseAND(3) >= 1)
                           + plus(a, i - 2, i.bitwiseAND(3) >= 2) + plus(a, i - 3, i.bitwiseAND(3) == 3))

    def over_groups(g: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            place, end = i.bitwiseAND(15), i - i.bitwiseAND(3) - 1
            return x + plus(g, end, place >= 4) + plus(g, end - 4, place >= 8) + plus(g, end - 8, place >= 12)
        return F.transform(g, one)

    return let(in_groups(arr), over_groups)


def prefix_sums(lens: Column, first: Column | int = 0, level: int = 0) -> Column:
    """``first`` plus the sum of all earlier elements, for each element of ``array<int>``.

    Appending to an accumulator copies it at each step, which is quadratic in the text length. Here sums run inside
    blocks of 16, then over blocks, so the work per element is constant.
    """
    base = F.lit(first) if isinstance(first, int) else first
    if level == 2:
        return let(lens, lambda a: let(base, lambda b: F.transform(
            a, lambda _, i: F.aggregate(F.slice(a, F.lit(1), i), b, lambda x, y: x + y))))

    def totals(running: Column) -> Column:
        n = F.size(running)
        blocks = _count_up(F.shiftright(n + 15, 4))
        return F.transform(blocks, lambda b: F.get(running, F.least(b * 16 + 15, n - 1)))

    return let(lens, lambda a: let(_running_in_blocks(a), lambda running: let(
        prefix_sums(totals(running), base, level + 1), lambda block_at: F.transform(
            a, lambda x, i: F.get(block_at, F.shiftright(i, 4)) + F.get(running, i) - x))))


def run_starts(sorted_arr: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Indexes where a run of equal neighbours starts in a sorted array."""
    return F.filter(
        indexes(sorted_arr),
        lambda i: (i == 0) | ~same(F.get(sorted_arr, i), F.get(sorted_arr, i - 1)),
    )
