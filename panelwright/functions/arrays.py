"""Expressions over arrays of numbers in order, such as one ticker's values along a range.

An array is read within its row, where a window copies each value into a row of its own and a sliding frame reads its
rows anew for every row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def total(x: Column) -> Column:
    """The sum; NULL if an element is NULL."""
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def deviation(x: Column, n: int) -> Column:
    """Sample standard deviation of n values; exactly 0 if they are equal, NULL if one is NULL."""
    off = let(x, lambda s: let(F.get(s, F.lit(0)), lambda first: F.transform(s, lambda v: v - first)))
    return let(off, lambda s: let(total(s) / n, lambda m: F.sqrt(F.aggregate(s, F.lit(0.0), lambda a, v: a + (v - m) * (v - m)) / (n - 1))))


def before(x: Column) -> Column:
    """Each place's element before."""
    return F.concat(F.array(F.lit(None).cast("double")), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))))


def more(a: Column, b: Column) -> Column:
    """The larger one; a if b is NULL. (``greatest`` of two goes through a list of its arguments.)"""
    return F.when(b > a, b).otherwise(a)


def less(a: Column, b: Column) -> Column:
    return F.when(b < a, b).otherwise(a)


def moving(x: Column, n: int, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """The join of the n elements from each one on, by doubling: about 2 log2(n) passes, not n. Elements after the last are NULL."""

    def joined(a: Column, b: Column, k: int) -> Column:
        return F.zip_with(a, F.slice(b, k + 1, F.size(b)), join)

    def step(s: Column, width: int, found: Column | None, used: int) -> Column:
        """``s`` joins ``width`` elements, ``found`` the first ``used`` of the n."""
        if n & width and found is not None:
            return let(joined(found, s, used), lambda a: wider(s, width, a, used + width))
        return wider(s, width, s, width) if n & width else wider(s, width, found, used)

    def wider(s: Column, width: int, found: Column | None, used: int) -> Column:
        return found if 2 * width > n else let(joined(s, s, width), lambda t: step(t, 2 * width, found, used))

    return let(x, lambda s: step(s, 1, None, 0))


def last_centre(x: Column, k: int, extreme: Callable[[Column, Column], Column]) -> Column:
    """The last place whose element is the extreme of the 2k+1 around it, which must all be there; NULL if there is none."""
    n = 2 * k + 1

    def last(s: Column) -> Column:
        found = F.zip_with(F.slice(moving(s, n, extreme), 1, F.greatest(F.size(s) - 2 * k, F.lit(0))), F.slice(s, k + 1, F.greatest(F.size(s) - 2 * k, F.lit(0))), lambda m, v: m == v)
        return F.array_max(F.transform(found, lambda yes, i: F.when(yes, i + k)))

    def search(s: Column) -> Column:
        # mostly it is near the end
        start = F.greatest(F.size(s) - 4 * n, F.lit(0))
        return F.coalesce(let(F.slice(s, start + 1, F.greatest(F.size(s), F.lit(1))), last) + start, last(s))

    return let(x, search)
