"""Events: where a state begins and ends, the objects they number and the landmarks they leave behind.

w orders the samples of a group; `upto(w)` is its running frame.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def enter(state: Column, w: WindowSpec) -> Column:
    """A state begins; never at a group's first sample."""
    return state & ~F.lag(state, 1, True).over(w)


def exit(state: Column, w: WindowSpec) -> Column:
    """The first sample after a state; never a group's first."""
    return ~state & F.lag(state, 1, False).over(w)


def enter_mask(state: Column, w: WindowSpec) -> Column:
    """As enter, but a state that holds at the first sample begins there."""
    return state & ~F.lag(state, 1, False).over(w)


exit_mask = exit


def between(entered: Column, exited: Column, w: WindowSpec) -> Column:
    """From each enter to before its exit; the inverse of the two masks."""
    return F.sum(entered.cast("int") - exited.cast("int")).over(upto(w)) > 0


def number(entered: Column, w: WindowSpec) -> Column:
    """The running count of enters: an object's number, 0 before the first."""
    return F.sum(entered.cast("long")).over(upto(w))


def landmark(event: Column, index: Column, w: WindowSpec) -> Column:
    """The index of the last event so far; null before the first."""
    return F.last(F.when(event, index), ignorenulls=True).over(upto(w))


def preceding(event: Column, w: WindowSpec) -> Column:
    """The sample before an event, in the same group."""
    return F.lead(event, 1, False).over(w)


def smooth(x: Column, n: int, w: WindowSpec) -> Column:
    """The mean of n samples up to this one; null until there are n, or where one of them is null."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) == n, F.avg(x).over(frame))


def rolling_both(x: Column, n: int, w: WindowSpec) -> Column:
    """Whether the sums of n samples back and of n samples on are both positive; false where either isn't full."""
    out = []
    for frame in (w.rowsBetween(-(n - 1), 0), w.rowsBetween(0, n - 1)):
        out.append(F.when(F.count(x).over(frame) == n, F.sum(x).over(frame)) > 0)
    return F.coalesce(out[0] & out[1], F.lit(False))


def running_sum(x: Column, w: WindowSpec) -> Column:
    """The sum so far; null where x is, and going on after."""
    return F.when(x.isNotNull(), F.sum(x).over(upto(w)))


def carried(x: Column, w: WindowSpec) -> Column:
    """The last value so far that isn't null."""
    return F.last(x, ignorenulls=True).over(upto(w))
