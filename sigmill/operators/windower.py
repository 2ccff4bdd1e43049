"""Cutting windows out of streams, around markers or at a fixed step.

A stream is samples(stream, t, ...) with markers at sample positions. Conditions on other markers near a window's marker
are counts over a RANGE frame of the stream's own order, so include and exclude need no join. Samples meet windows by
equality on (stream, t), after each window is spelled out as its positions: an interval join without an interval.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigmill.operators.segments import LENGTH, in_segments, last_where


@dataclass(frozen=True)
class Near:
    """A marker within [m - before, m + after] of the window's marker at m."""

    marker: str
    before: int
    after: int


@dataclass(frozen=True)
class WindowDef:
    """Windows of class label: samples [m + start, m + end] (end left out with no_overlap) at each marker."""

    name: str
    label: str
    marker: str
    start: int
    end: int
    exclude: tuple[Near, ...] = field(default=())
    include: tuple[Near, ...] = field(default=())
    skip_first: int = 0
    no_overlap: bool = False


def _near(df_order: Window, near: Near, t: str, marker: str, no_overlap: bool) -> Column:
    frame = df_order.rangeBetween(-near.before, near.after - (1 if no_overlap else 0))
    own = (F.col(marker) == near.marker).cast("int")
    return F.sum(own).over(frame) - own  # the marker itself doesn't count


def marker_windows(markers: DataFrame, defs: list[WindowDef], stream: list[str], t: str = "t", marker: str = "marker", length: int = LENGTH) -> DataFrame:
    """stream, m (position), window, label, first and last position of each window whose conditions hold."""
    near = [n for d in defs for n in (*d.exclude, *d.include)]
    before, after = max([0, *(n.before for n in near)]), max([0, *(n.after for n in near)])
    return in_segments(markers, stream, t, lambda df, key: _marker_windows(df, defs, key, t, marker), before, after, length).drop(t)


def _marker_windows(markers: DataFrame, defs: list[WindowDef], stream: list[str], t: str, marker: str) -> DataFrame:
    order = Window.partitionBy(*stream).orderBy(t)
    found = None
    for d in defs:
        ok = (F.col(marker) == d.marker) & (F.col(t) >= d.skip_first)
        conditions = {f"_x{k}": _near(order, n, t, marker, d.no_overlap) for k, n in enumerate(d.exclude)} | {f"_i{k}": _near(order, n, t, marker, d.no_overlap) for k, n in enumerate(d.include)}
        df = markers.withColumns(conditions) if conditions else markers
        for c in conditions:
            ok &= F.coalesce(F.col(c), F.lit(0)) == 0 if c.startswith("_x") else F.coalesce(F.col(c), F.lit(0)) >= 1
        one = df.filter(ok).select(*stream, t, F.col(t).alias("m"), F.lit(d.name).alias("window"), F.lit(d.label).alias("label"), (F.col(t) + d.start).alias("first"), (F.col(t) + d.end - (1 if d.no_overlap else 0)).alias("last"))
        found = one if found is None else found.unionByName(one)
    return found


def null_markers(samples: DataFrame, stream: list[str], t: str, stride: int, name: str = "null") -> DataFrame:
    """A synthetic marker every stride samples."""
    return samples.filter(F.col(t) % stride == 0).select(*stream, t, F.lit(name).alias("marker"))


def extract(samples: DataFrame, windows: DataFrame, stream: list[str], value: str, t: str = "t", whole: bool = True) -> DataFrame:
    """The samples of each window with their index k in it; whole: only windows that lie inside their stream."""
    spelled = windows.withColumn(t, F.explode(F.sequence("first", "last")))
    out = spelled.join(samples.select(*stream, t, value), [*stream, t]).withColumn("k", F.col(t) - F.col("first"))
    if whole:
        n = F.count("*").over(Window.partitionBy(*stream, "m", "window"))
        out = out.withColumn("_n", n).filter(F.col("_n") == F.col("last") - F.col("first") + 1).drop("_n")
    return out.select(*stream, "m", "window", "label", "k", value)


def sliding(samples: DataFrame, t: str, size: int, stride: int) -> DataFrame:
    """Each sample in every window of size samples that starts at a multiple of stride: adds win and k."""
    last = F.floor(F.col(t) / stride)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col(t) - (size - 1)) / stride))
    return samples.withColumn("win", F.explode(F.sequence(first, last))).withColumn("k", F.col(t) - F.col("win") * stride)


def trials(samples: DataFrame, stream: list[str], t: str, marker: str, start: str, end: str) -> DataFrame:
    """Samples from a start marker to the next end marker (included), with the position of the trial's start."""
    out = last_where(samples, stream, t, {"_s": F.col(marker) == start, "_e": F.col(marker) == end})
    began = F.when(F.col(marker) == start, F.col(t)).otherwise(F.col("_s"))
    return out.withColumn("began", began).filter(F.col("began").isNotNull() & (F.col("_e").isNull() | (F.col("_e") < F.col("began")))).drop("_s", "_e")


def pair_with_trigger(events: DataFrame, stream: list[str], t: str, marker: str, event: str, trigger: str) -> DataFrame:
    """For each trigger, the last event before it and since the trigger before: position and waiting time, or null."""
    out = last_where(events, stream, t, {"_event": F.col(marker) == event, "_other": F.col(marker) == trigger})
    paired = F.when(F.col("_other").isNull() | (F.col("_event") > F.col("_other")), F.col("_event"))
    return out.filter(F.col(marker) == trigger).select(*stream, F.col(t).alias("trigger_t"), paired.alias("event_t"), (F.col(t) - paired).alias("waited"))
