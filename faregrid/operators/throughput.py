"""Throughput of sources: samples, steady state, run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faregrid.operators.panes import floor_div
from faregrid.session import stored

#: Intervals that form a group, and groups that form one of the next level.
FANOUT = 64


def _behind(rows: DataFrame, keys: list[str], place: str, value: str) -> Column:
    """`value` of the nearest later row, by `place`, that has one."""
    return F.last(value, ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy(F.desc(place)).rowsBetween(Window.unboundedPreceding, -1))


def _successors(points: DataFrame, step: int) -> DataFrame:
    """(source, t, next): for every point the first one that lies `step` or more behind it, if any.

    Points and thresholds t + step are put in order inside groups of FANOUT steps; a threshold
    with no point behind it in its group takes the first point of the next group that has one. That
    is looked up inside runs of FANOUT groups, and over their ends by one row per run.
    """
    none = F.lit(None).cast("long")
    marks = points.select("source", F.col("t").alias("at"), F.col("t").alias("point"), none.alias("of")).unionAll(
        points.select("source", F.col("t") + step, none, F.col("t"))).withColumn("g", floor_div(F.col("at"), step * FANOUT))
    # From the end; of one time, the point comes first.
    order = Window.partitionBy("source", "g").orderBy(F.desc("at"), F.col("of").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    marks = marks.withColumn("next", F.last("point", ignorenulls=True).over(order))
    groups = marks.groupBy("source", "g").agg(F.min("point").alias("first_t")).withColumn("run", floor_div(F.col("g"), FANOUT))
    groups = groups.withColumn("near", _behind(groups, ["source", "run"], "g", "first_t"))
    runs = groups.groupBy("source", "run").agg(F.min("first_t").alias("first_t"))
    runs = runs.select("source", "run", _behind(runs, ["source"], "run", "first_t").alias("far"))
    groups = groups.join(runs, ["source", "run"]).select("source", "g", F.coalesce("near", "far").alias("later"))
    return marks.where("of is not null").join(groups, ["source", "g"]).select(
        "source", F.col("of").alias("t"), F.coalesce("next", "later").alias("next"))


def _linked(nodes: DataFrame, span: int) -> DataFrame:
    """(source, g, nodes) per group of `span`: its nodes in order, each with its time, the place of its
    successor if that is in the group, and the successor's time. A group is bounded by its span."""
    nodes = nodes.withColumn("g", floor_div(F.col("t"), span))
    nodes = nodes.withColumn("place", F.row_number().over(Window.partitionBy("source", "g").orderBy("t")))
    targets = nodes.select("source", F.col("t").alias("next"), "g", F.col("place").alias("next_place"))
    linked = nodes.join(targets, ["source", "g", "next"], "left")
    return linked.groupBy("source", "g").agg(
        F.array_sort(F.collect_list(F.struct("t", "next_place", "next"))).alias("nodes"))


def _entered(groups: DataFrame, entries: DataFrame, span: int) -> DataFrame:
    """Every entry (source, t) beside its group, and its place there."""
    entries = entries.withColumn("g", floor_div(F.col("t"), span))
    return groups.join(entries, ["source", "g"]).withColumn("at", F.array_position("nodes.t", F.col("t")).cast("int"))


def _next_place(place: Column) -> Column:
    return F.element_at("nodes", place)["next_place"]


def _with_neighbours(points: DataFrame, step: int) -> DataFrame:
    """(source, t, before, after): every point with the nearest one before and behind it. They are looked
    for inside groups of FANOUT steps, then in runs of FANOUT groups, then over the runs."""
    rows = points.select("source", "t", floor_div(F.col("t"), step * FANOUT).alias("g"))
    order = Window.partitionBy("source", "g").orderBy("t")
    rows = rows.withColumns({"before": F.lag("t").over(order), "after": F.lead("t").over(order)})
    ends = [F.min("first").alias("first"), F.max("last").alias("last")]
    groups = rows.withColumns({"first": F.col("t"), "last": F.col("t")}).groupBy("source", "g").agg(*ends).withColumn(
        "run", floor_div(F.col("g"), FANOUT))
    order = Window.partitionBy("source", "run").orderBy("g")
    runs = groups.groupBy("source", "run").agg(*ends)
    groups = groups.withColumns({"near_before": F.lag("last").over(order), "near_after": F.lead("first").over(order)})
    order = Window.partitionBy("source").orderBy("run")
    runs = runs.select("source", "run", F.lag("last").over(order).alias("far_before"), F.lead("first").over(order).alias("far_after"))
    groups = groups.join(runs, ["source", "run"]).select(
        "source", "g", F.coalesce("near_before", "far_before").alias("group_before"), F.coalesce("near_after", "far_after").alias("group_after"))
    return rows.join(groups, ["source", "g"]).select(
        "source", "t", F.coalesce("before", "group_before").alias("before"), F.coalesce("after", "group_after").alias("after"))


def _sessions(points: DataFrame, step: int) -> DataFrame:
    """(source, t) with the source made narrower: its points from one that `opens` up to the next such one."""
    upto = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1])
    first, now = Window.unboundedPreceding, Window.currentRow
    rows = points.withColumn("g", floor_div(F.col("t"), step * FANOUT)).withColumn("opened", F.when(F.col("opens"), F.col("t")))
    rows = rows.withColumn("start", F.last("opened", ignorenulls=True).over(upto("source", "g", "t").rowsBetween(first, now)))
    groups = rows.groupBy("source", "g").agg(F.max("opened").alias("opened")).withColumn("run", floor_div(F.col("g"), FANOUT))
    runs = groups.groupBy("source", "run").agg(F.max("opened").alias("opened"))
    groups = groups.withColumn("near", F.last("opened", ignorenulls=True).over(upto("source", "run", "g").rowsBetween(first, -1)))
    runs = runs.select("source", "run", F.last("opened", ignorenulls=True).over(upto("source", "run").rowsBetween(first, -1)).alias("far"))
    groups = groups.join(runs, ["source", "run"]).select("source", "g", F.coalesce("near", "far").alias("earlier"))
    return rows.join(groups, ["source", "g"]).select(
        F.struct("source", F.coalesce("start", "earlier").alias("start")).alias("source"), "t")


def _taken(points: DataFrame, step: int, low: int, high: int) -> DataFrame:
    """(source, t, next) of the points that are met from each source's first by going to the successor.

    A point that lies `step` or more behind the one before it is always met: whatever was met last before
    it, it is that one's successor. So walks are only needed inside sessions, points at closer
    distances from such a point to the next one, and a session of one point needs none.
    """
    near = stored(_with_neighbours(points, step).select(
        "source", "t", "after", F.coalesce(F.col("t") - F.col("before") >= step, F.lit(True)).alias("opens"),
        F.coalesce(F.col("after") - F.col("t") >= step, F.lit(True)).alias("closes")), "neighbours")
    close = near.where("not (opens and closes)")
    if close.isEmpty():
        return near.select("source", "t", F.col("after").alias("next"))
    walked = _chain(stored(_sessions(close, step), "sessions"), step, low, high)
    met = near.where("opens and closes").select("source", "t").unionAll(walked.select("source.source", "t"))
    return _with_neighbours(stored(met, "met"), step).select("source", "t", F.col("after").alias("next"))


def _chain(points: DataFrame, step: int, low: int, high: int) -> DataFrame:
    """(source, t, next) of the points that are met from each source's first by going to the successor.

    Two of them are never in one interval of `step`, so inside a group of FANOUT intervals a walk has
    that many steps at most. Walks from all points at which a group may be entered make the links
    between groups, which are grouped in turn, until a group spans everything or no link leaves one. Then the
    entries that are really met are told from the top down. Work on each level is spread by group, also of one source.
    """
    steps = F.sequence(F.lit(1), F.lit(FANOUT))
    first = points.groupBy("source").agg(F.min("t").alias("t"))
    nodes, span, levels = _successors(points, step), step * FANOUT, []
    while True:
        groups = stored(_linked(nodes, span), "links")
        levels.append((groups, span))
        pointers = groups.select("source", "g", F.explode("nodes").alias("n")).where("n.next is not null and n.next_place is null")
        if low // span == high // span or pointers.isEmpty():
            break
        entries = pointers.select("source", F.col("n.next").alias("t")).unionAll(first).distinct()
        last = F.aggregate(steps, F.col("at"), lambda at, _: F.coalesce(_next_place(at), at))
        nodes = _entered(groups, entries, span).select("source", "t", F.element_at("nodes", last)["next"].alias("next"))
        span *= FANOUT
    met = first
    for groups, span in reversed(levels):
        places = F.aggregate(steps, F.array("at"), lambda met, _: F.when(
            _next_place(F.element_at(met, -1)).isNull(), met).otherwise(F.concat(met, F.array(_next_place(F.element_at(met, -1))))))
        met = _entered(groups, met, span).select("source", F.explode(F.transform(
            places, lambda at: F.element_at("nodes", at))).alias("n")).select("source", "n.t", "n.next")
        full, met = met, met.select("source", "t")
    return full


def samples_from_checkpoints(
    checkpoints: DataFrame, keys: list[str], min_interval_ms: int = 1000,
) -> DataFrame:
    """Rates between recorded checkpoints (`t_ms`, `total` events so far) of each source.

    The first checkpoint of a source is its starting point. A sample is taken at the first
    checkpoint that lies `min_interval_ms` or more behind the last one taken; of checkpoints at
    the same time the largest total counts. Checkpoints without a time are none. Written steps go
    to the shared folder.
    """
    points = stored(checkpoints.where("t_ms is not null").groupBy(
        F.struct(*keys).alias("source"), F.col("t_ms").alias("t")).agg(F.max("total").alias("total")), "checkpoints")
    low, high = points.agg(F.min("t"), F.max("t")).first()
    if low is None:
        return points.select("source.*", F.lit(0).cast("long").alias("sample_no"), F.lit(0.0).alias("rate"))
    # Times from 0 on: all groups above are then one in the end.
    points = points.withColumn("t", F.col("t") - low)
    taken = stored(_taken(points, min_interval_ms, 0, high - low), "taken")
    # Numbers inside runs of time, then over a source's runs.
    run = floor_div(F.col("t"), min_interval_ms * FANOUT * FANOUT)
    runs = taken.groupBy("source", run.alias("run")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("source", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("source", "run").orderBy("t"))
    numbered = taken.withColumn("run", run).withColumn("inside", inside).where("next is not null").join(runs, ["source", "run"])
    ends = points.select("source", F.col("t").alias("next"), F.col("total").alias("next_total"))
    rate = (F.col("next_total") - F.col("total")) / (F.col("next") - F.col("t")) * 1000.0
    return numbered.join(points, ["source", "t"]).join(ends, ["source", "next"]).select(
        "source.*", (F.col("base") + F.col("inside")).alias("sample_no"), rate.alias("rate"))


def steady_state(samples: DataFrame, keys: list[str], sources: DataFrame | None = None) -> DataFrame:
    """Mean rate per source without its first and last sample, if it has three or more.

    Only the samples in between are added up, so that extreme first or last ones leave no trace.
    `sources` lists all sources; those without any sample then report 0.0.
    """
    ends = samples.groupBy(*keys).agg(
        F.min("sample_no").alias("first_no"), F.max("sample_no").alias("last_no"), F.count("*").alias("n"))
    inside = F.expr("n < 3 or (sample_no > first_no and sample_no < last_no)")
    means = samples.join(ends, keys).where(inside).groupBy(*keys).agg(F.avg("rate").alias("steady_rate"))
    if sources is None:
        return means
    return sources.select(*keys).distinct().join(means, keys, "left").withColumn(
        "steady_rate", F.coalesce("steady_rate", F.lit(0.0)))


def run_totals(rates: DataFrame, runs: DataFrame) -> DataFrame:
    """Sum of the steady-state rates per run; runs without any report 0.0."""
    totals = rates.groupBy("run").agg(F.sum("steady_rate").alias("total_throughput"))
    return runs.select("run").join(totals, "run", "left").withColumn(
        "total_throughput", F.coalesce("total_throughput", F.lit(0.0)))
