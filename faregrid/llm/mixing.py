"""Mixing sources to target weights: exact block quotas, split over output shards by a tree.

Targets: sources, ordered by name (null last), get weights in turn and share a budget by them;
no target exceeds a multiple of its source's size, and what exceeds it is shared again.

Draw: a source's documents are dealt into blocks of about `block_docs` by hash. Whole passes over
the source come first; the rest of the target is filled by blocks in order, up to the one that
holds the border. In that block documents are taken from the largest down as long as they fit,
and one more if that comes closer. Documents stay whole and are taken `passes` or `passes + 1`
times.

Shards: the drawn block copies of all sources are exact quotas. A binary tree over the output
shards splits them: at each node the left half's share of every source is drawn from the
multivariate hypergeometric distribution, source by source, by inversion. A shard then owns a
range of each source's permuted block copies; ranges are disjoint and cover all. Inside a shard
rows are ordered by a hash.

Everything is DataFrame functions; all draws are hashes of the seed and the documents, so reruns
agree. Per-source rows are joined to documents under a salt, so a hot source is spread.

Rows that repeat id, source and text are counted, and each becomes a unit of its own, dealt and drawn
like any other document; which of the repeated rows a unit stands for is settled when rows are joined.

Cases: null text has size 0; a null source is a source of its own; repeated rows are drawn one by
one; without words all targets are 0; an input column named like a result is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faregrid.llm import common

WORD = r"[^\x20\x09-\x0D]+"
SALTS = 256
#: Blocks whose sizes are summed up before one running sum over a whole source.
GROUP = 256
#: A prime above any 64-bit number of block copies up to 2e18, so that multiples of it permute them.
_STEP = (1 << 61) - 1
#: Repeated rows of which one task makes the units at once.
REPEATS = 4096


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2
    block_docs: int = 16
    shard_words: int = 1 << 19
    seed: int = 7


def _keys(docs: DataFrame) -> dict[str, Column]:
    """A join key for the source (null is a value) and one for the document."""
    return {"skey": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
            "doc_hash": F.xxhash64("doc_id", "text")}


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, skey, doc_hash, size, m, nth, unit), a row per document, written to the shared
    folder: the nth of m rows that repeat each other, and the hash that it is dealt by."""
    same = ["doc_id", "source", "skey", "doc_hash", "size"]
    counted = docs.select(
        "doc_id", "source", *(c.alias(k) for k, c in _keys(docs).items()),
        F.regexp_count(common.whole_text(), F.lit(WORD)).cast("long").alias("size")).groupBy(*same).agg(F.count("*").alias("m"))
    counted = common.stored(counted, "counted")
    few = counted.where(f"m <= {REPEATS}").withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    parts = counted.where(f"m > {REPEATS}").withColumn(
        "part", F.explode(F.expr(f"sequence(0L, (m - 1) div {REPEATS})"))).repartition(*same, "part")
    many = parts.withColumn("nth", F.explode(F.expr(
        f"sequence(part * {REPEATS}, least(m, (part + 1) * {REPEATS}) - 1)"))).drop("part")
    unit = F.when(F.col("nth") == 0, F.col("doc_hash")).otherwise(F.xxhash64("doc_hash", "nth"))
    return common.stored(few.unionByName(many).withColumn("unit", unit), "sized")


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: its size, weight, target, whole passes, rest and number of blocks."""
    sources = sizes.groupBy("skey", "source").agg(
        F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(mix.weights)
    ranked = sources.withColumns({
        "place": F.row_number().over(by_name) - 1,
        "weight": F.element_at(F.array(*map(F.lit, mix.weights)), place + 1).cast("double"),
        "cap": (F.lit(mix.most) * F.col("source_size")).cast("double")})
    # Sources reach their caps in the order of cap / weight. The level that the others share
    # rises with each capped source and would fall with the next one: its highest value holds.
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0.0)
    level = ((F.lit(mix.share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), none))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), none)))
    target = F.least("cap", F.max("level").over(whole) * F.col("weight"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    return ranked.withColumn("level", level).withColumn("target", target).withColumn("passes", passes).select(
        "skey", "place", "source_size", "target", "passes",
        (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"),
        F.ceil(F.col("n_docs") / mix.block_docs).cast("long").alias("n_blocks"))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Joins per-source rows; each source is there once per salt, so none gathers in one task."""
    salted = sources.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("unit", F.lit(SALTS)).cast("int")).join(
        salted, ["skey", "salt"]).drop("salt")


def draw(sizes: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """`sizes` with the source's figures, `block` and `copies`, written to the shared folder."""
    dealt = _with_source(sizes, sources.drop("place")).withColumn(
        "block", F.pmod(F.xxhash64(F.lit(mix.seed), "unit"), F.col("n_blocks")))
    blocks = dealt.groupBy("skey", "block", "rest").agg(F.sum("size").alias("words")).withColumn(
        "part", F.expr(f"block div {GROUP}"))
    # Running sums in two steps: over groups of blocks, then inside a group.
    parts = blocks.groupBy("skey", "part").agg(F.sum("words").alias("words"))
    earlier = Window.partitionBy("skey").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("skey", "part", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("skey", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    lines = blocks.join(parts, ["skey", "part"]).withColumn(
        "before", F.col("base") + F.coalesce(F.sum("words").over(earlier), F.lit(0))).select(
        "skey", "block", (F.col("rest") - F.col("before")).alias("left"),
        (F.col("before") + F.col("words") <= F.col("rest")).alias("inside"))
    lined = common.stored(dealt.join(lines, ["skey", "block"]), "lined")

    border = lined.where("left > 0 and not inside")
    picked = _fill(border).withColumn("picked", F.lit(True))
    drawn = lined.where("not (left > 0 and not inside)").withColumn("picked", F.col("inside")).unionByName(
        border.join(picked, ["skey", "unit"], "left").withColumn("picked", F.coalesce("picked", F.lit(False))))
    return common.stored(drawn.withColumn(
        "copies", F.col("passes") + F.col("picked").cast("long")).drop("left", "inside"), "drawn")


def _fill(border: DataFrame) -> DataFrame:
    """(skey, unit) of the documents taken from each source's border block, a block of about
    `block_docs` documents."""
    lists = border.groupBy("skey", "unit").agg(
        F.sum("size").alias("size"), F.min("left").alias("left")).groupBy("skey").agg(
        F.min("left").alias("left"), F.array_sort(F.collect_list(F.struct(
            (-F.col("size")).alias("minus"), "unit"))).alias("docs"))
    start = F.struct(F.col("left"), F.array().cast("array<bigint>").alias("taken"))

    def step(state: Column, doc: Column) -> Column:
        fits = -doc["minus"] <= state["left"]
        return F.struct(F.when(fits, state["left"] + doc["minus"]).otherwise(state["left"]).alias("left"),
                        F.when(fits, F.concat(state["taken"], F.array(doc["unit"])))
                        .otherwise(state["taken"]).alias("taken"))
    filled = lists.withColumn("end", F.aggregate("docs", start, step))
    # The smallest document left out, if it overshoots by less than what is missing.
    rest = F.filter("docs", lambda d: ~F.array_contains("end.taken", d["unit"]))
    last = F.element_at("rest", -1)
    one_more = (F.size("rest") > 0) & (-last["minus"] < 2 * F.col("end.left"))
    return filled.withColumn("rest", F.when(F.size("docs") > F.size("end.taken"), rest).otherwise(F.filter("docs", lambda d: F.lit(False)))).select(
        "skey", F.explode(F.when(one_more, F.concat("end.taken", F.array(F.expr("rest[size(rest) - 1].unit"))))
                          .otherwise(F.col("end.taken"))).alias("unit"))


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `marked` among `total` are in a draw of `drawn`, by inversion of `u`.

    Weights are relative to the lower end of twelve standard deviations around the mode; what
    lies outside is below the precision of a double.
    """
    n, k, d = (c.cast("double") for c in (total, marked, drawn))
    mode = F.floor((d + 1) * (k + 1) / (n + 2))
    spread = F.ceil(F.sqrt(d * (k / n) * ((n - k) / n) * ((n - d) / F.greatest(n - 1, F.lit(1.0)))) * 12) + 12
    low = F.greatest(F.lit(0), drawn - (total - marked)).cast("long")
    high = F.least(marked, drawn).cast("long")
    bounds = F.array(F.struct(F.greatest(low, (mode - spread).cast("long")).alias("low"),
                              F.least(high, (mode + spread).cast("long")).alias("high")))

    def at(bound: Column) -> Column:
        def next_weight(weight: Column, x: Column) -> Column:
            return weight * (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))
        steps = F.sequence(bound["low"], bound["high"])
        begin = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"))
        sum_ = F.aggregate(steps, begin, lambda s, x: F.struct(
            next_weight(s["weight"], x).alias("weight"), (s["sum"] + s["weight"]).alias("sum")), lambda s: s["sum"])
        walk = F.aggregate(
            steps, F.struct(F.lit(1.0).alias("weight"), (u * sum_).alias("left"), bound["low"].alias("found")),
            lambda s, x: F.struct(
                next_weight(s["weight"], x).alias("weight"), (s["left"] - s["weight"]).alias("left"),
                F.when((s["left"] > 0) & (s["left"] - s["weight"] > 0) & (x < bound["high"]), x + 1)
                .otherwise(s["found"]).alias("found")), lambda s: s["found"])
        return F.when(bound["low"] < bound["high"], walk).otherwise(bound["low"])
    return F.when(total > 0, F.transform(bounds, at)[0]).otherwise(F.lit(0)).cast("long")


def _left_share(seed: int) -> Column:
    """The left half's quotas of a node: one hypergeometric draw per source, each from what the
    sources before it have left over."""
    quotas = F.transform("quotas", lambda q, i: F.struct(q.alias("q"), i.alias("i")))
    begin = F.struct(F.col("n_left").alias("need"), F.col("n_all").alias("pool"),
                     F.array().cast("array<bigint>").alias("out"))

    def step(state: Column, source: Column) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "first", "width", source["i"]), 11).cast("double") + 0.5) / float(1 << 53)
        took = F.array(_hypergeometric(state["pool"], source["q"], state["need"], u))
        return F.transform(took, lambda x: F.struct(
            (state["need"] - x).alias("need"), (state["pool"] - source["q"]).alias("pool"),
            F.concat(state["out"], F.array(x)).alias("out")))[0]
    return F.aggregate(quotas, begin, step, lambda state: state["out"])


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(place, shard, quota) from (place, quota): the exact quotas dealt to equal shards."""
    nodes = quotas.agg(F.array_sort(F.collect_list(F.struct("place", "quota"))).alias("all")).select(
        F.lit(0).alias("first"), F.lit(shards).alias("width"), F.col("all.place").alias("places"),
        F.col("all.quota").alias("quotas"))
    for depth in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        n_all = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        half = nodes.withColumn("n_all", n_all).withColumn("half", F.expr("width div 2")).withColumn(
            "n_left", F.expr("n_all * half div width"))
        left = half.withColumn("left", _left_share(seed))
        right = F.zip_with("quotas", "left", lambda q, x: q - x)
        both = F.array(F.struct("first", F.col("half").alias("width"), "places", F.col("left").alias("quotas")),
                       F.struct((F.col("first") + F.col("half")).alias("first"),
                                (F.col("width") - F.col("half")).alias("width"), "places", right.alias("quotas")))
        nodes = left.select(F.explode(F.filter(both, lambda n: n["width"] > 0)).alias("node")).select("node.*")
        nodes = common.stored(nodes.repartition("first") if depth >= 8 else nodes, "nodes") if depth % 4 == 3 else nodes
    return nodes.select(F.col("first").alias("shard"), F.explode(F.arrays_zip("places", "quotas")).alias("x")).select(
        F.col("x.places").alias("place"), "shard", F.col("x.quotas").alias("quota"))


def place_copies(drawn: DataFrame, sources: DataFrame, mix: Mix) -> DataFrame:
    """(skey, doc_hash, unit, m, nth, copy, shard, mix_order) for every copy that the mix takes."""
    words = drawn.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
    shards = max(1, math.ceil(words / mix.shard_words))
    picks = drawn.groupBy("skey").agg(F.coalesce(F.max(F.when(F.col("picked"), F.col("block"))) + 1, F.lit(0)).alias("n_picked"))
    quotas = common.stored(sources.join(picks, "skey").select(
        "skey", "place", "n_blocks", (F.col("passes") * F.col("n_blocks") + F.col("n_picked")).alias("quota")), "quotas")
    dealt = split_quotas(quotas.select("place", "quota"), shards, mix.seed)
    upto = Window.partitionBy("place").orderBy("shard")
    ranges = dealt.withColumn("end", F.sum("quota").over(upto)).where("quota > 0").join(
        quotas.select("skey", "place", F.expr(f"(quota + {shards - 1}) div {shards}").alias("step")), "place")
    # A range is filed under every stretch of `step` copies that it touches.
    filed = ranges.select("skey", "shard", (F.col("end") - F.col("quota")).alias("begin"), "end", F.explode(F.sequence(
        F.expr("(end - quota) div step"), F.expr("(end - 1) div step"))).alias("stretch"))
    copies = drawn.where("copies > 0").select(
        "skey", "doc_hash", "unit", "m", "nth", "block",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"))
    at = _with_source(copies, quotas.drop("place")).withColumn("at", permuted(mix.seed)).withColumn(
        "stretch", F.expr(f"at div ((quota + {shards - 1}) div {shards})"))
    return at.join(filed, ["skey", "stretch"]).where("at >= begin and at < end").select(
        "skey", "doc_hash", "unit", "m", "nth", "copy", "shard", F.xxhash64(F.lit(mix.seed), "unit", "copy").alias("mix_order"))


def permuted(seed: int) -> Column:
    """Where a block's copy (`copy`, `block` of `n_blocks`) stands among the `quota` of its source.

    Products pass 64 bits for large sources, so they are decimals of up to 38 digits.
    """
    number = "(cast(copy as decimal(18,0)) * cast(n_blocks as decimal(18,0)) + block)"
    return F.expr(f"cast(pmod(cast({number} as decimal(18,0)) * cast({_STEP} as decimal(19,0)) + {seed}, cast(quota as decimal(18,0))) as bigint)")


def plan(docs: DataFrame, mix: Mix = Mix()) -> tuple[DataFrame, DataFrame]:
    """The drawn documents (with size, source_size, target and copies) and their copies' places."""
    sizes = sized(docs)
    sources = common.stored(source_targets(sizes, mix), "sources")
    drawn = draw(sizes, sources, mix)
    return drawn, place_copies(drawn, sources, mix)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with `nth` among those of their (skey, doc_hash), from 0: counted inside partitions, then over
    them, so that one task never holds a whole group."""
    rows = common.stored(rows.withColumn("pid", F.spark_partition_id()), "repeated")
    earlier = Window.partitionBy("skey", "doc_hash").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("skey", "doc_hash", "pid").agg(F.count("*").alias("n")).select(
        "skey", "doc_hash", "pid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("skey", "doc_hash", "pid").orderBy(F.xxhash64("row")))
    return rows.withColumn("inside", inside).join(bases, ["skey", "doc_hash", "pid"]).withColumn(
        "nth", F.col("base") + F.col("inside") - 1).drop("pid", "base", "inside")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """`docs` as the mix has them: each row as often as it is taken, dealt by `shard` and in the
    shard's order, with `shard` and `copy`."""
    _, places = plan(docs, mix)
    places = common.stored(places, "places")
    kept = common.kept_columns(docs, ["shard", "copy"])
    keyed = docs.select(F.struct(*map(common.quoted, kept)).alias("row"), *(c.alias(k) for k, c in _keys(docs).items()))
    out = ["row", "shard", "copy", "mix_order"]
    once = keyed.join(places.where("m = 1"), ["skey", "doc_hash"]).select(*out)
    again = places.where("m > 1")
    numbered = _numbered(keyed.join(again.select("skey", "doc_hash").distinct(), ["skey", "doc_hash"]))
    repeated = numbered.join(again, ["skey", "doc_hash", "nth"]).select(*out)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Shards are about as large as each other; dealt in turn, not by a hash, no task gets several times its share.
    return once.unionAll(repeated).repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "mix_order").select("row.*", "shard", "copy")


def taken(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """What the mix takes of every document, and the shards that hold its copies."""
    drawn, places = plan(docs, mix)
    held = places.groupBy("skey", "unit").agg(F.array_join(F.array_sort(F.collect_list("shard")), ",").alias("shards"))
    return drawn.join(held, ["skey", "unit"], "left").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
        F.coalesce("shards", F.lit("")).alias("shards"))
