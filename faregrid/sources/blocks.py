"""Line numbers for text files, and the block each source instance reads.

A line's number is the number of lines before its input split, from one count per split, and its place
in the split. Counts can be kept as an index (one row per split, with the listing it was made from),
so that a folder is counted once and blocks are turned into files before any text is read.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faregrid.session import stored

#: With more splits than this (128 TB at 64 MB each) the text is joined by a shuffle.
BROADCAST_SPLITS = 1 << 21
#: What decides where Spark cuts files.
_CUTS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


def _scan(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split_start"))


def placed(lines: DataFrame) -> DataFrame:
    """Adds `pos`: the partition, and the place of the row in it."""
    return lines.withColumn("pos", F.monotonically_increasing_id())


def count_splits(lines: DataFrame, order: Sequence[str] = ("file",)) -> DataFrame:
    """(file, split_start, first_pos, n, first_line) of placed lines, with files in the given order.

    Counts are summed up over files (one row per file), then inside a file.
    """
    counted = stored(lines.groupBy(*dict.fromkeys([*order, "file"]), "split_start").agg(
        F.min("pos").alias("first_pos"), F.count("*").alias("n")), "splits")
    earlier = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    files = counted.groupBy(*dict.fromkeys([*order, "file"])).agg(F.sum("n").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("file").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    return counted.join(files, "file").select(
        "file", "split_start", "first_pos", "n",
        (F.col("base") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("first_line"))


def with_line_numbers(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Placed lines with `line_no`. `splits` must come from a scan that was cut at the same places.

    A partition may read several splits, which the rows' places tell apart. The few numbers per
    split are broadcast within a bound that is counted here, so the text stays where it is.
    """
    shifts = splits.select(
        F.shiftright("first_pos", 33).alias("part"), "first_pos", (F.col("first_pos") + F.col("n") - 1).alias("last_pos"),
        (F.col("first_line") - F.col("first_pos")).alias("shift"))
    if shifts.count() <= BROADCAST_SPLITS:
        shifts = F.broadcast(shifts)
    return (lines.withColumn("part", F.shiftright("pos", 33)).join(shifts, "part")
            .where(F.col("pos").between(F.col("first_pos"), F.col("last_pos")))
            .withColumn("line_no", F.col("pos") + F.col("shift")).drop("pos", "part", "first_pos", "last_pos", "shift"))


def number_lines(spark: SparkSession, path: str, splits: DataFrame | None = None) -> DataFrame:
    """Lines of a text file or folder with `line_no` from 0, in file-name and file order.

    A first scan counts the lines of each input split, unless `splits` holds them; its text is not
    kept. Both scans come from one listing and so have the same splits.
    """
    lines = placed(_scan(spark, path))
    return with_line_numbers(lines, count_splits(lines) if splits is None else splits).select("line_no", "value")


def _listing(spark: SparkSession, path: str) -> DataFrame:
    """Names, sizes and times of the files below `path`; nothing is read from them."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")


def _fingerprint(spark: SparkSession, path: str) -> str:
    """Changes whenever a file or the way files are cut does."""
    n, total = _listing(spark, path).agg(
        F.count("*"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)"))).first()
    cuts = [spark.conf.get(key, None) for key in _CUTS] + [str(spark.sparkContext.defaultParallelism)]
    return f"{n}:{total}:{','.join(map(str, cuts))}"


def index_lines(spark: SparkSession, path: str, index: str) -> None:
    """Counts the lines below `path` and writes the index (file, split_start, first_pos, n,
    first_line, made_from) to `index`."""
    made_from = _fingerprint(spark, path)
    count_splits(placed(_scan(spark, path))).withColumn("made_from", F.lit(made_from)).write.mode("overwrite").parquet(index)


def read_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """The index, after a test that it still fits what lies below `path`."""
    splits = spark.read.parquet(index)
    stale = splits.where(F.col("made_from") != _fingerprint(spark, path)).limit(1).count()
    if stale:
        raise ValueError(f"{index} was made from other files or splits than {path} has now; index it again")
    return splits.drop("made_from")


def files_of(splits: DataFrame, cache_size: int, blocks: Sequence[int]) -> DataFrame:
    """(file, first_line) of the files that hold a line of the given blocks."""
    files = splits.groupBy("file").agg(F.min("first_line").alias("first_line"), F.sum("n").alias("n"))
    wanted = files.sparkSession.createDataFrame([(int(b),) for b in blocks], "block_id long")
    spans = files.where("n > 0").select("file", "first_line", F.explode(F.expr(
        f"sequence(first_line div {cache_size}, (first_line + n - 1) div {cache_size})")).alias("block_id"))
    return spans.join(wanted, "block_id", "left_semi").select("file", "first_line").distinct()


def assign_blocks(lines: DataFrame, cache_size: int) -> DataFrame:
    """Adds `block_id`: source instance i reads raw lines [i * cache_size, (i + 1) * cache_size).

    Bad lines use up the quota, so blocks are cut before parsing.
    """
    if cache_size <= 0:
        raise ValueError("cache_size must be positive")
    return lines.withColumn("block_id", F.expr(f"line_no div {cache_size}"))


def read_blocks(
    spark: SparkSession, path: str, cache_size: int, instances: int | None = None,
    blocks: Sequence[int] | None = None, index: str | None = None,
) -> DataFrame:
    """Numbered lines of the first `instances` blocks, of `blocks`, or of all.

    With an index from `index_lines`, the text is not counted again, and only the files that hold
    wanted blocks are opened at all.
    """
    if instances is not None:
        blocks = [b for b in blocks if b < instances] if blocks is not None else range(instances)
    splits = None if index is None else read_index(spark, path, index)
    if blocks is None or splits is None:
        lines = assign_blocks(number_lines(spark, path, splits), cache_size)
        return lines if blocks is None else lines.where(F.col("block_id").isin(list(blocks)))
    files = files_of(splits, cache_size, blocks).collect()  # as many as will be opened
    if not files:
        return assign_blocks(spark.createDataFrame([], "line_no long, value string"), cache_size)
    lines = placed(_scan(spark, [unquote(row["file"]) for row in files]))
    # The files are cut anew, as there are fewer of them; the index knows where each one begins.
    inside = count_splits(lines)
    begins = inside.groupBy("file").agg(F.min("first_line").alias("begin")).join(
        spark.createDataFrame(files, "file string, first_line long"), "file")
    shifted = inside.join(F.broadcast(begins.select("file", (F.col("first_line") - F.col("begin")).alias("by"))), "file")
    numbered = with_line_numbers(lines, shifted.withColumn("first_line", F.col("first_line") + F.col("by")))
    return assign_blocks(numbered.select("line_no", "value"), cache_size).where(F.col("block_id").isin(list(blocks)))


def cached_events(parsed: DataFrame) -> DataFrame:
    """The bounded cache of each instance: `cache_idx` within the block, and its size.

    `parsed` holds the valid trips with `block_id` and `line_no`. A block has at most
    `cache_size` rows, so the window below is bounded by that parameter.
    """
    block = Window.partitionBy("block_id")
    return parsed.withColumns({
        "cache_idx": F.row_number().over(block.orderBy("line_no")).cast("long") - 1,
        "cache_n": F.count("*").over(block)})
