"""The line index: counted once, few files opened, nothing shuffled."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from faregrid.sources import blocks

SIZES = (7, 0, 25, 1, 40, 12)


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    n = 0
    for k, size in enumerate(SIZES):
        (tmp_path / "in" / f"part {k}+.txt").write_text("".join(f"line {n + i}\n" for i in range(size)))
        n += size
    return str(tmp_path / "in"), str(tmp_path / "index")


def lines(df):
    return sorted((r.block_id, r.line_no, r.value) for r in df.collect())


@pytest.mark.parametrize("cut", [None, "64"])
def test_blocks_by_index(spark, folder, cut):
    path, index = folder
    if cut:
        spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
    try:
        blocks.index_lines(spark, path, index)
        whole = [(k // 10, k, f"line {k}") for k in range(sum(SIZES))]
        assert lines(blocks.read_blocks(spark, path, 10, index=index)) == whole
        assert lines(blocks.read_blocks(spark, path, 10)) == whole
        for wanted in ([0], [3, 8], [7], [99], []):
            some = blocks.read_blocks(spark, path, 10, blocks=wanted, index=index)
            assert lines(some) == [r for r in whole if r[0] in wanted]
            held = {k for k in range(len(SIZES)) for n in range(sum(SIZES[:k]), sum(SIZES[:k + 1])) if n // 10 in wanted}
            assert len([f for f in some.inputFiles() if f.endswith(".txt")]) == len(held)
        assert lines(blocks.read_blocks(spark, path, 10, instances=2, index=index)) == whole[:20]
        assert lines(blocks.read_blocks(spark, path, 10, instances=2)) == whole[:20]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_text_is_not_shuffled(spark, folder):
    path, index = folder
    blocks.index_lines(spark, path, index)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (blocks.read_blocks(spark, path, 10), blocks.read_blocks(spark, path, 10, blocks=[3], index=index)):
            text = io.StringIO()
            with contextlib.redirect_stdout(text):
                df.explain()
            plan = text.getvalue().splitlines()
            at = next(k for k, row in enumerate(plan) if "FileScan text" in row)
            above = [row for row in plan[:at] if row.index(row.lstrip(" :+-")[:1] or " ") < plan[at].index("FileScan")]
            assert not any("Exchange" in row for row in above) and any("BroadcastHashJoin" in row for row in above)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_stale_index_is_refused(spark, folder, tmp_path):
    path, index = folder
    blocks.index_lines(spark, path, index)
    (tmp_path / "in" / "part 9.txt").write_text("more\n")
    with pytest.raises(ValueError, match="index it again"):
        blocks.read_blocks(spark, path, 10, index=index)
    blocks.index_lines(spark, path, index)
    assert blocks.read_blocks(spark, path, 10, index=index).agg(F.max("line_no")).first()[0] == sum(SIZES)
