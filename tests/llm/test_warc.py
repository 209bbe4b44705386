"""Merkle audits against comparing all records."""

import random

from helpers import with_clashes
from pyspark.sql import functions as F

from faregrid.llm import queries, warc

PAGES = "page_id long, url string, html string"


def pages(spark, n=400):
    rng = random.Random(1)
    rows = [(k, f"http://x/{k}", "".join(rng.choice("ab<é😀") for _ in range(rng.randrange(0, 900)))) for k in range(n)]
    rows += [(None, None, None), (7000, None, "url is null"), (7001, "", None), (5, "again", "same id"), (8000, "long", "z" * 300_000)]
    return spark.createDataFrame(rows, PAGES)


def compare(ours, theirs):
    """Records (file, offset, bytes) that one side has and the other has not."""
    sides = [{} for _ in range(2)]
    for side, records in zip(sides, (ours, theirs)):
        for r in records.collect():
            side.setdefault((r.file, r.offset), []).append(bytes(r.record))
    return sorted(k for k in {**sides[0], **sides[1]} if sorted(sides[0].get(k, [])) != sorted(sides[1].get(k, [])))


def damaged(records):
    return records.where("page_id is null or not page_id in (17, 333)").withColumn(
        "record", F.when(F.col("page_id") == 44, F.encode(F.lit("other"), "UTF-8")).otherwise(F.col("record"))).unionByName(
        records.where("page_id = 60").withColumn("offset", F.col("offset") + 10_000_000))


def test_records_follow_each_other(spark):
    ends = {}
    for r in sorted(warc.warc_records(pages(spark)).collect(), key=lambda r: (r.file, r.offset)):
        assert r.offset == ends.get(r.file, 0) and r.length == len(r.record) and bytes(r.record).startswith(b"WARC/1.1\r\n")
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        assert int(head.rsplit(b"Content-Length: ", 1)[1]) == len(body) - 4
        ends[r.file] = r.offset + r.length


def test_damage_is_located(spark):
    ours = warc.warc_records(pages(spark))
    for range_bytes, fanout in ((512, 2), (4096, 8), (1 << 30, 4)):
        files, damage = warc.audit(ours, damaged(ours), range_bytes, fanout)
        found = damage.collect()
        assert sorted((r.file, r.offset) for r in found) == compare(ours, damaged(ours))
        bad = {r.file for r in found}
        for r in files.collect():
            assert (r.our_root != r.their_root) == (r.file in bad)
        assert files.agg(F.sum("our_n")).first()[0] == ours.count()


def test_equal_replicas_and_one_sided_files(spark):
    ours = warc.warc_records(pages(spark))
    files, damage = warc.audit(ours, ours)
    assert damage.count() == 0 and files.where("our_root <> their_root or our_root is null").count() == 0
    part = ours.where("file <> 'pages-000002.warc'")
    files, damage = warc.audit(ours, part, 4096)
    assert damage.count() == ours.count() - part.count() and damage.where("theirs is not null").count() == 0
    assert [r.file for r in files.where("their_root is null").collect()] == ["pages-000002.warc"]


def test_clashing_columns_and_pages_without_id(spark):
    names = ("file", "offset", "length", "record", "node", "hash", "begin", "end", "n", "digest")
    plain, clash = pages(spark), with_clashes(pages(spark), *names)
    assert sorted(map(tuple, warc.warc_records(clash).collect()), key=str) == sorted(map(tuple, warc.warc_records(plain).collect()), key=str)
    nameless = spark.createDataFrame([(None, f"u{k}", "x" * k) for k in range(300)], PAGES)
    ours = warc.warc_records(nameless)
    assert ours.select("file").distinct().count() > 250
    files, damage = warc.audit(ours, ours)
    assert damage.count() == 0 and files.agg(F.sum("our_n")).first()[0] == 300


def test_empty_tables(spark):
    empty = warc.warc_records(spark.createDataFrame([], PAGES))
    files, damage = warc.audit(empty, empty)
    assert files.count() == 0 and damage.count() == 0


def test_query(spark, sf_dir):
    rows = queries.op4_warc_audit(spark, sf_dir).collect()
    ids = [r.page_id for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id").collect()]
    found = sorted(int(x) for r in rows for x in r.page_ids.split(",") if x)
    assert found == sorted(i for i in ids if i % 193 == 101 or i % 97 == 13)
    assert sum(r.n_records for r in rows) == len(ids) and all(r.intact == (r.n_damaged == 0) for r in rows)
