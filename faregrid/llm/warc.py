"""WARC fixity audit: Merkle trees over ordered offset ranges.

The records of a file are cut into ranges of bytes by the offset where they start. A range's
hash covers its records' offsets, lengths and digests in order; `fanout` neighbouring ranges
make a node, and so on up to one root per file. Two replicas are compared by their roots, and
only nodes that differ are followed down to the ranges, whose records are then compared.

Ranges and nodes are found by division, so no file's records are numbered or gathered in one
task; a group never holds more than `fanout` nodes, or the records of one range.

Cases: a null payload is an empty record; a file or range that only one replica has differs;
two records of a replica at one offset are both compared (by digest, in order); a null url is
empty; pages without id are dealt to files of their own by a hash of what they hold; columns are taken by
name and further ones, whatever they are called, are not read; an empty table has no files.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faregrid.llm import common

RANGE_BYTES = 1 << 15
FANOUT = 8
FILE_RECORDS = 64
#: Files that pages without id are dealt to.
NAMELESS_FILES = 1 << 20


def warc_records(pages: DataFrame, per_file: int = FILE_RECORDS) -> DataFrame:
    """(file, offset, length, page_id, record) of WARC files with the pages as response records,
    in the order of page_id, `per_file` ids a file."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")), F.lit("\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    record = F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))
    nameless = F.format_string("pages-none-%05x.warc", F.pmod(F.xxhash64("url", "html"), F.lit(NAMELESS_FILES)))
    file = F.when(F.col("page_id").isNull(), nameless).otherwise(F.format_string("pages-%06d.warc", F.expr(f"page_id div {per_file}")))
    named = pages.select("page_id", file.alias("file"),
                         record.alias("record")).withColumn("length", F.octet_length("record").cast("long"))
    before = Window.partitionBy("file").orderBy("page_id", "record").rowsBetween(Window.unboundedPreceding, -1)
    return named.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def leaves(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, node, hash, begin, end, n) of each range of a replica's files."""
    entry = F.struct("offset", F.sha2("record", 256).alias("digest"), "length")
    return records.groupBy("file", F.expr(f"offset div {range_bytes}").alias("node")).agg(
        F.array_sort(F.collect_list(entry)).alias("entries")).select(
        "file", "node", _hash(F.transform("entries", lambda e: F.concat_ws(
            ":", e["offset"].cast("string"), e["length"].cast("string"), e["digest"]))),
        F.col("entries")[0]["offset"].alias("begin"),
        F.array_max(F.transform("entries", lambda e: e["offset"] + e["length"])).alias("end"),
        F.size("entries").cast("long").alias("n"))


def _hash(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "\n"), 256).alias("hash")


def _parents(nodes: DataFrame, fanout: int) -> DataFrame:
    child = F.struct("node", "hash", "begin", "end", "n")
    return nodes.groupBy("file", F.expr(f"node div {fanout}").alias("node")).agg(
        F.array_sort(F.collect_list(child)).alias("children")).select(
        "file", "node", _hash(F.transform("children", lambda c: F.concat_ws(
            ":", c["node"].cast("string"), c["begin"].cast("string"), c["end"].cast("string"), c["hash"]))),
        F.col("children")[0]["begin"].alias("begin"), F.array_max("children.end").alias("end"),
        F.aggregate("children", F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n"))


def merkle_levels(records: DataFrame, range_bytes: int, fanout: int, height: int) -> list[DataFrame]:
    """The levels of all files' trees, leaves first; the last has a root per file."""
    levels = [common.stored(leaves(records, range_bytes), "merkle-0")]
    for k in range(height):
        levels.append(common.stored(_parents(levels[-1], fanout), f"merkle-{k + 1}"))
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(file, node) where the replicas' nodes differ or only one has the node."""
    a, b = (x.select("file", "node", F.col("hash").alias(name)) for x, name in ((a, "ours"), (b, "theirs")))
    return a.join(b, ["file", "node"], "full").where("not (ours <=> theirs)").select("file", "node")


def audit(ours: DataFrame, theirs: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """(files, damage) for two replicas (file, offset, length, record).

    `files` has a row per file: records, bytes, both roots. `damage` has a row per record that
    the replicas do not share: file, offset, and the digests of either side (null: missing).
    """
    last = max((x.agg(F.max(F.expr(f"offset div {range_bytes}"))).first()[0] or 0) for x in (ours, theirs))
    height = max(1, math.ceil(math.log(last + 1, fanout) - 1e-9)) if last else 1
    a, b = (merkle_levels(x, range_bytes, fanout, height) for x in (ours, theirs))
    front = _differing(a[-1], b[-1])
    for left, right in zip(a[-2::-1], b[-2::-1]):
        front = common.stored(front, "front").withColumnRenamed("node", "up")
        below = [x.withColumn("up", F.expr(f"node div {fanout}")).join(front, ["file", "up"], "left_semi") for x in (left, right)]
        front = _differing(*below)
    front = common.stored(front, "front")

    def suspects(records: DataFrame, name: str) -> DataFrame:
        same = Window.partitionBy("file", "offset").orderBy("digest")
        return records.withColumn("node", F.expr(f"offset div {range_bytes}")).join(front, ["file", "node"], "left_semi").select(
            "file", "offset", F.sha2("record", 256).alias("digest")).select(
            "file", "offset", F.row_number().over(same).alias("copy"), F.col("digest").alias(name))
    damage = suspects(ours, "ours").join(suspects(theirs, "theirs"), ["file", "offset", "copy"], "full").where(
        "not (ours <=> theirs)").select("file", "offset", "ours", "theirs")
    roots = [x[-1].select("file", F.col("hash").alias(f"{side}_root"), F.col("n").alias(f"{side}_n"), F.col("end").alias(f"{side}_end"))
             for x, side in ((a, "our"), (b, "their"))]
    return roots[0].join(roots[1], "file", "full"), damage
