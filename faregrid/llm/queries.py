"""One registered query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from faregrid.llm import (
    bpe, chat, classifier, common, grammar, licenses, mixing, phrases, quality, search, secrets, simhash, vectors,
    warc)
from faregrid.llm.oracles import ORACLES  # noqa: F401
from faregrid.session import scratch_dir

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return common.read_table(spark, sf, "documents")


def op1_secret_scan(spark, sf):
    spans = F.col("secrets")
    return secrets.find_secrets(_documents(spark, sf).select("doc_id", "text")).select(
        "doc_id", *(secrets.count_kind(spans, r.kind).alias(f"n_{r.kind}") for r in secrets.BASE),
        F.sha2(secrets.listed(secrets.of_kinds(spans, secrets.BASE)), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"))


def op2_bpe(spark, sf):
    path = public_tokenizers.path(BYTE_BPE)
    return bpe.encode(_documents(spark, sf).select("doc_id", "text"), path, decoded="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def _files(docs: DataFrame) -> DataFrame:
    """Documents as files of a tree, directories by ranges of ids: every fourth is its directory's
    license file, every 64th that of the directory above."""
    top = F.concat_ws("/", F.expr("doc_id div 4096"), F.expr("doc_id div 64"))
    leaf = F.concat_ws("/", top, F.expr("doc_id div 4"))
    return docs.select("doc_id", "text", F.when(F.expr("doc_id % 64 = 0"), F.concat_ws("/", top, F.lit("LICENSE")))
                       .when(F.expr("doc_id % 4 = 0"), F.concat_ws("/", leaf, F.lit("LICENSE.txt")))
                       .when(F.col("doc_id").isNotNull(), F.concat_ws("/", leaf, F.concat("doc_id", F.lit(".txt")))).alias("path"))


def op3_license_scan(spark, sf):
    return licenses.scan_licenses(_files(_documents(spark, sf))).withColumn("score", F.round("score", 6))


def _replica(records: DataFrame) -> DataFrame:
    """A replica with damage: one record in 97 has its last byte before the end marks changed,
    one in 193 is missing."""
    size = F.octet_length("record")
    changed = F.concat(F.substring("record", F.lit(1), size - 5), F.encode(F.lit("~"), "UTF-8"), F.substring("record", size - 3, F.lit(4)))
    return records.where("not page_id % 193 = 101").withColumn(
        "record", F.when(F.expr("page_id % 97 = 13"), changed).otherwise(F.col("record")))


def op4_warc_audit(spark, sf):
    records = common.stored(warc.warc_records(common.read_table(spark, sf, "pages")), "warc")
    files, damage = warc.audit(records, _replica(records))
    found = damage.join(records.select("file", "offset", "page_id"), ["file", "offset"], "left").groupBy("file").agg(
        F.count("*").alias("n_damaged"), F.array_join(F.array_sort(F.collect_list("page_id")), ",").alias("page_ids"),
        F.array_join(F.array_sort(F.collect_list("offset")), ",").alias("offsets"))
    return files.join(found, "file", "left").select(
        "file", F.col("our_n").alias("n_records"), F.col("our_end").alias("n_bytes"), "our_root", "their_root",
        F.expr("our_root <=> their_root").alias("intact"), F.coalesce("n_damaged", F.lit(0)).alias("n_damaged"),
        F.coalesce("page_ids", F.lit("")).alias("page_ids"), F.coalesce("offsets", F.lit("")).alias("offsets"))


def op5_quality_rules(spark, sf):
    return quality.judge_documents(
        _documents(spark, sf).select("doc_id", "text"), common.read_table(spark, sf, "labels")).drop("text")


def op6_simhash(spark, sf):
    return simhash.near_duplicates(_documents(spark, sf)).select(
        "doc_id", simhash.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op7_near_vectors(spark, sf):
    return vectors.near_vectors(common.read_table(spark, sf, "embeddings"))


def near_vectors_with_copies(spark, sf):
    """The same over all vectors and slightly changed copies of them, so that there are links: one copy
    of each, and a second one of every fifth."""
    vectors_ = common.read_table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    copies = vectors_.withColumn("k", F.explode(F.when(F.expr("vec_id % 5 = 0"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    changed = copies.select(
        (F.col("vec_id") + F.col("k") * 1_000_000).alias("vec_id"), "label",
        F.transform("embedding", lambda x, i: x * (1 + (((F.col("vec_id") * 31 + i * 17 + F.col("k")) % 7) - 3) / 100.0)).alias("embedding"))
    return vectors.near_vectors(vectors_.unionAll(changed))


def op8_chat(spark, sf):
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    rows = common.read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionAll(more)
    rendered = common.stored(chat.render(chat.fold(chat.conversation_events(rows))), "chat")
    return chat.read_back(rendered)


def op9_token_files(spark, sf):
    path = scratch_dir(spark, "token-files")
    grammar.write_ids(_documents(spark, sf), path, public_tokenizers.path(WORD_BPE))
    return grammar.read_ids(spark.read.parquet(path))


def op10_source_mix(spark, sf):
    return mixing.taken(_documents(spark, sf))


def op11_quality_classifier(spark, sf):
    return classifier.classify(_documents(spark, sf).select("doc_id", "text"), common.read_table(spark, sf, "labels")).drop("text")


def op12_ranked_search(spark, sf):
    return search.ranked(_documents(spark, sf), common.read_table(spark, sf, "benchmark"))


def op13_phrase_collocations(spark, sf):
    return phrases.collocations(_documents(spark, sf))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_bpe": op2_bpe,
    "op3_license_scan": op3_license_scan,
    "op4_warc_audit": op4_warc_audit,
    "op5_quality_rules": op5_quality_rules,
    "op6_simhash": op6_simhash,
    "op7_near_vectors": op7_near_vectors,
    "near_vectors_with_copies": near_vectors_with_copies,
    "op8_chat": op8_chat,
    "op9_token_files": op9_token_files,
    "op10_source_mix": op10_source_mix,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_ranked_search": op12_ranked_search,
    "op13_phrase_collocations": op13_phrase_collocations,
}
