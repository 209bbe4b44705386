"""Quality rules against plain Python."""

import math
import random
import re
import statistics
from collections import Counter

import pytest
from helpers import empty_documents, odd_documents, with_clashes
from pyspark.sql import functions as F

from faregrid.llm import common, quality
from faregrid.llm.quality import QualityRules
from faregrid.llm.words import Words

LABELS = "doc_id long, quality int, toxic int"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def expected(text):
    words = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_words_match_a_plain_split():
    texts = ["", " ", "a", "a b", "é 中文\x0b😀\x1c x", "\n\n", "a\x85b\xa0c", "ab ab ba"]
    words = Words([t.encode() for t in texts])
    assert words.counts().tolist() == [len(words_of(t)) for t in texts]
    every = [w for t in texts for w in words_of(t)]
    hashes = words.hashes().tolist()
    assert len({*zip(every, hashes)}) == len(set(every)) == len(set(hashes))


def test_counts(spark):
    line = "one two three four five six seven eight nine ten"
    more = [(5000, "\n".join([line] * 4), None, None, 0), (5001, f"{line} # $ {line}\n| <", None, None, 0),
            (5002, "w " * 50, None, None, 0), (5003, "\n \n\n", None, None, 0)]
    rng = random.Random(2)
    more += [(5100 + k, " ".join(rng.choice("BUY!! NOW!! CHEAP!! WIN!! $$$ FREE!!".split()) for _ in range(30)), None, None, 0) for k in range(20)]
    docs = odd_documents(spark)
    docs = docs.unionAll(spark.createDataFrame(more, docs.schema))
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(None, 1, 0), (41, None, None)], LABELS)
    rows = quality.judge_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    usual = [r.llr for r in rows if r.doc_id is not None and r.doc_id < 40 and not r.base_failed and r.llr is not None]
    floor = sum(usual) / len(usual) - 3 * statistics.pstdev(usual)
    assert len(usual) >= 20 and sum(not r.kept for r in rows) > sum(r.base_failed for r in rows)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == expected(r.text)
        assert r.kept == (not r.base_failed and not (r.llr is not None and r.llr < floor))


def test_score_is_the_mean_log_ratio(spark):
    good, bad = "alpha beta gamma delta " * 8, "BUY!! NOW!! BUY!! CHEAP!! " * 8
    docs = spark.createDataFrame([(k, good if k < 5 else bad) for k in range(10)] + [(99, "")], "doc_id long, text string")
    rules = QualityRules(buckets=1 << 14, smoothing=300.0)
    labels = spark.createDataFrame([(k, int(k < 3), 0) for k in range(10)], LABELS)
    rows = {r.doc_id: r for r in quality.judge_documents(docs, labels, rules).collect()}

    def grams(text):
        words = words_of(text)
        return [*words, *zip(words, words[1:])]
    for doc_id in (1, 4, 7):
        own = grams(good if doc_id < 5 else bad)
        corpus, trusted = Counter(), Counter()
        for k in range(10):
            if k != doc_id:  # the text itself is taken out
                corpus.update(grams(good if k < 5 else bad))
                trusted.update(grams(good) if k < 3 else [])
        scale = sum(trusted.values()) / sum(corpus.values())
        add = 300 * sum(trusted.values()) / (1 << 14)
        want = sum(math.log((trusted[g] + add) / (corpus[g] * scale + add)) for g in own) / len(own)
        assert rows[doc_id].llr == pytest.approx(want)
    assert rows[7].llr < 0 < rows[1].llr and rows[99].llr is None


def test_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], LABELS)
    assert quality.judge_documents(empty_documents(spark), none).count() == 0
    docs = with_clashes(odd_documents(spark, 20), "is_trusted", "bucket", "llr", "kept", "count")
    rows = quality.judge_documents(docs, none).collect()
    assert len(rows) == docs.count() and all(r.llr is None and r.bucket == "own" for r in rows)
    assert all(r.kept is not r.base_failed for r in rows)


@pytest.mark.parametrize("sf, junk_kept", [("sf0.01", 0.2), ("sf0.1", 0.05)])
def test_junk_is_told_from_held_out_good_text(spark, sf_dir, sf, junk_kept):
    docs, labels = (common.read_table(spark, sf_dir.replace("sf0.001", sf), name) for name in ("documents", "labels"))
    learned = labels.where("doc_id % 2 = 0")
    held = quality.judge_documents(docs, learned).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good, junk = ([r for r in held if r.quality == q] for q in (1, 0))
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(r.kept for r in junk) <= junk_kept * len(junk)
    assert sum(r.llr for r in junk) / len(junk) < sum(r.llr for r in good) / len(good) - 0.5


def test_all_trusted_documents_count(spark):
    """More of them than were once taken; also with ids that are joined by a shuffle."""
    n = 20_100
    words = "some plain words of a text that is long enough to pass every count there is in this test"
    docs = spark.range(n + 400).select(F.col("id").alias("doc_id"), F.format_string(f"%d a{n} b%d {words}", "id", F.col("id") % 7).alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    ids = quality.trusted_documents(labels)
    counts = quality.collected(quality.gram_counts(docs, ids, QualityRules()), QualityRules()).sum(axis=1)
    assert ids.count() == n and counts[1] * (n + 400) == counts[0] * n  # every text has equally many n-grams
    some = docs.where(F.col("doc_id") % 100 == 0)
    rows = [sorted(quality.judge_documents(some, labels, rules).collect()) for rules in (QualityRules(), QualityRules(broadcast_ids=0))]
    assert rows[0] == rows[1] and len(rows[0]) == 205


def test_few_trusted_documents_reject_nothing_by_score(spark):
    docs = spark.createDataFrame([(k, f"word{k} " + "some plain words of a text " * 4) for k in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(5)], LABELS)
    assert all(r.kept is not r.base_failed for r in quality.judge_documents(docs, labels).collect())
