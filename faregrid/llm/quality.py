"""Quality rules: a hashed n-gram log-likelihood ratio beside fixed counts.

Every text is a bag of hashed word n-grams. Two multinomials over the hash buckets are counted,
one over the whole corpus and one over its trusted documents. A text's score is the mean, over
its n-grams, of log(p_trusted / p_corpus), where the text's own n-grams are taken out of both
counts. The trusted documents' own scores say what is usual: a text that lies further below their mean
than a number of their standard deviations is rejected. So nothing depends on the size of the tables.

Cases: a null text is empty (no word, score null, failed by the word count); a text without
n-grams has a null score, which rejects nothing; no trusted document: all scores are null; too few
of them for a spread: no score rejects anything; repeated rows each get their row; an input column named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faregrid.llm import common
from faregrid.llm.common import mixed
from faregrid.llm.words import Words

SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
WINDOW = 8

RESULTS = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()),
           ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()),
           ("base_failed", T.BooleanType()), ("llr", T.DoubleType()), ("kept", T.BooleanType())]


@dataclass(frozen=True)
class QualityRules:
    buckets: int = 1 << 16
    #: All trusted documents count. Up to so many of their ids are broadcast; more of them are joined by a shuffle.
    broadcast_ids: int = 2_000_000
    #: Added to each bucket's counts, as a share of the mean count of the target: n-grams of a few documents
    #: say little.
    smoothing: float = 0.5
    #: A text is rejected so many standard deviations below the mean of the trusted documents.
    spreads: float = 3.0
    #: Fewer trusted documents that pass the counts give no mean and spread.
    least_trusted: int = 20
    min_words: int = 20
    max_repeat_percent: int = 30


def _grams(words: Words, hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and of all word pairs within a text, and each one's text."""
    text = words.text_of_word()
    inside = text[1:] == text[:-1]
    pairs = mixed(hashes[:-1] * np.uint64(3) + hashes[1:])[inside] if len(hashes) else hashes
    bucket = np.concatenate((hashes, pairs)) % np.uint64(buckets)
    return bucket.astype(np.int64), np.concatenate((text, text[1:][inside]))


def _marked(docs: DataFrame, trusted: DataFrame, flag: str) -> DataFrame:
    """`docs` with whether they are trusted. `trusted` carries the broadcast hint if its ids are few enough."""
    ids = trusted.select("doc_id").distinct().withColumn(flag, F.lit(True))
    return docs.join(ids, "doc_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def gram_counts(docs: DataFrame, trusted: DataFrame, rules: QualityRules) -> DataFrame:
    """(bucket, n_corpus, n_trusted) over all documents. A task sends at most one row per bucket,
    however much text it reads."""
    marked = _marked(docs.select("doc_id", "text"), trusted, "is_trusted").select("text", "is_trusted")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, rules.buckets), np.int64)
        for batch in batches:
            flags, at = np.array(batch.column(1).to_pylist(), bool), 0
            for texts in common.text_slices(batch.column(0)):
                words = Words(texts)
                bucket, text = _grams(words, words.hashes(), rules.buckets)
                own = flags[at:at + len(texts)]
                at += len(texts)
                totals[0] += np.bincount(bucket, minlength=rules.buckets)
                if own.any():
                    totals[1] += np.bincount(bucket[own[text]], minlength=rules.buckets)
        found = np.flatnonzero(totals[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(found), pa.array(totals[0][found]), pa.array(totals[1][found])],
            names=["bucket", "n_corpus", "n_trusted"])

    return common.map_arrow(marked, count, "bucket long, n_corpus long, n_trusted long").groupBy(
        "bucket").agg(F.sum("n_corpus").alias("n_corpus"), F.sum("n_trusted").alias("n_trusted"))


def collected(counts: DataFrame, rules: QualityRules) -> np.ndarray:
    """The counts of corpus and trusted documents by bucket.

    Brings one row per bucket to the driver, a number fixed by the parameters.
    """
    totals = np.zeros((2, rules.buckets))
    for row in counts.collect():
        totals[:, row["bucket"]] = row["n_corpus"], row["n_trusted"]
    return totals


def _scores(bucket: np.ndarray, text: np.ndarray, trusted: np.ndarray, totals: np.ndarray,
            rules: QualityRules) -> np.ndarray:
    """Mean log ratios, without each text's own n-grams; NaN if there is nothing to compare."""
    n_texts = len(trusted)
    entries, n = np.unique(text * rules.buckets + bucket, return_counts=True)
    bucket, text = entries % rules.buckets, entries // rules.buckets
    sizes = np.bincount(text, n, n_texts)
    trusted_size, corpus_size = totals[1].sum() - sizes * trusted, totals[0].sum() - sizes
    # The corpus's counts are scaled to the trusted total, so that one smoothing fits both.
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(corpus_size > 0, trusted_size / corpus_size, 0)
    found = totals[1][bucket] - n * trusted[text]
    expected = (totals[0][bucket] - n) * scale[text]
    smoothing = rules.smoothing * np.maximum(trusted_size, 1)[text] / rules.buckets
    ratios = np.log((found + smoothing) / (expected + smoothing))
    total = np.bincount(text, n * ratios, n_texts)
    scores = np.full(n_texts, np.nan)
    np.divide(total, sizes, out=scores, where=(sizes > 0) & (trusted_size > 0))
    return scores


def _dup_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def _covered(texts: list[bytes], words: Words, hashes: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a window of eight words that occurs twice or more.

    Window hashes name the texts that may have such a window; these are then compared word by
    word, so equal hashes alone decide nothing.
    """
    out = np.zeros(len(texts), np.int64)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return out
    text = words.text_of_word()
    windows = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + n]
    windows = mixed(windows + text[:n].astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    windows = windows[text[:n] == text[WINDOW - 1:]]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return out
    inside = np.flatnonzero(text[:n] == text[WINDOW - 1:])
    twice = np.unique(twice)
    place = np.minimum(np.searchsorted(twice, windows), len(twice) - 1)
    for k in np.unique(text[inside[twice[place] == windows]]).tolist():
        out[k] = repeated_words(texts[k].split())
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of eight words that are found twice or more, the first included."""
    ids: dict = {}
    row = [ids.setdefault(w, len(ids)) for w in words]
    seen: dict = {}
    again = set()
    covered = np.zeros(len(row) + 1, np.int64)
    for i, window in enumerate(zip(*(row[k:] for k in range(WINDOW)))):
        first = seen.setdefault(window, i)
        if first != i:
            again.update((first, i))
    for i in again:
        covered[i] += 1
        covered[min(i + WINDOW, len(row))] -= 1
    return int(np.count_nonzero(np.cumsum(covered)[:len(row)]))


def score_floor(docs: DataFrame, totals: np.ndarray, trusted: DataFrame, rules: QualityRules) -> float | None:
    """The score below which a text is rejected, from the trusted documents that pass the counts."""
    texts = _marked(docs.select("doc_id", "text"), trusted, "is_trusted").where("is_trusted").select("doc_id", "text")
    found = apply_rules(texts, totals, trusted, rules, None).where("not base_failed and llr is not null").agg(
        F.count("*").alias("n"), F.avg("llr").alias("mean"), F.stddev_pop("llr").alias("spread")).first()
    # Sums of doubles come in any order: rounded, the floor is the same in every run.
    return None if found["n"] < rules.least_trusted else round(found["mean"] - rules.spreads * found["spread"], 9)


def apply_rules(docs: DataFrame, totals: np.ndarray, trusted: DataFrame, rules: QualityRules, floor: float | None) -> DataFrame:
    """`docs` with the counts, the score and the verdict of every document."""
    kept = common.kept_columns(docs, [name for name, _ in RESULTS])
    at, flag = kept.index("text"), common.free_name(docs, "is_trusted")
    shared = docs.sparkSession.sparkContext.broadcast(totals)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags, done, row = np.array(batch.column(len(kept)).to_pylist(), bool), [], 0
            for texts in common.text_slices(batch.column(at)):
                done.append(_judge(texts, flags[row:row + len(texts)], shared.value, rules, floor))
                row += len(texts)
            columns = [np.concatenate(x) for x in zip(*done)] if done else [[] for _ in RESULTS]
            scores = np.asarray(columns[6], float)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(kept)],
                 *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.bool_()),
                 pa.array(scores, pa.float64(), mask=np.isnan(scores)), pa.array(columns[7], pa.bool_())],
                names=[*kept, *(name for name, _ in RESULTS)])

    marked = _marked(docs.select(*map(common.quoted, kept)), trusted, flag)
    return common.map_arrow(marked.select(*map(common.quoted, kept), flag), judge,
                            common.extended(docs, kept, RESULTS))


def _judge(texts: list[bytes], trusted: np.ndarray, totals: np.ndarray, rules: QualityRules, floor: float | None) -> tuple:
    words = Words(texts)
    hashes = words.hashes()
    n_words = words.counts()
    starts_char = (words.data & 0xC0) != 0x80
    covered = _covered(texts, words, hashes)
    failed = (n_words < rules.min_words) | (100 * covered > rules.max_repeat_percent * n_words)
    scores = np.full(len(texts), np.nan)
    if totals[1].any():
        scores = _scores(*_grams(words, hashes, rules.buckets), trusted, totals, rules)
    return (n_words, words.per_text(starts_char & ~words.space), words.per_text(_IS_SYMBOL[words.data]),
            np.fromiter(map(_dup_lines, texts), np.int64, len(texts)), covered, failed, scores,
            ~failed & ~(scores < (-np.inf if floor is None else floor)))


def trusted_documents(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled as good."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()


def judge_documents(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """All steps: count the two multinomials over `docs`, see how trusted documents score, judge every document."""
    trusted = common.stored(trusted_documents(labels), "trusted")
    if trusted.count() <= rules.broadcast_ids:
        trusted = F.broadcast(trusted)
    totals = collected(gram_counts(docs, trusted, rules), rules)
    return apply_rules(docs, totals, trusted, rules, score_floor(docs, totals, trusted, rules))
