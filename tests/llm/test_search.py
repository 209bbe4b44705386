"""Ranked search against plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from helpers import empty_documents, odd_documents, with_clashes

from faregrid.llm import search
from faregrid.llm.search import Search

ITEMS = "item_id long, text string"
LOWER = {k: k + 32 for k in range(65, 91)}


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected(docs, items, top=10):
    held = [(doc_id, Counter(t)) for doc_id, text in docs if (t := terms(text))]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in set(items):
        scored = []
        for doc_id, counts in held:
            m = 25 + 75 * sum(counts.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (10 ** 9 * counts[t] // (1000 * counts[t] + 8 * m)) for t in terms(text) if counts[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=str)


WIDE = " ".join(f"w{k}" for k in range(200))
QUERIES = [(1, "licence data river"), (2, "River RIVER, stone!"), (3, None), (4, ""), (5, "no such term"), (6, "中文 ÉTÉ é ñandú"),
           (7, "the of and to licence data token river stone key night a b c"), (7, "the of and to"), (2, "River RIVER, stone!"),
           (None, "key"), (8, WIDE + " river"), (9, "x" * 20_000)]


def tables(spark):
    docs = odd_documents(spark)
    more = [(4000 + k, " ".join(f"w{j}" for j in range(0, 200, k + 1)) + " river" * (k % 3), "en", "s0", 0) for k in range(30)]
    return docs.unionAll(spark.createDataFrame(more, docs.schema)), spark.createDataFrame(QUERIES, ITEMS)


@pytest.mark.parametrize("options", [Search(), Search(top=3), Search(block_items=2, block_docs=7),
                                     Search(block_terms=10, block_postings=50), Search(top=1, block_docs=1)])
def test_matches_plain_python(spark, options):
    docs, items = tables(spark)
    want = expected([(r.doc_id, r.text) for r in docs.collect()], QUERIES, options.top)
    assert found(search.ranked(docs.repartition(3), items, options)) == want
    assert len(want) >= 8 * options.top // 2


def test_groups_are_masks_and_bounds_hold():
    rng = np.random.default_rng(3)
    n, n_terms = 300, 150
    rows = [np.flatnonzero(rng.random(n_terms) < rng.choice([0.01, 0.1, 0.5])) for _ in range(n)]
    counts = [rng.integers(1, 9, len(r)) for r in rows]
    first = np.concatenate(([0], np.cumsum([*map(len, rows)])))
    block = search.Block(np.arange(n), np.zeros(n, bool), rng.integers(26, 400, n), first,
                         np.concatenate(rows), np.concatenate(counts), n_terms)
    for terms_ in (np.arange(5), rng.permutation(n_terms)):
        factors = rng.integers(1, 9000, len(terms_))
        docs, begins, bound = block.groups(terms_, factors)
        masks = [frozenset(rows[d]) & set(terms_) for d in range(n)]
        assert sorted(docs) == [d for d in range(n) if masks[d]]
        seen = set()
        for a, b, most in zip(begins, begins[1:], bound):
            group = {frozenset(masks[d]) for d in docs[a:b]}
            assert len(group) == 1 and not group & seen
            seen |= group
            assert block.scores(docs[a:b], terms_, factors).max() <= most


def test_few_groups_are_scored(monkeypatch):
    """Documents that hold the rare terms settle the result; masks of the common one alone are left."""
    n = 2000
    terms_ = [np.array([0, 1] if k % 100 == 7 else [0]) for k in range(n)]
    first = np.concatenate(([0], np.cumsum([*map(len, terms_)])))
    block = search.Block(np.arange(n), np.zeros(n, bool), np.full(n, 100), first, np.concatenate(terms_), np.ones(first[-1], int), 2)
    scored, scores = [], block.scores
    monkeypatch.setattr(block, "scores", lambda docs, *rest: (scored.extend(docs), scores(docs, *rest))[1])
    assert [d for *_, d in block.best(np.array([0, 1]), np.array([1, 5000]), 10, [])] == [7 + 100 * k for k in range(10)]
    assert len(scored) < 100


def test_empty_tables_and_clashing_columns(spark):
    docs, items = tables(spark)
    none = spark.createDataFrame([], ITEMS)
    for a, b in ((empty_documents(spark), items), (docs, none), (empty_documents(spark), none)):
        assert found(search.ranked(a, b)) == []
    clash = with_clashes(docs, "rank", "score", "item_id", "terms", "n_terms", "place")
    assert found(search.ranked(clash, with_clashes(items, "doc_id", "terms"))) == found(search.ranked(docs, items))
