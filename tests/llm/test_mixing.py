"""The source mix against plain arithmetic."""

import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import empty_documents, odd_documents, with_clashes
from pyspark.sql import functions as F

from faregrid.llm import mixing
from faregrid.llm.mixing import Mix


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water_fill(sizes, weights=(3, 1, 2)):
    """Shares again and again what exceeds a cap."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    budget, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = budget - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return {**fixed, **share}
        fixed.update({s: 2.0 * sizes[s] for s in over})


def check(rows, docs):
    texts = docs.collect()
    sizes, largest = defaultdict(int), defaultdict(int)
    for r in texts:
        sizes[r.source] += size_of(r.text)
        largest[r.source] = max(largest[r.source], size_of(r.text))
    targets = water_fill(dict(sizes))
    by_id, taken = {r.doc_id: r for r in texts}, defaultdict(int)
    for r in rows:
        own = by_id[r.doc_id]
        assert r.taken in (0, r.size, 2 * r.size)
        if r.doc_id is not None:
            assert r.size == size_of(own.text) and r.source_size == sizes[own.source] and r.target == pytest.approx(targets[own.source])
            taken[own.source] += r.taken
    return sizes, targets, taken, largest


def many(spark, n=600):
    rng = random.Random(4)
    rows = [(k, "w " * rng.randrange(0, 60), "en", "hot" if k % 3 == 0 else rng.choice(["a", "b", "Z", "é", None, "tiny"][:5 + (k < 3)]), 0)
            for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_targets_and_draw(spark):
    docs = many(spark)
    rows = mixing.taken(docs).collect()
    assert len(rows) == docs.count()
    sizes, targets, taken, largest = check(rows, docs)
    for source, target in targets.items():
        assert abs(taken[source] - target) <= max(3, 0.01 * sizes[source])
    assert sorted(map(tuple, mixing.taken(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_shards_are_dealt_evenly_to_tasks(spark):
    """By a hash, some tasks had several times as many shards as others."""
    mixed = mixing.mixed(many(spark), Mix(shard_words=1200))
    held = defaultdict(set)
    for r in mixed.select("shard", F.spark_partition_id().alias("task")).distinct().collect():
        held[r.task].add(r.shard)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = sorted(map(len, held.values()))
    assert len(held) == n and sum(sizes) == len(set().union(*held.values())) >= 3 * n and sizes[-1] - sizes[0] <= 1


def test_copies_are_dealt_to_shards_exactly(spark):
    docs = many(spark)
    mix = Mix(shard_words=500)
    drawn, places = mixing.plan(docs, mix)
    want = Counter((r.skey, r.doc_hash) for r in drawn.collect() for _ in range(r.copies))
    at = places.collect()
    assert Counter((r.skey, r.doc_hash) for r in at) == want
    assert len({(r.skey, r.doc_hash, r.copy) for r in at}) == len(at)
    shards = Counter(r.shard for r in at)
    assert len(shards) > 20 and max(shards.values()) < 4 * len(at) / len(shards)
    rows = mixing.mixed(docs, mix).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in drawn.collect() for _ in range(r.copies))


def test_quotas_are_split_without_loss(spark):
    quotas = {0: 1000, 1: 7, 2: 0, 3: 350}
    for shards in (1, 2, 7, 33):
        rows = mixing.split_quotas(spark.createDataFrame(list(quotas.items()), "place int, quota long"), shards, 5).collect()
        got = defaultdict(int)
        per_shard = defaultdict(int)
        for r in rows:
            assert r.quota >= 0
            got[r.place] += r.quota
            per_shard[r.shard] += r.quota
        assert got == quotas and len(per_shard) == shards
        assert max(per_shard.values()) - min(per_shard.values()) <= 6


def test_hypergeometric_draws(spark):
    from pyspark.sql import functions as F
    n = 4000
    draws = spark.range(n).select(mixing._hypergeometric(
        F.lit(60).cast("long"), F.lit(20).cast("long"), F.lit(15).cast("long"), (F.col("id") + 0.5) / n).alias("x"))
    got = Counter(r.x for r in draws.collect())
    from math import comb
    for x in range(16):
        assert abs(got[x] / n - comb(20, x) * comb(40, 15 - x) / comb(60, 15)) < 1.5 / n + 1e-9


def test_odd_rows(spark):
    docs = with_clashes(odd_documents(spark), "salt", "skey", "doc_hash", "copy", "size", "block")
    rows = mixing.taken(docs).collect()
    assert len(rows) == docs.count()
    check(rows, docs)
    mixed = mixing.mixed(docs)
    assert mixed.columns == [c for c in docs.columns if c != "copy"] + ["shard", "copy"]
    copies = Counter(r.doc_id for r in mixed.collect())
    assert all(copies[r.doc_id] == r.taken // r.size for r in rows if r.size and r.doc_id not in (3, None))


@pytest.mark.parametrize("text", ["same " * 11, "other " * 11, "x y z w v u t s r q p", "again " * 11])
def test_repeated_rows_are_drawn_one_by_one(spark, monkeypatch, text):
    """A group of repeated rows with half of a source's words is neither taken nor left as a whole."""
    monkeypatch.setattr(mixing, "REPEATS", 16)
    rows = [(k, "w " * 10, "en", "b", 0) for k in range(100)] + [(500, text, "en", "b", k) for k in range(100)]
    rows += [(1000 + k, "v " * 30, "en", "a", 0) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    found = mixing.taken(docs).collect()
    assert len(found) == len(rows)
    targets = water_fill({"a": 3000, "b": 2100})
    for source, ids in (("a", range(1000, 1100)), ("b", [*range(100), 500])):
        got = sum(r.taken for r in found if r.doc_id in set(ids))
        assert abs(got - targets[source]) <= 0.01 * targets[source]
    # Each of the repeated rows is in the mix as often as one unit was drawn; none is lost or doubled.
    copies = Counter((r.doc_id, r.n_chars) for r in mixing.mixed(docs).collect())
    drawn = Counter(r.taken // 11 for r in found if r.doc_id == 500)
    assert Counter(copies.get((500, k), 0) for k in range(100)) == drawn
    assert sum(n for (i, _), n in copies.items() if i < 100) == sum(r.taken // 10 for r in found if r.doc_id < 100)


def test_permutation_of_many_blocks(spark):
    """Six thousand million blocks, taken up to twice: no overflow, places within the quota, no two alike."""
    n_blocks = 6_000_000_000
    quota = 2 * n_blocks - 12345
    numbers = [(c, b) for c in (0, 1) for b in (0, 1, 2, 4_400_000_000, n_blocks - 20_000, n_blocks - 12_346)]
    rows = spark.createDataFrame(numbers, "copy long, block long").selectExpr("*", f"{n_blocks}L as n_blocks", f"{quota}L as quota")
    got = [r.at for r in rows.select("*", mixing.permuted(7).alias("at")).collect()]
    assert got == [((c * n_blocks + b) * ((1 << 61) - 1) + 7) % quota for c, b in numbers] and len(set(got)) == len(got)
    small = spark.range(1000).selectExpr("0L as copy", "id as block", "1000L as n_blocks", "1000L as quota")
    assert {r.at for r in small.select(mixing.permuted(3).alias("at")).collect()} == set(range(1000))


def test_empty_and_wordless_tables(spark):
    assert mixing.taken(empty_documents(spark)).count() == 0
    assert mixing.mixed(empty_documents(spark)).count() == 0
    docs = spark.createDataFrame([(1, "", "en", "a", 0), (2, None, "en", "b", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert all(r.target == 0 and r.taken == 0 for r in mixing.taken(docs).collect())


def test_no_python_runs(spark):
    plan = mixing.taken(many(spark, 60))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
