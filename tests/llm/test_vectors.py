"""Embedding near-duplicates against all cosines."""

import numpy as np
import pyarrow as pa
import pytest

from faregrid.llm import vectors
from faregrid.llm.vectors import Near

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows):
    usable = [(i, np.array(v, np.float32).astype(float), l) for i, v, l in rows
              if i is not None and l is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, root = {}, {i: i for i, _, _ in usable}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, (i, v, l) in enumerate(usable):
        links.setdefault(i, 0)
        for j, w, m in usable[:k]:
            if l == m and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (links.get(i, 0), find(i) if i in root else i) for i, _, _ in rows if i is not None}


def groups(n_groups=12, size=64, noise=0.02, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(n_groups):
        centre = rng.standard_normal(size)
        centre /= np.linalg.norm(centre)
        for _ in range(int(rng.integers(1, 30))):
            v = centre + noise * rng.standard_normal(size)
            rows.append((len(rows), [float(x) for x in v * rng.uniform(0.1, 9)], g % 3))
    return rows


@pytest.mark.parametrize("tile", [1024, 7])
def test_links_and_components(spark, tile):
    rows = groups()
    rows += [(1000 + k, rows[4][1], rows[4][2]) for k in range(5)]              # equal vectors
    rows += [(1100, rows[4][1], (rows[4][2] + 1) % 3), (1101, rows[4][1], None)]  # other label, none
    ones = [1.0] * 64
    rows += [(1200 + k, v, 1) for k, v in enumerate([None, [], [0.0] * 64, [float("nan")] * 64, [float("inf")] + ones[1:],
                                                     [None] + ones[1:], [1.0] * 3, [1.0, 1.0, 1.001], ones, [2.0] * 64, [-1.0] * 64])]
    rows += [(None, ones, 1)]
    found = vectors.near_vectors(spark.createDataFrame(rows, SCHEMA), Near(tile=tile)).collect()
    assert len(found) == len(rows)
    want = expected(rows)
    for r in found:
        if r.vec_id is None:
            assert (r.n_links, r.component_id, r.kept) == (0, None, False)
        else:
            assert (r.n_links, r.component_id) == want[r.vec_id]
            assert r.kept == (r.vec_id == r.component_id)


def test_recall_near_the_threshold(spark):
    """Pairs with cosines just above the threshold: at least nine in ten are found, none below."""
    rng = np.random.default_rng(2)
    rows = []
    for k in range(300):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        cosine = rng.uniform(0.931, 0.95) if k % 3 else rng.uniform(0.9, 0.929)
        rows += [(2 * k, a.tolist(), 0), (2 * k + 1, (cosine * a + np.sqrt(1 - cosine ** 2) * b).tolist(), 0)]
    found = {r.vec_id: r.n_links for r in vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = expected(rows)
    above = [k for k in range(300) if k % 3]
    assert all(found[i] <= want[i][0] for i in found)
    assert sum(found[2 * k] for k in above) >= 0.9 * sum(want[2 * k][0] for k in above)


def test_estimates_are_unbiased(spark):
    """Codes with correction factors estimate inner products without a trend."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.standard_normal(64).tolist(), 0) for k in range(400)]
    items = vectors.coded(vectors.classes(spark.createDataFrame(rows, SCHEMA)), Near()).collect()
    unit = np.array([r.vector for r in items])
    signs = np.unpackbits(np.frombuffer(b"".join(bytes(r.code) for r in items), np.uint8).reshape(-1, 8), axis=1) * 2.0 - 1
    small = np.frombuffer(b"".join(bytes(r.small) for r in items), np.int8).reshape(-1, 64) * np.array([r.scale for r in items])[:, None]
    guess = signs @ small.T / 8 / np.array([r.factor for r in items])[:, None]
    error = (guess - unit @ unit.T)[~np.eye(len(items), dtype=bool)]
    assert abs(error.mean()) < 0.003 and error.std() < 0.12


def test_empty_table_and_other_columns(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    from pyspark.sql import functions as F
    df = spark.createDataFrame(groups(3), SCHEMA).withColumns({c: F.lit("own") for c in ("id", "n", "root", "kept", "own_label")})
    assert vectors.near_vectors(df).columns == ["vec_id", "n_links", "component_id", "kept"]
    assert vectors.near_vectors(df).count() == df.count()


def test_small_buckets_are_compared_together(spark):
    """150 buckets of four: each pair once, and never one bucket at a time."""
    rows = spark.createDataFrame([(k, f"4/{k % 2}", k % 3, k // 24) for k in range(600)], "id long, label string, table int, key int")

    def never(*_):
        raise AssertionError("a small bucket was compared by itself")

    def pairs(tables, columns, first, second):
        ids = columns[0].to_numpy()
        assert (tables == ids % 3).all()
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[first]), pa.array(ids[second]), pa.array(np.full(len(first), len(first)))], names=["u", "v", "n"])

    found = vectors.by_tiles(rows, ["id"], Near(), "u long, v long, n long", never, pairs).collect()
    want = {(a, b) for a in range(600) for b in range(a) if a % 6 == b % 6 and a // 24 == b // 24}
    assert len(found) == len(want) and {(max(r.u, r.v), min(r.u, r.v)) for r in found} == want
    assert sum(r.n == 6 for r in found) <= 4 * 6  # each of four tasks has its last bucket left
