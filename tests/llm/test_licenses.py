"""License scans against plain Python."""

import math
import random
import re
import textwrap
from collections import Counter

import pytest
from helpers import empty_documents, odd_documents, with_clashes
from pyspark.sql import functions as F

from faregrid.llm import licenses
from faregrid.llm.licenses import Scan


def terms(text):
    return re.findall(licenses.TERM, text.lower())


def own_license(text, texts, scan):
    """The best template over all lines, with all products formed."""
    df = Counter(t for x in texts for t in set(terms(x or "")))
    n = len(texts)
    known = {t for _, c in scan.statements for t in c}

    def weigh(counts):
        return {t: k * (1 + math.log((1 + n) / (1 + (df[t] if t in known else 0)))) for t, k in counts.items()}
    best = []
    for line in (text or "").split("\n"):
        a = weigh(Counter(terms(line)))
        for name, counts in scan.statements:
            b = weigh(counts)
            dot = sum(a[t] * b[t] for t in a.keys() & b.keys())
            if dot:
                cosine = dot / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
                if cosine >= scan.cosine:
                    best.append((-round(cosine, 9), name))
    return min(best, default=(None, None))


@pytest.fixture(scope="module")
def docs(spark):
    docs = odd_documents(spark, 60)
    lines = ["Released under the MIT License.", "x\nLicensed under CC BY-NC 4.0.\ny", "licensed under the apache license, version 2.0",
             "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT license",
             "the license of the river", "SPDX-License-Identifier: Apache-2.0", "a licence to the version of data", "MIT " * 3000 + "License"]
    rows = [(4000 + k, t, None, "s0", 0) for k, t in enumerate(lines)]
    return docs.unionAll(spark.createDataFrame(rows, docs.schema))


def test_own_licenses(docs):
    scan = Scan()
    texts = [r.text for r in docs.collect()]
    rows = licenses.scan_licenses(docs.withColumn("path", F.concat(F.lit("d/"), F.col("doc_id").cast("string")))).collect()
    assert len(rows) == len(texts)
    by_id = {r.doc_id: r.text for r in docs.collect()}
    found = 0
    for r in rows:
        if r.doc_id is not None:
            score, name = own_license(by_id[r.doc_id], texts, scan)
            assert r.own_license == name and (score is None or r.score == pytest.approx(-score))
            found += name is not None
    assert found >= 5


def test_inheritance(spark):
    mit, gpl = "Released under the MIT License", "This work is licensed under the GNU General Public License, version 3"
    rows = [(1, mit, "LICENSE"), (2, "x", "readme"), (3, "x", "a/b/c.txt"), (4, gpl, "a/COPYING.txt"), (5, "x", "a/b/d/e.txt"),
            (6, "x", "z/e.txt"), (7, "no license here", "q/LICENSE"), (8, "x", "q/r/s"), (9, gpl, "z/own.txt"), (10, "x", None),
            (11, mit, "a/b/licence.md"), (12, "x", "a/f"), (13, "Licensed under CC BY 4.0", "a/b/NOTICE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    found = {r.doc_id: (r.license, r.licensed_by) for r in licenses.scan_licenses(docs).collect()}
    assert found == {
        1: ("MIT", "LICENSE"), 2: ("MIT", "LICENSE"), 3: ("CC-BY-4.0", "a/b/NOTICE"), 4: ("GPL-3.0", "a/COPYING.txt"),
        5: ("CC-BY-4.0", "a/b/NOTICE"), 6: ("MIT", "LICENSE"), 7: ("MIT", "LICENSE"), 8: ("MIT", "LICENSE"), 9: ("GPL-3.0", "z/own.txt"),
        10: (None, None), 11: ("MIT", "a/b/licence.md"), 12: ("GPL-3.0", "a/COPYING.txt"), 13: ("CC-BY-4.0", "a/b/NOTICE")}


def wrapped(text, mark, width=60):
    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_whole_files_and_wrapped_headers(spark):
    headers, body = licenses.HEADERS, licenses._body
    prose = "stones and rivers of the night were seen by all who came along the road " * 3
    texts = [
        (body("MIT"), "a.txt", "MIT"), (prose + body("MIT").replace("\n", " ") + prose, "a.txt", "MIT"),
        ("MIT License\n\nCopyright (c) 2020 A. Person\n\n" + body("MIT"), "LICENSE", "MIT"),
        *((body(name), "a.txt", name) for name in licenses.BODIES),
        *((wrapped(text, mark) + "\nimport os\n" + prose, "a.py", name) for name, own in headers.items() for text, mark in zip(own, ["# ", " * "])),
        (wrapped(licenses.TEMPLATES["GPL-3.0"][0], "// ", 30), "a.c", "GPL-3.0"),
        (prose + "Licensed under the Apache License, Version 2.0. " + prose, "a.txt", "Apache-2.0"),
        (prose + "This text is released under the MIT License by its authors. " + prose, "a.txt", "MIT"),
        ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + prose, "COPYING", "GPL-3.0"),
        ("Mozilla Public License Version 2.0\n====\n" + prose, "b/LICENSE.md", "MPL-2.0"),
        ("Mozilla Public License Version 2.0\n====\n" + prose, "b/other.md", None),
        (prose + "a licence to copy, the copyright of the river and the public domain", "a.txt", None), (prose, "LICENSE", None),
        ("license " * 300, "LICENSE", None)]
    rows = [(k, text, f"{k}/{path}") for k, (text, path, _) in enumerate(texts)] + [(1000 + k, prose, f"x/{k}") for k in range(200)]
    rows.append((texts.index(next(t for t in texts if t[1] == "b/LICENSE.md")), texts[-6][0], "c/other.md"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    found = {r.path: (r.own_license, r.score) for r in licenses.scan_licenses(docs).collect()}
    for k, (text, path, name) in enumerate(texts):
        assert found[f"{k}/{path}"][0] == name, (k, path, name, found[f"{k}/{path}"], text[:80])
    assert found["c/other.md"][0] is None


def test_every_title_makes_a_license_file(spark):
    """Also titles that hold no word like license."""
    titles = [(name, text) for name, own in licenses.TITLES.items() for text in own]
    rows = [(k, text + end, f"{k}/{path}") for k, (_, text) in enumerate(titles) for path, end in (("LICENSE", ""), ("copying.md", "\n\nthe river"))]
    rows += [(1000 + k, "stones and rivers of the night", f"x/{k}") for k in range(200)]
    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, path string")).where("doc_id < 1000").collect()
    assert len(found) == 2 * len(titles)
    assert {(r.doc_id, r.own_license) for r in found} == {(k, name) for k, (name, _) in enumerate(titles)}


def test_templates_that_would_not_be_looked_at_are_refused():
    with pytest.raises(ValueError, match="would not be looked at"):
        Scan(headers=(("X", "Attribution 4.0 International"),))


def test_damaged_notices_are_found(spark):
    """One word in ten of the longer notices and short licenses is another one. Windows are placed by a few
    rare terms only; that costs next to none of the passages whose cosine is high enough."""
    rng = random.Random(6)
    scan = Scan()
    long = [own for kind, _, own in scan.longer if kind == "window" and len(own) > licenses.FEW] * 6
    prose = ["stones", "rivers", "night", "road"]
    damaged = [[rng.choice(prose) if rng.random() < 0.1 else t for t in own] for own in long]
    rows = [(k, " ".join([*prose * 20, *words, "license", *prose * 20]), f"{k}/a.txt") for k, words in enumerate(damaged)]
    rows += [(1000 + k, " ".join(prose * 5), f"x/{k}") for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string")
    weights, rare = licenses.term_weights(docs, scan)

    def vector(words):
        return {t: (1 + math.log(n)) * weights.get(t, rare) for t, n in Counter(words).items()}

    def cosine(a, b):
        a, b = vector(a), vector(b)
        return sum(w * b.get(t, 0) for t, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))
    near = [k for k, (own, words) in enumerate(zip(long, damaged)) if cosine(own, words) >= scan.cosine]
    found = {r.doc_id: r.own_license for r in licenses.scan_licenses(docs).collect()}
    assert len(near) >= 0.3 * len(long) and sum(found[k] is not None for k in near) >= 0.95 * len(near)


def test_deep_and_shallow_paths_take_equally_many_jobs(spark):
    """A license at the top, one half way down and 200 levels of directories."""
    jobs = {}
    for depth in (4, 200):
        at = lambda n: "/".join(f"d{k}" for k in range(n))
        rows = [("LICENSE", "MIT", 1.0), (f"{at(depth // 2)}/COPYING", "GPL-3.0", 0.9), (f"{at(depth)}/x.txt", None, None),
                (f"{at(depth // 2 - 1)}/y.txt", None, None), ("z.txt", None, None), ("other/z.txt", None, None)]
        files = spark.createDataFrame(rows, "path string, own_license string, score double")
        spark.sparkContext.setJobGroup(f"depth{depth}", "")
        found = {r.dir: r.license for r in licenses.directory_licenses(files).collect()}
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        jobs[depth] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"depth{depth}"))
        assert found == {"": "MIT", "other": "MIT", at(depth // 2 - 1): "MIT", at(depth // 2): "GPL-3.0", at(depth): "GPL-3.0"}
    assert jobs[4] == jobs[200] > 0


def test_empty_table_and_clashing_columns(spark, docs):
    empty = empty_documents(spark).withColumn("path", F.lit("a/b"))
    assert licenses.scan_licenses(empty).count() == 0
    own = with_clashes(docs, "row_key", "salt", "dir", "license", "score", "dir_license", "line").withColumn("path", F.lit("a/b"))
    rows = licenses.scan_licenses(own)
    assert rows.count() == docs.count() and rows.where("row_key = 'own'").count() == docs.count()


def test_no_python_runs(docs):
    plan = licenses.passages(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
