"""License scans: sparse TF-IDF cosines of passages to templates, inherited along paths.

Terms are weighed by their rarity over all documents. Passages are the lines of every text, and
of license files and other texts that name a license or copyright:

* windows of as many terms as a statement, a standard header or a short license has, across lines
  or inside of one: wherever the text has one of a template's seed terms, the window lies as it
  does in the template;
* the head of a license file, compared with titles;
* the whole text, compared with whole licenses, which needs a higher cosine, as they are alike.

By the Cauchy-Schwarz inequality a passage can only reach the wanted cosine if it has one of
a template's heaviest terms, so other lines are dropped before any product is formed, and short
templates have all of those as seeds. Products are sums over a join of terms. In windows and
whole texts the logarithm of a term's count is weighed, for in long texts "the" would decide.

A document keeps the license of its best passage. One without a license has that of the nearest
directory above it whose license file has one: a join of each directory's ancestors' paths with those
that have a license. All of it is DataFrame functions.

Cases: a null text has no passage; of equal cosines the first license by name counts, of several
license files in a directory the one with the best cosine, then name; repeated rows each get
their row; a null path inherits nothing; an input column named like a result is replaced.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faregrid.llm import common

#: Short statements of public licenses.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0",
                   "SPDX-License-Identifier: Apache-2.0"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3",
                "SPDX-License-Identifier: GPL-3.0-only"),
    "MIT": ("Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
                "SPDX-License-Identifier: MPL-2.0"),
}
#: Notices that go over several lines or stand inside of longer ones. Licenses besides those of
#: TEMPLATES are there so that a text of theirs does not pass for the one it resembles.
_GNU = ("This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by"
        " the Free Software Foundation, either version {2} of the License, or (at your option) any later version.")
_CC = ("This work is licensed under the Creative Commons {0} International License. To view a copy of this license,"
       " visit http://creativecommons.org/licenses/{1}/4.0/")
HEADERS = {
    "AGPL-3.0": (_GNU.format("program", "Affero General Public License", "3"), "SPDX-License-Identifier: AGPL-3.0-only"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the"
        " License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by"
        " applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",),
    "CC-BY-4.0": (_CC.format("Attribution 4.0", "by"), "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": (_CC.format("Attribution-NonCommercial 4.0", "by-nc"), "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-NC-SA-4.0": (_CC.format("Attribution-NonCommercial-ShareAlike 4.0", "by-nc-sa"), "Licensed under CC BY-NC-SA 4.0"),
    "CC-BY-SA-4.0": (_CC.format("Attribution-ShareAlike 4.0", "by-sa"), "Licensed under CC BY-SA 4.0"),
    "CC0-1.0": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to"
                " this software to the public domain worldwide. This software is distributed without any warranty.",),
    "GPL-2.0": (_GNU.format("program", "General Public License", "2"), "SPDX-License-Identifier: GPL-2.0-only",
                "This work is licensed under the GNU General Public License, version 2"),
    "GPL-3.0": (_GNU.format("program", "General Public License", "3"),
                "You should have received a copy of the GNU General Public License version 3 along with this program."),
    "LGPL-2.1": (_GNU.format("library", "Lesser General Public License", "2.1"),),
    "LGPL-3.0": (_GNU.format("library", "Lesser General Public License", "3"),),
    "MIT": ("Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
            "This project is licensed under the terms of the MIT License"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not"
                " distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
}
#: How license files begin.
TITLES = {
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",),
    "Apache-2.0": ("Apache License Version 2.0, January 2004", "Apache License 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "CC-BY-4.0": ("Attribution 4.0 International", "Creative Commons Attribution 4.0 International Public License"),
    "CC-BY-NC-4.0": ("Attribution-NonCommercial 4.0 International",
                     "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    "CC-BY-NC-SA-4.0": ("Attribution-NonCommercial-ShareAlike 4.0 International",),
    "CC-BY-SA-4.0": ("Attribution-ShareAlike 4.0 International",),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal"),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991",),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "GNU GENERAL PUBLIC LICENSE"),
    "LGPL-2.1": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",),
    "LGPL-3.0": ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",),
    "MIT": ("MIT License", "The MIT License (MIT)"),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "Mozilla Public License 2.0"),
}
#: Whole licenses, files of `license_texts`.
BODIES = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0")
#: Texts with one of these name a license or copyright. All statements, notices and whole licenses do, which
#: `Scan` tests; titles need not, as license files are always read.
NAMED = ("licen", "copyright", "public domain")
#: Templates up to so many terms are searched by windows as well; above FEW terms they have SEEDS seeds.
WINDOW, FEW, SEEDS = 256, 24, 8
TERM = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.].*)?$"
RESULTS = ["own_license", "score", "license", "licensed_by"]


@lru_cache
def _body(name: str) -> str:
    return pkgutil.get_data("faregrid.llm", f"license_texts/{name}.txt").decode()


def _terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def _pairs(texts: dict[str, tuple[str, ...]]) -> tuple[tuple[str, str], ...]:
    return tuple((name, text) for name, own in texts.items() for text in own)


@dataclass(frozen=True)
class Scan:
    cosine: float = 0.75
    templates: tuple[tuple[str, tuple[str, ...]], ...] = tuple(TEMPLATES.items())

    #: The cosine that a whole text needs.
    whole: float = 0.9
    headers: tuple[tuple[str, str], ...] = _pairs(HEADERS)
    titles: tuple[tuple[str, str], ...] = _pairs(TITLES)
    bodies: tuple[str, ...] = BODIES
    named: tuple[str, ...] = NAMED

    def __post_init__(self) -> None:
        texts = [text for _, own in self.templates for text in own] + [text for _, text in self.headers] + [*map(_body, self.bodies)]
        unnamed = [text[:60] for text in texts if not any(word in text.lower() for word in self.named)]
        if unnamed:
            raise ValueError(f"texts like these would not be looked at, as none of {self.named} is in them: {unnamed}")

    @property
    def longer(self) -> list[tuple[str, str, list[str]]]:
        """(kind, license, terms) of what windows, heads and whole texts are compared with."""
        own = [("window", name, _terms(text)) for name, texts in self.templates for text in texts]
        own += [("window", name, _terms(text)) for name, text in self.headers]
        whole = [("whole", name, _terms(_body(name))) for name in self.bodies]
        own += [("window", name, terms) for _, name, terms in whole if len(terms) <= WINDOW]
        return own + [("head", name, _terms(text)) for name, text in self.titles] + whole

    @property
    def statements(self) -> list[tuple[str, Counter]]:
        return [(name, Counter(re.findall(TERM, text.lower()))) for name, texts in self.templates for text in texts]


def term_weights(docs: DataFrame, scan: Scan) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the templates' terms, and that of a term that no document has.

    Brings one row per template term to the driver.
    """
    terms = sorted({t for _, counts in scan.statements for t in counts} | {t for _, _, own in scan.longer for t in own})
    own = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(common.whole_text()), F.lit(TERM), F.lit(0)), lambda t: t.isin(terms)))
    # An entry for each document itself comes along, so that one pass counts both.
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), own)).alias("term")).groupBy("term").count().collect()
    counts = {row["term"]: row["count"] for row in found}
    n = counts.get("", 0)
    return {t: 1 + math.log((1 + n) / (1 + counts.get(t, 0))) for t in terms}, 1 + math.log(1 + n)


def _needed(vector: dict[str, float], cosine: float) -> list[str]:
    """Terms of which a passage needs one: without a template's heaviest, what it can share is
    too short for the wanted cosine."""
    out = []
    total = left = sum(w * w for w in vector.values())
    for w, t in sorted(((w, t) for t, w in vector.items()), reverse=True):
        if left < cosine ** 2 * total:
            break
        out.append(t)
        left -= w * w
    return out


def _anchors(scan: Scan, weights: dict[str, float]) -> list[str]:
    return sorted({t for _, counts in scan.statements for t in _needed({t: n * weights[t] for t, n in counts.items()}, scan.cosine)})


def _row_key(docs: DataFrame) -> Column:
    """Of rows with equal id and text, license files are told from others."""
    return F.xxhash64("doc_id", "text", _is_file(docs))


def _is_file(docs: DataFrame) -> Column:
    if "path" not in docs.columns:
        return F.lit(False)
    return F.coalesce(F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILE), F.lit(False))


def passages(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """(row_key, line, license, cosine) of every passage that comes close enough to a template;
    `line` is null for those that are not lines."""
    weights, rare = term_weights(docs, scan)
    return _lines(docs, scan, weights, rare).unionByName(_longer(docs, scan, weights, rare))


def _lines(docs: DataFrame, scan: Scan, weights: dict[str, float], rare: float) -> DataFrame:
    known = {t for _, counts in scan.statements for t in counts}
    weights = {t: w for t, w in weights.items() if t in known}
    wanted = F.array(*map(F.lit, _anchors(scan, weights)))
    anchor = r"\b(?:" + "|".join(map(re.escape, _anchors(scan, weights))) + r")\b"
    lines = F.filter(F.split(F.lower(common.whole_text()), "\n"), lambda line: line.rlike(anchor))
    near = docs.where(F.lower(common.whole_text()).rlike(anchor)).select(
        _row_key(docs).alias("row_key"), F.explode(F.array_distinct(lines)).alias("line"))
    terms = near.select("row_key", F.xxhash64("line").alias("line"), F.regexp_extract_all("line", F.lit(TERM), F.lit(0)).alias("terms")).where(
        F.arrays_overlap("terms", wanted)).select("row_key", "line", F.explode("terms").alias("term"))
    counted = common.stored(terms.groupBy("row_key", "line", "term").agg(F.count("*").alias("n")), "passages")
    spark = docs.sparkSession
    vectors = []
    for k, (name, counts) in enumerate(scan.statements):
        size = math.sqrt(sum((n * weights[t]) ** 2 for t, n in counts.items()))
        vectors += [(t, name, k, n * weights[t] / size) for t, n in counts.items()]
    # Both tables are as large as the templates, so they may be broadcast.
    idf = spark.createDataFrame(sorted(weights.items()), "term string, idf double")
    products = spark.createDataFrame(vectors, "term string, license string, statement int, share double")
    weighed = counted.join(F.broadcast(idf), "term", "left").withColumn("weight", F.col("n") * F.coalesce("idf", F.lit(rare)))
    lengths = weighed.groupBy("row_key", "line").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    dots = weighed.join(F.broadcast(products), "term").groupBy("row_key", "line", "license", "statement").agg(
        F.sum(F.col("weight") * F.col("share")).alias("dot"))
    return dots.join(lengths, ["row_key", "line"]).select(
        "row_key", "line", "license", (F.col("dot") / F.col("length")).alias("cosine")).where(F.col("cosine") >= scan.cosine)


def _longer(docs: DataFrame, scan: Scan, weights: dict[str, float], rare: float) -> DataFrame:
    """Windows, heads and whole texts."""
    spark = docs.sparkSession
    lowered = F.lower(common.whole_text())
    named = reduce(lambda a, b: a | b, (F.contains(lowered, F.lit(word)) for word in scan.named))
    # Of a license file that names nothing, only the head is compared: as many terms as the longest title has.
    head = max((len(own) for kind, _, own in scan.longer if kind == "head"), default=0)
    found = F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))
    mark = common.free_name(docs, "named")
    # Distinct, as repeated rows have one key.
    read = common.stored(docs.withColumn(mark, named).where(F.col(mark) | _is_file(docs)).select(
        _row_key(docs).alias("row_key"), _is_file(docs).alias("is_file"), F.col(mark).alias("named"),
        F.posexplode(F.when(F.col(mark), found).otherwise(F.slice(found, 1, head))).alias("pos", "term")).distinct(), "license-terms")
    terms = read.where("named")
    seeds, titles, vectors = [], [], []
    for k, (kind, name, own) in enumerate(scan.longer):
        vector = {t: (1 + math.log(n)) * weights[t] for t, n in Counter(own).items()}
        size = math.sqrt(sum(w * w for w in vector.values()))
        vectors += [(k, t, name, kind, w / size) for t, w in vector.items()]
        if kind == "window":
            if len(own) <= FEW:
                needed = _needed(vector, scan.cosine)
            else:
                needed = sorted(vector, key=lambda t: (own.count(t), -weights[t], t))[:SEEDS]
            seeds += [(t, k, j, len(own)) for j, t in enumerate(own) if t in needed]
        elif kind == "head":
            titles.append((k, len(own)))
    # All three tables are as large as the templates, so they may be broadcast.
    seeds = F.broadcast(spark.createDataFrame(seeds, "term string, k int, j int, n int"))
    idf = F.broadcast(spark.createDataFrame(sorted(weights.items()), "term string, idf double"))
    products = F.broadcast(spark.createDataFrame(vectors, "k int, term string, license string, kind string, share double"))
    names = F.broadcast(spark.createDataFrame(sorted({(k, name) for k, _, name, _, _ in vectors}), "k int, license string"))

    windows = terms.join(seeds, "term").select("row_key", "k", (F.col("pos") - F.col("j")).alias("start"), "n").distinct()
    title = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in titles))).alias("t")
    heads = read.where("is_file and pos = 0").select("row_key", title).select("row_key", "t.k", F.lit(0).alias("start"), "t.n")
    places = windows.unionByName(heads).select("row_key", "k", "start", F.explode(
        F.sequence(F.greatest("start", F.lit(0)), F.col("start") + F.col("n") - 1)).alias("pos"))
    weight = (1 + F.log("n")) * F.coalesce("idf", F.lit(rare))
    counted = places.join(read.select("row_key", "pos", "term"), ["row_key", "pos"]).groupBy("row_key", "k", "start", "term").agg(
        F.count("*").alias("n"))
    near = counted.join(idf, "term", "left").withColumn("weight", weight).join(products.select("k", "term", "share"), ["k", "term"], "left").groupBy(
        "row_key", "k", "start").agg((F.sum(F.col("weight") * F.col("share")) / F.sqrt(F.sum(F.col("weight") * F.col("weight")))).alias("cosine"))
    near = near.where(F.col("cosine") >= scan.cosine).join(names, "k")

    weighed = common.stored(terms.groupBy("row_key", "term").agg(F.count("*").alias("n")).join(idf, "term", "left").select(
        "row_key", "term", weight.alias("weight")), "license-weights")
    lengths = weighed.groupBy("row_key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("length"))
    whole = weighed.join(products.where("kind = 'whole'"), "term").groupBy("row_key", "k", "license").agg(
        F.sum(F.col("weight") * F.col("share")).alias("dot")).join(lengths, "row_key").withColumn(
        "cosine", F.col("dot") / F.col("length")).where(F.col("cosine") >= scan.whole)
    return near.select("row_key", "license", "cosine").unionByName(whole.select("row_key", "license", "cosine")).select(
        "row_key", F.lit(None).cast("long").alias("line"), "license", "cosine")


def own_licenses(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """(row_key, own_license, score) of documents with a passage close enough."""
    # Cosines are compared at nine digits, so that the order of additions decides nothing.
    ranked = passages(docs, scan).groupBy("row_key", "license").agg(F.max(F.round("cosine", 9)).alias("cosine"))
    best = F.min(F.struct((-F.col("cosine")).alias("minus"), "license")).alias("best")
    return ranked.groupBy("row_key").agg(best).select(
        "row_key", F.col("best.license").alias("own_license"), (-F.col("best.minus")).alias("score"))


def _parent(path: Column) -> Column:
    """The directory of a path; the top is empty, above it is nothing."""
    return F.when(path.isNull() | (path == ""), F.lit(None)).when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def directory_licenses(files: DataFrame) -> DataFrame:
    """(dir, license, licensed_by) of each directory that has a license: its own or that of the nearest above.

    Every directory meets those above it in one join, and the deepest one that has a license counts; the
    number of jobs does not depend on how deep paths are.
    """
    named = files.where("own_license is not null").withColumn("dir", _parent(F.col("path"))).where(
        F.regexp_extract("path", "[^/]*$", 0).rlike(LICENSE_FILE))
    own = named.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "own_license", "path")).alias("x")).select(
        F.col("dir").alias("above"), F.col("x.own_license").alias("license"), F.col("x.path").alias("licensed_by"))
    dirs = files.where("path is not null").select(_parent(F.col("path")).alias("dir")).distinct()
    # A path has as many directories above as slashes, besides the top.
    steps = F.split("dir", "/")
    depths = F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(steps)))
    above = dirs.select("dir", F.explode(depths).alias("depth")).withColumn(
        "above", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    # The top's license meets every directory: a skewed join, which Spark splits as it runs. It stays a sorted one:
    # whether it became a broadcast, with a job more, would depend on which side is done first.
    return above.join(own.hint("merge"), "above").groupBy("dir").agg(F.max(F.struct("depth", "license", "licensed_by")).alias("x")).select(
        "dir", "x.license", "x.licensed_by")


def scan_licenses(docs: DataFrame, scan: Scan = Scan()) -> DataFrame:
    """`docs` (with doc_id, text, path) with own_license, score, license and licensed_by (the path
    of the file that says so); the text is left out."""
    kept = [c for c in common.kept_columns(docs, RESULTS) if c != "text"]
    key = common.free_name(docs, "row_key")
    own = own_licenses(docs, scan).withColumnRenamed("row_key", key)
    files = common.stored(docs.select(*map(common.quoted, kept), _row_key(docs).alias(key)).join(own, key, "left"), "license-files")
    names = {c: common.free_name(docs, c) for c in ("dir", "dir_license", "dir_by")}
    dirs = common.stored(directory_licenses(files), "directory-licenses").select(*(F.col(c).alias(names[n]) for c, n in (
        ("dir", "dir"), ("license", "dir_license"), ("licensed_by", "dir_by"))))
    # A directory of very many files makes a skewed join, which Spark splits as it runs.
    return files.withColumn(names["dir"], _parent(F.col("path"))).join(dirs, names["dir"], "left").select(
        *map(common.quoted, kept), "own_license", "score", F.coalesce("own_license", names["dir_license"]).alias("license"),
        F.when(F.col("own_license").isNotNull(), F.col("path")).otherwise(F.col(names["dir_by"])).alias("licensed_by"))
