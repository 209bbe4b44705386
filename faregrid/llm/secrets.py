"""Secret scans over a trigram inverted index.

Each rule's regular expression yields a Boolean trigram query. The index files every document
under the trigrams of the rule set that its text contains; postings are intersected by
counting, per alternative of a query and document, how many of its trigrams were met. Only
candidates are verified with the expression itself. Rules without mandatory trigrams (runs of
hex digits) scan every text.

Documents are filed under a 64-bit hash of id and text. Equal hashes would merge postings, which
can only add candidates, never lose one. All of it is DataFrame functions.

Cases: a null text is empty; repeated rows each get their row; an input column named like a
result column is replaced. Spans are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faregrid.llm import common
from faregrid.llm.trigrams import ANY, Query, trigram_query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and the fewest characters it may have; a shorter match is
    #: dropped, and the text it took is not searched again.
    group: int = 0
    least: int = 0

    @property
    def query(self) -> Query:
        return trigram_query(self.pattern)


#: The three base rules, then further public token formats.
BASE = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: A PEM key from BEGIN through END. Where END is missing: its headers and its base64 up to the last
#: long run, and what is left of a line behind that. There are no loops over groups without a
#: bound, as Java would follow them by recursion.
PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
    r"(?:[\t\n\r\x20\\nr\"'>#]{0,8}(?:Proc-Type|DEK-Info):[A-Za-z0-9,\x20-]{1,100}){0,4}"
    r"(?:[^-]*-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|[A-Za-z0-9+/=\t\n\r\x20\\\"'>#]*[A-Za-z0-9+/]{40}[A-Za-z0-9+/]*={0,2}(?:(?:\r?\n|\\n)[\t\x20]{0,40}[A-Za-z0-9+/]{1,76}={0,2})?"
    r"|)")
RULES = BASE + (
    Rule("private_key", PRIVATE_KEY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]+"),
)
MASK = "[SECRET]"
_SPAN = "array<struct<start:int,place:int,end:int,kind:string>>"


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(gram, row_key) for the trigrams that the rules ask for, written to the shared folder."""
    grams = sorted({gram for rule in rules for option in rule.query for gram in option})
    # The text is lowered once and bound to a name: a column would be lowered for each trigram.
    lowered = F.array(F.lower(common.whole_text()))
    found = F.transform(lowered, lambda text: F.filter(
        F.array(*map(F.lit, grams)), lambda gram: F.contains(text, gram)))
    return common.stored(docs.select(_row_key().alias("row_key"), F.explode(found[0]).alias("gram")),
                         "trigram-index")


def _row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row_key, kinds): the rules that each document's trigrams allow."""
    asked = [(gram, rule.kind, f"{rule.kind}/{k}", len(option))
             for rule in rules if rule.query != ANY
             for k, option in enumerate(sorted(map(sorted, rule.query))) for gram in option]
    queries = index.sparkSession.createDataFrame(asked, "gram string, kind string, option string, needed int")
    # The rule set bounds the queries, so they may be broadcast.
    met = index.join(F.broadcast(queries), "gram").groupBy("row_key", "kind", "option", "needed").agg(
        F.count_distinct("gram").alias("met"))
    return met.where("met = needed").groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """The rule's spans: pieces between matches and the matches alternate, so their lengths add
    up to positions."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    steps = F.zip_with(
        F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(hits)), F.arrays_zip(hits.alias("hit"), sized.alias("part")),
        lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m["hit"]).alias("hit"), F.length(m["part"]).alias("part")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + m["gap"]
        span = F.struct(start.alias("start"), F.lit(place).alias("place"),
                        (start + m["hit"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((start + m["hit"]).alias("at"),
                        F.when(m["part"] >= rule.least, F.concat(state["found"], F.array(span)))
                        .otherwise(state["found"]).alias("found"))
    return F.aggregate(steps, begin, step, lambda state: state["found"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "secrets") -> DataFrame:
    """`docs` with a column `into`: all spans (start, place of the rule, end, kind), by start and rule."""
    key, kinds = common.free_name(docs, "row_key"), common.free_name(docs, "kinds")
    allowed = candidates(build_index(docs, rules), rules).select(
        F.col("row_key").alias(key), F.col("kinds").alias(kinds))
    text = common.whole_text()
    none = F.array().cast(_SPAN)
    spans = [F.when(text.rlike(rule.pattern) if rule.query == ANY
                    else F.coalesce(F.array_contains(kinds, rule.kind), F.lit(False)),
                    _spans(text, rule, place)).otherwise(none)
             for place, rule in enumerate(rules)]
    kept = common.kept_columns(docs, [into])
    return docs.withColumn(key, _row_key()).join(allowed, key, "left").select(
        *map(common.quoted, kept), F.array_sort(F.concat(*spans)).alias(into))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = MASK) -> DataFrame:
    """`docs` with every found span replaced in `text` (overlapping spans by one mask) and
    `n_chars` counted anew; a document without secrets is unchanged."""
    found = common.free_name(docs, "secrets")
    marked = find_secrets(docs, rules, found)
    text = F.col("text")
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def cut(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        gap = F.substring(text, state["at"] + 1, s["start"] - state["at"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(state["parts"], F.array(gap, F.lit(mask))))
                        .otherwise(state["parts"]).alias("parts"))
    masked = F.aggregate(F.col(found), begin, cut, lambda state: F.concat(
        F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text))))
    out = marked.withColumn("text", F.when(F.size(found) > 0, masked).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*map(common.quoted, docs.columns))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def of_kinds(spans: Column, rules: tuple[Rule, ...]) -> Column:
    return F.filter(spans, lambda s: reduce(lambda a, b: a | b, (s["kind"] == r.kind for r in rules)))
