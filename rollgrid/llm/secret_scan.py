"""Secret scans over a trigram inverted index, in native DataFrames.

From each rule's expression comes a Boolean trigram query. The index holds, for
each trigram that some query names, the rows whose text has it; a rule's
candidates are the rows on which the posting lists of one of its conjunctions
intersect. Only candidates are tried with the rule's expression itself; a rule
without mandatory trigrams is tried on every text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollgrid.llm.trigrams import ANY, trigram_query

SPAN = "struct<start:int,order:int,kind:string,end:int>"
#: Matches whose places are added up one after the other.
RUN = 256


@dataclass(frozen=True)
class Rule:
    """group: the part of a match that has to have at_least characters (0: all of it)."""

    kind: str
    pattern: str
    group: int
    at_least: int


#: In the order in which spans that start together are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)


def _row_key() -> Column:
    """Rows that share a key by chance are only tried in vain; no result depends on it."""
    return F.xxhash64(F.col("doc_id").cast("string"), "text")


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, row_key: the index of docs for the given trigrams, of lower-case text."""
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select(_row_key().alias("row_key"), F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """row_key, rules: a bit for each rule whose query the row's postings fulfil."""
    asked = [(r, n, sorted(conjunction)) for r, rule in enumerate(rules) for n, conjunction in enumerate(sorted(trigram_query(rule.pattern), key=sorted)) if trigram_query(rule.pattern) != ANY]
    terms = [(r, n, t, 1 << i, (1 << len(c)) - 1) for r, n, c in asked for i, t in enumerate(c)]
    table = docs.sparkSession.createDataFrame(terms, "rule int, conjunction int, trigram string, bit long, full long")
    index = postings(docs, sorted({t for _, _, t, _, _ in terms}))
    met = index.join(F.broadcast(table), "trigram")  # as many rows as the rules have trigrams
    both = met.groupBy("row_key", "rule", "conjunction", "full").agg(F.bit_or("bit").alias("bits")).where("bits = full")
    return both.groupBy("row_key").agg(F.bit_or(F.expr("shiftleft(1, rule)")).alias("rules"))


def _places(items: Column, at: Column, size: Callable[[Column], Column], kind: str, made: Callable[[Column, Column], Column]) -> Column:
    """What made() gives of each item and the place where it starts; the first starts at at, each ends size() later."""
    none = F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("found"))

    def step(state: Column, x: Column) -> Column:
        found = F.array(made(state["at"], x).cast(kind))
        return F.struct((state["at"] + size(x)).alias("at"), F.concat(state["found"], found).alias("found"))

    return F.aggregate(items, none, step, lambda s: s["found"])


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """array<struct<start, order, kind, end>> of a rule's matches that are long enough.

    Places add up the gaps and matches before: of runs of RUN matches first, then within
    each, so that no long array grows by one match at a time.
    """
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = whole if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g))
    zipped = F.arrays_zip(gaps, F.transform(whole, lambda m: F.length(m)), F.transform(part, lambda m: F.length(m)))
    steps = F.transform(zipped, lambda x: F.struct(x["0"].alias("gap"), F.coalesce(x["1"], F.lit(0)).alias("size"), x["2"].alias("part")))
    runs = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(RUN)), lambda i: F.slice(steps, i, F.lit(RUN)))

    def length(x: Column) -> Column:
        return x["gap"] + x["size"]

    def span(at: Column, x: Column) -> Column:
        fields = F.struct((at + x["gap"]).alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), (at + length(x)).alias("end"))
        return F.struct(fields.alias("span"), x["part"].alias("part"))

    starts = _places(runs, F.lit(0), lambda run: F.aggregate(run, F.lit(0), lambda n, x: n + length(x)), "int", lambda at, _: at)
    found = F.flatten(F.zip_with(runs, starts, lambda run, at: _places(run, at, length, f"struct<span:{SPAN},part:int>", span)))
    long_enough = F.transform(F.filter(found, lambda x: x["part"] >= rule.at_least), lambda x: x["span"])
    return F.when(F.rlike(text, pattern), long_enough).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, spans: array<struct<start, order, kind, end>>, for each row of docs (doc_id, text).

    Matches are leftmost and do not overlap within a rule; positions are code
    points, the end exclusive; spans are sorted by start, then by the rules' order.
    A null text counts as empty; repeated rows each return; spans of two rules that
    start together are listed in the rules' order. Very long texts are scanned whole.
    Other columns are not read. An empty table gives no rows.
    """
    found = candidates(docs, rules).select(F.col("row_key").alias("candidate"), "rules")
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("body"), _row_key().alias("row_key"))
    met = rows.join(found.hint("shuffle_hash"), F.col("row_key") == F.col("candidate"), "left")
    parts = []
    for i, rule in enumerate(rules):
        spans = _spans(rule, i, F.col("body"))
        if trigram_query(rule.pattern) != ANY:
            spans = F.when(F.col("rules").bitwiseAND(F.lit(1 << i)) != 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))
        parts.append(spans)
    return met.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def digest_spans(scanned: DataFrame, kinds: tuple[str, ...] = ("assign", "access", "hex")) -> DataFrame:
    """Counts by kind, and the spans as kind:start:end, joined by commas, with their digest."""
    told = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds_found = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds_found) - F.size(F.array_remove(kinds_found, k))).cast("long").alias(f"n_{k}") for k in kinds]
    return scanned.select("doc_id", *counts, F.sha2(told.cast("binary"), 256).alias("base_sha256"), told.alias("spans"))
