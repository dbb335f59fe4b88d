"""Secret scans by a trigram inverted index, in DataFrame functions only.

`trigram_query` derives from each rule's pattern a Boolean query over trigrams
that any match must contain (lower-cased, so one index serves all rules).  The
index is a written table of posting lists by trigram, read off each text in one
pass.  Lists are intersected from the shortest on, and united, as the queries
say, which leaves candidates; the pattern then runs over the whole texts of
these alone.  A rule without mandatory trigrams runs over every text.  The index
holds the trigrams that rules have asked for, as all trigrams of all texts would
take several times their space; other rules reuse its lists and add new ones.

Postings carry a hash of doc_id and text instead of the text, so building and
intersecting the index moves little.  Candidates are written and counted, and
broadcast to the texts while they fit; beyond that texts are shuffled to them.  Should two rows share a hash, both get the trigrams of both,
which only adds candidates.

Defined results: a null text is empty and has no secrets; null or repeated
doc_ids are separate rows, each with its own result; an empty table gives no
rows; extra columns are ignored by `find_secrets` and kept by `redact`.
"""

from __future__ import annotations

import re
import re._constants as kinds
import re._parser as parser
from dataclasses import dataclass, field
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

#: More alternatives than these aren't spelled out in a trigram query.
MOST_STRINGS = 64
#: Bytes of candidates that are broadcast, and those of one with what a hash table adds.
MOST_BROADCAST, ROW_BYTES = 64_000_000, 64


@dataclass(frozen=True)
class Rule:
    """A match counts if `group` has at least `least` characters.  Letters of a pattern with ignore_case match in either case (A-Z only)."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False


#: Fixed rules.  A run of hex digits is matched whole, so a minimum on its length can stand in the pattern.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)


@dataclass(frozen=True)
class Query:
    """all: every part holds; any: one of them."""

    how: str = "all"
    parts: tuple[Query | str, ...] = field(default=())

    def trigrams(self) -> set[str]:
        return set().union(*({p} if isinstance(p, str) else p.trigrams() for p in self.parts))


def _of_strings(strings: set[str]) -> Query | None:
    """One of the strings occurs; None if some string is too short to say anything."""
    each = []
    for s in sorted(s for s in strings if not any(t != s and t in s for t in strings)):  # what holds s also holds t
        grams = sorted({s[i : i + 3] for i in range(len(s) - 2)})
        if not grams:
            return None
        each.append(Query("all", tuple(grams)))
    return each[0] if len(each) == 1 else Query("any", tuple(each))


def _strings(op, arg) -> set[str] | None:
    """All strings that a part of a pattern matches, lower-cased, or None if there are too many."""
    if op is kinds.LITERAL:
        return {chr(arg).lower()}
    if op is kinds.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is kinds.LITERAL:
                out.add(chr(x).lower())
            elif kind is kinds.RANGE and x[1] - x[0] < MOST_STRINGS:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out
    if op is kinds.SUBPATTERN:
        return _sequence(arg[3])
    if op is kinds.BRANCH:
        each = [_sequence(x) for x in arg[1]]
        return None if None in each else set().union(*each)
    if op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and arg[1] is not kinds.MAXREPEAT:
        one = _sequence(arg[2])
        if one is not None and len(one) ** arg[1] <= MOST_STRINGS:
            return {"".join(x) for n in range(arg[0], arg[1] + 1) for x in product(one, repeat=n)}
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for op, arg in items:
        more = _strings(op, arg)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(items) -> list[Query]:
    """Queries that hold for every match of the items one after another."""
    found: list[Query] = []
    held = {""}

    def flush() -> None:
        nonlocal held
        if (q := _of_strings(held)) is not None:
            found.append(q)
        held = {""}

    for op, arg in items:
        more = _strings(op, arg)
        if more is not None and len(held) * len(more) <= MOST_STRINGS:
            held = {a + b for a in held for b in more}
            continue
        flush()
        if more is not None and len(more) <= MOST_STRINGS:
            held = more
        elif op is kinds.SUBPATTERN:
            found.extend(_query(arg[3]))
        elif op in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and arg[0] > 0:
            found.extend(_query(arg[2]))
        elif op is kinds.BRANCH:
            each = [_query(x) for x in arg[1]]
            if all(each):
                found.append(Query("any", tuple(Query("all", tuple(x)) for x in each)))
    flush()
    return found


def trigram_query(pattern: str) -> Query | None:
    """What any match of the pattern contains, as a query over lower-cased trigrams; None: nothing is certain."""
    found = _query(parser.parse(pattern))
    return Query("all", tuple(found)) if found else None


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def own_trigrams(text: Column, wanted: list[str]) -> Column:
    """Those of the trigrams that the lower-cased text holds, each once: one pass that looks at every position of it."""
    after: dict[str, list[str]] = {}
    for g in sorted(wanted):
        after.setdefault(re.escape(g[0]), []).append(re.escape(g[1:]))
    either = "|".join(f"{first}(?:{'|'.join(rest)})" for first, rest in after.items())
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?=[{''.join(after)}])(?=({either}))"), F.lit(1)))


@dataclass(frozen=True)
class TrigramIndex:
    """Posting lists in a written table (trigram, row_key), sorted by trigram in each file, and the length of each list."""

    postings: DataFrame
    sizes: dict[str, int]

    @classmethod
    def build(cls, rows: DataFrame, trigrams: set[str]) -> TrigramIndex:
        """The lists of these trigrams over rows (row_key, text)."""
        held = rows.select(F.explode(own_trigrams(F.col("text"), list(trigrams))).alias("trigram"), "row_key")
        postings = _shared.materialize(held.sortWithinPartitions("trigram"), "postings")
        counts = postings.groupBy("trigram").agg(F.count("*").alias("n")).collect()  # a row for each trigram of the rules
        return cls(postings, dict.fromkeys(trigrams, 0) | {r.trigram: r.n for r in counts})

    def extended(self, rows: DataFrame, trigrams: set[str]) -> TrigramIndex:
        """The index with the lists that other rules also need; texts are read again for new trigrams alone."""
        new = trigrams - set(self.sizes)
        if not new:
            return self
        more = TrigramIndex.build(rows, new)
        return TrigramIndex(self.postings.unionByName(more.postings), self.sizes | more.sizes)

    def most(self, q: Query | str) -> int:
        """How many rows a query gives at most: the shortest list of 'all', all lists of 'any'."""
        if isinstance(q, str):
            return self.sizes[q]
        return (min if q.how == "all" else sum)(self.most(p) for p in q.parts)

    def rows(self, q: Query | str) -> DataFrame:
        """The row_keys that a query holds for: lists are intersected from the shortest on, and united."""
        if isinstance(q, str):
            return self.postings.where(F.col("trigram") == q).select("row_key")
        each = [self.rows(p) for p in sorted(q.parts, key=self.most)]
        if q.how == "all":
            return reduce(lambda found, more: found.join(more, "row_key", "left_semi"), each)
        return reduce(lambda a, b: a.unionByName(b), each)


def candidates(index: TrigramIndex, queries: dict[str, Query]) -> DataFrame:
    """Rows (row_key, one Boolean by kind) for which some query holds."""
    found = reduce(lambda a, b: a.unionByName(b), (index.rows(q).withColumn("kind", F.lit(k)) for k, q in queries.items()))
    return found.groupBy("row_key").agg(*(F.bool_or(F.col("kind") == k).alias(f"may_{k}") for k in queries))


def _java(rule: Rule) -> str:
    return f"(?i){rule.pattern}" if rule.ignore_case else rule.pattern


def rule_spans(text: Column, rule: Rule, no: int) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind_no, end), in code points, end excluded.

    A text is its unmatched pieces and its matches in turn, so sums of their
    lengths are the positions.
    """
    pattern = F.lit(_java(rule))
    found = F.arrays_zip(
        F.split(text, _java(rule), -1).alias("before"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("part"),
    )
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["before"])
        end = start + F.coalesce(F.length(x["whole"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"))
        keep = F.coalesce(F.length(x["part"]) >= rule.least, F.lit(False))
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(found, start, step, lambda s: s["spans"])


def with_spans(rows: DataFrame, rules: tuple[Rule, ...] = RULES, index: TrigramIndex | None = None) -> DataFrame:
    """Adds spans, an array of structs (start, kind_no, end) in order, to rows with row_key and text; an index of these rows may be given."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    if queries:
        trigrams = set().union(*(q.trigrams() for q in queries.values()))
        may = candidates(index.extended(rows, trigrams) if index else TrigramIndex.build(rows, trigrams), queries)
        # Written first: it is counted, and beyond a broadcast both sides of the join are plain exchanges, whose large partitions Spark splits.
        may = _shared.materialize(may, "candidates")
        few = may.count() * ROW_BYTES <= MOST_BROADCAST
        rows = rows.join(F.broadcast(may) if few else may.hint("shuffle_hash"), "row_key", "left")
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
    each = []
    for no, rule in enumerate(rules):
        goes = F.rlike("text", F.lit(_java(rule)))
        if rule.kind in queries:
            goes = F.coalesce(F.col(f"may_{rule.kind}"), F.lit(False)) & goes
        each.append(F.when(goes, rule_spans(F.col("text"), rule, no)).otherwise(none))
    return rows.withColumn("spans", F.array_sort(F.concat(*each)))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, text, row_key) of documents, which an index is built over."""
    return _shared.texts_of(docs, id_col, text_col).withColumn("row_key", row_key())


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", index: TrigramIndex | None = None) -> DataFrame:
    """A row for each document: doc_id, the number of spans of each kind (n_<kind>), spans as kind:start:end, and their SHA-256."""
    found = with_spans(keyed(docs, id_col, text_col), rules, index)
    names = F.array(*(F.lit(r.kind) for r in rules))
    spelled = F.transform("spans", lambda s: F.concat_ws(":", names[s["kind_no"]], s["start"].cast("string"), s["end"].cast("string")))
    kind_nos = F.transform("spans", lambda s: s["kind_no"])
    counts = [(F.size(kind_nos) - F.size(F.array_remove(kind_nos, no))).cast("long").alias(f"n_{r.kind}") for no, r in enumerate(rules)]
    joined = F.array_join(spelled, ",")
    return found.select("doc_id", *counts, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with each secret, or run of overlapping ones, replaced by mask; other columns stay, null texts too."""
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    packed = docs.select(
        docs[id_col].alias("doc_id"),
        docs[text_col].alias("given"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
        F.struct(F.lit(0).alias("_"), *(docs[c] for c in others)).alias("others"),
    ).withColumn("row_key", row_key())
    done = with_spans(packed, rules)
    text = F.col("text")

    def step(state: Column, s: Column) -> Column:
        fresh = s["start"] >= state["at"]
        added = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, added).otherwise(state["out"]).alias("out"))

    clean = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda st: F.concat(st["out"], F.substring(text, st["at"] + 1, F.length(text))),
    )
    fixed = F.when(F.size("spans") > 0, clean).otherwise(F.col("given"))
    at = {id_col: F.col("doc_id"), text_col: fixed} | {c: F.col("others").getField(c) for c in others}
    return done.select(*(at[c].alias(c) for c in docs.columns))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_shared.read_table(spark, sf_dir, "documents"))


#: Classes spell out both cases of A-Z, as RE2 would also fold letters beyond these.
_ASSIGN = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_SQL_RULES = (
    ("assign", rf"""({_ASSIGN})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)
SQL = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS ("
    + " UNION ALL ".join(
        f"""SELECT r, {no} AS no, '{kind}' AS kind, a, a + length(w) AS b FROM (
    SELECT r, w[i] AS w, g[i] AS g, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x))), 0) AS a
    FROM (SELECT r, p, w, g, unnest(range(1, len(w) + 1)) AS i FROM (
      SELECT r, string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS w, regexp_extract_all(t, '{pattern}', {group}) AS g FROM d)))
  WHERE length(g) >= {least}"""
        for no, (kind, pattern, group, least) in enumerate(_SQL_RULES)
    )
    + """), j AS (
  SELECT r, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, no) AS spans,
    count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex
  FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (r)"""
)
