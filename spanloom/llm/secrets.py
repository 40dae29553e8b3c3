"""Secret scans over a block-wise trigram inverted index, with DataFrame functions only.

Each rule's regex is parsed on the driver into a Boolean query over the trigrams
that any match must hold. One pass finds those that a text holds. An index row is
a block of neighbouring documents with a posting list per trigram asked for;
queries intersect and unite posting lists, and the regex then verifies the
candidates' whole texts where they lie. Rules without mandatory trigrams scan
every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flag_keys, stage

#: A block of the index has 2 to this power rows of a partition at most.
BLOCK_BITS = 11
#: Strings that a run of literals and small classes may stand for before it is cut.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed patterns. The first three are the base rules, in their order; the rest add spans.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
EXTRA = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

#: A query is a conjunction of clauses; a clause is a disjunction of trigram sets that must all be there.
Query = list[list[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """What every text with a match must hold, in lower case; empty if nothing is mandatory."""
    exact, query, _ = _walk(sre_parser.parse(pattern))
    return query + _clause(exact)


def _clause(strings: set[str]) -> Query:
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return []
    return [sorted((a for a in sets if not any(b < a for b in sets)), key=sorted)]


def _walk(nodes) -> tuple[set[str], Query, bool]:
    """(strings that what was walked ends in, what holds for the rest, whether those strings are all of it)."""
    exact, query, complete = {""}, [], True

    def cut(then: set[str] = frozenset({""})) -> None:
        nonlocal exact, complete
        query.extend(_clause(exact))
        exact, complete = set(then), False

    def join(strings: set[str]) -> None:
        nonlocal exact
        if len(exact) * len(strings) > MOST_STRINGS:
            cut(strings if len(strings) <= MOST_STRINGS else {""})
        else:
            exact = {a + b for a, b in product(exact, strings)}

    for op, arg in nodes:
        if op is sre.SUBPATTERN or op is sre.BRANCH:
            strings, clauses, known = _walk(arg[-1]) if op is sre.SUBPATTERN else _either(arg[1])
            if known:
                join(strings)
            else:
                cut(strings)
                query.extend(clauses)
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            strings, clauses, known = _walk(inner)
            if known and (low, high) == (0, 1):
                join(strings | {""})
            elif known and low == high and low <= 4:
                for _ in range(low):
                    join(strings)
            else:
                cut()
                if low:
                    query.extend(clauses + _clause(strings))
        elif (strings := _chars(op, arg)) is not None:
            join(strings)
        else:
            cut()
    return exact, query, complete


def _either(branches) -> tuple[set[str], Query, bool]:
    walked = [_walk(b) for b in branches]
    if all(known for _, _, known in walked):
        return set().union(*(s for s, _, _ in walked)), [], True
    whole = [q + _clause(s) for s, q, _ in walked]
    # one clause of each branch is enough; a branch without any asks for nothing
    return {""}, [[x for q in whole for x in q[0]]] if all(whole) else [], False


def _chars(op, arg) -> set[str] | None:
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
        return {chr(a).lower() for _, a in arg}
    return {""} if op is sre.AT else None


def _quoted(c: str) -> str:
    return "\\" + c if c.isascii() and not c.isalnum() and c != "_" else c


def _alternatives(trigrams: list[str]) -> str:
    """A pattern for any of the trigrams that tries common beginnings once."""
    parts = []
    for head in sorted({t[0] for t in trigrams}):
        tails = sorted({t[1:] for t in trigrams if t[0] == head})
        parts.append(_quoted(head) + (_alternatives(tails) if tails != [""] else ""))
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def _overlapping(trigrams: list[str]) -> str:
    """A pattern that matches at each place where a trigram stands, its group 1; most places fail by classes of characters."""
    classes = ["[" + "".join(_quoted(c) for c in sorted({t[i] for t in trigrams})) + "]" for i in range(3)]
    return f"(?={''.join(classes)})(?=({_alternatives(trigrams)}))"


def build_index(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """A row for each block of neighbouring rows: a posting list of keys for each trigram, as columns p0, p1, ..."""
    held = F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(_overlapping(trigrams)), F.lit(1)))
    held = rows.select("key", held.alias("held"), F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block")).where(F.size("held") > 0)
    lists = [F.collect_set(F.when(F.array_contains("held", t), F.col("key"))).alias(f"p{i}") for i, t in enumerate(trigrams)]
    return held.groupBy("block").agg(*lists)


def search(index: DataFrame, trigrams: list[str], queries: dict[int, Query]) -> DataFrame:
    """key of each candidate of any rule."""
    posting = {t: F.col(f"p{i}") for i, t in enumerate(trigrams)}
    both = lambda xs: reduce(F.array_intersect, xs)
    either = lambda xs: reduce(F.array_union, xs)
    found = [both([either([both([posting[t] for t in sorted(s)]) for s in clause]) for clause in query]) for query in queries.values()]
    return index.select(F.explode(either(found)).alias("key"))


def _of_kind(i: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"))


def _spans(rule: Rule, t: Column) -> Column:
    """Spans of a rule's matches in code points: the texts between matches and the matches add up to places."""
    p = F.lit(rule.pattern)
    gaps, whole = F.transform(F.split(t, rule.pattern, -1), F.length), F.transform(F.regexp_extract_all(t, p, F.lit(0)), F.length)
    told = whole if not rule.group else F.transform(F.regexp_extract_all(t, p, F.lit(rule.group)), F.length)
    parts = F.arrays_zip(gaps.alias("gap"), whole.alias("len"), told.alias("told"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        b = a + F.coalesce(x["len"], F.lit(0))
        own = F.array(F.struct(a.alias("start"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(x["told"] >= rule.least, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, start, step)["spans"]


def scan(docs: DataFrame, rules: Sequence[Rule] = BASE + EXTRA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and found: spans (start, kind, end) of every document, by start, then in the rules' order.

    ``kind`` is the rule's number. Null texts are empty and have no spans; null
    and repeated ids are scanned like any other. An empty table gives no rows;
    other columns are ignored. A text's key may collide with another's, and the
    filter that marks candidates may mark others: that only adds a candidate,
    which the regex then rejects. The index holds keys; texts stay where they are.
    """
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for clause in q for s in clause for t in s})
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "t"))
    if queries:
        candidates = search(build_index(rows, trigrams), trigrams, queries)
        rows = flag_keys(rows, "key", stage(candidates, "secret-candidates"), "asked")
    named = []
    for i, rule in enumerate(rules):
        asked = F.col("asked") if i in queries else F.lit(True)
        spans = F.when(asked & F.rlike(F.col("t"), F.lit(rule.pattern)), _spans(rule, F.col("t")))
        named.append(F.transform(F.coalesce(spans, F.array().cast("array<struct<start:int,end:int>>")), _of_kind(i)))
    return rows.select("doc_id", F.array_sort(F.concat(*named)).alias("found"))


def describe(found: Column, rules: Sequence[Rule]) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
