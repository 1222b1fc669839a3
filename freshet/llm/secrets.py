"""Secret scanning over a trigram inverted index.

For each rule a Boolean trigram query is derived from its regular expression:
every match must hold all of some trigrams, or those of one of several
alternatives. The index has, for each block of ids, a posting list for each
trigram that some query names; a rule's candidates are intersections and unions
of postings, and only candidates are verified by the regular expression. Rules
without mandatory trigrams scan every text.

Defined results: a null text counts as empty and has no spans. A null id is a
key like any other. Rows that repeat an id are each scanned. Very long texts are
scanned whole, and a span costs the same in a text of many. There are no ties:
spans of one kind never overlap, and they are listed by start, then kind. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .spans import find_spans, listing, sql_listing, sql_spans, tagged

_NULL_KEY = -9223372036854775808
_MOST = 64  # alternatives that a derived clause may hold


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds; ``accept`` (a pattern that the whole match must satisfy) drops failing matches."""

    kind: str
    pattern: str
    accept: str | None = None
    base: bool = False


#: The three base kinds. A match of `assign` must end in a value of twelve characters or more.
_ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?"
)
RULES = (
    Rule("assign", _ASSIGN + r"[A-Za-z0-9+/_.=-]+", _ASSIGN + r"[A-Za-z0-9+/_.=-]{12,}", base=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    # the method's own rules, all with mandatory trigrams
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(pattern: str) -> list[frozenset[frozenset[str]]]:
    """Clauses that all must hold; a clause holds if every trigram of one alternative is there.

    Trigrams are of lower-cased text, so a pattern's letter case doesn't matter.
    An empty list: the pattern has no mandatory trigram.
    """
    clauses: list[frozenset[frozenset[str]]] = []

    def close(strings: set[str]) -> set[str]:
        options = {trigrams(s) for s in strings}
        options = {o for o in options if not any(p < o for p in options)}
        if frozenset() not in options:
            clauses.append(frozenset(options))
        return {""}

    def char_set(items) -> set[str] | None:
        chars: set[str] = set()
        for op, arg in items:
            if op is sre.LITERAL:
                chars.add(chr(arg).lower())
            elif op is sre.RANGE and arg[1] - arg[0] < 8:
                chars |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None

    def alternatives(node) -> set[str] | None:
        """Every string that the node can match, if they are few."""
        op, arg = node
        if op is sre.LITERAL:
            return {chr(arg).lower()}
        if op is sre.IN:
            return char_set(arg)
        if op is sre.SUBPATTERN:
            return strings_of(arg[-1])
        if op is sre.BRANCH:
            sets = [strings_of(branch) for branch in arg[1]]
            return None if None in sets else set().union(*sets)
        if op is sre.MAX_REPEAT and arg[1] <= 2:
            inner = strings_of(arg[2])
            if inner is None:
                return None
            out = {""} if arg[0] == 0 else set()
            power = {""}
            for k in range(1, arg[1] + 1):
                power = {a + b for a in power for b in inner}
                out |= power if k >= arg[0] else set()
            return out
        return None

    def strings_of(nodes) -> set[str] | None:
        out = {""}
        for node in nodes:
            more = alternatives(node)
            if more is None or len(out) * len(more) > _MOST:
                return None
            out = {a + b for a in out for b in more}
        return out

    now = {""}
    for node in sre_parser.parse(pattern):
        more = alternatives(node)
        if more is None:
            now = close(now)
        elif len(now) * len(more) > _MOST:
            now = close(now) and set(more)
        else:
            now = {a + b for a in now for b in more}
    close(now)
    return clauses


def posting_lists(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str], block: int) -> DataFrame:
    """``(block, postings map<trigram, array<key>>)``; a list has at most ``block`` keys."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    there = F.array_compact(F.array(*[F.when(F.col("low").contains(t), F.lit(t)) for t in vocabulary]))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_KEY))
    return (
        docs.select(key.alias("key"), low.alias("low"))
        .select("key", F.explode(there).alias("trigram"))
        .groupBy(F.floor(F.col("key") / block).alias("block"), "trigram")
        .agg(F.array_sort(F.collect_set("key")).alias("keys"))
        .groupBy("block")
        .agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("postings"))
    )


def candidate_keys(postings: Column, clauses: list[frozenset[frozenset[str]]]) -> Column:
    """The query's answer over a block's postings."""
    none = F.array().cast("array<bigint>")

    def lookup(t: str) -> Column:
        return F.coalesce(F.try_element_at(postings, F.lit(t)), none)

    def all_of(option: frozenset[str]) -> Column:
        return reduce(F.array_intersect, [lookup(t) for t in sorted(option)])

    def one_of(clause) -> Column:
        return reduce(F.array_union, [all_of(o) for o in sorted(clause, key=sorted)])

    return reduce(F.array_intersect, [one_of(c) for c in clauses])


def scan_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", block: int = 4096
) -> DataFrame:
    """``id_col`` and, for each rule, the column ``<kind>``: array<struct<start,end,hit,before>>."""
    scratch = Scratch(docs.sparkSession, "secrets")
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    vocabulary = sorted({t for q in queries.values() for c in q for o in c for t in o})
    indexed = [r for r in rules if queries[r.kind]]
    index = posting_lists(docs, id_col, text_col, vocabulary, block)
    found = F.array(
        *[
            F.struct(F.lit(r.kind).alias("kind"), candidate_keys(F.col("postings"), queries[r.kind]).alias("keys"))
            for r in indexed
        ]
    )
    flags = (
        index.select(F.inline(found))
        .select("kind", F.explode("keys").alias("key"))
        .groupBy("key")
        .agg(F.collect_set("kind").alias("try_kinds"))
    )
    flags = scratch.keep(flags, "candidates")

    text = F.coalesce(F.col("text"), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_KEY))
    both = docs.select(F.col(id_col), F.col(text_col).alias("text"), key.alias("key")).join(flags, "key", "left")

    def verified(r: Rule) -> Column:
        spans = find_spans(text, r.pattern)
        if r.accept:
            spans = F.filter(spans, lambda s: s["hit"].rlike(f"^(?:{r.accept})$"))
        if queries[r.kind]:
            spans = F.when(F.array_contains("try_kinds", r.kind), spans)
        return F.coalesce(spans, F.array().cast("array<struct<start:long,end:long,hit:string,before:string>>"))

    return both.select(id_col, *[verified(r).alias(r.kind) for r in rules])


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kinds = [r.kind for r in RULES]
    base = F.concat(*[tagged(F.col(r.kind), k) for k, r in enumerate(RULES) if r.base])
    every = F.concat(*[tagged(F.col(r.kind), k) for k, r in enumerate(RULES)])
    return found.select(
        "doc_id",
        *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in RULES if r.base],
        F.sha2(listing(base, kinds), 256).alias("base_sha256"),
        listing(every, kinds).alias("spans"),
    )


def _sql() -> str:
    quoted = _ASSIGN.replace("'", "''")
    test = {"assign": f"regexp_full_match($h, '{quoted}[A-Za-z0-9+/_.=-]{{12,}}')"}
    lists = {r.kind: sql_spans("t", r.pattern, r.kind, k, test.get(r.kind, "true")) for k, r in enumerate(RULES)}
    base = reduce(lambda a, b: f"list_concat({a}, {b})", [r.kind for r in RULES if r.base])
    every = reduce(lambda a, b: f"list_concat({a}, {b})", [r.kind for r in RULES])
    made = ",\n  ".join(f"{s} AS {k}" for k, s in lists.items())
    counts = ", ".join(f"len({r.kind})::BIGINT AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id,
  {made}
  FROM d)
SELECT doc_id, {counts}, sha256({sql_listing(base)}) AS base_sha256, {sql_listing(every)} AS spans FROM s
"""


SQL = _sql()
