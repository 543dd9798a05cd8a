"""Secret scans through a trigram inverted index, with DataFrame functions only.

Every rule's regular expression gives a Boolean trigram query: an AND of ORs of ANDs of trigrams that any match has to contain. The index
keeps a posting (trigram, document) for the trigrams that some query names. Postings are intersected by document, the queries decided on
what a document has, and the rules that pass are verified on the whole text. Rules without a mandatory trigram scan every text.

Defined results: a private key without an END line is taken for 400 lines at most; a null text is empty and has no spans; texts of any
length are scanned in whole; rows are scanned one by one, so equal rows get equal results, also where ids repeat; rows without an id are
scanned by every rule; positions are code points, ends exclusive; matches of a rule are leftmost and do not overlap; spans of different
rules may overlap and are all given, by start, then in the rules' order; an empty table gives an empty result. Columns of the input
besides id and text are kept as they are, but for one called spans.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from re import _constants as sre
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.llm.store import settle


@dataclass(frozen=True)
class Rule:
    """kind: its name; pattern: understood alike by Python and Java; group: whose length counts; least: its least length in code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The three base kinds.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of fewer digits holds no match, so this finds what [0-9a-f]+ and the least length find
)
_KEY = r"(?:(?:RSA |EC |OPENSSH |DSA |ENCRYPTED )?PRIVATE KEY|PGP PRIVATE KEY BLOCK)-----"
#: Kinds that the method adds. A private key goes on to its END line, over base64, headers and the escaped line ends of quoted texts; where it
#: has no such line, over the lines of base64 that follow. Only character classes repeat without bound, as Java recurses on groups.
MORE = (
    Rule("private_key", rf"""-----BEGIN {_KEY}(?:[A-Za-z0-9+/=\x20\t\r\n:,.()@<>_"'\\-]*?-----END {_KEY}|(?:(?:[\x20\t\r\n"'+]|\\[nr]){{1,16}}[A-Za-z0-9+/=]{{40,}}){{0,400}}(?:(?:[\x20\t]?\r?\n|\\n)[A-Za-z0-9+/]{{1,39}}={{1,2}})?)"""),
    Rule("hub_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z]{2,12}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)
RULES = BASE + MORE

#: A query is a list of clauses, all needed; a clause is a list of alternatives; an alternative is the set of trigrams of one string.
Query = tuple[tuple[frozenset[str], ...], ...]
#: Sets of more strings than this count as unknown.
FEW = 64


def _strings(tree) -> list[set[str] | None]:
    """The parts of a sequence in order: the strings that a part can be, or None where they are unknown or many. Lower case."""
    parts: list[set[str] | None] = []
    for op, value in tree:
        if op is sre.LITERAL:
            parts.append({chr(value).lower()})
        elif op is sre.IN and all(k is sre.LITERAL for k, _ in value):
            parts.append({chr(v).lower() for _, v in value})
        elif op is sre.SUBPATTERN:
            parts.extend(_strings(value[-1]))
        elif op is sre.BRANCH:
            branches = [_joined(_strings(b)) for b in value[1]]
            parts.append(None if any(b is None for b in branches) else set().union(*branches))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = value
            once = _joined(_strings(inner))
            if once is None or (low, high) not in ((0, 1), (1, 1)):
                parts.extend(_strings(inner) * min(low, 3))
                parts.append(None)
            else:
                parts.append(once | ({""} if low == 0 else set()))
        elif op is not sre.AT:
            parts.append(None)
    return parts


def _joined(parts: list[set[str] | None]) -> set[str] | None:
    out = {""}
    for part in parts:
        if part is None or len(out) * len(part) > FEW:
            return None
        out = {a + b for a in out for b in part}
    return out


def trigram_query(pattern: str) -> Query:
    """What a text in lower case has to contain for ``pattern`` to match it; empty if nothing is mandatory."""
    clauses, run = [], {""}

    def close() -> None:
        if all(len(s) >= 3 for s in run):
            clauses.append(tuple(sorted({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}, key=sorted)))

    for part in [*_strings(_parser.parse(pattern)), None]:
        if part is None or len(run) * len(part) > FEW:
            close()
            run = {""} if part is None else part
        else:
            run = {a + b for a in run for b in part}
    return tuple(clauses)


def index(docs: DataFrame, trigrams: Sequence[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Postings (trigram, id_col): which documents hold which of ``trigrams``, in either case. One for each pair of rows and trigrams."""
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("s_lower"), F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select(F.col(id_col), text.alias("s_lower")).select(F.col(id_col), F.explode(held).alias("trigram"))


def candidates(postings: DataFrame, queries: dict[str, Query], id_col: str = "doc_id") -> DataFrame:
    """Rows (id_col, kinds): the rules whose query a document's postings meet. A document has at most as many postings as there are
    trigrams, and rows of the same id count together, which can only add candidates."""
    met = postings.groupBy(id_col).agg(F.collect_set("trigram").alias("s_held"))
    has = lambda grams: F.forall(F.array(*[F.lit(g) for g in sorted(grams)]), lambda g: F.array_contains(F.col("s_held"), g))

    def holds(query: Query) -> Column:
        out = F.lit(True)
        for clause in query:
            some = F.lit(False)
            for grams in clause:
                some = some | has(grams)
            out = out & some
        return out

    kinds = F.array_compact(F.array(*[F.when(holds(q), F.lit(kind)) for kind, q in queries.items()]))
    return met.select(id_col, kinds.alias("kinds")).where(F.size("kinds") > 0)


def matches(text: Column, rule: Rule, order: int) -> Column:
    """ARRAY<STRUCT<start, order, kind, end>> of the rule's matches that are long enough. Positions are running sums over the texts
    between and in the matches, as splitting and extracting find the same matches."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.split(text, rule.pattern, -1)
    each = F.arrays_zip(found.alias("m"), counted.alias("c"), F.slice(gaps, F.lit(1), F.size(found)).alias("g"))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), end.alias("end"))
        kept = F.when(F.length(x["c"]) >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), kept.alias("spans"))

    return F.aggregate(each, F.struct(F.lit(0).alias("at"), empty.alias("spans")), step, lambda acc: acc["spans"])


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with spans ARRAY<STRUCT<start, rank, kind, end>>, sorted by start, then rule."""
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    trigrams = sorted({g for q in indexed.values() for clause in q for grams in clause for g in grams})
    named = docs
    kinds = F.array().cast("array<string>")
    if trigrams:
        # The candidates are a small table as a rule; Spark broadcasts it if its size allows, else both sides are dealt by id.
        told = index(docs.where(F.col(id_col).isNotNull()), trigrams, id_col, text_col)
        found = settle(candidates(told, indexed, id_col).select(F.col(id_col).alias("s_id"), F.col("kinds").alias("s_kinds")))
        named = docs.join(found, docs[id_col] == found["s_id"], "left")
        kinds = F.when(docs[id_col].isNull(), F.array(*[F.lit(k) for k in indexed])).otherwise(F.coalesce(F.col("s_kinds"), kinds))
    text = F.coalesce(docs[text_col], F.lit(""))
    empty = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    each = []
    for order, rule in enumerate(rules):
        possible = F.rlike(text, F.lit(rule.pattern))
        if rule.kind in indexed:
            possible = F.array_contains(kinds, F.lit(rule.kind)) & possible
        each.append(F.when(possible, matches(text, rule, order)).otherwise(empty))
    return named.select(*[docs[c] for c in docs.columns if c != "spans"], F.array_sort(F.concat(*each)).alias("spans"))


def written(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """kind:start:end of each span, comma-joined; only of ``kinds``, if given."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with each stretch that spans cover replaced by ``mark``; spans that touch or overlap make one stretch."""
    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] > acc["at"]
        first = (acc["at"] == 0) & (s["start"] == 0)
        between = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh | first, F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
