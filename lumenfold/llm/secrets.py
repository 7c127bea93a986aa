"""Operator 7: secret scans over a trigram inverted index, in DataFrame functions only.

required() derives from each rule's pattern a Boolean query over trigrams (of lower-case text): the literal
runs that every match must hold, small classes and optional parts written out, alternatives joined by OR. The index
has a posting (trigram, document) for every trigram that some rule needs; one regex, a trie of these trigrams, finds
them in one pass over each text. The postings of a query's trigrams are intersected by counting, and what is in all
of them is a candidate, which alone is verified by the rule's regex. Candidates are written once and joined to the
texts by a broadcast while they are few, else by a shuffle. Rules without a mandatory trigram (runs of hex digits,
say) scan every document.

The index is keyed by document id and a hash of the text, so repeated ids, null ids and repeated rows are
told apart or treated alike as their texts are. Null texts count as empty: no spans. Texts are scanned whole, however
long. An empty table gives an empty result. Spans are in code points, the end excluded, leftmost and non-overlapping
in each kind; spans of equal start are listed in the order of the rules. Columns beside key and text are ignored by
digests() and kept by scan() and redacted(), whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.common import sized, unused, written


@dataclass(frozen=True)
class Rule:
    """kind: its name in spans. A match counts if it has `least` characters in `group`; base rules are counted."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False


#: In the order in which spans of equal start are listed. The first three are the base; the others only add spans.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),  # the same spans as runs of any length of which those under 32 are dropped
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}[.]eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}"),
    Rule("live_key", r"sk_live_[A-Za-z0-9]{16,}"),
)


#: A class of up to so many characters is written out, as long as a pattern has no more ways than this.
CLASS, WAYS = 8, 256


def required(pattern: str) -> list[list[str]]:
    """The pattern's trigram query: any of these lists, all of its trigrams. [[]]: no mandatory trigram.

    Literals are gathered along the parsed pattern; a larger class or a repeat ends a run. Groups, alternatives,
    optional parts and small classes are followed; a repeat that must occur at least once counts once. A way that
    holds all trigrams of another one says nothing more and goes.
    """
    from re import _constants as C
    from re import _parser

    def walk(tree) -> list[list[str]]:
        """Ways to match: each a list of literal runs, of which only the last may be joined to what follows."""
        ways: list[list[str]] = [[""]]
        for op, arg in tree:
            once = op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] == 1
            if op is C.LITERAL:
                inner = [[chr(arg).lower()]]
            elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= CLASS:
                inner = [[c] for c in sorted({chr(x).lower() for _, x in arg})]
            elif op is C.BRANCH:
                inner = [x for alternative in arg[1] for x in walk(alternative)]
            elif op is C.SUBPATTERN:
                inner = walk(arg[3])
            elif once:
                inner = walk(arg[2]) + [[""]] * (arg[0] == 0)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
                inner = [["", *x, ""] for x in walk(arg[2])]
            else:
                inner = [["", ""]]
            if len(ways) * len(inner) > WAYS:
                inner = [["", ""]]
            ways = [[*w[:-1], w[-1] + x[0], *x[1:]] for w in ways for x in inner]
        return ways

    found = {frozenset(run[i : i + 3] for run in way for i in range(len(run) - 2)) for way in walk(_parser.parse(pattern))}
    return sorted(sorted(x) for x in found if not any(y < x for y in found))


def plans(rules: tuple[Rule, ...]) -> tuple[list[str], dict[str, list[list[str]]]]:
    """All trigrams that rules need, in order, and each rule's query."""
    by_rule = {r.kind: required(r.pattern) for r in rules}
    return sorted({t for q in by_rule.values() for way in q for t in way}), by_rule


def lookout(trigrams: list[str]) -> str:
    """A regex that finds, at every character, the trigram that starts there, if it is one of these: group 1 of a match without width."""
    tree: dict[str, dict[str, list[str]]] = {}
    for t in trigrams:
        tree.setdefault(t[0], {}).setdefault(t[1], []).append(t[2])
    one_of = lambda letters: re.escape(letters[0]) if len(letters) == 1 else "[" + "".join(map(re.escape, letters)) + "]"
    each = lambda parts: parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    # three classes turn most characters down before the tree is tried
    worth = "".join(one_of(sorted({t[i] for t in trigrams})) for i in range(3))
    return f"(?={worth})(?=(" + "|".join(re.escape(a) + each([re.escape(b) + one_of(cs) for b, cs in m.items()]) for a, m in tree.items()) + "))"


def postings(docs: DataFrame, trigrams: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index, restricted to these trigrams: distinct (trigram, doc, hash), in runs of rows of one document."""
    held = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(lookout(trigrams)), F.lit(1))) if trigrams else F.array().cast("array<string>")
    return docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("hash"), F.explode(held).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(doc, hash, rules): the documents that satisfy some rule's query, with the kinds of these rules.

    A posting counts for every way that needs its trigram; a document with as many as the way has trigrams is in the
    intersection of its postings. Counts are combined before they are shuffled, so a common trigram is no hot key.
    """
    ways = [(kind, i, way) for kind, q in queries.items() for i, way in enumerate(q) if way]
    needs = [F.struct(F.lit(kind).alias("rule"), F.lit(i).alias("way"), F.lit(len(way)).alias("all"), F.lit(t).alias("trigram")) for kind, i, way in ways for t in way]
    needs = index.sparkSession.range(1).select(F.inline(F.array(*needs))) if needs else index.sparkSession.sql("SELECT '' AS rule, 0 AS way, 0 AS all, '' AS trigram WHERE false")
    # a row for each trigram of each way
    met = index.distinct().join(F.broadcast(needs), "trigram").groupBy("doc", "hash", "rule", "way", "all").count().where("count = all")
    return met.groupBy("doc", "hash").agg(F.collect_set("rule").alias("rules"))


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start,end>> of a rule's matches: the text between matches gives their places."""
    pattern = F.lit(rule.pattern)
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda x: F.length(x))
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda x: F.length(x))
    measured = sizes if rule.group == 0 else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x))
    rows = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), measured.alias("measured"))
    none = F.array().cast("array<struct<start:int,end:int,measured:int>>")
    empty = F.struct(F.lit(0).alias("at"), none.alias("made"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        made = F.when(x["size"].isNotNull(), F.concat(acc["made"], F.array(F.struct(start.alias("start"), end.alias("end"), x["measured"].alias("measured"))))).otherwise(acc["made"])
        return F.struct(end.alias("at"), made.alias("made"))

    return F.filter(F.aggregate(rows, empty, step, lambda acc: acc["made"]), lambda s: s["measured"] >= rule.least)


def _of_kind(spans: Column, kind: int) -> Column:
    # the lambdas of transform() and filter() may take no further parameter: it would be the position
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", into: str = "spans", index: DataFrame | None = None) -> DataFrame:
    """docs with a column `into`: array<struct<start,kind,end>>, kind as a position in rules. index: postings() of these
    documents and (at least) these rules' trigrams, if they are already there."""
    trigrams, queries = plans(rules)
    hash_, doc, other, kinds = unused(docs, "hash", "doc", "other", "rules")
    named = written(candidates(postings(docs, trigrams, key, text) if index is None else index, queries), "candidates").toDF(doc, other, kinds)
    rows = docs.withColumn(hash_, F.xxhash64(F.col(text)))
    joined = rows.join(sized(named), rows[key].eqNullSafe(F.col(doc)) & (rows[hash_] == F.col(other)), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for i, rule in enumerate(rules):
        hits = _of_kind(spans_of(F.col(text), rule), i)
        wanted = F.col(text).rlike(rule.pattern)
        if [] not in queries[rule.kind]:
            wanted = F.array_contains(F.col(kinds), rule.kind) & wanted
        found.append(F.when(wanted, hits).otherwise(none))
    return joined.withColumn(hash_, F.array_sort(F.concat(*found))).drop(doc, other, kinds).withColumnRenamed(hash_, into)


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of text that spans cover replaced by mark; a null text stays null."""
    whole, (spans,) = F.col(text), unused(docs, "spans")

    def step(acc: Column, s: Column) -> Column:
        opened = F.concat(acc["made"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), opened.alias("made"))).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["made"].alias("made")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))
    made = F.aggregate(spans, start, step, lambda acc: F.concat(acc["made"], F.substring(whole, acc["at"] + 1, F.length(whole))))
    return scan(docs, rules, key, text, spans).withColumn(text, F.when(F.size(spans) > 0, made).otherwise(whole)).drop(spans)


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: counts of base kinds, a digest of base spans, and all spans."""
    base = [i for i, r in enumerate(rules) if r.base]
    rows = scan(docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")), rules, "id", "text")
    own = F.filter("spans", lambda s: s["kind"].isin(base))
    counts = [_count(F.col("spans"), i).alias(f"n_{rules[i].kind}") for i in base]
    return rows.select(F.col("id").alias(key), *counts, F.sha2(listed(own, rules), 256).alias("base_sha256"), listed(F.col("spans"), rules).alias("spans"))
