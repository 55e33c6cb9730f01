"""Secret scans with a trigram inverted index.

Every rule is a regular expression. From its syntax tree a Boolean query over lower-case
trigrams is derived: alternatives of sets of trigrams that any match must hold. The index
has a row (trigram, text) for each trigram that some query names and each distinct text
that holds it. Intersecting the postings of an alternative's trigrams gives its candidate
texts; rules without a mandatory trigram scan all texts. Only candidates are verified, once
for all their copies, which also gives the spans.

Matches are leftmost and do not overlap within a kind; a match whose checked group is
shorter than the rule's minimum is dropped but still takes its place. Positions are code
points, ends exclusive. Spans are numbered by running sums over match and gap lengths, in
rows, so that a text may hold any number of them.

Defined results: a null text is empty and has no spans. Repeated rows get the same spans.
Spans of different kinds may overlap. Other columns are kept by ``redact`` and left out by
``find``. A text counts as the same as another if their SHA-256 is the same.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import free_name, written

COMMON = "zqxjkvbpygfwmucldrhsnioate"  # letters from rare to common; others count as rarest
MAX_TRIGRAMS = 3  # of an alternative that are looked up
MASK = 60  # trigrams in a long
MAX_STRINGS = 64  # alternatives that are spelt out of a part of a pattern


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # in the syntax that Python and Java share; (?i) in front ignores the case of A-Z
    least: int = 1  # code points of the checked group
    group: int = 0
    probe: str | None = None  # what every match that is not dropped holds; tried first by rules that scan


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16, probe=r"[0-9a-f]{16}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"(?i)bearer\x20+([A-Za-z0-9._~+/-]+=*)", 20, 1),
)
RULES = BASE_RULES + MORE_RULES


# --- Boolean trigram queries -------------------------------------------------------------

Query = frozenset  # of alternatives, each a frozenset of trigrams; an empty alternative is always met


def grams(text: str) -> frozenset[str]:
    text = text.lower()
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def both(a: Query, b: Query) -> Query:
    return tidy({x | y for x in a for y in b})


def tidy(query: set) -> Query:
    """Without alternatives that ask for more than another one; too many become none at all."""
    least = frozenset(x for x in query if not any(y < x for y in query))
    return least if len(least) <= MAX_STRINGS else frozenset([frozenset()])


def strings(node) -> list[str] | None:
    """All strings that one part of a pattern matches, if they are few."""
    op, arg = node
    if op is sre.LITERAL:
        return [chr(arg)]
    if op is sre.IN and all(x[0] in (sre.LITERAL, sre.RANGE) for x in arg):
        found = [c for k, v in arg for c in ([v] if k is sre.LITERAL else range(v[0], v[1] + 1))]
        return [chr(c) for c in found] if len(found) <= 8 else None
    if op is sre.SUBPATTERN:
        return sequence_strings(arg[3])
    if op is sre.BRANCH:
        every = [sequence_strings(x) for x in arg[1]]
        return None if None in every else [s for x in every for s in x]
    if op is sre.MAX_REPEAT and arg[1] == 1:
        once = sequence_strings(arg[2])
        return None if once is None else once if arg[0] else ["", *once]
    return None


def sequence_strings(nodes) -> list[str] | None:
    found = [""]
    for node in nodes:
        own = strings(node)
        if own is None or len(found) * len(own) > MAX_STRINGS:
            return None
        found = [a + b for a, b in product(found, own)]
    return found


def sequence_query(nodes) -> Query:
    """What a sequence asks for: runs of spelt-out parts give trigrams, other parts their own queries."""
    query, run = frozenset([frozenset()]), [""]
    for node in nodes:
        own = strings(node)
        if own is not None and len(run) * len(own) <= MAX_STRINGS:
            run = [a + b for a, b in product(run, own)]
            continue
        query = both(query, tidy(set(map(grams, run))))
        run = own if own is not None else [""]
        if own is None:
            query = both(query, node_query(node))
    return both(query, tidy(set(map(grams, run))))


def node_query(node) -> Query:
    op, arg = node
    if op is sre.SUBPATTERN:
        return sequence_query(arg[3])
    if op is sre.BRANCH:
        return tidy(set().union(*(sequence_query(x) for x in arg[1])))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
        return sequence_query(arg[2])
    return frozenset([frozenset()])


def trigram_query(pattern: str) -> list[tuple[str, ...]]:
    """Alternatives of mandatory trigrams, the rarest of each; empty if the rule has none and must scan.
    Leaving some out only adds candidates, which are verified anyway."""
    query = sequence_query(parser.parse(pattern))
    return [] if frozenset() in query else sorted({tuple(sorted(sorted(x, key=rareness)[:MAX_TRIGRAMS])) for x in query})


def rareness(trigram: str) -> tuple:
    return sum(COMMON.find(c) + 1 for c in trigram), trigram


# --- index, candidates, spans ------------------------------------------------------------


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rule) of every distinct text (columns key, text) that may, by its trigrams, match a rule; rules
    without a mandatory trigram are tried on every text."""
    queries = {i: trigram_query(r.pattern) for i, r in enumerate(rules)}
    named = sorted({t for alternatives in queries.values() for a in alternatives for t in a})
    lower = F.lower("text")
    # Plain conditions, so that they stay in generated code and lower-case the text once.
    bit = lambda condition, n: F.when(condition, F.lit(1 << n % MASK)).otherwise(F.lit(0)).cast("bigint")
    flags = [bit(F.contains(lower, F.lit(t)), n) for n, t in enumerate(named)]
    masks = [reduce(Column.bitwiseOR, flags[n : n + MASK]) for n in range(0, len(flags), MASK)]
    scans = [i for i, q in queries.items() if not q]
    tried = [bit(F.rlike("text", F.lit(rules[i].probe or rules[i].pattern)), n) for n, i in enumerate(scans)]
    tries = [reduce(Column.bitwiseOR, tried[n : n + MASK]) for n in range(0, len(tried), MASK)]
    # Written whole: a filter here would be pushed down and compute the masks a second time.
    marked = written(texts.select("key", *[m.alias(f"m{n}") for n, m in enumerate(masks)], *[m.alias(f"s{n}") for n, m in enumerate(tries)]), "trigrams")
    marked = marked.where(" OR ".join(f"{c} <> 0" for c in marked.columns if c != "key") or "false").distinct()
    index = marked.select("key", F.explode(bits_of("m", len(named))).alias("trigram"))
    asked = [(n, i, named.index(t), len(a)) for n, (i, a) in enumerate((i, a) for i, q in queries.items() for a in q) for t in a]
    asked = texts.sparkSession.createDataFrame(asked, "alternative int, rule int, trigram int, needed int")
    # One row for each trigram of each rule: bounded by the rules, which are part of the call.
    met = index.join(F.broadcast(asked), "trigram").groupBy("key", "alternative", "rule").agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
    found = met.where("n = needed").select("key", "rule")
    scanned = marked.select("key", F.explode(bits_of("s", len(scans))).alias("n"))
    numbers = F.array(*map(F.lit, scans)).cast("array<int>")
    return found.union(scanned.select("key", numbers[F.col("n")])).distinct()


def bits_of(prefix: str, n: int) -> Column:
    """Array of the numbers of the bits that are set, over columns of MASK bits each."""
    own = [F.when(F.col(f"{prefix}{i // MASK}").bitwiseAND(1 << i % MASK) != 0, F.lit(i)) for i in range(n)]
    return F.array_compact(F.array(*own).cast("array<int>"))


def possible(text: Column, rules: tuple[Rule, ...]) -> Column:
    """The rules' Boolean queries on one text itself: what fails them is no candidate of the index either."""
    lower, tests = F.lower(text), []
    for rule in rules:
        query = trigram_query(rule.pattern)
        tests += [reduce(Column.__and__, [F.contains(lower, F.lit(t)) for t in a]) for a in query]
        if not query:
            tests.append(F.rlike(text, F.lit(rule.probe or rule.pattern)))
    return F.coalesce(reduce(Column.__or__, tests, F.lit(False)), F.lit(False))


def spans(docs: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, rule, start, end) of the texts of ``docs``, each distinct text once."""
    value = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(text_key(value).alias("key"), value.alias("text"))
    wanted = candidates(texts, rules).groupBy("key").agg(F.collect_set("rule").alias("rules"))
    wanted = written(wanted, "candidates")
    # Only texts that may be candidates are shuffled for the join, at any size of either side.
    held = texts.where(possible(F.col("text"), rules)).join(wanted, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("rules").alias("rules"))

    def pieces(i: int, r: Rule) -> Column:
        """Matches and the gaps before them, for one rule."""
        matches = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        checked = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))
        zipped = F.arrays_zip(F.split("text", r.pattern, -1).alias("gap"), matches.alias("match"), checked.alias("checked"))
        filled = F.filter(zipped, lambda x: x["match"].isNotNull())
        row = F.transform(filled, lambda x, n: F.struct(F.lit(i).alias("rule"), n.alias("n"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["match"]).alias("size"), (F.char_length(x["checked"]) >= r.least).alias("good")))
        return F.when(F.array_contains("rules", i), row)

    every = F.flatten(F.array_compact(F.array(*[pieces(i, r) for i, r in enumerate(rules)])))
    rows = held.select("key", F.inline(every))
    so_far = Window.partitionBy("key", "rule").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(so_far)
    placed = rows.select("key", "rule", "good", "size", end.alias("end"))
    return placed.where("good").select("key", "rule", (F.col("end") - F.col("size")).alias("start"), "end")


def joined(spans_: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end, comma-joined, of an array of (start, rule, end) in order."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", kinds[x["rule"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def found_by_text(docs: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, found): the spans of each text that has some, by start, then rule."""
    return spans(docs, text, rules).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "rule", "end"))).alias("found"))


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` and found, an array of (start, rule, end); rule is the place in ``rules``."""
    by_text = written(found_by_text(docs, text, rules), "secrets")
    keyed = docs.select(*keep, text_key(F.coalesce(F.col(text), F.lit(""))).alias("key_"))
    joined_ = keyed.join(by_text.withColumnRenamed("key", "key_"), "key_", "left")
    return joined_.select(*keep, F.coalesce("found", F.array().cast(by_text.schema["found"].dataType)).alias("found"))


def redact(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans become one. ``n_chars`` follows the text."""
    by_text = written(found_by_text(docs, text, rules), "secrets")
    maybe = possible(F.col(text), rules)
    key, found = free_name(docs, "key_"), free_name(docs, "found_")
    keyed = docs.where(maybe).withColumn(key, text_key(F.col(text)))
    joined_ = keyed.join(by_text.select(F.col("key").alias(key), F.col("found").alias(found)), key, "left")
    replaced = F.expr(
        f"""aggregate(`{found}`, struct(CAST(0 AS bigint) AS at, '' AS out), (s, x) -> IF(x.start >= s.at,
        struct(x.end AS at, concat(s.out, substring(`{text}`, CAST(s.at + 1 AS int), CAST(x.start - s.at AS int)), '{mark}') AS out),
        struct(greatest(s.at, x.end) AS at, s.out AS out)), s -> concat(s.out, substring(`{text}`, CAST(s.at + 1 AS int))))"""
    )
    out = joined_.withColumn(text, F.when(F.col(found).isNull(), F.col(text)).otherwise(replaced))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found).isNull(), F.col("n_chars")).otherwise(F.char_length(text)))
    return docs.where(~maybe).union(out.select(*docs.columns))
