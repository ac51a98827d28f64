"""Secret scans over a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression.  From it a Boolean trigram query is derived: a set
of alternatives, each a set of trigrams that any match must contain.  Documents are
posted under the query trigrams that they hold, the postings of an alternative are
intersected by counting, and only candidate documents meet the expression itself.
Rules without mandatory trigrams scan every document.

Trigrams are those of the lower-cased text, so a query never misses a match; the
expression decides.  Offsets are code points, ends exclusive.

Candidates are written before they are joined, so that the optimiser knows their size:
few ones go to the texts, and only many make the texts move.

Null and empty texts have no spans.  A null key joins like any other value; rows that
share a key are verified each on their own text, so repeated rows give repeated
results.  Texts of any length and number of matches are taken whole, in time that grows
with them; spans that start together are listed in the order of the rules.  An empty table
gives an empty one.  Other columns pass through, but for one named ``spans``, which the
result replaces.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscope.llm.shared import Scratch, quoted, unused, without

#: Elements of an array that are folded at once.
CHUNK = 128
#: Alternatives kept apart while a query is derived; beyond it a run of literals ends.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``least`` code points are needed in capture group ``group``."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False

    @property
    def regex(self) -> str:
        """What is searched for: for runs of one class, only those that are long enough."""
        if self.pattern[0] == "[" and self.pattern.find("]") == len(self.pattern) - 2 and self.pattern[-1] == "+":
            return f"{self.pattern[:-1]}{{{self.least},}}"
        return f"(?i){self.pattern}" if self.any_case else self.pattern


# The base rules, in the order in which kinds are listed.
BASE_RULES = (
    Rule(
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=2,
        least=6,
        any_case=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]+", least=24),
)
#: Published formats of further credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[oprsu]_[A-Za-z0-9]+", least=40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("maps", r"AIza[A-Za-z0-9_-]+", least=39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("payment", r"sk_live_[A-Za-z0-9]+", least=24),
)
RULES = BASE_RULES + MORE_RULES

Query = list[frozenset[str]]
ALWAYS: Query = [frozenset()]


def simpler(query: Query) -> Query:
    """Alternatives that ask for more than another one add nothing."""
    return [x for x in dict.fromkeys(query) if not any(y < x for y in query)]


def trigrams(strings: set[str]) -> Query:
    return simpler([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings)])


def both(a: Query, b: Query) -> Query:
    return simpler([x | y for x in a for y in b])


def strings_of(item: tuple) -> set[str] | None:
    """All strings an item can match, if they are few."""
    kind, arg = item
    if kind is op.LITERAL:
        return {chr(arg).lower()}
    if kind is op.IN and arg[0][0] is not op.NEGATE:
        found: set[str] = set()
        for what, value in arg:
            if what is op.LITERAL:
                found.add(chr(value).lower())
            elif what is op.RANGE and value[1] - value[0] < 8:
                found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return found if len(found) <= 8 else None
    if kind is op.SUBPATTERN:
        return strings_of_all(arg[3])
    if kind is op.BRANCH:
        parts = [strings_of_all(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if kind is op.MAX_REPEAT and arg[1] == 1:
        inner = strings_of_all(arg[2])
        return None if inner is None else inner | ({""} if arg[0] == 0 else set())
    return None


def strings_of_all(items) -> set[str] | None:
    found = {""}
    for item in items:
        own = strings_of(item)
        if own is None or len(found) * len(own) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in own}
    return found


def trigram_query(pattern: str) -> Query:
    """Alternatives of mandatory trigrams; ``ALWAYS`` if there are none."""
    query, run = ALWAYS, {""}
    for item in parser.parse(pattern):
        own = strings_of(item)
        if own is not None and len(run) * len(own) <= MOST_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        query = both(query, trigrams(run))
        run = {""} if own is None else own
    return both(query, trigrams(run))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], key: str, text: str) -> DataFrame:
    """``key`` and ``rules_hit``, the rules whose trigram query a key's text fulfils."""
    asked = [
        (rule.kind, k, trigram, len(need))
        for rule in rules
        for k, need in enumerate(trigram_query(rule.pattern))
        for trigram in sorted(need)
    ]
    needed = docs.sparkSession.createDataFrame(asked, "kind string, alternative int, trigram string, need long")
    folded = docs.select(F.col(quoted(key)).alias("key"), F.lower(F.col(quoted(text))).alias("folded"))
    wanted = sorted({t for _, _, t, _ in asked})
    postings = folded.select(
        "key",
        F.explode(
            F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(t)), F.lit(t)) for t in wanted]))
        ).alias("trigram"),
    )
    met = (
        postings.join(F.broadcast(needed), "trigram")  # a few rows for each rule
        .groupBy("key", "kind", "alternative", "need")
        .agg(F.count_distinct("trigram").alias("held"))
        .where("held = need")
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("rules_hit"))


def folded_in_chunks(items: Column, start: Column, chunk_of: Callable[[Column, Column], Column], finish) -> Column:
    """Left fold over an array, CHUNK elements at a time, so that what grows is copied once for each chunk.

    ``chunk_of`` takes what was carried on (``at``) and a chunk, and gives a struct of ``at``
    and ``out``; ``finish`` takes the last ``at`` and the array of all ``out``.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / CHUNK).cast("int")), lambda k: F.slice(items, k * CHUNK + 1, CHUNK))
    step = lambda s, chunk: named(chunk_of(s["at"], chunk), lambda x: F.struct(x["at"].alias("at"), F.concat(s["out"], F.array(x["out"])).alias("out")))
    return F.aggregate(chunks, start, step, lambda s: finish(s["at"], s["out"]))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


SPANS = "array<struct<start:int,order:int,kind:string,end:int>>"


def spans_of(rule: Rule, order: int, text: Column) -> Column:
    """Array of (start, order, kind, end) of a rule's matches, too short ones dropped.

    The texts between the matches and the matches themselves alternate, so their
    lengths give the offsets.
    """
    pieces = F.transform(F.split(text, rule.regex, -1), lambda x: F.length(x))
    matches = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    parts = F.arrays_zip(
        pieces.alias("gap"),
        F.transform(matches, lambda x: F.length(x)).alias("size"),
        F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)), lambda x: F.length(x)).alias("own"),
    )
    empty = F.array().cast(SPANS)

    def step(so_far: Column, part: Column) -> Column:
        start = so_far["at"] + part["gap"]
        end = start + F.coalesce(part["size"], F.lit(0))
        span = F.struct(
            start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"), end.alias("end")
        )
        return F.struct(
            end.alias("at"),
            F.when(part["own"] >= rule.least, F.concat(so_far["out"], F.array(span))).otherwise(so_far["out"]).alias("out"),
        )

    chunk_of = lambda at, chunk: F.aggregate(chunk, F.struct(at.alias("at"), empty.alias("out")), step)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("out"))
    return folded_in_chunks(parts, start, chunk_of, lambda _, out: F.flatten(out))


def scan(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``docs`` with ``spans``: array of (start, order, kind, end), sorted by start and kind."""
    own, hit_key, hit = (unused(docs, n) for n in ("own_text", "hit_key", "hit_rules"))
    found = Scratch(docs.sparkSession, "secrets").keep(candidates(docs, rules, key, text), "candidates")
    found = found.select(F.col("key").alias(hit_key), F.col("rules_hit").alias(hit))
    rows = docs.join(found, F.col(quoted(key)).eqNullSafe(F.col(hit_key)), "left")
    rows = rows.withColumn(own, F.coalesce(F.col(quoted(text)), F.lit("")))
    none = F.array().cast(SPANS)
    spans = []
    for order, rule in enumerate(rules):
        asked = F.array_contains(hit, rule.kind) if trigram_query(rule.pattern) != ALWAYS else F.rlike(F.col(own), F.lit(rule.regex))
        spans.append(F.when(asked, spans_of(rule, order, F.col(own))).otherwise(none))
    return rows.select(*without(docs, "spans"), F.sort_array(F.concat(*spans)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones as one) replaced by a marker of its kind."""

    def chunk_of(at: Column, chunk: Column) -> Column:
        to = F.greatest(at, F.array_max(F.transform(chunk, lambda s: s["end"])))

        def within(part: Column) -> Column:
            def step(so_far: Column, s: Column) -> Column:
                fresh = s["start"] >= so_far["at"]
                piece = F.concat(F.substring(part, so_far["at"] - at + 1, s["start"] - so_far["at"]), F.lit("["), s["kind"], F.lit("]"))
                return F.struct(
                    F.greatest(so_far["at"], s["end"]).alias("at"),
                    F.when(fresh, F.concat(so_far["out"], piece)).otherwise(so_far["out"]).alias("out"),
                )

            return F.aggregate(chunk, F.struct(at.alias("at"), F.lit("").alias("out")), step)

        return named(F.substring(text, at + 1, to - at), within)

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = folded_in_chunks(
        spans, start, chunk_of, lambda at, out: F.concat(F.array_join(out, ""), F.substring(text, at + 1, F.length(text)))
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)
