"""Text search as expressions: terms, rules over pieces of text, hits with offsets, sentences and clauses, negation.

A piece is struct(kind, t: text, low: the text in lower case, at: its offset in the document). A rule is one pattern and the
kinds of pieces it is looked for in, the preferred first; `scan` runs all rules over all pieces of a row and gives an array of
hits. A pattern runs only over pieces of its kinds in which one of its words occurs. Offsets count code points. Private-use
characters mark matches; `clean` takes them out of texts beforehand.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE, END, GROUP = "", "", "", ""
LOOK_BACK = 400


def term(words: str, gap: str = r"\s+") -> str:
    """A pattern for a term: `*` stands for any ending, `_` for the edge of a word, a blank for white space; abbreviations in
    capitals are whole words; `=` in front asks for the case as it is written; ё is also е."""
    exact, parts = words.startswith("="), []
    for word in words.removeprefix("=").split(" "):
        core = word.strip("_*")
        whole = core.isupper() and len(core) > 1 and "_" not in word
        body = "[её]".join(map(re.escape, core.split("ё")))
        head = r"\b" if whole or word.startswith("_") else ""
        tail = r"\w*" if word.endswith("*") else r"\b" if whole or word.endswith("_") else ""
        parts.append(head + body + tail)
    found = gap.join(parts)
    return f"(?-i:{found})" if exact else found


@functools.cache
def _alike() -> dict[str, str]:
    """For each letter in lower case, all letters that a search without regard to case takes for it."""
    out: dict[str, str] = {}
    for letter in map(chr, (*range(0xD800), *range(0xE000, 0x10000))):
        up = letter.upper() if len(letter.upper()) == 1 else letter
        out[up.lower()[0]] = out.get(up.lower()[0], "") + letter
    return out


def opening(*terms: str) -> str:
    """A look at the next letter: whether one of the terms can begin with it. A search gives up most places by it, instead of trying
    all terms there."""
    letters = {t.lstrip("=_*")[0].lower() for t in terms}
    every = {x for c in letters for x in _alike().get(c, c) + ("".join(map(_alike().get, "её")) if c in "её" else "")}
    return f"(?=(?-i:[{''.join(map(re.escape, sorted(every)))}]))"


def any_of(*terms: str, gap: str = r"\s+") -> str:
    return f"(?:{opening(*terms)}(?:" + "|".join(term(t, gap) for t in terms) + "))"


def words_of(*terms: str) -> tuple[str, ...]:
    """What must occur in lower case wherever one of the terms does: the longest plain stretch of each."""
    longest = lambda t: max(re.split(r"[\s*_=ё]+", t.lower()), key=len)
    return tuple(dict.fromkeys(map(longest, terms)))


# What negates a clause.
NEGATIONS = ("_нет_", "_не_", "_без_", "_отрица*", "_отсутств*", "_исключ*")
# A full stop ends a sentence before a blank or away from digits, and never before a degree ("ст.").
SENTENCE_END = r"[;\n]|\.(?!\s*ст\.)(?:(?=\s)|(?<!\d\.)(?!\d))"
CLAUSE_END = rf"{SENTENCE_END}|,"
NEGATION = rf"(?<!-){any_of(*NEGATIONS)}(?![\w-])"


def ci(pattern: str) -> str:
    return f"(?iUd){pattern}"


def cs(pattern: str) -> str:
    return f"(?Ud){pattern}"


def once(build: Callable) -> Callable:
    """build, a function of names that gives columns, run once a session for the same names. Columns only name what they refer to, so
    that they serve any frame; the rules are some thousands of them, and putting those together takes seconds."""
    held: dict = {}

    @functools.wraps(build)
    def run(*names: str):
        context = SparkContext._active_spark_context
        key = (context and context.applicationId, names)
        if key not in held:
            held[key] = build(*names)
        return held[key]

    return run


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def head(items: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """The first item (that is kept), or null."""
    return F.get(F.filter(items, keep) if keep else items, F.lit(0))


def clean(text: Column) -> Column:
    marks = OPEN + CLOSE + END + GROUP
    return F.translate(text, marks, "�" * len(marks))


def some(items: Column) -> Column:
    return F.filter(items, lambda x: x.isNotNull())


def after(text: Column, n: Column) -> Column:
    return F.substring(text, n + 1, F.lit(2**31 - 1))


def before(text: Column, n: Column) -> Column:
    return F.substring(text, F.lit(1), n)


def has_any(low: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [F.contains(low, F.lit(w)) for w in words])


# One byte for each Cyrillic letter in lower case, as a search for a word stops at nearly every letter that is written with two: all
# begin with one of two bytes. Nothing in lower case has capitals of A-Z, so that the rest are rare signs; those may cost a try in vain.
FOLDED_FROM, FOLDED_TO = "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "ABCDEFGHIJKLMNOPQRSTUVWXYZ\x01\x02\x03\x04\x05\x06\x07"
_FOLDED = str.maketrans(FOLDED_FROM, FOLDED_TO)


def folded(low: Column) -> Column:
    """What `holds` looks for words in, of a text in lower case."""
    return F.translate(low, FOLDED_FROM, FOLDED_TO)


def holds(low: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words, in lower case, occurs in a text, as `folded` made it."""
    return has_any(low, tuple(w.translate(_FOLDED) for w in words))


def cut(text: Column, pattern: str) -> Column:
    """The text in parts at each match, which is not empty. The pattern is compiled once, where F.split would for each text."""
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(OPEN)), OPEN)


def marked(text: Column, pattern: str | Column, replacement: str = f"{OPEN}$0{OPEN}{OPEN}") -> Column:
    """(m, s, g) for each stretch that the replacement marks: its text, its offset, and the groups that follow it."""
    none = F.array().cast("array<struct<m:string,s:int,g:array<string>>>")

    def collect(parts: Column) -> Column:
        # parts are what lies between matches, a match, its groups, and so on
        sizes = F.transform(parts, lambda x, i: F.when(i % 3 == 2, 0).otherwise(F.length(x)))
        odd = F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("m"), i.alias("s"))), lambda x: x["s"] % 3 == 1)
        at = lambda i: F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda n, x: n + x)
        return F.transform(odd, lambda x: F.struct(x["m"].alias("m"), at(x["s"]).alias("s"), F.split(F.get(parts, x["s"] + 1), GROUP).alias("g")))

    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return let(F.regexp_replace(text, pattern, F.lit(replacement)), lambda x: F.when(F.contains(x, F.lit(OPEN)), let(F.split(x, OPEN), collect)).when(x.isNotNull(), none))


@dataclass(frozen=True)
class Rule:
    """A pattern (its groups are values) and the kinds of pieces it runs over, in order of preference; `words` as in words_of
    (none: always tried); every: all matches of a piece, not only the first."""

    name: str
    pattern: str
    scopes: tuple[tuple[str, ...], ...]
    words: tuple[str, ...] = ()
    every: bool = False
    exact: bool = False

    @property
    def groups(self) -> int:
        return re.compile(self.pattern.replace(r"\z", r"\Z").replace("(?-i:", "(?:")).groups


HIT = "struct<rule:int,prio:int,at:int,m:string,s:int,g:array<string>,t:string,base:int>"


def scan(pieces: Column, rules: tuple[Rule, ...]) -> Column:
    """array of hits (rule: its number, prio, at, m, s, g, t: the piece's text, base: its offset), sorted by rule, preference
    and place."""

    def tried(p: Column) -> Column:
        made = []
        for number, rule in enumerate(rules):
            prio, seen = None, set()
            for n, kinds in enumerate(rule.scopes):
                fresh = [k for k in kinds if k not in seen]
                seen.update(fresh)
                if fresh:
                    prio = F.when(p["kind"].isin(fresh), n) if prio is None else prio.when(p["kind"].isin(fresh), n)
            values = GROUP.join(f"${g + 2}" for g in range(rule.groups))
            flags = cs if rule.exact else ci
            pattern = flags(f"({rule.pattern})" if rule.every else f"({rule.pattern})(?s:.*)")
            marks = F.regexp_replace(p["t"], F.lit(pattern), F.lit(f"{OPEN}$1{OPEN}{values}{OPEN}"))
            tries = p["kind"].isin(list(seen))
            if rule.words:
                tries = tries & holds(p["folded"], rule.words)
            made.append(F.when(tries, F.struct(F.lit(number).alias("rule"), prio.alias("prio"), marks.alias("marks"), p["t"].alias("t"), p["at"].alias("base"))))
        return F.filter(F.array(*made), lambda x: F.contains(x["marks"], F.lit(OPEN)))

    def found(x: Column) -> Column:
        def collect(parts: Column) -> Column:
            sizes = F.transform(parts, lambda y, i: F.when(i % 3 == 2, 0).otherwise(F.length(y)))
            at = lambda i: F.aggregate(F.slice(sizes, F.lit(1), 3 * i + 1), F.lit(0), lambda n, y: n + y)
            numbers = F.sequence(F.lit(0), F.floor(F.size(parts) / 3).cast("int") - 1)
            return F.transform(
                numbers,
                lambda i: F.struct(
                    x["rule"].alias("rule"), x["prio"].alias("prio"), (x["base"] + at(i)).cast("int").alias("at"), F.get(parts, 3 * i + 1).alias("m"), at(i).cast("int").alias("s"),
                    F.split(F.get(parts, 3 * i + 2), GROUP).alias("g"), x["t"].alias("t"), x["base"].cast("int").alias("base"),
                ),
            )

        return let(F.split(x["marks"], OPEN), collect)

    ready = F.transform(pieces, lambda p: F.struct(p["kind"].alias("kind"), p["t"].alias("t"), folded(p["low"]).alias("folded"), p["at"].alias("at")))
    return F.sort_array(F.flatten(F.transform(F.flatten(F.transform(ready, tried)), found)))


def pieces(sections: Column) -> Column:
    """The bodies of sections, as pieces."""
    return F.transform(sections, lambda s: F.struct(s["kind"].alias("kind"), s["body"].alias("t"), F.lower(s["body"]).alias("low"), s["body_start"].alias("at")))


def sentences(scope: Column, kind: str) -> Column:
    """The sentences of all pieces, as pieces of a kind of their own. A separator is one character."""

    def of(p: Column) -> Column:
        def placed(parts: Column) -> Column:
            start = lambda i: F.aggregate(F.slice(parts, F.lit(1), i), F.lit(0), lambda n, y: n + F.length(y) + 1)
            seen = F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("t"), i.alias("i"))), lambda x: x["t"].rlike(r"(?U)\S"))
            return F.transform(seen, lambda x: F.struct(F.lit(kind).alias("kind"), x["t"].alias("t"), F.lower(x["t"]).alias("low"), (p["at"] + start(x["i"])).cast("int").alias("at")))

        return let(cut(p["t"], cs(SENTENCE_END)), placed)

    return F.flatten(F.transform(scope, of))


def left_of(h: Column, end: str) -> Column:
    """What of the sentence or clause stands before a hit."""
    lo = F.greatest(F.lit(0), h["s"] - LOOK_BACK)
    return F.element_at(cut(F.substring(h["t"], lo + 1, h["s"] - lo), cs(end)), -1)


def right_of(h: Column, size: Column, end: str) -> Column:
    """What of the sentence or clause stands after the first `size` characters of a hit. One of them stays in sight of what
    looks behind."""
    return F.regexp_extract(after(h["t"], h["s"] + size - 1), f"(?s)^.(.*?)(?:{cs(end)}|\\z)", 1)


def negated(h: Column, core: Column) -> Column:
    """Whether the clause around a hit (its `core`) holds a negation, before or after it."""
    own = F.concat(before(core, F.lit(1)), F.regexp_replace(after(core, F.lit(1)), r"[.;,]+\z", ""))
    return let(own, lambda x: F.concat(left_of(h, CLAUSE_END), x, right_of(h, F.length(x), CLAUSE_END)).rlike(ci(NEGATION)))


def raw_finding(field: str, value: Column, text: Column, start: Column) -> Column:
    """A finding before its evidence is trimmed; its value may be null."""
    return F.struct(F.lit(field).alias("field"), value.alias("value"), text.alias("text"), start.cast("int").alias("start"))


def trimmed(x: Column) -> Column:
    """A raw finding with evidence that has no blanks at either end."""
    bare = F.regexp_replace(x["text"], r"(?U)^\s+", "")
    start = x["start"] + F.length(x["text"]) - F.length(bare)
    return let(
        F.struct(F.regexp_replace(bare, r"(?U)\s+\z", "").alias("e"), start.alias("s")),
        lambda y: F.struct(x["field"].alias("field"), x["value"].alias("value"), y["e"].alias("evidence"), y["s"].cast("int").alias("start"), (y["s"] + F.length(y["e"])).cast("int").alias("end"), F.lit("rule").alias("source")),
    )
