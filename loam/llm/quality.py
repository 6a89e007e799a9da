"""Quality rules as a short-circuit cascade (native).

Each rule has a reject predicate over lazily computed text features. On a bounded sample the
operator times every rule and counts its rejections, then orders the rules by rejection per cost,
so that most bad rows stop at a cheap test. The verdict is the same in any order; the order only
decides how much work a row costs. A report computes the features it returns for every row, and
those that only rules need where the cascade gets to them.

Defined results: a null or blank text has no words and is rejected for length; lines are compared
exactly; texts may be of any length; repeated rows get the same verdict; an empty table gives an empty
table; further columns pass, one named like an added column as ``<name>_input``.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.binding import aside, let

BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
Features = Callable[[str], Column]


def words_of(text: Column) -> Column:
    """Runs of characters that are not white space: with all of it made spaces, a split by one character."""
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), " "), "")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are 64-bit hashes. Only where two are equal are they sorted with their places, neighbours
    compared word by word, and the places of repeated windows united. Should different windows ever
    share a hash, the text's windows are compared as strings instead.
    """
    starts = F.sequence(F.lit(0), F.size(words) - 3)
    word = lambda i: F.get(words, i)
    hashes = F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))
    strings = F.transform(starts, lambda i: F.concat_ws(" ", word(i), word(i + 1), word(i + 2)))

    def placed(windows: Column) -> Column:
        return F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def covered(ordered: Column) -> Column:
        before = lambda j: F.get(ordered, F.greatest(j - 1, F.lit(0)))
        twice = F.filter(ordered, lambda w, j: F.coalesce(F.get(ordered, j + 1)["x"] == w["x"], F.lit(False)) | ((j > 0) & (before(j)["x"] == w["x"])))
        places = F.sort_array(F.transform(twice, lambda w: w["i"]))
        # each window adds three words, or as many as lie before the next one
        return let(places, lambda p: F.aggregate(F.transform(p, lambda i, j: F.least(F.coalesce(F.get(p, j + 1), i + 3) - i, F.lit(3))), F.lit(0), lambda a, x: a + x))

    def clean(ordered: Column) -> Column:
        before = lambda j: F.get(ordered, F.greatest(j - 1, F.lit(0)))
        same = lambda a, b: (word(a) == word(b)) & (word(a + 1) == word(b + 1)) & (word(a + 2) == word(b + 2))
        flags = F.transform(ordered, lambda w, j: (j == 0) | (before(j)["x"] != w["x"]) | same(before(j)["i"], w["i"]))
        return F.forall(flags, lambda x: x)

    def counted(h: Column) -> Column:
        settled = let(placed(h), lambda o: F.when(clean(o), covered(o)).otherwise(let(placed(strings), covered)))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(settled)

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(hashes, counted))


def _without(text: Column, chars: str) -> Column:
    """Length of the text without these characters; replacing one after another is faster than a translation."""
    for c in chars:
        text = F.replace(text, F.lit(c))
    return F.length(text)


def _made(text: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = {
        "n_words": F.size(words),
        "word_chars": _without(text, " " + BLANKS),
        "n_symbols": F.length(text) - _without(text, SYMBOLS),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": _repeat_words(words),
        "n_bangs": F.length(text) - _without(text, "!"),
        "n_digits": F.length(text) - _without(text, "0123456789"),
    }
    return {k: v.cast("long") for k, v in made.items()}


#: Features that a report returns.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def metrics(text: Column, names=REPORTED) -> Column:
    """Features of a text as one struct, its words split once."""
    text = F.coalesce(text, F.lit(""))

    def struct(words: Column) -> Column:
        made = _made(text, words)
        return F.struct(*[made[k].alias(k) for k in names])

    return let(words_of(text), struct)


def lazy_features(text: Column) -> Features:
    """Features computed where a rule asks for them, so that a rule that is not reached costs nothing."""
    text = F.coalesce(text, F.lit(""))
    return lambda name: let(words_of(text), lambda w: _made(text, w)[name]) if name == "n_repeat_words" else _made(text, words_of(text))[name]


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], Column]


#: Integer forms of the usual ratio rules, so that any engine gives the same verdicts.
RULES = (
    Rule("short", lambda f: f("n_words") < 50),
    Rule("repeats", lambda f: 100 * f("n_repeat_words") > 50 * f("n_words")),
    Rule("symbols", lambda f: 100 * f("n_symbols") > 20 * f("n_words")),
    Rule("shouting", lambda f: 100 * f("n_bangs") > 60 * f("n_words")),
    Rule("long_words", lambda f: f("word_chars") > 40 * f("n_words")),
    Rule("numbers", lambda f: 100 * f("n_digits") > 50 * f("word_chars")),
)
#: Rows on which costs and selectivities are estimated, one of ``SAMPLE_EVERY`` by digest, and runs of which the
#: fastest counts; they decide the order of tests only.
SAMPLE_ROWS, SAMPLE_EVERY, SAMPLE_RUNS = 256, 4, 2


def order_rules(docs: DataFrame, rules=RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second on the sample, best first."""
    text_of = docs.select(F.col(text).alias("text"))
    sample = text_of.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_EVERY)) == 0).limit(sample_rows).persist()
    try:
        sample.count()

        def timed(flag: Column) -> tuple[float, int]:
            counted, took = sample.agg(F.sum(F.coalesce(flag, F.lit(False)).cast("int"))), []
            for _ in range(SAMPLE_RUNS):
                began = time.perf_counter()
                hits = counted.first()[0] or 0
                took.append(time.perf_counter() - began)
            return min(took), hits

        idle = timed(F.length("text") < 0)[0]
        features = lazy_features(F.col("text"))
        scored = []
        for k, rule in enumerate(rules):
            cost, hits = timed(rule.rejects(features))
            scored.append((-(hits + 0.5) / max(cost - idle, 1e-3), k, rule))
        return [x[2] for x in sorted(scored, key=lambda x: x[:2])]
    finally:
        sample.unpersist()


def first_failed(features: Features, ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules are not evaluated."""
    chain = None
    for rule in ordered:
        flag = rule.rejects(features)
        chain = F.when(flag, F.lit(rule.name)) if chain is None else chain.when(flag, F.lit(rule.name))
    return F.lit(None).cast("string") if chain is None else chain


def quality_filter(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """The rows that no rule rejects, columns unchanged."""
    ordered = order_rules(docs, rules, text)
    return docs.where(first_failed(lazy_features(F.col(text)), ordered).isNull())


def quality_report(docs: DataFrame, rules=RULES, text: str = "text") -> DataFrame:
    """Every row with its reported features (struct ``m``) and the verdict of the cascade (``failed_rule``).

    Rules over reported features cost nothing more, so they come first; the others follow in the
    cascade's order and compute what they need only for rows that got so far.
    """
    docs = aside(docs, "m", "failed_rule")
    text = f"{text}_input" if text in ("m", "failed_rule") else text
    asked: dict[str, set[str]] = {r.name: set() for r in rules}
    for r in rules:
        r.rejects(lambda name, r=r: asked[r.name].add(name) or F.lit(0))
    ordered = sorted(order_rules(docs, rules, text), key=lambda r: not asked[r.name] <= set(REPORTED))
    lazy = lazy_features(F.col(text))
    scored = docs.withColumn("m", metrics(F.col(text)))
    return scored.withColumn("failed_rule", first_failed(lambda name: F.col(f"m.{name}") if name in REPORTED else lazy(name), ordered))
