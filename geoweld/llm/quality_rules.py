"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule rejects a text, by figures of its own. A bounded share of the rows, drawn by chance, gives
every rule's cost (seconds of a run over the sample, less those of a run without a rule) and selectivity (share it
rejects); the cascade is one CASE whose branches stand in order of rejection
per cost, so a row that an early branch rejects never pays for the figures of the later ones.
The verdict is the disjunction of the rules whatever their order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweld.llm.common import checkpointed, free_name, words_of

#: Words in a window of the repetition figure.
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """reject: from the columns of MEASURES, by name, to a boolean column, true where the text is refused."""

    name: str
    reject: Callable[[Mapping[str, Column]], Column]


#: What a rule costs at least, as shorter times can't be told from chance.
LEAST_SECONDS = 0.001


@dataclass(frozen=True)
class RuleCost:
    name: str
    seconds: float
    rejected: float

    @property
    def rank(self) -> float:
        return self.rejected / self.seconds


def worded_lines(text: Column) -> Column:
    return F.filter(
        F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))
    )


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = worded_lines(text)
    return F.size(lines) - F.size(F.array_distinct(lines))


def _lines_like(text: Column, pattern: str) -> Column:
    return F.size(F.filter(worded_lines(text), lambda x: F.regexp_like(x, F.lit(pattern))))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value to a name for body, so that body's uses of it evaluate it once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_in_repeats(words: Column, window: int = WINDOW) -> Column:
    """How many of the words lie in a window of `window` words which the text holds twice or more.

    Windows are compared by a 64-bit hash. Only texts in which two hashes agree
    pay for the sort that finds their places; n log n in the words of the text.
    The hash of a window joins those of its halves, so it takes log(window) steps.
    """

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(ordered, lambda s: _let(F.size(s), lambda n: _let(
            F.sort_array(F.transform(
                F.filter(s, lambda x, i: (F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)))
                         | (F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))),
                lambda x: x["i"])),
            lambda at: F.aggregate(
                F.transform(at, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - p, F.lit(window)))),
                F.lit(0), lambda total, x: total + x))))

    def paired(hashes: Column, apart: int, upto: Column | None = None) -> Column:
        """Hashes of the windows twice as long: each hash with the one `apart` places on."""
        of = hashes if upto is None else F.slice(hashes, F.lit(1), upto)
        return F.transform(of, lambda h, i: F.xxhash64(h, F.get(hashes, i + apart)))

    if window & (window - 1):
        raise ValueError("the window must be a power of two")

    def doubled(hashes: Column, length: int, n: Column) -> Column:
        if 2 * length < window:
            return _let(paired(hashes, length), lambda h: doubled(h, 2 * length, n))
        return paired(hashes, length, n - (window - 1))

    hashes = F.when(
        F.size(words) >= window,
        _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: doubled(h, 1, F.size(words))),
    )
    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0)))


#: A line that ends as a sentence, a heading or a quotation does.
ENDED = r"[.!?:;…\"')\]»”][\x20\x09-\x0D]*$"

#: From the text and its words to a figure.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda text, words: F.size(words),
    "word_chars": lambda text, words: F.length(F.array_join(words, "")),
    "n_symbols": lambda text, words: F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>]")), F.lit(0)),
    "n_dup_lines": lambda text, words: duplicate_lines(text),
    "n_repeat_words": lambda text, words: words_in_repeats(words),
    "n_lines": lambda text, words: F.size(worded_lines(text)),
    "n_capital_words": lambda text, words: F.size(F.filter(words, lambda w: (w == F.upper(w)) & (w != F.lower(w)) & (F.length(w) >= 2))),
    "n_letter_words": lambda text, words: F.size(F.filter(words, lambda w: F.regexp_like(w, F.lit(r"\p{L}")))),
    "n_ended_lines": lambda text, words: _lines_like(text, ENDED),
    "n_trailing_lines": lambda text, words: _lines_like(text, r"(\.\.\.|…)[\x20\x09-\x0D]*$"),
    "n_bullet_lines": lambda text, words: _lines_like(text, r"^[\x20\x09-\x0D]*[-*•]"),
}
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measures(dict):
    """MEASURES as columns over a text and its words; a rule computes the ones it names."""

    def __init__(self, text: Column, words: Column):
        super().__init__({k: f(text, words).cast("long") for k, f in MEASURES.items()})


#: Fixed limits, those of the lines only for texts with five or more.
RULES = (
    Rule("too_short", lambda m: m["n_words"] < 20),
    Rule("repetitive", lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"]),
    Rule("symbols", lambda m: 10 * m["n_symbols"] > m["n_words"]),
    Rule("capitals", lambda m: 10 * m["n_capital_words"] > 4 * m["n_words"]),
    Rule("letters", lambda m: 10 * m["n_letter_words"] < 8 * m["n_words"]),
    Rule("line_ends", lambda m: (m["n_lines"] >= 5) & (10 * m["n_ended_lines"] < m["n_lines"])),
    Rule("trailing_off", lambda m: (m["n_lines"] >= 5) & (10 * m["n_trailing_lines"] > 3 * m["n_lines"])),
    Rule("bullets", lambda m: (m["n_lines"] >= 5) & (10 * m["n_bullet_lines"] > 9 * m["n_lines"])),
    Rule("word_length", lambda m: ~m["word_chars"].between(1.5 * m["n_words"], 40 * m["n_words"])),
    Rule("repeated_lines", lambda m: 10 * m["n_dup_lines"] > 8 * m["n_lines"]),
)
BASE = ("too_short", "repetitive")


#: Partitions of the sample, whose size doesn't grow with the table.
SAMPLE_PARTITIONS = 4


def rule_costs(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 4000, seed: int = 7, runs: int = 2) -> list[RuleCost]:
    """Cost and selectivity of each rule on about sample_rows rows, the most by rejection per cost first.

    The sample is drawn once and kept with its words; only two counts a rule
    come to the driver. A rule's cost is its fastest of some runs less that of a run without a rule, so
    what any job takes doesn't count. On an empty table every rule rejects nothing and they go by cost.
    """
    total = docs.count()
    share = min(1.0, sample_rows / total) if total else 1.0
    # in a few partitions, or each of the runs would have a task for every one of the table's
    sample = docs.select(F.col(text).alias("text")).sample(False, share, seed).repartition(SAMPLE_PARTITIONS)
    sample = checkpointed(sample.withColumn("words", words_of(F.col("text"))))
    measures = Measures(F.col("text"), F.col("words"))

    def timed(rejects: Column) -> tuple[float, float]:
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            seen, rejected = sample.agg(F.count(F.lit(1)), F.count_if(rejects)).first()
            took.append(time.perf_counter() - began)
        return min(took), rejected / max(seen, 1)

    bare = timed((F.length("text") < 0) | (F.size("words") < 0))[0]
    found = []
    for rule in rules:
        seconds, rejected = timed(rule.reject(measures))
        found.append(RuleCost(rule.name, max(seconds - bare, LEAST_SECONDS), rejected))
    return sorted(found, key=lambda c: (-c.rank, c.seconds, c.name))


def verdict(measures: Mapping[str, Column], rules: Sequence[Rule], order: Sequence[str]) -> Column:
    """True if no rule rejects. The branches of the CASE are tried in the given order."""
    by_name, cascade = {r.name: r for r in rules}, F
    for name in order:
        cascade = cascade.when(by_name[name].reject(measures), F.lit(False))
    return cascade.otherwise(F.lit(True)) if order else F.lit(True)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 4000) -> DataFrame:
    """The rows that the cascade keeps, with the columns of docs; rows repeat as they do there.

    A null text has no words and goes as too short; so does an empty one.
    """
    order = [c.name for c in rule_costs(docs, rules, text, sample_rows)]
    # bound within the predicate: a column of words would be put in its place each time once Catalyst pushes the filter down
    return docs.where(_let(words_of(F.col(text)), lambda words: verdict(Measures(F.col(text), words), rules, order)))


def judged(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 4000) -> DataFrame:
    """Every row of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    The base figures are wanted for every row, so rules read them off; the rules that aren't
    base rules form the cascade for the rows that pass the base, and compute their other figures within it. A null text
    has zeros and fails; an empty table gives an empty result. Columns of docs
    under one of the names made here are replaced, others stay.
    """
    rest = [r for r in rules if r.name not in BASE]
    order, words = [c.name for c in rule_costs(docs, rest, text, sample_rows)], free_name(docs, "words_of_text")
    made = Measures(F.col(text), F.col(words))
    old = [c for c in docs.columns if c.lower() not in {*FIGURES, "base_failed", "kept"}]
    with_figures = docs.withColumn(words, words_of(F.col(text))).select(*old, words, *(made[k].alias(k) for k in FIGURES))
    measures = made | {k: F.col(k) for k in FIGURES}
    failed = F.lit(False)
    for rule in (r for r in rules if r.name in BASE):
        failed = failed | rule.reject(measures)
    return (
        with_figures.withColumn("base_failed", failed)
        .withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(measures, rest, order)))
        .drop(words)
    )
