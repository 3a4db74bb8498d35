"""Quality rules as weak supervision, with DataFrame functions only.

Each rule looks at one measure of a text and votes for good, for bad, or abstains. No rule decides: whether a document is
good is a hidden label. Bad documents are of several kinds, one for each rule, since a rule against tables says little of
shouted text; with a single bad class the rules that see the same fault would agree on that fault alone. A rule has an
accuracy on good documents and one on each kind. These, and the shares of the classes, are estimated by
expectation-maximisation from how the votes of all documents agree; no labels are read. A document is kept if the posterior
probability that it is good is high enough.

Votes are counted by pattern first: with R rules there are 3^R patterns at most, whatever the number of documents, so a
round of the estimation is one aggregation of a small table, and the driver sees one row of sums for each round. A text's
measures are taken in one narrow pass; nothing but the counts of patterns is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import let
from ..session import discard, materialise

# What parts words, and the characters that count as symbols.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

LEAST_WORDS, MOST_REPEATED = 50, 50
# Classes of characters, as a pattern of runs of them.
_BLANK, _SYMBOL, _CAPITAL, _MARK = f"[{BLANKS}]+", f"[{SYMBOLS}]+", "[A-Z]+", r"[!-@\[-`{-~]+"


@dataclass(frozen=True)
class Rule:
    """Votes bad outside [bad_below, bad_above], good inside [good_from, good_to], and abstains between or without a value."""

    name: str
    measure: str  # SQL over the measures
    good_from: float = float("-inf")
    good_to: float = float("inf")
    bad_below: float = float("-inf")
    bad_above: float = float("inf")

    def vote(self) -> Column:
        """'+' for good, '-' for bad, '0' for none."""
        value = F.expr(self.measure)
        return (
            F.when(value.isNull(), "0").when((value < self.bad_below) | (value > self.bad_above), "-")
            .when((value >= self.good_from) & (value <= self.good_to), "+").otherwise("0"))


RULES = (
    Rule("length", "n_words", good_from=100, bad_below=50),
    Rule("word length", "word_chars / nullif(n_words, 0)", good_from=3.5, good_to=8, bad_below=3, bad_above=10),
    Rule("symbols", "n_symbols / nullif(n_words, 0)", good_to=0.02, bad_above=0.1),
    Rule("repeated windows", "n_repeat_words / nullif(n_words, 0)", good_to=0.1, bad_above=0.3),
    Rule("duplicate lines", "CASE WHEN n_lines >= 5 THEN n_dup_lines / n_lines END", good_to=0.1, bad_above=0.3),
    Rule("capitals", "n_capitals / nullif(word_chars, 0)", good_to=0.1, bad_above=0.35),
    Rule("marks", "n_marks / nullif(word_chars, 0)", good_to=0.08, bad_above=0.25),
    Rule("line ends", "CASE WHEN n_lines >= 5 THEN n_ended_lines / n_lines END", good_from=0.6, bad_below=0.12),
    Rule("distinct words", "CASE WHEN n_words >= 20 THEN n_distinct_words / pow(n_words, 0.75) END", good_from=1.0, bad_below=0.4),
)


def _outside(pattern: str) -> Column:
    """How many characters of the text lie outside the runs; far cheaper than translate()."""
    return F.length(F.regexp_replace("text", pattern, ""))


def _repeats(words: Column) -> Column:
    """How many words stand in a window of three that occurs twice or more: windows are sorted with their places, equal
    ones are then neighbours, and what the places of those cover is counted."""
    inner = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    windows = F.transform(inner, lambda word, k: F.struct(F.concat(word, F.lit(" "), F.get(words, k + 1), F.lit(" "), F.get(words, k + 2)).alias("text"), k.alias("at")))
    same = lambda a, b: F.coalesce(a.text == b.text, F.lit(False))
    covered = lambda at: F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - x, F.lit(3)))), F.lit(0), lambda n, x: n + x)
    found = lambda s: F.transform(F.filter(s, lambda e, k: same(e, F.get(s, k + 1)) | same(e, F.get(s, k - 1))), lambda e: e.at)
    return let(F.sort_array(windows), lambda s: let(F.sort_array(found(s)), covered))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and counts of each row's whole text; a null text has no words."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    cut = texts.select(
        "doc_id", "text", F.array_remove(F.split("text", _BLANK), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: F.regexp(line, F.lit(f"[^{BLANKS}]"))).alias("lines"))
    chars = F.length("text")
    ended = F.filter("lines", lambda line: F.regexp(line, F.lit(r"[.!?:\"'…。！？»”][ \t\x0b\x0c\r]*$")))
    counts = {
        "n_words": F.size("words"), "word_chars": _outside(_BLANK), "n_symbols": chars - _outside(_SYMBOL),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")), "n_repeat_words": let(F.col("words"), _repeats),
        "n_lines": F.size("lines"), "n_ended_lines": F.size(ended), "n_distinct_words": F.size(F.array_distinct("words")),
        "n_capitals": chars - _outside(_CAPITAL), "n_marks": chars - _outside(_MARK),
    }
    return cut.select("doc_id", *(c.cast("long").alias(n) for n, c in counts.items()))


#: Where the estimation begins: the share of good documents, how often a rule says bad of a good document, of the kind of
#: bad document that it looks for, and of another kind.
GOOD, ON_GOOD, ON_OWN, ON_OTHER = 0.8, 0.02, 0.9, 0.3


@dataclass(frozen=True)
class Accuracies:
    """shares[c] of documents are of class c, of which rule k says bad in says_bad[c][k] of its votes. Class 0 is good,
    class k + 1 the kind of bad that rule k looks for."""

    shares: tuple
    says_bad: tuple

    @staticmethod
    def assumed(rules: int) -> Accuracies:
        kinds = tuple(tuple(ON_OWN if k == j else ON_OTHER for k in range(rules)) for j in range(rules))
        return Accuracies((GOOD,) + ((1 - GOOD) / max(1, rules),) * rules, ((ON_GOOD,) * rules, *kinds))

    def posterior(self, votes: Column) -> Column:
        """An array of the probabilities of the classes, given an array of the places of the votes (see places)."""
        told = [[log(s)] + [x for bad in row for x in (log(bad), 0.0, log(1 - bad))] for s, row in zip(self.shares, self.says_bad)]
        classes = F.from_json(F.lit(str(told)), "array<array<double>>")  # one literal, which the plan folds
        odds = F.transform(classes, lambda c: F.aggregate(votes, F.get(c, F.lit(0)), lambda total, at: total + F.get(c, at)))
        scaled = let(odds, lambda z: F.transform(z, lambda x: F.exp(x - F.array_max(z))))
        return let(scaled, lambda e: let(F.aggregate(e, F.lit(0.0), lambda total, x: total + x), lambda whole: F.transform(e, lambda x: x / whole)))


def places(votes: Column) -> Column:
    """Of each rule's vote, written '-', '0' or '+', its place in a row of 1 + 3 numbers a rule."""
    marks = F.filter(F.split(votes, ""), lambda v: v != "")
    return F.transform(marks, lambda v, k: F.instr(F.lit("-0+"), v) + 3 * k)


def estimate(patterns: DataFrame, rules: int, rounds: int = 40, tolerance: float = 1e-3) -> Accuracies:
    """Expectation-maximisation over a table of patterns (votes, n); shares are smoothed by one document more for each outcome."""
    found = Accuracies.assumed(rules)
    # One partition: sums of the same numbers in the same order, without a shuffle.
    patterns = patterns.coalesce(1).select(places(F.col("votes")).alias("votes"), "n")
    for _ in range(rounds):
        expected = patterns.select("votes", "n", F.posexplode(found.posterior(F.col("votes"))).alias("class", "p")).select("class", (F.col("n") * F.col("p")).alias("n"), F.explode(F.array_append("votes", F.lit(0))).alias("at"))
        rows = {(r["class"], r["at"]): r["n"] for r in expected.groupBy("class", "at").agg(F.sum("n").alias("n")).collect()}  # at most (rules + 1) (3 rules + 1)
        sums = [[rows.get((c, at), 0.0) for at in range(3 * rules + 1)] for c in range(rules + 1)]
        total = sum(row[0] for row in sums)
        new = Accuracies(
            tuple((row[0] + 1) / (total + rules + 1) for row in sums),
            tuple(tuple((row[3 * k + 1] + 1) / (row[3 * k + 1] + row[3 * k + 3] + 2) for k in range(rules)) for row in sums))
        moved = max(abs(x - y) for x, y in zip((*new.shares, *sum(new.says_bad, ())), (*found.shares, *sum(found.says_bad, ()))))
        found = new
        if moved < tolerance:
            break
    return found


def judge(docs: DataFrame, rules: tuple = RULES, least: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, votes and posterior for every
    row of docs.

    base_failed: fewer than 50 words, or over half of them in repeated windows. kept: not so, and a posterior of `least` or
    more. A null or empty text has no words, so it fails. Rows that repeat an id give a row each; other columns do not
    matter, whatever their names; an empty table gives no rows. The same table gives the same verdicts however it is
    partitioned, but for a posterior that differs from `least` by no more than rounding.
    """
    if len(rules) > 10:
        raise ValueError("more than ten rules have too many patterns of votes")
    counted = measures(docs)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    table = materialise(counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.concat(*(r.vote() for r in rules)).alias("votes")))
    patterns = materialise(table.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1).sortWithinPartitions("votes"))
    found = estimate(patterns, len(rules))
    discard(patterns)
    posterior = F.get(found.posterior(places(F.col("votes"))), 0)
    return table.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (posterior >= least)).alias("kept"),
        "votes", F.round(posterior, 6).alias("posterior"))
