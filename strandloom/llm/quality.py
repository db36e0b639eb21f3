"""Quality rules combined by weak supervision.

Rules on counts of a text vote good, bad or abstain. Expectation-maximisation over all texts
estimates each rule's accuracy on good and on bad texts and the share of good ones, without
labels; a text's posterior probability of being good replaces the demand that all rules pass.
Counts, votes and posteriors are DataFrame expressions. The model sees texts only as counts of
vote patterns, of which there are at most 3 to the power of the number of rules.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, materialize, words_of

_SEPARATORS = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeated(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text."""

    def of_windows(h: Column) -> Column:
        # h: hash of the window at each place. Sorted with their places, equal windows are neighbours.
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            same = lambda a, k: F.coalesce(F.get(s, k)["h"] == a["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda a, k: same(a, k - 1) | same(a, k + 1)), lambda a: a["i"]))

        def covered(p: Column) -> Column:
            # A window covers three words, or those up to the next window.
            return F.aggregate(p, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")), lambda s: s["n"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_let(pairs, lambda s: covered(places(s))))

    windows = F.transform(F.slice(words, F.lit(3), F.size(words)), lambda w, i: F.xxhash64(F.get(words, i), F.get(words, i + 1), w))
    return F.when(F.size(words) < 4, 0).otherwise(_let(windows, of_windows))


def counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id and the counts that rules use; a null text counts as empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    without = lambda t, chars: F.char_length(F.translate(t, chars, ""))
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).cast("long").alias("n_repeat_words"), F.size(F.filter(w, lambda x: x.rlike(r"[#*$%&|<>]"))).cast("long").alias("n_symbol_words"))
    worded = F.filter(F.split(F.col("text"), "\n", -1), lambda x: x.rlike(WORD_CLASS))
    of_lines = lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"),
        (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(x, lambda y: y.rlike(r"[.!?…:;,»”\"')\]][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
    )
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n = F.char_length("text")
    d = d.select(
        "doc_id",
        _let(words_of(F.col("text")), of_words).alias("w"),
        _let(worded, of_lines).alias("x"),
        without(F.col("text"), _SEPARATORS).cast("long").alias("word_chars"),
        (n - without(F.col("text"), _SYMBOLS)).cast("long").alias("n_symbols"),
        (n - without(F.col("text"), _MARKS)).cast("long").alias("n_marks"),
        (n - without(F.col("text"), _UPPER)).cast("long").alias("n_upper"),
    )
    return d.select("doc_id", "w.n_words", "word_chars", "n_symbols", "x.n_dup_lines", "w.n_repeat_words", "w.n_symbol_words", "x.n_lines", "x.n_ended", "n_marks", "n_upper")


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))




def rules() -> dict[str, tuple[Column, Column]]:
    """The rules, by name: when they vote good, and when bad; else they abstain."""
    length = _share("word_chars", "n_words")
    symbols = _share("n_symbols", "n_words")
    symbol_words = _share("n_symbol_words", "n_words")
    marks = _share("n_marks", "word_chars")
    upper = _share("n_upper", "word_chars")
    same_lines = _share("n_dup_lines", "n_lines")
    again = _share("n_repeat_words", "n_words")
    ended = _share("n_ended", "n_lines")
    n = F.col("n_words")
    return {
        "length": (n.between(80, 50_000), (n < 50) | (n > 200_000)),
        "word_length": (length.between(3, 9), (length < 2) | (length > 14)),
        "symbols": (symbols <= 0.02, symbols > 0.2),
        "symbol_words": (symbol_words <= 0.03, symbol_words > 0.25),
        "marks": (marks <= 0.08, marks > 0.12),
        "upper_case": (upper <= 0.15, upper > 0.5),
        "repeated_lines": ((same_lines <= 0.1) & (F.col("n_lines") > 1), same_lines > 0.3),
        "repeated_words": (again <= 0.15, again > 0.4),
        "line_ends": (ended >= 0.7, (ended < 0.2) & (F.col("n_lines") > 3)),
    }


#: What is supposed of a rule before any text is seen, as votes counted beside the texts' own: (share right, votes) on good
#: texts, which thresholds are set for, and on bad ones, of which a rule may find one kind only. A few texts outweigh them.
GOOD_PRIOR, BAD_PRIOR, SHARE_PRIOR = (0.95, 10.0), (0.4, 2.0), (0.5, 2.0)
_START = 0.8, (0.95, 0.4)


def fit(patterns: list[tuple[tuple[int | None, ...], int]], rounds: int = 300, good_prior=GOOD_PRIOR, bad_prior=BAD_PRIOR, share_prior=SHARE_PRIOR) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation on (votes, count) patterns, votes 1 good, 0 bad, None abstain.

    Returns the share of good texts, and for each rule the probabilities to vote good on a good
    text and bad on a bad one, given that it votes: the most probable ones under the weak priors,
    which keep them between 0 and 1. The first guess tells the good class from the bad one.
    Ends when nothing moves any more, or after `rounds`. Without votes the priors stand.
    """
    k = len(patterns[0][0]) if patterns else len(rules())
    prior, acc = _START[0] if patterns else share_prior[0], [_START[1] if patterns else (good_prior[0], bad_prior[0])] * k
    for _ in range(rounds if patterns else 0):
        good, bad = [[good_prior[0] * good_prior[1], good_prior[1]] for _ in range(k)], [[bad_prior[0] * bad_prior[1], bad_prior[1]] for _ in range(k)]
        share, total = share_prior[0] * share_prior[1], share_prior[1]
        for votes, n in patterns:
            p = posterior(votes, prior, acc)
            share += n * p
            total += n
            for j, v in enumerate(votes):
                if v is not None:
                    good[j][0] += n * p * v
                    good[j][1] += n * p
                    bad[j][0] += n * (1 - p) * (1 - v)
                    bad[j][1] += n * (1 - p)
        before = [prior, *(x for pair in acc for x in pair)]
        prior, acc = share / total, [(g[0] / g[1], b[0] / b[1]) for g, b in zip(good, bad)]
        if max(abs(x - y) for x, y in zip(before, [prior, *(x for pair in acc for x in pair)])) < 1e-10:
            break
    return prior, acc


def posterior(votes: tuple[int | None, ...], prior: float, acc: list[tuple[float, float]]) -> float:
    """Probability that a text with these votes is good."""
    x = math.log(prior / (1 - prior))
    for v, (g, b) in zip(votes, acc):
        if v is not None:
            x += math.log(g / (1 - b)) if v else math.log((1 - g) / b)
    return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per row of docs(doc_id, text): the counts, base_failed, quality (posterior) and kept.

    base_failed: under 50 words, or more than half of the words in repeated three-word windows.
    kept: not base_failed, and quality of at least `least`: a posterior on the line is kept.
    Null texts count as empty and fail; a null doc_id stays null. Rows that repeat stay apart and
    count each; other columns are ignored, whatever their names; an empty table stays empty.
    """
    vote = [F.when(bad, 0).when(good, 1).alias(name) for name, (good, bad) in rules().items()]
    names = list(rules())
    c = materialize(counts(docs).select("*", *vote), "votes")
    seen = c.groupBy(*names).count().collect()  # at most 3 ** rules rows
    patterns = sorted(((tuple(r[x] for x in names), r["count"]) for r in seen), key=str)
    prior, acc = fit(patterns)
    x = F.lit(math.log(prior / (1 - prior)))
    for name, (g, b) in zip(names, acc):
        x = x + F.when(F.col(name) == 1, math.log(g / (1 - b))).when(F.col(name) == 0, math.log((1 - g) / b)).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = c.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-x)))
    kept = ~F.col("base_failed") & (F.col("quality") >= least)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "quality")
