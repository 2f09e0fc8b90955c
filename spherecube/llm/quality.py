"""Quality by weak supervision, DataFrame functions only.

Rules look at figures of a text and vote good (1), bad (-1) or abstain (0), which says nothing. How accurate the votes of
each rule are, on good and on bad documents, is not known; expectation maximisation estimates it from how the rules agree over all documents, together
with the share of good ones. A document's verdict is its posterior probability of being good, not whether every rule passes it.

The estimation runs on the different vote patterns with their numbers of documents: at most 3 to the power of the number
of rules, whatever the number of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spherecube.runtime import materialise

from .common import WORD

#: Words of a window, for repeated windows.
WINDOW = 8
#: Fixed values of the base filter.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Steps of the estimation, and what it starts from: the share of good documents, and how often a rule that does not abstain
#: votes bad and good, on good and on bad documents. Rules seldom call a good document bad, and miss most faults of a bad one.
STEPS, GOOD = 20, 0.8
ON_GOOD, ON_BAD = (0.01, 0.99), (0.4, 0.6)

#: Frequent words of the languages that the rules know.
FREQUENT = "the of and to in that der die und das von den le la les de et des que el los del en un".split()


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words of an array that lie in a window of WINDOW words found twice or more, by 64-bit hashes of the windows.

    Window hashes come from pairs of half as long ones. Sorted with their places, equal ones are neighbours.
    """

    def doubled(h: Column, n: Column, width: int) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 2 * width), lambda i: F.xxhash64(h[i], h[i + width]))

    def covered(places: Column) -> Column:
        spans = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(spans, F.lit(0), lambda a, x: a + x)

    def repeated(sorted_: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(sorted_, j)["g"] == x["g"], F.lit(False))
        twice = F.filter(sorted_, lambda x, i: same(x, i - 1) | same(x, i + 1))
        return _let(F.sort_array(F.transform(twice, lambda x: x["p"])), covered)

    def of_windows(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(g)) < F.size(g), _let(placed, repeated)).otherwise(0)

    def of_words(h: Column) -> Column:
        n = F.size(h)
        two = lambda x: doubled(x, n, 1)
        eight = _let(two(h), lambda h2: _let(doubled(h2, n, 2), lambda h4: doubled(h4, n, 4)))
        return _let(eight, of_windows)

    enough = F.size(words) >= WINDOW
    return F.when(enough, _let(F.transform(words, lambda w: F.xxhash64(w)), of_words)).otherwise(0)


def figures(docs: DataFrame) -> DataFrame:
    """doc_id and the base figures of each row, with n_lines, n_capitals and n_frequent for the rules."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.regexp_extract_all("t", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("t", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    without = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    rows = docs.select("doc_id", text.alias("t")).select("doc_id", "t", words.alias("w"))
    line_counts = _let(lines, lambda x: F.struct(F.size(x).alias("all"), F.size(F.array_distinct(x)).alias("own")))
    frequent = F.array(*[F.lit(w) for w in FREQUENT])
    rows = rows.select("doc_id", "t", "w", line_counts.alias("lines"), repeated_words(F.col("w")).alias("repeated"))
    return rows.select(
        "doc_id", F.size("w").cast("long").alias("n_words"),
        (F.length("t") - without(" \t\n\x0b\f\r")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.col("lines.all") - F.col("lines.own")).cast("long").alias("n_dup_lines"),
        F.col("repeated").cast("long").alias("n_repeat_words"),
        F.col("lines.all").cast("long").alias("n_lines"),
        without("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÀÇÊÔÍÓÁÚÑ").cast("long").alias("n_capitals"),
        F.size(F.array_intersect(F.col("w"), frequent)).cast("long").alias("n_frequent"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> dict[str, Column]:
    """The rules, on the columns of `figures`; shares are compared as products of whole numbers."""
    n, c = F.col("n_words"), F.col
    return {
        "v_length": F.when(n >= 40, 1).otherwise(0),
        "v_word_length": F.when(n > 0, _vote((c("word_chars") >= 3 * n) & (c("word_chars") <= 10 * n), (c("word_chars") > 14 * n) | (c("word_chars") < 2 * n))).otherwise(-1),
        "v_symbols": _vote(50 * c("n_symbols") <= n, 10 * c("n_symbols") > n),
        "v_lines": F.when(c("n_lines") >= 2, _vote(c("n_dup_lines") == 0, (c("n_dup_lines") >= 3) & (10 * c("n_dup_lines") > 3 * c("n_lines")))).otherwise(0),
        "v_repeats": _vote(20 * c("n_repeat_words") <= n, 10 * c("n_repeat_words") > 3 * n),
        "v_capitals": _vote(10 * c("n_capitals") <= c("word_chars"), 10 * c("n_capitals") > 3 * c("word_chars")),
        "v_frequent": F.when(n >= 40, _vote(c("n_frequent") >= 2, c("n_frequent") == 0)).otherwise(0),
    }


def _posterior(given: Column, cast: Column) -> Column:
    """Probability of good of a document that cast these votes (their numbers); given: good, on_good, on_bad."""
    start = F.log(given["good"] / (1 - given["good"]))
    odds = F.aggregate(cast, start, lambda s, k: s + F.log(F.element_at(given["on_good"], k) / F.element_at(given["on_bad"], k)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def _cast(rules: list[str]) -> Column:
    """The numbers of the votes that a row casts: 2 j + 1 where rule j says bad, 2 j + 2 where it says good."""
    votes = F.array(*[F.when(F.col(r) == -1, 2 * j + 1).when(F.col(r) == 1, 2 * j + 2) for j, r in enumerate(rules)])
    return F.filter(votes, lambda k: k.isNotNull())


def estimate(voted: DataFrame, rules: list[str]) -> DataFrame:
    """One row `given`: the share of good documents, and how often each vote is cast on good and on bad ones.

    It is an aggregate over the steps, of an array of all different vote patterns with their numbers of documents.
    """
    patterns = voted.groupBy(*rules).agg(F.count("*").alias("n"))
    patterns = patterns.agg(F.collect_list(F.struct(F.col("n").cast("double").alias("n"), _cast(rules).alias("cast"))).alias("patterns"))
    guess = lambda of: F.array(*[F.lit(x) for _ in rules for x in of])
    start = F.struct(F.lit(GOOD).alias("good"), guess(ON_GOOD).alias("on_good"), guess(ON_BAD).alias("on_bad"))
    total = lambda rows, of: F.aggregate(rows, F.lit(0.0), lambda s, x: s + of(x))

    def step(given: Column, _) -> Column:
        shared = F.transform("patterns", lambda x: F.struct(x["cast"].alias("cast"), x["n"].alias("n"), (x["n"] * _posterior(given, x["cast"])).alias("good")))

        def update(rows: Column) -> Column:
            good, bad = total(rows, lambda x: x["good"]), total(rows, lambda x: x["n"] - x["good"])
            numbers = F.sequence(F.lit(1), F.lit(2 * len(rules)))
            casting = lambda k, of: total(F.filter(rows, lambda x: F.array_contains(x["cast"], k)), of)
            other = lambda k: k + F.when(k % 2 == 0, -1).otherwise(1)
            share = lambda k, of: (casting(k, of) + 1) / (casting(k, of) + casting(other(k), of) + 2)
            return F.struct(
                F.least(F.greatest((good + 1) / (good + bad + 2), F.lit(0.05)), F.lit(0.95)).alias("good"),
                F.transform(numbers, lambda k: share(k, lambda x: x["good"])).alias("on_good"),
                F.transform(numbers, lambda k: share(k, lambda x: x["n"] - x["good"])).alias("on_bad"),
            )

        return _let(shared, update)

    return patterns.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step).alias("given"))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, posterior per row of `docs`.

    A null text has no words. base_failed: under 20 words, or over 30 of 100 words in repeated windows. kept: not
    base_failed, and the posterior is at least 0.5. Rows are judged each by itself, whatever their ids, but all of them
    count for the estimation; other columns than doc_id and text are not looked at.
    """
    rules = votes()
    voted = materialise(figures(docs).select("*", *[v.alias(k) for k, v in rules.items()]))
    given = materialise(estimate(voted, list(rules)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    judged = voted.crossJoin(given).withColumn("posterior", _posterior(F.col("given"), _cast(list(rules))))  # one row
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= 0.5)).alias("kept"), "posterior",
    )
