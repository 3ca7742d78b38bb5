"""Quality rules as weak supervision.

Each rule votes good or bad, or abstains. Expectation-maximisation over the counts of vote
patterns (at most 3 to the number of rules, so a bounded table) estimates the share of good
documents and, for each rule, how often it is right on good and on bad ones, with a weak prior of a
thousandth of all documents. The posterior probability of being good decides, in place of the
conjunction of all rules.

Documents that fail the base rule are out already, so the rates come from the others.

Features are row-local expressions: the text is read once and never shuffled. The features are
written once, as the pattern counts and the result both need them.

Defined results: a null text counts as empty. No words: all counts are 0 and the base rule
fails. Repeated rows are judged each by itself. An empty table gives an empty result. Other
columns are not looked at.
"""

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm.columns import documents, let, words
from netlens.storage import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_FROM = 0.5
ITERATIONS = 500
#: Pseudo-counts of the rates, in documents and as a part of all, and the prior's rates, which are also the starting values.
PRIOR, PRIOR_PART = 2.0, 0.001
START_GOOD, START_BAD, START_SHARE = 0.98, 0.5, 0.9

SYMBOLS = "[#*$%&|<>]"
LETTER = r"\p{L}"
NOT_BLANK = r"[^ \t\n\x0B\f\r]"


def repeated_words(w: Column) -> Column:
    """How many words of the array lie in a 3-word window that occurs at least twice in it.

    Windows are sorted as (shortened hash, position) in one long; a window whose neighbour has an equal hash is
    a candidate, so no repeat is missed. Candidates are sorted by their words, and equal neighbours are repeats.
    The words under them are the union of the windows' positions.
    """

    def alike(order: Column, j: Column, same: Callable[[Column, Column], Column]) -> Column:
        here = F.get(order, j)
        return F.coalesce(
            same(here, F.get(order, j - 1)),
            F.lit(False),
        ) | F.coalesce(same(here, F.get(order, j + 1)), F.lit(False))

    def counted(w: Column) -> Column:
        def candidates(shift: Column, order: Column) -> Column:
            key = lambda x: F.call_function("shiftright", x, shift)
            mask = F.call_function("shiftleft", F.lit(1).cast("long"), shift) - 1
            twice = F.filter(order, lambda x, j: alike(order, j, lambda a, b: key(a) == key(b)))
            at = let(mask, lambda m: F.transform(twice, lambda x: x.bitwiseAND(m).cast("int")))
            return let(
                at,
                lambda at: F.sort_array(
                    F.transform(
                        at,
                        lambda i: F.struct(
                            F.get(w, i).alias("a"),
                            F.get(w, i + 1).alias("b"),
                            F.get(w, i + 2).alias("c"),
                            i.alias("i"),
                        ),
                    )
                ),
            )

        def covered(order: Column) -> Column:
            twice = F.filter(
                order,
                lambda x, j: alike(order, j, lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])),
            )
            positions = F.sort_array(F.transform(twice, lambda x: x["i"].cast("long")))
            return let(
                positions,
                lambda p: F.aggregate(
                    F.transform(
                        p,
                        lambda x, j: F.coalesce(F.least(F.lit(3).cast("long"), F.get(p, j + 1) - x), F.lit(3).cast("long")),
                    ),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                ),
            )

        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )
        shift = F.length(F.bin(F.size(w).cast("long")))
        ordered = lambda s: F.sort_array(
            F.transform(windows, lambda h, i: F.call_function("shiftleft", h, s).bitwiseOR(i.cast("long")))
        )
        return let(let(shift, lambda s: let(ordered(s), lambda order: candidates(s, order))), covered)

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(counted(w))


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts of each whole text."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    of_words = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        repeated_words(w).alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"),
        F.size(F.filter(w, lambda x: x.rlike(LETTER))).cast("long").alias("n_letter_words"),
    )
    of_lines = lambda lines: F.struct(
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NOT_BLANK))
    found = docs.select(
        F.col(id_column).alias("doc_id"),
        let(words(text), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
        F.length(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    return found.select(
        "doc_id",
        "w.n_words",
        "word_chars",
        "n_symbols",
        "l.n_dup_lines",
        "w.n_repeat_words",
        "w.n_distinct_words",
        "w.n_letter_words",
        "l.n_lines",
    )


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes over the features: -1 bad, 0 abstains, 1 good."""
    c = F.col
    n = F.greatest(c("n_words"), F.lit(1))
    return {
        "length": vote(n < 60, n >= 150),
        "word_length": vote(
            (c("word_chars") < 3 * n) | (c("word_chars") > 7 * n),
            (c("word_chars") >= 4 * n) & (2 * c("word_chars") <= 13 * n),
        ),
        "symbols": vote(10 * c("n_symbols") > n, 50 * c("n_symbols") <= n),
        "letters": vote(5 * c("n_letter_words") < 4 * n, 20 * c("n_letter_words") >= 19 * n),
        "repeated_lines": vote(10 * c("n_dup_lines") > 3 * c("n_lines"), 20 * c("n_dup_lines") <= c("n_lines")),
        "repeated_words": vote(5 * c("n_repeat_words") > n, 20 * c("n_repeat_words") <= n),
        "distinct_words": vote(c("n_distinct_words") < F.lit(6.0) * F.sqrt(n), c("n_distinct_words") >= F.lit(9.0) * F.sqrt(n)),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], size: int) -> tuple[float, list[tuple[float, float]]]:
    """Share of good documents, and for each rule how often its vote is right on good and on bad ones."""
    share, rates = START_SHARE, [(START_GOOD, START_BAD)] * size
    total = sum(n for _, n in patterns)
    prior = PRIOR + PRIOR_PART * total
    for _ in range(ITERATIONS if total else 0):
        good = 0.0
        sums = [[0.0] * 4 for _ in range(size)]
        for votes, n in patterns:
            p = posterior(votes, share, rates)
            good += n * p
            for s, v in zip(sums, votes, strict=True):
                if v:
                    s[0] += n * p * (v > 0)
                    s[1] += n * p
                    s[2] += n * (1 - p) * (v < 0)
                    s[3] += n * (1 - p)
        share = (good + prior * START_SHARE) / (total + prior)
        rates = [((s[0] + prior * START_GOOD) / (s[1] + prior), (s[2] + prior * START_BAD) / (s[3] + prior)) for s in sums]
    return share, rates


def weights(share: float, rates: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of being good: the start, and what a good and a bad vote of each rule add."""
    odds = [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in rates]
    return math.log(share / (1 - share)), odds


def posterior(votes: tuple[int, ...], share: float, rates: list[tuple[float, float]]) -> float:
    start, odds = weights(share, rates)
    x = start + sum(o[0] if v > 0 else o[1] for v, o in zip(votes, odds, strict=True) if v)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Features, ``base_failed``, ``p_good`` (posterior) and ``kept`` of each document."""
    found = materialize(features(docs, id_column, text_column), "quality-features")
    voted = rules()
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    counts = found.where(~failed).groupBy(*(column.alias(name) for name, column in voted.items())).count()
    patterns = sorted((tuple(r[name] for name in voted), r["count"]) for r in counts.collect())
    start, odds = weights(*estimate(patterns, len(voted)))
    score = F.lit(start)
    for column, (good, bad) in zip(voted.values(), odds, strict=True):
        score = score + F.when(column > 0, good).when(column < 0, bad).otherwise(0.0)
    p_good = 1 / (1 + F.exp(-score))
    return found.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (p_good >= KEEP_FROM)).alias("kept"),
        p_good.alias("p_good"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
