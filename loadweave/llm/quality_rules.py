"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Base counts of a text (null: empty): words between ASCII white space, their code
points, symbols, repeated lines, and words in repeated 3-word windows. A text of
fewer than 50 words, or with over half of its words in repeated windows, fails.

Beyond that, rules of the form "score above cutoff: reject" get their cutoffs from
labels. Labelled good documents are the holdout on which false rejections count. For each
stratum (language), rule and cutoff of a fixed grid, the exact binomial tail gives
the p-value of the hypothesis "this rule rejects over RISK / rules of good documents".
A cutoff qualifies if its p-value is at most FAILURE / (strata * rules) (Bonferroni),
which is the Clopper-Pearson upper bound at that level lying below the risk. Within a
rule cutoffs are tested in the order given, from the highest down to the first that fails; a fixed
sequence needs no further correction, and as counts only grow downwards it ends at the lowest that
qualifies. A stratum without one, or without labels, rejects nothing. So with probability 1 - FAILURE, in all strata at once, at most RISK of good
documents are rejected by all rules together, on top of the base rules.

``passing`` tests joint settings instead, one cutoff for all rules: a good document that any
rule rejects counts once, at the whole RISK and FAILURE / strata. That is one fixed
sequence per stratum with the same guarantee, and a third of the labels is enough (438 good
documents for four strata). ``verdicts`` keeps a cutoff per rule, as its SQL twin has it.

Windows are compared by their XXH64 within one text, so two unequal ones count as
equal with a chance below 1e-9 even in a text of 100,000 words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadweave.llm.common import SPACED_WORD, let
from loadweave.session import pin

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
SYMBOLS = "#*$%&|<>"
WINDOW = 3
RISK = 0.01
FAILURE = 0.05
# rule: (count, per) in whole promille; the grid is fixed before any label is seen
RULES = {
    "symbols_to_words": ("n_symbols", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
}
CUTOFFS = (10, 20, 50, 100, 150, 200, 250, 300, 400, 500, 650, 800, 1000, 1500, 2000)


def _repeated(words: Column) -> Column:
    """Words of an array that lie in 3-word windows found twice or more."""
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - WINDOW),
        lambda i: F.struct(
            F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")
        ),
    )

    def starts(s):
        # sorted by hash: a window that occurs again has an equal neighbour
        hashes = s["h"]
        return let(
            hashes,
            lambda h: F.transform(
                F.filter(
                    F.transform(s, lambda x, k: F.struct(x["i"].alias("i"), k.alias("k"))),
                    lambda x: (F.get(h, x["k"]) == F.get(h, x["k"] + 1))
                    | (F.get(h, x["k"]) == F.get(h, x["k"] - 1)),
                ),
                lambda x: x["i"],
            ),
        )

    def covered(p):
        # sorted starts: each covers three words, or as many as lie before the next
        return F.aggregate(
            F.transform(
                p,
                lambda x, k: F.least(
                    F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))
                ).cast("long"),
            ),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )

    counted = let(
        F.sort_array(windows),
        lambda s: let(F.sort_array(starts(s)), covered),
    )
    return F.when(F.size(words) > WINDOW, counted).otherwise(F.lit(0).cast("long"))


def measured(text: Column) -> Column:
    """The base counts of a text as one struct column, computed once per row."""
    text = F.coalesce(text, F.lit(""))

    def counts(t):
        words = F.regexp_extract_all(t, F.lit(SPACED_WORD), F.lit(0))
        with_word = F.filter(F.split(t, "\n"), lambda line: line.rlike(SPACED_WORD))
        return let(
            F.struct(words.alias("words"), with_word.alias("lines")),
            lambda x: F.struct(
                F.size(x["words"]).cast("long").alias("n_words"),
                F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
                F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
                (F.size(x["lines"]) - F.size(F.array_distinct(x["lines"])))
                .cast("long")
                .alias("n_dup_lines"),
                _repeated(x["words"]).alias("n_repeat_words"),
                F.size(x["lines"]).cast("long").alias("n_lines"),
            ),
        )

    return let(text, counts)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (
        m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEATED_PERCENT
    )


def _above(m: Column, rule: str, cutoff) -> Column:
    count, per = RULES[rule]
    return m[count] * 1000 > m[per] * cutoff


def _log_tail(rejected: Column, good: Column, risk: float) -> Column:
    """P(Binomial(good, risk) <= rejected), summed from the first term on.

    Terms are kept as logarithms, so none is lost to underflow for large counts.
    From the mean on the tail is over a third; then the sum is not needed.
    """
    step = math.log(risk) - math.log1p(-risk)
    first = good * math.log1p(-risk)
    total = F.aggregate(
        F.sequence(F.lit(1).cast("long"), rejected),
        F.struct(first.alias("term"), F.exp(first).alias("sum")),
        lambda s, i: let(
            s["term"] + F.log((good - i + 1) / i) + step,
            lambda term: F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum")),
        ),
        lambda s: s["sum"],
    )
    return (
        F.when(rejected >= good * risk, F.lit(1.0))
        .when(rejected == 0, F.exp(first))
        .otherwise(total)
    )


def _holdout(measures: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of labelled good documents that pass the base rules."""
    good = (
        labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("_good")).distinct()
    )
    return measures.filter(~base_failed(F.col("m"))).join(
        good, F.col("doc_id") == F.col("_good"), "left_semi"
    )


def thresholds(
    measures: DataFrame, labels: DataFrame, risk: float = RISK, failure: float = FAILURE
) -> DataFrame:
    """One row per stratum: the cutoff of each rule, null where none is safe.

    ``measures`` has doc_id, stratum and ``m`` of ``measured``. A label without id or
    quality says nothing; a document with several labels counts as good if one says so.
    """
    holdout = _holdout(measures, labels)
    m = F.col("m")
    counts = holdout.groupBy("stratum").agg(
        F.count("*").alias("good"),
        *[
            F.sum(_above(m, rule, cutoff).cast("long")).alias(f"{rule}_{cutoff}")
            for rule in RULES
            for cutoff in CUTOFFS
        ],
    )
    counts = pin(counts)  # one row per stratum
    tests = max(1, counts.count() * len(RULES))
    level = failure / tests

    def cutoff_of(rule):
        safe = [
            F.when(
                _log_tail(F.col(f"{rule}_{c}"), F.col("good"), risk / len(RULES)) <= level, F.lit(c)
            )
            for c in CUTOFFS
        ]
        return F.array_min(F.array(*safe)).alias(rule)

    return pin(counts.select("stratum", "good", *[cutoff_of(rule) for rule in RULES]))


def _any_above(m: Column, cutoff) -> Column:
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | _above(m, rule, cutoff)
    return rejected


def joint_thresholds(
    measures: DataFrame, labels: DataFrame, risk: float = RISK, failure: float = FAILURE
) -> DataFrame:
    """As ``thresholds``, with one cutoff for all rules of a stratum, tested on them together."""
    counts = pin(
        _holdout(measures, labels)
        .groupBy("stratum")
        .agg(
            F.count("*").alias("good"),
            *[F.sum(_any_above(F.col("m"), c).cast("long")).alias(f"any_{c}") for c in CUTOFFS],
        )
    )
    level = failure / max(1, counts.count())
    safe = [
        F.when(_log_tail(F.col(f"any_{c}"), F.col("good"), risk) <= level, F.lit(c))
        for c in CUTOFFS
    ]
    found = counts.select("stratum", "good", F.array_min(F.array(*safe)).alias("cutoff"))
    return pin(found.select("stratum", "good", *[F.col("cutoff").alias(rule) for rule in RULES]))


def judged(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Add ``base_failed`` and ``kept`` to rows with ``stratum`` and ``m``."""
    at = cutoffs.select(F.col("stratum").alias("_stratum"), *RULES)
    met = rows.join(at, F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
    m = F.col("m")
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | F.coalesce(_above(m, rule, F.col(rule)), F.lit(False))
    return met.withColumns(
        {"base_failed": base_failed(m), "kept": ~base_failed(m) & ~rejected}
    ).drop("_stratum", *RULES)


def verdicts(
    docs: DataFrame, labels: DataFrame, risk: float = RISK, failure: float = FAILURE
) -> DataFrame:
    """doc_id, the base counts, base_failed and kept, one row per row of ``docs``.

    Strata are the values of ``lang``; null is a stratum of its own. The texts are read
    once: their counts are written to the shared folder and used twice.
    """
    measures = pin(
        docs.select("doc_id", F.col("lang").alias("stratum"), measured(F.col("text")).alias("m"))
    )
    found = judged(measures, thresholds(measures, labels, risk, failure))
    return found.select("doc_id", "m.*", "base_failed", "kept")


def passing(
    docs: DataFrame, labels: DataFrame, risk: float = RISK, failure: float = FAILURE
) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are.

    Rows and their counts are written to the shared folder together: counting costs
    far more than reading the texts again. The cutoffs read only ids and counts.
    """
    rows = pin(
        docs.select(
            F.struct("*").alias("row"),
            F.col("lang").alias("stratum"),
            measured(F.col("text")).alias("m"),
        )
    )
    measures = rows.select(F.col("row.doc_id").alias("doc_id"), "stratum", "m")
    cutoffs = joint_thresholds(measures, labels, risk, failure)
    return judged(rows, cutoffs).filter("kept").select("row.*")
