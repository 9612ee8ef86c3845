"""Quality rules whose cutoffs keep false rejection under a stated risk, chosen on labelled documents.

Signals are counts over whole texts. Each rule is a ratio of them that is high in bad documents. For every
stratum and rule, cutoffs on a fixed grid are tested from the most lenient one on: with n good labelled
documents of which k lie above the cutoff, the cutoff holds if P(Binomial(n, share) <= k) <= level, the
exact binomial test of "more than `share` of the good documents are rejected". The level is `risk` divided by
the number of (stratum, rule) families (Bonferroni); within a family the cutoffs are a fixed sequence, as k only
grows. The strictest cutoff that holds is taken; without one, the rule does not act in that stratum.
So, with probability 1 - risk, the rules together reject at most `false_rejection` of the good documents of any stratum.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchgrain.functions.storage import cut_lineage
from matchgrain.llm.textcore import column_words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Rule: value from the signals, and the step of its grid of cutoffs (step, 2 * step, ... GRID * step).
GRID = 50
RULES = {
    "symbols": ("n_symbols / word_chars", 0.02),
    "dup_lines": ("n_dup_lines / n_lines", 0.02),
    "repeats": ("n_repeat_words / n_words", 0.02),
    "long_words": ("word_chars / n_words", 0.5),
}
FALSE_REJECTION, RISK = 0.05, 0.05
#: Cutoffs of so many strata at most are broadcast.
SMALL = 10_000


def with_signals(docs: DataFrame, into: str = "_signals") -> DataFrame:
    """`docs` with a struct column `into`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long).

    Words are runs of characters other than space and \\t to \\r; a null text has none. n_lines counts lines
    with a word; n_dup_lines those of them that equal an earlier one; n_repeat_words the words inside
    windows of 8 words that start at two or more places of the text. All in one row, without a shuffle.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    w, h, runs, order, starts = (f"{into}_{x}" for x in ("words", "hashes", "runs", "order", "starts"))
    d = docs.withColumn(w, column_words(F.col("text").cast("string")))
    d = d.withColumn(h, F.transform(w, lambda x: F.xxhash64(x)))
    window = F.when(
        F.size(h) > WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.col(h)[i + k] for k in range(WINDOW)])),
    )
    d = d.withColumn(runs, window)
    # Documents with a repeated window: all windows sorted by hash, then the start of each that has an equal neighbour.
    repeated = F.size(F.array_distinct(runs)) < F.size(runs)
    d = d.withColumn(order, F.when(repeated, F.array_sort(F.transform(runs, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twin = lambda x, k: (F.coalesce(F.get(F.col(order), k - 1)["h"] == x["h"], F.lit(False))) | (F.coalesce(F.get(F.col(order), k + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn(starts, F.array_sort(F.transform(F.filter(order, twin), lambda x: x["i"])))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda acc, s: F.struct(s.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), s - acc["last"])).alias("n")),
    )["n"]
    lines = f"{into}_lines"
    d = d.withColumn(lines, F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0))
    values = [
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
    ]
    return d.withColumn(into, F.struct(*values)).drop(w, h, runs, order, starts, lines)


def base_failed(signals: Column) -> Column:
    return (signals["n_words"] < 20) | (100 * signals["n_repeat_words"] > 30 * signals["n_words"])


def _rule(signals: str, name: str) -> Column:
    above, below = RULES[name][0].split(" / ")
    return F.coalesce(F.col(f"{signals}.{above}") / F.nullif(F.col(f"{signals}.{below}"), F.lit(0)), F.lit(0.0))


def _log_factorial(n: Column) -> Column:
    x = n.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, share: float) -> Column:
    """P(Binomial(n, share) <= k) for k < n * share; 1 for larger k, where it exceeds 1/4.

    The largest term comes from log factorials, the others from the ratio of neighbours, down to where they
    are under exp(-700) of it.
    """
    lead = F.exp(_log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(share) + (n - k) * math.log1p(-share))
    far = F.least(k, F.ceil(40 * F.sqrt(n * share)) + 100)
    total = F.aggregate(
        F.when(far > 0, F.sequence(F.lit(1).cast("long"), far.cast("long"))).otherwise(F.array().cast("array<bigint>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, t: F.struct(
            (acc["term"] * (k - t + 1) * (1 - share) / ((n - k + t) * share)).alias("term"),
            (acc["sum"] + acc["term"] * (k - t + 1) * (1 - share) / ((n - k + t) * share)).alias("sum"),
        ),
    )["sum"]
    return F.when(k < n * share, lead * total).otherwise(F.lit(1.0))


def fit_cutoffs(
    signed: DataFrame, labels: DataFrame, stratum: str = "lang", signals: str = "_signals", false_rejection: float = FALSE_REJECTION, risk: float = RISK
) -> DataFrame:
    """(stratum, n_good, one cutoff column per rule; null: the rule does not act) from all labelled rows of `signed`.

    `signed` has doc_id, the stratum and the signals; `labels` has doc_id and quality (1: good; if a doc_id
    has several labels, one good is enough; nulls are no label). A null stratum is the stratum ''.
    Documents that fail the base rule take no part: the rules act on what it has passed. Without labels the result is empty.
    """
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("_id")).distinct()
    held = signed.where(~base_failed(F.col(signals))).select(
        F.col("doc_id").alias("_id"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum"),
        *[_rule(signals, r).alias(r) for r in RULES],
    ).join(good, "_id", "left_semi")
    # A value above j cutoffs counts for each of them: cutoffs j * step with value > j * step.
    passed = [
        F.struct(F.lit(r).alias("rule"), sum((F.col(r) > j * step).cast("int") for j in range(1, GRID + 1)).alias("above")) for r, (_, step) in RULES.items()
    ]
    tally = held.select("stratum", F.explode(F.array(*passed)).alias("x")).groupBy("stratum", "x.rule", "x.above").agg(F.count("*").alias("n"))
    per = tally.groupBy("stratum", "rule").agg(
        F.sum("n").alias("n_good"), *[F.sum(F.when(F.col("above") >= j, F.col("n")).otherwise(0)).alias(f"k{j}") for j in range(1, GRID + 1)]
    )
    per = cut_lineage(per)
    share, level = false_rejection / len(RULES), risk / max(1, per.count())
    tested = per.select("stratum", "rule", "n_good", F.posexplode(F.array(*[F.col(f"k{j}") for j in range(1, GRID + 1)])).alias("j", "k"))
    chosen = tested.where(binomial_tail(F.col("k"), F.col("n_good"), share) <= level).groupBy("stratum", "rule").agg((F.min("j") + 1).alias("j"))
    sizes = per.groupBy("stratum").agg(F.max("n_good").alias("n_good"))
    wide = chosen.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("j") * F.lit(RULES[r][1]))).alias(f"cutoff_{r}") for r in RULES])
    return sizes.join(wide, "stratum", "left")


def judge(signed: DataFrame, cutoffs: DataFrame, stratum: str = "lang", signals: str = "_signals", into: str = "_kept") -> DataFrame:
    """`signed` with boolean `into`: false if the base rule fails or a signal is above the cutoff of its stratum.

    A stratum without cutoffs rejects nothing beyond the base rule. The cutoffs (one row per stratum) are
    broadcast if there are at most SMALL of them, else joined.
    """
    cutoffs = cut_lineage(cutoffs).select(F.col("stratum").alias(f"{into}_s"), *[F.col(f"cutoff_{r}").alias(f"{into}_{r}") for r in RULES])
    if cutoffs.limit(SMALL + 1).count() <= SMALL:
        cutoffs = F.broadcast(cutoffs)
    joined = signed.join(cutoffs, F.coalesce(F.col(stratum).cast("string"), F.lit("")) == F.col(f"{into}_s"), "left")
    over = [F.coalesce(_rule(signals, r) > F.col(f"{into}_{r}"), F.lit(False)) for r in RULES]
    rejected = over[0] | over[1] | over[2] | over[3]
    return joined.withColumn(into, ~base_failed(F.col(signals)) & ~rejected).drop(f"{into}_s", *[f"{into}_{r}" for r in RULES])


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The rows of `docs`, with all their columns, that pass the base rule and the fitted cutoffs.

    Signals of all rows are written once without the texts; the rejected rows, as (doc_id, stratum, hash of the text), are
    then taken out by an anti join. Structs compare null fields as equal, so rows without a doc_id are judged as well.
    """
    row = F.struct(F.col("doc_id").alias("id"), F.col(stratum).alias("stratum"), F.xxhash64("text").alias("text"))
    signed = cut_lineage(with_signals(docs.select("doc_id", stratum, "text", row.alias("_row"))).drop("text"))
    rejected = judge(signed, fit_cutoffs(signed, labels, stratum), stratum).where("not _kept").select("_row").distinct()
    return docs.withColumn("_row", row).join(rejected, "_row", "left_anti").select(*docs.columns)
