"""Quality rules with verdicts per host.

Each document is measured by a few rules.  Failures are summed up per host, the host's failure
rates are shrunk towards the rate of all hosts by a beta prior whose strength is estimated from
the hosts themselves (method of moments), and the verdict of a host goes back to its documents:
a document stays if it passes the base rules and its host is not rejected.

Only DataFrame functions are used; one row's arrays never leave its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.staging import stage, stage_summary

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
HOST_LIMIT = 0.5
RULES = ("short", "repeats", "symbols", "lines", "word_length")


# A text with at most this many different repeated windows has them looked up one by one.
FEW = 64


def split_words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _neighbour_equal(s: Column, x: Column, k: Column) -> Column:
    return ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words`` to rows with ``_words``: words in a three-word window found twice or more.

    Windows are compared by 64-bit hashes within one text.  Sorting the hashes shows the repeated
    ones; they are then found in the text by look-up if few, else by sorting them with their places.
    Each step is a column of its own, since it is used several times by the next.
    """
    words, hashes, dups, places = F.col("_words"), F.col("_hashes"), F.col("_dups"), F.col("_places")
    other = df.columns
    hashed = df.select(
        *other,
        F.when(
            F.size(words) > 3,
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("_hashes"),
    )
    sorted_hashes = hashed.select("*", F.sort_array("_hashes").alias("_sorted"))
    found = sorted_hashes.select(
        *other,
        "_hashes",
        F.array_distinct(F.filter("_sorted", lambda x, k: (k > 0) & (F.get("_sorted", k - 1) == x))).alias("_dups"),
    )
    by_sort = found.select(
        *other,
        "_hashes",
        "_dups",
        F.when(
            F.size(dups) > FEW,
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_pairs"),
    )
    placed = by_sort.select(
        *other,
        F.when(F.size(dups) == 0, F.array().cast("array<int>"))
        .when(
            F.size(dups) <= FEW,
            F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.array_contains(dups, F.get(hashes, i))),
        )
        .otherwise(
            F.sort_array(
                F.transform(
                    F.filter("_pairs", lambda x, k: _neighbour_equal(F.col("_pairs"), x, k)), lambda x: x["i"]
                )
            )
        )
        .alias("_places"),
    )
    covered = F.aggregate(
        F.transform(places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3)))),
        F.lit(0),
        lambda a, b: a + b,
    )
    return placed.select(*other, covered.cast("long").alias("n_repeat_words"))


def measured(docs: DataFrame) -> DataFrame:
    """``(doc_id, host, counts)`` from ``(doc_id, host, text)``.  A null text counts as empty."""
    value = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(value, "\n"), lambda x: F.regexp_replace(x, SPACE, "") != "")
    parts = docs.select(
        "doc_id",
        "host",
        split_words(value).alias("_words"),
        lines.alias("_lines"),
        (F.char_length(value) - F.char_length(F.translate(value, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    counted = parts.select(
        "doc_id",
        "host",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
    )
    return with_repeats(counted).drop("_words")


def failures() -> dict[str, Column]:
    """One boolean per rule over the measured columns."""
    words = F.col("n_words")
    return {
        "short": words < MIN_WORDS,
        "repeats": 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * words,
        "symbols": 10 * F.col("n_symbols") > F.col("word_chars"),
        "lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * words) | (F.col("word_chars") > 20 * words),
    }


def beta_priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """Mean and strength (m, k) of the Beta(m*k, (1-m)*k) prior of every rule.

    m is the failure rate over all documents; k follows from the spread of the hosts' rates beyond
    binomial noise, held to [1, 10000].  Two passes over one row per host; a few numbers come back.
    """
    totals = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("n").alias("n"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"),
        *[F.sum(r).alias(r) for r in RULES],
    ).first()
    if not totals["n"]:
        return {r: (0.0, 1.0) for r in RULES}
    mean = {r: totals[r] / totals["n"] for r in RULES}
    spread = hosts.agg(
        *[F.sum(F.col("n") * F.pow(F.col(r) / F.col("n") - mean[r], 2)).alias(r) for r in RULES]
    ).first()
    priors = {}
    for r in RULES:
        noise = mean[r] * (1 - mean[r])
        scale = totals["n"] - totals["squares"] / totals["n"]
        between = (spread[r] - (totals["hosts"] - 1) * noise) / scale if scale > 0 else 0.0
        k = noise / between - 1 if between > 0 else 10000.0
        priors[r] = (mean[r], min(10000.0, max(1.0, k)))
    return priors


def shrunk_rates(hosts: DataFrame) -> DataFrame:
    """Posterior mean of every rule's failure rate; ``hosts`` has ``n`` and a count per rule."""
    priors = beta_priors(hosts)
    return hosts.select(
        "host",
        "n",
        *[
            ((F.col(r) + m * k) / (F.col("n") + k)).alias(f"rate_{r}") for r, (m, k) in priors.items()
        ],
    )


def host_verdicts(measured_docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """One row per host with shrunk rates and ``host_rejected``: a rule fails in more than ``limit``.

    ``measured_docs`` has ``host`` and the measured columns.  A null host is a host like any other.
    """
    tests = failures()
    hosts = measured_docs.groupBy("host").agg(
        F.count("*").alias("n"), *[F.count_if(tests[r]).alias(r) for r in RULES]
    )
    rates = shrunk_rates(stage(hosts, "hosts"))
    worst = F.greatest(*[F.col(f"rate_{r}") for r in RULES])
    return rates.withColumn("worst_rate", worst).withColumn("host_rejected", F.col("worst_rate") > limit)


def rule_verdicts(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", limit: float = HOST_LIMIT
) -> DataFrame:
    """Measures and verdict of every row of ``docs``, without its other columns.

    Null text: an empty text, which fails the base rules.  Repeated rows each get a row.  An empty
    table gives an empty table.  Other columns of ``docs`` are not read, so their names do not matter.

    The measures are written once: host rates and documents then see the same rows, and the text is
    read a single time.  One row per host comes back, broadcast only if its counted size is small.
    """
    named = docs.select(F.col(id_column).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    rows = stage(measured(named), "measures")
    tests = failures()
    hosts = stage_summary(host_verdicts(rows, limit).select(F.col("host").alias("_h"), "worst_rate", "host_rejected"), "verdicts")
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("_h")), "left")
    failed = tests["short"] | tests["repeats"]
    return joined.select(
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.col("worst_rate").alias("host_rate"),
        (~failed & ~F.col("host_rejected")).alias("kept"),
    )
