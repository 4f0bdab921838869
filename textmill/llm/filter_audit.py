"""How five document filters interact: what each removes, in every order of applying them.

Each document fails some of the filters A to E.  A to D look at one text; E is an existential
self-join: a document fails it if a left-semi join on hash, exact text and a smaller id finds a
partner.  The ids that fail E are put together with those that fail the others (a union, whose bits
are joined per document), and only counts per part and combination of failures go on: what a filter
removes, in whatever order, follows from those at most 32 counts a part.

Null texts are empty, null parts the empty string.  A null id is neither smaller nor larger than any
other, so it neither fails E nor makes others fail it.  Rows that repeat an id and a text are counted
as often as they occur and do not fail E by each other.  An empty table has no parts, hence no rows.
Further columns are ignored, whatever their names.  A very long text is one row of one task.

Only DataFrame functions are used.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.quality_rules import SPACE
from textmill.staging import stage, stage_summary

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
SYMBOLS = "[#$%&*|]"

# Copies of a text that meet one copy of its first document in the semi-join.
SLICE_ROWS = 1024
# First level of the search for the smallest id of a text.
SALTS = 256

_E = 1 << FILTERS.index("E")
_KEY = ["_k1", "_k2"]


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(FILTERS), text).alias("_k2")]


def failures(docs: DataFrame) -> DataFrame:
    """``(id, part, _k1, _k2, bits)`` from ``(id, part, text)``: bits 0 to 3 for filters A to D."""
    split = docs.select("id", "part", "text", F.split("text", SPACE).alias("_split"), *_keys(F.col("text")))
    parts = F.col("_split")
    # Only the first and the last part may be empty.
    first, last = (F.get(parts, F.lit(0)) == ""), (F.size(parts) > 1) & (F.get(parts, F.size(parts) - 1) == "")
    chars = F.char_length("text")
    counted = split.select(
        "id",
        "part",
        *_KEY,
        (F.size(parts) - first.cast("int") - last.cast("int")).cast("long").alias("_words"),
        (F.size(F.array_distinct(parts)) - (first | last).cast("int")).cast("long").alias("_distinct"),
        (chars - F.char_length(F.regexp_replace("text", "[A-Z]+", ""))).cast("long").alias("_upper"),
        chars.cast("long").alias("_chars"),
        F.col("text").rlike(SYMBOLS).alias("_symbol"),
    )
    tests = [
        F.col("_words") < MIN_WORDS,
        100 * F.col("_distinct") < MIN_DISTINCT_PERCENT * F.col("_words"),
        100 * F.col("_upper") > MAX_UPPER_PERCENT * F.col("_chars"),
        F.col("_symbol"),
    ]
    bits = sum((t.cast("int") * (1 << i) for i, t in enumerate(tests)), F.lit(0))
    return counted.select("id", "part", *_KEY, bits.alias("bits"))


def later_copies(docs: DataFrame, measured: DataFrame) -> DataFrame:
    """``(id, part, _k1, _k2)`` of the rows whose text another row with a smaller id has, too.

    Only rows whose hash occurs under two ids take part, so few texts move.  The smallest id of a
    text is found on two levels, so that a text of a third of all rows sends one row a task; the
    copies are dealt to slices of bounded size, each of which gets the first document once.
    """
    several = stage_summary(
        measured.where("id is not null")
        .groupBy(*_KEY)
        .agg(F.count("*").alias("_rows"), F.min("id").alias("_low"), F.max("id").alias("_high"))
        .where("_low < _high")
        .select(*_KEY, F.ceil(F.col("_rows") / SLICE_ROWS).cast("long").alias("_slices")),
        "copies",
    )
    rows = docs.where("id is not null").select("id", "part", "text", *_keys(F.col("text"))).join(several, _KEY)
    text = [*_KEY, "_slices", "text"]
    firsts = (
        rows.select(*text, "id", (F.spark_partition_id() % SALTS).alias("_salt"))
        .groupBy(*text, "_salt")
        .agg(F.min("id").alias("_least"))
        .groupBy(*text)
        .agg(F.min("_least").alias("_least"))
        .select(*text, "_least", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slices") - 1)).alias("_slice"))
    )
    a = rows.withColumn("_slice", F.pmod(F.xxhash64("id"), F.col("_slices"))).alias("a")
    b = firsts.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*_KEY, "_slice", "text")]
    return a.join(b, [*same, F.col("b._least") < F.col("a.id")], "left_semi").select("id", "part", *_KEY)


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, bits, n, good, toxic)``: documents by part and combination of failures.

    ``docs`` has ``(doc_id, text, source)``, ``labels`` ``(doc_id, quality, toxic)``; a document
    with several labels counts if any of them is 1.
    """
    plain = docs.select(
        F.col("doc_id").alias("id"),
        F.coalesce("source", F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    measured = stage(failures(plain), "failures")
    copies = later_copies(plain, measured)
    failed = measured.withColumn("n", F.lit(1)).unionByName(
        copies.select("*", F.lit(_E).alias("bits"), F.lit(0).alias("n"))
    )
    rows = (
        failed.groupBy("id", "part", *_KEY)
        .agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n"))
        .groupBy("id", "part", "bits")
        .agg(F.sum("n").alias("n"))
    )
    known = (
        labels.where("doc_id is not null")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(
            F.max(F.coalesce((F.col("quality") == 1), F.lit(False)).cast("int")).alias("_good"),
            F.max(F.coalesce((F.col("toxic") == 1), F.lit(False)).cast("int")).alias("_toxic"),
        )
    )

    def marked(mark: str) -> Column:
        return F.sum(F.col("n") * F.coalesce(F.col(mark), F.lit(0))).cast("long")

    return (
        rows.join(known, "id", "left")
        .groupBy("part", "bits")
        .agg(F.sum("n").cast("long").alias("n"), marked("_good").alias("good"), marked("_toxic").alias("toxic"))
    )


def _left_after(cells: Column, count: str) -> Column:
    """For each set of filters (a mask): documents that fail none of them."""
    masks = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    return F.transform(
        masks,
        lambda m: F.aggregate(
            F.filter(cells, lambda c: c["bits"].bitwiseAND(m) == 0), F.lit(0).cast("long"), lambda a, c: a + c[count]
        ),
    )


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order and step, from the counts of failures.

    A filter's ``shapley`` is its removals summed over all orders: a set of filters comes before it in
    ``|set|! * (others - |set|)!`` of them.
    """
    n = len(FILTERS)
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("bits", "n", "good", "toxic")).alias("_cells"))
    held = cells.select(
        "part", "_cells", *[_left_after(F.col("_cells"), c).alias(f"_{c}") for c in ("n", "good", "toxic")]
    )
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = held.select("*", F.explode(orders).alias("filter_order")).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step")
    )
    letters = F.split("filter_order", "")

    def bit(letter: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord("A"))

    placed = steps.select(
        "*",
        F.get(letters, F.col("step") - 1).alias("filter"),
        bit(F.get(letters, F.col("step") - 1)).alias("_bit"),
        F.aggregate(
            F.transform(F.slice(letters, F.lit(1), F.col("step") - 1), bit), F.lit(0), lambda a, b: a + b
        ).alias("_before"),
    )
    before, own = F.col("_before"), F.col("_bit")

    def lost(count: str) -> Column:
        held = F.col(f"_{count}")
        return F.get(held, before) - F.get(held, before + own)

    factorial = [1, 1, 2, 6, 24]
    weights = F.array(*[F.lit(factorial[k] * factorial[n - 1 - k]).cast("long") for k in range(n)])
    left = F.col("_n")
    shapley = F.aggregate(
        F.filter(F.sequence(F.lit(0), F.lit((1 << n) - 1)), lambda m: m.bitwiseAND(own) == 0),
        F.lit(0).cast("long"),
        lambda a, m: a + F.get(weights, F.bit_count(m)) * (F.get(left, m) - F.get(left, m + own)),
    )
    alone = F.aggregate(
        F.filter("_cells", lambda c: c["bits"] == own), F.lit(0).cast("long"), lambda a, c: a + c["n"]
    )
    return placed.select(
        "part",
        "filter_order",
        "step",
        "filter",
        F.get(left, before + own).alias("kept"),
        lost("n").alias("removed"),
        (F.get(left, F.lit(0)) - F.get(left, own) - lost("n")).alias("redundant"),
        alone.alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts for every part, order of the filters and step; see :func:`interactions`."""
    return interactions(failure_counts(docs, labels))
