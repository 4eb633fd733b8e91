"""Quality rules with thresholds from quantile sketches; DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.session import materialize, table

SPACE, WINDOW, MIN_WORDS, REPEAT_PERCENT = r"[\x20\x09-\x0D]+", 8, 20, 30
BLANKS, SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"

#: share: what it is a share of; of repeated words, the windows that fit side by side
UNITS = {"symbol_ratio": ("word_chars", 1), "dup_line_ratio": ("n_lines", 1), "repeat_ratio": ("n_words", WINDOW), "stutter_ratio": ("n_words", 1)}
SKETCHED = (*UNITS, "mean_word_chars", "log_words")
TAIL, DEVIATIONS = 0.15, 3.0


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(starts: Column) -> Column:
    """Places under windows that begin at the sorted starts."""
    return F.aggregate(F.transform(starts, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)


def _repeated(windows: Column) -> Column:
    """Words under windows whose hash occurs again; windows: a hash for each place."""
    again = lambda s: F.filter(F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["v"] == x["v"]) | (F.get(s, i + 1)["v"] == x["v"]), x["i"])), lambda x: x.isNotNull())
    ordered = F.array_sort(F.transform(windows, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(_let(ordered, lambda s: _let(F.array_sort(again(s)), _covered)))


def repeat_words(words: Column) -> Column:
    """Number of words inside 8-word windows that a text has twice or more."""
    slide = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))
    return F.when(F.size(words) <= WINDOW, 0).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(slide(h), _repeated))).cast("long")


def metrics(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Counts of each text (null: empty) and whether it fails the fixed rules.

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_stutters (words equal to the one
    before) (long), base_failed.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    own = docs.select(F.col(key).alias("doc_id"), *[F.col(c).cast("string").alias(f"by_{i}") for i, c in enumerate(groups)], body.alias("body"))
    split = own.withColumn("words", F.filter(F.split("body", SPACE), lambda w: w != ""))
    lines = F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    same = lambda w: F.size(F.filter(w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))).cast("long")
    found = _let(F.col("words"), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words"), same(w).alias("n_stutters")))
    dup = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counted = split.select(
        "doc_id", *[f"by_{i}" for i in range(len(groups))], found.alias("w"), dup.alias("l"),
        F.length(F.translate("body", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    flat = counted.select("*", "w.*", "l.*").drop("w", "l")
    return flat.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def _ratios(rows: DataFrame) -> DataFrame:
    part = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.withColumns({"symbol_ratio": part("n_symbols", "word_chars"), "dup_line_ratio": part("n_dup_lines", "n_lines"), "repeat_ratio": part("n_repeat_words", "n_words"), "stutter_ratio": part("n_stutters", "n_words"), "mean_word_chars": part("word_chars", "n_words"), "log_words": F.log1p("n_words")})


def quantiles(rows: DataFrame, depth: int, tail: float = TAIL, k: int = 400) -> list[DataFrame]:
    """For the groups of by_0 .. by_(depth-1), then of one key less, down to one row for all: n and q, the quantiles at tail,
    1/2 and 1 - tail of each metric among rows that pass the fixed rules.

    The finest sketches are built once (partial aggregation, a few KB each whatever the rows); those of coarser groups are
    merges of them.
    """
    keys = [f"by_{i}" for i in range(depth)]
    fine = rows.filter("not base_failed").groupBy(*keys).agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m, F.lit(k)).alias(m) for m in SKETCHED])
    coarse = [fine.groupBy(*keys[:d]).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(m).alias(m) for m in SKETCHED]) for d in range(depth - 1, -1, -1)]
    q = lambda m: F.when(F.coalesce("n", F.lit(0)) > 0, F.array(*[F.kll_sketch_get_quantile_double(F.col(m), F.lit(r)) for r in (tail, 0.5, 1 - tail)]))
    return [s.select(*[c for c in s.columns if c.startswith("by_")], "n", F.struct(*[q(m).alias(m) for m in SKETCHED]).alias("q")) for s in (fine, *coarse)]


def fits(deviations: float = DEVIATIONS) -> Column:
    """Whether a row stays within the fences that q, the quantiles of its group, gives for a text of its size.

    A share may be what chance makes of the group's upper quantile p in n units: p + d sqrt(p (1 - p) / n) + d^2 / n for d
    deviations. The mean length of words may be d times as far beyond a tail quantile as that is from the median, and further
    by the square root of how much shorter the text is than the group's median. No other number is fixed.
    """
    inside = []
    for m, (unit, size) in UNITS.items():
        p, n = F.col(f"q.{m}")[2], F.greatest(F.col(unit) / size, F.lit(1.0))
        inside.append(F.col(m) <= p + deviations * F.sqrt(p * (1 - p) / n) + deviations**2 / n)
    low, middle, high = (F.col("q.mean_word_chars")[i] for i in range(3))
    wide = deviations * F.sqrt(F.greatest(F.lit(1.0), F.expm1(F.col("q.log_words")[1]) / F.greatest(F.col("n_words"), F.lit(1))))
    inside.append(F.col("mean_word_chars").between(low - wide * (middle - low), high + wide * (high - middle)))
    return reduce(Column.__and__, inside)


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", groups: tuple[str, ...] = ("lang", "source"), prior: int = 100, tail: float = TAIL, deviations: float = DEVIATIONS) -> DataFrame:
    """doc_id, counts, base_failed and kept for each row of docs.

    Quantiles of a group are weighed against those of the next coarser one (all groups share the coarsest): by the number of
    texts that passed the fixed rules there, which counts as much as the coarser group at `prior` texts; so no count is a step. Up to a share `tail` of junk in a group moves no fence. Null texts count as empty and
    fail; a null language or source is a group of its own; repeated rows return repeated rows; with no text left to learn from
    only the fixed rules speak; an empty table returns no rows; other columns are ignored.
    """
    rows = materialize(_ratios(metrics(docs, key, text, groups)))
    depth = len(groups)
    found = quantiles(rows, depth, tail)
    bound = found[0].select(*[f"by_{j}" for j in range(depth)])
    whole = found[-1].first()  # one row: the quantiles of all groups together
    bound = bound.withColumn("q", F.struct(*[F.lit(whole["q"][m] if whole else None).cast("array<double>").alias(m) for m in SKETCHED]))
    for d in range(1, depth + 1):  # from coarse to fine
        on = [F.col(f"by_{j}").alias(f"on_{j}") for j in range(d)]
        own = found[depth - d].filter("n > 0").select(*on, F.col("n").alias("own_n"), F.col("q").alias("own_q"))
        same = reduce(Column.__and__, [F.col(f"by_{j}").eqNullSafe(F.col(f"on_{j}")) for j in range(d)])
        weighed = lambda m: F.zip_with(f"own_q.{m}", f"q.{m}", lambda x, y: (F.col("own_n") * x + prior * y) / (F.col("own_n") + prior)).alias(m)
        q = F.when(F.col("own_n").isNull(), F.col("q")).otherwise(F.struct(*map(weighed, SKETCHED)))
        bound = bound.join(own, same, "left").withColumn("q", q).select(*[f"by_{j}" for j in range(depth)], "q")
    bound = bound.select(*[F.col(f"by_{j}").alias(f"to_{j}") for j in range(depth)], "q")
    judged = rows.join(bound, reduce(Column.__and__, [F.col(f"by_{j}").eqNullSafe(F.col(f"to_{j}")) for j in range(depth)]), "left")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *counts, "base_failed", (~F.col("base_failed") & F.coalesce(fits(deviations), F.lit(True))).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
