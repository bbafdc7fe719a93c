"""Grouped summaries of scored rows: one pass and one shuffle of partial sums for any number of levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The score columns of a result, but for the primary one.
METRICS = ["lexical", "grounding", "plausibility", "contract", "faithfulness", "composite"]


def _means(metrics: list[str]) -> list[Column]:
    ok = F.col("error").isNull()
    scored = F.greatest(F.lit(1), F.sum(ok.cast("int")))
    out = [
        F.count("*").alias("n"),
        F.sum((~ok).cast("int")).alias("errors"),
        F.sum((ok & F.coalesce("passed", F.lit(False))).cast("int")).alias("n_passed"),
        F.bround(F.sum(F.when(ok, F.coalesce("score", F.lit(0.0))).otherwise(0.0)) / scored, 4).alias("mean_score"),
        F.bround(F.sum((ok & F.coalesce("passed", F.lit(False))).cast("int")) / scored, 4).alias("pass_rate"),
    ]
    return out + [F.bround(F.avg(F.when(ok, F.col(m))), 4).alias(f"mean_{m}") for m in metrics]


def by_model(results: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """A row for each model. Rows with an error count as such and nowhere else; a missing primary score counts as 0, other missing scores don't count."""
    return results.groupBy("model").agg(*_means(metrics or METRICS))


def by_levels(results: DataFrame, levels: list[str], metrics: list[str] | None = None) -> DataFrame:
    """Rows for (model) and for (model, level) of each further column, by grouping sets; null levels are unknown.

    Column level tells which it is, member its value.
    """
    from functools import reduce

    clean = results
    for c in levels:
        clean = clean.withColumn(c, F.coalesce(F.nullif(F.lower(F.trim(F.col(c))), F.lit("")), F.lit("unknown")))
    sets = [[F.col("model")], *[[F.col("model"), F.col(c)] for c in levels]]
    out = clean.groupingSets(sets, "model", *levels).agg(*_means(metrics or METRICS), *[F.grouping(c).alias(f"__g_{c}") for c in levels])
    level = reduce(lambda a, c: F.when(F.col(f"__g_{c}") == 0, F.lit(c)).otherwise(a), levels, F.lit("model"))
    member = reduce(lambda a, c: F.when(F.col(f"__g_{c}") == 0, F.col(c)).otherwise(a), levels, F.lit(None).cast("string"))
    return out.withColumn("level", level).withColumn("member", member).drop(*levels, *[f"__g_{c}" for c in levels])


def threshold_sweep(results: DataFrame, thresholds: list[float], value: str = "pass_value") -> DataFrame:
    """(model, threshold, n, n_passed, pass_rate) for each threshold, from one scan: passes are counted per threshold in the same aggregate."""
    ok = F.col("error").isNull()
    counted = results.groupBy("model").agg(F.count("*").alias("n"), F.sum(ok.cast("int")).alias("scored"), *[F.sum((ok & F.coalesce(F.col(value) >= t, F.lit(False))).cast("int")).alias(f"p{i}") for i, t in enumerate(thresholds)])
    pairs = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"p{i}").alias("n_passed")) for i, t in enumerate(thresholds)]))
    return counted.select("model", "n", "scored", pairs.alias("x")).select("model", "x.threshold", "n", "x.n_passed", F.bround(F.col("x.n_passed") / F.greatest(F.lit(1), F.col("scored")), 4).alias("pass_rate"))


def parsed_thresholds(text: str) -> list[float]:
    """Numbers in [0, 1] from a text with commas or spaces between them, each once, in order."""
    found = set()
    for part in text.replace(",", " ").split():
        try:
            found.add(float(part))
        except ValueError:
            continue
    return sorted(x for x in found if 0 <= x <= 1)


def variant_deltas(summary: DataFrame, suffix: str, means: list[str]) -> DataFrame:
    """For each model that has a variant with the suffix: its means less the variant's; null if either is null."""
    plain = summary.where(~F.col("model").endswith(suffix))
    other = summary.where(F.col("model").endswith(suffix)).select(F.expr(f"left(model, length(model) - {len(suffix)})").alias("model"), *[F.col(m).alias(f"__{m}") for m in means])
    return plain.join(other, "model").select("model", *[F.bround(F.col(m) - F.col(f"__{m}"), 4).alias(f"delta_{m}") for m in means])


def pair_means(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean of a value by group, with counts of rows and of those in error."""
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(F.col("error").isNotNull().cast("int")).alias("errors"), F.bround(F.avg(F.when(F.col("error").isNull(), F.col(value))), 4).alias(f"mean_{value}"))


def health(rows: DataFrame) -> DataFrame:
    """One row: counts of each status, the upper median and greatest drift, and a verdict.

    rows: status (good, borderline, degenerate, missing) and drift_km. The upper median is the element at
    floor(n / 2) in order: the discrete median of the reversed order.
    """
    is_ = lambda s: F.sum((F.col("status") == s).cast("int"))
    ranked = rows.where(F.col("drift_km").isNotNull())
    counts = rows.agg(F.count("*").alias("n"), *[is_(s).alias(f"n_{s}") for s in ("good", "borderline", "degenerate", "missing")], F.max("drift_km").alias("max_drift_km"))
    median = ranked.agg(F.expr("percentile_disc(0.5) within group (order by drift_km desc)").alias("high"))
    share_bad = (F.col("n_degenerate") + F.col("n_missing")) / F.greatest(F.lit(1), F.col("n"))
    verdict = F.when(F.col("n") == 0, "empty").when(share_bad > 0.5, "degenerate").when(F.col("n_good") / F.col("n") >= 0.8, "healthy").otherwise("mixed")
    return counts.crossJoin(F.broadcast(median)).select("n", "n_good", "n_borderline", "n_degenerate", "n_missing", F.bround(share_bad * 100, 3).alias("bad_pct"), F.col("high").alias("median_drift_km"), "max_drift_km", verdict.alias("verdict"))


def flag_counts(rows: DataFrame, flags: str) -> DataFrame:
    """(flag, n) over an array column."""
    return rows.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def change_counts(rows: DataFrame, changes: str) -> DataFrame:
    """(change, n): a map column of counters summed over rows."""
    return rows.select(F.explode(changes).alias("change", "v")).groupBy("change").agg(F.sum("v").alias("n"))


def build_stats(rows: DataFrame) -> DataFrame:
    """(task, emitted, dropped, mean_chars, boxes) of built rows (task, drop_reason, prompt_chars, n_boxes)."""
    kept = F.col("drop_reason").isNull()
    return rows.groupBy("task").agg(F.sum(kept.cast("int")).alias("emitted"), F.sum((~kept).cast("int")).alias("dropped"), F.bround(F.avg(F.when(kept, F.col("prompt_chars"))), 2).alias("mean_chars"), F.sum(F.when(kept, F.col("n_boxes"))).alias("boxes"))


def split_leaks(rows: DataFrame, base: Column, split: str = "split") -> DataFrame:
    """Bases that stand in more than one split, with the number of splits."""
    return rows.select(base.alias("base"), split).distinct().groupBy("base").agg(F.count(split).alias("n_splits")).where("n_splits > 1")


def missing_roots(paths: DataFrame, path: str, depth: int = 2, most: int = 12) -> DataFrame:
    """The roots (leading folders) with the most paths, ties by name."""
    return paths.groupBy(F.substring_index(F.col(path), "/", depth).alias("root")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "root").limit(most)


def crowded_folders(files: DataFrame, path: str, most: int) -> DataFrame:
    """Folders of more than so many files."""
    return files.groupBy(F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("n")).where(F.col("n") > most)


def markdown_table(summary: DataFrame, columns: list[str]) -> DataFrame:
    """A line of a Markdown table for each row of a small summary, a dash for null."""
    return summary.select(F.concat(F.lit("| "), F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("–")) for c in columns]), " | "), F.lit(" |")).alias("line"))
