"""Quality rules for whole texts and for the hosts that they come from, with DataFrame functions only.

Each text is judged by rules of its own. A host is judged by the share of its texts that break any of
them, drawn towards the share of all hosts by a beta prior whose strength is estimated from how much the hosts differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free_name, let, written

WINDOW = 8
#: The base rules.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Further rules whose failures count against a host: percent of symbols to word characters, percent of repeated lines to lines.
MOST_SYMBOLS, MOST_LINES = 20, 60
#: A host goes if its shrunk failure rate is above so many times that of all texts, but for a bar of a quarter at least and of 0.6 at most: where
#: few texts fail a host that fails for every fourth is far off, and where many do the bar mustn't reach hosts of good texts or none.
TIMES_MEAN, BARS = 4.0, (0.25, 0.6)
#: Strength of the prior (in texts) at least and at most: no host goes for a text or two.
STRENGTH = (10.0, 1e6)
#: Rejected hosts up to this many are broadcast (a host name is some tens of bytes); more are joined by a shuffle.
BROADCAST_HOSTS = 50_000

_SPACE = " \t\n\x0b\x0c\r"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def _long(c: Column) -> Column:
    return c.cast("long")


def _repeat_words(words: Column) -> Column:
    """The number of words inside windows that occur twice or more.

    Hashes that all differ prove that no window repeats; only otherwise are windows with a repeated hash compared
    themselves, as neighbours in sorted order.
    """
    n = F.size(words) - WINDOW
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashed, lambda h: F.transform(F.sequence(F.lit(0), n), lambda i: F.xxhash64(*[h[i + k] for k in range(WINDOW)])))

    def neighbours(s: Column, field: str) -> Column:
        """Those of sorted structs whose field is also the one before's or after's."""
        return F.filter(s, lambda x, j: F.coalesce(x[field] == F.get(s, j - 1)[field], F.lit(False)) | F.coalesce(x[field] == F.get(s, j + 1)[field], F.lit(False)))

    def covered(h: Column) -> Column:
        places = let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda s: neighbours(s, "h"))
        strings = F.transform(places, lambda p: F.struct(F.concat_ws(" ", *[words[p["i"] + k] for k in range(WINDOW)]).alias("k"), p["i"].alias("i")))
        twice = let(F.sort_array(strings), lambda s: F.sort_array(F.transform(neighbours(s, "k"), lambda x: x["i"])))
        return let(twice, lambda t: F.aggregate(F.transform(t, lambda x, j: F.coalesce(F.least(F.get(t, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, b: a + b))

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
    return F.when(n < 0, 0).otherwise(counted)


def features(text: Column) -> Column:
    """The counts of FEATURES of a text, as a struct of longs; a null text has none of anything."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: F.length(F.translate(x, _SPACE, "")) > 0)
    counted = let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    return F.struct(
        _long(counted["n"]).alias("n_words"),
        _long(F.length(F.translate(whole, _SPACE, ""))).alias("word_chars"),
        _long(F.length(whole) - F.length(F.translate(whole, "#*$%&|<>", ""))).alias("n_symbols"),
        _long(by_line["d"]).alias("n_dup_lines"),
        _long(counted["r"]).alias("n_repeat_words"),
        _long(by_line["n"]).alias("n_lines"),
    )


def base_failed(f: Column) -> Column:
    return (f["n_words"] < LEAST_WORDS) | (100 * f["n_repeat_words"] > MOST_REPEATED * f["n_words"])


def rule_failed(f: Column) -> Column:
    """Whether any rule fails: the base ones, or those on symbols and lines."""
    return base_failed(f) | (100 * f["n_symbols"] > MOST_SYMBOLS * f["word_chars"]) | (100 * f["n_dup_lines"] > MOST_LINES * f["n_lines"])


def host_rates(judged: DataFrame, host: str, f: str) -> DataFrame:
    """Each host's texts, failures, raw rate, shrunk rate and bar (host, n_docs, n_failed, rate, shrunk, bar).

    The prior's mean is the share of failures among all texts. Its strength follows from the variance of the
    hosts' rates beyond what texts drawn at random would give, within STRENGTH. A null host is one like the others.
    """
    hosts = judged.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(rule_failed(F.col(f)).cast("long")).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    exact = lambda x: F.sum(x.cast("decimal(28,18)"))  # noqa: E731  (the same in any order of rows)
    p = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("failed"), F.count("*").alias("hosts"), exact(rate).alias("rates"), exact(rate * rate).alias("squares"), exact(1 / F.col("n_docs")).alias("inverse")).first()
    if not p["n"]:
        mean, strength = 0.0, STRENGTH[0]
    else:
        mean = p["failed"] / p["n"]
        spread = float(p["squares"]) / p["hosts"] - (float(p["rates"]) / p["hosts"]) ** 2
        beyond = spread - mean * (1 - mean) * float(p["inverse"]) / p["hosts"]
        strength = STRENGTH[1] if beyond <= 0 else min(max(mean * (1 - mean) / beyond - 1, STRENGTH[0]), STRENGTH[1])
    bar = min(max(TIMES_MEAN * mean, BARS[0]), BARS[1])
    return hosts.select("host", "n_docs", "n_failed", rate.alias("rate"), ((F.col("n_failed") + mean * strength) / (F.col("n_docs") + strength)).alias("shrunk"), F.lit(bar).alias("bar"))


def _with_hosts(judged: DataFrame, host: str, f: str, bad: str, host_rate: float | None) -> DataFrame:
    """judged with a column that says whether the row's host is rejected."""
    other = free_name(judged, "their_host")
    rejected = host_rates(judged, host, f).where(F.col("shrunk") > (F.col("bar") if host_rate is None else F.lit(host_rate))).select(F.col("host").alias(other), F.lit(True).alias(bad))
    few = rejected.limit(BROADCAST_HOSTS + 1).count()
    if few == 0:
        return judged.withColumn(bad, F.lit(False))
    if few <= BROADCAST_HOSTS:
        rejected = F.broadcast(rejected)
    # Beyond that Spark splits a host's rows by itself where they are many (the large side is preserved).
    joined = judged.join(rejected, F.col(host).eqNullSafe(F.col(other)), "left")
    return joined.withColumn(bad, F.coalesce(bad, F.lit(False))).drop(other)


def judge(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", host_rate: float | None = None) -> DataFrame:
    """The counts and verdicts of every document.

    One row for each: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
    host_rejected and kept (neither). A host goes if its shrunk rate is above host_rate, or else above the bar that host_rates gives. Null texts are empty; null ids stay null, null hosts are one host; repeated rows
    give a row each; other columns are not read. The counts are computed once and checkpointed, as both the hosts and the rows need them.
    """
    counted = checkpointed(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), features(F.col(text)).alias("f")))
    out = _with_hosts(counted, "host", "f", "host_rejected", host_rate)
    failed = base_failed(F.col("f"))
    return out.select("doc_id", *[F.col("f")[c].alias(c) for c in FEATURES], failed.alias("base_failed"), "host_rejected", (~failed & ~F.col("host_rejected")).alias("kept"))


def keep(docs: DataFrame, *, text: str = "text", host: str = "source", host_rate: float | None = None) -> DataFrame:
    """The documents that judge() keeps, with all their columns (whatever their names)."""
    f, bad = free_name(docs, "f"), free_name(docs, "bad")
    counted = written(docs.withColumn(f, features(F.col(text))))
    out = _with_hosts(counted, host, f, bad, host_rate)
    return out.where(~base_failed(F.col(f)) & ~F.col(bad)).select(*docs.columns)
