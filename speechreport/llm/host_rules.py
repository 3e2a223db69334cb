"""Quality rules at the level of hosts, in DataFrame functions only.

Each document is measured by four rules. Failures are summed by host, the failure rate of a host is
shrunk toward the corpus by a beta prior that is fitted to all hosts, and the host's verdict scales
the limits that its documents meet: a document from a host that fails twice as often as the corpus
meets half the limits, one from a clean host twice the limits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechreport.llm.common import materialize, words

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
#: Per cent of words in repeated windows, of symbols among characters of words, of lines that repeat.
REPEAT_LIMIT, SYMBOL_LIMIT, LINE_LIMIT = 30, 10, 30
#: Lines without repeats that are added to each text's, so that one repeat among few lines tells little.
LINE_PRIOR = 6
#: How far a host's verdict moves a limit, and the prior's least weight in documents.
STRICT, LENIENT, LEAST_PRIOR = 0.5, 2.0, 2.0


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and _n_lines; null counts as ''.

    n_repeat_words counts the words inside 8-word windows that occur twice or more in the text, first
    ones included. Windows are compared by 64-bit hash. A hash set tells whether any repeat; only then
    are hashes and places sorted, so that a text without repeats costs one pass.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    hashed = df.withColumn("_words", words(F.col(text)))
    hashed = hashed.withColumns({
        "_h": F.transform("_words", lambda w: F.xxhash64(w)),
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
        "_n_lines": F.size(lines),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }).drop("_words")
    at = F.when(F.size("_h") >= WINDOW, F.sequence(F.lit(0), F.size("_h") - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashed = hashed.withColumn("_at", at)
    window = F.transform("_at", lambda i: F.xxhash64(*[F.get("_h", i + k) for k in range(WINDOW)]))
    hashed = hashed.withColumn("_win", window).drop("_h")
    hashed = hashed.withColumn("_some", F.size(F.array_distinct("_win")) < F.size("_win"))
    # places whose window repeats, ascending: neighbours in the order of (hash, place) with equal hashes
    pairs = F.sort_array(F.arrays_zip(F.col("_win").alias("h"), F.col("_at").alias("i")))
    hashed = hashed.withColumn("_pairs", F.when(F.col("_some"), pairs)).drop("_win", "_at")
    twice = F.filter("_pairs", lambda p, i: (F.get("_pairs", i - 1)["h"] == p["h"]) | (F.get("_pairs", i + 1)["h"] == p["h"]))
    hashed = hashed.withColumn("_twice", F.sort_array(F.transform(twice, lambda p: p["i"]))).drop("_pairs")
    gaps = F.transform("_twice", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_twice", i + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, x: a + x), F.lit(0))
    return hashed.withColumn("n_repeat_words", covered.cast("long")).drop("_twice", "_some")


def host_verdicts(measured: DataFrame) -> DataFrame:
    """One row for each host: _key, n documents, k failures, shrunk rate and scale of its limits.

    The beta prior comes from the mean and the variance of the hosts' rates (method of moments,
    weighted by documents); with no spread between hosts it weighs a million documents.
    """
    rates = measured.groupBy("_key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_fails").cast("long")).alias("k"))
    rates = materialize(rates)
    square = F.col("k") * F.col("k") / F.col("n").cast("double")
    docs, failed, squares = rates.agg(F.sum("n"), F.sum("k"), F.sum(square)).first()  # three numbers
    mean = failed / docs if docs else 0.0
    spread = max(squares / docs - mean * mean, 1e-9) if docs else 1e-9
    weight = min(max(mean * (1 - mean) / spread - 1, LEAST_PRIOR), 1e6)
    rate = (F.col("k") + F.lit(weight * mean)) / (F.col("n") + F.lit(weight))
    scale = F.least(F.greatest(F.lit(mean) / F.greatest(rate, F.lit(1e-9)), F.lit(STRICT)), F.lit(LENIENT))
    return rates.select("_key", F.col("n").alias("host_docs"), F.col("k").alias("host_fails"), rate.alias("host_rate"), F.when(F.col("k") == 0, F.lit(LENIENT)).otherwise(scale).alias("host_scale"))


def apply_rules(df: DataFrame, text: str = "text", host: str = "source", out_keep: list[str] | None = None) -> DataFrame:
    """df's columns (or ``out_keep``) with the measures, base_failed, host_rate, host_scale and kept.

    Null and empty texts have no words and fail the base rule; a null host is a host of its own.
    Very long texts are measured whole, repeated rows are judged each, limits are met by equal values. An empty table gives an empty table. Columns that start with an
    underscore and the names above are the operator's own and replace equal ones of df.
    """
    keep = df.columns if out_keep is None else out_keep
    ours = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate", "host_scale", "host_docs", "host_fails"}
    keep = [c for c in keep if c not in ours and not c.startswith("_")]
    key = F.struct(F.col(host).isNull().alias("none"), F.coalesce(F.col(host), F.lit("")).alias("name"))
    base = df.select(*dict.fromkeys([*keep, text, host])).withColumn("_key", key)
    found = measure(base, text)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_LIMIT * F.col("n_words"))
    found = found.withColumn("base_failed", base_failed)
    found = found.withColumn("_symbols", 100.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)))
    found = found.withColumn("_lines", 100.0 * F.col("n_dup_lines") / (F.col("_n_lines") + LINE_PRIOR))
    found = found.withColumn("_fails", F.col("base_failed") | (F.col("_symbols") > SYMBOL_LIMIT) | (F.col("_lines") > LINE_LIMIT))
    found = materialize(found.select(*keep, *[c for c in found.columns if c not in {*keep, text, host}]))
    verdicts = materialize(host_verdicts(found))
    found = found.join(verdicts, "_key", "left")
    soft = (F.col("_symbols") > F.lit(SYMBOL_LIMIT) * F.col("host_scale")) | (F.col("_lines") > F.lit(LINE_LIMIT) * F.col("host_scale"))
    kept = ~F.col("base_failed") & ~soft
    return found.withColumn("kept", kept).drop("_key", "_symbols", "_lines", "_fails", "_n_lines", "host_docs", "host_fails")
