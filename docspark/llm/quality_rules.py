"""Quality rules at host level, in DataFrame functions only.

Each document is measured; failures are counted by host; a host's failure rate is shrunk towards a beta prior that is
fitted to all hosts by the method of moments; hosts above ``most`` are rejected and their verdict is joined back.

Defined cases: a null or empty text has no words and fails the base rule; a text of any length is measured whole, within its row; null
and empty sources are one host; hosts of equal rates get equal verdicts, and a rate at the limit is kept; repeated rows are measured
one by one; an empty table gives no rows; input columns named like a measure are replaced by it, any other name may occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, materialise

#: Fixed values of the base rules.
MIN_WORDS, MAX_REPEAT_PERCENT, SYMBOLS = 50, 50, "#*$%&|<>"
#: A host is rejected if its shrunk failure rate exceeds this.
MOST_HOST_RATE = 0.5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def host_of(source: Column) -> Column:
    """The host of a URL in lower case, or the source itself; null and empty are one host."""
    host = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.when(host != "", F.lower(host)).otherwise(source), F.lit(""))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the five measures and ``base_failed``. No shuffle: repeats are found by sorting within the row."""
    body = F.coalesce(F.col(text), F.lit(""))
    bare = F.regexp_replace(body, WORD_GAP, "")
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.regexp_replace(x, WORD_GAP, "") != "")
    out = docs.drop(*MEASURES, "base_failed", "_words", "_lines", "_windows", "_at").withColumns(
        {"_words": F.filter(F.split(body, WORD_GAP, -1), lambda w: w != ""), "_lines": lines, "word_chars": F.length(bare).cast("long"),
         "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long")}
    )
    window = F.transform("_words", lambda w, i: F.struct(F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("p")))
    out = out.withColumns(
        {"n_words": F.size("_words").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
         "_windows": F.sort_array(F.when(F.size("_words") > 2, F.slice(window, F.lit(1), F.size("_words") - 2)).otherwise(F.slice(window, 1, 0)))}
    )
    twice = lambda x, i: (F.get("_windows", i + 1)["h"] == x["h"]) | ((i > 0) & (F.get("_windows", i - 1)["h"] == x["h"]))
    out = out.withColumn("_at", F.sort_array(F.transform(F.filter("_windows", lambda x, i: F.coalesce(twice(x, i), F.lit(False))), lambda x: x["p"])))
    covered = F.aggregate(F.transform("_at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_at", i + 1) - p, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    out = out.withColumn("n_repeat_words", covered.cast("long")).drop("_words", "_lines", "_windows", "_at")
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))


def host_verdicts(measured: DataFrame, host: str = "host", most: float = MOST_HOST_RATE) -> DataFrame:
    """One row per host: ``host, n_docs, n_failed, shrunk_rate, host_kept``.

    The prior has the pooled rate m as mean and k = m(1-m)/v - 1 as strength, v being the variance of the hosts' rates weighted
    by documents; k is held within 1 to 1e6 (equal rates: 1e6). Only the two sums behind it reach the driver.
    """
    hosts = materialise(measured.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")))
    total = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs")).alias("q")).first()
    n = total["n"] or 1
    m = (total["f"] or 0) / n
    v = max((total["q"] or 0.0) / n - m * m, 0.0)
    k = min(max(m * (1 - m) / v - 1, 1.0), 1e6) if v > 0 else 1e6
    rate = (F.col("n_failed") + F.lit(m * k)) / (F.col("n_docs") + F.lit(k))
    return hosts.withColumn("shrunk_rate", rate).withColumn("host_kept", F.col("shrunk_rate") <= most)


def apply_rules(docs: DataFrame, columns: list[str] | None = None, text: str = "text", source: str = "source", most: float = MOST_HOST_RATE) -> DataFrame:
    """``columns`` of ``docs`` (all, if not given) with the measures, ``base_failed`` and ``kept``.

    The measured rows are written once to the shared folder, since they serve the hosts' counts and the join back. The join is
    left to the planner: it broadcasts the hosts only below its size threshold and splits a hot host's partition otherwise.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c not in (*MEASURES, "base_failed", "kept")]
    # the caller's columns travel in one struct, so that no name of theirs meets one of this module's
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text).alias("text"), F.col(source).alias("source"))
    measured = materialise(measure(carried).select("row", host_of(F.col("source")).alias("host"), *MEASURES, "base_failed"))
    hosts = host_verdicts(measured, "host", most).select("host", "host_kept")
    return measured.join(hosts, "host").select("row.*", *MEASURES, "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"))
