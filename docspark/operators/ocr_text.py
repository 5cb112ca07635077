"""What happens to recognised text: merging of results and fractured lines, repair of digit runs, and answers' repeated lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.values import BANNED_OPENINGS, NOT_FOUND
from .folds import fold
from .numbering import numbered_within
from .shared import kept, slices

#: Where a text's lines end.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
LIST_MARK = r"^[\-•*]|^\(?\d+[.)،]"


def lines_of(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("pos", "line"))


def _picked():
    """The lines of texts at given positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a, b in slices(whole):
                batch = whole.slice(a, b - a)
                rows, places, lines = [], [], []
                for i, (text, at) in enumerate(zip(batch.column("text").to_pylist(), batch.column("at").to_pylist(), strict=True)):
                    held = text.split("\n")
                    rows += [i] * len(at)
                    places += [x["place"] for x in at]
                    lines += [held[x["pos"]] for x in at]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), pa.array(places, pa.int32()), pa.array(lines, pa.string())], ["key", "place", "line"])

    return run


def merged_results(results: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Lines of several recognition results of one image, the longest result first, each line once: ``key, place, line``.

    Results and forms of lines stand as 128 bits of their hashes while results are ordered, first lines found and these numbered; texts are
    shuffled once, to where their lines are picked. Results are ordered by length and first characters; whole texts of those that agree in
    both, and only these, say the rest.
    """
    hashed = F.unhex(F.md5(F.concat(F.xxhash64(key).cast("string"), F.lit(" "), F.col(text))))
    said = results.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), hashed.alias("h"))
    kind = dict(said.dtypes)["key"]
    slim = kept(said.select("key", "h", (-F.length("text")).alias("n"), F.substring("text", 1, 48).alias("head")).distinct())
    shared = slim.withColumn("_n", F.count("*").over(Window.partitionBy("key", "n", "head"))).where("_n > 1").select("h")
    ties = said.join(shared, "h", "left_semi").select("key", "h", "text").distinct()
    ties = numbered_within(ties, ["key"], ["text"], "tie").select("h", "tie")
    ranked = kept(numbered_within(slim.join(ties, "h", "left"), ["key"], ["n", "head", "tie"], "r").select("key", "h", "r"))
    rows = said.select("h", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("form", T.collapse(F.lower("line"))).where("form <> ''")
    rows = rows.groupBy("h", F.unhex(F.md5("form")).alias("k")).agg(F.min("pos").alias("pos")).join(ranked, "h")
    first = rows.groupBy("key", "k").agg(F.min(F.shiftleft("r", 31) + F.col("pos")).alias("at"))  # by result, then line
    placed = numbered_within(first.select("key", "at"), ["key"], ["at"], "place")
    chosen = F.collect_list(F.struct((F.col("at") % (1 << 31)).cast("int").alias("pos"), F.col("place").cast("int").alias("place"))).alias("at")
    chosen = placed.groupBy("key", F.shiftright("at", 31).alias("r")).agg(chosen).withColumnRenamed("key", "_key")
    chosen = ranked.join(chosen.withColumnRenamed("r", "_r"), F.col("key").eqNullSafe(F.col("_key")) & (F.col("r") == F.col("_r"))).select("key", "h", "at")
    texts = said.groupBy("h").agg(F.any_value("text").alias("text"))
    found = texts.join(chosen, "h").select("key", "text", "at").mapInArrow(_picked(), f"key {kind}, place int, line string")
    return found.withColumnRenamed("key", key)


def merge_fractured(docs: DataFrame, key: str, text: str = "text", short: int = 15, run: int = 6) -> DataFrame:
    """``key, place, line``: runs of short lines joined, up to six at a time. Islands by window, cut into sixes."""
    rows = lines_of(docs, key, text).withColumn("s", T.strip(F.col("line")))
    rows = rows.withColumn("fits", (F.col("s") != "") & (F.length("s") <= short) & ~F.col("s").rlike(LIST_MARK))
    order = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("island", F.sum(F.when(F.col("fits"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = F.row_number().over(Window.partitionBy(key, "island", "fits").orderBy("pos")) - 1
    rows = rows.withColumn("part", F.when(F.col("fits"), F.floor(within / run)).otherwise(-1))
    parts = F.array_sort(F.collect_list(F.struct("pos", "s", "line")))
    made = rows.groupBy(key, "island", "part").agg(F.min("pos").alias("at"), parts.alias("l"))
    line = F.when(F.size("l") > 1, F.array_join(F.transform("l", lambda x: x["s"]), " ")).otherwise(F.col("l")[0]["line"])
    return made.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).alias("place"), line.alias("line"))


def spliced(rows: DataFrame, key: str, text: str, runs: str) -> DataFrame:
    """``key, text``: suspect tokens replaced in order by the digit runs of a second recognition; what has no run stays."""
    tokens = rows.select(key, F.col(runs).alias("runs"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), " ", -1)).alias("pos", "t"))
    bad = F.coalesce(T.is_digit_suspect(F.col("t")), F.lit(False))
    before = F.sum("bad").over(Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    placed = tokens.withColumn("bad", bad.cast("int")).withColumn("n", before)
    token = F.when((F.col("bad") == 1) & (F.col("n") <= F.size("runs")), F.get("runs", F.col("n") - 1)).otherwise(F.col("t"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pos", token.alias("t")))), lambda x: x["t"])
    return placed.groupBy(key).agg(F.array_join(parts, " ").alias("text"))


def digit_runs(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([0-9٠-٩]+)"), F.lit(1))


def _opened(line: Column) -> Column:
    """A line without an opening that only names sources."""
    out = line
    for b in reversed(BANNED_OPENINGS):
        at = F.locate(b, line)
        out = F.when(F.startswith(T.strip(line), F.lit(b)), T.strip(F.concat(F.substring(line, F.lit(1), at - 1), F.substring(line, at + len(b), F.length(line))))).otherwise(out)
    return out


def clean_answers(answers: DataFrame, key: str, text: str, lang: str, last: int = 10) -> DataFrame:
    """``key, answer``: answers without repeated lines (compared with the last ten kept) and without openings that only name sources.

    Forms of lines are columns; which line stays depends on those kept before it, a fold that holds ten forms.
    """
    lines = answers.select(key, F.col(lang).alias("lang"), F.posexplode(F.split(T.clean(F.col(text)), LINE_END, -1)).alias("pos", "line"))
    lines = lines.withColumn("line", _opened(F.col("line"))).withColumn("form", T.normalize(F.col("line")))

    def step(seen: list[str] | None, row: tuple) -> tuple[list[str], tuple]:
        seen, form = seen or [], row[0]
        if not form:
            return seen, (True,)
        return (seen, (False,)) if form in seen else ([*seen, form][-last:], (True,))

    kept = fold(lines, key, ["pos"], ["form"], step, "stays boolean")
    parts = F.transform(F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("pos", "line")))), lambda x: x["line"])
    made = kept.groupBy(key).agg(F.any_value("lang").alias("lang"), T.strip(F.array_join(parts, "\n")).alias("answer"))
    fixed = F.when(F.col("lang") == "ar", NOT_FOUND["ar"]).otherwise(NOT_FOUND["en"])
    return made.select(key, F.when(F.col("answer") != "", F.col("answer")).otherwise(fixed).alias("answer"))
