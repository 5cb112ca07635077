"""Reports over a whole document: page packing, extraction per slice, and aggregation with page references."""

from __future__ import annotations

import functools
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T
from ..functions.values import REPORT_CAPS, REPORT_SECTIONS
from .numbering import numbered_within, running
from .shared import kept

#: A word's beginning, written out because engines differ in what ends a word.
BEFORE = r"(?:^|[^\p{L}\p{N}_])"


#: Pages of a document whose links one task follows.
SPAN = 4096


def _next_starts(size: int):
    """For pages of one stretch of running lengths (idx, n, upto: whether a row asks or answers): where the slice after the one from here begins."""

    def run(rows: pa.Table) -> pa.Table:
        idx, upto, n = (rows.column(c).to_numpy() for c in ("idx", "upto", "n"))
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        held = np.argsort(upto[~asks], kind="stable")
        lengths, places = upto[~asks][held], idx[~asks][held]
        own, limit = idx[asks], upto[asks] - n[asks] + size
        at = np.searchsorted(lengths, limit, "right") - 1  # the last page that still fits
        found = np.where(at >= 0, places[np.maximum(at, 0)] if len(places) else 0, 0)
        return pa.table({"doc": rows.column("doc").filter(pa.array(asks)), "idx": pa.array(own), "nxt": pa.array(np.maximum(found, own) + 1)})

    return run


def _exits(links: pa.Table) -> pa.Table:
    """For each page of a span, the first page beyond the span that its chain of slices reaches."""
    links = links.sort_by("idx")
    idx, nxt = links.column("idx").to_numpy(), links.column("nxt").to_numpy()
    out, first = nxt.copy(), int(idx[0])
    for i in range(len(idx) - 1, -1, -1):
        if nxt[i] <= idx[-1]:
            out[i] = out[nxt[i] - first]
    return pa.table({"doc": links.column("doc"), "idx": links.column("idx"), "beyond": pa.array(out)})


def _borders(links: pa.Table) -> pa.Table:
    """Which pages of a span begin a slice, from where the chain enters it (``entry``, null if it passes by), as a running count."""
    links = links.sort_by("idx")
    idx, nxt, entry = links.column("idx").to_numpy(), links.column("nxt").to_numpy(), links.column("entry")[0].as_py()
    begins = np.zeros(len(idx), np.int64)
    while entry is not None and entry <= idx[-1]:
        begins[entry - idx[0]] = 1
        entry = int(nxt[entry - idx[0]])
    return pa.table({"doc": links.column("doc"), "idx": links.column("idx"), "part": links.column("part"), "local": pa.array(np.cumsum(begins))})


def slice_numbers(pages: DataFrame, doc: str, page: str, length: Column, size: int) -> DataFrame:
    """``doc, page, slice_no``: pages in order, a new slice where the next page would not fit.

    Where a slice that begins at a page would end follows from running lengths, for each page by itself: pages whose running lengths lie
    within one size of each other meet in a task. The slices are the chain of these links from the first page. Spans of ``SPAN`` pages
    say where a chain that enters them leaves; from span to span pointers are doubled, so the rounds go by the logarithm of a
    document's spans; then each span marks its borders. No task holds more of a document than a span.
    """
    kind = dict(pages.dtypes)[doc]
    placed = running(pages.select(doc, page, length.cast("long").alias("n")).where("n > 0"), [doc], [page], {"idx": F.lit(1), "upto": F.col("n") + 2})
    placed = kept(placed.withColumnRenamed(doc, "doc"))
    stretch = lambda c: F.floor(c / (size + 2))
    rows = placed.select("doc", "idx", "n", "upto")
    # a page asks for the last one whose running length is within the size of its own beginning, which lies in the same stretch or the one before
    asks = rows.select("*", F.lit(True).alias("asks"), stretch(F.col("upto") - F.col("n") + size).alias("stretch"))
    answers = rows.select("*", F.lit(False).alias("asks"), F.explode(F.array(stretch(F.col("upto")), stretch(F.col("upto")) + 1)).alias("stretch"))
    links = asks.unionByName(answers).groupBy("doc", "stretch").applyInArrow(_next_starts(size), f"doc {kind}, idx long, nxt long")
    part = F.floor((F.col("idx") - 1) / SPAN)
    links = kept(links.withColumn("part", part))
    spans = links.agg(F.max("part")).first()[0] or 0
    entries = links.where("idx = 1").select("doc", F.lit(1).cast("long").alias("entry"))
    if spans:
        exits = kept(links.groupBy("doc", "part").applyInArrow(_exits, f"doc {kind}, idx long, beyond long"))
        hops = exits.select("doc", F.col("idx").alias("a"), F.col("beyond").alias("b"))
        targets = hops.select("doc", F.col("b").alias("a")).unionByName(entries.select("doc", F.col("entry").alias("a"))).distinct()
        hops = hops.join(hops.select("doc", F.col("a").alias("b")), ["doc", "b"], "left_semi")  # a document's last chain ends
        hops = kept(hops.join(targets, ["doc", "a"], "left_semi").select("doc", "a", "b"))  # only where a chain can enter a span
        for _ in range(spans.bit_length()):
            step = lambda df, c: df.join(hops.withColumnRenamed("a", c), ["doc", c])  # noqa: E731, B023
            entries = kept(entries.unionByName(step(entries, "entry").select("doc", F.col("b").alias("entry"))).distinct())
            hops = kept(step(hops.withColumnRenamed("b", "m"), "m").select("doc", "a", "b"))
    entries = entries.withColumn("part", F.floor((F.col("entry") - 1) / SPAN))
    marked = kept(links.join(entries, ["doc", "part"], "left").groupBy("doc", "part").applyInArrow(_borders, f"doc {kind}, idx long, part long, local long"))
    held = marked.groupBy("doc", "part").agg(F.max("local").alias("n"))
    before = held.select("doc", "part", F.coalesce(F.sum("n").over(Window.partitionBy("doc").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbers = marked.join(before, ["doc", "part"]).select("doc", "idx", (F.col("before") + F.col("local") - 1).cast("int").alias("slice_no"))
    return placed.join(numbers, ["doc", "idx"]).select(F.col("doc").alias(doc), page, "slice_no")


def packed_pages(pages: DataFrame, doc: str, page: str, text: str, size: int = DEFAULTS.report_slice_chars) -> DataFrame:
    """``doc, slice_no, page_start, page_end, text``: pages in order, a new slice where the next page would not fit; pages without text are left out."""
    numbers = slice_numbers(pages, doc, page, F.length(text), size)
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))), lambda x: x["t"])
    made = pages.select(doc, page, text).where(F.col(text) != "").join(numbers, [doc, page]).groupBy(doc, "slice_no")
    return made.agg(F.min(page).alias("page_start"), F.max(page).alias("page_end"), F.array_join(parts, "\n\n").alias("text"))


def extracted(slices: DataFrame, text: str = "text") -> DataFrame:
    """The default extractor, patterns only: numbers, equations, definitions, sentences that advise; title, summary and key points are the first sentences."""
    body, said_first = F.col(text), F.col("_said")
    none = F.array().cast("array<string>")
    holds = lambda c, *parts: functools.reduce(operator.or_, [F.contains(c, F.lit(x)) for x in parts])
    where = lambda has, found: F.when(~has, none).otherwise(found)  # noqa: E731  (patterns are slow, and most texts lack a part that one needs)
    every = lambda pattern, group: F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), F.lit(group)))
    advice = F.filter(said_first, lambda x: F.rlike(F.lower(x), F.lit(BEFORE + "(?:should|must|recommend|best practice)")))
    advice = where(holds(F.lower(body), "should", "must", "recommend", "best practice"), advice)
    said = where(holds(body, " is "), F.regexp_extract_all(body, F.lit(r"([A-Z][\p{L}]+(?: [\p{L}]+)? is (?:a|an|the) [^.\n]+\.)"), F.lit(1)))
    definitions = F.transform(said, lambda x: F.struct(F.substring_index(x, " is ", 1).alias("term"), F.regexp_replace(x, r"^.*? is ", "").alias("definition")))
    return slices.withColumn("_said", T.sentences(body)).withColumns(
        {"page_ref": T.page_ref(F.col("page_start"), F.col("page_end")), "section_title": F.substring(F.coalesce(F.get(said_first, F.lit(0)), F.lit("")), 1, 80),
         "summary": F.array_join(F.slice(said_first, 1, 2), " "), "key_points": F.slice(said_first, 1, 3), "numbers": every(BEFORE + r"(\d[\d.,]*%?)", 1),
         "equations": where(holds(body, " = "), every(r"(\w+ = [^\n.;]+)", 1)), "technical_terms": every(BEFORE + r"([A-Z]{2,})(?:$|[^\p{L}\p{N}_])", 1), "best_practices": advice,
         "figures_tables": where(holds(body, "Figure ", "Table "), every(r"((?:Figure|Table) \d+)", 1)), "definitions": definitions}
    ).drop("_said")


def buckets(maps: DataFrame, doc: str, order: str = "slice_no") -> DataFrame:
    """``doc, section, place, item``: list items with their page, each once by its first 200 characters, in order of appearance."""
    lists = [s for s in REPORT_SECTIONS if s != "definitions"]
    rows = maps.select(doc, order, "page_ref", F.explode(F.array(*[F.struct(F.lit(s).alias("section"), F.col(s).alias("items")) for s in lists])).alias("b"))
    rows = rows.select(doc, order, "page_ref", "b.section", F.posexplode("b.items").alias("i", "text"))
    keyed = rows.withColumn("key", F.substring(T.collapse(F.lower("text")), 1, 200)).where("key <> ''")
    first = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(doc, "section", "key").orderBy(order, "i"))).where("_r = 1")
    item = F.concat(T.strip(F.col("text")), F.when(F.coalesce("page_ref", F.lit("")) != "", F.concat(F.lit(" ("), F.col("page_ref"), F.lit(")"))).otherwise(""))
    placed = numbered_within(first.select(doc, "section", order, "i", item.alias("item")), [doc, "section"], [order, "i"], "place")
    return placed.select(doc, "section", F.col("place").cast("int").alias("place"), "item")


def definitions(maps: DataFrame, doc: str, order: str = "slice_no") -> DataFrame:
    rows = maps.select(doc, order, "page_ref", F.posexplode("definitions").alias("i", "d")).withColumn("term", T.strip(F.col("d.term"))).where("term <> ''")
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(doc, F.lower("term")).orderBy(order, "i"))).where("_r = 1")
    return first.select(doc, "term", F.col("d.definition").alias("definition"), F.col("page_ref").alias("page"))


def digest(maps: DataFrame, doc: str, order: str, title: str, summary: str, most: int = DEFAULTS.report_digest_chars) -> DataFrame:
    """``doc, digest``: a line per slice, cut at ``most`` characters. Running lengths say which lines begin before that; only these are put together."""
    line = F.concat(F.lit("["), F.col("page_ref"), F.lit("] "), F.col(title), F.lit(": "), F.col(summary))
    lines = maps.where(F.col(summary) != "").select(doc, F.col(order).alias("o"), line.alias("l"))
    size = F.length("l") + 1
    placed = running(lines, [doc], ["o"], {"upto": size}, {"whole": size})
    parts = F.transform(F.array_sort(F.collect_list(F.struct("o", "l"))), lambda x: x["l"])
    made = placed.where(F.col("upto") - size <= most).groupBy(doc).agg(F.array_join(parts, "\n").alias("t"), F.max("whole").alias("whole"))
    text = F.when(F.col("whole") - 1 > most, F.concat(F.substring("t", 1, most), F.lit("\n...(truncated — document continues)"))).otherwise(F.coalesce("t", F.lit("")))
    return maps.select(doc).distinct().join(made, doc, "left").select(doc, text.alias("digest"))


def capped(items: DataFrame) -> DataFrame:
    """Report items within each section's cap."""
    table = F.create_map(*[F.lit(x) for p in zip(REPORT_SECTIONS, REPORT_CAPS, strict=True) for x in p])
    return items.where(F.col("place") <= F.element_at(table, F.col("section")))


def object_name(stem: Column, topic: Column) -> Column:
    slug = F.substring(F.regexp_replace(topic, r"[^\p{L}\p{N}_-]+", "_"), 1, 80)
    return F.concat(F.regexp_replace(F.coalesce(F.nullif(slug, F.lit("")), stem), r"[^\p{L}\p{N}_.-]+", "_"), F.lit("_report.pdf"))


def sections(maps: DataFrame, doc: str, order: str = "slice_no") -> DataFrame:
    """``doc, section_no, title, page_ref, summary``: the slices of a document as sections of its report."""
    place = F.row_number().over(Window.partitionBy(doc).orderBy(order))
    return maps.select(doc, place.alias("section_no"), F.col("section_title").alias("title"), "page_ref", "summary")


def extents(pages: DataFrame, doc: str, page: str, source: str | None = None) -> DataFrame:
    """``doc, page_count[, sources]``: the last page's number, and the sources in order, each once."""
    more = [F.sort_array(F.collect_set(source)).alias("sources")] if source else []
    return pages.groupBy(doc).agg(F.max(page).alias("page_count"), *more)


NARRATIVES = ("executive_summary", "introduction", "relationships", "conclusion")


def narratives(maps: DataFrame, doc: str, order: str = "slice_no") -> DataFrame:
    """``doc`` and the four narrative parts, by extraction: first points, first and last summary, terms that several slices share."""
    by = maps.groupBy(doc).agg(
        F.min(F.struct(F.col(order).alias("o"), "summary", "key_points")).alias("first"), F.max(F.struct(F.col(order).alias("o"), "summary")).alias("last"),
    )
    terms = maps.select(doc, order, F.explode("technical_terms").alias("term")).distinct().groupBy(doc, "term").agg(F.count("*").alias("n")).where("n > 1")
    top = terms.withColumn("r", F.row_number().over(Window.partitionBy(doc).orderBy(F.desc("n"), "term"))).where("r <= 10")
    shared = top.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), ", ").alias("relationships"))
    return by.join(shared, doc, "left").select(
        doc, F.array_join("first.key_points", " ").alias("executive_summary"), F.col("first.summary").alias("introduction"),
        F.coalesce("relationships", F.lit("")).alias("relationships"), F.col("last.summary").alias("conclusion"),
    )


def is_covered(answer: Column) -> Column:
    """Whether a gate's answer says yes; one that could not be had counts as yes."""
    low = F.lower(T.clean(answer))
    return answer.isNull() | F.startswith(low, F.lit("yes")) | F.startswith(low, F.lit("نعم"))


def rendered(sections_: DataFrame, items: DataFrame, parts: DataFrame, doc: str) -> DataFrame:
    """``doc, place, title, body``: the report as rows, in order: narratives, sections, then each list within its cap."""
    told = parts.select(doc, F.posexplode(F.array(*[F.struct(F.lit(n).alias("title"), F.col(n).alias("body")) for n in NARRATIVES[:3]])).alias("i", "x"))
    rows = told.select(doc, F.struct(F.lit(0).alias("g"), F.col("i").alias("i")).alias("at"), "x.title", "x.body")
    named = F.concat("title", F.lit(" ("), "page_ref", F.lit(")"))
    rows = rows.unionByName(sections_.select(doc, F.struct(F.lit(1).alias("g"), F.col("section_no").alias("i")).alias("at"), named.alias("title"), F.col("summary").alias("body")))
    order = F.create_map(*[F.lit(x) for i, sec in enumerate(REPORT_SECTIONS) for x in (sec, i)])
    listed = capped(items).groupBy(doc, "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: F.concat(F.lit("- "), x["item"])), "\n").alias("body"))
    rows = rows.unionByName(listed.select(doc, F.struct(F.lit(2).alias("g"), F.element_at(order, F.col("section")).alias("i")).alias("at"), F.col("section").alias("title"), "body"))
    rows = rows.unionByName(parts.select(doc, F.struct(F.lit(3).alias("g"), F.lit(0).alias("i")).alias("at"), F.lit(NARRATIVES[3]).alias("title"), F.col(NARRATIVES[3]).alias("body")))
    rows = rows.where(F.coalesce("body", F.lit("")) != "")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy("at"))).select(doc, "place", "title", "body")


def markdown(rows: DataFrame, doc: str, heading: str) -> DataFrame:
    """``doc, body``: a rendered report as one Markdown text with a list of contents; layout beyond that is a viewer's."""
    ordered = F.array_sort(F.collect_list(F.struct("place", "title", "body")))
    made = rows.groupBy(doc).agg(ordered.alias("l"))
    contents = F.array_join(F.transform("l", lambda x: F.concat(x["place"].cast("string"), F.lit(". "), x["title"])), "\n")
    body = F.array_join(F.transform("l", lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), x["body"])), "\n\n")
    return made.select(doc, F.concat(F.lit("# "), F.col(heading), F.lit("\n\n"), contents, F.lit("\n\n"), body).alias("body"))
