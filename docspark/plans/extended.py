"""More registered queries: what the catalog's do not reach. Texts of the tables are Latin; ``_arabic`` turns their letters into Arabic ones."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import replace
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text as T
from ..functions import tokens
from ..operators import chunking, dedupe, images, lexical, memory, ocr_text, prompts, ranking, report, search, shared, sheets, store
from ..plugins import embedding
from ..sources import audio, files
from . import batch, table_functions
from .agent import first_of_turn, token_totals
from .catalog import _facts, _neighbours, _points, _ranked, query, table

#: Small letters, some capitals and digits, and the Arabic letters, marks and digits that stand for them.
LATIN, ARABIC = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789", "ابةدأفغهيجكلمنوإقرستؤىئآزص\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652\u0640\u0670٠١٢٣٤٥٦٧٨٩"
SECRET = "a test secret"


def _arabic(c: Column) -> Column:
    return F.translate(c, LATIN, ARABIC)


@query
def arabic_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _arabic(F.col("text")).alias("t"))
    return docs.select("doc_id", T.detect_language(F.col("t")).alias("lang"), F.md5(T.normalize_arabic(F.col("t"))).alias("normal"), F.md5(T.loose_arabic(F.col("t"))).alias("loose"))


@query
def arabic_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.enrich(_arabic(F.col("text")))).alias("enriched"))


@query
def arabic_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").withColumn("t", F.concat(F.lit("ما هذا الذي ازاي "), _arabic(F.col("text"))))
    return items.select("item_id", F.array_join(T.keywords(F.col("t"), F.lit("ar")), " ").alias("kws"))


@query
def arabic_loose_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _neighbours(spark, sf_dir).select("item_id", _arabic(F.col("text")).alias("q"), _arabic(F.concat("next", F.lit(" "), F.substring("text", 1, 60))).alias("d"))
    return pairs.select("item_id", F.round(lexical.loose_score(lexical.loose_terms(F.col("q")), lexical.loose_forms(F.col("d"))), 6).alias("score"))


@query
def digit_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("\u200e"), _arabic(F.col("text")), F.lit("\u200f"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.digits_western(t)).alias("western"), F.md5(T.without_diacritics(t)).alias("bare"), F.md5(T.without_marks(t)).alias("unmarked"))


@query
def digit_splice(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("runs", ocr_text.digit_runs(F.reverse(F.col("text"))))
    return ocr_text.spliced(docs, "doc_id", "text", "runs").select("doc_id", F.md5("text").alias("spliced"))


@query
def ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.is_confident(F.col("text")).alias("confident"))


@query
def ocr_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("int").alias("page"), "text")
    return images.document_text(pages, "source").select("source", F.md5("text").alias("body"))


@query
def prompt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c, m = F.col("text"), F.concat(F.lit("context of "), F.col("text")), F.lit("memory")
    made = {}
    for lang in ("en", "ar"):
        x = F.lit(lang)
        made |= {
            f"answer_{lang}": prompts.answer(q, c, x, m), f"memory_{lang}": prompts.from_memory(q, m, x), f"summary_{lang}": prompts.summary(c, x), f"comparison_{lang}": prompts.comparison(q, c, x),
            f"extraction_{lang}": prompts.extraction(c, F.lit(1), F.lit(2), x), f"narratives_{lang}": prompts.narratives(c, m, q, x), f"gate_{lang}": prompts.topic_gate(q, c, x),
        }
    return table(spark, sf_dir, "benchmark").select("item_id", *[F.md5(v).alias(k) for k, v in made.items()])


@query
def memory_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = memory.rendered(_facts(spark, sf_dir).where("importance > 2"), "conv_id", "turn", 300)
    said = memory.prompt_lines(table(spark, sf_dir, "conversations"))
    return said.join(facts, "conv_id", "left").select("conv_id", F.md5(prompts.memory_text(F.col("facts"), F.col("prompt"))).alias("memory"))


@query
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("url"), F.lit("?a:b|c.html"))
    kept = T.safe_filename(name)
    return table(spark, sf_dir, "pages").select("page_id", T.safe_id(F.col("url")).alias("safe_id"), kept.alias("filename"), store.stored_name(kept, F.sha2("html", 256)).alias("stored"), report.object_name(kept, F.col("url")).alias("report"))


@query
def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conv_id")).distinct()
    return conv.select("conv_id", tokens.signed(F.col("conv_id"), SECRET).alias("token"))


@query
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit('{"k": "turn '), F.col("turn").cast("string"), F.lit('"}'))
    raw = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("Sure: "), body, F.lit(" done"))).otherwise(F.concat(F.lit("no object {"), F.col("role")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.try_variant_get(T.salvage_json(raw), "$.k", "string").alias("k"))


@query
def fact_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("turn") % 4 == 3, F.lit("many")).otherwise((F.col("turn") * 3 - 2).cast("string"))
    kind = F.when(F.col("turn") % 2 == 0, F.lit("Decision")).otherwise(F.col("role"))
    raw = F.array(F.struct(F.concat(F.lit("  "), F.col("text"), F.lit("\n")).alias("text"), kind.alias("category"), given.alias("importance")), F.struct(F.lit(" ").alias("text"), kind.alias("category"), given.alias("importance")))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(memory.cleaned(raw)).alias("f"))
    return rows.select("conv_id", "turn", F.md5("f.text").alias("fact"), "f.category", "f.importance")


@query
def text_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(T.text_list(F.split("text", "\n", -1)), "|")).alias("items"))


@query
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for jobs that ended in one stage or another."""
    stage = F.element_at(F.array(*map(F.lit, ("parsing", "chunking", "embedding", "done", "queued"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", stage.alias("stage")).withColumn("message", T.error_category(F.col("stage")))


@query
def audio_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("[x] mean_volume: -"), (F.col("doc_id") % 100).cast("string"), F.lit(".5 dB"))).otherwise("n/a")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), log.alias("log"), F.substring("text", 1, 2500).cast("binary").alias("pcm"))
    return audio.audio_gate(docs, replace(DEFAULTS, min_audio_bytes=1500)).select("doc_id", "status")


@query
def spoken_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    asked = F.when(F.col("doc_id") % 5 == 0, "en").when(F.col("doc_id") % 5 == 1, "ar").otherwise("auto")
    p_ar = F.when(F.col("doc_id") % 13 > 0, (F.col("doc_id") % 11) / 10)
    return docs.select("doc_id", audio.spoken_language(asked, p_ar, (F.col("doc_id") % 7) / 10).alias("language"))


def _files(docs: DataFrame, ext: str, content: Column) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(ext))
    return docs.select(name.alias("path"), name.alias("filename"), content.alias("content"))


def _doc_id(loaded: DataFrame) -> DataFrame:
    return loaded.withColumn("doc_id", F.regexp_extract("path", r"(\d+)", 1).cast("long"))


@query
def scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _doc_id(files.load(_files(docs, ".md", F.col("text").cast("binary")))).select("doc_id", "file_type", F.md5("text").alias("body"))


@query
def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = F.when(F.col("doc_id") % 10 == 9, F.lit("{broken")).otherwise(F.to_json(F.struct("doc_id", "source", "lang"))).cast("binary")
    return _doc_id(files.load(_files(docs, ".json", content))).select("doc_id", "text")


@query
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of all nations, through the reader, to its summary and row groups."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat_ws(";", "n_nationkey", "n_name", "n_regionkey").alias("l")))), lambda x: x["l"])
    body = F.concat(F.lit("n_nationkey;n_name;n_regionkey\n"), F.array_join(lines, "\n"))
    one = table(spark, sf_dir, "nation").agg(body.cast("binary").alias("content"))
    made = files.load(one.select(F.lit("nation.csv").alias("path"), F.lit("nation.csv").alias("filename"), "content"))
    return made.select("chunk_type", F.coalesce("row_range", F.lit("")).alias("row_range"), F.md5("text").alias("body"))


def _packed(docs: DataFrame, pack, ext: str) -> DataFrame:
    """Documents as files of a binary format."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in shared.slices(batch):
                ids, texts = (batch.column(c).slice(a, b - a) for c in ("doc_id", "text"))
                yield pa.RecordBatch.from_arrays([ids, pa.array([pack(x or "") for x in texts.to_pylist()], pa.binary())], ["doc_id", "content"])

    return _files(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, content binary"), ext, F.col("content"))


def docx_bytes(text: str) -> bytes:
    """A text as a word-processor file, a paragraph a line."""
    kept = "".join(c for c in text if c in "\n\t" or c >= " ")
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in kept.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


@query
def scan_docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(T.clean(F.col("text")) != "")
    return _doc_id(files.load(_packed(docs, docx_bytes, ".docx"))).select("doc_id", F.md5(F.regexp_replace("text", r"\s+", " ")).alias("body"))


@query
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 5).alias("page"), "doc_id", "text")
    return files.page_texts(rows, "source", "page", "doc_id", "text").select("source", "page", F.md5("text").alias("body"))


@query
def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 5).alias("page"), "doc_id", "text")
    pages = files.page_texts(rows, "source", "page", "doc_id", "text")
    return files.full_text(pages, "source", "page").select("source", F.md5("text").alias("body"))


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("slice_no"), F.col("doc_id").alias("page_start"), (F.col("doc_id") + F.col("doc_id") % 2).alias("page_end"), "text")
    return report.extracted(docs)


@query
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.sections(_slices(spark, sf_dir), "source").select("source", "section_no", "page_ref", F.md5("title").alias("title"), F.md5("summary").alias("summary"))


@query
def report_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.capped(report.buckets(_slices(spark, sf_dir), "source")).select("source", "section", "place", F.md5("item").alias("item"))


@query
def report_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.definitions(_slices(spark, sf_dir), "source").select("source", "term", "definition", "page")


@query
def report_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.digest(_slices(spark, sf_dir), "source", "slice_no", "section_title", "summary").select("source", F.md5("digest").alias("digest"))


@query
def report_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.extents(table(spark, sf_dir, "documents"), "lang", "doc_id", "source").select("lang", "page_count", F.array_join("sources", "|").alias("sources"))


@query
def report_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.narratives(_slices(spark, sf_dir), "source").select("source", *[F.md5(n).alias(n) for n in report.NARRATIVES])


@query
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = shared.kept(_slices(spark, sf_dir).drop("text"))  # read for sections, lists and narratives
    made = report.rendered(report.sections(maps, "source"), report.buckets(maps, "source"), report.narratives(maps, "source"), "source")
    return made.select("source", "place", "title", F.md5("body").alias("body"))


@query
def topic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit(" Yes, "), F.col("text"))).when(F.col("turn") % 4 == 1, "نعم").when(F.col("turn") % 4 == 2, F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", report.is_covered(said).alias("covered"))


@query
def question_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's own words beside a planner's question, variants once whatever their case, and what is searched when nothing is hit."""
    items = table(spark, sf_dir, "benchmark")
    planned = search.variants(F.concat(F.lit("About "), F.col("text")))
    once = dedupe.fold_case_dedupe(F.split("text", " ", -1))
    return items.select("item_id", F.md5(F.array_join(search.anchored(planned, F.col("text")), "|")).alias("anchored"), F.array_join(once, " ").alias("once"), search.fallback_query(F.col("text")).alias("fallback"))


@query
def unseen_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = shared.kept(_ranked(spark, sf_dir, 6).select("item_id", "doc_id"))  # read for both halves
    known = ranked.where("item_id % 2 = 0").select("doc_id")
    return store.unseen_results(ranked.where("item_id % 2 = 1"), known, "doc_id").select("item_id", "doc_id")


@query
def repeated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit(" "), F.col("text")).alias("question"))
    return first_of_turn(said, "conv_id", "question", "turn").select("conv_id", "turn")


@query
def token_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("user_id", F.length("event_type").alias("prompt_tokens"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 50).alias("completion_tokens"), (F.length("event_type") + F.col("event_id") % 50).alias("total_tokens"))
    return token_totals(calls, "user_id")


@query
def variant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items are the variants of one question; a document counts with its best score."""
    scored = _ranked(spark, sf_dir, 6).withColumn("question", F.floor(F.col("item_id") / 2))
    return lexical.best_over_variants(scored, "question", "doc_id", "score").select("question", "doc_id", F.round("score", 6).alias("score"))


@query
def blended_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blend with a model's scores and with the penalty for summaries beside rows."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", ((F.col("vec_id") % 97) / 97).alias("lex"), (F.col("vec_id") % 24).alias("idx"), F.when(F.col("vec_id") % 5 > 0, (F.col("vec_id") % 89) / 89).alias("model"))
    any_rows = F.max(((F.col("vec_id") % 11 == 0) & (F.col("label") < 4)).cast("int")).over(ranking.Window.partitionBy("label")) == 1
    return rows.select("vec_id", F.round(ranking.blend(F.col("lex"), F.col("idx"), F.col("vec_id") % 3 == 0, any_rows, F.col("model")), 6).alias("score"))


@query
def usable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.col("p_partkey") % 7 == 0
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.when(~empty, F.col("p_name")).alias("p_name"), F.when(~empty, F.col("p_size")).alias("p_size"))
    return sheets.usable_rows(part, "pos", replace(DEFAULTS, excel_max_rows=100))


@query
def lateral_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two splitters as table functions, called from SQL."""
    table_functions.register(spark)
    docs = {"docs": table(spark, sf_dir, "documents").select("doc_id", "text")}
    return spark.sql(
        """SELECT doc_id, 'recursive' AS way, pos, md5(chunk) AS chunk FROM {docs}, LATERAL recursive_chunks(text, 700, 150)
        UNION ALL SELECT doc_id, 'hybrid', pos, md5(chunk) FROM {docs}, LATERAL hybrid_chunks(text)""", **docs)  # fmt: skip


@query
def column_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of an address as a sheet's header."""
    parts = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.split(F.concat(F.lit(" "), "url", F.lit(" /Unnamed: 3/")), "/", -1)).alias("pos", "given"))
    return parts.select("page_id", "pos", "given", sheets.clean_column(F.col("given"), F.col("pos") + 1).alias("name"))


@query
def chunk_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    kind = F.when(d % 3 > 0, "excel").otherwise("txt")
    sheet, span = F.when(d % 2 == 0, F.concat(F.lit("S"), (d % 4).cast("string"))), F.when(d % 5 > 1, F.concat((d % 9).cast("string"), F.lit("-"), (d % 9 + 3).cast("string")))
    label = T.chunk_label(d, F.col("source"), (d % 6).cast("int"), kind, sheet, F.when(d % 7 < 2, "sheet_summary"), span)
    return table(spark, sf_dir, "documents").select("doc_id", label.alias("label"))


@query
def semantic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.semantic_groups(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "grp", "n", F.md5("chunk").alias("chunk"))


@query
def registered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's files by recency, and those of one name, out of a registry."""
    reg = table(spark, sf_dir, "documents").select(F.col("source").alias("conversation_id"), F.concat(F.lit("File"), (F.col("doc_id") % 4).cast("string")).alias("filename"), F.col("doc_id").cast("string").alias("document_id"), F.timestamp_seconds(F.col("doc_id") * 60).alias("processed_at"))
    mine = store.by_name(store.files(reg, "src3"), "FILE3")
    place = F.row_number().over(ranking.Window.partitionBy("conversation_id").orderBy(F.desc("processed_at"), "filename"))
    return mine.select("conversation_id", "document_id", place.alias("place"))


def _stored(spark: SparkSession, sf_dir: str) -> store.ChunkStore:
    """A store of all documents, a chunk each, their sources as conversations."""
    docs = table(spark, sf_dir, "documents")
    made = store.ChunkStore(spark, shared.folder(spark), buckets=8, dim=1)
    none = [F.lit(None).cast("string").alias(c) for c in ("file_type", "chunk_type", "sheet_name", "row_range")]
    key = [F.col("source").alias("conversation_id"), F.col("doc_id").cast("string").alias("document_id")]
    chunks = docs.select(*key, F.lit("f").alias("source"), F.lit(0).alias("page"), F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), "text", F.array(F.lit(1.0)).alias("embedding"), *none)
    registry = docs.select(*key, F.sha2("text", 256).alias("file_hash"), F.lit("f").alias("filename"), F.lit("f").alias("stored_path"), F.lit("txt").alias("file_type"), F.lit(1).alias("chunks"), F.timestamp_seconds(F.lit(0)).alias("processed_at"))
    made.add(chunks, registry)
    return made


def _left(made: store.ChunkStore) -> DataFrame:
    return made.read("chunks").select(F.col("document_id").cast("long").alias("doc_id"), F.col("conversation_id").alias("source"), F.md5("text").alias("body"))


@query
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items asked at once, each of one source's documents, from a store; by score alone, as SQL has no greedy choice."""
    docs = table(spark, sf_dir, "documents")
    made = store.ChunkStore(spark, shared.folder(spark), buckets=8)
    none = [F.lit(None).cast("string").alias(c) for c in ("file_type", "chunk_type", "sheet_name", "row_range")]
    key = [F.col("source").alias("conversation_id"), F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("f"), "doc_id").alias("source")]
    chunks = docs.select(*key, F.lit(0).alias("page"), F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), "text", embedding(None, F.col("text")).alias("embedding"), *none)
    made.add(chunks, spark.createDataFrame([], store.REGISTRY))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(F.lit("src"), (F.col("item_id") % 10).cast("string")).alias("conversation_id"), F.col("text").alias("question"))
    found = batch.search_many(made, asked, replace(DEFAULTS, mmr_lambda=1.0))
    return found.select(F.col("question_id").cast("long").alias("question_id"), F.col("document_id").cast("long").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query
def delete_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _stored(spark, sf_dir)
    made.delete_document("7", "src7")
    made.delete_document("8", "src0")
    return _left(made).drop("body")


@query
def delete_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _stored(spark, sf_dir)
    gone = made.delete_conversation("src3")
    again = made.delete_conversation("src3")
    return _left(made).groupBy("source").agg(F.count("*").alias("n")).select("source", "n", F.lit(gone).cast("long").alias("gone"), F.lit(again).cast("long").alias("again"))


@query
def reindex_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's chunks replaced in the store; all others as they were."""
    made = _stored(spark, sf_dir)
    row = made.read("chunks").where("document_id = '7'").select("conversation_id").first()
    conv = row["conversation_id"]
    fresh = made.read("chunks").where("document_id = '7'").drop("bucket").withColumn("text", F.upper("text"))
    registry = made.registered(conv, document_id="7").drop("bucket").withColumn("file_hash", F.lit("new"))
    made.reindex("7", conv, fresh, registry)
    return _left(made).select("doc_id", "body")


@query
def diverse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal marginal relevance within each label, by a score that does not depend on sums of floats."""
    points = _points(spark, sf_dir).withColumn("score", (F.col("point_id") * 7919 % 1000) / 1000).withColumn("idx", F.col("point_id"))
    return ranking.diversify(points.withColumnRenamed("label", "question"), "question", 6).select("question", "point_id", "pick")
