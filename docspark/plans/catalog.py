"""The registered queries: each applies operators of this package to the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import chunking, dedupe, fuzzy, lexical, memory, ocr_text, profile, ranking, report, router, search, sheets, shared, store, substrings
from ..operators.numbering import numbered, numbered_within
from ..sources import validation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Meaningful documents, each text once, with their normal form."""
    docs = table(spark, sf_dir, "documents").where(T.is_meaningful(F.col("text")))
    return dedupe.prefix_dedupe(docs, "text", "doc_id").withColumn("normal", T.normalize(F.col("text")))


def _ranked(spark: SparkSession, sf_dir: str, k: int = 24) -> DataFrame:
    """The k best documents of each benchmark item, with their texts; texts are joined only to what is left."""
    kept = _kept(spark, sf_dir)
    best = lexical.lexical_top_k(table(spark, sf_dir, "benchmark"), kept, k, "item_id", "text", "doc_id", "normal").withColumnRenamed("query_id", "item_id")
    return best.join(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")


def _loosely(spark: SparkSession, sf_dir: str, pool: DataFrame) -> DataFrame:
    """``pool`` with ``loose``, the loose score; forms are worked out once per item and once per document of the pool."""
    docs = table(spark, sf_dir, "documents").join(pool.select("doc_id").distinct(), "doc_id", "left_semi")
    forms = docs.select("doc_id", lexical.loose_forms(F.col("text")).alias("forms"))
    terms = table(spark, sf_dir, "benchmark").select("item_id", lexical.loose_terms(F.col("text")).alias("terms"))
    return pool.join(forms, "doc_id").join(terms, "item_id").withColumn("loose", lexical.loose_score(F.col("terms"), F.col("forms"))).drop("forms", "terms")


@query
def flagship_grounded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark passage the supporting documents that the gate and the context budget leave."""
    gated = ranking.confident(_ranked(spark, sf_dir, 6), "item_id", "score")
    return ranking.within_budget(gated, "item_id", "rank", "text").select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


def _index(spark: SparkSession, sf_dir: str) -> substrings.SubstringIndex:
    return substrings.SubstringIndex.build(_kept(spark, sf_dir), "doc_id", "normal", shared.folder(spark))


@query
def indexed_grounded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship's result from a written index of words and neighbours."""
    best = shared.kept(_index(spark, sf_dir).top_k(table(spark, sf_dir, "benchmark"), 6, "item_id", "text").withColumnRenamed("query_id", "item_id"))  # few rows, so texts need not be shuffled
    gated = ranking.confident(best.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), "item_id", "score")
    return ranking.within_budget(gated, "item_id", "rank", "text").select("item_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query
def lang_script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.detect_language(F.col("text")).alias("detected"), T.is_mixed(F.col("text")).alias("mixed"))


def _form(spark: SparkSession, sf_dir: str, f: Callable) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", f(F.col("text")).alias("n")).select("doc_id", F.length("n").alias("n_chars"), F.md5("n").alias("form"))


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _form(spark, sf_dir, T.normalize)


@query
def loose_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _form(spark, sf_dir, T.loose_latin)


@query
def keywords_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = lexical.query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    return terms.select(F.col("query_id").alias("item_id"), F.array_join("kws", " ").alias("kws"), F.array_join("bigrams", "|").alias("bigrams"))


@query
def meaningful_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(T.is_meaningful(F.col("text"))).select("doc_id")


@query
def enrich_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.enrich(F.col("text"))).alias("enriched"))


@query
def code_like_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("url").alias("x"))
    items = table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.col("text").alias("x"))
    return pages.union(items).select("kind", "id", T.is_code_like(F.col("x")).alias("code_like"))


@query
def content_hash_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("conversation_id"), store.file_hash(F.col("text")).alias("file_hash"))
    return store.new_uploads(hashed, hashed.where("doc_id % 3 = 0")).select("doc_id", F.col("conversation_id").alias("source"), "file_hash")


@query
def prefix_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.prefix_dedupe(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id")


@query
def hit_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedupe.hit_dedupe(table(spark, sf_dir, "documents").withColumn("page", F.lit(0)), "text", "source", "page", "doc_id").select("doc_id", "idx")


@query
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = chunking.number_chunks(table(spark, sf_dir, "documents"), "source", ["doc_id"])
    return numbered.select("doc_id", T.chunk_id(F.col("source"), F.lit(0), F.col("chunk_index"), F.col("text")).alias("chunk_id"), "chunk_index", "total_chunks")


@query
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentence_rows(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "pos", F.md5("sentence").alias("sentence"))


@query
def sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunking.sentence_windows(chunking.sentence_rows(table(spark, sf_dir, "documents"), "doc_id"), "doc_id")
    return rows.select("doc_id", "pos", F.md5("window").alias("window_md5"))


@query
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.semantic_chunks(table(spark, sf_dir, "documents"), "doc_id")


@query
def recursive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.recursive_chunks(table(spark, sf_dir, "documents"), "doc_id")


@query
def hybrid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.hybrid_chunks(table(spark, sf_dir, "documents"), "doc_id")


@query
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")).alias("w"))
    return rows.groupBy("item_id", V.word_bucket(F.col("w")).alias("bucket")).agg(F.count("*").alias("n"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), "label")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).where("point_id % 10 = 0").withColumnRenamed("point_id", "query_id")


@query
def vector_topk_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(_asked(spark, sf_dir), _points(spark, sf_dir), 8, "label")


@query
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows as queries, against all rows of their label, then against all."""
    points = _points(spark, sf_dir)
    asked = points.withColumnRenamed("point_id", "query_id")
    both = search.top_k(asked, points, 3, "label").withColumn("scoped", F.lit(True)).unionByName(search.top_k(asked, points, 5).withColumn("scoped", F.lit(False)))
    return both.select("scoped", "query_id", "point_id", "score", "rank")


@query
def multi_variant_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a question's variants, variant by variant, each point once; ``idx`` is its place."""
    hits = search.top_k(_asked(spark, sf_dir), _points(spark, sf_dir), 8).withColumn("question", F.floor(F.col("query_id") / 40))
    first = dedupe.keep_first(hits, [F.col("question"), F.col("point_id")], [F.col("query_id"), F.col("rank")])
    place = F.row_number().over(ranking.Window.partitionBy("question").orderBy("query_id", "rank")) - 1
    return first.select("question", "point_id", place.alias("idx"))


@query
def post_topk_source_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter above the limit: it may leave fewer than k."""
    points = _points(spark, sf_dir)
    return search.top_k(_asked(spark, sf_dir), points, 8).join(points.select("point_id", "label"), "point_id").where("label = 3").select("query_id", "point_id", "rank")


@query
def mmr_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _points(spark, sf_dir)
    pool = search.top_k(_asked(spark, sf_dir), points, 24).join(points.select("point_id", "vector"), "point_id").withColumn("idx", F.col("rank") - 1)
    return ranking.diversify(pool, "query_id", 6)


@query
def blended_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = _ranked(spark, sf_dir).select("item_id", "doc_id", "score", "rank")
    final = ranking.blend(F.greatest("score", "loose"), F.col("rank") - 1, F.lit(False), F.lit(False))
    rows = _loosely(spark, sf_dir, best).withColumn("final", F.round(final, 6))
    place = F.row_number().over(ranking.Window.partitionBy("item_id").orderBy(F.desc("final"), "rank"))
    return rows.withColumn("place", place).where("place <= 6").select("item_id", "doc_id", "final", "place")


@query
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.confident(_ranked(spark, sf_dir), "item_id", "score", 0.5).select("item_id", "doc_id")


@query
def relative_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.relatively_relevant(_ranked(spark, sf_dir), "item_id", "score").select("item_id", "doc_id")


@query
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ranking.within_budget(ranking.confident(_ranked(spark, sf_dir, 6), "item_id", "score"), "item_id", "rank", "text")
    none = F.lit(None).cast("string")
    kept = kept.withColumn("label", T.chunk_label(F.col("rank"), F.col("source"), F.lit(0), none, none, none, none))
    sizes = kept.groupBy("item_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    return ranking.context(kept, "item_id", "rank", "label", "text").join(sizes, "item_id").select("item_id", "n", "chars", F.md5("context").alias("context"))


@query
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.citations(_ranked(spark, sf_dir).withColumn("page", F.lit(0)), "item_id", "rank", "source", "page")


@query
def active_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.active_source(_ranked(spark, sf_dir), "item_id", "rank", "source")


PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.row_lines(numbered(table(spark, sf_dir, "part"), "p_partkey", "pos"), "pos", PART)


@query
def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir)


@query
def sheet_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.row_groups(_lines(spark, sf_dir), "part").select("start", "row_range", F.md5("chunk").alias("chunk"))


@query
def sheet_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.summary(_lines(spark, sf_dir), "part", PART)


@query
def page_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = report.packed_pages(table(spark, sf_dir, "documents"), "source", "doc_id", "text")
    return packed.select("source", "slice_no", "page_start", "page_end", F.length("text").alias("n_chars"))


@query
def report_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("slice_no"), F.col("doc_id").alias("page_start"), F.col("doc_id").alias("page_end"), "text")
    return report.buckets(report.extracted(slices), "source").where(F.col("section").isin("technical_terms", "numbers")).select("source", "section", "place", "item")


@query
def memory_recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.prompt_lines(table(spark, sf_dir, "conversations"))


@query
def memory_compaction_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.compaction_points(table(spark, sf_dir, "conversations"), most=4, chars=600, keep=2)


@query
def small_talk_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", router.small_talk(F.col("text")).alias("category"))


@query
def route_override_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a planner chose for each message, beside what is done."""
    turn, conv = F.col("turn"), F.col("conv_id")
    action = F.element_at(F.array(*map(F.lit, ("respond", "generate", "retrieve", "summarize"))), ((conv + turn) % 4 + 1).cast("int"))
    cases = table(spark, sf_dir, "conversations").select("conv_id", "turn", action.alias("action"), (conv % 3).alias("n_documents"), (turn % 2).alias("n_retrieved"), router.small_talk(F.col("text")).isNotNull().alias("chatty"))
    return cases.withColumn("taken", router.routed(F.col("action"), F.col("n_documents"), F.col("n_retrieved"), F.col("chatty")))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("role") == "user", "preference").when(F.col("role") == "assistant", "decision").otherwise("fact")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", kind.alias("category"), (1 + F.col("turn") % 5).cast("int").alias("importance"), (F.col("conv_id") % 7 + F.floor(F.col("turn") / 2)).alias("updated_at"))


@query
def fact_eviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.evicted(_facts(spark, sf_dir), "conv_id", "turn", 3).select("conv_id", "turn")


@query
def fact_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.rendered(_facts(spark, sf_dir), "conv_id", "turn", 300)


@query
def fact_fuzzy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    facts = said.select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").cast("int").alias("pos"), "text", F.lit("fact").alias("category"), (1 + F.col("turn") % 5).cast("int").alias("importance"), F.timestamp_seconds(F.col("turn")).alias("updated_at"))
    return memory.merge(facts.where("pos % 2 = 0"), facts.where("pos % 2 = 1"), facts.where("pos = 0").select("conversation_id", "text"))


@query
def fact_alike_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one size, as the facts of one conversation, whose names are nearly equal: each pair once."""
    facts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_name")
    return fuzzy.alike_pairs(facts, facts, "p_partkey", "p_name", ["p_size"], 0.85).where("left_id < right_id")


@query
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.latest_state(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


@query
def session_idle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.idle_sessions(table(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "session_no")


@query
def job_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts").alias("now"))
    return events.join(F.broadcast(now), F.col("ts") >= F.col("now") - F.expr("INTERVAL 1 HOUR")).select("event_id")  # one row


@query
def stage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.stage_profile(table(spark, sf_dir, "events"), "user_id", "event_type", "value").select("user_id", "stage", F.round("ms", 4).alias("ms"), F.round("share", 4).alias("share"))


@query
def latency_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.latency_summary(table(spark, sf_dir, "events"), "event_type", "value").withColumn("avg", F.round("avg", 4))


@query
def request_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = profile.marks(events, "user_id", "event_type", "at", {"dispatch_ms": ("view", "click"), "total_ms": ("view", "purchase")})
    return spans.select("user_id", *[(F.col(c) / 1000).alias(c) for c in ("dispatch_ms", "total_ms")])


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, text, next``: each benchmark item beside the one that follows."""
    items = numbered(table(spark, sf_dir, "benchmark"), "item_id", "at")
    return items.join(items.select((F.col("at") - 1).alias("at"), F.col("text").alias("next")), "at").select("item_id", "text", "next")


@query
def cer_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = profile.char_error_rate(T.loose_latin(F.col("text")), T.loose_latin(F.col("next")))
    return _neighbours(spark, sf_dir).select("item_id", F.round(rate, 6).alias("cer"))


@query
def wer_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.word_error_rate(_neighbours(spark, sf_dir), "text", "next").select("item_id", F.round("wer", 6).alias("wer"))


@query
def document_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents beside the next one of their source: both rates, whatever their length."""
    placed = shared.kept(numbered_within(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ["source"], ["doc_id"], "at"))
    pairs = placed.join(placed.select("source", (F.col("at") - 1).alias("at"), F.col("text").alias("next")), ["source", "at"])
    return profile.word_error_rate(pairs, "text", "next").select("doc_id", F.round(profile.char_error_rate("text", "next"), 9).alias("cer"), F.round("wer", 9).alias("wer"))


@query
def ocr_line_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_text.merged_results(table(spark, sf_dir, "documents"), "source").select("source", "place", F.md5("line").alias("line"))


@query
def fractured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_text.merge_fractured(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "place", F.md5("line").alias("line"))


@query
def digit_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(F.split("text", " ", -1), T.is_digit_suspect)).alias("n"))


@query
def answer_line_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "documents").withColumn("lang", T.detect_language(F.col("text")))
    return ocr_text.clean_answers(said, "doc_id", "text", "lang").select("doc_id", F.md5("answer").alias("answer"))


#: Extensions that page names get in turn.
EXTENSIONS = ("pdf", "docx", "doc", "xls", "xlsx", "csv", "PNG", "txt", "md", "json", "zzz")


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads named by their address with each extension in turn; every other one begins with the marks of its type."""
    i = (F.col("page_id") % len(EXTENSIONS)).cast("int")
    name = F.concat("url", F.lit("."), F.element_at(F.array(*map(F.lit, EXTENSIONS)), i + 1))
    mark = F.element_at(F.array(*[F.unhex(F.lit(x)) for x in ("255044462D", "504B0304", "D0CF11E0A1B11AE1", "D0CF11E0A1B11AE1", "504B0304", "", "89504E470D0A1A0A", "", "", "", "")]), i + 1)
    content = F.concat(F.when(F.col("page_id") % 2 == 0, mark).otherwise(F.unhex(F.lit(""))), F.col("html").cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", name.alias("filename"), content.alias("content"))


@query
def upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.validate(_uploads(spark, sf_dir)).select("page_id", "status", "file_type")


@query
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _uploads(spark, sf_dir).select("page_id", validation.content_type(F.col("filename")).alias("content_type"))


@query
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(search.variants(F.col("text")), "|").alias("variants"))


@query
def refusal_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.refuses(F.col("text")).alias("refuses"))


@query
def star_join_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built-ins that no document operator needs: joins over a star schema with a rollup."""
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query
def star_window_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.dense_rank().over(ranking.Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal")))
    return table(spark, sf_dir, "customer").withColumn("rk", rank).where("rk <= 3").select("c_nationkey", "c_custkey", "rk")


@query
def star_set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n, c: table(spark, sf_dir, n).select(F.col(c).alias("nation"))
    return t("customer", "c_nationkey").intersect(t("supplier", "s_nationkey")).exceptAll(table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey"))
