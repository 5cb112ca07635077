"""The engine's surface for Python callers: ingest, search, ask, manage files, remember, report, profile; and SQL names for its tables."""

from __future__ import annotations

import contextlib
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULTS, Settings
from ..functions import text as T
from ..functions import tokens
from ..functions import vectors as V
from ..operators import chunking, dedupe, images, lexical, memory, objects, ocr_text, pdf, profile, prompts, ranking, report, search, shared, store
from ..plugins import Embedder, ExtractiveGenerator, Generator, Planner, Remembering, Reranker, Rewriter, RulePlanner, embedding, reranked
from ..sources import files
from . import batch

TOPIC_CANDIDATES = 24
NO_DOCUMENTS = {"en": "No relevant documents were found.", "ar": "لا توجد مستندات كافية للإجابة."}
SHEET = ["file_type", "chunk_type", "sheet_name", "row_range"]
#: Hears a stage's name and the number of its rows.
Progress = Callable[[str, int], None]


def silent(stage: str, rows: int) -> None:
    """No progress is told."""


class Engine:
    """Chunks and registry below ``path``; every call that reads chunks names the conversation they belong to.

    Models are plugged in; without one the defaults are deterministic and say so: a hashing embedder, lexical ranking, extraction.
    """

    def __init__(
        self, spark: SparkSession, path: str, settings: Settings = DEFAULTS, generator: Generator | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None,
        rewriter: Rewriter | None = None, planner: Planner | None = None, recognise: images.Recognise | None = None,
    ):
        self.spark, self.settings, self.path = spark, settings, path.rstrip("/")
        self.store = store.ChunkStore(spark, path, dim=embedder.dim if embedder else V.BUCKETS)
        self.objects = objects.ObjectStore(spark, f"{self.path}/objects")
        self.fact_files = objects.FactFiles(objects.ObjectStore(spark, f"{self.path}/facts"))
        self.facts = memory.fact_table(spark, f"{self.path}/memory")
        self.generator, self.planner = generator or ExtractiveGenerator(), planner or RulePlanner()
        self.embedder, self.reranker, self.rewriter, self.recognise = embedder, reranker, Remembering(rewriter), recognise
        self._events: list[tuple[str, str, float]] = []

    # ---- ingestion

    def _stage(self, rows: DataFrame, name: str, progress: Progress) -> DataFrame:
        """A stage's rows, written aside; ``progress`` hears of it once they are, with their number as it was observed on the way."""
        seen = Observation(name)
        done = self.store._held(rows.observe(seen, F.count(F.lit(1)).alias("n")))
        progress(name, seen.get["n"])
        return done

    def _prepared(self, found: DataFrame, conversation_id: str, document_id: str | None = None, progress: Progress = silent) -> tuple[DataFrame, DataFrame]:
        """(chunks, registry rows) of files (path, filename, content), stage by stage."""
        s = self.settings
        hashed = found.select("path", "filename", "content", store.file_hash(F.col("content")).alias("file_hash")).withColumn("conversation_id", F.lit(conversation_id))
        new = store.new_uploads(hashed, self.store.read("registry")) if document_id is None else hashed
        ids = F.lit(document_id) if document_id else F.concat_ws("-", F.substring("file_hash", 1, 16), F.substring(F.md5(F.lit(conversation_id)), 1, 8))
        new = new.withColumn("document_id", ids)
        pages = files.load(new, self.recognise, settings=s).where("error is null").join(new.select("path", "file_hash", "document_id"), "path")
        order = F.concat_ws("/", "path", F.format_string("%09d", "page"), F.coalesce("row_range", F.lit("")))
        pages = self._stage(dedupe.prefix_dedupe(pages.withColumn("text", T.enrich(F.col("text"))).withColumn("key", order), "text", "key"), "parsing", progress)
        whole = pages.where("file_type = 'excel'").select("key", F.lit(0).alias("pos"), F.col("text").alias("chunk")).where(T.is_meaningful(F.col("chunk")))
        made = chunking.chunk(pages.where("file_type <> 'excel'"), "key", "text", s).unionByName(whole)
        rows = made.join(pages.select("key", "filename", "page", "document_id", "file_hash", "path", *SHEET), "key").withColumn("source", F.col("filename"))
        rows = self._stage(chunking.number_chunks(rows, "source", ["key", "pos"]).withColumn("conversation_id", F.lit(conversation_id)), "chunking", progress)
        chunks = rows.select("conversation_id", "document_id", "source", "page", "chunk_index", "total_chunks", F.col("chunk").alias("text"), embedding(self.embedder, F.col("chunk")).alias("embedding"), *SHEET, "file_hash")
        chunks = self._stage(chunks, "embedding", progress)
        kinds = chunks.groupBy("conversation_id", "file_hash", F.col("source").alias("filename"), "file_type", "document_id").agg(F.count("*").cast("int").alias("chunks"))
        registry = kinds.select("conversation_id", "file_hash", "filename", store.stored_name(F.col("filename"), F.col("file_hash")).alias("stored_path"), "file_type", "chunks", F.current_timestamp().alias("processed_at"), "document_id")
        return chunks.drop("file_hash"), registry

    def ingest(self, path: str, conversation_id: str, glob: str = "*") -> int:
        """Index the new files below ``path``; the number of chunks."""
        return self.ingest_files(files.scan(self.spark, path, self.settings, glob), conversation_id)

    def ingest_files(self, found: DataFrame, conversation_id: str, progress: Progress = silent, batch: tuple[str, int] | None = None) -> int:
        """The number of chunks added; with ``batch`` (a stream and its batch's number) that batch counts once, however often it runs."""
        if batch and self.store.tables.has_batch(*batch):
            return 0
        chunks, registry = self._prepared(found, conversation_id, progress=progress)
        n = chunks.count()
        if n:
            self.store.add(chunks, registry, batch)
        return n

    def upload(self, filename: str, content: bytes, conversation_id: str) -> int:
        """Index one file's bytes and keep them as an object; that the object cannot be kept does not stop the indexing."""
        name = T.safe_filename
        row = self.spark.createDataFrame([(filename, bytearray(content))], "given string, content binary").select(name(F.col("given")).alias("filename"), "content").withColumn("path", F.col("filename"))
        n = self.ingest_files(row, conversation_id)
        with contextlib.suppress(Exception):
            self.objects.put(row.select(store.stored_name(F.col("filename"), store.file_hash(F.col("content")))).first()[0], content)
        return n

    # ---- search

    def _variants(self, question: str, raw: str | None, lang: str) -> Column:
        q, s = F.lit(question), self.settings
        alternatives, corrected, translated = ([], "", "") if self._code_like(question) else self.rewriter.rewrite(question, lang)
        found = search.variants(q, s, F.array(*map(F.lit, alternatives)).cast("array<string>"), F.lit(corrected), F.lit(translated))
        if raw and raw.strip() and raw.strip().lower() != question.strip().lower():
            return search.anchored(found, F.lit(raw))
        return dedupe.fold_case_dedupe(found)

    def _code_like(self, question: str) -> bool:
        return bool(self.spark.range(1).select(T.is_code_like(F.lit(question))).first()[0])

    def candidates(self, variants: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
        """Hits of all variants (query_id, variant), each chunk once, numbered from 0 in variant-major order."""
        points = chunks.select(T.chunk_id(F.col("source"), F.col("page"), F.col("chunk_index"), F.col("text")).alias("point_id"), F.col("embedding").alias("vector"), "source", "page", "chunk_index", "text", "document_id", *SHEET)
        asked = variants.select("query_id", embedding(self.embedder, F.col("variant"), queries=True).alias("vector"))
        hits = search.top_k(asked, points, k).join(points, "point_id")
        return dedupe.hit_dedupe(hits.withColumn("question", F.lit(0)).withColumn("order", F.col("query_id") * 1_000_000 + F.col("rank")), "text", "source", "page", "order", "question")

    def rerank(self, question: str, variants: DataFrame, hits: DataFrame, top_n: int) -> DataFrame:
        """``hits`` scored against all variants, the best diversified: with ``score`` and ``rank`` from 1."""
        kept = hits.where(T.is_meaningful(F.col("text"))).withColumns({"normal": T.normalize(F.col("text")), "forms": lexical.loose_forms(F.col("text"))})
        asked = variants.select("query_id", T.keywords(F.col("variant"), T.detect_language(F.col("variant"))).alias("kws"), T.ngrams(T.words(T.normalize(F.col("variant")))).alias("bigrams"), lexical.loose_terms(F.col("variant")).alias("terms"))
        pairs = kept.select("point_id", "normal", "forms").join(F.broadcast(asked.withColumn("one", F.lit(0))), F.lit(0) == F.col("one"))  # 25 variants at most
        both = F.greatest(lexical.score_columns(F.col("kws"), F.col("bigrams"), F.col("normal")), lexical.loose_score(F.col("terms"), F.col("forms")))
        lexical_scores = lexical.best_over_variants(pairs.withColumn("lexical", both).withColumn("q", F.lit(0)), "q", "point_id", "lexical").drop("q")
        kept = kept.drop("normal", "forms").join(lexical_scores, "point_id")
        any_rows = F.coalesce(F.max((F.col("chunk_type") == "row_group").cast("int")).over(ranking.Window.partitionBy("question")), F.lit(0)) == 1
        cross = reranked(self.reranker, F.lit(question), F.col("text")) if self.reranker else None
        is_summary = F.coalesce(F.col("chunk_type") == "sheet_summary", F.lit(False))
        if cross is not None:
            kept = kept.withColumn("cross", cross)
        scored = kept.withColumn("score", ranking.blend(F.col("lexical"), F.col("idx"), is_summary, any_rows, F.col("cross") if cross is not None else None, self.settings))
        return ranking.diversify(scored, "question", top_n, self.settings).join(scored.drop("question", "rank"), "point_id").withColumnRenamed("pick", "rank")

    def search(self, question: str, conversation_id: str, top_n: int | None = None, source: str | None = None, raw_question: str | None = None, k: int | None = None, seen: list[str] | None = None) -> DataFrame:
        """The best chunks for a question: variants, vector hits, union, source filter, widening for sheets, rerank, confidence gate.

        ``raw_question`` adds the user's own words to a planner's; ``seen`` leaves out chunks by their ids.
        """
        s, n = self.settings, top_n or self.settings.top_n
        chunks = self.store.chunks(conversation_id)
        lang = self.language(question)
        asked = self.spark.createDataFrame([(question,)], "question string")
        variants = asked.select(F.posexplode(self._variants(question, raw_question, lang)).alias("query_id", "variant"))
        with self.stage(conversation_id, "retrieval"):
            hits = shared.kept(self.candidates(variants, chunks, k or s.top_k))
            if not hits.limit(1).count():
                variants = asked.select(F.lit(0).alias("query_id"), search.fallback_query(F.col("question")).alias("variant")).where("variant <> ''")
                hits = shared.kept(self.candidates(variants, chunks, k or s.top_k))
        if source is not None:
            hits = hits.where(F.col("source") == source)
        if hits.where("file_type = 'excel'").limit(1).count():
            n = max(n, s.top_n_sheets)
        with self.stage(conversation_id, "reranking"):
            ranked = ranking.confident(self.rerank(question, variants, hits, n), "question", "score", s.confidence)
            if seen:
                ranked = store.unseen_results(ranked, self.spark.createDataFrame([(x,) for x in seen], "point_id string"), "point_id")
            return ranked.select("point_id", "source", "page", "chunk_index", "document_id", "text", "score", "rank", *SHEET).withColumn("question", F.lit(question))

    def search_many(self, questions: DataFrame, source: str | None = None) -> DataFrame:
        """The best chunks for many questions (question_id, conversation_id, question) in one plan; see ``plans.batch.search_many``."""
        return batch.search_many(self.store, questions, self.settings, self.embedder, source)

    def language(self, question: str) -> str:
        return self.spark.range(1).select(T.detect_language(F.lit(question))).first()[0]

    # ---- answers

    def context(self, found: DataFrame) -> DataFrame:
        """``question, context`` of the ranked chunks that fit the budget, labelled and ruled off."""
        fitting = ranking.within_budget(found, "question", "rank", "text", self.settings.context_chars)
        label = T.chunk_label(F.col("rank"), F.col("source"), F.col("page"), F.col("file_type"), F.col("sheet_name"), F.col("chunk_type"), F.col("row_range"))
        return ranking.context(fitting.withColumn("label", label), "question", "rank", "label", "text")

    def _plain(self, found: DataFrame) -> str:
        """The texts that fit the budget, parted by blank lines."""
        fitting = ranking.within_budget(found, "question", "rank", "text", self.settings.context_chars)
        row = fitting.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("t")).first()
        return row["t"]

    def _one(self, c: Column) -> str:
        return self.spark.range(1).select(c).first()[0]

    def answer_prompt(self, question: str, found: DataFrame, lang: str, memory_text: str = "") -> str | None:
        """The prompt for an answer from chunks; None if there are none."""
        built = self.context(found).select(prompts.answer(F.lit(question), F.col("context"), F.lit(lang), F.lit(memory_text))).first()
        return built[0] if built else None

    def _clean(self, answer: str, lang: str) -> str:
        said = self.spark.createDataFrame([(0, answer, lang)], "i int, answer string, lang string")
        return ocr_text.clean_answers(said, "i", "answer", "lang").first()["answer"]

    def generate(self, question: str, found: DataFrame, lang: str, memory_text: str = "") -> str:
        """An answer from chunks, without repeated lines. The generator's errors are the caller's; they never become answers."""
        prompt = self.answer_prompt(question, found, lang, memory_text)
        return self._clean(self.generator.invoke(prompt), lang) if prompt else NO_DOCUMENTS[lang]

    def generate_stream(self, question: str, found: DataFrame, lang: str, memory_text: str = "") -> Iterator[str]:
        prompt = self.answer_prompt(question, found, lang, memory_text)
        yield from self.generator.stream(prompt) if prompt else [NO_DOCUMENTS[lang]]

    def summarize_stream(self, found: DataFrame, lang: str) -> Iterator[str]:
        yield from self.generator.stream(self._one(prompts.summary(F.lit(self._plain(found)), F.lit(lang))))

    def summarize(self, found: DataFrame, lang: str) -> str:
        return self.generator.invoke(self._one(prompts.summary(F.lit(self._plain(found)), F.lit(lang)))).strip()

    def compare_stream(self, question: str, found: DataFrame, lang: str) -> Iterator[str]:
        yield from self.generator.stream(self._one(prompts.comparison(F.lit(question), F.lit(self._plain(found)), F.lit(lang))))

    def compare(self, question: str, found: DataFrame, lang: str) -> str:
        return self.generator.invoke(self._one(prompts.comparison(F.lit(question), F.lit(self._plain(found)), F.lit(lang)))).strip()

    def answer_from_memory(self, question: str, memory_text: str, lang: str) -> str:
        return self._clean(self.generator.invoke(self._one(prompts.from_memory(F.lit(question), F.lit(memory_text), F.lit(lang)))), lang)

    def answer_from_memory_stream(self, question: str, memory_text: str, lang: str) -> Iterator[str]:
        yield from self.generator.stream(self._one(prompts.from_memory(F.lit(question), F.lit(memory_text), F.lit(lang))))

    def sources(self, found: DataFrame, answer: str = "") -> str:
        """The citation line of the chunks an answer rests on; none for an answer that says nothing was found."""
        if self._one(T.refuses(F.lit(answer))):
            return ""
        row = ranking.citations(ranking.within_budget(found, "question", "rank", "text", self.settings.context_chars), "question", "rank", "source", "page").first()
        return row["citation"] if row else ""

    def ask(self, question: str, conversation_id: str) -> dict:
        """``answer, sources, provider`` from the chunks that fit the context budget."""
        lang = self.language(question)
        found = shared.kept(self.search(question, conversation_id))  # top_n rows
        answer = self.generate(question, found, lang)
        return {"answer": answer, "sources": self.sources(found, answer), "provider": self.generator.provider}

    # ---- files

    def list_files(self, conversation_id: str | None = None) -> DataFrame:
        return store.files(self.store.read("registry"), conversation_id)

    def full_text(self, conversation_id: str, source: str) -> str:
        """A stored document's text, page after page."""
        pages = self._pages(conversation_id, source)
        row = files.full_text(pages, "source", "page").first()
        return row["text"] if row else ""

    def _pages(self, conversation_id: str, source: str) -> DataFrame:
        rows = self.store.chunks(conversation_id).where(F.col("source") == source)
        return files.page_texts(rows, "source", "page", "chunk_index", "text")

    def delete_document(self, document_id: str, conversation_id: str) -> int:
        return self.store.delete_document(document_id, conversation_id)

    def delete_conversation(self, conversation_id: str) -> int:
        """Registry rows removed; the conversation's facts go as well."""
        self.fact_files.delete(conversation_id)
        if self.facts.of("facts", conversation_id).limit(1).count():
            self.facts.replace("facts", self.spark.createDataFrame([], memory.FACTS), self.spark.createDataFrame([(conversation_id,)], "conversation_id string"))
        return self.store.delete_conversation(conversation_id)

    def reindex_document(self, document_id: str, conversation_id: str, path: str) -> int:
        chunks, registry = self._prepared(files.scan(self.spark, path, self.settings), conversation_id, document_id)
        return self.store.reindex(document_id, conversation_id, chunks, registry)

    # ---- reports

    def _report(self, pages: DataFrame, lang: str) -> dict[str, DataFrame]:
        maps = report.extracted(report.packed_pages(pages, "source", "page", "text", self.settings.report_slice_chars))
        maps = shared.kept(maps)
        made = {
            "sections": report.sections(maps, "source"), "items": report.capped(report.buckets(maps, "source")), "definitions": report.definitions(maps, "source"),
            "digest": report.digest(maps, "source", "slice_no", "section_title", "summary", self.settings.report_digest_chars), "narratives": report.narratives(maps, "source"), "extent": report.extents(pages, "source", "page"),
        }
        if not isinstance(self.generator, ExtractiveGenerator):
            made["narratives"] = self._narratives(made, lang)
        made["rendered"] = report.rendered(made["sections"], made["items"], made["narratives"], "source")
        return made

    def _narratives(self, made: dict[str, DataFrame], lang: str) -> DataFrame:
        """The generator's four parts in one request; empty where its answer cannot be read."""
        label, digest = made["digest"].first()
        points = "\n".join(f"- {r['item']}" for r in made["items"].where("section = 'key_points' and place <= 60").orderBy("place").collect())
        try:
            said = self.generator.invoke(self._one(prompts.narratives(F.lit(digest), F.lit(points), F.lit(label), F.lit(lang))))
        except Exception:
            said = ""
        row = self.spark.createDataFrame([(label, said)], "source string, said string").withColumn("v", T.salvage_json(F.col("said")))
        return row.select("source", *[F.coalesce(F.try_variant_get("v", f"$.{n}", "string"), F.lit("")).alias(n) for n in report.NARRATIVES])

    def report_data(self, conversation_id: str, source: str) -> dict[str, DataFrame]:
        """Everything a report on a whole stored document holds, by part. Raises if the document has no text."""
        pages = shared.kept(self._pages(conversation_id, source))
        sample = pages.agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.substring("text", 1, 2000).alias("t")))), lambda x: x["t"]), " "), 1, 2000)).first()[0]
        if not sample:
            raise ValueError(f"no text of {source} was found")
        return self._report(pages, self.language(sample))

    def topic_report_data(self, topic: str, conversation_id: str, source: str | None = None) -> dict[str, DataFrame]:
        """A report on what a conversation's documents say on a topic. Raises if that is too little."""
        if not topic.strip():
            raise ValueError("a report needs a topic")
        lang = self.language(topic)
        found = self.search(topic, conversation_id, TOPIC_CANDIDATES, source, k=TOPIC_CANDIDATES)
        found = ranking.relatively_relevant(found, "question", "score", 0.5, self.settings.confidence)
        found = shared.kept(found)
        if not found.limit(1).count() or not self._covered(topic, found, lang):
            raise ValueError(f"not enough on {topic!r} was found in the documents")
        place = F.row_number().over(ranking.Window.partitionBy("question").orderBy("rank"))
        pages = found.select(F.lit(topic).alias("source"), place.alias("page"), F.concat(F.lit("["), "source", F.lit("] "), "text").alias("text"), F.col("source").alias("file"))
        made = self._report(pages.drop("file"), lang)
        made["extent"] = report.extents(pages, "source", "page", "file")
        return made

    def _covered(self, topic: str, found: DataFrame, lang: str) -> bool:
        """A model's word on whether chunks are on a topic; without a model the confidence gate has decided already."""
        if isinstance(self.generator, ExtractiveGenerator):
            return True
        sample = "\n\n".join(r["t"] for r in found.where("rank <= 6").orderBy("rank").select(F.substring("text", 1, 500).alias("t")).collect())
        try:
            said = self.generator.invoke(self._one(prompts.topic_gate(F.lit(topic), F.lit(sample), F.lit(lang))))
        except Exception:
            said = None
        return bool(self._one(report.is_covered(F.lit(said).cast("string"))))

    def report(self, conversation_id: str, source: str) -> DataFrame:
        """``section, place, item`` of a stored document."""
        return self.report_data(conversation_id, source)["items"].select("section", "place", "item")

    def write_report(self, made: dict[str, DataFrame], topic: str | None = None, markdown: bool = False) -> str:
        """A report as a PDF object, or as Markdown; its path. Lists are capped, so its rows are few."""
        row = report.markdown(made["rendered"], "source", "source").select("source", "body", report.object_name(F.col("source"), F.lit(topic).cast("string")).alias("name")).first()
        if markdown:
            return self.objects.put(row["name"].removesuffix(".pdf") + ".md", row["body"].encode())
        parts = [(r["title"], r["body"]) for r in made["rendered"].orderBy("place").collect()]
        return self.objects.put(row["name"], pdf.report_pdf(row["source"], parts))

    # ---- memory and measures

    def remember(self, incoming: DataFrame, removed: DataFrame | None = None) -> None:
        """Merge new facts (``memory.FACTS``) into the stored ones of their conversations, after those that ``removed`` (conversation_id, text) names are gone."""
        memory.remember(self.facts, incoming, removed, self.settings)

    def remember_snapshots(self, rows: DataFrame, extract: Callable[[str], str], checkpoint: str) -> StreamingQuery:
        """Facts of a stream of ``streaming.memory.compacted`` rows, merged and stored batch by batch, each once."""
        from ..streaming.memory import remembered

        return remembered(rows, self.facts, extract, checkpoint, self.settings)

    def stored_facts(self, conversation_id: str) -> DataFrame:
        """A conversation's facts in order: the table's, or a fact file's where the table has none."""
        rows = self.facts.of("facts", conversation_id).drop("bucket")
        if not rows.limit(1).count() and self.fact_files.exists(conversation_id):
            found = files.fact_files(self.spark, f"{self.fact_files.objects.path}/{objects.safe_id(conversation_id)}.json")
            rows = found.select(F.lit(conversation_id).alias("conversation_id"), "pos", "text", "category", F.coalesce("importance", F.lit(3)).alias("importance"), F.col("updated_at").try_cast("timestamp").alias("updated_at"))
        return rows

    def memory_text(self, conversation_id: str, messages: DataFrame) -> str:
        """What a prompt is told of a conversation: its stored facts and its last messages (conv_id, turn, role, text)."""
        row = memory.rendered(self.stored_facts(conversation_id), "conversation_id", "pos", self.settings.fact_chars).first()
        facts = row["facts"] if row else ""
        row = memory.prompt_lines(messages.where(F.col("conv_id") == conversation_id), n=self.settings.prompt_messages).first()
        return self._one(prompts.memory_text(F.lit(facts), F.lit(row["prompt"] if row else "")))

    @contextlib.contextmanager
    def stage(self, request: str, name: str) -> Iterator[None]:
        """Measure a stage of a request; ``stage_events`` has the rows."""
        start = time.perf_counter()
        try:
            yield
        finally:
            self._events.append((request, name, (time.perf_counter() - start) * 1000))

    def stage_events(self) -> DataFrame:
        return self.spark.createDataFrame(self._events, "request_id string, name string, ms double")

    def profile(self, stages: DataFrame | None = None) -> DataFrame:
        return profile.stage_profile(stages if stages is not None else self.stage_events(), "request_id", "name", "ms")

    def register(self, prefix: str = "docspark_") -> None:
        """Temp views of chunks and registry, and the text functions, for SQL."""
        self.store.read("chunks").createOrReplaceTempView(f"{prefix}chunks")
        self.store.read("registry").createOrReplaceTempView(f"{prefix}registry")
        register_functions(self.spark)


    def health(self) -> dict[str, bool]:
        """Whether the store and the folder of objects can be reached."""
        try:
            self.objects.exists(".")
            objects_ = True
        except Exception:
            objects_ = False
        return {"store": self.store.ready(tries=1), "objects": objects_}


def register_functions(spark: SparkSession) -> None:
    """Splitters and the embedder for SQL: ``recursive_chunks(text, size, overlap)``, ``hash_embedding(text)``."""
    split = F.udf(lambda text, size, overlap: chunking.split_recursively(text or "", size, overlap), "array<string>", useArrow=True)
    spark.udf.register("recursive_chunks", split)
    spark.udf.register("hash_embedding", V.hash_embedding)


def new_conversation_id() -> str:
    return uuid.uuid4().hex


def new_session(secret: str) -> tuple[str, str]:
    """A new conversation's id and the token that proves it."""
    made = new_conversation_id()
    return made, tokens.sign(made, secret)
