"""Search for many questions of many conversations in one plan: questions are rows throughout, and the driver runs no job for any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as T
from ..operators import dedupe, lexical, ranking, search, shared
from ..operators.store import ChunkStore
from ..plugins import Embedder, embedding

#: Parts a conversation from a chunk's id, and a question from its variant's number.
MARK = "\x1f"
CARRIED = ["source", "page", "chunk_index", "document_id", "text", "file_type", "chunk_type", "sheet_name", "row_range"]


def asked_variants(questions: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """``question_id, conversation_id, place, variant``: the forms of each question, each once whatever its case."""
    forms = dedupe.fold_case_dedupe(search.variants(F.col("question"), settings))
    return questions.select(F.col("question_id").cast("string").alias("question_id"), "conversation_id", F.posexplode(forms).alias("place", "variant"))


def conversations(chunk_store: ChunkStore, questions: DataFrame) -> DataFrame:
    """The chunks of the conversations that are asked; buckets that none of them is in are pruned as the plan runs."""
    wanted = questions.select("conversation_id").distinct().withColumn("bucket", chunk_store.bucket(F.col("conversation_id")))
    return chunk_store.read("chunks").join(wanted, ["bucket", "conversation_id"], "left_semi")


def search_many(chunk_store: ChunkStore, questions: DataFrame, settings: Settings = DEFAULTS, embedder: Embedder | None = None, source: str | None = None) -> DataFrame:
    """``question_id, point_id, rank, score`` and the chunk's columns: the best chunks of each question's own conversation.

    questions: question_id, conversation_id, question[, the column that ``source`` names: the file to stay in]. As ``Engine.search`` without a
    rewriter and a reranker: variants, vector hits within the conversation, union, source filter, lexical scores, diversification with more
    results where sheets were hit, and the confidence gate.
    """
    s = settings
    asked = shared.kept(asked_variants(questions, s))
    chunks = conversations(chunk_store, questions)
    name = F.concat("conversation_id", F.lit(MARK), T.chunk_id(F.col("source"), F.col("page"), F.col("chunk_index"), F.col("text")))
    points = shared.kept(chunks.select(name.alias("point_id"), F.col("embedding").alias("vector"), "conversation_id", *CARRIED))
    number = F.concat("question_id", F.lit(MARK), F.format_string("%04d", "place"))
    vectors = asked.select(number.alias("query_id"), embedding(embedder, F.col("variant"), queries=True).alias("vector"), "conversation_id")
    hits = search.top_k(vectors, points, s.top_k, "conversation_id").join(points.drop("conversation_id"), "point_id")
    order = F.concat(F.element_at(F.split("query_id", MARK), -1), F.format_string("%06d", "rank"))
    hits = hits.withColumns({"question_id": F.substring_index("query_id", MARK, 1), "order": order})
    hits = dedupe.hit_dedupe(hits, "text", "source", "page", "order", "question_id").drop("query_id", "score", "rank", "order")
    if source is not None:
        hits = hits.join(questions.select(F.col("question_id").cast("string").alias("question_id"), F.col(source).alias("_only")), "question_id").where(F.col("_only").isNull() | (F.col("source") == F.col("_only"))).drop("_only")
    kept = shared.kept(hits.where(T.is_meaningful(F.col("text"))))

    body = F.col("variant")
    terms = asked.select("question_id", T.keywords(body, T.detect_language(body)).alias("kws"), T.ngrams(T.words(T.normalize(body))).alias("bigrams"), lexical.loose_terms(body).alias("terms"))
    forms = kept.select("question_id", "point_id", T.normalize(F.col("text")).alias("normal"), lexical.loose_forms(F.col("text")).alias("forms"))
    both = F.greatest(lexical.score_columns(F.col("kws"), F.col("bigrams"), F.col("normal")), lexical.loose_score(F.col("terms"), F.col("forms")))
    scores = lexical.best_over_variants(forms.join(terms, "question_id").withColumn("lexical", both), "question_id", "point_id", "lexical")
    own = Window.partitionBy("question_id")
    has = lambda c: F.coalesce(F.max(c.cast("int")).over(own), F.lit(0)) == 1
    scored = kept.join(scores, ["question_id", "point_id"]).withColumns({"_rows": has(F.col("chunk_type") == "row_group"), "_sheets": has(F.col("file_type") == "excel")})
    final = ranking.blend(F.col("lexical"), F.col("idx"), F.coalesce(F.col("chunk_type") == "sheet_summary", F.lit(False)), F.col("_rows"), None, s)
    scored = shared.kept(scored.withColumn("score", final).drop("_rows", "lexical"))
    plain, sheets = (ranking.diversify(scored.where(x), "question_id", n, s) for x, n in ((~F.col("_sheets"), s.top_n), (F.col("_sheets"), max(s.top_n, s.top_n_sheets))))
    best = plain.unionByName(sheets).join(scored, ["question_id", "point_id"]).withColumnRenamed("pick", "rank")
    gated = ranking.confident(best, "question_id", "score", s.confidence)
    return gated.select("question_id", F.element_at(F.split("point_id", MARK), -1).alias("point_id"), "rank", "score", *CARRIED)
