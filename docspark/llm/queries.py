"""The queries of this subpackage, each a thin use of its operator over a whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bin_slack, bpe, collocations, context_tree, exact_topk, html_text, near_dedup, packing, quality_model, quality_rules, secrets, suffix_dedup, whitening
from .common import read_table
from .sql import OP8, OP10, OP11

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: The vocabulary of byte_bpe_50k.json as ranks.
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_bpe(spark: SparkSession, sf_dir: str, path: str = WORD_TOKENIZER) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path).select("doc_id", "ids")
    out = bpe.decode(coded, path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _remainder(divisor: int) -> Column:
    """crc32 of the id as text, by ``divisor``; a null id counts like an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality_model.fit(docs, read_table(spark, sf_dir, "labels"), "quality", _remainder(5) != 0)
    scored = quality_model.score(docs, weights).select("doc_id", "score")
    return scored.select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score_documents(read_table(spark, sf_dir, "documents"))


def _is_base(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["base"] & (x["kind"] == kind)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.filter("spans", _is_base(k))).cast("long").alias(f"n_{k}") for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str, path: str = BYTE_TOKENIZER) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), path)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    removed = F.col("removed")
    return cut.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), suffix_dedup.total(removed).alias("n_removed"), F.size(removed).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.apply_rules(docs, ["doc_id"])


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op13_bin_slack(spark: SparkSession, sf_dir: str, path: str = WORD_TOKENIZER) -> DataFrame:
    pieces = bin_slack.pack(read_table(spark, sf_dir, "documents"), path, digests={"ids_crc32": F.crc32("ids")})
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline; the pieces that its packing makes."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_quality_model": op2_quality_model,
        "op3_context_tree": op3_context_tree,
        "op4_secrets": op4_secrets,
        "op5_near_dedup": op5_near_dedup,
        "op6_packing": op6_packing,
        "op7_html_text": op7_html_text,
        "op8_exact_topk": op8_exact_topk,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_quality_rules": op10_quality_rules,
        "op11_collocations": op11_collocations,
        "op12_whitening": op12_whitening,
        "op13_bin_slack": op13_bin_slack,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_exact_topk": OP8, "op10_quality_rules": OP10, "op11_collocations": OP11}
