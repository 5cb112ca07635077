"""Phrase collocations: which neighbouring words belong together more than their own counts would have it.

N-grams are exploded into rows and hash-aggregated per language, level by level. Every occurrence of a phrase is one of its first
n - 1 and one of its last n - 1 words, so an n-gram is exploded only where both of these reach the least count; a filter over their
keys says so. The filter may let others through, which costs rows on the way and never a count. Candidates meet the counts of the two
sides of each cut in joins, are scored in Decimal, lose those that a one-word extension covers (a longer phrase over the limit has an
extension of one word over it, too), and are ranked in a window per language.

Rows are counted once inside each slice of texts before they are shuffled, so the commonest word of the commonest language sends one
row a slice; the ranking keeps the best of each task before its shuffle.

Defined cases: a null text is empty; an empty text has no words; texts of any length are read whole, each at once; languages that are
null are one, ``und``; phrases that tie by score and count are ranked by their bytes; repeated rows count each; an empty table gives
no rows; only text and language are read, so no other column can clash. Decimals have 38 digits: counts may reach 10**16.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, slices
from .suffix_dedup import key_filter, passes

#: What ends a piece, what parts words inside a piece, and the language of rows without one.
BREAKS, GAPS, NO_LANG = ".,;:!?\n\x0b\x0c\r", " \t", "und"
MIN_COUNT, MAX_WORDS, COVERED_PERCENT, MOST, SCALE = 10, 3, 50, 2000, 1_000_000
#: Bytes of text whose rows are counted together before they leave a task, and rows of a batch that leaves it.
SLICE, ROWS = 1 << 20, 1 << 14
#: Bytes of an Arrow batch of texts on its way to the counting step; the default's ten thousand rows are tens of megabytes, on both sides.
BATCH = str(4 << 20)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)
_KIND[list(GAPS.encode())] = 1
_KIND[list(BREAKS.encode())] = 2
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
COUNTS = "lang string, phrase string, n long"


def _strings(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))


class Words:
    """The words of some texts: the distinct ones, and for each place its word's code, its piece and its text."""

    def __init__(self, texts: pa.Array):
        texts = pa.concat_arrays([pc.fill_null(texts, "")])
        ends = np.append(0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))).astype(np.int64)
        raw = texts.buffers()
        first = np.frombuffer(raw[1], np.int32)[texts.offset] if len(texts) else 0
        data = _LOWER[np.frombuffer(raw[2], np.uint8)[first : first + ends[-1]]] if len(texts) and raw[2] else np.empty(0, np.uint8)
        kind = _KIND[data]
        inside = kind == 0
        edge = np.zeros(len(data) + 1, bool)  # where a text begins or ends, a word does so too
        edge[ends] = True
        start = np.flatnonzero(inside & (edge[:-1] | np.append(True, ~inside[:-1])[: len(data)]))
        end = np.flatnonzero(inside & (edge[1:] | np.append(~inside[1:], True)[: len(data)])) + 1
        self.text = np.searchsorted(ends, start, "right") - 1
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), start) + self.text
        found = _strings(data[inside], end - start).dictionary_encode()
        self.code, self.words = found.indices.to_numpy().astype(np.int64), found.dictionary

    def keys(self, lang: np.ndarray, most: int) -> list[np.ndarray]:
        """64-bit keys of the 1- to ``most``-grams that begin at each place, given the hash of each text's language."""
        own = hashes(self.words)[self.code] if len(self.code) else np.empty(0, np.uint64)
        out = [_mixed(own ^ lang[self.text])]
        for n in range(1, most):
            out.append(_mixed(out[-1][:-1] * _MIX + own[n:]))
        return out

    def together(self, n: int) -> np.ndarray:
        """Whether the n words from each place on are in one piece."""
        return self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1] if len(self.piece) >= n else np.empty(0, bool)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _MIX
    return x ^ x >> np.uint64(29)


def hashes(strings: pa.Array) -> np.ndarray:
    """A polynomial in the bytes of each string, mixed; keys for a filter, never an identity."""
    if not len(strings):
        return np.empty(0, np.uint64)
    sizes = pc.binary_length(strings).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.append(0, np.cumsum(sizes))
    first = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset]
    data = np.frombuffer(strings.buffers()[2] or b"", np.uint8)[first : first + ends[-1]].astype(np.uint64)
    powers = np.empty(int(sizes.max(initial=0)) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = _ODD
    powers = np.multiply.accumulate(powers)
    place = np.arange(len(data)) - np.repeat(ends[:-1], sizes)
    total = np.append(np.uint64(0), np.cumsum((data + np.uint64(1)) * powers[place], dtype=np.uint64))
    return _mixed(total[ends[1:]] - total[ends[:-1]])


def _lang(batch: pa.RecordBatch) -> pa.Array:
    return pc.fill_null(batch.column("lang"), NO_LANG)


def _exploded(n: int, sent: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of n-grams with their counts within a slice; for single words also one row without phrase per language, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            langs = _lang(batch).dictionary_encode()
            words = Words(batch.column("text"))
            good = words.together(n)
            if sent is not None and len(good):
                known = passes(sent.value, words.keys(hashes(langs.dictionary)[langs.indices.to_numpy()], n - 1)[-1])
                good &= known[:-1] & known[1:]
            at = np.flatnonzero(good)
            lang = langs.indices.to_numpy()[words.text[at]] if len(at) else np.empty(0, np.int32)
            names = [f"w{i}" for i in range(n)]
            grams = pa.table([pa.array(lang), *[pa.array(words.code[at + i]) for i in range(n)]], ["lang", *names])
            grams = grams.group_by(["lang", *names], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            parts = [words.words.take(grams.column(c).combine_chunks()) for c in names]
            phrase = pc.binary_join_element_wise(*parts, " ") if n > 1 else parts[0]
            which, count = grams.column("lang").combine_chunks(), grams.column("count_all").combine_chunks()
            if n == 1:
                totals = np.bincount(lang, minlength=len(langs.dictionary))
                which = pa.concat_arrays([which, pa.array(np.arange(len(totals), dtype=np.int32))])
                phrase, count = pa.concat_arrays([phrase, pa.nulls(len(totals), pa.string())]), pa.concat_arrays([count, pa.array(totals)])
            for a in range(0, len(count), ROWS):
                some = [x.slice(a, ROWS) for x in (which, phrase, count)]
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(some[0]), some[1], some[2].cast(pa.int64())], ["lang", "phrase", "n"])

    return run


def _keyed(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The filter's keys of phrases of n words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column("phrase"))
            key = words.keys(hashes(batch.column("lang")), n)[-1][::n] if batch.num_rows else np.empty(0, np.uint64)
            # phrases follow each other n words by n words, so every n-th place begins one
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], ["key"])

    return run


def phrase_counts(docs: DataFrame, most: int = MAX_WORDS, least: int = MIN_COUNT, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, phrase, size, n`` of all phrases of up to ``most`` words that occur ``least`` times; the null phrase counts a language's words."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sent, out = None, None
    for n in range(1, most + 1):
        grams = rows.mapInArrow(_exploded(n, sent), COUNTS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        level = materialise(grams.where((F.col("n") >= least) | F.col("phrase").isNull()).select("lang", "phrase", F.lit(n).alias("size"), "n"), batch=BATCH)
        if n < most:
            sent = docs.sparkSession.sparkContext.broadcast(key_filter(level.where("phrase is not null").select("lang", "phrase").mapInArrow(_keyed(n), "key long")))
        out = level if out is None else out.unionByName(level)
    return out


def collocations(docs: DataFrame, most: int = MAX_WORDS, least: int = MIN_COUNT, first: int = MOST, covered: int = COVERED_PERCENT, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's ``first`` best phrases of 2 to ``most`` words."""
    counts = phrase_counts(docs, most, least, text, lang)
    known = counts.where("phrase is not null")
    totals = counts.where("phrase is null").select("lang", "n")
    candidates = known.where("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"))
    words = F.split("phrase", " ")
    part = lambda start, size: F.array_join(F.slice(words, start, size), " ")
    k = F.col("k")

    # a phrase that an extension of one word covers to the given percentage goes
    longer = candidates.where("size > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"), F.col("a").alias("longer"))
    longer = longer.groupBy(F.col("lang").alias("of"), F.col("phrase").alias("inner")).agg(F.max("longer").alias("longer"))
    wide = lambda x: F.col(x).cast("decimal(38,0)")
    kept = candidates.join(longer, (F.col("lang") == F.col("of")) & (F.col("phrase") == F.col("inner")) & (100 * wide("longer") >= covered * wide("a")), "left_anti")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), k).alias("head"), part(k + 1, F.col("size") - k).alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    score = F.expr(f"(cast({SCALE} as decimal(7,0)) * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
