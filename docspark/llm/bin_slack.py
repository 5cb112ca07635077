"""Best-fit packing by minimum bin slack.

A document's ids are cut into pieces of the window's length, of which the last may be shorter. How pieces are packed depends on their
lengths alone, so what is planned is the histogram of lengths, one count for each length up to the window, whatever the number of
documents. For each bin, the longest piece left is taken and a subset-sum dynamic program over bitsets finds the fullest combination
of the lengths still available to go with it, which is then removed; as long as the same lengths last, the same combination stays
the fullest, so it is removed as often as it can be, and a plan has some thousand steps at most. Pieces are then numbered
within their length and find their sequence and place by that number.

Numbers within a length come from counts per task and length: each task numbers its own pieces as it cuts them, and what the tasks
before it hold of that length is added in a join by (task, length), so a length that a third of all pieces have is no hot key.

Defined cases: a null or empty text is the end id alone; a text of any length is encoded whole and cut; pieces of equal length are
taken in the order of tasks and rows; repeated rows each get their pieces; a null id is carried along; an empty table gives no
pieces; columns that ``pack`` is asked to keep travel in a struct, so that no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WordBpe
from .common import materialise, slices, texts

WINDOW, END_ID = 2048, 0
#: Chunks of text kept per Python worker with their ids.
MEMORY = 600_000
#: Bytes of text encoded at once.
SLICE = 4 << 20
#: Signs that follow words; any run of them is a word of its own.
SIGNS = ".,;:!?\"')]}#*$%&"
#: Ends a word in the merger's alphabet; a byte that no text in UTF-8 has as a character of its own is not at hand, so words that hold it are merged plainly.
END = "\x01"
PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, place long"


class BatchedWords(WordBpe):
    """Ids of many texts at once: chunks that are new to the worker go to a compiled merger together.

    That merger joins any two neighbours that make up a vocabulary entry, where this vocabulary asks for a certain pair. Both come to
    the same if each entry, merged alone, becomes itself in the end: the last two parts it then has are the only two it can be
    made of. That is tried for each entry; if one fails, all words are merged plainly.
    """

    def __init__(self, path: str):
        super().__init__(path)
        end = self.suffix
        byte = {x: bytes([b]) for b, x in enumerate(self.letters)}
        ranks, plain = {}, bool(end)
        for entry, i in self.vocab.items():
            if i in self.special.values():
                continue
            body = entry.removesuffix(end) if end else entry
            symbols = list(body)
            if not body or any(x not in byte for x in symbols):
                plain = False
                continue
            if body != entry:
                symbols[-1] += end
            plain = plain and self.merge([self.vocab[x] for x in symbols]) == [i]
            ranks[b"".join(byte[x] for x in body) + (END.encode() if body != entry else b"")] = i
        # ranks are ids: the order of merges has to be that of ids, and the single symbols with an end mark come before all others
        order = [made for _, made in sorted(self.merges.values())]
        self.merger = None
        if plain and order == sorted(order) and len(set(order)) == len(order) and all(self.vocab.get(x + end, order[0]) < order[0] for x in byte):
            self.merger = tiktoken.Encoding("words", pat_str=f"[^{END}]*{END}", mergeable_ranks=ranks, special_tokens={})
        self.last = np.zeros(max(self.strings) + 1, bool)
        self.last[[i for s, i in self.vocab.items() if end and s.endswith(end)]] = True

    def words(self, chunk: str) -> list[str]:
        core = chunk.rstrip(SIGNS)  # letters, then signs: the common case needs no pattern
        if core.isalpha():
            return [core] if len(core) == len(chunk) else [core, chunk[len(core) :]]
        seen = chunk if chunk.isascii() else chunk.translate(self.novel)
        return self.split.findall(chunk) if seen == chunk else [chunk[m.start() : m.end()] for m in self.split.finditer(seen)]

    def learn(self, chunks: list[str]) -> None:
        """Put the ids of new chunks into the memory."""
        words = [self.words(c) for c in chunks]
        if self.merger is None or any(END in c for c in chunks):
            self.known.update((c, np.array([i for w in ws for i in self.word(w)], "<u4").tobytes()) for c, ws in zip(chunks, words, strict=True))
            return
        ids = np.array(self.merger.encode_ordinary(END.join([w for ws in words for w in ws] + [""])), "<u4")
        ends = np.append(0, np.flatnonzero(self.last[ids]) + 1)[np.cumsum([0, *map(len, words)])]
        raw = ids.tobytes()
        self.known.update((c, raw[4 * a : 4 * b]) for c, a, b in zip(chunks, ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    def encode_all(self, many: list[str]) -> list[bytes]:
        out: list[bytes | None] = [self.encode(x) if "<|" in x else None for x in many]
        split = [[] if y is not None else self.chunks(x) for x, y in zip(many, out, strict=True)]
        new = set().union(*split) - self.known.keys()
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            new = set().union(*split)
        self.learn(list(new))
        return [b"".join(map(self.known.__getitem__, chunks)) if y is None else y for chunks, y in zip(split, out, strict=True)]


@lru_cache(1)
def load(path: str) -> BatchedWords:
    return BatchedWords(path)


def cut(docs: DataFrame, path: str, window: int = WINDOW, text: str = "text", end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (little-endian 32-bit), the task that cut it and its number there among pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = load(path), TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, text, SLICE):
            ids = [x + end for x in bpe.encode_all(texts(batch, text))]
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            count = -(-sizes // window)
            owner = np.repeat(np.arange(len(ids)), count)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            length = np.minimum(window, sizes[owner] - piece * window)
            order = np.argsort(length, kind="stable")
            run_start = np.flatnonzero(np.append(True, np.diff(length[order]) != 0)) if len(order) else np.empty(0, np.int64)
            within = np.arange(len(order)) - np.repeat(run_start, np.diff(np.append(run_start, len(order))))
            place = np.empty(len(order), np.int64)
            place[order] = within
            place += seen[length]
            np.add.at(seen, length, 1)
            raw = pa.array([ids[o][4 * window * p : 4 * window * (p + 1)] for o, p in zip(owner.tolist(), piece.tolist(), strict=True)], pa.binary())
            columns = [batch.column("doc_id").cast(pa.int64()).take(pa.array(owner)), piece.astype(np.int32), piece * window, length, raw, np.full(len(owner), part, np.int32), place]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select("doc_id", text).mapInArrow(run, PIECES)


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """The lengths, and how often each, that fill ``room`` best: bit t of ``reach`` says that some of the lengths seen so far add up to t.

    Lengths are added from the longest; the search ends early once the room can be filled whole. Of fillings that are equally full,
    the one with the fewest short pieces is taken.
    """
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for size in (np.flatnonzero(counts[1 : room + 1])[::-1] + 1).tolist():
        steps.append((size, reach))
        left, block = min(int(counts[size]), room // size), 1
        while left:  # copies in blocks of 1, 2, 4, ... and the rest
            block = min(block, left)
            reach |= reach << size * block & mask
            left, block = left - block, 2 * block
        if reach >> room & 1:
            break
    target, out = reach.bit_length() - 1, []
    for size, before in reversed(steps):
        n = 0
        while not before >> target & 1:
            target -= size
            n += 1
        if n:
            out.append((size, n))
    return out


def plan(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """How often each combination of lengths is used, from counts by length; together the combinations use up all counts."""
    counts, out = counts.copy(), []
    while (left := np.flatnonzero(counts)).size:
        longest = int(left[-1])
        counts[longest] -= 1
        rest = dict(fullest(counts, len(counts) - 1 - longest))
        counts[longest] += 1
        rest[longest] = rest.get(longest, 0) + 1
        times = min(int(counts[size]) // n for size, n in rest.items())
        for size, n in rest.items():
            counts[size] -= n * times
        out.append((times, sorted(rest.items(), reverse=True)))
    return out


class Places:
    """Sequence and offset of the i-th piece of a length."""

    def __init__(self, steps: list[tuple[int, list[tuple[int, int]]]], window: int):
        rows: list[list[tuple[int, ...]]] = [[] for _ in range(window + 1)]
        used, sequence = [0] * (window + 1), 0
        for times, parts in steps:
            offset = 0
            for size, n in parts:
                rows[size].append((used[size], sequence, n, offset))
                used[size] += n * times
                offset += size * n
            sequence += times
        self.by_length = {size: np.array(x, np.int64).T for size, x in enumerate(rows) if x}
        self.sequences = sequence

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for size in np.unique(length).tolist():
            at = np.flatnonzero(length == size)
            first, base, n, start = self.by_length[size]
            row = np.searchsorted(first, number[at], "right") - 1
            i = number[at] - first[row]
            sequence[at], offset[at] = base[row] + i // n[row], start[row] + i % n[row] * size
        return sequence, offset


def assign(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a written table of pieces with ``length``, ``part`` and ``place``."""
    spark, names = pieces.sparkSession, [c for c in pieces.columns if c not in ("part", "place")]
    held = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("held")))
    counts = np.zeros(window + 1, np.int64)
    for row in held.groupBy("length").agg(F.sum("held").alias("n")).collect():  # one row per length, ``window`` at most
        counts[row["length"]] = row["n"]
    sent = spark.sparkContext.broadcast(Places(plan(counts), window))  # by lengths and steps, whatever the number of pieces
    before = F.sum("held").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = held.select(F.col("part").alias("of"), F.col("length").alias("size"), F.coalesce(before, F.lit(0)).alias("base"))
    rows = pieces.select(F.struct(*names).alias("row"), "length", "part", "place")
    joined = rows.join(bases, (F.col("part") == F.col("of")) & (F.col("length") == F.col("size")))
    numbered = joined.select("row", "length", (F.col("place") + F.col("base")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = sent.value.find(batch.column("length").to_numpy(), batch.column("number").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sequence), pa.array(offset)], ["row", "sequence_id", "offset"])

    kind = numbered.schema["row"].dataType.simpleString()
    return numbered.mapInArrow(run, f"row {kind}, sequence_id long, offset long").select("row.*", "sequence_id", "offset")


def pack(docs: DataFrame, path: str, window: int = WINDOW, text: str = "text", digests: dict[str, Column] | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids, sequence_id, offset; with ``digests`` these columns stand in place of the ids."""
    pieces = cut(docs, path, window, text)
    carried = ["ids"] if digests is None else [c.alias(name) for name, c in digests.items()]
    return assign(materialise(pieces.select("doc_id", "piece", "start", "length", *carried, "part", "place")), window)
