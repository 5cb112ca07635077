"""Sum-of-squares online packing of tokenised documents into windows of a fixed length.

A document's ids fill whole windows first; what remains goes to the fill level h that makes the sum over levels of the squared
number of partially filled windows least, where opening a window is level 0. A level array holds these numbers. When a task's
documents end, the emptiest open windows are cut up to fill the gaps of the fullest, and the one window that may be left is cut
into windows whose lengths are powers of two, so nothing is padded. Each task packs the rows it reads, in one pass without a
shuffle; memory holds its open windows only. Sequence ids are the task's number times 2**40 plus a count.

Defined cases: a null or empty text is the end id alone; a text of any length is encoded whole and fills as many windows as it needs;
equal costs go to the fullest level; rows are packed one by one, so repeated rows each get their pieces; an empty table gives no
pieces; a null doc_id is carried along; only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import base64
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices, texts

WINDOW = 2048
END_ID = 1
MEMORY = 400_000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: The published split pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where white space meets so that cutting at single spaces could change a token.
MEETS = re.compile(r"\s \s|\s $")


class ByteBpe:
    """Ids of the byte-level vocabulary as little-endian 32-bit integers, with a memory of pieces between single spaces.

    Ranks come from the ``.tiktoken`` file, added tokens from the ``.json`` file of the same name beside it.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        with open(path.rsplit(".", 1)[0] + ".json", encoding="utf-8") as f:
            self.special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.encoder = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.asarray(self.encoder.encode_ordinary(text), "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        if len(self.known) >= MEMORY:
            self.known.clear()
        out = self.ids(" " + piece)
        if len(piece) <= 64:
            self.known[piece] = out
        return out

    def plain(self, text: str) -> bytes:
        if not text or MEETS.search(text):
            return self.ids(text)
        first, *rest = text.split(" ")
        known = self.known.get
        return self.ids(first) + b"".join([x if (x := known(p)) is not None else self.piece(p) for p in rest])

    def encode(self, text: str) -> np.ndarray:
        if not any(m in text for m in self.special):
            return np.frombuffer(self.plain(text), "<u4")
        parts = self.marks.split(text)
        return np.frombuffer(b"".join(np.array([self.special[x]], "<u4").tobytes() if x in self.special else self.plain(x) for x in parts), "<u4")


@lru_cache(1)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


class Piece:
    __slots__ = ("doc_id", "start", "ids", "doc_tokens")

    def __init__(self, doc_id: int | None, start: int, ids: np.ndarray, doc_tokens: int):
        self.doc_id, self.start, self.ids, self.doc_tokens = doc_id, start, ids, doc_tokens

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:at], self.doc_tokens), Piece(self.doc_id, self.start + at, self.ids[at:], self.doc_tokens)


class Packer:
    """Online packing of one task's documents; ``add`` and ``close`` return the windows that are complete."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)  # open windows by fill; 0 and full stay 0
        self.open: dict[int, list[list[Piece]]] = defaultdict(list)

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[list[Piece]]:
        n, done = len(ids), []
        whole = n - n % self.window
        for a in range(0, whole, self.window):
            done.append([Piece(doc_id, a, ids[a : a + self.window], n)])
        size = n - whole
        if not size:
            return done
        piece = Piece(doc_id, whole, ids[whole:].copy(), n)
        top = self.window - size
        after = self.level[size:]
        cost = 2 * (after - self.level[: top + 1] + 1)  # of moving one window from each level up by size
        cost[self.level[: top + 1] == 0] = np.iinfo(np.int64).max
        if self.level[top]:
            cost[top] = 1 - 2 * self.level[top]  # full windows do not count
        cost[0] = 2 * self.level[size] + 1
        h = top - int(np.argmin(cost[::-1]))
        content = [piece]
        if h:
            content = [*self.open[h].pop(), piece]
            self.level[h] -= 1
        if h + size == self.window:
            done.append(content)
        else:
            self.open[h + size].append(content)
            self.level[h + size] += 1
        return done

    def close(self) -> list[list[Piece]]:
        left = [(h, content) for h in sorted(self.open) for content in self.open[h]]
        self.open.clear()
        self.level[:] = 0
        done, low, spare = [], 0, []
        high = len(left) - 1
        while True:
            if not spare:
                if low > high:
                    break
                spare = left[low][1]
                low += 1
            if low > high:
                break
            fill, content = left[high]
            while fill < self.window and (spare or low < high):
                if not spare:
                    spare = left[low][1]
                    low += 1
                piece = spare.pop()
                if len(piece.ids) > self.window - fill:
                    piece, rest = piece.cut(self.window - fill)
                    spare.append(rest)
                content.append(piece)
                fill += len(piece.ids)
            high -= 1
            if fill < self.window:  # nothing is left to fill it with
                spare = content
            else:
                done.append(content)
        total = sum(len(p.ids) for p in spare)
        for power in reversed(range(total.bit_length())):
            if total >> power & 1:
                need, content = 1 << power, []
                while need:
                    piece = spare.pop(0)
                    if len(piece.ids) > need:
                        piece, rest = piece.cut(need)
                        spare.insert(0, rest)
                    content.append(piece)
                    need -= len(piece.ids)
                done.append(content)
        return done


def pack(docs: DataFrame, path: str, window: int = WINDOW, text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, packer = load(path), Packer(window)
        base, count = TaskContext.get().partitionId() << 40, 0
        end = np.array([END_ID], "<u4")

        def rows(done: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal count
            out: list[tuple] = []
            for content in done:
                offset = 0
                for p in content:
                    out.append((p.doc_id, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.doc_tokens, base + count, offset))
                    offset += len(p.ids)
                count += 1
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            names = [x.split()[0] for x in PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

        for batch in slices(batches, text):
            done = []
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), texts(batch, text), strict=True):
                done += packer.add(doc_id, np.concatenate([bpe.encode(x), end]))
            yield rows(done)
        yield rows(packer.close())

    return docs.select("doc_id", text).mapInArrow(run, PIECES)
