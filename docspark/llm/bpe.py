"""BPE encoding and decoding with a published vocabulary whose words carry an end mark.

A word's symbols form a doubly linked list; a priority queue holds the merge rank of each adjacent pair; entries whose
symbols have changed meanwhile are stale and skipped. Decoding joins the vocabulary strings of the ids.

Defined cases: a null text encodes like an empty one, to no ids, and decodes to an empty text; texts and words of any length are
encoded whole; of equal ranks the leftmost pair merges first; rows are independent of each other, so repeated rows repeat and an
empty table stays empty; input columns named like an output are replaced, others are carried along.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices, texts

#: Words kept per Python worker with their ids; beyond that the memory is cleared and filled anew.
MEMORY = 400_000
#: White space as the tokenizer's patterns see it; Python's own adds U+001C to U+001F.
GAP = r"\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: What Python takes for white space and the tokenizer does not.
ODD = "\x1c\x1d\x1e\x1f"


#: Letters and digits that Unicode 16 added to 15.1, as first and last; the tokenizer's patterns know these, and no later ones.
UNICODE_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x113D3), (0x11BC0, 0x11BF9),
    (0x116D0, 0x116E3), (0x13460, 0x143FA), (0x16100, 0x16139), (0x16D40, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5FA),
]
#: Capitals that Unicode 16 and 17 added, as first, last and the small letter of the first.
CAPITALS = [(0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB)]


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Tokenizer file with lower-casing, pattern split, byte letters and an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.merges = {(self.vocab[a], self.vocab[b]): (rank, self.vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.letters = byte_letters()
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.split = regex.compile(split.replace(r"\s", GAP))
        self.gap = regex.compile(f"[{GAP}]+")
        # letters and digits that this pattern engine knows and the tokenizer's older tables do not: signs, as any unassigned code point
        known = {c for a, b in UNICODE_16 for c in range(a, b + 1)}
        self.small = {a + i: small + i for a, b, small in CAPITALS for i in range(b - a + 1) if unicodedata.category(chr(a + i)) == "Cn"}
        self.capitals = regex.compile("[" + "".join(map(chr, self.small)) + "]") if self.small else None
        unassigned = "".join(c for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000 and i not in known and unicodedata.category(c := chr(i)) == "Cn")
        self.novel = dict.fromkeys(map(ord, regex.findall(r"[\p{L}\p{N}]", unassigned)), 0xE000)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.known: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Merge adjacent symbols in order of rank, the leftmost first among equals."""
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found[0], i, pair[0], pair[1], found[1]) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (found := merges.get(pair))]
        heapq.heapify(queue)
        while queue:
            _, i, left, right, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((made, ids[k])):
                    heapq.heappush(queue, (found[0], i, made, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], made))):
                heapq.heappush(queue, (found[0], h, ids[h], made, found[1]))
        return [x for x in ids if x >= 0]

    def word(self, word: str) -> list[int]:
        letters = [self.letters[b] for b in word.encode()]
        letters[-1] += self.suffix
        return self.merge([i for x in letters if (i := self.vocab.get(x)) is not None])

    def chunk(self, chunk: str) -> bytes:
        """Ids of a text without white space, as little-endian 32-bit integers."""
        seen = chunk if chunk.isascii() else chunk.translate(self.novel)
        words = self.split.findall(chunk) if seen == chunk else [chunk[m.start() : m.end()] for m in self.split.finditer(seen)]
        ids = [i for w in words for i in self.word(w)]
        if len(self.known) >= MEMORY:
            self.known.clear()
        out = np.array(ids, "<i4").tobytes()
        if len(chunk) <= 64:
            self.known[chunk] = out
        return out

    def chunks(self, text: str) -> list[str]:
        """The text in its normal form, parted at white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            if self.capitals and self.capitals.search(text):
                text = text.translate(self.small)
        text = text.lower()
        return [c for c in self.gap.split(text) if c] if any(x in text for x in ODD) else text.split()

    def plain(self, text: str) -> bytes:
        known = self.known.get
        return b"".join([x if (x := known(c)) is not None else self.chunk(c) for c in self.chunks(text)])

    def encode(self, text: str) -> bytes:
        if "<|" not in text:
            return self.plain(text)
        return b"".join(np.array([self.special[x]], "<i4").tobytes() if x in self.special else self.plain(x) for x in self.marks.split(text))

    def decoder(self) -> pa.Array:
        """Vocabulary strings by id, null where an id has none."""
        return pa.array([self.strings.get(i) for i in range(max(self.strings) + 1)], pa.string())


@lru_cache(2)
def load(path: str) -> WordBpe:
    return WordBpe(path)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c != name]
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], values], [*names, name])


def _schema(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in df.schema.fields if f.name != name], T.StructField(name, kind)])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the array of token ids of each whole text; one pass over the rows, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in slices(batches, text):
            found = [bpe.encode(x) for x in texts(batch, text)]
            ends = np.cumsum([0, *[len(x) // 4 for x in found]], dtype=np.int64)
            values = pa.array(np.frombuffer(b"".join(found), "<i4"))
            yield _with(batch, ids, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values))

    return df.mapInArrow(run, _schema(df, ids, T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded", most: int = 8 << 20) -> DataFrame:
    """Add the text of each array of ids: their vocabulary strings joined by one space, special tokens included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = load(path).decoder()
        for batch in batches:
            lists = pc.fill_null(pc.list_value_length(batch.column(ids)), 0).to_numpy(zero_copy_only=False)
            part = np.cumsum(lists, dtype=np.int64) // most
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                ends = np.concatenate([[0], np.cumsum(lists[a:b])])
                words = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), strings.take(piece.column(ids).flatten()))
                yield _with(piece, decoded, pc.binary_join(words, " "))

    return df.mapInArrow(run, _schema(df, decoded, T.StringType()))
