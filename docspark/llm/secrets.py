"""Secret scans over every layer that a text wraps: a worklist of decoded layers, each scanned anew, with spans mapped back.

A layer is the text itself; the text with its percent escapes resolved in place, also with the plus signs of form-coded runs as spaces;
with its Unicode, octal or named escapes resolved; without the NULs that UTF-16 puts between letters; or what a base64 run holds, be it
text or not (bytes that are no UTF-8 become U+FFFD), also over line breaks and from the middle of a run. Bytes that are gzip, zlib, bz2
or xz streams are decompressed, from base64 as well as from escapes or where a text holds them as characters below U+0100; a
base64 run that is a raw deflate stream from end to end is, too. Each layer carries the span of the original text behind each of its
characters; what a stream holds has the stream's span as a whole, and one character per byte, so streams inside it are found again.
The list ends at the fixpoint: a layer that was seen before with the same spans behind it is not taken up again; equal layers at
other places are. Layers are made one at a time, as the list comes to them.

Defined cases: a null text is empty and holds nothing; equal spans found in several layers count once, the base layer's first;
rows are independent, so repeated rows repeat and an empty table stays empty; an input column named ``spans`` is replaced, others are
carried along; texts of any length are read whole.
Compressed data of any size is read in pieces of ``PIECE`` bytes that overlap by ``OVERLAP``, so memory is bounded; streams count as
far as their checksums hold. Guards: ``NESTED`` compressed layers inside each other end a stream made to grow without end, ``CHAIN`` of
them if each holds over ``PIECE`` bytes; what is longer than ``OVERLAP`` inside such a stream (a run in base64) may be cut between pieces.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, texts

KINDS = ("assign", "access", "hex")
PIECE, OVERLAP, NESTED, CHAIN = 8 << 20, 1 << 20, 4096, 64
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("depth", T.IntegerType())]))

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
WORDS = ("passw", "secret", "token", "apikey", "api_key")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
PLUS = re.compile(r"\+|(?:%[0-9A-Fa-f]{2})+")
FORM = re.compile(r"[^\s\"'<>]+")
UNICODE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|%[uU]([0-9A-Fa-f]{4})|&#[xX]([0-9A-Fa-f]{1,6});"
    r"|\\([0-3][0-7]{2})|&#([0-9]{1,7});|&([A-Za-z][A-Za-z0-9]{1,31};)|\\([nrt0abfv\\'\"])"
)
#: A run goes on over a line break, and white space after it, if base64 takes the next line up to its end or a closing mark.
BASE64 = re.compile(r"""[A-Za-z0-9+/_-]{16,}+(?:\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++(?=={0,2}[\x20\t]*+(?:["'`<)\]},;]|\r?\n|\Z)))*+={0,2}""")
LINE = re.compile(r"[A-Za-z0-9+/_=-]+")
PIECES = (re.compile(r"[A-Za-z0-9+]{16,}"), re.compile(r"[A-Za-z0-9+/]{16,}"), re.compile(r"[A-Za-z0-9_-]{16,}"))
STANDARD = str.maketrans("-_", "+/")
#: Starts of gzip, zlib, bz2 and xz streams.
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00")
#: The same in characters, for a quick look and for all places.
STARTS = ("\x1f\x8b\x08", "x\x01", "x^", "x\x9c", "x\xda", "BZh", "\xfd7zXZ")
BYTES = re.compile("[\0-\xff]{8,}")
#: Plain escapes, which bytes written out have beside \x.
PLAIN = {"n": "\n", "r": "\r", "t": "\t", "0": "\0", "a": "\a", "b": "\b", "f": "\f", "v": "\v", "\\": "\\", "'": "'", '"': '"'}
#: Bytes without any of these hold no secret and no further layer.
MATTERS = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|[0-9a-f]{32}|%[0-9A-Fa-fuU]|\\[uUx0-3]|&#|&[A-Za-z]+;|[A-Za-z0-9+/_-]{16}|(?:\0[^\0]){8}")


def scan(text: str) -> list[tuple[str, int, int]]:
    """Base matches of one layer: leftmost, non-overlapping per kind, too short ones dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


class Layer:
    """A text and, per character, the span of the original it comes from (none: the original itself), or one for all, with the number of streams around."""

    def __init__(self, text: str, starts: np.ndarray | None, ends: np.ndarray | None, depth: int, shared: tuple[int, int] | None = None, packed: int = 0):
        self.text, self.starts, self.ends, self.depth, self.shared, self.packed = text, starts, ends, depth, shared, packed

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.shared:
            return self.shared
        if self.starts is None:
            return a, b
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())

    def key(self) -> bytes:
        """Equal for layers of equal text over the same parts of the original only."""
        made = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"))
        made.update(f" {self.shared}".encode())
        if self.starts is not None:
            made.update(self.starts.tobytes() + self.ends.tobytes())
        return made.digest()

    def below(self, text: str, starts: np.ndarray, ends: np.ndarray) -> Layer:
        """A layer whose characters stand for parts of this one, from starts up to and with ends."""
        if self.shared:
            return Layer(text, None, None, self.depth + 1, self.shared, self.packed)
        if self.starts is None:
            return Layer(text, starts, ends + 1, self.depth + 1)
        return Layer(text, self.starts[starts], self.ends[ends], self.depth + 1)

    def replaced(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
        """A layer with pieces [a, b) of this one replaced by characters that stand for parts [x, y) of it."""
        out, starts, ends, at = [], [], [], 0
        for a, b, chars in edits:
            out.append(self.text[at:a])
            starts.append(np.arange(at, a))
            ends.append(np.arange(at, a))
            out.append("".join(c for c, _, _ in chars))
            starts.append(np.array([x for _, x, _ in chars], np.int64))
            ends.append(np.array([y - 1 for _, _, y in chars], np.int64))
            at = b
        out.append(self.text[at:])
        starts.append(np.arange(at, len(self.text)))
        ends.append(np.arange(at, len(self.text)))
        return self.below("".join(out), np.concatenate(starts), np.concatenate(ends))


def _characters(data: bytes) -> Iterator[tuple[str, int, int]]:
    """Characters of UTF-8 bytes with the bytes they take; wrong bytes become U+FFFD."""
    i = 0
    while i < len(data):
        n = 1 if data[i] < 0x80 else 2 if data[i] < 0xE0 else 3 if data[i] < 0xF0 else 4
        try:
            yield data[i : i + n].decode(), i, i + n
            i += n
        except UnicodeDecodeError:
            yield "�", i, i + 1
            i += 1


def decoded(m: re.Match[str], at: int, as_bytes: bool) -> tuple[int, int, list[tuple[str, int, int]]]:
    """The edit that resolves a match of percent escapes, or a plus sign, that lies at a place."""
    if m[0] == "+":
        return at, at + 1, [(" ", at, at + 1)]
    data, end = bytes.fromhex(m[0].replace("%", "")), at + len(m[0])
    found = ((chr(c), i, i + 1) for i, c in enumerate(data)) if as_bytes else _characters(data)
    return at, end, [(c, at + 3 * i, min(end, at + 3 * j)) for c, i, j in found]


def percent(layer: Layer, as_bytes: bool = False) -> Layer | None:
    """The layer with its percent escapes as UTF-8, or, with ``as_bytes``, each as the character of that number."""
    edits = [decoded(m, m.start(), as_bytes) for m in PERCENT.finditer(layer.text)]
    return layer.replaced(edits) if edits else None


def form(layer: Layer, as_bytes: bool = False) -> Layer | None:
    """The same in runs of form-coded text only, with their plus signs as spaces."""
    edits = []
    for run in FORM.finditer(layer.text):
        if "+" in run[0] and PERCENT.search(run[0]):
            edits += [decoded(m, run.start() + m.start(), as_bytes) for m in PLUS.finditer(run[0])]
    return layer.replaced(edits) if edits else None


def escapes(layer: Layer) -> Layer | None:
    """The layer with its escapes resolved, if any is numbered, named or a backslash's own."""
    edits, written = [], False
    for m in UNICODE.finditer(layer.text):
        if m[9] or m[10]:
            if plain := PLAIN[m[10]] if m[10] else html5.get(m[9]):
                edits.append((m.start(), m.end(), [(c, m.start(), m.end()) for c in plain]))
                written = written or bool(m[9]) or m[10] == "\\"
            continue
        code = int(m[8]) if m[8] else int(m[7], 8) if m[7] else int(m[1] or m[2] or m[3] or m[4] or m[5] or m[6], 16)
        if edits and edits[-1][1] == m.start() and 0xDC00 <= code < 0xE000 and (high := ord(edits[-1][2][-1][0])) in range(0xD800, 0xDC00):
            a = edits.pop()[0]
            edits.append((a, m.end(), [(chr(0x10000 + ((high - 0xD800) << 10) + code - 0xDC00), a, m.end())]))
        elif code < 0x110000:
            edits.append((m.start(), m.end(), [(chr(code), m.start(), m.end())]))
            written = True
    return layer.replaced(edits) if written else None


def narrowed(layer: Layer) -> Layer | None:
    """The layer without NULs, if it has so many that it may be UTF-16."""
    return layer.replaced([(m.start(), m.end(), []) for m in re.finditer("\0+", layer.text)]) if layer.text.count("\0") >= 8 else None


def streams(layer: Layer) -> Iterator[Layer]:
    """What compressed streams hold that stand in a layer as characters."""
    if not any(x in layer.text for x in STARTS):
        return
    for run in BYTES.finditer(layer.text):
        for a, b, source in compressed(run[0].encode("latin-1")):
            yield from held(source, layer, layer.span(run.start() + a, run.start() + b))


def compressed(data: bytes) -> Iterator[tuple[int, int, Iterator[bytes]]]:
    """The streams that begin anywhere in bytes, none inside another: their part [a, b) and their content."""
    done = 0
    for m in MAGIC.finditer(view := memoryview(data)):
        if m.start() >= done:
            source, used = whole(view[m.start() :])
            done = m.start() + used
            if used:
                yield m.start(), done, source


def held(source: Iterator[bytes], layer: Layer, span: tuple[int, int]) -> Iterator[Layer]:
    """Layers of a stream's content, one character per byte, in pieces that overlap."""
    if layer.packed == NESTED:
        return
    kept, fresh = b"", 0
    for out in itertools.chain(source, [None]):
        kept += out or b""
        fresh += len(out or b"")
        if fresh >= PIECE or fresh and out is None:
            yield Layer(kept.decode("latin-1"), None, None, layer.depth + 1, span, layer.packed + 1)
            kept, fresh = kept[-OVERLAP:], 0


def opened(data: bytes):
    """A decompressor for what the first bytes say, None if they are no known format."""
    if data[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0:
        return zlib.decompressobj()
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if data[:6] == b"\xfd7zXZ\x00" else None


def inflate(source: Iterator[bytes], raw: bool = False) -> Iterator[tuple[bytes, int]]:
    """What a compressed stream and those right after it hold, in pieces; with each, the bytes taken if a stream ends whole there, else 0."""
    rest, taken, tool, more = b"", 0, None, True
    if raw:
        tool, rest = zlib.decompressobj(-15), next(source, b"")
    while True:
        if not tool:
            while more and len(rest.lstrip(b"\0")) < 6:
                more = next(source, b"")
                rest += more
            taken += len(rest) - len(rest := rest.lstrip(b"\0")) if taken else 0
            if (tool := opened(rest)) is None:
                return
        size = len(rest)
        try:
            out = tool.decompress(rest, 1 << 18)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
            return
        rest = tool.unused_data if tool.eof else getattr(tool, "unconsumed_tail", b"")
        taken += size - len(rest)
        yield out, taken if tool.eof else 0
        if tool.eof:
            tool = None
        elif not out and not rest:
            if not (rest := next(source, b"")):
                return


def whole(data: bytes | memoryview, raw: bool = False) -> tuple[Iterator[bytes], int]:
    """The content of compressed bytes as far as it is whole, and the bytes it takes (0: none is).

    Content over a piece that begins with a stream gives way to what that stream holds, so that no border of pieces cuts it.
    """

    def pieces(lengths: list[int]) -> Iterator[bytes]:
        source = (bytes(data[i : i + (1 << 16)]) for i in range(0, len(data), 1 << 16))
        for k, n in enumerate(lengths):
            source = cut(inflate(source, raw and not k), n)
        return source

    def cut(found: Iterator[tuple[bytes, int]], n: int) -> Iterator[bytes]:
        for out, _ in found:
            if n <= 0:
                return
            yield out[:n]
            n -= len(out)

    lengths: list[int] = []
    used = 0
    while len(lengths) < CHAIN and (not lengths or lengths[-1] > PIECE):
        length = good = 0
        for out, end in inflate(pieces(lengths), raw and not lengths):
            length += len(out)
            if end:
                good = length
                used = end if not lengths else used
        if not good:
            break
        lengths.append(good)
    return pieces(lengths), used


def readings(run: str) -> tuple[np.ndarray, str, list[tuple[int, int]]]:
    """The places of a run's characters without line breaks, the characters, and the parts [a, b) of them to decode.

    These are the run and each of its lines from each of four alignments, as something may be glued before the start; and, for exact
    ends, the pieces between separators. Parts of under 16 characters hold too few bytes for a secret. The first four are the run's.
    """
    lines = [(m.start(), m.end()) for m in LINE.finditer(run)]
    at = np.concatenate([np.arange(a, b) for a, b in lines])
    chars = "".join(run[a:b] for a, b in lines)
    n = len(chars.rstrip("="))
    parts = [(r, n) for r in range(4)]
    done = 0
    for a, b in lines:
        a, b, done = done, min(n, done + b - a), done + b - a
        if len(lines) > 1:
            parts += [(a + r, b) for r in range(4)]
        parts += [(m.start(), m.end()) for piece in PIECES for m in piece.finditer(chars, a, b)]
    return at, chars, [(a, b) for i, (a, b) in enumerate(dict.fromkeys(parts)) if i < 4 or b - a >= 16]


def unpacked(layer: Layer) -> Iterator[Layer]:
    """The layers that base64 runs hold, text or not, or compressed."""
    for run in BASE64.finditer(layer.text):
        at, chars, parts = readings(run[0])
        at, chars = at + run.start(), chars.translate(STANDARD)
        n = parts[0][1]
        for k, (a, b) in enumerate(parts):
            data = binascii.a2b_base64(chars[a : b - ((b - a) % 4 == 1)] + "=" * (-(b - a) % 4 % 3))
            final = (len(at) if b == n else b) - 1  # with the padding
            first, last = lambda i: at[a + i // 3 * 4], lambda j: at[np.minimum(final, a + j // 3 * 4 + 3)]  # noqa: B023, E731
            for x, y, source in compressed(data) if k < 4 else ():
                yield from held(source, layer, layer.span(int(first(x)), int(last(y - 1)) + 1))
            if 0 < k < 4:
                pass  # a raw stream shows no start, so it is looked for from a run's or a piece's own
            elif data and (found := whole(data, True))[1] == len(data):
                yield from held(found[0], layer, layer.span(int(first(0)), int(last(len(data) - 1)) + 1))
            if MATTERS.search(data):
                if data.isascii():
                    text, i = data.decode(), np.arange(len(data))
                    j = i
                else:
                    found = list(_characters(data))
                    text, i, j = "".join(c for c, _, _ in found), np.array([x for _, x, _ in found]), np.array([y - 1 for _, _, y in found])
                yield layer.below(text, first(i), last(j))


def below(layer: Layer) -> Iterator[Layer]:
    """The layers right below one."""
    text = layer.text
    if "%" in text:
        for read in (percent, form) if "+" in text else (percent,):
            if made := read(layer):
                yield made
                yield from streams(read(layer, True))
    if ("\\" in text or "&" in text or "%u" in text or "%U" in text) and (made := escapes(layer)):
        yield made
    if "\0" in text and (made := narrowed(layer)):
        yield made
    yield from streams(layer)
    yield from unpacked(layer)


def find(text: str) -> list[tuple[str, int, int, bool, int]]:
    """All spans (kind, start, end, base, depth of the layer), by start, then kind as listed, then end."""
    spans: dict[tuple[str, int, int], int] = {}
    work, seen = [iter([Layer(text, None, None, 0)])], set()
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
        elif (key := layer.key()) not in seen:
            seen.add(key)
            for kind, a, b in scan(layer.text):
                span = (kind, *layer.span(a, b))
                spans[span] = min(layer.depth, spans.get(span, layer.depth))
            work.append(below(layer))
    order = {k: i for i, k in enumerate(KINDS)}
    return [(*k, not depth, depth) for k, depth in sorted(spans.items(), key=lambda x: (x[0][1], order[x[0][0]], x[0][2]))]


def find_secrets(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Add the array of spans of each whole text; one pass over the rows, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("depth", pa.int32())]))
        for batch in slices(batches, text):
            names = [c for c in batch.schema.names if c != spans]
            found = [[dict(zip(("kind", "start", "end", "base", "depth"), x, strict=True)) for x in find(t)] for t in texts(batch, text)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(found, kind)], [*names, spans])

    return df.mapInArrow(run, T.StructType([*[f for f in df.schema.fields if f.name != spans], T.StructField(spans, SPANS)]))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace each maximal stretch of overlapping spans by ``[kind]`` of its first span; a text without spans is unchanged."""
    none = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    body = F.coalesce(F.col(text), F.lit(""))

    def step(a: Column, x: Column) -> Column:
        gap = F.substr(body, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int"))
        return F.when(x["start"] >= a["at"], F.struct(F.concat(a["out"], gap, F.lit("["), x["kind"], F.lit("]")).alias("out"), x["end"].alias("at"))).otherwise(
            F.struct(a["out"].alias("out"), F.greatest(a["at"], x["end"]).alias("at"))
        )

    done = F.aggregate(spans, none, step, lambda a: F.concat(a["out"], F.substr(body, (a["at"] + 1).cast("int"))))
    return df.withColumn(text, F.when(F.size(spans) > 0, done).otherwise(F.col(text)))
