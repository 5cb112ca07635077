"""Removal of repeated byte strings by suffix sorting, exact over the whole corpus.

Every window of ``LENGTH`` bytes belongs to the least hash among the k-grams inside it, so equal windows meet under one key wherever
they start. Runs of windows with one key are kept together as pieces of text. Pieces that occur twice need no sorting: all their
windows repeat. Of the rest only those whose key has other pieces are sorted: deep-shallow, that is by multikey quicksort with eight
bytes as a symbol, all groups of a level at once, down to ``SHALLOW`` bytes; groups that are still together go into blind tries, which
branch on single bytes and compare with one leaf. Equal windows are neighbours then.

A key with more than ``HOT`` different pieces (the edges of passages that very many documents share) is parted by further symbols before
it is sorted: windows that reach far to the left of the k-gram by the bytes there, the others by those to its right, half of what
is not yet known at a time. Parts of equal bytes become one. Groups that are small enough are sorted as above, the others parted
again; after eight such levels all bytes of a window are known. A window is in one group on each level, so no task sees all windows
of a hot key.

Texts are read in three passes, and only what may repeat is shuffled: a filter says which keys may matter. Its size goes by the
number of keys, up to 2**``FILTER`` bits. It lets too much through when it fills up, never too little, so at any size the result is
the same.

Defined cases: null texts are empty; texts shorter than a window keep all bytes; a text of any length is read whole; equal texts repeat
each other, also when the rows are equal; overlapping and touching windows make one run; an empty table gives no rows; input columns
named like an output or ``body_id`` and ``ranges`` are replaced, others are carried along.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, slices

LENGTH, GRAM, SHALLOW = 200, 64, 40
LONGEST = 4096  # windows of a piece
HOT = 512
FILTER = 27
CHUNK = 400_000  # windows sorted together
SLICE = 1 << 17  # bytes of text hashed together, so that the arrays stay in a core's cache
REST = LENGTH - GRAM  # bytes of a window beside its k-gram
U = np.uint64
_P, _M1, _M2 = 0x100000001B3, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed hash of each k-gram, by doubling."""
    h, step, power = data.astype(np.uint64) + np.uint64(1), 1, _P
    while step < GRAM:
        h = h[:-step] * np.uint64(power) + h[step:]
        step, power = 2 * step, power * power % 2**64
    h ^= h >> np.uint64(31)
    h *= _M1
    h ^= h >> np.uint64(29)
    h *= _M2
    return h


def window_keys(h: np.ndarray) -> np.ndarray:
    """The least k-gram hash of each window."""
    span, step, m = LENGTH - GRAM + 1, 1, h
    while 2 * step <= span:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    return np.minimum(m[: len(m) - (span - step)], m[span - step :]) if span > step else m


def pieces(data: np.ndarray, ends: np.ndarray, repeats: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one key within one text: key, text number, start, number of windows; with ``repeats``, whether windows may repeat inside."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none, none.astype(bool)
    h = gram_hashes(data)
    key = window_keys(h)
    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[: len(key)]
    inside = np.arange(len(key)) + LENGTH <= ends[owner + 1]
    cut = np.ones(len(key) + 1, bool)
    cut[1:-1] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
    at = np.flatnonzero(cut)
    size = np.diff(at)
    at = at[:-1]
    if size.max() > LONGEST:
        parts = [(a + i, min(LONGEST, n - i)) for a, n in zip(at, size, strict=True) for i in range(0, n, LONGEST)]
        at, size = np.array([x[0] for x in parts]), np.array([x[1] for x in parts])
    good = inside[at]
    at, size = at[good], size[good]
    if not repeats or not len(at):
        return key[at], owner[at], at, size, np.zeros(len(at), bool)
    # k-grams that are the least of a window and occur twice near each other
    where = np.flatnonzero(h <= key[at].max())
    where = where[np.isin(h[where], key[at])]
    order = np.lexsort((where, h[where]))
    where = where[order]
    twice = (h[where][1:] == h[where][:-1]) & (np.diff(where) < LONGEST + LENGTH)
    odd = np.isin(key[at], h[where][1:][twice])
    return key[at], owner[at], at, size, odd


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, one after the other, and where each begins; the last entry is the end."""
    column = batch.column("text")
    raw = column.buffers()
    ends = np.frombuffer(raw[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[ends[0] : ends[-1]] if raw[2] else np.empty(0, np.uint8)
    return data, ends - ends[0]


def _digests(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[int]:
    raw = memoryview(data.tobytes())
    return [xxhash.xxh3_64_intdigest(raw[a : a + n + LENGTH - 1]) for a, n in zip(at.tolist(), size.tolist(), strict=True)]


def _signed(x: np.ndarray | list[int]) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First pass: pieces by key and digest, equal ones of a batch made one row."""
    for batch in slices(batches, "text", SLICE):
        data, ends = _texts(batch)
        key, _, at, size, odd = pieces(data, ends, True)
        digest = np.array(_digests(data, at, size), np.uint64)
        order = np.lexsort((digest, key))
        key, digest, odd = key[order], digest[order], odd[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        rows = np.flatnonzero(first)
        yield pa.RecordBatch.from_arrays([_signed(key[rows]), _signed(digest[rows]), pa.array(np.diff(np.append(rows, len(key)))), pa.array(odd[rows])], ["key", "digest", "n", "odd"])


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = keys * _M1
    y = (keys ^ keys >> np.uint64(33)) * _M2
    return x >> np.uint64(64 - bits), y >> np.uint64(64 - bits)


def key_filter(keys: DataFrame) -> np.ndarray:
    """A bitmap that holds all ``key`` of a table, 16 bits a key if they are not too many: partial ones are united by word, 2**FILTER / 64 rows at most."""
    size = min(FILTER, max(16, (16 * keys.count()).bit_length()))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(np.concatenate(_slots(batch.column("key").to_numpy().view(np.uint64), size)))
            word, bit = slots >> np.uint64(6), np.left_shift(np.uint64(1), slots & np.uint64(63))
            at = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(word[at].astype(np.int64)), _signed(np.bitwise_or.reduceat(bit, at) if len(at) else bit)], ["word", "bits"])

    rows = keys.select("key").mapInArrow(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << size - 6, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    x, y = _slots(keys, len(bitmap).bit_length() + 5)
    test = lambda s: bitmap[s >> np.uint64(6)] >> (s & np.uint64(63)) & np.uint64(1) == 1
    return test(x) & test(y)


def _contested(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Second pass: the bytes of pieces whose key passes the filter, equal ones of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in slices(batches, "text", SLICE):
            data, ends = _texts(batch)
            key, _, at, size, _ = pieces(data, ends)
            good = passes(bitmap, key)
            key, at, size = key[good], at[good], size[good]
            found = dict(zip(zip(key.tolist(), _digests(data, at, size), strict=True), zip(at.tolist(), size.tolist(), strict=True), strict=True))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [_signed([k for k, _ in found]), _signed([d for _, d in found]), pa.array([raw[a : a + n + LENGTH - 1] for a, n in found.values()], pa.binary())], ["key", "digest", "body"]
            )

    return run


def _places(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Third pass: where pieces lie whose key passes the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = sent.value
        for batch in slices(batches, "text", SLICE):
            data, ends = _texts(batch)
            key, owner, at, size, _ = pieces(data, ends)
            good = passes(bitmap, key)
            key, owner, at, size = key[good], owner[good], at[good], size[good]
            start = at - ends[owner]
            yield pa.RecordBatch.from_arrays(
                [batch.column("body_id").take(pa.array(owner)), pa.array(start), pa.array(start + size + LENGTH - 1), _signed(key), _signed(_digests(data, at, size))], ["body_id", "start", "end", "key", "digest"]
            )

    return run


def blind_trie(strings: list[bytes]) -> list[bool]:
    """Which strings of equal length occur more than once. Inner nodes hold the byte at which their leaves part, leaves their members."""
    root: list = [None, [0]]  # a leaf: None and members; an inner node: depth and children by byte
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while node[0] is not None:
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        t = strings[node[1][0]]
        if s == t:
            node[1].append(i)
            continue
        depth = len(s) - 1 - ((int.from_bytes(s) ^ int.from_bytes(t)).bit_length() - 1) // 8
        node = root
        while node[0] is not None and node[0] < depth:
            node = node[1][s[node[0]]]
        if node[0] == depth:
            node[1][s[depth]] = [None, [i]]
        else:
            node[:] = [depth, {t[depth]: list(node), s[depth]: [None, [i]]}]
    again, stack = [False] * len(strings), [root]
    while stack:
        node = stack.pop()
        if node[0] is not None:
            stack.extend(node[1].values())
        elif len(node[1]) > 1:
            for i in node[1]:
                again[i] = True
    return again


def repeated_windows(keys: np.ndarray, bodies: list[bytes]) -> list[np.ndarray]:
    """For each piece, the numbers of its windows that occur more than once among the pieces' windows (at different places)."""
    sizes = np.array([len(b) - LENGTH + 1 for b in bodies])
    begins = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    raw = b"".join(bodies)
    data = np.frombuffer(raw, np.uint8)
    owner = np.repeat(np.arange(len(bodies)), sizes)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = begins[owner] + number
    # the place of the key's k-gram within each window: equal windows agree in it
    h = gram_hashes(data)
    holder = np.repeat(np.arange(len(bodies)), np.diff(begins))[: len(h)]
    spots = np.flatnonzero(h == keys[holder])
    offset = spots[np.searchsorted(spots, at)] - at
    order = np.lexsort((offset, keys[owner]))
    group = np.cumsum(np.append(True, (np.diff(keys[owner][order]) != 0) | (np.diff(offset[order]) != 0))) if len(order) else order
    order, group = _together(order, group)
    symbols = np.ndarray((len(raw) - 7,), ">u8", raw, strides=(1,)) if len(raw) > 7 else np.empty(0, ">u8")
    for depth in range(0, SHALLOW, 8):
        if not len(order):
            break
        symbol = symbols[at[order] + depth].astype(np.uint64)
        by = np.lexsort((symbol, group))
        order, group, symbol = order[by], group[by], symbol[by]
        group = np.cumsum(np.append(True, (np.diff(group) != 0) | (symbol[1:] != symbol[:-1])))
        order, group = _together(order, group)
    marked = np.zeros(len(at), bool)
    bounds = np.append(np.flatnonzero(np.append(True, np.diff(group) != 0)), len(group)) if len(group) else []
    starts = at[order].tolist()
    found = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        found += blind_trie([raw[x : x + LENGTH] for x in starts[a:b]])
    marked[order[np.array(found, bool)]] = True
    hits = np.flatnonzero(marked)
    return np.split(number[hits], np.searchsorted(owner[hits], np.arange(1, len(bodies))))


def _together(order: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without the groups of one."""
    if not len(order):
        return order, group
    new = np.append(True, np.diff(group) != 0)
    alone = new & np.append(new[1:], True)
    return order[~alone], group[~alone]


def stretches(starts: np.ndarray, width: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows at ascending ``starts`` cover; touching runs are one."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + width).tolist(), strict=True))


RANGES = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
_RANGES = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
FOUND = T.StructType([T.StructField("key", T.LongType()), T.StructField("digest", T.LongType()), T.StructField("ranges", RANGES)])


def _ranges(found: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"a": a, "b": b} for a, b in x] for x in found], _RANGES)


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces ordered by group, sorted chunk by chunk; a group's pieces stay together."""
    rows: list[tuple[int, int, int, int, bytes]] = []
    windows = 0

    def flush() -> pa.RecordBatch:
        nonlocal windows
        found = repeated_windows(np.array([r[1] for r in rows], np.int64).view(np.uint64), [r[4] for r in rows])
        kept = [(r, stretches(x + r[3])) for r, x in zip(rows, found, strict=True) if len(x)]
        out = pa.RecordBatch.from_arrays([pa.array([r[1] for r, _ in kept], pa.int64()), pa.array([r[2] for r, _ in kept], pa.int64()), _ranges([x for _, x in kept])], ["key", "digest", "ranges"])
        rows.clear()
        windows = 0
        return out

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "key", "digest", "base", "body")), strict=True):
            if windows >= CHUNK and row[0] != rows[-1][0]:
                yield flush()
            rows.append(row)
            windows += len(row[4]) - LENGTH + 1
    if rows:
        yield flush()


#: A part of a piece: its group, the piece, where its first window starts there, its bytes, the k-gram's place in them, and how many
#: bytes to the left and to the right of the k-gram all of the group share.
PARTS = "grp long, key long, digest long, base int, body binary, spot int, l int, r int"


def _parts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in PARTS.split(", ")])


def _spotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of hot keys, cut so that all windows of a part hold the same k-gram first."""
    for batch in batches:
        rows = []
        for key, digest, body in zip(*(batch.column(c).to_pylist() for c in ("key", "digest", "body")), strict=True):
            n, low = len(body) - LENGTH + 1, 0
            for spot in np.flatnonzero(gram_hashes(np.frombuffer(body, np.uint8)).view(np.int64) == key).tolist():
                high = min(n, spot + 1)  # windows up to here begin no later than the k-gram
                if high > low:
                    rows.append((key, key, digest, low, body[low : high + LENGTH - 1], spot - low, 0, 0))
                    low = high
        yield _parts(rows)


def halves(row: tuple) -> Iterator[tuple]:
    """A part's windows that reach far to the left of the k-gram, and the others, each with the group that more of their bytes give."""
    grp, key, digest, base, body, spot, left, right = row
    n, rest = len(body) - LENGTH + 1, REST - left - right
    half = (rest + 1) // 2
    cut = min(n, max(0, spot - left - half + 1))
    name = lambda side, more: xxhash.xxh3_64_intdigest(grp.to_bytes(8, "little", signed=True) + side + more) - (1 << 63)
    if cut:
        yield name(b"l", body[spot - left - half : spot - left]), key, digest, base, body[: cut + LENGTH - 1], spot, left + half, right
    if cut < n:
        more, at = rest - half + 1, spot + GRAM + right
        yield name(b"r", body[at : at + more]), key, digest, base + cut, body[cut:], spot - cut, left, right + more


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in PARTS.split(", ")]
    for batch in batches:
        yield _parts([x for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True) for x in halves(row)])


def _hot(pieces_: DataFrame, hot: int) -> DataFrame:
    """``key, digest, ranges`` of the pieces (key, digest, body) of hot keys, parted until their groups can be sorted.

    Parts of equal bytes need no sorting, as equal pieces do not: all their windows repeat, and one of them stays to meet others.
    """
    state = materialise(pieces_.select("key", "digest", "body").mapInArrow(_spotted, PARTS))
    found = None
    while True:
        sized = state.join(state.groupBy("grp").agg(F.count("*").alias("many")), "grp")
        cold = sized.where(F.col("many") <= hot).select("grp", "key", "digest", "base", "body")
        part = cold.repartition("grp").sortWithinPartitions("grp").mapInArrow(_sorted, FOUND)
        found = part if found is None else found.unionByName(part)
        halved = materialise(sized.where(F.col("many") > hot).drop("many").mapInArrow(_halved, PARTS))
        if not halved.limit(1).count():
            return found
        same = materialise(halved.groupBy("grp", "spot", "body").agg(F.count("*").alias("many"), F.min(F.struct("key", "digest", "base", "l", "r")).alias("one")))
        all_of_it = F.array(F.struct(F.col("base").cast("long").alias("a"), (F.col("base") + F.octet_length("body")).cast("long").alias("b")))
        again = halved.join(same.where("many > 1").select("grp", "spot", "body"), ["grp", "spot", "body"], "left_semi")
        found = found.unionByName(again.select("key", "digest", all_of_it.alias("ranges")))
        rest = same.where(F.col("one.l") + F.col("one.r") < REST)  # else all bytes are known, and equal windows have been found
        state = materialise(rest.select("grp", "one.key", "one.digest", "one.base", "body", "spot", "one.l", "one.r"))


def _cut(batches: Iterator[pa.RecordBatch], as_text: bool) -> Iterator[pa.RecordBatch]:
    """Merge a text's ranges, remove them, keep the rest."""
    for batch in slices(batches, "text"):
        names = [c for c in batch.schema.names if c not in ("text", "ranges", "body_id")]
        kept, spans = [], []
        for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            merged: list[list[int]] = []
            for a, b in sorted((x["a"], x["b"]) for x in ranges or ()):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            raw, at, out = (text or "").encode(), 0, []
            for a, b in merged:
                out.append(raw[at:a])
                at = b
            kept.append(b"".join([*out, raw[at:]]))
            spans.append(merged)
        body = batch.column("text")
        if as_text:  # the bytes left of a character that a cut breaks go too; untouched texts stay as they are
            body = pa.array([k.decode(errors="ignore") if s else t for k, s, t in zip(kept, spans, body.to_pylist(), strict=True)], pa.string())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], body, pa.array(kept, pa.binary()), _ranges(spans)], [*names, "text", "kept", "removed"])


def repeated_ranges(bodies: DataFrame, hot: int = HOT) -> DataFrame:
    """``body_id, ranges`` of the texts (body_id, text) that hold repeated windows; ranges may overlap."""
    spark = bodies.sparkSession
    texts = bodies.select("body_id", "text")
    counted = materialise(bodies.select("text").mapInArrow(_count, "key long, digest long, n long, odd boolean").groupBy("key", "digest").agg(F.sum("n").alias("n"), F.max("odd").alias("odd")))
    by_key = counted.groupBy("key").agg(F.count("*").alias("different"), F.sum("n").alias("total"), F.max("odd").alias("any_odd"))
    by_key = materialise(by_key.where("total > 1 or any_odd"))
    whole = counted.where("n > 1").select("key", "digest", F.lit(None).cast(RANGES).alias("ranges"))

    unsure = by_key.where("different > 1 or any_odd")
    sent = spark.sparkContext.broadcast(key_filter(unsure))  # 2**FILTER bits at most
    bytes_ = texts.select("text").mapInArrow(_contested(sent), "key long, digest long, body binary").groupBy("key", "digest").agg(F.any_value("body").alias("body"))
    bytes_ = materialise(bytes_.join(unsure.select("key", "different"), "key").join(counted.select("key", "digest", F.col("n").alias("copies")), ["key", "digest"]))
    cold = bytes_.where(F.col("different") <= hot).select(F.col("key").alias("grp"), "key", "digest", F.lit(0).alias("base"), "body")
    found = cold.repartition("grp").sortWithinPartitions("grp").mapInArrow(_sorted, FOUND)
    many = bytes_.where(F.col("different") > hot)
    if many.limit(1).count():
        found = found.unionByName(_hot(many, hot))
    found = found.join(whole.select("key", "digest"), ["key", "digest"], "left_anti")
    results = materialise(whole.unionByName(found.select("key", "digest", "ranges")))

    sent = spark.sparkContext.broadcast(key_filter(results))
    places = texts.mapInArrow(_places(sent), "body_id string, start long, end long, key long, digest long").distinct()
    each = F.coalesce("ranges", F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("end") - F.col("start")).alias("b"))))
    moved = F.transform(each, lambda x: F.struct((x["a"] + F.col("start")).alias("a"), (x["b"] + F.col("start")).alias("b")))
    hits = places.join(results, ["key", "digest"]).select("body_id", F.explode(moved).alias("range"))
    return hits.groupBy("body_id").agg(F.collect_list("range").alias("ranges"))


def remove_repeats(docs: DataFrame, text: str = "text", keep: list[str] | None = None, as_text: bool = False, hot: int = HOT) -> DataFrame:
    """``keep`` columns of ``docs`` with ``text`` (null as empty), ``kept`` (the bytes left) and ``removed`` (maximal runs of bytes).

    With ``as_text``, ``text`` holds what is left, as far as it is whole characters.
    """
    keep = [f"`{c}`" for c in (docs.columns if keep is None else keep) if c not in (text, "text", "kept", "removed", "body_id", "ranges")]
    bodies = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("body_id", F.md5("text"))
    ranges = materialise(repeated_ranges(bodies, hot))
    fields = [f for f in bodies.select(*keep, "text").schema.fields]
    schema = T.StructType([*fields, T.StructField("kept", T.BinaryType()), T.StructField("removed", RANGES)])
    return bodies.join(ranges, "body_id", "left").select(*keep, "text", "ranges", "body_id").mapInArrow(partial(_cut, as_text=as_text), schema)


def total(removed: Column) -> Column:
    return F.aggregate(removed, F.lit(0).cast("long"), lambda a, x: a + x["b"] - x["a"])
