"""Language-model scores by context-tree weighting over bytes, beside a unigram base.

A text is its words in lower case, joined by single spaces and ended by a line feed. Each byte is eight binary decisions; a decision's
node is a context of 0 to ``DEPTH`` preceding bytes and the bits so far. A node keeps how often 0 and 1 followed in the training texts;
its Krichevsky-Trofimov estimate is mixed half and half with the product of its children, which knows one byte more. The weights
that this leaves after training predict every text: a decision's probability is the mixture of the estimates along its context,
and a context that training has not seen leaves its share to the deepest one that it has. The score is the sum over all bytes, each rounded to 1/4096 bit.

Work is dealt like this. Texts are packed once into blocks of a bounded size. A block lists its distinct contexts with symbols
(grams) and its distinct words, with training counts; grams meet by their two latest bytes (a subtree), words by hash. Up to
``GROUP`` lists are merged into one, these again, until few are left; words go to finer buckets on each level, and a subtree with
over ``HOT`` listed grams is split by the third byte. Subtrees are weighted from the leaves up; each distinct gram is worked out
once, and the log probabilities go down the same levels to each block's list in the order of its grams, so that only numbers reach
the blocks; the same holds for word counts. Work is in proportion to the input but for the number of levels, its logarithm. No table
of grams or words is broadcast or collected: the driver sees the 256 contexts of one byte, and two sums.

Defined cases: a null or empty text is the end alone; without training texts all estimates are 1/2; repeated rows are scored and
counted one by one; a null id counts like an empty one for the fold; a text longer than a block is a block of its own; equal counts
need no order; an empty table gives no rows; only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, texts

DEPTH = 6  # at most 7: with the symbol, a key of 64 bits
BLOCK = 8 << 20  # bytes of text
GROUP = 128  # lists that one task merges or answers
HOT = 2_000_000  # listed grams of a subtree, beyond which it is split by a third byte
BUCKETS, SPLIT = 256, 8  # of words: in a block, and parts of each on the next level; powers of two
MOST_TASKS = 8192
U = np.uint64
_IPC = pa.ipc.IpcWriteOptions(compression="zstd")
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def canonical(text: str) -> str:
    words = text.encode().lower().split()  # on bytes, both know ASCII alone: A-Z, and the white space of the contract
    return b" ".join(words).decode() + "\n"


def fold(doc_id: int | None, divisor: int = 7) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % divisor


# ---- packed lists

def squeeze(x: np.ndarray | bytes) -> bytes:
    raw = x if isinstance(x, bytes) else x.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def expand(x: bytes) -> bytes:
    return pa.decompress(x[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True)


def squeeze_numbers(x: np.ndarray, ordered: bool = False) -> bytes:
    """Whole numbers, ascending ones as differences; bytes of equal rank stand together, so that zeros pack well."""
    x = x.astype("<u8")
    if ordered and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    return squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T))


def numbers(x: bytes, ordered: bool = False) -> np.ndarray:
    out = np.ascontiguousarray(np.frombuffer(expand(x), np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(out, dtype=U) if ordered else out.view("<i8")


def squeeze_logs(x: np.ndarray) -> bytes:
    """Negative log2 values in steps of 1/4096 bit."""
    x = np.minimum(np.rint(-x * 4096), 2**32 - 1).astype("<u4")
    return squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 4).T))


def logs(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(expand(x), np.uint8).reshape(4, -1).T).view("<u4").ravel() / -4096.0


def pack_block(ids: list[int | None], bodies: list[str]) -> bytes:
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bodies, pa.large_string())], ["doc_id", "body"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_IPC) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_block(blob: bytes) -> tuple[list[int | None], list[str]]:
    table = pa.ipc.open_stream(blob).read_all()
    return table.column("doc_id").to_pylist(), table.column("body").to_pylist()


# ---- grams of a block

def grams(bodies: list[str], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """One number per byte: the ``depth`` bytes before it, the latest highest, then itself; and each body's first place."""
    pad = b"\n" * depth
    raw = [x.encode() for x in bodies]
    x = np.frombuffer(b"".join(y for b in raw for y in (pad, b)), np.uint8).astype(U)
    sizes = np.array([len(b) for b in raw])
    n = len(x) - depth
    out = np.zeros(n, U)
    for k in range(1, depth + 1):
        out = out << U(8) | x[depth - k : depth - k + n]
    out = out << U(8) | x[depth:]
    first = np.cumsum(sizes + depth) - sizes - depth  # of each body, counted from the end of its padding
    within = np.arange(n) - np.repeat(first, sizes + depth)[:n]
    return out[within < np.repeat(sizes, sizes + depth)[:n]], np.cumsum(sizes) - sizes


def parts(bodies: list[str], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, b in enumerate(bodies):
        if total and total + len(b) > most:
            yield start, i
            start, total = i, 0
        total += len(b)
    if start < len(bodies):
        yield start, len(bodies)


def added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their summed counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    return k[at], np.add.reduceat(c, at) if len(at) else c


def distinct(x: np.ndarray) -> np.ndarray:
    """Distinct values in order."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and the place of each value among them."""
    order = np.argsort(x)
    x = x[order]
    new = np.append(True, x[1:] != x[:-1])
    places = np.empty(len(x), np.int32)
    places[order] = np.cumsum(new, dtype=np.int32) - 1
    return x[new], places


def block_grams(ids: list[int | None], bodies: list[str], depth: int, held: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a block in order, with their counts in its training texts."""
    train = [fold(i) != held for i in ids]
    keys, counts = [], []
    for use in (True, False):
        runs = []
        for a, b in parts(bodies):
            some = [bodies[i] for i in range(a, b) if train[i] == use]
            if some:
                runs.append(grams(some, depth)[0])
        if runs:
            x = np.concatenate(runs)
            runs.clear()
            x.sort()
            at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            keys.append(x[at]), counts.append(np.diff(at, append=len(x)) if use else np.zeros(len(at), np.int64))
    return added(keys, counts) if keys else (np.empty(0, U), np.empty(0, np.int64))


class Words:
    """The words of a block: the distinct ones, each token's place among them, where each body's tokens begin."""

    __slots__ = ("distinct", "codes", "first")

    def __init__(self, bodies: list[str]):
        lists = pc.split_pattern(pa.array([b[:-1] for b in bodies], pa.large_string()), " ")
        flat = lists.flatten().dictionary_encode()
        self.distinct, codes = flat.dictionary, flat.indices.to_numpy()
        sizes = np.array([len(x) > 1 for x in bodies]) * pc.list_value_length(lists).to_numpy()  # an empty body splits into one empty word
        none = pc.index(self.distinct, pa.scalar("", pa.large_string())).as_py()
        self.codes = codes[codes != none] if none >= 0 else codes
        self.first = np.concatenate([[0], np.cumsum(sizes)])

    def order(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the distinct words ordered by bucket, and their buckets."""
        in_bucket = (word_hashes(self.distinct) & U(buckets - 1)).astype(np.int32)
        order = np.argsort(in_bucket.astype(np.uint16) if buckets <= 1 << 16 else in_bucket, kind="stable")
        order = order[pc.binary_length(self.distinct).to_numpy()[order] > 0]
        return order, in_bucket[order]


def word_hashes(words: pa.Array) -> np.ndarray:
    """A mixed polynomial hash of the bytes of each word; its low bits deal words to buckets, nothing else rests on it."""
    raw, n = words.buffers(), len(words)
    at = np.frombuffer(raw[1], np.int64)[words.offset : words.offset + n + 1]
    if not n or at[-1] == at[0]:
        return np.zeros(n, U)
    data = np.frombuffer(raw[2], np.uint8)[at[0] : at[-1]].astype(U) + U(1)
    at = at - at[0]
    power = np.full(len(data) + 1, _ROOT, U)
    back = np.full(len(data) + 1, _INVERSE, U)
    power[0] = back[0] = 1
    np.multiply.accumulate(power, out=power), np.multiply.accumulate(back, out=back)
    total = np.concatenate([np.zeros(1, U), np.cumsum(data * power[:-1], dtype=U)])
    h = (total[at[1:]] - total[at[:-1]]) * back[at[:-1]]
    h = (h ^ h >> U(31)) * U(0xBF58476D1CE4E5B9)
    return h ^ h >> U(29)


_ROOT = 0x9E3779B97F4A7C15
_INVERSE = pow(_ROOT, -1, 1 << 64)


def word_lists(words: pa.Array, counts: np.ndarray, order: np.ndarray, in_bucket: np.ndarray) -> Iterator[tuple[int, bytes, bytes, int]]:
    """By bucket: its words joined by spaces, their counts, and how many they are."""
    if not len(order):
        return
    at = np.flatnonzero(np.append(True, in_bucket[1:] != in_bucket[:-1]))
    taken = words.take(pa.array(order)).cast(pa.string())
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(at, len(order)), pa.int32()), taken), " ")
    for i, (a, b) in enumerate(zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True)):
        yield int(in_bucket[a]), squeeze(joined[i].as_buffer().to_pybytes()), squeeze_numbers(counts[order[a:b]]), b - a


def block_words(ids: list[int | None], bodies: list[str], buckets: int, held: int) -> list[tuple[int, bytes, bytes, int]]:
    """The lists of a block's distinct words by bucket, with their counts in its training texts."""
    words = Words(bodies)
    train = np.repeat([fold(i) != held for i in ids], np.diff(words.first))
    count = np.bincount(words.codes[train], minlength=len(words.distinct))
    return list(word_lists(words.distinct, count, *words.order(buckets)))


# ---- the tree

_LOG = np.log(np.arange(1, 1 << 16))
_WHOLE = np.concatenate([[0.0], np.cumsum(_LOG)])  # ln n!
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange((1 << 16) - 1) + 0.5))])  # ln of (1/2)(3/2)...(n - 1/2)


def _stirling(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3)


def log_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a zeros and b ones."""

    def half(n: np.ndarray) -> np.ndarray:
        big = n >= len(_HALF)
        return np.where(big, _stirling(np.maximum(n, 9) + 0.5) - 0.5723649429247001, _HALF[np.minimum(n, len(_HALF) - 1)])

    n = a + b
    whole = np.where(n >= len(_WHOLE), _stirling(np.maximum(n, 9) + 1.0), _WHOLE[np.minimum(n, len(_WHOLE) - 1)])
    return half(a) + half(b) - whole


class Level:
    """The nodes of one depth in order of their keys (context, then bits so far with a leading one)."""

    __slots__ = ("keys", "zeros", "ones", "weight", "log_mixed")


def nodes(keys: np.ndarray, counts: np.ndarray) -> Level:
    """From distinct grams of one depth in order."""
    level = Level()
    k, zeros, ones = [], [], []
    for j in range(8):
        node = keys >> U(8 - j)
        at = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        bit = (keys >> U(7 - j) & U(1)).astype(bool)
        n, one = np.add.reduceat(counts, at), np.add.reduceat(np.where(bit, counts, 0), at)
        node = node[at]
        k.append((node >> U(j)) << U(8) | node & U((1 << j) - 1) | U(1 << j))
        zeros.append(n - one), ones.append(one)
    level.keys = np.concatenate(k)
    order = np.argsort(level.keys)
    level.keys, level.zeros, level.ones = level.keys[order], np.concatenate(zeros)[order], np.concatenate(ones)[order]
    return level


def mix(level: Level, child_sum: np.ndarray | None) -> Level:
    """Weight a level's own estimate against the product of its children (none: a leaf)."""
    own = log_estimate(level.zeros, level.ones)
    if child_sum is None:
        level.log_mixed, level.weight = own, np.ones(len(own))
    else:
        level.log_mixed = np.logaddexp(own, child_sum) - np.log(2)
        level.weight = np.exp(own - np.log(2) - level.log_mixed)
    return level


def shorter(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Grams without the oldest byte of their context."""
    return added([(keys >> U(16)) << U(8) | keys & U(255)], [counts])


def subtree(keys: np.ndarray, counts: np.ndarray, depth: int, top: int = 2) -> dict[int, Level]:
    """Levels ``depth`` to ``top`` of the tree below one context of ``top`` bytes."""
    levels: dict[int, Level] = {}
    for d in range(depth, top - 1, -1):
        if d < depth:
            keys, counts = shorter(keys, counts)
        level, below = nodes(keys, counts), levels.get(d + 1)
        total = None
        if below is not None:
            parent = (below.keys >> U(16)) << U(8) | below.keys & U(255)
            total = np.bincount(np.searchsorted(level.keys, parent), weights=below.log_mixed, minlength=len(level.keys))
        levels[d] = mix(level, total)
    return levels


def dense(symbols: np.ndarray, child_sum: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one context, by bits so far: the estimate of a one (not a number if training has not seen the node), its weight, and the ln of the mixture; from counts of its 256 symbols."""
    count = np.zeros(512, np.int64)
    count[256:] = symbols
    for i in range(255, 0, -1):
        count[i] = count[2 * i] + count[2 * i + 1]
    zeros, ones = count[0:512:2], count[1:512:2]  # of node i: children 2i and 2i + 1
    level = Level()
    level.zeros, level.ones = zeros[:256].copy(), ones[:256].copy()
    level.zeros[0] = level.ones[0] = 0
    mix(level, child_sum)
    n = level.zeros + level.ones
    return np.where(n > 0, (level.ones + 0.5) / (n + 1), np.nan), level.weight, level.log_mixed


def log2_probabilities(asked: np.ndarray, levels: dict[int, Level], top: list[tuple[np.ndarray, np.ndarray] | None], depth: int) -> np.ndarray:
    """log2 of the probability of each gram's byte after its context. top: estimates and weights of the depths above the levels."""
    out = np.zeros(len(asked))
    symbol = asked & U(255)
    for j in range(8):
        one = (symbol >> U(7 - j) & U(1)).astype(bool)
        prefix = symbol >> U(8 - j) | U(1 << j)
        at = prefix.astype(np.int64)
        rest, p, last = np.ones(len(asked)), np.zeros(len(asked)), np.full(len(asked), 0.5)
        seen = np.ones(len(asked), bool)
        for found in top:
            estimate, weight = (np.nan, 0.0) if found is None else (found[0][at], found[1][at])
            seen &= ~np.isnan(estimate)
            estimate = np.where(one, estimate, 1 - estimate)
            p = np.where(seen, p + rest * weight * estimate, p)
            rest = np.where(seen, rest * (1 - weight), rest)
            last = np.where(seen, estimate, last)
        for d in range(len(top), depth + 1):
            level = levels.get(d)
            if level is None or not seen.any():
                break
            key = (asked >> U(8 * (depth - d + 1))) << U(8) | prefix
            i = np.minimum(np.searchsorted(level.keys, key), len(level.keys) - 1)
            seen &= level.keys[i] == key
            i = i[seen]
            zeros, ones = level.zeros[i], level.ones[i]
            estimate = np.where(one[seen], ones + 0.5, zeros + 0.5) / (zeros + ones + 1)
            p[seen] += rest[seen] * level.weight[i] * estimate
            rest[seen] *= 1 - level.weight[i]
            last[seen] = estimate
        out += np.log2(p + rest * last)
    return out


# ---- the jobs

def _blocks(held: int, most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, ids, bodies, size, made = TaskContext.get().partitionId() << 24, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal size, made
            row = [pa.array([base + made], pa.int64()), pa.array([sum(fold(i) != held for i in ids)], pa.int64()), pa.array([pack_block(ids, bodies)], pa.binary())]
            made += 1
            ids.clear(), bodies.clear()
            size = 0
            return pa.RecordBatch.from_arrays(row, ["block", "train_docs", "body"])

        for batch in slices(batches, "text"):
            for i, x in zip(batch.column("doc_id").to_pylist(), texts(batch, "text"), strict=True):
                bodies.append(canonical(x))
                ids.append(i)
                size += len(bodies[-1])
                if size >= most:
                    yield flush()
        if ids:
            yield flush()

    return run


def _table(rows: list[tuple], like: str) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [x.split() for x in like.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(names)], [n for n, _ in names])


LISTS = "node long, kind int, part int, items binary, counts binary, n long"
ANSWERS = "node long, kind int, part int, sub int, items binary, values binary"


def _lists(depth: int, buckets: int, held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per block: its grams by subtree (kind 0) and its words by bucket (kind 1), with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
                ids, bodies = unpack_block(blob.as_py())
                rows = [(block, 1, *x) for x in block_words(ids, bodies, buckets, held)]
                keys, counts = block_grams(ids, bodies, depth, held)
                for root, x, c in _cut(keys, counts, 8 * (depth - 1)):
                    rows.append((block, 0, root, squeeze_numbers(x, True), squeeze_numbers(c), len(x)))
                for a in range(0, len(rows), 512):
                    yield from _table(rows[a : a + 512], LISTS).to_batches()
                del ids, bodies, keys, counts, rows
                pa.default_memory_pool().release_unused()

    return run


def _cut(keys: np.ndarray, counts: np.ndarray, shift: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ordered keys with their counts, one piece for each value of the bits from ``shift`` on."""
    root = keys >> U(shift)
    cuts = np.flatnonzero(np.append(True, root[1:] != root[:-1])).tolist() if len(root) else []
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        yield int(root[a]), keys[a:b], counts[a:b]


def _joined_grams(items: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of several lists with summed counts, some lists at a time."""
    keys, sums = [], []
    for i, c in zip(items, counts, strict=True):
        keys.append(numbers(i, True)), sums.append(numbers(c))
        if len(keys) == 32:
            k, n = added(keys, sums)
            keys, sums = [k], [n]
    return added(keys, sums)


def _joined_words(items: list[bytes], counts: list[bytes]) -> dict[str, int]:
    count: dict[str, int] = {}
    for i, c in zip(items, counts, strict=True):
        for w, n in zip(expand(i).decode().split(" "), numbers(c).tolist(), strict=True):
            count[w] = count.get(w, 0) + n
    return count


def _merge(buckets: int) -> Callable[[pa.Table], pa.Table]:
    """One list out of those of a group of nodes: all items with summed counts; words in ``buckets`` finer ones."""

    def run(table: pa.Table) -> pa.Table:
        up, kind, part = (table.column(c)[0].as_py() for c in ("up", "kind", "part"))
        items, counts = table.column("items").to_pylist(), table.column("counts").to_pylist()
        if kind == 0:
            k, c = _joined_grams(items, counts)
            return _table([(up, 0, part, squeeze_numbers(k, True), squeeze_numbers(c), len(k))], LISTS)
        count = _joined_words(items, counts)
        words = pa.array(count, pa.large_string())
        in_bucket = (word_hashes(words) & U(buckets - 1)).astype(np.int32)
        order = np.argsort(in_bucket, kind="stable")
        return _table([(up, 1, *x) for x in word_lists(words, np.fromiter(count.values(), np.int64, len(count)), order, in_bucket[order])], LISTS)

    return run


def _split(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lists of a large subtree by the third byte of the context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, part, items, counts in zip(*(batch.column(c).to_pylist() for c in ("node", "part", "items", "counts")), strict=True):
                rows = [(node, part, sub & 255, squeeze_numbers(x, True), squeeze_numbers(c)) for sub, x, c in _cut(numbers(items, True), numbers(counts), 8 * (depth - 2))]
                yield from _table(rows, "node long, part int, sub int, items binary, counts binary").to_batches()

    return run


def _weigh(depth: int) -> Callable[[pa.Table], pa.Table]:
    """Merge a subtree's lists, and sum up its root for the level above: counts of symbols, ln of the mixtures by bits so far."""

    def run(table: pa.Table) -> pa.Table:
        k, c = _joined_grams(table.column("items").to_pylist(), table.column("counts").to_pylist())
        part, sub = table.column("part")[0].as_py(), table.column("sub")[0].as_py()
        symbols, mixed = np.zeros(256, np.int64), np.zeros(256)
        seen = c > 0
        if seen.any():
            top = 2 if sub < 0 else 3
            root = subtree(k[seen], c[seen], depth, top)[top]
            mixed[(root.keys & U(255)).astype(np.int64)] = root.log_mixed
            symbols = np.bincount((k & U(255)).astype(np.int64), weights=c, minlength=256).astype(np.int64)
        return _table([(part, sub, squeeze_numbers(k, True), squeeze_numbers(c), symbols.tobytes(), mixed.tobytes())], MODEL)

    return run


MODEL = "part int, sub int, items binary, counts binary, symbols binary, mixed binary"


def _above(name: str) -> Callable[[pa.Table], pa.Table]:
    """A context over the subtrees that know one byte more."""

    def run(table: pa.Table) -> pa.Table:
        symbols = sum(np.frombuffer(x, np.int64) for x in table.column("symbols").to_pylist())
        below = sum(np.frombuffer(x, float) for x in table.column("mixed").to_pylist())
        estimate, weight, mixed = dense(symbols, below)
        return _table([(table.column(name)[0].as_py(), *(x.tobytes() for x in (symbols, estimate, weight, mixed)))], ABOVE.format(name))

    return run


ABOVE = "{} int, symbols binary, estimate binary, weight binary, mixed binary"


def _answer(depth: int, whole: tuple[np.ndarray, np.ndarray] | None, single: dict[int, tuple[np.ndarray, np.ndarray]], items: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Log probabilities of the grams of a subtree, each worked out once, then given to each list in its order."""

    def run(model: pa.Table, asked: pa.Table) -> pa.Table:
        part, sub = (asked.column(c)[0].as_py() for c in ("part", "sub"))
        every, c = numbers(model.column("items")[0].as_py(), True), numbers(model.column("counts")[0].as_py())
        top, seen = [None], c > 0
        if whole:
            top = [x for x in (whole, single.get(part >> 8)) if x is not None]
            if sub >= 0 and (pair := model.column("estimate")[0].as_py()) is not None:
                top.append((np.frombuffer(pair), np.frombuffer(model.column("weight")[0].as_py())))
        levels = subtree(every[seen], c[seen], depth, 2 if sub < 0 else 3) if seen.any() else {}
        found = log2_probabilities(every, levels, top, depth)
        return _given([(every, found)], asked, items)

    return run


def _given(answers: list[tuple[np.ndarray, np.ndarray]], asked: pa.Table, items: bool) -> pa.Table:
    every, found = (np.concatenate(x) for x in zip(*answers, strict=True))
    rows = []
    subs = asked.column("sub").to_pylist() if "sub" in asked.column_names else [-1] * asked.num_rows
    for node, part, sub, x in zip(asked.column("node").to_pylist(), asked.column("part").to_pylist(), subs, asked.column("items").to_pylist(), strict=True):
        rows.append((node, 0, part, sub, x if items else None, squeeze_logs(found[np.searchsorted(every, numbers(x, True))])))
    return _table(rows, ANSWERS)


def _tally(items: bool) -> Callable[[pa.Table], pa.Table]:
    """Training counts of a bucket's words over all nodes, sent back to each list in its order; and their number and sum."""

    def run(table: pa.Table) -> pa.Table:
        lists = table.column("items").to_pylist()
        count = _joined_words(lists, table.column("counts").to_pylist())
        stats = [(sum(n > 0 for n in count.values()), sum(count.values())), *[(0, 0)] * (len(lists) - 1)]
        rows = []
        for node, part, x, more in zip(table.column("node").to_pylist(), table.column("part").to_pylist(), lists, stats, strict=True):
            values = squeeze_numbers(np.array([count[w] for w in expand(x).decode().split(" ")], np.int64))
            rows.append((node, 1, part, -1, x if items else None, values, *more))
        return _table(rows, ANSWERS + ", words long, total long")

    return run


def _handed(items: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The answers to a merged list handed down to the lists that went into it."""

    def run(above: pa.Table, asked: pa.Table) -> pa.Table:
        order = sorted(range(above.num_rows), key=above.column("sub").to_pylist().__getitem__)
        lists, values = above.column("items").to_pylist(), above.column("values").to_pylist()
        if asked.column("kind")[0].as_py() == 0:
            return _given([(numbers(lists[i], True), logs(values[i])) for i in order], asked, items)
        count = _joined_words(lists, values)
        rows = []
        for node, part, x in zip(asked.column("node").to_pylist(), asked.column("part").to_pylist(), asked.column("items").to_pylist(), strict=True):
            rows.append((node, 1, part, -1, x if items else None, squeeze_numbers(np.array([count[w] for w in expand(x).decode().split(" ")], np.int64))))
        return _table(rows, ANSWERS)

    return run


def _score(depth: int, buckets: int, held: int, words: int, total: int, ends: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores of a block's texts from the answers to its lists."""

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        ids, bodies = unpack_block(blocks.column("body")[0].as_py())
        kinds, places, subs = (answers.column(c).to_pylist() for c in ("kind", "part", "sub"))
        values = answers.column("values")
        order = sorted(range(len(kinds)), key=lambda i: (kinds[i], places[i], subs[i]))
        answer = np.concatenate([np.empty(0), *[logs(values[i].as_py()) for i in order if kinds[i] == 0]])
        chunks = []
        for a, b in parts(bodies):
            keys, first = grams(bodies[a:b], depth)
            chunks.append((a, b, *ranked(keys), first))
        asked = distinct(np.concatenate([c[2] for c in chunks]))
        found = Words(bodies)
        known = np.zeros(len(found.distinct), np.int64)
        known[found.order(buckets)[0]] = np.concatenate([np.empty(0, np.int64), *[numbers(values[i].as_py()) for i in order if kinds[i] == 1]])
        counts = known[found.codes]
        size = np.log10(total + words + 1)
        each = np.log10(counts + 1) - size
        end = float(np.log10(ends + 1) - size)
        columns: list[list] = [[] for _ in range(7)]
        for a, b, some, where, first in chunks:
            sums = np.add.reduceat(answer[np.searchsorted(asked, some)][where], first)
            for i in range(a, b):
                x, y = found.first[i], found.first[i + 1]
                row = (ids[i], fold(ids[i]) == held, int(y - x) + 1, int(np.count_nonzero(counts[x:y])) + (ends > 0), total, float(each[x:y].sum()) + end, float(sums[i - a]) * float(np.log10(2)))
                for column, v in zip(columns, row, strict=True):
                    column.append(v)
        kinds_ = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds_, strict=True)], [x.split()[0] for x in SCORES.split(", ")])

    return run


def score_documents(docs: DataFrame, depth: int = DEPTH, held: int = 2, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, group: int = GROUP, hot: int = HOT, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: its fold, token counts, base score and model score (log10 of the probability of the text)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks = materialise(docs.mapInArrow(_blocks(held, block), "block long, train_docs long, body binary"))
    n_blocks, ends = blocks.agg(F.count("*"), F.coalesce(F.sum("train_docs"), F.lit(0))).first()

    levels, sizes = [materialise(blocks.select("block", "body").mapInArrow(_lists(depth, buckets, held), LISTS))], [n_blocks]
    up = lambda n: F.pmod(F.xxhash64("node"), F.lit(n)).alias("up")
    while sizes[-1] > group:
        sizes.append(-(-sizes[-1] // group))
        merged = levels[-1].select(up(sizes[-1]), "kind", "part", "items", "counts").groupBy("up", "kind", "part")
        levels.append(materialise(merged.applyInArrow(_merge(buckets * SPLIT ** len(levels)), LISTS)))
    top, several = levels[-1], len(levels) > 1

    tallied = materialise(top.where("kind = 1").groupBy("part").applyInArrow(_tally(several), ANSWERS + ", words long, total long"))
    words, total = tallied.agg(F.coalesce(F.sum("words"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    words, total = words + (ends > 0), total + ends

    some = top.where("kind = 0")
    large = some.groupBy("part").agg(F.sum("n").alias("all")).where(F.col("all") > hot).select("part")
    large = F.broadcast(large)  # one row of an int for each pair of bytes, 65536 at most
    columns = ["node", "part", "sub", "items", "counts"]
    plain = some.join(large, "part", "left_anti").withColumn("sub", F.lit(-1)).select(*columns)
    some = plain.unionByName(some.join(large, "part", "left_semi").mapInArrow(_split(depth), "node long, part int, sub int, items binary, counts binary"))
    if several:
        some = materialise(some)
    model = materialise(some.select("part", "sub", "items", "counts").groupBy("part", "sub").applyInArrow(_weigh(depth), MODEL))
    pairs = model.where("sub >= 0").groupBy("part").applyInArrow(_above("part"), ABOVE.format("part"))
    by_byte = model.where("sub < 0").select("part", "symbols", "mixed").unionByName(pairs.select("part", "symbols", "mixed")).select(F.shiftright("part", 8).alias("byte"), "symbols", "mixed")
    rows = by_byte.groupBy("byte").applyInArrow(_above("byte"), ABOVE.format("byte")).collect()  # 256 at most
    rows = [r for r in rows if any(r["symbols"])]
    single = {r["byte"]: (np.frombuffer(r["estimate"]), np.frombuffer(r["weight"])) for r in rows}
    whole = dense(sum(np.frombuffer(r["symbols"], np.int64) for r in rows), sum(np.frombuffer(r["mixed"], float) for r in rows))[:2] if rows else None

    asked = some.select("node", "part", "sub", "items").groupBy("part", "sub")
    model = model.select("part", "sub", "items", "counts").join(pairs.select("part", "estimate", "weight"), "part", "left")
    answers = model.groupBy("part", "sub").cogroup(asked).applyInArrow(_answer(depth, whole, single, several), ANSWERS).unionByName(tallied.drop("words", "total"))
    for level in reversed(range(len(levels) - 1)):
        coarse = F.when(F.col("kind") == 1, F.col("part").bitwiseAND(buckets * SPLIT**level - 1)).otherwise(F.col("part")).alias("part")
        above = answers.select(F.col("node").alias("up"), "kind", coarse, "sub", "items", "values").groupBy("up", "kind", "part")
        below = levels[level].select(up(sizes[level + 1]), "node", "kind", "part", "items").groupBy("up", "kind", "part")
        answers = above.cogroup(below).applyInArrow(_handed(level > 0), ANSWERS)
    spread = min(4 * n_blocks + 1, MOST_TASKS)  # so that hashing seldom deals several blocks to a task
    asked = answers.select(F.col("node").alias("block"), "kind", "part", "sub", "values").repartition(spread, "block")
    return blocks.select("block", "body").repartition(spread, "block").groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(_score(depth, buckets, held, words, total, ends), SCORES)
