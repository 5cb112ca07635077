"""MinHash near-dedup with sequential Bayesian verification.

A document's set holds the hashes of its distinct five-word shingles. Documents with equal sets form a class; one MinHash signature per
class is cut into bands, and classes that share a band are candidates. Signatures are compared batch by batch: a pair drops out once
the posterior probability that its similarity reaches the threshold is below ``MISS``; pairs that last are verified on the full sets.

No bucket is expanded into all its pairs. Each bucket links its members to one of them; these pairs are verified and give first
components. Only buckets whose other members still lie in several components are taken up again, in blocks of bounded size: pairs
between components are compared and verified there, each in the first band that brings it together, and only new links leave the task. So a large group of near copies costs a pair per member, and no link between different texts that
the bands can see is lost: 32 bands of 4 rows miss a pair at the threshold with a probability below 0.00001.

Defined cases: a text with fewer words than a shingle is one shingle; null texts and texts without words have empty sets and link with
nothing; a row without an id is in no component (null) and kept; rows that share an id are judged by their own texts; the least id
of a component is its name; a similarity of just the threshold links; a text of any length is one row's set; repeated rows are one
class and each gets its row back; an empty table gives no rows; only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

WORDS, PERCENT = 5, 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-5
BLOCK = 512
#: Bytes of text hashed together, so that arrays stay in a core's cache; words longer than this are hashed one by one.
SLICE, LONG = 1 << 17, 64
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0xD1342543DE82EF95
_up = _down = np.empty(0, np.uint64)
_dice = np.random.default_rng(20240501)
_XOR, _ODD = _dice.integers(0, 2**32, HASHES, np.uint32)[:, None], (_dice.integers(0, 2**31, HASHES, np.uint32) * 2 + 1)[:, None]
_MIX, _ODD_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse, modulo 2**64."""
    global _up, _down
    if len(_up) < n:
        _up, _down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        _up[0] = _down[0] = 1
        np.multiply.accumulate(_up, out=_up), np.multiply.accumulate(_down, out=_down)
    return _up[:n], _down[:n]


def word_hashes(raw: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of texts that lie one after the other, and the number of words before each text and in all.

    ``begins`` says where each text begins, and where the last ends. Hashes are polynomials of the lower-cased bytes, taken from
    running sums, and mixed; for words of over ``LONG`` bytes they are made of the word by itself.
    """
    low = raw.lower()
    data = np.frombuffer(low, np.uint8)
    n = len(data)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = _IS_GAP[data]
    begin = np.zeros(n + 1, bool)
    begin[begins] = True
    start = np.flatnonzero(~gap[1:] & (gap[:-1] | begin))
    stop = np.flatnonzero(~gap[:-1] & (gap[1:] | begin))
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[:-1], dtype=np.uint64, out=total[1:])
    h = (total[stop] - total[start]) * down[start]
    size = stop - start
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(low[start[i] : stop[i]])
    h = (h ^ h >> np.uint64(31) ^ size.astype(np.uint64)) * _MIX
    h ^= h >> np.uint64(29)
    return h * _ODD_MIX, np.searchsorted(start, begins)


def shingle_sets(column: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text; null as empty."""
    texts_ = [(x or "").encode() for x in column.to_pylist()]
    h, first = word_hashes(b"".join(texts_), np.cumsum([0, *map(len, texts_)]))

    def mixed(n: int, size: int) -> np.ndarray:
        out = np.full(n, size, np.uint64)
        for k in range(size):
            out = (out ^ h[k : k + n]) * _MIX
            out ^= out >> np.uint64(32)
        return out

    every = mixed(max(len(h) - words + 1, 0), words)
    sets = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= words:
            sets.append(np.unique(every[a : b - words + 1]))
        else:
            out = np.full(min(b - a, 1), b - a, np.uint64)
            for k in range(a, b):
                out = (out ^ h[k]) * _MIX
                out ^= out >> np.uint64(32)
            sets.append(out)
    return sets


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    low = (hashes ^ hashes >> np.uint64(32)).astype(np.uint32)
    return np.minimum.reduce([((low[a : a + 2048] ^ _XOR) * _ODD).min(axis=1) for a in range(0, len(low), 2048)])


def least_matches(total: int, percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For 32, 64, ... compared hashes: the matches below which the posterior (uniform prior) of the threshold is under ``miss``.

    With a beta posterior of whole parameters, P(similarity >= t | m of n match) is the chance of at most m successes in n + 1 trials of
    probability t. Signatures keep one byte per hash, so unlike sets agree once in 256 and t is raised accordingly.
    """
    t = percent / 100
    t += (1 - t) / 256
    out = []
    for n in range(BATCH, total + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


LIMITS = least_matches(HASHES)


def survives(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which pairs of signature rows last through all batches."""
    alive, matches = np.arange(len(left)), np.zeros(len(left), np.int32)
    for i, limit in enumerate(LIMITS):
        part = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + np.count_nonzero(left[alive, part] == right[alive, part], axis=1)
        lasting = matches >= limit
        alive, matches = alive[lasting], matches[lasting]
    return alive


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        counts, prints, signs, bands = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            counts.append(len(s))
            if not len(s):
                prints.append(None), signs.append(None), bands.append(None)
                continue
            prints.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
            sig = signature(s)
            signs.append((sig & 0xFF).astype(np.uint8).tobytes())
            keys = sig.reshape(BANDS, ROWS)
            bands.append([int.from_bytes(xxhash.xxh3_64_digest(k.tobytes(), seed=i), "big", signed=True) for i, k in enumerate(keys)])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(prints, pa.string()), pa.array(signs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "n_shingles", "print", "sig", "bands"],
        )


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, sig_a, sig_b) that Bayesian verification lets through."""
    for batch in batches:
        left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        rows = pa.array(survives(left, right))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], ["a", "b"])


def _between(table: pa.Table) -> pa.Table:
    """Links between components within one pair of blocks of a bucket; pairs that an earlier band brings together are left to it."""
    side, label = np.array(table.column("side").to_pylist()), np.array(table.column("label").to_pylist(), object)
    names, sigs = table.column("print").to_pylist(), np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
    bands, key = np.array(table.column("bands").to_pylist(), np.int64), table.column("key")[0].as_py()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("members").to_pylist()]
    sizes = np.array([len(x) for x in sets])
    earlier = np.arange(BANDS) < np.argmax(bands == key, axis=1)[:, None]
    same = table.column("x")[0].as_py() == table.column("y")[0].as_py()
    order = {x: i for i, x in enumerate(dict.fromkeys(label))}
    group = np.array([order[x] for x in label])  # components as far as this task knows them
    found: list[tuple[str, str]] = []
    for r in range(len(side)) if same else np.flatnonzero(side == 0):
        others = np.arange(r + 1, len(side)) if same else np.flatnonzero(side == 1)
        others = others[group[others] != group[r]]
        others = others[~((bands[others] == bands[r]) & earlier[r]).any(axis=1)]
        if not len(others):
            continue
        others = others[survives(np.broadcast_to(sigs[r], (len(others), HASHES)), sigs[others])]
        if not len(others):
            continue
        every = np.concatenate([sets[i] for i in others])
        at = np.minimum(np.searchsorted(sets[r], every), sizes[r] - 1)
        both = np.add.reduceat(sets[r][at] == every, np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        for i in others[100 * both >= PERCENT * (sizes[others] + sizes[r] - both)]:
            if group[i] != group[r]:
                group[group == group[i]] = group[r]
                found.append((min(names[r], names[i]), max(names[r], names[i])))
    return pa.table([pa.array([p[i] for p in found], pa.string()) for i in (0, 1)], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        found = shingle_sets(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in found], pa.string()), pa.array([s.tobytes() for s in found], pa.binary())], ["print", "members"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, set_a, set_b) whose sets reach the threshold."""
    for batch in batches:
        good = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(100 * both >= PERCENT * (len(p) + len(q) - both))
        rows = pa.array(np.flatnonzero(good))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(rows), batch.column("b").take(rows)], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for all nodes of ``edges`` (a, b): the least node of each component, by alternating large and small stars.

    Each round is one table in the shared folder; the number of rounds grows with the logarithm of the longest chain.
    """
    now, state = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()), None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialise(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
        now = materialise(small.where("u <> v").distinct())
        found = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found == state:
            break
        state = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    left, right = sets.select(F.col("print").alias("a"), F.col("members").alias("set_a")), sets.select(F.col("print").alias("b"), F.col("members").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm, "a string, b string")


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketches = materialise(docs.mapInArrow(_sketch, "doc_id long, n_shingles long, print string, sig binary, bands array<long>"))
    linkable = sketches.where("print is not null and doc_id is not null")
    classes = materialise(linkable.groupBy("print").agg(F.min("doc_id").alias("rep"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands")))
    rows = classes.select("print", F.explode("bands").alias("key"))
    buckets = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("print").alias("head")).where("n > 1").select("key", "head")
    members = materialise(rows.join(buckets, "key").where("print <> head").select("key", "head", "print"))

    sigs = classes.select("print", "sig")
    pairs = members.select(F.col("head").alias("a"), F.col("print").alias("b")).distinct()
    pairs = pairs.join(sigs.select(F.col("print").alias("a"), F.col("sig").alias("sig_a")), "a").join(sigs.select(F.col("print").alias("b"), F.col("sig").alias("sig_b")), "b")
    likely = materialise(pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(_likely, "a string, b string"))

    involved = members.select("print").union(members.select(F.col("head").alias("print"))).distinct()
    wanted = involved.join(classes.select("print", F.col("rep").alias("doc_id")), "print").select("doc_id", "print")
    held = docs.join(wanted.select("doc_id").distinct(), "doc_id").select("text").mapInArrow(_sets, "print string, members binary")
    sets = materialise(held.join(wanted.select("print"), "print").groupBy("print").agg(F.any_value("members").alias("members")))
    first = materialise(_verified(likely, sets))

    labels = components(first)
    marked = materialise(members.join(labels, members["print"] == labels["node"], "left").select("key", "print", F.coalesce("root", "print").alias("label")))
    # buckets whose members besides the head lie in several components
    several = marked.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q")
    several = several.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = marked.join(several, "key").withColumn("mine", F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int"))
    dealt = dealt.join(classes.select("print", "sig", "bands"), "print").join(sets, "print")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ends = [F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), (F.col("mine") > F.col("other")).cast("int").alias("side")]
    dealt = dealt.select("key", "print", "label", "sig", "bands", "members", *ends)
    names = components(first.union(materialise(dealt.groupBy("key", "x", "y").applyInArrow(_between, "a string, b string"))))

    named = classes.select("print", "rep").join(names, F.col("print") == F.col("node"), "left").select("print", "rep", F.coalesce("root", "print").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    found = named.join(least, "root").select("print", "component")
    out = sketches.select("doc_id", "n_shingles", "print").join(found, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
