"""Collocations, whitening and bin packing against plain versions, on rows that are null, empty, long, tied or repeated."""

import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

from docspark.llm import bin_slack, collocations, queries, whitening  # noqa: E402
from docspark.llm.common import ASCII_LOWER, read_table  # noqa: E402

KIND = "doc_id long, text string, lang string, phrase string, n long, key string, score string"


def rows():
    dice = random.Random(5)
    words = ["new", "york", "city", "of", "the", "a", "B", "é", "Éa", "x y", " "]
    texts = [None, "", " \t", "...", "one", "the of. The of, the\x0bof the\x1fof"]
    texts += [dice.choice([" ", "  ", "\t", ". ", "\n"]).join(dice.choices(words, k=dice.randint(1, 60))) + dice.choice(["", "!", " new york city"]) for _ in range(60)]
    texts += [" ".join(dice.choices(words[:4], k=30_000))] + ["hot pair hot pair"] * 40
    return [(i if i % 9 else None, t, ["en", "de", None, "und", ""][i % 5], "x", 1, "k", "s") for i, t in enumerate(texts)]


def plain_collocations(rows, most, least, first, covered):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(ASCII_LOWER)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            totals["und" if lang is None else lang] += len(w)
            for n in range(1, most + 1):
                counts["und" if lang is None else lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, c in counts.items():
        good = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        ranked = []
        for g, a in good.items():
            longer = [b for h, b in good.items() if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))]
            if any(100 * b >= covered * a for b in longer):
                continue
            score, k = min((10**6 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g)))
            ranked.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:first], 1)]
    return sorted(out)


@pytest.mark.parametrize(("most", "least", "first", "covered"), [(3, 10, 2000, 50), (4, 2, 7, 90), (2, 1, 50, 50)])
def test_collocations(spark, most, least, first, covered, monkeypatch):
    monkeypatch.setattr(collocations, "SLICE", 2000)
    got = collocations.collocations(spark.createDataFrame(rows(), KIND).repartition(3), most, least, first, covered)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {t for _, t in got.dtypes} == {"string", "bigint"}
    found = sorted(map(tuple, got.collect()))
    assert found and found == plain_collocations(rows(), most, least, first, covered)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], KIND)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None, "", 1, "", "")], KIND)).count() == 0


def test_collocation_scores_beyond_64_bits(spark):
    """a * a * 1000000 passes 2**63 here; the score of the pair is a whole million."""
    n = 4_000_000
    docs = spark.range(40).select(F.repeat(F.lit("p q. "), n // 40).alias("text"), F.lit("en").alias("lang"))
    assert list(map(tuple, collocations.collocations(docs).collect())) == [("en", 1, "p q", n, n, n, 2 * n, 10**6)]


def vectors():
    dice = np.random.default_rng(7)
    mix = dice.normal(size=(6, 6))
    good = [(i, (dice.normal(size=6) @ mix).astype(np.float32).tolist(), i % 3, "c") for i in range(300)]
    odd = [(900, None, 1, "c"), (901, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1, "c"), (902, [float("nan")] * 6, 1, "c"), (903, [float("inf")] + [0.0] * 5, 1, "c"), (904, [1.0, 2.0], 1, "c"), (905, [], 1, "c")]
    return [*good, good[3], good[3], (None, good[5][1], 1, "c"), (2**61 + 1, good[8][1], 1, "c"), *odd]


VECTORS = "vec_id long, embedding array<float>, n int, component string"


def test_whitening(spark):
    table = vectors()
    used = [(i, v) for i, v, *_ in table if v is not None and len(v) == 6 and all(x is not None and np.isfinite(x) for x in v)]
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in used]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    moved = [[n * c - s for c, s in zip(v, sums, strict=True)] for v in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in moved), n**3)) for j in range(6)] for i in range(6)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    got = whitening.whiten(spark.createDataFrame(table, VECTORS).repartition(4), most=4).collect()
    assert len(got) == 4 * n and {r["n"] for r in got} == {n}
    assert Counter(r["vec_id"] for r in got) == Counter(i for i, _ in used for _ in range(4))
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == Counter((i, sum(c * c for c in m)) for (i, _), m in zip(used, moved, strict=True) for _ in range(4))
    assert all(0 <= r["identity_error"] < 1e-9 for r in got) and len({r["identity_error"] for r in got}) == 1
    want = np.array([[c / n for c in m] for m in moved]) @ axes / np.sqrt(values)
    for k in range(4):
        assert abs(next(r["explained"] for r in got if r["component"] == k + 1) / (values[k] / cov.trace()) - 1) < 1e-12
        a = sorted(r["whitened"] for r in got if r["component"] == k + 1)
        assert min(np.abs(np.array(a) - np.sort(s * want[:, k])).max() for s in (1, -1)) < 1e-9


def test_whitening_without_variance(spark):
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0], 1, "c") for i in range(5)], VECTORS)).collect()
    assert len(same) == 10 and {(r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in same} == {(0, None, None, None)}
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0], 1, "c") for i in range(5)], VECTORS)).collect()
    assert {r["whitened"] is None for r in flat if r["component"] == 2} == {True} and {r["explained"] for r in flat if r["component"] == 1} == {1.0}
    for none in ([], [(1, None, 1, "c"), (2, [], 1, "c")]):
        assert whitening.whiten(spark.createDataFrame(none, VECTORS)).count() == 0


def test_whitening_of_huge_entries(spark):
    rows_ = [(i, [3e38 * (-1) ** i, float(i), 1e10]) for i in range(6)]
    got = whitening.whiten(spark.createDataFrame(rows_, "vec_id long, embedding array<float>")).collect()
    assert {r["deviation"] for r in got} == {2**63 - 1} and len(got) == 18


def test_fullest_combination():
    dice = random.Random(2)
    for _ in range(200):
        room = dice.randint(0, 40)
        counts = np.zeros(41, np.int64)
        for _ in range(dice.randint(0, 8)):
            counts[dice.randint(1, 40)] += dice.randint(1, 3)
        sums = {0}
        for size in np.repeat(np.arange(41), counts).tolist():
            sums |= {s + size for s in sums}
        found = bin_slack.fullest(counts, room)
        assert sum(size * n for size, n in found) == max(s for s in sums if s <= room)
        assert all(n <= counts[size] for size, n in found) and len(dict(found)) == len(found)


def test_plan_uses_each_piece_once():
    dice = np.random.default_rng(1)
    counts = np.append(0, dice.integers(0, 400, 300))
    steps = bin_slack.plan(counts)
    used = np.zeros_like(counts)
    for times, parts in steps:
        assert times > 0 and sum(size * n for size, n in parts) <= 300
        for size, n in parts:
            used[size] += times * n
    assert (used == counts).all() and len(steps) < 2000
    total = int((counts * np.arange(301)).sum())
    assert sum(t for t, _ in steps) <= 1.02 * total / 300
    assert len(bin_slack.plan(np.bincount([3] * 10**6, minlength=11))) <= 3


def check_pieces(got, docs, tokenizer, window):
    texts = Counter((i, t or "") for i, t, *_ in docs)
    ids = {k: [*tokenizer.encode(k[1], add_special_tokens=False).ids, 0] for k in texts}
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        assert 0 < r["length"] <= window and r["start"] == r["piece"] * window
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    want = Counter()
    for k, x in ids.items():
        for p in range(0, len(x), window):
            want[(k[0], p // window, len(x[p : p + window]), zlib.crc32(np.array(x[p : p + window], "<u4").tobytes()))] += texts[k]
    assert Counter((r["doc_id"], r["piece"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in got) == want
    return len(by_sequence), sum(len(ids[k]) * n for k, n in texts.items())


@pytest.mark.parametrize("window", [64, 2048])
def test_bin_slack(spark, window, monkeypatch):
    monkeypatch.setattr(bin_slack, "SLICE", 3000)
    docs = rows() + [(7, "<|endoftext|> X's \x01 it\x01 42 <|startoftext|>", "en", "", 1, "", ""), (8, "it's ΑΣ Σ ﬁ é é ½ 12a_b\x1cq …!!", "en", "", 1, "", "")]
    got = bin_slack.pack(spark.createDataFrame(docs, KIND).repartition(5), queries.WORD_TOKENIZER, window).collect()
    sequences, total = check_pieces(got, docs, tokenizers.Tokenizer.from_file(queries.WORD_TOKENIZER), window)
    assert sequences <= -(-total // window) + 1


def test_bin_slack_of_nothing(spark):
    assert bin_slack.pack(spark.createDataFrame([], KIND), queries.WORD_TOKENIZER).count() == 0


def test_words_merge_as_plainly():
    bpe = bin_slack.load(queries.WORD_TOKENIZER)
    assert bpe.merger is not None
    dice = random.Random(4)
    letters = "etaonéßñ日́'🙂zqx"
    words = sorted({"".join(dice.choices(letters, k=dice.randint(1, 24))) for _ in range(4000)} | {"a" * 500, "abc" * 300})
    plain = [np.array([i for w in bpe.words(c) for i in bpe.word(w)], "<u4").tobytes() for c in words]
    bpe.known.clear()
    bpe.learn(words)
    assert [bpe.known[c] for c in words] == plain
    bpe.known.clear()


def test_bin_slack_query(spark, sf_dir):
    got = queries.op13_bin_slack(spark, sf_dir)
    assert got.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    docs = [(r["doc_id"], r["text"]) for r in read_table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    t = tokenizers.Tokenizer.from_file(queries.WORD_TOKENIZER)
    t.no_padding(), t.no_truncation()
    want = Counter()
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.update((i, p // 2048, zlib.crc32(np.array(ids[p : p + 2048], "<u4").tobytes())) for p in range(0, len(ids), 2048))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got.collect()) == want
