"""Each stage against a plain version over the smallest table, on what the stage before it kept."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")

import corpus_pipeline  # noqa: E402
from docspark.llm import near_dedup, queries, secrets  # noqa: E402
from docspark.llm.common import ASCII_LOWER, WORD_GAP, materialise, written  # noqa: E402

GAP = re.compile(WORD_GAP)


def words(t):
    return [x for x in GAP.split(t or "") if x]


def repeats(w):
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    return len({i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)})


def ruled(docs):
    """No host of this table fails half the time, so only the base rule rejects."""
    return {d: t for d, t in docs.items() if len(words(t)) >= 50 and 100 * repeats(words(t)) <= 50 * len(words(t))}


def first_copies(docs):
    sets = {}
    for d, t in docs.items():
        w = words(t.translate(ASCII_LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {d: d for d in docs}
    for a in docs:
        for b in docs:
            if a < b and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    return {d: t for d, t in docs.items() if root[d] == d}


def without_repeats(docs):
    raw = {d: t.encode() for d, t in docs.items()}
    count = Counter(b[i : i + 200] for b in raw.values() for i in range(len(b) - 199))
    out = {}
    for d, b in raw.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out[d] = np.frombuffer(b, np.uint8)[~gone].tobytes().decode(errors="ignore") if gone.any() else docs[d]
    return out


def redacted(docs):
    out = {}
    for d, t in docs.items():
        at, parts = 0, []
        for kind, a, b, _, _ in secrets.find(t):
            if a >= at:
                parts += [t[at:a], f"[{kind}]"]
            at = max(at, b)
        out[d] = "".join([*parts, t[at:]])
    return out


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r["doc_id"]: r["text"] for r in docs.collect()}
    for (_, stage), plain in zip(corpus_pipeline.STAGES[:-1], (ruled, first_copies, without_repeats, redacted), strict=True):
        docs, want = materialise(stage(spark, docs, sf_dir)), plain(want)
        assert docs.columns == corpus_pipeline.COLUMNS
        assert {r["doc_id"]: r["text"] for r in docs.collect()} == want
        assert docs.where("n_chars <> length(text)").count() == 0
    t = tokenizers.Tokenizer.from_file(queries.public_tokenizers.path("byte_bpe_50k.json"))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).toPandas().sort_values(["doc_id", "start"])
    for d, g in pieces.groupby("doc_id"):
        assert np.concatenate([np.frombuffer(x, "<u4") for x in g["ids"]]).tolist() == [*t.encode(want.pop(d), add_special_tokens=False).ids, 1]
    assert not want


def test_repeated_rows(spark):
    text = lambda k: " ".join(f"word{k}{i}" for i in range(60))
    rows = [(5, text("a")), (5, text("a")), (5, text("b")), (7, text("b") + " end"), (7, text("c")), (None, text("c") + " end"), (None, text("d")), (None, text("d") + " end"), (None, text("d"))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = materialise(corpus_pipeline.near(spark, docs, ""))
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert Counter(x for x in got if x[0]) == Counter([(5, text("a")), (5, text("b")), (7, text("c"))])
    assert [t.removesuffix(" end") for i, t in got if i is None] == [text("d")]
    # so that the next stage takes nothing
    assert sorted(r["text"] for r in corpus_pipeline.repeats(spark, kept, "").collect()) == sorted(t for _, t in got)


def test_odd_rows(spark):
    """Nulls in any column, a very long text, rows that repeat, and columns named as the operators name theirs."""
    text = lambda k, n=80: " ".join(f"word{k}{i}" for i in range(n))
    long = text("l", 400_000)
    rows = [(1, text("a"), "en", "s", 1), (1, text("a"), "en", "s", 1), (2, None, "en", "s", None), (None, text("b"), None, None, None), (3, "", "", "", 0), (4, long, "en", "s", len(long)), (5, text("c") + " token=abcdefgh12345", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "component", "first", "n", "id", "kept", "spans", "ranges", "body_id", "ids", "host", "key"):
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, ""))
        assert docs.columns == corpus_pipeline.COLUMNS
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert got == {1: text("a"), None: text("b"), 4: long, 5: text("c") + " [assign]"} and docs.count() == 4
    pieces = corpus_pipeline.packed(spark, docs, "").toPandas()
    assert set(pieces["doc_id"].dropna()) == {1, 4, 5} and int(pieces[pieces["doc_id"] == 4]["length"].sum()) == int(pieces[pieces["doc_id"] == 4]["doc_tokens"].iloc[0])


def test_run_keeps_only_what_the_result_reads(spark, sf_dir):
    mark = written()
    got = corpus_pipeline.run(spark, sf_dir)
    assert written() == mark + 1 and got.agg(F.sum("length")).first()[0] > 0


def test_empty(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        assert docs.count() == 0
