"""Vector and lexical search against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.operators import lexical, search


def plain_top_k(queries, points, k, scoped):
    unit = lambda v: np.array(v, float) / (np.linalg.norm(v) or 1)
    fine = lambda v: v is not None and None not in v and np.isfinite(v).all()
    out = []
    for q, v, s in queries:
        if not fine(v) or scoped and s is None:
            continue
        hits = [(-round(float(unit(v) @ unit(w)), 6) + 0.0, p) for p, w, t in points if fine(w) and len(w) == len(v) and (not scoped or s == t)]
        out += [(q, p, -x + 0.0, i) for i, (x, p) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("scoped", [False, True])
@pytest.mark.parametrize("blocks", [(7, 5, 4), (16384, 4096, 64)])
def test_top_k_equals_a_plain_version(spark, monkeypatch, scoped, blocks):
    for name, n in zip(("BLOCK_POINTS", "BLOCK_QUERIES", "PIVOTS"), blocks, strict=True):
        monkeypatch.setattr(search, name, n)
    dice = np.random.default_rng(3)
    centres = dice.normal(size=(5, 8)) * 4
    near = lambda: (centres[dice.integers(5)] + dice.normal(size=8)).round(3).tolist()
    points = [(i, near(), "abc"[i % 3] if i % 11 else None) for i in range(150)]
    points += [(200 + i, points[1][1], "a") for i in range(60)] + [(300 + i, [0.0] * 8, "b") for i in range(9)]
    points += [(400, None, "a"), (401, [1.0, None] * 4, "a"), (402, [float("nan")] * 8, "b"), (403, [1.0, 2.0], "a"), (404, [2.0, 1.0], "b"), (405, [0.0, 0.0], "b")]
    queries = [(i, near(), "abcd"[i % 4]) for i in range(40)] + [(50 + i, points[1][1], "a") for i in range(20)]
    queries += [(80, [0.0] * 8, "b"), (81, [0.0] * 8, "b"), (82, [1.0, 1.0], "b"), (83, [1.0] * 3, "b"), (84, None, "a"), (85, near(), None), (86, [float("inf")] * 8, "a")]
    ask, held = (spark.createDataFrame(rows, f"{name} long, vector array<double>, scope string").repartition(3) for rows, name in ((queries, "query_id"), (points, "point_id")))
    got = search.top_k(ask, held, 4, "scope" if scoped else None)
    assert sorted((r["query_id"], r["point_id"], round(r["score"], 6), r["rank"]) for r in got.collect()) == plain_top_k(queries, points, 4, scoped)


def test_top_k_of_names_and_of_nothing(spark):
    kinds = "{} string, vector array<float>"
    held = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("é", [0.0, 1.0])], kinds.format("point_id"))
    ask = spark.createDataFrame([("q", [1.0, 0.0]), ("q", [0.0, 2.0])], kinds.format("query_id"))
    assert sorted(map(tuple, search.top_k(ask, held, 2).collect())) == [("q", "a", 0.0, 2), ("q", "a", 1.0, 1), ("q", "b", 1.0, 2), ("q", "é", 1.0, 1)]
    assert search.top_k(ask, held.where("false"), 2).count() == 0 and search.top_k(ask.where("false"), held, 2).count() == 0


def test_cells_are_pruned(spark):
    """Queries of one cluster leave the points of far ones alone."""
    dice = np.random.default_rng(1)
    axes = np.eye(8)
    rows = [(i, (axes[i % 8] + dice.normal(size=8) * 0.01).tolist()) for i in range(800)]
    held = spark.createDataFrame(rows, "point_id long, vector array<double>")
    seen = []
    met = search._met

    def counted(asked, *rest):
        seen.append(asked.count())
        return met(asked, *rest)

    search._met = counted
    try:
        search.top_k(held.withColumnRenamed("point_id", "query_id"), held, 5).count()
    finally:
        search._met = met
    assert seen[0] == 800 and seen[1] < 800 * 63 / 4


def test_substring_index_equals_a_plain_version(spark, tmp_path):
    from docspark.functions import text as T
    from docspark.operators.substrings import SubstringIndex

    dice = random.Random(8)
    word = lambda: "".join(dice.choices("abcé", k=dice.randint(1, 5)))
    texts = [(i, " ".join(word() for _ in range(dice.randint(0, 40)))) for i in range(80)] + [(90, None), (91, "solo"), (92, "x y x y x y")]
    asked = [(i, " ".join(word() for _ in range(dice.randint(1, 9)))) for i in range(25)] + [(50, "zzz absent"), (51, ""), (52, None), (53, texts[3][1]), (54, "ab ab ab")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("normal", T.normalize(F.col("text"))).repartition(3)
    queries = spark.createDataFrame(asked, "item_id long, text string")
    index = SubstringIndex.build(docs, "doc_id", "normal", str(tmp_path / "index"))
    terms = sorted({"".join(p) for p in (dice.choices("abcé", k=3) for _ in range(30))} | {f"{word()} {word()}" for _ in range(60)})
    want = sorted((t, i) for t in terms for i, x in texts if t in (x or ""))
    assert len(want) > 50 and sorted(map(tuple, index.holding(spark.createDataFrame([(t,) for t in terms], "term string")).collect())) == want
    got = index.top_k(queries, 5, "item_id", "text")
    plain = lexical.lexical_top_k(queries, docs, 5, "item_id", "text", "doc_id", "normal")
    shape = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    assert shape(got) == shape(plain) and len(shape(got)) == 5 * len(asked)


def test_substring_index_reads_matching_postings_only(spark, tmp_path):
    from docspark.operators.substrings import SubstringIndex

    docs = spark.createDataFrame([(i, f"word{i} other{i}") for i in range(300)], "doc_id long, normal string")
    index = SubstringIndex.build(docs, "doc_id", "normal", str(tmp_path / "index"))
    found = index.matching(spark.createDataFrame([("word17", "any"), ("r299", "end"), ("oth", "begin"), ("qqq", "any")], "atom string, kind string"))
    by = {}
    for r in found.collect():
        by.setdefault(r["atom"], []).append(r["word"])
    assert sorted(by["word17"]) == sorted(["word17", *[f"word{i}" for i in range(170, 180)]]) and by["r299"] == ["other299"] and len(by["oth"]) == 300 and "qqq" not in by
    assert "normal" not in {c for t in ("words", "grams", "pairs", "pair_docs", "docs") for c in index.table(t).columns}
