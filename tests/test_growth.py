"""What must not grow faster than its input: each test would have run for minutes, or failed, before."""

import random
import time

import pyarrow as pa
from docspark.functions import text as T
from docspark.operators import chunking, fuzzy, lexical, profile, report, search, shared, substrings, versions
from docspark.operators.shared import folder
from docspark.plans import catalog, extended  # noqa: F401  (the extended queries add to those of the catalog)
from pyspark.sql import functions as F


def test_index_of_one_long_text(spark):
    """Distinct neighbours of a text of 40,000 different words were found by comparing each with each."""
    docs = spark.createDataFrame([(1, " ".join(f"w{i}x" for i in range(40_000))), (2, "a b a b"), (3, "one"), (4, "")], "doc_id long, normal string")
    began = time.time()
    index = substrings.SubstringIndex.build(docs, "doc_id", "normal", folder(spark))
    assert time.time() - began < 60
    got = index.table("pair_docs").groupBy("doc_id").count().collect()
    assert {tuple(r) for r in got} == {(1, 39_999), (2, 2)}
    assert {tuple(r) for r in index.table("pair_docs").where("doc_id = 2").select("head", "tail").collect()} == {("a", "b"), ("b", "a")}


def test_index_is_not_shuffled(spark, tmp_path):
    """Postings were joined with matching words, which took shuffles of the whole index, and it took several times the bytes of its texts."""
    dice = random.Random(5)
    vocabulary = ["".join(dice.choices("aeinrst", k=dice.randint(1, 9))) for _ in range(3000)]
    texts = [(i, " ".join(dice.choices(vocabulary, k=dice.randint(0, 120)))) for i in range(1300)]  # three blocks
    docs = spark.createDataFrame(texts, "doc_id long, normal string").coalesce(1)
    asked = spark.createDataFrame([(i, texts[40 * i][1][5:90]) for i in range(30)], "item_id long, text string")
    index = substrings.SubstringIndex.build(docs, "doc_id", "normal", str(tmp_path / "index"))
    assert sum(f.stat().st_size for f in (tmp_path / "index").rglob("*") if f.is_file()) < sum(len(x) for _, x in texts)
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    terms = sorted({x for _, t in texts[:40] for x in (t[7:11].strip(), " ".join(t.split()[3:5])) if x})
    held, best = index.holding(spark.createDataFrame([(t,) for t in terms], "term string")), index.top_k(asked, 6, "item_id", "text")
    assert exchanges(held) == 0 and exchanges(best) == 1
    assert sorted(map(tuple, held.collect())) == sorted((t, i) for t in terms for i, x in texts if t in x)
    plain = lexical.lexical_top_k(asked, docs, 6, "item_id", "text", "doc_id", "normal")
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, plain.collect())) and best.count() == 180


def test_copies_are_compared_once(spark, monkeypatch):
    """Copies met by each gram, each with its text; now their classes do. Blocks of two put members of a class into several groups."""
    monkeypatch.setattr(fuzzy, "BLOCK", 2)
    dice = random.Random(4)
    rows = [(i, dice.choice([1, 2, None]), dice.choice(["old plate", " Old  PLATE", "cold plate", "cold plates", "", None, "x"])) for i in range(120)] + [(3, 2, "old plate"), (3, 1, "cold plate")]
    df = spark.createDataFrame(rows, "id int, k int, t string")
    want = {(i, j) for i, k, a in rows for j, m, b in rows if k == m and k is not None and fuzzy.alike(a, b, 0.85)}
    got = [tuple(r) for r in fuzzy.alike_pairs(df, df, "id", "t", ["k"], 0.85).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    many = spark.range(6000).select("id", F.lit(1).alias("k"), F.lit("a rather long name").alias("t"))
    plan = fuzzy._alike_classes(*[fuzzy._classes(many, ["k"], "id", "t", 0.85)[1]] * 2, ["k"], 0.85)
    assert plan.count() == 1


def test_rows_without_alike(spark):
    rows = spark.createDataFrame([("a", 1, "old plate"), ("b", 1, "new ring"), ("c", 2, "old plate"), ("d", None, "old plate"), ("e", 1, None)], "row string, k int, text string")
    gone = spark.createDataFrame([(1, "cold plate"), (None, "old plate")], "k int, text string")
    assert {r["row"] for r in fuzzy.without_alike(rows, gone, "row", "text", ["k"], 0.85).collect()} == {"b", "c", "d", "e"}


def test_slices_hold_all_rows_and_few_bytes():
    """A whole Arrow batch became Python objects at once; now about a megabyte of it does."""
    rng = random.Random(2)
    batch = pa.RecordBatch.from_pydict({"i": list(range(5000)), "t": ["x" * rng.choice([0, 1, 900, 40_000]) for _ in range(5000)]})
    cuts = list(shared.slices(batch))
    assert [i for a, b in cuts for i in range(a, b)] == list(range(5000))
    assert all(b == a + 1 or batch.slice(a, b - a).nbytes <= shared.SLICE for a, b in cuts) and len(cuts) > 40
    assert list(shared.slices(batch.slice(0, 0))) == []


def test_chunks_keep_their_keys(spark):
    docs = spark.createDataFrame([("a", "x. " * 900), (None, "one"), ("c", None), ("d", ""), ("e", "y " * 2000)], "k string, text string").coalesce(1)
    got = chunking.recursive_chunks(docs, "k", size=500, overlap=0).collect()
    want = [(k, i, c) for k, t in docs.collect() for i, c in enumerate(chunking.split_recursively(t or "", 500, 0))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and {r["k"] for r in got} == {"a", None, "e"}


def test_hot_bucket_is_dealt(spark, tmp_path):
    """All rows of a bucket were one task's and one file's, however many there were."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        tables = versions.VersionedTables(spark, str(tmp_path), {"t": "k string, x string"}, "k", 4)
        rows = spark.range(0, 80_000, 1, 8).select(F.lit("hot").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("x"))
        change = tables.change()
        change.append("t", rows)
        change.commit()
        files = tables.read("t").groupBy(F.input_file_name()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert sum(r["count"] for r in files) == 80_000 and max(r["count"] for r in files) < 40_000
    assert tables.read("t").exceptAll(rows.withColumn("bucket", tables.bucket(F.col("k")))).count() == 0


def test_distances_beyond_a_block_of_symbols():
    rng = random.Random(8)
    for _ in range(60):
        a, b = ("".join(rng.choices("abcd", k=rng.randint(50, 400))) for _ in range(2))
        before = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
            before = now
        assert profile.edit_distance(a, b) == before[-1]


def test_vectors_travel_as_given(spark):
    """Queries and points were shuffled as doubles, two longer than given."""
    points = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0])], "point_id int, vector array<float>")
    found = search.top_k(points.withColumnRenamed("point_id", "query_id"), points, 2)
    assert {tuple(r) for r in found.collect()} == {(1, 1, 1.0, 1), (1, 5, 1.0, 2), (5, 1, 1.0, 1), (5, 5, 1.0, 2), (2, 2, 1.0, 1), (2, 1, 0.707107, 2), (3, 1, 0.0, 1), (3, 2, 0.0, 2)}
    batch = pa.RecordBatch.from_pydict({"id": [1], "scope": [0], "vector": pa.array([[3.0, 4.0]], pa.list_(pa.float32()))})
    assert [b.column("v").type for b in search._placed({}, 0)(iter([batch]))] == [pa.list_(pa.float32())]


def test_few_removals_need_no_grams(spark, monkeypatch):
    """Each text of a conversation was joined by about half of its grams with one removed text. Both ways must agree."""
    dice = random.Random(6)
    names = ["old plate", " Old  PLATE", "cold plate", "cold plates", "new ring", "", None, "x", "a far longer text of plates", "a far longer text of plate"]
    rows = spark.createDataFrame([(str(i), dice.choice([1, 2, None]), dice.choice(names)) for i in range(200)], "row string, k int, text string")
    gone = spark.createDataFrame([(1, "cold plate"), (1, "X "), (1, None), (2, "a far longer text of plate"), (None, "x")], "k int, text string")
    want = {r["row"] for r in rows.collect() if not any(r["k"] == g["k"] and r["k"] is not None and (fuzzy.form(r["text"]) == fuzzy.form(g["text"]) != "" or fuzzy.alike(r["text"], g["text"], 0.85)) for g in gone.collect())}
    for few in (0, 1, 2):
        monkeypatch.setattr(fuzzy, "FEW", few)
        assert {r["row"] for r in fuzzy.without_alike(rows, gone, "row", "text", ["k"], 0.85).collect()} == want
    monkeypatch.setattr(fuzzy, "_classes", None)  # not called any more
    assert {r["row"] for r in fuzzy.without_alike(rows, gone, "row", "text", ["k"], 0.85).collect()} == want


def test_bounds_keep_every_ratio():
    dice = random.Random(7)
    for _ in range(3000):
        a = "".join(dice.choices("ab cd", k=dice.choice([0, 2, 9, 40, 300])))
        b = "".join(dice.choice(["", c, c, c, c, c, c, c, c, c + "e"]) for c in a) if dice.random() < 0.8 else "".join(dice.choices("ab cd", k=9))
        x, y = fuzzy.form(a), fuzzy.form(b)
        assert fuzzy.alike(a, b, 0.85) == (bool(x) and bool(y) and fuzzy.SequenceMatcher(None, x, y).ratio() >= 0.85)


def test_ranking_is_worked_out_once(spark, sf_dir):
    """All documents were scored for the items of even and once more for those of odd numbers."""
    plan = extended.unseen_results(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("Relation") == 2


def test_slices_are_extracted_once(spark, sf_dir):
    """Sections, lists and each half of the narratives read all texts and matched all patterns by themselves."""
    plan = extended.report_rows(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "split(" not in plan


def test_extraction_passes_over_nothing(spark):
    odd = ["", None, "no. yes! \n\n\nThree?  four\n five.\t\tsix  seven.", "x = 1; You MUST go. We Recommend it", "Water is a thing. It is so = no.", "Figure 2 and Table 10 of NATO, 3.5% 7", "\n\n a.  \n\n b", "Best   practice. best practice"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(odd)], "i int, text string")
    slices = rows.select("i", F.col("i").alias("page_start"), F.col("i").alias("page_end"), "text")
    got = {r["i"]: r for r in report.extracted(slices).collect()}
    body = F.col("text")
    every = lambda pattern: F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)))
    parts = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), r"(?<=[.!?؟۔])\s+|\n{2,}"), T.strip), lambda x: x != "")
    advice = F.filter(parts, lambda x: F.rlike(F.lower(x), F.lit(report.BEFORE + "(?:should|must|recommend|best practice)")))
    said = F.regexp_extract_all(body, F.lit(r"([A-Z][\p{L}]+(?: [\p{L}]+)? is (?:a|an|the) [^.\n]+\.)"), F.lit(1))
    want = rows.select("i", parts.alias("parts"), advice.alias("advice"), every(r"(\w+ = [^\n.;]+)").alias("equations"), every(r"((?:Figure|Table) \d+)").alias("figures"), said.alias("said"))
    for w in want.collect():
        g = got[w["i"]]
        assert (g["key_points"], g["best_practices"], g["equations"], g["figures_tables"]) == (w["parts"][:3], w["advice"], w["equations"], w["figures"])
        assert (g["definitions"] is None) == (w["said"] is None) and len(g["definitions"] or []) == len(w["said"] or [])
    assert got[3]["best_practices"] == ["x = 1; You MUST go.", "We Recommend it"] and got[4]["definitions"][0]["term"] == "Water"
