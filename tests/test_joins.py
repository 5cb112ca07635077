"""Numbering with hot keys, fuzzy joins and error rates against plain versions."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from docspark.operators import fuzzy, numbering, profile
from docspark.plans import catalog


def test_numbering_of_a_hot_key(spark):
    """One key holds 90 % of the rows; no range holds twice the median."""
    rows = spark.range(6000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 70).cast("string"))).alias("k"), F.xxhash64("id").alias("o"), "id").repartition(5)
    got = numbering.numbered_within(rows, ["k"], ["o", "id"], "n", "total", parts=16)
    by = {}
    for r in rows.collect():
        by.setdefault(r["k"], []).append((r["o"], r["id"]))
    want = {(k, i, n, len(v)) for k, v in by.items() for n, (_, i) in enumerate(sorted(v), 1)}
    assert {(r["k"], r["id"], r["n"], r["total"]) for r in got.collect()} == want
    sizes = sorted(r["count"] for r in numbering.dealt(rows, ["k"], ["o", "id"], 16).groupBy("_part").count().collect())
    assert len(sizes) >= 12 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_running_sums_with_null_keys(spark):
    rows = [(None, 1, 5), (None, 2, 7), ("a", 2, 1), ("a", 1, 3), ("a", 3, -2)]
    df = spark.createDataFrame(rows, "k string, o int, v int")
    got = numbering.running(df, ["k"], ["o"], {"s": F.col("v")}, {"t": F.col("v")}, parts=3)
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 1, 5, 5, 12), (None, 2, 7, 12, 12), ("a", 1, 3, 3, 2), ("a", 2, 1, 4, 2), ("a", 3, -2, 2, 2)], key=str)
    assert numbering.numbered_within(df.where("false"), ["k"], ["o"], "n").count() == 0


@pytest.mark.parametrize("least", [0.4, 0.7, 0.92])
def test_alike_pairs_equal_brute_force(spark, least):
    dice = random.Random(int(least * 100))
    texts = ["".join(dice.choices("abc de", k=dice.randint(0, 30))) for _ in range(60)]
    for x in texts[:40]:
        y = list(x)
        for _ in range(dice.randint(0, 4)):
            y.insert(dice.randint(0, len(y)), dice.choice("abx "))
        texts.append("".join(y).upper())
    rows = [(i, t if i % 17 else None, "k1" if i % 3 else "k2") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string, conv string").repartition(3)
    got = {tuple(r) for r in fuzzy.alike_pairs(df, df, "id", "text", ["conv"], least).collect()}
    form = lambda x: " ".join((x or "").strip().lower().split())
    want = {(i, j) for i, a, k in rows for j, b, m in rows if k == m and form(a) and form(b) and SequenceMatcher(None, form(a), form(b)).ratio() >= least}
    assert got == want and len(want) > 100


def test_near_bounds_never_miss():
    dice = random.Random(9)
    met = 0
    for least in (0.3, 0.5, 0.66, 0.68, 0.75, 0.92, 0.99):
        for _ in range(1500):
            a = "".join(dice.choices("abcd ", k=dice.randint(1, 25)))
            b = "".join(c for c in a if dice.random() < least) + "".join(dice.choices("ab", k=dice.randint(0, 2)))
            x, y = fuzzy.form(a), fuzzy.form(b)
            if x and y and SequenceMatcher(None, x, y).ratio() >= least:
                met += 1
                assert set(fuzzy.signs(x, least)) & set(fuzzy.signs(y, least)), (x, y, least)
    assert met > 500


def test_pairs_of_all_facts(spark, sf_dir):
    facts = [(r["p_partkey"], r["p_size"], fuzzy.form(r["p_name"])) for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect()]
    want = {(i, j) for i, k, a in facts for j, m, b in facts if i < j and k == m and SequenceMatcher(None, a, b).ratio() >= 0.85}
    assert want and {tuple(r) for r in catalog.QUERIES["fact_alike_pairs"](spark, sf_dir).collect()} == want


def plain_distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]


def test_edit_distance_equals_the_table():
    dice = random.Random(1)
    for _ in range(600):
        a, b = ("".join(dice.choices("abc", k=dice.randint(0, 90))) for _ in range(2))
        assert profile.edit_distance(a, b) == plain_distance(a, b)
        assert profile.edit_distance(list(a), list(a + b)) == len(b)
    words = [str(dice.randint(0, 10**6)) for _ in range(20_000)]
    other = words.copy()
    for i in range(0, 20_000, 100):
        other[i] = "edit"
    assert profile.edit_distance(words, other) == 200 and profile.edit_distance(words, words[5:] + ["x"]) == 6


@pytest.mark.parametrize(("r", "h", "cer", "wer"), [("\nabc\t", "abc", 0.0, 0.0), ("", "", 0.0, 0.0), (None, "x", 1.0, 1.0), ("a b", "", 1.0, 1.0), (" ab cd", "ab ce", 0.2, 0.5)])
def test_error_rates(spark, r, h, cer, wer):
    df = spark.createDataFrame([(r, h)], "r string, h string")
    got = profile.word_error_rate(df, "r", "h").withColumn("cer", profile.char_error_rate("r", "h")).first()
    assert (got["cer"], got["wer"]) == (cer, wer)


def test_document_error_rates(spark, sf_dir):
    docs = {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        docs.setdefault(r["source"], []).append((r["doc_id"], r["text"]))
    got = {r["doc_id"]: (r["cer"], r["wer"]) for r in catalog.QUERIES["document_error_rates"](spark, sf_dir).collect()}
    pairs = {a[0]: (a[1], b[1]) for rows in docs.values() for a, b in zip(rows, rows[1:], strict=False)}
    assert set(got) == set(pairs)
    for i in [i for i, (a, b) in pairs.items() if len(a) * len(b) < 400_000][:40]:
        a, b = pairs[i]
        assert got[i] == (round(plain_distance(a.strip(), b.strip()) / len(a.strip()), 9), round(plain_distance(a.split(), b.split()) / len(a.split()), 9))
    assert Counter(got)  # every pair has both rates


@pytest.mark.parametrize("span", [4, 4096])
def test_page_packing_equals_a_plain_version(spark, monkeypatch, span):
    """One source holds nearly all pages; some pages are blank, some longer than a slice."""
    from docspark.operators import report

    monkeypatch.setattr(report, "SPAN", span)
    dice = random.Random(6)
    rows = [("hot", i, dice.choice("abcd") * dice.choice([0, 1, 2, 9, 20, 30, 31, 70])) for i in range(400)]
    rows += [("one", 3, "x"), ("blank", 1, ""), ("null", 1, None), ("two", 1, "y" * 99), ("two", 2, "z")]
    want = []
    for doc in {r[0] for r in rows}:
        held, first, last, no = "", None, None, 0
        for _, page, text in sorted(r for r in rows if r[0] == doc and r[2]):
            if held and len(held) + 2 + len(text) > 60:
                want.append((doc, no, first, last, held))
                held, first, no = "", None, no + 1
            held, first, last = f"{held}\n\n{text}" if held else text, page if first is None else first, page
        if held:
            want.append((doc, no, first, last, held))
    df = spark.createDataFrame(rows, "doc string, page int, text string").repartition(5)
    assert sorted(map(tuple, report.packed_pages(df, "doc", "page", "text", 60).collect())) == sorted(want)


def test_splitters_in_sql(spark, sf_dir):
    from docspark.operators import chunking
    from docspark.plans import table_functions

    table_functions.register(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.createOrReplaceTempView("some_docs")
    got = spark.sql("SELECT doc_id, pos, chunk FROM some_docs, LATERAL recursive_chunks(text, 700, 150)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunking.recursive_chunks(docs, "doc_id", size=700, overlap=150).collect()))
    got = spark.sql("SELECT doc_id, pos, chunk FROM some_docs, LATERAL hybrid_chunks(text)")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunking.hybrid_chunks(docs, "doc_id").collect()))
    assert spark.sql("SELECT * FROM recursive_chunks(CAST(null AS STRING))").count() == 0
    with pytest.raises(Exception, match="takes a text and whole numbers"):
        spark.sql("SELECT * FROM recursive_chunks('a', 'b')").collect()


def test_damaged_files_are_their_own_errors(spark):
    """A damaged stream, a password and an unknown method in an archive: each file says so, and the others are read."""
    import io
    import zipfile

    from docspark.sources import files, validation

    def archive(change):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("word/document.xml", "<w:document xmlns:w='http://schemas.openxmlformats.org/wordprocessingml/2006/main'>" + "<w:p/>" * 50 + "</w:document>")
        return change(bytearray(out.getvalue()))

    def broken(data):
        data[60:75] = b"\xff" * 15
        return data

    def flagged(data):
        data[6] |= 1
        at = data.rindex(b"PK\x01\x02")
        data[at + 8] |= 1
        return data

    def method(data):
        at = data.rindex(b"PK\x01\x02")
        data[8] = data[at + 10] = 77
        return data

    up = [(f"{n}.docx", archive(f)) for n, f in (("broken", broken), ("password", flagged), ("method", method))] + [("fine.txt", bytearray(b"Some plain text that is read."))]
    got = {r["filename"]: (r["error"], r["text"]) for r in files.load(spark.createDataFrame([(n, n, c) for n, c in up], "path string, filename string, content binary")).collect()}
    assert set(got) == {n for n, _ in up} and got["fine.txt"][1].startswith("Some plain") and all(got[n][0] for n, _ in up[:3])
    kinds = spark.createDataFrame([("a.doc",), ("a.docx",), ("a",)], "n string").select(validation.content_type(F.col("n")), validation.file_type(F.col("n"))).collect()
    assert [tuple(k) for k in kinds] == [("application/msword", "doc"), ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "docx"), ("application/octet-stream", "unknown")]


def test_lines_end_where_they_do_elsewhere(spark):
    from docspark.operators import ocr_text

    text = "one\x0btwo\x0cthree\x1cfour\x1dfive\x1esix\x85seven eight nine\r\none"
    got = ocr_text.clean_answers(spark.createDataFrame([(1, text, "en")], "k int, t string, lang string"), "k", "t", "lang").first()["answer"]
    assert got == "one\ntwo\nthree\nfour\nfive\nsix\nseven\neight\nnine"


def test_report_targets_without_a_dot():
    from docspark.operators.router import resolve_report_target

    assert resolve_report_target(["x"], "xyz", None) == ("x", None) and resolve_report_target(["a.pdf", "xyz"], "the xyz file", None) == ("xyz", None)
