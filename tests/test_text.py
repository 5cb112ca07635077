import random
import re

import pytest
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import chunking, memory, ocr_text, ranking, router, search


def value(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("hello", "en"), ("مرحبا", "ar"), ("abc مرح", "ar"), ("abcd مرح", "en"), ("123", "en"), ("", "en"), (None, "en")],
)
def test_language(spark, text, want):
    assert value(spark, text, T.detect_language) == want


@pytest.mark.parametrize(("text", "want"), [("أَحْمَد؛ إلى المدرسةِ!", "احمد؛ الي المدرسه"), ("مؤمن ـــ شيئ", "مومن شيي"), (None, ""), ("", "")])
def test_normalize_arabic(spark, text, want):
    assert value(spark, text, T.normalize_arabic) == want


def test_normal_and_loose_forms(spark):
    assert value(spark, "  Café-au lait_2, Ünder!  ", T.normalize) == "café au lait_2 ünder"
    assert value(spark, "Café au LAIT", T.loose_latin) == "caf au lait"
    assert value(spark, "المدرسة والبيت", T.loose_arabic) == "مدرسه والبيت"


def test_keywords_and_ngrams(spark):
    assert value(spark, "What is the difference between cats and dogs", lambda c: T.keywords(c, F.lit("en"))) == ["cats", "dogs"]
    assert value(spark, "one two three", lambda c: T.ngrams(T.words(T.normalize(c)))) == ["one two", "two three"]
    assert value(spark, "one", lambda c: T.ngrams(T.words(T.normalize(c)))) == []


@pytest.mark.parametrize(("text", "want"), [("192.168.0.1", True), ("hello", False), ("err-404", True), ("what is 4", False), ("", False), (None, False)])
def test_code_like(spark, text, want):
    assert value(spark, text, T.is_code_like) is want


def test_sentences(spark):
    assert value(spark, "One. Two!  Three؟ four\n\n\nfive 1.5 x", T.sentences) == ["One.", "Two!", "Three؟", "four", "five 1.5 x"]


def test_salvage_json(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```',), ('well: {"a": 2} done',), ("nothing",)], "t string")
    got = df.select(F.to_json(T.salvage_json(F.col("t"))).alias("v")).collect()
    assert [r["v"] for r in got] == ['{"a":1}', '{"a":2}', None]


@pytest.mark.parametrize(("text", "want"), [("Hello!!", "greeting"), ("thank you.", "thanks"), ("شكرا؟", "thanks"), ("what did I ask?", "memory"), ("explain tcp", None), ("", None), (None, None)])
def test_small_talk(spark, text, want):
    assert value(spark, text, router.small_talk) == want


def test_report_target():
    files = ["networks.pdf", "algebra.docx"]
    assert router.resolve_report_target(files, "NETWORKS.pdf", None) == ("networks.pdf", None)
    assert router.resolve_report_target(files, "the algebra notes", None) == ("algebra.docx", None)
    assert router.resolve_report_target(files, "zzz", None) == (None, None)
    assert router.resolve_report_target(files, None, "algebra.docx") == ("algebra.docx", None)
    assert router.resolve_report_target(files, None, None) == (None, files)


def test_variants(spark):
    assert value(spark, "  What's UP? ", search.variants) == ["What's UP?", "what s up", "what's up?"]
    assert value(spark, "", search.variants) == []


def test_recursive_split():
    text = "aaa. bbb. ccc\n\nddd eee fff"
    chunks = chunking.split_recursively(text, 10, 0)
    assert all(len(c) <= 10 for c in chunks)
    assert "".join("".join(chunks).split()) == "".join(text.split())
    assert chunking.split_recursively("", 10, 0) == []
    assert chunking.split_recursively("x" * 25, 10, 3)[0] == "x" * 10
    assert len(chunking.split_recursively("word " * 100, 50, 15)) > 10


def test_mmr_takes_lowest_index_among_ties_and_equals_top_n_without_diversity():
    import numpy as np

    scores, vectors = np.array([1.0, 0.9, 0.9, 0.1]), np.array([[1, 0], [1, 0], [0, 1], [0, 1]], float)
    assert ranking.select_diverse(scores, vectors, 2, 0.7) == [0, 2]
    assert ranking.select_diverse(scores, vectors, 3, 1.0) == [0, 1, 2]


def test_fact_similarity():
    assert memory.alike("Prefers tea in the morning", "prefers  tea in the mornings")
    assert not memory.alike("email Ahmed", "email Sara")
    assert not memory.alike("", "x")


def test_fact_merge(spark):
    kind = "conversation_id string, pos int, text string, category string, importance int, updated_at timestamp"
    import datetime as dt

    t = dt.datetime(2024, 1, 1)
    stored = spark.createDataFrame([("c", 0, "likes tea", "fact", 3, t), ("c", 1, "works in Rome", "fact", 3, t)], kind)
    new = spark.createDataFrame([("c", 0, "likes teas", "fact", 5, t), ("c", 1, "has a cat", "fact", 2, t)], kind)
    gone = spark.createDataFrame([("c", "works in rome")], "conversation_id string, text string")
    got = memory.merge(stored, new, gone).orderBy("pos").collect()
    assert [(r["text"], r["importance"]) for r in got] == [("likes teas", 5), ("has a cat", 2)]


def test_answer_without_repeated_lines(spark):
    def clean(x):
        return ocr_text.clean_answers(spark.createDataFrame([(1, x, "en")], "k int, t string, lang string"), "k", "t", "lang").first()["answer"]

    assert clean("Sources: a\nline one\nLine ONE!\nother") == "a\nline one\nother"
    assert clean("").startswith("The information is not available")


def test_splice_digits(spark):
    df = spark.createDataFrame([(1, "no 12x4 and 9k9 end")], "k int, t string").withColumn("r", F.array(F.lit("1234")))
    assert ocr_text.spliced(df, "k", "t", "r").first()["text"] == "no 1234 and 9k9 end"


def test_fact_merge_equals_a_plain_version(spark, sf_dir):
    """Removals first, then each fact in place of the first alike, else at the end; the least important and oldest go beyond the cap."""
    from dataclasses import replace
    from difflib import SequenceMatcher

    from docspark.config import DEFAULTS

    settings = replace(DEFAULTS, max_facts=3, fact_similarity=0.5)
    t = lambda x: " ".join((x or "").strip().lower().split())
    alike = lambda a, b: bool(t(a) and t(b)) and SequenceMatcher(None, t(a), t(b)).ratio() >= 0.5
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    facts = said.select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").cast("int").alias("pos"), F.substring("text", 1, 60).alias("text"), F.lit("fact").alias("category"), (1 + F.col("turn") % 5).cast("int").alias("importance"), F.timestamp_seconds(F.col("turn")).alias("updated_at"))
    got = memory.merge(facts.where("pos % 2 = 0"), facts.where("pos % 2 = 1"), facts.where("pos = 0").select("conversation_id", "text"), settings).collect()
    want = {}
    for r in facts.orderBy("conversation_id", "pos").collect():
        want.setdefault(r["conversation_id"], []).append(r)
    for conv, rows in want.items():
        store = [r for r in rows if r["pos"] % 2 == 0]
        for gone in [r for r in rows if r["pos"] == 0]:
            store = [r for r in store if not alike(r["text"], gone["text"])]
        for new in [r for r in rows if r["pos"] % 2 == 1]:
            at = next((i for i, r in enumerate(store) if alike(r["text"], new["text"])), None)
            store = [*store, new] if at is None else [*store[:at], new, *store[at + 1 :]]
        over = sorted(range(len(store)), key=lambda i: (store[i]["importance"], store[i]["updated_at"], i))[: max(0, len(store) - 3)]
        left = [r["text"] for i, r in enumerate(store) if i not in over]
        assert [r["text"] for r in sorted((r for r in got if r["conversation_id"] == conv), key=lambda r: r["pos"])] == left


def test_forms_take_one_pass(spark):
    """Three patterns ran over each text, one of them a match per space; the forms must be as those three leave them."""
    odd = ["", " ", "A b C", "\t a--b \n\n c_d\x0b", "ÀÉ İß 𝟘x 😀y", "--", "a", " é ", "٣ ab", "x\u0085y​z", None]
    rows = spark.createDataFrame([(x,) for x in odd], "t string")
    three = lambda other: T.strip(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("t", F.lit(""))), other, " "), r"\s+", " "))
    got = rows.select(T.loose_latin(F.col("t")), three(r"[^a-z0-9\s]"), T.normalize_latin(F.col("t")), three(r"[^\p{L}\p{N}_\s]")).collect()
    assert all(a == b and c == d for a, b, c, d in got)
    plan = rows.select(T.loose_latin(F.col("t")).alias("n"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_results_are_numbered_without_texts(spark, monkeypatch):
    """Whole texts and lines went through the numbering; now only those that agree in length and first characters do."""
    dice, seen, plain = random.Random(3), [], ocr_text.numbered_within
    monkeypatch.setattr(ocr_text, "numbered_within", lambda rows, *a, **k: seen.append(rows) or plain(rows, *a, **k))
    lines = ["One line", "one  LINE ", "two", "", " ", "three x", "long " * 30, "Long " * 30]
    rows = [(dice.choice(["a", "b", None]), "\n".join(dice.choices(lines, k=dice.randint(0, 6)))) for _ in range(150)] + [("a", None), ("c", ""), (None, "only\nhere")]
    same = "the beginning of a result that others share, word by word\n"
    rows += [("t", same + x) for x in ("b\nB\na", "a\nc\nb", "a\nb\nc", "a\nb\nc")]
    want = []
    for key in {k for k, _ in rows}:
        held, place = set(), 0
        for t in sorted((t for k, t in rows if k == key and t is not None), key=lambda t: (-len(t), t)):
            for line in t.split("\n"):
                form = re.sub(r"[ \t\n\r\f\x0b]+", " ", line.lower()).strip(" ")
                if form and form not in held:
                    held.add(form)
                    place += 1
                    want.append((key, place, line))
    got = ocr_text.merged_results(spark.createDataFrame(rows, "k string, text string"), "k").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    seen.clear()
    big = spark.createDataFrame([("a", f"{i} " + "word\n" * 3000) for i in range(9)], "k string, text string")
    ocr_text.merged_results(big, "k").collect()
    strings = lambda df: [F.sum(F.length(c)) for c, kind in df.dtypes if kind in ("string", "binary")]
    assert all(sum(x or 0 for x in df.select(*strings(df)).first()) < 2000 for df in seen if strings(df))
