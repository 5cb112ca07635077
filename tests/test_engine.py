import io
import zipfile

import pytest
from pyspark.sql import functions as F

from docspark.plans.api import Engine
from docspark.sources import files
from docspark.streaming.ingest import stream_files


@pytest.fixture
def engine(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "tea.txt").write_text("The zanzibar harbour opens at nine. Ships bring cloves and tea every day of the week.")
    (tmp_path / "in" / "maths.md").write_text("Integral calculus studies accumulation. A derivative measures change of a quantity.")
    (tmp_path / "in" / "bad.pdf").write_bytes(b"no pdf")
    return Engine(spark, str(tmp_path / "store"))


def test_lifecycle(spark, engine, tmp_path):
    source = str(tmp_path / "in")
    n = engine.ingest(source, "c1")
    assert n == 2 and engine.ingest(source, "c1") == 0
    assert engine.ingest(source, "c2") == n
    top = engine.search("when does the zanzibar harbour open", "c1").orderBy("rank").first()
    assert "zanzibar" in top["text"]
    assert "zanzibar" in engine.ask("zanzibar harbour", "c1")["answer"].lower()
    doc = engine.list_files("c1").where("filename = 'tea.txt'").first()["document_id"]
    assert engine.delete_document(doc, "c2") == 0
    (tmp_path / "v2").mkdir()
    (tmp_path / "v2" / "tea.txt").write_text("The mombasa harbour opens at ten and closes at six in the evening.")
    assert engine.reindex_document(doc, "c1", str(tmp_path / "v2")) == 1
    texts = [r["text"] for r in engine.store.chunks("c1").collect()]
    assert any("mombasa" in t for t in texts) and not any("zanzibar" in t for t in texts)
    with pytest.raises(ValueError):
        engine.reindex_document("nope", "c1", str(tmp_path / "v2"))
    assert engine.delete_document(doc, "c1") == 1 and engine.delete_document(doc, "c1") == 0
    assert engine.store.chunks("c2").count() == n
    assert engine.delete_conversation("c2") == 2 and engine.delete_conversation("c2") == 0


def test_stream_equals_batch(spark, engine, tmp_path):
    q = stream_files(engine, str(tmp_path / "in"), "s", str(tmp_path / "cp"), str(tmp_path / "jobs"))
    assert q.awaitTermination(120)
    assert engine.store.chunks("s").count() == 2
    assert {r["status"] for r in spark.read.parquet(str(tmp_path / "jobs")).collect()} == {"queued", "parsing", "chunking", "embedding", "done"}


def test_readers(spark, tmp_path):
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row><c r="A1" t="inlineStr"><is><t>name</t></is></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="B2"><v>3</v></c></row></sheetData></worksheet>')
    (tmp_path / "a.xlsx").write_bytes(book.getvalue())
    (tmp_path / "b.csv").write_text("p;q\n1;2.0\n3;4.5\n")
    (tmp_path / "c.json").write_text('{"k": "é"}')
    (tmp_path / "d.exe").write_bytes(b"MZ")
    got = files.load(files.scan(spark, str(tmp_path))).where("error is null").orderBy("filename", F.desc("chunk_type")).collect()
    assert [(r["filename"], r["chunk_type"], r["text"].split("\n")[-1]) for r in got] == [
        ("a.xlsx", "sheet_summary", "Row 2: name: x | n: 3"), ("a.xlsx", "row_group", "Row 2: name: x | n: 3"),
        ("b.csv", "sheet_summary", "Row 3: p: 3 | q: 4.5"), ("b.csv", "row_group", "Row 3: p: 3 | q: 4.5"), ("c.json", None, "}"),
    ]
