"""Readers from binary files to document rows: text, Markdown, JSON, CSV, XLSX, DOCX, PDF; images and audio by plug-in."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions import text as X
from ..operators import images
from ..operators.images import Recognise
from ..operators.shared import slices
from ..operators.sheets import frame_chunks
from .validation import validate

PAGES = "path string, filename string, file_type string, page int, text string, chunk_type string, sheet_name string, row_range string, error string"


def scan(spark: SparkSession, path: str, settings: Settings = DEFAULTS, glob: str = "*") -> DataFrame:
    """Files below ``path`` within the size cap; the cap is a filter on length, so contents beyond it are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return found.where(F.col("length") <= settings.max_upload_mb * 1024 * 1024).withColumn("filename", F.element_at(F.split("path", "/"), -1))


def text_page(data: bytes) -> str:
    return data.decode("utf-8", "replace").strip()


def json_page(data: bytes) -> str:
    raw = text_page(data)
    try:
        return json.dumps(json.loads(raw), ensure_ascii=False, indent=2)
    except ValueError:
        return raw


def csv_frame(data: bytes) -> pd.DataFrame:
    """A CSV file's table; the delimiter is the candidate that the first lines agree on."""
    raw = data.decode("utf-8-sig", "replace")
    try:
        mark = csv.Sniffer().sniff("\n".join(raw.splitlines()[:20]), ",;\t|").delimiter
    except csv.Error:
        mark = ","
    return pd.read_csv(io.StringIO(raw), sep=mark)


_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def xlsx_frames(data: bytes) -> dict[str, pd.DataFrame]:
    """The sheets of a workbook, first row as header."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = set(book.namelist())
    read = lambda n: ElementTree.fromstring(book.read(n))
    shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
    dated = set()
    if "xl/styles.xml" in names:
        styles = read("xl/styles.xml")
        custom = {int(f.get("numFmtId")) for f in styles.iter(f"{_S}numFmt") if re.search("[ymdh]", f.get("formatCode", ""))}
        cells = styles.find(f"{_S}cellXfs")
        dated = {i for i, x in enumerate(cells if cells is not None else ()) if (n := int(x.get("numFmtId", 0))) in custom or 14 <= n <= 22}
    out = {}
    for sheet in read("xl/workbook.xml").iter(f"{_S}sheet"):
        target = targets[sheet.get(_R)].lstrip("/")
        rows: list[dict[int, object]] = []
        for row in read(target if target.startswith("xl/") else f"xl/{target}").iter(f"{_S}row"):
            found: dict[int, object] = {}
            for c in row.iter(f"{_S}c"):
                letters = re.match("[A-Z]+", c.get("r", "")) if c.get("r") else None
                at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(found)
                value, kind = c.find(f"{_S}v"), c.get("t")
                if kind == "inlineStr":
                    found[at] = "".join(t.text or "" for t in c.iter(f"{_S}t"))
                elif value is not None and value.text is not None:
                    if kind == "s":
                        found[at] = shared[int(value.text)]
                    elif kind in ("str", "e"):
                        found[at] = value.text
                    elif kind == "b":
                        found[at] = value.text == "1"
                    else:
                        number = float(value.text)
                        found[at] = pd.Timestamp("1899-12-30") + pd.Timedelta(days=number) if int(c.get("s", 0)) in dated else number
            rows.append(found)
        width = max((max(r, default=-1) for r in rows), default=-1) + 1
        table = [[r.get(i) for i in range(width)] for r in rows]
        head = [str(x) if x is not None else f"Unnamed: {i}" for i, x in enumerate(table[0])] if table else []
        out[sheet.get("name")] = pd.DataFrame(table[1:], columns=head)
    return out


def docx_page(data: bytes) -> str:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    return "\n".join(s for p in body.iter(f"{w}p") if (s := "".join(t.text or "" for t in p.iter(f"{w}t")).strip()))


def pdf_objects(data: bytes) -> dict[int, bytes]:
    """Bodies of a PDF's objects by number, also those packed into object streams."""
    objects = {int(m[1]): m[2] for m in re.finditer(rb"(\d+) \d+ obj\b(.*?)endobj", data, re.S)}
    for body in list(objects.values()):
        if not re.search(rb"/Type\s*/ObjStm\b", body):
            continue
        inner, n, first = pdf_stream(body), re.search(rb"/N\s+(\d+)", body), re.search(rb"/First\s+(\d+)", body)
        if not (n and first):
            continue
        head = list(map(int, inner[: int(first[1])].split()))[: 2 * int(n[1])]
        places = [*(int(first[1]) + x for x in head[1::2]), len(inner)]
        for number, a, b in zip(head[::2], places, places[1:], strict=False):
            objects.setdefault(number, inner[a:b])
    return objects


def pdf_stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    try:
        return zlib.decompressobj().decompress(m[1]) if b"FlateDecode" in body else m[1]  # its last byte may look like a line's end
    except zlib.error:
        return b""


def pdf_page_order(objects: dict[int, bytes]) -> list[int]:
    """Page objects in the order of the page tree; those that no tree reaches follow by number."""
    is_page = lambda n: re.search(rb"/Type\s*/Page\b", objects.get(n, b""))
    out, stack, seen = [], [], set()
    for body in objects.values():
        if re.search(rb"/Type\s*/Catalog\b", body) and (m := re.search(rb"/Pages\s+(\d+) \d+ R", body)):
            stack.append(int(m[1]))
    while stack:
        n = stack.pop()
        if n in seen:
            continue
        seen.add(n)
        if is_page(n):
            out.append(n)
        elif m := re.search(rb"/Kids\s*\[([^\]]*)\]", objects.get(n, b""), re.S):
            stack += reversed([int(x) for x in re.findall(rb"(\d+) \d+ R", m[1])])
    return out + [n for n in sorted(objects) if n not in seen and is_page(n)]


ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_string(raw: bytes) -> str:
    """A literal string's or a hexadecimal string's text; UTF-16 by its mark, else one byte a character."""
    if raw[:1] == b"<":
        digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
        value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        value = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1][-1:] == b"\n" else ESCAPES.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return value[2:].decode("utf-16-be", "replace") if value[:2] == b"\xfe\xff" else value.decode("latin-1")


STRING = rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>"
SHOWN = re.compile(rb"\[((?:" + STRING + rb"|[^\]()<>])*)\]\s*TJ|(" + STRING + rb")\s*(?:Tj|'|\")|(T\*|\bT[dDm]\b|\bET\b)", re.S)


def pdf_pages(data: bytes) -> list[str]:
    """Text of each page of a PDF in the order of its page tree; content streams may be plain or deflated. Fonts with codes of their own are not mapped."""
    objects = pdf_objects(data)
    pages = []
    for number in pdf_page_order(objects):
        refs = [int(x) for x in re.findall(rb"(\d+) \d+ R", (re.search(rb"/Contents\s*(\[[^\]]*\]|\d+ \d+ R)", objects[number]) or [b"", b""])[1])]
        content, lines, line = b"\n".join(pdf_stream(objects.get(r, b"")) for r in refs), [], ""
        for m in SHOWN.finditer(content):
            if m[3]:
                lines, line = ([*lines, line] if line else lines), ""
            else:
                line += "".join(pdf_string(x[0]) for x in re.finditer(STRING, m[1] if m[1] is not None else m[2], re.S))
        pages.append("\n".join([*lines, line] if line else lines).strip())
    return pages


def load(files: DataFrame, recognise: Recognise | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per page, sheet chunk or whole file of the valid ``files`` (path, filename, content).

    ``recognise`` reads images; without it they are an error. A file that no reader here takes, or that is broken, gives one row
    with its ``error`` and no text, so that none disappears.
    """

    def rows(name: str, kind: str, data: bytes) -> Iterator[tuple]:
        ext = name.lower().rpartition(".")[2]
        if ext in ("xls", "doc"):
            raise LookupError(f"no reader for .{ext} files")
        if kind == "excel":
            sheets = {name.rpartition(".")[0]: csv_frame(data)} if ext == "csv" else xlsx_frames(data)
            for i, (sheet, frame) in enumerate((k, f) for k, f in sheets.items() if not f.dropna(how="all").empty):
                for chunk_type, span, body in frame_chunks(sheet, frame, settings):
                    yield i, body, chunk_type, sheet, span, None
        elif kind == "pdf":
            found = pdf_pages(data)
            if not found:
                raise LookupError("no page was found")
            for i, body in enumerate(found):
                yield i, body, None, None, None, None
        elif kind == "image":
            if recognise is None:
                raise LookupError("no recogniser for images")
            image = images.decode(data)
            if image is None:
                raise LookupError("no decoder for this image")
            if body := images.read_image(image, recognise):
                yield 0, body, None, None, None, None
        elif body := json_page(data) if kind == "json" else docx_page(data) if kind == "docx" else text_page(data):
            yield 0, body, None, None, None, None

    names = [x.split()[0] for x in PAGES.split(", ")]
    types = [pa.int32() if x.split()[1] == "int" else pa.string() for x in PAGES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch):  # few files at a time, and each is let go before the next is opened
                out = []
                for path, name, kind, data in zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in ("path", "filename", "file_type", "content")), strict=True):
                    try:
                        out += [(path, name, kind, *r) for r in rows(name, kind, data)]
                    except Exception as e:  # whatever a damaged file makes a reader raise is that file's error
                        out.append((path, name, kind, 0, None, None, None, None, str(e)[:200] or type(e).__name__))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    good = validate(files).where("status = 'ok'").select("path", "filename", "file_type", "content")
    return good.mapInArrow(run, PAGES)


def weak_pages(pages: DataFrame, least: int = DEFAULTS.weak_page_chars) -> DataFrame:
    """Adds ``needs_ocr``: PDF pages with next to no text; all pages, if the whole file has next to none."""
    n = F.length(X.clean(F.col("text")))
    return pages.withColumn("needs_ocr", (F.col("file_type") == "pdf") & ((F.sum(n).over(Window.partitionBy("path")) < least) | (n < least)))


def page_texts(rows: DataFrame, doc: str, page: str, order: str, text: str) -> DataFrame:
    """``doc, page, text``: a document's stored rows joined by page, blank pages left out, pages counted from 1."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"])
    made = rows.groupBy(doc, page).agg(F.array_join(parts, "\n").alias("text"))
    return made.where(X.clean(F.col("text")) != "").select(doc, (F.col(page) + 1).alias(page), "text")


def full_text(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))), lambda x: x["t"])
    return pages.groupBy(doc).agg(F.array_join(parts, "\n\n").alias("text"))


def fact_files(spark: SparkSession, path: str) -> DataFrame:
    """Fact files of either version as rows; a version 1 summary is one fact, broken files give none."""
    raw = spark.read.option("wholetext", True).text(path).withColumn("path", F.input_file_name())
    kind = "struct<version:int,summary:string,updated_at:string,facts:array<struct<text:string,category:string,importance:int,updated_at:string>>>"
    body = F.from_json("value", kind, {"mode": "PERMISSIVE"})
    legacy = F.when(F.coalesce(body["summary"], F.lit("")) != "", F.array(F.struct(body["summary"].alias("text"), F.lit("fact").alias("category"), F.lit(3).alias("importance"), body["updated_at"].alias("updated_at"))))
    rows = raw.select("path", F.posexplode(F.coalesce(body["facts"], legacy)).alias("pos", "f"))
    return rows.select(F.regexp_extract("path", r"([^/]*)\.json$", 1).alias("conversation_id"), "pos", "f.*").where(X.clean(F.col("text")) != "")
