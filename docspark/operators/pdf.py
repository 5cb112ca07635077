"""Text as a plain PDF: A4 pages of one font, lines as given or broken at the margin. Letters outside Latin-1 become question marks."""

from __future__ import annotations

import zlib

WIDTH, HEIGHT, MARGIN, SIZE, LEADING = 595, 842, 57, 10, 14
LINES, COLUMNS = (HEIGHT - 2 * MARGIN) // LEADING, 95


def _literal(line: str) -> bytes:
    raw = line.encode("latin-1", "replace")
    return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"


def pdf_bytes(pages: list[list[str]]) -> bytes:
    """A PDF of pages, each a list of lines."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    kids = []
    for lines in pages:
        shown = b"\n".join(_literal(x) + b" Tj T*" for x in lines)
        body = zlib.compress(b"BT /F1 %d Tf %d TL %d %d Td\n" % (SIZE, LEADING, MARGIN, HEIGHT - MARGIN - SIZE) + shown + b"\nET")
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(body) + body + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (WIDTH, HEIGHT, len(objects)))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def broken(text: str, columns: int = COLUMNS) -> list[str]:
    """Lines of up to ``columns`` signs, broken at spaces where there are any."""
    out = []
    for line in text.split("\n"):
        while len(line) > columns:
            at = line.rfind(" ", 1, columns + 1)
            at = at if at > 0 else columns
            out.append(line[:at])
            line = line[at:].lstrip(" ")
        out.append(line)
    return out


def report_pdf(title: str, parts: list[tuple[str, str]]) -> bytes:
    """A report as PDF: a title page, the contents with page numbers, then the parts. Pages are counted before they are written."""
    bodies = [[name, "", *broken(body), ""] for name, body in parts]
    contents_pages = -(-(len(parts) + 2) // LINES) or 1
    lines, starts = [], []
    for body in bodies:
        if LINES - len(lines) % LINES < 3:
            lines += [""] * (LINES - len(lines) % LINES)  # a heading is not left at a page's foot
        starts.append(len(lines) // LINES + 2 + contents_pages)
        lines += body
    contents = ["Contents", "", *(f"{i}. {name[: COLUMNS - 12]}  {page}" for i, ((name, _), page) in enumerate(zip(parts, starts, strict=True), 1))]
    cut = lambda x: [x[a : a + LINES] for a in range(0, len(x), LINES)] or [[]]
    return pdf_bytes([[title], *cut(contents), *cut(lines)])
