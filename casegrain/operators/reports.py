"""Reports in Markdown, HTML, DOCX and PDF of a case's summary tables; rows are cut to what a person reads, with the rest counted."""

from __future__ import annotations

import io
import zipfile
from html import escape

from pyspark.sql import DataFrame

#: A table shows so many rows; the report says how many there are.
MOST_ROWS = 200


def _table(rows: DataFrame) -> tuple[list[str], list[list[str]], int]:
    total = rows.count()
    shown = [["" if v is None else str(v) for v in r] for r in rows.limit(MOST_ROWS).collect()]
    return rows.columns, shown, total


def markdown(title: str, facts: dict[str, str], tables: dict[str, DataFrame]) -> str:
    """A heading, facts as a list, and a table under each heading."""
    cell = lambda v: v.replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}", "", *[f"- **{k}:** {v}" for k, v in facts.items()], ""]
    for name, rows in tables.items():
        columns, shown, total = _table(rows)
        out += [f"## {name}", "", "| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
        out += ["| " + " | ".join(cell(v) for v in r) + " |" for r in shown]
        out += [f"\n{total - len(shown)} more rows." if total > len(shown) else "", ""]
    return "\n".join(out)


def html(title: str, facts: dict[str, str], tables: dict[str, DataFrame]) -> str:
    out = [f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body><h1>{escape(title)}</h1><dl>"]
    out += [f"<dt>{escape(k)}</dt><dd>{escape(v)}</dd>" for k, v in facts.items()] + ["</dl>"]
    for name, rows in tables.items():
        columns, shown, total = _table(rows)
        out += [f"<h2>{escape(name)}</h2><table><tr>" + "".join(f"<th>{escape(c)}</th>" for c in columns) + "</tr>"]
        out += ["<tr>" + "".join(f"<td>{escape(v)}</td>" for v in r) + "</tr>" for r in shown] + ["</table>"]
        out += [f"<p>{total - len(shown)} more rows.</p>"] if total > len(shown) else []
    return "".join([*out, "</body></html>"])


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(title: str, facts: dict[str, str], tables: dict[str, DataFrame]) -> bytes:
    """The same report as a Word document of plain paragraphs and tables."""
    text = lambda v: f'<w:p><w:r><w:t xml:space="preserve">{escape(v)}</w:t></w:r></w:p>'
    row = lambda r: "<w:tr>" + "".join(f"<w:tc>{text(v)}</w:tc>" for v in r) + "</w:tr>"
    body = [text(title), *[text(f"{k}: {v}") for k, v in facts.items()]]
    for name, rows in tables.items():
        columns, shown, total = _table(rows)
        body += [text(name), "<w:tbl>" + row(columns) + "".join(row(r) for r in shown) + "</w:tbl>"]
        body += [text(f"{total - len(shown)} more rows.")] if total > len(shown) else []
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {_W}><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


#: Lines of a PDF page, and characters of a line; longer ones go on in the next.
PAGE_LINES, LINE_CHARS = 60, 95


def pdf(title: str, facts: dict[str, str], tables: dict[str, DataFrame]) -> bytes:
    """The Markdown report's lines on pages of a PDF; characters beyond Latin-1 become question marks."""
    lines = [line[i : i + LINE_CHARS] for line in markdown(title, facts, tables).split("\n") for i in range(0, max(1, len(line)), LINE_CHARS)]
    pages = [lines[i : i + PAGE_LINES] for i in range(0, max(1, len(lines)), PAGE_LINES)]
    literal = lambda v: v.encode("latin-1", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count %d/Kids[%s]>>" % (len(pages), b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages)))), b"<</Type/Font/Subtype/Type1/BaseFont/Courier/Encoding/WinAnsiEncoding>>"]
    for i, page in enumerate(pages):
        stream = b"\n".join(b"BT /F1 9 Tf 40 %d Td (%s) Tj ET" % (800 - 12 * k, literal(line)) for k, line in enumerate(page))
        objects += [b"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Resources<</Font<</F1 3 0 R>>>>/Contents %d 0 R>>" % (5 + 2 * i), b"<</Length %d>>\nstream\n%s\nendstream" % (len(stream), stream)]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    table = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, table))
