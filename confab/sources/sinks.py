"""Sinks of report models: JSON, plain text, DOCX and PDF files, and the log table."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from confab.functions.clock import SECOND, written_time
from confab.operators.report import lost_characters, minutes_document, minutes_text, report_model, transcript_document
from confab.sources.documents import write_documents
from confab.sources.tables import written


def analysis_json(row: Column) -> Column:
    """The serialised form: null fields are kept."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", "false").json(path)


def write_text(model: DataFrame, path: str, by: str = "meeting_id") -> None:
    """Plain-text minutes, a record per meeting, form feeds between them."""
    minutes_text(model, by).select("minutes").write.option("lineSep", "\n\f\n").text(path)


def output_path(directory: Column, stem: str, at: Column, meeting: Column, extension: str, given: Column | None = None) -> Column:
    """The given path, else directory, stem, second and meeting (so that two in one second differ)."""
    made = F.concat(directory, F.lit(f"/{stem}_"), written_time(at, SECOND), F.lit("_"), meeting.cast("string"), F.lit(f".{extension}"))
    return made if given is None else F.coalesce(F.when(given != "", given), made)


_MAIN = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_OFFICE = "application/vnd.openxmlformats-officedocument.wordprocessingml"
_LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
#: Run sizes (half points) and boldness of the kinds of pieces.
LOOKS = {"title": (36, True), "heading": (24, True), "strong": (24, True), "note": (18, False), "end": (20, True), "rule": (16, False)}
_LISTS = {"bullet": ("1", "bullet", "\u2022"), "numbered": ("2", "decimal", "%1.")}


def _shown(text: str) -> str:
    """XML text; characters that XML does not allow are left out."""
    return escape("".join(c for c in text if c in "\t\n\r" or c >= " " and c not in "\ufffe\uffff" and not "\ud800" <= c <= "\udfff"))


def _paragraph(kind: str, text: str) -> str:
    size, bold = LOOKS.get(kind, (22, False))
    style = f'<w:pStyle w:val="{"Title" if kind == "title" else "Heading1"}"/>' if kind in ("title", "heading") else ""
    style += f'<w:numPr><w:ilvl w:val="0"/><w:numId w:val="{_LISTS[kind][0]}"/></w:numPr>' if kind in _LISTS else ""
    lines = "<w:br/>".join(f'<w:t xml:space="preserve">{_shown(x)}</w:t>' for x in ("_" * 78 if kind == "rule" else text).split("\n"))
    return f'<w:p><w:pPr>{style}</w:pPr><w:r><w:rPr>{"<w:b/>" * bold}<w:sz w:val="{size}"/></w:rPr>{lines}</w:r></w:p>'


def _table(rows: list[tuple[str, list[str]]]) -> str:
    sides = "".join(f'<w:{s} w:val="single" w:sz="4"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV"))
    cell = lambda kind, x: f"<w:tc><w:tcPr/>{_paragraph('strong' if kind == 'columns' else 'cell', x)}</w:tc>"
    return f"<w:tbl><w:tblPr><w:tblBorders>{sides}</w:tblBorders></w:tblPr>{''.join('<w:tr>' + ''.join(cell(k, x or '') for x in cells) + '</w:tr>' for k, cells in rows)}</w:tbl>"


def _grouped(pieces: list[dict]):
    """Pieces, with the rows that follow each other as one list."""
    rows: list[tuple[str, list[str]]] = []
    for p in pieces:
        if p["kind"] in ("row", "columns"):
            rows.append((p["kind"], list(p["cells"])))
            continue
        if rows:
            yield "table", rows
            rows = []
        yield p["kind"], p["text"] or ""
    if rows:
        yield "table", rows


def docx_bytes(pieces: list[dict]) -> bytes:
    """A DOCX file of document pieces: headings, paragraphs, bulleted and numbered lists, bordered tables."""
    body = "".join(_table(x) if kind == "table" else _paragraph(kind, x) for kind, x in _grouped(pieces))
    style = lambda i, name: f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{name}"/></w:style>'
    level = lambda n, kind, mark: f'<w:abstractNum w:abstractNumId="{n}"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{mark}"/></w:lvl></w:abstractNum>'
    numbers = "".join(level(*x) for x in _LISTS.values()) + "".join(f'<w:num w:numId="{n}"><w:abstractNumId w:val="{n}"/></w:num>' for n, _, _ in _LISTS.values())
    names = ("document.main", "styles", "numbering")
    types = "".join(f'<Override PartName="/word/{n.split(".")[0]}.xml" ContentType="{_OFFICE}.{n}+xml"/>' for n in names)
    link = lambda i, kind, target: f'<Relationship Id="r{i}" Type="{_LINKS}/{kind}" Target="{target}"/>'
    links = lambda inner: f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{inner}</Relationships>'
    files = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{types}</Types>',
        "_rels/.rels": links(link(1, "officeDocument", "word/document.xml")),
        "word/_rels/document.xml.rels": links(link(1, "styles", "styles.xml") + link(2, "numbering", "numbering.xml")),
        "word/styles.xml": f'{_HEAD}<w:styles xmlns:w="{_MAIN}">{style("Title", "Title")}{style("Heading1", "heading 1")}</w:styles>',
        "word/numbering.xml": f'{_HEAD}<w:numbering xmlns:w="{_MAIN}">{numbers}</w:numbering>',
        "word/document.xml": f'{_HEAD}<w:document xmlns:w="{_MAIN}"><w:body>{body}</w:body></w:document>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


class _Pages:
    """Lines of text at places of A4 pages; a page is begun where the last one is full."""

    def __init__(self, top: float = 790, bottom: float = 60):
        self.top, self.bottom, self.y, self.pages = top, bottom, top, [[]]

    def room(self, height: float) -> None:
        if self.y - height < self.bottom and self.y < self.top:
            self.pages.append([])
            self.y = self.top

    def put(self, x: float, down: float, size: float, bold: bool, text: str) -> None:
        shown = text.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)").encode("cp1252", "replace")
        self.pages[-1].append(b"BT /F%d %g Tf 1 0 0 1 %g %g Tm (" % (2 if bold else 1, size, x, self.y - down) + shown + b") Tj ET")

    def rule(self) -> None:
        self.pages[-1].append(b"0.5 w 50 %g m 545 %g l S" % (self.y - 4, self.y - 4))


def _wrapped(text: str, width: float, size: float) -> list[str]:
    import textwrap

    return [y for x in (text or "").split("\n") for y in (textwrap.wrap(x, max(1, int(width / (size * 0.52)))) or [""])]


def pdf_bytes(pieces: list[dict]) -> bytes:
    """A PDF file of document pieces in two standard fonts, with page numbers."""
    pages, number = _Pages(), 0
    for kind, x in _grouped(pieces):
        number = number + 1 if kind == "numbered" else 0
        if kind == "table":
            share = (0.38, 0.16, 0.16, 0.14, 0.16) if len(x[0][1]) == 5 else (0.26, 0.74)
            for row, cells in x:
                columns = [_wrapped(c, 495 * w - 6, 9) for c, w in zip(cells, share)]
                pages.room(12 * max(map(len, columns)) + 4)
                for c, lines in enumerate(columns):
                    for k, line in enumerate(lines):
                        pages.put(50 + 495 * sum(share[:c]), 12 * k + 9, 9, row == "columns" or len(share) == 2 and c == 0, line)
                pages.y -= 12 * max(map(len, columns))
                pages.rule()
                pages.y -= 6
            continue
        size, bold = (lambda a: (a[0] / 2, a[1]))(LOOKS.get(kind, (20, False)))
        if kind == "rule":
            pages.rule()
            pages.y -= 10
            continue
        lead = {"bullet": "- ", "numbered": f"{number}. "}.get(kind, "")
        indent = {"bullet": 16, "numbered": 16, "note": 24}.get(kind, 0)
        pages.y -= 8 if kind in ("heading", "end") else 0
        for line in _wrapped(lead + x, 495 - indent, size):
            pages.room(size * 1.35)
            pages.put(50 + indent, size, size, bold, line)
            pages.y -= size * 1.35
        pages.y -= 3
    n = len(pages.pages)
    kids = b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(n))
    font = lambda name: b"<< /Type /Font /Subtype /Type1 /BaseFont /" + name + b" /Encoding /WinAnsiEncoding >>"
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + kids + b"] /Count %d >>" % n, font(b"Helvetica"), font(b"Helvetica-Bold")]
    for i, page in enumerate(pages.pages):
        stream = b"\n".join([*page, b"BT /F1 8 Tf 1 0 0 1 520 30 Tm (Page %d) Tj ET" % (i + 1)])
        objects += [b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents %d 0 R >>" % (6 + 2 * i), b"<< /Length %d >>\nstream\n" % len(stream) + stream + b"\nendstream"]
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + o + b"\nendobj\n"
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out) + table + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, len(out))


#: Exports by name: flavour, file name stem, and what makes the pieces from analyses.
EXPORTS = {
    "minutes_docx": ("docx", "minutes_of_meeting", lambda a, info: minutes_document(report_model(a, "docx", info), "docx")),
    "minutes_pdf": ("pdf", "minutes_of_meeting", lambda a, info: minutes_document(report_model(a, "pdf", info), "pdf")),
    "transcript_docx": ("docx", "transcript_report", lambda a, info: transcript_document(a, "docx", info)),
    "transcript_pdf": ("pdf", "transcript_report", lambda a, info: transcript_document(a, "pdf", info)),
}


def export(analyses: DataFrame, name: str, directory: str, prepared: DataFrame | None = None, info: str | None = None, at: Column | None = None) -> DataFrame:
    """(``meeting_id``, ``path``, ``lost``): a file per meeting by one of ``EXPORTS``; meetings in ``prepared`` keep the file they have.

    The list is written once, so files are made once; they are committed together, see :mod:`.documents`.
    ``lost`` counts the characters that a PDF shows as question marks, as its fonts are Western European.
    """
    flavor, stem, make = EXPORTS[name]
    todo = analyses if prepared is None else analyses.join(prepared.select("meeting_id"), "meeting_id", "left_anti")
    path = output_path(F.lit(directory), stem, at if at is not None else F.current_timestamp(), F.col("meeting_id"), flavor)
    lost = lost_characters(F.col("parts")) if flavor == "pdf" else F.lit(0)
    rows = written(make(todo, info).select("meeting_id", path.alias("path"), "parts", lost.alias("lost")), "documents")
    write_documents(rows.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "parts"), flavor, directory)
    made = rows.select("meeting_id", "path", "lost")
    return made if prepared is None else prepared.select("meeting_id", "path", "lost").unionByName(made)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends (ts, stage, message, details) rows to the log table."""
    rows.select("ts", "stage", "message", "details").write.mode("append").parquet(path)
