"""Minimal zipped-XML files, so that the parsers can be checked on the given tables."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DRAW = "http://schemas.openxmlformats.org/drawingml/2006/main"
_SLIDE = "http://schemas.openxmlformats.org/presentationml/2006/main"


def _zip(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as package:
        for name, body in parts.items():
            package.writestr(name, body)
    return out.getvalue()


def _rels(links: list[tuple[str, str, str]]) -> str:
    body = "".join(
        f'<Relationship Id="{i}" Type="{_DOC}/{kind}" Target={quoteattr(target)}/>'
        for i, kind, target in links
    )
    return f'<Relationships xmlns="{_PKG}">{body}</Relationships>'


def word_file(paragraphs: list[str], image: bytes | None = None) -> bytes:
    body = "".join(
        f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs
    )
    parts: dict[str, str | bytes] = {
        "word/document.xml": f'<w:document xmlns:w="{_WORD}"><w:body>{body}</w:body></w:document>'
    }
    if image is not None:
        parts["word/media/image1.png"] = image
        parts["word/_rels/document.xml.rels"] = _rels([("r1", "image", "media/image1.png")])
    return _zip(parts)


def slide_file(slides: list[list[str]], image: bytes | None = None) -> bytes:
    """Slides of one text box each; the image comes last on the last slide."""
    parts: dict[str, str | bytes] = {}
    ids, links = "", []
    for number, paragraphs in enumerate(slides, 1):
        texts = "".join(f"<a:p><a:r><a:t>{escape(p)}</a:t></a:r></a:p>" for p in paragraphs)
        shapes = f"<p:sp><p:txBody>{texts}</p:txBody></p:sp>"
        if image is not None and number == len(slides):
            shapes += '<p:pic><p:blipFill><a:blip r:embed="r1"/></p:blipFill></p:pic>'
            parts[f"ppt/slides/_rels/slide{number}.xml.rels"] = _rels(
                [("r1", "image", "../media/image1.png")]
            )
            parts["ppt/media/image1.png"] = image
        parts[f"ppt/slides/slide{number}.xml"] = (
            f'<p:sld xmlns:p="{_SLIDE}" xmlns:a="{_DRAW}" xmlns:r="{_DOC}">'
            f"<p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>"
        )
        ids += f'<p:sldId id="{255 + number}" r:id="s{number}"/>'
        links.append((f"s{number}", "slide", f"slides/slide{number}.xml"))
    parts["ppt/presentation.xml"] = (
        f'<p:presentation xmlns:p="{_SLIDE}" xmlns:r="{_DOC}">'
        f"<p:sldIdLst>{ids}</p:sldIdLst></p:presentation>"
    )
    parts["ppt/_rels/presentation.xml.rels"] = _rels(links)
    return _zip(parts)


def _cell(at: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, str):
        return f'<c r="{at}" t="inlineStr"><is><t>{escape(value)}</t></is></c>'
    return f'<c r="{at}"><v>{value!r}</v></c>'


def workbook(sheets: dict[str, list[list]]) -> bytes:
    parts: dict[str, str | bytes] = {}
    listed, links = "", []
    for number, (name, rows) in enumerate(sheets.items(), 1):
        body = "".join(
            f'<row r="{r}">'
            + "".join(_cell(f"{chr(65 + c)}{r}", v) for c, v in enumerate(row))
            + "</row>"
            for r, row in enumerate(rows, 1)
        )
        parts[f"xl/worksheets/sheet{number}.xml"] = (
            f'<worksheet xmlns="{_SHEET}"><sheetData>{body}</sheetData></worksheet>'
        )
        listed += f'<sheet name={quoteattr(name)} sheetId="{number}" r:id="s{number}"/>'
        links.append((f"s{number}", "worksheet", f"worksheets/sheet{number}.xml"))
    parts["xl/workbook.xml"] = (
        f'<workbook xmlns="{_SHEET}" xmlns:r="{_DOC}"><sheets>{listed}</sheets></workbook>'
    )
    parts["xl/_rels/workbook.xml.rels"] = _rels(links)
    return _zip(parts)
