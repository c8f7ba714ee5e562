"""Word files of laid-out papers: a paragraph for each block, columns by tab stops (SNK-02..04)."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import PAGE_WIDTH_IN
from .docx import _HEAD, FILES_EACH, W, twips

#: Fixed values of the format and of the paper: A4 in twips, fonts by script.
PAGE = '<w:pgSz w:w="11906" w:h="16838"/>'
LATIN, HINDI = "Arial", "Nirmala UI"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml"
_TYPES = f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{_WORD}.document.main+xml"/><Override PartName="/word/settings.xml" ContentType="{_WORD}.settings+xml"/></Types>'
_RELS = f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>'
_PARTS = f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/settings" Target="settings.xml"/></Relationships>'
#: The gap before a block that opens a page is not shown.
_SETTINGS = f'{_HEAD}<w:settings xmlns:w="{W[1:-1]}"><w:compat><w:suppressSpBfAfterPgBrk/></w:compat></w:settings>'
_PIECES = re.compile("[ऀ-ॿ]+(?:[^A-Za-zऀ-ॿ]*[ऀ-ॿ]+)*|[^ऀ-ॿ]+")


@lru_cache
def _run_opens(font: str, bold: bool, half_points: int) -> str:
    """What stands before a run's text."""
    fonts = "".join(f' w:{kind}="{font}"' for kind in ("ascii", "hAnsi", "cs", "eastAsia"))
    weight = "<w:b/><w:bCs/>" if bold else ""
    return f'<w:r><w:rPr><w:rFonts{fonts}/>{weight}<w:sz w:val="{half_points}"/><w:szCs w:val="{half_points}"/></w:rPr><w:t xml:space="preserve">'


def runs_xml(text: str, bold: bool, half_points: int) -> str:
    """Runs of one script each; a tab is a tab, a line feed a line break."""
    out = []
    for piece in re.split("([\t\n])", text):
        if piece in ("\t", "\n"):
            out.append(f'<w:r><w:rPr><w:sz w:val="{half_points}"/></w:rPr>{"<w:tab/>" if piece == chr(9) else "<w:br/>"}</w:r>')
            continue
        for part in _PIECES.findall(piece):
            font = HINDI if "ऀ" <= part[0] <= "ॿ" else LATIN
            out.append(f"{_run_opens(font, bold, half_points)}{escape(part)}</w:t></w:r>")
    return "".join(out)


def block_xml(block: dict, font_pt: float = 12.0) -> str:
    """The paragraph of a block: marks at a right tab; time, class and marks at a centre and a right one; columns at left ones, rows by line breaks; rules as borders, the one to cut along dashed."""
    content, indent, cells = PAGE_WIDTH_IN - 2 * block["side"], block["indent"] or 0.0, block["cells"]
    text, stops, border = block["text"] or "", [], ""
    if block["type"] == "rule":
        style, size, color = ("dashed", 4, "808080") if block["dashed"] else ("single", 6, "000000")
        text, border = "", f'<w:pBdr><w:bottom w:val="{style}" w:sz="{size}" w:space="1" w:color="{color}"/></w:pBdr>'
    elif block["type"] == "header-row":
        text, stops = "\t".join(cells), [("center", content / 2), ("right", content)]
    elif cells is not None:
        cols = max(int(block["cols"] or 1), 1)
        widths = block["widths"] if block["widths"] is not None else [(content - indent) / cols] * cols
        stops = [("left", indent + sum(widths[: c + 1])) for c in range(cols - 1)]
        text = "\n".join("\t".join(cells[k : k + cols]) for k in range(0, len(cells), cols))
    elif block["right_text"] is not None:
        text, stops = f"{text}\t{block['right_text']}", [("right", content)]
    tabs = "".join(f'<w:tab w:val="{kind}" w:pos="{twips(at)}"/>' for kind, at in stops)
    props = "<w:keepNext/>" * (block["type"] == "question") + border + (f"<w:tabs>{tabs}</w:tabs>" if tabs else "")
    props += f'<w:spacing w:before="{int((block["before_pt"] or 0) * 20 + 0.5)}" w:after="0" w:line="{int(block["line"] * 240 + 0.5)}" w:lineRule="auto"/><w:ind w:left="{twips(indent)}"/>'
    props += '<w:jc w:val="center"/>' if block["align"] == "center" else ""
    return f"<w:p><w:pPr>{props}</w:pPr>{runs_xml(text, bool(block['bold']), int(font_pt * 2))}</w:p>"


def paper_file(blocks: list[dict], font_pt: float = 12.0) -> bytes:
    """A Word file of an A4 section with the density's margins."""
    first = blocks[0]
    margins = "".join(f' w:{side}="{twips(first[c])}"' for side, c in (("top", "top"), ("bottom", "bottom"), ("left", "side"), ("right", "side")))
    body = "".join(block_xml(b, font_pt) for b in blocks)
    xml = f'{_HEAD}<w:document xmlns:w="{W[1:-1]}"><w:body>{body}<w:sectPr>{PAGE}<w:pgMar{margins}/></w:sectPr></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", xml), ("word/_rels/document.xml.rels", _PARTS), ("word/settings.xml", _SETTINGS)):
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), part)
    return out.getvalue()


FIELDS = ["block_no", "type", "text", "right_text", "cells", "cols", "widths", "indent", "before_pt", "bold", "align", "line", "top", "bottom", "side", "dashed"]


def docx_of_blocks(blocks: DataFrame, font_pt: float = 12.0) -> DataFrame:
    """(path, content): one Word file for each paper and density of laid-out blocks, edits and inserts included. A paper's blocks are gathered into one row, as it is one file."""
    if "dashed" not in blocks.columns:
        blocks = blocks.withColumn("dashed", F.lit(False))
    # By rung as well, where there is one, the groups lie where the copies' windows put them.
    by = ["paper_id", *(["rung"] if "rung" in blocks.columns else []), "density_id"]
    each = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("bs")).select("paper_id", "density_id", "bs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A paper's blocks are read column by column; as objects of their own, each field would be converted by itself.
        for batch in batches:
            for begin in range(0, batch.num_rows, FILES_EACH):
                some = batch.slice(begin, FILES_EACH)
                paths = [f"paper-{p}-{d}.docx" for p, d in zip(some.column("paper_id").to_pylist(), some.column("density_id").to_pylist())]
                made = [paper_file([dict(zip(FIELDS, row)) for row in zip(*[c.to_pylist() for c in bs.values.flatten()])], font_pt) for bs in some.column("bs")]
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(made, pa.binary())], names=["path", "content"])

    return each.mapInArrow(work, "path string, content binary")
