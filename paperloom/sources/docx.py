"""Word files as lines, and lines as Word files (SRC-01..09, SNK-02..04)."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.cutting import cut

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: Number formats of Word and the letters that stand for them.
CODES = {"decimal": "d", "lowerLetter": "a", "upperLetter": "A", "lowerRoman": "r", "upperRoman": "R", "bullet": "b"}

_RUN, _TEXT, _TAB, _BREAKS, _NUMBER = f"{W}r", f"{W}t", f"{W}tab", (f"{W}br", f"{W}cr"), f"{W}pPr/{W}numPr"
#: Files that are read or written between two batches, so that their lines are held together no longer.
FILES_EACH = 64


def _code(fmt: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv]), fmt), F.when(fmt.isNotNull(), "d"))


def numbering_formats(paras: DataFrame, nums: DataFrame, levels: DataFrame) -> DataFrame:
    """``paras(para_no, num_id, ilvl)`` with auto_fmt: the level's format, else that of level 0, else d; none for bullets and for paragraphs without a number."""
    zero = levels.where("ilvl = '0'").select("abstract_id", F.col("num_fmt").alias("zero_fmt"))
    rows = paras.join(nums, "num_id", "left").join(levels, ["abstract_id", "ilvl"], "left").join(zero, "abstract_id", "left")
    code = F.coalesce(_code(F.col("num_fmt")), _code(F.col("zero_fmt")), F.lit("d"))
    return rows.withColumn("auto_fmt", F.when(F.col("num_id").isNull() | (F.col("num_id") == "0") | (code == "b"), "").otherwise(code)).drop("zero_fmt")


def formats_of(xml: bytes | None) -> dict[tuple[str, str], str]:
    if not xml:
        return {}
    root = ElementTree.fromstring(xml)
    levels = {(a.get(f"{W}abstractNumId"), lvl.get(f"{W}ilvl")): lvl.find(f"{W}numFmt").get(f"{W}val") for a in root.iter(f"{W}abstractNum") for lvl in a.iter(f"{W}lvl") if lvl.find(f"{W}numFmt") is not None}
    out = {}
    for num in root.iter(f"{W}num"):
        ref = num.find(f"{W}abstractNumId")
        for (abstract, level), fmt in levels.items():
            if ref is not None and abstract == ref.get(f"{W}val"):
                out[num.get(f"{W}numId"), level] = CODES.get(fmt, "d")
    return out


def paragraph_lines(p: ElementTree.Element, formats: dict) -> list[tuple[str, str]]:
    """(text, format) of each line of a paragraph; the number belongs to the first one."""
    parts = []
    for run in p.iter(_RUN):
        for node in run:
            tag = node.tag
            if tag == _TEXT:
                parts.append(node.text or "")
            elif tag == _TAB:
                parts.append("\t")
            elif tag in _BREAKS:
                parts.append("\n")
    number = p.find(_NUMBER)
    code = ""
    if number is not None and (name := number.find(f"{W}numId")) is not None and name.get(f"{W}val") != "0":
        level = number.find(f"{W}ilvl")
        key = name.get(f"{W}val")
        code = formats.get((key, level.get(f"{W}val") if level is not None else "0")) or formats.get((key, "0"), "d")
    rows = "".join(parts).split("\n")
    return [(t, code if k == 0 and t.strip() and code != "b" else "") for k, t in enumerate(rows)]


def _walk(node: ElementTree.Element, formats: dict) -> list[tuple[str, str]]:
    """Lines in document order; a table's row is one line of its cells, and content controls are looked into."""
    out = []
    for child in node:
        if child.tag == f"{W}p":
            out += paragraph_lines(child, formats)
        elif child.tag == f"{W}tbl":
            for row in child.findall(f"{W}tr"):
                # Cells of the row itself; a table within a cell is part of that cell's lines.
                cells = [_walk(cell, formats) for cell in row.findall(f"{W}tc")]
                code = cells[0][0][1] if cells and cells[0] else ""
                out.append(("\t".join(" ".join(t for t, _ in lines).strip() for lines in cells), code))
        elif child.tag == f"{W}sdt":
            for content in child.findall(f"{W}sdtContent"):
                out += _walk(content, formats)
    return out


def read_docx(data: bytes) -> list[tuple[str, str]]:
    """(text, format) of each line of a Word file. A file that cannot be read gives a ValueError that says why."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            if "word/document.xml" not in names:
                raise ValueError("this file has no word/document.xml; is it a .docx file?")
            formats = formats_of(z.read("word/numbering.xml") if "word/numbering.xml" in names else None)
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    except zipfile.BadZipFile as e:
        raise ValueError("this file is no .docx file (it is not a zip archive, or a damaged one)") from e
    except ElementTree.ParseError as e:
        raise ValueError(f"this file's XML is damaged: {e}") from e
    except (zlib.error, EOFError, NotImplementedError, RuntimeError) as e:
        # Cut off within an entry, packed in an unknown way, or under a password.
        raise ValueError(f"this file cannot be unpacked: {e}") from e
    if body is None:
        raise ValueError("this file's document has no body")
    return _walk(body, formats)


_PARSED = "path string, error string, lines array<struct<text: string, auto_fmt: string>>"


def docx_files(files: DataFrame) -> DataFrame:
    """(path, error, lines) of each of ``files(path, content)``: its lines, or why it cannot be read. A broken file is a row like others and stops no corpus; a null content is a file that is none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, FILES_EACH):
                some = batch.slice(begin, FILES_EACH)
                errors, ends, lines = [], [0], []
                for data in some.column("content"):
                    error = None
                    try:
                        lines += read_docx(data.as_py() or b"")
                    except (ValueError, RecursionError) as e:
                        error = str(e) or type(e).__name__
                    errors.append(error)
                    ends.append(len(lines))
                fields = [pa.array([x[k] for x in lines], pa.string()) for k in (0, 1)]
                found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["text", "auto_fmt"]))
                yield pa.RecordBatch.from_arrays([some.column("path").cast(pa.string()), pa.array(errors, pa.string()), found], names=["path", "error", "lines"])

    return files.select("path", "content").mapInArrow(work, _PARSED)


def docx_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, text, auto_fmt) of the readable ones of ``files(path, content)``, such as ``spark.read.format('binaryFile')`` gives."""
    return lines_of(docx_files(files))


def lines_of(parsed: DataFrame) -> DataFrame:
    """(path, line_no, text, auto_fmt) of ``docx_files``."""
    return parsed.select("path", F.posexplode("lines").alias("k", "l")).select("path", (F.col("k") + 1).cast("long").alias("line_no"), "l.text", "l.auto_fmt")


def _word_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path)


def load_with_errors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, errors): ``load``, and (path, error) of the Word files that cannot be read. Files are parsed once."""
    parsed = cut(docx_files(_word_files(spark, path)))
    return _with_text_files(spark, path, lines_of(parsed)), parsed.where("error is not null").select("path", "error")


def load(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, text, auto_fmt) of all .docx and .txt files under a path; other kinds are left alone, and Word files that cannot be read give no lines (``load_with_errors`` tells which). Spark's reader leaves out files of no bytes."""
    return _with_text_files(spark, path, docx_lines(_word_files(spark, path)))


def _with_text_files(spark: SparkSession, path: str, word: DataFrame) -> DataFrame:
    plain = spark.read.option("pathGlobFilter", "*.{txt,text}").option("recursiveFileLookup", True).text(path, wholetext=True)
    rows = plain.select(F.input_file_name().alias("path"), F.posexplode(F.split("value", r"\r?\n")).alias("k", "text"))
    return word.unionByName(rows.select("path", (F.col("k") + 1).cast("long").alias("line_no"), "text", F.lit("").alias("auto_fmt")))


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_TYPES = f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def twips(inches: float) -> int:
    return int(inches * 1440 + 0.5)


def paragraph_xml(text: str, bold: bool = False, indent_in: float = 0.0, before_pt: float = 0.0, line: float = 1.0, align: str = "", tabs_in: tuple[float, ...] = (), border: bool = False) -> str:
    stops = "".join(f'<w:tab w:val="left" w:pos="{twips(t)}"/>' for t in tabs_in)
    props = (f"<w:pBdr><w:bottom w:val=\"single\" w:sz=\"6\" w:space=\"1\" w:color=\"auto\"/></w:pBdr>" if border else "") + (f"<w:tabs>{stops}</w:tabs>" if stops else "")
    props += f'<w:spacing w:before="{int(before_pt * 20 + 0.5)}" w:line="{int(line * 240 + 0.5)}" w:lineRule="auto"/><w:ind w:left="{twips(indent_in)}"/>' + (f'<w:jc w:val="{align}"/>' if align else "")
    runs = "<w:tab/>".join(f'<w:t xml:space="preserve">{escape(t)}</w:t>' for t in text.split("\t"))
    return f"<w:p><w:pPr>{props}</w:pPr><w:r>{'<w:rPr><w:b/></w:rPr>' if bold else ''}{runs}</w:r></w:p>"


def write_docx(paragraphs: list[str], margins_in: tuple[float, float, float] = (0.75, 0.65, 0.75)) -> bytes:
    """A Word file of an A4 section from paragraphs of markup."""
    top, bottom, side = margins_in
    section = f'<w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="{twips(top)}" w:bottom="{twips(bottom)}" w:left="{twips(side)}" w:right="{twips(side)}"/></w:sectPr>'
    xml = f'{_HEAD}<w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(paragraphs)}{section}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", xml)):
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def docx_of_lines(lines: DataFrame) -> DataFrame:
    """(path, content): one Word file for each paper of ``lines(paper_id, line_no, flat)``."""
    each = lines.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "flat"))).alias("ls"))

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            made = [write_docx([paragraph_xml(x["flat"]) for x in ls]) for ls in frame["ls"]]
            yield pd.DataFrame({"path": [f"paper-{p}.docx" for p in frame["paper_id"]], "content": made})

    return each.mapInPandas(work, "path string, content binary")
