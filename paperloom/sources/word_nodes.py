"""The blocks of Word files as a table of nodes, and their lines put together level by level (SRC-07, SRC-08)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.cutting import cut
from .docx import W, formats_of, paragraph_lines

NODE = "path string, node int, parent int, depth int, ord int, tag string, text string, auto_fmt string"
#: Elements that hold blocks, and paragraphs; all others are looked past.
HOLDERS = ("body", "tbl", "tr", "tc", "sdt", "sdtContent")
_LINES = "array<struct<text: string, auto_fmt: string>>"
_BLANKS = " \t\n\x0b\f\r"


def nodes_of(data: bytes) -> list[tuple]:
    """(node, parent, depth, ord, tag, text, auto_fmt) of a Word file's body, which is node 0; a paragraph's text has its line breaks."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        formats = formats_of(z.read("word/numbering.xml") if "word/numbering.xml" in z.namelist() else None)
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    out: list[tuple] = [(0, None, 0, 0, "body", None, None)]
    waiting = [(body, 0, 0)]
    while waiting:
        element, parent, depth = waiting.pop()
        for k, child in enumerate(element):
            tag = child.tag.removeprefix(W)
            if tag == "p":
                lines = paragraph_lines(child, formats)
                out.append((len(out), parent, depth + 1, k, tag, "\n".join(t for t, _ in lines), lines[0][1]))
            elif tag in HOLDERS:
                waiting.append((child, len(out), depth + 1))
                out.append((len(out), parent, depth + 1, k, tag, None, None))
    return out


def node_table(files: DataFrame) -> DataFrame:
    """(path, node, parent, depth, ord, tag, text, auto_fmt) of readable ``files(path, content)``; ``docx.docx_files`` tells which are not."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path, *n) for path, data in zip(frame["path"], frame["content"]) for n in nodes_of(bytes(data))]
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in NODE.split(", ")]).astype({"parent": "Int32"})

    return files.select("path", "content").mapInPandas(work, NODE)


def _lines(children: Column) -> Column:
    """A node's lines from those of its children(ord, lines): a paragraph's own, one of tabbed cells for a row, else the children's in order."""
    own = F.transform(F.split("text", "\n"), lambda t, k: F.struct(t.alias("text"), F.when((k == 0) & (F.trim(t, F.lit(_BLANKS)) != ""), F.coalesce("auto_fmt", F.lit(""))).otherwise("").alias("auto_fmt")))
    cells = F.transform(children, lambda c: F.trim(F.array_join(F.transform(c["lines"], lambda l: l["text"]), " "), F.lit(_BLANKS)))
    first = F.try_element_at(F.try_element_at(children, F.lit(1))["lines"], F.lit(1))["auto_fmt"]
    row = F.array(F.struct(F.array_join(cells, "\t").alias("text"), F.coalesce(first, F.lit("")).alias("auto_fmt")))
    return F.when(F.col("tag") == "p", own).when(F.col("tag") == "tr", row).otherwise(F.flatten(F.transform(children, lambda c: c["lines"]))).cast(_LINES)


def lines_of_nodes(nodes: DataFrame) -> DataFrame:
    """(path, line_no, text, auto_fmt) of a table of nodes: the lines of its bodies, from the deepest level up.

    A level is one grouping by parent; there are as many as tables are nested. A table's row is one line, its cells by tabs; a table within a cell gives lines of that cell.
    Content controls give the lines of what they hold. Cells and bodies without paragraphs have no text. An empty table gives an empty result.
    """
    nodes = cut(nodes)
    deepest = nodes.agg(F.max("depth")).first()[0]
    none = F.array().cast(f"array<struct<ord: int, lines: {_LINES}>>")
    below = None
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = nodes.where(F.col("depth") == depth)
        if below is None:
            level = level.withColumn("children", none)
        else:
            held = below.groupBy("path", F.col("parent").alias("node")).agg(F.array_sort(F.collect_list(F.struct("ord", "lines"))).alias("children"))
            level = level.join(held, ["path", "node"], "left").withColumn("children", F.coalesce("children", none))
        below = cut(level.select("path", "parent", "ord", _lines(F.col("children")).alias("lines")))
    if below is None:
        return nodes.select("path", F.lit(0).cast("long").alias("line_no"), "text", "auto_fmt")
    return below.select("path", F.posexplode("lines").alias("k", "l")).select("path", (F.col("k") + 1).cast("long").alias("line_no"), "l.text", "l.auto_fmt")
