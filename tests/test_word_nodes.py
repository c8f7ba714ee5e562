"""Lines put together from a table of nodes against the reader of whole files, on nested tables, content controls and numbers; and the query against its SQL."""

import random

import duckdb

from paperloom.plans import editing
from paperloom.sources import docx, word_nodes
from tests.conftest import SF001
from tests.test_sources import p, word_file

NUMBERING = '<w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:numFmt w:val="upperRoman"/></w:lvl></w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="7"/></w:num>'


def some_blocks(rng, depth=0):
    out = ""
    for _ in range(rng.randint(1, 3)):
        kind = rng.choice(["p", "p", "tbl", "sdt", "other"]) if depth < 3 else "p"
        if kind == "p":
            text = rng.choice(["one", " two ", "", "three &amp; four", "a</w:t><w:br/><w:t>b", "x</w:t><w:tab/><w:t>y"])
            out += p(text, rng.choice(["3", "9", "0"])) if rng.random() < 0.4 else p(text)
        elif kind == "tbl":
            rows = "".join("<w:tr>" + "".join(f"<w:tc>{some_blocks(rng, depth + 1) if rng.random() < 0.9 else ''}</w:tc>" for _ in range(rng.randint(0, 3))) + "</w:tr>" for _ in range(rng.randint(0, 2)))
            out += f"<w:tbl><w:tblPr/>{rows}</w:tbl>"
        elif kind == "sdt":
            out += f"<w:sdt><w:sdtPr/><w:sdtContent>{some_blocks(rng, depth + 1)}</w:sdtContent></w:sdt>"
        else:
            out += "<w:bookmarkStart/>"
    return out


def test_lines_of_nodes(spark):
    rng = random.Random(1)
    files = [(f"f{k}", bytearray(word_file(some_blocks(rng), NUMBERING))) for k in range(160)] + [("empty", bytearray(word_file("")))]
    got = word_nodes.lines_of_nodes(word_nodes.node_table(spark.createDataFrame(files, "path string, content binary"))).collect()
    want = [(path, n, t, c) for path, data in files for n, (t, c) in enumerate(docx.read_docx(bytes(data)), 1)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 150


def test_no_files(spark):
    assert word_nodes.lines_of_nodes(word_nodes.node_table(spark.createDataFrame([], "path string, content binary"))).collect() == []


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view part as select * from '{SF001}/part.parquet'")
    want = con.sql(editing.ORACLES["word_nodes"])
    assert sorted(map(tuple, editing.QUERIES["word_nodes"](spark, SF001).select(*want.columns).collect())) == sorted(want.fetchall())
