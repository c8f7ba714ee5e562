"""Word files with numbering, tables and content controls, files by their kind, pasted text, and the streams."""

import io
import zipfile

from pyspark.sql import functions as F

from paperloom.functions import normalize
from paperloom.sources import docx
from paperloom.streaming import ingest

NAMES = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def word_file(body, numbering=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NAMES}><w:body>{body}</w:body></w:document>")
        if numbering:
            z.writestr("word/numbering.xml", f"<w:numbering {NAMES}>{numbering}</w:numbering>")
    return out.getvalue()


def p(text, num=None, level="0"):
    number = f'<w:pPr><w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr></w:pPr>' if num else ""
    return f"<w:p>{number}<w:r><w:t>{text}</w:t></w:r></w:p>"


def test_tables_and_content_controls():
    def table(*rows):
        return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in cells) + "</w:tr>" for cells in rows) + "</w:tbl>"

    body = p("first") + f"<w:sdt><w:sdtPr/><w:sdtContent>{p('held')}{table([p('deep')])}</w:sdtContent></w:sdt>"
    body += table([p("one"), p("two") + p("more")], [table([p("inner"), p("right")]), p("four")]) + p("last")
    assert [t for t, _ in docx.read_docx(word_file(body))] == ["first", "held", "deep", "one\ttwo more", "inner\tright\tfour", "last"]


def test_automatic_numbers():
    levels = "".join(f'<w:lvl w:ilvl="{k}"><w:numFmt w:val="{f}"/></w:lvl>' for k, f in enumerate(("decimal", "lowerLetter", "bullet")))
    numbering = f'<w:abstractNum w:abstractNumId="7">{levels}</w:abstractNum><w:num w:numId="3"><w:abstractNumId w:val="7"/></w:num>'
    body = p("a", 3) + p("b", 3, "1") + p("c", 3, "2") + p("d", 3, "5") + p("e", 9) + p("f", "0") + p("g") + p(" ", 3)
    assert docx.read_docx(word_file(body, numbering)) == [("a", "d"), ("b", "a"), ("c", ""), ("d", "d"), ("e", "d"), ("f", ""), ("g", ""), (" ", "")]
    tabs = '<w:p><w:pPr><w:tabs><w:tab w:val="left" w:pos="9"/></w:tabs></w:pPr><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:t>z</w:t></w:r></w:p>'
    assert docx.read_docx(word_file(tabs)) == [("x\ty", ""), ("z", "")]


def test_files_by_their_kind(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.docx").write_bytes(word_file(p("word line")))
    (tmp_path / "in" / "b.txt").write_text("one\r\ntwo", encoding="utf-8")
    (tmp_path / "c.pdf").write_bytes(b"left alone")
    got = sorted((r["path"].rsplit("/", 1)[1], r["line_no"], r["text"]) for r in docx.load(spark, str(tmp_path)).collect())
    assert got == [("a.docx", 1, "word line"), ("b.txt", 1, "one"), ("b.txt", 2, "two")]


def test_pasted_text(spark):
    raw = "Tab 3\n\nQue 1. A apple ,please _____ [2026 -27]\n  last  line "
    lines, fixes = normalize.prepare(spark.createDataFrame([(1, raw)], "paper_id long, raw string"))
    assert [(r["line_no"], r["flat"]) for r in lines.orderBy("line_no").collect()] == [(3, "Que 1. An apple, please __________ [2026-27]"), (4, "last line")]
    found = {r["rule"] for r in fixes.collect()}
    assert found == {"document furniture", "punctuation spacing", "year range", "article", "blank length"}


def test_streams(spark, tmp_path):
    folder, out = tmp_path / "papers", tmp_path / "out"
    folder.mkdir()
    (folder / "a.txt").write_text("Que 1. Tick\nTab 3\n\n  two  words ", encoding="utf-8")
    schema = "paper_id long, seq long, key string, text string"
    for k, rows in enumerate(([(1, 1, "a", "x"), (1, 3, "a", "z")], [(1, 2, "a", "y"), (2, 4, "b", "w")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "log" / str(k)))

    def run(name, df, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(out / name)).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table(name)

    papers = run("papers_seen", ingest.paper_stream(spark, str(folder)), "append")
    assert sorted((r["line_no"], r["flat"]) for r in papers.collect()) == [(1, "Que 1. Tick"), (4, "two words")]
    log = spark.readStream.schema(schema).json(str(tmp_path / "log" / "*"))
    edits = run("edits_seen", ingest.latest_edits_stream(log), "complete")
    assert sorted(map(tuple, edits.select("paper_id", "key", "text", "seq").collect())) == [(1, "a", "z", 3), (2, "b", "w", 4)]
    assert edits.where(F.col("text").isNull()).count() == 0


def test_broken_files_stop_nothing(spark, tmp_path):
    """Every way in which a file can be broken is reported with its path; the others are read."""
    good = word_file(p("one") + p("two"))
    locked = bytearray(good)
    # The flag of an encrypted entry, in its own header and in the directory.
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        k = -1
        while (k := bytes(locked).find(mark, k + 1)) >= 0:
            locked[k + at] |= 1
    files = {"good": good, "text": b"not a zip", "cut": good[: len(good) // 2], "locked": bytes(locked), "later": word_file(p("three"))}
    for name, inner in (("none", {"other.xml": "x"}), ("torn", {"word/document.xml": "<w:document"}), ("bodiless", {"word/document.xml": "<a/>"})):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for entry, text in inner.items():
                z.writestr(entry, text)
        files[name] = out.getvalue()
    for name, data in files.items():
        (tmp_path / f"{name}.docx").write_bytes(data)
    (tmp_path / "plain.txt").write_text("line", encoding="utf-8")
    lines, errors = docx.load_with_errors(spark, str(tmp_path))
    short = lambda path: path.rsplit("/", 1)[1].split(".")[0]
    assert sorted((short(r.path), r.line_no, r.text) for r in lines.collect()) == [("good", 1, "one"), ("good", 2, "two"), ("later", 1, "three"), ("plain", 1, "line")]
    found = {short(r.path): r.error for r in errors.collect()}
    assert set(found) == set(files) - {"good", "later"}
    assert "zip" in found["text"] and "document.xml" in found["none"] and "XML" in found["torn"] and "body" in found["bodiless"] and "unpacked" in found["locked"]
    assert docx.load(spark, str(tmp_path)).count() == 4
    none = spark.createDataFrame([("a", None), ("b", bytearray())], "path string, content binary")
    assert all("zip" in r.error and r.lines == [] for r in docx.docx_files(none).collect())
