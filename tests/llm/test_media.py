"""Grouped blocks, and the tables of cues and tracks."""

from paperloom.llm import matroska as m


def grouped(references):
    """A file of one cluster whose blocks are grouped, some with a reference to another one."""
    body = m.element(m.TIMECODE, b"\x07")
    for k, refers in enumerate(references):
        block = m.element(m.BLOCK, b"\x81" + k.to_bytes(2, "big", signed=True) + b"\x00" + bytes([k]) * 5)
        body += m.element(m.BLOCK_GROUP, block + (m.element(m.REFERENCE, b"\xff") if refers else b""))
    track = m.element(m.TRACK, m.element(m.TRACK_NUMBER, b"\x01") + m.element(m.CODEC, b"V_TEST"))
    return m.element(m.EBML, m.element(m.DOC_TYPE, b"matroska")) + m.element(m.SEGMENT, m.element(m.TRACKS, track) + m.element(m.CLUSTER, body))


def test_key_frames_of_groups():
    references = [False, True, True, False]
    data = grouped(references)
    found = m.parse(data)
    assert [p.keyframe for p in found.packets] == [not r for r in references]
    assert [p.timestamp_ns for p in found.packets] == [(7 + k) * 1_000_000 for k in range(4)]
    assert [data[p.offset : p.offset + p.size] for p in found.packets] == [bytes([k]) * 5 for k in range(4)]


def test_cues_and_tracks(spark):
    docs = spark.createDataFrame([(1, "word " * 20_000), (2, ""), (3, None)], "doc_id long, text string")
    media = m.media_column(docs)
    cues = m.cue_table(media).where("doc_id = 1").collect()
    clusters = m.packet_table(media).where("doc_id = 1").select("cluster").distinct().count()
    assert [r["cluster"] for r in sorted(cues, key=lambda r: r["time"])] == list(range(clusters)) and clusters > 1
    assert {(r["doc_id"], r["track"], r["codec"]) for r in m.track_table(media).collect()} == {(k, 1, "A_PCM/INT/LIT") for k in (1, 2, 3)}
    assert m.cue_table(media.limit(0)).count() == m.track_table(media.limit(0)).count() == 0
    group = spark.createDataFrame([(9, bytearray(grouped([False, True]))), (10, None)], "doc_id long, media binary")
    assert [(r["keyframe"], r["size"]) for r in m.packet_table(group).collect()] == [(True, 5), (False, 5)] and m.cue_table(group).count() == 0
