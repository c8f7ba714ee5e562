"""The same results in DuckDB's SQL, written from the rules and not from the plans."""

from __future__ import annotations

from ..constants import DENSITIES, DEVANAGARI, HINDI_ITEMS, HINDI_OPTIONS, LETTERS, LINE_DEVANAGARI, LINE_LATIN, MAX_FIXES, PAGE_HEIGHT_IN, PAGE_WIDTH_IN, ROMAN, SAFETY, SUGGESTIONS, WIDTH_CLASSES
from ..functions import patterns as P
from .corpus import ORACLE_LINES
from .literals import LITERALS


def q(text: str) -> str:
    """A string literal."""
    return "'" + text.replace("'", "''") + "'"


def rep(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, 'g')"


def hit(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def ext(x: str, pattern: str, group: int) -> str:
    return f"coalesce(regexp_extract({x}, {q(pattern)}, {group}), '')"


def collapse(x: str) -> str:
    return f"trim({rep(x, '[ ' + chr(9) + chr(160) + ']+', ' ')})"


def clean(x: str) -> str:
    return collapse(rep(x, "[\x01\x02]", " "))


def marked(x: str) -> str:
    bare = rep(f"translate({x}, chr(160) || chr(13), '  ')", r"^[ \t]+|[ \t]+$", "")
    return rep(rep(bare, r"[ ]*\t[ \t]*", "\x01"), r"[ ][ ]+", "\x02")


def count_of(x: str, characters: str) -> str:
    return f"(length({x}) - length(translate({x}, {q(characters)}, '')))"


def centi_em(x: str) -> str:
    return f"(length({x}) * 52 + " + " + ".join(f"{count_of(x, c)} * {w - 52}" for c, w in WIDTH_CLASSES) + ")"


def width(x: str) -> str:
    return f"({centi_em(x)} * 12.0::DOUBLE / 7200.0::DOUBLE)"


def line_count(x: str, available: str) -> str:
    return f"(CASE WHEN {x} = '' THEN 1 ELSE greatest(1, CAST(ceil({width(x)} / {available} - 0.02::DOUBLE) AS BIGINT)) END)"


def hindi(x: str) -> str:
    return f"({count_of(x, DEVANAGARI)} > 0)"


def spacing(x: str) -> str:
    return rep(rep(x, r"[ ]+([,;:.?!।])", r"\1"), r"([,;])([A-Za-z\x{0900}-\x{097F}])", r"\1 \2")


def years(x: str) -> str:
    return rep(x, r"([0-9]{4})[ ]*-[ ]*([0-9]{2})", r"\1-\2")


def articles(x: str) -> str:
    from ..constants import A_BEFORE_VOWEL, AN_BEFORE_CONSONANT

    start, end = r"(^|[^A-Za-z0-9_'.])([Aa])", r"(?:$|[^A-Za-z])"
    x = rep(x, start + " ([aeiouAEIOU][A-Za-z])", r"\1\2n \3")
    x = rep(x, start + "n ([b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z][a-z])", r"\1\2 \3")
    x = rep(x, rf"{start}n ({'|'.join(A_BEFORE_VOWEL)})({end})", r"\1\2 \3\4")
    return rep(x, rf"{start} ({'|'.join(AN_BEFORE_CONSONANT)})({end})", r"\1\2n \3\4")


def blanks(x: str) -> str:
    return rep(x, "__+", "_" * 10)


def boxes(x: str) -> str:
    tail = ext(x, f"({P.TRUTH_BOX})", 1)
    head = f"substring({x}, 1, length({x}) - length({tail}))"
    return f"({rep(head, r'''\([ _\x01\x02]*\)|\[[ _\x01\x02]*\]''', '( )')} || CASE WHEN {tail} <> '' THEN '[ ]' ELSE '' END)"


def label(x: str) -> str:
    return f"(CASE WHEN {ext(x, P.LABEL, 1)} <> '' THEN {ext(x, P.LABEL, 1)} ELSE {ext(x, P.GLUED_LABEL, 1)} END)"


def rest(x: str) -> str:
    glued = ext(x, P.GLUED_LABEL, 1)
    return f"(CASE WHEN {ext(x, P.LABEL, 1)} <> '' THEN trim(regexp_replace({x}, {q(P.LABEL)}, '')) WHEN {glued} <> '' THEN trim(substring({x}, length({glued}) + 1)) ELSE {x} END)"


def form(x: str) -> str:
    later = ", ".join(q(r) for r in ROMAN[1:])
    letters = ", ".join
    return (
        f"(CASE WHEN {hit(x, '^[0-9]{1,2}$')} THEN 'd' WHEN {x} IN ({later}) THEN 'r' WHEN lower({x}) IN ({later}) THEN 'R' WHEN {hit(x, '^[a-z]$')} THEN 'a' WHEN {hit(x, '^[A-Z]$')} THEN 'A' "
        f"WHEN {x} IN ({letters(map(q, HINDI_OPTIONS))}) THEN 'option-hi' WHEN {x} IN ({letters(map(q, HINDI_ITEMS))}) THEN 'hindi-letter' END)"
    )


def position(x: str, f: str) -> str:
    def at(xs: list[str], v: str) -> str:
        return f"coalesce(list_position([{', '.join(map(q, xs))}], {v}), 0) - 1"

    return (
        f"CAST(coalesce(CASE {f} WHEN 'd' THEN TRY_CAST({x} AS INT) - 1 WHEN 'r' THEN {at(ROMAN, f'lower({x})')} WHEN 'R' THEN {at(ROMAN, f'lower({x})')} WHEN 'a' THEN ascii({x}) - 97 "
        f"WHEN 'A' THEN ascii({x}) - 65 WHEN 'option-hi' THEN {at(HINDI_OPTIONS, x)} WHEN 'hindi-letter' THEN {at(HINDI_ITEMS, x)} END, -1) AS BIGINT)"
    )


def marks(x: str) -> str:
    return f"translate({rep(ext(x, P.MARKS, 1), '[ ' + chr(9) + ']+', '')}, 'X×', 'xx')"


def no_marks(x: str) -> str:
    return f"regexp_replace({x}, {q(P.MARKS)}, '')"


def polished(x: str) -> str:
    return f"(upper(substring({x}, 1, 1)) || substring({x}, 2))"


def heading(x: str) -> str:
    """The steps of a heading's wording, one inside the other, as a scalar subquery so that each is written once."""
    imperative = hit("b", P.IMPERATIVE)
    return f"""(SELECT CASE WHEN {hindi('d')} OR {hit('d', '[?:।॥|]$')} THEN d ELSE d || ':' END FROM (SELECT CASE WHEN {hit('c', r'[.][ ]*$')} AND NOT {hit('c', r'[A-Za-z][.][A-Za-z]')} THEN {rep('c', r'[ ]*[.][ ]*$', '')} ELSE c END AS d
      FROM (SELECT CASE WHEN {hit('b', r'[?]+[ ]*$')} AND {imperative} THEN {rep('b', r'[?]+[ ]*$', '')} ELSE b END AS c
      FROM (SELECT {rep(collapse(rep(rep('a', '__+', ' '), '[ ]*,([ ]*,)+', ',')), '[ ]*[-–—_:;,]+[ ]*$', '')} AS b FROM (SELECT {polished(x)} AS a)))))"""


#: The corpus as marked, fixed and cut lines, questions and bodies.
LINES = f"""WITH RECURSIVE raw_lines AS ({ORACLE_LINES}),
s0 AS (SELECT paper_id, line_no, raw, {hit('trim(raw)', P.FURNITURE)} AS furniture, {marked('raw')} AS t0 FROM raw_lines WHERE trim(raw) <> ''),
s1 AS (SELECT *, {spacing('t0')} AS t1 FROM s0), s2 AS (SELECT *, {years('t1')} AS t2 FROM s1), s3 AS (SELECT *, {articles('t2')} AS t3 FROM s2),
s4 AS (SELECT *, {blanks('t3')} AS t4 FROM s3), s5 AS (SELECT *, {boxes('t4')} AS t5 FROM s4),
lines AS (SELECT paper_id, line_no, t5 AS text, {clean('t5')} AS flat FROM s5 WHERE NOT furniture),
numbered AS (SELECT *, CASE WHEN {ext('flat', P.QUESTION, 1)} <> '' THEN {ext('flat', P.QUESTION, 1)} ELSE {ext('flat', P.QUESTION, 2)} END AS number, {ext('flat', P.QUESTION, 3)} AS rest FROM lines),
seg AS (SELECT paper_id, line_no, text, flat, number, number <> '' AS is_heading, CAST(sum(CASE WHEN number <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY line_no) AS BIGINT) AS q_idx,
  CASE WHEN number <> '' THEN {no_marks('rest')} END AS heading, CASE WHEN number <> '' THEN {marks('rest')} END AS marks FROM numbered),
body AS (SELECT * FROM seg WHERE q_idx > 0 AND NOT is_heading)
"""


def could(before: str, flat: str) -> str:
    return f"coalesce({before} <> '' AND NOT {hit(before, P.FINISHED)} AND {flat} <> '' AND NOT {hit(flat, P.BLANK)} AND {label(flat)} = '', false)"


FOLDED = f"""{LINES},
placed AS (SELECT *, row_number() OVER w AS place, first_value(heading) OVER w AS head, first_value(marks) OVER w AS head_marks FROM seg WHERE q_idx > 0 WINDOW w AS (PARTITION BY paper_id, q_idx ORDER BY line_no)),
judged AS (SELECT *, place = 2 AND {could(clean('head'), 'flat')} AND CASE WHEN {hit('head', P.QUOTED)} THEN head_marks = '' AND {hit('flat', P.MARKS)} ELSE {width(clean('head'))} >= 3.4 OR (head_marks = '' AND {hit('flat', P.MARKS)}) END AS folded FROM placed),
tails AS (SELECT *, max(CASE WHEN folded THEN flat END) OVER (PARTITION BY paper_id, q_idx) AS tail FROM judged),
fulls AS (SELECT *, CASE WHEN tail IS NULL THEN head ELSE {collapse(clean('head') + " || ' ' || tail")} END AS joined_head FROM tails),
lifted AS (SELECT *, CASE WHEN tail IS NULL THEN joined_head ELSE {no_marks('joined_head')} END AS heading2, CASE WHEN head_marks <> '' THEN head_marks WHEN tail IS NULL THEN '' ELSE {marks('joined_head')} END AS marks2 FROM fulls),
strays AS (SELECT *, min(CASE WHEN NOT is_heading AND NOT folded AND marks2 = '' AND {hit('flat', P.MARKS)} THEN line_no END) OVER (PARTITION BY paper_id, q_idx) AS stray FROM lifted),
done AS (SELECT *, coalesce(max(CASE WHEN line_no = stray THEN {marks('flat')} END) OVER (PARTITION BY paper_id, q_idx), marks2) AS marks3 FROM strays),
questions AS (SELECT paper_id, q_idx, number, heading2 AS heading, marks3 AS marks, tail IS NOT NULL AS folded FROM done WHERE is_heading),
bodies AS (SELECT paper_id, q_idx, line_no, CASE WHEN line_no = stray THEN trim({no_marks('text')}) ELSE text END AS text, heading2 AS heading FROM done WHERE NOT is_heading AND NOT folded),
b0 AS (SELECT *, {clean('text')} AS own, row_number() OVER (PARTITION BY paper_id, q_idx ORDER BY line_no) AS n FROM bodies WHERE text <> '')
"""

#: The sequential fold itself: each line either goes on with the accumulated one or opens the next.
WRAPPED = f"""{FOLDED},
fold AS (SELECT paper_id, q_idx, n, own AS acc, 1 AS group_no FROM b0 WHERE n = 1
  UNION ALL SELECT b.paper_id, b.q_idx, b.n, CASE WHEN f.goes THEN f.acc || ' ' || b.own ELSE b.own END, f.group_no + CASE WHEN f.goes THEN 0 ELSE 1 END
  FROM (SELECT f.*, b.own AS next, {could('f.acc', 'b.own')} AND {width('f.acc')} >= 3.4 AND NOT {hit('b.heading', P.QUOTED)} AS goes FROM fold f JOIN b0 b ON b.paper_id = f.paper_id AND b.q_idx = f.q_idx AND b.n = f.n + 1) f
  JOIN b0 b ON b.paper_id = f.paper_id AND b.q_idx = f.q_idx AND b.n = f.n + 1),
groups AS (SELECT paper_id, q_idx, CAST(group_no AS BIGINT) AS group_no, arg_max(acc, n) AS flat FROM fold GROUP BY paper_id, q_idx, group_no)
"""

_LITERALS = "(VALUES " + ", ".join(f"({k}, {q(t)})" for k, t in LITERALS) + ") v(id, text)"
_TEXTS = f"(SELECT doc_id, u.pos - 1 AS pos, u.line AS line FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos) u UNION ALL SELECT -id, 0, text FROM {_LITERALS})"
_WIDTHS = f"SELECT doc_id, CAST(pos AS BIGINT) AS pos, CAST({centi_em('line')} AS BIGINT) AS centi_em, CAST({count_of('line', LETTERS)} AS BIGINT) AS letters, CAST({line_count('line', '6.8::DOUBLE')} AS BIGINT) AS lines, CASE WHEN {hindi('line')} THEN 'hi' ELSE 'en' END AS script FROM {_TEXTS}"


def _split(table: str, columns: str) -> str:
    return f"SELECT {columns}, u.line_no - 1 AS line_no, u.raw FROM {table}, LATERAL (SELECT unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line_no) u"


def _rule(rule) -> str:
    return f"SELECT paper_id, line_no, {rule('raw')} AS fixed FROM (SELECT * FROM ({ORACLE_LINES}) UNION ALL SELECT -1 - doc_id, line_no, raw FROM ({_split('documents', 'doc_id')})) WHERE {rule('raw')} <> raw"


_AUDIT = "SELECT paper_id, line_no, CAST(-1 AS BIGINT) AS step, 'document furniture' AS rule, trim(raw) AS before, '' AS after FROM s5 WHERE furniture UNION ALL " + " UNION ALL ".join(
    f"SELECT paper_id, line_no, CAST({k} AS BIGINT), {q(name)}, {clean(f't{k}')}, {clean(f't{k + 1}')} FROM s5 WHERE NOT furniture AND {clean(f't{k}')} <> {clean(f't{k + 1}')}"
    for k, name in enumerate(("punctuation spacing", "year range", "article", "blank length", "tick box"))
)
_WORDING = "regexp_replace(replace({0}, ' ', ''), '__+', '_', 'g')"
_FIXES = f"{LINES}, every AS ({_AUDIT}), audit AS (SELECT * FROM every WHERE {_WORDING.format('before')} <> {_WORDING.format('after')})"

_LOST = f"SELECT paper_id, q_idx, 'instruction punctuation' AS rule, {collapse('heading')} AS before, {heading('trim(questions.heading)')} AS after FROM questions WHERE {hit('heading', r'[?]+[ ]*[-–—_:;,]*[ ]*$')} AND {hit(polished('trim(heading)'), P.IMPERATIVE)}"
_PARSER = f"{FOLDED} {_LOST}"
_FIXES_TOO = f"{FOLDED}, every AS ({_AUDIT}), audit AS (SELECT * FROM every WHERE {_WORDING.format('before')} <> {_WORDING.format('after')}), all_fixes AS (SELECT 0 AS part, * FROM audit UNION ALL SELECT 1, paper_id, q_idx, 0, rule, before, after FROM ({_LOST}))"

_OPTIONS = f"""{LINES},
chunked AS (SELECT paper_id, line_no, [trim({rep('c', '[' + chr(1) + chr(2) + ']', ' ')}) for c in regexp_split_to_array(text, {q(P.EMPTY_BOX)})] AS cs, len(regexp_extract_all(text, {q(P.EMPTY_BOX)})) AS boxes FROM body),
opened AS (SELECT paper_id, line_no, boxes, i AS place, cs[i] AS c, i = len(cs) AS last FROM (SELECT *, unnest(generate_series(1, len(cs))) AS i FROM chunked WHERE boxes >= 2)),
named AS (SELECT *, {label('c')} AS l, {rest('c')} AS r, {ext('c', P.BARE_LABEL, 1)} AS bl, trim({ext('c', P.BARE_LABEL, 2)}) AS br FROM opened),
options AS (SELECT paper_id, line_no, place, CASE WHEN l <> '' AND r <> '' THEN l WHEN l = '' AND bl <> '' THEN bl ELSE '' END AS label, CASE WHEN l <> '' AND r <> '' THEN r WHEN l = '' AND bl <> '' THEN br WHEN NOT last THEN c ELSE '' END AS text FROM named),
kept AS (SELECT *, count(*) OVER (PARTITION BY paper_id, line_no) AS n, row_number() OVER (PARTITION BY paper_id, line_no ORDER BY place) - 1 AS k FROM options WHERE text <> '')
SELECT paper_id, line_no, CAST(k AS BIGINT) AS k, label, text FROM kept WHERE n >= 2"""

_DENSITIES = "(VALUES " + ", ".join(f"({r[0]}, {q(r[1])}, {r[3]}::DOUBLE, {r[4]}::DOUBLE, {r[5]}::DOUBLE, {r[6]}::DOUBLE, {r[9]}::DOUBLE)" for r in DENSITIES) + ") d(rung, density_id, top, bottom, side, line, gap_sub)"
_CONTENT = f"({PAGE_WIDTH_IN}::DOUBLE - 2.0::DOUBLE * side)"
_PAGINATE = f"""WITH RECURSIVE ls AS ({_split('documents', 'doc_id')}),
bs AS (SELECT doc_id AS paper_id, rung, density_id, line_no + 1 AS n, CAST({line_count('raw', _CONTENT)} * 1400000 + 200000 AS BIGINT) AS h,
  CAST(floor(({PAGE_HEIGHT_IN}::DOUBLE - top - bottom) * 72.0::DOUBLE * {SAFETY}::DOUBLE * 100000) AS BIGINT) AS cap FROM ls, {_DENSITIES}),
walk AS (SELECT paper_id, rung, density_id, n, 1 AS page, h AS used FROM bs WHERE n = 1
  UNION ALL SELECT b.paper_id, b.rung, b.density_id, b.n, w.page + CASE WHEN w.used > 0 AND w.used + b.h > b.cap THEN 1 ELSE 0 END, CASE WHEN w.used > 0 AND w.used + b.h > b.cap THEN b.h - 200000 ELSE w.used + b.h END
  FROM walk w JOIN bs b ON b.paper_id = w.paper_id AND b.rung = w.rung AND b.n = w.n + 1)
"""
_PAGES = "SELECT paper_id, density_id, CAST(max(page) AS BIGINT) AS pages FROM walk GROUP BY paper_id, density_id"
_DOCUMENT_JOIN = f"""WITH RECURSIVE ls AS ({_split('documents', 'doc_id')}),
b0 AS (SELECT doc_id, {clean('raw')} AS own, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM ls WHERE trim(raw) <> ''),
fold AS (SELECT doc_id, n, own AS acc, 1 AS group_no, 0 AS joined FROM b0 WHERE n = 1
  UNION ALL SELECT doc_id, n + 1, CASE WHEN goes THEN acc || ' ' || next ELSE next END, group_no + CASE WHEN goes THEN 0 ELSE 1 END, joined + CASE WHEN goes THEN 1 ELSE 0 END
  FROM (SELECT f.*, b.own AS next, {could('f.acc', 'b.own')} AND {width('f.acc')} >= 3.4 AS goes FROM fold f JOIN b0 b ON b.doc_id = f.doc_id AND b.n = f.n + 1))
SELECT doc_id AS paper_id, CAST(max(group_no) AS BIGINT) AS n_groups, CAST(max(joined) AS BIGINT) AS n_joined FROM fold GROUP BY doc_id"""
_NUMBERING = """WITH levels AS (SELECT r_regionkey AS a, l, ['decimal', 'lowerLetter', 'upperRoman', 'bullet', 'lowerRoman', 'ordinal', 'upperLetter'][(r_regionkey * 2 + l) % 7 + 1] AS fmt FROM region, range(4) r(l) WHERE (r_regionkey + l) % 4 <> 3),
told AS (SELECT p_partkey, CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 27 END AS num, coalesce(own.fmt, zero.fmt, 'decimal') AS fmt FROM part LEFT JOIN nation ON p_partkey % 11 <> 0 AND n_nationkey = p_partkey % 27
  LEFT JOIN levels own ON own.a = n_regionkey AND own.l = p_size % 4 LEFT JOIN levels zero ON zero.a = n_regionkey AND zero.l = 0)
SELECT p_partkey AS para_no, CASE WHEN num IS NULL OR num = 0 OR fmt = 'bullet' THEN '' WHEN fmt = 'lowerLetter' THEN 'a' WHEN fmt = 'upperLetter' THEN 'A' WHEN fmt = 'lowerRoman' THEN 'r' WHEN fmt = 'upperRoman' THEN 'R' ELSE 'd' END AS auto_fmt FROM told"""
_ESC = "raw"
for _a, _b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
    _ESC = f"replace({_ESC}, '{_a}', '{_b}')"
_HTML = f""", shown AS (SELECT w.paper_id, w.page, w.n, raw, row_number() OVER (PARTITION BY w.paper_id, w.page ORDER BY w.n) = 1 AS opens FROM walk w JOIN ls ON ls.doc_id = w.paper_id AND ls.line_no + 1 = w.n WHERE density_id = 'normal')
SELECT paper_id, CAST(page AS BIGINT) AS page_no, '<section class="page" data-page="' || page || '">' || string_agg('<p class="line' || CASE WHEN n = 1 THEN ' bold' ELSE '' END || '" style="margin-top:' || CASE WHEN opens THEN '0.00' ELSE '2.00' END
  || 'pt;margin-left:0.30in"><span data-edit-key="q0.i' || (n - 1) || '">' || {_ESC} || '</span></p>', '' ORDER BY n) || '<footer>Page ' || page || '</footer></section>' AS html FROM shown GROUP BY paper_id, page"""
_PAGE_NUMBERS = "SELECT paper_id, density_id, CAST(page AS BIGINT) AS page_no, min(n) AS first_line, count(*) AS n FROM walk GROUP BY paper_id, density_id, page"
_HEIGHT = f"""SELECT doc_id AS paper_id, density_id, CAST(sum(CAST(round(({line_count('raw', f'({_CONTENT} - 0.3::DOUBLE - 0.0::DOUBLE)')} * (CASE WHEN {hindi('raw')} THEN {12.0 * LINE_DEVANAGARI!r}::DOUBLE ELSE {12.0 * LINE_LATIN!r}::DOUBLE END * line) + gap_sub) * 100000) AS BIGINT)) AS BIGINT) AS height_u, count(*) AS n
FROM ({_split('documents', 'doc_id')}), {_DENSITIES} GROUP BY doc_id, density_id"""

_PACK = f"""WITH cells AS (SELECT p_partkey, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS i, len(cs) AS n FROM (SELECT p_partkey, string_split(p_name || ' ' || p_brand || ' ' || p_type || ' ' || p_name, ' ') AS cs FROM part)),
tried AS (SELECT p_partkey, n, cols, i % cols AS col, max({width('c')}) AS w FROM cells, (SELECT unnest(generate_series(2, 6)) AS cols) WHERE cols <= n GROUP BY ALL),
fit AS (SELECT p_partkey, n, cols FROM tried GROUP BY ALL HAVING sum(w) + 0.2::DOUBLE * (cols - 1) <= 3.0),
best AS (SELECT p_partkey, n, max(cols) AS cols FROM fit GROUP BY ALL)
SELECT p.p_partkey, CAST(coalesce(e.cols, b.cols, 1) AS BIGINT) AS cols FROM part p LEFT JOIN best b USING (p_partkey)
LEFT JOIN fit e ON e.p_partkey = b.p_partkey AND e.cols < b.cols AND e.cols = ceil(b.n / ceil(b.n / b.cols))"""
_MATCH_WIDTH = f"""WITH w AS (SELECT p_type, max({width("(p_brand || ' ' || p_name)")}) AS widest FROM part GROUP BY p_type)
SELECT p_type, density_id, CAST(round(least(greatest(widest + 0.45::DOUBLE, {_CONTENT} / 3.0::DOUBLE), {_CONTENT} * 0.55::DOUBLE) * 1000) AS BIGINT) AS left_milli FROM w, {_DENSITIES}"""

_DOUBLED = f"""WITH w AS (SELECT doc_id AS paper_id, line_no, ws[i] AS word, ws[i + 1] AS after FROM (SELECT *, unnest(generate_series(1, len(ws) - 1)) AS i FROM (SELECT doc_id, line_no, [x for x in regexp_split_to_array(lower(raw), '[^a-z]+') if x <> ''] AS ws FROM ({_split('documents', 'doc_id')}))))
SELECT paper_id, CAST(line_no AS BIGINT) AS line_no, count(*) AS n, min(word) AS first_word FROM w WHERE word = after GROUP BY ALL"""

_SHORT = rep(rep("r", "__+", " "), "[.?।]+$", "")
_LABELS = f"{LINES}, stripped AS (SELECT paper_id, line_no, q_idx, {label('flat')} AS label, {rest('flat')} AS rest FROM body)"

_PAIRS = f"""{LINES}, cut AS (SELECT paper_id, line_no, CASE WHEN {label('text')} <> '' THEN {rest('text')} ELSE text END AS t FROM body),
parts AS (SELECT *, [{clean('x')} for x in string_split_regex(t, CASE WHEN strpos(t, chr(1)) = 0 THEN '[' || chr(1) || chr(2) || ']' ELSE chr(1) END)] AS xs FROM cut WHERE NOT {hit('t', P.BLANK_OR_BOX)} AND NOT {hit('t', P.SENTENCE_END)}),
sides AS (SELECT paper_id, line_no, ys[1] AS left, array_to_string(ys[2:], ' ') AS right FROM (SELECT *, [x for x in xs if x <> ''] AS ys FROM parts) WHERE len(ys) >= 2)
SELECT paper_id, line_no, left, right FROM sides WHERE {' AND '.join(f"length({s}) <= 40 AND len(string_split_regex({s}, '[ ]+')) <= 5 AND NOT {hit(s, P.BLANK_OR_BOX)}" for s in ('"left"', '"right"'))}""".replace(" left,", ' "left",').replace(" right FROM", ' "right" FROM').replace("AS left", 'AS "left"').replace("AS right", 'AS "right"')

ORACLES: dict[str, str] = {
    "spacing_fix": _rule(spacing),
    "year_range_fix": _rule(years),
    "article_fix": _rule(articles),
    "blank_normalize": _rule(blanks),
    "box_normalize": _rule(boxes),
    "line_tokenize": f"SELECT source, conv_id, part, CAST(line_no AS BIGINT) AS line_no, {clean(marked('raw'))} AS flat, CAST(len(string_split_regex({marked('raw')}, '[\x01\x02]')) AS BIGINT) AS n_columns FROM ({_split('(SELECT ' + q('conversations') + ' AS source, conv_id, turn AS part, text FROM conversations UNION ALL SELECT ' + q('documents') + ', doc_id, 0, text FROM documents)', 'source, conv_id, part')}) WHERE {clean(marked('raw'))} <> ''",
    "text_width": _WIDTHS,
    "corpus_text_stats": f"SELECT script, count(*) AS n, CAST(sum(centi_em) AS BIGINT) AS centi_em, CAST(sum(letters) AS BIGINT) AS letters, CAST(sum(lines) AS BIGINT) AS lines FROM ({_WIDTHS}) GROUP BY script",
    "collapse_spaces": f"SELECT paper_id, line_no, {collapse('raw')} AS flat FROM ({ORACLE_LINES})",
    "furniture_filter": f"SELECT paper_id, line_no, trim(raw) AS raw FROM ({ORACLE_LINES}) WHERE {hit('trim(raw)', P.FURNITURE)}",
    "fix_audit": f"{_FIXES} SELECT * FROM audit",
    "parser_fixes": _PARSER,
    "fix_cap": f"{_FIXES_TOO} SELECT paper_id, ord, rule, before, after FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY part, line_no, step) AS ord FROM all_fixes) WHERE ord <= {MAX_FIXES}",
    "doubled_word_suggest": _DOUBLED,
    "question_segments": f"{LINES} SELECT paper_id, line_no, q_idx, is_heading, number FROM seg",
    "question_marks": f"{LINES} SELECT paper_id, q_idx, number, trim(heading) AS heading, marks FROM seg WHERE is_heading",
    "heading_fold": f"{FOLDED} SELECT paper_id, q_idx, trim(heading) AS heading, marks, folded FROM questions",
    "wrapped_line_join": f"{WRAPPED} SELECT paper_id, q_idx, group_no, flat FROM groups",
    "label_strip": f"{_LABELS} SELECT paper_id, line_no, label, rest FROM stripped",
    "label_format": f"{_LABELS} SELECT paper_id, line_no, label, coalesce({form('label')}, '') AS form, {position('label', form('label'))} AS position FROM stripped WHERE label <> ''",
    "options_split": _OPTIONS,
    "pair_split": _PAIRS,
    "short_items": f"{_LABELS}, s AS (SELECT paper_id, line_no, trim({_SHORT.replace('(r,', '(rest,')}) AS b FROM stripped) SELECT paper_id, line_no, {count_of('b', LETTERS)} <= 14 AND length(b) <= 30 AND {width('b')} <= 2.4 AS is_short FROM s",
    "heading_polish": f"{LINES} SELECT paper_id, q_idx, {heading('trim(seg.heading)')} AS heading FROM seg WHERE is_heading",
    "imperative_flag": f"{LINES} SELECT conv_id, turn, {hit('trim(text)', P.IMPERATIVE)} AS imperative FROM conversations UNION ALL SELECT -1 - paper_id, q_idx, {hit('trim(heading)', P.IMPERATIVE)} FROM seg WHERE is_heading",
    "column_pack": _PACK,
    "match_width": _MATCH_WIDTH,
    "block_height": _HEIGHT,
    "paginate": _PAGINATE + _PAGES,
    "page_numbers": _PAGINATE + _PAGE_NUMBERS,
    "html_preview": _PAGINATE + _HTML,
    "edit_log": "SELECT user_id AS paper_id, event_type AS key, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND value > 20",
    "writing_room": f"{LINES} SELECT paper_id, line_no, flat AS text FROM body WHERE trim(flat) <> '' AND {hit(f'regexp_replace(trim(flat), {q(P.ITEM_LABEL)}, {q(chr(0)[:0])})', P.WRITING_ROOM)}",
    "corpus_marks_stats": f"{FOLDED} SELECT number, count(*) AS n, CAST(sum(CASE WHEN marks = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_without, max(marks) AS most FROM questions GROUP BY number",
    "document_line_join": _DOCUMENT_JOIN,
    "numbering_lookup": _NUMBERING,
    "docx_roundtrip": f"{LINES} SELECT 'paper-' || paper_id || '.docx' AS path, row_number() OVER (PARTITION BY paper_id ORDER BY line_no) AS line_no, flat AS text, '' AS auto_fmt FROM lines",
}
