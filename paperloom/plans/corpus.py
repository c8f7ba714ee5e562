"""A corpus of question papers made from the driver's tables, in SQL that Spark and DuckDB read alike.

Eight rows of ``part`` make one paper; every row adds lines to it. Headings, labels, spacing and marks are typed in as
many ways as real papers have, so that every operator meets lines that it changes and lines that it leaves alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize
from ..operators import segment

_P = "CAST(floor(p_partkey / 8.0) AS BIGINT)"
_K = "(p_partkey % 8)"


def _typed(no: str, text: str, where: str = "true") -> tuple[str, str, str]:
    return no, text, where


def _of(column: str, *cases: str) -> str:
    """One of the texts, by turns."""
    whens = " ".join(f"WHEN {column} % {len(cases)} = {k} THEN {c}" for k, c in enumerate(cases))
    return f"CASE {whens} END"


_ROMAN = "CASE k WHEN 0 THEN 'i' WHEN 1 THEN 'ii' WHEN 2 THEN 'iii' WHEN 3 THEN 'iv' WHEN 4 THEN 'v' WHEN 5 THEN 'vi' WHEN 6 THEN 'vii' ELSE 'viii' END"
_SECTIONS = [
    _typed("1", _of("paper_id", "'SS Academy koirauna  Bhadohi'", "'S.S Academy - Gyanpur __'", "'St Mary Public School'", "'नवीन विद्यालय भदोही'"), "k = 0"),
    _typed("2", "'Tab 3'", "k = 0 AND paper_id % 4 = 1"),
    _typed("3", _of("paper_id", "'Half _ yearly Examination 2026 -27'", "'ANNUAL EXAMINATION OF THE YEAR'", "'Unit Test exam CBSE S.A.'"), "k = 0"),
    _typed("4", _of("paper_id", "'Sub:- English.'", "'Subject  G.K.'", "'विषय- हिन्दी'", "'Sub : ' || p_brand || ' Time_ 2:30 hrs'", "'Standard work'"), "k = 0"),
    _typed("5", _of("paper_id", "'Time- 2:30  Class :- 5th' || chr(9) || 'M.M.__50'", "'Class- Nursery   Total Marks 100'", "'समय- 3 घंटे  कक्षा- 8'", "'STANDARD Examination | Std VI | Mark 40'"), "k = 0"),
    _typed("100", _of("paper_id", "'Que 1. Tick the correct option _ (5)'", "'Q.1) Choose the right answer [10]'", "'question 1 - Tick the best option ( 2 X 5 )'"), "k = 0"),
    _typed("101 + 3 * k", "CAST(k + 1 AS STRING) || '. which is a ' || p_name || '?'"),
    _typed("102 + 3 * k", _of("p_partkey", "'A. ' || p_brand || ' ( ) B. ' || p_type || ' [ ] C. size ' || CAST(p_size AS STRING) || ' ( )'", "'(a) ' || p_brand || '(  )  b bird ( ) tall ( )'", "'A. only one ( )'")),
    _typed("200", _of("paper_id", "'Q2- Match the following [4]'", "'Ques 2 - Match the columns ___'", "'Que 2: मिलान कीजिए (4)'"), "k = 0"),
    _typed("201", "'Column A' || chr(9) || 'Column B'", "k = 0 AND paper_id % 2 = 0"),
    _typed("202 + k", _of("p_partkey", "CAST(k + 1 AS STRING) || '. ' || p_brand || chr(9) || '(a) ' || p_type", "p_brand || '   ' || CAST(p_size AS STRING)", "'(' || CAST(k + 1 AS STRING) || ') alone'")),
    _typed("300", _of("paper_id", "'Question 3: Fill in the blanks'", "'Q3 Fill up the blanks (8)'"), "k = 0"),
    _typed("301 + k", f"CASE WHEN k % 3 = 1 THEN '' ELSE '(' || {_ROMAN} || ') ' END || 'the ' || p_brand || ' was a ____ and size_____' || CAST(p_size AS STRING) || CASE WHEN k = 5 THEN ' (1x 5)' ELSE '.' END"),
    _typed("400", "'Ques.4) Write the plural of these words, _'", "k = 0"),
    _typed("401", _of("paper_id", "'1. pen 2. boat 3. boy 4. ' || p_brand", "'(a) pen (b) toy'", "'a) ink b) cup c) '"), "k = 0"),
    _typed("402 + k", "CAST(k + 5 AS STRING) || ') word' || CAST(p_size AS STRING)", "paper_id % 2 = 1"),
    _typed("500", "'Que 5 Read the following long passage about the ' || p_name || _and || p_type || ' and then write what you'".replace("_and", "' and the '"), "k = 0"),
    _typed("501", _of("paper_id", "'think about it (3)'", "'think about it all day.'"), "k = 0"),
    _typed("502 + 2 * k", "'The ' || p_name || ' which was kept for everyday use by the ' || p_type || ' family of ' || p_brand || ' was'"),
    _typed("503 + 2 * k", _of("p_partkey", "'not a apple but an unit of ' || p_brand || '.'", "'a) labelled ' || p_brand", "'short ' || p_brand || ' tail'")),
    _typed("600", "'प्रश्न 6 सही विकल्प चुनिए। (4)'", "k = 0"),
    _typed("601 + k", _of("p_partkey", "'अ) नदी ' || CAST(p_size AS STRING)", "'ब) पहाड़'", "'स) सागर'", "'द) आकाश'", "'कौन सा शब्द सही है'")),
    _typed("700", _of("paper_id", "'Que-7 Tick the correct answer?'", "'Q 7 Write true or false.'", "'Que 7. Choose the correct word'"), "k = 0"),
    _typed("701 + 5 * k", "CAST(k + 1 AS STRING) || '. What is the ' || p_brand || ' of it'"),
    _typed("702 + 5 * k", "'a) ' || p_brand"),
    _typed("703 + 5 * k", "'b) size ' || CAST(p_size AS STRING)"),
    _typed("704 + 5 * k", _of("p_partkey", "'c) none of them'", "'d) all'", "'c) a sentence that is far too long to be one of the options here.'")),
    _typed("800", "'Que 8. Write the opposite words'", "k = 0"),
    _typed("801", "'(i) Talk-' || chr(9) || '(iv) Walk-'", "k = 0"),
    _typed("802", "'(ii) Big' || chr(9) || '(v) ' || p_brand", "k = 0"),
    _typed("803", _of("paper_id", "'(iii) Hot   (vi) Cold'", "'(iii) Hot' || chr(9) || 'Cold'"), "k = 0"),
    _typed("900", "'Que 9. Give the reason [ 6 ]'", "k = 0"),
    _typed("901 + k", _of("paper_id", "CAST(CASE WHEN k = 0 THEN 2 WHEN k = 1 THEN 1 ELSE k + 1 END AS STRING) || '. why ' || p_name", "CAST(k + 1 AS STRING) || '. why ' || p_name", "CASE WHEN k = 4 THEN '' ELSE chr(97 + CAST(k AS INT)) || '. ' END || 'why ' || p_name || '.'")),
    _typed("1000", "'Que 10. Read the stanza and answer (5)'", "k = 0"),
    _typed("1001 + k", "'the ' || p_brand || ' goes, the ' || p_type || ' stays'", "k < 4"),
    _typed("1100", "'Que 11 Match the words'", "k = 0"),
    _typed("1101 + k", "CAST(k % 4 + 1 AS STRING) || '. ' || p_brand"),
    _typed("1200", "'Que 12 Answer in the space below'", "k = 0 AND paper_id % 3 = 0"),
    _typed("1201", "'____________________'", "k = 0 AND paper_id % 3 = 0"),
]

_PARTS = f"SELECT {_P} AS paper_id, {_K} AS k, p_partkey, p_name, p_brand, p_type, p_size FROM {{part}}"

#: One pass: the lines that a row adds are an array, and the array is unpacked.
PAPER_LINES = f"""WITH parts AS ({_PARTS}), typed AS (SELECT paper_id, explode(array({", ".join(f"CASE WHEN {where} THEN named_struct('line_no', CAST({no} AS BIGINT), 'raw', {text}) END" for no, text, where in _SECTIONS)})) AS l FROM parts)
SELECT paper_id, l.line_no, l.raw FROM typed WHERE l IS NOT NULL"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of ``part`` to a partition; each adds some 17 lines.
PARTS_EACH = 1000


def spread(parts: DataFrame) -> DataFrame:
    """Rows of ``part`` spread by paper before they become lines: a small file is one task otherwise, and all that is keyed by paper needs no exchange of lines. As many partitions as the rows ask for, up to the session's."""
    most = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.repartition(min(most, parts.count() // PARTS_EACH + 1), F.expr(_P))


def paper_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PAPER_LINES, part=spread(table(spark, sf_dir, "part")))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.prepare_lines(paper_lines(spark, sf_dir))[0]


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(lines(spark, sf_dir))


#: The same corpus for DuckDB.
ORACLE_LINES = f"WITH parts AS ({_PARTS.format(part='part')})\n" + "\nUNION ALL\n".join(f"SELECT paper_id, CAST({no} AS BIGINT) AS line_no, {text} AS raw FROM parts WHERE {where}" for no, text, where in _SECTIONS)
