"""Workbook import: cell table, headers, labels, rows, plan and application.

Suppliers are sheets, nations workbooks, orders rows, and line numbers the
columns. A sheet's layout and name follow its supplier key, a row's identity
the priority of its order, so every layout and every kind of error occurs.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from gradeloom.functions.marks import parse_mark, problem_text
from gradeloom.functions.text import clean_text, normal_header, safe_name
from gradeloom.operators import importing, labels, sheets, templates
from gradeloom.operators.identity import resolve_students
from gradeloom.operators.results import Domain
from gradeloom.plans.campus import BASE_TABLES, CAMPUS, Campus
from gradeloom.plans.registry import ORACLE_TABLES, query
from gradeloom.session import settle
from gradeloom.sources.schemas import SCHEMAS

# Texts of a row and of its marks, as the tables below and the cells made of entries know them.
_ROLL = """CASE WHEN o_orderpriority = '3-MEDIUM' OR (o_orderpriority = '5-LOW' AND o_orderstatus = 'P') THEN NULL
                    ELSE CONCAT('R', CAST(who AS STRING)) END"""
_NAME = """CASE WHEN o_orderpriority = '2-HIGH' OR (o_orderpriority = '5-LOW' AND o_orderstatus = 'P') THEN NULL
                    ELSE CONCAT('Customer#', LPAD(CAST(CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN who + 5 ELSE who END AS STRING), 9, '0'))
                    END"""
_CLASS = "CASE WHEN o_orderstatus = 'F' THEN n_name WHEN o_orderstatus = 'P' THEN 'NATION_X' END"
_VALUE = """CASE WHEN flag = 'A' THEN 'AB' WHEN flag = 'R' AND q < 20 THEN ' Exempt ' WHEN q = 13 THEN 'oops'
                       WHEN q = 7 THEN '-1' WHEN q = 3 THEN ' ' WHEN q = 5 THEN '' WHEN q = 11 THEN '1_1'
                       WHEN q > 30 THEN CONCAT(CAST(CAST(q AS INT) AS STRING), '.5')
                       ELSE CAST(CAST(q AS INT) AS STRING) END"""
_KIND = """CASE WHEN flag = 'A' OR (flag = 'R' AND q < 20) OR q IN (13, 7, 3, 5, 11) THEN 'text' WHEN q > 30 THEN 'float'
                    ELSE 'int' END"""

IMPORT = {
    "book": """
        SELECT CAST(n_nationkey % 5 AS STRING) AS institution_id, CONCAT('W', CAST(n_nationkey AS STRING)) AS workbook,
               CASE WHEN n_nationkey IN (4, 9) THEN CONCAT('OF', CAST(n_nationkey AS STRING))
                    WHEN n_nationkey = 19 THEN 'none' END AS offering_hint,
               n_nationkey >= 20 AS legacy, n_nationkey, n_name
        FROM {nation}""",
    "sheet": """
        SELECT b.institution_id, b.workbook, s.s_suppkey AS sheet_no, s.s_suppkey AS k, b.legacy, b.n_name,
               CASE WHEN b.legacy THEN 7 + s.s_suppkey % 2 ELSE s.s_suppkey % 7 END AS sort,
               CASE WHEN b.legacy OR s.s_suppkey % 7 = 6 THEN CONCAT('Sheet ', CAST(s.s_suppkey AS STRING))
                    WHEN s.s_suppkey % 7 = 1 THEN CONCAT('CC', CAST(s.s_suppkey AS STRING))
                    WHEN s.s_suppkey % 7 = 2 THEN CASE WHEN s.s_acctbal < 3000 THEN 'Shared' ELSE CONCAT('Subject ', CAST(s.s_suppkey AS STRING)) END
                    WHEN s.s_suppkey % 7 = 3 THEN CONCAT('Mixed ', CAST(s.s_suppkey AS STRING))
                    WHEN s.s_suppkey % 7 = 4 THEN CONCAT('Lost ', CAST(s.s_suppkey AS STRING))
                    ELSE CONCAT('OF', CAST(s.s_suppkey AS STRING)) END AS sheet,
               CASE WHEN s.s_acctbal < 3000 THEN 'Shared' ELSE CONCAT('Subject ', CAST(s.s_suppkey AS STRING)) END AS subject
        FROM {supplier} s JOIN {book} b ON b.n_nationkey = s.s_nationkey""",
    "imp_course": """
        SELECT institution_id, CONCAT('C', CAST(k AS STRING)) AS id, subject AS name, CONCAT('CC', CAST(k AS STRING)) AS code
        FROM {sheet}""",
    "imp_offering": """
        SELECT institution_id, k AS seq, CONCAT('OF', CAST(k AS STRING)) AS id, CONCAT('C', CAST(k AS STRING)) AS course_id,
               'Y1' AS year_id, CASE WHEN sort = 8 THEN 'T2' ELSE 'T1' END AS term_id, workbook AS org_unit_id
        FROM {sheet}""",
    "imp_line": """
        SELECT s.institution_id, s.k, s.sort, l.l_linenumber AS line
        FROM (SELECT l_suppkey, l_linenumber FROM {lineitem} GROUP BY 1, 2) l JOIN {sheet} s ON s.k = l.l_suppkey""",
    "imp_assessment": """
        SELECT institution_id, k * 8 + line AS seq, CONCAT('OF', CAST(k AS STRING), '#', CAST(line AS STRING)) AS id,
               CONCAT('OF', CAST(k AS STRING)) AS offering_id,
               CASE WHEN line = 6 THEN 't5' ELSE CONCAT('T', CAST(line AS STRING)) END AS name,
               CAST(40 AS DOUBLE) AS max_marks, 8 - line AS "order"
        FROM {imp_line} WHERE sort < 6 OR line = 1 OR (k % 3 = 0 AND line = 2)""",
    "imp_org_unit": """
        SELECT institution_id, workbook AS id, CASE n_nationkey WHEN 24 THEN 'NATION_4' ELSE n_name END AS name FROM {book}""",
    "imp_student": """
        SELECT CAST(c_custkey % 5 AS STRING) AS institution_id, c_custkey AS seq, CAST(c_custkey AS STRING) AS id,
               CONCAT('Customer#', LPAD(CAST(c_custkey AS STRING), 9, '0')) AS name,
               CONCAT('R', CAST(c_custkey AS STRING)) AS roll_no
        FROM {customer} WHERE c_mktsegment <> 'MACHINERY'""",
    "imp_entry": """
        SELECT s.institution_id, s.workbook, s.sheet_no, s.sheet, s.sort, s.k, s.subject, s.n_name, l.l_linenumber AS line,
               CASE WHEN s.sort IN (6, 7) THEN l.l_orderkey * 8 + l.l_linenumber + 2 ELSE l.l_orderkey + 2 END AS row_no,
               o.o_orderpriority, o.o_orderstatus, o.o_custkey - o.o_custkey % 5 + CAST(s.institution_id AS BIGINT) AS who,
               max(l.l_quantity) AS q, min(l.l_returnflag) AS flag
        FROM {lineitem} l JOIN {sheet} s ON s.k = l.l_suppkey JOIN {orders} o ON o.o_orderkey = l.l_orderkey
        GROUP BY 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13""",
    "imp_row": f"""
        SELECT DISTINCT institution_id, workbook, sheet_no, sheet, sort, k, subject, n_name, row_no,
               {_ROLL} AS roll,
               {_NAME} AS name,
               {_CLASS} AS class_label
        FROM {{imp_entry}}""",
    "mark_cell": f"""
        SELECT *, {_VALUE} AS value,
               {_KIND} AS value_kind
        FROM {{imp_entry}}""",
    "cell": """
        SELECT institution_id, workbook, sheet, sheet_no, row_no, col_no, value, value_kind FROM (
            SELECT institution_id, workbook, sheet, sheet_no, CAST(1 AS BIGINT) AS row_no, 1 AS col_no,
                   CASE WHEN sort < 6 THEN 'Roll No' ELSE 'Student' END AS value, 'text' AS value_kind FROM {sheet}
            UNION ALL SELECT institution_id, workbook, sheet, sheet_no, 1, 2,
                   CASE WHEN sort < 6 THEN ' Student  Name ' ELSE 'Roll No' END, 'text' FROM {sheet}
            UNION ALL SELECT institution_id, workbook, sheet, sheet_no, 1, 3, 'Class', 'text' FROM {sheet} WHERE sort >= 6
            UNION ALL SELECT institution_id, workbook, sheet, sheet_no, 1, 4, 'Subject', 'text' FROM {sheet} WHERE sort IN (6, 7)
            UNION ALL SELECT institution_id, workbook, sheet, sheet_no, 1, 5, 'Marks', 'text' FROM {sheet} WHERE sort IN (6, 7)
            UNION ALL SELECT institution_id, workbook, sheet, sheet_no, 1, 12, 't1', 'text' FROM {sheet} WHERE sort = 5
            UNION ALL SELECT s.institution_id, s.workbook, s.sheet, s.sheet_no, 1, 3 + l.line,
                   CASE WHEN s.sort = 3 AND l.line % 2 = 0 THEN CONCAT('OF', CAST(s.k AS STRING), ': T', CAST(l.line AS STRING))
                        WHEN s.sort = 3 THEN CONCAT('CC', CAST(s.k AS STRING), ' | t', CAST(l.line AS STRING))
                        WHEN s.sort = 8 AND l.line = 1 THEN CONCAT('CC', CAST(s.k AS STRING))
                        WHEN s.sort = 8 AND l.line = 2 THEN s.subject
                        WHEN s.sort = 8 THEN CONCAT('Subject x', CAST(l.line AS STRING))
                        WHEN l.line = 4 THEN ' t4 ' ELSE CONCAT('T', CAST(l.line AS STRING)) END, 'text'
                FROM {sheet} s JOIN {imp_line} l ON l.k = s.k WHERE s.sort NOT IN (6, 7) AND l.line <> 6
            UNION ALL SELECT institution_id, workbook, sheet, sheet_no, row_no, CASE WHEN sort < 6 THEN 1 ELSE 2 END, roll,
                   CASE WHEN roll IS NULL THEN 'blank' ELSE 'text' END FROM {imp_row}
            UNION ALL SELECT institution_id, workbook, sheet, sheet_no, row_no, CASE WHEN sort < 6 THEN 2 ELSE 1 END, name,
                   CASE WHEN name IS NULL THEN 'blank' ELSE 'text' END FROM {imp_row}
            UNION ALL SELECT institution_id, workbook, sheet, sheet_no, row_no, 3, class_label, 'text' FROM {imp_row}
                WHERE sort >= 6 AND class_label IS NOT NULL
            UNION ALL SELECT institution_id, workbook, sheet, sheet_no, row_no, 4, CONCAT('CC', CAST(k AS STRING)), 'text' FROM {imp_row}
                WHERE sort IN (6, 7)
            UNION ALL SELECT institution_id, workbook, sheet, sheet_no, row_no, CASE WHEN sort IN (6, 7) THEN 5 ELSE 3 + line END,
                   value, value_kind FROM {mark_cell}
            UNION ALL SELECT institution_id, workbook, 'Notes', 4000000 + CAST(n_nationkey AS BIGINT), 1, 1, '', 'text' FROM {book}) x""",
}
ORACLE_TABLES.update(IMPORT)
ORACLE_TABLES.update(
    {
        "header": """
            SELECT *, lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS norm FROM {cell}
            WHERE row_no = 1 AND value <> ''""",
        "role": """
            SELECT institution_id, workbook, sheet_no, min(sheet) AS sheet,
                   min(CASE WHEN norm = 'roll no' THEN col_no END) AS roll_col,
                   min(CASE WHEN norm IN ('student', 'student name') THEN col_no END) AS name_col,
                   min(CASE WHEN norm = 'class' THEN col_no END) AS class_col,
                   min(CASE WHEN norm = 'subject' THEN col_no END) AS subject_col,
                   min(CASE WHEN norm = 'marks' THEN col_no END) AS marks_col,
                   count(*) > count(DISTINCT norm) AS repeats
            FROM {header} GROUP BY 1, 2, 3""",
        "layout": """
            SELECT r.*, CASE WHEN repeats THEN NULL WHEN subject_col IS NOT NULL THEN 'legacy_long'
                             WHEN b.legacy THEN 'legacy_wide' ELSE 'native' END AS layout,
                   CASE WHEN repeats THEN 'invalid header: duplicate header ''t1''' END AS error
            FROM {role} r JOIN {book} b ON b.institution_id = r.institution_id AND b.workbook = r.workbook""",
        "label_match": """
            SELECT institution_id, id AS label, 1 AS level, id FROM {imp_offering}
            UNION ALL SELECT o.institution_id, c.code, 2, o.id FROM {imp_offering} o
                JOIN {imp_course} c ON c.institution_id = o.institution_id AND c.id = o.course_id
            UNION ALL SELECT o.institution_id, c.name, 3, o.id FROM {imp_offering} o
                JOIN {imp_course} c ON c.institution_id = o.institution_id AND c.id = o.course_id""",
        "label_level": """
            SELECT institution_id, label, level, count(*) AS n, min(id) AS id, string_agg(id, ', ' ORDER BY id) AS ids
            FROM {label_match} GROUP BY 1, 2, 3""",
    }
)

ORACLE_TABLES["label_answer"] = """
    SELECT r.institution_id, r.label, x.id AS offering_id,
              CASE WHEN x.id IS NULL THEN CASE WHEN y.ids IS NULL THEN concat('no course offering matches ''', r.label, '''')
                   ELSE concat('''', r.label, ''' is ambiguous across offerings (', y.ids, ')') END END AS error
       FROM (SELECT DISTINCT institution_id, sheet AS label FROM {sheet}
             UNION SELECT institution_id, subject FROM {sheet}) r
       LEFT JOIN (SELECT institution_id, label, first(id ORDER BY level) AS id FROM {label_level} WHERE n = 1 GROUP BY 1, 2) x
            ON x.institution_id = r.institution_id AND x.label = r.label
       LEFT JOIN (SELECT institution_id, label, first(ids ORDER BY level) AS ids FROM {label_level} GROUP BY 1, 2) y
            ON y.institution_id = r.institution_id AND y.label = r.label"""
ORACLE_TABLES["failed_sheet"] = """
    SELECT * FROM (
        SELECT l.institution_id, l.workbook, l.sheet_no, l.sheet, CAST(1 AS BIGINT) AS header_row,
               CASE WHEN l.institution_id <> '4' THEN CASE WHEN s.sort <> 3 THEN a.error END
                    WHEN b.offering_hint IS NULL THEN '--offering is required when excel.expect_course_prefix is false'
                    WHEN o.id IS NULL THEN concat('no course offering with id ''', b.offering_hint, '''')
                    ELSE (SELECT concat('no assessment named ''', trim(h.value), ''' for offering ''', o.id, '''') FROM {header} h
                          WHERE h.institution_id = l.institution_id AND h.sheet_no = l.sheet_no
                            AND h.norm NOT IN ('roll no', 'student name')
                            AND NOT EXISTS (SELECT 1 FROM {imp_assessment} x WHERE x.institution_id = o.institution_id
                                            AND x.offering_id = o.id AND lower(x.name) = lower(trim(h.value)))
                          ORDER BY h.col_no LIMIT 1) END AS error
        FROM {layout} l JOIN {sheet} s ON s.k = l.sheet_no
        JOIN {book} b ON b.institution_id = l.institution_id AND b.workbook = l.workbook
        LEFT JOIN {label_answer} a ON a.institution_id = l.institution_id AND a.label = l.sheet
        LEFT JOIN {imp_offering} o ON o.institution_id = l.institution_id AND o.id = b.offering_hint
        WHERE l.layout = 'native') WHERE error IS NOT NULL"""

_settled: dict = {}  # (application, folder, its files as they are now, name) -> tables written once


def _files(c: Campus) -> tuple:
    """Size and time of change of every file of the tables in the folder."""
    jvm, conf = c.spark._jvm, c.spark._jsc.hadoopConfiguration()
    found = []
    for table in BASE_TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{c.sf_dir}/{table}.parquet")
        system = path.getFileSystem(conf)
        if system.exists(path):
            found += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in system.listStatus(path)]
    return tuple(found)


def _once(c: Campus, name: str, make):
    key = (c.spark.sparkContext.applicationId, c.sf_dir, _files(c), name)
    if key not in _settled:
        _settled[key] = make()
    return _settled[key]


def _campus(c: Campus) -> Campus:
    c.tables = {**CAMPUS, **IMPORT}
    return c


_SHEET = ["institution_id", "workbook", "sheet_no", "sheet", "sort", "k", "subject", "n_name"]


def _row_cells(c: Campus):
    """Cells of the rows of ``imp_row`` and ``mark_cell``: line items are dealt by their orders once, no step after that deals them again.

    All entries of a row are of one order, since its number tells the order; so the order may be a key of every grouping.
    """
    orders = c["orders"].select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", "o_orderstatus", F.expr("o_custkey - o_custkey % 5").alias("base")
    )
    line = ["l_orderkey", "l_suppkey", "l_linenumber", "o_orderpriority", "o_orderstatus", "base"]
    lines = c["lineitem"].select(*line[:3], "l_quantity", "l_returnflag").repartition("l_orderkey").join(orders, "l_orderkey")
    lines = lines.groupBy(*line).agg(F.max("l_quantity").alias("q"), F.min("l_returnflag").alias("flag"))
    sheet = settle(c["sheet"].select(*_SHEET).distinct().withColumn("sheet_id", F.monotonically_increasing_id()))
    entries = lines.join(sheet, F.col("l_suppkey") == F.col("k"))
    number = F.expr("CASE WHEN sort IN (6, 7) THEN l_orderkey * 8 + l_linenumber + 2 ELSE l_orderkey + 2 END")
    entries = entries.withColumn("row_no", number).withColumn("who", F.expr("base + CAST(institution_id AS BIGINT)"))
    entries = entries.withColumns({"roll": F.expr(_ROLL), "name": F.expr(_NAME), "class_label": F.expr(_CLASS)})
    # The texts of a row stand beside the first of its entries.
    row = Window.partitionBy("l_orderkey", "sheet_id", "k", "row_no", "roll", "name", "class_label").orderBy("l_linenumber")
    entries = entries.withColumn("first", F.row_number().over(row) == 1)
    first, long, text = F.col("first"), F.col("sort").isin(6, 7), F.lit("text")

    def cell(col_no, value, kind=text):
        return F.struct(col_no.cast("int").alias("col_no"), value.alias("value"), kind.alias("value_kind"))

    def some(condition, *cells):
        return F.when(condition, F.array(*cells)).otherwise(F.array().cast("array<struct<col_no:int,value:string,value_kind:string>>"))

    kind = [F.when(F.col(x).isNull(), "blank").otherwise("text") for x in ("roll", "name")]
    native = F.col("sort") < 6
    given = F.concat(
        some(first, cell(F.when(native, 1).otherwise(2), F.col("roll"), kind[0]), cell(F.when(native, 2).otherwise(1), F.col("name"), kind[1])),
        some(first & ~native & F.col("class_label").isNotNull(), cell(F.lit(3), F.col("class_label"))),
        some(first & long, cell(F.lit(4), F.concat(F.lit("CC"), F.col("k").cast("string")))),
        F.array(cell(F.when(long, F.lit(5)).otherwise(3 + F.col("l_linenumber")), F.expr(_VALUE), F.expr(_KIND))),
    )
    return entries.select("institution_id", "workbook", "sheet", "sheet_no", "row_no", F.inline(given))


def _cells(c: Campus):
    def make():
        # what stands in ``cell`` without entries: headers and notes
        bare = Campus(c.spark, c.sf_dir, {**CAMPUS, **IMPORT})
        bare._made["imp_entry"] = c.spark.createDataFrame([], bare["imp_entry"].schema)
        headers, rows = bare["cell"], _row_cells(_campus(c))
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in headers.schema])
        return settle(headers.unionByName(typed))

    return _once(c, "cells", make)


def _books(c: Campus):
    return _campus(c)["book"].select("institution_id", "workbook", "offering_hint", "legacy")


def _settings(c: Campus):
    return c["institution"].select(
        "institution_id",
        (F.col("institution_id") != "4").alias("expect_course_prefix"),
        F.lit("Y1").alias("default_year"),
        F.lit("T1").alias("default_term"),
    )


def _domain(c: Campus) -> Domain:
    def make():
        _campus(c)
        given = {"course", "offering", "assessment", "org_unit", "student"}
        tables = {n: settle(c[f"imp_{n}"]) if n in given else c.spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
        return Domain(**tables)

    return _once(c, "domain", make)


def _plan(c: Campus) -> importing.ImportPlan:
    return _once(c, "plan", lambda: importing.validate(_cells(c), _books(c), _settings(c), _domain(c)))


@query(
    "a14_sheet_headers",
    """SELECT institution_id, workbook, sheet_no, sheet, CASE WHEN sheet = 'Notes' THEN NULL ELSE min(row_no) END AS header_row
       FROM {cell} GROUP BY 1, 2, 3, 4""",
)
def a14_sheet_headers(c: Campus):
    return sheets.sheet_list(_cells(c))


@query(
    "a15_empty_sheets",
    """SELECT institution_id, workbook, 4000000 + n_nationkey AS sheet_no, 'Notes' AS sheet, 'Sheet ''Notes'': empty, ignored.' AS note
       FROM {book}""",
)
def a15_empty_sheets(c: Campus):
    return sheets.import_notes(sheets.sheet_list(_cells(c)))


@query(
    "a16_template_headers",
    """SELECT institution_id, replace(offering_id, '#', '') AS sheet, col_no, header FROM (
           SELECT institution_id, offering_id, 2 + row_number() OVER (PARTITION BY institution_id, offering_id ORDER BY "order", id) AS col_no,
                  name AS header FROM {imp_assessment}
           UNION ALL SELECT institution_id, id, 1, 'Roll No' FROM {imp_offering}
           UNION ALL SELECT institution_id, id, 2, 'Student Name' FROM {imp_offering})""",
)
def a16_template_headers(c: Campus):
    domain = _domain(c)
    return templates.template_headers(domain.offering, domain.assessment).select("institution_id", "sheet", "col_no", "header")


_TEMPLATE_HINT = "CASE i.institution_id WHEN '1' THEN '' WHEN '2' THEN 'none' ELSE concat('OF', i.institution_id) END"


def _template_settings(c: Campus):
    """Institution 0 expects prefixes; 1 has no hint, 2 an unknown one, 3 and 4 hints that may be theirs."""
    i = F.col("institution_id")
    hint = F.when(i == "1", "").when(i == "2", "none").otherwise(F.concat(F.lit("OF"), i))
    return c["institution"].select(i, (i == "0").alias("expect_course_prefix"), hint.alias("offering_hint"))


@query(
    "a16_hinted_headers",
    f"""SELECT t.institution_id, t.sheet, t.col_no, t.header FROM (
           SELECT o.institution_id, o.id AS offering_id, CASE o.institution_id WHEN '0' THEN o.id ELSE 'Marks' END AS sheet, x.col_no, x.header
           FROM {{imp_offering}} o JOIN (
               SELECT institution_id, offering_id, 2 + row_number() OVER (PARTITION BY institution_id, offering_id ORDER BY "order", id) AS col_no,
                      name AS header FROM {{imp_assessment}}
               UNION ALL SELECT institution_id, id, 1, 'Roll No' FROM {{imp_offering}}
               UNION ALL SELECT institution_id, id, 2, 'Student Name' FROM {{imp_offering}}) x
           ON x.institution_id = o.institution_id AND x.offering_id = o.id) t
       JOIN {{institution}} i ON i.institution_id = t.institution_id
       WHERE i.institution_id = '0' OR t.offering_id = {_TEMPLATE_HINT}""",
)
def a16_hinted_headers(c: Campus):
    domain = _domain(c)
    headers = templates.template_headers(domain.offering, domain.assessment, settings=_template_settings(c))
    return headers.select("institution_id", "sheet", "col_no", "header")


@query(
    "a16_template_errors",
    f"""SELECT * FROM (
           SELECT i.institution_id, NULLIF({_TEMPLATE_HINT}, '') AS offering_hint,
                  CASE WHEN i.institution_id = '1' THEN '--offering is required when excel.expect_course_prefix is false'
                       WHEN o.id IS NULL THEN concat('no course offering with id ''', {_TEMPLATE_HINT}, '''') END AS error
           FROM {{institution}} i LEFT JOIN {{imp_offering}} o ON o.institution_id = i.institution_id AND o.id = {_TEMPLATE_HINT}
           WHERE i.institution_id <> '0') WHERE error IS NOT NULL""",
)
def a16_template_errors(c: Campus):
    return templates.template_errors(_domain(c).offering, _template_settings(c))


@query(
    "a17_sheet_titles",
    """SELECT id, CASE rn WHEN 1 THEN title ELSE substr(concat(raw, '_2'), 1, 31) END AS title FROM (
           SELECT *, row_number() OVER (PARTITION BY title ORDER BY id) AS rn FROM (
               SELECT *, COALESCE(NULLIF(substr(raw, 1, 31), ''), 'offering') AS title FROM (
                   SELECT id, translate(id, '\\/?*[]:', '') AS raw FROM (
                       SELECT concat(p_brand, '/', p_type, CASE WHEN p_size > 25 THEN '*' ELSE ':' END, '[', p_partkey // 3, ']') AS id
                       FROM {part} GROUP BY 1))))""",
)
def a17_sheet_titles(c: Campus):
    mark = F.when(F.col("p_size") > 25, "*").otherwise(":")
    group = F.floor(F.col("p_partkey") / 3).cast("bigint")
    ids = c["part"].select(F.concat("p_brand", F.lit("/"), "p_type", mark, F.lit("["), group, F.lit("]")).alias("id")).distinct()
    titled = templates.sheet_titles(ids.withColumn("institution_id", F.lit("i")))
    return titled.select("id", "title")


@query(
    "h04_safe_name",
    """SELECT doc_id, replace(COALESCE(NULLIF(trim(regexp_replace(text, '[^\\p{L}\\p{N} _-]', '', 'g'), ' '), ''), 'Student'), ' ', '_') AS safe
       FROM {documents}""".replace("\\p{L}\\p{N}", "\\p\x01L\x02\\p\x01N\x02"),
)
def h04_safe_name(c: Campus):
    return c["documents"].select("doc_id", safe_name(F.col("text")).alias("safe"))


@query(
    "h05_enrollment_id",
    """SELECT institution_id, id, concat('enroll_', student_id, '_', year_id, '_', COALESCE(term_id, 'na'), '_', org_unit_id) AS made
       FROM {enrollment}""",
)
def h05_enrollment_id(c: Campus):
    parts = [F.col(x) for x in ("student_id", "year_id", "term_id", "org_unit_id")]
    return c["enrollment"].select("institution_id", "id", importing.enrollment_id(*parts).alias("made"))


_ENTRY_KEY = "institution_id, sheet_no, row_no, line"


@query(
    "h06_parse_mark",
    f"""SELECT {_ENTRY_KEY}, status, CASE WHEN status = 'entered' OR problem IN ('negative', 'over') THEN number
                                         WHEN status IS NOT NULL THEN 0 END AS obtained, problem,
               CASE problem WHEN 'unreadable' THEN concat('unrecognised mark value ''', value, '''')
                    WHEN 'negative' THEN 'marks cannot be negative'
                    WHEN 'over' THEN concat('mark ', printf('%g', number), ' exceeds maximum 40') END AS message
        FROM (SELECT *, CASE WHEN token = '' OR problem IS NOT NULL THEN NULL WHEN token = 'ab' THEN 'absent'
                             WHEN token = 'exempt' THEN 'exempt' ELSE 'entered' END AS status
              FROM (SELECT *, CASE WHEN token IN ('', 'ab', 'exempt') THEN NULL WHEN number IS NULL THEN 'unreadable'
                                   WHEN number < 0 THEN 'negative' WHEN number > 40 THEN 'over' END AS problem
                    FROM (SELECT *, lower(trim(value)) AS token, TRY_CAST(replace(trim(value), '_', '') AS DOUBLE) AS number
                          FROM {{mark_cell}})))""",
)
def h06_parse_mark(c: Campus):
    cells = _campus(c)["mark_cell"].withColumn("m", parse_mark(F.col("value"), F.col("value_kind"), F.lit(40.0)))
    message = problem_text(F.col("m.problem"), F.col("value"), F.col("m.obtained"), F.lit(40.0))
    return cells.select("institution_id", "sheet_no", "row_no", "line", "m.*", message.alias("message"))


@query(
    "h07_clean_text",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity,
              l_returnflag AS flag FROM {lineitem}""",
)
def h07_clean_text(c: Campus):
    quantity = clean_text(F.col("l_quantity").cast("string"), F.lit("float"))
    flag = clean_text(F.concat(F.lit(" \t"), "l_returnflag", F.lit(" ")), F.lit("text"))
    return c["lineitem"].select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quantity.alias("quantity"), flag.alias("flag")
    )


@query("h08_normal_headers", "SELECT institution_id, workbook, sheet_no, col_no, norm FROM {header}")
def h08_normal_headers(c: Campus):
    cells = _cells(c)
    return sheets.header_cells(cells, sheets.sheet_list(cells)).select(
        "institution_id", "workbook", "sheet_no", "col_no", "norm"
    )


def _classified(c: Campus):
    def make():
        cells = _cells(c)
        listed = sheets.sheet_list(cells)
        return settle(sheets.classify_sheets(listed, sheets.header_cells(cells, listed), _books(c)))

    return _once(c, "classified", make)


@query(
    "h09_header_roles",
    "SELECT institution_id, workbook, sheet_no, roll_col, name_col, class_col, subject_col, marks_col FROM {role}",
)
def h09_header_roles(c: Campus):
    return _classified(c).select(
        "institution_id", "workbook", "sheet_no", "roll_col", "name_col", "class_col", "subject_col", "marks_col"
    )


@query(
    "h10_prefixed_headers",
    """SELECT institution_id, workbook, sheet_no, col_no,
              trim(CASE WHEN contains(value, ':') THEN split_part(value, ':', 1) ELSE split_part(value, '|', 1) END) AS prefix,
              trim(CASE WHEN contains(value, ':') THEN split_part(value, ':', 2) ELSE split_part(value, '|', 2) END) AS suffix
       FROM {header} WHERE contains(value, ':') OR contains(value, '|')""",
)
def h10_prefixed_headers(c: Campus):
    cells = _cells(c)
    headers = sheets.header_cells(cells, sheets.sheet_list(cells)).where("value RLIKE '[:|]'")
    prefix, suffix = sheets.split_prefix(F.col("value"))
    return headers.select(
        "institution_id", "workbook", "sheet_no", "col_no", prefix.alias("prefix"), suffix.alias("suffix")
    )


@query("h11_sheet_layouts", "SELECT institution_id, workbook, sheet_no, layout, error FROM {layout}")
def h11_sheet_layouts(c: Campus):
    return _classified(c).select("institution_id", "workbook", "sheet_no", "layout", "error")


@query("d14_duplicate_headers", "SELECT institution_id, workbook, sheet_no, error FROM {layout} WHERE repeats")
def d14_duplicate_headers(c: Campus):
    return _classified(c).where("error LIKE '%duplicate header%'").select("institution_id", "workbook", "sheet_no", "error")


@query("h12_rendered_errors")
def h12_rendered_errors(c: Campus):
    return importing.render_errors(_plan(c).errors)


@query(
    "h14_composed_ids",
    "SELECT institution_id, write_no, concat(student_id, ':', assessment_id) AS id FROM {mark_log}",
)
def h14_composed_ids(c: Campus):
    return c["mark_log"].select(
        "institution_id", "write_no", F.concat_ws(":", "student_id", "assessment_id").alias("id")
    )


@query("c11_offering_labels", "SELECT * FROM {label_answer}")
def c11_offering_labels(c: Campus):
    domain = _domain(c)
    listed = _campus(c)["sheet"]
    asked = listed.select("institution_id", F.col("sheet").alias("label")).unionByName(
        listed.select("institution_id", F.col("subject").alias("label"))
    )
    return labels.resolve_offerings(asked, domain.offering, domain.course)


@query(
    "c12_offering_hints",
    """SELECT DISTINCT b.institution_id, b.offering_hint AS hint, o.id AS offering_id,
              CASE WHEN o.id IS NULL THEN concat('no course offering with id ''', b.offering_hint, '''') END AS error
       FROM {book} b LEFT JOIN {imp_offering} o ON o.institution_id = b.institution_id AND o.id = b.offering_hint
       WHERE b.offering_hint IS NOT NULL""",
)
def c12_offering_hints(c: Campus):
    asked = _books(c).where("offering_hint IS NOT NULL").select("institution_id", F.col("offering_hint").alias("hint"))
    return labels.resolve_hints(asked, _domain(c).offering)


@query(
    "c13_assessment_names",
    """SELECT institution_id, offering_id, name, CASE WHEN ne = 1 THEN ie WHEN nf = 1 THEN if_ END AS assessment_id,
              CASE WHEN ne = 1 OR nf = 1 THEN NULL WHEN ne > 1 THEN concat('assessment ''', name, ''' is ambiguous (', ids, ')')
                   ELSE concat('no assessment named ''', name, ''' for offering ''', offering_id, '''') END AS error
       FROM (SELECT r.institution_id, r.offering_id, r.name, count(*) FILTER (a.name = r.name) AS ne,
                    min(a.id) FILTER (a.name = r.name) AS ie, count(a.id) AS nf, min(a.id) AS if_,
                    string_agg(a.id, ', ' ORDER BY a.id) FILTER (a.name = r.name) AS ids
             FROM (SELECT DISTINCT institution_id, concat('OF', sheet_no) AS offering_id, value AS name FROM {header}) r
             LEFT JOIN {imp_assessment} a ON a.institution_id = r.institution_id AND a.offering_id = r.offering_id
                  AND lower(trim(a.name)) = lower(trim(r.name))
             GROUP BY 1, 2, 3)""",
)
def c13_assessment_names(c: Campus):
    cells = _cells(c)
    headers = sheets.header_cells(cells, sheets.sheet_list(cells))
    asked = headers.select(
        "institution_id", F.concat(F.lit("OF"), "sheet_no").alias("offering_id"), F.col("value").alias("name")
    )
    return labels.resolve_assessments(asked, _domain(c).assessment).select(
        "institution_id", "offering_id", "name", "assessment_id", "error"
    )


@query(
    "c14_legacy_subjects",
    """SELECT institution_id, subject, org_unit_id, CASE WHEN nc = 1 AND nf = 1 THEN fit END AS offering_id,
              CASE WHEN nc = 0 THEN concat('no course matches legacy subject ''', subject, '''')
                   WHEN nc > 1 THEN concat('subject ''', subject, ''' matches multiple courses')
                   WHEN nf > 1 THEN concat('subject ''', subject, ''' is ambiguous across offerings (', ids, ')')
                   WHEN nf = 1 THEN NULL
                   WHEN na > 0 THEN concat('subject ''', subject, ''' has no offering for the default period')
                   ELSE concat('no course offering exists for subject ''', subject, '''') END AS error
       FROM (SELECT r.institution_id, r.subject, r.org_unit_id, count(DISTINCT c.id) AS nc, count(o.id) AS na,
                    count(o.id) FILTER (o.fits) AS nf, min(o.id) FILTER (o.fits) AS fit,
                    string_agg(o.id, ', ' ORDER BY o.id) FILTER (o.fits) AS ids
             FROM (SELECT DISTINCT institution_id, subject, '' AS org_unit_id FROM {sheet}
                   UNION SELECT institution_id, concat('CC', k), workbook FROM {sheet}
                   UNION SELECT institution_id, concat('CC', k), 'elsewhere' FROM {sheet}
                   UNION SELECT institution_id, concat('XX', k), '' FROM {sheet}) r
             LEFT JOIN {imp_course} c ON c.institution_id = r.institution_id AND (c.name = r.subject OR c.code = r.subject)
             LEFT JOIN LATERAL (SELECT o.id, CASE WHEN r.org_unit_id <> '' THEN o.org_unit_id = r.org_unit_id
                                     ELSE o.year_id = 'Y1' AND o.term_id = 'T1' END AS fits
                                FROM {imp_offering} o
                                WHERE o.institution_id = c.institution_id AND o.course_id = c.id) o ON TRUE
             GROUP BY 1, 2, 3)""",
)
def c14_legacy_subjects(c: Campus):
    listed = _campus(c)["sheet"]
    code = F.concat(F.lit("CC"), "k")

    def asking(subject, unit):
        return listed.select("institution_id", subject.alias("subject"), unit.alias("org_unit_id"))

    asked = (
        asking(F.col("subject"), F.lit(""))
        .unionByName(asking(code, F.col("workbook")))
        .unionByName(asking(code, F.lit("elsewhere")))
        .unionByName(asking(F.concat(F.lit("XX"), "k"), F.lit("")))
    )
    domain = _domain(c)
    return labels.resolve_subjects(asked, domain.offering, domain.course, _settings(c))


@query(
    "c15_class_labels",
    """SELECT r.institution_id, r.class_label, CASE WHEN count(u.id) = 1 THEN min(u.id) END AS org_unit_id,
              CASE WHEN count(u.id) = 0 THEN concat('no class/org unit named ''', r.class_label, '''')
                   WHEN count(u.id) > 1 THEN concat('class ''', r.class_label, ''' matches multiple org units') END AS error
       FROM (SELECT DISTINCT institution_id, class_label FROM {imp_row} WHERE class_label IS NOT NULL) r
       LEFT JOIN {imp_org_unit} u ON u.institution_id = r.institution_id AND u.name = r.class_label GROUP BY 1, 2""",
)
def c15_class_labels(c: Campus):
    asked = _campus(c)["imp_row"].where("class_label IS NOT NULL")
    return labels.resolve_org_units(asked, _domain(c).org_unit)


@query(
    "c16_only_assessment",
    """SELECT o.institution_id, o.id AS offering_id, CASE WHEN count(a.id) = 1 THEN min(a.id) END AS assessment_id,
              CASE WHEN count(a.id) <> 1 THEN concat('legacy import needs exactly one assessment for offering ''', o.id,
                   ''' (found ', count(a.id), ')') END AS error
       FROM {imp_offering} o LEFT JOIN {imp_assessment} a ON a.institution_id = o.institution_id AND a.offering_id = o.id
       GROUP BY 1, 2""",
)
def c16_only_assessment(c: Campus):
    domain = _domain(c)
    asked = domain.offering.select("institution_id", F.col("id").alias("offering_id"))
    return labels.only_assessments(asked, domain.assessment).select("institution_id", "offering_id", "assessment_id", "error")


def _identities(c: Campus):
    def make():
        rows = _campus(c)["imp_row"].where("roll IS NOT NULL OR name IS NOT NULL").select(
            "institution_id", "workbook", importing.row_order(F.col("sheet_no"), F.col("row_no")).alias("ord"),
            F.coalesce("roll", F.lit("")).alias("roll"), F.coalesce("name", F.lit("")).alias("name"),
        )
        return resolve_students(rows, _domain(c).student)

    return _once(c, "identities", make)


@query(
    "d15_idle_rows",
    """SELECT DISTINCT r.institution_id, r.workbook, r.sheet_no, r.row_no, 'student row has no marks' AS message FROM {imp_row} r
       WHERE r.sort NOT IN (6, 7) AND NOT EXISTS (
           SELECT 1 FROM {mark_cell} m WHERE m.institution_id = r.institution_id AND m.workbook = r.workbook
               AND m.sheet_no = r.sheet_no AND m.row_no = r.row_no AND trim(m.value) <> '')""",
)
def d15_idle_rows(c: Campus):
    campus = _campus(c)
    layout = F.when(F.col("sort").isin(6, 7), "legacy_long").when(F.col("sort") == 8, "legacy_wide").otherwise("native")
    cells = campus["mark_cell"].withColumn("m", parse_mark(F.col("value"), F.col("value_kind"), F.lit(40.0)))
    used = cells.where("m.status IS NOT NULL OR m.problem IS NOT NULL")
    idle = importing.idle_rows(campus["imp_row"].withColumn("layout", layout), used)
    return idle.select("institution_id", "workbook", "sheet_no", "row_no", "message").distinct()


@query("c17_student_identity")
def c17_student_identity(c: Campus):
    return _identities(c)[0]


@query("e05_new_student_ids")
def e05_new_student_ids(c: Campus):
    return _identities(c)[1]


@query("i01_native_columns")
def i01_native_columns(c: Campus):
    cells, domain = _cells(c), _domain(c)
    headers = sheets.header_cells(cells, sheets.sheet_list(cells))
    return sheets.native_columns(
        _classified(c), headers, _settings(c), domain.offering, domain.course, domain.assessment
    )[0]


@query("i02_sheet_errors", "SELECT * FROM {failed_sheet}")
def i02_sheet_errors(c: Campus):
    cells, domain = _cells(c), _domain(c)
    headers = sheets.header_cells(cells, sheets.sheet_list(cells))
    return sheets.native_columns(
        _classified(c), headers, _settings(c), domain.offering, domain.course, domain.assessment
    )[1]


def _of_layout(c: Campus, layout: str):
    """Marks of the sheets with one layout; native ones are read apart, without those of other layouts."""
    plan = _plan(c)
    marks = (plan.native_marks if layout == "native" else plan.marks).withColumn("sheet_no", F.shiftright("ord", 36))
    wanted = plan.classified.where(F.col("layout") == layout).select("institution_id", "workbook", "sheet_no")
    return marks.join(wanted, ["institution_id", "workbook", "sheet_no"], "left_semi")


@query("i03_native_marks")
def i03_native_marks(c: Campus):
    return _of_layout(c, "native")


@query("i04_legacy_long_marks")
def i04_legacy_long_marks(c: Campus):
    return _of_layout(c, "legacy_long")


@query("i05_legacy_wide_marks")
def i05_legacy_wide_marks(c: Campus):
    return _of_layout(c, "legacy_wide")


@query("g01_plan_in_order")
def g01_plan_in_order(c: Campus):
    return _plan(c).marks.orderBy("institution_id", "workbook", "ord", "col_no")


@query(
    "g02_failed_sheets",
    """SELECT institution_id, workbook, sheet_no, header_row AS row_no, error AS message FROM {failed_sheet}
       UNION ALL SELECT institution_id, workbook, sheet_no, 1, error FROM {layout} WHERE error IS NOT NULL""",
)
def g02_failed_sheets(c: Campus):
    # Errors at header rows are those of sheets: rows and cells that are judged lie below.
    plan = _plan(c)
    header = plan.classified.select("institution_id", "workbook", "sheet_no", F.col("header_row").alias("row_no"))
    of_sheets = plan.sheet_places.join(header, ["institution_id", "workbook", "sheet_no", "row_no"], "left_semi")
    return plan.told_sheets(of_sheets).select("institution_id", "workbook", "sheet_no", "row_no", "message")


@query("g04_new_students")
def g04_new_students(c: Campus):
    return _plan(c).new_students


@query("i06_import_marks")
def i06_import_marks(c: Campus):
    return _plan(c).marks


@query("i06_import_errors")
def i06_import_errors(c: Campus):
    return _plan(c).errors


@query("d16_import_preview")
def d16_import_preview(c: Campus):
    return importing.preview(_plan(c), _domain(c).offering)


@query("i07_import_report")
def i07_import_report(c: Campus):
    return importing.apply_plan(_plan(c), _domain(c), skip_invalid=True).report


# Applying a plan whose marks are the whole log of the campus.

APPLY = {
    "dated_offering": """
        SELECT CAST(o_custkey % 5 AS STRING) AS institution_id, o_orderkey AS seq, CAST(o_orderkey AS STRING) AS id,
               CONCAT('Y', CAST(YEAR(o_orderdate) AS STRING)) AS year_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN NULL WHEN '2-HIGH' THEN '' ELSE 'T1' END AS term_id,
               o_orderstatus AS org_unit_id, o_custkey, o_orderpriority, YEAR(o_orderdate) AS y
        FROM {orders}""",
    "old_enrollment": """
        SELECT institution_id, o_custkey * 10000 + y AS seq, CONCAT('old', CAST(o_custkey AS STRING), '-', CAST(y AS STRING)) AS id,
               CAST(o_custkey AS STRING) AS student_id, year_id, CAST(NULL AS STRING) AS term_id, 'F' AS org_unit_id
        FROM {dated_offering} WHERE org_unit_id = 'F' AND o_orderpriority = '2-HIGH' GROUP BY 1, 2, 3, 4, 5""",
    "old_course": """
        SELECT o.institution_id, e.id AS enrollment_id, o.seq AS pos, o.id AS offering_id
        FROM {dated_offering} o JOIN {old_enrollment} e
          ON e.student_id = CAST(o.o_custkey AS STRING) AND e.year_id = o.year_id
        WHERE o.org_unit_id = 'F' AND o.o_orderpriority = '2-HIGH'""",
    "fresh_student": """
        SELECT institution_id, 'w' AS workbook, seq AS ord, id AS student_id, name, roll_no FROM {student}""",
}
ORACLE_TABLES.update(APPLY)
ORACLE_TABLES["planned"] = """
    SELECT DISTINCT m.institution_id, m.student_id, o.year_id, COALESCE(o.term_id, '') AS term_key, o.org_unit_id AS org_key,
           o.id AS offering_id
    FROM {mark_log} m JOIN {dated_offering} o ON o.institution_id = m.institution_id
         AND o.id = split_part(m.assessment_id, '#', 1)"""
ORACLE_TABLES["planned_period"] = """
    SELECT p.institution_id, p.student_id, p.year_id, p.term_key, p.org_key,
           COALESCE(e.id, concat('enroll_', p.student_id, '_', p.year_id, '_', COALESCE(NULLIF(p.term_key, ''), 'na'), '_', p.org_key)) AS enrollment_id,
           e.id IS NOT NULL AS stored, p.offering_id
    FROM {planned} p LEFT JOIN {old_enrollment} e ON e.institution_id = p.institution_id AND e.student_id = p.student_id
         AND e.year_id = p.year_id AND p.term_key = '' AND p.org_key = 'F'"""


def _applied(c: Campus) -> importing.Applied:
    def make():
        c.tables = {**CAMPUS, **APPLY}
        nothing = {n: c.spark.createDataFrame([], s) for n, s in SCHEMAS.items()}
        domain = Domain(
            **{
                **nothing,
                "student": c["student"].join(c["customer"].where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("seq")), "seq", "left_semi"),
                "enrollment": c["old_enrollment"],
                "enrollment_course": c["old_course"],
                "offering": c["dated_offering"].select("institution_id", "seq", "id", "year_id", "term_id", "org_unit_id"),
            }
        )
        marks = c["mark_log"].select(
            "institution_id", F.lit("w").alias("workbook"), F.col("write_no").alias("ord"),
            F.substring_index("assessment_id", "#", -1).cast("int").alias("col_no"), F.lit("s").alias("sheet"),
            F.lit(1).alias("row_no"), F.lit("").alias("column_name"), "student_id",
            F.substring_index("assessment_id", "#", 1).alias("offering_id"), "assessment_id", "obtained", "status",
        )
        errors = c.spark.createDataFrame([], "institution_id string, workbook string, message string")
        notes = c.spark.createDataFrame([], "institution_id string, note string")
        plan = importing.ImportPlan(settle(marks), lambda: errors, c["fresh_student"], notes)
        return plan, domain, importing.apply_plan(plan, domain)

    return _once(c, "applied", make)


@query("d12_planned_enrollments", "SELECT * FROM {planned}")
def d12_planned_enrollments(c: Campus):
    plan, domain, _ = _applied(c)
    return importing.planned_enrollments(plan, domain.offering).select(
        "institution_id", "student_id", "year_id", "term_key", "org_key", "offering_id"
    )


@query(
    "d13_import_report",
    """SELECT (SELECT count(*) FROM {customer} WHERE c_mktsegment = 'MACHINERY') AS students_created,
              (SELECT count(DISTINCT (student_id, year_id, term_key, org_key)) FROM {planned_period} WHERE NOT stored) AS enrollments_created,
              (SELECT count(DISTINCT p.enrollment_id) FROM {planned_period} p WHERE stored AND NOT EXISTS (
                  SELECT 1 FROM {old_course} c WHERE c.enrollment_id = p.enrollment_id AND c.offering_id = p.offering_id)) AS enrollments_updated,
              (SELECT count(*) FROM {mark_log}) AS marks_written, 0 AS skipped""",
)
def d13_import_report(c: Campus):
    return _applied(c)[2].report


@query(
    "c18_enrollments_after_import",
    """SELECT institution_id, id, student_id, year_id, term_id, org_unit_id FROM {old_enrollment}
       UNION SELECT institution_id, enrollment_id, student_id, year_id, NULLIF(term_key, ''), org_key
             FROM {planned_period} WHERE NOT stored""",
)
def c18_enrollments_after_import(c: Campus):
    return _applied(c)[2].enrollment.select("institution_id", "id", "student_id", "year_id", "term_id", "org_unit_id")


@query(
    "c20_students_after_import",
    "SELECT institution_id, id, name, roll_no FROM {student}",
)
def c20_students_after_import(c: Campus):
    return _applied(c)[2].student.select("institution_id", "id", "name", "roll_no")


@query(
    "g03_extended_enrollments",
    """SELECT institution_id, enrollment_id, offering_id FROM {old_course}
       UNION SELECT institution_id, enrollment_id, offering_id FROM {planned_period}""",
)
def g03_extended_enrollments(c: Campus):
    return _applied(c)[2].enrollment_course.select("institution_id", "enrollment_id", "offering_id")


@query(
    "i08_marks_after_import",
    """SELECT institution_id, concat(student_id, ':', assessment_id) AS id, student_id, assessment_id, obtained, status
       FROM {mark}""",
)
def i08_marks_after_import(c: Campus):
    """The marks after the same plan was applied twice; marks follow from marks alone."""
    plan, domain, applied = _applied(c)
    after = Domain(**{**vars(domain), "mark": settle(applied.mark)})
    again = importing.apply_plan(plan, after)
    return again.mark.select("institution_id", "id", "student_id", "assessment_id", "obtained", "status")


@query(
    "b21_answer_log",
    """SELECT institution_id, student_id, assessment_id, seq,
              CASE WHEN answer IN ('a', 'absent') THEN 0 WHEN answer = '' THEN 1 ELSE TRY_CAST(answer AS DOUBLE) END AS obtained,
              CASE WHEN answer IN ('a', 'absent') THEN 'absent' ELSE 'entered' END AS status
       FROM (SELECT *, lower(trim(raw)) AS answer, min(CASE WHEN lower(trim(raw)) IN ('q', 'quit') THEN seq END) OVER (PARTITION BY session) AS stop
             FROM {answer}) a
       WHERE (stop IS NULL OR seq < stop) AND (answer IN ('a', 'absent') OR TRY_CAST(answer AS DOUBLE) >= 0
              OR (answer = '' AND EXISTS (SELECT 1 FROM {answered} m WHERE m.assessment_id = a.assessment_id
                  AND m.student_id = a.student_id AND m.institution_id = a.institution_id)))""",
)
def b21_answer_log(c: Campus):
    c.tables = {**CAMPUS, **ANSWERS}
    return importing.answer_writes(c["answer"], c["answered"])


ANSWERS = {
    "answer": """
        SELECT CAST(l_suppkey % 5 AS STRING) AS institution_id, CONCAT('S', CAST(l_suppkey AS STRING)) AS session,
               (l_orderkey * 8 + l_linenumber) * 1000000000 + l_partkey AS seq, CAST(l_orderkey AS STRING) AS student_id,
               CONCAT(CAST(l_partkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS assessment_id,
               CASE WHEN l_quantity = 50 AND l_discount = 0 THEN ' Q ' WHEN l_quantity = 1 THEN 'Absent' WHEN l_quantity = 2 THEN ''
                    WHEN l_quantity = 3 THEN '-4' WHEN l_quantity = 4 THEN 'huh'
                    ELSE CONCAT(CAST(CAST(l_quantity AS INT) AS STRING), '.25') END AS raw
        FROM {lineitem}""",
    "answered": """
        SELECT DISTINCT CAST(l_suppkey % 5 AS STRING) AS institution_id, CAST(l_orderkey AS STRING) AS student_id,
               CONCAT(CAST(l_partkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS assessment_id,
               CAST(1 AS DOUBLE) AS obtained, 'entered' AS status
        FROM {lineitem} WHERE l_linestatus = 'F'""",
}
ORACLE_TABLES.update(ANSWERS)
