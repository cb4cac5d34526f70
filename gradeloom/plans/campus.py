"""The driver's tables seen as a campus: SELECTs that any SQL engine reads.

Each text names the tables it reads in braces. Spark fills them with
DataFrames; an oracle turns them into common table expressions. Institutions
are regions, students customers, offerings orders, and every line item is one
write to the log of marks.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions.grading import DEFAULT_BANDS, sort_bands
from gradeloom.operators.results import Domain
from gradeloom.operators.upsert import latest_marks
from gradeloom.session import settle

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")

CAMPUS = {
    "institution": """
        SELECT CAST(r_regionkey AS STRING) AS institution_id, CAST(r_regionkey AS BIGINT) AS seq, r_name AS name,
               'University' AS institution_type, 'default' AS default_grade_scale_id,
               CASE r_regionkey WHEN 3 THEN 'lenient' WHEN 4 THEN 'nosuch' ELSE 'default' END AS default_rule_set_id
        FROM {region}""",
    "rule_set": """
        SELECT institution_id, 0 AS seq, 'default' AS id, 'default' AS grade_scale_id,
               CAST(40 AS DOUBLE) AS pass_percentage, CAST(35 AS DOUBLE) AS per_course_pass_percentage,
               'weighted_percentage' AS aggregation, 2 AS decimals FROM {institution}
        UNION ALL
        SELECT institution_id, 1, 'raw', 'strict', CAST(50 AS DOUBLE), CAST(40 AS DOUBLE),
               'raw_total_percentage', 2 FROM {institution}
        UNION ALL
        SELECT institution_id, 2, 'open', 'default', CAST(40 AS DOUBLE), CAST(NULL AS DOUBLE),
               'weighted_percentage', 2 FROM {institution}
        UNION ALL
        SELECT institution_id, 3, 'lenient', 'coarse', CAST(30 AS DOUBLE), CAST(25 AS DOUBLE),
               'other_percentage', 1 FROM {institution}""",
    "student": """
        SELECT CAST(c_custkey % 5 AS STRING) AS institution_id, c_custkey AS seq, CAST(c_custkey AS STRING) AS id,
               c_name AS name, CONCAT('R', CAST(c_custkey AS STRING)) AS roll_no
        FROM {customer}""",
    "enrollment": """
        SELECT CAST(o.o_custkey % 5 AS STRING) AS institution_id, o.o_custkey * 10000 + o.y AS seq,
               CONCAT('E', CAST(o.o_custkey AS STRING), '-', CAST(o.y AS STRING)) AS id,
               CAST(o.o_custkey AS STRING) AS student_id, CONCAT('Y', CAST(o.y AS STRING)) AS year_id,
               CASE WHEN c.c_acctbal < 0 THEN NULL WHEN c.c_acctbal < 2000 THEN 'T9' ELSE 'T1' END AS term_id,
               CASE WHEN c.c_acctbal > 9000 THEN 'none'
                    ELSE CONCAT('S', CAST(c.c_nationkey AS STRING), '-', c.c_mktsegment) END AS org_unit_id
        FROM (SELECT o_custkey, CAST(YEAR(o_orderdate) AS BIGINT) AS y FROM {orders} GROUP BY 1, 2) o
        JOIN {customer} c ON c.c_custkey = o.o_custkey""",
    "enrollment_course": """
        SELECT CAST(o_custkey % 5 AS STRING) AS institution_id,
               CONCAT('E', CAST(o_custkey AS STRING), '-', CAST(YEAR(o_orderdate) AS STRING)) AS enrollment_id,
               o_orderkey AS pos, CAST(o_orderkey AS STRING) AS offering_id
        FROM {orders}
        UNION ALL
        SELECT CAST(o_custkey % 5 AS STRING),
               CONCAT('E', CAST(o_custkey AS STRING), '-', CAST(YEAR(o_orderdate) AS STRING)),
               o_orderkey + 1000000000000000,
               CASE o_orderpriority WHEN '1-URGENT' THEN CAST(o_orderkey AS STRING)
                    ELSE CONCAT('gone', CAST(o_orderkey AS STRING)) END
        FROM {orders} WHERE o_orderstatus = 'P'""",
    "academic_year": """
        SELECT CAST(o_custkey % 5 AS STRING) AS institution_id, CAST(YEAR(o_orderdate) AS BIGINT) AS seq,
               CONCAT('Y', CAST(YEAR(o_orderdate) AS STRING)) AS id,
               CONCAT('Year ', CAST(YEAR(o_orderdate) AS STRING)) AS name
        FROM {orders} WHERE YEAR(o_orderdate) < 2001 GROUP BY 1, 2, 3, 4""",
    "term": """
        SELECT institution_id, CAST(1 AS BIGINT) AS seq, 'T1' AS id, CONCAT('Term 1 of ', name) AS name
        FROM {institution}""",
    "org_unit": """
        SELECT CAST(c_custkey % 5 AS STRING) AS institution_id, 'Segment' AS level, c_mktsegment AS name,
               CONCAT('S', CAST(c_nationkey AS STRING), '-', c_mktsegment) AS id,
               CONCAT('N', CAST(c_nationkey AS STRING)) AS parent_id
        FROM {customer} GROUP BY 1, 3, 4, 5
        UNION ALL
        SELECT CAST(c.c_custkey % 5 AS STRING), 'Nation', n.n_name, CONCAT('N', CAST(n.n_nationkey AS STRING)),
               CONCAT('R', CAST(n.n_regionkey AS STRING))
        FROM {customer} c JOIN {nation} n ON n.n_nationkey = c.c_nationkey GROUP BY 1, 3, 4, 5
        UNION ALL
        SELECT i.institution_id, 'Region', i.name, CONCAT('R', i.institution_id),
               CASE i.institution_id WHEN '0' THEN NULL WHEN '1' THEN 'world' ELSE '' END
        FROM {institution} i""",
    "org_deep": """
        SELECT institution_id, level, name, id, parent_id FROM {org_unit}
        UNION ALL
        SELECT CAST(c_custkey % 5 AS STRING), 'Desk', c_name, CONCAT('D', CAST(c_custkey AS STRING)),
               CASE WHEN (c_custkey - c_custkey % 5) % 60 = 0 THEN CONCAT('S', CAST(c_nationkey AS STRING), '-', c_mktsegment)
                    ELSE CONCAT('D', CAST(c_custkey - 5 AS STRING)) END
        FROM {customer}""",
    "course": """
        SELECT CAST(o_custkey % 5 AS STRING) AS institution_id, CONCAT(o_orderstatus, '/', o_orderpriority) AS id,
               CONCAT('Course ', o_orderpriority) AS name, o_orderstatus AS code
        FROM {orders} WHERE o_orderstatus <> 'P' GROUP BY 1, 2, 3, 4""",
    "offering": """
        SELECT CAST(o_custkey % 5 AS STRING) AS institution_id, o_orderkey AS seq, CAST(o_orderkey AS STRING) AS id,
               CONCAT(o_orderstatus, '/', o_orderpriority) AS course_id,
               CASE o_orderpriority WHEN '2-HIGH' THEN 'strict' WHEN '5-LOW' THEN '' END AS grade_scale_id,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'raw' WHEN '2-HIGH' THEN 'open'
                    WHEN '3-MEDIUM' THEN 'unheard' WHEN '5-LOW' THEN '' END AS rule_set_id,
               CAST(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'P' THEN 50 ELSE 100 END AS DOUBLE) AS max_marks
        FROM {orders}""",
    "assessment": """
        SELECT CAST(o.o_custkey % 5 AS STRING) AS institution_id, l.l_orderkey * 8 + l.l_linenumber AS seq,
               CONCAT(CAST(l.l_orderkey AS STRING), '#', CAST(l.l_linenumber AS STRING)) AS id,
               CAST(l.l_orderkey AS STRING) AS offering_id, CONCAT('L', CAST(l.l_linenumber AS STRING)) AS name,
               CAST(CASE l.l_linenumber WHEN 7 THEN 0 ELSE 50 END AS DOUBLE) AS max_marks,
               CAST(l.l_linenumber % 4 AS DOUBLE) / CAST(10 AS DOUBLE) AS weight, l.l_linenumber AS "order"
        FROM (SELECT l_orderkey, l_linenumber FROM {lineitem} GROUP BY 1, 2) l
        JOIN {orders} o ON o.o_orderkey = l.l_orderkey""",
    "mark_log": """
        SELECT CAST(o.o_custkey % 5 AS STRING) AS institution_id,
               (YEAR(l.l_shipdate) * 10000 + MONTH(l.l_shipdate) * 100 + DAY(l.l_shipdate)) * 100000000000
                   + l.l_partkey AS write_no,
               CAST(o.o_custkey AS STRING) AS student_id,
               CONCAT(CAST(l.l_orderkey AS STRING), '#', CAST(l.l_linenumber AS STRING)) AS assessment_id,
               l.l_quantity * (CAST(1 AS DOUBLE) - l.l_discount) AS obtained,
               CASE l.l_returnflag WHEN 'A' THEN 'absent' WHEN 'R' THEN 'exempt' ELSE 'entered' END AS status
        FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey""",
    "subject_mark": """
        SELECT CAST(l_orderkey AS STRING) AS student_name, l_linestatus AS semester,
               (l_linenumber * 100000000000 + l_partkey) * 10000
                   + (YEAR(l_shipdate) - 1990) * 372 + MONTH(l_shipdate) * 31 + DAY(l_shipdate) AS seq,
               CONCAT('Subject ', CAST(l_linenumber AS STRING), '.', CAST(l_partkey AS STRING)) AS subject,
               l_quantity * CAST(2 AS DOUBLE) AS mark
        FROM {lineitem}""",
}

# The grade scales of every institution.
SCALES = {
    "default": DEFAULT_BANDS,
    "strict": ((95.0, "A"), (75.0, "B"), (55.0, "C"), (0.0, "F")),
    "coarse": ((60.0, "P"), (30.0, "Q")),
}


def needed(text: str, tables: dict[str, str] = CAMPUS) -> list[str]:
    """The derived tables a text reads, each after the ones it reads itself."""
    order: list[str] = []

    def visit(body: str) -> None:
        for name in tables:
            if "{" + name + "}" in body and name not in order:
                visit(tables[name])
                order.append(name)

    visit(text)
    return order


def as_sql(text: str, tables: dict[str, str] = CAMPUS) -> str:
    """A stand-alone query over the driver's tables for another SQL engine."""
    names = {name: name for name in (*BASE_TABLES, *tables)}
    parts = [f"{name} AS ({_fill(tables[name], names)})" for name in needed(text, tables)]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + _fill(text, names)


def _fill(text: str, names: dict[str, str]) -> str:
    for name, value in names.items():
        text = text.replace("{" + name + "}", value)
    return text


class Campus:
    """Lazily derived DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, tables: dict[str, str] = CAMPUS):
        self.spark = spark
        self.sf_dir = sf_dir
        self.tables = tables
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in self.tables:
                self._made[name] = self.sql(self.tables[name])
            else:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._made[name]

    def settled(self, *names: str) -> "Campus":
        """Write the named tables once; tables made from now on read what was written."""
        for name in names:
            self._made[name] = settle(self[name])
        return self

    def sql(self, text: str) -> DataFrame:
        read = [n for n in (*BASE_TABLES, *self.tables) if "{" + n + "}" in text]
        body = text.replace('"order"', "`order`")
        return self.spark.sql(body, **{n: self[n] for n in read})

    def grade_scale(self) -> DataFrame:
        scales = F.array(
            *[
                F.struct(
                    F.lit(name).alias("id"),
                    sort_bands(
                        F.array(
                            *[F.struct(F.lit(m).alias("min_percentage"), F.lit(g).alias("grade")) for m, g in bands]
                        )
                    ).alias("bands"),
                )
                for name, bands in SCALES.items()
            ]
        )
        return self["institution"].select("institution_id", F.inline(scales))

    def domain(self) -> Domain:
        return Domain(
            institution=self["institution"],
            academic_year=self["academic_year"],
            term=self["term"],
            org_unit=self["org_unit"],
            student=self["student"],
            enrollment=self["enrollment"],
            enrollment_course=self["enrollment_course"],
            course=self["course"],
            offering=self["offering"],
            assessment=self["assessment"],
            mark=latest_marks(self["mark_log"]),
            grade_scale=self.grade_scale(),
            rule_set=self["rule_set"],
        )
