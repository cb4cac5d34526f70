import math
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import grading, marks, numeric, text


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def evaluate(df, expr):
    return [row[0] for row in df.orderBy("i").select(expr).collect()]


def rounding_cases():
    rng = random.Random(7)
    cases = [k / 200 for k in range(-4000, 4000)]
    cases += [rng.uniform(-500, 500) for _ in range(4000)]
    cases += [round(rng.uniform(0, 100), 2) * round(rng.uniform(0, 1), 2) for _ in range(4000)]
    return cases + [0.5, 1.5, 2.5, 2.675, 1.005, 0.125, 0.375, 1e9 + 0.005]


@pytest.mark.parametrize("digits", [0, 1, 2, 3, 5, 8])
def test_py_round(spark, digits):
    cases = rounding_cases()
    got = evaluate(column(spark, cases), numeric.py_round(F.col("x"), digits))
    assert [g for g, c in zip(got, cases) if g != round(c, digits)] == []


def test_py_round_by_column_and_specials(spark):
    df = spark.createDataFrame([(0, 2.345, 1), (1, 2.345, 2), (2, float("inf"), 2)], "i int, x double, d int")
    assert evaluate(df, numeric.py_round(F.col("x"), F.col("d"))) == [2.3, round(2.345, 2), float("inf")]
    nan = evaluate(column(spark, [float("nan")]), numeric.py_round(F.col("x"), 2))
    assert math.isnan(nan[0])
    with pytest.raises(ValueError):
        numeric.py_round(F.col("x"), 9)


def summed(spark, rows):
    df = spark.createDataFrame(rows, "g int, x double").repartition(7)
    sums = {"s": F.col("x"), "twice": F.col("x") * 2.0}
    found = numeric.exact_sums(df, ["g"], sums, {"n": (F.count(F.lit(1)), F.sum)}).collect()
    assert all(r.twice == 2 * r.s or math.isnan(r.s) for r in found)
    return {r.g: r.s for r in found}


def test_exact_sums_of_all_magnitudes(spark):
    rng = random.Random(3)
    rows, expected = [], {}
    odd = [1e16, 1.0, -1e16, 2.0**-53, 1e-21, 0.0001, 2.0**53, -(2.0**53), 5e-324, 3 * 2.0**-1074, 0.1, -0.1]
    shapes = [
        lambda: rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300),
        lambda: rng.uniform(-1, 1) * 10.0 ** rng.randint(-20, 20),
        lambda: round(rng.uniform(0, 100), 2),
        lambda: rng.choice(odd),
        lambda: rng.uniform(-1e-3, 1e-3) * 2.0 ** -rng.randint(0, 40),
        lambda: round(rng.uniform(0, 100), 2) * round(rng.uniform(0, 1), 2),
    ]
    for group in range(3000):
        values = [shapes[group % 6]() for _ in range(rng.randint(1, 12))]
        expected[group] = math.fsum(values)
        rows += [(group, v) for v in values]
    rng.shuffle(rows)
    got = summed(spark, rows)
    assert {g: (got[g], e) for g, e in expected.items() if got[g] != e} == {}


def test_exact_sums_of_nothing_and_specials(spark):
    inf, nan = float("inf"), float("nan")
    got = summed(spark, [(0, None), (1, inf), (1, 1.0), (2, nan), (2, 1.0), (3, 2.0**40), (3, 0.5), (4, inf), (4, -inf), (5, 0.0)])
    assert got[0] == got[5] == 0.0 and got[1] == inf and math.isnan(got[2]) and math.isnan(got[4]) and got[3] == 2.0**40 + 0.5


def test_general_format_at_every_magnitude(spark):
    rng = random.Random(11)
    cases = [rng.choice([-1, 1]) * rng.uniform(1, 10) * 10.0 ** rng.randint(-320, 300) for _ in range(3000)]
    cases += [float(f"{rng.randint(100000, 999999)}5e{rng.randint(-320, 295)}") for _ in range(6000)]  # as near to a tie as doubles go
    cases += [k / 64 for k in range(-800, 800)] + [rng.randint(100000, 999999) * 10 + 5.0 for _ in range(800)]
    cases += [10.0**k for k in range(-320, 309)] + [9.999995 * 10.0**k for k in range(-300, 300)]
    cases += [5e-324, 1.7976931348623157e308, -0.0, 1.234565e-05, 0.0008789745]
    got = evaluate(column(spark, cases), numeric.fmt_g(F.col("x")))
    assert [(c, g) for c, g in zip(cases, got) if f"{c:g}" != g] == []


@pytest.mark.parametrize("digits", [0, 1, 2, 8])
def test_round_of_large_numbers(spark, digits):
    rng = random.Random(13)
    cases = [rng.uniform(-1, 1) * 10.0 ** rng.randint(5, 20) for _ in range(2000)] + [2.0 ** rng.randint(40, 54) + rng.randint(0, 10**6) / 64 for _ in range(2000)]
    cases += [4498598583533459.5, 1e300, -1e22]
    got = evaluate(column(spark, cases), numeric.py_round(F.col("x"), digits))
    assert [(c, g) for c, g in zip(cases, got) if g != round(c, digits)] == []


def test_formats(spark):
    rng = random.Random(5)
    cases = rounding_cases()[::7] + [10.0**k for k in range(-3, 9)] + [0.0, 20.5, 100.0, 10000.25, 999999.5, 123456.5, 1234567.0]
    cases += [rng.uniform(0, 10 ** rng.randint(-2, 6)) for _ in range(3000)]
    df = column(spark, cases)
    assert [p for p in zip(cases, evaluate(df, numeric.fmt_g(F.col("x")))) if f"{p[0]:g}" != p[1]] == []
    for digits in (0, 1, 2):
        bad = [
            p for p in zip(cases, evaluate(df, numeric.fmt_f(F.col("x"), digits)))
            if f"{p[0]:.{digits}f}" != p[1]
        ]
        assert bad == []
    specials = column(spark, [float("nan"), float("inf"), float("-inf")])
    assert evaluate(specials, numeric.fmt_g(F.col("x"))) == ["nan", "inf", "-inf"]
    assert evaluate(specials, numeric.fmt_f(F.col("x"), 2)) == ["nan", "inf", "-inf"]


def test_fixed_format_and_integers_of_every_magnitude(spark):
    rng = random.Random(5)
    cases = [rng.choice((-1, 1)) * rng.uniform(1, 10) * 10.0**e for e in range(-300, 308, 3) for _ in range(2)]
    cases += [rng.uniform(1, 10) * 10.0**e for e in range(12, 20) for _ in range(25)]
    cases += [0.5, 1.5, 2.5, -0.5, 0.0, -0.0, -0.001, 0.125, 0.375, 2.0**52 + 0.5, 2.0**52 + 1.5, 2.0**53, 2.0**63, 2.0**64, 1.7976931348623157e308, 999.999999999, 1e16]
    df = column(spark, cases)
    for digits in (0, 1, 2, 6):
        assert evaluate(df, numeric.fmt_f(F.col("x"), digits)) == [f"{x:.{digits}f}" for x in cases]
    whole = [float(int(x)) for x in cases if abs(x) >= 1]
    cells = column(spark, [repr(x) for x in whole], "string")
    assert evaluate(cells, text.clean_text(F.col("x"), F.lit("float"))) == [str(int(x)) for x in whole]


def test_templates_agree_with_format(spark):
    rng = random.Random(3)
    given = {"student": "Ann {roll}", "roll": "7"}
    pieces = ["{student}", "{roll}", "{{", "}}", "{", "}", "{other}", "{roll:>5}", "{student:*^12.3}", "{roll:05}", "{roll!s:<3}", "{student:.2s}",
              "{roll!r}", "{roll:d}", "{}", "x", " - ", "é", "{roll:{}}", "{roll:+5}", "{roll:<<4}"]
    templates = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 5))) for _ in range(600)] + pieces

    def plain(template):
        if "!r" in template or ":{}" in template:  # stays as it is, by the rule of this library
            return None
        try:
            return template.format(**given)
        except (KeyError, IndexError, ValueError):
            return template

    got = evaluate(column(spark, templates, "string"), text.fill_template(F.col("x"), {k: F.lit(v) for k, v in given.items()}))
    assert [(t, g) for t, g in zip(templates, got) if plain(t) not in (None, g)] == []


def test_digits_of_every_script(spark):
    written = ["٤٢", "४२.५", "１_０", "-٣", "٤²", "𝟗𝟖", "四"]
    df = column(spark, written, "string")
    got = evaluate(df, marks.parse_mark(F.col("x"), F.lit("text"), F.lit(100.0)))

    def number(mark):
        try:
            return float(mark)
        except ValueError:
            return None

    assert [g["obtained"] for g in got] == [number(m) for m in written]


def safe(name):
    kept = "".join(c for c in name if c.isalnum() or c in " _-").strip()
    return (kept or "Student").replace(" ", "_")


def test_safe_name(spark):
    names = ["Aarav Sharma", "  a/b: c ", "???", "", "Zoë-Å_1", "李雷", "٣ x", "a\tb"]
    assert evaluate(column(spark, names, "string"), text.safe_name(F.col("x"))) == [safe(n) for n in names]


def test_strip_every_white_space(spark):
    names = [f"{c}x y{c}" for c in text.WHITESPACE]
    assert len(text.WHITESPACE) == sum(chr(c).isspace() for c in range(0x11000))
    assert set(evaluate(column(spark, names, "string"), text.strip(F.col("x")))) == {"x y"}


def test_clean_text_and_headers(spark):
    df = spark.createDataFrame(
        [(0, "78.0", "float"), (1, "20.5", "float"), (2, " Roll   No ", "text"), (3, None, "blank"), (4, "7", "int")],
        "i int, x string, k string",
    )
    assert evaluate(df, text.clean_text(F.col("x"), F.col("k"))) == ["78", "20.5", "Roll   No", "", "7"]
    assert evaluate(df, text.normal_header(F.col("x"), F.col("k")))[2] == "roll no"


def test_templates(spark):
    df = spark.createDataFrame(
        [(0, "{institution} - {term}"), (1, "{missing} result"), (2, "plain"), (3, "{term}{term}!")], "i int, x string"
    )
    values = {"institution": F.lit("X {term} $1"), "term": F.lit("Y")}
    assert evaluate(df, text.fill_template(F.col("x"), values)) == [
        "X {term} $1 - Y", "{missing} result", "plain", "YY!",
    ]


def test_parse_mark(spark):
    cases = [
        ("20.5", "float"), ("78", "text"), (" 78 ", "text"), ("A", "text"), ("AB", "text"), ("absent", "text"),
        ("Abs", "text"), ("E", "text"), ("EX", "text"), ("exempt", "text"), (None, "blank"), ("", "text"), ("  ", "text"),
        ("-1", "int"), ("101", "int"), ("oops", "text"), ("1_0", "text"), ("1e1", "text"), ("1d", "text"),
        ("0x1", "text"), ("inf", "text"), ("-inf", "text"), ("nan", "text"), ("1__0", "text"), ("True", "bool"),
        ("2024-01-01", "date"), (".5", "text"), ("5.", "text"), ("+7", "text"), (".", "text"), ("150.5", "text"),
    ]
    df = spark.createDataFrame([(i, v, k) for i, (v, k) in enumerate(cases)], "i int, v string, k string")
    parsed = df.withColumn("m", marks.parse_mark(F.col("v"), F.col("k"), F.lit(100.0)))
    text_of = marks.problem_text(F.col("m.problem"), F.col("v"), F.col("m.obtained"), F.lit(100.0))
    value = F.when(F.col("m.status").isNotNull(), F.col("m.obtained"))
    got = [tuple(r) for r in parsed.orderBy("i").select("m.status", value, text_of).collect()]
    blank = (None, None, None)

    def entered(x):
        return ("entered", x, None)

    def bad(message):
        return (None, None, message)

    def unknown(raw):
        return bad(f"unrecognised mark value '{raw}'")

    expected = [
        entered(20.5), entered(78.0), entered(78.0), *[("absent", 0.0, None)] * 4, *[("exempt", 0.0, None)] * 3,
        blank, blank, blank, bad("marks cannot be negative"), bad("mark 101 exceeds maximum 100"), unknown("oops"),
        entered(10.0), entered(10.0), unknown("1d"), unknown("0x1"), bad("mark inf exceeds maximum 100"),
        bad("marks cannot be negative"), None, unknown("1__0"), entered(1.0), unknown("2024-01-01"),
        entered(0.5), entered(5.0), entered(7.0), unknown("."), bad("mark 150.5 exceeds maximum 100"),
    ]
    nan = cases.index(("nan", "text"))
    assert got[nan][0] == "entered" and math.isnan(got[nan][1])
    got[nan] = None
    assert got == expected


def bands_column(bands):
    return F.array(*[F.struct(F.lit(m).alias("min_percentage"), F.lit(g).alias("grade")) for m, g in bands])


def test_default_scale(spark):
    cases = [100, 90, 89, 80, 79, 70, 69, 60, 59, 50, 49, 40, 39, 0, 101, -5]
    expected = "A+ A+ A A B+ B+ B B C C D D F F A+ F".split()
    df = column(spark, [float(c) for c in cases])
    assert evaluate(df, grading.grade_by_bands(F.col("x"))) == expected
    assert evaluate(df, grading.grade_for(F.col("x"), bands_column(grading.DEFAULT_BANDS))) == expected


def test_other_scales(spark):
    df = column(spark, [100.0, 90.0, 89.0, 50.0, 49.0, 0.0, -5.0, float("nan")])
    bands = [(90.0, "A"), (50.0, "C"), (0.0, "F")]
    assert evaluate(df, grading.grade_for(F.col("x"), bands_column(bands))) == list("AACCFFFF")
    empty = F.array().cast("array<struct<min_percentage:double,grade:string>>")
    assert set(evaluate(df, grading.grade_for(F.col("x"), empty))) == {""}
    shuffled = bands_column([(0.0, "F"), (70.0, "B1"), (90.0, "A"), (70.0, "B2")])
    got = evaluate(df, F.transform(grading.sort_bands(shuffled), lambda b: b["grade"]))[0]
    assert got == ["A", "B1", "B2", "F"]


def test_pass_rules(spark):
    df = spark.createDataFrame(
        [
            (0, True, 35.0, 40.0), (1, True, 35.0, 30.0), (2, True, None, 0.0), (3, False, None, 0.0),
            (4, True, 35.0, float("nan")),
        ],
        "i int, rules boolean, threshold double, x double",
    )
    assert evaluate(df, grading.course_passed(F.col("rules"), F.col("threshold"), F.col("x"))) == [
        True, False, True, True, False,
    ]
    df = spark.createDataFrame(
        [
            (0, True, 45.0, True), (1, True, 35.0, True), (2, True, 45.0, False), (3, False, 0.0, False),
            (4, True, 45.0, None), (5, True, float("nan"), True),
        ],
        "i int, rules boolean, x double, allc boolean",
    )
    assert evaluate(df, grading.student_passed(F.col("rules"), F.lit(40.0), F.col("x"), F.col("allc"))) == [
        True, False, False, True, True, True,
    ]
