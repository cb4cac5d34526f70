import json
import os
import tempfile

import pytest
from pyspark.errors import AnalysisException
from helpers import config, configs_of
from pyspark.sql import functions as F

from gradeloom.operators.provision import provision, provision_counts
from gradeloom.operators.results import student_results
from gradeloom.operators.skew import number_rows, running_total
from gradeloom.operators.templates import sheet_titles, template_errors, template_headers
from gradeloom.sources.config_json import ConfigError, load_configs, parse_configs
from gradeloom.sources.store import Store


def test_documents_in_a_folder(spark):
    folder = tempfile.mkdtemp(prefix="gradeloom-configs-")
    for name in ("a", "b"):
        with open(f"{folder}/{name}.json", "w") as out:
            json.dump(config(name), out, indent=2)
    assert load_configs(spark, folder).institutions().count() == 2
    with open(f"{folder}/c.json", "w") as out:
        json.dump({"institution": {"name": ""}}, out)
    with pytest.raises(ConfigError, match="Institution needs id, name in .*c.json"):
        load_configs(spark, folder)


def test_defaults_absent_and_null(spark):
    d = {"institution": {"id": "x", "name": "X", "default_rule_set_id": None}, "reporting": None,
         "grade_scales": [{"id": "g", "bands": [{"min_percentage": 0, "grade": "F"}, {"min_percentage": 70, "grade": "B"}, {"min_percentage": 90, "grade": "A"}]},
                          {"id": "g", "bands": []}],
         "rule_sets": [{"id": "r"}],
         "assessment_schemes": [{"id": "m", "assessments": [{"name": "T", "max_marks": 10, "order": 0}, {"name": "U", "max_marks": 5}]}],
         "seed": {"terms": [{"id": "t1", "name": "T"}, {"id": "t2", "name": "U"}], "students": [{"id": 5, "name": "N", "extra": {"a": [1]}}],
                  "offerings": [{"id": "o", "org_unit_id": "u", "course_id": "c"}, {"id": "p", "org_unit_id": "u", "course_id": "c", "term_id": None, "max_marks": 0}],
                  "enrollments": [{"id": "e", "student_id": 5, "org_unit_id": "u", "course_ids": ["o", "p", "o"]}]}}
    configs, errors = configs_of(spark, [d])
    assert errors.isEmpty()
    inst = configs.institutions().first()
    assert (inst.default_grade_scale_id, inst.default_rule_set_id, inst.org_levels) == ("default", None, [])
    rules = configs.rule_sets().first()
    assert (rules.pass_percentage, rules.per_course_pass_percentage, rules.aggregation, rules.decimals) == (
        40.0, None, "weighted_percentage", 2,
    )
    assert [b.grade for b in configs.grade_scales().first().bands] == ["A", "B", "F"]
    reporting = configs.reporting().first()
    assert reporting.include_chart and reporting.formats == ["excel", "pdf"]
    tables = provision(configs)
    offerings = {r.id: (r.year_id, r.term_id, r.max_marks, r.assessment_scheme_id) for r in tables["offering"].collect()}
    assert offerings == {"o": ("", "t1", 100.0, "m"), "p": ("", None, 0.0, "m")}
    assert {(r.id, r.order) for r in tables["assessment"].collect()} == {("o#1", 1), ("o#2", 2), ("p#1", 1), ("p#2", 2)}
    assert tables["student"].first().extra == '{"a":[1]}'
    taken = tables["enrollment_course"].orderBy("pos").collect()
    assert [r.offering_id for r in taken] == ["o", "p", "o"]
    assert provision_counts(configs).first().records == 1 + 2 + 1 + 2 + 4 + 1


@pytest.fixture(scope="module")
def store(spark):
    store = Store(spark, tempfile.mkdtemp(prefix="gradeloom-store-"), shards=2)
    configs, _ = configs_of(spark, [config("a"), config("b"), config("c")])
    store.provision(provision(configs))
    return store


def marks(spark, rows):
    schema = "institution_id string, id string, student_id string, assessment_id string, obtained double, status string, write_no bigint"
    return spark.createDataFrame([(i, f"{s}:{a}", s, a, o, "entered", n) for n, (i, s, a, o) in enumerate(rows)], schema)


def test_store_scopes_upserts_and_clears(spark, store):
    assert store.load_all("student").count() == 9 and store.load_all("student", "a").count() == 3
    assert store.load("student", "p1", "a").first().name == "Ines Duarte"
    assert store.load("student", "zz", "a").isEmpty() and store.load_all("mark").isEmpty()
    store.save("mark", marks(spark, [("a", "p1", "geo_n#1", 5.0), ("a", "p2", "geo_n#1", 6.0), ("b", "p1", "geo_n#1", 7.0)]))
    store.save("mark", marks(spark, [("a", "p3", "geo_n#1", 1.0), ("a", "p1", "geo_n#1", 8.0), ("a", "p1", "geo_n#1", 9.0)]))
    got = [(r.institution_id, r.student_id, r.obtained) for r in store.load_all("mark").orderBy("institution_id", "seq").collect()]
    assert got == [("a", "p1", 9.0), ("a", "p2", 6.0), ("a", "p3", 1.0), ("b", "p1", 7.0)]
    only_a = spark.createDataFrame([("a",)], "institution_id string")
    before = student_results(store.domain("a")).count()
    store.clear(only_a)
    assert before == 3 and store.load_all("student", "a").isEmpty()
    assert {r.institution_id for r in store.load_all("mark").collect()} == {"b"}
    configs, _ = configs_of(spark, [config("b")])
    store.provision(provision(configs))  # a second provisioning erases marks
    assert store.load_all("mark").isEmpty() and store.load_all("student").count() == 6


def test_templates(spark):
    offering = spark.createDataFrame(
        [("i", "a/b"), ("i", "ab"), ("i", "[]"), ("i", "x" * 40)], "institution_id string, id string"
    )
    titles = {r.id: r.title for r in sheet_titles(offering).collect()}
    assert titles == {"a/b": "ab", "ab": "ab_2", "[]": "offering", "x" * 40: "x" * 31}
    crowd = ["a*b", "a/b", "a:b", "AB", "ab_2", *("y" * 31 + str(n) for n in range(12)), "y" * 31]
    both = spark.createDataFrame([(i, c) for i in ("i", "j") for c in crowd], "institution_id string, id string")
    got = sheet_titles(both).collect()
    assert len(got) == 2 * len(crowd) and all(len(r.title) <= 31 for r in got)
    assert len({(r.institution_id, r.title.lower()) for r in got}) == 2 * len(crowd)
    assessment = spark.createDataFrame(
        [("i", "ab", 2, "ab#1", "Late"), ("i", "ab", 1, "ab#2", "Early"), ("i", "ab", 1, "ab#10", "Earliest")],
        "institution_id string, offering_id string, order int, id string, name string",
    )
    rows = template_headers(offering, assessment, offering_hint="ab").orderBy("col_no").collect()
    assert [(r.sheet, r.header) for r in rows] == [
        ("Marks", h) for h in ("Roll No", "Student Name", "Earliest", "Early", "Late")
    ]
    assert template_headers(offering, assessment).where("sheet = 'offering'").count() == 2


def test_templates_by_institution(spark):
    offering = spark.createDataFrame([("p", "o1"), ("p", "o2"), ("q", "o1"), ("q", "o2"), ("r", "o1"), ("s", "o1")], "institution_id string, id string")
    assessment = spark.createDataFrame(
        [(i, o, 1, f"{o}#1", "Test") for i in "pqrs" for o in ("o1", "o2")],
        "institution_id string, offering_id string, order int, id string, name string",
    )
    settings = spark.createDataFrame(
        [("p", True, None), ("q", False, "o2"), ("r", False, ""), ("s", False, "o9")],
        "institution_id string, expect_course_prefix boolean, offering_hint string",
    )
    rows = template_headers(offering, assessment, settings=settings).collect()
    assert {(r.institution_id, r.offering_id, r.sheet) for r in rows} == {("p", "o1", "o1"), ("p", "o2", "o2"), ("q", "o2", "Marks")}
    assert len(rows) == 9
    assert {r.institution_id: r.error for r in template_errors(offering, settings).collect()} == {
        "r": "--offering is required when excel.expect_course_prefix is false", "s": "no course offering with id 'o9'",
    }


def test_numbering_across_blocks(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7).alias("o"))
    rows = number_rows(df, ["k"], "o", "n", parts=7).collect()
    for k in range(3):
        assert [r.n for r in sorted((r for r in rows if r.k == k), key=lambda r: r.o)] == list(range(1, 335 if k == 0 else 334))
    total = running_total(df, ["k"], "o", "t", weight=F.col("o"), parts=5).where("k = 1").agg(F.max("t")).first()[0]
    assert total == sum(7 * i for i in range(1000) if i % 3 == 1)


def test_numbering_of_sparse_and_equal_orders(spark):
    """A group of far apart orders and one of equal orders: no window sees more than a partition."""
    rows = spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, "sparse").otherwise("equal").alias("k"),
        F.when(F.col("id") % 2 == 0, F.col("id") * 10_000_019).otherwise(F.lit(5)).alias("o"),
        F.col("id"),
    )
    got = number_rows(rows, ["k"], "o", "n", parts=16).collect()
    for k in ("sparse", "equal"):
        assert sorted(r.n for r in got if r.k == k) == list(range(1, 2001))
    sparse = sorted((r for r in got if r.k == "sparse"), key=lambda r: r.o)
    assert [r.n for r in sparse] == list(range(1, 2001))
    dealt = rows.repartitionByRange(16, "k", "o", "id").select("k", F.spark_partition_id().alias("p")).groupBy("k", "p").count().collect()
    assert max(r["count"] for r in dealt) < 700


def test_unusable_documents_are_errors_of_their_own(spark):
    good = config("good")
    twice = [config("twice"), config("twice")]
    decimals = config("decimals")
    decimals["rule_sets"][0]["decimals"] = 12
    words = config("words")
    words["rule_sets"][0]["decimals"] = "many"
    homeless = config("homeless")
    del homeless["seed"]["offerings"][1]["org_unit_id"]
    endless = config("endless")
    del endless["assessment_schemes"][0]["assessments"][2]["max_marks"]
    documents = [good, *twice, decimals, words, homeless, endless]
    texts = [(f"{n}.json", json.dumps(d)) for n, d in enumerate(documents)]
    texts += [("7.json", "{not json"), ("8.json", '{"institution": {"id": "a", "id": "b"}}'), ("9.json", None), ("10.json", "[]")]
    configs, errors = parse_configs(spark.createDataFrame(texts, "file string, text string"))
    assert [r.institution_id for r in configs.institutions().collect()] == ["good"]
    found = {r.file: r.message for r in errors.collect()}
    clash = "Institution 'twice' is configured in 1.json and 2.json"
    assert found == {
        "1.json": clash,
        "2.json": clash,
        "3.json": "decimals outside 0 to 8 in 3.json",
        "4.json": "decimals outside 0 to 8 in 4.json",
        "5.json": "offering without org_unit_id in 5.json",
        "6.json": "assessment without max_marks in 6.json",
        "7.json": "not a JSON document: 7.json",
        "8.json": "not a JSON document: 8.json",
        "9.json": "not a JSON document: 9.json",
        "10.json": "Institution needs id, name in 10.json",
    }


def test_a_store_keeps_its_number_of_shards(spark, store):
    assert Store(spark, store.root, shards=2).load_all("student").count() == store.load_all("student").count() > 0
    with pytest.raises(ValueError, match="has 2 shards, not 256"):
        Store(spark, store.root)


def files_of(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith((".parquet", ".json"))}


def stored_marks(store, **version):
    rows = store.load_all("mark", **version).orderBy("institution_id", "seq").collect()
    return [(r.institution_id, r.student_id, r.obtained) for r in rows]


@pytest.fixture
def own_store(spark):
    store = Store(spark, tempfile.mkdtemp(prefix="gradeloom-store-"), shards=4)
    store.replace("mark", marks(spark, [(f"i{k % 6}", f"p{k}", "a", float(k)) for k in range(600)]).withColumn("seq", F.col("write_no")))
    return store


def test_one_changed_mark_writes_one_small_file(spark, own_store):
    before = files_of(own_store.root)
    own_store.save("mark", marks(spark, [("i1", "p1", "a", 77.0)]))
    new = {p: n for p, n in files_of(own_store.root).items() if p not in before}
    assert [n < 10_000 for p, n in new.items() if p.endswith(".parquet")] == [True]
    assert all(files_of(own_store.root)[p] == n for p, n in before.items())
    assert dict((s, o) for _, s, o in stored_marks(own_store))["p1"] == 77.0
    assert len(stored_marks(own_store)) == 600


def test_earlier_versions_stay_readable(spark, own_store):
    first = own_store.versions()[-1]
    was = stored_marks(own_store)
    own_store.save("mark", marks(spark, [("i1", "p1", "a", 1.5), ("i9", "q", "a", 2.5)]))
    own_store.clear(spark.createDataFrame([("i2",)], "institution_id string"))
    own_store.save("mark", marks(spark, [("i2", "p2", "a", 3.5), ("i9", "q", "a", 4.5)]))
    now = stored_marks(own_store)
    assert stored_marks(own_store, version=first) == was
    want = [(i, s, 1.5 if s == "p1" else o) for i, s, o in was if i != "i2"] + [("i2", "p2", 3.5), ("i9", "q", 4.5)]
    assert sorted(now) == sorted(want)
    own_store.compact()
    assert stored_marks(own_store) == now  # positions too
    own_store.vacuum()
    assert stored_marks(own_store) == now and len(own_store.versions()) == 1
    with pytest.raises(AnalysisException):
        own_store.load_all("mark", version=first).collect()


def test_a_failed_write_changes_nothing(spark, own_store):
    was, versions = stored_marks(own_store), own_store.versions()
    good = marks(spark, [("i1", "p1", "a", 0.5)])
    bad = marks(spark, [("i1", "p2", "a", 0.5)]).withColumn("obtained", F.raise_error(F.lit("broken")).cast("double"))
    student = spark.createDataFrame([("i1", "s", "n", "r", 0)], "institution_id string, id string, name string, roll_no string, write_no bigint")
    for saved in ({"student": student, "mark": bad}, {"mark": good.unionByName(bad)}):
        with pytest.raises(Exception, match="broken"):
            own_store.write(saved=saved)
    assert own_store.versions() == versions and stored_marks(own_store) == was
    assert own_store.load_all("student").isEmpty()
    own_store.vacuum()  # what the failed writes left goes, what is stored stays
    assert stored_marks(own_store) == was


def test_the_second_of_two_writers_fails(spark, own_store):
    number, rows = own_store._version()
    own_store.save("mark", marks(spark, [("i1", "p1", "a", 0.5)]))
    with pytest.raises(AnalysisException):
        own_store._commit(number, [r.asDict() for r in rows])


def test_many_saves_are_compacted(spark, own_store, monkeypatch):
    from gradeloom.sources import store as module

    monkeypatch.setattr(module, "LAYERS", 3)
    for n in range(6):
        own_store.save("mark", marks(spark, [("i1", "p1", "a", 100.0 + n), ("i1", f"new{n}", "a", 1.0)]))
    rows = own_store._version()[1]
    assert max(sum(r["shard"] == s for r in rows) for s in range(4)) <= 3
    mine = [(s, o) for i, s, o in stored_marks(own_store) if i == "i1"]
    assert mine[0] == ("p1", 105.0) and [s for s, _ in mine[-6:]] == [f"new{n}" for n in range(6)] and len(mine) == 106


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_documents_are_judged_once_and_sections_stay_in_them(spark):
    configs, errors = configs_of(spark, [config(), {"institution": {"id": "x"}}])
    assert "parse_json" not in _plan(errors)
    for rows in (configs.rule_sets(), configs.scheme_specs(), configs.seed_rows("students", "last")):
        plan = _plan(rows)
        assert plan.count("parse_json") <= 1 and "hashpartitioning" not in plan


def test_repeated_ids_of_a_section(spark):
    document = config()
    document["seed"]["students"] = [{"id": i, "name": n} for i, n in [("a", "1"), ("b", "2"), (None, "3"), ("a", "4"), (None, "5"), ("c", "6")]]
    document["rule_sets"] = [{"id": i, "pass_percentage": p} for i, p in [("r", 1), ("q", 2), ("r", 3)]]
    configs = configs_of(spark, [document])[0]
    students = {tuple(r) for r in configs.seed_rows("students", "last").select("seq", "id", "name").collect()}
    assert students == {(0, "a", "4"), (1, "b", "2"), (2, None, "5"), (5, "c", "6")}
    assert {tuple(r) for r in configs.rule_sets().select("seq", "id", "pass_percentage").collect()} == {(0, "r", 1.0), (1, "q", 2.0)}


def test_offerings_stay_in_their_document(spark):
    tables = provision(configs_of(spark, [config()])[0])
    assert "hashpartitioning" not in _plan(tables["offering"])
    assert {r["assessment_scheme_id"] for r in tables["offering"].collect()} == {"main"}


def test_one_table_is_provisioned_alone(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("assessments were numbered")

    monkeypatch.setattr("gradeloom.operators.provision.number_rows", refuse)
    tables = provision(configs_of(spark, [config()])[0])
    assert tables["offering"].count() == 3 and len(tables) == 12
    with pytest.raises(AssertionError, match="numbered"):
        tables["assessment"]


def test_documents_are_parsed_once(spark):
    tables = provision(configs_of(spark, [config("a"), config("b")])[0])
    assert all("parse_json" not in _plan(tables[name]) for name in ("institution", "offering", "student", "rule_set"))
    assert {r["institution_id"] for r in tables["institution"].collect()} == {"a", "b"}


def test_stored_tables_of_many_institutions_are_not_broadcast(spark, monkeypatch):
    store = Store(spark, tempfile.mkdtemp(prefix="gradeloom-store-"), shards=2)
    store.provision(provision(configs_of(spark, [config("a"), config("b")])[0]))

    def joined():
        domain = store.domain()
        return _plan(domain.term.join(domain.institution, "institution_id"))

    assert "BroadcastHashJoin" in joined()
    monkeypatch.setattr("gradeloom.session.BROADCAST_ROWS", 1)
    assert "SortMergeJoin" in joined()
