"""Whose row is it? Students found by roll number and name, or newly made.

Rows of an institution are judged in order, workbook after workbook by their
names, and a student made for one row is known to every later row. A row makes a student exactly when nobody holds its
roll and nobody holds its name, so which rows do is the greedy choice in row
order. Each round decides, in all institutions at once:

* a row that is the first undecided one for its roll and for its name wins;
* a roll or a name is held for certain once a row has come that only this key could stop:
  all later rows with the key lose;
* such a row that has a single undecided row of the key before it wins exactly if that one
  loses. These rows form chains of negations, which are composed by doubling: a chain
  of n rows that alternate between shared rolls and shared names takes log2(n) steps.

Only rows that wait for several undecided ones need further rounds. The verdict on every row
is then a lookup of the holders that were there before it.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions.text import safe_name
from gradeloom.operators.skew import number_rows, running_max, running_total
from gradeloom.session import settle

BOOK = ["institution_id", "workbook"]
INST = ["institution_id"]


def _place() -> Column:
    """The place of a row in its institution; places compare workbook first."""
    return F.struct("workbook", "ord")


def _holders(student: DataFrame, key: str) -> DataFrame:
    """Stored students per roll number or name: how many, and the first."""
    return (
        student.where(F.coalesce(F.col(key), F.lit("")) != "")
        .groupBy("institution_id", F.col(key).alias("key"))
        .agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("id", "name", "roll_no"), "seq").alias("held"))
    )


def new_student_rows(rows: DataFrame, student: DataFrame) -> DataFrame:
    """The rows that make a student: (institution_id, place, roll, name)."""
    return _makers(_pairs(rows), student)


def _pairs(rows: DataFrame) -> DataFrame:
    """Every roll with its name, once, and the first row that holds both."""
    return rows.groupBy(*INST, "roll", "name").agg(F.min(_place()).alias("place"))


def _makers(pairs: DataFrame, student: DataFrame) -> DataFrame:
    for key, column in (("roll", "roll_no"), ("name", "name")):
        held = _holders(student, column).select("institution_id", F.col("key").alias(key))
        pairs = pairs.join(held, ["institution_id", key], "left_anti")
    waiting = settle(pairs.select(*INST, "place", "roll", "name"))
    won = None
    while not waiting.isEmpty():
        seen = settle(_decided(settle(_firsts(waiting))))
        known = _composed(seen)
        if known is not None:
            seen = settle(seen.drop("wins").join(known, [*INST, "place"], "left"))
        winners = seen.where("wins").select(*INST, "place", "roll", "name")
        won = winners if won is None else won.unionByName(winners)
        waiting = settle(_unblocked(seen.where("wins IS NULL"), winners))
    return waiting if won is None else won


def _held_name() -> Column:
    """A row without a name names its student after the roll number."""
    return F.when(F.col("name") == "", F.col("roll")).otherwise(F.col("name"))


def _firsts(waiting: DataFrame) -> DataFrame:
    """Rows with the first claims on their roll and on the name they would hold, and whether they wait for neither.

    A row without a name is not stopped by a holder of the name it takes.
    """
    rows = waiting.withColumn("held", _held_name())
    rolls = rows.where("roll <> ''").groupBy(*INST, "roll").agg(F.min("place").alias("roll_place"))
    names = rows.groupBy(*INST, "held").agg(F.min("place").alias("name_place"))
    both = rows.join(rolls, [*INST, "roll"], "left").join(names, [*INST, "held"], "left")
    first_roll = (F.col("roll") == "") | (F.col("roll_place") == F.col("place"))
    first_name = (F.col("name") == "") | (F.col("name_place") == F.col("place"))
    return both.withColumns({"first_roll": first_roll, "first_name": first_name})


def _decided(firsts: DataFrame) -> DataFrame:
    """``wins`` where it is certain; else, in ``rival``, the one row that has to lose for this one to win."""
    place = F.col("place")

    def holders(key: str, first: str, free: str):
        # the first row that only this key can stop, and the second claim on the key
        sure, second = F.min(F.when(F.col(free), place)), F.min(F.when(place > F.col(first), place))
        return firsts.where(F.col(key) != "").groupBy(*INST, key).agg(sure.alias(f"{key}_sure"), second.alias(f"{key}_second"))

    rows = firsts.join(holders("roll", "roll_place", "first_name"), [*INST, "roll"], "left")
    rows = rows.join(holders("held", "name_place", "first_roll"), [*INST, "held"], "left")
    late = ((F.col("roll") != "") & (place > F.col("roll_sure"))) | ((F.col("name") != "") & (place > F.col("held_sure")))
    by_roll = ~F.col("first_roll") & F.col("first_name") & (place == F.col("roll_second"))
    by_name = F.col("first_roll") & ~F.col("first_name") & (place == F.col("held_second"))
    wins = F.when(F.col("first_roll") & F.col("first_name"), True).when(late, False)
    rival = F.when(by_roll, F.col("roll_place")).when(by_name, F.col("name_place"))
    return rows.select(*INST, "place", "roll", "name", wins.alias("wins"), rival.alias("rival"))


def _composed(seen: DataFrame) -> DataFrame | None:
    """(institution_id, place, wins) of the undecided rows and all they wait for; None if no row waits for a single one.

    A row is the negation of its rival. In each step every row takes over the rival of its
    rival, so the distance to a decided row halves. A key has one second row, so at
    most two rows wait for the same one.
    """
    waits = seen.where("wins IS NULL AND rival IS NOT NULL").select(*INST, "place", "wins", "rival", F.lit(True).alias("negated"))
    if waits.isEmpty():
        return None
    ends = seen.join(waits.select(*INST, F.col("rival").alias("place")), [*INST, "place"], "left_semi").where("wins IS NOT NULL OR rival IS NULL")
    links = settle(waits.unionByName(ends.select(*INST, "place", "wins", F.lit(None).cast(seen.schema["rival"].dataType).alias("rival"), F.lit(False).alias("negated"))))
    while not (waiting := links.where("rival IS NOT NULL")).isEmpty():
        ahead = links.select(
            *INST, F.col("place").alias("rival"), F.col("wins").alias("rival_wins"), F.col("rival").alias("next"), F.col("negated").alias("again")
        )
        moved = waiting.drop("wins").join(ahead, [*INST, "rival"], "left")
        moved = moved.select(*INST, "place", (F.col("rival_wins") != F.col("negated")).alias("wins"), F.col("next").alias("rival"), (F.col("negated") != F.col("again")).alias("negated"))
        links = settle(links.where("rival IS NULL").unionByName(moved))
    return seen.where("wins IS NOT NULL").select(*INST, "place", "wins").unionByName(
        links.where("wins IS NOT NULL").join(waits.select(*INST, "place"), [*INST, "place"], "left_semi").select(*INST, "place", "wins")
    )


def _unblocked(rest: DataFrame, winners: DataFrame) -> DataFrame:
    """Rows whose roll and name no winner before them holds."""
    rolls = winners.where("roll <> ''").groupBy(*INST, "roll").agg(F.min("place").alias("roll_place"))
    names = winners.groupBy(*INST, _held_name().alias("name")).agg(F.min("place").alias("name_place"))
    joined = rest.join(rolls, [*INST, "roll"], "left").join(names, [*INST, "name"], "left")
    blocked = F.coalesce(F.col("roll_place") < F.col("place"), F.lit(False)) | F.coalesce(F.col("name_place") < F.col("place"), F.lit(False))
    return joined.where(~blocked).select(*INST, "place", "roll", "name")


def make_ids(made: DataFrame, student: DataFrame) -> DataFrame:
    """Add ``student_id`` to the rows that make a student.

    The id is ``imp_`` and the roll number or name. Where that id is taken,
    a number follows that counts the collisions of the workbook in row order;
    a numbered id that is taken too uses up its number.

    Every round gives ids to all rows against the stored ones; rows before the first id that
    an earlier row of the institution has taken as well are final, and their ids are taken in
    the next round. So rounds count collisions between new ids, not those with stored ones.
    """
    base = F.concat(F.lit("imp_"), safe_name(F.when(F.col("roll") != "", F.col("roll")).otherwise(F.col("name"))))
    taken = student.select("institution_id", F.col("id").alias("student_id"))
    rest = settle(made.select(*INST, "place", "roll", "name", base.alias("base"), "place.workbook", "place.ord"))
    done = None
    while True:
        named = settle(_named(rest, taken, done))
        owner = named.groupBy(*INST, "student_id").agg(F.min("place").alias("owner_place"))
        late = named.join(owner, [*INST, "student_id"]).where("owner_place < place")
        late = settle(late.groupBy(*INST).agg(F.min("place").alias("from")))
        final = named.join(late, INST, "left").where("from IS NULL OR place < from").drop("from")
        done = final if done is None else done.unionByName(final)
        if late.isEmpty():
            return done.select(*BOOK, "ord", "roll", "name", "student_id")
        taken = settle(taken.unionByName(final.select(*INST, "student_id")))
        rest = settle(rest.join(late, INST).where("place >= from").drop("from"))


def _named(rest: DataFrame, taken: DataFrame, done: DataFrame | None) -> DataFrame:
    """Ids of ``rest`` that no id of ``taken`` equals, with their numbers; those of ``rest`` may still meet."""
    known = rest.join(taken.select(*INST, F.col("student_id").alias("base")), [*INST, "base"], "left_anti")
    first = known.groupBy(*INST, "base").agg(F.min("place").alias("first_place"))
    split = rest.join(first, [*INST, "base"], "left").withColumn("plain", F.coalesce(F.col("place") == F.col("first_place"), F.lit(False)))
    split = settle(split.drop("first_place"))
    plain = split.where("plain").withColumn("number", F.lit(None).cast("bigint")).withColumn("student_id", F.col("base"))
    rows = split.where("NOT plain")
    if done is not None:  # counting goes on where the final rows of the workbook ended
        used = done.groupBy(*BOOK).agg(F.max("number").alias("used"))
        rows = rows.join(used, BOOK, "left").withColumn("used", F.coalesce("used", F.lit(0)))
    else:
        rows = rows.withColumn("used", F.lit(0).cast("bigint"))
    numbered = _numbered(rows, taken).withColumn("student_id", F.concat_ws("_", "base", "number"))
    return plain.select(*numbered.columns).unionByName(numbered)


def _taken_runs(taken: DataFrame) -> DataFrame:
    """(institution_id, base, low, high, before): runs of taken numbers without a gap, and the taken numbers before each."""
    pattern = r"^(.*)_([1-9][0-9]{0,17})$"
    parts = taken.select(
        "institution_id",
        F.regexp_extract("student_id", pattern, 1).alias("base"),
        F.regexp_extract("student_id", pattern, 2).try_cast("bigint").alias("number"),
    )
    placed = number_rows(parts.where("number IS NOT NULL").distinct(), ["institution_id", "base"], "number", "n")
    island = placed.groupBy("institution_id", "base", (F.col("number") - F.col("n")).alias("island"))
    return island.agg(F.min("number").alias("low"), F.max("number").alias("high"), (F.min("n") - 1).alias("before")).drop("island")


def _numbered(rows: DataFrame, taken: DataFrame) -> DataFrame:
    """``number`` of each row: the least free for its base after the number of the row before in the workbook.

    Free numbers of a base are ranked by the runs of taken ones before them (rank: the number less
    the taken ones below; select: the rank and the taken ones whose free predecessors are fewer).
    Numbers start as the count of the rows, below the right ones. A step lifts each to a
    free number, spreads the ranks of a base (its rows have one each) and then the numbers of the
    workbook downwards; none ever passes the right one, and when nothing moves all are right. Rows
    of one base are right after one step, however the taken numbers lie.
    """
    kept = [*INST, "place", "roll", "name", "base", "workbook", "ord"]
    counted = running_total(rows, BOOK, "ord", "i").withColumn("number", F.col("i") + F.col("used"))
    bases = rows.select(*INST, "base").distinct()
    runs = settle(_taken_runs(taken.join(_bases_of(taken, bases), [*INST, "student_id"], "left_semi")))
    if runs.isEmpty():
        return counted.select(*kept, "number")
    state = settle(number_rows(counted, [*BOOK, "base"], "ord", "k"))
    while True:
        ranked = _after_runs(state, runs, "number", F.col("low"))
        rank = F.col("number") - F.coalesce(F.col("run.before") + F.least("run.high", F.col("number") - 1) - F.col("run.low") + 1, F.lit(0))
        ranked = ranked.withColumn("rank", rank).drop("run")
        ranked = running_max(ranked, [*BOOK, "base"], "ord", "lift", F.col("rank") - F.col("k"))
        ranked = ranked.withColumn("rank", F.col("lift") + F.col("k"))
        chosen = _after_runs(ranked, runs, "rank", F.col("low") - 1 - F.col("before"))
        number = F.col("rank") + F.coalesce(F.col("run.before") + F.col("run.high") - F.col("run.low") + 1, F.lit(0))
        chosen = chosen.withColumn("free", number).drop("run", "rank", "lift")
        lifted = running_max(chosen, BOOK, "ord", "lift", F.col("free") - F.col("i"))
        moved = settle(lifted.withColumn("next", F.col("lift") + F.col("i")))
        if moved.where("next <> number").isEmpty():
            return moved.select(*kept, "number")
        state = moved.drop("free", "lift", "number").withColumnRenamed("next", "number")


def _bases_of(taken: DataFrame, bases: DataFrame) -> DataFrame:
    """Taken ids that are a number of one of ``bases``."""
    own = taken.select(*INST, "student_id", F.regexp_extract("student_id", r"^(.*)_[1-9][0-9]{0,17}$", 1).alias("base"))
    return own.join(bases, [*INST, "base"], "left_semi").select(*INST, "student_id").distinct()


def _after_runs(rows: DataFrame, runs: DataFrame, at: str, start: Column) -> DataFrame:
    """Add ``run``: the last run of the base that starts before the row's ``at``."""
    keys = [*INST, "base"]
    run = runs.select(*keys, start.alias("_start"), F.lit(1).alias("_kind"), F.struct("low", "high", "before").alias("_run"))
    both = rows.select(*keys, F.col(at).alias("_start"), F.lit(0).alias("_kind"), F.struct(*rows.columns).alias("_row"))
    both = both.unionByName(run, allowMissingColumns=True)
    found = running_max(both, keys, "_start", "run", F.col("_run"), ties=("_kind",))
    return found.where("_kind = 0").select("_row.*", "run")


def resolve_students(rows: DataFrame, student: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdict on every row, and the students made.

    ``rows``: (institution_id, workbook, ord, roll, name), unique by ``ord``
    in a workbook, roll and name '' when missing. Workbooks of one institution
    follow each other in the order of their names. The first result adds
    ``student_id``, ``is_new`` and ``error``; the second is
    (institution_id, workbook, ord, student_id, name, roll_no).
    """
    judged, students = judge_students(settle(rows.select(*BOOK, "ord", "roll", "name")), student)
    return judged.select(*BOOK, "ord", "student_id", "is_new", "error"), students


def judge_students(rows: DataFrame, student: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``resolve_students``, but the verdict is added to the columns of ``rows``, which are read twice.

    Holders are looked up once for every roll with its name; rows meet what was found by one join.
    """
    pairs = settle(_pairs(rows))
    made = settle(make_ids(_makers(pairs, student), student))
    made_name = F.when(F.col("name") == "", F.col("roll")).otherwise(F.col("name"))
    one = F.struct(_place().alias("place"), F.col("student_id").alias("id"), made_name.alias("name"), F.col("roll").alias("roll_no"))
    made_roll = made.where("roll <> ''").select(*INST, "roll", one.alias("roll_made"))
    # a name has at most one student made under it and one named after a roll
    made_names = made.select(*INST, made_name.alias("name"), (F.col("name") == "").alias("after_roll"), one.alias("m"))
    made_by_name = made_names.groupBy(*INST, "name").agg(
        F.min(F.when(~F.col("after_roll"), F.col("m"))).alias("name_made"),
        F.min(F.when(F.col("after_roll"), F.col("m"))).alias("name_made_too"),
    )
    rolls = _holders(student, "roll_no").select(
        "institution_id", F.col("key").alias("roll"), F.col("n").alias("roll_n"), F.col("held").alias("roll_held")
    )
    names = _holders(student, "name").select(
        "institution_id", F.col("key").alias("name"), F.col("n").alias("name_n"), F.col("held").alias("name_held")
    )
    held = (
        pairs.drop("place")
        .join(rolls, ["institution_id", "roll"], "left")
        .join(made_roll, [*INST, "roll"], "left")
        .join(names, ["institution_id", "name"], "left")
        .join(made_by_name, [*INST, "name"], "left")
    )
    pair = [*INST, "roll", "name"]
    found = [c for c in held.columns if c not in pair]
    # A number that nearly tells the pair comes first, so that sorting seldom compares texts.
    number = F.xxhash64(*pair).alias("pair_no")
    same = reduce(Column.__and__, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in pair], F.col("l.pair_no") == F.col("r.pair_no"))
    known = rows.select("*", number).alias("l").join(held.select("*", number).alias("r"), same, "left").select("l.*", *[f"r.{c}" for c in found]).withColumn("place", _place())

    def before(made_column: str):
        # a made student is there for the rows after its own
        return F.when(F.col(made_column)["place"] < F.col("place"), F.col(made_column).dropFields("place"))

    def count(stored: str, *students):
        parts = [F.coalesce(F.col(stored), F.lit(0))] + [F.when(s.isNotNull(), 1).otherwise(0) for s in students]
        total = parts[0]
        for part in parts[1:]:
            total = total + part
        return total

    made_r, made_n, made_n2 = before("roll_made"), before("name_made"), before("name_made_too")
    seen = known.select(
        *rows.columns, "place",
        count("roll_n", made_r).alias("roll_count"),
        count("name_n", made_n, made_n2).alias("name_count"),
        F.coalesce("roll_held", made_r).alias("by_roll"),
        F.coalesce("name_held", made_n, made_n2).alias("by_name"),
        F.when(F.col("roll") != "", F.col("roll_made")["place"]).alias("roll_made_place"),
        F.col("name_made")["place"].alias("name_made_place"),
        F.coalesce(F.col("roll_made")["id"], F.col("name_made")["id"]).alias("made_id"),
    )
    by_roll, by_name, roll, name = (F.col(c) for c in ("by_roll", "by_name", "roll", "name"))
    quote = F.lit("'")

    def say(*parts):
        return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])

    error = (
        F.when(F.col("roll_count") > 1, say("roll number '", roll, "' matches multiple students"))
        .when(F.col("name_count") > 1, say("name '", name, "' matches multiple students"))
        .when(
            by_roll.isNotNull() & by_name.isNotNull() & (by_roll["id"] != by_name["id"]),
            say("roll '", roll, "' resolves to '", by_roll["name"], "' but name '", name, "' resolves to '", by_name["name"], quote),
        )
        .when(
            by_roll.isNotNull() & (name != "") & (by_roll["name"] != name),
            say("roll '", roll, "' belongs to '", by_roll["name"], "', not '", name, quote),
        )
        .when(
            by_name.isNotNull() & (roll != "") & (by_name["roll_no"] != roll),
            say("name '", name, "' has roll '", by_name["roll_no"], "', not '", roll, quote),
        )
    )
    own = F.coalesce(F.col("roll_made_place") == F.col("place"), F.lit(False)) | F.coalesce(
        F.col("name_made_place") == F.col("place"), F.lit(False)
    )
    judged = seen.select(
        *rows.columns, error.alias("error"), own.alias("is_new"),
        F.when(own, F.col("made_id")).otherwise(F.coalesce(by_roll["id"], by_name["id"])).alias("student_id"),
    )
    verdict = judged.select(
        *rows.columns, F.when(F.col("error").isNull(), F.col("student_id")).alias("student_id"),
        (F.col("is_new") & F.col("error").isNull()).alias("is_new"), "error",
    )
    students = made.select(*BOOK, "ord", "student_id", made_name.alias("name"), F.col("roll").alias("roll_no"))
    return verdict, students
