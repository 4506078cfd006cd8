"""Change feeds, by hand-made rows and by the properties every fold must have."""

import datetime as dt
import hashlib
import random

import pytest
from conftest import tuples
from pyspark.sql import functions as F

from rollbook.operators.folds import (
    new_uid,
    rename_verdicts,
    upsert_classes,
    upsert_courses,
    upsert_scores,
    upsert_students,
)
from rollbook.operators.writes import affected_counts, patch_update, soft_delete, upsert_explicit
from rollbook.sources.sinks import append_rows

STATE = {
    "score": "course_uid string, student_uid string, score double, status int, created timestamp, updated timestamp",
    "class": "class_uid string, class_name string, status int, created timestamp, updated timestamp",
    "student": "student_uid string, student_name string, username string, age int, class_uid string, "
    "status int, created timestamp, updated timestamp",
    "course": "course_uid string, course_name string, teacher_uid string, class_uid string, status int, "
    "created timestamp, updated timestamp",
}
FEED = {
    "score": "course_uid string, student_uid string, score double",
    "class": "class_uid string, class_name string",
    "student": "student_uid string, student_name string, username string, age int, class_uid string",
    "course": "course_uid string, teacher_uid string, class_uid string, course_name string",
}
T0 = dt.datetime(2024, 1, 1)


def at(n):
    return T0 + dt.timedelta(hours=n)


def state(spark, record, *rows):
    return spark.createDataFrame([(*r, T0, None) for r in rows], STATE[record])


def feed(spark, record, *events):
    """Events ``(op, field, ..)``; their number gives time and id."""
    rows = [(i, at(i), *e) for i, e in enumerate(events, 1)]
    return spark.createDataFrame(rows, f"event_id bigint, ts timestamp, op string, {FEED[record]}")


def reasons(fold):
    return [(r.event_id, r.reason) for r in fold.rejected.orderBy("event_id").collect()]


def uid(spark, event_id, name):
    row = spark.createDataFrame([(event_id, name)], "event_id bigint, name string")
    return row.select(new_uid("name")).first()[0]


def test_scores(spark):
    rows = state(spark, "score", ("c", "s", 50.0, 1), ("c", "off", 40.0, 0), ("c", "back", 30.0, 0))
    events = feed(
        spark, "score",
        ("patch", "c", "off", 41.0),  # a deleted score changes but stays deleted
        ("create", "c", "back", 31.0),  # recording again makes it live
        ("patch", "c", "new", 1.0),  # nothing there yet
        ("create", "c", "new", 2.0),
        ("patch", "c", "new", 3.0),
        ("patch", "c", "s", None),  # no value: left as it is
        ("create", "c", "once", 4.0),
        ("erase", "c", "s", 0.0),
    )
    fold = upsert_scores(rows, events)
    assert tuples(fold.table, "student_uid", "score", "status", "created", "updated") == [
        ("back", 31.0, 1, T0, at(2)),
        ("new", 3.0, 1, at(4), at(5)),
        ("off", 41.0, 0, T0, at(1)),
        ("once", 4.0, 1, at(7), None),
        ("s", 50.0, 1, T0, at(6)),
    ]
    assert reasons(fold) == [(3, "no_match"), (8, "unknown_op")]
    assert fold.changed.count() == 5


def test_late_score_is_skipped(spark):
    first = feed(spark, "score", ("create", "c", "s", 1.0), ("patch", "c", "s", 2.0))
    table = upsert_scores(state(spark, "score"), first).table
    older = upsert_scores(table, first.where("event_id = 1"))
    assert tuples(older.table) == tuples(table)
    assert reasons(older) == [(1, "late")]
    assert older.changed.count() == 0


def test_classes(spark):
    rows = state(spark, "class", ("1", "A", 1), ("2", "B", 0), ("3", "C", 1))
    events = feed(
        spark, "class",
        ("create", None, "B"),  # brings class 2 back, without a stamp
        ("create", None, "D"),  # new
        ("rename", "1", "B"),  # taken, even though B was deleted
        ("rename", "1", "A"),  # its own name: no change
        ("rename", "1", ""),  # no name: no change
        ("rename", "3", "E"),
        ("rename", "1", "E"),  # the first to ask had it
        ("delete", "9", None),
        ("create", None, ""),
        ("create", None, "D"),  # exists by now
    )
    fold = upsert_classes(rows, events)
    assert tuples(fold.table, "class_name", "class_uid", "status", "updated") == [
        ("A", "1", 1, None),
        ("B", "2", 1, None),
        ("D", uid(spark, 2, "D"), 1, None),
        ("E", "3", 1, at(6)),
    ]
    assert reasons(fold) == [(3, "name_taken"), (7, "name_taken"), (8, "no_match"), (9, "no_name")]


def test_class_renamed_away_and_back(spark):
    rows = state(spark, "class", ("1", "A", 1))
    fold = upsert_classes(rows, feed(spark, "class", ("rename", "1", "B"), ("rename", "1", "A")))
    assert tuples(fold.table, "class_name", "updated") == [("A", at(2))]


def test_rename_verdicts(spark):
    rows = state(spark, "class", ("1", "A", 1), ("2", "B", 0), ("3", "C", 1))
    events = feed(
        spark, "class",
        ("", "1", "B"), ("", "1", "A"), ("", "1", ""), ("", "3", "E"), ("", "1", "E"), ("", "9", "F"),
    )
    got = rename_verdicts(rows, events.drop("op"))
    assert [v for _, v in tuples(got, "event_id", "verdict")] == [
        "taken", "noop", "noop", "ok", "taken", "no_match"
    ]


def test_students(spark):
    rows = state(
        spark, "student",
        ("1", "Ann", "ann", 10, "c", 1),
        ("2", "Bob", "bob", 11, "c", 0),
        ("3", "Cid", "cid", None, "c", 1),
    )
    events = feed(
        spark, "student",
        ("create", None, "Bobby", "bob", None, "c"),  # the name of a deleted student
        ("create", None, "Dan", "", None, "c"),  # username falls back to the name
        ("create", None, "Dan", "Dan", 9, "c"),  # taken in this batch
        ("patch", "1", "", "cid", 12, None),  # another student's name: refused as a whole
        ("patch", "1", "Anna", None, 0, ""),  # age 0 counts, empty class does not
        ("patch", "3", None, "", None, ""),  # nothing sent: no stamp
        ("delete", "3", None, None, None, None),
        ("create", None, "Cid", "cid", None, "c"),  # deleted, but the name stays taken
        ("patch", "9", "X", None, None, None),
        ("create", None, None, "zoe", None, "c"),
    )
    fold = upsert_students(rows, events)
    columns = ["username", "student_name", "age", "class_uid", "status", "updated"]
    assert tuples(fold.table, *columns) == [
        ("Dan", "Dan", None, "c", 1, None),
        ("ann", "Anna", 0, "c", 1, at(5)),
        ("bob", "Bob", 11, "c", 0, None),
        ("cid", "Cid", None, "c", 0, at(7)),
    ]
    assert reasons(fold) == [
        (1, "name_taken"), (3, "name_taken"), (4, "name_taken"), (8, "name_taken"), (9, "no_match"),
        (10, "no_name"),
    ]


def test_student_names_within_a_batch(spark):
    rows = state(spark, "student", ("1", "Ann", "ann", 1, "c", 1), ("2", "Bob", "bob", 1, "c", 1))
    born = uid(spark, 4, "eve")
    events = feed(
        spark, "student",
        ("patch", "2", "", "new", None, None),  # first to ask for "new"
        ("patch", "1", "", "new", None, None),
        ("create", None, "New", "new", None, "c"),
        ("create", None, "Eve", "eve", None, "c"),
        ("patch", born, "Eva", None, 5, None),  # born in this batch: fields may change
        ("patch", born, None, "adam", None, None),  # and so may its name
    )
    fold = upsert_students(rows, events)
    assert tuples(fold.table, "username", "student_name", "age") == [
        ("adam", "Eva", 5), ("ann", "Ann", 1), ("new", "Bob", 1)
    ]
    assert reasons(fold) == [(2, "name_taken"), (3, "name_taken")]


MOVES = [
    # record, rows, events, (name, status) of all rows after them
    ("class", [("x", "N1", 1)], [("rename", "x", "N2"), ("delete", "x", None), ("create", None, "N1")], [("N1", 1), ("N2", 0)]),
    ("class", [("x", "N1", 1), ("y", "N3", 1)], [("rename", "x", "N2"), ("rename", "y", "N1")], [("N1", 1), ("N2", 1)]),
    ("course", [("x", "A", "t", "c", 1)], [("patch", "x", "t", None, "B"), ("create", None, "t", "c", "A")], [("A", 1), ("B", 1)]),
    ("course", [("x", "A", "t", "c", 1)], [("patch", "x", "t", "d", None), ("create", None, "t", "d", "A"), ("create", None, "t", "c", "A")], [("A", 1), ("A", 1)]),
    ("student", [("x", "X", "u1", 1, "c", 1)], [("patch", "x", None, "u2", None, None), ("create", None, "Y", "u1", None, "c")], [("u1", 1), ("u2", 1)]),
    ("student", [], [("create", None, "E", "u5", None, "c"), ("patch", "born", None, "u6", None, None)], [("u6", 1)]),
]


@pytest.mark.parametrize("case", range(len(MOVES)))
def test_names_move_within_a_batch(spark, case):
    record, rows, events, want = MOVES[case]
    name = {"class": "class_name", "course": "course_name", "student": "username"}[record]
    born = hashlib.md5(b"1:u5").hexdigest()
    events = [tuple(born if v == "born" else v for v in e) for e in events]
    fold = FOLDS[record](state(spark, record, *rows), feed(spark, record, *events))
    assert sorted(tuples(fold.table, name, "status")) == want
    assert reasons(fold) == []


def test_courses(spark):
    rows = state(
        spark, "course",
        ("1", "Maths", "t", "c", 1),
        ("2", "Art", "t", "c", 0),
        ("3", "Music", "t", "c", 1),
        ("4", "Latin", "t", "c", 1),
    )
    events = feed(
        spark, "course",
        ("create", None, "t", "c", "Maths"),  # live: nothing happens
        ("create", None, "t", "c", "Art"),  # deleted: back, with a stamp
        ("create", None, "t", "c", "Art"),  # live by now: no further stamp
        ("create", None, "t", "d", "Art"),  # another class: a new course
        ("patch", "3", "other", None, "Stolen"),  # not the owner
        ("patch", "3", "t", "", ""),  # an empty patch still stamps
        ("patch", "4", "t", "d", "Greek"),
        ("delete", "4", "t", None, None),
        ("create", None, "t", "c", None),
        ("delete", "9", "t", None, None),
    )
    fold = upsert_courses(rows, events)
    assert tuples(fold.table, "course_name", "class_uid", "status", "created", "updated") == [
        ("Art", "c", 1, T0, at(2)),
        ("Art", "d", 1, at(4), None),
        ("Greek", "d", 0, T0, at(8)),
        ("Maths", "c", 1, T0, None),
        ("Music", "c", 1, T0, at(6)),
    ]
    assert reasons(fold) == [(5, "no_match"), (9, "no_name"), (10, "no_match")]


def test_create_patch_delete_create(spark):
    events = feed(
        spark, "course",
        ("create", None, "t", "c", "Art"),
        ("delete", "x", "t", None, None),
        ("create", None, "t", "c", "Art"),
        ("create", None, "t", "c", "Art"),
    )
    born = uid(spark, 1, "Art")
    events = events.withColumn("course_uid", F.when(F.col("op") == "delete", born))
    fold = upsert_courses(state(spark, "course"), events)
    assert tuples(fold.table, "course_uid", "status", "created", "updated") == [(born, 1, at(1), at(3))]


# --- properties ---------------------------------------------------------------------------------

FOLDS = {
    "score": upsert_scores, "class": upsert_classes, "student": upsert_students, "course": upsert_courses
}


def random_case(record, seed, moves=True):
    """A state and a feed whose names move between rows, those of rows born in the feed included."""
    rows, events = _random_case(record, seed)
    still = {"score": lambda e: e, "class": lambda e: e if e[0] != "rename" else ("delete", e[1], None),
             "student": lambda e: e if e[0] != "patch" else (*e[:3], None, *e[4:]), "course": lambda e: e if e[0] != "patch" else (*e[:3], "", "")}[record]
    return rows, events if moves else [still(e) for e in events]


def _random_case(record, seed):
    r = random.Random(seed)
    born = lambda i, name: hashlib.md5(f"{i}:{name}".encode()).hexdigest()
    if record == "score":
        rows = [("c", f"s{i}", float(i), r.randrange(2)) for i in range(4)]
        events = [
            (r.choice(["create", "patch"]), "c", f"s{r.randrange(9)}", r.choice([None, float(i)]))
            for i in range(60)
        ]
    elif record == "class":
        rows = [(f"{i}", f"N{i}", r.randrange(2)) for i in range(4)]
        events = []
        for i in range(1, 61):
            some = r.choice([f"{r.randrange(6)}", *[born(j, e[2]) for j, e in enumerate(events, 1) if e[0] == "create"][:3]])
            events.append(r.choice([
                ("create", None, f"N{r.randrange(8)}"), ("delete", some, None), ("rename", some, r.choice(["", f"N{r.randrange(8)}", f"N{r.randrange(8)}"])),
            ]))
    elif record == "student":
        rows = [(f"{i}", f"N{i}", f"n{i}", i, "c", r.randrange(2)) for i in range(4)]
        events = []
        for i in range(1, 61):
            some = r.choice([f"{r.randrange(6)}", *[born(j, e[3]) for j, e in enumerate(events, 1) if e[0] == "create"][:3]])
            events.append(r.choice([
                ("create", None, f"M{i}", f"n{r.randrange(9)}", r.choice([None, i]), "c"),
                ("patch", some, r.choice(["", f"P{i}"]), r.choice([None, "", f"n{r.randrange(9)}"]), r.choice([None, i]), ""),
                ("delete", some, None, None, None, None),
            ]))
    else:
        rows = [(f"{i}", f"N{i}", "t", "c", r.randrange(2)) for i in range(4)]
        events = []
        for i in range(1, 61):
            some = r.choice([f"{r.randrange(6)}", *[born(j, e[4]) for j, e in enumerate(events, 1) if e[0] == "create"][:3]])
            events.append(r.choice([
                ("create", None, "t", r.choice("cd"), f"N{r.randrange(6)}"),
                ("delete", some, r.choice(["t", "t", "u"]), None, None),
                ("patch", some, r.choice(["t", "t", "u"]), r.choice(["", "c", "d"]), r.choice(["", f"N{r.randrange(6)}"])),
            ]))
    return rows, events


@pytest.mark.parametrize("record", FOLDS)
def test_one_batch_equals_several(spark, record):
    fold = FOLDS[record]
    rows, events = random_case(record, seed=3)
    start, changes = state(spark, record, *rows), feed(spark, record, *events)
    whole = fold(start, changes).table
    cut = start
    for low, high in ((0, 15), (15, 17), (17, 100)):
        part = changes.where((F.col("event_id") > low) & (F.col("event_id") <= high))
        kept = fold(cut, part).table
        # keep plans short: each batch starts from plain rows, as it does from a written table
        cut = spark.createDataFrame(kept.collect(), kept.schema)
    assert tuples(cut) == tuples(whole)


@pytest.mark.parametrize("record", FOLDS)
def test_replay_changes_nothing(spark, record):
    """As long as names stay: a repeated create may else claim a name that its row has given up since."""
    fold = FOLDS[record]
    rows, events = random_case(record, seed=3, moves=False)
    changes = feed(spark, record, *events)
    once = fold(state(spark, record, *rows), changes).table
    once = spark.createDataFrame(once.collect(), once.schema)
    assert tuples(fold(once, changes).table) == tuples(once)


def played(record, rows, events):
    """Request by request: ``{uid: [name, status, ..]}`` and the refused events."""
    first = {"class": lambda r: [r[1], r[2]], "student": lambda r: [r[2], r[5]], "course": lambda r: [(r[2], r[3], r[1]), r[4]]}
    table = {r[0]: first[record](r) for r in rows}
    refused = []
    for i, (op, uid, *fields) in enumerate(events, 1):
        if record == "class":
            name = fields[0]
            holders = [u for u, (n, _) in table.items() if n == name]
            known = uid in table
        elif record == "student":
            name = fields[1]
            holders = [u for u, (n, _) in table.items() if n == name]
            known = uid in table
        else:
            teacher, klass, title = fields
            name = (teacher, klass, title)
            holders = [u for _, u in sorted((v[1] != 1, u) for u, v in table.items() if v[0] == name)]
            known = uid in table and table[uid][0][0] == teacher
        text = name[2] if record == "course" else name
        if op == "create":
            if not holders:
                table[hashlib.md5(f"{i}:{text}".encode()).hexdigest()] = [name, 1]
            elif record == "student":
                refused.append(i)
            else:
                table[holders[0]][1] = 1
        elif op == "delete":
            if known:
                table[uid][1] = 0
            else:
                refused.append(i)
        elif record == "course":
            if known:
                old = table[uid][0]
                table[uid][0] = (old[0], klass or old[1], title or old[2])
            else:
                refused.append(i)
        elif not name:
            if record == "student" and (fields[0] or fields[2] is not None) and not known:
                refused.append(i)
        elif not known or [u for u in holders if u != uid]:
            refused.append(i)
        else:
            table[uid][0] = name
    return table, refused


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("record", ["class", "student", "course"])
def test_feed_equals_request_by_request(spark, record, seed):
    rows, events = random_case(record, seed)
    fold = FOLDS[record](state(spark, record, *rows), feed(spark, record, *events))
    table, refused = played(record, rows, events)
    name = {"class": ["class_name"], "student": ["username"], "course": ["teacher_uid", "class_uid", "course_name"]}[record]
    got = {r[0]: [r[1] if len(name) == 1 else tuple(r[1:-1]), r[-1]] for r in fold.table.select(f"{record}_uid", *name, "status").collect()}
    assert got == table
    assert [i for i, _ in reasons(fold)] == refused


@pytest.mark.parametrize("rounds", [40, 2])
@pytest.mark.parametrize("record", ["class", "student", "course"])
def test_names_by_rounds_and_slices(spark, monkeypatch, record, rounds):
    """Settled by rounds of joins, and played through in slices where those are too few, the outcomes are those of one pass."""
    from rollbook.operators import names

    rows, events = random_case(record, 4)
    start, changes = state(spark, record, *rows), feed(spark, record, *events)
    whole = FOLDS[record](start, changes)
    table, rejected = tuples(whole.table), tuples(whole.rejected)
    monkeypatch.setattr(names, "SLICE_RECORDS", 25)
    monkeypatch.setattr(names, "ROUNDS", rounds)
    cut = FOLDS[record](start, changes)
    assert tuples(cut.table) == table and tuples(cut.rejected) == rejected


@pytest.mark.parametrize("seed", [4, 6])
def test_shared_names_by_lines(spark, monkeypatch, seed):
    """Large feeds of courses are settled side by side by row and by name; nothing is left to slices that wait for each other."""
    from rollbook.operators import names

    rows, events = random_case("course", seed)
    start, changes = state(spark, "course", *rows), feed(spark, "course", *events)
    whole = upsert_courses(start, changes)
    table, rejected = tuples(whole.table), tuples(whole.rejected)
    monkeypatch.setattr(names, "SLICE_RECORDS", 10)
    monkeypatch.setattr(names, "_in_slices", None)
    cut = upsert_courses(start, changes)
    assert tuples(cut.table) == table and tuples(cut.rejected) == rejected


def test_a_create_goes_to_the_course_that_is_live_then(spark, monkeypatch):
    """Also in a large feed without any move."""
    from rollbook.operators import names

    monkeypatch.setattr(names, "SLICE_RECORDS", 1)
    start = state(spark, "course", ("1", "Art", "t", "c", 1), ("2", "Art", "t", "c", 1))
    changes = feed(spark, "course", ("delete", "1", "t", None, None), ("create", None, "t", "c", "Art"))
    assert tuples(upsert_courses(start, changes).table, "course_uid", "status") == [("1", 0), ("2", 1)]


def test_a_chain_of_renames_by_rounds(spark, monkeypatch):
    """Every row takes the name that the next one has just given up; nothing is gathered and few rounds settle it."""
    from rollbook.operators import names

    n = 60
    rows = [(f"{i:03d}", f"N{i:03d}", 1) for i in range(n)]
    events = [("rename", f"{i:03d}", f"N{i + 1:03d}") for i in reversed(range(n))]
    start, changes = state(spark, "class", *rows), feed(spark, "class", *events)
    monkeypatch.setattr(names, "SLICE_RECORDS", 10)
    monkeypatch.setattr(names, "_in_slices", None)
    got = {r["class_uid"]: r["class_name"] for r in FOLDS["class"](start, changes).table.collect()}
    assert got == {f"{i:03d}": f"N{i + 1:03d}" for i in range(n)}


def test_rounds_end_once_they_settle_too_little(spark, monkeypatch):
    """Two rows ask for each other's name again and again: a round settles one event, so the rest is played through."""
    from rollbook.operators import names, tables

    written = []
    monkeypatch.setattr(names, "kept", lambda df, name: written.append(name) or tables.kept(df, name))
    monkeypatch.setattr(names, "SLICE_RECORDS", 10)
    start = state(spark, "class", ("a", "X", 1), ("b", "Y", 1))
    changes = feed(spark, "class", *[("rename", "b", "X") if i % 2 else ("rename", "a", "Y") for i in range(30)])
    fold = FOLDS["class"](start, changes)
    assert {r["class_uid"]: r["class_name"] for r in fold.table.collect()} == {"a": "X", "b": "Y"}
    assert [why for _, why in reasons(fold)] == ["name_taken"] * 30
    assert written.count("round") <= 3


@pytest.mark.parametrize("record", FOLDS)
def test_order_of_rows_does_not_matter(spark, record):
    fold = FOLDS[record]
    rows, events = random_case(record, seed=5)
    start, changes = state(spark, record, *rows), feed(spark, record, *events)
    shuffled = changes.orderBy(F.xxhash64("event_id")).repartition(5)
    a, b = fold(start, changes), fold(start, shuffled)
    assert tuples(a.table) == tuples(b.table)
    assert tuples(a.rejected) == tuples(b.rejected)


@pytest.mark.parametrize("record", FOLDS)
def test_repeated_events_in_one_batch(spark, record):
    fold = FOLDS[record]
    rows, events = random_case(record, seed=9)
    start, changes = state(spark, record, *rows), feed(spark, record, *events)
    once, twice = fold(start, changes), fold(start, changes.union(changes))
    assert tuples(twice.table) == tuples(once.table)
    assert tuples(twice.rejected.distinct()) == tuples(once.rejected)
    assert twice.rejected.count() == 2 * once.rejected.count()


# --- writes without rules of their own ------------------------------------------------------------


def test_upsert_explicit(spark):
    table = spark.createDataFrame([("a", 1, None), ("b", 2, None)], "k string, v int, updated timestamp")
    rows = spark.createDataFrame(
        [("a", 5, at(1)), ("c", 6, at(2)), ("d", 7, at(3)), ("d", 8, at(4))], "k string, v int, ts timestamp"
    )
    got = upsert_explicit(table, rows, ["k"], {"v": 99, "updated": "now()"}, ["ts"])
    assert tuples(got) == [("a", 99, at(1)), ("b", 2, None), ("c", 6, None), ("d", 99, at(4))]


def test_patch_update(spark):
    table = spark.createDataFrame([(1, 1), (None, 2), (3, 3)], "a int, b int")
    got = patch_update(table, F.col("a") > 1, {"a": F.col("b") * 10, "b": F.col("a")})
    assert tuples(got, "b", "a") == [(1, 1), (2, None), (3, 30)]
    assert tuples(patch_update(table, F.lit(True), {})) == tuples(table)


def test_affected_and_soft_delete(spark):
    table = spark.createDataFrame([("a", 1, None), ("b", 1, None)], "k string, status int, updated timestamp")
    asked = spark.createDataFrame([("a", at(1)), ("a", at(2)), ("z", at(3))], "k string, ts timestamp")
    counted = affected_counts(asked, table, ["k"])
    assert tuples(counted, "k", "affected", "accepted") == [("a", 1, True), ("a", 1, True), ("z", 0, False)]
    kept, missed = soft_delete(table, asked, ["k"])
    assert tuples(kept) == [("a", 0, at(2)), ("b", 1, None)]
    assert tuples(missed) == [("z", at(3), "no_match")]


def test_append_by_name(spark):
    table = spark.createDataFrame([(1, "x")], "a int, b string")
    got = append_rows(table, spark.createDataFrame([("y", 2)], "b string, a int"),
                      spark.createDataFrame([(3,)], "a int"))
    assert tuples(got) == [(1, "x"), (2, "y"), (3, None)]
    with pytest.raises(ValueError):
        append_rows(table, spark.createDataFrame([(1,)], "z int"))
