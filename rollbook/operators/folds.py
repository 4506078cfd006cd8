"""Folding a feed of changes into a record table.

A feed has ``event_id``, ``ts``, ``op``, the key columns and the field columns. Within a key, events
apply in ``(ts, event_id)`` order. The state keeps the position of the last event applied to each row
in ``applied_ts`` and ``applied_id``; events at or before it are late and change nothing.

Every fold is one aggregate per key (latest value per column, first create, latest stamp, ..) joined
once with the state, so a key with very many events shrinks to one row before the shuffle.

Names that must be unique are settled event by event (see ``names``), so a feed gives the same rows
however it is cut into batches: a name that a row gave up can be taken at once, and a row can be renamed as soon as
it is born.
"""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollbook.operators.joins import left_join
from rollbook.operators.names import settle
from rollbook.operators.tables import kept

APPLIED = ["applied_ts", "applied_id"]


class Fold(NamedTuple):
    table: DataFrame  # all rows after the feed
    changed: DataFrame  # only the rows the feed reached
    rejected: DataFrame  # event_id, ts, op, reason


def _at() -> Column:
    return F.struct(F.col("ts"), F.col("event_id"))


def _here() -> Column:
    return F.struct(F.col("applied_ts").alias("ts"), F.col("applied_id").alias("event_id"))


def _pos(column: str) -> Column:
    return F.struct(F.col(f"{column}.ts").alias("ts"), F.col(f"{column}.event_id").alias("event_id"))


def _true(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _given(name: str) -> Column:
    """A text or key field that is neither missing nor empty."""
    return _true(F.col(name).cast("string") != "")


def new_uid(name: str) -> Column:
    """Uid of a row created by an event: the same on a retry, and not tied to the name alone."""
    return F.md5(F.concat_ws(":", F.col("event_id").cast("string"), F.col(name).cast("string")))


def with_position(state: DataFrame, feed: DataFrame) -> DataFrame:
    """The state with its position columns; a table that never took a feed has none yet."""
    for column, source in zip(APPLIED, ["ts", "event_id"]):
        if column not in state.columns:
            kind = feed.schema[source].dataType
            state = state.withColumn(column, F.lit(None).cast(kind))
    return state


def _join_state(
    state: DataFrame,
    events: DataFrame,
    keys: Sequence[str],
    sets: Mapping[str, Column],
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Aggregate the events per key and put them next to the state row.

    ``events`` carry ``_birth`` (creates the row), ``_status`` (new status or NULL) and ``_stamp``
    (moves ``updated``); ``sets`` tells which events set a column.
    """
    at = _at()
    folded = events.groupBy(*keys).agg(
        F.min(F.when(F.col("_birth"), at)).alias("_born"),
        F.max(at).alias("_last"),
        F.max(F.when(F.col("_stamp"), at)).alias("_stamped"),
        F.max(
            F.when(F.col("_status").isNotNull(), F.struct("ts", "event_id", "_status"))
        ).alias("_status"),
        *[
            F.max(F.when(test, F.struct("ts", "event_id", F.col(c).alias("value")))).alias(f"_set_{c}")
            for c, test in sets.items()
        ],
        *[agg.alias(name) for name, agg in (extra or {}).items()],
    )
    joined = state.withColumn("_known", F.lit(True)).join(folded, list(keys), "full_outer")
    return (
        joined.withColumn("_known", F.coalesce("_known", F.lit(False)))
        .where(F.col("_known") | F.col("_born").isNotNull())
        .withColumn("_base", F.when(F.col("_known"), _here()).otherwise(F.col("_born")))
    )


def _next_state(
    joined: DataFrame, columns: Sequence[str], sets: Sequence[str], stamped: Column | None = None
) -> DataFrame:
    """The rows after the feed, with ``_touched``; ``stamped`` overrides the position of the stamp."""
    known, base = F.col("_known"), F.col("_base")
    stamped = F.col("_stamped") if stamped is None else stamped

    def applies(column: str) -> Column:
        return _true(F.when(known, _pos(column) > base).otherwise(_pos(column) >= base))

    fresh = _true(F.col("_last") > base)
    rules = {
        c: F.when(applies(f"_set_{c}"), F.col(f"_set_{c}.value")).otherwise(F.col(c)) for c in sets
    }
    rules["status"] = (
        F.when(applies("_status"), F.col("_status._status"))
        .when(known, F.col("status"))
        .otherwise(1)
        .cast("int")
    )
    rules["created"] = F.when(known, F.col("created")).otherwise(
        F.col("_born.ts").cast(joined.schema["created"].dataType)
    )
    rules["updated"] = F.when(
        _true(stamped > base), stamped["ts"].cast(joined.schema["updated"].dataType)
    ).otherwise(F.col("updated"))
    for column, part in zip(APPLIED, ["ts", "event_id"]):
        rules[column] = F.when(fresh, F.col(f"_last.{part}")).otherwise(base[part])
    touched = fresh | ~known
    return joined.select(
        *[rules.get(c, F.col(c)).alias(c) for c in columns], touched.alias("_touched")
    )


def _result(rows: DataFrame, rejected: DataFrame) -> Fold:
    return Fold(
        rows.drop("_touched"),
        rows.where("_touched").drop("_touched"),
        rejected.where(F.col("reason").isNotNull()).select("event_id", "ts", "op", "reason"),
    )


def _known_targets(events: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Events with ``_known`` (``_uid`` is in the state) and ``_late`` against that row's position."""
    targets = state.select(F.col(key).alias("_uid"), F.lit(True).alias("_known"), _here().alias("_here"))
    found = left_join(events, targets, ["_uid"])
    known = F.coalesce("_known", F.lit(False))
    # a create whose own uid is in the state has been applied before
    late = known & ((F.col("op") == "create") | (_at() <= F.col("_here")))
    return found.withColumn("_late", _true(late)).withColumn("_known", known).drop("_here")


def _missing(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_absent``: the target row is neither in the state nor born earlier in the batch."""
    births = events.where("_birth").groupBy(*keys).agg(F.min(_at()).alias("_birth_at"))
    found = left_join(events, births, keys)
    unborn = _true(F.col("_birth_at").isNull() | (_at() < F.col("_birth_at")))
    return found.withColumn("_absent", ~F.col("_known") & ~F.col("_birth") & unborn)


def upsert_scores(state: DataFrame, feed: DataFrame) -> Fold:
    """``create`` inserts or overwrites and makes live; ``patch`` overwrites what is there."""
    keys = ["course_uid", "student_uid"]
    state = with_position(state, feed)
    create = F.col("op") == "create"
    events = feed.where(F.col("op").isin("create", "patch")).select(
        "event_id",
        "ts",
        *keys,
        "score",
        create.alias("_birth"),
        F.when(create, 1).alias("_status"),
        F.lit(True).alias("_stamp"),
        (create | F.col("score").isNotNull()).alias("_scored"),
    )
    joined = _join_state(state, events, keys, {"score": F.col("_scored")})
    rows = _next_state(joined, state.columns, ["score"])

    targets = joined.select(*keys, "_known", "_base")
    before = F.when(F.col("_known"), _at() <= F.col("_base"))
    rejected = left_join(feed, targets, keys).withColumn(
        "reason",
        F.when(~_true(F.col("op").isin("create", "patch")), "unknown_op")
        .when(before, "late")
        .when(
            (F.col("op") == "patch")
            & (F.col("_known").isNull() | (~F.col("_known") & (_at() < F.col("_base")))),
            "no_match",
        ),
    )
    return _result(rows, rejected)


def upsert_classes(state: DataFrame, feed: DataFrame) -> Fold:
    """``create`` by name (brings a deleted class back), ``rename`` and ``delete`` by uid."""
    state = with_position(state, feed)
    op, named = F.col("op"), _given("class_name")
    events = feed.select("event_id", "ts", "op", "class_uid", "class_name").withColumn(
        "_uid", F.when(op == "create", new_uid("class_name")).otherwise(F.col("class_uid"))
    )
    events = _known_targets(events, state, "class_uid")
    fresh = named & ~F.col("_late")
    events = settle(events, state, "class_uid", ["class_name"], fresh & (op == "create"), fresh & (op == "rename"))
    outcome = F.col("_outcome")
    events = events.withColumns(
        {
            "_birth": _true((op == "create") & (outcome == "born")) & ~F.col("_known"),
            "_renamed": _true((op == "rename") & outcome.isin("moved", "same")),
            "_status": F.when((op == "create") & named, 1).when(op == "delete", 0),
            "class_uid": F.when(op == "create", F.col("_holder")).otherwise(F.col("class_uid")),
        }
    ).withColumn("_stamp", (op == "delete") | _true(outcome == "moved"))
    events = kept(_missing(events, ["class_uid"]), "judged")
    applied = events.where(
        ~F.col("_late") & ((op == "delete") | F.col("_renamed") | ((op == "create") & named))
    )
    sets = {"class_name": F.col("_birth") | F.col("_renamed")}
    joined = _join_state(state, applied, ["class_uid"], sets)
    rows = _next_state(joined, state.columns, list(sets))

    rejected = events.withColumn(
        "reason",
        F.when(~_true(op.isin("create", "rename", "delete")), "unknown_op")
        .when((op == "create") & ~named, "no_name")
        .when(F.col("_late"), "late")
        .when((op == "rename") & ~named, None)
        .when((op == "delete") & F.col("_absent"), "no_match")
        .when((op == "rename") & (outcome == "absent"), "no_match")
        .when((op == "rename") & (outcome == "taken"), "name_taken"),
    )
    return _result(rows, rejected)


def rename_verdicts(classes: DataFrame, renames: DataFrame) -> DataFrame:
    """What each rename of a feed comes to: ``ok``, ``noop``, ``taken`` or ``no_match``.

    ``renames`` has ``event_id``, ``ts``, ``class_uid`` and ``class_name``.
    """
    state = with_position(classes, renames)
    events = renames.withColumn("op", F.lit("rename")).withColumn("_uid", F.col("class_uid"))
    events = _known_targets(events, state, "class_uid")
    named = _given("class_name")
    events = settle(events, state, "class_uid", ["class_name"], F.lit(False), named, refuses_first=True)
    outcome = F.col("_outcome")
    verdict = (
        F.when(~named | (outcome == "same"), "noop")
        .when(outcome == "taken", "taken")
        .when(outcome == "absent", "no_match")
        .otherwise("ok")
    )
    return events.select(*renames.columns, verdict.alias("verdict"))


def upsert_students(state: DataFrame, feed: DataFrame) -> Fold:
    """``create`` with a free username, ``patch`` of the given fields, ``delete``; all by uid.

    A username is taken whatever the status of its owner, so a deleted student stays deleted.
    """
    state = with_position(state, feed)
    op = F.col("op")
    fields = ["student_name", "username", "age", "class_uid"]
    create, patch = op == "create", op == "patch"
    events = feed.select("event_id", "ts", "op", "student_uid", *fields).withColumn(
        "username",
        F.when(create & ~_given("username"), F.col("student_name")).otherwise(F.col("username")),
    )
    # an empty text in a patch is a field that was not sent
    sent = {c: F.when(~patch | _given(c), F.col(c)) for c in fields if c != "age"}
    events = events.withColumns(sent).withColumn(
        "_uid", F.when(create, new_uid("username")).otherwise(F.col("student_uid"))
    )
    events = _known_targets(events, state, "student_uid")
    named = _given("username") & (~create | _given("student_name"))
    fresh = named & ~F.col("_late")
    events = settle(events, state, "student_uid", ["username"], fresh & create, fresh & patch, refuses_first=True)
    outcome = F.col("_outcome")
    any_field = reduce(operator.or_, [F.col(c).isNotNull() for c in fields])
    events = events.withColumns(
        {
            "_birth": _true(create & (outcome == "born")) & ~F.col("_known"),
            "_patch": patch & any_field & (F.col("username").isNull() | _true(outcome.isin("moved", "same"))),
            "_status": F.when(op == "delete", 0),
            "student_uid": F.col("_uid"),
        }
    ).withColumn("_stamp", F.col("_patch") | (op == "delete"))
    events = kept(_missing(events, ["student_uid"]).withColumn("_any", any_field), "judged")
    applied = events.where(
        ~F.col("_late") & (F.col("_birth") | F.col("_patch") | (op == "delete"))
    )
    sets = {
        c: F.col("_birth") | (F.col("_patch") & F.col(c).isNotNull()) for c in fields
    }
    joined = _join_state(state, applied, ["student_uid"], sets)
    rows = _next_state(joined, state.columns, fields)

    rejected = events.withColumn(
        "reason",
        F.when(~_true(op.isin("create", "patch", "delete")), "unknown_op")
        .when(create & ~_given("student_name"), "no_name")
        .when(F.col("_late"), "late")
        .when(create & ~F.col("_birth"), "name_taken")
        .when(patch & (outcome == "taken"), "name_taken")
        .when(patch & ~F.col("_any"), None)
        .when(~create & F.col("_absent"), "no_match"),
    )
    return _result(rows, rejected)


def upsert_courses(state: DataFrame, feed: DataFrame) -> Fold:
    """``create`` by (teacher, class, name), ``patch`` and ``delete`` by uid and owning teacher.

    A create of a live course changes nothing, of a deleted one brings it back.
    """
    keys, triple = ["course_uid", "teacher_uid"], ["teacher_uid", "class_uid", "course_name"]
    state = with_position(state, feed)
    op = F.col("op")
    create, patch, delete = op == "create", op == "patch", op == "delete"
    complete = reduce(operator.and_, [F.col(c).isNotNull() for c in triple])
    events = feed.select("event_id", "ts", "op", "course_uid", *triple).withColumn(
        "_uid", F.when(create, new_uid("course_name")).otherwise(F.col("course_uid"))
    )
    owned = state.withColumnRenamed("teacher_uid", "_teacher")
    targets = owned.select(
        F.col("course_uid").alias("_uid"), "_teacher", _here().alias("_here")
    )
    events = left_join(events, targets, ["_uid"])
    known = F.col("_teacher").isNotNull()
    late = known & (create | ((F.col("_teacher") == F.col("teacher_uid")) & (_at() <= F.col("_here"))))
    events = events.withColumn("_late", _true(late)).withColumn(
        "_known", _true(F.col("_teacher") == F.col("teacher_uid"))
    )
    fresh = ~F.col("_late")
    renaming = patch & (_given("class_uid") | _given("course_name"))
    # an empty text in a patch is a part of the name that was not sent
    events = events.withColumns({c: F.when(~patch | _given(c), F.col(c)) for c in ("class_uid", "course_name")})
    events = settle(
        events, state, "course_uid", triple, create & complete & fresh, renaming & fresh, delete & fresh,
        touch=["teacher_uid", "course_name"], shared=True,
    )
    owners = state.select(F.col("course_uid").alias("_holder"), F.lit(True).alias("_owned"), (F.col("status") != 1).alias("_off"), _here().alias("_owner_at"))
    events = left_join(events, owners, ["_holder"])
    owned = _true(F.col("_owned"))
    events = events.withColumns(
        {
            "_birth": _true(create & ~known & (F.col("_outcome") == "born")),
            "_status": F.when(create, 1).when(delete, 0),
            "_stamp": patch | delete,
            "course_uid": F.when(create, F.col("_holder")).otherwise(F.col("course_uid")),
        }
    )
    # A create that brings a course back stamps: the one that follows a delete, or the first for a course deleted before.
    current = ~owned | F.col("_owner_at").isNull() | (_at() > F.col("_owner_at"))
    turns = Window.partitionBy(*keys).orderBy("ts", "event_id")
    turned = events.where(fresh & ((create & complete & current) | delete)).select("event_id", "ts", "op", *keys).distinct()
    turned = turned.withColumn("_before", F.lag("op").over(turns)).select("event_id", "ts", "op", "course_uid", "_before")
    events = left_join(events, turned.distinct(), ["event_id", "ts", "op", "course_uid"])
    was_off = F.when(F.col("_before").isNull(), owned & F.col("_off")).otherwise(F.col("_before") == "delete")
    events = events.withColumn("_back", _true(create & was_off & current)).drop("_owned", "_off", "_owner_at", "_before")
    events = kept(_missing(events, keys), "judged")
    applied = events.where(~F.col("_late") & ((create & complete) | patch | delete))
    sets = {c: F.col("_birth") | (patch & _given(c)) for c in ["course_name", "class_uid"]}
    joined = _join_state(state, applied, keys, sets, {"_returned": F.max(F.when(F.col("_back"), _at()))})
    rows = _next_state(joined, state.columns, list(sets), F.greatest("_stamped", "_returned"))

    rejected = events.withColumn(
        "reason",
        F.when(~_true(op.isin("create", "patch", "delete")), "unknown_op")
        .when(create & ~complete, "no_name")
        .when(F.col("_late"), "late")
        .when(~create & F.col("_absent"), "no_match"),
    )
    return _result(rows, rejected)
