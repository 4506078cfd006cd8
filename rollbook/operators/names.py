"""Names that rows take, give up and hand on, settled event by event in time order.

A create asks for a name: it goes to the row that holds the name, or a row is born. A move takes a row to
another name, which others may then ask for. What an event meets depends on all earlier ones that touched its name or its row.

A feed of up to ``SLICE_RECORDS`` small records is played through in order by one task. A larger one is first narrowed to what moves can touch:
creates whose names none can touch are settled by one aggregate per name. The rest is settled by rounds of windows: every event is judged by the
time lines of its name and its row under the guesses of the round before, until no outcome changes. All events before the first one that changed
are settled for good, so where outcomes hang on each other too closely, as is seen when a round leaves more than half as many changes as the one before, a
later part is left, which is played through in slices of bounded size, each from the state that the one before it left. No group is ever gathered whole.

Names that several rows may share are settled by lines instead. A move always succeeds there, so what a row does at which name follows from the
row's own events, but for what creates did to it: whether one gave birth to it, and whether one brought it back before it moved on. So the line of every
row is followed once, then the line of every name, each sorted and read as a stream; rows that creates turned out to concern otherwise than taken for are followed again,
and only the names whose lines changed by that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollbook.operators.joins import left_join
from rollbook.operators.tables import kept

# Records that one task plays through at a time.
SLICE_RECORDS = 250_000
# Rounds before what is left is played through.
ROUNDS = 12

AT = "yyyyMMddHHmmss.SSSSSS"
ORDER = ("_first", "_at", "event_id", "op", "_uid")
# The order of lines; ``_void`` puts events without an id last, ``_seq`` tells the steps of one row apart.
PLACE = ("_at", "_void", "event_id", "op", "_uid", "_seq")


def settle(
    events: DataFrame,
    state: DataFrame,
    key: str,
    names: Sequence[str],
    claims: Column,
    moves: Column,
    offs: Column | None = None,
    touch: Sequence[str] | None = None,
    refuses_first: bool = False,
    shared: bool = False,
) -> DataFrame:
    """Add ``_holder``, the row that an event ends at, and ``_outcome``.

    Events have ``event_id``, ``ts``, ``op`` and ``_uid``, the row that a move is about or a create would give birth to. ``claims``
    tells the creates, ``moves`` the moves, ``offs`` the events that delete a row. Outcomes are ``born`` and ``held``
    for creates; ``moved``, ``same``, ``taken`` and ``absent`` for moves; NULL for all others.

    A move is to the whole name and refused if another row has it; an unknown row is ``absent``, looked at
    before or, with ``refuses_first``, after that. With ``shared`` several rows may have one name, a move changes the parts
    of the name that it gives, the first part must be the row's own, and a create goes to the live holder of the smallest uid.
    ``touch`` names the columns whose values tell which names a move can touch, by default all of the name.
    """
    names, touch = list(names), list(touch or names)
    claims, moves = (F.coalesce(c, F.lit(False)) for c in (claims, moves))
    offs = F.lit(False) if offs is None or not shared else F.coalesce(offs, F.lit(False))  # only there does it matter which rows are live
    marked = events.withColumn("_kind", F.when(claims, "create").when(moves, "move").when(offs, "off")).withColumn("_at", F.date_format("ts", AT))
    marked = kept(marked, "marked")  # it is read five times
    records = kept(_records(marked, state, key, names), "names")
    at = ["event_id", "_at", "op", "_uid"]
    if records.count() <= SLICE_RECORDS:
        found = left_join(marked, _played(records, refuses_first, shared), at).withColumn("_claimed", F.lit(None).cast("string"))
    elif shared:
        found = left_join(marked, _by_lines(records), at).withColumn("_claimed", F.lit(None).cast("string"))
    else:
        parts = [f"_n{names.index(c)}" for c in touch]
        outcomes = _settled(_scope(records, parts), refuses_first)
        found = left_join(_plain_claims(marked, state, key, names), outcomes, at)
    return found.withColumns({
        "_holder": F.coalesce("_to", F.when(F.col("_kind") == "create", F.col("_claimed"))),
        "_outcome": F.coalesce(
            "_what",
            F.when((F.col("_kind") == "create") & F.col("_claimed").isNotNull(), F.when(F.col("_claimed") == F.col("_uid"), "born").otherwise("held")),
            F.when(F.col("_kind") == "move", "absent"),
        ),
    }).drop("_at", "_to", "_what", "_claimed", "_kind")


def _records(marked: DataFrame, state: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Events that ask for names, and the rows they are about or whose names they ask for, as records of one shape."""
    own = [F.col(c).cast("string").alias(f"_n{i}") for i, c in enumerate(names)]
    asked = marked.where("_kind is not null").select(F.col("_kind").alias("kind"), "event_id", "_at", "op", "_uid", *own, F.lit(False).alias("_off")).distinct()
    rows = state.select(
        F.lit("row").alias("kind"), F.lit(None).cast(marked.schema["event_id"].dataType).alias("event_id"), F.lit("").alias("_at"),
        F.lit("").alias("op"), F.col(key).alias("_uid"), *own, (F.col("status") != 1).alias("_off"),
    )
    parts = [f"_n{i}" for i in range(len(names))]
    targets = marked.where("_kind <> 'create'").select("_uid").dropna().distinct().withColumn("_meant", F.lit(True))
    wanted = marked.where("_kind is not null").select(*own).dropna().distinct().withColumn("_wanted", F.lit(True))
    met = left_join(left_join(rows, targets, ["_uid"]), wanted, parts).where("_meant or _wanted").drop("_meant", "_wanted")
    return met.unionByName(asked)


def _plain_claims(marked: DataFrame, state: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Add ``_claimed``: for a name that does not move, its row of the smallest uid, live ones first, or else its first claimant's.

    It is worked out for all creates; those that were settled otherwise have their own answer.
    """
    named = state.dropna(subset=names)
    owners = named.groupBy(*names).agg(F.min(F.struct((F.col("status") != 1).alias("off"), F.col(key).alias("uid"))).alias("_o"))
    first = marked.where("_kind = 'create'").dropna(subset=names).groupBy(*names).agg(F.min(F.struct("ts", "event_id", "_uid")).alias("_f"))
    holders = left_join(first, owners, names).select(*names, F.coalesce("_o.uid", "_f._uid").alias("_claimed"))
    return left_join(marked, holders, names)


def _scope(records: DataFrame, touch: list[str]) -> DataFrame:
    """The records that moves can touch."""
    moves, still = records.where("kind = 'move'"), records.where("kind in ('row', 'create')")
    targets = moves.select("_uid").dropna().distinct()
    moved = left_join(still, targets, ["_uid"], "left_semi")
    touched = moved.select(*touch).union(moves.select(*touch)).dropna().distinct()
    chosen = kept(moved.unionByName(left_join(still, touched, touch, "left_semi")).distinct(), "touched")
    live = left_join(records.where("kind = 'off'"), chosen.where("kind = 'row'").select("_uid").distinct(), ["_uid"], "left_semi")
    return kept(chosen.unionByName(moves).unionByName(live), "names")


def _parts(records: DataFrame) -> list[str]:
    return [c for c in records.columns if c.startswith("_n")]


def _settled(scope: DataFrame, refuses_first: bool) -> DataFrame:
    """``_to`` and ``_what`` of each event in the scope, by rounds and, for what they leave, in slices."""
    names = _parts(scope)
    twice = scope.where("kind = 'row'").dropna(subset=names).groupBy(*names).count().where("count > 1")
    if scope.count() <= SLICE_RECORDS:
        return _played(scope, refuses_first, False)
    if not twice.isEmpty():  # rounds take a name to have one holder
        return _in_slices(scope.where("kind = 'row'"), scope.where("kind <> 'row'"), refuses_first, False)
    guess = scope.withColumn("_first", F.col("kind") != "row").withColumn("_ok", F.lit(True))
    changes = scope.count()
    for _ in range(ROUNDS):
        judged = kept(_judged(guess, refuses_first), "round")
        first, changed = judged.where("_fits <> _ok").agg(F.min(F.struct(*ORDER)), F.count(F.lit(1))).first()
        guess = judged.select(*guess.columns[:-1], F.col("_fits").alias("_ok"))
        if first is None:
            return _outcomes(judged)
        if changed * 2 > changes:  # a round shuffles all records twice, and more of them would not settle enough
            break
        changes = changed
    mark = F.struct(*[F.lit(first[c]).cast(judged.schema[c].dataType).alias(c) for c in ORDER])
    done = F.struct(*ORDER) < mark
    rows = judged.where(done & F.col("_ok")).groupBy("_uid").agg(F.max_by(F.struct(*names), F.struct(*ORDER)).alias("_name"))
    rows = rows.select(
        F.lit("row").alias("kind"), F.lit(None).cast(scope.schema["event_id"].dataType).alias("event_id"), F.lit("").alias("_at"), F.lit("").alias("op"),
        "_uid", *[F.col(f"_name.{c}").alias(c) for c in names], F.lit(False).alias("_off"),
    )
    later = judged.where(~done).select(*scope.columns)
    return _outcomes(judged.where(done)).unionByName(_in_slices(rows, later, refuses_first, False))


def _judged(guess: DataFrame, refuses_first: bool) -> DataFrame:
    """Every record with ``_fits``, whether it gives its row its name, ``_what`` and ``_to``, where earlier events come out as ``_ok`` says."""
    names = _parts(guess)
    name, past = F.struct(*names), (Window.unboundedPreceding, -1)
    by_row = Window.partitionBy("_uid").orderBy(*ORDER).rowsBetween(*past)
    lined = guess.withColumn("_now", F.last(F.when(F.col("_ok"), name), ignorenulls=True).over(by_row))
    known, same = F.col("_now").isNotNull(), F.coalesce(F.col("_now") == name, F.lit(False))
    comes = F.col("_ok") & ~F.when(F.col("kind") == "create", known).otherwise(same)
    lined = lined.withColumns({"_known": known, "_same": same, "_step": F.when(comes, 1).otherwise(0)})
    leaves = lined.where("_ok and _known and _step = 1").select(
        *[F.col(f"_now.{c}").alias(c) for c in names], *[c for c in lined.columns if c not in (*names, "_step")], F.lit(-1).alias("_step")
    )
    line = lined.unionByName(leaves)
    by_name = Window.partitionBy(*names).orderBy(*ORDER).rowsBetween(*past)
    line = line.withColumns({
        "_held": F.coalesce(F.sum("_step").over(by_name), F.lit(0)),
        "_last": F.last(F.when(F.col("_step") == 1, F.col("_uid")), ignorenulls=True).over(by_name),
    }).where("_step >= 0")
    others = F.col("_held") - F.col("_same").cast("int") > 0
    free = F.when(F.col("kind") == "create", F.col("_known") | (F.col("_held") == 0)).otherwise(F.col("_known") & ~others)
    taken = others if refuses_first else others & F.col("_known")
    moved = F.when(taken, "taken").when(~F.col("_known"), "absent").when(F.col("_same"), "same").otherwise("moved")
    created = F.when(F.col("_known") | (F.col("_held") == 0), "born").otherwise("held")
    return line.withColumns({
        "_fits": (F.col("kind") == "row") | free,
        "_what": F.when(F.col("kind") == "create", created).otherwise(moved),
        "_to": F.when((F.col("kind") == "create") & ~free, F.col("_last")).otherwise(F.col("_uid")),
    })


def _outcomes(judged: DataFrame) -> DataFrame:
    return judged.where("kind <> 'row'").select("event_id", "_at", "op", "_uid", "_to", "_what")


def _by_lines(records: DataFrame) -> DataFrame:
    """``_to`` and ``_what`` of each event where several rows may share a name, by the lines of rows and of names."""
    names = _parts(records)
    records = records.withColumns({"_at": F.coalesce("_at", F.lit("~")), "_void": F.col("event_id").isNull(), "_seq": F.lit(0), "_row": F.col("_uid"), "_off": F.coalesce("_off", F.lit(False))})
    events, rows = records.where("kind <> 'row'"), records.where("kind = 'row'")
    about = events.select("_uid").dropna().distinct()
    traced = kept(events.unionByName(left_join(rows, about, ["_uid"], "left_semi")), "traced")
    # rows whose further line depends on what creates did to them: those that move, and those that more than one create would give birth to
    asks = events.where("kind <> 'off'").groupBy("_row").agg(F.max(F.col("kind") == "move").alias("moves"), F.count(F.lit(1)).alias("n"))
    moving = kept(asks.where("_row is not null and (moves or n > 1)").select("_row"), "moving")
    # of the rows of a name that no event is about, only the one that creates go to counts, now and later
    still = left_join(rows, about, ["_uid"], "left_anti").dropna(subset=names).groupBy(*names).agg(F.min(F.struct("_off", "_uid")).alias("_o"))
    still = still.select(
        F.lit("enter").alias("kind"), F.lit("").alias("_at"), F.lit(True).alias("_void"), F.lit(None).cast(records.schema["event_id"].dataType).alias("event_id"),
        F.lit("").alias("op"), "_o._uid", F.lit(0).alias("_seq"), *names, "_o._off", F.lit(None).cast("string").alias("_what"),
    )
    lines = kept(_row_lines(traced).unionByName(still), "lines")
    said, hints = kept(_name_lines(lines), "said"), None
    most = max(ROUNDS, math.ceil(2 * events.count() / SLICE_RECORDS))  # a round costs no more than a slice, but for the first
    for turn in range(most + 1):
        now = kept(left_join(_hints(said), moving, ["_row"], "left_semi"), "hints")
        news = now if hints is None else kept(now.subtract(hints).union(hints.subtract(now)), "news")
        first = news.agg(F.min(F.struct(*PLACE[:-1]))).first()[0]
        if first is None:
            return _line_outcomes(events, lines, said)
        if turn == most:
            break
        again = kept(news.select("_row").distinct(), "again")
        fresh = kept(_row_lines(left_join(traced.unionByName(now), again, ["_row"], "left_semi")), "fresh")
        rest = left_join(lines, again.withColumnRenamed("_row", "_uid"), ["_uid"], "left_anti")
        old = left_join(lines, again.withColumnRenamed("_row", "_uid"), ["_uid"], "left_semi").select(*fresh.columns)
        changed = kept(fresh.subtract(old).union(old.subtract(fresh)).where("kind <> 'told'").select(*names).dropna().distinct(), "changed")
        lines = kept(rest.unionByName(fresh), "lines")
        anew = _name_lines(left_join(lines, changed, names, "left_semi"))
        said, hints = kept(left_join(said, changed, names, "left_anti").unionByName(anew), "said"), now
    # all before the first guess that still changed is settled
    mark = F.struct(*[F.lit(first[c]).cast(lines.schema[c].dataType).alias(c) for c in PLACE[:-1]])
    done = F.struct(*PLACE[:-1]) < mark
    told = said.where(done)
    steps = [
        lines.where(done).where("kind in ('enter', 'off')").select("_uid", *PLACE[:-2], "_seq", F.when(F.col("kind") == "enter", F.struct(*names)).alias("_name"), F.coalesce("_off", F.lit(True)).alias("_off")),
        told.where("_what = 'born'").select("_uid", *PLACE[:-2], F.lit(0).alias("_seq"), F.struct(*names).alias("_name"), F.lit(False).alias("_off")),
        told.where("_up").select(F.col("_to").alias("_uid"), *PLACE[:-2], F.lit(0).alias("_seq"), F.lit(None).cast(T.StructType([lines.schema[c] for c in names])).alias("_name"), F.lit(False).alias("_off")),
    ]
    place = F.struct(*PLACE[:-2], "_seq")
    left = _union(steps).groupBy("_uid").agg(F.max_by("_name", F.when(F.col("_name").isNotNull(), place)).alias("_name"), F.max_by("_off", place).alias("_off"))
    left = left.select(
        F.lit("row").alias("kind"), F.lit(None).cast(records.schema["event_id"].dataType).alias("event_id"), F.lit("").alias("_at"), F.lit("").alias("op"),
        "_uid", *[F.col(f"_name.{c}").alias(c) for c in names], "_off",
    )
    later = events.where(~done).drop("_void", "_seq", "_row")
    return _line_outcomes(events.where(done), lines.where(done), told).unionByName(_in_slices(left, later, False, True))


def _hints(said: DataFrame) -> DataFrame:
    """What creates did to rows: brought one back (``up``), or did not give birth to one (``not``), as records for the lines of rows."""
    names = _parts(said)
    did = F.explode(F.array(
        F.when(F.col("_up"), F.struct(F.lit("up").alias("kind"), F.col("_to").alias("row"))),
        F.when(F.col("_what") == "held", F.struct(F.lit("not").alias("kind"), F.col("_uid").alias("row"))),
    )).alias("_did")
    hints = said.select(did, *PLACE[:-1], *names).where("_did is not null")
    return hints.select("_did.kind", "event_id", "_at", "op", "_uid", *names, F.lit(False).alias("_off"), "_void", F.lit(-1).alias("_seq"), F.col("_did.row").alias("_row"))


def _line_outcomes(events: DataFrame, lines: DataFrame, said: DataFrame) -> DataFrame:
    at = ["event_id", "_at", "op", "_uid"]
    offs = events.where("kind = 'off'").select(*at, F.col("_uid").alias("_to"), F.lit(None).cast("string").alias("_what"))
    told = lines.where("kind = 'told'").select(*at, F.col("_uid").alias("_to"), "_what")
    return said.select(*at, "_to", "_what").unionByName(told).unionByName(offs)


def _row_lines(records: DataFrame) -> DataFrame:
    """What each row does at which name: ``enter``, ``leave``, ``off`` or, asking for it, ``create``; ``told`` is what is settled by that alone."""
    names = _parts(records)
    out = T.StructType([records.schema[c] for c in ("kind", *PLACE, *names, "_off")]).add("_what", "string")
    out = T.StructType([T.StructField(f.name, f.dataType) for f in out])
    read = ["kind", *PLACE[:-1], "_row", "_off", *names]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = RowLine()
        for batch in batches:
            line.steps = []
            for kind, at, void, event, op, uid, row, dead, *name in zip(*(batch[c].to_pylist() for c in read), strict=True):
                line.take(kind, (at, void, event, op, uid), row, dead, tuple(name))
            yield _batch(line.steps, out.names, batch.schema.field("event_id").type, {"_void", "_off"})

    return records.select(*read).repartition("_row").sortWithinPartitions("_row", *PLACE[:-1], F.col("kind") != "not", *names).mapInArrow(follow, out)


def _name_lines(lines: DataFrame) -> DataFrame:
    """The outcome of each create, by the line of its name."""
    names = _parts(lines)
    steps = lines.where("kind <> 'told'").dropna(subset=names)
    out = T.StructType([T.StructField(c, steps.schema[c].dataType) for c in (*PLACE[:-1], *names)]).add("_to", "string").add("_what", "string").add("_up", "boolean")
    read = [*PLACE[:-1], *names, "kind", "_off"]

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = NameLine()
        for batch in batches:
            line.outcomes = []
            for at, void, event, op, uid, *name, kind, off in zip(*(batch[c].to_pylist() for c in read), strict=True):
                line.take((at, void, event, op, uid), tuple(name), kind, off)
            yield _batch(line.outcomes, out.names, batch.schema.field("event_id").type, {"_void", "_up"})

    return steps.repartition(*names).sortWithinPartitions(*names, *PLACE).select(*read).mapInArrow(follow, out)


def _batch(rows: list[tuple], names: list[str], event_type: pa.DataType, flags: set[str]) -> pa.RecordBatch:
    kinds = {"event_id": event_type, "_seq": pa.int32(), **dict.fromkeys(flags, pa.bool_())}
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names=names)


class RowLine:
    """Follows row after row through its events; it remembers one row's name at a time, and whether it is deleted."""

    def __init__(self) -> None:
        self.row, self.begun, self.steps = None, False, []

    def take(self, kind: str, place: tuple, row: str, dead: bool, name: tuple) -> None:
        if not self.begun or row != self.row:
            self.row, self.begun, self.now, self.off, self.seq, self.denied = row, True, None, False, 0, None
        if kind == "up":
            self.off = False
        elif kind == "not":
            self.denied = place
        elif kind == "off":
            if self.now is not None and self.now[0] == name[0]:
                self.off = True
                self._step("off", place, self.now, None)
        elif kind == "create":
            if self.now is not None:
                self._step("told", place, name, None, "born")  # the same event once more
            else:
                self._step("create", place, name, None)
                if place != self.denied:
                    self.now, self.off = name, False
        elif kind == "row":
            self._goes(place, name, dead)
        elif self.now is None or self.now[0] != name[0]:
            self._step("told", place, name, None, "absent")
        else:
            self._step("told", place, name, None, "moved")
            self._goes(place, tuple(new or old for new, old in zip(name, self.now, strict=True)), self.off)

    def _goes(self, place: tuple, name: tuple, off: bool) -> None:
        self.off = off
        if name != self.now:
            if self.now is not None:
                self._step("leave", place, self.now, None)
            self._step("enter", place, name, off)
        self.now = name

    def _step(self, kind: str, place: tuple, name: tuple, off: bool | None, what: str | None = None) -> None:
        self.seq += 1
        self.steps.append((kind, *place, self.seq, *name, off, what))


class NameLine:
    """Follows name after name through what rows do there; it remembers the rows that have one name at a time."""

    def __init__(self) -> None:
        self.name, self.outcomes = None, []

    def take(self, place: tuple, name: tuple, kind: str, off: bool | None) -> None:
        if name != self.name:
            # deleted or not of each row; and both kinds of rows by uid, with some in them that are not so any more
            self.name, self.rows, self.piles, self.piled = name, {}, ([], []), (set(), set())
        uid = (place[-1] is not None, place[-1])
        if kind == "enter":
            self._put(uid, off)
        elif kind == "leave":
            self.rows.pop(uid, None)
        elif kind == "off":
            if uid in self.rows:
                self._put(uid, True)
        else:
            live, dead = self._least(False), self._least(True)
            to = live or dead or uid
            what, up = ("held", live is None) if live or dead else ("born", False)
            if live is None:
                self._put(to, False)
            self.outcomes.append((*place, *name, to[1], what, up))

    def _put(self, uid: tuple, off: bool) -> None:
        self.rows[uid] = off
        if uid not in self.piled[off]:
            self.piled[off].add(uid)
            heappush(self.piles[off], uid)

    def _least(self, off: bool) -> tuple | None:
        pile = self.piles[off]
        while pile and self.rows.get(pile[0]) is not off:
            self.piled[off].discard(heappop(pile))
        return pile[0] if pile else None


def _in_slices(rows: DataFrame, events: DataFrame, refuses_first: bool, shared: bool) -> DataFrame:
    """Outcomes of events played through in slices of time, each by one task that holds the slice and the rows it is about."""
    names = _parts(rows)
    n = max(1, math.ceil(2 * events.count() / SLICE_RECORDS))
    slices = kept(events.repartitionByRange(n, "_at", "event_id", "op", "_uid").withColumn("_slice", F.spark_partition_id()), "slices")
    state, out = kept(rows.select(*[c for c in events.columns]), "holders"), []
    for i in range(n):
        now = slices.where(F.col("_slice") == i).drop("_slice")
        meant = left_join(state, now.select("_uid").dropna().distinct(), ["_uid"], "left_semi")
        named = left_join(state, now.select(*names).dropna().distinct(), names, "left_semi")
        concerned = kept(meant.unionByName(named).distinct(), "concerned")
        played = kept(_played(concerned.unionByName(now), refuses_first, shared, with_rows=True), "played")
        out.append(played.where("op <> ''").select("event_id", "_at", "op", "_uid", "_to", "_what"))
        after = played.where("op = ''").select(F.lit("row").alias("kind"), "event_id", "_at", "op", "_uid", *names, "_off")
        state = kept(left_join(state, concerned.select("_uid"), ["_uid"], "left_anti").unionByName(after), "holders")
    return kept(_union(out), "outcomes")


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _played(records: DataFrame, refuses_first: bool, shared: bool, with_rows: bool = False) -> DataFrame:
    """``_to`` and ``_what`` of each event of a bounded slice, told by its id, moment, operation and row; perhaps its rows as they are after it."""
    names = _parts(records)
    fields = [records.schema["event_id"], *T.StructType.fromDDL("_at string, op string, _uid string, _to string, _what string")]
    fields += [*[records.schema[c] for c in names], T.StructField("_off", T.BooleanType())] if with_rows else []
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])

    def play(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [b for b in batches if len(b)]
        if whole:
            events, rows = play_through(pd.concat(whole), names, refuses_first, shared)
            yield events.reindex(columns=schema.names).astype(object)
            if with_rows:
                yield rows.reindex(columns=schema.names).astype(object)

    return records.coalesce(1).mapInPandas(play, schema)


def play_through(records: pd.DataFrame, names: list[str], refuses_first: bool, shared: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Outcomes of a slice's events, in time order, against its rows; and the rows as they are then."""
    name_of: dict[str, tuple] = {}
    holders: dict[tuple, set[str]] = {}
    off: dict[str, bool] = {}
    out: list[tuple] = []
    records = records.astype(object).where(records.notna(), None)
    records["_first"] = records["kind"] != "row"
    records = records.sort_values(["_first", "_at", "event_id", "op", "_uid"], kind="stable")

    def put(uid: str, name: tuple) -> None:
        if uid in name_of:
            holders[name_of[uid]].discard(uid)
        name_of[uid] = name
        holders.setdefault(name, set()).add(uid)

    columns = [records[c] for c in ("kind", "event_id", "_at", "op", "_uid", "_off")]
    for kind, event, at, op, uid, dead, *name in zip(*columns, *(records[c] for c in names), strict=True):
        name = tuple(name)
        to, what = uid, None
        if kind == "row":
            put(uid, name)
            off[uid] = dead
            continue
        if kind == "create":
            own = holders.get(name)
            if uid in name_of:
                what = "born"  # the same event once more
            elif own:
                to, what = min((off[u], u) for u in own)[1], "held"
                off[to] = False
            else:
                put(uid, name)
                off[uid], what = False, "born"
        elif kind == "off":
            off[uid] = off.get(uid, False) or (uid in name_of and name_of[uid][0] == name[0])
        elif shared:
            now = name_of.get(uid)
            if now is None or now[0] != name[0]:
                what = "absent"
            else:
                put(uid, tuple(new or old for new, old in zip(name, now, strict=True)))
                what = "moved"
        else:
            now, others = name_of.get(uid), bool(holders.get(name, set()) - {uid})
            if others and (refuses_first or now is not None):
                what = "taken"
            elif now is None:
                what = "absent"
            else:
                what = "same" if now == name else "moved"
                put(uid, name)
        out.append((event, at, op, uid, to, what))
    rows = [(None, "", "", uid, *name, off[uid]) for uid, name in name_of.items()]
    return pd.DataFrame(out, columns=["event_id", "_at", "op", "_uid", "_to", "_what"]), pd.DataFrame(rows, columns=["event_id", "_at", "op", "_uid", *names, "_off"])
