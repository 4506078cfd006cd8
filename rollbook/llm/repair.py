"""Conversations brought back to their role grammar by the cheapest edits, found by generalised LR parsing.

The grammar is turned into an SLR automaton. All ways to edit the turns read so far are followed side by side on a
graph-structured stack: equal stacks are one node, and of the ways that lead to a node only the least (cost, audit) lives on.
"""

from __future__ import annotations

import os.path
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.llm.common import read

#: Perhaps one system turn, then pairs of a user and an assistant turn; nothing at all is a conversation too.
GRAMMAR = (("S", ""), ("S", "B"), ("B", "sT"), ("B", "T"), ("T", "P"), ("T", "TP"), ("P", "ua"))
SYSTEM, ROLES = "s", {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

#: Signs of a turn's first fault in its code.
BLANK, DUPLICATE, CUT, FINE = "b", "d", "t", "-"

#: Turns after which what all ways have in common is put aside, and different conversations whose edits are remembered.
SHARE_TURNS, REMEMBERED = 64, 20_000

Items = frozenset[tuple[int, int]]
Stack = tuple  # (state, stack below or None)


class Automaton:
    """SLR automaton of a grammar whose first rules are those of its start sign; upper-case signs have rules."""

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR):
        self.grammar = grammar
        self.heads = {head for head, _ in grammar}
        self.start = grammar[0][0]
        self.ends = self._follow()
        first = self._closed({(i, 0) for i, (head, _) in enumerate(grammar) if head == self.start})
        self.bottom: Stack = (first, None)
        self.moves: dict[tuple[Stack, str], Stack | None] = {}
        self.nodes: dict[tuple, Stack] = {self.bottom: self.bottom}

    def _closed(self, items: set[tuple[int, int]]) -> Items:
        found, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            body = self.grammar[rule][1]
            for i, (head, _) in enumerate(self.grammar):
                if dot < len(body) and head == body[dot] and (i, 0) not in found:
                    found.add((i, 0))
                    todo.append((i, 0))
        return frozenset(found)

    def _follow(self) -> dict[str, set[str]]:
        """What can stand behind each head; ``$`` is the end. No head but the start may be empty."""
        first = {h: set() for h in self.heads}
        ends = {h: {"$"} if h == self.start else set() for h in self.heads}
        while True:
            size = sum(map(len, first.values())) + sum(map(len, ends.values()))
            for head, body in self.grammar:
                first[head] |= first.get(body[0], {body[0]}) if body else set()
                for i, sign in enumerate(body):
                    if sign in self.heads:
                        after = body[i + 1 : i + 2]
                        ends[sign] |= first.get(after, {after}) if after else ends[head]
            if size == sum(map(len, first.values())) + sum(map(len, ends.values())):
                return ends

    def _goto(self, items: Items, sign: str) -> Items:
        return self._closed({(r, d + 1) for r, d in items if self.grammar[r][1][d : d + 1] == sign})

    def _reduced(self, stack: Stack, ahead: str) -> Stack:
        """The stack with all rules applied that end before ``ahead``; ``$`` on top tells that all was read."""
        while True:
            done = [r for r, d in stack[0] if d == len(self.grammar[r][1]) and ahead in self.ends[self.grammar[r][0]]]
            if not done:
                return stack
            head, body = self.grammar[done[0]]
            for _ in body:
                stack = stack[1]
            if head == self.start:
                return ("$", stack)
            stack = (self._goto(stack[0], head), stack)

    def shift(self, stack: Stack, sign: str) -> Stack | None:
        """The stack after ``sign``, None where it can't stand; equal stacks are the same object."""
        if (stack, sign) not in self.moves:
            below = self._reduced(stack, sign)
            items = self._goto(below[0], sign)
            top = (items, below) if items else None
            self.moves[stack, sign] = None if top is None else self.nodes.setdefault(top, top)
        return self.moves[stack, sign]

    def accepts(self, stack: Stack) -> bool:
        return self._reduced(stack, "$")[0] == "$"


def turn_steps(initial: str, fault: str) -> list[tuple[str, str, int]]:
    """Edits of a turn as (letter, role sign it leaves or none, cost)."""
    steps = [("D", "", DELETE)]
    if fault in (BLANK, DUPLICATE):
        return steps
    more = TRUNCATED if fault == CUT else 0
    kept = [("K", initial, KEEP + more)] if initial == SYSTEM or initial in ROLES else []
    return [*steps, *kept, *[("R", sign, REROLE + more) for sign in ROLES]]


def cheapest(code: str, automaton: Automaton) -> tuple[int, str]:
    """Least cost and then least audit for turns given as two signs each: the role's initial, and the fault."""
    tops: dict[Stack, tuple[int, str]] = {automaton.bottom: (0, "")}
    told = []

    def merge(into: dict, stack: Stack | None, cost: int, audit: str) -> bool:
        if stack is None or (stack in into and into[stack] <= (cost, audit)):
            return False
        into[stack] = (cost, audit)
        return True

    def with_inserts(held: dict) -> dict:
        todo = list(held)
        while todo:
            stack = todo.pop()
            cost, audit = held[stack]
            for sign in ROLES:
                to = automaton.shift(stack, sign)
                if merge(held, to, cost + INSERT, audit + "I"):
                    todo.append(to)
        return held

    for i in range(0, len(code), 2):
        steps = turn_steps(code[i], code[i + 1])
        after: dict[Stack, tuple[int, str]] = {}
        for stack, (cost, audit) in with_inserts(tops).items():
            for letter, sign, price in steps:
                merge(after, automaton.shift(stack, sign) if sign else stack, cost + price, audit + letter)
        tops = after
        if i // 2 % SHARE_TURNS == SHARE_TURNS - 1:
            shared = len(os.path.commonprefix([audit for _, audit in tops.values()]))
            told.append(next(iter(tops.values()))[1][:shared])
            tops = {stack: (cost, audit[shared:]) for stack, (cost, audit) in tops.items()}
    cost, audit = min(best for stack, best in with_inserts(tops).items() if automaton.accepts(stack))
    return cost, "".join(told) + audit


def repaired_turns(code: str, audit: str) -> tuple[list[int | None], list[str | None]]:
    """Of each turn left: the place it had (None: inserted), and its new role (None: as it was)."""
    places, roles = [], []
    at, expected = 0, "u"
    for letter in audit:
        if letter != "D":
            system = letter == "K" and code[2 * at] == SYSTEM
            places.append(None if letter == "I" else at)
            roles.append(None if letter == "K" else ROLES[expected])
            expected = expected if system else "a" if expected == "u" else "u"
        at += letter != "I"
    return places, roles


def illegal_pairs(code: str) -> int:
    return sum(code[i] + code[i + 2] not in ("su", "ua", "au") for i in range(0, len(code) - 2, 2))


EDITS = "illegal bigint, cost bigint, audit string, places array<int>, roles array<string>"


def edits(code: Column) -> Column:
    """``EDITS`` of conversations given as codes; only the codes go to Python, and equal ones are parsed once."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton()

        @lru_cache(REMEMBERED)
        def parsed(code: str) -> tuple:
            cost, audit = cheapest(code, automaton)
            return illegal_pairs(code), cost, audit, *repaired_turns(code, audit)

        short = 200  # longer codes rarely come twice
        for codes in batches:
            found = [parsed(c) if len(c) <= short else parsed.__wrapped__(c) for c in codes]
            yield pd.DataFrame(found, columns=["illegal", "cost", "audit", "places", "roles"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}  # Spark reads them as types, not as text
    return F.pandas_udf(run, EDITS)(code)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``gaps``, counts of faulty turns, ``cost``, ``audit`` and the ``repaired`` turns.

    Turns stand by ``turn`` (nulls first), then role and text. A null role or text counts as one space, a role is known by its first
    sign, and one of no sign is of no known role. The first of these faults counts: ``blank`` (no visible sign), ``duplicate`` (role and text
    seen earlier in the conversation; repeated rows are such) and ``truncated`` (no ``.``, ``!`` or ``?`` at the end). Blank and duplicate turns
    are deleted; a truncated one that stays costs extra. ``gaps`` are turn numbers left out between the first and the last, nulls aside. The audit
    has one letter for each edit in order: Keep, Rerole, Delete, Insert; the least one of those that cost least. ``repaired`` lists
    role and text; inserted turns have no text. Rows without a conversation id make one conversation; other columns are ignored, no rows give none.

    Spark finds the faults; a conversation is gathered as it is one value of the result, and two signs a turn of it are parsed.
    """
    said = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("_role"), F.coalesce(F.col(text), F.lit(" ")).alias("_text"),
    )
    seen = F.row_number().over(Window.partitionBy("conv_id", "_role", "_text").orderBy("_turn"))
    visible = r"[^\x20\x09-\x0D]"
    last = F.regexp_extract("_text", rf"({visible})[\x20\x09-\x0D]*\z", 1)
    fault = (
        F.when(last == "", BLANK).when(seen > 1, DUPLICATE).when(~last.isin(".", "!", "?"), CUT).otherwise(FINE)
    )
    initial = F.when(F.col("_role") == "", F.lit("\u0001")).otherwise(F.substring("_role", 1, 1))
    coded = said.withColumn("_fault", fault).withColumn("_code", F.concat(initial, F.col("_fault")))
    row = F.struct(F.col("_turn").isNotNull().alias("numbered"), F.col("_turn").alias("turn"), F.col("_role").alias("role"), F.col("_text").alias("text"), F.col("_code").alias("code"))
    count = lambda sign: F.count(F.when(F.col("_fault") == sign, 1))
    gathered = coded.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(row)).alias("_rows"), count(BLANK).alias("blank"), count(DUPLICATE).alias("duplicate"), count(CUT).alias("truncated"),
        (F.max("_turn") - F.min("_turn") + 1).alias("_span"),
    )
    distinct = F.size(F.array_distinct(F.filter(F.col("_rows.turn"), lambda t: t.isNotNull())))
    parsed = gathered.withColumn("_edits", edits(F.array_join(F.col("_rows.code"), "")))
    left = F.transform(
        F.arrays_zip(F.col("_edits.places").alias("place"), F.col("_edits.roles").alias("role")),
        lambda t: F.struct(
            F.coalesce(t["role"], F.get("_rows", t["place"])["role"]).alias("role"),
            F.coalesce(F.get("_rows", t["place"])["text"], F.lit("")).alias("text"),
        ),
    )
    return parsed.select(
        "conv_id", F.coalesce(F.col("_span") - distinct, F.lit(0)).cast("bigint").alias("gaps"), "blank", "duplicate", "truncated",
        F.col("_edits.illegal").alias("illegal"), F.col("_edits.cost").alias("cost"), F.col("_edits.audit").alias("audit"), left.alias("repaired"),
    )


def damaged(turns: DataFrame) -> DataFrame:
    """Turns of ``conversations`` with the faults of the contract, told by a checksum of ``conv_id:turn``; nulls are one space there."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = turns.select("conv_id", "turn", shown("role").alias("_r"), shown("text").alias("_t"), kind.alias("_kind"))
    times = F.when(F.col("_kind") == 0, F.array().cast("array<int>")).when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_t", "[.!?]", "")).otherwise(F.col("_t"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("_r"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times)).drop("col")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired; one that lost every turn has zeros."""
    turns = read(spark, sf_dir, "conversations")
    found = repair(damaged(turns)).withColumnRenamed("conv_id", "_conv")
    ids = turns.select("conv_id").distinct()
    rows = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    text = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("repaired_sha256"))


def _more(way: str, cost: str | int, letter: str) -> str:
    """SQL of a way, nine digits of cost and then the audit, with another edit."""
    return f"lpad(CAST(CAST(left({way}, 9) AS INT) + {cost} AS VARCHAR), 9, '0') || substr({way}, 10) || '{letter}'"


def _least(*ways: str) -> str:
    return f"least({', '.join(ways)})"


def _stayed(*ways: str) -> str:
    """Ways after a turn that can take role ``r`` is kept or given that role."""
    kept = ", ".join(f"CASE WHEN ini = '{{r}}' AND NOT gone THEN {_more(w, 'more', 'K')} END" for w in ways)
    given = ", ".join(f"CASE WHEN NOT gone THEN {_more(w, '1 + more', 'R')} END" for w in ways)
    return f"{kept}, {given}"


_INSERTED = f"""SELECT * EXCLUDE (q2, q3), {_least('q2', *[_more(q, 5, 'I') for q in ('q0', 'q1', 'q3')])} AS c2,
         {_least('q3', _more(_least('q2', *[_more(q, 5, 'I') for q in ('q0', 'q1', 'q3')]), 5, 'I'))} AS c3"""

#: The same by shortest paths over the four states that the grammar has: nothing yet, after system, user, assistant.
ORACLE = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t,
         list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
           lambda c: [(1000 + ascii(c))::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0]))),
           lambda s, b: CASE WHEN b >= 1000 THEN xor(s, b - 1000) ELSE xor(s >> 1, (s & 1) * 3988292384) END) AS crc FROM conversations),
kinds AS (SELECT *, xor(crc, 4294967295::UBIGINT) % 20 AS kind FROM given),
turns AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE r END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text,
         unnest(CASE WHEN kind = 0 THEN [] WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending, left(role, 1) AS ini FROM turns),
faults AS (
  SELECT *, ending = '' AS blank, ending <> '' AND seen > 1 AS dup, ending <> '' AND seen = 1 AND ending NOT IN ('.', '!', '?') AS cut,
         lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS ini0 FROM placed),
steps AS (SELECT conv_id, i, role, text, ini, blank OR dup AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM faults),
ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000000' AS q0, NULL::VARCHAR AS q1, NULL::VARCHAR AS q2, NULL::VARCHAR AS q3 FROM steps
  UNION ALL
  SELECT conv_id, i, {_more('q0', 2, 'D')},
         {_least(_more('q1', 2, 'D'), f"CASE WHEN ini = 's' AND NOT gone THEN {_more('q0', 'more', 'K')} END")},
         {_least(_more('c2', 2, 'D'), _stayed('q0', 'q1', 'c3').format(r='u'))}, {_least(_more('c3', 2, 'D'), _stayed('c2').format(r='a'))}
  FROM (SELECT s.i, s.ini, s.gone, s.more, w.* EXCLUDE (i) FROM ({_INSERTED} FROM ways) w JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1)),
ends AS (SELECT conv_id, {_least('q0', 'c3')} AS best FROM ({_INSERTED} FROM ways) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
letters AS (
  SELECT conv_id, p, substr(best, 9 + p, 1) AS e FROM (SELECT conv_id, best, unnest(range(1, length(best) - 8)) AS p FROM ends)),
edits AS (
  SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN e <> 'D' THEN 1 ELSE 0 END) OVER w AS o
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
left_over AS (
  SELECT e.conv_id, e.p, e.e, e.o, s.role, CASE WHEN e.e = 'I' THEN '' ELSE s.text END AS text,
         max(CASE WHEN e.o = 1 AND e.e = 'K' AND s.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS sys
  FROM edits e LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND s.i = e.i WHERE e.e <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS text
  FROM left_over GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(dup::INT) AS duplicate,
         sum(cut::INT) AS truncated, sum((i > 1 AND ini0 || ini NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM faults GROUP BY conv_id)
SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
       CAST(coalesce(CAST(left(best, 9) AS BIGINT), 0) AS BIGINT) AS cost, coalesce(substr(best, 10), '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM g.conv_id
"""
