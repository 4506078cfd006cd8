import hashlib
import itertools
import random

import duckdb
import pytest

from rollbook.llm import repair

LEGAL = {"", "ua", "sua", "uaua", "suaua", "uauaua"}


def brute(code, longest=6):
    """The least (cost, audit) over all ways to keep, rerole, delete and insert, grown turn by turn without merging."""
    turns = [code[i : i + 2] for i in range(0, len(code), 2)]
    best = None

    def grow(at, roles, cost, audit):
        nonlocal best
        if len(roles) > longest or (best and cost > best[0]):
            return
        if at == len(turns):
            if roles in LEGAL:
                best = min(filter(None, (best, (cost, audit))))
        else:
            initial, fault = turns[at]
            grow(at + 1, roles, cost + 2, audit + "D")
            if fault not in "bd":
                more = 5 * (fault == "t")
                grow(at + 1, roles + initial, cost + more, audit + "K")
                for r in "ua":
                    grow(at + 1, roles + r, cost + 1 + more, audit + "R")
        for r in "ua":
            grow(at, roles + r, cost + 5, audit + "I")

    grow(0, "", 0, "")
    return best


def test_cheapest_edits_equal_brute_force():
    automaton = repair.Automaton()
    random.seed(1)
    codes = ["".join(p) for n in range(3) for p in itertools.product([i + f for i in "suaxT" for f in "-tb"], repeat=n)]
    codes += ["".join(random.choice("suax") + random.choice("---td") for _ in range(random.randint(3, 4))) for _ in range(60)]
    for code in codes:
        assert repair.cheapest(code, automaton) == brute(code), code


def test_grammar_accepts_only_its_words():
    automaton = repair.Automaton()
    for word in ("".join(p) for n in range(7) for p in itertools.product("sua", repeat=n)):
        stack = automaton.bottom
        for sign in word:
            stack = stack and automaton.shift(stack, sign)
        assert bool(stack and automaton.accepts(stack)) == (word in LEGAL), word


def test_long_conversations_share_their_past():
    automaton = repair.Automaton()
    code = "u-a-" * 40_000 + "u-" + "a-u-" * 100 + "x-"
    cost, audit = repair.cheapest(code, automaton)
    assert len(audit) - audit.count("I") == len(code) // 2 and cost == 1 and audit.endswith("R")


ROWS = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes!"), (1, 2, "user", "More?"),  # an odd turn at the end
    (2, None, "assistant", "first."), (2, 4, "user", None), (2, 7, "user", "cut"), (2, 7, "user", "cut"),
    (3, 1, None, "x."), (3, 2, "", "y."), (3, 3, "Teacher", "z."),
    (4, 0, "system", "S."), (4, 1, "user", " \t\n"), (4, 2, "assistant", "a. \n"), (4, 9, "user", "é😀!"),
    (None, 0, "user", "q?"), (None, 1, "assistant", "a" * 50_000 + "."),
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string, audit string, _rows int, cost string, _code int"


def test_faults_and_repairs(spark):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in ROWS], SCHEMA)
    got = {r["conv_id"]: r for r in repair.repair(df).collect()}
    told = lambda c: tuple(got[c][k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))
    assert told(1) == (0, 0, 0, 0, 0, 2, "KKD")
    assert told(2)[:5] == (2, 1, 1, 1, 2) and told(4)[:5] == (6, 1, 0, 0, 0)
    assert told(3)[:5] == (0, 0, 0, 0, 2) and told(None) == (0, 0, 0, 0, 0, 0, "KK")
    assert [tuple(t) for t in got[None]["repaired"]] == [("user", "q?"), ("assistant", "a" * 50_000 + ".")]
    for row in got.values():
        assert "".join(t["role"][0] for t in row["repaired"]) in LEGAL
    assert repair.repair(df.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(2))
def test_query_equals_sql(spark, tmp_path, seed):
    random.seed(seed)
    texts, roles = ["a.", "b?", "c", "", " ", None, "é! ", "a.\n"], ["user", "assistant", "system", "user", None, "tool", ""]
    rows = [(random.choice([*range(12), None]), random.choice([None, *range(9)]), random.choice(roles), random.choice(texts)) for _ in range(150)]
    rows = list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values()) + ROWS
    rows += [(100 + c, t, "user assistant".split()[t % 2], f"turn {t}.") for c in range(40) for t in range(6)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, repair.op11_repair(spark, str(tmp_path)).collect()), key=str)
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(duck.sql(repair.ORACLE).fetchall(), key=str)
    assert len(got) == len({r[0] for r in rows}) and hashlib.sha256(b"").hexdigest() in {r[-1] for r in got}
