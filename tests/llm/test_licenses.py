import time

import regex

from rollbook.llm import licenses as L
from tests.llm.edges import documents


def rows_of(spark, rows, **more):
    return {r["doc_id"]: r for r in L.scan(documents(spark, rows), **more).collect()}


def test_phrases_and_notices(spark):
    rows = [
        (0, None), (1, ""), (2, "nothing here"), (3, "CC-BY, cc by: CC by cc by"), (4, "All Rights\nReserved! x"), (5, "é Permision is herby granted, free of charge, to any person obtaining"),
        (6, "w " * 50_000 + "Licensed under the Apache Licence, Version 2.0."), (7, "ccby all rights"), (4, "All Rights\nReserved! x"),
    ]
    got = rows_of(spark, rows)
    assert [got[i]["n_words"] for i in (0, 1, 2)] == [0, 0, 2]
    assert [b["first"] for b in got[3]["base"]] == [0, 2, 4, 6] and {b["label"] for b in got[3]["base"]} == {"cc-by"}
    assert [(b["first"], b["past"], b["label"]) for b in got[4]["base"]] == [(0, 3, "reserved")] and got[4]["score"] == 1.0
    text = rows[5][1]
    (near,) = got[5]["found"]
    assert near["label"] == "mit" and near["edits"] == 2 and text[near["start"] : near["end"]].startswith("Permision") and near["first"] == 1
    (far,) = got[6]["found"]
    assert far["label"] == "apache-2.0" and far["first"] == 50_000 and rows[6][1][far["start"] : far["end"]] == "Licensed under the Apache Licence, Version 2.0"
    assert got[7]["base"] == [] and got[7]["found"] == [] and got[7]["score"] == 0.0
    assert L.scan(documents(spark, [])).count() == 0
    assert rows_of(spark, rows, notices={}, phrases={})[4]["score"] == 0.0


def test_seeds_lose_no_notice():
    """Every notice that the pattern finds in a whole text is found from its seeds."""
    import random

    rng = random.Random(2)
    scanner = L.Scanner(L.NOTICES)
    for _ in range(400):
        phrase = rng.choice(list(L.NOTICES))
        text = list(" " + "ab " * rng.randint(0, 5) + phrase + " cd" * rng.randint(0, 5) + " ")
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(1, len(text) - 1)
            text[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "e"])
        text = "".join(text)
        found = {scanner.notices[n][0] for n, *_ in scanner.find(text)}
        whole = {p for (p, _, k) in scanner.notices if regex.search(f"(?:{regex.escape(p)}){{e<={k}}}", text)}
        assert found == whole


def test_an_edited_notice_before_a_better_one():
    """The best place of a window is told, and so are those before and after it."""
    scanner = L.Scanner({"all rights reserved": "reserved"})
    text = " all rights reservd all rights reserved all rihts reserved all rights reservedx "
    assert [(text[a:b].strip(), edits) for _, a, b, edits in scanner.find(text)] == [
        ("all rights reservd", 1), ("all rights reserved", 0), ("all rihts reserved", 1), ("all rights reserved", 0),
    ]


def test_work_grows_with_the_text():
    scanner = L.Scanner(L.NOTICES)
    for text, n in (("all rights reservd " * 20_000, 20_000), ("permission granted software license version rights " * 4_000, 0)):
        began = time.perf_counter()
        found = scanner.find(" " + text)
        assert len(found) == n and time.perf_counter() - began < 10
