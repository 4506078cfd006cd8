import random
import re

from rollbook.llm import decontamination as D
from tests.llm.edges import by_id, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string, n_hit string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    """Hit words and items, by comparing every window at every place."""
    w, hit, found = words(text), set(), set()
    for item, value in items:
        own = words(value)
        for a in range(max(1, len(own) - 12) if own else 0):
            window = own[a : a + 13]
            for b in range(len(w) - len(window) + 1):
                if w[b : b + len(window)] == window:
                    hit |= set(range(b, b + len(window)))
                    found.add(str(item))
    return hit, found


def random_text(rng, n):
    return "".join(rng.choice("abc") + rng.choice([" ", ", ", " É ", "\n"]) for _ in range(n))


def test_automaton_equals_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        items = [(i, random_text(rng, rng.randint(0, 20))) for i in range(rng.randint(0, 6))]
        automaton = D.build(items)
        for _ in range(5):
            text = random_text(rng, rng.randint(0, 60))
            if items and rng.random() < 0.6:
                text += rng.choice(items)[1] + random_text(rng, 5)
            runs, found, longest = automaton.scan(D.words_of(text))
            hit, names = brute(text, items)
            assert {i for a, b in runs for i in range(a, b)} == hit
            assert {str(i) for i in found} == names
            assert longest <= len(words(text))


def test_documents_and_blocks(spark):
    rng = random.Random(5)
    items = [(i, random_text(rng, n)) for i, n in enumerate((14, 20, 3, 30))] + [(9, None), (10, "--"), (1, "zz yy")]
    rows = [(0, None), (1, ""), (2, "lone"), (3, "x " * 30 + items[0][1] + " y" * 5), (4, items[3][1]), (4, items[3][1]), (None, "a Zz, YY b"), (6, "w " * 100_000 + items[1][1])]
    docs, table = documents(spark, rows), spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    whole = D.decontaminate(docs, table).collect()
    cut = D.decontaminate(docs, table, block_chars=60).collect()
    order = lambda rows: sorted((r.asDict(recursive=True) for r in rows), key=str)
    for some in (whole, cut):
        for r in some:
            text = next(t for i, t in rows if i == r["doc_id"])
            hit, names = brute(text, items)
            assert (r["n_words"], r["n_hit"], r["item_ids"]) == (len(words(text)), len(hit), sorted(names))
            assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(words(text)))
            left = words(r["clean_text"])
            assert len(left) == len(words(text)) - len(hit)
            assert (r["clean_text"] is None) == (text is None)
    assert len(whole) == len(cut) == len(rows)
    same = lambda rows: [{k: v for k, v in r.items() if k != "longest"} for r in order(rows)]
    assert same(whole) == same(cut)


def test_items_are_fetched_block_by_block(spark):
    rng = random.Random(6)
    items = [(i % 9, random_text(rng, 10)) for i in range(40)] + [(3, None), (None, "aa bb")]
    n, blocks = D.item_blocks(spark.createDataFrame([(*i, "x") for i in items], ITEMS), "item_id", "text", 200)
    assert n > 3 and iter(blocks) is blocks
    found = [row for block in blocks for row in block]
    assert sorted(found, key=str) == sorted({i for i in items if i[1] is not None}, key=str)


def test_empty_tables(spark):
    docs, none = documents(spark, [(1, "a b")]), spark.createDataFrame([], ITEMS)
    assert by_id(D.decontaminate(docs, none))[1]["n_hit"] == 0
    assert D.decontaminate(documents(spark, []), none).count() == 0
