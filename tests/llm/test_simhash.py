import random

import numpy as np
import pytest
import xxhash

from rollbook.llm import simhash as S
from rollbook.llm.components import Forest
from tests.llm.edges import documents


def plain(text, n=4):
    """The fingerprint word by word and bit by bit."""
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("aBé   \n\t.") for _ in range(rng.randint(0, 60)))
        assert S.fingerprint(text) == plain(text)


def test_fingerprint_uses_the_engine_s_hash(spark):
    from pyspark.sql import functions as F

    (row,) = spark.range(1).select(F.xxhash64(F.lit("a b c d"))).collect()
    assert S.signed(S.fingerprint("A b\tc d")) == row[0]


@pytest.mark.parametrize("bits", [2, 4])
def test_links_equal_all_pairs(spark, bits):
    rng = random.Random(bits)
    fps = {0}
    while len(fps) < 300:
        base = rng.choice(list(fps)) if rng.random() < 0.7 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 6)):
            base ^= 1 << b
        fps.add(base)
    fps = sorted(fps)
    forest = Forest()
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= bits:
                forest.join(a, b)
    df = spark.createDataFrame([(S.signed(f),) for f in fps], "fp bigint")
    for rounds, cell in ((1, 10**6), (3, 20_000)):
        links = S.near_links(df, bits, rounds, cell).collect()
        own = Forest()
        mask = (1 << 64) - 1
        for r in links:
            own.join(r["a"] & mask, r["b"] & mask)
        group = lambda f: sorted(sorted(x for x in fps if f.root(x) == r) for r in {f.root(x) for x in fps})
        assert group(own) == group(forest)


def test_documents(spark):
    rng = random.Random(9)
    words = [rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(400)]
    near = list(words)
    near[7] = "changed"
    rows = [(5, " ".join(words)), (2, " ".join(near)), (9, " ".join(words)), (9, " ".join(words)), (0, None), (1, ""), (3, " \n"), (4, "one"), (None, "two words"), (6, "lone " * 60_000), (7, "Lone lone lone lone")]
    got = S.near_duplicates(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = {S.signed(plain(t or "")) for _, t in rows}
    assert {r["fp"] for r in got} == fps
    component = {r["doc_id"]: r["component_id"] for r in got}
    bits = (plain(rows[0][1]) ^ plain(rows[1][1])).bit_count()
    assert component == {5: 2 if bits <= 4 else 5, 2: 2, 9: 2 if bits <= 4 else 5, 0: 0, 1: 0, 3: 0, 4: 4, None: None, 6: 6, 7: 6}
    assert sorted(r["doc_id"] for r in got if r["kept"] and r["doc_id"] is not None) == sorted({c for c in component.values() if c is not None})
    assert S.near_duplicates(documents(spark, [])).count() == 0


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        S.near_links(spark.createDataFrame([(1,)], "fp bigint"), 3)


def test_ball():
    assert len(S.ball(2)) == 2081 and len(np.unique(S.ball(2))) == 2081
