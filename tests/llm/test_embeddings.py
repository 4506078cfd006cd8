import numpy as np
import pytest

from rollbook.llm import embeddings as E
from rollbook.llm.components import Forest


def vectors_of(seed=4):
    rng = np.random.default_rng(seed)
    rows, out = [], []
    for _ in range(40):
        centre = rng.standard_normal(24)
        for _ in range(int(rng.integers(1, 12))):
            out.append((centre + rng.standard_normal(24) * rng.choice([0.0, 0.1, 0.2, 0.3])).tolist())
    rows = list(enumerate(out, 10))
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] + [1.0] * 23), (1003, [None] + [1.0] * 23), (1004, [float("inf")] + [1.0] * 23), (1005, []), (1006, [1.0]), (1007, [2.0]), (1008, [-1.0]), (None, out[0]), (10, out[0])]
    return rows


def brute(rows):
    sound = [(i, np.array(np.float32(v), dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, forest = [0] * len(sound), Forest()
    for x, (i, a) in enumerate(sound):
        for y, (j, b) in enumerate(sound[:x]):
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                links[x] += 1
                links[y] += 1
                forest.join(i, j)
    return {(i, n, forest.root(i)) for (i, _), n in zip(sound, links, strict=True)}


@pytest.mark.parametrize("chunk", [2000, 5])
def test_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(E, "CHUNK", chunk)
    if chunk == 5:
        monkeypatch.setattr(E, "BROADCAST_BUCKETS", 0)
        monkeypatch.setattr(E, "STRIP", 2)
    rows = vectors_of()
    df = spark.createDataFrame([(*r, "x", "x") for r in rows], "vec_id bigint, embedding array<float>, n string, codes string")
    got = E.near_vectors(df).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    ids = {i for i, _, _ in want}
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] in ids} == want
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] for r in got if r["vec_id"] not in ids)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got if r["vec_id"] is not None)


def test_empty_and_doubles(spark):
    assert E.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    assert sorted((r["vec_id"], r["n_links"]) for r in E.near_vectors(df).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_recall_at_the_limit():
    """Pairs just at the least cosine meet in some table nearly always."""
    rng = np.random.default_rng(0)
    bits, tables = E.plan_tables(50_000)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((3000, 64))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    met = (E.codes_of(a, bits, tables) == E.codes_of(b, bits, tables)).any(axis=1)
    assert met.mean() > 0.995


def test_packed_codes_keep_their_bits():
    draw = np.random.default_rng(3)
    for bits in (1, 8, 9, 23, 40):
        codes = draw.integers(0, 1 << bits, (50, 7))
        width = E.width_of(bits)
        whole = E.packed(codes, width)
        assert {len(w) for w in whole} == {7 * width} and (E.unpacked(whole, width) == codes).all()
        # the codes of earlier tables are a beginning of the whole
        assert (E.unpacked([w[: 3 * width] for w in whole], width) == codes[:, :3]).all()
