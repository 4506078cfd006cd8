import random

import numpy as np
import pytest

from rollbook.llm import pieces as P
from tests.llm.edges import by_id, documents

sentencepiece = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def model():
    return P.load()


def ids(model, text):
    return np.frombuffer(model.encode(text), np.int32).tolist()


def test_equals_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice("aaabbcethind   ▁▁\n\t0012éñ漢字😀\x00 xyz<>/._\"'") for _ in range(rng.randint(0, 40)))
        assert ids(model, text) == library.encode(text)
        assert model.decode(ids(model, text)) == text.replace("▁", " ")


def varint(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def field(n, value):
    if isinstance(value, int):
        return varint(n << 3) + varint(value)
    return varint(n << 3 | 2) + varint(len(value)) + value


def score_model(scores):
    """A model of scores, in the public format."""
    parts = [field(1, b"<unk>"), field(1, field(1, b"<unk>") + field(3, 2))][1:]
    for piece, score in scores.items():
        parts.append(field(1, field(1, piece.encode()) + varint(2 << 3 | 5) + np.float32(score).tobytes()))
    return P.Transducer(b"".join(parts) + field(2, field(3, 1)) + field(3, field(3, 0) + field(4, 0)))


def test_path_of_a_model_of_scores_is_the_lightest():
    rng = random.Random(3)
    scores = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.random() * 5 for _ in range(12)} | {"a": -4.0, "b": -4.5}
    model = score_model(scores)

    def best(text):
        if not text:
            return 0.0
        ways = [model.weight[text[:n]] + best(text[n:]) for n in range(1, len(text) + 1) if text[:n] in scores]
        if text[0] not in scores:
            ways.append(model.worst + best(text[1:]))
        return min(ways)

    for _ in range(200):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 8)))
        got = sum(model.weight.get(p, model.worst) for p in model.lightest(text))
        assert abs(got - best(text)) < 1e-6


def test_documents(spark, model):
    long = "x" * 30_000 + " y" * 30_000
    rows = [(0, None), (1, ""), (2, " two  words "), (2, " two  words "), (3, long), (None, "a▁b"), (4, "漢\x00")]
    coded = P.encode(documents(spark, rows), model)
    got = by_id(coded)
    assert len(coded.collect()) == len(rows)
    assert got[0]["ids"] is None and got[0]["n_tokens"] == 0 and got[1]["ids"] == []
    assert all(r["round_trip"] for r in got.values()) and got[3]["n_tokens"] == len(got[3]["ids"])
    back = by_id(P.decode(coded, model))
    assert {i: r["text"] for i, r in back.items()} == {i: t if t is None else t.replace("▁", " ") for i, t in rows}
    assert P.encode(documents(spark, []), model).count() == 0
    odd = spark.createDataFrame([(1, [5, 99_999, None, -1])], "doc_id bigint, ids array<int>")
    assert by_id(P.decode(odd, model))[1]["text"] == model.decode([5])


def test_one_finite_path_only(model):
    """Relaxing every arc of the composition in order, the least path of a model of merges is the one taken, and the only finite one."""
    rng = random.Random(9)
    model._wake()
    for _ in range(400):
        signs = "".join(rng.choice("▁aeinrsthé0x") for _ in range(rng.randint(1, 9)))
        ways = [{-1: 1}] + [{} for _ in signs]
        for at in range(len(signs)):
            for end, number in model.arcs(signs, at):
                n = sum(times for last, times in ways[at].items() if last < 0 or model.joins[last * P.PAIR + number])
                if n:
                    ways[end][number] = ways[end].get(number, 0) + n
        assert sum(ways[-1].values()) == 1
        assert "".join(model.lightest(signs)) == signs


def test_normaliser_reads_as_its_rule(model):
    """Stretch by stretch, the normaliser's arcs write what the plain replacement of the whole text does."""
    rng = random.Random(10)
    for prefix in (True, False):
        for tidy in (True, False):
            other = P.load()
            other.prefix, other.tidy = prefix, tidy
            other.reads = other.normaliser_arcs()
            for _ in range(200):
                text = "".join(rng.choice("ab  \t.") for _ in range(rng.randint(0, 12)))
                found = P.STRETCH.findall(text)
                assert "".join(other.read(s, "word" if i else "start") for i, s in enumerate(found)) == other.normalise(text), (text, prefix, tidy)
