import random
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

from rollbook.llm import packing

from .edges import documents


def fewest(counts, size):
    """Bins of a best packing, by trying all."""

    @lru_cache(None)
    def solve(items):
        if not items:
            return 0
        first, rest = items[0], items[1:]
        best = 99

        def fill(room, at, left):
            nonlocal best
            best = min(best, 1 + solve(tuple(left)))
            for i in range(at, len(left)):
                if left[i] <= room and (i == at or left[i] != left[i - 1]):
                    fill(room - left[i], i, left[:i] + left[i + 1 :])

        fill(size - first, 0, list(rest))
        return best

    return solve(tuple(sorted(Counter(counts).elements(), reverse=True)))


def bins(plan):
    return sum(times for _, times in plan)


def test_reduction_loses_no_best_packing():
    random.seed(3)
    fixed_some = 0
    for _ in range(250):
        size = random.randint(8, 24)
        low = random.choice([1, 2, size // 4])
        counts = Counter(random.randint(max(1, low), size) for _ in range(random.randint(1, 9)))
        fixed, left = packing.reduce_instance(counts, size)
        fixed_some += bool(fixed)
        used = Counter()
        for items, times in fixed:
            assert sum(s * n for s, n in items) <= size
            used.update({s: n * times for s, n in items})
        assert used + Counter(left) == counts
        assert bins(fixed) + fewest(left, size) == fewest(counts, size), (size, counts)
    assert fixed_some > 100


def plain_best_fit(counts, size):
    rooms = []
    for s in sorted(Counter(counts).elements(), reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
        rooms.append((min(fits) if fits else size) - s)
    return len(rooms)


def test_best_fit_equals_one_by_one_and_stays_near_the_bound():
    random.seed(4)
    for _ in range(60):
        size = random.randint(5, 60)
        counts = Counter(random.choice([random.randint(1, size), size // 2 + 1, 3]) for _ in range(random.randint(1, 300)))
        plan = packing.best_fit(counts, size)
        assert bins(plan) == plain_best_fit(counts, size)
        assert all(sum(s * n for s, n in items) <= size for items, _ in plan)
        assert bins(packing.arrange(counts, size)) <= bins(plan)


def test_plan_stays_small_however_many_documents():
    counts = {s: 10**12 // s for s in range(1, 1025)}
    plan = packing.arrange(counts, 1024)
    total = sum(s * n for s, n in counts.items())
    assert len(plan) < 4000 and bins(plan) <= -(-total // 1024) + 1


def check(pieces, size):
    places = {}
    for r in pieces:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= size


def test_query_equals_the_tokenizer(spark, tmp_path):
    texts = [None, "", "Hello <|endoftext|> world", "é😀\n" * 900, "word " * 5000, "a" * 3000, "x", "x", "the quick brown fox " * 256]
    df = documents(spark, [(i if i < 7 else None if i == 7 else 3, t) for i, t in enumerate(texts)])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op12_packing(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = []
    for i, t in [(r["doc_id"], r["text"]) for r in df.collect()]:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    check(got, 1024)
    assert got[0].__fields__ == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_pack_many_parts_hot_lengths_and_empty(spark, monkeypatch):
    rows = [(i, 7 if i % 3 == 0 else i % 100 + 1, "x", 5) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id bigint, length bigint, sequence_id string, offset int").repartition(9)
    for most in (packing.BROADCAST_ROWS, 0):
        monkeypatch.setattr(packing, "BROADCAST_ROWS", most)
        got = packing.pack(df, 100).collect()
        assert sorted((r["doc_id"], r["length"]) for r in got) == sorted(r[:2] for r in rows)
        check(got, 100)
        assert len({r["sequence_id"] for r in got}) <= plain_best_fit(Counter(r[1] for r in rows), 100)
    assert packing.pack(df.limit(0), 100).collect() == []


def test_ids_can_be_carried(spark):
    df = documents(spark, [(1, "some words " * 700)])
    rows = sorted(packing.cut(df, packing.tokenizer_path(), size=100, with_ids=True).collect(), key=lambda r: r["piece"])
    ids = [i for r in rows for i in r["ids"]]
    assert ids == [*Tokenizer.from_file(packing.tokenizer_path()).encode("some words " * 700, add_special_tokens=False).ids, 2]
    assert [r["length"] for r in rows[1:]] == [100] * (len(rows) - 1) and all(len(r["ids"]) == r["length"] for r in rows)


def test_ids_are_those_of_the_tokenizer():
    encoder, tokenizer = packing.Encoder(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    random.seed(5)
    plain = [" ", "  ", "\n", "\t ", "\r\n", "a", "word", "It's", "'S", "'ll", "<|endoftext|>", "<|endof", "é", "ÿ", "_", "12", "-", ".", "x" * 150, "…", "€", "“", "ſ", "ª²", "½"]
    odd = ["\u3000", "\u00a0", "\x1f", "\x85", "\u4e2d\u6587", "\u0661", "\U0001f600", "\u0301", "\u200b", "\ufeff", "\x00"]
    for k in range(120):
        bits = plain if k % 2 else plain + odd
        texts = ["".join(random.choices(bits, k=random.randint(0, 30))) for _ in range(25)] + ["y" * 2500]
        want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert [i.tolist() for i in encoder.encode(texts)] == want
    assert encoder.encode([]) == []
    every = [chr(c) + "a " + chr(c) + chr(c) for c in range(0x250)]
    assert [i.tolist() for i in encoder.encode(every)] == [e.ids for e in tokenizer.encode_batch(every, add_special_tokens=False)]
