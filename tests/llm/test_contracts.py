"""Registered queries without SQL, by name, against the contract worked out plainly for each text."""

import hashlib
import re
import zlib

import pytest
import xxhash

from rollbook.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


HARD = [
    None, "", "a@b.c", "x@y.z@w.v a.b+c@d-e.f.g.", "1.2.3.4.5.6.7.8 999.1.1.1 001.002.003.004", "4111 1111 1111 1111 41111111111111 4111-1111-1111-1111-9",
    "+1 (555) 010-9999 ++44.20.7946.0958 +12", "CC-BY cc  by! ccby GENERAL public\nlicense general-public-license cc by cc by", "All rights reserved all RIGHTS reservd", "é😀 " * 30,
    "7" * 300, "\x00\x01 \x1f", "KELVIN İstanbul", "word " * 20,
]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The small documents and hard ones, with an item that some of them hold."""
    folder = str(tmp_path_factory.mktemp("contracts"))
    given = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(10_000 + i, t) for i, t in enumerate(HARD)] + [(None, "no id"), (10_000, None)]
    made = spark.createDataFrame(extra, "doc_id bigint, text string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "1L n_chars")
    given.select("doc_id", "text", "lang", "source", "n_chars").unionByName(made).coalesce(3).write.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    some = [(f"own{i}", t) for i, t in enumerate(["rights RESERVED all", "word word", "", None, "é", "no id", "word " * 13])]
    items.selectExpr("cast(item_id as string) item_id", "text").unionByName(spark.createDataFrame(some, "item_id string, text string")).write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    return folder, docs, [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def personal(text):
    spans = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    spans += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        spans += [("card", *m.span())] if 14 <= len(digits) <= 19 and luhn(digits) else []
    spans += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(spans, key=lambda s: (s[1], ("email", "ip", "card", "phone").index(s[0])))


def test_op1(spark, tables):
    folder, docs, _ = tables
    found = QUERIES["op1_pii"](spark, folder)
    want = []
    for i, t, _ in docs:
        spans = personal(t or "")
        want.append((i, *[sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))))
    assert rows(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=str)
    whole = {(r["doc_id"], r["base_sha256"]): r["spans"].split(",") for r in found.collect()}
    for i, t, _ in docs:
        base = [f"{k}:{a}:{b}" for k, a, b in personal(t or "")]
        assert set(base) <= set(whole[i, sha(",".join(base))])


def test_op4(spark, tables):
    folder, docs, _ = tables
    found = QUERIES["op4_licenses"](spark, folder)
    labels = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    want = []
    for i, t, _ in docs:
        words = WORD.findall(lower(t))
        places = [(at, label) for phrase, label in labels.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split()]
        starts = [at for at, _ in places]
        want.append((i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))))
    assert rows(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=str)
    for r in found.collect():
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(","))))


def test_op5(spark, tables):
    folder, docs, items = tables
    found = QUERIES["op5_decontamination"](spark, folder)
    held: dict[tuple, set] = {}
    for item, t in items:
        words = tuple(WORD.findall(lower(t)))
        for at in range(max(1, len(words) - 12) if words else 0):
            held.setdefault(words[at : at + 13], set()).add(item)
    sizes = sorted({len(w) for w in held})
    want = []
    for i, t, _ in docs:
        words, hit, ids = tuple(WORD.findall(lower(t))), set(), set()
        for n in sizes:
            for at in range(len(words) - n + 1):
                if words[at : at + n] in held:
                    hit |= set(range(at, at + n))
                    ids |= held[words[at : at + n]]
        want.append((i, len(words), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit) and 20 * len(hit) >= len(words)))
    assert rows(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=str)


def test_op9(spark, tables):
    folder, docs, _ = tables
    found = QUERIES["op9_simhash"](spark, folder)
    prints = []
    for i, t, _ in docs:
        words = [w for w in re.split("[\x20\x09-\x0D]+", lower(t)) if w]
        shingles = [" ".join(words[at : at + 4]) for at in range(max(1, len(words) - 3) if words else 0)]
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))))
    kinds = sorted({p for _, p in prints})
    root = {p: p for p in kinds}

    def top(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in kinds:
        for b in kinds:
            if a < b and (a ^ b).bit_count() <= 4:
                root[top(b)] = top(a)
    first = {}
    for i, p in prints:
        if i is not None:
            first[top(p)] = min(i, first.get(top(p), i))
    assert rows(found, "doc_id", "fingerprint", "component_id") == sorted(((i, f"{p:016x}", first.get(top(p))) for i, p in prints), key=str)


def test_op10(spark, tables):
    folder, docs, _ = tables
    found = {(r["doc_id"], r["lang_pred"], r["held_out"]): r for r in QUERIES["op10_language"](spark, folder).collect()}
    learned = {lang for _, _, lang in docs if lang}
    right = seen = 0
    told = {i: (p, h, r["score"]) for (i, p, h), r in found.items()}
    for i, t, lang in docs:
        p, h, score = told[i]
        assert h == (None if i is None else zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= score <= 1
        if not re.search(r"[^\W\d_]", t or ""):
            assert p == "und" or i == 10_000
        else:
            assert p in learned
            if h and i < 10_000:
                seen += 1
                right += p == lang
    assert seen > 20 and right / seen > 0.95


def test_op2_and_op3(spark, tables):
    import sentencepiece

    folder, docs, _ = tables
    kept = QUERIES["op2_quality"](spark, folder)
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str) == sorted((i for i, _, _ in docs), key=str)
    labels = {r["doc_id"]: r["quality"] == 1 for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    chosen = {r["doc_id"] for r in kept.filter("kept").collect()}
    good, bad = [i for i, ok in labels.items() if ok], [i for i, ok in labels.items() if not ok]
    assert sum(i in chosen for i in good) > 0.9 * len(good) and sum(i in chosen for i in bad) < 0.2 * len(bad)
    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    coded = QUERIES["op3_sentencepiece"](spark, folder)
    want = sorted(((i, None if t is None else library.encode(t)) for i, t, _ in docs), key=str)
    assert rows(coded, "doc_id", "ids") == want and coded.filter("not round_trip").count() == 0
