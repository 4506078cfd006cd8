"""Phrases whose words stand together more often than chance, from counts that are only ever sorted and merged.

Every word leaves once, with up to four words behind it. Sorted, these windows are the stream in prefix order: the places of a phrase
stand side by side, so the counts of all lengths fall out of one pass. The phrases counted often enough are sorted twice, by their words from
the first and from the last. In the first order a phrase follows those it begins with, in the second those it ends with; a pass in
lockstep with the few that are open tells the counts of both parts of each cut and of the extensions by one word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.llm.common import keep, read, slices

MOST_WORDS, LEAST_COUNT, TOP, SCALE = 5, 100, 2000, 1000

#: Frequent words are broadcast, to cut windows at all others and to shorten them, up to so many words and bytes; beyond it windows hold whole words and are
#: not cut, with the same results.
PRUNE_WORDS, PRUNE_BYTES = 500_000, 16_000_000

#: Signs of short forms.
DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

#: Texts of about so many bytes are taken apart together, and sorted windows of so many rows counted together.
BATCH_BYTES, BATCH_ROWS = 4_000_000, 200_000

#: A to Z in lower case; signs that end a piece are line feeds, and a tab is a space.
SIGNS = bytes(10 if chr(b) in ".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b for b in bytes(range(256)).lower())


def coded_words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different words of the texts, the number of each word in order, and where pieces end (those numbers name no word)."""
    whole = b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts).translate(SIGNS)
    coded = pa.array(whole.replace(b"\n", b" \n ").split(b" "), pa.binary()).dictionary_encode()
    kinds, codes = coded.dictionary, coded.indices.to_numpy()
    codes = codes[codes != pc.index(kinds, pa.scalar(b"", pa.binary())).as_py()]
    return kinds, codes, codes == pc.index(kinds, pa.scalar(b"\n", pa.binary())).as_py()


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str | None]]]:
    for whole in batches:
        for part in slices(whole, 1, BATCH_BYTES):
            groups: dict[str, list] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                groups.setdefault(lang, []).append(text)
            yield from groups.items()


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))


def word_counts(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang``, ``phrase`` (one word) and its count ``a``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, texts in _by_lang(batches):
            kinds, codes, ends = coded_words(texts)
            times = np.bincount(codes[~ends], minlength=len(kinds))
            at = np.flatnonzero(times)
            yield pa.RecordBatch.from_arrays([pa.repeat(name, len(at)), kinds.take(pa.array(at)).cast(pa.string()), pa.array(times[at], pa.int64())], names=["lang", "phrase", "a"])

    return _texts(docs, lang, text).mapInArrow(run, "lang string, phrase string, a bigint").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def short_forms(common: DataFrame) -> dict[str, dict[bytes, bytes]]:
    """For each language its ``common`` words (``lang``, ``phrase``, ``a``) with a form of one sign up, the shorter the more frequent."""
    chosen: dict[str, list] = {}
    for lang, word, a in common.collect():  # bounded by PRUNE_WORDS
        chosen.setdefault(lang, []).append((-a, word.encode("utf-8", "surrogatepass")))

    def form(n: int) -> bytes:
        return (form(n // len(DIGITS) - 1) if n >= len(DIGITS) else b"") + DIGITS[n % len(DIGITS) :][:1]

    return {lang: {word: form(n) for n, (_, word) in enumerate(sorted(words))} for lang, words in chosen.items()}


def windows(docs: DataFrame, shared, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang``, ``window`` and how often it comes (``n``) for each word with what follows it in its piece, up to ``MOST_WORDS`` words.

    With (broadcast) short forms of common words a window holds those and ends before any other word: a phrase with it is too rare. Windows of one word are
    left out, as words are counted on their own. Each word is followed by a space, so that windows sort word by word. Those of a batch
    leave in order, which makes them small on their way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, texts in _by_lang(batches):
            kinds, codes, stops = coded_words(texts)
            if not len(codes):
                continue
            spelled = kinds.to_pylist()
            if shared.value is not None:
                known = shared.value.get(name, {})
                spelled = [known.get(w) for w in spelled]
                stops |= np.fromiter((w is None for w in spelled), bool, len(spelled))[codes]
                spelled = [w or b"" for w in spelled]
            order = sorted(range(len(spelled)), key=spelled.__getitem__)
            kinds, ranks = pa.array([spelled[i] for i in order], pa.binary()), np.empty(len(order), dtype=np.int64)
            ranks[order] = np.arange(len(order))
            codes = ranks[codes]
            places = np.arange(len(codes))
            nexts = np.append(np.flatnonzero(stops), len(codes))
            reach = nexts[np.searchsorted(nexts, places)] - places
            starts = np.flatnonzero(reach > 1)
            after = [codes[np.minimum(starts + k, len(codes) - 1)] for k in range(MOST_WORDS)]
            sort = np.argsort(after[0] << 42 | after[1] << 21 | after[2])
            reach = reach[starts][sort]
            columns = [kinds.take(pa.array(at[sort], mask=reach <= k)) for k, at in enumerate(after)]
            found = pc.binary_join_element_wise(*columns, b"", b" ", null_handling="skip").value_counts()
            yield pa.RecordBatch.from_arrays([pa.repeat(name, len(found)), found.field(0).cast(pa.string()), found.field(1)], names=["lang", "window", "n"])

    return _texts(docs, lang, text).mapInArrow(run, "lang string, window string, n bigint")


def phrase_counts(in_order: DataFrame, shared, least: int = LEAST_COUNT) -> DataFrame:
    """``lang``, ``phrase`` of two words or more and its count ``a``, at least ``least``, from windows in sorted ranges; short forms are spelled out.

    Windows with the same first words are a run, and its weight the count of that phrase. Many rows are counted at a time; the first and the last run of
    each length may go on before or after them, so they leave with any count, and all are added up.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled: dict[str, dict[str, str]] = {}
        for rows in _gathered(batches):
            for name in pc.unique(rows.column("lang")).to_pylist():
                if shared.value is not None and name not in spelled:
                    spelled[name] = {form.decode(): word.decode("utf-8", "surrogatepass") for word, form in shared.value[name].items()}
                whole = spelled.get(name, {})
                mine = rows.filter(pc.equal(rows.column("lang"), name))
                texts = mine.column("window").combine_chunks()
                found = [(" ".join(whole.get(w, w) for w in texts[i].as_py().split(" ")[:k]), n) for k, i, n in runs_of(texts, mine.column("n").to_numpy(), least)]
                phrases, counts = zip(*found) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.repeat(name, len(found)), pa.array(phrases, pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "a"])

    counted = in_order.select("lang", "window", "n").mapInArrow(run, "lang string, phrase string, a bigint")
    return counted.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BATCH_ROWS:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def runs_of(texts: pa.Array, weights: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """``(words, first row, weight)`` of the runs of sorted windows that weigh enough or lie at a border."""
    parts = pc.split_pattern(texts, " ")
    sizes = pc.list_value_length(parts).to_numpy() - 1  # a space follows the last word
    at = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    words = parts.flatten().dictionary_encode().indices.to_numpy()
    fresh = np.zeros(len(texts), dtype=bool)
    fresh[0] = True
    for k in range(MOST_WORDS):
        word = np.where(sizes > k, words[np.minimum(at + k, len(words) - 1)], -1)
        fresh[1:] |= word[1:] != word[:-1]
        if k:
            heads = np.flatnonzero(fresh)
            sums = np.add.reduceat(weights, heads)
            told = sums >= least
            told[[0, -1]] = True
            told &= sizes[heads] > k
            yield from ((k + 1, int(i), int(n)) for i, n in zip(heads[told], sums[told]))


ORDERED = "lang string, key string, a bigint, parts array<bigint>, ext bigint, piece int, loose boolean"


def lockstep(counts: DataFrame, key) -> DataFrame:
    """For each phrase, in the order of ``key`` (its words, each with a space behind): the counts ``parts`` of the keys of 1, 2, .. words that it
    begins with, and the largest count ``ext`` of a phrase with one word more, 0 if there is none.

    The sorted stream is cut into ranges anywhere, so that no first word is one task's work. A range knows the phrases that are open when it begins only by
    name: it tells those (``loose``, four at most), which are then looked up and broadcast by the number of the range.
    """
    stream = counts.select("lang", key.alias("key"), "a")
    stream = stream.repartitionByRange("lang", "key").sortWithinPartitions("lang", "key").withColumn("piece", F.spark_partition_id())
    rows = keep(stream.mapInArrow(_open_phrases, ORDERED), "lockstep")
    loose = rows.filter("loose")  # at most four for each range, so these two are small
    known = counts.select("lang", key.alias("key"), F.col("a").alias("f"))
    opened = known.join(F.broadcast(loose.select("lang", "key", "piece")), ["lang", "key"])
    opened = opened.groupBy("piece").agg(F.map_from_entries(F.collect_list(F.struct(F.size(F.split("key", " ")) - 1, "f"))).alias("_open"))
    later = loose.groupBy("lang", "key").agg(F.max("ext").alias("_later"))
    met = rows.filter("not loose").join(F.broadcast(opened), "piece", "left").join(F.broadcast(later), ["lang", "key"], "left")
    parts = F.transform("parts", lambda f, i: F.coalesce(f, F.try_element_at("_open", i + 1)))
    return met.select("lang", "key", "a", parts.alias("parts"), F.greatest("ext", "_later").alias("ext"))


def _open_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over a sorted range, with the phrases that the last one begins with on a stack."""
    opened: list[list] = []  # [lang, key, words, a, parts, ext]
    before: dict[tuple[str, str], int] = {}
    out: list[tuple] = []
    piece = None

    def close(upto: int) -> None:
        while len(opened) > upto:
            lang, key, _, a, parts, ext = opened.pop()
            out.append((lang, key, a, parts, ext, piece, False))

    def told() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 7
        kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.bool_()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "key", "a", "parts", "ext", "piece", "loose"])

    for batch in batches:
        for lang, key, a, piece in zip(*(batch.column(i).to_pylist() for i in range(4))):
            stay = len(opened)
            while stay and not (opened[stay - 1][0] == lang and key.startswith(opened[stay - 1][1])):
                stay -= 1
            close(stay)
            words = key.count(" ")
            parts: list = [None] * (words - 1)
            for held in opened:
                parts[held[2] - 1] = held[3]
            for n in (n for n, f in enumerate(parts, 1) if f is None):  # open since an earlier range
                whole = " ".join(key.split(" ")[:n]) + " "
                before[lang, whole] = max(before.get((lang, whole), 0), a if n == words - 1 else 0)
            if opened and opened[-1][2] == words - 1:
                opened[-1][5] = max(opened[-1][5], a)
            opened.append([lang, key, words, a, parts, 0])
        yield told()
    close(0)
    out += [(lang, key, None, None, ext, piece, True) for (lang, key), ext in before.items()]
    yield told()


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST_COUNT, prune_words: int = PRUNE_WORDS
) -> DataFrame:
    """Phrases of two to ``MOST_WORDS`` words that come at least ``least`` times: ``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A to Z count as lower case; sentence signs and line ends part pieces, spaces and tabs part words, and no phrase goes beyond its piece. Overlapping
    places all count, so do repeated rows. A null language is ``und``, a null text empty. ``n`` are all words of the language, ``a`` the places of
    the phrase; it is cut in two (``l`` and ``r`` places) where ``SCALE * a * n / (l * r)``, rounded down, is least, as early as can be. Phrases within
    a longer one that comes as often are left out. Without frequent phrases the result is empty; other columns are not read.
    """
    words = keep(word_counts(docs, lang, text), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    common = keep(words.filter(F.col("a") >= least), "common-words")
    n, size = common.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    few = n <= prune_words and size <= PRUNE_BYTES
    shared = docs.sparkSession.sparkContext.broadcast(short_forms(common) if few else None)
    in_order = windows(docs, shared, lang, text).repartitionByRange("window").sortWithinPartitions("window")
    counts = keep(phrase_counts(in_order, shared, least).unionByName(common), "phrases")
    forward = F.concat(F.col("phrase"), F.lit(" "))
    backward = F.concat(F.array_join(F.reverse(F.split("phrase", " ")), " "), F.lit(" "))
    begins = lockstep(counts, forward).select("lang", F.rtrim("key").alias("phrase"), "a", F.col("parts").alias("_begins"), F.col("ext").alias("_right"))
    ends = lockstep(counts, backward).select(
        "lang", F.array_join(F.reverse(F.split(F.rtrim("key"), " ")), " ").alias("phrase"), F.col("parts").alias("_ends"), F.col("ext").alias("_left")
    )
    whole = begins.filter(F.size("_begins") > 0).join(ends, ["lang", "phrase"]).filter(F.greatest("_right", "_left") < F.col("a")).join(totals, "lang")
    exact = lambda c: c.cast("decimal(19,0)")
    size = F.size("_begins") + 1
    cuts = F.transform(F.sequence(F.lit(1), size - 1), lambda k: F.struct(k.alias("k"), F.get("_begins", k - 1).alias("l"), F.get("_ends", size - k - 1).alias("r")))
    cuts = whole.withColumn("_cut", F.explode(cuts)).select("lang", "phrase", "a", "n", "_cut.*")
    product = (exact(F.col("a") * SCALE) * exact(F.col("n"))).alias("_above"), (exact(F.col("l")) * exact(F.col("r"))).alias("_below")
    scored = cuts.select("*", *product).withColumn("score", F.expr("_above div _below"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("_low")
    return scored.groupBy("lang", "phrase", "a", "n").agg(lowest).select("lang", "phrase", "a", "_low.l", "_low.r", "n", "_low.score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ``TOP`` phrases of each language."""
    found = collocations(read(spark, sf_dir, "documents"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= TOP)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?' || chr(11) || chr(12) || chr(13),
           'abcdefghijklmnopqrstuvwxyz' || repeat(chr(10), 9)), chr(10))) AS p FROM documents),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, len, array_to_string(w[i : i + len - 1], ' ') AS phrase
          FROM (SELECT lang, w, len, unnest(range(1, len(w) - len + 2)) AS i FROM words, range(1, {MOST_WORDS + 1}) t(len))),
counts AS (SELECT lang, len, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM counts WHERE len = 1 GROUP BY lang),
candidates AS (SELECT * FROM counts WHERE len > 1 AND a >= {LEAST_COUNT}),
inner_parts AS (
  SELECT lang, a, array_to_string(s[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, s, m, unnest(range(1, len - m + 2)) AS i FROM (SELECT *, string_split(phrase, ' ') AS s FROM candidates), range(2, {MOST_WORDS}) t(m) WHERE m < len)),
covered AS (SELECT DISTINCT c.lang, c.phrase FROM candidates c JOIN inner_parts p ON p.lang = c.lang AND p.phrase = c.phrase WHERE 100 * p.a >= 100 * c.a),
cuts AS (SELECT *, array_to_string(s[1 : k], ' ') AS first_part, array_to_string(s[k + 1 :], ' ') AS rest
         FROM (SELECT *, string_split(phrase, ' ') AS s, unnest(range(1, len)) AS k FROM candidates)),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, t.n, ({SCALE}::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score, k
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.first_part JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang
  WHERE NOT EXISTS (SELECT 1 FROM covered v WHERE v.lang = c.lang AND v.phrase = c.phrase)),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM lowest QUALIFY rank <= {TOP}
"""
