"""License scans: exact phrases by words, and notices with a few edits.

A notice of ``n`` signs may differ by ``n // SIGNS_PER_EDIT`` edits. Cut into one piece more than that, it keeps at least
one piece whole (pigeonhole), so an Aho-Corasick automaton over all pieces finds every place where a notice
may stand. Only there does the regex library look for the notice with bounded errors.
"""

from __future__ import annotations

import re

import ahocorasick
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import WORD, Shared, read, text_map, words_of

# Phrases found word by word, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices found with edits, and their labels.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license version": "mpl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under cc by nc": "cc-by-nc",
    "licensed under cc by sa": "cc-by-sa",
    "creative commons attribution": "cc-by",
    "released into the public domain": "public-domain",
    "permission to use copy modify and or distribute this software": "isc",
    "all rights reserved": "reserved",
}
SIGNS_PER_EDIT = 10

#: Lengths of a notice that are searched at a time, and signs of the grams that tell whether it is worth it.
STRETCH, GRAM = 2, 3


class Scanner:
    """Seeds of all notices in one automaton, and a pattern with bounded errors for each notice."""

    def __init__(self, notices: dict[str, str], signs_per_edit: int = SIGNS_PER_EDIT):
        self.notices = [(phrase, label, len(phrase) // signs_per_edit) for phrase, label in notices.items()]
        fuzzy = [f"(?:{regex.escape(p)}){{e<={k}}}" for p, _, k in self.notices]
        self.patterns = [(regex.compile(f), regex.compile(f"(?b){f}")) for f in fuzzy]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for n, (phrase, _, k) in enumerate(self.notices):
            for at, piece in pieces(phrase, k + 1):
                seeds.setdefault(piece, []).append((n, at))
        self.seeds = list(seeds.items())

    def automaton(self):
        if not hasattr(self, "_automaton"):
            self._automaton = ahocorasick.Automaton()
            for piece, places in self.seeds:
                self._automaton.add_word(piece, (len(piece), places))
            if self.seeds:
                self._automaton.make_automaton()
        return self._automaton if self.seeds else None

    def __getstate__(self):
        return {"notices": self.notices, "patterns": self.patterns, "seeds": self.seeds}

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Places in a normalised text as (notice, start, end, edits), by start."""
        automaton = self.automaton()
        if automaton is None:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in automaton.iter(text):
            for n, at in places:
                phrase, _, k = self.notices[n]
                start = max(0, end + 1 - size - at - k)
                stop = min(len(text), end + 1 - size - at + len(phrase) + k)
                own = windows.setdefault(n, [])
                if own and start <= own[-1][1]:
                    own[-1][0], own[-1][1] = min(start, own[-1][0]), max(stop, own[-1][1])
                else:
                    own.append([start, stop])
        found = []
        for n, own in windows.items():
            for start, stop in own:
                found += [(n, *place) for place in self.places(n, text, start, stop)]
        return sorted(found, key=lambda f: (f[1], f[2], f[0]))

    def near(self, n: int, stretch: str) -> bool:
        """Whether a stretch has as many of a notice's grams as one with all its edits must have: each edit breaks ``GRAM`` at most."""
        phrase, _, k = self.notices[n]
        grams = {stretch[i : i + GRAM] for i in range(len(stretch) - GRAM + 1)}
        return sum(phrase[i : i + GRAM] in grams for i in range(len(phrase) - GRAM + 1)) >= len(phrase) - GRAM + 1 - GRAM * k

    def places(self, n: int, text: str, start: int, stop: int) -> list[tuple[int, int, int]]:
        """Places of a notice in a window as (start, end, edits), left to right.

        A search goes over a stretch of a few notices' length at a time. Where one may begin, the best place nearby is taken; the
        next search begins behind it. So the work grows with the window, however many places it holds.
        """
        phrase, _, k = self.notices[n]
        first, best = self.patterns[n]
        reach = len(phrase) + 2 * k
        found = []
        while stop - start >= len(phrase) - k:
            end = min(stop, start + STRETCH * reach)
            m = first.search(text, start, end) if self.near(n, text[start:end]) else None
            if m:
                m = best.search(text, m.start(), min(stop, m.start() + reach)) or m
                found.append((m.start(), m.end(), sum(m.fuzzy_counts)))
                start = m.end()
            elif end == stop:
                break
            else:
                start = end - reach
        return found


def pieces(phrase: str, n: int) -> list[tuple[int, str]]:
    """A phrase cut into ``n`` pieces of about the same size, each with its place."""
    cuts = [i * len(phrase) // n for i in range(n + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def exact_places(text: str, phrases: dict[str, str]) -> list[tuple[int, int, str]]:
    """Places of phrases in words joined by and enclosed in spaces: (first word, past the last, label)."""
    out = []
    for phrase, label in phrases.items():
        held, at = f" {phrase} ", -1
        word = seen = 0
        while (at := text.find(held, at + 1)) >= 0:
            word += text.count(" ", seen, at)
            seen = at
            out.append((word, word + phrase.count(" ") + 1, label))
    return sorted(out)


OUTPUTS = (
    "n_words bigint, base array<struct<first:int,past:int,label:string>>, "
    "found array<struct<label:string,start:int,end:int,first:int,past:int,edits:int>>, score double"
)


def scan(
    docs: DataFrame,
    text: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    phrases: dict[str, str] | None = None,
    notices: dict[str, str] | None = None,
    signs_per_edit: int = SIGNS_PER_EDIT,
) -> DataFrame:
    """Phrases and notices in every whole text, compared by lower-cased (A-Z) words joined by spaces.

    One row per row of ``docs``: the ``carry`` columns; ``base``, the words of exact phrases; ``found``, the
    notices with their places in the text (code points, end exclusive), words and edits; and ``score``, 1 for
    an exact place, else the share of signs that the best notice has right, 0 without any. A null or
    empty text has no words; repeated rows are each judged alike; other columns are ignored.
    """
    exact = PHRASES if phrases is None else phrases
    shared = Shared(docs.sparkSession, Scanner(NOTICES if notices is None else notices, signs_per_edit))

    def judge(texts: list[str | None]) -> list[tuple]:
        scanner, rows = shared.value, []
        for value in texts:
            words = words_of(value or "")
            joined = b" ".join([b"", *words, b""]).decode("utf-8", "surrogatepass")
            base = exact_places(joined, exact) if words else []
            near = scanner.find(joined)
            found, score = [], 1.0 if base else 0.0
            if near:
                places = [m.span() for m in re.finditer(WORD, value)]
                word = seen = 0
                for n, start, end, edits in near:
                    phrase, label, _ = scanner.notices[n]
                    start += joined[start] == " "
                    word += joined.count(" ", seen, start)
                    seen = start
                    past = min(len(places), word + joined.count(" ", start, end - (joined[end - 1] == " ")))
                    first = max(0, word - 1)
                    score = max(score, 1 - edits / len(phrase))
                    found.append({"label": label, "start": places[first][0], "end": places[max(first, past - 1)][1], "first": first, "past": max(past, first + 1), "edits": edits})
            rows.append((len(words), [{"first": a, "past": b, "label": x} for a, b, x in base], found, score))
        return list(zip(*rows, strict=True)) if rows else [()] * 4

    return text_map(docs, judge, OUTPUTS, [text], carry)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    found = scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.first").cast("bigint").alias("first_word"), F.array_max("base.first").cast("bigint").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat(F.col("base.label"), F.col("found.label"))).alias("labels"), "score",
        F.col("found").alias("notices"),
    )
