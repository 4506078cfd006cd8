"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton recognises every run of words that stands in some item. A document's words are streamed
through it; after each word the automaton's state and match length give the longest run ending there that
some item holds. A run of ``window`` words, or a whole item that is shorter, marks its words as hit.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import WORD, Shared, keep, read, text_map, words_of

WINDOW = 13
#: A document is contaminated if hit words are at least one in so many of its words.
ONE_IN = 20
#: Characters of items in one automaton (about 1 GB at most in a worker). More items make more automata, used in turn.
BLOCK_CHARS = 4_000_000


@dataclass
class Automaton:
    """States of a generalised suffix automaton; state 0 is the empty run."""

    window: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    step: list[dict[int, int]] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    length: list[int] = field(default_factory=lambda: [0])

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _new(self, length: int, link: int, step: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        return len(self.length) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """Give the runs of ``target`` that extend ``state`` a state of their own."""
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.step[target]))
        self.link[target] = copy
        while state >= 0 and self.step[state].get(word) == target:
            self.step[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        known = self.step[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        state = self._new(self.length[last] + 1, 0, {})
        above = last
        while above >= 0 and word not in self.step[above]:
            self.step[above][word] = state
            above = self.link[above]
        if above >= 0:
            target = self.step[above][word]
            exact = self.length[target] == self.length[above] + 1
            self.link[state] = target if exact else self._split(above, word, target)
        return state

    def finish(self, items: list[tuple[object, list[int]]]) -> None:
        """Note which items a full window or a short item found in a state belongs to."""
        size = len(self.length)
        self.at_window = [-1] * size
        for state in sorted(range(1, size), key=self.length.__getitem__):
            above = self.link[state]
            if self.length[above] < self.window <= self.length[state]:
                self.at_window[state] = state
            elif self.length[above] >= self.window:
                self.at_window[state] = self.at_window[above]
        self.items: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, object]]] = {}
        for item, words in items:
            state = 0
            for i, word in enumerate(words, 1):
                state = self.step[state][word]
                if i >= self.window:
                    self.items.setdefault(self.at_window[state], set()).add(item)
            if 0 < len(words) < self.window:
                self.short.setdefault(state, []).append((len(words), item))
        self.short_above = [-1] * size  # the next state on the way to the empty run that ends a short item
        for state in sorted(range(1, size), key=self.length.__getitem__):
            self.short_above[state] = state if state in self.short else self.short_above[self.link[state]]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Runs of hit words as (first, past the last), the items they come from, the longest match."""
        step, link, length = self.step, self.link, self.length
        at_window, short_above, window = self.at_window, self.short_above, self.window
        state = matched = longest = 0
        hits: list[tuple[int, int]] = []
        found: set = set()
        states: set[int] = set()
        for i, word in enumerate(map(self.vocabulary.get, words), 1):
            if word is None:
                state = matched = 0
                continue
            after = step[state].get(word)
            while after is None and state > 0:
                state = link[state]
                matched = length[state]
                after = step[state].get(word)
            if after is None:
                continue
            state = after
            matched += 1
            if matched > longest:
                longest = matched
            if matched >= window:
                hits.append((i - window, i))
                states.add(at_window[state])
            at = short_above[state]
            while at > 0:
                for size, item in self.short[at]:
                    if size <= matched:
                        hits.append((i - size, i))
                        found.add(item)
                at = short_above[link[at]]
        for at in states:
            found |= self.items[at]
        return merged(hits), found, longest


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of runs, as runs that don't touch."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def build(items: list[tuple[object, str | None]], window: int = WINDOW) -> Automaton:
    automaton = Automaton(window)
    ids = automaton.vocabulary
    coded = [(item, [ids.setdefault(w, len(ids)) for w in words_of(text or "")]) for item, text in items]
    for _, words in coded:
        automaton.add(words)
    automaton.finish(coded)
    return automaton


def char_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as code points, end exclusive."""
    if not runs:
        return []
    places = [m.span() for m in re.finditer(WORD, text)]
    return [(places[a][0], places[b - 1][1]) for a, b in runs]


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text less its spans."""
    at, out = 0, []
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def item_blocks(items: DataFrame, item_id: str, text: str, block_chars: int) -> tuple[int, Iterator[list[tuple]]]:
    """How many blocks of about ``block_chars`` the items make, told apart by a hash of the id, and the blocks; each is fetched when it is asked for."""
    whole = items.select(F.col(item_id).alias("item"), F.col(text).alias("text")).filter("text is not null").distinct()
    chars = whole.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / block_chars))
    place = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    if n > 1:  # each block is read by itself
        whole = keep(whole, "items")
    return n, ([tuple(r) for r in whole.filter(place == k).orderBy("item", "text").collect()] for k in range(n))


OUTPUTS = (
    "n_words bigint, n_hit bigint, n_items bigint, item_ids array<string>, longest bigint, runs array<struct<first:int,"
    "past:int>>, spans array<struct<start:int,end:int>>, contaminated boolean, clean_text string"
)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    one_in: int = ONE_IN,
    clean: bool = True,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Per document the hit words, the items they come from, and the text less the hit spans.

    One row per row of ``docs``: the ``carry`` columns and ``OUTPUTS``. Items beyond ``block_chars`` are
    cut into several automata, and the documents pass through one after the other; what was hit adds up.

    A null or empty text has no words and is never contaminated; null item texts and items without words
    never match; items without an id hit but are not listed; repeated items and rows are each judged alike;
    without items nothing is hit. Other columns are ignored.
    """
    spark = docs.sparkSession
    n_blocks, blocks = item_blocks(items, item_id, item_text, block_chars)
    result = docs.withColumn("_text", docs[text])
    for k, block in enumerate(blocks):
        shared = Shared(spark, build(block, window))
        last = k == n_blocks - 1
        inputs = ["_text", *(("runs", "item_ids", "longest") if k else ())]
        result = text_map(result, _judge(shared, one_in, last and clean), OUTPUTS, inputs, [*carry, *([] if last else ["_text"])])
        if not last:
            result = keep(result, "decontamination")
            shared.destroy()  # what its automaton found is written
    return result


def _judge(shared, one_in: int, clean: bool):
    """One automaton's pass over a batch; what earlier passes found comes along and counts as well."""

    def judge(texts, *before) -> list[tuple]:
        automaton, rows = shared.value, []
        for n, value in enumerate(texts):
            words = words_of(value or "")
            runs, found, longest = automaton.scan(words)
            ids = {str(i) for i in found if i is not None}
            if before:
                runs = merged([*runs, *((r["first"], r["past"]) for r in before[0][n])])
                ids.update(before[1][n])
                longest = max(longest, before[2][n])
            spans = char_spans(value or "", runs)
            hit = sum(b - a for a, b in runs)
            rows.append((
                len(words), hit, len(ids), sorted(ids), longest,
                [{"first": a, "past": b} for a, b in runs], [{"start": a, "end": b} for a, b in spans],
                hit > 0 and one_in * hit >= len(words),
                without(value, spans) if clean and value is not None else None,
            ))
        return list(zip(*rows, strict=True)) if rows else [()] * 9

    return judge


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), clean=False)
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated", "longest", "spans",
    )
