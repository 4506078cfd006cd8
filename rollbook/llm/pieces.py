"""SentencePiece encoding and decoding with weighted finite-state transducers.

A model file is compiled to three machines, each a table of arcs. The normaliser reads signs of a text and writes spaces as ``▁``, one in front. The
pieces are a trie that reads normalised signs and writes ids, those of a sign's bytes where no piece covers it. The neighbours read pieces:
in a model of scores all go together and a piece weighs its negative score; in a model of merges the arc of two neighbours weighs nothing
if merging their joined text gives back just these two, and infinitely much otherwise. The first is true of
all neighbours in one segmentation only, that of the merges.

An input is composed with them on the fly, stretch by stretch: a state is a place in the normalised signs, the trie's node and the last piece. Weights
add up along a path and the least one wins (tropical semiring). Places are relaxed in order, as no arc leads back; where only one path can have a
finite weight, furthest first, until it has reached the end.

Where no piece joins two signs, no path can cross, and the text is cut there: before the spaces of each word, as no
piece goes on with ``▁``, and between letters and other signs, but for texts with the few signs that some piece joins
across. Each stretch is composed by itself, and the paths of stretches seen before are remembered.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rollbook.llm.common import Shared, columns_of, read, slices, text_map

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Paths of stretches, and verdicts on neighbours, in each of a worker's memories (a new and an old one).
REMEMBERED = 450_000
#: Weight that a character without a piece has beyond the worst piece, in a model of scores.
UNKNOWN_WEIGHT = 10.0

#: Numbers of signs without a piece begin here, behind those of pieces, and two numbers make one.
FIRST_SIGN, PAIR = 1 << 24, 1 << 26

# Numbers of fields, piece types and model types in the public model format.
PIECE, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
UNIGRAM, MERGES = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else 4 if kind == 5 else 8
        yield key >> 3, data[at : at + size]
        at += size


class Memory(dict):
    """Values of a function by key. A full memory becomes the old one, from which what is asked for again comes back."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most = make, most
        self.old: dict = {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Transducer:
    def __init__(self, model: bytes):
        parts = list(fields(model))
        trainer = dict(fields(next((v for n, v in parts if n == TRAINER), b"")))
        rules = dict(fields(next((v for n, v in parts if n == NORMALIZER), b"")))
        if rules.get(2):
            raise ValueError("models with a table of character replacements are not supported")
        self.merges = trainer.get(3, UNIGRAM) == MERGES
        self.prefix = bool(rules.get(3, 1))
        self.tidy = bool(rules.get(4, 1))
        self.ids: dict[str, int] = {}
        self.weight: dict[str, float] = {}
        self.bytes_of: list[bytes] = []
        self.byte_ids = [-1] * 256
        self.unknown = 0
        for i, raw in enumerate(v for n, v in parts if n == PIECE):
            one = dict(fields(raw))
            piece, kind = one[1].decode(), one.get(3, NORMAL)
            self.bytes_of.append(piece.encode() if kind in (NORMAL, USER_DEFINED) else b"")
            if kind in (NORMAL, USER_DEFINED):
                self.ids[piece] = i
                self.weight[piece] = -float(np.frombuffer(one.get(2, b"\0\0\0\0"), "<f4")[0])
            elif kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif kind == UNKNOWN:
                self.unknown = i
                self.bytes_of[i] = " ⁇ ".encode()
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces that go on behind a space are not supported")
        across = {a if WORD_SIGN.match(a) else b for p in self.ids for a, b in zip(p, p[1:], strict=False) if a != SPACE and bool(WORD_SIGN.match(a)) != bool(WORD_SIGN.match(b))}
        self.across = re.compile(f"[{re.escape(''.join(sorted(across)))}]") if across else None
        self.worst = max(self.weight.values(), default=0.0) + UNKNOWN_WEIGHT
        self.reads = self.normaliser_arcs()
        self.trie, self.leaves = self.piece_arcs()
        self._ready = False

    def normaliser_arcs(self) -> dict[tuple[str, bool], tuple[str, bool, str]]:
        """By state and whether the sign is a space: what is written, whether the sign itself follows, and the next state."""
        lead = SPACE if self.prefix else ""
        if self.tidy:
            return {
                ("start", True): ("", False, "start"), ("start", False): (lead, True, "word"), ("word", True): ("", False, "gap"),
                ("word", False): ("", True, "word"), ("gap", True): ("", False, "gap"), ("gap", False): (SPACE, True, "word"),
            }
        return {
            ("start", True): (lead + SPACE, False, "word"), ("start", False): (lead, True, "word"),
            ("word", True): (SPACE, False, "word"), ("word", False): ("", True, "word"),
        }

    def piece_arcs(self) -> tuple[list[dict[str, int]], list[int]]:
        """Arcs of the trie by node and sign, and the number of the piece that ends at a node, -1 for none that stands for its own text.

        Numbers from ``FIRST_SIGN`` on are single signs without a piece.
        """
        arcs: list[dict[str, int]] = [{}]
        leaves = [-1]
        self.names, self.costs = list(self.ids), [self.weight[p] for p in self.ids]
        for number, piece in enumerate(self.names):
            node = 0
            for sign in piece:
                if sign not in arcs[node]:
                    arcs[node][sign] = len(arcs)
                    arcs.append({})
                    leaves.append(-1)
                node = arcs[node][sign]
            if not self.merges or self.merged(piece) == [piece]:
                leaves[node] = number
        return arcs, leaves

    def name(self, number: int) -> str:
        return self.names[number] if number < FIRST_SIGN else chr(number - FIRST_SIGN)

    def stands(self, pair: int) -> bool:
        """Whether the neighbours' arc of two pieces, numbered in one, has no weight; it is infinite otherwise."""
        first, second = self.name(pair // PAIR), self.name(pair % PAIR)
        return self.merged(first + second) == [first, second]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("firsts", "stretches", "joins")} | {"_ready": False}

    def _wake(self) -> None:
        if not self._ready:
            self.joins = Memory(self.stands)
            self.firsts = Memory(lambda s: array("i", self.path(s, "start")).tobytes())
            self.stretches = Memory(lambda s: array("i", self.path(s, "word")).tobytes())
            self._ready = True

    def normalise(self, text: str) -> str:
        if self.tidy:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return ((" " if self.prefix else "") + text).replace(" ", SPACE)

    def plain(self, text: str) -> str:
        """What decoding a text's ids gives."""
        whole = self.normalise(text).replace(SPACE, " ")
        return whole[1:] if self.prefix and whole else whole

    def merged(self, text: str) -> list[str]:
        """Signs of a short text merged pair by pair, the pair of the best piece first, the leftmost of equals."""
        parts, weight = list(text), self.weight
        while len(parts) > 1:
            best, at = math.inf, -1
            for i in range(len(parts) - 1):
                w = weight.get(parts[i] + parts[i + 1], math.inf)
                if w < best:
                    best, at = w, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def read(self, stretch: str, state: str) -> str:
        """What the normaliser writes for a stretch."""
        out = []
        for sign in stretch:
            written, copied, state = self.reads[state, sign == " "]
            out.append(written + sign if copied else written)
        return "".join(out)

    def path(self, stretch: str, state: str) -> list[int]:
        """Ids along the path of least weight through the composition with one stretch, read from a state of the normaliser on."""
        self._wake()
        return [i for piece in self.lightest(self.read(stretch, state)) for i in self.coded(piece)]

    def arcs(self, signs: str, at: int) -> list[tuple[int, int]]:
        """Where the trie can be left again from a place on, and the number of the piece read, shorter ones first; there is one for the sign alone."""
        out, trie, leaves, node = [], self.trie, self.leaves, 0
        for end in range(at, len(signs)):
            node = trie[node].get(signs[end], 0)
            if not node:
                break
            if leaves[node] >= 0:
                out.append((end + 1, leaves[node]))
        if not out or out[0][0] > at + 1:
            out.insert(0, (at + 1, FIRST_SIGN + ord(signs[at])))
        return out

    def lightest(self, signs: str) -> list[str]:
        """Pieces of the least path."""
        self._wake()
        return self.only_finite(signs) if self.merges else self.least(signs)

    def least(self, signs: str) -> list[str]:
        """In a model of scores all paths have a weight: places are relaxed in order, each with one state."""
        size, costs = len(signs), self.costs
        ways = [(0.0, 0, -1)] + [(math.inf, 0, -1)] * size  # weight, place before, piece
        for at in range(size):
            sofar = ways[at][0]
            for end, number in self.arcs(signs, at):
                weight = sofar + (costs[number] if number < FIRST_SIGN else self.worst)
                if weight < ways[end][0]:
                    ways[end] = (weight, at, number)
        out, at = [], size
        while at:
            _, at, number = ways[at]
            out.append(self.name(number))
        return out[::-1]

    def only_finite(self, signs: str) -> list[str]:
        """In a model of merges every path but one meets an arc of infinite weight, so the first that reaches the end is the least.

        Arcs are relaxed from the furthest place on, the longest first. A state is a place and the last piece; one from which no finite path goes
        on is not entered again.
        """
        joins, size = self.joins, len(signs)
        arcs: list[list[tuple[int, int]] | None] = [None] * size
        places, path, ways, dead = [0], [-1], [], set()
        while places[-1] < size:
            at, last = places[-1], path[-1]
            if len(ways) < len(places):
                if arcs[at] is None:
                    arcs[at] = self.arcs(signs, at)[::-1]
                ways.append(iter(arcs[at]))
            for end, number in ways[-1]:
                if (last < 0 or joins[last * PAIR + number]) and (end, number) not in dead:
                    places.append(end)
                    path.append(number)
                    break
            else:
                dead.add((places.pop(), path.pop()))
                ways.pop()
        return [self.name(number) for number in path[1:]]

    def coded(self, piece: str) -> list[int]:
        """The id of a piece, or those of a character's bytes, or the unknown id."""
        if piece in self.ids:
            return [self.ids[piece]]
        spelled = [self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass")]
        return spelled if min(spelled) >= 0 else [self.unknown]

    def encode(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers in a row."""
        self._wake()
        fine = self.across is None or not self.across.search(text)
        stretches = (FINE if fine else STRETCH).findall(text)
        return b"".join([*map(self.firsts.__getitem__, stretches[:1]), *map(self.stretches.__getitem__, stretches[1:])])

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: the machines run backwards. Bytes that are no UTF-8 become U+FFFD."""
        whole = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return whole[1:] if self.prefix and whole[:1] == " " else whole


WORD_SIGN = re.compile(r"[^\W_]")
STRETCH = re.compile(f"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")
FINE = re.compile(f"[ {SPACE}]*[^\\W_]+|[ {SPACE}]*(?:[^\\w {SPACE}]|_)+|[ {SPACE}]+")


def load(path: str = MODEL) -> Transducer:
    """Compile a model file on the driver."""
    with open(path, "rb") as file:
        return Transducer(file.read())


def encode(docs: DataFrame, model: Transducer, text: str = "text", carry: Sequence[str] = ("doc_id",), check: bool = True) -> DataFrame:
    """``ids``, ``n_tokens`` and, with ``check``, whether decoding gives back the text (``round_trip``) for every whole text.

    One row per row of ``docs`` with the ``carry`` columns. A null text has null ids and 0 tokens, an empty one no
    ids; both round-trip. A ``▁`` in a text comes back as a space, and is compared as one. Repeated rows are
    each encoded alike; other columns are ignored.
    """
    made = T.StructType.fromDDL("ids array<int>, n_tokens bigint, round_trip boolean")
    kept = columns_of(docs, carry, made)
    shared = Shared(docs.sparkSession, model)
    names = [f.name for f in (*kept, *made)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for part in slices(whole, len(kept)):
                texts = part.column(len(kept)).to_pylist()
                coded = [b"" if t is None else own.encode(t) for t in texts]
                back = [t is None or not check or own.decode(np.frombuffer(c, np.int32).tolist()) == own.plain(t) for t, c in zip(texts, coded, strict=True)]
                sizes = np.array([len(c) // 4 for c in coded], dtype=np.int64)
                missing = pa.array([t is None for t in texts])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(coded), np.int32)), mask=missing)
                arrays = [*(part.column(i) for i in range(len(kept))), ids, pa.array(sizes), pa.array(back if check else [None] * len(back), pa.bool_())]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(*[docs[f.name] for f in kept], docs[text].alias("_text")).mapInArrow(run, T.StructType([*kept, *made]))


def decode(coded: DataFrame, model: Transducer, ids: str = "ids", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``text`` for every row's ids; null ids give a null text, ids outside the model are skipped."""
    shared = Shared(coded.sparkSession, model)
    last = len(model.bytes_of)

    def back(rows: list[list[int] | None]) -> list[list]:
        return [[None if r is None else shared.value.decode([i for i in r if i is not None and 0 <= i < last]) for r in rows]]

    return text_map(coded, back, "text string", [ids], carry)


def op3_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), load(model))
