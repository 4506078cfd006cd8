"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The random field is trained by gradient ascent from a small labelled table and
finds secrets the patterns don't know, such as keys, passwords and account numbers. Every word is scored. Where no path
through another label can be the best one under the weights, ``O`` is certain and cuts the chain, so only the stretches of other words
are decoded, all those of a batch together, and the result is that of decoding whole texts.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.llm.common import Shared, read, text_map

# The kinds of base spans in their order, and their patterns.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match begins where its digits do, so long runs of them are read once
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterable[Span]:
    """Each ``@`` with a domain behind it and the run of local characters before it.

    A match of the whole pattern must run up to some ``@``, so this equals a scan from the left, without its
    backtracking over every word.
    """
    floor = 0
    for at in DOMAIN.finditer(text):
        start = at.start()
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at.start():
            floor = at.end()
            yield "email", start, at.end()


def base_spans(text: str) -> list[Span]:
    """Base spans ordered by start, then kind as listed. Leftmost and non-overlapping within a kind."""
    spans: list[Span] = []
    if "@" in text:
        spans += emails(text)
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                spans.append(("phone", *m.span()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# ---- the conditional random field

#: Labels: outside, then begin and inside of each kind. ``value`` marks what follows a word such as ``password``.
CRF_KINDS = ("email", "ip", "card", "phone", "key", "secret", "iban", "ssn")
LABELS = ("O", *(f"{p}-{k}" for k in CRF_KINDS for p in "BI"))

WORDS = re.compile(r"\S+")
SIGN = re.compile(r"[0-9@]")


class Classes(dict):
    """Upper case ``A``, lower case ``a``, digits ``9``, other signs as they are, by code point."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        self[point] = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return self[point]


CLASSES = Classes()
RUNS = re.compile(r"(.)\1{3,}", re.DOTALL)


def shape(word: str) -> str:
    """The classes of a word's signs; runs keep three signs of one class."""
    return RUNS.sub(r"\1\1\1", word.translate(CLASSES))


def size_class(n: int) -> str:
    return str(n) if n < 5 else "5-9" if n < 10 else "10-13" if n < 14 else "14-19" if n < 20 else "20-29" if n < 30 else "30+"


def features(word: str) -> list[str]:
    """Shape features of one word, whatever its neighbours."""
    core = word.strip(".,;:!?\"'()")
    whole = core.translate(CLASSES)
    digits = whole.count("9")
    classes = "".join(sorted(set(whole)))
    out = [f"shape={shape(core)}", f"size={size_class(len(core))}", f"digits={size_class(digits)}", f"classes={classes}"]
    out.append(f"size={size_class(len(core))},classes={classes}")
    if digits and len(classes) > 1 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core):
        out.append("hex")
    if "=" in core[1:-1]:
        name = core.split("=", 1)[0].lower()
        out += ["assigns", f"name={name}", f"named={re.split('[^a-z]', name)[-1]}"]
    if len(core) >= 16:
        out.append(f"start={core[:4]}")
    if not digits:
        out.append(f"word={core.lower()}")
    return out


def sequence_features(words: list[str], i: int) -> list[str]:
    """Features of a word and, marked by their side, the shape and word of its neighbours."""
    out = features(words[i])
    for side in (-2, -1, 1):
        j = i + side
        if 0 <= j < len(words):
            core = words[j].strip(".,;:!?\"'()")
            out += neighbour(words[j], side)
        else:
            out.append(f"{side}:none")
    return out


def neighbour(word: str, side: int) -> list[str]:
    core = word.strip(".,;:!?\"'()")
    out = [f"{side}:shape={shape(core)}"]
    if not SIGN.search(core):
        out.append(f"{side}:word={core.lower()}")
        if word.endswith((":", "=")):
            out.append(f"{side}:names={word.lower()}")
    return out


class Field:
    """Weights of a linear-chain conditional random field: features by labels, label by label."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, words: list[str], i: int) -> np.ndarray:
        """Label scores of one word."""
        return self.weigh(sequence_features(words, i))

    def weigh(self, found: list[str]) -> np.ndarray:
        return self.emit[[self.index[f] for f in found if f in self.index]].sum(axis=0)

    def uncertain(self, scores: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Whether each of the words may have another label than ``O`` in a best path.

        A label goes where ``O`` in its place is better whatever the neighbours' labels that are left. ``apart`` marks places
        between texts; words before the first and past the last one may have any label.
        """
        ahead, behind = self.move - self.move[:, :1], (self.move - self.move[:1]).T  # label after label, label before label
        above = scores - scores[:, :1] - 1e-9
        left = above + ahead.max(axis=0) + behind.max(axis=0) >= 0
        left[apart] = False
        left[:, 0] = True
        at, label = np.nonzero(left[1:-1, 1:])  # pairs of a word and a label that is left
        at, label = at + 1, label + 1
        while True:
            fine = np.ones(len(at), dtype=bool)
            for a in range(0, len(at), 20_000):  # in parts, for memory
                i, y = at[a : a + 20_000], label[a : a + 20_000]
                gain = np.where(left[i - 1], ahead.T[y], -np.inf).max(axis=1) + np.where(left[i + 1], behind.T[y], -np.inf).max(axis=1)
                fine[a : a + 20_000] = above[i, y] + gain >= 0
            if fine.all():
                return left[:, 1:].any(axis=1)
            left[at[~fine], label[~fine]] = False
            at, label = at[fine], label[fine]

    def decode(self, stretches: list[list[np.ndarray]]) -> list[list[int]]:
        """Best labels of each stretch (Viterbi), all stretches side by side; each starts and ends beside an ``O``."""
        if not stretches:
            return []
        sizes = np.array([len(s) for s in stretches])
        order = np.argsort(-sizes, kind="stable")  # the longest first: those still running are a prefix
        paths: list[list[int]] = [[] for _ in stretches]
        steps = int(sizes.max())
        live = [int((sizes > t).sum()) for t in range(steps)]
        score = np.array([stretches[k][0] for k in order]) + self.move[0]
        back: list[np.ndarray] = []
        final = np.zeros((len(stretches), len(LABELS)))
        for t in range(steps):
            if t:
                n = live[t]
                step = score[:n, :, None] + self.move[None]
                back.append(step.argmax(axis=1))
                score = step.max(axis=1) + np.array([stretches[k][t] for k in order[:n]])
            n_next = live[t + 1] if t + 1 < steps else 0
            final[n_next : live[t]] = score[n_next : live[t]]
        ends = (final + self.move[:, 0]).argmax(axis=1)
        for place, k in enumerate(order):
            label = int(ends[place])
            path = [label]
            for t in range(int(sizes[k]) - 1, 0, -1):
                label = int(back[t - 1][place, label])
                path.append(label)
            paths[k] = path[::-1]
        return paths


def train(rows: list[tuple[list[str], list[str]]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Fit by gradient ascent (Adam) on the log likelihood of all words."""
    names = sorted({f for words, _ in rows for i in range(len(words)) for f in sequence_features(words, i)})
    index, k = {f: i for i, f in enumerate(names)}, len(LABELS)
    longest = max(len(w) for w, _ in rows)
    n = len(rows)
    # all rows side by side, each filled up with places held to O
    held = np.ones((n, longest), dtype=bool)
    gold = np.zeros((n, longest), dtype=np.int64)
    cells: list[tuple[int, int]] = []
    for r, (words, labels) in enumerate(rows):
        for i in range(len(words)):
            gold[r, i] = LABELS.index(labels[i])
            held[r, i] = False
            cells.append((r, i))
    r_at, i_at = (np.array(x) for x in zip(*cells, strict=True))
    listed = [[index[f] for f in sequence_features(rows[r][0], i)] for r, i in cells]
    of = np.concatenate(listed)  # features of all words in turn, and where each word's begin
    begin = np.cumsum([0, *(len(x) for x in listed[:-1])])
    word = np.repeat(np.arange(len(cells)), [len(x) for x in listed])
    by = np.argsort(of, kind="stable")
    turns = np.flatnonzero(np.diff(of[by], prepend=-1))
    summed = lambda x: np.add.reduceat(x[word[by]], turns)  # by feature; each occurs
    emit, move = np.zeros((len(names), k)), np.zeros((k, k))
    params, moments = [emit, move], [[np.zeros_like(p) for p in (emit, move)] for _ in range(2)]
    seen_emit, seen_move = summed(np.eye(k)[gold[r_at, i_at]]), np.zeros_like(move)
    np.add.at(seen_move, (gold[:, :-1], gold[:, 1:]), 1)
    block = np.where(held[:, :, None] & (np.arange(k) > 0), -1e9, 0.0)
    for turn in range(1, rounds + 1):
        scores = block.copy()
        scores[r_at, i_at] += np.add.reduceat(emit[of], begin)
        ahead, behind = np.zeros((n, longest, k)), np.zeros((n, longest, k))
        ahead[:, 0] = scores[:, 0]
        for t in range(1, longest):
            ahead[:, t] = log_sum(ahead[:, t - 1, :, None] + move, 1) + scores[:, t]
        for t in range(longest - 2, -1, -1):
            behind[:, t] = log_sum(move + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        whole = log_sum(ahead[:, -1], 1)[:, None, None]
        single = np.exp(ahead + behind - whole)
        pair = np.zeros((k, k))
        for t in range(1, longest):
            pair += np.exp(ahead[:, t - 1, :, None] + move + (scores[:, t] + behind[:, t])[:, None, :] - whole).sum(axis=0)
        slopes = [(seen_emit - summed(single[r_at, i_at])) / n - decay * emit, (seen_move - pair) / n - decay * move]
        for p, slope, first, second in zip(params, slopes, *moments, strict=True):
            first *= 0.9
            first += 0.1 * slope
            second *= 0.99
            second += 0.01 * slope**2
            p += rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-8)
    return Field(index, emit, move)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def labelled_rows(n: int = 900, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: phrases of invented words around data of each kind, and around harmless numbers."""
    rng = np.random.default_rng(seed)
    pick = lambda signs, size: "".join(rng.choice(list(signs), size))
    digits, low, high = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = lambda: one(str, str, str, str.title, str.upper)(pick(low, int(rng.integers(1, 9))) + one("", "", "", "", "-" + pick(low, 2)))
    num = lambda a, b: pick(digits, int(rng.integers(a, b + 1)))
    quad = lambda: ".".join(str(rng.integers(0, 256)) for _ in range(4))
    one = lambda *xs: xs[int(rng.integers(0, len(xs)))]
    secret = lambda: one("", "", "", "db_", "my-") + one("password", "passwd", "secret", "token", "api_key")
    long = lambda: one(str, str, str.title, str.upper)(pick(low, int(rng.integers(9, 31))))
    beyond = "éèüßçñабвгде漢字日本語가나"
    makers = {
        "email": lambda: [f"{word()}.{num(1, 3)}@{word()}{num(0, 1)}.{one('com', 'org', 'net')}"],
        "ip": lambda: [quad()],
        "card": lambda: one([num(16, 16)], [num(4, 4) for _ in range(4)], ["-".join(num(4, 4) for _ in range(4))]),
        "phone": lambda: one(["+1", f"({num(3, 3)})", f"{num(3, 3)}-{num(4, 4)}"], [f"+{num(11, 13)}"], [f"+{num(2, 2)}", num(3, 3), num(6, 8)]),
        "key": lambda: [one(
            *["AKIA" + pick(one(high + "234567", high), 16) for _ in range(3)], one("AKIA", "ASIA") + pick(one(high, high + digits), 16), one("ghp_", "gho_", "ghs_") + pick(low + high + digits, 36),
            one("sk_live_", "sk_test_", "rk_live_") + pick(low + high + digits, 24), f"{one('xoxb', 'xoxp')}-{num(10, 12)}-{pick(low + high + digits, 24)}",
        )],
        "secret": lambda: one(
            [f"{secret()}={pick('0123456789abcdef', 18)}"], *[[f"{secret()}={one('', chr(34))}{pick(one(low, low + high, low + high + digits), int(rng.integers(6, 25)))}"] for _ in range(3)],
            [f'"{pick("0123456789abcdef", 40)}"'], [f'"{pick(one(low, high, low + high), int(rng.integers(6, 41)))}"'], *[[pick(one(low, low + digits, low + high + digits), int(rng.integers(7, 25)))] for _ in range(3)],
        ),
        "iban": lambda: [one("DE", "FR", "ES", "GB") + num(2, 2) + num(16, 20)],
        "ssn": lambda: [f"{num(3, 3)}-{num(2, 2)}-{num(4, 4)}"],
    }
    harmless = [
        lambda: [num(1, 4)], lambda: [f"{num(1, 2)}.{num(1, 2)}"], lambda: ["version", f"{num(1, 1)}.{num(1, 1)}"], lambda: [f"{num(1, 2)}.{num(1, 2)}.{num(1, 2)}"], lambda: [f"{num(4, 4)}-{num(2, 2)}-{num(2, 2)}"],
        lambda: [f"{num(1, 2)}:{num(2, 2)}"], lambda: [f"{word()}{num(1, 3)}"], lambda: [f"{num(1, 3)},{num(3, 3)}"], lambda: [num(5, 9)], lambda: [f"{num(1, 3)}%"], lambda: ["@" + word()],
        lambda: [f"{one('page', 'id', 'n')}={num(1, 4)}"], lambda: [f"({num(1, 4)})"], lambda: [pick(high, 2) + num(1, 3)], lambda: [f"v{num(1, 1)}.{num(1, 1)}"], lambda: [f"{num(4, 4)}-{num(4, 4)}"], lambda: [num(2, 4), num(2, 4)],
        lambda: [long()], lambda: [long()], lambda: [f"{word()}={word()}"], lambda: [word(), "=", word()], lambda: [f"{word()}:", word()],
        lambda: [one("password", "passwd", "secret", "token", "key"), word()], lambda: [one("the", "a"), one("password", "secret", "token", "key"), one("is", "of"), word()],
        lambda: [f"{one('http', 'https')}://www.{word()}.com/{word()}{one('/', '-', '_')}{long()}"], lambda: [one("|", "-", "--", "###", "&", "=", "*", "...", "=====", "/")],
        lambda: [pick(beyond, int(rng.integers(1, 12)))], lambda: [pick(low + beyond, int(rng.integers(3, 30)))], lambda: [f"{word()}{one('_', '-', '/', '.', '(', '|')}{long()}"], lambda: [f'"{word()}"'], lambda: [f"'{word()}", f"{word()}'"],
    ]
    rows = []
    for r in range(n):
        words, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            for _ in range(int(rng.integers(1, 4))):
                words.append(word() + one("", "", "", ",", "."))
                labels.append("O")
            kind = None
            if rng.random() < 0.5:
                kind = CRF_KINDS[(r + len(words)) % len(CRF_KINDS)]
            got = makers[kind]() if kind else one(*harmless)()
            if kind == "secret" and "=" not in got[0]:
                words += one([secret(), "="], [secret() + ":"], [one("token", "password"), "="], [secret() + ":"], [one("password", "secret") + ":"], ["Bearer"])
                if words[-1] == "Bearer":
                    got = [f"eyJ{pick(low + high + digits, int(rng.integers(12, 40)))}.{pick(low + high + digits, 20)}"]
                labels += ["O"] * (len(words) - len(labels))
            if rng.random() < 0.2:
                got[-1] += one(",", ".")
            words += got
            labels += [f"{'I' if i else 'B'}-{kind}" if kind else "O" for i in range(len(got))]
        if rng.random() < 0.6:
            words.append(word())
            labels.append("O")
        rows.append((words, labels))
    return rows


#: Words that are scored together, and distinct words whose scores are held from one window to the next.
WINDOW, HELD_WORDS = 20_000, 200_000
#: Texts from this size on are not split as a whole.
LONG_TEXT = 1 << 20


class Scores:
    """Scores of all words: each distinct word is looked at once, by itself and as a neighbour."""

    def __init__(self, field: Field):
        self.field = field
        #: words that have features of their own
        self.told = {f.split("=", 1)[1] for f in field.index if f.split("=", 1)[0].split(":")[-1] in ("word", "names")}
        self.clear()

    def clear(self) -> None:
        weigh = self.field.weigh
        self.place: dict[str | None, int] = {None: 0}  # None lies between texts
        self.plain: dict[str, int] = {}
        self.rows = [np.array([weigh([]), *(weigh([f"{side}:none"]) for side in (-2, -1, 1))])]

    def row(self, word: str) -> int:
        """The place of a word's scores. Plain words that the field has not met differ in their classes only."""
        core = word.strip(".,;:!?\"'()")
        whole = core.translate(CLASSES)
        plain = len(whole) < 16 and "9" not in whole and "=" not in whole and "@" not in whole and core.lower() not in self.told and word.lower() not in self.told
        if plain and whole in self.plain:
            return self.plain[whole]
        weigh = self.field.weigh
        self.rows.append(np.array([weigh(features(word)), *(weigh(neighbour(word, side)) for side in (-2, -1, 1))]))
        if plain:
            self.plain[whole] = len(self.rows) - 1
        return len(self.rows) - 1

    def of(self, words: list[str | None]) -> np.ndarray:
        """Label scores of the words but for the first two and the last, which are neighbours only."""
        if len(self.place) > HELD_WORDS or len(self.rows) > HELD_WORDS // 4:
            self.clear()
        place = self.place
        for w in set(words).difference(place):
            place[w] = self.row(w)
        used, here = np.unique(np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words)), return_inverse=True)
        rows = np.array([self.rows[u] for u in used])
        return rows[here[2:-1], 0] + rows[here[:-3], 1] + rows[here[1:-2], 2] + rows[here[3:], 3]


def field_spans(field: Field, texts: list[str]) -> list[list[Span]]:
    """Spans that the random field finds in each text."""
    found: list[list[Span]] = [[] for _ in texts]
    if not hasattr(field, "known"):
        field.known = Scores(field)
    first: list[int] = []  # place of each text's first word

    def words_of_all() -> Iterator[str | None]:
        n = 2
        for text in texts:
            first.append(n)
            for w in text.split() if len(text) < LONG_TEXT else map(re.Match.group, WORDS.finditer(text)):
                yield w
                n += 1
            yield from (None, None)
            n += 2

    stretches: list[list[np.ndarray]] = []  # words that may have a label, and their places
    where: list[list[int]] = []
    every, words, a = words_of_all(), [None, None], 2
    while more := list(islice(every, WINDOW)):
        words += more
        if len(words) > 3:
            scores = field.known.of(words)
            unsure = field.uncertain(scores, np.array([w is None for w in words[2:-1]], dtype=bool))
            for i in np.flatnonzero(unsure).tolist():
                if not where or where[-1][-1] != a + i - 1:
                    where.append([])
                    stretches.append([])
                where[-1].append(a + i)
                stretches[-1].append(scores[i])
            a += len(words) - 3
        words = words[-3:]
    of, places, past = -1, iter(()), 0
    for run, path in zip(where, field.decode(stretches), strict=True):
        if not any(path):
            continue
        n = bisect_right(first, run[0]) - 1
        text, i = texts[n], 0
        if n != of:
            of, places, past = n, WORDS.finditer(text), first[n]
        spans = [m.span() for m in islice(places, run[0] - past, run[-1] + 1 - past)]
        past = run[-1] + 1
        while i < len(run):
            label, j = LABELS[path[i]], i + 1
            if label == "O":
                i = j
                continue
            while j < len(run) and LABELS[path[j]] == f"I-{label[2:]}":
                j += 1
            start, end = trimmed(text, spans[i][0], spans[j - 1][1])
            if start < end:
                found[n].append((label[2:], start, end))
            i = j
    return found


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the punctuation and quotes around it."""
    while start < end and text[start] in "\"'([{<,;:":
        start += 1
    while end > start and text[end - 1] in "\"')]}>.,;:!?":
        end -= 1
    return start, end


def all_spans(base: list[Span], more: list[Span]) -> list[Span]:
    """Base spans, and those of the field that touch none of them."""
    covered: list[int] = []  # starts and ends of what base spans cover, in turn
    for _, a, b in base:
        if covered and a <= covered[-1]:
            covered[-1] = max(covered[-1], b)
        else:
            covered += [a, b]
    free = lambda a, b: bisect_right(covered, a) == bisect_left(covered, b) and bisect_right(covered, a) % 2 == 0
    fresh = [s for s in more if free(s[1], s[2])]
    kinds = (*KINDS, *(k for k in CRF_KINDS if k not in KINDS))
    return sorted([*base, *fresh], key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def told(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def checked(text: str, spans: list[Span]) -> list[Span]:
    """The spans but for numbers that can't be what their kind says."""
    return [s for s in spans if s[0] != "card" or luhn("".join(c for c in text[s[1] : s[2]] if c in "0123456789"))]


OUTPUTS = "base array<struct<kind:string,start:int,end:int>>, spans array<struct<kind:string,start:int,end:int>>, masked string"


def detect(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",), field: Field | None = None, mask: bool = True) -> DataFrame:
    """Spans of personal data and secrets in every whole text, and the text with them masked.

    A number that the field takes for a card but whose check digit is wrong is no card.

    One row per row of ``docs``: the ``carry`` columns, ``base`` and ``spans`` (code points, end exclusive,
    by start) and ``masked`` (null with ``mask=False``). The field is trained on the driver from the small table of ``labelled_rows``
    unless one is given. A null or empty text has no spans; a null text stays null. Repeated rows are each judged alike; other
    columns are ignored.
    """
    shared = Shared(docs.sparkSession, field or train(labelled_rows()))

    def judge(texts: list[str | None]) -> list[list]:
        whole = [t or "" for t in texts]
        base = [base_spans(t) for t in whole]
        spans = [all_spans(b, checked(t, m)) for t, b, m in zip(whole, base, field_spans(shared.value, whole), strict=True)]
        rows = lambda found: [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found]
        return [rows(base), rows(spans), [masked(t, s) if mask and t is not None else None for t, s in zip(texts, spans, strict=True)]]

    return text_map(docs, judge, OUTPUTS, [text], carry)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(read(spark, sf_dir, "documents"), mask=False)
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
