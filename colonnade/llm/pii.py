"""Personal data: fixed patterns, and spans that a character model adds.

The fixed patterns find the strict forms.  The model (``sequence_model``) adds
forms that they miss: addresses with other letters or with ``[at]`` and
``[dot]``, phone numbers without a plus, card numbers with other gaps, hidden
and long internet addresses.

Every form has a digit, an at-sign or a bracketed ``at`` or ``dot`` (a *mark*),
its gaps between marks are short, and what is not near a mark stands in one run of
non-spaces beside it.  So a stretch of all characters within REACH of a mark, and
of the runs of non-spaces they touch, holds every such span whole; other text
holds none.  A stretch is read in windows of WINDOW characters at a stride of
half a window.  Where windows overlap, their scores of tags are averaged, more
weight for the one with more context; one Viterbi pass over the whole stretch
then decides, so that no tag sequence breaks a transition.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colonnade.llm.sequence_model import BiLstmCrf
from colonnade.llm.text import utf8

#: Kinds in the order in which they are listed, and their patterns.
KINDS = ("email", "ip", "card", "phone")
#: Equivalent to the patterns in every match, and linear in any text: no run is entered twice.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WINDOW, REACH = 64, 24
#: Training: windows made, Adam steps.
TRAIN_WINDOWS, STEPS = 8000, 450
#: Characters decoded at once, but for longer texts.
DECODED = 1 << 18
_DIGITS = re.compile(r"[0-9]")
_SPELLED_MARK = re.compile(r"[\[(]\x20?(?:at|dot)\x20?[\])]", re.I)

# Tags: 0 outside, 1 + 2k first and 2 + 2k further character of kind k.
TAGS = 1 + 2 * len(KINDS)
_SHOWN = "@.-+() \n:/_%,#=<>\"'[]"
_PAD, _DIGIT, _LOWER, _UPPER, _WIDE, _OTHER = range(len(_SHOWN), len(_SHOWN) + 6)
SYMBOLS = len(_SHOWN) + 6


def _symbol_table() -> np.ndarray:
    table = np.full(128, _OTHER, np.int8)
    for c in range(128):
        s = chr(c)
        if s in _SHOWN:
            table[c] = _SHOWN.index(s)
        elif s.isdigit():
            table[c] = _DIGIT
        elif s.islower():
            table[c] = _LOWER
        elif s.isupper():
            table[c] = _UPPER
    return table


_TABLE = _symbol_table()


def symbols(code: np.ndarray) -> np.ndarray:
    return np.where(code < 128, _TABLE[np.minimum(code, 127)], _WIDE).astype(np.int8)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _passes(kind: str, piece: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        parts = [p.lstrip("0") for p in piece.split(".")]
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
    digits = "".join(_DIGITS.findall(piece))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def _emails(text: str):
    """Spans of the address pattern, from each at-sign outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > done and text[first - 1] in _LOCAL:
            first -= 1
        found = _DOMAIN.match(text, at + 1) if first < at else None
        if found:
            done = found.end()
            yield first, done
        at = text.find("@", max(done, at + 1))


def _matches(kind: str, text: str):
    if kind == "email":
        return _emails(text) if "@" in text else ()
    if kind == "phone" and "+" not in text:
        return ()
    return (m.span() for m in {"ip": _IP, "card": _CARD, "phone": _PHONE}[kind].finditer(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind index, start, end) of the fixed patterns, by kind and start; time in proportion to the text."""
    return [(k, a, b) for k, kind in enumerate(KINDS) for a, b in _matches(kind, text) if _passes(kind, text[a:b])]


# Training samples -----------------------------------------------------------


def sample_text(rng, size: int) -> tuple[str, list[int]]:
    """Invented text of ``size`` characters or more with labelled spans and look-alikes, and its tags."""
    pick = lambda *xs: xs[rng.integers(len(xs))]
    number = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    small = lambda hi: str(rng.integers(0, hi))

    def word(lo=1, hi=11, letters="abcdefghijklmnopqrstuvwxyz"):
        return "".join(letters[c] for c in rng.integers(0, len(letters), rng.integers(lo, hi)))

    def wide(lo=1, hi=9):
        return word(lo, hi) + word(1, 3, "äöüéèñçåø") + word(1, 4)

    def email():
        name = pick(word(), number(2), f"{word()}.{word()}", f"{word()}_{number(3)}", f"{word()}+{word()}", wide())
        host, end = pick(word(), word() + number(1), wide(), f"{word()}-{word()}"), pick(word(2, 5), word(2, 8) + "." + word(2, 4))
        form = rng.integers(6)
        if form == 0:
            return f"{name}{pick(' [at] ', '[at]', ' (at) ', '(at)')}{host}.{word(2, 5)}"
        if form == 1:
            return f"{name} {pick('[at]', '(at)')} {host} {pick('[dot]', '(dot)')} {word(2, 5)}"
        return f"{name}@{host}.{end}"

    def ip():
        if rng.random() < 0.15:
            return ":".join("".join(rng.choice(list("0123456789abcdef"), 4)) for _ in range(8))
        return pick(".", ".", "[.]").join(small(256) for _ in range(4))

    def card():
        gap = pick("", " ", "-", ".", "/", "  ")
        return gap.join(number(4) for _ in range(4)) if gap else number(rng.integers(13, 20))

    def phone():
        a, b, c = number(3), number(3), number(4)
        return pick(
            f"+{small(99)} ({a}) {b}-{c}", f"+{small(99)} {a} {b} {c}", f"({a}) {b}-{c}", f"+{small(99)}{a}{b}{c}",
            f"+{small(99)}-{a}-{b}-{c}", f"({a}) {b} {c}", f"00{number(2)} {a} {b}{c}", f"{a}-{b}-{c}", f"0{a}/{b}{c}",
        )

    def other():
        return pick(
            number(rng.integers(1, 9)), f"{number(1)}.{number(1)}", f"{number(1)}.{number(2)}.{number(1)}",
            f"20{number(2)}-0{number(1)}-1{number(1)}", f"{small(24)}:{number(2)}", f"{small(999)},{number(3)}",
            f"v{small(9)}.{small(20)}", f"@{word()}", f"{number(3)}-{number(3)}", f"${small(999)}.{number(2)}",
            "".join(rng.choice(list("0123456789abcdef"), 24)), f"{word()}{number(2)}", f"{small(99)}%",
            f"AKIA{word(12, 13).upper()}{number(3)}", f"{word()}/{number(2)}/{word()}", f"{number(2)}.{number(2)}.{number(4)}",
            f"20{number(2)}-0{number(1)}-1{number(1)} {small(24)}:{number(2)}:{number(2)}", f"{small(24)}:{number(2)}:{number(2)}",
            f"{number(3)}.{number(3)}.{number(3)},{number(2)}", f"978-{number(1)}-{number(4)}-{number(4)}-{number(1)}",
            "".join(rng.choice(list("0123456789abcdef"), 16)), f"[{small(99)}]", f"({small(99)})", f"({word()}) {word()}",
            f"{number(4)}-{number(4)}", f"{number(10)}.{number(3)}", f"{small(99)}/{small(99)}/20{number(2)}",
        )

    makers = (email, ip, card, phone)
    text, tags = "", []
    while len(text) < size:
        kind = int(rng.integers(-5, 4))
        if kind >= 0:
            part = makers[kind]()
            own = [1 + 2 * kind, *[2 + 2 * kind] * (len(part) - 1)]
        else:
            prose = " ".join((wide() if rng.random() < 0.1 else word()) for _ in range(3))
            part = other() if kind <= -4 else prose.capitalize() if rng.random() < 0.2 else prose
            own = [0] * len(part)
        gap = pick(" ", " ", " ", ". ", ", ", "\n", "###", "$$$ ", ": ", " (", ") ", '" ', ".\n", " | ")
        text += part + gap
        tags += own + [0] * len(gap)
    return text, tags


def _sample_windows(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of n windows of invented text."""
    rng = np.random.default_rng(seed)
    s = np.full((n, WINDOW), _PAD, np.int8)
    y = np.zeros((n, WINDOW), np.int64)
    row = 0
    while row < n:
        text, tags = sample_text(rng, 8 * WINDOW)
        code = symbols(np.array([ord(c) for c in text]))
        for _ in range(8):
            # Some windows begin inside a span, as they do in real text; its tags stay as they are.
            at = int(rng.integers(0, len(text) - WINDOW))
            size = WINDOW if rng.random() < 0.8 else int(rng.integers(8, WINDOW))
            if row < n:
                s[row, :size] = code[at : at + size]
                y[row, :size] = tags[at : at + size]
                row += 1
    return s, y


@lru_cache(maxsize=1)
def trained_model() -> BiLstmCrf:
    """The model, trained on labelled windows made by rule; some ten seconds, once a driver."""
    allowed = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        allowed[:, 2 + 2 * k] = False
        allowed[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = True
    model = BiLstmCrf(SYMBOLS, TAGS, allowed, embed=12, hidden=24)
    model.fit(*_sample_windows(TRAIN_WINDOWS), steps=STEPS, batch=64)
    return model.float32()


# Decoding -------------------------------------------------------------------


def stretches(text: str, code: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of all characters within REACH of a mark, and of the runs of non-spaces that these touch."""
    mark = ((code >= 48) & (code <= 57)) | (code == 64)
    for m in _SPELLED_MARK.finditer(text):
        mark[m.start() : m.end()] = True
    at = np.flatnonzero(mark)
    if not len(at):
        return []
    space = np.flatnonzero((code == 32) | ((code >= 9) & (code <= 13)))
    low, high = np.maximum(at - REACH, 0), np.minimum(at + REACH, len(code) - 1)
    edge = np.concatenate([[-1], space, [len(code)]])
    first = edge[np.searchsorted(edge, low, "right") - 1] + 1
    last = edge[np.searchsorted(edge, high, "left")]
    first, last = np.minimum(first, low), np.maximum(last, high + 1)
    split = np.flatnonzero(first[1:] > np.maximum.accumulate(last)[:-1])
    begin = np.append(first[:1], first[split + 1])
    end = np.append(np.maximum.accumulate(last)[split], last.max())
    return list(zip(begin.tolist(), end.tolist(), strict=True))


def merged_scores(model: BiLstmCrf, parts: list[np.ndarray], at_once: int = 2048) -> list[np.ndarray]:
    """Scores (characters, tags) of each stretch of symbols: those of its windows, weighted by their context."""
    half = WINDOW // 2
    lengths = np.array([len(p) for p in parts], np.int64)
    many = np.maximum(1, -(-(lengths - half) // half))
    begin = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(parts)), many)
    place = (np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)) * half
    flat = np.concatenate([*parts, np.full(WINDOW, _PAD, np.int8)])
    total = int(lengths.sum())
    score, weight = np.zeros((total, TAGS), np.float32), np.zeros(total, np.float32)
    step = np.arange(WINDOW)
    for low in range(0, len(owner), at_once):
        own, first = owner[low : low + at_once], place[low : low + at_once]
        inside = first[:, None] + step < lengths[own][:, None]
        where = (begin[own] + first)[:, None] + step
        found = model.unary(np.where(inside, flat[np.minimum(where, len(flat) - 1)], _PAD)).transpose(1, 0, 2)
        # Context is counted to the window's ends; an end of the stretch takes none away.
        left = np.where(first[:, None] == 0, WINDOW, step + 1)
        right = np.where(first[:, None] + WINDOW >= lengths[own][:, None], WINDOW, WINDOW - step)
        share = np.minimum(left, right).astype(np.float32)
        for odd in (0, 1):
            # Of one parity no two windows of a stretch overlap.
            some = inside & ((first // half) % 2 == odd)[:, None]
            score[where[some]] += found[some] * share[some][:, None]
            weight[where[some]] += share[some]
    return np.split(score / weight[:, None], np.cumsum(lengths)[:-1]) if parts else []


def tag_stretches(model: BiLstmCrf, parts: list[np.ndarray]) -> list[np.ndarray]:
    """Tags of each stretch of symbols: one best path through the scores of all its windows."""
    return model.best_paths(merged_scores(model, parts))


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of runs of one kind; a first-character tag begins a new run."""
    kind = (tags.astype(np.int64) + 1) // 2
    cut = np.flatnonzero((np.diff(kind) != 0) | ((tags[1:] % 2 == 1) & (tags[1:] > 0))) + 1
    edges = [0, *cut.tolist(), len(tags)]
    return [(int(kind[a]) - 1, a, b) for a, b in zip(edges, edges[1:]) if b > a and kind[a]]


_ADDRESS = re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]+")
_SPELLED = re.compile(r"[^\s@\[\]()]+ ?[\[(]at[\])] ?[^\s@\[\]()]+?(( ?[\[(]dot[\])] ?|\.)[^\s@\[\]().]+)+", re.I)
_HIDDEN_IP = re.compile(r"[0-9]{1,3}(\[?\.\]?[0-9]{1,3}){3}")
_LONG_IP = re.compile(r"[0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4}){7}")
_CARD_FORM = re.compile(r"[0-9]+([ ./-]{1,2}[0-9]+)*")
_PHONE_FORM = re.compile(r"[+(0-9][0-9]*([ ()./-]{1,2}[0-9]+)*")


def _plausible(kind: int, text: str, lo: int, hi: int) -> bool:
    """An added span is whole enough to be what it is called, and no part of a longer number."""
    piece = text[lo:hi]
    if piece[0] in "0123456789" and text[lo - 1 : lo].isdigit() or piece[-1] in "0123456789" and text[hi : hi + 1].isdigit():
        return False
    digits = "".join(_DIGITS.findall(piece))
    if KINDS[kind] == "email":
        return bool(_ADDRESS.fullmatch(piece) or _SPELLED.fullmatch(piece))
    if KINDS[kind] == "ip":
        if _LONG_IP.fullmatch(piece):
            return True
        return bool(_HIDDEN_IP.fullmatch(piece)) and all(int(p) <= 255 for p in re.findall("[0-9]+", piece))
    if KINDS[kind] == "card":
        return bool(_CARD_FORM.fullmatch(piece)) and 13 <= len(digits) <= 19 and luhn(digits)
    return bool(_PHONE_FORM.fullmatch(piece)) and 9 <= len(digits) <= 15


_SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
)


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_personal_data(docs: DataFrame, model: BiLstmCrf | None = None) -> DataFrame:
    """One row per row of ``docs``: counts of base spans, digest of base spans, all spans, n_added.

    Added spans touch no base span.  Positions are code points, end exclusive.
    Null texts count as empty; repeated rows keep a row each; an empty table
    gives an empty result.  Other columns are ignored.
    """
    model = model or trained_model()

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            raw = data.tobytes()
            # Texts without any mark hold no span of any kind; a spelled one has a closing bracket.
            mark = ((data >= 48) & (data <= 57)) | (data == 64) | (data == 41) | (data == 93)
            marked = np.diff(np.concatenate([[0], np.cumsum(mark)])[offsets]) > 0
            base: dict[int, list] = {}
            added: dict[int, list] = {}
            held: list = []

            def add(held=held, base=base, added=added):
                found = tag_stretches(model, [part for *_, part in held])
                for (row, text, a, _), tags in zip(held, found, strict=True):
                    for k, lo, hi in spans_of(tags):
                        if not any(lo + a < e and s < hi + a for _, s, e in base[row]) and _plausible(k, text, lo + a, hi + a):
                            added.setdefault(row, []).append((k, lo + a, hi + a))
                held.clear()

            size = 0
            for row in np.flatnonzero(marked).tolist():
                text = raw[offsets[row] : offsets[row + 1]].decode()
                base[row] = base_spans(text)
                code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                for a, b in stretches(text, code):
                    held.append((row, text, a, symbols(code[a:b])))
                    size += b - a
                if size > DECODED:
                    add()
                    size = 0
            add()
            rows = []
            for row in range(batch.num_rows):
                own, more = base.get(row, []), added.get(row, [])
                counts = [sum(1 for k, _, _ in own if k == j) for j in range(len(KINDS))]
                rows.append((*counts, hashlib.sha256(_shown(own).encode()).hexdigest(), _shown(own + more), len(more)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()]
            columns = [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [x.split()[0] for x in _SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _SCHEMA)
