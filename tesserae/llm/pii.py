"""Personal data by a linear-chain conditional random field over word shapes.

Exact patterns give the base spans. The field, trained on the driver from a small labelled table, reads the shapes of all
words of a line, with two neighbours on both sides, and labels what the patterns leave out: numbers without a country
code, cards that fail the check digit, identity numbers, and addresses that are spelled out (``jane at example dot
com``). Names of persons are no kind of it. Tasks decode every line whole by Viterbi in numpy batches, a line that repeats
once.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import map_rows, sha256_hex, span_string

# The base patterns of the contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
KINDS = ("email", "ip", "card", "phone")

LABELS = ("O", "email", "ip", "card", "phone", "id")
#: Kinds of the field's own spans.
CRF_KINDS = tuple(f"crf_{x}" for x in LABELS[1:])
#: Sentences of the labelled table, and its seed.
TRAIN_ROWS, TRAIN_SEED = 1500, 10
#: Words of lines that are decoded together, at most, but for a longer line.
MAX_CELLS = 200_000
_RANK = {k: i for i, k in enumerate(KINDS + CRF_KINDS)}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their at signs, so that long runs of letters cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    spans = [(a, 0, "email", b) for a, b in emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                spans.append((m.start(), 1, "ip", m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                spans.append((m.start(), 2, "card", m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                    spans.append((m.start(), 3, "phone", m.end()))
    return spans


# --- shapes ---------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\S+")
_EDGE = "\"'()[]{}<>.,;:!?*%&#$|"
_CUES = {
    "email": "email", "mail": "email", "phone": "phone", "tel": "phone", "call": "phone", "mobile": "phone", "fax": "phone",
    "card": "card", "visa": "card", "mastercard": "card", "ssn": "id", "passport": "id", "ip": "ip", "address": "ip", "at": "at", "dot": "dot",
    "com": "tld", "org": "tld", "net": "tld", "edu": "tld", "gov": "tld", "io": "tld",
}
def coarse(token: str, features: tuple[str, ...]) -> str:
    """What neighbours see of a word: its class, or that it has an at sign, or the short shape of its numbers."""
    first = features[0]
    if first in ("dotted", "Dotted"):
        return "host" if features[2] == "end-tld" else features[1]
    return first if is_plain(token) else "has-at" if "@" in token and "[@]" not in token and "(@)" not in token else first if len(first) <= 8 else "numbers"


_RUNS = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[^0-9a-zA-Z]")


def is_plain(token: str) -> bool:
    return "@" not in token and not _DIGITS.search(token)


def shape(token: str) -> tuple[str, ...]:
    """Features of a word, the coarse shape first; plain words, without digits and at signs, have one of a few classes."""
    if is_plain(token):
        core = token.strip(_EDGE)
        if cue := _CUES.get(core.lower()):
            return (f"cue-{cue}" if core == token or cue not in ("at", "dot") or token[0] not in "[({<" else f"cue-[{cue}]",)
        if not core:
            return ("marks",)
        if "." in core and core.replace(".", "").replace("_", "").replace("-", "").isalpha():
            return ("dotted" if core.islower() else "Dotted", "lower" if core.islower() else "cap", "end-tld" if _CUES.get(core.rpartition(".")[2].lower()) == "tld" else "end-other")
        return ("lower" if core.islower() else "upper" if core.isupper() and len(core) > 1 else "cap" if core[0].isupper() and core[1:].islower() or len(core) == 1 else "mixed",)
    core = token.strip(_EDGE.replace("(", "").replace(")", "")) or token
    runs = _RUNS.findall(core)
    short = "".join("d" if r[0].isdigit() else "x" if r[0].islower() else "X" if r.isalpha() and r.isascii() else r for r in runs)
    groups = [len(r) for r in runs if r[0].isdigit()]
    n = sum(groups)
    return (
        f"s:{short}" if len(short) <= 24 else "s:long",
        f"n:{min(n, 20)}",
        f"g:{'-'.join(map(str, groups))}" if len(groups) <= 6 else "g:many",
        f"l:{'x' in short.lower()}:{'@' in core}:{core.count('.')if core.count('.')<4 else 4}",
    )


# --- the labelled table -----------------------------------------------------------------------------------------------

_FRAMES = (
    "please write to {email} before noon", "her address is {email} and his is {email}", "contact {email}.", "email {email} or call {phone}",
    "call {phone} today", "my number is {phone}, thanks", "Tel {phone} in the office", "fax {phone} and mail {email}", "reach us at {phone} or {phone}",
    "the card {card} was charged", "Visa {card} expires soon", "pay with {card} please", "it is card number {card}.", "the server {ip} is down",
    "traffic from {ip} to {ip} was blocked", "host {ip} answered", "ssn {id} on file", "passport {id} was lost", "her number {id} is on the form",
    "in {year} there were {count} people", "version {version} of the file", "on {date} at {time} they met", "see page {count} of {count}",
    "it costs {price} in {year}", "the code {hex} is a digest", "token = \"{hex}\" was found", "room {count}, floor {count}", "about {big} units were sold",
    "order {order} shipped on {date}", "chapter {version} and table {version}", "the ratio was {price} in {version}", "a {count} b {count} c {count}",
    "Licensed under the Apache License, Version {version}.", "under CC BY-NC {version}.", "Then they went home and slept.", "THE END OF IT ALL", "as of {year}, {big} items",
    "write to {spelled} for more", "{spelled}", "ask {spelled} or {email}", "mail me: {spelled}", "you can reach me at {spelled}, any time", "Contact {spelled}.", "my address is {spelled} and I read it",
    "The form goes to {spelled} by noon", "send it to {spelled}", "or {spelled} if need be, or call {phone}", "{spelled} is my address", "Jane Doe, {spelled}", "questions? {spelled} answers them", "try {spelled} at {time}",
    "they met at noon and left at once", "look at the dot in the middle of the page", "the dot com bubble burst in {year}", "at home or at work, at {time} or later", "she works at example.org and at home",
    "See example.com for the rest of it", "the word dot was at the end", "He stood at Point Break at {time}", "click at the dot to go on", "The Net was full at last", "de la part de la com", "Uk and De are at the top of it.",
    "Einer der Leute kam um {time} an", "call me later, my mobile is broken", "the visa card is in the mail", "Phone, mail and fax were down at the office", "IP address and email are not given here", "{again}", "{again}", "so {again}",
    "lines {count}-{count} of {order}", "{hex} {hex}", "{year}-{year} {count}%", "und {email} the thing", "of the {ip} and so {card} on",
)


def _value(kind: str, r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 8)))
    match kind:
        case "email":
            local = r.choice([w(), f"{w()}.{w()}", f"{w()}{d(2)}", f"{w()}.{d(2)}", f"{w()}_{w()}"])
            return r.choice([f"{local}@{w()}.{w()[:3]}", f"{local}@{w()}{d(1)}.{w()}.com", f"{local}[@]{w()}.com", f"{local}(@){w()}.org"])
        case "spelled":
            at, dot = r.choice([(" at ", " dot "), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", "."), (" [at] ", "."), (" AT ", " DOT "), (" (at) ", ".")])
            local, host = r.choice([w(), w(), f"{w()}.{w()}", f"{w()}_{w()}", f"{w()}{d(2)}", f"{w().capitalize()}.{w()}"]), r.choice([w(), w(), "example", f"{w()}{dot}{w()}"])
            return f"{local}{at}{host}{dot}{r.choice(['com', 'org', 'net', 'edu', 'gov', 'io'])}"
        case "again":
            return " ".join([r.choice(["at", "dot", "com", "de", "la", "At", "phone", w(), "."])] * r.randint(2, 9))
        case "phone":
            return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(3)} {d(4)}", f"0{d(3)} {d(3)} {d(4)}"])
        case "card":
            sep = r.choice(["", "-", " ", ""])
            return sep.join(d(4) for _ in range(4)) if r.random() < 0.8 else d(4) + sep + d(6) + sep + d(5)
        case "ip":
            return ".".join(str(r.randint(1, 255)) for _ in range(4))
        case "id":
            return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}"])
        case "year":
            return str(r.randint(1700, 2099))
        case "count":
            return str(r.choice([r.randint(0, 9), r.randint(10, 999), r.randint(1000, 99999)]))
        case "big":
            return r.choice([f"{r.randint(1, 999)},{d(3)}", f"{r.randint(1, 99)},{d(3)},{d(3)}", d(7), d(9), f"{r.randint(1, 99)}.{d(3)}.{d(3)}"])
        case "version":
            return r.choice([f"{r.randint(0, 30)}.{r.randint(0, 30)}", f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 30)}", d(1)])
        case "date":
            return r.choice([f"{r.randint(1900, 2099)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}.{d(2)}.{d(4)}", f"{d(4)}/{d(2)}/{d(2)}"])
        case "time":
            return f"{r.randint(0, 23)}:{d(2)}"
        case "price":
            return r.choice(["$", "", "£"]) + f"{r.randint(0, 9999)}.{d(2)}"
        case "hex":
            return "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 16, 32, 40, 64])))
        case _:
            return r.choice([f"#{d(6)}", f"A{d(5)}", f"{w()[:2].upper()}-{d(4)}", f"{d(8)}", f"x{d(3)}y"])


def labelled_table(n: int = TRAIN_ROWS, seed: int = TRAIN_SEED) -> list[tuple[list[str], list[int]]]:
    """Sentences with a label for each word; a value of several words has its label on all of them."""
    r, out = random.Random(seed), []
    for i in range(n):
        words, labels = [], []
        for part in re.split(r"(\{\w+\})", _FRAMES[i % len(_FRAMES)]):
            kind = part[1:-1] if part.startswith("{") else ""
            text = _value(kind, r) if kind else part
            y = LABELS.index(kind) if kind in LABELS else LABELS.index("email") if kind == "spelled" else 0
            glued = bool(words) and not text[:1].isspace() and not last.isspace()  # noqa: F821
            for k, w in enumerate(text.split()):
                if k == 0 and glued:
                    words[-1] += w
                    labels[-1] = labels[-1] or y
                else:
                    words.append(w)
                    labels.append(y)
            last = text[-1:] or " "
        if r.random() < 0.2:  # marks that junk text hangs on words
            words = [w + r.choice(["###", "***", "%%%", "$$$"]) for w in words]
        out.append((words, labels))
    return out


# --- the field ----------------------------------------------------------------------------------------------------------


class Field:
    """Weights of (feature, label) at the word, of coarse shapes of its neighbours and of couples of them, and of label pairs."""

    #: Where the neighbours are whose coarse shapes count.
    OFFSETS = (-2, -1, 1, 2)

    def __init__(self, features: dict[str, int], coarse: dict[str, int]):
        n = len(LABELS)
        self.features, self.coarse = features, coarse
        self.own = np.zeros((len(features) + 1, n))
        #: By offset and coarse shape; a shape that the table lacks, and one for no neighbour, are the last two.
        self.near = np.zeros((len(self.OFFSETS), len(coarse) + 2, n))
        #: By the coarse shapes of two words in a row, from the second and the first before to the first and the second after.
        self.couples = np.zeros((len(self.OFFSETS), (len(coarse) + 2) ** 2, n))
        self.pairs = np.zeros((n, n))
        self.joined: np.ndarray | None = None
        self.numbers: dict[str, int] = {}
        self.rows, self.kinds = np.zeros((1024, n)), np.zeros(1024, np.int64)

    def both(self) -> np.ndarray:
        """The tables of couples with those of single neighbours in them, made once training is over."""
        if self.joined is None:
            n = len(self.coarse) + 2
            first = np.repeat(np.arange(n), n)
            sides = (first, first, np.tile(np.arange(n), n), np.tile(np.arange(n), n))
            self.joined = self.couples + np.stack([near[side] for near, side in zip(self.near, sides)])
        return self.joined

    def number(self, token: str) -> int:
        """The word's place among the words seen last, whose own scores and coarse shapes are kept."""
        if (known := self.numbers.get(token)) is None:
            known = self.numbers[token] = len(self.numbers)
            if known == len(self.rows):
                self.rows, self.kinds = np.resize(self.rows, (2 * known, len(LABELS))), np.resize(self.kinds, 2 * known)
            s = shape(token)
            self.rows[known] = sum((self.own[self.features[f]] for f in s if f in self.features), np.zeros(len(LABELS)))
            self.kinds[known] = self.coarse.get(coarse(token, s), len(self.coarse))
        return known

    def scores(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of lines of words, padded to the longest, (lines, words, labels), and the numbers of their words."""
        if len(self.numbers) > 200_000:
            self.numbers.clear()
        longest = max(map(len, lines))
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        mask = np.arange(longest) < lengths[:, None]
        numbers = np.zeros(mask.shape, np.int64)
        numbers[mask] = np.fromiter(map(self.number, chain.from_iterable(lines)), np.int64, int(lengths.sum()))
        kinds = np.full((len(lines), longest + 4), len(self.coarse) + 1)
        kinds[:, 2:-2] = np.where(mask, self.kinds[numbers], len(self.coarse) + 1)
        out = self.rows[numbers]
        couple = kinds[:, :-1] * (len(self.coarse) + 2) + kinds[:, 1:]
        for k, table in enumerate(self.both()):
            out += table[couple[:, k : k + longest]]
        return out, lengths


@lru_cache(maxsize=1)
def trained(n: int = TRAIN_ROWS, seed: int = TRAIN_SEED, rounds: int = 150, rate: float = 0.2, decay: float = 2e-4) -> Field:
    """Maximum likelihood by Adam over the labelled table, as one padded batch; scaled forward and backward sums in numpy."""
    data = labelled_table(n, seed)
    feats: dict[str, int] = {}
    kinds: dict[str, int] = {}
    for words, _ in data:
        for w in words:
            s = shape(w)
            kinds.setdefault(coarse(w, s), len(kinds))
            for f in s:
                feats.setdefault(f, len(feats))
    field = Field(feats, kinds)
    m, t, k = len(data), max(len(w) for w, _ in data), len(LABELS)
    x = np.full((m, t, 4), len(feats))
    near = np.full((len(Field.OFFSETS), m, t + 4), len(kinds) + 1)
    y, mask = np.zeros((m, t), int), np.zeros((m, t), bool)
    for i, (words, labels) in enumerate(data):
        shapes = [shape(w) for w in words]
        for j, s in enumerate(shapes):
            x[i, j, : len(s)] = [feats[f] for f in s]
            near[:, i, j + 2] = kinds[coarse(words[j], s)]
        y[i, : len(labels)], mask[i, : len(labels)] = labels, True
    couple = near[0, :, :-1] * (len(kinds) + 2) + near[0, :, 1:]
    couple = np.stack([couple[:, c : c + t] for c in range(len(Field.OFFSETS))])
    near = np.stack([n[:, 2 + step : 2 + step + t] for n, step in zip(near, Field.OFFSETS)])
    params = [field.own, *field.near, *field.couples, field.pairs]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    places = [x[..., c][mask] for c in range(4)]
    beside = [(n[mask], len(kinds) + 2) for n in near] + [(c[mask], (len(kinds) + 2) ** 2) for c in couple]
    gold = np.eye(k)[y] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    for step in range(1, rounds + 1):
        e = np.zeros((m, t, k))
        e[mask] = sum(field.own[place] for place in places) + sum(p[place] for p, (place, _) in zip(params[1:], beside))
        e, links = np.exp(e - e.max(2, keepdims=True)), np.exp(field.pairs - field.pairs.max())
        alpha, sums = [e[:, 0] / e[:, 0].sum(1, keepdims=True)], []
        for j in range(1, t):
            a = (alpha[-1] @ links) * e[:, j]
            sums.append(np.where(mask[:, j], a.sum(1), 1.0)[:, None])
            alpha.append(np.where(mask[:, j, None], a / sums[-1], alpha[-1]))
        beta = [np.ones((m, k))]
        for j in range(t - 1, 0, -1):
            beta.append(np.where(mask[:, j, None], (e[:, j] * beta[-1]) @ links.T / sums[j - 1], beta[-1]))
        alpha, beta, sums = np.stack(alpha, 1), np.stack(beta[::-1], 1), np.stack(sums, 1)
        node = alpha * beta * mask[..., None]
        right = np.where(both[..., None], e[:, 1:] * beta[:, 1:] / sums, 0.0)
        pair = links * np.einsum("ijk,ijl->kl", alpha[:, :-1], right)
        grads = [np.zeros_like(p) for p in params]
        d = (gold - node)[mask]
        total = lambda where, size: np.stack([np.bincount(where, d[:, c], size) for c in range(k)], 1)
        for place in places:
            grads[0] += total(place, len(feats) + 1)
        for grad, (place, size) in zip(grads[1:], beside):
            grad += total(place, size)
        grads[-1] += np.einsum("ijk,ijl->kl", gold[:, :-1] * both[..., None], gold[:, 1:]) - pair
        grads[0][-1] = 0  # no feature
        for p, g, f, s in zip(params, grads, first, second):
            g = g / m - decay * p
            f += 0.1 * (g - f)
            s += 0.001 * (g * g - s)
            p += rate * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return field


def viterbi(scores: np.ndarray, pairs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of sequences of given lengths, padded to (n, t, labels); O, which is 0, beyond their ends."""
    n, t, k = scores.shape
    best, same = scores[:, 0], np.arange(k, dtype=np.int8)
    back = np.zeros(scores.shape, np.int8)
    for j in range(1, t):
        path = best[:, :, None] + pairs
        on = (j < lengths)[:, None]
        back[:, j] = np.where(on, path.argmax(1), same)
        best = np.where(on, path.max(1) + scores[:, j], best)
    labels = np.zeros((n, t), np.int8)
    labels[:, -1] = best.argmax(1)
    for j in range(t - 1, 0, -1):
        labels[:, j - 1] = back[np.arange(n), j, labels[:, j]]
    return np.where(np.arange(t) < lengths[:, None], labels, 0)


def crf_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, str, int]]]:
    """The field's spans of each text: runs of words of one label in a line, without the marks at their edges."""
    lines = {line for text in texts for line in text.split("\n")}
    words = sorted(((line.split(), line) for line in lines), key=lambda w: len(w[0]))
    found: dict[str, list[tuple[int, int, int, int]]] = {}
    at = 0
    while at < len(words):
        end = at + 1
        if not words[at][0]:
            at = end
            continue
        while end < len(words) and len(words[end][0]) * (end - at + 1) <= MAX_CELLS and len(words[end][0]) <= 1.25 * len(words[at][0]) + 4:
            end += 1
        part = words[at:end]
        scores, lengths = field.scores([w for w, _ in part])
        labels = viterbi(scores, field.pairs, lengths)
        for row in np.flatnonzero(labels.any(1)).tolist():
            found[part[row][1]] = _runs(part[row][1], labels[row].tolist())
        at = end
    out: list[list[tuple[int, int, str, int]]] = []
    for text in texts:
        spans, at = [], 0
        for line in text.split("\n") if found else ():
            spans += [(at + a, rank, kind, at + b) for a, rank, kind, b in found.get(line, ())]
            at += len(line) + 1
        out.append(spans)
    return out


def _runs(line: str, labels: list[int]) -> list[tuple[int, int, str, int]]:
    out = []
    words = [m.span() for m in _TOKEN.finditer(line)]
    for y, group in groupby(range(len(words)), key=labels.__getitem__):
        if y:
            places = list(group)
            a, b = words[places[0]][0], words[places[-1]][1]
            while a < b and line[a] in _EDGE.replace("(", ""):
                a += 1
            while a < b and line[b - 1] in _EDGE:
                b -= 1
            if a < b:
                kind = f"crf_{LABELS[y]}"
                out.append((a, _RANK[kind], kind, b))
    return out


def all_spans(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base, added) spans of each text; what overlaps a base span is not added."""
    out = []
    for text, more in zip(texts, crf_spans(texts, field)):
        base = base_spans(text)
        added = [s for s in more if not any(s[0] < b[3] and b[0] < s[3] for b in base)] if len(base) * len(more) < 10_000 else _apart(more, base)
        out.append((base, added))
    return out


def _apart(spans: list, others: list) -> list:
    """Spans that overlap none of the others, by a sweep over both."""
    ends, starts = np.maximum.accumulate([b[3] for b in sorted(others)]), np.array([b[0] for b in sorted(others)])
    k = np.searchsorted(starts, [s[3] for s in spans])  # others that start before the span ends
    return [s for s, n in zip(spans, k) if n == 0 or ends[n - 1] <= s[0]]


def find(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each whole text of ``docs``, one row for each row.

    A null or empty text has none. Spans are in code points, end exclusive. Rows are independent and nothing is
    shuffled; extra columns are ignored.
    """
    field = field or trained()

    def rows(batches):
        held: list[tuple] = []
        n = 0
        for row in batches:
            held.append(row)
            n += len(row[1] or "") + 100  # rows without text are not free either
            if n > 4_000_000:
                yield from decoded(held)
                held, n = [], 0
        yield from decoded(held)

    def decoded(held):
        for (doc_id, _), (base, added) in zip(held, all_spans([t or "" for _, t in held], field)):
            kinds = [s[2] for s in base]
            yield doc_id, *(kinds.count(k) for k in KINDS), sha256_hex(span_string(base)), span_string(base + added)

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string")]
    return map_rows(docs, columns, rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked_text(text: str, spans: list[tuple[int, int, str, int]]) -> str:
    """The text with each span, overlaps joined, replaced by the name of its kind."""
    out, done = [], 0
    for a, _, kind, b in sorted(spans, key=lambda s: (s[0], -s[3])):
        if a >= done:
            out += [text[done:a], f"<{kind.removeprefix('crf_').upper()}>"]
        done = max(done, b)
    return "".join(out) + text[done:]


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` masked; other columns, nulls and texts without any stay as they are."""
    field = field or trained()

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for at in range(0, len(texts), 1000):
            part = texts.slice(at, 1000).to_pylist()
            found = all_spans([t or "" for t in part], field)
            out += [None if t is None else masked_text(t, base + added) if base or added else t for t, (base, added) in zip(part, found)]
        return pa.array(out, pa.string())

    return docs.withColumn("text", masked(F.col("text").cast("string")))
