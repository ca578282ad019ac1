"""Secret scan by assignment-aware lexing.

Three plain patterns give the base spans. Beyond them, source and configuration syntax is lexed into pairs of a target
name and a literal: assignments and mappings of most languages, type annotations, quoted strings of one or three marks,
block scalars, elements and their attributes, calls (``setPassword("...")``, ``put("password", "...")``), long options
and the password of a URL. Constants are followed through names (``k = "..."`` then ``password = k``), parts of a
concatenation are kept together, and a literal is reported when the sensitivity of its target's name and its own shape
score high enough together. All of it is linear in the text, whatever the text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import map_rows, sha256_hex, span_string

# The base patterns of the contract, by kind, in the order of their rank.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # runs are maximal, so the shortest length can stand in the pattern
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "pair", "const")

#: How sensitive a name is: the largest weight of a word, or of two words in a row, in it.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "api key": 1.0,
    "access key": 1.0, "private key": 1.0, "secret key": 1.0, "signing key": 0.9, "encryption key": 0.9, "credential": 0.9,
    "credentials": 0.9, "auth": 0.7, "authorization": 0.8, "bearer": 0.8, "client secret": 1.0, "connection string": 0.8,
}
#: Values that stand for a secret without being one.
PLACEHOLDER = re.compile(r"(?i)^(?:change.?me|example.*|placeholder|your[_-].*|none|null|nil|true|false|undefined|todo|test|x{3,}|\*+|\.{3,}|<.*>|env|string)$")
THRESHOLD = 0.5

_OP = re.compile(r":=|=>|\?=|(?<![=!<>:])[:=](?![=:])")
_NAME_SIGNS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_$.-")
_FIRST = re.compile(r"[A-Za-z_$]")
_QUOTED = re.compile(r"""\"""(.+?)\"""|\'\'\'(.+?)\'\'\'|"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`((?:[^`\\]|\\.)*+)`""", re.DOTALL)
_BARE = re.compile(r"""[^\s,;#"'`<>()\[\]{}+]+""")
_REF = re.compile(r"\$?\{?([A-Za-z_$][\w$.]*)\}?\Z", re.ASCII)
_ANNOTATED = re.compile(r"[ \t]*(?:\[[\w ,.|]*\][ \t]*)?=(?!=)[ \t]*")
_BLOCK = re.compile(r"[|>][-+0-9]{0,2}[ \t]*\n")
_LINE = re.compile(r"([ \t]*)([^\n]*)\n?")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:\-]*+)(?:\s[^<>]*+)?>\s*(?:<!\[CDATA\[([^\]<]*+)\]\]>|([^<>]++))</\1\s*>", re.ASCII)
_ATTRIBUTES = re.compile(r"""\b(?:key|name)\s*=\s*"([^"\n<>]*+)"\s+value\s*=\s*"([^"\n<>]*+)\"""")
_CALL = re.compile(r"""(?<![\w$])([A-Za-z_$][\w$]*+)[ \t]*\(\s*(?:"([^"\\\n]*+)"|'([^'\\\n]*+)')\s*(?:,\s*(?:"([^"\\\n]*+)"|'([^'\\\n]*+)')\s*)?[,)]""", re.ASCII)
_OPTION = re.compile(r"""(?<!\S)--([A-Za-z][\w\-]*+)[ \t]+(?:"([^"\n]*+)"|'([^'\n]*+)'|([^\s\-"'<>][^\s"'<>]*+))""", re.ASCII)
_USERINFO = re.compile(r"://[^\s:/@]*+:([^\s:/@]++)@")
#: A word of an authorization scheme before its token, and a block of a private key, which may span lines.
_SCHEME = re.compile(r"(?i)(?:bearer|basic)[ \t]+")
_PEM = re.compile(r"""(?:["'`]{1,3}|[|>][-+]?)?\s*(-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----)""")
_PEM_HEAD = re.compile(r"\s*-----BEGIN [A-Z ]*PRIVATE KEY-----")
#: Words that sentences have and passphrases seldom.
_PROSE = re.compile(r"(?i)\b(?:a|an|and|are|be|can|cannot|do|enter|for|from|in|is|it|must|no|not|of|on|or|please|that|the|this|to|was|with|you|your)\b")
_SPACE = re.compile(r"[ \t]*")
_PLUS = re.compile(r"[ \t]*(?:\+|\.\.)[ \t]*")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_weight(name: str) -> float:
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return max((NAME_WEIGHTS.get(w, 0.0) for w in words + pairs), default=0.0)


class Value:
    """What the score of a value depends on, so that values are put together without their texts."""

    __slots__ = ("counts", "head", "last", "n", "prose", "quoted", "spaced")

    def __init__(self, text: str = "", quoted: bool = False):
        self.n, self.head, self.last, self.quoted = len(text), text[:80], text[-1:], quoted
        self.counts = Counter(text)
        self.spaced = any(c.isspace() for c in text.strip())
        self.prose = self.spaced and bool(_PROSE.search(text))

    def add(self, other: Value) -> None:
        self.head = (self.head + other.head)[:80] if self.n < 80 else self.head
        self.n, self.last = self.n + other.n, other.last or self.last
        self.counts.update(other.counts)
        self.quoted, self.spaced, self.prose = self.quoted or other.quoted, self.spaced or other.spaced, self.prose or other.prose

    def score(self) -> float:
        """0 to 1: long, mixed, high-entropy values and private keys score high, placeholders, plain words and sentences low."""
        if _PEM_HEAD.match(self.head):
            return 1.0
        if self.n < 8 or PLACEHOLDER.match(self.head if self.n <= 80 else self.head + self.last):
            return 0.0
        entropy = -sum(c / self.n * math.log2(c / self.n) for c in self.counts.values())
        classes = sum(any(kind(c) for c in self.counts) for kind in (str.isdigit, str.islower, str.isupper))
        score = 0.25 * (classes - 1) + 0.2 * min(entropy, 4) - 0.2
        if self.spaced:
            score -= 0.6 if self.prose else 0.15
        return max(0.0, min(1.0, score + (0.2 if self.quoted else 0.0)))


def literal_score(value: str, quoted: bool) -> float:
    return Value(value, quoted).score()


def _name_before(text: str, low: int, end: int) -> str:
    """The name that ends at ``end``, but for blanks, a bracket and a quote; read backwards, no further than ``low``."""
    while end > low and text[end - 1] in " \t":
        end -= 1
    if end > low and text[end - 1] == "]":
        end -= 1
    if end > low and text[end - 1] in "\"'`":
        end -= 1
    start = end
    while start > low and text[start - 1] in _NAME_SIGNS:
        start -= 1
    first = _FIRST.search(text, start, end)
    return text[first.start() : end] if first else ""


def _block(text: str, op: int, at: int) -> tuple[int, int]:
    """Start and end of the lines from ``at`` that are indented more than the line of ``op``, blank ones among them."""
    line = text.rfind("\n", 0, op) + 1
    indent = len(text[line:op]) - len(text[line:op].lstrip(" \t-"))
    start = end = at
    while at < len(text):
        m = _LINE.match(text, at)
        if m[2].strip() and len(m[1]) <= indent:
            break
        if m[2].strip():
            start, end = start if end > start else m.start(2), m.end(2)
        at = m.end()
    return start, end


def _terms(text: str, at: int) -> tuple[list[tuple], int]:
    """The value at ``at``: terms ('lit', start, end, quoted) or ('ref', name, start, end), and where it ends."""
    terms, done = [], at
    while True:
        if (m := _QUOTED.match(text, at)) and (m.end() - m.start() > 2 or not _PEM.match(text, at)):
            start, end = _stripped(text, *m.span(m.lastindex)) if m.lastindex < 3 else m.span(m.lastindex)
            scheme = _SCHEME.match(text, start, end)
            terms.append(("lit", scheme.end() if scheme else start, end, True))
        elif m := _PEM.match(text, at):
            terms.append(("lit", m.start(1), m.end(1), True))
        elif m := ((scheme := _SCHEME.match(text, at)) and _BARE.match(text, scheme.end())) or _BARE.match(text, at):
            ref = _REF.match(m[0])
            terms.append(("ref", ref[1], m.start(), m.end()) if ref else ("lit", m.start(), m.end(), False))
        else:
            return terms, done
        done = m.end()
        if not (plus := _PLUS.match(text, done)):
            return terms, done
        at = plus.end()


def _stripped(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    return end - len(part.lstrip()), start + len(part.rstrip())


def _found(m: re.Match, name: str, *groups: int) -> tuple[str, int, list[tuple]]:
    g = next(g for g in groups if m[g] is not None)
    return name, m.start(), [("lit", *_stripped(m.string, *m.span(g)), True)]


def assignments(text: str) -> list[tuple[str, int, list[tuple]]]:
    """(target, position, terms) by position; a term is ('lit', start, end, quoted) or ('ref', name, start, end)."""
    out, done = [], 0
    for op in _OP.finditer(text) if "=" in text or ":" in text else ():
        if op.start() < done:
            continue  # inside a literal that has been read
        if not (name := _name_before(text, done, op.start())):
            continue
        at = _SPACE.match(text, op.end()).end()
        if (block := _BLOCK.match(text, at)) and not _PEM.match(text, at):
            # what is inside a block may be assignments too, so reading goes on there
            if name_weight(name) and (span := _block(text, op.start(), block.end()))[1] > span[0]:
                out.append((name, op.start(), [("lit", *span, True)]))
            continue
        terms, end = _terms(text, at)
        if terms and op[0] == ":" and terms[0][0] == "ref" and len(terms) == 1 and (eq := _ANNOTATED.match(text, end)):
            terms, end = _terms(text, eq.end())  # a type stood before the value
        if terms:
            out.append((name, op.start(), terms))
            done = end
    more = []
    if "</" in text:
        more += [_found(m, m[1], 2, 3) for m in _ELEMENT.finditer(text)]
    if "value" in text:
        more += [_found(m, m[1], 2) for m in _ATTRIBUTES.finditer(text)]
    if "(" in text:
        for m in _CALL.finditer(text):
            two = m[4] is not None or m[5] is not None
            more.append(_found(m, (m[2] or m[3] or "") if two else m[1], *((4, 5) if two else (2, 3))))
    if "--" in text:
        more += [_found(m, m[1], 2, 3, 4) for m in _OPTION.finditer(text)]
    if "://" in text:
        more += [_found(m, "password", 1) for m in _USERINFO.finditer(text)]
    return sorted(out + [a for a in more if a[0]], key=lambda a: a[1])


def lexed_spans(text: str) -> list[tuple[int, int, str, int]]:
    """Spans of literals that reach a sensitive target: kind pair where assigned directly, const where by way of a name.

    A name means its latest earlier assignment, else its first. Each assignment's value is put together once.
    """
    found = assignments(text)
    heavy = [name_weight(name) for name, _, _ in found]
    if not any(heavy):
        return []
    targets: dict[str, list[int]] = {}
    for i, (name, _, _) in enumerate(found):
        targets.setdefault(name, []).append(i)

    def meant(name: str, at: int) -> int | None:
        known = targets.get(name)
        return None if known is None else known[max(0, bisect_left(known, at) - 1)]

    values: dict[int, Value] = {}
    refs: dict[int, list[int]] = {}

    def value(i: int) -> Value:
        """Of assignment i, by way of names; a name that leads back to itself adds nothing."""
        todo = [i]
        while todo:
            at = todo[-1]
            if at not in refs:
                met = [meant(t[1], at) for t in found[at][2] if t[0] == "ref"]
                refs[at] = [k for k in met if k is not None and k != at]
                todo += [k for k in refs[at] if k not in refs]
                continue
            todo.pop()
            if at in values:
                continue
            values[at] = whole = Value()
            for term in found[at][2]:
                if term[0] == "lit":
                    whole.add(Value(text[term[1] : term[2]], term[3]))
                elif (k := meant(term[1], at)) is None:
                    whole.add(Value(text[term[2] : term[3]]))  # a bare value, not a name of this text
                elif k != at and k in values:
                    whole.add(values[k])
        return values[i]

    def own(i: int) -> list[tuple[int, int]]:
        return [(t[1], t[2]) if t[0] == "lit" else (t[2], t[3]) for t in found[i][2] if t[0] == "lit" or meant(t[1], i) is None]

    spans, reached = set(), set()
    for i, weight in enumerate(heavy):
        if weight and weight * value(i).score() >= THRESHOLD:
            spans.update((a, KINDS.index("pair"), "pair", b) for a, b in own(i) if b > a)
            todo = list(refs[i])
            while todo:
                if (k := todo.pop()) not in reached:
                    reached.add(k)
                    spans.update((a, KINDS.index("const"), "const", b) for a, b in own(k) if b > a)
                    todo += refs[k]
    return list(spans)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return spans


def _rows(rows):
    for doc_id, text in rows:
        base = base_spans(text or "")
        more = lexed_spans(text or "")
        n = Counter(kind for _, _, kind, _ in base + more)
        yield (doc_id, *(n[k] for k in KINDS[:3]), sha256_hex(span_string(base)), span_string(base + more), *(n[k] for k in KINDS[3:]))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: counts, the digest of the base spans and all spans, over the whole text.

    Spans are in code points, end exclusive: whole matches of the base patterns, literals without their quotes for
    the lexer's. A null or empty text has none. Rows are independent: repeated rows, ties and extra columns change
    nothing, and there is no shuffle.
    """
    return map_rows(
        docs, [F.col("doc_id").cast("long"), F.col("text").cast("string")], _rows,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_pair long, n_const long",
    )
