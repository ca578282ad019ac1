"""Benchmark decontamination with one Aho-Corasick automaton over normalised questions and answers.

Items are words, and words are numbers of two signs each. The automaton's patterns are every item's words in blocks of
half a window, side by side, so a window anywhere in an item holds a whole block, and the automaton grows with the
benchmark's words and not with its windows. A document is normalised and scanned once; a block that is met is followed
to both sides for as long as document and item agree, and where they agree on a window or more every word is hit. Hits are mapped
back to word numbers and to offsets in the original text.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Iterable, Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import checkpoint, map_rows, sha256_hex

WINDOW = 13
#: A document is contaminated where hit words are at least this share (one in so many) of its words.
ONE_IN = 20
#: Bytes of benchmark text for one automaton, which takes about ten times as much memory in a Python worker (measured:
#: 50 MB for 5 MB). A larger benchmark is scanned in parts, whose results are merged.
MAX_AUTOMATON_BYTES = 48 << 20

# Word characters are 0-9, A-Z, a-z and everything beyond ASCII; A-Z count as a-z.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEPT else 0x20 for b in range(256))


def normalised(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split(b" ")


def words_of(text: bytes | None) -> list[bytes]:
    return [w for w in normalised(text or b"") if w]


class Scanner:
    """The automaton of some items, and their words to follow a match in."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        self.size, self.block = size, (size + 1) // 2
        self.numbers: dict[bytes, int] = {}
        self.ids: list[str] = []
        number = lambda w: self.numbers.setdefault(w, len(self.numbers) + 1)
        self.words, starts = array("i", [-1]), []
        for item_id, text in items:
            if words := words_of(text):
                self.ids.append(item_id)
                starts.append(len(self.words))
                self.words.extend(map(number, words))
                self.words.append(-1)  # the next item's words do not follow
        self.starts = np.array(starts, np.int64)
        base = math.isqrt(len(self.numbers)) + 1
        #: Two signs for each word, the first and the second from different ranges, so that matches start at words.
        self.signs = {w: chr(1 + n // base) + chr(2 + base + n % base) for w, n in self.numbers.items()}
        signs = [""] * (len(self.numbers) + 1)
        for w, n in self.numbers.items():
            signs[n] = self.signs[w]
        places: dict[str, list[int]] = {}
        for at, after in zip(starts, [*starts[1:], len(self.words)]):
            end = after - 1
            step = self.block if end - at >= size else end - at
            for k in range(at, end - step + 1, step):
                places.setdefault("".join(signs[n] for n in self.words[k : k + step]), []).append(k)
        self.automaton = ahocorasick.Automaton()
        for pattern, ks in places.items():
            self.automaton.add_word(pattern, (len(pattern) // 2, ks))
        if places:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are inside an occurrence of a window, and the items whose windows occur."""
        hit, found = np.zeros(len(words), bool), set()
        if not len(self.automaton) or not words:
            return hit, found
        numbers, followed = None, {}
        for end, (n, places) in self.automaton.iter("".join(map(self.signs.get, words, repeat("\0\0")))):
            if numbers is None:
                numbers = list(map(self.numbers.get, words, repeat(0)))
            first, last = (end + 1) // 2 - n, (end + 1) // 2
            for k in places:
                shift = k - first
                if followed.get(shift, -1) >= last:
                    continue  # this stretch of the item has been followed
                low, high = first, last
                while low and numbers[low - 1] == self.words[low - 1 + shift]:
                    low -= 1
                while high < len(numbers) and numbers[high] == self.words[high + shift]:
                    high += 1
                followed[shift] = high
                item = int(np.searchsorted(self.starts, k, "right")) - 1
                whole = (self.starts[item + 1] if item + 1 < len(self.starts) else len(self.words)) - self.starts[item] - 1
                if high - low >= min(self.size, whole):
                    hit[low:high] = True
                    found.add(self.ids[item])
        return hit, found


_built: dict[str, Scanner] = {}


def _scanner(name: str, items: Broadcast, size: int) -> Scanner:
    """The scanner of broadcast items, built once in each Python worker, which holds the last one only."""
    if name not in _built:
        _built.clear()
        _built[name] = Scanner(items.value, size)
    return _built[name]


def spans(text: str, hit: np.ndarray) -> list[tuple[int, int]]:
    """Hit runs of words as offsets in the original text (code points, end exclusive)."""
    out: list[tuple[int, int]] = []
    for i, m in enumerate(_WORD.finditer(text)):
        if hit[i]:
            if out and i and hit[i - 1]:
                out[-1] = (out[-1][0], m.end())
            else:
                out.append(m.span())
    return out


def _sound(benchmark: DataFrame) -> DataFrame:
    return benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))


def _parts(benchmark: DataFrame) -> int:
    """Automata that the benchmark needs: its size is checked before any of it is gathered."""
    size = _sound(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-int(size) // MAX_AUTOMATON_BYTES))


def _broadcast(benchmark: DataFrame, part: int, parts: int) -> tuple[str, Broadcast]:
    rows = _sound(benchmark).where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
    rows = rows.select("item_id", F.col("text").cast("binary")).distinct().collect()
    return uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast(sorted((r[0], bytes(r[1])) for r in rows))


def _hashes() -> list[Column]:
    """128 bits of the text."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("h"), F.xxhash64(F.lit(9), F.reverse(text)).alias("g")]


def _met(docs: DataFrame, benchmark: DataFrame, parts: int, size: int) -> DataFrame:
    """``(h, g, runs, ids)`` of every distinct text with a hit, by several automata, one after another.

    ``runs`` are the words hit, ``ids`` the items, of each automaton. A task holds one automaton; the parts are jobs of their own.
    """
    out = None
    for part in range(parts):
        name, items = _broadcast(benchmark, part, parts)

        def rows(batches: Iterator[tuple], name: str = name, items: Broadcast = items) -> Iterator[tuple]:
            scanner = _scanner(name, items, size)
            for h, g, text in batches:
                hit, found = scanner.scan(words_of(text))
                if found:
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
                    yield h, g, edges, sorted(found)

        texts = docs.where(F.col("text").isNotNull())
        hits = map_rows(texts, [*_hashes(), F.col("text").cast("string").cast("binary")], rows, "h long, g long, edges array<long>, ids array<string>")
        # copies of a text have the same hits: one for each partition goes on
        hits = checkpoint(hits.groupBy("h", "g").agg(F.first("edges").alias("edges"), F.first("ids").alias("ids")))
        out = hits if out is None else out.unionByName(hits)
        items.destroy()
    return out.groupBy("h", "g").agg(F.collect_list("edges").alias("runs"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))


def _row(doc_id: int | None, text: bytes | None, words: list[bytes], hit: np.ndarray, found: Iterable[str]) -> tuple:
    n, ids = int(hit.sum()), sorted(found)
    where = ",".join(f"{a}:{b}" for a, b in spans(text.decode(errors="replace"), hit)) if n else ""
    return doc_id, len(words), n, len(ids), sha256_hex(",".join(ids)), _too_much(n, len(words)), where


def _too_much(hit: int, words: int) -> bool:
    return hit > 0 and ONE_IN * hit >= words


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans)`` per row of ``docs``.

    A null or empty text has no words and is clean. Benchmark rows without an id or a text are ignored; ids are strings
    or numbers, and rows that repeat an id are one item with the windows of all of them. Rows of ``docs`` are
    independent: repeated rows and extra columns change nothing. With one automaton the documents are scanned without a shuffle; with
    more, texts meet their merged hits by hash.
    """
    parts = _parts(benchmark)
    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans string"
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")]
    if parts == 1:
        name, items = _broadcast(benchmark, 0, 1)

        def rows(batches: Iterator[tuple]) -> Iterator[tuple]:
            scanner = _scanner(name, items, size)
            for doc_id, text in batches:
                words = words_of(text)
                yield _row(doc_id, text, words, *scanner.scan(words))

        return map_rows(docs, columns, rows, schema)

    def merged(batches: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, runs, ids in batches:
            words = words_of(text)
            hit = np.zeros(len(words), bool)
            for edges in runs or ():
                for low, high in zip(edges[::2], edges[1::2]):
                    hit[low:high] = True
            yield _row(doc_id, text, words, hit, ids or ())

    joined = docs.select(*columns, *_hashes()).join(_met(docs, benchmark, parts, size), ["h", "g"], "left")
    return map_rows(joined, ["doc_id", "text", "runs", "ids"], merged, schema)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, all columns unchanged; without a shuffle where one automaton is enough."""
    parts = _parts(benchmark)
    if parts == 1:
        name, items = _broadcast(benchmark, 0, 1)

        @F.arrow_udf("boolean")
        def contaminated(texts: pa.Array) -> pa.Array:
            scanner = _scanner(name, items, size)
            words = map(words_of, texts.to_pylist())
            return pa.array([_too_much(int(scanner.scan(w)[0].sum()), len(w)) for w in words], pa.bool_())

        return docs.where(~contaminated(F.col("text").cast("string").cast("binary")))

    @F.arrow_udf("boolean")
    def over(texts: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for text, edges in zip(texts.to_pylist(), runs.to_pylist()):
            hit = {k for e in edges or () for low, high in zip(e[::2], e[1::2]) for k in range(low, high)}
            out.append(_too_much(len(hit), len(words_of(text)) if hit else 0))
        return pa.array(out, pa.bool_())

    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")
    joined = docs.select(row, F.col("text").cast("string").cast("binary").alias("text"), *_hashes()).join(_met(docs, benchmark, parts, size), ["h", "g"], "left")
    return joined.where(~over("text", "runs")).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
