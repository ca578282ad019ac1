"""Token counts by offset-mapped attribution.

A document is encoded once, as a whole. The tokens' character spans are interval-joined to the spans of fields or
sections, and a token that crosses a boundary goes to one side by an explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import map_rows

#: Where the public tokenizers' files are.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Which section has a token that crosses a boundary: that of its first or last character, or the one with most bytes
#: of it (of equals, the first).
RULES = ("first", "last", "most")


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The tokenizer and the number of bytes of each of its tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # Fixed value: the pattern that goes with this vocabulary.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the tokens' starts and ends in the UTF-8 text."""
    encoding, lengths = _encoder(path)
    size = lengths[np.array(encoding.encode_ordinary(text), np.int64)]
    ends = np.cumsum(size)
    return ends - size, ends


def attribute(starts: np.ndarray, ends: np.ndarray, section_starts: np.ndarray, section_ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token (-1: none) and whether it crosses a boundary; sections are sorted and disjoint."""
    if not len(section_starts) or not len(starts):
        return np.full(len(starts), -1), np.zeros(len(starts), bool)
    first = np.searchsorted(section_ends, starts, "right")  # the first section that ends after the token starts
    last = np.searchsorted(section_starts, ends, "left") - 1  # the last one that starts before the token ends
    met = first <= last
    if rule == "first":
        to = first
    elif rule == "last":
        to = last
    else:
        to = first.copy()
        at = np.minimum(first, len(section_starts) - 1)
        best = np.minimum(ends, section_ends[at]) - np.maximum(starts, section_starts[at])
        for step in range(1, int((last - first).max(initial=0)) + 1):
            at = np.minimum(first + step, len(section_starts) - 1)
            more = np.where(first + step <= last, np.minimum(ends, section_ends[at]) - np.maximum(starts, section_starts[at]), -1)
            to, best = np.where(more > best, first + step, to), np.maximum(best, more)
    at = np.clip(first, 0, len(section_starts) - 1)
    whole = (first == last) & (starts >= section_starts[at]) & (ends <= section_ends[at])
    return np.where(met, to, -1), met & ~whole


def line_sections(text: str) -> list[tuple[str, int, int]]:
    """Each line that is not empty, by its number; line breaks belong to no section."""
    out, at = [], 0
    for i, line in enumerate(text.split("\n")):
        if line:
            out.append((str(i), at, at + len(line)))
        at += len(line) + 1
    return out


def count_tokens(
    docs: DataFrame, sections: Column | None = None, rule: str = "first", tokenizer: str = TOKENIZER, tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """``(doc_id, section, start, end, n_tokens, n_crossing)``: a row for each section of each row of ``docs``.

    ``sections``: ARRAY<STRUCT<name STRING, start INT, end INT>> over ``text`` in characters, which may not overlap;
    by default its lines. A last row of a null section has the tokens that meet no section (in the gaps between), so
    the counts of a document sum to the tokens of its whole text; ``n_crossing`` counts those that were given to the
    section although they reach beyond it. A null text is an empty one: only the last row, with none. Sections that
    are null, empty, outside the text or overlapping raise an error. Repeated rows are counted each by itself.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}, not {rule}")
    path = f"{tokenizer_dir}/{tokenizer}"
    given = sections is not None

    def rows(batches: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text, own in batches:
            text = text or ""
            parts = sorted(((s["name"], s["start"], s["end"]) for s in own or ()), key=lambda s: s[1]) if given else line_sections(text)
            bounds = np.array([s[1:] for s in parts], np.int64).reshape(-1, 2)
            flat = bounds.ravel()
            if (np.diff(flat) < 0).any() or (bounds[:, 0] >= bounds[:, 1]).any() or (len(flat) and (flat[0] < 0 or flat[-1] > len(text))):
                raise ValueError(f"document {doc_id}: sections are empty, overlap or lie outside the text")
            starts, ends = token_spans(text, path)
            if len(flat) and not text.isascii():
                points = np.frombuffer(text.encode("utf-32-le"), "<u4")
                width = np.ones(len(points), np.int64) + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
                flat = np.concatenate(([0], np.cumsum(width)))[flat]
            to, crossing = attribute(starts, ends, flat[0::2], flat[1::2], rule)
            n = np.bincount(to + 1, minlength=len(parts) + 1).tolist()
            c = np.bincount(to + 1, crossing, len(parts) + 1).astype(int).tolist()
            for i, (name, start, end) in enumerate(parts):
                yield doc_id, name, start, end, n[i + 1], c[i + 1]
            yield doc_id, None, None, None, n[0], c[0]

    columns = [F.col("doc_id").cast("long"), F.col("text").cast("string"), sections if given else F.lit(None).cast("string")]
    return map_rows(docs, columns, rows, "doc_id long, section string, start long, end long, n_tokens long, n_crossing long")
