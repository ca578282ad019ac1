"""Licence scan by a trained paragraph classifier; DataFrame and SQL functions only on the texts.

A paragraph is a run of lines between blank ones, however they are wrapped. Sparse logistic regressions over its word
n-grams, one for each licence family and one for licence text as such, give calibrated probabilities; a family that is
predicted is confirmed by comparison with its templates, and licence text without a confirmed family is ``unknown``.
The models are fitted on the driver, once a process, to the small table of ``license_texts``; they are applied inside
the row, to every paragraph, without a shuffle.

Every feature of the models has a word of a small set of keys. A paragraph is read in windows around its key words; words
beyond them can have no part in a score, so nothing else is skipped, and text without a key has the scores of an empty
one, which is no licence text.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.license_texts import BODIES, NAMES, NONE, UNKNOWN_BODIES, UNKNOWN_NAMES

FAMILIES = tuple(BODIES)
#: A family is named only where these are not: their texts hold its paragraphs, or name its version.
ABSORBED_BY = {"BSD-2-Clause": ("BSD-3-Clause",), "GPL": ("GPL-2.0", "GPL-3.0")}
#: Families whose calibrated probability is lower, or whose templates cover less, are not named.
MIN_PROBABILITY, MIN_COVER = 0.5, 0.6
#: Words of a window; each is half over the next, so that statements of up to half a window are seen whole.
WINDOW = 96
#: Slots of the tables of keys and features, a power of two. Of words, or of n-grams, that share a slot the most frequent is one, the others are not.
SLOTS = 1 << 15
#: The penalty on weights, the number of steps, and the weight below which a feature is dropped.
PENALTY, STEPS, SMALL = 1e-4, 120, 0.02

#: Sentences around a licence's name; every third is held out from the fit that the calibration uses.
_FRAMES = (
    "Licensed under the {}", "Released under the {}.", "SPDX-License-Identifier: {}", "This work is licensed under the {}.", "This project is available under {}", "under the terms of {}",
    "distributed under the terms of the {} license", "License: {}", "covered by {}", "subject to the terms of the {}. See LICENSE for details.", "The code is provided under {}; see LICENSE",
    "Copyright (c) 2019 The Authors. Licensed under {}.", "you may use this file under {}", "is free software under the {}", "{} licensed", "Published under {} by the group",
    "this file is part of a library that is licensed under the {} and others", "The license of this package is {}.",
)
_DUAL = ("Dual {}/{}", "dual-licensed under {} or {}", "{} OR {}", "Licensed under either of {} or {} at your option", "SPDX-License-Identifier: ({} OR {})", "{} and {}")
_STOP = frozenset(
    "a about above all also an and any are as at be been but by can could do does for from had has have he her his how i if in into is it its may more must no not of on one only or other out shall she so some such "
    "than that the their them then there these they this to under up use used was we were what when where which who will with without would you your here see get new first two year years day time people make made "
    "der die das dem den und ein eine er sie es wir zu ist auf von la le les de un une et des en que el los las del y con por para example".split()
) | frozenset(map(str, range(100)))
_MARKS = re.compile("[^a-z0-9]+")


# --- n-grams, on the driver and in Spark ---------------------------------------------------------------------------------


def words_of(text: str) -> list[str]:
    return [w for w in _MARKS.split(text.lower()) if w]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def hashes_of(words: list[str]) -> dict[int, list[str]]:
    """Words, pairs and triples by Spark's ``xxhash64`` of their words."""
    out = {}
    for n in (1, 2, 3):
        for i in range(len(words) - n + 1):
            h = 42
            for w in words[i : i + n]:
                h = xxhash.xxh64_intdigest(w.encode(), seed=h)
            out[_signed(h)] = words[i : i + n]
    return out


_hashed = lru_cache(maxsize=8192)(lambda text: hashes_of(words_of(text)))


def normal_words(text: Column) -> Column:
    """Lower-case words and numbers; marks, the dots of versions too, separate."""
    return F.array_remove(F.split(F.lower(text), _MARKS.pattern), "")


def gram_hashes(words: Column) -> Column:
    """Distinct hashes of words, pairs and triples; nulls beyond the end do not change a hash."""
    return F.array_distinct(
        F.concat(
            F.transform(words, lambda w: F.xxhash64(w)),
            F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1))),
            F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))),
        )
    )


# --- training ------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Sparse weights by n-gram hash, over the families and, last, licence text as such."""

    intercepts: tuple[float, ...]
    weights: dict[int, dict[int, float]]
    #: Hashes of the words of which every feature has one.
    keys: tuple[int, ...]
    #: Temperatures of the families' scores and of the last one.
    temperatures: tuple[float, float] = (1.0, 1.0)
    templates: dict[str, tuple[tuple[int, ...], ...]] | None = None


def labelled_rows() -> list[tuple[frozenset[str], bool, str, bool]]:
    """(families, licence text or not, text, held out or not): names in sentences, two names, passages, cut passages."""
    out = []
    known = [(frozenset([k]), n) for k, names in NAMES.items() for n in names]
    for i, (kinds, name) in enumerate([*known, *((frozenset(), n) for n in UNKNOWN_NAMES)]):
        for j, frame in enumerate(_FRAMES):
            if (i + j) % 3 != 1 or j < 3:
                out.append((kinds, True, frame.format(name), j % 3 == 2 or kinds == frozenset() and i % 3 == 2))
        if kinds and (" " in name or any(c.isdigit() for c in name)):
            out += [(kinds, True, name, False), (kinds, True, f"our code is out under {name} now", False)]
    for i, (a, b) in enumerate((i, (7 * i + 3) % len(known)) for i in range(2 * len(known))):
        (x, m), (y, n) = known[a % len(known)], known[(b + i // len(known)) % len(known)]
        if x != y:
            out.append((x | y, True, _DUAL[i % len(_DUAL)].format(m, n), i % 3 == 2))
    for who in ("the author", "Example GmbH", "Foo Ltd", "J. Doe"):
        for line in ("{} (c) 2008. All rights reserved.", "All rights reserved by {}.", "{}: all rights reserved", "Copyright {}, all rights reserved.", "by {} All rights reserved"):
            out.append((frozenset(["Proprietary"]), True, line.format(who), False))
    for i, (kind, names) in enumerate(NAMES.items()):  # the names that are most often beside another one
        for j, short in enumerate(x for x in ("MIT", "Apache-2.0") if x != kind):
            for k, pair in enumerate(((short, names[0]), (names[0], short))):
                out.append((frozenset([kind, short]), True, _DUAL[(i + j + k) % len(_DUAL)].format(*pair), i % 3 == 2))
    for kind, passages in [*BODIES.items(), ("", UNKNOWN_BODIES)]:
        kinds = frozenset([kind] if kind else [])
        for i, p in enumerate(passages):
            words = p.split()
            held = not kind and i % 3 == 2
            out.append((kinds, True, "Copyright (c) 2012, 2015 The Authors " + " ".join(words[:WINDOW]), held))
            for j, at in enumerate(range(0, max(1, len(words) - WINDOW // 3), WINDOW // 2)):
                out.append((kinds, True, " ".join(words[at : at + WINDOW]), held or j % 3 == 2))
    out += [(frozenset(), False, "", False)] * 8
    for i, p in enumerate(NONE):
        out += [(frozenset(), False, p, i % 3 == 2), (frozenset(), False, f"{NONE[(5 * i + 2) % len(NONE)]}. {p}.", i % 3 == 2)]
    return out


def _fitted(rows: list) -> Model:
    """Logistic regressions with a penalty on absolute weights, by accelerated proximal gradient steps."""
    grams = [_hashed(text) for _, _, text, _ in rows]
    most = lambda counts: sorted(counts.items(), key=lambda c: (-c[1], c[0]))
    counts = Counter(w for g in grams for words in g.values() if len(words) == 1 for w in words if w not in _STOP)
    keys: dict[int, tuple[str, int]] = {}
    for word, n in most(counts):
        if n > 1:
            h = _signed(xxhash.xxh64_intdigest(word.encode(), seed=42))
            keys.setdefault(h % SLOTS, (word, h))
    known = {w for w, _ in keys.values()}
    slots: dict[int, int] = {}
    for h, n in most(Counter(h for g in grams for h, words in g.items() if not known.isdisjoint(words))):
        if n > 1:
            slots.setdefault(h % SLOTS, h)
    features = {h: i for i, h in enumerate(slots.values())}
    x = np.zeros((len(rows), len(features) + 1), np.float32)
    x[:, -1] = 1
    for i, g in enumerate(grams):
        x[i, [features[h] for h in g if h in features]] = 1
    y = np.array([[f in kinds for f in FAMILIES] + [licence] for kinds, licence, _, _ in rows], np.float32)
    share = y.mean(0)  # both sides of a class weigh the same, as far as a row weighs eight at most
    weigh = (np.minimum(np.where(y > 0, 0.5 / share, 0.5 / (1 - share)), 8) / len(rows)).astype(np.float32)
    v = np.random.default_rng(0).normal(size=x.shape[1]).astype(np.float32)
    for _ in range(12):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    step = 4.0 / (float(weigh.max()) * float(np.linalg.norm(x.T @ (x @ v))))
    w = z = np.zeros((x.shape[1], y.shape[1]), np.float32)
    t = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        moved = z - step * (x.T @ (weigh * (p - y)))
        moved[:-1] = np.sign(moved[:-1]) * np.maximum(np.abs(moved[:-1]) - step * PENALTY, 0)
        after = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = moved + (t - 1) / after * (moved - w)
        w, t = moved, after
    kept = {h: {k: round(float(c), 3) for k, c in enumerate(w[i]) if abs(c) >= SMALL} for h, i in features.items()}
    kept = {h: row for h, row in kept.items() if row}
    used = {w for g in grams for h, words in g.items() if h in kept for w in words}
    return Model(tuple(round(float(c), 3) for c in w[-1]), kept, tuple(h for word, h in keys.values() if word in used))


def scores_of(model: Model, text: str) -> list[float]:
    """Scores of one paragraph, for calibration and tests."""
    out = list(model.intercepts)
    for h in _hashed(text):
        for k, w in model.weights.get(h, {}).items():
            out[k] += w
    return out


@lru_cache(maxsize=1)
def trained() -> Model:
    """The model of all rows, with the temperatures that fit held-out rows under a model of the others."""
    rows = labelled_rows()
    part = _fitted([r for r in rows if not r[3]])
    families, licence = [], []
    for kinds, is_licence, text, held in rows:
        if held:
            *own, last = scores_of(part, text)
            families += [(s, f in kinds) for f, s in zip(FAMILIES, own)]
            licence.append((last, is_licence))

    def temperature(found: list[tuple[float, bool]]) -> float:
        s, y = np.array([s for s, _ in found]), np.array([1 if g else -1 for _, g in found])
        return min((0.25 * 1.1**i for i in range(40)), key=lambda t: float(np.logaddexp(0, -y * s / t).sum()))

    texts = {k: tuple(tuple(_hashed(t)) for t in (*NAMES.get(k, ()), *BODIES[k])) for k in FAMILIES}
    return replace(_fitted(rows), temperatures=(temperature(families), temperature(licence)), templates=texts)


# --- scanning --------------------------------------------------------------------------------------------------------------


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _table(hashes: Iterable[int]) -> list[int]:
    out = [0] * SLOTS
    for h in hashes:
        out[h % SLOTS] = h
    return out


def _among(h: Column, table: Column) -> Column:
    return F.get(table, h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")) == h


def _windows(words: Column, model: Model) -> Column:
    """The windows that hold key words, as arrays of words."""
    half, keys = WINDOW // 2, _constant(_table(model.keys), "array<bigint>")
    found = F.filter(F.transform(words, lambda w, i: F.when(_among(F.xxhash64(w), keys), i)), lambda i: i.isNotNull())
    blocks = lambda f: F.array_distinct(F.transform(f, lambda i: (i / half).cast("int")))
    around = lambda b: F.array_distinct(F.concat(b, F.transform(F.filter(b, lambda k: k > 0), lambda k: k - 1)))
    cut = lambda b: F.transform(b, lambda k: F.slice(words, k * half + 1, WINDOW))
    return _once(found, lambda f: F.when(F.size(f) == 0, F.slice(F.array(words), 1, 0)).when(F.size(words) > WINDOW, _once(blocks(f), lambda b: cut(around(b)))).otherwise(F.array(words)))


def _decided(grams: Column, model: Model) -> Column:
    """ARRAY<STRUCT<family, probability, cover>> of one window: of licence text, confirmed families, else ``unknown``; of other text none."""
    rows: list = [None] * SLOTS
    for h, row in model.weights.items():
        rows[h % SLOTS] = [{"k": k, "w": w} for k, w in row.items()]
    heads, table = _constant(_table(model.weights), "array<bigint>"), _constant(rows, "array<array<struct<k:int,w:double>>>")
    templates = _constant([model.templates[f] for f in FAMILIES], "array<array<array<bigint>>>")
    hits = F.filter(grams, lambda h: _among(h, heads))
    none = F.array().cast("array<struct<family:string,probability:double,cover:double>>")
    last = len(FAMILIES)

    def decide(parts: Column) -> Column:
        total = lambda k: F.aggregate(F.filter(parts, lambda p: p["k"] == k), F.lit(0.0), lambda a, p: a + p["w"])
        chance = lambda s, t: 1 / (1 + F.exp(-s / t))
        families = F.transform(F.array(*map(F.lit, model.intercepts[:last])), lambda b, k: F.struct(k.alias("k"), chance(b + total(k), model.temperatures[0]).alias("p")))
        cover = lambda k: F.array_max(F.transform(templates[k], lambda t: F.size(F.array_intersect(t, grams)) / F.least(F.size(t), F.size(grams))))
        entry = lambda f: F.struct(
            F.array(*map(F.lit, FAMILIES))[f["k"]].alias("family"), F.round(f["p"], 6).alias("probability"), F.round(cover(f["k"]), 6).alias("cover")
        )
        found = F.filter(F.transform(F.filter(families, lambda f: f["p"] >= MIN_PROBABILITY), entry), lambda e: e["cover"] >= MIN_COVER)
        licence = chance(model.intercepts[last] + total(F.lit(last)), model.temperatures[1])
        unknown = F.array(F.struct(F.lit("unknown").alias("family"), F.round(licence, 6).alias("probability"), F.lit(0.0).alias("cover")))
        sure = _once(found, lambda x: F.when(F.size(x) > 0, x).otherwise(unknown))
        return F.when(licence >= MIN_PROBABILITY, sure).otherwise(none)

    found = _once(F.flatten(F.transform(hits, lambda h: F.get(table, h.bitwiseAND(F.lit(SLOTS - 1)).cast("int")))), decide)
    return _once(hits, lambda x: F.when(F.size(x) > 0, found).otherwise(none))


def _joined(found: Column) -> Column:
    """One entry for each family of a paragraph's windows, the surest; ``unknown`` only by itself."""
    known = F.filter(found, lambda e: e["family"] != "unknown")
    best = lambda name: F.array_max(F.transform(F.filter(found, lambda e: e["family"] == name), lambda e: F.struct(e["cover"].alias("c"), e["probability"].alias("p"))))
    names = F.array_sort(F.array_distinct(F.transform(F.when(F.size(known) > 0, known).otherwise(found), lambda e: e["family"])))
    return F.transform(names, lambda n: _once(best(n), lambda b: F.struct(n.alias("family"), b["p"].alias("probability"), b["c"].alias("cover"))))


#: Where a paragraph ends: before a line without a letter or digit.
BLANK = r"(?<=\n)(?=[^\p{L}\p{N}\n]*+\n)"


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, n_licenses, n_unknown, families, paragraphs)`` per row of ``docs``, over the whole text.

    ``paragraphs`` lists ``line:family:probability:cover`` of every licence paragraph, ``line`` its first line from 0;
    a paragraph that names several families has an entry for each, one without a confirmed family is ``unknown``.
    ``n_licenses`` and ``n_unknown`` count these entries. ``families`` has the distinct known ones, sorted, without
    those that ``ABSORBED_BY`` others. A null or empty text has none. Rows are independent: repeated rows give repeated
    results, extra columns are ignored, and nothing is shuffled.
    """
    model = model or trained()
    text = F.col("text").cast("string")
    piece = lambda t: F.struct(t.alias("text"), (F.length(t) - F.length(F.replace(t, F.lit("\n")))).alias("lines"))
    blank = lambda t: F.length(F.regexp_extract(t, r"^((?:[^\p{L}\p{N}\n]*+\n)*)", 1)) - F.length(F.replace(F.regexp_extract(t, r"^((?:[^\p{L}\p{N}\n]*+\n)*)", 1), F.lit("\n")))

    def read(pieces: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            found = F.flatten(F.transform(_once(normal_words(p["text"]), lambda w: _windows(w, model)), lambda w: _once(gram_hashes(w), lambda g: _decided(g, model))))
            line = F.aggregate(F.slice(pieces, 1, i), F.lit(0), lambda n, q: n + q["lines"]) + blank(p["text"])
            return _once(found, lambda f: F.when(F.size(f) > 0, F.transform(_joined(f), lambda e: F.struct(line.alias("line"), *[e[c].alias(c) for c in ("family", "probability", "cover")]))))

        return F.flatten(F.filter(F.transform(pieces, one), lambda x: x.isNotNull()))

    found = _once(F.transform(F.split(text, BLANK), piece), read)
    none = F.array().cast("array<struct<line:int,family:string,probability:double,cover:double>>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(found, none).alias("found"))
    known = F.filter("found", lambda e: e["family"] != "unknown")
    entry = lambda e: F.concat_ws(":", e["line"], e["family"], e["probability"].cast("string"), e["cover"].cast("string"))
    names = F.array_distinct(F.transform(known, lambda e: e["family"]))
    for name, others in ABSORBED_BY.items():
        names = _once(names, lambda n: F.when(F.arrays_overlap(n, F.array(*map(F.lit, others))), F.array_remove(n, name)).otherwise(n))
    return rows.select(
        "doc_id", F.size(known).cast("long").alias("n_licenses"), (F.size("found") - F.size(known)).cast("long").alias("n_unknown"),
        F.array_join(F.array_sort(names), ",").alias("families"), F.array_join(F.transform("found", entry), ",").alias("paragraphs"),
    )
