import numpy as np
import xxhash

from tesserae.llm import simhash
from tesserae.llm.components import Forest, connected_components


def brute_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_whole_table_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    fps = {n: brute_fingerprint(t) for n, (_, t) in enumerate(rows)}
    links = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 4]
    comp = brute_components(fps, links)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[comp[n]] = min(least.get(comp[n], i), i)
    want = sorted(((i, fps[n] - (fps[n] >> 63 << 64), least.get(comp[n])) for n, (i, _) in enumerate(rows)), key=str)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want


def test_pairs_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE_ROWS", (40, 40))
    monkeypatch.setattr(simhash, "BLOCK", 64)
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 300)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(1, 6), False)) for b in base[:150]]
    fps = sorted({*map(int, base), *near, 0, -1, 1, 15, 31})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = [(a, b) for a in fps for b in fps if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 4]
    want = brute_components(fps, links)
    got = {r.id: r.component for r in connected_components(simhash.near_pairs(frame)).collect()}
    assert {f: got.get(f, f) for f in fps} == want


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (None, 3), (700, 600), (600, 700)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {600: 600, 700: 600}


def test_forest_keeps_components():
    rng = np.random.default_rng(2)
    i, j = rng.integers(0, 500, 300), rng.integers(0, 500, 300)
    f = Forest(500)
    for at in range(0, 300, 50):
        f.join(i[at : at + 50], j[at : at + 50])
    want = brute_components(range(500), zip(i.tolist(), j.tolist()))
    roots = f.root.tolist()
    assert len(set(zip(roots, want.values()))) == len(set(roots)) == len(set(want.values()))


def test_deduplicate_keeps_one_of_each_group(docs, no_docs):
    kept = simhash.deduplicate(docs).collect()
    groups = simhash.near_duplicates(docs).where("doc_id is not null").select("component_id").distinct().count()
    ids = [r.doc_id for r in kept if r.doc_id is not None]
    assert len(ids) == len(set(ids)) == groups
    assert simhash.deduplicate(docs).columns == docs.columns
    assert sum(r.doc_id is None for r in kept) == 2
    assert simhash.deduplicate(no_docs).count() == 0
