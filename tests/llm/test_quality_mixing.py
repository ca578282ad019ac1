"""Importance resampling and mixing against brute-force versions and their invariants."""

import math
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from tesserae.llm import mixing, quality
from tesserae.llm.common import kth_largest


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(4)
    good = [" ".join(rng.choice(["the", "river", "runs", "to", "a", "far", "sea", "and", "back"], 40)) + f" {i}" for i in range(150)]
    bad = ["!! ".join(rng.choice(["BUY", "NOW", "click", "win", "a", "prize"], 40)) + f" {i}" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as key", "1 as score")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(0, 210, 2)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    rows = quality.resample(docs, labels).collect()
    held = [r for r in rows if r.doc_id % 2]
    assert sum(r.kept == (r.doc_id < 150) for r in held) / len(held) >= 0.95
    assert all(r.kept for r in rows if r.doc_id < 150)  # the extra share comes from the others
    assert 0 < sum(r.kept for r in rows if r.doc_id >= 150) <= 4
    kept = quality.select(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.kept}


def test_weights_and_top_k_against_brute_force(labelled):
    docs, labels = labelled
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    grams = {i: quality._buckets(t, quality._Hashes()).tolist() for i, t in texts.items()}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i in good:
            target.update(g)
    n_raw, n_target = sum(raw.values()) + quality.BUCKETS, sum(target.values()) + quality.BUCKETS
    ratio = lambda b: math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw)
    want = {i: quality.TEMPER * sum(map(ratio, g)) / len(g) for i, g in grams.items()}
    rows = quality.resample(docs, labels, k=50).collect()
    assert all(abs(want[r.doc_id] - r.log_weight) < 1e-6 for r in rows)
    best = sorted((r.score for r in rows), reverse=True)[:50]
    assert sorted(r.score for r in rows if r.kept) == sorted(best)
    assert all(abs(r.score - r.log_weight) < 25 for r in rows)


def test_inclusion_follows_the_weights(spark):
    """The first of a Gumbel top-k is drawn in proportion to the weights, the next in proportion among the others."""
    from pyspark.sql import functions as F

    weights, seeds = [0.0, 0.5, 1.0, 2.0, -1.0], 4000
    grid = spark.range(seeds).select(F.col("id").cast("int").alias("seed"), F.explode(F.expr("sequence(0L, 4L)")).alias("doc_id"))
    w = F.array(*map(F.lit, weights))[F.col("doc_id").cast("int")]
    ranked = grid.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct(-quality.key(w, F.col("doc_id"), F.col("seed")), "doc_id"))).alias("r"))
    pairs = Counter((r[0], r[1]) for r in ranked.select(F.col("r")[0]["doc_id"], F.col("r")[1]["doc_id"]).collect())
    p = np.exp(weights) / np.exp(weights).sum()
    for i in range(5):
        assert abs(sum(n for (a, _), n in pairs.items() if a == i) / seeds - p[i]) < 4 * math.sqrt(p[i] / seeds)
        for j in range(5):
            q = p[i] * p[j] / (1 - p[i]) * (i != j)
            assert abs(pairs[i, j] / seeds - q) < 4 * math.sqrt(q / seeds) + 1e-9


def test_noise_decides_the_sample(labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    samples = []
    for seed in range(3):
        rows = quality.resample(docs, labels, k=100, seed=seed, model=model).collect()
        samples.append({r.doc_id for r in rows if r.kept})
        heaviest = {r.doc_id for r in sorted(rows, key=lambda r: -r.log_weight)[:100]}
        assert len(samples[-1]) == 100 and len(samples[-1] & heaviest) < 95
    assert samples[0] != samples[1] != samples[2]
    again = quality.resample(docs.repartition(3), labels, k=100, seed=2, model=model).where("kept").collect()
    assert {r.doc_id for r in again} == samples[2]


def test_quality_odd_rows(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.resample(docs, labels).count() == docs.count()
    assert quality.resample(no_docs, labels).count() == 0 and quality.select(no_docs, labels).count() == 0
    none = labels.where("false")
    assert all(r.log_weight == 0 for r in quality.resample(docs, none).collect())


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = [*map(int, rng.integers(-(10**12), 10**12, 3000)), *[7] * 500]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x long")
    for k in (1, 2, 400, 1700, 3500):
        assert kth_largest(frame, "x", k) == sorted(values, reverse=True)[k - 1]
    assert kth_largest(frame, "x", 0) is None and kth_largest(frame, "x", 3501) is None


def test_targets_reshare_exactly():
    got = mixing.targets([10, 100, 1000, 5], [5, 2, 1, 5], 1.5 * 1115)
    size, w, total, cap = [10, 100, 1000, 5], [5, 2, 1, 5], Fraction(3345, 2), {}
    while True:
        rest = total - sum(cap.values())
        open_ = [i for i in range(4) if i not in cap]
        share = {i: rest * w[i] / sum(w[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > 2 * size[i]]
        if not over:
            break
        cap |= {i: Fraction(2 * size[i]) for i in over}
    assert got == pytest.approx([float((cap | share)[i]) for i in range(4)])
    assert mixing.targets([], [], 0) == [] and mixing.targets([0, 0], [5, 2], 0) == [0, 0]


def test_splitting_tree_is_exact_and_fair():
    quotas = [1000, 37, 0, 1, 500]
    dealt = mixing.split_quotas(quotas, 13, seed=3)
    assert dealt.sum(1).tolist() == quotas and (dealt >= 0).all()
    assert np.ptp(dealt.sum(0)) <= 1
    draws = np.array([mixing.split_quotas([60, 40], 4, seed=s)[0] for s in range(400)])
    # multivariate hypergeometric: 25 blocks of 100 without replacement
    assert abs(draws.mean() - 15) < 0.3
    assert abs(draws.var() - 25 * 0.6 * 0.4 * 75 / 99) < 0.6


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_mix(rows, hashes, shards=mixing.SHARDS, seed=mixing.SEED):
    """Word by word: each source's words in the order of their rows' hashes, block by block, dealt to the shards."""
    import xxhash

    def spark_hash(*values):
        h = 42
        for v in values:
            raw = v.encode() if isinstance(v, str) else int(v).to_bytes(8 if abs(v) > 1 << 20 or isinstance(v, np.int64) else 4, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, seed=h)
        return h - (1 << 64) if h >> 63 else h

    long = np.int64
    by_source = defaultdict(list)
    for row, hs in zip(rows, hashes):
        by_source[row[2]].append((hs[0] % (1 << 64) >> 64 - mixing.SLICE_BITS, *hs, row))
    order = sorted(by_source, key=lambda s: (s is None, s or ""))
    size = [sum(len(words(r[-1][1])) for r in by_source[s]) for s in order]
    goal = mixing.targets(size, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(size))
    plans = []
    for n, t in zip(size, goal):
        w = max(1, min(2048, -(-n // 400)))
        b, e = -(-n // w), int(t // n) if n else 0
        plans.append((w, b, e, min(b, round((t - e * n) / w)) if n else 0))
    dealt = mixing.split_quotas([e * b + p for w, b, e, p in plans], shards, seed)
    got = Counter()
    for sid, (source, (w, b, e, p)) in enumerate(zip(order, plans)):
        stream = [(i, k) for i, r in enumerate(sorted(by_source[source], key=lambda r: r[:3])) for k in range(len(words(r[-1][1])))]
        units = [(epoch, block) for epoch in range(e) for block in range(b)]
        units += [(e, k) for k in sorted(range(b), key=lambda k: (spark_hash(seed, e, long(k)), k))[:p]]
        units.sort(key=lambda u: (spark_hash(seed, "unit", u[0], long(u[1])), *u))
        ranked = [r[-1] for r in sorted(by_source[source], key=lambda r: r[:3])]
        shard_of = np.repeat(np.arange(shards), dealt[sid])
        for (epoch, block), shard in zip(units, shard_of):
            for i, _ in stream[block * w : (block + 1) * w]:
                got[sid, i, int(shard)] += 1
        for i, row in enumerate(ranked):
            found = {s: got[sid, i, s] for s in range(shards) if got[sid, i, s]}
            yield row[0], len(words(row[1])), size[sid], goal[sid], sum(found.values()), ",".join(f"{s}:{n}" for s, n in found.items())


def test_mix_against_brute_force(spark, docs):
    """Every column of every row, with repeated rows, and the same id and text in two sources."""
    extra = spark.createDataFrame([(1, "a b c d", None, "s1", 7)] * 3 + [(1, "a b c d", None, "s2", 7), (1, None, "a b c d", "s2", 7)], docs.select("doc_id", "text", "lang", "source", "n_chars").schema)
    table = docs.unionByName(extra, allowMissingColumns=True)
    rows = table.select("doc_id", "text", "source", *mixing.row_hashes(table)).collect()
    want = sorted(brute_mix([tuple(r)[:3] for r in rows], [tuple(r)[3:] for r in rows]), key=str)
    got = sorted(map(tuple, mixing.mix(table.repartition(5))[0].collect()), key=str)
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
    plan = mixing.mix(table)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "dealt" in plan  # the splitting tree decides the result


def test_mix_keeps_its_promises(docs, no_docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mixing.mix(docs)[0].collect()
    assert mixing.mix(docs)[0].columns == ["doc_id", "size", "source_size", "target", "taken", "shards"]
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7))[0].collect()), key=str)
    assert sorted(((r.doc_id, r["size"]) for r in got), key=str) == sorted(((i, len(words(t))) for i, t, _ in rows), key=str)
    source = {(i, len(words(t))): s for i, t, s in rows}
    size = Counter()
    for _, t, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, mixing.targets([size[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()))))
    taken = Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == size[source[r.doc_id, r["size"]]]
        assert r.target == pytest.approx(want[source[r.doc_id, r["size"]]])
        taken[source[r.doc_id, r["size"]]] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= max(1, -(-size[s] // mixing.PARTS))
    assert mixing.mix(no_docs)[0].count() == 0 and mixing.mixture(no_docs).count() == 0


def test_mixture_puts_texts_back_together(spark):
    rng = np.random.default_rng(6)
    texts = {i: "".join(rng.choice(["a", "bc", " ", "\n", "é"], 300)) for i in range(40)}
    docs = spark.createDataFrame([(i, t, f"s{i % 2}") for i, t in texts.items()], "doc_id long, text string, source string")
    result, pieces = mixing.mix(docs)
    taken = {r.doc_id: r.taken for r in result.collect()}
    rows = mixing.mixture(docs).collect()
    got = defaultdict(int)
    for r in rows:
        assert r.text in texts[r.doc_id]
        got[r.doc_id] += len(words(r.text))
    assert dict(got) == {i: n for i, n in taken.items() if n}
    by_shard = Counter()
    for r in rows:
        by_shard[r.shard] += len(words(r.text))
    assert len(by_shard) == mixing.SHARDS and max(by_shard.values()) < 1.3 * min(by_shard.values()) + 20


def test_mixture_delivers_what_is_taken(spark, tmp_path):
    """Rows alike but for their source, repeated rows, long texts and own columns of the mixture's names."""
    long = "w x\ty " * 9000
    rows = [(1, "a b c d", "s1"), (1, "a b c d", "s2"), (1, "a b c d", "s2"), (2, long, "s1"), (3, " lead and tail \n", "s2"), (None, long + "z", None), (4, None, "s1"), (5, "", None)]
    docs = spark.createDataFrame([(*r, i, "mine", "p") for i, r in enumerate(rows[:2])] + [(*rows[2], 1, "mine", "p")] + [(*r, i + 9, "mine", "p") for i, r in enumerate(rows[3:])], "doc_id long, text string, source string, n long, shard string, position string")
    taken, delivered = Counter(), Counter()
    for r in mixing.mix(docs)[0].collect():
        taken[r.doc_id] += r.taken
        assert r.taken == sum(int(s.split(":")[1]) for s in r.shards.split(",") if s)
    mixed = mixing.mixture(docs)
    assert mixed.columns == [*docs.columns, "_shard", "_position", "epoch", "first"]
    out = mixed.collect()
    by_source, target = Counter(), {}
    for r in out:
        delivered[r.doc_id] += len(words(r.text))
        by_source[r.source] += len(words(r.text))
        assert (r["shard"], r["position"]) == ("mine", "p") and r.source == {0: "s1", 1: "s2", 9: "s1", 10: "s2", 11: None}[r.n]
    assert delivered == +taken
    for r in mixing.mix(docs)[0].collect():
        target[r.source_size] = r.target
    assert sorted(by_source.values()) == pytest.approx(sorted(target.values()), rel=0.01, abs=2)
    whole = "".join(r.text for r in sorted((r for r in out if r.doc_id == 2 and r.epoch == 0), key=lambda r: r["first"]))
    assert whole == long
    mixing.write_shards(mixed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(out) and {r["shard"] for r in back.select("shard").distinct().collect()} == {"mine"}
