"""SimHash near-duplicates by tiled exact comparison.

Every pair of distinct fingerprints is compared, by exclusive or and bit counts in numpy, except pairs of tiles (and
rows inside a tile) whose population counts alone put them beyond the radius.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import checkpoint, small_frame
from tesserae.llm.components import Forest, connected_components

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints in a tile, at least and at most; between them a tile holds a part of all that gives TILES tiles.
TILE_ROWS = (2048, 262144)
TILES = 24
#: Tasks that compare pairs of tiles, at most.
TASKS = 20000
#: Comparisons held in memory at once.
BLOCK = 1 << 20


def fingerprint(text: bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """The 64-bit fingerprint, as a signed integer; zero for a text that is null or has no words."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly space and 09-0D
    if not words:
        return 0
    if len(words) <= shingle_words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        pieces = map(slice, starts[: 1 - shingle_words or None].tolist(), ends[shingle_words - 1 :].tolist())
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[p], SEED) for p in pieces), np.uint64, len(words) - shingle_words + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0].astype(np.int64))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``(doc_id, fp BIGINT)`` of every row of ``docs``; other columns are ignored."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    text = F.col("text").cast("string").cast("binary").alias("text")
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(run, "doc_id long, fp long")


def near_pairs(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fps (fp)``, distinct, to edges ``(a, b)`` that join exactly what fingerprints within ``radius`` bits join.

    The driver sees 65 counts and a row for each tile. A tile holds neighbouring population counts; two tiles meet in one task as two packed
    rows. Tasks return a spanning forest of the links they find, never all pairs.
    """
    bins = {r["p"]: r["count"] for r in fps.groupBy(F.bit_count("fp").alias("p")).count().collect()}
    rows = min(max(sum(bins.values()) // TILES, TILE_ROWS[0]), TILE_ROWS[1])
    tiles, base, split = [], [0] * 65, [1] * 65  # tiles: [lowest, highest, rows]
    for p in sorted(bins):
        if tiles and tiles[-1][2] + bins[p] <= rows:
            tiles[-1][1:] = [p, tiles[-1][2] + bins[p]]
            base[p] = len(tiles) - 1
        else:
            split[p], base[p] = -(-bins[p] // rows), len(tiles)
            tiles += [[p, p, -(-bins[p] // split[p])] for _ in range(split[p])]
    n = len(tiles)
    # tiles ascend in population count, so those that a tile meets from itself on are neighbours; the cluster writes them out
    last = np.searchsorted([t[0] for t in tiles], [t[1] + radius for t in tiles], "right") - 1 if n else np.empty(0, int)

    p = F.bit_count("fp")
    lookup = lambda xs: F.element_at(F.array(*map(F.lit, xs)), p + 1)
    tile = (lookup(base) + F.pmod(F.xxhash64("fp"), lookup(split))).cast("int").alias("tile")
    packed = fps.select(tile, "fp").groupBy("tile").applyInArrow(_pack, "tile int, fps binary")
    bounds = small_frame(fps.sparkSession, list(enumerate(last.tolist())), "one int, last int")
    pairs = bounds.select("one", F.explode(F.sequence("one", "last")).alias("two")).select(
        F.explode(F.array_distinct(F.array("one", "two"))).alias("tile"), (F.col("one").cast("long") * n + F.col("two")).alias("pair")
    )
    # little data and much work for each pair: as many tasks as pairs, within reason
    met = packed.join(pairs, "tile").repartition(min(max(1, int(last.sum()) - n * (n - 1) // 2 + n), TASKS), "pair")
    return met.groupBy("pair").applyInArrow(_comparer(radius), "a long, b long")


def _pack(table: pa.Table) -> pa.Table:
    fps = np.unique(table["fp"].to_numpy())
    fps = fps[np.argsort(np.bitwise_count(fps.view(np.uint64)), kind="stable")]
    return pa.table({"tile": pa.array(table["tile"].to_pylist()[:1], pa.int32()), "fps": pa.array([fps.tobytes()], pa.binary())})


def _comparer(radius: int):
    def compare(table: pa.Table) -> pa.Table:
        sides = [np.frombuffer(b, np.uint64) for b in table["fps"].to_pylist()]
        left, right = sides[0], sides[-1]
        alone = len(sides) == 1
        nodes = left if alone else np.concatenate((left, right))
        shift = 0 if alone else len(left)
        forest = Forest(len(nodes))
        pl, pr = np.bitwise_count(left).astype(np.int64), np.bitwise_count(right).astype(np.int64)
        at = 0
        while at < len(left):
            low = np.searchsorted(pr, pl[at] - radius)
            width = max(1, np.searchsorted(pr, pl[at] + radius, "right") - low)
            end = min(len(left), at + max(1, BLOCK // width), np.searchsorted(pl, pl[at], "right"))
            high = np.searchsorted(pr, pl[end - 1] + radius, "right")
            if alone:
                low = max(low, at)
            if low < high:
                i, j = np.nonzero(np.bitwise_count(left[at:end, None] ^ right[None, low:high]) <= radius)
                forest.join(i + at, j + low + shift)
            at = end
        i, j = forest.edges()
        ids = nodes.view(np.int64)
        return pa.table({"a": pa.array(ids[i]), "b": pa.array(ids[j])})

    return compare


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row of ``docs``: the smallest doc_id reachable over links of near fingerprints.

    Rows of one fingerprint (exact copies, repeated rows, all texts without words) are one node, so a group of copies
    costs one row in what is compared. A null doc_id is never the smallest unless it is alone. An empty table gives
    an empty result.
    """
    rows = checkpoint(fingerprints(docs))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = connected_components(near_pairs(nodes.select("fp"), radius))
    whole = nodes.join(found.withColumnRenamed("id", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    # settled, so that the join below stands by itself and Spark can split a component of very many nodes
    least = checkpoint(whole.groupBy("component").agg(F.min("first").alias("component_id")))
    return rows.join(whole.join(least, "component").select("fp", "component_id"), "fp").select(
        "doc_id", "fp", "component_id"
    )


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of ``docs``, all its columns unchanged, for each group: that of the smallest doc_id.

    Rows that repeat a doc_id are one document; the one whose text, then whole row, has the smallest hash stays. Rows without a
    doc_id stay, as nothing tells which document they are.
    """
    keep = near_duplicates(docs, radius).where("doc_id = component_id").select(F.col("doc_id").alias("_keep_id")).distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    joined = docs.select(F.col("doc_id").cast("long").alias("_keep_id"), row.alias("_row")).join(keep, "_keep_id", "left_semi")
    kept = joined.groupBy("_keep_id").agg(F.min_by("_row", F.struct(F.xxhash64("_row.text"), F.xxhash64(F.to_json("_row")))).alias("_row")).select("_row.*")
    return kept.unionByName(docs.where("doc_id is null"))
