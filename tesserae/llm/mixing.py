"""Mixing sources to target weights.

Each source's documents, in a permuted order, are one stream of words that is cut into blocks. A multivariate
hypergeometric splitting tree deals the sources' exact block quotas out to the output shards; each shard then gets
disjoint permuted blocks of every source and shuffles them locally.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import checkpoint, small_frame

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SHARDS = 16
SEED = 8
#: A block has a four-hundredth of its source's words, 2048 at most, but never so few that a source has more than MOST.
BLOCK_WORDS, PARTS, MOST = 2048, 400, 1 << 20
#: The driver holds a row for each source, of so many at most; more are refused.
MAX_SOURCES = 100_000
#: Slices of a source's permuted order, for its running sum.
SLICE_BITS = 12
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """``total`` shared by weight; what exceeds ``cap`` times a size is reshared by weight until none does."""
    out, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = total / sum(weights[i] for i in open_)
        over = [i for i in sorted(open_) if unit * weights[i] > cap * sizes[i]]
        for i in over or open_:
            out[i] = float(cap * sizes[i]) if over else unit * weights[i]
        if not over:
            break
        total -= sum(out[i] for i in over)
        open_ -= set(over)
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks by source and shard: rows sum to the quotas, columns differ by one block at most.

    The root holds all blocks; each node draws, without replacement, how many blocks of each source go to its left
    half.
    """
    out = np.zeros((len(quotas), shards), np.int64)

    def halve(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = counts
            return
        middle = (low + high) // 2
        total = int(counts.sum())
        # blocks are dealt to the shards as evenly as whole blocks allow
        left = total * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        draw = np.zeros_like(counts)
        rest, need = total, left
        for i, n in enumerate(counts.tolist()):  # one source after another, each given the rest
            if need and n:
                draw[i] = need if rest == n else rng.hypergeometric(n, rest - n, need)
            rest, need = rest - n, need - int(draw[i])
        halve(draw, low, middle)
        halve(counts - draw, middle, high)

    halve(np.array(quotas, np.int64), 0, shards)
    return out


def mix(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Two tables: ``(doc_id, size, source_size, target, taken, shards)`` per row of ``docs``, and the mixture's pieces.

    Sources are ordered by code point, null last, and take ``weights`` in turn. Pieces are ``(h, g, shard, position,
    epoch, first, last, width)``: words first to last (exclusive) of the row with hashes h and g, in the shard's shuffled order;
    ``width`` is the most that a piece of its source has. ``taken`` is the sum of a row's pieces and ``shards`` lists
    ``shard:words`` of those that got some. A row takes no more than ``cap`` times its size, each source's taken words
    are within a block of its target, and nothing but the rows and the seed decides. A null text has size 0 and takes
    nothing. Rows are told apart by all of their columns; rows that repeat wholly are mixed each by itself, and as they
    cannot be told apart, which of them takes more is open, while what they take is not. Without rows both tables are
    empty.
    """
    return _mix(docs, share, weights, cap, shards, seed)[:2]


def _mix(docs: DataFrame, share: float = SHARE, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``mix``, and the sources' ``(of, width)``."""
    text = F.col("text").cast("string")
    # copies are one row for each partition of the input that has some, however many there are
    rows = checkpoint(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            words(text).alias("size"), *row_hashes(docs, seed), F.spark_partition_id().alias("salt"),
        ).groupBy("doc_id", "source", "size", "h", "g", "salt").agg(F.count("*").alias("m"))
    )
    sizes = rows.groupBy("source").agg(F.sum(F.expr("size * m")).alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: group them before mixing")
    sizes.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    n = [int(r["n"]) for r in sizes]
    goal = targets(n, [weights[i % len(weights)] for i in range(len(n))], share * sum(n), cap)
    width = [_width(s) for s in n]
    blocks = [-(-s // w) for s, w in zip(n, width)]
    whole = [int(t // s) if s else 0 for s, t in zip(n, goal)]
    part = [min(b, round((t - e * s) / w)) if s else 0 for s, t, e, w, b in zip(n, goal, whole, width, blocks)]
    quotas = [e * b + p for e, b, p in zip(whole, blocks, part)]
    dealt = split_quotas(quotas, shards, seed).cumsum(axis=1).tolist() if n else []

    spark = docs.sparkSession
    plan = small_frame(
        spark, [(i, r["source"], *x) for i, (r, *x) in enumerate(zip(sizes, n, goal, width, blocks, whole, part, dealt))],
        "sid int, source string, source_size long, target double, width long, blocks long, whole int, part long, dealt array<long>",
    )
    permuted = lambda *c: F.xxhash64(F.lit(seed), *c)
    units = (
        plan.where("blocks > 0")
        .select("sid", "blocks", "whole", "part", "dealt", F.explode(F.expr(f"sequence(0, {cap - 1})")).alias("epoch"))
        .where("epoch < whole or epoch = whole and part > 0")
        .select("sid", "whole", "part", "dealt", "epoch", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
        .withColumn("nth", F.row_number().over(Window.partitionBy("sid", "epoch").orderBy(permuted("epoch", "block"), "block")))
        .where("epoch < whole or nth <= part")
        .withColumn("unit", F.row_number().over(Window.partitionBy("sid").orderBy(permuted(F.lit("unit"), "epoch", "block"), "epoch", "block")))
        .withColumn("shard", F.expr("size(filter(dealt, x -> x < unit))").cast("int"))
        .select("sid", "epoch", "block", "shard", permuted(F.lit("place"), "sid", "epoch", "block").alias("position"))
    )
    named = F.broadcast(plan.select("sid", F.col("source").alias("of"), "source_size", "target", "width"))  # at most MAX_SOURCES rows
    known = rows.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("source", "of")
    known = known.withColumn("slice", F.shiftrightunsigned("h", 64 - SLICE_BITS).cast("int"))
    sums = known.groupBy("sid", "slice").agg(F.sum(F.expr("size * m")).alias("n"))
    earlier = Window.partitionBy("sid").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("sid", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "slice").orderBy("h", "g", "salt").rowsBetween(Window.unboundedPreceding, 0)
    placed = known.where("size > 0").join(sums, ["sid", "slice"]).withColumn("end", F.col("base") + F.sum(F.expr("size * m")).over(inside))
    placed = placed.withColumn("start", F.explode(F.expr("sequence(end - size * m, end - size, size)"))).withColumn("end", F.expr("start + size"))
    met = placed.withColumn("block", F.explode(F.expr("sequence(start div width, (end - 1) div width)")))
    first, last = F.expr("greatest(block * width, start) - start"), F.expr("least(block * width + width, end) - start")
    met = met.select("h", "g", "doc_id", "sid", "start", "size", "source_size", "target", "width", "block", first.alias("first"), last.alias("last"))
    # blocks are made from a few rows, so their number is underestimated: merge joins, never a broadcast of them
    dealt_out = met.join(units.hint("merge"), ["sid", "block"], "left")
    key = ["sid", "start", "doc_id", "size", "source_size", "target"]  # a row with words is alone at its start
    got = [F.sum(F.when(F.col("shard") == i, F.col("last") - F.col("first")).otherwise(0)).alias(f"w{i}") for i in range(shards)]
    taken = dealt_out.groupBy(*key).agg(*got)
    columns = ["doc_id", "size", "source_size", "target"]
    listed = F.array_join(F.filter(F.array(*[F.when(F.col(f"w{i}") > 0, F.concat(F.lit(f"{i}:"), F.col(f"w{i}"))) for i in range(shards)]), lambda x: x.isNotNull()), ",")
    result = taken.select(*columns, sum((F.col(f"w{i}") for i in range(shards)), F.lit(0)).cast("long").alias("taken"), listed.alias("shards"))
    empty = known.where("size = 0").withColumn("copy", F.explode(F.expr("sequence(1L, m)"))).select(*columns, F.lit(0).cast("long").alias("taken"), F.lit("").alias("shards"))
    pieces = met.join(units.hint("merge"), ["sid", "block"])
    return result.unionByName(empty), pieces.select("h", "g", "shard", "position", "epoch", "first", "last", "width"), named.select("of", "width")


def _width(size: int) -> int:
    return max(1, min(BLOCK_WORDS, -(-size // PARTS)), -(-size // MOST))


def row_hashes(docs: DataFrame, seed: int = SEED) -> list[Column]:
    """``h`` and ``g``, together 128 bits of all columns of a row; where nulls are counts too."""
    plain = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    nulls = [F.col(f"`{c}`").isNull() for c in docs.columns]
    return [F.xxhash64(F.lit(seed), *nulls, *plain).alias("h"), F.xxhash64(F.lit(~seed), *plain[::-1], *nulls).alias("g")]


def _starts(text: str) -> list[int]:
    return [m.start() for m in _WORD.finditer(text)]


def piece(text: str, first: int, last: int, starts: list[int] | None = None) -> str:
    """From the start of word ``first`` (the text's start for word 0) to that of word ``last`` (or the text's end)."""
    starts = _starts(text) if starts is None else starts
    return text[0 if first == 0 else starts[first] : len(text) if last >= len(starts) else starts[last]]


def _fragments(text: pa.Array, width: pa.Array) -> pa.Array:
    out = []
    for t, w in zip(text.to_pylist(), width.to_pylist()):
        starts = _starts(t or "")
        out.append([piece(t, at, at + w, starts) for at in range(0, len(starts), w)])
    return pa.array(out, pa.list_(pa.string()))


def _cut(text: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    return pa.array([piece(*row) for row in zip(text.to_pylist(), first.to_pylist(), last.to_pylist())], pa.string())


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mixed data: pieces of rows of ``docs`` with all of their columns, ``text`` cut, and four columns at the end.

    These are ``shard``, ``position`` in the shard's shuffled order, ``epoch``, and ``first``, the piece's first word; each has
    underscores before it where ``docs`` has a column of that name. A row's pieces of one epoch, put together in order,
    are its text. Texts are cut once, into fragments as wide as a block, before they meet their pieces, so a text of any length
    is shuffled once and a piece meets two fragments at most; one that crosses from one into the next is two rows. Rows
    are not in order: sort by shard, position and first, or use ``write_shards``.
    """
    _, pieces, widths = _mix(docs, **options)
    fragments, cut_out = F.arrow_udf(_fragments, "array<string>"), F.arrow_udf(_cut, "string")
    seed = options.get("seed", SEED)
    rest = [c for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("z"))
    hashes = row_hashes(docs, seed)
    texts = docs.select(*hashes, row.alias("row"), F.col("text").cast("string").alias("text"), F.col("source").cast("string").alias("source"))
    texts = texts.where("text is not null").dropDuplicates(["h", "g"])  # rows with equal hashes are equal
    cut = texts.join(F.broadcast(widths), F.col("source").eqNullSafe(F.col("of"))).select("h", "g", "row", F.posexplode(fragments("text", "width")).alias("nth", "text"))
    parts = pieces.withColumn("nth", F.explode(F.expr("sequence(cast(first div width as int), cast((last - 1) div width as int))")))
    low = F.expr("greatest(first, nth * width)")
    parts = parts.select("h", "g", "nth", "shard", "position", "epoch", low.alias("first"), (low - F.expr("nth * width")).alias("a"), F.expr("least(last, (nth + 1) * width) - nth * width").alias("b"))
    met = parts.join(cut, ["h", "g", "nth"])
    own = [cut_out("text", "a", "b").alias("text") if c == "text" else F.col(f"row.c{rest.index(c)}").alias(c) for c in docs.columns]
    return met.select(*own, *[F.col(c).alias(_free(c, docs.columns)) for c in ("shard", "position", "epoch", "first")])


def _free(name: str, taken: list[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


def write_shards(mixed: DataFrame, path: str) -> None:
    """One folder for each shard of what ``mixture`` returns, its rows in the shuffled order."""
    shard, position, epoch, first = mixed.columns[-4:]
    mixed.repartition(shard).sortWithinPartitions(shard, position, epoch, first).write.partitionBy(shard).parquet(path)
