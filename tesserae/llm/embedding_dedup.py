"""Embedding near-duplicates over an inverted multi-index.

Two codebooks, trained independently on the two halves of the unit vectors, form a product grid of cells. A vector is
filed under its own cell; as a query it visits cells in the order of a multi-sequence traversal until the cost above
its nearest cell passes a bound that is calibrated to the target recall. Visited cells are verified exactly, in double
precision, tile by tile.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import checkpoint
from tesserae.llm.components import Forest, connected_components

THRESHOLD = 0.9
#: Share of pairs at the very threshold that the traversal has to reach; pairs above it are reached more often.
TARGET_RECALL = 0.97
#: The codebooks are fitted on so many vectors at most, those of the smallest hashes.
SAMPLE_ROWS = 16384
#: Centroids of a half, at least and at most; between them a twelfth of the root of the number of vectors:
#: fewer cells mean fewer visits to ship, more mean fewer vectors to verify.
CENTROIDS = (4, 2048)
#: Cells of a grid whose counts are broadcast, at most; those of a larger grid are joined as Spark sees fit.
BROADCAST_CELLS = 1 << 16
#: Vectors of a cell, or queries that visit it, in one tile.
TILE_ROWS = 2048


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None]


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _squares(x, c).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


class MultiIndex:
    """Codebooks of both halves and the traversal's bound."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float = THRESHOLD, target: float = TARGET_RECALL):
        self.half = sample.shape[1] // 2
        k = int(min(max(n**0.5 / 12, CENTROIDS[0]), CENTROIDS[1], max(len(sample) // 8, CENTROIDS[0]), len(sample)))
        self.books = _kmeans(sample[:, : self.half], k), _kmeans(sample[:, self.half :], k)
        self.bound = 0.0
        rng = np.random.default_rng(0)
        q = sample[:4096]
        step = rng.normal(size=q.shape)
        step -= (step * q).sum(1)[:, None] * q
        step /= np.maximum(np.linalg.norm(step, axis=1), 1e-12)[:, None]
        other = threshold * q + (1 - threshold**2) ** 0.5 * step  # a partner at the threshold itself
        cost = np.minimum(self.cost(q, self.cells(other)), self.cost(other, self.cells(q)))
        self.bound = float(np.quantile(cost, target))

    def costs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances to each half's centroids, above those of the nearest."""
        pair = [_squares(part, c) for part, c in zip((x[:, : self.half], x[:, self.half :]), self.books)]
        return tuple(d - d.min(1)[:, None] for d in pair)

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = self.costs(x)
        return one.argmin(1) * len(self.books[1]) + two.argmin(1)

    def cost(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        one, two = self.costs(x)
        rows, k = np.arange(len(x)), len(self.books[1])
        return one[rows, cells // k] + two[rows, cells % k]

    def traverse(self, one: np.ndarray, two: np.ndarray) -> list[int]:
        """Cells in the order of their cost, as far as the bound, by a multi-sequence traversal of two sorted halves."""
        first, second, k = np.argsort(one, kind="stable"), np.argsort(two, kind="stable"), len(two)
        a, b = one[first].tolist(), two[second].tolist()
        heap, out = [(0.0, 0, 0)], []
        while heap:
            cost, i, j = heapq.heappop(heap)
            if cost > self.bound:
                break
            out.append(int(first[i]) * k + int(second[j]))
            if j + 1 < len(b):
                heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(a):
                heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
        return out


def _matrix(column, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors``; other columns are ignored.

    Two rows are linked where their cosine in double precision is at least ``threshold`` and the traversal of one of
    them reaches the other's cell. Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and
    vectors of different lengths never link (each length has an index of its own). Rows of equal vectors are one
    vector in the index and are counted by their number: a repeated row links with its copies. An empty table gives an
    empty result.
    """
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"))
    sound = (
        F.col("v").isNotNull()
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    rows = checkpoint(rows.withColumn("v", F.when(sound, F.transform("v", lambda x: x + F.lit(0.0).cast(kind)))))  # -0.0 is 0.0
    key = F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256)  # the text of a number is exact
    classes = checkpoint(
        rows.where("v is not null").groupBy(key.alias("key")).agg(
            F.min("vec_id").alias("first"), F.count("*").alias("size"), F.first("v").alias("v")
        ).withColumn("rep", F.xxhash64("key"))
    )
    found = None
    for width, n in classes.groupBy(F.size("v").alias("d")).count().collect():
        links = _links(classes.where(F.size("v") == width), width, n, threshold, target)
        found = links if found is None else found.unionByName(links)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = checkpoint(found)
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comps = connected_components(found.where("b is not null").select("a", "b"))
    nodes = classes.join(counts, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(
        "key", "first", "size", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("component", "rep").alias("component")
    )
    # settled, so that the join below stands by itself and Spark can split a component of very many nodes
    least = checkpoint(nodes.groupBy("component").agg(F.min("first").alias("component_id")))
    nodes = nodes.join(least, "component").select("key", (F.col("n") + F.col("size") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), key).alias("key")).join(nodes, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )


def _links(classes: DataFrame, width: int, n: int, threshold: float, target: float) -> DataFrame:
    """``(a, n, b)``: numbers of rows that class ``a`` links to (their sum over rows counts), and joining edges to ``b``."""
    sample = classes.orderBy("rep").limit(SAMPLE_ROWS).select("v").toArrow()
    x = _matrix(sample["v"], width)
    index = MultiIndex(_unit(x), n, threshold, target)

    def visit(batches):
        for batch in batches:
            u = _unit(_matrix(batch["v"], width))
            one, two = index.costs(u)
            own = index.cells(u)
            cells, row, member = [], [], []
            for r, cell in enumerate(own.tolist()):
                for c in dict.fromkeys([cell, *index.traverse(one[r], two[r])]):
                    cells.append(c)
                    row.append(r)
                    member.append(c == cell)
            row = np.array(row, np.int64)
            taken = {"rep": batch["rep"].take(pa.array(row)), "size": batch["size"].take(pa.array(row))}
            v = batch["v"].take(pa.array(row))
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int32()), "member": pa.array(member), **taken, "v": v})

    kind = classes.schema["v"].dataType.simpleString()
    filed = classes.select("rep", "size", "v").mapInArrow(visit, f"cell int, member boolean, rep long, size long, v {kind}")
    filed = checkpoint(filed)
    cells = filed.groupBy("cell").agg(F.count("*").alias("queries"), F.count_if("member").alias("members"))
    blocks = cells.where("members > 0").select(
        "cell", F.ceil(F.col("queries") / TILE_ROWS).cast("int").alias("qs"), F.ceil(F.col("members") / TILE_ROWS).cast("int").alias("ms")
    )
    few = len(index.books[0]) * len(index.books[1]) <= BROADCAST_CELLS
    at = filed.join(F.broadcast(blocks) if few else blocks, "cell")
    each = lambda size: F.sequence(F.lit(0), F.col(size) - 1)
    ask = at.select("cell", F.pmod(F.xxhash64("rep"), "qs").cast("int").alias("q"), F.explode(each("ms")).alias("m"), F.lit(True).alias("asks"), "rep", "size", "v")
    own = at.where("member").select("cell", F.explode(each("qs")).alias("q"), F.pmod(F.xxhash64("rep", F.lit(1)), "ms").cast("int").alias("m"), F.lit(False).alias("asks"), "rep", "size", "v")
    tiles = ask.unionByName(own).groupBy("cell", "q", "m")
    return tiles.applyInArrow(_verifier(index, width, threshold), "a long, n long, b long")


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1)[:, None]


def _verifier(index: MultiIndex, width: int, threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        rep, size, v = table["rep"].to_numpy(), table["size"].to_numpy(), _unit(_matrix(table["v"], width))
        q, m = np.flatnonzero(asks), np.flatnonzero(~asks)
        out_a, out_n = [], []
        forest = Forest(len(rep))
        if len(q) and len(m):
            back_one, back_two = index.costs(v[m])
            home, k = index.cells(v[q]), len(index.books[1])
            for at in range(0, len(q), 256):
                own = q[at : at + 256]
                i, j = np.nonzero((v[own] @ v[m].T >= threshold) & (rep[own][:, None] != rep[m][None]))
                if not len(i):
                    continue
                forest.join(own[i], m[j])
                n = np.bincount(i, size[m[j]], len(own)).astype(np.int64)
                # a member that visits the asking vector's cell counts this link there
                cell = home[at : at + 256][i]
                deaf = (back_one[j, cell // k] + back_two[j, cell % k] > index.bound) & (cell != own_cell(index, back_one, back_two, j))
                back = np.bincount(j[deaf], size[own[i[deaf]]], len(m)).astype(np.int64)
                out_a += [rep[own][n > 0], rep[m][back > 0]]
                out_n += [n[n > 0], back[back > 0]]
        i, root = forest.edges()
        # the copies of one vector as query and as member are one node
        a = np.concatenate([*out_a, rep[i]]) if len(out_a) or len(i) else np.empty(0, np.int64)
        n = np.concatenate([*out_n, np.zeros(len(i), np.int64)]) if len(a) else np.empty(0, np.int64)
        b = pa.array([None] * (len(a) - len(i)) + rep[root].tolist(), pa.int64())
        return pa.table({"a": pa.array(a, pa.int64()), "n": pa.array(n, pa.int64()), "b": b})

    def own_cell(index, one, two, j):
        return (one.argmin(1) * len(index.books[1]) + two.argmin(1))[j]

    return verify
