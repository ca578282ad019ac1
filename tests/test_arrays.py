"""Arrays through a store: metadata, reads, shards, writes, hierarchies, receipts and folds."""

import json
import os
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tesserae.errors import CodecError, DTypeMismatch, InvalidHierarchy, InvalidMetadata, InvalidSelection, NodeExists, NodeNotFound, ResourceLimit, Unsupported
from tesserae.functions import codecs as C
from tesserae.functions.dtypes import dtype
from tesserae.functions.strict_json import loads
from tesserae.operators import fold, hierarchy, receipts, write
from tesserae.plans import selection as S
from tesserae.plans.descriptor import ArrayDescriptor, Sharding, parse_v2, parse_v3, render_v2, render_v3
from tesserae.plans.shards import coalesced
from tesserae.sources import arrays, files
from tesserae.sources.arrays import fill_boxes, gathered, open_array, open_group, open_node, opened

LITTLE = C.Bytes("little")


def values(df, order):
    return [r.v for r in df.orderBy(*order).collect()]


@pytest.fixture
def border(spark, tmp_path):
    """4 x 5 of int16 in chunks of 2 x 3, fill -9; chunk (1, 0) is missing."""
    d = ArrayDescriptor((4, 5), (2, 3), dtype("int16"), -9, names=("y", "x"))
    data = np.arange(20, dtype=np.int16).reshape(4, 5)
    cells = write.cells_of_numpy(spark, data, d).where("not (i0 >= 2 and i1 < 3)")
    write.create_array(cells, f"{tmp_path}/a", d)
    return open_array(spark, f"{tmp_path}/a")


def test_region_points_and_factored(border):
    got = values(border.region((1, 1), (3, 4)), ["i0", "i1"])
    assert got == [6, 7, 8, 9, -9, -9, 13, 14, -9, -9, 18, 19]
    assert values(border.points([(3, 4), (0, 0), (2, 1), (3, 4)]), ["ord"]) == [19, 0, -9, 19]
    got = values(border.select(S.Indices([3, 1, 3]), S.Slice(0, 5, 2)), ["o0", "o1"])
    assert got == [-9, -9, 19, 5, 7, 9, -9, -9, 19]
    assert border.region((1, 1), (0, 4)).count() == 0 and border.points([]).count() == 0
    assert border.to_numpy().tolist()[3] == [-9, -9, -9, 18, 19]
    with pytest.raises(InvalidSelection):
        border.region((0, 0), (5, 1))
    with pytest.raises(InvalidSelection):
        border.points([(4, 0)])
    for bad in (S.Slice(0, 6), S.Slice(3, 2), S.Slice(0, 5, 0), S.Indices([5])):
        with pytest.raises(InvalidSelection):
            border.select(S.All(), bad)
    with pytest.raises(DTypeMismatch):
        open_array(border.spark, border.root, dtype="int32")


def test_receipt_and_fold(border):
    axes = S.region((4, 5), (1, 1), (3, 4))
    r = receipts.receipt(border, axes).first()
    assert (r.object_requests, r.touched_chunks, r.requested_elements, r.bytes_read) == (4, 4, 12, 36)
    axes = S.checked((4, 5), [S.Indices([3, 1, 3]), S.Slice(0, 5, 2)])
    seen = {}

    def step(n, t):
        for o0, o1, v in zip(t["o0"].to_pylist(), t["o1"].to_pylist(), t["v"].to_pylist()):
            seen[o0, o1] = v
        return n + 1, True

    n, receipt = fold.fold_chunks(border, axes, 0, step)
    assert (n, receipt.planned, receipt.decoded, receipt.filled, receipt.elements, receipt.completed) == (4, 4, 3, 1, 9, True)
    assert [seen[a, b] for a in range(3) for b in range(3)] == [-9, -9, 19, 5, 7, 9, -9, -9, 19]
    _, receipt = fold.fold_chunks(border, axes, 0, lambda n, t: (n + 1, False))
    assert (receipt.visited, receipt.completed) == (1, False)


# Shard objects and metadata of independent public writers.
START = "44000000000000000800000000000000" + "ff" * 32 + "4c000000000000000800000000000000" + "a45840a0" + "01000200030004000d000e000f001000"
END = "01000200030004000d000e000f001000" + "00000000000000000800000000000000" + "ff" * 32 + "08000000000000000800000000000000" + "6729498b"


@pytest.mark.parametrize(("location", "raw"), [("start", START), ("end", END)])
def test_golden_shards(spark, tmp_path, location, raw):
    d = ArrayDescriptor((4, 4), (4, 4), dtype("int16"), 0, (), Sharding((2, 2), location=location))
    rows = [(0, 0, 1), (0, 1, 2), (1, 0, 3), (1, 1, 4), (2, 2, 13), (2, 3, 14), (3, 2, 15), (3, 3, 16)]
    cells = spark.createDataFrame(rows, "i0 long, i1 long, v short")
    receipt = write.create_array(cells, f"{tmp_path}/s", d)
    assert (tmp_path / "s/c/0/0").read_bytes().hex() == raw
    assert (receipt.encoded_chunks, receipt.omitted_chunks, receipt.n_bytes) == (2, 2, 84)
    a = open_array(spark, f"{tmp_path}/s")
    assert a.to_numpy().tolist() == [[1, 2, 0, 0], [3, 4, 0, 0], [0, 0, 13, 14], [0, 0, 15, 16]]
    assert values(a.points([(3, 3), (0, 3), (1, 0)]), ["ord"]) == [16, 0, 3]
    r = receipts.receipt(a, a.all_axes()).first()
    assert (r.range_requests, r.index_bytes, r.data_bytes, r.read_amplification) == (2, 68, 16, 2.625)
    assert r.object_requests == (2 if location == "start" else 3)
    assert receipts.receipt(a, a.all_axes(), coalesce=False).first().range_requests == 3
    bad = bytearray.fromhex(raw)
    bad[20 if location == "start" else -20] ^= 1
    (tmp_path / "s/c/0/0").write_bytes(bad)
    assert sorted(os.listdir(tmp_path / "s")) == ["c", "zarr.json"]
    with pytest.raises(Exception, match="CRC-32C differs|half empty"):
        a.read_all().collect()


def test_whole_shard_behind_outer_codecs(spark, tmp_path):
    s = Sharding((2, 2), (LITTLE, C.Gzip(5)), (LITTLE, C.Shuffle(8), C.Crc32c()), "start")
    d = ArrayDescriptor((5, 7), (4, 4), dtype("uint16"), 3, (C.Gzip(1),), s)
    data = (np.arange(35, dtype=np.uint16) * 1800).reshape(5, 7)
    a = write.create_and_open(write.cells_of_numpy(spark, data, d), f"{tmp_path}/s", d)
    assert (a.to_numpy() == data).all()
    assert values(a.select(S.Indices([4, 0]), S.Slice(1, 7, 4)), ["o0", "o1"]) == [data[4, 1], data[4, 5], data[0, 1], data[0, 5]]


def test_metadata_round_trips():
    chains = [(LITTLE,), (C.Transpose((1, 0)), C.Bytes("big"), C.Crc32c()), (C.Delta(dtype("int16"), dtype("int8")), C.Bytes(None), C.Shuffle(2), C.Zstd(3, True))]
    for chain in chains:
        d = ArrayDescriptor((4, 5), (2, 3), dtype("int16"), -9, chain, names=("y", None), attributes={"k": [1, None]}).checked()
        again = parse_v3(loads(render_v3(d)))
        assert render_v3(again) == render_v3(d) and again.codecs == d.codecs
    d = ArrayDescriptor((8, 8), (4, 4), dtype("int16"), 0, (C.Gzip(1),), Sharding((2, 2), location="start")).checked()
    assert render_v3(parse_v3(loads(render_v3(d)))) == render_v3(d)
    for chain in [(LITTLE, C.Zlib(1)), (C.Transpose((1, 0)), C.Delta(dtype("int16"), dtype("int16")), C.Bytes("big"), C.Shuffle(2), C.Blosc("zstd", 3, "shuffle", 2))]:
        d = ArrayDescriptor((4, 5), (2, 3), dtype("int16"), 1, chain, encoding="v2", separator=".", names=("y", "x"), zarr_format=2).checked()
        array, attributes = render_v2(d)
        again = parse_v2(loads(array), loads(attributes))
        assert render_v2(again)[0] == array and again.names == ("y", "x")
    with pytest.raises(Unsupported):
        render_v2(ArrayDescriptor((4, 5), (2, 3), dtype("int16"), 1, (LITTLE, C.Gzip(1), C.Zlib(1)), zarr_format=2))


BASE = {"zarr_format": 3, "node_type": "array", "shape": [7], "data_type": "float32", "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [3]}}, "chunk_key_encoding": {"name": "default"}, "fill_value": "NaN", "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}]}


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ({"shape": [-1]}, Exception), ({"data_type": "text"}, InvalidMetadata), ({"chunk_grid": {"name": "rectilinear"}}, Unsupported), ({"codecs": ["lz9"]}, Unsupported),
        ({"codecs": []}, InvalidMetadata), ({"codecs": ["gzip"]}, Exception), ({"fill_value": None}, InvalidMetadata), ({"dimension_names": ["a", "b"]}, InvalidMetadata),
        ({"storage_transformers": ["x"]}, Unsupported), ({"future": {"name": "x"}}, Unsupported), ({"data_type": {"name": "float32", "must_understand": False}}, InvalidMetadata),
        ({"chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [0]}}}, Exception), ({"codecs": ["bytes"]}, InvalidMetadata),
    ],
)
def test_bad_metadata(change, error):
    with pytest.raises(error):
        parse_v3(loads(json.dumps(BASE | change)))


def test_ignorable_metadata():
    d = parse_v3(loads(json.dumps(BASE | {"storage_transformers": [{"name": "x", "must_understand": False}], "future": {"must_understand": False}, "codecs": [*BASE["codecs"], {"name": "y", "must_understand": False}]})))
    assert d.codecs == (LITTLE,) and np.isnan(d.fill_value)
    with pytest.raises(ResourceLimit):
        parse_v3(loads(json.dumps(BASE | {"shape": [1 << 40], "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": [1 << 30]}}})))


@pytest.mark.parametrize("name", ["bool", "uint8", "uint64", "float16", "complex64", "r24"])
def test_types_through_a_store(spark, tmp_path, name):
    t = dtype(name)
    raw = np.random.default_rng(1).integers(0, 2 if name == "bool" else 120, 6 * t.width, np.uint8).tobytes()
    data = np.frombuffer(raw, t.numpy).reshape(2, 3)
    d = ArrayDescriptor((2, 3), (2, 2), t, False if name == "bool" else b"abc" if name == "r24" else 0)
    a = write.create_and_open(write.cells_of_numpy(spark, data, d), f"{tmp_path}/a", d)
    assert a.to_numpy().tobytes() == data.tobytes() and a.read_all().count() == 6


def test_rank_zero_and_empty_axes(spark, tmp_path):
    d = ArrayDescriptor((), (), dtype("float32"), "NaN")
    a = write.create_and_open(spark.createDataFrame([(2.5,)], "v float"), f"{tmp_path}/a", d)
    assert a.read_all().collect()[0].v == 2.5 and os.path.exists(tmp_path / "a/c") and float(a.to_numpy()) == 2.5
    write.create_fill_array(spark, f"{tmp_path}/b", ArrayDescriptor((0, 9), (4, 3), dtype("float32"), 0))
    assert open_array(spark, f"{tmp_path}/b").read_all().count() == 0
    write.create_fill_array(spark, f"{tmp_path}/c", ArrayDescriptor((3,), (2,), dtype("int8"), 5))
    assert values(open_array(spark, f"{tmp_path}/c").read_all(), ["i0"]) == [5, 5, 5]


def test_five_axes(spark, tmp_path):
    d = ArrayDescriptor((2, 3, 4, 5, 6), (1, 2, 3, 2, 4), dtype("int32"), -1, (C.Transpose((4, 2, 0, 1, 3)), LITTLE))
    data = np.arange(720, dtype=np.int32).reshape(d.shape)
    a = write.create_and_open(write.cells_of_numpy(spark, data, d), f"{tmp_path}/a", d)
    assert (a.to_numpy(S.Slice(0, 2), S.Indices([2, 0]), S.Slice(1, 4, 2), S.All(), S.Indices([5])) == data[:, [2, 0]][:, :, 1:4:2][..., [5]]).all()


def test_create_only(spark, tmp_path, border):
    d = border.descriptor
    cells = spark.createDataFrame([(0, 0, 1)], "i0 long, i1 long, v short")
    with pytest.raises(NodeExists):
        write.create_array(cells, border.root, d)
    with pytest.raises(ResourceLimit):
        write.create_array(cells, f"{tmp_path}/z", d, max_objects=1)
    with pytest.raises(Exception, match="outside shape"):
        write.create_array(spark.createDataFrame([(0, 9, 1)], "i0 long, i1 long, v short"), f"{tmp_path}/z", d)
    with pytest.raises(Exception, match="repeated coordinates"):
        write.create_array(cells.union(cells), f"{tmp_path}/z", d)
    with pytest.raises(Exception, match="null is not"):
        write.create_array(spark.createDataFrame([(0, 0, None)], "i0 long, i1 long, v short"), f"{tmp_path}/z", d)
    assert not os.path.exists(tmp_path / "z") and not [n for n in os.listdir(tmp_path) if n.startswith(".staging")]
    r = write.create_array(cells, f"{tmp_path}/z", d)
    rows = r.objects.collect()
    assert [x.key for x in rows] == ["c/0/0"] and rows[0].length == 12 and r.documents == ("zarr.json",)
    assert (r.n_objects, r.encoded_chunks, r.omitted_chunks) == (1, 1, 3)


def test_hierarchy(spark, tmp_path):
    root = f"{tmp_path}/h"
    write.create_group(spark, root, attributes={"title": "x"})
    write.create_group(spark, root, "derived")
    d = ArrayDescriptor((3,), (2,), dtype("int32"), 7)
    write.create_fill_array(spark, root, d, "derived/mask")
    write.create_fill_array(spark, root, d, "bold")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    want = [("", "group", 3), ("bold", "array", 3), ("derived", "group", 3), ("derived/mask", "array", 3)]
    assert rows(hierarchy.nodes(spark, root)) == want
    assert rows(hierarchy.children(spark, root)) == [want[1], want[2]] and rows(hierarchy.children(spark, root, "derived")) == [want[3]]
    assert open_group(spark, root).attributes == {"title": "x"}
    group = open_group(spark, root, mode="ignore")
    assert group.open_group("derived").open_array("mask", "int32").to_numpy().tolist() == [7, 7, 7]
    assert group.open("derived/mask").path == "derived/mask" and rows(hierarchy.children_of(group.open("derived"))) == [want[3]]
    with pytest.raises(DTypeMismatch):
        group.open_array("bold", "int64")
    with pytest.raises(NodeNotFound):
        group.open("nothing")
    with pytest.raises(NodeNotFound):
        open_group(spark, root, "derived", mode="require")
    with pytest.raises(ValueError):
        open_array(spark, root, "bold", mode="sometimes")
    with pytest.raises(ResourceLimit):
        hierarchy.nodes(spark, root, max_documents=3)
    with pytest.raises(InvalidMetadata):
        open_group(spark, root, "bold")
    with pytest.raises(InvalidMetadata):
        open_array(spark, root)
    with pytest.raises(NodeNotFound):
        open_node(spark, root, "nothing")
    with pytest.raises(NodeNotFound):
        hierarchy.nodes(spark, root, "require")
    with pytest.raises(NodeExists):
        write.create_group(spark, root)
    os.makedirs(f"{root}/bold/inside")
    with open(f"{root}/bold/inside/zarr.json", "w") as f:
        f.write('{"zarr_format":3,"node_type":"group"}')
    with pytest.raises(InvalidHierarchy):
        hierarchy.nodes(spark, root)


def test_v2_consolidated(spark, tmp_path):
    array = json.loads(render_v2(ArrayDescriptor((2, 3), (2, 3), dtype("int16"), -1, (LITTLE,), encoding="v2", separator=".", zarr_format=2))[0])
    meta = {".zgroup": {"zarr_format": 2}, ".zattrs": {"title": "root"}, "bold/.zarray": array, "bold/.zattrs": {"_ARRAY_DIMENSIONS": ["y", "x"]}, "derived/mask/.zarray": array}
    (tmp_path / ".zmetadata").write_text(json.dumps({"zarr_consolidated_format": 1, "metadata": meta}))
    os.makedirs(tmp_path / "bold")
    (tmp_path / "bold/0.0").write_bytes(np.arange(6, dtype="<i2").tobytes())
    rows = sorted(tuple(r) for r in hierarchy.nodes(spark, str(tmp_path)).collect())
    assert rows == [("", "group", 2), ("bold", "array", 2), ("derived", "group", 2), ("derived/mask", "array", 2)]
    a = open_array(spark, str(tmp_path), "bold")
    assert a.descriptor.names == ("y", "x") and a.to_numpy().tolist() == [[0, 1, 2], [3, 4, 5]]
    assert values(open_array(spark, str(tmp_path), "derived/mask").read_all(), ["i0", "i1"]) == [-1] * 6


@pytest.mark.parametrize("n", [1, 7])
def test_coalescing_limits(spark, n):
    rows = [(0, 10), (10, 10), (25, 5), (40, 0), (100, 60)]
    frame = spark.createDataFrame([(k, a, b) for k in range(n) for a, b in rows], "k int, offset long, length long")
    got = lambda gap, span: [tuple(r)[1:] for r in coalesced(frame, ["k"], gap, span).where("k = 0").orderBy("start").collect()]
    assert got(0, 1000) == [(0, 20, 2), (25, 30, 1), (40, 40, 1), (100, 160, 1)]
    assert got(10, 1000) == [(0, 40, 4), (100, 160, 1)]
    assert got(10, 25) == [(0, 20, 2), (25, 40, 2), (100, 160, 1)]


def test_plans(spark):
    d = ArrayDescriptor((8, 10), (4, 4), dtype("int16"), 0)
    rows = S.chunk_plan(spark, d, S.region(d.shape, (2, 3), (5, 6))).orderBy("nth").collect()
    assert [(r.c0, r.c1) for r in rows] == [(a, b) for a in (0, 1) for b in (0, 1, 2)] and sum(r.elements for r in rows) == 30
    points = spark.createDataFrame([(0, 2, 1), (1, 1, 2), (2, 2, 1), (3, 2, 3)], "ord long, i0 long, i1 long")
    plan = S.point_plan(points, ArrayDescriptor((8, 8), (4, 4), dtype("int16"), 0)).first()
    assert [(p.dest, p.source) for p in plan.points] == [(0, 9), (1, 6), (2, 9), (3, 11)]
    wide = ArrayDescriptor((1200, 200000), (64, 4096), dtype("int16"), 0)
    stats = S.plan_stats(wide, S.checked(wide.shape, [S.All(), S.Indices(range(0, 200000, 2))]))
    assert stats == {"chunks": 931, "axis_groups": 68, "explicit_indices": 100000, "axis_references": 1862, "elements": 120_000_000}
    huge = ArrayDescriptor((10**12,), (16,), dtype("int8"), 0)
    got = S.chunk_plan(spark, huge, S.checked(huge.shape, [S.Slice(5, 10**12, 10**11)])).orderBy("nth").collect()
    assert [r.c0 for r in got] == [(5 + k * 10**11) // 16 for k in range(10)]


SELECTORS = st.one_of(st.just(S.All()), st.builds(lambda a, n, s: S.Slice(min(a, 7), min(7, a + n), s), st.integers(0, 7), st.integers(0, 7), st.integers(1, 9)), st.lists(st.integers(0, 6), max_size=4).map(S.Indices))


@settings(max_examples=12, deadline=None)
@given(SELECTORS, st.integers(1, 8))
def test_axis_plans_equal_enumeration(spark, selector, chunk):
    (axis,) = S.checked((7,), [selector])
    picked = list(axis.inside(0, 7)[0])
    want = {}
    for p in picked:
        want[p // chunk] = want.get(p // chunk, 0) + 1
    rows = S.axis_plan(spark, axis, chunk).orderBy("pos").collect()
    assert {r.chunk: r.n for r in rows} == want and [r.chunk for r in rows] == sorted(want) and axis.touched(chunk) == len(want)


def test_many_chunks_on_an_axis(spark, tmp_path):
    d = ArrayDescriptor((600,), (2,), dtype("int16"), 0)
    data = np.arange(600, dtype=np.int16)
    a = write.create_and_open(write.cells_of_numpy(spark, data, d), f"{tmp_path}/a", d)
    assert (a.to_numpy() == data).all() and values(a.region((5,), (590,)), ["i0"]) == list(range(5, 595))


def test_encoding_errors_name_the_fault(spark, tmp_path):
    d = ArrayDescriptor((4,), (2,), dtype("int8"), 0)
    with pytest.raises(Exception, match="outside int8|CAST_OVERFLOW|overflow"):
        write.create_array(spark.createDataFrame([(0, 900)], "i0 long, v int"), f"{tmp_path}/z", d)
    assert CodecError.__mro__[1].__name__ == "ArrayError"


def test_v3_consolidated(spark, tmp_path):
    d = ArrayDescriptor((3,), (2,), dtype("int32"), 7)
    write.create_fill_array(spark, f"{tmp_path}/h", d, "bold")
    inline = {"kind": "inline", "must_understand": False, "metadata": {"bold": json.loads(render_v3(d.checked())), "derived": {"zarr_format": 3, "node_type": "group"}}}
    (tmp_path / "h/zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "consolidated_metadata": inline}))
    os.remove(tmp_path / "h/bold/zarr.json")  # the index answers for it
    root = f"{tmp_path}/h"
    assert sorted(tuple(r) for r in hierarchy.nodes(spark, root, "require").collect()) == [("", "group", 3), ("bold", "array", 3), ("derived", "group", 3)]
    assert open_array(spark, root, "bold").to_numpy().tolist() == [7, 7, 7]
    with pytest.raises(NodeNotFound):
        open_node(spark, root, "bold", mode="ignore")
    with pytest.raises(NodeNotFound):
        open_node(spark, root, "nothing")
    with pytest.raises(NodeNotFound):
        open_node(spark, f"{tmp_path}/none", "x", mode="require")


CHAINS = st.tuples(
    st.sampled_from(["int8", "uint16", "int64", "float32", "float64", "bool"]),
    st.permutations(range(3)), st.booleans(), st.sampled_from(["little", "big"]),
    st.lists(st.sampled_from([C.Gzip(1), C.Zlib(1), C.Zstd(1), C.Crc32c(), C.Blosc("zstd", 1, "shuffle", 4)]), max_size=3),
)


@settings(max_examples=80, deadline=None)
@given(CHAINS, st.tuples(*[st.integers(1, 5)] * 3), st.integers(0, 2**32))
def test_any_chain_round_trips(chain, shape, seed):
    name, order, delta, endian, rest = chain
    t = dtype(name)
    x = np.random.default_rng(seed).integers(0, 2 if name == "bool" else 100, shape).astype(t.numpy)
    codecs = C.checked_chain(C.typed((C.Transpose(tuple(order)), *([C.Delta()] if delta else []), C.Bytes(endian), *rest), t), shape, t)
    assert C.decode_chunk(C.encode_chunk(x, codecs, t), shape, codecs, t).tobytes() == x.tobytes()


class CountedFile:
    """A file that keeps which ranges were read of it."""

    def __init__(self, data):
        self.data, self.reads = data, []

    def size(self):
        return len(self.data)

    def read_at(self, n, at):
        self.reads.append((at, n))
        return self.data[at : at + n]


@pytest.mark.parametrize("location", ["start", "end"])
def test_shards_are_read_in_ranges(location):
    """The index and the ranges of the selected inner chunks, near ones as one; never the others' bytes."""
    from tesserae.plans import shards as P
    from tesserae.sources.arrays import blocks

    s = Sharding((4, 4), (C.Bytes("little"),), location=location)
    d = ArrayDescriptor((16, 16), (16, 16), dtype("int32"), 7, (), sharding=s)
    values = np.arange(256, dtype="<i4").reshape(16, 16)
    parts = [None if k == 5 else values[at[0] : at[0] + 4, at[1] : at[1] + 4].tobytes() for k, at in P.shard_slices(s, d.chunks)]
    data = P.assemble(parts, s, d.chunks)
    for box, n_reads, n_bytes in ((((0, 0), (16, 16)), 2, 15 * 64), (((5, 5), (1, 1)), 1, 0), (((13, 13), (2, 2)), 2, 64), (((0, 0), (4, 8)), 2, 128)):
        axes, file = S.region(d.shape, *box), CountedFile(data)
        got = np.full((16, 16), -1)
        for (a, b), block in blocks(d, (0, 0), file, axes):
            got[a : a + 4, b : b + 4] = block
        want = np.where((np.arange(16)[:, None] // 4 == 1) & (np.arange(16) // 4 == 1), 7, values)
        part = tuple(slice(o, o + e) for o, e in zip(*box))
        assert (got[part] == want[part]).all()
        assert len(file.reads) == n_reads and sum(n for _, n in file.reads) == n_bytes + s.index_length(d.chunks)
    far = [(0, 10), (5000, 10), (20, 4000), (9000, 10)]
    assert P.near_ranges(far, max_gap=100) == [(0, 4020), (5000, 5010), (9000, 9010)]
    assert P.near_ranges([]) == [] and P.near_ranges(far, max_gap=1 << 20) == [(0, 9010)]


def test_untouched_objects_are_not_opened(spark, tmp_path):
    """All objects outside of the selection are spoiled: opening one of them would fail."""
    d = ArrayDescriptor((700, 4), (1, 4), dtype("int32"), 0, (C.Bytes("little"), C.Crc32c()))
    cells = spark.range(2800).selectExpr("id div 4 as i0", "id % 4 as i1", "cast(id as int) as v")
    a = write.create_and_open(cells, str(tmp_path / "store"), d)
    kept = {*range(300, 600), 0, 699}
    for k in range(700):
        if k not in kept:
            next((tmp_path / "store").rglob(f"c/{k}/0")).write_bytes(b"spoiled")
    assert a.region((300, 1), (300, 2)).agg({"v": "sum"}).first()[0] == sum(4 * r + c for r in range(300, 600) for c in (1, 2))
    assert [r.v for r in a.points([(0, 0), (699, 3), (0, 0)]).orderBy("ord").collect()] == [0, 2799, 0]
    assert a.select(S.Slice(0, 700, 699), S.All()).count() == 8


def test_fold_in_runs(spark, tmp_path):
    """Partial folds merge to the fold in order, with missing chunks, a stop in the middle, and any number of runs."""
    d = ArrayDescriptor((23, 7), (4, 3), dtype("int32"), -1)
    cells = spark.range(23 * 7).selectExpr("id div 7 as i0", "id % 7 as i1", "cast(id as int) as v").where("i0 < 8 or i0 >= 12")
    a = write.create_and_open(cells, str(tmp_path / "store"), d)
    axes = S.region(d.shape, (2, 1), (20, 6))
    listed = lambda state, table: (state + table["v"].to_pylist(), True)
    want, receipt = fold.fold_chunks(a, axes, [], listed)
    for runs in (1, 3, 40):
        got, r = fold.fold_ranges(a, axes, [], listed, lambda x, y: x + y, runs)
        assert got == want and r == receipt
    stop = lambda state, table: (state + table["v"].to_pylist(), 29 not in table["v"].to_pylist())
    want, _ = fold.fold_chunks(a, axes, [], stop)
    got, r = fold.fold_ranges(a, axes, [], stop, lambda x, y: x + y, 4)
    assert got == want and not r.completed


def test_small_chunks_are_encoded_in_runs_and_large_ones_across_batches(spark):
    d = ArrayDescriptor((4000, 3), (2, 3), dtype("int32"), -1)
    cells = spark.range(12000).where("id % 7 < 3").select((F.col("id") / 3).cast("long").alias("i0"), (F.col("id") % 3).alias("i1"), F.col("id").cast("int").alias("v"))
    objects = write.encoded(cells, d)
    assert "FlatMapGroups" not in objects._jdf.queryExecution().executedPlan().toString()  # a group for each chunk costs more than the chunk
    want = np.full(12000, -1, "<i4")
    held = np.arange(12000)[np.arange(12000) % 7 < 3]
    want[held] = held
    got = {(r["c0"], r["c1"]): bytes(r["payload"]) for r in objects.collect()}
    assert got == {(c, 0): want[6 * c : 6 * c + 6].tobytes() for c in np.unique(held // 6).tolist()}

    columns = lambda i: pa.RecordBatch.from_pydict({"c0": pa.array(i // 6), "i0": pa.array(i), "v": pa.array(i.astype("i4"))})
    line = ArrayDescriptor((600,), (6,), dtype("int32"), -1).checked()
    runs = list(write._blocks(iter([columns(np.arange(k, min(k + 100, 600))) for k in range(0, 600, 100)]), line, 50))
    assert [c for at, _, _ in runs for c in at[:, 0].tolist()] == list(range(100)) and len(runs) < 20
    assert np.array_equal(np.concatenate([b.ravel() for _, b, _ in runs]), np.arange(600)) and all(s.all() for _, _, s in runs)
    for again in ([5, 5], [5, 4]):  # within a batch, and in the next one
        with pytest.raises(CodecError, match=r"repeated coordinates in chunk \[0\]"):
            list(write._blocks(iter([columns(np.array([3, 4])), columns(np.array(again))]), line, 50))


def test_small_chunks_are_read_together(spark, tmp_path):
    d = ArrayDescriptor((61, 47), (4, 3), dtype("int32"), -1)
    want = np.where(np.add.outer(np.arange(61) // 4, np.arange(47) // 3) % 3 == 0, np.arange(61 * 47).reshape(61, 47), -1).astype("i4")
    write.create_array(write.cells_of_numpy(spark, want, d).where("v >= 0"), f"{tmp_path}/a", d)
    a = open_array(spark, f"{tmp_path}/a")
    assert a.missing(a.all_axes()).count() > 100
    chunks = [(x, y) for x in range(16) for y in range(16)]
    batches = list(gathered(a.descriptor, (p for c in chunks for p in opened(a.descriptor, c, f"{tmp_path}/a/c/{c[0]}/{c[1]}", a.all_axes())), a.all_axes(), False))
    assert len(batches) <= 4 and sum(map(len, batches)) == want.size  # whole chunks and three kinds of border ones, not 256
    got = pa.Table.from_batches(batches)
    assert np.array_equal(want[got["i0"].to_numpy(), got["i1"].to_numpy()], got["v"].to_numpy())
    for rows, cols, r, c in [
        (S.All(), S.All(), slice(0, 61), slice(0, 47)), (S.Slice(5, 50), S.Slice(2, 41), slice(5, 50), slice(2, 41)),
        (S.Slice(1, 60, 2), S.Slice(0, 47, 7), slice(1, 60, 2), slice(0, 47, 7)),
        (S.Indices([60, 3, 3, 1, 17, 16]), S.All(), [60, 3, 3, 1, 17, 16], slice(0, 47)),
        (S.Indices([2, 1] * 40), S.Indices([46, 0, 2, 0]), [2, 1] * 40, [46, 0, 2, 0]),
    ]:
        assert np.array_equal(a.to_numpy(rows, cols), want[r][:, c])


def test_small_objects_cost_one_creation_each(spark, tmp_path):
    steps = []
    sys.addaudithook(lambda event, args: steps.append(event) if event in ("open", "os.mkdir", "os.rename") and str(tmp_path) in str(args[0]) else None)
    create = files.creator(f"file://{tmp_path}/a")
    for k in range(100):
        create(f"c/{k // 50}/{k}", bytes([k]))
    assert steps.count("open") <= 102 and steps.count("os.mkdir") <= 4 and steps.count("os.rename") == 0
    assert [(tmp_path / f"a/c/{k // 50}/{k}").read_bytes() for k in range(100)] == [bytes([k]) for k in range(100)]
    (tmp_path / "a/c/0/7").write_bytes(b"longer than the object of the attempt before")
    create("c/0/7", b"whole")
    assert (tmp_path / "a/c/0/7").read_bytes() == b"whole" and len(list((tmp_path / "a/c/0").iterdir())) == 50

    d = ArrayDescriptor((512, 100_000), (8, 5), dtype("int32"), -1)
    cells = spark.range(2000).select((F.col("id") % 512).alias("i0"), (F.col("id") * 49).alias("i1"), F.lit(1).alias("v"))
    assert write.write_cells(cells, d, f"file://{tmp_path}/b")._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    stretches = write._sorted(cells, d).select("c0", F.expr("c1 div 1250"), F.spark_partition_id().alias("task")).distinct()
    assert stretches.groupBy("c0", "(c1 div 1250)").count().where("count > 1").count() == 0  # not a task for every few chunks of a grid that is mostly empty


def test_folders_of_a_wide_read_are_listed(spark, tmp_path, monkeypatch):
    d = ArrayDescriptor((301, 1211), (8, 5), dtype("float32"), float("nan"))
    want = np.full(d.shape, np.nan, "f4")
    want[::37, ::101] = np.arange(9 * 12).reshape(9, 12)
    want[160:176, 400:450] = 7  # neighbouring chunks
    write.create_array(write.cells_of_numpy(spark, want, d).where("not isnan(v)"), f"{tmp_path}/a/b", d)
    (tmp_path / "a/b/c/4/007").write_bytes(b"no object")
    (tmp_path / "a/b/c/4/8").mkdir()
    a = open_array(spark, f"{tmp_path}/a", "b")
    monkeypatch.setattr(arrays, "LISTED_CHUNKS", 100)
    monkeypatch.setattr(arrays, "FILL_CELLS", 64)
    monkeypatch.setattr(S, "MAX_CHUNKS", 1000)  # of 38 * 243
    for rows, cols in [(slice(0, 301), slice(0, 1211)), (slice(3, 290), slice(407, 1202)), (slice(16, 24), slice(1, 1209))]:
        part, (h, w) = want[rows, cols], want[rows, cols].shape
        cells = a.region((rows.start, cols.start), (h, w)).toArrow()
        i, j = cells["i0"].to_numpy() - rows.start, cells["i1"].to_numpy() - cols.start
        assert len(cells) == part.size and len(np.unique(i * w + j)) == part.size
        assert np.array_equal(part[i, j], cells["v"].to_numpy(), equal_nan=True)
        placed = S.Slice(rows.start, rows.stop), S.Slice(cols.start, cols.stop)
        assert np.array_equal(a.to_numpy(*placed), part, equal_nan=True)
    with pytest.raises(ResourceLimit):
        a.select(S.Slice(0, 301, 2), S.All())  # each key is opened

    monkeypatch.undo()
    write.create_fill_array(spark, f"{tmp_path}/wide", ArrayDescriptor((540_000, 180_000), (8, 5), dtype("int32"), -1))
    wide = open_array(spark, f"{tmp_path}/wide")
    assert wide.read_all().columns == ["i0", "i1", "v"]  # of 2,430,000,000 chunks
    assert list(fill_boxes(a.descriptor, [37], range(0, 243), [0, 1, 5, 242], a.all_axes())) == [((296, 300), (10, 24)), ((296, 300), (30, 1209))]
