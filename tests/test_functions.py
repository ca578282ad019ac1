"""Geometry, strict JSON, scalar types and codecs. Golden bytes come from independent public writers of the format."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.errors import CodecError, InvalidJson, InvalidKey, InvalidMetadata, InvalidSelection, ResourceLimit, Unsupported
from tesserae.functions import codecs as C
from tesserae.functions import geometry as G
from tesserae.functions.dtypes import BUILT_IN, dtype, v2_dtype
from tesserae.functions.strict_json import dumps, loads

INT16 = np.array([[1, -2, 300], [4, 5, -6]], np.int16)
# Encoded forms of the array above and of a delta chunk.
GOLDEN = {
    "bytes": "0100feff2c0104000500faff",
    "gzip": "1f8b08005c125e6a04ff6364f8f75f8791858195e1d77f0052120ac00c000000",
    "zlib": "78016364f8f75f8791858195e1d77f001781042e",
    "shuffle": "01fe2c0405fa00ff010000ff",
    "delta": "6402fc0102fd0000ff0000ff",
}


def test_grids_and_regions():
    assert G.grid_shape((4, 5, 0), (2, 3, 4)) == (2, 2, 0)
    assert G.element_count(()) == 1 and G.element_count((0, 1 << 62, 1 << 62)) == 0
    with pytest.raises(ResourceLimit):
        G.element_count((1 << 62, 4))
    assert G.checked_region((4, 5), (1, 5), (3, 0)) == ((1, 3), (5, 0))
    for bad in [((0, 0), (5, 1)), ((-1, 0), (1, 1)), ((0,), (1,))]:
        with pytest.raises(InvalidSelection):
            G.checked_region((4, 5), *bad)


def test_keys(spark):
    assert [G.chunk_key((0, 1)), G.chunk_key((), "default"), G.chunk_key((), "v2"), G.chunk_key((0, 1), "v2", ".")] == ["c/0/1", "c", "0", "0.1"]
    keys = ["a/b", "c/0", "x-1_~.y", "", "/a", "a//b", "a/../b", ".", "a\\b", "a%2Fb", "a%5cb", "é", "a/"]
    want = []
    for k in keys:
        try:
            want.append(G.valid_key(k) == k)
        except InvalidKey:
            want.append(False)
    assert want == [True, True, True] + [False] * 10
    frame = spark.createDataFrame(list(enumerate(keys)), "n int, k string")
    from pyspark.sql import functions as F

    assert [r[1] for r in frame.select("n", G.is_valid_key(F.col("k"))).orderBy("n").collect()] == want


def test_unravel_and_linear_are_inverse(spark):
    shape = (3, 4, 5)
    rows = spark.range(60).select("id", *G.unravel("id", shape, "i")).select("id", G.linear(["i0", "i1", "i2"], shape).alias("back"), "i0", "i1", "i2").collect()
    assert all(r.id == r.back and (r.i0, r.i1, r.i2) == np.unravel_index(r.id, shape) for r in rows)


@pytest.mark.parametrize("bad", ['{"a":1,"a":2}', "NaN", "[1,]", '"\\ud800"', "[" * 200 + "]" * 200, "", "{'a':1}", "01"])
def test_json_is_strict(bad):
    with pytest.raises(InvalidJson):
        loads(bad)


def test_json_keeps_numbers():
    text = '{"b":1.50e+02,"a":[12345678901234567890,-0.0,null,true,"é\\n"]}'
    assert dumps(loads(text)) == '{"a":[12345678901234567890,-0.0,null,true,"é\\n"],"b":1.50e+02}'


@pytest.mark.parametrize(
    ("name", "value", "raw"),
    [
        ("bool", "true", "01"), ("int8", "-128", "80"), ("uint64", "18446744073709551615", "ff" * 8), ("float32", '"NaN"', "0000c07f"),
        ("float32", '"0x7fc00001"', "0100c07f"), ("float64", '"-Infinity"', "000000000000f0ff"), ("float16", "1.5", "003e"),
        ("complex64", '[1,"NaN"]', "0000803f0000c07f"), ("r24", "[1,2,255]", "0102ff"), ("int32", "1e3", "e8030000"),
    ],
)
def test_fill_values(name, value, raw):
    kind = dtype(name)
    fill = kind.fill(loads(value))
    assert fill.tobytes().hex() == raw
    assert kind.fill(loads(dumps(kind.fill_json(fill)))).tobytes() == fill.tobytes()


@pytest.mark.parametrize(("name", "value"), [("bool", "1"), ("int8", "128"), ("int8", "1.5"), ("uint8", "-1"), ("float32", '"nan"'), ("float32", '"0x7fc0"'), ("complex64", "[1]"), ("r16", "[1,256]"), ("r16", "[1]"), ("int16", "null")])
def test_bad_fill_values(name, value):
    with pytest.raises(InvalidMetadata):
        dtype(name).fill(loads(value))


def test_types():
    assert v2_dtype(">i2") == (dtype("int16"), "big") and v2_dtype("|u1") == (dtype("uint8"), "little")
    for bad in ("i2", "|i2", "<x4", "<M8[ns]", "<i3"):
        with pytest.raises(InvalidMetadata):
            v2_dtype(bad)
    for bad in ("r0", "r7", "string"):
        with pytest.raises(InvalidMetadata):
            dtype(bad)
    extremes = {"i": lambda t: [np.iinfo(t).min, -1, 0, np.iinfo(t).max], "u": lambda t: [0, 1, np.iinfo(t).max], "f": lambda t: [0.0, -0.0, 1.5, -2.25, np.inf, -np.inf, np.nan], "c": lambda t: [1 + 2j, complex("nan"), -0.0], "b": lambda t: [False, True]}
    for t in [*BUILT_IN.values(), dtype("r24")]:
        values = np.frombuffer(b"abcdef", "V3") if t.kind == "V" else np.array(extremes[t.kind](t.numpy), t.numpy)
        assert t.from_arrow(t.to_arrow(values)).tobytes() == values.tobytes()


def test_golden_bytes():
    kind, chain = dtype("int16"), {"bytes": (), "gzip": (C.Gzip(1),), "zlib": (C.Zlib(1),), "shuffle": (C.Shuffle(2),)}
    for name, rest in chain.items():
        raw = bytes.fromhex(GOLDEN[name])
        assert (C.decode_chunk(raw, (2, 3), (C.Bytes("little"), *rest), kind) == INT16).all()
        if name != "gzip":
            assert C.encode_chunk(INT16, (C.Bytes("little"), *rest), kind) == raw
    delta = C.typed((C.Delta(), C.Bytes("little"), C.Shuffle(2)), kind)
    want = np.array([[100, 102, 98], [99, 101, 98]], np.int16)
    assert (C.decode_chunk(bytes.fromhex(GOLDEN["delta"]), (2, 3), delta, kind) == want).all()
    assert C.encode_chunk(want, delta, kind).hex() == GOLDEN["delta"]
    fortran = (C.Transpose((1, 0)), C.Bytes("big"))
    assert C.decode_chunk(bytes.fromhex("000100040002000500030006"), (2, 3), fortran, kind).tolist() == [[1, 2, 3], [4, 5, 6]]


def test_delta_of_each_family():
    def out(name, values, astype=None):
        t = dtype(name)
        c = C.Delta(t, dtype(astype) if astype else t)
        x = np.array(values, t.numpy)
        e = c.encode(x, t)
        assert c.decode(e, t).tobytes() == x.tobytes()
        return e.tolist()

    assert out("int16", [100, 102, 98, 99], "int8") == [100, 2, -4, 1]
    assert out("int8", [-128, 127, -128]) == [-128, -1, 1]
    assert out("bool", [True, True, False, True]) == [True, False, True, True]
    assert out("float32", [1.0, 1.5, 0.5], "float16") == [1.0, 0.5, -1.0]


def test_checksums_and_digests():
    assert C.crc32c(b"123456789") == 0xE3069283 and C.crc32c(b"") == 0
    rng = np.random.default_rng(0)
    for n in (1, 8191, 8192, 8193, 100_003):
        data = rng.integers(0, 256, n, np.uint8).tobytes()
        table, crc = C._crc_table(), 0xFFFFFFFF
        for b in data:
            crc = int(table[(crc ^ b) & 0xFF]) ^ (crc >> 8)
        assert C.crc32c(data) == crc ^ 0xFFFFFFFF
    assert hashlib.sha256(b"abc").hexdigest().startswith("ba7816bf")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([C.Gzip(0), C.Gzip(9), C.Zlib(-1), C.Zstd(0), C.Zstd(-5, True), C.Crc32c(), C.Blosc("zstd", 5, "noshuffle", 1), C.Blosc("zstd", 0, "shuffle", 4, 256), C.Blosc("zstd", 9, "bitshuffle", 3, 1000), C.Shuffle(1)]))
def test_byte_codecs_round_trip(data, codec):
    assert codec.decode(codec.encode(data), 3000) == data


def test_bad_bytes():
    good = zlib.compress(b"x" * 100)
    for codec, data in [(C.Zlib(), good[:-1]), (C.Zlib(), good + b"x"), (C.Zlib(), b""), (C.Gzip(), good), (C.Zstd(), b"abc"), (C.Crc32c(), b"abcde"), (C.Crc32c(), b"a"), (C.Shuffle(4), b"abcde"), (C.Blosc(), b"\x02" * 16), (C.Blosc(), C.Blosc().encode(b"ab" * 500)[:-1])]:
        with pytest.raises(CodecError):
            codec.decode(data, 1000)
    with pytest.raises(CodecError):
        C.Zlib().decode(zlib.compress(b"x" * 1000), 999)
    with pytest.raises(CodecError):
        C.decode_chunk(b"\x02", (1,), (C.Bytes(None),), dtype("bool"))
    with pytest.raises(CodecError):
        C.decode_chunk(b"\x00", (1,), (C.Bytes("little"),), dtype("int16"))


def test_chains():
    kind = dtype("int16")
    with pytest.raises(InvalidMetadata):
        C.checked_chain((C.Gzip(), C.Bytes()), (2,), kind)
    with pytest.raises(InvalidMetadata):
        C.checked_chain((C.Bytes(), C.Bytes()), (2,), kind)
    with pytest.raises(InvalidMetadata):
        C.checked_chain((C.Transpose((1, 0)), C.Bytes()), (2,), kind)
    with pytest.raises(Unsupported):
        C.BUILT_IN["blosc"]({"cname": "lz4"}, kind)
    two = (C.Bytes(), C.Crc32c(), C.Gzip(1))
    assert (C.decode_chunk(C.encode_chunk(INT16, two, kind), (2, 3), two, kind) == INT16).all()
