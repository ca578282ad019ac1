"""Arrays over HTTP and as a SQL table."""

import http.server
import threading
from functools import partial

import numpy as np
import pytest

from tesserae.errors import ArrayError
from tesserae.functions.dtypes import dtype
from tesserae.operators import write
from tesserae.plans import selection as S
from tesserae.plans.descriptor import ArrayDescriptor, Sharding
from tesserae.sources import datasource, http as remote
from tesserae.sources.arrays import open_array

DATA = np.arange(77, dtype=np.int32).reshape(7, 11)


@pytest.fixture
def stored(spark, tmp_path):
    d = ArrayDescriptor((7, 11), (3, 4), dtype("int32"), -1)
    cells = write.cells_of_numpy(spark, DATA, d).where("not (i0 < 3 and i1 < 4)")
    write.create_array(cells, f"{tmp_path}/a", d)
    write.create_array(cells, f"{tmp_path}/s", ArrayDescriptor((7, 11), (6, 8), dtype("int32"), -1, (), Sharding((3, 4))))
    want = DATA.copy()
    want[:3, :4] = -1
    return tmp_path, want


class Handler(http.server.SimpleHTTPRequestHandler):
    ranges = True

    def log_message(self, *args):
        pass

    def do_GET(self):
        asked = self.headers.get("Range")
        if not asked or not self.ranges:
            return super().do_GET()
        with open(self.translate_path(self.path), "rb") as f:
            data = f.read()
        a, b = map(int, asked.removeprefix("bytes=").split("-"))
        self.send_response(206)
        self.send_header("Content-Range", f"bytes {a}-{min(b, len(data) - 1)}/{len(data)}")
        self.end_headers()
        self.wfile.write(data[a : b + 1])


@pytest.fixture
def served(stored):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), partial(Handler, directory=str(stored[0])))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", stored[1]
    server.shutdown()


def test_http_reads(spark, served):
    root, want = served
    for node in ("a", "s"):
        a = open_array(spark, root, node)
        assert (a.to_numpy() == want).all()
        assert (a.to_numpy(S.Indices([6, 0]), S.Slice(1, 11, 3)) == want[[6, 0]][:, 1:11:3]).all()
        rows = a.points([(6, 10), (0, 0), (6, 10)]).orderBy("ord").collect()
        assert [r.v for r in rows] == [76, -1, 76]


def test_http_ranges(served, monkeypatch):
    root, _ = served
    whole = remote.read(root, "a/zarr.json")
    assert remote.read_range(root, "a/zarr.json", 3, 9) == whole[3:9] and remote.length(root, "a/zarr.json") == len(whole)
    assert remote.read(root, "a/none") is None and remote.length(root, "none") is None
    with pytest.raises(ArrayError, match="range"):
        remote.read_range(root, "a/zarr.json", 3, len(whole) + 5)
    monkeypatch.setattr(Handler, "ranges", False)
    with pytest.raises(ArrayError, match="ignored"):
        remote.read_range(root, "a/zarr.json", 3, 9)
    with pytest.raises(ArrayError):
        remote.read(root, "../a")
    with pytest.raises(ArrayError):
        remote.read("http://127.0.0.1:9", "x")


def test_sql_table(spark, stored):
    root, want = stored
    datasource.register(spark)
    for node in ("a", "s"):
        spark.read.format("tesserae").option("node", node).load(str(root)).createOrReplaceTempView("cells")
        rows = spark.sql("select i0, i1, v from cells where i0 >= 2 and i1 = 5 and i0 < 6").collect()
        assert sorted(map(tuple, rows)) == [(k, 5, want[k, 5]) for k in range(2, 6)]
        assert spark.sql("select sum(v) from cells").first()[0] == want.sum()
        assert spark.sql("select * from cells where i0 > 6").count() == 0


def test_region_prunes_chunks(spark, stored):
    datasource.register(spark)
    options = {"path": str(stored[0]), "node": "a", "origin": "3,0", "extent": "4,4"}
    assert len(range(*datasource.CellSource({k: options[k] for k in ("path", "node")}).reader(None).partitions()[0].value)) == 9
    assert len(range(*datasource.CellSource(options).reader(None).partitions()[0].value)) == 2
    rows = spark.read.format("tesserae").options(**options).load().collect()
    assert sorted(map(tuple, rows)) == [(a, b, DATA[a, b]) for a in range(3, 7) for b in range(4)]


def test_objects_in_a_table(spark, stored):
    from pyspark.sql import functions as F

    from tesserae.sources.arrays import open_table

    root, want = stored
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/a")
    table = rows.select(F.regexp_extract("path", "/a/(.*)$", 1).alias("key"), F.col("content").alias("payload"))
    a = open_table(table)
    assert (a.to_numpy() == want).all()
    assert [r.v for r in a.points([(6, 10), (0, 0)]).orderBy("ord").collect()] == [76, -1]


def test_v2_objects_in_a_table(spark):
    import json

    from tesserae.sources.arrays import open_table

    meta = {"zarr_format": 2, "shape": [3], "chunks": [2], "dtype": "<i2", "compressor": None, "fill_value": -1, "order": "C", "filters": None}
    rows = [("x/.zarray", json.dumps(meta).encode()), ("x/.zattrs", b'{"unit": "m"}'), ("x/0", np.array([4, 5], "<i2").tobytes())]
    a = open_table(spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "key string, payload binary"), "x")
    assert a.descriptor.zarr_format == 2 and a.to_numpy().tolist() == [4, 5, -1]


def test_own_codec_and_type(spark, tmp_path):
    """An external codec and type, end to end."""
    from dataclasses import dataclass

    from tesserae.functions import codecs as C
    from tesserae.functions.dtypes import DType
    from tesserae.sources.arrays import Registry

    @dataclass(frozen=True)
    class Flip(C.Codec):
        name = "flip"

        def encode(self, data):
            return data[::-1]

        def decode(self, data, limit):
            return data[::-1]

    own = DType("day", "i4", "int")
    d = ArrayDescriptor((5,), (2,), own, 0, (C.Bytes("little"), Flip()))
    write.create_array(write.cells_of_numpy(spark, np.arange(5, dtype=np.int32), d), f"{tmp_path}/a", d)
    with pytest.raises(ArrayError):
        open_array(spark, f"{tmp_path}/a")
    a = open_array(spark, f"{tmp_path}/a", registry=Registry({"day": own}, {"flip": lambda c, t: Flip()}))
    assert a.to_numpy().tolist() == [0, 1, 2, 3, 4]
    assert (tmp_path / "a/c/0").read_bytes() == b"\0\0\0\1\0\0\0\0"


def test_stream_of_batches(spark, tmp_path):
    from tesserae.streaming import write_batches

    for k in range(2):
        spark.range(4).selectExpr("id as i0", f"cast(id + {10 * k} as int) as v").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    cells = spark.readStream.schema("i0 long, v int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    d = ArrayDescriptor((4,), (3,), dtype("int32"), 0)
    for _ in range(2):  # the second run finds its batches
        query = write_batches(cells, f"{tmp_path}/out", d).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted(open_array(spark, f"{tmp_path}/out", f"batch-0000000{k}").to_numpy().tolist() for k in range(2))
    assert got == [[0, 1, 2, 3], [10, 11, 12, 13]]
