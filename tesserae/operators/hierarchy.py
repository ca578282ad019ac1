"""Nodes of a store as a DataFrame ``(path, kind, format)``.

From the consolidated document where there is one, else from a listing. The checks are grouped flags and joins of each
node with its ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.errors import InvalidHierarchy, NodeNotFound
from tesserae.functions.strict_json import Number, loads
from tesserae.sources.arrays import MODES, Group
from tesserae.sources.objects import Store

_NAMES = ("zarr.json", ".zarray", ".zgroup", ".zattrs")
_SCHEMA = "path string, kind string, format int"
#: Documents that are listed where there is no consolidated one, at most.
MAX_DOCUMENTS = 100_000


def nodes(spark: SparkSession, root: str, mode: str = "prefer", max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """All nodes; ``mode`` says whether a consolidated document is preferred, required or ignored.

    A listing of more than ``max_documents`` documents is an error.
    """
    store = Store(spark, root)
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}")
    if mode != "ignore":
        raw = store.read("zarr.json")
        inline = loads(raw).get("consolidated_metadata") if raw else None
        if inline:
            if inline.get("kind") == "inline":
                return _checked(_v3(spark, inline.get("metadata", {})), spark)
            if inline.get("must_understand", True):
                raise InvalidHierarchy(f"consolidated metadata of kind {inline.get('kind')!r}")
        elif raw is None and (whole := store.read(".zmetadata")):
            doc = loads(whole)
            if doc.get("zarr_consolidated_format") != Number("1"):
                raise InvalidHierarchy("consolidated format is not 1")
            return _checked(_v2(spark, list(doc.get("metadata", {}))), spark)
    if mode == "require":
        raise NodeNotFound("no consolidated metadata")
    return _listed(spark, store, max_documents)


def children_of(group: Group) -> DataFrame:
    """Immediate children of an opened group."""
    return children(group.spark, group.root, group.path, group.mode)


def children(spark: SparkSession, root: str, path: str = "", mode: str = "prefer") -> DataFrame:
    """Immediate children of the group at ``path``."""
    return nodes(spark, root, mode).where(F.regexp_replace("path", "/?[^/]+$", "") == path).where("path <> ''")


def _v3(spark: SparkSession, metadata: dict) -> DataFrame:
    rows = [("", "group", 3)] + [(k.strip("/"), doc.get("node_type"), 3) for k, doc in metadata.items()]
    return spark.createDataFrame(rows, _SCHEMA)


def _v2(spark: SparkSession, keys: list[str]) -> DataFrame:
    """Nodes of a v2 index; ancestors that it leaves out are groups."""
    found = _flags(spark.createDataFrame([(k,) for k in keys], "key string"))
    if found.where("n_attrs > 0 and n_array + n_group = 0").limit(1).count():
        raise InvalidHierarchy("attributes without a node")
    own = found.select("path", F.when(F.col("n_array") > 0, "array").otherwise("group").alias("kind"), F.lit(2).alias("format"))
    inferred = _ancestors(own).select(F.col("above").alias("path"), F.lit("group").alias("kind"), F.lit(2).alias("format")).distinct()
    return own.unionByName(inferred.join(own, "path", "left_anti"))


def _flags(listing: DataFrame) -> DataFrame:
    """Documents of each node, counted by kind."""
    name = F.substring_index("key", "/", -1)
    rows = listing.select(F.regexp_replace("key", "/?[^/]+$", "").alias("path"), name.alias("name")).where(name.isin(*_NAMES))
    n = lambda x: F.count_if(F.col("name") == x)
    return rows.groupBy("path").agg(n("zarr.json").alias("n_v3"), n(".zarray").alias("n_array"), n(".zgroup").alias("n_group"), n(".zattrs").alias("n_attrs"))


def _ancestors(found: DataFrame) -> DataFrame:
    """``(path, above)`` for each proper ancestor, the root included."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return found.where("path <> ''").select("path", F.explode(above).alias("above"))


def _listed(spark: SparkSession, store: Store, limit: int) -> DataFrame:
    listing = store.documents(_NAMES, limit)
    found = _flags(spark.createDataFrame([(k,) for k, _ in listing], "key string"))
    bad = (
        F.when((F.col("n_v3") > 0) & (F.col("n_array") + F.col("n_group") > 0), "v2 and v3 documents")
        .when((F.col("n_array") > 0) & (F.col("n_group") > 0), "array and group documents")
        .when((F.col("n_attrs") > 0) & (F.col("n_array") + F.col("n_group") == 0), "attributes without a node")
    )
    if wrong := found.select("path", bad.alias("bad")).where("bad is not null").orderBy("path").limit(1).collect():
        raise InvalidHierarchy(f"{wrong[0].path or 'the root'}: {wrong[0].bad}")
    kinds = [(k.rpartition("/")[0], loads(store.read(k)).get("node_type")) for k, _ in listing if k.endswith("zarr.json")]
    kinds = spark.createDataFrame(kinds, "path string, node_type string")
    kind = F.when(F.col("n_v3") > 0, F.col("node_type")).when(F.col("n_array") > 0, "array").otherwise("group")
    rows = found.join(kinds, "path", "left").select("path", kind.alias("kind"), F.when(F.col("n_v3") > 0, 3).otherwise(2).alias("format"))
    return _checked(rows, spark)


def _checked(found: DataFrame, spark: SparkSession) -> DataFrame:
    """Nodes of one format and of known kinds, once each, none below an array."""
    flags = found.agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"), F.countDistinct("format").alias("formats"), F.count_if(~F.col("kind").isin("array", "group") | F.col("kind").isNull()).alias("odd")).first()
    if flags.n != flags.paths:
        raise InvalidHierarchy("a node appears twice")
    if flags.formats > 1:
        raise InvalidHierarchy("nodes of both formats")
    if flags.odd:
        raise InvalidHierarchy("a node that is neither array nor group")
    arrays = found.where("kind = 'array'").select(F.col("path").alias("above"))
    if below := _ancestors(found).join(arrays, "above").limit(1).collect():
        raise InvalidHierarchy(f"{below[0].path} lies below the array {below[0].above}")
    return found
