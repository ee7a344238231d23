"""Tables as published artifacts: line-JSON and CSV readers, atomic publication, success markers.

A published table is a folder.  It is written beside its final place, gets its marker (row count, schema
and an order-insensitive content hash) last, and is moved to its place in one rename; what was there is
moved away first, comes back if the rename fails, and is deleted at the end.  Whoever
reads through open_verified() either gets exactly what was published or an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKER = "_MARKER.json"


class GateError(ValueError):
    """An artifact that is missing or not what its marker says."""


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """One JSON object a line.  Not strict: bad lines come as rows with the text in _corrupt_record; strict: they are errors.

    Blank lines are skipped either way.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    if strict:
        return spark.read.schema(kind).option("mode", "FAILFAST").json(path)
    return spark.read.schema(T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header; a byte-order mark is no part of the first name."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("encoding", "UTF-8").csv(path)


def content_hash(df: DataFrame) -> dict[str, object]:
    """rows, hash and schema of a table; the hash does not depend on the order of rows or files.

    Two sums over 64-bit row hashes of different seeds, in decimal so that they cannot overflow.
    """
    columns = sorted(df.columns)
    text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    one = df.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64(text).cast("decimal(38,0)")).alias("a"),
        F.sum(F.xxhash64(F.lit("second"), text).cast("decimal(38,0)")).alias("b"),
    ).first()
    return {"rows": one["n"], "hash": f"{int(one['a'] or 0):x}.{int(one['b'] or 0):x}", "schema": df.select(*columns).schema.simpleString()}


def _fs(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _fs(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        raise GateError(f"no marker at {path}")
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


@dataclass
class Publication:
    """What goes into a marker besides the figures of the table."""

    version: str = "1"
    upstream: dict[str, str] = field(default_factory=dict)


def publish(df: DataFrame, path: str, how: Publication | None = None, partition_by: list[str] | None = None, kind: str = "parquet") -> dict[str, object]:
    """Write df as the artifact at path and return its marker.  An artifact that is there is replaced."""
    spark, how = df.sparkSession, how or Publication()
    aside = f"{path.rstrip('/')}.tmp-{uuid.uuid4().hex}"
    writer = df.write.format(kind)
    if kind == "csv":
        writer = writer.option("header", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(aside)
    marker = content_hash(spark.read.schema(df.schema).option("header", "true").format(kind).load(aside)) | {"version": how.version, "upstream": how.upstream, "kind": kind}
    _write_text(spark, f"{aside}/{MARKER}", json.dumps(marker, sort_keys=True))
    fs, where = _fs(spark, path)
    old = _fs(spark, f"{path.rstrip('/')}.old-{uuid.uuid4().hex}")[1]
    had = fs.exists(where)
    if had and not fs.rename(where, old):
        raise GateError(f"{path} could not be moved away")
    if not fs.rename(_fs(spark, aside)[1], where):
        if had:
            fs.rename(old, where)
        raise GateError(f"{aside} could not be moved to {path}")
    if had:
        fs.delete(old, True)
    return marker


def open_verified(spark: SparkSession, path: str, schema: T.StructType, version: str | None = None, upstream: dict[str, str] | None = None) -> DataFrame:
    """The artifact at path if it is what its marker says; GateError otherwise.

    upstream: hashes that the artifact must have been made from.
    """
    marker = json.loads(_read_text(spark, f"{path}/{MARKER}"))
    if version is not None and marker.get("version") != version:
        raise GateError(f"{path} has the version {marker.get('version')}")
    for name, wanted in (upstream or {}).items():
        if marker.get("upstream", {}).get(name) != wanted:
            raise GateError(f"{path} was not made from this {name}")
    df = spark.read.schema(schema).option("header", "true").format(marker["kind"]).load(path)
    for k, v in content_hash(df).items():
        if marker.get(k) != v:
            raise GateError(f"{path}: {k} is {v}, the marker says {marker.get(k)}")
    return df


def shard_hashes(rows: DataFrame, shard: str) -> DataFrame:
    """shard, n_rows, hash: rows and order-insensitive content hash of each shard."""
    text = F.to_json(F.struct(*sorted(c for c in rows.columns if c != shard)), {"ignoreNullFields": "false"})
    two = [F.sum(F.xxhash64(F.lit(x), text).cast("decimal(38,0)")).cast("string") for x in ("first", "second")]
    return rows.groupBy(shard).agg(F.count("*").alias("n_rows"), F.concat_ws(".", *two).alias("hash"))


def manifest_check(rows: DataFrame, manifest: DataFrame, shard: str) -> DataFrame:
    """shard, n_rows, expected_rows, status of a sharded table against its manifest (shard, n_rows and, where it has it, hash)."""
    have = shard_hashes(rows, shard)
    given = "hash" in manifest.columns
    want = manifest.select(shard, F.col("n_rows").alias("expected_rows"), (F.col("hash") if given else F.lit(None).cast("string")).alias("expected_hash"))
    both = have.join(want, shard, "full_outer")
    status = F.when(F.col("expected_rows").isNull(), "unknown_shard").when(F.col("n_rows").isNull(), "missing_shard").when(F.col("n_rows") != F.col("expected_rows"), "row_count").when(F.col("hash") != F.col("expected_hash"), "content").otherwise("ok")
    return both.withColumn("status", status).drop("hash", "expected_hash")


def inferred(df: DataFrame, backend, schema: str) -> DataFrame:
    """df through a model that is plugged in: backend(batch) -> batch, called once for each Arrow batch.

    Stands where a network service or a local model would; tests plug in a plain function.
    """
    return df.mapInPandas(lambda batches: (backend(b) for b in batches), schema)
