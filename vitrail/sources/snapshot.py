"""Versioned snapshots of a table: a new version is written whole, then a pointer file is moved to it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

POINTER = "_current.json"  # hidden from readers of the folder


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    # Of a local disk without checksum files, so that a file replaced by hand can be read.
    return (fs.getRaw() if fs.getScheme() == "file" else fs), jvm.org.apache.hadoop.fs.Path


def put_text(spark: SparkSession, file: str, text: str) -> None:
    """Writes a small file whole: readers see the old or the new one, and at no time none. Works on any Hadoop file system."""
    fs, path = _fs(spark, file)
    draft = path(f"{file}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    draft = fs.makeQualified(draft)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, fs.makeQualified(path(file)), options)


def get_text(spark: SparkSession, file: str) -> str | None:
    """The text of a small file, None if it doesn't exist."""
    fs, path = _fs(spark, file)
    if not fs.exists(path(file)):
        return None
    stream = fs.open(path(file))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def exists(spark: SparkSession, file: str) -> bool:
    fs, path = _fs(spark, file)
    return fs.exists(path(file))


def write_snapshot(df: DataFrame, folder: str, partition_by: list[str] | None = None) -> str:
    """Writes a new version and points to it; readers see the old or the new version, never a mixture. Works on any Hadoop file system."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    writer = df.write.mode("error")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{folder}/v-{version}")
    put_text(spark, f"{folder}/{POINTER}", json.dumps({"version": version}))
    return version


def current_version(spark: SparkSession, folder: str) -> str | None:
    """The version that the pointer names; None if nothing was ever written. Versions without a pointer are an error, no empty table."""
    found = get_text(spark, f"{folder}/{POINTER}")
    if found is not None:
        return json.loads(found)["version"]
    fs, path = _fs(spark, folder)
    if fs.exists(path(folder)) and any(s.isDirectory() and s.getPath().getName().startswith("v-") for s in fs.listStatus(path(folder))):
        raise FileNotFoundError(f"{folder} has versions but no pointer to one")
    return None


def read_snapshot(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """The current version; an empty table of ``schema`` if nothing was ever written. Columns the version lacks come as null."""
    version = current_version(spark, folder)
    if version is None:
        if schema is None:
            raise FileNotFoundError(folder)
        return spark.createDataFrame([], schema)
    df = spark.read.parquet(f"{folder}/v-{version}")
    if schema is None:
        return df
    return spark.createDataFrame([], schema).unionByName(df, allowMissingColumns=True)


def drop_old_versions(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Deletes all but the newest versions; the current one always stays."""
    fs, path = _fs(spark, folder)
    current = current_version(spark, folder)
    found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(path(folder)) if s.isDirectory()), reverse=True)
    old = [name for k, (_, name) in enumerate(found) if name.startswith("v-") and k >= keep and name != f"v-{current}"]
    for name in old:
        fs.delete(path(f"{folder}/{name}"), True)
    return len(old)
