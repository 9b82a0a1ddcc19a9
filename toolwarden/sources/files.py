"""Small files and folder names in whatever store the session reads: local, HDFS, object store, mount table."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    """Hadoop's file context and path object, which know every store that Spark knows."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, where.getFileSystem(conf), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there.  Names that begin with a dot are work in progress."""
    _, fs, where = _store(spark, folder)
    if not fs.exists(where):
        return []
    found = [status.getPath().getName() for status in fs.listStatus(where)]
    return sorted(n for n in found if not n.startswith("."))


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, or None if it isn't there."""
    jvm, fs, where = _store(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file appear with all its text at once; False if one of that name is already there.

    The text is written under another name and renamed, and the rename refuses an existing
    target, so readers see the file whole or not at all and of two writers one wins.
    """
    jvm, fs, where = _store(spark, path)
    fs.mkdirs(where.getParent())
    aside = jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(where).toUri(), fs.getConf())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(context.makeQualified(aside), context.makeQualified(where), none)
        return True
    except Exception:
        fs.delete(aside, False)
        if fs.exists(where):
            return False
        raise


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder, if it is there."""
    _, fs, where = _store(spark, path)
    fs.delete(where, True)
