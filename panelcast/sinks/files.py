"""Names, small files and exclusive creation in whatever store the session's paths name."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from fnmatch import fnmatch

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _store(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none when it does not exist."""
    where, fs = _store(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def below(spark: SparkSession, path: str, pattern: str = "*") -> list[str]:
    """Files at or below a path (which may hold wildcards) whose name fits ``pattern``; hidden ones are left out."""
    where, fs = _store(spark, path)
    out = []
    for top in fs.globStatus(where) or []:
        if top.isFile():
            out.append(top.getPath().toString())
            continue
        inside = fs.listFiles(top.getPath(), True)
        root = top.getPath().toString()
        while inside.hasNext():
            name = inside.next().getPath().toString()
            parts = name[len(root):].split("/")
            if fnmatch(parts[-1], pattern) and not any(p.startswith(("_", ".")) for p in parts):
                out.append(name)
    return sorted(out)


def remove(spark: SparkSession, path: str) -> None:
    where, fs = _store(spark, path)
    fs.delete(where, True)


def create_once(spark: SparkSession, path: str, text: str = "") -> bool:
    """Create a file unless it exists; of several writers one gets True.

    The store must create files exclusively, as HDFS does. For a mounted folder the operating system's exclusive creation is
    used, since Hadoop's local file system looks first and creates then.
    """
    where, fs = _store(spark, path)
    if fs.getScheme() == "file":
        local = fs.makeQualified(where).toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        try:
            handle = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "wb") as f:
            f.write(text.encode())
        return True
    try:
        stream = fs.create(where, False)
    except Exception:
        if fs.exists(where):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def first_bytes(spark: SparkSession, paths: list[str], size: int = 1 << 16, at_once: int = 16) -> list[bytes | Exception]:
    """The first ``size`` bytes of each file (of its content, where it is compressed), or why they cannot be read.

    Only so much is read, however long a file is; many files are opened at once.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def head(path: str) -> bytes | Exception:
        try:
            where, fs = _store(spark, path)
            stream = fs.open(where)
            try:
                codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
                source = codec.createInputStream(stream) if codec is not None else stream
                return bytes(source.readNBytes(size))
            finally:
                stream.close()
        except Exception as err:
            return err

    with ThreadPoolExecutor(at_once) as pool:
        return list(pool.map(head, paths))
