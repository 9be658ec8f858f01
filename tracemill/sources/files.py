"""Small files on the session's file system: listed, read, and made only if absent."""

from __future__ import annotations

import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _at(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there. Hidden ones (a leading dot or underscore) are left out."""
    p, fs = _at(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(x for x in found if x[0] not in "._")


def changed(spark: SparkSession, path: str) -> float:
    """When a file was changed last, in seconds."""
    p, fs = _at(spark, path)
    return fs.getFileStatus(p).getModificationTime() / 1000


def read(spark: SparkSession, path: str) -> str:
    p, fs = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _at(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def _hidden(spark: SparkSession, path: str, text: str) -> str:
    """The text under a hidden name beside the path: what is renamed is whole."""
    folder, _, name = path.rpartition("/")
    out = f"{folder}/.{name}.{uuid.uuid4().hex}"
    write(spark, out, text)
    return out


def _renamed(spark: SparkSession, old: str, new: str, option: str) -> None:
    jvm, (p, fs), (to, _) = spark._jvm, _at(spark, old), _at(spark, new)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, option)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(p, to, options)


def create(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with all of its text, unless one of the name is there: True if this call made it. A rename that doesn't overwrite decides (a hard link on a local path), so of several writers one wins."""
    hidden = _hidden(spark, path, text)
    try:
        if _at(spark, path)[1].getUri().getScheme() == "file":
            os.link(re.sub(r"^file:/*", "/", hidden), re.sub(r"^file:/*", "/", path))
        else:
            _renamed(spark, hidden, path, "NONE")
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e.java_exception):
            return False
        raise
    finally:
        delete(spark, hidden)
    return True


def replace(spark: SparkSession, path: str, text: str) -> None:
    """The file with the new text; a reader finds the old or the new one."""
    _renamed(spark, _hidden(spark, path, text), path, "OVERWRITE")
