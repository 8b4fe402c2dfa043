"""Single small files and listings in the store a path belongs to, through Spark's own file systems.

Rows are read and written by Spark alone; this is for the commit files of published tables.
"""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_HIDDEN = (".", "_")


def _at(spark: SparkSession, path: str):
    """The file system a path belongs to, and the path as that knows it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _is(error: Py4JJavaError, name: str) -> bool:
    return error.java_exception.getClass().getSimpleName() == name


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files and folders in a folder; none if there is no such folder."""
    store, target = _at(spark, folder)
    if not store.exists(target):
        return []
    found = (status.getPath().getName() for status in store.listStatus(target))
    return sorted(name for name in found if not name.startswith(_HIDDEN))


def files_below(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """Files below a folder: folder relative to it, bytes, time of change in milliseconds."""
    store, target = _at(spark, folder)
    if not store.exists(target):
        return []
    begin = len(store.getFileStatus(target).getPath().toUri().getPath()) + 1
    found, each = [], store.listFiles(target, True)
    while each.hasNext():
        status = each.next()
        parent, _, name = status.getPath().toUri().getPath()[begin:].rpartition("/")
        if not name.startswith(_HIDDEN):
            found.append((parent, status.getLen(), status.getModificationTime()))
    return found


def read_text(spark: SparkSession, path: str) -> str:
    store, target = _at(spark, path)
    stream = store.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with all it holds, if there is one."""
    store, target = _at(spark, path)
    store.delete(target, True)


def create_once(spark: SparkSession, path: str, text: str = "") -> bool:
    """Write a file unless there is one of that name; whether this call made it.

    The text is written under another name first, so nobody reads half of it, and takes its name by a
    step that the store refuses if the name is taken: a link on a local disk, a rename
    without overwriting elsewhere. Of several callers exactly one succeeds, as far as the store
    promises that; object stores without such a rename do not.
    """
    store, target = _at(spark, path)
    store.mkdirs(target.getParent())
    if store.exists(target):
        return False
    draft = f".{uuid.uuid4().hex}.draft"
    if store.getScheme() == "file":
        local = target.toUri().getPath()
        draft = os.path.join(os.path.dirname(local), draft)
        with open(draft, "x", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(draft, local)
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
        return True
    fs = spark._jvm.org.apache.hadoop.fs
    source = fs.Path(target.getParent(), draft)
    stream = store.create(source, False)
    try:
        stream.write(bytearray(text, "utf-8"))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
    options[0] = getattr(fs, "Options$Rename").NONE
    try:
        fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(source, target, options)
    except Py4JJavaError as error:
        store.delete(source, False)
        if _is(error, "FileAlreadyExistsException"):
            return False
        raise
    return True
