"""Files of a table's folder that the driver makes: claims that keep two writers apart, and marks."""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, system.makeQualified(place)


def create_once(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if it is there already.  Of several callers one gets True.

    Rests on the store's create without overwriting (HDFS and stores with conditional writes); on a local disk, where Hadoop only
    looks before it writes, on an exclusive open.
    """
    system, place = _file_system(spark, path)
    system.mkdirs(place.getParent())
    if system.getScheme() == "file":
        try:
            os.close(os.open(unquote(urlparse(place.toString()).path), os.O_CREAT | os.O_EXCL))
        except FileExistsError:
            return False
        return True
    try:
        system.create(place, False).close()
    except Py4JJavaError as problem:
        if "AlreadyExists" not in problem.java_exception.getClass().getName():
            raise
        return False
    return True


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file, or a folder with what is in it; nothing if it is not there."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder; none if it is not there."""
    system, place = _file_system(spark, path)
    return [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []


@contextmanager
def claimed(spark: SparkSession, path: str, wait: float = 600.0) -> Iterator[None]:
    """Hold the claim on a table while it is read and written: a file beside it that one writer can create.

    Others try again until ``wait`` seconds have passed, and then raise.  A driver that dies leaves its claim, which is deleted by
    hand once it is known that nothing of it still writes.
    """
    claim, until = f"{path.rstrip('/')}.claim", time.monotonic() + wait
    while not create_once(spark, claim):
        if time.monotonic() >= until:
            raise TimeoutError(f"another writer holds {claim}")
        time.sleep(min(0.2, wait / 10 or 0.01))
    try:
        yield
    finally:
        delete(spark, claim)
