"""Small files that are made whole or not at all, and by one writer only."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def create_new(spark: SparkSession, path: str, content: str) -> bool:
    """Make a file with this content, and tell whether it was made: not if another writer has made one of this name.

    The content is written beside, and appears under its name in one step that fails if the name is taken: a hard link on a
    local disk, elsewhere a rename, which has to be atomic there (as in HDFS).
    """
    fs, place = _place(spark, path)
    fs.mkdirs(place.getParent())
    beside = spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), f"_tmp-{uuid.uuid4().hex}")
    data = bytearray(content.encode())
    if fs.getScheme() == "file":
        to_local = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        system = spark._jvm.java.nio.file.Files
        system.write(to_local(beside), data, spark.sparkContext._gateway.new_array(spark._jvm.java.nio.file.OpenOption, 0))
        try:
            system.createLink(to_local(place), to_local(beside))
            return True
        except Exception as failure:
            if "FileAlreadyExistsException" not in type(getattr(failure, "java_exception", failure)).__name__ + str(failure):
                raise
            return False
        finally:
            system.delete(to_local(beside))
    out = fs.create(beside, False)
    out.write(data)
    out.close()
    made = not fs.exists(place) and fs.rename(beside, place)
    if not made:
        fs.delete(beside, False)
    return made


def exists(spark: SparkSession, path: str) -> bool:
    fs, place = _place(spark, path)
    return fs.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, sorted; none if there is no such folder."""
    fs, place = _place(spark, folder)
    found = [status.getPath().getName() for status in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(name for name in found if not name.startswith(("_", ".")))


def remove(spark: SparkSession, path: str) -> None:
    """Remove a file or folder that this process has written."""
    fs, place = _place(spark, path)
    fs.delete(place, True)
