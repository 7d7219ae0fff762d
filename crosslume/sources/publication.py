"""Several results that appear together, and part files joined to one.

Both go through the file system that the path names, so they work wherever Spark's readers do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_JOURNAL = "_publishing.json"


class _Files:
    """The file system of a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at(path).getFileSystem(self.conf)

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self.fs.exists(self.at(path))

    def delete(self, path: str) -> None:
        self.fs.delete(self.at(path), True)

    def move(self, source: str, target: str) -> None:
        self.fs.mkdirs(self.at(target).getParent())
        if not self.fs.rename(self.at(source), self.at(target)):
            raise OSError(f"could not move {source} to {target}")

    def names(self, folder: str, prefix: str) -> list[str]:
        found = [status.getPath().getName() for status in self.fs.listStatus(self.at(folder))]
        return sorted(name for name in found if name.startswith(prefix))

    def write(self, path: str, text: str) -> None:
        """All of a small file, or nothing."""
        out = self.fs.create(self.at(f"{path}.new"), True)
        try:
            out.write(text.encode())
        finally:
            out.close()
        self.move(f"{path}.new", path)

    def read(self, path: str) -> str:
        inside = self.fs.open(self.at(path))
        try:
            return bytes(inside.readAllBytes()).decode()
        finally:
            inside.close()


def publish(spark: SparkSession, folder: str, writers: dict[str, Callable[[str], None]]) -> None:
    """Run every writer on a new path, then put what they wrote under their names in ``folder``, all or none.

    If a writer fails, ``folder`` keeps what it had. Once all have written, a journal says what has to be moved;
    whatever interrupts the moves, ``settle`` ends them. Other files of the folder are left alone.
    """
    files, tag = _Files(spark, folder), uuid.uuid4().hex
    settle(spark, folder)
    try:
        for name, write in writers.items():
            write(f"{folder}/_new-{tag}/{name}")
        files.write(f"{folder}/{_JOURNAL}", json.dumps({"tag": tag, "names": list(writers)}))
    except BaseException:
        files.delete(f"{folder}/_new-{tag}")
        raise
    settle(spark, folder)


def settle(spark: SparkSession, folder: str) -> None:
    """End a publication that was interrupted after all had been written. To be called before results are read."""
    files = _Files(spark, folder)
    if not files.exists(f"{folder}/{_JOURNAL}"):
        return
    journal = json.loads(files.read(f"{folder}/{_JOURNAL}"))
    new, old = (f"{folder}/_{kind}-{journal['tag']}" for kind in ("new", "old"))
    for name in journal["names"]:
        if not files.exists(f"{new}/{name}"):
            continue  # moved before
        if files.exists(f"{folder}/{name}"):
            files.move(f"{folder}/{name}", f"{old}/{name}")
        files.move(f"{new}/{name}", f"{folder}/{name}")
    files.delete(f"{folder}/{_JOURNAL}")
    files.delete(new)
    files.delete(old)


def join_parts(spark: SparkSession, parts: str, path: str, head: str, foot: str, skip: int = 0) -> None:
    """One file at ``path``: ``head``, the part files in order (the first ``skip`` bytes of all left out), ``foot``.

    Bytes are streamed from file to file, a buffer at a time; the file appears when it is whole.
    """
    files = _Files(spark, path)
    source = _Files(spark, parts)
    temporary = f"{path}.new-{uuid.uuid4().hex}"
    out = files.fs.create(files.at(temporary), True)
    try:
        out.write(head.encode())
        for name in source.names(parts, "part-"):
            inside = source.fs.open(source.at(f"{parts}/{name}"))
            try:
                if skip:
                    skip -= int(inside.skip(skip))
                files.jvm.org.apache.hadoop.io.IOUtils.copyBytes(inside, out, files.conf, False)
            finally:
                inside.close()
        out.write(foot.encode())
        out.close()
        if files.exists(path):
            files.delete(path)
        files.move(temporary, path)
    except BaseException:
        out.close()
        files.delete(temporary)
        raise
