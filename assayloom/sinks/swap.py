"""Replaces some files of a table by others, so that a run that breaks off can be finished.

New files are written below the table in a hidden folder, with the folders of their partitions. A marker then names the old
files; from it on the swap is decided: moving the new files in and deleting the old ones can be repeated until the marker is
gone. Before the marker nothing of the table has changed. Only names pass through the driver, as in any file listing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from assayloom.runtime import delete_path, list_names

_STAGED, _MARKER = "_staged-", "_swap-"


def _path(spark: SparkSession, name: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Data files below a folder, by their path from it on."""
    root = _path(spark, folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    base, found, listed = fs.makeQualified(root).toString(), [], fs.listFiles(root, True)
    while listed.hasNext():
        name = listed.next().getPath().toString()[len(base) + 1:]
        if not name.split("/")[-1].startswith(("_", ".")):
            found.append(name)
    return found


def staging(table: str) -> str:
    """A fresh hidden folder of the table for new files."""
    return f"{table.rstrip('/')}/{_STAGED}{uuid.uuid4().hex}"


def decide(spark: SparkSession, table: str, staged: str, old_uris: list[str]) -> None:
    """Writes the marker: from here on the staged files stand for the old ones (given as file URIs)."""
    uri = spark.sparkContext._jvm.java.net.URI
    names = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri(u)).toString() for u in old_uris]
    marker = f"{table}/{_MARKER}{uuid.uuid4().hex}"
    fs = _path(spark, table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    draft = _path(spark, f"{marker}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps({"staged": staged, "old": names}).encode()))
    out.close()
    fs.rename(draft, _path(spark, marker))


def finish(spark: SparkSession, table: str) -> int:
    """Carries out every decided swap and clears what undecided ones left; returns the number of swaps."""
    names = list_names(spark, table)
    fs = _path(spark, table).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    markers = [n for n in names if n.startswith(_MARKER) and not n.endswith(".draft")]
    for name in markers:
        at = _path(spark, f"{table}/{name}")
        source = fs.open(at)
        told = json.loads(bytes(source.readAllBytes()))
        source.close()
        for f in _files(spark, told["staged"]):
            target = _path(spark, f"{table}/{f}")
            fs.mkdirs(target.getParent())
            if not fs.rename(_path(spark, f"{told['staged']}/{f}"), target):
                raise OSError(f"could not move {f} into {table}")
        for f in told["old"]:
            fs.delete(_path(spark, f), False)
        delete_path(spark, told["staged"])
        fs.delete(at, False)
    for name in names:
        if name.startswith(_STAGED) or name.endswith(".draft"):
            delete_path(spark, f"{table}/{name}")
    return len(markers)
