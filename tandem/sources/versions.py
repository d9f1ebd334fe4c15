"""Tables that change by one act: numbered manifests, each written under another name and then renamed.

A manifest says which folders are the table. What a writer leaves behind before its manifest is there is
no part of the table, so a crash between two writes changes nothing, and readers see one state or the next.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Changed(Exception):
    """Another writer published this number first; nothing of this one's is in the table."""


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Hadoop's classes and the file system that holds the path, as Spark itself uses them."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop, hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """What the manifest with the greatest number says; None if there is none yet."""
    hadoop, files = file_system(spark, path)
    folder = hadoop.Path(f"{path}/_manifests")
    if not files.exists(folder):
        return None
    names = sorted(x.getPath().getName() for x in files.listStatus(folder))
    names = [x for x in names if x.endswith(".json") and not x.startswith((".", "_"))]
    if not names:
        return None
    stream = files.open(hadoop.Path(folder, names[-1]))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, version: int, state: dict[str, Any]) -> None:
    """Make ``state`` the table's manifest of this number; ``Changed`` if the number is taken."""
    hadoop, files = file_system(spark, path)
    written = hadoop.Path(f"{path}/_manifests/.{uuid.uuid4().hex}")
    final = hadoop.Path(f"{path}/_manifests/{version:020d}.json")
    out = files.create(written, False)
    out.write(bytearray(json.dumps(state), "utf-8"))
    out.close()
    context = hadoop.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(written), files.makeQualified(final), none)
    except Exception as error:
        files.delete(written, False)
        if "FileAlreadyExists" in str(error):
            raise Changed(f"manifest {version} of {path}") from None
        raise
