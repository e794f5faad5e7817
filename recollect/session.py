"""Session construction and the shared work folder that long jobs cut their lineage with."""

from __future__ import annotations

import atexit
import json
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def build_session(app: str = "recollect", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` uses ``_`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, which every executor can reach; it is deleted when the application ends.

    Only in local mode a missing setting gives a temporary folder; on a cluster it is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            local = tempfile.mkdtemp(prefix="recollect-")
            atexit.register(shutil.rmtree, local, ignore_errors=True)
            base = f"file://{local}"
        _ROOTS[app] = f"{base.rstrip('/')}/recollect-{app}"
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_ROOTS[app])
        fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(root)
        fs.deleteOnExit(root)
    return _ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lineage cut that survives executors.

    ``partitions`` is the number of shuffle partitions of this step, for steps that know the size of what they shuffle.
    """
    path = scratch_path(df.sparkSession, name)
    with freeing_shuffles(df.sparkSession), setting(df.sparkSession, "spark.sql.shuffle.partitions", partitions and str(partitions)):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str | None) -> Iterator[None]:
    """Inside, the session setting ``key`` is ``value``; None leaves it as it is."""
    before = spark.conf.get(key, None)
    if value is not None:
        spark.conf.set(key, value)
    try:
        yield
    finally:
        if value is not None and before is None:
            spark.conf.unset(key)
        elif value is not None:
            spark.conf.set(key, before)


def freeing_shuffles(spark: SparkSession) -> AbstractContextManager[None]:
    """Inside, Spark deletes an execution's shuffle files when it ends. For writes that cut the lineage: nothing reads them again."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file from the driver."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    stream.write(bytearray(text.encode()))
    stream.hsync()
    stream.close()


def place(spark: SparkSession, text: str, to: str) -> bool:
    """Make the file ``to`` with this content, whole or not at all; False, and nothing changed, where it exists already.

    The content is written beside it first. A rename onto an existing file is refused by shared file systems; local ones would
    overwrite it, so there a hard link is made, which is refused.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    folder, name = to.rsplit("/", 1)
    temp, final = path(f"{folder}/_{name}-{uuid.uuid4().hex[:12]}"), path(to)
    fs = final.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    write_text(spark, temp.toString(), text)
    try:
        if fs.getScheme() == "file":
            os.link(temp.toUri().getPath(), final.toUri().getPath())
            return True
        return bool(not fs.exists(final) and fs.rename(temp, final))
    except FileExistsError:
        return False
    finally:
        fs.delete(temp, False)


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what is directly below ``folder``."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def publish_manifest(spark: SparkSession, root: str, number: int, value: dict[str, Any]) -> None:
    """Write ``value`` as manifest ``number`` below ``root``, whole or not at all, then drop the one before.

    Of several writers one succeeds; the others, and one that did not see the newest manifest, are refused.
    """
    if _newest_manifest(spark, root) != number - 1 or not place(spark, json.dumps(value), f"{root}/manifest-{number:06d}.json"):
        raise ValueError("CONFLICT: another version was published below this root")
    delete_path(spark, f"{root}/manifest-{number - 1:06d}.json")


def _newest_manifest(spark: SparkSession, root: str) -> int:
    return max((int(n[9:-5]) for n in file_names(spark, root) if n.startswith("manifest-") and n.endswith(".json")), default=0)


def last_manifest(spark: SparkSession, root: str) -> tuple[int, dict[str, Any]] | None:
    """Number and value of the newest manifest below ``root``, if there is one."""
    number = _newest_manifest(spark, root)
    return (number, json.loads(spark.read.text(f"{root}/manifest-{number:06d}.json", wholetext=True).first()[0])) if number else None


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of all executors, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="recollect-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/recollect_package.zip", "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(f"{folder}/recollect_package.zip")
