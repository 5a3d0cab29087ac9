"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's own checkpoint folder.

    Where neither is set, a new folder is made and set on a single machine (master ``local``);
    on a cluster, whose machines don't share one, that raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def write(df: DataFrame, path: str) -> None:
    """All tables here are written by this."""
    df.write.parquet(path)


#: Scratch folders of this process.
_MADE: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Scratch tables made within are removed at the end; write what is to be kept before it.

    ``with scratch(spark): query(spark).write.parquet(place)``.
    """
    first = len(_MADE)
    try:
        yield
    finally:
        for place in _MADE[first:]:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        del _MADE[first:]


class Parts:
    """A relation kept as Parquet parts in the shared folder; each round of a loop adds one.

    Reading all parts is one scan however many rounds there were, so plans stay small, and
    no part depends on an executor. ``base`` names a folder of its own.
    """

    def __init__(self, spark: SparkSession, name: str, base: str | None = None) -> None:
        self.spark, self.paths, self.schema = spark, [], None
        self.base = base or f"{shared_folder(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
        if base is None:
            _MADE.append(self.base)

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/part-{uuid.uuid4().hex}"
        write(df, path)
        self.schema = self.schema or df.schema
        self.paths.append(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def forget_last(self) -> None:
        """Leave an empty part out of later scans, unless it is the only one."""
        if len(self.paths) > 1:
            self.paths.pop()

    def compact(self) -> None:
        """Write many parts anew as one; those who still read the old ones can."""
        whole = self.all()
        self.paths = []
        self.add(whole)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)


class Ledger:
    """Versions of a set of tables in a shared folder; a version lists the files that hold each.

    Files lie in folders of their own under ``parts``, and none is ever changed. A version is
    one small file that is written aside and renamed, after all it lists is there: what a
    failure leaves behind is listed nowhere, and goes with the next ``tidy``. One writer at a
    time is expected.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def _path(self, place: str) -> tuple:
        """A path of the cluster's file system, and that system."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(place)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, place: str) -> list[str]:
        path, files = self._path(place)
        return sorted(str(x.getPath().getName()) for x in files.listStatus(path)) if files.exists(path) else []

    def versions(self) -> list[int]:
        return [int(x[1:]) for x in self._listed(f"{self.folder}/versions") if re.fullmatch(r"v\d+", x)]

    def read(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/versions/v{version:012}", wholetext=True).first()[0])

    def commit(self, version: int, content: dict) -> None:
        aside, files = self._path(f"{self.folder}/versions/.new-{uuid.uuid4().hex}")
        out = files.create(aside, True)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        there, _ = self._path(f"{self.folder}/versions/v{version:012}")
        if files.exists(there) or not files.rename(aside, there):
            raise RuntimeError(f"version {version} of {self.folder} is there already")

    def part(self, df: DataFrame) -> list[str]:
        """Write a table's rows into a folder of their own; its files."""
        place = f"{self.folder}/parts/{uuid.uuid4().hex}"
        write(df, place)
        return [f"{place}/{x}" for x in self._listed(place) if x.endswith(".parquet")]

    def tidy(self, keep: list[dict]) -> None:
        """Remove parts that no version in ``keep`` lists, and versions that aren't among the last as many."""
        listed = {file.rsplit("/", 2)[1] for content in keep for files in content["files"].values() for file in files}
        for name in self._listed(f"{self.folder}/parts"):
            if name not in listed:
                path, files = self._path(f"{self.folder}/parts/{name}")
                files.delete(path, True)
        for version in self.versions()[: -len(keep)]:
            path, files = self._path(f"{self.folder}/versions/v{version:012}")
            files.delete(path, False)


def drop(df: DataFrame) -> None:
    """Remove the scratch folders that a table written by ``Parts`` or ``settle`` lies in; it can't be read any more."""
    spark = df.sparkSession
    for place in sorted({file.rsplit("/", 2)[0] for file in df.inputFiles()}):
        if "/lodestar-" in place:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it again."""
    return Parts(df.sparkSession, name).add(df)
