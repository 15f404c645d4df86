"""Derived tables that grow by loads and are published as a whole.

A load writes its files under a fresh name and is then published by one small manifest, which names
all files of the new generation. Readers take the latest manifest, so they see a load entirely or
not at all; a load that died has no manifest, and its files are never read.

``{root}/data/{table}/load={name}/``    files of one load of one table, never changed
``{root}/generations/{number}.json``    manifests, numbered from 1 without gaps
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

LOAD = "load"


class Conflict(RuntimeError):
    """Another load was published meanwhile; take the latest generation and load again."""


@dataclass(frozen=True)
class Generation:
    """What is in: ``loads`` of every table, in order, and settings, such as the last day."""

    number: int = 0
    loads: dict[str, list[str]] = field(default_factory=dict)
    settings: dict[str, str] = field(default_factory=dict)


class Generations:
    """The generations below ``root``, a folder that driver and executors share.

    Manifests are put in place by a rename that fails if the name is taken, which the file system
    must do in one step (HDFS and local disks do).
    """

    def __init__(self, spark: SparkSession, root: str, schemas: Mapping[str, T.StructType]) -> None:
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), dict(schemas)

    def latest(self) -> Generation:
        """The last published generation; number 0, without loads, if there is none."""
        numbers = self._numbers()
        return self.get(max(numbers)) if numbers else Generation()

    def get(self, number: int) -> Generation:
        source = self._files().open(self._path(self._manifest(number)))
        try:
            text = bytes(source.readAllBytes()).decode()
        finally:
            source.close()
        return Generation(**json.loads(text))

    def new_load(self) -> str:
        return uuid4().hex

    def write(self, table: str, load: str, rows: DataFrame, *partition_by: str) -> None:
        columns = self.schemas[table].fieldNames()
        rows.select(*columns).write.partitionBy(*partition_by).parquet(self._folder(table, load))

    def read(self, table: str, generation: Generation) -> DataFrame:
        """All rows of ``table`` in ``generation``, its loads side by side."""
        schema = self.schemas[table]
        loads = generation.loads.get(table, [])
        if not loads:
            return self.spark.createDataFrame([], schema)
        with_load = T.StructType([*schema, T.StructField(LOAD, T.StringType())])
        reader = self.spark.read.schema(with_load).option("basePath", f"{self.root}/data/{table}")
        return reader.parquet(*[self._folder(table, load) for load in loads]).drop(LOAD)

    def publish(
        self, base: Generation, loads: dict[str, list[str]], settings: dict[str, str]
    ) -> Generation:
        """Make the generation after ``base``; Conflict if there is one already."""
        made = Generation(base.number + 1, loads, settings)
        files = self._files()
        draft = self._path(f"{self.root}/drafts/{uuid4().hex}.json")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(asdict(made)).encode()))
        out.close()
        files.mkdirs(self._path(f"{self.root}/generations"))
        try:
            self._move(draft, self._path(self._manifest(made.number)))
        except Py4JJavaError as error:
            files.delete(draft, False)
            if made.number in self._numbers():
                raise Conflict(f"generation {made.number} is published already") from error
            raise
        return made

    def prune(self, keep: int = 2) -> list[str]:
        """Drop all but the last ``keep`` generations and the files that only they name.

        Files of loads that were never published stay: one of them may be running.
        """
        numbers = sorted(self._numbers())
        old, kept = numbers[:-keep], numbers[-keep:]
        named = lambda ns: {
            self._folder(table, load)
            for n in ns
            for table, loads in self.get(n).loads.items()
            for load in loads
        }
        unused = sorted(named(old) - named(kept))
        files = self._files()
        for number in old:
            files.delete(self._path(self._manifest(number)), False)
        for folder in unused:
            files.delete(self._path(folder), True)
        return unused

    def _numbers(self) -> list[int]:
        files, folder = self._files(), self._path(f"{self.root}/generations")
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return [int(name.removesuffix(".json")) for name in names if name.endswith(".json")]

    def _manifest(self, number: int) -> str:
        return f"{self.root}/generations/{number:08d}.json"

    def _folder(self, table: str, load: str) -> str:
        return f"{self.root}/data/{table}/{LOAD}={load}"

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _files(self):
        return self._path(self.root).getFileSystem(self._hadoop())

    def _hadoop(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _move(self, source, target) -> None:
        """Rename that fails if ``target`` exists."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        never = fs.Options.Rename.NONE
        options = self.spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
        options[0] = never
        context = fs.FileContext.getFileContext(self._files().getUri(), self._hadoop())
        context.rename(source, target, options)
