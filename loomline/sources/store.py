"""A store of tables in a folder: immutable Parquet, and numbered commits that name what each table consists of.

A commit is one small JSON file. Its number is taken exclusively before it is written, so of two writers that start from one commit the
second fails and nothing of it is seen; a reader has the tables of one commit, whatever is written meanwhile. Any file system that Spark
reaches will do; nothing is renamed over what exists.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from loomline.operators import catalog

#: The tables of a projected catalogue.
PROJECTIONS = ("members", "attributes", "products", "media", "depicted", "categories", "substances", "descriptions", "public_ids")


class Conflict(RuntimeError):
    """Another writer took the commit number; start again from its commit."""


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.number, self.tables = self._last()

    def _files(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _last(self) -> tuple[int, dict[str, list[str]]]:
        files, path = self._files()
        folder = path(f"{self.path}/commits")
        if not files.exists(folder):
            return 0, {}
        numbers = [int(f.getPath().getName()[:-5]) for f in files.listStatus(folder) if f.getPath().getName().endswith(".json")]
        if not numbers:
            return 0, {}
        stream = files.open(path(f"{self.path}/commits/{max(numbers):012d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return max(numbers), json.loads(text)

    def has(self, table: str) -> bool:
        return table in self.tables

    def read(self, table: str) -> DataFrame:
        """The table as of this store's commit. The files are Spark's own, with their schema."""
        return self.spark.read.parquet(*self.tables[table])

    def _write(self, df: DataFrame, table: str) -> str:
        folder = f"{self.path}/tables/{table}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        return folder

    def commit(self, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None) -> int:
        """Write whole tables and additions to tables, and make them the store's next commit, all or nothing."""
        tables = dict(self.tables)
        for name, df in (replaced or {}).items():
            tables[name] = [self._write(df, name)]
        for name, df in (appended or {}).items():
            tables[name] = [*tables.get(name, []), self._write(df, name)]
        files, path = self._files()
        files.mkdirs(path(f"{self.path}/commits"))
        number = self.number + 1
        at = f"{self.path}/commits/{number:012d}"
        if not files.createNewFile(path(f"{at}.taken")):
            raise Conflict(f"commit {number} is another writer's")
        stream = files.create(path(f"{at}.new"), True)
        try:
            stream.write(bytearray(json.dumps(tables).encode()))
        finally:
            stream.close()
        if not files.rename(path(f"{at}.new"), path(f"{at}.json")):
            raise Conflict(f"commit {number} could not be written")
        self.number, self.tables = number, tables
        return number

    def compact(self, tables: Iterable[str]) -> int:
        """Rewrite tables that many additions have split into folders as one each."""
        return self.commit({t: self.read(t) for t in tables})


def save_catalog(store: Store, found: catalog.Catalog) -> int:
    """Replace the store's projections with a catalogue's tables, in one commit."""
    return store.commit({name: getattr(found, name) for name in PROJECTIONS})


def load_catalog(store: Store) -> catalog.Catalog:
    return catalog.Catalog(**{name: store.read(name) for name in PROJECTIONS})
