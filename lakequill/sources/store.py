"""Copy-on-write table store: Parquet directories and one manifest that names the current one of each table.

A change writes whole new directories, then replaces the manifest by one rename, so several tables change together or not
at all, and readers of the old directories are undisturbed. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        where, fs = self._fs(path)
        return fs.exists(where)

    def manifest(self) -> dict[str, str]:
        path = f"{self.root}/_manifest.json"
        if not self.exists(path):
            return {}
        where, fs = self._fs(path)
        stream = fs.open(where)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def current(self, table: str) -> str | None:
        """Where a table's rows are now: a committed directory, or a plain ``<table>.parquet`` of an input folder."""
        if version := self.manifest().get(table):
            return f"{self.root}/{version}"
        plain = f"{self.root}/{table}.parquet"
        return plain if self.exists(plain) else None

    def stage(self, table: str, rows: DataFrame) -> str:
        version = f"{table}/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{version}")
        return version

    def commit(self, staged: dict[str, str | None]) -> None:
        """Make staged versions current; None drops a table."""
        tables = self.manifest()
        for table, version in staged.items():
            if version is None:
                tables.pop(table, None)
            else:
                tables[table] = version
        self.replace(tables)

    def replace(self, tables: dict[str, str]) -> None:
        path = f"{self.root}/_manifest.json.{uuid.uuid4().hex}"
        where, fs = self._fs(path)
        out = fs.create(where, True)
        out.write(bytearray(json.dumps(tables, indent=1, sort_keys=True).encode()))
        out.close()
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/_manifest.json")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.spark._jsc.hadoopConfiguration())
        option = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()[1]
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = option
        context.rename(where, target, options)

    def vacuum(self) -> int:
        """Delete directories that the manifest does not name; returns how many."""
        named = set(self.manifest().values())
        gone = 0
        for table in {v.split("/")[0] for v in named}:
            where, fs = self._fs(f"{self.root}/{table}")
            for status in fs.listStatus(where):
                if f"{table}/{status.getPath().getName()}" not in named:
                    gone += bool(fs.delete(status.getPath(), True))
        return gone
