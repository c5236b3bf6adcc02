"""The three relations as versions of Parquet tables. A version is visible once its marker file exists, so readers never
see half of one, and a lost job leaves the last version in force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.sources.bindings import Graph

FORMAT = 1
FILES = "id long, path string, hash string, mtime long, language string, size long, skeleton string, has_errors boolean"
SYMBOLS = "id long, file_id long, name string, kind string, signature string, parent string, visibility string, exported boolean, start_line int, end_line int, start_byte long, end_byte long"
DEPENDENCIES = "id long, source_file_id long, target_file_id long, imported_symbol string, dependency_type string, source_raw string, resolution string"
TABLES = {"files": FILES, "symbols": SYMBOLS, "dependencies": DEPENDENCIES}


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        root = self._path(self.folder)
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self._fs.exists(self._path(f"{self.folder}/{n}/_READY")))

    def at(self, version: int) -> str:
        return f"{self.folder}/v{version:06d}"

    def table(self, name: str) -> DataFrame:
        """The current version's table, or an empty one."""
        have = self.versions()
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.at(have[-1])}/{name}") if have else self.spark.createDataFrame([], TABLES[name])

    def graph(self) -> Graph:
        return Graph(*(self.table(t) for t in TABLES))

    def begin(self) -> int:
        version = (self.versions() or [0])[-1] + 1
        self._fs.delete(self._path(self.at(version)), True)  # what a lost run left
        return version

    def commit(self, version: int, keep: int = 2) -> None:
        """Marks a version as the current one; an error if another writer was faster. The marker holds the format."""
        out = self._fs.create(self._path(f"{self.at(version)}/_READY"), False)
        out.write(bytearray(str(FORMAT).encode()))
        out.close()
        for old in self.versions()[:-keep]:
            self._fs.delete(self._path(self.at(old)), True)

    def format(self) -> int:
        """The format of the current version; 0 if there is none."""
        have = self.versions()
        if not have:
            return 0
        stream = self._fs.open(self._path(f"{self.at(have[-1])}/_READY"))
        try:
            digit = stream.read()
            return digit - 48 if digit >= 0 else 0
        finally:
            stream.close()

    def built(self) -> float:
        """When the current version was committed, in seconds; 0 if there is none."""
        have = self.versions()
        return self._fs.getFileStatus(self._path(f"{self.at(have[-1])}/_READY")).getModificationTime() / 1000 if have else 0.0

    def wipe(self) -> None:
        self._fs.delete(self._path(self.folder), True)

    def size(self) -> int:
        have = self.versions()
        return self._fs.getContentSummary(self._path(self.at(have[-1]))).getLength() if have else 0


def ddl() -> str:
    return "\n".join(f"CREATE TABLE {name} ({columns});" for name, columns in TABLES.items())
