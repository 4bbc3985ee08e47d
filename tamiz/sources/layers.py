"""Layers of declared tables in versioned folders: bronze, silver and gold below one root.

A table ``layer.name`` is a folder of versions, ``v000001``, ``v000002``, ... Rows are written aside and published by one
rename of the finished folder, which either happens or does not. Readers take the highest version when they are planned, so
a reader sees the old rows or the new ones, never part of them, and there is no moment without a table. A write that fails
changes nothing, and of two writers that publish the same version the second one fails. Old versions stay until ``release``.

The root must be on a file system whose rename is atomic (HDFS, or a local disk in tests).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tamiz.operators.quality import row_counts

LAYERS = ("bronze", "silver", "gold")
_VERSION = re.compile(r"v(\d{6,})$")


class Layers:
    """Registry of tables: ``layer.name`` to declared columns. All reads and writes of a plan go through it."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, str]):
        self.spark, self.root, self.schemas = spark, root.rstrip("/"), {}
        for name, columns in tables.items():
            layer, _, short = name.partition(".")
            if layer not in LAYERS or not re.fullmatch(r"\w+", short):
                raise ValueError(f"{name!r} is not <layer>.<table> with a layer of {', '.join(LAYERS)}")
            self.schemas[name] = StructType.fromDDL(columns)

    def _folder(self, name: str):
        if name not in self.schemas:
            raise ValueError(f"undeclared table {name}")
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name.replace('.', '/')}")

    def _files(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, name: str) -> list[int]:
        """Published versions, oldest first."""
        folder = self._folder(name)
        files = self._files(folder)
        if not files.exists(folder):
            return []
        found = (_VERSION.match(s.getPath().getName()) for s in files.listStatus(folder))
        return sorted(int(m.group(1)) for m in found if m)

    def _place(self, name: str, version: int) -> str:
        return f"{self._folder(name)}/v{version:06d}"

    def check(self, name: str, df: DataFrame) -> DataFrame:
        """``df`` with the declared columns in order; a missing, further or differently typed column is refused."""
        want = {f.name: f.dataType.simpleString() for f in self.schemas[name]}
        got = {f.name: f.dataType.simpleString() for f in df.schema}
        faults = [f"{c} missing" for c in want if c not in got] + [f"{c} not declared" for c in got if c not in want]
        faults += [f"{c} is {got[c]}, declared {want[c]}" for c in want if c in got and got[c] != want[c]]
        if faults:
            raise ValueError(f"{name}: {'; '.join(faults)}")
        return df.select(*want)

    def write(self, name: str, df: DataFrame) -> int:
        """Publish ``df`` as the next version of a table, which may be derived from the present one; gives its number."""
        folder, rows = self._folder(name), self.check(name, df)
        number = (self.versions(name) or [0])[-1] + 1
        aside = f"{folder}/.write-{uuid.uuid4().hex[:12]}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        try:
            rows.write.parquet(aside)
            context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
                folder.toUri(), self.spark._jsc.hadoopConfiguration()
            )
            plain = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(path(aside), path(self._place(name, number)), plain)  # refuses a version that exists
        except Exception:
            self._files(folder).delete(path(aside), True)
            raise
        return number

    def create(self, name: str) -> None:
        """An empty first version, unless the table exists."""
        if not self.versions(name):
            self.write(name, self.spark.createDataFrame([], self.schemas[name]))

    def write_if_absent(self, name: str, df: DataFrame) -> bool:
        """Publish only where there is no version yet; says whether it did."""
        if self.versions(name):
            return False
        self.write(name, df)
        return True

    def append(self, name: str, df: DataFrame) -> int:
        """The present rows and ``df`` as the next version. For loads of many files read them at once and write once."""
        return self.write(name, self.read(name).unionByName(self.check(name, df)))

    def swap(self, name: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """Replace a table by rows derived from it."""
        return self.write(name, change(self.read(name)))

    def delete(self, name: str, condition: Column) -> int:
        """Replace a table by its rows for which ``condition`` is false or missing."""
        return self.swap(name, lambda df: df.where(~F.coalesce(condition, F.lit(False))))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table by name: the present version or a given one."""
        found = self.versions(name)
        if not found or (version is not None and version not in found):
            raise ValueError(f"required tables not found: {name}" + (f" version {version}" if version else ""))
        return self.spark.read.schema(self.schemas[name]).parquet(self._place(name, version or found[-1]))

    def require(self, names: Sequence[str]) -> None:
        """Stop before any job unless all these tables are there with the declared columns."""
        missing = [n for n in names if not self.versions(n)]
        if missing:
            raise ValueError(f"required tables not found: {', '.join(missing)}")
        for name in names:
            self.check(name, self.spark.read.parquet(self._place(name, self.versions(name)[-1])))

    def release(self, name: str, keep: int = 1) -> list[int]:
        """Remove all but the newest ``keep`` versions, which no reader may use any more; gives their numbers."""
        if keep < 1:
            raise ValueError("the present version cannot be released")
        old = self.versions(name)[:-keep]
        for version in old:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._place(name, version))
            self._files(path).delete(path, True)
        return old

    def row_counts(self, layer: str) -> DataFrame:
        """``table_name, row_count`` of every published table of a layer."""
        names = sorted(n for n in self.schemas if n.startswith(f"{layer}.") and self.versions(n))
        if not names:
            return self.spark.createDataFrame([], "table_name string, row_count bigint")
        return row_counts({n: self.read(n) for n in names})
