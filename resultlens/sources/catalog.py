"""Which parquet tables a (dataset, database) has."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass
class Catalog:
    """Databases below a root, in one of three layouts: nested (``db/table.parquet`` below the dataset's root), flat (tables of all databases side by side, named
    ``db.table.parquet``), or several roots that are tried in order. `names` maps dataset names to folder names."""

    root: str
    layouts: dict[str, str] = field(default_factory=dict)
    roots: dict[str, list[str]] = field(default_factory=dict)
    names: dict[str, str] = field(default_factory=dict)

    def folders(self, dataset: str, db: str) -> list[str]:
        """Candidate folders of a database. Names that leave the root are refused."""
        dataset = self.names.get(dataset, dataset)
        for part in (dataset, db):
            if not re.fullmatch(r"[\w.-]+", part) or part in (".", "..") or part.startswith("."):
                raise ValueError(f"not a name: {part!r}")
        tops = self.roots.get(dataset, [dataset])
        return [f"{self.root.rstrip('/')}/{top}" + ("" if self.layouts.get(dataset) == "flat" else f"/{db}") for top in tops]

    def tables(self, spark: SparkSession, dataset: str, db: str) -> dict[str, str]:
        """Table name to path; of several roots the first that has the database. Goes through Spark's file system, so any store will do."""
        flat = self.layouts.get(self.names.get(dataset, dataset)) == "flat"
        jvm = spark.sparkContext._jvm
        for folder in self.folders(dataset, db):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if not fs.exists(path):
                continue
            found = {}
            for f in fs.listStatus(path):
                name = f.getPath().getName()
                if name.endswith(".parquet") and (not flat or name.startswith(f"{db}.")):
                    found[name.removesuffix(".parquet").removeprefix(f"{db}." if flat else "")] = f.getPath().toString()
            if found:
                return found
        raise FileNotFoundError(f"no database {db!r} in {dataset!r}")
