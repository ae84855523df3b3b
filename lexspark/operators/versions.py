"""Versions of several tables that change together: one commit names the folders of all, and appears at once or not at all.

A commit writes each changed table into a folder of its own, checks it, and last of all renames one small file into the
list of commits. Readers go by the newest file of that list, so they see all tables of a commit or none; what a failed or
killed run has written is in no list and is removed by `vacuum`. The rename refuses a name that is taken: of two writers that start from the same
version one fails (Conflict) and changes nothing. It is atomic where the file system's is, as in HDFS; on object stores it is not.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ty

from lexspark.staging import at_once

from . import store

#: Child tables and the columns by which they belong to a row of another: (child, column, parent), each to the parent's id.
REFERENCES = (
    ("document_segments", "document_id", "documents"), ("document_summaries", "document_id", "documents"), ("document_key_information", "document_id", "documents"),
    ("document_embeddings", "document_id", "documents"), ("document_embeddings", "segment_id", "document_segments"),
)


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class Violation(ValueError):
    """A table breaks a constraint; nothing is committed."""


def schema(table: str, dim: int | None = None) -> ty.StructType:
    """The table's schema; the vectors' dimension is metadata of their column."""
    out = ty._parse_datatype_string(store.SCHEMAS[table])
    if dim is not None and table == "document_embeddings":
        out = ty.StructType([ty.StructField(f.name, f.dataType, f.nullable, {"dim": dim} if f.name == "embedding" else {}) for f in out])
    return out


def dimension(vectors: DataFrame) -> int | None:
    """The dimension of the stored vectors, from their column's metadata: no vector is read."""
    return vectors.schema["embedding"].metadata.get("dim")


def broken(names: list[str], tables: dict[str, DataFrame]) -> str | None:
    """What constraint the rows of some tables break: columns that may not be null, unique keys, references. None if all hold. All are looked for in one job."""
    found: DataFrame | None = None
    for name in names:
        df, must = tables[name], [f.name for f in schema(name) if not f.nullable]
        own = [df.where(F.array_contains(F.array(*[F.col(c).isNull() for c in must]), True)).select(F.lit(f"{name}: null in one of {must}").alias("why"))]
        for keys in (["id"], store.KEYS[name]):
            own.append(store.repeated_keys(df, keys).select(F.concat(F.lit(f"{name}: {keys} are not unique: "), F.to_json(F.struct(*keys))).alias("why")))
        for child, column, parent in REFERENCES:
            if child == name:
                lost = df.where(F.col(column).isNotNull()).join(tables[parent].select(F.col("id").alias("__id")), F.col(column) == F.col("__id"), "left_anti")
                own.append(lost.select(F.concat(F.lit(f"{name}: {column} names no row of {parent}: "), F.col(column).cast("string")).alias("why")))
        for each in own:
            found = each if found is None else found.unionByName(each)
    first = found.take(1) if found is not None else []
    return first[0]["why"] if first else None


class Versions:
    """The store's tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.list = f"{self.root}/_commits"

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._path(self.root).getFileSystem(self.conf)

    def versions(self) -> list[int]:
        """The versions that are committed, oldest first."""
        files = self._files()
        if not files.exists(self._path(self.list)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(self._path(self.list))]
        return sorted(int(n) for n in names if n.isdigit())

    def commit_of(self, version: int | None = None) -> dict:
        """The commit of a version, the newest without one: version, tables (name -> path), dim, and notes."""
        known = self.versions()
        if version is None:
            if not known:
                return {"version": 0, "tables": {}, "dim": None, "notes": {}}
            version = known[-1]
        stream = self._files().open(self._path(f"{self.list}/{version:020d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """All tables as one commit has them; those never written are empty."""
        commit = self.commit_of(version)
        out = {}
        for name in store.SCHEMAS:
            kind = schema(name, commit["dim"])
            nullable = ty.StructType([ty.StructField(f.name, f.dataType, True, f.metadata) for f in kind])
            path = commit["tables"].get(name)
            out[name] = self.spark.read.schema(nullable).parquet(path) if path else self.spark.createDataFrame([], nullable)
        return out

    def commit(self, changed: dict[str, DataFrame], base: int, dim: int | None = None, notes: dict | None = None, check: bool = True) -> int:
        """Write the changed tables as the version after `base`; the others stay as they are. The writes go side by side; checks come after them and before
        the commit. check: False where constraints can't break, as for empty tables that no other refers to."""
        before = self.commit_of(base) if base else {"version": 0, "tables": {}, "dim": None, "notes": {}}
        dim = before["dim"] if dim is None else dim
        paths = before["tables"] | {name: f"{self.root}/{name}/v={base + 1}-{uuid.uuid4().hex}" for name in changed}

        def write(name: str) -> None:
            kinds = schema(name, dim)
            changed[name].select(*[F.col(f.name).cast(f.dataType).alias(f.name, metadata=f.metadata) for f in kinds]).write.option("compression", "zstd").parquet(paths[name])

        at_once(self.spark, *[lambda name=name: write(name) for name in changed])
        if check:
            after = {name: self.spark.read.parquet(paths[name]) if name in paths else self.spark.createDataFrame([], schema(name)) for name in store.SCHEMAS}
            parents = {parent for _, _, parent in REFERENCES if parent in changed}
            why = broken([n for n in store.SCHEMAS if n in changed or any(c == n and p in parents for c, _, p in REFERENCES)], after)
            if why:
                raise Violation(why)
        self._publish({"version": base + 1, "tables": paths, "dim": dim, "notes": notes or {}})
        return base + 1

    def _publish(self, commit: dict) -> None:
        files, whole = self._files(), self._path(f"{self.list}/{commit['version']:020d}")
        files.mkdirs(self._path(self.list))
        draft = self._path(f"{self.list}/.draft-{uuid.uuid4().hex}")
        stream = files.create(draft)
        stream.write(json.dumps(commit).encode())
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri() if whole.toUri().getScheme() else files.getUri(), self.conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(draft, whole, none)
        except Py4JJavaError as error:
            files.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception):
                raise Conflict(f"version {commit['version']} is committed already") from error
            raise

    def create(self, dim: int) -> dict[str, DataFrame]:
        """All tables for vectors of this dimension: what is there stays, but vectors of another dimension are dropped."""
        commit = self.commit_of()
        if commit["version"] == 0:
            self.commit({name: store.empty(self.spark, name) for name in store.SCHEMAS}, 0, dim, check=False)
        elif commit["dim"] != dim:
            self.commit({"document_embeddings": store.empty(self.spark, "document_embeddings")}, commit["version"], dim, check=False)
        return self.tables()

    def vacuum(self, keep: int = 2) -> list[str]:
        """Remove the folders that none of the last `keep` commits names, and the older commits; gives the folders. For times without a writer."""
        files, known = self._files(), self.versions()
        used = {self._path(p).getName() for v in known[-keep:] for p in self.commit_of(v)["tables"].values()}
        gone = []
        for name in store.SCHEMAS:
            folder = self._path(f"{self.root}/{name}")
            for status in files.listStatus(folder) if files.exists(folder) else []:
                if status.getPath().getName() not in used:
                    gone.append(f"{name}/{status.getPath().getName()}")
                    files.delete(status.getPath(), True)
        for v in known[:-keep]:
            files.delete(self._path(f"{self.list}/{v:020d}"), False)
        return sorted(gone)
