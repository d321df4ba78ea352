"""Durable state: versioned snapshots, a write journal and its replay, cassettes, namespaces."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Collection, Mapping

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMAT = 1


class Folder:
    """Small files in any file system that Spark knows, by its Hadoop client.

    A file's states are numbered files of their own, each made visible by one rename to a new name, and the latest counts. So
    there is no moment without a whole state, whenever a writer stops.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, name: str) -> JavaObject:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self) -> JavaObject:
        return self._path("x").getFileSystem(self.conf)

    def names(self) -> list[str]:
        fs, root = self._fs(), self.jvm.org.apache.hadoop.fs.Path(self.root)
        return [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []

    def _states(self, name: str) -> list[int]:
        tails = [n[len(name) + 1 :] for n in self.names() if n.startswith(f"{name}.")]
        return sorted(int(t) for t in tails if t.isdigit())

    def read(self, name: str) -> str | None:
        held = self._states(name)
        if not held:
            return None
        stream = self._fs().open(self._path(f"{name}.{held[-1]}"))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """Write beside and rename to the name, which must be new."""
        fs, path, part = self._fs(), self._path(name), self._path(f".{uuid.uuid4().hex}.part")
        out = fs.create(part, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not fs.rename(part, path):
            raise OSError(f"{part} could not become {path}")

    def replace(self, name: str, text: str) -> None:
        """A new state; the one before stays until the next."""
        held = self._states(name)
        self.put(f"{name}.{held[-1] + 1 if held else 1}", text)
        for old in held[:-1]:
            self.drop(f"{name}.{old}")

    def drop(self, name: str) -> None:
        self._fs().delete(self._path(name), True)


class SnapshotStore:
    """Tables under version folders, and a manifest that names the current one with schemas and row counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, Folder(spark, root)

    def manifest(self) -> dict | None:
        text = self.folder.read("manifest.json")
        if text is None:
            return None
        m = json.loads(text)
        if not isinstance(m, dict) or m.get("format") != FORMAT:
            raise ValueError(f"not a snapshot of format {FORMAT}")
        tables = m.get("tables")
        whole = isinstance(m.get("version"), int) and isinstance(tables, dict) and isinstance(m.get("settings"), dict)
        if not whole or not all(isinstance(t, dict) and isinstance(t.get("rows"), int) and isinstance(t.get("schema"), dict) for t in tables.values()):
            raise ValueError("the snapshot's manifest is not whole")
        return m

    def save(self, tables: Mapping[str, DataFrame], settings: Mapping | None = None) -> int:
        """Write a new version and make it current; the one before stays until the next."""
        old = self.manifest()
        version = (old["version"] if old else 0) + 1
        held = {}
        for name, df in sorted(tables.items()):
            path = f"{self.folder.root}/v{version}/{name}"
            df.write.mode("overwrite").parquet(path)
            held[name] = {"rows": self.spark.read.parquet(path).count(), "schema": json.loads(df.schema.json())}
        self.folder.replace("manifest.json", json.dumps({"format": FORMAT, "version": version, "tables": held, "settings": settings or {}}, sort_keys=True, allow_nan=False))
        if version > 2:
            self.folder.drop(f"v{version - 2}")
        return version

    def load(self) -> dict[str, DataFrame]:
        """The current version's tables, checked against the manifest."""
        m = self.manifest()
        if m is None:
            return {}
        out = {}
        for name, held in m["tables"].items():
            schema = T.StructType.fromJson(held["schema"])
            df = self.spark.read.schema(schema).parquet(f"{self.folder.root}/v{m['version']}/{name}")
            if df.count() != held["rows"]:
                raise ValueError(f"{name} has not the {held['rows']} rows of the manifest")
            out[name] = df
        return out


def check_vectors(records: DataFrame, dims: int, vector_col: str = "embedding") -> DataFrame:
    """records, failing at the first vector of another length."""
    bad = F.raise_error(F.format_string("vector of %s numbers, not %s", F.size(vector_col), F.lit(dims)))
    return records.where(F.when(F.size(vector_col) == dims, True).otherwise(bad.cast("boolean")))


class Journal:
    """Committed writes since the last snapshot, appended in batches, each visible only when its marker is.

    A batch is named by a number and its writer's own mark and has a marker file of its own, so writers share nothing that one could
    overwrite for another, whatever the file system promises. Batches of one moment may share a number; what a writer did not
    finish is never read.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str | T.StructType, compact_every: int = 256):
        self.spark, self.folder, self.schema, self.compact_every = spark, Folder(spark, root), schema, compact_every

    def committed(self) -> list[str]:
        """Names of the batches, number and mark, in order."""
        held = [n.removeprefix("done-") for n in self.folder.names() if n.startswith("done-")]
        return sorted(held, key=lambda b: (int(b.partition("-")[0]), b))

    def _path(self, batch: str) -> str:
        number, _, mark = batch.partition("-")
        return f"batch={number}/writer={mark}"

    def append(self, writes: DataFrame) -> int:
        """Add a batch after all that are there; returns its number."""
        held = self.committed()
        seq = int(held[-1].partition("-")[0]) + 1 if held else 0
        name = f"{seq}-{uuid.uuid4().hex}"
        writes.write.parquet(f"{self.folder.root}/{self._path(name)}")
        self.folder.put(f"done-{name}", "")
        return seq

    def read(self, skip: Collection[str] = ()) -> DataFrame:
        """All committed writes with their batch's number, but for the batches to skip."""
        paths = [f"{self.folder.root}/{self._path(b)}" for b in self.committed() if b not in set(skip)]
        empty = self.spark.createDataFrame([], self.schema)
        if not paths:
            return empty.withColumn("batch", F.lit(0).cast("int"))
        schema = T.StructType([*empty.schema.fields, T.StructField("batch", T.IntegerType()), T.StructField("writer", T.StringType())])
        return self.spark.read.option("basePath", self.folder.root).schema(schema).parquet(*paths).drop("writer")

    def due(self) -> bool:
        return len(self.committed()) >= self.compact_every

    def compact(self, batches: Collection[str] | None = None) -> None:
        """Forget the batches that a snapshot now holds, the marker of each first."""
        held = self.committed()
        for b in held if batches is None else [x for x in batches if x in held]:
            self.folder.drop(f"done-{b}")
            self.folder.drop(self._path(b))


def replay(snapshot: DataFrame | None, tail: DataFrame, derive: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The state that the snapshot's writes and the journal's tail give by the normal path."""
    rows = tail.drop("batch")
    return derive(rows if snapshot is None else snapshot.unionByName(rows))


def cassette_key(kind: str, text: str) -> str:
    return hashlib.md5(f"{kind}\x1f{text}".encode()).hexdigest()


def replay_cassette(rows: DataFrame, cassette: DataFrame, kind: str, text_col: str, strict: bool = True) -> DataFrame:
    """rows with completion: the recorded answer (kind, key, value) to each text; a missing one fails unless strict is off."""
    key = F.md5(F.concat(F.lit(f"{kind}\x1f"), F.col(text_col)))
    held = cassette.where(F.col("kind") == kind).select(F.col("key").alias("__key"), F.col("value").alias("completion"))
    out = rows.withColumn("__key", key).join(held, "__key", "left")
    if strict:
        miss = F.raise_error(F.concat(F.lit("no recorded answer to: "), F.substring(text_col, 1, 80))).cast("string")
        out = out.withColumn("completion", F.coalesce("completion", miss))
    return out.drop("__key")


def record_cassette(rows: DataFrame, cassette: DataFrame, kind: str, text_col: str, model: Callable[[list[str]], list[str]]) -> DataFrame:
    """cassette with the model's answers to texts that it lacks; the model is called with batches, on the executors."""
    from pyspark.sql.pandas.functions import ArrowUDFType
    import pyarrow as pa

    def run(parts):
        for p in parts:
            yield pa.array(model(p.to_pylist()), pa.string())

    texts = rows.select(F.col(text_col).alias("t")).where("t IS NOT NULL").distinct().withColumn("key", F.md5(F.concat(F.lit(f"{kind}\x1f"), F.col("t"))))
    new = texts.join(cassette.where(F.col("kind") == kind).select("key"), "key", "left_anti")
    made = new.select(F.lit(kind).alias("kind"), "key", F.arrow_udf(run, "string", ArrowUDFType.SCALAR_ITER)(F.col("t")).alias("value"))
    return cassette.select("kind", "key", "value").unionByName(made)


def json_rows(df: DataFrame) -> DataFrame:
    """(json): every row as JSON that any reader takes: numbers that JSON has no form for become text in a tagged object."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            odd = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf")
            cols += [F.when(odd.isNull(), c).alias(f.name), F.when(odd.isNotNull(), F.struct(odd.alias("__f__"))).alias(f"{f.name}__special")]
        else:
            cols.append(c)
    return df.select(F.to_json(F.struct(*cols)).alias("json"))


def of_namespace(table: DataFrame, namespace: str) -> DataFrame:
    return table.where(F.col("namespace") == namespace)


def drop_namespace(table: DataFrame, namespace: str) -> DataFrame:
    """table without a tenant's rows; every key holds the namespace, so nobody else's change."""
    return table.where(F.col("namespace") != namespace)


def namespaces(*tables: DataFrame) -> DataFrame:
    out = tables[0].select("namespace")
    for t in tables[1:]:
        out = out.union(t.select("namespace"))
    return out.distinct()
