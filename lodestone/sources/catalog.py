"""Declared tables: schema, primary key, secondary indexes, and data as immutable versions of Parquet folders.

A write makes a new version and then names it as the current one, so readers of the one before are not disturbed; older versions are deleted. The
registry is a JSON document a change, numbered, in the catalog's folder, which may be in any file system that Spark reaches: the one of the highest
number counts, so a crash between two leaves the older one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import METRICS
from ..operators.changes import upsert
from ..operators.vectors import knn


class EngineError(Exception):
    """An error with its SQLSTATE."""

    def __init__(self, state: str, text: str) -> None:
        super().__init__(f"[{state}] {text}")
        self.state = state


@dataclass
class Table:
    name: str
    schema: T.StructType
    primary_key: list[str] = field(default_factory=list)
    indexes: dict[str, dict] = field(default_factory=dict)
    version: int = 0


class Catalog:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self.tables: dict[str, Table] = {}
        self.number = 0
        self._load()

    def _path(self, name: str):  # noqa: ANN202
        path = self._hadoop.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _registries(self) -> list[int]:
        path, store = self._path("registry")
        names = [x.getPath().getName() for x in store.listStatus(path)] if store.exists(path) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def _load(self) -> None:
        if numbers := self._registries():
            self.number = numbers[-1]
            text = self.spark.read.text(f"{self.folder}/registry/{self.number}.json", wholetext=True).first()[0]
            for name, t in json.loads(text).items():
                self.tables[name] = Table(name, T.StructType.fromJson(t["schema"]), t["primary_key"], t["indexes"], t["version"])
            for name in self.tables:
                self._show(name)

    def _save(self) -> None:
        text = json.dumps({n: {"schema": t.schema.jsonValue(), "primary_key": t.primary_key, "indexes": t.indexes, "version": t.version} for n, t in self.tables.items()})
        tmp, store = self._path(f"registry/{self.number + 1}.tmp")
        out = store.create(tmp, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not store.rename(tmp, self._path(f"registry/{self.number + 1}.json")[0]):
            raise EngineError("58000", "the registry can't be written")
        self.number += 1
        for old in self._registries():
            if old < self.number - 1:
                store.delete(self._path(f"registry/{old}.json")[0], False)

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise EngineError("42P01", f"there is no table {name}")
        return self.tables[name]

    def read(self, name: str) -> DataFrame:
        own = self.table(name)
        return self.spark.read.schema(own.schema).parquet(f"{self.folder}/{name}/v{own.version}")

    def _show(self, name: str) -> None:
        self.read(name).createOrReplaceTempView(name)

    def write(self, name: str, rows: DataFrame, schema: T.StructType | None = None) -> None:
        """Puts rows in place of the table's, with a new schema if one is given. Nothing is changed if the rows don't fit."""
        own, schema = self.table(name), schema or self.table(name).schema
        missing = [f.name for f in schema if f.name not in rows.columns]
        if missing:
            raise EngineError("42703", f"{name} has columns {missing} that the rows lack")
        strict = [f.name for f in schema if not f.nullable]
        if strict:
            found = rows.agg(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(c) for c in strict]).first()
            if bad := [c for c in strict if found[c]]:
                raise EngineError("23502", f"{name}.{bad[0]} must not be null")
        rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in schema]).write.parquet(f"{self.folder}/{name}/v{own.version + 1}", mode="overwrite")
        own.version, own.schema = own.version + 1, schema
        self._save()
        self._show(name)
        old, store = self._path(f"{name}/v{own.version - 2}")
        store.delete(old, True)

    def insert(self, name: str, rows: DataFrame) -> None:
        """Adds rows; with a primary key, a row replaces the one of its key."""
        own = self.table(name)
        self.write(name, upsert(self.read(name), rows, own.primary_key) if own.primary_key else self.read(name).unionByName(rows))

    def create(self, name: str, schema: T.StructType, primary_key: list[str] | None = None, if_not_exists: bool = False) -> Table:
        if name in self.tables:
            if if_not_exists:
                return self.tables[name]
            raise EngineError("42P07", f"there is a table {name} already")
        names = [f.name for f in schema]
        if len(set(names)) != len(names):
            raise EngineError("42701", f"{name} has a column twice")
        if unknown := [k for k in primary_key or [] if k not in names]:
            raise EngineError("42703", f"{name} has no columns {unknown} for its key")
        self.tables[name] = own = Table(name, schema, primary_key or [])
        self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.folder}/{name}/v0")
        self._save()
        self._show(name)
        return own

    def drop(self, name: str, if_exists: bool = False) -> bool:
        if name not in self.tables:
            if if_exists:
                return False
            raise EngineError("42P01", f"there is no table {name}")
        del self.tables[name]
        self._save()
        self.spark.catalog.dropTempView(name)
        path, store = self._path(name)
        store.delete(path, True)
        return True

    def create_index(self, table: str, columns: list[str], name: str | None = None, kind: str = "btree", **params: object) -> str:
        own, name = self.table(table), name or f"{table}_idx"
        if unknown := [c for c in columns if c not in own.schema.names]:
            raise EngineError("42703", f"{table} has no columns {unknown}")
        if any(name in t.indexes for t in self.tables.values()):
            raise EngineError("42P07", f"there is an index {name} already")
        if any(isinstance(own.schema[c].dataType, T.ArrayType) for c in columns):
            self._check_vector_index(table, columns, params)
        own.indexes[name] = {"columns": columns, "kind": kind.lower(), **params}
        self._save()
        return name

    def _check_vector_index(self, table: str, columns: list[str], params: dict) -> None:
        """An index on a column of number arrays answers nearest-neighbour searches, whatever its kind: exactly, by one scan. A declared dimension is the column's."""
        own = self._column(table, columns[0])
        if len(columns) != 1 or not isinstance(own.dataType.elementType, T.NumericType):
            raise EngineError("42804", "a vector index is on one column of numbers")
        declared, asked = own.metadata.get("vector_dim"), params.get("dimension")
        if declared is not None and asked is not None and int(asked) != int(declared):
            raise EngineError("22023", f"{table}.{columns[0]} has {declared} dimensions, not {asked}")
        if params.setdefault("metric", "l2") not in METRICS:
            raise EngineError("22023", f"{params['metric']!r} is none of {sorted(METRICS)}")

    def index(self, name: str) -> tuple[Table, dict]:
        for own in self.tables.values():
            if name in own.indexes:
                return own, own.indexes[name]
        raise EngineError("42704", f"there is no index {name}")

    def list_indexes(self, table: str | None = None) -> DataFrame:
        """name, table, columns, kind, params (JSON)."""
        found = [(n, t.name, i["columns"], i["kind"], json.dumps({k: v for k, v in i.items() if k not in ("columns", "kind")}, sort_keys=True)) for t in self.tables.values() for n, i in t.indexes.items() if table in (None, t.name)]
        return self.spark.createDataFrame(found, "name string, table string, columns array<string>, kind string, params string")

    def search(self, index: str, query: list[float], k: int = 10, where: str | None = None, radius: float | None = None) -> DataFrame:
        """The k rows (all columns: the payload too) of the index's table that are nearest to the query, with their distance."""
        own, info = self.index(index)
        if not isinstance(own.schema[info["columns"][0]].dataType, T.ArrayType):
            raise EngineError("42809", f"{index} is no vector index")
        if (asked := info.get("dimension")) is not None and len(query) != int(asked):
            raise EngineError("22023", f"{index} has {asked} dimensions, the query {len(query)}")
        order = own.primary_key[0] if own.primary_key else own.schema.names[0]
        return knn(self.read(own.name), query, k, order, info["columns"][0], info.get("metric", "l2"), F.expr(where) if where else None, radius)

    def delete_rows(self, table: str, keys: DataFrame) -> None:
        """Deletes the rows of these primary keys; indexes are read from the table, so they follow."""
        self.write(table, self.read(table).join(keys.select(*self.table(table).primary_key), self.table(table).primary_key, "left_anti"))

    def drop_index(self, name: str, if_exists: bool = False) -> bool:
        for own in self.tables.values():
            if own.indexes.pop(name, None):
                self._save()
                return True
        if if_exists:
            return False
        raise EngineError("42704", f"there is no index {name}")

    def _column(self, name: str, column: str) -> T.StructField:
        found = [f for f in self.table(name).schema if f.name == column]
        if not found:
            raise EngineError("42703", f"{name} has no column {column}")
        return found[0]

    def add_column(self, name: str, column: T.StructField, default: object = None) -> None:
        """Rows that are there get the default: the one given, or else the column's own."""
        own = self.table(name)
        if column.name in own.schema.names:
            raise EngineError("42701", f"{name} has a column {column.name} already")
        value = F.lit(column.metadata.get("default") if default is None else default).cast(column.dataType)
        self.write(name, self.read(name).withColumn(column.name, value), T.StructType([*own.schema.fields, column]))

    def drop_column(self, name: str, column: str) -> None:
        """Indexes on the column go with it."""
        own = self.table(name)
        self._column(name, column)
        if column in own.primary_key:
            raise EngineError("42P16", f"{column} is of the key of {name}")
        if len(own.schema) == 1:
            raise EngineError("42P16", f"{column} is the only column of {name}")
        own.indexes = {k: i for k, i in own.indexes.items() if column not in i["columns"]}
        self.write(name, self.read(name), T.StructType([f for f in own.schema if f.name != column]))

    def rename_column(self, name: str, old: str, new: str) -> None:
        """The key and indexes follow."""
        own = self.table(name)
        self._column(name, old)
        if new in own.schema.names:
            raise EngineError("42701", f"{name} has a column {new} already")
        rows = self.read(name).withColumnRenamed(old, new)
        own.primary_key = [new if k == old else k for k in own.primary_key]
        own.indexes = {k: i | {"columns": [new if c == old else c for c in i["columns"]]} for k, i in own.indexes.items()}
        self.write(name, rows, T.StructType([T.StructField(new if f.name == old else f.name, f.dataType, f.nullable, f.metadata) for f in own.schema]))

    def describe(self, name: str) -> DataFrame:
        own = self.table(name)
        rows = [(f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("default"), "primary key" if f.name in own.primary_key else None) for f in own.schema]
        return self.spark.createDataFrame(rows, "column string, type string, nullable boolean, default string, extra string")

    def list(self) -> DataFrame:
        return self.spark.createDataFrame([(t.name, ",".join(t.primary_key), len(t.schema), ",".join(sorted(t.indexes))) for t in self.tables.values()], "name string, primary_key string, columns int, indexes string")
