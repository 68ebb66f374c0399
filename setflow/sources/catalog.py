"""Databases of typed sets: creation, loading, reading back, export and partitioned copies.

Created sets are Parquet tables of the session's catalog; a folder of Parquet files can be attached as a read-only database.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Row as SparkRow
from pyspark.sql import functions as F
from pyspark.sql import types as T

from setflow.operators import computations as N
from setflow.plans.compiler import Compiler
from setflow.types import REGISTRY, TypeRegistry

FORMATS = ("parquet", "csv", "json", "orc")


class SetStore:
    def __init__(self, spark: SparkSession, types: TypeRegistry = REGISTRY):
        self.spark, self.types = spark, types
        self._folders: dict[str, str] = {}
        self._frames: dict[tuple[str, str], DataFrame] = {}
        self._copies: dict[str, dict[tuple[str, str], str]] = {}

    # --- definition ---
    def create_database(self, db: str) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{db}`")

    def create_set(self, db: str, name: str, type_name: str) -> None:
        schema = self.types[type_name].schema
        if schema is None:
            raise TypeError(f"type {type_name} has no schema")
        self.spark.createDataFrame([], schema).write.format("parquet").saveAsTable(f"`{db}`.`{name}`")
        self.spark.sql(f"ALTER TABLE `{db}`.`{name}` SET TBLPROPERTIES ('setflow.type' = '{type_name}')")

    def remove_set(self, db: str, name: str) -> None:
        self._frames.pop((db, name), None)
        self._changed(db, name)
        self.spark.sql(f"DROP TABLE IF EXISTS `{db}`.`{name}`")

    def clear_set(self, db: str, name: str) -> None:
        self._changed(db, name)
        self.spark.sql(f"TRUNCATE TABLE `{db}`.`{name}`")

    def remove_database(self, db: str) -> None:
        self._folders.pop(db, None)
        self._copies.pop(db, None)
        self.spark.sql(f"DROP DATABASE IF EXISTS `{db}` CASCADE")

    def attach(self, db: str, folder: str) -> SetStore:
        """Every folder/<set>.parquet is a set of db."""
        self._folders[db] = folder
        return self

    def attach_frame(self, db: str, name: str, df: DataFrame) -> SetStore:
        """A temporary set: it lives as long as this store."""
        self._frames[db, name] = df
        return self

    def databases(self) -> list[str]:
        return sorted({d.name for d in self.spark.catalog.listDatabases()} | set(self._folders) | {d for d, _ in self._frames})

    def sets(self, db: str) -> list[str]:
        own = {n for d, n in self._frames if d == db}
        if self.spark.catalog.databaseExists(db):
            own |= {t.name for t in self.spark.catalog.listTables(db) if not t.isTemporary}
        return sorted(own)

    def type_of(self, db: str, name: str) -> str | None:
        rows = self.spark.sql(f"SHOW TBLPROPERTIES `{db}`.`{name}`").where("key = 'setflow.type'").collect()
        return rows[0]["value"] if rows else None

    # --- data ---
    def send_data(self, db: str, name: str, rows: Iterable) -> int:
        """Append rows from the client."""
        rows = list(rows)
        self._changed(db, name)
        schema = self.spark.table(f"`{db}`.`{name}`").schema
        self.spark.createDataFrame(rows, schema).write.mode("append").insertInto(f"{db}.{name}")
        return len(rows)

    def send_bytes(self, db: str, name: str, stream: bytes) -> int:
        """Append the rows of an Arrow stream from the client."""
        table = pa.ipc.open_stream(stream).read_all()
        self.append(db, name, self.spark.createDataFrame(table))
        return table.num_rows

    def flush(self, db: str, name: str) -> None:
        """Rows are on disk when a call returns; this makes the session see what others wrote."""
        self.spark.catalog.refreshTable(f"`{db}`.`{name}`")

    def read(self, db: str, name: str) -> DataFrame:
        if (db, name) in self._frames:
            return self._frames[db, name]
        if db in self._folders:
            return self.spark.read.parquet(f"{self._folders[db]}/{name}.parquet")
        return self.spark.table(f"`{db}`.`{name}`")

    def append(self, db: str, name: str, df: DataFrame) -> None:
        self._changed(db, name)
        columns = self.spark.table(f"`{db}`.`{name}`").columns
        df.select(*[F.col(f"`{c}`") for c in columns]).write.mode("append").insertInto(f"{db}.{name}")

    def iterate(self, db: str, name: str) -> Iterator[SparkRow]:
        """Rows on the client, one partition at a time."""
        return self.read(db, name).toLocalIterator()

    def export(self, db: str, name: str, path: str, fmt: str = "parquet") -> None:
        if fmt not in FORMATS:
            raise ValueError(f"{fmt} is none of {', '.join(FORMATS)}")
        df = self.read(db, name)
        if fmt == "csv":  # nested columns have no CSV form but their JSON
            nested = (T.StructType, T.ArrayType, T.MapType)
            df = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields])
        df.write.mode("overwrite").format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)

    def partition_set(self, db: str, source: str, target: str, key: str, buckets: int, keys_only: bool = False) -> None:
        """A copy of a set bucketed by key. Its origin is a property of the table; joins of the set on that key read the copy, without a shuffle.

        A change of the set through a store makes its copies stale: joins read the set itself until it is partitioned anew.
        """
        df = self.read(db, source)
        df = df.select(key) if keys_only else df
        df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(f"`{db}`.`{target}`")
        self.spark.sql(f"ALTER TABLE `{db}`.`{target}` SET TBLPROPERTIES ('setflow.source' = '{source}', 'setflow.key' = '{key}', 'setflow.whole' = '{"" if keys_only else "yes"}')")
        self._copies.pop(db, None)

    def _copies_of(self, db: str) -> dict[tuple[str, str], str]:
        """The whole and fresh copies in a database, by set and key."""
        if db not in self._copies:
            self._copies[db] = {}
            if self.spark.catalog.databaseExists(db):
                for t in self.spark.catalog.listTables(db):
                    if not t.isTemporary:
                        own = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES `{db}`.`{t.name}`").collect()}
                        if own.get("setflow.whole") == "yes":
                            self._copies[db][own["setflow.source"], own["setflow.key"]] = t.name
        return self._copies[db]

    def _changed(self, db: str, name: str) -> None:
        for (source, _), copy in list(self._copies_of(db).items()):
            if name in (source, copy):
                self.spark.sql(f"ALTER TABLE `{db}`.`{copy}` SET TBLPROPERTIES ('setflow.whole' = '')")
                self._copies.pop(db, None)

    def bucketed(self, db: str, name: str, key: str) -> DataFrame | None:
        """A whole copy of a set that is bucketed by a field, if there is a fresh one."""
        if (db, name) in self._frames or (copy := self._copies_of(db).get((name, key))) is None:
            return None
        return self.spark.table(f"`{db}`.`{copy}`")

    def place(self, df: DataFrame, partitions: int, policy: str = "round_robin", seed: int = 0) -> DataFrame:
        """Rows dealt to partitions in turn, or by a seeded draw."""
        if policy == "round_robin":
            return df.repartition(partitions)
        if policy == "random":
            return df.repartition(partitions, F.xxhash64(F.lit(seed), *df.columns))
        raise ValueError(f"unknown policy {policy}")

    def statistics(self, db: str, name: str) -> dict[str, str]:
        """Collects and returns what the planner knows of a set."""
        self.spark.sql(f"ANALYZE TABLE `{db}`.`{name}` COMPUTE STATISTICS")
        found = self.spark.sql(f"DESCRIBE EXTENDED `{db}`.`{name}`").where("col_name IN ('Statistics', 'Type', 'Provider')").collect()
        return {r["col_name"]: r["data_type"] for r in found}

    # --- execution ---
    def frame(self, node: N.Computation) -> DataFrame:
        """The rows of a node, not yet computed."""
        return Compiler(self.read, self.types, self.bucketed).compile(node)

    def execute(self, *sinks: N.Computation) -> None:
        """Run a graph: every write, and every node with an output of its own; shared nodes with several writes are kept meanwhile."""
        compiler = Compiler(self.read, self.types, self.bucketed)
        targets: list[tuple[str, str, N.Computation]] = []
        seen: set[int] = set()

        def visit(node: N.Computation) -> None:
            if id(node) in seen:
                return
            seen.add(id(node))
            for kid in node.wired():
                visit(kid)
            if node.output:
                targets.append((*node.output, node))
            if isinstance(node, N.Write):
                targets.append((node.db, node.set_name, node))

        for sink in sinks:
            visit(sink)
        shared = [compiler.compile(n).persist() for _, _, n in targets if n.output and len(targets) > 1]
        try:
            for db, name, node in targets:
                self.append(db, name, compiler.compile(node))
        finally:
            for df in shared:
                df.unpersist()
