"""Tables kept in buckets of their keys: a change rewrites the buckets that it touches and no others, and changes of several
tables become visible at once.

A manifest entry names the folders of every bucket of every table. Entries are numbered; the highest is the store's state. An
entry is written under another name and then renamed, without replacing one that is there: a job that dies at any step
leaves the state as it was, and of two writers that started from the same state one fails and has to start again."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.tables import last_of, publish, published
from quire.sources.staging import file_system


class Store:
    """The tables below a folder. Each has a column by which its rows are dealt to buckets: that of the document or file that owns
    a row, so that what belongs to one owner lies together."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def state(self) -> tuple[int, dict]:
        """The number of the next manifest entry and what the last one says: by table its schema, column, number of buckets, and
        the folders of each bucket that has rows."""
        entries, number = published(self.spark, f"{self.path}/manifest")
        return number, json.loads(entries[-1][1]) if entries else {}

    def bucket(self, table: dict, column: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(column or table["by"])), F.lit(table["buckets"])).cast("int")

    def touched(self, table: dict, keys: DataFrame) -> list[int]:
        """Buckets of the keys (their first column); as many numbers as the table has buckets, at most, come to the driver."""
        return sorted(r[0] for r in keys.select(self.bucket(table, keys.columns[0]).alias("b")).distinct().collect())

    def rows(self, table: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(table["schema"])
        chosen = table["files"] if buckets is None else {str(b): table["files"].get(str(b), []) for b in buckets}
        folders = [f"{self.path}/{f}" for fs in chosen.values() for f in fs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        """A table, or of it the rows whose bucket column is among keys (one column): other buckets are not read."""
        _, tables = self.state()
        if keys is None:
            return self.rows(tables[name])
        by = tables[name]["by"]
        return self.rows(tables[name], self.touched(tables[name], keys)).join(keys.select(F.col(keys.columns[0]).alias(by)), by, "left_semi")

    def write(self, name: str, table: dict, df: DataFrame) -> dict[str, list[str]]:
        """Store rows in a new folder: the folders of their buckets. A large bucket is written by several tasks."""
        version = f"{name}/v-{uuid.uuid4().hex}"
        rows = df.select(*T.StructType.fromJson(table["schema"]).fieldNames()).withColumn("bucket", self.bucket(table))
        rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", table["by"]).write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        fs, place = file_system(self.spark, f"{self.path}/{version}")
        names = [x.getPath().getName() for x in fs.listStatus(place)]
        return {n.removeprefix("bucket="): [f"{version}/{n}"] for n in names if n.startswith("bucket=")}

    def create(self, name: str, df: DataFrame, by: str, buckets: int = 64) -> None:
        """Add a table, or put another one in the place of it."""
        number, tables = self.state()
        table = {"schema": df.schema.jsonValue(), "by": by, "buckets": buckets, "files": {}}
        table["files"] = self.write(name, table, df)
        publish(self.spark, f"{self.path}/manifest", number, json.dumps(tables | {name: table}))

    def change(self, changes: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]]) -> dict[str, list[int]]:
        """Change several tables by one entry: for each the keys (one column) whose buckets are touched, and a function from the rows
        of these buckets to new ones, which have to belong to the same buckets. The buckets that were rewritten, by table."""
        number, tables = self.state()
        done, after = {}, dict(tables)
        for name, (keys, change) in changes.items():
            table = tables[name]
            done[name] = self.touched(table, keys)
            files = {b: fs for b, fs in table["files"].items() if int(b) not in done[name]}
            after[name] = table | {"files": files | (self.write(name, table, change(self.rows(table, done[name]))) if done[name] else {})}
        publish(self.spark, f"{self.path}/manifest", number, json.dumps(after))
        return done

    def upsert(self, name: str, new: DataFrame, key: str, order: str | None = None, newer: bool = False) -> list[int]:
        """Rows of `new` replace those with the same key and owner; of a key that is repeated, last_of() by `order` stays. With
        newer, rows that are there count as well, so that an older row replaces nothing."""
        by = self.state()[1][name]["by"]

        def change(old: DataFrame) -> DataFrame:
            if newer:
                return last_of(old.unionByName(new.select(*old.columns)), key, order)
            return old.join(new.select(key), key, "left_anti").unionByName(last_of(new, key, order).select(*old.columns))

        return self.change({name: (new.select(by), change)})[name]

    def replace_owned(self, name: str, new: DataFrame) -> list[int]:
        """All rows of the owners that `new` names give way to its rows."""
        by = self.state()[1][name]["by"]
        return self.change({name: (new.select(by), lambda old: old.join(new.select(by).distinct(), by, "left_anti").unionByName(new.select(*old.columns)))})[name]

    def delete_owned(self, ids: DataFrame, owner: str, names: list[str] | None = None) -> DataFrame:
        """Delete the rows of owners in ids (one column) from every table, by one entry. The ids that the table `owner` doesn't
        have, whose rows elsewhere go as well."""
        _, tables = self.state()
        ids = ids.select(F.col(ids.columns[0]).alias("id")).distinct()
        known = self.rows(tables[owner], self.touched(tables[owner], ids)).select(F.col(tables[owner]["by"]).alias("id"))
        less = lambda by: lambda old: old.join(ids.select(F.col("id").alias(by)), by, "left_anti")
        self.change({n: (ids, less(tables[n]["by"])) for n in names or tables})
        return ids.join(known, "id", "left_anti")

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete what the last `keep` entries don't name, and the entries before them. Not while others write or read older states."""
        entries, _ = published(self.spark, f"{self.path}/manifest", keep)
        tables = [t for _, text in entries for t in json.loads(text).items()]
        used = {f for _, t in tables for fs in t["files"].values() for f in fs}
        fs, place = file_system(self.spark, self.path)
        below = lambda folder: [x.getPath() for x in fs.listStatus(folder) if x.isDirectory()]
        gone = []
        for version in (v for table in below(place) if table.getName() != "manifest" for v in below(table)):
            for bucket in below(version):
                name = f"{version.getParent().getName()}/{version.getName()}/{bucket.getName()}"
                if name not in used and fs.delete(bucket, True):
                    gone.append(name)
        for old in range(entries[0][0] if entries else 0):
            fs.delete(file_system(self.spark, f"{self.path}/manifest/{old:09d}")[1], False)
        return sorted(gone)
