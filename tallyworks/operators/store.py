"""Tables in buckets under one manifest: a change set rewrites the buckets it touches, of several tables in one step.

A row lies in the bucket of a hash of its table's bucket column. A commit writes a change set once, by bucket and operation, into a folder
of its own, adds what stays of the touched buckets and then writes a manifest, a small file that names the folder of every bucket of every table. The manifest
is what counts: until it is there nothing has changed, afterwards all of it has, and no file that is being read is
overwritten. Untouched buckets keep their files. One writer at a time.

Of several changes to a key the one with the highest sequence wins, of equal sequences an upsert. A deleted row takes the rows of other
tables that refer to it along, in the same commit. A commit that carries a source and a batch number is made once,
so a replayed batch changes nothing.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructType

from .snapshot import _fs

#: Buckets of a table unless it says otherwise; manifests that stay readable.
BUCKETS, KEEP = 16, 2
#: Values in a task's share of a shuffle of whole rows (its compressed size says little of the memory that they take), and changed keys that are sent to every task.
TASK_VALUES, BROADCAST = 2_000_000, 100_000


def leaves(t: DataType) -> int:
    """Values of a row of this type."""
    if isinstance(t, ArrayType):
        return leaves(t.elementType)
    return sum(leaves(f.dataType) for f in t) if isinstance(t, StructType) else 1


def tasks(rows: int, schema: StructType) -> int:
    """Partitions for so many rows; as their number is given, small ones are not put together."""
    return max(1, math.ceil(rows * leaves(schema) / TASK_VALUES))


def meet(rows: DataFrame, side: DataFrame, on: Column | str | list[str], how: str, n: int, parts: int = 0) -> DataFrame:
    """rows joined with a side of at most n rows, which is sent to every task only if these are few; else both are shuffled, over parts tasks if given.

    Spark would choose by the size of files, which says little of a few narrow columns of wide rows: a side that seems small may fill the driver.
    """
    if n <= BROADCAST:
        return rows.join(F.broadcast(side), on, how)
    if parts:
        keys = [on] if isinstance(on, str) else on
        rows, side = rows.repartition(parts, *keys), side.repartition(parts, *keys)
    return rows.join(side.hint("merge"), on, how)


def upserts(rows: DataFrame, seq: Column | int = 0) -> DataFrame:
    """Rows as changes: inserted, or put in the place of the row with their key."""
    return rows.withColumns({"_op": F.lit("upsert"), "_seq": F.lit(seq).cast("long")})


def deletes(keys: DataFrame, seq: Column | int = 0) -> DataFrame:
    """Keys as changes that delete their rows."""
    return keys.withColumns({"_op": F.lit("delete"), "_seq": F.lit(seq).cast("long")})


@dataclass
class Manifest:
    version: int = 0
    #: table -> bucket -> folder
    buckets: dict[str, dict[str, str]] = field(default_factory=dict)
    last_ids: dict[str, int] = field(default_factory=dict)
    #: source -> last batch that is in
    batches: dict[str, int] = field(default_factory=dict)


class Store:
    """A folder of tables that change together."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.tables: dict[str, BucketTable] = {}
        #: Functions of (manifest before, manifest to be, changes) that give changes of further tables for the same commit.
        self.derived: list[Callable[[Manifest, Manifest, dict[str, DataFrame]], dict[str, DataFrame]]] = []

    def table(self, name: str, schema: StructType, keys: list[str], bucket_by: str | None = None, buckets: int = BUCKETS, children: dict[str, str] | None = None) -> BucketTable:
        """children: tables whose rows go with a deleted row, by their column that refers to this table's key."""
        self.tables[name] = BucketTable(self, name, schema, keys, bucket_by or keys[0], buckets, children or {})
        return self.tables[name]

    def _versions(self) -> list[int]:
        fs, p = _fs(self.spark, f"{self.path}/_manifest")
        if not fs.exists(p):
            return []
        return sorted(int(m[1]) for s in fs.listStatus(p) if (m := re.fullmatch(r"v(\d+)\.json", s.getPath().getName())))

    def manifest(self, version: int | None = None) -> Manifest:
        found = self._versions()
        if not found:
            return Manifest()
        fs, p = _fs(self.spark, f"{self.path}/_manifest/v{found[-1] if version is None else version:08d}.json")
        stream = fs.open(p)
        try:
            return Manifest(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _publish(self, made: Manifest) -> None:
        """Written aside and renamed, so a manifest is whole or not there."""
        name = f"{self.path}/_manifest/v{made.version:08d}.json"
        fs, aside = _fs(self.spark, f"{self.path}/_manifest/.{uuid.uuid4().hex}")
        final = _fs(self.spark, name)[1]
        if fs.exists(final):
            raise RuntimeError(f"another writer made version {made.version} of {self.path}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(made.__dict__).encode()))
        out.close()
        if not fs.rename(aside, final):
            raise RuntimeError(f"version {made.version} of {self.path} could not be published")

    def apply(self, changes: dict[str, DataFrame], last_ids: dict[str, int] | None = None, batch: tuple[str, int] | None = None) -> bool:
        """Applies changes (the table's columns, _op, _seq) of one or more tables as one commit; False if the batch is already in."""
        now = self.manifest()
        if batch and now.batches.get(batch[0], -1) >= batch[1]:
            return False
        commit = f"c{now.version + 1}"
        folders: dict[str, str] = {}
        dropped: list[str] = []

        def latest_of(name: str, df: DataFrame) -> DataFrame:
            if name in folders:
                dropped.append(f"{self.path}/{name}/{folders[name]}")
            folders[name] = f"{commit}-{uuid.uuid4().hex[:8]}"
            return self.tables[name].latest(df, folders[name])

        latest = {name: latest_of(name, df) for name, df in changes.items()}
        for name in list(latest):
            for child, column in self.tables[name].children.items():
                dead = latest[name].where("_op = 'delete'").select(F.col(self.tables[name].keys[0]).cast(self.tables[child].schema[column].dataType).alias(column))
                n = dead.count()
                if not n:
                    continue
                lines = self.tables[child].orphans(dead, column, now)
                if child in latest:  # whatever else was to happen to a line of a row that is gone, it goes
                    lines = lines.unionByName(meet(latest[child].withColumn("_seq", F.lit(0).cast("long")), dead, column, "left_anti", n), allowMissingColumns=True)
                latest[child] = latest_of(child, lines)
        made = Manifest(now.version + 1, {k: dict(v) for k, v in now.buckets.items()}, {**now.last_ids, **(last_ids or {})}, dict(now.batches))

        def write(name: str, df: DataFrame) -> None:
            table = self.tables[name]
            touched = table.buckets_of(df)
            if touched:
                table.keep(df, touched, folders[name], now)
                own = made.buckets.setdefault(name, {})
                for b in touched:
                    own.pop(str(b), None)
                own.update({str(b): folders[name] for b in table.written(folders[name], touched)})

        for name, df in latest.items():
            write(name, df)
        for derive in self.derived:
            for name, df in derive(now, made, latest).items():
                latest_of(name, df)
                write(name, self.tables[name].changed(folders[name]))
        if batch:
            made.batches[batch[0]] = batch[1]
        self._publish(made)
        for path in dropped:
            fs, p = _fs(self.spark, path)
            fs.delete(p, True)
        self._clean()
        return True

    def _clean(self) -> None:
        """Removes manifests but for the newest, and bucket folders that none of those names."""
        found = self._versions()
        if len(found) <= KEEP:
            return
        used = {(t, b, f) for v in found[-KEEP:] for t, own in self.manifest(v).buckets.items() for b, f in own.items()}
        for v in found[:-KEEP]:
            for t, own in self.manifest(v).buckets.items():
                for b, f in own.items():
                    if (t, b, f) not in used:
                        fs, p = _fs(self.spark, f"{self.path}/{t}/{f}/bucket={b}")
                        fs.delete(p, True)
            fs, p = _fs(self.spark, f"{self.path}/_manifest/v{v:08d}.json")
            fs.delete(p, False)


class BucketTable:
    """One table of a store."""

    def __init__(self, store: Store, name: str, schema: StructType, keys: list[str], bucket_by: str, buckets: int, children: dict[str, str]):
        self.store, self.name, self.schema, self.keys, self.bucket_by, self.buckets, self.children = store, name, schema, keys, bucket_by, buckets, children

    @property
    def last_id(self) -> int:
        return self.store.manifest().last_ids.get(self.name, 0)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int")

    def files(self, manifest: Manifest | None = None) -> dict[int, str]:
        """Bucket -> folder that holds it now."""
        own = (manifest or self.store.manifest()).buckets.get(self.name, {})
        return {int(b): f"{self.store.path}/{self.name}/{f}/bucket={b}/_op=upsert" for b, f in own.items()}

    def read(self, buckets: list[int] | None = None, manifest: Manifest | None = None) -> DataFrame:
        """The whole table, or some of its buckets."""
        paths = [p for b, p in sorted(self.files(manifest).items()) if buckets is None or b in set(buckets)]
        spark = self.store.spark
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def read_keys(self, keys: DataFrame, manifest: Manifest | None = None) -> DataFrame:
        """The rows whose bucket column is among some values; only their buckets are read."""
        held = self.rows_by_bucket(keys)
        return meet(self.read(sorted(held), manifest), keys.select(self.bucket_by).distinct(), self.bucket_by, "left_semi", sum(held.values()))

    def rows_by_bucket(self, rows: DataFrame) -> dict[int, int]:
        """Bucket -> how many of the rows lie in it; at most as many as there are buckets."""
        own = F.col("bucket") if "bucket" in rows.columns else self.bucket()
        return dict(tuple(r) for r in rows.groupBy(own.alias("b")).agg(F.count(F.lit(1))).collect())

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """At most as many numbers as there are buckets."""
        return sorted(self.rows_by_bucket(rows))

    def _dealt(self, rows: DataFrame, n: int) -> DataFrame:
        """Rows by bucket and shares of it, over n tasks: neither a bucket nor a hot value of its column lies in one task or one file."""
        share = F.pmod(F.xxhash64(*self.keys, F.lit(1)), F.lit(max(1, math.ceil(4 * n / self.buckets)))).cast("int")
        return rows.withColumns({"bucket": self.bucket(), "_share": share}).repartition(n, "bucket", "_share")

    def latest(self, changes: DataFrame, folder: str) -> DataFrame:
        """One change for each key, the last one, written into a commit's folder by bucket and operation."""
        names = self.schema.names
        row = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in changes.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        dealt = self._dealt(changes.select(*row, "_op", "_seq"), tasks(changes.count(), self.schema))
        keyed = dealt.groupBy("bucket", "_share", *[F.col(k).alias(f"_k_{k}") for k in self.keys])
        if set(names) == set(self.keys):  # a row that is nothing but its key
            at = lambda op: F.max(F.when(F.col("_op") == op, F.coalesce("_seq", F.lit(-(1 << 63)))))
            last = keyed.agg(at("upsert").alias("_u"), at("delete").alias("_d")).withColumn("_op", F.when(F.col("_d").isNull() | (F.col("_u") >= F.col("_d")), "upsert").otherwise("delete"))
            last = last.select(*[F.col(f"_k_{k}").alias(k) for k in names], "bucket", "_op")
        else:
            last = keyed.agg(F.max_by(F.struct(*names, "_op"), F.struct("_seq", "_op")).alias("r")).select("r.*", "bucket").select(*names, "bucket", "_op")
        last.write.partitionBy("bucket", "_op").parquet(f"{self.store.path}/{self.name}/{folder}")
        return self.changed(folder)

    def changed(self, folder: str) -> DataFrame:
        """The changes in a commit's folder, as its files are now."""
        kinds = StructType([*self.schema.fields]).add("bucket", IntegerType()).add("_op", StringType())
        return self.store.spark.read.schema(kinds).parquet(f"{self.store.path}/{self.name}/{folder}")

    def orphans(self, gone: DataFrame, column: str, manifest: Manifest) -> DataFrame:
        """Deletes of the rows that refer to keys that are gone; where rows lie by that column, only its buckets are read."""
        own = self.read(self.buckets_of(gone) if column == self.bucket_by else None, manifest)
        return deletes(meet(own, gone.distinct(), column, "left_semi", gone.count()).select(*self.keys))

    def keep(self, latest: DataFrame, touched: list[int], folder: str, manifest: Manifest) -> None:
        """Adds the rows of touched buckets that no change is about to the commit's folder."""
        if not set(touched) & self.files(manifest).keys():
            return
        own, keys = self.read(touched, manifest), latest.select(*self.keys)
        stored, changed = own.count(), keys.count()
        kept = meet(own, keys, self.keys, "left_anti", changed, tasks(stored + changed, self.schema))
        rows = self._dealt(kept.select(*self.schema.names), tasks(stored, self.schema)).drop("_share")
        rows.withColumn("_op", F.lit("upsert")).write.mode("append").partitionBy("bucket", "_op").parquet(f"{self.store.path}/{self.name}/{folder}")

    def written(self, folder: str, touched: list[int]) -> list[int]:
        """The touched buckets that have rows in a commit's folder."""
        return [b for b in touched if (fp := _fs(self.store.spark, f"{self.store.path}/{self.name}/{folder}/bucket={b}/_op=upsert"))[0].exists(fp[1])]

    def apply(self, changes: DataFrame, last_id: int | None = None) -> bool:
        return self.store.apply({self.name: changes}, {self.name: last_id} if last_id else None)
