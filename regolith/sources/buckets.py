"""Tables in hash buckets under one manifest: a version appears at once, and a write leaves other buckets' files alone.

The manifest names, for each table, its schema, its key and the folder of each bucket; a new version of it is written aside
and takes its number by one rename that fails where the number is taken. Files that a manifest names are never changed, so
readers of a version are not disturbed and a writer that dies leaves nothing but files that no manifest names. A manifest
grows with the buckets, which are a fixed number, not with the rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: The columns that `Change.place` adds.
PLACE = ("bucket", "part")


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._java = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _path(self, name: str):
        return self._java.Path(f"{self.root}/{name}")

    def _listed(self, name: str) -> list[str]:
        path = self._path(name)
        fs = path.getFileSystem(self._conf)
        return [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._listed("manifests") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A version's manifest, the newest by default; an empty one where there is none."""
        known = self.versions() if version is None else [version]
        if not known:
            return {"version": 0, "tables": {}, "done": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{known[-1]:012d}.json", wholetext=True).first()[0])

    def _publish(self, manifest: dict) -> None:
        aside, name = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{manifest['version']:012d}.json")
        fs = aside.getFileSystem(self._conf)
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(self._java.Options.Rename, 0)
        try:
            self._java.FileContext.getFileContext(name.toUri(), self._conf).rename(aside, name, options)
        except Py4JJavaError as e:
            fs.delete(aside, False)
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise Conflict(f"version {manifest['version']} of {self.root} is there already") from e
            raise

    def vacuum(self, keep: int = 2) -> int:
        """Delete the files that none of the last `keep` versions names; returns how many folders went. Not while writers run."""
        known = self.versions()
        old, kept = (known[:-keep], known[-keep:]) if keep else (known, [])
        used = {folder for v in kept for t in self.manifest(v)["tables"].values() for folder in t["folders"].values()}
        gone = 0
        for name in self._listed("files"):
            inside = {f"files/{name}/{b}" for b in self._listed(f"files/{name}")}
            for folder in inside - used:
                self._path(folder).getFileSystem(self._conf).delete(self._path(folder), True)
                gone += folder.rpartition("/")[2].startswith("bucket=")
        for v in old:
            path = self._path(f"manifests/{v:012d}.json")
            path.getFileSystem(self._conf).delete(path, False)
        return gone

    def begin(self) -> Change:
        return Change(self, self.manifest())

    def read(self, table: str, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """A table's rows, or those of some of its buckets; only their files are read."""
        known = (manifest or self.manifest())["tables"][table]
        wanted = known["folders"] if buckets is None else {str(b): known["folders"][str(b)] for b in buckets if str(b) in known["folders"]}
        schema = StructType.fromJson(known["schema"])
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{folder}" for folder in wanted.values()])


class Change:
    """What is to become the next version: all of its tables appear together, or none does."""

    def __init__(self, store: Store, before: dict):
        self.store, self.before = store, before
        self.next = json.loads(json.dumps(before)) | {"version": before["version"] + 1}

    def has(self, table: str) -> bool:
        return table in self.next["tables"]

    def create(self, table: str, schema: StructType, key: str, buckets: int) -> None:
        """A table without rows, unless it is there."""
        if not self.has(table):
            self.next["tables"][table] = {"schema": json.loads(schema.json()), "key": key, "buckets": buckets, "folders": {}}

    def bucket(self, table: str, key: Column | None = None) -> Column:
        known = self.next["tables"][table]
        return F.pmod(F.xxhash64(F.col(known["key"]) if key is None else key), F.lit(known["buckets"])).cast("int")

    def touched(self, table: str, rows: DataFrame) -> list[int]:
        """The buckets of the rows' keys: as many as the table has at most."""
        return sorted(r[0] for r in rows.select(self.bucket(table).alias("b")).distinct().collect())

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """The table as it will be: what this change has replaced so far is seen."""
        return self.store.read(table, buckets, self.next)

    def holds(self, table: str, buckets: Iterable[int]) -> bool:
        """Whether there is anything in these buckets."""
        return any(str(b) in self.next["tables"][table]["folders"] for b in buckets)

    def place(self, table: str, rows: DataFrame, *keys: str) -> DataFrame:
        """`rows` moved to where they are written from, with columns `bucket` and `part`: rows of equal `keys` (the table's
        among them) come together, so what groups by PLACE and keys, and then replaces buckets, moves nothing again. A large
        bucket has several parts."""
        parts = -(-2 * int(self.store.spark.conf.get("spark.sql.shuffle.partitions")) // self.next["tables"][table]["buckets"])
        return rows.withColumns({"bucket": self.bucket(table), "part": F.pmod(F.hash(*keys), F.lit(parts))}).repartition(*PLACE)

    def replace(self, table: str, rows: DataFrame, buckets: Iterable[int]) -> None:
        """`rows` are all that the buckets hold from now on; those that have a bucket were placed. A large bucket is written by
        several tasks."""
        known = self.next["tables"][table]
        names = StructType.fromJson(known["schema"]).fieldNames()
        folder = f"files/{table}-{uuid.uuid4().hex}"
        placed = rows.select(*names, "bucket") if "bucket" in rows.columns else rows.select(*names, self.bucket(table).alias("bucket")).hint("rebalance", "bucket")
        placed.write.partitionBy("bucket").parquet(f"{self.store.root}/{folder}")
        written = {n.removeprefix("bucket=") for n in self.store._listed(folder) if n.startswith("bucket=")}
        if not written <= {str(b) for b in buckets}:
            raise ValueError(f"rows of {table} lie in other buckets than those to replace")
        for b in map(str, buckets):
            known["folders"].pop(b, None)
        known["folders"] |= {b: f"{folder}/bucket={b}" for b in written}

    def put(self, table: str, rows: DataFrame) -> None:
        """A whole table, without buckets, in place of what it was."""
        folder = f"files/{table}-{uuid.uuid4().hex}/bucket=all"
        rows.write.parquet(f"{self.store.root}/{folder}")
        self.next["tables"][table] = {"schema": json.loads(rows.schema.json()), "key": None, "buckets": 0, "folders": {"all": folder}}

    def done(self, token: tuple[str, int] | None) -> bool:
        """Whether a batch (of a name and number) is in a version already."""
        if token is None:
            return False
        d = self.before["done"].get(token[0], {"upto": -1, "beyond": []})
        return token[1] <= d["upto"] or token[1] in d["beyond"]

    def commit(self, token: tuple[str, int] | None = None) -> int:
        if token is not None:
            d = self.next["done"].setdefault(token[0], {"upto": -1, "beyond": []})
            later = {*d["beyond"], token[1]}
            while d["upto"] + 1 in later:  # numbers that came in a row are one number
                d["upto"] += 1
                later.discard(d["upto"])
            d["beyond"] = sorted(later)
        self.store._publish(self.next)
        return self.next["version"]


def newest(rows: DataFrame, key: str, version: str = "version") -> DataFrame:
    """One row a key, of the greatest version; of equal versions the one with the greater hash, wherever it came from."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(whole, F.struct(version, F.xxhash64(F.to_json(whole)))).alias("_row")).select("_row.*")


def merge(store: Store, table: str, rows: DataFrame, key: str, version: str = "version", token: tuple[str, int] | None = None, buckets: int = 32) -> bool:
    """Upsert by key: rows of a greater version replace those that are held, whatever order they come in.

    Deletions are rows as well, with a column `deleted` that readers look at, since an older row may arrive after them. A
    batch whose token is in a version already changes nothing; so does one without a newer row. Returns whether there is a
    new version.
    """
    change = store.begin()
    if change.done(token):
        return False
    change.create(table, rows.schema, key, buckets)
    where = change.touched(table, rows)
    held = change.read(table, where)
    change.replace(table, newest(held.unionByName(rows.select(*held.columns)), key, version), where)
    change.commit(token)
    return True


def merge_each(store: Store, table: str, key: str, name: str, version: str = "version", prepare: Callable[[DataFrame], DataFrame] | None = None, buckets: int = 32) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: merges each batch under its number, so a batch that comes again after a failure is seen to be done."""

    def work(batch: DataFrame, number: int) -> None:
        merge(store, table, prepare(batch) if prepare else batch, key, version, (name, number), buckets)

    return work
