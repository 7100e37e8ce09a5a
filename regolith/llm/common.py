"""Shared folders, materialisation and row packing used by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import io
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters of [\x20\x09-\x0D], which separate words.
SPACE_RE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_local: dict[str, str] = {}
_LOWER_TABLE = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below spark.checkpoint.dir, which driver and executors share.

    Only where the setting is absent and all of Spark is one process (tests, bench) a local temporary folder stands in.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = _local.setdefault("root", "file://" + tempfile.mkdtemp(prefix="regolith-"))
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage is cut and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_blocks(df: DataFrame, label: str, blocks: int) -> DataFrame:
    """Written in one bucket for each hash of b, so that `by_block` need not move the blocks again, only what comes to them."""
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}".replace("-", "_")
    df.write.option("compression", "zstd").option("path", shared_dir(spark, label)).bucketBy(partitions(blocks), "b").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name alone: the files are outside of the catalog's folder
    return out


def forget(table: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    files = table.inputFiles()
    if files:
        spark = table.sparkSession
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def reclaim(spark: SparkSession) -> None:
    """Spark deletes a shuffle's files when the driver has collected what refers to them. Before and between steps that each
    shuffle as much as the input the driver is told to, since otherwise the files of earlier work lie there to the end."""
    spark.sparkContext._jvm.System.gc()


def release() -> None:
    """Give memory that a finished task has freed back to the machine; a Python worker lives on for further tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def lower_ascii(data: bytes) -> bytes:
    """Lower-case A-Z alone."""
    return data.translate(_LOWER_TABLE)


def to_bytes(text: object) -> bytes:
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def by_size(texts: list, most: int = 2_000_000):
    """Runs of texts of about `most` characters (or bytes) together, so that memory doesn't grow with the batch."""
    run: list = []
    size = 0
    for t in texts:
        run.append(t)
        size += len(t) if isinstance(t, (str, bytes)) else 0
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def dump(table: pa.Table, level: int = 6) -> bytes:
    """Compressed well, since blocks are written once and shuffled again; higher levels cost more than they save."""
    out = io.BytesIO()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=level))) as w:
        w.write_table(table.combine_chunks())
    return out.getvalue()


def load(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


#: Bytes from which a plane is compressed by itself.
LONE = 512


def dump_arrays(**arrays: np.ndarray) -> bytes:
    """Arrays of unlike lengths in one compressed block. Integers that never fall are kept as the steps between them. Bytes of
    the same weight lie together and are compressed apart from others, since low ones are noise and high ones mostly alike."""
    head, planes = [], []
    for name, a in arrays.items():
        a = np.ascontiguousarray(a).ravel()
        kept, base = a, ""
        if a.dtype.kind in "iu" and a.size > 1 and (a[1:] >= a[:-1]).all():
            kept, base = np.diff(a.view(f"u{a.itemsize}"), prepend=a[:1].view(f"u{a.itemsize}")), str(a[0])
            kept = kept.astype(np.min_scalar_type(kept.max()))
        head.append(f"{name} {a.dtype.str} {a.size} {kept.dtype.str} {base}")
        planes += list(kept.view(np.uint8).reshape(kept.size, kept.itemsize).T)
    head = "\n".join(head).encode()
    first = len(head).to_bytes(4, "little") + head + b"".join(x.tobytes() for x in planes if x.size < LONE)
    zstd, out = pa.Codec("zstd"), [len(first).to_bytes(8, "little")]
    for part in (first, *[x.tobytes() for x in planes if x.size >= LONE]):
        packed = zstd.compress(part, asbytes=True)
        out += [len(packed).to_bytes(4, "little"), packed]
    return b"".join(out)


def load_arrays(blob: bytes) -> dict[str, np.ndarray]:
    zstd, at = pa.Codec("zstd"), 8

    def part(size: int) -> bytes:
        nonlocal at
        end = at + 4 + int.from_bytes(blob[at : at + 4], "little")
        data = zstd.decompress(blob[at + 4 : end], size, asbytes=True)
        at = end
        return data

    first = part(int.from_bytes(blob[:8], "little"))
    place = 4 + int.from_bytes(first[:4], "little")
    out = {}
    for line in first[4:place].decode().split("\n"):
        name, true, n, kind, base = line.split(" ")
        n, kind = int(n), np.dtype(kind)
        whole = np.empty((n, kind.itemsize), np.uint8)
        for i in range(kind.itemsize):
            if n >= LONE:
                whole[:, i] = np.frombuffer(part(n), np.uint8)
            else:
                whole[:, i] = np.frombuffer(first, np.uint8, n, place)
                place += n
        found = whole.view(kind).ravel() if n else np.zeros(0, kind)
        out[name] = np.cumsum(found, dtype=true) + np.array(int(base), true) if base else found
    return out


def narrow(values: np.ndarray) -> np.ndarray:
    """Integers less their least, in the smallest type that holds them; the least comes with `least_of`."""
    return (values - least_of(values)).astype(np.min_scalar_type(int(values.max()) - int(values.min())) if len(values) else np.uint8)


def least_of(values: np.ndarray) -> np.ndarray:
    return values.min(keepdims=True) if len(values) else np.zeros(1, values.dtype)


def shards_for(packed: DataFrame, least: int = 12) -> int:
    """As many shards as there are blocks, so that a shard's part of the requests fits in memory at any size."""
    return int(max(least, packed.count()))


def partitions(n: int, most: int = 65536) -> int:
    """Tasks for n groups: beyond `most` a task has several, one after the other."""
    return max(1, min(n, most))


def pack(df: DataFrame, columns: list[str], label: str, batch_bytes: int = 6_000_000, fn=None) -> DataFrame:
    """Rows packed into blocks of about batch_bytes of text, written to the shared folder.

    Returns (b, data): b names the block, data is a compressed Arrow table of `columns` (or of what fn makes of it). A
    block is the unit in which the operators ask for counts and get answers, so that what is shuffled is pre-aggregated
    and no row of the corpus is shuffled on a hot key.
    """

    def blocks(batches):
        rows: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            step = max(1, int(batch.num_rows * batch_bytes / max(batch.nbytes, 1)))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                # what the slice itself holds
                rows.append(part)
                size += int(part.nbytes)
                if size >= batch_bytes:
                    yield _block(rows)
                    rows, size = [], 0
        if rows:
            yield _block(rows)
        release()

    def _block(rows):
        table = pa.Table.from_batches(rows)
        table = fn(table) if fn else table
        return pa.RecordBatch.from_pydict({"b": pa.array([uuid.uuid4().int & (2**63 - 1)], pa.int64()), "data": pa.array([dump(table)], pa.binary())})

    # once before the operator's own shuffles, and once after the cleaner has had time for what was found
    reclaim(df.sparkSession)
    out = materialize(df.select(*columns).mapInArrow(blocks, "b long, data binary"), label)
    reclaim(df.sparkSession)
    return out


def ask(packed: DataFrame, fn, shards: int) -> DataFrame:
    """fn(b, table) gives {shard: bytes}; the result has one row (s, b, data) for each."""

    def run(frames):
        for frame in frames:
            for b, data in zip(frame["b"], frame["data"]):
                found = [(s, b, x) for s, x in fn(b, load(data)).items()]
                yield pd.DataFrame(found, columns=["s", "b", "data"])
        release()

    return packed.mapInPandas(run, "s int, b long, data binary")


def answer(requests: DataFrame, fn, shards: int, label: str) -> DataFrame:
    """fn([bytes]) gives an answer for each request of one shard; the answers keep (s, b).

    An answer more is the shard's own summary; it gets b = -1.
    """

    def run(frame):
        order = frame.sort_values("b")
        got = fn(list(order["data"]))
        release()
        return pd.DataFrame({"s": int(order["s"].iloc[0]), "b": [*order["b"], -1][: len(got)], "data": got})

    spread = requests.repartition(partitions(shards), "s")
    out = materialize(spread.groupBy("s").applyInPandas(run, "s int, b long, data binary"), label)
    reclaim(out.sparkSession)
    return out


_KINDS = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}


def columns_of(schema: str, columns: dict) -> pa.Table:
    """A table of the schema; columns that are Arrow data already (such as ids of any type) stay as they are."""
    names = [x.strip().split(" ", 1) for x in schema.split(",")]
    return pa.table({n: c if isinstance(c := columns[n], (pa.Array, pa.ChunkedArray)) else pa.array(c, _KINDS[k]) for n, k in names})


def tell(packed: DataFrame, answers: DataFrame, fn, schema: str, blocks: int, read=load, placed: bool = False) -> DataFrame:
    """fn(b, what `read` makes of the block, {shard: bytes}) for each block gives the columns of `schema`. placed: the
    blocks are in buckets."""

    def run(left, right):
        got = dict(zip(right["s"].to_pylist(), right["data"].to_pylist()))
        return columns_of(schema, fn(left["b"][0].as_py(), read(left["data"][0].as_py()), got))

    return by_block(packed, answers, run, schema, blocks, placed)


def keyed(packed: DataFrame, fn, schema: str) -> DataFrame:
    """Plain rows for Spark to aggregate by key: fn(table) gives the columns of `schema` that follow the block's b."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches):
        for batch in batches:
            for b, data in zip(batch.column("b").to_pylist(), batch.column("data")):
                got = fn(load(data.as_py()))
                for i in range(0, len(got[0]), 100_000):
                    part = [x[i : i + 100_000] for x in got]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), b, np.int64)), *map(pa.array, part)], ["b", *names])
        release()

    return packed.mapInArrow(run, f"b long, {schema}")


def deliver(packed: DataFrame, rows: DataFrame, fn, schema: str, blocks: int) -> DataFrame:
    """fn(table, rows) for each block, with the block's rows as a table, gives the columns of `schema`."""
    return by_block(packed, rows, lambda left, right: columns_of(schema, fn(load(left["data"][0].as_py()), right)), schema, blocks)


def by_block(packed: DataFrame, rows: DataFrame, fn, schema: str, blocks: int, placed: bool = False) -> DataFrame:
    def run(left, right):
        if not left.num_rows:
            raise ValueError("rows for a block that does not exist")
        try:
            return fn(left, right)
        finally:
            release()

    dealt = lambda x: x.repartition(partitions(blocks), "b")
    return (packed if placed else dealt(packed)).groupBy("b").cogroup(dealt(rows).groupBy("b")).applyInArrow(run, schema)


def few(df: DataFrame, rows: int = 300_000) -> DataFrame:
    """Marked for broadcast if a count shows that it has at most so many (narrow) rows; else Spark joins by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def with_share(rows: DataFrame, columns: list[str], label: str) -> DataFrame:
    """A column `share`: 1 / how often the same row occurs, so that repeated rows add up to one."""
    key = F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])
    again = materialize(rows.groupBy(key.alias("row_key")).agg(F.count(F.lit(1)).alias("times")).filter("times > 1"), label)
    if again.isEmpty():
        return rows.withColumn("share", F.lit(1.0))
    return rows.withColumn("row_key", key).join(few(again), "row_key", "left").withColumn("share", 1 / F.coalesce("times", F.lit(1))).drop("row_key", "times")


def rows_with_key(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, row): whole rows in one column, so that none of their names can clash, and what names a document.

    Ids may be null or repeat, so the hash of the text goes with them.
    """
    return documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.struct(*documents.columns).alias("row"))


def lower_col(col):
    return F.translate(col, UPPER, LOWER)
