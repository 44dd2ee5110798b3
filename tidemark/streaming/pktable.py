"""Keyed upsert table on plain Parquet files (no table-format jar needed).

Layout under ``path``::

    schema/                                                   the table's columns, as an empty Parquet file
    log/batch_id=<n>/writer=<w>/bucket=<b>/part-*.parquet     change rows of batch n by writer w
    snapshot/version=<n>/bucket=<b>/part-*.parquet            compacted state as of batch n

* ``write_batch`` writes one micro-batch of one writer; a retried batch
  replaces itself, and writers that share batch numbers do not touch each
  other's files. Every write is aligned to the table's columns; a batch with
  new columns adds them.
* A batch or snapshot counts once Spark's job has committed it (``_SUCCESS``);
  a directory without that marker is ignored.
* ``read`` = newest snapshot <= version and the log batches after it ->
  latest change per key (``apply_changes``); tombstones hide deleted keys, so
  a late stale update cannot resurrect a deleted row. Only the directories of
  the batches after the snapshot are listed and read.
* ``compact(expire=True)`` removes what the snapshot before the new one
  already covers, so time travel reaches back to that snapshot and the files a
  read lists do not grow with the number of batches.
* ``bucket = pmod(xxhash64(key...), n)`` is a partition column: a lookup
  by key reads the buckets of its keys (partition pruning).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType, IntegerType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType)

from tidemark.operators.changes import latest_changes
from tidemark.session import change_file_options, open_files

_PARTS = ("batch_id", "writer", "bucket")
SPREAD_ROWS = 10_000  # rows of a batch a bucket


def _join(path: str, *parts: str) -> str:
    return "/".join([path.rstrip("/"), *parts]) if "://" in path else os.path.join(path, *parts)


class PKTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 4,
                 seq: str = "seq", op: str = "op", bucket_keys: list[str] | None = None,
                 schema: StructType | str | None = None):
        """``bucket_keys`` (default: the key) choose the bucket; a key prefix such
        as ``user_id`` of a (user_id, order_id) key makes the table an index by user.
        ``schema`` declares the columns (op, seq, keys, values); without it they are
        those of the batches written so far, kept with the table. ``buckets`` should
        make a bucket's state a few hundred MB; files within it follow the data."""
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self.seq, self.op = seq, op
        self.bucket_keys = list(bucket_keys or keys)
        self._declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self._schema: StructType | None = None

    # ------------------------------------------------------------ helpers
    def bucket_col(self) -> F.Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.bucket_keys]), F.lit(self.buckets)).cast("int")

    def _fs(self, *sub: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(_join(self.path, *sub))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self, col: str, *sub: str) -> list[str]:
        """Values of the directories ``col=value`` directly under ``sub``."""
        fs, p = self._fs(*sub)
        if not fs.exists(p):
            return []
        names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
        return [n.split("=", 1)[1] for n in names if n.startswith(col + "=")]

    def _committed(self, *sub: str) -> bool:
        fs, p = self._fs(*sub, "_SUCCESS")
        return fs.exists(p)

    def _snapshots(self) -> list[int]:
        return sorted(int(v) for v in self._numbers("version", "snapshot")
                      if self._committed("snapshot", f"version={v}"))

    def _batches(self, after: int = -1, upto: int | None = None) -> list[tuple[int, str]]:
        """(batch, writer) of the committed log batches in (after, upto]."""
        out = []
        for n in sorted(int(v) for v in self._numbers("batch_id", "log")):
            if n > after and (upto is None or n <= upto):
                out += [(n, w) for w in sorted(self._numbers("writer", "log", f"batch_id={n}"))
                        if self._committed("log", f"batch_id={n}", f"writer={w}")]
        return out

    def schema(self) -> StructType | None:
        """The table's columns; None before the first write of an undeclared table."""
        if self._schema is None:
            fs, p = self._fs("schema", "_SUCCESS")
            if fs.exists(p):
                self._schema = self.spark.read.parquet(_join(self.path, "schema")).schema
            elif self._declared is not None:
                self._save_schema(self._declared)
        return self._schema

    def _save_schema(self, schema: StructType) -> None:
        (self.spark.range(0, 0, 1, 1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("overwrite")
         .option("partitionOverwriteMode", "static").parquet(_join(self.path, "schema")))
        self._schema = schema

    def _aligned(self, rows: DataFrame) -> DataFrame:
        known = self.schema()
        if known is None:
            known = StructType([StructField(f.name, f.dataType) for f in rows.schema.fields])
            self._save_schema(known)
        new = [StructField(f.name, f.dataType) for f in rows.schema.fields if f.name not in known.names]
        if new:
            known = StructType(known.fields + new)
            self._save_schema(known)
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                             for f in known.fields])

    # ------------------------------------------------------------- writes
    def write_batch(self, changes: DataFrame, batch_id: int, writer: str = "main", large: bool = False, empty: bool = True) -> None:
        """Write one micro-batch of change rows (op, seq, key..., columns...). Of a ``large`` one every task writes its
        own file of each bucket: its rows are not dealt by bucket first. Without ``empty``, one without rows leaves no
        log batch: its write has no bucket."""
        sub = "log", f"batch_id={int(batch_id)}", f"writer={writer}"
        self._write(self._aligned(changes), *sub, large=large)
        if not empty and not self._numbers("bucket", *sub):
            fs, p = self._fs(*sub)
            fs.delete(p, True)

    def _write(self, rows: DataFrame, *sub: str, large: bool = False) -> None:
        rows = rows.withColumn("bucket", self.bucket_col())
        if not large:  # rebalanced by bucket: AQE splits a large bucket over several writers and joins small ones
            rows = rows.hint("rebalance", "bucket")
        with open_files(rows.sparkSession):
            (rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket")
             .options(**change_file_options(rows)).parquet(_join(self.path, *sub)))

    def compact(self, version: int | None = None, expire: bool = False, drop_tombstones: bool = False) -> int | None:
        """Rewrite the state as of ``version`` (default: newest batch) as one
        snapshot; later reads start from it. ``expire`` removes the log batches and
        snapshots that the snapshot before it covers. ``drop_tombstones`` forgets
        deleted keys: for tables whose late changes cannot be older than a snapshot."""
        batches = self._batches()
        if not batches and version is None:
            return None
        v = batches[-1][0] if version is None else version
        self._write(self._latest(v, keep_tombstones=not drop_tombstones), "snapshot", f"version={v}")
        if expire:
            earlier = [s for s in self._snapshots() if s < v]
            if earlier:
                self._drop("snapshot", "version", [s for s in earlier[:-1]])
                self._drop("log", "batch_id", [int(n) for n in self._numbers("batch_id", "log")
                                               if int(n) <= earlier[-1]])
        return v

    def _drop(self, sub: str, col: str, numbers: list[int]) -> None:
        for n in numbers:
            fs, p = self._fs(sub, f"{col}={n}")
            fs.delete(p, True)

    # -------------------------------------------------------------- reads
    def log(self, after: int = -1, upto: int | None = None) -> DataFrame | None:
        """Change rows of the committed batches in (after, upto] with batch_id, writer
        and bucket; None where there are none."""
        dirs = [_join(self.path, "log", f"batch_id={n}", f"writer={w}") for n, w in self._batches(after, upto)]
        if not dirs:
            return None
        schema = StructType(self.schema().fields + [
            StructField("batch_id", LongType()), StructField("writer", StringType()), StructField("bucket", IntegerType())])
        return self.spark.read.schema(schema).option("basePath", _join(self.path, "log")).parquet(*dirs)

    def _restrict(self, df: DataFrame, only: DataFrame | None, whole_buckets: bool = False) -> DataFrame:
        """Rows whose bucket-key values occur in ``only`` (NULL equals NULL): a semi join
        on the bucket partition column (the bucket set is at most ``buckets`` rows and
        is broadcast, so dynamic partition pruning skips the other buckets), then,
        but for ``whole_buckets``, on the bucket keys themselves."""
        if only is None:
            return df
        types = {f.name: f.dataType for f in self.schema().fields}
        keys = only.select(*[F.col(k).cast(types[k]).alias(k) for k in self.bucket_keys])
        bset = F.broadcast(keys.select(self.bucket_col().alias("bucket")).distinct())
        df = df.join(bset, "bucket", "left_semi")
        if whole_buckets:
            return df
        keys = keys.distinct().withColumnsRenamed({k: f"_k_{k}" for k in self.bucket_keys})
        return df.join(keys, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in self.bucket_keys], "left_semi")

    def restrict(self, rows: DataFrame, only: DataFrame | None) -> DataFrame:
        """Rows of the buckets that ``only`` touches; all without it."""
        return self._restrict(rows, only, whole_buckets=True)

    def stored(self, version: int | None) -> tuple[DataFrame | None, DataFrame | None]:
        """The newest snapshot up to batch ``version`` and the log rows after it, with bucket; None where there are none."""
        snaps = [s for s in self._snapshots() if version is None or s <= version]
        snap, start = None, -1
        if snaps:
            start = snaps[-1]
            schema = StructType(self.schema().fields + [StructField("bucket", IntegerType())])
            snap = self.spark.read.schema(schema).parquet(_join(self.path, "snapshot", f"version={start}"))
        return snap, self.log(start, version)

    def changes_upto(self, version: int | None, only: DataFrame | None = None,
                     whole_buckets: bool = False) -> DataFrame | None:
        """Snapshot and log rows up to batch ``version``, several of a key; None before the first write."""
        parts = [self._restrict(p, only, whole_buckets).drop(*_PARTS) for p in self.stored(version) if p is not None]
        if not parts:
            return None
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def changes_with(self, batch_id: int) -> DataFrame:
        """Snapshot and log rows up to the written batch ``batch_id``, of the buckets that it wrote; ``_new`` marks its own.
        Of the others those are left out whose key has a time outside the times of the batch's keys."""
        wrote = {int(v) for n, w in self._batches(batch_id - 1, batch_id)
                 for v in self._numbers("bucket", "log", f"batch_id={n}", f"writer={w}")}
        old, new = [p for p in self.stored(batch_id - 1) if p is not None], self.log(batch_id - 1, batch_id)
        near = F.col("bucket").isin(*sorted(wrote))
        if old:
            near = near & self._between(new)
        parts = [p.where(near).drop(*_PARTS).withColumn("_new", F.lit(False)) for p in old]
        out = new.drop(*_PARTS).withColumn("_new", F.lit(True))
        for p in parts:
            out = out.unionByName(p)
        return out

    def _between(self, rows: DataFrame) -> F.Column:
        """Holds for every row with a key of ``rows``: its times are null or within the least and greatest ones there."""
        times = {f.name: f.dataType for f in self.schema().fields
                 if f.name in self.keys and isinstance(f.dataType, (DateType, TimestampType, TimestampNTZType))}
        held = F.lit(True)
        if times:  # as text: a literal of each type
            ends = rows.agg(*[f(c).cast("string").alias(f"{f.__name__}_{c}") for c in times for f in (F.min, F.max)]).first()
            for c, t in times.items():
                least, most = (F.lit(ends[f"{f}_{c}"]).cast(t) for f in ("min", "max"))
                held = held & (F.col(c).isNull() | F.col(c).between(least, most))
        return held

    def is_stored(self, version: int) -> bool:
        """Whether there is a snapshot or a log batch up to batch ``version``."""
        return any(s <= version for s in self._snapshots()) or bool(self._batches(upto=version))

    def is_spread(self, batch_id: int) -> bool:
        """Whether the written batch is so large that what follows from it is taken to touch every bucket: to find out
        which would cost more than the buckets it saves."""
        return self.log(batch_id - 1, batch_id).count() >= SPREAD_ROWS * self.buckets

    def is_large(self, batch: DataFrame) -> bool:
        """Whether so many rows touch every bucket, with enough rows for a file of each bucket and task. No more rows of a
        micro-batch are read than decide it: its count would read all of them with all columns."""
        most = SPREAD_ROWS * self.buckets
        return most <= 0 or batch.limit(most).count() >= most

    def _latest(self, version: int | None, keep_tombstones: bool = False,
                only: DataFrame | None = None) -> DataFrame:
        ch = self.changes_upto(version, only)
        if ch is None:
            raise FileNotFoundError(self.path)
        w = latest_changes(ch, self.keys, self.seq, self.op)
        return w if keep_tombstones else w.where(F.col(self.op) != "d")

    def read(self) -> DataFrame:
        """Current state (deleted keys removed)."""
        return self._latest(None)

    def as_of(self, version: int, only: DataFrame | None = None) -> DataFrame:
        """State after batch ``version`` - time travel over the change log.
        ``only``: restrict to the rows whose bucket keys occur in that frame."""
        return self._latest(version, only=only)

    def latest_in(self, version: int, only: DataFrame) -> DataFrame:
        """All rows of the buckets that ``only`` touches, as of batch ``version``."""
        ch = self.changes_upto(version, only, whole_buckets=True)
        if ch is None:
            raise FileNotFoundError(self.path)
        return latest_changes(ch, self.keys, self.seq, self.op).where(F.col(self.op) != "d")

    def lookup(self, key_values: list | DataFrame) -> DataFrame:
        """Current rows of the given keys (values, tuples for a composite key, or a frame
        with the key columns): reads only the buckets of those keys."""
        if not isinstance(key_values, DataFrame):
            schema = self.schema()
            if schema is None:
                raise FileNotFoundError(self.path)
            rows = [v if isinstance(v, (tuple, list)) else (v,) for v in key_values]
            key_values = self.spark.createDataFrame(rows, StructType([schema[k] for k in self.keys]))
        types = {f.name: f.dataType for f in self.schema().fields}
        keys = key_values.select(*[F.col(k).cast(types[k]).alias(k) for k in self.keys]).distinct()
        return self._latest(None, only=keys).join(keys, self.keys, "left_semi")
