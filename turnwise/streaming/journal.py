"""Streams over append-only run journals: latest row per key, progress, accepted-once, conversation state, rates.

Every stream keeps its progress beside its output (`progress_folder`), so a lost executor or a restart with the same
output folder resumes where the last committed batch ended.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions import text as tx

JOURNAL = "position bigint, sample_id string, system string, latency double, error string, pred_answer string, incomplete_build boolean, tokens int"


def read_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A journal folder as a stream; `files_per_batch` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def progress_folder(path: str) -> str:
    """Where the stream that writes to `path` keeps its progress; readers of `path` pass over it."""
    return f"{path.rstrip('/')}/_progress"


def start(src: DataFrame, path: str, step: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Run all batches that are new since the last start with this `path` through step(batch, number)."""
    return src.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", progress_folder(path)).trigger(availableNow=True).start()


def versioned(spark: SparkSession, path: str, schema: StructType, part: str) -> DataFrame:
    """The rows of the last batch folder `part`=n under `path`; none were written before the first batch."""
    rows = spark.read.schema(StructType([*schema.fields, StructField(part, IntegerType())])).parquet(path)
    return rows.join(F.broadcast(rows.agg(F.max(part).alias(part))), part, "left_semi").drop(part)


def drain(query: StreamingQuery) -> None:
    """Wait for an availableNow run to finish, raising what stopped it."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def latest(src: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """Running latest row per key: max_by keeps one row per key as state (update or complete mode)."""
    body = F.struct(*[c for c in src.columns if c not in keys])
    return src.groupBy(*keys).agg(F.max_by(body, position).alias("r")).select(*keys, "r.*")


#: Buckets of a latest-row table, and batches that may have added to a bucket before it is compacted.
BUCKETS, DELTAS = 64, 4
_MANIFEST = "bucket int, base int, since int, deltas int"


class LatestTable:
    """Latest row per key as a log: each batch appends its own latest rows, cut into buckets by key.

    `delta/lt_batch=n/lt_bucket=b` holds batch n's rows, `base/lt_base=n/lt_bucket=b` a bucket as compacted after batch n, and
    `manifest/lt=n` says per bucket which base counts and from which batch on its deltas do. A bucket is compacted once
    `DELTAS` batches have touched it, so a batch writes its own rows and, over time, each bucket once per `DELTAS` batches
    that touch it. A batch that is retried writes the same folders again. Files that the manifest before the last does
    not name are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], position: str, buckets: int = BUCKETS):
        self.spark, self.path, self.schema, self.keys, self.position, self.buckets = spark, path.rstrip("/"), schema, list(keys), position, buckets

    def _fs(self, name: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _numbers(self, name: str) -> list[int]:
        """The n of the folders `…=n` under `name`."""
        fs, at = self._fs(name)
        return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if "=" in f.getPath().getName()) if fs.exists(at) else []

    def manifest(self, before: int | None = None) -> DataFrame:
        """One row per bucket ever touched, of the last version (below `before`); at most `buckets` rows."""
        found = [n for n in self._numbers("manifest") if before is None or n < before]
        if not found:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest/lt={found[-1]}")

    def rows(self, manifest: DataFrame, last: int | None = None) -> DataFrame:
        """Base rows and later deltas of the buckets in `manifest` (bucket, base, since), with their bucket."""
        from pyspark.sql.types import StructType as S
        part = lambda name: S([*self.schema.fields, StructField(name, IntegerType()), StructField("lt_bucket", IntegerType())])
        cols = [*self.schema.names, "lt_bucket"]
        m = F.broadcast(manifest.select(F.col("bucket").alias("lt_bucket"), F.col("base").alias("lt_base"), F.col("since").alias("lt_since")))
        out = self.spark.createDataFrame([], S([*self.schema.fields, StructField("lt_bucket", IntegerType())]))
        if self._numbers("delta"):
            d = self.spark.read.schema(part("lt_batch")).parquet(f"{self.path}/delta")
            d = d if last is None else d.where(F.col("lt_batch") <= last)
            out = out.unionByName(d.join(m.drop("lt_base"), "lt_bucket").where("lt_batch >= lt_since").select(*cols))
        if self._numbers("base"):
            b = self.spark.read.schema(part("lt_base")).parquet(f"{self.path}/base")
            out = out.unionByName(b.join(m.drop("lt_since"), ["lt_bucket", "lt_base"]).select(*cols))
        return out

    def merge(self, batch: DataFrame, n: int) -> None:
        from ..operators.rowset import latest_wins
        own = latest_wins(batch.select(*self.schema.names), self.keys, self.position).select(*self.schema.names)
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("lt_bucket")
        own.select("*", bucket).write.mode("overwrite").partitionBy("lt_bucket").parquet(f"{self.path}/delta/lt_batch={n}")
        before = self.manifest(n).collect()
        fs, at = self._fs(f"delta/lt_batch={n}")
        touched = {int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(at) if f.getPath().getName().startswith("lt_bucket=")}
        state = {r["bucket"]: (r["base"], r["since"], r["deltas"]) for r in before}
        for b in touched:
            base, since, deltas = state.get(b, (-1, n, 0))
            state[b] = (base, since, deltas + 1)
        full = {b: v for b, v in state.items() if v[2] > DELTAS}
        if full:
            old = self.spark.createDataFrame([(b, v[0], v[1]) for b, v in full.items()], "bucket int, base int, since int")
            whole = self.rows(old, n)
            latest_wins(whole, self.keys, self.position).select(*self.schema.names, bucket).write.mode("overwrite").partitionBy("lt_bucket").parquet(f"{self.path}/base/lt_base={n}")
            state |= {b: (n, n + 1, 0) for b in full}
        self.spark.createDataFrame([(b, *v) for b, v in state.items()], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/lt={n}")
        self._sweep(before, n)

    def _sweep(self, kept: list, n: int) -> None:
        """Delete what neither the manifest of batch n nor the one before it names."""
        live = {(r["bucket"], r["base"]) for r in [*kept, *self.manifest().collect()]}
        since = {}
        for r in [*kept, *self.manifest().collect()]:
            since[r["bucket"]] = min(since.get(r["bucket"], n), r["since"])
        for name, dead in (("base", lambda v, b: (b, v) not in live), ("delta", lambda v, b: v < since.get(b, 0))):
            for v in self._numbers(name):
                fs, at = self._fs(f"{name}/{'lt_base' if name == 'base' else 'lt_batch'}={v}")
                if v == n:
                    continue
                for f in fs.listStatus(at):
                    b = f.getPath().getName()
                    if b.startswith("lt_bucket=") and dead(v, int(b.split("=")[1])):
                        fs.delete(f.getPath(), True)
        for v in self._numbers("manifest")[:-2]:
            fs, at = self._fs(f"manifest/lt={v}")
            fs.delete(at, True)

    def read(self) -> DataFrame:
        """The latest row per key."""
        from ..operators.rowset import latest_wins
        return latest_wins(self.rows(self.manifest()).drop("lt_bucket"), self.keys, self.position).select(*self.schema.names)


def upsert_latest(src: DataFrame, keys: Sequence[str], position: str, path: str) -> StreamingQuery:
    """Latest row per key kept in a `LatestTable` under `path`; batch numbers go on over restarts."""
    table = LatestTable(src.sparkSession, path, src.schema, keys, position)
    return start(src, path, table.merge)


def progress(src: DataFrame) -> DataFrame:
    """Running counts by status; partial sums combine on the map side, so few statuses are no hot spot."""
    status = F.when(tx.strip(tx.text_of("error")) != "", "failed").when(tx.strip(tx.text_of("pred_answer")) == "", "blank").otherwise("done")
    return src.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def accept_once(src: DataFrame, keys: Sequence[str], ts: str | None = None, delay: str | None = None) -> DataFrame:
    """One accepted row per key across batches and restarts.

    The state holds every key ever accepted. Only a caller who knows that keys do not come back later than `delay` after
    their time `ts` may give both, to let the state forget them.
    """
    if delay is None:
        return src.dropDuplicates(list(keys))
    return src.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


class CurrentFacts(StatefulProcessor):
    """Value state per (conversation, subject, relation): the last fact and its value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "position bigint, assertion_id string, value string")

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        held = self.last.get()
        told = lambda fact, status, by: Row(conversation_id=key[0], subject=key[1], relation=key[2], assertion_id=fact, status=status, superseded_by=by)
        for position, assertion_id, value in sorted(((r.position, r.assertion_id, r.value) for r in rows), key=lambda r: r[0]):
            if held is not None and held[2] != value:
                yield told(held[1], "SUPERSEDED", assertion_id)
            held = (position, assertion_id, value)
        self.last.update(held)
        yield told(held[1], "CURRENT", None)

    def close(self) -> None:
        pass


STATE_OUT = "conversation_id string, subject string, relation string, assertion_id string, status string, superseded_by string"


def supersede_stream(src: DataFrame) -> DataFrame:
    """Each new fact updates CURRENT / SUPERSEDED of its key. State is per (conversation, subject, relation), so a
    large conversation spreads over its keys.

    src: conversation_id, subject, relation, position, assertion_id, value; batches arrive in position order.
    """
    keyed = src.groupBy("conversation_id", "subject", "relation")
    return keyed.transformWithState(CurrentFacts(), STATE_OUT, "Append", "None")


def supersede_table(src: DataFrame, path: str) -> StreamingQuery:
    """`supersede_stream` into batch folders under `path`; a retried batch rewrites its own folder."""
    spark = src.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return start(supersede_stream(src), path, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"))
    finally:
        spark.conf.set(name, was)


def current_facts(spark: SparkSession, path: str) -> DataFrame:
    """The value state of `supersede_table` as the state store holds it: conversation_id, subject, relation, position, assertion_id, value."""
    state = spark.read.format("statestore").option("stateVarName", "last").load(progress_folder(path))
    key = [F.col(f"key.{c}").alias(c) for c in ("conversation_id", "subject", "relation")]
    return state.select(*key, *[F.col(f"value.{c}").alias(c) for c in ("position", "assertion_id", "value")])


def windowed_rates(src: DataFrame, width: str = "1 hour", delay: str | None = None) -> DataFrame:
    """Error rate and mean latency by event-time window and system. src: ts, system, latency, error

    Late rows count unless `delay` says how late a row may be; a stream with a delay forgets closed windows.
    """
    rows = src.withWatermark("ts", delay) if delay is not None else src
    return rows.groupBy(F.window("ts", width).alias("w"), "system").agg(
        F.count(F.lit(1)).alias("n"), F.avg((tx.strip(tx.text_of("error")) != "").cast("double")).alias("error_rate"), F.avg("latency").alias("avg_latency")).select(
        F.col("w.start").alias("start"), "system", "n", "error_rate", "avg_latency")


#: What adds up over batches: rows, errors, latencies that are given and their sum.
_SUMS = "start timestamp, end timestamp, system string, n bigint, errors bigint, n_latency bigint, latency double"


def _added(rows: DataFrame) -> DataFrame:
    return rows.groupBy("start", "end", "system").agg(*[F.sum(c).alias(c) for c in ("n", "errors", "n_latency", "latency")]).select("start", "end", "system", "n", "errors", "n_latency", "latency")


class RatesTable:
    """Rates by event-time window as tables under `path`: windows close `delay` behind the latest row, late rows correct them.

    `closed/lt=n` has the windows that batch n closed, `late/lt=n` the sums of its rows whose window was closed before, and
    `open/lt=n` what is still open: all state there is, bounded by the windows inside the delay. Sums of both tables and the
    open rows together are exact whatever came late. A batch that is retried writes its own folders again.
    """

    def __init__(self, spark: SparkSession, path: str, width: str = "1 hour", delay: str = "2 hours"):
        self.spark, self.path, self.width, self.delay = spark, path.rstrip("/"), width, delay

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SUMS).parquet(f"{self.path}/{name}").select("start", "end", "system", "n", "errors", "n_latency", "latency")

    def step(self, batch: DataFrame, n: int) -> None:
        told = batch.select(F.window("ts", self.width).alias("w"), "ts", "system", "latency", (tx.strip(tx.text_of("error")) != "").cast("bigint").alias("e")).groupBy("w", "system").agg(
            F.count(F.lit(1)).alias("n"), F.sum("e").alias("errors"), F.count("latency").alias("n_latency"), F.coalesce(F.sum("latency"), F.lit(0.0)).alias("latency"), F.max("ts").alias("ts"))
        told.select("w.start", "w.end", "system", "n", "errors", "n_latency", "latency", "ts").write.mode("overwrite").parquet(f"{self.path}/sums/lt={n}")
        sums = self.spark.read.schema(_SUMS + ", ts timestamp").parquet(f"{self.path}/sums/lt={n}")
        before = self.spark.read.schema("ts timestamp").parquet(f"{self.path}/mark/lt={n - 1}") if n else self.spark.createDataFrame([], "ts timestamp")
        mark = before.unionByName(sums.select("ts")).agg(F.max("ts").alias("ts"))
        mark.write.mode("overwrite").parquet(f"{self.path}/mark/lt={n}")
        # One row each.
        limit = lambda df: df.agg((F.max("ts") - F.expr(f"INTERVAL {self.delay}")).alias("x")).first()["x"]
        was, now = limit(before), limit(self.spark.read.schema("ts timestamp").parquet(f"{self.path}/mark/lt={n}"))
        gone = F.col("end") <= F.lit(was) if was is not None else F.lit(False)
        own = sums.drop("ts")
        own.where(gone).write.mode("overwrite").parquet(f"{self.path}/late/lt={n}")
        live = own.where(~gone)
        live = _added(live.unionByName(self._read(f"open/lt={n - 1}")) if n else live)
        shut = F.col("end") <= F.lit(now) if now is not None else F.lit(False)
        live.where(shut).write.mode("overwrite").parquet(f"{self.path}/closed/lt={n}")
        live.where(~shut).write.mode("overwrite").parquet(f"{self.path}/open/lt={n}")
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        for name in ("sums", "mark", "open"):
            at = hadoop.Path(f"{self.path}/{name}/lt={n - 2}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def run(self, src: DataFrame) -> StreamingQuery:
        """src: ts, system, latency, error"""
        return start(src, self.path, self.step)

    def open_windows(self) -> DataFrame:
        return versioned(self.spark, f"{self.path}/open", self.spark.createDataFrame([], _SUMS).schema, "lt")

    def rates(self) -> DataFrame:
        """start, system, n, error_rate, avg_latency and whether the window is closed."""
        rows = self._read("closed").withColumn("shut", F.lit(True)).unionByName(self._read("late").withColumn("shut", F.lit(True))).unionByName(self.open_windows().withColumn("shut", F.lit(False)))
        each = rows.groupBy("start", "system").agg(*[F.sum(c).alias(c) for c in ("n", "errors", "n_latency", "latency")], F.min("shut").alias("closed"))
        return each.select("start", "system", "n", (F.col("errors") / F.col("n")).alias("error_rate"), F.try_divide("latency", "n_latency").alias("avg_latency"), "closed")
