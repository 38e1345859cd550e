"""Bounded ingest, running state and resume with Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from .paged import PagedSource, run_paged


def _parted(sink: str, good: str) -> Callable[[DataFrame, int], None]:
    """Writes a batch's rows to sink, those for which `good` fails to <sink>-rejected."""

    def put(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("_good", F.coalesce(F.expr(good), F.lit(False))).persist()
        for folder, keep in ((sink, F.col("_good")), (f"{sink}-rejected", ~F.col("_good"))):
            marked.where(keep).drop("_good").write.mode("overwrite").parquet(f"{folder}/batch={number}")
        marked.unpersist()

    return put


class Progress(StreamingQueryListener):
    """ST1: says how far streams are, each time another `every` rows have come in. Rows count once per process, also those of a
    batch that runs again; what is in the sink is told by ingest_counts."""

    def __init__(self, every: int = 1000, say: Callable[[str], object] = print):
        self.every, self.say, self.rows = every, say, {}

    def onQueryStarted(self, event) -> None:
        self.rows[str(event.id)] = 0

    def onQueryProgress(self, event) -> None:
        p = event.progress
        before = self.rows.get(str(p.id), 0)
        now = self.rows[str(p.id)] = before + p.numInputRows
        if now // self.every > before // self.every:
            self.say(f"{p.name or p.id}: batch {p.batchId}, {now} rows, {p.processedRowsPerSecond or 0:.0f} a second")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.say(f"{event.id}: stopped by {event.exception.splitlines()[0]}")


def ingest(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, good: str, files_per_trigger: int = 1000) -> None:
    """ST1 and IO11: all files there are, in bounded micro-batches; rows for which `good` fails go to <sink>-rejected.

    A batch overwrites its own folder, so one that runs twice leaves its rows once."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    stream.writeStream.foreachBatch(_parted(sink, good)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_counts(spark: SparkSession, sink: str) -> DataFrame:
    """ST1: rows taken and rejected so far, by what the sink's folders hold."""
    one = lambda folder, name: spark.read.parquet(folder).agg(F.count("*").alias(name))
    return one(sink, "taken").join(one(f"{sink}-rejected", "rejected"))


def batch_counts(spark: SparkSession, sink: str) -> DataFrame:
    """ST1: (batch, taken, rejected, total) of each batch of a bounded ingest; total is what is taken up to and with it."""
    return spark.read.schema("taken long, rejected long, total long, batch long").parquet(f"{sink}-counts")


def _total_before(spark: SparkSession, sink: str, number: int) -> int:
    """The rows taken by the batches before one. Each batch notes its total last, so the one before has done so."""
    if not number:
        return 0
    return spark.read.schema("taken long, rejected long, total long").parquet(f"{sink}-counts/batch={number - 1}").first()["total"]


def taken_so_far(spark: SparkSession, sink: str) -> int:
    try:
        return batch_counts(spark, sink).agg(F.max("total")).first()[0] or 0
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def _bounded(sink: str, good: str, order: list[str], limit: int) -> Callable[[DataFrame, int], None]:
    """Writes a batch's good rows to sink, up to what `limit` leaves room for, in the order of columns, and bad ones to <sink>-rejected.

    What there is room for comes from the batches before alone, and a batch overwrites its own folders: one that runs again
    takes as many rows as at first. Its counts are noted last. A batch without room
    raises LimitReached before it reads a row."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _total_before(spark, sink, number)
        if before >= limit:
            raise LimitReached(f"{before} rows are taken")
        marked = batch.withColumn("_good", F.coalesce(F.expr(good), F.lit(False))).persist()
        n = marked.agg(F.count_if("_good").alias("good"), F.count_if(~F.col("_good")).alias("bad")).first()
        good_rows, room = marked.where("_good"), limit - before
        if n["good"] > room:  # once: the batch is the last one
            good_rows = good_rows.orderBy(*order).limit(room)
        good_rows.drop("_good").write.mode("overwrite").parquet(f"{sink}/batch={number}")
        marked.where("not _good").drop("_good").write.mode("overwrite").parquet(f"{sink}-rejected/batch={number}")
        marked.unpersist()
        taken, rejected = min(n["good"], room), n["bad"]
        note = spark.createDataFrame([(taken, rejected, before + taken)], "taken long, rejected long, total long")
        note.coalesce(1).write.mode("overwrite").parquet(f"{sink}-counts/batch={number}")

    return put


class LimitReached(Exception):
    """Ends a stream whose limit is reached; the batch that finds no room stays undone, for a run with a higher limit."""


def _until_limit(run: Callable[[], object], spark: SparkSession, sink: str, limit: int) -> int:
    """The rows taken by all runs so far; a run at its limit isn't begun, and LimitReached ends one."""
    if (total := taken_so_far(spark, sink)) >= limit:
        return total
    try:
        run()
    except StreamingQueryException as e:
        if "LimitReached" not in str(e):
            raise
    return taken_so_far(spark, sink)


def ingest_up_to(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, good: str, order: str, limit: int, files_per_trigger: int = 1) -> int:
    """ST1, IO14: like ingest, but stops once `limit` good rows are taken; the batch that passes it is cut in the order of a column.
    Returns the rows taken by all runs with this sink and checkpoint, which belong together; once the limit is reached a run
    reads nothing. A batch that runs again after a crash takes what it took at first. A run with a higher limit goes on behind
    the batch that was cut."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    writer = stream.writeStream.foreachBatch(_bounded(sink, good, [order], limit)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return _until_limit(lambda: writer.start().awaitTermination(), spark, sink, limit)


def ingest_listing(spark: SparkSession, path: str, sink: str, checkpoint: str, good: str, limit: int, items: int = 100, source: type[PagedSource] = PagedSource) -> int:
    """IO13, IO14, ST1: up to `limit` good rows (item, line, value) of a paged listing, batches of `items` items, as ingest_up_to does."""
    return _until_limit(lambda: run_paged(spark, path, _bounded(sink, good, ["item", "line"], limit), checkpoint, items, source), spark, sink, limit)


def once_reached(stream: DataFrame, target: int, stage: Callable[[], object], marker: str, checkpoint: str) -> None:
    """ST3: counts a stream's rows and runs the stage once, when they are `target` or more; then writes a marker, a folder.

    The count is the stream's own state: it goes on after a restart and a batch that runs again counts once. A stage that fails
    stops the stream, and runs again with the batch. With the marker set nothing is read."""
    spark = stream.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(marker)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(path):
        return

    def look(counts: DataFrame, number: int) -> None:
        row = counts.first()
        if row is not None and row["n"] >= target and not store.exists(path):
            stage()
            spark.createDataFrame([(row["n"],)], "rows long").coalesce(1).write.json(marker)

    counted = stream.groupBy().agg(F.count(F.lit(1)).alias("n"))
    counted.writeStream.outputMode("complete").foreachBatch(look).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def when_reached(count: Callable[[], int], target: int, stage: Callable[[], object], done: Callable[[], bool], mark: Callable[[], object], wait_s: float = 30.0, most_polls: int | None = None) -> bool:
    """ST3: for counts that are no stream: polls until the target is reached, then runs the stage once and sets the marker. With the
    marker set it does nothing. Returns whether the stage has run, now or before."""
    polls = 0
    while not done():
        if count() >= target:
            stage()
            mark()
            return True
        polls += 1
        if most_polls is not None and polls >= most_polls:
            return False
        time.sleep(wait_s)
    return True


def called(df: DataFrame, key: str, prompt: str, call: Callable[[str], str], good: Callable[[str], bool] = bool, parallel: int = 5, attempts: int = 3, wait_s: float = 2.0) -> DataFrame:
    """ST6: (key, reply, attempts, error) of a call per row, at most `parallel` at a time (as many partitions). A call that raises is
    tried again after wait_s, then twice as long; one whose reply isn't good, at once. After the last attempt the reply is null."""

    def run(frames):
        for frame in frames:
            out = []
            for k, text in zip(frame[key], frame[prompt], strict=True):
                reply, error, wait = None, None, wait_s
                for n in range(1, attempts + 1):
                    try:
                        said = call(text)
                        if good(said):
                            reply, error = said, None
                            break
                        error = "bad reply"
                    except Exception as e:  # a call may fail in any way; the row says how
                        error = type(e).__name__
                        if n < attempts:
                            time.sleep(wait)
                            wait *= 2
                out.append((k, reply, n, error))
            yield pd.DataFrame(out, columns=[key, "reply", "attempts", "error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, prompt).repartition(parallel).mapInPandas(run, f"{key} {kind}, reply string, attempts int, error string")


def run_stages(stages: list[tuple[str, Callable[[], object]]], log: Callable[[str], object] = print) -> list[str]:
    """ST7: runs named stages in order and logs each; the first that raises stops the chain. Returns the names that ended."""
    ended = []
    for name, stage in stages:
        log(f"{name}: begins")
        stage()
        log(f"{name}: ended")
        ended.append(name)
    return ended


def pending(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """IO9, J5, ST5: rows whose key is not among the finished ones."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def running_average(stream: DataFrame, decay: float = 0.95) -> DataFrame:
    """ST4: the moving average of (run, step, value) as state per run; steps of a batch in order, repeated ones each, as in w4.

    Late steps (below the last one seen) come out without an average, and leave the state as it is."""

    def update(key, frames, state):
        step, ema = state.get if state.exists else (-(1 << 63), 0.0)
        rows = pd.concat(list(frames)).sort_values("step", kind="stable")
        out = []
        for s, v in zip(rows["step"], rows["value"], strict=True):
            if s >= step:
                step, ema = int(s), decay * ema + (1 - decay) * float(v)
            out.append((key[0], int(s), float(v), ema if s >= step else None))
        state.update((step, ema))
        yield pd.DataFrame(out, columns=["run", "step", "value", "ema"])

    return stream.groupBy("run").applyInPandasWithState(update, "run string, step long, value double, ema double", "step long, ema double", "append", "NoTimeout")


def write_running_average(stream: DataFrame, sink: str, checkpoint: str, decay: float = 0.95) -> None:
    """ST4 over all there is: averages to sink, late steps to <sink>-rejected."""
    put = _parted(sink, "ema is not null")
    running_average(stream, decay).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
