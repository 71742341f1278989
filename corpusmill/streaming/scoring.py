"""Micro-batch scoring of a file stream. The scorer is the batch transform; it keeps no state.

A batch is written to a directory of its own and then committed by a small file that holds its number of rows. Only
committed batches are read. A failure before the commit, wherever it is, leaves a directory that the repeated batch
replaces, so every row is there once.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.sources.tables import spread_out

_POSITION_BITS = 33  # monotonically_increasing_id: partition above, row position below


def _path(spark: SparkSession, *parts: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path("/".join(parts))
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commit(spark: SparkSession, output: str, number: int, rows: int) -> None:
    """Make a written batch visible; the file appears whole or not at all."""
    started, files = _path(spark, output, "_commits", f".{number}.started")
    stream = files.create(started, True)
    stream.write(bytearray(json.dumps({"batch": number, "rows": rows}).encode()))
    stream.close()
    done, _ = _path(spark, output, "_commits", str(number))
    files.delete(done, False)
    if not files.rename(started, done):
        raise OSError(f"batch {number} of {output} was not committed")


def committed(spark: SparkSession, output: str) -> dict[int, int]:
    """Rows of every committed batch; one small file per batch is read."""
    folder, files = _path(spark, output, "_commits")
    if not files.exists(folder):
        return {}
    found = {}
    for status in files.listStatus(folder):
        if status.getPath().getName().isdigit():
            stream = files.open(status.getPath())
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            found[int(status.getPath().getName())] = json.loads(text)["rows"]
    return found


def read_committed(spark: SparkSession, output: str, schema) -> DataFrame:
    """The rows of all committed batches; none if there are none yet."""
    paths = [f"{output}/batch={n}" for n in sorted(committed(spark, output))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write(batch: DataFrame, output: str, number: int) -> int:
    path = f"{output}/batch={number}"
    batch.write.mode("overwrite").parquet(path)
    return batch.sparkSession.read.schema(batch.schema).parquet(path).count()  # from the file footers


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def run_available(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], output: str, checkpoint: str
) -> StreamingQuery:
    """Process what has arrived, append it to ``output`` as Parquet and stop.

    Progress is in ``checkpoint``: a restart goes on after the last finished batch. A batch that is repeated, because
    something failed before it was finished, overwrites its own directory and is committed again. Batches of fewer
    splits than cores are dealt to all cores before the transform.
    """

    def write(batch: DataFrame, number: int) -> None:
        commit(batch.sparkSession, output, number, _write(transform(spread_out(batch)), output, number))

    query = _start(stream, write, checkpoint)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return query


def first_of(batch: DataFrame, n: int, output: str, number: int, order: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows of a batch by the columns ``order``; without them in the order of its partitions, all of
    which stay where they are.

    The batch is written once with its row positions, which then no longer change; the rows of every partition are
    counted, and the cut is a filter on the position. With ``order`` it is sorted by range before that.
    """
    spark, path = batch.sparkSession, f"{output}/_taken/{number}"
    batch = batch.orderBy(*order) if order else batch
    batch.withColumn("_at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    held = spark.read.parquet(path)
    sizes = held.groupBy(F.shiftright("_at", _POSITION_BITS).alias("part")).count().orderBy("part").collect()
    cut = 0
    for part, rows in sizes:
        if n < rows:
            cut = (part << _POSITION_BITS) + n
            break
        n, cut = n - rows, (part + 1) << _POSITION_BITS
    return held.where(F.col("_at") < cut).select(*batch.columns)


def take_from_stream(
    stream: DataFrame, n: int, output: str, checkpoint: str, order: Sequence[str] = ()
) -> StreamingQuery | None:
    """Append batches until ``output`` holds ``n`` committed rows, then stop the stream; later files stay unread.

    Only the batch that goes over ``n`` is cut, to its first rows by ``order``; Spark reads the files of a batch largest
    first, so without it which rows these are depends on the files. A restart goes on with what is committed; if that
    is enough, nothing is started and None is returned.
    """
    spark = stream.sparkSession
    enough, stopping = threading.Event(), threading.Event()
    if sum(committed(spark, output).values()) >= n:
        return None

    def write(batch: DataFrame, number: int) -> None:
        held = sum(rows for k, rows in committed(spark, output).items() if k != number)
        if held < n:
            rows = _write(batch, output, number)
            if held + rows > n:
                rows = _write(first_of(batch, n - held, output, number, order), output, number)
            commit(spark, output, number, rows)
            held += rows
        if held >= n:
            enough.set()
            stopping.wait(60)  # the next batch must not begin before the query is told to stop

    query = _start(stream, write, checkpoint)
    while query.isActive and not enough.wait(0.05):
        pass
    if enough.is_set():
        stopper = threading.Thread(target=query.stop)
        stopper.start()
        stopper.join(1)
        stopping.set()
        stopper.join()
    elif query.exception():
        raise query.exception()
    return query
