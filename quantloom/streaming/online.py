"""Streams: codebooks that follow arriving vectors, and encoding of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quantloom.operators.quantize import ResidualKMeans


def fit_batch(batch: DataFrame, batch_id: int, model: ResidualKMeans, snapshots: str, vector: str = "embedding") -> None:
    """One ``fit_step`` from the snapshot of the latest batch before this one; ``model`` takes the result when its snapshot is written.

    A batch that is repeated, after whatever failure, therefore starts where it started before and counts
    once. Without an earlier snapshot the step starts from ``start``, the model as the stream found it. An
    empty batch changes nothing and leaves no snapshot.
    """
    if batch.isEmpty():
        return
    spark = batch.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(snapshots)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{snapshots}/start/done")):
        if model.books:
            model.save(spark, f"{snapshots}/start")
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{snapshots}/start/done"))
    known = [s.getPath().getName() for s in fs.listStatus(folder)]
    complete = [int(n) for n in known if n.isdigit() and int(n) < batch_id and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{snapshots}/{n}/done"))]
    if complete:
        fresh = ResidualKMeans.load(spark, f"{snapshots}/{max(complete)}")
    elif fs.exists(jvm.org.apache.hadoop.fs.Path(f"{snapshots}/start/codebook")):
        fresh = ResidualKMeans.load(spark, f"{snapshots}/start")
    else:
        fresh = ResidualKMeans(model.levels, model.codes, model.seed, model.seed_rows)
    fresh.fit_step(batch, vector)
    fresh.save(spark, f"{snapshots}/{batch_id}")
    fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{snapshots}/{batch_id}/done"))
    model.books, model.counts = fresh.books, fresh.counts


def fit_stream(stream: DataFrame, model: ResidualKMeans, snapshots: str, checkpoint: str, vector: str = "embedding") -> StreamingQuery:
    """One ``fit_batch`` a micro-batch; snapshots lie under the batches' numbers. A stream needs a folder of snapshots of its own."""
    step = lambda batch, batch_id: fit_batch(batch, batch_id, model, snapshots, vector)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def encode_stream(stream: DataFrame, model: ResidualKMeans, path: str, checkpoint: str, vector: str = "embedding") -> StreamingQuery:
    """Codes of each arriving vector, appended to a table."""
    return model.transform(stream, vector).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
