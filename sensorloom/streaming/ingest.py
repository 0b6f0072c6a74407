"""New CSV files arriving in a folder, processed as a stream of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensorloom.operators.fleet import run_metrics
from sensorloom.plans.upload import NOTHING_KEPT, process_rows, run_params
from sensorloom.scale import DEFAULT, Scale, cut
from sensorloom.schema import DEFAULT_THRESHOLD, DEFAULT_WINDOW
from sensorloom.sources.csv import records, split_files
from sensorloom.sources.store import Change, Store
from sensorloom.sources.tables import run_rows, set_status


def dataset_key(file):
    """Dataset id of a file: the same for every delivery of the same path."""
    return F.abs(F.xxhash64(file))


def _registered(files: DataFrame, *more) -> DataFrame:
    return files.select(dataset_key(F.col("file")).alias("id"), F.element_at(F.split("file", "/"), -1).alias("filename"), *more)


def _process_files(change: Change, lines: DataFrame, names: list[str], threshold: float, window: int, scale: Scale) -> None:
    """Process some files of a batch at once: no loop over files as long as none of them raises.

    When the plan raises, the files are halved until the one that raises stands alone and is reported; the
    others take no harm from it.
    """
    spark, saved = change.store.spark, change.savepoint()
    files = spark.createDataFrame([(n,) for n in names], "file string")
    try:
        raw, rejected = split_files(lines.join(F.broadcast(files), "file", "left_semi"))
        rejected = cut(rejected)
        # the cells are parsed once, for the machines, the series and the count of rows
        rows = cut(raw.withColumn("dataset_id", dataset_key(F.col("file"))).drop("file"))
        ids = files.select(dataset_key(F.col("file")).alias("dataset_id"))

        def own(df: DataFrame) -> DataFrame:
            return df.join(F.broadcast(ids), "dataset_id", "left_semi")

        keys = [r["dataset_id"] for r in ids.collect()]
        written = process_rows(change, rows, own, threshold, window, scale, keys)
        metrics = cut(run_metrics(written, own(change.read("anomalies")), "dataset_id"))
        counts = metrics.select(F.col("dataset_id").alias("id"), F.col("rows").alias("row_count"))
        accepted = cut(_registered(files.join(rejected, "file", "left_anti")).join(counts, "id", "left").fillna(0, ["row_count"]))
        # a file with rows of which none can be kept has failed, one with nothing but its header has not
        given = rows.groupBy(F.col("dataset_id").alias("id")).count().drop("count")
        useless = accepted.filter("row_count = 0").join(given, "id", "left_semi").select("id", "filename", F.lit(NOTHING_KEPT).alias("error"))
        change.append("etl_runs", run_rows(metrics, run_params(threshold, window)))
        set_status(change, "datasets", accepted.join(useless, "id", "left_anti"), "completed")
        set_status(change, "datasets", _registered(rejected, "error").unionByName(useless), "failed")
    except Exception as error:  # the status table is the report of a failed upload
        change.back_to(saved)
        if len(names) > 1:
            for half in (names[::2], names[1::2]):
                _process_files(change, lines, half, threshold, window, scale)
        else:
            set_status(change, "datasets", _registered(files, F.lit(str(error)).alias("error")), "failed")


def process_batch(store: Store, lines: DataFrame, threshold: float = DEFAULT_THRESHOLD, window: int = DEFAULT_WINDOW,
                  scale: Scale = DEFAULT, batch: int | None = None, stream: str = "files") -> None:
    """All files of one micro-batch: readings, anomalies, run log and status become visible together.

    The number of the batch is published with them. A batch that is delivered again after it was published
    does nothing; one that broke off before has left nothing, so either way there is one of each.
    """
    if batch is not None and store.change().marked(stream) >= batch:
        return
    start = "start" if "start" in lines.columns else F.lit(0).cast("long").alias("start")
    # the files are read once, and their records made once; a task meets the lines of a byte range in their order
    held = cut(records(cut(lines.select("file", "value", start, F.monotonically_increasing_id().alias("at")))))
    # one name for each file of the batch
    names = sorted(r["file"] for r in held.select("file").distinct().collect())
    if names:
        files = store.spark.createDataFrame([(n,) for n in names], "file string")
        set_status(store, "datasets", _registered(files), "processing")

    def work(change: Change) -> None:
        if names:
            _process_files(change, held, names, threshold, window, scale)
        if batch is not None:
            change.mark(stream, batch)
    store.retried(work)


def ingest_stream(spark: SparkSession, in_dir: str, store: Store, checkpoint: str,
                  threshold: float = DEFAULT_THRESHOLD, window: int = DEFAULT_WINDOW,
                  scale: Scale = DEFAULT) -> StreamingQuery:
    """Process the CSV files of ``in_dir`` not seen before and stop; ``checkpoint`` remembers them."""
    lines = (spark.readStream.format("text").option("pathGlobFilter", "*.[cC][sS][vV]").load(in_dir)
             .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")))

    def handle(batch: DataFrame, epoch: int) -> None:
        process_batch(store, batch, threshold, window, scale, epoch, checkpoint)

    return (lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
