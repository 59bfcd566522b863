"""Structured Streaming form of receipt scoring.

The reference has no stream; this is the same stateless operator chain —
parse receipt lines, classify each distinct product, emit one row per item —
applied to receipt files as they land in a folder.  Each micro-batch is a
plain DataFrame handed to the batch operators (``foreachBatch``) and written to
its own folder ``batch_id=N``, replaced whole: a batch that is replayed after a
restart writes the same rows to the same place.  The stream itself only carries the names of new files; a batch reads its
files' lines by byte (``sources.lines``), so that every pass over them sees the same keys.
Receipt numbers restart per file, in line order, as the reference numbers the
lines of one uploaded file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans import flows as FL
from ..plans.training import Prepared
from ..sources.lines import read_lines
from ..sources.receipts import receipts_from_texts


def _score_batch(prepared: Prepared, sink: str, model_choice: str):
    def run(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        files = [r["path"] for r in batch.select("path").distinct().collect()]  # at most ``max_files``
        lines = read_lines(batch.sparkSession, files)
        receipts = receipts_from_texts(lines, "value", ["_offset"], group_cols=["_file"], marks=False)
        pred = FL.receipt_predictions(receipts, prepared, model_choice)
        pred.write.mode("overwrite").parquet(f"{sink}/batch_id={epoch_id}")

    return run


def score_receipt_stream(spark: SparkSession, source_dir: str, prepared: Prepared, sink_dir: str,
                         checkpoint_dir: str, model_choice: str = "naive_bayes", available_now: bool = True,
                         max_files: int = 1000):
    """Start the streaming query; with ``available_now`` it processes what is there and stops, ``max_files`` files
    a batch."""
    schema = "path string, modificationTime timestamp, length long, content binary"  # of the format; content is not read
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", max_files).load(source_dir)
    w = (files.select("path").writeStream.foreachBatch(_score_batch(prepared, sink_dir, model_choice))
         .option("checkpointLocation", checkpoint_dir))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
