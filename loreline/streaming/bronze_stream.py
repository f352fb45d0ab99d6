"""Bronze pages as a stream: new files of JSON lines are merged into a versioned table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loreline.operators.incremental import merge
from loreline.session import file_system
from loreline.sources.files import BRONZE
from loreline.sources.versioned import VersionedTable


def query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id a stream keeps in its checkpoint folder for as long as the folder lives."""
    fs, path = file_system(spark, f"{checkpoint.rstrip('/')}/metadata")
    stream = fs.open(path)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["id"]
    finally:
        stream.close()


def stream_bronze(spark: SparkSession, folder: str, table: VersionedTable, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upsert the highest revid of each number, batch by batch.

    The stream's id and the batch's go into the table's commit, so a batch that is
    delivered again after a failure changes nothing, while a stream with a new checkpoint
    folder, whose batches are numbered from 0 again, is read from the start.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        mark = f"batch.{query_id(spark, checkpoint)}"
        if int(table.manifest().properties.get(mark, -1)) >= batch_id:
            return
        rows = batch.where("number IS NOT NULL").groupBy("number").agg(F.max_by(F.struct("revid", "timestamp", "wikitext"), "revid").alias("r")).select("number", "r.*")
        old = table.read().select("number", F.col("revid").alias("old"))
        newer = rows.join(old, "number", "left").where("old IS NULL OR revid > old").drop("old")
        merge(table, newer, ["number"], ["revid", "timestamp", "wikitext"], {mark: str(batch_id)}, delete_missing=False)

    stream = spark.readStream.schema(BRONZE).option("lineSep", "\n").json(folder)
    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
