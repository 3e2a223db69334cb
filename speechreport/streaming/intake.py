"""Running the pipelines for each micro-batch of new recordings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from speechreport.operators.inference import Engines
from speechreport.plans.pipelines import run_pipelines
from speechreport.sources.recordings import write_reports
from speechreport.sources.scratch import dropped, written


def run_stream(stream: DataFrame, requests: Callable[[DataFrame], DataFrame], stt: Engines, llm: Engines, path: str, checkpoint: str, **options: object) -> StreamingQuery:
    """Starts a query that writes reports below path/batch=N for each micro-batch, and stops when all is read.

    requests: gives the requests for a batch of recordings. options: on_slot_error and check_languages, as run_pipelines()
    takes them. A batch that runs again after a failure replaces its own folder; what a batch has written in between is
    deleted when its reports are there.
    """

    def one(batch: DataFrame, number: int) -> None:
        cleanup: list[Callable[[], object]] = []
        reports = run_pipelines(requests(batch.drop("content")), batch.select("recording_id", "content"), stt, llm, audio="content", cleanup=cleanup, **options)
        write_reports(reports, f"{path}/batch={number}", "overwrite")
        for free in cleanup:
            free()

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def matched(requests: DataFrame, recordings: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """Rows of a stream of requests with the audio of a stream of recordings, in whichever order the two come.

    requests: recording_id, requested_at (timestamp) and what run_pipelines() takes; recordings: recording_id, recorded_at, content.
    A request takes the recording of its id that lies within ``wait`` of it, before or after, and keeps its place in the join's state for
    as long. Once both watermarks have passed it without a recording it is given with null content, so a request whose recording
    is missing or late gets a row, too. Rows without a time or an id have no place in the streams: they have no partner. Of
    recordings with one id and time, which files sent twice are, the first counts; one that comes at another time is another recording, and a
    request gets a row for each.
    """
    asked = requests.withWatermark("requested_at", wait).withColumnRenamed("recording_id", "_asked")
    once = recordings.select("recording_id", "recorded_at", "content").withWatermark("recorded_at", wait).dropDuplicatesWithinWatermark(["recording_id", "recorded_at"])
    near = F.expr(f"recorded_at between requested_at - interval {wait} and requested_at + interval {wait}")
    found = asked.join(once, (F.col("_asked") == F.col("recording_id")) & near, "left")
    return found.drop("recording_id").withColumnRenamed("_asked", "recording_id")


def run_request_stream(requests: DataFrame, recordings: DataFrame, stt: Engines, llm: Engines, path: str, checkpoint: str, wait: str = "10 minutes", **options: object) -> StreamingQuery:
    """Starts a query over two streams, as matched() joins them, that writes reports below path/batch=N, and stops when all is read.

    A request without a recording gets its row with status 404 once the wait is over. The join and its state are the stream's; only the
    pipelines, which need all slots of a request, and the sink run batch by batch. A batch that runs again replaces its own folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        # written once, as each read of the batch would run the join again
        batch = written(batch)
        cleanup: list[Callable[[], object]] = [lambda: dropped(batch)]
        if batch.isEmpty():
            return cleanup[0]()
        # a request may meet two recordings of one id, so each row is a recording of its own for the pipelines
        rows = batch.withColumn("_row", F.sha2(F.to_json(F.struct(*[c for c in batch.columns if c != "content"])), 256))
        asked = rows.withColumn("_id", F.col("recording_id")).withColumn("recording_id", F.col("_row"))
        heard = rows.filter("content is not null").groupBy(F.col("_row").alias("recording_id")).agg(F.any_value("content").alias("content"))
        own = [c for c in batch.columns if c not in ("content", "recorded_at", "requested_at")]
        reports = run_pipelines(asked.select(*own), heard, stt, llm, audio="content", cleanup=cleanup, **options)
        names = asked.select(F.col("_row"), F.col("_id")).distinct()
        named = reports.join(names, reports["recording_id"] == names["_row"], "left").withColumn("recording_id", F.col("_id")).drop("_row", "_id")
        write_reports(named, f"{path}/batch={number}", "overwrite")
        for free in cleanup:
            free()

    return matched(requests, recordings, wait).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
