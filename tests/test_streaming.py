"""Streaming gaps agree with the batch window."""

from pyspark.sql import functions as F

from chronoloom.operators import sequence, windows
from chronoloom.sources import events as ev
from chronoloom.streaming.gaps import stream_gaps

from .conftest import SF


def test_stream_agrees_with_batch(spark, tmp_path):
    e = ev.from_event_stream(ev.read_events(spark, f"{SF}/events.parquet")).select("row_id", "timestamp", "node", "anomaly", "event_template")
    cut = e.orderBy("timestamp", "row_id").limit(500)
    cut.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream_gaps(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), 86_400).writeStream.format("memory").queryName("gaps").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["row_id"]: (r["gap_prev_s"], r["prev_anomaly"], r["window_idx"]) for r in spark.table("gaps").collect()}
    batch = windows.by_time(sequence.add_sequence_context(cut), 86_400)
    assert got == {r["row_id"]: (r["gap_prev_s"], r["prev_anomaly"], r["window_idx"]) for r in batch.select("row_id", "gap_prev_s", "prev_anomaly", F.col("window_idx")).collect()}
