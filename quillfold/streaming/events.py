"""Event-time windows and stream de-identification with Structured Streaming.

The sink writes each micro-batch under its number and skips numbers that its ledger holds, so a replayed batch is not
written twice. A checkpoint carries fingerprints of policy and pattern set; a run with others is refused.
"""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import dedupe_key
from ..operators.spans import PATTERNS, POLICY, mask_by_patterns


def fingerprint(policy: list = POLICY, patterns: dict = PATTERNS) -> str:
    return sha256(json.dumps([sorted(map(list, policy)), sorted(patterns.items())]).encode()).hexdigest()


def _marked(events: DataFrame, watermark: str | None) -> DataFrame:
    """With a watermark if one is given; event times without a zone are read in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark) if watermark else events


def tumbling(events: DataFrame, width: str, *keys: str, watermark: str | None = None) -> DataFrame:
    """window_start, keys, n, total of values; works on tables and, with a watermark, on streams."""
    e = _marked(events, watermark)
    return e.groupBy(F.window("ts", width), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), *keys, "n", "total")


def sliding(events: DataFrame, width: str, slide: str, *keys: str, watermark: str | None = None) -> DataFrame:
    e = _marked(events, watermark)
    return e.groupBy(F.window("ts", width, slide), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, gap: str, key: str, watermark: str | None = None) -> DataFrame:
    """key, session_start, last event plus gap, n."""
    e = _marked(events, watermark)
    return e.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def deduplicated(records: DataFrame, fields: list[str], watermark: str = "1 hour", time: str = "ts") -> DataFrame:
    """Records once for each position; on a stream within the watermark."""
    keyed = records.withColumn("dedupe_key", dedupe_key(F.lit("v1"), *fields))
    return keyed.withWatermark(time, watermark).dropDuplicatesWithinWatermark(["dedupe_key"]) if records.isStreaming else keyed.dropDuplicates(["dedupe_key"])


def deidentified(records: DataFrame, text_col: str, labels: list[str]) -> DataFrame:
    """The stateless map of the stream: texts masked by Column expressions, no Python."""
    return records.withColumn(text_col, mask_by_patterns(text_col, labels))


class BatchSink:
    """A ``foreachBatch`` writer of Parquet with one folder for each batch, and a guard of the run's fingerprint."""

    def __init__(self, folder: str, print_: str | None = None):
        self.folder, self.print = folder.rstrip("/"), print_ or fingerprint()

    def _fs(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(spark._jsc.hadoopConfiguration())

    def check(self, spark: SparkSession) -> None:
        """Refuse a folder that another policy or pattern set has written to."""
        path, fs = self._fs(spark, f"{self.folder}/_run")
        if fs.exists(path):
            if [r.fingerprint for r in spark.read.json(str(path.toString())).collect()] != [self.print]:
                raise ValueError("the sink was written under another policy")
        else:
            spark.createDataFrame([(self.print,)], "fingerprint string").coalesce(1).write.json(f"{self.folder}/_run")

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        done, fs = self._fs(batch.sparkSession, f"{self.folder}/batch={batch_id}/_SUCCESS")
        if not fs.exists(done):
            batch.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")


def write_stream(records: DataFrame, folder: str, checkpoint: str, **options):
    """Start the stream into a ``BatchSink``."""
    sink = BatchSink(folder)
    sink.check(records.sparkSession)
    return records.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def carry_chunks(chunks: DataFrame, most: int = 4000) -> DataFrame:
    """doc_id, seq, text: chunks of a document's stream joined and cut again at the last sentence end within ``most``.

    The tail waits in the state of its document until the next chunk, or until a chunk marked last.
    Chunks are (doc_id, seq, text, last) and come in order.
    """
    import pandas as pd

    def run(key, batches, state):
        tail, seq = state.get if state.exists else ("", 0)
        out, closed = [], False
        for b in batches:
            for text, last in b.sort_values("seq")[["text", "last"]].itertuples(index=False):
                tail += text or ""
                while len(tail) > most or (last and tail):
                    if len(tail) <= most:
                        cut = len(tail)
                    else:
                        ends = [tail.rfind(m, 0, most) for m in (". ", "! ", "? ", "\n")]
                        cut = max(ends) + 1 or max(tail.rfind(" ", 0, most) + 1, 0) or most
                    out.append((key[0], seq, tail[:cut]))
                    tail, seq = tail[cut:], seq + 1
                closed |= bool(last)
        if closed and not tail:
            state.remove()
        else:
            state.update((tail, seq))
        yield pd.DataFrame(out, columns=["doc_id", "seq", "text"])

    kind = chunks.schema["doc_id"].dataType.simpleString()
    return chunks.groupBy("doc_id").applyInPandasWithState(run, f"doc_id {kind}, seq long, text string", "tail string, seq long", "append", "NoTimeout")


def kafka_records(spark: SparkSession, servers: str, topic: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """topic, partition, offset, event_id, text: a stream, or a bounded replay where both offsets are given."""
    reader = spark.read if start and end else spark.readStream
    reader = reader.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start or "latest")
    rows = (reader.option("endingOffsets", end) if start and end else reader).load()
    value = F.from_json(F.col("value").cast("string"), "event_id string, text string")
    return rows.select("topic", "partition", "offset", F.col("timestamp").alias("ts"), value.alias("v")).select("topic", "partition", "offset", "ts", "v.event_id", "v.text")
