"""The forward log: one observation for each source and session after a freeze date, as a stream."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def observations(events: DataFrame) -> DataFrame:
    """(session, event_type, ret, n): the mean value of each source and day."""
    return events.groupBy(F.to_date("ts").alias("session"), "event_type").agg(F.avg("value").alias("ret"), F.count("*").alias("n"))


def forward_observations(daily: DataFrame, freeze: str, watermark: str = "40 days") -> DataFrame:
    """Observations after the freeze, one for each source and session; works on a stream and a table alike.

    A stream forgets a session when the watermark has passed it, so its state holds no more sessions
    than the watermark is long; a repeat that comes later than that is not recognised. Of repeats that
    differ a table keeps the smallest (ret, n), a stream the first.
    """
    d = daily.where(F.col("session") > F.lit(freeze).cast("date")).withColumn("at", F.col("session").cast("timestamp"))
    if not d.isStreaming:
        best = d.drop("at").groupBy("event_type", "session").agg(F.min(F.struct("ret", "n")).alias("o"))
        return best.select("session", "event_type", "o.ret", "o.n")
    return d.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["event_type", "session"]).drop("at")


def stream_to_table(spark: SparkSession, source: str, target: str, checkpoint: str, freeze: str) -> DataFrame:
    """Runs the stream over the files in source until all are read and returns the table it appended to.

    A batch writes its own folder, which a restart from the checkpoint overwrites: nothing is appended
    twice, and what earlier batches wrote is never touched again.
    """
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(source)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    query = forward_observations(stream, freeze).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(target)


SUMMARY = "source string, version long, sessions long, cumulative double, sharpe double"


class _Running(StatefulProcessor):
    """Figures of one source so far: recent sessions one by one, older ones as sums.

    A session stays open for corrections until the watermark has passed it; of several observations of an
    open session the smallest (ret, n) counts, whatever order they come in. Then it is added to the sums
    and forgotten, and what comes for it later is ignored: the state holds no more sessions than the
    watermark is long.
    """

    def __init__(self, hidden_until: int) -> None:
        self.hidden_until = hidden_until

    def init(self, handle) -> None:
        self.recent = handle.getMapState("recent", "day int", "ret double, n long")
        self.sums = handle.getValueState("sums", "version long, closed int, sessions long, logs double, total double, squares double")

    def handleInputRows(self, key, rows, timer_values):  # noqa: N802
        version, closed, sessions, logs, total, squares = self.sums.get() if self.sums.exists() else (0, -(10**6), 0, 0.0, 0.0, 0.0)
        passed = timer_values.getCurrentWatermarkInMs() // 86_400_000
        for pdf in rows:
            for day, ret, n in zip(pdf["day"].tolist(), pdf["ret"].tolist(), pdf["n"].tolist(), strict=True):
                if day > closed and day >= passed:
                    found = self.recent.getValue((day,)) if self.recent.containsKey((day,)) else None
                    if found is None or (ret, n) < tuple(found):
                        self.recent.updateValue((day,), (ret, n))
        open_now = sorted((k[0], v[0]) for k, v in self.recent.iterator())
        for day, ret in open_now:
            if day < passed:
                sessions, logs, total, squares, closed = sessions + 1, logs + math.log1p(ret), total + ret, squares + ret * ret, max(closed, day)
                self.recent.removeKey((day,))
        self.sums.update((version + 1, closed, sessions, logs, total, squares))
        rets = [ret for day, ret in open_now if day >= passed]
        n = sessions + len(rets)
        logs, total, squares = logs + sum(map(math.log1p, rets)), total + sum(rets), squares + sum(r * r for r in rets)
        variance = max(squares / n - (total / n) ** 2, 0.0) if n else 0.0
        shown = n >= self.hidden_until
        yield pd.DataFrame({"source": [key[0]], "version": [version + 1], "sessions": [n], "cumulative": [logs if shown else None], "sharpe": [total / n / math.sqrt(variance) if shown and variance > 0 else None]}).astype({"cumulative": "float64", "sharpe": "float64"})

    def close(self) -> None:
        pass


def stream_summary(spark: SparkSession, source: str, target: str, checkpoint: str, freeze: str, hidden_until: int = 10, watermark: str = "40 days", files_at_once: int = 1) -> DataFrame:
    """(source, sessions, cumulative, sharpe) after all files in source, summed up as they arrive.

    source holds daily observations (session, event_type, ret, n); every batch appends the figures of the
    sources it touched, and the last version of each is the answer. Sessions up to the freeze do not
    count; figures stay hidden until so many sessions are in, as in the batch form.
    """
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = spark.read.parquet(source).schema
    d = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(source).where(F.col("session") > F.lit(freeze).cast("date"))
    d = d.select("event_type", F.unix_date("session").alias("day"), "ret", "n", F.col("session").cast("timestamp").alias("at")).withWatermark("at", watermark)
    running = d.groupBy("event_type").transformWithStateInPandas(_Running(hidden_until), SUMMARY, "Update", "EventTime")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    running.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(availableNow=True).start().awaitTermination()
    spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    versions = spark.read.schema(SUMMARY).parquet(target)
    return versions.groupBy("source").agg(F.max_by(F.struct("sessions", "cumulative", "sharpe"), "version").alias("s")).select("source", "s.sessions", "s.cumulative", "s.sharpe")
