"""Counts by sliding window in event time over a stream of many batches, with late and refused rows kept apart.

A batch adds its own partial counts in a folder of its number and never reads or rewrites those of others, so a
repeated batch replaces itself, and the work of a batch grows with its rows alone. The watermark is the newest
time of all earlier batches less the delay; a row is late for the windows that ended by then. Late rows
are counted beside the rest instead of being dropped: both together are what a batch query gives. Rows
without a time or kind, and rows later than `until`, are refused and counted by reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import query
from ..sources.tables import table
from .queries import EVENTS, shared

PARTS = "start timestamp_ntz, stop timestamp_ntz, kind string, on_time long, late long, newest timestamp_ntz, batch long"
REFUSED = "reason string, kind string, n long, batch long"


class Series:
    """Partial counts below one folder; `at` and `kind` are columns of the rows."""

    def __init__(self, spark: SparkSession, folder: str, at: str, kind: str, until: str, size: str = "1 hour", slide: str = "15 minutes", delay: str = "1 hour"):
        self.spark, self.folder, self.at, self.kind = spark, folder.rstrip("/"), at, kind
        self.until, self.size, self.slide, self.delay = until, size, slide, delay

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def watermark(self, before: int | None = None) -> DataFrame:
        """One row, `mark`: the newest time of all batches, or of those before a number, less the delay; null without any."""
        parts = self._read("parts", PARTS)
        return (parts if before is None else parts.where(F.col("batch") < before)).agg((F.max("newest") - F.expr(f"interval {self.delay}")).alias("mark"))

    def batch(self, rows: DataFrame, number: int) -> None:
        """Takes one batch in; the same number again replaces what it left."""
        at, kind = F.col(self.at).cast("timestamp_ntz"), F.col(self.kind)
        future = at > F.lit(self.until).cast("timestamp_ntz")
        reason = F.when(at.isNull(), "no time").when(kind.isNull(), "no kind").when(future, "future")
        marked = rows.select(at.alias("at"), kind.alias("kind"), reason.alias("reason"))
        marked.where("reason is not null").groupBy("reason", "kind").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.folder}/refused/batch={number}")
        mark = self.watermark(number).first()["mark"]  # one value
        counted = marked.where("reason is null").groupBy(F.window("at", self.size, self.slide).alias("w"), "kind").agg(F.count("*").alias("n"), F.max("at").alias("newest"))
        late = F.lit(False) if mark is None else F.col("stop") <= F.lit(mark.isoformat()).cast("timestamp_ntz")
        parts = counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "kind", "n", "newest")
        parts = parts.select("start", "stop", "kind", F.when(late, 0).otherwise(F.col("n")).alias("on_time"), F.when(late, F.col("n")).otherwise(0).alias("late"), "newest")
        parts.write.mode("overwrite").parquet(f"{self.folder}/parts/batch={number}")

    def run(self, stream: DataFrame) -> None:
        """Takes in what the stream has; another call goes on where this one ended."""
        running = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
        running.awaitTermination()

    def series(self) -> DataFrame:
        """Each window and kind with its rows on time and late, and whether the watermark has passed it."""
        found = self._read("parts", PARTS).groupBy("start", "stop", "kind").agg(F.sum("on_time").alias("on_time"), F.sum("late").alias("late"))
        return found.join(F.broadcast(self.watermark())).select("start", "stop", "kind", "on_time", "late", F.coalesce(F.col("stop") <= F.col("mark"), F.lit(False)).alias("closed"))

    def refused(self) -> DataFrame:
        return self._read("refused", REFUSED).groupBy("reason", "kind").agg(F.sum("n").alias("n"))


#: The demonstration's stream ends here; what comes later counts as future.
UNTIL = "2024-01-29 00:00:00"


def with_stragglers(spark: SparkSession, sf_dir: str, folder: str, days: int = 7) -> None:
    """The events as files in order of their arrival, so many days in each; each fiftieth comes two files later."""
    found = table(spark, sf_dir, "events")
    late = F.when(F.col("event_id") % 50 == 0, 2).otherwise(0)
    # a year has few such files; of the rows themselves nothing is collected
    arrival = F.floor(F.datediff("ts", F.lit("2024-01-01")) / days) + late
    dealt = found.withColumn("arrival", F.coalesce(arrival, F.lit(0)))
    for n in sorted(r[0] for r in dealt.select("arrival").distinct().collect()):
        dealt.where(F.col("arrival") == n).drop("arrival").coalesce(1).write.mode("append").parquet(folder)


@query(
    "stream_sliding_series",
    f"select 'window' as part, start, event_type as kind, count(*) as n from (select event_type, ts, unnest(generate_series(time_bucket(interval 15 minute, ts) - interval 45 minute, time_bucket(interval 15 minute, ts), interval 15 minute)) as start from events where ts <= timestamp '{UNTIL}') group by all "
    f"union all select 'future' as part, null as start, event_type as kind, count(*) as n from events where ts > timestamp '{UNTIL}' group by all",
)
def stream_sliding_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by sliding hour and type over several micro-batches with stragglers, rows on time and late together; refused rows beside them."""
    folder = shared(spark)
    with_stragglers(spark, sf_dir, f"{folder}/in")
    found = Series(spark, f"{folder}/out", "ts", "event_type", UNTIL)
    found.run(spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"))
    windows = found.series().select(F.lit("window").alias("part"), "start", "kind", (F.col("on_time") + F.col("late")).alias("n"))
    return windows.unionByName(found.refused().select(F.col("reason").alias("part"), F.lit(None).cast("timestamp_ntz").alias("start"), "kind", "n"))
