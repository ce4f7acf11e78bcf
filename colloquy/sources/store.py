"""The store: tables as Parquet folders with fixed schemas, append-only but for staged replacements.

`replace` writes to a folder of its own first and moves it into place at the end. `append` and
`replace_partitions` leave the moving to Spark's committer and may be repeated after a failure: rows that
are there by their key are not added again. Paths may be in any file system that Spark reaches.

Tables that grow with the posts are bucketed by their key. Whether a key is there is then asked bucket by
bucket: only the rows that come are shuffled, to as many partitions as there are buckets, and of the store
only the key's columns are read, where they lie. The number of buckets is fixed when a store is made and
kept in its folder; choose it so that one bucket's keys suit one task. A key holds over all months, so
months can't be left out of the search. Rows with a null in their key are compared apart, for buckets
don't join nulls. Stores made without buckets go on without.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import checkpointed

#: Tables in the order of their creation: name, columns, key (unique by construction), partition column.
TABLES = [
    ("data_sources", "source_name string, display_name string, source_type string, category string, active boolean", ["source_name"], None),
    ("raw_posts", "post_id long, source_name string, category string, external_id string, content string, content_hash string, location string, language string, collected_at timestamp_ntz, month date", ["source_name", "external_id"], "month"),
    ("processing_jobs", "job_id long, triggered_by string, status string, posts_collected long, posts_processed long, started_at timestamp_ntz, completed_at timestamp_ntz", ["job_id", "status"], None),
    ("methodology_versions", "component string, version string, model_name string, config string, effective_from string, deprecated_at string", ["component", "version"], None),
    ("decision_audit_log", "audit_id string, post_id long, job_id long, decision_type string, input_hash string, output string, confidence double", ["audit_id"], None),
    ("sentiment_results", "post_id long, score long, comparative double, indicator string, positive_words array<string>, negative_words array<string>, token_count long", ["post_id"], None),
    ("relevance_results", "post_id long, relevance double, matched_keywords array<string>, is_relevant boolean", ["post_id"], None),
    ("discourse_results", "post_id long, dqi_total double, participation double, justification double, respectfulness double, constructiveness double, evidence double", ["post_id"], None),
    ("data_retention_log", "post_id long, action string, reason string, performed_at timestamp_ntz", ["post_id", "action"], None),
    ("bias_assessments", "job_id long, assessment_type string, group_field string, group_value string, metric_name string, metric_value double, threshold double, is_violation boolean, severity string", ["job_id", "assessment_type"], None),
    ("alert_events", "job_id long, assessment_type string, severity string, resolved_at timestamp_ntz", ["job_id", "assessment_type"], None),
    ("post_embeddings", "post_id long, embedding array<float>, model_name string", ["post_id"], None),
    ("monthly_topic_rollups", "month date, topic string, category string, location string, language string, positive long, neutral long, negative long, total long, avg_comparative double", ["month", "topic", "category", "location", "language"], "month"),
    ("monthly_source_rollups", "month date, source_name string, positive long, neutral long, negative long, total long, avg_comparative double", ["month", "source_name"], "month"),
    ("compaction_log", "month date, posts_compacted long, rollups_created long", ["month"], None),
    ("pseudonymous_users", "user_id long, sighting_count long, distinct_platforms long, correlation_confidence double, first_sighted_at timestamp_ntz, last_sighted_at timestamp_ntz, topic_affinity string", ["user_id"], None),
    ("user_platform_sightings", "event_id long, user_id long, source_id string, signal_hash string, confidence double, sighted_at timestamp_ntz", ["event_id"], None),
    ("dead_letters", "letter_id string, stage string, reason string, line string, batch_id long", ["letter_id"], None),
]

#: Tables that grow with the posts.
BUCKETED = ["raw_posts", "decision_audit_log", "sentiment_results", "relevance_results", "discourse_results", "data_retention_log", "post_embeddings", "user_platform_sightings", "dead_letters"]
#: Buckets of a new store that is told nothing else, enough for some hundred million posts.
BUCKETS = 16


class Store:
    """Tables below one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schemas = {name: columns for name, columns, _, _ in TABLES}
        self.keys = {name: key for name, _, key, _ in TABLES}
        self.partitions = {name: part for name, _, _, part in TABLES}
        if self.exists("_layout"):
            buckets = spark.read.schema("buckets int").parquet(f"{self.folder}/_layout").first()["buckets"]
        elif self.exists("raw_posts"):
            buckets = 0
        self.buckets = buckets

    def _bucketed(self, name: str) -> bool:
        return self.buckets > 0 and name in BUCKETED

    def _table(self, name: str) -> str:
        """The catalog's name of a bucketed table, registered for this session if it isn't yet; its files stay in the folder."""
        table = f"colloquy_{hashlib.md5(self.folder.encode()).hexdigest()[:16]}_{name}"
        if not self.spark.catalog.tableExists(table):
            part = f"partitioned by ({self.partitions[name]})" if self.partitions[name] else ""
            self.spark.sql(
                f"create table if not exists {table} ({self.schemas[name]}) using parquet options ('partitionOverwriteMode' = 'dynamic') {part} "
                f"clustered by ({', '.join(self.keys[name])}) into {self.buckets} buckets location '{self.folder}/{name}'"
            )
        return table

    def _by_bucket(self, rows: DataFrame, name: str) -> DataFrame:
        """The rows dealt like the table's buckets, so that a task writes one of them."""
        return rows.repartition(self.buckets, *self.keys[name])

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def exists(self, name: str) -> bool:
        fs, path = self._fs(f"{self.folder}/{name}")
        return fs.exists(path)

    def migrate(self, fresh: bool = False) -> list[str]:
        """Creates the tables that aren't there, in order, and says which; `fresh` starts anew."""
        made = []
        for name, columns, _, _ in TABLES:
            if fresh and self.exists(name):
                fs, path = self._fs(f"{self.folder}/{name}")
                fs.delete(path, True)
            if not self.exists(name):
                if self._bucketed(name):
                    self._mark()
                    fs, path = self._fs(f"{self.folder}/{name}")
                    fs.mkdirs(path)
                    self._table(name)
                else:
                    self._write(self.spark.createDataFrame([], columns), name, f"{self.folder}/{name}")
                made.append(name)
        return made

    def _mark(self) -> None:
        """Keeps the number of buckets in the folder, before the first bucketed table."""
        if not self.exists("_layout"):
            self.spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.parquet(f"{self.folder}/_layout")

    def read(self, name: str) -> DataFrame:
        if self._bucketed(name):
            table = self._table(name)
            if self.partitions[name]:
                self.spark.catalog.recoverPartitions(table)  # months that another session added
            self.spark.catalog.refreshTable(table)
            return self.spark.table(table)
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}")

    def _write(self, df: DataFrame, name: str, path: str, mode: str = "errorifexists") -> None:
        writer = df.write.mode(mode)
        if self.partitions[name]:
            writer = writer.partitionBy(self.partitions[name])
        writer.parquet(path)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows whose key isn't there yet, each once: adding them again changes nothing."""
        columns = self.spark.createDataFrame([], self.schemas[name]).columns
        rows, key = rows.select(*columns), self.keys[name]
        if self._bucketed(name):
            self.missing(name, rows).write.insertInto(self._table(name))
            return
        if key:
            old = self.read(name).select(*[F.col(k).alias(f"_{k}") for k in key])
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
            rows = rows.dropDuplicates(key).join(old, same, "left_anti")
        self._write(rows, name, f"{self.folder}/{name}", "append")

    def missing(self, name: str, rows: DataFrame) -> DataFrame:
        """Those of the rows whose key a bucketed table doesn't hold, each key once."""
        key, there = self.keys[name], self.read(name).select(*self.keys[name])
        no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key])
        full = self._by_bucket(rows.where(~no_key), name).dropDuplicates(key).join(there, key, "left_anti")
        old = there.where(no_key).select(*[F.col(k).alias(f"_{k}") for k in key])
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
        return full.select(*rows.columns).unionByName(rows.where(no_key).dropDuplicates(key).join(old, same, "left_anti"))

    def replace(self, name: str, rows: DataFrame) -> None:
        """Puts new content in place of the old after it has been written in full."""
        staged, old = (f"{self.folder}/.{name}-{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
        if self._bucketed(name):
            columns = self.spark.table(self._table(name)).columns
            passing = f"colloquy_{uuid.uuid4().hex}"
            writer = self._by_bucket(rows.select(*columns), name).write.format("parquet").bucketBy(self.buckets, *self.keys[name]).option("path", staged)
            if self.partitions[name]:
                writer = writer.partitionBy(self.partitions[name])
            writer.saveAsTable(passing)
            self.spark.sql(f"drop table {passing}")  # only its entry: the files are moved below
        else:
            self._write(rows, name, staged)
        fs, target = self._fs(f"{self.folder}/{name}")
        _, new = self._fs(staged)
        _, aside = self._fs(old)
        if fs.exists(target):
            fs.rename(target, aside)
        if not fs.rename(new, target):
            fs.rename(aside, target)
            raise OSError(f"{name} could not be replaced")
        fs.delete(aside, True)

    def replace_partitions(self, name: str, rows: DataFrame) -> None:
        """Puts new content in place of the partitions that `rows` holds; all others are not read or written.
        The rows are computed in full and kept in the shared folder first, so they may come from the table itself."""
        columns = self.spark.createDataFrame([], self.schemas[name]).columns
        kept = checkpointed(rows.select(*columns))
        if self._bucketed(name):
            self._by_bucket(kept, name).write.mode("overwrite").insertInto(self._table(name))
            return
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partitions[name]).parquet(f"{self.folder}/{name}")

    def is_connected(self) -> bool:
        return self.spark.range(1).count() == 1
