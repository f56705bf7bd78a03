"""A store of scores that expire (SCO-07, JOIN-08, SET-03).

Scores are kept in a table bucketed and sorted by payload hash and partitioned
by the hour they were made in. Looking requests up needs no exchange of the
store, only of the requests, and hours older than the time to live are pruned
before a file is opened. Every append adds a file for each bucket and hour;
:meth:`ScoreStore.compact` drops expired hours and puts the others' files
together again.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from earnlens.operators.score import Artefacts, memoised, request_key, score
from earnlens.session import materialize
from earnlens.sources.tables import path_exists

HOUR = "scored_hour"


def hour_of(c: Column) -> Column:
    return F.floor(F.unix_seconds(c) / 3600).cast("bigint")


class ScoreStore:
    """``schema``: ``payload_hash``, ``scored_at`` and the response columns.
    A folder that already holds a store is opened."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, buckets: int | None = None):
        self.spark, self.path = spark, path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = "score_store_" + hashlib.md5(path.encode()).hexdigest()[:12]
        self.columns = [f.name for f in schema.fields if f.name != HOUR]
        if not spark.catalog.tableExists(self.table):
            kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != HOUR)
            spark.sql(f"CREATE TABLE {self.table} ({kept}, {HOUR} BIGINT) USING parquet PARTITIONED BY ({HOUR}) "
                      f"CLUSTERED BY (payload_hash) SORTED BY (payload_hash) INTO {self.buckets} BUCKETS LOCATION '{path}'")
            if path_exists(spark, path):
                spark.sql(f"MSCK REPAIR TABLE {self.table}")

    @staticmethod
    def schema_of(art: Artefacts, requests: DataFrame) -> StructType:
        """What :func:`score_through` keeps of scored requests."""
        empty = score(requests.limit(0), art)
        return StructType([*empty.schema.fields]).add("payload_hash", "string").add("scored_at", "timestamp")

    def append(self, rows: DataFrame) -> None:
        rows = rows.select(*self.columns, hour_of(F.col("scored_at")).alias(HOUR))
        rows.repartition(self.buckets, "payload_hash").write.mode("append").insertInto(self.table)

    def fresh(self, now: Column, ttl_seconds: int) -> DataFrame:
        """The newest score of each payload that has not expired."""
        oldest = now - F.make_dt_interval(secs=F.lit(ttl_seconds))
        rows = self.spark.table(self.table).where(F.col(HOUR) >= hour_of(oldest)).where(F.col("scored_at") > oldest)
        newest = rows.groupBy("payload_hash").agg(F.max_by(F.struct(*self.columns), "scored_at").alias("_s"))
        return newest.select("payload_hash", *[F.col(f"_s.{c}").alias(c) for c in self.columns if c != "payload_hash"])

    def hours(self) -> list[int]:
        """The hours that hold scores."""
        return sorted(int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.table}").collect())

    def compact(self, now: Column, ttl_seconds: int) -> None:
        """Expired hours go; of the others every bucket becomes one file,
        with the newest score of each payload of the hour."""
        limit = self.spark.range(1).select(hour_of(now - F.make_dt_interval(secs=F.lit(ttl_seconds)))).first()[0]
        for hour in self.hours():
            if hour < limit:
                self._drop(hour)
        rows = self.spark.table(self.table).groupBy(HOUR, "payload_hash").agg(F.max_by(F.struct(*self.columns), "scored_at").alias("_s"))
        rows = materialize(rows.select("_s.*", HOUR))
        rows.repartition(self.buckets, "payload_hash").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(self.table)

    def _drop(self, hour: int) -> None:
        self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION ({HOUR}={hour})")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{HOUR}={hour}")
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def score_through(store: ScoreStore, requests: DataFrame, art: Artefacts, ttl_seconds: int = 3600, now=None,
                  id_col: str = "request_id") -> DataFrame:
    """Responses with ``cache_hit``: requests whose payload has a fresh score
    take it, the others' payloads are scored once each and kept."""
    now = F.lit(now).cast("timestamp") if now is not None else F.lit(requests.sparkSession.range(1).select(F.current_timestamp()).first()[0])
    out, new = memoised(request_key(requests, art.model_version), store.fresh(now, ttl_seconds), art, now, id_col)
    out = materialize(out)  # the hits as they were before the new scores come
    store.append(new)
    return out
