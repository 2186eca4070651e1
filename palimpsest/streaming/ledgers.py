"""Streams of ledger events: append, deduplicate, deliver and count.

Extensions of the batch operators; delivery is at least once, and exact by key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators.contracts import idempotent_write
from palimpsest.sources.commits import CommitLog, StaleVersion


def without_replays(stream: DataFrame, time: str, key: list[str], retention: str) -> DataFrame:
    """Rows whose key didn't come within the retention; state goes with the watermark."""
    return stream.withWatermark(time, retention).dropDuplicatesWithinWatermark(key)


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str, late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def append_ledger(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All rows that are there, appended to a Parquet ledger; the sink's log makes it exact."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain_outbox(jobs: DataFrame, checkpoint: str, deliver: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hand each batch of jobs to `deliver`, which must upsert by id, as a batch may come again after a failure."""
    return jobs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(deliver).start()


def remember_requests(stream: DataFrame, log: CommitLog, table: str, checkpoint: str, attempts: int = 5) -> StreamingQuery:
    """Requests (scope, key, request_sha256, at, ..) appended once a key, whatever comes again and however often a batch does.

    Each batch is compared with what is remembered at one version and committed
    against it; a writer that comes late compares again.  Conflicts, the same
    key with another hash, are appended to `{table}_conflicts`, once each.
    """

    def write(batch: DataFrame, _: int) -> None:
        for last in range(attempts - 1, -1, -1):
            version = log.version()
            held, refused = log.read(table, version), log.read(f"{table}_conflicts", version)
            none = batch.limit(0)
            judged = idempotent_write(batch.dropDuplicates(["scope", "key", "request_sha256"]), none if held is None else held.select(*batch.columns))
            new = judged.where("outcome = 'new'").drop("outcome")
            wrong = judged.where("outcome = 'conflict'").drop("outcome").join((none if refused is None else refused).select("scope", "key", "request_sha256"), ["scope", "key", "request_sha256"], "left_anti")
            tables = {name: rows for name, rows in ((table, new), (f"{table}_conflicts", wrong.select(*batch.columns))) if not rows.isEmpty()}
            if not tables:
                return
            try:
                log.commit(tables, expected=version, note="requests")
                return
            except StaleVersion:
                if not last:
                    raise

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
