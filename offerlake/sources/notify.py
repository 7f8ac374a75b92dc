"""Notifications of alerts. Messages are made by Spark; a sender puts each out, and may be asked twice after a failure."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..operators.diff import alert_message

#: (search_id, message) -> error text, or None if it went well.
Sender = Callable[[str, str], str | None]


def notify(alerts: DataFrame, groups: DataFrame, searches: DataFrame, senders: dict[str, Sender], enabled: bool, force: bool = False) -> DataFrame:
    """(search_id, provider, ok, error): one row for each message and sender; none unless enabled or forced.

    Senders run on the executors, once for each search with alerts.
    """
    messages = alert_message(alerts, groups, searches)
    if not (enabled or force):
        messages = messages.limit(0)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                for name, sender in senders.items():
                    try:
                        error = sender(row["search_id"], row["message"])
                    except Exception as failed:  # a sender's failure is a result, not the job's end
                        error = str(failed)
                    rows.append((row["search_id"], name, error is None, error))
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], names=["search_id", "provider", "ok", "error"])

    return messages.mapInArrow(send, "search_id string, provider string, ok boolean, error string")
