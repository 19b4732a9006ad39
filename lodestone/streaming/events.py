"""A synchronous event bus: subscribers of exactly an event's class are called in the order in which they subscribed."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Event:
    event_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    timestamp: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat())


@dataclass(frozen=True)
class WorkspaceInitialized(Event):
    path: str = ""


@dataclass(frozen=True)
class StorageWritten(Event):
    path: str = ""


@dataclass(frozen=True)
class DiscoveryCompleted(Event):
    added: int = 0
    modified: int = 0
    deleted: int = 0
    renamed: int = 0


@dataclass(frozen=True)
class DiagnosticEmitted(Event):
    level: str = ""
    code: str = ""
    message: str = ""


class EventBus:
    def __init__(self) -> None:
        self._subscribers: dict[type, list[Callable]] = defaultdict(list)
        self.log: list[Event] = []

    def subscribe(self, kind: type, handler: Callable) -> None:
        self._subscribers[kind].append(handler)

    def publish(self, event: Event) -> None:
        self.log.append(event)
        for handler in self._subscribers[type(event)]:
            handler(event)

    def frame(self, spark: SparkSession) -> DataFrame:
        """What was published, as a relation."""
        import json

        rows = [(e.event_id, e.timestamp, type(e).__name__, json.dumps(asdict(e))) for e in self.log]
        return spark.createDataFrame(rows, "event_id string, timestamp string, event_type string, payload string")
