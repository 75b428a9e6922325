"""What a logger needs of its parts, for callers that bring their own."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Destination(Protocol):
    """Where records are delivered: AuditTable, AppendTable, JdbcTable."""

    def insert(self, logs: DataFrame) -> None:
        """Add logs; by id, so that a second delivery changes nothing."""

    def scan(self) -> DataFrame:
        """All logs."""

    def prune(self, cutoff: str) -> None:
        """Remove logs before cutoff."""


@runtime_checkable
class JournalStore(Protocol):
    """Where records are stored until they are delivered: Journal."""

    def append(self, records: list[dict]) -> None: ...

    def ack(self, ids: list[str]) -> None: ...

    def pending(self) -> DataFrame: ...

    def recover(self, max_logs: int | None = None, max_bytes: float | None = None) -> tuple[list[dict], bool]: ...

    def compact(self) -> None: ...

    def truncate(self) -> bool: ...

    def bytes(self) -> int: ...


@runtime_checkable
class DeadLetterStore(Protocol):
    """Where batches go that can't be delivered: DeadLetters."""

    def add(self, logs: DataFrame) -> int: ...

    def set(self, changes: list[tuple[str, str, int]]) -> None: ...

    def read(self) -> DataFrame: ...

    def get(self, batch: str) -> dict | None: ...
