"""Tables that a logger keeps open, each pinned while it is in use."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from auditmill.sources.interfaces import Destination


class _Open:
    def __init__(self):
        self.table: Destination | None = None
        self.users = 0
        self.opening = threading.Lock()


class OpenTables:
    """At most `most` tenants' tables, beside the one of no tenant. The one that was not used for longest makes room; tables in use never do.

    Callers that ask for a table at one time have it opened once. A table with a close() is closed when it goes."""

    def __init__(self, make: Callable[[str | None], Destination], most: int):
        self._make, self._most, self._lock = make, most, threading.Lock()
        self._base = _Open()
        self._held: OrderedDict[str, _Open] = OrderedDict()

    @contextmanager
    def using(self, tenant: str | None) -> Iterator[Destination]:
        """A tenant's table, which stays open until the end of the block. RuntimeError pool_exhausted: all that may be open are in use."""
        gone = None
        with self._lock:
            own = self._base if tenant is None else self._held.get(tenant)
            if own is None:
                if len(self._held) >= self._most:
                    free = next((t for t, x in self._held.items() if not x.users), None)
                    if free is None:
                        raise RuntimeError("pool_exhausted")
                    gone = self._held.pop(free)
                own = self._held[tenant] = _Open()
            own.users += 1
            if tenant is not None:
                self._held.move_to_end(tenant)
        try:
            _close(gone)
            with own.opening:
                if own.table is None:
                    own.table = self._make(tenant)
            yield own.table
        finally:
            with self._lock:
                own.users -= 1
                # a table that could not be opened takes no room
                if own.table is None and not own.users and self._held.get(tenant) is own:
                    del self._held[tenant]

    def open(self) -> list[str | None]:
        """Tenants whose tables are open, the one that was not used for longest first; None first of all for the table of no tenant."""
        with self._lock:
            return [None] * (self._base.table is not None) + [t for t, x in self._held.items() if x.table is not None]

    def close(self, tenant: str | None = None) -> None:
        """Close a tenant's table (None: that of no tenant), if it is open. RuntimeError pool_close_in_use: it is in use."""
        with self._lock:
            own = self._base if tenant is None else self._held.get(tenant)
            if own is None:
                return
            if own.users:
                raise RuntimeError("pool_close_in_use")
            if tenant is None:
                self._base = _Open()
            else:
                del self._held[tenant]
        _close(own)


def _close(own: _Open | None) -> None:
    if own is not None and hasattr(own.table, "close"):
        try:
            own.table.close()
        except Exception:  # noqa: BLE001 - it is not used any more
            return
