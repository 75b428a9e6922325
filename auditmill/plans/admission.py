"""Queues of records that wait for delivery: caps, reservations, and whose queue makes room. All on the driver, bounded by the caps."""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Caps:
    tenant: int = 1000
    tenants: int = 10_000
    total: int = 50_000
    #: What happens where a queue is full: "dlq" sends queues to the dead letters, "drop" refuses the record.
    when_full: str = "dlq"

    def __post_init__(self):
        if self.when_full not in ("dlq", "drop"):
            raise ValueError(f"no policy {self.when_full}")
        if min(self.tenant, self.tenants, self.total) < 1:
            raise ValueError("caps are positive")


class Queues:
    """A queue for each tenant (None: no tenant). A place is reserved when a record is admitted, and filled once it is stored."""

    def __init__(self, caps: Caps):
        self.caps = caps
        self.held: dict[str | None, deque] = {}
        self.reserved: Counter = Counter()
        # kept as records come and go: admitting one looks at no other queue
        self._occupied: Counter = Counter()
        self._total = 0

    def _counted(self, tenant: str | None, n: int) -> None:
        self._total += n
        self._occupied[tenant] += n
        if not self._occupied[tenant]:
            del self._occupied[tenant]

    def occupancy(self, tenant: str | None) -> int:
        return self._occupied.get(tenant, 0)

    def total(self) -> int:
        return self._total

    def active(self) -> set:
        return set(self._occupied)

    def _may_open(self, tenant: str | None) -> bool:
        return tenant in self._occupied or len(self._occupied) < self.caps.tenants

    def order(self) -> list:
        """Tenants with records, the longest queue first; of equal ones, the one whose first record is older."""
        return sorted((t for t, q in self.held.items() if q), key=lambda t: (-len(self.held[t]), self.held[t][0]["id"]))

    def victims(self, admitting: str | None, coming: int = 1) -> list:
        """The queues that make room for `coming` records: the longest of others first, the admitting one's last."""
        out, over = [], self.total() + coming - self.caps.total
        for t in sorted(self.order(), key=lambda t: t == admitting):
            if over <= 0:
                break
            out.append(t)
            over -= len(self.held[t])
        return out

    def admit(self, tenant: str | None, spill: Callable[[str | None], bool]) -> str:
        """Reserve a place; why not, if there is none. spill(tenant) sends a queue elsewhere and tells whether it did."""
        caps, drop = self.caps, self.caps.when_full == "drop"
        if not self._may_open(tenant):
            return "max_active_tenants"
        if self.occupancy(tenant) >= caps.tenant and (drop or not spill(tenant) or self.occupancy(tenant) >= caps.tenant):
            return "queue_full"
        if self.total() >= caps.total and (drop or not all(spill(t) for t in self.victims(tenant)) or self.total() >= caps.total):
            return "max_total_queued"
        self.reserved[tenant] += 1
        self._counted(tenant, 1)
        return ""

    def release(self, tenant: str | None) -> None:
        if self.reserved[tenant] > 0:
            self._counted(tenant, -1)
        self.reserved[tenant] -= 1
        if self.reserved[tenant] <= 0:
            del self.reserved[tenant]

    def push(self, record: dict) -> None:
        self.held.setdefault(record["tenant_id"], deque()).append(record)
        self._counted(record["tenant_id"], 1)

    def take(self, tenant: str | None, n: int | None = None) -> list[dict]:
        """The first records of a queue."""
        q = self.held.get(tenant, deque())
        out = [q.popleft() for _ in range(len(q) if n is None else min(n, len(q)))]
        if out:
            self._counted(tenant, -len(out))
        if not q:
            self.held.pop(tenant, None)
        return out

    def restore(self, records: list[dict]) -> None:
        """Put records back in front, in their order."""
        for r in reversed(records):
            self.held.setdefault(r["tenant_id"], deque()).appendleft(r)
            self._counted(r["tenant_id"], 1)

    def wave(self, records: list[dict]) -> list[dict]:
        """Put recovered records in front of their queues, as far as the caps go; those that wait, grouped by tenant as first seen."""
        groups: dict[str | None, list[dict]] = {}
        for r in records:
            groups.setdefault(r["tenant_id"], []).append(r)
        waits: list[dict] = []
        for t, own in groups.items():
            room = min(self.caps.tenant - self.occupancy(t), self.caps.total - self.total())
            if not self._may_open(t):
                room = 0
            room = max(0, room)
            self.restore(own[:room])
            waits += own[room:]
        return waits
