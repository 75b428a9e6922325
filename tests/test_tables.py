"""Tables that a logger keeps open."""

import threading
import time

import pytest
from auditmill.plans.logger import AuditLogger, Config
from auditmill.plans.tables import OpenTables


class Table:
    def __init__(self, tenant):
        self.tenant, self.closed = tenant, False

    def close(self):
        self.closed = True


def test_the_longest_unused_goes_and_those_in_use_stay():
    made = []
    pool = OpenTables(lambda t: made.append(Table(t)) or made[-1], 2)
    with pool.using("a") as a, pool.using(None):
        with pool.using("b") as b:
            with pytest.raises(RuntimeError, match="pool_exhausted"), pool.using("c"):
                pass
            with pool.using("a") as again:
                assert again is a
            assert pool.open() == [None, "b", "a"]
        # a was not used for longer, but is in use
        with pool.using("c"):
            assert b.closed and not a.closed and pool.open() == [None, "a", "c"]
        with pytest.raises(RuntimeError, match="pool_close_in_use"):
            pool.close("a")
    pool.close("a")
    pool.close("nobody")
    assert a.closed and pool.open() == [None, "c"] and [x.tenant for x in made] == ["a", None, "b", "c"]
    pool.close()
    assert pool.open() == ["c"]


def test_callers_at_one_time_open_a_table_once():
    made, got = [], []

    def make(t):
        time.sleep(0.05)
        made.append(t)
        return Table(t)

    pool = OpenTables(make, 4)

    def use(k):
        with pool.using(f"t{k % 3}") as table:
            got.append((k % 3, table))

    threads = [threading.Thread(target=use, args=(k,)) for k in range(30)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(made) == ["t0", "t1", "t2"] and len({(k, id(x)) for k, x in got}) == 3 and len(got) == 30


def test_a_table_that_cannot_be_opened_takes_no_room():
    down = [True]

    def make(t):
        if down[0]:
            raise OSError("down")
        return Table(t)

    pool = OpenTables(make, 1)
    for t in ("a", "b", None):
        with pytest.raises(OSError), pool.using(t):
            pass
    down[0] = False
    with pool.using("c") as c:
        assert c.tenant == "c" and pool.open() == ["c"]


def test_more_tenants_than_tables(spark, tmp_path):
    logger = AuditLogger(spark, Config(f"file://{tmp_path}/log", database_per_tenant=True, tables=1))
    for t in "abc":
        logger.fire("x.y", "u", tenant_id=t)
    assert logger.flush() and len(logger.tables.open()) == 1
    with logger.using("a"), pytest.raises(RuntimeError, match="pool_exhausted"):
        logger.query("b")
    assert [len(logger.query(t)[0]) for t in "abc"] == [1, 1, 1]
    assert logger.shutdown() and logger.tables.open() == []
