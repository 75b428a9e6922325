"""The journal as a stream, and batches by size or time."""

import json
import time

import pytest
from auditmill.plans.ingest import Limits
from auditmill.plans.logger import AuditLogger, Config
from auditmill.sources import files
from auditmill.sources.journal import Journal
from auditmill.sources.schema import COLUMNS, LOG
from auditmill.sources.table import AppendTable, AuditTable
from auditmill.streaming import batches, delivery, journal as waves
from pyspark.sql import functions as F


def rec(i, tenant="t1"):
    return dict.fromkeys(COLUMNS) | {"id": f"{i:05d}", "tenant_id": tenant, "actor_id": "a", "action": "x", "created_at": "2026-01-01T00:00:00.000Z", "metadata": '{"n":1}'}


def ids(table):
    return sorted(r.id for r in table.scan().collect())


@pytest.mark.parametrize("key", [None, "secret"])
def test_a_journal_is_worked_off_in_waves_and_across_a_crash(spark, tmp_path, key):
    from auditmill.functions.scalars import normalise_key

    j = Journal(spark, f"file://{tmp_path}/j", key=normalise_key(key) if key else None)
    for k in range(12):
        j.append([rec(10 * k + i) for i in range(10)])
    j.ack([f"{i:05d}" for i in range(5)])
    want = sorted(r.id for r in j.pending().collect())
    table, seen, down = AuditTable(spark, f"file://{tmp_path}/t"), [], [False]

    def insert(rows):
        if down[0] and len(seen) == 2:
            raise OSError("down")
        seen.append(rows.count())
        table.insert(rows)

    size = j.bytes() // 4
    work = lambda: waves.work_off(waves.segments(spark, f"{j.path}/segments", j.key, wave_bytes=size), j.acks, insert, f"file://{tmp_path}/ck", attempts=1)
    down[0] = True
    with pytest.raises(Exception, match="down"):
        work().awaitTermination()
    assert len(seen) == 2 and 0 < len(ids(table)) < len(want)
    down[0] = False
    work().awaitTermination()
    assert ids(table) == want and len(seen) >= 4 and max(seen) <= 40
    # committed segments are deleted but for the last wave's, whose records are in the table
    assert len(j.segments()) <= 4
    j.append([rec(900)])
    waves.drain(j, table.insert, f"file://{tmp_path}/ck")
    assert ids(table) == [*want, "00900"] and j.segments() == [] and j.bytes() == 0 and j.recover() == ([], False)


def test_a_wave_that_is_refused_goes_to_the_dead_letters(spark, tmp_path):
    j, letters = Journal(spark, f"file://{tmp_path}/j"), []
    j.append([rec(1), rec(2)])
    waves.drain(j, lambda _: (_ for _ in ()).throw(OSError("down")), f"file://{tmp_path}/ck", attempts=2, backoff_ms=1, dead_letter=lambda rows, e: letters.append((rows.count(), str(e))))
    assert letters == [(2, "down")] and j.segments() == []


def test_a_logger_drains_its_journal_at_the_start(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    first = AuditLogger(spark, Config(path))
    for i in range(3):
        first.fire_async("x.y", f"u{i}", tenant_id="t")
    assert first.table().scan().count() == 0
    second = AuditLogger(spark, Config(path, drain_on_start=True))
    assert second.table().scan().count() == 3 and second.stats()["queued"] == 0 and second.stats_detailed()["journal"] == 0 and not second.degraded
    second.fire_async("x.y", "u", tenant_id="t")
    assert second.shutdown() and second.table().scan().count() == 4
    with pytest.raises(ValueError):
        Config(path, drain_on_start=True, integrity=True)


def put(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f".{name}").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "in" / f".{name}").rename(tmp_path / "in" / name)


def test_requests_headers_become_columns(spark, tmp_path):
    table, rejected = AuditTable(spark, f"file://{tmp_path}/t"), []
    headers = {"x_forwarded_for": "203.0.113.9, 10.0.0.1", "user_agent_header": "curl", "x_tenant_id": "from-header"}
    put(tmp_path, "1.json", [rec(1, None) | headers, rec(2, "stated") | headers, rec(3, None)])
    stream = delivery.source(spark, f"file://{tmp_path}/in", headers=True)
    delivery.deliver(stream, table.insert, f"file://{tmp_path}/ck", Limits(require_tenant=True), rejected=lambda bad: rejected.extend(r.id for r in bad.collect()), proxies=1).awaitTermination()
    got = {r.id: (r.tenant_id, r.ip_address, r.user_agent) for r in table.scan().collect()}
    assert got == {"00001": ("from-header", "203.0.113.9", "curl"), "00002": ("stated", "203.0.113.9", "curl")} and rejected == ["00003"]


def until(found, n):
    """A stream with timeouts never runs out of batches, so wait for what has to come."""
    end = time.time() + 40
    while time.time() < end and len(found) < n:
        time.sleep(0.2)


def test_batches_go_by_size_or_by_time_and_wait_across_a_restart(spark, tmp_path):
    found = []

    def start(wait_ms):
        stream = batches.batched(delivery.source(spark, f"file://{tmp_path}/in"), 4, wait_ms)
        put_away = lambda rows, _: found.extend((r.queue, r.batch_no, r.cause, r.id) for r in rows.collect())
        return stream.writeStream.foreachBatch(put_away).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(processingTime="0 seconds").start()

    put(tmp_path, "1.json", [rec(i, "a") for i in range(10)] + [rec(20, None), rec(30, "")])
    query = start(3_600_000)
    until(found, 8)
    assert sorted(found) == [("of a", k // 4, "size", f"{k:05d}") for k in range(8)]
    query.stop()
    put(tmp_path, "2.json", [rec(10, "a"), rec(11, "a"), rec(40, "c")])
    query = start(1)
    until(found, 13)
    query.stop()
    assert sorted(found[8:]) == [("of a", 2, "size", f"{k:05d}") for k in range(8, 12)] + [("of c", 0, "time", "00040")]


def forget_last_batch(tmp_path):
    """As if the driver was lost after the table's change and before the stream noted its batch."""
    commits = sorted((int(p.name), p) for p in (tmp_path / "ck" / "commits").iterdir() if p.name.isdigit())
    for p in (commits[-1][1], commits[-1][1].with_name(f".{commits[-1][1].name}.crc")):
        p.unlink(missing_ok=True)


@pytest.mark.parametrize("numbered", [True, False])
def test_a_batch_that_comes_again_is_told_by_its_number(spark, tmp_path, numbered):
    table = AppendTable(spark, f"file://{tmp_path}/t")
    run = lambda: delivery.deliver(delivery.source(spark, f"file://{tmp_path}/in", 1), table.insert, f"file://{tmp_path}/ck", numbered=numbered).awaitTermination()
    put(tmp_path, "1.json", [rec(1), rec(2)])
    put(tmp_path, "2.json", [rec(3)])
    run()
    before = len(table._manifests())
    forget_last_batch(tmp_path)
    put(tmp_path, "3.json", [rec(4)])
    run()
    assert ids(table) == ["00001", "00002", "00003", "00004"]
    # the replayed batch is a second version of its row unless the table knows it
    assert table.raw().count() == (4 if numbered else 5) and len(table._manifests()) == before + (1 if numbered else 2)


def test_changes_keep_what_streams_noted(spark, tmp_path, monkeypatch):
    frame = lambda *rows: spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], LOG)
    path = f"file://{tmp_path}/t"
    table, other = AuditTable(spark, path), AuditTable(spark, path)
    table.insert(frame(rec(1)), batch=("s", 0))
    other.insert(frame(rec(2)), batch=("r", 7))
    real, seen = table._staged, []

    def staged(rows):
        # the same batch by another driver, which comes first
        if not seen:
            seen.append(1)
            other.insert(frame(rec(3)), batch=("s", 1))
        return real(rows)

    monkeypatch.setattr(table, "_staged", staged)
    table.insert(frame(rec(3)), batch=("s", 1))
    table.compact(many=2)
    table.prune("2025-01-01T00:00:00.000Z")
    assert ids(table) == ["00001", "00002", "00003"]
    assert [table.has(x) for x in (("s", 1), ("s", 2), ("r", 7), ("r", 8), ("q", 0))] == [True, False, True, False, False]
    table.insert(frame(rec(9)), batch=("s", 1))
    assert ids(table) == ["00001", "00002", "00003"]


def test_a_task_that_fails_leaves_no_half_written_batch(spark, tmp_path):
    table, down = AuditTable(spark, f"file://{tmp_path}/t"), tmp_path / "down"
    put(tmp_path, "1.json", [rec(i) for i in range(40)])

    def insert(rows, batch):
        path = str(down)

        def parts(chunks):
            import pathlib

            for chunk in chunks:
                if pathlib.Path(path).exists() and (chunk["id"] > "00030").any():
                    raise OSError("a task is down")
                yield chunk

        table.insert(rows.repartition(8, "id").mapInPandas(parts, LOG), batch=batch)

    run = lambda: delivery.deliver(delivery.source(spark, f"file://{tmp_path}/in"), insert, f"file://{tmp_path}/ck", attempts=1, numbered=True).awaitTermination()
    down.touch()
    with pytest.raises(Exception, match="a task is down"):
        run()
    assert table._manifests() == [] and ids(table) == []
    down.unlink()
    run()
    assert ids(table) == [f"{i:05d}" for i in range(40)] and len(table._manifests()) == 1


def test_a_wave_parses_each_line_once_and_keeps_few_parts(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.ndjson").write_text("".join(json.dumps({"id": f"{i:03d}", "log": {"id": f"{i:03d}", "actorId": "u"}}) + "\n" for i in range(50)) + "{broken\n")
    plan = files.parsed(spark.read.text(f"{tmp_path}/s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    seen, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # acks may be too many to be sent to all tasks
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        acked = spark.range(20).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("id"))
        stream = waves.segments(spark, f"{tmp_path}/s", clean=False)
        waves.work_off(stream, lambda: acked, lambda rows: seen.append((rows.count(), rows.rdd.getNumPartitions())), f"{tmp_path}/c").awaitTermination()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert seen == [(30, 1)]
