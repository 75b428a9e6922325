"""The audit table: changes at one time, skip data, deleted rows, pages that open few months."""

import datetime
import threading
import time

import pytest
from auditmill.operators import query
from auditmill.sources import skipping, table as T
from auditmill.sources.hadoop import Conflict, Files
from auditmill.sources.schema import COLUMNS, LOG
from auditmill.sources.table import AppendTable, AuditTable
from pyspark.sql import functions as F


def log(i, tenant="t1", at="2026-01-01T00:00:00.000Z", **more):
    return tuple(({"id": f"{i:04d}", "tenant_id": tenant, "actor_id": "a", "action": "x", "created_at": at} | more).get(c) for c in COLUMNS)


def frame(spark, rows):
    return spark.createDataFrame(rows, LOG)


def ids(table):
    return sorted(r.id for r in table.scan().collect())


def test_publish_is_for_one(spark, tmp_path):
    files, won = Files(spark, f"file://{tmp_path}/p"), []
    threads = [threading.Thread(target=lambda k=k: won.append((files.publish("m/v1", str(k) * 9), k))) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    (winner,) = [k for ok, k in won if ok]
    assert files.read("m/v1") == str(winner) * 9 and files.names("m") == ["v1"]


def test_a_writer_that_dies_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    """Before the change is written, before folders are moved, before the manifest; then another writer inserts, and prunes."""
    for k, step in enumerate(("_laid_out", "_staged", "_commit")):
        path = f"file://{tmp_path}/t{k}"
        AuditTable(spark, path).insert(frame(spark, [log(1), log(2, at="2026-01-20T00:00:00.000Z"), log(3, at="2026-02-01T00:00:00.000Z")]))
        dying = AuditTable(spark, path)

        def die(*_a, real=getattr(dying, step), step=step):
            if step != "_commit":
                real(*_a)
            raise OSError("dead")

        monkeypatch.setattr(dying, step, die)
        with pytest.raises(OSError):
            dying.insert(frame(spark, [log(9)]))
        if step == "_commit":
            with pytest.raises(OSError):
                dying.prune("2026-01-10T00:00:00.000Z")
        other = AuditTable(spark, path, lease=0)
        assert ids(other) == ["0001", "0002", "0003"]
        other.insert(frame(spark, [log(4, at="2026-01-30T00:00:00.000Z")]))
        other.prune("2026-01-10T00:00:00.000Z")
        assert ids(AuditTable(spark, path)) == ["0002", "0003", "0004"]
        other.recover()
        folders = [p for m in (tmp_path / f"t{k}").glob("created_month=*") for p in m.iterdir() if not p.name.startswith(".")]
        assert len(folders) == 3 and len(list((tmp_path / f"t{k}" / "_gone").iterdir())) == 1
        assert not list((tmp_path / f"t{k}").glob("_stage/[0-9]*"))


def between(monkeypatch, table, step, action):
    """Run action once, when table comes to this step of its next change."""
    real, done = getattr(table, step), []

    def first(*args):
        if not done:
            done.append(1)
            action()
        return real(*args)

    monkeypatch.setattr(table, step, first)


CHANGES = {
    "insert": lambda spark, t: t.insert(frame(spark, [log(5, at="2026-01-05T00:00:00.000Z"), log(6, at="2026-03-01T00:00:00.000Z")])),
    "same insert": lambda spark, t: t.insert(frame(spark, [log(7, action="other", at="2026-01-25T00:00:00.000Z")])),
    "prune": lambda spark, t: t.prune("2026-01-10T00:00:00.000Z"),
    "batch": lambda spark, t: t.delete_batch("2026-02-20T00:00:00.000Z", 1),
    "compact": lambda spark, t: t.compact(1),
}


@pytest.mark.parametrize("step", ["_staged", "_commit"])
@pytest.mark.parametrize("first, second", [("insert", "prune"), ("prune", "insert"), ("compact", "insert"), ("insert", "compact"), ("prune", "batch"), ("compact", "prune"), ("insert", "same insert"), ("batch", "compact")])
def test_two_writers_at_one_time_lose_nothing(spark, tmp_path, monkeypatch, first, second, step):
    """The second change is done whole while the first is under way; the result is that of one after the other."""
    rows = [log(1), log(2, at="2026-01-20T00:00:00.000Z"), log(3, at="2026-02-01T00:00:00.000Z"), log(4, "t2", at="2026-01-02T00:00:00.000Z")]
    path, calm = f"file://{tmp_path}/a", AuditTable(spark, f"file://{tmp_path}/b")
    slow, fast = AuditTable(spark, path), AuditTable(spark, path)
    for t in (slow, calm):
        t.insert(frame(spark, rows))
        t.insert(frame(spark, [log(7, at="2026-01-25T00:00:00.000Z")]))
    where = "_marked" if step == "_staged" and first in ("prune", "batch") else step
    between(monkeypatch, slow, where, lambda: CHANGES[second](spark, fast))
    CHANGES[first](spark, slow)
    for name in (second, first):
        CHANGES[name](spark, calm)
    assert sorted(map(tuple, slow.scan().select("id", "action").collect())) == sorted(map(tuple, calm.scan().select("id", "action").collect()))


def test_prune_and_flush_in_two_threads(spark, tmp_path):
    path, errors = f"file://{tmp_path}/t", []
    AuditTable(spark, path).insert(frame(spark, [log(i, at=f"2026-01-{i + 1:02d}T00:00:00.000Z") for i in range(20)]))

    def run(work):
        try:
            work(AuditTable(spark, path))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    def inserts(t):
        for i in range(100, 104):
            t.insert(frame(spark, [log(i, at="2026-01-25T00:00:00.000Z"), log(i + 50, at="2026-02-01T00:00:00.000Z")]))

    def prunes(t):
        for d in (3, 6, 9, 12):
            t.prune(f"2026-01-{d:02d}T00:00:00.000Z")

    threads = [threading.Thread(target=run, args=(w,)) for w in (inserts, prunes)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert ids(AuditTable(spark, path)) == [f"{i:04d}" for i in (*range(11, 20), *range(100, 104), *range(150, 154))]


def test_a_change_that_outlasts_its_lease_fails(spark, tmp_path, monkeypatch):
    slow, other = AuditTable(spark, f"file://{tmp_path}/t"), AuditTable(spark, f"file://{tmp_path}/t", lease=0)
    slow.insert(frame(spark, [log(1)]))
    between(monkeypatch, slow, "_commit", other.recover)
    real = slow._staged
    monkeypatch.setattr(slow, "_staged", lambda rows: [x for x in [real(rows)] if [other.recover()]][0])
    with pytest.raises(Conflict):
        slow.insert(frame(spark, [log(2)]))
    assert ids(other) == ["0001"]


def test_endless_conflicts_are_told(spark, tmp_path, monkeypatch):
    t = AppendTable(spark, f"file://{tmp_path}/t")
    monkeypatch.setattr(T, "ATTEMPTS", 2)
    monkeypatch.setattr(t, "_commit", lambda *_: False)
    with pytest.raises(Conflict):
        t.insert(frame(spark, [log(1)]))


def test_filters_open_files_that_can_match(spark, tmp_path):
    t = AuditTable(spark, f"file://{tmp_path}/t", index_bytes=0)
    rows = [log(i, f"t{i % 10}", at=f"2026-0{1 + i % 3}-01T00:00:00.000Z", actor_id=f"u{i % 200}", entity_id=None if i % 2 else f"e{i}") for i in range(3000)]
    t.insert(frame(spark, rows).repartitionByRange(30, "actor_id"))
    # a layout of many files, each with few actors
    t._laid_out = lambda r: r.repartitionByRange(30, "created_month", "actor_id")
    t.compact(1)
    files = t.scan().inputFiles()
    found = t.find(None, query.Filters(actor_id="u17"))
    assert len(files) == 30 and 1 <= len(found.inputFiles()) <= 6
    assert sorted(r.id for r in found.collect()) == sorted(r[0] for r in rows if r[2] == "u17")
    both = t.find("t7", query.Filters(actor_id="u17", start="2026-02-01", end="2026-02-28"))
    assert len(both.inputFiles()) <= 2 and sorted(r.id for r in both.collect()) == sorted(r[0] for r in rows if r[2] == "u17" and r[10][:7] == "2026-02")
    assert t.find(None, query.Filters(entity_id="none")).count() == 0 and t.find("t3", query.Filters(actor_id="u4")).count() == 0
    # small folders have no skip data, and are read
    t.index_bytes = 1 << 40
    t.insert(frame(spark, [log(9000, actor_id="u17", at="2026-01-09T00:00:00.000Z")]))
    assert t.find(None, query.Filters(actor_id="u17")).count() == 16


def test_skip_data_of_many_values(spark):
    """More values than one block takes: no value is missed, and few files are opened for nothing."""
    rows = spark.range(40_000).select(F.concat(F.lit("f"), F.col("id") % 8).alias("_file"), *(F.when(F.col("id") % 5 != 0, F.concat(F.lit(c), "id")).alias(c) for c in skipping.COLUMNS))
    index = skipping.build(rows, ("actor_id",)).cache()
    assert index.agg(F.max("blocks")).first()[0] == 1 and index.count() == 8
    wide = skipping.build(rows.withColumn("_file", F.lit("f")), ("actor_id",)).cache()
    assert wide.count() == wide.agg(F.max("blocks")).first()[0] == 8
    there = sum(skipping.candidates(wide, {"actor_id": f"actor_id{k}"}).count() for k in range(1, 60, 5))
    assert there == 12
    false = sum(skipping.candidates(wide, {"actor_id": f"actor_id3{k}x"}).count() for k in range(60))
    assert false <= 8
    assert skipping.candidates(index, {"actor_id": "actor_id11"}).first().file == "f3"


def test_a_files_name_costs_little_for_each_row(spark):
    """Scans name the file of each row, in folders whose paths may be long."""
    path = F.concat(F.lit("file://" + f"/{'x' * 60}" * 60 + "/created_month=202601/folder/part-"), "id", F.lit(".parquet"))
    rows = spark.range(20_000).select(path.alias("path"))
    began = time.perf_counter()
    found = rows.select(skipping.file_of("path").alias("_file")).withColumn("folder", skipping.folder_of()).groupBy("folder").agg(F.max("_file").alias("file")).collect()
    assert [tuple(r) for r in found] == [("created_month=202601/folder", "created_month=202601/folder/part-9999.parquet")]
    assert time.perf_counter() - began < 5


def test_pages_open_the_newest_months(spark, tmp_path):
    t = AuditTable(spark, f"file://{tmp_path}/t")
    months = [f"{y}-{m:02d}" for y in (2024, 2025) for m in range(1, 13)]
    rows = [log(100 * k + i, "busy" if i else "rare", at=f"{m}-1{i}T00:00:00.000Z") for k, m in enumerate(months) for i in range(5)]
    t.insert(frame(spark, rows))
    assert len(t.months()) == 24
    found, opened = t.ahead("busy", limit=3)
    assert [r.id for r in found] == ["2304", "2303", "2302", "2301"] and opened == [202512]
    page, cursor = t.page("busy", limit=3)
    assert len(page) == 3 and cursor == "2302"
    found, opened = t.ahead("busy", cursor="1203", limit=2)
    assert [r.id for r in found] == ["1202", "1201", "1104"] and opened == [202501, 202412, 202411]
    found, opened = t.ahead("rare", limit=2)
    assert [r.id for r in found] == ["2300", "2200", "2100"] and len(opened) == 3
    assert t.ahead("nobody")[0] == [] and t.ahead("busy", cursor="0000")[1] == []
    found, opened = t.ahead("busy", query.Filters(start="2024-03-01", end="2024-04-30"), limit=2)
    assert [r.id for r in found] == ["0304", "0303", "0302"] and opened == [202404]
    seen, cursor = [], None
    while True:
        page, cursor = t.page("busy", cursor=cursor, limit=7)
        seen += [r.id for r in page]
        if not cursor:
            break
    assert seen == sorted((r[0] for r in rows if r[1] == "busy"), reverse=True)


def test_pages_of_ids_that_hold_no_time(spark, tmp_path):
    """Ids whose order is not that of the months: ids' ranges decide, so the page is right."""
    t = AuditTable(spark, f"file://{tmp_path}/t")
    rows = [log((i * 37) % 101, at=f"2026-{1 + i % 12:02d}-01T00:00:00.000Z") for i in range(101)]
    t.insert(frame(spark, rows))
    assert [r.id for r in t.page("t1", limit=20)[0]] == [f"{i:04d}" for i in range(100, 80, -1)]


def test_deleted_rows_are_bitmaps_until_compaction(spark, tmp_path):
    t = AuditTable(spark, f"file://{tmp_path}/t", lease=0)
    t.insert(frame(spark, [log(i, "ab"[i % 2], at="2026-01-10T00:00:00.000Z") for i in range(500)]))
    t.insert(frame(spark, [log(i, "a", at="2026-02-10T00:00:00.000Z") for i in range(500, 600)]))
    before = {x.path for x in t._live()}
    t.delete_batch("2026-03-01T00:00:00.000Z", 7)
    t.delete_batch("2026-03-01T00:00:00.000Z", 8)
    assert {x.path for x in t._live()} == before and sum(x.gone_rows for x in t._live()) == 15
    assert ids(t) == [f"{i:04d}" for i in range(15, 600)] and t.find("a", query.Filters(action="x")).count() == 342
    t.prune("2026-02-20T00:00:00.000Z", tenant="b")
    assert {x.path for x in t._live()} == before and t.scan().count() == 342 and t.scan().where("tenant_id = 'b'").count() == 0
    t.prune("2026-02-20T00:00:00.000Z", tenant="b")
    t.compact(1)
    assert not {x.path for x in t._live()} & before and all(x.gone is None for x in t._live()) and sum(x.rows for x in t._live()) == 342
    assert t.scan().count() == 342
    t.recover()
    t.delete_batch("2026-03-01T00:00:00.000Z", 1000)
    assert t._live() == [] and t.scan().count() == 0


def test_too_many_deleted_rows_are_written_anew(spark, tmp_path, monkeypatch):
    t = AuditTable(spark, f"file://{tmp_path}/t")
    t.insert(frame(spark, [log(i) for i in range(50)]))
    monkeypatch.setattr(T, "GONE_BLOCKS", 0)
    t.delete_batch("2026-03-01T00:00:00.000Z", 10)
    assert all(x.gone is None for x in t._live()) and t.scan().count() == 40


def test_compaction_and_ttl(spark, tmp_path):
    t = AuditTable(spark, f"file://{tmp_path}/t")
    t.create()
    t.create()
    assert t.scan().count() == 0
    for i in range(1, 5):
        t.insert(frame(spark, [log(i, at=f"2026-01-0{i}T00:00:00.000Z")]))
    assert len(t._live()) == 4
    t.compact(3)
    assert len(t._live()) == 1 and t.scan().count() == 4
    t.delete_batch("2026-01-04T00:00:00.000Z", 2)
    assert ids(t) == ["0003", "0004"]
    assert [r.id for r in t.scan(ttl_days=1, now=datetime.datetime(2026, 1, 4, 12, tzinfo=datetime.UTC)).collect()] == ["0004"]
    t.compact()
    assert t._live()[0].rows == 2


def test_inserts_read_the_folders_that_their_ids_reach_into(spark, tmp_path, monkeypatch):
    t, read = AuditTable(spark, f"file://{tmp_path}/t"), []
    real = t._read
    monkeypatch.setattr(t, "_read", lambda live, files=None: read.append(len(live)) or real(live, files))
    for i in range(0, 40, 10):
        t.insert(frame(spark, [log(k) for k in range(i, i + 10)]))
    assert read == []
    t.insert(frame(spark, [log(15, action="again"), log(45)]))
    assert read == [3] and len(ids(t)) == 41 and t.scan().where("action = 'again'").count() == 0
    assert sorted(r.id for r in t.present(spark.createDataFrame([("0003",), ("0099",), (None,)], "id string")).collect()) == ["0003"]
    assert t.present(spark.createDataFrame([], "id string")).count() == 0


def test_an_insert_into_an_empty_table_reads_its_rows_once(spark, tmp_path):
    """Whatever makes the rows is done once; a table that has rows needs their ids' range first."""
    t, read = AuditTable(spark, f"file://{tmp_path}/t"), spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    logs = frame(spark, [log(i) for i in range(20)]).mapInArrow(seen, LOG)
    t.insert(logs)
    assert read.value == 20 and len(ids(t)) == 20
    t.insert(logs)
    assert read.value == 60 and len(ids(t)) == 20
    empty = AuditTable(spark, f"file://{tmp_path}/e")
    empty.insert(frame(spark, []))
    empty.insert(frame(spark, []), batch=("s", 0))
    assert empty.scan().count() == 0 and not empty.has(("s", 0))


@pytest.mark.parametrize("second", [[log(1, action="other"), log(2)], [log(3, at="2026-02-01T00:00:00.000Z", action="other")]])
def test_two_first_inserts_at_one_time(spark, tmp_path, monkeypatch, second):
    """Ids of the one that comes first are not added again, in whatever month of the other's rows they lie."""
    path = f"file://{tmp_path}/t"
    slow, fast = AuditTable(spark, path), AuditTable(spark, path)
    between(monkeypatch, slow, "_commit", lambda: fast.insert(frame(spark, second)))
    slow.insert(frame(spark, [log(1), log(3), log(3, at="2026-02-01T00:00:00.000Z")]))
    assert ids(slow) == sorted({"0001", "0003", *(r[0] for r in second)})
    assert slow.scan().where("action = 'other'").count() == 1


def test_rows_without_a_time_stay(spark, tmp_path):
    t = AuditTable(spark, f"file://{tmp_path}/t")
    t.insert(frame(spark, [log(1, at=None), log(2)]))
    t.insert(frame(spark, [log(1, at=None)]))
    t.prune("2027-01-01T00:00:00.000Z")
    assert ids(t) == ["0001"] and len(t.page("t1")[0]) == 1


def test_append_table_raw_rows_and_pages(spark, tmp_path):
    t = AppendTable(spark, f"file://{tmp_path}/t", index_bytes=0)
    t.insert(frame(spark, [log(1, actor_id="old"), log(2)]))
    t.insert(frame(spark, [log(1, actor_id="new")]))
    assert t.raw().count() == 3 and t.scan().count() == 2
    # the last version does not match, so the first must not be found by its file's skip data
    assert t.find("t1", query.Filters(actor_id="old")).count() == 0 and t.find("t1", query.Filters(actor_id="new")).count() == 1
    assert [(r.id, r.actor_id) for r in t.page("t1")[0]] == [("0002", "a"), ("0001", "new")]
    t.compact(1)
    assert t.raw().count() == 3 and [r.id for r in t.page("t1", limit=1)[0]] == ["0002"]
