"""The audit table: Parquet by month under manifests, so that each change is there at once or not at all."""

from __future__ import annotations

import datetime
import json
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from auditmill.functions.scalars import month
from auditmill.operators import query
from auditmill.operators.delivery import expired, first_write, insert_if_absent, last_write, oldest_expired
from auditmill.sources import skipping
from auditmill.sources.hadoop import Conflict, Files, lines
from auditmill.sources.schema import COLUMNS, LOG

#: Folders of one month from which on compact() puts it in one.
MANY = 32
#: Bytes of a folder from which on its files have skip data; smaller ones are as soon read.
INDEX_BYTES = 8 << 20
#: Blocks of deleted rows in a table: their bitmaps have 4 KB each, and a scan sends them to every task.
GONE_BLOCKS = 8_192
#: Manifests that stay, and seconds for which files that none lists may still be a running change's.
KEPT, LEASE = 10, 24 * 3600.0
#: Times that a change is made anew because others came first.
ATTEMPTS = 20
#: Stands for the month of rows without a time: it never passes.
NO_MONTH = 999_999
#: A stream and the number of one of its batches.
Batch = tuple[str, int]
_GONE = "folder string, file string, block long, bits binary"


@dataclass(frozen=True)
class Folder:
    """A folder of rows, created_month=YYYYMM/<name>, as a manifest has it."""

    path: str
    rows: int
    bytes: int
    #: The least and the largest id.
    low: str | None
    high: str | None
    indexed: bool = False
    #: The table of deleted rows that this folder has some in, how many, and blocks of them.
    gone: str | None = None
    gone_rows: int = 0
    gone_blocks: int = 0

    @property
    def month(self) -> int:
        own = self.path[14:].partition("/")[0]
        return int(own) if own.isdigit() else NO_MONTH


@dataclass
class Change:
    """Folders that go and that come; months whose folders it rests on (None: all)."""

    removed: list[Folder]
    added: list[Folder]
    months: set[int] | None = None


class AuditTable:
    """Insert-if-absent by id, scans, pages, prune; any number of writers.

    Rows lie in folders below their month. The newest manifest lists those that count, with their ids' range and their deleted rows. A change writes
    folders and then the next manifest, which fails if there is one of this number by now. If what the change rests on is as it was, it
    follows the other one; else it is made anew. What a writer that died left is swept by recover() once it is older than the lease, which a change
    must not outlast. A reader may take as long as KEPT changes.

    Deleted rows are bitmaps by file and row number, applied by scans, until compact() drops the rows. Files have skip data by column, which tell a filter
    the files that it has to open."""

    def __init__(self, spark: SparkSession, path: str, index_bytes: int = INDEX_BYTES, lease: float = LEASE):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)
        self.index_bytes, self.lease = index_bytes, lease

    # manifest

    def _manifests(self) -> list[str]:
        return [n for n in self.files.names("_manifest") if n.startswith("v")]

    def _read_manifest(self, name: str) -> tuple[list[Folder], dict[str, int]]:
        """Folders, and the last batch of each stream that is in them."""
        found = [json.loads(x) for x in self.files.read(f"_manifest/{name}").splitlines()]
        return [Folder(**x) for x in found if "path" in x], {x["stream"]: x["batch"] for x in found if "stream" in x}

    def _state(self) -> tuple[int, list[Folder], dict[str, int]]:
        """The newest manifest's number (0: none), folders and streams."""
        found = self._manifests()
        return (int(found[-1][1:-6]), *self._read_manifest(found[-1])) if found else (0, [], {})

    def _live(self) -> list[Folder]:
        return self._state()[1]

    def has(self, batch: Batch) -> bool:
        """Whether the table took this batch."""
        return self._state()[2].get(batch[0], -1) >= batch[1]

    def _commit(self, number: int, live: list[Folder], streams: dict[str, int] | None = None) -> bool:
        """Manifest `number` of these folders and streams, unless there is one; whether there wasn't."""
        noted = [{"stream": k, "batch": n} for k, n in sorted((streams or {}).items())]
        done = self.files.publish(f"_manifest/v{number:020d}.jsonl", lines([asdict(x) for x in sorted(live, key=lambda x: x.path)] + noted))
        if done:
            for n in self._manifests()[:-KEPT]:
                self.files.drop("_manifest", n)
        return done

    def _change(self, make: Callable[[list[Folder], int], Change | None], batch: Batch | None = None) -> None:
        """Commit what make(folders, number) says, until it is committed or there is nothing to do. A stream's batch that the table took before is nothing to do."""
        for attempt in range(ATTEMPTS):
            number, live, streams = self._state()
            if batch and streams.get(batch[0], -1) >= batch[1]:
                return
            change = make(live, number)
            if change is None or not (change.removed or change.added):
                return
            rests_on = lambda own, months=change.months: {x for x in own if months is None or x.month in months}
            based, gone = rests_on(live), {x.path for x in change.removed}
            new = [x.path for x in change.added if x.path not in {y.path for y in live}]
            while True:
                swept = [p for p in new if not self.files.exists(p)]
                if swept:
                    raise Conflict(f"the change outlasted its lease: {swept}")
                if self._commit(number + 1, [x for x in live if x.path not in gone] + change.added, streams | dict([batch] if batch else [])):
                    return
                number, live, streams = self._state()
                if change.months is None or based != rests_on(live) or (batch and streams.get(batch[0], -1) >= batch[1]):
                    break
            for p in new:
                self.files.drop(p)
            time.sleep(random.uniform(0, 0.05 * 2 ** min(attempt, 6)))
        raise Conflict(f"{ATTEMPTS} changes came first")

    def recover(self) -> None:
        """Sweep what no kept manifest lists and is older than the lease: left by writers that died, or replaced by later changes."""
        known = [x for n in self._manifests() for x in self._read_manifest(n)[0]]
        paths, gone = {x.path for x in known}, {x.gone for x in known}
        indexed = {x.path.rpartition("/")[2] for x in known}
        oldest = int((time.time() - self.lease) * 1000)
        old = lambda name: name[:13].isdigit() and int(name[:13]) <= oldest
        for m in self.files.names():
            if m.startswith("created_month="):
                for n in self.files.names(m):
                    if f"{m}/{n}" not in paths and old(n):
                        self.files.drop(m, n)
        for place, kept in (("_stage", set()), ("_gone", gone), ("_index", indexed)):
            for n in self.files.names(place):
                if n not in kept and old(n):
                    self.files.drop(place, n)

    def _name(self) -> str:
        return f"{int(time.time() * 1000):013d}-{uuid.uuid4().hex}"

    def _staged(self, rows: DataFrame) -> list[Folder]:
        """Rows (with created_month), written to folders that no manifest lists yet."""
        name = self._name()
        rows.write.partitionBy("created_month").parquet(f"{self.path}/_stage/{name}")
        out = []
        for m in self.files.names("_stage", name):
            if m.startswith("created_month="):
                self.files.move(f"_stage/{name}/{m}", f"{m}/{name}")
                out.append(f"{m}/{name}")
        self.files.drop("_stage", name)
        return self._described(out)

    def _described(self, paths: list[str]) -> list[Folder]:
        """Folders as manifests have them, with skip data if they are large."""
        if not paths:
            return []
        rows = self._raw(paths).select("id", *skipping.COLUMNS, skipping.file_of().alias("_file"))
        counted = {r.folder: r for r in rows.groupBy(skipping.folder_of().alias("folder")).agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).collect()}
        size = {p: sum(self.files.sizes(p).values()) for p in paths}
        # one name for all months of a change
        large = sum(size.values()) >= self.index_bytes
        if large and counted:
            skipping.build(rows).write.mode("overwrite").parquet(f"{self.path}/_index/{paths[0].rpartition('/')[2]}")
        return [Folder(p, c.n, size[p], c.low, c.high, large) for p in paths if (c := counted.get(p))]

    def create(self) -> None:
        """An empty table, if there is none. Columns that later versions add are null in older rows."""
        if not self._manifests():
            self._commit(1, [])

    # reading

    def months(self) -> list[int]:
        return sorted({x.month for x in self._live()})

    _more = ""

    def _raw(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(f"{LOG}{self._more}, created_month int").option("basePath", self.path).parquet(*(f"{self.path}/{x}" for x in paths))

    def _stored(self, live: list[Folder], files: list[str] | None = None, placed: bool = False) -> DataFrame:
        """Rows of these folders, or of these of their files, with all that is stored of them, without the deleted ones; placed: with _file and _row."""
        schema = f"{LOG}{self._more}, created_month int" + ", _file string, _row long" * placed
        paths = [x.path for x in live] if files is None else files
        if not paths:
            return self.spark.createDataFrame([], schema)
        cut = {x.path: x for x in live if x.gone}
        own = [p for p in paths if (p if files is None else p.rpartition("/")[0]) in cut]
        whole = [p for p in paths if p not in set(own)]
        at = [skipping.file_of().alias("_file"), F.col("_metadata.row_index").alias("_row")]
        columns = [x.split()[0] for x in f"{LOG}{self._more}".split(", ")] + ["created_month"]
        out = self._raw(whole).select(*columns, *(at if placed else [])) if whole else None
        if own:
            gone = self._gone(list(cut.values())).withColumnRenamed("file", "_f")
            rows = self._raw(own).select(*columns, *at)
            # bounded by GONE_BLOCKS
            left = rows.join(F.broadcast(gone), (F.col("_file") == F.col("_f")) & (F.floor(F.col("_row") / skipping.BITS) == F.col("block")), "left")
            left = left.where(~F.coalesce(skipping.is_set(F.col("bits"), F.col("_row") % skipping.BITS), F.lit(False))).select(*columns, *(["_file", "_row"] if placed else []))
            out = left if out is None else out.unionByName(left)
        return out

    def _gone(self, live: list[Folder]) -> DataFrame:
        """file, block, bits of the deleted rows of these folders."""
        names = sorted({x.gone for x in live if x.gone})
        if not names:
            return self.spark.createDataFrame([], _GONE).drop("folder")
        # a table of deleted rows may have some of folders that have a newer one
        mine = F.broadcast(self.spark.createDataFrame([(x.path, x.gone) for x in live if x.gone], "folder string, gone string"))
        found = self.spark.read.schema(_GONE).parquet(*(f"{self.path}/_gone/{n}" for n in names)).withColumn("gone", F.regexp_extract("_metadata.file_path", r"_gone/([^/]+)/", 1))
        return found.join(mine, ["folder", "gone"]).select("file", "block", "bits")

    def _read(self, live: list[Folder], files: list[str] | None = None) -> DataFrame:
        return self._stored(live, files)

    def scan(self, ttl_days: int | None = None, now: datetime.datetime | None = None) -> DataFrame:
        """All rows, with created_month; with ttl_days without those that are older, whether or not they are pruned yet."""
        rows = self._read(self._live())
        return rows if ttl_days is None else rows.where(~F.coalesce(expired(cutoff(ttl_days, now)), F.lit(False)))

    #: Columns by whose values whole files may be left out.
    _skips = skipping.COLUMNS

    def _candidates(self, live: list[Folder], wanted: dict[str, str]) -> list[str] | None:
        """Files of these folders that can hold rows with these values; None: all."""
        indexed = [x for x in live if x.indexed]
        if not wanted or not indexed:
            return None
        names = sorted({x.path.rpartition("/")[2] for x in indexed})
        found = skipping.candidates(self.spark.read.parquet(*(f"{self.path}/_index/{n}" for n in names)), wanted)
        there = {x.path for x in indexed}
        own = [r.file for r in found.collect() if r.file.rpartition("/")[0] in there]
        return own + [f"{x.path}/{n}" for x in live if not x.indexed for n in self.files.names(x.path) if n.endswith(".parquet")]

    def _within(self, tenant: str | None, f: query.Filters, cursor: str | None, as_time: bool) -> tuple[list[Folder], dict[str, str]]:
        """Folders that dates and cursor leave, and the values that filters ask for."""
        live = [x for x in self._live() if not cursor or x.low is None or x.low < cursor]
        for value, outside in ((f.start, lambda m, b: m < b), (f.end, lambda m, b: m > b)):
            if value and not as_time and len(value) >= 7 and (value[:4] + value[5:7]).isdigit():
                live = [x for x in live if not outside(x.month, int(value[:4] + value[5:7]))]
        wanted = {"tenant_id": tenant, "actor_id": f.actor_id, "action": f.action, "entity_id": f.entity_id}
        return live, {c: v for c, v in wanted.items() if v and c in self._skips}

    def find(self, tenant: str | None = None, f: query.Filters = query.Filters(), cursor: str | None = None, as_time: bool = False) -> DataFrame:
        """Rows that fulfil this. Folders that dates or the cursor exclude, and files that cannot hold the values, are not opened."""
        live, wanted = self._within(tenant, f, cursor, as_time)
        return query.filtered(self._read(live, self._candidates(live, wanted)), tenant, f, cursor, as_time=as_time)

    def ahead(self, tenant: str | None, f: query.Filters = query.Filters(), cursor: str | None = None, limit: float | None = None, most: int = query.MAX_PAGE, as_time: bool = False) -> tuple[list[Row], list[int]]:
        """One page's rows, newest first, and one row beyond if there are more; and the months that were opened.

        Months are opened from the newest ids on, each time twice as many, and no more once the page is full and what is left has lesser ids only. So a page of a
        busy tenant opens one month, and one of a tenant without rows opens each month once or twice."""
        live, wanted = self._within(tenant, f, cursor, as_time)
        by: dict[int, list[Folder]] = {}
        for x in live:
            by.setdefault(x.month, []).append(x)
        top = lambda own: max(x.high or "" for x in own)
        months = sorted(by.values(), key=top, reverse=True)
        found: list[Row] = []
        taken, step = 0, 1
        while taken < len(months) and not (len(found) > query.clamp(limit, most) and found[-1].id > top(months[taken])):
            taken, step = min(len(months), taken + step), 2 * step
            own = [x for m in months[:taken] for x in m]
            found = query.page(self._read(own, self._candidates(own, wanted)), tenant, f, cursor, limit, most, as_time=as_time).select(*COLUMNS).collect()
        return found, [m[0].month for m in months[:taken]]

    def page(self, tenant: str | None, f: query.Filters = query.Filters(), cursor: str | None = None, limit: float | None = None, most: int = query.MAX_PAGE) -> tuple[list[Row], str | None]:
        """A page's rows, newest first, and the cursor of the next."""
        found, _ = self.ahead(tenant, f, cursor, limit, most)
        n = query.clamp(limit, most)
        return found[:n], found[n - 1].id if len(found) > n else None

    def present(self, ids: DataFrame) -> DataFrame:
        """Those of ids (id) that are there. Folders whose ids do not reach into theirs are not opened."""
        span = ids.agg(F.min("id").alias("low"), F.max("id").alias("high")).first()
        own = [x for x in self._live() if span.low is not None and x.low is not None and x.low <= span.high and x.high >= span.low]
        return ids.join(self._read(own).select("id"), "id", "left_semi")

    # writing

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        """By month and tenant, so that files hold few tenants each, and by id in it."""
        return rows.repartitionByRange("created_month", "tenant_id", "id").sortWithinPartitions("created_month", "tenant_id", "id")

    def insert(self, logs: DataFrame, seq: str = "id", batch: Batch | None = None) -> None:
        """Add rows whose id isn't there; of rows with one id the first. Only ids of the rows' own months are read, in folders whose ids reach into theirs.

        An id holds its time, so one that comes again has the same month. A table without rows takes the rows as they are read once, without their ids' range.
        batch: the stream and number that these rows are of, noted with them in one step; a batch that the table has is not read again. A stream's batches come in order."""
        if batch and self.has(batch):
            return
        new = logs.withColumn("created_month", month(F.col("created_at")))
        span: dict[int, Row] = {}
        staged = lambda own: self._staged(self._laid_out(own.select(*COLUMNS, "created_month")))

        def make(live: list[Folder], _: int) -> Change:
            if not live:
                # rests on all months: if another change comes first, ids are sought in what it added
                return Change([], staged(first_write(new, seq)))
            if not span:
                found = new.groupBy("created_month").agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()
                span.update({NO_MONTH if r.created_month is None else r.created_month: r for r in found})
            if not span:
                return Change([], [])
            there = [x for x in live if x.month in span and x.low is not None and x.low <= span[x.month].high and x.high >= span[x.month].low]
            return Change([], staged(insert_if_absent(new, self._read(there), seq) if there else first_write(new, seq)), set(span))

        self._change(make, batch)

    def _marked(self, own: list[Folder], doomed: DataFrame) -> list[Folder]:
        """These folders without the rows of doomed (_file, _row). Folders without rows are left out."""
        name, at = self._name(), f"{self.path}/_gone/"
        new = doomed.groupBy(F.col("_file").alias("file"), F.floor(F.col("_row") / skipping.BITS).alias("block")).agg(F.bitmap_construct_agg((F.col("_row") % skipping.BITS).cast("long")).alias("bits"))
        all_ = new.unionByName(self._gone(own)).groupBy("file", "block").agg(F.bitmap_or_agg("bits").alias("bits"))
        all_.select(skipping.folder_of("file").alias("folder"), "file", "block", "bits").write.parquet(at + name)
        made = self.spark.read.schema(_GONE).parquet(at + name).groupBy("folder").agg(F.sum(F.bitmap_count("bits")).alias("rows"), F.count("*").alias("blocks")).collect()
        by = {r.folder: r for r in made}
        out = [replace(x, gone=name, gone_rows=by[x.path].rows, gone_blocks=by[x.path].blocks) if x.path in by and by[x.path].rows > x.gone_rows else x for x in own]
        return [x for x in out if x.gone_rows < x.rows]

    def _delete(self, own: list[Folder], live: list[Folder], doomed: Callable[[DataFrame], DataFrame], months: set[int] | None, removed: list[Folder]) -> Change | None:
        """Delete doomed(rows) from folders own, and the folders removed, in one change: by bitmaps while the table may have more of them, else by writing the folders anew."""
        rows = self._stored(own, placed=True)
        left = self._marked(own, doomed(rows).select("_file", "_row")) if own else []
        changed = {x.path for x in own} - {x.path for x in left if x in own}
        left = [x for x in left if x.path in changed]
        others = [x for x in live if x.path not in changed and x not in removed]
        if sum(x.gone_blocks for x in [*others, *left]) > GONE_BLOCKS:
            left = self._staged(self._laid_out(self._stored(left)))
        return Change(removed + [x for x in own if x.path in changed], left, months)

    def prune(self, cutoff: str, tenant: str | None = None, whole_months: bool = False) -> None:
        """Remove rows before cutoff (of one tenant if given). Months before it go whole; of cutoff's own rows are deleted, unless whole_months. All in one change."""
        at = int(cutoff[:4] + cutoff[5:7])

        def make(live: list[Folder], _: int) -> Change | None:
            removed = [x for x in live if x.month < at and tenant is None]
            own = [] if whole_months else [x for x in live if x.month <= at and x not in removed]
            gone = expired(cutoff) if tenant is None else expired(cutoff) & (F.col("tenant_id") == tenant)
            return self._delete(own, live, lambda rows: rows.where(gone), {x.month for x in removed + own}, removed)

        self._change(make)

    def delete_batch(self, cutoff: str, rows: int) -> None:
        """Remove `rows` rows before cutoff at most, oldest first by id. One small file tells which."""
        at = int(cutoff[:4] + cutoff[5:7])

        def make(live: list[Folder], _: int) -> Change | None:
            own = [x for x in live if x.month <= at]
            return self._delete(own, live, lambda r: oldest_expired(r, cutoff, rows), {x.month for x in own}, [])

        self._change(make)

    def compact(self, many: int = MANY) -> None:
        """Put months of `many` folders or more in one, without their deleted rows, and those of which half the rows are deleted."""

        def make(live: list[Folder], _: int) -> Change | None:
            by: dict[int, list[Folder]] = {}
            for x in live:
                by.setdefault(x.month, []).append(x)
            worn = lambda own: 2 * sum(x.gone_rows for x in own) >= sum(x.rows for x in own)
            full = [x for own in by.values() if len(own) >= many or worn(own) for x in own]
            return Change(full, self._staged(self._laid_out(self._stored(full))), {x.month for x in full}) if full else None

        self._change(make)
        self.recover()


class AppendTable(AuditTable):
    """Inserts are plain appends; of rows with one tenant and id, scans return the last that was written."""

    _more = ", _written long"
    #: A row's last version may lack a value that an earlier one has, so files are left out by the key alone.
    _skips = ("tenant_id",)

    def _read(self, live: list[Folder], files: list[str] | None = None) -> DataFrame:
        return last_write(self._stored(live, files), "_written").drop("_written")

    def raw(self) -> DataFrame:
        """All rows as they were written, repeated ones too; _written tells their order."""
        return self._stored(self._live())

    def insert(self, logs: DataFrame, seq: str = "id", batch: Batch | None = None) -> None:
        """Add rows. A null tenant is the empty one, as such a store has it. Of rows with one tenant and id in logs, the last by seq is the last.

        batch: the stream and number that these rows are of. They are noted with the rows, and a batch that comes again adds none."""

        def make(_: list[Folder], number: int) -> Change:
            # its number orders the rows, so an insert that comes second is made anew
            rows = last_write(logs.withColumn("tenant_id", F.coalesce("tenant_id", F.lit(""))), seq).select(*COLUMNS, F.lit(number << 32).cast("long").alias("_written"), month(F.col("created_at")).alias("created_month"))
            return Change([], self._staged(self._laid_out(rows)))

        self._change(make, batch)


def cutoff(days: int, now: datetime.datetime | None = None) -> str:
    """The time before which rows are older than so many days."""
    at = (now or datetime.datetime.now(datetime.UTC)) - datetime.timedelta(days=days)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
