"""An audit table in a database, by JDBC. The driver's jar has to be on Spark's class path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.operators.delivery import first_write
from auditmill.sources.schema import COLUMNS


#: Rows that one task reads, about; and tasks that look for ids before an insert, at most.
PART_ROWS, MOST_SPANS = 50_000, 64


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


class JdbcTable:
    """Inserts of ids that aren't there, scans, and deletion by time. Filters on a scan are pushed to the database."""

    def __init__(self, spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None, part_rows: int = PART_ROWS):
        self.spark, self.url, self.table, self.properties, self.part_rows = spark, url, table, dict(properties or {}), part_rows

    def create(self, kind: str = "VARCHAR(4000)") -> None:
        """The table, if it is not there."""
        columns = ", ".join(f"{c} {'VARCHAR(64) NOT NULL PRIMARY KEY' if c == 'id' else kind}" for c in COLUMNS)
        connection = self._connection()
        try:
            if not connection.getMetaData().getTables(None, None, self.table.upper(), None).next():
                connection.createStatement().executeUpdate(f"CREATE TABLE {self.table} ({columns})")
        finally:
            connection.close()

    def _connection(self):
        jvm = self.spark._jvm
        own = jvm.java.util.Properties()
        for k, v in self.properties.items():
            own.setProperty(k, v)
        if "driver" in self.properties:
            jvm.java.lang.Class.forName(self.properties["driver"], True, jvm.java.lang.Thread.currentThread().getContextClassLoader())
        return jvm.java.sql.DriverManager.getConnection(self.url, own)

    def bounds(self) -> list[str]:
        """Ids that part the table's rows in ranges of about part_rows each, from the table itself; none for a small table."""
        connection = self._connection()
        try:
            def first(sql: str) -> str | None:
                found = connection.createStatement().executeQuery(sql)
                return found.getString(1) if found.next() else None

            parts = -(-int(first(f"SELECT COUNT(*) FROM {self.table}")) // self.part_rows)
            # by the key's index
            found = [first(f"SELECT id FROM {self.table} ORDER BY id OFFSET {k * self.part_rows} ROWS FETCH NEXT 1 ROWS ONLY") for k in range(1, parts)]
            return sorted({x for x in found if x is not None})
        finally:
            connection.close()

    def _named(self, found: DataFrame) -> DataFrame:
        return found.select(*(F.col(next(x for x in found.columns if x.lower() == c)).alias(c) for c in COLUMNS))

    def _of(self, predicates: list[str]) -> DataFrame:
        """Rows of these predicates, which exclude one another: a task for each."""
        return self._named(self.spark.read.jdbc(self.url, self.table, predicates=predicates, properties=self.properties))

    def scan(self) -> DataFrame:
        """All rows, by ranges of ids: a task for each. Filters go to the database too."""
        at = [_quoted(x) for x in self.bounds()]
        if not at:
            return self._named(self.spark.read.jdbc(self.url, self.table, properties=self.properties))
        return self._of([f"id < {at[0]}", *(f"id >= {a} AND id < {b}" for a, b in zip(at[:-1], at[1:], strict=True)), f"id >= {at[-1]}"])

    def insert(self, logs: DataFrame, seq: str = "id") -> None:
        """Add rows whose id isn't there. Ids are looked for in the spans of time that the new ones come from, a task for each; an id's first eight digits are its minute."""
        new = first_write(logs, seq).select(*COLUMNS)
        spans = new.groupBy(F.substring("id", 1, 8).alias("at")).agg(F.min("id").alias("low"), F.max("id").alias("high")).orderBy("at").collect()
        if spans:
            # neighbours go together where there are more spans than tasks are worth
            each = -(-len(spans) // MOST_SPANS)
            parts = [spans[k : k + each] for k in range(0, len(spans), each)]
            there = self._of([" OR ".join(f"(id >= {_quoted(r.low)} AND id <= {_quoted(r.high)})" for r in own) for own in parts]).select("id")
            new.join(there, "id", "left_anti").select(*COLUMNS).write.jdbc(self.url, self.table, mode="append", properties=self.properties)

    def merge(self, logs: DataFrame, seq: str = "id", kind: str = "VARCHAR(4000)", update: bool = False) -> None:
        """Add rows whose id isn't there, all in one statement of the database (MERGE); with update, rows that are there become the new ones.

        Tasks write to a table beside this one, with columns of this kind, which is dropped after it. So a task that fails leaves nothing of the batch, and no ids are read.
        A driver that dies leaves the table beside (<name>_new_...). Of rows with one id in logs the first counts."""
        beside = f"{self.table}_new_{uuid.uuid4().hex[:12]}"
        connection = self._connection()
        try:
            run = lambda sql: connection.createStatement().executeUpdate(sql)
            run(f"CREATE TABLE {beside} ({', '.join(f'{c} VARCHAR(64) NOT NULL PRIMARY KEY' if c == 'id' else f'{c} {kind}' for c in COLUMNS)})")
            try:
                first_write(logs, seq).select(*COLUMNS).write.jdbc(self.url, beside, mode="append", properties=self.properties)
                change = f"WHEN MATCHED THEN UPDATE SET {', '.join(f'{c} = n.{c}' for c in COLUMNS if c != 'id')} " if update else ""
                run(f"MERGE INTO {self.table} AS o USING {beside} AS n ON o.id = n.id {change}WHEN NOT MATCHED THEN INSERT ({', '.join(COLUMNS)}) VALUES ({', '.join(f'n.{c}' for c in COLUMNS)})")
            finally:
                run(f"DROP TABLE {beside}")
        finally:
            connection.close()

    def prune(self, cutoff: str, tenant: str | None = None) -> None:
        connection = self._connection()
        try:
            statement = connection.prepareStatement(f"DELETE FROM {self.table} WHERE created_at < ?" + (" AND tenant_id = ?" if tenant is not None else ""))
            for i, value in enumerate([cutoff, *([tenant] if tenant is not None else [])], 1):
                statement.setString(i, value)
            statement.executeUpdate()
        finally:
            connection.close()
