"""Loading database tables in batches that are retried one by one, each with its line in a ledger.

Rows reach the database by Spark's own parallel writer, into a stage table.  From there each batch goes into its
target by SQL, in one transaction with a line in the ledger; so a batch that fails is tried again alone, and one that is
in the ledger is never done twice, even by another driver.  Only statements pass through the driver.
Where there is no server, `shards.Shards` is a database of files that tasks load in the same way.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StepFailed, require, require_columns
from ..workspace import unused, written
from .shards import Shards

LEDGER = "load_ledger"


class Database:
    """A database behind a JDBC URL that the driver and all executors reach."""

    def __init__(self, spark: SparkSession, url: str, **options: str):
        self.spark, self.url, self.options = spark, url, options
        self.dialect = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url)

    def quoted(self, name: str) -> str:
        return self.dialect.quoteIdentifier(name)

    def transaction(self, *statements: str) -> None:
        """All statements, or none of them."""
        properties = self.spark._jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        connection = self.spark._jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            connection.setAutoCommit(False)
            for sql in statements:
                statement = connection.createStatement()
                try:
                    statement.executeUpdate(sql)
                finally:
                    statement.close()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def read(self, table: str) -> DataFrame:
        return self.spark.read.format("jdbc").option("url", self.url).option("dbtable", table).options(**self.options).load()

    def write(self, rows: DataFrame, table: str, mode: str = "append", types: dict[str, str] | None = None) -> None:
        """types: the database's types of columns of a table that is made."""
        named = ", ".join(f"`{c}` {kind}" for c, kind in (types or {}).items() if c in rows.columns)
        writer = rows.write.option("createTableColumnTypes", named) if named else rows.write
        writer.format("jdbc").option("url", self.url).option("dbtable", table).options(**self.options).mode(mode).save()

    def exists(self, table: str) -> bool:
        """By the database's own metadata, whatever the letter case it keeps names in."""
        properties = self.spark._jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        connection = self.spark._jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            found = connection.getMetaData().getTables(None, None, "%", None)
            name = table.split(".")[-1].strip('"').lower()
            while found.next():
                if found.getString("TABLE_NAME").lower() == name:
                    return True
            return False
        finally:
            connection.close()

    def done(self, load: str) -> dict[int, int]:
        """Batches of a load that are in the ledger, with a number each; -1 has the number of batches."""
        rows = self.read(LEDGER).where(F.col("LOAD_ID") == load).select("BATCH", "ROW_COUNT").collect()
        return {r[0]: r[1] for r in rows}


def _batch_source(db: Database, stage: str, columns: list[str], number: int, batch: str, row: str, copy: str) -> str:
    """A batch's rows; of those that a repeated task has written twice, one."""
    names, b, r, c = ", ".join(db.quoted(x) for x in columns), db.quoted(batch), db.quoted(row), db.quoted(copy)
    return f"(SELECT {names} FROM {stage} o WHERE o.{b} = {number} AND NOT EXISTS (SELECT 1 FROM {stage} d WHERE d.{b} = {number} AND d.{r} = o.{r} AND d.{c} < o.{c}))"


def load(
    db: Database | Shards,
    rows: DataFrame,
    table: str,
    load_id: str,
    keys: list[str] | None = None,
    batch_rows: int = 10_000,
    retries: int = 3,
    wait: float = 1.0,
    types: dict[str, str] | None = None,
    before_commit: Callable[[int], list[str]] | None = None,
) -> int:
    """Rows into a database table in batches of about batch_rows; returns the number of batches done by this call.

    With `keys` a batch is merged: rows of a key that the table has replace it, others are added; null keys are always
    added, a key that rows has twice fails the load.  load_id names the load: called again with the same rows, it does the
    batches that are not in the ledger.  A row's batch follows from its values (its keys), so equal rows share one.
    types: the database's column types of a table that is made (text keys need one that compares).
    before_commit(batch) may add statements to a batch's transaction.  Columns that the table has and rows have not get its defaults."""
    require(batch_rows > 0 and retries >= 0, "batches need rows")
    require_columns(rows, *(keys or []))
    columns = rows.columns
    batch, row, copy = (unused(columns, x) for x in ("load_batch", "load_row", "load_copy"))
    rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "load")
    if keys and rows.dropna(subset=keys).groupBy(*keys).count().where("count > 1").limit(1).count():
        raise StepFailed(f"TooManyMatch: {keys} is no key of the rows to be merged into {table}")
    if isinstance(db, Shards):
        return db.load(rows.select(*columns), table, load_id, keys, batch_rows, retries, wait, types, before_commit)
    if not db.exists(LEDGER):
        db.transaction(f"CREATE TABLE {LEDGER} (LOAD_ID VARCHAR(200) NOT NULL, BATCH INT NOT NULL, ROW_COUNT BIGINT, PRIMARY KEY (LOAD_ID, BATCH))")
    if not db.exists(table):
        db.write(rows.select(*columns).limit(0), table, types=types)
    done, name = db.done(load_id), load_id.replace("'", "''")
    if -1 not in done:
        batches = max(1, -(-rows.count() // batch_rows))
        db.transaction(f"INSERT INTO {LEDGER} VALUES ('{name}', -1, {batches})")
        done[-1] = batches
    batches = done[-1]
    left = [n for n in range(batches) if n not in done]
    if not left:
        return 0
    stage = "load_stage_" + "".join(c if c.isalnum() else "_" for c in load_id)
    # drawn anew by every attempt of a task, unlike Spark's own random values
    drawn = F.java_method(F.lit("java.util.UUID"), F.lit("randomUUID"))
    staged = rows.withColumns({batch: F.pmod(F.xxhash64(*(keys or columns)), F.lit(batches)).cast("int"), copy: drawn})
    db.write(staged, stage, "overwrite", {copy: "VARCHAR(36)", **(types or {})})
    db.transaction(f"CREATE INDEX {stage}_i ON {stage} ({db.quoted(batch)}, {db.quoted(row)})")
    names = ", ".join(db.quoted(c) for c in columns)
    for number in left:
        source = _batch_source(db, stage, columns, number, batch, row, copy)
        statements = []
        if keys:
            same = " AND ".join(f"s.{db.quoted(k)} = {table}.{db.quoted(k)}" for k in keys)
            values = [f"{db.quoted(c)} = (SELECT s.{db.quoted(c)} FROM {source} s WHERE {same})" for c in columns if c not in keys]
            if values:
                statements.append(f"UPDATE {table} SET {', '.join(values)} WHERE EXISTS (SELECT 1 FROM {source} s WHERE {same})")
            statements.append(f"INSERT INTO {table} ({names}) SELECT {names} FROM {source} s WHERE NOT EXISTS (SELECT 1 FROM {table} WHERE {same})")
        else:
            statements.append(f"INSERT INTO {table} ({names}) SELECT {names} FROM {source} s")
        statements.append(f"INSERT INTO {LEDGER} VALUES ('{name}', {number}, (SELECT COUNT(*) FROM {source} s))")
        for turn in range(retries + 1):
            try:
                db.transaction(*statements, *(before_commit(number) if before_commit else []))
                break
            except Exception:
                # a commit whose answer was lost is in the ledger
                if number in db.done(load_id):
                    break
                if turn == retries:
                    raise
                time.sleep(wait * 2**turn)
    db.transaction(f"DROP TABLE {stage}")
    return len(left)
