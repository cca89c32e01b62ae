"""Catalogue and JDBC tables as sources, and jobs over catalogue tables.

A table that is read is never overwritten while it is read: changes are staged
in a table of their own and then moved over, so a failed job leaves the target.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StepFailed, require, require_columns
from ..sinks.journal import Journal, rename_table, replacing
from .merge import Clause, delete_from, merge_into

_procedures: dict[str, Callable[..., DataFrame]] = {}


def procedure(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Registers a named source."""
    _procedures[f.__name__] = f
    return f


def read_procedure(spark: SparkSession, name: str, **parameters) -> DataFrame:
    require(name in _procedures, f"no such procedure: {name}")
    return _procedures[name](spark, **parameters)


def read_table(spark: SparkSession, name: str, columns: list[str] | None = None, where: str | Column | None = None, order: list[str] | None = None, limit: int | None = None) -> DataFrame:
    df = spark.table(name)
    df = df.where(where) if where is not None else df
    df = df.orderBy(*order) if order else df
    df = df.limit(limit) if limit is not None else df
    return df.select(*columns) if columns else df


def read_query(spark: SparkSession, sql: str, **parameters) -> DataFrame:
    """A query with named parameters; a list stands for its values, separated by commas, as in IN (:ids), an empty one for a null."""
    args: dict[str, object] = {}
    for name, value in parameters.items():
        if isinstance(value, (list, tuple)):
            marks = [f"{name}__{i}" for i in range(len(value))]
            sql = re.sub(rf":{name}\b", ", ".join(f":{m}" for m in marks) or "NULL", sql)
            args.update(zip(marks, value))
        else:
            args[name] = value
    return spark.sql(sql, args=args or None)


def read_jdbc(spark: SparkSession, url: str, table_or_query: str, partition_column: str | None = None, bounds: tuple | None = None, partitions: int | None = None, **options) -> DataFrame:
    """A database table, or a query in parentheses; split by a numeric column if bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table_or_query).options(**options)
    if partition_column and bounds:
        reader = reader.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions or 8)
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, **options) -> DataFrame:
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("batchsize", batch).options(**options).mode(mode).save()
    return df


def merged(target: DataFrame, source: DataFrame, keys: list[str], mode: str = "upsert", when_missing: str = "keep") -> DataFrame:
    """target after source's rows are merged in by null-safe keys.

    mode: upsert, update_only or insert_only.  when_missing: what happens to target
    rows whose key source lacks, keep or delete.  Columns that source lacks keep
    target's values, null for new rows."""
    require(mode in ("upsert", "update_only", "insert_only"), f"no such mode: {mode}")
    require_columns(target, *keys)
    require_columns(source, *keys)
    values = [c for c in target.columns if c not in keys]
    t = target.select(*[F.col(k).alias(f"__t{i}") for i, k in enumerate(keys)], F.struct(*target.columns).alias("__t"), F.lit(True).alias("__in_t"))
    s = source.select(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)], F.struct(*source.columns).alias("__s"), F.lit(True).alias("__in_s"))
    same = reduce(lambda a, b: a & b, [F.col(f"__t{i}").eqNullSafe(F.col(f"__s{i}")) for i in range(len(keys))])
    how = {"upsert": "full", "update_only": "left", "insert_only": "full"}[mode]
    rows = t.join(s, same, how)
    in_t, in_s = F.coalesce("__in_t", F.lit(False)), F.coalesce("__in_s", F.lit(False))
    if when_missing == "delete":
        rows = rows.where(in_s)
    updated = in_s if mode != "insert_only" else in_s & ~in_t
    out = [F.when(in_t, F.col(f"__t.{k}")).otherwise(F.col(f"__s.{k}")).alias(k) for k in keys]
    for c in values:
        out.append((F.when(updated, F.col(f"__s.{c}")).otherwise(F.col(f"__t.{c}")) if c in source.columns else F.col(f"__t.{c}")).alias(c))
    return rows.select(*out).select(*target.columns)


class Tables:
    """Jobs over catalogue tables."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def replace(self, name: str, rows: DataFrame) -> None:
        """name holds rows, laid out and with properties as before; they are staged first, so rows may read name, and a failure at any point leaves it as it was."""
        stage = f"{name}__stage_{uuid.uuid4().hex[:12]}"
        try:
            self._stage(rows, stage, name)
            self.publish({name: stage})
        finally:
            self.drop(stage)

    def _stage(self, rows: DataFrame, stage: str, name: str) -> None:
        """Writes rows as a table like the table `name`, if that exists: format, partitions, buckets, comment and properties."""
        if not self.spark.catalog.tableExists(name):
            rows.write.saveAsTable(stage)
            return
        facts = {r.col_name: r.data_type for r in self.spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
        columns = self.spark.catalog.listColumns(name)
        writer, parts, buckets = rows.write.format(facts["Provider"]), [c.name for c in columns if c.isPartition], [c.name for c in columns if c.isBucket]
        writer = writer.partitionBy(*parts) if parts else writer
        (writer.bucketBy(int(facts["Num Buckets"]), *buckets) if buckets else writer).saveAsTable(stage)
        text = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        if own := [r for r in self.spark.sql(f"SHOW TBLPROPERTIES {name}").collect()]:
            self.spark.sql(f"ALTER TABLE {stage} SET TBLPROPERTIES ({', '.join(f'{text(r.key)} = {text(r.value)}' for r in own)})")
        if facts.get("Comment"):
            self.spark.sql(f"COMMENT ON TABLE {stage} IS {text(facts['Comment'])}")

    def publish(self, stages: dict[str, str]) -> None:
        """Each table becomes what its stage is, by renaming.  Replaced tables are kept until all are
        published; if one cannot be, they are put back and the stages are stages again.  What is done is in a journal
        first, so that a new driver can carry it through (`Journal.recover`) if this one dies."""
        journal = Journal(self.spark)
        steps = [replacing(name, stage) for name, stage in stages.items()]
        entry = journal.prepare([("drop_table", s) for s in stages.values()])
        journal.commit(entry, steps)
        done: list[tuple[str, str]] = []
        try:
            for _, name, stage, old in steps:
                for a, b in ([(name, old)] if self.spark.catalog.tableExists(name) else []) + [(stage, name)]:
                    self._rename(a, b)
                    done.append((a, b))
        except Exception:
            for a, b in reversed(done):
                self._rename(b, a)
            journal.close(entry)
            raise
        self.drop(*[old for _, _, _, old in steps])
        journal.close(entry)

    def _rename(self, old: str, new: str) -> None:
        rename_table(self.spark, old, new)

    def create(self, name: str, rows: DataFrame) -> None:
        rows.write.saveAsTable(name)

    def append(self, name: str, rows: DataFrame, defaults: dict[str, object] | None = None) -> None:
        for column, value in (defaults or {}).items():
            rows = rows.withColumn(column, F.lit(value))
        rows.select(*self.spark.table(name).columns).write.insertInto(name)

    def copy_into_existing(self, source: str, target: str, where: str | None = None, columns: dict[str, str] | None = None, defaults: dict[str, object] | None = None) -> None:
        rows = read_table(self.spark, source, where=where)
        rows = rows.select(*[F.col(s).alias(t) for t, s in columns.items()]) if columns else rows
        self.append(target, rows, defaults)

    def copy_into_new(self, source: str, target: str, where: str | None = None) -> None:
        read_table(self.spark, source, where=where).write.saveAsTable(target)

    def copy_structure(self, source: str, target: str) -> None:
        self.spark.table(source).limit(0).write.saveAsTable(target)

    def delete(self, name: str, where: str) -> None:
        delete_from(self.spark, name, where)

    def truncate(self, name: str) -> None:
        self.spark.sql(f"TRUNCATE TABLE {name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def drop_views(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP VIEW IF EXISTS {name}")

    def names(self, database: str | None = None) -> list[str]:
        return [t.name for t in self.spark.catalog.listTables(database) if not t.isTemporary]

    def execute(self, sql: str, **parameters) -> DataFrame:
        return self.spark.sql(sql, args=parameters or None)

    def merge(self, name: str, source: DataFrame, keys: list[str], mode: str = "upsert", when_missing: str = "keep") -> None:
        """As `merged`, in place: only files that hold changed rows are written anew."""
        require(mode in ("upsert", "update_only", "insert_only"), f"no such mode: {mode}")
        clauses = [Clause("matched", "update")] if mode != "insert_only" else []
        clauses += [Clause("missing_in_target", "insert")] if mode != "update_only" else []
        self.merge_into(name, source, keys, clauses + ([Clause("missing_in_source", "delete")] if when_missing == "delete" else []))

    def merge_into(self, name: str, source: DataFrame, keys: list[str], clauses: list[Clause]) -> None:
        """Merges by ordered clauses, each with its condition; see `merge.merge_into`."""
        merge_into(self.spark, name, source, keys, clauses)

    def require_key(self, name: str, keys: list[str]) -> None:
        """Fails if a key is null or not unique."""
        df = self.spark.table(name)
        null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
        if df.where(null).limit(1).count() or df.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise StepFailed(f"{name}: {keys} is no key")

    def load_staged(self, targets: dict[str, Callable[[], DataFrame]], finalize: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None, retries: int = 3, skip_empty: bool = True) -> None:
        """Loads every target into a staging table first; only when all are complete, they are published together:
        replaced, or as finalize(target, staged) says.  Publishing is tried again on failure, all of it, and is undone if it fails for good."""
        stages = {name: f"{name}__stage_{uuid.uuid4().hex[:12]}" for name in targets}
        finals = {}
        try:
            for name, make in targets.items():
                self._stage(make(), stages[name], name)
            for name, stage in stages.items():
                staged = self.spark.table(stage)
                if skip_empty and staged.limit(1).count() == 0:
                    continue
                finals[name] = stage
                if final := (finalize or {}).get(name):
                    finals[name] = f"{stage}_final"
                    self._stage(final(self.spark.table(name), staged), finals[name], name)
            for turn in range(retries + 1):
                try:
                    self.publish(finals)
                    break
                except Exception:
                    if turn == retries:
                        raise
        finally:
            self.drop(*stages.values(), *finals.values())
