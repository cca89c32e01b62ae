"""Merging into a table of files: ordered, conditional clauses; only files that hold changed rows are written anew."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import StepFailed, require, require_columns
from ..sinks.journal import Journal, find_partitions
from ..workspace import unused, written

UPDATE, DELETE, INSERT = "update", "delete", "insert"


@dataclass(frozen=True)
class Clause:
    """What happens to rows of one kind that meet `where`: the first clause that fits a row counts.

    on: matched, missing_in_target or missing_in_source.  where and the values of `set` are columns over the target's rows as
    t.<column> and the source's as s.<column>.  Without `set`, all columns that the source has are taken from it."""

    on: str
    action: str
    where: Column | None = None
    set: dict[str, Column] | None = None

    def __post_init__(self):
        allowed = {"matched": (UPDATE, DELETE), "missing_in_target": (INSERT,), "missing_in_source": (UPDATE, DELETE)}
        require(self.on in allowed and self.action in allowed[self.on], f"no such clause: {self.on}, {self.action}")
        require(self.on != "missing_in_source" or self.action == DELETE or self.set is not None, "rows that the source lacks need values to be set")


class FileTable:
    """A catalogue table of files: where they are, how they are laid out."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
        facts = {r.col_name: r.data_type for r in rows}
        self.location, self.format = facts.get("Location"), (facts.get("Provider") or "").lower()
        columns = spark.catalog.listColumns(name)
        self.partitions = [c.name for c in columns if c.isPartition]
        require(bool(self.location) and not any(c.isBucket for c in columns), f"{name} is no table of plain files")

    def rows(self, files: list[str] | None = None) -> DataFrame:
        """All rows, or those of some files, with the file as __file."""
        table = self.spark.table(self.name)
        if files is None:
            out = table
        else:
            at = self.spark._jvm.org.apache.hadoop.fs.Path
            paths = [at(self.spark._jvm.java.net.URI(f)).toString() for f in files]
            out = self.spark.read.schema(table.schema).option("basePath", self.location).format(self.format).load(paths).select(*table.columns)
        return out.withColumn(unused(table, "__file"), F.col("_metadata.file_path"))

    def rewrite(self, files: list[str], rows: DataFrame, journal: Journal) -> None:
        """rows take the place of the files.  They are written beside the table first; a journal then moves them in and the old ones out."""
        stage = f"{self.location}/_stage_{uuid.uuid4().hex}"  # readers pass over names that begin so
        name = journal.prepare([("delete", stage)])
        writer = (rows.hint("rebalance", *self.partitions) if self.partitions else rows.hint("rebalance")).write.format(self.format)
        (writer.partitionBy(*self.partitions) if self.partitions else writer).save(stage)
        moves = [("move", f"{stage}/{f}", f"{self.location}/{f}") for f in journal.files.below(stage)]
        at = self.spark._jvm.org.apache.hadoop.fs.Path
        old = [("delete", at(self.spark._jvm.java.net.URI(f)).toString()) for f in files]
        journal.commit(name, [*moves, *old, ("delete", stage)])
        journal.run(name)
        self.spark.sql(f"REFRESH TABLE {self.name}")
        find_partitions(self.spark, self.name)


def _judged(target: DataFrame, source: DataFrame, keys: list[str], clauses: list[Clause], hit: str, which: str) -> DataFrame:
    """Each target row with its source row, if it has one, as t and s, and the number of its clause, null if none fits."""
    t, s = target.alias("t"), source.withColumn(hit, F.lit(True)).alias("s")
    rows = t.join(s, reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]), "left")
    matched = F.col(f"s.{hit}").isNotNull()
    found = F.lit(None).cast("int")
    for i in range(len(clauses) - 1, -1, -1):
        c = clauses[i]
        if c.on != "missing_in_target":
            fits = (matched if c.on == "matched" else ~matched) & F.coalesce(c.where if c.where is not None else F.lit(True), F.lit(False))
            found = F.when(fits, i).otherwise(found)
    return rows.withColumn(which, found)


def merge_into(spark: SparkSession, name: str, source: DataFrame, keys: list[str], clauses: list[Clause], journal: Journal | None = None) -> None:
    """Merges source into a table by null-safe keys, as the clauses say.

    Only files that hold a changed row are written anew, and new rows come in files of their own; the table, its
    partitioning and its properties stay.  A target row that several source rows would change fails the merge before
    anything is written.  The list of changed files, of which the table's own listing is longer, passes through the driver."""
    table = FileTable(spark, name)
    columns = spark.table(name).columns
    require_columns(spark.table(name), *keys)
    require_columns(source, *keys)
    source = written(source, "merge")
    file, hit, which = unused(columns, "__file"), unused([*columns, *source.columns], "__hit"), unused([*columns, *source.columns], "__which")
    changing = [c for c in clauses if c.on != "missing_in_target"]
    if any(c.on == "matched" for c in changing):
        twice = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(*keys)
        met = _judged(spark.table(name), source.join(twice, reduce(lambda a, b: a & b, [source[k].eqNullSafe(twice[k]) for k in keys]), "left_semi"), keys, clauses, hit, which)
        clash = met.where(F.col(f"s.{hit}").isNotNull() & F.col(which).isNotNull()).select(*[F.col(f"t.{k}") for k in keys]).limit(1).collect()
        if clash:
            raise StepFailed(f"TooManyMatch: several source rows change the row {clash[0].asDict()} of {name}")
    files = []
    if changing:
        files = [r[0] for r in _judged(table.rows(), source, keys, clauses, hit, which).where(F.col(which).isNotNull()).select(file).distinct().collect()]
    parts = []
    if files:
        rows = _judged(table.rows(files), source, keys, clauses, hit, which)
        gone = [i for i, c in enumerate(clauses) if c.action == DELETE]
        rows = rows.where(F.col(which).isNull() | ~F.col(which).isin(gone)) if gone else rows
        out = []
        for c in columns:
            value = F.col(f"t.{c}")
            for i, clause in enumerate(clauses):
                if clause.action == UPDATE:
                    new = clause.set.get(c) if clause.set is not None else F.col(f"s.{c}") if c in source.columns and c not in keys else None
                    value = value if new is None else F.when(F.col(which) == i, new).otherwise(value)
            out.append(value.alias(c))
        parts.append(rows.select(*out))
    inserts = [c for c in clauses if c.on == "missing_in_target"]
    if inserts:
        s, t = source.alias("s"), spark.table(name).select(*keys).alias("t")
        fresh = s.join(t, reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]), "left_anti")
        chosen = F.lit(None).cast("int")
        for i in range(len(inserts) - 1, -1, -1):
            chosen = F.when(F.coalesce(inserts[i].where if inserts[i].where is not None else F.lit(True), F.lit(False)), i).otherwise(chosen)
        fresh = fresh.withColumn(which, chosen).where(F.col(which).isNotNull())
        out = []
        for field in spark.table(name).schema:
            value = F.lit(None)
            for i, clause in enumerate(inserts):
                new = clause.set.get(field.name) if clause.set is not None else F.col(f"s.{field.name}") if field.name in source.columns else None
                value = value if new is None else F.when(F.col(which) == i, new).otherwise(value)
            out.append(value.cast(field.dataType).alias(field.name))
        parts.append(fresh.select(*out))
    if parts and (files or parts[-1].limit(1).count()):
        table.rewrite(files, reduce(DataFrame.union, parts), journal or Journal(spark))


def delete_from(spark: SparkSession, name: str, where: str | Column, journal: Journal | None = None) -> None:
    """Rows that meet the condition go; only files that hold one are written anew."""
    table = FileTable(spark, name)
    rows = table.rows()
    file = unused(spark.table(name), "__file")
    gone = F.coalesce(F.expr(where) if isinstance(where, str) else where, F.lit(False))
    files = [r[0] for r in rows.where(gone).select(file).distinct().collect()]
    if files:
        table.rewrite(files, table.rows(files).where(~gone).drop(file), journal or Journal(spark))
