"""What several operators share: written intermediate tables, distributed
ranks and connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Only a local-mode session may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints"
    return base.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, codec: str = "zstd") -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None:
                self.drop_path(table._scratch_path)

    def drop_path(self, path: str) -> None:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows in a batch that Spark hands to a Python worker, where rows hold whole texts.
TEXT_BATCH = 500


def text_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to TEXT_BATCH rows, so that long texts do not fill a worker.  Lower settings stay."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXT_BATCH:
        spark.conf.set(name, str(TEXT_BATCH))


class Recent:
    """A worker's memory of what it has derived, in two generations: whatever is asked for again moves to
    the young one; when that is full, it becomes the old one and the old one is forgotten."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def recall(self, keys: set) -> list:
        """Brings known keys into the young generation and returns those to be derived."""
        young, old, fresh = self.young, self.old, []
        for key in keys.difference(young):
            if key in old:
                young[key] = old[key]
            else:
                fresh.append(key)
        return fresh

    def age(self) -> None:
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young


#: Rows of a few numbers each that one task takes rather than a shuffle; their count is known before.
ONE_TASK = 1 << 17


def few(df: DataFrame, rows: int) -> DataFrame:
    """df in one partition, which spares the shuffles that follow, if its counted rows are at most ONE_TASK."""
    return df.coalesce(1) if rows <= ONE_TASK else df


def small_table(spark: SparkSession, columns: dict[str, pa.DataType], rows: list[tuple]) -> DataFrame:
    """A DataFrame of rows that the driver holds; it reaches the executors as Arrow data, without a Python worker."""
    values = list(zip(*rows)) if rows else [()] * len(columns)
    return spark.createDataFrame(pa.table([pa.array(v, t) for v, t in zip(values, columns.values())], names=list(columns)))


def small_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused_name(df: DataFrame, wanted: str) -> str:
    """A column name that df has not, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


#: Words of 64 row numbers that are broadcast at most (67 million rows and more); their count is known before.
MOST_WORDS = 1 << 20


def among(scratch: Scratch, df: DataFrame, row: str, numbers: DataFrame, keep: bool = True, most: int = MOST_WORDS) -> DataFrame:
    """df's rows whose number in the column `row` is among those of a one-column table, or with keep=False is not.

    Numbers are of monotonically_increasing_id, whose values lie close together: a word stands for 64 of them.  So the
    words go to the rows, which keep their place, and no text is shuffled; beyond `most` words how is left to Spark."""
    n, word, bits = (unused_name(df, x) for x in ("_n", "_word", "_bits"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(n).bitwiseAND(63).cast("int"))
    words = scratch.save(numbers.toDF(n).groupBy(F.shiftright(n, 6).alias(word)).agg(F.bit_or(bit).alias(bits)))
    words = F.broadcast(words) if words.count() <= most else words
    hit = F.coalesce(F.getbit(bits, F.col(row).bitwiseAND(63).cast("int")) == 1, F.lit(False))
    return df.join(words, F.shiftright(row, 6) == F.col(word), "left").where(hit if keep else ~hit).drop(word, bits)


def ranked(scratch: Scratch, df: DataFrame, keys: list[str], order: list[str], rank: str) -> DataFrame:
    """df with a gapless rank from 0 within each key, in the given order.

    A range sort puts each key into consecutive partitions, so a key that holds
    most rows is spread over many tasks; the rank is the row's place in its
    partition plus what the key has in earlier partitions.  Ties get ranks in any
    order.  The sorted rows are written, since a second sort may cut elsewhere.
    """
    spark = df.sparkSession
    at, part = unused_name(df, "_at"), unused_name(df, "_part")
    ordered = df.repartitionByRange(small_parts(spark), *keys, *order).sortWithinPartitions(*keys, *order)
    ordered = scratch.save(ordered.withColumn(at, F.monotonically_increasing_id()))
    ordered = ordered.withColumn(part, F.shiftright(at, 33))
    firsts = ordered.groupBy(*keys, part).agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = firsts.withColumn("_before", before).select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(part).alias("_p"), (F.col("_before") - F.col("_first")).alias("_shift")
    )
    same = F.col(part) == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    # one row for each key and partition that holds it: partitions + keys at most
    return ordered.join(firsts, same, "inner").withColumn(rank, F.col(at) + F.col("_shift")).select(*df.columns, rank)


def _united(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of the edges (a, b) of one task, by union and find."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in it:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def connected_components(scratch: Scratch, edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) of every node on an edge (a, b), longs; the component is its smallest node.

    Alternating large-star and small-star contraction: each round points
    neighbours at the smallest node they can see.  Only minima are grouped, so
    a node with very many edges is pre-aggregated, never gathered.  Edges that are
    at most `one_task`, counted, are united by one task.
    """
    current = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark, last = _mark(current), current
    if mark[0] <= one_task:
        return current.coalesce(1).mapInArrow(_united, "node long, component long")
    while mark[0]:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("low"))
        large = both.join(low, both.a == low.u).where("b > u").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), "low")
        small = large.join(least, large.a == least.u)
        small = small.select("b", "low").union(small.select("u", "low")).toDF("a", "b").where("a <> b").distinct()
        following = scratch.save(small)
        new_mark = _mark(following)
        scratch.drop(last)
        current = last = following
        if new_mark == mark:
            break
        mark = new_mark
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(current.select("b", "b").distinct()).toDF("node", "component")


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
    return row[0], row[1]
