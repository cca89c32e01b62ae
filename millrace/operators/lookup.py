"""Keyed lookups: joins, key tests, row comparison and expansion.

A lookup never holds or finds null keys, nor empty text keys; which side Spark
broadcasts, hashes or sorts is left to its size statistics and to adaptive
execution.  What happens to rows with and without matches is said by actions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..errors import RESERVED, fail_when, require, require_columns
from ..workspace import unused, written
from .ordering import numbered, running_sum, with_previous

KEEP, REMOVE, FAIL = "keep", "remove", "fail"


@dataclass(frozen=True)
class Action:
    """keep, remove or fail; with `set` columns get new values first."""

    mode: str = KEEP
    set: dict[str, Column] = field(default_factory=dict)


#: Names that lookups use beside a caller's columns.
_OWN = re.compile(r"__(hit|more|outcome|row|left|right|at|side|last|first|place|([kit]\d+)|r_.*)")


def _clash_free(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator on a left side whose columns of such names go by others meanwhile."""

    @wraps(operator)
    def run(left: DataFrame, right: DataFrame, keys: list[str] | dict[str, str], *args, **options) -> DataFrame:
        clashing = [c for c in left.columns if _OWN.fullmatch(c.lower())]
        if not clashing:
            return operator(left, right, keys, *args, **options)
        mark = uuid.uuid4().hex[:8]
        names = {c: f"own_{mark}_{i}" for i, c in enumerate(clashing)}
        renamed = {names.get(k, k): v for k, v in _pairs(keys).items()}
        out = operator(left.withColumnsRenamed(names), right, renamed, *args, **options)
        return out.withColumnsRenamed({v: k for k, v in names.items()})

    return run


def _pairs(keys: list[str] | dict[str, str]) -> dict[str, str]:
    return keys if isinstance(keys, dict) else {k: k for k in keys}


def lookup(right: DataFrame, keys: list[str], where: Column | None = None) -> DataFrame:
    """The rows of right that a lookup by `keys` holds: a single null or empty key is not held."""
    require_columns(right, *keys)
    rows = right.where(where) if where is not None else right
    if len(keys) == 1:
        k = F.col(keys[0])
        rows = rows.where(k.isNotNull() & (k != "") if isinstance(right.schema[keys[0]].dataType, T.StringType) else k.isNotNull())
    return rows


def _prepared(right: DataFrame, keys: dict[str, str], columns: dict[str, str], where: Column | None) -> DataFrame:
    held = lookup(right, list(keys.values()), where)
    names = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys.values())]
    return held.select(*names, *[F.col(s).alias(f"__r_{t}") for t, s in columns.items()], F.lit(True).alias("__hit"))


def _condition(keys: dict[str, str]) -> Column:
    """Several key columns: a null equals a null.  One: plain equality."""
    equal = [(F.col(k).eqNullSafe(F.col(f"__k{i}")) if len(keys) > 1 else F.col(k) == F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return reduce(lambda a, b: a & b, equal)


def _added(keys: dict[str, str], columns) -> list[str]:
    """Names of the columns that a match adds."""
    return [*[f"__k{i}" for i in range(len(keys))], *[f"__r_{c}" for c in columns], "__hit"]


def _acted(rows: DataFrame, state: Column, action: Action, code: str, keys: dict[str, str]) -> DataFrame:
    for name, value in action.set.items():
        rows = rows.withColumn(name, F.when(state, value).otherwise(F.col(name) if name in rows.columns else F.lit(None)))
    if action.mode == REMOVE:
        return rows.where(~state)
    if action.mode == FAIL:
        first = rows.columns[0]
        return rows.withColumn(first, fail_when(state, F.col(first), code, F.to_json(F.struct(*keys))))
    return rows


@_clash_free
def join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str] | dict[str, str],
    columns: list[str] | dict[str, str],
    no_match: Action = Action(),
    match_where: Column | None = None,
    match_limit: int | None = None,
    match_order: list[str] | None = None,
    too_many: Action | None = None,
    match_set: dict[str, Callable[[Callable[[str], Column]], Column]] | None = None,
) -> DataFrame:
    """A row for each match, with `columns` (target to right source) copied over.

    A left row without a match is kept with its own columns unless no_match says
    otherwise; a target column that left has keeps left's value there.
    match_limit keeps a key's first matches by match_order; keys with more meet
    too_many.  match_set adds values made of the match: {target: f}, where
    f(right) has right("column") for the copied columns."""
    keys = _pairs(keys)
    columns = columns if isinstance(columns, dict) else {c: c for c in columns}
    require_columns(left, *keys)
    held = _prepared(right, keys, columns, match_where)
    if match_limit is not None:
        require(bool(match_order), "a match limit needs an order")
        names = [f"__k{i}" for i in range(len(keys))]
        held_all = lookup(right, list(keys.values()), match_where)
        place = F.row_number().over(Window.partitionBy(*keys.values()).orderBy(*match_order))
        limited = held_all.withColumn("__place", place).where(F.col("__place") <= match_limit + 1)
        if too_many:  # a key's rows are told apart before the join, which only a left row without a match leaves without a key
            limited = limited.withColumn("__more", F.max("__place").over(Window.partitionBy(*keys.values())) > match_limit)
        limited = limited.where(F.col("__place") <= match_limit)
        held = limited.select(*[F.col(k).alias(n) for k, n in zip(keys.values(), names)], *[F.col(s).alias(f"__r_{t}") for t, s in columns.items()], F.lit(True).alias("__hit"), *(["__more"] if too_many else []))
    rows = left.join(held, _condition(keys), "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    if match_limit is not None and too_many:
        rows = _acted(rows, F.coalesce("__more", F.lit(False)), too_many, "TooManyMatch", keys)
    for target in columns:
        value = F.col(f"__r_{target}")
        rows = rows.withColumn(target, F.when(hit, value).otherwise(F.col(target)) if target in left.columns else value)
    for target, make in (match_set or {}).items():
        made = make(lambda c: F.col(f"__r_{c}"))
        rows = rows.withColumn(target, F.when(hit, made).otherwise(F.col(target)) if target in rows.columns else F.when(hit, made))
    rows = _acted(rows, ~hit, no_match, "NoMatch", keys)
    return rows.drop(*_added(keys, columns), *(["__more"] if match_limit is not None and too_many else []))


@_clash_free
def key_test(left: DataFrame, right: DataFrame, keys: list[str] | dict[str, str], match: Action = Action(), no_match: Action = Action(), match_where: Column | None = None, first_by: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    """Acts on rows by whether their key is in right: removal is a semi or anti join.

    With first_by, `match.set` may use `columns` of the first match as __r_<column>."""
    keys = _pairs(keys)
    require_columns(left, *keys)
    plain = not (match.set or no_match.set or FAIL in (match.mode, no_match.mode))
    held = _prepared(right, keys, {}, match_where).drop("__hit")
    if plain and no_match.mode == REMOVE and match.mode == REMOVE:
        return left.limit(0)
    if plain and no_match.mode == REMOVE:
        return left.join(held, _condition(keys), "left_semi")
    if plain and match.mode == REMOVE:
        return left.join(held, _condition(keys), "left_anti")
    if plain:
        return left
    firsts = first_match(right, list(keys.values()), first_by, columns or [], match_where) if first_by else _prepared(right, keys, {}, match_where).distinct()
    rows = left.join(firsts, _condition(keys), "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    rows = _acted(_acted(rows, hit, match, "Match", keys), ~hit, no_match, "NoMatch", keys)
    return rows.drop(*_added(keys, columns or []))


def first_match(right: DataFrame, keys: list[str], order: list[str], columns: list[str], where: Column | None = None) -> DataFrame:
    """The first row of each key by `order`, as __k<i>, __r_<column>, __hit."""
    held = lookup(right, keys, where)
    row = F.min_by(F.struct(*[F.col(c).alias(f"__r_{c}") for c in columns], F.lit(True).alias("__hit")), F.struct(*order)).alias("__row")
    return held.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(row).select(*[f"__k{i}" for i in range(len(keys))], "__row.*")


def equal_columns(columns: list[str]) -> Callable[[Callable, Callable], Column]:
    """Rows are equal if these columns are; null equals null."""
    return lambda l, r: reduce(lambda a, b: a & b, [l(c).eqNullSafe(r(c)) for c in columns])


def equal_all_columns(left: DataFrame, right: DataFrame, ignoring: list[str] = ()) -> Callable[[Callable, Callable], Column]:
    """All columns of both sides but the ignored; one that a side lacks is null there."""
    names = [c for c in dict.fromkeys([*left.columns, *right.columns]) if c not in ignoring and c not in RESERVED]
    value = lambda get, frame, c: get(c) if c in frame.columns else F.lit(None)
    return lambda l, r: reduce(lambda a, b: a & b, [value(l, left, c).eqNullSafe(value(r, right, c)) for c in names])


@_clash_free
def compare_rows(
    left: DataFrame,
    right: DataFrame,
    keys: list[str] | dict[str, str],
    equal: Callable[[Callable, Callable], Column],
    order: list[str],
    same: Action = Action(),
    different: Action = Action(),
    no_match: Action = Action(),
    status: str | None = None,
) -> DataFrame:
    """Each left row against the first right row of its key: same, different or without match, each with an action.
    `set` values may use right's columns as __r_<column>.  status names a column for the outcome."""
    keys = _pairs(keys)
    firsts = first_match(right, list(keys.values()), order, right.columns)
    rows = left.join(firsts, _condition(keys), "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    alike = hit & equal(F.col, lambda c: F.col(f"__r_{c}"))
    outcome = F.when(~hit, "no_match").when(alike, "same").otherwise("different")
    rows = rows.withColumn("__outcome", outcome)
    for name, action, code in (("same", same, "Match"), ("different", different, "Match"), ("no_match", no_match, "NoMatch")):
        rows = _acted(rows, F.col("__outcome") == name, action, code, keys)
    if status:
        rows = rows.withColumn(status, F.col("__outcome"))
    return rows.drop(*_added(keys, right.columns), "__outcome")


@_clash_free
def expand(
    left: DataFrame,
    right: DataFrame,
    keys: list[str] | dict[str, str],
    columns: dict[str, str] | list[str],
    identity: list[str],
    condition: Column | None = None,
    best: Column | None = None,
    no_match: Action = Action(),
    between: tuple[Column, Column | None, Column | None] | None = None,
) -> DataFrame:
    """left with `columns` of one right row of its key: of those that meet `condition` (over left's columns and
    right's as __r_<column>) the one with the largest `best`.  identity names columns that tell left's rows apart.

    between = (value, low, high): of the right rows whose value (over __r_<column>) is in low to high (over left's columns;
    None or null: open) the one with the largest `best` (over __r_<column>), found by an interval index: a left row meets
    2 * INDEX_BIN rows and two nodes a level at most, however many its range holds.  See _best_in_range.

    With a free condition, only identity, keys and candidates are grouped, by a maximum with partial
    aggregation, so a key with very many candidates is not gathered; but each left
    row meets every candidate of its key.  Where the condition is that a value of
    the right row is at most one of the left row, and the nearest is best, use as_of."""
    keys = _pairs(keys)
    columns = columns if isinstance(columns, dict) else {c: c for c in columns}
    if between is not None:
        require(condition is None, "a range or a condition, not both")
        chosen = _best_in_range(left, right, keys, columns, identity, between, best if best is not None else F.lit(1))
        return _expanded(left, chosen, keys, columns, identity, no_match)
    held = _prepared(right, keys, {c: c for c in right.columns}, None)
    met = left.join(held, _condition(keys), "inner")
    met = met.where(condition) if condition is not None else met
    ids = [F.col(c).alias(f"__i{i}") for i, c in enumerate(identity)]
    row = F.struct(*[F.col(f"__r_{s}").alias(f"__r_{t}") for t, s in columns.items()], F.lit(True).alias("__hit"))
    chosen = met.groupBy(*ids).agg(F.max_by(row, best if best is not None else F.lit(1)).alias("__row")).select(*[f"__i{i}" for i in range(len(identity))], "__row.*")
    return _expanded(left, chosen, keys, columns, identity, no_match)


def _expanded(left: DataFrame, chosen: DataFrame, keys: dict[str, str], columns: dict[str, str], identity: list[str], no_match: Action) -> DataFrame:
    """left with the chosen rows' columns."""
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__i{i}")) for i, c in enumerate(identity)])
    rows = left.join(chosen, same, "left")
    rows = _copied(rows, columns, left.columns)
    rows = _acted(rows, ~F.coalesce(F.col("__hit"), F.lit(False)), no_match, "NoMatch", keys)
    return rows.drop(*_added({}, columns), *[f"__i{i}" for i in range(len(identity))])


#: Right rows in a bin of the interval index.
INDEX_BIN = 32


def _best_in_range(left: DataFrame, right: DataFrame, keys: dict[str, str], columns: dict[str, str], identity: list[str], between: tuple, best: Column) -> DataFrame:
    """(__i<i>, __r_<column>, __hit): for each left row, the right row with the largest `best` in its range.

    Right rows are numbered along one order of key and value and cut into bins of INDEX_BIN; a bin, and each aligned
    pair, pair of pairs and so on of bins, keeps its best row.  A left row's range is a run of numbers, found by sorting
    its ends among the right rows; it is covered by the rows at both ends and at most two nodes a level.  Runs lie inside
    a key, so nodes need no key, and neither a hot key nor a wide range is gathered."""
    value, low, high = between
    places = [f"__k{i}" for i in range(len(keys))]
    held = lookup(right, list(keys.values()))
    held = held.select(*[F.col(k).alias(p) for k, p in zip(keys.values(), places)], *[F.col(c).alias(f"__r_{c}") for c in right.columns]).withColumn("__v", value).where("__v is not null")
    row = F.struct(*[F.col(f"__r_{s}").alias(f"__r_{t}") for t, s in columns.items()], F.lit(True).alias("__hit"))
    rows = numbered(held.select(*places, "__v", best.alias("__best"), row.alias("__row")), [*places, "__v"], "__at").select("__at", "__best", "__row")

    # how many right rows stand before either end of each range
    kind = held.schema["__v"].dataType
    marks = held.select(*places, F.lit(0).alias("__open"), "__v", F.lit(1).alias("__side"), F.lit(None).cast(left.select(*identity).schema).alias("__id"))
    ends = []
    for side, end in ((0, low), (2, high)):
        end = F.lit(None).cast(kind) if end is None else end.cast(kind)
        beyond = F.when(end.isNull(), 1).otherwise(0) if side else F.lit(0)  # nulls come first, which is right for an open low end
        ends.append(left.select(*[F.col(k).alias(p) for k, p in zip(keys, places)], beyond.alias("__open"), end.alias("__v"), F.lit(side).alias("__side"), F.struct(*identity).alias("__id")))
    line = running_sum(marks.unionByName(ends[0]).unionByName(ends[1]), F.when(F.col("__side") == 1, 1).otherwise(0), [*places, "__open", "__v", "__side"], "__n")
    runs = line.where("__side <> 1").groupBy("__id").agg(F.max(F.when(F.col("__side") == 0, F.col("__n"))).alias("a"), F.max(F.when(F.col("__side") == 2, F.col("__n"))).alias("b")).where("a < b")
    # rows of the same run share one search of the index, so that a run that most rows have makes no node hot
    each = written(runs, "runs")
    runs = each.select("a", "b").distinct().withColumn("__id", F.struct("a", "b"))

    # the run [a, b) as parts of bins and as nodes: level, number, and for parts the run's ends
    probe = lambda level, node, a=F.lit(None).cast("long"), b=F.lit(None).cast("long"): F.struct(F.lit(level).cast("int").alias("level") if isinstance(level, int) else level.cast("int").alias("level"), node.cast("long").alias("node"), a.alias("from"), b.alias("to"))
    runs = runs.withColumns({"p": F.floor((F.col("a") + INDEX_BIN - 1) / INDEX_BIN), "q": F.floor(F.col("b") / INDEX_BIN)})
    a, b, p, q = (F.col(c) for c in "abpq")
    parts = F.when(p > q, F.array(probe(-1, q, a, b))).otherwise(
        F.concat(F.when(a < p * INDEX_BIN, F.array(probe(-1, p - 1, a, p * INDEX_BIN))).otherwise(F.array().cast("array<struct<level:int,node:bigint,from:bigint,to:bigint>>")), F.when(q * INDEX_BIN < b, F.array(probe(-1, q, q * INDEX_BIN, b))).otherwise(F.array().cast("array<struct<level:int,node:bigint,from:bigint,to:bigint>>")))
    )

    def nodes_of(level: Column) -> Column:
        first, end = F.ceil(p / F.pow(F.lit(2), level)).cast("long"), F.floor(q / F.pow(F.lit(2), level)).cast("long")
        inside = first < end
        left_node, right_node = F.when(inside & (first % 2 == 1), probe(level, first)), F.when(inside & (end % 2 == 1), probe(level, end - 1))
        return F.filter(F.array(left_node, right_node), lambda x: x.isNotNull())

    # above the level at which a run of bins is empty there is nothing to take
    levels = F.sequence(F.lit(0), F.greatest(F.ceil(F.log2(F.greatest(q - p, F.lit(1)).cast("double"))).cast("int") + 1, F.lit(1)))
    probes = runs.select("__id", F.explode(F.concat(parts, F.when(p < q, F.flatten(F.transform(levels, nodes_of))).otherwise(F.array().cast("array<struct<level:int,node:bigint,from:bigint,to:bigint>>")))).alias("x")).select("__id", "x.*")

    binned = rows.withColumn("node", F.floor(F.col("__at") / INDEX_BIN))
    bins = binned.groupBy("node").agg(F.max_by(F.struct("__best", "__row"), "__best").alias("x"))
    top = F.sequence(F.lit(0), F.lit(40))
    wanted = probes.where("level >= 0").agg(F.max("level").alias("top"))  # one number
    lifted = bins.join(F.broadcast(wanted)).select(F.explode(F.filter(top, lambda k: k <= F.col("top"))).alias("level"), F.col("node").alias("bin"), "x")
    nodes = lifted.groupBy("level", F.floor(F.col("bin") / F.pow(F.lit(2), F.col("level"))).cast("long").alias("node")).agg(F.max_by("x", F.col("x.__best")).alias("x"))
    items = binned.select(F.lit(-1).alias("level"), "node", "__at", "__best", "__row").union(nodes.select("level", "node", F.lit(None).cast("long"), "x.__best", "x.__row"))
    met = probes.join(items, ["level", "node"]).where(F.col("__at").isNull() | ((F.col("__at") >= F.col("from")) & (F.col("__at") < F.col("to"))))
    chosen = met.groupBy("__id").agg(F.max_by("__row", "__best").alias("__row")).select("__id.a", "__id.b", "__row")
    chosen = each.join(chosen, ["a", "b"])
    return chosen.select(*[F.col(f"__id.{c}").alias(f"__i{i}") for i, c in enumerate(identity)], "__row.*")


def _copied(rows: DataFrame, columns: dict[str, str], own: list[str]) -> DataFrame:
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    for t in columns:
        value = F.col(f"__r_{t}")
        rows = rows.withColumn(t, F.when(hit, value).otherwise(F.col(t)) if t in own else value)
    return rows


@_clash_free
def as_of(
    left: DataFrame,
    right: DataFrame,
    keys: list[str] | dict[str, str],
    at: str | Column,
    right_at: str | Column,
    columns: dict[str, str],
    ties: list[str] = (),
    no_match: Action = Action(),
) -> DataFrame:
    """left with columns of the right row of its key with the largest `right_at` that is not above `at`; of equal ones
    that with the largest `ties`, else any.  A left column of a copied column's name keeps its value without a match.

    Both sides are put on one line, sorted by key and value, and each left row
    takes the last right row before it.  The line is cut into buckets by sampled
    bounds, and what a bucket ends with is carried on: no pairs, and no task
    holds a key that most rows have."""
    keys = _pairs(keys)
    places = [f"__k{i}" for i in range(len(keys))]
    value = lambda c: F.col(c) if isinstance(c, str) else c
    kinds = {f"__t{i}": right.schema[c].dataType for i, c in enumerate(ties)} or {"__t0": T.LongType()}
    held = lookup(right, list(keys.values())).where(value(right_at).isNotNull())
    copied = F.struct(*[F.col(s).alias(f"__r_{t}") for t, s in columns.items()], F.lit(True).alias("__hit"))
    tie = [F.col(c).alias(t) for c, t in zip(ties, kinds)] if ties else [F.xxhash64(copied).alias("__t0")]
    rights = held.select(*[F.col(k).alias(p) for k, p in zip(keys.values(), places)], value(right_at).alias("__at"), F.lit(0).alias("__side"), *tie, F.lit(None).cast(left.schema).alias("__left"), copied.alias("__right"))
    lefts = left.select(*[F.col(k).alias(p) for k, p in zip(keys, places)], value(at).alias("__at"), F.lit(1).alias("__side"), *[F.lit(None).cast(kind).alias(t) for t, kind in kinds.items()], F.struct(*left.columns).alias("__left"), F.lit(None).cast(rights.schema["__right"].dataType).alias("__right"))
    last = F.when(F.col("__side") == 0, F.struct(*places, "__right"))
    rows = with_previous(lefts.unionByName(rights), {"__last": last}, [*places, "__at", "__side", *kinds], skip_nulls=True).where("__side = 1")
    same = reduce(lambda a, b: a & b, [F.col(p).eqNullSafe(F.col(f"__last.{p}")) for p in places]) & F.col("__at").isNotNull()
    rows = rows.select("__left.*", F.when(same, F.col("__last.__right")).alias("__right")).select(*left.columns, "__right.*")
    rows = _copied(rows, columns, left.columns)
    rows = _acted(rows, ~F.coalesce(F.col("__hit"), F.lit(False)), no_match, "NoMatch", keys)
    return rows.drop(*_added({}, columns))


def count_by_key(right: DataFrame, keys: list[str]) -> DataFrame:
    return lookup(right, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def rows_of_key(right: DataFrame, keys: dict[str, object], where: Column | None = None) -> DataFrame:
    rows = lookup(right, list(keys), where)
    for k, v in keys.items():
        rows = rows.where(F.col(k).eqNullSafe(F.lit(v)))
    return rows
