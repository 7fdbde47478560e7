"""A table of rows with replayable operations: filter, sort, unique and count, decimate, split, transpose, undo and redo.

A Grid is a base table and a tuple of operations; its frame is the fold of these over the base, so undo drops the last operation,
redo puts it back, and replay folds them over another base. Rows carry _index (their place in the base) and _pos (their place as
shown). Positions are kept as an order key; where an operation needs places without gaps, they are counted by blocks of the old
positions, never in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import natural_key, to_double, unique_name
from ..session import written

BLOCK = 1 << 16
HIDDEN = ("_index", "_pos")


def renumbered(df: DataFrame, size: int = BLOCK) -> DataFrame:
    """_pos from 0 without gaps in the old order: counts by block of the old positions, running sums of these, places within blocks."""
    rows = df.withColumn("__b", F.floor(F.col("_pos") / size))
    counts = rows.groupBy("__b").agg(F.count("*").alias("__n"))
    starts = counts.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__s"))
    at = F.row_number().over(Window.partitionBy("__b").orderBy("_pos"))
    return rows.withColumn("__at", at).join(starts, "__b").withColumn("_pos", F.col("__s") + F.col("__at") - 1).drop("__b", "__at", "__s", "__n")


def cell(name: str) -> Column:
    """A cell for regular expressions: null is the text null."""
    return F.coalesce(F.col(name).cast("string"), F.lit("null"))


def member(name: str, values: list) -> Column:
    """Whether the cell is one of the values, case ignored; null only matches null."""
    texts = [str(v).lower() for v in values if v is not None]
    hit = F.coalesce(F.lower(F.col(name).cast("string")).isin(texts), F.lit(False))
    return hit | F.col(name).isNull() if None in values else hit


def regex(name: str, pattern: str) -> Column:
    return cell(name).rlike("(?i)" + pattern)


def selected(df: DataFrame, indexes: list[int] | DataFrame, how: str) -> DataFrame:
    """The rows whose _index is (left_semi) or isn't (left_anti) in a short list, or in a table with a column _index."""
    if isinstance(indexes, DataFrame):
        return df.join(indexes.select("_index"), "_index", how).select(df.columns)
    hit = F.col("_index").isin(indexes)
    return df.where(hit if how == "left_semi" else ~hit)


def hide_rows(df: DataFrame, indexes: list[int] | DataFrame) -> DataFrame:
    return selected(df, indexes, "left_anti")


def hide_others(df: DataFrame, indexes: list[int] | DataFrame) -> DataFrame:
    return selected(df, indexes, "left_semi")


def hide_above(df: DataFrame, pos: int) -> DataFrame:
    return renumbered(df).where(F.col("_pos") >= pos)


def hide_below(df: DataFrame, pos: int) -> DataFrame:
    return renumbered(df).where(F.col("_pos") <= pos)


def hide_matching(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(~member(column, values))


def keep_matching(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(member(column, values))


def show_regex(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(regex(column, pattern))


def hide_regex(df: DataFrame, column: str, pattern: str) -> DataFrame:
    return df.where(~regex(column, pattern))


def decimate(df: DataFrame, stride: int) -> DataFrame:
    """Rows shown at 0, stride, 2 stride...; strides under 2 change nothing."""
    return df if stride < 2 else renumbered(df).where(F.col("_pos") % stride == 0)


def unique_count(df: DataFrame, column: str) -> DataFrame:
    """The first row shown of each value, with how often it occurs to the right of the column; null and the empty text count together.

    Two combinable aggregates and a join: a value that most rows have is no task's burden.
    """
    value, name = F.coalesce(F.col(column).cast("string"), F.lit("")), f"{column} count"
    groups = df.groupBy(value.alias("__v"), F.col(column).isNull().alias("__null")).agg(F.min(F.struct("_pos", "_index")).alias("__f"), F.count("*").alias("__k"))
    counts = groups.groupBy("__v").agg(F.sum("__k").alias("__n"))
    firsts = groups.join(counts, "__v").select(F.col("__f._index").alias("__i"), "__n")
    out = df.join(firsts, F.col("_index") == F.col("__i"))
    if name in df.columns:
        return out.drop("__i", "__n")
    at = df.columns.index(column)
    return out.select(*df.columns[: at + 1], F.col("__n").alias(name), *df.columns[at + 1 :])


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds a column with each row's place from 0 in an order.

    Rows are dealt by ranges of the order's columns and numbered within each range, after what comes before it. The ranges are
    drawn from a sample, so they are written before anything is counted on them.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("__b", F.spark_partition_id()), "grid_sort")
    starts = ranged.groupBy("__b").agg(F.count("*").alias("__n")).select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__s"))
    at = F.row_number().over(Window.partitionBy("__b").orderBy(*order))
    return ranged.withColumn("__at", at).join(starts, "__b").withColumn(name, F.col("__s") + F.col("__at") - 1).drop("__b", "__at", "__s", "__n")


def sort_by(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Numbers by value (NaN last), texts in natural order with case ignored. Ties keep the order shown, turned round if descending."""
    numeric = dict(df.dtypes)[column] in ("double", "float", "int", "bigint", "smallint", "tinyint")
    key = F.col(column) if numeric else natural_key(F.col(column))
    rows = df.withColumn("__k", key)
    order = [F.desc_nulls_last("__k"), F.desc("_pos")] if descending else [F.asc_nulls_first("__k"), F.asc("_pos")]
    return placed(rows, order, "_pos").drop("__k")


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """The rows in an order that a seed and their places in the base fix."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_index").cast("string")))
    return placed(df.withColumn("__k", key), [F.asc("__k"), F.asc("_index")], "_pos").drop("__k")


def show_text(df: DataFrame, column: str, text: str, name: str = "match") -> DataFrame:
    """Adds whether the cell holds a text, case ignored; an empty text marks nothing."""
    return df.withColumn(name, F.contains(F.lower(cell(column)), F.lit(text.lower())) & F.lit(bool(text)))


def add_column(df: DataFrame, name: str, values: list | DataFrame, at: int | None = None) -> DataFrame:
    """A column of values by place shown (null where there are no more), at the right or at an ordinal: a short list, or a table with columns place and value."""
    if isinstance(values, DataFrame):
        side = values.select(F.col("place").cast("long").alias("__p"), F.col("value").alias(name))
    else:
        side = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(values)], f"__p long, `{name}` {'double' if values and isinstance(values[0], float) else 'string'}")
    joined = renumbered(df).join(side, F.col("_pos") == F.col("__p"), "left").drop("__p")
    shown = [c for c in df.columns if c not in HIDDEN]
    shown.insert(len(shown) if at is None else at, name)
    return joined.select(*shown, *HIDDEN)


def remove_column(df: DataFrame, name: str) -> DataFrame:
    return df.drop(name)


def move_column(df: DataFrame, name: str, after: str) -> DataFrame:
    """To the right of another column; "" is the left end; an unknown one changes nothing."""
    shown = [c for c in df.columns if c not in HIDDEN]
    if name not in shown or (after and after not in shown) or name == after:
        return df
    shown.remove(name)
    shown.insert(shown.index(after) + 1 if after else 0, name)
    return df.select(*shown, *HIDDEN)


def split_column(df: DataFrame, column: str, emit: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """Columns made from a column, to the right of it; taken names get a number."""
    shown = [c for c in df.columns if c not in HIDDEN]
    taken, made = set(shown), []
    for name, c in emit(F.col(column)).items():
        name = unique_name(name, taken)
        taken.add(name)
        made.append(c.alias(name))
    at = shown.index(column) + 1
    return df.select(*shown[:at], *made, *shown[at:], *HIDDEN)


def append_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (with an order column _index from 0) after all others."""
    top = df.agg(F.coalesce(F.max("_index"), F.lit(-1)), F.coalesce(F.max("_pos"), F.lit(-1))).first()
    more = rows.withColumn("_pos", F.col("_index") + top[1] + 1).withColumn("_index", F.col("_index") + top[0] + 1)
    return df.unionByName(more, allowMissingColumns=True)


def transpose(df: DataFrame) -> DataFrame:
    """Columns as rows: headers, row 1, row 2...; a table of that shape is turned back. For as many rows as a table may have columns."""
    shown = [c for c in df.columns if c not in HIDDEN]
    rows = renumbered(df)
    n = rows.count()
    if shown and shown[0] == "headers" and shown[1:] == [f"row {i}" for i in range(1, len(shown))]:
        names = [r[0] for r in rows.orderBy("_pos").select("headers").collect()]
        long = rows.unpivot(["headers"], shown[1:], "row", "value")
        back = long.groupBy("row").pivot("headers", names).agg(F.first("value"))
        return back.withColumn("_index", F.expr("cast(substring(row, 5) AS long) - 1")).withColumn("_pos", F.col("_index")).drop("row")
    order = {c: i for i, c in enumerate(shown)}
    long = rows.select("_pos", *[F.col(f"`{c}`").cast("string").alias(c) for c in shown]).unpivot(["_pos"], shown, "headers", "value")
    wide = long.groupBy("headers").pivot("_pos", list(range(n))).agg(F.first("value"))
    at = F.element_at(F.create_map(*[x for c, i in order.items() for x in (F.lit(c), F.lit(i).cast("long"))]), F.col("headers"))
    return wide.select("headers", *[F.col(str(i)).alias(f"row {i + 1}") for i in range(n)], at.alias("_index"), at.alias("_pos"))


OPERATIONS: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (hide_rows, hide_others, hide_above, hide_below, hide_matching, keep_matching, show_regex, hide_regex, decimate, unique_count, sort_by, shuffled, show_text, add_column, remove_column, move_column, split_column, append_rows, transpose)}
FILTERS = {"hide_rows", "hide_others", "hide_above", "hide_below", "hide_matching", "keep_matching", "show_regex", "hide_regex", "decimate", "unique_count"}


@dataclass(frozen=True)
class Grid:
    """A base table and what has been done to it; every method returns a new grid."""

    base: DataFrame
    done: tuple[tuple[str, tuple, tuple], ...] = ()
    undone: tuple[tuple[str, tuple, tuple], ...] = ()

    @classmethod
    def of(cls, df: DataFrame, order: str) -> Grid:
        """A table whose rows are in the order of a column of whole numbers."""
        return cls(renumbered(df.withColumn("_pos", F.col(order).cast("long"))).withColumn("_index", F.col("_pos")).select(*df.columns, *HIDDEN))

    def apply(self, name: str, *args, **kwargs) -> Grid:
        if name not in OPERATIONS:
            raise ValueError(f"no operation {name}")
        return replace(self, done=(*self.done, (name, args, tuple(kwargs.items()))), undone=())

    def undo(self) -> Grid:
        return replace(self, done=self.done[:-1], undone=(self.done[-1], *self.undone)) if self.done else self

    def redo(self) -> Grid:
        return replace(self, done=(*self.done, self.undone[0]), undone=self.undone[1:]) if self.undone else self

    def show_all(self) -> Grid:
        """All rows again: filters go, sorts and columns stay."""
        return replace(self, done=tuple(o for o in self.done if o[0] not in FILTERS))

    def replay(self, base: DataFrame, order: str) -> Grid:
        """The same operations on another table."""
        return replace(Grid.of(base, order), done=self.done)

    @property
    def frame(self) -> DataFrame:
        df = self.base
        for name, args, kwargs in self.done:
            df = OPERATIONS[name](df, *args, **dict(kwargs))
        return df

    def rows(self) -> DataFrame:
        """The rows in the order shown, with their places."""
        return renumbered(self.frame)


def nearest(df: DataFrame, column: str, value: str) -> DataFrame:
    """The row that a remembered value points to: the nearest number (the first of equals), else an equal text, else the first text that isn't less, else the last row."""
    number = F.col(column).try_cast("double")
    target = F.lit(value).try_cast("double")
    low = F.lower(F.col(column).cast("string"))
    rank = F.when(target.isNotNull() & number.isNotNull(), F.struct(F.lit(0).alias("k"), F.abs(number - target).alias("d"), "_pos"))
    rank = F.coalesce(rank, F.when(low == value.lower(), F.struct(F.lit(1).alias("k"), F.lit(0.0).alias("d"), "_pos")), F.when(low >= value.lower(), F.struct(F.lit(2).alias("k"), F.lit(0.0).alias("d"), "_pos")), F.struct(F.lit(3).alias("k"), F.lit(0.0).alias("d"), (-F.col("_pos")).alias("_pos")))
    return df.withColumn("__r", rank).orderBy("__r").limit(1).drop("__r")


def reachable(edges: DataFrame, focus: DataFrame, rounds: int | None = None) -> DataFrame:
    """Nodes connected with the focus nodes over edges (a, b) in either direction: direct neighbours for rounds = 1, all for None.

    Each round joins the newest nodes with the edges and takes away the known ones; rounds are written, so lineage stays short.
    """
    both = written(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "graph_edges")
    known = new = written(focus.select("node").distinct(), "graph_nodes")
    while (rounds is None or rounds > 0) and not new.isEmpty():
        found = new.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        new = written(found.join(known, "node", "left_anti"), "graph_nodes")
        known = written(known.unionByName(new), "graph_nodes")
        rounds = None if rounds is None else rounds - 1
    return known


def connected(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for each node of edges (a, b), in rounds whose number grows with the logarithm of the nodes.

    In each round a node points to the first of itself and its neighbours in the order of a hash, and edges are drawn between
    what their ends point to, until none is left. A hash has no long rising ways, so a chain shrinks as fast as a star.
    """
    left = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "graph_edges")
    nodes = written(left.select(F.col("a").alias("node")).union(left.select("b")).distinct(), "graph_nodes")
    label, left = nodes.withColumn("at", F.col("node")), left.where("a <> b")
    rank = lambda c: F.struct(F.xxhash64(c), F.col(c))
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy(F.col("a").alias("from")).agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("to"))).alias("f"))
        moves = written(first.select("from", F.when(rank("from") < F.struct("f.h", "f.to"), F.col("from")).otherwise(F.col("f.to")).alias("to")), "graph_moves")
        label = written(label.join(moves, F.col("at") == F.col("from"), "left").select("node", F.coalesce("to", "at").alias("at")), "graph_labels")
        x, y = (moves.select(F.col("from").alias(c), F.col("to").alias(n)) for c, n in (("a", "x"), ("b", "y")))
        moved = left.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        left = written(moved, "graph_edges")
    least = label.groupBy("at").agg(F.min("node").alias("component"))
    return label.join(least, "at").select("node", "component")


def connected_to(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """The nodes of edges (a, b) that any way connects with focus nodes (node), these included."""
    parts = written(connected(edges), "graph_components")
    wanted = parts.join(focus, "node", "left_semi").select("component").distinct()
    return parts.join(wanted, "component", "left_semi").select("node")


def numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns as numbers; 0 for what is none."""
    return df.withColumns({c: to_double(F.col(c)) for c in columns})
