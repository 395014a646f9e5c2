"""Record-level provenance as ordinary DataFrames.

A `TracedFrame` is a DataFrame whose rows carry the id of their record, plus the
recorded steps that led to it.  Narrow steps pass ids through; a step that makes
new records (explode, aggregation, join, union, distinct) also defines an edge
table (out_id, in_id) per parent.  Edges are lazy projections of the traced
input: they cost nothing until a cursor walks them, and Catalyst prunes them
like any query; `materialise` writes them once where many walks follow.  Ids are
the key values (structs), never hashes or texts of them, so distinct records
never merge.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import reliable

RID = "__rid"


def _id(*columns: Column | str) -> Column:
    """The key values themselves as one struct; null is a value of its own."""
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in columns])


#: Steps that give each row of a scan at most once and in its place.
_BARE = {"Project", "Filter", "SubqueryAlias", "View"}


def _scanned_format(df: DataFrame) -> str | None:
    """The file format below a plan that only chooses rows and columns of one scan; None for any other plan."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in _BARE and node.children().size() == 1:
        node = node.children().head()
    if not node.nodeName().startswith("LogicalRelation"):
        return None
    relation = node.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation":
        return None
    return relation.fileFormat().toString().lower()


@dataclass
class Edge:
    """(out_id, in_id) between a node and one of its parents; `inside` names the field of out_id that is in_id, if there is one."""

    parent: TracedFrame
    rows: DataFrame
    inside: str | None = None


@dataclass
class TracedFrame:
    """A traced DataFrame; `df` has the data columns and the record id."""

    df: DataFrame
    op: str
    edges: list[Edge] = field(default_factory=list)
    capture: bool = True
    rerun: Callable[[list[DataFrame]], DataFrame] | None = None
    parents: list[TracedFrame] = field(default_factory=list)

    # sources

    @staticmethod
    def source(df: DataFrame, key: list[str] | None = None, capture: bool = True) -> TracedFrame:
        """Records of a table: ids from a unique key, else from the file's path and the row's place in it.

        A bare scan of Parquet (columns and rows chosen, nothing else) tells the place of a row, so
        its ids need no copy and stay whatever the splits are.  All other rows are numbered once and
        materialised: scans of other files (with their path), and rows that were exploded, joined,
        grouped or dealt out first, for which the place in a file names several records or none.
        """
        if key:
            return TracedFrame(df.withColumn(RID, _id(*key)), "source", capture=capture)
        path = F.col("_metadata.file_path").alias("path")
        number = F.monotonically_increasing_id().alias("row")
        scanned = _scanned_format(df)
        if scanned == "parquet":
            return TracedFrame(df.withColumn(RID, _id(path, F.col("_metadata.row_index").alias("row"))), "source", capture=capture)
        return TracedFrame(reliable(df.withColumn(RID, _id(path, number) if scanned else _id(number))), "source", capture=capture)

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != RID]

    @property
    def data(self) -> DataFrame:
        return self.df.drop(RID)

    def _narrow(self, op: str, step: Callable[[DataFrame], DataFrame]) -> TracedFrame:
        """A step that keeps the records' ids."""
        return TracedFrame(step(self.df), op, capture=self.capture, rerun=lambda p: step(p[0]), parents=[self])

    def _edges(self, rows: list[tuple], inside: tuple[str | None, ...] = (None, None)) -> list[Edge]:
        return [Edge(parent, r, field) for (parent, r), field in zip(rows, inside, strict=False)] if self.capture else []

    # narrow steps

    def select(self, *columns: Column | str) -> TracedFrame:
        return self._narrow("select", lambda d: d.select(RID, *columns))

    def where(self, condition: Column | str) -> TracedFrame:
        return self._narrow("where", lambda d: d.where(condition))

    def with_column(self, name: str, value: Column) -> TracedFrame:
        return self._narrow("with_column", lambda d: d.withColumn(name, value))

    def order_by(self, *columns: Column | str) -> TracedFrame:
        return self._narrow("order_by", lambda d: d.orderBy(*columns))

    def limit_by(self, n: int, *order: Column | str) -> TracedFrame:
        """The first n records of an order; the record id decides among equals, so a later walk meets the same records."""
        return self._narrow("limit", lambda d: d.orderBy(*order, RID).limit(n))

    def repartition_and_sort(self, n: int, *keys: str) -> TracedFrame:
        return self._narrow("repartition_and_sort", lambda d: d.repartition(n, *keys).sortWithinPartitions(*keys))

    def coalesce(self, n: int) -> TracedFrame:
        return self._narrow("coalesce", lambda d: d.coalesce(n))

    # steps that make records

    def flat_map(self, name: str, array: Column) -> TracedFrame:
        """One record per element; its id is the parent's and the place."""

        def step(d: DataFrame) -> DataFrame:
            rows = d.select("*", F.posexplode(array).alias("__pos", name)).withColumn("__in", F.col(RID))
            return rows.withColumn(RID, _id(F.col("__in").alias("r"), F.col("__pos").alias("p")))

        rows = step(self.df)
        edges = self._edges([(self, rows.select(F.col(RID).alias("out_id"), F.col("__in").alias("in_id")))], ("r",))
        return TracedFrame(rows.drop("__pos", "__in"), "flat_map", edges, self.capture, lambda p: step(p[0]).drop("__pos", "__in"), [self])

    def group_by(self, keys: list[str], *aggregates: Column) -> TracedFrame:
        """One record per group, named by its key; every row of the group is an input."""

        def step(d: DataFrame) -> DataFrame:
            return d.groupBy(*keys).agg(*aggregates).withColumn(RID, _id(*keys))

        edges = self._edges([(self, self.df.select(_id(*keys).alias("out_id"), F.col(RID).alias("in_id")))])
        return TracedFrame(step(self.df), "group_by", edges, self.capture, lambda p: step(p[0]), [self])

    def distinct(self) -> TracedFrame:
        keys = self.columns

        def step(d: DataFrame) -> DataFrame:
            return d.select(*keys).distinct().withColumn(RID, _id(*keys))

        edges = self._edges([(self, self.df.select(_id(*keys).alias("out_id"), F.col(RID).alias("in_id")))])
        return TracedFrame(step(self.df), "distinct", edges, self.capture, lambda p: step(p[0]), [self])

    def join(self, other: TracedFrame, on: list[str], how: str = "inner") -> TracedFrame:
        """A record per pair; it comes from both sides' records."""

        def step(a: DataFrame, b: DataFrame) -> DataFrame:
            rows = a.withColumnRenamed(RID, "__l").join(b.withColumnRenamed(RID, "__r"), on, how)
            return rows.withColumn(RID, _id(F.col("__l").alias("l"), F.col("__r").alias("r")))

        rows = step(self.df, other.df)
        sides = [(self, rows.where("__l is not null").select(F.col(RID).alias("out_id"), F.col("__l").alias("in_id")))]
        sides.append((other, rows.where("__r is not null").select(F.col(RID).alias("out_id"), F.col("__r").alias("in_id"))))
        return TracedFrame(rows.drop("__l", "__r"), "join", self._edges(sides, ("l", "r")), self.capture, lambda p: step(p[0], p[1]).drop("__l", "__r"), [self, other])

    def cogroup(self, other: TracedFrame, on: list[str], left: Column, right: Column) -> TracedFrame:
        """A record per key of either side, with one aggregate of each."""

        def step(a: DataFrame, b: DataFrame) -> DataFrame:
            return a.groupBy(*on).agg(left).join(b.groupBy(*on).agg(right), on, "full").withColumn(RID, _id(*on))

        sides = [(p, p.df.select(_id(*on).alias("out_id"), F.col(RID).alias("in_id"))) for p in (self, other)]
        return TracedFrame(step(self.df, other.df), "cogroup", self._edges(sides), self.capture, lambda p: step(p[0], p[1]), [self, other])

    def union(self, other: TracedFrame) -> TracedFrame:
        """The records of both; an id names the branch and holds that branch's own id as it is."""

        def tagged(p: list[DataFrame], branch: int) -> DataFrame:
            kinds = [d.schema[RID].dataType for d in p]
            ids = [F.col("__in") if i == branch else F.lit(None).cast(kinds[i]) for i in (0, 1)]
            return p[branch].withColumn("__in", F.col(RID)).withColumn(RID, _id(F.lit(branch).alias("b"), ids[0].alias("l"), ids[1].alias("r")))

        both = [self.df, other.df]
        edges = self._edges([(p, tagged(both, i).select(F.col(RID).alias("out_id"), F.col("__in").alias("in_id"))) for i, p in enumerate((self, other))], ("l", "r"))

        def step(p: list[DataFrame]) -> DataFrame:
            return tagged(p, 0).drop("__in").unionByName(tagged(p, 1).drop("__in"))

        return TracedFrame(step(both), "union", edges, self.capture, step, [self, other])

    def zip_partitions(self, other: TracedFrame, buckets: int, order: str, other_order: str) -> TracedFrame:
        """Positional pairing inside buckets: the i-th record of a bucket meets the i-th of the other side's."""

        def placed(d: DataFrame, by: str) -> DataFrame:
            d = d.withColumn("__bucket", F.pmod(F.xxhash64(by), F.lit(buckets)))
            return d.withColumn("__place", F.row_number().over(Window.partitionBy("__bucket").orderBy(by, RID)))

        a = TracedFrame(placed(self.df, order), "place", capture=self.capture, rerun=lambda p: placed(p[0], order), parents=[self])
        b = TracedFrame(placed(other.df, other_order), "place", capture=self.capture, rerun=lambda p: placed(p[0], other_order), parents=[other])
        return a.join(b, ["__bucket", "__place"]).select(*[c for c in a.columns + b.columns if not c.startswith("__")])

    def zip_three(self, second: TracedFrame, third: TracedFrame, buckets: int, orders: tuple[str, str, str]) -> TracedFrame:
        """Positional pairing of three sides; the third is zipped to the pairs of the first two."""
        return self.zip_partitions(second, buckets, orders[0], orders[1]).zip_partitions(third, buckets, orders[0], orders[2])

    # queries

    def materialise(self) -> TracedFrame:
        """Writes the edges of the step that made this frame's records, once; every later walk reads them."""
        node, edges = self._steps()
        node.edges = [Edge(e.parent, reliable(e.rows), e.inside) for e in edges]
        return self

    def materialise_in_background(self, tries: int = 2) -> Future:
        """The same while the caller goes on: walks read the lazy edges until the written ones are there.

        A failed write is tried again, `tries` times in all; after that the future holds the error
        and walks go on with the lazy edges.
        """

        def write() -> TracedFrame:
            for left in range(tries - 1, -1, -1):
                try:
                    return self.materialise()
                except PySparkException:
                    if not left:
                        raise
            return self

        pool = ThreadPoolExecutor(1, thread_name_prefix="edges")
        try:
            return pool.submit(write)
        finally:
            pool.shutdown(wait=False)

    def aggregate(self, **key) -> DataFrame:
        """The data of the groups with the given key values."""
        rows = self.df
        for name, value in key.items():
            rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
        return rows.drop(RID)

    def collect_with_id(self) -> DataFrame:
        return self.df

    def lineage(self) -> Cursor:
        """A cursor on all records of this frame."""
        return Cursor(self, self.df.select(F.col(RID).alias("id")), by_key=())

    def replay(self, source: TracedFrame, rows: DataFrame) -> DataFrame:
        """This frame's data with `source` replaced by other rows (same columns), capture off."""
        return self._replayed(source, rows).drop(RID)

    def _replayed(self, source: TracedFrame, rows: DataFrame) -> DataFrame:
        if self is source:
            return rows
        if not self.parents:
            return self.df
        return self.rerun([p._replayed(source, rows) for p in self.parents])

    def _steps(self) -> tuple[TracedFrame, list[Edge]]:
        """Past narrow steps, whose ids are those of their parent, to the node that made the ids."""
        node = self
        while not node.edges and len(node.parents) == 1:
            node = node.parents[0]
        return node, node.edges


@dataclass
class Cursor:
    """A selection of record ids at one node.

    A move is a semi join with the edges, or less: where an id holds the parent's id the move
    is a projection of the selected ids, and a selection of groups by their keys alone goes to
    the groups' inputs as a filter, so the groups are not computed.
    """

    at: TracedFrame
    ids: DataFrame
    trail: tuple[tuple[TracedFrame, Edge], ...] = ()
    by_key: tuple[Column | str, ...] | None = None  # the conditions on keys that alone made this selection

    def where(self, condition: Column | str) -> Cursor:
        """Keeps the selected records that meet a condition on their data."""
        chosen = self.at.df.where(condition).select(F.col(RID).alias("id"))
        keyed = None
        if self.by_key is not None and self._on_keys(condition):
            keyed = (*self.by_key, condition)
        return Cursor(self.at, chosen if self.by_key == () else self.ids.join(chosen, "id", "left_semi"), self.trail, keyed)

    def _on_keys(self, condition: Column | str) -> bool:
        keys = self.at.df.schema[RID].dataType
        try:
            self.at.df.sparkSession.createDataFrame([], keys).where(condition)
            return True
        except AnalysisException:
            return False

    def where_id(self, condition: Column | str) -> Cursor:
        return Cursor(self.at, self.ids.where(condition), self.trail)

    def go_back(self, parent: int = 0) -> Cursor:
        """One step back: the records of a parent that contributed."""
        node, edges = self.at._steps()
        if not edges:
            raise ValueError("the cursor is at a source, or capture was off")
        edge = edges[parent]
        if edge.inside:
            found = self.ids.select(F.col(f"id.{edge.inside}").alias("in_id")).where("in_id is not null")
        elif self.by_key and self.at is node and node.op in ("group_by", "cogroup"):
            found = edge.rows.select("in_id", "out_id.*")
            for condition in self.by_key:
                found = found.where(condition)
        else:
            found = edge.rows.join(self.ids.withColumnRenamed("id", "out_id"), "out_id", "left_semi")
        return Cursor(edge.parent, found.select(F.col("in_id").alias("id")).distinct(), (*self.trail, (self.at, edge)))

    def go_back_all(self, parent: int = 0) -> Cursor:
        """Back to a source, always through the given parent (the first where there is one)."""
        cursor = self
        while cursor.at._steps()[1]:
            cursor = cursor.go_back(min(parent, len(cursor.at._steps()[1]) - 1))
        return cursor

    def go_next(self) -> Cursor:
        """One step forward along the way the cursor came: all records derived from the selection."""
        if not self.trail:
            raise ValueError("the cursor has not gone back")
        node, edge = self.trail[-1]
        found = edge.rows.join(self.ids.withColumnRenamed("id", "in_id"), "in_id", "left_semi").select(F.col("out_id").alias("id")).distinct()
        return Cursor(node, found, self.trail[:-1])

    def show(self) -> DataFrame:
        """The distinct records of the selection, readable."""
        return self.dump().drop(RID).distinct()

    def dump(self) -> DataFrame:
        """The records of the selection with their ids."""
        return self.at.df.join(self.ids.withColumnRenamed("id", RID), RID, "left_semi")
