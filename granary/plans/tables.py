"""Tables: what is declared of one, and its rows as immutable Parquet parts that a catalog file names.

A change writes new parts and then replaces the catalog file, so that a reader sees the table before it or after it. A table is kept in one of three layouts: sorted by key
ranges, dealt into hash buckets, or cut into grid cells. Layouts prune files and never change a result.
"""

from __future__ import annotations

import math
import time
import uuid
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import kernels as K
from granary.operators import spatial
from granary.sources.storage import Files

SPARK_TYPES = {"int": T.IntegerType(), "float": T.FloatType(), "char": T.StringType(), "double": T.DoubleType()}
INDEX_TYPES = ("btree", "sequential", "hash", "rtree")
#: Parts of a table before it is compacted, and rows of a hash bucket or grid cell at least.
MOST_PARTS, CELL_ROWS = 16, 500_000
RID = "_rid"


@dataclass
class Index:
    column: str | list[str]
    type: str
    unique: bool = False


@dataclass
class Spec:
    """columns: name -> int, float or char(n), in order. point_columns: logical name -> its two float columns."""

    columns: dict[str, str]
    primary_key: str | None = None
    pk_index_type: str | None = None
    indexes: list[Index] = field(default_factory=list)
    point_columns: dict[str, list[str]] = field(default_factory=dict)
    record_count: int = 0
    next_rid: int = 0
    parts: list[dict] = field(default_factory=list)
    version: int = 0

    @classmethod
    def of(cls, stored: dict) -> Spec:
        return cls(**(stored | {"indexes": [Index(**i) for i in stored.get("indexes", [])]}))

    def kind(self, column: str) -> str:
        if column not in self.columns:
            raise ValueError(f"no column {column!r}")
        return self.columns[column].partition("(")[0]

    def size(self, column: str) -> int:
        return int(self.columns[column].partition("(")[2].rstrip(")") or 0)

    @property
    def clustered(self) -> bool:
        return self.pk_index_type == "sequential"

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, SPARK_TYPES[self.kind(c)]) for c in self.columns] + [T.StructField(RID, T.LongType())])

    def expand(self, names: list[str]) -> list[str]:
        """Physical columns of a select list; logical points become two; unknown names vanish."""
        if names == ["*"]:
            return list(self.columns)
        return [c for n in names for c in (self.point_columns.get(n) or ([n] if n in self.columns else []))]

    def layout(self) -> dict:
        grid = next((i for i in self.indexes if i.type == "rtree"), None)
        hashed = next((i for i in self.indexes if i.type == "hash"), None)
        if self.clustered or not (grid or hashed):
            return {"kind": "range", "by": self.primary_key}
        return {"kind": "grid", "by": list(grid.column)} if grid else {"kind": "hash", "by": hashed.column}


def check_type(declared: str) -> str:
    kind, _, size = declared.lower().partition("(")
    if kind not in ("int", "float", "char") or (kind == "char") != bool(size):
        raise ValueError(f"unknown type {declared!r}")
    return declared.lower()


class Table:
    def __init__(self, spark: SparkSession, root: str, name: str, spec: Spec):
        self.spark, self.name, self.spec = spark, name, spec
        self.files = Files(spark, root)
        self.catalog_file = f"{name}/catalog.json"

    @classmethod
    def create(cls, spark: SparkSession, root: str, name: str, columns: dict[str, str], primary_key: str | None = None, pk_index_type: str = "btree", point_columns: dict[str, list[str]] | None = None) -> Table:
        """Opens the table if it is there with the same columns; with others that is a ValueError."""
        declared = {c: check_type(t) for c, t in columns.items()}
        if primary_key is not None and primary_key not in declared:
            raise ValueError(f"primary key {primary_key!r} is no column")
        if pk_index_type not in INDEX_TYPES[:3]:
            raise ValueError(f"unknown index type {pk_index_type!r}")
        table = cls(spark, root, name, Spec(declared, primary_key, pk_index_type if primary_key else None, point_columns=point_columns or {}))
        if table.files.exists(table.catalog_file):
            there = cls.open(spark, root, name)
            if there.spec.columns != declared:
                raise ValueError(f"table {name!r} has other columns")
            return there
        if primary_key:
            table.spec.indexes.append(Index(primary_key, pk_index_type, True))
        table.save()
        return table

    @classmethod
    def open(cls, spark: SparkSession, root: str, name: str) -> Table:
        files = Files(spark, root)
        if not files.exists(f"{name}/catalog.json"):
            raise ValueError(f"no table {name!r}")
        return cls(spark, root, name, Spec.of(files.load(f"{name}/catalog.json")))

    def save(self) -> None:
        """Replaces the catalog file. If another writer has done so since this table was opened, that is a RuntimeError, and its change stays."""
        there = self.files.load(self.catalog_file).get("version", 0) if self.files.exists(self.catalog_file) else 0
        if there != self.spec.version:
            raise RuntimeError(f"table {self.name!r} was changed by another writer; open it again")
        self.files.store(self.catalog_file, asdict(self.spec) | {"version": there + 1})
        self.spec.version = there + 1

    # ---- reading

    def frame(self, prune: dict[str, Any] | None = None) -> DataFrame:
        """All live rows with _rid. prune: what a predicate says about the layout's columns, to skip files; the predicate itself still has to be applied."""
        parts = [self._part(p, prune) for p in self.spec.parts]
        if not parts:
            return self.spark.createDataFrame([], self.spec.schema)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if self.spec.clustered and len(parts) > 1:  # the newest row of a key counts
            newest = W.partitionBy(self.spec.primary_key).orderBy(F.col(RID).desc())
            rows = rows.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
        return rows

    def _part(self, part: dict, prune: dict[str, Any] | None) -> DataFrame:
        layout, schema = part["layout"], self.spec.schema
        if layout["kind"] == "hash":
            schema = T.StructType([*schema, T.StructField("_bucket", T.IntegerType())])
        elif layout["kind"] == "grid":
            schema = T.StructType([*schema, T.StructField("_cx", T.IntegerType()), T.StructField("_cy", T.IntegerType())])
        rows = self.spark.read.schema(schema).parquet(self.files.at(f"{self.name}/{part['path']}"))
        if prune and layout["kind"] == "hash" and layout["by"] in prune and "equal" in prune[layout["by"]]:
            rows = rows.where(F.col("_bucket") == self._bucket(F.lit(prune[layout["by"]]["equal"]).cast(SPARK_TYPES[self.spec.kind(layout["by"])]), layout["buckets"]))
        if prune and layout["kind"] == "hash" and 0 < len(prune.get(layout["by"], {}).get("among", ())) <= layout["buckets"]:  # more values than buckets meet nearly all of them
            rows = rows.where(F.col("_bucket").isin([self._bucket(F.lit(v).cast(SPARK_TYPES[self.spec.kind(layout["by"])]), layout["buckets"]) for v in prune[layout["by"]]["among"]]))
        if prune and layout["kind"] == "grid" and "circle" in prune and prune["circle"]["by"] == layout["by"]:
            rows = rows.where(spatial.cells_around(prune["circle"], layout))
        return rows.select(*self.spec.columns, RID)

    @staticmethod
    def _bucket(c, n: int):
        return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    def scan(self) -> DataFrame:
        """The physical columns of all rows; the order is not defined."""
        return self.frame().select(*self.spec.columns)

    def count(self) -> int:
        return self.frame().count()

    def recount(self) -> int:
        """Counts the live rows and corrects the catalog."""
        self.spec.record_count = self.count()
        self.save()
        return self.spec.record_count

    def record(self, rid: int) -> DataFrame:
        """The row with this _rid, if it lives."""
        return self.frame().where(F.col(RID) == rid).select(*self.spec.columns)

    def _check_column(self, column: str) -> str:
        return self.spec.kind(column)

    def matching(self, column: str, op: str, value: Any) -> DataFrame:
        kind = self._check_column(column)
        prune = {column: {"equal": value}} if op == "=" and K.comparable(kind, value) and not (kind == "int" and value != int(value)) else None
        return self.frame(prune).where(K.compare(column, kind, op, value))

    def select(self, column: str, value: Any, limit: int | None = None, offset: int = 0) -> DataFrame:
        return self._page(self.matching(column, "=", value), [RID], limit, offset)

    def select_many(self, column: str, values: list[Any]) -> DataFrame:
        """Rows whose column equals any of the values, in one job: the values reach the reader, and a hash layout reads their buckets alone."""
        kind = self._check_column(column)
        values = [v for v in values if K.comparable(kind, v) and not (kind == "int" and v != int(v))]
        if not values:
            return self.frame().where(F.lit(False)).select(*self.spec.columns)
        typed = [F.lit(v).cast(SPARK_TYPES[kind]) for v in values] if kind == "float" else [{"int": int, "char": str, "double": float}[kind](v) for v in values]
        return self.frame({column: {"among": values}}).where(F.col(column).isin(typed)).select(*self.spec.columns)

    def select_range(self, column: str, begin: Any, end: Any, limit: int | None = None, offset: int = 0) -> DataFrame:
        """In key order."""
        return self._page(self.frame().where(K.between(column, self._check_column(column), begin, end)), [column, RID], limit, offset)

    def _page(self, rows: DataFrame, order: list[str], limit: int | None, offset: int) -> DataFrame:
        rows = rows.orderBy(*order)
        if offset:
            rows = rows.offset(offset)
        if limit:
            rows = rows.limit(limit)
        return rows.select(*self.spec.columns)

    def ordered(self, column: str, rows: DataFrame | None = None, descending: bool = False) -> DataFrame:
        self._check_column(column)
        c = F.col(column)
        return (self.frame() if rows is None else rows).orderBy(c.desc_nulls_first() if descending else c.asc_nulls_last(), RID)

    # ---- spatial

    def _axes(self, x: str, y: str | None = None) -> tuple[str, str]:
        pair = tuple(self.spec.point_columns.get(x, [])) if y is None else (x, y)
        if len(pair) != 2 or any(c not in self.spec.columns for c in pair):
            raise ValueError(f"no point {x!r}")
        return pair

    def has_point_index(self, x: str, y: str | None = None) -> bool:
        return any(i.type == "rtree" and tuple(i.column) == self._axes(x, y) for i in self.spec.indexes)

    def near(self, cx: float, cy: float, *, radius: float | None = None, k: int | None = None, point: str | tuple[str, str], limit: int = 0, offset: int = 0) -> DataFrame:
        """Rows by distance (column _distance, ties by _rid): all within the radius, or the k nearest after offset. limit 0: all."""
        x, y = self._axes(point) if isinstance(point, str) else self._axes(*point)
        if radius is not None:
            return spatial.within(self.frame({"circle": {"by": [x, y], "x": cx, "y": cy, "r": radius}}), x, y, cx, cy, radius, [RID], limit, offset)
        wide = self._radius_with(x, y, cx, cy, (k or 0) + offset)
        rows = self.frame() if wide is None else self.frame({"circle": {"by": [x, y], "x": cx, "y": cy, "r": wide}}).where(K.box(x, y, cx, cy, wide))
        return spatial.nearest(rows, x, y, cx, cy, k or 0, [RID], limit, offset)

    def _radius_with(self, x: str, y: str, cx: float, cy: float, n: int) -> float | None:
        """A radius within which n rows lie, found by widening a circle over the cells of a grid; None: look at all rows."""
        grids = [p["layout"] for p in self.spec.parts]
        if n <= 0 or not grids or any(g["kind"] != "grid" or g["by"] != [x, y] for g in grids):
            return None
        radius = max(max(g["sides"]) for g in grids)
        for _ in range(max(g["tiles"] for g in grids).bit_length()):
            near = self.frame({"circle": {"by": [x, y], "x": cx, "y": cy, "r": radius}}).where(K.box(x, y, cx, cy, radius)).where(K.distance(x, y, cx, cy) <= radius)
            if near.limit(n).count() >= n:
                return radius
            radius *= 2
        return None

    def select_radius(self, point, cx: float, cy: float, radius: float, limit: int = 0, offset: int = 0) -> DataFrame:
        return self.near(cx, cy, radius=radius, point=point, limit=limit, offset=offset).select(*self.spec.columns)

    def select_knn(self, point, cx: float, cy: float, k: int, limit: int = 0, offset: int = 0) -> DataFrame:
        return self.near(cx, cy, k=k, point=point, limit=limit, offset=offset).select(*self.spec.columns)

    def select_point(self, point, px: float, py: float, limit: int = 0, offset: int = 0) -> DataFrame:
        x, y = self._axes(point) if isinstance(point, str) else self._axes(*point)
        return self._page(self.frame({"circle": {"by": [x, y], "x": px, "y": py, "r": 0.0}}).where(spatial.at(x, y, px, py)), [RID], limit or None, offset)

    def envelope(self, point, cx: float, cy: float, *, radius: float | None = None, k: int | None = None, limit: int = 0, offset: int = 0) -> dict:
        x, y = self._axes(point) if isinstance(point, str) else self._axes(*point)
        found = self.near(cx, cy, radius=radius, k=k, point=(x, y), limit=limit, offset=offset)
        rows = [{"x": r[0], "y": r[1], "rid": r[2], "distance": round(r[3], 6), "color": "blue"} for r in found.select(x, y, RID, "_distance").collect()]
        return {"query_point": {"x": cx, "y": cy, "color": "red"}, "results": rows, "total": len(rows)}

    # ---- changes

    def coerce(self, record: dict[str, Any]) -> tuple:
        missing = [c for c in self.spec.columns if c not in record]
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        out = []
        for c in self.spec.columns:
            kind, v = self.spec.kind(c), record[c]
            out.append(int(v) if kind == "int" else float(v) if kind == "float" else str(v).encode()[: self.spec.size(c)].decode("utf-8", "replace").rstrip("\x00"))
        return tuple(out)

    def insert(self, record: dict[str, Any]) -> int:
        """Appends a row and returns its _rid. In a clustered table it takes the place of the row with its key."""
        row = (*self.coerce(record), rid := self.spec.next_rid)
        replaced = 0
        if self.spec.clustered:
            key = self.spec.primary_key
            replaced = self.matching(key, "=", row[list(self.spec.columns).index(key)]).limit(1).count()
        part = self._write(self.spark.createDataFrame([row], self.spec.schema).coalesce(1), {"kind": "range", "by": None}, 1, sort=False)
        self._commit([*self.spec.parts, part], 1 - replaced, rid + 1)
        return rid

    def insert_frame(self, rows: DataFrame, order: str | None = None) -> int:
        """Appends the physical columns of rows. order: a column of unique longs that says in which order they arrive."""
        base = self.spec.next_rid
        numbered = rows.select(*(self._stored(c) for c in self.spec.columns), (F.lit(base) + (F.col(order) if order else F.monotonically_increasing_id())).alias(RID))
        layout = self.spec.layout()
        part = self._write(numbered, layout, None if layout["kind"] == "range" else rows.agg(F.count("*"), F.max(F.xxhash64(*self.spec.columns))).first()[0])  # buckets and cells follow the number of rows; a CSV reader counts only what it also reads
        written = self._part(part, None).agg(F.count("*"), F.max(RID)).first()
        if written[0]:
            self._commit([*self.spec.parts, part], written[0] if not self.spec.clustered else None, written[1] + 1)
        else:
            self.files.delete(f"{self.name}/{part['path']}")
        return written[0]

    def _stored(self, c: str):
        kind = self.spec.kind(c)
        return (K.truncate_bytes(F.col(c).cast("string"), self.spec.size(c)) if kind == "char" else F.col(c).cast(SPARK_TYPES[kind])).alias(c)

    def _commit(self, parts: list[dict], more: int | None, next_rid: int | None = None) -> None:
        self.spec.parts = parts
        self.spec.next_rid = self.spec.next_rid if next_rid is None else next_rid
        self.spec.record_count = self.count() if more is None else self.spec.record_count + more
        self.save()
        if len(parts) > MOST_PARTS:
            self.compact()

    def _write(self, rows: DataFrame, layout: dict, n: int | None, sort: bool = True) -> dict:
        path = f"part-{time.time_ns():x}-{uuid.uuid4().hex[:8]}"
        layout, target = dict(layout), self.files.at(f"{self.name}/{path}")
        cells = max(1, math.ceil((n if n is not None else self.spec.record_count) / CELL_ROWS))
        if layout["kind"] == "hash":
            layout["buckets"] = max(8, cells)
            rows.withColumn("_bucket", self._bucket(F.col(layout["by"]), layout["buckets"])).hint("rebalance", "_bucket").sortWithinPartitions("_bucket", layout["by"]).write.partitionBy("_bucket").parquet(target)
        elif layout["kind"] == "grid":
            laid, layout = spatial.gridded(rows, layout, max(4, math.isqrt(cells) + 1))
            laid.write.partitionBy("_cx", "_cy").parquet(target)
        else:
            by = layout["by"]
            (rows.repartitionByRange(F.col(by), F.col(RID)).sortWithinPartitions(by, RID) if sort and by else rows).write.parquet(target)
        return {"path": path, "layout": layout}

    def delete(self, column: str, value: Any) -> int:
        """Rows whose column equals the value go; their number. Parts that hold none of them stay as they are; the others are written anew. A clustered table of several parts is
        compacted, since a part may hold older rows of a key."""
        kind = self._check_column(column)
        condition, before = K.compare(column, kind, "=", value), self.spec.record_count
        if self.spec.clustered and len(self.spec.parts) > 1:
            rows = self.frame()
            gone = rows.where(condition).count()
            if gone:
                self._rewrite(rows.where(~F.coalesce(condition, F.lit(False))), before - gone)
            return gone
        parts, gone = [], 0
        for part in self.spec.parts:
            rows = self._part(part, None)
            n = rows.where(condition).count()
            if n:
                left = rows.where(~F.coalesce(condition, F.lit(False)))
                part = self._write(left, {k: v for k, v in part["layout"].items() if k in ("kind", "by")}, max(1, before - gone - n))
            parts, gone = [*parts, part], gone + n
        if gone:
            self.spec.parts, self.spec.record_count = parts, before - gone
            self.save()
        return gone

    def _rewrite(self, rows: DataFrame, n: int) -> None:
        part = self._write(rows, self.spec.layout(), n)
        self.spec.parts, self.spec.record_count = [part], n
        self.save()

    def compact(self) -> None:
        """One part in the declared layout, without replaced rows. Old parts stay for readers; vacuum() takes them away."""
        if self.spec.parts:
            self._rewrite(self.frame(), self.spec.record_count)

    def vacuum(self) -> int:
        used = {p["path"] for p in self.spec.parts}
        old = [n for n in self.files.names(self.name) if n.startswith("part-") and n not in used]
        return sum(self.files.delete(f"{self.name}/{n}") for n in old)

    # ---- layouts that are declared as indexes

    def create_index(self, column: str | tuple[str, str], index_type: str, unique: bool = False) -> None:
        if index_type not in INDEX_TYPES:
            raise ValueError(f"unknown index type {index_type!r}")
        names = [column] if isinstance(column, str) else list(column)
        for c in names:
            self._check_column(c)
        if (index_type == "rtree") != (len(names) == 2):
            raise ValueError("an rtree index is over two columns, any other over one")
        key = names if index_type == "rtree" else names[0]
        if any(i.column == key for i in self.spec.indexes):
            raise ValueError(f"an index on {key} exists already")
        self.spec.indexes.append(Index(key, index_type, unique))
        self.save()
        self.compact()

    def drop_index(self, column: str | tuple[str, str]) -> None:
        key = column if isinstance(column, str) else list(column)
        if self.spec.clustered and key == self.spec.primary_key:
            raise ValueError("the index of a clustered primary key cannot be dropped")
        if not self.has_index(column):
            raise ValueError(f"no index on {key}")
        self.spec.indexes = [i for i in self.spec.indexes if i.column != key]
        self.save()
        self.compact()

    def has_index(self, column: str | tuple[str, str]) -> bool:
        return any(i.column == (column if isinstance(column, str) else list(column)) for i in self.spec.indexes)


class Mounted(Table):
    """Rows of a frame that the engine does not keep: queries work, changes do not. key orders rows that tie."""

    KINDS = {"string": "char", "float": "float", "double": "double", "int": "int", "bigint": "int", "smallint": "int", "tinyint": "int"}

    def __init__(self, name: str, rows: DataFrame, key: str, points: dict[str, list[str]] | None = None):
        self.spark, self.name, self.rows = rows.sparkSession, name, rows.withColumn(RID, F.col(key))
        columns = {c: self.KINDS[t] for c, t in rows.dtypes if t in self.KINDS}
        self.spec = Spec(columns, key, point_columns=points or {})

    def frame(self, prune: dict[str, Any] | None = None) -> DataFrame:
        return self.rows

    def save(self) -> None:
        raise RuntimeError(f"{self.name!r} is mounted; it cannot be changed")
