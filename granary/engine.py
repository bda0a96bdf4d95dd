"""SQL text in, results out; and the same engine as a Python API."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import kernels as K
from granary.plans import dialect as D
from granary.plans.tables import RID, Index, Mounted, Spec, Table
from granary.sources.csv_files import Uploads, read_csv
from granary.sources.storage import Files

ERRORS_OF_THE_CALLER = frozenset({"LexicalError", "ParserError", "ValueError", "RuntimeError", "NotImplementedError"})
#: Keys of every statement's metrics. Page counts have no meaning here and stay None; what Spark scanned stands under keys of its own.
PAGE_KEYS = ("heap_reads", "heap_writes", "index_reads", "index_writes", "total_reads", "total_writes")


def http_status(error: dict) -> int:
    return 400 if error.get("type") in ERRORS_OF_THE_CALLER else 500


@dataclass
class Result:
    """What a statement gives. frame is lazy; to_dict() runs it."""

    statement: dict
    type: str
    table: str | None = None
    frame: DataFrame | None = None
    more: dict[str, Any] = field(default_factory=dict)
    began: float = field(default_factory=time.perf_counter)
    run_time: float | None = None

    def to_dict(self) -> dict:
        out = {"statement": self.statement, "type": self.type} | ({"table": self.table} if self.table else {}) | self.more
        scanned: dict[str, int] = {}
        if self.frame is not None:
            self.began = time.perf_counter()
            rows = [list(r) for r in self.frame.collect()]
            out |= {"columns": self.frame.columns, "rows": rows}
            scanned = scan_metrics(self.frame)
        ms = (time.perf_counter() - self.began if self.run_time is None else self.run_time) * 1000
        return out | {"metrics": {"time_ms": round(ms, 3)} | dict.fromkeys(PAGE_KEYS) | scanned}


def scan_metrics(df: DataFrame) -> dict[str, int]:
    """Files, rows and bytes that the scans of an executed plan read."""
    found = {"scan_files": 0, "scan_rows": 0, "scan_bytes": 0}
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        metrics = leaves.apply(i).metrics()
        for key, name in (("numFiles", "scan_files"), ("numOutputRows", "scan_rows"), ("filesSize", "scan_bytes")):
            if metrics.contains(key):
                found[name] += metrics.apply(key).value()
    return found


class Database:
    """Tables under one folder, and the folder of CSV files that CREATE TABLE ... FROM FILE reads.

    strict: an unknown column in a select list and a spatial query without an RTREE index are errors; else the column is left out and the rows are scanned.
    """

    def __init__(self, spark: SparkSession, root: str | Path, uploads: str | Path | None = None, strict: bool = False, order_by_ignores_where: bool = False):
        self.spark, self.root, self.strict = spark, str(root), strict
        self.order_by_ignores_where = order_by_ignores_where
        self.files = Files(spark, self.root)
        self.uploads = Uploads(uploads) if uploads else None
        self.warnings: list[str] = []
        self.mounted: dict[str, Table] = {}

    # ---- catalog

    def mount(self, name: str, rows: DataFrame, key: str, points: dict[str, list[str]] | None = None) -> None:
        """Lets queries name a frame, such as Parquet files that others write."""
        self.mounted[name] = Mounted(name, rows, key, points)

    def table(self, name: str) -> Table:
        return self.mounted.get(name) or Table.open(self.spark, self.root, name)

    def create(self, name: str, columns: dict[str, str], **how: Any) -> Table:
        return Table.create(self.spark, self.root, name, columns, **how)

    def tables(self) -> list[dict]:
        """Every table with its columns, key, indexes, points and row count, by name; a catalog that cannot be read is passed over."""
        out = []
        for name in self.files.names():
            try:
                spec = Spec.of(self.files.load(f"{name}/catalog.json"))
            except Exception:  # noqa: BLE001  whatever is wrong with one table, the others are listed
                continue
            out.append({"name": name, "columns": spec.columns, "primary_key": spec.primary_key, "pk_index_type": spec.pk_index_type, "indexes": [vars(i) for i in spec.indexes], "point_columns": spec.point_columns, "record_count": spec.record_count})
        return out

    # ---- programs

    def execute(self, source: str, lenient: bool = False) -> dict:
        """All statements are read first; the first that fails ends the program, and what ran before it stays done."""
        try:
            statements = D.parse(source, lenient)
        except D.LexicalError as e:
            return _failed("LexicalError", e, "scan")
        except D.ParserError as e:
            return _failed("ParserError", e, "parse")
        except ValueError as e:
            return _failed("ValueError", e, "execution")
        results = []
        try:
            for s in statements:
                results.append(self.run(s).to_dict())
        except AnalysisException as e:
            return _failed("ValueError", e, "execution")
        except Exception as e:  # noqa: BLE001  an error is a result here
            return _failed(type(e).__name__, e, "execution")
        return {"success": True, "ast": [s.to_dict() for s in statements], "results": results}

    def trace(self, source: str) -> str:
        return "\n".join(D.sql_of(s) for s in D.parse(source))

    def explain(self, source: str) -> str:
        """The physical plan of one SELECT."""
        return self.sql(source)._jdf.queryExecution().toString()

    def run(self, s: D.Statement) -> Result:
        return _RUN[type(s)](self, s)

    def sql(self, source: str) -> DataFrame:
        """The lazy DataFrame of one SELECT."""
        (s,) = D.parse(source)
        if not isinstance(s, D.Select):
            raise ValueError("not a SELECT")
        return self.selected(s)

    # ---- statements

    def selected(self, s: D.Select) -> DataFrame:
        table = self.table(s.table)
        unknown = [c for c in s.columns if c != "*" and not table.spec.expand([c])]
        if unknown and self.strict:
            raise ValueError(f"unknown columns: {', '.join(unknown)}")
        columns = table.spec.expand(s.columns)
        if isinstance(s.where, D.Near):
            rows = self._near(table, s.where)
            return rows.select(*table.spec.columns, "_distance")
        where = None if s.order_by and self.order_by_ignores_where else s.where
        if isinstance(where, D.Comparison):
            rows = table.matching(where.left, where.operator, where.right)
        elif isinstance(where, D.Between):
            rows = table.frame().where(K.between(where.left, table.spec.kind(where.left), where.lower, where.upper))
        else:
            rows = table.frame()
        if s.order_by:
            rows = table.ordered(s.order_by, rows, s.descending)
        elif isinstance(where, D.Between):
            rows = rows.orderBy(where.left, RID)
        return rows.select(*columns)

    def _near(self, table: Table, c: D.Near) -> DataFrame:
        if self.strict and not table.has_point_index(c.left):
            raise ValueError(f"no RTREE index on {c.left!r}")
        return table.near(c.x, c.y, point=c.left, **{"radius" if c.search == "radius" else "k": c.value})

    def _select(self, s: D.Select) -> Result:
        if not isinstance(s.where, D.Near):
            return Result(s.to_dict(), "select", s.table, self.selected(s))
        began, table, c = time.perf_counter(), self.table(s.table), s.where
        if self.strict and not table.has_point_index(c.left):
            raise ValueError(f"no RTREE index on {c.left!r}")
        found = table.envelope(c.left, c.x, c.y, **{"radius" if c.search == "radius" else "k": c.value})
        return Result(s.to_dict(), "select", s.table, more={"is_spatial": True, "spatial_data": found}, run_time=time.perf_counter() - began)

    def _insert(self, s: D.Insert) -> Result:
        began, table = time.perf_counter(), self.table(s.table)
        if len(s.values) != len(table.spec.columns):
            raise RuntimeError(f"{len(s.values)} values for {len(table.spec.columns)} columns")
        rid = table.insert(dict(zip(table.spec.columns, s.values, strict=True)))
        return Result(s.to_dict(), "insert", more={"affected_rows": 1, "rid": rid}, run_time=time.perf_counter() - began)

    def _delete(self, s: D.Delete) -> Result:
        began = time.perf_counter()
        if s.where.operator != "=":
            raise RuntimeError("DELETE takes = only")
        n = self.table(s.table).delete(s.where.left, s.where.right)
        return Result(s.to_dict(), "delete", more={"affected_rows": n}, run_time=time.perf_counter() - began)

    def _create(self, s: D.Create) -> Result:
        began = time.perf_counter()
        columns, points = {}, {}
        for c in s.columns:
            if c.data_type == "POINT":
                points[c.name] = [f"{c.name}_x", f"{c.name}_y"]
                columns |= dict.fromkeys(points[c.name], "float")
            else:
                kind, _, size = c.data_type.partition("(")
                columns[c.name] = {"INT": "int", "FLOAT": "float"}.get(kind) or f"char({size.rstrip(')') or 255})"
        # the key: as declared; else the first SEQUENTIAL column; else the first column
        declared = next((c for c in s.columns if c.primary_key), None) or next((c for c in s.columns if c.index == "SEQUENTIAL"), None)
        key = declared.name if declared and declared.data_type != "POINT" else next(iter(columns))
        how = (declared.index or "BTREE").lower() if declared else "btree"
        table = self.create(s.name, columns, primary_key=key, pk_index_type=how if how != "rtree" else "btree", point_columns=points)
        for c in s.columns:
            target = points.get(c.name, c.name)
            if c.index and c.name != key and not table.has_index(target if isinstance(target, str) else tuple(target)):
                if c.index == "RTREE" and c.data_type != "POINT":
                    raise ValueError("RTREE is for POINT columns")
                table.spec.indexes.append(Index(target, c.index.lower() if c.index != "SEQUENTIAL" else "btree"))
        table.save()
        if s.file:
            self._load(table, s.file)
        return Result(s.to_dict(), "create_table", s.name, more={"status": "ok"}, run_time=time.perf_counter() - began)

    def _load(self, table: Table, name: str) -> int:
        path = self.uploads.find(name) if self.uploads else None
        if path is None:
            self.warnings.append(f"no file {name!r}")
            return 0
        spec = table.spec
        rows = read_csv(self.spark, str(path.resolve().as_uri()), [(c, spec.kind(c), spec.size(c)) for c in spec.columns])
        return table.insert_frame(rows, "_order")


_RUN: dict[type, Callable[[Database, Any], Result]] = {D.Select: Database._select, D.Insert: Database._insert, D.Delete: Database._delete, D.Create: Database._create}


def _failed(kind: str, error: Exception, phase: str) -> dict:
    return {"success": False, "error": {"type": kind, "message": str(error).partition("\n")[0], "phase": phase}}


class LenientDatabase:
    """The forgiving dialect over frames in memory: any comparison in DELETE, text compared without regard to case, unknown columns null, problems as messages."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables = dict(tables)

    def execute(self, source: str) -> list[dict]:
        statements, problems = D.parse_each(source)
        return [{"problem": p} for p in problems] + [self._run(s) for s in statements]

    def _where(self, rows: DataFrame, c):
        if c is None:
            return F.lit(True)
        if c.left not in rows.columns:
            return F.lit(False)
        if isinstance(c, D.Comparison):
            return F.coalesce(K.loosely(c.left, c.operator, c.right), F.lit(False))
        if isinstance(c, D.Between):
            return K.loosely_between(c.left, c.lower, c.upper)
        x, y = K.point_of_text(c.left)
        return F.coalesce(K.distance(x, y, c.x, c.y) <= float(c.value), F.lit(False))

    def _run(self, s: D.Statement) -> dict:
        name = s.name if isinstance(s, D.Create) else s.table
        if not isinstance(s, D.Create) and name not in self.tables:
            return {"type": s.to_dict()["type"], "message": f"no table {name!r}"}
        rows = self.tables.get(name)
        if isinstance(s, D.Create):
            if rows is None:
                spark = SparkSession.active()
                self.tables[name] = spark.createDataFrame([], ", ".join(f"`{c.name}` string" for c in s.columns))
            return {"type": "create_table", "message": f"table {name!r} is there"}
        if isinstance(s, D.Insert):
            if len(s.values) != len(rows.columns):
                return {"type": "insert", "message": f"{len(s.values)} values for {len(rows.columns)} columns"}
            new = rows.sparkSession.createDataFrame([tuple(str(v) for v in s.values)], ", ".join(f"`{c}` string" for c in rows.columns))
            self.tables[name] = rows.unionByName(new.select(*(F.col(c).cast(t).alias(c) for c, t in rows.dtypes)))
            return {"type": "insert", "affected_rows": 1}
        where = self._where(rows, s.where)
        if isinstance(s, D.Delete):
            n = rows.where(where).count()
            self.tables[name] = rows.where(~where)
            return {"type": "delete", "affected_rows": n}
        if isinstance(s.where, D.Near) and s.where.search == "k" and s.where.left in rows.columns:
            x, y = K.point_of_text(s.where.left)
            found = rows.where(x.isNotNull() & y.isNotNull()).orderBy(K.distance(x, y, s.where.x, s.where.y)).limit(int(s.where.value))
        else:
            found = rows.where(where)
        if s.order_by and s.order_by in rows.columns:
            c, number = F.lower(F.col(s.order_by).cast("string")), F.col(s.order_by).cast("string").try_cast("double")
            found = found.orderBy(*([number.desc_nulls_first(), c.desc_nulls_first()] if s.descending else [number.asc_nulls_last(), c.asc_nulls_last()]))
        columns = rows.columns if s.columns == ["*"] else s.columns
        return {"type": "select", "frame": found.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns))}
