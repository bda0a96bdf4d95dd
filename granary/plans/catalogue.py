"""Every query over the driver's tables, with the SQL that it is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.engine import Database
from granary.functions import kernels as K
from granary.operators import changes, spatial, txlog
from granary.plans.tables import RID, Mounted, Table
from granary.sources.csv_files import read_csv
from granary.sources.storage import scratch

Query = Callable[[SparkSession, str], DataFrame]

#: table -> column that tells its rows apart
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": "l_orderkey", "events": "event_id",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two coordinates of each embedding, as a point."""
    v = read(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.col("embedding")[0].alias("loc_x"), F.col("embedding")[1].alias("loc_y"))


def database(spark: SparkSession, sf_dir: str) -> Database:
    db = Database(spark, sf_dir)
    for name, key in KEYS.items():
        db.mount(name, read(spark, sf_dir, name), key)
    db.mount("places", places(spark, sf_dir), "vec_id", {"loc": ["loc_x", "loc_y"]})
    return db


def program(text: str) -> Query:
    """A query in the dialect."""
    return lambda spark, sf_dir: database(spark, sf_dir).sql(text)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return program("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 200")(spark, sf_dir)


#: name -> (program, SQL)
PROGRAMS: dict[str, tuple[str, str]] = {
    "scan_all": ("SELECT * FROM nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "project_columns": ("SELECT c_name, c_custkey FROM customer", "SELECT c_name, c_custkey FROM customer"),
    "project_unknown": ("SELECT c_name, nothing FROM customer", "SELECT c_name FROM customer"),
    "filter_eq_key": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 4242", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 4242"),
    "filter_eq_string": ("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = BUILDING", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_ne": ("SELECT c_custkey FROM customer WHERE c_mktsegment != 'BUILDING'", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING'"),
    "filter_lt": ("SELECT p_partkey, p_size FROM part WHERE p_size < 5", "SELECT p_partkey, p_size FROM part WHERE p_size < 5"),
    "filter_gt": ("SELECT p_partkey, p_size FROM part WHERE p_size > 45", "SELECT p_partkey, p_size FROM part WHERE p_size > 45"),
    "filter_le": ("SELECT p_partkey, p_size FROM part WHERE p_size <= 5", "SELECT p_partkey, p_size FROM part WHERE p_size <= 5"),
    "filter_ge": ("SELECT p_partkey, p_size FROM part WHERE p_size >= 45", "SELECT p_partkey, p_size FROM part WHERE p_size >= 45"),
    "filter_fraction": ("SELECT p_partkey, p_size FROM part WHERE p_size < 4.5", "SELECT p_partkey, p_size FROM part WHERE p_size < 4.5"),
    "between_int": ("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 1000 AND 1500", "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 1000 AND 1500"),
    "between_double": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 101000.5", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 101000.5"),
    "between_string": ("SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'FURNITURE'", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment BETWEEN 'B' AND 'FURNITURE'"),
    "point_projection": ("SELECT vec_id, loc FROM places", "SELECT vec_id, embedding[1] AS loc_x, embedding[2] AS loc_y FROM embeddings"),
}


def radius_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = database(spark, sf_dir).sql("SELECT * FROM places WHERE loc IN (POINT(0, 0), RADIUS 0.05)")
    return found.select("vec_id", F.round("_distance", 6).alias("distance"))


def radius_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    found = spatial.within(rows, "x", "y", 25, 50, 2.5, ["l_orderkey", "l_linenumber"])
    return found.select("l_orderkey", "l_linenumber", F.round("_distance", 6).alias("distance"))


def knn(offset: int) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = spatial.nearest(places(spark, sf_dir), "loc_x", "loc_y", 0, 0, 5, ["vec_id"], offset=offset)
        return found.select("vec_id", F.round("_distance", 6).alias("distance"))

    return run


def point_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    rows = rows.withColumns({"x": F.col("l_quantity").cast("float"), "y": F.col("l_discount").cast("float")})
    found = Mounted("lines", rows, "key", {"at": ["x", "y"]}).select_point("at", 25, 0.05)
    return found.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


def spatial_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON envelope, read back: a row for each result."""
    found = spatial.nearest(places(spark, sf_dir), "loc_x", "loc_y", 0, 0, 3, ["vec_id"])
    text = spatial.points_json(found, "loc_x", "loc_y", "vec_id", 0, 0)
    shape = "struct<query_point: struct<x: double, y: double, color: string>, results: array<struct<x: float, y: float, rid: long, distance: double, color: string>>, total: long>"
    e = text.select(F.from_json("envelope", F.lit(shape)).alias("e")).select("e.*", F.posexplode("e.results").alias("nth", "r"))
    return e.select(F.col("query_point.x").alias("query_x"), F.col("query_point.color").alias("query_color"), "total", F.col("nth").cast("long").alias("nth"), F.col("r.rid").alias("rid"), F.col("r.distance").alias("distance"), F.col("r.color").alias("color"))


def cell_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = places(spark, sf_dir).select(F.col("loc_x").cast("double").alias("x"), F.col("loc_y").cast("double").alias("y"))
    return spatial.cell_extents(rows, "x", "y", 0.25)


def filter_eq_float32(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("f", F.col("l_discount").cast("float"))
    return rows.where(K.compare("f", "float", "=", 0.05)).select("l_orderkey", "l_linenumber", "l_discount")


def truncated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 bytes of each text; a character that is cut there (U+FFFD) is taken off, since SQL has no bytes that are half a character."""
    rows = read(spark, sf_dir, "documents").select("doc_id", K.truncate_bytes("text", 40).alias("t"))
    return rows.select("doc_id", F.regexp_replace("t", "\ufffd$", "").alias("t"))


def ordered(table: str, order: list[str], *columns: str, where: str | None = None) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = read(spark, sf_dir, table).select(*columns)
        return changes.positions(rows.where(where) if where else rows, order).select("pos", *columns)

    return run


def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = database(spark, sf_dir).table("orders").select_range("o_orderkey", 1000, 1500, limit=100, offset=100)
    return rows.select("o_orderkey", "o_totalprice")


def delete_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.without(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("o_orderstatus") == "P")


def insert_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "nation")
    return changes.append(rows, spark.createDataFrame([(100, "ATLANTIS", 4)], rows.schema))


def upsert_pk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return changes.newest(rows, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])


def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [read(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in KEYS]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer")
    path = scratch(spark, "csv")
    rows.write.csv(path, sep=";", header=False)
    columns = [("c_custkey", "int", 0), ("c_name", "char", 25), ("c_nationkey", "int", 0), ("c_acctbal", "float", 0), ("c_mktsegment", "char", 20)]
    back = read_csv(spark, path, columns)
    return back.select(F.col("c_custkey").cast("long"), "c_name", "c_nationkey", F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"), "c_mktsegment")


def log_of(spark: SparkSession, sf_dir: str, ops: dict[str, str]) -> DataFrame:
    """The events table read as a transaction log; event types without an operation have none."""
    op = F.create_map(*(F.lit(x) for kv in ops.items() for x in kv))[F.col("event_type")]
    e = read(spark, sf_dir, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("event_id").alias("seq"), ts.alias("ts"), F.col("user_id").alias("tx_id"), F.coalesce(op, F.lit("BEGIN")).alias("op"), F.concat(F.lit("page="), F.col("event_id") % 500).alias("detail"), (F.col("event_id") % 500).alias("page"))


ACCESS = {"click": "WRITE", "purchase": "WRITE", "view": "READ", "signup": "COMMIT", "error": "ERROR"}
LOCKS = {"click": "LOCK_X", "purchase": "LOCK_X", "view": "LOCK_S"}


def tx_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txlog.conflicts(log_of(spark, sf_dir, ACCESS))


#: A log in which transactions lock, write and fail.
TROUBLE = {"click": "LOCK_X", "purchase": "WRITE", "view": "LOCK_S", "signup": "ABORT", "error": "ERROR"}


def tx_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txlog.summary(log_of(spark, sf_dir, TROUBLE)).withColumn("duration_ms", F.round("duration_ms", 1))


def tx_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = log_of(spark, sf_dir, TROUBLE)
    return txlog.totals(log.withColumn("detail", F.when(F.col("seq") % 3 == 0, F.concat(F.lit("Deadlock: "), "detail")).otherwise(F.col("detail"))))


def tx_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txlog.timeline(log_of(spark, sf_dir, ACCESS))


def tx_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txlog.flows(log_of(spark, sf_dir, ACCESS)).select("tx_id", "flow", F.size("errors").cast("long").alias("n_errors"))


def lock_contention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txlog.contention(log_of(spark, sf_dir, LOCKS))


def deadlock_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return txlog.cycles(e.select(F.col("user_id").alias("waiter"), ((F.col("user_id") * F.col("user_id") + 1) % 150).alias("holder")))


def laid_out(name: str, columns: dict[str, str], source: Callable[[SparkSession, str], DataFrame], points: dict[str, list[str]] | None = None, how: str = "btree", index: tuple | None = None) -> Callable[[SparkSession, str], Table]:
    """The rows of a driver table as a table of the engine, in one of its layouts."""

    def make(spark: SparkSession, sf_dir: str) -> Table:
        table = Table.create(spark, scratch(spark, "tables"), name, columns, primary_key=next(iter(columns)), pk_index_type=how, point_columns=points)
        if index:
            table.create_index(*index)
        table.insert_frame(source(spark, sf_dir))
        return table

    return make


_ORDERS = {"o_orderkey": "int", "o_orderstatus": "char(1)", "o_totalprice": "float"}
_orders = lambda spark, sf_dir: read(spark, sf_dir, "orders")
bucketed = laid_out("orders_hash", _ORDERS, _orders, index=("o_orderstatus", "hash"))
clustered = laid_out("orders_seq", _ORDERS, _orders, how="sequential")
gridded = laid_out("places_grid", {"vec_id": "int", "loc_x": "float", "loc_y": "float"}, places, {"loc": ["loc_x", "loc_y"]}, index=(("loc_x", "loc_y"), "rtree"))


def lookup_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(spark, sf_dir).matching("o_orderstatus", "=", "P").select("o_orderkey", "o_orderstatus")


def lookup_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(spark, sf_dir).select_range("o_orderkey", 1000, 1050).select("o_orderkey", "o_orderstatus")


def lookup_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gridded(spark, sf_dir).near(0, 0, radius=0.05, point="loc")
    return found.select("vec_id", F.round("_distance", 6).alias("distance"))


def delete_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = bucketed(spark, sf_dir)
    table.delete("o_orderstatus", "P")
    return table.frame().drop(RID).select("o_orderkey", "o_orderstatus")


def nations(spark: SparkSession, sf_dir: str, how: str = "btree") -> tuple[Database, Table]:
    """A database of its own with the nations as a stored table."""
    root = scratch(spark, "tables")
    db = Database(spark, root)
    done = db.execute(f"CREATE TABLE nations (n_nationkey INT PRIMARY KEY INDEX {how.upper()}, n_name VARCHAR(25), n_regionkey INT)")
    assert done["success"], done
    table = db.table("nations")
    table.insert_frame(read(spark, sf_dir, "nation"), "n_nationkey")
    return Database(spark, root), table


def through(how: str, text: str) -> Query:
    """The nations after a program of the dialect has run over the stored table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db, _ = nations(spark, sf_dir, how)
        done = db.execute(text)
        assert done["success"], done
        return db.sql("SELECT * FROM nations")

    return run


def table_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, table = nations(spark, sf_dir)
    return spark.createDataFrame([(table.recount(), table.count(), table.spec.record_count)], "recounted long, counted long, kept long")


def index_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hash index made and dropped again: whether it is there, and the rows that the same lookup gives each time."""
    _, table = nations(spark, sf_dir)
    rows = []
    for step, change in (("before", lambda: None), ("made", lambda: table.create_index("n_regionkey", "hash")), ("dropped", lambda: table.drop_index("n_regionkey"))):
        change()
        rows.append((step, table.has_index("n_regionkey"), table.select("n_regionkey", 2).count(), table.select_many("n_regionkey", [1, 2, 77]).count()))
    return spark.createDataFrame(rows, "step string, there boolean, n long, n_many long")


def knn_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = gridded(spark, sf_dir)
    found = table.near(0.1, -0.1, k=7, point="loc")
    return found.select("vec_id", F.round("_distance", 6).alias("distance"))


def order_by_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialect's ORDER BY, with WHERE; the place of each row is read off the sorted result, which is one partition at most of a few thousand rows."""
    rows = database(spark, sf_dir).sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice")
    return rows.coalesce(1).withColumn("pos", F.monotonically_increasing_id() + 1)


_X, _Y = "CAST(embedding[1] AS DOUBLE)", "CAST(embedding[2] AS DOUBLE)"
_NEAR = f"SELECT vec_id, round(sqrt({_X} * {_X} + {_Y} * {_Y}), 6) AS distance FROM embeddings"
_ACCESS_SQL = "SELECT *, event_id % 500 AS page, CASE event_type WHEN 'click' THEN 'WRITE' WHEN 'purchase' THEN 'WRITE' WHEN 'view' THEN 'READ' WHEN 'signup' THEN 'COMMIT' WHEN 'error' THEN 'ERROR' ELSE 'BEGIN' END AS op FROM events"
_EDGES = "SELECT DISTINCT user_id AS a, (user_id * user_id + 1) % 150 AS b FROM events"
_TROUBLE_SQL = "SELECT *, event_id % 500 AS page, CASE event_type WHEN 'click' THEN 'LOCK_X' WHEN 'purchase' THEN 'WRITE' WHEN 'view' THEN 'LOCK_S' WHEN 'signup' THEN 'ABORT' WHEN 'error' THEN 'ERROR' ELSE 'BEGIN' END AS op FROM events"

#: name -> (query, SQL or None)
OTHERS: dict[str, tuple[Query, str | None]] = {
    "filter_eq_float32": (filter_eq_float32, "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE CAST(l_discount AS FLOAT) = CAST(0.05 AS FLOAT)"),
    "truncated_text": (truncated_text, "SELECT doc_id, substring(text, 1, len([i for i in range(1, least(length(text), 40) + 1) if strlen(substring(text, 1, CAST(i AS INT))) <= 40])) AS t FROM documents"),
    "radius_small": (radius_sql, f"{_NEAR} WHERE sqrt({_X} * {_X} + {_Y} * {_Y}) <= 0.05"),
    "radius_large": (radius_large, "SELECT l_orderkey, l_linenumber, round(sqrt((l_quantity - 25) * (l_quantity - 25) + (l_extendedprice / 1000 - 50) * (l_extendedprice / 1000 - 50)), 6) AS distance FROM lineitem WHERE sqrt((l_quantity - 25) * (l_quantity - 25) + (l_extendedprice / 1000 - 50) * (l_extendedprice / 1000 - 50)) <= 2.5"),
    "knn": (knn(0), f"{_NEAR} ORDER BY sqrt({_X} * {_X} + {_Y} * {_Y}), vec_id LIMIT 5"),
    "knn_paged": (knn(5), f"{_NEAR} ORDER BY sqrt({_X} * {_X} + {_Y} * {_Y}), vec_id LIMIT 5 OFFSET 5"),
    "point_exact": (point_exact, "SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM lineitem WHERE l_quantity = 25 AND l_discount = 0.05"),
    "spatial_envelope": (spatial_envelope, f"SELECT 0.0::DOUBLE AS query_x, 'red' AS query_color, CAST(3 AS BIGINT) AS total, row_number() OVER (ORDER BY sqrt({_X} * {_X} + {_Y} * {_Y}), vec_id) - 1 AS nth, vec_id AS rid, round(sqrt({_X} * {_X} + {_Y} * {_Y}), 6) AS distance, 'blue' AS color FROM embeddings ORDER BY nth LIMIT 3"),
    "cell_extents": (cell_extents, f"SELECT CAST(floor({_X} / 0.25) AS BIGINT) AS cx, CAST(floor({_Y} / 0.25) AS BIGINT) AS cy, min({_X}) AS min_x, min({_Y}) AS min_y, max({_X}) AS max_x, max({_Y}) AS max_y, count(*) AS n FROM embeddings GROUP BY 1, 2"),
    "order_by": (ordered("orders", ["o_totalprice", "o_orderkey"], "o_orderkey", "o_totalprice"), "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos, o_orderkey, o_totalprice FROM orders"),
    "order_by_string": (ordered("customer", ["c_name", "c_custkey"], "c_custkey", "c_name"), "SELECT row_number() OVER (ORDER BY c_name, c_custkey) AS pos, c_custkey, c_name FROM customer"),
    "where_order_by": (ordered("orders", ["o_totalprice", "o_orderkey"], "o_orderkey", "o_orderstatus", "o_totalprice", where="o_orderstatus = 'P'"), "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos, o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus = 'P'"),
    "page_range": (page_range, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 1000 AND 1500 ORDER BY o_orderkey LIMIT 100 OFFSET 100"),
    "delete_eq": (delete_eq, "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'"),
    "insert_append": (insert_append, "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100, 'ATLANTIS', 4"),
    "upsert_pk": (upsert_pk, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1"),
    "row_count": (row_count, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in KEYS)),
    "csv_roundtrip": (csv_roundtrip, "SELECT c_custkey, c_name, c_nationkey, round(CAST(CAST(c_acctbal AS FLOAT) AS DOUBLE), 2) AS c_acctbal, c_mktsegment FROM customer"),
    "tx_conflicts": (tx_conflicts, f"SELECT page, CASE WHEN bool_and(op = 'WRITE') THEN 'W-W' ELSE 'R-W' END AS kind, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS transactions FROM ({_ACCESS_SQL}) WHERE op IN ('READ', 'WRITE') GROUP BY page HAVING count(DISTINCT user_id) > 1 AND bool_or(op = 'WRITE')"),
    "tx_summary": (tx_summary, f"SELECT user_id AS tx_id, CASE WHEN bool_or(op = 'COMMIT') THEN 'COMMIT' WHEN bool_or(op = 'ABORT') THEN 'ABORT' ELSE 'ACTIVE' END AS status, count(*) FILTER (op = 'LOCK_S') AS locks_s, count(*) FILTER (op = 'LOCK_X') AS locks_x, count(*) FILTER (op = 'READ') AS reads, count(*) FILTER (op = 'WRITE') AS writes, min(event_id) AS first_seq, max(event_id) AS last_seq, round((epoch_us(arg_max(ts, event_id)) - epoch_us(arg_min(ts, event_id))) / 1000.0, 1) AS duration_ms FROM ({_TROUBLE_SQL}) GROUP BY user_id"),
    "tx_totals": (tx_totals, f"SELECT count(*) FILTER (op = 'ERROR' AND event_id % 3 = 0) AS deadlocks, count(*) FILTER (op = 'ABORT') AS aborts FROM ({_TROUBLE_SQL})"),
    "tx_flows": (tx_flows, f"SELECT user_id AS tx_id, string_agg(op || '(page=' || page || ')', ' -> ' ORDER BY event_id) FILTER (op IN ('BEGIN', 'COMMIT', 'ERROR')) AS flow, count(*) FILTER (op = 'ERROR') AS n_errors FROM ({_ACCESS_SQL}) GROUP BY user_id"),
    "tx_timeline": (tx_timeline, f"SELECT event_id AS seq, '[' || strftime(ts, '%H:%M:%S.%g') || '] TX' || lpad(CAST(user_id AS VARCHAR), CAST(greatest(length(CAST(user_id AS VARCHAR)), 2) AS INT), ' ') || '  ' || rpad(op, 15, ' ') || ' page=' || page AS line FROM ({_ACCESS_SQL})"),
    "lock_contention": (lock_contention, "SELECT page, count(*) AS n_locks, array_to_string(list_sort(list(DISTINCT t)), ',') AS lock_types, array_to_string(list_sort(list(DISTINCT user_id)), ',') AS transactions, count(DISTINCT user_id) > 1 AND bool_or(t = 'X') AS contended FROM (SELECT *, event_id % 500 AS page, CASE WHEN event_type = 'view' THEN 'S' ELSE 'X' END AS t FROM events WHERE event_type IN ('click', 'purchase', 'view')) GROUP BY page"),
    "deadlock_cycle": (deadlock_cycle, f"WITH RECURSIVE e AS ({_EDGES}), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT DISTINCT a AS node FROM r WHERE a = b"),
    "lookup_bucketed": (lookup_bucketed, "SELECT CAST(o_orderkey AS INT) AS o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'P'"),
    "lookup_clustered": (lookup_clustered, "SELECT CAST(o_orderkey AS INT) AS o_orderkey, o_orderstatus FROM orders WHERE o_orderkey BETWEEN 1000 AND 1050"),
    "lookup_grid": (lookup_grid, f"SELECT CAST(vec_id AS INT) AS vec_id, distance FROM ({_NEAR} WHERE sqrt({_X} * {_X} + {_Y} * {_Y}) <= 0.05)"),
    "insert_program": (through("btree", "INSERT INTO nations VALUES (100, 'ATLANTIS', 4); INSERT INTO nations VALUES (7, 'AGAIN', 1)"), "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM nation UNION ALL SELECT 100, 'ATLANTIS', 4 UNION ALL SELECT 7, 'AGAIN', 1"),
    "upsert_program": (through("sequential", "INSERT INTO nations VALUES (100, 'ATLANTIS', 4); INSERT INTO nations VALUES (7, 'AGAIN', 1)"), "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM nation WHERE n_nationkey <> 7 UNION ALL SELECT 100, 'ATLANTIS', 4 UNION ALL SELECT 7, 'AGAIN', 1"),
    "delete_program": (through("btree", "DELETE FROM nations WHERE n_regionkey = 2; DELETE FROM nations WHERE n_name = 'FRANCE'"), "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM nation WHERE n_regionkey <> 2 AND n_name <> 'FRANCE'"),
    "delete_clustered": (through("sequential", "INSERT INTO nations VALUES (7, 'AGAIN', 1); DELETE FROM nations WHERE n_nationkey = 7"), "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM nation WHERE n_nationkey <> 7"),
    "table_recount": (table_recount, "SELECT count(*) AS recounted, count(*) AS counted, count(*) AS kept FROM nation"),
    "index_lifecycle": (index_lifecycle, "SELECT step, step = 'made' AS there, (SELECT count(*) FROM nation WHERE n_regionkey = 2) AS n, (SELECT count(*) FROM nation WHERE n_regionkey IN (1, 2)) AS n_many FROM (VALUES ('before'), ('made'), ('dropped')) t(step)"),
    "knn_program": (lambda spark, sf_dir: database(spark, sf_dir).sql("SELECT * FROM places WHERE loc IN (POINT(0, 0), K 5)").select("vec_id", F.round("_distance", 6).alias("distance")), f"{_NEAR} ORDER BY sqrt({_X} * {_X} + {_Y} * {_Y}), vec_id LIMIT 5"),
    "knn_grid": (knn_grid, f"SELECT CAST(vec_id AS INT) AS vec_id, round(sqrt(({_X} - 0.1) * ({_X} - 0.1) + ({_Y} + 0.1) * ({_Y} + 0.1)), 6) AS distance FROM embeddings ORDER BY sqrt(({_X} - 0.1) * ({_X} - 0.1) + ({_Y} + 0.1) * ({_Y} + 0.1)), vec_id LIMIT 7"),
    "order_by_program": (order_by_program, "SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS pos, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'"),
    "delete_layout": (delete_layout, "SELECT CAST(o_orderkey AS INT) AS o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P'"),
}


def queries() -> dict[str, Query]:
    return {name: program(text) for name, (text, _) in PROGRAMS.items()} | {name: query for name, (query, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (PROGRAMS | OTHERS).items() if sql}
