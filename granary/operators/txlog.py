"""Analysis of transaction logs: frames (seq, ts, tx_id, op, detail), in order of seq.

op is one of BEGIN, SEARCH, FOUND, NOT_FOUND, RANGE_SEARCH, RANGE_RESULT, INSERT, INSERT_OK, DELETE, DELETE_OK, DELETE_NOTFOUND, LOCK_S, LOCK_X, READ, WRITE, ERROR, COMMIT,
ABORT; the page of an entry stands in detail as page=N. ts is in seconds since the epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.storage import discard, settle

#: Operations that a transaction's flow shows.
FLOW = ("BEGIN", "SEARCH", "INSERT", "DELETE", "RANGE_SEARCH", "COMMIT", "ABORT", "ERROR")
SCHEMA = "seq long, ts double, tx_id long, op string, detail string"


def from_entries(spark: SparkSession, entries: list[dict]) -> DataFrame:
    return spark.createDataFrame([(i, e["time"], e["tx_id"], e["op"], e["detail"]) for i, e in enumerate(entries)], SCHEMA)


def page() -> Column:
    return F.regexp_extract("detail", r"page=(\d+)", 1).try_cast("long")


def with_page(log: DataFrame) -> DataFrame:
    return log.withColumn("page", page())


def ids(c: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",")


def conflicts(log: DataFrame) -> DataFrame:
    """page, kind, transactions: pages that more than one transaction reads or writes, one of them at least writing. W-W if all accesses are writes, else R-W."""
    used = log.where(F.col("op").isin("READ", "WRITE") & F.col("page").isNotNull())
    writes = F.col("op") == "WRITE"
    found = used.groupBy("page").agg(F.countDistinct("tx_id").alias("n"), F.bool_or(writes).alias("some"), F.bool_and(writes).alias("all"), ids("tx_id").alias("transactions"))
    return found.where("n > 1 AND some").select("page", F.when(F.col("all"), "W-W").otherwise("R-W").alias("kind"), "transactions")


def summary(log: DataFrame) -> DataFrame:
    """One row for each transaction: status, locks, reads, writes, first and last entry, and how long it took."""

    def n(op: str) -> Column:
        return F.count_if(F.col("op") == op)

    status = F.when(n("COMMIT") > 0, "COMMIT").when(n("ABORT") > 0, "ABORT").otherwise("ACTIVE")
    return log.groupBy("tx_id").agg(
        status.alias("status"), n("LOCK_S").alias("locks_s"), n("LOCK_X").alias("locks_x"), n("READ").alias("reads"), n("WRITE").alias("writes"),
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), ((F.max_by("ts", "seq") - F.min_by("ts", "seq")) * 1000).alias("duration_ms"),
    )


def flows(log: DataFrame) -> DataFrame:
    """tx_id, flow, errors: the operations of each transaction, in order, with their details."""
    step = F.concat("op", F.when(F.coalesce("detail", F.lit("")) != "", F.concat(F.lit("("), "detail", F.lit(")"))).otherwise(""))
    listed = F.array_sort(F.collect_list(F.when(F.col("op").isin(*FLOW), F.struct("seq", step.alias("step")))))
    errors = F.array_sort(F.collect_list(F.when(F.col("op") == "ERROR", F.struct("seq", "detail"))))
    return log.groupBy("tx_id").agg(F.array_join(F.transform(listed, lambda s: s["step"]), " -> ").alias("flow"), F.transform(errors, lambda e: e["detail"]).alias("errors"))


def contention(log: DataFrame) -> DataFrame:
    """page, n_locks, lock_types, transactions, contended: locks by page; contended if several transactions hold them and one is exclusive."""
    locks = log.where(F.col("op").isin("LOCK_S", "LOCK_X") & F.col("page").isNotNull()).withColumn("type", F.right("op", F.lit(1)))
    found = locks.groupBy("page").agg(F.count("*").alias("n_locks"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("lock_types"), ids("tx_id").alias("transactions"), F.countDistinct("tx_id").alias("n"))
    return found.withColumn("contended", (F.col("n") > 1) & F.col("lock_types").contains("X")).drop("n")


def totals(log: DataFrame) -> DataFrame:
    """deadlocks, aborts."""
    deadlock = (F.col("op") == "ERROR") & F.lower("detail").contains("deadlock")
    return log.agg(F.count_if(deadlock).alias("deadlocks"), F.count_if(F.col("op") == "ABORT").alias("aborts"))


def timeline(log: DataFrame) -> DataFrame:
    """seq, line: the log in order of arrival, a line for each entry."""
    when = F.date_format(F.timestamp_micros(F.round(F.col("ts") * 1_000_000).cast("long")), "HH:mm:ss.SSS")
    tx = F.col("tx_id").cast("string")
    return log.orderBy("seq").select("seq", F.concat(F.lit("["), when, F.lit("] TX"), F.lpad(tx, F.greatest(F.length(tx), F.lit(2)), F.lit(" ")), F.lit("  "), F.rpad("op", 15, " "), F.lit(" "), "detail").alias("line"))


#: Edges that may be on cycles and are looked at by the driver, at most (16 bytes each); more are left to joins.
CORE_EDGES = 200_000


def cycles(edges: DataFrame) -> DataFrame:
    """node: those that wait, directly or over any number of others, for themselves. edges: (waiter, holder) longs; nulls are no edges.

    What waits for nobody, or is waited for by nobody, is on no cycle: such nodes go, again and again, until all that are left wait and are waited for. That core is small where locks
    time out: up to CORE_EDGES the driver finds its strongly connected components; a larger one is searched by joins that double the length of the known paths until
    nothing new is reached. Both tell all cycles, however long.
    """
    spark = edges.sparkSession
    core = settle(edges.select(F.col("waiter").cast("long"), F.col("holder").cast("long")).where("waiter IS NOT NULL AND holder IS NOT NULL").distinct(), "edges")
    n = core.count()
    while n > CORE_EDGES:
        kept = settle(core.join(core.select(F.col("waiter").alias("holder")).distinct(), "holder", "left_semi").join(core.select(F.col("holder").alias("waiter")).distinct(), "waiter", "left_semi").select("waiter", "holder"), "core")
        before, (core, n) = (core, n), (kept, kept.count())
        discard(before[0])
        if n == before[1]:
            break
    if n <= CORE_EDGES:
        found = on_cycles([(r[0], r[1]) for r in core.collect()])
        return spark.createDataFrame([(x,) for x in found], "node long")
    reach, size = core, n
    while True:
        longer = reach.alias("a").join(reach.alias("b"), F.col("a.holder") == F.col("b.waiter")).select(F.col("a.waiter"), F.col("b.holder"))
        reach = settle(reach.union(longer).distinct(), "reach")
        if size == (size := reach.count()):
            return reach.where("waiter = holder").select(F.col("waiter").alias("node")).distinct()


def on_cycles(edges: list[tuple[int, int]]) -> list[int]:
    """The nodes of strongly connected components of several nodes, and those that wait for themselves. Finish order forwards, then components backwards; no recursion."""
    ahead, back = {}, {}
    for u, v in edges:
        ahead.setdefault(u, []).append(v)
        back.setdefault(v, []).append(u)
    order, seen = [], set()
    for start in ahead:
        stack = [] if start in seen else [(start, iter(ahead[start]))]
        seen.add(start)
        while stack:
            node, rest = stack[-1]
            for other in rest:
                if other not in seen:
                    seen.add(other)
                    stack.append((other, iter(ahead.get(other, ()))))
                    break
            else:
                order.append(node)
                stack.pop()
    found, done = {u for u, v in edges if u == v}, set()
    for root in reversed(order):
        if root not in done:
            done.add(root)
            part = [root]
            for node in part:  # grows while it is read
                new = [x for x in back.get(node, ()) if x not in done]
                done.update(new)
                part += dict.fromkeys(new)
            if len(part) > 1:
                found.update(part)
    return sorted(found)


def report(log: DataFrame) -> str:
    """The log's analysis as text. What is printed is one line for each transaction, page and entry, so it is for logs that a person reads."""
    log = with_page(log)
    rule, out = "-" * 72, ["=" * 72, "  CONCURRENCY REPORT", "=" * 72, "", "PROTOCOL: strict two-phase locking, by page; shared and exclusive locks; released at the end; deadlocks found in the wait-for graph", ""]
    flow = {r["tx_id"]: r for r in flows(log).collect()}
    rows = summary(log).orderBy("tx_id").collect()
    out += ["TRANSACTIONS", rule, f"  Total: {len(rows)}", ""]
    for r in rows:
        out += [f"  TX{r['tx_id']} [{r['status']}]  {r['duration_ms']:.1f} ms", f"    Locks: {r['locks_s']} S + {r['locks_x']} X  |  I/O: {r['reads']} reads + {r['writes']} writes"]
        out += [f"    ERROR: {e}" for e in flow[r["tx_id"]]["errors"]] + [f"    Flow: {flow[r['tx_id']]['flow']}", ""]
    out += ["LOCKS BY PAGE", rule]
    out += [f"  Page {r['page']}: {r['n_locks']} locks ({r['lock_types']}) by TX [{r['transactions']}]{' CONTENTION' if r['contended'] else ''}" for r in contention(log).orderBy("page").collect()]
    found = conflicts(log).orderBy("kind", "page").collect()
    out += ["", "CONFLICTS", rule, f"  Total: {len(found)}"] + [f"  {r['kind']} page {r['page']}: TX [{r['transactions']}]" for r in found]
    t = totals(log).first()
    out += ["", "DEADLOCKS AND ABORTS", rule, f"  Deadlocks: {t['deadlocks']}", f"  Aborted: {t['aborts']}", "", "TIMELINE", rule]
    return "\n".join([*out, *("  " + r["line"] for r in timeline(log).collect()), "", "=" * 72]) + "\n"
