import threading
import time

import pytest

from granary.operators import txlog
from granary.operators.locks import EXCLUSIVE, SHARED, DeadlockError, LockManager, LockTimeoutError, PagedIndex, Transaction, TransactionLog
from granary.streaming.txtail import contended_pages, tail


def test_modes_and_upgrade():
    m = LockManager()
    m.acquire(1, 0, SHARED)
    m.acquire(2, 0, SHARED)
    with pytest.raises(LockTimeoutError):
        m.acquire(1, 0, EXCLUSIVE, timeout=0.1)
    m.release(2, 0)
    m.acquire(1, 0, EXCLUSIVE)
    m.acquire(1, 0, SHARED)
    assert m.holding(1) == {0: EXCLUSIVE}
    began = time.monotonic()
    with pytest.raises(LockTimeoutError):
        m.acquire(2, 0, EXCLUSIVE, timeout=0.3)
    assert 0.25 < time.monotonic() - began < 1.5
    m.release_all(1)
    m.acquire(2, 0, EXCLUSIVE)


def test_deadlock():
    m, ready, failed = LockManager(), threading.Barrier(2), []

    def run(tx, first, second):
        m.acquire(tx, first, EXCLUSIVE)
        ready.wait()
        try:
            m.acquire(tx, second, EXCLUSIVE, timeout=5)
        except DeadlockError as e:
            failed.append(e)
        m.release_all(tx)

    threads = [threading.Thread(target=run, args=a) for a in ((1, 0, 1), (2, 1, 0))]
    [t.start() for t in threads]
    [t.join(10) for t in threads]
    assert len(failed) == 1


def test_transactions(spark, tmp_path):
    index, locks, log = PagedIndex(), LockManager(), TransactionLog()
    tx = Transaction(index, locks, log)
    for k in range(20):
        tx.add(k, (0, k))
    tx.add(5, (1, 5))
    assert tx.search(5) == (0, 5) and tx.search(99) is None and len(tx.range_search(10, 19)) == 10
    assert tx.remove(5, (1, 5)) and not tx.remove(77)
    tx.commit()
    with pytest.raises(RuntimeError):
        tx.search(1)
    other = Transaction(index, locks, log)
    other.add(50, (9, 9))
    other.abort()
    assert not locks.holding(other.id) and index.between(50, 50)  # an abort undoes nothing
    reader = Transaction(index, locks, log)
    assert reader.search(0) == (0, 0)
    reader.commit()
    frame = txlog.from_entries(spark, log.entries)
    text = txlog.report(frame)
    assert f"TX{tx.id} [COMMIT]" in text and f"TX{other.id} [ABORT]" in text and "Aborted: 1" in text
    assert log.lines() and (log.clear() or not log.entries)


LOG = [(0, "BEGIN", ""), (1, "LOCK_S", "page=0"), (1, "READ", "page=0"), (2, "LOCK_X", "page=0"), (2, "WRITE", "page=0"), (2, "WRITE", "page=1"), (1, "WRITE", "page=1"), (2, "ERROR", "Deadlock on page=1"), (2, "ABORT", ""), (1, "COMMIT", "")]


def test_analysis(spark):
    log = txlog.with_page(txlog.from_entries(spark, [{"time": 1000.0 + i, "tx_id": t, "op": o, "detail": d} for i, (t, o, d) in enumerate(LOG)]))
    assert {r["page"]: (r["kind"], r["transactions"]) for r in txlog.conflicts(log).collect()} == {0: ("R-W", "1,2"), 1: ("W-W", "1,2")}
    by = {r["tx_id"]: r for r in txlog.summary(log).collect()}
    assert (by[0]["status"], by[1]["status"], by[2]["status"]) == ("ACTIVE", "COMMIT", "ABORT") and by[1]["duration_ms"] == 8000
    assert [tuple(r) for r in txlog.contention(log).collect()] == [(0, 2, "S,X", "1,2", True)]
    assert tuple(txlog.totals(log).first()) == (1, 1)
    assert {r["tx_id"]: r["flow"] for r in txlog.flows(log).collect()}[2] == "ERROR(Deadlock on page=1) -> ABORT"
    assert txlog.timeline(log).first()["line"].startswith("[00:16:40.000] TX 0  BEGIN")


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (7, 7), (None, 1)], "waiter long, holder long")
    assert sorted(r[0] for r in txlog.cycles(edges).collect()) == [1, 2, 3, 7]


def test_tail(spark, tmp_path):
    entries = [{"time": 1000.0 + i, "tx_id": t, "op": o, "detail": d} for i, (t, o, d) in enumerate(LOG)]
    txlog.from_entries(spark, entries).coalesce(1).write.json(str(tmp_path / "log"))
    q = contended_pages(tail(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("contended").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["page"], r["n_locks"]) for r in spark.table("contended").collect()] == [(0, 2)]


def test_cycles_of_any_length(spark, monkeypatch):
    """A cycle of 150, chains into it and out of it, two cycles that meet; by the driver and by joins."""
    ring = [(i, (i + 1) % 150) for i in range(150)]
    pairs = [*ring, *((1000 + i, 1001 + i) for i in range(40)), (1040, 5), (9, 2000), (2000, 2001), (3000, 3001), (3001, 3002), (3002, 3000), (3001, 3003), (3003, 3001), (4000, 4000), (None, 1), (1, None)]
    edges, want = spark.createDataFrame(pairs, "waiter long, holder long"), [*range(150), 3000, 3001, 3002, 3003, 4000]
    assert sorted(r[0] for r in txlog.cycles(edges).collect()) == want
    monkeypatch.setattr(txlog, "CORE_EDGES", 10)
    assert sorted(r[0] for r in txlog.cycles(edges).collect()) == want
    assert txlog.cycles(edges.limit(0)).count() == 0
