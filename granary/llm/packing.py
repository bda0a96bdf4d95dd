"""Best-fit packing by the configuration linear program.

Pieces matter only by length, so the whole problem is a histogram of at most 2048 counts, whatever the corpus holds. A configuration is a
multiset of lengths that fit into one sequence. The program (as few sequences as cover every length's count) is solved by multiplicative
weights: a length that is covered less than the others gets more weight, and a knapsack dynamic program prices the best configurations for the weights. Each
pricing's configurations are rounded down at once, within what there is, and the next one solves what is left; the last few pieces go, best fit first, into the gaps.
Several starting prices are tried, one of them so that no configuration is taken and all is left to best fit; the fewest sequences win. What no packing can be
better than is told by feasible dual prices.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import lean, materialize, small_batches, table, texts, to_arrow
from granary.llm.tokens import encoder, forget

VOCABULARY = "byte_bpe_50k.json"
END = 0
CAPACITY = 2048
#: Starting prices and steps: how much more a long piece is worth than its share of a sequence, how strongly weights follow the cover, which share of what is there a step takes,
#: and how near to the best of all a configuration must come in value to be taken.
PLANS = ((0.05, 0.0, 0.5, 0.002), (0.3, 0.3, 0.5, 0.005), (0.05, 0.05, 0.25, 0.001), (1.0, 0.0, 0.5, 0.01))
#: Pricings of a plan, and the largest tolerance.
ROUNDS, LOOSEST = 25, 0.02


def price(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: best[c], the most value of lengths that sum to c or less, and choice[c], a length to take there (0: nothing, -1: as in c - 1).
    value[k]: of length k, 0 where there is none."""
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        total = best[c - 1 :: -1][:c] + value[1 : c + 1]
        k = int(total.argmax())
        if total[k] > best[c - 1] and value[k + 1] > 0:
            best[c], choice[c] = total[k], k + 1
        else:
            best[c], choice[c] = best[c - 1], -1 if c > 1 else 0
    return best, choice


def configurations(counts: np.ndarray, capacity: int, slope: float, pull: float, share: float, tolerance: float) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray, float]:
    """Configurations with whole numbers, what they leave, and the least number of sequences that the first prices prove."""
    left, found, bound = counts.astype(np.int64).copy(), [], 0.0
    worth = np.arange(capacity + 1) / capacity
    worth = worth * (1 + slope * worth)
    for turn in range(ROUNDS):
        present = np.flatnonzero(left)
        if not len(present) or tolerance > LOOSEST:
            break
        waiting = left[present] / counts[present]
        value = np.zeros(capacity + 1)
        value[present] = worth[present] * np.exp(pull * (waiting - waiting.mean()))
        best, choice = price(value, capacity)
        if turn == 0:
            bound = float((value * counts).sum() / best[capacity])
        taken = 0
        for first in present[::-1].tolist():  # the best configuration that holds this length
            if not left[first]:
                continue
            held, gap, gain = {first: 1}, capacity - first, value[first]
            while gap > 0 and choice[gap]:
                k = int(choice[gap])
                if k < 0:
                    gap -= 1
                elif left[k] > held.get(k, 0):
                    held[k] = held.get(k, 0) + 1
                    gap, gain = gap - k, gain + value[k]
                else:
                    break
            if gain >= (1 - tolerance) * best[capacity]:
                n = max(1, int(share * min(int(left[k]) // m for k, m in held.items())))
                for k, m in held.items():
                    left[k] -= n * m
                found.append((tuple(k for k, m in sorted(held.items(), reverse=True) for _ in range(m)), n))
                taken += n
        if not taken:
            tolerance = 2 * tolerance + 1e-4
    return found, left, bound


def least(counts: np.ndarray, capacity: int) -> int:
    """What no packing can be better than, by dual prices that no sequence exceeds: 1 for a piece of over half a sequence, whose gap pieces from a least size on must fill."""
    size = np.arange(capacity + 1)
    half = capacity // 2
    best = -(-int((counts * size).sum()) // capacity)
    n, room = np.cumsum(counts[::-1])[::-1], np.cumsum((counts * size)[::-1])[::-1]  # pieces, and tokens in them, from a length on
    n_big, tokens_big = int(n[half + 1]) if half < capacity else 0, int(room[half + 1]) if half < capacity else 0
    for low in range(1, half + 1):
        n_huge, tokens_huge = (int(n[capacity - low + 1]), int(room[capacity - low + 1]))
        gaps = capacity * (n_big - n_huge) - (tokens_big - tokens_huge)
        best = max(best, n_big + max(0, -(-(int(room[low]) - tokens_big - gaps) // capacity)))
    return best


def solve(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """counts[k]: pieces of length k -> (lengths in one sequence, sequences of that kind), which together hold every piece, and the proven least number of sequences."""
    left = counts.astype(np.int64).copy()
    n_full = int(left[capacity])
    left[capacity] = 0
    full, bound = [((capacity,), n_full)] if n_full else [], least(left, capacity)
    if not left.any():
        return full, n_full
    best = best_fit(left.copy(), [], capacity)
    for plan in PLANS:
        if sum(n for _, n in best) <= bound:
            break
        found, rest, proven = configurations(left, capacity, *plan)
        bound = max(bound, int(np.ceil(proven - 1e-6 * (1 + proven))))
        found = best_fit(rest, found, capacity)
        if sum(n for _, n in found) < sum(n for _, n in best):
            best = found
    return full + best, n_full + bound


def best_fit(left: np.ndarray, opened: list[tuple[tuple[int, ...], int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Puts what is left, longest first, where the gap is smallest; sequences alike are handled together, by their number."""
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for config, n in opened:
        gaps[capacity - sum(config)].append((config, n))
    for length in range(capacity, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g, kinds in gaps.items() if g >= length and kinds), default=None)
            config, m = gaps[gap].pop() if gap is not None else ((), n)
            gap = capacity if gap is None else gap
            each = min(gap // length, n)  # so many fit into one
            fill = min(m, n // each)
            if fill < m and config:
                gaps[gap].append((config, m - fill))
            gaps[gap - each * length].append((config + (length,) * each, fill))
            n -= each * fill
    return [x for kinds in gaps.values() for x in kinds]


def slots(found: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length << 40 | first rank), and for each the sequence of that rank, the place in it, and the first rank."""
    next_rank, base, rows = defaultdict(int), 0, []
    for config, n in found:
        place = 0
        for length in config:
            rows.append((length << 40 | next_rank[length], base, place, next_rank[length]))
            next_rank[length] += n
            place += length
        base += n
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(4))


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """part, nth, doc_id, piece, start, length, ids_crc32: nth counts the pieces of a length within a part of the table."""
    small_batches(docs.sparkSession)
    ddl = "part int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long"
    out = to_arrow(docs.sparkSession, ddl)

    def run(batches):
        from pyspark import TaskContext

        part, tokens, seen = TaskContext.get().partitionId(), encoder(vocabulary), np.zeros(capacity + 1, np.int64)
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), tokens.encode(b.column(1).to_pylist()), strict=True):
                ids = np.append(ids, tokens.dtype.type(end)).astype("<u4")
                first = (len(ids) - 1) % capacity + 1
                for k, start in enumerate([0, *range(first, len(ids), capacity)]):
                    n = first if k == 0 else capacity
                    rows.append((part, int(seen[n]), doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return texts(docs).mapInArrow(lean(run, lambda: forget(vocabulary)), ddl)


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and for the whole packing n_sequences and least_sequences (no packing has fewer): one row for each piece.

    Null and empty texts are one piece, the end id alone. Rows with a null or repeated doc_id are packed like any other. An empty table gives
    no rows. Other columns of docs are not read. The driver sees the histogram (2048 counts) and the configurations: pieces of
    a length go to sequences of a kind together, so there are no more than pairs of a length and a gap, 2 million, whatever the corpus holds.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, vocabulary, end, capacity), "pieces")
    counted = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    first = counted.select("part", "length", "n", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    first = materialize(first, "ranks")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in first.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    found, fewest = solve(histogram, capacity)
    n_sequences = sum(n for _, n in found)
    tables = spark.sparkContext.broadcast(slots(found))
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    out = to_arrow(spark, ddl)

    def place(batches):
        keys, base, offset, begin = tables.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length << 40 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(base[at] + rank - begin[at]), pa.array(offset[at])], schema=out)

    ranked = cut.join(first, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(place, ddl).withColumns({"n_sequences": F.lit(n_sequences).cast("long"), "least_sequences": F.lit(fewest).cast("long")})


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
