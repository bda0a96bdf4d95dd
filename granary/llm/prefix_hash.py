"""Document fingerprints from prefix polynomial hashes.

A text's prefix arrays hold, for two primes, the sums of its code points times powers of a base. They give the hash of any span by one subtraction,
so spans compare in constant time and the longest common extension of two places is found by binary search. A fingerprint is the text's length, the
hash of the whole, and a sketch of the hashes of all its spans of SPAN code points: the least hash of each of BINS classes, a byte of each.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import materialize, parallelism, small_batches, table, texts, to_arrow

SPAN = 16
BINS = 128
PRIMES = (2147483647, 2147483629)
BASES = (1000003, 998244353)
#: Spans that are hashed at a time, so that a very long text needs no more than its prefix arrays.
AT_ONCE = 1 << 18


class _Powers:
    """Powers of the bases and of their inverses, as far as a text has needed them."""

    def __init__(self) -> None:
        self.up = [np.ones(1, np.uint64) for _ in PRIMES]
        self.down = [np.ones(1, np.uint64) for _ in PRIMES]

    def upto(self, n: int) -> None:
        while len(self.up[0]) <= n:
            for k, (p, b) in enumerate(zip(PRIMES, BASES, strict=True)):
                m = len(self.up[k])
                for rows, base in ((self.up, b), (self.down, pow(b, -1, p))):
                    rows[k] = np.concatenate([rows[k], rows[k] * np.uint64(pow(base, m, p)) % np.uint64(p)])


_POWERS = _Powers()


class PrefixHash:
    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(points)
        _POWERS.upto(self.n)
        self.sums = []
        for k, p in enumerate(PRIMES):
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(points * _POWERS.up[k][: self.n] % np.uint64(p), out=s[1:])  # below 2**31 each: no overflow for texts of under 2**33
            self.sums.append(s % np.uint64(p))

    def span(self, start: int, length: int) -> tuple[int, ...]:
        """Hash of a span; equal spans have equal hashes wherever they stand."""
        return tuple(int((int(s[start + length]) - int(s[start])) % p * int(_POWERS.down[k][start]) % p) for k, (s, p) in enumerate(zip(self.sums, PRIMES, strict=True)))

    def extension(self, start: int, other: PrefixHash, at: int) -> int:
        """Length of the longest common extension of self from start and other from at."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, middle) == other.span(at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def spans(self, length: int, start: int, end: int) -> np.ndarray:
        """62-bit hashes, mixed to 64 bits, of the spans of one length that begin in [start, end)."""
        h = np.zeros(end - start, np.uint64)
        for k, (s, p) in enumerate(zip(self.sums, PRIMES, strict=True)):
            p = np.uint64(p)
            h = h << np.uint64(31) | (s[start + length : end + length] + p - s[start:end]) % p * _POWERS.down[k][start:end] % p
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ h >> np.uint64(32)

    def fingerprint(self) -> str:
        least = np.full(BINS, np.iinfo(np.uint64).max)
        length = min(SPAN, self.n)
        n = self.n - length + 1 if self.n else 0
        for i in range(0, n, AT_ONCE):
            h = self.spans(length, i, min(n, i + AT_ONCE))
            np.minimum.at(least, (h >> np.uint64(57)).astype(np.intp), h & np.uint64((1 << 57) - 1))
        sketch = np.where(least == np.iinfo(np.uint64).max, 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8)
        return f"{self.n:x}.{''.join(f'{x:08x}' for x in self.span(0, self.n))}.{base64.b64encode(sketch.tobytes()).decode()}"


def likeness(a: str, b: str) -> float:
    """0 to 1, from fingerprints alone: 1 for equal ones, else the share of spans in common (Dice's coefficient, as the sketches tell it)."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(base64.b64decode(s.rpartition(".")[2]), np.uint8) for s in (a, b))
    either, same = ((x > 0) | (y > 0)).sum(), ((x > 0) & (x == y)).sum()
    if not either:
        return 0.0
    jaccard = max(0.0, (same / either - 1 / 255) / (1 - 1 / 255))  # bytes of different hashes agree once in 255
    return float(2 * jaccard / (1 + jaccard))


def edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(doc_id: int | None, text: str, own: PrefixHash, fp: str, next_text: str, next_fp: str) -> tuple:
    edited = edit(text, next_text)
    other = PrefixHash(edited)
    edited_fp = other.fingerprint()
    return doc_id, own.n, hashlib.sha256(edited.encode()).hexdigest(), fp, edited_fp, likeness(fp, edited_fp), likeness(fp, next_fp), own.extension(0, other, 0)


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every text's fingerprint, and those of its edited text and of its next document's, compared. Columns: RESULT.

    The next document is the one with the next smaller doc_id, that of the last is the first; of rows that share a doc_id the text decides the
    order, null doc_ids come last. Null texts are empty. A table of one row is followed by itself; an empty one gives no rows. common_prefix:
    code points that a text and its edited text share from the start. Other columns of docs are not read.

    The rows are dealt by ranges of doc_id, each in order. A range compares all its rows but the last, whose next document stands at the head of
    another range: heads and last rows, two of each range, are joined afterwards.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = texts(docs)
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    ordered = rows.repartitionByRange(parallelism(rows), order[0]).sortWithinPartitions(*order)
    ddl = f"part int, role string, text string, {RESULT}"
    out = to_arrow(spark, ddl)

    def run(batches):
        from pyspark import TaskContext

        part, last = TaskContext.get().partitionId(), None
        for b in batches:
            made = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = PrefixHash(text)
                fp = own.fingerprint()
                if last is None:
                    made.append((part, "head", text, doc_id, own.n, None, fp, None, None, None, None))
                else:
                    made.append((part, "row", None, *_compared(*last, text, fp)))
                last = doc_id, text, own, fp
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made, strict=True), out, strict=True)], schema=out)
        if last:
            doc_id, text, own, fp = last
            yield pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip((part, "last", text, doc_id, own.n, None, fp, None, None, None, None), out, strict=True)], schema=out)

    done = materialize(ordered.mapInArrow(run, ddl), "fingerprints")
    parts = sorted(r[0] for r in done.where("role = 'head'").select("part").collect())  # one number for each range
    following = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1], strict=True)), "part int, next int")
    heads = done.where("role = 'head'").select(F.col("part").alias("next"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    ends = done.where("role = 'last'").select("part", "doc_id", "text", "fingerprint").join(following, "part").join(heads, "next")
    result = to_arrow(spark, RESULT)

    def finish(batches):
        for b in batches:
            made = [_compared(doc_id, text, PrefixHash(text), fp, next_text, next_fp) for doc_id, text, fp, next_text, next_fp in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*made, strict=True), result, strict=True)], schema=result)

    ended = ends.select("doc_id", "text", "fingerprint", "next_text", "next_fp").mapInArrow(finish, RESULT)
    return done.where("role = 'row'").select(ended.columns).unionByName(ended)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
