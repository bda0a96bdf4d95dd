"""Substring dedup by content-defined chunking.

A gear hash rolls over a text's bytes. Words begin where white space ends (a word of over LONG_WORD bytes, as in scripts without spaces, has further places that the hash picks). A
chunk begins at a word whose hash is less than those of the AROUND words on both sides: cuts depend on a few words around them alone, whatever stands before, and chunks are AROUND + 1
words at least. Chunks are compared by digest across documents: each one that occurs in several is traced to its first and its last occurrence. Chunks of a document that
follow one another at the same distance from the same other document form a passage; it counts from LEAST_WORDS words in whole chunks, which a shared passage of 51 words
holds. Its first occurrence (smallest doc_id) stays, the others may go.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import free_name, materialize, small_batches, table, texts, to_arrow

#: Words on each side whose hashes are greater where a chunk begins; words of a chunk at most; bytes of a word at most; words in the whole chunks of a passage at least.
AROUND, LONGEST, LONG_WORD, LEAST_WORDS = 3, 24, 32, 20
#: Bytes that are hashed at a time; a piece overlaps the one before by the 16 bytes that the hash sees.
AT_ONCE = 1 << 20

_G = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_G = (_G ^ _G >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
GEAR = (_G >> np.uint64(32)).astype(np.uint32)


def gear(raw: np.ndarray) -> np.ndarray:
    """The gear hash, two bits a byte, of the 16 bytes that end at each byte."""
    out = np.empty(len(raw), np.uint32)
    for i in range(0, len(raw), AT_ONCE):
        begin = max(0, i - 15)
        h = GEAR[raw[begin : i + AT_ONCE]]
        for step in (1, 2, 4, 8):  # doubling: the hash of 2k bytes from two of k
            shifted = h[:-step] << np.uint32(2 * step)
            h = h.copy()
            h[step:] += shifted
        out[i : i + AT_ONCE] = h[i - begin :]
    return out


def places(raw: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Where words begin."""
    space = (raw == 32) | (raw >= 9) & (raw <= 13)
    first = ~space
    first[1:] &= space[:-1]
    at = np.arange(len(raw), dtype=np.int64)
    since = at - np.maximum.accumulate(np.where(space, at, -1))
    if len(since) and since.max() > LONG_WORD:
        first |= (since > LONG_WORD) & (h >> np.uint32(29) == 0) & (raw & 0xC0 != 0x80) & ~space
    return np.flatnonzero(first)


def chunk_starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the chunks of a text begin (bytes; the first at 0), and how many words begin in each."""
    h = gear(raw)
    word = places(raw, h)
    v, n = h[word], len(word)
    least = np.ones(n, bool)
    for s in range(1, min(AROUND, n - 1) + 1):
        least[s:] &= v[s:] < v[:-s]
        least[:-s] &= v[:-s] <= v[s:]
    cut = np.union1d([0], np.flatnonzero(least)).astype(np.int64)
    gap = np.diff(np.append(cut, n))
    if len(gap) and gap.max() > LONGEST:  # text without such a place for long, as where a word is said over and over
        cut = np.concatenate([np.arange(c, c + g, LONGEST) if g else [c] for c, g in zip(cut.tolist(), gap.tolist(), strict=True)])
    starts = word[cut] if n else np.zeros(1, np.int64)
    starts[0] = 0
    return starts, np.diff(np.append(cut, n))


CHUNK = "doc_id long, row long, begin int, end int, words int, digest long"


def chunks(docs: DataFrame) -> DataFrame:
    """CHUNK of every text: begin and end in code points; row: hash of the text, which tells rows that share a doc_id apart. Null and empty texts have no chunks."""
    small_batches(docs.sparkSession)
    out = to_arrow(docs.sparkSession, CHUNK)

    def run(batches):
        from xxhash import xxh3_64_intdigest

        for b in batches:
            columns = [[] for _ in out]
            for doc_id, text, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not text:
                    continue
                whole = text.encode()
                raw = np.frombuffer(whole, np.uint8)
                cut, words = chunk_starts(raw)
                ends = np.append(cut[1:], len(raw))
                at = ends if len(whole) == len(text) else np.cumsum(raw & 0xC0 != 0x80)[ends - 1]
                digests = np.fromiter((xxh3_64_intdigest(whole[s:e]) for s, e in zip(cut.tolist(), ends.tolist(), strict=True)), np.uint64, len(cut)).view(np.int64)
                made = (pa.array([doc_id] * len(cut), pa.int64()), np.full(len(cut), row), np.concatenate([[0], at[:-1]]), at, words, digests)
                for column, x, field in zip(columns, made, out, strict=True):
                    column.append(pa.array(x, field.type))
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], schema=out)

    return texts(docs, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row")).mapInArrow(run, CHUNK)


def runs(parts: list[tuple[int, int, int, list[tuple]]]) -> list[tuple[int, int, tuple]]:
    """parts: a document's repeated chunks in order, (begin, end, words, places elsewhere); a place is (document, begin there). -> (begin, end, (document, distance)) of passages.

    Chunks without a gap between them are a stretch. In a stretch, what lies between the first and the last chunk at one distance from one document is a passage, if it
    has LEAST_WORDS words and at least half of them are at that distance: a chunk within it may be traced to a third document that holds it too."""
    found, i = [], 0
    while i < len(parts):
        j, of = i, defaultdict(list)
        while True:
            begin, _, _, elsewhere = parts[j]
            for other, there in elsewhere:
                of[other, begin - there].append(j)
            j += 1
            if j == len(parts) or parts[j][0] != parts[j - 1][1]:
                break
        total = np.concatenate([[0], np.cumsum([p[2] for p in parts[i:j]])])
        for key, at in of.items():
            words, own = total[at[-1] + 1 - i] - total[at[0] - i], sum(parts[k][2] for k in at)
            if words >= LEAST_WORDS and 2 * own >= words:
                found.append((parts[at[0]][0], parts[at[-1]][1], key))
        i = j
    return found


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans that touch or overlap, put together."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def listed(spans: list[tuple[int, int]]) -> str:
    return ",".join(f"{s}:{e}" for s, e in spans)


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, row, n_passages, repeated_chars, removed_chars, passages, removed: one row for each document that shares a passage with another.

    passages and removed list start:end (code points, end exclusive), comma-joined: all passages, and the parts of them that stand in an earlier document too (smaller doc_id, null
    ids last; of rows that share a doc_id, smaller row). row is the text's hash: rows that share a doc_id but not the text are different documents; rows that share both (or both have
    no doc_id), are one and come back once. A passage that a document repeats within itself is none. Documents without passages, with null or empty texts, and empty tables
    give no rows. Other columns are not read.

    Digests have 64 bits; a passage is several equal ones in a row at one distance, so that a chance collision does not make one.
    """
    spark = docs.sparkSession
    all_chunks = chunks(docs)
    occurrence = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "row", "begin")
    document = lambda c: F.struct(f"{c}.nil", f"{c}.doc_id", f"{c}.row")
    # written, so that the join behind it is between two shuffles and adaptive execution can split a digest that is everywhere
    repeated = all_chunks.groupBy("digest").agg(F.min(occurrence).alias("first"), F.max(occurrence).alias("last"))
    repeated = materialize(repeated.where(document("first") != document("last")), "repeated")
    marked = all_chunks.join(repeated, "digest").select("doc_id", "row", F.struct("begin", "end", "words", "first", "last").alias("c"))
    own = marked.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("c")).alias("cs"))
    small_batches(spark)
    ddl = "doc_id long, row long, begin int, end int, later boolean"
    out = to_arrow(spark, ddl)

    def trace(batches):
        for b in batches:
            rows = []
            for doc_id, row, cs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                me, parts = (doc_id is None, doc_id or 0, row), []
                for c in cs:
                    there = {((o["nil"], o["doc_id"] or 0, o["row"]), o["begin"]) for o in (c["first"], c["last"])}
                    parts.append((c["begin"], c["end"], c["words"], [x for x in there if x[0] != me]))
                for s, e, (other, distance) in runs(parts):
                    rows.append((doc_id, row, s, e, other < me))
                    rows.append((None if other[0] else other[1], other[2], s - distance, e - distance, me < other))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    found = own.mapInArrow(trace, ddl).groupBy("doc_id", "row").agg(F.collect_set(F.struct("begin", "end", "later")).alias("spans"))
    ddl = "doc_id long, row long, n_passages int, repeated_chars long, removed_chars long, passages string, removed string"
    result = to_arrow(spark, ddl)

    def finish(batches):
        for b in batches:
            rows = []
            for doc_id, row, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                every, gone = (joined([(x["begin"], x["end"]) for x in spans if x["later"] or not later]) for later in (False, True))
                rows.append((doc_id, row, len(every), *(sum(e - s for s, e in x) for x in (every, gone)), listed(every), listed(gone)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), result, strict=True)], schema=result)

    return found.mapInArrow(finish, ddl)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the removable passages taken out of text; n_chars, where there is such a column, follows. Rows without any stay as they are, all columns too; rows that share a doc_id
    are told apart by their texts, and rows that share both are cut alike. An empty table stays empty."""
    key, spans = free_name(docs, "text_hash"), free_name(docs, "removed")
    gone = passages(docs).where("removed <> ''").select(F.col("doc_id").alias("_d"), F.col("row").alias("_r"), F.col("removed").alias("_s"))
    text = F.col("text").cast("string")
    left, right = docs.withColumn(key, F.xxhash64(F.coalesce(text, F.lit("")))).alias("l"), gone.alias("r")
    both = left.join(right, F.col(f"l.{key}").eqNullSafe(F.col("r._r")) & F.col("l.doc_id").cast("long").eqNullSafe(F.col("r._d")), "left").select("l.*", F.col("r._s").alias(spans))

    @F.pandas_udf("string")
    def cut(text, removed):
        def one(t, where):
            at, kept = 0, []
            for s, e in (map(int, x.split(":")) for x in where.split(",")):
                kept.append(t[at:s])
                at = e
            return "".join(kept) + t[at:]

        return text.combine(removed, lambda t, w: t if t is None or w is None else one(t, w))

    both = both.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(cut("text", spans)))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        both = both.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return both.select(docs.columns)


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(table(spark, sf_dir, "documents")).drop("row")
