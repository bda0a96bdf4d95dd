"""SimHash near-duplicates through anchors of a covering code.

Fingerprints: 64 bits over 3-word shingles (XXH64, seed 42). Two fingerprints link at 3 or fewer differing bits.

Anchors: the first 46 bits of a fingerprint are two 23-bit blocks. The binary Golay code covers each block: every 23-bit
word lies within 3 bits of exactly one codeword (covering radius 3, a perfect code). A pair of codewords is an anchor, and
the nearest pair is a fingerprint's home. If two fingerprints differ in d <= 3 bits, then the home of one lies, in the two
blocks together, within radius plus d of the other. So every fingerprint is replicated to all anchors within radius plus
threshold, counted by block, and is compared there with those at home: no link can be missed.

The 18 bits outside the blocks make cells of an anchor: a replica that is beyond the radius by 3 can only link if those bits are all equal, one beyond it by 2 only if either
half of them is. So there are four kinds of cell: an anchor; an anchor with the lower half; with the upper half; with all 18 bits. A fingerprint at home stands in one of each
kind, a replica in those that its distance asks for. A bitmap of the cells that are somebody's home spares replicas that nobody can meet; its size follows the number of
fingerprints up to MOST_BITS, and a full bitmap costs replicas, never links. A cell of many members is cut into blocks, and pairs of blocks go to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import discard, lean, materialize, parallelism, per_row, small_batches, table, texts
from granary.llm.graph import components

THRESHOLD = 3
SHINGLE = 3
SEED = 42
#: A cell with more members is cut into blocks of about so many.
HOT_CELL = 20_000
#: Bits of the bitmap for each cell, how many of them a cell sets, and bits of all of it at least and at most (powers of two; at most 64 MB are sent to each executor).
BITS_EACH, PROBES, LEAST_BITS, MOST_BITS = 16, 4, 1 << 20, 1 << 29

#: Fixed value: generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str, size: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash. No words: 0. Fewer words than a shingle has: one shingle of them all."""
    from xxhash import xxh64_intdigest

    words = text.encode().translate(_LOWER).split()  # splits at \x20 and \x09-\x0D only
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < size else map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    h = np.fromiter((xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    return int(majority(h))


def majority(h: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def make():
        def one(doc_id, text):
            fp = fingerprint(text, size)
            return doc_id, fp - (1 << 64) if fp >> 63 else fp

        return one

    return per_row(texts(docs), "doc_id long, fp long", make, "doc_id", "text")


@lru_cache(1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """home[word]: the nearest codeword's 12-bit message; error[word]: number of its error pattern; near[e], cost[e]: messages, relative to home, of all
    codewords within radius + 3 of a word with error pattern e, cheapest first, and how far beyond the radius each is (9: none)."""
    messages = np.arange(4096, dtype=np.uint32)
    codewords = np.zeros(4096, np.uint32)
    for i in range(12):
        codewords ^= np.where(messages >> np.uint32(i) & np.uint32(1), np.uint32(GOLAY << i), np.uint32(0))
    patterns = np.array(sorted(sum(1 << i for i in bits) for n in range(4) for bits in combinations(range(23), n)), np.uint32)
    home, error = np.zeros(1 << 23, np.uint16), np.zeros(1 << 23, np.uint16)
    for k, p in enumerate(patterns):
        home[codewords ^ p] = messages
        error[codewords ^ p] = k
    far = np.maximum(np.bitwise_count(codewords[None, :] ^ patterns[:, None]).astype(np.int8) - 3, 0, dtype=np.int8)
    width = int((far <= THRESHOLD).sum(axis=1).max())
    near = np.concatenate([np.argsort(part, axis=1, kind="stable")[:, :width].astype(np.uint32) for part in np.array_split(far, 32)])  # in parts: the order of all takes 64 MB
    cost = np.take_along_axis(far, near.astype(np.intp), axis=1)
    cost[cost > THRESHOLD] = 9
    return home, error, near, cost.astype(np.int8)


def homes(fp: np.ndarray) -> np.ndarray:
    home = golay()[0]
    low, high = (fp & 0x7FFFFF).astype(np.int64), (fp >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    return home[low].astype(np.int64) << 12 | home[high].astype(np.int64)


def anchors(fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of (row, anchor, cost): all anchors of each of the fingerprints, home included; cost: by how much it is beyond the radius."""
    home, error, near, cost = golay()
    a, b = (fp & np.uint64(0x7FFFFF)).astype(np.int64), (fp >> np.uint64(23) & np.uint64(0x7FFFFF)).astype(np.int64)
    ha, hb, na, nb, ca, cb = home[a].astype(np.int64), home[b].astype(np.int64), near[error[a]].astype(np.int64), near[error[b]].astype(np.int64), cost[error[a]], cost[error[b]]
    for i in range(na.shape[1]):
        row = np.flatnonzero(ca[:, i] <= THRESHOLD)
        if not len(row):
            break
        left = THRESHOLD - ca[row, i]
        width = int((cb[row] <= left[:, None]).sum(axis=1).max())
        r, j = np.nonzero(cb[row, :width] <= left[:, None])
        yield row[r], (ha[row[r]] ^ na[row[r], i]) << 12 | (hb[row[r]] ^ nb[row[r], j]), ca[row[r], i] + cb[row[r], j]


def cells(fp: np.ndarray, anchor: np.ndarray) -> list[np.ndarray]:
    """The cell of each kind, as a number: anchor, kind, and the bits outside the blocks that the kind looks at."""
    rest = (fp >> np.uint64(46)).astype(np.int64)
    return [anchor << 20 | kind << 18 | part for kind, part in enumerate((0 * rest, rest & 511, rest >> 9, rest))]


def bits_of(cell: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The PROBES bits of each cell."""
    h = cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    for _ in range(PROBES):
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        yield (h >> np.uint64(65 - bits.bit_length())).astype(np.int64)
        h ^= h >> np.uint64(29)


def has(words: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Places of the cells that may be somebody's home."""
    at = np.arange(len(cell))
    for bit in bits_of(cell, len(words) << 6):
        bit = bit[at] if len(at) < len(bit) else bit
        at = at[(words[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)]
    return at


def homes_bitmap(prints: DataFrame, bits: int) -> np.ndarray:
    """Which cells are somebody's home. The driver receives the words that are not zero, bits / 64 at most."""

    def run(batches):
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            bit = np.concatenate([x for c in cells(fp, homes(fp)) for x in bits_of(c, bits)])
            word, at = np.unique(bit >> 6, return_inverse=True)
            value = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(value, at, np.uint64(1) << (bit & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value).view(pa.int64())], ["w", "b"])

    found = prints.mapInArrow(lean(run, lambda: golay.cache_clear()), "w long, b long").groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    words = np.zeros(bits >> 6, np.uint64)
    words[found["w"].to_numpy()] = found["b"].to_numpy().view(np.uint64)
    return words


def links(prints: DataFrame) -> DataFrame:
    """fp long, each once -> (u, v), written: pairs of fingerprints that differ in THRESHOLD bits or fewer.

    The pairs returned join the same fingerprints as all links do: within a cell they are a spanning forest of its links, so that a dense group costs as many rows as it has
    members. A cell of more than HOT_CELL members is cut into blocks; a task compares two blocks, and each member goes to as many tasks as there are blocks to meet.
    """
    spark = prints.sparkSession
    small_batches(spark)
    prints = prints.select("fp")
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * BITS_EACH * max(1, prints.count()) - 1).bit_length()))
    bitmap = spark.sparkContext.broadcast(homes_bitmap(prints, bits))

    def replicate(batches):
        words = bitmap.value
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            own = homes(fp)
            found = [(c, np.arange(len(fp)), True) for c in cells(fp, own)]
            for row, anchor, cost in anchors(fp):
                of = cells(fp[row], anchor)
                for kind, wanted in enumerate((cost <= 1, cost == 2, cost == 2, cost >= 3)):
                    at = np.flatnonzero(wanted & (own[row] != anchor))
                    at = at[has(words, of[kind][at])]
                    found.append((of[kind][at], row[at], False))
            cell, row = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            home = np.concatenate([np.full(len(f[0]), f[2]) for f in found])
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(home), b.column(0).take(pa.array(row))], ["cell", "home", "fp"])

    replicas = materialize(prints.mapInArrow(lean(replicate, lambda: golay.cache_clear()), "cell long, home boolean, fp long"), "replicas")
    blocks = lambda home: F.ceil(F.count_if(F.col("home") == home) / HOT_CELL).cast("int")
    hot = replicas.groupBy("cell").agg(F.count("*").alias("n"), blocks(True).alias("own"), blocks(False).alias("others")).where(F.col("n") > HOT_CELL).drop("n")
    hot = materialize(hot, "hot")
    # tasks of a hot cell: i * (own + others) + j for block i at home and block j, those at home first and, among them, i <= j
    at = F.pmod(F.xxhash64("fp"), F.greatest(F.when(F.col("home"), F.col("own")).otherwise(F.col("others")), F.lit(1))).cast("int")
    width = F.col("own") + F.col("others")
    upto = lambda first, last, task: F.transform(F.filter(F.sequence(F.lit(0), width), lambda i: (i >= first) & (i < last)), task)
    of_home = F.concat(upto(F.lit(0), F.col("at"), lambda i: i * width + F.col("at")), upto(F.col("at"), width, lambda j: F.col("at") * width + j))
    of_other = upto(F.lit(0), F.col("own"), lambda i: i * width + F.col("own") + F.col("at"))
    task = F.when(F.col("own").isNull(), F.array(F.lit(0))).when(F.col("home"), of_home).otherwise(of_other)
    split = replicas.join(hot, "cell", "left").withColumn("at", at).select("cell", F.explode(task).alias("task"), "home", "fp")
    dealt = split.repartition(parallelism(replicas), "cell", "task").sortWithinPartitions("cell", "task")

    def compare(batches):
        """One cell and task at a time."""
        key, parts, found = None, [], []

        def close():
            if sum(map(len, parts)) > 1:
                rows = np.concatenate(parts)
                if (rows[:, 0] > 0).any():
                    found.extend(forest(rows[:, 1].view(np.uint64), rows[:, 0] > 0, key[0] >> 18 & 3 == 0))
            parts.clear()

        for b in batches:
            cell, of, home, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            rows = np.stack([home.astype(np.int64), fp], axis=1)
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(cell) != 0) | (np.diff(of) != 0)) + 1, [len(cell)]])
            for i in np.flatnonzero((np.diff(cuts) > 1) | (cuts[:-1] == 0) | (cuts[1:] == len(cell))).tolist():  # others are alone
                s, e = int(cuts[i]), int(cuts[i + 1])
                if s == e:
                    continue
                if key != (here := (int(cell[s]), int(of[s]))):
                    close()
                    key = here
                parts.append(rows[s:e])
            if len(found) > 10_000:
                yield _pairs(found)
                found.clear()
        close()
        if found:
            yield _pairs(found)

    out = materialize(dealt.mapInArrow(lean(compare), "u long, v long"), "links")
    discard(replicas, hot)
    return out


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(c, np.uint64)).view(pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])


def forest(prints: np.ndarray, home: np.ndarray, among: bool) -> list[tuple[int, int]]:
    """prints: the members of a cell -> pairs of them that link.

    First, if `among`, a spanning forest of the links between members at home. Then others that share a home elsewhere are taken as joined where they link, since that home
    returns their forest; and of links from home to others only those are returned that join what is not joined yet. So a dense group gives a cell about as many pairs as it has
    homes."""
    at_home, others, joined_ = np.flatnonzero(home), np.flatnonzero(~home), np.arange(len(prints))

    def linked(x: np.ndarray, y: np.ndarray):
        step = max(1, (1 << 20) // max(1, len(y)))
        for i in range(0, len(x), step):
            a, b = np.nonzero(np.bitwise_count(prints[x[i : i + step]][:, None] ^ prints[y][None, :]) <= THRESHOLD)
            u, v = x[i + a], y[b]
            near = u != v
            if near.any():
                yield u[near], v[near]

    def join(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
        """Joins what the links join; those that were needed. Each round hooks every root to a smaller one that it links to."""
        nonlocal joined_
        used = []
        while True:
            p, q = joined_[u], joined_[v]
            open_ = p != q
            if not open_.any():
                return used
            u, v, p, q = u[open_], v[open_], p[open_], q[open_]
            high, first = np.unique(np.maximum(p, q), return_index=True)
            joined_[high] = np.minimum(p, q)[first]
            used += zip(prints[u[first]].tolist(), prints[v[first]].tolist(), strict=True)
            while (joined_[joined_] != joined_).any():
                joined_ = joined_[joined_]

    out = []
    if among and len(at_home) > 1:
        for u, v in linked(at_home, at_home):
            out += join(u, v)
    if len(others) > 1:
        own = homes(prints[others])
        order = np.argsort(own, kind="stable")
        cuts = np.flatnonzero(np.diff(own[order])) + 1
        for same in np.split(others[order], cuts):
            if len(same) > 1:
                for u, v in linked(same, same):
                    join(u, v)
    if len(others):
        for u, v in linked(at_home, others):
            out += join(u, v)
    return out


def simhash_groups(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of docs.

    component_id: the smallest doc_id that links reach, its own included. Null and empty texts have fingerprint 0 and are
    linked like any other. Rows with a null doc_id are kept and never name a component (their component_id is null where
    nothing else is linked). Repeated rows each come back. An empty table gives no rows. Other columns of docs are not read.
    """
    prints = materialize(fingerprints(docs, size), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(links(classes))
    linked = roots.join(classes, roots["node"] == classes["fp"]).select("node", "root", "first_id")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(linked.join(least, "root").select(F.col("node").alias("fp"), "component_id"), "named")
    of_class = materialize(classes.join(named, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "components")
    discard(classes, named)
    return prints.join(of_class, "fp").select("doc_id", "fp", "component_id")  # a hot fingerprint's rows are split by adaptive execution


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
