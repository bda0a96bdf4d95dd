"""Near-duplicate texts, exactly: Jaccard similarity of the sets of five-word shingles of 0.8 or more.

Candidates come from SimHash anchors first (simhash.py, over five-word shingles): fingerprints within 3 bits find most copies at little cost. Fingerprints alone miss copies
whose difference is one stretch, so prefix filtering looks for the rest: two sets of similarity 0.8 or more share one of their first n - ceil(0.8 n) + 1 shingles in any order
that is the same for all. A candidate pair passes two tests. Sketches first: bit b of a set's sketch is the parity of the number of its shingles that fall to b, so the
bits in which two sketches differ are no more than the shingles in which the sets do, and a pair that differs in more cannot be similar. Then the sets themselves are compared.
Where all pairs of a posting are met, sketches of one width for all texts are part of the join's condition already, so that unlike pairs are never rows.
Only links that hold join groups; no link that holds is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import simhash
from granary.llm.common import discard, free_name, lean, materialize, may_be_among, parallelism, per_row, row_key, small_batches, texts, to_arrow
from granary.llm.graph import components

#: Words in a shingle, and least similarity as a fraction.
SHINGLE, SIMILAR = 5, (4, 5)
#: One text of so many tells which shingles are frequent; so many of those are known at most. A frequent shingle's postings are dealt to a task for each so many.
SAMPLED, FREQUENT, DEALT = 16, 500_000, 20_000
#: Words of the sketch that all texts have at one width.
WIDE = 8
#: Rounds of one link for each posting before all pairs are tested: at most so many, and no more once a round has found fewer links than one for so many open postings.
ROUNDS, FEW = 8, 50

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str) -> list[bytes]:
    return text.encode().translate(_LOWER).split()  # splits at \x20 and \x09-\x0D only


def digest(text: str) -> bytes:
    """128 bits of the words in order, A-Z lower-cased."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words(text)))


def shingles(text: str) -> np.ndarray:
    """Hashes of the shingles in order; fewer words: one of them all; none: none."""
    from xxhash import xxh64_intdigest

    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    found = [b" ".join(w)] if len(w) < SHINGLE else map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)), strict=False))
    return np.fromiter((xxh64_intdigest(s, simhash.SEED) for s in found), np.uint64)


def shingle_set(text: str) -> np.ndarray:
    return np.unique(shingles(text))


def sketch(held: np.ndarray, n: int = 0) -> np.ndarray:
    """Parities of a set's shingles by their low bits: n 64-bit words, or a power of two of them with at least a bit for each shingle."""
    n = n or max(1, 1 << (-(-len(held) // 64) - 1).bit_length())
    bit = held & np.uint64(64 * n - 1)
    out = np.zeros(n, np.uint64)
    np.bitwise_xor.at(out, (bit >> np.uint64(6)).astype(np.intp), np.uint64(1) << (bit & np.uint64(63)))
    return out


def differing(a: str, b: str) -> Column:
    """Bits in which two sketches differ, the longer one folded to the shorter one's size."""
    least = F.least(F.size(a), F.size(b))

    def folded(c: str) -> Column:
        half = F.zip_with(F.slice(c, 1, least), F.slice(c, least + 1, F.greatest(least, F.lit(1))), lambda x, y: x.bitwiseXOR(y))
        many = F.transform(F.sequence(F.lit(1), least), lambda i: F.aggregate(F.filter(F.col(c), lambda _, j: j % least == i - 1), F.lit(0).cast("long"), lambda s, x: s.bitwiseXOR(x)))
        return F.when(F.size(c) == least, F.col(c)).when(F.size(c) == 2 * least, half).otherwise(many)

    return F.aggregate(F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def frequent(single: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that come again in a sample of the texts, and how many of those texts hold each. They order shingles and say how to deal them; any order
    gives the same groups."""
    sample = single.where(F.pmod(F.xxhash64("row_key"), F.lit(SAMPLED)) == 0)
    held = per_row(sample, "held array<long>", lambda: lambda text: (shingle_set(text).view(np.int64).tolist(),), "text")
    counted = held.select(F.explode("held").alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    got = counted.orderBy(F.desc("n"), "key").limit(FREQUENT).orderBy("key").toArrow()
    return got["key"].to_numpy(), got["n"].to_numpy()


def postings(single: DataFrame) -> DataFrame:
    """key, digest, n, at, salt: the first shingles of every text, rare ones first. n: shingles of the text; at: the place of this one, from 1. salt: -1 for a shingle that is not
    known to be frequent, else which of the tasks that share it."""
    spark = single.sparkSession
    usual = spark.sparkContext.broadcast(frequent(single))
    small_batches(spark)
    ddl = "key long, digest binary, n int, at int, salt int"
    out = to_arrow(spark, ddl)

    def run(batches):
        hashes, counts = usual.value
        for b in batches:
            found = []
            for text in b.column(0).to_pylist():
                h = shingle_set(text).view(np.int64)
                if len(h):
                    n = np.zeros(len(h), np.int64)
                    if len(hashes):
                        i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                        n = np.where(hashes[i] == h, counts[i], 0)
                    first = np.lexsort((h, n))[: len(h) - -(-SIMILAR[0] * len(h) // SIMILAR[1]) + 1]
                    name = digest(text)
                    tasks = n[first] * SAMPLED // DEALT + 1
                    salt = np.where(n[first] > 0, int.from_bytes(name[:4], "big") % tasks, -1)
                    found.append((h[first], [name] * len(first), np.full(len(first), len(h)), np.arange(1, len(first) + 1), salt))
            if found:
                columns = [sum(c, []) if isinstance(c[0], list) else np.concatenate(c) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, out, strict=True)], schema=out)

    return single.select("text").mapInArrow(lean(run), ddl)


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by key and digest, those whose key another text has too, each once. What is known to be frequent passes."""
    last, was = None, False  # the row that waits for the next one; whether it shares its key with the row before
    for b in batches:
        b = pa.Table.from_batches([b] if last is None else [last, b]).combine_chunks().to_batches()[0] if len(b) else b
        if not len(b):
            continue
        key, same_text = b.column(0).to_numpy(), np.zeros(len(b) - 1, bool)
        same = key[1:] == key[:-1]
        at = np.flatnonzero(same)
        own = b.column(1)
        same_text[at] = [own[i].as_py() == own[i + 1].as_py() for i in at.tolist()]
        new = np.concatenate([[True], ~same_text])
        b, key = b.filter(pa.array(new)), key[new]
        same = key[1:] == key[:-1]
        before = np.concatenate([[was], same])
        known = b.column(4).to_numpy() >= 0
        yield b.slice(0, len(b) - 1).filter(pa.array(before[:-1] | same | known[:-1]))
        last, was = b.slice(len(b) - 1), bool(before[-1])
    if last is not None and (was or last.column(4)[0].as_py() >= 0):
        yield last


class _Tester:
    """Tells which candidate pairs of ids are similar. The sets of texts that a sketch let through are written once and kept for later rounds."""

    def __init__(self, rows: DataFrame, classes: DataFrame):
        self.rows, self.classes = rows, classes
        self.held: list[DataFrame] = []

    def similar(self, pairs: DataFrame) -> DataFrame:
        """(u, v) of candidates (u, v), u < v -> those that are similar, written."""
        of = self.classes.select("id", "n", "sketch")
        both = pairs.distinct().join(of.toDF("u", "nu", "su"), "u").join(of.toDF("v", "nv", "sv"), "v")
        a, b = SIMILAR
        sizes = b * F.least("nu", "nv") >= a * F.greatest("nu", "nv")
        both = both.where(sizes).where((a + b) * differing("su", "sv") <= (b - a) * (F.col("nu") + F.col("nv")))
        both = materialize(both.select("u", "v", "nu", "nv"), "alike")
        wanted = both.select(F.col("u").alias("id")).union(both.select("v")).distinct()
        for there in self.held:
            wanted = wanted.join(there.select("id"), "id", "left_anti")
        wanted = materialize(wanted.join(self.classes.select("id", "first"), "id"), "wanted")
        rows = self.rows.where(may_be_among(wanted, "first")("row_key")).join(wanted.withColumnRenamed("first", "row_key"), "row_key")
        found = per_row(rows, "id long, held array<long>", lambda: lambda i, text: (i, shingle_set(text).view(np.int64).tolist()), "id", "text")
        self.held.append(materialize(found.dropDuplicates(["id"]), "sets"))
        sets = self.held[0]
        for more in self.held[1:]:
            sets = sets.union(more)
        tested = both.join(sets.toDF("u", "hu"), "u").join(sets.toDF("v", "hv"), "v")
        out = materialize(tested.where((a + b) * F.size(F.array_intersect("hu", "hv")) >= a * (F.col("nu") + F.col("nv"))).select("u", "v"), "links")
        discard(both, wanted)
        return out


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, group), one row for each row of docs, written: near-duplicates share a group.

    Exact: groups are the components of all pairs of similarity 0.8 or more. Texts that are equal but for A-Z case and white space are one from the start; so are null, empty and
    blank ones. Rows with null or repeated doc_ids each come back; an empty table gives none. Columns other than doc_id and text are not read.

    After the fingerprints' links, each round links the texts of a posting to one of them, so that a dense group costs as many rows as it has postings, and keeps what still meets in
    different groups. Once few enough pairs are left, or links have become few, all pairs whose sizes and places let them be similar are tested.
    """
    rows = texts(docs, row_key().alias("row_key"))
    ddl = "doc_id long, row_key binary, digest binary, n int, fp long, sketch array<long>, wide array<long>"

    def make():
        def one(doc_id, key, text):
            h = shingles(text)
            held = np.unique(h)
            fp = int(simhash.majority(h)) if len(h) else 0
            return doc_id, key, digest(text), len(held), fp - (1 << 64) if fp >> 63 else fp, sketch(held).view(np.int64).tolist(), sketch(held, WIDE).view(np.int64).tolist()

        return one

    keys = materialize(per_row(rows, ddl, make, "doc_id", "row_key", "text"), "keys")
    first = F.min(F.struct("row_key", "n", "fp", "sketch", "wide"))
    classes = keys.groupBy("digest").agg(first.alias("f")).select(F.monotonically_increasing_id().alias("id"), "digest", F.col("f.row_key").alias("first"), "f.n", "f.fp", "f.sketch", "f.wide")
    classes = materialize(classes, "classes")

    def similar_prints() -> DataFrame:
        """(u, v) that a fingerprint links: texts of one fingerprint with its first, and those first ones with each other."""
        prints = classes.where("n > 0").groupBy("fp").agg(F.min("id").alias("id"))
        prints = materialize(prints, "prints")
        same = classes.where("n > 0").join(prints.toDF("fp", "u"), "fp").where("id <> u").select("u", F.col("id").alias("v"))
        linked = simhash.links(prints).toDF("a", "b").join(prints.toDF("a", "u"), "a").join(prints.toDF("b", "v"), "b").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        return same.union(linked)

    tester = _Tester(rows, classes)
    edges = tester.similar(similar_prints())

    # one row of each text: copies of other texts stay out, rows that occur again and again are put together
    times = keys.groupBy("row_key", "digest").agg(F.count("*").alias("m")).join(classes.select("digest", "first"), "digest")
    odd = materialize(times.where("row_key <> first or m > 1").select("row_key", (F.col("row_key") == F.col("first")).alias("again")), "copies")
    single = one_row_each(rows, odd, "row_key")
    dealt = postings(single)
    dealt = dealt.repartition(parallelism(dealt), "key", "salt").sortWithinPartitions("key", "digest")
    met = dealt.mapInArrow(lean(shared), "key long, digest binary, n int, at int, salt int").drop("salt")
    met = materialize(met.join(classes.select("digest", "id"), "digest").select("key", "id", "n", "at"), "met")
    n_met = met.count()

    a, b = SIMILAR
    may = (b * F.least("a.n", "b.n") >= a * F.greatest("a.n", "b.n")) & ((a + b) * (1 + F.least(F.expr("a.n - a.at"), F.expr("b.n - b.at"))) >= a * F.expr("a.n + b.n"))

    def meet(x: DataFrame, y: DataFrame, also: Column | None = None) -> DataFrame:
        test = F.expr("a.group <> b.group") & may
        both = x.alias("a").join(y.alias("b"), "key").where(test if also is None else test & also)
        return both.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v"))

    def grouped(rows_: DataFrame, roots: DataFrame) -> DataFrame:
        return rows_.join(roots.toDF("id", "root"), "id", "left").select("key", "id", "n", "at", F.coalesce("root", "id").alias("group"))

    roots = components(edges)
    now, few = grouped(met, roots), False
    for turn in range(ROUNDS + 1):
        sizes = now.groupBy("key", "group").agg(F.count("*").alias("m"), F.min_by(F.struct("id", "n", "at", "group"), F.xxhash64("id", F.lit(turn))).alias("h"))
        pairs = (F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2
        hub, most = F.min_by("h", F.xxhash64("h.id", F.lit(turn))), F.max_by("group", F.struct("m", "group"))
        open_ = materialize(sizes.groupBy("key").agg(pairs.alias("pairs"), hub.alias("h"), most.alias("most")).where("pairs > 0"), "open")
        now, before = materialize(now.join(open_.select("key"), "key", "left_semi"), "now"), now
        discard(before)
        left, n_open = open_.agg(F.coalesce(F.sum("pairs"), F.lit(0)), F.count("*")).first()
        last = few or turn == ROUNDS or left <= n_met
        if not left:
            break
        if last:  # of two groups one is not the largest; what sketches of one width tell apart is never a row
            words_ = [F.get("wide", F.lit(i)).alias(f"w{i}") for i in range(WIDE)]
            wide = materialize(now.join(classes.select("id", *words_), "id"), "wide")
            apart = sum((F.bit_count(F.col(f"a.w{i}").bitwiseXOR(F.col(f"b.w{i}"))) for i in range(WIDE)), F.lit(0))
            held = (a + b) * apart <= (b - a) * F.expr("a.n + b.n")
            found = tester.similar(meet(wide.join(open_.select("key", "most"), "key").where("group <> most").select(wide.columns), wide, held))
            discard(wide)
        else:
            found = tester.similar(meet(now, open_.select("key", "h.*")))
        known = roots.select(F.col("root").alias("u"), F.col("node").alias("v")).where("u <> v")
        roots, before = materialize(components(known.union(found)), "roots"), roots
        discard(before, open_)
        if last:
            break
        now, few = grouped(now, roots), FEW * found.count() < n_open
    group = classes.join(roots.toDF("id", "root"), "id", "left").select("digest", F.coalesce("root", "id").alias("group"))
    out = materialize(keys.select("doc_id", "row_key", "digest").join(group, "digest").select("doc_id", "row_key", "group"), "groups")
    discard(keys, classes, edges, odd, met, now, roots, *tester.held)
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near_duplicate_groups: the smallest doc_id's (null ids last), of rows that share it one. All columns stay as they are; of rows with equal
    doc_id and text any one stays. Null, empty and blank texts are one group. An empty table stays empty."""
    groups = near_duplicate_groups(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key"))
    kept = groups.groupBy("group").agg(first.alias("k")).select("group", F.col("k.row_key").alias("kept"))
    times = groups.groupBy("group", "row_key").agg(F.count("*").alias("m")).join(kept, "group")
    odd = materialize(times.where("row_key <> kept or m > 1").select("row_key", (F.col("row_key") == F.col("kept")).alias("again")), "removed")
    discard(groups)
    key = free_name(docs, "row_key")
    return one_row_each(docs.withColumn(key, row_key()), odd, key).select(docs.columns)


def one_row_each(rows: DataFrame, odd: DataFrame, key: str) -> DataFrame:
    """rows without those whose key is among odd (row_key, again), but for one of each that is to be there again."""
    odd = odd.withColumnRenamed("row_key", key)
    may = may_be_among(odd, key)(key)
    some = rows.where(may)
    once = rows.where(~may).unionByName(some.join(odd.select(key), key, "left_anti"))
    return once.unionByName(some.join(odd.where("again").select(key), key, "left_semi").dropDuplicates([key]).select(rows.columns))
