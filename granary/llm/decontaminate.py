"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A seed is a fixed mask over consecutive words: the words at its ones are hashed, those at its zeros may be anything. Seeds of documents and of benchmark items are
joined; a hit names a document, an item and a diagonal (the offset of one in the other). Around every hit the two texts are compared word by word along the
diagonal, and the overlap is the stretch of LEAST_WORDS or more that scores best when a mismatch costs four matches, so that it tolerates one substitution in five words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import free_name, materialize, may_be_among, row_key, table

#: Together they hit any two texts of 13 words that differ in two, of 15 in three, of 20 in four: at any places.
MASKS = ("1110101", "1101011", "11111")
#: An overlap counts from so many words, or the whole of a shorter item, and from this share of equal words.
LEAST_WORDS, SIMILARITY = 13, 0.8
#: Seeds of the benchmark that are broadcast, at most (16 bytes each); a larger benchmark is joined by a shuffle.
BROADCAST_SEEDS = 2_000_000


def word_hashes(text: Column) -> Column:
    """Hashes of the lower-case words (runs of letters and digits) of a text."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, hashes: str, masks: tuple[str, ...], *carried: str) -> DataFrame:
    """The carried columns with key, at (from 1) and before for every mask at every place of the array `hashes`; before: the key at the place before, null at the first. The keys of
    each mask are columns of their own first, so that they are computed once."""

    def keys(mask: str) -> Column:
        ones = [i for i, bit in enumerate(mask) if bit == "1"]
        places = F.sequence(F.lit(1), F.size(hashes) - len(mask) + 1)
        key = lambda i: F.xxhash64(F.lit(mask), *(F.get(F.col(hashes), i + (o - 1)) for o in ones))
        return F.when(F.size(hashes) >= len(mask), F.transform(places, key)).otherwise(F.array().cast("array<long>"))

    names = [f"keys_{i}" for i in range(len(masks))]
    made = rows.select(*carried, *(keys(m).alias(n) for m, n in zip(masks, names, strict=True)))

    def placed(name: str) -> Column:
        return F.transform(name, lambda k, i: F.struct(k.alias("key"), (i + 1).alias("at"), F.get(F.col(name), i - 1).alias("before")))

    return made.select(*carried, F.explode(F.concat(*map(placed, names))).alias("s")).select(*carried, "s.*")


def overlap(least: Column) -> Column:
    """(score, first, words) of the best stretch of `least` or more words of the array `same`; first counts from 0; a score under 0: none has SIMILARITY.

    Sums of +1 and -4 from the start: a stretch scores the sum at its end less the one at its start, and the lowest sum that is `least` words behind is kept along.
    """
    worth = lambda equal: F.when(equal, F.lit(1)).otherwise(F.lit(-4))
    state = F.struct(*(F.lit(x).alias(c) for c, x in {"at": 0, "sum": 0, "behind": 0, "low": 0, "low_at": 0, "best": -1, "first": 0, "words": 0}.items()))

    def step(s: Column, equal: Column) -> Column:
        at, total = s["at"] + 1, s["sum"] + worth(equal)
        back = at - least
        behind = F.when(back > 0, s["behind"] + worth(F.get(F.col("same"), back - 1))).otherwise(F.lit(0))
        lower = (back > 0) & (behind <= s["low"])
        low, low_at = F.when(lower, behind).otherwise(s["low"]), F.when(lower, back).otherwise(s["low_at"])
        better = (back >= 0) & (total - low > s["best"])
        keep = lambda new, old: F.when(better, new).otherwise(s[old]).alias(old)
        return F.struct(at.alias("at"), total.alias("sum"), behind.alias("behind"), low.alias("low"), low_at.alias("low_at"), keep(total - low, "best"), keep(low_at, "first"), keep(at - low_at, "words"))

    return F.aggregate("same", state, step, lambda s: F.struct(s["best"].alias("score"), s["first"].alias("first"), s["words"].alias("words")))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, row_key, item_id, doc_start, n_words, n_equal, item_words, similarity: the best overlap of each pair of a document and an item that has one.

    Counted in words; doc_start from 0. Items with equal words are one, named by their smallest item_id (null ids last). Items and texts that are null or hold no word
    have no overlap; an item shorter than the longest mask must occur whole and unchanged. row_key tells rows with the same doc_id apart (hash of id and text); rows that
    share both come back once. Extra columns are not read. Either table may be empty.

    Of hits that follow one another on a diagonal only the first counts: one whose seeds have equal seeds before them is skipped. So a word that is said over and over in a
    text and in an item gives as many rows as the two are long.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text").cast("string")).alias("item")).where(F.size("item") > 0)
    items = materialize(items.groupBy("item").agg(F.min("item_id").alias("item_id")).select("item_id", "item", F.monotonically_increasing_id().alias("item_key")), "items")
    span = max(map(len, MASKS))
    short = sorted(r[0] for r in items.where(F.size("item") < span).select(F.size("item")).distinct().collect())  # at most span - 1 numbers
    masks = MASKS + tuple("1" * n for n in short if "1" * n not in MASKS)
    of_items = materialize(seeds(items, "item", masks, "item_key").withColumnsRenamed({"at": "item_at", "before": "item_before"}), "seeds")
    small = of_items.count() <= BROADCAST_SEEDS

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row_key")).where("text is not null")
    of_docs = seeds(rows.select("row_key", word_hashes(F.col("text")).alias("words")), "words", masks, "row_key")
    first = F.expr("before is null or item_before is null or before <> item_before")
    hits = of_docs.join(F.broadcast(of_items) if small else of_items, "key").where(first).select("row_key", "item_key", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    hits = materialize(hits, "hits")

    hit = rows.where(may_be_among(hits, "row_key")("row_key")).join(hits.select("row_key").distinct(), "row_key")
    hit = materialize(hit.select("doc_id", "row_key", word_hashes(F.col("text")).alias("words")).dropDuplicates(["row_key"]), "words")
    found = hit.join(hits, "row_key").join(items, "item_key")
    start, skipped = F.greatest("diagonal", F.lit(0)), F.greatest(-F.col("diagonal"), F.lit(0))
    length = F.least(F.size("words") - start, F.size("item") - skipped)
    same = F.zip_with(F.slice("words", start + 1, length), F.slice("item", skipped + 1, length), lambda a, b: a == b)
    found = found.select("doc_id", "row_key", "item_id", F.size("item").alias("item_words"), start.alias("start"), same.alias("same"))
    least = F.least(F.lit(LEAST_WORDS), "item_words")
    found = found.withColumn("whole", F.size(F.filter("same", lambda x: x))).where(F.col("whole") >= SIMILARITY * least)  # fewer equal words suffice for no stretch
    found = materialize(found, "aligned").withColumn("o", overlap(least))
    whole = F.col("whole") >= SIMILARITY * F.col("item_words")
    part = F.col("o.score") >= 0
    found = found.where(whole | part).select(
        "doc_id", "row_key", "item_id",
        F.when(whole, F.col("start")).otherwise(F.col("start") + F.col("o.first")).alias("doc_start"),
        F.when(whole, F.size("same")).otherwise(F.col("o.words")).alias("n_words"),
        F.when(whole, F.col("whole")).otherwise(((F.col("o.score") + 4 * F.col("o.words")) / 5).cast("int")).alias("n_equal"), "item_words",
    )
    best = F.max_by(F.struct("doc_start", "n_words", "n_equal"), F.struct("n_equal", -F.col("n_words"), -F.col("doc_start")))
    found = found.groupBy("doc_id", "row_key", "item_id", "item_words").agg(best.alias("b"))
    return found.select("doc_id", "row_key", "item_id", "b.*", "item_words", F.round(F.col("b.n_equal") / F.col("b.n_words"), 6).alias("similarity"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that overlap a benchmark item. All other rows stay, null and empty texts, null doc_ids and repeated rows too, and all columns as they are; rows that
    share a doc_id are judged by their own texts. Either table may be empty."""
    bad = materialize(overlaps(docs, benchmark).select("row_key").distinct(), "bad")
    key = free_name(docs, "row_key")
    bad = bad.withColumnRenamed("row_key", key)
    keyed, may = docs.withColumn(key, row_key()), may_be_among(bad, key)(key)
    return keyed.where(~may).unionByName(keyed.where(may).join(bad, key, "left_anti")).select(docs.columns)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")
