"""Language identification by hierarchical discrimination: the family first, then, within it, one-versus-one linear support vector machines.

A text is a vector of hashed character 2- and 3-grams of its letters, square roots of counts at length one. The machines are trained by averaged stochastic
subgradient steps on the hinge loss, over a bounded sample of the labelled rows.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import keep_rows, per_row, table

#: Width of the vectors; rows of each language that training sees at most; languages that are learned at most, the most frequent ones.
WIDTH, SAMPLE, LANGUAGES = 1 << 12, 400, 200
EPOCHS, STRENGTH = 12, 1e-4
UNKNOWN = "und"

#: Languages by family; any other is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "indic": "hi bn ur mr gu pa",
    "semitic": "ar he am",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = re.compile(r"[^\W\d_]")
_SEPARATORS = bytes(32 if b < 65 or 91 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


def has_letter(text: str) -> bool:
    """Whether a character is a letter to Unicode; numbers such as \u00b2 or \u2167 are none."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def vector(text: str) -> np.ndarray:
    """Unit vector over the whole text; bytes below 0x80 that are not letters separate words."""
    raw = b" " + text.lower().encode().translate(_SEPARATORS) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    b = b[np.concatenate([[True], (b[1:] != 32) | (b[:-1] != 32)])]
    counts = np.zeros(WIDTH)
    for i in range(0, max(1, len(b) - 1), 1 << 20):
        c = b[i : i + (1 << 20) + 2]
        two = c[:-1] << np.uint32(8) | c[1:]
        three = two[:-1] << np.uint32(8) | c[2:]
        for grams, seed in ((two, 0x85EBCA6B), (three, 0x9E3779B1)):
            counts += np.bincount(grams * np.uint32(seed) >> np.uint32(20), minlength=WIDTH)
    x = np.sqrt(counts)
    return (x / max(np.linalg.norm(x), 1e-12)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights, the last one the bias, of a linear support vector machine for labels -1 and 1; both sides count alike."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)
    rng, w, total, t = np.random.default_rng(seed), np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            t += 1
            rate = 1 / (STRENGTH * (t + 100 / STRENGTH / len(x)))
            rate = min(rate, 4.0)
            hit = y[i] * (x[i] @ w) < 1
            w *= 1 - rate * STRENGTH
            if hit:
                w += rate * weight[i] * y[i] * x[i]
            total += w
    return total / max(t, 1)


class Classifier:
    def __init__(self, x: np.ndarray, labels: list[str]):
        self.languages = sorted(set(labels))
        label = np.array(labels)
        family = np.array([FAMILY.get(v, v) for v in labels])
        self.families = sorted(set(family.tolist()))
        rest = [machine(x, np.where(family == f, 1, -1)) for f in self.families] if len(self.families) > 1 else []
        self.family_weights = np.array(rest)
        self.members = {f: sorted(set(label[family == f].tolist())) for f in self.families}
        self.pairs = {}
        for members in self.members.values():
            for a, b in combinations(members, 2):
                of = (label == a) | (label == b)
                self.pairs[a, b] = machine(x[of], np.where(label[of] == a, 1, -1))

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        x = np.append(vector(text), 1.0)
        family, margin = self.families[0], 4.0
        if len(self.families) > 1:
            s = self.family_weights @ x
            order = np.argsort(-s, kind="stable")
            family, margin = self.families[order[0]], float(s[order[0]] - s[order[1]]) / 2
        members = self.members[family]
        votes, least = dict.fromkeys(members, 0), dict.fromkeys(members, 4.0)
        for a, b in combinations(members, 2):
            s = float(self.pairs[a, b] @ x)
            votes[a if s >= 0 else b] += 1
            least[a], least[b] = min(least[a], s), min(least[b], -s)
        best = max(members, key=lambda m: (votes[m], least[m], m))
        return best, float(1 / (1 + np.exp(-4 * min(margin, least[best]))))


def remainder() -> Column:
    """crc32 of the doc_id as text, modulo 3; a null doc_id gives 0."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)), F.lit(0))


def share_of(n: int, sample: int) -> float:
    """The share of n rows that holds `sample` of them with some to spare, so that few are sorted and hardly ever too few."""
    return min(1.0, (2 * sample + 50) / n)


def train(docs: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Learns from text and non-null lang of rows outside the held-out third. Of each language the `sample` rows with the smallest hash of doc_id and text are learned from, or all if
    there are fewer; rows with equal doc_id, lang and text count as one. Only the LANGUAGES most frequent languages are learned (ties by name). They are vectorised where
    they lie; the driver sees those vectors only, their values other than zero (sample * LANGUAGES * WIDTH of them at most). Without such rows nothing is learned."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (remainder() != 1))
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not totals:
        return Classifier(np.zeros((0, WIDTH), np.float32), [])
    share = F.create_map(*(F.lit(v) for lang, n in totals.items() for v in (lang, share_of(n, sample))))
    hashed = rows.withColumn("h", F.xxhash64("doc_id", "text", F.lit("language")))
    chosen = hashed.where(F.col("lang").isin(list(totals)) & (F.col("h") / F.lit(2.0**64) + 0.5 < share[F.col("lang")])).distinct()
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id", "text"))
    chosen = chosen.withColumn("nth", nth).where(F.col("nth") <= sample)

    def make():
        def one(lang, nth, text):
            if not has_letter(text):
                return lang, nth, None, None
            x = vector(text)
            at = np.flatnonzero(x)
            return lang, nth, at.astype("<u2").tobytes(), x[at].astype("<f4").tobytes()

        return one

    # the rows are put in order here: a sort in Spark would vectorise them twice and send a sample of the vectors to the driver first
    found = per_row(chosen, "lang string, nth int, at binary, x binary", make, "lang", "nth", "text").where("x is not null").toArrow()
    found = found.take(pc.sort_indices(found.select(["lang", "nth"]), [("lang", "ascending"), ("nth", "ascending")]))
    x = np.zeros((len(found), WIDTH), np.float32)
    for row, at, values in zip(x, found["at"], found["x"], strict=True):
        row[np.frombuffer(at.as_buffer(), "<u2")] = np.frombuffer(values.as_buffer(), "<f4")
    return Classifier(x, found["lang"].to_pylist())


def identify(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row. und (score 0) for null texts and texts without a letter, and for all if nothing was learned. Rows
    with null or repeated doc_ids each come back; only doc_id and text are read, and the prediction sees the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def make():
        learned = shared.value
        return lambda doc_id, held_out, text: (doc_id, held_out, *learned.predict(text or ""))

    return per_row(docs, "doc_id long, held_out boolean, lang_pred string, score double", make, F.col("doc_id").cast("long").alias("doc_id"), (remainder() == 1).alias("held_out"), F.col("text"))


def known_language(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """docs without the rows whose language cannot be told (und): null texts and texts without a letter, or all of them if nothing was learned. All other
    rows, repeated ones and those with null doc_ids too, and all columns stay as they are; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    def make():
        learned = shared.value
        return lambda text: learned.predict(text or "")[0] != UNKNOWN

    return keep_rows(docs, "text", make)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
