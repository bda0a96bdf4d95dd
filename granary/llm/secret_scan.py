"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, the other of ordinary identifiers; both are trained from labelled samples. A run of key characters that holds a digit
and a letter is a secret if the first model explains it better than the second by at least THRESHOLD nats; one without a digit, in which a capital follows a small letter,
needs LETTERS nats. Other runs are numbers or words.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import change_texts, per_row, table, texts

#: Patterns of the base kinds and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "markov")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
THRESHOLD, LETTERS = 8.0, 16.0
_MIXED = re.compile(r"[a-z].*[A-Z]")

_HEX_RUN = re.compile(r"[0-9a-f]{16,}")  # the maximal runs that are long enough
_WORDS = ("passw", "secret", "token", "api")
_LETTERS = string.ascii_letters + string.digits + "+/_=-"
_INDEX = np.full(256, len(_LETTERS), np.uint8)
_INDEX[np.frombuffer(_LETTERS.encode(), np.uint8)] = np.arange(len(_LETTERS))

#: Words that the ordinary samples are made of.
ORDINARY = """
account action address agent alert alias amount answer archive argument array asset author average backup balance bar batch block board body branch bucket
buffer build button cache call campaign card cart category center chain change channel chapter character check child city class client clock cloud cluster
code collection column comment commit company component config connection contact content context control cookie copy count country course cover create
current customer dashboard data database date day default delete delivery demo department description design detail device dialog directory discount
display document domain download draft drive edit editor element email employee engine entity entry error event example export expression extension factory
feature feed field figure file filter final find first flag folder font footer form format frame function game gateway group guide handler header health
height history home host icon image import index info input instance interface invoice issue item job journal kernel key label language last layout level
library license line link list loader local location logger login machine manager map market master matrix media member memory menu message method metric
mobile model module monitor month name network news node note notice number object offer office option order organization output owner package page panel
parameter parent part partner path payment percent person phone picture place plan platform player plugin point policy position post price print process
product profile program project property provider public query question queue quote random range rate reader record region release remote report request
resource response result return review role route rule sample scale schedule schema school score screen script search season section select sender series
server service session setting shape share sheet shop signal single site size slot source space stage start state station status step storage store story
stream string student style subject summary support switch symbol system table tag target task team template term test text theme thread ticket time title
tool topic total track traffic transfer travel tree type unit update upload user value vector version video view visit volume watch week weight widget width
window word worker world year zone
""".split()


def labelled_samples(n: int = 4000, seed: int = 20240229) -> list[tuple[str, bool]]:
    """(string, whether it is a secret): random strings over common alphabets, and identifiers as people write them."""
    rng = random.Random(seed)
    digits = string.digits
    alphabets = [string.ascii_letters + digits, string.ascii_letters + digits + "+/", string.ascii_letters + digits + "_-", string.ascii_uppercase + digits, string.ascii_lowercase + digits, digits + "abcdef", digits + "ABCDEF", string.ascii_uppercase + "234567"]
    secrets = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(16, 64))), True) for _ in range(n)]
    names = []
    while len(names) < n:
        words = rng.choices(ORDINARY, k=rng.randint(2, 5))
        form = rng.randrange(5)
        name = rng.choice("_-/").join(words) if form < 2 else "".join(w.capitalize() for w in words) if form == 2 else "_".join(words).upper() if form == 3 else "".join([words[0], *(w.capitalize() for w in words[1:])])
        extra = rng.choice(["", str(rng.randint(0, 99)), f"_v{rng.randint(1, 12)}", f"-{rng.randint(1990, 2030)}", f"_{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"_{rng.randint(1, 999):05}", f"/{rng.randint(1, 9999)}"])
        if len(name + extra) >= 12:
            names.append((name + extra, False))
    return secrets + names


def codes(s: str) -> np.ndarray:
    return _INDEX[np.frombuffer(s.encode("ascii", "replace"), np.uint8)]


def train(samples: Iterable[tuple[str, bool]]) -> np.ndarray:
    """Table of log P(b | a, random) - log P(b | a, ordinary); the last row and column stand for the start and for other characters."""
    size = len(_LETTERS) + 1
    counts = np.full((2, size, size), 0.2)
    for s, label in samples:
        c = codes(s).astype(np.intp)
        np.add.at(counts[int(label)], (np.concatenate([[size - 1], c[:-1]]), c), 1)
    logs = np.log(counts / counts.sum(axis=2, keepdims=True))
    return logs[1] - logs[0]


def ratio(table_: np.ndarray, s: str) -> float:
    c = codes(s).astype(np.intp)
    return float(table_[np.concatenate([[len(_LETTERS)], c[:-1]]), c].sum())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end (code points, end exclusive) of the fixed patterns, by start, then kind."""
    found = []
    lower = text.lower() if text.isascii() else text.casefold()
    if any(w in lower for w in _WORDS):  # else nothing can match
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", *m.span()) for m in _HEX_RUN.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def markov_spans(text: str, table_: np.ndarray) -> list[tuple[str, int, int]]:
    found = []
    for m in RUN.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s):
            least = THRESHOLD if any(c.isalpha() for c in s) else None
        else:
            least = LETTERS if _MIXED.search(s) else None
        if least is not None and ratio(table_, s) >= least:
            found.append(("markov", *m.span()))
    return found


def scan(text: str, table_: np.ndarray) -> tuple[list, list]:
    """Base spans, and all spans: base ones and those of the models that no base span holds already."""
    base, more, at, reach = base_spans(text), [], 0, 0
    for x in markov_spans(text, table_):  # both are sorted by start; reach: where the base spans that start no later end
        while at < len(base) and base[at][1] <= x[1]:
            reach = max(reach, base[at][2])
            at += 1
        if reach < x[2]:
            more.append(x)
    return base, sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0])))


def joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secrets(docs: DataFrame, samples: Iterable[tuple[str, bool]] | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each row. Null and empty texts have no spans; repeated rows and null doc_ids each
    come back. Other columns are not read."""
    models = train(samples or labelled_samples())

    def make():
        def one(doc_id, text):
            base, spans = scan(text, models)
            n = [sum(b[0] == k for b in base) for k in KINDS[:3]]
            return doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

        return one

    return per_row(texts(docs), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", make, "doc_id", "text")


def redact(docs: DataFrame, samples: Iterable[tuple[str, bool]] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret span, or each chain of overlapping ones, replaced by mark; n_chars, where there is such a column, follows. Null texts stay null; documents without
    secrets, null doc_ids, repeated rows and all other columns stay as they are; an empty table stays empty."""
    models = train(samples or labelled_samples())

    def clean(text: str | None) -> str | None:
        spans = scan(text, models)[1] if text else []
        if not spans:
            return text
        kept, at = [], 0
        for _, s, e in spans:
            if s >= at:
                kept += [text[at:s], mark]
            at = max(at, e)
        return "".join(kept) + text[at:]

    return change_texts(docs, lambda: clean)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
