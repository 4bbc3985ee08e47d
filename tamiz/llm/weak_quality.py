"""Quality classifier from weak labels.

Eight heuristics vote good, bad or nothing on every text. Expectation-maximisation over the counts of vote patterns (at
most 3^8, whatever the input) estimates how often each heuristic votes right, and gives every pattern the posterior that
its text is good. Posteriors of a bounded sample (``TRAIN_ROWS``, chosen by a hash of the id) train a linear scorer over
hashed byte 4-grams, which then scores every whole text. No true label is used.

Two scans of the text with Python, one of a sample; the only shuffle is that of the pattern counts.

Defined cases: a text without a 4-gram (null, empty, shorter than 4 bytes) has its posterior as score. Null ids and
repeated rows are scored like any other. An empty table gives no rows. Only the id and the text column are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from tamiz.llm.base import Stages
from tamiz.llm.quality_rules import SYMBOLS, repeated_words

BAD, NONE, GOOD = 0, 1, 2
NAMES = ("symbols", "repeats", "capitals", "short_words", "stops", "variety", "length", "lines")
DIM = 1 << 14
TRAIN_ROWS = 4000
ROUNDS, STEPS, RATE, RIDGE, SEED = 100, 150, 0.05, 1e-5, 11
SCALE = 100.0
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))


def _between(value: float, bad_below: float, good_from: float, good_to: float, bad_above: float) -> int:
    if value < bad_below or value > bad_above:
        return BAD
    return GOOD if good_from <= value <= good_to else NONE


def votes(text: str | None) -> list[int]:
    """One vote per heuristic of ``NAMES``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(1, len(words))
    upper = len(raw) - len(raw.translate(None, UPPER))
    lower = len(raw) - len(raw.translate(None, LOWER))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    short = sum(len(w) <= 3 for w in words) / n
    stops = sum(w.endswith((b".", b"!", b"?")) for w in words) / n
    lines = [line for line in raw.split(b"\n") if line.strip()]
    again = 1 - len(set(lines)) / len(lines) if lines else 0.0
    inf = float("inf")
    return [
        _between(symbols / n, -inf, -inf, 0.02, 0.10),
        _between(repeated_words(words) / n, -inf, -inf, 0.10, 0.30),
        _between(upper / max(1, upper + lower), -inf, -inf, 0.20, 0.50),
        _between(short, 0.08, 0.15, 0.60, 0.80),
        _between(stops, 0.005, 0.015, 0.20, 0.40),
        _between(len(set(words)) / n, 0.10, 0.25, inf, inf) if words else BAD,
        _between(len(words), 20, 50, inf, inf),
        _between(again, -inf, -inf, 0.05, 0.30),
    ]


@pandas_udf(T.IntegerType())
def pattern_column(texts: pd.Series) -> pd.Series:
    powers = 3 ** np.arange(len(NAMES))
    return pd.Series([int(np.dot(votes(t), powers)) for t in texts], dtype="int32")


def pattern_votes(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(NAMES))[None] % 3


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: posterior of good per pattern, and P(vote | class) per heuristic.

    It starts from the share of good votes, which fixes which of the two classes is the good one.
    """
    cast = np.eye(3)[pattern_votes(patterns)]  # patterns, heuristics, votes
    good, bad = cast[:, :, GOOD].sum(1), cast[:, :, BAD].sum(1)
    posterior = (good + 0.5) / (good + 2 * bad + 1)
    for _ in range(ROUNDS):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        rates = np.einsum("cp,phv->chv", weight, cast) + 1.0
        rates /= rates.sum(axis=2, keepdims=True)
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        logs = np.log(prior)[:, None] + np.einsum("phv,chv->cp", cast, np.log(rates))
        after = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(after - posterior).max() < 1e-9:
            break
        posterior = after
    return posterior, rates


def grams(text: str | None) -> np.ndarray:
    """Hashed byte 4-grams of a text, in order."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(raw) < 4:
        return np.zeros(0, dtype=np.int64)
    x = raw.astype(np.uint32)
    code = x[:-3] | x[1:-2] << np.uint32(8) | x[2:-1] << np.uint32(16) | x[3:] << np.uint32(24)
    return ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - DIM.bit_length() + 1)).astype(np.int64)


@pandas_udf(T.BinaryType())
def _sparse(texts: pd.Series) -> pd.Series:
    """Hashed counts as little-endian 32-bit slot, count, slot, count, ...; bounded by twice ``DIM``."""
    out = []
    for text in texts:
        counts = np.bincount(grams(text), minlength=1)
        slots = np.flatnonzero(counts)
        out.append(np.stack([slots, counts[slots]], axis=1).astype("<i4").tobytes())
    return pd.Series(out)


def fit_scorer(rows: list[np.ndarray], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on mean hashed counts; good and bad weigh alike."""
    lengths = np.array([len(r) // 2 for r in rows])
    flat = np.concatenate(rows).reshape(-1, 2)
    owner, slot = np.repeat(np.arange(len(rows)), lengths), flat[:, 0]
    totals = np.bincount(owner, weights=flat[:, 1], minlength=len(rows))
    value = SCALE * flat[:, 1] / np.maximum(totals, 1)[owner]
    balance = np.where(target > 0.5, 0.5 / max(target.sum(), 1e-9), 0.5 / max((1 - target).sum(), 1e-9))
    w, b = np.zeros(DIM), 0.0
    m, v = np.zeros(DIM + 1), np.zeros(DIM + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(owner, weights=value * w[slot], minlength=len(rows)) + b
        error = balance * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target)
        g = np.append(np.bincount(slot, weights=value * error[owner], minlength=DIM) + RIDGE * w, error.sum())
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        b -= move[-1]
    return w, b


def score_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: id, pattern (vote code), posterior, score, good (score at least one half)."""
    stages = Stages(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    voted = stages.keep(base.groupBy(pattern_column("text").alias("pattern")).agg(F.count(F.lit(1)).alias("n")))
    counted = voted.collect()  # at most 3^8 rows
    if not counted:
        return docs.sparkSession.createDataFrame([], f"{id_col} long, pattern int, posterior double, score double, good boolean")
    patterns, counts = (np.array([r[k] for r in counted]) for k in ("pattern", "n"))
    posterior, _ = estimate(patterns, counts)
    table = np.full(3 ** len(NAMES), 0.5)
    table[patterns] = posterior
    unit = (F.xxhash64("id", F.lit(SEED)).bitwiseAND((1 << 40) - 1)) / (1 << 40)
    share = base.filter(unit < 1.5 * rows / int(counts.sum()))
    picked = share.select("id", unit.alias("unit"), pattern_column("text").alias("pattern"), _sparse("text").alias("s"))
    sample = [r for r in picked.orderBy("unit", "id").limit(rows).collect() if r["s"]]  # packed: boxed numbers take ten times the room
    w, b = np.zeros(DIM), 0.0
    if sample:
        w, b = fit_scorer([np.frombuffer(r["s"], "<i4") for r in sample], table[[r["pattern"] for r in sample]])
    weights = w.astype(np.float32)

    @pandas_udf("pattern int, posterior double, score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        powers = 3 ** np.arange(len(NAMES))
        for texts in batches:
            out = []
            for text in texts:
                pattern, slots = int(np.dot(votes(text), powers)), grams(text)
                z = b + SCALE * float(weights[slots].mean()) if len(slots) else None
                p = float(table[pattern])
                out.append((pattern, p, p if z is None else float(1 / (1 + np.exp(-np.clip(z, -50, 50))))))
            yield pd.DataFrame(out, columns=["pattern", "posterior", "score"]).astype({"pattern": "int32"})

    out = base.select("id", score("text").alias("q"))
    return out.select(F.col("id").alias(id_col), "q.pattern", "q.posterior", "q.score", (F.col("q.score") >= 0.5).alias("good"))
