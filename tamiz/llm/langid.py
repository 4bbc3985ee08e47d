"""Language identification by a byte convolutional network trained in numpy.

Network: byte embedding, convolutions of widths 2, 3 and 4, max pooling over the window, softmax. It is fitted on the
driver from a bounded sample (``TRAIN_ROWS`` rows, the same share per language as far as there are rows, chosen by a
hash of the id; ``TRAIN_WINDOWS`` windows of each), so the fit costs the same at every size. Every whole text is then
classified in fixed-length windows: for inference embedding and filters are folded into tables per byte pair, a window
is a few table look-ups and a maximum, and a text's answer is the mean probability of its windows.

Defined cases: a text that is null or has no letter is ``und`` with score 0. Rows without language are not learned from.
If nothing can be learned every text is ``und``. Null ids are held out or not like any value (crc32 of null counts as not
held out). Repeated rows get the same answer. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

WINDOW = 256
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 16
TRAIN_ROWS, TRAIN_WINDOWS = 4000, 3
STEPS, BATCH, RATE, SEED = 700, 64, 0.01, 7
GROUP = 128  # windows per numpy call, so that its arrays stay in cache
UNKNOWN = "und"


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def windows_of(raw: bytes) -> np.ndarray:
    """All windows of a text, the last one padded with zero bytes."""
    count = max(1, -(-len(raw) // WINDOW))
    return np.frombuffer(raw.ljust(count * WINDOW, b"\0"), dtype=np.uint8).reshape(count, WINDOW)


@pandas_udf(T.ArrayType(T.BinaryType()))
def _training_windows(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        if not has_letter(text):
            out.append([])
            continue
        all_ = windows_of(text.encode("utf-8", "surrogatepass"))
        picks = np.unique(np.linspace(0, len(all_) - 1, TRAIN_WINDOWS).astype(int))
        out.append([all_[i].tobytes() for i in picks])
    return pd.Series(out)


class ByteNet:
    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(SEED)
        self.languages = languages
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        self.filters = [rng.normal(0, (2 / (k * EMBED)) ** 0.5, (k * EMBED, FILTERS)).astype(np.float32) for k in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, *self.bias, self.out, self.out_bias]

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        """Gradients of the weighted cross entropy on windows ``x`` with classes ``y``."""
        n, seen = len(x), self.embed[x]
        spans, pooled, where = [], [], []
        for k, filters, bias in zip(WIDTHS, self.filters, self.bias):
            m = WINDOW - k + 1
            span = np.concatenate([seen[:, j : j + m] for j in range(k)], axis=2)
            value = span @ filters + bias
            at = value.argmax(axis=1)
            spans.append(span)
            where.append(at)
            pooled.append(np.take_along_axis(value, at[:, None], axis=1)[:, 0])
        hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
        p = _softmax(hidden @ self.out + self.out_bias)
        p[np.arange(n), y] -= 1
        p *= (weight / weight.sum())[:, None]
        d_hidden = (p @ self.out.T) * (hidden > 0)
        d_embed = np.zeros_like(self.embed)
        d_filters, d_bias, rows = [], [], np.arange(n)[:, None]
        for w, (k, filters) in enumerate(zip(WIDTHS, self.filters)):
            d = d_hidden[:, w * FILTERS : (w + 1) * FILTERS]
            best = spans[w][rows, where[w]]  # n, FILTERS, k * EMBED
            d_filters.append(np.einsum("nf,nfe->ef", d, best))
            d_bias.append(d.sum(axis=0))
            back = (d[:, :, None] * filters.T[None]).reshape(n, FILTERS, k, EMBED)
            for j in range(k):
                np.add.at(d_embed, x[rows, where[w] + j], back[:, :, j])
        return [d_embed, *d_filters, *d_bias, hidden.T @ p, p.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on batches; classes count alike whatever their number of windows."""
        rng = np.random.default_rng(SEED)
        weight = (1 / np.maximum(np.bincount(y, minlength=len(self.languages)), 1))[y].astype(np.float32)
        state = [(np.zeros_like(p), np.zeros_like(p)) for p in self.parameters()]
        for step in range(1, STEPS + 1):
            pick = rng.integers(0, len(x), min(BATCH, len(x)))
            rate = RATE * (1 - step / (STEPS + 1)) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for p, g, (m, v) in zip(self.parameters(), self.gradients(x[pick], y[pick], weight[pick]), state):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)

    def tables(self) -> list[list[tuple[int, np.ndarray]]]:
        """Per width, what each byte pair (or last single byte) at an offset adds to the filters."""
        out = []
        for k, filters, bias in zip(WIDTHS, self.filters, self.bias):
            single = [self.embed @ filters[j * EMBED : (j + 1) * EMBED] for j in range(k)]
            single[0] = single[0] + bias
            parts = [(j, (single[j][:, None] + single[j + 1][None]).reshape(65536, FILTERS)) for j in range(0, k - 1, 2)]
            if k % 2:
                parts.append((k - 1, np.ascontiguousarray(single[k - 1])))
            out.append(parts)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Scorer:
    """Applies a fitted network to windows."""

    def __init__(self, net: ByteNet):
        self.net, self.tables = net, net.tables()

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.net.languages)), np.float32)
        for a in range(0, len(windows), GROUP):
            x = windows[a : a + GROUP].astype(np.int32)
            pairs = x[:, :-1] * 256 + x[:, 1:]
            pooled = []
            for k, parts in zip(WIDTHS, self.tables):
                m = WINDOW - k + 1
                total = None
                for j, table in parts:
                    index = pairs[:, j : j + m] if len(table) == 65536 else x[:, j : j + m]
                    value = table.take(index, axis=0)
                    total = value if total is None else np.add(total, value, out=total)
                pooled.append(total.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            out[a : a + GROUP] = _softmax(hidden @ self.net.out + self.net.out_bias)
        return out

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        todo, held, size = [], [], 0

        def flush():
            p = self.probabilities(np.concatenate(held))
            starts = np.concatenate([[0], np.cumsum([len(h) for h in held])[:-1]])
            mean = np.add.reduceat(p, starts, axis=0) / np.array([len(h) for h in held])[:, None]
            for row, best, score in zip(todo, mean.argmax(axis=1), mean.max(axis=1)):
                names[row], scores[row] = self.net.languages[best], min(1.0, float(score))

        for row, text in enumerate(texts):
            if not has_letter(text):
                continue
            todo.append(row)
            held.append(windows_of(text.encode("utf-8", "surrogatepass")))
            size += len(held[-1])
            if size >= 16 * GROUP:
                flush()
                todo, held, size = [], [], 0
        if todo:
            flush()
        return names, scores


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int = TRAIN_ROWS) -> ByteNet | None:
    """A network fitted to at most ``rows`` of the rows that are not held out."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("out"))
    known = known.filter("lang IS NOT NULL AND text IS NOT NULL AND NOT out")
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per language that is learned
    if not counts:
        return None
    unit = (F.xxhash64("id", F.lit(SEED)).bitwiseAND((1 << 40) - 1)) / (1 << 40)
    wanted = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], rows / len(counts) / r["n"])])
    share = known.filter(unit < F.element_at(wanted, F.col("lang")))
    found = share.select("lang", "id", _training_windows("text").alias("w"), unit.alias("unit")).orderBy("unit", "id").limit(rows)
    sample = sorted(((r["unit"], r["lang"], w) for r in found.collect() for w in r["w"]), key=lambda s: s[:2])
    if not sample:
        return None
    names = sorted({lang for _, lang, _ in sample})
    net = ByteNet(names)
    x = np.frombuffer(b"".join(bytes(w) for *_, w in sample), dtype=np.uint8).reshape(-1, WINDOW)
    net.fit(x, np.array([names.index(lang) for _, lang, _ in sample]))
    return net


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score."""

    @pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(net) if net else None
        for texts in batches:
            names, scores = scorer.classify(list(texts)) if scorer else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    out = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), predict(text_col).alias("p"))
    return out.select(id_col, "held_out", "p.lang_pred", "p.score")


def learned_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows that are not held out, then identify every row."""
    return identify(docs, train(docs, id_col, text_col, lang_col), id_col, text_col)
