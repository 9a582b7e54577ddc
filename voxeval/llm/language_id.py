"""Language identification by a byte convolutional network.

Windows of fixed length cover the whole UTF-8 text. A network with byte embeddings, filters of several widths, maximum
pooling over the window and a softmax is trained in numpy on windows of labelled texts; a text gets the mean of its windows'
probabilities, weighted by their bytes. In tasks the filters are folded into tables (a pair of bytes is one row), so
a window costs a few look-ups per byte, and windows of an Arrow batch are handled together in blocks of bounded size.

The fit uses about ``TRAIN_TEXTS`` texts of each language, chosen by a hash of doc_id, and up to ``TRAIN_WINDOWS`` windows of
each. Defined cases: a null text and one without a letter are ``und`` with score 0; labels that are null are not learned;
without a labelled text every prediction is ``und``; repeated rows are predicted alike; an empty table has an empty result;
other columns are passed by, but for those with the names of results, which the results replace.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxeval.session import stage

from .base import uniform

WINDOW = 256
WIDTHS, FILTERS, DIM = (2, 3, 4), 16, 8
TRAIN_TEXTS, TRAIN_WINDOWS, MAX_LANGS = 500, 3, 200
EPOCHS, BATCH, RATE = 6, 64, 0.004
#: Windows that are handled at once in a task.
BLOCK = 256
UNKNOWN = "und"


def windows(text: str, size: int = WINDOW) -> np.ndarray:
    """The whole text as rows of ``size`` bytes, the last one filled with zeros."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = -(-len(raw) // size)
    out = np.zeros(n * size, np.uint8)
    out[: len(raw)] = raw
    return out.reshape(n, size)


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256, DIM
    filters: list[np.ndarray]  # per width: width * DIM, FILTERS
    bias: np.ndarray  # all filters
    out: np.ndarray  # all filters, langs
    shift: np.ndarray  # langs

    @classmethod
    def fresh(cls, langs: list[str], rng: np.random.Generator) -> Network:
        wide = FILTERS * len(WIDTHS)
        return cls(
            langs, rng.normal(0, 0.5, (256, DIM)), [rng.normal(0, (w * DIM) ** -0.5, (w * DIM, FILTERS)) for w in WIDTHS],
            np.zeros(wide), rng.normal(0, wide**-0.5, (wide, len(langs))), np.zeros(len(langs)),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, *self.filters, self.bias, self.out, self.shift]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the mean cross entropy of windows ``x`` with classes ``y``."""
        b, size = x.shape
        e = self.embed[x]
        pooled, where, unfolded = [], [], []
        for w, f in zip(WIDTHS, self.filters):
            u = np.concatenate([e[:, i : size - w + 1 + i] for i in range(w)], axis=2)
            z = u @ f
            k = z.argmax(axis=1)
            pooled.append(np.take_along_axis(z, k[:, None], axis=1)[:, 0])
            where.append(k)
            unfolded.append(u)
        raw = np.concatenate(pooled, axis=1) + self.bias
        h = np.maximum(raw, 0)
        p = softmax(h @ self.out + self.shift)
        loss = -np.log(p[np.arange(b), y] + 1e-12).mean()
        d = p.copy()
        d[np.arange(b), y] -= 1
        d /= b
        dh = (d @ self.out.T) * (raw > 0)
        de, df = np.zeros_like(e), []
        rows = np.arange(b)[:, None]
        for j, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            g = dh[:, j * FILTERS : (j + 1) * FILTERS]
            picked = unfolded[j][rows, where[j]]  # b, FILTERS, w * DIM
            df.append(np.einsum("bfd,bf->df", picked, g))
            back = (g[:, :, None] * f.T[None]).reshape(b, FILTERS, w, DIM)
            for i in range(w):
                np.add.at(de, (rows, where[j] + i), back[:, :, i])
        dembed = np.zeros_like(self.embed)
        np.add.at(dembed, x.ravel(), de.reshape(-1, DIM))
        return [dembed, *df, dh.sum(axis=0), h.T @ d, d.sum(axis=0)], loss

    def tables(self) -> Tables:
        steps = [[(self.embed @ f.reshape(w, DIM, FILTERS)[i]).astype(np.float32) for i in range(w)] for w, f in zip(WIDTHS, self.filters)]

        def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)

        joined = [[(i, pair(s[i], s[i + 1])) if i + 1 < len(s) else (i, s[i]) for i in range(0, len(s), 2)] for s in steps]
        return Tables(self.langs, joined, self.bias.astype(np.float32), self.out.astype(np.float32), self.shift.astype(np.float32))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Tables:
    """The network with its filters as tables by byte or by pair of bytes; (first byte's place, table) per look-up."""

    langs: list[str]
    steps: list[list[tuple[int, np.ndarray]]]
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        done = [self._block(x[a : a + BLOCK]) for a in range(0, len(x), BLOCK)]
        return np.concatenate(done) if done else np.zeros((0, len(self.langs)), np.float32)

    def _block(self, x: np.ndarray) -> np.ndarray:
        one = x.astype(np.intp)
        two = (one[:, :-1] << 8) | one[:, 1:]
        pooled = []
        for width, steps in zip(WIDTHS, self.steps):
            n = x.shape[1] - width + 1
            total = None
            for place, table in steps:
                part = table.take((two if len(table) > 256 else one)[:, place : place + n], axis=0)
                total = part if total is None else np.add(total, part, out=total)
            pooled.append(total.max(axis=1))
        return softmax(np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out + self.shift)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 3) -> Network:
    """Adam on cross entropy, rows dealt anew each epoch."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(langs, rng)
    ps = net.parameters()
    m, v, t = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            at = order[a : a + BATCH]
            gs, _ = net.gradients(x[at], y[at])
            t += 1
            for i, g in enumerate(gs):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                ps[i] -= RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return net


def training_windows(docs: DataFrame, allowed: Column, per_lang: int = TRAIN_TEXTS, seed: str = "lang") -> DataFrame:
    """(lang, window) of about ``per_lang`` texts of each of the MAX_LANGS most frequent languages.

    Each language has its own share, so a rare one is not lost and a frequent one does not grow with the table.
    """
    known = docs.filter(allowed & F.col("lang").isNotNull() & has_letter())
    shares = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS)
    shares = shares.select("lang", F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("count")).alias("_share"))
    chosen = known.select("doc_id", "lang", "text").join(F.broadcast(shares), "lang").filter(uniform(seed, F.col("doc_id")) < F.col("_share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, held = [], []
            for i, lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                ws = windows(text)
                picks = np.linspace(0, len(ws) - 1, min(len(ws), TRAIN_WINDOWS)).astype(int)
                for k in picks:
                    langs.append(lang)
                    held.append(ws[k].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(held, pa.binary())], names=["lang", "window"])

    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("window", T.BinaryType())])
    return chosen.select("doc_id", "lang", "text").mapInArrow(run, schema)


def has_letter(col: str = "text") -> Column:
    return F.coalesce(F.col(col).rlike(r"\p{L}"), F.lit(False))


def fit(docs: DataFrame, allowed: Column | None = None, per_lang: int = TRAIN_TEXTS) -> Tables | None:
    """A network from docs (doc_id, text, lang); the driver sees some TRAIN_WINDOWS * per_lang windows of each language."""
    rows = stage(training_windows(docs, F.lit(True) if allowed is None else allowed, per_lang)).orderBy("lang", "window").collect()
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    x = np.stack([np.frombuffer(r["window"], np.uint8) for r in rows])
    y = np.array([langs.index(r["lang"]) for r in rows])
    return train(x, y, langs).tables()


def predict(texts: DataFrame, model: Tables | None) -> DataFrame:
    """``texts`` (some columns and ``text``) without the text, with lang_pred and score."""
    texts = texts.drop("lang_pred", "score", "_letter")
    held = texts.sparkSession.sparkContext.broadcast(model)
    rows = texts.withColumn("_letter", has_letter())
    rest = [f for f in texts.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for b in batches:
            best, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            if net is not None:
                letter = b.column("_letter").to_pylist()
                for at, ws, sizes in _dealt(b.column("text").to_pylist(), letter):
                    p = net.probabilities(ws) * sizes[:, None]
                    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                    mean = np.add.reduceat(p, starts) / np.add.reduceat(sizes, starts)[:, None]
                    for i, row in zip(at[starts], mean):
                        k = int(row.argmax())
                        best[i], score[i] = net.langs[k], min(1.0, float(row[k]))
            cols = [*(b.column(f.name) for f in rest), pa.array(best, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*(f.name for f in rest), "lang_pred", "score"])

    extra = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*rest, *extra]))


def _dealt(texts: list[str | None], letter: list[bool]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows' places, windows and bytes per window, in portions of some thousand windows; a text is never split."""
    at, held, sizes, n = [], [], [], 0
    for i, (text, ok) in enumerate(zip(texts, letter)):
        if not ok or text is None:
            continue
        ws = windows(text)
        full = np.full(len(ws), WINDOW, np.float64)
        full[-1] = (len(text.encode("utf-8", "replace")) - 1) % WINDOW + 1
        at.append(np.full(len(ws), i))
        held.append(ws)
        sizes.append(full)
        n += len(ws)
        if n >= 4096:
            yield np.concatenate(at), np.concatenate(held), np.concatenate(sizes)
            at, held, sizes, n = [], [], [], 0
    if n:
        yield np.concatenate(at), np.concatenate(held), np.concatenate(sizes)
