"""Language identification with a byte convolutional network, trained here in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import TEXT_BYTES, release, table, with_new

WIDTHS, FILTERS, DIM, WINDOW = (2, 3, 4), 16, 8, 256
TAPS = max(WIDTHS)
#: A window shares its last bytes with the next, so that every position of a text begins one convolution.
STEP = WINDOW - TAPS + 1
UND = "und"
_is_letter = np.array([chr(b).isalpha() or b >= 0xC3 for b in range(256)])


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's category L stands in the text (superscripts and fractions are none)."""
    return any(map(str.isalpha, text))


@dataclass
class Network:
    """langs; byte vectors (256, DIM); kernels (TAPS, DIM, filters) with zeros past a filter's width; biases; softmax layer."""

    langs: list[str]
    vectors: np.ndarray
    kernels: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What each pair of bytes adds to all filters as first two, and as last two bytes: the convolution by look-up."""
        taps = np.einsum("bd,kdf->kbf", self.vectors, self.kernels).astype(np.float32)
        first = taps[0][:, None, :] + taps[1][None, :, :] + self.bias.astype(np.float32)
        return first.reshape(65536, -1), (taps[2][:, None, :] + taps[3][None, :, :]).reshape(65536, -1)


def text_windows(text: str) -> np.ndarray:
    """The whole text's UTF-8 bytes (lower case) in windows of WINDOW bytes, each STEP after the last, padded by 0."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-max(0, len(raw) - TAPS + 1) // STEP))
    padded = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STEP]


def train(texts: list[str], langs: list[str], *, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """A network fitted by Adam to all windows of each text. The same input gives the same network."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    xs, ys = [], []
    for text, lang in zip(texts, langs):
        own = text_windows(text)
        xs.append(own)
        ys += [names.index(lang)] * len(own)
    x, y = np.concatenate(xs), np.array(ys)
    width = np.repeat(WIDTHS, FILTERS)
    mask = (np.arange(TAPS)[:, None] < width[None, :])[:, None, :].astype(np.float32)
    n = len(width)
    p = {
        "vectors": rng.normal(0, 0.5, (256, DIM)), "kernels": rng.normal(0, 0.25, (TAPS, DIM, n)) * mask, "bias": np.zeros(n),
        "out": rng.normal(0, 0.1, (n, len(names))), "out_bias": np.zeros(len(names)),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            rows = x[order[at : at + batch]]
            target = y[order[at : at + batch]]
            b = len(rows)
            emb = p["vectors"][rows]
            cols = np.concatenate([emb[:, k : k + STEP] for k in range(TAPS)], axis=2).reshape(b * STEP, TAPS * DIM)
            z = (cols @ p["kernels"].reshape(TAPS * DIM, n)).reshape(b, STEP, n)
            best = z.argmax(axis=1)
            pooled = np.take_along_axis(z, best[:, None, :], 1)[:, 0] + p["bias"]
            h = np.maximum(pooled, 0)
            scores = h @ p["out"] + p["out_bias"]
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            d = scores / scores.sum(axis=1, keepdims=True)
            d[np.arange(b), target] -= 1
            d /= b
            dz = (d @ p["out"].T) * (pooled > 0)
            grad = {"out": h.T @ d, "out_bias": d.sum(axis=0), "bias": dz.sum(axis=0), "kernels": np.zeros_like(p["kernels"]), "vectors": np.zeros_like(p["vectors"])}
            for k in range(TAPS):
                symbols = np.take_along_axis(rows, best + k, 1)
                grad["kernels"][k] = np.einsum("bf,bfd->df", dz, p["vectors"][symbols])
                np.add.at(grad["vectors"], symbols.ravel(), (dz[:, :, None] * p["kernels"][k].T[None]).reshape(-1, DIM))
            grad["kernels"] *= mask
            step += 1
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Network(names, **p)


def predict(net: Network, tables: tuple[np.ndarray, np.ndarray], texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text: the mean over all its windows, by their letters, of the softmax outputs."""
    kinds, scores = [UND] * len(texts), np.zeros(len(texts))
    held, owners = [], []
    for i, text in enumerate(texts):
        if text and net.langs and has_letter(text):
            own = text_windows(text)
            held.append(own)
            owners.append(np.full(len(own), i))
    if not held:
        return kinds, scores
    x, owner = np.concatenate(held), np.concatenate(owners)
    first, last = tables
    pooled = np.empty((len(x), first.shape[1]), np.float32)
    for at in range(0, len(x), 32):
        part = x[at : at + 32].astype(np.uint16)
        pairs = (part[:, :-1] << 8) | part[:, 1:]
        z = first.take(pairs[:, :STEP], axis=0)
        z += last.take(pairs[:, 2 : 2 + STEP], axis=0)
        z.max(axis=1, out=pooled[at : at + 32])
    out = np.maximum(pooled, 0) @ net.out + net.out_bias
    out = np.exp(out - out.max(axis=1, keepdims=True)).astype(np.float64)
    out /= out.sum(axis=1, keepdims=True)
    weight = _is_letter[x].sum(axis=1) + 1e-3
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    mean = np.add.reduceat(out * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
    for i, row in zip(owner[starts], mean):
        k = int(row.argmax())
        kinds[i], scores[i] = net.langs[k], min(1.0, max(0.0, float(row[k])))
    return kinds, scores


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves 2 on division by 4 (null id: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, per_lang: int, langs: int, chars: int) -> tuple[list[str], list[str]]:
    """Whole texts and their langs to learn from, of the `langs` most frequent ones (ties: the first names).

    A lang gives at most per_lang documents, and of them no more than have chars characters together, one at least: those
    of the smallest hashes of doc_id and text among its rows with text that are not held out; repeated rows are one. First
    the langs are counted (distinct hashes, so that a few texts repeated very often don't raise the threshold's base), then
    lengths alone are ranked below a hash threshold, then the texts chosen come to the driver: langs * chars characters
    at most, but for a document that alone is longer.
    """
    known = docs.where("lang is not null and length(text) > 0").where(~held_out())
    u = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id"), F.col("text")), F.lit(1 << 30))
    # repeated rows share a hash, so it is hashes that are counted (to some 2 percent) and ranked
    counts = {r[0]: r[1] for r in known.groupBy("lang").agg(F.approx_count_distinct(u, 0.02).alias("n")).orderBy(F.desc("n"), "lang").limit(langs).collect()}
    if not counts:
        return [], []
    bounds = docs.sparkSession.createDataFrame([(k, int(min(1.0, 1.5 * per_lang / n) * (1 << 30))) for k, n in counts.items()], "l string, bound long")
    rows = known.select("lang", "doc_id", "text", u.alias("u")).join(F.broadcast(bounds), F.col("lang") == F.col("l")).where("u < bound").drop("l", "bound")
    order = Window.partitionBy("lang").orderBy("u")
    ranked = rows.groupBy("lang", "u").agg(F.max(F.length("text")).alias("n")).withColumns({"k": F.row_number().over(order), "held": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    last = ranked.where((F.col("k") == 1) | ((F.col("k") <= per_lang) & (F.col("held") <= chars))).groupBy("lang").agg(F.max("u").alias("last"))
    chosen = rows.join(F.broadcast(last.withColumnRenamed("lang", "l")), (F.col("lang") == F.col("l")) & (F.col("u") <= F.col("last"))).dropDuplicates(["lang", "u"])
    found = sorted((r["lang"], r["u"], r["text"]) for r in chosen.select("lang", "u", "text").collect() if has_letter(r["text"]))
    return [t for _, _, t in found], [k for k, _, _ in found]


def fit_language_id(docs: DataFrame, *, per_lang: int = 400, langs: int = 100, chars: int = 500_000, **how) -> Network:
    """A network learnt from training_sample(docs); without any labelled text, one that knows no language. Rows of a lang
    beyond the `langs` most frequent teach it nothing."""
    texts, names = training_sample(docs, per_lang, langs, chars)
    if not texts:
        return Network([], *(np.zeros(s, np.float32) for s in ((256, DIM), (TAPS, DIM, 1), (1,), (1, 0), (0,))))
    return train(texts, names, **how)


def identify(docs: DataFrame, net: Network, *, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score (0 to 1), from the whole text alone.

    A null text, or one without a letter, gets `und` and 0; so does every text if the network knows no language.
    Columns of docs named like the new ones give way. Ties go to the language first by name. Repeated rows are told
    alike; an empty table gives an empty one. Texts alone go to Python.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)  # about 30 KB, by the network's shape

    @F.pandas_udf("lang string, score double")
    def told(texts: pd.Series) -> pd.DataFrame:
        own = sent.value
        tables = own.tables() if own.langs else None
        names, scores, held, size = [], [], [], 0
        for text in texts:
            held.append(text)
            size += len(text or "")
            if size >= TEXT_BYTES:
                a, b = predict(own, tables, held)
                names, scores, held, size = names + a, [*scores, *b], [], 0
        a, b = predict(own, tables, held)
        release()
        return pd.DataFrame({"lang": names + a, "score": [*scores, *b]}).astype({"score": float})

    # else a filter on the result would be pushed below it and work it out a second time
    told = told.asNondeterministic()
    return with_new(docs.withColumn("__told", told("text")), {lang: F.col("__told.lang"), score: F.col("__told.score")}).drop("__told")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null and letterless texts are `und`, as identify says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = fit_language_id(docs)
    return identify(docs.select("doc_id", "text"), net).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
