"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's features are the byte n-grams of its words, word ends included, hashed
into a fixed number of buckets. Their embeddings are averaged and a linear layer
with softmax gives the languages. Stochastic gradient descent in numpy on the
driver fits both on a bounded sample of labelled rows; tasks turn the sample's
texts into counts first, so no text comes to the driver. Embeddings times layer
is one small table, which is all that a prediction needs: it averages the
table's rows over the n-grams of the whole text.

A part of the sample, not fitted on, calibrates: a temperature makes the score a
probability, and the rejection bound is the score that all but a set share of
the correctly told texts reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweld.llm.common import free_name

UNKNOWN = "und"
SIZES = (2, 3, 4)
#: An n-gram has a share of some thousandths of its text, so embeddings move by longer steps than the layer.
EMBED_STEP = 50.0
#: Bytes of text that are turned into n-grams at once.
CHUNK = 1 << 19

_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(range(97, 123)) + list(range(128, 256))] = True


@dataclass(frozen=True)
class Model:
    """labels, a row of logits for each bucket, bias, temperature and the least score that isn't rejected."""

    labels: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float


def ngrams(raw: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram and the place where it starts. raw is lower-cased UTF-8; other bytes than letters end words."""
    b = np.frombuffer(raw, np.uint8)
    inside = _IN_WORD[b]
    codes = np.where(inside, b, 32).astype(np.uint32)
    found, places = [], []
    for n in SIZES:
        if len(b) < n:
            break
        m = len(b) - n + 1
        with np.errstate(over="ignore"):
            h = np.full(m, n * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
            for k in range(n):
                h = (h ^ codes[k : k + m]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(13)
        valid = inside[1 : 1 + m] if n == 2 else np.logical_and.reduce([inside[k : k + m] for k in range(1, n - 1)])
        if n == 2:
            valid = valid | inside[:m]
        at = np.flatnonzero(valid)
        found.append((h[at] % np.uint32(buckets)).astype(np.int32))
        places.append(at)
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(places)


def lowered(text: str) -> bytes:
    return (" " + text.lower() + " ").encode("utf-8", "replace")


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def sgd(counts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_labels: int, buckets: int, dim: int, epochs: int, rate: float, seed: int, batch: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Logits a bucket and the bias. counts holds each text's buckets and shares, which add up to 1."""
    rng = np.random.default_rng(seed)
    embed = rng.uniform(-1, 1, (buckets, dim)).astype(np.float32) / dim
    layer, bias = np.zeros((dim, n_labels), np.float32), np.zeros(n_labels, np.float32)
    steps, done = max(1, epochs * -(-len(y) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), batch):
            rows = order[start : start + batch]
            used, where = np.unique(np.concatenate([counts[i][0] for i in rows]), return_inverse=True)
            x = np.zeros((len(rows), len(used)), np.float32)
            x[np.repeat(np.arange(len(rows)), [len(counts[i][0]) for i in rows]), where] = np.concatenate([counts[i][1] for i in rows])
            hidden = x @ embed[used]
            grad = _softmax(hidden @ layer + bias)
            grad[np.arange(len(rows)), y[rows]] -= 1
            step = rate * (1 - done / steps)
            back = grad @ layer.T
            layer -= step * (hidden.T @ grad)
            bias -= 0.1 * step * grad.mean(axis=0)
            embed[used] -= EMBED_STEP * step * (x.T @ back)
            done += 1
    return embed @ layer, bias


#: Rows of each label that are learnt from, however many labels there are.
LEAST_ROWS = 8


def train(docs: DataFrame, usable: Column, text: str = "text", label: str = "lang", key: str = "doc_id", per_label: int = 800, most_labels: int = 4096, most_rows: int = 4096, buckets: int = 1 << 14, dim: int = 16, epochs: int = 12, rate: float = 0.5, refuse: float = 0.001, seed: int = 5) -> Model:
    """Fit on about per_label rows of each label, and most_rows of them all but LEAST_ROWS of each, among the usable rows.

    Every label is learnt; as the model takes 4 bytes a bucket and label, more than most_labels (256 MB) are an error.
    The sample has about most_rows rows at most, or LEAST_ROWS a label, each of no more than 6 bytes a bucket (400 MB if all texts fill
    all buckets; some 6 KB a row is usual); they are chosen by a
    hash of the key, of whatever type, so reruns choose alike. Rows with a null label or key, or a text without letters, are not
    learnt from. Without any such row the model knows no label and predicts
    UNKNOWN throughout. refuse is the share of correctly told texts
    that the rejection bound may cost.
    """
    rows = docs.where(usable & F.col(label).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.xxhash64(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(text).alias("text")
    )
    sizes = rows.groupBy("label").count().limit(most_labels + 1).collect()
    if len(sizes) > most_labels:
        raise ValueError(f"more than {most_labels} labels: a model of them all may not fit into memory")
    labels = tuple(sorted(r["label"] for r in sizes))
    if not labels:
        return Model((), np.zeros((buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    of_each = min(per_label, max(LEAST_ROWS, most_rows // len(labels)))
    shares = docs.sparkSession.createDataFrame([(r["label"], min(1.0, of_each / r["count"])) for r in sizes], "label string, share double")
    draw = F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(1 << 30)) / (1 << 30)
    sample = rows.join(F.broadcast(shares), "label").where(draw < F.col("share")).select("key", "label", "text")  # most_labels rows

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, name, t in zip(pdf["key"], pdf["label"], pdf["text"], strict=True):
                found, n = np.unique(ngrams(lowered(t), buckets)[0], return_counts=True)
                if has_letter(t) and len(found):
                    out.append((k, name, found.astype("<u2").tobytes(), (n / n.sum()).astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["key", "label", "buckets", "shares"])

    found = sample.mapInPandas(count, "key long, label string, buckets binary, shares binary").toPandas()
    found = found.sort_values(["key", "label", "buckets"], ignore_index=True)
    counts = [(np.frombuffer(a, "<u2").astype(np.int32), np.frombuffer(b, "<f4")) for a, b in zip(found["buckets"], found["shares"], strict=True)]
    y = found["label"].map({k: i for i, k in enumerate(labels)}).to_numpy(np.int64)
    aside = np.random.default_rng(seed).random(len(y)) < 0.2 if len(y) >= 50 else np.zeros(len(y), bool)
    fit = np.flatnonzero(~aside)
    table, bias = sgd([counts[i] for i in fit], y[fit], len(labels), buckets, dim, epochs, rate, seed)
    held = np.flatnonzero(aside) if aside.any() else fit
    logits = np.array([counts[i][1] @ table[counts[i][0]] for i in held]).reshape(-1, len(labels)) + bias
    temperature, threshold = calibrate(logits, y[held], refuse)
    return Model(labels, table.astype(np.float32), bias, temperature, threshold)


def calibrate(logits: np.ndarray, y: np.ndarray, refuse: float) -> tuple[float, float]:
    """The temperature of the least log loss on a grid, and the score that all but `refuse` of the right answers reach."""
    if not len(y):
        return 1.0, 0.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean())

    temperature = min(np.geomspace(0.2, 5, 40).tolist(), key=loss)
    scores = _softmax(logits / temperature)
    right = scores[scores.argmax(axis=1) == y].max(axis=1, initial=0.0)
    return temperature, float(np.quantile(right, refuse, method="lower")) if len(right) else 0.0


def classify(model: Model, texts: list[str | None]) -> pd.DataFrame:
    """lang and score of whole texts; UNKNOWN and 0 for a null text or one without a letter."""
    lang = np.full(len(texts), UNKNOWN, object)
    score = np.zeros(len(texts))
    use = [i for i, t in enumerate(texts) if model.labels and has_letter(t)]
    sums, sizes = np.zeros((len(use), len(model.labels))), np.zeros(len(use))
    chunk = max(1 << 14, min(CHUNK, (1 << 23) // max(1, len(model.labels))))
    group: list[int] = []
    raws: list[bytes] = []

    def flush() -> None:
        if not raws:
            return
        whole = b"".join(raws)
        bounds = np.cumsum([0, *map(len, raws)])
        for start in range(0, len(whole), chunk):  # a long text goes in parts that overlap by an n-gram
            part = whole[start : start + chunk + max(SIZES) - 1]
            found, at = ngrams(part, len(model.table))
            own = at < chunk
            of = np.searchsorted(bounds, at[own] + start, side="right") - 1
            for c in range(len(model.labels)):
                sums[group, c] += np.bincount(of, model.table[found[own], c], len(group))
            sizes[group] += np.bincount(of, minlength=len(group))
        group.clear()
        raws.clear()

    size = 0
    for j, i in enumerate(use):
        raws.append(lowered(texts[i]))
        group.append(j)
        size += len(raws[-1])
        if size >= chunk:
            flush()
            size = 0
    flush()
    if use:
        p = _softmax((sums / np.maximum(sizes, 1)[:, None] + model.bias) / model.temperature)
        best = p.argmax(axis=1)
        lang[use], score[use] = np.array(model.labels, object)[best], p[np.arange(len(use)), best]
    return pd.DataFrame({"lang": lang, "score": score})


def predicted(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language, its probability and `rejected`: UNKNOWN, or below the model's threshold.

    Columns of docs under these names are replaced. Only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def tell(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield classify(shared.value, texts.tolist())

    told = free_name(docs, "told")
    rejected = (F.col(lang) == UNKNOWN) | (F.col(score) < model.threshold)
    old = [c for c in docs.columns if c.lower() not in {lang, score, "rejected"}]
    return (
        docs.withColumn(told, tell(F.col(text)))
        .select(*old, F.col(told)["lang"].alias(lang), F.col(told)["score"].alias(score))
        .withColumn("rejected", rejected)
    )


def not_held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string")) % 3 != 1


def keep_told(docs: DataFrame, **params) -> DataFrame:
    """The rows whose language is told with confidence, with the columns of docs. The model learns from docs.

    Where docs has no row to learn from, nothing can be told and all rows stay. A null text, or one
    without letters, goes otherwise; rows that repeat share their fate.
    """
    row = F.struct(*docs.columns)
    model = train(docs, not_held_out(), **params)
    if not model.labels:
        return docs
    one = docs.select(row.alias("row"), "text")
    return predicted(one, model).where(~F.col("rejected")).select("row.*")
