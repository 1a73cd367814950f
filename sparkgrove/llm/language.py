"""Language ID: multinomial naive Bayes over hashed character n-grams.

Trained on a bounded sample of labelled rows; the log-probability matrix (buckets x languages, at most CELLS
numbers: with many languages the buckets are fewer) is broadcast with the languages' priors, and whole
texts are scored in batches as a sparse product: each n-gram's bucket selects a matrix row, rows are
summed per document.

Cases: a null text or one without a letter gives `und` with score 0; a short text is scored by what
n-grams it has; without any labelled row every document is `und`; ties go to the language first in
order; all columns but the text stay in Spark, so rows pass through one by one, repeated or with null ids; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Bound of the matrix; the sample bounds the languages, to TRAIN_ROWS or so.
CELLS = 1 << 23
#: Bound of the training sample, in rows; which rows is decided by a hash of the id.
TRAIN_ROWS = 20_000
_SLICE = 400_000
_SMOOTH = 0.5


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def codepoints(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lower-cased texts, each between blanks, and where each text begins."""
    blob = [f" {t.lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
    starts = np.cumsum([0, *[len(b) // 4 for b in blob]])
    return np.frombuffer(b"".join(blob), np.uint32), starts


def buckets(cp: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram at each position (the last order-1 positions have none)."""
    n = len(cp) - order + 1
    h = np.full(max(n, 0), order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h ^= cp[k : k + n] if n > 0 else h
        h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    return (h >> np.uint32(17)).astype(np.int64)


def slices(texts: list[str]):
    """Runs of texts of about _SLICE characters: bounds memory whatever the batch."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 2
        if size >= _SLICE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


class Model:
    """Languages in order, log probabilities (buckets x languages, float32), log priors; a bucket of BUCKETS
    is row bucket >> shift."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, shift: int) -> None:
        self.langs, self.shift = langs, shift
        counts = counts + _SMOOTH
        self.matrix = np.log(counts / counts.sum(axis=0)).astype(np.float32)
        self.prior = np.log(docs / docs.sum()) if len(docs) else np.zeros(0)


def train(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fitted on labelled rows outside the held-out fold."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = d.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 2))
    n = labelled.select("lang").count()
    share = min(1.0, rows / max(n, 1))
    draw = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30))
    sample = labelled.filter(draw < int(share * (1 << 30))) if share < 1 else labelled
    per = {r.lang: r["n"] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()} if n else {}  # as many rows as the sample at most
    langs = sorted(per)
    shift = max(0, (BUCKETS * len(langs) - 1).bit_length() - CELLS.bit_length() + 1)

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            texts, langs = pdf["text"].tolist(), pdf["lang"].to_numpy()
            for lang in set(langs):
                mine = [t for t, l in zip(texts, langs) if l == lang]
                acc = total.setdefault(lang, np.zeros(BUCKETS >> shift, np.int64))
                for a, b in slices(mine):
                    cp, starts = codepoints(mine[a:b])
                    for k in ORDERS:
                        inside = np.ones(len(cp), bool)  # n-grams that cross into the next text don't count
                        for back in range(1, k):
                            inside[np.maximum(starts[1:] - back, 0)] = False
                        h = buckets(cp, k)
                        acc += np.bincount(h[inside[: len(h)]] >> shift, minlength=len(acc))
        for lang, acc in total.items():
            hit = np.flatnonzero(acc)
            yield pd.DataFrame({"lang": lang, "bucket": hit.astype("int32"), "n": acc[hit]})

    counts = np.zeros((BUCKETS >> shift, len(langs)))
    if langs:
        sums = sample.select("lang", "text").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        got = sums.toPandas()  # at most CELLS rows
        counts[got["bucket"].to_numpy(), np.searchsorted(langs, got["lang"].to_numpy().astype(str))] = got["n"].to_numpy()
    return Model(langs, counts, np.array([per[l] for l in langs], float), shift)


def log_likelihoods(texts: list[str], model: Model) -> np.ndarray:
    """Log prior and sum of log probabilities, one row a text, one column a language."""
    out = np.tile(model.prior, (len(texts), 1))
    columns = np.ascontiguousarray(model.matrix.T)
    for a, b in slices(texts):
        cp, starts = codepoints(texts[a:b])
        for order in ORDERS:
            h = buckets(cp, order) >> model.shift
            for lang in range(len(columns)):
                sums = np.concatenate(([0.0], np.cumsum(columns[lang][h], dtype=np.float64)))
                ends = np.minimum(starts[1:], len(h))
                ends = np.maximum(np.minimum(starts[1:] - order + 1, ends), np.minimum(starts[:-1], len(h)))
                out[a:b, lang] += sums[ends] - sums[np.minimum(starts[:-1], len(h))]
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """struct(lang_pred, score: the posterior of the prediction) of a row of docs; a map, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts, worded in batches:
            ok = np.flatnonzero(worded.to_numpy(bool)) if m.langs else np.empty(0, np.int64)
            pred, conf = np.full(len(texts), "und", object), np.zeros(len(texts))
            if len(ok):
                ll = log_likelihoods([texts.iloc[i] for i in ok], m)
                best = ll.argmax(axis=1)
                pred[ok] = np.array(m.langs, object)[best]
                conf[ok] = 1.0 / np.exp(ll - ll[np.arange(len(ok)), best][:, None]).sum(axis=1)
            yield pd.DataFrame({"lang_pred": pred, "score": conf})

    text = F.col(text_col).cast("string")
    return score(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def language_id(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    model = train(docs, text_col, id_col, lang_col, train_rows)
    out = docs.select(F.col(id_col).alias("doc_id"), identify(docs, model, text_col).alias("p"))
    return out.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs to which language_id gives a language, with all their columns. Its score decides nothing:
    a posterior over all n-grams is near 1 for any long text, and low only for short ones."""
    model = train(docs, text_col, id_col, lang_col, train_rows)
    scored = docs.select(F.struct(*docs.columns).alias("row"), identify(docs, model, text_col).alias("p"))
    return scored.filter(F.col("p.lang_pred") != "und").select("row.*")
