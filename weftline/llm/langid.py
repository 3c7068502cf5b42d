"""Operator 1: language ID from averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its letter n-grams (n = 1 to 4, inside words, with word edges), hashed to
a fixed number of buckets; a linear softmax over that average gives the languages.  The model is trained by
mini-batch SGD in numpy on a bounded sample of labelled rows.  As the output layer is linear, embeddings and output
layer fold into one table of a score per bucket and language, so scoring is a gather and a mean.  Confidences are
calibrated by a temperature.  A text is rejected if its confidence, or the share of its trigrams that the training
texts have, falls below what calibration texts of the known languages reach: the second tells languages that were never
learnt and strings of letters from short texts of a known one, whatever the softmax says of them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, fresh, id_split, table

UNKNOWN = "und"
BUCKETS, WIDTH, ORDERS = 1 << 16, 16, (1, 2, 3, 4)
#: Bound of the training sample: rows a language; every language is learnt.
ROWS_A_LANGUAGE = 300
#: Slots for trigrams seen in training; a text whose share of seen ones is below LEAST_SEEN and at least FAR deviations
#: below that of known texts is rejected (odd words and repetitions in a known language stay above the first).
SEEN, FAR, LEAST_SEEN = 1 << 20, 6.0, 0.6
EPOCHS, BATCH, RATE = 6, 64, 40.0
#: Share of calibration texts of known languages that rejection may lose, and the confidence below which a text is
#: rejected at most (a text of confidence above this is never rejected).
REJECT_SHARE, REJECT_MOST = 0.0005, 0.4
FOLD_MOD = 5

_letters: np.ndarray | None = None


def letter_table() -> np.ndarray:
    """Code point to lower-cased letter, 0 for anything else, over the basic plane."""
    global _letters
    if _letters is None:
        t = np.zeros(0x10000, dtype=np.uint32)
        for c in range(0x41, 0x10000):
            ch = chr(c)
            if unicodedata.category(ch)[0] == "L":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _letters = t
    return _letters


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letter codes of all texts one after the other, each text closed by a 0, and where each ends."""
    joined = "\0".join([t or "" for t in texts]) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    t = letter_table()
    if len(codes) and codes.max() < 0x10000:
        return t[codes], ends
    out = np.where(codes < 0x10000, t[np.minimum(codes, 0xFFFF)], 0).astype(np.uint32)
    for c in np.unique(codes[codes >= 0x10000]).tolist():
        if unicodedata.category(chr(c))[0] == "L":
            out[codes == c] = ord(chr(c).lower()[:1])
    return out, ends


def grams(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each order, where its n-grams start and their hashes.  Runs of non-letters are word edges; an n-gram
    may begin or end with an edge, but never crosses one."""
    letter = codes > 0
    mix = np.uint32(0x9E3779B1)
    for n in ORDERS:
        if len(codes) < n:
            return
        m = len(codes) - n + 1
        h = np.full(m, n, dtype=np.uint32)
        inside = np.ones(m, dtype=bool)
        for i in range(n):
            h = (h ^ codes[i : i + m]) * mix
            h ^= h >> np.uint32(15)
            if n == 1 or 0 < i < n - 1:
                inside &= letter[i : i + m]
        if n == 2:
            inside = letter[:m] | letter[1:]
        at = np.flatnonzero(inside)
        yield n, at, h[at]


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # a row a bucket: embedding times output layer
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    seen: np.ndarray | None = None  # trigrams of the training texts, by hash
    usual: float = 1.0  # share of a known text's trigrams that are seen, its deviation over texts, and the limit
    spread: float = 0.0
    limit: float = np.inf

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logits a text, whether it has a letter, its number of trigrams, and how many of them are seen."""
        codes, ends = letters(texts)
        starts = np.concatenate([[0], ends[:-1]])
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        three, known = np.zeros(len(texts)), np.zeros(len(texts))
        for n, at, h in grams(codes):
            low = np.searchsorted(at, starts)
            high = np.searchsorted(at, ends)
            count += high - low
            full = np.flatnonzero(high > low)
            if len(full):
                total[full] += np.add.reduceat(self.scores[(h & np.uint32(len(self.scores) - 1)).astype(np.int64)], low[full], axis=0)
                if n == 3 and self.seen is not None:
                    three += high - low
                    known[full] += np.add.reduceat(self.seen[(h & np.uint32(SEEN - 1)).astype(np.int64)].astype(np.int32), low[full])
        has = np.add.reduceat((codes > 0).astype(np.int64), starts) > 0 if len(texts) else np.zeros(0, bool)
        return total / np.maximum(count, 1)[:, None] + self.bias, has, three, known

    def away(self, three: np.ndarray, known: np.ndarray) -> np.ndarray:
        """How far, in deviations, the share of seen trigrams lies below that of known texts of the same length."""
        n = np.maximum(three, 1)
        return np.where(three > 0, (self.usual - known / n) / (np.sqrt(self.usual * (1 - self.usual) / n) + self.spread + 1e-3), 0.0)

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: no letter), its calibrated probability, and whether the text is rejected; of
        languages of equal probability the first by name."""
        z, has, three, known = self.logits(texts)
        p = softmax(z / self.temperature)
        best = p.argmax(axis=1)
        top = p[np.arange(len(p)), best]
        return np.where(has, best, -1), np.where(has, top, 0.0), ~has | (top < self.threshold) | ((self.away(three, known) > self.limit) & (known < LEAST_SEEN * three))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sparse(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, weight) of the averages, in row order; a bounded number of letters at a time."""
    parts = []
    for a, b in chunks([len(t or "") for t in texts], 1 << 19):
        codes, ends = letters(texts[a:b])
        key = np.concatenate([np.searchsorted(ends, at, side="right") * BUCKETS + g for _, at, g in ((n, at, (h & np.uint32(BUCKETS - 1)).astype(np.int64)) for n, at, h in grams(codes))])
        key, n = np.unique(key, return_counts=True)
        row = key // BUCKETS
        total = np.bincount(row, weights=n, minlength=b - a)
        parts.append(((row + a).astype(np.int32), (key % BUCKETS).astype(np.int32), (n / total[row]).astype(np.float32)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _pieces(texts: list[str], rng: np.random.Generator) -> list[str]:
    """A short stretch of words from each text, so that short texts are learnt as well."""
    out = []
    for t in texts:
        w = t.split()
        n = int(rng.integers(2, 12))
        at = int(rng.integers(0, max(1, len(w) - n + 1)))
        out.append(" ".join(w[at : at + n]))
    return out


def train(texts: list[str], langs: list[str], seed: int = 17) -> Model:
    """Fit on labelled texts; a fifth of them calibrates the temperature and the rejection threshold."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    order = rng.permutation(len(texts))
    cut = len(texts) - len(texts) // 5
    fit, hold = order[:cut], order[cut:]
    whole = [texts[i] for i in fit]
    samples = whole + _pieces(whole, rng) + _pieces(whole, rng)
    row, bucket, weight = _sparse(samples)
    target = np.tile(y[fit], 3)
    first = np.searchsorted(row, np.arange(len(samples) + 1))
    share = np.bincount(y[fit], minlength=len(names)) + 1.0
    bias = np.zeros(len(names))
    e = np.zeros((BUCKETS, WIDTH))
    out = rng.normal(0, 1 / np.sqrt(WIDTH), (WIDTH, len(names)))
    balance = (1 / share) / (1 / share).mean()
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for part in np.array_split(rng.permutation(len(samples)), max(1, len(samples) // BATCH)):
            spans = [np.arange(first[i], first[i + 1]) for i in part]
            at = np.concatenate(spans) if spans else np.empty(0, np.int64)
            mine = np.repeat(np.arange(len(part)), [len(s) for s in spans])
            hidden = np.zeros((len(part), WIDTH))
            np.add.at(hidden, mine, e[bucket[at]] * weight[at, None])
            p = softmax(hidden @ out + bias)
            g = p
            g[np.arange(len(part)), target[part]] -= 1
            g *= balance[target[part]][:, None] / len(part)
            back = g @ out.T
            out -= 0.05 * rate * (hidden.T @ g)
            np.add.at(e, bucket[at], -rate * weight[at, None] * back[mine])
    seen = np.zeros(SEEN, dtype=bool)
    for a, b in chunks([len(t) for t in whole], 1 << 19):
        for n, _, h in grams(letters(whole[a:b])[0]):
            if n == 3:
                seen[(h & np.uint32(SEEN - 1)).astype(np.int64)] = True
    model = Model(names, (e @ out).astype(np.float32), bias, seen=seen)
    if len(hold):
        calibrate(model, [texts[i] for i in hold], y[hold], rng)
    return model


def calibrate(model: Model, texts: list[str], y: np.ndarray, rng: np.random.Generator) -> None:
    """Temperature by likelihood over whole texts and short stretches of them; then the two limits of rejection, so
    that all but ``REJECT_SHARE`` of these texts pass: the confidence (``REJECT_MOST`` at most) and the distance of the
    share of seen trigrams (``FAR`` at least)."""
    samples = texts + _pieces(texts, rng)
    y = np.tile(y, 2)
    z, has, three, known = model.logits(samples)
    z, y, three, known = z[has], y[has], three[has], known[has]
    if not len(z):
        return
    grid = np.geomspace(0.02, 5, 60)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    top = softmax(z / model.temperature).max(axis=1)
    model.threshold = float(min(REJECT_MOST, np.quantile(top, REJECT_SHARE)))
    some = three > 0
    if some.any():
        share = known[some] / three[some]
        model.usual, model.spread = float(share.mean()), float(share[three[some] >= np.median(three[some])].std())
        model.limit = float(max(FAR, 1.25 * np.quantile(model.away(three, known), 1 - REJECT_SHARE)))


def labelled_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column) -> tuple[list[str], list[str]]:
    """At most ``ROWS_A_LANGUAGE`` (in expectation, half as many again at most) labelled rows of each
    language, chosen by a hash of the text: one aggregate and one scan, no shuffle of texts, so a hot language costs
    no more than another."""
    rows = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = rows.groupBy(lang_col).count().collect()
    if not counts:
        return [], []
    share = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(min(1.0, ROWS_A_LANGUAGE / n)))])
    u = F.pmod(F.xxhash64(F.lit("fit"), F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    got = rows.where(u < share[F.col(lang_col)]).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    part = got.limit(ROWS_A_LANGUAGE * len(counts) * 3 // 2).toArrow()
    return part.column("t").to_pylist(), part.column("l").to_pylist()


def fit_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", usable: Column | None = None) -> Model | None:
    """The model for ``docs``, or None where no row has both a text and a language."""
    texts, langs = labelled_sample(docs, id_col, text_col, lang_col, F.lit(True) if usable is None else usable)
    return train(texts, langs) if texts else None


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", rejected_name: str = "rejected") -> DataFrame:
    """``docs`` with the predicted language, its probability and whether it is rejected.

    The whole text is read.  Texts that are null or have no letter get ``und``, score 0, and are rejected; so are all
    if there is no model.  Columns of the new names are replaced; others are kept as they are, whatever their names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kind = "struct<lang:string,score:double,rejected:boolean>"

    @F.pandas_udf(kind)
    def guess(text):  # noqa: ANN001, ANN202
        import pandas as pd

        model, texts = shared.value, [t if isinstance(t, str) else None for t in text]
        if model is None or not texts:
            return pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "rejected": [True] * len(texts)})
        parts = [model.predict(texts[a:b]) for a, b in chunks([len(t or "") for t in texts], 1 << 18)]
        best, score, rejected = (np.concatenate(x) for x in zip(*parts))
        names = np.array([*model.languages, UNKNOWN], dtype=object)
        return pd.DataFrame({"lang": names[best], "score": score, "rejected": rejected})

    (guessed,) = fresh(docs, "guess")
    out = docs.withColumn(guessed, guess(F.col(text_col).cast("string")))
    new = {lang_name: "lang", score_name: "score", rejected_name: "rejected"}
    return out.select(*[docs[c] for c in docs.columns if c not in new], *[out[guessed][field].alias(name) for name, field in new.items()])


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is recognised; the model learns from all labelled rows' sample.  Columns stay.

    Null texts and those without a letter go, rows that repeat go or stay alike, very long texts are read whole, and an
    empty table gives no rows.  Where no row has both a text and a language nothing is known, and all rows stay."""
    model = fit_languages(docs, id_col, text_col, lang_col)
    if model is None:
        return docs
    lang, score, rejected = fresh(docs, "lang", "score", "rejected")
    return identify(docs, model, text_col, lang, score, rejected).where(~F.col(rejected)).drop(lang, score, rejected)


def op1_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = id_split("doc_id", FOLD_MOD) == 0
    model = fit_languages(docs, usable=~held)
    out = identify(docs.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")
