"""Operator 9: toxicity by a factorization machine over hashed terms.

A text's terms are its words and their beginnings, hashed to buckets; a bucket counts once a text.  The most frequent
buckets of the training sample are the machine's terms, whatever they say on their own; it gives each a weight and a
short vector and scores w0 + sum w_i + sum over pairs <v_i, v_j>, so two terms that matter only together are learnt.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import id_split, segment_sum, table

BUCKETS, WIDTH = 1 << 20, 4
#: Lengths of word beginnings that are terms as well.
BEGINNINGS = (4, 5)
#: Bound of the training sample (labelled rows, in expectation; twice that at most); the machine's terms are the most
#: frequent buckets of the sample, so many at most, that occur in that many of its rows.
ROWS, TERMS, LEAST_ROWS = 40_000, 1 << 16, 4
#: Passes over the sample, steps at least, rows a step, step size.
EPOCHS, STEPS, BATCH, RATE = 6, 1_200, 256, 0.1
#: Shrinkage of weights and of vectors towards zero (absolute, so that most end at zero), standard deviation of the
#: first vectors, and steps after which terms at zero are left out.
DECAY, DECAY_V, SPREAD, SETTLED = 1e-3, 1e-3, 0.02, 200
THRESHOLD, FOLD_MOD, FOLD = 0.3, 4, 2

WORD = re.compile(r"\w+")


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


class Terms:
    """Buckets of a text, optionally only kept ones (as their rank); words seen are remembered up to a bound."""

    def __init__(self, kept: dict[int, int] | None = None, most: int = 400_000) -> None:
        self.kept, self.most, self.seen = kept, most, {}

    def of_word(self, word: str) -> tuple[int, ...]:
        found = [bucket(word), *(bucket(f"{word[:n]}*") for n in BEGINNINGS if len(word) > n)]
        if self.kept is not None:
            found = [self.kept[b] for b in found if b in self.kept]
        if len(self.seen) >= self.most:
            self.seen.clear()
        self.seen[word] = out = tuple(found)
        return out

    def of(self, text: str | None) -> set[int]:
        out: set[int] = set()
        seen, fresh = self.seen, self.of_word
        for word in set(WORD.findall(text.lower())) if text else ():
            got = seen.get(word)
            if got is None:
                got = fresh(word)
            if got:
                out.update(got)
        return out


@dataclass
class Machine:
    kept: dict[int, int]
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        term, ends = flat_terms(rows)
        v = self.vectors[term]
        s = np.stack([segment_sum(v[:, f], ends) for f in range(WIDTH)], axis=1)
        return self.bias + segment_sum(self.weights[term], ends) + 0.5 * ((s * s).sum(axis=1) - segment_sum((v * v).sum(axis=1), ends))

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def flat_terms(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All rows' terms one after the other, and where each row ends."""
    return (np.concatenate(rows).astype(np.int64) if len(rows) else np.empty(0, np.int64)), np.cumsum([len(r) for r in rows], dtype=np.int64)


def _batches(rows: list[np.ndarray], parts: list[np.ndarray]) -> list[tuple]:
    """For each part its rows, their lengths, the distinct terms, and the place of every term among these."""
    out = []
    for part in parts:
        term, ends = flat_terms([rows[i] for i in part])
        hit, place = np.unique(term, return_inverse=True)
        out.append((part, np.diff(ends, prepend=0), hit.astype(np.int32), place.astype(np.uint16 if len(hit) <= 1 << 16 else np.int32)))
    return out


def _shrink(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def train(rows: list[np.ndarray], y: np.ndarray, kept: dict[int, int], seed: int = 5) -> Machine:
    """Logistic loss with absolute shrinkage by mini-batch proximal AdaGrad over (bias, weights, vectors): ``EPOCHS``
    passes, ``STEPS`` steps at least.  Terms whose weight and vector are zero when the fit has settled are left out.

    Rows without a term, no term at all and labels of one class are borne: the bias then says all there is."""
    rng = np.random.default_rng(seed)
    n = len(kept)
    w, v = np.zeros(n), rng.normal(0, SPREAD, (n, WIDTH))
    rate = (y.sum() + 1) / (len(y) + 2)
    b = float(np.log(rate / (1 - rate)))
    gw, gv, gb = np.full(n, 1e-2), np.full((n, WIDTH), 1e-2), 1e-2
    parts = np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH))
    batches, step, settled = _batches(rows, parts), 0, False
    for _ in range(max(EPOCHS, -(-STEPS // len(batches)))):
        for at in rng.permutation(len(batches)):
            part, sizes, hit, place = batches[at]
            m, k = len(part), len(hit)
            own = np.repeat(np.arange(m), sizes)
            vh, wh = v[hit], w[hit]
            s = np.stack([np.bincount(own, weights=vh[place, f], minlength=m) for f in range(WIDTH)], axis=1)
            q = np.bincount(own, weights=(vh * vh).sum(axis=1)[place], minlength=m)
            z = b + np.bincount(own, weights=wh[place], minlength=m) + 0.5 * ((s * s).sum(axis=1) - q)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / max(1, m)
            gp = g[own]
            dw = np.bincount(place, weights=gp, minlength=k)
            dv = np.stack([np.bincount(place, weights=gp * s[own, f], minlength=k) for f in range(WIDTH)], axis=1) - dw[:, None] * vh
            gw[hit] += dw * dw
            gv[hit] += dv * dv
            gb += g.sum() ** 2
            pace_w, pace_v = RATE / np.sqrt(gw[hit]), RATE / np.sqrt(gv[hit])
            w[hit] = _shrink(wh - pace_w * dw, DECAY * pace_w)
            v[hit] = _shrink(vh - pace_v * dv, DECAY_V * pace_v)
            b -= RATE * g.sum() / np.sqrt(gb)
            step += 1
        if step >= SETTLED and not settled:
            alive, settled = np.flatnonzero((w != 0) | (v != 0).any(axis=1)), True
            place_of = np.full(n, -1)
            place_of[alive] = np.arange(len(alive))
            rows = [r[r >= 0] for r in (place_of[r] for r in rows)]
            w, v, gw, gv, batches = w[alive], v[alive], gw[alive], gv[alive], _batches(rows, parts)
            kept = {bucket: int(place_of[i]) for bucket, i in kept.items() if place_of[i] >= 0}
    return Machine(kept, b, w, v)


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, usable: Column) -> DataFrame:
    """(text, y) of a bounded sample of labelled rows; the sample of labels is broadcast, texts are not shuffled.

    An id that the labels repeat counts as toxic if any of its labels says so; rows that repeat an id all take part."""
    mine = labels.where(usable & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    n = mine.count()
    u = F.pmod(F.xxhash64(F.lit("tox"), "__id"), F.lit(1 << 30))
    sample = mine.where(u < min(1.0, ROWS / max(1, n)) * (1 << 30)).limit(2 * ROWS)
    return docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "__id").select("text", "y")


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", usable: Column | None = None) -> Machine | None:
    """Fit on a bounded sample of the labelled rows; None where there is no labelled text.

    Null and empty labelled texts are rows without a term; labels of one class give a machine that always says so."""
    rows = labelled(docs, labels, id_col, text_col, label_col, F.lit(True) if usable is None else usable)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, totals = Terms(), np.zeros(BUCKETS, dtype=np.int32)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                totals[list(terms.of(text))] += 1
        full = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(totals[full].astype(np.int64))], ["bucket", "n"])

    counts = rows.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    kept = counts.where(F.col("n") >= LEAST_ROWS).orderBy(F.desc("n"), "bucket").limit(TERMS).select("bucket").toArrow()
    rank = {b: i for i, b in enumerate(kept.column("bucket").to_pylist())}

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(rank)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sorted(terms.of(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], ["terms", "y"])

    got = rows.mapInArrow(terms_of, "terms array<int>, y int").toArrow()
    if not got.num_rows:
        return None
    lists, y = got.column("terms").combine_chunks(), got.column("y").to_numpy().astype(np.float64)
    ends, values = lists.offsets.to_numpy()[1:], lists.values.to_numpy()
    found = np.split(values, ends[:-1])
    order = sorted(range(len(found)), key=lambda i: (y[i], found[i].tobytes()))  # the same whatever the partitions
    return train([found[i] for i in order], y[order], rank)


def score_toxicity(docs: DataFrame, machine: Machine | None, text_col: str = "text", score_name: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1 from the whole text; null and empty texts get the score of no term.

    Texts of any length are read whole, rows that repeat score alike, and an empty table gives no rows.  Without a
    machine every score is 0.  A column of the new name is replaced; all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(text):  # noqa: ANN001, ANN202
        import pandas as pd

        machine = shared.value
        if machine is None:
            return pd.Series(np.zeros(len(text)))
        terms = Terms(machine.kept)
        rows = [np.fromiter(terms.of(t), dtype=np.int64) if isinstance(t, str) else np.empty(0, np.int64) for t in text]
        return pd.Series(machine.score(rows))

    return docs.withColumn(score_name, score(F.col(text_col).cast("string")))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = id_split("doc_id", FOLD_MOD) == FOLD
    machine = fit_toxicity(docs, labels, usable=~held)
    out = score_toxicity(docs.select("doc_id", "text", held.alias("held_out")), machine)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
