"""Operator 3: log-bilinear language model scores.

Tokens are counted over the whole training corpus.  The model predicts the next *unit*: each of the most frequent
words is a unit, the end of a text is one, and every other word belongs to the unit of its ending.  The unit's vector
is predicted from the two units before by a log-bilinear form, trained in numpy by noise-contrastive estimation on
draws from the exact unit trigram counts of the whole training corpus.  Batched matrix products over all contexts
then give normalised log-probabilities.  Within a unit of many words, a word has its smoothed share of the unit's
count, so the probabilities of all known words and one unknown word a unit add up to one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, flat, id_split, raw, segment_sum, table, words
from weftline.scratch import discard, materialise

#: Units: single words, endings of ENDING bytes, the end of a text, and one for other words.
TOP, ENDINGS, ENDING = 96, 30, 3
UNITS = TOP + ENDINGS + 2
END, OTHER = TOP, TOP + ENDINGS + 1
#: Words whose counts are broadcast; the counts of all others are joined by a shuffle.
FREQUENT = 50_000
#: Distinct words a task counts before it hands them on.
HELD = 250_000
WIDTH, NOISE, BATCH, STEPS, RATE = 24, 128, 2048, 1500, 0.15
FOLD_MOD, FOLD = 7, 2


def count_words(texts: DataFrame) -> DataFrame:
    """(token, c) over all rows of (text): each task adds up what it has read before anything is shuffled."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "c"])
            held.clear()
            return out

        for batch in batches:
            for text in raw(batch.column(0)):
                held.update(words(text))
                if len(held) >= HELD:
                    yield hand_on()
        if held:
            yield hand_on()

    return texts.mapInArrow(work, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    rank: dict[bytes, int]  # of the frequent words
    counts: np.ndarray
    units: np.ndarray  # of the frequent words
    endings: dict[bytes, int]
    unit_log: np.ndarray  # log10 of a many-word unit's denominator, 0 for units of one token
    total: int
    distinct: int
    ends: int

    def read(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Ranks (-1: not frequent, -2: end) and units of all tokens, where texts end, the other words, and the
        rows they are in."""
        lists = [[*words(t), b" "] for t in texts]
        tokens, ends = flat(lists)
        rank = np.fromiter(map(self.rank.get, tokens, repeat(-1)), dtype=np.int32, count=len(tokens))
        unit = np.zeros(len(tokens), dtype=np.int64)
        known = rank >= 0
        unit[known] = self.units[rank[known]]
        rank[ends - 1], unit[ends - 1] = -2, END
        at = np.flatnonzero(rank == -1)
        others = [tokens[i] for i in at.tolist()]
        get = self.endings.get
        unit[at] = np.fromiter((get(t[-ENDING:], OTHER) for t in others), dtype=np.int64, count=len(others))
        return rank, unit, ends, others, np.searchsorted(ends, at, side="right")


def vocabulary(counts: DataFrame, n_texts: int) -> Vocabulary:
    top = counts.orderBy(F.desc("c"), "token").limit(FREQUENT).toArrow()
    names, c = top.column("token").to_pylist(), top.column("c").to_numpy()
    rest = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(bytearray(x),) for x in names[:TOP]], "token binary")), "token", "left_anti")
    ending = F.hex(F.substring("token", -ENDING, ENDING))
    common = rest.groupBy(ending.alias("e")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "e").limit(ENDINGS).collect()
    endings = {bytes.fromhex(e): TOP + 1 + i for i, (e, _) in enumerate(common)}
    found = F.lit(OTHER)
    if endings:
        found = F.coalesce(F.create_map(*[F.lit(x) for e, k in endings.items() for x in (e.hex().upper(), k)])[ending], F.lit(OTHER))
    logs = np.zeros(UNITS)
    logs[[*range(TOP + 1, UNITS)]] = 0.0
    for k, n, v in rest.groupBy(found.alias("k")).agg(F.sum("c"), F.count("*")).collect():
        logs[k] = np.log10(n + v + 1)
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    units = np.array([i if i < TOP else endings.get(t[-ENDING:], OTHER) for i, t in enumerate(names)], dtype=np.int64)
    return Vocabulary({t: i for i, t in enumerate(names)}, c, units, endings, logs, (total or 0) + n_texts, distinct + (n_texts > 0), n_texts)


def contexts(unit: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code of (two before, one before, unit); before a text's first token stand ends."""
    one, two = np.full(len(unit), END), np.full(len(unit), END)
    one[1:], two[2:] = unit[:-1], unit[:-2]
    starts = np.concatenate([[0], ends[:-1]])
    two[starts] = END
    second = starts + 1
    two[second[second < len(unit)]] = END
    return (two * UNITS + one) * UNITS + unit


def count_trigrams(texts: DataFrame, vocab) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """Codes and counts of all unit trigrams of (text), at most UNITS ** 3 of them whatever the corpus."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNITS**3, dtype=np.int64)
        for batch in batches:
            texts = raw(batch.column(0))
            for a, b in chunks([len(t or b"") for t in texts]):
                _, unit, ends, _, _ = vocab.value.read(texts[a:b])
                code, n = np.unique(contexts(unit, ends), return_counts=True)
                total[code] += n
        code = np.flatnonzero(total)
        for s in range(0, len(code), 100_000):
            part = code[s : s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(total[part])], ["code", "n"])

    got = texts.mapInArrow(work, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    return got.column("code").to_numpy(), got.column("n").to_numpy()


def train(codes: np.ndarray, counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """log10 P(unit | two before, one before), normalised, for every context: (UNITS ** 2, UNITS)."""
    rng = np.random.default_rng(seed)
    k = UNITS
    unigram = np.bincount(codes % k, weights=counts, minlength=k) + 0.5
    noise_p = unigram / unigram.sum()
    log_noise = np.log(NOISE * noise_p)
    r, q = rng.normal(0, 0.1, (k, WIDTH)), rng.normal(0, 0.1, (k, WIDTH))
    c1, c2, b = np.eye(WIDTH), 0.5 * np.eye(WIDTH), np.log(noise_p)
    sums = {name: np.full(x.shape, 1e-6) for name, x in (("r", r), ("q", q), ("c1", c1), ("c2", c2), ("b", b))}

    def step(name: str, x: np.ndarray, g: np.ndarray, rate: float) -> None:
        sums[name] += g * g
        x -= rate * g / np.sqrt(sums[name])

    if len(codes):
        edges = np.cumsum(counts.astype(np.float64))
        noise_edges = np.cumsum(noise_p)
        one_hot = np.eye(k)
        sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        for i in range(STEPS):
            rate = RATE * (1 - 0.9 * i / STEPS)
            code = codes[np.searchsorted(edges, rng.random(BATCH) * edges[-1])].astype(np.int64)
            w, one, two = code % k, code // k % k, code // (k * k)
            noise = np.minimum(np.searchsorted(noise_edges, rng.random(NOISE)), k - 1)
            r1, r2 = r[one], r[two]
            h = r1 @ c1 + r2 @ c2
            data = sigmoid((h * q[w]).sum(axis=1) + b[w] - log_noise[w]) - 1
            fake = sigmoid(h @ q[noise].T + b[noise] - log_noise[noise])
            data, fake = data / BATCH, fake / BATCH
            gh = data[:, None] * q[w] + fake @ q[noise]
            hot_w, hot_n = one_hot[w], one_hot[noise]
            gq = hot_w.T @ (data[:, None] * h) + hot_n.T @ (fake.T @ h)
            gb = hot_w.T @ data + hot_n.T @ fake.sum(axis=0)
            gr = one_hot[one].T @ (gh @ c1.T) + one_hot[two].T @ (gh @ c2.T)
            g1, g2 = r1.T @ gh, r2.T @ gh
            for name, x, g in (("r", r, gr), ("q", q, gq), ("c1", c1, g1), ("c2", c2, g2), ("b", b, gb)):
                step(name, x, g, rate)
    by_one, by_two = r @ c1 @ q.T, r @ c2 @ q.T
    out = np.empty((k * k, k), dtype=np.float32)
    for two in range(k):  # a batch of contexts at a time
        z = by_two[two] + by_one + b
        z -= z.max(axis=1, keepdims=True)
        out[two * k : (two + 1) * k] = (z - np.log(np.exp(z).sum(axis=1, keepdims=True))) / np.log(10)
    return out


def language_scores(docs: DataFrame, train_on, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: ANN001
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``train_on`` says which rows are learnt from.  Null and empty texts consist of the end alone.  Rows that repeat
    are scored each.  With no training row every token is unknown, the base is uniform over one unknown token and
    the model uniform over its units.  Only id and text are read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(train_on, F.lit(False)).alias("fit"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    fit = rows.where("fit").select("text")
    counts = materialise(count_words(fit))
    vocab = spark.sparkContext.broadcast(vocabulary(counts, fit.count()))
    model = spark.sparkContext.broadcast(train(*count_trigrams(fit, vocab)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table = vocab.value, model.value.reshape(-1)
        logs = np.log10(v.counts + 1.0)
        for batch in batches:
            texts = raw(batch.column(3))
            for a, b in chunks([len(t or b"") for t in texts]):
                rank, unit, ends, others, at = v.read(texts[a:b])
                own = np.zeros(len(rank))
                own[rank >= 0] = logs[rank[rank >= 0]]
                many = v.unit_log[unit]
                within = np.where((unit > END) & (rank >= 0), own, 0.0) - np.where(unit > END, many, 0.0)
                own[ends - 1] = np.log10(v.ends + 1.0)
                n = b - a
                known = segment_sum((rank >= 0).astype(np.float64), ends).astype(np.int64) + (v.ends > 0)
                made = table[contexts(unit, ends)].astype(np.float64) + within
                uid = batch.column(0).slice(a, n)
                none = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([uid, none, batch.column(1).slice(a, n), batch.column(2).slice(a, n), pa.array(np.diff(ends, prepend=0)), pa.array(known), pa.array(segment_sum(own, ends)), pa.array(segment_sum(made, ends))], names)
                for s in range(0, len(others), 50_000):
                    part = others[s : s + 50_000]
                    m = len(part)
                    yield pa.RecordBatch.from_arrays([uid.take(pa.array(at[s : s + 50_000])), pa.array(part, pa.binary()), pa.nulls(m, batch.column(1).type), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())], names)

    names = ["uid", "token", "id", "fit", "n_tokens", "n_known", "base", "score"]
    tagged = rows.select(F.monotonically_increasing_id().alias("uid"), "id", "fit", "text")
    both = materialise(tagged.mapInArrow(score, f"uid long, token binary, id {kind}, fit boolean, n_tokens long, n_known long, base double, score double"))
    # words beyond the frequent ones: none holds more than a 1 / FREQUENT share of the tokens, so no key is hot
    rest = both.where("token is not null").select("uid", "token").join(counts, "token")
    rest = rest.groupBy("uid").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("gain"))
    whole = both.where("token is null").drop("token").join(rest, "uid", "left")
    v = vocab.value
    per_token = float(np.log10(v.total + 1.0 * (v.distinct + 1)))
    gain = F.coalesce("gain", F.lit(0.0))
    return whole.select(
        F.col("id").alias(id_col),
        (~F.col("fit")).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("long").alias("train_tokens"),
        (F.col("base") + gain - F.col("n_tokens") * per_token).alias("base_score"),
        (F.col("score") + gain).alias("score"),
    )


def op3_lm(spark, sf_dir: str) -> DataFrame:
    return language_scores(table(spark, sf_dir, "documents"), id_split("doc_id", FOLD_MOD) != FOLD)
