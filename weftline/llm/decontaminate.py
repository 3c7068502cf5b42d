"""Operator 10: benchmark decontamination by the q-gram lemma.

An item of m characters that occurs in a text with at most k edits shares at least (m - q + 1) - k*q q-grams with
the place, and their diagonals (text position less item position) differ by k at most.  Shared q-grams are counted
in overlapping diagonal bands, bands that reach the bound are kept, and a banded alignment verifies each.

The lemma holds for any selection of an item's q-grams as well: of s selected ones at least s - k*q are shared.  So
q-grams that many items have are left unselected wherever the others suffice.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, table
from weftline.scratch import materialise, reserve

#: Edits allowed per item character, and lengths of q-grams: an item takes the first by which the bound is positive.
EDITS, GRAMS = 0.1, (8, 6, 5, 4)
#: Items that a q-gram may be in to be selected without need.
HOT = 64
#: Benchmark characters under one matcher; more items are taken in blocks.  Shared q-grams expanded at once.
BLOCK_CHARS, EXPANDED = 4 << 20, 1 << 21
BITS = 22
BASE = 0x9E3779B97F4A7C15

_codes: np.ndarray | None = None


def code_table() -> np.ndarray:
    """Code point to lower-cased letter or digit; marks and anything else become a space (basic plane)."""
    global _codes
    if _codes is None:
        t = np.full(0x10000, 32, dtype=np.uint32)
        for c in range(0x30, 0x10000):
            ch = chr(c)
            if unicodedata.category(ch)[0] in "LN":
                low = ch.lower()
                t[c] = ord(low) if len(low) == 1 else c
        t[0] = 0
        _codes = t
    return _codes


def normalise(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts, each closed by a 0, with runs of other characters as one space; the place of each code
    in its text; and where each text ends (its 0 included)."""
    joined = "\0".join([(t or "").replace("\0", " ") for t in texts]) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    t = code_table()
    out = t[np.minimum(codes, 0xFFFF)]
    big = codes > 0xFFFF
    if big.any():
        out[big] = codes[big]
    keep = np.ones(len(out), dtype=bool)
    space = out == 32
    keep[1:] = ~(space[1:] & (space[:-1] | (out[:-1] == 0)))
    keep[0] = not space[0]
    keep[:-1] &= ~(space[:-1] & (out[1:] == 0))
    at = np.flatnonzero(keep)
    out = out[at]
    raw_ends = np.cumsum([len(x or "") + 1 for x in texts])
    ends = np.searchsorted(at, raw_ends)
    starts = np.concatenate([[0], raw_ends[:-1]])
    return out, at - np.repeat(starts, np.diff(ends, prepend=0)), ends


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit polynomial hash of every q consecutive codes, by doubling."""
    n, out, have = len(codes) - q + 1, None, 0
    if n < 1:
        return np.empty(0, np.uint64)
    h, span, base = codes.astype(np.uint64), 1, BASE
    while True:
        if q & span:
            out = h[:n] if out is None else out * np.uint64(pow(BASE, span, 1 << 64)) + h[have : have + n]
            have += span
        if have == q:
            return out
        h = h[:-span] * np.uint64(base) + h[span:]
        base = base * base % (1 << 64)
        span *= 2


def banded_distances(items: list[np.ndarray], regions: list[np.ndarray], low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edits, start, end) of the best occurrence of each item in its region on diagonals low..high; free region ends.

    All alignments advance together, a row of item characters at a time, over their bands only; an alignment whose
    whole row exceeds its limit drops out, and its edits are given as limit + 1.  A cell holds its edits and, in the
    lower digits, how far from the region's end its alignment began, so of equal edits the latest start survives.
    """
    n, width = len(items), int((high - low).max()) + 1
    m, size = np.array([len(x) for x in items]), np.array([len(x) for x in regions])
    unit = np.int64(size.max() + 2)
    edits, start, end = limit + 1, np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    x, text = np.full((n, m.max()), 0xFFFFFFFE, dtype=np.uint32), np.full((n, size.max() + 1), 0xFFFFFFFF, dtype=np.uint32)
    for i in range(n):
        x[i, : m[i]], text[i, : size[i]] = items[i], regions[i]
    off, who, low, size, big = np.arange(width), np.arange(n), low[:, None], size[:, None], (edits * unit)[:, None]
    banded = off <= high[:, None] - low
    row = np.where(banded & (low + off >= 0) & (low + off <= size), unit - 1 - (low + off), big)
    for i in range(1, x.shape[1] + 1):
        col = i + low + off
        inside = banded & (col >= 0) & (col <= size)
        same = np.take_along_axis(text, np.clip(col - 1, 0, text.shape[1] - 1), axis=1) == x[:, i - 1 : i]
        step = np.where(inside & (col >= 1), row + ~same * unit, big)
        step[:, :-1] = np.minimum(step[:, :-1], row[:, 1:] + unit)
        step[~inside] = np.broadcast_to(big, step.shape)[~inside]
        row = np.minimum.accumulate(step - off * unit, axis=1) + off * unit
        row[~inside] = np.broadcast_to(big, row.shape)[~inside]
        least = row.min(axis=1)
        done = np.flatnonzero((m[who] == i) & (least < big[:, 0]))
        cost = row[done] // unit
        at = cost.argmin(axis=1)
        edits[who[done]], end[who[done]] = cost[np.arange(len(done)), at], m[who[done]] + low[done, 0] + at
        start[who[done]] = unit - 1 - row[done, at] % unit
        alive = (m[who] > i) & (least < big[:, 0])
        if not alive.all():
            who, row, low, size, big, x, text, banded = (v[alive] for v in (who, row, low, size, big, x, text, banded))
            if not len(who):
                break
    return edits, start, end


def budget(m: int) -> int:
    """Edits that an item of m characters is allowed."""
    return int(m * EDITS + 1e-9)


def spreads(items: list[np.ndarray], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All q-grams of the items, their item and place in it, and the number of items that have the q-gram."""
    sizes = np.array([max(0, len(x) - q + 1) for x in items], dtype=np.int64)
    every = np.concatenate([gram_hashes(x, q) for x in items])
    item, pos = np.repeat(np.arange(len(items)), sizes), np.arange(len(every)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    _, gram = np.unique(every, return_inverse=True)
    held = np.unique(gram * np.int64(len(items)) + item) // len(items)
    return every, item, pos, np.bincount(held)[gram]


def gram_lengths(items: list[np.ndarray]) -> list[int | None]:
    """For each item the longest q-grams of which it has more than k*q that few items share; if there are none, the
    longest of which it has that many at all; None for items under 8 characters."""
    out: list[int | None] = [None] * len(items)
    pool = [i for i, x in enumerate(items) if len(x) >= GRAMS[0]]
    for q in GRAMS:
        if not pool:
            break
        _, item, _, spread = spreads([items[i] for i in pool], q)
        few = np.bincount(item[spread <= HOT], minlength=len(pool))
        for k, i in enumerate(pool):
            if few[k] > budget(len(items[i])) * q:
                out[i] = q
        pool = [i for i in pool if out[i] is None]
    for i in pool:
        out[i] = next(q for q in GRAMS if len(items[i]) - q + 1 > budget(len(items[i])) * q)
    return out


class Index:
    """The selected q-grams of items of one q-gram length."""

    def __init__(self, q: int, who: list[int], items: list[np.ndarray]) -> None:
        self.q, self.who, self.items = q, np.array(who, dtype=np.int64), items
        m = np.array([len(x) for x in items], dtype=np.int64)
        self.edits = np.array([budget(int(n)) for n in m], dtype=np.int64)
        every, item, pos, spread = spreads(items, q)
        order = np.lexsort((pos, spread, item))
        place = np.arange(len(every)) - np.repeat(np.cumsum(m - q + 1) - (m - q + 1), m - q + 1)
        needed = np.repeat(self.edits * q + 1, m - q + 1)
        chosen = np.sort(order[(place < needed) | (spread[order] <= HOT)])
        self.bound = np.bincount(item[chosen], minlength=len(items)) - self.edits * q
        own = np.argsort(every[chosen], kind="stable")
        self.grams, first = np.unique(every[chosen][own], return_index=True)
        self.first = np.concatenate([first, [len(chosen)]]).astype(np.int64)
        self.item, self.pos = item[chosen][own].astype(np.int32), pos[chosen][own].astype(np.int32)
        self.seen = np.zeros(1 << BITS, dtype=bool)
        self.seen[self._slot(self.grams)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)).astype(np.int64)

    def bands(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """(row, item, lowest diagonal) of every band of 2 (k + 1) diagonals with enough shared q-grams; in order."""
        none = np.empty((0, 3), dtype=np.int64)
        h = gram_hashes(codes, self.q)
        at = np.flatnonzero(self.seen[self._slot(h)]) if len(h) else np.empty(0, np.int64)
        if len(at):
            g = np.minimum(np.searchsorted(self.grams, h[at]), len(self.grams) - 1)
            true = self.grams[g] == h[at]
            at, g = at[true], g[true]
        if not len(at):
            return none
        n = self.first[g + 1] - self.first[g]
        wide = np.int64(2 * len(codes) + 8)
        kept, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        upto = np.cumsum(n)
        cuts = np.searchsorted(upto, np.arange(EXPANDED, upto[-1] + EXPANDED, EXPANDED), side="right")
        for a, b in zip(np.concatenate([[0], cuts[:-1]]), cuts):
            b = max(b, a + 1)
            m = n[a:b]
            if not len(m):
                continue
            entry = np.repeat(self.first[g[a:b]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            item, spot = self.item[entry].astype(np.int64), np.repeat(at[a:b], m)
            pair = np.searchsorted(ends, spot, side="right") * len(self.items) + item
            band = (spot - self.pos[entry] + len(codes) + 2) // (self.edits[item] + 1)  # shifted to stay above zero
            key, count = np.unique(pair * wide + band, return_counts=True)
            kept, counts = np.concatenate([kept, key]), np.concatenate([counts, count])
        key, place = np.unique(np.concatenate([kept, kept - 1]), return_inverse=True)  # a band and the one above it
        total = np.bincount(place, weights=np.concatenate([counts, counts])).astype(np.int64)
        pair, band = key // wide, key % wide
        item = pair % len(self.items)
        good = total >= self.bound[item]
        pair, band, item = pair[good], band[good], item[good]
        return np.stack([pair // len(self.items), item, band * (self.edits[item] + 1) - len(codes) - 2], axis=1)


@dataclass
class Matcher:
    """Items of one block, normalised; equal ones are looked for once."""

    ids: list
    items: list[np.ndarray]

    def __post_init__(self) -> None:
        same: dict[bytes, list[int]] = {}
        for i, x in enumerate(self.items):
            same.setdefault(x.tobytes(), []).append(i)
        self.alike = list(same.values())
        own = [self.items[like[0]] for like in self.alike]
        length = gram_lengths(own)
        self.indices = [Index(q, [i for i, n in enumerate(length) if n == q], [x for x, n in zip(own, length) if n == q]) for q in GRAMS if q in length]
        self.short = [(i, x) for i, (x, n) in enumerate(zip(own, length)) if n is None and len(x)]

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item, edits, start, end): each item that occurs in a text, once a text, at its best place; start
        and end are character places in the text itself."""
        codes, place, ends = normalise(texts)
        starts = np.concatenate([[0], ends[:-1]])
        found: dict[tuple[int, int], tuple[int, int, int]] = {}

        def note(row: int, item: int, edits: int, a: int, b: int) -> None:
            now = (edits, int(place[a]), int(place[b - 1]) + 1)
            if (row, item) not in found or now < found[row, item]:
                found[row, item] = now

        for index in self.indices:
            self._verify(index, codes, starts, ends, index.bands(codes, ends), note)
        if self.short:
            hay = codes.astype("<u4").tobytes()
            for i, x in self.short:
                for p in self._literals(x, hay):
                    if (p == 0 or codes[p - 1] in (0, 32)) and codes[p + len(x)] in (0, 32):
                        note(int(np.searchsorted(ends, p, side="right")), i, 0, p, p + len(x))
        return sorted((r, i, *v) for (r, k), v in found.items() for i in self.alike[k])

    def _verify(self, index: Index, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, bands: np.ndarray, note) -> None:  # noqa: ANN001
        """Align the items of all retained bands: literal occurrences first, the others together.  After a literal
        occurrence an item's later bands in the text can't be better."""
        left: list[tuple[int, int, int, int, int, int]] = []
        settled: tuple[int, int] | None = None
        for r, i, low in bands.tolist():
            if settled == (r, i):
                continue
            x, k = index.items[i], int(index.edits[i])
            high = low + 2 * (k + 1) - 1
            a, b = max(int(starts[r]), low - k), min(int(ends[r]) - 1, high + k + len(x))
            if b <= a:
                continue
            where = next(self._literals(x, codes[a:b].astype("<u4").tobytes()), -1)
            if where >= 0:
                note(r, int(index.who[i]), 0, a + where, a + where + len(x))
                settled = r, i
            elif k:
                left.append((r, i, a, b, low - a, high - a))
        for s in range(0, len(left), 256):
            part = left[s : s + 256]
            _, item, a, b, low, high = (np.array(v) for v in zip(*part))
            edits = index.edits[item]
            got = banded_distances([index.items[i] for i in item], [codes[c:d] for c, d in zip(a, b)], low - edits, high + edits, edits)
            for (r, i, c, d, _, _), e, y, z in zip(part, *(v.tolist() for v in got)):
                if e <= index.edits[i]:
                    z = max(1, min(z, d - c))
                    note(r, int(index.who[i]), e, c + min(y, z - 1), c + z)

    @staticmethod
    def _literals(item: np.ndarray, hay: bytes) -> Iterator[int]:
        """Places where ``item`` stands in ``hay`` unchanged."""
        needle, at = item.astype("<u4").tobytes(), -1
        while (at := hay.find(needle, at + 1)) >= 0:
            if at % 4 == 0:
                yield at // 4


def matchers(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator:
    """Broadcast matchers over all items, a block of about ``BLOCK_CHARS`` characters at a time; empty items match
    nothing.

    Benchmarks are small beside a corpus: usually there is one block.  More blocks take one more pass over the texts
    each, and only one of them is at the driver at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text <> ''")
    pieces = -(-(rows.agg(F.sum(F.char_length("text"))).first()[0] or 0) // BLOCK_CHARS)
    for piece in range(pieces):
        some = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(pieces)) == piece).collect()
        parts = [(r["id"], normalise([r["text"]])[0][:-1]) for r in sorted(some, key=lambda r: (str(r["id"]), r["text"]))]
        kept = [(i, c) for i, c in parts if len(c)]
        if kept:
            yield spark.sparkContext.broadcast(Matcher([i for i, _ in kept], [c for _, c in kept])), pieces


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, edits, start, end): every document and benchmark item that occurs in it with at most a tenth of the
    item's characters edited (items under 8 characters: as whole words, unchanged).

    Letters and digits are compared without case; other characters count as one space.  The whole text is searched;
    an item is reported once a row, at the place of the fewest edits, then the first.  Null and empty texts and
    items match nothing; rows that repeat match alike; items of equal text are reported each.
    """
    spark = docs.sparkSession
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    shape = f"`{id_col}` {kind}, `{item_col}` {item_kind}, edits int, start int, `end` int"
    found, folder = None, reserve(spark)
    for shared, pieces in matchers(benchmark, item_col, item_text_col):

        @F.pandas_udf("array<struct<item:int,edits:int,start:int,end:int>>")
        def search(text, shared=shared):  # noqa: ANN001, ANN202
            import pandas as pd

            texts = [t if isinstance(t, str) else None for t in text]
            out: list[list] = [[] for _ in texts]
            for a, b in chunks([len(t or "") for t in texts], 1 << 18):
                for r, i, edits, s, e in shared.value.find(texts[a:b]):
                    out[a + r].append({"item": i, "edits": edits, "start": s, "end": e})
            return pd.Series(out)

        ids = spark.createDataFrame(list(enumerate(shared.value.ids)), f"item int, `{item_col}` {item_kind}")
        hits = docs.select(F.col(id_col).alias("__id"), F.explode(search(F.col(text_col).cast("string"))).alias("h")).select("__id", "h.*")
        found = hits.join(F.broadcast(ids), "item").select(F.col("__id").alias(id_col), item_col, "edits", "start", "end")
        if pieces > 1:
            found.write.mode("append").parquet(folder)
            found = spark.read.schema(found.schema).parquet(folder)
            shared.unpersist()
    return found if found is not None else spark.createDataFrame([], shape)


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark item; all columns as they are, nothing is shuffled.

    Documents whose text is null or empty stay, rows that repeat go or stay alike, an empty benchmark removes nothing
    and an empty table gives no rows.  Whole texts are searched however long."""
    for shared, pieces in matchers(benchmark, item_col, item_text_col):

        @F.pandas_udf("boolean")
        def clean(text, shared=shared):  # noqa: ANN001, ANN202
            import pandas as pd

            texts = [t if isinstance(t, str) else None for t in text]
            out = np.ones(len(texts), dtype=bool)
            for a, b in chunks([len(t or "") for t in texts], 1 << 18):
                out[[a + r for r, *_ in shared.value.find(texts[a:b])]] = False
            return pd.Series(out)

        docs = docs.where(clean(F.col(text_col).cast("string")))
        if pieces > 1:
            docs = materialise(docs)
            shared.unpersist()
    return docs


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
