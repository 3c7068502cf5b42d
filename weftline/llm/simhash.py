"""Operator 4: SimHash near-duplicate groups over vantage-point trees.

Each text gets a fingerprint: a bit is 1 if it is set in over half of its shingles' hashes.  Equal fingerprints are
merged first, so a group of exact copies costs one row.  The distinct fingerprints are dealt to shards by the leaves
of a vantage-point tree grown on a small sample; each also visits the shards that its search ball overlaps.  A shard
is searched exactly by a tree of its own and returns one edge a node (to the root of its local group), never all
pairs.  Components of those edges are then found by star contraction.

The pipeline's stage takes such components only as candidates: with ``confirm`` their members' sets of shingles are
compared, and a link holds if the exact Jaccard similarity is reached.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, fresh, raw, table, words
from weftline.llm.vptree import Forest, build, link, route
from weftline.operators.graph import connected_components
from weftline.scratch import attach, discard, materialise, small_enough, without

SEED = 42
#: Distinct fingerprints meant for a shard, and sampled for each shard to grow the upper tree.
SHARD, SAMPLE = 32_768, 48
LANES = np.uint64(0x0101010101010101)
#: Odd multipliers that turn one 64-bit hash into further ones come from this generator.
MIX_SEED = 20_240_607


def mixers(n: int) -> np.ndarray:
    return np.random.default_rng(MIX_SEED).integers(1 << 62, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def _counts(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each run of hashes: eight byte lanes are summed at a time."""
    n = len(ends)
    starts = np.concatenate([[0], ends[:-1]])
    pieces = -(-(ends - starts) // 255)
    owner = np.repeat(np.arange(n), pieces)
    first = np.concatenate([[0], np.cumsum(pieces)[:-1]])
    cut = starts[owner] + 255 * (np.arange(len(owner)) - first[owner])
    out = np.zeros((n, 64), dtype=np.int64)
    for bit in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, cut)
        lanes = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[:, bit::8] = np.add.reduceat(lanes, first, axis=0)
    return out


def shingles(text: bytes | None, size: int) -> list[int]:
    """Hashes of the runs of ``size`` words, in order; a shorter text is one shingle, one without a word none."""
    digest, w = xxhash.xxh64_intdigest, words(text)
    if len(w) < size:
        return [digest(b" ".join(w), SEED)] if w else []
    joined, at = b" ".join(w), 0
    starts = []
    for x in w:
        starts.append(at)
        at += len(x) + 1
    stops = [s - 1 for s in starts[size:]] + [at - 1]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, stops)]


def fingerprints(texts: list[bytes | None], size: int, n_words: int = 1, distinct: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of 64 * ``n_words`` bits and shingle counts; texts without a word get zero and count 0.

    With ``distinct`` a shingle that a text repeats has one vote and counts once."""
    hashes: list[int] = []
    ends = []
    for text in texts:
        own = shingles(text, size)
        hashes += set(own) if distinct else own
        ends.append(len(hashes))
    ends = np.array(ends, dtype=np.int64)
    n = np.diff(ends, prepend=0)
    out = np.zeros((len(texts), n_words), dtype=np.uint64)
    full = n > 0
    if full.any():
        h, own_ends = np.array(hashes, dtype=np.uint64), ends[full]
        for k, mixer in enumerate([None, *mixers(n_words - 1)]):
            if mixer is not None:
                h_k = h * mixer
                h_k ^= h_k >> np.uint64(29)
                h_k *= mixer
                h_k ^= h_k >> np.uint64(32)
            bits = 2 * _counts(h if mixer is None else h_k, own_ends) > n[full][:, None]
            out[full, k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out, n


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str, size: int, n_words: int, distinct: bool = False) -> DataFrame:
    """(id, fp, n, th): fp as 8 * n_words bytes, first the 64-bit fingerprint itself, most significant byte first; th
    tells apart the texts under one id."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("th"))
    kind = dict(rows.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw(batch.column(1))
            parts = [fingerprints(texts[a:b], size, n_words, distinct) for a, b in chunks([len(t or b"") for t in texts])]
            if parts:
                fp = np.concatenate([p for p, _ in parts]).astype(">u8").tobytes()
                width = 8 * n_words
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fp[i : i + width] for i in range(0, len(fp), width)], pa.binary()), pa.array(np.concatenate([n for _, n in parts]), pa.int64()), batch.column(2)], ["id", "fp", "n", "th"])

    return rows.mapInArrow(work, f"id {kind}, fp binary, n long, th long")


def as_words(column: pa.Array, n_words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, n_words)


def fingerprint_edges(groups: DataFrame, n_words: int, prefix_radius: int, radius: int, ratio: float | None) -> DataFrame:
    """Edges (src, dst) between nodes whose fingerprints are in reach; (node, fp, n) in, one row a fp.

    With ``ratio`` only counts n within that ratio are compared: rows are dealt to bands of log(n) so wide, members
    of a band are searched by the band's own rows and by those of the band below.
    """
    step = -math.log(ratio) if ratio else None
    band = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / step).cast("int") if step else F.lit(0)
    groups = groups.withColumn("band", band)
    largest = groups.groupBy("band").count().agg(F.max("count"), F.sum("count")).first()
    most, total = largest[0] or 0, largest[1] or 0
    depth = max(0, math.ceil(math.log2(max(1, most) / SHARD)))
    nodes = [None]
    if depth:
        wanted = SAMPLE << depth
        share = min(1.0, wanted / total)
        sample = groups.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < share * (1 << 30)).select("fp").limit(2 * wanted).toArrow()
        nodes = build(as_words(sample.column(0).combine_chunks(), n_words)[:, :1], depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = as_words(batch.column(1), n_words)
            who, leaf, home = route(nodes, rows[:, :1], prefix_radius)
            bands = batch.column(2).to_numpy()[who]
            for up in (0, 1) if step else (0,):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(who)), batch.column(1).take(pa.array(who)), pa.array((bands + up).astype(np.int64) * (len(nodes) + 1) + leaf), pa.array(home & (up == 0))], ["node", "fp", "shard", "home"])

    def search(part: pa.Table) -> pa.Table:
        home = part.column("home").to_numpy()
        rows = as_words(part.column("fp").combine_chunks(), n_words)
        order = np.concatenate([np.nonzero(home)[0], np.nonzero(~home)[0]])
        rows, members = rows[order], int(home.sum())
        forest = Forest(len(rows))
        link(rows[:members], rows, prefix_radius, radius, forest)
        root = forest.roots(np.arange(len(rows)))
        child = np.nonzero(root != np.arange(len(rows)))[0]
        nodes = part.column("node").take(pa.array(order))
        return pa.table({"src": nodes.take(pa.array(child)), "dst": nodes.take(pa.array(root[child]))})

    dealt = groups.select("node", "fp", "band").mapInArrow(deal, "node binary, fp binary, shard long, home boolean")
    return dealt.groupBy("shard").applyInArrow(search, "src binary, dst binary")


#: Candidates that one task compares: larger groups are cut in blocks, and every two blocks are compared.
BLOCK = 4_096


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, size: int, n_words: int) -> DataFrame:
    """(id, fp, shingles): a text's distinct shingle hashes in order, 8 bytes each."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = raw(batch.column(1))
            for a, b in chunks([len(t or b"") for t in texts]):
                fp = fingerprints(texts[a:b], size, n_words, True)[0].astype(">u8")
                sets = [np.unique(np.array(shingles(t, size), dtype=np.uint64)).tobytes() for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([x.tobytes() for x in fp], pa.binary()), pa.array(sets, pa.binary())], ["id", "fp", "shingles"])

    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, fp binary, shingles binary")


def confirm(fps: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Spanning edges of the pairs whose fingerprints are in reach and whose exact Jaccard similarity is ``similarity``
    or more; pairs that earlier edges join are not compared."""
    size, label, out = np.array([len(x) for x in sets]), np.arange(len(sets)), []
    for i in range(len(sets) - 1):
        least, most = np.minimum(size[i + 1 :], size[i]), np.maximum(size[i + 1 :], size[i])
        near = (label[i + 1 :] != label[i]) & (least >= similarity * most - 1e-9)
        near[near] = np.bitwise_count(fps[i + 1 :][near] ^ fps[i]).sum(axis=1, dtype=np.int32) <= radius
        for j in (i + 1 + np.nonzero(near)[0]).tolist():
            if label[i] == label[j]:
                continue
            shared = size[i] + size[j] - len(np.unique(np.concatenate([sets[i], sets[j]])))
            if shared >= similarity * (size[i] + size[j] - shared) - 1e-9:
                label[label == label[j]] = label[i]
                out.append((i, j))
    return out


def confirmed_edges(docs: DataFrame, groups: DataFrame, candidates: DataFrame, id_col: str, text_col: str, size: int, n_words: int, radius: int, similarity: float) -> DataFrame:
    """Edges (src, dst) of exact similarity within the components (node, component) of ``candidates``.

    Only texts of a component are read again.  A component up to ``BLOCK`` is compared in one task (small ones share
    tasks); of a larger one each pair of blocks is a task, so its rows travel once for every block.
    """
    blocks = candidates.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("k"))
    members = attach(candidates, materialise(blocks), "component", 48)
    members = materialise(groups.where("rep is not null").select("rep", "fp", "node").join(members, "node"))
    total, reps = members.count(), members.select(F.col("rep").alias(id_col)).distinct()
    texts = docs.join(F.broadcast(reps) if small_enough(reps, 32) else reps.hint("merge"), id_col, "left_semi")
    sets = shingle_sets(texts, id_col, text_col, size, n_words)
    if not small_enough(members, 64 + 8 * n_words):
        sets = materialise(sets)
    # an id that repeats with another text has another fingerprint
    sets = attach(sets, members, "fp", 64 + 8 * n_words).where("id = rep")
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    small = F.pmod(F.xxhash64("component"), F.lit(max(1, total // BLOCK * 4))).cast("string")
    other = F.explode(F.sequence(F.lit(0), F.col("k") - 1))
    sets = sets.withColumn("own", own).withColumn("other", other)
    pair = F.concat_ws("/", F.col("component").cast("string"), F.least("own", "other"), F.greatest("own", "other"))
    dealt = sets.select("node", "fp", "shingles", "component", F.when(F.col("k") > 1, pair).otherwise(small).alias("shard"))

    def search(part: pa.Table) -> pa.Table:
        fps = as_words(part.column("fp").combine_chunks(), n_words)
        codes = part.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        held, src, dst = part.column("shingles"), [], []
        # of repeated rows one is enough
        _, once = np.unique(np.column_stack([codes.astype(np.uint64), fps]), axis=0, return_index=True)
        once = once[np.argsort(codes[once], kind="stable")]
        for who in np.split(once, np.nonzero(np.diff(codes[once]))[0] + 1):
            sets_of = [np.frombuffer(x, dtype=np.uint64) for x in held.take(pa.array(who)).to_pylist()]
            for i, j in confirm(fps[who], sets_of, radius, similarity):
                src.append(who[i])
                dst.append(who[j])
        nodes = part.column("node")
        return pa.table({"src": nodes.take(pa.array(src, pa.int64())), "dst": nodes.take(pa.array(dst, pa.int64()))})

    return dealt.groupBy("shard").applyInArrow(search, "src binary, dst binary")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, n_words: int = 1, prefix_radius: int = 2, radius: int = 2, ratio: float | None = None, confirmed: bool = False) -> DataFrame:
    """(id, fingerprint bytes, component): component is the smallest id reachable over links, itself included.

    Null and empty texts have the zero fingerprint and link to each other like any other.  Repeated rows are equal
    fingerprints.  Rows with a null id keep their fingerprint and take their group's component (null if the group
    has no id at all).  Only id and text are read, so other columns cannot clash.  An empty table gives no rows.

    With ``confirmed`` fingerprints are those of the sets of shingles and only find candidates: a link is a pair whose
    sets have a Jaccard similarity of ``ratio`` or more.
    """
    fps = materialise(fingerprint_table(docs, id_col, text_col, size, n_words, confirmed))
    # nodes are texts' fingerprints (long ones by their digest), not ids: an id may repeat with another text
    node = F.col("fp") if n_words == 1 else F.unhex(F.md5("fp"))
    groups = materialise(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.max("n").alias("n")).withColumn("node", node))
    edges = materialise(fingerprint_edges(groups.where("rep is not null"), n_words, prefix_radius, radius, ratio))
    found = materialise(connected_components(edges))
    discard(edges)
    if confirmed:
        exact = materialise(confirmed_edges(docs, groups, found, id_col, text_col, size, n_words, radius, ratio))
        discard(found)
        found = materialise(connected_components(exact))
        discard(exact)
    joined = materialise(attach(groups.select("fp", "rep", "node"), found, "node", 48).select("fp", "rep", F.coalesce("component", "node").alias("component")))
    least = materialise(joined.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("k")).where("k > 1").select("component", "least"))
    labels = materialise(attach(joined, least, "component", 48).select("fp", F.coalesce("least", "rep").alias("component")))
    discard(groups, found, joined, least)
    return attach(fps, labels, "fp", 48 + 8 * n_words).select("id", "fp", "n", "component", "th")


#: The pipeline's rule: five-word shingles and a Jaccard similarity of 0.8.
STAGE_WORDS, STAGE_SIZE, STAGE_SIMILARITY = 16, 5, 0.8
#: Standard deviations added to the bits in which a pair of that similarity differs, and the largest union of shingles
#: for which those bits are counted rather than taken from the limit of large sets.
SPREAD, COUNTED = 5, 24


def differing(shared: int, a: int, b: int) -> float:
    """The chance that a bit differs between sets of ``shared`` common shingles and ``a`` and ``b`` of their own."""
    votes = lambda n: {2 * k - n: math.comb(n, k) / 2**n for k in range(n + 1)}
    one, two, out = votes(a), votes(b), 0.0
    for v, p in votes(shared).items():
        x, y = (sum(q for u, q in own.items() if v + u > 0) for own in (one, two))
        out += p * (x * (1 - y) + y * (1 - x))
    return out


def stage_radii(similarity: float = STAGE_SIMILARITY, n_words: int = STAGE_WORDS) -> tuple[int, int]:
    """Radii of the first 64 bits and of all bits that a pair of ``similarity`` or more hardly ever exceeds.

    In large sets it differs in acos(2J / (1 + J)) / pi of the bits; small sets have ties, and 4 against 5 shingles
    differ most (0.1875 of the bits at 0.8, against 0.1515)."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for union in range(1, COUNTED + 1):
        for shared in range(math.ceil(similarity * union - 1e-9), union):
            p = max(p, *(differing(shared, a, union - shared - a) for a in range((union - shared) // 2 + 1)), 0.0)
    reach = lambda bits: math.floor(bits * p + SPREAD * math.sqrt(bits * p * (1 - p)))
    return reach(64), reach(64 * n_words)


def near_duplicate_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """(id, component) under the pipeline's rule: five-word shingles, similarity of ``similarity`` or more."""
    prefix, radius = stage_radii(similarity)
    return simhash_groups(docs, id_col, text_col, STAGE_SIZE, STAGE_WORDS, prefix, radius, similarity, True).select("id", "component", "th")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = STAGE_SIMILARITY) -> DataFrame:
    """One document of each near-duplicate group, the one of the smallest id; all columns of ``docs``.

    What counts is the row: texts that differ under one id are documents of their own, each goes or stays with its
    group, and of wholly repeated (id, text) one row stays.  Rows without an id are kept.  Null and empty texts form
    one group like any other equal texts.  Texts are not shuffled unless the list of dropped ids outgrows the broadcast
    bound or ids repeat.
    """
    found = materialise(near_duplicate_ids(docs, id_col, text_col, similarity).where("id is not null"))
    repeated = materialise(found.groupBy("id").count().where("count > 1").select("id"))
    if repeated.isEmpty():
        drop = materialise(found.where("id <> component").select(F.col("id").alias(id_col)))
        return without(docs, drop, id_col)
    best = found.where("id = component").groupBy("component").agg(F.min("th").alias("best"))
    drop = materialise(found.join(best, "component", "left").where("id <> component or th <> best").select(F.struct("id", "th").alias("row")).distinct())
    row, again = fresh(docs, "row", "again")
    mine = docs.withColumn(row, F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th")))
    kept = without(mine, drop.withColumnRenamed("row", row), row)
    twice = kept.where(F.col(id_col).isNotNull()).join(repeated.select(F.col("id").alias(again)), F.col(id_col) == F.col(again), "left")
    once = twice.where(F.col(again).isNull()).drop(again)
    more = twice.where(F.col(again).isNotNull()).drop(again).dropDuplicates([row])
    return once.unionByName(more).unionByName(kept.where(F.col(id_col).isNull())).select(*docs.columns)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash_groups(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
