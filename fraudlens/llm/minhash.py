"""Operator 4, near-duplicate documents by MinHash, banding and components.

1. Every whole text becomes the set of its distinct word shingles (64-bit
   hashes). ``bands * rows`` universal hash functions give its minima; the
   minima of a band together are a bucket key, and 16 bits of each are the
   signature. This table is written once, without the texts.
2. Texts with equal sets form a class; its smallest document id stands for
   it from here on, so copies are never compared with each other.
3. Class representatives that share a bucket are linked to the smallest one
   in it: a few links each, however large a bucket is. Connected components
   of these unverified links are the groups inside which alone true links
   can be.
4. In each group, signatures rule out pairs that cannot reach the threshold
   and the rest is confirmed on the full sets. Members already connected
   are not compared, and only links that join two parts are returned, so at
   most one link per member and task. A group of many members is cut into
   blocks of bounded size and weight: first a few rounds of random blocks,
   which join most of a family of copies; then its largest part is set
   against the others, block by block. No task sees more than two blocks.
5. Connected components of the confirmed links, by alternating large-star
   and small-star steps on written tables.

With 28 bands of 6 rows a pair at the threshold of 0.85 shares no bucket with
probability ``(1 - 0.85**6)**28`` = 1.8e-6, one at 0.9 with 6e-10. The signature bound lies 4.5 standard deviations below the threshold.

Edge cases: a null, empty or blank text has an empty set, no link, and is
its own component. Repeated rows of a document id share its component, and
different texts under one id make one node. A row without id gets no
component and is kept. An empty table gives an empty result. Extra columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraudlens.llm.common import write_table

WORDS, PERCENT, BANDS, ROWS, SEED = 5, 85, 28, 6, 20240229
#: Members and shingles of a block, and rounds of random blocks in large groups.
BLOCK_DOCS, BLOCK_SHINGLES, ROUNDS = 512, 1_000_000, 2
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not w:
        return np.zeros(0, dtype=np.uint64)
    x = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    k = min(words, len(x))
    h = np.full(len(x) - k + 1, k, dtype=np.uint64)  # the length tells short texts from shingles
    for j in range(k):
        h = h * _MIX2 + x[j:len(x) - k + 1 + j]
        h ^= h >> np.uint64(32)
    h *= _MIX1
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _functions(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**64, size=n, dtype=np.uint64) | np.uint64(1)
    return a, rng.integers(0, 2**64, size=n, dtype=np.uint64)


def minima(sets: list[np.ndarray], n: int, seed: int = SEED) -> np.ndarray:
    """``n`` minima of each non-empty set under functions ``a * x + b mod 2**64``."""
    a, b = _functions(n, seed)
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out, buf = np.empty((len(sets), n), dtype=np.uint64), np.empty_like(x)
    for i in range(n):
        np.multiply(x, a[i], out=buf)
        np.add(buf, b[i], out=buf)
        out[:, i] = np.minimum.reduceat(buf, starts)
    return out


def signatures(docs: DataFrame, doc_id: str, text: str, words: int, bands: int, rows: int, seed: int) -> DataFrame:
    """Per row: id, hash of the text, set size, fingerprint of the set (two
    64-bit sums), bucket keys and signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                sets, weight, a = [], 0, at
                texts = whole.column(2)
                while at < whole.num_rows and len(sets) < 512 and weight < 100_000:  # fits the CPU's cache
                    sets.append(shingles(texts[at].as_py(), words))
                    weight, at = weight + len(sets[-1]), at + 1
                full = [i for i, s in enumerate(sets) if len(s)]
                keys = np.zeros((len(sets), bands), dtype=np.uint64)
                sig = np.zeros((len(sets), bands * rows), dtype=np.uint16)
                if full:
                    m = minima([sets[i] for i in full], bands * rows, seed)
                    sig[full] = (m >> np.uint64(40)).astype(np.uint16)
                    k = np.zeros((len(full), bands), dtype=np.uint64)
                    for r in range(rows):
                        k = (k ^ m.reshape(len(full), bands, rows)[:, :, r]) * _MIX1
                        k ^= k >> np.uint64(31)
                    keys[full] = k
                b = whole.slice(a, at - a)
                yield pa.RecordBatch.from_arrays([
                    b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)),
                    pa.array(np.array([((s ^ (s >> np.uint64(33))) * _MIX2).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1).view(np.int64))),
                    pa.array([s.tobytes() for s in sig], pa.binary()),
                ], names=["doc_id", "th", "n", "f1", "f2", "bands", "sig"])

    narrow = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("th"),
                         F.col(f"`{text}`").alias("t"))
    return narrow.mapInArrow(run, "doc_id long, th long, n long, f1 long, f2 long, bands array<long>, sig binary")


# --- connected components ------------------------------------------------


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u, v) with u > v. The minima are a written table,
    so a node with very many neighbours can be split over tasks."""
    near = edges.select("u", "v")
    if large:
        near = near.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = write_table(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "star-min")
    linked = near.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return write_table(out.where(F.col("u") != F.col("v")).distinct(), "star-edges")


def _settled(edges: DataFrame) -> bool:
    """Whether the links are stars: no node is on both sides, and each on
    the left has one link. One aggregate over (node, links left, right)."""
    sides = edges.select(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))
    per = sides.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return not per.agg(F.max((F.col("a") > 1) | ((F.col("a") > 0) & (F.col("b") > 0)))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (u, v); the component is
    its smallest node. Alternates large-star and small-star until each link
    points to its component, which is when all links are stars."""
    edges = write_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                        .where(F.col("u") != F.col("v")).distinct(), "links")
    while not _settled(edges):
        edges = _star(_star(edges, True), False)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


# --- confirmation --------------------------------------------------------


def confirm(members: list[tuple], percent: int, bound: float, words: int) -> list[tuple[int, int]]:
    """Links that join parts of one task's members: (node, block, label,
    signature, text). Pairs are compared within block 0, or across the two
    blocks if there are two; members with one label are already joined."""
    nodes = [m[0] for m in members]
    block = np.array([m[1] for m in members])
    sig = np.stack([np.frombuffer(m[3], dtype=np.uint16) for m in members])
    cross = block.min() != block.max()
    sets = [shingles(m[4], words) for m in members]
    size = np.array([len(s) for s in sets])
    code = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum([0, *size])
    ids = [code[a:b] for a, b in zip(ends, ends[1:])]
    mark = np.zeros(code.max() + 1 if len(code) else 1, dtype=bool)
    part = np.unique([m[2] for m in members], return_inverse=True)[1]
    links = []
    for i in range(len(members) - 1):
        rest = np.arange(i + 1, len(members))
        rest = rest[(part[rest] != part[i]) & (100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i]))]
        if cross:
            rest = rest[block[rest] != block[i]]
        if not len(rest):
            continue
        alike = (sig[rest] == sig[i]).mean(axis=1)
        rest = rest[alike >= bound]
        if not len(rest):
            continue
        mark[ids[i]] = True
        for j in rest[np.argsort(-alike[alike >= bound], kind="stable")].tolist():
            if part[j] == part[i]:
                continue
            both = int(np.count_nonzero(mark[ids[j]]))
            if 100 * both >= percent * (size[i] + size[j] - both):
                links.append((nodes[i], nodes[j]))
                part[part == part[j]] = part[i]
        mark[ids[i]] = False
    return links


def _confirmed(tasks: DataFrame, percent: int, bound: float, words: int) -> DataFrame:
    """``tasks``: rows (grp, bi, bj, blk, node, label, sig, t), one comparison
    for each (grp, bi, bj). Sorted partitions are read as streams, so many
    small groups share a task and only one is held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, out = None, [], []
        for batch in batches:
            for g, bi, bj, blk, node, label, sig, t in batch.itertuples(index=False, name=None):
                if (g, bi, bj) != key:
                    if len(held) > 1:
                        out += confirm(held, percent, bound, words)
                    key, held = (g, bi, bj), []
                held.append((node, blk, label, sig, t))
            if out:
                yield pd.DataFrame(out, columns=["u", "v"])
                out = []
        if len(held) > 1 and (out := confirm(held, percent, bound, words)):
            yield pd.DataFrame(out, columns=["u", "v"])

    return (tasks.select("grp", "bi", "bj", "blk", "node", "label", "sig", "t").repartition("grp", "bi", "bj")
            .sortWithinPartitions("grp", "bi", "bj", "node").mapInPandas(run, "u long, v long"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
                    bands: int = BANDS, rows: int = ROWS, seed: int = SEED, block_docs: int = BLOCK_DOCS,
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """One row per input row: ``doc_id``, ``th`` (hash of the text),
    ``n_shingles``, ``class_id`` (smallest id with the same set),
    ``component_id`` and ``kept``."""
    bound = max(0.0, percent / 100 - 4.5 * (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5)
    sigs = write_table(signatures(docs, doc_id, text, words, bands, rows, seed), "minhash")
    classes = write_table(sigs.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
                          .groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")), "classes")
    reps = sigs.join(classes.withColumnRenamed("rep", "doc_id").hint("merge"), ["doc_id", "n", "f1", "f2"], "left_semi")
    # a repeated row is one member; written, as three steps read it
    reps = write_table(reps.dropDuplicates(["doc_id", "n", "f1", "f2"]), "representatives")

    # (merge hints: documents and their texts are dealt by id at any size, so
    # that a run on a sample moves its share of what the whole table will move)
    # unverified links: each member of a bucket to the smallest one
    slots = reps.select(F.col("doc_id").alias("node"), F.posexplode("bands").alias("band", "key"))
    buckets = write_table(slots.groupBy("band", "key").agg(F.min("node").alias("head"), F.max("node").alias("last"))
                          .where(F.col("head") != F.col("last")).drop("last"), "buckets")
    loose = slots.join(buckets, ["band", "key"]).where(F.col("node") != F.col("head")).select(
        F.col("node").alias("u"), F.col("head").alias("v"))
    groups = components(loose)
    # the texts of members only, written once for all that compares them
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("node"), F.xxhash64(F.col(f"`{text}`")).alias("th"),
                        F.col(f"`{text}`").alias("t"))
    found = groups.join(reps.select(F.col("doc_id").alias("node"), "th", "n", "sig"), "node")
    members = write_table(found.join(texts.hint("merge"), ["node", "th"]).dropDuplicates(["node", "th"]), "members")
    blocks = lambda n, w: F.ceil(F.greatest(n / block_docs, w / block_shingles)).cast("int")
    sized = members.groupBy("comp").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("weight"))
    big = write_table(sized.select("comp", blocks(F.col("docs"), F.col("weight")).alias("nb")).where("nb > 1"), "large-groups")
    some = not big.isEmpty()
    links = None
    labels = None
    if some:  # random blocks in the large groups
        inside = members.join(big, "comp")
        tasks = inside.withColumn("round", F.explode(F.array(*map(F.lit, range(ROUNDS))))).select(
            F.col("comp").alias("grp"), (-1 - F.col("round")).alias("bi"),
            F.pmod(F.xxhash64("node", "round"), "nb").cast("int").alias("bj"), F.lit(0).alias("blk"),
            "node", F.col("node").alias("label"), "sig", "t")
        links = write_table(_confirmed(tasks, percent, bound, words), "block-links")
        labels = components(links).withColumnRenamed("comp", "label")

    # every group: blocks of its largest part (m) against those of the others (s)
    if some:
        part = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        parts = part.groupBy("comp", "label").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("weight"))
        largest = (parts.join(big.select("comp"), "comp").groupBy("comp").agg(
            F.max(F.struct("docs", "label", "weight")).alias("top"), F.sum("docs").alias("docs"), F.sum("weight").alias("weight"))
            .select("comp", F.col("top.label").alias("main"), blocks(F.col("top.docs"), F.col("top.weight")).alias("nm"),
                    blocks(F.col("docs") - F.col("top.docs"), F.col("weight") - F.col("top.weight")).alias("ns")))
        part = part.join(write_table(largest, "main-parts"), "comp", "left").withColumns(
            {"nm": F.coalesce("nm", F.lit(0)), "ns": F.coalesce("ns", F.lit(1))})
        main = F.coalesce(F.col("label") == F.col("main"), F.lit(False))
    else:
        part = members.withColumns({"label": F.col("node"), "nm": F.lit(0), "ns": F.lit(1)})
        main = F.lit(False)
    own = F.when(main, F.col("ns") + F.pmod(F.xxhash64("node"), "nm")).otherwise(F.pmod(F.xxhash64("node"), F.greatest("ns", F.lit(1)))).cast("int")
    last = F.when(main, F.col("ns")).otherwise(F.col("ns") + F.col("nm"))  # main blocks meet only the others
    tasks = (part.withColumn("blk", own)
             .withColumn("other", F.explode(F.when(last > 0, F.sequence(F.lit(0), last.cast("int") - 1)).otherwise(F.array().cast("array<int>"))))
             .select(F.col("comp").alias("grp"), F.least("blk", "other").alias("bi"), F.greatest("blk", "other").alias("bj"),
                     "blk", "node", "label", "sig", "t"))
    found = write_table(_confirmed(tasks, percent, bound, words), "links")
    comps = components(found if links is None else found.unionByName(links))

    rep = classes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    rows_ = sigs.select("doc_id", "th", "n", "f1", "f2").join(write_table(rep, "class-components"), ["n", "f1", "f2"], "left")
    # different texts under one id make one node: the id's own component is the smallest of them
    return rows_.select(
        "doc_id", "th", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def minhash_query(docs: DataFrame) -> DataFrame:
    """Contract of ``op4``."""
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
