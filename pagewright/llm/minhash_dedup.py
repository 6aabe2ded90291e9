"""Near-duplicate documents by MinHash, banding, signature and set checks, and components.

1. Each document becomes its set of word-shingle hashes and many universal-hash minima of it.
   Equal sets form one class, so exact copies never meet each other again.
2. The minima are cut into bands; classes with an equal band share a bucket. In each bucket every
   class is compared with one pivot, the class with most company in its buckets, which in a group
   of near copies is close to their origin: first by signature, then on the full shingle sets.
3. Alternating large-star and small-star give the components of the links found.
4. Buckets whose classes still lie in several components may hide links that the pivot doesn't
   see. Their classes get longer signatures and are dealt into clusters that share buckets (large
   ones in pairs of blocks); within a cluster, pairs across components of a bucket are compared by
   signature, and only those that may reach the similarity become rows and are checked on the
   full sets. Links within a component cannot change the result and are not looked for.

Two sets that reach 0.8 miss all 32 bands of 4 rows with a probability below 5e-8.

Defined results for odd input: a null or empty text has the empty set and is a component of its
own; repeated rows fall into one component and keep their id's verdict; null doc_ids come after all
others, and where a component has no other they all stay; an empty table gives an empty table. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import text_slices
from .common import broadcast_if_small, drop_table, materialise, table, text_or_empty
from .components import components

#: Words remembered per worker with their hashes.
MEMORY_WORDS = 400_000
#: Members of a verification group.
GROUP = 256
#: Minima of the longer signatures, and classes of a cluster that are compared in one task.
LONG, BLOCK = 1024, 2048
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class WordHashes(dict):
    """word -> 8 bytes of its 64-bit hash, remembered up to a bound."""

    def __init__(self, most: int = MEMORY_WORDS):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh64_intdigest(word).to_bytes(8, "little")
        if len(word) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[word] = h
        return h


_words = WordHashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text; A-Z count as a-z."""
    words = np.frombuffer(b"".join(map(_words.__getitem__, text.lower().split())), np.uint64)
    n = len(words)
    if n == 0:
        return words
    if n < size:
        return _mix(np.sum(words * _MULTIPLIERS[:n], keepdims=True, dtype=np.uint64) + np.uint64(n))
    total = words[: n - size + 1] * _MULTIPLIERS[0]
    for k in range(1, size):
        total = total + words[k : n - size + 1 + k] * _MULTIPLIERS[k]
    return np.unique(_mix(total))


def hash_family(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n multiply-shift hashes."""
    rng = np.random.default_rng(seed)
    return (rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1))[:, None], rng.integers(0, 1 << 64, n, np.uint64)[:, None]


def signature(hashes: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The high 32 bits of each universal hash's minimum over the set."""
    least = None
    for k in range(0, len(hashes), 1024):
        m = (family[0] * hashes[None, k : k + 1024] + family[1]).min(axis=1)
        least = m if least is None else np.minimum(least, m)
    return (least >> np.uint64(32)).astype(np.uint32)


def node_of(hashes: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64)))


def _signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = hash_family(bands * rows)
        for batch in (part for whole in batches for part in text_slices(whole, 1)):
            n, nodes, sigs = [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                s = shingles(text, size)
                n.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                sigs.append(signature(s, family).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sigs, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "node", "sig"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, node long, sig binary")


def _buckets(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, node, n) for every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, bands, rows).astype(np.uint64)
            key = (sig * _MULTIPLIERS[np.arange(rows) % 8]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)
            yield pa.RecordBatch.from_arrays([pa.array(_mix(key.ravel()).view(np.int64)), pa.array(np.repeat(node, bands)), pa.array(np.repeat(n, bands))], names=["key", "node", "n"])

    return classes.select("node", "n", "sig").mapInArrow(run, "key long, node long, n long")


def _agreeing(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree in a share of at least ``least`` (bounded work: no sets yet)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (4, 5))
            keep = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(4)], names=["a", "b", "ca", "cb"])

    left = classes.select(F.col("node").alias("a"), F.col("sig").alias("x"))
    right = classes.select(F.col("node").alias("b"), F.col("sig").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ca", "cb", "x", "y").mapInArrow(run, "a long, b long, ca long, cb long")


def least_share(percent: int, minima: int) -> float:
    """Sets at the similarity agree in fewer minima than this share with a probability below 1e-5."""
    share = percent / 100
    return share - 4.5 * (share * (1 - share) / minima) ** 0.5


def _near_in_cluster(rows: list[tuple], percent: int, first: int) -> list[tuple[int, int, int, int]]:
    """(a, b, component of a, of b) of pairs across components that share a bucket and agree by signature.

    rows are (node, component, n, keys, signature, block, i, j); with i and j different, only pairs
    of the two blocks are looked at.
    """
    component, n, block = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 5))
    apart = rows[0][6] != rows[0][7]
    buckets: dict[int, list[int]] = {}
    for k, r in enumerate(rows):
        for key in r[3]:
            buckets.setdefault(key, []).append(k)
    found = []
    for members in buckets.values():
        v = np.array(members)
        c = component[v]
        if len(v) < 2 or (c == c[0]).all():
            continue
        small, large = np.minimum(n[v][:, None], n[v][None, :]), np.maximum(n[v][:, None], n[v][None, :])
        meet = np.triu((c[:, None] != c[None, :]) & (100 * small >= percent * large), 1)
        if apart:
            meet &= block[v][:, None] != block[v][None, :]
        x, y = np.nonzero(meet)
        found.append(v[x] * len(rows) + v[y])
    if not found:
        return []
    pairs = np.unique(np.concatenate(found))
    sigs = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(len(rows), -1)
    for minima in (first, sigs.shape[1]):
        keep = []
        for lo in range(0, len(pairs), 8192):
            part = pairs[lo : lo + 8192]
            same = (sigs[part // len(rows), :minima] == sigs[part % len(rows), :minima]).mean(axis=1)
            keep.append(part[same >= least_share(percent, minima)])
        pairs = np.concatenate(keep) if keep else pairs
    return [(rows[x][0], rows[y][0], rows[x][1], rows[y][1]) for x, y in zip((pairs // len(rows)).tolist(), (pairs % len(rows)).tolist(), strict=True)]


def _across(live: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int, first: int) -> DataFrame:
    """(a, b, ca, cb): pairs across components of the live buckets that agree by long signatures."""
    least = live.groupBy("key").agg(F.min("node").alias("b"))
    clusters = components(live.select("key", F.col("node").alias("a")).join(least, "key").select("a", "b").distinct(), "minhash-clusters").withColumnRenamed("component", "cluster")
    nodes = live.groupBy("node").agg(F.first("component").alias("component"), F.first("n").alias("n"), F.collect_list("key").alias("keys")).join(clusters, "node").join(classes.select("node", "rep"), "node")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    needed = materialise(nodes.join(sizes, "cluster"), "minhash-open")
    joined = docs.join(broadcast_if_small(needed, "keys"), docs["doc_id"].eqNullSafe(needed["rep"])).select("text", "node", "component", "n", "keys", "cluster", "blocks")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = hash_family(LONG)
        for batch in (part for whole in batches for part in text_slices(whole, 0)):
            sets = [shingles(t, size) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            right = pa.array([len(s) > 0 and node_of(s) == node for s, node in zip(sets, batch.column(1).to_pylist(), strict=True)], pa.bool_())
            sigs = pa.array([signature(s, family).tobytes() if ok else None for s, ok in zip(sets, right.to_pylist(), strict=True)], pa.binary())
            out = pa.RecordBatch.from_arrays([*batch.columns[1:], sigs], names=[*batch.schema.names[1:], "sig"])
            yield out.filter(right)

    signed = joined.mapInArrow(sign, "node long, component long, n long, keys array<long>, cluster long, blocks int, sig binary")
    block = F.pmod("node", "blocks").cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = signed.withColumn("block", block).withColumn("p", F.explode(others)).select("node", "component", "n", "keys", "sig", "block", "p.i", "p.j", "cluster").repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            found = _near_in_cluster(held, percent, first)
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in range(4)], names=["a", "b", "ca", "cb"])

        for batch in (part for whole in batches for part in text_slices(whole, 4)):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[-1][6:] != row[6:]:
                    yield flush()
                    held = []
                if held and held[-1][0] == row[0]:  # identical rows give a class twice
                    continue
                held.append(row)
        if held:
            yield flush()

    return dealt.mapInArrow(compare, "a long, b long, ca long, cb long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The components (a, b) of pairs (a, pivot b) whose full sets reach the similarity.

    A pivot's members are dealt to groups of bounded size; the pivot's set goes to each of its
    groups and stands first there, so a task holds one set at a time.
    """
    counted = pairs.join(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("c")), "b").withColumn("part", F.pmod(F.xxhash64("a"), F.ceil(F.col("c") / GROUP)).cast("int"))
    counted = materialise(counted, "minhash-dealt")  # read twice
    members = counted.select(F.col("a").alias("node"), F.col("b").alias("pivot"), "part", F.lit(1).alias("role"), F.col("ca").alias("of"))
    pivots = counted.select(F.col("b").alias("node"), F.col("b").alias("pivot"), "part", F.lit(0).alias("role"), F.col("cb").alias("of")).distinct()
    targets = members.union(pivots).groupBy("node").agg(F.collect_list(F.struct("pivot", "part", "role", "of")).alias("targets"))
    needed = materialise(targets.join(classes.select("node", "rep"), "node"), "minhash-targets")
    texts = docs.join(broadcast_if_small(needed, "targets"), docs["doc_id"].eqNullSafe(needed["rep"])).select("text", "node", F.explode("targets").alias("t")).select("node", "t.pivot", "t.part", "t.role", "t.of", "text")

    dealt = texts.repartition("pivot", "part").sortWithinPartitions("pivot", "part", "role")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine, root = None, None, None
        for batch in (part for whole in batches for part in text_slices(whole, 5)):
            a, b = [], []
            columns = [batch.column(k).to_pylist() for k in range(5)]
            for node, pivot, part, role, of, text in zip(*columns, batch.column(5).cast(pa.binary()).to_pylist(), strict=True):
                s = shingles(text, size)
                if node_of(s) != node:  # another row with the same doc_id
                    continue
                if role == 0:
                    held, mine, root = (pivot, part), s, of
                elif held == (pivot, part):
                    at = np.searchsorted(mine, s)
                    at[at == len(mine)] = 0
                    both = int((mine[at] == s).sum())
                    if 100 * both >= percent * (len(s) + len(mine) - both):
                        a.append(of)
                        b.append(root)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(check, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 80, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash, kept for every row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    signed = materialise(_signatures(docs.withColumn("text_hash", F.xxhash64("text")), size, bands, rows), "minhash-signatures")
    classes = materialise(signed.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")), "minhash-classes")
    shared = _buckets(classes, bands, rows)
    open_keys = shared.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key")
    members = materialise(shared.join(open_keys, "key").withColumn("component", F.col("node")), "minhash-buckets")
    near = F.least("n", "m") * 100 >= F.greatest("n", "m") * percent
    company = members.join(members.groupBy("key").agg(F.count(F.lit(1)).alias("c")), "key").groupBy("node").agg(F.sum("c").alias("company"))
    order = F.struct(-F.col("company"), "node", "n", "component")
    pivot = members.join(company, "node").groupBy("key").agg(F.min(order).alias("p")).select("key", F.col("p.node").alias("b"), F.col("p.n").alias("m"), F.col("p.component").alias("cb"))
    pairs = members.join(pivot, "key").filter((F.col("node") != F.col("b")) & near).select(F.col("node").alias("a"), "b", F.col("component").alias("ca"), "cb").distinct()
    agreed = materialise(_agreeing(pairs, classes, least_share(percent, bands * rows)), "minhash-pairs")
    labels = None  # node to component, of nodes that have links
    if not agreed.isEmpty():
        links = materialise(_verified(agreed, docs, classes, size, percent).distinct(), "minhash-links")
        labels = materialise(components(links, "minhash-star"), "minhash-components")
        now = members.drop("component").join(labels, "node", "left").select("key", "node", "n", F.coalesce("component", "node").alias("component"))
        apart = now.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q").select("key")
        live = materialise(now.join(apart, "key"), "minhash-live")
        more = None
        if not live.isEmpty():
            more = materialise(_across(live, docs, classes, size, percent, bands * rows), "minhash-pairs")
        if more is not None and not more.isEmpty():
            new = materialise(_verified(more, docs, classes, size, percent).distinct(), "minhash-links")
            moved = materialise(components(new, "minhash-star"), "minhash-components").select(F.col("node").alias("component"), F.col("component").alias("to"))
            own = moved.select(F.col("component").alias("node"), F.col("to").alias("component")).join(labels.select("node"), "node", "left_anti")
            labels = materialise(labels.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")).union(own), "minhash-labels")
    out = signed.select("doc_id", "n_shingles", "text_hash", "node")
    if labels is not None:
        out = out.join(labels, "node", "left").withColumn("node", F.coalesce("component", "node"))
    ids = out.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("component_id"))
    joined = out.filter("node is not null").join(ids, "node").select("doc_id", "n_shingles", "component_id", "text_hash")
    empty = out.filter("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "text_hash")
    return joined.union(empty).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the least id."""
    kept = near_duplicates(docs, id_col, text_col, **how).filter("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash")).distinct()
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_kept_id")) & (F.xxhash64(text_or_empty(text_col)) == F.col("_kept_hash"))
    return docs.join(kept, same, "left_semi")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' ')) END) AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS a, doc_id AS c FROM s UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, c AS component_id, s.doc_id = c AS kept
FROM s JOIN (SELECT a, min(c) AS c FROM r GROUP BY a) m ON m.a = s.doc_id
"""
