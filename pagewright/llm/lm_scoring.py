"""Language-model scoring with a log-frequency Bloom filter.

A bigram model is learned from the training documents. Bigram counts are quantised on a
logarithmic scale and held in a Bloom filter: a bigram of level q is put in q times, with the
levels 1 to q. A count is read back by repeated membership probes, level by level until one
fails. The conditional probability is

    p(w | h) = a * count(h w) / count(h) + (1 - a) * (count(w) + 1) / (N + V + 1)

where a is the Witten-Bell weight of all histories with as many binary digits in their count as
h has: tokens / (tokens + distinct bigrams). Quantised counts are rounded down, so the
probabilities of all words after h add up to at most one, but for the filter's false positives.

Unigram counts are exact. Documents are packed into blocks of bounded size, each with its own
vocabulary; a block's vocabulary goes to count shards by hash range, and the totals come back to
the block. So no table of words is broadcast or gathered.

The filter grows with the corpus, so no size of it is proven and it is not broadcast whole: it is
cut into shards by bigram hash, and a block's bigrams go to their shard, which is built, probed
for all blocks in one pass, and answers with levels. Nothing is collected by the driver but sums.

Defined results for odd input: a null or empty text is one end token; a null doc_id is the
empty text to the split rule; repeated rows are counted and scored as often as they occur; an
empty table gives an empty table. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialise, release, table, text_or_empty
from .minhash_dedup import WordHashes, _mix

BLOCK_BYTES = 4 << 20
#: Vocabulary entries and bigrams per reducing shard, about.
SHARD_WORDS, SHARD_BIGRAMS = 2_000_000, 3_000_000
#: Bits of filter per inserted level, and bits set for it within one 64-bit word.
BITS, SET = 10, 4
END, BEGIN = 0x656E642D746F6B65, 0x626567696E2D746F
#: The quantised counts: powers of two and the values halfway between.
LEVELS = np.array([1, 2] + [v for k in range(1, 44) for v in (3 * 2 ** (k - 1), 2 ** (k + 1))], np.int64)
_BINS = 48
_words = WordHashes(250_000)

BLOCKS = "block long, doc_ids binary, held_out binary, lengths binary, tokens binary, vocab binary, counts binary, entries long"


def _pack(raw: bytes) -> bytes:
    """Compressed, so that what is shuffled is no larger than what is written."""
    return struct.pack("<Q", len(raw)) + pa.compress(raw, "zstd", asbytes=True)


def _unpack(packed: pa.Buffer | bytes) -> bytes:
    (n,) = struct.unpack_from("<Q", packed)
    return pa.decompress(memoryview(packed)[8:], n, "zstd", asbytes=True)


def _bytes_of(x: np.ndarray) -> bytes:
    """The bytes of integers, plane by plane: those of small ones are zero but for the first."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _from_bytes(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one at a time; binary values are views of the batch, not copies."""
    for k in range(batch.num_rows):
        row = {}
        for name, column in zip(batch.schema.names, batch.columns, strict=True):
            v = column[k]
            row[name] = v.as_buffer() if pa.types.is_binary(column.type) else v.as_py()
        yield row


def held_out(doc_id: int | None, parts: int = 7, part: int = 2) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts == part


def _by_count(counts: np.ndarray) -> np.ndarray:
    """The places of a block's vocabulary, words with the most training tokens first."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _pack_tokens(tokens: np.ndarray, counts: np.ndarray) -> bytes:
    """Token places as ranks by count, byte plane by plane: most bytes are then small or zero."""
    rank = np.empty(len(counts), np.uint32)
    rank[_by_count(counts)] = np.arange(len(counts), dtype=np.uint32)
    width = max(1, -(-int(len(counts) - 1).bit_length() // 8))
    return np.ascontiguousarray(rank[tokens].view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def _unpack_tokens(raw: bytes, n: int, counts: np.ndarray) -> np.ndarray:
    rank = np.zeros(n, np.uint32)
    for k, plane in enumerate(np.frombuffer(raw, np.uint8).reshape(-1, n) if n else ()):
        rank |= plane.astype(np.uint32) << np.uint32(8 * k)
    return _by_count(counts)[rank]


def _blocks(docs: DataFrame) -> DataFrame:
    """Documents packed into blocks: token ranks, and the block's sorted vocabulary of word hashes with training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, words, lengths, size = [], [], [], 0
        end = END.to_bytes(8, "little")

        def flush() -> pa.RecordBatch:
            nonlocal ids, words, lengths, size, number
            vocab, tokens = np.unique(np.frombuffer(b"".join(words), np.uint64), return_inverse=True)
            out, n = np.array([held_out(i) for i in ids]), np.array(lengths, np.uint32)
            counts = np.bincount(tokens[np.repeat(~out, n)], minlength=len(vocab)).astype(np.uint32)
            known = np.array([-(1 << 63) if i is None else i for i in ids], np.int64)
            row = [number, known.tobytes(), out.tobytes(), n.tobytes(), _pack(_pack_tokens(tokens, counts)), _pack(_planes(vocab)), _pack(_bytes_of(counts))]
            number += 1
            ids, words, lengths, size = [], [], [], 0
            arrays = [pa.array([row[0]], pa.int64()), *(pa.array([x], pa.binary()) for x in row[1:]), pa.array([len(vocab)], pa.int64())]
            return pa.RecordBatch.from_arrays(arrays, names=["block", "doc_ids", "held_out", "lengths", "tokens", "vocab", "counts", "entries"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                got = b"".join(map(_words.__getitem__, text.lower().split())) + end
                ids.append(doc_id)
                words.append(got)
                lengths.append(len(got) // 8)
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    return docs.mapInArrow(run, BLOCKS)


def _shard_cuts(sorted_hashes: np.ndarray, shards: int) -> np.ndarray:
    """Where each hash range begins and ends in a sorted array."""
    edges = np.array([(k << 64) // shards for k in range(1, shards)], np.uint64)
    return np.concatenate([[0], np.searchsorted(sorted_hashes, edges), [len(sorted_hashes)]])


def _pieces(sorted_hashes: np.ndarray, shards: int) -> tuple[list[int], list[tuple[int, int]]]:
    """The hash ranges with entries, and where each begins and ends: never more rows than entries."""
    cut = _shard_cuts(sorted_hashes, shards)
    some = np.flatnonzero(cut[1:] > cut[:-1])
    return some.tolist(), list(zip(cut[some].tolist(), cut[some + 1].tolist(), strict=True))


def _planes(x: np.ndarray) -> bytes:
    """Ascending 64-bit integers as differences, byte plane by plane: the high planes are then zero."""
    return _bytes_of(np.diff(x, prepend=np.uint64(0)))


def _from_planes(raw: bytes) -> np.ndarray:
    return np.cumsum(_from_bytes(raw, np.uint64), dtype=np.uint64)


def _totals(blocks: DataFrame, shards: int) -> DataFrame:
    """(shard, block, totals, distinct): each block's words of a hash range with corpus counts."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                vocab, counts = _from_planes(_unpack(row["vocab"])), _from_bytes(_unpack(row["counts"]), np.uint32)
                some, parts = _pieces(vocab, shards)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), pa.array([_pack(_planes(vocab[a:b])) for a, b in parts], pa.binary()), pa.array([_pack(_bytes_of(counts[a:b])) for a, b in parts], pa.binary())], names=["shard", "block", "words", "counts"])

    def add(t: pa.Table) -> pa.Table:
        words = [_from_planes(_unpack(w)) for w in t.column("words").to_pylist()]
        counts = np.concatenate([_from_bytes(_unpack(c), np.uint32) for c in t.column("counts").to_pylist()])
        every, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, counts, minlength=len(every)).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        distinct = [int((total > 0).sum())] + [0] * (len(words) - 1)
        totals = [_pack(_bytes_of(total[place[e - len(w) : e]])) for w, e in zip(words, ends.tolist(), strict=True)]
        return pa.table({"shard": t.column("shard"), "block": t.column("block"), "totals": pa.array(totals, pa.binary()), "distinct": pa.array(distinct, pa.int64())})

    pieces = blocks.select("block", "vocab", "counts").mapInArrow(split, "shard int, block long, words binary, counts binary")
    return pieces.groupBy("shard").applyInArrow(add, "shard int, block long, totals binary, distinct long")


def _bigrams(row: dict, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bigram keys, history counts, token counts, token lengths by document, held out)."""
    n = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
    tokens = _unpack_tokens(_unpack(row["tokens"]), int(n.sum()), _from_bytes(_unpack(row["counts"]), np.uint32))
    vocab, totals = _from_planes(_unpack(row["vocab"])), np.concatenate([_from_bytes(_unpack(x), np.int64) for x in row["totals"]])
    hashes, count = vocab[tokens], totals[tokens]
    history, seen = np.empty_like(hashes), np.empty_like(count)
    history[1:], seen[1:] = hashes[:-1], count[:-1]
    first = np.concatenate([[0], np.cumsum(n)[:-1]])
    history[first], seen[first] = BEGIN, begin
    keys = _mix(history * np.uint64(0x9E3779B97F4A7C15) + hashes * np.uint64(0xC2B2AE3D27D4EB4F))
    return keys, seen, count, n, np.frombuffer(row["held_out"], bool)


def _bin(counts: np.ndarray) -> np.ndarray:
    """Binary digits of a count."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.uint8)


def _places(keys: np.ndarray, level: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of the filter, bits in it) of keys at a level."""
    h = _mix(keys + np.uint64(level * 0xA0761D6478BD642F & (1 << 64) - 1))
    mask = np.zeros(len(h), np.uint64)
    for k in range(SET):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return ((h >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32), mask


def build_filter(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter words of distinct bigram keys with their counts."""
    level = np.searchsorted(LEVELS, counts, side="right")
    words = np.zeros(max(1, -(-int(level.sum()) * BITS // 64)), np.uint64)
    for q in range(1, int(level.max(initial=0)) + 1):
        at, mask = _places(keys[level >= q], q, len(words))
        np.bitwise_or.at(words, at.astype(np.int64), mask)
    return words


def probe_filter(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The quantised counts of keys: probes by rising level until one fails."""
    out, live, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
    while len(live) and level <= len(LEVELS):
        at, mask = _places(keys[live], level, len(words))
        live = live[(words[at.astype(np.int64)] & mask) == mask]
        out[live] = LEVELS[level - 1]
        level += 1
    return out


def _levels(blocks: DataFrame, shards: int, begin: int) -> DataFrame:
    """(shard, block, levels, distinct): the filter's levels of each block's bigrams of a hash range.

    A shard of the filter is built from the training counts of all blocks and then probed for the
    distinct bigrams of all blocks, in ascending key order. distinct has the shard's training
    bigrams by history bin, in one of its rows.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                keys, seen, _, n, out = _bigrams(row, begin)
                keys, first, at = np.unique(keys, return_index=True, return_inverse=True)
                counts = np.bincount(at[np.repeat(~out, n)], minlength=len(keys)).astype(np.uint32)
                bins = _bin(seen[first])
                some, parts = _pieces(keys, shards)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), *(pa.array([f(a, b) for a, b in parts], pa.binary()) for f in (lambda a, b: _pack(_planes(keys[a:b])), lambda a, b: _pack(_bytes_of(counts[a:b])), lambda a, b: _pack(bins[a:b].tobytes())))], names=["shard", "block", "keys", "counts", "bins"])

    def build_and_probe(t: pa.Table) -> pa.Table:
        pieces = [_from_planes(_unpack(k)) for k in t.column("keys").to_pylist()]
        counts = np.concatenate([_from_bytes(_unpack(c), np.uint32) for c in t.column("counts").to_pylist()])
        bins = np.concatenate([np.frombuffer(_unpack(b), np.uint8) for b in t.column("bins").to_pylist()])
        every, first, place = np.unique(np.concatenate(pieces), return_index=True, return_inverse=True)
        total = np.bincount(place, counts, minlength=len(every)).astype(np.int64)
        trained = total > 0
        words = build_filter(every[trained], total[trained])
        raw = np.searchsorted(LEVELS, probe_filter(words, every), side="right").astype(np.uint8)[place].tobytes()
        ends = np.cumsum([len(p) for p in pieces]).tolist()
        distinct = [np.bincount(bins[first[trained]], minlength=_BINS).tolist()] + [None] * (len(pieces) - 1)
        return pa.table({"shard": t.column("shard"), "block": t.column("block"), "levels": pa.array([_pack(raw[e - len(p) : e]) for p, e in zip(pieces, ends, strict=True)], pa.binary()), "distinct": pa.array(distinct, pa.list_(pa.int64()))})

    pieces = blocks.mapInArrow(split, "shard int, block long, keys binary, counts binary, bins binary")
    return pieces.groupBy("shard").applyInArrow(build_and_probe, "shard int, block long, levels binary, distinct array<long>")


def _history_tokens(blocks: DataFrame, begin: int) -> np.ndarray:
    """Training tokens by bin of their history's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_BINS, np.int64)
        for batch in batches:
            for row in _rows(batch):
                _, seen, _, n, out = _bigrams(row, begin)
                total += np.bincount(_bin(seen[np.repeat(~out, n)]), minlength=_BINS)
        yield pa.RecordBatch.from_arrays([pa.array(range(_BINS), pa.int32()), pa.array(total)], names=["bin", "n"])

    sums = {r["bin"]: r["n"] for r in blocks.mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()}  # one row per bin
    return np.array([sums.get(b, 0) for b in range(_BINS)], np.float64)


def _gathered(pieces: DataFrame, value: str) -> DataFrame:
    """(block, value): the pieces of a block in the order of their shards."""
    return pieces.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", value))), lambda x: x[value]).alias(value))


def _scores(blocks: DataFrame, weights: np.ndarray, begin: int, n_tokens: int, n_types: int) -> DataFrame:
    """Per document the sums over its tokens, from blocks with the totals of their words and the levels of their bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                keys, seen, count, n, out = _bigrams(row, begin)
                base = (count + 1) / (n_tokens + n_types + 1)
                # a false positive never exceeds what history and word allow
                level = np.frombuffer(b"".join(map(_unpack, row["levels"])), np.uint8)[np.unique(keys, return_inverse=True)[1]]
                together = np.where(level > 0, np.minimum(LEVELS[np.maximum(level, 1) - 1], np.minimum(seen, count)), 0)
                a = weights[_bin(seen)]
                score = np.log10(a * together / np.maximum(seen, 1) + (1 - a) * base)
                starts = np.concatenate([[0], np.cumsum(n)[:-1]])
                docs = np.frombuffer(row["doc_ids"], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, mask=docs == -(1 << 63)),
                        pa.array(out),
                        pa.array(n),
                        pa.array(np.add.reduceat((count > 0).astype(np.int64), starts)),
                        pa.array(np.add.reduceat(np.log10(base), starts)),
                        pa.array(np.add.reduceat(score, starts)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
                )

    return blocks.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    raw = materialise(_blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))), "lm-blocks")
    entries = int(raw.agg(F.sum("entries")).first()[0] or 0)
    shards = max(1, -(-entries // SHARD_WORDS))
    totals = materialise(_totals(raw, shards), "lm-totals")
    blocks = materialise(raw.join(_gathered(totals, "totals"), "block"), "lm-counted")
    n_types = int(totals.agg(F.sum("distinct")).first()[0] or 0)
    drop_table(docs.sparkSession, raw)
    drop_table(docs.sparkSession, totals)
    del raw, totals
    release(docs.sparkSession)
    # training documents, training tokens: sums over blocks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = t = every = 0
        for batch in batches:
            for lengths, out in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, train = np.frombuffer(lengths, np.uint32), ~np.frombuffer(out, bool)
                d, t, every = d + int(train.sum()), t + int(n[train].sum()), every + int(n.sum())
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (d, t, every)], names=["d", "t", "every"])

    sums = blocks.select("lengths", "held_out").mapInArrow(count, "d long, t long, every long").agg(F.sum("d"), F.sum("t"), F.sum("every")).first()
    begin, n_tokens, tokens = (int(x or 0) for x in sums)
    cuts = max(1, -(-tokens // SHARD_BIGRAMS))
    levels = materialise(_levels(blocks, cuts, begin), "lm-levels")
    release(docs.sparkSession)
    sums = {r["pos"]: r["n"] for r in levels.select(F.posexplode("distinct")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}  # one row per bin
    distinct, seen = np.array([sums.get(b, 0) for b in range(_BINS)], np.float64), _history_tokens(blocks, begin)
    weights = seen / np.maximum(seen + distinct, 1)
    weights[0] = 0
    out = _scores(blocks.join(_gathered(levels, "levels"), "block"), weights, begin, n_tokens, n_types)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
