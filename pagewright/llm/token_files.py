"""Token-id files as directly addressable codes (DAC).

Each id is split into chunks of eight bits, lowest first. Level l holds the l-th chunk of every
id that has one, and a bitmap that says whether the id goes on; a rank directory (ones before
every 512th bit) turns a place in one level into the place in the next. So the id at any place
is read by one rank per level, without decoding what stands before it.

A file set is a Parquet folder of segments in ascending (shard, segment), shards being ranges
of doc_id: doc ids and ends within the segment, and the code itself, which is not compressed, so
that its bytes are addressed as they lie in the file. Documents are never split over segments.
``read_token_files`` reads each document as a range of its segment's code; ``read_places`` reads
single tokens of the whole file set by their place in it.

Defined results for odd input: a null text is empty and holds only the end id; rows with equal
doc_id stay together, ordered by text; null doc_ids come first; an empty table gives an empty
file set and an empty result.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import parts
from .common import scratch_path, table, text_or_empty

MAGIC = b"PWDAC001"
RANK_BITS = 512
SEGMENT_TOKENS = 1 << 19
#: Single places read at a time, and places of a segment that one row asks for.
PLACES_AT_ONCE = 1 << 12
#: Chunks up to this many bytes are remembered by the encoder, so many at most.
MEMORY_BYTES, MEMORY_CHUNKS = 64, 1_300_000
#: Plain words encoded as one text.
WORDS_AT_ONCE = 500
SEGMENTS = "shard int, segment int, shard_start long, n_tokens long, doc_ids binary, ends binary, code binary"


def dac_encode(ids: np.ndarray) -> bytes:
    """The directly addressable code of unsigned 32-bit ids."""
    levels, rest = [], np.ascontiguousarray(ids, np.uint32)
    while len(rest):
        chunk, rest = (rest & 255).astype(np.uint8), rest >> 8
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // RANK_BITS) * RANK_BITS, np.uint32)
        padded[: len(more)] = more
        ranks = np.concatenate([[0], np.cumsum(padded.reshape(-1, RANK_BITS).sum(1))[:-1]]).astype(np.uint32)
        levels.append((len(chunk), chunk.tobytes(), bits.tobytes(), ranks.tobytes()))
        rest = rest[more]
    head = MAGIC + struct.pack("<QB", len(ids), len(levels))
    return head + b"".join(struct.pack("<QQQ", n, len(b), len(r)) for n, _, b, r in levels) + b"".join(c + b + r for _, c, b, r in levels)


class Dac:
    """Reader of one code: random access by rank, or all ids at once."""

    def __init__(self, code: bytes):
        if code[:8] != MAGIC:
            raise ValueError("not a directly addressable code")
        self.n, n_levels = struct.unpack_from("<QB", code, 8)
        at, sizes = 17, []
        for _ in range(n_levels):
            sizes.append(struct.unpack_from("<QQQ", code, at))
            at += 24
        self.levels = []
        for n, b, r in sizes:
            self.levels.append((np.frombuffer(code, np.uint8, n, at), np.frombuffer(code, np.uint8, b, at + n), np.frombuffer(code, np.uint32, r // 4, at + n + b)))
            at += n + b + r

    def __getitem__(self, i: int) -> int:
        return int(self.gather(np.array([i]))[0])

    def gather(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places, each by one rank per level."""
        at = np.asarray(places, np.int64)
        if len(at) > PLACES_AT_ONCE:
            return np.concatenate([self.gather(at[k : k + PLACES_AT_ONCE]) for k in range(0, len(at), PLACES_AT_ONCE)])
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("place outside the code")
        out, live = np.zeros(len(at), np.uint32), np.arange(len(at))
        for level, (chunks, bits, ranks) in enumerate(self.levels):
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(8 * level)
            more = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            live, at = live[more], at[more]
            if not len(at):
                break
            block = at // RANK_BITS
            start = block * (RANK_BITS // 8)
            window = np.zeros((len(at), RANK_BITS // 8), np.uint8)
            reach = start[:, None] + np.arange(RANK_BITS // 8)
            inside = reach < len(bits)
            window[inside] = bits[reach[inside]]
            ones = np.unpackbits(window, axis=1, bitorder="little")
            ones[np.arange(RANK_BITS) >= (at % RANK_BITS)[:, None]] = 0
            at = ranks[block].astype(np.int64) + ones.sum(1, dtype=np.int64)
        return out

    def _rank(self, level: int, at: int) -> int:
        """Ones before a place in a level's bitmap, by its directory and less than a block of bits."""
        _, bits, ranks = self.levels[level]
        block = at // RANK_BITS
        if block == len(ranks):
            return len(self.levels[level + 1][0]) if level + 1 < len(self.levels) else 0
        rest = int.from_bytes(bits[block * (RANK_BITS // 8) : -(-at // 8)].tobytes(), "little") & ((1 << (at - block * RANK_BITS)) - 1)
        return int(ranks[block]) + rest.bit_count()

    def read(self, start: int, end: int, level: int = 0) -> np.ndarray:
        """The ids of a range of places: on each level a range, whose start is one rank away."""
        if level == 0 and not 0 <= start <= end <= self.n:
            raise IndexError("range outside the code")
        if start == end:
            return np.zeros(0, np.uint32)
        chunks, bits, _ = self.levels[level]
        out = chunks[start:end].astype(np.uint32)
        if level + 1 < len(self.levels):
            lead = start & 7
            more = np.unpackbits(bits[start >> 3 : (end + 7) >> 3], bitorder="little")[lead : lead + end - start].view(bool)
            if n := int(np.count_nonzero(more)):
                first = self._rank(level, start)
                out[more] |= self.read(first, first + n, level + 1) << np.uint32(8)
        return out


class LibraryEncoder:
    """Encodes whole texts with the tokenizers library, each distinct white-space chunk once.

    Exact for vocabularies whose tokens never span white space, whose normaliser works within
    chunks and lowers letters, and that part letters from punctuation, as the word vocabulary
    does; other vocabularies take ``by_chunk=False``.
    """

    def __init__(self, path: str, by_chunk: bool = True):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_chunk, self.known = Tokenizer.from_file(path), by_chunk, {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk. Plain words are encoded many at a time, as one text.

        A chunk of letters is one word to the library, so the ends of words part the ids; where
        their number differs (a letter that is no letter once normalised), one by one.
        """
        out: list[bytes | None] = [None] * len(chunks)
        words = [k for k, c in enumerate(chunks) if c.isalpha()]
        runs = [words[a : a + WORDS_AT_ONCE] for a in range(0, len(words), WORDS_AT_ONCE)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([" ".join([chunks[k] for k in run]) for run in runs], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) == len(run):
                raw, at = ids.tobytes(), 0
                for k, end in zip(run, ends.tolist(), strict=True):
                    out[k] = raw[at:end]
                    at = end
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self.ids([chunks[k] for k in rest]), strict=True):
            out[k] = x
        return out

    def encode_texts(self, texts: list[bytes]) -> list[bytes]:
        """The ids of whole texts. Texts without special tokens share chunks in lower case."""
        if not self.by_chunk:
            return self.ids([t.decode() for t in texts])
        cut = [(t if b"<|" in t else t.lower()).split() for t in texts]
        known = self.known
        if len(known) > MEMORY_CHUNKS:
            known.clear()
        missing = set(chain.from_iterable(cut)).difference(known)
        # a word and the comma or full stop after it are separate tokens to the library
        marked = [c for c in missing if c[-1:] in b",." and c[:-1].isalpha()]
        missing.difference_update(marked)
        missing.update(c[:-1] for c in marked)
        missing.update((b",", b"."))
        new = [c for c in missing if c not in known]
        known.update(zip(new, self.chunk_ids([c.decode() for c in new]), strict=True))
        for c in marked:
            known[c] = known[c[:-1]] + known[c[-1:]]
        out = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        for c in missing:
            if len(c) > MEMORY_BYTES:
                del known[c]
        for c in marked:
            if len(c) > MEMORY_BYTES:
                del known[c]
        return out


_encoders: dict[tuple[str, bool], LibraryEncoder] = {}


def encoder(path: str, by_chunk: bool) -> LibraryEncoder:
    if (path, by_chunk) not in _encoders:
        _encoders[path, by_chunk] = LibraryEncoder(path, by_chunk)
    return _encoders[path, by_chunk]


def write_token_files(docs: DataFrame, path: str, vocab_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", by_chunk: bool = True) -> None:
    """Encode every document, add end_id, and write segments in ascending doc_id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocab_path, by_chunk), array("I", [end_id]).tobytes()
        shard, segment, start = TaskContext.get().partitionId(), 0, 0
        ids, ends, pieces, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal segment, start, ids, ends, pieces, held
            row = [shard, segment, start, held, np.array([-(1 << 63) if i is None else i for i in ids], np.int64).tobytes(), np.array(ends, np.uint64).tobytes(), dac_encode(np.frombuffer(b"".join(pieces), np.uint32))]
            segment, start = segment + 1, start + held
            ids, ends, pieces, held = [], [], [], 0
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["shard", "segment", "shard_start", "n_tokens", "doc_ids", "ends", "code"])

        for batch in batches:
            coded = (got for run in parts(batch.column(1).cast(pa.binary()).to_pylist()) for got in enc.encode_texts(run))
            for doc_id, got in zip(batch.column(0).to_pylist(), coded, strict=True):
                got += end
                if held and held + len(got) // 4 > SEGMENT_TOKENS:
                    yield flush()
                held += len(got) // 4
                ids.append(doc_id)
                ends.append(held)
                pieces.append(got)
        if ids:
            yield flush()

    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "uncompressed").parquet(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``first``, the number of ids before their shard."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    # One row per shard, so no more than the writing job had partitions.
    shards = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    first = shards.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return segments.join(F.broadcast(first), "shard")


def read_places(spark: SparkSession, path: str, places: DataFrame, place_col: str = "place") -> DataFrame:
    """(place, id) of single places, counted over the whole file set; null for places outside it.

    A place meets its segment through buckets, and is read there by rank. Repeated places give
    one row, a null place none.
    """
    asked = places.select(F.col(place_col).cast("long").alias("place")).filter("place is not null").distinct().withColumn("bucket", F.floor(F.col("place") / SEGMENT_TOKENS))
    held = _segments(spark, path)
    begin = F.col("first") + F.col("shard_start")
    where = held.select("shard", "segment", begin.alias("begin"), (begin + F.col("n_tokens")).alias("end"))
    where = where.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("begin") / SEGMENT_TOKENS), F.floor((F.col("end") - 1) / SEGMENT_TOKENS))))
    found = asked.join(where, "bucket").filter((F.col("place") >= F.col("begin")) & (F.col("place") < F.col("end")))
    # distinct places of so many tokens in a row: no group is larger
    grouped = found.groupBy("shard", "segment", "begin", F.floor((F.col("place") - F.col("begin")) / PLACES_AT_ONCE).alias("part")).agg(F.collect_list("place").alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = np.array(batch.column(1)[k].as_py(), np.int64)
                ids = Dac(batch.column(2)[k].as_buffer()).gather(at - batch.column(0)[k].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ids.astype(np.int64))], names=["place", "id"])

    got = grouped.join(held.select("shard", "segment", "code"), ["shard", "segment"]).select("begin", "places", "code").mapInArrow(run, "place long, id long")
    return asked.select("place").join(got, "place", "left")


def read_token_files(spark: SparkSession, path: str, digests_only: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, unless digests_only, the ids (binary) of every document."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ("" if digests_only else ", ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                first, shard_start = (batch.column(c)[k].as_py() for c in (0, 1))
                ids, ends, code = (batch.column(c)[k].as_buffer() for c in (2, 3, 4))
                docs, ends, code = np.frombuffer(ids, np.int64), np.frombuffer(ends, np.uint64).astype(np.int64), Dac(code)
                starts = np.concatenate([[0], ends[:-1]])
                raw = [code.read(a, b).tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [
                    pa.array(docs, mask=docs == -(1 << 63)),
                    pa.array(starts + (first + shard_start)),
                    pa.array(ends - starts),
                    pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                ]
                if not digests_only:
                    columns.append(pa.array(raw, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    return _segments(spark, path).select("first", "shard_start", "doc_ids", "ends", "code").mapInArrow(run, schema)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import default_vocabulary

    path = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, default_vocabulary(), end_id=2)
    return read_token_files(spark, path, digests_only=True)
