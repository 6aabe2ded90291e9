"""BPE encoding and decoding by a segment tree over adjacent pair ranks.

The leaves of the tree hold the merge rank of each pair of neighbouring symbols, inner nodes the
smaller rank of their children. The root tells the lowest rank, a walk down finds its leftmost
place, and each merge updates three leaves in logarithmic time; it ends when the root holds no
rank. A text of n symbols without white space thus costs O(n log n), however long it is.

Texts are cut at white space into chunks, which no token spans, and each distinct chunk is
merged once per worker (a bounded memory of chunks, dropped when full: the result is the same).

Defined results for odd input: a null text is the empty text, with no tokens; repeated rows give
repeated results; an empty table gives an empty table; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batches import text_slices
from .common import table, text_or_empty

INFINITE = 1 << 60
#: The split pattern of the vocabulary file, with white space as Unicode's White_Space property.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Chunks up to this many bytes are remembered, so many at most.
MEMORY_BYTES, MEMORY_CHUNKS = 64, 700_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class PairTree:
    """Minimum segment tree over the ranks of adjacent pairs; merges a symbol list in place."""

    def __init__(self, ranks: dict[int, int], results: list[int]):
        self.ranks, self.results = ranks, results

    def merge(self, symbols: list[int]) -> list[int]:
        n = len(symbols)
        rank, none = self.ranks.get, INFINITE
        leaves = [rank(a << 20 | b, none) for a, b in zip(symbols, symbols[1:])]
        if not leaves or min(leaves) == none:
            return symbols
        size = 1 << (n - 2).bit_length()
        tree = [none] * size + leaves + [none] * (size - n + 1)
        for i in range(size - 1, 0, -1):
            left, right = tree[2 * i], tree[2 * i + 1]
            tree[i] = left if left <= right else right
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := tree[1]) < none:
            i = 1
            while i < size:
                i *= 2
                if tree[i] != low:
                    i += 1
            p = i - size
            q = after[p]
            new = symbols[p] = self.results[low]
            symbols[q] = -1
            far = after[p] = after[q]
            changed = []
            if far < n:
                before[far] = p
                changed.append((i, rank(new << 20 | symbols[far], none)))
                changed.append((size + q, none))
            else:
                changed.append((i, none))
            if (back := before[p]) >= 0:
                changed.append((size + back, rank(symbols[back] << 20 | new, none)))
            for i, value in changed:
                tree[i] = value
                while i > 1:
                    other = tree[i ^ 1]
                    if other < value:
                        value = other
                    i >>= 1
                    if tree[i] == value:
                        break
                    tree[i] = value
        return [s for s in symbols if s >= 0]


class WordBpe:
    """Encoder and decoder of a byte-level BPE vocabulary with word ends (tokenizers' JSON format)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens: list[str] = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for t, i in vocab.items():
            self.tokens[i] = t
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for t, i in self.special.items():
            self.tokens[i] = t
        self.specials = regex.compile("|".join(map(regex.escape, self.special)))
        self.special_bytes = [t.encode() for t in self.special]
        chars = byte_symbols()
        self.inner, self.last = [vocab[c] for c in chars], [vocab[c + end] for c in chars]
        ranks, results = {}, []
        for r, (a, b) in enumerate(model["merges"]):
            ranks[vocab[a] << 20 | vocab[b]] = r
            results.append(vocab[a + b])
        self.tree = PairTree(ranks, results)
        self.most = MEMORY_CHUNKS
        self.pieces: dict[str, list[int]] = {}
        self.ids: dict[bytes, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}

    def piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return self.tree.merge(symbols)

    def remembered(self, piece: str) -> list[int]:
        """The ids of a short piece that many chunks share, such as a punctuation mark."""
        if (known := self.pieces.get(piece)) is None:
            known = self.piece(piece)
            if len(self.pieces) < self.most // 8:
                self.pieces[piece] = known
        return known

    def plain(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        if text.isalpha():
            return self.piece(text)
        out: list[int] = []
        for p in PIECES.findall(text):
            out += self.remembered(p) if len(p) < 4 else self.piece(p)
        return out

    def chunk(self, raw: bytes) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the decoded tokens with a space before each."""
        text = raw.decode("utf-8", "replace")
        ids: list[int] = []
        if b"<|" in raw and any(s in raw for s in self.special_bytes):
            at = 0
            for m in self.specials.finditer(text):
                ids += self.plain(text[at : m.start()])
                ids.append(self.special[m[0]])
                at = m.end()
            text = text[at:]
        ids += self.plain(text)
        return array("I", ids).tobytes(), "".join([" " + self.tokens[i] for i in ids]).encode()

    def encode_texts(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded text) of whole texts: each a join over the text's chunks.

        A-Z and a-z give the same tokens, except in special tokens, so texts without those are
        put into lower case first and share more chunks.
        """
        cut = [(t if b"<|" in t else t.lower()).split() for t in texts]
        ids, decoded = self.ids, self.decoded
        if len(ids) > self.most:
            ids.clear()
            decoded.clear()
        long: list[bytes] = []
        for c in set(chain.from_iterable(cut)).difference(ids):
            if c[-1:] in b",." and (stem := c[:-1]) in ids and stem.isalpha():
                mark = c[-1:]
                if mark not in ids:
                    ids[mark], decoded[mark] = self.chunk(mark)
                ids[c], decoded[c] = ids[stem] + ids[mark], decoded[stem] + decoded[mark]
                continue
            ids[c], decoded[c] = self.chunk(c)
            if len(c) > MEMORY_BYTES:
                long.append(c)
        out = [(b"".join(map(ids.__getitem__, chunks)), b"".join(map(decoded.__getitem__, chunks))[1:]) for chunks in cut]
        for c in long:
            ids.pop(c, None)
            decoded.pop(c, None)
        return out

    def encode(self, text: str | None) -> list[int]:
        return list(array("I", self.encode_texts([(text or "").encode()])[0][0]))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces, special tokens kept: the file names no decoder."""
        return " ".join(self.tokens[i] for i in ids)


def parts(texts: list[bytes], most: int = 4 << 20) -> Iterator[list[bytes]]:
    """The texts in runs of about ``most`` bytes, so that few chunks are held at a time."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The encoder of a vocabulary file, once per worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_batches(batches: Iterator[pa.RecordBatch], bpe: WordBpe, digests_only: bool = False, decoded: bool = True) -> Iterator[pa.RecordBatch]:
    """The results of batches of (doc_id, text), put out slice by slice: a worker holds one slice's tokens."""
    sha = hashlib.sha256
    for whole in batches:
        for batch in text_slices(whole, 1):
            rows = bpe.encode_texts(batch.column(1).cast(pa.binary()).to_pylist())
            columns = [batch.column(0), pa.array([len(i) // 4 for i, _ in rows], pa.int64()), pa.array([sha(i).hexdigest() for i, _ in rows], pa.string()), pa.array([sha(d).hexdigest() for _, d in rows], pa.string())]
            if not digests_only:
                columns.append(pa.array([i for i, _ in rows], pa.binary()))
                if decoded:
                    columns.append(pa.array([d.decode("utf-8", "replace") for _, d in rows], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(columns)])


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", digests_only: bool = False, memory_chunks: int = MEMORY_CHUNKS, decoded: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests and, unless digests_only, the ids (binary) and, with decoded, the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ("" if digests_only else ", ids binary" + ", decoded string" * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocab_path)
        bpe.most = memory_chunks
        return encode_batches(batches, bpe, digests_only, decoded)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), default_vocabulary(), digests_only=True)
