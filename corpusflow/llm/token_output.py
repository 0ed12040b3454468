"""Token ids in binary shards with Elias-Fano document boundaries (operator 1).

`write_shards` orders documents by id over Spark's range partitions, encodes each whole text and
writes one file a partition: the concatenated ids (16 bits each where the vocabulary allows it)
as they come, then two Elias-Fano sequences, document ids and document ends. `read_shards` reads
them back by select, a block of documents at a time; no table of offsets is built.

Edge cases: a null or empty text is the end id alone; rows whose doc_id is null come first;
repeated doc_ids keep one entry each, ordered by a hash of the text; an empty table writes no shard.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusflow.llm import arrays, elias_fano, storage
from corpusflow.llm.idcache import IdCache

MAGIC = b"EFTOKEN2"
#: At a shard's end: bytes an id, documents, null document ids, bytes of: document ids, ends, tokens; magic.
TAIL = struct.Struct("<BQQQQQ8s")
#: Documents that a reader hands on at once.
READ_ROWS = 16 * elias_fano.SAMPLE

#: Pieces that the library gets as one text.
LINES = 1000

SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
#: Kinds of characters below U+0250 that every version of Unicode classes alike; any other character is UNSURE.
KIND = np.full(0x251, UNSURE, np.uint8)
for _c in (*b"\t\n\r", *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x250)):
    _k = unicodedata.category(chr(_c))[0]
    KIND[_c] = SPACE if _c <= 0x20 else LETTER if _k == "L" else NUMBER if _k == "N" else OTHER


def piece_starts(code: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the byte-level pre-tokenizer starts a piece. first: where a text starts.

    Runs of one kind are pieces; a blank goes with the run after it, and the last of several white-space
    characters stands apart; an apostrophe that starts a run takes one of the endings s, t, d, m, re, ve, ll.
    """
    n = len(code)
    inner = ~first[1:]
    start = np.ones(n + 3, bool)
    start[1:n] = (kind[1:] != kind[:-1]) | first[1:]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & inner)
    start[last] = True
    start[last[code[last] == 0x20] + 1] = False
    at = np.flatnonzero(start[:n] & (code == ord("'")))
    padded, ended = np.append(code, [0, 0]), np.append(first, [True, True])
    one = np.where(ended[at + 1], 0, padded[at + 1])
    two = np.where(ended[at + 1] | ended[at + 2], 0, padded[at + 2])
    short = np.isin(one, list(b"stdm"))
    long = np.isin(one << 8 | two, [a << 8 | b for a, b in (b"re", b"ve", b"ll")])
    start[at[short | long] + 1] = False
    start[at[short] + 2] = True
    start[at[long] + 3] = True
    return start[:n]


class Encoder:
    """Encodes texts with a byte-level BPE file of the tokenizers library.

    Byte-level BPE never joins what its pre-tokenizer separates, so each new piece is given to the library
    once. A text with an UNSURE character, or with a special token's string, goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.width = 2 if self.library.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        size = {i: len(t) for t, i in self.library.get_vocab().items()}  # a character of the byte alphabet is a byte
        self.bytes_of = np.array([size.get(i, 0) for i in range(max(size) + 1)], np.int64)
        self.known = IdCache(21)

    def _pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids). Pieces are given to the library as lines of one text, which it cuts at the same places."""
        count, found = np.zeros(len(pieces), np.int64), []
        for a in range(0, len(pieces), LINES):
            part = pieces[a : a + LINES]
            ids = np.array(self.library.encode_batch_fast([b"\n".join([*part, b""]).decode()], add_special_tokens=False)[0].ids, np.int32)
            size = np.fromiter(map(len, part), np.int64, len(part)) + 1
            of = np.searchsorted(np.cumsum(size), np.cumsum(self.bytes_of[ids]) - 1, "right")
            count[a : a + len(part)] = np.bincount(of, minlength=len(part)) - 1
            keep = np.ones(len(ids), bool)
            keep[np.cumsum(count[a : a + len(part)] + 1) - 1] = False  # line ends
            found.append(ids[keep])
        return count, np.concatenate([np.zeros(0, np.int32), *found])

    def _coded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each); end_id follows every text."""
        data, off = arrays.utf8(column)
        n, more = len(off) - 1, int(end_id is not None)
        at, code = arrays.code_points(data)
        kind = KIND[np.minimum(code, 0x250)]
        edge = np.searchsorted(at, off)
        whole = np.zeros(n, bool)
        whole[np.searchsorted(edge, np.flatnonzero(kind == UNSURE), "right") - 1] = True
        text = data.tobytes()
        for mark in self.special:
            p = text.find(mark)
            while p >= 0:
                whole[np.searchsorted(off, p, "right") - 1] = True
                p = text.find(mark, p + 1)
        first = np.zeros(len(at) + 1, bool)
        first[edge] = True
        start = np.flatnonzero(piece_starts(code, kind, first[:-1])) if len(at) else at
        begin = at[start]
        end = np.append(begin[1:], len(data))[: len(begin)]
        doc = np.searchsorted(off, begin, "right") - 1
        plain = ~whole[doc]
        begin, end, doc = begin[plain], end[plain], doc[plain]

        def learn(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            blank = np.flatnonzero(arrays.IS_SPACE[data[end[new] - 1]])  # pieces of white space
            rest = np.setdiff1d(np.arange(len(new)), blank)
            own = self._coded([text[a:b].decode() for a, b in zip(begin[new[blank]].tolist(), end[new[blank]].tolist(), strict=True)])
            size, ids = self._pieces([text[a:b] for a, b in zip(begin[new[rest]].tolist(), end[new[rest]].tolist(), strict=True)])
            count = np.zeros(len(new), np.int64)
            count[rest], count[blank] = size, list(map(len, own))
            ends, out = np.cumsum(count), np.empty(int(count.sum()), np.int32)
            out[arrays.spread((ends - count)[rest], size)] = ids
            for i, x in zip(blank.tolist(), own, strict=True):
                out[ends[i] - count[i] : ends[i]] = x
            return count, out

        place, size = self.known.find(arrays.heads(arrays.eights(data), begin, end - begin), arrays.word_hashes(data, begin, end), learn)
        count = np.bincount(doc, size, n).astype(np.int64)
        odd = np.flatnonzero(whole)
        others = self._coded([text[off[d] : off[d + 1]].decode() for d in odd.tolist()])
        count[odd] = list(map(len, others))
        ends = np.cumsum(count + more)
        out = np.empty(int(ends[-1]) if n else 0, self.kind)
        own = np.where(whole, 0, count)
        out[arrays.spread(ends - more - count, own)] = self.known.gather(place, size)
        for d, ids in zip(odd.tolist(), others, strict=True):
            out[ends[d] - more - count[d] : ends[d] - more] = ids
        if more:
            out[ends - 1] = end_id
        return out, count + more


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def boundaries(doc_ids: pa.ChunkedArray, ends: np.ndarray, width: int) -> tuple[bytes, ...]:
    """What follows the ids in a shard file."""
    known, bounds = elias_fano.encode(doc_ids.drop_null().to_numpy()), elias_fano.encode(ends)
    return known, bounds, TAIL.pack(width, len(doc_ids), doc_ids.null_count, len(known), len(bounds), int(ends[-1]) * width, MAGIC)


class Shard:
    """One shard file: `ids(i)` is document i's ids, `start(i)` its offset in the shard."""

    def __init__(self, buffer) -> None:
        self.width, self.n, self.nulls, ids, ends, tokens, magic = TAIL.unpack_from(buffer, len(buffer) - TAIL.size)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.doc_ids = elias_fano.Sequence(buffer[tokens : tokens + ids])
        self.ends = elias_fano.Sequence(buffer[tokens + ids : tokens + ids + ends])
        self.tokens = np.frombuffer(buffer, f"<u{self.width}", tokens // self.width)

    def start(self, i: int) -> int:
        return self.ends.select(i - 1) if i else 0

    def ids(self, i: int) -> np.ndarray:
        return self.tokens[self.start(i) : self.ends.select(i)]

    def documents(self, rows: int = READ_ROWS) -> Iterator[tuple[list[int | None], np.ndarray]]:
        """(document ids, offsets: one more than documents) of blocks of documents, read by select."""
        for a in range(0, self.n, rows):
            b = min(self.n, a + rows)
            null = max(0, min(b, self.nulls) - a)
            known = self.doc_ids.some(max(0, a - self.nulls), max(0, b - self.nulls)).tolist()
            yield [None] * null + known, np.concatenate([[self.start(a)], self.ends.some(a, b)])


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0) -> DataFrame:
    """Write docs (doc_id, text) in ascending doc_id; return the manifest: shard, path, n_docs, n_ids, base (ids before)."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        doc_ids, counts = [], []

        def parts() -> Iterator[bytes]:
            for batch in arrays.sliced(batches):
                ids, count = enc.encode(batch.column("text"), end_id)
                doc_ids.append(batch.column("doc_id"))
                counts.append(count)
                yield ids.tobytes()
            if not counts:
                return
            yield from boundaries(pa.chunked_array(doc_ids), np.cumsum(np.concatenate(counts)), enc.width)

        part = TaskContext.get().partitionId()
        path = f"{folder}/tokens-{part:06d}.ef"
        storage.write_file(path, parts())
        if counts:
            yield pa.RecordBatch.from_pydict({"shard": [part], "path": [path], "n_docs": [sum(map(len, counts))], "n_ids": [int(sum(c.sum() for c in counts))]})

    # The hash lets Spark split the rows of one doc_id, or of none.
    keyed = docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    listed = ordered.select("doc_id", "text").mapInArrow(write, "shard long, path string, n_docs long, n_ids long")
    listed = storage.written(listed, "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a file: a task holds millions
    return listed.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), from the files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                held = Shard(storage.read_file(path))
                for ids, edge in held.documents():
                    own = held.tokens[edge[0] : edge[-1]].astype("<u4")
                    cut = (edge - edge[0]).tolist()
                    crc = [zlib.crc32(own[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "start": pa.array(edge[:-1] + base, pa.int64()), "n_tokens": pa.array(np.diff(edge), pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return manifest.select("path", "base").repartition(F.col("path")).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), f"{storage.shared_dir(spark)}/shards")
    return read_shards(manifest)
