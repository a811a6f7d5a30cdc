"""Byte-level BPE by a shuffle of distinct words.

A word here is a run ` ?[^white space]+` or a run of white space (without its last character where text follows); no
match of the tokenizer's pattern crosses such a border, so the matches of a word don't depend on its neighbours. Stages:
(1) documents are gathered into blocks of BLOCK_BYTES of text; the distinct words of a block get local numbers and are
dealt to buckets by their hash, one packed row for each block and bucket; (2) a bucket has every block's entries of its
words: each distinct word is encoded once and its ids go back to the blocks; (3) at its block they meet the positions,
which are the block's local numbers in text order and went straight there, and the ids are put in order by position. A
word that every document has is one entry of each block, whatever its count. Words and positions are two scans of the
documents, so that the positions are shuffled once and not twice. A block is named after its texts: should the scans
differ, no words are found under its name and the job fails instead of mixing words up. Decoding looks ids up in the table
of token bytes (as long as the vocabulary, so it is sent to all executors).

Defined cases: a null text is empty and has no ids; rows keep their doc_id (null too), repeated rows give a row each; an
empty table gives no rows; other columns are ignored. A very long text is a block of its own, held in one task.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .common import distinct_words, mapped, pack, ranges, session, table, text_bytes, unpack

BLOCK_BYTES = 4 << 20
#: Bytes of text for which there is a bucket, up to MAX_BUCKETS: beyond, buckets grow and not the number of a block's rows.
BUCKET_BYTES = 8 << 20
MAX_BUCKETS = 4096
#: Words of a bucket whose ids are kept (some 60 MB); a bucket of more starts anew, and encodes some words again.
KNOWN_WORDS = 400_000
#: Ids after which a batch of whole documents is given out.
OUT_IDS = 1 << 18
#: The white space of the pattern library, the property White_Space.
_SPACE = "\t-\r \x85\xa0  -     　"
WORD = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


_encodings: dict = {}


def kept_encoding(path: str, pattern: str):
    """The worker's own, which outlasts a task: this function is sent by name, while what a closure names is copied."""
    return _encodings.get((path, pattern)) or _encodings.setdefault((path, pattern), encoding(path, pattern))


def _planes(x: np.ndarray) -> np.ndarray:
    """The bytes of 32-bit numbers, the lowest byte of all first: they pack better so."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _unplanes(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


#: Bytes of white space beyond ASCII; texts with these are split by WORD itself.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_ASCII_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def word_starts(texts: list[bytes], data: np.ndarray) -> np.ndarray:
    """Where the words of the joined texts begin. A run of white space is one word, but for its last character where text
    follows: a space belongs to that text, another character is a word of its own."""
    sizes = np.array([len(t) for t in texts], np.int64)
    border = np.cumsum(sizes)
    border = np.append(0, border)[:-1][sizes > 0]
    space = _ASCII_SPACE[data]
    start = np.zeros(len(data), bool)
    if len(data):
        before = np.append(False, space[:-1])
        start[:] = space & ~before
        start |= ~space & before & (np.append(np.uint8(0), data[:-1]) != 32)
        follows = np.append(~space[1:], False)
        follows[border[1:] - 1] = False
        start |= space & before & follows
        start[border] = True
    at = np.append(0, np.cumsum(sizes))
    for k, text in enumerate(texts):
        if not text.isascii() and _WIDE.search(text):
            start[at[k] : at[k + 1]] = False
            ends = np.cumsum([len(w.encode()) for w in WORD.findall(text.decode())])
            start[at[k] + np.append(0, ends[:-1])] = True
    return np.flatnonzero(start)


class _Block:
    """Texts in order as one array of bytes, its words as spans, and the distinct words among them."""

    def __init__(self, docs: list, texts: list[bytes]):
        import xxhash

        try:
            b"".join(texts).decode()
        except UnicodeDecodeError:
            texts = [t.decode("utf-8", "replace").encode() for t in texts]
        self.docs, self.sizes, joined = docs, np.array([len(t) for t in texts], np.int64), b"".join(texts)
        content = xxhash.xxh3_64(self.sizes.tobytes())
        content.update(joined)
        #: The block's name: blocks of one name have the same texts in the same order.
        self.key = content.intdigest() - (1 << 63)
        self.data = np.frombuffer(joined, np.uint8)
        self.starts = word_starts(texts, self.data)
        self.ends = np.append(self.starts[1:], len(self.data)) if len(self.starts) else self.starts

    def word_rows(self, n_buckets: int):
        """A packed row for each bucket that the block has words of: the words and their local numbers."""
        if not len(self.starts):
            return
        first, _, h = distinct_words(self.data, self.starts, self.ends)
        size = self.ends[first] - self.starts[first]
        bucket = (h % np.uint64(n_buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        occupied, at = np.unique(bucket[by], return_index=True)
        for k, own in zip(occupied.tolist(), np.split(by, at[1:]), strict=True):
            yield k, pack(_planes(size[own]), self.data[ranges(self.starts[first][own], size[own])], _planes(np.diff(own, prepend=0)), level=3)

    def position_rows(self, _):
        """One row: the documents, their numbers of words, and the local numbers of all words in order."""
        ends = np.searchsorted(self.starts, np.cumsum(self.sizes))
        number = distinct_words(self.data, self.starts, self.ends)[1] if len(self.starts) else np.zeros(0, np.int64)
        yield -1, pack(np.array([d or 0 for d in self.docs], "<i8"), np.array([d is None for d in self.docs]), np.diff(ends, prepend=0).astype("<i8"), _planes(number), level=3)


def _row(key: int, bucket: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], ["block", "bucket", "data"])


def _split(rows_of, n_buckets: int):
    def rows(docs, texts):
        block = _Block(docs, texts)
        for k, data in rows_of(block, n_buckets):
            yield _row(block.key, k, data)

    def apply(batches):
        docs, texts, held = [], [], 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                docs.append(doc)
                texts.append(text)
                held += len(text)
                if held >= BLOCK_BYTES:
                    yield from rows(docs, texts)
                    docs, texts, held = [], [], 0
        if docs:
            yield from rows(docs, texts)

    return apply


class _Known(dict):
    """word -> its ids as bytes, encoded at the first look."""

    def __init__(self, bpe):
        super().__init__()
        self.encode = bpe.encode_ordinary

    def __missing__(self, word: bytes) -> bytes:
        ids = self[word] = array("I", self.encode(word.decode())).tobytes()
        return ids


def _encode(path: str, pattern: str):
    """Words become ids. Rows come sorted by bucket, so the ids of a bucket's words are kept until the next bucket."""

    def apply(batches):
        bpe = kept_encoding(path, pattern)
        known, now = _Known(bpe), None
        for b in batches:
            for key, bucket, data in zip(b.column("block").to_pylist(), b.column("bucket").to_pylist(), b.column("data"), strict=True):
                if bucket != now or len(known) > KNOWN_WORDS:
                    known, now = _Known(bpe), bucket
                sizes, blob, steps = unpack(data.as_buffer())
                ends = np.cumsum(_unplanes(sizes)).tolist()
                blob = bytes(blob)
                ids = [known[blob[start:end]] for start, end in zip([0, *ends[:-1]], ends, strict=True)]
                yield _row(key, bucket, pack(_planes(np.array(list(map(len, ids))) // 4), _planes(np.frombuffer(b"".join(ids), "<u4")), bytes(steps), level=3))

    return apply


def load_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: the bytes of all tokens by rank, and where each ends."""
    ranks = load_ranks(path)
    lengths = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return np.frombuffer(b"".join(t for t, _ in sorted(ranks.items(), key=lambda x: x[1])), np.uint8), np.cumsum(lengths)


def _bytes_of(ids: np.ndarray, blob: np.ndarray, ends: np.ndarray) -> bytes:
    starts = np.append(0, ends[:-1])
    return b"".join(blob[ranges(starts[part], (ends - starts)[part])].tobytes() for part in np.split(ids, range(1 << 18, len(ids), 1 << 18)))


def _join(words: dict[int, bytes], positions: list[bytes], table):
    """Batches of documents of one block: the ids of its words by local number, put in order by position."""
    sizes, values, spots = [], [], []
    for data in words.values():
        size, value, steps = unpack(data)
        sizes.append(_unplanes(size))
        values.append(_unplanes(value).astype(np.uint32))
        spots.append(np.cumsum(_unplanes(steps)))
    of = source = np.zeros(0, np.int64)
    if spots:
        at, size, values = np.concatenate(spots), np.concatenate(sizes), np.concatenate(values)
        of, source = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        of[at], source[at] = size, np.cumsum(size) - size
    for data in positions:
        docs, null, counts, order = unpack(data)
        docs, null, counts, order = np.frombuffer(docs, "<i8").tolist(), np.frombuffer(null, bool).tolist(), np.frombuffer(counts, "<i8"), _unplanes(order)
        if order.max(initial=-1) >= len(of):
            raise RuntimeError("the two scans of the input differ: write it as a table first")
        ends = np.cumsum(counts).tolist()
        rows, held = [], 0
        for doc, no, s, e in zip(docs, null, [0, *ends[:-1]], ends, strict=True):
            own = order[s:e]
            ids = values[ranges(source[own], of[own])] if len(own) else np.zeros(0, np.uint32)
            rows.append([None if no else doc, len(ids), ids.astype("<u4").tobytes()] + ([_bytes_of(ids, *table)] if table else []))
            held += len(ids)
            if held >= OUT_IDS:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])


def _gather(sent):
    def apply(batches):
        table = sent.value if sent else None
        now, words, positions = None, {}, []
        for b in batches:
            for key, bucket, data in zip(b.column("block").to_pylist(), b.column("bucket").to_pylist(), b.column("data"), strict=True):
                if key != now and now is not None:
                    yield from _join(words, positions, table)
                    words, positions = {}, []
                now = key
                if bucket < 0:
                    positions.append(data.as_buffer().to_pybytes())
                else:
                    words[bucket] = data.as_buffer().to_pybytes()  # blocks of one name have equal words
        if now is not None:
            yield from _join(words, positions, table)

    return apply


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian, four bytes each), and with decoded the bytes of the ids, as decode() adds them.
    path: a file of ranks."""
    spark = session(docs)
    base = text_bytes(docs, id_col, text_col)
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(1, min(MAX_BUCKETS, -(-size // BUCKET_BYTES)))
    schema = "block long, bucket int, data binary"
    words = mapped(base, _split(_Block.word_rows, n_buckets), schema)
    coded = mapped(words.repartition("bucket").sortWithinPartitions("bucket"), _encode(path, pattern), schema)
    both = coded.unionByName(mapped(base, _split(_Block.position_rows, n_buckets), schema))
    sent = spark.sparkContext.broadcast(load_bytes(path)) if decoded else None
    return mapped(both.repartition("block").sortWithinPartitions("block"), _gather(sent), "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """The rows of tokens (a column ids, as encode() gives it) with a column decoded: the bytes of the ids."""
    sent = session(tokens).sparkContext.broadcast(load_bytes(path))

    def apply(batches):
        for b in batches:
            out = [_bytes_of(np.frombuffer(data or b"", "<u4"), *sent.value) for data in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(out, pa.binary())], ["row", "decoded"])

    rows = tokens.select("ids", F.struct("*").alias("row"))
    return mapped(rows, apply, StructType([rows.schema["row"], StructField("decoded", BinaryType())])).select("row.*", "decoded")


def digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digest(encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True))


def brute(docs: list[tuple], path: str, pattern: str) -> dict:
    """doc_id -> (n_tokens, ids_sha256, decoded_sha256), by the library on whole texts, for tests."""
    bpe, out = encoding(path, pattern), {}
    for doc, text in docs:
        ids = bpe.encode_ordinary(text or "")
        out[doc] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode_bytes(ids)).hexdigest())
    return out
