"""Token-id files: canonical length-limited Huffman coding of ids, decoded by table in independent blocks.

Stages: (1) tokenise and write the ids (two bytes each where the vocabulary allows) with the documents' ids; (2) count
every id over the whole corpus; (3) make the code on the driver, whose input is the vocabulary's size and nothing else;
(4) deal the id rows by doc_id into ranges, sort, and write blocks. The file is a Parquet folder: its rows are blocks of
whole documents (at least BLOCK_IDS ids, unless the shard ends), each with the bit stream, the bit length of every run of
SEGMENT ids (the bit-offset checkpoints), the documents' ids and lengths, and the ids before it in its shard. A second
folder holds the code lengths, from which the canonical code follows. Any block decodes on its own: all segments of a
block advance together, one table look-up each.

Defined cases: a null text is empty and gives the end id alone; null doc_ids sort first; repeated doc_ids are further
documents, in the order of their ids' bytes; an empty table gives no blocks; other columns are ignored; a very long text is a
block of its own, held in one task.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct_words, mapped, materialise, pack, ranges, session, table, text_bytes, unpack

#: Bytes of letters that composing leaves alone and lower-casing changes in ASCII alone (a to z, and in UTF-8 the small ones of
#: Latin-1): 1. Closing marks, which are a match of their own after a letter: 2. All others: 0.
_CLASS = np.array([1 if chr(b).isascii() and chr(b).isalpha() or b == 0xC3 or 0x9F <= b <= 0xBF and b != 0xB7 else 2 if b in b".,;:!?" else 0 for b in range(256)], np.int8)
_LOW = np.frombuffer(bytes(range(256)).lower(), np.uint8)
#: Ends a word in the merger's texts; no letter.
MARK = b"\n"
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
END_ID = 2
MAX_BITS = 16
SEGMENT = 64
BLOCK_IDS = 1 << 17
SHARD_IDS = 1 << 22
#: Shards grow beyond SHARD_IDS rather than in number from here on: their totals meet on the driver.
MAX_SHARDS = 20_000


def limited_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Code lengths of the symbols with a count, none over max_bits, by package-merge; 0 for the others."""
    used = np.flatnonzero(counts)
    n = len(used)
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit in {max_bits} bits")
    lengths = np.zeros(len(counts), np.int64)
    if n <= 1:
        lengths[used] = 1
        return lengths
    weight = counts[used].astype(np.int64)
    order = np.argsort(weight, kind="stable")
    leaf = weight[order]
    levels, row, is_leaf = [], leaf, np.ones(n, bool)
    for _ in range(max_bits - 1):
        levels.append(is_leaf)
        even = len(row) // 2 * 2
        packages = row[0:even:2] + row[1:even:2]
        both = np.concatenate([leaf, packages])
        at = np.argsort(both, kind="stable")
        row, is_leaf = both[at], at < n
    levels.append(is_leaf)
    take, got = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        k = int(is_leaf[:take].sum())
        got[:k] += 1
        take = 2 * (take - k)
    lengths[used[order]] = got
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: shorter codes first, then by symbol."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    step = np.uint64(1) << (np.uint64(MAX_BITS) - lengths[order].astype(np.uint64))
    start = np.concatenate([np.zeros(1, np.uint64), np.cumsum(step)[:-1]])
    codes[order] = start >> (np.uint64(MAX_BITS) - lengths[order].astype(np.uint64))
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bit stream, and the bits of each run of SEGMENT ids."""
    size = lengths[ids]
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    at = (end - size).astype(np.int64)
    word = at >> 5
    value = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    n = total // 32 + 2
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), n)
    low = np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    marks = np.append(at[::SEGMENT], total)
    return (high + low).astype(">u4").tobytes(), np.diff(marks).astype("<u2")


class Decoder:
    """Table of all MAX_BITS-bit prefixes: the symbol and the bits it takes."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        span = 1 << (MAX_BITS - lengths[order])
        self.symbol, self.bits = np.zeros(1 << MAX_BITS, np.int64), np.ones(1 << MAX_BITS, np.int64)
        self.symbol[: span.sum()] = np.repeat(order, span)
        self.bits[: span.sum()] = np.repeat(lengths[order], span)

    def block(self, stream: bytes, segment_bits: np.ndarray, n: int) -> np.ndarray:
        words = np.append(np.frombuffer(stream, ">u4"), 0).astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at = np.cumsum(segment_bits.astype(np.int64)) - segment_bits
        out = np.zeros((SEGMENT, len(at)), np.int64)
        last = n - (len(at) - 1) * SEGMENT
        for k in range(SEGMENT):
            if k == last:
                at = at[:-1]
            prefix = (pairs[at >> 5] >> (48 - (at & 31)).astype(np.uint64)).astype(np.int64) & 0xFFFF
            out[k, : len(at)] = self.symbol[prefix]
            at = at + self.bits[prefix]
        return out.T.ravel()[:n]


def _units(token: str, suffix: str) -> list[str]:
    """What merging starts from: characters, the last one with the suffix."""
    body = token.removesuffix(suffix) if token.endswith(suffix) else token
    return [*body[:-1], body[-1:] + token[len(body) :]]


def byte_of() -> dict[str, int]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)).difference(plain)))}


@functools.cache
def ranks_of(path: str) -> dict[bytes, int] | None:
    """The vocabulary as ranks of byte strings in which MARK stands for the end of a word, if merging the pair of least rank
    gives what the merges in their order give; None otherwise. That is so if token ids follow the merges and each token comes
    out of its own characters with its own merge last: then no other pair that joins to the token is ever neighbours."""
    with open(path) as f:
        model = json.load(f)["model"]
    suffix, vocabulary = model.get("end_of_word_suffix"), model["vocab"]
    if model.get("type") != "BPE" or not suffix or any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges")):
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rank = {m: i for i, m in enumerate(merges)}
    first = len(vocabulary) - len(merges)
    byte = byte_of()
    for i, (a, b) in enumerate(merges):
        units = _units(a + b, suffix)
        while len(units) > 2:
            at = min(range(len(units) - 1), key=lambda k: rank.get((units[k], units[k + 1]), len(merges)))
            if rank.get((units[at], units[at + 1]), len(merges)) >= i:
                return None
            pair = units[at], units[at + 1]
            done, k = [], 0
            while k < len(units):
                both = k + 1 < len(units) and (units[k], units[k + 1]) == pair
                done.append(pair[0] + pair[1] if both else units[k])
                k += 1 + both
            units = done
        if tuple(units) != (a, b) or vocabulary.get(a + b) != first + i:
            return None
    single = [t for t, i in vocabulary.items() if i < first]
    if sorted(t.removesuffix(suffix) if len(t) > 1 else t for t in single) != sorted([*byte, *byte]) or len(rank) != len(merges):
        return None
    return {bytes(byte[c] for c in (t.removesuffix(suffix) if len(t) > 1 else t)) + (MARK if len(t) > 1 and t.endswith(suffix) else b""): i for t, i in vocabulary.items()}


class Pieces:
    """Encodes texts by the distinct pieces between their ASCII white space, which the tokenizer drops and across which it joins
    nothing. A word of letters and the marks that close it are two matches and so two pieces."""

    def __init__(self, path: str, ranks: dict[bytes, int] | None):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Encodes words of letters that the tokenizer's normalising changes in ASCII capitals alone.
        self.merger = tiktoken.Encoding("own", pat_str=f"[^{MARK.decode()}]+{MARK.decode()}", mergeable_ranks=ranks, special_tokens={}) if ranks else None
        vocabulary = self.tokenizer.get_vocab()
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        #: Which ids end a match.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True

    def merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has: the words as lines of one text."""
        size = ends - starts
        lines = np.full(int((size + 1).sum()), MARK[0], np.uint8)
        lines[ranges(np.cumsum(size + 1) - size - 1, size)] = data[ranges(starts, size)]
        ids = np.array(self.merger.encode_ordinary(lines.tobytes().decode()), np.int64)
        return ids, np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)

    def alone(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same by the library, a text a word."""
        got = [e.ids for i in range(0, len(words), 20_000) for e in self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in words[i : i + 20_000]], add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.int64), np.array(list(map(len, got)), np.int64)

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """The ids of each text with the end id."""
        try:
            b"".join(texts).decode()
        except UnicodeDecodeError:
            texts = [t.decode("utf-8", "replace").encode() for t in texts]
        joined, last = b" ".join(texts), np.array([end], self.kind).tobytes()
        data = np.frombuffer(joined, np.uint8)
        text = np.zeros(len(data) + 2, bool)  # with white space before and after
        text[1:-1] = ~_SPACE[data]
        starts, ends = np.flatnonzero(text[1:] & ~text[:-1]), np.flatnonzero(~text[1:] & text[:-1])
        if not len(starts):
            return [last] * len(texts)
        letters, marks = (np.append(0, np.cumsum(_CLASS[data] == k)) for k in (1, 2))
        n = letters[ends] - letters[starts]
        form = (n > 0) & (n + marks[ends] - marks[starts] == ends - starts) & (letters[starts + n] - letters[starts] == n) & (self.merger is not None)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[starts[form]] += 1
        inside[ends[form]] -= 1
        data = np.where(np.cumsum(inside[:-1], dtype=np.int8) > 0, _LOW[data], data)
        closed = form & (n < ends - starts)
        starts, stops, stem = np.append(starts, (starts + n)[closed]), np.append(np.where(form, starts + n, ends), ends[closed]), np.append(form, np.zeros(closed.sum(), bool))
        order = np.argsort(starts, kind="stable")
        starts, ends, stem = starts[order], stops[order], stem[order]
        first, number, _ = distinct_words(data, starts, ends)
        words, rest = first[stem[first]], first[~stem[first]]
        values, size = self.merged(data, starts[words], ends[words]) if len(words) else (np.zeros(0, np.int64),) * 2
        blob = data.tobytes()
        more, size2 = self.alone([blob[s:e] for s, e in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)])
        sizes = np.zeros(len(first), np.int64)
        sizes[stem[first]], sizes[~stem[first]] = size, size2
        source = np.zeros(len(first), np.int64)
        source[stem[first]], source[~stem[first]] = np.cumsum(size) - size, np.cumsum(size2) - size2 + len(values)
        values = np.concatenate([values, more]).astype(self.kind)
        length, source = sizes[number], source[number]
        border = np.append(0, np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))).tolist()
        return [values[ranges(source[s:e], length[s:e])].tobytes() + last for s, e in zip(border[:-1], border[1:], strict=True)]


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str, ranks: dict[bytes, int] | None) -> Pieces:
    """The worker's own cache, which outlasts a task: this function is sent by name, while what a closure names is copied."""
    if path not in _pieces:
        _pieces[path] = Pieces(path, ranks)
    return _pieces[path]


def tokenise(docs: DataFrame, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian, two bytes, or four for more than 65,536 ids; with the end id), n_tokens."""
    sent = session(docs).sparkContext.broadcast(ranks_of(path))  # as long as the vocabulary

    def apply(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        pieces = pieces_of(path, sent.value)
        width = np.dtype(pieces.kind).itemsize
        for b in batches:
            ids = pieces.encode(b.column("text").to_pylist(), end_id)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // width for x in ids], pa.int64()), pa.array([width] * len(ids), pa.int32())], ["doc_id", "ids", "n_tokens", "width"])

    return mapped(text_bytes(docs, id_col, text_col), apply, "doc_id long, ids binary, n_tokens long, width int")


def _count(batches):
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        for ids, width in zip(b.column("ids").to_pylist(), b.column("width").to_pylist(), strict=True):
            got = np.bincount(np.frombuffer(ids, "<u2" if width == 2 else "<u4"))
            if len(got) > len(total):
                total = np.append(total, np.zeros(len(got) - len(total), np.int64))
            total[: len(got)] += got
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["id", "n"])


def write(tokens: DataFrame, path: str, shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> None:
    """tokens as tokenise() gives them, from a table. Writes path/code and path/blocks."""
    spark = session(tokens)
    counts = mapped(tokens.select("ids", "width"), _count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = counts["id"].to_numpy(), counts["n"].to_numpy()
    weight = np.zeros(int(ids.max(initial=0)) + 1, np.int64)
    weight[ids] = n
    lengths = limited_lengths(weight)
    used = np.flatnonzero(lengths)
    spark.createDataFrame(pa.table({"id": used, "bits": lengths[used]}), "id long, bits long").coalesce(1).write.parquet(f"{path}/code")
    code = spark.sparkContext.broadcast((canonical(lengths), lengths))

    def blocks(batches):
        from pyspark import TaskContext

        shard, before = TaskContext.get().partitionId(), 0
        codes, bits = code.value
        docs, sizes, parts, held = [], [], [], 0

        def emit():
            ids = np.concatenate(parts).astype(np.int64)
            stream, segments = encode_block(ids, codes, bits)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((shard, pa.int32()), (before, pa.int64()), (len(ids), pa.int64()), (stream, pa.binary()), (pack(segments), pa.binary()), (docs, pa.list_(pa.int64())), (sizes, pa.list_(pa.int64())))], ["shard", "before", "n_ids", "stream", "segments", "doc_ids", "doc_sizes"])

        for b in batches:
            for doc, data, width in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), b.column("width").to_pylist(), strict=True):
                docs.append(doc)
                parts.append(np.frombuffer(data, "<u2" if width == 2 else "<u4"))
                sizes.append(len(parts[-1]))
                held += sizes[-1]
                if held >= block_ids:
                    yield emit()
                    before, docs, sizes, parts, held = before + held, [], [], [], 0
        if docs:
            yield emit()

    shards = max(1, min(MAX_SHARDS, -(-int(n.sum()) // shard_ids)))
    dealt = tokens.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "ids")
    schema = "shard int, before long, n_ids long, stream binary, segments binary, doc_ids array<long>, doc_sizes array<long>"
    mapped(dealt, blocks, schema).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (little-endian, four bytes each)."""
    code = spark.read.parquet(f"{path}/code").toArrow()
    lengths = np.zeros(int(code["id"].to_numpy().max(initial=0)) + 1, np.int64)
    lengths[code["id"].to_numpy()] = code["bits"].to_numpy()
    blocks = spark.read.parquet(f"{path}/blocks")
    totals = {r.shard: r.n for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).toLocalIterator()}
    first = dict(zip(sorted(totals), np.cumsum([0, *(totals[k] for k in sorted(totals))]).tolist(), strict=False))
    sent = spark.sparkContext.broadcast((lengths, first))

    def decode(batches):
        lengths, first = sent.value
        decoder = Decoder(lengths)
        for b in batches:
            for r in b.to_pylist():
                ids = decoder.block(r["stream"], np.frombuffer(unpack(r["segments"])[0], "<u2"), r["n_ids"]).astype("<u4")
                ends = np.cumsum(r["doc_sizes"])
                starts = ends - r["doc_sizes"]
                data = memoryview(ids.tobytes())
                own = [bytes(data[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["before"] + first[r["shard"]], pa.int64()), pa.array(r["doc_sizes"], pa.int64()), pa.array(own, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    session(blocks)
    return mapped(blocks, decode, "doc_id long, start long, n_tokens long, ids binary")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import new_path

    tokens = materialise(tokenise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
    write(tokens, path := new_path(spark))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def brute_lengths(counts: list[int]) -> int:
    """Total bits of the best code without a limit, for tests."""
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = heap[0] if len(heap) == 1 else 0
    while len(heap) > 1:
        heapq.heappush(heap, both := heapq.heappop(heap) + heapq.heappop(heap))
        total += both
    return total


def brute(docs: list[tuple], path: str, end_id: int = END_ID) -> dict:
    """doc_id -> (start, n_tokens, crc32), by the library on whole texts, for tests."""
    from tokenizers import Tokenizer

    tokenizer, out, start = Tokenizer.from_file(path), {}, 0
    for doc, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out[doc] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out
