"""N-gram Jaccard join with token-combination prefixes.

Tokens are hashes of word shingles. They are ordered by an estimate of their frequency, the product of their words'
counts over the whole corpus (levels of the TOP_WORDS most frequent words are broadcast, others count as rarest), then by
hash. Two sets of Jaccard similarity t share a token in their prefixes of n - ceil(t n) + 1 tokens. Prefix tokens of the
rare class are indexed singly. Tokens estimated to be in FREQUENT documents or more by chance are indexed as pairs within
hash classes, for which the prefix is extended by one token a class; sets that may share a single token (100 / percent
tokens at most) keep it singly, and sets that one token more would take too far are linked with equal sets alone. Classes
grow with the size of a set, so that pairs stay in proportion to it.

Equal sets are one node from the start. Nodes that share a signature form a bucket; buckets with the same nodes count once.
Inside a bucket no pairs are listed: each node names its nearest NEAREST[0] partners of another component, judged by parity
sketches (bit b of a sketch is the parity of the set's tokens in slot b, so that two sketches differ in no more bits than
the sets differ in tokens; what differs in too many bits can't link). Named pairs are verified on the whole sets, links
become components (components.py), and buckets in which a node had more candidates than it could name go another round
with more names and the new components, until nothing is left unsaid. Pairs within a component are never looked at again,
so a family of near copies costs some names a copy, not its square. Buckets of more than max_group nodes are compared in
blocks of that many, dealt over tasks.

Defined cases: null or empty texts have no shingles and are linked with nothing; texts of fewer words than a shingle have
one, the whole sequence; rows with a null doc_id are not linked and have a null component; rows with one doc_id are
separate texts; an empty table gives no rows; other columns are ignored. A very long text is one set, held in one task.
dedup() keeps, of each component, one row with the smallest doc_id, and all rows without a doc_id.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, MIX1, MIX2, mapped, materialise, measured, mix64, session, table, union
from .components import components

SHINGLE, PERCENT = 3, 90
TOP_WORDS = 1 << 16
FREQUENT = 8
#: Partners that a node may name in each round; then all that are left.
NEAREST = (3, 48)
#: Nodes of a bucket that are compared at once; larger buckets are split into blocks.
MAX_GROUP = 4096
#: Dropped rows of dedup() that are sent to all executors (16 bytes each); beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
BITMAP_BITS = 1 << 27


def _word_counts(batches):
    """Counts of words; the empty word, which no text has, counts them all."""
    count: Counter = Counter()

    def rows():
        count[b""] = sum(count.values())
        got = pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])
        count.clear()
        return got

    for b in batches:
        for t in b.column("text").to_pylist():
            count.update(t.translate(LOWER).split())
        if len(count) > 1_000_000:
            yield rows()
    yield rows()


def word_levels(base: DataFrame) -> tuple[dict[bytes, int], int]:
    """Levels (8 times the binary logarithm of the count) of the most frequent words, and the number of all words. What is taken
    is all words of the highest levels, as many levels as hold TOP_WORDS words at most: no ranking in one task."""
    counts = materialise(mapped(base.select("text"), _word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    words = counts.where(F.octet_length("word") > 0)
    level = F.floor(8 * F.log2("n"))
    cut, held = 1 << 20, 0
    for r in words.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a row for each level, some hundred
        held += r["count"]
        if held > TOP_WORDS:
            break
        cut = r.level
    top = words.where(level >= cut).toArrow()
    total = counts.where(F.octet_length("word") == 0).agg(F.sum("n")).first()[0]
    return {w: int(8 * math.log2(n)) for w, n in sorted(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True))}, total or 1


class Shingler:
    """Sets of ordered tokens: the level in the high 15 bits, 48 bits of the shingle's hash below."""

    def __init__(self, levels: dict[bytes, int], words: int, shingle: int, percent: int):
        self.number = {w: i for i, w in enumerate(levels)}
        # The last entry of each stands for words that aren't listed.
        self.level = np.array([*levels.values(), 0], np.int64)
        self.hash = np.array([*map(xxhash.xxh3_64_intdigest, levels), 0], np.uint64)
        self.shingle, self.percent = shingle, percent
        self.frequent = int(8 * ((shingle - 1) * math.log2(words) + math.log2(FREQUENT)))

    def tokens(self, text: bytes) -> np.ndarray:
        """Sorted distinct tokens: order (what decides the prefix) and identity (64 bits) of each, two columns."""
        words = text.translate(LOWER).split()
        if not words:
            return np.zeros((0, 2), np.uint64)
        get, k = self.number.get, min(self.shingle, len(words))
        at = np.array([get(w, -1) for w in words])
        h, level = self.hash[at], self.level[at]
        new = np.flatnonzero(at < 0)
        h[new] = np.fromiter(map(xxhash.xxh3_64_intdigest, map(words.__getitem__, new.tolist())), np.uint64, len(new))
        n = len(words) - k + 1
        full, rank = np.full(n, np.uint64(k)), np.zeros(n, np.int64)
        for i in range(k):
            full = (full + h[i : i + n]) * (MIX1 if i % 2 else MIX2)
            rank += level[i : i + n]
        full, at = np.unique(mix64(full), return_index=True)
        order = (rank[at].astype(np.uint64) << np.uint64(48)) | (full >> np.uint64(16))
        by = np.argsort(order, kind="stable")
        return np.column_stack([order[by], full[by]])

    @staticmethod
    def node(tokens: np.ndarray) -> bytes:
        """What equal sets have in common: size and two sums of mixed hashes."""
        a, b = mix64(tokens[:, 1] * MIX2), mix64(tokens[:, 1] ^ MIX1)
        return np.array([np.add.reduce(a) + np.uint64(len(tokens)), np.add.reduce(b)], np.uint64).tobytes()

    def signatures(self, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prefix, and what the set is indexed by."""
        n = len(order)
        low = -(-self.percent * n // 100)
        prefix = order[: n - low + 1]
        if 100 * n < self.percent * (n + 1):  # one token more is too far, and so is one less: only equal sets
            return prefix, prefix[:0]
        if (prefix[-1] >> np.uint64(48)) < self.frequent:
            return prefix, prefix
        out = []
        classes, most = self.classes(low), self.classes(100 * n // self.percent)
        if self.percent * n <= 100:  # a partner may share one token alone, which makes no pair
            out.append(prefix)
        while classes <= most:
            longer = order[: n - low + 1 + classes]
            often = (longer >> np.uint64(48)) >= self.frequent
            out.append(longer[~often])
            some = longer[often]
            kind = (mix64(some) % np.uint64(classes)).astype(np.int64)
            for c in np.unique(kind).tolist():
                own = some[kind == c]
                i, j = np.triu_indices(len(own), 1)
                out.append(mix64(own[i] * MIX1 + own[j] + np.uint64(classes)) | np.uint64(1 << 63))
            classes *= 2
        return prefix, np.unique(np.concatenate(out))

    def sketch(self, tokens: np.ndarray) -> bytes:
        """Parities of the tokens in slots, at least half as many as tokens at 90 %, as many at 80 %."""
        bits = 1 << max(6, ((len(tokens) * min(100, 5 * (100 - self.percent)) - 1) // 100).bit_length())
        return np.packbits(np.bincount((tokens[:, 1] & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()

    def classes(self, n: int) -> int:
        """A power of two near half the prefix, or less where partners may share fewer tokens; a set is indexed by those of
        all sizes that its partners may have, so that two partners have one in common."""
        return 1 << max(0, (n * min(100 - self.percent, self.percent) // 400).bit_length() - 1) if n else 1


def _prepare(base: DataFrame, sent) -> DataFrame:
    def apply(batches):
        shingler = sent.value
        for b in batches:
            rows = []
            for doc, key, text in zip(b.column("doc_id").to_pylist(), b.column("key").to_pylist(), b.column("text").to_pylist(), strict=True):
                tokens = shingler.tokens(text)
                if len(tokens):
                    rows.append((doc, key, len(tokens), shingler.node(tokens), shingler.sketch(tokens), shingler.signatures(np.ascontiguousarray(tokens[:, 0]))[1].view(np.int64)))
                else:
                    rows.append((doc, key, 0, None, None, []))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "key", "n", "node", "sketch", "sigs"])

    return mapped(base, apply, "doc_id long, key long, n long, node binary, sketch binary, sigs array<long>")


def _buckets(nodes: DataFrame) -> DataFrame:
    """sig, node, first, n, sketch, size of buckets with two nodes or more; of buckets with the same nodes one is left."""
    entry = nodes.select("node", F.explode("sigs").alias("sig")).withColumns({"h": F.xxhash64("node"), "g": F.xxhash64("node", F.lit(1))})
    over = "OVER (PARTITION BY sig)"
    entry = entry.selectExpr("sig", "node", f"count(*) {over} AS size", f"min(node) {over} AS least", f"bit_xor(h) {over} AS h", f"bit_xor(g) {over} AS g")
    entry = materialise(entry.where("size > 1"))
    kept = entry.where("node = least").groupBy("size", "h", "g").agg(F.min("sig").alias("sig")).select("sig")
    return entry.join(kept, "sig", "left_semi").select("sig", "node", "size").join(nodes.select("node", "first", "n", "sketch"), "node")


def _fold(rows: np.ndarray, words: int) -> np.ndarray:
    """Sketches of fewer slots: the parities of slots that fall together are added."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


class Bucket:
    """Nodes that share a signature. side: pairs are looked for between sides only, if there are two."""

    def __init__(self, n: list[int], label: list[bytes], sketch: list[bytes], side: list[int], percent: int):
        number: dict[bytes, int] = {}
        self.n, self.side, self.percent = np.array(n, np.int64), np.array(side, np.int64), percent
        self.label = np.array([number.setdefault(x, len(number)) for x in label], np.int64)
        self.two = len(np.unique(self.side)) > 1
        size = np.array([len(x) // 8 for x in sketch])
        self.rows = {w: np.flatnonzero(size == w) for w in np.unique(size).tolist()}
        self.sketch = {w: np.frombuffer(b"".join(sketch[i] for i in own.tolist()), "<u8").reshape(len(own), w) for w, own in self.rows.items()}

    def nearest(self, k: int):
        """(i, j, more) in turns: pairs of nodes that could link and aren't of one label, the k nearest of each i at most (all
        where k is 0), and whether some i had more."""
        if self.label.max(initial=0) == 0:
            return
        for w, own in self.rows.items():
            step = max(1, (1 << 21) // (len(self.n) * w))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                found = [self.between(w, slice(at, at + step), part, v) for v in self.rows]
                i, j, d = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((j, d, i))
                i, j = i[order], j[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                near = rank < k if k else np.ones(len(i), bool)
                yield part[i[near]], j[near], not near.all()

    def between(self, w: int, at: slice, part: np.ndarray, v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of part, nodes of sketches of v words, and in how many bits they differ, where they could link."""
        other, words = self.rows[v], min(v, w)
        a, b = self.n[part], self.n[other]
        if 100 * a.max() < self.percent * b.min() or 100 * b.max() < self.percent * a.min():
            return (np.zeros(0, np.int64),) * 3
        one, two = _fold(self.sketch[w][at], words), _fold(self.sketch[v], words)
        differ = np.zeros((len(part), len(other)), np.int32)
        for c in range(words):
            differ += np.bitwise_count(one[:, c, None] ^ two[None, :, c])
        allowed = (100 - self.percent) * (a[:, None] + b[None, :])
        fits = ((100 + self.percent) * np.maximum(differ, np.abs(a[:, None] - b[None, :])) <= allowed) & (self.label[part][:, None] != self.label[other][None, :])
        if self.two:
            fits &= self.side[part][:, None] != self.side[other][None, :]
        i, j = np.nonzero(fits)
        return i, other[j], differ[i, j]


_COLUMNS = ("sig", "block", "side", "node", "first", "label", "n", "sketch")


def _name(percent: int, k: int):
    """Rows sorted by sig and block -> u, v of named pairs; a row of sig alone for a bucket with more to say."""

    kinds = {"u": pa.binary(), "v": pa.binary(), "sig": pa.int64(), "first_u": pa.int64(), "first_v": pa.int64()}

    def pairs(rows: pa.Table):
        node, first = rows.column("node").to_pylist(), rows.column("first").to_pylist()
        bucket = Bucket(rows.column("n").to_pylist(), rows.column("label").to_pylist(), rows.column("sketch").to_pylist(), rows.column("side").to_pylist(), percent)
        unsaid, told = False, set()
        for i, j, more in bucket.nearest(k):
            unsaid |= more
            if not k:  # all pairs come from both their nodes
                i, j = i[i < j], j[i < j]
            both = [(x, y) for x, y in dict.fromkeys(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True)) if x * len(node) + y not in told]
            if k:
                told.update(x * len(node) + y for x, y in both)
            both = [(x, y) if node[x] < node[y] else (y, x) for x, y in both]
            columns = ([node[x] for x, _ in both], [node[y] for _, y in both], [None] * len(both), [first[x] for x, _ in both], [first[y] for _, y in both])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))
        if unsaid:
            sig = rows.column("sig")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([sig if c == "sig" else None], t) for c, t in kinds.items()], list(kinds))

    def apply(batches):
        rest = None
        for b in batches:
            now = pa.Table.from_batches([b.select(list(_COLUMNS))])
            rest = now if rest is None else pa.concat_tables([rest, now])
            sig, block = rest.column("sig").to_numpy(), rest.column("block").to_numpy()
            borders = [0, *(np.flatnonzero((sig[1:] != sig[:-1]) | (block[1:] != block[:-1])) + 1).tolist()]
            for s, e in zip(borders, borders[1:], strict=False):
                yield from pairs(rest.slice(s, e - s))
            rest = rest.slice(borders[-1])
        if rest is not None and len(rest):
            yield from pairs(rest)

    return apply


def _blocks(buckets: DataFrame, max_group: int) -> DataFrame:
    """buckets with block and side: a large bucket is cut in parts of max_group nodes, and each two parts meet in a block."""
    cut = buckets.withColumn("parts", F.ceil(F.col("size") / max_group).cast("int")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int"))
    block = "IF(parts = 1, array(named_struct('block', 0L, 'side', 0)), transform(sequence(0, parts - 1), x -> named_struct('block', cast(least(own, x) AS bigint) * parts + greatest(own, x), 'side', IF(own <= x, 0, 1))))"
    return cut.withColumn("at", F.explode(F.expr(block))).select("sig", "at.block", "at.side", "node", "first", "label", "n", "sketch")


def _slots(docs: pa.Array) -> np.ndarray:
    return (mix64(docs.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64(BITMAP_BITS - 1)).astype(np.int64)


def _bits(batches):
    for b in batches:
        slots = np.concatenate([_slots(b.column(c)) for c in ("first_u", "first_v")])
        yield pa.RecordBatch.from_arrays([pa.array(slots >> 6), pa.array(np.left_shift(1, slots & 63))], ["w", "b"])


def _sets(base: DataFrame, pairs: DataFrame, sent) -> DataFrame:
    """node, tokens of the pairs' nodes, from the document that each is named after. A bitmap of fixed size over doc_ids
    spares the other documents; what it lets through beyond is joined with nothing."""
    bits = mapped(pairs.select("first_u", "first_v"), _bits, "w long, b long").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    bitmap[bits["w"].to_numpy()] = bits["b"].to_numpy()
    known = base.sparkSession.sparkContext.broadcast(bitmap)

    def apply(batches):
        shingler, bitmap = sent.value, known.value
        for b in batches:
            slots = _slots(b.column("doc_id"))
            rows = []
            for text in b.column("text").filter(pa.array((bitmap[slots >> 6] >> (slots & 63)) & 1 == 1)).to_pylist():
                tokens = shingler.tokens(text)
                if len(tokens):
                    rows.append((shingler.node(tokens), np.sort(tokens[:, 1]).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1)], ["node", "tokens"])

    return mapped(base, apply, "node binary, tokens binary").dropDuplicates(["node"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs a, b those that are linked, as u, v."""

    def apply(batches):
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield b.select(["u", "v"]).take(pa.array(keep, pa.int64()))

    x, y = sets.select(F.col("node").alias("u"), F.col("tokens").alias("x")), sets.select(F.col("node").alias("v"), F.col("tokens").alias("y"))
    return mapped(pairs.join(x, "u").join(y, "v"), apply, "u binary, v binary")


def _classes(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str, max_group: int) -> DataFrame:
    """doc_id, key (a hash of the text), n_shingles, component_id, component of each row."""
    spark = session(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.cast("binary").alias("text"))
    levels, words = word_levels(base)
    sent = spark.sparkContext.broadcast(Shingler(levels, words, shingle, percent))
    prepared = materialise(_prepare(base, sent))
    linkable = prepared.where("doc_id IS NOT NULL AND n > 0")
    nodes = materialise(linkable.groupBy("node").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "sketch", "sigs")]))
    buckets = materialise(_buckets(nodes))

    labels = links = tested = known = None
    for k in (*NEAREST, 0):
        told = buckets.withColumn("label", F.col("node")) if labels is None else buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        rows = _blocks(told, max_group).repartition("sig", "block").sortWithinPartitions("sig", "block")
        named, said = measured(mapped(rows, _name(percent, k), "u binary, v binary, sig long, first_u long, first_v long"), more=F.count("sig"))
        pairs = named.where("u IS NOT NULL").select("u", "v", "first_u", "first_v").dropDuplicates(["u", "v"])
        pairs, new = measured(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"))
        if new["rows"]:
            sets = materialise(_sets(base.select("doc_id", "text"), pairs, sent))
            known = sets if known is None else union(known, sets.join(known.select("node"), "node", "left_anti"))
            found = materialise(_verify(pairs.select("u", "v"), known, percent))
            links, tested = (found, pairs) if links is None else (union(links, found), union(tested, pairs))
            labels = components(links)
        if not said["more"]:
            break
        buckets = materialise(buckets.join(named.where("sig IS NOT NULL").select("sig").distinct(), "sig", "left_semi"))
    labels = nodes.select("node", F.col("node").alias("label")).limit(0) if labels is None else labels

    in_class = nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = in_class.groupBy("label").agg(F.min("first").alias("component_id"))
    found = in_class.join(least, "label").select("node", "component_id", "label")
    linked = linkable.join(found, "node").select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id", F.col("label").alias("component"))
    alone = prepared.where("doc_id IS NULL OR n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component"))
    return union(linked, alone)


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", max_group: int = MAX_GROUP) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links lead to)."""
    return _classes(docs, shingle, percent, id_col, text_col, max_group).select("doc_id", "n_shingles", "component_id")


def dedup(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with the columns of docs. Rows are told apart by doc_id and text: of a component the row
    with the least of both stays, and repeated rows stay once."""
    rows = materialise(_classes(docs, shingle, percent, id_col, text_col, MAX_GROUP).where("component IS NOT NULL").groupBy("component", "component_id", "doc_id", "key").agg(F.count("*").alias("times")))
    best = rows.where("doc_id = component_id").groupBy("component").agg(F.min("key").alias("best"), F.count("*").alias("rivals"))
    tied = best.where("rivals > 1").select("component", "best")
    gone = rows.join(tied, "component", "left").where("doc_id <> component_id OR key <> best")
    gone = materialise(gone.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")))
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    mine = lambda x: (docs[id_col].cast("long") == x["_doc"]) & (F.xxhash64(text) == x["_key"])
    stay = docs.join(gone, mine(gone), "left_anti")
    twice = rows.where("times > 1 AND doc_id = component_id").select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"))
    if twice.isEmpty():
        return stay
    once = stay.join(twice, mine(twice), "left_semi").select(F.struct("*").alias("row"), docs[id_col].alias("doc"), F.xxhash64(text).alias("key")).dropDuplicates(["doc", "key"]).select("row.*")
    return union(stay.join(twice, mine(twice), "left_anti"), once)


def query(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))


def brute(docs: list[tuple], shingle: int = SHINGLE, percent: int = PERCENT) -> dict:
    """doc_id -> (n_shingles, component_id), by all pairs that share a shingle, for tests."""
    sets, by = {}, {}
    for doc, text in docs:
        w = (text or "").encode().translate(LOWER).split()
        k = min(shingle, len(w))
        sets[doc] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for s in sets[doc]:
            by.setdefault(s, []).append(doc)
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for doc, own in sets.items():
        shared = Counter(d for s in own for d in by[s] if d < doc)
        for other, both in shared.items():
            if 100 * both >= percent * (len(own) + len(sets[other]) - both):
                x, y = sorted((root(doc), root(other)))
                label[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}
