"""Language ID by Bayesian fusion of evidence.

Text: likelihood of byte trigrams under one multinomial a language, trained on TRAIN_DOCS labelled documents a language at
most (those with the least hash of doc_id), and under a flat model that stands for no known language ('und'). Long texts
count as EVIDENCE trigrams, because trigrams aren't independent. Address and markup: a grouped aggregation of what the
texts say counts languages by suffix and host, and by declared language. The prior of a host is smoothed towards its
suffix, the suffix towards the whole corpus; the declared language is a likelihood whose table is smoothed likewise. All
evidence is added in logarithms. A row is accepted if its best language isn't 'und' and has ACCEPT of the posterior.

Defined cases: null texts are empty, have no text evidence, and are never accepted; null hosts, suffixes or declarations
give no evidence of their own; repeated rows are judged alike; without labelled rows everything is 'und'; an empty table
gives no rows; other columns are carried in a struct. A very long text is read in pieces of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import mapped, materialise, session, table

SLOTS = 1 << 16
TRAIN_DOCS = 400
#: Bytes of text that a worker turns into trigrams at once.
CHUNK = 1 << 20
EVIDENCE = 100
ACCEPT = 0.5
SMOOTH = 20.0
UNKNOWN = "und"
#: Hosts up to this many (some 100 bytes each) are sent to the executors; beyond, rows are joined by a shuffle.
BROADCAST_HOSTS = 200_000


def _pieces(texts: list[bytes]):
    """(number of the text, its letters and spaces) in pieces of CHUNK bytes at most; pieces of a text overlap by two."""
    for k, text in enumerate(texts):
        words = b" ".join(text.translate(_LETTERS).split())
        words = b" " + words + b" " if words else b""
        for at in range(0, len(words) - 2, CHUNK):
            yield k, words[at : at + CHUNK + 2]


def _groups(texts: list[bytes]):
    """Pieces of texts, together CHUNK bytes or little more: what is worked on at once, however long a text is."""
    group, held = [], 0
    for piece in _pieces(texts):
        group.append(piece)
        held += len(piece[1])
        if held >= CHUNK:
            yield group
            group, held = [], 0
    if group:
        yield group


def trigrams(pieces: list[bytes]) -> np.ndarray:
    """Slots of the byte trigrams of the pieces, which have three bytes at least, one piece after another."""
    joined = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
    code = (joined[:-2] << 16) | (joined[1:-1] << 8) | joined[2:]
    ends = np.cumsum([len(x) for x in pieces])[:-1]
    keep = np.ones(len(code), bool)
    keep[np.concatenate([ends - 1, ends - 2])] = False
    return ((code[keep] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int32)


_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


class TextModel:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = [*sorted(counts), UNKNOWN]
        table = [np.log((counts[x] + 0.5) / (counts[x].sum() + 0.5 * SLOTS)) for x in self.languages[:-1]]
        # What a text of evenly drawn letters and spaces would have.
        self.table = np.vstack([*table, np.full(SLOTS, -3 * np.log(27.0))])

    def likelihoods(self, texts: list[bytes]) -> np.ndarray:
        out, sizes = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for group in _groups(texts):
            owner, n = np.array([k for k, _ in group]), np.array([len(x) - 2 for _, x in group], np.int64)
            slots, starts = trigrams([x for _, x in group]), np.cumsum(n) - n
            np.add.at(sizes, owner, n)
            for k, row in enumerate(self.table):
                np.add.at(out[:, k], owner, np.add.reduceat(row[slots], starts))
        return out / np.maximum(sizes, 1)[:, None] * np.minimum(sizes, EVIDENCE)[:, None]


def train(docs: DataFrame, per_language: int = TRAIN_DOCS) -> TextModel:
    """docs: doc_id, text, lang. A language's sample is the rows whose hash of doc_id is in a share of all hashes, which is
    so large that it holds per_language of them but for a chance in millions; those of the least hash train."""
    session(docs)
    known = docs.where("lang IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("of"))
    h = F.xxhash64("doc_id", F.lit(8))
    share = known.join(F.broadcast(sizes), "lang").where(F.shiftrightunsigned(h, 11).cast("double") * F.col("of") < (per_language + 6 * per_language**0.5 + 10) * 2.0**53)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    some = share.select("lang", "doc_id", "text", h.alias("h")).dropDuplicates(["lang", "doc_id"]).withColumn("k", rank).where(F.col("k") <= per_language).select("lang", "text")

    def count(batches):
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                for group in _groups([text]):
                    slots, n = np.unique(trigrams([x for _, x in group]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(slots, pa.int32()), pa.array(n, pa.int64())], ["lang", "slot", "n"])

    counts: dict[str, np.ndarray] = {}
    got = mapped(some, count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    for lang, slot, n in zip(got["lang"].to_pylist(), got["slot"].to_pylist(), got["n"].to_pylist(), strict=True):
        counts.setdefault(lang, np.zeros(SLOTS))[slot] = n
    return TextModel(counts)


def _likelihoods(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows with ll (one for each language) and heard (the text's best language, null for texts without evidence)."""
    sent = session(rows).sparkContext.broadcast(model)

    def apply(batches):
        for b in batches:
            ll = sent.value.likelihoods(b.column("text").to_pylist())
            heard = [sent.value.languages[k] if any_ else None for k, any_ in zip(ll.argmax(axis=1).tolist(), (ll != 0).any(axis=1).tolist(), strict=True)] if len(ll) else []
            names = [n for n in b.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(ll.tolist(), pa.list_(pa.float64())), pa.array(heard, pa.string())], [*names, "ll", "heard"])

    fields = [f for f in rows.schema if f.name != "text"]
    return mapped(rows, apply, StructType([*fields, StructField("ll", ArrayType(DoubleType())), StructField("heard", StringType())]))


def fuse(rows: DataFrame, model: TextModel) -> DataFrame:
    """rows: text (binary), declared, host, suffix, and what else is to be kept. Adds lang, posterior, accepted."""
    languages = model.languages
    heard = _likelihoods(rows.select("text", "declared", "host", "suffix"), model).where("heard IS NOT NULL")
    counts = materialise(heard.groupBy("declared", "host", "suffix", "heard").agg(F.count("*").alias("n")))
    tally = [F.sum(F.when(F.col("heard") == x, F.col("n")).otherwise(0)).cast("double") for x in languages]
    smooth = lambda own, above: f"transform({own}, (x, i) -> (x + {SMOOTH} * {above}[i]) / (aggregate({own}, 0D, (s, y) -> s + y) + {SMOOTH}))"
    whole = [x or 0.0 for x in counts.agg(*tally).first()]
    corpus = [(x + 1) / (sum(whole) + len(whole)) for x in whole]
    corpus_sql = f"array({', '.join(f'{x!r}D' for x in corpus)})"
    by_suffix = counts.groupBy("suffix").agg(F.array(*tally).alias("own")).select("suffix", F.expr(smooth("own", corpus_sql)).alias("of_suffix"))
    by_host = counts.groupBy("host", "suffix").agg(F.array(*tally).alias("own")).where("host IS NOT NULL")
    prior = materialise(by_host.join(by_suffix, by_host["suffix"].eqNullSafe(by_suffix["suffix"]), "left").select("host", by_host["suffix"].alias("host_suffix"), F.expr(smooth("own", "of_suffix")).alias("prior")))
    prior = F.broadcast(prior) if prior.count() <= BROADCAST_HOSTS else prior
    said = counts.where("declared IS NOT NULL AND heard IS NOT NULL").withColumn("declared", F.when(F.col("declared").isin(languages), F.col("declared")).otherwise(UNKNOWN)).groupBy("declared", "heard").agg(F.sum("n")).collect()
    said = {(d, h): n for d, h, n in said}
    total = {h: sum(said.get((d, h), 0) for d in languages) for h in languages}
    chance = lambda d, h: (said.get((d, h), 0) + (SMOOTH * 0.8 if d == h else SMOOTH * 0.2 / len(languages))) / (total[h] + SMOOTH)
    likely = ", ".join(f"'{d}', array({', '.join(f'{float(np.log(chance(d, h)))!r}D' for h in languages)})" for d in languages)
    flat = f"array({', '.join('0D' for _ in languages)})"
    with_prior = _likelihoods(rows, model).alias("r").join(prior.alias("p"), (F.col("r.host") == F.col("p.host")) & F.col("r.suffix").eqNullSafe(F.col("p.host_suffix")), "left")
    told = f"CASE WHEN declared IS NULL THEN {flat} ELSE coalesce(map({likely})[declared], map({likely})['{UNKNOWN}']) END"
    kept = [f"r.`{c}`" for c in rows.columns if c != "text"]
    got = with_prior.selectExpr(*kept, "heard", f"transform(ll, (x, i) -> x + ln(coalesce(prior, {corpus_sql})[i]) + ({told})[i]) AS score")
    got = got.withColumn("top", F.expr("array_max(score)")).withColumn("best", F.expr("array_position(score, top) - 1").cast("int"))
    names = f"array({', '.join(repr(x) for x in languages)})"
    got = got.withColumn("lang", F.expr(f"{names}[best]")).withColumn("posterior", F.expr("1D / aggregate(score, 0D, (s, x) -> s + exp(x - top))"))
    return got.withColumn("accepted", F.expr(f"heard IS NOT NULL AND lang <> '{UNKNOWN}' AND posterior >= {ACCEPT}")).drop("heard", "score", "top", "best")


def of_documents(docs: DataFrame, *rest) -> DataFrame:
    """Documents as evidence: the source is the host; nothing is declared."""
    return docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"), F.lit(None).cast("string").alias("declared"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"), *rest)


def of_pages(pages: DataFrame, *rest) -> DataFrame:
    """Pages as evidence: text without markup, the html element's lang, host and last label of the address."""
    host = F.lower(F.nullif(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    text = F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.lower(F.nullif(F.regexp_extract(F.coalesce("html", F.lit("")), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit("")))
    return pages.select(text.cast("binary").alias("text"), declared.alias("declared"), host.alias("host"), F.regexp_extract(host, r"([^.]+)$", 1).alias("suffix"), *rest)


def accept(docs: DataFrame) -> DataFrame:
    """The rows of docs that are accepted, with the columns of docs."""
    return fuse(of_documents(docs, F.struct("*").alias("row")), train(docs)).where("accepted").select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    rows = of_documents(docs, F.col("doc_id"), none.alias("page_id")).unionByName(of_pages(pages, none.alias("doc_id"), F.col("page_id")))
    return fuse(rows, train(docs)).select("doc_id", "page_id", "lang", F.round("posterior", 6).alias("posterior"), "accepted")
