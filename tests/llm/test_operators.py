"""Each operator against brute force, round trips or held-out labels, and at the edges of its input."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from thermaline.llm import common, components, minimisers, op1_chat_format, op2_byte_bpe, op3_decontaminate, op4_token_file, op5_substring_dedup, op6_suffix_array, op7_exact_dedup, op8_language_id, op9_quality, op10_jaccard_join, registry

DATA = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def plain(rows):
    return sorted(tuple(str(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    r = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    assert plain(registry.queries()[name](spark, DATA).select(*cols).collect()) == plain(r.fetchall())


def test_chats_at_the_edges(spark):
    rows = [(1, 0, "user", "<|turn|><\\|part|>[INST]"), (1, 1, "user", None), (1, 1, "user", None), (1, 2, "assistant", "a</s>"), (1, 3, "assistant", "<\\\\s>b"), (2, None, None, ""), (None, 0, "assistant", "é😀")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in op1_chat_format.read_chats(op1_chat_format.format_chats(df)).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", "<|turn|><\\|part|>[INST]"), ("user", ""), ("user", ""), ("assistant", "a</s>"), ("assistant", "<\\\\s>b")]
    assert got[1].loss_texts == ["a</s>", "<\\\\s>b"] and got[2].loss_texts == [] and got[None].loss_texts == ["é😀"]
    assert got[1].formatted.count("<|turn|>") == 2 and op1_chat_format.format_chats(df.limit(0)).count() == 0


def test_long_chats_and_clashing_columns(spark):
    turns = spark.range(1500).selectExpr("7L AS conv_id", "id AS turn", "IF(id % 3 = 0, 'user', 'assistant') AS role", "repeat('w', CAST(id % 50 AS INT)) AS text", "id AS t", "'x' AS runs", "1 AS segs", "'y' AS `a.b`", "0 AS starts")
    got = op1_chat_format.read_chats(op1_chat_format.format_chats(turns)).first()
    rows = turns.orderBy("turn").collect()
    assert [tuple(t) for t in got.turns] == [(r.role, r.text) for r in rows] and got.loss_texts == [r.text for r in rows if r.role == "assistant"]


def test_bpe(spark, odd, odd_rows):
    got = op2_byte_bpe.digest(op2_byte_bpe.decode(op2_byte_bpe.encode(odd, BPE, public_tokenizers.PATTERN), BPE)).collect()
    want = [(d, *op2_byte_bpe.brute([(d, t)], BPE, public_tokenizers.PATTERN)[d]) for d, t in odd_rows]
    assert plain(got) == plain(want) and op2_byte_bpe.encode(odd.limit(0), BPE, public_tokenizers.PATTERN).count() == 0


def test_bpe_documents(documents):
    got = op2_byte_bpe.digest(op2_byte_bpe.decode(op2_byte_bpe.encode(documents, BPE, public_tokenizers.PATTERN), BPE)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == op2_byte_bpe.brute(pairs(documents), BPE, public_tokenizers.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\t\x1c\xa0　ab'sé1!", max_size=30))
def test_words_of_bpe_partition_the_matches(text):
    bpe = op2_byte_bpe.encoding(BPE, public_tokenizers.PATTERN) if not op2_byte_bpe._encodings else next(iter(op2_byte_bpe._encodings.values()))
    op2_byte_bpe._encodings[BPE] = bpe
    assert [i for w in op2_byte_bpe.WORD.findall(text) for i in bpe.encode_ordinary(w)] == bpe.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r\x1c\x85\xa0\u2028\u3000\u4e00ab'\xe91!", max_size=20), max_size=8))
def test_blocks_split_texts_like_the_pattern(texts):
    block = op2_byte_bpe._Block(list(range(len(texts))), [t.encode() for t in texts])
    data = block.data.tobytes()
    words = [data[s:e].decode() for s, e in zip(block.starts.tolist(), block.ends.tolist(), strict=True)]
    assert words == [w for t in texts for w in op2_byte_bpe.WORD.findall(t)]
    if words:
        first, number, _ = common.distinct_words(block.data, block.starts, block.ends)
        assert [words[first[i]] for i in number.tolist()] == words and len(first) == len(set(words))


def test_scans_that_differ_are_noticed(spark):
    """Positions whose block has no words, as a second scan in another order would leave them, stop the job."""
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": [b"one two", b"three"]})
    positions = list(op2_byte_bpe._split(op2_byte_bpe._Block.position_rows, 3)([rows]))
    with pytest.raises(RuntimeError):
        list(op2_byte_bpe._gather(None)(positions))


def test_decontamination(spark, odd, odd_rows):
    bench = spark.createDataFrame([(1, " ".join(f"W{i}" for i in range(100, 115))), (2, "ONE"), (None, "it's i"), (4, None)], "item_id long, text string")
    rows = [(d, t) for d, t in odd_rows if d != 5]
    want = op3_decontaminate.brute(rows, [("null" if r.item_id is None else r.item_id, r.text) for r in bench.collect()])
    got = op3_decontaminate.digest(op3_decontaminate.scan(odd.where("doc_id <> 5 OR doc_id IS NULL"), bench)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and want[10][1] == 15
    assert sorted(r.doc_id or 0 for r in op3_decontaminate.decontaminate(odd, bench).collect()) == sorted(d or 0 for d, _ in odd_rows if d not in (8, 10, 11, 12))
    assert op3_decontaminate.decontaminate(odd, bench.limit(0)).columns == odd.columns


def test_benchmark_in_slices(spark, documents, monkeypatch):
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    whole = plain(op3_decontaminate.digest(op3_decontaminate.scan(documents, bench)).collect())
    monkeypatch.setattr(op3_decontaminate, "SLICE_WORDS", 300)
    assert plain(op3_decontaminate.digest(op3_decontaminate.scan(documents, bench)).collect()) == whole


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 10**7), min_size=1, max_size=300), st.integers(0, 2**31))
def test_huffman(counts, seed):
    counts = np.array(counts)
    lengths = op4_token_file.limited_lengths(counts)
    assert lengths.max() <= op4_token_file.MAX_BITS and (2.0**-lengths).sum() <= 1
    if lengths.max() < op4_token_file.MAX_BITS:
        assert (lengths * counts).sum() == max(op4_token_file.brute_lengths(counts.tolist()), counts.sum())
    ids = np.random.default_rng(seed).integers(0, len(counts), 777)
    stream, segments = op4_token_file.encode_block(ids, op4_token_file.canonical(lengths), lengths)
    assert (op4_token_file.Decoder(lengths).block(stream, segments, 777) == ids).all()


def test_token_file(spark, documents, odd, odd_rows):
    with_null = documents.select("doc_id", "text").union(spark.sql("SELECT 10000000L, cast(NULL AS string)"))
    path = common.new_path(spark)
    op4_token_file.write(common.materialise(op4_token_file.tokenise(with_null, WORDS)), path, shard_ids=20_000, block_ids=3_000)
    got = {r.doc_id: (r.start, r.n_tokens, zlib.crc32(r.ids)) for r in op4_token_file.read(spark, path).collect()}
    assert got == op4_token_file.brute(pairs(with_null), WORDS)
    ids = {r.doc_id: r.ids for r in op4_token_file.tokenise(odd, WORDS).collect()}
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    for d, t in odd_rows:
        assert np.frombuffer(ids[d], "<u2").tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2]
    op4_token_file.write(common.materialise(op4_token_file.tokenise(odd.limit(0), WORDS)), path := common.new_path(spark))
    assert op4_token_file.read(spark, path).count() == 0


def test_added_tokens_in_capitals_are_ordinary_text(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    texts = ["<|ENDOFTEXT|>", "<|EndOfText|>", "a <|endoftext|> B <|STARTOFTEXT|>", "X<|EndOfText|>Y <|endoftext|>Z, <|ENDOFTEXT|>.", "<| ENDOFTEXT |> Plain WORDS <|startoftext|>A"]
    ids = {r.doc_id: r.ids for r in op4_token_file.tokenise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORDS).collect()}
    for d, t in enumerate(texts):
        assert np.frombuffer(ids[d], "<u2").tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]


def passages(spark):
    """Passages of 45 to 70 words that many documents share, in different surroundings and also back to back."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(300)]
    shared = [[rng.choice(words) for _ in range(n)] for n in (45, 50, 51, 70, 60)]
    rows = []
    for d in range(60):
        parts = [rng.choice(shared) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(40))] for _ in range(rng.randrange(6))]
        rows.append((rng.randrange(10**6) if d % 10 else 7, " ".join(w for p in parts for w in p)))
    rows += [(1, "same " * 200), (2, "same " * 120), (3, None), (None, " ".join(shared[3])), (4, " ".join(shared[3])), (4, " ".join(shared[3]))]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


@pytest.mark.parametrize("module", [op5_substring_dedup, op6_suffix_array])
@pytest.mark.parametrize("hot", [minimisers.HOT, 3])
def test_substrings(spark, module, hot, monkeypatch):
    df, rows = passages(spark)
    monkeypatch.setattr(minimisers, "HOT_LIST", 10**9)
    want = sorted(minimisers.brute(rows), key=str)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in module.dedup(df, hot=hot).collect()), key=str) == want
    assert sum(n for _, _, n, _ in want) > 1000 and module.dedup(df.limit(0)).count() == 0


def test_substrings_at_the_edges(odd, odd_rows):
    for module in (op5_substring_dedup, op6_suffix_array):
        got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in module.dedup(odd).collect()]
        assert sorted(got, key=str) == sorted(minimisers.brute(odd_rows), key=str)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**56 - 1), min_size=1, max_size=400), st.lists(st.integers(0, 2**56 - 1), min_size=1, max_size=400))
def test_quotient_filters_lose_nothing(a, b):
    one = [np.unique(np.array(x, np.uint64), return_counts=True) for x in (a, b, a)]
    got = op7_exact_dedup.merge_filters([op7_exact_dedup.encode_filter(v, c) for v, c in one])
    want = np.unique(np.array(a + b + a, np.uint64), return_counts=True)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_exact_dedup(odd, odd_rows):
    got = op7_exact_dedup.mark(odd).collect()
    text = {}
    for d, t in odd_rows:
        text.setdefault(t or "", []).append(d)
    want = [(d, max((x for x in text[t or ""] if x is not None), default=None), len(text[t or ""]), d == max((x for x in text[t or ""] if x is not None), default=None), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in odd_rows]
    assert plain(got) == plain(want)
    kept = op7_exact_dedup.dedup(odd.union(odd))
    assert kept.columns == odd.columns and sorted(r.text or "" for r in kept.collect()) == sorted(text)
    assert op7_exact_dedup.mark(odd.limit(0)).count() == 0


def test_forged_fingerprints_are_told_apart_by_bytes(documents, monkeypatch):
    monkeypatch.setattr(op7_exact_dedup.F, "xxhash64", lambda *c: op7_exact_dedup.F.lit(5).cast("long"))
    assert {r.group_size for r in op7_exact_dedup.mark(documents.dropDuplicates(["text"])).collect()} == {1}


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op8_language_id.train(docs, 100)
    got = op8_language_id.fuse(op8_language_id.of_documents(docs, docs["doc_id"], docs["lang"].alias("true")), model).collect()
    assert sum(r.lang == r.true for r in got) / len(got) > 0.99 and sum(r.accepted for r in got) / len(got) > 0.99
    kept = op8_language_id.accept(odd)
    assert kept.columns == odd.columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()} and op8_language_id.accept(odd.limit(0)).count() == 0
    pages = spark.createDataFrame([(1, "http://u@h.example.fr:8/x", "<html lang='fr'><script>no</script><p>the of</p>"), (2, None, None), (3, "??", "<p>")], "page_id long, url string, html string")
    seen = op8_language_id.of_pages(pages, pages["page_id"]).orderBy("page_id").collect()
    assert (seen[0].declared, seen[0].host, seen[0].suffix) == ("fr", "h.example.fr", "fr") and b"no" not in seen[0].text
    assert op8_language_id.fuse(op8_language_id.of_pages(pages, pages["page_id"]), model).count() == 3


def test_evidence_of_host_and_markup_decides_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op8_language_id.train(docs, 100)
    rows = [(i, d.text.encode(), "fr", "h.fr", "fr") for i, d in enumerate(docs.where("lang = 'fr'").limit(60).collect())] + [(-1, b"la", "fr", "h.fr", "fr"), (-2, b"", None, None, None)]
    got = {r.id: r for r in op8_language_id.fuse(spark.createDataFrame(rows, "id long, text binary, declared string, host string, suffix string"), model).collect()}
    assert got[-1].lang == "fr" and got[-1].posterior > 0.9 and not got[-2].accepted


def test_fusion_against_plain_code(spark):
    """Likelihoods, smoothed priors of suffix and host, and the table of declarations, added up by loops."""
    import math
    from collections import Counter

    model = op8_language_id.TextModel({x: np.random.default_rng(i).integers(0, 40, op8_language_id.SLOTS).astype(float) for i, x in enumerate(("aa", "bb"))})
    rng, words = random.Random(11), ["lorem", "ipsum", "dolor", "sit", "été", "x1", ""]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(8))).encode(), rng.choice([None, "aa", "bb", "zz"]), rng.choice([None, "h1.aa", "h2.bb"]), None) for i in range(60)]
    rows = [(i, t, d, h, h and h[-2:]) for i, t, d, h, _ in rows]
    got = {r.id: r for r in op8_language_id.fuse(spark.createDataFrame(rows, "id long, text binary, declared string, host string, suffix string"), model).collect()}
    names, k = model.languages, op8_language_id.SMOOTH
    ll = {r[0]: model.likelihoods([r[1]])[0] for r in rows}
    heard = {i: names[int(np.argmax(v))] if v.any() else None for i, v in ll.items()}
    seen = [r for r in rows if heard[r[0]]]
    tally = lambda keep: [sum(heard[r[0]] == x for r in seen if keep(r)) for x in names]
    smooth = lambda own, above: [(a + k * b) / (sum(own) + k) for a, b in zip(own, above, strict=True)]
    whole = tally(lambda r: True)
    corpus = [(a + 1) / (sum(whole) + len(names)) for a in whole]
    said = Counter((r[2] if r[2] in names else "und", heard[r[0]]) for r in seen if r[2])
    for i, _, declared, host, suffix in rows:
        prior = smooth(tally(lambda r: r[3] == host and r[4] == suffix), smooth(tally(lambda r: r[4] == suffix), corpus)) if host and any(r[3] == host for r in seen) else corpus
        of = declared if declared in names else "und"
        chance = [(said[of, h] + (k * 0.8 if of == h else k * 0.2 / len(names))) / (sum(said[d, h] for d in names) + k) if declared else 1.0 for h in names]
        score = [a + math.log(b) + math.log(c) for a, b, c in zip(ll[i], prior, chance, strict=True)]
        best = int(np.argmax(score))
        assert got[i].lang == names[best] and abs(got[i].posterior - 1 / sum(math.exp(x - score[best]) for x in score)) < 1e-9
        assert got[i].accepted == (heard[i] is not None and names[best] != "und" and got[i].posterior >= op8_language_id.ACCEPT)


@pytest.mark.parametrize("name", ["op2", "op3", "op7", "op8", "op10"])
def test_odd_column_names(spark, documents, name):
    docs = documents.limit(30).withColumn("a.b", documents["doc_id"]).withColumn("my col", documents["lang"])
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    if name == "op2":
        tokens = op2_byte_bpe.encode(docs, BPE, public_tokenizers.PATTERN).withColumn("a.b", op2_byte_bpe.F.lit(1)).withColumn("my col", op2_byte_bpe.F.lit("x"))
        assert op2_byte_bpe.decode(tokens, BPE).columns == ["doc_id", "n_tokens", "ids", "a.b", "my col", "decoded"] and op2_byte_bpe.decode(tokens, BPE).count() == 30
        return
    kept = {"op3": lambda: op3_decontaminate.decontaminate(docs, bench), "op7": lambda: op7_exact_dedup.dedup(docs), "op8": lambda: op8_language_id.accept(docs), "op10": lambda: op10_jaccard_join.dedup(docs)}[name]()
    assert kept.columns == docs.columns and all(r["a.b"] == r["doc_id"] and r["my col"] == r["lang"] for r in kept.collect())


def test_large_groups_of_copies_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(op7_exact_dedup, "HOT", 3)
    rows = [(i, "same" if i % 3 else f"t{i // 6}") for i in range(60)] + [(None, "same"), (59, "same")]
    got = op7_exact_dedup.mark(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size = {t: sum(x == t for _, x in rows) for _, t in rows}
    most = {t: max(d for d, x in rows if x == t and d is not None) for _, t in rows}
    assert plain((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == plain((d, most[t], size[t], d == most[t]) for d, t in rows)


def test_risk_against_plain_descent():
    """The model's non-negative risk isn't above that of weights found by plain gradient steps on the same bins."""
    import math

    rng = np.random.default_rng(4)
    positive = rng.normal(1.0, 1.0, (60, 2))
    unlabelled = np.concatenate([rng.normal(1.0, 1.0, (60, 2)), rng.normal(-1.5, 1.0, (60, 2))])
    model = op9_quality.Model(positive, unlabelled, 0.5)
    p, u = model.bins(positive).tolist(), model.bins(unlabelled).tolist()
    soft = lambda x: math.log1p(math.exp(x)) if x < 30 else x

    def risk(w, c):
        fp, fu = [sum(w[i] for i in x) + c for x in p], [sum(w[i] for i in x) + c for x in u]
        return 0.5 * sum(soft(-f) for f in fp) / len(p) + max(0.0, sum(map(soft, fu)) / len(u) - 0.5 * sum(map(soft, fp)) / len(p))

    w, c = [0.0] * len(model.weights), 0.0
    for _ in range(150):
        g, gc = [0.0] * len(w), 0.0
        for rows, part in ((p, lambda f: 0.5 * (-1 / (1 + math.exp(f))) - 0.5 / (1 + math.exp(-f))), (u, lambda f: 1 / (1 + math.exp(-f)))):
            for x in rows:
                d = part(sum(w[i] for i in x) + c) / len(rows)
                gc += d
                for i in x:
                    g[i] += d
        w, c = [a - 1.0 * b for a, b in zip(w, g, strict=True)], c - 1.0 * gc
    assert risk(model.weights.tolist(), model.offset) <= risk(w, c) + 0.02
    flat = np.linspace(0, 1, 1000)
    assert abs(op9_quality.estimate_prior(np.linspace(0.5, 1, 500), np.concatenate([flat[flat < 0.5], np.linspace(0.5, 1, 1500)])) - 0.75) < 0.01
    assert op9_quality.estimate_prior(np.zeros(0), flat) == 0.5


def test_quality(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = op9_quality.fit(docs, labels)
    got = {r.doc_id: r for r in op9_quality.score(docs, model).collect()}
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for d, r in got.items())
    assert sum(q == r.predicted for q, r in held) / len(held) > 0.97
    edge = op9_quality.score(odd, model).collect()
    assert len(edge) == odd.count() and all(0 <= r.score <= 1 for r in edge)
    nothing = op9_quality.fit(docs.limit(0), labels.limit(0))
    assert {r.score for r in op9_quality.score(odd, nothing).collect()} == {0.5}


def near_copies(spark):
    rng = random.Random(3)
    words = ["the", "of", "and", "to"] * 30 + [f"u{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 9, 12, 40, 120, 400]))]
        for _ in range(rng.choice([1, 3, 40])):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((rng.randrange(10**7), " ".join(copy)))
    rows += [(rng.randrange(10**7), " ".join(rng.choice(["the", "of", "and"]) for _ in range(30))) for _ in range(40)]
    return list(dict(rows).items())


@pytest.mark.parametrize(("shingle", "percent", "max_group"), [(3, 90, 30_000), (5, 80, 30_000), (3, 90, 5)])
def test_jaccard(spark, shingle, percent, max_group):
    rows = near_copies(spark)
    got = op10_jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), shingle, percent, max_group=max_group).collect()
    want = op10_jaccard_join.brute(rows, shingle, percent)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and sum(d != c for d, (_, c) in want.items()) > 50


def test_one_component_of_many_near_copies(spark):
    """Buckets of some 400 copies in blocks of 64, of which most link with few others."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for d in range(400):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 3, 4])):
            copy[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        rows.append((d, " ".join(copy)))
    got = op10_jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), max_group=64).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == op10_jaccard_join.brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 400), min_size=1, max_size=200), min_size=2, max_size=12), st.sampled_from([50, 80, 90]))
def test_sketches_lose_no_link(sets, percent):
    """Whatever could link is named, in whatever round; sets within a component aren't named again."""
    s = op10_jaccard_join.Shingler({}, 1000, 3, percent)
    sets += [set(list(x)[: -1 - len(x) // 20]) or x for x in sets]
    columns = [np.column_stack([np.array(sorted(x), np.uint64)] * 2) * np.uint64(0x9E3779B97F4A7C15) for x in sets]
    b = op10_jaccard_join.Bucket([len(x) for x in sets], [bytes([i]) for i in range(len(sets))], [s.sketch(c) for c in columns], [0] * len(sets), percent)
    named = {(i, j) for a, c, _ in b.nearest(0) for i, j in zip(a.tolist(), c.tolist(), strict=True)}
    assert all((i, j) in named for i, x in enumerate(sets) for j, y in enumerate(sets) if i != j and 100 * len(x & y) >= percent * len(x | y))
    b.label[:] = 0
    assert not list(b.nearest(0))


def test_repeated_ids_lose_no_text(spark):
    base, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"z{i}" for i in range(60))
    rows = [(3, base, 1), (5, base + " extra", 2), (5, other, 3), (7, other + " more", 4), (8, base, 5), (9, "alone here", 6), (9, "alone here", 7), (None, base, 8), (10, None, 9), (10, "", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int")
    got = op10_jaccard_join.dedup(docs)
    assert got.columns == docs.columns
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted([(3, base), (5, other), (9, "alone here"), (None, base), (10, None), (10, "")], key=str)


def test_frequent_tokens_are_indexed_by_pairs():
    rng = random.Random(1)
    s = op10_jaccard_join.Shingler({b"the": 200, b"of": 200, b"and": 200}, 10_000, 3, 90)
    s.frequent = 0
    base = [rng.choice(["the", "of", "and", *map(str, range(60))]) for _ in range(150)]
    one = s.tokens(" ".join(base).encode())
    for _ in range(30):
        copy = list(base)
        for _ in range(3):
            copy[rng.randrange(150)] = "new"
        two = s.tokens(" ".join(copy).encode())
        both = len(np.intersect1d(one[:, 1], two[:, 1]))
        if 100 * both >= 90 * (len(one) + len(two) - both):
            assert set(s.signatures(one[:, 0].copy())[1]) & set(s.signatures(two[:, 0].copy())[1])


@pytest.mark.parametrize(("shingle", "percent", "words"), [(3, 90, 11), (5, 80, 8)])
def test_one_word_more_is_linked(spark, shingle, percent, words):
    rows = []
    for g, names in enumerate([[f"r{i}" for i in range(words + 1)], ["the"] * 3 + ["of"] * 3 + ["and", "to", "the", "and", "of", "to"]]):
        text = names[: words + 1]
        rows += [(10 * g + 1, " ".join(text[:-1])), (10 * g + 2, " ".join(text)), (10 * g + 3, " ".join(text[1:]))]
    rows += [(100 + i, " ".join(random.Random(i).choices(["the", "of", "and", "to"], k=40))) for i in range(40)]
    got = op10_jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), shingle, percent).collect()
    want = op10_jaccard_join.brute(rows, shingle, percent)
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert all(want[d][1] == 1 for d in (1, 2, 3)) and all(want[d][1] == 11 for d in (11, 12, 13))


@pytest.mark.parametrize(("shingle", "percent"), [(3, 90), (5, 80)])
def test_one_token_more_shares_a_signature(shingle, percent):
    rng = random.Random(2)
    for n in range(1, 60):
        s = op10_jaccard_join.Shingler({}, 1000, shingle, percent)
        for _ in range(30):
            more = np.sort(np.array([rng.randrange(1 << 12) << 48 | rng.randrange(1 << 48) for _ in range(n + 1)], np.uint64))
            less = np.delete(more, rng.randrange(n + 1))
            s.frequent = rng.choice([0, 1 << 11, 1 << 12])
            shared = set(s.signatures(more)[1].tolist()) & set(s.signatures(less)[1].tolist())
            assert shared or 100 * n < percent * (n + 1)


@pytest.mark.parametrize("percent", [10, 30, 50, 60, 70, 80, 90])
def test_low_thresholds_share_a_signature(percent):
    rng = random.Random(4)
    sizes = [(29, 48), (16, 32), (1, 2), (1, 9), (2, 3), (12, 40), *[(n, rng.randrange(n, 100 * n // percent + 1)) for n in range(1, 90)]]
    for n, m in sizes:
        s = op10_jaccard_join.Shingler({}, 1000, 3, percent)
        for _ in range(10):
            both = -(-percent * (n + m) // (100 + percent))  # the fewest that are enough
            if both > n:
                continue
            every = np.array([rng.randrange(1 << 12) << 48 | i << 8 for i in range(n + m - both)], np.uint64)
            one, two = np.sort(every[:n]), np.sort(every[n - both :])
            s.frequent = rng.choice([0, 1 << 11])
            assert set(s.signatures(one)[1].tolist()) & set(s.signatures(two)[1].tolist()) or n == m == both


@pytest.mark.parametrize("percent", [50, 60])
def test_low_thresholds_are_linked(spark, percent):
    rng = random.Random(6)
    words = ["the", "of", "and", "to", "a", "in"]
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in range(200)]
    for g, (n, m) in enumerate([(16, 32), (29, 48), (30, 50), (17, 33)]):
        text = rng.choices(words, k=m + 1)
        rows += [(1000 + 10 * g, " ".join(text)), (1001 + 10 * g, " ".join(text[: n + 1]))]
    got = op10_jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 2, percent).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == op10_jaccard_join.brute(rows, 2, percent)


def test_jaccard_at_the_edges(spark, odd):
    got = plain(op10_jaccard_join.join(odd).collect())
    assert ("None", "5", "None") in got and ("1", "0", "1") in got and got.count(("5", "1", "5")) == 2 and ("6", "1", "5") in got
    assert op10_jaccard_join.join(odd.limit(0)).count() == 0 and op10_jaccard_join.dedup(odd).columns == odd.columns


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAzZ ßéÉ́'’.,!?19<|>\n\t\xa0日ıİ", max_size=24), max_size=6))
def test_pieces_are_encoded_as_by_the_library(texts):
    from tokenizers import Tokenizer

    pieces = op4_token_file.pieces_of(WORDS, op4_token_file.ranks_of(WORDS))
    library = Tokenizer.from_file(WORDS)
    texts += ["don't STOP, now!!", "Übergröße naïve.", "x.y z,.", "<|endoftext|> <|ENDOFTEXT|>."]
    got = [np.frombuffer(x, pieces.kind).tolist() for x in pieces.encode([t.encode() for t in texts], 2)]
    assert got == [[*library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_merger_gives_the_librarys_ids_for_words(spark):
    """All words of the documents and the vocabulary's own, by least rank and by the library."""
    from tokenizers import Tokenizer

    pieces, library = op4_token_file.pieces_of(WORDS, op4_token_file.ranks_of(WORDS)), Tokenizer.from_file(WORDS)
    texts = [t for _, t in pairs(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")) if t]
    words = sorted({w for t in texts for w in t.lower().split() if w.isascii() and w.isalpha()} | {t.removesuffix("</w>") for t in library.get_vocab() if t.removesuffix("</w>").isascii() and t.removesuffix("</w>").isalpha() and t.islower()})
    data = np.frombuffer("".join(words).encode(), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    ids, size = pieces.merged(data, np.append(0, ends[:-1]), ends)
    assert pieces.merger and [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_roots(links):
    u, v = (np.array([x[i] for x in links], np.int64) for i in (0, 1))
    label = components.roots(u, v, 41)
    group = {i: {i} for i in range(41)}
    for a, b in links:
        both = group[a] | group[b]
        for x in both:
            group[x] = both
    assert label.tolist() == [min(group[i]) for i in range(41)]


def test_components_at_once_and_by_stars(spark):
    rng = random.Random(9)
    links = [(f"n{rng.randrange(300)}".encode(), f"n{rng.randrange(300)}".encode()) for _ in range(200)] + [(f"c{i}".encode(), f"c{i + 1}".encode()) for i in range(30)]
    df = spark.createDataFrame(links, "u binary, v binary")
    classes = []
    for bound in (10**6, 0):
        by = {}
        for r in components.components(df, bound).collect():
            by.setdefault(bytes(r.label), set()).add(bytes(r.node))
        classes.append(sorted(map(sorted, by.values())))
    assert classes[0] == classes[1] and max(map(len, classes[0])) >= 31
    assert components.components(df.limit(0)).count() == 0
