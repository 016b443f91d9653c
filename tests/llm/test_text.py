import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import EDGES, PROSE, documents
from oracle import SF
from pyspark.sql import functions as F

from trackwright.llm import bpe, byte_cnn, mixing, token_store
from trackwright.llm import quality_rules as qr
from trackwright.session import table

tokenizers = pytest.importorskip("public_tokenizers")
RANKS, WORDS = tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.path("word_bpe_49k.json")


def rule_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark):
    rng = random.Random(3)
    texts = [*EDGES[:6], EDGES[7], "a b a b a b", "#x# $%\n#x# $%\n\n#x# $%"] + [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (3, 30, 90)]
    rows = qr.quality_rules(documents(spark, texts)).orderBy("doc_id").collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows] == [rule_counts(t) for t in texts]
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)


GOOD = " ".join(f"word{i}" for i in range(60))


def test_bad_host_takes_its_good_documents_with_it(spark):
    texts = ["short"] * 40 + [GOOD] + [GOOD] * 30 + ["short"] * 2 + [GOOD]
    sources = ["bad"] * 41 + ["good"] * 32 + [None]
    docs = documents(spark, texts, sources)
    rows = {r.doc_id: r for r in qr.quality_rules(docs).collect()}
    assert not rows[40].kept
    assert not rows[40].base_failed
    assert rows[41].kept
    assert rows[73].kept
    assert 0 < rows[41].host_rate < 0.5 < rows[40].host_rate < 1
    assert qr.keep_good(docs).count() == 31
    assert qr.keep_good(docs).columns == docs.columns
    assert qr.quality_rules(docs.where("false")).count() == 0


def test_stage_rejects_symbols_repeated_lines_and_far_hosts(spark):
    symbols = " ".join(f"w{i} #" for i in range(60))
    lines = "\n".join(f"line {i} has these w{i} x{i} y{i} z{i} v{i} words\nagain" for i in range(8))
    texts = [GOOD, symbols, lines] + [GOOD] * 95 + ["short"] * 5 + [GOOD] * 40 + ["short"] * 60 + [GOOD] * 98 + ["short"] * 2
    sources = [None] * 3 + ["a"] * 100 + ["far"] * 100 + ["b"] * 100
    sources += [f"h{i % 6}" for i in range(300)]
    texts += [GOOD if i >= 18 else "short" for i in range(300)]
    docs = documents(spark, texts, sources)
    rows = {r.doc_id: r for r in qr.quality_rules(docs).collect()}
    assert [rows[i].passed for i in range(3)] == [True, False, False]
    assert not any(rows[i].base_failed for i in range(3))
    assert {r.host for r in rows.values() if r.host_outlier} == {"far"}
    assert all(not r.passed for r in rows.values() if r.host == "far")
    assert all(r.kept == (not r.base_failed and r.host != "far") for r in rows.values())
    assert {r.doc_id for r in qr.keep_good(docs).collect()} == {i for i, r in rows.items() if r.passed}


def test_host_verdict_acts_on_real_documents(spark):
    """Three of four real documents of one host are cut to three words: the host goes, with its good documents, and no other does."""
    docs = table(spark, SF.replace("sf0.001", "sf0.01"), "documents")
    host = docs.groupBy("source").count().orderBy(F.desc("count"), "source").first()["source"]
    cut = F.when((F.col("source") == host) & (F.pmod(F.xxhash64("doc_id"), F.lit(4)) > 0), F.lit("only three words")).otherwise(F.col("text"))
    rows = qr.quality_rules(docs.withColumn("text", cut)).collect()
    assert not any(r.kept or r.passed for r in rows if r.host == host)
    assert sum(not r.base_failed for r in rows if r.host == host) > 1
    assert all(r.kept == (not r.base_failed) for r in rows if r.host != host)
    assert all(r.kept == (not r.base_failed) for r in qr.quality_rules(docs).collect())


def test_quality_counts_of_long_and_repeated_rows(spark):
    texts = ["x" * 70_000, "word " * 30_000, "a line of text\n" * 5_000, "same", "same"]
    rows = sorted(qr.quality_rules(documents(spark, texts, ids=[0, 1, 2, 3, 3])).collect(), key=lambda r: (r.doc_id, r.n_words))
    assert [(r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) for r in rows] == [(1, 70_000, 0, 0), (30_000, 120_000, 0, 30_000), (20_000, 55_000, 4_999, 20_000), (1, 4, 0, 0), (1, 4, 0, 0)]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.ranks(RANKS).ranks, special_tokens={})


def odd_texts():
    rng = random.Random(8)
    wide, narrow = "ab 'stlm\n\t\r  é1 2½　中ñ́\x1c\x85\xa0!?#ÀßÉµ²A.,", "ab 's\n é1 2½ñ!?#ÀßÉA., "
    return ["".join(rng.choice(wide if k % 2 else narrow) for _ in range(rng.randint(0, 40))) for k in range(2000)] + [t or "" for t in EDGES] + ["ab" * 3000, " a", "\na", "a ", "don't"]


def test_bpe_is_the_library(spark, tiktoken_encoding):
    own = bpe.encoder(RANKS, tokenizers.PATTERN)
    for text, ids in zip(odd_texts(), own.encode(odd_texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tiktoken_encoding.encode_ordinary(text), repr(text)


def test_segment_trees_agree():
    r, rng = bpe.ranks(RANKS), random.Random(1)
    pieces = ["".join(rng.choice("abehrst") for _ in range(rng.randint(2, 60))).encode() for _ in range(300)]
    assert r.merge_many(pieces, 64) == [r.merge_one(p) for p in pieces]


def test_bpe_rows(spark):
    docs = documents(spark, EDGES, ids=[0, 0, None, *range(3, 10)])
    rows = bpe.bpe_decode(bpe.bpe_encode(docs, RANKS, tokenizers.PATTERN), RANKS).collect()
    assert sorted(r.decoded.decode() for r in rows) == sorted(t or "" for t in EDGES)
    assert all(r.n_tokens == len(r.ids) // 4 for r in rows)
    assert bpe.bpe_encode(docs.where("false"), RANKS, tokenizers.PATTERN).count() == 0


def test_word_encoder_is_the_library():
    own = token_store.encoder(WORDS)
    for text, ids in zip(odd_texts(), own.encode(odd_texts()), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_are_the_librarys():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    texts = ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y<|startoftext|>", "A <|ENDOFTEXT|> b", "<|endoftext|", "東京<|endoftext|>", "a\t<|endoftext|>", *odd_texts()]
    for text, ids in zip(texts, token_store.encoder(WORDS).encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert library.encode(texts[0], add_special_tokens=False).ids == [320, 49407, 321]


@pytest.mark.parametrize("encoding", ["delta", "dictionary"])
def test_token_store_round_trip(spark, tmp_path, encoding):
    texts = [*EDGES, *(f"document number {i}" for i in range(40))]
    docs = documents(spark, texts, ids=[97 * i % 501 for i in range(len(texts))])
    path = f"{tmp_path}/store"
    token_store.write_tokens(docs, path, WORDS, end_id=1, encoding=encoding)
    rows = token_store.with_checksum(token_store.read_tokens(spark, path)).orderBy("id").collect()
    own, start = token_store.encoder(WORDS), 0
    for r, (i, text) in zip(rows, sorted((97 * i % 501, t or "") for i, t in enumerate(texts)), strict=True):
        ids = np.array([*own.tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        assert (r.id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    part = next(p for p in (tmp_path / "store").glob("*.parquet"))
    column = pq.ParquetFile(part).metadata.row_group(0).column(5)
    assert ("DELTA_BINARY_PACKED" in column.encodings) == (encoding == "delta")
    assert column.has_offset_index


def test_token_store_looks_a_unit_up_once_for_megabytes_of_text():
    """The smaller a slice, the more often its units come again in others."""
    batch = pa.RecordBatch.from_pydict({"text": [PROSE * (1_000_000 // len(PROSE))] * 3})
    assert [part.num_rows for part in token_store.slices(iter([batch]), "text", token_store.AT_ONCE)] == [3]


def test_token_store_null_and_repeated_ids(spark, tmp_path):
    texts = ["b c", "a", None, "<|endoftext|>", "a"]
    token_store.write_tokens(documents(spark, texts, ids=[7, None, 7, 3, 7]), f"{tmp_path}/s", WORDS, end_id=1)
    rows = sorted(token_store.read_tokens(spark, f"{tmp_path}/s").collect(), key=lambda r: r.start)
    assert [r.id for r in rows] == [None, 3, 7, 7, 7]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    assert sorted(map(tuple, (r.ids for r in rows))) == sorted([(320, 1), (1,), (49407, 1), (320, 1), (*token_store.encoder(WORDS).tokenizer.encode("b c", add_special_tokens=False).ids, 1)])


def test_token_store_selective_read(spark, tmp_path, monkeypatch):
    """One id is in one row group by the ids' statistics; and a read of metadata leaves the column of ids alone."""
    monkeypatch.setattr(token_store, "ROW_GROUP", 16 << 10)
    rng = random.Random(1)
    docs = documents(spark, [" ".join(str(rng.randint(0, 10**9)) for _ in range(60)) for _ in range(3000)])
    token_store.write_tokens(docs, f"{tmp_path}/s", WORDS)
    groups = [f.metadata.row_group(g).column(0).statistics for p in (tmp_path / "s").glob("*.parquet") for f in [pq.ParquetFile(p)] for g in range(f.metadata.num_row_groups)]
    assert len(groups) > 8
    assert sum(s.min <= 123 <= s.max for s in groups) == 1
    store = spark.read.parquet(f"{tmp_path}/s")
    plan = store.where("id = 123").select("n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,123)" in plan
    assert "ids" not in plan.split("ReadSchema")[1].split(">")[0]


def test_token_store_of_nothing(spark, tmp_path):
    token_store.write_tokens(documents(spark, ["a"]).where("false"), f"{tmp_path}/none", WORDS)
    assert token_store.read_tokens(spark, f"{tmp_path}/none").count() == 0


def labelled_texts(n=160):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "house", "stands", "near", "water", "and", "trees", "grow"]) for _ in range(60))
    bad = lambda: " ".join("".join(rng.choice("#$%&") for _ in range(5)) for _ in range(60))
    return [good() if i % 2 else bad() for i in range(n)], [i % 2 for i in range(n)]


def test_cnn_learns_and_scores_all(spark):
    texts, labels = labelled_texts()
    docs = documents(spark, texts + EDGES)
    table = spark.createDataFrame([(i, y, None) for i, y in enumerate(labels)], "doc_id bigint, quality int, text string")
    net = byte_cnn.fit(docs, table.where("doc_id % 4 <> 2"), shape=byte_cnn.Shape(filters=8))
    rows = byte_cnn.score(docs, net).orderBy("doc_id").collect()
    assert len(rows) == len(texts) + len(EDGES)
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([(rows[i].score >= 0.5) == labels[i] for i in range(2, len(texts), 4)]) > 0.95
    assert rows[len(texts)].score == rows[len(texts) + 1].score


def description_by_hand(net, text):
    """Mean, largest and smallest answer of each filter over the chunks of two blocks, position by position."""
    s, text = net.shape, text or b"\0"
    padded = text + b"\0" * s.width
    answers = [net.bias + sum(net.table[j, padded[i + j]] for j in range(s.width)) for i in range(len(text))]
    tops = [np.maximum(np.max(answers[k : k + 2 * s.block], axis=0), 0) for k in range(0, max(1, len(text) - s.block), s.block)]
    return np.concatenate([np.mean(tops, axis=0), np.max(tops, axis=0), np.min(tops, axis=0)])


CHUNKED = (b"", b"a", b"x" * 127, b"y" * 128, b"ab" * 65, bytes(range(256)) * 5, b"z" * 129, b"q" * 384)


def test_cnn_scores_by_all_chunks(spark):
    net = byte_cnn.Network.fresh(byte_cnn.Shape(filters=4))
    net.weights[:] = np.random.default_rng(0).normal(size=12)
    for text in CHUNKED:
        want = 1 / (1 + np.exp(-(description_by_hand(net, text) @ net.weights + net.offset)))
        assert net.probabilities([b"zz", text, b"q" * 300])[1] == pytest.approx(want, abs=1e-5)


def test_cnn_trains_on_whole_texts():
    """Only the last of many chunks tells the labels apart, in texts longer than a tile."""
    rng = random.Random(1)
    length = byte_cnn._TILE + 5000
    texts = [bytes(rng.choice(b"abcd") for _ in range(2000)) * (length // 2000) + (b"#%#%#%" if i % 2 else b"efefef") for i in range(6)]
    net = byte_cnn.Network.fresh(byte_cnn.Shape(filters=4, steps=60, batch=6))
    net.train(texts, np.array([i % 2 for i in range(6)], float))
    p = net.probabilities(texts)
    assert all((p[i] > 0.5) == i % 2 for i in range(6))


def test_cnn_handles_null_and_repeated_ids(spark):
    texts, labels = labelled_texts(40)
    docs = documents(spark, [*texts, "a b", None], ids=[*range(39), 38, None, None])
    table = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(None, 1), (3, None)], "doc_id bigint, quality int")
    rows = byte_cnn.score(docs, byte_cnn.fit(docs, table, shape=byte_cnn.Shape(filters=4, steps=20))).collect()
    assert len(rows) == 42
    assert sum(r.doc_id is None for r in rows) == 2


def test_cnn_without_labels(spark):
    docs = documents(spark, ["a", None])
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    assert [r.score for r in byte_cnn.score(docs, byte_cnn.fit(docs, none)).collect()] == [0.5, 0.5]
    assert byte_cnn.score(docs.where("false"), None).count() == 0


def domains(spark, labels):
    return spark.createDataFrame([(i, "good" if y else "bad") for i, y in enumerate(labels)], "doc_id bigint, domain string")


def test_mixing_meets_its_targets(spark):
    texts, labels = labelled_texts()
    docs = documents(spark, [*texts, "", None])
    rows = mixing.mix(docs, domains(spark, labels), {"good": 0.8, "bad": 0.2}).collect()
    total = sum(r.n_tokens for r in rows)
    assert sum(r.n_tokens * r.rate * r.p_good for r in rows) / total == pytest.approx(0.8, abs=0.01)
    assert sum(r.n_tokens * r.rate * r.p_bad for r in rows) / total == pytest.approx(0.2, abs=0.01)
    assert all(r.rate >= 0 and r.copies >= 0 and abs(r.p_good + r.p_bad - 1) < 1e-9 for r in rows)
    assert {r.rate for r in rows if not r.n_tokens} == {1.0}


def test_rates_solve_the_least_squares(spark):
    """Against plain projected gradient in numpy over the same table."""
    rng = np.random.default_rng(2)
    p, t = rng.dirichlet([0.5] * 3, 200), rng.integers(1, 400, 200)
    table = spark.createDataFrame([(int(n), row.tolist()) for n, row in zip(t, p, strict=True)], "n_tokens bigint, p array<double>")
    targets = np.array([0.6, 0.3, 0.1])
    fit = mixing.fit_rates(table, targets, mixing.Settings(max_steps=200, tolerance=1e-7, max_rate=1.5))
    w = fit.rates(p, t)
    slow, step = np.ones(200), 1 / np.linalg.eigvalsh((p * t[:, None]).T @ p / t.sum())[-1]
    for _ in range(5000):
        slow = np.clip(slow - step * (p @ ((slow * t) @ p / t.sum() - targets)), 0, 1.5)
    miss = lambda x: np.abs((x * t) @ p / t.sum() - targets).max()
    assert miss(w) <= miss(slow) + 1e-3


@pytest.mark.parametrize("shares", [(0.94, 0.05, 0.01), (0.985, 0.01, 0.005)])
def test_default_settings_meet_targets_of_rare_domains(spark, shares):
    p = np.repeat(np.full((3, 3), 0.01) + np.eye(3) * 0.97, np.round(np.array(shares) * 2000).astype(int), axis=0)
    t = np.random.default_rng(3).integers(50, 400, len(p))
    table = spark.createDataFrame([(int(n), row.tolist()) for n, row in zip(t, p, strict=True)], "n_tokens bigint, p array<double>")
    targets = np.array([0.9, 0.05, 0.05])
    fit = mixing.fit_rates(table, targets, mixing.Settings())
    assert fit.converged
    assert (fit.rates(p, t) * t) @ p / t.sum() == pytest.approx(targets, rel=1e-3)


def test_unreachable_targets_are_reported(spark, caplog):
    """With rates of at most 1 the rare domain can't grow: the fit is the nearest point, and says what it misses."""
    p, t = np.repeat(np.eye(2), [90, 10], axis=0), np.full(100, 10)
    table = spark.createDataFrame([(int(n), row.tolist()) for n, row in zip(t, p, strict=True)], "n_tokens bigint, p array<double>")
    fit = mixing.fit_rates(table, np.array([0.5, 0.5]), mixing.Settings(max_rate=1.0))
    assert fit.converged
    assert (fit.rates(p, t) * t) @ p / t.sum() == pytest.approx([0.5, 0.1], abs=1e-5)
    assert fit.residual == pytest.approx([0.0, -0.4], abs=1e-5)
    assert "missed" in caplog.text


def test_anchored_weights_are_reached(spark, caplog):
    """All tokens of the anchor stay; a domain with more than its weight thins out to it, one with less keeps all it has."""
    p = np.repeat(np.full((3, 3), 0.005) + np.eye(3) * 0.985, [1600, 395, 5], axis=0)
    t = np.random.default_rng(3).integers(50, 400, len(p))
    table = spark.createDataFrame([(int(n), row.tolist()) for n, row in zip(t, p, strict=True)], "n_tokens bigint, p array<double>")
    targets = mixing.anchored(table, {"a": 0.9, "b": 0.05, "c": 0.05}, "a")
    present = t @ p / t.sum()
    assert [targets[d] for d in "abc"] == pytest.approx([present[0], present[0] / 18, present[2]])
    fit = mixing.fit_rates(table, np.array([targets[d] for d in "abc"]), mixing.Settings(max_rate=1.0))
    assert (fit.rates(p, t) * t) @ p / t.sum() == pytest.approx([targets[d] for d in "abc"], abs=0.005)
    assert fit.rates(p, t)[:1600].min() > 0.98


def test_mixing_edges(spark):
    docs = documents(spark, EDGES, ids=[0, 0, None, *range(3, 10)])
    none = spark.createDataFrame([], "doc_id bigint, domain string")
    rows = mixing.mix(docs, none, {"a": 0.5, "b": 0.5}).collect()
    assert len(rows) == len(EDGES)
    assert {r.p_a for r in rows} == {0.5}
    taken = mixing.take_mixture(docs, none, {"a": 1.0, "b": 1.0})
    assert taken.columns == docs.columns
    assert mixing.mix(docs.where("false"), none, {"a": 1.0}).count() == 0


def test_rows_that_repeat_id_and_text_draw_one_by_one(spark):
    """Null ids and copies: about the share that the rate asks for stays, not all or none."""
    texts = ["some words of a good text here"] * 600 + [f"words of text {i} and more" for i in range(600)]
    docs = spark.createDataFrame([(None if i < 900 else i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, copies string").repartition(4)
    none = spark.createDataFrame([], "doc_id bigint, domain string")
    taken = mixing.take_mixture(docs, none, {"a": 0.25, "b": 0.25}, settings=mixing.Settings(max_rate=1.0))
    assert taken.columns == docs.columns
    kept = [r.text for r in taken.collect()]
    assert 0.4 * 600 < sum(t == texts[0] for t in kept) < 0.6 * 600
    assert 0.4 * 600 < sum(t != texts[0] for t in kept) < 0.6 * 600
    again = mixing.take_mixture(docs.where("doc_id is not null").repartition(7), none, {"a": 0.25, "b": 0.25}, settings=mixing.Settings(max_rate=1.0))
    first = mixing.take_mixture(docs.where("doc_id is not null"), none, {"a": 0.25, "b": 0.25}, settings=mixing.Settings(max_rate=1.0))
    assert {r.doc_id for r in again.collect()} == {r.doc_id for r in first.collect()}


def test_copies_follow_rates(spark):
    got = spark.range(20000).select(mixing.copies(F.lit(1.3), 1, F.col("id")).alias("c")).groupBy("c").count().collect()
    assert {r.c for r in got} == {1, 2}
    assert next(r["count"] for r in got if r.c == 2) == pytest.approx(6000, rel=0.1)


def test_digest_form():
    ids = np.array([1, 2], "<u4").tobytes()
    assert hashlib.sha256(ids).hexdigest() == hashlib.sha256(b"\1\0\0\0\2\0\0\0").hexdigest()
