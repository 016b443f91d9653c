"""The registered queries against their SQL, and the pipeline against what its stages must do."""

import hashlib
import math
import os
import re
import zlib

import numpy as np
import pytest
from oracle import SF, check

import corpus_pipeline
from trackwright.llm.oracles import ORACLES
from trackwright.llm import byte_cnn
from trackwright.llm.bpe import read_ranks
from trackwright.llm.mixing import mix
from trackwright.llm.queries import MIX_TARGETS, QUERIES, URL_RULES, labelled_domains, labelled_urls
from trackwright.llm.url_filter import url_filter
from trackwright.session import materialise, table


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    check(spark, QUERIES[name], ORACLES[name])


def texts_of(spark):
    return {r.doc_id: r.text or "" for r in table(spark, SF, "documents").select("doc_id", "text").collect()}


def test_bpe_query_is_the_library(spark):
    import tiktoken

    public = pytest.importorskip("public_tokenizers")
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=read_ranks(public.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {}
    for i, text in texts_of(spark).items():
        ids = library.encode_ordinary(text)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op2_bpe"](spark, SF).collect()} == want


def test_token_store_query_is_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    want, start = {}, 0
    for i, text in sorted(texts_of(spark).items()):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op10_token_store"](spark, SF).collect()} == want


def test_url_filter_query(spark):
    urls = {r.page_id: r.url for r in table(spark, SF, "pages").collect()}
    rows = {r.page_id: r for r in url_filter(table(spark, SF, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"), labelled_urls(spark, SF)).collect()}
    assert {r.page_id: tuple(r) for r in QUERIES["op4_url_filter"](spark, SF).collect()} == {i: tuple(r) for i, r in rows.items()}
    assert set(rows) == set(urls)
    for i, url in urls.items():
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (found[1].translate({c: c + 32 for c in range(65, 91)}), found[2]) if found else ("", "")
        fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if rows[i].score >= 0.5 else "allow")
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == (host, path, rule, verdict)


def test_mixing_query_meets_its_targets(spark):
    rows = QUERIES["op6_mixing"](spark, SF).collect()
    texts, tokens = texts_of(spark), np.array([r.n_tokens for r in rows])
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    p, rates = np.array([[r[f"p_{d}"] for d in sorted(MIX_TARGETS)] for r in rows]), np.array([r.rate for r in rows])
    assert p.sum(axis=1) == pytest.approx(np.ones(len(rows)))
    assert (rates * tokens) @ p / tokens.sum() == pytest.approx([MIX_TARGETS[d] for d in sorted(MIX_TARGETS)], rel=1e-3)
    assert all(math.floor(r.rate) <= r.copies <= math.ceil(r.rate) and r.rate >= 0 for r in rows)


def test_cnn_query_scores_every_document(spark):
    rows = QUERIES["op9_byte_cnn"](spark, SF).collect()
    texts = texts_of(spark)
    labels = table(spark, SF, "labels").where("crc32(cast(doc_id as string)) % 4 <> 2")
    net = byte_cnn.fit(table(spark, SF, "documents"), labels)
    want = dict(zip(texts, net.probabilities([t.encode() for t in texts.values()]), strict=True))
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    assert all(r.score == pytest.approx(want[r.doc_id], abs=1e-5) and r.predicted == int(r.score >= 0.7) for r in rows)


def test_cnn_query_on_held_out_labels(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    if not os.path.isdir(sf):
        pytest.skip("no larger tables")
    rows = QUERIES["op9_byte_cnn"](spark, sf).where("held_out").join(table(spark, sf, "labels"), "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns, counts = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = materialise(stage(spark, docs, SF), "stage")
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns
        assert set(after) <= before
        assert len(after) == len(set(after))
        counts.append(len(after))
    assert counts[0] < table(spark, SF, "documents").count()
    assert counts[-1] > 0.5 * counts[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == counts[-1]
    assert all(r.exact for r in last)


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty, long and repeated rows, ties and clashing columns through every stage; and no rows at all."""
    from helpers import EDGES, PROSE, documents

    long = [f"{PROSE} number {i} {w} {w * 3}" for i, w in enumerate(["alpha", "beta", "gamma"])]
    texts = [*EDGES, *(t + " " + t[::-1] for t in long), long[0] + " " + long[0][::-1], long[1].replace(" ", "  ") + " " + long[1][::-1], " ".join(f"w{i}" for i in range(40_000)), None]
    ids = [*range(len(texts) - 1), None]
    docs = documents(spark, [*texts, texts[-2]], ids=[*ids, ids[-2]])
    for rows in (docs, docs.where("false")):
        columns = rows.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before = rows.count()
            rows = materialise(stage(spark, rows, SF), "edge")
            assert rows.columns == columns, name
            assert rows.count() <= before
        assert all(r.exact for r in corpus_pipeline.STAGES[-1][1](spark, rows, SF).collect())


def test_pipeline_mixes_to_its_weights(spark):
    docs, domains = table(spark, SF, "documents"), labelled_domains(spark, SF)
    rows = mix(docs, domains, corpus_pipeline.WEIGHTS, settings=corpus_pipeline.MIXING).collect()
    tokens, rates = np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    names = sorted(corpus_pipeline.WEIGHTS)
    p = np.array([[r[f"p_{d}"] for d in names] for r in rows])
    present, reached = tokens @ p, (tokens * rates) @ p
    good = names.index("good")
    assert reached[good] > 0.98 * present[good]
    for i, d in enumerate(names):
        want = min(present[i], present[good] * corpus_pipeline.WEIGHTS[d] / corpus_pipeline.WEIGHTS["good"])
        assert reached[i] == pytest.approx(want, abs=0.02 * present[good])
