import re

import numpy as np
import pytest
from helpers import EDGES, PROSE, documents
from pyspark.sql import functions as F

from trackwright.llm import exact_dedup as ex
from trackwright.llm import line_dedup as ld
from trackwright.llm import minhash as mh


def exact_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def test_exact_dedup_edges(spark):
    texts = [*EDGES, "a b", "ab", "a\tb ", "ab"]
    got = ex.exact_dedup(documents(spark, texts), capacity=2, max_depth=6).collect()
    want = exact_by_hand(enumerate(texts))
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_dedup_null_and_repeated_ids(spark):
    got = ex.exact_dedup(documents(spark, ["a", "a", "a", "b"], ids=[None, 3, 3, None])).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in got) == [
        ("3", "3", 3, True), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "None", 1, True)
    ]


@pytest.mark.parametrize(("texts", "ids", "want"), [
    (["a", "a", "a", "b"], [None, 3, 3, None], [("3", "a"), ("3", "a"), ("None", "b")]),
    (["a", "a", "b", "c"], [1, 3, 3, 4], [("1", "a"), ("3", "b"), ("4", "c")]),
])
def test_keep_first_goes_by_row(spark, texts, ids, want):
    kept = ex.keep_first(documents(spark, texts, ids=ids))
    assert kept.columns == documents(spark, texts, ids=ids).columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == want


def test_exact_dedup_hash_collisions_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(ex.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    got = ex.exact_dedup(documents(spark, ["a", "b", "a", "c"])).collect()
    assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == {0: (0, 2), 1: (1, 1), 2: (0, 2), 3: (3, 1)}


def test_directory_covers_the_hash_space(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h64"))
    slots = ex.build_directory(keys, capacity=100, max_depth=12).collect()
    depth = slots[0].global_depth
    assert sorted(r.slot for r in slots) == list(range(2**depth))
    assert all(r.n_keys <= 100 for r in slots)
    assert depth >= 5


def test_exact_dedup_empty_table(spark):
    assert ex.exact_dedup(documents(spark, ["a"]).where("false")).count() == 0
    assert ex.keep_first(documents(spark, ["a", "a"])).columns[:2] == ["doc_id", "text"]


PASSAGE = [f"shared line number {i} of the passage" for i in range(12)]


def test_line_dedup_removes_repeated_chunks_but_for_the_first(spark):
    one = "\n".join(["first opening", *PASSAGE, "first ending"])
    two = "\n".join(["second opening", "second line", *PASSAGE, "second ending"])
    got = {r.doc_id: r for r in ld.line_dedup(documents(spark, [one, two, "alone\nhere"])).collect()}
    assert got[0].text == one
    assert got[1].n_removed_lines >= 4
    assert "second opening" in got[1].text
    assert "second ending" in got[1].text
    assert got[2].text == "alone\nhere"


def test_line_dedup_edges(spark):
    got = ld.line_dedup(documents(spark, [None, "", "\n\n\n\n", "a", *EDGES])).collect()
    assert len(got) == 4 + len(EDGES)
    assert all(r.n_lines >= 1 for r in got)
    assert ld.line_dedup(documents(spark, ["a"]).where("false")).count() == 0
    same = ld.line_dedup(documents(spark, ["a\nb\nc\nd\ne\nf"] * 2, ids=[1, 1])).collect()
    assert same[0].text == same[1].text


def line_dedup_by_hand(rows):
    """rows: (id, text). Text left of each row, by plain loops over lines."""
    import hashlib

    order = lambda i: (i is None, i or 0)
    chunks, seen, gone = [], {}, {}
    for k, (i, text) in enumerate(rows):
        lines = (text or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        for first in range(len(lines) - 1):
            if (h[first + 1] + 31 * h[first]) % 4:
                ends = [n for n in range(first + 1, min(first + 16, len(lines))) if (h[n] + 31 * h[n - 1]) // 4 % 4]
                chunks += [(*order(i), first, k, ends[0])] if ends else []
    for *_, first, k, last in sorted(chunks):
        lines = (rows[k][1] or "").split("\n")
        key = tuple(lines[first : last + 1])
        at = seen.get((k, key)) or seen.get(key)
        seen[k, key] = (k, first)
        seen.setdefault(key, (k, first))
        if at is None:
            continue
        source = (rows[at[0]][1] or "").split("\n")
        low, high = first, last
        while low > 0 and low - (first - at[1]) > 0 and lines[low - 1] == source[low - 1 - (first - at[1])]:
            low -= 1
        while high + 1 < len(lines) and high + 1 - (first - at[1]) < len(source) and lines[high + 1] == source[high + 1 - (first - at[1])]:
            high += 1
        gone.setdefault(k, set()).update(range(low, high + 1))
    return ["\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in gone.get(k, ())) for k, (_, t) in enumerate(rows)]


def test_line_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(6)
    shared = [f"passage {i} has line {i * 7} in it" for i in range(30)]
    texts = []
    for k in range(60):
        own = [f"text {k} says {n}" for n in range(rng.integers(0, 9))]
        at, n = int(rng.integers(0, 25)), int(rng.integers(0, 9))
        texts.append("\n".join(own[:3] + shared[at : at + n] + own[3:] + (["x", "y"] * int(rng.integers(0, 4)))))
    texts += [None, "", "\n\n\n\n", "é\nb" * 3000]
    ids = [*range(63), None]
    got = {r.doc_id: r.text for r in ld.line_dedup(documents(spark, texts, ids=ids)).collect()}
    assert got == dict(zip(ids, line_dedup_by_hand(list(zip(ids, texts, strict=True))), strict=True))


def test_planted_passages_go_whole_but_for_the_first(spark):
    """Passages of 3 to 8 lines between different neighbours: one goes whole or, where it has no chunk, stays whole."""
    texts, found = [], {}
    for n in range(3, 9):
        for k in range(20):
            passage = [f"passage {n} {k} line {i} with a dozen words or so to make it long enough" for i in range(n)]
            texts += [(n, k, d, "\n".join([f"before {n} {d} {k}", *passage, f"after {n} {d} {k}"])) for d in range(3)]
    got = {r.doc_id: r.text for r in ld.line_dedup(documents(spark, [t[3] for t in texts])).collect()}
    for i, (n, k, d, text) in enumerate(texts):
        if d == 0:
            assert got[i] == text
        else:
            assert got[i] in (text, f"before {n} {d} {k}\nafter {n} {d} {k}")
            found.setdefault(n, []).append(got[i] != text)
    assert [np.mean(found[n]) >= least for n, least in ((3, 0.7), (4, 0.85), (5, 0.9), (6, 0.95), (7, 0.95), (8, 0.95))] == [True] * 6


def test_line_dedup_long_texts_of_few_different_lines(spark):
    """Many repeated chunks in one text: what is drawn out follows the text's length, not its square."""
    kinds = np.random.default_rng(2).integers(0, 41, 12_000)
    mixed, cycle = [f"line of kind {k}" for k in kinds], [f"turn {k % 41}" for k in range(30_000)]
    texts = ["\n".join(mixed), "\n".join(["a line before", *mixed[100:700], "a line behind"])]
    got = {r.doc_id: r.text for r in ld.line_dedup(documents(spark, [*texts, "\n".join(cycle)])).collect()}
    assert got[2] == "\n".join(cycle[:41])
    assert [got[0], got[1]] == line_dedup_by_hand(list(enumerate(texts)))


def test_line_dedup_ranges_reach_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ld, "BLOCK", 3)
    monkeypatch.setattr(ld, "REACH", 2)
    monkeypatch.setattr(ld, "GROWTH", 2)
    lines = [f"number {i}" for i in range(90)]
    texts = ["\n".join(["x", *lines, "y"]), "\n".join(["z", "zz", *lines[:50], "other", *lines[50:]]), "\n".join(lines[7:80])]
    got = {r.doc_id: r.text for r in ld.line_dedup(documents(spark, texts)).collect()}
    assert got == dict(enumerate(line_dedup_by_hand(list(enumerate(texts)))))


def test_line_dedup_null_and_repeated_ids(spark):
    text = "\n".join(PASSAGE)
    got = ld.line_dedup(documents(spark, [text, text, text, "alone\nhere"], ids=[None, 5, 5, None])).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("5", text), ("5", text), ("None", ""), ("None", "alone\nhere")]


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def components_by_hand(texts, k, percent):
    sets = [shingles(t, k) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= percent * len(a | b) and label[i] > label[j]:
                    label[i], changed = label[j], True
    return [(len(s), c) for s, c in zip(sets, label, strict=True)]


def near_texts():
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = list(rng.choice(vocabulary, 120))
        texts.append(" ".join(base))
        for edits in (1, 3, 8, 14, 25):
            copy = list(base)
            for at in rng.choice(120, edits, replace=False):
                copy[at] = str(rng.choice(vocabulary)).upper()
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("k", [2, 5])
def test_minhash_matches_brute_force(spark, k):
    texts = near_texts() + EDGES
    got = mh.near_duplicates(documents(spark, texts), p=mh.MinHash(words=k)).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in got] == components_by_hand(texts, k, 80)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_pivots_and_final_pairs_agree(spark):
    texts = near_texts()
    eager = mh.near_duplicates(documents(spark, texts), p=mh.MinHash(words=2, enough=0.0)).orderBy("doc_id").collect()
    assert [r.component_id for r in eager] == [c for _, c in components_by_hand(texts, 2, 80)]


def test_minhash_null_ids_and_empty_table(spark):
    got = mh.near_duplicates(documents(spark, [PROSE, PROSE, "", None], ids=[None, 5, 6, 7])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("5", "5", True), ("6", "6", True), ("7", "7", True), ("None", "None", True)]
    assert mh.near_duplicates(documents(spark, ["a"]).where("false")).count() == 0


def test_keep_one_each_goes_by_row(spark):
    other = " ".join(f"other{i}" for i in range(40))
    docs = documents(spark, [PROSE, PROSE, other, PROSE, ""], ids=[1, 3, 3, None, 3])
    kept = mh.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", PROSE), ("3", other), ("None", PROSE), ("3", "")])


def test_shingle_hashes_have_no_collisions():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdé"), rng.integers(1, 6))) for _ in range(5000)] + ["a" * 300, "a" * 301]
    text = " ".join(words)
    assert len(mh.shingle_sets([text.encode()], 2)[0]) == len(shingles(text, 2))


def test_posterior_bounds():
    p = mh.MinHash()
    limits = mh.least_matches(p)
    assert [n for n, _ in limits] == [48, 96, 144, 192, 240]
    rng = np.random.default_rng(1)
    equal = rng.binomial(1, 0.8, (20000, 240)).cumsum(axis=1)
    assert all((equal[:, n - 1] >= m).all() for n, m in limits)
