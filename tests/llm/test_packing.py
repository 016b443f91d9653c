"""Packing: the plan against bounds and the best possible, pieces against the library, sequences against their documents."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import EDGES, documents
from oracle import SF

from trackwright.llm.packing import Layout, pack, pack_lengths, sequences
from trackwright.llm.queries import QUERIES, SEQUENCE
from trackwright.session import table

public = pytest.importorskip("public_tokenizers")
FILE = public.path("word_bpe_49k.json")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(FILE)


def taken(configs):
    got = Counter()
    for times, config in configs:
        for size, c in config:
            got[size] += times * c
    return got


def best_fit_decreasing(sizes, capacity):
    rooms = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= s
        else:
            rooms.append(capacity - s)
    return len(rooms)


def fewest(sizes, capacity):
    """By trying all groupings."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= sizes[i] and rooms[k] not in rooms[:k]:
                go(i + 1, [*rooms[:k], rooms[k] - sizes[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_plan_takes_all_and_fits():
    rnd = random.Random(5)
    for n, capacity, low in itertools.product((0, 1, 7, 200, 3000), (10, 64, 512), (1, 5)):
        sizes = [rnd.randint(low, capacity) for _ in range(n)]
        configs = pack_lengths(Counter(sizes), capacity)
        assert taken(configs) == Counter(sizes)
        assert all(times > 0 and sum(s * c for s, c in config) <= capacity for times, config in configs)


def test_plan_against_the_fewest_possible():
    rnd = random.Random(6)
    for _ in range(60):
        sizes = [rnd.randint(1, 20) for _ in range(9)]
        assert sum(t for t, _ in pack_lengths(Counter(sizes), 20)) <= fewest(sizes, 20) + 1


def test_plan_of_many_pieces_wastes_next_to_nothing():
    lengths = np.clip(np.random.default_rng(1).lognormal(4, 1.2, 20_000).astype(int), 1, 512)
    used = sum(t for t, _ in pack_lengths(Counter(lengths.tolist()), 512))
    assert used <= -(-int(lengths.sum()) // 512) + 1


def test_plan_on_lengths_that_pair_badly():
    rnd = random.Random(8)
    sizes = [rnd.randint(120, 400) for _ in range(4000)]
    assert sum(t for t, _ in pack_lengths(Counter(sizes), 512)) <= 1.01 * best_fit_decreasing(sizes, 512)


def test_lengths_out_of_range_are_refused():
    with pytest.raises(ValueError):
        pack_lengths({11: 1}, 10)


def test_layout_gives_each_piece_its_own_place():
    histogram = {7: 5, 3: 11, 10: 2, 1: 4}
    layout = Layout.of(pack_lengths(histogram, 10))
    filled = defaultdict(list)
    for size, n in histogram.items():
        for s, o in zip(*layout.places(np.full(n, size), np.arange(n)), strict=True):
            filled[s].append((o, size))
    assert len(filled) == layout.sequences
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 10


def expected_pieces(texts, capacity, end):
    own = library()
    want = Counter()
    for i, text in texts:
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, *end], "<u4")
        for p, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[i, p, at, len(part), zlib.crc32(part.tobytes())] += 1
    return want


def check_rows(rows, capacity):
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_query_is_the_library_and_fills_sequences(spark):
    texts = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows = QUERIES["op11_packing"](spark, SF).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected_pieces(texts, SEQUENCE, [1])
    assert check_rows(rows, SEQUENCE) == -(-sum(r.length for r in rows) // SEQUENCE)


@pytest.mark.parametrize("end", [[1], []])
def test_edges(spark, end):
    ids = [*range(len(EDGES) - 2), None, None]
    docs = documents(spark, EDGES, ids=ids).repartition(3)
    packed = pack(docs, FILE, 32, end_id=end[0] if end else None)
    rows = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected_pieces(zip(ids, EDGES, strict=True), 32, end)
    check_rows(rows, 32)
    own = {(r.sequence_id, r.offset): list(r.ids) for r in rows}
    for s in sequences(packed).collect():
        want = [t for (q, _), part in sorted(own.items()) if q == s.sequence_id for t in part]
        assert list(s.ids) == want and s.n_tokens == len(want)


def test_empty_table(spark):
    assert pack(documents(spark, ["x"]).where("false"), FILE).count() == 0


def test_one_length_holds_all_pieces(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'the same words' as text").repartition(8)
    rows = pack(docs, FILE, 64).collect()
    assert check_rows(rows, 64) == -(-5000 // (64 // rows[0].length))
