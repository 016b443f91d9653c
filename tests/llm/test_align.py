"""Alignment: the query and the edges against a plain double loop over the libraries' tokens."""

import hashlib
from collections import Counter

import pytest
from helpers import EDGES, PROSE, documents
from oracle import SF
from pyspark.sql import functions as F

from trackwright.llm.align import alignment, byte_letters, encoders, packed, unpacked
from trackwright.llm.queries import QUERIES
from trackwright.session import table

public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def restated(texts):
    """The rows, without ids, of the texts in order."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters, each, counts = byte_letters(), [], Counter()
    for text in texts:
        found = a.encode(" " + (text or ""), add_special_tokens=False)
        sides = [(i, bytes(letters[c] for c in t)) for i, t in zip(found.ids, found.tokens, strict=True)], []
        for i in b.encode(text or ""):
            piece = b.id_to_piece(i)
            sides[1].append((i, bytes([int(piece[1:-1], 16)]) if b.is_byte(i) else piece.replace("\u2581", " ").encode()))
        if not text or any(b"".join(x for _, x in s) != (" " + text).encode() for s in sides):
            each.append(None)
            continue
        spans = []
        for side in sides:
            at, own = 0, []
            for i, x in side:
                own.append((i, at, at + len(x)))
                at += len(x)
            spans.append(own)
        links, j = [], 0
        for i, start, end in spans[0]:
            while spans[1][j][2] <= start:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][1] < end:
                links.append((i, spans[1][k][0]))
                k += 1
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, low = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for i, s, _ in own if low <= s < e) for own in spans) if len(text) < 5000 else None)
            low = e
        counts.update(links)
        each.append((len(spans[0]), len(spans[1]), len(ends), links, None if None in groups else ";".join(groups)))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for x in each:
        if x is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            digest = None if x[4] is None else hashlib.sha256(x[4].encode()).hexdigest()
            out.append((*x[:3], len(x[3]), sum(counts[p] == top[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), digest))
    return out


def check(rows, ids, texts):
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows)
    for i, want in zip(ids, restated(texts), strict=True):
        key = next((k for k in got if got[k] and k[0] == i and k[1:7] == want[:6] and want[6] in (None, k[7])), None)
        assert key, (i, want, [k for k in got if k[0] == i])
        got[key] -= 1
    assert not +got


def test_query_against_restatement(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    check(QUERIES["op13_alignment"](spark, SF).collect(), [r.doc_id for r in docs], [r.text for r in docs])


TEXTS = [
    *EDGES, "a\u2581b", "\n\nx\n y  z \n", "<|endoftext|> and </s> <s> <0x41>", "tab\there\u00a0there", " leading", "trailing  ", "é\u00ad£", "\x00nul", "don't we'll  I'M",
    "𝔘nicode ﬁ ﷺ 🙂🙂", "1234567890 " * 20, (PROSE + "\n") * 300, "supercalifragilistic" * 50,
]


@pytest.mark.parametrize("broadcast", [0, 40, 10**6])
def test_edges_with_any_number_of_broadcast_pairs(spark, broadcast):
    ids = [*range(len(TEXTS) - 2), None, None]
    check(alignment(documents(spark, TEXTS, ids=ids).repartition(3), A, B, broadcast=broadcast).collect(), ids, TEXTS)


def test_units_give_the_tokens_of_whole_texts():
    own = encoders(A, B)
    units, places, at = own.cut([t or "" for t in TEXTS])
    for k, text in enumerate(TEXTS):
        parts = own.encode([units[i] for i in places[at[k] : at[k + 1]]])
        if not text:
            assert not parts
            continue
        a, b, same = own.encode([" " + text])[0]
        assert (b"".join(p[0] for p in parts), b"".join(p[1] for p in parts), all(p[2] for p in parts)) == (a, b, same), text[:50]


def test_texts_stay_where_they_are(spark):
    """What is known of a slice's units goes to the slice; its texts are not shuffled, which took a fifth of the disk."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = alignment(documents(spark, TEXTS), A, B)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(slice#") == 1
        check(found.collect(), [*range(len(TEXTS))], TEXTS)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_packed_values_may_be_joined(spark):
    rows = [("1:2:1:12,3|4;5|67", "0000000012"), ("", ":"), ("1:1:1:1|22", "123")]
    frame = spark.createDataFrame(rows, "x string, y string").select("x", "y", F.concat(packed(F.col("y")), packed(F.col("x"))).alias("both"))
    for r in frame.withColumn("again", unpacked(F.col("both"))).collect():
        assert r.again == r.y + r.x
        assert len(r.both) == (len(r.x) + 1) // 2 + (len(r.y) + 1) // 2


def test_empty_table(spark):
    assert alignment(documents(spark, ["x"]).where("false"), A, B).count() == 0


def test_very_long_text(spark):
    text = " ".join(f"word{i % 7919} und" for i in range(200_000))
    (row,) = alignment(documents(spark, [text]), A, B).collect()
    assert row.n_links == row.n_a + row.n_b - row.n_groups > 400_000
