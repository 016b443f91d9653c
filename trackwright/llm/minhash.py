"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text becomes its set of distinct word shingles, and that a MinHash signature. Documents with equal sets form one
   class, and only its smallest id goes on.
2. Signatures are cut into bands. Documents that share a band are candidates. Inside a bucket not all pairs are formed: first
   all members meet one pivot, the member with the most company in all its buckets (the text that copies were made from), and
   those found similar become one component.
3. A pair's signatures are compared batch by batch. With a uniform prior, the posterior probability that the similarity
   reaches the threshold is known after each batch, and the pair is dropped once that is below the miss probability.
   Survivors are confirmed on their full sets.
   What is left are pairs between different components that meet the same pivot. They are joined by pivot, large families in
   blocks, and only true links come out of that join: its condition takes sizes, then the same sequential test on one bit of each
   hash, batch by batch, then the exact similarity. That needs only what each set has and the pivot's has not, or the other way
   round: with D for these differences, the sets of x and y differ in |Dx| + |Dy| - 2 |Dx & Dy| shingles. No pair inside a
   component is looked at.
4. Confirmed links give connected components; a component's id is its smallest document id.

Words are runs of characters other than ASCII white space after lower-casing A-Z. A text with fewer words than a shingle has its
whole sequence as one shingle. Sets are held as 64-bit hashes of the shingles.

Defined cases: a text without words (null or empty) has an empty set, links with nothing and is kept. A null id links with
nothing and has a null component. Rows that repeat an id share its component if their texts are linked. An empty table gives an
empty result. Columns other than the named ones are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .units import slices

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_BYTE_VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)
#: Words longer than this are hashed one by one by BLAKE2, since a polynomial is weak on long runs.
_LONG_WORD = 255


@dataclass(frozen=True)
class MinHash:
    words: int = 5
    percent: int = 80
    #: 40 bands of 6: two documents of similarity 0.8 share no band once in 190,000 pairs, of 0.1 share one once in 25,000.
    bands: int = 40
    rows: int = 6
    #: Hashes compared before each decision, and the chance that a decision drops a pair of the threshold's similarity.
    batch: int = 48
    miss: float = 1e-6
    seed: int = 7
    #: Share of the pairs between different components at which pivot rounds end.
    enough: float = 0.5

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    first_byte = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    inside = ~_IS_SPACE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    # Polynomial prefix sums: a word's hash is the difference over the word, moved to power 0.
    power = np.multiply.accumulate(np.full(len(data), _BASE))
    prefix = np.concatenate([[_U(0)], np.cumsum(_BYTE_VALUE[data] * power, dtype=np.uint64)])
    back = np.multiply.accumulate(np.full(len(data), _BASE_INVERSE))
    word = _mix((prefix[ends] - prefix[starts]) * back[starts] + (ends - starts).astype(np.uint64)) if len(starts) else np.zeros(0, np.uint64)
    for i in np.flatnonzero(ends - starts > _LONG_WORD):
        word[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    first_word = np.searchsorted(starts, first_byte)
    rolled = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for j in range(words):
        rolled = _mix(rolled * _BASE + word[j : j + len(rolled)])
    out = []
    for a, b in zip(first_word[:-1].tolist(), first_word[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            short = np.zeros(1, np.uint64)
            for w in word[a:b]:
                short = _mix(short * _BASE + w)
            out.append(_mix(short + _U(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The least of factor * x + shift (32 bits) over all shingles, for every hash function."""
    x = (shingles >> _U(32)).astype(np.uint32)
    least = np.full(len(factors), np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 1024):
        h = factors[:, None] * x[None, i : i + 1024]
        h += shifts[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return least


def _bits(sig: np.ndarray) -> list[int]:
    """One bit of each hash, 64 to a number; the rest of the last number is 0."""
    packed = np.packbits(((sig ^ (sig >> np.uint32(16))) & np.uint32(1)).astype(np.uint8))
    return np.frombuffer(packed.tobytes().ljust(-(-len(packed) // 8) * 8, b"\0"), np.int64).tolist()


def _functions(p: MinHash) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    return rng.integers(0, 1 << 31, p.hashes, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, p.hashes, dtype=np.uint32)


def signatures(docs: DataFrame, id_col: str, text_col: str, p: MinHash, keyed: bool = False) -> DataFrame:
    """id, n_shingles, digest (equal for equal sets), sig, bits (one of each hash); the last three are null for empty sets.

    keyed adds text_sha, the SHA-256 of the text.
    """
    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
        T.StructField("sig", T.BinaryType()), T.StructField("bits", T.ArrayType(T.LongType())),
        *([T.StructField("text_sha", T.BinaryType())] if keyed else []),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = _functions(p)
        for part in slices(batches, "text"):
            sets = shingle_sets([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], p.words)
            sigs = [signature(s, factors, shifts) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                part.column("id"), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                pa.array([s.tobytes() if s is not None else None for s in sigs], pa.binary()),
                pa.array([_bits(s) if s is not None else None for s in sigs], pa.list_(pa.int64())),
                *([part.column("text_sha")] if keyed else []),
            ], schema.names)

    texts = _texts(docs, id_col, text_col)
    return (texts.withColumn("text_sha", _text_sha("text")) if keyed else texts).mapInArrow(run, schema)


def _text_sha(col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(col).cast("string"), F.lit("")), 256))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def full_sets(docs: DataFrame, id_col: str, text_col: str, p: MinHash) -> DataFrame:
    """id and the whole set as array<bigint>."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], p.words)
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists], schema.names)

    return _texts(docs, id_col, text_col).mapInArrow(run, schema)


def fewest_equal(n: int, p: MinHash, bits: bool = False) -> int:
    """The fewest of n equal hashes (or bits) with which the posterior P(similarity >= threshold) is at least the miss probability.

    The prior is uniform. Hashes agree with the similarity's probability s, single bits with (1 + s) / 2.
    """
    s = (np.arange(4000) + 0.5) / 4000
    agree = np.log((1 + s) / 2 if bits else s), np.log((1 - s) / 2 if bits else 1 - s)
    for m in range(n + 1):
        likely = m * agree[0] + (n - m) * agree[1]
        likely = np.exp(likely - likely.max())
        if likely[s >= p.percent / 100].sum() >= p.miss * likely.sum():
            return m
    return n


def least_matches(p: MinHash, batch: int | None = None, bits: bool = False) -> list[tuple[int, int]]:
    """(hashes or bits compared, fewest equal ones that keep a pair) after each batch."""
    batch = batch or p.batch
    return [(n, fewest_equal(n, p, bits)) for n in [*range(batch, p.hashes, batch), p.hashes]]


def _bayes(pairs: DataFrame, p: MinHash) -> DataFrame:
    """The pairs (a, b with sig_a, sig_b) that no batch rules out."""
    limits = least_matches(p)
    schema = pairs.select("a", "b").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, p.hashes) for c in ("sig_a", "sig_b")
            )
            open_, equal, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in limits:
                equal[open_] += (left[open_, done:n] == right[open_, done:n]).sum(axis=1)
                open_, done = open_[equal[open_] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], schema.names).take(pa.array(open_))

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, schema)


def _with_both(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(values.select(F.col("id").alias(side), F.col(name).alias(f"{name}_{side}")), side)
    return pairs


def verify(pairs: DataFrame, sigs: DataFrame, sets: DataFrame, p: MinHash) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    survivors = _bayes(_with_both(pairs, sigs, "sig"), p)
    both = _with_both(survivors, sets, "shingles")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return both.withColumn("common", common).where(
        100 * F.col("common") >= p.percent * (F.size("shingles_a") + F.size("shingles_b") - F.col("common"))
    ).select("a", "b")


def components(links: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (id, comp) after links (a, b) between ids: every id has the least label that it can reach.

    Each round gives a label the least label beside it, and at once what that one was given.
    """
    edges = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        # A lower label goes to the whole component, not only to the node that saw it.
        lower = (
            labels.join(near, labels["id"] == near["a"]).where("near < comp").groupBy(F.col("comp").alias("old")).agg(F.min("near").alias("new"))
        )
        lower = materialise(lower, "lower")
        if lower.isEmpty():
            return labels
        further = lower.select(F.col("old").alias("new"), F.col("new").alias("next"))
        lower = lower.join(further, "new", "left").select("old", F.coalesce("next", "new").alias("new"))
        labels = materialise(
            labels.join(lower, labels["comp"] == lower["old"], "left").select("id", F.coalesce("new", "comp").alias("comp")), "labels"
        )


def _pairs(df: DataFrame, one: Column, two: Column) -> DataFrame:
    return df.select(F.least(one, two).alias("a"), F.greatest(one, two).alias("b")).where("a <> b").distinct()


def _mixed_buckets(placed: DataFrame) -> DataFrame:
    """bucket and open (pairs between different components), where there are any."""
    counts = placed.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(
        F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same")
    )
    return mixed.where("all * all > same").select("bucket", ((F.col("all") * F.col("all") - F.col("same")) / 2).alias("open"))


def _with_pivots(placed: DataFrame, rank: Column) -> DataFrame:
    """placed with pivot and pivot_comp, the member of its bucket that has the highest rank.

    The pivots are written first, so that this is a plain join, of which Spark splits a bucket that many rows share.
    """
    best = F.max(F.struct(rank.alias("rank"), F.col("id").alias("pivot"), F.col("comp").alias("pivot_comp")))
    pivots = materialise(placed.groupBy("bucket").agg(best.alias("p")).select("bucket", "p.pivot", "p.pivot_comp"), "pivots")
    return placed.join(pivots.hint("merge"), "bucket")


def _meet_pivots(placed: DataFrame, rank: Column) -> DataFrame:
    """Pairs of each bucket's pivot with all its members of other components."""
    return _pairs(_with_pivots(placed, rank).where("comp <> pivot_comp"), F.col("id"), F.col("pivot"))


#: Members of a pivot's family that one block of the last join has.
FAMILY_BLOCK = 1024


def _links_beside_pivots(placed: DataFrame, known: DataFrame, labels: DataFrame, sets: DataFrame, p: MinHash) -> DataFrame:
    """Links (a, b) between different components among the members that meet one pivot."""
    families = _with_pivots(placed, F.col("company")).where("id <> pivot").select("pivot", "id").distinct()
    families = materialise(families.join(labels, "id"), "families")
    majors = (
        families.groupBy("pivot", "comp").agg(F.count("*").alias("n"))
        .groupBy("pivot").agg(F.max(F.struct("n", "comp"))["comp"].alias("major"), F.count("*").alias("parts"), F.sum("n").alias("n"))
    )
    majors = majors.where("parts > 1").select("pivot", "major", F.ceil(F.col("n") / FAMILY_BLOCK).alias("blocks"))
    mixed = families.join(materialise(majors, "majors"), "pivot")
    own, pivots = sets.withColumnRenamed("shingles", "own"), sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("base"))
    delta = F.concat(F.array_except("own", "base"), F.array_except("base", "own"))
    here = mixed.join(own.hint("merge"), "id").join(pivots.hint("merge"), "pivot").select("pivot", "id", "comp", "major", "blocks", delta.alias("delta"))
    here = materialise(here.join(known.select("id", "n_shingles", "bits"), "id"), "deltas")

    # Every block of a family meets all members outside the largest component, so no task has a whole large family.
    small = here.where("comp <> major").select(
        "pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), *(F.col(c).alias(f"{c}_one") for c in ("id", "comp", "n_shingles", "bits", "delta"))
    )
    blocked = here.withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
    new = (F.col("comp") != F.col("comp_one")) & ((F.col("comp") == F.col("major")) | (F.col("id_one") < F.col("id")))
    sizes = 100 * F.least("n_shingles", "n_shingles_one") >= p.percent * F.greatest("n_shingles", "n_shingles_one")
    differ, alike = F.lit(0), sizes
    for i, (n, least) in enumerate(least_matches(p, 64, bits=True)):
        differ = differ + F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits_one")[i]))
        alike = alike & (differ <= n - least)
    total = F.col("n_shingles") + F.col("n_shingles_one")
    common = (total - F.size("delta") - F.size("delta_one")) / 2 + F.size(F.array_intersect("delta", "delta_one"))
    exact = 100 * common >= p.percent * (total - common)
    joined = small.join(blocked.hint("merge"), ["pivot", "block"]).where(new & F.when(alike, exact).otherwise(False))
    return _pairs(joined, F.col("id_one"), F.col("id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: MinHash = MinHash()) -> DataFrame:
    """One row for each document: id, n_shingles, component_id, kept."""
    return _verdicts(docs, id_col, text_col, p)


def _verdicts(docs: DataFrame, id_col: str, text_col: str, p: MinHash, keyed: bool = False) -> DataFrame:
    signed = materialise(signatures(docs, id_col, text_col, p, keyed), "signatures")
    usable = signed.where(F.col("digest").isNotNull() & F.col("id").isNotNull())
    classes = materialise(
        usable.groupBy("digest").agg(F.min(F.struct("id", "n_shingles", "bits", "sig")).alias("first")).select("digest", "first.*"), "classes"
    )
    band = F.transform(
        F.sequence(F.lit(0), F.lit(p.bands - 1)), lambda i: F.xxhash64(i, F.substring("sig", i * (4 * p.rows) + 1, F.lit(4 * p.rows)))
    )
    banded = classes.select("id", F.explode(band).alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialise(banded.join(shared.hint("merge"), "bucket"), "members")
    ids = materialise(members.groupBy("id").agg(F.sum("n").alias("company")), "candidates")
    known = materialise(classes.drop("digest").join(ids.hint("merge"), "id"), "candidate-signatures")
    wanted = ids.select(F.col("id").alias("__id")).hint("merge")
    sets = materialise(full_sets(docs.join(wanted, F.col(id_col) == F.col("__id"), "left_semi"), id_col, text_col, p).dropDuplicates(["id"]), "sets")

    labels = ids.select("id", F.col("id").alias("comp"))
    left, step = None, 0
    while True:
        placed = members.select("bucket", "id").join(known.select("id", "company").join(labels, "id"), "id")
        mixed = materialise(_mixed_buckets(placed), "mixed-buckets")
        open_ = mixed.agg(F.sum("open")).first()[0] or 0
        if not open_:
            break
        placed = placed.join(mixed.select("bucket"), "bucket")
        # The first pivots nearly always leave little; others follow only while much is left and the last ones helped.
        if left is not None and (open_ <= p.enough * left or open_ > 0.9 * last):
            labels = components(materialise(_links_beside_pivots(placed, known, labels, sets, p), "links"), labels)
            break
        left, last = left or open_, open_
        pairs = materialise(_meet_pivots(placed, F.xxhash64("id", F.lit(step)) if step else F.col("company")), "pairs")
        labels, step = components(materialise(verify(pairs, known, sets, p), "links"), labels), step + 1

    comp = classes.join(labels, "id", "left").select("digest", F.coalesce("comp", "id").alias("comp"))
    key = ["text_sha"] if keyed else []
    joined = signed.select("id", "n_shingles", "digest", *key).join(comp, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    return joined.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), *key)


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: MinHash = MinHash()) -> DataFrame:
    """The rows of docs that stay, one document of each component, with docs' columns. A row goes by its id and text."""
    gone = _verdicts(docs, id_col, text_col, p, keyed=True).where(~F.col("kept")).select(F.col(id_col).alias("__gone"), F.col("text_sha").alias("__gone_sha"))
    keyed = docs.withColumn("__sha", _text_sha(text_col))
    return keyed.join(gone, (keyed[id_col] == F.col("__gone")) & (F.col("__sha") == F.col("__gone_sha")), "left_anti").drop("__sha")
