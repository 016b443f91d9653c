"""Alignment of two tokenizers' tokens over the same bytes.

Each text, with a space before it, is encoded by a byte-level BPE (A) and by a sentence-piece model (B, which adds the space itself).
No token of either side reaches over a place where white space or, after a letter, a non-letter begins, so texts are cut there. A slice of
texts brings its different units once, with the places of each text's units; then the units of all slices are made different, so
that each unit of the corpus is encoded and aligned once. A text that can't be cut is one unit. Tasks of Python only cut and encode.

Everything else is done by Spark's functions on the arrays of ids and byte offsets where tokens end, once for each unit:
array_intersect of the two arrays of ends counts the groups that no token crosses. All ends in order, made by transform as numbers that hold end,
side and place, pair the tokens off: the ends before an entry, less its own side's, are the other side's place. An entry is the stretch of bytes
up to it, which lies in one A and one B token, so the entries, ends that both share once, are the links. Neighbours that share an end cut the
groups. Texts are put together from their slice's units by transform and aggregate.

How often each pair of ids is linked is counted over the whole corpus, units times how often they come. The counts are looked up for every
link of every unit: pairs that come often (at most BROADCAST of them) from a broadcast table, and rare ones, summed up by unit first, by a
join. So no pair is a hot key of a shuffle, and the broadcast does not grow with the corpus. A slice has a bounded number of bytes, or one
text, and names a unit once, so a frequent unit has one row for each slice.

Defined cases: null and empty texts have no tokens, nor have texts whose tokens' bytes, joined, are not the space and the text
on both sides (B takes U+2581 for a space, for example). Null and repeated ids are documents of their own. An empty table gives
an empty result. Columns other than the named ones are never read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bucketed, materialise
from .text import let
from .units import LETTERS, is_plain, slices, with_space

#: Bytes of text in a slice, and of units encoded at once; pairs of ids in the broadcast table; characters of a unit that stands for itself in
#: joins. The larger a slice, the fewer units come again in others.
SLICE, AT_ONCE, BROADCAST, SHORT = 8_000_000, 1_500_000, 1_000_000, 40


def byte_letters() -> dict[str, int]:
    """The printable letters by which byte-level vocabularies write bytes: printable Latin-1 for itself, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoders:
    """Both tokenizers and each token's bytes. A token is one number: id, and bytes in it from bit 32 on."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        letters = byte_letters()
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            known = all(c in letters for c in token)
            self.a_bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.uint64) for side in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("\u2581")
        # Texts may be cut before white space and between a letter and a following non-letter if no token of B, of those that plain
        # texts can have, reaches over such a place.
        crossing = re.compile(f"[^\u2581]\u2581|\n|[{LETTERS}][^{LETTERS}]")
        self.cuttable = not any(crossing.search(p) and is_plain(p.replace("\u2581", " ")) for i, p in enumerate(pieces) if not self._is_special(i))
        # And if their bytes stay as they are, so that a text can't have other bytes for one of its units.
        plain = [f" x{c}x" for c in map(chr, range(256)) if is_plain(c)]
        self.cuttable = self.cuttable and all(same for *_, same in self.encode([*plain, "   ", "  a", "\n\n", "\n  a"]))

    def _is_special(self, i: int) -> bool:
        return self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i)

    def _b_ids(self, texts: list[str]) -> list[list[int]]:
        """B puts a space before what it gets, and a line feed is a token of its own: so the tokens of any part of a text are found."""
        given = [t[1:] if t[0] == " " else "\n" + t for t in texts]
        found = self.b.encode(given, num_threads=1)
        return [([self.space] if t == " " else ids) if t[0] == " " else ids[2:] for t, ids in zip(texts, found, strict=True)]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes, bool]]:
        """A's and B's tokens of texts, none of them empty, and whether their bytes are the text's."""
        if not texts:
            return []
        raw = [t.encode() for t in texts]
        sides = ([x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)], self.a_bytes, self.a_sizes), (self._b_ids(texts), self.b_bytes, self.b_sizes)
        packed, same = [], np.ones(len(texts), bool)
        for ids, bytes_of, sizes in sides:
            flat = list(chain.from_iterable(ids))
            tokens = np.array(flat, np.int64)
            tokens = (tokens.astype(np.uint64) | sizes[tokens] << np.uint64(32)).astype("<u8")
            at = np.cumsum([0, *map(len, ids)])
            packed.append([tokens[x:y].tobytes() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
            parts = list(map(bytes_of.__getitem__, flat))
            # If the whole is the same and each text has its number of bytes, each text is the same.
            got = np.diff(np.concatenate([[0], np.cumsum(sizes[np.array(flat, np.int64)].astype(np.int64))])[at])
            if b"".join(parts) != b"".join(raw) or (got != np.fromiter(map(len, raw), np.int64, len(raw))).any():
                same &= np.array([b"".join(parts[x:y]) == r for x, y, r in zip(at[:-1], at[1:], raw, strict=True)])
        return list(zip(*packed, same.tolist(), strict=True))

    def cut(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different units of the texts, each with a space before it; and the texts' units as places among those: text k has those from
        at[k] to at[k + 1]. A text that can't be cut is one unit, an empty one has none."""
        plain = [self.cuttable and t != "" and is_plain(t) for t in texts]
        parts = with_space(pa.array([" " + t if p else None for t, p in zip(texts, plain, strict=True)], pa.string()))
        found = parts.flatten().dictionary_encode()
        units = found.dictionary.to_pylist()
        whole = [k for k, (t, p) in enumerate(zip(texts, plain, strict=True)) if t and not p]
        others = pa.array([" " + texts[k] for k in whole], pa.string()).dictionary_encode()
        size = np.diff(parts.offsets.to_numpy()).astype(np.int64)
        size[whole] = 1
        at = np.concatenate([[0], np.cumsum(size)])
        places = np.zeros(at[-1], np.int64)
        is_whole = np.zeros(at[-1], bool)
        is_whole[at[whole]] = True
        places[~is_whole] = found.indices.to_numpy()
        places[is_whole] = len(units) + others.indices.to_numpy()
        return units + others.dictionary.to_pylist(), places, at


@cache
def encoders(a_file: str, b_file: str) -> Encoders:
    return Encoders(a_file, b_file)


_INTS = T.ArrayType(T.IntegerType(), containsNull=False)


def cut_texts(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each slice of texts: slice (a number), units (the different parts of its texts), times (how often each comes) and texts
    (id, and the places of its units in order)."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([
        T.StructField("slice", T.LongType()), T.StructField("units", T.ArrayType(T.StringType(), False), False), T.StructField("times", T.ArrayType(T.LongType(), False), False),
        T.StructField("texts", T.ArrayType(T.StructType([T.StructField("id", kind), T.StructField("places", _INTS, False)]), False), False),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = encoders(a_file, b_file), 0
        for part in slices(batches, "text", SLICE):
            units, places, at = own.cut([t or "" for t in part.column("text").to_pylist()])
            of_text = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(places.astype(np.int32)))
            named = pa.StructArray.from_arrays([part.column("id"), of_text], ["id", "places"])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            times = pa.array(np.bincount(places, minlength=len(units)))
            first = part.column("task")[0].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([(first << 40) + n], pa.int64()), one(pa.array(units, pa.string())), one(times), one(named)], schema.names)
            n += 1

    texts = docs.select(F.spark_partition_id().cast("long").alias("task"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, schema)


def slice_units(slices_of: DataFrame) -> DataFrame:
    """slice, place, unit and times of each slice's units."""
    each = slices_of.select("slice", F.posexplode_outer(F.arrays_zip("units", "times")).alias("place", "x")).where("place is not null")
    return each.select("slice", "place", F.col("x.units").alias("unit"), "x.times")


def unit_key(unit: Column) -> Column:
    """What stands for a unit in joins: a short one for itself, a long one by its digest, which is longer than any short one."""
    return F.when(F.length(unit) <= SHORT, unit).otherwise(F.sha2(unit, 256))


def encoded_units(distinct: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """distinct (unit, times) as key, times, a_ids, a_ends, b_ids, b_ends. Units with other bytes on a side are left out."""
    columns = ["key", "times", "a_ids", "a_ends", "b_ids", "b_ends"]
    schema = "key string, times long, " + ", ".join(f"{c} array<int>" for c in columns[2:])

    def lists(sides: list[bytes]) -> tuple[pa.ListArray, pa.ListArray]:
        """ids and ends."""
        tokens = np.frombuffer(b"".join(sides), "<u8")
        size = np.fromiter(map(len, sides), np.int64, len(sides)) // 8
        at = np.concatenate([[0], np.cumsum(size)])
        ends = np.concatenate([[0], np.cumsum((tokens >> np.uint64(32)).astype(np.int64))])
        within = ends[1:] - np.repeat(ends[at[:-1]], size)
        offsets = pa.array(at.astype(np.int32))
        return tuple(pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in ((tokens & np.uint64(0xFFFFFFFF)), within))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoders(a_file, b_file)
        for part in slices(batches, "unit", AT_ONCE):
            found = own.encode(part.column("unit").to_pylist())
            part = part.filter(pa.array([same for *_, same in found], pa.bool_()))
            found = [x for x in found if x[2]]
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("times"), *lists([x[0] for x in found]), *lists([x[1] for x in found])], columns)

    return distinct.select(unit_key(F.col("unit")).alias("key"), "unit", "times").mapInArrow(run, schema)


_LOW = (1 << 32) - 1


def _high(x: Column) -> Column:
    return F.shiftright(x, 32).cast("int")


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW)).cast("int")


#: In a number that holds end, side and place: B's bit.
_B_SIDE = 1 << 31


def with_ends(units: DataFrame) -> DataFrame:
    """units with ends: both sides' ends in order, each one number that holds end, side and place; of equal ends A's comes first."""
    keyed = lambda ends, side: F.transform(ends, lambda e, i: F.shiftleft(e.cast("long"), 32) + (i + F.lit(side)))
    return units.withColumn("ends", F.sort_array(F.concat(keyed("a_ends", 0), keyed("b_ends", _B_SIDE))))


def links(units: DataFrame) -> DataFrame:
    """key, times and pair (A's id shifted by 32 bits, and B's id) of every link of the units. An end that both sides share is
    taken once, as A's."""
    i = F.col("x").bitwiseAND(F.lit(_B_SIDE - 1)).cast("int")
    other, on_a = F.col("p") - i, F.col("x").bitwiseAND(F.lit(_B_SIDE)) == 0
    shared = F.shiftright(F.get("ends", F.col("p") - 1), 32) == F.shiftright("x", 32)
    pair = F.shiftleft(F.get("a_ids", F.when(on_a, i).otherwise(other)).cast("long"), 32) + F.get("b_ids", F.when(on_a, other).otherwise(i))
    # Of an inner explode Spark infers filters on the array, which then is made three times.
    each = units.select("key", "times", "a_ids", "b_ids", "ends", F.posexplode_outer("ends").alias("p", "x")).where("x is not null")
    return each.where(on_a | ~F.coalesce(shared, F.lit(False))).select("key", "times", pair.alias("pair"))


def aligned(units: DataFrame) -> DataFrame:
    """key with known: n_a, n_b, n_groups and groups, a string like "a1,a2|b1;a3|b2", ids in order, with ":" between, packed."""
    ends = F.col("ends")
    end, place = lambda x: F.shiftright(x, 32), lambda x: x.bitwiseAND(F.lit(_B_SIDE - 1))
    # Where both sides end, B's entry follows A's: how many tokens of A and of B there are up to here.
    upto = lambda x, y: F.when(end(x) == end(y), F.shiftleft(place(x) + 1, 32) + place(y) + 1)
    found = units.withColumn("cuts", F.filter(F.zip_with(ends, F.slice(ends, 2, F.size(ends)), upto), lambda v: v.isNotNull())).drop("ends")

    def group(upto: Column, since: Column) -> Column:
        # Not slice, which goes over the whole array each time.
        side = lambda ids, of: F.array_join(F.transform(F.sequence(of(since), of(upto) - 1), lambda i: F.get(ids, i).cast("string")), ",")
        one = F.concat(F.get("a_ids", _high(since)).cast("string"), F.lit("|"), F.get("b_ids", _low(since)).cast("string"))
        return F.when(upto - since == (1 << 32) + 1, one).otherwise(F.concat(side("a_ids", _high), F.lit("|"), side("b_ids", _low)))

    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("cuts", 1, F.greatest(F.size("cuts") - 1, F.lit(0))))
    groups = F.array_join(F.zip_with("cuts", before, group), ";")
    n_groups = F.size(F.array_intersect("a_ends", "b_ends"))
    counts = (F.size("a_ids"), F.size("b_ids"), n_groups)
    return found.select("key", packed(F.concat_ws(":", *(c.cast("string") for c in counts), groups)).alias("known"))


def packed(text: Column) -> Column:
    """A string of digits and ":,|;" in half as many bytes; such values may be joined."""
    even = F.when(F.length(text) % 2 == 0, text).otherwise(F.concat(text, F.lit("F")))
    return F.unhex(F.translate(even, ":,|;", "ABCD"))


def unpacked(value: Column) -> Column:
    return F.translate(F.hex(value), "ABCDF", ":,|;")


def _often(counts: DataFrame, most: int) -> int:
    """The least power of two that at most most pairs are counted."""
    sizes = {r["bits"]: r["pairs"] for r in counts.groupBy(F.floor(F.log2("n")).alias("bits")).agg(F.count("*").alias("pairs")).collect()}  # 64 rows at most
    total, least = 0, 62
    for bits in sorted(sizes, reverse=True):
        total += sizes[bits]
        if total > most:
            break
        least = bits
    return 1 << least


def alignment(
    docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text", broadcast: int = BROADCAST
) -> DataFrame:
    """One row for each document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    cut = bucketed(cut_texts(docs, a_file, b_file, id_col, text_col), "text-slices", "slice")
    named = slice_units(cut)
    units = with_ends(materialise(encoded_units(named.groupBy("unit").agg(F.sum("times").alias("times")), a_file, b_file), "units"))
    counts = materialise(links(units).groupBy("pair").agg(F.sum("times").alias("n")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit(_LOW))
    # A row for each id of B: its vocabulary bounds the broadcast.
    top = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("top"))
    valued = materialise(counts.withColumn("b", b_id).join(F.broadcast(top), "b").select("pair", "n", (F.col("n") == F.col("top")).cast("long").alias("best")), "pair-values")
    often = _often(counts, broadcast)
    common, rare = valued.where(F.col("n") >= often), valued.where(F.col("n") < often)

    # Each link of each unit gets its pair's count; a unit's common pairs are summed up at once, its rare ones looked up one by one.
    met = links(units).drop("times").join(F.broadcast(common), "pair", "left")
    left = F.when(F.col("n").isNull(), F.col("pair")).alias("rare")
    by_unit = materialise(met.groupBy("key", left).agg(F.sum("n").alias("n"), F.sum("best").alias("best"), F.count("*").alias("met")), "unit-sums")
    looked_up = by_unit.where("rare is not null").select("key", "rare", "met").join(rare, F.col("rare") == F.col("pair"))
    looked_up = looked_up.select("key", (F.col("n") * F.col("met")).alias("n"), (F.col("best") * F.col("met")).alias("best"))
    sums = by_unit.where("rare is null").select("key", "n", "best").unionByName(looked_up)
    sums = sums.groupBy("key").agg(F.sum("n").alias("count_sum"), F.sum("best").alias("n_best"))
    whole = aligned(units).join(sums, "key")

    # A slice's units, by place, and then its texts from them. A slice has a bounded number of bytes, so its units fit in a row. What is known
    # of a unit goes there as one packed value, its place first. The texts lie in buckets by slice and stay there.
    numbers = ["n_best", "count_sum", "n_a", "n_b", "n_groups"]
    placed = named.select("slice", "place", unit_key(F.col("unit")).alias("key")).join(whole, "key", "left")
    at = packed(F.lpad(F.col("place").cast("string"), 10, "0"))
    sums_of = packed(F.concat(F.lit(":"), F.col("n_best").cast("string"), F.lit(":"), F.col("count_sum").cast("string"), F.lit(":")))
    value = F.coalesce(F.concat(at, sums_of, "known"), at)
    by_slice = placed.groupBy("slice").agg(F.sort_array(F.collect_list(value)).alias("known"))
    texts = cut.select("slice", "texts").join(by_slice, "slice", "left")

    def one(text: Column, known: Column) -> Column:
        places = text["places"]
        # Null as soon as one unit is not known, since its bytes are others.
        total = lambda c: F.aggregate(places, F.lit(0).cast("long"), lambda acc, i: acc + F.get(known[c], i)).alias(c)
        joined = F.array_join(F.transform(places, lambda i: F.get(known["groups"], i)), ";")
        return F.struct(text["id"].alias("id"), *map(total, numbers), F.sha2(joined, 256).alias("digest"))

    # The arrays are bound once for each slice; inside a lambda Spark would take them out of known for each element.
    fields = F.transform("known", lambda v: F.split(unpacked(v), ":"))
    field = lambda own, i, kind: F.transform(own, lambda v: F.get(v, F.lit(i)).cast(kind))
    arrays = lambda own: F.struct(field(own, 6, "string").alias("groups"), *(field(own, i, "long").alias(c) for i, c in enumerate(numbers, 1)))
    each = let(fields, lambda own: let(arrays(own), lambda known: F.transform("texts", lambda text: one(text, known))))
    found = texts.select(F.explode_outer(each).alias("x")).where("x is not null").select("x.*")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    n_links = zero("n_a") + zero("n_b") - zero("n_groups")
    digest = F.when(F.col("n_a") > 0, F.col("digest")).otherwise("").alias("groups_sha256")
    return found.select(F.col("id").alias(id_col), *map(zero, ("n_a", "n_b", "n_groups")), n_links.alias("n_links"), *map(zero, ("n_best", "count_sum")), digest)
