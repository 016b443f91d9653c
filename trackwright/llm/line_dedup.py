"""Line deduplication by content-defined chunks of lines.

A polynomial hash rolls over the hashes of a few consecutive lines. Its residues choose boundaries: the hash of the first lines
behind a place may begin a chunk there, the hash of the last lines before a place may end one. A chunk runs from a beginning to
the first end after it, two lines or more. So what is in a chunk depends on its own lines alone, an inserted or removed line
moves only the chunks that hold it, and a passage has the same chunks wherever it stands; chunks may overlap.

Chunks whose digest occurs again anywhere in the corpus are anchors: their first occurrence (smallest id, then position) stays.
As a passage seldom begins and ends where chunks do, each anchor is drawn out to both sides, line by line, as long as the lines beside
it are those beside the earlier occurrence. The lines so covered are then compared with the earlier ones byte by byte, and go if they are
the same. A line only goes for an equal one that comes earlier, so the first of all occurrences stays. Single lines that occur
again go only as part of a repeated passage.

Drawing out works on blocks of line hashes: an end of a range asks for a few hashes on both texts and, while all are equal, for 32 times as
many in the next round, after ranges that have met were made one. No row holds two texts or all of a text's hashes for each
range, so memory and time follow the text's length and the number of its repeated chunks.

Defined cases: a range with two different lines of one 64-bit hash stays whole. Null text counts as empty: one empty line, which is never removed. A null id comes after all others. Rows that
repeat id and text are one document and get the same result. An empty table gives an empty result. Columns other than the
named ones are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .text import let, whole_text

#: Lines in the rolling window; of so many residues one is no boundary; most lines of a chunk; the hash's base.
WINDOW, SPACING, MOST, BASE = 2, 4, 16, 31


def _joined(lines: Column, first: Column, last: Column) -> Column:
    """The text of the lines from first to last; takes time by their number alone, which slice does not."""
    return F.array_join(F.transform(F.sequence(first, last), lambda i: F.get(lines, i)), "\n")


def chunks(text: Column, window: int = WINDOW, spacing: int = SPACING, most: int = MOST) -> Column:
    """array<struct<first int, last int, body string>> of window lines or more; lines count from 0."""

    def build(lines: Column) -> Column:
        hashes = F.transform(lines, lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long"))
        # rolled[k] is the hash of lines k .. k + window - 1.
        rolled = let(hashes, lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - window), lambda k: sum((BASE**j * F.get(h, k + window - 1 - j) for j in range(1, window)), F.get(h, k + window - 1))
        ))

        def cut(r: Column) -> Column:
            def one(k: Column) -> Column:
                ends = F.filter(F.sequence(k, F.least(k + most - window, F.size(r) - 1)), lambda e: F.floor(F.get(r, e) / spacing) % spacing != 0)
                last = F.get(ends, F.lit(0)) + window - 1
                return F.struct(k.alias("first"), last.alias("last"), _joined(lines, k, last).alias("body"))

            begins = F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda k: F.get(r, k) % spacing != 0)
            return F.filter(F.transform(begins, one), lambda c: c["last"].isNotNull())

        nothing = F.array().cast("array<struct<first:int,last:int,body:string>>")
        return F.when(F.size(lines) < window, nothing).otherwise(let(rolled, cut))

    return let(F.split(text, "\n"), build)


#: Lines in a block of hashes; lines that the first round of drawing out looks at, and how many times more each next round.
BLOCK, REACH, GROWTH = 256, 8, 32

#: A document, and the one that a range's earlier occurrence is in (a line's place there is less by shift).
_DOC, _SOURCE = ["id", "row"], ["sid", "srow"]
_DIAGONAL = [*_DOC, *_SOURCE, "shift"]


def _same(pairs: list[tuple[str, str]]) -> Column:
    """Equality of keys, of which the first, an id, may be null."""
    (a, b), *rest = pairs
    met = F.col(a).eqNullSafe(F.col(b))
    for x, y in rest:
        met &= F.col(x) == F.col(y)
    return met


def _blocks(hashes: DataFrame, reach: int, names: list[str]) -> DataFrame:
    """id, row, block, start and hashes: reach lines more than the block's on both sides. names: of the result's columns."""
    count = F.size("hashes")

    def one(b: Column) -> Column:
        start = F.greatest(b * BLOCK - reach, F.lit(0))
        stop = F.least((b + 1) * BLOCK + reach, count)
        return F.struct(b.alias("block"), start.alias("start"), F.transform(F.sequence(start, stop - 1), lambda i: F.get("hashes", i)).alias("part"))

    numbers = F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int"))
    return hashes.select("id", "row", F.explode(F.transform(numbers, one)).alias("x")).select("id", "row", "x.*").toDF(*names)


def _reached(ends: DataFrame, hashes: DataFrame, reach: int) -> DataFrame:
    """ends (place: the first line to look at, step: 1 or -1) with n_equal: lines from there on that are those of the source."""
    ends = ends.withColumns({"block": F.floor(F.col("place") / BLOCK), "sblock": F.floor((F.col("place") - F.col("shift")) / BLOCK)})
    own = _blocks(hashes, reach, ["o_id", "o_row", "o_block", "o_start", "o_part"])
    other = _blocks(hashes, reach, ["p_id", "p_row", "p_block", "p_start", "p_part"])
    met = ends.join(own.hint("merge"), _same([("id", "o_id"), ("row", "o_row"), ("block", "o_block")]), "left")

    def ahead(part: Column, at: Column) -> Column:
        """The reach lines from at on, in the direction of step."""
        forward = F.slice(part, at + 1, F.lit(reach))
        since = F.greatest(at - (reach - 1), F.lit(0))
        backward = F.reverse(F.slice(part, since + 1, at - since + 1))
        fine = part.isNotNull() & (at >= 0) & (at < F.size(part))
        return F.when(fine, F.when(F.col("step") == 1, forward).otherwise(backward)).otherwise(F.array().cast("array<bigint>"))

    met = met.withColumn("mine", ahead(F.col("o_part"), (F.col("place") - F.col("o_start")).cast("int"))).drop("o_id", "o_row", "o_block", "o_start", "o_part")
    met = met.join(other.hint("merge"), _same([("sid", "p_id"), ("srow", "p_row"), ("sblock", "p_block")]), "left")
    met = met.withColumn("theirs", ahead(F.col("p_part"), (F.col("place") - F.col("shift") - F.col("p_start")).cast("int"))).drop("p_id", "p_row", "p_block", "p_start", "p_part")
    both = F.least(F.size("mine"), F.size("theirs"))
    differ = F.array_position(F.zip_with("mine", "theirs", lambda a, b: F.coalesce(a == b, F.lit(False))), False)
    return met.withColumn("n_equal", F.when(differ > 0, differ - 1).otherwise(both).cast("int")).drop("mine", "theirs", "block", "sblock")


def _merged(ranges: DataFrame) -> DataFrame:
    """Ranges of one diagonal that overlap or touch made one. n: their anchors; open_left, open_right: may reach further."""
    w = Window.partitionBy(*_DIAGONAL).orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = ranges.withColumn("new", F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w))
    return numbered.groupBy(*_DIAGONAL, "island").agg(
        F.min(F.struct("first", (~F.col("open_left")).alias("shut"))).alias("lo"), F.max(F.struct("last", "open_right")).alias("hi"), F.sum("n").alias("n"),
    ).select(*_DIAGONAL, F.col("lo.first").alias("first"), F.col("hi.last").alias("last"), "n", (~F.col("lo.shut")).alias("open_left"), F.col("hi.open_right").alias("open_right"))


def _drawn_out(anchors: DataFrame, hashes: DataFrame) -> DataFrame:
    """_DIAGONAL, first, last and n (anchors in it): the anchors (first, last) drawn out as far as lines have equal hashes."""
    whole = anchors.select(*_DIAGONAL, "first", "last", F.lit(1).cast("long").alias("n"), F.lit(True).alias("open_left"), F.lit(True).alias("open_right"))
    ranges, reach = materialise(_merged(whole), "ranges"), REACH
    while True:
        is_open = F.col("open_left") | F.col("open_right")
        left = F.when(F.col("open_left"), F.struct((F.col("first") - 1).alias("place"), F.lit(-1).alias("step")))
        right = F.when(F.col("open_right"), F.struct((F.col("last") + 1).alias("place"), F.lit(1).alias("step")))
        ends = ranges.where(is_open).withColumn("end", F.explode(F.array_compact(F.array(left, right)))).select(*_DIAGONAL, "first", "last", "n", "end.*")
        seen = _reached(ends, hashes, reach)
        of = lambda step, value: F.coalesce(F.max(F.when(F.col("step") == step, value)), F.lit(0))
        grown = seen.groupBy(*_DIAGONAL, "first", "last", "n").agg(of(-1, F.col("n_equal")).alias("before"), of(1, F.col("n_equal")).alias("behind"))
        grown = grown.select(
            *_DIAGONAL, (F.col("first") - F.col("before")).alias("first"), (F.col("last") + F.col("behind")).alias("last"), "n",
            (F.col("before") == reach).alias("open_left"), (F.col("behind") == reach).alias("open_right"),
        )
        ranges = materialise(_merged(ranges.where(~is_open).unionByName(grown)), "ranges")
        if ranges.where(is_open).isEmpty():
            return ranges.drop("open_left", "open_right")
        reach *= GROWTH


def _proven(ranges: DataFrame, texts: DataFrame) -> DataFrame:
    """id, row, first, last, n of the ranges whose lines are the source's, byte by byte. A text is read once for all its ranges."""
    lines = F.split("text", "\n")
    own = ranges.groupBy(*_DOC).agg(F.collect_list(F.struct(*_SOURCE, "shift", "first", "last", "n")).alias("ranges"))
    own = own.select(F.col("id").alias("o_id"), F.col("row").alias("o_row"), "ranges")

    def bodies(lines: Column) -> Column:
        def one(x: Column) -> Column:
            sfirst, slast = (x["first"] - x["shift"]).cast("int"), (x["last"] - x["shift"]).cast("int")
            inner = x["sid"].eqNullSafe(F.col("id")) & (x["srow"] == F.col("row"))
            return F.struct(
                *(x[c].alias(c) for c in (*_SOURCE, "first", "last", "n")), sfirst.alias("sfirst"), slast.alias("slast"),
                _joined(lines, x["first"], x["last"]).alias("body"), F.when(inner, _joined(lines, sfirst, slast)).alias("earlier"),
            )

        return F.transform("ranges", one)

    mine = texts.join(materialise(own, "own-ranges").hint("merge"), _same([("id", "o_id"), ("row", "o_row")])).select("id", "row", F.explode(let(lines, bodies)).alias("x"))
    mine = mine.select("id", "row", "x.*")
    mine = materialise(mine, "own-lines")
    wanted = ranges.where(~_same([("sid", "id"), ("srow", "row")])).select(*_SOURCE, (F.col("first") - F.col("shift")).cast("int").alias("first"), (F.col("last") - F.col("shift")).cast("int").alias("last"))
    wanted = wanted.groupBy(*_SOURCE).agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
    cut = lambda lines: F.transform("ranges", lambda x: F.struct(x["first"].alias("first"), x["last"].alias("last"), _joined(lines, x["first"], x["last"]).alias("body")))
    theirs = texts.join(materialise(wanted, "source-ranges").hint("merge"), _same([("id", "sid"), ("row", "srow")])).select("sid", "srow", F.explode(let(lines, cut)).alias("x"))
    theirs = theirs.select(F.col("sid").alias("t_id"), F.col("srow").alias("t_row"), F.col("x.first").alias("t_first"), F.col("x.last").alias("t_last"), F.col("x.body").alias("t_body"))
    theirs = materialise(theirs.dropDuplicates(["t_id", "t_row", "t_first", "t_last"]), "source-lines")
    keys = [("sid", "t_id"), ("srow", "t_row"), ("sfirst", "t_first"), ("slast", "t_last")]
    outer = mine.where("earlier is null").join(theirs.hint("merge"), _same(keys)).where("body = t_body")
    return mine.where("body = earlier").select(*_DOC, "first", "last", "n").unionByName(outer.select(*_DOC, "first", "last", "n"))


def line_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, spacing: int = SPACING, most: int = MOST
) -> DataFrame:
    """One row for each document: id, n_lines, n_chunks, n_removed_chunks (anchors), n_removed_lines and the text that is left."""
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    texts = texts.withColumn("row", F.xxhash64("text"))
    pieces = texts.select("id", "row", F.explode(chunks(F.col("text"), window, spacing, most)).alias("chunk"))
    pieces = pieces.select("id", "row", "chunk.first", "chunk.last", F.unhex(F.sha2("chunk.body", 256)).alias("digest"))
    # Where each document has a chunk. Rows that repeat id and text are one document.
    places = materialise(pieces.groupBy("id", "row", "digest").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("at")), "chunks")

    # What is grouped by a key is written before it is joined by it: of a plain join Spark splits a key that many rows share.
    order = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"))
    first = F.min(F.struct(order.alias("doc"), F.col("at")[0]["first"].alias("first")))
    earliest = places.groupBy("digest").agg(first.alias("source"), F.sum(F.size("at")).alias("n")).where("n > 1").drop("n")
    again = places.join(materialise(earliest, "first-chunks").hint("merge"), "digest").withColumn("own", order)
    # A document's first chunk of its kind is held against the corpus' first one, later ones against the one before.
    one = F.struct(F.col("source.doc.id").alias("sid"), F.col("source.doc.row").alias("srow"), (F.col("at")[0]["first"] - F.col("source.first")).alias("shift"), F.col("at")[0].alias("anchor"))
    foreign = F.when(F.col("own") == F.col("source.doc"), F.filter(F.array(one), lambda _: F.lit(False))).otherwise(F.array(one))
    inner = F.transform(F.slice("at", 2, F.size("at")), lambda a, k: F.struct(
        F.col("id").alias("sid"), F.col("row").alias("srow"), (a["first"] - F.get("at", k)["first"]).alias("shift"), a.alias("anchor")
    ))
    each = again.select("id", "row", F.explode(F.concat(foreign, inner)).alias("x")).select("id", "row", "x.sid", "x.srow", "x.shift", "x.anchor.first", "x.anchor.last")

    hashes = texts.dropDuplicates(["id", "row"]).select("id", "row", F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("hashes"))
    ranges = _drawn_out(each, materialise(hashes, "line-hashes"))
    gone = _proven(ranges, texts.dropDuplicates(["id", "row"]))
    # Ranges of a document made one where they overlap, whatever their sources.
    w = Window.partitionBy(*_DOC).orderBy("first", "last")
    before = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = gone.withColumn("part", F.sum(F.coalesce(F.col("first") > before, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    gone = parts.groupBy(*_DOC, "part").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    gone = gone.groupBy(*_DOC).agg(F.collect_list(F.struct("first", "last")).alias("ranges"), F.sum("n").alias("n_removed_chunks"))
    counts = places.groupBy(*_DOC).agg(F.sum(F.size("at")).cast("long").alias("n_chunks"))
    gone = gone.select(F.col("id").alias("g_id"), F.col("row").alias("g_row"), "ranges", "n_removed_chunks")
    known = materialise(counts.join(gone, _same([("id", "g_id"), ("row", "g_row")]), "left").drop("g_id", "g_row"), "gone")
    found = texts.alias("t").join(known.hint("merge").alias("g"), F.col("t.id").eqNullSafe(F.col("g.id")) & (F.col("t.row") == F.col("g.row")), "left")

    def left(lines: Column) -> Column:
        covered = F.flatten(F.transform("g.ranges", lambda x: F.sequence(x["first"], x["last"])))
        stays = F.when(F.col("g.ranges").isNull(), lines).otherwise(let(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered), lambda k: F.transform(k, lambda i: F.get(lines, i))))
        return let(stays, lambda s: F.struct(
            F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(s)).cast("long").alias("n_removed_lines"), F.array_join(s, "\n").alias("text")
        ))

    return found.select(
        F.col("t.id").alias(id_col), F.coalesce("g.n_chunks", F.lit(0)).cast("long").alias("n_chunks"),
        F.coalesce("g.n_removed_chunks", F.lit(0)).cast("long").alias("n_removed_chunks"), let(F.split("t.text", "\n"), left).alias("out"),
    ).select(id_col, "out.n_lines", "n_chunks", "n_removed_chunks", "out.n_removed_lines", "out.text")
