"""Splitting oversized items at natural boundaries.

Method: balanced targets. A section of L characters that must be cut into pieces of at most ``limit`` characters, of
which up to ``overlap`` are shared with the piece before, needs at least ceil(L / room) pieces, where ``room`` = limit -
overlap. Equal-length targets are placed, and each is snapped to the strongest boundary near it: before a labelled
paragraph, before a paragraph, after a line, after a sentence, between words, between characters; the nearest of equals.
"Near" means half of what a piece of equal length leaves of ``room``, so that two snapped cuts are never too far apart;
if that leaves less than ``SLACK`` of the room to look around, one piece is added.

A piece then begins with text that the piece before also has: from the earliest paragraph start, or else sentence start,
at most ``overlap`` characters before its cut. ``keep_before`` is the position of the paragraph in which the next piece's
own text begins; what begins there or later belongs to the next piece (null in the last piece).

Only section lengths and the text around targets are looked at, each in its own row: no task holds a whole section. The
paragraphs of one piece are gathered at the end, at most ``limit`` characters. Sections within the limit are not cut.

Defined results: null texts count as empty, empty paragraphs are in no piece; rows without revision or position are
ignored; of rows with the same revision and position the one with the smallest pid counts; empty tables give empty
results; other columns are ignored. Characters are code points.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.islands import islands, running_sum
from lectern.sources.tables import materialise

LIMIT, OVERLAP, SLACK = 24_000, 4_000, 0.05
SENTENCE = re.compile(r"[.!?。！？][\"')\]]*\s+|[。！？]")
LINE, GAP = re.compile(r"\n\s*"), re.compile(r"\s+")


#: Fewer sections than this are broadcast (some 40 bytes each), more are joined by shuffling.
BROADCAST_ROWS = 200_000
#: Fewer paragraphs of such sections than this (some 40 bytes each) are broadcast, so that other texts do not move.
BROADCAST_POSITIONS = 500_000


def sectioned(paragraphs: DataFrame) -> DataFrame:
    """(revision_id, position, island, chars): each paragraph with the first position of its section.

    Only lengths and a 128-bit hash of the section path are moved.
    """
    path = F.concat_ws("\x1f", "section_path")
    same = F.struct(F.col("section_path").isNull().alias("none"), F.size("section_path").alias("depth"), F.xxhash64(path).alias("h1"), F.xxhash64(F.lit(1), path).alias("h2"))
    light = paragraphs.where(F.col("revision_id").isNotNull() & F.col("position").isNotNull()).select(
        "pid", "revision_id", "position", same.alias("path"), F.coalesce(F.length("text"), F.lit(0)).alias("chars"), F.coalesce(F.col("block_kind") == "reference", F.lit(False)).alias("apart")
    )
    one = light.groupBy("revision_id", "position").agg(F.min_by(F.struct("path", "chars", "apart"), "pid").alias("p")).select("revision_id", "position", "p.*")
    return islands(one, "revision_id", "position", F.col("path"), ~F.col("apart")).select("revision_id", "position", "island", "chars")


def long_sections(sections: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(revision_id, island, last_pos, total) of ``sectioned`` paragraphs: sections with more than ``limit`` characters."""
    s = sections.groupBy("revision_id", "island").agg(F.max("position").alias("last_pos"), F.sum("chars").alias("total"))
    return s.where(F.col("total") > limit)


def oversized(paragraphs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(revision_id, first_pos, last_pos, chars): sections whose texts have more than ``limit`` characters."""
    return long_sections(sectioned(paragraphs), limit).select("revision_id", F.col("island").alias("first_pos"), "last_pos", F.col("total").alias("chars"))


def piece_count(chars: int, limit: int, overlap: int) -> int:
    """The least number of equal pieces, one more if they leave too little room to look for boundaries."""
    room = limit - overlap
    n = max(1, -(-chars // room))
    if n > 1 and (room - chars / n) < SLACK * room:
        n += 1
    return n


def boundary(text: str, low: int, high: int, target: int, labelled: bool) -> tuple[int, int]:
    """(strength, offset) of the best cut of a paragraph at offsets low..high (0: before the paragraph)."""
    if low <= 0 <= high:
        return (5 if labelled else 4), 0
    for strength, rule in ((3, LINE), (2, SENTENCE), (1, GAP)):
        at = [m.end() for m in rule.finditer(text, max(0, low - 50), min(len(text), high + 50))]
        at = [a for a in at if max(1, low) <= a <= min(high, len(text) - 1)]
        if at:
            return strength, min(at, key=lambda a: (abs(a - target), a))
    a = min(max(target, 1, low), min(high, len(text) - 1))
    while 1 < a < len(text) and a > low and 0x300 <= ord(text[a]) < 0x370:  # not before a combining mark
        a -= 1
    return 0, a


def overlap_start(text: str, end: int, room: int, first: bool) -> int | None:
    """Where shared text may begin in a paragraph whose text up to ``end`` lies before a cut: its start, or else a
    sentence start, at most ``room`` characters before ``end``."""
    if end <= room:
        return 0
    if not first:
        return None
    at = [m.end() for m in SENTENCE.finditer(text, max(0, end - room - 1), end) if end - room <= m.end() < end]
    return at[0] if at else None


def chunks(paragraphs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(revision_id, first_pos, last_pos, piece, section_path, keep_before, chars, shared, paragraphs): the pieces of the
    sections above the limit; paragraphs is an array of (position, start, text)."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    room = limit - overlap
    cols = paragraphs.select("pid", "revision_id", "position", "section_path", "block_kind", "block_label", "text")
    where = materialise(sectioned(cols), "sectioned")
    long = materialise(long_sections(where, limit), "long")
    small = F.broadcast(long) if long.count() <= BROADCAST_ROWS else long
    # texts of those sections alone, found by the positions of their paragraphs
    at = materialise(where.join(small, ["revision_id", "island"]).select("revision_id", "position", "island", "last_pos", "total"), "positions")
    own = cols.drop("block_kind").join(F.broadcast(at) if at.count() <= BROADCAST_POSITIONS else at, ["revision_id", "position"])
    own = own.groupBy("revision_id", "island", "last_pos", "total", "position").agg(F.min_by(F.struct("section_path", "block_label", F.coalesce("text", F.lit("")).alias("text")), "pid").alias("p"))
    own = own.select("revision_id", "island", "last_pos", "total", "position", "p.*").withColumn("n", F.length("text")).where("n > 0")
    own = materialise(running_sum(own, ["revision_id", "island"], "position", F.col("n")), "sections")
    n = F.greatest(F.lit(1), F.ceil(F.col("total") / room))
    n = n + F.when((n > 1) & (room - F.col("total") / n < SLACK * room), 1).otherwise(0)
    half = F.floor((room - F.col("total") / F.col("n")) / 2)
    targets = long.withColumn("n", n).withColumn("half", half).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n") - 1)))
    targets = targets.where("n > 1").select("revision_id", "island", "k", "half", F.floor(F.col("k") * F.col("total") / F.col("n")).alias("target"))
    # a window meets a paragraph where their character ranges do; both carry the stripes of the section they touch
    stripe = 4 * limit
    t = targets.withColumn("stripe", F.explode(F.sequence(F.floor((F.col("target") - F.col("half")) / stripe), F.floor((F.col("target") + F.col("half")) / stripe))))
    p = own.withColumn("stripe", F.explode(F.sequence(F.floor(F.col("before") / stripe), F.floor((F.col("before") + F.col("n")) / stripe))))
    near = p.withColumnRenamed("n", "len").join(t, ["revision_id", "island", "stripe"]).where((F.col("before") <= F.col("target") + F.col("half")) & (F.col("before") + F.col("len") > F.col("target") - F.col("half")))
    near = near.select("revision_id", "island", "k", "position", "before", "target", "half", "text", F.col("block_label").isNotNull().alias("labelled")).distinct()

    def best(batches):
        for b in batches:
            c = b.to_pydict()
            found = [
                boundary(text, target - half - before, target + half - before, target - before, labelled)
                for text, target, half, before, labelled in zip(c["text"], c["target"], c["half"], c["before"], c["labelled"])
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), b.column(5), pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32())],
                names=["revision_id", "island", "k", "position", "before", "target", "strength", "offset"],
            )

    fields = "revision_id long, island int, k long, position int, before long, target long, strength int, offset int"
    typed = near.select("revision_id", F.col("island").cast("int").alias("island"), F.col("k").cast("long").alias("k"), F.col("position").cast("int").alias("position"), F.col("before").cast("long").alias("before"), F.col("target").cast("long").alias("target"), F.col("half").cast("long").alias("half"), "text", "labelled")
    found = typed.mapInArrow(best, fields).withColumn("cut", F.col("before") + F.col("offset")).where("cut > 0")
    cuts = found.groupBy("revision_id", "island", "k").agg(F.min_by(F.struct("cut", "position", "offset"), F.struct(-F.col("strength"), F.abs(F.col("cut") - F.col("target")), F.col("cut"))).alias("c")).select("revision_id", "island", "k", "c.*")
    cuts = materialise(cuts, "cuts")
    # where the text shared with the piece before begins
    stripes = F.explode(F.sequence(F.floor((F.col("cut") - overlap) / stripe), F.floor(F.col("cut") / stripe)))
    behind = p.withColumnRenamed("n", "len").join(cuts.select("revision_id", "island", "k", "cut").withColumn("stripe", stripes), ["revision_id", "island", "stripe"])
    behind = behind.where((F.col("before") < F.col("cut")) & (F.least(F.col("before") + F.col("len"), F.col("cut")) > F.col("cut") - overlap))
    behind = behind.select("revision_id", F.col("island").cast("int").alias("island"), F.col("k").cast("long").alias("k"), F.col("cut").cast("long").alias("cut"), F.col("before").cast("long").alias("before"), "text").distinct()

    def shared(batches):
        for b in batches:
            c = b.to_pydict()
            start = []
            for text, before, cut in zip(c["text"], c["before"], c["cut"]):
                end = min(len(text), cut - before)
                s = overlap_start(text, end, overlap - (cut - before - end), True)
                start.append(None if s is None else before + s)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(start, pa.int64())], names=["revision_id", "island", "k", "start"])

    begins = behind.mapInArrow(shared, "revision_id long, island int, k long, start long").groupBy("revision_id", "island", "k").agg(F.min("start").alias("start"))
    ends = cuts.select("revision_id", "island", (F.col("k") - 1).alias("k"), F.col("cut").alias("end"), F.col("position").alias("keep_before"))
    first = long.select("revision_id", "island", F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("cut"))
    pieces = cuts.select("revision_id", "island", "k", "cut").unionByName(first).join(begins, ["revision_id", "island", "k"], "left").join(ends, ["revision_id", "island", "k"], "left")
    pieces = pieces.join(long, ["revision_id", "island"]).select("revision_id", "island", "last_pos", "k", F.coalesce("start", "cut").alias("start"), "cut", F.coalesce("end", "total").alias("end"), "keep_before")
    pieces = pieces.withColumn("stripe", F.explode(F.sequence(F.floor(F.col("start") / stripe), F.floor(F.col("end") / stripe))))
    held = p.withColumnRenamed("n", "len").join(pieces.withColumnRenamed("last_pos", "last"), ["revision_id", "island", "stripe"]).where((F.col("before") < F.col("end")) & (F.col("before") + F.col("len") > F.col("start")))
    lo, hi = F.greatest(F.col("start") - F.col("before"), F.lit(0)), F.least(F.col("end") - F.col("before"), F.col("len"))
    part = F.struct("position", lo.cast("int").alias("start"), F.substring(F.col("text"), lo.cast("int") + 1, (hi - lo).cast("int")).alias("text"))
    held = held.select("revision_id", "island", "last", "k", "cut", "start", "end", "keep_before", "section_path", part.alias("part")).dropDuplicates(["revision_id", "island", "k", "part"])
    return held.groupBy("revision_id", F.col("island").alias("first_pos"), F.col("last").alias("last_pos"), F.col("k").cast("int").alias("piece")).agg(
        F.first("section_path").alias("section_path"), F.first("keep_before").alias("keep_before"), (F.first("end") - F.first("start")).alias("chars"), (F.first("cut") - F.first("start")).alias("shared"),
        F.array_sort(F.collect_list("part")).alias("paragraphs"),
    )
