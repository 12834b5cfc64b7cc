"""Read-only tools: units, paragraph ranges, outlines, locations and the citation check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 20


def narrowest_label(paragraphs: DataFrame, units: DataFrame) -> DataFrame:
    """(pid, label): the label of the narrowest labelled unit that holds the paragraph, ties by unit id; null if none."""
    u = units.where("anchor_label IS NOT NULL").select("revision_id", "unit_id", "first_pos", "last_pos", "anchor_label")
    # one row per position a unit covers: a pure equi-join, however many units a revision has
    spread = u.withColumn("position", F.explode(F.sequence("first_pos", "last_pos"))).groupBy("revision_id", "position").agg(
        F.min_by("anchor_label", F.struct(F.col("last_pos") - F.col("first_pos"), "unit_id")).alias("label")
    )
    return paragraphs.select("pid", "revision_id", "position").join(spread, ["revision_id", "position"], "left").select("pid", "label")


def render(name: Column, page: Column, section_path: Column, label: Column) -> Column:
    """'Document, p. N, last section, label', the label only if it is not there already."""
    section = F.when(F.size(section_path) > 0, F.element_at(section_path, -1))
    base = F.array_compact(F.array(name, F.concat(F.lit("p. "), (page + 1).cast("string")), section))
    full = F.when(label.isNotNull() & ~F.array_contains(base, label), F.array_append(base, label)).otherwise(base)
    return F.array_join(full, ", ")


def locations(paragraphs: DataFrame, units: DataFrame, revisions: DataFrame, papers: DataFrame) -> DataFrame:
    """(pid, location) of every paragraph; its own label comes before that of the narrowest labelled unit around it."""
    named = revisions.select("revision_id", "paper_id").join(papers.select("paper_id", "name"), "paper_id")
    label = narrowest_label(paragraphs, units)
    p = paragraphs.select("pid", "revision_id", "page", "section_path", "block_label").join(named, "revision_id").join(label, "pid")
    return p.select("pid", render(F.col("name"), F.col("page"), F.col("section_path"), F.coalesce("block_label", "label")).alias("location"))


def outline(paragraphs: DataFrame) -> DataFrame:
    """(revision_id, section, first_pos, page): a path that comes again later is one row."""
    return paragraphs.groupBy("revision_id", "section_path").agg(F.min("position").alias("first_pos"), (F.min("page") + 1).alias("page"))


def paragraph_range(paragraphs: DataFrame, revision_id: int, first: int, last: int, cap: int = PAGE) -> DataFrame:
    """At most ``cap`` positions from ``first`` on; pages count from 1."""
    return paragraphs.where((F.col("revision_id") == revision_id) & F.col("position").between(first, min(last, first + cap - 1))).withColumn("page", F.col("page") + 1)


def unit_paragraphs(paragraphs: DataFrame, units: DataFrame) -> DataFrame:
    """(unit_id, positions, chars): each unit's paragraphs in order."""
    u = units.select("unit_id", "revision_id", F.explode(F.sequence("first_pos", "last_pos")).alias("position"))
    rows = u.join(paragraphs.select("revision_id", "position", F.length("text").alias("n")), ["revision_id", "position"])
    return rows.groupBy("unit_id").agg(F.array_join(F.array_sort(F.collect_list("position")), ",").alias("positions"), F.sum("n").alias("chars"))


def current_units(units: DataFrame, revisions: DataFrame) -> DataFrame:
    """Units that can be opened: those of current revisions that are ready."""
    return units.join(revisions.where(F.col("is_current") & (F.col("stage") == "ready")).select("revision_id", "paper_id"), "revision_id")


def opened_units(units: DataFrame, revisions: DataFrame, paragraphs: DataFrame, cap: int = PAGE) -> DataFrame:
    """(unit_id, pid, position, page): the paragraphs of units that can be opened, ``cap`` positions at most; others have
    no row."""
    u = current_units(units, revisions).select("unit_id", "revision_id", F.explode(F.sequence("first_pos", F.least("last_pos", F.col("first_pos") + cap - 1))).alias("position"))
    return u.join(paragraphs.select("revision_id", "position", "pid", "page"), ["revision_id", "position"]).select("unit_id", "pid", "position", (F.col("page") + 1).alias("page"))


def document_counts(paragraphs: DataFrame, revisions: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, name, paragraphs): each document that can be opened, with its number of paragraphs (greatest position + 1)."""
    rev = revisions.where(F.col("is_current") & (F.col("stage") == "ready")).select("revision_id", "paper_id")
    last = paragraphs.groupBy("revision_id").agg(F.max("position").alias("last")).join(rev, "revision_id")
    return last.groupBy("paper_id").agg((F.max("last") + 1).alias("paragraphs")).join(papers.select("paper_id", "name"), "paper_id").select("paper_id", "name", "paragraphs")


def retrieved(*returned: DataFrame) -> DataFrame:
    """(pid): what a session has seen, the union of what its tools returned."""
    out = returned[0].select("pid")
    for r in returned[1:]:
        out = out.unionByName(r.select("pid"))
    return out.distinct()


def new_in_session(calls: DataFrame) -> DataFrame:
    """(session, call, new): how many paragraphs each call of a session (session, call, pid) returned that no earlier call had."""
    first = calls.groupBy("session", "pid").agg(F.min("call").alias("call"))
    n = first.groupBy("session", "call").agg(F.count("*").alias("new"))
    return calls.select("session", "call").distinct().join(n, ["session", "call"], "left").select("session", "call", F.coalesce("new", F.lit(0)).alias("new"))


def html_safe(text: Column) -> Column:
    """Text for a page: characters that HTML reads are references, line breaks are elements."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def check_citations(cited: DataFrame, retrieved: DataFrame, located: DataFrame) -> DataFrame:
    """(marker, pid, location, removed): a citation stays if its paragraph was retrieved and has a location."""
    seen = retrieved.select("pid").distinct().withColumn("seen", F.lit(True))
    joined = cited.join(seen, "pid", "left").join(located, "pid", "left")
    gone = F.when(F.col("seen").isNull(), "not retrieved").when(F.col("location").isNull(), "no location")
    return joined.select("marker", "pid", F.when(gone.isNull(), F.col("location")).alias("location"), gone.alias("removed"))


def citations_by_place(checked: DataFrame) -> DataFrame:
    """(place, markers, ord): markers per place without repeats in first-seen order; removed ones last."""
    kept = checked.where("removed IS NULL").groupBy(F.col("location").alias("place"), "marker").count()
    kept = kept.groupBy("place").agg(F.array_sort(F.collect_list("marker")).alias("markers"), F.min("marker").alias("ord"))
    gone = checked.where("removed IS NOT NULL").select(F.concat(F.lit("removed: "), "removed").alias("place"), F.array("marker").alias("markers"), (F.col("marker") + 1_000_000).alias("ord"))
    return kept.unionByName(gone.distinct())
