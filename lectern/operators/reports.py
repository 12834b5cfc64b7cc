"""Evaluation data: reproducible samples, comparisons of judgements, grouped reports, corpus status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.latex import maths
from lectern.sources.tables import materialise

PER_STRATUM = 14
VERDICTS, BOUNDARIES = ("faithful", "overstated", "wrong", "unclear"), ("sensible", "too_narrow", "too_broad", "not_sensible")
FREEZE_FAITHFUL = 0.9
STAGES = ("parse", "segment", "embed", "ready", "failed")


def stratified_sample(rows: DataFrame, stratum: str, identity: str, n: int = PER_STRATUM) -> DataFrame:
    """The ``n`` rows of each stratum with the smallest SHA-256 of their identity: the same whatever the input's order."""
    w = Window.partitionBy(stratum).orderBy(F.sha2(F.col(identity).cast("string"), 256), identity)
    return rows.withColumn("ord", F.row_number().over(w)).where(F.col("ord") <= n)


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    return a.select(*keys, F.col(value).alias("first")).join(b.select(*keys, F.col(value).alias("second")), keys).where("first <> second")


def overridden(base: DataFrame, override: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Right wins where both have a value."""
    return base.select(*keys, F.col(value).alias("b")).join(override.select(*keys, F.col(value).alias("o")), keys, "full").select(*keys, F.coalesce("o", "b").alias(value))


def disagreements_of_all(scores: DataFrame, keys: list[str], rater: str, value: str) -> DataFrame:
    """Every two raters of a key that differ, the smaller name first; a null rater compares with nobody."""
    a = scores.select(*keys, F.col(rater).alias("first_rater"), F.col(value).alias("first"))
    b = scores.select(*keys, F.col(rater).alias("second_rater"), F.col(value).alias("second"))
    return a.join(b, keys).where("first_rater < second_rater AND first <> second").select(*keys, "first_rater", "second_rater", "first", "second")


def overridden_by_all(scores: DataFrame, keys: list[str], rater: str, value: str) -> DataFrame:
    """``overridden`` from rater to rater in order of their names: the last one who has a value wins."""
    return scores.where(F.col(rater).isNotNull()).groupBy(*keys).agg(F.max_by(value, rater).alias(value))


def status_counts(revisions: DataFrame, spark) -> DataFrame:
    """Revisions by stage, with zero for stages that have none."""
    stages = spark.createDataFrame([(s,) for s in STAGES], "stage string")
    n = revisions.groupBy("stage").agg(F.count("*").alias("n"), F.sum(F.col("is_current").cast("int")).alias("current"))
    return F.broadcast(stages).join(n, "stage", "left").select("stage", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("current", F.lit(0)).alias("current"))


def latest_revisions(papers: DataFrame, revisions: DataFrame, least: float = 0.5) -> DataFrame:
    """Each paper's latest revision, with the name of the paper it resembles where the similarity is large enough."""
    last = revisions.groupBy("paper_id").agg(F.max_by(F.struct("revision_id", "revision", "stage", "similar_paper_id", "similarity"), "revision").alias("r")).select("paper_id", "r.*")
    other = papers.select(F.col("paper_id").alias("_p"), F.col("name").alias("similar_name"))
    on = (F.col("similar_paper_id") == F.col("_p")) & (F.col("similarity") >= F.lit(least).cast("float"))
    return papers.select("paper_id", "name", "created_at").join(last, "paper_id").join(other, on, "left").select("paper_id", "name", "revision_id", "revision", "stage", "similar_name")


def newest_ready(revisions: DataFrame) -> DataFrame:
    """Ready revisions that no newer ready revision of the paper follows."""
    r = revisions.where("stage = 'ready'").select("paper_id", "revision_id", "revision")
    newest = r.groupBy("paper_id").agg(F.max_by("revision_id", "revision").alias("revision_id"))
    return newest.select("revision_id", "paper_id")


def pivoted(scores: DataFrame, group: str, column: str, values: list[str], value: str) -> DataFrame:
    """Mean score per group and column, with a row for all (group null) that weighs every score alike."""
    return scores.rollup(group).agg(*[F.round(F.avg(F.when(F.col(column) == v, F.col(value))), 6).alias(v) for v in values])


def means_by_column(scores: DataFrame, group: str, column: str, value: str) -> DataFrame:
    """``pivoted`` in long form, for every value of the column: (group, column, mean), with rows for all (group null)."""
    mean = F.round(F.avg(value), 6).alias("mean")
    each = scores.groupBy(group, column).agg(mean)
    return each.unionByName(scores.groupBy(column).agg(mean).select(F.lit(None).cast(each.schema[group].dataType).alias(group), column, "mean"))


def gloss_report(judged: DataFrame) -> DataFrame:
    """One row of counters over judgements (stratum, verdict, boundaries, source), and whether the freeze criterion is met:
    a share of at least ``FREEZE_FAITHFUL`` faithful of those on readable text, no wrong theorem or definition. Rows without
    a verdict are not reviewed."""
    readable = F.col("source") == "readable"
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    n = judged.where(F.length("verdict") > 0).agg(
        F.count("*").alias("reviewed"),
        *[count(F.col("verdict") == v).alias(v) for v in VERDICTS],
        count(readable).alias("readable"),
        count(readable & (F.col("verdict") == "faithful")).alias("readable_faithful"),
        count(F.col("source") == "garbled").alias("garbled"),
        count((F.col("verdict") == "wrong") & F.col("stratum").isin("theorem", "definition")).alias("wrong_formal"),
        count(F.length("boundaries") > 0).alias("bounded"),
        *[count(F.col("boundaries") == b).alias(b) for b in BOUNDARIES],
    )
    share = F.when(F.col("reviewed") > 0, F.col("faithful") / F.col("reviewed")).otherwise(0.0)
    met = (F.col("readable") > 0) & (F.col("readable_faithful") / F.nullif("readable", F.lit(0)) >= FREEZE_FAITHFUL) & (F.col("wrong_formal") == 0)
    return n.select("*", share.alias("faithful_share"), F.coalesce(met, F.lit(False)).alias("frozen"))


def verdicts_by_stratum(judged: DataFrame) -> DataFrame:
    """(stratum, reviewed, one column per verdict) of the strata that have a reviewed unit."""
    return judged.where(F.length("verdict") > 0).groupBy("stratum").agg(F.count("*").alias("reviewed"), *[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def flag_counts(flagged: DataFrame) -> DataFrame:
    """(flag, n) over an array column ``flags``."""
    return flagged.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def formula_counts(texts: DataFrame, group: str) -> DataFrame:
    """(group, formulas, undelimited): formulas between dollar signs, and equations without any."""
    m = texts.select(group, (F.col("block_kind") == "equation").alias("eq"), F.when(F.contains("text", F.lit("$")), F.size(maths("text"))).otherwise(0).alias("n"))
    return m.groupBy(group).agg(F.sum("n").alias("formulas"), F.count_if(F.coalesce("eq", F.lit(False)) & (F.col("n") == 0)).alias("undelimited"))


def markdown_table(df: DataFrame, rows: int = 1000) -> str:
    """A report as text; reports are small, and more than ``rows`` rows are an error."""
    found = df.limit(rows + 1).collect()
    if len(found) > rows:
        raise ValueError(f"a report of more than {rows} rows")
    head = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    return "\n".join([*head, *(f"| {' | '.join('' if v is None else str(v) for v in r)} |" for r in found)])


def score_report(scores: DataFrame, formulas: DataFrame, group: str, column: str) -> DataFrame:
    """(group, column, mean, scored, formulas, failed, failed_share), with rows for all (group null).

    ``scores`` has one row per judged page, ``formulas`` (group, column, formulas, failed) one per document and column;
    ``scored`` is the number of pages that every column of the group has at least. The row for all weighs every score
    alike; a group without scores is left out, formulas of a column without any are null.
    """
    each = scores.groupBy(group, column).agg(F.avg("score").alias("mean"), F.count("score").alias("n"))
    least = each.groupBy(group).agg(F.min("n").alias("scored"))
    counted = formulas.groupBy(group, column).agg(F.sum("formulas").alias("formulas"), F.sum("failed").alias("failed"))
    rows = each.join(least, group).join(counted, [group, column], "left")
    pages = least.agg(F.sum("scored")).first()[0]  # one number
    every = scores.groupBy(column).agg(F.avg("score").alias("mean")).withColumn("scored", F.lit(pages).cast("long"))
    total = formulas.groupBy(column).agg(F.sum("formulas").alias("formulas"), F.sum("failed").alias("failed"))
    every = every.join(total, column, "left").withColumn(group, F.lit(None).cast(scores.schema[group].dataType))
    both = rows.select(group, column, "mean", "scored", "formulas", "failed").unionByName(every.select(group, column, "mean", "scored", "formulas", "failed"))
    return both.withColumn("mean", F.round("mean", 6)).withColumn("failed_share", F.round(F.try_divide("failed", "formulas"), 6))


def strata_counts(units: DataFrame, stratum: str) -> DataFrame:
    return units.groupBy(stratum).agg(F.count("*").alias("n"))


def chosen_items(items: DataFrame, sample: DataFrame, keys: list[str]) -> DataFrame:
    """Items that a sample names by keys of which any may be null."""
    s = sample.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return items.join(s, same, "left_semi")


def all_judged(items: DataFrame, judged: DataFrame, keys: list[str]) -> bool:
    """Whether every item has a judgement: no key of the items is missing among those of the judgements."""
    return items.select(*keys).join(judged.select(*keys), keys, "left_anti").isEmpty()


def items_that_differ(items: DataFrame, differ: DataFrame, keys: list[str]) -> DataFrame:
    """Items with a key among those that raters disagree about."""
    return items.join(differ.select(*keys).distinct(), keys, "left_semi")


def placed(rows: DataFrame, *order) -> DataFrame:
    """Rows with ``ord``, their place from 1 in the given order, which must be total. They are dealt to ranges of the order
    and numbered there; the ranges' sizes (one row each) say where each begins, so no task holds them all."""
    dealt = materialise(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "placed")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    begins = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_own", own).join(F.broadcast(begins), "_range").withColumn("ord", F.col("_own") + F.col("_before")).drop("_own", "_before", "_range")


def newest_first(papers: DataFrame) -> DataFrame:
    """Papers with ``ord``, their place in the list: newest first, then by name, then by id."""
    return placed(papers, F.desc_nulls_last("created_at"), F.col("name"), F.col("paper_id"))


def unit_items(units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(unit_id, pages, kinds, paragraphs): what a reviewer sees of each unit: the distinct pages of its span in order,
    its kinds, and its paragraphs (position, page, kind, html)."""
    from lectern.operators.lookup import html_safe

    at = units.select("unit_id", "revision_id", F.explode(F.sequence("first_pos", "last_pos")).alias("position"))
    p = paragraphs.select("revision_id", "position", "page", F.coalesce("block_kind", F.lit("text")).alias("kind"), F.coalesce("html", html_safe(F.col("text"))).alias("html"))
    rows = at.join(p, ["revision_id", "position"])
    return rows.groupBy("unit_id").agg(F.array_sort(F.collect_set("page")).alias("pages"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_sort(F.collect_list(F.struct("position", "page", "kind", "html"))).alias("paragraphs"))


def page_items(blocks: DataFrame) -> DataFrame:
    """(revision_id, page, blocks): what a reviewer sees of each page: kind and text of its blocks in order, without
    furniture; a page of furniture alone is there, empty."""
    shown = F.when(F.coalesce("kind", F.lit("")) != "furniture", F.struct("block_index", "kind", "text"))
    return blocks.where("page IS NOT NULL").groupBy("revision_id", "page").agg(F.array_sort(F.collect_list(shown)).alias("blocks"))
