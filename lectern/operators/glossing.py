"""Glossing passages end to end: requests of chunks, replies from a store or a model, their checks, merged units with
where they came from, and the next snapshots of units, questions, vectors and stored replies.

A reply is accepted whole or not at all, and a revision's units are merged only if every one of its chunks has an accepted
reply; accepted replies are stored either way, so the next run asks for the missing ones only.

Defined results: a null title is an empty one; a null text is an empty one; chunks without paragraphs make no request; a reply that is null, no JSON
or not of the schema is rejected as "schema"; repeated stored replies count once (the smallest text); empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import input_hash
from lectern.operators.segment import OPTIONAL, SAME_KEY, chunk_spans, merge_replies, quality_flags, reply_errors, sections
from lectern.ports import complete_missing
from lectern.sources.tables import materialise

# The kinds of anchors, and the fields of a unit in a reply.
ANCHOR_KINDS = ("theorem", "definition", "algorithm", "game", "example", "other")
UNIT_FIELDS = ("first_pos", "last_pos", "anchor_label", "anchor_pos", "anchor_kind", "anchor_term", "gloss", "key_terms", "questions")
_UNIT = "struct<first_pos:int,last_pos:int,anchor_label:string,anchor_pos:int,anchor_kind:string,anchor_term:string,gloss:string,key_terms:array<string>,questions:array<string>>"
CHUNK = ["revision_id", "chunk_first"]


def reply_schema() -> dict:
    """The JSON schema that a model's reply must follow."""
    kinds = {"first_pos": "integer", "last_pos": "integer", "gloss": "string"}
    nullable = {"anchor_label": "string", "anchor_pos": "integer", "anchor_term": "string", "anchor_kind": "string"}
    fields: dict = {f: {"type": kinds[f]} for f in kinds}
    fields |= {f: {"anyOf": [{"type": t} | ({"enum": list(ANCHOR_KINDS)} if f == "anchor_kind" else {}), {"type": "null"}]} for f, t in nullable.items()}
    fields |= {f: {"type": "array", "items": {"type": "string"}} for f in ("key_terms", "questions")}
    unit = {"type": "object", "properties": {f: fields[f] for f in UNIT_FIELDS}, "required": list(UNIT_FIELDS), "additionalProperties": False}
    return {"type": "object", "properties": {"units": {"type": "array", "items": unit}}, "required": ["units"], "additionalProperties": False}


def chunk_requests(paragraphs: DataFrame, titles: DataFrame, prompt: str, model: str) -> DataFrame:
    """(revision_id, chunk_first, chunk_last, keep_before, input_hash, request) of every chunk of every section.

    ``request`` is the JSON message: title, section path, and the paragraphs with position, text and (if not plain) kind.
    A chunk holds at most the limit of characters or one paragraph, so gathering it is bounded.
    """
    spans = chunk_spans(paragraphs).select("revision_id", F.col("first_pos").alias("chunk_first"), F.col("last_pos").alias("chunk_last"), "keep_before")
    at = spans.withColumn("position", F.explode(F.sequence("chunk_first", "chunk_last")))
    held = sections(paragraphs).select("revision_id", "position", "section_path", "text", "content_hash", "block_kind")
    rows = at.join(held, ["revision_id", "position"])
    one = F.struct("position", "content_hash", F.col("block_kind").alias("kind"), "text")
    chunks = rows.groupBy("revision_id", "chunk_first", "chunk_last", "keep_before").agg(F.array_sort(F.collect_set(one)).alias("p"), F.first("section_path").alias("section"))
    chunks = chunks.join(titles.select("revision_id", F.coalesce("title", F.lit("")).alias("title")), "revision_id")
    told = F.transform("p", lambda x: F.struct(x["position"].alias("pos"), F.coalesce(x["text"], F.lit("")).alias("text"), x["kind"].alias("kind")))
    key = F.struct("title", "section", F.transform("p", lambda x: F.struct(x["position"].alias("position"), x["content_hash"].alias("content_hash"), x["kind"].alias("kind"))).alias("paragraphs"), F.lit(prompt).alias("prompt"), F.lit(model).alias("model"))
    return chunks.select("revision_id", "chunk_first", "chunk_last", "keep_before", input_hash(key).alias("input_hash"), F.to_json(F.struct("title", "section", told.alias("paragraphs"))).alias("request"))


def read_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, errors) of replies (chunk columns, ``reply``): one row per unit with ``ord``, its place in the reply, and
    one row per reply that breaks the schema ("schema") or holds no unit ("no units")."""
    parsed = replies.withColumn("keys", F.from_json("reply", "struct<units:array<map<string,string>>>")["units"]).withColumn("units", F.from_json("reply", f"struct<units:array<{_UNIT}>>")["units"])
    whole = F.forall("keys", lambda m: F.array_sort(F.map_keys(m)) == F.array(*[F.lit(f) for f in sorted(UNIT_FIELDS)]))
    typed = F.forall(
        "units",
        lambda u: u["first_pos"].isNotNull() & u["last_pos"].isNotNull() & u["gloss"].isNotNull() & u["key_terms"].isNotNull() & u["questions"].isNotNull() & F.coalesce(u["anchor_kind"].isin(*ANCHOR_KINDS), F.lit(True)),
    )
    only = F.array_sort(F.json_object_keys("reply")) == F.array(F.lit("units"))
    error = F.when(~F.coalesce(whole & typed & only, F.lit(False)), "schema").when(F.size("units") == 0, "no units")
    judged = parsed.withColumn("error", error)
    errors = judged.where("error IS NOT NULL").select(*CHUNK, F.lit(-1).alias("ord"), "error")
    columns = [c for c in replies.columns if c != "reply"]
    units = judged.where("error IS NULL").select(*columns, F.posexplode("units").alias("ord", "u")).select(*columns, "ord", "u.*")
    return units, errors


def uncovered_in_chunks(chunks: DataFrame, units: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(revision_id, chunk_first, ord, error) of chunks with a paragraph that must be in a unit of theirs and is in none."""
    must = paragraphs.where(~F.coalesce(F.col("block_kind").isin(*OPTIONAL), F.lit(False))).select("revision_id", "position")
    need = chunks.select(*CHUNK, F.explode(F.sequence("chunk_first", "chunk_last")).alias("position")).join(must, ["revision_id", "position"], "left_semi")
    held = units.where("first_pos <= last_pos").select(*CHUNK, F.explode(F.sequence(F.greatest("first_pos", "chunk_first"), F.least("last_pos", "chunk_last"))).alias("position")).distinct()
    left = need.join(held, [*CHUNK, "position"], "left_anti").select(*CHUNK).distinct()
    return left.select(*CHUNK, F.lit(1_000_000).alias("ord"), F.lit("not covered").alias("error"))


def first_errors(replies: DataFrame, paragraphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, errors): what replies (with chunk columns) hold, and the first rule that each rejected one breaks."""
    units, errors = read_replies(replies)
    inside = units.where((F.col("first_pos") >= F.col("chunk_first")) & (F.col("last_pos") <= F.col("chunk_last")))
    broken = reply_errors(units, paragraphs).select(*CHUNK, "ord", "error")
    read = replies.join(units.select(*CHUNK).distinct(), CHUNK, "left_semi")
    every = errors.unionByName(broken).unionByName(uncovered_in_chunks(read, inside, paragraphs))
    return units, every.groupBy(*CHUNK).agg(F.min_by(F.struct("ord", "error"), F.struct("ord", "error")).alias("e")).select(*CHUNK, "e.ord", "e.error")


class Glossed(NamedTuple):
    units: DataFrame
    replies: DataFrame
    errors: DataFrame
    calls: int


def gloss(paragraphs: DataFrame, titles: DataFrame, stored: DataFrame, model_of, prompt: str, model: str) -> Glossed:
    """One glossing run over all revisions.

    ``stored`` has (revision_id, input_hash, gloss_model, reply). Chunks whose hash is stored make no call; others go to
    ``model_of()``, as one batch where the client takes batches. Units carry ``input_hash`` and ``gloss_model`` of the
    reply they come from, ``flags`` of the mechanical checks and ``prompt_version``. ``replies`` is the next store: what was
    stored or accepted, without replies of chunks that are gone.
    """
    chunks = materialise(chunk_requests(paragraphs, titles, prompt, model), "chunks")
    known = stored.groupBy("revision_id", "input_hash").agg(F.min_by(F.struct("gloss_model", "reply"), "reply").alias("s")).select("revision_id", "input_hash", "s.*")
    cached = chunks.join(known, ["revision_id", "input_hash"])
    missing = chunks.join(known, ["revision_id", "input_hash"], "left_anti")
    came = materialise(complete_missing(missing, known.select("input_hash").limit(0), model_of), "came")
    failed = missing.join(came.where("error IS NOT NULL"), "input_hash").select(*CHUNK, F.lit(-2).alias("ord"), "error")
    fresh = missing.join(came.where("error IS NULL").select("input_hash", "reply"), "input_hash").withColumn("gloss_model", F.lit(model))
    replies = materialise(cached.unionByName(fresh, allowMissingColumns=True), "replies")
    units, errors = first_errors(replies.drop("request"), paragraphs)
    errors = materialise(errors.unionByName(failed), "errors")
    accepted = replies.join(errors, CHUNK, "left_anti")
    whole = units.join(errors.select("revision_id").distinct(), "revision_id", "left_anti")
    merged = merge_replies(whole).withColumn("unit_id", unit_number())
    flags = quality_flags(merged.drop("questions"), merged.select("unit_id", F.explode("questions").alias("question")), paragraphs, "key_terms")
    merged = merged.join(flags, "unit_id").withColumn("prompt_version", F.lit(prompt)).drop("chunk_first", "chunk_last", "keep_before", "ord")
    return Glossed(merged, accepted.select("revision_id", "input_hash", "gloss_model", "reply"), errors, came.count())


def unit_number() -> Column:
    """The id of a new unit: a hash of its key."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in SAME_KEY])


# --- next snapshots ----------------------------------------------------------------------------------------------


def purged_replies(stored: DataFrame, chunks: DataFrame) -> DataFrame:
    """Stored replies without those of chunks that no longer exist."""
    return stored.join(chunks.select("revision_id", "input_hash").distinct(), ["revision_id", "input_hash"], "left_semi")


def kept_replies(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored replies and new ones; where both have a hash the stored one stays."""
    return stored.unionByName(new.dropDuplicates(["revision_id", "input_hash"]).join(stored.select("revision_id", "input_hash"), ["revision_id", "input_hash"], "left_anti"))


def next_units(old: DataFrame, new: DataFrame) -> DataFrame:
    """The next units of the revisions in ``new``, by key (span and label, null labels equal): a known key keeps its id, a
    new one gets one; all other columns are the new ones. ``change`` is inserted, kept or gloss_changed."""
    o = old.select(*[F.col(c).alias(f"_{c}") for c in SAME_KEY], F.col("unit_id").alias("_id"), F.col("gloss").alias("_gloss"))
    same = F.lit(True)
    for c in SAME_KEY:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    change = F.when(F.col("_id").isNull(), "inserted").when(F.col("gloss").eqNullSafe(F.col("_gloss")), "kept").otherwise("gloss_changed")
    joined = new.drop("unit_id").join(o, same, "left").withColumn("change", change).withColumn("unit_id", F.coalesce("_id", unit_number()))
    return joined.drop(*[f"_{c}" for c in SAME_KEY], "_id", "_gloss")


def unit_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """Events of units that are gone: (unit_id, revision_id, first_pos, last_pos, anchor_label, change)."""
    gone = old.join(new.select(F.col("unit_id")), "unit_id", "left_anti")
    return gone.select("unit_id", *SAME_KEY, F.lit("deleted").alias("change"))


def next_questions(old: DataFrame, units: DataFrame) -> DataFrame:
    """(question_id, unit_id, question, kept): the next questions of units (unit_id, ``questions``). A unit whose ordered
    questions are the same keeps its rows; otherwise all of them are replaced by new ones."""
    had = old.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("question_id", "question"))), lambda x: x["question"]).alias("had"))
    both = units.select("unit_id", "questions").join(had, "unit_id", "left").withColumn("same", F.coalesce(F.col("questions") == F.col("had"), F.lit(False)))
    kept = old.join(both.where("same").select("unit_id"), "unit_id", "left_semi").select("question_id", "unit_id", "question", F.lit(True).alias("kept"))
    new = both.where("NOT same").select("unit_id", F.posexplode("questions").alias("i", "question"))
    return kept.unionByName(new.select(F.xxhash64("unit_id", "i", "question").alias("question_id"), "unit_id", "question", F.lit(False).alias("kept")))


def next_vectors(vectors: DataFrame, units: DataFrame, questions: DataFrame) -> DataFrame:
    """Vectors, in both sets, that still hold: those of paragraphs, of units (unit_id, change) that are kept with their
    gloss, and of questions that are there."""
    keep = units.where("change = 'kept'").select(F.lit("gloss").alias("target"), F.col("unit_id").alias("owner_id"))
    keep = keep.unionByName(questions.select(F.lit("question").alias("target"), F.col("question_id").alias("owner_id"))).distinct()
    held = vectors.where(F.col("target").isin("gloss", "question")).join(keep, ["target", "owner_id"], "left_semi")
    return vectors.where(~F.coalesce(F.col("target").isin("gloss", "question"), F.lit(False))).unionByName(held.select(*vectors.columns))


def filled_vectors(vectors: DataFrame, made: DataFrame, set_name: str, target: str, model: str) -> DataFrame:
    """Vectors with new ones (owner_id, emb) of owners that had no usable one; a usable one is never replaced, unusable
    ones of the owners are dropped."""
    own = (F.col("set_name") == set_name) & (F.col("target") == target)
    usable = F.coalesce((F.size("emb") > 0) & ~F.exists("emb", lambda x: x.isNull() | F.isnan(x)) & F.exists("emb", lambda x: x != 0), F.lit(False))
    have = vectors.where(own & usable).select("owner_id").distinct()
    new = made.select("owner_id", "emb").dropDuplicates(["owner_id"]).join(have, "owner_id", "left_anti")
    stale = vectors.where(own & ~usable).join(new.select("owner_id"), "owner_id", "left_semi").select("vector_id").distinct()
    rows = new.select(F.xxhash64(F.lit(set_name), F.lit(target), "owner_id").alias("vector_id"), F.lit(set_name).alias("set_name"), F.lit(target).alias("target"), "owner_id", F.lit(model).alias("model"), "emb")
    return vectors.join(stale, "vector_id", "left_anti").unionByName(rows.select(*vectors.columns))


def cleared_vectors(vectors: DataFrame, revisions: DataFrame, paragraphs: DataFrame, units: DataFrame, questions: DataFrame) -> DataFrame:
    """Vectors without those of the paragraphs, units and questions of ``revisions``, in every set."""
    rev = revisions.select("revision_id").distinct()
    u = units.join(rev, "revision_id", "left_semi")
    gone = paragraphs.join(rev, "revision_id", "left_semi").select(F.lit("paragraph").alias("target"), F.col("pid").alias("owner_id"))
    gone = gone.unionByName(u.select(F.lit("gloss").alias("target"), F.col("unit_id").alias("owner_id")))
    gone = gone.unionByName(questions.join(u.select("unit_id"), "unit_id", "left_semi").select(F.lit("question").alias("target"), F.col("question_id").alias("owner_id")))
    return vectors.join(gone, ["target", "owner_id"], "left_anti").select(*vectors.columns)


def vectors_left(vectors: DataFrame) -> DataFrame:
    """(set_name, target, n): how many vectors are not null; a set whose paragraphs have none left loses its model."""
    return vectors.groupBy("set_name", "target").agg(F.count("emb").alias("n"))
