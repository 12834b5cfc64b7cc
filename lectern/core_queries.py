"""Queries of the core: name -> callable(spark, sf_dir), and the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions.text import content_hash, matches, websearch, words
from lectern import ports
from lectern.operators import glossing, ingest, lookup, reports, retrieval, segment
from lectern.sources.tables import shared_dir, table, temporary
from lectern.streaming.incremental import history

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query(
    "p5_found",
    """
    WITH runs AS (SELECT run_id, started_at, lag(run_id) OVER (ORDER BY started_at) AS prev FROM import_runs WHERE status = 'succeeded'),
    cur AS (SELECT r.run_id, i.revision_id, i.position, lower(trim(i.content_hash, E' \\t\\n\\r')) AS h,
                   row_number() OVER (PARTITION BY r.run_id, i.revision_id, i.position ORDER BY i.modified_at DESC, i.delivery_id DESC) AS rn
            FROM runs r JOIN import_rows i ON i.arrived_at <= r.started_at),
    one AS (SELECT * FROM cur WHERE rn = 1)
    SELECT a.run_id, a.revision_id, a.position
    FROM one a JOIN runs r ON r.run_id = a.run_id
    LEFT JOIN one b ON b.run_id = r.prev AND b.revision_id = a.revision_id AND b.position = a.position
    WHERE a.h IS NOT NULL AND (b.h IS NULL OR b.h <> a.h)
    """,
)
def p5_found(spark, d):
    rows = table(spark, d, "import_rows", "delivery_id", "revision_id", "position", "content_hash", "modified_at", "arrived_at")
    return history(rows, table(spark, d, "import_runs", "run_id", "started_at", "status"))


# --- retrieval ---------------------------------------------------------------------------------------------------

#: The question asked by the search queries: a word, and the first usable question vector.
TERM = "lattice"
_QUERY_VECTOR = """
    qv AS (SELECT list_transform(emb, lambda x: x::DOUBLE) AS q FROM vectors WHERE set_name = 'primary' AND target = 'question' AND emb IS NOT NULL AND len(emb) = 64
             AND len(list_filter(emb, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(emb, lambda x: x <> 0)) > 0 ORDER BY vector_id LIMIT 1),
    vec AS (SELECT owner_id, target, round(list_cosine_similarity(list_transform(emb, lambda x: x::DOUBLE), q), 9) AS score FROM vectors, qv
             WHERE set_name = 'primary' AND emb IS NOT NULL AND len(emb) = 64 AND len(list_filter(emb, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(emb, lambda x: x <> 0)) > 0)
"""
_SCOPE = """
    rev AS (SELECT revision_id, paper_id FROM revisions WHERE is_current AND stage = 'ready'),
    ps AS (SELECT p.* FROM paragraphs p JOIN rev USING (revision_id) WHERE coalesce(block_kind, '') <> 'reference'),
    us AS (SELECT u.* FROM units u JOIN rev USING (revision_id) WHERE coalesce(anchor_kind, '') <> 'reference' AND coalesce(anchor_term, '') <> 'reference')
"""
_CHANNELS = """
    c_p AS (SELECT pid, max(score) AS score FROM ps JOIN vec ON owner_id = pid AND target = 'paragraph' GROUP BY pid ORDER BY 2 DESC, 1 LIMIT 50),
    ft AS (SELECT pid, len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: w = 'lattice')) AS n FROM ps WHERE lower(text) LIKE '%lattice%'),
    c_f AS (SELECT pid, round(n * 0.1::DOUBLE, 9) AS score FROM ft WHERE n > 0 ORDER BY 2 DESC, 1 LIMIT 50),
    c_g AS (SELECT unit_id, max(score) AS score FROM us JOIN vec ON owner_id = unit_id AND target = 'gloss' GROUP BY unit_id ORDER BY 2 DESC, 1 LIMIT 50),
    c_q AS (SELECT us.unit_id, max(score) AS score FROM us JOIN unit_questions q ON q.unit_id = us.unit_id JOIN vec ON owner_id = question_id AND target = 'question' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)
"""
_FUSED = """
    ph AS (SELECT 'paragraph' AS channel, pid, row_number() OVER (ORDER BY score DESC, pid) AS rank FROM c_p
           UNION ALL SELECT 'fulltext', pid, row_number() OVER (ORDER BY score DESC, pid) FROM c_f),
    uh AS (SELECT 'gloss' AS channel, unit_id, row_number() OVER (ORDER BY score DESC, unit_id) AS rank FROM c_g
           UNION ALL SELECT 'question', unit_id, row_number() OVER (ORDER BY score DESC, unit_id) FROM c_q),
    items AS (SELECT CASE WHEN u.unit_id IS NULL THEN 'paragraph' ELSE 'unit' END AS item_type, coalesce(u.unit_id, ph.pid) AS item_id, channel, rank
              FROM ph JOIN paragraphs p ON p.pid = ph.pid LEFT JOIN units u ON u.revision_id = p.revision_id AND p.position BETWEEN u.first_pos AND u.last_pos
              UNION ALL SELECT 'unit', unit_id, channel, rank FROM uh),
    best AS (SELECT item_type, item_id, channel, min(rank) AS rank FROM items GROUP BY ALL),
    fused AS (SELECT item_type, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS n_channels FROM best GROUP BY ALL ORDER BY score DESC, item_type, item_id LIMIT 10)
"""


def query_vector(spark, d):
    v = table(spark, d, "vectors", "vector_id", "set_name", "target", "emb").where("set_name = 'primary' AND target = 'question' AND size(emb) = 64")
    v = v.where(F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("emb", lambda x: x != 0))
    row = v.orderBy("vector_id").select("emb").first()
    return list(row["emb"]) if row else [1.0] + [0.0] * 63


def _tables(spark, d):
    return {t: table(spark, d, t) for t in ("paragraphs", "units", "unit_questions", "vectors", "revisions", "papers")}


def _scopes(spark, d):
    t = _tables(spark, d)
    return t, retrieval.paragraph_scope(t["paragraphs"], t["revisions"]), retrieval.unit_scope(t["units"], t["revisions"])


@query("rrf_search", f"WITH {_QUERY_VECTOR}, {_SCOPE}, {_CHANNELS}, {_FUSED} SELECT item_type, item_id, score, n_channels FROM fused")
def rrf_search(spark, d):
    hits = retrieval.search(_tables(spark, d), TERM, query_vector(spark, d))
    return hits.select("item_type", "item_id", "score", F.size("channels").cast("bigint").alias("n_channels"))


@query("rrf_search_all_channels")
def rrf_search_all_channels(spark, d):
    hits = retrieval.search(_tables(spark, d), r"x \in \mathbb{Z}_{479}", query_vector(spark, d), exclude=())
    return hits.select("item_type", "item_id", "score", F.map_keys("channels").alias("channels"), "matched_positions")


_KINDS = _SCOPE.replace("coalesce(block_kind, '') <> 'reference'", "block_kind IN ('lemma', 'theorem', 'equation')").replace(
    "coalesce(anchor_kind, '') <> 'reference' AND coalesce(anchor_term, '') <> 'reference'", "anchor_kind IN ('lemma', 'theorem', 'equation') OR anchor_term IN ('lemma', 'theorem', 'equation')"
)


@query("rrf_search_kinds", f"WITH {_QUERY_VECTOR}, {_KINDS}, {_CHANNELS}, {_FUSED} SELECT item_type, item_id, score FROM fused")
def rrf_search_kinds(spark, d):
    hits = retrieval.search(_tables(spark, d), TERM, query_vector(spark, d), kinds=("lemma", "theorem", "equation"))
    return hits.select("item_type", "item_id", "score")


@query("channel_vector_paragraph", f"WITH {_QUERY_VECTOR}, {_SCOPE}, {_CHANNELS} SELECT pid, score FROM c_p")
def channel_vector_paragraph(spark, d):
    t, p, _ = _scopes(spark, d)
    return retrieval.vector_channel(p, "pid", t["vectors"], "primary", "paragraph", query_vector(spark, d)).select("pid", "score")


@query("channel_vector_gloss", f"WITH {_QUERY_VECTOR}, {_SCOPE}, {_CHANNELS} SELECT unit_id, score FROM c_g")
def channel_vector_gloss(spark, d):
    t, _, u = _scopes(spark, d)
    return retrieval.vector_channel(u, "unit_id", t["vectors"], "primary", "gloss", query_vector(spark, d)).select("unit_id", "score")


@query("channel_question_groupmin", f"WITH {_QUERY_VECTOR}, {_SCOPE}, {_CHANNELS} SELECT unit_id, score FROM c_q")
def channel_question_groupmin(spark, d):
    t, _, u = _scopes(spark, d)
    return retrieval.question_channel(u, t["unit_questions"], t["vectors"], "primary", query_vector(spark, d)).select("unit_id", "score")


@query("channel_fulltext_term", f"WITH {_QUERY_VECTOR}, {_SCOPE}, {_CHANNELS} SELECT pid, score FROM c_f")
def channel_fulltext_term(spark, d):
    return retrieval.fulltext_channel(_scopes(spark, d)[1], TERM).select("pid", "score")


@query("channel_fulltext_phrase_not")
def channel_fulltext_phrase_not(spark, d):
    return retrieval.fulltext_channel(_scopes(spark, d)[1], '"zero knowledge" lattice -quorum or "public key" digest').select("pid", "score", "rank")


@query(
    "fulltext_matches",
    f"""
    WITH {_SCOPE}, w AS (SELECT pid, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS t FROM ps)
    SELECT pid FROM w WHERE t LIKE '% zero knowledge %' AND t LIKE '% lattice %' AND t NOT LIKE '% quorum %'
    """,
)
def fulltext_matches(spark, d):
    p = _scopes(spark, d)[1]
    return p.where(matches(words(F.col("text")), websearch('"zero knowledge" lattice -quorum'))).select("pid")


@query("channel_latex")
def channel_latex(spark, d):
    return retrieval.latex_channel(_scopes(spark, d)[1], r"x_{27} \in \mathbb{Z}_{479}").select("pid", "score", "rank")


@query("scope_current_ready", f"WITH {_SCOPE} SELECT pid, revision_id FROM ps")
def scope_current_ready(spark, d):
    return _scopes(spark, d)[1].select("pid", "revision_id")


@query("scope_units_kinds", f"WITH {_SCOPE} SELECT unit_id FROM us WHERE anchor_kind IN ('lemma', 'theorem') OR anchor_term IN ('lemma', 'theorem')")
def scope_units_kinds(spark, d):
    t = _tables(spark, d)
    return retrieval.unit_scope(t["units"], t["revisions"], kinds=("lemma", "theorem")).select("unit_id")


@query(
    "enclosing_units",
    "SELECT p.pid, u.unit_id FROM paragraphs p LEFT JOIN units u ON u.revision_id = p.revision_id AND p.position BETWEEN u.first_pos AND u.last_pos",
)
def enclosing_units(spark, d):
    return retrieval.enclosing(table(spark, d, "paragraphs", "pid", "revision_id", "position"), table(spark, d, "units")).select("pid", "unit_id")


_HYDRATED = """
    h AS (SELECT f.*, u.revision_id, first_pos, last_pos, anchor_label FROM fused f JOIN units u ON item_type = 'unit' AND unit_id = item_id
          UNION ALL SELECT f.*, p.revision_id, position, position, NULL FROM fused f JOIN paragraphs p ON item_type = 'paragraph' AND pid = item_id),
    hp AS (SELECT item_type, item_id, string_agg(p.position::VARCHAR, ',' ORDER BY p.position) AS positions,
                  coalesce(string_agg(p.position::VARCHAR, ',' ORDER BY p.position) FILTER (p.pid IN (SELECT pid FROM ph)), '') AS matched
           FROM h JOIN paragraphs p ON p.revision_id = h.revision_id AND p.position BETWEEN first_pos AND last_pos GROUP BY 1, 2)
"""


@query(
    "search_hydrated",
    f"""
    WITH {_QUERY_VECTOR}, {_SCOPE}, {_CHANNELS}, {_FUSED}, {_HYDRATED}
    SELECT item_type, item_id, name, first_pos, last_pos, anchor_label, positions, matched FROM h JOIN hp USING (item_type, item_id) JOIN revisions r USING (revision_id) JOIN papers USING (paper_id)
    """,
)
def search_hydrated(spark, d):
    t = _tables(spark, d)
    full = retrieval.hydrate(retrieval.search(t, TERM, query_vector(spark, d)), t)
    at = lambda x: F.array_join(F.transform(x, lambda p: p["position"]), ",")
    return full.select("item_type", "item_id", "name", "first_pos", "last_pos", "anchor_label", at("paragraphs").alias("positions"), at(F.filter("paragraphs", lambda p: p["matched"])).alias("matched"))


_BATCH = """
    qs AS (SELECT question_id AS question, arg_min(emb, vector_id) AS emb FROM unit_questions JOIN vectors ON set_name = 'primary' AND target = 'question' AND owner_id = question_id
           WHERE question_id % 100 = 0 AND emb IS NOT NULL AND len(emb) = 64 AND len(list_filter(emb, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(emb, lambda x: x <> 0)) > 0 GROUP BY 1),
    v AS (SELECT owner_id, target, list_transform(emb, lambda x: x::DOUBLE) AS e FROM vectors
          WHERE set_name = 'primary' AND emb IS NOT NULL AND len(emb) = 64 AND len(list_filter(emb, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(emb, lambda x: x <> 0)) > 0),
    o AS (SELECT 'paragraph' AS channel, pid AS item, e FROM ps JOIN v ON owner_id = pid AND target = 'paragraph' UNION ALL SELECT 'gloss', unit_id, e FROM us JOIN v ON owner_id = unit_id AND target = 'gloss'
          UNION ALL SELECT 'question', us.unit_id, e FROM us JOIN unit_questions q ON q.unit_id = us.unit_id JOIN v ON owner_id = question_id AND target = 'question'),
    s AS (SELECT question, channel, item, max(round(list_cosine_similarity(e, list_transform(emb, lambda x: x::DOUBLE)), 9)) AS score FROM o, qs GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY question, channel ORDER BY score DESC, item) AS rank FROM s QUALIFY rank <= 50),
    items AS (SELECT question, CASE WHEN u.unit_id IS NULL THEN 'paragraph' ELSE 'unit' END AS item_type, coalesce(u.unit_id, p.pid) AS item_id, channel, rank
              FROM r JOIN paragraphs p ON p.pid = r.item LEFT JOIN units u ON u.revision_id = p.revision_id AND p.position BETWEEN u.first_pos AND u.last_pos WHERE channel = 'paragraph'
              UNION ALL SELECT question, 'unit', item, channel, rank FROM r WHERE channel <> 'paragraph'),
    b AS (SELECT question, item_type, item_id, channel, min(rank) AS rank FROM items GROUP BY ALL),
    f AS (SELECT question, item_type, item_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM b GROUP BY ALL)
"""


def _asked(spark, d):
    """The stored questions whose id is divisible by 100, with their first usable vectors."""
    v = table(spark, d, "vectors", "vector_id", "set_name", "target", "owner_id", "emb").where("set_name = 'primary' AND target = 'question' AND size(emb) = 64")
    v = v.where(F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("emb", lambda x: x != 0))
    q = table(spark, d, "unit_questions", "question_id", "question").where("question_id % 100 = 0").withColumnRenamed("question", "text")
    first = v.join(F.broadcast(q.select(F.col("question_id").alias("owner_id"))), "owner_id").groupBy("owner_id").agg(F.min_by("emb", "vector_id").alias("emb"))
    return q.join(first, q["question_id"] == first["owner_id"]).select(F.col("question_id").alias("question"), "text", "emb")


@query("search_batch", f"WITH {_SCOPE}, {_BATCH} SELECT question, item_type, item_id, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, item_type, item_id) AS place FROM f QUALIFY place <= 10")
def search_batch(spark, d):
    """The fused hits of the three vector channels for many questions in one plan."""
    hits = retrieval.search_many(_tables(spark, d), _asked(spark, d), channels=("paragraph", "gloss", "question"))
    return hits.select("question", "item_type", "item_id", "score", F.col("place").cast("bigint").alias("place"))


@query("search_batch_all_channels")
def search_batch_all_channels(spark, d):
    """The same with all five channels, over stored postings and normal forms."""
    t = _tables(spark, d)
    t |= retrieval.write_index(t["paragraphs"], temporary(f"{shared_dir(spark)}/lectern-index-{uuid.uuid4().hex}", spark))
    hits = retrieval.search_many(t, _asked(spark, d))
    return hits.select("question", "item_type", "item_id", "score", "place", F.map_keys("channels").alias("channels"))


# --- tools -------------------------------------------------------------------------------------------------------


@query(
    "unit_hydrate",
    """
    SELECT u.unit_id, string_agg(p.position::VARCHAR, ',' ORDER BY p.position) AS positions, sum(length(p.text))::BIGINT AS chars
    FROM units u JOIN paragraphs p ON p.revision_id = u.revision_id AND p.position BETWEEN u.first_pos AND u.last_pos GROUP BY 1
    """,
)
def unit_hydrate(spark, d):
    return lookup.unit_paragraphs(table(spark, d, "paragraphs", "revision_id", "position", "text"), table(spark, d, "units"))


_LABEL = """
    l AS (SELECT p.pid, u.anchor_label AS label, row_number() OVER (PARTITION BY p.pid ORDER BY u.last_pos - u.first_pos, u.unit_id) AS n
          FROM paragraphs p LEFT JOIN units u ON u.revision_id = p.revision_id AND p.position BETWEEN u.first_pos AND u.last_pos AND u.anchor_label IS NOT NULL)
"""


@query("narrowest_unit_label", f"WITH {_LABEL} SELECT pid, label FROM l WHERE n = 1")
def narrowest_unit_label(spark, d):
    return lookup.narrowest_label(table(spark, d, "paragraphs", "pid", "revision_id", "position"), table(spark, d, "units"))


_LOCATION = f"""{_LABEL},
    loc AS (SELECT p.pid, list_filter([pa.name, 'p. ' || (p.page + 1), p.section_path[-1]], lambda x: x IS NOT NULL) AS parts, coalesce(p.block_label, l.label) AS label
            FROM paragraphs p JOIN revisions r USING (revision_id) JOIN papers pa USING (paper_id) JOIN l ON l.pid = p.pid AND l.n = 1),
    located AS (SELECT pid, array_to_string(CASE WHEN label IS NOT NULL AND NOT list_contains(parts, label) THEN list_append(parts, label) ELSE parts END, ', ') AS location FROM loc)
"""


def _locations(spark, d):
    return lookup.locations(table(spark, d, "paragraphs", "pid", "revision_id", "position", "page", "section_path", "block_label"), table(spark, d, "units"), table(spark, d, "revisions"), table(spark, d, "papers"))


@query("location_render", f"WITH {_LOCATION} SELECT pid, location FROM located")
def location_render(spark, d):
    return _locations(spark, d)


@query("document_outline", "SELECT revision_id, array_to_string(section_path, ' / ') AS section, min(position) AS first_pos, min(page) + 1 AS page FROM paragraphs GROUP BY revision_id, section_path")
def document_outline(spark, d):
    o = lookup.outline(table(spark, d, "paragraphs", "revision_id", "section_path", "position", "page"))
    return o.select("revision_id", F.array_join("section_path", " / ").alias("section"), "first_pos", "page")


@query("get_paragraphs_page", "SELECT pid, position, page + 1 AS page, content_hash FROM paragraphs WHERE revision_id = 1 AND position BETWEEN 5 AND least(60, 5 + 19)")
def get_paragraphs_page(spark, d):
    return lookup.paragraph_range(table(spark, d, "paragraphs", "pid", "revision_id", "position", "page", "content_hash"), 1, 5, 60).select("pid", "position", "page", "content_hash")


# cited: each unit cites the paragraph with its number; retrieved: the paragraphs of even position
_CITED = "SELECT unit_id AS marker, unit_id * 3 AS pid FROM units"


def _checked(spark, d):
    cited = table(spark, d, "units", "unit_id").select(F.col("unit_id").alias("marker"), (F.col("unit_id") * 3).alias("pid"))
    retrieved = table(spark, d, "paragraphs", "pid", "position").where("position % 2 = 0")
    return lookup.check_citations(cited, retrieved, _locations(spark, d))


@query(
    "citation_check",
    f"""
    WITH {_LOCATION}, c AS ({_CITED}), r AS (SELECT DISTINCT pid FROM paragraphs WHERE position % 2 = 0)
    SELECT c.marker, c.pid, CASE WHEN r.pid IS NOT NULL THEN location END AS location, CASE WHEN r.pid IS NULL THEN 'not retrieved' WHEN location IS NULL THEN 'no location' END AS removed
    FROM c LEFT JOIN r ON r.pid = c.pid LEFT JOIN located ON located.pid = c.pid
    """,
)
def citation_check(spark, d):
    return _checked(spark, d)


@query(
    "citations_by_place",
    f"""
    WITH {_LOCATION}, c AS ({_CITED}), r AS (SELECT DISTINCT pid FROM paragraphs WHERE position % 2 = 0),
    k AS (SELECT c.marker, CASE WHEN r.pid IS NULL THEN 'not retrieved' WHEN location IS NULL THEN 'no location' END AS removed, location FROM c LEFT JOIN r ON r.pid = c.pid LEFT JOIN located ON located.pid = c.pid)
    SELECT location AS place, string_agg(DISTINCT marker::VARCHAR, ',' ORDER BY marker::VARCHAR) AS markers, min(marker) AS ord FROM k WHERE removed IS NULL GROUP BY 1
    UNION ALL SELECT DISTINCT 'removed: ' || removed, marker::VARCHAR, marker + 1000000 FROM k WHERE removed IS NOT NULL
    """,
)
def citations_by_place(spark, d):
    c = lookup.citations_by_place(_checked(spark, d))
    return c.select("place", F.array_join(F.array_sort(F.transform("markers", lambda m: m.cast("string"))), ",").alias("markers"), "ord")


@query(
    "hit_kinds",
    """
    WITH k AS (SELECT u.unit_id, list(p.block_kind) AS ks FROM units u LEFT JOIN paragraphs p ON p.revision_id = u.revision_id AND p.position BETWEEN u.first_pos AND u.last_pos GROUP BY 1)
    SELECT unit_id, array_to_string(list_sort(list_distinct(list_filter(list_concat([anchor_kind, anchor_term], ks), lambda x: x IS NOT NULL))), ',') AS kinds FROM units JOIN k USING (unit_id)
    """,
)
def hit_kinds(spark, d):
    u = table(spark, d, "units", "unit_id", "revision_id", "first_pos", "last_pos", "anchor_kind", "anchor_term")
    p = table(spark, d, "paragraphs", "revision_id", "position", "block_kind")
    span = u.select("unit_id", "revision_id", F.explode(F.sequence("first_pos", "last_pos")).alias("position"))
    kinds = span.join(p, ["revision_id", "position"]).groupBy("unit_id").agg(F.collect_set("block_kind").alias("ks"))
    return u.join(kinds, "unit_id", "left").select("unit_id", F.array_join(retrieval.hit_kinds(F.col("anchor_kind"), F.col("anchor_term"), F.coalesce("ks", F.array().cast("array<string>"))), ",").alias("kinds"))


# --- documents ---------------------------------------------------------------------------------------------------


_BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query("content_hash", f"SELECT pid, sha256(trim(regexp_replace(text, '{_BLANKS}', ' ', 'g'))) AS h FROM paragraphs")
def content_hash_q(spark, d):
    return table(spark, d, "paragraphs", "pid", "text").select("pid", content_hash(F.col("text")).alias("h"))


@query(
    "file_dedup",
    f"WITH h AS (SELECT doc_id, sha256(trim(regexp_replace(text, '{_BLANKS}', ' ', 'g'))) AS h FROM documents WHERE text IS NOT NULL) SELECT h, min(doc_id) AS doc_id, count(*) AS copies FROM h GROUP BY h",
)
def file_dedup(spark, d):
    h = table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", content_hash(F.col("text")).alias("h"))
    return h.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(
    "paragraph_positions",
    f"""
    SELECT block_id, revision_id, row_number() OVER (PARTITION BY revision_id ORDER BY block_index) - 1 AS position, nullif(kind, 'text') AS block_kind
    FROM blocks WHERE kind NOT IN ('heading', 'furniture') AND trim(regexp_replace(text, '{_BLANKS}', ' ', 'g')) <> ''
    """,
)
def paragraph_positions(spark, d):
    b = table(spark, d, "blocks", "block_id", "revision_id", "block_index", "page", "bbox", "section_path", "text", "kind")
    p = ingest.paragraphs_from(b)
    ids = b.where(~F.col("kind").isin("heading", "furniture")).where(content_hash(F.col("text")) != F.sha2(F.lit(""), 256))
    from pyspark.sql import Window

    ids = ids.select("block_id", "revision_id", (F.row_number().over(Window.partitionBy("revision_id").orderBy("block_index")) - 1).alias("position"))
    return p.join(ids, ["revision_id", "position"]).select("block_id", "revision_id", F.col("position").cast("bigint").alias("position"), "block_kind")


@query(
    "running_sections",
    """
    WITH b AS (SELECT *, kind = 'heading' AND heading_level = 1 AS t, kind = 'heading' AND coalesce(heading_level, 2) > 1 AS s FROM blocks),
    k AS (SELECT *, count(*) FILTER (t) OVER (PARTITION BY revision_id ORDER BY block_index) AS book FROM b)
    SELECT block_id, last_value(CASE WHEN t THEN text END IGNORE NULLS) OVER (PARTITION BY revision_id ORDER BY block_index) AS title,
           last_value(CASE WHEN s THEN text END IGNORE NULLS) OVER (PARTITION BY revision_id, book ORDER BY block_index) AS section FROM k
    """,
)
def running_sections(spark, d):
    return ingest.running_sections(table(spark, d, "blocks", "block_id", "revision_id", "block_index", "kind", "heading_level", "text"))


@query(
    "near_duplicates",
    """
    WITH p AS (SELECT r.paper_id, p.revision_id, content_hash, length(text) AS n FROM paragraphs p JOIN revisions r USING (revision_id)),
    mine AS (SELECT DISTINCT revision_id, paper_id, content_hash FROM p WHERE n >= 80), tot AS (SELECT revision_id, count(*) AS n FROM mine GROUP BY 1),
    theirs AS (SELECT DISTINCT paper_id AS other, content_hash FROM p),
    s AS (SELECT revision_id, other, count(*) AS k FROM mine JOIN theirs USING (content_hash) WHERE paper_id <> other GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY revision_id ORDER BY k DESC, other) AS i FROM s)
    SELECT revision_id, other AS similar_paper_id, round((k::DOUBLE / n), 5) AS similarity FROM r JOIN tot USING (revision_id) WHERE i = 1
    """,
)
def near_duplicates(spark, d):
    s = ingest.shared_content(table(spark, d, "paragraphs", "revision_id", "content_hash", "text"), table(spark, d, "revisions"))
    return s.select("revision_id", "similar_paper_id", F.round(F.col("similarity").cast("double"), 5).alias("similarity"))


# two versions: the stored paragraphs, and the same with every seventh changed and every eleventh gone
@query(
    "paragraph_reconcile",
    """
    WITH n AS (SELECT revision_id, position, CASE WHEN pid % 7 = 0 THEN content_hash || 'x' ELSE content_hash END AS h FROM paragraphs WHERE pid % 11 <> 0)
    SELECT coalesce(o.revision_id, n.revision_id) AS revision_id, coalesce(o.position, n.position) AS position,
           CASE WHEN n.h IS NULL THEN 'deleted' WHEN n.h = o.content_hash THEN 'kept' ELSE 'changed' END AS status, CASE WHEN n.h = o.content_hash THEN o.pid END AS kept_pid
    FROM paragraphs o FULL JOIN n ON o.revision_id = n.revision_id AND o.position = n.position
    """,
)
def paragraph_reconcile(spark, d):
    old = table(spark, d, "paragraphs", "pid", "revision_id", "position", "content_hash", "block_label")
    new = old.where("pid % 11 <> 0").select("revision_id", "position", F.when(F.col("pid") % 7 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")).alias("content_hash"))
    r = ingest.reconcile(old, new, ["block_label"])
    return r.select("revision_id", "position", "status", F.when(F.col("status") == "kept", F.col("pid")).alias("kept_pid"))


# --- passages ----------------------------------------------------------------------------------------------------

_ISLANDS = """
    k AS (SELECT revision_id, position, section_path, length(text) AS n FROM paragraphs WHERE block_kind IS DISTINCT FROM 'reference'),
    s AS (SELECT *, CASE WHEN lag(position) OVER w = position - 1 AND lag(section_path) OVER w IS NOT DISTINCT FROM section_path THEN 0 ELSE 1 END AS b
          FROM k WINDOW w AS (PARTITION BY revision_id ORDER BY position)),
    i AS (SELECT *, sum(b) OVER (PARTITION BY revision_id ORDER BY position) AS g FROM s)
"""


@query("section_islands", f"WITH {_ISLANDS} SELECT revision_id, min(position) AS first_pos, max(position) AS last_pos, sum(n)::BIGINT AS chars FROM i GROUP BY revision_id, g")
def section_islands(spark, d):
    s = segment.sections(table(spark, d, "paragraphs", "revision_id", "position", "section_path", "block_kind", "text"))
    return s.groupBy("revision_id", F.col("island").alias("first_pos")).agg(F.max("position").alias("last_pos"), F.sum(F.length("text")).alias("chars"))


@query(
    "chunks",
    f"""
    WITH RECURSIVE {_ISLANDS},
    o AS (SELECT revision_id, g, position, n, row_number() OVER w AS x, sum(n) OVER w AS t, count(*) OVER (PARTITION BY revision_id, g) AS c FROM i WINDOW w AS (PARTITION BY revision_id, g ORDER BY position)),
    e AS (SELECT s.revision_id, s.g, s.x AS a, any_value(s.position) AS first_pos, any_value(s.c) AS c, max(z.x) AS z, max(z.t) AS tz, max(z.position) AS last_pos
          FROM o s JOIN o z ON z.revision_id = s.revision_id AND z.g = s.g AND z.x >= s.x AND (z.x = s.x OR z.t - s.t + s.n <= 24000) GROUP BY 1, 2, 3),
    f AS (SELECT e.revision_id, e.g, e.a, first_pos, last_pos, e.z, e.c, coalesce(min(y.x), e.z + 1) AS nxt
          FROM e LEFT JOIN o y ON y.revision_id = e.revision_id AND y.g = e.g AND y.x > e.a AND y.x <= e.z AND e.tz - y.t + y.n <= 4000 GROUP BY 1, 2, 3, 4, 5, 6, 7),
    cut(revision_id, g, a) AS (SELECT revision_id, g, x FROM o WHERE x = 1 UNION ALL SELECT f.revision_id, f.g, f.nxt FROM cut JOIN f ON f.revision_id = cut.revision_id AND f.g = cut.g AND f.a = cut.a WHERE f.z < f.c)
    SELECT f.revision_id, f.first_pos, f.last_pos, CASE WHEN f.z < f.c THEN o.position END AS keep_before
    FROM cut JOIN f ON f.revision_id = cut.revision_id AND f.g = cut.g AND f.a = cut.a LEFT JOIN o ON o.revision_id = f.revision_id AND o.g = f.g AND o.x = f.nxt
    """,
)
def chunks(spark, d):
    return segment.chunk_spans(table(spark, d, "paragraphs", "revision_id", "position", "section_path", "block_kind", "text"))


@query(
    "coverage_violations",
    """
    SELECT p.revision_id, p.position FROM paragraphs p WHERE coalesce(block_kind, '') NOT IN ('reference', 'footnote', 'caption') AND p.revision_id IN (SELECT revision_id FROM units)
      AND NOT EXISTS (SELECT 1 FROM units u WHERE u.revision_id = p.revision_id AND p.position BETWEEN u.first_pos AND u.last_pos)
    """,
)
def coverage_violations(spark, d):
    return segment.uncovered(table(spark, d, "paragraphs", "revision_id", "position", "block_kind"), table(spark, d, "units"))


def _replies(spark, d):
    """Stored units as replies of one chunk per 12 positions, in order of unit id."""
    u = table(spark, d, "units")
    return u.withColumn("chunk_first", (F.floor(F.col("first_pos") / 12) * 12).cast("int")).withColumn("chunk_last", F.col("chunk_first") + 14).withColumn("ord", F.col("unit_id")).withColumn("keep_before", F.col("chunk_first") + 10)


_REPLIES = "u AS (SELECT *, (first_pos // 12) * 12 AS chunk_first, (first_pos // 12) * 12 + 14 AS chunk_last, (first_pos // 12) * 12 + 10 AS keep_before FROM units)"


@query(
    "reply_errors",
    f"""
    WITH {_REPLIES}, w AS (SELECT u.*, p.text, lag(first_pos) OVER (PARTITION BY u.revision_id, chunk_first ORDER BY unit_id) AS prev,
      row_number() OVER (PARTITION BY u.revision_id, chunk_first, first_pos, last_pos, anchor_label ORDER BY unit_id) AS n
      FROM u LEFT JOIN paragraphs p ON p.revision_id = u.revision_id AND p.position = u.anchor_pos),
    e AS (SELECT revision_id, chunk_first, unit_id AS ord, CASE WHEN last_pos > chunk_last OR first_pos > last_pos THEN 'outside the chunk' WHEN first_pos < prev THEN 'out of order' WHEN n > 1 THEN 'twice'
      WHEN anchor_label IS NOT NULL AND anchor_pos NOT BETWEEN first_pos AND last_pos THEN 'anchor not in span'
      WHEN anchor_label IS NOT NULL AND (trim(anchor_label) = '' OR NOT coalesce(contains(text, anchor_label), false)) THEN 'label not in paragraph'
      WHEN anchor_label IS NOT NULL AND NOT contains(lower(anchor_label), lower(anchor_term)) THEN 'term not in label' END AS error FROM w)
    SELECT * FROM e WHERE error IS NOT NULL
    """,
)
def reply_errors(spark, d):
    return segment.reply_errors(_replies(spark, d), table(spark, d, "paragraphs", "revision_id", "position", "text")).withColumn("chunk_first", F.col("chunk_first").cast("int"))


@query(
    "merge_units",
    f"""
    WITH {_REPLIES}, r AS (SELECT *, row_number() OVER (PARTITION BY revision_id, first_pos, last_pos, anchor_label ORDER BY chunk_first, unit_id) AS n FROM u WHERE first_pos < keep_before)
    SELECT unit_id FROM r WHERE n = 1
    """,
)
def merge_units(spark, d):
    return segment.merge_replies(_replies(spark, d)).select("unit_id")


@query("quality_flags")
def quality_flags(spark, d):
    return segment.quality_flags(table(spark, d, "units"), table(spark, d, "unit_questions", "unit_id", "question"))


@query(
    "quality_flags_plain",
    """
    WITH q AS (SELECT unit_id, count(question) AS n FROM unit_questions GROUP BY 1)
    SELECT u.unit_id, trim(coalesce(gloss, '')) = '' AS gloss_empty, length(trim(coalesce(gloss, ''))) > 600 AS gloss_long, coalesce(n, 0) NOT BETWEEN 3 AND 5 AS question_count FROM units u LEFT JOIN q USING (unit_id)
    """,
)
def quality_flags_plain(spark, d):
    f = segment.quality_flags(table(spark, d, "units"), table(spark, d, "unit_questions", "unit_id", "question"))
    return f.select("unit_id", *[F.array_contains("flags", x).alias(x) for x in ("gloss_empty", "gloss_long", "question_count")])


# two versions of the units: every ninth gone, every fifth with another gloss
@query(
    "unit_diff",
    """
    WITH n AS (SELECT revision_id, first_pos, last_pos, anchor_label, CASE WHEN unit_id % 5 = 0 THEN gloss || '.' ELSE gloss END AS gloss FROM units WHERE unit_id % 9 <> 0)
    SELECT o.unit_id, CASE WHEN n.first_pos IS NULL THEN 'deleted' WHEN n.gloss IS NOT DISTINCT FROM o.gloss THEN 'kept' ELSE 'gloss_changed' END AS change
    FROM units o LEFT JOIN n ON o.revision_id = n.revision_id AND o.first_pos = n.first_pos AND o.last_pos = n.last_pos AND o.anchor_label IS NOT DISTINCT FROM n.anchor_label
    """,
)
def unit_diff(spark, d):
    old = table(spark, d, "units", "unit_id", "revision_id", "first_pos", "last_pos", "anchor_label", "gloss")
    new = old.where("unit_id % 9 <> 0").withColumn("gloss", F.when(F.col("unit_id") % 5 == 0, F.concat("gloss", F.lit("."))).otherwise(F.col("gloss")))
    return segment.unit_changes(old, new).select("unit_id", "change")


@query("block_labels", "SELECT p.pid, l.label FROM paragraphs p LEFT JOIN (SELECT revision_id, anchor_pos, arg_max(anchor_label, unit_id) AS label FROM units WHERE anchor_pos IS NOT NULL GROUP BY 1, 2) l ON l.revision_id = p.revision_id AND l.anchor_pos = p.position")
def block_labels(spark, d):
    return segment.block_labels(table(spark, d, "paragraphs", "pid", "revision_id", "position"), table(spark, d, "units"))


@query(
    "fill_missing_vectors",
    """
    SELECT p.pid FROM paragraphs p WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.set_name = 'primary' AND v.target = 'paragraph' AND v.owner_id = p.pid AND v.emb IS NOT NULL AND len(v.emb) = 64
      AND len(list_filter(v.emb, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(v.emb, lambda x: x <> 0)) > 0)
    """,
)
def fill_missing_vectors(spark, d):
    return segment.missing_vectors(table(spark, d, "paragraphs", "pid"), "pid", table(spark, d, "vectors", "set_name", "target", "owner_id", "emb"), "primary", "paragraph")


# --- reports -----------------------------------------------------------------------------------------------------


@query(
    "stratified_sample",
    "WITH s AS (SELECT unit_id, coalesce(anchor_kind, 'plain') AS stratum, row_number() OVER (PARTITION BY coalesce(anchor_kind, 'plain') ORDER BY sha256(unit_id::VARCHAR), unit_id) AS ord FROM units) SELECT stratum, unit_id, ord FROM s WHERE ord <= 14",
)
def stratified_sample(spark, d):
    u = table(spark, d, "units", "unit_id", "anchor_kind").select("unit_id", F.coalesce("anchor_kind", F.lit("plain")).alias("stratum"))
    return reports.stratified_sample(u, "stratum", "unit_id").select("stratum", "unit_id", F.col("ord").cast("bigint").alias("ord"))


def _graded(spark, d):
    g = table(spark, d, "reading_labels", "doc_id", "rater", "grade").where("grade IS NOT NULL")
    one = g.groupBy("doc_id", "rater").agg(F.min("grade").alias("grade"))
    return one


@query(
    "report_by_group",
    """
    SELECT d.source, count(*) AS n, round(avg(l.grade), 6) AS mean_grade, count(*) FILTER (l.grade >= 4) AS demanding, round(100.0::DOUBLE * count(*) FILTER (l.grade >= 4) / count(*), 4) AS share
    FROM reading_labels l JOIN documents d USING (doc_id) WHERE l.grade IS NOT NULL GROUP BY ROLLUP (d.source)
    """,
)
def report_by_group(spark, d):
    j = table(spark, d, "reading_labels", "doc_id", "grade").where("grade IS NOT NULL").join(table(spark, d, "documents", "doc_id", "source"), "doc_id")
    many = F.count_if(F.col("grade") >= 4)
    return j.rollup("source").agg(F.count("*").alias("n"), F.round(F.avg("grade"), 6).alias("mean_grade"), many.alias("demanding"), F.round(100.0 * many / F.count("*"), 4).alias("share"))


@query(
    "corpus_status",
    """
    SELECT s.stage, count(r.revision_id) AS n, coalesce(sum(r.is_current::INT), 0)::BIGINT AS current
    FROM (VALUES ('parse'), ('segment'), ('embed'), ('ready'), ('failed')) s(stage) LEFT JOIN revisions r ON r.stage = s.stage GROUP BY 1
    """,
)
def corpus_status(spark, d):
    return reports.status_counts(table(spark, d, "revisions", "stage", "is_current"), spark)


@query(
    "latest_revision",
    """
    WITH l AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY revision DESC) AS n FROM revisions)
    SELECT p.paper_id, p.name, l.revision_id, l.revision, l.stage, s.name AS similar_name FROM papers p JOIN l ON l.paper_id = p.paper_id AND n = 1 LEFT JOIN papers s ON s.paper_id = l.similar_paper_id AND l.similarity >= 0.5::FLOAT
    """,
)
def latest_revision(spark, d):
    return reports.latest_revisions(table(spark, d, "papers"), table(spark, d, "revisions"))


@query("newest_ready_antijoin", "SELECT revision_id, paper_id FROM revisions r WHERE stage = 'ready' AND NOT EXISTS (SELECT 1 FROM revisions n WHERE n.paper_id = r.paper_id AND n.stage = 'ready' AND n.revision > r.revision)")
def newest_ready_antijoin(spark, d):
    return reports.newest_ready(table(spark, d, "revisions", "paper_id", "revision_id", "revision", "stage"))


# --- streams -----------------------------------------------------------------------------------------------------


@query("outbox_cursor", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def outbox_cursor(spark, d):
    """The events table read as a stream through a cursor, then counted."""
    from lectern.streaming.outbox import collected

    work = temporary(f"{shared_dir(spark)}/lectern-outbox-{uuid.uuid4().hex}", spark)
    schema = table(spark, d, "events").schema
    events = collected(spark, f"{d}/events.parquet*", schema, f"{work}/cursor", f"{work}/events")
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "document_titles",
    "WITH f AS (SELECT revision_id, arg_min(text, block_index) AS t FROM blocks WHERE kind = 'heading' GROUP BY 1), l AS (SELECT paper_id, arg_max(t, revision) AS t FROM f JOIN revisions USING (revision_id) GROUP BY 1) SELECT p.paper_id, coalesce(p.title, l.t) AS title FROM papers p LEFT JOIN l USING (paper_id)",
)
def document_titles(spark, d):
    return ingest.fill_titles(table(spark, d, "papers", "paper_id", "title"), table(spark, d, "revisions", "revision_id", "paper_id", "revision"), table(spark, d, "blocks", "revision_id", "block_index", "kind", "text"))


@query(
    "formula_report",
    r"""
    WITH m AS (SELECT revision_id, block_kind, len(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(text, '`+[^`]*`+', ' ', 'g'), '\\\$', ' ', 'g'), '\$\$[^$]+\$\$', '$x$', 'g'), '\$[^$]+\$')) AS n FROM paragraphs)
    SELECT revision_id, sum(n)::BIGINT AS formulas, count(*) FILTER (block_kind = 'equation' AND n = 0) AS undelimited FROM m GROUP BY 1
    """,
)
def formula_report(spark, d):
    return reports.formula_counts(table(spark, d, "paragraphs", "revision_id", "block_kind", "text"), "revision_id")


@query(
    "score_disagreements_of_all_raters",
    """
    WITH g AS (SELECT doc_id, rater, min(grade) AS grade FROM reading_labels WHERE grade IS NOT NULL AND rater IS NOT NULL GROUP BY 1, 2)
    SELECT a.doc_id, a.rater AS first_rater, b.rater AS second_rater, a.grade AS first, b.grade AS second FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.rater < b.rater WHERE a.grade <> b.grade
    """,
)
def score_disagreements_of_all_raters(spark, d):
    return reports.disagreements_of_all(_graded(spark, d), ["doc_id"], "rater", "grade")


@query(
    "final_scores_of_all_raters",
    """
    WITH g AS (SELECT doc_id, rater, min(grade) AS grade FROM reading_labels WHERE grade IS NOT NULL AND rater IS NOT NULL GROUP BY 1, 2)
    SELECT doc_id, arg_max(grade, rater) AS grade FROM g GROUP BY 1
    """,
)
def final_scores_of_all_raters(spark, d):
    return reports.overridden_by_all(_graded(spark, d), ["doc_id"], "rater", "grade")


@query(
    "scores_by_source_and_every_rater",
    """
    SELECT d.source, l.rater, round(avg(grade), 6) AS mean FROM reading_labels l JOIN documents d USING (doc_id)
    WHERE grade IS NOT NULL GROUP BY GROUPING SETS ((d.source, l.rater), (l.rater))
    """,
)
def scores_by_source_and_every_rater(spark, d):
    j = table(spark, d, "reading_labels", "doc_id", "rater", "grade").where("grade IS NOT NULL").join(table(spark, d, "documents", "doc_id", "source"), "doc_id")
    return reports.means_by_column(j, "source", "rater", "grade")


_FLAGS = r"""
    q AS (SELECT unit_id, count(question) AS n FROM unit_questions GROUP BY 1),
    g AS (SELECT u.*, trim(coalesce(gloss, '')) AS g, coalesce(q.n, 0) AS n FROM units u LEFT JOIN q USING (unit_id))
"""


@query(
    "flag_histogram_plain",
    f"""
    WITH {_FLAGS} SELECT * FROM (SELECT 'gloss_empty' AS flag, count(*) AS n FROM g WHERE g = '' UNION ALL SELECT 'gloss_long', count(*) FROM g WHERE length(g) > 600
    UNION ALL SELECT 'question_count', count(*) FROM g WHERE n NOT BETWEEN 3 AND 5) WHERE n > 0
    """,
)
def flag_histogram_plain(spark, d):
    """Of the flags that SQL can say."""
    return reports.flag_counts(quality_flags(spark, d)).where(F.col("flag").isin("gloss_empty", "gloss_long", "question_count"))


@query("flag_histogram")
def flag_histogram(spark, d):
    return reports.flag_counts(quality_flags(spark, d))


# --- glossing ----------------------------------------------------------------------------------------------------


def _text_rows(spark, d):
    return table(spark, d, "paragraphs", "revision_id", "position", "section_path", "block_kind", "content_hash", "text")


def _titles(spark, d):
    r = table(spark, d, "revisions", "revision_id", "paper_id").join(table(spark, d, "papers", "paper_id", "title"), "paper_id")
    return r.select("revision_id", "title")


@query(
    "chunk_requests",
    SQL["chunks"].replace("SELECT f.revision_id, f.first_pos, f.last_pos, CASE", ", spans AS (SELECT f.revision_id, f.first_pos, f.last_pos, CASE") + """)
    SELECT s.revision_id, first_pos AS chunk_first, last_pos AS chunk_last, count(*) AS paragraphs, sum(length(text))::BIGINT AS chars, count(block_kind) AS kinds
    FROM spans s JOIN paragraphs p ON p.revision_id = s.revision_id AND position BETWEEN first_pos AND last_pos GROUP BY 1, 2, 3
    """,
)
def chunk_requests(spark, d):
    """The requests of all chunks, read back."""
    r = glossing.chunk_requests(_text_rows(spark, d), _titles(spark, d), "v1", "scripted")
    r = r.withColumn("p", F.from_json("request", "struct<paragraphs:array<struct<pos:int,text:string,kind:string>>>")["paragraphs"])
    chars = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["text"]))
    return r.select("revision_id", "chunk_first", "chunk_last", F.size("p").cast("bigint").alias("paragraphs"), chars.alias("chars"), F.size(F.filter("p", lambda x: x["kind"].isNotNull())).cast("bigint").alias("kinds"))


@query(
    "segment_stage",
    """
    SELECT revision_id, position AS first_pos, position AS last_pos, array_to_string(list_filter(string_split_regex(trim(text, E' \\t\\n\\r'), '\\s+'), lambda x: x <> '')[1:12], ' ') AS gloss, 'scripted' AS gloss_model
    FROM paragraphs WHERE block_kind IS DISTINCT FROM 'reference'
    """,
)
def segment_stage(spark, d):
    """Every chunk of the corpus through requests, a scripted model, checks, merging and provenance."""
    none = spark.createDataFrame([], "revision_id long, input_hash string, gloss_model string, reply string")
    done = glossing.gloss(_text_rows(spark, d), _titles(spark, d), none, ports.OnePerParagraphInBatches, "v1", "scripted")
    return done.units.select("revision_id", "first_pos", "last_pos", "gloss", "gloss_model")


# the next version of the units: every ninth is gone, every fifth has another gloss, every fourth other questions
_NEXT = """
    n AS (SELECT * REPLACE (CASE WHEN unit_id % 5 = 0 THEN gloss || '.' ELSE gloss END AS gloss) FROM units WHERE unit_id % 9 <> 0),
    nq AS (SELECT unit_id, list(question ORDER BY question_id) FILTER (question IS NOT NULL) AS qs FROM unit_questions WHERE unit_id IN (SELECT unit_id FROM n) GROUP BY 1)
"""


def _next_units(spark, d):
    old = table(spark, d, "units")
    new = old.where("unit_id % 9 <> 0").withColumn("gloss", F.when(F.col("unit_id") % 5 == 0, F.concat("gloss", F.lit("."))).otherwise(F.col("gloss")))
    return old, glossing.next_units(old, new)


def _next_questions(spark, d):
    q, (_, units) = table(spark, d, "unit_questions"), _next_units(spark, d)
    had = q.groupBy("unit_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("question_id", "question"))), lambda x: x["question"]).alias("questions"))
    told = units.select("unit_id").join(had, "unit_id").withColumn("questions", F.when(F.col("unit_id") % 4 == 0, F.reverse("questions")).otherwise(F.col("questions")))
    return glossing.next_questions(q, told)


@query("unit_snapshot", f"WITH {_NEXT} SELECT n.unit_id, CASE WHEN n.gloss IS NOT DISTINCT FROM u.gloss THEN 'kept' ELSE 'gloss_changed' END AS change, n.gloss FROM n JOIN units u USING (unit_id)")
def unit_snapshot(spark, d):
    return _next_units(spark, d)[1].select("unit_id", "change", "gloss")


@query("unit_events", "SELECT unit_id, revision_id, first_pos, last_pos, anchor_label, 'deleted' AS change FROM units WHERE unit_id % 9 = 0")
def unit_events(spark, d):
    return glossing.unit_events(*_next_units(spark, d))


_KEPT_QUESTIONS = "kq AS (SELECT q.*, nq.unit_id % 4 <> 0 OR nq.qs = list_reverse(nq.qs) AS kept FROM unit_questions q JOIN nq USING (unit_id))"


@query("question_snapshot", f"WITH {_NEXT}, {_KEPT_QUESTIONS} SELECT unit_id, question, kept, count(*) AS n FROM kq GROUP BY ALL")
def question_snapshot(spark, d):
    return _next_questions(spark, d).groupBy("unit_id", "question", "kept").agg(F.count("*").alias("n"))


@query(
    "vector_snapshot",
    f"""
    WITH {_NEXT}, {_KEPT_QUESTIONS}
    SELECT vector_id FROM vectors v WHERE target NOT IN ('gloss', 'question') OR (target = 'gloss' AND owner_id IN (SELECT unit_id FROM n WHERE unit_id % 5 <> 0)) OR (target = 'question' AND owner_id IN (SELECT question_id FROM kq WHERE kept))
    """,
)
def vector_snapshot(spark, d):
    """Vectors that still hold after glosses and questions have changed, in both sets."""
    return glossing.next_vectors(table(spark, d, "vectors"), _next_units(spark, d)[1], _next_questions(spark, d)).select("vector_id")


@query(
    "vectors_filled",
    """
    WITH u AS (SELECT *, emb IS NOT NULL AND len(emb) > 0 AND len(list_filter(emb, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(emb, lambda x: x <> 0)) > 0 AS ok FROM vectors),
    h AS (SELECT DISTINCT owner_id FROM u WHERE set_name = 'alt' AND target = 'gloss' AND ok)
    SELECT v.set_name, v.target, count(*) AS n FROM (SELECT set_name, target FROM u WHERE NOT (set_name = 'alt' AND target = 'gloss' AND NOT ok AND owner_id IN (SELECT unit_id FROM units) AND owner_id NOT IN (SELECT owner_id FROM h))
    UNION ALL SELECT 'alt', 'gloss' FROM units WHERE unit_id NOT IN (SELECT owner_id FROM h)) v GROUP BY 1, 2
    """,
)
def vectors_filled(spark, d):
    """The alternate set after an embedding run over glosses that had no vector in it."""
    v, u = table(spark, d, "vectors"), table(spark, d, "units", "unit_id", "gloss")
    todo = segment.missing_vectors(u, "unit_id", v, "alt", "gloss").join(u.select("unit_id", F.coalesce("gloss", F.lit("")).alias("gloss")), "unit_id")
    made = ports.embed(todo, "unit_id", "gloss", ports.SeededEmbedder(64)).withColumnRenamed("unit_id", "owner_id")
    return glossing.filled_vectors(v, made, "alt", "gloss", "seeded").groupBy("set_name", "target").agg(F.count("*").alias("n"))


@query(
    "vectors_cleared",
    """
    WITH r AS (SELECT revision_id FROM revisions WHERE stage = 'ready' AND revision % 2 = 1), u AS (SELECT unit_id FROM units JOIN r USING (revision_id))
    SELECT set_name, target, count(emb) AS n FROM vectors WHERE NOT ((target = 'paragraph' AND owner_id IN (SELECT pid FROM paragraphs JOIN r USING (revision_id))) OR (target = 'gloss' AND owner_id IN (SELECT unit_id FROM u))
      OR (target = 'question' AND owner_id IN (SELECT question_id FROM unit_questions JOIN u USING (unit_id)))) GROUP BY 1, 2
    """,
)
def vectors_cleared(spark, d):
    """What is left of the vectors after the ready first, third ... revisions are cleared."""
    rev = table(spark, d, "revisions", "revision_id", "stage", "revision").where("stage = 'ready' AND revision % 2 = 1")
    left = glossing.cleared_vectors(table(spark, d, "vectors"), rev, table(spark, d, "paragraphs", "pid", "revision_id"), table(spark, d, "units", "unit_id", "revision_id"), table(spark, d, "unit_questions", "question_id", "unit_id"))
    return glossing.vectors_left(left)


@query("replies_purged", "SELECT DISTINCT u.revision_id, u.input_hash FROM units u WHERE EXISTS (SELECT 1 FROM units v WHERE v.revision_id = u.revision_id AND v.input_hash = u.input_hash AND v.first_pos % 3 = 0)")
def replies_purged(spark, d):
    """Stored replies (one per input hash of the units) whose chunk is still there: that of a unit at every third position."""
    u = table(spark, d, "units", "revision_id", "input_hash", "first_pos")
    stored = u.select("revision_id", "input_hash").distinct()
    return glossing.purged_replies(stored, u.where("first_pos % 3 = 0"))


# --- more tools and reports --------------------------------------------------------------------------------------


@query("document_counts", "SELECT r.paper_id, pa.name, max(position) + 1 AS paragraphs FROM paragraphs p JOIN revisions r USING (revision_id) JOIN papers pa USING (paper_id) WHERE is_current AND stage = 'ready' GROUP BY 1, 2")
def document_counts(spark, d):
    return lookup.document_counts(table(spark, d, "paragraphs", "revision_id", "position"), table(spark, d, "revisions"), table(spark, d, "papers"))


@query(
    "opened_units",
    """
    SELECT unit_id, pid, position, page + 1 AS page FROM units u JOIN revisions r USING (revision_id) JOIN paragraphs p ON p.revision_id = u.revision_id AND position BETWEEN first_pos AND least(last_pos, first_pos + 19)
    WHERE is_current AND stage = 'ready'
    """,
)
def opened_units(spark, d):
    return lookup.opened_units(table(spark, d, "units"), table(spark, d, "revisions"), table(spark, d, "paragraphs", "revision_id", "position", "pid", "page"))


# sessions: each client's deliveries as calls by hour, each delivered paragraph as returned
_CALLS = "c AS (SELECT client AS session, date_diff('hour', TIMESTAMPTZ '2024-01-01 00:00:00+00', date_trunc('hour', arrived_at)) AS call, revision_id * 1000000 + position AS pid FROM import_rows WHERE client IS NOT NULL AND arrived_at IS NOT NULL)"


def _calls(spark, d):
    rows = table(spark, d, "import_rows", "client", "arrived_at", "revision_id", "position").where("client IS NOT NULL AND arrived_at IS NOT NULL")
    hour = F.floor((F.unix_seconds("arrived_at") - F.unix_seconds(F.lit("2024-01-01 00:00:00+00:00").cast("timestamp"))) / 3600)
    return rows.select(F.col("client").alias("session"), hour.alias("call"), (F.col("revision_id") * 1000000 + F.col("position")).alias("pid"))


@query("session_accounting", f"WITH {_CALLS}, f AS (SELECT session, pid, min(call) AS call FROM c GROUP BY 1, 2), n AS (SELECT session, call, count(*) AS new FROM f GROUP BY 1, 2) SELECT DISTINCT c.session, c.call, coalesce(new, 0) AS new FROM c LEFT JOIN n USING (session, call)")
def session_accounting(spark, d):
    """How many paragraphs each call of a session returned that the session had not seen."""
    return lookup.new_in_session(_calls(spark, d))


@query("session_retrieved", f"WITH {_CALLS} SELECT DISTINCT pid FROM c")
def session_retrieved(spark, d):
    c = _calls(spark, d)
    return lookup.retrieved(c.where("call % 2 = 0"), c.where("call % 2 <> 0"))


@query("html_safe", "SELECT pid, replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;'), chr(10), '<br>') AS html FROM paragraphs")
def html_safe(spark, d):
    return table(spark, d, "paragraphs", "pid", "text").select("pid", lookup.html_safe(F.col("text")).alias("html"))


@query("documents_newest_first", "SELECT paper_id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, name, paper_id) AS ord FROM papers")
def documents_newest_first(spark, d):
    return reports.newest_first(table(spark, d, "papers", "paper_id", "name", "created_at")).select("paper_id", F.col("ord").cast("bigint").alias("ord"))


@query("stored_files", "SELECT r.pdf_sha256, r.paper_id, name, revision_id, revision, stage FROM revisions r JOIN papers USING (paper_id) WHERE revision_id % 3 = 0")
def stored_files(spark, d):
    """What is stored of some known hashes and of unknown ones."""
    r = table(spark, d, "revisions")
    asked = r.select(F.when(F.col("revision_id") % 3 == 0, F.col("pdf_sha256")).otherwise(F.concat(F.lit("unknown"), "pdf_sha256")).alias("pdf_sha256"))
    return ingest.stored_files(asked, r, table(spark, d, "papers"))


@query("imported_files", "SELECT count(*) AS papers, count(DISTINCT h) AS revisions, count(*) FILTER (name = 'untitled') AS untitled FROM (SELECT sha256(coalesce(text, '')) AS h, coalesce(nullif(trim((list(title ORDER BY doc_id))[1]), ''), 'untitled') AS name FROM documents GROUP BY 1)")
def imported_files(spark, d):
    """The documents as files: each distinct text becomes a paper with its first revision."""
    f = table(spark, d, "documents", "doc_id", "text", "title").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), "title")
    f = f.groupBy("sha256").agg(F.min_by("title", "doc_id").alias("name"))
    papers, revisions = ingest.new_papers(f, "2024-01-01 00:00:00")
    both = papers.join(revisions.select("paper_id", "pdf_sha256"), "paper_id")
    return both.agg(F.countDistinct("paper_id").alias("papers"), F.countDistinct("pdf_sha256").alias("revisions"), F.count_if(F.col("name") == "untitled").alias("untitled"))


@query("strata_counts", "SELECT coalesce(anchor_kind, 'plain') AS stratum, count(*) AS n FROM units GROUP BY 1")
def strata_counts(spark, d):
    return reports.strata_counts(table(spark, d, "units", "anchor_kind").select(F.coalesce("anchor_kind", F.lit("plain")).alias("stratum")), "stratum")


@query("chosen_items", "WITH s AS (SELECT DISTINCT revision_id, first_pos, last_pos, anchor_label FROM units WHERE unit_id % 10 = 0) SELECT unit_id FROM units u WHERE EXISTS (SELECT 1 FROM s WHERE s.revision_id = u.revision_id AND s.first_pos = u.first_pos AND s.last_pos = u.last_pos AND s.anchor_label IS NOT DISTINCT FROM u.anchor_label)")
def chosen_items(spark, d):
    """Units that a sample names by its keys (every tenth unit's)."""
    u = table(spark, d, "units", "unit_id", *segment.SAME_KEY)
    return reports.chosen_items(u, u.where("unit_id % 10 = 0").drop("unit_id"), segment.SAME_KEY).select("unit_id")


@query(
    "items_that_differ",
    "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM reading_labels WHERE grade IS NOT NULL AND rater IS NOT NULL GROUP BY 1 HAVING min(grade) <> max(grade))",
)
def items_that_differ(spark, d):
    """Documents that raters disagree about."""
    g = table(spark, d, "reading_labels", "doc_id", "rater", "grade").where("grade IS NOT NULL AND rater IS NOT NULL")
    differ = g.groupBy("doc_id").agg(F.min("grade").alias("lo"), F.max("grade").alias("hi")).where("lo <> hi")
    return reports.items_that_differ(table(spark, d, "documents", "doc_id"), differ, ["doc_id"])


@query("unjudged_items", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id NOT IN (SELECT doc_id FROM reading_labels WHERE doc_id IS NOT NULL)")
def unjudged_items(spark, d):
    items = table(spark, d, "documents", "doc_id", "lang").where("lang = 'en'").select("doc_id")
    return items.join(table(spark, d, "reading_labels", "doc_id"), "doc_id", "left_anti")


@query(
    "unit_items",
    """
    SELECT unit_id, count(*) AS paragraphs, string_agg(DISTINCT coalesce(block_kind, 'text'), ',' ORDER BY coalesce(block_kind, 'text')) AS kinds, count(DISTINCT page) AS pages, min(page) AS first_page
    FROM units u JOIN paragraphs p ON p.revision_id = u.revision_id AND position BETWEEN first_pos AND last_pos GROUP BY 1
    """,
)
def unit_items(spark, d):
    i = reports.unit_items(table(spark, d, "units", "unit_id", "revision_id", "first_pos", "last_pos"), table(spark, d, "paragraphs", "revision_id", "position", "page", "block_kind", "html", "text"))
    return i.select("unit_id", F.size("paragraphs").cast("bigint").alias("paragraphs"), F.array_join("kinds", ",").alias("kinds"), F.size("pages").cast("bigint").alias("pages"), F.array_min("pages").alias("first_page"))


@query("page_items", "SELECT revision_id, page, count(*) FILTER (kind IS DISTINCT FROM 'furniture') AS blocks, coalesce(sum(length(text)) FILTER (kind IS DISTINCT FROM 'furniture'), 0)::BIGINT AS chars FROM blocks WHERE page IS NOT NULL GROUP BY 1, 2")
def page_items(spark, d):
    i = reports.page_items(table(spark, d, "blocks", "revision_id", "page", "block_index", "kind", "text"))
    chars = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda a, b: a + F.coalesce(F.length(b["text"]), F.lit(0)))
    return i.select("revision_id", "page", F.size("blocks").cast("bigint").alias("blocks"), chars.alias("chars"))


# judgements of units, made of their ids: verdict, boundaries and whether the text was readable
_JUDGED = """
    j AS (SELECT coalesce(anchor_kind, 'plain') AS stratum, ['faithful', 'faithful', 'overstated', 'wrong', 'unclear', NULL][unit_id % 6 + 1] AS verdict, ['sensible', 'too_narrow', 'too_broad', 'not_sensible', NULL][unit_id % 5 + 1] AS boundaries,
                 CASE WHEN unit_id % 7 = 0 THEN 'garbled' ELSE 'readable' END AS source FROM units)
"""


def _judged(spark, d):
    pick = lambda values, n: F.array(*[F.lit(v) for v in values])[(F.col("unit_id") % n).cast("int")]
    u = table(spark, d, "units", "unit_id", "anchor_kind")
    return u.select(
        F.coalesce("anchor_kind", F.lit("plain")).alias("stratum"), pick(["faithful", "faithful", "overstated", "wrong", "unclear", None], 6).alias("verdict"), pick([*reports.BOUNDARIES, None], 5).alias("boundaries"),
        F.when(F.col("unit_id") % 7 == 0, "garbled").otherwise("readable").alias("source"),
    )


@query(
    "gloss_report",
    f"""
    WITH {_JUDGED}, r AS (SELECT * FROM j WHERE verdict IS NOT NULL)
    SELECT count(*) AS reviewed, count(*) FILTER (verdict = 'faithful') AS faithful, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (source = 'readable') AS readable,
           count(*) FILTER (source = 'readable' AND verdict = 'faithful') AS readable_faithful, count(*) FILTER (verdict = 'wrong' AND stratum IN ('theorem', 'definition')) AS wrong_formal, count(*) FILTER (boundaries IS NOT NULL) AS bounded,
           round(count(*) FILTER (verdict = 'faithful') / count(*)::DOUBLE, 6) AS faithful_share, count(*) FILTER (source = 'readable' AND verdict = 'faithful') >= 0.9 * count(*) FILTER (source = 'readable') AND count(*) FILTER (verdict = 'wrong' AND stratum IN ('theorem', 'definition')) = 0 AS frozen
    FROM r
    """,
)
def gloss_report(spark, d):
    r = reports.gloss_report(_judged(spark, d))
    return r.select("reviewed", "faithful", "wrong", "readable", "readable_faithful", "wrong_formal", "bounded", F.round("faithful_share", 6).alias("faithful_share"), "frozen")


@query("verdicts_by_stratum", f"WITH {_JUDGED} SELECT stratum, count(*) AS reviewed, count(*) FILTER (verdict = 'faithful') AS faithful, count(*) FILTER (verdict = 'overstated') AS overstated, count(*) FILTER (verdict = 'wrong') AS wrong, count(*) FILTER (verdict = 'unclear') AS unclear FROM j WHERE verdict IS NOT NULL GROUP BY 1")
def verdicts_by_stratum(spark, d):
    return reports.verdicts_by_stratum(_judged(spark, d))


_SCORED = """
    s AS (SELECT d.source, l.rater, l.grade AS score FROM reading_labels l JOIN documents d USING (doc_id) WHERE l.grade IS NOT NULL AND l.rater IS NOT NULL AND d.source IS NOT NULL),
    f AS (SELECT DISTINCT d.doc_id, d.source, l.rater, d.n_chars FROM reading_labels l JOIN documents d USING (doc_id) WHERE l.grade IS NOT NULL AND l.rater IS NOT NULL AND d.source IS NOT NULL)
"""


@query(
    "score_report",
    f"""
    WITH {_SCORED}, e AS (SELECT source, rater, avg(score) AS mean, count(*) AS n FROM s GROUP BY 1, 2), m AS (SELECT source, min(n) AS scored FROM e GROUP BY 1),
    c AS (SELECT source, rater, count(*) AS formulas, count(*) FILTER (n_chars % 5 = 0) AS failed FROM f GROUP BY 1, 2), t AS (SELECT rater, sum(formulas)::BIGINT AS formulas, sum(failed)::BIGINT AS failed FROM c GROUP BY 1)
    SELECT e.source, e.rater, round(mean, 6) AS mean, scored, formulas, failed, round(failed / formulas::DOUBLE, 6) AS failed_share FROM e JOIN m USING (source) LEFT JOIN c ON c.source = e.source AND c.rater = e.rater
    UNION ALL SELECT NULL, a.rater, round(a.mean, 6), (SELECT sum(scored)::BIGINT FROM m), formulas, failed, round(failed / formulas::DOUBLE, 6) FROM (SELECT rater, avg(score) AS mean FROM s GROUP BY 1) a LEFT JOIN t USING (rater)
    """,
)
def score_report(spark, d):
    """Mean grade, least number of grades, and totals with their failing share, by source and rater, with rows for all."""
    docs = table(spark, d, "documents", "doc_id", "source", "n_chars").where("source IS NOT NULL")
    j = table(spark, d, "reading_labels", "doc_id", "rater", "grade").where("grade IS NOT NULL AND rater IS NOT NULL").join(docs, "doc_id")
    once = j.select("doc_id", "source", "rater", "n_chars").distinct()
    counted = once.select("source", "rater", F.lit(1).cast("bigint").alias("formulas"), F.coalesce((F.col("n_chars") % 5 == 0).cast("bigint"), F.lit(0)).alias("failed"))
    return reports.score_report(j.select("source", "rater", F.col("grade").alias("score")), counted, "source", "rater")
