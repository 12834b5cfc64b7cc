"""The pN_ queries of the subpackage: name -> callable(spark, sf_dir), and SQL where SQL gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.llm.copies import expand, near_copies
from lectern.llm.leaks import find_leaks
from lectern.llm.markup import clean_texts, find_markup
from lectern.llm.neighbours import nearest
from lectern.llm.pieces import chunks
from lectern.llm.reading import reading_levels
from lectern.llm.scans import find_noise, paragraphs_of
from lectern.llm.tokens import encode_corpus
from lectern.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p7_ids")
def p7_ids(spark, d):
    return encode_corpus(table(spark, d, "documents", "doc_id", "text"))


#: From this calibrated grade on a text counts as one of grade 4 or 5.
DEMANDING = 3.5


def _labels(spark, d):
    return table(spark, d, "reading_labels", "doc_id", "grade")


@query("p9_found")
def p9_found(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "lang", "source")
    levels = reading_levels(docs, _labels(spark, d), only=F.col("lang") == "en")
    return levels.where(F.col("level") >= DEMANDING).select("doc_id")


@query("p9_levels")
def p9_levels(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "lang", "source")
    return reading_levels(docs, _labels(spark, d)).select("doc_id", F.round("level", 2).alias("level"))


@query(
    "p8_found",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
    dg AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
    ig AS (SELECT item_id, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12))
    SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)
    """,
)
def p8_found(spark, d):
    return p8_leaks(spark, d).select("doc_id", "item_id")


@query(
    "p8_leaks",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w, len(regexp_extract_all(regexp_extract(rtrim(text), '(?s)^.*[.!?。！？]+\s'), '[\p{L}\p{N}]+')) AS q FROM eval_items WHERE text IS NOT NULL),
    dg AS (SELECT doc_id, k, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d WHERE len(w) >= 12)),
    ig AS (SELECT item_id, k, array_to_string(w[k : k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE len(w) >= 12)),
    m AS (SELECT DISTINCT doc_id, item_id, dg.k AS a, ig.k AS p FROM dg JOIN ig USING (g)),
    r AS (SELECT doc_id, item_id, a - p AS off, p - row_number() OVER (PARTITION BY doc_id, item_id, a - p ORDER BY p) AS run FROM m),
    l AS (SELECT doc_id, item_id, max(n) + 11 AS longest_run FROM (SELECT doc_id, item_id, off, run, count(*) AS n FROM r GROUP BY ALL) GROUP BY 1, 2),
    c AS (SELECT DISTINCT doc_id, item_id, unnest(range(p, p + 12)) AS c FROM m),
    s AS (SELECT doc_id, item_id, count(*) AS n, count(*) FILTER (c > q) AS asked, any_value(len(w)) AS whole, any_value(q) AS q FROM c JOIN i USING (item_id) GROUP BY 1, 2)
    SELECT doc_id, item_id, longest_run::INT AS longest_run, round(n / whole::DOUBLE, 6) AS item_share, CASE WHEN whole > q THEN round(asked / (whole - q)::DOUBLE, 6) ELSE 0 END AS question_share FROM s JOIN l USING (doc_id, item_id)
    """,
)
def p8_leaks(spark, d):
    found = find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))
    return found.withColumns({c: F.round(c, 6) for c in ("item_share", "question_share")})


_USABLE = """
    v AS (SELECT vector_id, set_name, target, list_transform(emb, lambda x: x::DOUBLE) AS e FROM vectors
          WHERE emb IS NOT NULL AND len(emb) = 64 AND len(list_filter(emb, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(emb, lambda x: x <> 0)) > 0)
"""


@query(
    "p6_found",
    f"""
    WITH {_USABLE},
    p AS (SELECT a.vector_id AS a, b.vector_id AS b, round(list_cosine_similarity(a.e, b.e), 12) AS s
          FROM v a JOIN v b ON a.set_name = b.set_name AND a.target = b.target AND a.vector_id <> b.vector_id),
    r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM p)
    SELECT DISTINCT least(a, b) AS vector_id_a, greatest(a, b) AS vector_id_b FROM r WHERE n <= 5 AND s >= 0.85
    """,
)
def p6_found(spark, d):
    lists = nearest(table(spark, d, "vectors", "vector_id", "set_name", "target", "emb"), k=5, least=0.85)
    pair = lists.select(F.least("id", "other").alias("vector_id_a"), F.greatest("id", "other").alias("vector_id_b"))
    return pair.distinct()


@query(
    "p6_nearest",
    f"""
    WITH {_USABLE},
    p AS (SELECT a.vector_id AS a, b.vector_id AS b, round(list_cosine_similarity(a.e, b.e), 12) AS s
          FROM v a JOIN v b ON a.set_name = b.set_name AND a.target = b.target AND a.vector_id <> b.vector_id WHERE a.vector_id % 100 = 0),
    r AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM p)
    SELECT a AS vector_id, b AS neighbour_id, round(s, 6) AS cosine, n AS rank FROM r WHERE n <= 10
    """,
)
def p6_nearest(spark, d):
    vectors = table(spark, d, "vectors", "vector_id", "set_name", "target", "emb")
    lists = nearest(vectors, k=10, margin=0.35, queries=F.col("id") % 100 == 0)
    return lists.select(F.col("id").alias("vector_id"), F.col("other").alias("neighbour_id"), F.round("similarity", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


@query(
    "p4_found",
    r"""
    WITH s AS (SELECT pid, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM paragraphs WHERE length(text) >= 80),
    u AS (SELECT pid, len(w) AS n, unnest(w) AS w FROM s),
    c AS (SELECT a.pid AS pid_a, b.pid AS pid_b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
          FROM u a JOIN u b ON a.w = b.w AND a.pid < b.pid GROUP BY 1, 2)
    SELECT pid_a, pid_b FROM c WHERE k * 10 >= 7 * (na + nb - k)
    """,
)
def p4_found(spark, d):
    links, members = near_copies(table(spark, d, "paragraphs", "pid", "text"), "pid", "text", 0.7)
    return expand(links, members).select(F.col("a").alias("pid_a"), F.col("b").alias("pid_b"))


@query(
    "p4_classes",
    r"""
    WITH s AS (SELECT pid, list_sort(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))) AS w FROM paragraphs WHERE length(text) >= 80),
    m AS (SELECT pid, min(pid) OVER (PARTITION BY w) AS rep, w FROM s WHERE len(w) > 0),
    u AS (SELECT pid, len(w) AS n, unnest(w) AS w FROM m WHERE pid = rep),
    c AS (SELECT a.pid AS a, b.pid AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM u a JOIN u b ON a.w = b.w AND a.pid < b.pid GROUP BY 1, 2),
    l AS (SELECT a, b FROM c WHERE k * 10 >= 7 * (na + nb - k)),
    e AS (SELECT rep, count(*) AS links FROM (SELECT a AS rep FROM l UNION ALL SELECT b FROM l) GROUP BY 1)
    SELECT pid, rep AS class_id, coalesce(links, 0) AS links FROM m LEFT JOIN e USING (rep)
    """,
)
def p4_classes(spark, d):
    """Each record with its class (equal word sets) and the number of classes that its class is linked to."""
    links, members = near_copies(table(spark, d, "paragraphs", "pid", "text"), "pid", "text", 0.7)
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(ends, "rep", "left").select(F.col("id").alias("pid"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))


def _sections(spark, d):
    return table(spark, d, "paragraphs", "pid", "revision_id", "position", "section_path", "block_kind", "block_label", "text")


@query(
    "p2_found",
    """
    WITH k AS (SELECT revision_id, position, section_path, length(text) AS n FROM paragraphs WHERE block_kind IS DISTINCT FROM 'reference'),
    s AS (SELECT *, CASE WHEN lag(position) OVER w = position - 1 AND lag(section_path) OVER w IS NOT DISTINCT FROM section_path THEN 0 ELSE 1 END AS b
          FROM k WINDOW w AS (PARTITION BY revision_id ORDER BY position)),
    i AS (SELECT *, sum(b) OVER (PARTITION BY revision_id ORDER BY position) AS g FROM s)
    SELECT revision_id, min(position) AS first_pos, max(position) AS last_pos FROM i GROUP BY revision_id, g HAVING sum(n) > 24000
    """,
)
def p2_found(spark, d):
    return chunks(_sections(spark, d)).select("revision_id", "first_pos", "last_pos").distinct()


@query("p2_chunks")
def p2_chunks(spark, d):
    return chunks(_sections(spark, d))


def _marked(spark, d):
    return table(spark, d, "blocks", "block_id", "text", "kind"), table(spark, d, "paragraphs", "pid", "text", "html", "block_kind")


@query("p3_found")
def p3_found(spark, d):
    return find_markup(*_marked(spark, d))


@query("p3_clean")
def p3_clean(spark, d):
    return clean_texts(*_marked(spark, d))


@query("p1_found")
def p1_found(spark, d):
    return find_noise(table(spark, d, "blocks"))


@query("p1_paragraphs")
def p1_paragraphs(spark, d):
    return paragraphs_of(table(spark, d, "blocks"))
