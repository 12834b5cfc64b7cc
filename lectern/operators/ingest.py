"""From parser output to paragraphs: readers, positions, hashes, shared content, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.latex import PLAIN, html_texts, maths
from lectern.functions.text import content_hash

# Block labels of the parser that writes trees, with their kinds, and the labels of its containers.
TREE_KINDS = {
    "SectionHeader": "heading",
    "Text": "text",
    "TextInlineMath": "text",
    "Handwriting": "text",
    "ComplexRegion": "text",
    "Form": "text",
    "TableOfContents": "text",
    "Bibliography": "reference",
    "Reference": "reference",
    "ListItem": "list_item",
    "Equation": "equation",
    "Code": "code",
    "Table": "table",
    "Caption": "caption",
    "Footnote": "footnote",
    "Figure": "figure",
    "Picture": "figure",
    "Diagram": "figure",
    "ChemicalBlock": "figure",
    "PageHeader": "furniture",
    "PageFooter": "furniture",
}
TREE_GROUPS = ("FigureGroup", "TableGroup", "ListGroup", "PictureGroup")
# Block labels of the parser that writes pages, with their kinds.
PAGE_KINDS = {
    "doc_title": "heading",
    "paragraph_title": "heading",
    "text": "text",
    "abstract": "text",
    "content": "text",
    "vertical_text": "text",
    "aside_text": "text",
    "reference": "reference",
    "reference_content": "reference",
    "display_formula": "equation",
    "inline_formula": "equation",
    "algorithm": "algorithm",
    "table": "table",
    "figure_title": "caption",
    "vision_footnote": "caption",
    "footnote": "footnote",
    "image": "figure",
    "chart": "figure",
    "seal": "figure",
    "formula_number": "furniture",
    "header": "furniture",
    "header_image": "furniture",
    "footer": "furniture",
    "footer_image": "furniture",
    "number": "furniture",
}
#: Groups of a tree may lie in each other this deep; a document that goes deeper is an error row.
DEPTH = 5
_PAGES = "struct<pages:array<struct<page_index:int,parsing_res_list:array<struct<block_label:string,block_content:string,block_bbox:array<double>>>>>>"
_NODE = "id:string,block_type:string,html:string,bbox:array<double>,section_hierarchy:map<string,string>"
_LEAF = "array<struct<page:int,label:string,node:string,html:string,bbox:array<double>,section_hierarchy:map<string,string>>>"
#: Papers that one part of a shared hash holds.
HELD = 1000
_STRINGS = "array<string>"
_MATH = "array<struct<tex:string,display:boolean>>"


def _kind(labels: dict[str, str], label: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[label]


def _opened(documents: DataFrame, key: str, blocks: Column, whole: Column, kinds: dict[str, str]) -> DataFrame:
    """(key, blocks, error): the blocks of each document as one array (``label`` and what the format has), and what is
    wrong with it: not the schema, or the first label that is not known. One that has an error keeps no block."""
    d = documents.withColumn("blocks", blocks)
    known = F.try_element_at(F.filter(F.transform("blocks", lambda b: b["label"]), lambda x: ~x.isin(*kinds)), F.lit(1))
    error = F.when(~F.coalesce(whole, F.lit(False)), "not the schema").otherwise(F.concat(F.lit("unknown label "), known))
    return d.select(key, "blocks", error.alias("error"))


def _errors(opened: DataFrame, key: str) -> DataFrame:
    return opened.where("error IS NOT NULL").select(key, "error")


def read_pages(documents: DataFrame, key: str, raw: str) -> DataFrame:
    """Blocks of page-list JSON, one row per block: nested arrays are opened by the engine, running titles are windows.

    A document that does not fit the schema, or has an unknown label, gives one row with ``error``, and no blocks.
    """
    name, key = key, "_key"
    doc = documents.select(F.col(name).alias(key), F.from_json(raw, _PAGES, {"mode": "PERMISSIVE"}).alias("d"))
    block = lambda page: lambda b: F.struct(page["page_index"].alias("page"), b["block_label"].alias("label"), F.trim(b["block_content"]).alias("content"), b["block_bbox"].cast("array<float>").alias("bbox"))
    blocks = F.flatten(F.transform("d.pages", lambda page: F.transform(page["parsing_res_list"], block(page))))
    fits = lambda b: b["block_label"].isNotNull() & b["block_content"].isNotNull() & (F.size(b["block_bbox"]) == 4)
    whole = F.forall("d.pages", lambda p: p["page_index"].isNotNull() & p["parsing_res_list"].isNotNull() & F.forall(p["parsing_res_list"], fits))
    opened = _opened(doc, key, blocks, whole, PAGE_KINDS)
    rows = opened.where("error IS NULL").select(key, F.posexplode("blocks").alias("block_index", "b")).select(key, "block_index", "b.*")
    by = Window.partitionBy(key).orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    is_title, is_section = F.col("label") == "doc_title", F.col("label") == "paragraph_title"
    rows = rows.withColumn("title", F.last(F.when(is_title, F.col("content")), True).over(by)).withColumn("book", F.count(F.when(is_title, 1)).over(by))
    in_book = Window.partitionBy(key, "book").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.last(F.when(is_section, F.col("content")), True).over(in_book))
    path = F.when(is_title, F.array().cast(_STRINGS)).when(is_section, F.array_compact(F.array("title"))).otherwise(F.array_compact(F.array("title", "section")))
    rows = rows.select(key, "block_index", "page", _kind(PAGE_KINDS, F.col("label")).alias("kind"), "bbox", "content", F.when(is_title, 1).when(is_section, 2).alias("heading_level"), path.alias("section_path"), maths("content").alias("found"))
    equation = F.col("kind") == "equation"
    math = F.transform("found", lambda m: F.struct(m["tex"].alias("tex"), (m["display"] | equation).alias("display")))
    text = F.when(equation & (F.size("found") > 0), F.array_join(F.transform("found", lambda m: m["tex"]), "\n\n")).otherwise(F.col("content"))
    shaped = rows.select(key, "block_index", "page", "kind", "bbox", text.alias("text"), math.cast(_MATH).alias("math"), "heading_level", "section_path", (equation & (F.size("found") == 0)).alias("malformed_math"))
    return shaped.withColumn("error", F.lit(None).cast("string")).unionByName(_errors(opened, key), allowMissingColumns=True).withColumnRenamed(key, name)


def _tree_schema(depth: int) -> str:
    children = "array<string>" if depth == 0 else f"array<{_tree_schema(depth - 1)}>"
    return f"struct<{_NODE},children:{children}>"


def _leaves(nodes: Column, page: Column, depth: int) -> Column:
    """The blocks under ``nodes`` in reading order, a group replaced by what it holds."""

    def one(n):
        own = F.array(F.struct(page.alias("page"), n["block_type"].alias("label"), n["id"].alias("node"), *[n[c].alias(c) for c in ("html", "bbox", "section_hierarchy")]))
        return own if depth == 0 else F.when(n["block_type"].isin(*TREE_GROUPS), F.coalesce(_leaves(n["children"], page, depth - 1), F.array().cast(_LEAF))).otherwise(own)

    return F.flatten(F.transform(nodes, one))


def read_trees(documents: DataFrame, key: str, raw: str) -> DataFrame:
    """Blocks of block-tree JSON, one row per block; groups are replaced by what they hold.

    All of it happens inside a document's row: the tree is read under a schema of bounded depth, its leaves become one
    array, the array is opened. Only the HTML of the blocks goes through Python, as Arrow batches. A section path lists
    the headings above a block from the outermost on, without the block itself; a heading that is not in the document is
    left out. A document that does not fit the schema, is nested deeper than ``DEPTH`` groups or has an unknown label
    gives one row with ``error``, and no blocks.
    """
    name, key = key, "_key"
    doc = documents.select(F.col(name).alias(key), F.from_json(raw, f"struct<children:array<{_tree_schema(DEPTH)}>>", {"mode": "PERMISSIVE"}).alias("d"))
    blocks = F.flatten(F.transform("d.children", lambda page, i: F.coalesce(_leaves(page["children"], i, DEPTH - 1), F.array().cast(_LEAF))))
    complete = lambda n: n["node"].isNotNull() & n["html"].isNotNull() & n["label"].isNotNull() & (F.size(n["bbox"]) == 4)
    pages = F.forall("d.children", lambda p: p["id"].isNotNull() | p["children"].isNotNull())
    deep = F.exists("blocks", lambda b: b["label"].isin(*TREE_GROUPS))
    opened = _opened(doc, key, blocks, pages & F.forall("blocks", complete) & ~deep, TREE_KINDS)
    good = opened.where("error IS NULL").select(key, "blocks", F.transform("blocks", lambda b: b["html"]).alias("source"))
    kind = documents.schema[name].dataType.simpleString()
    good = good.mapInArrow(html_texts, f"{key} {kind}, blocks {_LEAF}, plain {PLAIN}")  # a step of its own: the engine filters by the size of what is opened
    both = good.select(key, F.arrays_zip("blocks", "plain").alias("z"))
    heads = F.map_from_entries(F.transform(F.filter("z", lambda x: x["blocks"]["label"] == "SectionHeader"), lambda x: F.struct(x["blocks"]["node"], x["plain"]["text"])))
    rows = both.select(key, heads.alias("heads"), F.posexplode("z").alias("block_index", "x"))
    rows = rows.select(key, "block_index", "heads", "x.blocks.*", "x.plain.text", "x.plain.math", "x.plain.level").withColumn("kind", _kind(TREE_KINDS, F.col("label")))
    above = F.transform(F.array_sort(F.transform(F.map_entries("section_hierarchy"), lambda e: F.struct(e["key"].cast("int").alias("n"), e["value"].alias("id")))), lambda e: e["id"])
    path = F.array_compact(F.transform(F.filter(above, lambda i: i != F.col("node")), lambda i: F.col("heads")[i]))
    equation, table = F.col("kind") == "equation", F.col("kind") == "table"
    text = F.when(table, F.col("html")).when(equation & (F.size("math") > 0), F.array_join(F.transform("math", lambda m: m["tex"]), "\n\n")).otherwise(F.col("text"))
    shaped = rows.select(
        key, "block_index", "page", "kind", F.col("bbox").cast("array<float>").alias("bbox"), text.alias("text"), F.when(table, F.array().cast(_MATH)).otherwise(F.col("math")).alias("math"),
        F.when(F.col("kind") == "heading", F.col("level")).alias("heading_level"), F.coalesce(path, F.array().cast(_STRINGS)).alias("section_path"), (equation & (F.size("math") == 0)).alias("malformed_math"),
    )
    return shaped.withColumn("error", F.lit(None).cast("string")).unionByName(_errors(opened, key), allowMissingColumns=True).withColumnRenamed(key, name)


def paragraphs_from(blocks: DataFrame, key: str = "revision_id") -> DataFrame:
    """Stored paragraphs of blocks: headings, furniture and blank texts dropped, positions from 0, kind null for text."""
    kept = blocks.where(~F.coalesce(F.col("kind").isin("heading", "furniture"), F.lit(False)) & F.col("text").rlike(r"[^\s\x1C-\x1F\x85\xA0  -     　]"))
    at = F.row_number().over(Window.partitionBy(key).orderBy("block_index")) - 1
    return kept.select(key, at.alias("position"), "page", "bbox", "section_path", "text", content_hash(F.col("text")).alias("content_hash"), F.nullif("kind", F.lit("text")).alias("block_kind"))


def running_sections(blocks: DataFrame) -> DataFrame:
    """(block_id, title, section): the last title and section headings before each block; a title ends the section."""
    by = Window.partitionBy("revision_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    is_title = (F.col("kind") == "heading") & (F.col("heading_level") == 1)
    is_section = (F.col("kind") == "heading") & (F.coalesce(F.col("heading_level"), F.lit(2)) > 1)
    b = blocks.withColumn("title", F.last(F.when(is_title, F.col("text")), True).over(by)).withColumn("book", F.count(F.when(is_title, 1)).over(by))
    in_book = Window.partitionBy("revision_id", "book").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)
    return b.select("block_id", "title", F.last(F.when(is_section, F.col("text")), True).over(in_book).alias("section"))


def shared_content(paragraphs: DataFrame, revisions: DataFrame, least_chars: int = 80) -> DataFrame:
    """(revision_id, similar_paper_id, similarity): for each revision the other paper that shares most of its distinct
    hashes of long paragraphs, ties by paper id. All revisions of other papers count, with paragraphs of any length.

    Hashes are reduced to one row per paper first, so copies inside a paper cost nothing. A hash that p papers hold still
    gives p pairs per revision, as each of them is a possible answer; its pairs are spread over a part for every
    ``HELD`` papers, so that no task makes more than that for each of its revisions, and they are summed before they move.
    """
    p = paragraphs.join(revisions.select("revision_id", "paper_id"), "revision_id")
    mine = p.where(F.length("text") >= least_chars).select("revision_id", "paper_id", "content_hash").distinct()
    total = mine.groupBy("revision_id").agg(F.count("*").alias("n"))
    theirs = p.select(F.col("paper_id").alias("other"), "content_hash").distinct()
    parts = theirs.groupBy("content_hash").agg(F.ceil(F.count("*") / HELD).cast("int").alias("parts")).where("parts > 1")
    theirs = theirs.join(parts, "content_hash", "left").withColumn("part", F.pmod(F.xxhash64("other"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    mine = mine.join(parts, "content_hash", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    pairs = mine.join(theirs, ["content_hash", "part"]).where(F.col("paper_id") != F.col("other")).groupBy("revision_id", "other").agg(F.count("*").alias("shared"))
    best = pairs.groupBy("revision_id").agg(F.max("shared").alias("shared"), F.min_by("other", F.struct(-F.col("shared"), "other")).alias("similar_paper_id"))
    return best.join(total, "revision_id").select("revision_id", "similar_paper_id", (F.col("shared") / F.col("n")).cast("float").alias("similarity"))


def new_files(files: DataFrame, revisions: DataFrame, key: str = "pdf_sha256") -> DataFrame:
    """Files whose hash is not stored yet, each hash once."""
    return files.dropDuplicates([key]).join(revisions.select(key), key, "left_anti")


def stored_files(files: DataFrame, revisions: DataFrame, papers: DataFrame, key: str = "pdf_sha256") -> DataFrame:
    """(hash, paper_id, name, revision_id, revision, stage): what is stored of files, by hash."""
    r = revisions.select(key, "paper_id", "revision_id", "revision", "stage").join(papers.select("paper_id", "name"), "paper_id")
    return files.select(key).distinct().join(r, key)


def new_papers(files: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(papers, revisions): the rows of files (sha256, name) that are to be stored, a paper and its revision 1 for each.
    Ids are derived from the hash, so a repeated import makes the same rows; a blank name becomes 'untitled'."""
    paper = F.concat_ws("-", *[F.substring("sha256", a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    f = files.dropDuplicates(["sha256"]).withColumn("paper_id", paper).withColumn("at", F.lit(at).cast("timestamp"))
    name = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.lit("untitled"))
    papers = f.select("paper_id", name.alias("name"), F.lit(None).cast("string").alias("title"), F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    revisions = f.select(F.xxhash64("sha256").alias("revision_id"), "paper_id", F.lit(1).alias("revision"), F.col("sha256").alias("pdf_sha256"), F.lit("parse").alias("stage"), F.lit(False).alias("is_current"), F.lit(0).alias("attempts"), F.col("at").alias("created_at"))
    return papers, revisions


def reconcile(old: DataFrame, new: DataFrame, carried: list[str]) -> DataFrame:
    """The next snapshot of paragraphs: a row with the same position and hash keeps its id and the carried columns, a
    changed or new one gets a new id, one that is gone is left out. ``status`` says which."""
    o = old.select("revision_id", "position", F.col("content_hash").alias("_h"), F.col("pid").alias("_pid"), *[F.col(c).alias(f"_{c}") for c in carried])
    both = new.join(o, ["revision_id", "position"], "full")
    same = F.col("content_hash").eqNullSafe(F.col("_h")) & F.col("_pid").isNotNull()
    status = F.when(F.col("content_hash").isNull(), "deleted").when(same, "kept").when(F.col("_pid").isNull(), "inserted").otherwise("changed")
    pid = F.when(same, F.col("_pid")).otherwise(F.xxhash64("revision_id", "position", "content_hash"))
    return both.select("revision_id", "position", "content_hash", pid.alias("pid"), status.alias("status"), *[F.when(same, F.col(f"_{c}")).alias(c) for c in carried])


def document_titles(blocks: DataFrame) -> DataFrame:
    """(revision_id, title): the text of the first heading."""
    return blocks.where("kind = 'heading'").groupBy("revision_id").agg(F.min_by("text", "block_index").alias("title"))


def fill_titles(papers: DataFrame, revisions: DataFrame, blocks: DataFrame) -> DataFrame:
    """Papers whose title is null take the one found in their latest parsed revision."""
    found = document_titles(blocks).join(revisions.select("revision_id", "paper_id", "revision"), "revision_id")
    latest = found.groupBy("paper_id").agg(F.max_by("title", "revision").alias("_title"))
    return papers.join(latest, "paper_id", "left").withColumn("title", F.coalesce("title", "_title")).drop("_title")
