"""Five-channel retrieval over current paragraphs and units, fused by reciprocal ranks, for many questions at once.

Channels give ids only; texts are fetched for the few hits at the end. Ranks are those of a channel's raw list. A
paragraph credits every unit that holds it, or itself if none does; an item keeps its best rank per channel.

The questions are a stated set: up to ``TOGETHER`` of them travel to the tasks at once and take one pass over the vectors
(for all three vector channels), one over the texts or postings and one over the normal forms; a task scores ``AT_ONCE``
of them at a time. No task sends on more than its own best ``CANDIDATES`` per question and channel (for full text and
formulas: no segment and no Arrow batch), as one row of ids and scores.

Stored postings lie in segments of some ``SEGMENT`` characters: a row has a word's places in all texts of its segment, so
a segment's texts are compared with all questions in one task.

Defined results: unusable vectors (null, wrong length, not finite, all zero) are no hits, and a question without a usable
vector has none in those channels; null texts match nothing; equal scores go to the smaller id; repeated rows count once;
an empty table, question or scope gives no hits; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.latex import normalize, normalized
from lectern.functions.text import Terms, split_words, terms_score, trigrams, websearch, word_similarity

CANDIDATES, RRF, AT_ONCE, TOGETHER = 50, 60, 256, 16_384
CHANNELS = ("paragraph", "fulltext", "latex", "gloss", "question")
EXCLUDED = ("reference",)
SIMILAR = 0.6
BUCKETS = 64
#: Characters of a segment's texts (a longer text is a segment of its own), and texts of it.
SEGMENT, SEGMENT_TEXTS = 4_000_000, 10_000
#: Words up to which the stored postings are filtered by a list instead of a join.
LISTED = 1_000


def term_bucket(word: str) -> int:
    """Which of the ``BUCKETS`` parts of the stored postings a word is in."""
    return xxhash.xxh3_64_intdigest(word) % BUCKETS


def _segments(batches) -> Iterator[tuple[list[int], list[str]]]:
    """The ids and texts of Arrow batches (pid, text) in segments."""
    pids, texts, size = [], [], 0
    for b in batches:
        for pid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if texts and (size + len(text) > SEGMENT or len(texts) == SEGMENT_TEXTS):
                yield pids, texts
                pids, texts, size = [], [], 0
            pids.append(pid)
            texts.append(text)
            size += len(text)
    if texts:
        yield pids, texts


def _places(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, and for each place, by word, text and position: the word's number, the text's and the position."""
    split = [split_words(t) for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    encoded = pa.array(chain.from_iterable(split), pa.string()).dictionary_encode()
    word = encoded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(split), dtype=np.int32), n)
    position = (np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    order = np.argsort(word, kind="stable")
    return encoded.dictionary.to_pylist(), word[order], doc[order], position[order]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def postings_of(paragraphs: DataFrame) -> DataFrame:
    """(bucket, segment, term, docs, counts, positions, pids): the texts of a segment that hold a word, by their numbers in it,
    how often, and where. The row of the empty term has the ids of the segment's texts. Written by ``bucket``, it is the
    full-text index."""
    names = ["bucket", "segment", "term", "docs", "counts", "positions", "pids"]

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        for k, (pids, texts) in enumerate(_segments(batches)):
            terms, word, doc, position = _places(texts)
            at = _changes(word, doc)
            counts, docs = np.diff(np.r_[at, len(word)]).astype(np.int32), doc[at]
            n = len(terms)
            lists = lambda by, values: pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(by, np.arange(n + 1)), len(by)], pa.int32()), pa.array(values, pa.int32()))
            own = pa.ListArray.from_arrays(pa.array(np.r_[np.zeros(n + 1, np.int32), len(pids)], pa.int32()), pa.array(pids, pa.int64()))
            columns = [pa.array([term_bucket(w) for w in [*terms, ""]], pa.int32()), pa.array(np.full(n + 1, first + k)), pa.array([*terms, ""], pa.string()), lists(word[at], docs), lists(word[at], counts), lists(word, position), own]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return paragraphs.where("text IS NOT NULL").select(F.col("pid").cast("long").alias("pid"), "text").mapInArrow(run, POSTINGS)


POSTINGS = "bucket int, segment long, term string, docs array<int>, counts array<int>, positions array<int>, pids array<long>"


def write_index(paragraphs: DataFrame, root: str) -> dict[str, DataFrame]:
    """Store ``postings`` (by bucket, sorted by term, so that a question reads the parts of its words) and ``norms`` under
    ``root``; what it returns is what ``search_block`` takes beside the tables."""
    spark = paragraphs.sparkSession
    postings_of(paragraphs).repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{root}/postings")
    paragraphs.select("pid", normalized(F.col("text"), F.col("block_kind")).alias("norm")).where("norm IS NOT NULL").write.mode("overwrite").parquet(f"{root}/norms")
    return {"postings": spark.read.schema(POSTINGS).parquet(f"{root}/postings"), "norms": spark.read.parquet(f"{root}/norms")}


def current(revisions: DataFrame) -> DataFrame:
    return revisions.where(F.col("is_current") & (F.col("stage") == "ready")).select("revision_id", "paper_id")


def _kinds(kinds: Sequence[str] | None, exclude: Sequence[str], *columns: str) -> Column:
    """A null kind fails a whitelist and survives an exclusion."""
    keep = F.lit(True)
    if kinds:
        keep = F.lit(False)
        for c in columns:
            keep = keep | F.coalesce(F.col(c).isin(*kinds), F.lit(False))
    if exclude:
        for c in columns:
            keep = keep & ~F.coalesce(F.col(c).isin(*exclude), F.lit(False))
    return keep


def paragraph_scope(paragraphs, revisions, papers=None, kinds=None, exclude=EXCLUDED) -> DataFrame:
    rev = current(revisions)
    if papers:
        rev = rev.where(F.col("paper_id").isin(*papers))
    return paragraphs.where(_kinds(kinds, exclude, "block_kind")).join(rev, "revision_id")


def unit_scope(units, revisions, papers=None, kinds=None, exclude=EXCLUDED) -> DataFrame:
    rev = current(revisions)
    if papers:
        rev = rev.where(F.col("paper_id").isin(*papers))
    return units.where(_kinds(kinds, exclude, "anchor_kind", "anchor_term")).join(rev, "revision_id")


def _usable(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, in double precision, of the usable rows, and which rows they are."""
    offsets = column.offsets.to_numpy()
    rows = np.flatnonzero((np.diff(offsets) == dim) & ~np.asarray(column.is_null()))
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    m = values[offsets[:-1][rows][:, None] + np.arange(dim)] if len(rows) else np.zeros((0, dim))
    good = np.isfinite(m).all(1) & (m != 0).any(1)
    m, rows = m[good], rows[good]
    return m / np.sqrt(np.einsum("ij,ij->i", m, m))[:, None] if len(m) else m, rows


def _best(question: np.ndarray, item: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best items of each question by score, then id, each item once with its best score; with the rank from 0."""
    o = np.lexsort((-score, item, question))
    o = o[_changes(question[o], item[o])]
    o = o[np.lexsort((item[o], -score[o], question[o]))]
    at = _changes(question[o])
    rank = np.arange(len(o)) - np.repeat(at, np.diff(np.r_[at, len(o)]))
    o, rank = o[rank < k], rank[rank < k]
    return question[o], item[o], score[o], rank


LISTS = "question long, channel string, items array<long>, scores array<double>"


def _lists(channel: str, question: np.ndarray, item: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    """Hits that are sorted by question as ``LISTS``."""
    at = _changes(question)
    offsets = pa.array(np.r_[at, len(question)], pa.int32())
    columns = [pa.array(question[at], pa.int64()), pa.array([channel] * len(at), pa.string()), pa.ListArray.from_arrays(offsets, pa.array(item, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(score, pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["question", "channel", "items", "scores"])


def ranked(lists: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """(question, channel, item, score, rank): the k best items of each question and channel of ``LISTS`` by score, then id,
    with ``rank`` from 1."""

    def run(batches):
        held: dict[str, list] = {}
        for b in batches:
            n = np.diff(b.column(2).offsets.to_numpy())
            rows = np.repeat(np.arange(b.num_rows), n)
            channel = np.array(b.column(1).to_pylist(), object)[rows]
            for c in dict.fromkeys(b.column(1).to_pylist()):
                own = channel == c
                held.setdefault(c, []).append((b.column(0).to_numpy()[rows][own], b.column(2).flatten().to_numpy()[own], b.column(3).flatten().to_numpy()[own]))
        for c, parts in held.items():
            question, item, score, rank = _best(*(np.concatenate(x) for x in zip(*parts)), k)
            for a in range(0, len(question), 100_000):
                own = slice(a, a + 100_000)
                columns = [pa.array(question[own]), pa.array([c] * len(question[own]), pa.string()), pa.array(item[own]), pa.array(score[own]), pa.array(rank[own] + 1, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["question", "channel", "item", "score", "rank"])

    return lists.repartition("question").mapInArrow(run, "question long, channel string, item long, score double, rank int")


class Question:
    """One question: its number, its text and its vector (or none)."""

    def __init__(self, number: int, text: str | None, vector: Sequence[float] | None):
        self.number, self.text = number, text or ""
        v = np.array([np.nan if x is None else x for x in vector], np.float64) if vector is not None else np.zeros(0)
        self.vector = v / np.sqrt(v @ v) if len(v) and np.isfinite(v).all() and v.any() else None


def vector_hits(owners: DataFrame, vectors: DataFrame, set_name: str, questions: list[Question], k: int = CANDIDATES) -> DataFrame:
    """(question, channel, item, score, rank): ``owners`` (channel, owner, item) says whose vectors count for which item;
    an item's score is that of its best vector."""
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(q.vector) for q in questions if q.vector is not None}:
        own = [q for q in questions if q.vector is not None and len(q.vector) == dim]
        asked[dim] = np.array([q.number for q in own], np.int64), np.array([q.vector for q in own], np.float64)

    def run(batches):
        # channel, dimension and first question: its questions' numbers, and the best so far as (index, item, score) with the score of each question's k-th
        held: dict[tuple[str, int, int], list] = {}
        for b in batches:
            channels = np.array(b.column(0).to_pylist(), object)
            for dim, (numbers, matrix) in asked.items():
                m, rows = _usable(b.column(2), dim)
                channel, item = channels[rows], b.column(1).to_numpy()[rows]
                for c in dict.fromkeys(channel.tolist()):
                    own = np.flatnonzero(channel == c)
                    own = own[np.argsort(item[own], kind="stable")]
                    start = _changes(item[own])
                    ids, mine = item[own][start], m[own]
                    for a in range(0, len(numbers), AT_ONCE):
                        score = (mine @ matrix[a : a + AT_ONCE].T).round(9)
                        if len(start) < len(own):
                            score = np.maximum.reduceat(score, start, axis=0)
                        n, nq = score.shape
                        index, best, value, least = held.get((c, dim, a)) or (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.full(nq, -np.inf))
                        near = score >= least
                        if n > k and near.sum() > 4 * k * nq:
                            near = score >= np.maximum(least, np.partition(score, n - k, axis=0)[n - k])
                        row, q = np.nonzero(near)
                        index, best, value, rank = _best(np.r_[index, q], np.r_[best, ids[row]], np.r_[value, score[row, q]], k)
                        least = np.full(nq, -np.inf)
                        least[index[rank == k - 1]] = value[rank == k - 1]
                        held[c, dim, a] = index, best, value, least
        for (c, dim, a), (index, best, value, _) in held.items():
            yield _lists(c, asked[dim][0][a + index], best, value)

    v = vectors.where(F.col("set_name") == set_name).select(F.col("target").alias("channel"), F.col("owner_id").alias("owner"), "emb")
    of_items = v.join(owners, ["channel", "owner"]).select("channel", F.col("item").cast("long").alias("item"), "emb")
    return ranked(of_items.mapInArrow(run, LISTS), k)


def _texts_near(asked: list[tuple[int, Terms]]) -> Column:
    """A cheap test on the raw text, so that only texts that hold all words of an alternative are split."""
    near = F.lit(False)
    for _, terms in asked:
        for must, _ in terms.alternatives:
            near = near | F.forall(F.array(*[F.lit(w) for w in sorted({w for p in must for w in p})] or [F.lit("")]), lambda w: F.contains(F.lower("text"), w))
    return near


class _Finder:
    """Finds the texts of a segment that satisfy questions: of all words of an alternative at once as bits, then place by place."""

    def __init__(self, asked: list[tuple[int, Terms]]):
        self.asked = asked
        each = [(i, must) for i, (_, t) in enumerate(asked) for must, _ in t.alternatives]
        self.words = {w: i for i, w in enumerate(sorted(words_of(asked)))}
        self.of = np.array([i for i, _ in each], np.int64)
        # each alternative's words, after the number that stands for "any text"
        lists = [[len(self.words), *sorted({self.words[w] for p in must for w in p})] for _, must in each]
        self.flat = np.array(list(chain.from_iterable(lists)), np.int64)
        self.ends = np.cumsum([len(x) for x in lists])

    def find(self, held: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]], docs: np.ndarray, pids: np.ndarray, k: int) -> pa.RecordBatch:
        """``held``: the texts, counts and positions of the segment's words; ``docs`` and ``pids``: the texts that count."""
        n = int(docs.max()) + 1
        pid = np.zeros(n, np.int64)
        pid[docs] = pids
        row = np.full(len(self.words) + 1, -1)
        bits = np.zeros((len(held) + 1, -(-n // 8)), np.uint8)
        for i, (w, (at, _, _)) in enumerate([*held.items(), ("", (docs, None, None))]):
            row[self.words.get(w, len(self.words)) if w else len(self.words)] = i
            one = np.zeros(n, bool)
            one[at[at < n]] = True
            bits[i] = np.packbits(one)
        ends: dict[str, np.ndarray] = {}

        def places(w: str, doc: int) -> list[int] | None:
            at, counts, positions = held[w]
            i = int(np.searchsorted(at, doc))
            if i == len(at) or at[i] != doc:
                return None
            if w not in ends:
                ends[w] = np.cumsum(counts)
            return positions[ends[w][i] - counts[i] : ends[w][i]].tolist()

        found: dict[int, set[int]] = {}
        starts = np.r_[0, self.ends[:-1]]
        for x in np.flatnonzero(np.logical_and.reduceat(row[self.flat] >= 0, starts)):
            all_of = np.bitwise_and.reduce(bits[row[self.flat[starts[x] : self.ends[x]]]], axis=0)
            if all_of.any():
                found.setdefault(int(self.of[x]), set()).update(np.flatnonzero(np.unpackbits(all_of, count=n)).tolist())
        out: list[tuple[int, int, float]] = []
        for i, texts in found.items():
            number, terms = self.asked[i]
            own = words_of([self.asked[i]]) & held.keys()
            hits = []
            for doc in texts:
                s = terms_score({w: p for w in own if (p := places(w, doc))}, terms)
                if s is not None:
                    hits.append((number, int(pid[doc]), round(s, 9)))
            out += sorted(hits, key=lambda h: (-h[2], h[1]))
        question, item, score, _ = _best(np.array([o[0] for o in out], np.int64), np.array([o[1] for o in out], np.int64), np.array([o[2] for o in out], np.float64), k)
        return _lists("fulltext", question, item, score)


def words_of(asked: list[tuple[int, Terms]]) -> set[str]:
    return {w for _, t in asked for must, barred in t.alternatives for p in [*must, *barred] for w in p}


def fulltext_hits(scope: DataFrame, questions: list[Question], k: int = CANDIDATES, postings: DataFrame | None = None) -> DataFrame:
    """(question, channel, item, score, rank). With ``postings`` (as ``postings_of`` gives them) texts are read only for
    questions that have an alternative of barred words alone."""
    asked = [(q.number, t) for q in questions if (t := websearch(q.text))]
    whole = [(n, t) for n, t in asked if postings is None or any(not must for must, _ in t.alternatives)]
    rest = [(n, t) for n, t in asked if postings is not None and all(must for must, _ in t.alternatives)]

    def in_texts(batches):
        finder = _Finder(whole)
        for pids, texts in _segments(batches):
            terms, word, doc, position = _places(texts)
            own = np.flatnonzero([w in finder.words for w in terms])
            held = {}
            for w, a, b in zip(own, np.searchsorted(word, own), np.searchsorted(word, own, "right")):
                at = _changes(doc[a:b])
                held[terms[w]] = doc[a:b][at], np.diff(np.r_[at, b - a]), position[a:b]
            yield finder.find(held, np.arange(len(pids)), np.array(pids, np.int64), k)

    finder = _Finder(rest) if rest else None

    def in_segment(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        terms = t["term"].to_pylist()
        values = {c: t[c].combine_chunks() for c in ("docs", "counts", "positions", "pids")}
        of = lambda c, i: values[c][i].values.to_numpy()
        if "" not in terms:
            return pa.Table.from_batches([_lists("fulltext", np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))])
        mine = terms.index("")
        held = {w: (of("docs", i), of("counts", i), of("positions", i)) for i, w in enumerate(terms) if w}
        return pa.Table.from_batches([finder.find(held, of("docs", mine), of("pids", mine), k)])

    texts = scope.select(F.col("pid").cast("long").alias("pid"), "text").where(F.col("text").isNotNull() & F.lit(bool(whole)))
    parts = [(texts.where(_texts_near(whole)) if len(whole) <= 16 else texts).mapInArrow(in_texts, LISTS)] if whole or not rest else []
    if rest:
        wanted = sorted(words_of(rest))
        held = postings.where(F.col("bucket").isin(sorted({term_bucket(w) for w in wanted})))
        if len(wanted) <= LISTED:
            held = held.where(F.col("term").isin(wanted))
        else:
            held = held.join(F.broadcast(scope.sparkSession.createDataFrame(pa.table({"term": wanted}))), "term", "left_semi")
        stored = postings.where((F.col("bucket") == term_bucket("")) & (F.col("term") == "")).select("segment", F.posexplode("pids").alias("doc", "pid"))
        of_scope = stored.join(scope.select("pid"), "pid", "left_semi").groupBy("segment").agg(F.array_sort(F.collect_list(F.struct("doc", "pid"))).alias("d"))
        none = F.array().cast("array<int>")
        own = of_scope.select("segment", F.lit("").alias("term"), F.col("d.doc").alias("docs"), none.alias("counts"), none.alias("positions"), F.col("d.pid").alias("pids"))
        held = held.select("segment", "term", "docs", "counts", "positions", F.array().cast("array<long>").alias("pids")).unionByName(own)
        parts.append(held.groupBy("segment").applyInArrow(in_segment, LISTS))
    return ranked(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), k)


def latex_hits(scope: DataFrame, questions: list[Question], k: int = CANDIDATES, least: float = SIMILAR, norms: DataFrame | None = None) -> DataFrame:
    """(question, channel, item, score, rank) by word similarity to the normal forms of formulas, stored (pid, norm) or
    made here. A form is compared in full only with questions of whose trigrams it holds the share that ``least`` needs."""
    asked = [(q.number, w, parts) for q in questions if (w := normalize(q.text)) and (parts := frozenset(trigrams(w)))]
    if norms is None:
        norms = scope.select("pid", normalized(F.col("text"), F.col("block_kind")).alias("norm"))
    else:
        norms = norms.join(scope.select("pid"), "pid", "left_semi")

    def run(batches):
        number = {t: i for i, t in enumerate(sorted({t for _, _, parts in asked for t in parts}))}
        need = np.array([least * len(parts) for _, _, parts in asked])
        fewest = need.min(initial=np.inf)

        def held(each) -> np.ndarray:
            out = np.zeros((len(each), len(number)), np.float32)
            for i, parts in enumerate(each):
                out[i, [number[t] for t in parts]] = 1
            return out

        for b in batches:
            out = []
            kept = [(pid, norm, x) for pid, norm in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if len(x := number.keys() & trigrams(norm)) >= fewest]
            for r in range(0, len(kept), 1_000):
                rows = kept[r : r + 1_000]
                have = held([x for _, _, x in rows])
                for a in range(0, len(asked), AT_ONCE):
                    shared = have @ held([parts for _, _, parts in asked[a : a + AT_ONCE]]).T
                    for i, q in zip(*np.nonzero(shared >= need[a : a + AT_ONCE])):
                        n, text, _ = asked[a + q]
                        if (s := round(word_similarity(text, rows[i][1]), 9)) >= least:
                            out.append((n, rows[i][0], s))
            question, item, score, _ = _best(np.array([o[0] for o in out], np.int64), np.array([o[1] for o in out], np.int64), np.array([o[2] for o in out], np.float64), k)
            yield _lists("latex", question, item, score)

    rows = norms.where(F.col("norm").isNotNull() & F.lit(bool(asked))).select(F.col("pid").cast("long").alias("pid"), "norm")
    return ranked(rows.mapInArrow(run, LISTS), k)


def _one(hits: DataFrame, key: str) -> DataFrame:
    return hits.select(F.col("item").alias(key), "score", "rank")


def vector_channel(scope: DataFrame, key: str, vectors: DataFrame, set_name: str, target: str, query, k=CANDIDATES) -> DataFrame:
    owners = scope.select(F.lit(target).alias("channel"), F.col(key).alias("owner"), F.col(key).alias("item"))
    return _one(vector_hits(owners, vectors, set_name, [Question(0, None, query)], k), key)


def question_channel(scope: DataFrame, questions: DataFrame, vectors: DataFrame, set_name: str, query, k=CANDIDATES) -> DataFrame:
    owners = scope.select("unit_id").join(questions.select("question_id", "unit_id"), "unit_id").select(F.lit("question").alias("channel"), F.col("question_id").alias("owner"), F.col("unit_id").alias("item"))
    return _one(vector_hits(owners, vectors, set_name, [Question(0, None, query)], k), "unit_id")


def fulltext_channel(scope: DataFrame, query: str, k=CANDIDATES, postings: DataFrame | None = None) -> DataFrame:
    return _one(fulltext_hits(scope, [Question(0, query, None)], k, postings), "pid")


def latex_channel(scope: DataFrame, query: str, k=CANDIDATES, least=SIMILAR, norms: DataFrame | None = None) -> DataFrame:
    return _one(latex_hits(scope, [Question(0, query, None)], k, least, norms), "pid")


def enclosing(candidates: DataFrame, units: DataFrame) -> DataFrame:
    """Each candidate paragraph (pid, revision_id, position) with every unit that holds its position; unit_id is null
    where none does. Units are spread over their positions, so it is an equi-join on revision and position."""
    at = units.select("unit_id", "revision_id", F.explode(F.sequence("first_pos", "last_pos")).alias("position")).distinct()
    return candidates.join(at, ["revision_id", "position"], "left")


def fuse(hits: DataFrame, paragraphs: DataFrame, units: DataFrame, k: int = 10) -> DataFrame:
    """(question, item_type, item_id, score, channels, matched_positions, place) of hits (question, channel, item, rank);
    items of the channels ``gloss`` and ``question`` are units, others paragraphs."""
    of_unit = F.col("channel").isin("gloss", "question")
    found = hits.where(~of_unit).select("question", "channel", "rank", F.col("item").alias("pid"))
    opened = enclosing(found.join(paragraphs.select("pid", "revision_id", "position"), "pid"), units)
    item = opened.select(
        "question", F.when(F.col("unit_id").isNull(), "paragraph").otherwise("unit").alias("item_type"), F.coalesce("unit_id", "pid").alias("item_id"), "channel", "rank", "position"
    )
    item = item.unionByName(hits.where(of_unit).select("question", F.lit("unit").alias("item_type"), F.col("item").alias("item_id"), "channel", "rank", F.lit(None).cast("int").alias("position")))
    key = ["question", "item_type", "item_id"]
    best = item.groupBy(*key, "channel").agg(F.min("rank").alias("rank"), F.min_by("position", F.struct("rank", "position")).alias("position"))
    fused = best.groupBy(*key).agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(float(RRF)) + F.col("rank"))), 9).alias("score"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "rank")))).alias("channels"),
        F.array_sort(F.collect_set("position")).alias("matched_positions"),
    )
    w = Window.partitionBy("question").orderBy(F.desc("score"), "item_type", "item_id")
    return fused.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def search_block(tables: dict[str, DataFrame], questions: list[Question], k=10, channels=CHANNELS, papers=None, kinds=None, exclude=EXCLUDED, set_name="primary") -> DataFrame:
    """The fused hits of a block of questions. ``tables`` may hold stored ``postings`` and ``norms``."""
    p = paragraph_scope(tables["paragraphs"], tables["revisions"], papers, kinds, exclude)
    u = unit_scope(tables["units"], tables["revisions"], papers, kinds, exclude)
    parts, owners = [], []
    if "paragraph" in channels:
        owners.append(p.select(F.lit("paragraph").alias("channel"), F.col("pid").alias("owner"), F.col("pid").alias("item")))
    if "gloss" in channels:
        owners.append(u.select(F.lit("gloss").alias("channel"), F.col("unit_id").alias("owner"), F.col("unit_id").alias("item")))
    if "question" in channels:
        asked = tables["unit_questions"].select("question_id", "unit_id").join(u.select("unit_id"), "unit_id")
        owners.append(asked.select(F.lit("question").alias("channel"), F.col("question_id").alias("owner"), F.col("unit_id").alias("item")))
    if owners:
        both = owners[0]
        for x in owners[1:]:
            both = both.unionByName(x)
        parts.append(vector_hits(both, tables["vectors"], set_name, questions))
    if "fulltext" in channels:
        parts.append(fulltext_hits(p, questions, postings=tables.get("postings")))
    if "latex" in channels:
        parts.append(latex_hits(p, questions, norms=tables.get("norms")))
    hits = p.select(F.lit(0).cast("long").alias("question"), F.lit("").alias("channel"), F.col("pid").alias("item"), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    for x in parts:
        hits = hits.unionByName(x)
    # expansion knows no filters: a hit brings its unit of any kind
    return fuse(hits, tables["paragraphs"], tables["units"], k)


def search_many(tables: dict[str, DataFrame], questions: DataFrame, **settings) -> DataFrame:
    """The fused hits of every question (question, text, emb), ``TOGETHER`` in one pass."""
    asked = questions.select(F.col("question").cast("long").alias("question"), "text", "emb").where("question IS NOT NULL").dropDuplicates(["question"])
    rows = asked.orderBy("question").toArrow()
    every = [Question(number, text, vector.as_py()) for number, text, vector in zip(rows["question"].to_pylist(), rows["text"].to_pylist(), rows["emb"])]
    out = None
    for a in range(0, max(1, len(every)), TOGETHER):
        part = search_block(tables, every[a : a + TOGETHER], **settings)
        out = part if out is None else out.unionByName(part)
    return out


def search(tables: dict[str, DataFrame], text: str, query, k=10, **settings) -> DataFrame:
    """The fused hits of one question: its text, and its vector."""
    return search_block(tables, [Question(0, text, query)], k=k, **settings).drop("question", "place")


def hydrate(hits: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Hits with paper, span and their paragraphs in order, each with whether a channel found it."""
    rev = tables["revisions"].select("revision_id", "paper_id").join(tables["papers"].select("paper_id", "name"), "paper_id")
    u = hits.where("item_type = 'unit'").join(tables["units"].select(F.col("unit_id").alias("item_id"), "revision_id", "first_pos", "last_pos", "anchor_label", "anchor_kind", "anchor_term", "gloss"), "item_id")
    s = hits.where("item_type = 'paragraph'").join(tables["paragraphs"].select(F.col("pid").alias("item_id"), "revision_id", F.col("position").alias("first_pos"), F.col("position").alias("last_pos")), "item_id")
    none = [F.lit(None).cast("string").alias(c) for c in ("anchor_label", "anchor_kind", "anchor_term", "gloss")]
    both = u.unionByName(s.select("*", *none))
    p = tables["paragraphs"].select("revision_id", "pid", "position", "page", "text", "block_kind", "block_label")
    # hits are few (k for each question); their positions meet the paragraphs in an equi-join
    joined = both.withColumn("position", F.explode(F.sequence("first_pos", "last_pos"))).join(p, ["revision_id", "position"])
    by = [c for c in both.columns if c not in ("channels", "matched_positions")]
    matched = F.array_contains("matched_positions", F.col("position"))  # the channels found it here
    one = F.struct("position", "page", "pid", "text", "block_kind", "block_label", matched.alias("matched"))
    rows = joined.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("paragraphs"), F.first("channels").alias("channels"), F.first("matched_positions").alias("matched_positions"))
    return rows.join(rev, "revision_id")


def hit_kinds(anchor_kind: Column, anchor_term: Column, kinds: Column) -> Column:
    """Sorted distinct kinds of a hit."""
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(F.array(anchor_kind, anchor_term), kinds))))
