"""Evaluation texts leaking into training text.

Method: the held-out items form a BM25 inverted index with block maxima, and every passage of the corpus is a query
against it (WAND). An item counts as leaked when a run of ``RUN`` of its words occurs in the document.

No leak is lost by the index: it holds, for each window of ``RUN`` words of each item, the ``RAREST`` terms of the window
with the fewest items, and an item's threshold is the smallest sum of indexed weights over its windows. A passage that
holds a window holds its terms, so its score reaches the threshold. Weights are divided by the item's threshold, which
makes the threshold 1 for all. What is retrieved is verified word by word, and the overlap with the item's question
(its last sentence) and with the rest is reported.

With ``RAREST`` = 1 a document that holds an indexed term often enough reaches an item by that term alone, so the score
works nearly as a yes or no; larger values make the index larger and what is retrieved smaller, and lose nothing.

Passages are ``PASSAGE`` words long and overlap by ``RUN - 1``. The index is broadcast; it holds a block of at most
``ITEMS`` items and ``ITEM_CHARS`` characters, in arrays (some 10 bytes a character), and further items make further
blocks, each with its own pass.

``question_share`` is the share of the item's question that the document holds, ``item_share`` that of the whole item: a
caller that drops training text should drop by ``item_share`` or ``longest_run``, and treat a document with a large
``item_share`` and a ``question_share`` of zero as one in which the rest (the answer) leaked without its question.

Defined results: null, empty and short texts leak nothing; items with fewer than ``RUN`` words are never found; items
with equal text are all reported; repeated documents give repeated rows once (rows are distinct by document and item);
other columns are ignored. Words are maximal runs of letters or digits, lower-cased.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN, RAREST, PASSAGE, BLOCK = 12, 1, 64, 16
K1, B = 1.2, 0.75
ITEMS, ITEM_CHARS = 20_000, 16_000_000
WORDS, SEP = re.compile(r"[^\W_]+"), "\x1f"
SENTENCE_END = re.compile(r"[.!?。！？]+\s")


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def windows(w: list[str]):
    return (w[k : k + RUN] for k in range(len(w) - RUN + 1))


def window_hash(words_: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(SEP.join(words_))


class ItemIndex:
    """Postings (item, weight) by term, in blocks with their greatest weight."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.words, self.question = [], [], []
        for i, text in items:
            w = words(text)
            if len(w) >= RUN:
                ends = [m.end() for m in SENTENCE_END.finditer(text.rstrip())]
                self.ids.append(i)
                self.words.append(w)
                self.question.append(len(words(text[: ends[-1]])) if ends else 0)
        df: Counter = Counter()
        for w in self.words:
            df.update(set(w))
        n, mean = len(self.ids), sum(map(len, self.words)) / max(1, len(self.words))
        idf = {t: math.log(1 + (n - k + 0.5) / (k + 0.5)) for t, k in df.items()}
        held = {t for w in self.words for win in windows(w) for t in sorted(set(win), key=lambda t: (df[t], t))[:RAREST]}
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, w in enumerate(self.words):
            norm = K1 * (1 - B + B * len(w) / mean)
            weight = {t: idf[t] * k * (K1 + 1) / (k + norm) for t, k in Counter(w).items() if t in held}
            least = min(sum(weight.get(t, 0) for t in set(win)) for win in windows(w))
            for t, v in weight.items():
                self.postings[t].append((i, v / least))
        self.best = {t: max(v for _, v in p) for t, p in self.postings.items()}
        self.blocks = {t: [(p[min(k + BLOCK, len(p)) - 1][0], max(v for _, v in p[k : k + BLOCK])) for k in range(0, len(p), BLOCK)] for t, p in self.postings.items()}
        # windows by hash, in sorted arrays; the words of an item as one string with the places of its words
        self.hash = np.array([window_hash(win) for w in self.words for win in windows(w)], np.uint64)
        self.of = np.array([i for i, w in enumerate(self.words) for _ in range(len(w) - RUN + 1)], np.int32)
        self.at = np.array([k for w in self.words for k in range(len(w) - RUN + 1)], np.int32)
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.of, self.at = self.hash[order], self.of[order], self.at[order]
        self.length = [len(w) for w in self.words]
        self.text = [SEP.join(w) for w in self.words]
        self.place = [np.cumsum([0, *(len(t) + 1 for t in w)]).astype(np.int64) for w in self.words]
        del self.words

    def matches(self, passage: list[str], items: set[int]) -> list[tuple[int, int, int]]:
        """(item, place in the passage, place in the item) of all windows of the passage that are windows of the items."""
        if len(passage) < RUN:
            return []
        keys = np.array([window_hash(win) for win in windows(passage)], np.uint64)
        first, last = np.searchsorted(self.hash, keys, "left"), np.searchsorted(self.hash, keys, "right")
        out = []
        for k in np.flatnonzero(last > first):
            same = SEP.join(passage[k : k + RUN])
            for j in range(first[k], last[k]):
                i, p = int(self.of[j]), int(self.at[j])
                if i in items and self.text[i][self.place[i][p] : self.place[i][p + RUN] - 1] == same:  # hashes may collide
                    out.append((i, int(k), p))
        return out

    def above(self, terms: set[str], threshold: float = 1 - 1e-9) -> list[int]:
        """Items whose score against ``terms`` reaches the threshold: WAND with block maxima."""
        lists = [[self.postings[t], 0, self.best[t], self.blocks[t]] for t in terms]
        out = []
        while lists:
            lists.sort(key=lambda x: x[0][x[1]][0])
            total, pivot = 0.0, None
            for k, x in enumerate(lists):
                total += x[2]
                if total >= threshold:
                    pivot = k
                    break
            if pivot is None:
                return out
            item = lists[pivot][0][lists[pivot][1]][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0][lists[pivot + 1][1]][0] == item:
                pivot += 1
            # the maxima of the blocks that the item would be in
            bound, reach = 0.0, None
            for post, at, _, blocks in lists[: pivot + 1]:
                b = at // BLOCK
                while b < len(blocks) and blocks[b][0] < item:
                    b += 1
                if b < len(blocks):
                    bound += blocks[b][1]
                    reach = blocks[b][0] if reach is None else min(reach, blocks[b][0])
            if bound >= threshold:
                if lists[0][0][lists[0][1]][0] == item:
                    score = sum(x[0][x[1]][1] for x in lists[: pivot + 1])
                    if score >= threshold:
                        out.append(item)
                    to = item + 1
                else:
                    to = item
            else:  # no item up to the end of the nearest block can reach it
                to = max(item, reach) + 1 if reach is not None else item + 1
                if pivot + 1 < len(lists):
                    to = max(item + 1, min(to, lists[pivot + 1][0][lists[pivot + 1][1]][0]))
            for x in lists[: pivot + 1]:
                post, at = x[0], x[1]
                while at < len(post) and post[at][0] < to:
                    at += 1
                x[1] = at
            lists = [x for x in lists if x[1] < len(x[0])]
        return out

    def leaks(self, text: str | None) -> dict[int, tuple[int, int, int, int]]:
        """item index -> (longest run, words of the item found, of its question, words of the question)."""
        w = words(text)
        if len(w) < RUN or self.postings.keys().isdisjoint(w):
            return {}
        best, found = self.best, {}
        step = PASSAGE - RUN + 1
        for at in range(0, max(1, len(w) - RUN + 1), step):
            passage = w[at : at + PASSAGE]
            terms = best.keys() & set(passage)
            if not terms or sum(best[t] for t in terms) < 1 - 1e-9:
                continue
            reached = set(self.above(terms))
            for item, k, p in self.matches(passage, reached) if reached else ():
                found.setdefault(item, set()).add((at + k, p))
        out = {}
        for item, starts in found.items():
            longest, covered = RUN, set()
            chain: dict[tuple[int, int], int] = {}
            for a, p in sorted(starts):
                chain[a, p] = chain.get((a - 1, p - 1), RUN - 1) + 1
                longest = max(longest, chain[a, p])
                covered.update(range(p, p + RUN))
            q = self.question[item]
            out[item] = (longest, len(covered), sum(c >= q for c in covered), self.length[item] - q)
        return out


def item_blocks(items: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in blocks whose size is bounded. Held-out items are few and fixed; their number is checked, not assumed."""
    rows = items.select("item_id", "text").where(F.col("text").isNotNull())
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // ITEMS), -(-chars // ITEM_CHARS))
    at = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    return [sorted((r[0], r[1]) for r in rows.where(at == k).collect()) for k in range(parts)]


def find_leaks(documents: DataFrame, items: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, longest_run, item_share, question_share) of every document that holds a run of an item."""
    spark = documents.sparkSession
    schema = f"`{id_column}` bigint, item_id bigint, longest_run int, item_share double, question_share double"
    out = None
    for block in item_blocks(items):
        index = spark.sparkContext.broadcast(ItemIndex(block))

        def run(batches, index=index):
            ix = index.value
            for b in batches:
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for item, (longest, covered, asked, question) in ix.leaks(text).items():
                        rows.append((doc, ix.ids[item], longest, covered / ix.length[item], asked / question if question else 0.0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64()))],
                    names=[id_column, "item_id", "longest_run", "item_share", "question_share"],
                )

        part = documents.select(id_column, "text").where(F.col("text").isNotNull()).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(id_column, "item_id").agg(
        F.max("longest_run").alias("longest_run"), F.max("item_share").alias("item_share"), F.max("question_share").alias("question_share")
    )
