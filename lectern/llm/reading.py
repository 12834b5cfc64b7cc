"""Reading level of each document: gradient-boosted regression trees over text measures.

Measures (``MEASURES``) cover length, vocabulary (word lengths, repetition, how demanding the words of graded texts were),
syntax (sentence and clause lengths, punctuation) and cohesion (words shared by neighbouring sentences, pronouns), each
as a distribution over the words, the sentences or quarters of the text, so that a text is judged as a whole.

Training: at most ``TRAIN_ROWS`` labelled documents of ``TRAIN_CHARS`` characters in all (those with the smallest hash of their id; a documented bound), one
label per document: the median of its raters' grades. Cross-validation leaves out whole sources; the left-out
predictions fit an isotonic curve (calibration), and the final model is trained on all rows. Everything else covers all
documents: the measures are taken from every whole text, in one pass without a shuffle. The model (some 100 kB) and the
word table (at most ``WORDS`` entries) are broadcast.

Defined results: null, empty, blank texts, and texts without a word, get level null; null grades and labels of
unknown documents are ignored; without any label every level is null; repeated rows give repeated results; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAIN_CHARS = 50_000_000
TRAIN_ROWS, WORDS, FOLDS, TREES, RATE, DEPTH, BINS, LEAF = 2000, 20_000, 5, 160, 0.08, 4, 48, 6
TOKEN = re.compile(r"[^\W_]+|[.!?。！？]+|[,;:、，；]|\n+")
# English words that join or refer.
JOINING = frozenset("and but or so because when while although since if after before whereas unless that which hence thus therefore provided insofar notwithstanding irrespective".split())
REFERRING = frozenset("it he she they them him her this these those its their his i you we".split())
MEASURES = [
    *("words", "letters", "letters_sd", "long7", "long10", "long13", "short3", "vowels", "vowels4", "capital", "digit"),
    *("distinct", "once", "graded", "graded_sd", "graded_low", "graded_high", "known"),
    *("sentence", "sentence_sd", "sentence_max", "clause", "clause_max", "commas", "breaks", "stops", "hyphens"),
    *("joining", "referring", "shared", "repeated"),
    *(f"graded_q{i}" for i in range(4)), *(f"letters_q{i}" for i in range(4)), *(f"sentence_q{i}" for i in range(4)),
]
VOWELS = re.compile(r"[aeiouyäöüéèêàáíóú]+")


class Measurer:
    """Measures of texts; words are looked up once and then kept, in a table that is emptied when it is full."""

    def __init__(self, graded: dict[str, float] | None = None, most: int = 300_000):
        self.graded, self.most = graded or {}, most
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.rows: list[tuple] = []
        self.table = np.zeros((0, 9))

    def _row(self, w: str) -> tuple:
        if not w[0].isalnum():
            stop, comma, line = w[0] in ".!?。！？", w[0] in ",;:、，；", w[0] == "\n"
            return (-1 if stop else -2 if comma else -3, 0, 0, 0, 0, 0, 0, 0, 0)
        low = w.lower()
        g = self.graded.get(low, np.nan)
        return (len(w), len(VOWELS.findall(low)), w[0].isupper(), any(c.isdigit() for c in w), g, low in JOINING, low in REFERRING, 0, 0)

    def codes(self, tokens: list[str]) -> list[int]:
        index = self.index
        try:
            return [index[t] for t in tokens]
        except KeyError:
            for t in set(tokens).difference(index):
                index[t] = len(self.rows)
                self.rows.append(self._row(t))
            return [index[t] for t in tokens]

    def measure(self, texts: list[str]) -> np.ndarray:
        """One row of measures per text; nan where a text has no word."""
        if len(self.index) > self.most:
            self.reset()
        lists = [self.codes(TOKEN.findall(t)) for t in texts]
        if len(self.table) < len(self.rows):
            self.table = np.vstack([self.table, np.array(self.rows[len(self.table) :], float)])
        n = len(texts)
        out = np.full((n, len(MEASURES)), np.nan)
        code = np.array([c for x in lists for c in x], np.int64)
        if not len(code):
            return out
        doc = np.repeat(np.arange(n), [len(x) for x in lists])
        kind = self.table[code, 0]
        # a sentence ends at a stop or a line break; a clause at any mark
        ends = (kind == -1) | (kind == -3)
        sentence = np.cumsum(ends) - ends
        clause = np.cumsum(kind < 0)
        word = kind > 0
        line_breaks, commas, stops = (np.bincount(doc[kind == k], minlength=n) for k in (-3, -2, -1))
        doc, code, sentence, clause = doc[word], code[word], sentence[word], clause[word]
        sentence = sentence + doc  # texts that stop without a mark
        clause = clause + doc
        t = self.table[code]
        letters, vowels, graded = t[:, 0], t[:, 1], t[:, 4]
        count = np.bincount(doc, minlength=n).astype(float)
        some = count > 0
        c = np.where(some, count, np.nan)
        mean = lambda v: np.bincount(doc, weights=v, minlength=n) / c
        sd = lambda v, m: np.sqrt(np.maximum(0, mean(v * v) - m * m))
        known = ~np.isnan(graded)
        guess = np.where(known, graded, 1.5 + 0.2 * np.minimum(letters, 14))
        m_len, m_grade = mean(letters), mean(guess)
        cols = [np.log1p(count), m_len, sd(letters, m_len), mean(letters >= 7), mean(letters >= 10), mean(letters >= 13), mean(letters <= 3), mean(vowels), mean(vowels >= 4), mean(t[:, 2]), mean(t[:, 3])]
        # distinct words and the sentence in which a word was seen last: sorted by text, word, place
        order = np.lexsort((np.arange(len(doc)), code, doc))
        d, k, s = doc[order], code[order], sentence[order]
        same = np.r_[False, (d[1:] == d[:-1]) & (k[1:] == k[:-1])]
        first = ~same
        distinct = np.bincount(d[first], minlength=n)
        only = first & np.r_[~same[1:], True]
        long_word = self.table[k, 0] >= 4
        step = np.r_[0, np.diff(s)]
        shared = np.bincount(d[same & long_word & (step == 1)], minlength=n)
        again = np.bincount(d[same & long_word], minlength=n)
        cols += [distinct / c, np.bincount(d[only], minlength=n) / c, m_grade, sd(guess, m_grade), mean(guess < 2.2), mean(guess > 3.7), mean(known)]

        def runs(label):
            start = np.flatnonzero(np.r_[True, label[1:] != label[:-1]])
            return np.diff(np.r_[start, len(label)]).astype(float), doc[start]

        long_s, doc_s = runs(sentence)
        long_c, doc_c = runs(clause)
        per = lambda at, v: np.bincount(at, weights=v, minlength=n)
        n_s, n_c = per(doc_s, np.ones(len(doc_s))), per(doc_c, np.ones(len(doc_c)))
        n_s, n_c = np.where(n_s, n_s, np.nan), np.where(n_c, n_c, np.nan)
        m_s = per(doc_s, long_s) / n_s
        top_s, top_c = np.zeros(n), np.zeros(n)
        np.maximum.at(top_s, doc_s, long_s)
        np.maximum.at(top_c, doc_c, long_c)
        cols += [m_s, np.sqrt(np.maximum(0, per(doc_s, long_s**2) / n_s - m_s**2)), top_s, per(doc_c, long_c) / n_c, top_c, commas / c, line_breaks / c, stops / c, np.array([x.count("-") for x in texts]) / c]
        cols += [mean(t[:, 5]), mean(t[:, 6]), shared / c, again / c]
        # by quarter of the text
        at = np.arange(len(doc)) - np.r_[0, np.cumsum(count)][:-1].astype(int)[doc]
        cell = doc * 4 + np.minimum(3, (at * 4 // np.maximum(1, count[doc])).astype(int))
        size = np.bincount(cell, minlength=4 * n).astype(float)
        fill = lambda v, whole: np.where(size.reshape(n, 4) > 0, np.bincount(cell, weights=v, minlength=4 * n).reshape(n, 4) / np.maximum(size, 1).reshape(n, 4), whole[:, None])
        own = np.repeat(long_s, long_s.astype(int))
        for v, whole in ((guess, m_grade), (letters, m_len), (own, mean(own))):
            cols += list(np.sort(fill(v, whole), axis=1).T)
        out = np.column_stack(cols)
        out[~some] = np.nan
        return out


class Boosted:
    """Regression trees on binned columns, each fitted to the residuals of those before."""

    def fit(self, x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Boosted:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        n, d = b.shape
        self.base, self.trees = float(y.mean()), []
        pred = np.full(n, self.base)
        flat = b + np.arange(d) * BINS
        for _ in range(trees):
            residual = y - pred
            node = np.zeros(n, np.int64)
            column, cut, value = np.full(2**DEPTH - 1, -1), np.zeros(2**DEPTH - 1, np.int64), np.zeros(2 ** (DEPTH + 1) - 1)
            for level in range(DEPTH):
                first, width = 2**level - 1, 2**level
                at = ((node - first)[:, None] * (d * BINS) + flat).ravel()
                size = np.bincount(at, minlength=width * d * BINS).reshape(width, d, BINS)
                total = np.bincount(at, weights=np.repeat(residual, d), minlength=width * d * BINS).reshape(width, d, BINS)
                nl, sl = size.cumsum(2), total.cumsum(2)
                n_all, s_all = nl[:, :, -1:], sl[:, :, -1:]
                nr, sr = n_all - nl, s_all - sl
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where((nl >= LEAF) & (nr >= LEAF), sl**2 / (nl + 1) + sr**2 / (nr + 1) - s_all**2 / (n_all + 1), -1)
                best = gain.reshape(width, -1).argmax(1)
                for w in range(width):
                    if gain[w].ravel()[best[w]] > 1e-9:
                        column[first + w], cut[first + w] = divmod(best[w], BINS)
                c = column[node]
                right = np.where(c >= 0, b[np.arange(n), np.maximum(c, 0)] > cut[node], False)
                node = 2 * node + 1 + right
            leaf = np.bincount(node, minlength=len(value))
            value = np.bincount(node, weights=residual, minlength=len(value)) / (leaf + 1.0) * RATE
            pred += value[node]
            self.trees.append((column, cut, value))
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)]).astype(np.int64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._bin(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for column, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                c = column[node]
                node = 2 * node + 1 + np.where(c >= 0, b[rows, np.maximum(c, 0)] > cut[node], False)
            out += value[node]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing curve nearest to (x, y)."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            p, q = blocks[-2], blocks.pop()
            w = p[2] + q[2]
            blocks[-1] = [(p[0] * p[2] + q[0] * q[2]) / w, (p[1] * p[2] + q[1] * q[2]) / w, w]
    return np.array([b[0] for b in blocks]), np.array([b[1] for b in blocks])


def word_grades(texts: list[str], y: np.ndarray) -> dict[str, float]:
    """For the most frequent words of graded texts: the mean grade of the texts they are in, pulled to the mean."""
    total, seen = defaultdict(float), Counter()
    for t, g in zip(texts, y):
        for w in {w.lower() for w in TOKEN.findall(t) if w[0].isalnum()}:
            total[w] += g
            seen[w] += 1
    m = float(y.mean()) if len(y) else 3.0
    return {w: (total[w] + 2 * m) / (k + 2) for w, k in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:WORDS] if k >= 3}


class Levels:
    """The trained model: word table, trees, calibration, and its left-out results."""

    def fit(self, texts: list[str], y: np.ndarray, sources: list[str]) -> Levels:
        names = sorted(set(sources))
        fold_of = {s: i % FOLDS for i, s in enumerate(sorted(names, key=lambda s: (-sources.count(s), s)))}
        folds = np.array([fold_of[s] for s in sources])
        if len(names) < FOLDS:
            folds = np.arange(len(y)) % FOLDS
        out = np.full(len(y), np.nan)
        for k in range(FOLDS):
            a, b = np.flatnonzero(folds != k), np.flatnonzero(folds == k)
            if len(a) < 4 * LEAF or not len(b):
                continue
            words, x = self._crossed([texts[i] for i in a], y[a])
            out[b] = Boosted().fit(x, y[a]).predict(Measurer(words).measure([texts[i] for i in b]))
        ok = ~np.isnan(out)
        self.words, x = self._crossed(texts, y)
        self.trees = Boosted().fit(x, y)
        self.curve = isotonic(out[ok], y[ok]) if ok.sum() > 50 else None
        self.left_out = (out, y, folds)
        # a source's predictions are calibrated by a curve of the other sources' ones
        self.left_out_calibrated = out.copy()
        for k in range(FOLDS):
            own, rest = ok & (folds == k), ok & (folds != k)
            if own.any() and rest.sum() > 50:
                self.left_out_calibrated[own] = np.interp(out[own], *isotonic(out[rest], y[rest]))
        return self

    @staticmethod
    def _crossed(texts: list[str], y: np.ndarray) -> tuple[dict[str, float], np.ndarray]:
        """Measures for training; a text's own grade must not reach them, so its word table comes from other texts."""
        part = np.arange(len(y)) % 4
        x = np.empty((len(y), len(MEASURES)))
        for k in range(4):
            own = np.flatnonzero(part == k)
            if len(own):
                rest = np.flatnonzero(part != k)
                x[own] = Measurer(word_grades([texts[i] for i in rest], y[rest])).measure([texts[i] for i in own])
        return word_grades(texts, y), x

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return raw if self.curve is None else np.interp(raw, *self.curve)


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Levels | None:
    """Fit on at most ``rows`` labelled documents with at most ``TRAIN_CHARS`` characters; None if there are too few."""
    grade = labels.where(F.col("grade").isNotNull()).groupBy("doc_id").agg(F.median("grade").alias("grade"))
    chosen = grade.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    if chosen.isEmpty():
        return None
    known = documents.select("doc_id", "text", "source").join(F.broadcast(chosen), "doc_id").where(F.col("text").rlike(r"\w")).dropDuplicates(["doc_id"])
    # whole texts, as many as fit; the window runs over at most ``rows`` rows
    upto = known.select("doc_id", F.sum(F.length("text")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")).alias("upto")).where(F.col("upto") <= TRAIN_CHARS)
    got = known.join(F.broadcast(upto.select("doc_id")), "doc_id", "left_semi").collect()
    got.sort(key=lambda r: r["doc_id"])
    if len(got) < 8 * LEAF:
        return None
    return Levels().fit([r["text"] for r in got], np.array([float(r["grade"]) for r in got]), [r["source"] or "" for r in got])


def reading_levels(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, only=None) -> DataFrame:
    """(doc_id, level): the calibrated grade, 1.0 to 5.0, of each document (of those that meet the condition ``only``)."""
    model = train(documents, labels, rows)
    scored = documents if only is None else documents.where(only)
    if model is None:
        return scored.select("doc_id", F.lit(None).cast("double").alias("level"))
    small = documents.sparkSession.sparkContext.broadcast((model.words, model.trees, model.curve))
    kept: list = []

    def run(batches):
        if not kept:
            words, trees, curve = small.value
            kept.append((Measurer(words), trees, curve))
        measurer, trees, curve = kept[0]
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                x = measurer.measure([t or "" for t in b.column(1).to_pylist()])
                ok = ~np.isnan(x[:, 0])
                level = np.full(len(x), np.nan)
                if ok.any():
                    raw = trees.predict(x[ok])
                    level[ok] = raw if curve is None else np.interp(raw, *curve)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(level, mask=~ok)], names=["doc_id", "level"])

    return scored.select("doc_id", "text").mapInArrow(run, "doc_id bigint, level double")
