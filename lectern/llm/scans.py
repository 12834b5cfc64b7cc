"""Noise in text from scanned pages, and its repair into whole paragraphs.

Method: running headers are lines at page edges that repeat over the pages of a revision; they are compared in a form in
which characters that scanners confuse are the same (fuzzy repetition). Page numbers are edge lines whose number keeps
its distance to the page index. Both are removed. Lines are then joined with a vocabulary of the whole corpus: a word
cut at a line end is joined unless the corpus writes it with its hyphen in mid-line. A word is misread when undoing
confusions gives a word that is frequent in the corpus while it is not itself, or (for names, which repeat too seldom)
when its letter groups are rare in the corpus' names and those of the restored form are frequent.

The vocabulary is counted over all blocks and holds whatever occurs twice. It is never sent anywhere whole: what blocks
must know (words, cut words, first words of pages) is asked once per distinct question, the keys a question needs are
joined with the counts, and only answers that are not no go back to the blocks. Thresholds are counts in a corpus of up
to ``AT`` words and grow in proportion beyond it.

Defined results: blocks with null or empty text have no noise (an empty equation neither); a null page or revision keeps
a block out of headers, numbers and continuation, not out of the rest; a null ``malformed_math`` leaves the decision to
the text; repeated rows give repeated results once; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.islands import running_sum
from lectern.sources.tables import materialise

AT, LEAST, EDGE = 260_000, 2, 2
#: Longest line that can be furniture, and longest one that two pages are enough for; math.inf sets no bound.
LINE_CHARS, PAIR_CHARS = 100, 45
#: Longest formula between dollar signs whose inside is not read as words (a lone sign would hide what follows it).
FORMULA_CHARS = 600
#: Places of a word that can be confused and are tried, and how many of them may be at once.
SPOTS, CHANGES = 6, 3
PROSE = ("text", "list_item")
# What scanners read, and the letters that were there.
CONFUSIONS = {"0": "o", "1": "l", "5": "s", "í": "i", "rn": "m", "cl": "d", "ii": "u", "li": "h", "vv": "w", "c": "e", "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st"}
SURE = frozenset("íﬁﬂﬀﬃﬄﬅ")  # characters that the corpus' own words do not have
HYPHENS = "-­¬‐‑"
MARKUP = re.compile(rf"\$[^$]{{0,{FORMULA_CHARS}}}\$" r"|<[^<>]*>|&#?\w+;|\\cite\{[^}]*\}|\\(?:label|ref)\{[^}]*\}|\\[a-zA-Z]+|https?://\S+|\]\([^)]*\)|`[^`]*`|\{\{.*?\}\}", re.S)
#: What any markup, any cut word and any cut at the end of a text has; texts without it are not searched for them.
MAY_MARK, MAY_CUT = re.compile(r"[$<&\\`{]|://|\]\("), re.compile(rf"[{HYPHENS}]\s*(?:\n|\Z)")
WORD = re.compile(r"[^\W_]+")
CUT = re.compile(rf"(?<![^\W_])([^\W_]++)(?<=[^\W\d_])([{HYPHENS}])[ \t]*\n\s*([^\W_]++)")
CUT_AT_END = re.compile(rf"(?<![^\W_])([^\W_]++)([{HYPHENS}])\s*\Z")
COMPOUND = re.compile(r"(?<![^\W_])[^\W\d_]++(?:-[^\W\d_]++)+")
NUMBER = r"(?:\[(?P<a>\d{1,5}|[ivxlc]+)\]|(?:p\.|page|pg\.|s\.)\s*(?P<b>\d{1,5}|[ivxlc]+)|(?P<c>\d{1,5})\s*/\s*\d{1,5}|[-–—]\s*(?P<d>\d{1,5}|[ivxlc]+)\s*[-–—]|(?P<e>\d{1,5}|[ivxlc]+))"
LEADING, TRAILING = re.compile(rf"^\s*{NUMBER}(?=\s*$|\s*\||\s{{2,}})\s*\|?\s*", re.I), re.compile(rf"(?:\s*\|\s*|\s{{2,}}|^\s*){NUMBER}\s*$", re.I)
ENDS = re.compile(r"[.?!:。！？][\"'”’)\]]*$|[>}]$|^={2,}|={2,}$|\|$|```$")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def unmarked(text: str) -> str:
    """The text with a blank for every piece of markup."""
    return MARKUP.sub(" ", text) if MAY_MARK.search(text) else text


def to_number(s: str) -> int:
    if s[0].isdigit():
        return int(s)
    v = [ROMAN[c] for c in s.lower()]
    return sum(-a if b > a else a for a, b in zip(v, [*v[1:], 0]))


def parse_edge(line: str) -> tuple[str, int | None]:
    """(text of the line without a page number, the number)."""
    for rule in (LEADING, TRAILING):
        m = rule.search(line)
        if m:
            g = next(x for x in m.groupdict().values() if x)
            return (line[: m.start()] + line[m.end() :]).strip(" |"), to_number(g)
    return line.strip(), None


def canonical(s: str) -> str:
    """Letters without case and blanks, confusions undone."""
    s = "".join(WORD.findall(s.lower()))
    for a, b in CONFUSIONS.items():
        s = s.replace(a, b)
    return s


def own_lines(text: str) -> list[str]:
    return [x for x in text.split("\n") if x.strip()]


def edges(blocks: DataFrame) -> DataFrame:
    """(revision_id, page, key, offset, furniture): lines at the edges of pages that can be a header or a number.

    Only the first and the last line of each block go through the window that finds the edges of a page.
    """
    by = Window.partitionBy("revision_id", "page")
    at = blocks.where(F.col("revision_id").isNotNull() & F.col("page").isNotNull() & (F.length("text") > 0) & ~F.coalesce(F.col("kind").isin("code", "equation", "table", "figure"), F.lit(False)))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"(?U)\S"))
    outer = F.array_distinct(F.array_compact(F.array(F.try_element_at(lines, F.lit(1)), F.try_element_at(lines, F.lit(-1)))))
    outer = F.filter(outer, lambda x: F.length(x) <= F.lit(float(LINE_CHARS)))
    at = at.select(F.col("revision_id").cast("long").alias("revision_id"), F.col("page").cast("int").alias("page"), "block_index", (F.coalesce("kind", F.lit("")) == "furniture").alias("furniture"), outer.alias("lines"))
    at = at.withColumn("top", F.row_number().over(by.orderBy("block_index"))).withColumn("bottom", F.row_number().over(by.orderBy(F.desc("block_index"))))
    at = at.where((F.col("top") <= EDGE) | (F.col("bottom") <= EDGE) | F.col("furniture")).select("revision_id", "page", "furniture", F.explode("lines").alias("line"))

    def run(batches):
        for b in batches:
            keys, offsets = [], []
            for page, line in zip(b.column(1).to_pylist(), b.column(3).to_pylist()):
                rest, number = parse_edge(line)
                title_like = not rest[:1].islower() and rest[-1:] not in ".,;:?!-"
                keys.append((canonical(rest) or None) if title_like else None)
                offsets.append(None if number is None else number - page)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.string()), pa.array(offsets, pa.int32()), b.column(2)], names=["revision_id", "page", "key", "offset", "furniture"])

    return at.mapInArrow(run, "revision_id long, page int, key string, offset int, furniture boolean")


def furniture(blocks: DataFrame) -> DataFrame:
    """(revision_id, headers, offset) of each revision that has any."""
    found = materialise(edges(blocks), "edges")
    lines = found.where(F.length("key") >= 5).groupBy("revision_id", "key", "page").agg(F.max(F.col("furniture").cast("int")).alias("f"))
    often = (F.col("pages") >= 3) | (F.col("f") == 1) | ((F.col("pages") == 2) & (F.length("key") <= F.lit(float(PAIR_CHARS))))
    lines = lines.groupBy("revision_id", "key").agg(F.count("*").alias("pages"), F.max("f").alias("f")).where(often)
    headers = lines.groupBy("revision_id").agg(F.collect_list("key").alias("headers"))
    steps = found.where("offset IS NOT NULL").groupBy("revision_id", "offset", "page").agg(F.max(F.col("furniture").cast("int")).alias("f"))
    steps = steps.groupBy("revision_id", "offset").agg(F.count("*").alias("pages"), F.max("f").alias("f")).where("pages >= 2 OR f = 1")
    numbers = steps.groupBy("revision_id").agg(F.max_by("offset", F.struct("pages", "f", -F.col("offset"))).alias("offset"))
    return headers.join(numbers, "revision_id", "full")


def strip_furniture(text: str, page: int | None, headers: set[str], offset: int | None, title: bool) -> tuple[str, bool, bool, str]:
    """(text without furniture, had a header, had its page's number, the furniture)."""
    if title or (not headers and offset is None):
        return text, False, False, ""
    lines, kept, removed, header, number = text.split("\n"), [], [], False, False
    shortest = min(map(len, headers), default=math.inf)  # a ligature becomes up to three letters
    for k, line in enumerate(lines):
        if len(line) <= LINE_CHARS and line.strip() and (3 * len(line) >= shortest or (offset is not None and k in (0, len(lines) - 1))):
            rest, n = parse_edge(line)
            is_number = n is not None and offset is not None and page is not None and n - page == offset
            is_header = bool(headers) and canonical(rest if n is not None else line) in headers
            if is_header or (is_number and not rest and k in (0, len(lines) - 1)):
                header |= is_header
                number |= is_number
                removed.append(line)
                continue
        kept.append(line)
    return "\n".join(kept), header, number, "\n".join(removed)


def count_words(blocks: DataFrame) -> DataFrame:
    """(kind, key, n): words 'w', compounds 'c' and letter groups of capitalised words 'g' of prose, by part of the input."""

    def run(batches):
        words: Counter = Counter()
        names: Counter = Counter()
        compounds: Counter = Counter()

        def out():
            letters: Counter = Counter()
            for w, n in names.items():
                for g in groups(w):
                    letters[g] += n
            kinds = (("w", words), ("c", compounds), ("g", letters))
            b = pa.RecordBatch.from_arrays(
                [pa.array([k for k, c in kinds for _ in c], pa.string()), pa.array([x for _, c in kinds for x in c], pa.string()), pa.array([n for _, c in kinds for n in c.values()], pa.int64())], names=["kind", "key", "n"]
            )
            for c in (words, names, compounds):
                c.clear()
            return b

        for b in batches:
            for text in b.column(0).to_pylist():
                text = unmarked(text)
                text = CUT.sub(" ", text) if MAY_CUT.search(text) else text
                found = WORD.findall(text)
                words.update([w.lower() for w in found])
                names.update([w.lower() for w in found if len(w) > 3 and w[0].isupper()])
                if "-" in text:
                    compounds.update(COMPOUND.findall(text.lower()))
            if len(words) + len(names) + len(compounds) > 200_000:
                yield out()
        yield out()

    prose = blocks.where(F.col("kind").isin("text", "list_item", "footnote", "heading") & (F.length("text") > 0)).select("text")
    return prose.mapInArrow(run, "kind string, key string, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def groups(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 4] for i in range(len(w) - 3)]


class Corpus:
    """What the corpus writes: words, compounds, letter groups of names; of all or of what a question needs.

    ``heads`` are the beginnings of compounds (None: from ``compounds``), ``scale`` multiplies thresholds.
    """

    def __init__(self, words: dict[str, int], compounds: dict[str, int], letter_groups: dict[str, int], heads: dict[str, int] | None = None, scale: float = 1.0):
        self.words, self.compounds, self.groups, self.scale = words, compounds, letter_groups, scale
        self.heads = Counter(heads or {})
        for c, n in compounds.items() if heads is None else ():
            parts = c.split("-")
            for i in range(1, len(parts)):
                self.heads["-".join(parts[:i])] += n
        self.any_misread = True
        self.known: dict[str, bool] = {}
        self.cuts: dict[tuple[str, str, str], bool] = {}

    def cut_word(self, left: str, sign: str, right: str) -> bool:
        """Whether ``left`` and ``right`` are one word that the line end cut; answers are kept, in a bounded table."""
        key = (left, sign, right)
        found = self.cuts.get(key)
        if found is None:
            if len(self.cuts) > 300_000:
                self.cuts.clear()
            self.cuts[key] = found = self._cut_word(left, sign, right)
        return found

    def joined(self, text: str) -> str:
        """The text with cut words made whole; compounds keep their hyphen. A word can be cut twice."""

        def join(m: re.Match) -> str:
            return m.group(1) + ("" if self.cut_word(m.group(1), m.group(2), m.group(3)) else "-") + m.group(3)

        return CUT.sub(join, CUT.sub(join, text)) if MAY_CUT.search(text) else text

    def _cut_word(self, left: str, sign: str, right: str) -> bool:
        """Whether ``left`` and ``right`` are one word that the line end cut (not a compound at its own hyphen)."""
        a, b = left.lower(), right.lower()
        joined, compound = self.words.get(a + b, 0), self.compounds.get(f"{a}-{b}", 0)
        if compound and compound >= joined:
            return False
        if joined:
            return True
        for x in (restored(a + b)):
            if x in self.words:
                return True
        for x in restored(f"{a}-{b}"):
            if x in self.compounds:
                return False
        return not (sign in "-‐‑" and self.heads.get(a, 0) >= 3 * self.scale and b in self.words and len(a) > 2)

    def misread(self, word: str) -> bool:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[word] = found = self._misread(word)
        return found

    def _misread(self, word: str) -> bool:
        if not in_question(word):
            return False
        w = word.lower()
        own = self.words.get(w, 0)
        digits = sum(c.isdigit() for c in w)
        options = restored(w)
        best = max((self.words.get(x, 0) for x in options), default=0)
        if best >= 2 and best >= 8 * max(1, own):
            return True
        if any(c in SURE for c in w):
            return True
        if digits and re.fullmatch(r"[^\W\d_]*(?:[015][^\W\d_]+)+[015]?|[^\W\d_]{2,}[015]", w):
            return not own or best > own
        if own >= 4 * self.scale or not word[0].isupper():
            return False
        weak = self._weakest(w)
        return any(self._weakest(x) >= max(6 * self.scale, 12 * (weak + self.scale)) for x in options)

    def _weakest(self, w: str) -> int:
        return min((self.groups.get(g, 0) for g in groups(w)), default=0)

    def restore(self, word: str) -> str:
        """The form of a misread word that the corpus knows best, in lower case."""
        return max(restored(word.lower()), key=lambda x: (self.words.get(x, 0), self._weakest(x)), default=word)

    def is_name(self, first: str) -> bool:
        """Whether a word (in lower case) with a capital at the start of a page need not begin a sentence."""
        return first not in self.words or not first.isalpha() or (len(first) > 3 and self._weakest(first) >= 6 * self.scale and self.words[first] < 50 * self.scale and first not in STARTERS)


class Answers(Corpus):
    """A corpus of which only the answers to one block's questions are known; what is missing is no."""

    def __init__(self, answers: dict[str, str]):
        super().__init__({}, {}, {})
        self.answers = answers
        self.any_misread = any(q[0] == "m" for q in answers)

    def cut_word(self, left: str, sign: str, right: str) -> bool:
        return ask("c", left, sign, right) in self.answers

    def misread(self, word: str) -> bool:
        return self.any_misread and ask("m", word) in self.answers

    def restore(self, word: str) -> str:
        return self.answers[ask("m", word)]

    def is_name(self, first: str) -> bool:
        return ask("f", first) in self.answers


@lru_cache(100_000)
def in_question(word: str) -> bool:
    """Whether a word's form lets it be misread."""
    w = word.lower()
    if len(w) < 3 or w.isdigit():
        return False
    digits = sum(c.isdigit() for c in w)
    if digits and (not set(w) & set("015") or re.search(r"\d\d|[2346789]", w) or digits * 2 >= len(w)):
        return False
    return any(a in w for a in CONFUSIONS)


def ask(*parts: str) -> str:
    return "\x01".join(parts)


def questions(kind: str | None, text: str, head: str | None, removed: str = "") -> set[str]:
    """All that ``_look`` can ask a corpus about a block, whatever the answers are."""
    out: set[str] = set()
    if kind in ("equation", "code", "table"):
        return out
    head = (head or "").lstrip()
    first = WORD.match(head)
    if first:
        out.add(ask("f", first.group().lower()))
    may_cut = MAY_CUT.search(text) is not None
    if may_cut and (m := CUT_AT_END.search(text)):
        out.add(ask("c", m.group(1), m.group(2), first.group() if first else ""))
    forms = {text}
    for _ in range(2 if may_cut else 0):  # as ``joined``; a cut touches at most two neighbours of the round before, so parity gives all cases
        found = set()
        for form in forms:
            cuts = list(CUT.finditer(form))
            out.update(ask("c", *m.groups()) for m in cuts)
            for even, odd in product(("", "-"), repeat=2) if cuts else [("", "")]:
                signs = iter((even, odd) * (len(cuts) // 2 + 1))
                found.add(CUT.sub(lambda m: m.group(1) + next(signs) + m.group(3), form) if cuts else form)  # noqa: B023
        forms = found
    words = set(WORD.findall(removed))
    for form in forms:
        words.update(WORD.findall(form))  # joining lines changes no word
        if MAY_MARK.search(form):
            words.update(WORD.findall(MARKUP.sub(" ", form)))
    out.update(["m\x01" + w for w in words if in_question(w)])
    return out


def needed(question: str) -> set[tuple[str, str]]:
    """(kind, key) of all counts that decide a question; kinds as in ``count_words``, 'h' for heads."""
    kind, *parts = question.split("\x01")
    if kind == "c":
        a, b = parts[0].lower(), parts[2].lower()
        return {("w", x) for x in (a + b, b, *restored(a + b))} | {("c", x) for x in (f"{a}-{b}", *restored(f"{a}-{b}"))} | {("h", a)}
    w = parts[0].lower()
    forms = [w] if kind == "f" else [w, *restored(w)]
    return {("w", x) for x in forms} | {("g", g) for x in forms for g in groups(x)}


def answer(question: str, counts: list[tuple[str, str, int]], scale: float) -> str | None:
    """None: no; else what a question's answer carries."""
    kept: dict[str, dict[str, int]] = {"w": {}, "c": {}, "g": {}, "h": {}}
    for kind, key, n in counts:
        kept[kind][key] = n
    corpus = Corpus(kept["w"], kept["c"], kept["g"], kept["h"], scale)
    kind, *parts = question.split("\x01")
    if kind == "c":
        return "" if corpus.cut_word(*parts) else None
    if kind == "f":
        return "" if corpus.is_name(parts[0]) else None
    return corpus.restore(parts[0]) if corpus.misread(parts[0]) else None


def restored(w: str) -> list[str]:
    """Forms of ``w`` with one to three confusions undone (all occurrences of sure ones at once)."""
    base = "".join(CONFUSIONS[c] if c in SURE else c for c in w)
    spots = [(m.start(), a) for a in ("0", "1", "5", "rn", "cl", "ii", "li", "vv", "c") for m in re.finditer(a, base)]
    out = set() if base == w else {base}
    for pick in product((False, True), repeat=min(len(spots), SPOTS)):
        chosen = sorted((s for s, p in zip(spots, pick) if p), reverse=True)
        if not 0 < len(chosen) <= CHANGES or any(b[0] < a[0] + 0 + len(a[1]) and a[0] < b[0] + len(b[1]) for i, a in enumerate(chosen) for b in chosen[i + 1 :]):
            continue
        x = base
        for at, a in chosen:
            x = x[:at] + CONFUSIONS[a] + x[at + len(a) :]
        out.add(x)
        if "cl" in x or "1" in x:  # a letter that was read as two, one of which was misread again
            out.add(x.replace("cl", "d"))
    if "c1" in base:
        out.add(base.replace("c1", "d"))
    return sorted(out)


def answers_to(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """(question, value) of each distinct question in ``asked`` whose answer is not no."""
    counted = materialise(count_words(blocks), "words")
    total = counted.where("kind = 'w'").agg(F.sum("n")).first()[0] or 0
    scale = max(1.0, total / AT)
    known = counted.where(F.col("n") >= LEAST)
    parts = F.split("key", "-")
    ends = known.where("kind = 'c'").select("n", parts.alias("p")).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("p") - 1)))
    heads = ends.groupBy(F.lit("h").alias("kind"), F.array_join(F.slice("p", F.lit(1), F.col("i")), "-").alias("key")).agg(F.sum("n").alias("n"))

    def keys(batches):
        for b in batches:
            rows = [(q, *k) for q in b.column(0).to_pylist() for k in sorted(needed(q))]
            for a in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[a : a + 20_000])], names=["question", "kind", "key"])

    def decide(batches):
        for b in batches:
            out = []
            for q, counts in zip(*(c.to_pylist() for c in b.columns)):
                value = answer(q, [(c["kind"], c["key"], c["n"]) for c in counts], scale)
                if value is not None:
                    out.append((q, value))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], names=["question", "value"])

    needs = asked.select("question").distinct().mapInArrow(keys, "question string, kind string, key string")
    found = needs.join(known.unionByName(heads), ["kind", "key"], "left")
    # a count that is missing leaves no entry; the question stays
    facts = found.groupBy("question").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("kind", "key", "n"))).alias("counts"))
    return facts.mapInArrow(decide, "question string, value string")


def is_raw(text: str, malformed: bool | None) -> bool:
    """Whether an equation holds raw characters: no command, no braced sub- or superscript."""
    if not text.strip():
        return False
    return bool(malformed) or not re.search(r"\\[a-zA-Z|\\,;:!{]|[\^_]\{", text)


FENCE = re.compile(r"(^ {0,3}```[^\n]*\n(?:[^\n]*\n)*? {0,3}```[ \t]*$)", re.M)
LINE_END = re.compile(r"[ \t]*\n(?!\s*[-*+•] )\s*")


def one_line(text: str) -> str:
    """Lines joined, but for fenced code and list items."""
    if "```" not in text:
        return LINE_END.sub(" ", text)
    parts = FENCE.split(text)
    return "\n".join(x for k, part in enumerate(parts) if (x := part if k % 2 else LINE_END.sub(" ", part).strip()))


def repair(text: str, corpus: Corpus, misread: bool = True) -> str:
    """Lines joined, cut words made whole, misread words restored where the corpus knows the word."""
    text = one_line(corpus.joined(text))
    if not misread:
        return text
    spans = [m.span() for m in MARKUP.finditer(text)] if MAY_MARK.search(text) else []

    def fix(m: re.Match) -> str:
        w = m.group()
        if not corpus.misread(w) or any(a <= m.start() < z for a, z in spans):
            return w
        best = corpus.restore(w)
        return best.capitalize() if w[0].isupper() else best

    return WORD.sub(fix, text)


def examine(blocks: DataFrame) -> DataFrame:
    """(block_id, revision_id, page, block_index, kind, noise, clean, next, joint): one row per block that is not furniture.

    ``noise`` is an array of its kinds of noise, ``clean`` the repaired text, ``next`` the block it goes on in, ``joint``
    what comes between the two texts: nothing where the page cuts a word or a compound, else a blank.
    """
    b = blocks.select("block_id", "revision_id", "block_index", "page", "kind", "text", "malformed_math").where(F.col("kind").isNull() | (F.col("kind") != "furniture"))
    b = b.dropDuplicates(["block_id"])
    everything = blocks.select("block_id", "revision_id", "block_index", "page", "kind", "text")
    title = everything.where((F.col("kind") == "heading") & (F.col("page") == 0)).groupBy("revision_id").agg(F.min("block_index").alias("title"))
    known = furniture(everything).join(title, "revision_id", "full")
    joined = b.join(known, "revision_id", "left").select(
        F.col("block_id").cast("long"), F.col("revision_id").cast("long"), F.col("page").cast("int"), F.col("block_index").cast("int"), "kind", "text", "malformed_math", "headers", F.col("offset").cast("int").alias("offset"), (F.col("title") == F.col("block_index")).alias("title")
    )

    def strip(batches):
        for x in batches:
            c = x.to_pydict()
            got = [
                (t or "", False, False, "") if kind in ("code", "equation", "table") else strip_furniture(t or "", page, set(h or ()), o, bool(ti))
                for t, page, kind, h, o, ti in zip(c["text"], c["page"], c["kind"], c["headers"], c["offset"], c["title"])
            ]
            own = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.bool_(), pa.bool_(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*x.columns[:5], x.column(6), *own], names=["block_id", "revision_id", "page", "block_index", "kind", "malformed_math", "clean", "header", "number", "removed"])

    fields = "block_id long, revision_id long, page int, block_index int, kind string, malformed_math boolean, clean string, header boolean, number boolean, removed string"
    stripped = materialise(joined.mapInArrow(strip, fields), "stripped")
    prose = stripped.where(F.col("kind").isin(*PROSE) & F.col("clean").rlike(r"\S"))
    ends = prose.groupBy("revision_id", "page").agg(F.max(F.struct("block_index", "block_id")).alias("last"), F.min(F.struct("block_index", "block_id", F.regexp_extract("clean", r"(?U)^\s*(\S+)", 1).alias("head"))).alias("first"))
    after = ends.select("revision_id", (F.col("page") - 1).alias("page"), F.col("first.head").alias("head"), F.col("first.block_id").alias("next"))
    tails = ends.join(after, ["revision_id", "page"]).select(F.col("last.block_id").alias("block_id"), "head", "next")
    both = stripped.join(tails, "block_id", "left")

    def inquire(batches):
        for x in batches:
            c = x.to_pydict()
            found = [sorted(questions(kind, text or "", head, gone or "")) for kind, text, head, gone in zip(*(c[k] for k in ("kind", "clean", "head", "removed")))]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(found, pa.list_(pa.string()))], names=["block_id", "questions"])

    inquired = both.select("block_id", "kind", "clean", "head", "removed").mapInArrow(inquire, "block_id long, questions array<string>")
    asked = materialise(inquired.select("block_id", F.explode("questions").alias("question")), "questions")
    told = asked.join(answers_to(asked, everything), "question").groupBy(F.col("block_id").alias("told")).agg(F.collect_list(F.struct("question", "value")).alias("answers"))
    both = both.join(told, F.col("block_id").eqNullSafe(F.col("told")), "left")

    def look(batches):
        for x in batches:
            c = x.to_pydict()
            noise, text, goes, joint = [], [], [], []
            for k in range(x.num_rows):
                corp = Answers({a["question"]: a["value"] for a in c["answers"][k] or ()})
                n, t, go = _look(corp, c["kind"][k], c["clean"][k] or "", c["malformed_math"][k], c["head"][k], c["removed"][k] or "")
                t, between = page_joint(t, c["head"][k], corp) if go else (t, "")
                joint.append(between)
                noise.append([*n, *(["header"] if c["header"][k] else []), *(["page_number"] if c["number"][k] else [])])
                text.append(t)
                goes.append(c["next"][k] if go else None)
            yield pa.RecordBatch.from_arrays(
                [*(x.column(i) for i in range(5)), pa.array(noise, pa.list_(pa.string())), pa.array(text, pa.string()), pa.array(goes, pa.int64()), pa.array(joint, pa.string())],
                names=["block_id", "revision_id", "page", "block_index", "kind", "noise", "clean", "next", "joint"],
            )

    both = both.select("block_id", "revision_id", "page", "block_index", "kind", "malformed_math", "clean", "header", "number", "head", "next", "removed", "answers")
    return both.mapInArrow(look, "block_id long, revision_id long, page int, block_index int, kind string, noise array<string>, clean string, next long, joint string")


def page_joint(text: str, head: str | None, corpus: Corpus) -> tuple[str, str]:
    """A text that goes on on the next page, and what joins it to what begins with ``head``. A cut word loses its hyphen,
    a compound keeps it; neither gets a blank."""
    m = CUT_AT_END.search(text)
    if m is None:
        return text, " "
    follow = WORD.match((head or "").lstrip())
    cut = corpus.cut_word(m.group(1), m.group(2), follow.group() if follow else "")
    return (text[: m.end(1)] if cut else text.rstrip()), ""


def goes_on(text: str, head: str | None, corpus: Corpus) -> bool:
    """Whether a paragraph that ends with ``text`` stops in mid-sentence and ``head`` carries it on."""
    text, head = text.rstrip(), (head or "").lstrip()
    if not head or not text or ENDS.search(text.rpartition("\n")[2]):
        return False
    if not head[0].isupper():
        return head[0].islower() or head[0] in "$([" or head[0].isdigit()
    return corpus.is_name(WORD.match(head).group().lower())


# Words that begin a sentence.
STARTERS = frozenset("the a an any every each all some no this that these those it if when where while since suppose let hence thus moreover however for in on by to under from we as proof".split())


def _look(corpus: Corpus, kind: str | None, text: str, malformed: bool | None, head: str | None, removed: str = "") -> tuple[list[str], str, bool]:
    if kind == "equation":
        return (["formula"] if is_raw(text, malformed) else []), text, False
    if kind in ("code", "table"):
        return [], text, False
    noise, go = [], False
    if kind in PROSE and text.strip():
        go = goes_on(text, head, corpus)
        plain = text
        may_cut = MAY_CUT.search(plain) is not None
        cut = may_cut and any(corpus.cut_word(m.group(1), m.group(2), m.group(3)) for m in CUT.finditer(plain))
        m = CUT_AT_END.search(plain) if may_cut else None
        if m and not cut:
            follow = WORD.match((head or "").lstrip())
            cut = corpus.cut_word(m.group(1), m.group(2), follow.group() if follow else "")
        if cut:
            noise.append("broken_word")
        if go:
            noise.append("continued")

    whole = corpus.joined(text)
    misread = corpus.any_misread and any(corpus.misread(w) for w in WORD.findall(f"{unmarked(whole)}\n{removed}"))
    if misread:
        noise.append("misread")
    return noise, repair(text, corpus, misread), go


def find_noise(blocks: DataFrame) -> DataFrame:
    return examine(blocks).select("block_id", F.explode("noise").alias("noise")).distinct()


def paragraphs_of(blocks: DataFrame) -> DataFrame:
    """(revision_id, paragraph, first_block, kind, page, text): each revision's text as whole paragraphs."""
    seen = materialise(examine(blocks), "examined")
    kept = seen.where(F.col("clean").rlike(r"\S"))
    carried = kept.where("next IS NOT NULL").select(F.col("next").alias("block_id"), F.lit(True).alias("carried")).distinct()
    prose = kept.where(F.col("kind").isin(*PROSE)).join(carried, "block_id", "left")
    starts = running_sum(prose, ["revision_id"], "block_index", F.when(F.col("carried"), 0).otherwise(1))
    starts = starts.withColumn("paragraph", F.col("before") + F.when(F.col("carried"), 0).otherwise(1))
    parts = starts.groupBy("revision_id", "paragraph").agg(F.array_sort(F.collect_list(F.struct("block_index", "block_id", "page", "kind", "clean", "joint"))).alias("p"))
    joined = F.trim(F.array_join(F.transform("p", lambda x: F.concat(x["clean"], x["joint"])), ""))
    prose = parts.select("revision_id", F.expr("p[0].block_index").alias("block_index"), F.expr("p[0].block_id").alias("first_block"), F.expr("p[0].kind").alias("kind"), F.expr("p[0].page").alias("page"), joined.alias("text"))
    rest = kept.where(F.col("kind").isNull() | ~F.col("kind").isin(*PROSE)).select("revision_id", "block_index", F.col("block_id").alias("first_block"), "kind", "page", F.col("clean").alias("text"))
    return prose.unionByName(rest)
