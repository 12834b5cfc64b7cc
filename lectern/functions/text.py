"""Hashes, words, full-text queries and trigram similarity."""


import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's ``str.split`` sees it; neither ``\s`` nor its Unicode form is the same set.
BLANKS = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with white space runs collapsed; null for null."""
    return F.sha2(collapsed(text), 256)


def canonical_hash(value) -> str:
    """SHA-256 of canonical JSON: sorted keys, compact, ASCII-escaped."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()


@F.arrow_udf(T.StringType())
def input_hash(request: pa.Array) -> pa.Array:
    """Hash of what a chunk's request depends on: structs (title, section, paragraphs, prompt, model), the paragraphs
    being structs (position, content_hash, kind)."""
    made = []
    for r in request.to_pylist():
        held = [[p["position"], p["content_hash"], p["kind"]] for p in r["paragraphs"] or []]
        made.append(canonical_hash({"title": r["title"], "section": list(r["section"] or []), "paragraphs": held, "prompt": r["prompt"], "model": r["model"]}))
    return pa.array(made, pa.string())


def casefold(text: Column) -> Column:
    """The text without differences of case, letters that become two among them (sharp s, ligatures)."""
    return F.translate(F.lower(F.upper(text)), "\u03c2", "\u03c3")


def words(text: Column) -> Column:
    """Lower-cased maximal runs of letters or digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


# --- full text -------------------------------------------------------------------------------------------------


class Terms:
    """A parsed query: alternatives of required and barred phrases (a single word is a phrase of one)."""

    def __init__(self, alternatives: list[tuple[list[list[str]], list[list[str]]]]):
        self.alternatives = alternatives

    def __bool__(self) -> bool:
        return bool(self.alternatives)


_PIECES = re.compile(r'(-?)"([^"]*)"|(-?)(\S+)')


def websearch(query: str) -> Terms:
    """Quoted text is a phrase, ``or`` separates alternatives, a leading ``-`` bars, all else must occur."""
    out: list[tuple[list[list[str]], list[list[str]]]] = [([], [])]
    for m in _PIECES.finditer(query or ""):
        quoted = m.group(2) is not None
        text, barred = (m.group(2), m.group(1)) if quoted else (m.group(4), m.group(3))
        if not quoted and text.lower() == "or":
            out.append(([], []))
            continue
        phrase = [w.lower() for w in re.findall(r"[^\W_]+", text)]
        if phrase:
            out[-1][1 if barred else 0].append(phrase)
    return Terms([a for a in out if a[0] or a[1]])


def matches(tokens: Column, query: Terms) -> Column:
    """Whether a text's words satisfy the query; an empty query matches nothing."""

    def phrase(p: list[str]) -> Column:
        if len(p) == 1:
            return F.array_contains(tokens, p[0])
        return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(" " + " ".join(p) + " "))

    hit = F.lit(False)
    for must, barred in query.alternatives:
        one = F.lit(True)
        for p in must:
            one = one & phrase(p)
        for p in barred:
            one = one & ~phrase(p)
        hit = hit | one
    return hit


def split_words(text: str) -> list[str]:
    """As ``words``, in Python."""
    return re.findall(r"[^\W_]+", text.lower())


def _phrase_at(positions: dict[str, list[int]], phrase: list[str]) -> bool:
    if len(phrase) == 1:
        return phrase[0] in positions
    if any(w not in positions for w in phrase):
        return False
    starts = set(positions[phrase[0]])
    for k, w in enumerate(phrase[1:], 1):
        starts &= {i - k for i in positions[w]}
    return bool(starts)


def _covers(positions: dict[str, list[int]], wanted: set[str]) -> float:
    """Sum over minimal covers of (terms / sum of 1 / weight) / (1 + words between); weight 0.1 each."""
    last: dict[str, int] = {}
    total, begun = 0.0, -1
    for i, w in sorted((i, w) for w in wanted for i in positions.get(w, ())):
        last[w] = i
        if len(last) == len(wanted) and (start := min(last.values())) > begun:
            begun = start
            total += 0.1 / (1 + (i - start + 1 - len(wanted)))
    return total


def terms_score(positions: dict[str, list[int]], query: Terms) -> float | None:
    """The rank of a text given where the query's words stand in it; null if it does not match. With one term that is
    0.1 per occurrence."""
    hit, total = False, 0.0
    for must, barred in query.alternatives:
        if all(_phrase_at(positions, p) for p in must) and not any(_phrase_at(positions, p) for p in barred):
            hit = True
        wanted = {w for p in must for w in p}
        total += _covers(positions, wanted) if wanted else 0.0
    return total if hit else None


def cover_density(tokens: list[str], query: Terms) -> float:
    positions: dict[str, list[int]] = {}
    for i, w in enumerate(tokens):
        positions.setdefault(w, []).append(i)
    return sum(_covers(positions, {w for p in must for w in p}) for must, _ in query.alternatives if must)


# --- trigrams ----------------------------------------------------------------------------------------------------


def trigrams(text: str) -> list[str]:
    """Three-letter pieces of each word, padded by two blanks before and one after, in order."""
    return [p[i : i + 3] for w in re.findall(r"[^\W_]+", text.lower()) for p in [f"  {w} "] for i in range(len(p) - 2)]


def word_similarity(a: str, b: str) -> float:
    """The best ratio of shared to all trigrams between ``a`` and a contiguous extent of ``b``'s trigrams.

    An extent that is worth considering begins and ends with a trigram of ``a``.
    """
    wanted, seq = set(trigrams(a)), trigrams(b)
    if not wanted or not seq:
        return 0.0
    hits = [i for i, t in enumerate(seq) if t in wanted]
    best = 0.0
    for k, i in enumerate(hits):
        seen: set[str] = set()
        both = 0
        j = i
        for end in hits[k:]:
            for t in seq[j : end + 1]:
                if t not in seen:
                    seen.add(t)
                    both += t in wanted
            j = end + 1
            best = max(best, both / (len(wanted) + len(seen) - both))
            if both == len(wanted) or len(wanted) / (len(seen) or 1) <= best:
                break  # a longer extent only adds foreign trigrams
    return best
