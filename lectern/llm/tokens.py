"""Encoding of the whole corpus with a public byte-level BPE vocabulary.

Method: prefix dynamic programming. For every byte prefix of a word there is exactly one token that a correct encoding of
that prefix can end with. ``PrefixTable`` stores it: the token ``t`` of the bytes ``[i-n, i)`` ends prefix ``i`` exactly
when the pair (last token of prefix ``i-n``, ``t``) is one that merging would leave alone. The encoding is read off
backwards, an append only adds entries, and an edit needs new entries only from the edit on until the words meet the
old ones again (``Encoded``).

Splitting: the vocabulary's own pattern cuts a text into words. As the pattern looks at nothing before a match, a text
may also be cut before any single blank that a non-blank follows; the pieces between such cuts repeat so often that each
worker keeps their ids in a table (emptied when it is full, so its size is bounded; nothing is left out).

Defined results: a null, an empty text -> an empty list; blank texts have the ids of their blanks; special tokens'
strings are ordinary text; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# The split pattern of the public vocabulary, white space as the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Entries of a worker's table of pieces; a full one is emptied.
PIECES = 300_000


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    try:
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.tiktoken")
    except ImportError:
        return os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")


class Vocabulary:
    """Ranks, and for each token the two tokens that its last merge joins (the token itself if merging never makes it).

    Built once on the driver and broadcast; its size is that of the vocabulary file.
    """

    def __init__(self, content: bytes):
        self.rank = {base64.b64decode(t): int(r) for t, r in (x.split() for x in content.splitlines() if x)}
        self.bytes = {r: t for t, r in self.rank.items()}
        self.left, self.right, self.joined = {}, {}, {}
        for r, t in self.bytes.items():
            parts = self.merge(t, r) if len(t) > 1 else []
            if len(parts) == 2:
                self.left[r], self.right[r] = parts
                self.joined[parts[0], parts[1]] = r
            else:
                self.left[r] = self.right[r] = r
        #: tokens that are the encoding of their own bytes
        self.whole = {t: r for t, r in self.rank.items() if len(t) == 1 or self.left[r] != r}
        #: each ending of such a token: the token, or -1 if the ending itself is none
        self.endings = {t[i:]: -1 for t in self.whole for i in range(1, len(t))} | self.whole

    def merge(self, word: bytes, below: int) -> list[int]:
        """Plain merging with the ranks under ``below``: lowest rank first, leftmost of equals."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranked = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1], below)) < below]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def stays(self, left: int, right: int) -> bool:
        """Whether merging the bytes of ``left`` and ``right`` gives back these two tokens.

        Both are undone, the later merge first (of equal ranks the right one, as merging goes from left to right); at
        no stage may the two tokens at the border have merged earlier than the merge that was undone last.
        """
        until, joined, lefts, rights = 1 << 40, self.joined.get, self.left, self.right
        while True:
            across = joined((left, right))
            if across is not None and across < until:
                return False
            undo_left = left > right
            if undo_left and rights[left] != left:
                until, left = left, rights[left]
            elif lefts[right] != right:
                until, right = right + 1, lefts[right]
            elif rights[left] != left:
                until, left = left, rights[left]
            else:
                return True


class PrefixTable:
    """The last token of each byte prefix of one word."""

    def __init__(self, vocabulary: Vocabulary, word: bytes = b""):
        self.v, self.word, self.last = vocabulary, b"", [-1]
        self.append(word)

    def append(self, more: bytes) -> None:
        v, last, start = self.v, self.last, len(self.word)
        self.word = word = self.word + more
        endings, stays = v.endings.get, v.stays
        for end in range(start + 1, len(word) + 1):
            for begin in range(end - 1, -1, -1):
                t = endings(word[begin:end])  # None: no token ends so, nor with more before it
                if t is None:
                    raise ValueError("a byte is missing in the vocabulary")
                if t >= 0 and (begin == 0 or stays(last[begin], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("a byte is missing in the vocabulary")

    def tokens(self) -> list[int]:
        out, end = [], len(self.word)
        while end:
            t = self.last[end]
            out.append(t)
            end -= len(self.v.bytes[t])
        return out[::-1]


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pieces: int = PIECES):
        self.v, self.pattern, self.most = vocabulary, regex.compile(PATTERN), pieces
        self.split = self.pattern.findall
        self.words: dict[str, array] = {}
        self.after_blank: dict[str, array] = {}

    def word(self, w: str) -> array:
        found = self.words.get(w)
        if found is None:
            if len(self.words) >= self.most:
                self.words.clear()
            raw = w.encode()
            one = self.v.whole.get(raw)
            found = array("i", [one] if one is not None else PrefixTable(self.v, raw).tokens())
            self.words[w] = found
        return found

    def plain(self, text: str) -> array:
        out = array("i")
        for w in self.split(text):
            out += self.word(w)
        return out

    def encode(self, text: str | None) -> array:
        if not text:
            return array("i")
        parts = text.split(" ")
        known = self.after_blank
        out = self.plain(parts[0])
        try:
            for p in parts[1:]:
                out += known[p]
            return out
        except KeyError:
            pass
        for p in parts[1:]:
            if p not in known:
                if not p or p[0].isspace():
                    return self.plain(text)  # runs of blanks: the pattern decides where they are cut
                if len(known) >= self.most:
                    known.clear()
                if len(p) <= 100:
                    known[p] = self.plain(f" {p}")
        out = self.plain(parts[0])
        for p in parts[1:]:
            out += known.get(p) or self.plain(" " + p)
        return out

    def reencode(self, text: str, ids: list[list[int]], start: int, end: int, new: str) -> tuple[str, list[list[int]]]:
        """Replace ``text[start:end]`` by ``new``; ``ids`` are those of each word of ``text``."""
        document = Encoded(self, text, ids)
        document.edit(start, end, new)
        return document.text, document.words


class Encoded:
    """A text with the ids of its words, kept up to date under edits and appends.

    Only words from the last cut before an edit to the first common cut behind it are split and encoded anew; the rest of
    the text is copied, not looked at.
    """

    def __init__(self, encoder: Encoder, text: str, words: list[list[int]] | None = None):
        pieces = encoder.split(text)
        self.encoder, self.text = encoder, text
        self.words = [list(encoder.word(w)) for w in pieces] if words is None else list(words)
        self.starts = np.cumsum([0, *map(len, pieces)])[:-1]

    def ids(self) -> list[int]:
        return [t for w in self.words for t in w]

    def append(self, new: str) -> int:
        return self.edit(len(self.text), len(self.text), new)

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace ``text[start:end]`` by ``new``; gives how many words were encoded."""
        # the word before the one that is hit may have stopped because of what follows it
        k = max(0, int(np.searchsorted(self.starts, start, "right")) - 2)
        changed, shift = self.text[:start] + new + self.text[end:], len(new) - (end - start)
        words, starts, i = [], [], len(self.words)
        for m in self.encoder.pattern.finditer(changed, int(self.starts[k]) if len(self.starts) else 0):
            old = m.start() - shift
            if m.start() >= start + len(new) and old >= end:
                j = int(np.searchsorted(self.starts, old))
                if j < len(self.starts) and self.starts[j] == old:
                    i = j
                    break
            words.append(list(self.encoder.word(m.group())))
            starts.append(m.start())
        self.words[k:i] = words
        self.starts = np.concatenate([self.starts[:k], np.array(starts, self.starts.dtype), self.starts[i:] + shift])
        self.text = changed
        return len(words)


def encode_corpus(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of every row's text. One pass, no shuffle; the vocabulary (under 1 MB) is broadcast."""
    with open(vocabulary_path(path), "rb") as f:
        content = f.read()
    key, vocabulary = hashlib.sha256(content).hexdigest(), documents.sparkSession.sparkContext.broadcast(Vocabulary(content))
    kept: list[Encoder] = []

    def run(batches):
        if not kept:
            kept.append(_shared(key, vocabulary))
        encode = kept[0].encode
        for b in batches:
            lists = [encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = array("i")
            for x in lists:
                flat += x
            values = pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=[id_column, "ids"])

    kind = documents.schema[id_column].dataType.simpleString()
    return documents.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, ids array<int>")


_encoders: dict[str, Encoder] = {}


def _shared(key: str, vocabulary) -> Encoder:
    """One encoder per worker process; later tasks go on with its tables."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary.value)
    return _encoders[key]
