"""Near-duplicate records with small edits, over a collection too large for comparing all pairs.

Method: BagMinHash. A record is a bag of words with weights. Each word owns a stream of random points per discrete weight
level: a Poisson process over [0, weight) in which every point falls on one of ``SIZE`` signature places. The process is
drawn hierarchically: first the points of the whole range of weights, which are then handed down to the halves of the
range, so that words share their points at every weight they both have. A place keeps the smallest point over all words,
and the chance that two records agree in a place is their weighted Jaccard similarity. ``BANDS`` bands of ``ROWS`` places
are grouped (they share places, every band has its own choice of them); within a group, pairs are sifted by the last two
bits of all ``SIZE`` places, and what is left is verified on the sets of words. The sift asks for the number of agreeing
places that a pair at the wanted similarity has, less ``SIGMAS`` standard deviations, so it loses fewer than one in ten
million of the pairs that the bands find.

Weights: every word weighs the same, as in the cases' definition, so the places agree with the chance of the similarity
asked for whatever the collection holds; a family of edited texts that fills much of it makes none of its words light.
Records that have nothing in common but frequent words seldom meet because a band asks for ``ROWS`` places.

Records with the same set of words are one class and take part once, by their smallest id. Band rows travel packed, in
one piece per bucket of keys and some thousands of records; a task reads one bucket of about ``BUCKET`` bytes and finds
the groups in it by sorting. Band keys that hold more than ``block_rows(n)`` rows are looked for among the keys of a share
of the records (all of them where that is small) that is expected to hold ``SEEN`` rows of each, and split into blocks that
are compared pair by pair under keys of their own, in other buckets; an overlooked key would cost time and no pair. There
are at most ``HOT_KEYS`` of them by the definition of ``block_rows``.

Defined results: null, empty and short texts (under ``MIN_CHARS`` characters) and texts without a word belong to no
pair; ids are taken once; equal texts are pairs; the similarity is that of the sets of words (maximal runs of letters or
digits, lower-cased); other columns are ignored.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.tables import materialise

SIZE, ROWS, BANDS, LEVELS, SIGMAS = 128, 6, 56, 16, 5.3
MIN_CHARS, BLOCK_ROWS, SEEN = 80, 20_000, 400
#: Bound of the list of split keys (12 bytes each), and bytes of band rows in a bucket.
HOT_KEYS, BUCKET = 1_000_000, 32_000_000
#: A band row: its key, its record, on which side of a split key it stands (0: on none), and the sifting bits.
ROW = np.dtype([("key", "<i8"), ("id", "<i8"), ("side", "i1"), ("bits", "<u8", SIZE // 32)])
#: Fewer pairs (or ids, 8 to 16 bytes each) than this are broadcast, more are joined by shuffling.
BROADCAST_ROWS = 500_000
WORDS = re.compile(r"[^\W_]+")


def word_set(text: str) -> list[str]:
    return sorted(set(WORDS.findall(text.lower())))


def block_rows(n: int) -> int:
    """From how many rows on a band key is split: so that no more than ``HOT_KEYS`` can be, out of ``n`` records."""
    return max(BLOCK_ROWS, BANDS * n // HOT_KEYS)


def sift_at(least: float) -> int:
    """The number of places whose two bits must agree."""
    p = least + (1 - least) / 4
    return math.floor(SIZE * p - SIGMAS * math.sqrt(SIZE * p * (1 - p)))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64)."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_hash(words: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)


class Points:
    """Earliest points of words in each signature place, by weight level.

    One step of weight has rate 1 per place. The earliest point of a range of steps is known before those of its halves:
    a coin says which half it fell into, and the earliest point of the other half comes an exponential time later. Ranges
    that the weight covers count as a whole, ranges beyond it are never opened.
    """

    def __init__(self, levels: int = LEVELS, size: int = SIZE):
        self.levels, self.size = levels, size

    def first(self, h: np.ndarray, level: np.ndarray) -> np.ndarray:
        """For each word hash and its level (1..levels): the earliest point per place, as float32 (words x size)."""
        place = np.arange(self.size, dtype=np.uint64)
        with np.errstate(over="ignore"):
            seed = mix(h.astype(np.uint64)[:, None] + place[None, :] * np.uint64(0x9E3779B97F4A7C15))
        out = np.full((len(h), self.size), np.inf, np.float32)

        def later(at, node, width):
            with np.errstate(over="ignore"):
                d = mix(seed[at] ^ np.uint64(node * 0xD1B54A32D192ED03 % 2**64))
            u = ((d >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53
            return d, (-np.log(u) / width).astype(np.float32)

        every = np.arange(len(h))
        todo = [(0, self.levels, every, later(every, 1, self.levels)[1], 2)]
        while todo:
            low, high, at, point, node = todo.pop()
            whole = level[at] >= high
            out[at[whole]] = np.minimum(out[at[whole]], point[whole])
            part = ~whole & (level[at] > low)
            if not part.any():
                continue
            at, point, middle = at[part], point[part], (low + high) // 2
            d, wait = later(at, node, 1.0)
            left = (d & np.uint64(2047)).astype(np.float64) < 2048 * (middle - low) / (high - low)
            todo.append((low, middle, at, np.where(left, point, point + wait / np.float32(middle - low)), 2 * node + 1))
            todo.append((middle, high, at, np.where(left, point + wait / np.float32(high - middle), point), 2 * node + 2))
        return out


class Signer:
    """Signatures of bags; the points of words are kept in a table that is emptied when it is full."""

    def __init__(self, levels: dict[str, int], top: int = LEVELS, most: int = 60_000):
        self.level, self.top, self.most, self.points = levels, top, most, Points(top)
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, SIZE), np.float32)

    def sign(self, bags: list) -> np.ndarray:
        """uint64 (bags x SIZE): a hash of the smallest point of each place; bags must not be empty."""
        new = sorted(set().union(*bags).difference(self.index))
        if len(self.index) + len(new) > self.most and self.index:
            self.reset()
            new = sorted(set().union(*bags))
        if new:
            for k, w in enumerate(new):
                self.index[w] = len(self.table) + k
            lev = np.array([self.level.get(w, self.top) for w in new])
            h = text_hash(new)
            made = [self.points.first(h[a : a + 2000], lev[a : a + 2000]) for a in range(0, len(new), 2000)]
            self.table = np.concatenate([self.table, *made])
        ix = self.index
        at = np.array([ix[w] for b in bags for w in b])
        start = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]]
        least = np.minimum.reduceat(self.table[at], start, axis=0)
        return mix(least.view(np.uint32).astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def band_places() -> np.ndarray:
    """BANDS x ROWS places: each pass over all places deals them to bands in another order (fixed)."""
    order = np.random.RandomState(4)
    deals = -(-BANDS // (SIZE // ROWS))
    return np.concatenate([order.permutation(SIZE)[: SIZE // ROWS * ROWS].reshape(-1, ROWS) for _ in range(deals)])[:BANDS]


PLACES = band_places()


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.zeros((len(sig), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(BANDS):
            x = np.full(len(sig), b + 1, np.uint64)
            for r in range(ROWS):
                x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, PLACES[b, r]])
            out[:, b] = x
    return out.view(np.int64)


def survey(records: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One pass over all texts: (id, set) with a 128-bit hash of the set of words of each record that takes part."""

    def run(batches):
        import xxhash

        for b in batches:
            ids, hashes = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = word_set(t)
                if w:
                    ids.append(i)
                    hashes.append(xxhash.xxh3_128_digest("\n".join(w)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary())], names=["id", "set"])

    fit = records.where(F.col(id_column).isNotNull() & (F.length(text_column) >= MIN_CHARS))
    fit = fit.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    return materialise(fit.mapInArrow(run, "id long, set binary"), "survey")


def _signed(batches):
    """(ids, band keys, sifting bits) of the records (id, text) of Arrow batches."""
    signer = Signer({})
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            b = whole.slice(a, 256)
            sig = signer.sign([set(WORDS.findall(t.lower())) for t in b.column(1).to_pylist()])
            bits = np.hstack([np.packbits((sig & np.uint64(1)).astype(np.uint8), axis=1), np.packbits((sig & np.uint64(2)).astype(bool), axis=1)])
            yield b.column(0).to_numpy(), band_keys(sig), bits.view(np.uint64)


def split_rows(rows: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rows of split keys are put into the blocks they take part in: block i meets block j under key (i, j), i <= j."""
    keys, parts = hot
    if not len(keys):
        return rows
    at = np.minimum(np.searchsorted(keys, rows["key"]), len(keys) - 1)
    is_hot = keys[at] == rows["key"]
    own, n = rows[is_hot], parts[at[is_hot]]
    if not len(own):
        return rows
    out = np.repeat(own, n)
    n_of, block = np.repeat(n, n).astype(np.int64), np.repeat((mix(own["id"].astype(np.uint64)) % n.astype(np.uint64)).astype(np.int64), n)
    other = np.arange(len(out)) - np.repeat(np.cumsum(n) - n, n)
    lo, hi = np.minimum(block, other), np.maximum(block, other)
    with np.errstate(over="ignore"):
        out["key"] = mix(out["key"].astype(np.uint64) + (lo * n_of + hi + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    out["side"] = np.where(block == other, 0, np.where(block < other, 1, 2))
    return np.concatenate([rows[~is_hot], out])


def packed_bands(texts: DataFrame, hot, buckets: int) -> DataFrame:
    """(bucket, rows): the band rows of all records, packed."""

    def run(batches):
        held, n = [], 0

        def out():
            rows = np.concatenate(held)
            bucket = ((mix(rows["key"].astype(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            rows, bucket = rows[order], bucket[order]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            blobs = [rows[a:e].tobytes() for a, e in zip(start, np.r_[start[1:], len(rows)])]
            return pa.RecordBatch.from_arrays([pa.array(bucket[start]), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

        for ids, keys, bits in _signed(batches):
            rows = np.zeros(keys.size, ROW)
            rows["key"], rows["id"], rows["bits"] = keys.ravel(), np.repeat(ids, BANDS), np.repeat(bits, BANDS, axis=0)
            held.append(split_rows(rows, hot.value))
            n += len(held[-1])
            if n > 200_000:
                yield out()
                held, n = [], 0
        if held:
            yield out()

    return texts.mapInArrow(run, "bucket int, rows binary")


def _sift(needed: int):
    """For ``mapInArrow``: pairs of records whose rows have one key, in the rows of one bucket."""

    def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Agreeing places of bits that are broadcast against each other."""
        half, out = SIZE // 64, None
        for w in range(half):
            n = np.bitwise_count((x[..., w] ^ y[..., w]) | (x[..., half + w] ^ y[..., half + w]))
            out = n if out is None else out + n
        return SIZE - out.astype(np.int32)

    def pairs(rows, i, j):
        ok = (rows["id"][i] != rows["id"][j]) & ((rows["side"][i] == 0) | (rows["side"][i] != rows["side"][j]))
        a, b = rows["id"][i[ok]], rows["id"][j[ok]]
        return np.minimum(a, b), np.maximum(a, b)

    def found(rows):
        rows = rows[np.argsort(rows["key"], kind="stable")]
        start = np.flatnonzero(np.r_[True, rows["key"][1:] != rows["key"][:-1]])
        size = np.diff(np.r_[start, len(rows)])
        bits = np.ascontiguousarray(rows["bits"])
        for n in np.unique(size[size > 1]):
            first = start[size == n]
            if n > 1000:  # row against row, in blocks
                for s in first:
                    for a in range(s, s + n, 1024):
                        e = min(a + 1024, s + n)
                        i, j = np.nonzero(alike(bits[a:e, None], bits[None, a : s + n]) >= needed)
                        yield pairs(rows, i[i < j] + a, j[i < j] + a)
                continue
            i, j = np.triu_indices(n, 1)  # all groups of one size at a time
            step = max(1, 1_000_000 // len(i))
            for a in range(0, len(first), step):
                x, y = (first[a : a + step, None] + i).ravel(), (first[a : a + step, None] + j).ravel()
                ok = alike(bits[x], bits[y]) >= needed
                yield pairs(rows, x[ok], y[ok])

    def run(batches):
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for bucket, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(bucket, []).append(blob)
        for bucket in sorted(held):
            seen = [p for p in found(np.frombuffer(b"".join(held.pop(bucket)), ROW)) if len(p[0])]
            if seen:
                ab = np.unique(np.stack([np.concatenate(x) for x in zip(*seen)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], names=["a", "b"])

    return run


def _verify(least: float):
    def run(batches):
        known: dict[str, frozenset] = {}  # a text is in several pairs; long texts are not kept

        def split(text: str) -> frozenset:
            found = known.get(text)
            if found is None:
                found = frozenset(WORDS.findall(text.lower()))
                if len(known) > 4000:
                    known.clear()
                if len(text) < 10_000:
                    known[text] = found
            return found

        for b in batches:
            keep, score = [], []
            for k, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = split(x), split(y)
                both = len(x & y)
                if both >= least * (len(x) + len(y) - both) - 1e-9:
                    keep.append(k)
                    score.append(both / (len(x) + len(y) - both))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(score, pa.float64())], names=["a", "b", "similarity"])

    return run


def hot_keys(texts: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The band keys with more than ``block_rows`` rows, sorted, and into how many blocks each is split; they are found
    from half of that on."""
    limit = block_rows(n)
    share = min(1.0, SEEN / limit)
    some = texts if share == 1 else texts.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1_000_000)) < int(share * 1_000_000))

    def keys(batches):
        for _, k, _ in _signed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(k.ravel())], names=["key"])

    most = limit if share == 1 else limit * share / 2
    rows = sorted((r["key"], max(2, math.ceil(r["count"] / share / limit))) for r in some.mapInArrow(keys, "key long").groupBy("key").count().where(F.col("count") > most).collect())
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)


def near_copies(records: DataFrame, id_column: str, text_column: str, least: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, similarity) between class representatives, a < b; members (id, rep), one row per
    record that takes part. Records of one class have the same set of words."""
    spark = records.sparkSession
    sets = survey(records, id_column, text_column)
    by_set = sets.groupBy("set").agg(F.min("id").alias("rep"))
    members = materialise(sets.join(by_set, "set").select("id", "rep").distinct(), "members")
    taken, n = members.agg(F.count("*"), F.count_if(F.col("id") == F.col("rep"))).first()
    others = members.where("id <> rep").select("id")
    if taken - n <= BROADCAST_ROWS:
        others = F.broadcast(others)
    texts = records.where(F.length(text_column) >= MIN_CHARS).select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    texts = texts.where(F.col("id").isNotNull() & F.col("text").rlike(r"[\p{L}\p{N}]")).join(others, "id", "left_anti")
    hot = hot_keys(texts, n) if n > BLOCK_ROWS else (np.zeros(0, np.int64), np.zeros(0, np.int64))  # a key has a record once
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n * BANDS * ROW.itemsize // BUCKET)
    bands = packed_bands(texts, spark.sparkContext.broadcast(hot), buckets)
    pairs = materialise(bands.repartitionById(buckets, F.col("bucket")).mapInArrow(_sift(sift_at(least)), "a long, b long").distinct(), "pairs")
    # texts of the records that are in a pair are read once
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    few = pairs.count() <= BROADCAST_ROWS
    involved = materialise(texts.join(F.broadcast(ids) if few else ids, "id", "left_semi"), "involved")
    small = F.broadcast(pairs) if few else pairs
    joined = involved.withColumnsRenamed({"id": "a", "text": "text_a"}).join(small, "a").join(involved.withColumnsRenamed({"id": "b", "text": "text_b"}), "b")
    links = joined.select("a", "b", "text_a", "text_b").mapInArrow(_verify(least), "a long, b long, similarity double")
    return links.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), members


def expand(links: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of ids (a < b) that ``links`` and equal sets of words make."""
    every = links.select("a", "b").unionByName(members.where("id <> rep").select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct())
    left = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    both = every.join(left, "a").join(right, "b").where((F.col("a") != F.col("b")) | (F.col("x") < F.col("y")))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
