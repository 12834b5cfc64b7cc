"""Most similar vectors for every vector.

Method: randomly rotated one-bit codes. Within a cell of similar vectors each vector is stored as the signs of its
rotated residual to the cell's centre, with two correction scalars. A query keeps four bits per dimension; the sum of
its levels over a code's ones (a product of small whole numbers, exact in single precision) estimates its inner product
with every code, and an error bound (``SPREAD`` standard deviations) says which vectors can still be among the wanted
ones. Only those are compared exactly, in double precision.

Cells: spherical k-means centres per group (``set_name``, ``target``), one for every ``cell`` vectors but at most
``CENTRES`` in all, fitted on the driver with ``PER_CENTRE`` vectors a centre (at most ``CENTRES * PER_CENTRE``, a documented
bound; one per group is added). Every vector is indexed: it belongs to its nearest centre and is also compared in every
cell whose centre is at most ``margin`` farther (the nearest ``probes`` of them). Cells are counted; for one that holds more
than ``LARGE`` times ``cell``, centres of its own are fitted in a task on a sample of ``PER_CENTRE`` vectors a centre (at most
``CENTRES`` centres). The task that holds the cell's vectors divides them by these, so a vector is moved once to a cell,
whatever number of its smaller cells it is compared in. A cell of more than ``PLACED`` vectors is held in parts, each by a
task of its own; what else is compared there passes by, ``PASSING`` vectors at a time, and meets the vectors at home, at
most ``SPLIT`` at once. ``margin=EXACT`` with ``probes=None`` compares every vector with every other one of its group.

Disk: the number of cells a vector is compared in grows with the number of cells, so vectors are moved in waves, each for a
share of the cells (and their parts) and some ``WAVE`` rows for each vector indexed. The files of a wave's shuffle are removed
before the next; what stays is one stored form of the vectors and the lists found so far.

Exact copies are compared once, through the copy with the smallest id, and each keeps its own list.

Defined results: unusable vectors (null, wrong length, not finite, all zero) are neither queries nor results; ties go to
the smaller id; a group of one gives nothing; copies list each other with similarity 1; equal ids are taken once;
empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.tables import discard, materialise

DIM, CELL, CENTRES, PER_CENTRE, LARGE, SPLIT, SPREAD, SEED, EXACT = 64, 1200, 1024, 64, 3, 30_000, 3.0, 20240229, 2.0
#: Vectors at home in a cell that one task holds, and those it compares with them at a time.
PLACED, PASSING = 100_000, 16_384
#: Vectors that a wave moves, for each one indexed.
WAVE = 2
#: Copies fewer than this are dropped through a broadcast list, more through a join.
BROADCAST_ROWS = 500_000


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the usable vectors, and which they are."""
    n = len(column)
    offsets = column.offsets.to_numpy()
    length = np.diff(offsets)
    right = (length == dim) & ~np.asarray(column.is_null())
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    rows = np.flatnonzero(right)
    at = offsets[:-1][rows][:, None] + np.arange(dim)
    m = values[at] if len(rows) else np.zeros((0, dim), np.float32)
    good = np.isfinite(m).all(1) & (m != 0).any(1)
    return m[good], rows[good]


def named(vectors: DataFrame) -> DataFrame:
    """(id, grp, emb) of the vectors that have an id and numbers; grp is set and target."""
    rows = vectors.select(F.col("vector_id").cast("long").alias("id"), F.concat_ws("/", F.coalesce("set_name", F.lit("")), F.coalesce("target", F.lit(""))).alias("grp"), "emb")
    return rows.where(F.col("emb").isNotNull() & F.col("id").isNotNull())


def usable(rows: DataFrame, dim: int = DIM) -> DataFrame:
    """(id, grp, vec): the usable ones of ``named`` vectors, as packed floats."""

    def run(batches):
        for b in batches:
            m, at = _matrix(b.column(2), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array([x.tobytes() for x in m], pa.binary())], names=["id", "grp", "vec"])

    return rows.mapInArrow(run, "id long, grp string, vec binary")


def unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def fitted(x: np.ndarray, c: int) -> np.ndarray:
    """``c`` spherical k-means centres of unit vectors."""
    centres = x[np.random.default_rng(SEED).choice(len(x), c, replace=False)]
    for _ in range(10):
        near = (x @ centres.T).argmax(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        some = np.linalg.norm(total, axis=1) > 1e-9
        centres[some] = total[some] / np.linalg.norm(total[some], axis=1, keepdims=True)
    return centres


class Cells:
    """Centres per group, and the number of each group's first cell."""

    def __init__(self, sample: dict[str, np.ndarray], counts: dict[str, int], cell: int):
        self.centres, self.first, total = {}, {}, 0
        fine = min(1.0, CENTRES * cell / max(1, sum(counts.values())))
        for g in sorted(sample):
            x = unit(sample[g])
            self.centres[g] = fitted(x, int(np.clip(round(counts[g] * fine / cell), 1, max(1, len(x) // 2))))
            self.first[g] = total
            total += len(self.centres[g])


def fit_cells(rows: DataFrame, cell: int, dim: int) -> Cells:
    """Counts per group (one row each) and a sample of bounded size come to the driver."""
    counts = {r["grp"]: r["n"] for r in rows.groupBy("grp").agg(F.count("*").alias("n")).collect()}
    n = sum(counts.values())
    most = PER_CENTRE * min(CENTRES, max(1, n // cell) + len(counts))
    share = min(1.0, most / max(1, n))
    chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000))
    got: dict[str, dict] = {}
    for r in usable(chosen, dim).limit(2 * most).collect():
        got.setdefault(r["grp"], {})[r["id"]] = r["vec"]
    missed = [g for g in counts if g not in got]
    if missed:  # groups that the sample misses get one cell around one of their own
        first = usable(rows.where(F.col("grp").isin(missed)), dim).groupBy("grp").agg(F.min(F.struct("id", "vec")).alias("v"))
        for r in first.collect():
            got[r["grp"]] = {r["v"]["id"]: r["v"]["vec"]}
    sample = {g: np.frombuffer(b"".join(x[i] for i in sorted(x)), np.float32).reshape(len(x), -1) for g, x in got.items()}
    return Cells(sample, counts, cell)


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class Codes:
    """One-bit codes of unit vectors around a centre."""

    def __init__(self, x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        self.dim = d = x.shape[1]
        residual = x - centre
        self.norm = np.linalg.norm(residual, axis=1)
        self.rotated = (residual / np.maximum(self.norm, 1e-12)[:, None]) @ turn
        bits = self.rotated > 0
        self.ones = bits.sum(1)
        self.scale = np.clip(np.abs(self.rotated).sum(1) / np.sqrt(d), 1e-6, 1)
        self.error = np.sqrt(1 - self.scale**2) / self.scale / np.sqrt(max(1, d - 1))
        self.to_centre = x @ centre
        self.centre2 = float(centre @ centre)
        gain, root = np.maximum(self.norm, 1e-9) / (np.sqrt(d) * self.scale), np.sqrt(d)
        # the code, and below it what ``reach`` needs of it
        self.code = np.vstack([bits.T, self.ones, np.ones_like(gain), self.error * self.scale * root, np.ones_like(gain), self.to_centre / gain, 1 / gain]).astype(np.float32)

    def _asked(self, at: np.ndarray):
        """Rows ``at`` as queries: least value, step and levels of their four-bit form, and its sum."""
        q = self.rotated[at]
        low = q.min(1, keepdims=True)
        step = np.maximum((q.max(1, keepdims=True) - low) / 15, 1e-12)
        level = np.rint((q - low) / step)
        return low, step, level, (low + level * step).sum(1, keepdims=True)

    def bounds(self, other: Codes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products of rows ``at`` of ``other`` with all coded vectors, and their error."""
        low, step, level, total = other._asked(at)
        inside = (level.astype(np.float32) @ self.code[: self.dim]).astype(np.float64)  # whole numbers below 2**24
        est = (2 * (step * inside + low * self.ones) - total) / np.sqrt(self.dim) / self.scale
        both = other.norm[at][:, None] * self.norm
        slack = SPREAD * (self.error + step / np.sqrt(12) / self.scale)
        shift = other.to_centre[at][:, None] + self.to_centre - self.centre2
        return est * both + shift, slack * both

    def reach(self, other: Codes, at: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``at``, coded vector) whose estimate plus error is at least ``least``.

        The condition of ``bounds`` solved for the counted bits: what they must exceed is a product of two thin matrices,
        so a pair costs one product of its levels and bits with those beside them, and one comparison.
        """
        low, step, level, total = other._asked(at)
        norm = np.maximum(other.norm[at], 1e-9)[:, None]
        root = np.sqrt(self.dim)
        of_query = np.hstack([2 * low, -total, np.full_like(low, SPREAD), SPREAD * step / np.sqrt(12) * root, 1 / norm, (other.to_centre[at][:, None] - self.centre2 - least) / norm]) / (2 * step)
        over = np.hstack([level, of_query]).astype(np.float32) @ self.code
        return np.divmod(np.flatnonzero(over >= np.float32(-0.01)), over.shape[1])


def search(ids, x, codes, t_ids, t_x, targets, k, least):
    """(query, target, similarity): for each of the unit vectors ``x`` the k best of ``t_x`` with at least ``least``."""
    out_q, out_t, out_s = [], [], []
    for start in range(0, len(ids), 256):
        at = np.arange(start, min(start + 256, len(ids)))
        wide = np.arange(len(at))  # queries whose candidates are narrowed to those that can be among the k best
        qi, ti = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if least is not None:
            qi, ti = targets.reach(codes, at, least)
            wide = np.flatnonzero(np.bincount(qi, minlength=len(at)) > 256)
        if len(wide):
            est, err = targets.bounds(codes, at[wide])
            barred = ids[at[wide]][:, None] == t_ids
            floor = np.full(len(wide), -1.0 if least is None else least)
            if len(t_ids) > k:
                lower = np.where(barred, -2, est - err)
                floor = np.maximum(floor, np.partition(lower, len(t_ids) - k, axis=1)[:, len(t_ids) - k])
            wi, wt = np.nonzero((est + err >= floor[:, None] - 1e-9) & ~barred)
            narrow = ~np.isin(qi, wide)
            qi, ti = np.r_[qi[narrow], wide[wi]], np.r_[ti[narrow], wt]
        ok = ids[at[qi]] != t_ids[ti]
        qi, ti = qi[ok], ti[ok]
        if not len(qi):
            continue
        s = np.concatenate([np.einsum("ij,ij->i", x[at[qi[a : a + 65536]]], t_x[ti[a : a + 65536]]) for a in range(0, len(qi), 65536)]).round(12)
        ok = s >= (-2 if least is None else least)
        qi, ti, s = qi[ok], ti[ok], s[ok]
        order = np.lexsort((t_ids[ti], -s, qi))
        qi, ti, s = qi[order], ti[order], s[order]
        top = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
        out_q.append(ids[at[qi[top]]])
        out_t.append(t_ids[ti[top]])
        out_s.append(s[top])
    return out_q, out_t, out_s


def within_reach(near: np.ndarray, margin: float, probes: int | None) -> np.ndarray:
    """Of similarities to centres (vectors x centres): which cells a vector is compared in."""
    out = near >= near.max(1, keepdims=True) - margin
    if probes is not None and near.shape[1] > probes:
        out &= near >= np.partition(near, -probes, axis=1)[:, -probes, None]
    return out


def _unpacked(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def located(vectors: DataFrame, cells, margin: float, probes: int | None, every: bool, asked, dim: int) -> DataFrame:
    """(id, grp, vec, cells, near): usable vectors with the numbers of their cells, the own one first, and how near its
    centre is; those that ask nothing are in their own cell alone."""

    def run(batches):
        c = cells.value
        for b in batches:
            m, at = _matrix(b.column(2), dim)
            if not len(at):
                continue
            grp, asks = np.array(b.column(1).to_pylist(), dtype=object)[at], np.asarray(b.column(3).to_numpy(zero_copy_only=False), bool)[at]
            found: list = [None] * len(at)
            best = np.zeros(len(at))
            for g in dict.fromkeys(grp.tolist()):
                own = np.flatnonzero(grp == g)
                near = unit(m[own]) @ c.centres[g].T
                home = near.argmax(1)
                best[own] = near[np.arange(len(own)), home]
                if near.shape[1] == 1:
                    reach = np.ones_like(near, bool)
                else:
                    reach = within_reach(near, margin, probes)
                    if not every:
                        reach &= asks[own][:, None]
                for i, r, h in zip(own, reach, home):
                    found[i] = [h + c.first[g], *(z + c.first[g] for z in np.flatnonzero(r) if z != h)]
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array([x.tobytes() for x in m], pa.binary()), pa.array(found, pa.list_(pa.int32())), pa.array(best)], names=["id", "grp", "vec", "cells", "near"]
            )

    return vectors.select("id", "grp", "emb", asked.alias("asked")).mapInArrow(run, "id long, grp string, vec binary, cells array<int>, near double")


def divided(singles: DataFrame, large: DataFrame, cell: int, dim: int) -> DataFrame:
    """(cell, sub, vec): the centres of the smaller cells of each large cell. ``large`` has (cell, n)."""
    inside = singles.select(F.col("cells")[0].alias("cell"), "id", "vec").join(F.broadcast(large.select("cell", "n")), "cell")
    share = F.lit(PER_CENTRE) * F.least(F.ceil(F.col("n") / cell), F.lit(CENTRES)) / F.col("n")
    sample = inside.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share * 1_000_000)

    def fit(t: pa.Table) -> pa.Table:  # one large cell's sample, bounded by CENTRES * PER_CENTRE
        t = t.sort_by("id")
        x = unit(_unpacked(t.column("vec").combine_chunks(), dim))
        centres = fitted(x, int(np.clip(-(-t.column("n")[0].as_py() // cell), 1, min(CENTRES, max(1, len(x) // 2)))))
        return pa.table({"cell": pa.array([t.column("cell")[0].as_py()] * len(centres), pa.int32()), "sub": pa.array(range(len(centres)), pa.int32()), "vec": pa.array([v.astype(np.float32).tobytes() for v in centres], pa.binary())})

    return materialise(sample.groupBy("cell").applyInArrow(fit, "cell int, sub int, vec binary"), "centres", free=True)


class Region:
    """The vectors at home in one cell, or in a part of it, in smaller cells if the cell has some; others pass by."""

    def __init__(self, centres: np.ndarray, ids, vecs, asks, every: bool, margin: float, probes: int | None, turn, k: int, least: float | None):
        self.centres, self.every, self.margin, self.probes, self.turn, self.k, self.least = centres, every, margin, probes, turn, k, least
        self.blocks: list[list] = [[] for _ in range(max(1, len(centres)))]
        best = np.concatenate([(unit(vecs[a : a + 8192]) @ centres.T).argmax(1) for a in range(0, len(vecs), 8192)]) if len(centres) > 1 else np.zeros(len(vecs), np.int64)
        for sub, blocks in enumerate(self.blocks):
            own = np.flatnonzero(best == sub)
            x = unit(vecs[own])
            middle = x.mean(0) if len(own) else None  # one for all blocks, as codes around it are compared
            for a in range(0, len(own), SPLIT):
                at, part = own[a : a + SPLIT], x[a : a + SPLIT]
                blocks.append((ids[at], part, asks[at], Codes(part, middle, turn), middle))
        self.best = best

    def at_home(self):
        """Every vector that asks against those of its own smaller cell."""
        for blocks in self.blocks:
            for ids, x, asks, codes, middle in blocks:
                asked = codes if asks.all() else Codes(x[asks], middle, self.turn)
                for t_ids, t_x, _, targets, _ in blocks if len(asked.norm) else []:
                    yield search(ids[asks], x[asks], asked, t_ids, t_x, targets, self.k, self.least)

    def passing(self, ids, x, near_home, inside, best=None):
        """Vectors that ask against those at home in the smaller cells they reach; the other way round, if all ask or
        they are of this cell.

        ``near_home``: how near their own centre is; ``inside``: which are of this cell; ``best``: smaller cells they are
        at home in, for those of this region.
        """
        reach = np.ones((len(x), 1), bool)
        if len(self.centres):
            near = x @ self.centres.T
            reach = within_reach(near, self.margin, self.probes) & ((near >= near_home[:, None] - self.margin) | inside[:, None])
        if best is not None:
            reach[np.arange(len(x)), best] = False
        for sub, blocks in enumerate(self.blocks):
            at = np.flatnonzero(reach[:, sub])
            if not len(at) or not blocks:
                continue
            here = Codes(x[at], blocks[0][4], self.turn)
            aimed = at if self.every else at[inside[at]]
            back = here if len(aimed) == len(at) else Codes(x[aimed], blocks[0][4], self.turn)
            for t_ids, t_x, t_asks, targets, middle in blocks:
                yield search(ids[at], x[at], here, t_ids, t_x, targets, self.k, self.least)
                if len(aimed) and t_asks.any():
                    asked = targets if t_asks.all() else Codes(t_x[t_asks], middle, self.turn)
                    yield search(t_ids[t_asks], t_x[t_asks], asked, ids[aimed], x[aimed], back, self.k, self.least)


def nearest(vectors: DataFrame, k: int = 5, least: float | None = None, margin: float = 0.15, probes: int | None = 64, queries=None, cell: int = CELL, dim: int = DIM) -> DataFrame:
    """(id, other, similarity, rank): the k most similar vectors of each query (all usable ones, or those that meet
    ``queries``, a condition on ``id``) within its group, those under ``least`` left out."""
    spark = vectors.sparkSession
    source = named(vectors)
    cells = fit_cells(source, cell, dim)
    every = queries is None
    # copies are found by their numbers' bits; both hashes are of the packed form
    wanted = F.lit(True) if every else queries
    shared = spark.sparkContext.broadcast(cells)
    rows = materialise(located(source, shared, margin, probes, every, wanted, dim), "located")
    hashed = rows.select("id", "grp", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(7), "vec").alias("h2"))
    classes = hashed.groupBy("grp", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    copies = materialise(hashed.join(classes.select("grp", "h1", "h2", "rep"), ["grp", "h1", "h2"]).select("id", "rep").distinct(), "copies", free=True)
    extra = copies.where("id <> rep").select("id").distinct()
    many = extra.count() > BROADCAST_ROWS
    singles = rows.join(extra if many else F.broadcast(extra), "id", "left_anti")
    asked = wanted
    if not every:  # a copy that is asked for asks through its class
        through = copies.where(queries).select(F.col("rep").alias("id")).distinct().withColumn("through", F.lit(True))
        wide = many or through.count() > BROADCAST_ROWS
        singles, many = singles.join(through if wide else F.broadcast(through), "id", "left"), wide
        asked = wanted | F.col("through").isNotNull()
    singles = singles.select("id", "vec", "near", "cells", asked.alias("asked"))
    if many:  # whole vectors are sorted by id once, not for each wave
        singles, done = materialise(singles, "singles", free=True), rows
        discard(done)
        rows = singles
    sizes = singles.groupBy(F.col("cells")[0].alias("cell")).agg(F.count("*").alias("n"), F.sum(F.size("cells")).alias("moved")).collect()  # one row a centre
    large = [(r["cell"], r["n"], -(-r["n"] // PLACED)) for r in sizes if r["n"] > LARGE * cell]
    several = {c: p for c, _, p in large if p > 1}
    centres = parts = None
    if large:
        parts = spark.createDataFrame(large, "cell int, n long, parts int")
        centres = divided(singles, parts, cell, dim)
    # a vector is moved to each part of each cell it is compared in, for a share of the parts at once
    waves = max(1, -(-sum(r["moved"] * several.get(r["cell"], 1) for r in sizes) // (WAVE * max(1, sum(r["n"] for r in sizes)))))

    def work(batches):
        turn = rotation(dim)
        key, region = None, None
        ahead, homes, passing = [], [], []

        def found(results):
            q, t, s = [], [], []
            for result in results:
                for all_of, some in zip((q, t, s), result):
                    all_of += some
            if q:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(q)), pa.array(np.concatenate(t)), pa.array(np.concatenate(s))], names=["id", "other", "similarity"])

        def opened():
            nonlocal region, homes
            ids, asks, near, _, vecs = (np.concatenate(c) for c in zip(*homes))
            homes = []
            region = Region(np.array(ahead, np.float64).reshape(-1, dim), ids, vecs, asks, every, margin, probes, turn, k, least)
            yield from found(region.at_home())
            if len(region.centres) > 1:
                for a in range(0, len(ids), PASSING):
                    at = a + np.flatnonzero(asks[a : a + PASSING])
                    yield from found(region.passing(ids[at], unit(vecs[at]), near[at], np.ones(len(at), bool), region.best[at]))

        def passed():
            nonlocal passing
            ids, _, near, inside, vecs = (np.concatenate(c) for c in zip(*passing))
            passing = []
            yield from found(region.passing(ids, unit(vecs), near, inside))

        def closed():
            if homes:
                yield from opened()
            if passing and region:
                yield from passed()

        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(i).to_numpy() for i in range(3)], axis=1)
            ids, asks, near, inside = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3, 7))
            vecs = _unpacked(b.column(7), dim)
            starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(1)])
            for a, e in zip(starts, np.r_[starts[1:], len(at)]):
                if key != (at[a, 0], at[a, 1]):
                    yield from closed()
                    key, region = (at[a, 0], at[a, 1]), None
                    ahead, homes, passing = [], [], []
                kind, some = at[a, 2], (ids[a:e], asks[a:e], near[a:e], inside[a:e], vecs[a:e])
                if kind == 0:
                    ahead += list(vecs[a:e])
                elif kind == 1:
                    homes.append(some)
                else:
                    if homes:
                        yield from opened()
                    if region:  # a part may be without vectors of its own
                        passing.append(some)
                        if sum(len(c[0]) for c in passing) >= PASSING:
                            yield from passed()
        yield from closed()

    def wave(w: int) -> DataFrame:
        turn = lambda c, part: F.pmod(c + part, F.lit(waves)) == w
        part = F.explode(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda i: turn(F.col("cell"), i)))
        here = F.transform("cells", lambda c, z: F.struct(c.alias("cell"), (z == 0).alias("inside")))
        moved = singles.select("id", "asked", "near", "vec", F.inline(F.filter(here, lambda c: turn(c["cell"], F.lit(0)) | c["cell"].isin(*several))))
        moved = moved.join(F.broadcast(parts.select("cell", "parts")), "cell", "left").withColumn("parts", F.coalesce("parts", F.lit(1))) if large else moved.withColumn("parts", F.lit(1))
        moved = moved.withColumn("part", part)
        own = F.col("inside") & (F.pmod(F.xxhash64("id"), F.col("parts")) == F.col("part"))
        moved = moved.where(own | F.col("asked")).select("cell", "part", F.when(own, 1).otherwise(2).alias("kind"), "id", "asked", "near", "inside", "vec")
        if large:  # centres travel ahead of the vectors, once for each part of their cell
            some = centres.join(F.broadcast(parts), "cell")
            moved = moved.unionByName(some.select("cell", part.alias("part"), F.lit(0).alias("kind"), F.col("sub").cast("long").alias("id"), F.lit(False).alias("asked"), F.lit(0.0).alias("near"), F.lit(False).alias("inside"), "vec"))
        n = max(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // waves), len(sizes) // (4 * waves), min(len(sizes), 12))
        return moved.repartition(n, "cell", "part").sortWithinPartitions("cell", "part", "kind", "id").mapInArrow(work, "id long, other long, similarity double")

    if waves == 1:
        pairs = wave(0)
    else:
        pairs = None
        for w in range(waves):  # the files of a wave's shuffle are removed before the next
            got = materialise(wave(w), "pairs", free=True)
            if pairs is not None and least is None:  # lists without a least similarity are cut to k at once
                both = materialise(_top(pairs.unionByName(got).groupBy("id", "other").agg(F.max("similarity").alias("similarity")), k).drop("rank"), "pairs", free=True)
                discard(pairs)
                discard(got)
                pairs = both
            else:
                pairs = got if pairs is None else pairs.unionByName(got)
        discard(rows)
    best = _top(pairs.groupBy("id", "other").agg(F.max("similarity").alias("similarity")), k)
    # copies: a class lists its own first k + 1 members and those of its neighbours; each member skips itself
    ranked = copies.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).select("id", "rep")
    few = ranked.count()
    if not few:
        return best if every else best.where(queries)
    opening = F.broadcast(ranked) if few <= BROADCAST_ROWS else ranked
    opened = best.join(opening.withColumnsRenamed({"id": "copy", "rep": "other"}), "other", "left")
    opened = opened.select("id", F.coalesce("copy", "other").alias("other"), "similarity")
    classes_own = ranked.select(F.col("rep").alias("id"), F.col("id").alias("other"), F.lit(1.0).alias("similarity"))
    lists = _top(opened.unionByName(classes_own), k + 1)
    members = copies.withColumnsRenamed({"id": "member"}).withColumnsRenamed({"rep": "id"})
    held_by = lists.join(members, "id", "left").select(F.coalesce("member", "id").alias("id"), "other", "similarity")
    held_by = held_by.where(F.col("id") != F.col("other"))
    if not every:
        held_by = held_by.where(queries)
    return _top(held_by, k)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "other")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
