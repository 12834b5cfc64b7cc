"""Processing only new or changed records: log-based change capture.

Deliveries are appended to a log. Each append has a number, handed out by creating a file of that name, and is split
into partitions by a hash of the record key; a row's *offset* in its partition is (number of the append, row number in
the append), both given when it is appended. Event times have no part in it: what arrives late lies at the log's end.

A run

1. writes its *plan* before it touches a record: for each partition the offset it starts after (where the last committed
   run ended) and the offset it ends at, the appends between them, and the commit it builds upon,
2. reads those appends only and reduces them to one version per key (greatest ``modified_at``, then ``delivery_id``),
3. looks up the same keys in the state and finds those whose value is new or changed,
4. writes the winners under their key and offset, marked if changed; they are both the sink's rows and the next layer of
   the state,
5. creates the commit mark, whose number is one more than that of the commit it builds upon.

A run that dies leaves a plan without a mark, and its rows are not visible. The next call with the same run id replays
exactly that plan; another run id plans anew from the last commit, so nothing is skipped. Once a later run has committed,
an older plan is void and its run plans anew. The sink holds a (key, offset) once: rows of a dead attempt at the same
commit number are removed before they are written again, and rows at or below a partition's committed offset are
dropped.

The state is a base and the layers of the commits since; every ``compact_every`` commits a new base is written. So a run
reads its own appends, at most ``compact_every`` layers and the base's partitions that it touches, however long the
history is.

``replay`` does the same for many runs of a known history (catching up): all plans are written ahead, those of runs that
did not succeed stay void, and the others are processed in one pass, in order, each with its own commit.

Defined results: deliveries with a null key part or a null ``arrived_at`` belong to no run; a null ``modified_at`` loses
against any other; a null hash means withdrawn and gives no change; hashes are compared without letter case and outer
whitespace; repeated deliveries count once; empty inputs give empty outputs; extra columns are ignored. Of runs that
started at the same moment the one with the smallest id takes the changes.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources.files import Folder
from lectern.sources.tables import shared_dir, temporary

KEY = ["revision_id", "position"]
VERSION = "struct<modified_at:timestamp,delivery_id:bigint,hash:string>"
LAYER = f"revision_id long, position int, version {VERSION}, append long, n long, changed boolean, commit long, part int"


class Void(RuntimeError):
    """Another run has committed since the plan was written."""


def clean_hash(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def capture(rows: DataFrame, partitions: int, *also: str) -> DataFrame:
    """What the log keeps of each delivery: partition, key and version."""
    usable = F.col("revision_id").isNotNull() & F.col("position").isNotNull() & F.col("arrived_at").isNotNull()
    version = F.struct("modified_at", F.col("delivery_id").cast("long").alias("delivery_id"), clean_hash(F.col("content_hash")).alias("hash"))
    return rows.where(usable).select(
        F.col("revision_id").cast("long").alias("revision_id"), F.col("position").cast("int").alias("position"), F.pmod(F.xxhash64(*KEY), F.lit(partitions)).cast("int").alias("part"), version.alias("version"), *also
    )


def is_change(old: Column, new: Column) -> Column:
    """``new`` and ``old`` are versions; a missing old one is null."""
    return new["hash"].isNotNull() & (old.isNull() | old["hash"].isNull() | (old["hash"] != new["hash"]))


def number(k: int) -> str:
    return f"{k:012d}"


class IncrementalRuns:
    """Runs over a growing log, each under a write-ahead plan. One driver runs at a time; two that race for a plan or a
    commit get ``Void``. ``root`` is a folder that driver and executors share; ``partitions`` is fixed when it is made.

    Layout: ``log/append=<n>/part=<p>``, ``appends/<n>.json`` (makes an append visible, with its last offsets),
    ``plans/<n>.json``, ``layers/commit=<n>/part=<p>``, ``base/<n>/part=<p>``, ``commits/<n>.json``.
    """

    def __init__(self, spark: SparkSession, root: str, partitions: int = 16, compact_every: int = 16):
        self.spark, self.folder, self.compact_every = spark, Folder(spark, root), compact_every
        self.folder.create("log.json", {"partitions": partitions})
        self.partitions = self.folder.read("log.json")["partitions"]

    # --- the log -------------------------------------------------------------------------------------------------

    def append(self, rows: DataFrame, turn: Column | None = None) -> None:
        """Put deliveries at the log's end, as one append, or as one for each value of ``turn`` (numbers from 0)."""
        first = int((self.folder.names("appends") or ["-1"])[-1].removesuffix(".json")) + 1
        stage = f"incoming/{uuid.uuid4().hex}"
        turned = rows.withColumn("_turn", F.lit(0) if turn is None else turn).where("_turn IS NOT NULL")
        captured = capture(turned, self.partitions, "_turn")
        spread = captured.withColumn("append", (F.col("_turn") + first).cast("long")).drop("_turn").repartition("append", "part")
        spread.withColumn("n", F.monotonically_increasing_id()).write.partitionBy("append", "part").parquet(self.folder.at(stage))
        if not any(x.startswith("append=") for x in self.folder.names(stage)):
            return
        written = self.spark.read.schema("n long, append long, part int").parquet(self.folder.at(stage))
        ends: dict[int, dict[str, list[int]]] = {}
        for r in written.groupBy("append", "part").agg(F.max("n").alias("last"), F.count("*").alias("rows")).collect():  # one row per append and partition
            ends.setdefault(r["append"], {})[str(r["part"])] = [r["last"], r["rows"]]
        for a in sorted(ends):
            if not self.folder.move(f"{stage}/append={a}", f"log/append={a}") or not self.folder.create(f"appends/{number(a)}.json", {"ends": ends[a]}):
                raise Void(f"append {a} was written by another driver")
        self.folder.remove(stage)

    def appends(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self.folder.names("appends")]

    # --- plans and commits ---------------------------------------------------------------------------------------

    def commits(self) -> list[dict]:
        return [self.folder.read(f"commits/{x}") for x in self.folder.names("commits")]

    def last(self) -> dict:
        """The last commit; before the first one, where it would have ended."""
        names = self.folder.names("commits")
        return self.folder.read(f"commits/{names[-1]}") if names else {"commit": -1, "plan": -1, "append": -1, "ends": {}}

    def plan(self, run_id: int, since: dict | None = None, upto: int | None = None) -> dict:
        """The plan of a run: the pending one of this run (replay), or a new one from ``since`` (the last commit) to the
        log's end (or the append ``upto``). It is on disk before it is returned."""
        plans = self.folder.names("plans")
        last = since or self.last()
        if plans and since is None:
            pending = self.folder.read(f"plans/{plans[-1]}")
            if pending["run_id"] == run_id and pending["base"] == last["commit"] and pending["plan"] > last["plan"]:
                return pending
        new = [a for a in self.appends() if a > last["append"] and (upto is None or a <= upto)]
        ends = dict(last["ends"])
        for a in new:
            ends |= {part: [a, n] for part, (n, _) in self.folder.read(f"appends/{number(a)}.json")["ends"].items()}
        touched = sorted(p for p in ends if ends[p] != last["ends"].get(p))
        made = {"plan": len(plans), "run_id": run_id, "base": last["commit"], "after": last["ends"], "ends": ends, "appends": new, "append": max([last["append"], *new]), "parts": touched}
        if not self.folder.create(f"plans/{number(made['plan'])}.json", made):
            raise Void(f"plan {made['plan']} was written by another driver")
        return made

    def run(self, run_id: int, fail_at: str | None = None) -> None:
        """One run; nothing happens if it has committed before. ``fail_at`` is for tests: the step to die before."""
        if any(c["run_id"] == run_id for c in self.commits()):
            return
        self.process([self.plan(run_id)], fail_at)

    def replay(self, runs: list[tuple[int, int, bool]], fail_at: str | None = None) -> None:
        """Catch up on (run id, last append it saw, whether it succeeded), in order."""
        last, plans = self.last(), []
        done = {c["run_id"] for c in self.commits()}
        for run_id, upto, succeeded in runs:
            if run_id in done:
                continue
            plan = self.plan(run_id, last, upto)
            if succeeded:
                plans.append(plan)
                last = {"commit": last["commit"] + 1, "plan": plan["plan"], "append": plan["append"], "ends": plan["ends"]}
        self.process(plans, fail_at)

    def process(self, plans: list[dict], fail_at: str | None = None) -> None:
        """Execute plans that follow each other; the first one builds upon the last commit."""
        base = self.last()["commit"]
        if not plans:
            return
        if [p["base"] for p in plans] != [base + k for k in range(len(plans))]:
            raise Void(f"plan {plans[0]['plan']} builds upon commit {plans[0]['base']}, the last one is {base}")
        if fail_at == "process":
            raise RuntimeError("died before processing")
        for k in range(len(plans)):  # rows of a dead attempt at these commits
            self.folder.remove(f"layers/commit={base + 1 + k}")
        turn = {a: base + 1 + k for k, p in enumerate(plans) for a in p["appends"]}
        if turn:
            self.layers(turn, plans).write.mode("append").partitionBy("commit", "part").parquet(self.folder.at("layers"))
        if fail_at == "commit":
            raise RuntimeError("died before the commit")
        for k, p in enumerate(plans):
            if not self.folder.create(f"commits/{number(base + 1 + k)}.json", p | {"commit": base + 1 + k}):
                raise Void(f"commit {base + 1 + k} was made by another driver")
        self.compact()

    def layers(self, turn: dict[int, int], plans: list[dict]) -> DataFrame:
        """The rows of the commits of ``turn`` (append -> commit): one per key and commit, with what it became."""
        log = self.spark.read.schema(f"revision_id long, position int, version {VERSION}, n long, append long, part int").option("basePath", self.folder.at("log"))
        log = log.parquet(*[self.folder.at(f"log/append={a}") for a in sorted(turn)])
        # one row per partition: what the sink has already
        held = self.spark.createDataFrame([(int(p), a, n) for p, (a, n) in plans[0]["after"].items()], "part int, held_append long, held_n long")
        beyond = F.col("held_append").isNull() | (F.col("append") > F.col("held_append")) | ((F.col("append") == F.col("held_append")) & (F.col("n") > F.col("held_n")))
        log = log.join(F.broadcast(held), "part", "left").where(beyond)
        commit = self.spark.createDataFrame(list(turn.items()), "append long, commit long")  # one row per append of these plans
        batch = log.join(F.broadcast(commit), "append").groupBy(*KEY, "part", "commit").agg(F.max(F.struct("version", "append", "n")).alias("w"))
        batch = batch.select(*KEY, "part", "commit", "w.*")
        state = self.state(sorted({p for plan in plans for p in plan["parts"]}))
        if state is not None:
            known = state.join(batch.select(*KEY).distinct(), KEY, "left_semi")
            none = F.lit(None).cast("long")
            batch = batch.unionByName(known.select(*KEY, "part", F.lit(-1).cast("long").alias("commit"), "version", none.alias("append"), none.alias("n")))
        # few rows per key are left; a log partition is one task from here on, which writes one file per commit
        batch = batch.repartition(self.partitions, "part")
        w = Window.partitionBy("part", *KEY).orderBy("commit")
        now = F.max("version").over(w.rowsBetween(Window.unboundedPreceding, 0))
        old = F.max("version").over(w.rowsBetween(Window.unboundedPreceding, -1))
        merged = batch.withColumn("now", now).withColumn("old", old).where("commit >= 0")
        return merged.select(*KEY, F.col("now").alias("version"), "append", "n", is_change(F.col("old"), F.col("now")).alias("changed"), "commit", "part")

    # --- state and sink ------------------------------------------------------------------------------------------

    def sources(self) -> tuple[str | None, list[str]]:
        """(folder of the base, folders of the layers since): all that the state is read from."""
        base = self.folder.read("base.json") if self.folder.exists("base.json") else None
        since = base["commit"] if base else -1
        made = {int(x.partition("=")[2]) for x in self.folder.names("layers")}
        layers = [f"layers/commit={c}" for c in range(since + 1, self.last()["commit"] + 1) if c in made]
        return (base["folder"] if base else None), layers

    def state(self, parts: list[str] | None = None) -> DataFrame | None:
        """(key, part, version) of every key that was ever delivered, or of some partitions."""
        base, layers = self.sources()
        found = []
        if base:
            found.append(self.spark.read.schema(f"revision_id long, position int, version {VERSION}, part int").parquet(self.folder.at(base)))
        if layers:
            found.append(self._layers(layers).select(*KEY, "version", "part"))
        if not found:
            return None
        both = found[0] if len(found) == 1 else found[0].unionByName(found[1])
        if parts is not None:
            both = both.where(F.col("part").isin([int(p) for p in parts]))
        return both.groupBy(*KEY, "part").agg(F.max("version").alias("version"))

    def _layers(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(LAYER).option("basePath", self.folder.at("layers")).parquet(*[self.folder.at(x) for x in names])

    def compact(self) -> None:
        """Write a new base if enough layers have gathered; the layers stay, as they are the sink."""
        _, layers = self.sources()
        if len(layers) < self.compact_every:
            return
        commit, name = self.last()["commit"], f"base/{uuid.uuid4().hex}"
        self.state().repartition("part").write.partitionBy("part").parquet(self.folder.at(name))
        self.folder.replace("base.json", {"commit": commit, "folder": name})

    def sink(self) -> DataFrame:
        """(run_id, key, content_hash, part, append, n): what committed runs gave out, once per key and offset."""
        runs = [(c["commit"], c["run_id"]) for c in self.commits()]
        made = {int(x.partition("=")[2]) for x in self.folder.names("layers")}
        names = [f"layers/commit={c}" for c, _ in runs if c in made]
        rows = self._layers(names) if names else self.spark.createDataFrame([], LAYER)
        run = self.spark.createDataFrame(runs, "commit long, run_id int")  # one row per commit
        return rows.where("changed").join(F.broadcast(run), "commit").select("run_id", *KEY, F.col("version.hash").alias("content_hash"), "part", "append", "n")


def history(rows: DataFrame, runs: DataFrame, partitions: int = 8, root: str | None = None) -> DataFrame:
    """(run_id, revision_id, position): what each run that succeeded took.

    The deliveries are appended in the order in which the runs saw them (what arrived up to a run's start and after the
    one before), then the runs are replayed: plans of all, commits of those that succeeded. The list of runs is the
    driver's own record, one plan file each. ``partitions`` is the number of log partitions, which is also the number of
    tasks that keep the state.
    """
    spark = rows.sparkSession
    order = [(r["run_id"], r["at"], r["status"] == "succeeded") for r in runs.where("started_at IS NOT NULL").select("run_id", F.unix_micros("started_at").alias("at"), "status").orderBy("started_at", "run_id").collect()]
    bounds = np.array([at for _, at, _ in order], np.int64)
    last = len(bounds)

    @F.arrow_udf(T.LongType())
    def seen_by(at: pa.Array) -> pa.Array:
        """The first run that started when or after a delivery arrived; null if none did."""
        k = np.searchsorted(bounds, at.to_numpy(zero_copy_only=False), side="left")
        return pa.array(k, pa.int64(), mask=k == last)

    job = IncrementalRuns(spark, root or temporary(f"{shared_dir(spark)}/lectern-runs-{uuid.uuid4().hex}", spark), partitions, compact_every=64)
    job.append(rows.where("arrived_at IS NOT NULL"), seen_by(F.unix_micros("arrived_at")))
    job.replay([(run_id, k, succeeded) for k, (run_id, _, succeeded) in enumerate(order)])
    return job.sink().select("run_id", *KEY)
