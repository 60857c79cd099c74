"""Exactly one copy of each message of an at-least-once source.

The store keeps the winning delivery of every message in partitions by the day
on which it was received. An identifier index, in buckets by hash of the
identifier, tells in which partition the winner of an identifier lies. An
upsert reads the buckets that its identifiers fall into, recomputes the winners
of the partitions found there and the incoming rows together, and replaces only
those partitions and buckets.

A store is a folder: data in subfolders of a name of their own, and numbered
commits, each a manifest that names the folder of every partition and bucket.
A commit is one atomic rename that fails if the number is taken, so readers see
whole states, a writer lost half-way leaves the old one, and of two writers
that began at one state the second is refused (``Conflict``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import _fs, remove
from .names import free_name

#: Numbers of batches that the manifest remembers; an older one that comes again is taken in again, which changes nothing.
KEPT_BATCHES = 1000
#: Buckets of the identifier index, fixed when a store is made.
BUCKETS = 32


class Conflict(RuntimeError):
    """Another writer has committed since this store was opened or refreshed; nothing was changed. ``refresh`` and try again."""


@dataclass
class MessageStore:
    """A deduplicated table of messages at ``path``.

    ``keys`` identify a message; a null in any of them means that the row can't
    be identified: of such rows each delivery is kept once, or all, if that is null
    too. Of the deliveries
    of a message the first by ``received`` wins, then the smallest
    ``delivery``; nulls lose to anything. Payloads play no part, and neither do
    other columns: rows that agree in keys, time and delivery are one delivery,
    of which one row is kept. ``step`` is called before each step of an upsert
    (for tests of what a crash there leaves).
    """

    spark: SparkSession
    path: str
    keys: list[str]
    received: str
    delivery: str
    buckets: int = BUCKETS
    manifest: dict = field(default_factory=dict)
    step: Callable[[str], None] = lambda name: None

    def __post_init__(self) -> None:
        self.refresh()

    def refresh(self) -> None:
        """Go to the newest commit."""
        last = max((int(n) for n in _names(self.spark, f"{self.path}/commits") if n.isdigit()), default=0)
        text = _read_text(self.spark, f"{self.path}/commits/{last:012d}/manifest.json") if last else None
        self.manifest = json.loads(text) if text else {"version": 0, "parts": {}, "index": {}, "batches": {}, "buckets": self.buckets}

    @property
    def part(self) -> str:
        """The partition column; its name is fixed by the first batch, so that it clashes with none of the columns."""
        return self.manifest["part"]

    # -- reading

    def partitions(self, names: list[str] | None = None) -> list[str]:
        """Folders of the partitions named, or of all."""
        parts = self.manifest["parts"]
        return [f"{self.path}/data/{v}/{self.part}={p}" for p, v in parts.items() if names is None or p in names]

    def read(self, names: list[str] | None = None) -> DataFrame | None:
        """The kept messages; None if there are none yet."""
        folders = self.partitions(names)
        return self.spark.read.parquet(*folders) if folders else None

    def index_folders(self, buckets: list[int] | None = None) -> list[str]:
        return [f"{self.path}/index/{v}/bucket={b}" for b, v in self.manifest["index"].items() if buckets is None or int(b) in buckets]

    def index(self, buckets: list[int] | None = None) -> DataFrame | None:
        """(keys, part_day) of every winner in the buckets named, or in all."""
        folders = self.index_folders(buckets)
        return self.spark.read.parquet(*folders).select(*self.keys, F.col(self.part)) if folders else None

    # -- writing

    def day(self) -> Column:
        return F.coalesce(F.date_format(self.received, "yyyy-MM-dd"), F.lit("none"))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.manifest["buckets"])).cast("int")

    def upsert(self, incoming: DataFrame, batch: int | None = None) -> DataFrame:
        """Take in a batch; returns (delivery) of the surplus deliveries that this batch settles.

        A batch with a number that the store has taken in before changes
        nothing and returns what it returned then; one without a number that
        comes again changes nothing either, as its rows meet themselves.

        Each task cuts its rows to one per message before the exchange, so a
        message delivered a million times is a row per task there.
        """
        done = self.manifest["batches"].get(str(batch))
        if done is not None:
            return self.spark.read.parquet(f"{self.path}/surplus/{done}")
        state = json.loads(json.dumps(self.manifest))
        self.manifest.setdefault("part", free_name(incoming.columns, "part_day"))
        keyed = F.lit(True)
        for k in self.keys:
            keyed = keyed & F.col(k).isNotNull()
        touched: list[str] = []
        hit: list[int] = []
        history = index = None
        if self.manifest["parts"]:
            ids = incoming.where(keyed).select(*self.keys).distinct()
            # buckets are a fixed number, days one value per calendar day, whatever the size of the store
            hit = sorted(r[0] for r in ids.select(self.bucket().alias("b")).distinct().collect())
            days = incoming.select(self.day().alias(self.part)).distinct()
            if hit and (index := self.index(hit)) is not None:
                days = days.unionByName(index.join(ids, self.keys, "left_semi").select(self.part).distinct()).distinct()
            touched = sorted({r[0] for r in days.collect()} & set(self.manifest["parts"]))
            history = self.read(touched) if touched else None
        rows = incoming if history is None else incoming.unionByName(history.select(*incoming.columns))
        own = f"{self.manifest['version'] + 1:012d}-{uuid.uuid4().hex[:12]}"
        # what a writer lost on the way leaves behind is named by no commit; ``vacuum`` removes it
        new, buckets = self._write(rows, incoming, keyed, index, own)
        state["part"] = self.part
        state["parts"] = {p: old for p, old in state["parts"].items() if p not in touched} | {p: own for p in new}
        state["index"] = {b: old for b, old in state["index"].items() if int(b) not in hit} | {b: own for b in buckets}
        state["version"] += 1
        state["batches"] = dict(list((state["batches"] | ({} if batch is None else {str(batch): own})).items())[-KEPT_BATCHES:])
        self.step("commit")
        self._commit(state)
        return self.spark.read.parquet(f"{self.path}/surplus/{own}")

    def _write(self, rows: DataFrame, incoming: DataFrame, keyed: Column, index: DataFrame | None, own: str) -> tuple[list[str], list[str]]:
        """Write the new partitions, the surplus and the new buckets; returns the names of partitions and buckets."""
        rank = free_name(rows.columns, "__rank")
        first = [F.asc_nulls_last(self.received), F.asc_nulls_last(self.delivery)]
        winners = rows.where(keyed).withColumn(rank, F.row_number().over(Window.partitionBy(*self.keys).orderBy(*first))).where(F.col(rank) == 1)
        # rows that can't be identified: one of each delivery
        same = Window.partitionBy(*self.keys, self.received, self.delivery).orderBy(F.lit(0))
        loose = rows.where(~keyed).withColumn(rank, F.row_number().over(same)).where((F.col(rank) == 1) | F.col(self.delivery).isNull())
        kept = winners.unionByName(loose).drop(rank).withColumn(self.part, self.day())
        self.step("data")
        # files of even size by day: adaptive execution splits a day that holds a large share of the rows
        data = f"{self.path}/data/{own}"
        kept.hint("rebalance", self.part).write.partitionBy(self.part).mode("overwrite").parquet(data)
        new = [n.split("=", 1)[1] for n in _names(self.spark, data) if "=" in n]
        fresh = self.spark.read.option("basePath", data).parquet(data).where(keyed).withColumn(self.part, F.col(self.part).cast("string")) if new else None
        self.step("surplus")
        lost = rows.where(keyed & F.col(self.delivery).isNotNull()).select(self.delivery)
        if fresh is not None:
            lost = lost.join(fresh.select(self.delivery), self.delivery, "left_anti")
        lost.distinct().write.mode("overwrite").parquet(f"{self.path}/surplus/{own}")
        if fresh is None:
            return new, []
        self.step("index")
        # the buckets hit anew: the winners written, and the other identifiers of the buckets
        places = fresh.select(*self.keys, self.part)
        if index is not None:
            places = places.join(incoming.where(keyed).select(*self.keys).distinct(), self.keys, "left_semi")
            places = places.unionByName(index.join(places, self.keys, "left_anti"))
        folder = f"{self.path}/index/{own}"
        places.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(folder)
        return new, [n.split("=", 1)[1] for n in _names(self.spark, folder) if "=" in n]

    def _commit(self, state: dict) -> None:
        """Rename a folder with the manifest to the next number, which only one writer can."""
        own = uuid.uuid4().hex
        aside, target = f"{self.path}/commits/.{own}", f"{self.path}/commits/{state['version']:012d}"
        _write_text(self.spark, f"{aside}/manifest.json", json.dumps(state | {"writer": own}))
        jvm = self.spark.sparkContext._jvm
        path, none = jvm.org.apache.hadoop.fs.Path, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            if _read_text(self.spark, f"{target}/manifest.json") is None:
                context.rename(path(aside), path(target), none)
        except Exception:  # the number is taken: the look below tells
            pass
        # file systems that would move into a folder of the name: whose manifest stands there?
        got = _read_text(self.spark, f"{target}/manifest.json")
        if got is None or json.loads(got).get("writer") != own:
            remove(self.spark, aside)
            raise Conflict(f"version {state['version']} of {self.path} was committed by another writer")
        self.manifest = state

    def vacuum(self) -> None:
        """Remove what the newest commit doesn't name. Call it when there are no other readers or writers."""
        self.refresh()
        m = self.manifest
        for kind, current, name in (("data", m["parts"], m.get("part")), ("index", m["index"], "bucket")):
            named = {(v, f"{name}={p}") for p, v in current.items()}
            for v in _names(self.spark, f"{self.path}/{kind}"):
                for p in _names(self.spark, f"{self.path}/{kind}/{v}"):
                    if "=" in p and (v, p) not in named:
                        remove(self.spark, f"{self.path}/{kind}/{v}/{p}")
        for n in _names(self.spark, f"{self.path}/commits"):
            if n != f"{m['version']:012d}":
                remove(self.spark, f"{self.path}/commits/{n}")


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text, "utf-8"))
    out.close()


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def first_deliveries(store: MessageStore, batches: list[DataFrame], first: int = 0) -> DataFrame:
    """Take in the batches one after the other, numbered from ``first``; returns the surplus deliveries of all.

    A list that is taken in again under the same numbers after a failure goes
    on where it stopped.
    """
    out = store.upsert(batches[0], first)
    for i, b in enumerate(batches[1:], first + 1):
        out = out.unionByName(store.upsert(b, i))
    return out.distinct()
