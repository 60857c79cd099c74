"""Requests: each has a number, a folder of results and a job group of its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.filters import passes, temporal
from ..session import _fs, remove, scratch_scope, written
from ..sources.sinks import deliver, write_csv
from . import sales

DONE = "_DONE"


def shared_tables(t: sales.Tables) -> sales.Tables:
    """The tables, each read and cleaned once: transactions of the years asked for are written for the three results that read them.

    Written tables have the columns apart, so each result reads its own only.
    """
    kept: dict[str, DataFrame] = {}

    def get(name: str) -> DataFrame:
        if name not in kept:
            df = t(name)
            kept[name] = written(passes(df, temporal("created_at", *sales.YEARS)), f"clean-{name}") if name.startswith("transaction") else df
        return kept[name]

    return get


class Requests:
    """Runs requests below a root folder: ``root/request_N/q1_results`` and so on.

    A request's folder is made when it is accepted and gets the mark ``_DONE``
    when all its results are there, so that one which was cut off can be told.
    Requests don't see each other's results or tables; several may run in
    threads of one session.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _numbers(self) -> list[int]:
        fs, p = _fs(self.spark, self.root)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[8:]) for n in names if n.startswith("request_") and n[8:].isdigit())

    def folder(self, number: int) -> str:
        return f"{self.root}/request_{number}"

    def accept(self) -> int:
        """The number of a new request, the next that no one has taken."""
        number = max(self._numbers(), default=0) + 1
        while True:
            # the file is made only if it isn't there: of two who want a number one gets it
            fs, p = _fs(self.spark, f"{self.folder(number)}/_ACCEPTED")
            try:
                fs.create(p, False).close()
                return number
            except Exception:
                if not fs.exists(p):
                    raise
                number += 1

    def run(self, number: int, t: sales.Tables, results: Callable[[sales.Tables], dict[str, DataFrame]] = sales.run_all, write: Callable[[DataFrame, str], None] = write_csv) -> dict[str, str]:
        """All results of a request; returns their folders. Its helper tables are removed when it is done or has failed."""
        sc = self.spark.sparkContext
        sc.setJobGroup(f"request_{number}", f"request {number}", interruptOnCancel=True)
        try:
            with scratch_scope(self.spark):
                paths = deliver(results(shared_tables(t)), self.folder(number), write)
            fs, p = _fs(self.spark, f"{self.folder(number)}/{DONE}")
            fs.create(p, True).close()
            return paths
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self, number: int) -> None:
        """Stop a request's jobs and remove what it has delivered."""
        self.spark.sparkContext.cancelJobGroup(f"request_{number}")
        remove(self.spark, self.folder(number))

    def abandoned(self) -> list[int]:
        """Requests that were accepted and never got done. Right after a restart, before new ones run, these are the ones cut off."""
        return [n for n in self._numbers() if not (lambda fs, p: fs.exists(p))(*_fs(self.spark, f"{self.folder(n)}/{DONE}"))]

    def clean_up(self) -> list[int]:
        """Cancel and remove the abandoned requests; returns their numbers."""
        gone = self.abandoned()
        for n in gone:
            self.cancel(n)
        return gone
