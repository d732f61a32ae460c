"""Pipelines: stages wired by taps, run in order by a driver program.

What Spark can see as one plan stays one: stages connected without a named output are lazy DataFrames.  A named output
is written, and a policy says what to do if it is there already.
"""

from __future__ import annotations

import re
import sys
import threading
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from enum import Enum
from functools import reduce

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from millrace.functions.codecs import Codec, parquet
from millrace.operators.stage import Stage
from millrace.plans.session import scratch
from millrace.sources.files import Files
from millrace.sources.taps import Tap, Union, tap


class Rerun(Enum):
    """What to do with a stage whose output is complete: fail, compute it anew, or go on without computing it."""

    FAIL = "fail"
    RERUN = "rerun"
    SKIP = "skip"


class OutputExists(RuntimeError):
    pass


class StageTimeout(RuntimeError):
    pass


Source = Tap | Union | DataFrame


@dataclass
class Pipeline:
    """A program of stages.  ``name`` is lower-case letters and digits."""

    spark: SparkSession
    name: str
    #: Where temporary taps are: a folder that executors share; the session's checkpoint folder by default.
    workspace: str = ""
    rerun: Rerun = Rerun.FAIL
    variables: dict[str, object] = field(default_factory=dict)
    _once: dict[str, object] = field(default_factory=dict)
    _shipped: dict[str, Broadcast] = field(default_factory=dict)
    #: Names of stages, and whether each was run or skipped.
    history: list[tuple[str, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not re.fullmatch("[a-z0-9]+", self.name):
            raise ValueError(f"a pipeline's name is lower-case letters and digits: {self.name!r}")
        self.workspace = self.workspace or scratch(self.spark)

    @property
    def files(self) -> Files:
        return Files(self.spark)

    def _read(self, source: Source) -> DataFrame:
        return source if isinstance(source, DataFrame) else source.read(self.spark)

    def connect(self, stage: Stage, inputs: Source | Sequence[Source], output: Tap, rerun: Rerun | None = None) -> DataFrame:
        """Run a stage over the union of its inputs into a named output, and return that as read back.

        An output without its success mark is what a failed job left, and is computed anew under any policy.
        """
        policy = rerun or self.rerun
        target = output.paths[0]
        if self.files.complete(target):
            if policy is Rerun.FAIL:
                raise OutputExists(f"{stage.name}: {target} is there already")
            if policy is Rerun.SKIP:
                self.history.append((stage.name, "skipped"))
                return output.read(self.spark)
        out = self.lazily(stage, inputs)
        sc = self.spark.sparkContext
        options = stage.options.writer_options()
        with _deadline(self.spark, stage.name, stage.options.timeout_s):
            sc.setJobDescription(f"{self.name}: {stage.name}")
            try:
                output.write(out, "overwrite", **options)
            finally:
                sc.setJobDescription(None)
        self.history.append((stage.name, "run"))
        return output.read(self.spark)

    def lazily(self, stage: Stage, inputs: Source | Sequence[Source]) -> DataFrame:
        """A stage's output as part of the plans of those that read it."""
        sources = list(inputs) if isinstance(inputs, list | tuple) else [inputs]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self._read(s) for s in sources])
        return stage(rows)

    def temporary(self, codec: Codec | None = None) -> Tap:
        """A tap with a location of its own in the workspace."""
        return tap(f"{self.workspace.rstrip('/')}/{self.name}/{uuid.uuid4().hex}", codec or parquet())

    def io(self, effect: Callable[[], object]) -> object:
        """An effect of the driver, which in Spark runs once, when the program gets here."""
        return effect()

    def on_nodes(self, df: DataFrame, effect: Callable[[], None]) -> DataFrame:
        """The same rows; the effect runs in every task that reads them, before the first row, also in a task's retry."""

        def run(batches):
            effect()
            yield from batches

        return df.mapInArrow(run, df.schema)

    def run_once(self, name: str, compute: Callable[[], object]) -> object:
        """A value computed on the driver once per pipeline."""
        if name not in self._once:
            self._once[name] = compute()
        return self._once[name]

    def shipped(self, name: str, compute: Callable[[], object]) -> Broadcast:
        """``run_once`` as a broadcast, for functions that run in tasks: each executor gets the value once."""
        if name not in self._shipped:
            self._shipped[name] = self.spark.sparkContext.broadcast(self.run_once(name, compute))
        return self._shipped[name]

    def set(self, name: str, value: object) -> None:
        """A variable; stages launched from now on see this value."""
        self.variables[name] = value

    def get(self, name: str, default: object = None) -> object:
        return self.variables.get(name, default)


class _deadline:
    """Cancel the jobs started within, after so many seconds."""

    def __init__(self, spark: SparkSession, what: str, seconds: float | None) -> None:
        self.sc, self.what, self.seconds, self.late = spark.sparkContext, what, seconds, False

    def __enter__(self) -> None:
        if self.seconds is not None:
            self.tag = f"deadline-{uuid.uuid4().hex}"
            self.sc.addJobTag(self.tag)
            self.timer = threading.Timer(self.seconds, self._stop)
            self.timer.start()

    def _stop(self) -> None:
        self.late = True
        self.sc.cancelJobsWithTag(self.tag)

    def __exit__(self, kind: object, error: BaseException | None, trace: object) -> None:
        if self.seconds is not None:
            self.timer.cancel()
            self.sc.removeJobTag(self.tag)
            if self.late and error is not None:
                raise StageTimeout(f"{self.what}: took more than {self.seconds} s") from error


APPS: dict[str, Callable[[Pipeline], object]] = {}


def app(name: str) -> Callable[[Callable[[Pipeline], object]], Callable[[Pipeline], object]]:
    """Register a program under a name, to be started by ``python -m millrace NAME``."""
    if not re.fullmatch("[a-z0-9]+", name):
        raise ValueError(f"an app's name is lower-case letters and digits: {name!r}")

    def put(program: Callable[[Pipeline], object]) -> Callable[[Pipeline], object]:
        APPS[name] = program
        return program

    return put


def main(args: list[str], spark: SparkSession | None = None) -> int:
    """Run an app: its name, then ``--workspace DIR`` and ``--rerun fail|rerun|skip``."""
    options = {"--workspace": "", "--rerun": "fail"}
    names = []
    rest = list(args)
    while rest:
        word = rest.pop(0)
        if word in options and rest:
            options[word] = rest.pop(0)
        else:
            names.append(word)
    if len(names) != 1 or names[0] not in APPS:
        print(f"usage: NAME [--workspace DIR] [--rerun fail|rerun|skip]; apps: {', '.join(sorted(APPS)) or 'none'}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.getOrCreate()
    APPS[names[0]](Pipeline(spark, names[0], options["--workspace"], Rerun(options["--rerun"])))
    return 0
