"""A graph of steps over track tables. Steps are lazy plans, so Spark optimises across them; a step is written where
it is marked so, and is then reused while its description stays the same."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import Catalog, run_id


@dataclass
class Step:
    name: str
    operator: Callable[..., DataFrame]
    inputs: list[str]
    params: dict = field(default_factory=dict)
    version: str = "1"
    materialise: bool = False
    scope_dependent: bool = False
    callback: bool = False


@dataclass
class Pipeline:
    catalog: Catalog | None = None
    steps: dict[str, Step] = field(default_factory=dict)
    log: list[dict] = field(default_factory=list)

    def add(self, name: str, operator: Callable[..., DataFrame], inputs: list[str], materialise: bool = False, version: str = "1", scope_dependent: bool = False, **params) -> Pipeline:
        if name in self.steps or name == "tracks":
            raise ValueError(f"there is a step {name!r} already")
        if unknown := [i for i in inputs if i != "tracks" and i not in self.steps]:
            raise ValueError(f"{name!r} needs unknown steps {unknown}")
        if materialise and self.catalog is None:
            raise ValueError("only a pipeline with a catalogue can write steps")
        self.steps[name] = Step(name, operator, inputs, params, version, materialise, scope_dependent)
        return self

    def add_callback(self, name: str, function: Callable[..., DataFrame | None], inputs: list[str], **params) -> Pipeline:
        """A step that calls `function` with its inputs each time the pipeline runs, as for a plot or an export. What it
        returns is its result; if that is nothing, its first input is."""
        self.add(name, function, inputs, **params)
        self.steps[name].callback = True
        return self

    def clean(self, scope: list | None = None) -> list[str]:
        """Deletes the written data of steps whose runs aren't the ones that the pipeline would use now; their names."""
        gone = []
        for s in self.steps.values():
            if s.materialise:
                runs = self.catalog.runs().where((F.col("feature") == s.name) & (F.col("run_id") != self.run_id(s.name, scope)) & (F.col("status") != "deleted"))
                for r in runs.select("run_id").toLocalIterator():
                    self.catalog.delete(s.name, r["run_id"])
                    gone.append(f"{s.name}/{r['run_id']}")
        return gone

    def run_id(self, name: str, scope: list | None = None) -> str:
        step = self.steps[name]
        inputs = [i if i == "tracks" else f"{i}/{self.run_id(i, scope)}" for i in step.inputs]
        return run_id(step.version, step.params, inputs, scope=scope if step.scope_dependent else None)

    def downstream(self, name: str) -> set[str]:
        out = {name}
        for s in self.steps.values():
            if out & set(s.inputs):
                out.add(s.name)
        return out

    def status(self, scope: list | None = None) -> dict[str, str]:
        """cached, stale (an input isn't cached), lazy or callback for each step."""
        own = {(s.name, self.run_id(s.name, scope)) for s in self.steps.values() if s.materialise}
        finished = set()
        if own:  # a row for each written step at most
            runs = self.catalog.runs().where("status = 'finished'").where(F.col("feature").isin(*{n for n, _ in own}) & F.col("run_id").isin(*{i for _, i in own}))
            finished = own & {(r["feature"], r["run_id"]) for r in runs.select("feature", "run_id").collect()}
        out: dict[str, str] = {}
        for s in self.steps.values():
            if not s.materialise:
                out[s.name] = "callback" if s.callback else "lazy"
            else:
                own = (s.name, self.run_id(s.name, scope)) in finished
                out[s.name] = "cached" if own and not any(out.get(i) == "stale" for i in s.inputs) else "stale"
        return out

    def run(self, tracks: DataFrame, force_from: str | None = None, scope: list | None = None) -> dict[str, DataFrame]:
        """The result of every step. Cached steps are read; those from `force_from` on are written anew."""
        forced = self.downstream(force_from) if force_from else set()
        status = self.status(scope)
        out = {"tracks": tracks}
        for s in self.steps.values():
            ident = self.run_id(s.name, scope)
            with self._job(s, ident, tracks.sparkSession) as did:
                if s.materialise and status[s.name] == "cached" and s.name not in forced:
                    out[s.name], did["did"] = self.catalog.read(s.name, ident), "read"
                    continue
                df, did["did"] = s.operator(*[out[i] for i in s.inputs], **s.params), "called" if s.callback else "planned"
                df = out[s.inputs[0]] if df is None and s.callback else df
                if s.materialise:
                    upstream = [self.run_id(i, scope) for i in s.inputs if i != "tracks"]
                    df, did["did"] = self.catalog.write(s.name, ident, df, s.params, upstream), "written"
                out[s.name] = df
        return out

    def tag(self, name: str, scope: list | None = None) -> str:
        """The tag of all Spark jobs of a step."""
        return f"trackloom.{name}.{self.run_id(name, scope)}"

    def cancel(self, spark: SparkSession, name: str | None = None, scope: list | None = None) -> None:
        """Stops the running jobs of a step, or of all, from any thread. What a step had begun to write is never
        committed, and its run counts as failed."""
        for step in [name] if name else list(self.steps):
            spark.sparkContext.cancelJobsWithTag(self.tag(step, scope))

    @contextmanager
    def _job(self, s: Step, ident: str, spark: SparkSession) -> Iterator[dict]:
        """Tags the step's jobs and notes what became of it, in `log` and, with a catalogue, in its table of events."""
        note, began, tag = {"step": s.name, "run_id": ident, "did": "failed", "error": None}, time.time(), f"trackloom.{s.name}.{ident}"
        spark.sparkContext.addJobTag(tag)
        try:
            yield note
        except Exception as e:
            note |= {"did": "failed", "error": f"{type(e).__name__}: {e}"[:2_000]}
            if s.materialise:
                self.catalog.record(s.name, ident, s.params, [], "failed")
            raise
        finally:
            spark.sparkContext.removeJobTag(tag)
            note["seconds"] = time.time() - began
            self.log.append(note)
            if self.catalog is not None:
                self.catalog.note(note | {"at": began})
