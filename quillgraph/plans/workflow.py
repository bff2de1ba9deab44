"""Workflows: named lists of verb steps, ordered by their dependencies, materialised and resumable."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillgraph.operators import extraction  # noqa: F401  (registers its verbs)
from quillgraph.operators.relational import VERBS, Verb, VerbInput
from quillgraph.sources.files import emit

WORKFLOW = "workflow:"


@dataclass
class Step:
    verb: str
    args: dict[str, Any] = field(default_factory=dict)
    input: str | dict[str, Any] | None = None
    id: str | None = None
    enabled: bool = True


@dataclass
class Workflow:
    name: str
    steps: list[Step]

    def needs(self) -> list[str]:
        """Workflows whose output a step reads."""
        found = []
        for s in self.steps:
            refs = [s.input] if isinstance(s.input, str) else [x for v in (s.input or {}).values() for x in ([v] if isinstance(v, str) else v.values() if isinstance(v, dict) else v)]
            found += [r.removeprefix(WORKFLOW) for r in refs if r.startswith(WORKFLOW)]
        return list(dict.fromkeys(found))


WorkflowFactory = Callable[[dict[str, Any]], list[Step | dict[str, Any]]]


def _steps(raw: list[Step | dict[str, Any]]) -> list[Step]:
    steps = [s if isinstance(s, Step) else Step(**{k: v for k, v in s.items() if k in ("verb", "args", "input", "id", "enabled")}) for s in raw]
    return [s for s in steps if s.enabled]


def resolve(wanted: list[str | dict[str, Any]], factories: dict[str, WorkflowFactory]) -> list[Workflow]:
    """The wanted workflows and all they need, transitively, in an order that respects needs."""
    made: dict[str, Workflow] = {}

    def load(spec: str | dict[str, Any]) -> None:
        spec = {"name": spec} if isinstance(spec, str) else spec
        name = spec["name"]
        if name in made:
            return
        raw = spec.get("steps")
        if raw is None:
            if name not in factories:
                raise ValueError(f"unknown workflow {name!r}")
            raw = factories[name](spec.get("config") or {})
        made[name] = Workflow(name, _steps(raw))

    for spec in wanted:
        load(spec)
    waiting = list(made)
    while waiting:
        for need in made[waiting.pop()].needs():
            if need not in made:
                load(need)
                waiting.append(need)
    order: list[Workflow] = []
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if state.get(name) == 2:
            return
        if state.get(name) == 1:
            raise ValueError(f"workflows depend on each other in a circle at {name!r}")
        state[name] = 1
        for need in made[name].needs():
            visit(need)
        state[name] = 2
        order.append(made[name])

    for name in made:
        visit(name)
    return order


def run_steps(steps: list[Step], source: DataFrame | None, tables: dict[str, DataFrame], verbs: dict[str, Verb]) -> DataFrame:
    """Chain of steps: each reads its input, or the step before it. Plans only; nothing runs here."""
    results: dict[str, DataFrame] = {}
    last = source

    def table(ref: str) -> DataFrame:
        if ref.startswith(WORKFLOW):
            return tables[ref.removeprefix(WORKFLOW)]
        if ref in results:
            return results[ref]
        if ref in tables:
            return tables[ref]
        raise ValueError(f"unknown input {ref!r}")

    for s in steps:
        if s.verb not in verbs:
            raise ValueError(f"unknown verb {s.verb!r}")
        spec = {"source": s.input} if isinstance(s.input, str) else dict(s.input or {})
        first = table(spec.pop("source")) if spec.get("source") else last
        others = [table(r) for r in spec.pop("others", [])]
        named = {k: table(r) for k, r in (spec.pop("named", None) or spec).items() if isinstance(r, str)}
        last = verbs[s.verb](VerbInput(first, others, named), **s.args)
        if s.id:
            results[s.id] = last
    if last is None:
        raise ValueError("a workflow without steps needs an input")
    return last


@dataclass
class RunResult:
    workflow: str
    table: DataFrame | None
    errors: list[BaseException] = field(default_factory=list)


class Pipeline:
    """Runs workflows over a dataset, writing each output once and reading it where it is needed."""

    def __init__(self, spark: SparkSession, output: str, verbs: dict[str, Verb] | None = None, workflows: dict[str, WorkflowFactory] | None = None, emit_kinds: tuple[str, ...] = ("parquet",)):
        self.spark, self.output, self.emit_kinds = spark, output, emit_kinds
        self.verbs = VERBS | (verbs or {})
        self.factories = workflows or {}
        self.stats: dict[str, Any] = {"workflows": {}}

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.output}/{name}.parquet/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def run(self, wanted: list[str | dict[str, Any]], dataset: DataFrame | None = None, resume: bool = False, post_process: list[Step | dict[str, Any]] | None = None):
        """Yield a RunResult per workflow; an error ends the run and is the last result's."""
        began = time.time()
        if dataset is not None and post_process:
            dataset = run_steps(_steps(post_process), dataset, {}, self.verbs)
        tables: dict[str, DataFrame] = {}
        for w in resolve(wanted, self.factories):
            t = time.time()
            if resume and self._exists(w.name):
                tables[w.name] = self.spark.read.parquet(f"{self.output}/{w.name}.parquet")
                yield RunResult(w.name, tables[w.name])
                continue
            try:
                out = run_steps(w.steps, dataset, tables, self.verbs)
                emit(out, self.output, w.name, tuple(dict.fromkeys(("parquet", *self.emit_kinds))))
                tables[w.name] = self.spark.read.parquet(f"{self.output}/{w.name}.parquet")
            except Exception as e:
                yield RunResult(w.name, None, [e])
                return
            self.stats["workflows"][w.name] = {"overall": time.time() - t, "steps": [s.verb for s in w.steps]}
            self.stats["total_runtime"] = time.time() - began
            yield RunResult(w.name, tables[w.name])

    def write_stats(self) -> None:
        """stats.json as a one-line text table in the output folder."""
        self.spark.createDataFrame([(json.dumps(self.stats),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.output}/stats.json")


def load_config(text: str, includes: dict[str, str] | None = None) -> dict[str, Any]:
    """Pipeline settings from JSON; ``{"include": name}`` is replaced by the named text.

    ``extends`` names a text whose settings this one overrides.
    """
    includes = includes or {}

    def expand(x: Any) -> Any:
        if isinstance(x, dict):
            if set(x) == {"include"}:
                return expand(json.loads(includes[x["include"]]))
            return {k: expand(v) for k, v in x.items()}
        return [expand(v) for v in x] if isinstance(x, list) else x

    def over(base: Any, new: Any) -> Any:
        if isinstance(base, dict) and isinstance(new, dict):
            return base | {k: over(base.get(k), v) for k, v in new.items()}
        return new

    config = expand(json.loads(text))
    parents = config.pop("extends", [])
    base: dict[str, Any] = {}
    for parent in [parents] if isinstance(parents, str) else parents:
        base = over(base, load_config(includes[parent], includes))
    return over(base, config)
