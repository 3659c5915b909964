"""A small validated graph of steps that compose operators.

Steps name a registered function, what they depend on, their configuration and inputs;
``${{ steps.X.Y }}`` in an input means output ``Y`` of step ``X``.
"""

from __future__ import annotations

import heapq
import re
import time
from collections.abc import Callable, Mapping
from contextvars import ContextVar
from dataclasses import dataclass, field
from typing import Any

_REFERENCE = re.compile(r"^\$\{\{\s*steps\.([\w-]+)\.([\w-]+)\s*\}\}$")
STEP_KEYS = {"id", "module", "depends_on", "config", "inputs", "outputs", "on_success", "on_failure", "retry"}


class Registry:
    """Named functions; asking for an unknown one lists those there are."""

    def __init__(self, kind: str):
        self.kind, self.items = kind, {}

    def register(self, name: str, item: Callable | None = None):
        def keep(f):
            self.items[name] = f
            return f

        return keep if item is None else keep(item)

    def get(self, name: str) -> Callable:
        if name not in self.items:
            raise KeyError(f"unknown {self.kind} {name!r}; there are: {', '.join(self.names()) or 'none'}")
        return self.items[name]

    def names(self) -> list[str]:
        return sorted(self.items)

    def has(self, name: str) -> bool:
        return name in self.items

    def clear(self) -> None:
        self.items.clear()


STEPS, CALLBACKS = Registry("step"), Registry("callback")
_CONTEXTS: ContextVar[Mapping[str, Any]] = ContextVar("contexts", default={})


class context:
    """Values that steps inside the block can ask for with ``require``."""

    def __init__(self, **values):
        self.values = values

    def __enter__(self):
        self.token = _CONTEXTS.set({**_CONTEXTS.get(), **self.values})
        return self

    def __exit__(self, *_):
        _CONTEXTS.reset(self.token)


def require(name: str) -> Any:
    if name not in _CONTEXTS.get():
        raise RuntimeError(f"no context {name!r} is set")
    return _CONTEXTS.get()[name]


def deep_merge(base: Mapping, over: Mapping) -> dict:
    """Mappings put together, the second over the first, at every depth."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def nested(flat: Mapping[str, Any]) -> dict:
    """``{"a.b": 1}`` as ``{"a": {"b": 1}}``."""
    out: dict = {}
    for key, value in flat.items():
        *path, last = key.split(".")
        at = out
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value
    return out


def overrides(config: Mapping) -> list[str]:
    """A configuration as ``a.b=value`` strings."""

    def walk(at: Mapping, path: tuple):
        for k, v in at.items():
            if isinstance(v, Mapping):
                yield from walk(v, (*path, k))
            else:
                yield f"{'.'.join((*path, k))}={'null' if v is None else str(v).lower() if isinstance(v, bool) else v}"

    return list(walk(config, ()))


def effective(layers: Mapping[str, Mapping]) -> dict[str, tuple[Any, str]]:
    """Each setting of merged layers with the layer that it comes from; later layers win."""
    out: dict[str, tuple[Any, str]] = {}
    for name, layer in layers.items():
        for line in overrides(layer):
            key = line.split("=", 1)[0]
            at: Any = layer
            for part in key.split("."):
                at = at[part]
            out[key] = (at, name)
    return out


@dataclass
class Step:
    id: str
    module: str
    depends_on: list[str] = field(default_factory=list)
    config: dict = field(default_factory=dict)
    inputs: dict = field(default_factory=dict)
    outputs: dict[str, str] = field(default_factory=dict)
    on_success: list = field(default_factory=list)
    on_failure: list = field(default_factory=list)
    retry: dict = field(default_factory=dict)

    def references(self):
        for name, value in self.inputs.items():
            if isinstance(value, str) and (m := _REFERENCE.match(value)):
                yield name, m[1], m[2]


class Pipeline:
    """Steps, put together by ``step`` and ``after``; ``run`` carries them out in order."""

    def __init__(self, name: str, config: Mapping | None = None):
        self.name, self.config, self.steps = name, dict(config or {}), {}

    def step(self, id: str, module: str, **more) -> Pipeline:
        if id in self.steps:
            raise ValueError(f"step {id!r} is there already")
        self.steps[id] = Step(id, module, **more)
        self._last = id
        return self

    def after(self, *ids: str) -> Pipeline:
        self.steps[self._last].depends_on += ids
        return self

    def override(self, **config) -> Pipeline:
        self.steps[self._last].config = deep_merge(self.steps[self._last].config, config)
        return self

    def input(self, **inputs) -> Pipeline:
        self.steps[self._last].inputs |= inputs
        return self

    def on(self, event: str, *callbacks) -> Pipeline:
        getattr(self.steps[self._last], f"on_{event}").extend(callbacks)
        return self

    def order(self) -> list[str]:
        """Steps after what they depend on, free ones by name; a cycle is an error."""
        left = {k: set(s.depends_on) for k, s in self.steps.items()}
        if unknown := sorted(d for ds in left.values() for d in ds if d not in self.steps):
            raise ValueError(f"unknown step {unknown[0]!r}")
        ready, out = [k for k, ds in left.items() if not ds], []
        heapq.heapify(ready)
        while ready:
            done = heapq.heappop(ready)
            out.append(done)
            for k, ds in left.items():
                if done in ds:
                    ds.remove(done)
                    if not ds:
                        heapq.heappush(ready, k)
        if len(out) < len(left):
            raise ValueError(f"the steps {', '.join(sorted(set(left) - set(out)))} depend on each other")
        return out

    def validate(self, steps: Registry = STEPS) -> list[str]:
        """Everything that is wrong with the graph and its references."""
        wrong = []
        try:
            self.order()
        except ValueError as e:
            wrong.append(str(e))
        for s in self.steps.values():
            if not steps.has(s.module):
                wrong.append(f"{s.id}: unknown module {s.module!r}")
            for name, other, output in s.references():
                if other not in self.steps:
                    wrong.append(f"{s.id}.{name}: unknown step {other!r}")
                elif other not in s.depends_on:
                    wrong.append(f"{s.id}.{name}: {other!r} isn't in depends_on")
                elif output not in self.steps[other].outputs:
                    wrong.append(f"{s.id}.{name}: {other!r} has no output {output!r}")
                else:
                    wanted, given = getattr(steps.items.get(s.module), "inputs", {}).get(name), self.steps[other].outputs[output]
                    if wanted and "any" not in (wanted, given) and wanted != given:
                        wrong.append(f"{s.id}.{name}: wants {wanted}, {other}.{output} is {given}")
        return wrong

    def describe(self) -> str:
        return "\n".join(f"{k}: {self.steps[k].module}" + (f" after {', '.join(sorted(self.steps[k].depends_on))}" if self.steps[k].depends_on else "") for k in self.order())

    def run(self, steps: Registry = STEPS, callbacks: Registry = CALLBACKS, sleep=time.sleep, mocks: Mapping[str, Mapping] | None = None) -> dict[str, dict]:
        """Outputs of every step.  A step function takes its merged configuration and its inputs.

        A step with an entry in ``mocks`` isn't run: these are its outputs, and must be all it declares.
        """
        if wrong := self.validate(steps):
            raise ValueError("; ".join(wrong))
        results: dict[str, dict] = {}
        for key in self.order():
            s = self.steps[key]
            if key in (mocks or {}):
                if missing := sorted(set(s.outputs) - set(mocks[key])):
                    raise ValueError(f"the mock of {key!r} lacks {', '.join(missing)}")
                results[key] = dict(mocks[key])
                continue
            given = {**s.inputs, **{name: results[other][output] for name, other, output in s.references()}}
            config = deep_merge(self.config, s.config)
            attempts = int(s.retry.get("attempts", 3 if s.retry else 1))
            for attempt in range(1, attempts + 1):
                try:
                    out = steps.get(s.module)(config=config, **given)
                    results[key] = out if isinstance(out, dict) else dict.fromkeys(s.outputs, out)
                    break
                except Exception as e:
                    if attempt == attempts:
                        self._call(callbacks, s.on_failure, key, error=e)
                        raise
                    sleep(float(s.retry.get("delay", 10)))
            self._call(callbacks, s.on_success, key, result=results[key])
        return results

    @staticmethod
    def _call(registry: Registry, items: list, key: str, **more) -> None:
        for item in items:
            name, params = callback_form(item)
            registry.get(name)(step=key, **params, **more)


def callback_form(item) -> tuple[str, dict]:
    """A callback by name, by ``{name: params}``, or by ``{name: ..., params: ...}``."""
    if isinstance(item, str):
        return item, {}
    if isinstance(item, Mapping) and "name" in item:
        return item["name"], dict(item.get("params") or {})
    if isinstance(item, Mapping) and len(item) == 1:
        ((name, params),) = item.items()
        return name, dict(params or {})
    raise ValueError(f"no callback: {item!r}")


def load(source: str) -> Pipeline:
    """A pipeline from YAML: ``name``, ``config`` and ``steps``; other keys are errors."""
    import yaml

    given = yaml.safe_load(source)
    if not isinstance(given, dict) or set(given) - {"name", "config", "steps"}:
        raise ValueError("a pipeline has name, config and steps")
    out = Pipeline(given.get("name", "pipeline"), given.get("config"))
    for s in given.get("steps") or []:
        if extra := set(s) - STEP_KEYS:
            raise ValueError(f"step {s.get('id')!r} has unknown keys: {', '.join(sorted(extra))}")
        out.step(**{**s, "depends_on": list(s.get("depends_on") or [])})
    return out


def _register_operators() -> None:
    """The registered queries and the tools as steps, so that a pipeline can name them.

    A query takes ``sf_dir`` from its configuration and the session from the context.  A
    tool takes the context's ``tables``, its arguments from ``args`` in its configuration,
    and its inputs.
    """
    import inspect

    from lorespark.plans import load as load_queries
    from lorespark.plans.tools import TOOLS

    for name, tool in TOOLS.items.items():
        asks = "spark" in inspect.signature(tool).parameters

        def step(config, f=tool, asks=asks, **inputs):
            session = {"spark": require("spark")} if asks else {}
            return f(require("tables"), **session, **config.get("args", {}), **inputs)

        if not STEPS.has(name):
            STEPS.register(name, step)

    for name, function in load_queries().QUERIES.items():
        if not STEPS.has(name):
            STEPS.register(name, lambda config, f=function, **inputs: f(require("spark"), config["sf_dir"]))
