"""The stages of a program and the hooks around them.

read (text to tree), lower (checks and regions), plan (rules and components) and render
(DataFrames) can each be replaced or followed by a further step. Planning a rule and a
recursive component are operations with one terminal handler and any number of handlers
around it; a layer is an object with ``install(pipeline)``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any, Protocol

from deltarule.errors import RuleError

STAGES = ("read", "lower", "plan", "render")
PLAN_RULE, PLAN_COMPONENT = "plan_rule", "plan_component"


class Layer(Protocol):
    def install(self, pipeline: Pipeline) -> None: ...


class Next:
    """The rest of the handlers, to be called at most once."""

    def __init__(self, call: Callable[[Any], Any]):
        self._call: Callable[[Any], Any] | None = call

    def __call__(self, request: Any) -> Any:
        if self._call is None:
            raise RuleError("the next handler was called twice")
        call, self._call = self._call, None
        return call(request)


class Pipeline:
    def __init__(self) -> None:
        self._stages: dict[str, Callable] = {}
        self._terminal: dict[str, Callable] = {}
        self._around: dict[str, list[Callable]] = {}

    def stage(self, name: str) -> Callable:
        return self._stages[name]

    def replace(self, name: str, stage: Callable) -> Pipeline:
        if name not in STAGES:
            raise RuleError(f"there is no stage {name}")
        self._stages[name] = stage
        return self

    def insert_after(self, name: str, step: Callable) -> Pipeline:
        """step maps what the stage returns."""
        before = self.stage(name)
        return self.replace(name, lambda *a, **b: step(before(*a, **b)))

    def implement(self, operation: str, handler: Callable) -> Pipeline:
        if operation in self._terminal:
            raise RuleError(f"operation {operation} has two terminal implementations")
        self._terminal[operation] = handler
        return self

    def around(self, operation: str, handler: Callable[[Any, Next], Any]) -> Pipeline:
        """Later handlers stand outside earlier ones."""
        self._around.setdefault(operation, []).append(handler)
        return self

    def install(self, layer: Layer) -> Pipeline:
        layer.install(self)
        return self

    def perform(self, operation: str, request: Any) -> Any:
        if operation not in self._terminal:
            raise RuleError(f"operation {operation} has no terminal implementation")
        call = self._terminal[operation]
        for handler in self._around.get(operation, []):
            call = (lambda h, inner: lambda r: h(r, Next(inner)))(handler, call)
        return call(request)


def plan(resolved, pipeline: Pipeline):
    """Plans every rule, then every recursive component."""
    regions = []
    for region in resolved.regions:
        region = replace(region, rules=tuple(pipeline.perform(PLAN_RULE, r) for r in region.rules))
        regions.append(pipeline.perform(PLAN_COMPONENT, region) if region.recursive else region)
    return replace(resolved, regions=regions)


def default_pipeline() -> Pipeline:
    from deltarule.parser import parse
    from deltarule.program import render
    from deltarule.resolve import check_rule, resolve

    def checked(rule):
        check_rule(rule)
        return rule

    pipeline = Pipeline()
    for name, stage in zip(STAGES, (parse, resolve, plan, render), strict=True):
        pipeline.replace(name, stage)
    return pipeline.implement(PLAN_RULE, checked).implement(PLAN_COMPONENT, lambda region: region)
