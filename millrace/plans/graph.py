"""A flow graph: operators named and wired by name, turned into one DataFrame an operator."""

from __future__ import annotations

from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame

from ..operators.flow import Operator
from ..operators.routing import fan_in, if_else


@dataclass
class Node:
    operator: Operator
    inputs: list[DataFrame] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)
    else_outputs: list[str] = field(default_factory=list)
    when: Column | None = None


class FlowGraph:
    """Rows of `inputs` and of every operator that names this one as an output enter an operator; its results go to
    `outputs`, or those that fail `when` to `else_outputs`. Catalyst plans the frames that come out as one query each.
    """

    def __init__(self) -> None:
        self.nodes: dict[str, Node] = {}

    def add(self, name: str, operator: Operator, inputs: list[DataFrame] | None = None, outputs: list[str] | None = None, when: Column | None = None, else_outputs: list[str] | None = None) -> FlowGraph:
        if name in self.nodes:
            raise ValueError(f"operator {name} is there already")
        self.nodes[name] = Node(operator, list(inputs or []), list(outputs or []), list(else_outputs or []), when)
        return self

    def build(self) -> dict[str, DataFrame]:
        """The result of each operator, by name. Unknown outputs, cycles and operators without rows are errors."""
        feeds: dict[str, list[DataFrame]] = {n: list(x.inputs) for n, x in self.nodes.items()}
        before: dict[str, set[str]] = {n: set() for n in self.nodes}
        for name, node in self.nodes.items():
            for out in node.outputs + node.else_outputs:
                if out not in self.nodes:
                    raise ValueError(f"operator {name} names an unknown output {out}")
                before[out].add(name)
        try:
            order = list(TopologicalSorter(before).static_order())
        except CycleError as e:
            raise ValueError(f"the graph has a cycle: {e.args[1]}") from e
        done: dict[str, DataFrame] = {}
        for name in order:
            node = self.nodes[name]
            if not feeds[name]:
                raise ValueError(f"operator {name} has no input")
            done[name] = node.operator.transform(fan_in(*feeds[name]))
            yes, no = if_else(done[name], node.when, bool(node.else_outputs))
            for out in node.outputs:
                feeds[out].append(yes)
            for out in node.else_outputs:
                feeds[out].append(no)
        return done
