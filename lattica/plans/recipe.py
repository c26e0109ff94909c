"""Recipes: the logical plan of a network, as frozen descriptions of blocks and what joins them."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from graphlib import CycleError, TopologicalSorter


def _check(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


@dataclass(frozen=True)
class Input:
    """Clusters of mixed features. Temperatures: 0 is hard, positive is soft, infinite (weights only) is fixed."""

    K: int = 3
    epsilon: float = 0.0
    epsilon_D: float = math.inf
    epsilon_T: float = math.inf
    W_std: float = 0.0
    delta_cat: float | None = None
    candidates: int | None = 1
    balanced: bool = False
    name: str = ""

    def __post_init__(self) -> None:
        _check(self.K >= 1, "K must be at least one")
        _check(0 <= self.epsilon < math.inf, "epsilon must be finite and not negative")
        _check(self.epsilon_D >= 0 and self.epsilon_T >= 0, "weight temperatures must not be negative")
        _check(self.candidates is None or self.candidates >= 1, "candidates must be positive")


@dataclass(frozen=True)
class ManifoldInput:
    """Clusters around affine subspaces; alpha is the price of the distance along them."""

    K: int = 3
    subspace_dimension: int = 1
    alpha: float = 0.1
    epsilon: float = 0.0
    epsilon_T: float = math.inf
    candidates: int | None = 1
    balanced: bool = False
    name: str = ""

    def __post_init__(self) -> None:
        _check(self.K >= 1 and self.subspace_dimension >= 1, "K and subspace_dimension must be at least one")
        _check(self.alpha >= 0 and 0 <= self.epsilon < math.inf, "alpha and epsilon must be finite and not negative")


@dataclass(frozen=True)
class Hidden:
    K: int = 3
    epsilon: float | None = None
    epsilon_ratio: float | None = None
    name: str = ""

    def __post_init__(self) -> None:
        _check(self.K >= 1, "K must be at least one")
        _check(self.epsilon is None or self.epsilon_ratio is None, "give epsilon or epsilon_ratio, not both")


@dataclass(frozen=True)
class ClassificationHead:
    coupling: str = "M"
    n_classes: int | None = None
    theta_alpha: float = 1.0
    name: str = ""

    def __post_init__(self) -> None:
        _check(self.coupling in ("M", "S"), "coupling must be M or S")
        _check(self.theta_alpha >= 1, "theta_alpha must be at least one")


@dataclass(frozen=True)
class RegressionHead:
    epsilon_M: float = math.inf
    W_M: tuple[float, ...] | None = None
    name: str = ""

    def __post_init__(self) -> None:
        _check(self.W_M is None or self.epsilon_M == math.inf, "fixed output weights need an infinite epsilon_M")
        _check(self.W_M is None or all(w > 0 for w in self.W_M), "output weights must be positive")


Block = Input | ManifoldInput | Hidden | ClassificationHead | RegressionHead
HEADS = (ClassificationHead, RegressionHead)


@dataclass(frozen=True)
class Connection:
    source: str
    target: str
    delta: float | None = None
    delta_ratio: float | None = None
    coupling: str | None = None
    theta_alpha: float | None = None

    def __post_init__(self) -> None:
        _check(self.delta is None or self.delta_ratio is None, "give delta or delta_ratio, not both")
        _check(self.delta is None or 0 < self.delta < math.inf, "delta must be positive")
        _check(self.coupling in (None, "M", "S"), "coupling must be M or S")


@dataclass(frozen=True)
class Recipe:
    """Blocks and connections; a valid recipe is an acyclic graph with inputs and heads of one kind."""

    blocks: tuple[Block, ...]
    connections: tuple[Connection, ...] = field(default=())

    def __post_init__(self) -> None:
        names = [b.name for b in self.blocks]
        _check(all(names) and len(set(names)) == len(names), "blocks need names of their own")
        _check(not any("__" in n for n in names), "names must not hold two underscores")
        kinds = {type(b) for b in self.blocks}
        _check(any(isinstance(b, (Input, ManifoldInput)) for b in self.blocks), "a recipe needs an input")
        _check(len(kinds & set(HEADS)) == 1, "a recipe needs heads of one kind")
        by = {b.name: b for b in self.blocks}
        for c in self.connections:
            _check(c.source in by and c.target in by, f"{c.source} -> {c.target} names no block")
            _check(not isinstance(by[c.source], HEADS), "a head is no source")
            _check(not isinstance(by[c.target], (Input, ManifoldInput)), "an input is no target")
            _check(not isinstance(by[c.target], HEADS) or (c.coupling is None and c.theta_alpha is None), "a head's connection carries its strength only")
            _check(c.source != c.target, f"{c.source} is linked to itself")
        _check(len({(c.source, c.target) for c in self.connections}) == len(self.connections), "two connections link the same blocks")
        for b in self.blocks:
            _check(isinstance(b, HEADS) or any(c.source == b.name for c in self.connections), f"{b.name} leads nowhere")
            _check(isinstance(b, (Input, ManifoldInput)) or any(c.target == b.name for c in self.connections), f"nothing leads to {b.name}")
        _check(not (kinds & {RegressionHead} and any(isinstance(b, Input) and b.balanced for b in self.blocks)), "balanced seeds need classes")
        self.stable_order()

    def stable_order(self) -> list[str]:
        """Names in topological order, declared order first."""
        place = {b.name: i for i, b in enumerate(self.blocks)}
        graph = TopologicalSorter({b.name: {c.source for c in self.connections if c.target == b.name} for b in self.blocks})
        try:
            graph.prepare()
        except CycleError:
            raise ValueError("connections form a cycle") from None
        out = []
        ready = list(graph.get_ready())
        while ready:
            ready.sort(key=place.get)
            out.append(ready[0])
            graph.done(ready.pop(0))
            ready += graph.get_ready()
        return out

    @classmethod
    def chain(cls, *blocks: Block, coupling: str | Sequence[str] = "M", delta: float | Sequence[float] | None = 1.0, theta_alpha: float = 1.0, delta_ratio: float | None = None) -> Recipe:
        """Blocks in a row; values are for every connection or one each."""
        named = [b if b.name else replace(b, name="input" if i == 0 else "head" if isinstance(b, HEADS) else f"hidden{i}") for i, b in enumerate(blocks)]
        links = []
        for i, (a, b) in enumerate(zip(named, named[1:], strict=False)):
            strength = delta if not isinstance(delta, Sequence) else delta[i]
            ratio = delta_ratio if i and delta_ratio is not None else None
            own = {} if isinstance(b, HEADS) else {"coupling": coupling if isinstance(coupling, str) else coupling[i], "theta_alpha": theta_alpha}
            links.append(Connection(a.name, b.name, None if ratio is not None else strength, ratio, **own))
        return cls(tuple(named), tuple(links))

    def resolve_ratios(self) -> Recipe:
        """Every strength and temperature as a number: ratios multiply what comes in."""
        deltas: dict[str, float] = {}
        links, blocks = [], []
        for name in self.stable_order():
            incoming = [c for c in self.connections if c.target == name]
            for c in incoming:
                d = c.delta if c.delta is not None else (c.delta_ratio or 1.0) * deltas.get(c.source, 1.0)
                deltas[name] = d
                links.append(replace(c, delta=d, delta_ratio=None))
        for b in self.blocks:
            if isinstance(b, Hidden):
                e = b.epsilon if b.epsilon is not None else (b.epsilon_ratio or 0.0) * deltas.get(b.name, 1.0)
                b = replace(b, epsilon=e, epsilon_ratio=None)
            blocks.append(b)
        order = {(c.source, c.target): i for i, c in enumerate(self.connections)}
        return Recipe(tuple(blocks), tuple(sorted(links, key=lambda c: order[c.source, c.target])))

    def replace_block(self, name: str, **changes) -> Recipe:
        _check(any(b.name == name for b in self.blocks), f"no block {name}")
        return Recipe(tuple(replace(b, **changes) if b.name == name else b for b in self.blocks), self.connections)

    def replace_connection(self, source: str, target: str, **changes) -> Recipe:
        _check(any((c.source, c.target) == (source, target) for c in self.connections), f"no connection {source} -> {target}")
        return Recipe(self.blocks, tuple(replace(c, **changes) if (c.source, c.target) == (source, target) else c for c in self.connections))

    def as_chain(self) -> tuple[Block, list[Hidden], Block, list[Connection]]:
        """(input, hidden blocks, head, connections in order); raises if the graph is no single chain."""
        order = self.stable_order()
        by, full = {b.name: b for b in self.blocks}, self.resolve_ratios()
        links = {c.source: c for c in full.connections}
        _check(len(full.connections) == len(order) - 1 and all(n in links and links[n].target == m for n, m in zip(order, order[1:], strict=False)), "only a chain of blocks can be fitted")
        by = {b.name: b for b in full.blocks}
        return by[order[0]], [by[n] for n in order[1:-1]], by[order[-1]], [links[n] for n in order[:-1]]

    def to_json(self) -> dict:
        return {"blocks": [{"kind": type(b).__name__, **dataclasses.asdict(b)} for b in self.blocks], "connections": [dataclasses.asdict(c) for c in self.connections]}

    @classmethod
    def from_json(cls, data: dict) -> Recipe:
        kinds = {k.__name__: k for k in (Input, ManifoldInput, Hidden, ClassificationHead, RegressionHead)}
        made = []
        for b in data["blocks"]:
            fields = {k: tuple(v) if isinstance(v, list) else v for k, v in b.items() if k != "kind"}
            made.append(kinds[b["kind"]](**fields))
        return cls(tuple(made), tuple(Connection(**c) for c in data["connections"]))
