"""Planned programs: an arena whose nodes are checked to form an acyclic graph that the root reaches whole."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from quillon.errors import InvalidProgramReference, InvalidProgramRoot, ProgramCycle, UnreachableProgramNode
from quillon.plans.filters import Predicate


@dataclass(frozen=True)
class Term:
    field_id: int
    term: str
    boost: float = 1.0


@dataclass(frozen=True)
class And:
    children: tuple[int, ...] = ()
    boost: float = 1.0


@dataclass(frozen=True)
class Or:
    children: tuple[int, ...] = ()
    boost: float = 1.0


@dataclass(frozen=True)
class Not:
    child: int


@dataclass(frozen=True)
class ConstantScore:
    child: int
    score: float


@dataclass(frozen=True)
class Filter:
    child: int
    predicate: Predicate


@dataclass(frozen=True)
class ExternalFilter:
    child: int
    slot: int


@dataclass(frozen=True)
class Phrase:
    """Terms of one field within a slop of each other, in order; an extension."""

    field_id: int
    terms: tuple[str, ...]
    slop: int = 0


Node = Term | And | Or | Not | ConstantScore | Filter | ExternalFilter | Phrase
#: Matches nothing.
EMPTY = And(())


def children(node: Node) -> tuple[int, ...]:
    if isinstance(node, (And, Or)):
        return node.children
    return () if isinstance(node, (Term, Phrase)) else (node.child,)


@dataclass(frozen=True)
class Program:
    nodes: tuple[Node, ...]
    root: int
    depth: int = field(default=0)

    def __post_init__(self) -> None:
        if not 0 <= self.root < len(self.nodes):
            raise InvalidProgramRoot(self.root)
        for node in self.nodes:
            for c in children(node):
                if not 0 <= c < len(self.nodes):
                    raise InvalidProgramReference(c)
        state: dict[int, int] = {}
        for start in (self.root, *range(len(self.nodes))):
            todo = [(start, False)]
            while todo:
                at, leaving = todo.pop()
                if leaving:
                    state[at] = 2
                elif state.get(at) == 1:
                    raise ProgramCycle(at)
                elif at not in state:
                    state[at] = 1
                    todo.append((at, True))
                    todo.extend((c, False) for c in children(self.nodes[at]) if state.get(c) != 2)
            if start == self.root and len(state) < len(self.nodes) and self._acyclic(state):
                raise UnreachableProgramNode(next(i for i in range(len(self.nodes)) if i not in state))
        if not self.depth:
            object.__setattr__(self, "depth", self._depth())

    def _acyclic(self, reached: dict[int, int]) -> bool:
        """Cycles count before nodes that can't be reached."""
        rest = {i: [c for c in children(n) if c not in reached] for i, n in enumerate(self.nodes) if i not in reached}
        while free := [i for i, c in rest.items() if not any(x in rest for x in c)]:
            for i in free:
                del rest[i]
        return not rest

    def _depth(self) -> int:
        known: dict[int, int] = {}
        todo = [self.root]
        while todo:
            at = todo[-1]
            below = children(self.nodes[at])
            wait = [c for c in below if c not in known]
            if wait:
                todo.extend(wait)
            else:
                known[at] = 1 + max((known[c] for c in below), default=0)
                todo.pop()
        return known[self.root]


@dataclass(frozen=True)
class FeatureSet:
    term_frequencies: bool = False
    positions: bool = False
    field_stats: bool = False

    @classmethod
    def basic(cls) -> FeatureSet:
        return cls(term_frequencies=True)


@dataclass(frozen=True)
class ExecutionPlan:
    program: Program
    selectivity: float
    cost: int
    required_features: FeatureSet = FeatureSet.basic()

    @classmethod
    def of(cls, program: Program) -> ExecutionPlan:
        return cls(program, 1 / len(program.nodes), len(program.nodes))

    def wrap_external_filter(self, slot: int) -> ExecutionPlan:
        p = self.program
        wrapped = Program((*p.nodes, ExternalFilter(p.root, slot)), len(p.nodes), p.depth + 1)
        n = len(wrapped.nodes)
        return replace(self, program=wrapped, cost=n, selectivity=1 / n)
