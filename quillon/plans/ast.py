"""Programs as users build them: an arena of term, phrase, boolean and boost nodes, with typed views."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from quillon.errors import InvalidNodeId, WrongNodeType


@dataclass(frozen=True)
class UserTerm:
    term: str
    field: str | None = None
    boost: float = 1.0


@dataclass(frozen=True)
class UserPhrase:
    terms: tuple[str, ...]
    slop: int = 0
    field: str | None = None


@dataclass(frozen=True)
class UserBoolean:
    """op: and, or, not."""

    op: str
    children: tuple[int, ...]


@dataclass(frozen=True)
class UserBoost:
    child: int
    factor: float


UserNode = UserTerm | UserPhrase | UserBoolean | UserBoost


@dataclass(frozen=True)
class UserProgram:
    nodes: tuple[UserNode, ...]
    root: int

    @property
    def node_count(self) -> int:
        return len(self.nodes)

    def get(self, node: int) -> UserNode | None:
        return self.nodes[node] if 0 <= node < len(self.nodes) else None

    def children_of(self, node: int) -> tuple[int, ...]:
        n = self.get(node)
        if isinstance(n, UserBoolean):
            return n.children
        return (n.child,) if isinstance(n, UserBoost) else ()

    def walk(self) -> Iterator[tuple[int, UserNode]]:
        """Nodes from the root, parents first, each once; ids that point nowhere are passed over."""
        seen: set[int] = set()
        todo = [self.root]
        while todo:
            at = todo.pop()
            node = self.get(at)
            if node is None or at in seen:
                continue
            seen.add(at)
            yield at, node
            todo.extend(reversed(self.children_of(at)))

    def _view(self, node: int, kind: type) -> UserNode:
        n = self.get(node)
        if n is None:
            raise InvalidNodeId(node)
        if not isinstance(n, kind):
            raise WrongNodeType(f"{node} is a {type(n).__name__}")
        return n

    def as_term(self, node: int) -> UserTerm:
        return self._view(node, UserTerm)  # type: ignore[return-value]

    def as_phrase(self, node: int) -> UserPhrase:
        return self._view(node, UserPhrase)  # type: ignore[return-value]

    def as_boolean(self, node: int) -> UserBoolean:
        return self._view(node, UserBoolean)  # type: ignore[return-value]

    def as_boost(self, node: int) -> UserBoost:
        return self._view(node, UserBoost)  # type: ignore[return-value]


class QueryBuilder:
    """Each call adds a node, which becomes the root, and returns its id."""

    def __init__(self) -> None:
        self._nodes: list[UserNode] = []
        self._root: int | None = None

    def _add(self, node: UserNode) -> int:
        self._nodes.append(node)
        self._root = len(self._nodes) - 1
        return self._root

    def term(self, term: str) -> int:
        return self._add(UserTerm(term))

    def term_with_field(self, term: str, field: str) -> int:
        return self._add(UserTerm(term, field))

    def phrase(self, terms: list[str]) -> int:
        return self._add(UserPhrase(tuple(terms)))

    def phrase_with_slop(self, terms: list[str], slop: int) -> int:
        return self._add(UserPhrase(tuple(terms), slop))

    def and_(self, children: list[int]) -> int:
        return self._add(UserBoolean("and", tuple(children)))

    def or_(self, children: list[int]) -> int:
        return self._add(UserBoolean("or", tuple(children)))

    def not_(self, child: int) -> int:
        return self._add(UserBoolean("not", (child,)))

    def boost(self, child: int, factor: float) -> int:
        return self._add(UserBoost(child, factor))

    def set_root(self, node: int) -> QueryBuilder:
        self._root = node
        return self

    def build(self) -> UserProgram | None:
        """None if there are no nodes, or the root or a child is out of range."""
        if not self._nodes or self._root is None:
            return None
        program = UserProgram(tuple(self._nodes), self._root)
        ids = range(len(self._nodes))
        sound = self._root in ids and all(c in ids for i in ids for c in program.children_of(i))
        return program if sound else None


def term(text: str) -> UserProgram:
    return UserProgram((UserTerm(text),), 0)


def term_with_field(text: str, field: str) -> UserProgram:
    return UserProgram((UserTerm(text, field),), 0)


def phrase(terms: list[str]) -> UserProgram:
    return UserProgram((UserPhrase(tuple(terms)),), 0)


def phrase_with_slop(terms: list[str], slop: int) -> UserProgram:
    return UserProgram((UserPhrase(tuple(terms), slop),), 0)
