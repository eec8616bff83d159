"""Chat formatting: a template compiler.

A small template language, its syntax that of common chat templates, is parsed
into a tree, constants are folded, and the tree becomes Python closures. It is
a sandbox: there are no calls but those of the named filters, tests and
functions, members are only looked up in mappings, sequences and strings'
own slices, names with an underscore in front are refused, and a rendering has
a budget of steps that grows with the number of messages, and one of memory
that grows with their length.

    {{ expr }}   {% if %} {% elif %} {% else %} {% endif %}
    {% for x in xs %} {% else %} {% endfor %}   {% set x = expr %}
    {% generation %} ... {% endgeneration %}    {# comment #}   {%- and -%}

``generation`` marks what the model is to learn: rendering gives the text and
the (start, end) characters of each mark.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import _base

CHATML = "{% for m in messages %}{{ '<|im_start|>' + m.role + '\n' }}{% if m.role == 'assistant' %}{% generation %}{{ m.content }}<|im_end|>{% endgeneration %}{% else %}{{ m.content }}<|im_end|>{% endif %}{{ '\n' }}{% endfor %}"
#: What a rendering may take: so many steps, and so many for each message.
MAX_STEPS, STEPS_PER_MESSAGE = 1_000_000, 1_000
#: How long the output, and any value on the way, may get: so many characters or items, and so many for each character of the messages.
MAX_SIZE, SIZE_PER_CHAR = 1_000_000, 100


class TemplateError(ValueError):
    """Bad syntax, something the sandbox refuses, or raise_exception."""


class Undefined:
    """What a missing name or member gives: empty text, false, no members."""

    def __str__(self) -> str:
        return ""

    def __bool__(self) -> bool:
        return False

    def __iter__(self):
        return iter(())

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Undefined)

    __hash__ = None  # type: ignore[assignment]


MISSING = Undefined()


class Node(NamedTuple):
    kind: str
    args: tuple


# ---- parsing -------------------------------------------------------------

_TAG = re.compile(r"\{\{-?|\{%-?|\{#")
_WORD = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|\*\*|[-+*/%~<>()\[\]{}.,:|=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


def _lex(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(source):
        m = _WORD.match(source, at)
        if not m:
            if source[at:].strip():
                raise TemplateError(f"unexpected {source[at:].strip()[:20]!r}")
            break
        kind = m.lastgroup or ""
        out.append((kind, m.group(kind)))
        at = m.end()
    return out


def _close(source: str, at: int, mark: str) -> int:
    """Place of the closing mark, outside of strings."""
    quote = ""
    while at < len(source):
        c = source[at]
        if quote:
            if c == "\\":
                at += 1
            elif c == quote:
                quote = ""
        elif c in "'\"":
            quote = c
        elif source.startswith(mark, at):
            return at
        at += 1
    raise TemplateError(f"{mark} is missing")


def _split(source: str) -> list[tuple[str, str]]:
    """(text | expr | tag, content) parts, white space trimmed where a dash asks for it."""
    out: list[tuple[str, str]] = []
    at, trim = 0, False
    while True:
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else len(source)]
        if trim:
            text = text.lstrip()
        if m and m.group().endswith("-"):
            text = text.rstrip()
        if text:
            out.append(("text", text))
        if not m:
            return out
        if m.group() == "{#":
            end = source.find("#}", m.end())
            if end < 0:
                raise TemplateError("#} is missing")
            trim, at = source[end - 1] == "-", end + 2
            continue
        mark = "}}" if m.group().startswith("{{") else "%}"
        end = _close(source, m.end(), mark)
        body = source[m.end() : end]
        trim = body.endswith("-")
        out.append(("expr" if mark == "}}" else "tag", body[:-1] if trim else body))
        at = end + 2


class _Parser:
    def __init__(self, words: list[tuple[str, str]]):
        self.words, self.at = words, 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.words) and self.words[self.at][0] != "str" and self.words[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def name(self) -> str:
        if self.at >= len(self.words) or self.words[self.at][0] != "name":
            raise TemplateError("a name is expected")
        self.at += 1
        name = self.words[self.at - 1][1]
        if name.startswith("_"):
            raise TemplateError(f"name {name!r} is refused")
        return name

    def done(self) -> None:
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")

    def expression(self) -> Node:
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.expression() if self.take("else") else Node("const", (MISSING,))
            return Node("cond", (test, value, other))
        return value

    def either(self) -> Node:
        left = self.both()
        while self.take("or"):
            left = Node("or", (left, self.both()))
        return left

    def both(self) -> Node:
        left = self.negated()
        while self.take("and"):
            left = Node("and", (left, self.negated()))
        return left

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        left = self.joined()
        while True:
            if op := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                left = Node("binary", (op, left, self.joined()))
            elif self.peek("not"):
                self.at += 1
                self.need("in")
                left = Node("not", (Node("binary", ("in", left, self.joined())),))
            elif self.take("is"):
                negative = self.take("not")
                test = self.name()
                if test not in TESTS:
                    raise TemplateError(f"no test {test!r}")
                left = Node("test", (test, left))
                left = Node("not", (left,)) if negative else left
            else:
                return left

    def joined(self) -> Node:
        left = self.sum()
        while self.take("~"):
            left = Node("binary", ("~", left, self.sum()))
        return left

    def sum(self) -> Node:
        left = self.product()
        while op := self.take("+", "-"):
            left = Node("binary", (op, left, self.product()))
        return left

    def product(self) -> Node:
        left = self.unary()
        while op := self.take("*", "/", "//", "%"):
            left = Node("binary", (op, left, self.unary()))
        return left

    def unary(self) -> Node:
        return Node("minus", (self.unary(),)) if self.take("-") else self.filtered()

    def filtered(self) -> Node:
        value = self.postfix()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS and name not in GROWING:
                raise TemplateError(f"no filter {name!r}")
            value = Node("filter", (name, value, self.arguments() if self.take("(") else ()))
        return value

    def arguments(self) -> tuple[Node, ...]:
        out = []
        while not self.take(")"):
            out.append(self.expression())
            if not self.peek(")"):
                self.need(",")
        return tuple(out)

    def postfix(self) -> Node:
        value = self.atom()
        while True:
            if self.take("."):
                value = Node("member", (value, Node("const", (self.name(),))))
            elif self.take("["):
                if self.take(":"):
                    value = self.slice(value, None)
                else:
                    key = self.expression()
                    if self.take(":"):
                        value = self.slice(value, key)
                    else:
                        self.need("]")
                        value = Node("member", (value, key))
            elif self.peek("("):
                if value.kind != "name" or value.args[0] not in FUNCTIONS:
                    raise TemplateError("only the given functions can be called")
                self.at += 1
                value = Node("call", (value.args[0], self.arguments()))
            else:
                return value

    def slice(self, value: Node, start: Node | None) -> Node:
        stop = None if self.peek("]") else self.expression()
        self.need("]")
        none = Node("const", (None,))
        return Node("slice", (value, start or none, stop or none))

    def atom(self) -> Node:
        if self.at >= len(self.words):
            raise TemplateError("an expression ends early")
        kind, value = self.words[self.at]
        if kind == "name" and value in ("true", "True", "false", "False", "none", "None"):
            self.at += 1
            return Node("const", ({"t": True, "f": False, "n": None}[value[0].lower()],))
        if kind == "name":
            return Node("name", (self.name(),))
        self.at += 1
        if kind == "num":
            return Node("const", (float(value) if "." in value else int(value),))
        if kind == "str":
            return Node("const", (re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), value[1:-1], flags=re.S),))
        if value == "(":
            inner = self.expression()
            self.need(")")
            return inner
        if value == "[":
            items = []
            while not self.take("]"):
                items.append(self.expression())
                if not self.peek("]"):
                    self.need(",")
            return Node("list", tuple(items))
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    parts = _split(source)
    node, at, _ = _block(parts, 0, ())
    if at < len(parts):
        raise TemplateError(f"unexpected {parts[at][1].strip()!r}")
    return node


def _block(parts: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[Node, int, str]:
    """Parts up to a tag whose first word is in ``ends``."""
    body: list[Node] = []
    while at < len(parts):
        kind, content = parts[at]
        if kind == "text":
            body.append(Node("text", (content,)))
            at += 1
            continue
        p = _Parser(_lex(content))
        if kind == "expr":
            body.append(Node("output", (p.expression(),)))
            p.done()
            at += 1
            continue
        word = p.name()
        if word in ends:
            return Node("block", tuple(body)), at, word
        at += 1
        if word == "set":
            name = p.name()
            p.need("=")
            body.append(Node("set", (name, p.expression())))
            p.done()
        elif word == "for":
            name = p.name()
            p.need("in")
            items = p.either()
            p.done()
            inner, at, end = _block(parts, at, ("else", "endfor"))
            other = Node("block", ())
            if end == "else":
                other, at, _ = _block(parts, at + 1, ("endfor",))
            body.append(Node("for", (name, items, inner, other)))
            at = _ended(parts, at)
        elif word == "if":
            arms, test = [], p.expression()
            p.done()
            other = Node("block", ())
            while True:
                inner, at, end = _block(parts, at, ("elif", "else", "endif"))
                arms.append((test, inner))
                if at >= len(parts):
                    break
                if end == "elif":
                    p = _Parser(_lex(parts[at][1]))
                    p.name()
                    test = p.expression()
                    p.done()
                    at += 1
                elif end == "else":
                    other, at, _ = _block(parts, at + 1, ("endif",))
                    break
                else:
                    break
            body.append(Node("if", (tuple(arms), other)))
            at = _ended(parts, at)
        elif word == "generation":
            p.done()
            inner, at, _ = _block(parts, at, ("endgeneration",))
            body.append(Node("generation", (inner,)))
            at = _ended(parts, at)
        else:
            raise TemplateError(f"no tag {word!r}")
    if ends:
        raise TemplateError(f"{ends[-1]} is missing")
    return Node("block", tuple(body)), at, ""


def _ended(parts: list[tuple[str, str]], at: int) -> int:
    if at >= len(parts):
        raise TemplateError("a block isn't ended")
    return at + 1


# ---- values --------------------------------------------------------------


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _raise(message: Any) -> Any:
    raise TemplateError(_text(message))


def _length(x: Any) -> int:
    return len(x) if isinstance(x, (str, list, tuple, dict, range)) else 0


FILTERS: dict[str, Callable] = {
    "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": _length, "count": _length,
    "default": lambda x, d="": d if isinstance(x, Undefined) else x, "string": _text,
    "first": lambda x: x[0] if x else MISSING, "last": lambda x: x[-1] if x else MISSING, "int": lambda x: int(x or 0), "tojson": lambda x: json.dumps(x, ensure_ascii=False),
    "title": lambda x: _text(x).title(), "capitalize": lambda x: _text(x).capitalize(),
}
#: Filters whose result may be larger than what they are given: they also get the rendering.
GROWING: dict[str, Callable] = {
    "join": lambda r, x, by="": r.fits(_text(by), len(list(x))) and _text(by).join(map(_text, x)), "list": lambda r, x: r.fits(x) and list(x),
    "replace": lambda r, x, old, new: r.fits(_text(new), 1 + _text(x).count(_text(old))) and _text(x).replace(_text(old), _text(new)),
}
TESTS: dict[str, Callable] = {
    "defined": lambda x: not isinstance(x, Undefined), "undefined": lambda x: isinstance(x, Undefined), "none": lambda x: x is None, "string": lambda x: isinstance(x, str),
    "mapping": lambda x: isinstance(x, dict), "sequence": lambda x: isinstance(x, (str, list, tuple)), "iterable": lambda x: isinstance(x, (str, list, tuple, dict, range)),
    "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool), "boolean": lambda x: isinstance(x, bool), "odd": lambda x: x % 2 == 1, "even": lambda x: x % 2 == 0,
    "true": lambda x: x is True, "false": lambda x: x is False,
}
FUNCTIONS: dict[str, Callable] = {"raise_exception": _raise, "range": lambda *a: range(*a)}
PURE = {"range"}


def _member(value: Any, key: Any) -> Any:
    if isinstance(key, str) and key.startswith("_"):
        raise TemplateError(f"member {key!r} is refused")
    if isinstance(value, dict):
        return value.get(key, MISSING)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int):
        return value[key] if -len(value) <= key < len(value) else MISSING
    return MISSING


def _times(a: Any, b: Any) -> Any:
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a * b
    raise TemplateError("only numbers can be multiplied")


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, (str, Undefined)) or isinstance(b, (str, Undefined)):
        return _text(a) + _text(b)
    return a + b


BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b if isinstance(b, (str, list, tuple, dict)) and not (isinstance(b, str) and not isinstance(a, str)) else False,
    "~": lambda a, b: _text(a) + _text(b), "+": _plus, "-": lambda a, b: a - b, "*": _times, "/": lambda a, b: a / b, "//": lambda a, b: a // b, "%": lambda a, b: _mod(a, b),
}


def _mod(a: Any, b: Any) -> Any:
    if isinstance(a, str):
        raise TemplateError("% is for numbers")
    return a % b


# ---- folding -------------------------------------------------------------


def fold(node: Node) -> Node:
    """The tree with constant parts computed, untaken branches gone and neighbouring texts joined."""
    if not isinstance(node, Node):
        return tuple(fold(x) for x in node) if isinstance(node, tuple) else node
    n = Node(node.kind, tuple(fold(a) if isinstance(a, (Node, tuple)) else a for a in node.args) if node.kind != "const" else node.args)
    kind, args = n
    const = lambda x: isinstance(x, Node) and x.kind == "const"
    if kind == "block":
        out: list[Node] = []
        for x in args:
            for y in x.args if x.kind == "block" else (x,):
                if y.kind == "text" and out and out[-1].kind == "text":
                    out[-1] = Node("text", (out[-1].args[0] + y.args[0],))
                elif y.kind != "text" or y.args[0]:
                    out.append(y)
        return Node("block", tuple(out))
    if kind == "output" and const(args[0]):
        return Node("text", (_text(args[0].args[0]),))
    if kind == "if":
        arms = []
        for test, body in args[0]:
            if const(test):
                if test.args[0]:
                    return body if not arms else Node("if", (tuple(arms), body))
                continue
            arms.append((test, body))
        return Node("if", (tuple(arms), args[1])) if arms else args[1]
    if kind in ("and", "or") and const(args[0]):
        return args[1] if bool(args[0].args[0]) == (kind == "and") else args[0]
    if kind == "cond" and const(args[0]):
        return args[1] if args[0].args[0] else args[2]
    pure = kind in ("not", "minus", "binary", "test", "filter", "member", "slice", "list") or kind == "call" and args[0] in PURE
    inner = [y for x in args for y in (x if isinstance(x, tuple) and not isinstance(x, Node) else (x,)) if isinstance(y, Node)]
    if pure and all(map(const, inner)):
        try:
            value = _closure(n)(_Run({}))
        except Exception:  # it fails when it is rendered, if ever
            return n
        return Node("const", (value,)) if not isinstance(value, (list, range)) else n
    return n


# ---- closures ------------------------------------------------------------


class _Run:
    __slots__ = ("names", "out", "size", "marks", "steps", "most", "room")

    def __init__(self, names: dict):
        self.names, self.out, self.size, self.marks, self.steps = names, [], 0, [], 0
        messages = names.get("messages")
        messages = messages if isinstance(messages, (list, tuple)) else ()
        self.most = MAX_STEPS + STEPS_PER_MESSAGE * len(messages)
        self.room = MAX_SIZE + SIZE_PER_CHAR * sum(len(x) + 1 for m in messages if isinstance(m, dict) for x in m.values() if isinstance(x, str))

    def write(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)
        if self.size > self.room:
            raise TemplateError("too long a text")

    def fits(self, value: Any, times: int = 1) -> bool:
        """True, or an error if so many times the value is more than there is room for."""
        if isinstance(value, (str, list, tuple, dict, range)) and len(value) * times > self.room:
            raise TemplateError("too large a value")
        return True

    def checked(self, value: Any) -> Any:
        return value if self.fits(value) else None


def _closure(node: Node) -> Callable[[_Run], Any]:
    kind, a = node
    if kind == "const":
        value = a[0]
        return lambda r: value
    if kind == "name":
        name = a[0]
        return lambda r: r.names.get(name, MISSING)
    if kind == "list":
        items = [_closure(x) for x in a]
        return lambda r: [f(r) for f in items]
    if kind == "member":
        value, key = map(_closure, a)
        return lambda r: _member(value(r), key(r))
    if kind == "slice":
        value, start, stop = map(_closure, a)
        return lambda r: v[start(r) : stop(r)] if isinstance(v := value(r), (str, list, tuple)) else MISSING
    if kind == "not":
        inner = _closure(a[0])
        return lambda r: not inner(r)
    if kind == "minus":
        inner = _closure(a[0])
        return lambda r: -inner(r)
    if kind in ("and", "or"):
        left, right = map(_closure, a)
        return (lambda r: left(r) and right(r)) if kind == "and" else (lambda r: left(r) or right(r))
    if kind == "cond":
        test, yes, no = map(_closure, a)
        return lambda r: yes(r) if test(r) else no(r)
    if kind == "binary":
        op, left, right = BINARY[a[0]], _closure(a[1]), _closure(a[2])
        return (lambda r: r.checked(op(left(r), right(r)))) if a[0] in "+~" else (lambda r: op(left(r), right(r)))
    if kind == "test":
        test, inner = TESTS[a[0]], _closure(a[1])
        return lambda r: test(inner(r))
    if kind == "filter":
        inner, extra = _closure(a[1]), [_closure(x) for x in a[2]]
        if a[0] in GROWING:
            grow = GROWING[a[0]]
            return lambda r: r.checked(grow(r, inner(r), *(x(r) for x in extra)))
        f = FILTERS[a[0]]
        return lambda r: f(inner(r), *(x(r) for x in extra))
    if kind == "call":
        f, extra = FUNCTIONS[a[0]], [_closure(x) for x in a[1]]
        return lambda r: f(*(x(r) for x in extra))
    if kind == "text":
        text = a[0]
        return lambda r: r.write(text)
    if kind == "output":
        inner = _closure(a[0])
        return lambda r: r.write(_text(inner(r)))
    if kind == "block":
        body = [_closure(x) for x in a]

        def run_block(r: _Run) -> None:
            r.steps += len(body)
            if r.steps > r.most:
                raise TemplateError("too many steps")
            for f in body:
                f(r)

        return run_block
    if kind == "set":
        name, inner = a[0], _closure(a[1])
        return lambda r: r.names.__setitem__(name, inner(r))
    if kind == "if":
        arms = [(_closure(t), _closure(b)) for t, b in a[0]]
        other = _closure(a[1])

        def run_if(r: _Run) -> None:
            for test, body in arms:
                if test(r):
                    return body(r)
            return other(r)

        return run_if
    if kind == "generation":
        inner = _closure(a[0])

        def run_marked(r: _Run) -> None:
            start = r.size
            inner(r)
            r.marks.append((start, r.size))

        return run_marked
    name, items, body, other = a[0], _closure(a[1]), _closure(a[2]), _closure(a[3])

    def run_for(r: _Run) -> None:
        values = items(r)
        if not isinstance(values, (list, tuple, dict, range, str)):
            values = []
        n = len(values)
        outer = r.names
        if not n:
            return other(r)
        for i, value in enumerate(values):
            loop = {"index": i + 1, "index0": i, "first": i == 0, "last": i == n - 1, "length": n}
            r.names = {**outer, name: value, "loop": loop}
            body(r)
        r.names = outer

    return run_for


class Template:
    def __init__(self, source: str):
        try:
            self.tree = fold(parse(source))
            self._run = _closure(self.tree)
        except RecursionError as e:
            raise TemplateError("nested too deeply") from e

    def render(self, names: dict) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the start and end of each generation mark. An empty mark is kept."""
        r = _Run(dict(names))
        self._run(r)
        return "".join(r.out), r.marks


# ---- conversations -------------------------------------------------------


def format_conversations(turns: DataFrame, template: str = CHATML, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, text, spans, error): one row for each conversation, its turns in order.

    spans is "start:end,..." in characters, in order. Turns with equal numbers
    go by role, then text; null numbers come first. A null role or text is an
    empty one. Turns with a null id are one conversation. Repeated rows are
    repeated turns. Where the template raises, text and spans are null and
    error says why; else error is null. A bad template raises at once.
    """
    Template(template)
    d = _base.pick(turns, conv_id=id_col, turn=turn_col, role=role_col, content=text_col)
    message = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("content", F.lit("")).alias("content"))
    d = d.groupBy("conv_id").agg(F.array_sort(F.collect_list(message), _order).alias("messages"))
    d = d.select("conv_id", F.transform("messages", lambda m: F.struct(m.role.alias("role"), m.content.alias("content"))).alias("messages"))
    out = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "spans", "error")])

    @F.arrow_udf(out)
    def run(messages: pa.Array) -> pa.Array:
        made = Template(template)
        rows = []
        for m in messages:
            try:
                text, marks = made.render({"messages": m.as_py()})
                rows.append({"text": text, "spans": ",".join(f"{a}:{b}" for a, b in marks), "error": None})
            except (ValueError, TypeError, ArithmeticError, LookupError, AttributeError, RecursionError) as e:
                rows.append({"text": None, "spans": None, "error": str(e)})
        return pa.array(rows, pa.struct([("text", pa.string()), ("spans", pa.string()), ("error", pa.string())]))

    done = d.select("conv_id", F.size("messages").cast("long").alias("n_turns"), run("messages").alias("r"))
    return done.select("conv_id", "n_turns", "r.text", "r.spans", "r.error")


def _order(a, b):
    def by(x, y, rest):
        return F.when(x < y, -1).when(x > y, 1).otherwise(rest)

    last = by(a.content, b.content, F.lit(0))
    same = by(a.role, b.role, last)
    null = F.when(a.turn.isNull() & b.turn.isNull(), same).when(a.turn.isNull(), -1).when(b.turn.isNull(), 1)
    return null.otherwise(by(a.turn, b.turn, same))
