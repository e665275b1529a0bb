"""A model's own chat template, as the text that comes with it, compiled to Column expressions.

The language is the part of Jinja that chat templates use: output, ``for`` over messages, ``if``, ``set``,
namespaces, string operations, the tokens, and the wish for an answer. Everything that is known when
the plan is made (tokens, options, fields that messages do not have) is worked out then. What
is left becomes native expressions over the array of messages; what is not known raises a
``TemplateError`` with its line and column. Blocks are trimmed as tokenizers do it: a line
break after a block tag and blanks before one at the start of a line go.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.functions.strings import PYTHON_WHITESPACE


class TemplateError(ValueError):
    """What is wrong with a template, and where."""


# --- syntax ------------------------------------------------------------------------


class Token(NamedTuple):
    kind: str  # text, {{, }}, {%, %}, name, string, number, operator, end
    text: Any
    at: int


class Node(NamedTuple):
    kind: str
    at: int
    parts: tuple


_TAG = re.compile(r"\{#.*?#\}|\{\{[-+]?|\{%[-+]?", re.DOTALL)
_CLOSE = {"{{": re.compile(r"\s*([-+]?)\}\}"), "{%": re.compile(r"\s*([-+]?)%\}")}
_LEXEME = re.compile(
    r"""\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<number>\d+)|(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")"""
    r"""|(?P<operator>==|!=|<=|>=|//|[-+*/%~<>=()\[\].,:|{}]))""",
    re.DOTALL,
)
# What may follow a backslash in a quoted text.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"', "b": "\b", "f": "\f", "v": "\v", "0": "\0", "a": "\a"}


def _unquoted(text: str) -> str:
    def one(m: re.Match) -> str:
        if m[1]:
            return chr(int(m[1], 16))
        return _ESCAPES.get(m[2], m[0])

    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|(.))", one, text[1:-1], flags=re.DOTALL)


class Syntax:
    """From the text of a template to its tree."""

    def __init__(self, source: str) -> None:
        self.source = source.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n")
        self.tokens = self._tokens()
        self.next = 0

    def error(self, message: str, at: int) -> TemplateError:
        line = self.source.count("\n", 0, at) + 1
        column = at - (self.source.rfind("\n", 0, at) + 1) + 1
        return TemplateError(f"chat template, line {line}, column {column}: {message}")

    def _tokens(self) -> list[Token]:
        source, at, out = self.source, 0, []
        trim = False  # whether white space goes from the start of the next text
        newline = False  # or one line break
        while True:
            tag = _TAG.search(source, at)
            text = source[at : tag.start() if tag else len(source)]
            starts_line = at == 0 or (newline and text[:1] == "\n")
            if trim:
                text = text.lstrip()
            elif newline:
                text = text.removeprefix("\n")
            if tag:
                opened = tag[0]
                if opened.endswith("-") or (opened[:2] == "{#" and opened[2:3] == "-"):
                    text = text.rstrip()
                elif opened[:2] != "{{" and not opened.endswith("+"):
                    line = text.rfind("\n") + 1
                    if (starts_line or line) and not text[line:].strip():
                        text = text[:line]
            if text:
                out.append(Token("text", text, at))
            if not tag:
                return [*out, Token("end", "", len(source))]
            at = tag.end()
            if opened[:2] == "{#":
                trim, newline = opened[-3:-2] == "-", True
                continue
            out.append(Token(opened[:2], opened[:2], tag.start()))
            while not (closed := _CLOSE[opened[:2]].match(source, at)):
                found = _LEXEME.match(source, at)
                if not found:
                    raise self.error("this cannot be read", at)
                kind = found.lastgroup
                value: Any = found[kind]
                value = _unquoted(value) if kind == "string" else int(value) if kind == "number" else value
                out.append(Token(kind, value, found.start(kind)))
                at = found.end()
            out.append(Token("}}" if opened[:2] == "{{" else "%}", "", closed.start()))
            at = closed.end()
            trim, newline = closed[1] == "-", opened[:2] == "{%" and closed[1] != "+"

    # -- statements

    def parse(self) -> list[Node]:
        body, _ = self._body(())
        return body

    def _peek(self, *texts: str) -> bool:
        token = self.tokens[self.next]
        return token.kind in ("name", "operator") and token.text in texts

    def _take(self, *texts: str) -> Token:
        token = self.tokens[self.next]
        if texts and not (token.kind in ("name", "operator", "{{", "}}", "{%", "%}") and (token.text in texts or token.kind in texts)):
            raise self.error(f"expected {' or '.join(texts)}, found {str(token.text) or token.kind!r}", token.at)
        self.next += 1
        return token

    def _body(self, until: tuple[str, ...]) -> tuple[list[Node], str]:
        """The nodes up to one of these tags, whose name is consumed."""
        out: list[Node] = []
        while True:
            token = self._take()
            if token.kind == "end":
                if until:
                    raise self.error(f"the end is missing: {' or '.join(until)}", token.at)
                return out, ""
            if token.kind == "text":
                out.append(Node("text", token.at, (token.text,)))
            elif token.kind == "{{":
                out.append(Node("print", token.at, (self._expression(),)))
                self._take("}}")
            else:
                name = self._take()
                if name.kind == "name" and name.text in until:
                    return out, name.text
                out.append(self._statement(name))

    def _statement(self, name: Token) -> Node:
        if name.kind != "name":
            raise self.error("a block needs a name", name.at)
        if name.text == "if":
            return self._if(name.at)
        if name.text == "for":
            target = self._take()
            if target.kind != "name":
                raise self.error("only one loop variable is known", target.at)
            self._take("in")
            items = self._or()
            only = None
            if self._peek("if"):
                self._take()
                only = self._expression()
            self._take("%}")
            body, _ = self._body(("endfor",))
            self._take("%}")
            return Node("for", name.at, (target.text, items, only, body))
        if name.text == "set":
            target = self._take().text
            part = None
            if self._peek("."):
                self._take()
                part = self._take().text
            self._take("=")
            value = self._expression()
            self._take("%}")
            return Node("set", name.at, (target, part, value))
        if name.text == "generation":  # marks what a model is trained on, and renders it
            self._take("%}")
            body, _ = self._body(("endgeneration",))
            self._take("%}")
            return Node("block", name.at, (body,))
        raise self.error(f"the block {name.text!r} is not known", name.at)

    def _if(self, at: int) -> Node:
        test = self._expression()
        self._take("%}")
        body, ended = self._body(("elif", "else", "endif"))
        if ended == "elif":
            return Node("if", at, (test, body, [self._if(at)]))
        self._take("%}")
        other: list[Node] = []
        if ended == "else":
            other, _ = self._body(("endif",))
            self._take("%}")
        return Node("if", at, (test, body, other))

    # -- expressions, loosest first

    def _expression(self) -> Node:
        value = self._or()
        while self._peek("if"):
            at = self._take().at
            test = self._or()
            other = Node("constant", at, ("",))
            if self._peek("else"):
                self._take()
                other = self._expression()
            value = Node("choose", at, (test, value, other))
        return value

    def _or(self) -> Node:
        value = self._and()
        while self._peek("or"):
            value = Node("or", self._take().at, (value, self._and()))
        return value

    def _and(self) -> Node:
        value = self._not()
        while self._peek("and"):
            value = Node("and", self._take().at, (value, self._not()))
        return value

    def _not(self) -> Node:
        if self._peek("not"):
            return Node("not", self._take().at, (self._not(),))
        return self._comparison()

    def _comparison(self) -> Node:
        value = self._sum()
        while True:
            if self._peek("==", "!=", "<", "<=", ">", ">="):
                sign = self._take()
                value = Node("compare", sign.at, (sign.text, value, self._sum()))
            elif self._peek("in"):
                value = Node("in", self._take().at, (value, self._sum()))
            elif self._peek("not"):
                at = self._take().at
                self._take("in")
                value = Node("not", at, (Node("in", at, (value, self._sum())),))
            else:
                return value

    def _sum(self) -> Node:
        value = self._joined()
        while self._peek("+", "-"):
            sign = self._take()
            value = Node("arithmetic", sign.at, (sign.text, value, self._joined()))
        return value

    def _joined(self) -> Node:
        value = self._product()
        while self._peek("~"):
            value = Node("join", self._take().at, (value, self._product()))
        return value

    def _product(self) -> Node:
        value = self._unary()
        while self._peek("*", "//", "%"):
            sign = self._take()
            value = Node("arithmetic", sign.at, (sign.text, value, self._unary()))
        return value

    def _unary(self) -> Node:
        if self._peek("-"):
            at = self._take().at
            return Node("arithmetic", at, ("-", Node("constant", at, (0,)), self._unary()))
        return self._postfix(self._primary())

    def _primary(self) -> Node:
        token = self._take()
        if token.kind == "string":
            text = token.text
            while self.tokens[self.next].kind == "string":
                text += self._take().text
            return Node("constant", token.at, (text,))
        if token.kind == "number":
            return Node("constant", token.at, (token.text,))
        if token.kind == "name":
            known = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
            if token.text in known:
                return Node("constant", token.at, (known[token.text],))
            return Node("name", token.at, (token.text,))
        if token.text == "(":
            value = self._expression()
            self._take(")")
            return value
        if token.text == "[":
            items = []
            while not self._peek("]"):
                items.append(self._expression())
                if not self._peek("]"):
                    self._take(",")
            self._take("]")
            return Node("list", token.at, tuple(items))
        raise self.error(f"{str(token.text) or token.kind!r} cannot start an expression", token.at)

    def _postfix(self, value: Node) -> Node:
        while True:
            if self._peek("."):
                at = self._take().at
                name = self._take().text
                if self._peek("("):
                    value = Node("method", at, (value, name, self._arguments()))
                else:
                    value = Node("attribute", at, (value, name))
            elif self._peek("["):
                value = self._item(value)
            elif self._peek("("):
                if value.kind != "name":
                    raise self.error("this cannot be called", self._take().at)
                value = Node("call", value.at, (value.parts[0], self._arguments()))
            elif self._peek("|"):
                at = self._take().at
                name = self._take().text
                given = self._arguments() if self._peek("(") else ([], {})
                value = Node("method", at, (value, f"|{name}", given))
            elif self._peek("is"):
                at = self._take().at
                negated = self._peek("not")
                if negated:
                    self._take()
                value = Node("is", at, (value, self._take().text))
                if negated:
                    value = Node("not", at, (value,))
            else:
                return value

    def _item(self, value: Node) -> Node:
        at = self._take("[").at
        parts: list[Node | None] = [None]
        while not self._peek("]"):
            if self._peek(":"):
                self._take()
                parts.append(None)
            else:
                parts[-1] = self._expression()
        self._take("]")
        if len(parts) == 1:
            if parts[0] is None:
                raise self.error("an index is missing", at)
            return Node("item", at, (value, parts[0]))
        return Node("slice", at, (value, *parts, *[None] * (3 - len(parts))))

    def _arguments(self) -> tuple[list[Node], dict[str, Node]]:
        self._take("(")
        given: list[Node] = []
        named: dict[str, Node] = {}
        while not self._peek(")"):
            token, after = self.tokens[self.next], self.tokens[self.next + 1]
            if token.kind == "name" and after.kind == "operator" and after.text == "=":
                self.next += 2
                named[token.text] = self._expression()
            else:
                given.append(self._expression())
            if not self._peek(")"):
                self._take(",")
        self._take(")")
        return given, named


# --- values ------------------------------------------------------------------------


class _Undefined:
    def __repr__(self) -> str:
        return "undefined"


UNDEFINED = _Undefined()


@dataclass(frozen=True)
class Known:
    """A value that is known when the plan is made; lists hold values."""

    value: Any


@dataclass(frozen=True)
class Found:
    """A value that every row has."""

    column: Column
    kind: T.DataType


@dataclass(frozen=True)
class Either:
    """One of two values of different kinds, by a condition."""

    test: Column
    yes: Any
    no: Any


@dataclass
class Namespace:
    name: str


Value = Known | Found | Either
_TEXT, _TRUTH, _WHOLE = T.StringType(), T.BooleanType(), T.IntegerType()


def _is(value: Value, *kinds: type[T.DataType]) -> bool:
    return isinstance(value, Found) and isinstance(value.kind, kinds)


def _same_kind(a: T.DataType, b: T.DataType) -> bool:
    whole = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)
    return a == b or (isinstance(a, whole) and isinstance(b, whole)) or (
        isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType) and _same_kind(a.elementType, b.elementType)
    )


def found(value: Value) -> Found | None:
    """A column for a value, if its kind has one."""
    if isinstance(value, Found):
        return value
    if isinstance(value, Known):
        for kind, column_kind in ((bool, _TRUTH), (int, _WHOLE), (str, _TEXT)):
            if isinstance(value.value, kind):
                return Found(F.lit(value.value), column_kind)
    return None


def either(test: Column, yes: Value, no: Value) -> Value:
    if isinstance(yes, Known) and yes == no and type(yes.value) is type(no.value):
        return yes
    a, b = found(yes), found(no)
    if a and b and _same_kind(a.kind, b.kind):
        return Found(F.when(test, a.column).otherwise(b.column), a.kind)
    return Either(test, yes, no)


def lifted(body: Callable[..., Value], *values: Value) -> Value:
    """``body`` of values, each of which may be one of two."""
    for i, value in enumerate(values):
        if isinstance(value, Either):
            yes, no = (lifted(body, *values[:i], part, *values[i + 1 :]) for part in (value.yes, value.no))
            return either(value.test, yes, no)
    return body(*values)


def truth(value: Value) -> bool | Column:
    """Whether a value counts as true; a NULL does not."""
    if isinstance(value, Known):
        return bool(value.value) if value.value is not UNDEFINED else False
    if isinstance(value, Either):
        yes, no = truth(value.yes), truth(value.no)
        return F.when(value.test, _condition(yes)).otherwise(_condition(no))
    if isinstance(value.kind, T.BooleanType):
        test = value.column
    elif isinstance(value.kind, T.StringType):
        test = value.column != ""
    elif isinstance(value.kind, (T.ArrayType, T.MapType)):
        test = F.size(value.column) > 0
    elif isinstance(value.kind, T.NumericType):
        test = value.column != 0
    else:
        test = value.column.isNotNull()
    return F.coalesce(test, F.lit(False))


def _condition(test: bool | Column) -> Column:
    return F.lit(test) if isinstance(test, bool) else test


def _let(bound: Found, body: Callable[[Column], Column]) -> Column:
    """``body`` of a column that is computed once per row, not at each mention."""
    return F.get(F.transform(F.array(bound.column), lambda c: body(c)), F.lit(0))


# --- meaning -----------------------------------------------------------------------

_COMPARED = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
_COUNTED = {"+": operator.add, "-": operator.sub, "*": operator.mul}


@dataclass
class Compiler:
    """Renders the tree of a template over the columns of a row."""

    syntax: Syntax
    failure: Callable[[str], Column]
    scope: dict[str, Value | Namespace] = field(default_factory=dict)

    def error(self, message: str, node: Node) -> TemplateError:
        return self.syntax.error(message, node.at)

    # -- statements: the text of a body, with what follows inside the bindings it makes

    def body(
        self, nodes: Sequence[Node], scope: dict, pieces: list[Value],
        finish: Callable[[dict, list[Value]], Column], spine: bool = True,
    ) -> Column:
        for i, node in enumerate(nodes):
            rest = nodes[i + 1 :]

            def bound(names: list[str], scope: dict = scope, pieces: list[Value] = pieces, rest: Sequence[Node] = rest) -> Column:
                """The rest of the body with these variables computed once."""
                if not names:
                    return self.body(rest, scope, pieces, finish, spine)
                value = scope[names[0]]
                return _let(value, lambda c: bound(names[1:], {**scope, names[0]: Found(c, value.kind)}, pieces, rest))

            if node.kind == "text":
                pieces = [*pieces, Known(node.parts[0])]
            elif node.kind == "print":
                pieces = [*pieces, self.printed(self.value(node.parts[0], scope), node)]
            elif node.kind == "block":
                return self.body([*node.parts[0], *rest], scope, pieces, finish, spine)
            elif node.kind == "set":
                before, scope = scope, self.assigned(node, scope)
                changed = [k for k, v in scope.items() if v is not before.get(k) and isinstance(v, Found)]
                if changed and rest:
                    return bound(changed, scope)
            elif node.kind == "if":
                test = truth(self.value(node.parts[0], scope))
                if isinstance(test, bool):
                    return self.body([*node.parts[1 if test else 2], *rest], scope, pieces, finish, spine)
                if not _assigns(node):
                    yes, no = (self.text(part, scope, node) for part in node.parts[1:])
                    pieces = [*pieces, either(test, yes, no)]
                    continue
                (yes, after_yes), (no, after_no) = (self.inline(part, scope, node) for part in node.parts[1:])
                pieces = [*pieces, either(test, yes, no)]
                before, scope = scope, dict(scope)
                for name in {**after_yes, **after_no}:
                    a, b = (after.get(name, Known(UNDEFINED)) for after in (after_yes, after_no))
                    if a is not b:
                        scope[name] = either(test, a, b) if not isinstance(a, Namespace) else a
                changed = [k for k, v in scope.items() if v is not before.get(k) and isinstance(v, Found)]
                if changed and rest:
                    return bound(changed, scope)
            elif node.kind == "for":
                state = _states(node)
                if not state:
                    pieces = [*pieces, self.loop(node, scope)]
                    continue
                if not spine:
                    raise self.error("a loop that sets a namespace must not stand inside an if", node)
                final = self.fold(node, scope, state)

                def after(c: Column, scope: dict = scope, pieces: list[Value] = pieces, rest: Sequence[Node] = rest) -> Column:
                    kept = {s: Found(c[f"s{i}"], final.kind[f"s{i}"].dataType) for i, s in enumerate(state)}
                    return self.body(rest, {**scope, **kept}, [*pieces, Found(c["text"], _TEXT)], finish, spine)

                return _let(final, after)
        return finish(scope, pieces)

    def joined(self, pieces: Sequence[Value]) -> Value:
        """All pieces as one text; NULL if one is."""
        merged: list[Value] = []
        for piece in pieces:
            if merged and isinstance(piece, Known) and isinstance(merged[-1], Known):
                merged[-1] = Known(merged[-1].value + piece.value)
            elif piece != Known(""):
                merged.append(piece)
        if not merged:
            return Known("")
        if len(merged) == 1:
            return merged[0]
        return Found(F.concat(*[found(p).column for p in merged]), _TEXT)

    def text(self, nodes: Sequence[Node], scope: dict, node: Node) -> Value:
        """The text of a branch that sets nothing."""
        return self.inline(nodes, scope, node)[0]

    def inline(self, nodes: Sequence[Node], scope: dict, node: Node) -> tuple[Value, dict]:
        """The text of a branch and the variables behind it, without bindings."""
        pieces: list[Value] = []
        for part in nodes:
            if part.kind == "text":
                pieces.append(Known(part.parts[0]))
            elif part.kind == "print":
                pieces.append(self.printed(self.value(part.parts[0], scope), part))
            elif part.kind == "set":
                scope = self.assigned(part, scope)
            elif part.kind == "block":
                inner, scope = self.inline(part.parts[0], scope, part)
                pieces.append(inner)
            elif part.kind == "for":
                if _states(part):
                    raise self.error("a loop that sets a namespace must not stand inside an if", part)
                pieces.append(self.loop(part, scope))
            else:
                test = truth(self.value(part.parts[0], scope))
                if isinstance(test, bool):
                    inner, scope = self.inline(part.parts[1 if test else 2], scope, part)
                    pieces.append(inner)
                    continue
                (yes, after_yes), (no, after_no) = (self.inline(p, scope, part) for p in part.parts[1:])
                pieces.append(either(test, yes, no))
                scope = dict(scope)
                for name in {**after_yes, **after_no}:
                    a, b = (after.get(name, Known(UNDEFINED)) for after in (after_yes, after_no))
                    if a is not b and not isinstance(a, Namespace):
                        scope[name] = either(test, a, b)
        return self.joined(pieces), scope

    def assigned(self, node: Node, scope: dict) -> dict:
        name, part, given = node.parts
        if part is not None:
            if not isinstance(scope.get(name), Namespace):
                raise self.error(f"{name} is not a namespace", node)
            return {**scope, f"{name}.{part}": self.value(given, scope)}
        if given.kind == "call" and given.parts[0] == "namespace":
            positional, named = given.parts[1]
            if positional:
                raise self.error("a namespace takes names only", node)
            fields = {f"{name}.{k}": self.value(v, scope) for k, v in named.items()}
            return {**scope, name: Namespace(name), **fields}
        return {**scope, name: self.value(given, scope)}

    # -- loops

    def items(self, node: Node, scope: dict) -> Value:
        target, given, only, _ = node.parts
        items = self.value(given, scope)
        if only is not None and isinstance(items, Found):
            kind = items.kind.elementType
            keep = lambda m: _condition(truth(self.value(only, {**scope, target: Found(m, kind)})))
            return Found(F.filter(items.column, keep), items.kind)
        return items

    def inside(self, node: Node, scope: dict, items: Found, item: Column, index: Column) -> dict:
        """The scope of a loop's body."""
        size, kind = F.size(items.column), items.kind.elementType
        loop = {
            "index0": Found(index, _WHOLE), "index": Found(index + 1, _WHOLE), "first": Found(index == 0, _TRUTH),
            "last": Found(index == size - 1, _TRUTH), "length": Found(size, _WHOLE),
            "revindex": Found(size - index, _WHOLE), "revindex0": Found(size - index - 1, _WHOLE),
            "previtem": Found(F.get(items.column, index - 1), kind), "nextitem": Found(F.get(items.column, index + 1), kind),
        }
        return {**scope, node.parts[0]: Found(item, kind), **{f"loop.{k}": v for k, v in loop.items()}, "loop": Namespace("loop")}

    def loop(self, node: Node, scope: dict) -> Value:
        """The text of a loop whose rounds do not depend on each other."""
        items = self.items(node, scope)
        if isinstance(items, Either):
            yes, no = (self.loop(node._replace(parts=(node.parts[0], Node("given", node.at, (part,)), *node.parts[2:])), scope)
                       for part in (items.yes, items.no))
            return either(items.test, yes, no)
        if not _is(items, T.ArrayType):
            if items in (Known(UNDEFINED), Known(None), Known([])):
                return Known("")
            raise self.error("only a list of the messages can be looped over", node)

        def rounds(once: Column) -> Column:
            bound = Found(once, items.kind)

            def round_of(item: Column, index: Column) -> Column:
                return self.body(node.parts[3], self.inside(node, scope, bound, item, index), [], self.finished, False)

            return F.transform(once, round_of)

        pieces = Found(_let(items, rounds), T.ArrayType(_TEXT))
        whole = lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.array_join(p, ""))
        return Found(_let(pieces, whole), _TEXT)

    def finished(self, scope: dict, pieces: list[Value]) -> Column:
        return self.as_text(self.joined(pieces))

    def as_text(self, value: Value) -> Column:
        if isinstance(value, Either):
            return F.when(value.test, self.as_text(value.yes)).otherwise(self.as_text(value.no))
        return found(value).column

    def fold(self, node: Node, scope: dict, state: list[str]) -> Found:
        """The text of a loop and the namespace it leaves: its rounds are taken one after the other."""
        items = self.items(node, scope)
        if not _is(items, T.ArrayType):
            raise self.error("only a list of the messages can be looped over", node)
        starts = []
        for name in state:
            start = found(scope.get(name, Known(UNDEFINED)))
            if start is None:
                raise self.error(f"{name} needs a text, a number or a truth value before the loop", node)
            starts.append(start)
        kind = T.StructType([T.StructField("text", _TEXT), T.StructField("at", _WHOLE),
                             *[T.StructField(f"s{i}", s.kind) for i, s in enumerate(starts)]])
        as_kind = kind.simpleString()
        first = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"), *[s.column.alias(f"s{i}") for i, s in enumerate(starts)])

        def step(kept: Column, item: Column, items: Found) -> Column:
            inner = self.inside(node, scope, items, item, kept["at"])
            inner |= {name: Found(kept[f"s{i}"], s.kind) for i, (name, s) in enumerate(zip(state, starts))}

            def finish(scope: dict, pieces: list[Value]) -> Column:
                left = []
                for i, (name, s) in enumerate(zip(state, starts)):
                    now = found(scope[name])
                    if now is None or not _same_kind(now.kind, s.kind):
                        raise self.error(f"{name} must stay of one kind", node)
                    left.append(now.column.cast(s.kind).alias(f"s{i}"))
                text = F.concat(kept["text"], self.finished(scope, pieces)).alias("text")
                return F.struct(text, (kept["at"] + 1).alias("at"), *left).cast(as_kind)

            return self.body(node.parts[3], inner, [], finish, False)

        def rounds(once: Column) -> Column:
            bound = Found(once, items.kind)
            return F.aggregate(once, first.cast(as_kind), lambda kept, item: step(kept, item, bound))

        return Found(_let(items, rounds), kind)

    # -- expressions

    def value(self, node: Node, scope: dict) -> Value:
        return getattr(self, f"_{node.kind}")(node, scope)

    def printed(self, value: Value, node: Node) -> Value:
        def one(v: Value) -> Value:
            if isinstance(v, Known):
                if isinstance(v.value, (str, int)) or v.value is None:
                    return Known(str(v.value))
                if v.value is UNDEFINED:
                    return Known("")
            elif _is(v, T.StringType):
                return v
            elif _is(v, T.IntegralType):
                return Found(v.column.cast("string"), _TEXT)
            elif _is(v, T.BooleanType):
                return Found(F.when(v.column, "True").otherwise("False"), _TEXT)
            raise self.error("only texts and numbers can be put out", node)

        return lifted(one, value)

    def _given(self, node: Node, scope: dict) -> Value:
        return node.parts[0]

    def _constant(self, node: Node, scope: dict) -> Value:
        return Known(node.parts[0])

    def _name(self, node: Node, scope: dict) -> Value:
        value = scope.get(node.parts[0], Known(UNDEFINED))
        if isinstance(value, Namespace):
            raise self.error(f"{node.parts[0]} can only be asked for its parts", node)
        return value

    def _list(self, node: Node, scope: dict) -> Value:
        return Known([self.value(part, scope) for part in node.parts])

    def _choose(self, node: Node, scope: dict) -> Value:
        test = truth(self.value(node.parts[0], scope))
        if isinstance(test, bool):
            return self.value(node.parts[1 if test else 2], scope)
        return either(test, *[self.value(part, scope) for part in node.parts[1:]])

    def _or(self, node: Node, scope: dict) -> Value:
        first = self.value(node.parts[0], scope)
        test = truth(first)
        if isinstance(test, bool):
            return first if test else self.value(node.parts[1], scope)
        return either(test, first, self.value(node.parts[1], scope))

    def _and(self, node: Node, scope: dict) -> Value:
        first = self.value(node.parts[0], scope)
        test = truth(first)
        if isinstance(test, bool):
            return self.value(node.parts[1], scope) if test else first
        return either(test, self.value(node.parts[1], scope), first)

    def _not(self, node: Node, scope: dict) -> Value:
        test = truth(self.value(node.parts[0], scope))
        return Known(not test) if isinstance(test, bool) else Found(~test, _TRUTH)

    def _compare(self, node: Node, scope: dict) -> Value:
        sign, left, right = node.parts

        def one(a: Value, b: Value) -> Value:
            if isinstance(a, Known) and isinstance(b, Known):
                if sign in ("==", "!="):
                    return Known((a.value == b.value) == (sign == "=="))
                if type(a.value) is type(b.value) and isinstance(a.value, (int, str)):
                    return Known(_COMPARED[sign](a.value, b.value))
                raise self.error("these cannot be compared", node)
            none = next((x for x, y in ((a, b), (b, a)) if isinstance(y, Known) and y.value is None), None)
            x, y = found(a), found(b)
            if sign in ("==", "!="):
                if none is not None:
                    same = none.column.isNull()
                elif x and y and _same_kind(x.kind, y.kind):
                    same = x.column.eqNullSafe(y.column)
                else:  # of different kinds
                    return Known(sign == "!=")
                return Found(same if sign == "==" else ~same, _TRUTH)
            if x and y and _same_kind(x.kind, y.kind):
                return Found(_COMPARED[sign](x.column, y.column), _TRUTH)
            raise self.error("these cannot be compared", node)

        return lifted(one, self.value(left, scope), self.value(right, scope))

    def _in(self, node: Node, scope: dict) -> Value:
        def one(a: Value, b: Value) -> Value:
            if isinstance(b, Known) and isinstance(b.value, list):
                tests = [truth(self._compare(Node("compare", node.at, ("==", Node("given", node.at, (a,)), Node("given", node.at, (x,)))), scope))
                         for x in b.value]
                if any(t is True for t in tests):
                    return Known(True)
                open_ = [t for t in tests if t is not False]
                return Found(_any(open_), _TRUTH) if open_ else Known(False)
            x, y = found(a), found(b)
            if isinstance(a, Known) and isinstance(b, Known) and x and y:
                return Known(a.value in b.value)
            if x and y and isinstance(x.kind, T.StringType) and isinstance(y.kind, T.StringType):
                return Found(F.contains(y.column, x.column), _TRUTH)
            if x and _is(b, T.ArrayType) and _same_kind(x.kind, b.kind.elementType):
                return Found(F.coalesce(F.array_contains(b.column, x.column), F.lit(False)), _TRUTH)
            if isinstance(a, Known) and _is(b, T.StructType):
                return Known(a.value in b.kind.names)
            if x and _is(b, T.MapType):
                return Found(F.map_contains_key(b.column, x.column), _TRUTH)
            raise self.error("'in' needs a text or a list", node)

        return lifted(one, self.value(node.parts[0], scope), self.value(node.parts[1], scope))

    def _arithmetic(self, node: Node, scope: dict) -> Value:
        sign, left, right = node.parts

        def one(a: Value, b: Value) -> Value:
            for v in (a, b):
                if v in (Known(UNDEFINED), Known(None)):
                    raise self.error("an undefined value cannot be part of this", node)
            x, y = found(a), found(b)
            texts = x and y and isinstance(x.kind, T.StringType) and isinstance(y.kind, T.StringType)
            if texts and sign == "+":
                return self.joined([a, b])
            numbers = x and y and isinstance(x.kind, T.IntegralType) and isinstance(y.kind, T.IntegralType)
            if not numbers:
                raise self.error(f"{sign!r} needs two numbers" + (" or two texts" if sign == "+" else ""), node)
            if isinstance(a, Known) and isinstance(b, Known):
                whole = {"//": operator.floordiv, "%": operator.mod, **_COUNTED}
                return Known(whole[sign](a.value, b.value))
            if sign in _COUNTED:
                return Found(_COUNTED[sign](x.column, y.column), _WHOLE)
            rest = F.pmod(x.column, y.column)
            return Found(rest if sign == "%" else F.round((x.column - rest) / y.column).cast("int"), _WHOLE)

        return lifted(one, self.value(left, scope), self.value(right, scope))

    def _join(self, node: Node, scope: dict) -> Value:
        parts = [self.printed(self.value(p, scope), node) for p in node.parts]
        return lifted(lambda a, b: self.joined([a, b]), *parts)

    def _attribute(self, node: Node, scope: dict) -> Value:
        base, name = node.parts
        if base.kind == "name" and isinstance(scope.get(base.parts[0]), Namespace):
            value = scope.get(f"{base.parts[0]}.{name}")
            if value is None:
                raise self.error(f"{base.parts[0]} has no part {name}", node)
            return value
        return lifted(lambda v: self._field(v, name, node), self.value(base, scope))

    def _field(self, value: Value, name: str, node: Node) -> Value:
        if _is(value, T.StructType):
            if name not in value.kind.names:
                return Known(UNDEFINED)
            return Found(value.column[name], value.kind[name].dataType)
        if _is(value, T.MapType):
            return Found(F.try_element_at(value.column, F.lit(name)), value.kind.valueType)
        if value == Known(UNDEFINED):
            raise self.error(f"an undefined value has no part {name!r}", node)
        return Known(UNDEFINED)

    def _item(self, node: Node, scope: dict) -> Value:
        def one(value: Value, at: Value) -> Value:
            if isinstance(at, Known) and isinstance(at.value, str):
                return self._field(value, at.value, node)
            where = found(at)
            if where is None or not isinstance(where.kind, T.IntegralType):
                raise self.error("an index must be a number or a quoted name", node)
            if isinstance(value, Known) and isinstance(value.value, list) and isinstance(at, Known):
                inside = -len(value.value) <= at.value < len(value.value)
                return value.value[at.value] if inside else Known(UNDEFINED)
            if not _is(value, T.ArrayType):
                raise self.error("only a list has numbered items", node)
            position = where.column.cast("int")
            if not isinstance(at, Known):
                position = F.when(position < 0, position + F.size(value.column)).otherwise(position)
            elif at.value < 0:
                position = F.size(value.column) + at.value
            return Found(F.get(value.column, position), value.kind.elementType)

        return lifted(one, self.value(node.parts[0], scope), self.value(node.parts[1], scope))

    def _slice(self, node: Node, scope: dict) -> Value:
        given, start, stop, step = node.parts
        bounds = []
        for part in (start, stop, step):
            value = Known(None) if part is None else self.value(part, scope)
            if not isinstance(value, Known) or not (value.value is None or type(value.value) is int):
                raise self.error("the bounds of a slice must be plain numbers", node)
            bounds.append(value.value)

        def one(value: Value) -> Value:
            if isinstance(value, Known) and isinstance(value.value, list):
                return Known(value.value[slice(*bounds)])
            if not _is(value, T.ArrayType):
                raise self.error("only a list can be sliced", node)
            low, high, by = bounds
            if (low, high, by) == (None, None, -1):
                return Found(F.reverse(value.column), value.kind)
            if by not in (None, 1):
                raise self.error("a slice has steps of 1, or turns the whole list round", node)
            size = F.size(value.column)
            first = _bound(0 if low is None else low, size)
            last = size if high is None else _bound(high, size)
            return Found(F.slice(value.column, first + 1, F.greatest(last - first, F.lit(0))), value.kind)

        return lifted(one, self.value(given, scope))

    def _call(self, node: Node, scope: dict) -> Value:
        name, (given, _) = node.parts
        if name == "raise_exception" and len(given) == 1:
            said = self.value(given[0], scope)
            return Found(self.failure(said.value if isinstance(said, Known) else "the template refuses this"), _TEXT)
        raise self.error(f"the function {name!r} is not known", node)

    def _is(self, node: Node, scope: dict) -> Value:
        name = node.parts[1]

        def one(v: Value) -> Value:
            if name in ("defined", "undefined"):
                if _is(v, T.NullType):
                    return Known(name == "undefined")
                if isinstance(v, Found) and not isinstance(v.kind, T.BooleanType):
                    there = v.column.isNotNull()  # what a row leaves out is NULL
                    return Found(there if name == "defined" else ~there, _TRUTH)
                return Known((v != Known(UNDEFINED)) == (name == "defined"))
            if name in ("none", "string", "number", "boolean", "mapping", "iterable", "sequence", "true", "false"):
                if isinstance(v, Known):
                    python = {"none": type(None), "string": str, "number": (int, float), "boolean": bool, "mapping": dict,
                              "iterable": (str, list), "sequence": (str, list)}
                    if name in ("true", "false"):
                        return Known(v.value is (name == "true"))
                    return Known(isinstance(v.value, python[name]))
                if name == "none":
                    return Found(v.column.isNull(), _TRUTH)
                if name in ("true", "false"):
                    is_truth = isinstance(v.kind, T.BooleanType)
                    return Found(v.column.eqNullSafe(name == "true"), _TRUTH) if is_truth else Known(False)
                kinds = {"string": T.StringType, "number": T.NumericType, "boolean": T.BooleanType,
                         "mapping": (T.StructType, T.MapType), "iterable": (T.StringType, T.ArrayType, T.StructType, T.MapType),
                         "sequence": (T.StringType, T.ArrayType)}
                return Found(v.column.isNotNull(), _TRUTH) if isinstance(v.kind, kinds[name]) else Known(False)
            raise self.error(f"the test {name!r} is not known", node)

        return lifted(one, self.value(node.parts[0], scope))

    def _method(self, node: Node, scope: dict) -> Value:
        base, name, (given, named) = node.parts
        arguments = [self.value(a, scope) for a in given]
        if name == "|default" or name == "|d":
            if not arguments:
                arguments = [Known("")]
            flag = named["boolean"] if "boolean" in named else given[1] if len(given) > 1 else Node("constant", node.at, (False,))
            also_false = truth(self.value(flag, scope)) is True
            value = self.value(base, scope)
            as_test = Node("is", node.at, (Node("given", node.at, (value,)), "defined"))
            there = truth(value if also_false else self._is(as_test, scope))
            if isinstance(there, bool):
                return value if there else arguments[0]
            return either(there, value, arguments[0])
        texts = [a.value if isinstance(a, Known) and isinstance(a.value, str) else None for a in arguments]
        if named or None in texts:
            raise self.error(f"{name} takes quoted texts only", node)
        return lifted(lambda v: self._applied(v, name, texts, node), self.value(base, scope))

    def _applied(self, value: Value, name: str, texts: list[str], node: Node) -> Value:
        if name in ("|length", "|count") and not texts:
            if isinstance(value, Known) and isinstance(value.value, (str, list)):
                return Known(len(value.value))
            if _is(value, T.ArrayType):
                return Found(F.size(value.column), _WHOLE)
            if _is(value, T.StringType):
                return Found(F.char_length(value.column), _WHOLE)
        if name in ("|first", "|last") and not texts:
            at = Node("constant", node.at, (0 if name == "|first" else -1,))
            return self._item(Node("item", node.at, (Node("given", node.at, (value,)), at)), {})
        if name == "|join" and len(texts) <= 1 and _is(value, T.ArrayType) and isinstance(value.kind.elementType, T.StringType):
            return Found(F.array_join(value.column, texts[0] if texts else ""), _TEXT)
        if name == "|string" and not texts:
            return self.printed(value, node)
        if name == "get" and texts and not _is(value, T.StringType):
            return self._field(value, texts[0], node)
        text = found(value)
        if text is None or not isinstance(text.kind, T.StringType):
            raise self.error(f"{name} is not known for this value", node)
        plain, column = name.removeprefix("|"), text.column
        made: Column | None = None
        if len(texts) == 0 or (len(texts) == 1 and plain in ("strip", "lstrip", "rstrip", "trim")):
            goes = F.lit(texts[0] if texts else PYTHON_WHITESPACE)
            trims = {"strip": F.btrim, "trim": F.btrim, "lstrip": F.ltrim, "rstrip": F.rtrim}
            cases = {"upper": F.upper, "lower": F.lower}
            if plain in trims:
                made = trims[plain](column, goes)
            elif plain in cases:
                made = cases[plain](column)
            elif plain == "capitalize":
                made = F.concat(F.upper(F.substring(column, 1, 1)), F.lower(F.substring(column, 2, 1 << 30)))
        elif len(texts) == 1 and name == "split" and texts[0]:
            return Found(F.split(column, re.escape(texts[0])), T.ArrayType(_TEXT))
        elif len(texts) == 1 and name in ("startswith", "endswith"):
            return Found((F.startswith if name == "startswith" else F.endswith)(column, F.lit(texts[0])), _TRUTH)
        elif len(texts) == 2 and plain == "replace" and texts[0]:
            made = F.replace(column, F.lit(texts[0]), F.lit(texts[1]))
        if made is None:
            raise self.error(f"{name} is not known", node)
        return Found(made, _TEXT)


def _any(tests: Sequence[bool | Column]) -> Column:
    out = _condition(tests[0])
    for test in tests[1:]:
        out = out | test
    return out


def _bound(at: int, size: Column) -> Column:
    return F.least(F.lit(at), size) if at >= 0 else F.greatest(size + at, F.lit(0))


def _assigns(node: Node) -> bool:
    """Whether a branch sets variables that live on behind it."""
    if node.kind == "set":
        return True
    if node.kind == "if":
        return any(_assigns(n) for part in node.parts[1:] for n in part)
    return node.kind == "block" and any(_assigns(n) for n in node.parts[0])


def _states(node: Node) -> list[str]:
    """The parts of namespaces that a loop's rounds set, without those it makes itself."""
    names: dict[str, None] = {}
    own: set[str] = set()

    def visit(nodes: Sequence[Node]) -> None:
        for n in nodes:
            if n.kind == "set":
                if n.parts[1] is not None and n.parts[0] not in own:
                    names[f"{n.parts[0]}.{n.parts[1]}"] = None
                elif n.parts[2].kind == "call" and n.parts[2].parts[0] == "namespace":
                    own.add(n.parts[0])
            elif n.kind == "if":
                visit(n.parts[1])
                visit(n.parts[2])
            elif n.kind == "block":
                visit(n.parts[0])
            elif n.kind == "for":
                visit(n.parts[3])

    visit(node.parts[3])
    return list(names)


# --- templates ---------------------------------------------------------------------


@dataclass(frozen=True)
class ModelTemplate:
    """A template in its own words; ``variables`` are what it may ask for beside the messages."""

    name: str
    source: str
    tokens: Mapping[str, str]
    variables: Mapping[str, Any]

    @property
    def special_tokens(self) -> list[str]:
        """The distinct marker strings, first occurrence first."""
        return list(dict.fromkeys(self.tokens.values()))

    def render(
        self, messages: Column, kind: T.ArrayType, asks: Column | bool, failure: Callable[[str], Column] | None = None
    ) -> Column:
        """The text of a conversation, NULL where a value it needs is NULL.

        ``asks`` is what the template knows as ``add_generation_prompt``. Where the template raises an
        exception, ``failure`` makes the column for its message: NULL if none is given.
        """
        syntax = Syntax(self.source)
        compiler = Compiler(syntax, failure or (lambda _: F.lit(None).cast("string")))
        known = {name: Known(value) for name, value in {**{f"{k}_token": v for k, v in self.tokens.items()}, **self.variables}.items()}
        wish = Known(asks) if isinstance(asks, bool) else Found(asks, _TRUTH)

        def whole(conversation: Column) -> Column:
            scope = {**known, "messages": Found(conversation, kind), "add_generation_prompt": wish}
            return compiler.body(syntax.parse(), scope, [], compiler.finished)

        return _let(Found(messages, kind), whole)


def model_template(source: str, tokens: Mapping[str, str] | None = None, name: str = "own", **variables: Any) -> ModelTemplate:
    """A chat template from its text, as a model's tokenizer settings hold it.

    ``tokens`` are the texts of ``bos``, ``eos``, ``pad`` and so on, which the template knows as
    ``bos_token`` ...; ``variables`` are further options of it, such as ``enable_thinking=False``. What a
    template asks for and nobody gives is undefined. Its syntax is checked at once; whether all it does is
    known here shows when it meets the fields of the messages.
    """
    Syntax(source).parse()
    return ModelTemplate(name, source, dict(tokens or {}), variables)
