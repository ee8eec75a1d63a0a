"""Chat formatting with a template compiler.

A template is read into a syntax tree, constant parts are folded, and the tree becomes nested Python closures
that render a conversation and note the spans between ``{% generation %}`` and ``{% endgeneration %}``.  The
language is sandboxed: values are strings, numbers, booleans, none, and the fields of turns; there are no
calls, no attributes of Python objects and no loops but one over ``turns``, and only the registered filters.
Whatever else a template holds (a second loop, a tag left open, words after ``else``) is refused.

    {{ expression }}   {% if e %} {% elif e %} {% else %} {% endif %}   {% for x in turns %} {% endfor %}
    {% set name = e %}   {% generation %} {% endgeneration %}   {# comment #}
    expressions: 'text' 12 true false none  name  name.field  loop.first loop.last loop.index0
                 e | filter   e ~ e   e == e   e != e   not e   e and e   e or e   e if e else e   (e)

Rows of one conversation are ordered by turn, then role, then text (nulls first); null roles and texts are
empty, rows with a null conversation id form one conversation, and repeated rows are separate turns.  A
conversation is rendered turn by turn, texts of any length whole, and only one is held at a time.  An empty
table gives an empty result.  Extra columns, also those whose names differ by case only, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import pick

#: Marks turns; the filters keep what a text holds of the marks from being read as one.
TEMPLATE = (
    "{% for turn in turns %}{{ '### ' ~ (turn.role | escape_name) ~ ': ' }}"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}"
    "{{ '</turn>' ~ '\\n' }}{% endfor %}"
)
_MARKS = re.compile(r"\\|###|</turn>")
_READ = re.compile(r"\\(.)|(</turn>\n)", re.DOTALL)


def escape(text: str) -> str:
    """Put a backslash before backslashes and the marks of a turn; ``unescape`` undoes it."""
    return _MARKS.sub(lambda m: r"\#\#\#" if m[0] == "###" else "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda x: escape(_text(x)),
    "escape_name": lambda x: escape(_text(x)).replace(":", "\\:"),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(_text(x)),
}


class TemplateError(ValueError):
    pass


def _text(x: Any) -> str:
    return "" if x is None else "true" if x is True else "false" if x is False else str(x)


# The syntax tree: expressions ...


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Attr:
    of: Any
    name: str


@dataclass
class Filter:
    of: Any
    name: str


@dataclass
class Op:
    op: str
    args: list


# ... and statements.


@dataclass
class Emit:
    of: Any


@dataclass
class Assign:
    name: str
    of: Any


@dataclass
class If:
    cases: list  # (condition, body) pairs; the last may have no condition


@dataclass
class For:
    name: str
    body: list


@dataclass
class Generation:
    body: list


_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|~().]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:].strip()!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, text: str) -> bool:
        kind, value = self.peek()
        if value == text and kind in ("op", "name"):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise TemplateError(f"expected {text!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise TemplateError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def whole(self) -> Any:
        e = self.choice()
        if self.peek()[0] != "end":
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return e

    def choice(self) -> Any:
        e = self.either()
        if self.take("if"):
            condition = self.either()
            self.need("else")
            return Op("choose", [condition, e, self.choice()])
        return e

    def either(self) -> Any:
        e = self.both()
        while self.take("or"):
            e = Op("or", [e, self.both()])
        return e

    def both(self) -> Any:
        e = self.negated()
        while self.take("and"):
            e = Op("and", [e, self.negated()])
        return e

    def negated(self) -> Any:
        return Op("not", [self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> Any:
        e = self.joined()
        for op in ("==", "!="):
            if self.take(op):
                return Op(op, [e, self.joined()])
        return e

    def joined(self) -> Any:
        parts = [self.filtered()]
        while self.take("~"):
            parts.append(self.filtered())
        return parts[0] if len(parts) == 1 else Op("~", parts)

    def filtered(self) -> Any:
        e = self.atom()
        while True:
            if self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name!r}")
                e = Filter(e, name)
            elif self.take("."):
                name = self.name()
                if name.startswith("_"):
                    raise TemplateError(f"no field {name!r}")
                e = Attr(e, name)
            else:
                return e

    def atom(self) -> Any:
        kind, value = self.peek()
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "num":
            return Const(int(value))
        if kind == "name":
            words = {"true": True, "false": False, "none": None}
            return Const(words[value]) if value in words else Name(value)
        if value == "(":
            e = self.choice()
            self.need(")")
            return e
        raise TemplateError(f"unexpected {value!r}" if value else "an expression ends too early")


def parse(source: str) -> list:
    """The statements of a template."""
    pieces: list[tuple[str, str]] = []
    at = 0

    def plain(text: str) -> None:
        opened = re.search(r"\{[{%#]", text)
        if opened:
            raise TemplateError(f"{opened[0]!r} is not closed")
        if text:
            pieces.append(("text", text))

    for m in _PIECE.finditer(source):
        plain(source[at : m.start()])
        if m[1] is not None:
            pieces.append(("emit", m[1]))
        elif m[2] is not None:
            pieces.append(("do", m[2].strip().strip("-").strip()))
        at = m.end()
    plain(source[at:])
    body, _ = _body(pieces, 0, ())
    if _loops(body) > 1:
        raise TemplateError("turns are read once, so only one loop may run")
    return body


def _loops(body: list) -> int:
    """The most loops that one rendering can run through."""
    n = 0
    for node in body:
        if isinstance(node, If):
            n += max(_loops(inner) for _, inner in node.cases)
        elif isinstance(node, For):
            n += 1 + _loops(node.body)
        elif isinstance(node, Generation):
            n += _loops(node.body)
    return n


def _body(pieces: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[list, int]:
    """Statements up to one of ``ends``, and where that stands."""
    out: list = []
    while at < len(pieces):
        kind, value = pieces[at]
        word = value.split(None, 1)[0] if kind == "do" and value else ""
        if kind == "do" and word in ends:
            if word != "elif" and value != word:
                raise TemplateError(f"nothing may follow {word!r}: {value!r}")
            return out, at
        at += 1
        if kind == "text":
            out.append(Emit(Const(value)))
        elif kind == "emit":
            out.append(Emit(_Expression(value).whole()))
        elif word == "if":
            cases, condition = [], _Expression(value[2:]).whole()
            while True:
                inner, at = _body(pieces, at, ("endif",) if condition is None else ("elif", "else", "endif"))
                cases.append((condition, inner))
                end = pieces[at][1]
                at += 1
                if end == "endif":
                    break
                condition = _Expression(end[4:]).whole() if end.startswith("elif") else None
            out.append(If(cases))
        elif word == "for":
            m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+turns", value)
            if not m:
                raise TemplateError(f"loops run over turns only: {value!r}")
            inner, at = _body(pieces, at, ("endfor",))
            at += 1
            out.append(For(m[1], inner))
        elif word == "generation":
            inner, at = _body(pieces, at, ("endgeneration",))
            at += 1
            out.append(Generation(inner))
        elif word == "set":
            m = re.fullmatch(r"set\s+([A-Za-z_]\w*)\s*=(.*)", value, re.DOTALL)
            if not m:
                raise TemplateError(f"cannot read {value!r}")
            out.append(Assign(m[1], _Expression(m[2]).whole()))
        else:
            raise TemplateError(f"unknown statement {value!r}")
    if ends:
        raise TemplateError(f"missing {ends[-1]!r}")
    return out, at


def fold(node: Any) -> Any:
    """An expression with its constant parts computed, and neighbouring constants of a join merged."""
    if isinstance(node, Attr):
        return Attr(fold(node.of), node.name)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) else Filter(of, node.name)
    if not isinstance(node, Op):
        return node
    args = [fold(a) for a in node.args]
    if node.op == "~":
        flat = list(chain.from_iterable(a.args if isinstance(a, Op) and a.op == "~" else [a] for a in args))
        merged: list = []
        for a in flat:
            if isinstance(a, Const):
                a = Const(_text(a.value))
                if merged and isinstance(merged[-1], Const):
                    merged[-1] = Const(merged[-1].value + a.value)
                    continue
            merged.append(a)
        return merged[0] if len(merged) == 1 and isinstance(merged[0], Const) else Op("~", merged)
    if node.op == "choose" and isinstance(args[0], Const):
        return args[1] if args[0].value else args[2]
    if all(isinstance(a, Const) for a in args):
        return Const(_expression(Op(node.op, args))({}))
    return Op(node.op, args)


def fold_body(body: list) -> list:
    """Statements with folded expressions, dead branches gone and neighbouring constant output merged."""
    out: list = []
    for node in body:
        if isinstance(node, Emit):
            of = fold(node.of)
            if isinstance(of, Const):
                text = _text(of.value)
                if not text:
                    continue
                if out and isinstance(out[-1], Emit) and isinstance(out[-1].of, Const):
                    out[-1] = Emit(Const(out[-1].of.value + text))
                    continue
                of = Const(text)
            out.append(Emit(of))
        elif isinstance(node, Assign):
            out.append(Assign(node.name, fold(node.of)))
        elif isinstance(node, For):
            out.append(For(node.name, fold_body(node.body)))
        elif isinstance(node, Generation):
            out.append(Generation(fold_body(node.body)))
        else:
            cases = []
            for condition, inner in node.cases:
                condition = None if condition is None else fold(condition)
                if isinstance(condition, Const):
                    if not condition.value:
                        continue
                    condition = None
                cases.append((condition, fold_body(inner)))
                if condition is None:
                    break
            if cases and cases[0][0] is None:  # what is left stands here, and may join its neighbours
                out = fold_body([*out, *cases[0][1]])
            elif cases:
                out.append(If(cases))
    return out


@dataclass
class Sink:
    """What has been rendered, its length in code points, and the marked spans."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _expression(node: Any) -> Callable[[dict], Any]:
    """A closure from the variables to the expression's value."""
    if isinstance(node, Const):
        value = node.value
        return lambda v: value
    if isinstance(node, Name):
        name = node.name
        return lambda v: v.get(name)
    if isinstance(node, Attr):
        of, name = _expression(node.of), node.name

        def attr(v):
            held = of(v)
            return held.get(name) if isinstance(held, dict) else None

        return attr
    if isinstance(node, Filter):
        of, run = _expression(node.of), FILTERS[node.name]
        return lambda v: run(of(v))
    args = [_expression(a) for a in node.args]
    if node.op == "~":
        return lambda v: "".join([_text(a(v)) for a in args])
    if node.op == "not":
        (a,) = args
        return lambda v: not a(v)
    if node.op == "choose":
        c, a, b = args
        return lambda v: a(v) if c(v) else b(v)
    a, b = args
    return {
        "==": lambda v: a(v) == b(v),
        "!=": lambda v: a(v) != b(v),
        "and": lambda v: a(v) and b(v),
        "or": lambda v: a(v) or b(v),
    }[node.op]


def _statements(body: list) -> Callable[[dict, Sink], None]:
    steps = [_statement(n) for n in body]
    if len(steps) == 1:
        return steps[0]

    def run(v: dict, out: Sink) -> None:
        for step in steps:
            step(v, out)

    return run


def _statement(node: Any) -> Callable[[dict, Sink], None]:
    if isinstance(node, Emit):
        if isinstance(node.of, Const):
            text = node.of.value
            return lambda v, out: out.add(text)
        value = _expression(node.of)
        return lambda v, out: out.add(_text(value(v)))
    if isinstance(node, Assign):
        name, value = node.name, _expression(node.of)

        def assign(v, out):
            v[name] = value(v)

        return assign
    if isinstance(node, If):
        cases = [(None if c is None else _expression(c), _statements(b)) for c, b in node.cases]

        def branch(v, out):
            for condition, inner in cases:
                if condition is None or condition(v):
                    inner(v, out)
                    return

        return branch
    if isinstance(node, For):
        name, inner = node.name, _statements(node.body)

        def loop(v, out):
            i, held = 0, None
            for turn in chain(v["turns"], [None]):  # one turn ahead, to know the last
                if held is not None:
                    v[name], v["loop"] = held, {"index0": i, "first": i == 0, "last": turn is None}
                    inner(v, out)
                    i += 1
                held = turn

        return loop
    inner = _statements(node.body)

    def generation(v, out):
        start = out.size
        inner(v, out)
        out.spans.append((start, out.size))

    return generation


def compile_template(source: str = TEMPLATE) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function from turns (dictionaries with role and text) to the rendered text and its marked spans."""
    run = _statements(fold_body(parse(source)))

    def render(turns, **variables):
        out = Sink()
        run({**variables, "turns": iter(turns)}, out)
        return "".join(out.parts), out.spans

    return render


def read_back(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a text that ``TEMPLATE`` rendered."""
    turns, at = [], 0
    while at < len(text):
        if not text.startswith("### ", at):
            raise ValueError(f"no turn starts at {at}")
        end = at + 4
        while text[end] != ":":
            end += 2 if text[end] == "\\" else 1
        role, body = text[at + 4 : end], end + 2
        for m in _READ.finditer(text, body):
            if m[2]:
                turns.append((unescape(role), unescape(text[body : m.start()])))
                at = m.end()
                break
        else:
            raise ValueError("a turn has no end")
    return turns


def _format(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        kind = None

        def rows():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        done: list[tuple] = []
        size = 0
        stream = rows()
        row = next(stream, None)
        while row is not None:
            conv = row[0]

            def turns():
                nonlocal row
                while row is not None and row[0] == conv:  # noqa: B023
                    yield {"turn": row[1], "role": row[2] or "", "text": row[3] or ""}
                    row = next(stream, None)

            own = turns()
            text, spans = render(own)
            for _ in own:  # a template that doesn't loop leaves turns unread
                pass
            done.append((conv, text, [{"start": a, "end": b} for a, b in spans]))
            size += len(text)
            if size > 1 << 22:
                yield _batch(done, kind)
                done, size = [], 0
        if done:
            yield _batch(done, kind)

    return run


def _batch(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in done], kind), pa.array([r[1] for r in done], pa.string()), pa.array([r[2] for r in done], spans)], ["conv_id", "formatted", "spans"])


def format_conversations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", *, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, formatted, spans) for every conversation; spans are the generated parts, in code points."""
    compile_template(template)  # errors show here, not in a task
    rows = pick(df, conv_col, turn_col, role_col, text_col).toDF("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format(template), f"conv_id {kind}, formatted string, spans array<struct<start:bigint,end:bigint>>")


def with_mark_conversation(df: DataFrame) -> DataFrame:
    """``df`` and conversation -7, whose two turns hold the marks themselves."""
    said = "\\### Assistant: </turn> ok"
    extra = df.sparkSession.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = pick(df, "conv_id", "turn", "role", "text")
    return rows.unionByName(extra.select(*(F.col(f.name).cast(f.dataType) for f in rows.schema)))
