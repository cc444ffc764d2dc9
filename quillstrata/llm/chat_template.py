r"""Chat formatting by a small template compiler.

The template language has literal text, {{ expression }}, {% for x in expression %}, {% if %}/{% elif %}/{% else %} and
{% generation %} ... {% endgeneration %}, whose output is marked as the part to learn.  Expressions have names, strings,
integers, true/false/none, .field and [index] lookup, ==, !=, <, >, +, and, or, not, and the filters below.  There is no call, no
attribute of a Python object and no import: .field reads a mapping's entry, so a template can't reach anything but its input.
The source is parsed to a syntax tree, constants are folded and neighbouring literals joined, and each node becomes a
Python closure that appends to an output list.

Control strings.  Markers of the standard template begin with "<".  The filter `escape` writes "\" as "\\", "<" as "\l" and ">" as "\g",
so that escaped text holds no marker at all; `unescape` undoes it exactly.

Defined results: turns are ordered by turn, role and text, so ties and repeated rows have one order and all are kept; null role
or text is empty; a null conv_id is one conversation; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = (
    "{% for m in messages %}<turn {{ m.role | escape }}>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)


class TemplateError(ValueError):
    pass


_MARKS = {"l": "<", "g": ">"}


def escape(text: Any) -> str:
    return str(text).replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _MARKS.get(m[1], m[1]), text, flags=re.S)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": escape, "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}

# --- syntax tree -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Lookup:
    of: Any
    key: Any


@dataclass(frozen=True)
class Unary:
    value: Any


@dataclass(frozen=True)
class Binary:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class Filtered:
    value: Any
    name: str


@dataclass(frozen=True)
class Output:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # (condition, body) pairs; the last condition may be Const(True)


@dataclass(frozen=True)
class Generation:
    body: tuple


# --- parser ------------------------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_WORD = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[<>+.|()\[\]]))""")
_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over one expression's words."""

    def __init__(self, source: str) -> None:
        self.words: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _WORD.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def take(self, *ops: str) -> str | None:
        if self.at < len(self.words) and self.words[self.at][0] in ("op", "name") and self.words[self.at][1] in ops:
            self.at += 1
            return self.words[self.at - 1][1]
        return None

    def need(self, kind: str) -> str:
        if self.at >= len(self.words) or self.words[self.at][0] != kind:
            raise TemplateError(f"{kind} expected")
        self.at += 1
        return self.words[self.at - 1][1]

    def whole(self) -> Any:
        node = self.either()
        if self.at != len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return node

    def either(self) -> Any:
        node = self.both()
        while self.take("or"):
            node = Binary("or", node, self.both())
        return node

    def both(self) -> Any:
        node = self.negated()
        while self.take("and"):
            node = Binary("and", node, self.negated())
        return node

    def negated(self) -> Any:
        return Unary(self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        node = self.added()
        while op := self.take("==", "!=", "<", ">"):
            node = Binary(op, node, self.added())
        return node

    def added(self) -> Any:
        node = self.piped()
        while self.take("+"):
            node = Binary("+", node, self.piped())
        return node

    def piped(self) -> Any:
        node = self.looked_up()
        while self.take("|"):
            name = self.need("name")
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Filtered(node, name)
        return node

    def looked_up(self) -> Any:
        node = self.atom()
        while op := self.take(".", "["):
            if op == ".":
                node = Lookup(node, Const(self.need("name")))
            else:
                node = Lookup(node, self.either())
                if not self.take("]"):
                    raise TemplateError("] expected")
        return node

    def atom(self) -> Any:
        if self.take("("):
            node = self.either()
            if not self.take(")"):
                raise TemplateError(") expected")
            return node
        if self.at >= len(self.words):
            raise TemplateError("expression expected")
        kind, word = self.words[self.at]
        self.at += 1
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(word))
        if kind == "name":
            return Const({"true": True, "false": False, "none": None}[word]) if word in ("true", "false", "none") else Name(word)
        raise TemplateError(f"unexpected {word!r}")


def parse(source: str) -> tuple:
    """The template's syntax tree: a tuple of nodes."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at : m.start()]))
        parts.append(("out", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    body, rest, end = _body(parts, 0, ())
    if end:
        raise TemplateError(f"unexpected {end!r}")
    assert rest == len(parts)
    return body


def _body(parts: list[tuple[str, str]], at: int, until: tuple[str, ...]) -> tuple[tuple, int, str]:
    nodes: list[Any] = []
    while at < len(parts):
        kind, value = parts[at]
        at += 1
        word = value.split(None, 1)[0] if kind == "tag" and value else ""
        if kind == "text":
            nodes.append(Output(Const(value)))
        elif kind == "out":
            nodes.append(Output(_Expression(value).whole()))
        elif word in until:
            return tuple(nodes), at, value
        elif word == "for":
            m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", value, re.S)
            if not m:
                raise TemplateError(f"can't read {value!r}")
            body, at, _ = _closed(parts, at, ("endfor",))
            nodes.append(For(m[1], _Expression(m[2]).whole(), body))
        elif word == "generation":
            body, at, _ = _closed(parts, at, ("endgeneration",))
            nodes.append(Generation(body))
        elif word == "if":
            arms, condition = [], _Expression(value[2:]).whole()
            while True:
                body, at, end = _closed(parts, at, ("elif", "else", "endif"))
                arms.append((condition, body))
                if end == "endif":
                    break
                condition = Const(True) if end == "else" else _Expression(end[4:]).whole()
            nodes.append(If(tuple(arms)))
        else:
            raise TemplateError(f"unexpected {value!r}")
    return tuple(nodes), at, ""


def _closed(parts: list[tuple[str, str]], at: int, until: tuple[str, ...]) -> tuple[tuple, int, str]:
    body, at, end = _body(parts, at, until)
    if not end:
        raise TemplateError(f"{until[-1]} is missing")
    return body, at, end


# --- constants ---------------------------------------------------------------------------------------------------

_BINARY: dict[str, Callable[[Any, Any], Any]] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "+": lambda a, b: a + b, "and": lambda a, b: a and b, "or": lambda a, b: a or b}


def fold(node: Any) -> Any:
    """The same tree with constant expressions evaluated, dead branches gone and neighbouring literals joined."""
    if isinstance(node, tuple):
        out: list[Any] = []
        for x in map(fold, node):
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Output) and isinstance(y.value, Const):
                    text = "" if y.value.value is None else str(y.value.value)
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        text = out.pop().value.value + text
                    y = Output(Const(text))
                out.append(y)
        return tuple(out)
    if isinstance(node, Binary):
        left, right = fold(node.left), fold(node.right)
        return Const(_BINARY[node.op](left.value, right.value)) if isinstance(left, Const) and isinstance(right, Const) else Binary(node.op, left, right)
    if isinstance(node, Unary):
        value = fold(node.value)
        return Const(not value.value) if isinstance(value, Const) else Unary(value)
    if isinstance(node, Filtered):
        value = fold(node.value)
        return Const(FILTERS[node.name](value.value)) if isinstance(value, Const) else Filtered(value, node.name)
    if isinstance(node, Lookup):
        return Lookup(fold(node.of), fold(node.key))
    if isinstance(node, Output):
        return Output(fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms: list[tuple[Any, tuple]] = []
        for condition, body in node.arms:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            arms.append((condition, fold(body)))
            if isinstance(condition, Const):
                break
        return arms[0][1] if arms and isinstance(arms[0][0], Const) else If(tuple(arms)) if arms else ()
    return node


# --- closures ----------------------------------------------------------------------------------------------------


@dataclass
class _Frame:
    values: dict[str, Any]
    out: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)


def _value(node: Any) -> Callable[[_Frame], Any]:
    if isinstance(node, Const):
        return lambda f, v=node.value: v
    if isinstance(node, Name):

        def name(f: _Frame, n: str = node.name) -> Any:
            if n not in f.values:
                raise TemplateError(f"{n!r} isn't defined")
            return f.values[n]

        return name
    if isinstance(node, Lookup):
        of, key = _value(node.of), _value(node.key)

        def lookup(f: _Frame) -> Any:
            held, at = of(f), key(f)
            if isinstance(held, dict):
                return held.get(at)
            if isinstance(held, (list, tuple)) and isinstance(at, int):
                return held[at] if at < len(held) else None
            raise TemplateError("only mappings and lists have entries")

        return lookup
    if isinstance(node, Unary):
        value = _value(node.value)
        return lambda f: not value(f)
    if isinstance(node, Filtered):
        value, through = _value(node.value), FILTERS[node.name]
        return lambda f: through(value(f))
    left, right = _value(node.left), _value(node.right)
    if node.op == "and":
        return lambda f: left(f) and right(f)
    if node.op == "or":
        return lambda f: left(f) or right(f)
    return lambda f, op=_BINARY[node.op]: op(left(f), right(f))


def _block(nodes: tuple) -> Callable[[_Frame], None]:
    steps = [_step(x) for x in nodes]

    def run(f: _Frame) -> None:
        for step in steps:
            step(f)

    return steps[0] if len(steps) == 1 else run


def _step(node: Any) -> Callable[[_Frame], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            return lambda f, text=node.value.value: f.put(text)
        value = _value(node.value)

        def output(f: _Frame) -> None:
            found = value(f)
            f.put("" if found is None else str(found))

        return output
    if isinstance(node, For):
        over, body = _value(node.over), _block(node.body)

        def loop(f: _Frame, name: str = node.name) -> None:
            outer = f.values
            for f.values in ({**outer, name: x} for x in over(f)):
                body(f)
            f.values = outer

        return loop
    if isinstance(node, Generation):
        body = _block(node.body)

        def generation(f: _Frame) -> None:
            start = f.length
            body(f)
            f.spans.append((start, f.length))

        return generation
    arms = [(_value(c), _block(b)) for c, b in node.arms]

    def branch(f: _Frame) -> None:
        for condition, body in arms:
            if condition(f):
                body(f)
                return

    return branch


class Template:
    """render(**values) -> (text, spans of generated text)."""

    def __init__(self, source: str) -> None:
        self.tree = fold(parse(source))
        self._run = _block(self.tree)

    def render(self, **values: Any) -> tuple[str, list[tuple[int, int]]]:
        frame = _Frame(values)
        self._run(frame)
        return "".join(frame.out), frame.spans


_TURN = re.compile(r"<turn ([^<>]*)>([^<>]*)</turn>\n")


def read_back(text: str) -> list[tuple[str, str]]:
    """(role, text) of a conversation that TEMPLATE formatted."""
    turns, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise TemplateError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


FORMATTED = "n_turns bigint, formatted string, loss array<struct<start:int,stop:int>>"


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, formatted, loss (spans of the formatted text, in characters), from rows conv_id, turn, role, text.

    A conversation is one string in the end, so its turns meet in one row; nothing else does."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = Template(template)
        for batch in batches:
            for at in range(batch.num_rows):
                turns = batch.column("turns")[at].as_py()
                text, spans = compiled.render(messages=turns)
                yield pa.record_batch([batch.column("conv_id").slice(at, 1), pa.array([len(turns)], pa.int64()), pa.array([text]), pa.array([[{"start": a, "stop": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))], ["conv_id", "n_turns", "formatted", "loss"])

    kind = rows.schema["conv_id"].dataType.simpleString()
    return grouped.mapInArrow(run, f"conv_id {kind}, {FORMATTED}")


def digests(formatted: DataFrame) -> DataFrame:
    """The columns of query op6, read back from the formatted texts and their loss spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                said = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            n, turns_hash, loss_n, loss_hash, chars = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.record_batch([batch.column("conv_id"), pa.array(n, pa.int64()), pa.array(turns_hash, pa.string()), pa.array(loss_n, pa.int64()), pa.array(loss_hash, pa.string()), pa.array(chars, pa.int64())], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


#: Conversation -7 of query op6.
SAYS = r"\### Assistant: </turn> ok"


def report(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame([(-7, 0, "user", SAYS), (-7, 1, "assistant", SAYS)], "conv_id bigint, turn bigint, role string, text string")
    return digests(format_conversations(rows.unionByName(odd)))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '>', '\g')) + length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '>', '\g')) + length('<turn ></turn>') + 1 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
