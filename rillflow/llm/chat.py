"""Chat formatting: a sandboxed template language compiled to Python closures.

Language: text, `{{ expression }}`, `{% for x in y %}..{% endfor %}`,
`{% if e %}..{% elif e %}..{% else %}..{% endif %}` and
`{% generation %}..{% endgeneration %}`, whose output is under the loss mask.
Expressions: string literals, names, `a.b`, `==`, `!=`, `~` (join), `and`,
`or`, `not`, parentheses and the filter `| escape`.  There are no calls,
imports or attribute access on Python objects: names resolve to strings, and
to maps and sequences of strings given by the caller.

Templates render lazily: a `for` loop pulls its items from an iterator, so a
conversation of any length needs memory for one turn only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# The control strings of the default template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[OUT]")
DEFAULT_TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}{{ '<s>' ~ '[INST]' }}{{ m.text | escape }}[/INST]"
    "{% elif m.role == 'assistant' %}[OUT]{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<s>[SYS]{{ m.text | escape }}[/SYS]"
    "{% else %}<s>[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}</s>"
    "{% endif %}{% endfor %}"
)
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_TAILS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_TAILS})")
_MARKER = re.compile("|".join(re.escape(c) for c in CONTROL))

Piece = tuple[str, bool]
Closure = Callable[[dict, bool], Iterator[Piece]]


def escape(text: str) -> str:
    """text without control strings: each gets one more backslash behind its first character."""
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


class TemplateError(ValueError):
    pass


_LEX = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([A-Za-z_]\w*)|(==|!=|[.~|()]))")


class _Expression:
    """Recursive descent over one expression; nodes are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            at = m.end()
            text = m[1] if m[1] is not None else m[2]
            self.items.append(("str", re.sub(r"\\(.)", lambda x: {"n": "\n", "t": "\t"}.get(x[1], x[1]), text)) if text is not None else ("name", m[3]) if m[3] else ("op", m[4]))
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.items) and self.items[self.at][0] != "str" and self.items[self.at][1] in values

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.items):
            raise TemplateError("expression ends early")
        self.at += 1
        return self.items[self.at - 1]

    def whole(self) -> tuple:
        node = self.any_of()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.items[self.at][1]!r}")
        return node

    def any_of(self) -> tuple:
        node = self.all_of()
        while self.peek("or"):
            self.take()
            node = ("or", node, self.all_of())
        return node

    def all_of(self) -> tuple:
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return ("not", self.negated())
        node = self.joined()
        if self.peek("==", "!="):
            op = self.take()[1]
            node = (op, node, self.joined())
        return node

    def joined(self) -> tuple:
        node = self.filtered()
        while self.peek("~"):
            self.take()
            node = ("~", node, self.filtered())
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.peek("|"):
            self.take()
            name = self.take()
            if name != ("name", "escape"):
                raise TemplateError(f"no filter {name[1]!r}")
            node = ("escape", node)
        return node

    def atom(self) -> tuple:
        kind, value = self.take()
        if kind == "str":
            return ("const", value)
        if (kind, value) == ("op", "("):
            node = self.any_of()
            if self.take() != ("op", ")"):
                raise TemplateError("missing )")
            return node
        if kind != "name" or value in ("and", "or", "not"):
            raise TemplateError(f"unexpected {value!r}")
        node = ("name", value)
        while self.peek("."):
            self.take()
            kind, key = self.take()
            if kind != "name" or key.startswith("_"):
                raise TemplateError(f"no field {key!r}")
            node = ("field", node, key)
        return node


def parse(template: str) -> tuple:
    """The syntax tree of a template: ("block", nodes)."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    stack: list[tuple[str, Any, list]] = [("block", None, [])]

    def close(kind: str) -> tuple:
        if stack[-1][0] != kind or len(stack) == 1:
            raise TemplateError(f"nothing to end for {kind}")
        return stack.pop()

    for part in parts:
        body = stack[-1][2]
        if part.startswith("{{"):
            body.append(("out", _Expression(part[2:-2]).whole()))
        elif part.startswith("{%"):
            word, _, rest = part[2:-2].strip().partition(" ")
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                if not m:
                    raise TemplateError(f"bad loop {rest!r}")
                stack.append(("for", (m[1], _Expression(m[2]).whole()), []))
            elif word == "if":
                stack.append(("if", [(_Expression(rest).whole(), [])], []))
                stack[-1] = ("if", stack[-1][1], stack[-1][1][0][1])
            elif word in ("elif", "else") and stack[-1][0] == "if":
                arms = stack[-1][1]
                if arms[-1][0] == ("const", "1") and len(arms) > 1 and word == "else":
                    raise TemplateError("two else parts")
                arms.append((_Expression(rest).whole() if word == "elif" else ("const", "1"), []))
                stack[-1] = ("if", arms, arms[-1][1])
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word == "endfor":
                _, (name, of), inner = close("for")
                stack[-1][2].append(("for", name, of, ("block", inner)))
            elif word == "endif":
                _, arms, _ = close("if")
                stack[-1][2].append(("if", [(e, ("block", x)) for e, x in arms]))
            elif word == "endgeneration":
                _, _, inner = close("generation")
                stack[-1][2].append(("generation", ("block", inner)))
            else:
                raise TemplateError(f"no tag {word!r}")
        elif part:
            body.append(("out", ("const", part)))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return ("block", stack[0][2])


def fold(node: tuple) -> tuple:
    """The same tree with constant expressions, branches and neighbouring texts put together."""
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "field":
        return ("field", fold(node[1]), node[2])
    if kind in ("==", "!=", "~", "and", "or", "not", "escape"):
        args = [fold(x) for x in node[1:]]
        new = (kind, *args)
        if all(x[0] == "const" for x in args):
            value = _value(new)({})
            return ("const", value if isinstance(value, str) else "1" if value else "")
        return new
    if kind == "out":
        return ("out", fold(node[1]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "if":
        arms = []
        for test, body in node[1]:
            test = fold(test)
            if test == ("const", ""):
                continue
            arms.append((test, fold(body)))
            if test[0] == "const":
                break
        if not arms:
            return ("block", [])
        return arms[0][1] if arms[0][0][0] == "const" else ("if", arms)
    flat: list[tuple] = []
    for x in map(fold, node[1]):
        for y in x[1] if x[0] == "block" else [x]:
            if y == ("out", ("const", "")):
                continue
            if flat and y[0] == flat[-1][0] == "out" and y[1][0] == flat[-1][1][0] == "const":
                flat[-1] = ("out", ("const", flat[-1][1][1] + y[1][1]))
            else:
                flat.append(y)
    return ("block", flat)


def _value(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "const":
        return lambda scope, v=node[1]: v
    if kind == "name":
        return lambda scope, k=node[1]: scope.get(k, "")
    if kind == "field":
        of, key = _value(node[1]), node[2]

        def look_up(scope: dict) -> Any:
            found = of(scope)
            return found.get(key, "") if isinstance(found, dict) else ""

        return look_up
    args = [_value(x) for x in node[1:]]
    one, two = args[0], args[-1]
    return {
        "==": lambda s: one(s) == two(s),
        "!=": lambda s: one(s) != two(s),
        "~": lambda s: f"{one(s)}{two(s)}",
        "and": lambda s: one(s) and two(s),
        "or": lambda s: one(s) or two(s),
        "not": lambda s: not one(s),
        "escape": lambda s: escape(str(one(s))),
    }[kind]


def _closure(node: tuple) -> Closure:
    kind = node[0]
    if kind == "out":
        value = _value(node[1])

        def out(scope: dict, masked: bool) -> Iterator[Piece]:
            if text := str(value(scope)):
                yield text, masked

        return out
    if kind == "generation":
        inner = _closure(node[1])
        return lambda scope, masked: inner(scope, True)
    if kind == "for":
        name, of, inner = node[1], _value(node[2]), _closure(node[3])

        def loop(scope: dict, masked: bool) -> Iterator[Piece]:
            for item in of(scope):
                yield from inner(scope | {name: item}, masked)

        return loop
    if kind == "if":
        arms = [(_value(e), _closure(x)) for e, x in node[1]]

        def choose(scope: dict, masked: bool) -> Iterator[Piece]:
            for test, inner in arms:
                if test(scope):
                    yield from inner(scope, masked)
                    return

        return choose
    parts = [_closure(x) for x in node[1]]

    def block(scope: dict, masked: bool) -> Iterator[Piece]:
        for part in parts:
            yield from part(scope, masked)

    return block


def compile_template(template: str = DEFAULT_TEMPLATE) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages ({role, text}) to pieces of output, each with its loss mask."""
    run = _closure(fold(parse(template)))
    return lambda messages: run({"messages": messages}, False)


class Reader:
    """Reads formatted output back, piece by piece: turns, loss text and lengths.

    It sees nothing but the output and its mask.  Text up to the next control
    string is kept; the rest is only hashed and counted.
    """

    def __init__(self) -> None:
        self.buffer, self.head, self.role = "", "", ""
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, masked: bool) -> None:
        self.formatted_chars += len(piece)
        if masked:
            plain = unescape(piece)
            self.loss_chars += len(plain)
            self.loss.update(plain.encode("utf-8", "surrogatepass"))
        start = max(0, len(self.buffer) - 8)
        self.buffer += piece
        while m := _MARKER.search(self.buffer, start):
            self._marker(m[0], self.buffer[: m.start()])
            self.buffer, start = self.buffer[m.end() :], 0

    def _marker(self, mark: str, before: str) -> None:
        if mark in ("<s>", "[INST]", "[SYS]", "[ROLE]", "[OUT]"):
            if before:
                raise ValueError(f"text outside a turn: {before[:40]!r}")
            self.head = mark
        elif mark == "[/ROLE]":
            self.role = unescape(before)
        else:
            role = {"[INST]": "user", "[SYS]": "system", "[OUT]": "assistant", "[ROLE]": self.role}[self.head]
            self.turns.update(f"{role}\n{unescape(before)}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1

    def row(self) -> dict:
        if self.buffer:
            raise ValueError("output ends inside a turn")
        return {"n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.formatted_chars}


def _ordered(conversations: DataFrame) -> DataFrame:
    """Turns of a conversation next to each other and in order; ties by role, then text."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, Iterator[dict]]]:
    """(conv_id, its messages), read lazily; each conversation is used up before the next."""
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))))
    waiting = next(rows, None)
    while waiting is not None:
        conv = waiting[0]

        def messages() -> Iterator[dict]:
            nonlocal waiting
            while waiting is not None and waiting[0] == conv:
                yield {"role": waiting[1], "text": waiting[2]}
                waiting = next(rows, None)

        turns = messages()
        yield conv, turns
        for _ in turns:
            pass


def format_conversations(conversations: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """conv_id, formatted (the whole output) and loss_spans ([start, end) code points under the mask).

    A null role or text counts as empty; rows with a null conv_id are one conversation.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for conv, turns in _conversations(batches):
            out, spans, at = [], [], 0
            for text, masked in render(turns):
                if masked:
                    spans.append([at, at + len(text)])
                at += len(text)
                out.append(text)
            columns = [pa.array([conv], pa.int64()), pa.array(["".join(out)], pa.string()), pa.array([spans], pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "formatted", "loss_spans"])

    return _ordered(conversations).mapInArrow(run, "conv_id long, formatted string, loss_spans array<array<long>>")


def conversation_digests(conversations: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """What Reader finds in the output of each conversation, without keeping that output."""

    types = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        found: list[dict] = []
        for conv, turns in _conversations(batches):
            reader = Reader()
            for text, masked in render(turns):
                reader.feed(text, masked)
            found.append({"conv_id": conv} | reader.row())
            if len(found) >= 1000:
                yield pa.RecordBatch.from_pylist(found, pa.schema(types))
                found = []
        if found:
            yield pa.RecordBatch.from_pylist(found, pa.schema(types))

    return _ordered(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
