"""Chat formatting by a template compiler.

``compile_template`` parses a small sandboxed template language into a syntax
tree, folds constants and generates Python closures:

* ``{{ expr }}``, ``{% if %} {% elif %} {% else %} {% endif %}``, ``{% for m in
  messages %} {% endfor %}``, ``{% set x = expr %}``, ``{% generation %}
  {% endgeneration %}`` (what the model learns to write), ``{# note #}``, and
  ``-`` inside a tag to strip the white space beside it;
* expressions: strings, whole numbers, true, false, none, names, the fields
  ``role`` and ``content`` of a message, ``loop.index0 / index / first / last /
  previous / next``, ``or and not``, comparisons, ``in``, ``+ - ~``, brackets, ``a if c else
  b`` and filters (``FILTERS``).  There are no calls, no other fields, no
  repetition and no loop but the one over the messages, so a template can
  neither reach Python objects nor run without end; unknown names, fields and
  filters are refused when it is compiled;
* constant expressions, branches with constant conditions and neighbouring
  texts are folded before closures are made.

Rendering streams: messages come from an iterator (one is read ahead, for
``loop.last``) and each gives one chunk, so a conversation of any length takes
the memory of one message.  ``guard`` puts a backslash behind the first
character of every control string in a text (and one more where there are some
already), so a text can't end a turn; ``unguard`` takes it off again.  ``Reader``
gives the turns back from formatted text.

``format_conversations`` shuffles the rows once, by conversation, sorted by turn; a
task renders its sorted rows one after the other.  The digest of a
conversation's turns is one sequential hash, so a conversation is read by one
task, in constant memory.

Null texts and roles are empty; rows of one turn are ordered by role, then
text; repeated rows are turns of their own; null conv_ids make one
conversation with a null id; null turns come first; extra columns are ignored; an
empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.jobs import prepare

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")

TEMPLATE = """{#- user turns between [INST] marks, other roles named; answers are learned -#}
<s>
{%- for m in messages -%}
  {%- if m.role == "user" -%}
    {{- "[INST]" ~ " " ~ (m.content | guard) ~ " [/INST]" -}}
  {%- elif m.role == "assistant" -%}
    {{- " " -}}{%- generation -%}{{- m.content | guard -}}{%- endgeneration -%}</s>
  {%- else -%}
    {{- "[ROLE] " ~ (m.role | guard) ~ " [/ROLE] " ~ (m.content | guard) -}}</s>
  {%- endif -%}
{%- endfor -%}
"""

# no control string holds its first character again, so two never overlap
_HEADS = "".join(sorted({re.escape(c[0]) for c in CONTROLS}))
_TAILS = "|".join(sorted({re.escape(c[1:]) for c in CONTROLS}))
_GUARD = re.compile(rf"([{_HEADS}]\\*)(?={_TAILS})")
_UNGUARD = re.compile(rf"([{_HEADS}]\\*)\\(?={_TAILS})")


def guard(text: str) -> str:
    """Break every control string of a text by a backslash; reversible for any text."""
    return _GUARD.sub(r"\1\\", text) if "<" in text or "[" in text else text


def unguard(text: str) -> str:
    return _UNGUARD.sub(r"\1", text) if "\\" in text else text


class TemplateError(ValueError):
    pass


# ---- syntax tree ----


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Filter:
    of: object
    name: str
    args: tuple


@dataclass(frozen=True)
class Apply:
    op: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Out:
    expr: object


@dataclass(frozen=True)
class Put:
    name: str
    expr: object


@dataclass(frozen=True)
class Branch:
    arms: tuple  # (condition, body); the last condition may be Const(True)


@dataclass(frozen=True)
class Each:
    name: str
    body: tuple


@dataclass(frozen=True)
class Learned:
    body: tuple


def _text(v) -> str:
    return "" if v is None else ("true" if v is True else "false" if v is False else str(v))


def _add(a, b):
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int):
        return a + b
    raise TemplateError("+ takes two texts or two numbers")


FILTERS: dict[str, Callable] = {
    "guard": lambda v: guard(_text(v)),
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(_text(v)),
    "default": lambda v, other: other if v is None or v == "" else v,
}
OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b, "in": lambda a, b: _text(a) in _text(b), "+": _add, "-": lambda a, b: int(a) - int(b),
    "~": lambda a, b: _text(a) + _text(b), "not": lambda a: not a,
}
MESSAGE_FIELDS = ("role", "content")
LOOP_FIELDS = ("index0", "index", "first", "last", "previous", "next")

# ---- parser ----

_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#(.*?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>~+\-|.(),]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expr:
    """Expressions by precedence: if-else, or, and, not, comparison, ~, + -, filters and fields."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"not understood: {source[at:]!r}")
            self.tokens.append((m.lastindex, m.group(m.lastindex)))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != 2 else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != 3:
            raise TemplateError("name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self):
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self):
        value = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Apply("if", (test, value, self.choice()))
        return value

    def either(self):
        left = self.both()
        while self.take("or"):
            left = Apply("or", (left, self.both()))
        return left

    def both(self):
        left = self.negated()
        while self.take("and"):
            left = Apply("and", (left, self.negated()))
        return left

    def negated(self):
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self):
        left = self.joined()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            left = Apply(op, (left, self.joined()))
        return left

    def joined(self):
        left = self.added()
        while self.take("~"):
            left = Apply("~", (left, self.added()))
        return left

    def added(self):
        left = self.piped()
        while op := self.take("+", "-"):
            left = Apply(op, (left, self.piped()))
        return left

    def piped(self):
        value = self.simple()
        while op := self.take(".", "|"):
            name = self.name()
            if op == ".":
                value = Field(value, name)
                continue
            args = []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.choice())
                    if self.peek() != ")":
                        self.need(",")
            value = Filter(value, name, tuple(args))
        return value

    def simple(self):
        if self.take("("):
            out = self.choice()
            self.need(")")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("expression expected")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return Const(int(word))
        if kind == 2:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == 3:
            return Const({"true": True, "false": False, "none": None}[word]) if word in ("true", "false", "none") else Name(word)
        raise TemplateError(f"unexpected {word!r}")


def _lexed(source: str) -> list[tuple[str, str]]:
    """(kind, content) parts: text, out, tag; white space beside a dash is gone."""
    parts, at, strip = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        if source.startswith("-", m.start() + 2):
            text = text.rstrip()
        if text:
            parts.append(("text", text))
        kind = {1: "out", 2: "tag"}.get(m.lastindex)
        if kind:
            parts.append((kind, m.group(m.lastindex).strip()))
        strip, at = source[m.end() - 3] == "-", m.end()
    text = source[at:]
    parts.append(("text", text.lstrip() if strip else text))
    return parts


def parse(source: str) -> tuple:
    parts = iter(_lexed(source))

    def body(*ends: str):
        out = []
        for kind, content in parts:
            if kind == "text":
                if content:
                    out.append(Text(content))
                continue
            if kind == "out":
                out.append(Out(_Expr(content).whole()))
                continue
            word, _, rest = content.partition(" ")
            if word in ends:
                return tuple(out), word, rest
            if word == "if":
                arms, test = [], _Expr(rest).whole()
                while True:
                    inner, end, rest = body("elif", "else", "endif") if test is not None else body("endif")
                    arms.append((Const(True) if test is None else test, inner))
                    if end == "endif":
                        break
                    test = _Expr(rest).whole() if end == "elif" else None
                out.append(Branch(tuple(arms)))
            elif word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
                if not m:
                    raise TemplateError("a loop runs over messages")
                out.append(Each(m[1], body("endfor")[0]))
            elif word == "generation":
                out.append(Learned(body("endgeneration")[0]))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not re.fullmatch(r"[A-Za-z_]\w*", name.strip()) or name.strip() in ("messages", "loop"):
                    raise TemplateError("set takes a name of its own")
                out.append(Put(name.strip(), _Expr(value).whole()))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(out), "", ""

    return body()[0]


# ---- constant folding ----


def folded(expr):
    """The expression with everything constant computed."""
    if isinstance(expr, Field):
        return Field(folded(expr.of), expr.name)
    if isinstance(expr, Filter):
        of, args = folded(expr.of), tuple(map(folded, expr.args))
        if expr.name not in FILTERS:
            raise TemplateError(f"no filter {expr.name!r}")
        if len(args) != (expr.name == "default"):
            raise TemplateError(f"wrong number of arguments for {expr.name}")
        if all(isinstance(a, Const) for a in (of, *args)):
            return Const(FILTERS[expr.name](of.value, *[a.value for a in args]))
        return Filter(of, expr.name, args)
    if isinstance(expr, Apply):
        args = tuple(map(folded, expr.args))
        if expr.op in ("if", "and", "or") and isinstance(args[0], Const):
            if expr.op == "if":
                return args[1] if args[0].value else args[2]
            return args[1] if bool(args[0].value) == (expr.op == "and") else args[0]
        if expr.op in OPERATORS and all(isinstance(a, Const) for a in args):
            return Const(OPERATORS[expr.op](*[a.value for a in args]))
        if expr.op == "~" and isinstance(args[1], Const) and isinstance(args[0], Apply) and args[0].op == "~" and isinstance(args[0].args[1], Const):
            return folded(Apply("~", (args[0].args[0], Const(_text(args[0].args[1].value) + _text(args[1].value)))))
        return Apply(expr.op, args)
    return expr


def folded_body(nodes: tuple) -> tuple:
    """The nodes with constants folded: decided branches inlined, outputs of constants turned to text, texts joined."""
    out: list = []

    def put(node):
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + node.text)
        elif not (isinstance(node, Text) and not node.text):
            out.append(node)

    for node in nodes:
        if isinstance(node, Out):
            expr = folded(node.expr)
            put(Text(_text(expr.value)) if isinstance(expr, Const) else Out(expr))
        elif isinstance(node, Put):
            put(Put(node.name, folded(node.expr)))
        elif isinstance(node, Branch):
            arms = []
            for test, body in node.arms:
                test = folded(test)
                if isinstance(test, Const) and not test.value:
                    continue
                arms.append((test, folded_body(body)))
                if isinstance(test, Const):
                    break
            if arms and isinstance(arms[0][0], Const):
                for inner in arms[0][1]:
                    put(inner)
            elif arms:
                put(Branch(tuple(arms)))
        elif isinstance(node, (Each, Learned)):
            body = folded_body(node.body)
            put(Each(node.name, body) if isinstance(node, Each) else Learned(body))
        else:
            put(node)
    return tuple(out)


# ---- closures ----


@dataclass
class Message:
    role: str
    content: str


@dataclass
class Loop:
    index0: int
    first: bool
    last: bool
    previous: Message | None
    next: Message | None
    index: int = field(init=False)

    def __post_init__(self):
        self.index = self.index0 + 1


def _expression(expr, names: dict[str, str]) -> Callable:
    """A closure env -> value; ``names`` gives each known name its kind (value, message, loop)."""
    if isinstance(expr, Const):
        value = expr.value
        return lambda env: value
    if isinstance(expr, Name):
        name = expr.name
        if names.get(name) != "value":
            raise TemplateError(f"no value named {name!r}")
        return lambda env: env[name]
    if isinstance(expr, Field):
        of, name = expr.of, expr.name
        kind = names.get(of.name) if isinstance(of, Name) else None
        if kind in ("message", "loop") and name in (MESSAGE_FIELDS if kind == "message" else LOOP_FIELDS):
            if kind == "loop" and name in ("previous", "next"):
                raise TemplateError(f"loop.{name} is a message: take its role or content")
            source = of.name
            return lambda env: getattr(env[source], name)
        if isinstance(of, Field) and isinstance(of.of, Name) and names.get(of.of.name) == "loop" and of.name in ("previous", "next") and name in MESSAGE_FIELDS:
            source, side = of.of.name, of.name
            return lambda env: None if (m := getattr(env[source], side)) is None else getattr(m, name)
        raise TemplateError(f"no field {name!r} here")
    if isinstance(expr, Filter):
        run, of, args = FILTERS[expr.name], _expression(expr.of, names), [_expression(a, names) for a in expr.args]
        if not args:
            return lambda env: run(of(env))
        return lambda env: run(of(env), args[0](env))
    args = [_expression(a, names) for a in expr.args]
    if expr.op == "if":
        return lambda env: args[1](env) if args[0](env) else args[2](env)
    if expr.op == "and":
        return lambda env: args[0](env) and args[1](env)
    if expr.op == "or":
        return lambda env: args[0](env) or args[1](env)
    run = OPERATORS[expr.op]
    if len(args) == 1:
        return lambda env: run(args[0](env))
    a, b = args
    return lambda env: run(a(env), b(env))


_BEGIN, _END = object(), object()


def _loops(nodes: tuple) -> bool:
    return any(isinstance(n, Each) or isinstance(n, Learned) and _loops(n.body) or isinstance(n, Branch) and any(_loops(b) for _, b in n.arms) for n in nodes)


def _plain(nodes: tuple, names: dict[str, str], learned: bool) -> Callable:
    """A closure (env, out) for nodes without a loop: it appends texts and marks to ``out``."""
    steps = []
    for node in nodes:
        if isinstance(node, Text):
            steps.append(lambda env, out, text=node.text: out.append(text))
        elif isinstance(node, Out):
            steps.append(lambda env, out, f=_expression(node.expr, names): out.append(_text(f(env))))
        elif isinstance(node, Put):
            f = _expression(node.expr, names)
            names[node.name] = "value"
            steps.append(lambda env, out, f=f, name=node.name: env.__setitem__(name, f(env)))
        elif isinstance(node, Branch):
            arms = [(_expression(t, names), _plain(b, names, learned)) for t, b in node.arms]

            def branch(env, out, arms=arms):
                for test, body in arms:
                    if test(env):
                        return body(env, out)

            steps.append(branch)
        else:
            if learned:
                raise TemplateError("generation inside generation")
            body = _plain(node.body, names, True)
            steps.append(lambda env, out, body=body: (out.append(_BEGIN), body(env, out), out.append(_END)))
    if len(steps) == 1:
        return steps[0]

    def run(env, out):
        for s in steps:
            s(env, out)

    return run


def _streamed(nodes: tuple, names: dict[str, str]) -> Callable:
    """A closure env -> iterator of piece lists: one for each message of a loop, one for each stretch between."""
    parts: list = []
    for node in nodes:
        if isinstance(node, Each):
            if "loop" in names or _loops(node.body):
                raise TemplateError("a loop inside a loop")
            if node.name in ("messages", "loop"):
                raise TemplateError("the loop's name is taken")
            inner = names | {node.name: "message", "loop": "loop"}
            parts.append((node.name, _plain(node.body, inner, False)))
        elif isinstance(node, Branch) and _loops((node,)):
            parts.append((None, [(_expression(t, names), _streamed(b, dict(names))) for t, b in node.arms]))
        elif isinstance(node, Learned) and _loops((node,)):
            raise TemplateError("a loop inside generation")
        else:
            parts.append(("", _plain((node,), names, False)))

    def run(env):
        for name, part in parts:
            if name == "":
                out: list = []
                part(env, out)
                yield out
            elif name is None:
                for test, body in part:
                    if test(env):
                        yield from body(env)
                        break
            else:
                messages = env["messages"]
                if messages is None:
                    raise TemplateError("messages are read once")
                env["messages"] = None
                before, now, i = None, next(messages, None), 0
                while now is not None:
                    after = next(messages, None)
                    env[name], env["loop"], out = now, Loop(i, i == 0, after is None, before, after), []
                    part(env, out)
                    yield out
                    before, now, i = now, after, i + 1

    return run


class Template:
    """A compiled template: ``tree`` is its folded syntax tree."""

    def __init__(self, source: str):
        self.tree = folded_body(parse(source))
        self._run = _streamed(self.tree, {})

    def render(self, messages: Iterator[Message]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """(text, learned spans in it) chunk by chunk; a span is (start, end) in code points of the chunk."""
        for pieces in self._run({"messages": iter(messages)}):
            if not pieces:
                continue
            texts, spans, at, open_at = [], [], 0, 0
            for p in pieces:
                if p is _BEGIN:
                    open_at = at
                elif p is _END:
                    spans.append((open_at, at))
                else:
                    texts.append(p)
                    at += len(p)
            yield "".join(texts), spans


compile_template = Template


class Reader:
    """Turns back from formatted text (of ``TEMPLATE``), fed in pieces of any length."""

    def __init__(self):
        self.held = ""
        self.begun = False

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        s, at = (self.held + text if self.held else text), 0
        if not self.begun and s:
            if not s.startswith("<s>"):
                if "<s>".startswith(s):
                    self.held = s
                    return
                raise ValueError("no conversation begins here")
            self.begun, at = True, 3
        while at < len(s):
            if s.startswith("[INST] ", at):
                end = s.find(" [/INST]", at + 7)
                if end < 0:
                    break
                yield "user", unguard(s[at + 7 : end])
                at = end + 8
            elif s[at] == " ":
                end = s.find("</s>", at)
                if end < 0:
                    break
                yield "assistant", unguard(s[at + 1 : end])
                at = end + 4
            elif s.startswith("[ROLE] ", at):
                mid = s.find(" [/ROLE] ", at + 7)
                end = s.find("</s>", mid) if mid >= 0 else -1
                if end < 0:
                    break
                yield unguard(s[at + 7 : mid]), unguard(s[mid + 9 : end])
                at = end + 4
            elif len(s) - at < 7 and s[at] == "[":
                break  # a mark that has not come whole
            else:
                raise ValueError("a turn begins with no known mark")
        self.held = s[at:]

    def close(self) -> None:
        if self.held or not self.begun:
            raise ValueError("the text ends inside a turn")


# ---- Spark ----


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[Message]]]:
    """(conv_id, messages) of rows that are sorted by conversation; each must be read to its end before the next."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3))))
    ahead = [next(rows, None)]

    def messages(conv):
        while ahead[0] is not None and ahead[0][0] == conv:
            _, role, text = ahead[0]
            ahead[0] = next(rows, None)
            yield Message(role or "", text or "")

    while ahead[0] is not None:
        conv = ahead[0][0]
        yield conv, messages(conv)


def _sorted(conversations: DataFrame) -> DataFrame:
    prepare(conversations.sparkSession)
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, part, start, text, learned) of ``conversations`` (conv_id, turn, role, text): the formatted text in
    pieces (number, first code point in the conversation), with the learned spans as code points of the conversation."""
    kind = dict(conversations.dtypes)["conv_id"]
    Template(template)  # refused here, not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, rows, size = Template(template), [], 0

        def flush():
            out = pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], id_type), *[pa.array([r[i] for r in rows], t) for i, t in
                                                            ((1, pa.int64()), (2, pa.int64()), (3, pa.string()), (4, pa.list_(span)))]],
                ["conv_id", "part", "start", "text", "learned"])
            rows.clear()
            return out

        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
        for conv, messages in _conversations(batches):
            at = 0
            for part, (text, spans) in enumerate(made.render(messages)):
                rows.append((conv, part, at, text, [{"start": at + a, "end": at + b} for a, b in spans]))
                at += len(text)
                size += len(text)
                if len(rows) >= 1000 or size > 1 << 22:
                    yield flush()
                    size = 0
        if rows:
            yield flush()

    return _sorted(conversations).mapInArrow(run, f"conv_id {kind}, part long, start long, text string, learned array<struct<start: long, end: long>>")


def format_digests(conversations: DataFrame) -> DataFrame:
    """One row a conversation, read back from its formatted text: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    kind = dict(conversations.dtypes)["conv_id"]
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, rows = Template(TEMPLATE), []
        for conv, messages in _conversations(batches):
            reader, turns, loss, n, learned, total = Reader(), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for text, spans in template.render(messages):
                total += len(text)
                for a, b in spans:
                    own = unguard(text[a:b])
                    learned += len(own)
                    loss.update(own.encode("utf-8"))
                for role, content in reader.feed(text):
                    turns.update(f"{role}\n{content}\n".encode())
                    n += 1
            reader.close()
            rows.append((conv, n, turns.hexdigest(), learned, loss.hexdigest(), total))
            if len(rows) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return _sorted(conversations).mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op12_template_compiler(spark, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_digests(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(planted))
