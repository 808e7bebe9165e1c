"""Chat formatting: a compiler for a small template language, run over conversations.

A template is parsed into a syntax tree, constants are folded, and each node becomes a Python
closure; nothing is evaluated as code, attributes are looked up in plain data alone, and there are no
calls but the filters below. Rendering yields text and, for what stands within ``generation`` marks,
the spans of the loss mask.

    {{ expression }}    {% if %} {% elif %} {% else %} {% endif %}    {# comment #}
    {% for x in list %} {% endfor %} (with loop.index, .index0, .first, .last)    {% set x = ... %}
    {% generation %} {% endgeneration %}
    expressions: 'text' 12 true false none, names, a.b, a['b'], == != < > <= >= in, not, and, or,
    + ~, a if b else c, filters: x | trim, upper, lower, length, default('..'), escape, raw

What an expression puts out is escaped unless the template marks it ``raw``: control strings in texts
are broken up by a backslash after their first character, and backslashes are doubled, so that no
text can forge a turn and every text can be had back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.session import small_batches

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
#: The production template: every turn says its role; assistant texts are what a model is trained on.
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}<s>[INST]{{ m.text }}[/INST]"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text }}{% endgeneration %}"
    "{% elif m.role == 'system' %}<s><<SYS>>{{ m.text }}<</SYS>>"
    "{% else %}<s>[ROLE]{{ m.role }}[/ROLE]{{ m.text }}{% endif %}"
    "</s>{% endfor %}"
)


class TemplateError(ValueError):
    """The template is not in the language: the only error that compiling one raises."""


DEPTH = 40  # tags within tags, and expressions within expressions
LENGTH = 100  # operators of an expression


# -- escaping -------------------------------------------------------------------------------------


@lru_cache(maxsize=16)
def _control(controls: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, sorted(controls, key=len, reverse=True))))


def escape(text: str, controls: tuple[str, ...] = CONTROLS) -> str:
    return _control(controls).sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Undo escape(): of a backslash and another one stays, a single one goes."""
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


# -- lexer ----------------------------------------------------------------------------------------

_TAG = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~|.\[\](),<>=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(source: str) -> list[tuple[str, object]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m or m.end() == at:
            raise TemplateError(f"unexpected {source[at : at + 20]!r}")
        kind = m.lastgroup
        value: object = m[kind]
        if kind == "str":
            value = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[kind][1:-1], flags=re.S)
        elif kind == "num":
            if len(m[kind]) > 18:
                raise TemplateError("a number is too long")
            value = int(m[kind])
        out.append((kind, value))
        at = m.end()
    return out


# -- syntax tree ----------------------------------------------------------------------------------
# nodes are tuples: (name, part, ...)


class _Expressions:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str) -> None:
        self.rest, self.depth, self.length = _tokens(source), 0, 0

    def peek(self, *values: str) -> bool:
        return bool(self.rest) and self.rest[0][0] in ("op", "name") and self.rest[0][1] in values

    def take(self, *values: str) -> object:
        if values and not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values)}")
        if not self.rest:
            raise TemplateError("the tag ends too soon")
        return self.rest.pop(0)[1]

    def name(self) -> str:
        if not self.rest or self.rest[0][0] != "name":
            raise TemplateError("a name is missing")
        return self.rest.pop(0)[1]

    def end(self) -> None:
        if self.rest:
            raise TemplateError(f"unexpected {self.rest[0][1]!r}")

    def choice(self) -> tuple:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError(f"expressions are nested more than {DEPTH} deep")
        value = self._choice()
        self.depth -= 1
        return value

    def longer(self) -> None:
        """One operator more; a chain of them is as deep a tree as it is long."""
        self.length += 1
        if self.length > LENGTH:
            raise TemplateError(f"an expression has more than {LENGTH} operators")

    def _choice(self) -> tuple:
        value = self.either()
        if self.peek("if"):
            self.take()
            test = self.either()
            other = ("const", "")
            if self.peek("else"):
                self.take()
                other = self.choice()
            return ("choice", test, value, other)
        return value

    def either(self) -> tuple:
        left = self.both()
        while self.peek("or"):
            self.longer()
            self.take()
            left = ("or", left, self.both())
        return left

    def both(self) -> tuple:
        left = self.negated()
        while self.peek("and"):
            self.longer()
            self.take()
            left = ("and", left, self.negated())
        return left

    def negated(self) -> tuple:
        nots = 0
        while self.peek("not"):
            self.take()
            nots += 1
        value = self.compared()
        for _ in range(nots if nots < 2 else 2 - nots % 2):
            value = ("not", value)
        return value

    def compared(self) -> tuple:
        left = self.added()
        while self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
            self.longer()
            op = self.take()
            left = ("compare", op, left, self.added())
        return left

    def added(self) -> tuple:
        left = self.filtered()
        while self.peek("+", "~"):
            self.longer()
            op = self.take()
            left = ("add" if op == "+" else "join", left, self.filtered())
        return left

    def filtered(self) -> tuple:
        value = self.member()
        while self.peek("|"):
            self.longer()
            self.take()
            name = self.name()
            given = []
            if self.peek("("):
                self.take()
                while not self.peek(")"):
                    given.append(self.choice())
                    if self.peek(","):
                        self.take()
                self.take(")")
            if name not in FILTERS and name != "raw":
                raise TemplateError(f"no filter {name!r}")
            fewest, most = ARGUMENTS.get(name, (0, 0))
            if not fewest <= len(given) <= most:
                raise TemplateError(f"{name} takes {most} arguments")
            value = ("filter", name, value, *given)
        return value

    def member(self) -> tuple:
        value = self.atom()
        while self.peek(".", "["):
            self.longer()
            if self.take() == ".":
                value = ("get", value, ("const", self.name()))
            else:
                value = ("get", value, self.choice())
                self.take("]")
        return value

    def atom(self) -> tuple:
        if not self.rest:
            raise TemplateError("an expression is missing")
        kind, value = self.rest.pop(0)
        if kind in ("str", "num"):
            return ("const", value)
        if kind == "name":
            words = {"true": True, "false": False, "none": None}
            return ("const", words[value.lower()]) if value.lower() in words else ("name", value)
        if value == "(":
            inner = self.choice()
            self.take(")")
            return inner
        if value == "-" and self.rest and self.rest[0][0] == "num":
            return ("const", -self.rest.pop(0)[1])
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> tuple:
    """The syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _TAG.finditer(template):
        parts.append(("text", template[at : m.start()]))
        if m[1] is not None:
            parts.append(("out", m[1]))
        elif m[2] is not None:
            parts.append(("tag", m[2].strip()))
        at = m.end()
        for k, side in ((-2, m[0][2] == "-"), (None, m[0][-3] == "-")):
            if side and k is not None:
                parts[k] = (parts[k][0], parts[k][1].rstrip())
            elif side:
                at += len(template[at:]) - len(template[at:].lstrip())
    parts.append(("text", template[at:]))

    depth = 0

    def block(stops: tuple[str, ...]) -> tuple[tuple, str]:
        nonlocal depth
        depth += 1
        if depth > DEPTH:
            raise TemplateError(f"tags are nested more than {DEPTH} deep")
        try:
            return inner_block(stops)
        finally:
            depth -= 1

    def inner_block(stops: tuple[str, ...]) -> tuple[tuple, str]:
        nodes: list[tuple] = []
        while parts:
            kind, source = parts.pop(0)
            if kind == "text":
                nodes.append(("text", source))
                continue
            if kind == "out":
                e = _Expressions(source)
                nodes.append(("out", e.choice()))
                e.end()
                continue
            word, _, rest = source.partition(" ")
            if word in stops:
                return ("block", *nodes), source
            e = _Expressions(rest)
            if word == "if":
                arms = []
                test = e.choice()
                while True:
                    e.end()
                    body, stop = block(("elif", "else", "endif"))
                    arms.append((test, body))
                    if stop.startswith("elif"):
                        e = _Expressions(stop[4:])
                        test = e.choice()
                        continue
                    other = block(("endif",))[0] if stop == "else" else ("block",)
                    nodes.append(("if", tuple(arms), other))
                    break
            elif word == "for":
                name = e.name()
                e.take("in")
                items = e.choice()
                e.end()
                nodes.append(("for", name, items, block(("endfor",))[0]))
            elif word == "set":
                name = e.name()
                e.take("=")
                nodes.append(("set", name, e.choice()))
                e.end()
            elif word == "generation":
                e.end()
                nodes.append(("generation", block(("endgeneration",))[0]))
            else:
                raise TemplateError(f"no tag {word!r}")
        if stops:
            raise TemplateError(f"{stops[-1]} is missing")
        return ("block", *nodes), ""

    return block(())[0]


# -- folding --------------------------------------------------------------------------------------


def fold(node: tuple) -> tuple:
    """The same tree with what is known beforehand worked out."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "block":
        out: list[tuple] = []
        for n in map(fold, node[1:]):
            for x in n[1:] if n[0] == "block" else (n,):
                if x[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + x[1])
                elif x != ("text", ""):
                    out.append(x)
        return ("block", *out)
    if kind == "if":
        arms, other = [], fold(node[2])
        for test, body in node[1]:
            test = fold(test)
            if test[0] == "const":
                if not test[1]:
                    continue
                other = fold(body)
                break
            arms.append((test, fold(body)))
        return ("if", tuple(arms), other) if arms else other
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    node = (kind, *(fold(x) if isinstance(x, tuple) else x for x in node[1:]))
    if kind == "out":
        e = node[1]
        if e[0] == "filter" and e[1] == "raw" and e[2][0] == "const":
            return ("text", _text(e[2][1]))
        return node
    if kind == "set" or kind == "filter" and node[1] in ("raw", "escape"):
        return node
    given = [x for x in node[1:] if isinstance(x, tuple)]
    if given and all(x[0] == "const" for x in given):
        return ("const", _compile_expression(node, CONTROLS)({}))
    return node


# -- closures -------------------------------------------------------------------------------------


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _get(value: object, key: object) -> object:
    """A key of a mapping or a place in a list; all else is none: no attribute is ever looked up."""
    if isinstance(value, dict):
        return value.get(key) if isinstance(key, (str, int)) else None
    if isinstance(value, (list, tuple, str)) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    return None


FILTERS: dict[str, Callable] = {
    "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(),
    "length": lambda v: len(v) if isinstance(v, (str, list, tuple, dict)) else 0,
    "default": lambda v, other="": other if v is None else v,
    "escape": _text,  # which every output is anyway
}
ARGUMENTS = {"default": (0, 1)}  # fewest and most that a filter takes; others take none


def _ordered(a: object, b: object) -> bool:
    """Only two numbers, or two texts, come before one another."""
    return isinstance(a, int) and isinstance(b, int) or isinstance(a, str) and isinstance(b, str)


def _within(a: object, b: object) -> bool:
    if isinstance(b, str):
        return isinstance(a, str) and a in b
    return isinstance(b, (list, tuple, dict)) and (not isinstance(b, dict) or isinstance(a, (str, int))) and a in b


_COMPARE: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: _ordered(a, b) and a < b,
    ">": lambda a, b: _ordered(a, b) and a > b,
    "<=": lambda a, b: _ordered(a, b) and a <= b,
    ">=": lambda a, b: _ordered(a, b) and a >= b,
    "in": _within,
}


def _compile_expression(node: tuple, controls: tuple[str, ...]) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda env: value
    if kind == "name":
        name = node[1]
        return lambda env: env.get(name)
    parts = [_compile_expression(x, controls) for x in node[1:] if isinstance(x, tuple)]
    if kind == "get":
        whole, key = parts
        return lambda env: _get(whole(env), key(env))
    if kind == "choice":
        test, a, b = parts
        return lambda env: a(env) if test(env) else b(env)
    if kind == "or":
        a, b = parts
        return lambda env: a(env) or b(env)
    if kind == "and":
        a, b = parts
        return lambda env: a(env) and b(env)
    if kind == "not":
        (a,) = parts
        return lambda env: not a(env)
    if kind == "compare":
        op = _COMPARE[node[1]]
        a, b = parts
        return lambda env: op(a(env), b(env))
    if kind == "add":
        a, b = parts

        def add(env: dict) -> object:
            x, y = a(env), b(env)
            return x + y if isinstance(x, int) and isinstance(y, int) else _text(x) + _text(y)

        return add
    if kind == "join":
        a, b = parts
        return lambda env: _text(a(env)) + _text(b(env))
    if kind == "filter":
        if node[1] == "raw":
            return parts[0]
        f, value, given = FILTERS[node[1]], parts[0], parts[1:]
        return lambda env: f(value(env), *(g(env) for g in given))
    raise TemplateError(f"no expression {kind!r}")


@dataclass
class Rendered:
    """Text so far, and the spans of the loss mask in code points."""

    parts: list[str]
    spans: list[tuple[int, int]]
    size: int = 0
    inside: int = 0  # generation marks that are open

    def put(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.size += len(text)


def _compile(node: tuple, controls: tuple[str, ...]) -> Callable[[dict, Rendered], None]:
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda env, out: out.put(text)
    if kind == "out":
        raw = node[1][0] == "filter" and node[1][1] == "raw"
        value = _compile_expression(node[1], controls)
        if raw:
            return lambda env, out: out.put(_text(value(env)))
        return lambda env, out: out.put(escape(_text(value(env)), controls))
    if kind == "block":
        steps = [_compile(x, controls) for x in node[1:]]

        def block(env: dict, out: Rendered) -> None:
            for step in steps:
                step(env, out)

        return block
    if kind == "if":
        arms = [(_compile_expression(t, controls), _compile(b, controls)) for t, b in node[1]]
        other = _compile(node[2], controls)

        def choose(env: dict, out: Rendered) -> None:
            for test, body in arms:
                if test(env):
                    return body(env, out)
            return other(env, out)

        return choose
    if kind == "for":
        name, items, body = node[1], _compile_expression(node[2], controls), _compile(node[3], controls)

        def loop(env: dict, out: Rendered) -> None:
            seen = items(env)
            seen = list(seen) if isinstance(seen, (list, tuple)) else []
            for k, x in enumerate(seen):
                body({**env, name: x, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": k == len(seen) - 1, "length": len(seen)}}, out)

        return loop
    if kind == "set":
        name, value = node[1], _compile_expression(node[2], controls)

        def put(env: dict, out: Rendered) -> None:
            env[name] = value(env)

        return put
    if kind == "generation":
        body = _compile(node[1], controls)

        def generate(env: dict, out: Rendered) -> None:
            begin, out.inside = out.size, out.inside + 1
            body(env, out)
            out.inside -= 1
            if not out.inside:  # marks within marks add nothing: no text counts twice
                out.spans.append((begin, out.size))

        return generate
    raise TemplateError(f"no node {kind!r}")


@lru_cache(maxsize=32)
def compiled(template: str, controls: tuple[str, ...] = CONTROLS) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages to the formatted text and the spans of its loss mask."""
    run = _compile(fold(parse(template)), controls)

    def render(messages: list[dict], **given: object) -> tuple[str, list[tuple[int, int]]]:
        out = Rendered([], [])
        run({"messages": messages, **given}, out)
        return "".join(out.parts), out.spans

    return render


# -- reading back what the production template writes ---------------------------------------------

_TURN = re.compile(r"<s>(?:\[INST\](?P<user>.*?)\[/INST\]|<<SYS>>(?P<system>.*?)<</SYS>>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<other>.*?)|(?P<assistant>.*?))</s>", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a text in the production template."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        kind = m.lastgroup
        role, text = (m["role"], m["other"]) if kind == "other" else (kind, m[kind])
        out.append((unescape(role), unescape(text)))
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return out


def loss_text(formatted: str, spans: list[tuple[int, int]]) -> str:
    """All text under the mask, unescaped."""
    return "".join(unescape(formatted[a:b]) for a, b in spans)


# -- in Spark -------------------------------------------------------------------------------------


def _format(template: str, controls: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template, controls)
        spans_of = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            texts, spans = [], []
            for turns in b.column("turns").to_pylist():
                text, own = render([{"role": t["role"], "text": t["text"]} for t in turns])
                texts.append(text)
                spans.append([{"begin": x, "end": y} for x, y in own])
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(texts, pa.string()), pa.array(spans, spans_of)], names=["conv_id", "formatted", "loss_spans"])

    return run


def format_conversations(rows: DataFrame, template: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """``(conv_id, formatted, loss_spans)`` from rows ``(conv_id, turn, role, text)``.

    Turns go by number (null first), then role and text, so equal numbers have a fixed order; repeated
    rows are turns of their own. Null roles and texts are empty; rows of a null conversation are one.
    """
    small_batches(rows.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col("turn"), empty("role").alias("role"), empty("text").alias("text"))
    grouped = rows.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return grouped.mapInArrow(_format(template, controls), "conv_id long, formatted string, loss_spans array<struct<begin: long, end: long>>")


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for b in batches:
        rows = []
        for i, text, spans in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            turns = read_turns(text)
            loss = loss_text(text, [(s["begin"], s["end"]) for s in spans])
            rows.append((i, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _DIGEST.split(", ")])


def digest(formatted: DataFrame) -> DataFrame:
    """What format_conversations() gives with the production template, read back from the text."""
    return formatted.mapInArrow(_digest, _DIGEST)
