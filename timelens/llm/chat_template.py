"""Chat formatting by compiled templates.

A template is parsed into a syntax tree, constants are folded, and each node becomes a Python closure. The language is
sandboxed: expressions reach only the names given, keys of mappings, items of lists, and the filters listed in FILTERS; there are no calls,
no attributes and no imports. Tags may drop white space beside them (``-``), comments are left out, ``set`` binds a name up to the end of
its block, and whatever is wrong with a template or its values is a TemplateError. Rendering is lazy: turns are an iterator, and pieces come out as (text, masked), masked
being true inside ``{% generation %}``. Conversations of any length therefore render, and are read back, turn by turn.

Defined results: null roles and texts count as empty; turns are ordered by turn, then role, then text, nulls first, and
repeated rows are turns of their own; rows without a conv_id form one conversation; an empty table leaves the fixed conversation
alone; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timelens.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"

TEMPLATE = (
    "{% for m in turns %}{{ '<|im_start|>' + (m.role | escape_line) + '\\n' }}"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "{{ '<|im_end|>' + '\\n' }}{% endfor %}"
)


def escape(text: str) -> str:
    """One more backslash between ``<`` and ``|``, so that no control string is left; undone by unescape."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_line(text: str) -> str:
    """escape for text that must stay on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text), flags=re.S)


FILTERS: dict[str, Callable] = {"escape": escape, "escape_line": escape_line, "upper": str.upper, "lower": str.lower, "trim": str.strip, "length": len}

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[+%|().\[\]-]))")
# a tag ends at the first closing mark that stands in none of its strings
_STRINGS = r"(?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|[^'\"])*?"
_PARTS = re.compile(r"({{" + _STRINGS + r"}}|{%" + _STRINGS + r"%}|{#.*?#})", re.S)
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    pass


# Syntax tree: tuples whose first item is the kind. Expressions: const, name, key, eq, ne, add, and, or, not, filter.
# Statements: text, print, for, if, generation, block.


class _Expression:
    """Recursive descent over one expression; constants are folded as nodes are made."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in values

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> tuple:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> tuple:
        node = self.both()
        while self.peek("or"):
            self.take()
            node = fold(("or", node, self.both()))
        return node

    def both(self) -> tuple:
        node = self.negated()
        while self.peek("and"):
            self.take()
            node = fold(("and", node, self.negated()))
        return node

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take()
            return fold(("not", self.negated()))
        return self.compared()

    def compared(self) -> tuple:
        node = self.added()
        while self.peek("==", "!=", "in", "is", "not"):
            word = self.take()[1]
            if word in ("==", "!="):
                node = fold(("eq" if word == "==" else "ne", node, self.added()))
            elif word == "is":
                node = self.tested(node)
            else:
                if word == "not" and self.take()[1] != "in":
                    raise TemplateError("not is followed by in here")
                inside = fold(("in", node, self.added()))
                node = inside if word == "in" else fold(("not", inside))
        return node

    def tested(self, node: tuple) -> tuple:
        """What follows ``is``: defined or none, either with not."""
        negated = self.peek("not") and bool(self.take())
        name = self.take()[1]
        if name not in ("defined", "none"):
            raise TemplateError(f"no test {name!r}")
        found: tuple = (name, node)
        return ("not", found) if negated else found

    def added(self) -> tuple:
        node = self.divided()
        while self.peek("+", "-"):
            kind = "add" if self.take()[1] == "+" else "less"
            node = fold((kind, node, self.divided()))
        return node

    def divided(self) -> tuple:
        node = self.filtered()
        while self.peek("%"):
            self.take()
            node = fold(("rest", node, self.filtered()))
        return node

    def filtered(self) -> tuple:
        node = self.atom()
        while self.peek("|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = fold(("filter", node, name))
        return node

    def atom(self) -> tuple:
        kind, value = self.take()
        if value == "(" and kind == "op":
            node = self.either()
            if self.take()[1] != ")":
                raise TemplateError("missing )")
        elif kind == "str":
            node = ("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "num":
            node = ("const", int(value))
        elif kind == "name":
            low = value.lower()
            node = ("const", {"true": True, "false": False, "none": None}[low]) if low in ("true", "false", "none") else ("name", value)
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek(".", "["):
            if self.take()[1] == "[":
                of = self.either()
                if self.take()[1] != "]":
                    raise TemplateError("missing ]")
                if of[0] == "const" and isinstance(of[1], str) and of[1].startswith("_"):
                    raise TemplateError(f"key {of[1]!r} is not allowed")
                node = ("item", node, of)
                continue
            kind, key = self.take()
            if kind != "name" or key.startswith("_"):
                raise TemplateError(f"key {key!r} is not allowed")
            node = ("key", node, key)
        return node


_FOLDS: dict[str, Callable] = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "in": lambda a, b: a in b,
    "add": lambda a, b: a + b,
    "less": lambda a, b: a - b,
    "rest": lambda a, b: a % b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "not": lambda a: not a,
}


def _tried(does: Callable, *args: object) -> object:
    """A function of a template's values; what they don't allow is the template's error."""
    try:
        if does is _FOLDS["rest"] and not all(isinstance(a, int) for a in args):
            raise TypeError("only whole numbers have a remainder")
        return does(*args)
    except (TypeError, ValueError, ArithmeticError, AttributeError) as e:
        raise TemplateError(str(e)) from e


def fold(node: tuple) -> tuple:
    """The constant that an expression of constants has as its value, else the expression."""
    kind, *args = node
    if kind == "filter" and args[0][0] == "const":
        return ("const", _tried(FILTERS[args[1]], args[0][1]))
    if kind in _FOLDS and all(a[0] == "const" for a in args):
        return ("const", _tried(_FOLDS[kind], *(a[1] for a in args)))
    return node


def parse(source: str) -> tuple:
    """The syntax tree of a template, constants folded, neighbouring texts joined and dead branches gone."""
    parts = [p for p in _trimmed(_PARTS.split(source)) if p]
    tree, at = _block(parts, 0, ())
    if at < len(parts):
        raise TemplateError(f"unexpected {parts[at]}")
    return tree


def _trimmed(parts: list[str]) -> list[str]:
    """Texts and tags in turn, without comments, and without the white space that tags drop; tags lose their hyphens."""
    out = list(parts)
    for i in range(1, len(out), 2):
        tag = out[i]
        if tag[2] == "-":
            out[i - 1] = out[i - 1].rstrip()
        if tag[-3] == "-" and len(tag) > 5:
            out[i + 1] = out[i + 1].lstrip()
        out[i] = "" if tag.startswith("{#") else tag[:2] + tag[2:-2].removeprefix("-").removesuffix("-") + tag[-2:]
    return out


def _block(parts: list[str], at: int, ends: tuple[str, ...]) -> tuple[tuple, int]:
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "block":
            for x in node[1]:
                add(x)
        elif node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        else:
            out.append(node)

    while at < len(parts):
        part = parts[at]
        if part.startswith("{{"):
            node = _Expression(part[2:-2]).whole()
            add(("text", str(node[1])) if node[0] == "const" else ("print", node))
            at += 1
        elif part.startswith("{%"):
            words = part[2:-2].strip()
            head = words.split(None, 1)[0] if words else ""
            if head in ends:
                break
            if head == "set":
                m = re.fullmatch(r"set\s+([A-Za-z]\w*)\s*=\s*(.+)", words, re.S)
                if not m:
                    raise TemplateError(words)
                add(("set", m[1], _Expression(m[2]).whole()))
                at += 1
                continue
            if head == "for":
                m = re.fullmatch(r"for\s+([A-Za-z]\w*)\s+in\s+(.+)", words, re.S)
                if not m:
                    raise TemplateError(words)
                body, at = _block(parts, at + 1, ("endfor",))
                add(("for", m[1], _Expression(m[2]).whole(), body))
            elif head == "generation":
                body, at = _block(parts, at + 1, ("endgeneration",))
                add(("generation", body))
            elif head == "if":
                node, at = _if(parts, at)
                add(node)
            else:
                raise TemplateError(f"unexpected {words!r}")
            if at >= len(parts):
                raise TemplateError(f"{head} has no end")
            at += 1
        else:
            add(("text", part))
            at += 1
    return ("block", tuple(out)), at


def _if(parts: list[str], at: int) -> tuple[tuple, int]:
    """An if with its elif and else branches; stands at its endif when done."""
    condition = _Expression(re.sub(r"^\s*(el)?if\b", "", parts[at][2:-2])).whole()
    yes, at = _block(parts, at + 1, ("elif", "else", "endif"))
    no: tuple = ("block", ())
    if at < len(parts):
        head = parts[at][2:-2].strip().split(None, 1)[0]
        if head == "elif":
            no, at = _if(parts, at)
        elif head == "else":
            no, at = _block(parts, at + 1, ("endif",))
    if condition[0] == "const":
        return (yes if condition[1] else no), at
    return ("if", condition, yes, no), at


def _value(node: tuple) -> Callable[[dict], object]:
    """The closure of an expression."""
    kind, *args = node
    if kind == "const":
        value = args[0]
        return lambda env: value
    if kind == "name":
        name = args[0]
        return lambda env: env.get(name, "")
    if kind == "key":
        of, key = _value(args[0]), args[1]

        def look_up(env: dict) -> object:
            found = of(env)
            return found.get(key, "") if isinstance(found, dict) else ""

        return look_up
    if kind == "item":
        of, which = map(_value, args)

        def item(env: dict) -> object:
            found, key = of(env), which(env)
            if isinstance(found, dict):
                return "" if str(key).startswith("_") else found.get(key, "")
            return found[key] if isinstance(found, (list, tuple)) and isinstance(key, int) and -len(found) <= key < len(found) else ""

        return item
    if kind == "defined":
        of, name = _value(args[0]), args[0][1] if args[0][0] == "name" else None
        return lambda env: name in env if name is not None else of(env) != ""
    if kind == "none":
        of = _value(args[0])
        return lambda env: of(env) is None
    if kind == "filter":
        of, does = _value(args[0]), FILTERS[args[1]]
        return lambda env: _tried(does, of(env))
    if kind == "not":
        of = _value(args[0])
        return lambda env: not of(env)
    a, b = map(_value, args)
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    does = _FOLDS[kind]
    return lambda env: _tried(does, a(env), b(env))


Piece = tuple[str, bool]


def _statement(node: tuple, masked: bool) -> Callable[[dict], Iterator[Piece]]:
    """The closure of a statement: a generator of pieces."""
    kind, *args = node
    if kind == "text":
        piece = (args[0], masked)

        def constant(env: dict) -> Iterator[Piece]:
            yield piece

        return constant
    if kind == "print":
        of = _value(args[0])

        def printed(env: dict) -> Iterator[Piece]:
            yield str(of(env)), masked

        return printed
    if kind == "set":
        bound, of = args[0], _value(args[1])

        def assigned(env: dict) -> Iterator[Piece]:
            env[bound] = of(env)
            yield from ()

        return assigned
    if kind == "generation":
        return _statement(args[0], True)
    if kind == "if":
        test, yes, no = _value(args[0]), _statement(args[1], masked), _statement(args[2], masked)
        return lambda env: yes(env) if test(env) else no(env)
    if kind == "for":
        name, of, body = args[0], _value(args[1]), _statement(args[2], masked)

        def looped(env: dict) -> Iterator[Piece]:
            found = of(env)
            if isinstance(found, (str, bytes)) or not hasattr(found, "__iter__"):
                raise TemplateError(f"{name!r} has nothing to go over")
            # one item ahead, to know the last one
            items = iter(found)
            item, i = next(items, items), 0
            while item is not items:
                after = next(items, items)
                yield from body({**env, name: item, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": after is items}})
                item, i = after, i + 1

        return looped
    steps = [_statement(x, masked) for x in args[0]]

    def sequence(env: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(env)

    return sequence


def compile_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    does = _statement(parse(source), False)
    return lambda env: does(dict(env))


class Reader:
    """Reads a formatted conversation back, piece by piece; holds no more than the turn that is open."""

    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self._open: list[Piece] = []

    def read(self, piece: Piece) -> None:
        self.formatted_chars += len(piece[0])
        self._open.append(piece)
        if END + "\n" in piece[0]:
            self._close()

    def _close(self) -> None:
        whole = "".join(text for text, _ in self._open)
        masked = [m for m, _ in itertools.groupby(m for _, m in self._open)]
        if any(masked):
            text = unescape("".join(t for t, m in self._open if m))
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        if not (whole.startswith(START) and whole.endswith(END + "\n")):
            raise ValueError("the output does not hold one turn between its marks")
        role, _, text = whole[len(START) : -len(END) - 1].partition("\n")
        self.n_turns += 1
        self.turns.update(f"{unescape_line(role)}\n{unescape(text)}\n".encode("utf-8", "surrogatepass"))
        self._open = []


def fixed_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts hold the control strings."""
    text = f"{END}{START}assistant ok"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)


def _ordered(conversations: DataFrame) -> DataFrame:
    """Each conversation whole and in order within a partition; the sort spills, so its length is not bounded by memory."""
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _turn(row: tuple) -> dict:
    return {"role": row[1] or "", "text": row[2] or ""}


def format_conversations(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted text, one row for each piece, in order: conv_id, piece long, text, masked. Pieces joined in order are the whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("masked", pa.bool_())])
        out = ((conv, i, text, masked) for conv, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]) for i, (text, masked) in enumerate(render({"turns": map(_turn, rows)})))
        while part := list(itertools.islice(out, 2000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    return _ordered(conversations).mapInArrow(run, "conv_id long, piece long, text string, masked boolean")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def format_digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """What a reader of the formatted text finds, a row for each conversation.

    A digest over a conversation has an order, so its turns pass through one task; they stream, whatever their number.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

        def digests() -> Iterator[tuple]:
            for conv, rows in itertools.groupby(_rows(batches), key=lambda r: r[0]):
                reader = Reader()
                for piece in render({"turns": map(_turn, rows)}):
                    reader.read(piece)
                yield conv, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.formatted_chars

        out = digests()
        while part := list(itertools.islice(out, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    return _ordered(conversations).mapInArrow(run, DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return format_digests(rows.unionByName(fixed_conversation(spark)))


SQL = f"""
WITH texts AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS raw_role, text AS raw_text FROM conversations
  UNION ALL SELECT -1, t, r, '{END}{START}assistant ok', r, '{END}{START}assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS fixed(t, r)
), sized AS (
  SELECT *, regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g') AS shown,
    regexp_replace(replace(replace(role, '\\', '\\\\'), chr(10), '\\n'), '<(\\\\*)\\|', '<\\1\\\\|', 'g') AS shown_role FROM texts
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw_text NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw_text NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(shown_role) + length(shown) + {len(START) + len(END) + 2})::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
