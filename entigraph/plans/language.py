"""The method-chain query language: ``Entity.findMany().where(a == 1 && b like "x%").include(p).orderBy(f.desc).limit(n)``."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from typing import Any

from entigraph.plans import ir

_TOKEN = re.compile(
    r"\s+|(?P<float>-?\d+\.\d+(?:[eE][+-]?\d+)?)|(?P<int>-?\d+)|(?P<name>[A-Za-z_]\w*)"
    r"|(?P<string>\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')|(?P<sign>==|!=|<=|>=|&&|\|\||[<>.,:(){}\[\]])"
)
_OPS = {"==": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
_READS = ("findMany", "findUnique", "findFirst", "count")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class LanguageError(ValueError):
    """An error at a place of the source; its text shows the place with a caret."""

    def __init__(self, message: str, source: str, at: int) -> None:
        line_start = source.rfind("\n", 0, at) + 1
        line = source[line_start:].split("\n", 1)[0]
        super().__init__(f"{message} at offset {at}\n{line}\n{' ' * (at - line_start)}^")
        self.at = at


@dataclass(frozen=True)
class Token:
    kind: str
    value: Any
    at: int
    end: int


@dataclass(frozen=True)
class Statement:
    """``kind``: a read, create, update, delete, upsert, or a dot command; ``data``: assigned values; ``argument``: of a command."""

    kind: str
    query: ir.GraphQuery | None = None
    data: tuple[tuple[str, Any], ...] = ()
    argument: str | None = None


def tokens(source: str) -> list[Token]:
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m is None:
            raise LanguageError(f"unexpected character {source[at]!r}", source, at)
        kind, text = m.lastgroup, m[0]
        if kind == "string":
            value: Any = re.sub(r"\\([\s\S])", lambda e: _ESCAPES.get(e[1], e[1] if e[1] in "\"'\\" else e[0]), text[1:-1])
        else:
            value = float(text) if kind == "float" else int(text) if kind == "int" else text
        if kind:
            out.append(Token(kind, value, at, m.end()))
        at = m.end()
    out.append(Token("end", None, at, at))
    return out


class _Parser:
    def __init__(self, source: str) -> None:
        self.source, self.tokens, self.k = source, tokens(source), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.k]

    def fail(self, message: str) -> LanguageError:
        return LanguageError(message, self.source, self.now.at)

    def accept(self, value: str) -> bool:
        if self.now.kind in ("sign", "name") and self.now.value == value:
            self.k += 1
            return True
        return False

    def expect(self, value: str) -> None:
        if not self.accept(value):
            raise self.fail(f"expected {value!r}")

    def name(self) -> str:
        if self.now.kind != "name":
            raise self.fail("expected a name")
        self.k += 1
        return self.tokens[self.k - 1].value

    def number(self) -> int:
        if self.now.kind != "int" or self.now.value < 0:
            raise self.fail("expected a number of at least 0")
        self.k += 1
        return self.tokens[self.k - 1].value

    def literal(self) -> Any:
        t = self.now
        if t.kind in ("string", "int", "float"):
            self.k += 1
            return t.value
        if t.kind == "name" and t.value in ("true", "false", "null"):
            self.k += 1
            return {"true": True, "false": False, "null": None}[t.value]
        raise self.fail("expected a literal")

    def statement(self) -> Statement:
        if self.accept("."):
            command = self.name()
            if command not in ("schema", "describe", "help"):
                raise self.fail(f"unknown command .{command}")
            argument = self.name() if self.now.kind == "name" else None
            made = Statement(f".{command}", argument=argument)
        else:
            entity = self.name()
            self.expect(".")
            verb = self.name()
            if verb in _READS:
                made = self.read(entity, verb)
            elif verb == "create":
                self.expect("(")
                made = Statement("create", ir.GraphQuery(entity), self.object())
                self.expect(")")
            elif verb in ("update", "delete", "upsert"):
                made = self.mutation(entity, verb)
            else:
                raise self.fail(f"unknown operation {verb!r}")
        if self.now.kind != "end":
            raise self.fail("unexpected input after the statement")
        return made

    def read(self, entity: str, verb: str) -> Statement:
        self.expect("(")
        self.expect(")")
        query = ir.GraphQuery(entity)
        while self.accept("."):
            clause = self.name()
            self.expect("(")
            if clause == "where":
                query = _also(query, self.either())
            elif clause == "include":
                path = [self.name()]
                while self.accept("."):
                    path.append(self.name())
                query = replace(query, includes=(*query.includes, ir.Include(".".join(path))))
            elif clause == "orderBy":
                field, descending = self.name(), False
                if self.accept("."):
                    way = self.name()
                    if way not in ("asc", "desc"):
                        raise self.fail("expected asc or desc")
                    descending = way == "desc"
                query = replace(query, order=(*query.order, ir.Order(field, descending)))
            elif clause in ("limit", "offset"):
                query = replace(query, **{clause: self.number()})
            else:
                raise self.fail(f"unknown clause {clause!r}")
            self.expect(")")
        if verb == "findUnique" and query.where is None:
            raise self.fail("findUnique needs a where clause")
        return Statement(verb, query)

    def mutation(self, entity: str, verb: str) -> Statement:
        self.expect("(")
        self.expect(")")
        query, data = ir.GraphQuery(entity), ()
        while self.accept("."):
            clause = self.name()
            self.expect("(")
            if clause == "where":
                query = _also(query, self.either())
            elif clause == "set" and verb != "delete":
                data += self.object()
            else:
                raise self.fail(f"unknown clause {clause!r}")
            self.expect(")")
        return Statement(verb, query, data)

    def object(self) -> tuple[tuple[str, Any], ...]:
        self.expect("{")
        out = []
        while not self.accept("}"):
            if out:
                self.expect(",")
            key = self.name()
            self.expect(":")
            out.append((key, self.literal()))
        return tuple(out)

    def either(self) -> ir.Filter:
        parts = [self.both()]
        while self.accept("||"):
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else ir.Or(tuple(parts))

    def both(self) -> ir.Filter:
        parts = [self.primary()]
        while self.accept("&&"):
            parts.append(self.primary())
        return parts[0] if len(parts) == 1 else ir.And(tuple(parts))

    def primary(self) -> ir.Filter:
        if self.accept("("):  # an extension: conditions may be grouped
            inner = self.either()
            self.expect(")")
            return inner
        field = self.name()
        if self.now.kind == "sign" and self.now.value in _OPS:
            op = _OPS[self.now.value]
            self.k += 1
            return ir.Compare(field, op, self.literal())
        if self.accept("is"):
            negated = self.accept("not")
            self.expect("null")
            return ir.Null(field, negated)
        negated = self.accept("not")
        if self.accept("in"):
            self.expect("[")
            values = []
            while not self.accept("]"):
                if values:
                    self.expect(",")
                values.append(self.literal())
            return ir.In(field, tuple(values), negated)
        if self.accept("like"):
            if self.now.kind != "string":
                raise self.fail("expected a pattern")
            return ir.Like(field, self.literal(), negated)
        raise self.fail("expected a condition")


def _also(query: ir.GraphQuery, condition: ir.Filter) -> ir.GraphQuery:
    return replace(query, where=condition if query.where is None else ir.And((query.where, condition)))


def parse(source: str) -> Statement:
    return _Parser(source).statement()


HELP = "Entity.findMany() | findUnique() | findFirst() | count() with .where .include .orderBy .limit .offset; create({..}); update() | delete() | upsert() with .where .set; .schema [Entity], .describe Relation, .help"


def run(engine: Any, source: str, context: Any = None) -> Any:
    """A graph result for reads, a one-row DataFrame for counts, text for commands, the statement for mutations."""
    statement = parse(source)
    if statement.kind == "findMany":
        return engine.execute(statement.query, context)
    if statement.kind == "findFirst":
        return engine.execute(replace(statement.query, limit=1), context)
    if statement.kind == "findUnique":
        found = engine.execute(replace(statement.query, limit=2), context)
        if found.root.count() > 1:  # at most two rows
            raise ValueError("findUnique matches more than one row")
        return found
    if statement.kind == "count":
        return engine.aggregate(ir.AggregateQuery(statement.query.root, (ir.Aggregate("count", alias="count"),), statement.query.where), context)
    if statement.kind == ".help":
        return HELP
    if statement.kind == ".schema":
        names = [statement.argument] if statement.argument else sorted(engine.schema.entities)
        return "\n".join(f"{n}({', '.join(f'{f.name} {f.type.scalar}' for f in engine.schema.entity(n).fields)})" for n in names)
    if statement.kind == ".describe":
        own = [r for (_, n), r in sorted(engine.schema.relations.items()) if n == statement.argument]
        return "\n".join(f"{r.from_entity}.{r.name}: {r.from_fields} -> {r.to_entity}{r.to_fields}, {r.cardinality}, on delete {r.on_delete}" for r in own)
    return statement
