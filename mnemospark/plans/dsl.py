"""The schema language and its trigger conditions.

    namespace ns
    entity_type Person { name: text, age: number }
    kind Habit { cardinality: set, temporal: state }
    predicate works_at { kind: Fact, stateful: true, subject: Person }
    relation_type knows { from: Person, to: Person, symmetric: true, cardinality: many_to_many }
    extractor names { pattern: /[A-Z][a-z]+/, target: Person, when: salience >= 0.2 }

``parse`` gives a ``Schema``; ``validate`` lists what is wrong with one;
``condition`` compiles a trigger condition to a Column.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DECLARATIONS = ("entity_type", "kind", "predicate", "relation_type", "extractor")
CARDINALITIES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")
BUILTIN_KINDS = ("Attribute", "Directive", "Relation", "Preference", "Event", "Fact")
ATTRIBUTE_TYPES = ("text", "number", "bool", "date", "timestamp", "enum", "ref")


class DslError(ValueError):
    """Text that is not in the language."""


_TOKEN = re.compile(r'\s+|#[^\n]*|(?P<str>"(?:[^"\\]|\\.)*")|(?P<re>/(?:[^/\\\n]|\\.)+/)|(?P<num>-?\d+(?:\.\d+)?)|(?P<id>[A-Za-z_][\w.]*)|(?P<op>>=|<=|!=|==|=|>|<|[()\[\]{},:;])')


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise DslError(f"unexpected {text[at : at + 12]!r} at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None, kind: str | None = None) -> str:
        k, v = self.peek()
        if k == "end" or (value is not None and v != value) or (kind is not None and k != kind):
            raise DslError(f"expected {value or kind}, found {v or 'the end'}")
        self.at += 1
        return v

    def accept(self, value: str) -> bool:
        if self.peek()[1] == value and self.peek()[0] in ("id", "op"):
            self.at += 1
            return True
        return False


# --- conditions -----------------------------------------------------------------
def _literal(r: _Reader):
    kind, value = r.peek()
    r.at += 1
    if kind == "str":
        return re.sub(r"\\(.)", r"\1", value[1:-1])
    if kind == "num":
        return float(value) if "." in value else int(value)
    if kind == "id" and value in ("true", "false"):
        return value == "true"
    raise DslError(f"expected a value, found {value or 'the end'}")


def _comparison(r: _Reader) -> Column:
    if r.accept("("):
        inner = _either(r)
        r.take(")")
        return inner
    if r.accept("not"):
        return ~_comparison(r)
    name = F.col(r.take(kind="id"))
    if r.accept("matches"):
        return name.rlike(r.take(kind="re")[1:-1].replace("\\/", "/"))
    if r.accept("in"):
        r.take("[")
        values = [_literal(r)]
        while r.accept(","):
            values.append(_literal(r))
        r.take("]")
        return name.isin(*values)
    op, value = r.take(kind="op"), None
    value = _literal(r)
    compare = {"=": name.__eq__, "==": name.__eq__, "!=": name.__ne__, ">": name.__gt__, ">=": name.__ge__, "<": name.__lt__, "<=": name.__le__}
    if op not in compare:
        raise DslError(f"{op} does not compare")
    return compare[op](value)


def _both(r: _Reader) -> Column:
    left = _comparison(r)
    while r.accept("and"):
        left = left & _comparison(r)
    return left


def _either(r: _Reader) -> Column:
    left = _both(r)
    while r.accept("or"):
        left = left | _both(r)
    return left


def condition(text: str) -> Column:
    """``field op value``, ``matches /re/``, ``in [..]``, and, or, not, parentheses."""
    r = _Reader(text)
    out = _either(r)
    if r.peek()[0] != "end":
        raise DslError(f"unexpected {r.peek()[1]}")
    return out


# --- schemas --------------------------------------------------------------------
@dataclass
class Schema:
    namespace: str = ""
    uses: list[str] = field(default_factory=list)
    declared: dict[str, dict[str, dict]] = field(default_factory=lambda: {d: {} for d in DECLARATIONS})

    def dictionary(self, spark: SparkSession, what: str) -> DataFrame:
        """id, namespace, name of one kind of declaration, in order of declaration."""
        rows = [(i, self.namespace, name) for i, name in enumerate(self.declared[what], 1)]
        return spark.createDataFrame(rows, "id int, namespace string, name string")


def _value(r: _Reader):
    if r.peek()[0] == "re":
        return r.take()[1:-1]
    if r.accept("["):
        out = []
        while not r.accept("]"):
            out.append(_value(r))
            r.accept(",")
        return out
    if r.peek()[0] in ("str", "num") or r.peek()[1] in ("true", "false"):
        return _literal(r)
    name = r.take(kind="id")
    if r.accept("<"):
        name = (name, r.take(kind="id"))
        r.take(">")
    elif r.peek() == ("op", "["):
        name = (name, _value(r))
    return name


def parse(text: str) -> Schema:
    r, out = _Reader(text), Schema()
    while r.peek()[0] != "end":
        word = r.take(kind="id")
        if word == "namespace":
            out.namespace = r.take(kind="id")
        elif word == "use":
            out.uses.append(r.take(kind="id"))
        elif word in DECLARATIONS:
            name = r.take(kind="id")
            if name in out.declared[word]:
                raise DslError(f"{word} {name} is declared twice")
            body: dict = {}
            if r.accept("{"):
                while not r.accept("}"):
                    key = r.take(kind="id")
                    r.take(":")
                    if key == "when":
                        start = r.at
                        _either(r) if SparkSession.getActiveSession() else _skip(r)
                        body[key] = " ".join(v for _, v in r.tokens[start : r.at])
                    else:
                        body[key] = _value(r)
                    r.accept(",") or r.accept(";")
            out.declared[word][name] = body
        else:
            raise DslError(f"unexpected {word}")
        r.accept(";")
    return out


def _skip(r: _Reader) -> None:
    depth = 0
    while r.peek()[0] != "end":
        v = r.peek()[1]
        if depth == 0 and v in (",", ";", "}"):
            return
        depth += (v in "([") - (v in ")]") if len(v) == 1 else 0
        r.at += 1


def validate(schema: Schema) -> list[str]:
    """What is wrong, as ``code: name`` lines; empty for a good schema."""
    d, wrong = schema.declared, []
    types, kinds = set(d["entity_type"]), set(BUILTIN_KINDS) | set(d["kind"])
    if not schema.namespace:
        wrong.append("missing_namespace: schema")
    for name, body in d["entity_type"].items():
        for attr, kind in body.items():
            base = kind[0] if isinstance(kind, tuple) else kind
            if base not in ATTRIBUTE_TYPES:
                wrong.append(f"unknown_attribute_type: {name}.{attr}")
            if base == "ref" and (not isinstance(kind, tuple) or kind[1] not in types):
                wrong.append(f"unknown_ref: {name}.{attr}")
            if base == "enum" and not (isinstance(kind, tuple) and kind[1]):
                wrong.append(f"empty_enum: {name}.{attr}")
    for name in d["kind"]:
        if name in BUILTIN_KINDS:
            wrong.append(f"reserved_kind: {name}")
    for name, body in d["predicate"].items():
        if body.get("kind", "Fact") not in kinds:
            wrong.append(f"unknown_kind: {name}")
        if body.get("subject") and body["subject"] not in types:
            wrong.append(f"unknown_entity_type: {name}")
        if body.get("stateful") is True and body.get("kind") == "Event":
            wrong.append(f"stateful_event: {name}")
    for name, body in d["relation_type"].items():
        for end in ("from", "to"):
            if body.get(end) and body[end] not in types:
                wrong.append(f"unknown_entity_type: {name}.{end}")
        if body.get("cardinality", "many_to_many") not in CARDINALITIES:
            wrong.append(f"unknown_cardinality: {name}")
        if body.get("symmetric") is True and body.get("from") != body.get("to"):
            wrong.append(f"asymmetric_ends: {name}")
    for name, body in d["extractor"].items():
        if "pattern" not in body:
            wrong.append(f"missing_pattern: {name}")
        else:
            try:
                re.compile(body["pattern"])
            except re.error:
                wrong.append(f"bad_pattern: {name}")
    return wrong


def outside_vocabulary(statements: DataFrame, predicates: DataFrame) -> DataFrame:
    """Statements whose predicate (name) the active schema does not declare."""
    return statements.join(predicates.select(F.col("name").alias("predicate")), "predicate", "left_anti")


def extract(memories: DataFrame, schema: Schema) -> DataFrame:
    """memory_id, extractor, target, surface: every match of the schema's patterns (group 1, else the match)."""
    out = None
    for name, body in schema.declared["extractor"].items():
        rows = memories.where(condition(body["when"])) if body.get("when") else memories
        group = 1 if re.compile(body["pattern"]).groups else 0
        found = rows.select("memory_id", F.lit(name).alias("extractor"), F.lit(body.get("target")).cast("string").alias("target"), F.explode(F.regexp_extract_all("text", F.lit(body["pattern"]), F.lit(group))).alias("surface"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise DslError("the schema declares no extractor")
    return out
