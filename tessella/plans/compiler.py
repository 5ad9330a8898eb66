"""Syntax trees to DataFrames.

Expressions follow SQLite where it and Spark differ: integer division
truncates, division and remainder by zero give null, LIKE ignores ASCII case
and has no escape, and truth values count as 0 and 1 beside numbers. Constants
are bound as literals, never spliced into text. Everything stays built-in
expressions, so Catalyst sees, pushes and prunes the whole statement.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.errors import InvalidQuery, TypeMismatch, Unsupported
from tessella.plans.syntax import (
    Aggregate, Between, Binary, Case, Ident, In, IsNull, IsTruth, Item, Like, Literal, Name, Node, Order, Param, Select, Star, Unary, has_aggregate,
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INT64 = 1 << 63
NUMERIC = ("int", "float", "bool")


def kind_of(spark_type: str) -> str:
    if spark_type in ("bigint", "int", "smallint", "tinyint"):
        return "int"
    if spark_type in ("double", "float") or spark_type.startswith("decimal"):
        return "float"
    return {"string": "text", "boolean": "bool", "binary": "binary", "date": "time", "timestamp": "time", "timestamp_ntz": "time", "void": "null"}.get(spark_type, "other")


@dataclass(frozen=True)
class Typed:
    column: Column
    kind: str


def as_number(x: Typed) -> Typed:
    if x.kind in ("int", "float", "null"):
        return x
    if x.kind == "bool":
        return Typed(x.column.cast("bigint"), "int")
    if x.kind == "text":
        return Typed(F.coalesce(x.column.try_cast("double"), F.when(x.column.isNotNull(), F.lit(0.0))), "float")
    raise TypeMismatch("a value cannot count as a number")


def as_truth(x: Typed) -> Column:
    if x.kind == "bool":
        return x.column
    if x.kind == "null":
        return F.lit(None).cast("boolean")
    return as_number(x).column != 0


def as_text(x: Typed) -> Column:
    return x.column if x.kind == "text" else x.column.cast("bigint").cast("string") if x.kind == "bool" else x.column.cast("string")


def literal(value) -> Typed:
    if value is None:
        return Typed(F.lit(None), "null")
    if isinstance(value, bool):
        return Typed(F.lit(value), "bool")
    if isinstance(value, int):
        return Typed(F.lit(value).cast("bigint"), "int") if -INT64 <= value < INT64 else Typed(F.lit(float(value)), "float")
    if isinstance(value, float):
        return Typed(F.lit(value), "float")
    if isinstance(value, str):
        return Typed(F.lit(value), "text")
    return Typed(F.lit(bytes(value)), "binary")


def common(xs: list[Typed]) -> tuple[list[Column], str]:
    """Columns of one kind that hold all values of xs."""
    kinds = {x.kind for x in xs} - {"null"}
    if len(kinds) <= 1:
        return [x.column for x in xs], next(iter(kinds), "null")
    if kinds <= {"int", "bool"}:
        return [as_number(x).column for x in xs], "int"
    if kinds <= set(NUMERIC):
        return [as_number(x).column.cast("double") for x in xs], "float"
    if "binary" in kinds or "other" in kinds:
        raise TypeMismatch("branches are of kinds that do not mix")
    return [as_text(x) for x in xs], "text"


def compare(op: str, a: Typed, b: Typed) -> Column:
    if a.kind == "null" or b.kind == "null":
        return F.lit(None).cast("boolean")
    kinds = {a.kind, b.kind}
    if len(kinds) > 1 and kinds <= {*NUMERIC, "text"}:
        a, b = as_number(a), as_number(b)
    elif "time" in kinds and len(kinds) > 1:
        if kinds != {"time", "text"}:
            raise TypeMismatch("a time is compared with a value of another kind")
    elif len(kinds) > 1:
        raise TypeMismatch("values of kinds that do not compare")
    x, y = a.column, b.column
    return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def arithmetic(op: str, a: Typed, b: Typed) -> Typed:
    a, b = as_number(a), as_number(b)
    if "null" in (a.kind, b.kind):
        return Typed(F.lit(None), "null")
    x, y = a.column, b.column
    whole = a.kind == b.kind == "int"
    kind = "int" if whole else "float"
    if op in "+-*":
        return Typed({"+": x + y, "-": x - y, "*": x * y}[op], kind)
    if op == "/":
        if whole:
            # the result of the least integer by -1 is no 64-bit integer
            return Typed(F.when(y != 0, F.call_function("div", x.cast("bigint"), F.when(y != 0, y).cast("bigint"))), kind)
        return Typed(F.try_divide(x.cast("double"), y.cast("double")), kind)
    rest = F.try_mod(x.cast("bigint"), y.cast("bigint"))
    return Typed(rest if whole else rest.cast("double"), kind)


def like(x: Typed, pattern: Typed) -> Column:
    return F.like(fold_ascii(as_text(x)), F.replace(fold_ascii(as_text(pattern)), F.lit("\\"), F.lit("\\\\")))


def fold_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


@dataclass
class Scope:
    """What names mean: columns by name, and trees that are computed already."""

    columns: dict[str, Typed]
    params: list
    table: Ident | None = None
    alias: Ident | None = None
    known: dict[Node, Typed] = field(default_factory=dict)

    def owns(self, prefix: Ident | None) -> bool:
        return prefix is None or (self.alias or self.table) is not None and prefix.names((self.alias or self.table).folded() if not (self.alias or self.table).quoted else (self.alias or self.table).text)

    def find(self, name: Name) -> str | None:
        if not self.owns(name.table):
            return None
        return next((c for c in self.columns if name.column.names(c)), None)

    def of(self, x: Node) -> Typed:
        if x in self.known:
            return self.known[x]
        if isinstance(x, Literal):
            return literal(x.value)
        if isinstance(x, Param):
            return literal(self.params[x.index - 1])
        if isinstance(x, Name):
            found = self.find(x)
            if found is None:
                raise InvalidQuery("a column is not known")
            return self.columns[found]
        if isinstance(x, Unary):
            if x.op == "not":
                return Typed(~as_truth(self.of(x.x)), "bool")
            inner = as_number(self.of(x.x))
            return inner if x.op == "+" or inner.kind == "null" else Typed(-inner.column, inner.kind)
        if isinstance(x, Binary):
            if x.op in ("and", "or"):
                a, b = as_truth(self.of(x.a)), as_truth(self.of(x.b))
                return Typed(a & b if x.op == "and" else a | b, "bool")
            a, b = self.of(x.a), self.of(x.b)
            return arithmetic(x.op, a, b) if x.op in "+-*/%" else Typed(compare(x.op, a, b), "bool")
        if isinstance(x, IsNull):
            c = self.of(x.x).column
            return Typed(c.isNotNull() if x.negated else c.isNull(), "bool")
        if isinstance(x, IsTruth):
            truth = as_truth(self.of(x.x))
            held = F.coalesce(truth if x.truth else ~truth, F.lit(False))
            return Typed(~held if x.negated else held, "bool")
        if isinstance(x, Between):
            v = self.of(x.x)
            held = compare(">=", v, self.of(x.low)) & compare("<=", v, self.of(x.high))
            return Typed(~held if x.negated else held, "bool")
        if isinstance(x, In):
            held = self.member(self.of(x.x), [self.of(i) for i in x.items])
            return Typed(~held if x.negated else held, "bool")
        if isinstance(x, Like):
            held = like(self.of(x.x), self.of(x.pattern))
            return Typed(~held if x.negated else held, "bool")
        if isinstance(x, Case):
            return self.case(x)
        if isinstance(x, Aggregate):
            raise InvalidQuery("an aggregate stands where none can")
        raise Unsupported("an expression is outside the accepted subset")

    def member(self, v: Typed, items: list[Typed]) -> Column:
        plain = [i for i in items if i.kind == v.kind]
        held = v.column.isin(*[i.column for i in plain]) if plain else F.lit(False)
        for i in items:
            if i.kind != v.kind:
                held = held | compare("=", v, i)
        return held

    def case(self, x: Case) -> Typed:
        if x.operand is None:
            tests = [as_truth(self.of(c)) for c, _ in x.whens]
        else:
            v = self.of(x.operand)
            tests = [compare("=", v, self.of(c)) for c, _ in x.whens]
        results = [self.of(r) for _, r in x.whens] + ([self.of(x.otherwise)] if x.otherwise is not None else [])
        columns, kind = common(results)
        out = F
        for t, c in zip(tests, columns):
            out = out.when(t, c)
        return Typed(out.otherwise(columns[-1]) if x.otherwise is not None else out, kind)

    def aggregate(self, x: Aggregate) -> Typed:
        if x.argument is None:
            return Typed(F.count(F.lit(1)), "int")
        v = self.of(x.argument)
        if x.function == "count":
            return Typed(F.count_distinct(v.column) if x.distinct else F.count(v.column), "int")
        if x.function in ("min", "max"):
            if v.kind == "bool":
                v = as_number(v)
            return Typed((F.min if x.function == "min" else F.max)(v.column), v.kind)
        v = as_number(v)
        if v.kind == "null":
            return Typed(F.max(F.lit(None).cast("double")), "float")
        if x.function == "sum":
            return Typed(F.sum_distinct(v.column) if x.distinct else F.sum(v.column), v.kind)
        number = v.column.cast("double")
        return Typed(F.call_function("avg", number) if not x.distinct else F.sum_distinct(number) / F.count_distinct(number), "float")


def scope(df: DataFrame, names: list[str], params: list, table: Ident | None = None, alias: Ident | None = None) -> Scope:
    kinds = dict(df.dtypes)
    return Scope({n: Typed(F.col(f"`{n}`"), kind_of(kinds[n])) for n in names}, params, table, alias)


def _display(item: Item) -> str:
    if item.alias is not None:
        return item.alias.text
    return item.expression.column.text if isinstance(item.expression, Name) else item.text


def _bound(x: Node | None, params: list) -> int | None:
    """A limit or offset; a negative one is none."""
    if x is None:
        return None
    value = x.value if isinstance(x, Literal) else params[x.index - 1]
    if type(value) is not int:
        raise TypeMismatch("LIMIT and OFFSET take integers")
    return value if value >= 0 else None


def select(statement: Select, df: DataFrame | None, names: list[str], params: list, spark) -> DataFrame:
    """The statement over the rows of df, whose visible columns are names."""
    if df is None:
        df = spark.range(1)
    at = scope(df, names, params, statement.table.name if statement.table else None, statement.table.alias if statement.table else None)
    items: list[Item] = []
    for i in statement.items:
        if isinstance(i, Star):
            if not at.owns(i.table):
                raise InvalidQuery("a star's table is not known")
            items += [Item(Name(Ident(n, True)), Ident(n, True)) for n in names]
        else:
            items.append(i)
    # an alias may be referred to where it hides no column
    aliases = {i.alias.folded(): i.expression for i in items if i.alias is not None}

    def meant(x: Node, ordinals: bool) -> Node:
        if ordinals and isinstance(x, Literal) and type(x.value) is int:
            if not 1 <= x.value <= len(items):
                raise InvalidQuery("an ordinal is out of range")
            return items[x.value - 1].expression
        if isinstance(x, Name) and x.table is None and x.column.folded() in aliases and (ordinals == "order" or at.find(x) is None):
            return aliases[x.column.folded()]
        return x

    def with_aliases(x: Node) -> Node:
        return rewritten(x, lambda n: meant(n, False) if isinstance(n, Name) else n)

    if statement.where is not None:
        df = df.where(as_truth(at.of(statement.where)))
    group = [meant(g, True) for g in statement.group]
    if any(has_aggregate(g) for g in group):
        raise InvalidQuery("a group cannot be an aggregate")
    order = [Order(with_aliases(meant(o.expression, "order")), o.descending) for o in statement.order]
    having = with_aliases(statement.having) if statement.having is not None else None
    trees = [i.expression for i in items] + [o.expression for o in order] + ([having] if having is not None else [])
    if group or having is not None or any(map(has_aggregate, trees)):
        df, at = grouped(df, at, group, trees)
        if having is not None:
            df = df.where(as_truth(at.of(having)))
    shown = [at.of(i.expression).column.alias(f"c{k}") for k, i in enumerate(items)]
    same = {i.expression: k for k, i in reversed(list(enumerate(items)))}
    if statement.distinct:
        if any(o.expression not in same for o in order):
            raise Unsupported("the order of distinct rows takes selected columns only")
        df = df.select(*shown).distinct()
        keys = [(F.col(f"c{same[o.expression]}"), o.descending) for o in order]
    else:
        hidden = [at.of(o.expression).column.alias(f"o{k}") for k, o in enumerate(order)]
        df = df.select(*shown, *hidden)
        keys = [(F.col(f"o{k}"), o.descending) for k, o in enumerate(order)]
    if keys:
        df = df.orderBy(*[c.desc_nulls_last() if down else c.asc_nulls_first() for c, down in keys])
    limit, offset = _bound(statement.limit, params), _bound(statement.offset, params)
    if offset:
        df = df.offset(offset)
    if limit is not None:
        df = df.limit(limit)
    return df.select(*[F.col(f"c{k}") for k in range(len(items))]).toDF(*map(_display, items))


def grouped(df: DataFrame, at: Scope, group: list[Node], trees: list[Node]) -> tuple[DataFrame, Scope]:
    """df after partial and final aggregation, and the scope in which trees can be read from it."""
    aggregates = list(dict.fromkeys(n for t in trees for n in t.walk() if isinstance(n, Aggregate)))
    keys = [at.of(g) for g in group]
    bare: list[Name] = []

    def visit(x: Node) -> None:
        if x in group or isinstance(x, Aggregate):
            return
        if isinstance(x, Name) and at.find(x) is not None and not any(isinstance(g, Name) and at.find(g) == at.find(x) for g in group):
            bare.append(x)
        for c in x.children():
            visit(c)

    for t in trees:
        visit(t)
    extremes = [a for a in aggregates if a.function in ("min", "max")]
    out = [at.aggregate(a) for a in aggregates]
    columns = [o.column.alias(f"a{k}") for k, o in enumerate(out)]
    bare = list(dict.fromkeys(bare))
    for k, b in enumerate(bare):
        v = at.of(b).column
        if len(extremes) == 1:
            # beside one MIN or MAX, bare columns come from the row that has it
            pick = F.min_by if extremes[0].function == "min" else F.max_by
            by = at.of(extremes[0].argument).column
            columns.append(F.when(F.count(by) > 0, pick(v, by)).otherwise(F.any_value(v)).alias(f"b{k}"))
        else:
            columns.append(F.any_value(v).alias(f"b{k}"))
    keyed = df.groupBy(*[g.column.alias(f"g{k}") for k, g in enumerate(keys)])
    df = keyed.agg(*columns) if columns else keyed.agg(F.count(F.lit(1)).alias("n")).drop("n")
    known = {g: Typed(F.col(f"g{k}"), keys[k].kind) for k, g in enumerate(group)}
    for t in trees:
        for n in t.walk():
            if isinstance(n, Name) and n not in known:
                for k, g in enumerate(group):
                    if isinstance(g, Name) and at.find(g) is not None and at.find(g) == at.find(n):
                        known[n] = Typed(F.col(f"g{k}"), keys[k].kind)
    known |= {a: Typed(F.col(f"a{k}"), out[k].kind) for k, a in enumerate(aggregates)}
    known |= {b: Typed(F.col(f"b{k}"), at.of(b).kind) for k, b in enumerate(bare)}
    return df, Scope({}, at.params, at.table, at.alias, known)


def rewritten(x: Node, change) -> Node:
    """The tree with change applied to every node, leaves first."""
    from dataclasses import fields, replace

    def each(v):
        if isinstance(v, Node):
            return rewritten(v, change)
        return tuple(each(y) for y in v) if isinstance(v, tuple) else v

    return change(replace(x, **{f.name: each(getattr(x, f.name)) for f in fields(x) if f.init}))


def row_local(statement: Select) -> bool:
    """Can the statement be answered shard by shard, rows one by one?"""
    if statement.distinct or statement.group or statement.having is not None or statement.order or statement.limit is not None or statement.offset is not None:
        return False
    return not any(has_aggregate(i) for i in statement.items)
