"""A recursive-descent parser of the accepted subset.

What other engines accept but this one does not raises Unsupported; what no
one accepts raises InvalidQuery. Messages name the statement by its place.
"""

from __future__ import annotations

from tessella.errors import EngineError, InvalidQuery, LimitExceeded, NumericOutOfRange, Unsupported
from tessella.plans.lexer import Token, tokens
from tessella.plans.syntax import (
    AGGREGATES, Aggregate, Batch, Between, Binary, Case, ColumnDef, CreateIndex, CreateTable, Delete, Ident, In, Insert, IsNull, IsTruth, Item, Like, Literal, Name,
    Node, Order, Param, Select, Star, Statement, TableRef, Transaction, Unary, Update, has_aggregate,
)

MAX_STATEMENTS, MAX_NESTING, MAX_DEPTH, MAX_PARAMETERS = 256, 32, 128, 32_766
INT64 = 1 << 63

#: Words that cannot be an unquoted alias or column.
RESERVED = set(
    """ALL AND AS ASC BETWEEN BY CASE CHECK CREATE CROSS DEFAULT DELETE DESC DISTINCT ELSE END ESCAPE EXCEPT EXISTS FALSE FETCH FOR FROM FULL GROUP HAVING
    IN INDEX INNER INSERT INTERSECT INTO IS JOIN LATERAL LEFT LIKE LIMIT NATURAL NOT NULL OFFSET ON OR ORDER OUTER PRIMARY REFERENCES RETURNING RIGHT SELECT SET TABLE
    THEN TRUE UNION UNIQUE UPDATE USING VALUES WHEN WHERE WINDOW WITH QUALIFY""".split()
)
#: Statements and clauses that are known and refused.
FOREIGN = set(
    """ALTER ANALYZE ATTACH CALL COPY DETACH DO DROP EXPLAIN GRANT LOCK MERGE PRAGMA REINDEX RELEASE REPLACE REVOKE SAVEPOINT SET SHOW START TRUNCATE VACUUM VALUES WITH USE DESCRIBE
    TABLE LISTEN NOTIFY DECLARE OPEN CLOSE EXECUTE PREPARE DEALLOCATE RENAME COMMENT KILL FLUSH LOAD OPTIMIZE CHECKPOINT DISCARD RESET CLUSTER REFRESH""".split()
)
CLAUSES = set(
    """CROSS ESCAPE EXCEPT FETCH FILTER FOR FULL INNER INTERSECT INTO JOIN LATERAL LEFT NATURAL NULLS ON OUTER OVER PIVOT QUALIFY RETURNING RIGHT TABLESAMPLE UNION UNPIVOT USING WINDOW WITH
    COLLATE ISNULL NOTNULL GLOB REGEXP MATCH RLIKE ILIKE SIMILAR AT DIV MOD XOR OVERLAPS MINUS SELECT VALUES OF ANY SOME INTERPOLATE SORT DISTRIBUTE LOCK PROCEDURE PARTITION GENERATED CONFLICT
    ROWS GROUPS RANGE STRICT WITHOUT INHERITS TEMP TEMPORARY COMMENT AS ORDER LIMIT WHERE INCLUDE INDEXED SET DUPLICATE""".split()
)
FOREIGN_SYMBOLS = {"||", "->", "->>", "::", "<=>", "<<", ">>", "&", "|", "~", "^", "#", "@", "!~", "!~*", "~*", "[", "{"}
INTEGER_TYPES = {"INT", "INTEGER", "BIGINT", "SMALLINT", "TINYINT", "MEDIUMINT", "INT2", "INT4", "INT8", "BIGSERIAL", "SERIAL8"}


class _Parser:
    def __init__(self, source: str, dialect: str) -> None:
        self.source, self.dialect = source, dialect
        self.tokens, self.at = tokens(source, dialect), 0
        self.highest, self.nesting = 0, 0

    # -- tokens
    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def next(self) -> Token:
        t = self.now
        self.at += t.kind != "end"
        return t

    def word(self, *words: str) -> bool:
        """Takes the words if they follow in a row."""
        if all(self.peek(k).upper == w for k, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def symbol(self, s: str) -> bool:
        if self.now.kind == "symbol" and self.now.text == s:
            self.at += 1
            return True
        return False

    def need(self, *what: str) -> None:
        if not (self.word(*what) if what[0][0].isalpha() else self.symbol(what[0])):
            self.fail()

    def fail(self) -> None:
        t = self.now
        if t.kind == "word" and t.upper in CLAUSES | FOREIGN or t.kind == "symbol" and t.text in FOREIGN_SYMBOLS:
            raise Unsupported("it uses a construct outside the accepted subset")
        raise InvalidQuery("it is not well formed")

    def ident(self) -> Ident:
        t = self.now
        if t.kind == "ident":
            self.at += 1
            return Ident(t.text, True)
        if t.kind == "word" and t.upper not in RESERVED:
            self.at += 1
            return Ident(t.text)
        self.fail()

    # -- statements
    def batch(self) -> Batch:
        out = Batch(self.dialect, self.source)
        while True:
            while self.symbol(";"):
                pass
            if self.now.kind == "end":
                return out
            if len(out.statements) >= MAX_STATEMENTS:
                raise LimitExceeded(f"a source may have {MAX_STATEMENTS} statements")
            ordinal = len(out.statements) + 1
            try:
                self.highest = 0
                out.statements.append(self.statement())
                out.parameters.append(self.highest)
                if self.now.kind != "end" and not (self.now.kind == "symbol" and self.now.text == ";"):
                    self.fail()
            except EngineError as e:
                raise type(e)(f"statement {ordinal}: {e}") from None

    def statement(self) -> Statement:
        t = self.now.upper
        if t == "SELECT":
            return self.select()
        if t == "INSERT":
            return self.insert()
        if t == "UPDATE":
            return self.update()
        if t == "DELETE":
            return self.delete()
        if t == "CREATE":
            return self.create()
        if t in ("BEGIN", "COMMIT", "END", "ROLLBACK", "ABORT"):
            return self.transaction()
        if t in FOREIGN or self.now.text == "(":
            raise Unsupported("this kind of statement is outside the accepted subset")
        raise InvalidQuery("it is not a known statement")

    def transaction(self) -> Transaction:
        first = self.next().upper
        if first == "END":
            raise Unsupported("this form of transaction control is outside the accepted subset")
        if first == "BEGIN":
            if not (self.word("TRANSACTION") or self.word("WORK")) and self.now.kind == "word":
                raise Unsupported("transaction modes are outside the accepted subset")
            if self.now.kind == "word":
                raise Unsupported("transaction modes are outside the accepted subset")
            return Transaction("begin")
        if first == "ABORT" and self.dialect != "postgres":
            raise InvalidQuery("it is not a known statement")
        self.word("TRANSACTION") or self.word("WORK") or self.word("TRAN")
        if self.word("AND"):
            if not self.word("NO", "CHAIN"):
                raise Unsupported("chained transactions are outside the accepted subset")
        if self.now.kind == "word":
            raise Unsupported("savepoints are outside the accepted subset")
        return Transaction("commit" if first == "COMMIT" else "rollback")

    def table(self, alias: bool = True) -> TableRef:
        if self.now.text == "(" and self.now.kind == "symbol":
            raise Unsupported("derived tables are outside the accepted subset")
        name, other = self.ident(), None
        if self.now.text == "." or alias and self.now.text == "(":
            raise Unsupported("qualified tables and table functions are outside the accepted subset")
        if alias and (self.word("AS") or self.now.kind == "ident" or self.now.kind == "word" and self.now.upper not in RESERVED | CLAUSES):
            other = self.ident()
            if self.now.text == "(":
                raise Unsupported("column lists of aliases are outside the accepted subset")
        return TableRef(name, other)

    def select(self) -> Select:
        self.need("SELECT")
        distinct = False
        if self.word("DISTINCT"):
            distinct = True
            if self.now.upper == "ON":
                raise Unsupported("DISTINCT ON is outside the accepted subset")
        elif self.now.upper == "ALL":
            self.next()
        if self.now.upper == "TOP":
            raise Unsupported("TOP is outside the accepted subset")
        items = [self.item()]
        while self.symbol(","):
            items.append(self.item())
        table = where = having = limit = offset = None
        group: list[Node] = []
        order: list[Order] = []
        if self.word("FROM"):
            table = self.table()
            if self.now.text == "," and self.now.kind == "symbol":
                raise Unsupported("joins are outside the accepted subset")
        elif any(isinstance(i, Star) for i in items):
            raise InvalidQuery("a star needs a table")
        if self.word("WHERE"):
            where = self.scalar("WHERE")
        if self.word("GROUP", "BY"):
            if self.now.upper in ("ALL", "ROLLUP", "CUBE", "GROUPING"):
                raise Unsupported("grouping modifiers are outside the accepted subset")
            group = [self.scalar("GROUP BY")]
            while self.symbol(","):
                group.append(self.scalar("GROUP BY"))
            if self.now.upper in ("WITH", "ROLLUP", "CUBE"):
                raise Unsupported("grouping modifiers are outside the accepted subset")
        if self.word("HAVING"):
            having = self.expression()
        if self.word("ORDER", "BY"):
            if self.now.upper == "ALL":
                raise Unsupported("ORDER BY ALL is outside the accepted subset")
            order = [self.order()]
            while self.symbol(","):
                order.append(self.order())
        if self.word("LIMIT"):
            if self.now.upper == "ALL" and self.dialect == "postgres":
                self.next()
            else:
                limit = self.bound()
                if self.dialect != "postgres" and self.symbol(","):
                    limit, offset = self.bound(), limit
                    if self.now.upper == "OFFSET":
                        raise InvalidQuery("it has two offsets")
                elif self.word("OFFSET"):
                    offset = self.bound()
        elif self.now.upper in ("OFFSET", "FETCH"):
            raise Unsupported("OFFSET without LIMIT and FETCH are outside the accepted subset")
        if self.now.upper == "OFFSET":
            raise Unsupported("OFFSET without a limit is outside the accepted subset")
        return Select(tuple(items), table, where, tuple(group), having, tuple(order), limit, offset, distinct)

    def bound(self) -> Node:
        t = self.now
        if self.peek().kind == "symbol" and self.peek().text in ("+", "-", "*", "/", "%"):
            raise Unsupported("LIMIT and OFFSET take digits or a placeholder")
        if t.kind == "param":
            return self.param()
        if t.kind == "number" and t.text.isdigit():
            self.next()
            return Literal(int(t.text))
        if t.upper == "ALL" or t.kind in ("symbol", "word", "number", "string"):
            raise Unsupported("LIMIT and OFFSET take digits or a placeholder")
        self.fail()

    def item(self) -> Item | Star:
        if self.symbol("*"):
            return self.starred(Star())
        if self.now.kind in ("word", "ident") and self.peek().text == "." and self.peek(2).text == "*" and self.peek(2).kind == "symbol":
            name = self.ident()
            self.at += 2
            return self.starred(Star(name))
        first = self.now
        x = self.expression()
        text = self.source[first.at : self.tokens[self.at - 1].stop]
        alias = None
        if self.word("AS") or self.now.kind == "ident" or self.now.kind == "word" and self.now.upper not in RESERVED | CLAUSES:
            alias = self.ident()
        return Item(x, alias, text)

    def starred(self, star: Star) -> Star:
        if self.now.upper in ("EXCEPT", "EXCLUDE", "REPLACE", "RENAME", "ILIKE"):
            raise Unsupported("star modifiers are outside the accepted subset")
        return star

    def order(self) -> Order:
        x = self.expression()
        down = self.word("DESC")
        if not down:
            self.word("ASC")
        if self.now.upper in ("NULLS", "USING", "WITH"):
            raise Unsupported("the place of nulls cannot be chosen")
        return Order(x, down)

    def insert(self) -> Insert:
        self.need("INSERT")
        conflict = ""
        if self.word("OR"):
            if self.dialect != "sqlite":
                raise Unsupported("INSERT OR is outside the accepted subset of this dialect")
            conflict = self.next().upper.lower()
            if conflict not in ("abort", "fail", "ignore", "replace", "rollback"):
                raise InvalidQuery("it is not well formed")
        if not self.word("INTO"):
            raise Unsupported("INSERT modifiers are outside the accepted subset") if self.now.kind == "word" else InvalidQuery("it is not well formed")
        table = self.table(alias=False)
        if self.now.text != "(":
            if self.now.upper in ("VALUES", "SELECT", "DEFAULT", "AS"):
                raise Unsupported("INSERT needs its columns by name")
            self.fail()
        self.next()
        columns = [self.ident()]
        while self.symbol(","):
            columns.append(self.ident())
        self.need(")")
        if not self.word("VALUES"):
            if self.now.kind == "word" or self.now.text == "(":
                raise Unsupported("INSERT takes rows of values only")
            self.fail()
        rows = []
        while True:
            self.need("(")
            row = [self.value()]
            while self.symbol(","):
                row.append(self.value())
            self.need(")")
            if len(row) != len(columns):
                raise Unsupported("each row needs a value for each column")
            rows.append(tuple(row))
            if not self.symbol(","):
                break
        if self.now.upper in ("ON", "RETURNING"):
            raise Unsupported("upserts and RETURNING are outside the accepted subset")
        if len({c.folded() for c in columns}) < len(columns):
            raise Unsupported("a column is named twice")
        return Insert(table, tuple(columns), tuple(rows), conflict)

    def value(self) -> Node:
        if self.now.upper == "DEFAULT":
            raise Unsupported("DEFAULT as a value is outside the accepted subset")
        x = self.scalar("VALUES")
        if any(isinstance(n, Name) for n in x.walk()):
            raise Unsupported("inserted values cannot name columns")
        return x

    def update(self) -> Update:
        self.need("UPDATE")
        if self.now.upper == "OR" or self.dialect == "mysql" and self.now.upper in ("IGNORE", "LOW_PRIORITY"):
            raise Unsupported("UPDATE modifiers are outside the accepted subset")
        table = self.table()
        self.need("SET")
        sets = []
        while True:
            if self.now.text == "(":
                raise Unsupported("assignments of tuples are outside the accepted subset")
            column = self.ident()
            if self.now.text == ".":
                raise Unsupported("assigned columns cannot be qualified")
            self.need("=")
            sets.append((column, self.scalar("SET")))
            if not self.symbol(","):
                break
        if len({c.folded() for c, _ in sets}) < len(sets):
            raise Unsupported("a column is assigned twice")
        where = self.scalar("WHERE") if self.word("WHERE") else None
        if self.now.upper in ("FROM", "RETURNING", "ORDER", "LIMIT"):
            raise Unsupported("UPDATE takes SET and WHERE only")
        return Update(table, tuple(sets), where)

    def delete(self) -> Delete:
        self.need("DELETE")
        if not self.word("FROM"):
            raise Unsupported("DELETE takes FROM and WHERE only") if self.now.kind in ("word", "ident") else InvalidQuery("it is not well formed")
        table = self.table()
        if self.now.text == ",":
            raise Unsupported("DELETE takes one table")
        where = self.scalar("WHERE") if self.word("WHERE") else None
        if self.now.upper in ("USING", "RETURNING", "ORDER", "LIMIT"):
            raise Unsupported("DELETE takes FROM and WHERE only")
        return Delete(table, where)

    # -- schema
    def create(self) -> Statement:
        self.need("CREATE")
        unique = self.word("UNIQUE")
        if self.word("INDEX"):
            return self.create_index(unique)
        if unique or not self.word("TABLE"):
            raise Unsupported("this kind of CREATE is outside the accepted subset")
        again = self.word("IF", "NOT", "EXISTS")
        name = self.ident()
        if self.now.text == ".":
            raise Unsupported("qualified names are outside the accepted subset")
        if self.now.upper in ("AS", "LIKE", "CLONE", "PARTITION", "OF", "SELECT"):
            raise Unsupported("CREATE TABLE takes typed columns only")
        self.need("(")
        columns: list[ColumnDef] = []
        primary: tuple[Ident, ...] = ()
        uniques, checks = [], []
        while True:
            t = self.now.upper
            if t in ("CONSTRAINT", "FOREIGN", "EXCLUDE", "LIKE", "INDEX", "KEY", "FULLTEXT"):
                raise Unsupported("this table constraint is outside the accepted subset")
            if self.word("PRIMARY", "KEY"):
                if primary:
                    raise Unsupported("a table has one primary key")
                primary = self.plain_columns()
            elif self.word("UNIQUE"):
                uniques.append(self.plain_columns())
            elif self.word("CHECK"):
                self.need("(")
                checks.append(self.scalar("CHECK"))
                self.need(")")
            else:
                columns.append(self.column())
            if not self.symbol(","):
                break
        self.need(")")
        if self.now.kind not in ("end",) and self.now.text != ";":
            raise Unsupported("table options are outside the accepted subset")
        generated = [c for c in columns if c.generated]
        keyed = [c for c in columns if c.primary]
        if len(keyed) + bool(primary) > 1:
            raise Unsupported("a generated-key declaration or a primary key stands twice" if not generated else "the generated-key declaration is not in its accepted form")
        if generated and (len(generated) > 1 or not generated[0].primary):
            raise Unsupported("the generated-key declaration is not in its accepted form")
        if len({c.name.folded() for c in columns}) < len(columns):
            raise InvalidQuery("a column is declared twice")
        return CreateTable(name, tuple(columns), primary or tuple(c.name for c in keyed), tuple(uniques) + tuple((c.name,) for c in columns if c.unique), tuple(checks) + tuple(c.check for c in columns if c.check), again)

    def plain_columns(self) -> tuple[Ident, ...]:
        self.need("(")
        out = [self.ident()]
        while self.symbol(","):
            out.append(self.ident())
        if self.now.text != ")":
            raise Unsupported("keys take plain columns only")
        self.need(")")
        return tuple(out)

    def column(self) -> ColumnDef:
        name = self.ident()
        if self.now.kind != "word":
            raise Unsupported("columns need a type")
        kind = self.next().upper
        if kind in ("DOUBLE", "CHARACTER", "TIMESTAMP", "TIME"):
            if kind == "DOUBLE" and self.word("PRECISION"):
                kind = "DOUBLE"
            elif kind == "CHARACTER" and self.word("VARYING"):
                kind = "VARCHAR"
        if self.symbol("("):
            while not self.symbol(")"):
                if self.now.kind == "end":
                    self.fail()
                self.next()
        if self.dialect == "mysql" and self.now.upper == "UNSIGNED":
            raise Unsupported("unsigned types are outside the accepted subset")
        not_null = primary = unique = False
        default = check = None
        generated = "generated" if self.dialect == "postgres" and kind in ("BIGSERIAL", "SERIAL8") else ""
        while self.now.kind == "word":
            if self.word("NOT", "NULL"):
                not_null = True
            elif self.word("NULL"):
                pass
            elif self.word("PRIMARY", "KEY"):
                primary = True
                if self.now.upper in ("ASC", "DESC", "ON"):
                    raise Unsupported("options of keys are outside the accepted subset")
                if self.word("AUTOINCREMENT"):
                    if self.dialect != "sqlite" or kind != "INTEGER":
                        raise Unsupported("the generated-key declaration is not in its accepted form")
                    generated = "generated"
            elif self.word("AUTO_INCREMENT"):
                if self.dialect != "mysql" or kind not in INTEGER_TYPES:
                    raise Unsupported("the generated-key declaration is not in its accepted form")
                generated = "generated"
            elif self.word("GENERATED"):
                if self.dialect != "postgres" or not (self.word("ALWAYS", "AS", "IDENTITY") or self.word("BY", "DEFAULT", "AS", "IDENTITY")) or kind not in INTEGER_TYPES:
                    raise Unsupported("generated columns are outside the accepted subset: no generated-key declaration")
                if self.tokens[self.at - 4].upper == "BY":
                    raise Unsupported("the generated-key declaration is not in its accepted form")
                if self.now.text == "(":
                    raise Unsupported("the generated-key declaration is not in its accepted form")
                generated = "generated"
            elif self.word("UNIQUE"):
                unique = True
            elif self.word("DEFAULT"):
                default = self.literal_default()
            elif self.word("CHECK"):
                self.need("(")
                check = self.scalar("CHECK")
                self.need(")")
            else:
                raise Unsupported("this column option is outside the accepted subset")
        return ColumnDef(name, kind, not_null, primary, unique, default, check, generated)

    def literal_default(self) -> Node:
        sign = "-" if self.symbol("-") else "+" if self.symbol("+") else ""
        t = self.now
        if t.kind in ("number", "string") or t.upper in ("NULL", "TRUE", "FALSE"):
            x = self.primary()
            return Unary(sign, x) if sign else x
        raise Unsupported("defaults are literals")

    def create_index(self, unique: bool) -> CreateIndex:
        again = self.word("IF", "NOT", "EXISTS")
        if self.now.upper in ("CONCURRENTLY", "ON"):
            raise Unsupported("an index needs a name and no options")
        name = self.ident()
        self.need("ON")
        table = self.ident()
        if self.now.upper == "USING" or self.now.text == ".":
            raise Unsupported("index methods are outside the accepted subset")
        self.need("(")
        columns = []
        while True:
            if self.now.kind not in ("word", "ident"):
                raise Unsupported("an index takes plain columns only")
            column = self.ident()
            down = self.word("DESC")
            if not down:
                self.word("ASC")
            if self.now.text not in (",", ")"):
                raise Unsupported("an index takes plain columns only")
            columns.append((column, down))
            if not self.symbol(","):
                break
        self.need(")")
        if self.now.kind not in ("end",) and self.now.text != ";":
            raise Unsupported("partial indexes and index options are outside the accepted subset")
        return CreateIndex(name, table, tuple(columns), unique, again)

    # -- expressions
    def scalar(self, where: str) -> Node:
        x = self.expression()
        if has_aggregate(x):
            raise Unsupported(f"{where} cannot hold an aggregate")
        return x

    def expression(self) -> Node:
        x = self.either()
        if depth(x) > MAX_DEPTH:
            raise LimitExceeded(f"an expression may be {MAX_DEPTH} deep")
        return x

    def nested(self) -> Node:
        self.nesting += 1
        if self.nesting > MAX_NESTING:
            raise LimitExceeded(f"expressions may nest {MAX_NESTING} deep")
        try:
            return self.either()
        finally:
            self.nesting -= 1

    def either(self) -> Node:
        x = self.both()
        while self.word("OR"):
            x = Binary("or", x, self.both())
        return x

    def both(self) -> Node:
        x = self.negation()
        while self.word("AND"):
            x = Binary("and", x, self.negation())
        return x

    def negation(self) -> Node:
        if self.word("NOT"):
            if self.now.upper == "EXISTS":
                raise Unsupported("subqueries are outside the accepted subset")
            self.nesting += 1
            if self.nesting > MAX_NESTING:
                raise LimitExceeded(f"expressions may nest {MAX_NESTING} deep")
            try:
                return Unary("not", self.negation())
            finally:
                self.nesting -= 1
        return self.comparison()

    def comparison(self) -> Node:
        x = self.sum()
        while True:
            t = self.now
            if t.kind == "symbol" and t.text in ("=", "==", "<>", "!=", "<", "<=", ">", ">="):
                self.next()
                if t.text == "==" and self.dialect != "sqlite":
                    raise InvalidQuery("it is not well formed")
                if self.now.upper in ("ANY", "ALL", "SOME"):
                    raise Unsupported("quantified comparisons are outside the accepted subset")
                x = Binary({"==": "=", "!=": "<>"}.get(t.text, t.text), x, self.sum())
            elif self.word("IS"):
                negated = self.word("NOT")
                if self.word("NULL"):
                    x = IsNull(x, negated)
                elif self.word("TRUE"):
                    x = IsTruth(x, True, negated)
                elif self.word("FALSE"):
                    x = IsTruth(x, False, negated)
                else:
                    raise Unsupported("IS takes NULL, TRUE or FALSE")
            else:
                k = int(t.upper == "NOT")
                after = self.peek(k).upper
                if after == "BETWEEN":
                    self.at += k + 1
                    if self.now.upper in ("SYMMETRIC", "ASYMMETRIC"):
                        raise Unsupported("BETWEEN takes two bounds only")
                    low = self.sum()
                    self.need("AND")
                    x = Between(x, low, self.sum(), bool(k))
                elif after == "IN":
                    self.at += k + 1
                    if self.now.text != "(":
                        raise Unsupported("IN takes a list")
                    self.next()
                    if self.now.upper in ("SELECT", "WITH", "VALUES") or self.now.text == ")":
                        raise Unsupported("IN takes a list that is not empty")
                    items = [self.nested()]
                    while self.symbol(","):
                        items.append(self.nested())
                    self.need(")")
                    x = In(x, tuple(items), bool(k))
                elif after == "LIKE":
                    self.at += k + 1
                    if self.now.upper in ("ANY", "ALL"):
                        raise Unsupported("LIKE takes one pattern")
                    x = Like(x, self.sum(), bool(k))
                    if self.now.upper == "ESCAPE":
                        raise Unsupported("LIKE takes no escape")
                elif k or t.upper in ("ISNULL", "NOTNULL", "GLOB", "REGEXP", "MATCH", "RLIKE", "ILIKE", "SIMILAR", "COLLATE"):
                    raise Unsupported("it uses a construct outside the accepted subset")
                else:
                    return x

    def sum(self) -> Node:
        x = self.product()
        while self.now.kind == "symbol" and self.now.text in ("+", "-"):
            op = self.next().text
            x = Binary(op, x, self.product())
        return x

    def product(self) -> Node:
        x = self.unary()
        while self.now.kind == "symbol" and self.now.text in ("*", "/", "%"):
            op = self.next().text
            x = Binary(op, x, self.unary())
        if self.now.kind == "symbol" and self.now.text in FOREIGN_SYMBOLS:
            raise Unsupported("this operator is outside the accepted subset")
        return x

    def unary(self) -> Node:
        if self.now.kind == "symbol" and self.now.text in ("+", "-"):
            op = self.next().text
            self.nesting += 1
            if self.nesting > MAX_NESTING:
                raise LimitExceeded(f"expressions may nest {MAX_NESTING} deep")
            try:
                x = self.unary()
            finally:
                self.nesting -= 1
            if op == "-" and isinstance(x, Literal) and x.value == INT64 and type(x.value) is int:
                return Literal(-INT64)
            return Unary(op, x)
        return self.primary()

    def param(self) -> Param:
        t = self.next()
        number = int(t.text) if t.text else self.highest + 1
        if not 1 <= number <= MAX_PARAMETERS:
            raise InvalidQuery("a placeholder's number is out of range")
        self.highest = max(self.highest, number)
        return Param(number)

    def primary(self) -> Node:
        t = self.now
        if t.kind == "param":
            return self.param()
        if t.kind == "number":
            self.next()
            if t.text.isdigit():
                return Literal(int(t.text))
            value = float(t.text)
            if value in (float("inf"),):
                raise NumericOutOfRange("a number is out of range")
            return Literal(value)
        if t.kind == "string":
            self.next()
            return Literal(t.text)
        if self.symbol("("):
            if self.now.upper in ("SELECT", "WITH", "VALUES"):
                raise Unsupported("subqueries are outside the accepted subset")
            x = self.nested()
            if self.now.text == ",":
                raise Unsupported("tuples are outside the accepted subset")
            self.need(")")
            return x
        if t.kind == "word":
            if t.upper in ("NULL", "TRUE", "FALSE"):
                self.next()
                return Literal({"NULL": None, "TRUE": True, "FALSE": False}[t.upper])
            if t.upper == "CASE":
                return self.case()
            if t.upper in ("CAST", "EXISTS", "ARRAY", "ROW", "INTERVAL", "EXTRACT", "TRY_CAST", "CONVERT", "POSITION", "SUBSTRING", "TRIM", "OVERLAY", "NOT"):
                if self.peek().text in ("(", "[") or self.peek().kind == "string" or t.upper == "NOT":
                    raise Unsupported("it uses a construct outside the accepted subset")
            if t.upper in ("DATE", "TIME", "TIMESTAMP", "BINARY") and self.peek().kind == "string":
                raise Unsupported("typed literals are outside the accepted subset")
            if self.peek().text == "(" and self.peek().kind == "symbol":
                return self.call()
        if t.kind == "symbol":
            self.fail()
        first = self.ident()
        if self.symbol("."):
            second = self.ident()
            if self.now.text in (".", "("):
                raise Unsupported("names have one or two parts")
            return Name(second, first)
        if self.now.text == "(" and self.now.kind == "symbol":
            raise Unsupported("quoted functions are outside the accepted subset")
        return Name(first)

    def call(self) -> Node:
        name = self.next().upper.lower()
        if name not in AGGREGATES:
            if name.upper() in RESERVED:
                self.at -= 1
                self.fail()
            raise Unsupported("this function is outside the accepted subset")
        self.next()
        distinct = self.word("DISTINCT")
        if not distinct:
            self.word("ALL")
        if self.now.text == "*" and self.now.kind == "symbol":
            if name != "count" or distinct:
                raise Unsupported("only COUNT takes a star")
            self.next()
            x: Node = Aggregate("count", None)
        elif self.now.text == ")":
            raise Unsupported("an aggregate takes one argument")
        else:
            argument = self.nested()
            if has_aggregate(argument):
                raise Unsupported("aggregates cannot nest")
            if self.now.text == "," or self.now.upper in ("ORDER", "IGNORE", "RESPECT", "SEPARATOR", "LIMIT"):
                raise Unsupported("an aggregate takes one argument")
            x = Aggregate(name, argument, distinct)
        self.need(")")
        if self.now.upper in ("FILTER", "OVER", "WITHIN", "IGNORE", "RESPECT"):
            raise Unsupported("aggregate clauses are outside the accepted subset")
        return x

    def case(self) -> Case:
        self.need("CASE")
        operand = None if self.now.upper == "WHEN" else self.nested()
        whens = []
        while self.word("WHEN"):
            c = self.nested()
            self.need("THEN")
            whens.append((c, self.nested()))
        if not whens:
            self.fail()
        otherwise = self.nested() if self.word("ELSE") else None
        self.need("END")
        return Case(operand, tuple(whens), otherwise)


def depth(x: Node) -> int:
    level, at = 0, [x]
    while at:
        level, at = level + 1, [c for n in at for c in n.children()]
    return level


def parse(source: str, dialect: str = "sqlite") -> Batch:
    """All statements of a source text, checked against the accepted subset."""
    return _Parser(source, dialect).batch()


def parse_one(source: str, dialect: str = "sqlite") -> tuple[Statement, int]:
    """The one statement of a source and the number of its parameters."""
    batch = parse(source, dialect)
    if len(batch.statements) != 1:
        raise InvalidQuery("exactly one statement is needed")
    return batch.statements[0], batch.parameters[0]
