"""Recursive descent from text to syntax trees."""

from __future__ import annotations

from ..errors import ParseError
from . import ast as A
from .lexer import Token, tokenize

_COMPARE = {"=", "<>", "<", ">", "<=", ">=", "=~"}
_CLAUSES = {"MATCH", "OPTIONAL", "WHERE", "WITH", "RETURN", "UNWIND", "CALL", "CREATE", "MERGE", "SET", "REMOVE", "DELETE", "DETACH", "UNION", "ORDER", "SKIP", "LIMIT", "ON", "YIELD", "AS"}


class Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.i, self.fresh = text, tokenize(text), 0, 0

    # ------------------------------------------------------------ tokens

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def word(self, *words: str, ahead: int = 0) -> bool:
        t = self.toks[min(self.i + ahead, len(self.toks) - 1)]
        return t.kind == "name" and t.text.upper() in words

    def take(self, *words: str) -> bool:
        """Take these keywords if all of them come next."""
        if all(self.word(w, ahead=k) for k, w in enumerate(words)):
            self.i += len(words)
            return True
        return False

    def op(self, *ops: str) -> str:
        if self.tok.kind == "op" and self.tok.text in ops:
            self.i += 1
            return self.toks[self.i - 1].text
        return ""

    def need(self, what: str) -> None:
        if not (self.op(what) or self.take(what)):
            raise ParseError(f"{what} expected at {self.tok.at}, not {self.tok.text!r}")

    def name(self) -> str:
        if self.tok.kind != "name":
            raise ParseError(f"a name expected at {self.tok.at}, not {self.tok.text!r}")
        self.i += 1
        return str(self.toks[self.i - 1].value)

    def hidden(self) -> str:
        self.fresh += 1
        return f"_anon{self.fresh}"

    # ------------------------------------------------------------ statements

    def statement(self):
        if self.tok.kind == "end":
            raise ParseError("empty statement")
        out = self.ddl() or self.query()
        self.op(";")
        if self.tok.kind != "end":
            raise ParseError(f"unexpected {self.tok.text!r} at {self.tok.at}")
        return out

    def ddl(self):
        if self.word("CREATE") and self.word("NODE", "REL", "RELATIONSHIP", "TABLE", "DATABASE", ahead=1):
            self.i += 1
            if self.take("DATABASE"):
                name = self.database()
                shards = None
                if self.take("SHARDS"):
                    shards = self.integer()
                return A.Admin("create", name, shards)
            node = self.take("NODE")
            rel = not node and (self.take("REL") or self.take("RELATIONSHIP"))
            self.need("TABLE")
            quiet = self.take("IF", "NOT", "EXISTS")
            name = self.name()
            self.need("(")
            if rel or (not node and self.word("FROM")):
                return self.rel_ddl(name, quiet)
            return self.node_ddl(name, quiet)
        for word in ("STOP", "START", "DROP"):
            if self.take(word, "DATABASE"):
                return A.Admin(word.lower(), self.database())
        if self.take("SHOW", "DATABASES"):
            return A.Admin("show")
        if self.take("DROP", "TABLE"):
            quiet = self.take("IF", "EXISTS")
            return A.DropTable(self.name(), quiet)
        if self.take("ALTER", "TABLE"):
            return self.alter()
        if self.take("COPY"):
            table = self.name()
            self.need("FROM")
            if self.tok.kind != "string":
                raise ParseError("COPY needs a file name in quotes")
            path = str(self.tok.value)
            self.i += 1
            options = {}
            if self.op("("):
                while not self.op(")"):
                    key = self.name().upper()
                    self.need("=")
                    options[key] = self.tok.value if self.tok.kind == "string" else self.tok.text.lower() == "true"
                    self.i += 1
                    self.op(",")
            return A.Copy(table, path, options)
        return None

    def database(self) -> str:
        """A database name may hold hyphens."""
        start = self.tok.at
        while self.tok.kind in ("name", "int") or (self.tok.kind == "op" and self.tok.text == "-"):
            if self.word("SHARDS") or (self.i and self.toks[self.i - 1].at >= start and self.tok.at != self.toks[self.i - 1].at + len(self.toks[self.i - 1].text)):
                break
            self.i += 1
        last = self.toks[self.i - 1]
        if last.at < start:
            raise ParseError("a database name expected")
        return self.text[start : last.at + len(last.text)].strip("`").lower()

    def integer(self) -> int:
        if self.tok.kind != "int":
            raise ParseError(f"a whole number expected at {self.tok.at}")
        self.i += 1
        return int(self.toks[self.i - 1].value)

    def type_name(self) -> str:
        name = self.name()
        if self.op("["):
            self.need("]")
            name += "[]"
        return name

    def columns(self):
        """Yield (name, type, is_key) up to the closing parenthesis; a key clause has no type."""
        while not self.op(")"):
            if self.take("PRIMARY", "KEY"):
                self.need("(")
                yield self.name(), "", True
                self.need(")")
            else:
                name, kind = self.name(), self.type_name()
                if self.take("DEFAULT"):
                    self.expr()
                yield name, kind, self.take("PRIMARY", "KEY")
            if not self.op(","):
                self.need(")")
                return

    def node_ddl(self, name: str, quiet: bool) -> A.NodeDDL:
        columns, key = [], ""
        for column, kind, is_key in self.columns():
            if kind:
                columns.append((column, kind))
            key = column if is_key else key
        if key not in dict(columns):
            raise ParseError(f"node table {name} needs a PRIMARY KEY among its columns")
        return A.NodeDDL(name, tuple(columns), key, quiet)

    def rel_ddl(self, name: str, quiet: bool) -> A.RelDDL:
        self.need("FROM")
        src = self.name()
        self.need("TO")
        dst = self.name()
        columns = []
        if self.op(","):
            columns = [(c, k) for c, k, _ in self.columns() if k]
        else:
            self.need(")")
        return A.RelDDL(name, src, dst, tuple(columns), quiet)

    def alter(self) -> A.Alter:
        table = self.name()
        if self.take("RENAME", "TO"):
            return A.Alter(table, "rename_table", (self.name(),))
        if self.take("RENAME"):
            old = self.name()
            self.need("TO")
            return A.Alter(table, "rename", (old, self.name()))
        if self.take("ADD"):
            name, kind = self.name(), self.type_name()
            return A.Alter(table, "add", (name, kind, self.expr() if self.take("DEFAULT") else A.Lit(None)))
        if self.take("DROP"):
            return A.Alter(table, "drop", (self.name(),))
        raise ParseError(f"ALTER TABLE {table}: ADD, DROP or RENAME expected")

    # ------------------------------------------------------------ queries

    def query(self) -> A.Query:
        clauses = []
        while self.tok.kind != "end" and not self.word("UNION") and not (self.tok.kind == "op" and self.tok.text == ";"):
            clauses.append(self.clause())
        if not clauses:
            raise ParseError(f"a query expected at {self.tok.at}")
        if self.take("UNION"):
            all_rows = self.take("ALL")
            return A.Query(tuple(clauses), self.query(), all_rows)
        return A.Query(tuple(clauses))

    def clause(self):
        if self.take("OPTIONAL", "MATCH"):
            return self.match(True)
        if self.take("MATCH"):
            return self.match(False)
        if self.take("WITH"):
            return A.With(self.projection(True))
        if self.take("RETURN"):
            return A.Return(self.projection(False))
        if self.take("UNWIND"):
            expr = self.expr()
            self.need("AS")
            return A.Unwind(expr, self.name())
        if self.take("CALL"):
            return self.call()
        if self.take("CREATE"):
            return A.Create(tuple(self.patterns()))
        if self.take("MERGE"):
            pattern, hooks = self.pattern(), {"CREATE": (), "MATCH": ()}
            while self.take("ON"):
                kind = "CREATE" if self.take("CREATE") else "MATCH"
                if kind == "MATCH":
                    self.need("MATCH")
                self.need("SET")
                hooks[kind] += tuple(self.set_items())
            return A.Merge(pattern, hooks["CREATE"], hooks["MATCH"])
        if self.take("SET"):
            return A.SetProps(tuple(self.set_items()))
        if self.take("REMOVE"):
            out = [self.target()]
            while self.op(","):
                out.append(self.target())
            return A.Remove(tuple(out))
        detach = self.take("DETACH")
        if self.take("DELETE"):
            names = [self.name()]
            while self.op(","):
                names.append(self.name())
            return A.Delete(tuple(names), detach)
        raise ParseError(f"unexpected {self.tok.text!r} at {self.tok.at}")

    def match(self, optional: bool) -> A.Match:
        patterns = tuple(self.patterns())
        return A.Match(patterns, self.expr() if self.take("WHERE") else None, optional)

    def call(self) -> A.CallProc:
        name = self.name()
        while self.op("."):
            name += "." + self.name()
        args = []
        if self.op("("):
            while not self.op(")"):
                args.append(self.expr())
                self.op(",")
        outputs = []
        if self.take("YIELD"):
            while True:
                column = self.name()
                outputs.append((column, self.name() if self.take("AS") else column))
                if not self.op(","):
                    break
        return A.CallProc(name, tuple(args), tuple(outputs))

    def target(self) -> tuple[str, str]:
        var = self.name()
        self.need(".")
        return var, self.name()

    def set_items(self):
        while True:
            var = self.name()
            prop = self.name() if self.op(".") else ""
            if not prop and self.op("+"):
                pass
            self.need("=")
            yield var, prop, self.expr()
            if not self.op(","):
                return

    def projection(self, is_with: bool) -> A.Projection:
        distinct = self.take("DISTINCT")
        items = [self.item(is_with)]
        while self.op(","):
            items.append(self.item(is_with))
        order, skip, limit, where = [], None, None, None
        if self.take("ORDER", "BY"):
            while True:
                expr = self.expr()
                down = self.take("DESC") or self.take("DESCENDING")
                if not down:
                    self.take("ASC") or self.take("ASCENDING")
                order.append((expr, down))
                if not self.op(","):
                    break
        if self.take("SKIP") or self.take("OFFSET"):
            skip = self.expr()
        if self.take("LIMIT"):
            limit = self.expr()
        if is_with and self.take("WHERE"):
            where = self.expr()
        return A.Projection(tuple(items), distinct, tuple(order), skip, limit, where)

    def item(self, is_with: bool) -> A.Item:
        start = self.tok.at
        if self.op("*"):
            return A.Item(None, "*", True)
        if self.tok.kind == "name" and self.toks[self.i + 1].text == "." and self.toks[self.i + 2].text == "*":
            var = self.name()
            self.i += 2
            return A.Item(A.Var(var), var, True)
        expr = self.expr()
        last = self.toks[self.i - 1]
        text = self.text[start : last.at + len(last.text)]
        if self.take("AS"):
            return A.Item(expr, self.name())
        if is_with and not isinstance(expr, A.Var):
            raise ParseError(f"WITH {text}: AS and a name expected")
        return A.Item(expr, text)

    # ------------------------------------------------------------ patterns

    def patterns(self):
        yield self.pattern()
        while self.op(","):
            yield self.pattern()

    def pattern(self) -> A.Pattern:
        path = ""
        if self.tok.kind == "name" and self.toks[self.i + 1].text == "=":
            path = self.name()
            self.need("=")
        nodes, rels = [self.node()], []
        while self.tok.kind == "op" and self.tok.text in ("-", "<-", "->", "<"):
            rels.append(self.rel())
            nodes.append(self.node())
        return A.Pattern(tuple(nodes), tuple(rels), path)

    def node(self) -> A.NodePat:
        self.need("(")
        named = self.tok.kind == "name"
        var = self.name() if named else self.hidden()
        labels = []
        while self.op(":", "|"):
            labels.append(self.name())
        props = self.props()
        self.need(")")
        return A.NodePat(var, tuple(labels), props, named)

    def props(self) -> tuple:
        if not self.op("{"):
            return ()
        out = []
        while not self.op("}"):
            key = self.name()
            self.need(":")
            out.append((key, self.expr()))
            if not self.op(","):
                self.need("}")
                break
        return tuple(out)

    def rel(self) -> A.RelPat:
        left = self.op("<-", "-", "->", "<")
        if left == "<":
            self.need("-")
            left = "<-"
        if left == "->":  # written -->: the lexer reads the first dash as part of no bracket
            return A.RelPat(self.hidden(), named=False)
        var, types, props, low, high, shortest, named = self.hidden(), [], (), None, None, "", False
        if self.op("["):
            if self.tok.kind == "name":
                var, named = self.name(), True
            if self.op(":"):
                types.append(self.name())
                while self.op("|"):
                    self.op(":")
                    types.append(self.name())
            if self.op("*"):
                low, high = 1, None
                if self.take("ALL", "SHORTEST"):
                    shortest = "all"
                elif self.take("SHORTEST"):
                    shortest = "one"
                if self.tok.kind == "int":
                    low = high = self.integer()
                    if self.op(".."):
                        high = self.integer() if self.tok.kind == "int" else None
                elif self.op(".."):
                    high = self.integer() if self.tok.kind == "int" else None
            props = self.props()
            self.need("]")
        right = self.op("->", "-")
        if not right:
            raise ParseError(f"an arrow expected at {self.tok.at}")
        if left == "-" and right == "-" and self.op(">"):
            right = "->"
        way = "both" if (left == "<-") == (right == "->") else "in" if left == "<-" else "out"
        return A.RelPat(var, tuple(types), props, way, low, high, shortest, named)

    # ------------------------------------------------------------ expressions

    def expr(self):
        return self.chain(lambda: self.chain(lambda: self.chain(self.negation, "AND"), "XOR"), "OR")

    def chain(self, inner, word: str):
        out = inner()
        while self.take(word):
            out = A.Op(word.lower(), (out, inner()))
        return out

    def negation(self):
        return A.Op("not", (self.negation(),)) if self.take("NOT") else self.comparison()

    def comparison(self):
        out = self.sum()
        found = []
        while True:
            if op := self.op(*_COMPARE):
                right = self.sum()
                found.append(A.Op(op, (out, right)))
                out = right
            elif self.take("IS", "NOT", "NULL"):
                found.append(A.Op("is not null", (out,)))
            elif self.take("IS", "NULL"):
                found.append(A.Op("is null", (out,)))
            elif self.take("IN"):
                found.append(A.Op("in", (out, self.sum())))
            elif self.take("STARTS", "WITH"):
                found.append(A.Op("starts with", (out, self.sum())))
            elif self.take("ENDS", "WITH"):
                found.append(A.Op("ends with", (out, self.sum())))
            elif self.take("CONTAINS"):
                found.append(A.Op("contains", (out, self.sum())))
            else:
                break
        if not found:
            return out
        whole = found[0]
        for x in found[1:]:
            whole = A.Op("and", (whole, x))
        return whole

    def sum(self):
        out = self.product()
        while op := self.op("+", "-"):
            out = A.Op(op, (out, self.product()))
        return out

    def product(self):
        out = self.power()
        while op := self.op("*", "/", "%"):
            out = A.Op(op, (out, self.power()))
        return out

    def power(self):
        out = self.unary()
        return A.Op("^", (out, self.power())) if self.op("^") else out

    def unary(self):
        if self.op("-"):
            inner = self.unary()
            return A.Lit(-inner.value) if isinstance(inner, A.Lit) and isinstance(inner.value, (int, float)) else A.Op("neg", (inner,))
        self.op("+")
        return self.postfix()

    def postfix(self):
        out = self.atom()
        while True:
            if self.op("."):
                out = A.Prop(out, self.name())
            elif self.op("["):
                out = A.Op("index", (out, self.expr()))
                self.need("]")
            else:
                return out

    def atom(self):
        t = self.tok
        if t.kind in ("int", "float", "string"):
            self.i += 1
            return A.Lit(t.value)
        if t.kind == "param":
            self.i += 1
            return A.Param(str(t.value))
        if t.kind == "op" and t.text == "(" and (found := self.tested()) is not None:
            return found
        if self.op("("):
            out = self.expr()
            self.need(")")
            return out
        if self.op("["):
            items = []
            while not self.op("]"):
                items.append(self.expr())
                if not self.op(","):
                    self.need("]")
                    break
            return A.ListOf(tuple(items))
        if t.kind == "op" and t.text == "{":
            return A.MapOf(self.props())
        if t.kind != "name":
            raise ParseError(f"unexpected {t.text!r} at {t.at}")
        for word, value in (("TRUE", True), ("FALSE", False), ("NULL", None)):
            if self.take(word):
                return A.Lit(value)
        if self.word("CASE"):
            return self.case()
        if self.word("EXISTS", "COUNT") and self.toks[self.i + 1].text == "{":
            return self.asked(self.name().lower())
        if self.word("EXISTS") and self.toks[self.i + 1].text == "(":
            self.i += 2
            if (found := self.tested()) is None:
                raise ParseError(f"a pattern expected at {self.tok.at}")
            self.need(")")
            return found
        name = self.name()
        if not self.op("("):
            if t.text.upper() in _CLAUSES and not t.text.startswith("`"):
                raise ParseError(f"unexpected {t.text} at {t.at}")
            return A.Var(name)
        if self.op("*"):
            self.need(")")
            return A.Call(name.lower(), (), star=True)
        distinct, args = self.take("DISTINCT"), []
        while not self.op(")"):
            args.append(self.expr())
            if not self.op(","):
                self.need(")")
                break
        return A.Call(name.lower(), tuple(args), distinct)

    def tested(self) -> A.Sub | None:
        """A pattern with a relationship that stands where an expression may; None, and nothing read, if it is none."""
        begun = self.i, self.fresh
        try:
            p = self.pattern()
        except ParseError:
            p = None
        if p is None or not p.rels or p.path:
            self.i, self.fresh = begun
            return None
        return A.Sub("exists", (p,))

    def asked(self, kind: str) -> A.Sub:
        """{ [MATCH] patterns [WHERE condition] }"""
        self.need("{")
        self.take("MATCH")
        patterns = tuple(self.patterns())
        where = self.expr() if self.take("WHERE") else None
        self.need("}")
        return A.Sub(kind, patterns, where)

    def case(self):
        self.need("CASE")
        of = None if self.word("WHEN") else self.expr()
        arms, other = [], A.Lit(None)
        while self.take("WHEN"):
            cond = self.expr()
            self.need("THEN")
            arms.append((cond, self.expr()))
        if self.take("ELSE"):
            other = self.expr()
        self.need("END")
        return A.Case(of, tuple(arms), other)


def parse(text: str):
    """The syntax tree of one statement."""
    return Parser(text).statement()
