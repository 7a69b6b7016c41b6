"""MySQL-flavoured SQL text to Spark SQL text.

Expressions are parsed by operator precedence, so operators whose meaning differs (/, %, DIV, ||, XOR, CAST, ->, :=) are rewritten with their operands; function calls go through the table in millrace.functions. Statement structure is left as it is, but for a few clauses (LIMIT m, n; STRAIGHT_JOIN; index hints; FROM DUAL).
"""

from __future__ import annotations

import re

from ..functions import CALLS

TOKEN = re.compile(
    r"""(?P<ws>\s+|--[ \t][^\n]*|\#[^\n]*|/\*.*?\*/)
  | (?P<hex>0[xX][0-9a-fA-F]+|[xX]'[0-9a-fA-F]*') | (?P<bits>0b[01]+|[bB]'[01]*')
  | (?P<num>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?(?![A-Za-z_]))
  | (?P<str>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*")
  | (?P<var>@@?[A-Za-z_][\w.]*) | (?P<id>`[^`]+`|[A-Za-z_]\w*|\d+[A-Za-z_]\w*)
  | (?P<op><=>|->>|->|<<|>>|<=|>=|<>|!=|:=|\|\||&&|[-+*/%=<>!~^&|(),.;?:\[\]])""",
    re.X | re.S,
)

#: Words at which an expression ends.
STOPS = frozenset(
    "select from where group order having limit offset on using join inner left right full cross outer natural straight_join union all distinct distinctrow as asc desc set values with recursive partition by rows range when then else end insert into update delete create table view drop truncate explain window over separator for lateral nulls first last except intersect minus if replace".split()
)
UNITS = frozenset("microsecond second minute hour day week month quarter year minute_second hour_minute hour_second day_hour day_minute day_second year_month second_microsecond minute_microsecond hour_microsecond day_microsecond".split())


class Unsupported(ValueError):
    """SQL that a distributed engine can't run, or that the rewriter doesn't know."""


def tokens(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m:
            raise Unsupported(f"unexpected text at: {sql[at:at + 30]!r}")
        if m.lastgroup != "ws":
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return out


def quoted(text: str) -> str:
    """A Spark string literal of a MySQL one."""
    mark, body = text[0], text[1:-1].replace(text[0] * 2, text[0])
    del mark
    plain = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a", "%": "\\%", "_": "\\_"}.get(m[1], m[1]), body, flags=re.S)
    return literal(plain)


def literal(plain: str) -> str:
    return "'" + plain.replace("\\", "\\\\").replace("'", "\\'") + "'"


TYPES = {
    "signed": "bigint", "integer": "bigint", "int": "bigint", "bigint": "bigint", "unsigned": "decimal(20,0)", "char": "string", "varchar": "string", "nchar": "string", "text": "string", "binary": "binary", "date": "date", "datetime": "timestamp", "timestamp": "timestamp", "float": "double", "double": "double", "real": "double", "json": "string", "boolean": "boolean", "bool": "boolean",
}


class Rewriter:
    def __init__(self, sql: str, variables: dict | None = None):
        self.t, self.i, self.variables = tokens(sql), 0, variables or {}

    # tokens
    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.t[self.i + k] if self.i + k < len(self.t) else ("end", "")

    def word(self, k: int = 0) -> str:
        kind, text = self.peek(k)
        return text.lower() if kind == "id" else ""

    def op(self, *texts: str) -> bool:
        kind, text = self.peek()
        return kind == "op" and text in texts

    def take(self) -> str:
        self.i += 1
        return self.t[self.i - 1][1]

    def want(self, text: str) -> None:
        if self.peek()[1].lower() != text:
            raise Unsupported(f"expected {text!r}, found {self.peek()[1]!r}")
        self.i += 1

    # statements
    def statement(self, inner: bool = False) -> str:
        out: list[str] = []
        while self.i < len(self.t):
            kind, text = self.peek()
            w = self.word()
            if kind == "op" and text in ");" and inner:
                break
            if kind == "op" and text == ";":
                self.i += 1
            elif w == "limit":
                self.i += 1
                first = self.take()
                if self.op(","):
                    self.i += 1
                    out.append(f"LIMIT {self.take()} OFFSET {first}")
                else:
                    out.append(f"LIMIT {first}")
            elif w == "straight_join":
                self.i += 1
                out.append("JOIN")
            elif w == "distinctrow":
                self.i += 1
                out.append("DISTINCT")
            elif w in ("use", "force", "ignore") and self.word(1) in ("index", "key"):
                self.i += 2
                self.group()
            elif w == "from" and self.word(1) == "dual":
                self.i += 2
            elif w in ("sql_no_cache", "sql_calc_found_rows", "high_priority"):
                self.i += 1
            elif w in ("left", "right", "replace", "if", "insert", "values", "truncate") and self.peek(1)[1] == "(" and w != "values":
                out.append(self.expression())
            elif w == "as" or w in STOPS and w not in ("left", "right", "if"):
                out.append(self.take())
                if w == "as" and self.peek()[0] in ("id", "str"):
                    out.append(self.name())
            elif w in STOPS:
                out.append(self.take())
            elif kind == "op" and text in (",", "."):
                out.append(self.take())
            elif kind == "op" and text == "*":
                out.append(self.take())
            else:
                out.append(self.expression())
        return " ".join(out)

    def name(self) -> str:
        kind, text = self.peek()
        self.i += 1
        if kind == "str":
            return "`" + text[1:-1] + "`"
        return text

    def group(self) -> None:
        """Passes over a parenthesis."""
        self.want("(")
        depth = 1
        while depth:
            text = self.take()
            depth += (text == "(") - (text == ")")

    # expressions, loosest first
    def expression(self) -> str:
        left = self.xor_()
        while self.op("||") or self.word() == "or":
            self.i += 1
            left = f"({left} OR {self.xor_()})"
        if self.op(":="):
            raise Unsupported("assignment to a variable within a query depends on row order, which a distributed engine doesn't have")
        return left

    def xor_(self) -> str:
        left = self.and_()
        while self.word() == "xor":
            self.i += 1
            right = self.and_()
            left = f"(cast({left} as boolean) <> cast({right} as boolean))"
        return left

    def and_(self) -> str:
        left = self.not_()
        while self.op("&&") or self.word() == "and":
            self.i += 1
            left = f"({left} AND {self.not_()})"
        return left

    def not_(self) -> str:
        if self.word() == "not" and self.word(1) != "exists":
            self.i += 1
            return f"(NOT cast({self.not_()} as boolean))"
        return self.compare()

    def compare(self) -> str:
        left = self.bit_or()
        while True:
            negated = ""
            if self.op("=", "<=>", "<>", "!=", "<", "<=", ">", ">="):
                op = self.take()
                if self.word() in ("any", "some", "all"):
                    raise Unsupported("quantified comparison; use EXISTS or an aggregate")
                left = f"({left} {op} {self.bit_or()})"
                continue
            if self.word() == "is":
                self.i += 1
                if self.word() == "not":
                    self.i += 1
                    negated = "NOT "
                what = self.take().upper()
                subject = left if what == "NULL" else f"cast({left} as boolean)"
                left = f"({subject} IS {negated}{what})"
                continue
            if self.word() == "not" and self.word(1) in ("in", "like", "between", "regexp", "rlike"):
                self.i += 1
                negated = "NOT "
            w = self.word()
            if w == "in":
                self.i += 1
                left = f"({left} {negated}IN {self.parenthesis()})"
            elif w == "like":
                self.i += 1
                right = self.bit_or()
                left = f"({left} {negated}LIKE {right})"
                if self.word() == "escape":
                    self.i += 1
                    left = f"{left[:-1]} ESCAPE {self.bit_or()})"
            elif w in ("regexp", "rlike"):
                self.i += 1
                left = f"({left} {negated}RLIKE {self.bit_or()})"
            elif w == "between":
                self.i += 1
                low = self.bit_or()
                self.want("and")
                left = f"({left} {negated}BETWEEN {low} AND {self.bit_or()})"
            else:
                return left

    def _left(self, next_, ops: dict) -> str:
        left = next_()
        while (self.peek()[0] == "op" and self.peek()[1] in ops) or self.word() in ops:
            op = self.take().lower()
            right = next_()
            left = ops[op](left, right)
        return left

    def bit_or(self) -> str:
        return self._left(self.bit_and, {"|": lambda a, b: f"(cast({a} as bigint) | cast({b} as bigint))"})

    def bit_and(self) -> str:
        return self._left(self.shift, {"&": lambda a, b: f"(cast({a} as bigint) & cast({b} as bigint))"})

    def shift(self) -> str:
        return self._left(self.sum_, {"<<": lambda a, b: f"shiftleft(cast({a} as bigint), cast({b} as int))", ">>": lambda a, b: f"shiftrightunsigned(cast({a} as bigint), cast({b} as int))"})

    def sum_(self) -> str:
        left = self.product()
        while self.op("+", "-"):
            op = self.take()
            if self.word() == "interval" and self.is_interval():
                left = CALLS["date_add" if op == "+" else "date_sub"]([left, self.interval()])
            else:
                left = "({} {} {})".format(*operands(left, op, self.product()))
        return left

    def product(self) -> str:
        return self._left(
            self.power,
            {
                "*": lambda a, b: "({} {} {})".format(*operands(a, "*", b)),
                "/": lambda a, b: "try_divide({0}, {2})".format(*operands(a, "/", b)),
                "%": lambda a, b: "try_mod({0}, {2})".format(*operands(a, "%", b)),
                "mod": lambda a, b: "try_mod({0}, {2})".format(*operands(a, "%", b)),
                "div": lambda a, b: f"cast(({a}) div nullif({b}, 0) as bigint)",
            },
        )

    def power(self) -> str:
        return self._left(self.unary, {"^": lambda a, b: f"(cast({a} as bigint) ^ cast({b} as bigint))"})

    def unary(self) -> str:
        if self.op("-", "+"):
            return f"({self.take()}{self.unary()})"
        if self.op("!"):
            self.i += 1
            return f"(NOT cast({self.unary()} as boolean))"
        if self.op("~"):
            self.i += 1
            return f"(~ cast({self.unary()} as bigint))"
        if self.word() == "binary" and self.peek(1)[1] != "(":
            self.i += 1
            return self.unary()
        return self.postfix()

    def postfix(self) -> str:
        left = self.primary()
        while True:
            if self.op("->", "->>"):
                op = self.take()
                path = self.primary()
                left = CALLS["json_extract"]([left, path])
                left = CALLS["json_unquote"]([left]) if op == "->>" else left
            elif self.word() == "collate":
                self.i += 2
            elif self.word() == "over":
                self.i += 1
                left += f" OVER {self.window()}"
            else:
                return left

    def window(self) -> str:
        if not self.op("("):
            return self.name()
        self.i += 1
        out = []
        while not self.op(")"):
            w = self.word()
            if w in ("partition", "by", "order", "rows", "range", "between", "unbounded", "preceding", "following", "current", "row", "and", "asc", "desc", "nulls", "first", "last") or self.op(","):
                out.append(self.take())
            else:
                out.append(self.bit_or())
        self.i += 1
        return f"({' '.join(out)})"

    def parenthesis(self) -> str:
        self.want("(")
        if self.word() in ("select", "with", "values"):
            inner = self.statement(inner=True)
        else:
            items = []
            while not self.op(")"):
                items.append(self.expression())
                if self.op(","):
                    self.i += 1
                elif not self.op(")"):
                    items[-1] += " " + self.statement(inner=True)
            inner = ", ".join(items)
        self.want(")")
        return f"({inner})"

    def is_interval(self) -> bool:
        """INTERVAL n UNIT, as against the function INTERVAL(x, ..)."""
        if self.peek(1)[1] != "(":
            return self.peek(1)[0] in ("num", "str", "var") or self.peek(1)[1] == "-" or self.word(2) in UNITS
        depth, k = 0, 1
        while self.peek(k)[0] != "end":
            depth += (self.peek(k)[1] == "(") - (self.peek(k)[1] == ")")
            k += 1
            if not depth:
                break
        return self.word(k) in UNITS

    def interval(self) -> str:
        self.want("interval")
        n = self.bit_or()
        return f"INTERVAL|{n}|{self.take().lower()}"

    def primary(self) -> str:
        kind, text = self.peek()
        w = self.word()
        if kind == "num":
            self.i += 1
            return text if not re.fullmatch(r"\d+", text) or int(text) < 1 << 63 else f"{text}BD"
        if kind == "str":
            self.i += 1
            return quoted(text)
        if kind == "hex":
            self.i += 1
            digits = text[2:].rstrip("'")
            return f"X'{digits if len(digits) % 2 == 0 else '0' + digits}'"
        if kind == "bits":
            self.i += 1
            return str(int(re.sub(r"[^01]", "", text[1:] if text[0] != "0" else text[2:]) or "0", 2))
        if kind == "var":
            self.i += 1
            if self.op(":="):
                raise Unsupported("assignment to a variable within a query depends on row order, which a distributed engine doesn't have")
            value = self.variables.get(text.lstrip("@").lower())
            return "NULL" if value is None else literal(value) if isinstance(value, str) else str(value)
        if kind == "op" and text == "(":
            return self.parenthesis()
        if kind == "op" and text in "*?":
            self.i += 1
            return text
        if w == "case":
            return self.case()
        if w == "exists" or w == "not" and self.word(1) == "exists":
            negated = "NOT " if w == "not" else ""
            self.i += 1 + (w == "not")
            return f"({negated}EXISTS {self.parenthesis()})"
        if w == "interval" and self.is_interval():
            return self.interval()
        if w in ("date", "timestamp", "time") and self.peek(1)[0] == "str":
            self.i += 2
            return quoted(self.t[self.i - 1][1]) if w == "time" else f"{w.upper()} {quoted(self.t[self.i - 1][1])}"
        if kind == "id" and w.startswith("_") and self.peek(1)[0] == "str":
            self.i += 1  # a character set introducer
            return self.primary()
        if kind == "id" and self.peek(1)[1] == "(" and not text.startswith("`"):
            return self.call()
        if kind == "id":
            self.i += 1
            if w in CALLS and w in ("current_date", "current_timestamp", "current_time", "localtime", "localtimestamp", "current_user", "utc_date", "utc_time", "utc_timestamp"):
                return CALLS[w]([])
            parts = [text]
            while self.op(".") and (self.peek(1)[0] == "id" or self.peek(1)[1] == "*"):
                self.i += 1
                parts.append(self.take())
            return ".".join(parts)
        raise Unsupported(f"unexpected {text!r}")

    def case(self) -> str:
        self.want("case")
        out = ["CASE"]
        if self.word() != "when":
            out.append(self.expression())
        while self.word() == "when":
            self.i += 1
            out.append(f"WHEN {self.expression()}")
            self.want("then")
            out.append(f"THEN {self.expression()}")
        if self.word() == "else":
            self.i += 1
            out.append(f"ELSE {self.expression()}")
        self.want("end")
        return "(" + " ".join([*out, "END"]) + ")"

    def type_(self) -> str:
        first = self.take().lower()
        if first in ("decimal", "numeric", "dec"):
            if self.op("("):
                inner = self.parenthesis()
                return "decimal" + (inner if "," in inner else inner[:-1] + ",0)")
            return "decimal(10,0)"
        if self.op("("):
            self.group()
        while self.word() in ("integer", "precision", "character", "set", "varying"):
            self.i += 1
        if first not in TYPES:
            raise Unsupported(f"CAST to {first}")
        return TYPES[first]

    def call(self) -> str:
        fn = self.take().lower()
        self.want("(")
        if fn in ("cast", "try_cast"):
            x = self.expression()
            self.want("as")
            kind = self.type_()
            self.want(")")
            return cast(x, kind)
        if fn == "convert":
            x = self.expression()
            if self.word() == "using":
                self.i += 2
                self.want(")")
                return x
            self.want(",")
            kind = self.type_()
            self.want(")")
            return cast(x, kind)
        if fn == "extract":
            unit = self.take().lower()
            self.want("from")
            x = self.expression()
            self.want(")")
            return CALLS["extract"]([unit, x])
        if fn in ("timestampdiff", "timestampadd"):
            args = [self.take().lower()]
            while self.op(","):
                self.i += 1
                args.append(self.expression())
            self.want(")")
            return CALLS[fn](args)
        if fn == "trim":
            side = self.take().lower() if self.word() in ("both", "leading", "trailing") else "both"
            what = None
            x = None
            if self.word() != "from":
                x = self.expression()
            if self.word() == "from":
                self.i += 1
                what, x = x, self.expression()
            self.want(")")
            return CALLS[{"both": "trim", "leading": "ltrim", "trailing": "rtrim"}[side]]([x] + ([what] if what else []))
        if fn == "position":
            a = self.sum_()
            self.want("in")
            b = self.expression()
            self.want(")")
            return CALLS["locate"]([a, b])
        if fn == "get_format":
            args = [f"'{self.take().lower()}'"]
            self.want(",")
            args.append(self.expression())
            self.want(")")
            return CALLS[fn](args)
        if fn == "group_concat":
            return self.group_concat()
        distinct = ""
        if self.word() == "distinct":
            self.i += 1
            distinct = "DISTINCT "
        args = []
        if self.word() == "select":
            self.i -= 1
            inner = self.parenthesis()
            return f"{fn}{inner}"
        while not self.op(")"):
            if self.word() == "interval" and self.is_interval():
                args.append(self.interval())
            elif self.op("*"):
                args.append(self.take())
            else:
                args.append(self.expression())
            if self.op(","):
                self.i += 1
            elif self.word() in ("from", "for"):  # SUBSTRING(s FROM p FOR n)
                self.i += 1
            elif not self.op(")"):
                raise Unsupported(f"{fn}: unexpected {self.peek()[1]!r}")
        self.want(")")
        if fn in CALLS and not distinct:
            return CALLS[fn](args)
        return f"{fn}({distinct}{', '.join(args)})"

    def group_concat(self) -> str:
        distinct = ""
        if self.word() == "distinct":
            self.i += 1
            distinct = "DISTINCT "
        args = [self.expression()]
        while self.op(","):
            self.i += 1
            args.append(self.expression())
        x = args[0] if len(args) == 1 else f"concat({', '.join(args)})"
        order = []
        if self.word() == "order":
            self.i += 2
            while self.word() != "separator" and not self.op(")"):
                order.append(self.take() if self.op(",") or self.word() in ("asc", "desc") else self.bit_or())
        separator = "','"
        if self.word() == "separator":
            self.i += 1
            separator = quoted(self.take())
        self.want(")")
        within = f" WITHIN GROUP (ORDER BY {' '.join(order)})" if order else f" WITHIN GROUP (ORDER BY cast({x} as string))" if distinct else ""
        return f"listagg({distinct}cast({x} as string), {separator}){within}"


def operands(a: str, op: str, b: str) -> tuple[str, str, str]:
    """Operands of arithmetic: a text literal is its leading number, and two whole literals are taken in 64 bits."""
    number = lambda x: (m := re.match(r"\s*[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?", x[1:-1])) and m[0].strip() or "0"
    a, b = (f"{float(number(x))!r}D" if re.fullmatch(r"'(?:[^'\\]|\\.)*'", x, re.S) else x for x in (a, b))
    if re.fullmatch(r"\d+", a) and re.fullmatch(r"\d+", b) and op != "/":
        a, b = a + "L", b + "L"
    return a, op, b


def cast(x: str, kind: str) -> str:
    """CAST by MySQL's rules: a number to a whole number rounds, a text gives its leading number (0 if it has none)."""
    if kind in ("bigint", "decimal(20,0)"):
        number = f"coalesce(try_cast(regexp_extract(cast({x} as string), '^\\\\s*([-+]?[0-9]+(\\\\.[0-9]+)?([eE][-+]?[0-9]+)?)', 1) as decimal(38,10)), 0)"
        return f"if({x} is null, null, cast(round({number}) as {kind}))"
    if kind == "double":
        return f"coalesce(try_cast({x} as double), if({x} is null, null, coalesce(try_cast(regexp_extract(cast({x} as string), '^\\\\s*([-+]?[0-9]+(\\\\.[0-9]+)?)', 1) as double), 0)))"
    if kind in ("date", "timestamp"):
        return f"try_cast({x} as {kind})"
    return f"cast({x} as {kind})"


def rewrite(sql: str, variables: dict | None = None) -> str:
    """Spark SQL of one MySQL-flavoured query."""
    return Rewriter(sql, variables).statement()


def rewrite_expression(text: str, variables: dict | None = None) -> str:
    r = Rewriter(text, variables)
    out = r.expression()
    if r.i < len(r.t):
        raise Unsupported(f"unexpected {r.peek()[1]!r} after an expression")
    return out
