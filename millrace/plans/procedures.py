"""Stored procedures: a small interpreter on the driver. Statements run as Spark queries one after the other; variables are single values."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .rewrite import Unsupported, rewrite_expression

WORD = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|[A-Za-z_@]\w*|\s+|.", re.S)


@dataclass
class Procedure:
    name: str
    params: list[tuple[str, str]]  # mode, name
    body: list


class Return(Exception):
    pass


class Leave(Exception):
    pass


class Iterate(Exception):
    pass


@dataclass
class Parser:
    """Blocks of statements: nested lists of (kind, ..) tuples."""

    words: list[str]
    i: int = 0
    ends: tuple = field(default=())

    @classmethod
    def of(cls, text: str) -> Parser:
        return cls(WORD.findall(text))

    def skip(self) -> None:
        while self.i < len(self.words) and (self.words[self.i].isspace() or self.words[self.i] == ";"):
            self.i += 1

    def upper(self) -> str:
        self.skip()
        return self.words[self.i].upper() if self.i < len(self.words) else ""

    def take(self) -> str:
        self.skip()
        self.i += 1
        return self.words[self.i - 1]

    def until(self, *stops: str) -> str:
        """Text up to a word of stops outside of parentheses and CASE .. END; the stop is passed over."""
        out, depth, cases = [], 0, 0
        while self.i < len(self.words):
            w = self.words[self.i]
            self.i += 1
            up = w.upper()
            if not depth and not cases and up in stops:
                return "".join(out).strip()
            depth += (w == "(") - (w == ")")
            cases += (up == "CASE") - (up == "END" and cases > 0)
            out.append(w)
        return "".join(out).strip()

    def block(self, *stops: str) -> list:
        out = []
        while (w := self.upper()) and w not in stops:
            out.append(self.statement())
        return out

    def end(self, *words: str) -> None:
        for w in words:
            if self.upper() == w:
                self.take()

    def statement(self):
        w = self.take()
        up, label = w.upper(), None
        self.skip()
        if self.i < len(self.words) and self.words[self.i] == ":" and re.fullmatch(r"\w+", w):
            label = w.lower()
            self.i += 1
            up = self.take().upper()
        if up == "BEGIN":
            body = self.block("END")
            self.end("END")
            return ("block", body)
        if up == "DECLARE":
            text = self.until(";")
            if re.match(r"(CONTINUE|EXIT)\s+HANDLER", text, re.I):
                m = re.match(r"(CONTINUE|EXIT)\s+HANDLER\s+FOR\s+(.+?)\s+(SET\s+.+|BEGIN\b.*)$", text, re.I | re.S)
                if not m or not m[3].upper().startswith("SET"):
                    raise Unsupported("handlers with a single SET")
                return ("handler", m[2].upper(), Parser.of(m[3] + ";").statement())
            if m := re.match(r"(\w+)\s+CURSOR\s+FOR\s+(.+)$", text, re.I | re.S):
                return ("cursor", m[1].lower(), m[2])
            m = re.match(r"([\w,\s]+?)\s+(\w+(?:\s*\([\d,\s]+\))?)(?:\s+DEFAULT\s+(.+))?$", text, re.I | re.S)
            return ("declare", [n.strip().lower() for n in m[1].split(",")], m[3])
        if up == "SET":
            return ("set", [tuple(x.strip() for x in re.split(r":?=", p, maxsplit=1)) for p in split_commas(self.until(";"))])
        if up == "IF":
            arms, other = [(self.until("THEN"), self.block("ELSEIF", "ELSE", "END"))], []
            while self.upper() == "ELSEIF":
                self.take()
                arms.append((self.until("THEN"), self.block("ELSEIF", "ELSE", "END")))
            if self.upper() == "ELSE":
                self.take()
                other = self.block("END")
            self.end("END", "IF")
            return ("if", arms, other)
        if up == "CASE":
            subject = self.until("WHEN")
            arms, other = [], []
            while True:
                test = self.until("THEN")
                arms.append((f"({subject}) = ({test})" if subject else test, self.block("WHEN", "ELSE", "END")))
                if self.upper() != "WHEN":
                    break
                self.take()
            if self.upper() == "ELSE":
                self.take()
                other = self.block("END")
            self.end("END", "CASE")
            return ("if", arms, other)
        if up == "WHILE":
            test, body = self.until("DO"), self.block("END")
            self.end("END", "WHILE")
            return ("while", test, body, self.label(label))
        if up == "LOOP":
            body = self.block("END")
            self.end("END", "LOOP")
            return ("while", "TRUE", body, self.label(label))
        if up == "REPEAT":
            body = self.block("UNTIL")
            self.take()
            test = self.until("END")
            self.end("REPEAT")
            return ("repeat", test, body, self.label(label))
        if up in ("LEAVE", "ITERATE"):
            return (up.lower(), self.until(";").lower())
        if up in ("OPEN", "CLOSE"):
            return (up.lower(), self.until(";").lower())
        if up == "FETCH":
            m = re.match(r"(?:NEXT\s+)?(?:FROM\s+)?(\w+)\s+INTO\s+(.+)$", self.until(";"), re.I | re.S)
            return ("fetch", m[1].lower(), [n.strip().lower() for n in m[2].split(",")])
        if up == "RETURN":
            return ("return", self.until(";"))
        text = f"{w} {self.until(';')}"
        if m := re.match(r"(SELECT\s.+?)\sINTO\s+([\w@,\s]+?)(\sFROM\s.+)?$", text, re.I | re.S):
            return ("into", m[1] + (m[3] or ""), [n.strip().lower() for n in m[2].split(",")])
        return ("run", text)

    def label(self, label):
        if label and self.upper() == label.upper():
            self.take()
        return label


def split_commas(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


class Interpreter:
    def __init__(self, session, procedures: dict[str, Procedure], most_steps: int = 100_000):
        self.session, self.procedures, self.left = session, procedures, most_steps

    def filled(self, text: str, scope: dict) -> str:
        """Local variables as user variables, which the rewriter turns into literals."""
        return "".join(f"@__{w.lower()}" if w.lower() in scope else w for w in WORD.findall(text))

    def variables(self, scope: dict) -> dict:
        return {**self.session.variables, **{f"__{k}": v for k, v in scope.items()}}

    def value(self, text: str, scope: dict):
        e = rewrite_expression(self.filled(text, scope), self.variables(scope))
        return self.session.spark.sql(f"SELECT {e} AS v").first()["v"]

    def put(self, name: str, value, scope: dict) -> None:
        if name.startswith("@"):
            self.session.variables[name[1:].lower()] = value
        else:
            scope[name.lower()] = value

    def call(self, name: str, args: list[str]):
        """Runs a procedure; the DataFrame of its last query, if it has one."""
        p = self.procedures[name.lower()]
        if len(args) != len(p.params):
            raise Unsupported(f"{name} takes {len(p.params)} arguments")
        scope = {n: None if mode == "OUT" else self.value(a, {}) for (mode, n), a in zip(p.params, args)}
        state = {"result": None, "cursors": {}, "handlers": {}}
        try:
            self.block(p.body, scope, state)
        except Return:
            pass
        for (mode, n), a in zip(p.params, args):
            if mode != "IN" and a.strip().startswith("@"):
                self.put(a.strip(), scope[n], {})
        return state["result"]

    def block(self, body: list, scope: dict, state: dict) -> None:
        for s in body:
            self.step(s, scope, state)

    def loop(self, body, label, scope, state) -> bool:
        """Whether to go on."""
        try:
            self.block(body, scope, state)
        except Leave as x:
            if x.args[0] != label:
                raise
            return False
        except Iterate as x:
            if x.args[0] != label:
                raise
        return True

    def step(self, s, scope: dict, state: dict) -> None:
        self.left -= 1
        if self.left < 0:
            raise Unsupported("the procedure takes too many steps")
        kind = s[0]
        if kind == "block":
            self.block(s[1], scope, state)
        elif kind == "declare":
            for n in s[1]:
                scope[n] = None if s[2] is None else self.value(s[2], {k: v for k, v in scope.items() if k != n})
        elif kind == "set":
            for n, e in s[1]:
                self.put(n, self.value(e, scope), scope)
        elif kind == "if":
            self.block(next((b for test, b in s[1] if self.value(test, scope)), s[2]), scope, state)
        elif kind == "while":
            while self.value(s[1], scope) and self.loop(s[2], s[3], scope, state):
                pass
        elif kind == "repeat":
            while self.loop(s[2], s[3], scope, state) and not self.value(s[1], scope):
                pass
        elif kind == "leave":
            raise Leave(s[1])
        elif kind == "iterate":
            raise Iterate(s[1])
        elif kind == "return":
            raise Return
        elif kind == "handler":
            state["handlers"][s[1]] = s[2]
        elif kind == "cursor":
            state["cursors"][s[1]] = [s[2], None]
        elif kind == "open":
            c = state["cursors"][s[1]]
            c[1] = self.query(c[0], scope).toLocalIterator()
        elif kind == "close":
            state["cursors"][s[1]][1] = None
        elif kind == "fetch":
            row = next(state["cursors"][s[1]][1], None)
            if row is None:
                handler = next((h for k, h in state["handlers"].items() if "NOT FOUND" in k or "02000" in k), None)
                if handler is None:
                    raise Unsupported("no more rows, and no handler for NOT FOUND")
                self.step(handler, scope, state)
            else:
                for n, v in zip(s[2], row):
                    self.put(n, v, scope)
        elif kind == "into":
            rows = self.query(s[1], scope).take(2)
            if len(rows) > 1:
                raise Unsupported("SELECT INTO found more than one row")
            for n, v in zip(s[2], rows[0] if rows else ()):
                self.put(n, v, scope)
        elif m := re.match(r"CALL\s+(\w+)\s*\((.*)\)$", s[1], re.I | re.S):
            inner = [a.strip() for a in split_commas(m[2])] if m[2].strip() else []
            made = []
            for a in inner:
                if a.lower() in scope:
                    self.session.variables[f"__arg_{a.lower()}"] = scope[a.lower()]
                    made.append(f"@__arg_{a.lower()}")
                else:
                    made.append(a)
            state["result"] = self.call(m[1], made) or state["result"]
            for a in inner:
                if a.lower() in scope:
                    scope[a.lower()] = self.session.variables.pop(f"__arg_{a.lower()}")
        else:
            out = self.session.run(self.filled(s[1], scope), self.variables(scope))
            if re.match(r"(SELECT|WITH)\b", s[1], re.I):
                state["result"] = out

    def query(self, text: str, scope: dict):
        return self.session.run(self.filled(text, scope), self.variables(scope))


def parse_procedure(name: str, params: str, body: str) -> Procedure:
    spec = []
    for p in split_commas(params) if params.strip() else []:
        m = re.match(r"\s*(?:(INOUT|IN|OUT)\s+)?(\w+)\s", p + " ", re.I)
        spec.append(((m[1] or "IN").upper(), m[2].lower()))
    parsed = Parser.of(body.strip().rstrip(";") + ";").block()
    return Procedure(name.lower(), spec, parsed)
