"""Statements that change tables by way of joins, orders, defaults, unique keys, indexes and triggers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import dml
from .plans.procedures import split_commas
from .plans.rewrite import Rewriter, Unsupported, rewrite_expression

STRING = r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\""
NAME = r"`?(\w+)`?"


def outside_strings(pattern: str, put, text: str) -> str:
    """re.sub where string literals are passed over; put takes the match of pattern."""
    return re.sub(f"({STRING})|(?:{pattern})", lambda m: m[0] if m[1] else put(m), text, flags=re.I | re.S)


def clauses(text: str) -> tuple[str, dict[str, str]]:
    """What stands before WHERE, ORDER BY and LIMIT at the outer level, and these clauses."""
    marks, depth = [], 0
    for m in re.finditer(rf"{STRING}|[()]|\b(WHERE|ORDER\s+BY|LIMIT)\b", text, re.I | re.S):
        depth += (m[0] == "(") - (m[0] == ")")
        if m[1] and not depth:
            marks.append((m.start(), m.end(), re.sub(r"\s+", " ", m[1].lower())))
    ends = [a for a, _, _ in marks[1:]] + [len(text)]
    return text[: marks[0][0] if marks else None].strip(), {k: text[b:e].strip() for (_, b, k), e in zip(marks, ends)}


def ordering(text: str | None, variables: dict) -> list:
    out = []
    for part in split_commas(text) if text else []:
        m = re.fullmatch(r"(.+?)(?:\s+(ASC|DESC))?", part.strip(), re.I | re.S)
        c = F.expr(rewrite_expression(m[1], variables))
        out.append(c.desc() if (m[2] or "").upper() == "DESC" else c.asc())
    return out


class Changes:
    """The part of a session that changes tables."""

    # rows with identity
    def _marked(self, name: str) -> DataFrame:
        """The table with __id, a row's place in its files, which a recomputed task finds again."""
        t = self._table(name).read()
        return t.select("*", F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("__id"))

    def _references(self, text: str) -> dict[str, str]:
        """Alias: table of the tables in a FROM clause."""
        out = {}
        for m in re.finditer(rf"(?:^|,|\bJOIN\b)\s*{NAME}(?:\s+(?:AS\s+)?(?!ON\b|USING\b|JOIN\b|INNER\b|LEFT\b|RIGHT\b|CROSS\b|NATURAL\b|SET\b){NAME})?", text, re.I):
            out[(m[2] or m[1]).lower()] = m[1]
        return out

    def _joined(self, targets: list[str], sql: str) -> DataFrame:
        """A query in which the target tables have __id."""
        for name in targets:
            self._marked(name).createOrReplaceTempView(name)
        try:
            return self.query(sql)
        finally:
            for name in targets:
                self._changed(name)

    def _update_joined(self, refs, changes, where):
        tables = self._references(refs)
        parsed = []
        for part in split_commas(changes):
            m = re.fullmatch(rf"(?:{NAME}\.)?{NAME}\s*=\s*(.+)", part.strip(), re.I | re.S)
            owner = m[1].lower() if m[1] else next((a for a, t in tables.items() if t.lower() in self._known() and m[2].lower() in [c.lower() for c in self._table(t).read().columns]), None)
            if owner not in tables:
                raise Unsupported(f"UPDATE: no table for {part.strip()!r}")
            parsed.append((owner, m[2], m[3]))
        done = {}
        for alias in dict.fromkeys(p[0] for p in parsed):
            own = [(c, e) for a, c, e in parsed if a == alias]
            sql = f"SELECT {alias}.__id AS __hit, {', '.join(f'{e} AS __c{i}' for i, (_, e) in enumerate(own))} FROM {refs}" + (f" WHERE {where}" if where else "")
            hits = self._joined([tables[alias]], sql).dropDuplicates(["__hit"])  # a row changes once, whatever the number of its partners
            both = self._marked(tables[alias]).join(hits, F.col("__id") == F.col("__hit"), "left")
            schema, at = both.schema, {c.lower(): f"__c{i}" for i, (c, _) in enumerate(own)}
            names = self._table(tables[alias]).read().columns
            done[tables[alias]] = both.select(*[F.when(F.col("__hit").isNotNull(), F.col(at[c.lower()])).otherwise(F.col(c)).cast(schema[c].dataType).alias(c) if c.lower() in at else F.col(c) for c in names])
        for name, df in done.items():  # every right side has seen the old rows
            self._table(name).write(df)
            self._changed(name)

    def _delete_joined(self, targets, refs, where):
        tables, left = self._references(refs), {}
        for target in (x.strip(" `").split(".")[0].strip("`").lower() for x in targets.split(",")):
            name = tables[target]
            gone = self._joined([name], f"SELECT DISTINCT {target}.__id AS __hit FROM {refs}" + (f" WHERE {where}" if where else ""))
            left[name] = self._marked(name).join(gone, F.col("__id") == F.col("__hit"), "left_anti").drop("__id")
        for name, df in left.items():
            self._table(name).write(df)
            self._changed(name)

    # UPDATE and DELETE of one table
    def _known(self) -> set[str]:
        return set(self.tables)

    def _update(self, refs, body):
        changes, rest = clauses(body)
        where = rest.get("where")
        if re.search(r",|\bJOIN\b", refs, re.I):
            if "limit" in rest or "order by" in rest:
                raise Unsupported("UPDATE of several tables has no ORDER BY and LIMIT")
            return self._update_joined(refs, changes, where)
        alias, name = next(iter(self._references(refs).items()))
        t, old = self._table(name), self._table(name).read()
        strip = lambda s: outside_strings(rf"\b(?:{alias}|{name})\s*\.\s*(?=`?\w)", lambda m: "", s)
        sets = self._assignments(strip(changes), old.columns)
        hit = F.expr(rewrite_expression(strip(where), self.variables)) if where else F.lit(True)
        if "limit" in rest:
            chosen = dml._chosen(old, hit, ordering(rest.get("order by"), self.variables), int(rest["limit"]))
        else:
            chosen = old.withColumn("__hit", F.coalesce(hit, F.lit(False)))
        new = [(sets[c] if c in sets else F.col(c)).cast(f.dataType).alias(f"NEW_{c}") for c, f in zip(old.columns, old.schema)]
        rows = chosen.where("__hit").select(*[F.col(c).alias(f"OLD_{c}") for c in old.columns], *new)
        if self._has("UPDATE", name):
            rows = self._fire("BEFORE", "UPDATE", name, rows)
            t.write(chosen.where("NOT __hit").drop("__hit").unionByName(rows.select(*[F.col(f"NEW_{c}").alias(c) for c in old.columns])))
        else:
            t.write(chosen.select(*[F.when(F.col("__hit"), sets[c]).otherwise(F.col(c)).cast(f.dataType).alias(c) if c in sets else F.col(c) for c, f in zip(old.columns, old.schema)]))
        self._changed(name)
        self._fire("AFTER", "UPDATE", name, rows)

    def _delete(self, name, body=None):
        _, rest = clauses(body or "")
        t, old = self._table(name), self._table(name).read()
        where = rest.get("where")
        strip = lambda s: outside_strings(rf"\b{name}\s*\.\s*(?=`?\w)", lambda m: "", s)
        hit = F.expr(rewrite_expression(strip(where), self.variables)) if where else F.lit(True)
        if "limit" in rest:
            chosen = dml._chosen(old, hit, ordering(rest.get("order by"), self.variables), int(rest["limit"]))
        else:
            chosen = old.withColumn("__hit", F.coalesce(hit, F.lit(False)))
        gone = chosen.where("__hit").select(*[F.col(c).alias(f"OLD_{c}") for c in old.columns])
        self._fire("BEFORE", "DELETE", name, gone)
        t.write(chosen.where("NOT __hit").drop("__hit"))
        self._changed(name)
        self._fire("AFTER", "DELETE", name, gone)

    # triggers
    def _has(self, event: str, name: str) -> bool:
        return any((e, table) == (event, name.lower()) for _, e, table, _ in self.triggers.values())

    def _fire(self, when: str, event: str, name: str, rows: DataFrame) -> DataFrame:
        """Row triggers of a change over its rows as a set, which have the columns NEW_x and OLD_x: SET NEW.x = .. changes the rows; an INSERT into another table runs once, reading the rows."""
        for w, e, table, body in self.triggers.values():
            if (w, e, table) != (when, event, name.lower()):
                continue
            body = re.sub(r"^\s*BEGIN\b|\bEND\s*;?\s*$", "", body, flags=re.I)
            for text in re.findall(rf"(?:{STRING}|[^;'\"])+", body):
                text = outside_strings(r"\b(NEW|OLD)\s*\.\s*`?(\w+)`?", lambda m: f"{m[2].upper()}_{m[3]}", text.strip())
                if m := re.fullmatch(r"SET\s+(NEW_\w+)\s*:?=\s*(.+)", text, re.I | re.S):
                    if when != "BEFORE":
                        raise Unsupported("SET NEW needs a BEFORE trigger")
                    rows = rows.withColumn(m[1], F.expr(rewrite_expression(m[2], self.variables)).cast(rows.schema[m[1]].dataType))
                elif m := re.fullmatch(r"INSERT\s+INTO\s+(\w+)\s*(\([\w,\s`]+\))?\s*VALUES\s*\((.+)\)", text, re.I | re.S):
                    if m[1].lower() == name.lower():
                        raise Unsupported("a trigger can't change the table that it stands on")
                    rows.createOrReplaceTempView("__rows")
                    self.sql(f"INSERT INTO {m[1]} {m[2] or ''} SELECT {m[3]} FROM __rows")
                elif text:
                    raise Unsupported(f"trigger statement {text[:40]!r}")
        return rows

    # INSERT
    def _default(self, name: str, column: str) -> str:
        return self._table(name)._state().get("defaults", {}).get(column, "NULL")

    def _insert_set(self, verb, name, body, changes=None):
        pairs = [re.fullmatch(rf"{NAME}\s*=\s*(.+)", p.strip(), re.I | re.S) for p in split_commas(body)]
        values = ", ".join(m[2] for m in pairs)
        self._insert(verb, name, ", ".join(m[1] for m in pairs), f"VALUES ({values})", changes)

    def _with_defaults(self, name: str, names: list[str], body: str) -> str:
        """VALUES whose DEFAULT items are the columns' defaults."""
        rows, depth, start = [], 0, 0
        for m in re.finditer(rf"{STRING}|[()]", body, re.S):
            depth += (m[0] == "(") - (m[0] == ")")
            if m[0] == "(" and depth == 1:
                start = m.end()
            elif m[0] == ")" and depth == 0:
                items = [x.strip() for x in split_commas(body[start : m.start()])]
                rows.append("(" + ", ".join(self._default(name, c) if x.upper() == "DEFAULT" else x for c, x in zip(names, items)) + ")")
        return "VALUES " + ", ".join(rows)

    # indexes and names
    def _create_index(self, name, index, columns, unique=None):
        state = self._table(name)._state()
        keys = [c.strip(" `").split("(")[0].split()[0] for c in columns.split(",")]
        t = self._table(name)
        if unique:
            t.write(t.read(), unique={**state.get("unique", {}), index: keys})
        else:
            t.write(t.read(), indexes={**state.get("indexes", {}), index: keys})
        self._changed(name)

    def _drop_index(self, name, index):
        state, t = self._table(name)._state(), self._table(name)
        found = {k: {i: c for i, c in state.get(k, {}).items() if i != index} for k in ("unique", "indexes")}
        if found["unique"] == state.get("unique", {}) and found["indexes"] == state.get("indexes", {}):
            raise Unsupported(f"no index {index} on {name}")
        t.write(t.read(), **found)
        self._changed(name)

    def _rename(self, body):
        for part in body.split(","):
            m = re.fullmatch(rf"\s*{NAME}\s+TO\s+{NAME}\s*", part, re.I)
            old, new = self._table(m[1]), m[2]
            old.move(self._path(new))
            self.tables.pop(m[1].lower(), None)
            self.spark.catalog.dropTempView(m[1])
            self._changed(new)

    def _show_index(self, name):
        state = self._table(name)._state()
        every = {**({"PRIMARY": state["keys"]} if state["keys"] else {}), **state.get("unique", {}), **state.get("indexes", {})}
        rows = [(name, int(i in state.get("indexes", {})), i, k, c) for i, keys in every.items() for k, c in enumerate(keys, 1)]
        return self.spark.createDataFrame(rows, "`Table` string, Non_unique int, Key_name string, Seq_in_index int, Column_name string")

    def _show_create(self, name):
        t, state = self._table(name), self._table(name)._state()
        lines = []
        for f in t.read().schema:
            null = " NOT NULL" if f.name in {*state["not_null"], *state["keys"]} else ""
            default = f" DEFAULT {state['defaults'][f.name]}" if f.name in state.get("defaults", {}) else ""
            lines.append(f"  `{f.name}` {f.dataType.simpleString()}{null}{default}{' AUTO_INCREMENT' if f.name == state['auto_increment'] else ''}")
        quoted = lambda keys: ", ".join(f"`{c}`" for c in keys)
        lines += [f"  PRIMARY KEY ({quoted(state['keys'])})"] if state["keys"] else []
        lines += [f"  UNIQUE KEY `{i}` ({quoted(k)})" for i, k in state.get("unique", {}).items()] + [f"  KEY `{i}` ({quoted(k)})" for i, k in state.get("indexes", {}).items()]
        return self.spark.createDataFrame([(name, f"CREATE TABLE `{name}` (\n" + ",\n".join(lines) + "\n)")], "`Table` string, `Create Table` string")

    def _types_of(self, text: str) -> str:
        return self._type(Rewriter(text))
