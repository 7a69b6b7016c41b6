"""A session: views, user variables, prepared statements, stored SQL functions, table changes by statement."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import functions, sources
from .changes import Changes
from .operators.dml import VersionedTable
from .plans.procedures import Interpreter, Procedure, parse_procedure, split_commas
from .plans.rewrite import Rewriter, Unsupported, rewrite, rewrite_expression


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """The settings that results depend on, and adaptive execution."""
    return builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.ansi.enabled", "true").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")


class Session(Changes):
    """Runs MySQL-flavoured SQL on Spark. Queries return DataFrames; other statements act and return an empty or a listing DataFrame."""

    def __init__(self, spark: SparkSession, warehouse: str | None = None):
        self.spark, self.warehouse = spark, warehouse
        self.variables: dict = {}
        self.prepared: dict[str, str] = {}
        self.tables: dict[str, VersionedTable] = {}
        self.procedures: dict[str, Procedure] = {}
        self.triggers: dict[str, tuple[str, str, str, str]] = {}
        functions.register(spark)
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def query(self, sql: str) -> DataFrame:
        return self.spark.sql(rewrite(sql, self.variables))

    def sql(self, text: str, args: list | None = None) -> DataFrame:
        """One statement. args fill its question marks."""
        text = text.strip().rstrip(";")
        for pattern, act in self._statements():
            if m := re.fullmatch(pattern, text, re.I | re.S):
                return act(**m.groupdict()) or self._empty()
        query = rewrite(text, self.variables)
        return self.spark.sql(query, args=args) if args else self.spark.sql(query)

    def run(self, text: str, variables: dict) -> DataFrame:
        """A statement under other variables: those of a procedure."""
        before, self.variables = self.variables, variables
        try:
            return self.sql(text)
        finally:
            self.variables = before

    def _create_procedure(self, name, params, body):
        self.procedures[name.lower()] = parse_procedure(name, params, body)

    def _drop_procedure(self, name):
        self.procedures.pop(name.lower(), None)

    def _call(self, name, args):
        if name.lower() not in self.procedures:
            raise Unsupported(f"no procedure {name}")
        return Interpreter(self, self.procedures).call(name, [a.strip() for a in split_commas(args)] if args.strip() else [])

    def _create_trigger(self, trigger, when, event, name, body):
        self.triggers[trigger.lower()] = (when.upper(), event.upper(), name.lower(), body)

    def _drop_trigger(self, name):
        self.triggers.pop(name.lower(), None)

    def _empty(self) -> DataFrame:
        return self.spark.createDataFrame([], "ok int")

    def _statements(self):
        name = r"`?(?P<name>\w+)`?"
        return (
            (r"SET\s+@(?P<var>\w+)\s*:?=\s*(?P<value>.+)", self._set),
            (rf"PREPARE\s+{name}\s+FROM\s+(?P<body>'.*'|\".*\")", self._prepare),
            (rf"EXECUTE\s+{name}(?:\s+USING\s+(?P<using>.+))?", self._execute),
            (rf"(?:DEALLOCATE|DROP)\s+PREPARE\s+{name}", self._deallocate),
            (rf"CREATE\s+(?P<replace>OR\s+REPLACE\s+)?VIEW\s+{name}\s+AS\s+(?P<body>.+)", self._create_view),
            (rf"DROP\s+VIEW\s+(?:IF\s+EXISTS\s+)?{name}", self._drop_view),
            (rf"CREATE\s+TEMPORARY\s+TABLE\s+{name}\s+(?:AS\s+)?(?P<body>SELECT.+)", self._create_view),
            (rf"CREATE\s+TABLE\s+(?P<exists>IF\s+NOT\s+EXISTS\s+)?{name}\s+(?:AS\s+)?(?P<body>SELECT.+)", self._create_as),
            (rf"CREATE\s+TABLE\s+(?P<exists>IF\s+NOT\s+EXISTS\s+)?{name}\s*\((?P<body>.+)\)[^)]*", self._create_table),
            (r"DROP\s+TABLE\s+(?P<exists>IF\s+EXISTS\s+)?(?P<names>[\w`,\s]+)", self._drop_tables),
            (rf"TRUNCATE\s+(?:TABLE\s+)?{name}", self._truncate),
            (rf"(?P<verb>INSERT|INSERT\s+IGNORE|REPLACE)\s+INTO\s+{name}\s*(?:\((?P<columns>[\w`,\s]*)\))?\s*(?P<body>(?:VALUES|SELECT).+?)(?:\s+ON\s+DUPLICATE\s+KEY\s+UPDATE\s+(?P<changes>.+))?", self._insert),
            (rf"(?P<verb>INSERT|INSERT\s+IGNORE|REPLACE)\s+INTO\s+{name}\s+SET\s+(?P<body>.+?)(?:\s+ON\s+DUPLICATE\s+KEY\s+UPDATE\s+(?P<changes>.+))?", self._insert_set),
            (r"UPDATE\s+(?P<refs>.+?)\s+SET\s+(?P<body>.+)", self._update),
            (r"DELETE\s+(?P<targets>(?!FROM\b)[\w`.,\s*]+?)\s+FROM\s+(?P<refs>.+?)(?:\s+WHERE\s+(?P<where>.+))?", self._delete_joined),
            (r"DELETE\s+FROM\s+(?P<targets>[\w`.,\s*]+?)\s+USING\s+(?P<refs>.+?)(?:\s+WHERE\s+(?P<where>.+))?", self._delete_joined),
            (rf"DELETE\s+FROM\s+{name}(?P<body>\s+(?:WHERE|ORDER|LIMIT)\b.+)?", self._delete),
            (rf"CREATE\s+(?P<unique>UNIQUE\s+)?INDEX\s+`?(?P<index>\w+)`?\s+ON\s+{name}\s*\((?P<columns>.+)\)", self._create_index),
            (rf"DROP\s+INDEX\s+`?(?P<index>\w+)`?\s+ON\s+{name}", self._drop_index),
            (r"RENAME\s+TABLE\s+(?P<body>.+)", self._rename),
            (rf"SHOW\s+CREATE\s+TABLE\s+{name}", self._show_create),
            (rf"SHOW\s+(?:INDEX|INDEXES|KEYS)\s+FROM\s+{name}", self._show_index),
            (r"SHOW\s+(?:GLOBAL\s+|SESSION\s+)?(?:VARIABLES|STATUS)(?:\s+.+)?", lambda: self.spark.createDataFrame([], "Variable_name string, Value string")),
            (r"SHOW\s+(?:WARNINGS|ERRORS)", lambda: self.spark.createDataFrame([], "Level string, Code int, Message string")),
            # each statement commits itself, so there is nothing to begin, to commit or to lock
            (r"BEGIN|START\s+TRANSACTION|COMMIT|SET\s+(?:SESSION\s+|GLOBAL\s+|@@)?(?:autocommit|NAMES|sql_mode|foreign_key_checks|TRANSACTION)\b.*|(?:UN)?LOCK\s+TABLES.*|FLUSH\s+.+|USE\s+\w+|(?:CHECK|OPTIMIZE)\s+TABLE\s+\w+", lambda: None),
            (rf"ALTER\s+TABLE\s+{name}\s+(?P<body>.+)", self._alter),
            (rf"CREATE\s+FUNCTION\s+{name}\s*\((?P<params>.*?)\)\s*RETURNS\s+(?P<kind>\w+(?:\([\d,]+\))?)(?:\s+DETERMINISTIC)?\s+RETURN\s+(?P<body>.+)", self._create_function),
            (rf"CREATE\s+PROCEDURE\s+{name}\s*\((?P<params>[^()]*(?:\([^()]*\)[^()]*)*)\)\s*(?P<body>.+)", self._create_procedure),
            (rf"DROP\s+PROCEDURE\s+(?:IF\s+EXISTS\s+)?{name}", self._drop_procedure),
            (rf"CALL\s+{name}\s*\((?P<args>.*)\)", self._call),
            (rf"CREATE\s+TRIGGER\s+(?P<trigger>\w+)\s+(?P<when>BEFORE|AFTER)\s+(?P<event>INSERT|UPDATE|DELETE)\s+ON\s+{name}\s+FOR\s+EACH\s+ROW\s+(?P<body>.+)", self._create_trigger),
            (rf"DROP\s+TRIGGER\s+(?:IF\s+EXISTS\s+)?{name}", self._drop_trigger),
            (rf"DROP\s+FUNCTION\s+(?:IF\s+EXISTS\s+)?{name}", self._drop_function),
            (r"SHOW\s+(?:FULL\s+)?TABLES", lambda: sources.tables(self.spark)),
            (r"SHOW\s+(?:DATABASES|SCHEMAS)", lambda: sources.schemata(self.spark)),
            (r"SHOW\s+(?:STORAGE\s+)?ENGINES", lambda: sources.engines(self.spark)),
            (rf"(?:DESCRIBE|DESC|SHOW\s+(?:FULL\s+)?(?:COLUMNS|FIELDS)\s+FROM)\s+{name}", lambda name: sources.columns(self.spark, (name,))),
            (r"EXPLAIN\s+(?P<body>(?:SELECT|WITH).+)", lambda body: self.spark.sql(f"EXPLAIN FORMATTED {rewrite(body, self.variables)}")),
            (r"DO\s+(?P<body>.+)", lambda body: self.spark.sql(f"SELECT {rewrite_expression(body, self.variables)}").collect() and None),
            (rf"ANALYZE\s+TABLE\s+{name}", lambda name: self.spark.sql(f"SELECT '{name}' AS table_name, count(*) AS table_rows FROM {name}")),
        )

    # variables and prepared statements
    def _set(self, var, value):
        self.variables[var.lower()] = self.spark.sql(f"SELECT {rewrite_expression(value, self.variables)} AS v").first()["v"]

    def _prepare(self, name, body):
        self.prepared[name.lower()] = body[1:-1].replace("''", "'")

    def _execute(self, name, using):
        args = [self.variables.get(v.strip().lstrip("@").lower()) for v in using.split(",")] if using else None
        return self.sql(self.prepared[name.lower()], args)

    def _deallocate(self, name):
        del self.prepared[name.lower()]

    # views and functions
    def _create_view(self, name, body, replace=None):
        self.query(body).createOrReplaceTempView(name)

    def _drop_view(self, name):
        self.spark.catalog.dropTempView(name)

    def _create_function(self, name, params, kind, body):
        pairs = [p.split() for p in params.split(",") if p.strip()]
        spec = ", ".join(f"{p} {Rewriter(' '.join(t)).type_()}" for p, *t in pairs)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({spec}) RETURNS {Rewriter(kind).type_()} RETURN {rewrite_expression(body, self.variables)}")

    def _drop_function(self, name):
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")

    # tables
    def _path(self, name):
        if not self.warehouse:
            raise Unsupported("table changes need a session with a warehouse folder")
        return f"{self.warehouse}/{name.lower()}"

    def _table(self, name) -> VersionedTable:
        if name.lower() not in self.tables:
            t = VersionedTable(self.spark, self._path(name))
            if not t.exists():
                raise Unsupported(f"no table {name}")
            self.tables[name.lower()] = t
        return self.tables[name.lower()]

    def _changed(self, name):
        self._table(name).read().createOrReplaceTempView(name)

    def _create_table(self, name, body, exists=None):
        fields, keys, not_null, auto, unique, defaults, indexes = [], [], [], None, {}, {}, {}
        for part in re.split(r",(?![^(]*\))", body):
            part = part.strip()
            if m := re.match(r"(?:CONSTRAINT\s+\w+\s+)?(PRIMARY\s+KEY|UNIQUE(?:\s+KEY)?(?:\s+\w+)?)\s*\((.+?)\)", part, re.I):
                own = [c.strip(" `") for c in m[2].split(",")]
                if m[1].upper().startswith("PRIMARY"):
                    keys = own
                else:
                    words = m[1].split()
                    unique[words[-1].strip("`") if words[-1].upper() not in ("UNIQUE", "KEY", "INDEX") else own[0]] = own
                continue
            if m := re.match(r"(?:KEY|INDEX)\s+`?(\w+)`?\s*\((.+)\)", part, re.I):
                indexes[m[1]] = [c.strip(" `") for c in m[2].split(",")]
                continue
            if re.match(r"(?:CONSTRAINT|FOREIGN|CHECK|KEY|INDEX)\b", part, re.I):
                continue  # foreign keys and checks aren't enforced
            column, rest = part.split(None, 1)
            column = column.strip("`")
            r = Rewriter(re.sub(r"\b(ENUM|SET)\s*\(.*?\)", "TEXT", rest, flags=re.I))
            fields.append(f"`{column}` {self._type(r)}")
            if re.search(r"\bUNIQUE\b", rest, re.I):
                unique[column] = [column]
            if m := re.search(r"\bDEFAULT\s+('(?:[^'\\]|''|\\.)*'|\((?:[^()]|\([^()]*\))*\)|[-+\w.]+(?:\(\d*\))?)", rest, re.I):
                defaults[column] = m[1]
            if re.search(r"PRIMARY\s+KEY", rest, re.I):
                keys = [column]
            if re.search(r"NOT\s+NULL", rest, re.I):
                not_null.append(column)
            if re.search(r"AUTO_INCREMENT", rest, re.I):
                auto = column
        self.tables[name.lower()] = VersionedTable.create(self.spark, self._path(name), ", ".join(fields), keys, [c for c in not_null if c != auto], auto, bool(exists), {"unique": unique, "defaults": defaults, "indexes": indexes})
        self._changed(name)

    #: Column types; names that CAST shares are in the rewriter.
    DDL = {"tinyint": "tinyint", "smallint": "smallint", "year": "smallint", "mediumint": "int", "int": "int", "integer": "int", "serial": "bigint", "fixed": "double", "blob": "binary", "longblob": "binary", "varbinary": "binary", "tinytext": "string", "mediumtext": "string", "longtext": "string", "time": "string", "bit": "bigint", "point": "binary", "geometry": "binary"}

    def _type(self, r: Rewriter) -> str:
        first = r.word()
        if first == "bigint" and any(t[1].lower() == "unsigned" for t in r.t):
            return "decimal(20,0)"
        return self.DDL[first] if first in self.DDL else r.type_()

    def _create_as(self, name, body, exists=None):
        df = self.query(body)
        t = VersionedTable.create(self.spark, self._path(name), df.schema, if_not_exists=bool(exists))
        self.tables[name.lower()] = t
        t.insert(df)
        self._changed(name)

    def _drop_tables(self, names, exists=None):
        for name in names.split(","):
            self._drop_table(name.strip(" `\n\t"), exists)

    def _drop_table(self, name, exists=None):
        if exists and not VersionedTable(self.spark, self._path(name)).exists():
            return
        self._table(name).drop()
        del self.tables[name.lower()]
        self.spark.catalog.dropTempView(name)

    def _truncate(self, name):
        self._table(name).delete()
        self._changed(name)

    def _assignments(self, text, columns, old="", new=""):
        """name = expression, ..; VALUES(x) is the new row's x."""
        from pyspark.sql import functions as F

        r, out = Rewriter(re.sub(r"\bVALUES\s*\(\s*`?(\w+)`?\s*\)", r"n.\1", text, flags=re.I), self.variables), {}
        while r.i < len(r.t):
            name = r.name().strip("`")
            if r.op("."):
                r.i += 1
                name = r.name().strip("`")
            r.want("=")
            body = r.expression()
            if old:
                body = re.sub(r"(?<![\w.'`])(" + "|".join(map(re.escape, columns)) + r")\b(?!\s*[(.])", rf"{old}.\1", body)
            out[name] = F.expr(body)
            if r.op(","):
                r.i += 1
        return out

    def _insert(self, verb, name, columns, body, changes):
        from pyspark.sql import functions as F

        t = self._table(name)
        table, defaults = t.read(), t._state().get("defaults", {})
        names = [c.strip(" `") for c in columns.split(",")] if columns and columns.strip() else table.columns
        if columns is not None and not columns.strip() or re.fullmatch(r"VALUES\s*\(\s*\)", body, re.I):  # a row of defaults
            body = "VALUES (" + ", ".join(["DEFAULT"] * len(names)) + ")"
        if re.match("VALUES", body, re.I):
            if re.search(r"\bDEFAULT\b", body, re.I):
                body = self._with_defaults(name, names, body)
            body = re.sub(r"^VALUES", "SELECT * FROM VALUES", body, flags=re.I)
        rows = self.query(body)
        verb = re.sub(r"\s+", " ", verb.upper())
        full = rows.toDF(*names).select(*[(F.col(f.name) if f.name in names else F.expr(rewrite_expression(defaults.get(f.name, "NULL")))).cast(f.dataType).alias(f.name) for f in table.schema])
        if self._has("INSERT", name):
            fired = self._fire("BEFORE", "INSERT", name, full.toDF(*[f"NEW_{c}" for c in full.columns]))
            full = fired.select(*[F.col(f"NEW_{c}").alias(c) for c in table.columns])
        if changes:
            t.upsert(full, self._assignments(changes, table.columns, old="t"))
        elif verb == "REPLACE":
            t.replace(full)
        elif verb == "INSERT IGNORE":
            t.insert_ignore(full)
        else:
            t.insert(full)
        self._changed(name)
        state = functions.session.STATE
        state["row_count"] = full.count()
        if t._state()["auto_increment"] and not changes:
            state["last_insert_id"] = t._state()["next"] - state["row_count"]
        self._fire("AFTER", "INSERT", name, full.toDF(*[f"NEW_{c}" for c in full.columns]))

    def _alter(self, name, body):
        from .operators import dml

        t = self._table(name)
        word = r"`?(\w+)`?"
        if m := re.fullmatch(rf"ADD\s+(?:COLUMN\s+)?(?!(?:CONSTRAINT|UNIQUE|INDEX|KEY|PRIMARY|FOREIGN)\b){word}\s+(.+?)(?:\s+DEFAULT\s+(\S+))?(?:\s+AFTER\s+{word})?", body, re.I):
            default = self.spark.sql(f"SELECT {rewrite_expression(m[3])} AS v").first()["v"] if m[3] else None
            t.alter(lambda d: dml.add_column(d, m[1], self._type(Rewriter(m[2])), default, m[4]))
        elif m := re.fullmatch(rf"DROP\s+(?:COLUMN\s+)?(?!(?:INDEX|KEY|PRIMARY)\b){word}", body, re.I):
            t.alter(lambda d: dml.drop_column(d, m[1]))
        elif m := re.fullmatch(rf"MODIFY\s+(?:COLUMN\s+)?{word}\s+(.+)", body, re.I):
            t.alter(lambda d: dml.change_column(d, m[1], m[1], self._type(Rewriter(m[2]))))
        elif m := re.fullmatch(rf"CHANGE\s+(?:COLUMN\s+)?{word}\s+{word}\s+(.+)", body, re.I):
            t.alter(lambda d: dml.change_column(d, m[1], m[2], self._type(Rewriter(m[3]))))
        elif m := re.fullmatch(rf"RENAME\s+COLUMN\s+{word}\s+TO\s+{word}", body, re.I):
            t.alter(lambda d: dml.rename_column(d, m[1], m[2]))
        elif m := re.fullmatch(r"ADD\s+(?:CONSTRAINT\s+\w+\s+)?PRIMARY\s+KEY\s*\((.+)\)", body, re.I):
            t.alter(lambda d: d, keys=[c.strip(" `") for c in m[1].split(",")])
        elif m := re.fullmatch(rf"RENAME\s+(?:TO\s+|AS\s+)?{word}", body, re.I):
            return self._rename(f"{name} TO {m[1]}")
        elif m := re.fullmatch(rf"ADD\s+(?:CONSTRAINT\s+\w+\s+)?(UNIQUE\s*)?(?:INDEX|KEY)?\s*{word}?\s*\((.+)\)", body, re.I):
            return self._create_index(name, m[2] or m[3].split(",")[0].strip(" `"), m[3], m[1])
        elif m := re.fullmatch(rf"DROP\s+(?:INDEX|KEY)\s+{word}", body, re.I):
            return self._drop_index(name, m[1])
        elif m := re.fullmatch(rf"ALTER\s+(?:COLUMN\s+)?{word}\s+(?:SET\s+DEFAULT\s+(.+)|DROP\s+DEFAULT)", body, re.I):
            kept = {k: v for k, v in t._state().get("defaults", {}).items() if k != m[1]}
            t.alter(lambda d: d, defaults={**kept, m[1]: m[2]} if m[2] else kept)
        elif re.fullmatch(r"DROP\s+PRIMARY\s+KEY", body, re.I):
            t.alter(lambda d: d, keys=[])
        else:
            raise Unsupported(f"ALTER TABLE .. {body}")
        self._changed(name)
