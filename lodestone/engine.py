"""The SQL front: declarations and changes go to the catalog, everything else to Spark SQL.

Statements of a text run one by one; the last one's result is returned. Small results of queries that give the same rows each time are kept by their
text, within a bound of bytes, until any other statement runs.
"""

from __future__ import annotations

import re
import time
from collections import OrderedDict, deque

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import similar_pattern
from .operators.changes import delete_where, update_where
from .sources import files
from .sources.catalog import Catalog, EngineError
from .sources.types import parse_type

NAME = r'("[^"]+"|[A-Za-z_]\w*)'
#: What makes a query's rows differ from one run to the next though its plan is deterministic.
CLOCK = re.compile(r"\b(now|current_\w+|localtimestamp|unix_timestamp|curdate)\b", re.I)
KINDS = {"parquet": "parquet", "csv": "csv", "json": "json", "ndjson": "json", "orc": "orc", "text": "text", "arrow": "arrow"}


def split_outside(text: str, mark: str) -> list[str]:
    """Parts of the text between marks that are in no quotes and no brackets."""
    out, depth, quote, at = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == mark and not depth:
            out.append(text[at:i])
            at = i + 1
    out.append(text[at:])
    return [p.strip() for p in out if p.strip()]


def _bare(name: str) -> str:
    return name.strip().strip('"')


def _options(text: str | None) -> dict[str, str]:
    """(FORMAT csv, HEADER true) or ('k' 'v', ...) as a dict of lower-case names."""
    found = {}
    for part in split_outside(text or "", ","):
        name, _, value = part.strip().partition(" ")
        found[name.strip("'\"").lower()] = value.strip().strip("'\"") or "true"
    return found


class Engine:
    def __init__(self, spark: SparkSession, folder: str, cache_entries: int = 1024, slow_ms: float = 100, cache_bytes: int = 64 << 20) -> None:
        self.spark, self.catalog, self.cache_entries, self.slow_ms, self.cache_bytes = spark, Catalog(spark, folder), cache_entries, slow_ms, cache_bytes
        #: The last statements that took slow_ms or longer: (text, milliseconds). For queries that is the time to plan them.
        self.slow: deque[tuple[str, float]] = deque(maxlen=1000)
        self.settings: dict[str, str] = {}
        self._cache: OrderedDict[str, tuple[DataFrame, int]] = OrderedDict()

    def sql(self, text: str, params: list | dict | None = None) -> DataFrame:
        """params are bound by Spark: ? for a list, :name for a dict."""
        out = None
        for statement in split_outside(text, ";"):
            began = time.perf_counter()
            out = self._one(statement, params)
            if (took := (time.perf_counter() - began) * 1000) >= self.slow_ms:
                self.slow.append((statement, took))
        if out is None:
            raise EngineError("42601", "there is no statement")
        return out

    def _tag(self, tag: str) -> DataFrame:
        return self.spark.createDataFrame([(tag,)], "tag string")

    def _changed(self) -> None:
        for df, _ in self._cache.values():
            df.unpersist()
        self._cache.clear()

    def _one(self, s: str, params: list | dict | None) -> DataFrame:
        for pattern, run in self._forms():
            if m := re.fullmatch(pattern, s, re.I | re.S):
                out = run(m)
                if isinstance(out, tuple):  # rows that a change returns
                    self._changed()
                    return out[0]
                if isinstance(out, DataFrame):
                    return out
                if out != "SET":
                    self._changed()
                return self._tag(out)
        return self._query(s, params)

    def _spark_sql(self, s: str, params: list | dict | None = None) -> DataFrame:
        s = re.sub(r"\binformation_schema\.(tables|columns)\b", self._information, s, flags=re.I)
        # What Spark spells otherwise: SIMILAR TO, and quantified comparisons with a subquery.
        s = re.sub(r"\bsimilar\s+to\s+'((?:[^']|'')*)'", lambda m: f"RLIKE r'{similar_pattern(m[1])}'", s, flags=re.I)
        s = re.sub(r"=\s*(?:any|some)\s*\(\s*(?=select|with)", " IN (", s, flags=re.I)
        s = re.sub(r"(?:<>|!=)\s*all\s*\(\s*(?=select|with)", " NOT IN (", s, flags=re.I)
        try:
            return self.spark.sql(s, params) if params else self.spark.sql(s)
        except ParseException as e:
            raise EngineError("42601", str(e)) from e
        except AnalysisException as e:
            raise EngineError("42P01" if e.getCondition() == "TABLE_OR_VIEW_NOT_FOUND" else "42000", str(e)) from e

    def _information(self, m: re.Match) -> str:
        """Puts the schema's tables or columns in a view and returns its name."""
        name = f"lodestone_information_{m[1].lower()}"
        tables = self.catalog.tables.values()
        if m[1].lower() == "tables":
            rows = self.spark.createDataFrame([("lodestone", "public", t.name, "BASE TABLE") for t in tables], "table_catalog string, table_schema string, table_name string, table_type string")
        else:
            found = [("lodestone", "public", t.name, f.name, i + 1, f.metadata.get("default"), "YES" if f.nullable else "NO", f.dataType.simpleString()) for t in tables for i, f in enumerate(t.schema)]
            rows = self.spark.createDataFrame(found, "table_catalog string, table_schema string, table_name string, column_name string, ordinal_position int, column_default string, is_nullable string, data_type string")
        rows.createOrReplaceTempView(name)
        return name

    def _query(self, s: str, params: list | dict | None) -> DataFrame:
        if not re.match(r"\s*(select|with|values|from|explain|describe|desc|show)\b", s, re.I):
            self._changed()  # a view, say, may have another meaning now
            return self._spark_sql(s, params)
        if not params and s in self._cache:
            self._cache.move_to_end(s)
            return self._cache[s][0]
        df = self._spark_sql(s, params)
        if not params and re.match(r"\s*(select|with|values)\b", s, re.I) and not CLOCK.search(s):
            plan = df._jdf.queryExecution().optimizedPlan()
            size = int(plan.stats().sizeInBytes())
            if size <= self.cache_bytes and plan.deterministic():
                self._cache[s] = (df.persist(), size)
                while len(self._cache) > self.cache_entries or sum(n for _, n in self._cache.values()) > self.cache_bytes:
                    self._cache.popitem(last=False)[1][0].unpersist()
        return df

    _plain_update = rf"update\s+{NAME}\s+set\s+(.*?)(?:\s+where\s+(.*?))?(?:\s+returning\s+(.*))?"

    def _forms(self):  # noqa: ANN202
        n = NAME
        return [
            (r"set\s+(\w[\w.]*)\s*(?:=|to)\s*(.*)", self._set),
            (r"set\s+.*", lambda m: "SET"),
            (r"show\s+(?!tables\b|columns\b|indexes\b)(\w[\w.]*)", lambda m: self.spark.createDataFrame([(m[1], self.settings.get(m[1].lower()))], "name string, value string")),
            (rf"show\s+indexes(?:\s+from\s+{n})?", lambda m: self.catalog.list_indexes(m[1] and _bare(m[1]))),
            (r"explain\s+analyze\s+(.*)", self._analyze),
            (rf"create\s+external\s+table\s+(if\s+not\s+exists\s+)?{n}\s*(?:\((.*?)\)\s*)?stored\s+as\s+(\w+)\s+location\s+'([^']+)'(?:\s+options\s*\((.*)\))?", self._external),
            (rf"create\s+(or\s+replace\s+)?(?:temp(?:orary)?\s+)?view\s+{n}\s+as\s+(.*)", self._view),
            (rf"drop\s+view\s+(if\s+exists\s+)?{n}", self._drop_view),
            (rf"create\s+table\s+(if\s+not\s+exists\s+)?{n}\s+as\s+((?:select|with|values)\b.*)", self._create_as),
            (rf"copy\s+(?:\((.*)\)|{n})\s+to\s+'([^']+)'\s*(?:stored\s+as\s+(\w+)|\((.*)\))?", self._copy),
            (rf"merge\s+into\s+{n}(?:\s+as)?(?:\s+(?!using\b){n})?\s+using\s+(.*?)\s+on\s+(.*?)\s+(when\s+.*)", self._merge),
            (rf"create\s+table\s+(if\s+not\s+exists\s+)?{n}\s*\((.*)\)", self._create),
            (rf"drop\s+table\s+(if\s+exists\s+)?{n}", lambda m: self.catalog.drop(_bare(m[2]), bool(m[1])) and "DROP TABLE" or "DROP TABLE"),
            (rf"create\s+index\s+(?:{n}\s+)?on\s+{n}\s*(?:using\s+(\w+)\s*)?\(([^()]*)\)(?:\s+using\s+(\w+))?(?:\s+with\s*\((.*)\))?", self._create_index),
            (r"search\s+index\s+(\w+)\s+for\s+\[([^\]]*)\](?:\s+limit\s+(\d+))?(?:\s+within\s+([\d.]+))?(?:\s+where\s+(.*))?", lambda m: self.catalog.search(m[1], [float(x) for x in m[2].split(",")], int(m[3] or 10), m[5], float(m[4]) if m[4] else None)),
            (rf"drop\s+index\s+(if\s+exists\s+)?{n}", lambda m: self.catalog.drop_index(_bare(m[2]), bool(m[1])) and "DROP INDEX" or "DROP INDEX"),
            (rf"alter\s+table\s+{n}\s+add\s+column\s+(.*)", lambda m: self.catalog.add_column(_bare(m[1]), self._column(m[2])) or "ALTER TABLE"),
            (rf"alter\s+table\s+{n}\s+drop\s+column\s+{n}", lambda m: self.catalog.drop_column(_bare(m[1]), _bare(m[2])) or "ALTER TABLE"),
            (rf"alter\s+table\s+{n}\s+rename\s+column\s+{n}\s+to\s+{n}", lambda m: self.catalog.rename_column(_bare(m[1]), _bare(m[2]), _bare(m[3])) or "ALTER TABLE"),
            (rf"insert\s+into\s+{n}\s*(?:\(([^()]*)\))?\s*((?:values|select|with)\b.*?)(?:\s+returning\s+(.*))?", self._insert),
            (rf"update\s+{n}\s+set\s+(.*?)\s+from\s+(.*?)\s+where\s+(.*?)(?:\s+returning\s+(.*))?", self._update_from),
            (self._plain_update, self._update),
            (rf"delete\s+from\s+{n}(?:\s+where\s+(.*?))?(?:\s+returning\s+(.*))?", self._delete),
            (rf"truncate\s+(?:table\s+)?{n}", lambda m: self.catalog.write(_bare(m[1]), self.catalog.read(_bare(m[1])).limit(0)) or "TRUNCATE TABLE"),
            (rf"(?:describe|desc)\s+(?:table\s+)?{n}", lambda m: self.catalog.describe(_bare(m[1]))),
            (r"show\s+tables", lambda m: self.catalog.list()),
        ]

    @staticmethod
    def _column(text: str) -> T.StructField:
        m = re.fullmatch(rf"{NAME}\s+(.*?)((?:\s+(?:not\s+null|null|primary\s+key|default\s+\S+))*)", text.strip(), re.I | re.S)
        if not m:
            raise EngineError("42601", f"{text!r} declares no column")
        try:
            kind, metadata = parse_type(m[2])
        except ValueError as e:
            raise EngineError("42704", str(e)) from e
        default = re.search(r"default\s+(\S+)", m[3], re.I)
        return T.StructField(_bare(m[1]), kind, not re.search(r"not\s+null|primary\s+key", m[3], re.I), metadata | ({"default": default[1].strip("'")} if default else {}))

    def _create(self, m: re.Match) -> str:
        fields, key = [], []
        for part in split_outside(m[3], ","):
            if own := re.fullmatch(r"(?:constraint\s+\w+\s+)?primary\s+key\s*\((.*)\)", part, re.I | re.S):
                key = [_bare(c) for c in own[1].split(",")]
            else:
                fields.append(self._column(part))
                if re.search(r"primary\s+key", part, re.I):
                    key = [fields[-1].name]
        fields = [T.StructField(f.name, f.dataType, f.nullable and f.name not in key, f.metadata) for f in fields]
        self.catalog.create(_bare(m[2]), T.StructType(fields), key, bool(m[1]))
        return "CREATE TABLE"

    def _set(self, m: re.Match) -> str:
        self.settings[m[1].lower()] = m[2].strip().strip("'")
        return "SET"

    def _analyze(self, m: re.Match) -> DataFrame:
        """Runs the query to its end without keeping rows: its plan as executed, rows and milliseconds."""
        df = self._spark_sql(m[1])
        began = time.perf_counter()
        seen = df.agg(F.count(F.lit(1))).first()[0]
        took = (time.perf_counter() - began) * 1000
        return self.spark.createDataFrame([(df._jdf.queryExecution().executedPlan().toString(), seen, took)], "plan string, rows long, milliseconds double")

    def _create_index(self, m: re.Match) -> str:
        params = {k: int(v) if v.isdigit() else v for k, v in (x.partition("=")[::2] for x in split_outside((m[6] or "").replace(" ", ""), ","))}
        return "CREATE INDEX " + self.catalog.create_index(_bare(m[2]), [_bare(c) for c in m[4].split(",")], m[1] and _bare(m[1]), m[3] or m[5] or "btree", **params)

    def _external(self, m: re.Match) -> str:
        name, kind = _bare(m[2]), KINDS.get(m[4].lower())
        if kind is None:
            raise EngineError("0A000", f"{m[4]!r} is none of {sorted(KINDS)}")
        if self.spark.catalog.tableExists(name):
            if m[1]:
                return "CREATE TABLE"
            raise EngineError("42P07", f"there is a table {name} already")
        schema = T.StructType([self._column(c) for c in split_outside(m[3], ",")]) if m[3] else None
        files.read(self.spark, m[5], kind, schema, **_options(m[6])).createTempView(name)
        return "CREATE TABLE"

    def _view(self, m: re.Match) -> str:
        name = _bare(m[2])
        if name in self.catalog.tables or not m[1] and self.spark.catalog.tableExists(name):
            raise EngineError("42P07", f"there is a table or view {name} already")
        self._spark_sql(m[3]).createOrReplaceTempView(name)
        return "CREATE VIEW"

    def _drop_view(self, m: re.Match) -> str:
        if _bare(m[2]) in self.catalog.tables or not self.spark.catalog.dropTempView(_bare(m[2])) and not m[1]:
            raise EngineError("42P01", f"there is no view {_bare(m[2])}")
        return "DROP VIEW"

    def _create_as(self, m: re.Match) -> str:
        rows, name = self._spark_sql(m[3]), _bare(m[2])
        if name in self.catalog.tables and m[1]:
            return "CREATE TABLE"
        self.catalog.create(name, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))
        self.catalog.write(name, rows)
        return f"SELECT {self.catalog.read(name).count()}"

    def _copy(self, m: re.Match) -> str:
        """COPY (query) or table TO 'folder', as Parquet unless told otherwise."""
        rows = self._spark_sql(m[1]) if m[1] else self._spark_sql(f"SELECT * FROM {m[2]}")
        options = _options(m[5])
        kind = KINDS.get((m[4] or options.pop("format", "parquet")).lower())
        if kind is None:
            raise EngineError("0A000", f"no format of {sorted(KINDS)}")
        n = rows.count()
        files.write(rows, m[3], kind, **options)
        return f"COPY {n}"

    @staticmethod
    def _returned(rows: DataFrame, text: str | None, tag: str) -> str | tuple[DataFrame]:
        """The tag of a change, or the rows that its RETURNING asks for. They read the table's version before or after it."""
        return tag if text is None else (rows.selectExpr(*split_outside(text, ",")),)

    def _insert(self, m: re.Match) -> str | tuple[DataFrame]:
        name = _bare(m[1])
        own = self.catalog.table(name)
        columns = [_bare(c) for c in m[2].split(",")] if m[2] else own.schema.names
        if unknown := [c for c in columns if c not in own.schema.names]:
            raise EngineError("42703", f"{name} has no columns {unknown}")
        rows = self._spark_sql(f"SELECT * FROM {m[3]}" if m[3][:6].lower() == "values" else m[3])
        if len(rows.columns) != len(columns):
            raise EngineError("42601", f"{len(columns)} columns, but {len(rows.columns)} values")
        rows = rows.toDF(*columns)
        for f in own.schema:
            if f.name not in columns:
                rows = rows.withColumn(f.name, F.lit(f.metadata.get("default")).cast(f.dataType))
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in own.schema])
        n = rows.count()
        if own.primary_key:  # of rows with one key the last of the statement stands
            ordered = rows.withColumn("__n", F.monotonically_increasing_id())
            rest = [c for c in rows.columns if c not in own.primary_key]
            rows = ordered.groupBy(*own.primary_key).agg(F.max_by(F.struct(*rest), "__n").alias("__r")).select(*own.primary_key, *[F.col(f"__r.{c}").alias(c) for c in rest]) if rest else rows.distinct()
        self.catalog.insert(name, rows)
        return self._returned(rows.select(*own.schema.names), m[4], f"INSERT 0 {n}")

    def _assignments(self, name: str, text: str) -> dict[str, F.Column]:
        values = {}
        for part in split_outside(text, ","):
            column, _, value = part.partition("=")
            values[_bare(column.split(".")[-1])] = F.expr(value)
        if unknown := [c for c in values if c not in self.catalog.table(name).schema.names]:
            raise EngineError("42703", f"{name} has no columns {unknown}")
        return values

    def _update(self, m: re.Match) -> str | tuple[DataFrame]:
        name = _bare(m[1])
        values = self._assignments(name, m[2])
        predicate = F.expr(m[3]) if m[3] else F.lit(True)
        rows = self.catalog.read(name)
        changed = update_where(rows.withColumn("__hit", F.coalesce(predicate, F.lit(False))), F.col("__hit"), values)
        n = rows.where(predicate).count()
        if n:
            self.catalog.write(name, changed.drop("__hit"))
        return self._returned(changed.where("__hit").drop("__hit"), m[4], f"UPDATE {n}")

    def _delete(self, m: re.Match) -> str | tuple[DataFrame]:
        name = _bare(m[1])
        predicate = F.expr(m[2]) if m[2] else F.lit(True)
        rows = self.catalog.read(name)
        n = rows.where(predicate).count()
        if n:
            self.catalog.write(name, delete_where(rows, predicate))
        return self._returned(rows.where(predicate), m[3], f"DELETE {n}")

    def _source(self, text: str) -> DataFrame:
        """A table, or a query in brackets, with or without an alias."""
        if m := re.fullmatch(rf"\((.*)\)(?:\s+as)?\s+{NAME}", text.strip(), re.I | re.S):
            return self._spark_sql(m[1]).alias(_bare(m[2]))
        m = re.fullmatch(rf"{NAME}(?:(?:\s+as)?\s+{NAME})?", text.strip(), re.I)
        if not m:
            raise EngineError("42601", f"{text!r} is no table or query")
        return self._spark_sql(f"SELECT * FROM {m[1]}").alias(_bare(m[2] or m[1]))

    def _met(self, name: str, alias: str, source: DataFrame, on: str) -> DataFrame:
        """The table's rows (t: as a struct) with the source row that each meets; one that meets several is an error."""
        rows = self.catalog.read(name).withColumn("__id", F.monotonically_increasing_id()).alias(alias)
        met = rows.join(source.withColumn("__there", F.lit(True)), F.expr(on), "left")
        if not met.where("__there").groupBy("__id").count().where("count > 1").limit(1).isEmpty():
            raise EngineError("21000", f"a row of {name} meets several rows of the source")
        return met

    def _update_from(self, m: re.Match) -> str | tuple[DataFrame]:
        if m[2].count("(") != m[2].count(")"):  # the FROM is one of a subquery or function
            return self._update(re.fullmatch(self._plain_update, m[0], re.I | re.S))
        name = _bare(m[1])
        values, names = self._assignments(name, m[2]), self.catalog.table(name).schema.names
        met = self._met(name, name, self._source(m[3]), m[4])
        hit = F.coalesce("__there", F.lit(False))
        kinds = self.catalog.table(name).schema
        changed = met.select(*[(F.when(hit, values[c].cast(kinds[c].dataType)).otherwise(F.col(f"{name}.{c}")) if c in values else F.col(f"{name}.{c}")).alias(c) for c in names], hit.alias("__hit"))
        n = changed.where("__hit").count()
        if n:
            self.catalog.write(name, changed.drop("__hit"))
        return self._returned(changed.where("__hit").drop("__hit"), m[5], f"UPDATE {n}")

    def _merge(self, m: re.Match) -> str:
        """WHEN MATCHED [AND c] THEN UPDATE SET ... or DELETE; WHEN NOT MATCHED [AND c] THEN INSERT (...) VALUES (...). The first clause that holds counts."""
        name = _bare(m[1])
        alias, source, schema = _bare(m[2]) if m[2] else name, self._source(m[3]), self.catalog.table(name).schema
        updates, inserts = [], []
        for part in re.split(r"\bwhen\s+", m[5], flags=re.I)[1:]:
            c = re.fullmatch(r"(not\s+)?matched(?:\s+and\s+(.*?))?\s+then\s+(update\s+set\s+(.*)|delete|insert\s*\((.*?)\)\s*values\s*\((.*)\)|do\s+nothing)\s*", part.strip(), re.I | re.S)
            if not c or bool(c[1]) != (c[5] is not None) and not c[3].lower().startswith("do"):
                raise EngineError("42601", f"{part!r} is no clause of a merge")
            (inserts if c[1] else updates).append((F.expr(c[2]) if c[2] else F.lit(True), c))
        met = self._met(name, alias, source, m[4])
        there, act = F.coalesce("__there", F.lit(False)), F.lit(-1)
        for i, (when, _) in reversed([*enumerate(updates)]):
            act = F.when(there & F.coalesce(when, F.lit(False)), i).otherwise(act)
        acted = met.withColumn("__act", act)
        columns = {c: F.col(f"{alias}.{c}") for c in schema.names}
        for i, (_, c) in enumerate(updates):
            if c[4]:
                columns |= {k: F.when(F.col("__act") == i, v.cast(schema[k].dataType)).otherwise(columns[k]) for k, v in self._assignments(name, c[4]).items()}
        deletes = [i for i, (_, c) in enumerate(updates) if c[3].lower() == "delete"]
        changes = [i for i, (_, c) in enumerate(updates) if c[4]]
        n = acted.where(F.col("__act").isin(deletes + changes)).count() if deletes or changes else 0
        kept = acted.where(~F.col("__act").isin(deletes)) if deletes else acted
        out = kept.select(*[v.alias(c) for c, v in columns.items()])
        rest = source.join(self.catalog.read(name).alias(alias), F.expr(m[4]), "left_anti")
        taken = F.lit(False)
        for when, c in inserts:
            if c[5] is None:
                taken = taken | F.coalesce(when, F.lit(False))
                continue
            given = dict(zip([_bare(x) for x in split_outside(c[5], ",")], split_outside(c[6], ","), strict=True))
            if unknown := [x for x in given if x not in schema.names]:
                raise EngineError("42703", f"{name} has no columns {unknown}")
            new = rest.where(~taken & F.coalesce(when, F.lit(False)))
            new = new.select(*[(F.expr(given[f.name]) if f.name in given else F.lit(f.metadata.get("default"))).cast(f.dataType).alias(f.name) for f in schema])
            taken = taken | F.coalesce(when, F.lit(False))
            n += new.count()
            out = out.unionByName(new)
        if n:
            self.catalog.write(name, out)
        return f"MERGE {n}"
