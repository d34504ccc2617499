"""SQL texts with positional parameters: a read-only entry, statements, row changes on Parquet tables, dialect rewrites."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EngineError, require

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")
#: Functions of the embedded dialect and what they are called here.
RENAMED = {
    "group_concat": "listagg", "total": "total", "ifnull": "ifnull", "iif": "if", "instr": "instr", "char_length": "length", "unicode": "ascii", "julianday": "julianday",
    "json_extract": "get_json_object", "json_valid": "json_valid", "ceiling": "ceil", "random": "random", "trunc": "trunc", "printf": "format_string",
}
_PIECES = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z0-9_]*|\s+|.", re.S)


def name(text: str) -> str:
    """A table's or column's name, quoted; anything else than a plain name is refused."""
    require(bool(_NAME.match(text)), "invalid_argument", f"not a name: {text}")
    return f"`{text}`"


def parameters(values: Sequence[Any]) -> list:
    """Values as they are bound: null, truth values as 0 and 1, whole numbers, other numbers, texts; nothing else."""
    out = []
    for v in values:
        if isinstance(v, bool):
            out.append(int(v))
        elif v is None or isinstance(v, int | float | str):
            out.append(v)
        else:
            raise EngineError("invalid_argument", "a parameter is a list or an object")
    return out


def rewritten(text: str) -> str:
    """A statement of the embedded dialect in Spark's: LIKE without regard to case, group_concat, total, iif and the like,
    scalar max and min, json_group_array and json_group_object, x / y that is cut to a whole number (as a double) for whole
    numbers and null for y = 0 (as x % 0 is), x IS y for null-safe equality.  Strings, quoted names and comments stay as they are.

    Not translated: GLOB and REGEXP, date modifiers, json_each and json_set, text that counts as its numeric prefix, and
    frames with EXCLUDE; Spark refuses those that it does not know.
    """
    pieces = _PIECES.findall(text)
    out: list[str] = []
    for i, piece in enumerate(pieces):
        low = piece.lower()
        after = [p for p in pieces[i + 1 : i + 40] if not p.isspace()]
        called = after[:1] == ["("]
        if low == "like":
            out.append("ILIKE")
        elif low == "is" and after and after[0].lower() not in ("null", "not", "true", "false", "distinct", "unknown"):
            out.append("<=>")
        elif called and low in ("max", "min") and _arguments(pieces, i) > 1:
            out.append("greatest" if low == "max" else "least")
        elif called and low == "json_group_array":
            out.append("tidemark_json_array")
        elif called and low == "json_group_object":
            out.append("tidemark_json_object")
        elif called and low == "group_concat" and _arguments(pieces, i) == 1:
            out.append("tidemark_concat")
        elif called and low == "total":
            out.append("tidemark_total")
        elif called and low in RENAMED:
            out.append(RENAMED[low])
        else:
            out.append(piece)
    done = "".join(out)
    for called, around in (("tidemark_concat", "listagg({}, ',')"), ("tidemark_total", "coalesce(sum(cast({} AS DOUBLE)), 0D)"), ("tidemark_json_array", "to_json(collect_list({}))"), ("tidemark_json_object", "to_json(map_from_entries(collect_list(struct({}))))")):
        done = _wrapped(done, called, around)
    return _divided(done)


def _closing(pieces: list[str], i: int, step: int = 1) -> int:
    """The index of the bracket that matches that at ``i``."""
    depth = 0
    while 0 <= i < len(pieces):
        depth += (pieces[i] == "(") - (pieces[i] == ")")
        if depth == 0:
            return i
        i += step
    return min(max(i, 0), len(pieces) - 1)


def _wrapped(text: str, called: str, around: str) -> str:
    """Calls of a function as another expression of its arguments."""
    pieces = _PIECES.findall(text)
    while called in pieces:
        i = pieces.index(called)
        a = next(j for j in range(i + 1, len(pieces)) if pieces[j] == "(")
        b = _closing(pieces, a)
        pieces[i : b + 1] = [around.format("".join(pieces[a + 1 : b]))]
        pieces = _PIECES.findall("".join(pieces))
    return "".join(pieces)


_OPERAND = re.compile(r"[A-Za-z_0-9.:`\"]+\Z")


def _solid(pieces: list[str], i: int) -> int:
    """The last index below ``i`` that isn't white space."""
    i -= 1
    while i >= 0 and pieces[i].isspace():
        i -= 1
    return i


def _operand(pieces: list[str], i: int) -> int:
    """Where the operand begins that ends before ``i``: a bracket or call, or a name or number."""
    a = _solid(pieces, i)
    if a >= 0 and pieces[a] == ")":
        a = _closing(pieces, a, -1)
    while a > 0 and _OPERAND.match(pieces[a - 1]) and pieces[a - 1].lower() not in _WORDS:
        a -= 1
    return max(a, 0)


def _divided(text: str) -> str:
    """``x / y`` and ``x % y`` as calls that follow the dialect: of a chain of operands, from the left."""
    pieces = _PIECES.findall(text)
    at = 0
    while True:
        i = next((j for j in range(at, len(pieces)) if pieces[j] in ("/", "%")), None)
        if i is None:
            return "".join(pieces)
        a = _operand(pieces, i)
        # a product to the left is divided as a whole
        while (k := _solid(pieces, a)) >= 0 and pieces[k] == "*" and _solid(pieces, k) >= 0 and pieces[_solid(pieces, k)] not in "(,":
            a = _operand(pieces, k)
        b = i + 1
        while b < len(pieces) - 1 and (pieces[b].isspace() or pieces[b] in "+-"):
            b += 1
        while b + 1 < len(pieces) and _OPERAND.match(pieces[b]) and (_OPERAND.match(pieces[b + 1]) or pieces[b + 1] == "("):
            b += 1
        if pieces[b] == "(":
            b = _closing(pieces, b)
        left, right = "".join(pieces[a:i]).strip(), "".join(pieces[i + 1 : b + 1]).strip()
        before = len(pieces[:a])
        if pieces[i] == "%":
            call = f"try_mod({left}, {right})"
        else:
            # whole numbers and text have no fraction: the type decides, which Spark folds away
            call = f"CASE WHEN typeof({left}) IN ('tinyint','smallint','int','bigint') AND typeof({right}) IN ('tinyint','smallint','int','bigint') THEN CAST(CAST(try_divide(CAST({left} AS DECIMAL(19, 0)), CAST({right} AS DECIMAL(19, 0))) AS BIGINT) AS DOUBLE) ELSE try_divide(CAST({left} AS DOUBLE), CAST({right} AS DOUBLE)) END"
        pieces[a : b + 1] = ["(" + call + ")"]
        head, tail = "".join(pieces[: before + 1]), "".join(pieces[before + 1 :])
        pieces = _PIECES.findall(head)
        at = len(pieces)
        pieces += _PIECES.findall(tail)


#: Words that end an operand.
_WORDS = {"select", "where", "and", "or", "on", "by", "then", "else", "when", "case", "having", "in", "not", "from", "between", "limit", "offset", "set", "distinct", "all", "values", "is", "ilike", "as"}


def _arguments(pieces: list[str], i: int) -> int:
    """The number of arguments of the call that begins at piece i."""
    depth, n = 0, 1
    for p in pieces[i + 1 :]:
        if p == "(":
            depth += 1
        elif p == ")":
            depth -= 1
            if depth == 0:
                break
        elif p == "," and depth == 1:
            n += 1
    return n


def run(spark: SparkSession, text: str, values: Sequence[Any] = (), views: dict[str, DataFrame] | None = None) -> DataFrame:
    try:
        return spark.sql(text, args=parameters(values) or None, **(views or {}))
    except EngineError:
        raise
    except Exception as e:
        raise EngineError("sql_error", str(e).split("\n")[0]) from e


def query(spark: SparkSession, text: str, values: Sequence[Any] = ()) -> DataFrame:
    """A statement that begins with SELECT."""
    require(text.strip().lower().startswith("select"), "invalid_argument", "only SELECT statements are allowed")
    return run(spark, text, values)


def equal_rows(table: DataFrame, wanted: dict) -> DataFrame:
    """Rows whose columns equal what is given; a null equals nothing."""
    out = table
    for column, value in wanted.items():
        name(column)
        out = out.where(F.col(column) == F.lit(value))
    return out


_STATEMENTS = (
    ("create", re.compile(r"CREATE\s+TABLE\s+(?P<if>IF\s+NOT\s+EXISTS\s+)?(?P<table>\w+)\s*\((?P<body>.*)\)\s*;?\s*\Z", re.I | re.S)),
    ("drop", re.compile(r"DROP\s+TABLE\s+(?P<if>IF\s+EXISTS\s+)?(?P<table>\w+)\s*;?\s*\Z", re.I)),
    ("insert", re.compile(r"INSERT\s+INTO\s+(?P<table>\w+)\s*(?:\((?P<columns>[^()]*)\))?\s*(?P<body>(?:VALUES|SELECT)\b.*?);?\s*\Z", re.I | re.S)),
    ("update", re.compile(r"UPDATE\s+(?P<table>\w+)\s+SET\s+(?P<body>.*?);?\s*\Z", re.I | re.S)),
    ("delete", re.compile(r"DELETE\s+FROM\s+(?P<table>\w+)(?:\s+WHERE\s+(?P<where>.*?))?;?\s*\Z", re.I | re.S)),
    ("query", re.compile(r"(?:SELECT|WITH|VALUES)\b.*\Z", re.I | re.S)),
)
#: Column types by the rules of the embedded dialect's affinities; the first that a declared type holds counts.
AFFINITIES = (("INT", "bigint"), ("CHAR", "string"), ("CLOB", "string"), ("TEXT", "string"), ("BLOB", "binary"), ("REAL", "double"), ("FLOA", "double"), ("DOUB", "double"), ("BOOL", "boolean"), ("DATE", "string"), ("NUM", "double"), ("DEC", "double"))


def numbered(text: str, values: Sequence[Any]) -> tuple[str, dict[str, Any]]:
    """A text whose ``?`` are named by their numbers, so that parts of it can be used more than once, and the values."""
    pieces, n = _PIECES.findall(text), 0
    for i, p in enumerate(pieces):
        if p == "?":
            pieces[i] = f":p{n}"
            n += 1
    bound = parameters(values)
    require(n == len(bound), "sql_error", f"{n} parameters are wanted, {len(bound)} are given")
    return "".join(pieces), {f"p{i}": v for i, v in enumerate(bound)}


def _split(text: str, at: str = ",") -> list[str]:
    """The parts of a text between separators (a character, or a word as piece) outside of brackets and strings."""
    parts, depth = [[]], 0
    for p in _PIECES.findall(text):
        depth += (p == "(") - (p == ")")
        if depth == 0 and p.upper() == at:
            parts.append([])
        else:
            parts[-1].append(p)
    return ["".join(x).strip() for x in parts]


class Tables:
    """Parquet tables below a folder.  A version of a table is a small file that lists its parts (folders of files) and its
    schema; it becomes visible by one rename.  An insert adds a part, a delete or an update writes anew only the parts that
    hold rows it hits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._new(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # versions

    def _versions(self, table: str) -> list[str]:
        folder = self._new(f"{self.path}/{table}/versions")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _version(self, table: str) -> dict | None:
        """The newest version of a table: parts and schema; None if there is none or it was dropped."""
        found = self._versions(table)
        if not found:
            return None
        stream = self._fs.open(self._new(f"{self.path}/{table}/versions/{found[-1]}"))
        try:
            out = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return None if out["schema"] is None else out

    def _need(self, table: str) -> dict:
        name(table)
        found = self._version(table)
        require(found is not None, "not_found", table)
        return found

    def _switch(self, table: str, parts: list[str], schema: str | None) -> None:
        found = self._versions(table)
        number = int(found[-1].split(".")[0]) + 1 if found else 1
        staged = self._new(f"{self.path}/{table}/staging/{uuid.uuid4().hex}")
        target = self._new(f"{self.path}/{table}/versions/{number:09d}.json")
        out = self._fs.create(staged)
        out.write(bytearray(json.dumps({"parts": parts, "schema": schema}).encode()))
        out.close()
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            raise EngineError("conflict", f"another writer was faster: {table}")

    def _part(self, table: str, rows: DataFrame) -> str:
        part = f"parts/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{table}/{part}")
        return part

    def _read(self, table: str, schema: str, parts: list[str]) -> DataFrame:
        paths = [f"{self.path}/{table}/{p}" for p in parts]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def names(self) -> list[str]:
        folder = self._new(self.path)
        found = sorted(s.getPath().getName() for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        return [t for t in found if self._version(t)]

    def read(self, table: str) -> DataFrame:
        found = self._need(table)
        return self._read(table, found["schema"], found["parts"])

    def write(self, table: str, rows: DataFrame) -> None:
        """``rows`` as the whole table."""
        name(table)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
        self._switch(table, [self._part(table, rows)], schema)

    def create(self, table: str, schema: str) -> None:
        name(table)
        require(self._version(table) is None, "already_exists", table)
        fields = self.spark.createDataFrame([], schema).schema.fields
        self._switch(table, [], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))

    def drop(self, table: str) -> None:
        self._need(table)
        self._switch(table, [], None)

    # rows

    def insert(self, table: str, rows: DataFrame) -> int:
        """Rows by column name; missing columns are null.  The number of rows."""
        found = self._need(table)
        types = self._read(table, found["schema"], []).dtypes
        new = rows.select(*(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in types))
        part = self._part(table, new)
        n = self._read(table, found["schema"], [part]).count()  # of what was written, from the files' footers
        self._switch(table, [*found["parts"], part], found["schema"])
        return n

    def _hit(self, wanted: dict) -> Column:
        hit = F.lit(True)
        for column, value in wanted.items():
            name(column)
            hit = hit & F.coalesce(F.col(column) == F.lit(value), F.lit(False))
        return hit

    def _change(self, table: str, hit: Column, values: dict[str, Column] | None) -> int:
        """Delete the rows that ``hit`` (never null) holds for, or put ``values`` into them; their number."""
        found = self._need(table)
        old = self._read(table, found["schema"], found["parts"])
        file = F.col("_metadata.file_path")
        counts = {r.part: r.n for r in old.where(hit).groupBy(F.regexp_extract(file, "(parts/[0-9a-f]{32})/[^/]*$", 1).alias("part")).agg(F.count("*").alias("n")).collect()} if found["parts"] else {}
        if not counts:
            return 0
        rows = self._read(table, found["schema"], sorted(counts))
        if values is None:
            rows = rows.where(~hit)
        else:
            rows = rows.select(*(F.when(hit, values[c].cast(t)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c, t in old.dtypes))
        self._switch(table, [*(p for p in found["parts"] if p not in counts), self._part(table, rows)], found["schema"])
        return sum(counts.values())

    def delete(self, table: str, wanted: dict) -> int:
        return self._change(table, self._hit(wanted), None)

    def update(self, table: str, values: dict, wanted: dict) -> int:
        return self._change(table, self._hit(wanted), {c: F.lit(v) for c, v in values.items()})

    # texts

    def _run(self, text: str, args: dict[str, Any]) -> DataFrame:
        known = {w.lower() for w in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text)}
        for table in self.names():
            if table.lower() in known:
                self.read(table).createOrReplaceTempView(table)
        try:
            return self.spark.sql(rewritten(text), args=args or None)
        except Exception as e:
            raise EngineError("sql_error", str(e).split("\n")[0]) from e

    def query(self, text: str, values: Sequence[Any] = ()) -> DataFrame:
        """A SELECT over the tables, by their names, in the embedded dialect (see `rewritten`)."""
        require(text.strip().lower().startswith("select"), "invalid_argument", "only SELECT statements are allowed")
        return self._run(*numbered(text, values))

    def rows(self, text: str, values: Sequence[Any] = ()) -> DataFrame:
        """The rows of any query, one that begins with WITH or VALUES too; statements without rows are refused."""
        require(bool(_STATEMENTS[-1][1].match(text.strip())), "sql_error", "not a query")
        return self._run(*numbered(text, values))

    def execute(self, text: str, values: Sequence[Any] = ()) -> dict:
        """Run a statement: CREATE TABLE, DROP TABLE, INSERT, UPDATE, DELETE or a query; rows_affected, and rows (a frame) of a
        query.  Other statements, triggers, views, indexes and transactions are refused with sql_error."""
        text = text.strip()
        kind, m = next(((k, m) for k, p in _STATEMENTS if (m := p.match(text))), (None, None))
        require(kind is not None, "sql_error", "not a statement that is known here")
        if kind == "query":
            return {"rows_affected": 0, "rows": self._run(*numbered(text, values))}
        table = m["table"]
        if kind == "create":
            if m["if"] and self._version(table):
                return {"rows_affected": 0}
            self.create(table, ", ".join(self._column(c) for c in _split(m["body"]) if not re.match(r"(?:PRIMARY|UNIQUE|CHECK|FOREIGN|CONSTRAINT)\b", c, re.I)))
            return {"rows_affected": 0}
        if kind == "drop":
            if not (m["if"] and not self._version(table)):
                self.drop(table)
            return {"rows_affected": 0}
        self._need(table)
        # the parameters of the whole statement, in the order of the text
        body, args = numbered(text, values)
        m = next(p for k, p in _STATEMENTS if k == kind).match(body)
        try:
            if kind == "insert":
                names = [c.strip().strip('"`') for c in m["columns"].split(",")] if m["columns"] else self.read(table).columns
                rows = self._run(m["body"] if m["body"][:6].upper() == "SELECT" else f"SELECT * FROM ({m['body']})", args)
                require(len(rows.columns) == len(names), "sql_error", f"{len(rows.columns)} values for {len(names)} columns")
                return {"rows_affected": self.insert(table, rows.toDF(*names))}
            if kind == "delete":
                return {"rows_affected": self._change(table, self._where(m["where"], args), None)}
            changes, *where = _split(m["body"], "WHERE")
            pairs = [c.split("=", 1) for c in _split(changes)]
            columns = {c.strip().strip('"`'): self._bound(v, args) for c, v in pairs}
            known = self.read(table).columns
            require(set(columns) <= set(known), "sql_error", f"no such column in {table}")
            return {"rows_affected": self._change(table, self._where(where[0] if where else None, args), columns)}
        except EngineError:
            raise
        except Exception as e:
            raise EngineError("sql_error", str(e).split("\n")[0]) from e

    def _bound(self, text: str, args: dict[str, Any]) -> Column:
        """An expression of the dialect, its parameters written out as literals."""
        out = []
        for p in re.split(r"('(?:[^']|'')*'|:p\d+\b)", rewritten(text)):
            value = args[p[1:]] if re.fullmatch(r":p\d+", p) else None
            out.append(p if not re.fullmatch(r":p\d+", p) else "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(value, str) else f"{value}D" if isinstance(value, float) else f"{value}L")
        return F.expr("".join(out))

    def _where(self, text: str | None, args: dict[str, Any]) -> Column:
        return F.lit(True) if text is None else F.coalesce(self._bound(text, args).cast("boolean"), F.lit(False))

    @staticmethod
    def _column(text: str) -> str:
        first, *rest = text.split()
        column = first.strip('"`[]')
        name(column)
        declared = " ".join(rest).upper()
        kind = next((t for word, t in AFFINITIES if word in declared), "string")
        return f"`{column}` {kind}"
