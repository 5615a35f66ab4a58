"""Configuration files (*.tf) as tables. Spark lists and reads the files; each file is cut into blocks where it lies.

A block's arguments come as flattened (key, value) rows: nested blocks and objects add `.name`, repeated blocks and list
items `[i]`. Strings come unquoted, with references kept as `${...}`; numbers, booleans and null as written; any other
expression (calls, conditions, loops) as `${...}` text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.lineage import materialise

SYMBOL = re.compile(
    r"(?P<skip>[ \t\r]+|\#[^\n]*|//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<here><<-?(?P<tag>\w+)[^\n]*\n(?P<body>.*?)^[ \t]*(?P=tag)[ \t]*$)"
    r'|(?P<text>"(?:\\.|\$\{(?:[^{}]|\{[^{}]*\})*\}|[^"\\])*")'
    r"|(?P<word>[A-Za-z_][\w-]*|-?\d+(?:\.\d+)?)"
    r"|(?P<line>\n)"
    r"|(?P<sign>=>|[=!<>]=|&&|\|\||.)",
    re.S | re.M,
)
PLAIN = re.compile(r"-?\d+(\.\d+)?|true|false|null")
ESCAPES = {'\\"': '"', "\\n": "\n", "\\t": "\t", "\\\\": "\\", "\\r": "\r"}


class Reader:
    """One file's symbols, read from left to right."""

    def __init__(self, text: str):
        self.symbols = [(m.lastgroup, m[0], m["body"]) for m in SYMBOL.finditer(text) if m.lastgroup != "skip"]
        self.symbols = [("here" if b is not None else k, s, b) for k, s, b in self.symbols]
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        k = self.at + ahead
        return self.symbols[k][1] if k < len(self.symbols) else ""

    def lines(self) -> None:
        while self.peek() in ("\n", ",") and self.at < len(self.symbols):
            self.at += 1

    def body(self, out: list, key: str = "") -> None:
        """Arguments and nested blocks up to the closing brace, as (key, value) rows."""
        seen: dict[str, int] = {}
        while True:
            self.lines()
            name = self.peek()
            if not name or name == "}":
                self.at += 1
                return
            self.at += 1
            name = name.strip('"')
            path = f"{key}.{name}" if key else name
            if self.peek() in ("=", ":"):
                self.at += 1
                self.value(out, path)
                continue
            labels = []
            while self.peek() and self.peek() not in ("{", "\n"):
                labels.append(self.peek().strip('"'))
                self.at += 1
            if self.peek() != "{":
                raise ValueError(f"a block or an argument is cut at {name!r}")
            self.at += 1
            path = ".".join([path, *labels])
            n = seen[path] = seen.get(path, -1) + 1
            self.body(out, f"{path}[{n}]")

    def value(self, out: list, path: str) -> None:
        opening = self.peek()
        if opening == "{" and not self._loop():
            self.at += 1
            self.body(out, path)
        elif opening == "[" and not self._loop():
            self.at += 1
            n = 0
            while True:
                self.lines()
                if self.peek() in ("]", ""):
                    self.at += 1
                    return
                self.value(out, f"{path}[{n}]")
                n += 1
        else:
            out.append((path, self.expression()))

    def _loop(self) -> bool:
        k = 1
        while self.peek(k) == "\n":
            k += 1
        return self.peek(k) == "for"

    def expression(self) -> str | None:
        """A scalar, or any other expression as text in ${}."""
        kind, first, body = self.symbols[self.at] if self.at < len(self.symbols) else ("line", "", None)
        parts, depth = [], 0
        while self.at < len(self.symbols):
            k, s, b = self.symbols[self.at]
            if depth == 0 and (s in ("\n", ",", "]", "}", ")")):
                break
            depth += s in ("(", "[", "{")
            depth -= s in (")", "]", "}")
            parts.append(s)
            self.at += 1
        if len(parts) == 1 and kind == "here":
            return body
        if len(parts) == 1 and kind == "text":
            return re.sub(r'\\["ntr\\]', lambda m: ESCAPES[m[0]], first[1:-1])
        whole = "".join(parts).replace("\n", " ")
        if PLAIN.fullmatch(whole):
            return None if whole == "null" else whole
        return "${" + whole + "}"


def blocks_of(text: str) -> list[tuple[str, list[str], list[tuple[str, str | None]]]]:
    """(kind, labels, arguments) of each block of a file. Raises ValueError where the file is cut."""
    r, out = Reader(text), []
    while True:
        r.lines()
        kind = r.peek()
        if not kind:
            return out
        r.at += 1
        labels = []
        while r.peek() not in ("{", "=", ""):
            labels.append(r.peek().strip('"'))
            r.at += 1
        if r.peek() != "{":
            raise ValueError(f"no block behind {kind!r}")
        r.at += 1
        rows: list = []
        r.body(rows)
        if r.at > len(r.symbols):
            raise ValueError(f"block {kind!r} is not closed")
        out.append((kind, labels, rows))


COLUMNS = "path string, kind string, type string, name string, key string, value string, error string"


def read_blocks(spark: SparkSession, paths: list[str], pattern: str = "*.tf") -> DataFrame:
    """SC-1: one row per argument of each block in the files under paths whose names fit pattern (a block without arguments
    has one row with a null key). A file that can't be read gives one row with its error (Q20)."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(paths, wholetext=True)
    files = files.select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), "value")

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    for kind, labels, args in blocks_of(text or ""):
                        kind_of, name = (labels[0], labels[1]) if len(labels) > 1 else (None, labels[0] if labels else None)
                        rows += [(path, kind, kind_of, name, k, v, None) for k, v in (args or [(None, None)])]
                except (ValueError, IndexError) as e:
                    rows.append((path, None, None, None, None, None, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], [x.split()[0] for x in COLUMNS.split(", ")])

    return files.mapInArrow(run, COLUMNS)


def with_project(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """blocks under a project's root (roots: root), with path_id and in_module (below a folder `modules`). A file belongs to
    the deepest root above it; root files count only when they lie in the root itself (SC-1)."""
    folders = F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1), lambda i: F.array_join(F.slice(F.split(F.col("path"), "/"), 1, i), "/"))
    up = blocks.select("path").distinct().select("path", F.explode(folders).alias("root")).join(roots.select(F.regexp_replace("root", "/+$", "").alias("root")), "root")
    best = up.groupBy("path").agg(F.max(F.struct(F.length("root").alias("n"), "root")).alias("m")).select("path", F.col("m.root").alias("root"))
    rest = F.expr("substring(path, length(root) + 2)")
    out = blocks.join(best, "path").withColumn("rest", rest).withColumn("in_module", F.col("rest").startswith("modules/"))
    return out.where(F.col("in_module") | ~F.col("rest").contains("/")).withColumn("path_id", T.path_id(F.col("root"))).drop("rest", "root")


def _folder(path):
    return F.regexp_replace(path, r"/[^/]*$", "")


def _plain(path):
    """path without `.` and `..` steps; those that lead above the top stay at the top."""
    up = lambda done: F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
    step = lambda done, x: F.when(x.isin("", "."), done).when(x == "..", up(done)).otherwise(F.concat(done, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def with_sources(blocks: DataFrame, roots: DataFrame) -> DataFrame:
    """SC-2: blocks of each project's root folder (roots: root) and of all folders that its module blocks lead to by their
    `source`, from there on, however deep, with path_id and in_module (false in the root itself).

    A source is a way from the folder of the file that names it; where no file was read (a registry, an address, an
    expression, a folder that is not there) it leads nowhere. A folder that a project reaches by several ways, or by a
    cycle, counts once for it; one that several projects reach counts for each. Null and empty sources lead nowhere.
    Only pairs of project and folder go through the rounds, as many as modules lie within each other."""
    at = blocks.where("path IS NOT NULL").withColumn("folder", _folder(F.col("path")))
    folders = materialise(at.select("folder").distinct())
    asked = at.where("kind = 'module' AND key = 'source' AND value <> ''").select("folder", _plain(F.concat_ws("/", "folder", "value")).alias("to")).distinct()
    step = materialise(asked.join(folders.select(F.col("folder").alias("to")), "to").select("folder", "to"))
    start = roots.select(_plain("root").alias("root")).distinct()
    new = seen = materialise(start.join(folders, F.col("root") == F.col("folder")).select("root", "folder"))
    rounds = 0
    while not new.isEmpty():
        rounds += 1
        further = new.join(step, "folder").select("root", F.col("to").alias("folder")).distinct()
        new = materialise(further.join(seen, ["root", "folder"], "left_anti"))
        seen = seen.unionByName(new)
        if rounds % 8 == 0:
            seen = materialise(seen)
    own = seen.select("root", "folder", T.path_id(F.col("root")).alias("path_id"), (F.col("root") != F.col("folder")).alias("in_module"))
    return at.join(own, "folder").drop("folder", "root")


def _first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """All rows of the file that comes first for each key."""
    best = Window.partitionBy("path_id", *keys).orderBy(*order)
    return rows.withColumn("rank", F.dense_rank().over(best)).where("rank = 1").drop("rank")


def variables(blocks: DataFrame) -> DataFrame:
    """path_id, scope 'var', name, value (default), type, description. Root variables come before those of modules, which
    count only with a default."""
    of = blocks.where("kind = 'variable'").groupBy("path_id", "name", "in_module", "path").agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(a) for k, a in (("default", "value"), ("type", "type"), ("description", "description"))))
    fit = of.where(~F.col("in_module") | F.col("value").isNotNull())
    return _first(fit, ["name"], ["in_module", "path"]).select("path_id", F.lit("var").alias("scope"), "name", "value", "type", "description")


def local_values(blocks: DataFrame) -> DataFrame:
    """path_id, scope 'local', name, value: one for each scalar local."""
    of = blocks.where("kind = 'locals' AND key IS NOT NULL AND NOT in_module AND NOT key RLIKE '[.\\\\[]'")
    return _first(of, ["key"], ["path"]).select("path_id", F.lit("local").alias("scope"), F.col("key").alias("name"), "value")


def local_items(blocks: DataFrame) -> DataFrame:
    """path_id, name, key, value: what map and list locals hold, key being the way to it (`Team`, `[0]`, `a.b[1]`)."""
    of = blocks.where("kind = 'locals' AND key IS NOT NULL AND NOT in_module AND key RLIKE '[.\\\\[]'").withColumn("local", F.regexp_extract("key", r"^[^.\[]+", 0))
    rest = F.regexp_replace(F.expr("substring(key, length(local) + 1)"), r"^\.", "")
    return _first(of, ["local"], ["path"]).select("path_id", F.col("local").alias("name"), rest.alias("key"), "value")


def resources(blocks: DataFrame) -> DataFrame:
    """path_id, resource_type, resource_name, key, value. A module's resource comes before the root's of that name."""
    of = blocks.where("kind = 'resource'")
    return _first(of, ["type", "name"], [F.desc("in_module"), "path"]).select("path_id", F.col("type").alias("resource_type"), F.col("name").alias("resource_name"), "key", "value")


def as_graph(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SC-4: (nodes, edges, props) from resources: an edge wherever an argument refers to type.name of the same project.
    depends_on is left out (SC-12)."""
    named = found.select("path_id", "resource_type", "resource_name").distinct()
    key = F.xxhash64("path_id", "resource_type", "resource_name")
    nodes = named.select("path_id", key.alias("node_id"), F.lit("resource").alias("node_type"), "resource_type", "resource_name", F.concat_ws(".", "resource_type", "resource_name").alias("name"), F.lit("").alias("parent_id"))
    props = found.where("key IS NOT NULL AND NOT key LIKE 'depends_on%'").select("path_id", key.alias("node_id"), "key", "value")
    labels = F.regexp_extract_all("value", F.lit(r"\b([a-z][a-z0-9]*_\w+\.[A-Za-z_][\w-]*)"), F.lit(1))
    asked = props.where(F.col("value").contains("${")).select("path_id", F.col("node_id").alias("src"), F.explode(labels).alias("name")).distinct()
    edges = asked.join(nodes.select("path_id", "name", F.col("node_id").alias("dst")), ["path_id", "name"]).where("src <> dst").select("path_id", "src", "dst").distinct()
    return nodes, edges, props
