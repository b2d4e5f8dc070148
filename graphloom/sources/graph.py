"""The property graph: node tables by label set, relationship tables by type, all DataFrames; and bulk readers."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Column of a relationship table that tells parallel relationships apart; tables that weren't written here lack it.
EID = "__id"


@dataclass(frozen=True)
class ForeignKey:
    """A relationship that is a column of a node table: the rows of ``label`` are its end 0 (source) or 1 (target), and
    ``other`` gives the other end's id from the properties it ``reads``."""

    label: str
    end: int
    reads: tuple[str, ...]
    other: Callable[[dict[str, Column]], Column]


class RelTable:
    """Rows (src, dst, properties...); ``ends`` names the labels every row joins, where known. A function is called for
    the table when it is first read."""

    def __init__(self, df: DataFrame | Callable[[], DataFrame], ends: tuple[str | None, str | None] = (None, None), key: ForeignKey | None = None):
        self._df, self.ends, self.key = df, ends, key

    @property
    def df(self) -> DataFrame:
        if not isinstance(self._df, DataFrame):
            self._df = self._df()
        return self._df

    def unkeyed(self) -> RelTable:
        return RelTable(self._df, self.ends)


class NodeTables(dict):
    """Node tables by label set; a table given as a function is opened when it is first read."""

    def __getitem__(self, key: tuple[str, ...]) -> DataFrame:
        table = super().__getitem__(key)
        if not isinstance(table, DataFrame):
            table = table()
            self[key] = table
        return table

    def get(self, key, default=None):
        return self[key] if key in self else default

    def items(self):
        return [(k, self[k]) for k in list(self)]

    def having(self, labels: list[str]) -> list[tuple[str, ...]]:
        return [key for key in self if set(labels) <= set(key)]

    def with_table(self, key: tuple[str, ...], table) -> NodeTables:
        out = NodeTables()
        for k in self:
            dict.__setitem__(out, k, dict.__getitem__(self, k))
        out[key] = table
        return out


@dataclass(frozen=True)
class PropertyGraph:
    """An immutable version of a graph. Node tables have ``id`` and properties; ids are unique over all labels."""

    spark: SparkSession
    nodes: NodeTables = field(default_factory=NodeTables)
    rels: dict[str, RelTable] = field(default_factory=dict)

    def with_nodes(self, labels: tuple[str, ...], df: DataFrame | Callable[[], DataFrame]) -> PropertyGraph:
        """A version with another table for a label set; relationships that were its columns are tables from then on."""
        rels = {k: t.unkeyed() if t.key and t.key.label in labels else t for k, t in self.rels.items()}
        return replace(self, nodes=self.nodes.with_table(tuple(labels), df), rels=rels)

    def with_rels(self, kind: str, df: DataFrame | Callable[[], DataFrame], ends: tuple = (None, None), key: ForeignKey | None = None) -> PropertyGraph:
        return replace(self, rels=self.rels | {kind: RelTable(df, ends, key)})

    def without_end(self, label: str) -> PropertyGraph:
        """A version that doesn't hold every end of a relationship to have ``label``: some nodes have lost it."""
        return replace(self, rels={k: RelTable(t._df, tuple(None if x == label else x for x in t.ends), t.key) for k, t in self.rels.items()})

    def only_table(self, labels: list[str]) -> str | None:
        """The label whose one table, of that label alone, holds all nodes that have ``labels``."""
        keys = self.nodes.having(labels)
        return keys[0][0] if labels and len(keys) == 1 and len(keys[0]) == 1 else None

    def scan(self, labels: list[str]) -> tuple[DataFrame, list[str]]:
        """Nodes that have all of ``labels`` (id, labels, properties), and the property names."""
        parts = [self.nodes[key].withColumn("labels", F.array(*map(F.lit, key)).cast("array<string>")) for key in self.nodes.having(labels)]
        if not parts:
            return self.spark.createDataFrame([], "id long, labels array<string>"), []
        out = parts[0]
        for p in parts[1:]:
            out = _widened(out, p)
        return out, [c for c in out.columns if c not in ("id", "labels")]

    def edges(self, types: list[str]) -> tuple[DataFrame, list[str]]:
        """Relationships of ``types`` (any, if none are named): src, dst, type, EID, properties."""
        parts = [t.df.withColumn("type", F.lit(k)) for k, t in self.rels.items() if not types or k in types]
        parts = [p if EID in p.columns else p.withColumn(EID, F.lit(None).cast("long")) for p in parts]
        if not parts:
            return self.spark.createDataFrame([], f"src long, dst long, type string, {EID} long"), []
        out = parts[0]
        for p in parts[1:]:
            out = _widened(out, p)
        return out, [c for c in out.columns if c not in ("src", "dst", "type", EID)]

    def save(self, path: str) -> None:
        """A Parquet folder for each node and relationship table."""
        for key, df in self.nodes.items():
            df.write.mode("overwrite").parquet(f"{path}/nodes/{'+'.join(key)}")
        for key, t in self.rels.items():
            t.df.write.mode("overwrite").parquet(f"{path}/rels/{key}")


def _widened(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; a property of two types becomes a double if both are numbers, else a string."""
    kinds = {c: t for c, t in a.dtypes}
    number = {"int", "bigint", "double", "float", "smallint", "tinyint"}
    for c, t in b.dtypes:
        if c in kinds and kinds[c] != t:
            to = ("bigint" if {t, kinds[c]} <= {"int", "bigint", "smallint", "tinyint"} else "double") if t in number and kinds[c] in number else "string"
            a, b = a.withColumn(c, F.col(c).cast(to)), b.withColumn(c, F.col(c).cast(to))
    return a.unionByName(b, allowMissingColumns=True)


def load_csv(spark: SparkSession, url: str, headers: bool, sep: str | None) -> DataFrame:
    """One column ``row``: a map of strings with headers, else a list of strings. Quoted fields may span lines."""
    path = re.sub(r"^file://(?=/)", "", url)
    df = spark.read.option("header", headers).option("sep", {"\\t": "\t"}.get(sep, sep) or ",").option("multiLine", True).option("escape", '"').csv(path)
    if headers:
        return df.select(F.map_from_arrays(F.array(*map(F.lit, df.columns)), F.array(*(F.col(f"`{c}`") for c in df.columns))).alias("row"))
    return df.select(F.array(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


_CASTS = {"int": "bigint", "integer": "bigint", "long": "bigint", "float": "double", "double": "double", "boolean": "boolean", "bool": "boolean", "string": "string"}


def _typed(df: DataFrame, delimiter: str, lenient: bool) -> tuple[DataFrame, dict[str, str]]:
    """Columns of a bulk file by their headers: name, name:TYPE, name:TYPE[], and the marked ones by mark. What has no
    type is text, but keeps the type that a JSON file gives it."""
    marks, out = {}, []
    for c in df.columns:
        name, _, kind = c.partition(":")
        base = re.sub(r"\(.*\)", "", kind).upper()
        if base in ("ID", "LABEL", "START_ID", "END_ID", "TYPE"):
            marks[base] = c
            out.append(F.col(f"`{c}`").cast("string").alias(f"__{base}"))
            continue
        if not kind and dict(df.dtypes)[c] != "string":  # JSON brings types of its own
            out.append(F.col(f"`{c}`").alias(name))
            continue
        many, to = kind.endswith("[]"), _CASTS.get(kind.removesuffix("[]").lower() or "string", "string")
        x = F.split(F.col(f"`{c}`"), re.escape(delimiter)) if many else F.col(f"`{c}`")
        to = f"array<{to}>" if many else to
        out.append((x.try_cast(to) if lenient else x.cast(to)).alias(name))
    return df.select(*out), marks


def _read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    if kind == "jsonl" or (kind == "auto" and path.endswith((".jsonl", ".json"))):
        return spark.read.json(path)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def import_graph(spark: SparkSession, nodes: list[str], rels: list[str], kind: str = "auto", array_delimiter: str = ";", skip_bad_entries: bool = False) -> PropertyGraph:
    """A graph from node and relationship files with :ID, :LABEL, :START_ID, :END_ID and :TYPE columns (JSONL: id,
    labels, start, end, type). Ids are hashes of the files' ids; a row whose id is missing fails, or is skipped."""
    graph = PropertyGraph(spark)
    key = lambda c: F.xxhash64(F.col(c).cast("string"))
    for path in nodes:
        raw = _read(spark, path, kind)
        if ":ID" not in "".join(raw.columns):
            raw = raw.withColumnsRenamed({"id": "id:ID", "labels": ":LABEL"})
            if dict(raw.dtypes).get(":LABEL", "").startswith("array"):
                raw = raw.withColumn(":LABEL", F.array_join("`:LABEL`", ";"))
        df, marks = _typed(raw, array_delimiter, skip_bad_entries)
        df = df.filter("__ID IS NOT NULL") if skip_bad_entries else df.withColumn("__ID", F.coalesce("__ID", F.raise_error(F.lit("node without id")).cast("string")))
        df = df.withColumn("id", key("__ID")).withColumn("__LABEL", F.coalesce("__LABEL", F.lit("")) if "LABEL" in marks else F.lit(""))
        for r in df.select("__LABEL").distinct().collect():
            labels = tuple(x for x in r[0].split(";") if x)
            part = df.filter(F.col("__LABEL") == r[0]).drop("__LABEL", "__ID")
            graph = graph.with_nodes(labels, _widened(graph.nodes[labels], part) if labels in graph.nodes else part)
    for path in rels:
        raw = _read(spark, path, kind)
        if ":START_ID" not in "".join(raw.columns):
            raw = raw.withColumnsRenamed({"start": ":START_ID", "end": ":END_ID", "type": ":TYPE"})
        df, _ = _typed(raw, array_delimiter, skip_bad_entries)
        if skip_bad_entries:
            df = df.filter("__START_ID IS NOT NULL AND __END_ID IS NOT NULL AND __TYPE IS NOT NULL")
        df = df.withColumns({"src": key("__START_ID"), "dst": key("__END_ID")})
        for r in df.select("__TYPE").distinct().collect():
            part = df.filter(F.col("__TYPE") == r[0]).drop("__TYPE", "__START_ID", "__END_ID")
            graph = graph.with_rels(r[0], _widened(graph.rels[r[0]].df, part) if r[0] in graph.rels else part)
    return graph
