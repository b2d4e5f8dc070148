"""The engine: queries, procedures, transactions, indexes and constraints over versions of a property graph."""

from __future__ import annotations

import atexit
import re
import tempfile
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.scalar import register_function
from .operators import algorithms as alg
from .operators import quantizer
from .plans.builder import QueryBuilder
from .plans.compiler import has_aggregate
from .plans.parser import QueryError, names, parse
from .plans.writes import Writer
from .sources.graph import PropertyGraph

_WRITES = {"create_pattern", "merge", "set", "remove", "delete", "foreach"}
_TYPES = {"BOOLEAN": ("boolean",), "INTEGER": ("int", "bigint"), "FLOAT": ("double", "float"), "STRING": ("string",), "LIST": ("array",), "MAP": ("map", "struct")}


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may be gone already  # noqa: BLE001
        pass


class GraphEngine:
    def __init__(self, spark: SparkSession, graph: PropertyGraph | None = None, read_only: bool = False):
        self.spark, self.graph, self.read_only = spark, graph or PropertyGraph(spark), read_only
        self.projections: dict[str, tuple[DataFrame, DataFrame]] = {}
        self.indexes: dict[str, dict] = {}
        self.constraints: dict[str, dict] = {}
        self.config: dict[str, str] = {"query.max_hops": "50", "plan_cache.size": "128"}
        self.stats = {"queries": 0, "writes": 0, "cache_hits": 0}
        self.cache: OrderedDict[str, dict] = OrderedDict()
        self.next_id = 1 << 50
        self._saved: list[tuple] = []
        self.procedures: dict[str, Callable[..., DataFrame]] = {
            "gds.graph.project": self._project, "gds.graph.drop": self._drop, "gds.pagerank.stream": self._pagerank, "gds.wcc.stream": lambda g: alg.connected(*self._named(g)[:2], self.settle),
            "gds.betweenness.stream": lambda g, n=0: alg.betweenness(*self._named(g), self.settle, n).orderBy(F.desc("score"), "nodeId"), "gds.closeness.stream": lambda g, n=0: alg.closeness(*self._named(g), self.settle, n).orderBy(F.desc("score"), "nodeId"),
            "gds.shortestpath.dijkstra.stream": self._dijkstra, "algo.shortestpath": self._shortest, "db.index.vector.querynodes": self._vector, "db.index.vector.train": self._train,
            "dbms.listconfig": lambda: self._rows(sorted(self.config.items()), "key string, value string"), "dbms.getconfig": lambda k: self._rows([(k, self.config.get(k))], "key string, value string"), "dbms.setconfig": self._set_config,
            "dbms.showstats": lambda: self._rows([("engine", k, str(v)) for k, v in self.stats.items()], "category string, metric string, value string"), "dbms.resetstats": self._reset,
            "dbms.createlabelindex": self._label_index, "dbms.droplabelindex": self._drop_label_index,
        }

    # -- running ---------------------------------------------------------------------------------------------------
    def cypher(self, text: str, **params) -> DataFrame:
        """Run a statement; reads come back as a lazy DataFrame, writes are done when this returns."""
        self.stats["queries"] += 1
        t = time.time()
        if text in self.cache:
            self.stats["cache_hits"] += 1
            self.cache.move_to_end(text)
        else:
            self.cache[text] = parse(text)
            while len(self.cache) > int(self.config["plan_cache.size"]):
                self.cache.popitem(last=False)
        self._parse_ms = (time.time() - t) * 1e3
        return self._run(self.cache[text], params)

    def builder(self) -> QueryBuilder:
        return QueryBuilder(self)

    def _run(self, stmt: dict, params: dict) -> DataFrame:
        kind = stmt["kind"]
        if kind == "query":
            return self._query(stmt, params)
        if kind == "explain":
            rows = outline(stmt["body"])
            saved = self.graph
            df = Writer(self, params).query(stmt["body"]) if not self._writes(stmt["body"]) else None
            self.graph = saved
            plan = [("physical", df._jdf.queryExecution().toString())] if df is not None else []
            return self._rows(rows + plan, "operator string, details string")
        if kind == "profile":
            t = time.time()
            df = self._run(stmt["body"], params)
            t2 = time.time()
            df.write.format("noop").mode("overwrite").save()
            return self._rows([("parse", self._parse_ms, 1), ("plan", (t2 - t) * 1e3, 1), ("execute", (time.time() - t2) * 1e3, 1)], "phase string, total_time_ms double, calls int")
        if kind in ("begin", "commit", "rollback"):
            getattr(self, kind)()
            return self._rows([(f"{kind} ok",)], "result string")
        self.cache.clear()
        return self._ddl(stmt)

    @staticmethod
    def _writes(stmt: dict) -> bool:
        def deep(clauses: list) -> bool:
            return any(c["kind"] in _WRITES or (c["kind"] == "sub" and deep(c["body"])) for c in clauses)

        return any(deep(p) for p in stmt["parts"])

    def _query(self, stmt: dict, params: dict) -> DataFrame:
        if not self._writes(stmt):
            return Writer(self, params).query(stmt)
        if self.read_only:
            raise QueryError("this engine is read-only")
        saved, self.stats["writes"] = (self.graph, self.next_id), self.stats["writes"] + 1
        try:
            out = Writer(self, params).query(stmt)
            for name, c in self.constraints.items():
                self._check(name, c)
            return self.settle(out) if out is not None else self._rows([], "result string")
        except Exception:
            self.graph, self.next_id = saved
            raise

    def settle(self, df: DataFrame) -> DataFrame:
        """Checkpoint in the shared folder."""
        self.shared_folder()
        return df.checkpoint()

    def store(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet in the shared folder, which takes less room than a checkpoint, and read it back; what
        Parquet can't hold is checkpointed. The table is removed when the driver ends."""
        if not all(re.fullmatch(r"boolean|(?:tiny|small|big)?int|double|float|string|date", t) for _, t in df.dtypes):
            return self.settle(df)
        path = f"{self.shared_folder()}/written-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        atexit.register(_remove, self.spark, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def shared_folder(self) -> str:
        """The folder the cluster names for checkpoints. Only a local master, which shares everything, gets a temporary
        folder where none is named."""
        sc = self.spark.sparkContext
        if sc.getCheckpointDir() is None:
            named = sc.getConf().get("spark.checkpoint.dir")
            if named is None and not sc.master.startswith("local"):
                raise QueryError("set spark.checkpoint.dir to a folder that all executors and the driver share")
            sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphloom-"))
        return sc.getCheckpointDir()

    def _rows(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    # -- transactions ----------------------------------------------------------------------------------------------
    def begin(self) -> None:
        self._saved.append((self.graph, self.next_id))

    def commit(self) -> None:
        if not self._saved:
            raise QueryError("no transaction")
        self._saved.pop()

    def rollback(self) -> None:
        if not self._saved:
            raise QueryError("no transaction")
        self.graph, self.next_id = self._saved.pop()

    # -- schema ----------------------------------------------------------------------------------------------------
    def _ddl(self, s: dict) -> DataFrame:
        if s["kind"] == "show":
            if s["what"] == "constraints":
                return self._rows([(n, c["rule"], "relationship" if c["edge"] else "node", c["label"], ",".join(c["props"])) for n, c in sorted(self.constraints.items())], "name string, type string, entity string, label string, properties string")
            return self._rows([(n, c["type"], c["label"], ",".join(c["props"])) for n, c in sorted(self.indexes.items())], "name string, type string, label string, properties string")
        store = self.constraints if s["what"] == "constraint" else self.indexes
        if s["kind"] == "drop":
            name = s.get("name") or next((n for n, c in store.items() if c["label"] == s["label"] and c["props"] == s["props"]), None)
            if name not in store and not s.get("missing_ok"):
                raise QueryError(f"no {s['what']} {name}")
            store.pop(name, None)
            return self._rows([("ok",)], "result string")
        name = s["name"] or f"{s['what']}_{s['label']}_{'_'.join(s['props'])}"
        if name in store:
            raise QueryError(f"{name} exists")
        entry = s | {"type": "vector" if s["what"] == "vector" else "composite" if len(s["props"]) > 1 else "property"}
        if s["what"] == "vector":
            options = {k.lower(): v[1] for k, v in s["options"].items()}
            entry["metric"] = str(options.get("metric", "L2"))
            entry["dim"] = options.get("dimension", options.get("dim"))
        if s["what"] == "constraint":
            self._check(name, entry)
        store[name] = entry
        return self._rows([("ok",)], "result string")

    def _check(self, name: str, c: dict) -> None:
        tables = [t.df for k, t in self.graph.rels.items() if k == c["label"]] if c["edge"] else [self.graph.scan([c["label"]])[0]]
        for df in tables:
            missing = [p for p in c["props"] if p not in df.columns]
            if c["rule"] in ("not null", "key") and (not df.isEmpty() if missing else not df.filter(" OR ".join(f"`{p}` IS NULL" for p in c["props"])).isEmpty()):
                raise QueryError(f"constraint {name}: a value is missing")
            if missing:
                continue
            if c["rule"] in ("unique", "key") and not df.filter(" AND ".join(f"`{p}` IS NOT NULL" for p in c["props"])).groupBy(*c["props"]).count().filter("count > 1").isEmpty():
                raise QueryError(f"constraint {name}: a value repeats")
            if c["rule"].startswith("type") and not dict(df.dtypes)[c["props"][0]].startswith(_TYPES[c["rule"].split()[1]]):
                raise QueryError(f"constraint {name}: a value has another type")

    # -- procedures ------------------------------------------------------------------------------------------------
    def procedure(self, name: str, args: list) -> DataFrame:
        if name.lower() not in self.procedures:
            raise QueryError(f"unknown procedure {name}")
        return self.procedures[name.lower()](*args)

    def register_procedure(self, name: str, f: Callable[..., DataFrame]) -> None:
        self.procedures[name.lower()] = f

    register_function = staticmethod(register_function)

    def _project(self, name: str, label: str = "", kind: str = "", weight: str | None = None) -> DataFrame:
        if name in self.projections:
            raise QueryError(f"graph {name} exists")
        nodes = self.settle(self.graph.scan([label] if label else [])[0].select("id"))
        edges, props = self.graph.edges([kind] if kind else [])
        w = F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(1.0)) if weight in props else F.lit(1.0)
        edges = edges.select("src", "dst", w.alias("weight")).join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
        self.projections[name] = nodes, self.settle(edges.select("src", "dst", "weight"))
        return self._rows([(name, nodes.count(), self.projections[name][1].count())], "name string, nodeCount long, edgeCount long")

    def _named(self, name: str) -> tuple[DataFrame, DataFrame]:
        if name not in self.projections:
            raise QueryError(f"no graph {name}")
        return self.projections[name]

    def _drop(self, name: str) -> DataFrame:
        self._named(name)
        del self.projections[name]
        return self._rows([(name,)], "name string")

    def _pagerank(self, g: str, rounds: int = 20, damping: float = 0.85) -> DataFrame:
        return alg.pagerank(*self._named(g), self.settle, rounds, damping).orderBy(F.desc("score"), "nodeId")

    def _dijkstra(self, g: str, s: int, t: int) -> DataFrame:
        nodes, edges = self._named(g)
        if nodes.filter(F.col("id").isin(s, t)).count() < len({s, t}):
            return self._rows([], "nodeId long, node struct<id: long, labels: array<string>>, cost double, totalCost double")
        path = alg.dijkstra(edges, s, t, self.settle)
        node = self.graph.scan([])[0].select("id", F.struct("id", "labels").alias("node"))
        return node.join(F.broadcast(path), F.col("id") == F.col("nodeId")).orderBy("step").select("nodeId", "node", "cost", "totalCost")  # a path of two known ends

    def _shortest(self, s: int, t: int) -> DataFrame:
        found = alg.bfs(self.graph.edges([])[0], s, self.settle, None, t).filter(F.col("nodeId") == t)
        return found.select(F.posexplode("path").alias("step", "node"), F.size("path").cast("long").alias("path_length"))

    def _index(self, name: str) -> dict:
        if name not in self.indexes or self.indexes[name]["type"] != "vector":
            raise QueryError(f"no vector index {name}")
        return self.indexes[name]

    def _vector(self, name: str, k: int, query: list[float]) -> DataFrame:
        """The k nearest nodes: of all, or, if the index was trained on this version of the graph, of a shortlist by codes."""
        c = self._index(name)
        book, codes, version = c.get("trained", (None, None, None))
        if version is self.graph and book.dim == len(query):
            return alg.nearest(book.candidates(codes, query, k), "vec", query, k, c["metric"])
        return alg.nearest(self.graph.scan([c["label"]])[0], c["props"][0], query, k, c["metric"])

    def _train(self, name: str) -> DataFrame:
        """Learn a codebook and encode all vectors. What is written afterwards makes the search exact until the next call."""
        c = self._index(name)
        nodes, _ = self.graph.scan([c["label"]])
        prop = c["props"][0]
        first = nodes.filter(F.col(prop).isNotNull()).select(F.size(prop).alias("d")).head() if c["dim"] is None and prop in nodes.columns else None
        dim = first["d"] if first else c["dim"]
        book = quantizer.Codebook(quantizer.usable(nodes, prop, int(dim)), int(dim), c["metric"]) if dim and prop in nodes.columns else None
        if book is None or not book.trained_on:
            return self._rows([("Skipped (Empty Data)",)], "status string")
        path = f"{self.shared_folder()}/vectors-{uuid.uuid4().hex}"
        c["trained"] = book, book.write(quantizer.usable(nodes, prop, book.dim), path), self.graph
        return self._rows([("Success",)], "status string")

    def _label_index(self, name: str = "label") -> DataFrame:
        self.indexes[name] = {"type": "label", "label": "", "props": []}
        return self._rows([("ok",)], "result string")

    def _drop_label_index(self, name: str = "label") -> DataFrame:
        if self.indexes.pop(name, None) is None:
            raise QueryError(f"no index {name}")
        return self._rows([("ok",)], "result string")

    def _set_config(self, key: str, value) -> DataFrame:
        self.config[key] = str(value)
        return self._rows([(key, str(value), "ok")], "key string, value string, status string")

    def _reset(self) -> DataFrame:
        self.stats = dict.fromkeys(self.stats, 0)
        return self._rows([("ok",)], "result string")

    # -- native methods --------------------------------------------------------------------------------------------
    def get_shortest_path(self, s: int, t: int, max_depth: int = 15) -> DataFrame:
        return alg.bfs(self.graph.edges([])[0], s, self.settle, max_depth, t).filter(F.col("nodeId") == t)

    def bfs(self, start: int) -> DataFrame:
        """(nodeId, depth, path) of all that a node reaches, along relationships of either direction."""
        return alg.bfs(self.graph.edges([])[0], start, self.settle)

    def find_all_paths(self, s: int, t: int, max_depth: int = 15) -> DataFrame:
        return alg.all_paths(self.graph.edges([])[0], s, t, self.settle, max_depth)

    def create_nodes(self, labels: str | list[str], rows: list[dict]) -> DataFrame:
        """Add a node for each row of properties; (id, properties) of what was made."""
        names = [labels] if isinstance(labels, str) else list(labels)
        keys = list(dict.fromkeys(k for r in rows for k in r))
        made = ", ".join(f"`{k}`: r.`{k}`" for k in keys)
        shown = ", ".join(["id(n) AS id", *(f"n.`{k}` AS `{k}`" for k in keys)])
        return self.cypher(f"UNWIND $rows AS r CREATE (n{''.join(f':`{x}`' for x in names)} {{{made}}}) RETURN {shown}", rows=rows or [{}])

    def create_node(self, labels: str | list[str], **props) -> int:
        """Add one node; its id."""
        return self.create_nodes(labels, [props]).head()[0]

    def create_edges(self, kind: str, rows: list[tuple[int, int, dict]]) -> None:
        """Add a relationship for each (source id, target id, properties)."""
        keys = list(dict.fromkeys(k for *_, p in rows for k in p))
        made = [{"__s": s, "__t": t} | {k: p.get(k) for k in keys} for s, t, p in rows]
        if made:
            props = " {" + ", ".join(f"`{k}`: r.`{k}`" for k in keys) + "}" if keys else ""
            self.cypher(f"UNWIND $rows AS r MATCH (a) WHERE id(a) = r.`__s` MATCH (b) WHERE id(b) = r.`__t` CREATE (a)-[:`{kind}`{props}]->(b)", rows=made)

    def create_edge(self, source: int, target: int, kind: str, **props) -> None:
        self.create_edges(kind, [(source, target, props)])

    # -- results ---------------------------------------------------------------------------------------------------
    def fetchall(self, text: str, **params) -> list[dict]:
        return [r.asDict() for r in self.cypher(text, **params).collect()]

    def single(self, text: str, **params) -> dict:
        """The one row of a query; none or several raise."""
        rows = self.cypher(text, **params).take(2)
        if len(rows) != 1:
            raise QueryError("not one row")
        return rows[0].asDict()

    def scalar(self, text: str, **params):
        """The first column of the first row, or None."""
        row = self.cypher(text, **params).head()
        return None if row is None else row[0]

    def to_df(self, text: str, **params):
        """A query's rows as a pandas frame."""
        return self.cypher(text, **params).toPandas()


#: What a clause is called in an outline.
_STEPS = {"unwind": "Unwind", "load": "LoadCsv", "call": "ProcedureCall", "sub": "CallSubquery", "merge": "Merge", "set": "Set", "remove": "Remove", "delete": "Delete", "foreach": "Foreach"}


def outline(stmt: dict) -> list[tuple[str, str]]:
    """(operator, details) of a query, in the order of its clauses."""
    rows: list[tuple[str, str]] = []
    node = lambda n: f"({n['var'] or ''}{''.join(':' + x for x in n['labels'])}{' ' + ', '.join(n['props']) if n['props'] else ''})"
    for k, part in enumerate(stmt["parts"]):
        if k:
            rows.append(("Union" if not stmt["alls"][k - 1] else "UnionAll", ""))
        for c in part:
            if c["kind"] in ("match", "create_pattern"):
                new = c["kind"] == "create_pattern"
                for p in c["patterns"]:
                    rows.append(("CreateNode" if new else "OptionalMatch" if c["optional"] else "NodeScan", node(p["nodes"][0])))
                    for r, n in zip(p["rels"], p["nodes"][1:], strict=True):
                        hops = f" *{r['lo']}..{r['hi']}" if r["hi"] is not None else ""
                        rows.append(("CreateEdge" if new else "VarLengthTraversal" if hops else "Traversal", f"{r['dir']} {'|'.join(r['types'])}{hops} {node(n)}"))
                if not new and c["where"] is not None:
                    rows.append(("Filter", ", ".join(sorted(names(c["where"])))))
            elif c["kind"] in ("return", "with"):
                shown = ", ".join([*(["*"] if c["star"] else []), *(a for _, a in c["items"])])
                rows.append(("Aggregate" if any(has_aggregate(e) for e, _ in c["items"]) else "Project", shown))
                rows += [("Distinct", "")] * c["distinct"]
                if c["order"]:
                    rows.append(("Sort", ", ".join("ASC" if up else "DESC" for _, up in c["order"])))
                rows += [(w.capitalize(), str(c[w])) for w in ("skip", "limit") if c[w] is not None]
                if c["where"] is not None:
                    rows.append(("Filter", ", ".join(sorted(names(c["where"])))))
            else:
                rows.append((_STEPS[c["kind"]], str(c.get("name") or c.get("var") or "")))
    return rows
