"""Clauses to DataFrames. A bound node or relationship is a group of columns, so Catalyst prunes what isn't read."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import AGGREGATES, FUNCTIONS, duration
from ..sources.graph import EID, PropertyGraph, load_csv
from .parser import QueryError, children, names

_fresh = itertools.count()
#: Columns of a bound relationship besides its properties.
REL = ("src", "dst", "type", "eid")
#: Values of different kinds compare by the order of their kinds.
KINDS = ("bool", "number", "string", "list", "map")
Local = dict[str, tuple[Column, T.DataType]]


def fresh(stem: str) -> str:
    return f"{stem}__{next(_fresh)}"


@dataclass
class Entity:
    """A variable: kind node, rel, path or value, and its columns by role; of a node also the one table it is from."""

    kind: str
    cols: dict[str, str]
    props: dict[str, str] = field(default_factory=dict)
    table: str | None = None

    @property
    def key(self) -> list[str]:
        return {"node": ["id"], "rel": list(REL), "path": ["nodes", "rels"], "value": ["v"]}[self.kind]

    def identity(self) -> list[str]:
        """Columns that tell its values apart: properties follow from a node's id, not from a relationship's ends."""
        return [self.cols[k] for k in self.key] + (list(self.props.values()) if self.kind == "rel" else [])

    def columns(self) -> list[str]:
        return [*self.cols.values(), *self.props.values()]

    def packed(self) -> Column:
        c = {k: F.col(v) for k, v in self.cols.items()}
        if self.kind == "value":
            return c["v"]
        if self.kind == "path":
            return F.struct(c["nodes"].alias("nodes"), c["rels"].alias("rels"))
        props = [F.col(v).alias(k) for k, v in self.props.items()]
        shown = [c[k].alias(k) for k in (("id", "labels") if self.kind == "node" else ("src", "dst", "type"))]
        return F.when(c["id" if self.kind == "node" else "src"].isNotNull(), F.struct(*shown, *props))


class Frame:
    """Rows and what their columns are; ``once`` is a node or relationship that no two rows share, where that is known."""

    def __init__(self, df: DataFrame, scope: dict[str, Entity], unit: bool = False, outer: list[str] | None = None, once: str | None = None):
        self.df, self.scope, self.unit, self.outer, self.once = df, scope, unit, outer or [], once


def _same(pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in pairs), F.lit(True))


def conjuncts(e) -> list:
    return [*conjuncts(e[2]), *conjuncts(e[3])] if e[:2] == ("bin", "AND") else [e]


def is_duration(t: T.DataType) -> bool:
    return isinstance(t, T.StructType) and t.fieldNames() == ["months", "days", "nanos"]


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.ArrayType):
        return "list"
    if is_duration(t):
        return "duration"
    if isinstance(t, (T.StructType, T.MapType)):
        return "map"
    return "mixed" if isinstance(t, T.VariantType) else "null" if isinstance(t, T.NullType) else "time"


def span(d: Column) -> Column:
    """What durations are ordered by: a month is 30 days."""
    return F.struct((d["months"] * 30 + d["days"]).alias("days"), d["nanos"].alias("nanos"))


def mixed(c: Column, t: T.DataType) -> Column:
    """A value of any type as an element of a list of several types."""
    if kind_of(t) in ("mixed", "null"):
        return c if kind_of(t) == "mixed" else F.lit(None).cast("variant")
    return F.to_variant_object(c) if kind_of(t) in ("map", "list", "duration") else c.cast("variant")


_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"


def same_mixed(v: Column, c: Column, t: T.DataType) -> Column:
    """Whether an element of a list of several types is equal to a value."""
    kind, shape = kind_of(t), F.schema_of_variant(v)
    if kind == "mixed":
        return F.to_json(v) == F.to_json(c)
    fits = F.rlike(shape, F.lit(_NUMBER)) if kind == "number" else shape == {"bool": "BOOLEAN", "string": "STRING"}.get(kind, "")
    got = F.try_variant_get(v, "$", "double" if kind == "number" else t.simpleString()) if kind in KINDS[:3] else F.lit(None)
    return F.when(v.isNotNull() & c.isNotNull(), F.coalesce(fits & (got == c), F.lit(False))) if kind in KINDS[:3] else F.lit(False)


def has_aggregate(e) -> bool:
    return any(x[0] == "fn" and len(x) == 4 and x[1] in AGGREGATES for x in children(e))


def _literal(v) -> tuple:
    """A parameter's value as an expression."""
    if isinstance(v, (list, tuple)):
        return ("list", [_literal(x) for x in v])
    return ("map", [(str(k), _literal(x)) for k, x in v.items()]) if isinstance(v, dict) else ("lit", v)


class Compiler:
    def __init__(self, engine, params: dict):
        self.engine, self.params = engine, params
        self.spark = engine.spark
        self._types: dict[tuple, tuple] = {}

    @property
    def max_hops(self) -> int:
        return int(self.engine.config["query.max_hops"])

    @property
    def graph(self) -> PropertyGraph:
        return self.engine.graph

    # -- queries ---------------------------------------------------------------------------------------------------
    def unit(self) -> Frame:
        return Frame(self.spark.range(1).select(F.lit(1).alias(fresh("unit"))), {}, True)

    def query(self, stmt: dict) -> DataFrame | None:
        outs = [self.single(p) for p in stmt["parts"]]
        out = outs[0]
        for nxt, keep in zip(outs[1:], stmt["alls"], strict=True):
            if out.columns != nxt.columns:
                raise QueryError(f"UNION needs equal columns: {out.columns} and {nxt.columns}")
            out = out.unionByName(nxt)
            out = out if keep else out.distinct()
        return out

    def single(self, clauses: list[dict]) -> DataFrame | None:
        self.used = names([c for c in clauses if c["kind"] not in ("match",)]) | names([c["where"] for c in clauses if c["kind"] == "match"])
        self.used |= {x[1] for x in children(clauses) if x[0] == "var"}
        if any(c["kind"] in ("return", "with") and c["star"] or c["kind"] in ("set", "remove", "delete", "merge", "create_pattern", "foreach") for c in clauses):
            self.used |= names(clauses)
        frame, self.ending = self.unit(), clauses[-1]
        for c in clauses:
            frame = self.clause(frame, c)
            if c["kind"] == "return":
                return self.result(frame)
        last = clauses[-1]
        return self.result(frame) if last["kind"] == "call" else None

    def result(self, frame: Frame) -> DataFrame:
        return frame.df.select(*(e.packed().alias(v) for v, e in frame.scope.items()))

    def clause(self, frame: Frame, c: dict) -> Frame:
        return getattr(self, "do_" + c["kind"])(frame, c)

    # -- reading ---------------------------------------------------------------------------------------------------
    def do_match(self, frame: Frame, c: dict) -> Frame:
        if c["optional"]:
            sub, keys = self.correlated(frame, c["patterns"], c["where"])
            new = {v: e for v, e in sub.scope.items() if v not in frame.scope}
            alias = [(k, fresh("key")) for k in keys]
            right = sub.df.select(*(F.col(k).alias(a) for k, a in alias), *(x for e in new.values() for x in e.columns()))
            df = frame.df.join(right, _same(alias), "left").drop(*(a for _, a in alias))
            return Frame(df, frame.scope | new, frame.unit and not keys and False, frame.outer)
        out = Frame(frame.df, dict(frame.scope), frame.unit, frame.outer)
        for p in c["patterns"]:
            out = self.pattern(out, p)
        return self.where(out, c["where"])

    def where(self, frame: Frame, e) -> Frame:
        """Filters first; conditions that a pattern exists, or doesn't, are semi and anti joins."""
        found = []
        for x in conjuncts(e) if e is not None else ():
            y = x[2] if x[:2] == ("un", "NOT") else x
            if y[0] == "exists" and (y[1]["var"] is not None or y[1]["rels"]):
                found.append((y, "left_semi" if y is x else "left_anti"))
            else:
                frame.df = frame.df.filter(self.expr(x, frame).cast("boolean"))
        for y, how in found:
            frame.df = self.semi(frame, y[1], y[2], how)
        return frame

    def semi(self, frame: Frame, p: dict, where, how: str) -> DataFrame:
        nodes, rels = p["nodes"], p["rels"]
        flip = {"out": "in", "in": "out", "both": "both"}
        ways = [r["dir"] for r in rels]
        if nodes[0]["var"] not in frame.scope:
            nodes, rels, ways = nodes[::-1], rels[::-1], [flip[w] for w in ways[::-1]]
        at = frame.scope.get(nodes[0]["var"])
        alone = at is not None and at.kind == "node" and not nodes[0]["labels"] and not nodes[0]["props"] and rels and rels[0]["hi"] is None
        if not alone or p["fn"] or names([nodes[1:], rels, where, {"nodes": nodes[1:], "rels": rels}]) & set(frame.scope):
            sub, keys = self.correlated(frame, [p], where)
            alias = [(k, fresh("key")) for k in keys]
            right = sub.df.select(*(F.col(k).alias(a) for k, a in alias))
            return frame.df.join(right, _same(alias), how)
        # The pattern reads one outer node only, so it is matched once, from its first relationship on.
        vars_ = [n["var"] or fresh("anon") for n in nodes]
        sub, key = self.first_hop(rels[0], ways[0], nodes[1], vars_[1])
        for i in range(1, len(rels)):
            sub, _ = self.expand(sub, vars_[i], rels[i], ways[i], nodes[i + 1], vars_[i + 1], True)
        right = self.where(sub, where).df.select(F.col(key))
        return frame.df.join(right, F.col(at.cols["id"]) == F.col(key), how)

    def first_hop(self, rel: dict, way: str, n: dict, b: str) -> tuple[Frame, str]:
        """All matches of a hop, and the column with the id of the node it starts from."""
        key = fresh("key")
        far = self.keyed_far(rel, way, n, b)
        if far is not None:
            far, other = far
            df = far.df.withColumn(key, other)
            return self.inline(Frame(df, dict(far.scope)), b, {k: v for k, v in n["props"].items() if names(v)}), key
        right, to, e = self.hop(rel, way, key)
        scope = {rel["var"]: e} if rel["var"] else {}
        return self.arrive(Frame(right, scope), to, rel, way, n, b), key

    def correlated(self, frame: Frame, patterns: list, where, keep: set[str] = frozenset(), extra=None, whole: bool = False) -> tuple[Frame, list[str]]:
        """A frame of the distinct outer values that patterns and where read, matched on; and the outer columns that
        tell them apart (all their columns, if ``whole``)."""
        read = (names([patterns, where, extra]) | keep) & set(frame.scope)
        props = {(x[1][1], x[2]) for x in children([patterns, where, extra]) if x[0] == "prop" and x[1][0] == "var"}
        packed = {x[1] for x in children([extra]) if x[0] == "var"}
        scope, keys, columns = {}, list(frame.outer), list(frame.outer)
        for v in sorted(read):
            e = frame.scope[v]
            got = {p: c for p, c in e.props.items() if e.kind == "rel" or (v, p) in props or v in keep or v in packed}
            scope[v] = Entity(e.kind, dict(e.cols), got, e.table)
            keys += scope[v].columns() if whole else scope[v].identity()
            columns += scope[v].columns()
        keys, columns = list(dict.fromkeys(keys)), list(dict.fromkeys(columns))
        base = frame.df.select(*columns).dropDuplicates(keys) if keys else self.unit().df
        sub = Frame(base, scope, not keys)
        for p in patterns:
            sub = self.pattern(sub, p)
        return self.where(sub, where), keys

    def scan(self, frame: Frame, n: dict, var: str) -> Frame:
        df, props = self.graph.scan(n["labels"])
        e = Entity("node", {"id": fresh("id"), "labels": fresh("labels")}, {p: fresh(p) for p in props}, self.graph.only_table(n["labels"]))
        df = df.select(F.col("id").alias(e.cols["id"]), F.col("labels").alias(e.cols["labels"]), *(F.col(f"`{p}`").alias(c) for p, c in e.props.items()))
        only = Frame(df, {var: e})
        for k, v in n["props"].items():
            if not names(v):
                only.df = only.df.filter(F.col(e.props[k]) == self.expr(v, only)) if k in e.props else only.df.filter(F.lit(False))
        out = Frame(only.df if frame.unit else frame.df.crossJoin(only.df), frame.scope | {var: e}, False, frame.outer, var if frame.unit else None)
        return self.inline(out, var, {k: v for k, v in n["props"].items() if names(v)})

    def inline(self, frame: Frame, var: str, props: dict) -> Frame:
        for k, v in props.items():
            frame.df = frame.df.filter(self.expr(("prop", ("var", var), k), frame) == self.expr(v, frame))
        return frame

    def pattern(self, frame: Frame, p: dict) -> Frame:
        nodes, rels = p["nodes"], p["rels"]
        vars_ = [n["var"] or fresh("anon") for n in nodes]
        for n in nodes:
            if n["var"] in frame.scope and n["var"] is not None and frame.scope[n["var"]].kind != "node":
                raise QueryError(f"{n['var']} is not a node")
        start = next((i for i, v in enumerate(vars_) if v in frame.scope), None)
        if start is None:  # begin where a literal narrows the scan, else at a label
            start = max(range(len(nodes)), key=lambda i: (bool(nodes[i]["props"]), bool(nodes[i]["labels"]), -i))
            frame = self.scan(frame, nodes[start], vars_[start])
        else:
            frame = self.check(frame, nodes[start], vars_[start])
        if p["fn"]:
            return self.shortest(frame, p, vars_)
        hops: dict[int, tuple] = {}
        steps = [*((i, i + 1, i) for i in range(start, len(rels))), *((i + 1, i, i) for i in reversed(range(start)))]
        for a, b, r in steps:
            rel = rels[r]
            flip = {"out": "in", "in": "out", "both": "both"}
            way = rel["dir"] if b > a else flip[rel["dir"]]
            frame, hops[r] = self.expand(frame, vars_[a], rel, way, nodes[b], vars_[b], b > a)
        if p["var"]:
            e = Entity("path", {"nodes": fresh("nodes"), "rels": fresh("rels")})
            ids = [F.array(F.col(frame.scope[vars_[0]].cols["id"]))]
            for i in range(len(rels)):
                ids.append(hops[i][0])
            links = [hops[i][1] for i in range(len(rels))]
            frame.df = frame.df.withColumns({e.cols["nodes"]: F.concat(*ids), e.cols["rels"]: F.concat(*links) if links else F.array().cast("array<struct<type:string,src:bigint,dst:bigint>>")})
            frame.scope = frame.scope | {p["var"]: e}
        return frame

    def check(self, frame: Frame, n: dict, var: str) -> Frame:
        e = frame.scope[var]
        for label in n["labels"]:
            frame.df = frame.df.filter(F.array_contains(F.col(e.cols["labels"]), label))
        return self.inline(frame, var, n["props"])

    def edges(self, rel: dict, way: str) -> tuple[DataFrame, list[str]]:
        """(from, to, src, dst, type, eid, properties) in the direction of travel."""
        df, props = self.graph.edges(rel["types"])
        keep = ["src", "dst", "type", F.col(EID).alias("eid"), *(F.col(f"`{p}`") for p in props)]
        ahead = df.select(F.col("src").alias("__from"), F.col("dst").alias("__to"), *keep)
        back = df.select(F.col("dst").alias("__from"), F.col("src").alias("__to"), *keep)
        for k, v in rel["props"].items():
            ok = (F.col(f"`{k}`") == self.expr(v, self.unit())) if k in props else F.lit(False)
            ahead, back = ahead.filter(ok), back.filter(ok)
        out = ahead if way == "out" else back if way == "in" else ahead.unionByName(back.filter("src <> dst"))
        return out, props

    def hop(self, rel: dict, way: str, key: str) -> tuple[DataFrame, str, Entity]:
        """Relationships as columns: where they start (``key``), where they lead, and the bound relationship."""
        df, props = self.edges(rel, way)
        to = fresh("to")
        e = Entity("rel", {k: fresh(k) for k in REL}, {p: fresh(p) for p in props})
        return df.select(F.col("__from").alias(key), F.col("__to").alias(to), *(F.col(k).alias(v) for k, v in e.cols.items()), *(F.col(f"`{k}`").alias(v) for k, v in e.props.items())), to, e

    def foreign_key(self, rel: dict):
        """The node column that a one-type hop without properties is, if it is one."""
        if len(rel["types"]) != 1 or rel["hi"] is not None or rel["props"] or rel["types"][0] not in self.graph.rels:
            return None
        key = self.graph.rels[rel["types"][0]].key
        return key if key and self.graph.only_table([key.label]) == key.label else None

    def keyed_far(self, rel: dict, way: str, n: dict, b: str) -> tuple[Frame, Column] | None:
        """Where the far node's own table has the hop as a column: its rows, and the id of the near end."""
        key = self.foreign_key(rel)
        if key is None or way == "both" or key.end != (1 if way == "out" else 0) or rel["var"] or set(n["labels"]) - {key.label}:
            return None
        far = self.scan(Frame(self.unit().df, {}, True), {"labels": [key.label], "props": {k: v for k, v in n["props"].items() if not names(v)}}, b)
        e = far.scope[b]
        return far, key.other({p: F.col(e.props[p]) for p in key.reads})

    def near_key(self, e: Entity, rel: dict, way: str) -> Column | None:
        """Where the near node's own table has the hop as a column: the id of the far end."""
        key = self.foreign_key(rel)
        if key is None or way == "both" or key.end != (0 if way == "out" else 1) or e.table != key.label or not set(key.reads) <= set(e.props):
            return None
        return key.other({p: F.col(e.props[p]) for p in key.reads})

    def expand(self, frame: Frame, a: str, rel: dict, way: str, n: dict, b: str, forward: bool) -> tuple[Frame, tuple]:
        at = frame.scope[a].cols["id"]
        scope = dict(frame.scope)
        if rel["hi"] is not None:
            df, to = self.edges(rel, way)[0], fresh("to")
            link = F.struct(F.col("type"), F.col("src"), F.col("dst"))
            path, links = fresh("walk"), fresh("links")
            one = df.select(F.col("__from"), F.col("__to"), link.alias("__link"))
            cur = frame.df.withColumns({path: F.array(F.col(at)), links: F.array().cast("array<struct<type:string,src:bigint,dst:bigint>>")})
            parts = [cur] if rel["lo"] == 0 else []
            for hop in range(1, min(rel["hi"], self.max_hops) + 1):
                # A node once on a path; hops unrolled, so each is a plain join.
                cur = cur.join(one, F.element_at(F.col(path), -1) == F.col("__from")).filter(~F.array_contains(F.col(path), F.col("__to")))
                cur = cur.withColumns({path: F.concat(F.col(path), F.array("__to")), links: F.concat(F.col(links), F.array("__link"))}).drop("__from", "__to", "__link")
                if rel["hi"] > 4:  # long walks: cut the lineage, and stop where nothing is left
                    cur = self.engine.settle(cur)
                    if cur.isEmpty():
                        break
                if hop >= rel["lo"]:
                    parts.append(cur)
            out = reduce(DataFrame.unionByName, parts) if parts else cur.filter(F.lit(False))
            out = out.withColumn(to, F.element_at(F.col(path), -1))
            rest = F.slice(F.col(path), F.lit(2), F.size(path) - 1) if forward else F.reverse(F.slice(F.col(path), F.lit(1), F.size(path) - 1))
            hop = rest, F.col(links) if forward else F.reverse(F.col(links))
            if rel["var"]:
                scope[rel["var"]] = Entity("value", {"v": links})
            return self.arrive(Frame(out, scope, False, frame.outer), to, rel, way, n, b), hop
        far = self.keyed_far(rel, way, n, b) if b not in frame.scope else None
        if far is not None:
            far, other = far
            to = far.scope[b].cols["id"]
            out = Frame(frame.df.join(far.df, F.col(at) == other), scope | far.scope, False, frame.outer)
            hop = self.step(rel, way, at, to, forward)
            return self.inline(out, b, {k: v for k, v in n["props"].items() if names(v)}), hop
        other = self.near_key(frame.scope[a], rel, way) if rel["var"] not in frame.scope else None
        if other is not None:
            to = fresh("to")
            out = frame.df.withColumn(to, other).filter(F.col(to).isNotNull())
            if rel["var"]:
                src, dst = (at, to) if way == "out" else (to, at)
                e = Entity("rel", {k: fresh(k) for k in REL})
                out = out.withColumns({e.cols["src"]: F.col(src), e.cols["dst"]: F.col(dst), e.cols["type"]: F.lit(rel["types"][0]), e.cols["eid"]: F.lit(None).cast("long")})
                scope[rel["var"]] = e
            return self.arrive(Frame(out, scope, False, frame.outer), to, rel, way, n, b), self.step(rel, way, at, to, forward)
        key = fresh("key")
        right, to, e = self.hop(rel, way, key)
        out = frame.df.join(right, F.col(at) == F.col(key)).drop(key)
        if rel["var"] in frame.scope and rel["var"] is not None:
            old = frame.scope[rel["var"]]
            out = out.filter(_same([(e.cols[k], old.cols[k]) for k in e.key] + [(c, old.props[p]) for p, c in e.props.items() if p in old.props]))
        elif rel["var"]:
            scope[rel["var"]] = e
        hop = F.array(F.col(to) if forward else F.col(at)), F.array(F.struct(*(F.col(e.cols[k]).alias(k) for k in ("type", "src", "dst"))))
        there = self.arrive(Frame(out, scope, False, frame.outer), to, rel, way, n, b)
        there.once = rel["var"] if frame.once == a and way != "both" else None  # both nodes of a relationship are one row each
        return there, hop

    @staticmethod
    def step(rel: dict, way: str, at: str, to: str, forward: bool) -> tuple[Column, Column]:
        """What a hop over a node's column adds to a path."""
        src, dst = (at, to) if way == "out" else (to, at)
        return F.array(F.col(to if forward else at)), F.array(F.struct(F.lit(rel["types"][0]).alias("type"), F.col(src).alias("src"), F.col(dst).alias("dst")))

    def arrive(self, frame: Frame, to: str, rel: dict, way: str, n: dict, b: str) -> Frame:
        """Bind the far node of a hop, whose id is in column ``to``."""
        out, scope = frame.df, frame.scope
        if b in frame.scope:
            out = out.filter(F.col(to) == F.col(frame.scope[b].cols["id"]))
            return self.check(Frame(out, scope, False, frame.outer), n, b)
        ends = {t.ends[0 if way == "in" else 1] for k, t in self.graph.rels.items() if not rel["types"] or k in rel["types"]}
        known = next(iter(ends)) if len(ends) == 1 and way != "both" and rel["hi"] is None else None
        if not n["props"] and b not in self.used and (not n["labels"] or n["labels"] == [known]):
            # Nobody reads the far node and its label follows from the relationship: its table needn't be joined.
            labels = fresh("labels")
            out = out.withColumn(labels, F.array(F.lit(known)) if known else F.lit(None).cast("array<string>"))
            if known or not n["labels"]:
                return Frame(out, scope | {b: Entity("node", {"id": to, "labels": labels})}, False, frame.outer)
        far = self.scan(Frame(self.unit().df, {}, True), {"labels": n["labels"] or ([known] if known else []), "props": {k: v for k, v in n["props"].items() if not names(v)}}, b)
        e = far.scope[b]
        out = out.join(far.df, F.col(to) == F.col(e.cols["id"]))
        out = Frame(out, scope | {b: e}, False, frame.outer)
        return self.inline(out, b, {k: v for k, v in n["props"].items() if names(v)})

    def shortest(self, frame: Frame, p: dict, vars_: list[str]) -> Frame:
        """Breadth-first from the bound start of every row: one shortest path (the least by nodes), or all of them."""
        rel, (a, b) = p["rels"][0], vars_
        if b not in frame.scope:
            frame = self.scan(frame, p["nodes"][1], b) if a in frame.scope else frame
        if a not in frame.scope:
            frame = self.scan(frame, p["nodes"][0], a)
        s, t = (frame.scope[v].cols["id"] for v in (a, b))
        df, _ = self.edges(rel, rel["dir"])
        one = self.engine.settle(df.select("__from", "__to", F.struct("type", "src", "dst").alias("__link")))
        pairs = self.engine.settle(frame.df.select(F.col(s).alias("s"), F.col(t).alias("t")).distinct())
        # One search a source, whatever number of targets it has; it ends when all are found.
        seen = pairs.select("s", F.col("s").alias("n")).distinct()
        cur = seen.withColumns({"path": F.array("s"), "links": F.array().cast("array<struct<type:string,src:bigint,dst:bigint>>")})
        found, lo = None, rel["lo"] if rel["lo"] is not None else 1
        if lo == 0:
            found = cur.join(pairs, "s").filter("s = t").select("s", "t", "path", "links")
            pairs = pairs.filter("s <> t")
        for _ in itertools.count() if rel["open"] else range(min(rel["hi"] or 1, self.max_hops)):
            nxt = cur.join(one, F.col("n") == F.col("__from")).select("s", F.col("__to").alias("n"), F.concat("path", F.array("__to")).alias("path"), F.concat("links", F.array("__link")).alias("links"))
            nxt = nxt.join(seen, ["s", "n"], "left_anti")
            if p["fn"] == "shortestpath":
                nxt = nxt.groupBy("s", "n").agg(F.min(F.struct("path", "links")).alias("m")).select("s", "n", "m.path", "m.links")
            nxt = self.engine.settle(nxt)
            hit = nxt.join(pairs, (nxt["s"] == pairs["s"]) & (nxt["n"] == pairs["t"])).select(nxt["s"], "t", "path", "links")
            found = hit if found is None else found.unionByName(hit)
            seen = self.engine.settle(seen.unionByName(nxt.select("s", "n").distinct()))
            pairs = self.engine.settle(pairs.join(hit.select("s", "t").distinct(), ["s", "t"], "left_anti"))
            cur = nxt.join(pairs.select("s").distinct(), "s", "left_semi")
            if cur.isEmpty():
                break
        e = Entity("path", {"nodes": fresh("nodes"), "rels": fresh("rels")})
        ks, kt = fresh("s"), fresh("t")
        right = found.select(F.col("s").alias(ks), F.col("t").alias(kt), F.col("path").alias(e.cols["nodes"]), F.col("links").alias(e.cols["rels"]))
        out = frame.df.join(right, (F.col(s) == F.col(ks)) & (F.col(t) == F.col(kt))).drop(ks, kt)
        return Frame(out, frame.scope | ({p["var"]: e} if p["var"] else {}), False, frame.outer)

    def do_unwind(self, frame: Frame, c: dict) -> Frame:
        e = Entity("value", {"v": fresh(c["var"])})
        value = self.expr(c["expr"], frame)
        value = value if kind_of(self.type(c["expr"], frame, {}, value)) == "list" else F.array(value)
        return Frame(frame.df.withColumn(e.cols["v"], F.explode(value)), frame.scope | {c["var"]: e}, False, frame.outer)

    def do_load(self, frame: Frame, c: dict) -> Frame:
        url = self.constant(c["url"])
        df = load_csv(self.spark, url, c["headers"], self.constant(c["sep"]) if c["sep"] else None)
        e = Entity("value", {"v": fresh(c["var"])})
        df = df.select(F.col("row").alias(e.cols["v"]))
        return Frame(df if frame.unit else frame.df.crossJoin(df), frame.scope | {c["var"]: e}, False, frame.outer)

    def constant(self, e):
        if e[0] in ("lit", "param"):
            return e[1] if e[0] == "lit" else self.param(e[1])
        if e[0] == "list":
            return [self.constant(x) for x in e[1]]
        if e[0] == "un" and e[1] == "-":
            return -self.constant(e[2])
        if e[0] == "map":
            return {k: self.constant(v) for k, v in e[1]}
        raise QueryError("a literal or parameter is needed here")

    def param(self, name: str):
        if name not in self.params:
            raise QueryError(f"missing parameter ${name}")
        return self.params[name]

    def do_call(self, frame: Frame, c: dict) -> Frame:
        df = self.engine.procedure(c["name"], [self.constant(a) for a in c["args"]])
        items = c["yield"] or [(x, None) for x in df.columns]
        scope = {alias or x: Entity("value", {"v": fresh(x)}) for x, alias in items}
        df = df.select(*(F.col(x).alias(scope[alias or x].cols["v"]) for x, alias in items))
        out = Frame(df if frame.unit else frame.df.crossJoin(df), frame.scope | scope, False, frame.outer)
        return self.where(out, c["where"])

    def do_sub(self, frame: Frame, c: dict) -> Frame:
        """CALL { }: the body runs once over the distinct values it imports, and is joined back."""
        body = c["body"]
        imports = [x[0][1] for x in body[0]["items"]] if body[0]["kind"] == "with" and all(x[0][0] == "var" and x[0][1] in frame.scope for x in body[0]["items"]) else []
        if not any(x["kind"] == "return" for x in body):
            inner = Frame(frame.df, dict(frame.scope), frame.unit, frame.outer)
            for x in body:
                inner = self.clause(inner, x)
            return frame
        sub, keys = self.correlated(frame, [], None, set(imports))
        sub.outer = list(dict.fromkeys([*frame.outer, *keys]))
        for x in body[1:] if imports else body:
            sub = self.clause(sub, x)
        new = {v: e for v, e in sub.scope.items() if v not in imports}
        alias = [(k, fresh("key")) for k in sub.outer]
        right = sub.df.select(*(F.col(k).alias(a) for k, a in alias), *dict.fromkeys(x for e in new.values() for x in e.columns()))
        last = body[-1]["items"]
        whole = bool(last) and all(has_aggregate(e) for e, _ in last)  # aggregates of no rows are a row, too
        df = frame.df.join(right, _same(alias), "left" if whole else "inner").drop(*(a for _, a in alias)) if alias else (right if frame.unit else frame.df.crossJoin(right))
        if whole and alias:
            for e, v in last:
                c = new[v].cols["v"]
                if e[:2] == ("fn", "count"):
                    df = df.withColumn(c, F.coalesce(c, F.lit(0)))
                elif e[:2] == ("fn", "collect"):
                    df = df.withColumn(c, F.coalesce(c, F.array().cast(dict(df.dtypes)[c])))
        return Frame(df, frame.scope | new, False, frame.outer)

    # -- projection ------------------------------------------------------------------------------------------------
    def do_return(self, frame: Frame, c: dict) -> Frame:
        return self.project(frame, c)

    def do_with(self, frame: Frame, c: dict) -> Frame:
        return self.where(self.project(frame, c), c["where"])

    def project(self, frame: Frame, c: dict) -> Frame:
        items = list(c["items"])
        if c["star"]:
            items = [(("var", v), v) for v in frame.scope if "anon__" not in v] + items
        if len({a for _, a in items}) != len(items):
            raise QueryError("two columns of one name")
        grouped = any(has_aggregate(e) for e, _ in items)
        scope, cols, aggs, by = {}, [], [], [F.col(x) for x in frame.outer]
        for e, alias in items:
            old = frame.scope.get(e[1]) if e[0] == "var" else None
            if old is not None and old.kind in ("node", "rel", "path"):
                scope[alias] = Entity(old.kind, {k: fresh(k) for k in old.cols}, {k: fresh(k) for k in old.props}, old.table)
                pairs = [*((old.cols[k], scope[alias].cols[k], k in old.key) for k in old.cols), *((old.props[k], scope[alias].props[k], False) for k in old.props)]
                for a, b, key in pairs:
                    cols.append(F.col(a).alias(b))
                    (by if key else aggs).append(F.col(a).alias(b) if key else F.first(a).alias(b))
            else:
                scope[alias] = Entity("value", {"v": fresh("v")})
                x = self.expr(e, frame).alias(scope[alias].cols["v"])
                cols.append(x)
                (aggs if has_aggregate(e) else by).append(x)
        text = {repr(e): alias for e, alias in items}
        order, hidden = [], []
        for e, asc in c["order"]:
            if repr(e) in text:
                e = ("var", text[repr(e)])
            order.append((e, asc, fresh("sort")))
        key = lambda e, f: (lambda c: span(c) if is_duration(self.type(e, f, {}, c)) else c)(self.expr(e, f))
        if grouped:
            df = frame.df.groupBy(*by).agg(*aggs) if by else frame.df.agg(*aggs)
            out = Frame(df, scope, False, frame.outer)
            for e, _, name in order:
                out.df = out.df.withColumn(name, key(e, out))
        else:
            alias_frame = Frame(frame.df.select("*", *cols), frame.scope | scope, False, frame.outer)
            for e, _, name in order:
                alias_frame.df = alias_frame.df.withColumn(name, key(e, alias_frame))
            hidden = [name for *_, name in order]
            keep = list(dict.fromkeys([*frame.outer, *(x for e in scope.values() for x in e.columns()), *hidden]))
            out = Frame(alias_frame.df.select(*keep), scope, False, frame.outer)
        if c["distinct"]:
            keys = [x for e in scope.values() for x in ([e.cols[k] for k in e.key])]
            out.df = out.df.dropDuplicates([*frame.outer, *keys])
        sort = [(F.col(n).asc_nulls_first() if asc else F.col(n).desc_nulls_last()) for _, asc, n in order]
        if frame.outer and (c["limit"] is not None or c["skip"] is not None):
            n = fresh("n")
            out.df = out.df.withColumn(n, F.row_number().over(W.partitionBy(*frame.outer).orderBy(*(sort or [F.lit(0)]))))
            lo = c["skip"] or 0
            out.df = out.df.filter((F.col(n) > lo) & ((F.col(n) <= lo + c["limit"]) if c["limit"] is not None else F.lit(True))).drop(n)
        else:
            out.df = out.df.orderBy(*sort) if sort else out.df
            out.df = out.df.offset(c["skip"]) if c["skip"] else out.df
            out.df = out.df.limit(c["limit"]) if c["limit"] is not None else out.df
        out.df = out.df.drop(*(n for *_, n in order)) if c["kind"] == "with" else out.df
        return out

    # -- expressions -----------------------------------------------------------------------------------------------
    def type(self, e: tuple, frame: Frame, local: Local, c: Column | None = None) -> T.DataType:
        """The type of an expression; ``c`` is its Column, where it is at hand. Inside a lambda nulls of the variables'
        types stand for them."""
        if e[0] == "lit":
            v = e[1]
            return T.NullType() if v is None else T.BooleanType() if isinstance(v, bool) else T.LongType() if isinstance(v, int) else T.DoubleType() if isinstance(v, float) else T.StringType()
        if e[0] == "var" and e[1] in local:
            return local[e[1]][1]
        if e[0] == "prop" and e[1][0] == "var" and e[1][1] not in local and e[1][1] in frame.scope and e[2] in frame.scope[e[1][1]].props:
            return frame.df.schema[frame.scope[e[1][1]].props[e[2]]].dataType
        key = (repr(e), id(frame.df), tuple(sorted((v, t.simpleString()) for v, (_, t) in local.items())))
        if key not in self._types:
            if local:
                c = self.expr(e, frame, {v: (F.lit(None).cast(t), t) for v, (_, t) in local.items()})
            elif c is None:
                c = self.expr(e, frame)
            self._types[key] = frame.df.select(c.alias("x")).schema[0].dataType, frame.df
        return self._types[key][0]

    def expr(self, e: tuple, frame: Frame, local: Local | None = None) -> Column:
        return getattr(self, "e_" + e[0])(e, frame, local or {})

    def e_lit(self, e, frame, local) -> Column:
        return F.lit(e[1]).cast("long") if isinstance(e[1], int) and not isinstance(e[1], bool) else F.lit(e[1])

    def e_param(self, e, frame, local) -> Column:
        return self.expr(_literal(self.param(e[1])), frame, local)

    def e_var(self, e, frame, local) -> Column:
        if e[1] in local:
            return local[e[1]][0]
        if e[1] not in frame.scope:
            raise QueryError(f"{e[1]} is not defined")
        return frame.scope[e[1]].packed()

    def e_prop(self, e, frame, local) -> Column:
        base, name = e[1], e[2]
        if base[0] == "var" and base[1] not in local and base[1] in frame.scope and frame.scope[base[1]].kind in ("node", "rel"):
            x = frame.scope[base[1]]
            return F.col(x.props[name]) if name in x.props else F.lit(None)
        c = self.expr(base, frame, local)
        t = self.type(base, frame, local, c)
        if kind_of(t) == "time":
            return {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}[name](c).cast("long")
        if isinstance(t, T.StructType):
            return c[name] if name in t.fieldNames() else F.lit(None)
        if isinstance(t, T.MapType):
            return F.element_at(c, name)
        return F.try_variant_get(c, f"$.{name}", "variant") if kind_of(t) == "mixed" else F.lit(None)

    def alike(self, items: list[tuple], frame: Frame, local: Local) -> list[Column]:
        """Values as Columns of one type: maps get each other's keys, and values of several kinds are mixed ones."""
        if items and all(x[0] == "map" and x[1] for x in items):
            keys = list(dict.fromkeys(k for x in items for k, _ in x[1]))
            by = {k: self.alike([dict(x[1]).get(k, ("lit", None)) for x in items], frame, local) for k in keys}
            return [F.struct(*(by[k][i].alias(k) for k in keys)) for i in range(len(items))]
        cols = [self.expr(x, frame, local) for x in items]
        types = [self.type(x, frame, local, c) for x, c in zip(items, cols, strict=True)]
        if len({kind_of(t) for t in types} - {"null"}) > 1 or any(kind_of(t) == "mixed" for t in types):
            return [mixed(c, t) for c, t in zip(cols, types, strict=True)]
        return cols

    def e_list(self, e, frame, local) -> Column:
        return F.array(*self.alike(e[1], frame, local))

    def e_map(self, e, frame, local) -> Column:
        return F.struct(*(self.expr(v, frame, local).alias(k) for k, v in e[1])) if e[1] else F.create_map().cast("map<string,string>")

    def e_mapproj(self, e, frame, local) -> Column:
        out = {}
        for item in e[2]:
            if item[0] == "all":
                out |= {p: F.col(c) for p, c in frame.scope[e[1]].props.items()}
            elif item[0] == "prop":
                out[item[1]] = self.expr(("prop", ("var", e[1]), item[1]), frame, local)
            else:
                out[item[1]] = self.expr(item[2], frame, local)
        return F.struct(*(c.alias(k) for k, c in out.items()))

    def e_un(self, e, frame, local) -> Column:
        x = self.expr(e[2], frame, local)
        return ~x.cast("boolean") if e[1] == "NOT" else -x

    def e_isnull(self, e, frame, local) -> Column:
        if e[1][0] == "var" and e[1][1] in frame.scope and frame.scope[e[1][1]].kind in ("node", "rel"):
            x = frame.scope[e[1][1]]
            c = F.col(x.cols["id" if x.kind == "node" else "src"])
        else:
            c = self.expr(e[1], frame, local)
        return c.isNotNull() if e[2] else c.isNull()

    def e_bin(self, e, frame, local) -> Column:
        op, (ea, eb) = e[1], e[2:]
        if op in ("=", "<>") and all(x[0] == "var" and x[1] in frame.scope and frame.scope[x[1]].kind == "node" for x in (ea, eb)):
            a, b = (F.col(frame.scope[x[1]].cols["id"]) for x in (ea, eb))
            return a == b if op == "=" else a != b
        a, b = self.expr(ea, frame, local), self.expr(eb, frame, local)
        if op in ("AND", "OR", "XOR"):
            a, b = a.cast("boolean"), b.cast("boolean")
            return a & b if op == "AND" else a | b if op == "OR" else a != b
        types = lambda: (self.type(ea, frame, local, a), self.type(eb, frame, local, b))
        if op in ("=", "<>", "<", "<=", ">", ">="):
            return self.compare(op, a, b, *types())
        if op == "IN":
            return self.contained(ea, a, b, *types())
        simple = {
            "*": lambda: a * b, "/": lambda: a / b, "%": lambda: a % b, "^": lambda: F.pow(a, b), "=~": lambda: F.rlike(a, F.concat(F.lit("^(?:"), b, F.lit(")\\z"))),
            "STARTS": lambda: F.startswith(a, b), "ENDS": lambda: F.endswith(a, b), "CONTAINS": lambda: F.contains(a, b),
        }
        if op in simple:
            return simple[op]()
        ta, tb = types()
        ka, kb = ta.simpleString(), tb.simpleString()
        if op == "-":
            return self.minus(a, b, ka, kb)
        if "string" in (ka, kb):
            return F.concat(a.cast("string"), b.cast("string"))
        if ka.startswith("array") or kb.startswith("array"):
            return F.concat(a if ka.startswith("array") else F.array(a), b if kb.startswith("array") else F.array(b))
        for x, y, k in ((a, b, ka), (b, a, kb)):
            if k in ("date", "timestamp_ntz"):
                return self.shift(x, k, y, 1)
        if is_duration(ta) and is_duration(tb):
            return F.struct(*((a[p] + b[p]).alias(p) for p in ("months", "days", "nanos")))
        return a + b

    @staticmethod
    def compare(op: str, a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
        """Values of different kinds are unequal, and ordered by their kinds; null with anything is null."""
        ka, kb = kind_of(ta), kind_of(tb)
        if "mixed" in (ka, kb):
            eq = same_mixed(a, b, tb) if ka == "mixed" else same_mixed(b, a, ta)
            if op not in ("=", "<>"):
                raise QueryError("values of a list of several types have no order")
            return eq if op == "=" else ~eq
        if ka != kb and ka in KINDS and kb in KINDS:
            less = KINDS.index(ka) < KINDS.index(kb)
            return F.when(a.isNotNull() & b.isNotNull(), F.lit({"=": False, "<>": True, "<": less, "<=": less, ">": not less, ">=": not less}[op]))
        if ka == kb == "duration" and op not in ("=", "<>"):
            a, b = span(a), span(b)
        return {"=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()

    @staticmethod
    def contained(ea: tuple, a: Column, b: Column, ta: T.DataType, tb: T.DataType) -> Column:
        if ea == ("lit", None):
            return F.lit(False)
        item = tb.elementType if isinstance(tb, T.ArrayType) else T.NullType()
        if "mixed" in (kind_of(item), kind_of(ta)):
            return F.coalesce(F.exists(b, lambda x: same_mixed(x, a, ta) if kind_of(item) == "mixed" else same_mixed(a, x, item)), F.lit(False))
        if kind_of(item) != kind_of(ta) and kind_of(item) in KINDS and kind_of(ta) in KINDS:
            return F.when(b.isNotNull(), F.lit(False))
        return F.coalesce(F.array_contains(F.filter(b, lambda x: x.isNotNull()), a), F.lit(False))

    def minus(self, a: Column, b: Column, ka: str, kb: str) -> Column:
        if ka in ("date", "timestamp_ntz") and kb.startswith("struct"):
            return self.shift(a, ka, b, -1)
        part = lambda m, d, n: F.struct(*(x.cast("long").alias(k) for k, x in (("months", m), ("days", d), ("nanos", n))))
        if ka == kb == "date":
            return part(F.lit(0), F.datediff(a, b), F.lit(0))
        if ka == kb == "timestamp_ntz":  # days and the rest share the difference's sign, in milliseconds
            ms, day = F.timestamp_diff("MILLISECOND", b, a), F.lit(86_400_000)
            return part(F.lit(0), (ms - ms % day) / day, ms % day * 1_000_000)
        if ka == kb and ka.startswith("struct<months"):
            return part(*(a[k] - b[k] for k in ("months", "days", "nanos")))
        return a - b

    def shift(self, x: Column, kind: str, d: Column, sign: int) -> Column:
        """Add a duration; a day past the month's end rolls over into the next month."""
        months = F.year(x) * 12 + F.month(x) - 1 + sign * d["months"]
        first = F.make_date(F.floor(months / 12).cast("int"), F.pmod(months, F.lit(12)).cast("int") + 1, F.lit(1))
        day = F.date_add(first, (F.dayofmonth(x) - 1 + sign * d["days"]).cast("int"))
        if kind == "date":
            return day
        micros = F.hour(x) * 3_600_000_000 + F.minute(x) * 60_000_000 + F.floor(F.second(x) * 1_000_000) + F.floor(sign * d["nanos"] / 1000)
        return F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + micros.cast("long")).cast("timestamp_ntz")

    def e_case(self, e, frame, local) -> Column:
        operand = self.expr(e[1], frame, local) if e[1] else None
        out = None
        for cond, value in e[2]:
            c = self.expr(cond, frame, local)
            c = (operand == c) if operand is not None else c.cast("boolean")
            v = self.expr(value, frame, local)
            out = F.when(c, v) if out is None else out.when(c, v)
        return out.otherwise(self.expr(e[3], frame, local))

    def e_idx(self, e, frame, local) -> Column:
        c, i = self.expr(e[1], frame, local), self.expr(e[2], frame, local)
        t = self.type(e[1], frame, local, c)
        if isinstance(t, T.MapType):
            return F.element_at(c, i)
        if e[2][0] == "lit" and isinstance(e[2][1], str):
            return self.e_prop(("prop", e[1], e[2][1]), frame, local)
        return F.get(c, F.when(i < 0, F.size(c) + i).otherwise(i).cast("int"))

    def e_slice(self, e, frame, local) -> Column:
        c = self.expr(e[1], frame, local)
        n = F.size(c)
        bound = lambda x, d: d if x is None else (lambda v: F.least(F.greatest(F.when(v < 0, n + v).otherwise(v), F.lit(0)), n).cast("int"))(self.expr(x, frame, local))
        lo, hi = bound(e[2], F.lit(0)), bound(e[3], n)
        return F.slice(c, lo + 1, F.greatest(hi - lo, F.lit(0)))

    def items(self, src: tuple, frame: Frame, local: Local) -> tuple[Column, T.DataType]:
        """A list and the type of its elements."""
        c = self.expr(src, frame, local)
        t = self.type(src, frame, local, c)
        return c, t.elementType if isinstance(t, T.ArrayType) else T.NullType()

    def e_comp(self, e, frame, local) -> Column:
        _, var, src, where, proj = e
        c, t = self.items(src, frame, local)
        if where is not None:
            c = F.filter(c, lambda x: F.coalesce(self.expr(where, frame, local | {var: (x, t)}).cast("boolean"), F.lit(False)))
        return F.transform(c, lambda x: self.expr(proj, frame, local | {var: (x, t)})) if proj is not None else c

    def e_quant(self, e, frame, local) -> Column:
        _, kind, var, src, where = e
        c, t = self.items(src, frame, local)
        ok = lambda x: F.coalesce(self.expr(where, frame, local | {var: (x, t)}).cast("boolean"), F.lit(False))
        return {"all": lambda: F.forall(c, ok), "any": lambda: F.exists(c, ok), "none": lambda: ~F.exists(c, ok), "single": lambda: F.size(F.filter(c, ok)) == 1}[kind]()

    def e_reduce(self, e, frame, local) -> Column:
        """A fold; its value starts as a whole number where the body makes one with a fraction of it, or text."""
        _, acc, init, var, src, body = e
        (c, t), first = self.items(src, frame, local), self.expr(init, frame, local)
        at = self.type(init, frame, local, first)
        for _ in range(2):
            made = self.type(body, frame, local | {acc: (first, at), var: (first, t)})
            if kind_of(made) != "null":
                at = made
        return F.aggregate(c, first.cast(at), lambda a, x: self.expr(body, frame, local | {acc: (a, at), var: (x, t)}).cast(at))

    def attach(self, frame: Frame, sub: Frame, keys: list[str], value: Column, name: str) -> None:
        alias = [(k, fresh("key")) for k in keys]
        right = sub.df.groupBy(*keys).agg(value.alias(name)) if keys else sub.df.agg(value.alias(name))
        right = right.select(*(F.col(k).alias(a) for k, a in alias), name)
        frame.df = frame.df.join(right, _same(alias), "left").drop(*(a for _, a in alias))

    def e_exists(self, e, frame, local) -> Column:
        if e[1]["var"] is None and not e[1]["rels"]:
            raise QueryError("exists needs a pattern")
        sub, keys = self.correlated(frame, [e[1]], e[2])
        name = fresh("exists")
        self.attach(frame, sub, keys, F.count(F.lit(1)) > 0, name)
        return F.coalesce(F.col(name), F.lit(False))

    def e_pcomp(self, e, frame, local) -> Column:
        self.used |= names(e[3])
        sub, keys = self.correlated(frame, [e[1]], e[2], extra=e[3])
        x = self.expr(e[3], sub)
        kind = sub.df.select(x.alias("x")).dtypes[0][1]
        name = fresh("list")
        self.attach(frame, sub, keys, F.sort_array(F.collect_list(x)), name)
        return F.coalesce(F.col(name), F.array().cast(f"array<{kind}>"))

    def e_short(self, e, frame, local) -> Column:
        var = fresh("path")
        sub, keys = self.correlated(frame, [e[1] | {"var": var}], None)
        name = fresh("short")
        path = sub.scope[var].packed()
        self.attach(frame, sub, keys, F.min(path) if e[1]["fn"] == "shortestpath" else F.sort_array(F.collect_list(path)), name)
        return F.col(name)

    def e_fn(self, e, frame, local) -> Column:
        _, name, args, distinct = e
        if name in AGGREGATES:
            if name == "count" and not args:
                return F.count(F.lit(1))
            if name == "count" and args[0][0] == "var" and args[0][1] in frame.scope and frame.scope[args[0][1]].kind == "node":
                return AGGREGATES["count"](F.col(frame.scope[args[0][1]].cols["id"]), distinct)
            if name == "count" and distinct and args[0][:2] == ("fn", "id") and args[0][2] == [("var", frame.once)] and frame.once not in local and frame.scope[frame.once].kind == "rel":
                # Ids that were given are distinct, row by row; only relationships without one can share theirs.
                given = F.col(frame.scope[frame.once].cols["eid"])
                return F.count(given) + F.count_distinct(F.when(given.isNull(), self.expr(args[0], frame, local)))
            x, *more = (self.expr(a, frame, local) for a in args)
            if name in ("min", "max") and is_duration(self.type(args[0], frame, local, x)):
                return (F.min_by if name == "min" else F.max_by)(x, F.when(x.isNotNull(), span(x)))
            return AGGREGATES[name](x, distinct, *more)
        ent = frame.scope.get(args[0][1]) if args and args[0][0] == "var" and args[0][1] not in local else None
        if name in ("id", "labels", "type", "keys", "properties"):
            if ent is None or ent.kind not in ("node", "rel"):
                raise QueryError(f"{name}() takes a node or relationship variable")
            if name == "id":
                return F.col(ent.cols["id"]) if ent.kind == "node" else F.coalesce(ent.cols["eid"], F.xxhash64(*(F.col(ent.cols[k]) for k in ("src", "dst", "type")), *(F.col(c) for c in ent.props.values())))
            if name == "keys":
                return F.filter(F.array(*(F.when(F.col(c).isNotNull(), F.lit(p)) for p, c in ent.props.items())), lambda x: x.isNotNull())
            if name == "properties":
                return F.struct(*(F.col(c).alias(p) for p, c in ent.props.items()))
            if (name == "labels") != (ent.kind == "node"):
                raise QueryError(f"{name}() doesn't take a {ent.kind}")
            return F.col(ent.cols["labels" if name == "labels" else "type"])
        if name in ("nodes", "relationships"):
            c = self.expr(args[0], frame, local)
            return c["nodes"] if name == "nodes" else c["rels"]
        if name in ("length", "size"):
            c = self.expr(args[0], frame, local)
            t = self.type(args[0], frame, local, c)
            if isinstance(t, T.StructType) and t.fieldNames() == ["nodes", "rels"]:
                return F.size(c["rels"]).cast("long")
            if kind_of(t) in ("map", "duration"):
                return F.lit(None).cast("long")
            return (F.size(c) if kind_of(t) == "list" else F.length(c)).cast("long")
        if name == "duration":
            if len(args) != 1:
                raise QueryError("duration takes one argument")
            if args[0][0] != "map":
                return duration(self.expr(args[0], frame, local).cast("string"))
            parts = dict(args[0][1])
            n = lambda *ks: reduce(lambda a, b: a + b, (self.expr(parts[k], frame, local) * f for k, f in ks if k in parts), F.lit(0)).cast("long")
            return F.struct(n(("years", 12), ("months", 1)).alias("months"), n(("weeks", 7), ("days", 1)).alias("days"), n(("hours", 3_600_000_000_000), ("minutes", 60_000_000_000), ("seconds", 1_000_000_000), ("nanoseconds", 1)).alias("nanos"))
        if name == "datetime" and args and args[0][0] == "map":
            p = dict(args[0][1])
            part = lambda k, d: self.expr(p.get(k, ("lit", d)), frame, local)
            day = F.make_date(*(part(k, d).cast("int") for k, d in (("year", 1970), ("month", 1), ("day", 1))))
            ms = ((part("hour", 0) * 60 + part("minute", 0)) * 60 + part("second", 0)) * 1000 + part("millisecond", 0)
            return F.timestamp_add("MILLISECOND", ms.cast("long"), day.cast("timestamp_ntz"))
        if name == "date" and args and args[0][0] == "map":
            p = dict(args[0][1])
            return F.make_date(*(self.expr(p.get(k, ("lit", 1)), frame, local).cast("int") for k in ("year", "month", "day")))
        if name not in FUNCTIONS:
            raise QueryError(f"unknown function {name}")
        least, most, builder = FUNCTIONS[name]
        if not least <= len(args) <= most:
            raise QueryError(f"{name} takes {least} to {most} arguments")
        return builder(*(self.expr(a, frame, local) for a in args))
