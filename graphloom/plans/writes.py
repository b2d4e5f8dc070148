"""Writing clauses: each gives a new version of the graph; what was written is settled, so it is never worked out twice."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.graph import EID, _widened
from .compiler import REL, Compiler, Entity, Frame, fresh
from .parser import QueryError


class Writer(Compiler):
    def numbered(self, df: DataFrame, column: str) -> DataFrame:
        """df, written once, with dense new ids, counted partition by partition, without a shuffle."""
        part, row = fresh("part"), fresh("row")
        df = self.engine.store(df.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
        sizes = {r[0]: r[1] for r in df.groupBy(part).count().collect()}
        first, at = [self.engine.next_id] * (max(sizes, default=-1) + 1), self.engine.next_id
        for p in sorted(sizes):
            first[p], at = at, at + sizes[p]
        self.engine.next_id = at
        if not first:
            return df.withColumn(column, F.lit(0).cast("long")).drop(part, row)
        return df.withColumn(column, (F.array(*map(F.lit, first))[F.col(part)] + F.col(row)).cast("long")).drop(part, row)

    def do_create_pattern(self, frame: Frame, c: dict) -> Frame:
        # Numbering writes the frame before anything new is read, and once for each new node or relationship.
        frame = Frame(frame.df, dict(frame.scope), False, frame.outer)
        bound = all(n["var"] in frame.scope for p in c["patterns"] for n in p["nodes"])
        alone = c is self.ending and bound and sum(len(p["rels"]) for p in c["patterns"]) == 1
        for p in c["patterns"]:
            vars_ = [n["var"] or fresh("anon") for n in p["nodes"]]
            for n, v in zip(p["nodes"], vars_, strict=True):
                if v not in frame.scope:
                    self.create_node(frame, n, v)
            for rel, a, b in zip(p["rels"], vars_, vars_[1:], strict=False):
                if len(rel["types"]) != 1:
                    raise QueryError("a new relationship needs one type")
                s, d = (a, b) if rel["dir"] != "in" else (b, a)
                e = Entity("rel", {k: fresh(k) for k in REL}, {k: fresh(k) for k in rel["props"]})
                made = {e.cols["src"]: F.col(frame.scope[s].cols["id"]), e.cols["dst"]: F.col(frame.scope[d].cols["id"])} | {e.props[k]: self.expr(v, frame) for k, v in rel["props"].items()}
                # What nobody reads any more isn't written.
                frame.df = self.numbered(frame.df.select(*(v.alias(k) for k, v in made.items())) if alone else frame.df.withColumns(made), e.cols["eid"]).withColumn(e.cols["type"], F.lit(rel["types"][0]))
                ends = frame.scope[s].table, frame.scope[d].table
                rows = frame.df.select(*(F.col(e.cols[k]).alias(k) for k in ("src", "dst")), F.col(e.cols["eid"]).alias(EID), *(F.col(x).alias(k) for k, x in e.props.items()))
                have = self.graph.rels.get(rel["types"][0])
                ends = tuple(x if not have or x == y else None for x, y in zip(ends, have.ends if have else ends, strict=True))
                self.engine.graph = self.graph.with_rels(rel["types"][0], _widened(have.df, rows) if have else rows, ends)
                if rel["var"]:
                    frame.scope[rel["var"]] = e
        return frame

    def create_node(self, frame: Frame, n: dict, var: str) -> None:
        e = Entity("node", {"id": fresh("id"), "labels": fresh("labels")}, {k: fresh(k) for k in n["props"]})
        frame.df = frame.df.withColumns({e.cols["labels"]: F.array(*map(F.lit, n["labels"])).cast("array<string>")} | {e.props[k]: self.expr(v, frame) for k, v in n["props"].items()})
        frame.df = self.numbered(frame.df, e.cols["id"])
        rows = frame.df.select(F.col(e.cols["id"]).alias("id"), *(F.col(x).alias(k) for k, x in e.props.items()))
        labels = tuple(sorted(n["labels"]))
        have = self.graph.nodes.get(labels)
        self.engine.graph = self.graph.with_nodes(labels, _widened(have, rows) if have is not None else rows)
        frame.scope[var] = e

    def do_merge(self, frame: Frame, c: dict) -> Frame:
        p = c["pattern"]
        hit, keys = self.correlated(frame, [p], None, {n["var"] for n in p["nodes"] if n["var"]}, whole=True)
        hit.df = self.engine.settle(hit.df)
        if keys:
            alias = [(k, fresh("key")) for k in keys]
            cond = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(a)) for k, a in alias))
            miss = frame.df.select(*keys).distinct().join(hit.df.select(*(F.col(k).alias(a) for k, a in alias)), cond, "left_anti")
            values = [k for n in p["nodes"] if n["var"] not in frame.scope for k in n["props"]]
            missing = Frame(self.engine.settle(miss), {v: e for v, e in hit.scope.items() if v in frame.scope})
            if values:  # rows that ask for one and the same new node make it once
                made = {fresh("want"): self.expr(v, missing) for n in p["nodes"] if n["var"] not in frame.scope for v in n["props"].values()}
                bound = [missing.scope[n["var"]].cols["id"] for n in p["nodes"] if n["var"] in missing.scope]
                missing.df = missing.df.withColumns(made).dropDuplicates([*made, *bound])
        else:
            missing = self.unit()
            missing.df = missing.df.filter(F.lit(hit.df.isEmpty()))
        if c["matched"] and not hit.df.isEmpty():
            self.do_set(hit, {"items": c["matched"]})
        if not missing.df.isEmpty():
            created = self.do_create_pattern(missing, {"patterns": [p]})
            if c["created"]:
                self.do_set(created, {"items": c["created"]})
        return self.do_match(frame, {"optional": False, "patterns": [p], "where": None})

    def do_set(self, frame: Frame, c: dict) -> Frame:
        frame = Frame(self.engine.settle(frame.df), dict(frame.scope), False, frame.outer)
        for how, var, prop, e in c["items"]:
            if how == "label":
                self.relabel(frame, var, lambda key, prop=prop: tuple(sorted({*key, prop})))
            elif how == "prop":
                self.assign(frame, var, {prop: self.expr(e, frame)})
            else:
                if e[0] != "map":
                    raise QueryError("SET of a whole entity takes a map")
                new = {k: self.expr(v, frame) for k, v in e[1]}
                if how == "replace":
                    new = {k: F.lit(None) for k in frame.scope[var].props} | new
                self.assign(frame, var, new)
        return frame

    def do_remove(self, frame: Frame, c: dict) -> Frame:
        frame = Frame(self.engine.settle(frame.df), dict(frame.scope), False, frame.outer)
        for how, var, name in c["items"]:
            if how == "prop":
                self.assign(frame, var, {name: F.lit(None)})
            else:
                self.relabel(frame, var, lambda key, name=name: tuple(x for x in key if x != name))
                self.engine.graph = self.graph.without_end(name)
        return frame

    def assign(self, frame: Frame, var: str, new: dict[str, Column]) -> None:
        """Set properties of the entities that ``var`` holds; of several rows for one, one wins."""
        x = frame.scope[var]
        cols = {k: fresh(k) for k in new}
        frame.df = self.engine.settle(frame.df.withColumns({cols[k]: v for k, v in new.items()}))
        ids = [x.cols[k] for k in x.key] + ([] if x.kind == "node" else list(x.props.values()))
        rows = frame.df.dropDuplicates(ids)
        if x.kind == "node":
            wanted = rows.select(F.col(ids[0]).alias("id"), *(F.col(c).alias(f"__{k}") for k, c in cols.items()), F.lit(True).alias("__hit"))
            for key, df in self.graph.nodes.items():
                got = df.join(wanted, "id", "left")
                self.engine.graph = self.graph.with_nodes(key, self.engine.settle(self.overwrite(got, df, new)))
        else:
            for kind, t in self.graph.rels.items():
                mine = {p: c for p, c in x.props.items() if p in t.df.columns}
                on = {"src": x.cols["src"], "dst": x.cols["dst"]} | ({EID: x.cols["eid"]} if EID in t.df.columns else {}) | mine
                wanted = rows.filter(F.col(x.cols["type"]) == kind).select(*(F.col(c).alias(f"__k_{p}") for p, c in on.items()), *(F.col(c).alias(f"__{k}") for k, c in cols.items()), F.lit(True).alias("__hit"))
                got = t.df.join(wanted, reduce(lambda a, b: a & b, (F.col(p).eqNullSafe(F.col(f"__k_{p}")) for p in on)), "left").drop(*(f"__k_{p}" for p in on))
                self.engine.graph = self.graph.with_rels(kind, self.engine.settle(self.overwrite(got, t.df, new)), t.ends)
        x.props = dict(x.props) | cols

    @staticmethod
    def overwrite(joined: DataFrame, before: DataFrame, new: dict) -> DataFrame:
        types = dict(joined.dtypes)
        for k in new:
            value = F.col(f"__{k}")
            if k in before.columns:
                if types[f"__{k}"] == "void":
                    value = value.cast(types[k])
                joined = joined.withColumn(k, F.when(F.col("__hit"), value).otherwise(F.col(k)))
            elif types[f"__{k}"] != "void":
                joined = joined.withColumn(k, value)
        return joined.drop("__hit", *(f"__{k}" for k in new))

    def relabel(self, frame: Frame, var: str, to) -> None:
        ids = frame.df.select(F.col(frame.scope[var].cols["id"]).alias("id")).distinct()
        for key, df in list(self.graph.nodes.items()):
            if to(key) == key:
                continue
            moved = self.engine.settle(df.join(ids, "id", "left_semi"))
            if moved.isEmpty():
                continue
            self.engine.graph = self.graph.with_nodes(key, self.engine.settle(df.join(ids, "id", "left_anti")))
            have = self.graph.nodes.get(to(key))
            self.engine.graph = self.graph.with_nodes(to(key), _widened(have, moved) if have is not None else moved)

    def do_delete(self, frame: Frame, c: dict) -> Frame:
        frame = Frame(self.engine.settle(frame.df), dict(frame.scope), False, frame.outer)
        order = sorted(c["vars"], key=lambda v: frame.scope[v].kind != "rel")
        for var in order:
            x = frame.scope[var]
            if x.kind == "rel":
                for kind, t in self.graph.rels.items():
                    on = {"src": x.cols["src"], "dst": x.cols["dst"]} | ({EID: x.cols["eid"]} if EID in t.df.columns else {}) | {p: k for p, k in x.props.items() if p in t.df.columns}
                    gone = frame.df.filter(F.col(x.cols["type"]) == kind).select(*(F.col(k).alias(f"__{p}") for p, k in on.items()))
                    left = t.df.join(gone, reduce(lambda a, b: a & b, (F.col(p).eqNullSafe(F.col(f"__{p}")) for p in on)), "left_anti")
                    self.engine.graph = self.graph.with_rels(kind, self.engine.settle(left), t.ends)
                continue
            ids = self.engine.settle(frame.df.select(F.col(x.cols["id"]).alias("id")).filter("id IS NOT NULL").distinct())
            for kind, t in self.graph.rels.items():
                keep = t.df.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti").select(t.df.columns)
                if c["detach"]:
                    self.engine.graph = self.graph.with_rels(kind, self.engine.settle(keep), t.ends)
                elif keep.count() != t.df.count():
                    raise QueryError("a node that still has relationships needs DETACH DELETE")
            for key, df in self.graph.nodes.items():
                self.engine.graph = self.graph.with_nodes(key, self.engine.settle(df.join(ids, "id", "left_anti")))
        return frame

    def do_foreach(self, frame: Frame, c: dict) -> Frame:
        inner = self.do_unwind(Frame(self.engine.settle(frame.df), dict(frame.scope), False, frame.outer), {"expr": c["expr"], "var": c["var"]})
        for x in c["body"]:
            inner = self.clause(inner, x)
        return frame
