"""A query written step by step. Patterns and expressions are text of the query language; values travel as parameters.

    engine.builder().match("(c:Customer)-[:LIVES_IN]->(n)", c={"c_nationkey": 3}).where("c.c_acctbal > $least", least=0).returns("n.n_name AS n").run()
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame

from .parser import QueryError, parse

if TYPE_CHECKING:
    from ..engine import GraphEngine


def quoted(name: str) -> str:
    if "`" in name or not name:
        raise QueryError(f"not a name: {name!r}")
    return f"`{name}`"


class QueryBuilder:
    """Immutable: every method gives a longer query, so a common beginning can be shared."""

    def __init__(self, engine: GraphEngine, steps: tuple[str, ...] = (), params: dict[str, Any] | None = None):
        self.engine, self.steps, self.params = engine, steps, params or {}

    def then(self, clause: str, **params: Any) -> QueryBuilder:
        """Any clause, with its parameters."""
        taken = params.keys() & self.params.keys()
        if any(self.params[k] != params[k] for k in taken):
            raise QueryError(f"parameters of one name: {sorted(taken)}")
        return QueryBuilder(self.engine, (*self.steps, clause), self.params | params)

    def _equal(self, wanted: dict[str, dict[str, Any]]) -> tuple[str, dict[str, Any]]:
        """Conditions var.key = value, and their parameters."""
        found, params = [], {}
        for var, props in wanted.items():
            for key, value in props.items():
                name = f"v{len(self.params) + len(params)}"
                params[name] = value
                found.append(f"{quoted(var)}.{quoted(key)} = ${name}")
        return " AND ".join(found), params

    def match(self, *patterns: str, optional: bool = False, **equal: dict[str, Any]) -> QueryBuilder:
        """Patterns; ``var={"key": value}`` asks a variable for property values."""
        cond, params = self._equal(equal)
        return self.then(f"{'OPTIONAL ' if optional else ''}MATCH {', '.join(patterns)}{' WHERE ' + cond if cond else ''}", **params)

    def where(self, condition: str, **params: Any) -> QueryBuilder:
        """Keep rows; may follow any clause."""
        return self.then(f"WITH * WHERE {condition}", **params)

    def unwind(self, values: Iterable, name: str) -> QueryBuilder:
        param = f"v{len(self.params)}"
        return self.then(f"UNWIND ${param} AS {quoted(name)}", **{param: list(values)})

    def call(self, procedure: str, *args: Any, yields: str = "") -> QueryBuilder:
        params = {f"v{len(self.params) + i}": a for i, a in enumerate(args)}
        return self.then(f"CALL {procedure}({', '.join('$' + k for k in params)}){' YIELD ' + yields if yields else ''}", **params)

    def create(self, *patterns: str, **params: Any) -> QueryBuilder:
        return self.then(f"CREATE {', '.join(patterns)}", **params)

    def merge(self, pattern: str, **params: Any) -> QueryBuilder:
        return self.then(f"MERGE {pattern}", **params)

    def assign(self, var: str, **values: Any) -> QueryBuilder:
        """Set properties of a variable."""
        params = {f"v{len(self.params) + i}": v for i, v in enumerate(values.values())}
        return self.then("SET " + ", ".join(f"{quoted(var)}.{quoted(k)} = ${p}" for k, p in zip(values, params, strict=True)), **params)

    def label(self, var: str, *labels: str, remove: bool = False) -> QueryBuilder:
        return self.then(("REMOVE " if remove else "SET ") + ", ".join(f"{quoted(var)}:{quoted(x)}" for x in labels))

    def forget(self, var: str, *keys: str) -> QueryBuilder:
        """Remove properties of a variable."""
        return self.then("REMOVE " + ", ".join(f"{quoted(var)}.{quoted(k)}" for k in keys))

    def delete(self, *variables: str, detach: bool = False) -> QueryBuilder:
        return self.then(f"{'DETACH ' if detach else ''}DELETE {', '.join(map(quoted, variables))}")

    def returns(self, *items: str, distinct: bool = False) -> QueryBuilder:
        return self.then(f"RETURN {'DISTINCT ' if distinct else ''}{', '.join(items)}")

    def order_by(self, *keys: str) -> QueryBuilder:
        return self.then(f"ORDER BY {', '.join(keys)}")

    def page(self, size: int, after: int = 0) -> QueryBuilder:
        """``size`` rows after the first ``after``."""
        return self.then(f"{f'SKIP {int(after)} ' if after else ''}LIMIT {int(size)}")

    def text(self) -> str:
        return " ".join(self.steps)

    def check(self) -> QueryBuilder:
        """Raise if the query so far can't be parsed."""
        parse(self.text())
        return self

    def run(self) -> DataFrame:
        return self.engine.cypher(self.text(), **self.params)
