"""The relations of a SQL text: found by Spark's parser, in the scope of common table expressions, and put in by offset."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

_PART = r"(?:`(?:[^`]|``)*`|\w+)"


@dataclass(frozen=True)
class Relation:
    parts: tuple[str, ...]
    start: int  # in code points, as the parser counts
    aliased: bool


def _seq(s) -> list:
    return [s.apply(k) for k in range(s.size())]


def relations(spark: SparkSession, sql: str) -> list[Relation]:
    """Relations that no common table expression in scope defines, by their place in the text."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    found: dict[int, Relation] = {}

    def walk(node, scope: frozenset[str], aliased: bool) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            parts = tuple(_seq(node.multipartIdentifier()))
            if len(parts) > 1 or parts[0].lower() not in scope:
                start = node.origin().startIndex().get()
                found[start] = Relation(parts, start, aliased)
            return
        if kind == "UnresolvedWith":
            for pair in _seq(node.cteRelations()):
                name, definition = pair.productElement(0), pair.productElement(1)
                walk(definition, scope, False)
                scope = scope | {name.lower()}
        for child in _seq(node.children()):
            walk(child, scope, kind == "SubqueryAlias")
        for sub in _seq(node.subqueries()):
            walk(sub, scope, False)

    walk(plan, frozenset(), False)
    return [found[k] for k in sorted(found)]


def replaced(sql: str, views: dict[int, tuple[Relation, str]]) -> str:
    """The text with each relation's name replaced by a view's, which keeps the last part of the name as its alias."""
    out, last = [], 0
    for start in sorted(views):
        relation, view = views[start]
        name = re.compile(r"\s*\.\s*".join([_PART] * len(relation.parts))).match(sql, start)
        if name is None:
            raise ValueError(f"no name at {start}")
        alias = "" if relation.aliased else " AS `" + relation.parts[-1].replace("`", "``") + "`"
        out.append(f"{sql[last:start]}`{view}`{alias}")
        last = name.end()
    return "".join([*out, sql[last:]])
