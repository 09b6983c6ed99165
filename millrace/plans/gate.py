"""Refuses SQL whose result depends on how rows fall into batches.

The check walks Spark's unresolved plan of the rewritten text. At the ROW grain
(a streamed transform) every output row must come from one source row; at the BATCH
grain (a publication) one committed batch may be aggregated, by sum, count,
min and max.
"""

from __future__ import annotations

import enum
import functools
import logging
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..errors import TransformError
from . import rewrite

log = logging.getLogger(__name__)

SOURCE = "source"
FOREIGN = set(
    "mode listagg approx_distinct approx_median approx_percentile_cont percentile_cont percentile_disc corr covar covar_pop covar_samp every bool_and bool_or bit_and bit_or bit_xor "
    "stddev stddev_pop stddev_samp var var_pop var_samp median string_agg array_agg grouping".split()
)
SUMS = {"sum", "count", "min", "max"}
GENERATORS = {"explode"}


class Grain(enum.Enum):
    ROW = "row"
    BATCH = "batch"


@functools.cache
def _aggregates(spark: SparkSession) -> tuple[frozenset[str], frozenset[str]]:
    """Names of Spark's aggregate and window functions, aliases included."""
    registry = spark._jsparkSession.sessionState().functionRegistry()
    names = registry.listFunction()
    groups: dict[str, set[str]] = {"agg_funcs": set(), "window_funcs": set()}
    for i in range(names.size()):
        info = registry.lookupFunction(names.apply(i))
        if info.isDefined() and info.get().getGroup() in groups:
            groups[info.get().getGroup()].add(names.apply(i).funcName().lower())
    return frozenset(groups["agg_funcs"] | FOREIGN), frozenset(groups["window_funcs"])


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


@dataclass
class Verdict:
    """What the gate found in an accepted query."""

    sql: str
    lookups: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


class _Walk:
    def __init__(self, spark: SparkSession, grain: Grain, lookups: Iterable[str]):
        self.spark, self.grain = spark, grain
        self.lookups = {x.lower(): x for x in lookups}
        self.joined: list[str] = []
        self.seen: list[str] = []
        self.laterals = 0
        self.warnings: list[str] = []
        self.aggregates, self.windows = _aggregates(spark)

    def refuse(self, why: str):
        raise TransformError(why)

    def plan(self, node, ctes: frozenset[str] = frozenset()) -> None:
        kind = node.getClass().getSimpleName()
        row = self.grain is Grain.ROW
        if kind == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                name = pair._1().lower()
                if name in self.lookups:
                    self.refuse(f"the CTE {name} hides the lookup of this name")
                self.plan(pair._2(), ctes)
                ctes = ctes | {name}
            self.plan(node.child(), ctes)
            return
        if kind == "UnresolvedRelation":
            parts = [p.lower() for p in _items(node.multipartIdentifier())]
            if len(parts) != 1 or parts[0] not in ctes and parts[0] != SOURCE and parts[0] not in self.lookups:
                self.refuse(f"the query reads {'.'.join(parts)}; only {SOURCE} and declared lookups are there to be read")
            if parts[0] in self.lookups and parts[0] not in ctes:
                self.seen.append(parts[0])
            return
        if kind == "Aggregate" and row:
            self.refuse("GROUP BY would group the rows of one batch only; aggregate downstream of the target")
        if kind in ("UnresolvedHaving",) and row:
            self.refuse("HAVING needs an aggregate over all rows; aggregate downstream of the target")
        if kind in ("Distinct", "Deduplicate"):
            child = node.child().getClass().getSimpleName()
            if kind == "Distinct" and child == "Union":
                self.warnings.append("UNION drops repeats within a batch only")
            elif row:
                self.refuse("DISTINCT would drop repeats within one batch only; use an upsert target")
        if kind in ("Intersect", "Except"):
            self.warnings.append(f"{kind.upper()} compares the rows of one batch only")
        if kind in ("Sort", "GlobalLimit", "Offset"):
            self.warnings.append(f"{kind} applies to each batch by itself")
        if kind in ("Generate", "Sample", "RelationTimeTravel", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "UnresolvedTableValuedFunction", "Pivot", "Unpivot", "WithWindowDefinition", "Range", "UnresolvedSubqueryColumnAliases_"):
            self.refuse({"Generate": "LATERAL VIEW isn't supported; use unnest", "OneRowRelation": f"the query doesn't read {SOURCE}"}.get(kind, f"{kind} isn't allowed in a streamed query"))
        if kind in ("LateralJoin",):
            self.lateral(node, ctes)
            return
        if kind in ("Join", "AsOfJoin"):
            self.join(node, ctes)
            return
        if kind not in _PLAIN:
            self.refuse(f"{kind} isn't a query over {SOURCE}")
        self.expressions(node, ctes)
        for child in _items(node.children()):
            self.plan(child, ctes)

    def lateral(self, node, ctes) -> None:
        """One array may be unnested beside the source."""
        right = node.right().plan()
        while right.getClass().getSimpleName() in ("SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedTVFAliases"):
            right = right.child()
        name = ".".join(_items(right.name())).lower() if right.getClass().getSimpleName() == "UnresolvedTableValuedFunction" else ""
        if name not in GENERATORS or node.joinType().getClass().getSimpleName().rstrip("$") not in ("Inner", "Cross") or node.condition().isDefined():
            self.refuse("only CROSS JOIN UNNEST(array) may follow the source")
        self.laterals += 1
        if self.laterals > 1:
            self.refuse("one UNNEST a query is supported")
        for e in _items(right.functionArgs()):
            self.expression(e, ctes)
        self.plan(node.left(), ctes)

    def join(self, node, ctes) -> None:
        kind = node.joinType().getClass().getSimpleName().rstrip("$")
        if kind != "LeftOuter":
            self.refuse(f"a {kind} join depends on rows of other batches; only LEFT JOIN to a declared lookup is allowed")
        side, alias = node.right(), None
        while side.getClass().getSimpleName() == "SubqueryAlias":
            alias, side = side.identifier().name().lower(), side.child()
        parts = [p.lower() for p in _items(side.multipartIdentifier())] if side.getClass().getSimpleName() == "UnresolvedRelation" else []
        if len(parts) != 1 or parts[0] not in self.lookups or parts[0] in ctes:
            self.refuse("the right side of a LEFT JOIN must be a declared lookup by its name")
        if not node.condition().isDefined() or not self.keyed(node.condition().get(), alias or parts[0]):
            self.refuse("the join needs an equality of one side over the lookup's columns and one over the others'")
        self.seen.append(parts[0])
        self.joined.append(parts[0])
        self.expression(node.condition().get(), ctes)
        self.plan(node.left(), ctes)

    def keyed(self, condition, lookup: str) -> bool:
        kind = condition.getClass().getSimpleName()
        if kind == "And":
            return self.keyed(condition.left(), lookup) or self.keyed(condition.right(), lookup)
        if kind != "EqualTo":
            return False
        sides = [self.owners(condition.left(), lookup), self.owners(condition.right(), lookup)]
        return sides in ([{"lookup"}, {"other"}], [{"other"}, {"lookup"}])

    def owners(self, expression, lookup: str) -> set[str]:
        """Whose qualified columns an expression reads."""
        if expression.getClass().getSimpleName() == "UnresolvedAttribute":
            parts = [p.lower() for p in _items(expression.nameParts())]
            return {"none"} if len(parts) < 2 else {"lookup" if parts[0] == lookup else "other"}
        return set().union(*(self.owners(c, lookup) for c in _items(expression.children())), set())

    def aggregate(self, name: str, distinct: bool) -> None:
        if self.grain is Grain.ROW:
            self.refuse(f"{name} aggregates the rows of one batch only; aggregate downstream of the target")
        if name not in SUMS:
            self.refuse(f"{name} of batches can't be put together from each batch's; only sum, count, min and max can")
        if distinct:
            self.refuse(f"{name}(DISTINCT ...) of batches can't be put together from each batch's")

    def expressions(self, node, ctes) -> None:
        for e in _items(node.expressions()):
            self.expression(e, ctes)

    def expression(self, e, ctes) -> None:
        kind = e.getClass().getSimpleName()
        if kind in ("WindowExpression", "UnresolvedWindowExpression"):
            self.refuse("a window (OVER) sees the rows of one batch only")
        if kind == "UnresolvedFunction":
            name = _items(e.nameParts())[-1].lower()
            if name in self.windows:
                self.refuse(f"{name} is a window function, which sees the rows of one batch only")
            if name in self.aggregates:
                self.aggregate(name, e.isDistinct())
            if name in ("stack", "inline", "inline_outer", "posexplode", "posexplode_outer", "explode_outer", "json_tuple"):
                self.refuse(f"{name} isn't supported; use unnest")
        if kind == "AggregateExpression":  # first, last and the like, which the parser knows by their syntax
            self.aggregate(e.aggregateFunction().prettyName().lower(), e.isDistinct())
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
            if kind != "InSubquery":
                self.plan(e.plan(), ctes)
        for child in _items(e.children()):
            self.expression(child, ctes)


_PLAIN = {
    "Project", "Filter", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "Union", "Distinct", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Intersect", "Except", "Aggregate", "UnresolvedHaving",
    "UnresolvedTVFAliases", "ResolvedHint", "UnresolvedHint", "UnresolvedRelation", "Subquery", "Tail",
}


def check(spark: SparkSession, sql: str, grain: Grain = Grain.ROW, lookups: Iterable[str] = (), zones: tuple[str, ...] = rewrite.ZONES) -> Verdict:
    """The rewritten SQL of an acceptable query; raises TransformError otherwise. Idempotent on its own result."""
    text = rewrite.normalise(sql, zones)
    words = [t.lower() for t in rewrite.lex(text) if t.kind == "word"]
    if "tablesample" in words:
        raise TransformError("TABLESAMPLE isn't allowed in a streamed query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        said = getattr(e, "desc", None) or str(e)
        raise TransformError(f"the SQL doesn't parse: {said.splitlines()[0]}") from None
    walk = _Walk(spark, grain, lookups)
    walk.plan(plan)
    if sorted(walk.seen) != sorted(walk.joined):
        raise TransformError("a lookup may be read only as the right side of a LEFT JOIN")
    for w in walk.warnings:
        log.warning("%s", w)
    return Verdict(text, sorted(set(walk.joined)), walk.warnings)
