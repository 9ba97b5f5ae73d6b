"""Scale guards on physical plans, checked on every registered query.

* no window without a partition key (it moves every row to one task);
* no Cartesian product;
* a single-partition exchange only above a partial aggregate (one row per task) or a
  top-k (k rows per task);
* a nested-loop join only against a broadcast global aggregate (one row).
"""

from __future__ import annotations


def _children(node):
    seq = node.children()
    return [seq.apply(i) for i in range(seq.size())]


def _unwrap(node):
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return _unwrap(node.executedPlan())
    if name in ("ShuffleQueryStage", "BroadcastQueryStage", "TableCacheQueryStage"):
        return _unwrap(node.plan())
    if name in ("ReusedExchange",):
        return _unwrap(node.child())
    return node


def _is_global_aggregate(node) -> bool:
    node = _unwrap(node)
    name = node.nodeName()
    if name in ("HashAggregate", "SortAggregate", "ObjectHashAggregate"):
        return node.groupingExpressions().isEmpty()
    if name in ("Project", "Filter", "BroadcastExchange", "WholeStageCodegen", "InputAdapter", "Exchange",
                "ColumnarToRow", "AQEShuffleRead"):
        kids = _children(node)
        return len(kids) == 1 and _is_global_aggregate(kids[0])
    if name == "LocalTableScan":
        return True
    return False


def _partial_below(node) -> bool:
    node = _unwrap(node)
    name = node.nodeName()
    if name in ("HashAggregate", "SortAggregate", "ObjectHashAggregate", "TakeOrderedAndProject",
                "LocalLimit", "CollectLimit", "LocalTableScan"):
        return True
    if name in ("Project", "Filter", "WholeStageCodegen", "InputAdapter", "ColumnarToRow", "Sort"):
        kids = _children(node)
        return len(kids) == 1 and _partial_below(kids[0])
    return False


def plan_problems(df) -> list[str]:
    problems: list[str] = []

    def walk(node):
        node = _unwrap(node)
        name = node.nodeName()
        if name == "Window" and node.partitionSpec().isEmpty():
            problems.append("window without partition key")
        if name == "CartesianProduct":
            problems.append("cartesian product")
        if name == "Exchange" and "SinglePartition" in node.outputPartitioning().toString():
            if not _partial_below(_children(node)[0]):
                problems.append("single-partition exchange of raw rows")
        if name == "BroadcastNestedLoopJoin":
            build = node.buildSide().toString()
            kids = _children(node)
            side = kids[1] if "Right" in build else kids[0]
            if not _is_global_aggregate(side):
                problems.append("nested-loop join against a side that is not one row")
        for c in _children(node):
            walk(c)
        # subqueries (scalar subqueries in filters/projections)
        try:
            subs = node.subqueries()
            for i in range(subs.size()):
                walk(subs.apply(i))
        except Exception:  # noqa: BLE001
            pass

    walk(df._jdf.queryExecution().executedPlan())
    return problems
