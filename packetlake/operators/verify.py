"""V1–V3: check a user filter before it is stored or used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import PACKET_SCHEMA, TARGET_SCHEMA
from .query import customized, is_blank, is_full_select, run_user_sql

# Logical operators after which every output row still comes from one input
# row (no aggregate, join, window, limit, set difference or generator).
ROW_LOCAL_NODES = {"Project", "Filter", "Union", "Distinct", "Sort", "SubqueryAlias", "View", "WithCTE",
                   "CTERelationDef", "CTERelationRef", "LogicalRelation", "LocalRelation", "LogicalRDD"}


def schema_problems(schema: T.StructType) -> list[str]:
    """V2: the delivered columns must be present with their exact types."""
    have = {f.name: f.dataType for f in schema.fields}
    problems = []
    for field in TARGET_SCHEMA.fields:
        if field.name not in have:
            problems.append(f"column `{field.name}` is missing")
        elif have[field.name] != field.dataType:
            problems.append(f"column `{field.name}` is {have[field.name].simpleString()}, "
                            f"expected {field.dataType.simpleString()}")
    return problems


def compose_on_empty(spark: SparkSession, user_sql: str, summaries: dict | None = None) -> DataFrame:
    """The feed's statement (cursor 0) over an empty ``packets`` table, with its summaries of it."""
    def empty(session: SparkSession) -> DataFrame:
        rows = session.createDataFrame([], PACKET_SCHEMA)
        for name, summary in (summaries or {}).items():
            summary.over(rows).createOrReplaceTempView(name)
        return rows

    return customized(empty, user_sql, after=0, base=spark)


def verify_filter(spark: SparkSession, user_sql: str | None, summaries: dict | None = None) -> str | None:
    """V1: ``None`` if the filter is usable, else the error text.

    Parsing and analysis (unknown columns, bad syntax, ``ORDER BY`` in a
    condition, a result without the 12 columns) happen on an empty table, then
    the plan is run once on it.  Errors that only data can raise (a cast of
    ``'abc'`` to a number) are not visible here.
    """
    if is_blank(user_sql):
        return None
    try:
        df = compose_on_empty(spark, user_sql, summaries)
        problems = schema_problems(df.schema)
        if problems:
            return "; ".join(problems)
        df.limit(0).collect()
    except Exception as exc:  # noqa: BLE001 – the message is the answer
        return str(exc).strip().splitlines()[0] if str(exc).strip() else type(exc).__name__
    return None


# Expressions whose value depends on when they run.
CLOCK_EXPRESSIONS = {"CurrentDate", "CurrentTime", "CurrentTimestamp", "CurrentBatchTimestamp", "LocalTimestamp", "Now"}


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _reads_clock(expression) -> bool:
    return _kind(expression) in CLOCK_EXPRESSIONS or any(_reads_clock(c) for c in _items(expression.children()))


def _keeps_index(node) -> bool:
    """Whether what the node calls ``index`` is what its input calls ``index``."""
    if node.nodeName() == "Project":
        for e in _items(node.projectList()):
            if e.name().lower() == "index":
                source = e.child() if _kind(e) == "Alias" else e
                if _kind(source) != "AttributeReference" or source.name().lower() != "index":
                    return False
    elif node.nodeName() == "Union":
        names = [[a.name().lower() for a in _items(c.output())] for c in _items(node.children())]
        at = {n.index("index") if n.count("index") == 1 else -1 for n in names}
        return len(at) == 1 and -1 not in at
    return True


def is_row_local(df: DataFrame) -> bool:
    """True when the analysed plan only selects, filters and unions rows, each
    under its own ``index``, by expressions that always give the same value.

    Such a statement gives, for the new rows of a batch, exactly what it gives
    over the whole history restricted to those rows – ``index`` is unique, so
    even a ``DISTINCT`` cannot merge a new row with an old one – and a feed may
    evaluate it on the new batch alone.
    """
    stack = [df._jdf.queryExecution().analyzed()]
    while stack:
        node = stack.pop()
        if node.nodeName() not in ROW_LOCAL_NODES or node.subqueries().size() > 0 or not _keeps_index(node):
            return False
        if any(not e.deterministic() or _reads_clock(e) for e in _items(node.expressions())):
            return False
        stack.extend(_items(node.children()))
    return True


def full_sql_is_row_local(spark: SparkSession, user_sql: str | None) -> bool:
    """Whether a Mode B filter may be evaluated on new rows only."""
    if is_blank(user_sql) or not is_full_select(user_sql):
        return False
    return is_row_local(run_user_sql(lambda s: s.createDataFrame([], PACKET_SCHEMA), user_sql, base=spark))


def filter_is_row_local(spark: SparkSession, user_sql: str | None) -> bool:
    """Whether a filter of either mode may be evaluated on new rows only (a
    blank filter or a condition without subqueries: yes)."""
    if is_blank(user_sql):
        return True
    if is_full_select(user_sql):
        return full_sql_is_row_local(spark, user_sql)
    return is_row_local(compose_on_empty(spark, user_sql))


class FilterSetting:
    """V3: a stored filter, checked only when its text changes."""

    def __init__(self, spark: SparkSession, text: str | None = None, summaries: dict | None = None):
        self.spark = spark
        self.summaries = summaries or {}
        self.text: str | None = None
        self.row_local = True      # no filter: every row says it for itself
        self.checks = 0
        if text is not None:
            self.set(text)

    def set(self, text: str | None) -> None:
        if text == self.text:
            return
        self.checks += 1
        error = verify_filter(self.spark, text, self.summaries)
        if error:
            raise ValueError(f"filter refused: {error}")
        self.text = text
        # With summaries the statement says itself what it needs of the history.
        self.row_local = not self.summaries and filter_is_row_local(self.spark, text)
