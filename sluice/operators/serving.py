"""Role-scoped queries: a session that sees a role's tables alone, capped statements, ordered pages."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

from py4j.java_gateway import is_instance_of
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

DEFAULT_ROWS, MOST_ROWS = 1000, 10_000
#: Leaves of an analysed plan that are no table: rows of the statement's own.
PLAIN_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnresolvedInlineTable", "ResolvedInlineTable"}
#: Parts of expression class names that stand for code beyond the built-in functions.
FOREIGN = ("Reflection", "Reflect", "ScalaUDF", "PythonUD", "PythonFunction", "UserDefined", "ApplyFunction", "V2Aggregator")
#: How times stand in a token.
MICROS = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
BUILT_IN = "org.apache.spark.sql.catalyst."


class NotAllowed(PermissionError):
    """The role has no right to the table, or to what the statement does."""


def role_tables(policy: DataFrame, registry: DataFrame) -> DataFrame:
    """(role, table, and registry's other columns): the tables of each role that are registered."""
    return policy.select("role", "table").distinct().join(registry, "table").select("role", "table", *(c for c in registry.columns if c != "table"))


def scoped_session(spark: SparkSession, tables: Mapping[str, Callable[[SparkSession], DataFrame]], allowed: Sequence[str]) -> SparkSession:
    """A session with a view for each allowed table that exists.

    It does not see the views of the session it comes from, and can't name files. What the
    catalog and the global views have is there by name, as for every session of the
    application: so capped_sql lets a statement read these views alone.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    views = [name for name in allowed if name in tables]
    for name in views:
        tables[name](session).createOrReplaceTempView(name)
    session.sluice_scope = frozenset(v.lower() for v in views)
    return session


def check_scope(df: DataFrame, views: frozenset[str]) -> None:
    """NotAllowed unless the analysed plan reads these temporary views and rows of its own alone, and calls built-in functions alone.

    The plan is walked down to the views, with the plans of subqueries in expressions; what
    is below a view is its owner's. Nothing is run for that.
    """
    gateway = df.sparkSession.sparkContext._gateway

    def each(seq) -> Iterator:
        return (seq.apply(i) for i in range(seq.size()))

    def expression(e) -> None:
        name = e.getClass().getName()
        if not name.startswith(BUILT_IN) or any(x in name for x in FOREIGN):
            raise NotAllowed(f"the statement calls {name.rpartition('.')[2]}")
        if is_instance_of(gateway, e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            plan(e.plan())
        for child in each(e.children()):
            expression(child)

    def plan(p) -> None:
        name = p.getClass().getSimpleName()
        if name == "View":
            view = p.desc().identifier()
            if not p.isTempView() or view.database().isDefined() or view.table().lower() not in views:
                raise NotAllowed(view.unquotedString())
            return
        for e in each(p.expressions()):
            expression(e)
        children = list(each(p.children()))
        if not children and name not in PLAIN_LEAVES:
            raise NotAllowed(f"the statement reads {p.simpleString(5)}")
        for child in children:
            plan(child)

    plan(df._jdf.queryExecution().analyzed())


def clamp(rows: int | None, most: int = MOST_ROWS) -> int:
    return max(1, min(DEFAULT_ROWS if rows is None else rows, most))


def capped_sql(session: SparkSession, statement: str, rows: int | None = None, most: int = MOST_ROWS) -> DataFrame:
    """A SELECT of at most so many rows. As a subquery nothing but a query parses; a comment can't swallow its end.

    In a session of scoped_session the analysed statement may read its views alone (check_scope), or NotAllowed is raised.
    """
    out = session.sql(f"SELECT * FROM (\n{statement}\n) AS q")
    scope = getattr(session, "sluice_scope", None)
    if scope is not None:
        check_scope(out, scope)
    return out.limit(clamp(rows, most))


def page(df: DataFrame, order: Sequence[str], offset: int, limit: int, most: int = MOST_ROWS) -> DataFrame:
    """Rows offset .. offset + limit in the order of columns that make it total. All rows before them are sorted too: for depth use page_after."""
    return df.orderBy(*(F.col(c).asc_nulls_first() for c in order)).offset(max(0, offset)).limit(clamp(limit, most))


def _beyond(order: Sequence[str], key: Sequence[Column]) -> Column:
    """Rows after the key in ascending order, nulls first; key: a column for each of `order`."""
    cases, same = [], F.lit(True)
    for c, k in zip(order, key):
        c = F.col(c)
        cases.append(same & F.when(k.isNull(), c.isNotNull()).otherwise(F.coalesce(c > k, F.lit(False))))
        same = same & c.eqNullSafe(k)
    return reduce(lambda a, b: a | b, cases)


def token_of(row: Row | Mapping, order: Sequence[str], df: DataFrame) -> str:
    """An opaque token that stands for a place in the order: that of a row's key."""
    key = df.sparkSession.createDataFrame([tuple(row[c] for c in order)], df.select(*order).schema)
    text = key.select(F.to_json(F.struct(*order), {"ignoreNullFields": "false", "timestampNTZFormat": MICROS, "timestampFormat": f"{MICROS}XXX"})).first()[0]
    return base64.urlsafe_b64encode(text.encode()).decode()


def page_after(df: DataFrame, order: Sequence[str], token: str | None, limit: int, most: int = MOST_ROWS) -> DataFrame:
    """At most `limit` rows behind the token's key (all, without one) in the order of columns that make it total.

    The key is a filter, whose first column reaches the scan, and the rows behind it compete for
    the page: so a deep page costs no more than the first. Nothing is numbered or skipped,
    and rows that are added before the key meanwhile shift no page. A token that is not one of this order is a ValueError.
    """
    if token is not None:
        try:
            key = json.loads(base64.urlsafe_b64decode(token.encode()), parse_float=str)  # digits as they are
            if list(key) != list(order):
                raise ValueError(f"keys {list(key)}")
        except ValueError as e:
            raise ValueError(f"not a token of the order {list(order)}: {e}") from None
        kinds = {f.name: f.dataType for f in df.select(*order).schema}
        text = {c: F.lit(None if v is None else str(v) if not isinstance(v, bool) else str(v).lower()).cast(kinds[c]) for c, v in key.items()}
        first = order[0]
        if key[first] is not None:
            df = df.where(F.col(first) >= text[first])  # implied by the filter below, and simple enough for the scan
        df = df.where(_beyond(order, [text[c] for c in order]))
    return df.orderBy(*(F.col(c).asc_nulls_first() for c in order)).limit(clamp(limit, most))


def next_page(df: DataFrame, order: Sequence[str], token: str | None = None, limit: int = DEFAULT_ROWS, most: int = MOST_ROWS) -> tuple[list[Row], str | None]:
    """The rows of a page, and the token of the next one; None behind the last row."""
    rows = page_after(df, order, token, limit, most).collect()
    return rows, token_of(rows[-1], order, df) if len(rows) == clamp(limit, most) else None


def browse(tables: Mapping[str, DataFrame], allowed: Sequence[str], name: str, order: Sequence[str], offset: int = 0, limit: int = DEFAULT_ROWS) -> DataFrame:
    if name not in allowed or name not in tables:
        raise NotAllowed(name)
    return page(tables[name], order, offset, limit)
