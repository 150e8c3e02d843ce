"""The SQL front end: tables as views, the dialect's functions, epoch literals, and a read-only guard."""

from __future__ import annotations

import difflib
import re
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tempora.functions import kernels
from tempora.functions import windows as W
from tempora.operators import preprocess, series
from tempora.plans.dialect import KERNELS, DialectError, arguments, closing, find_calls, masked, rewrite, spec_of
from tempora.session import ship

#: Commands that only look; names are those of the parser's plans.
_LOOKS = ("Show", "Describe", "Explain")


class ReadOnlyError(ValueError):
    pass


def guard(text: str, spark: SparkSession | None = None) -> None:
    """Refuse everything but queries, wherever a write stands in the statement: the parser's plan tells."""
    bare = masked(text).strip().rstrip(";").strip()
    if ";" in bare:
        raise ReadOnlyError("one statement at a time")
    if not bare:
        raise ReadOnlyError("only queries are allowed, not nothing")
    spark = spark or SparkSession.active()
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text.strip().rstrip(";"))
    command = spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")
    waiting = [plan]
    while waiting:
        node = waiting.pop()
        name = node.getClass().getSimpleName()
        if name == "ExplainCommand":
            waiting.append(node.logicalPlan())
        elif (command.isInstance(node) or name.startswith("Insert") or "Statement" in name) and not name.startswith(_LOOKS):
            raise ReadOnlyError(f"only queries are allowed, not {name}")
        for inner in (node.children(), node.innerChildren()):
            waiting += [x for x in (inner.apply(i) for i in range(inner.size())) if hasattr(x, "children")]


class SqlSession:
    """Tables under names of their own; queries are read-only."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, time_columns: tuple[str, ...] = ("_time", "ts")):
        self.spark, self.time_columns, self.names = spark, time_columns, []
        for name, frame in (tables or {}).items():
            self.register(name, frame)

    def register(self, name: str, frame: DataFrame) -> None:
        frame.createOrReplaceTempView(name)
        self.names.append(name)

    def sql(self, text: str) -> DataFrame:
        text = self._with_kernels(text)
        made = rewrite(text, self.time_columns)
        guard(made, self.spark)
        return self.spark.sql(made)

    # -- window functions that are no expressions: the rows of their FROM and WHERE get a column more, and stand in for it --

    def _with_kernels(self, text: str) -> str:
        while calls := find_calls(masked(text), KERNELS):
            text = self._with_kernel(text, calls[-1])
        return text

    def _with_kernel(self, text: str, call: re.Match) -> str:
        bare, name = masked(text), call[1].lower()
        args, end = arguments(text, bare, call.end() - 1)
        fewest, most = KERNELS[name]
        if not fewest <= len(args) <= most:
            raise DialectError(f"{name} takes {fewest} to {most} arguments")
        spec, end = spec_of(text, bare, end, name)
        # the SELECT that the call stands in, and its FROM ... WHERE
        begin, stop = 0, len(text)
        for i, c in enumerate(bare[: call.start()]):
            if c == "(" and re.match(r"\s*(select|with)\b", bare[i + 1 :], re.I) and closing(bare, i) > call.start():
                begin, stop = i + 1, closing(bare, i)
        flat, depth = list(bare), 0
        for i in range(begin, stop):
            depth -= bare[i] == ")"
            if depth:
                flat[i] = " "
            depth += bare[i] == "("
        flat = "".join(flat)
        select = [m for m in re.compile(r"\bselect\b", re.I).finditer(flat, begin, call.start())]
        source = re.compile(r"\bfrom\b", re.I).search(flat, end, stop)
        if not select or not source:
            raise DialectError(f"{name} stands in no SELECT ... FROM")
        tail = re.compile(r"\b(group\s+by|having|order\s+by|limit|offset|window|union|intersect|except|minus|qualify)\b", re.I).search(flat, source.end(), stop)
        rest = tail.start() if tail else stop
        if tail and tail[1].lower().startswith(("group", "having")):
            raise DialectError(f"{name} does not stand beside GROUP BY: group in a subquery first")
        table = re.compile(r"\s*([\w.]+|\()", re.I).match(bare, source.end())
        behind = closing(bare, table.start(1)) + 1 if table and table[1] == "(" else table.end() if table else rest
        alias = re.compile(r"\s+(?:as\s+)?(?!where\b|join\b|left\b|right\b|full\b|inner\b|cross\b|lateral\b|on\b)(\w+)", re.I).match(flat, behind, rest)
        more = flat[alias.end() if alias else behind : rest]
        if re.match(r"\s*(,|(left|right|full|inner|cross|natural|join|lateral)\b)", more, re.I):
            raise DialectError(f"{name} reads one table or subquery; join in a subquery first")
        shown = alias[1] if alias else table[1].rsplit(".", 1)[-1] if table[1] != "(" else "__rows"
        made, column = f"__kernel_{uuid.uuid4().hex}", f"__k{uuid.uuid4().hex[:8]}"
        rows = self.sql(f"SELECT * FROM {text[source.end() : rest]}")
        self._kernel(rows, name, args, spec, column).createOrReplaceTempView(made)
        items = re.sub(r"(?<=[\s,])\*(?=\s*(,|$))", ", ".join(f"`{c}`" for c in rows.columns), text[select[-1].end() : call.start()] + column + text[end : source.start()])
        return f"{text[: select[-1].end()]}{items}FROM {made} AS {shown} {text[rest:]}"

    def _kernel(self, rows: DataFrame, name: str, args: list[str], spec, column: str) -> DataFrame:
        """The rows with the function's value in ``column``."""
        keys = [x.strip() for x in re.sub(r"(?i)^partition\s+by", "", spec.partition).split(",")] if spec.partition else []
        if not spec.order:
            raise DialectError(f"{name} needs ORDER BY")
        order = re.sub(r"(?i)^order\s+by", "", spec.order).strip()
        if re.search(r",|\b(desc|nulls)\b", masked(order), re.I):
            raise DialectError(f"{name} takes one ascending ORDER BY expression")
        order = re.sub(r"(?i)\s+asc$", "", order)
        named = rows.withColumns({f"__key{i}": F.expr(rewrite(k, self.time_columns)) for i, k in enumerate(keys)} | {"__order": F.expr(rewrite(order, self.time_columns)), "__value": F.expr(rewrite(args[0], self.time_columns)).cast("double")})
        own = [f"__key{i}" for i in range(len(keys))]
        helpers = [*own, "__order", "__value"]
        if name == "ewm":
            alpha = float(args[1])
            return preprocess.ewm(named, own, ["__order"], "__value", alpha, column).drop(*helpers)
        if name == "cross_correlation":
            lag = int(args[2])
            over, whole = Window.partitionBy(*own).orderBy("__order"), Window.partitionBy(*own)
            b = F.expr(rewrite(args[1], self.time_columns)).cast("double")
            named = named.withColumn("__partner", F.lag(b, lag).over(over) if lag >= 0 else F.lead(b, -lag).over(over))
            r = W.pearson(F.col("__value"), F.col("__partner"), whole)
            return named.withColumn(column, F.when(~F.isnan(r), r)).drop(*helpers, "__partner")
        period, robust = int(args[1]), len(args) > 2 and args[2].lower() == "true"
        if period < 2:
            raise DialectError(f"{name}: the period must be at least 2")
        parts = series.stl(named, own, ["__order"], "__value", period, robust, carried=["__order", "__value", *rows.columns])
        whole = F.struct("trend", "seasonal", "residual")
        return parts.withColumn(column, whole if name == "stl_decompose" else F.col(name.removeprefix("stl_"))).select(*rows.columns, column)

    def register_forecasts(self) -> None:
        """SQL aggregates forecast(v, ts, n) and auto_forecast(v, ts, n), arrays of the next n values of a group; a group is one series."""
        ship(self.spark)
        for name, kernel, least in (("forecast", kernels.ses, 2), ("auto_forecast", kernels.auto_forecast, 8)):

            def run(v: pd.Series, ts: pd.Series, n: pd.Series, kernel=kernel, least=least) -> list:
                rows = pd.DataFrame({"v": v, "t": ts}).dropna().sort_values("t", kind="stable").drop_duplicates("t", keep="last")
                return kernel(rows["v"].to_numpy(float), int(n.iloc[0])).mean.tolist() if len(rows) >= least else None

            run.__annotations__ = {"v": pd.Series, "ts": pd.Series, "n": pd.Series, "return": list}
            self.spark.udf.register(name, F.pandas_udf(run, "array<double>", F.PandasUDFType.GROUPED_AGG))

    def suggest(self, name: str) -> list[str]:
        """Names like a misspelt one."""
        return difflib.get_close_matches(name, self.names)

    def register_function(self, name: str, function, kind: str) -> None:
        self.spark.udf.register(name, function, kind)

    def register_aggregate(self, name: str, function, kind: str) -> None:
        """function(series of values, ...) -> one value per group, over pandas series; null-free groups are not assumed."""
        ship(self.spark)
        self.spark.udf.register(name, F.pandas_udf(function, kind, F.PandasUDFType.GROUPED_AGG))
