"""Tools as a table function: call_tool(name, arguments) gives a tool's rows, whose columns depend on the name.

    SELECT p.p_partkey, t.* FROM part p, LATERAL call_tool('split_words', to_json(struct(p_name AS text))) t

The name is a constant, so that the columns are known when the query is analysed; the arguments are a JSON object per row. A
call that fails gives one row with its error and nulls in the tool's columns, so that the other calls stand.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@dataclass(frozen=True)
class Tool:
    """columns as DDL, and a function from the arguments to rows."""

    columns: str
    run: Callable[[dict], Iterable[tuple]]


def split_words(a: dict) -> Iterator[tuple]:
    yield from enumerate(a["text"].split(), 1)


def count_tokens(a: dict) -> Iterator[tuple]:
    size = len(a["text"].encode())
    yield size, -(-size // 4)


def phone_parts(a: dict) -> Iterator[tuple]:
    country, area, local = a["phone"].split("-", 2)
    yield int(country), int(area), local


TOOLS = {
    "split_words": Tool("position int, word string", split_words),
    "count_tokens": Tool("bytes long, tokens long", count_tokens),
    "phone_parts": Tool("country int, area int, local string", phone_parts),
}


def register(spark: SparkSession, tools: Mapping[str, Tool] = TOOLS, name: str = "call_tool") -> None:
    """Make tools callable in SQL as the table function name."""
    runs = {k: t.run for k, t in tools.items()}
    kinds = {k: StructType.fromDDL(t.columns).add("error", StringType()) for k, t in tools.items()}

    class CallTool:
        @staticmethod
        def analyze(tool: AnalyzeArgument, arguments: AnalyzeArgument) -> AnalyzeResult:
            if not tool.isConstantExpression or tool.value not in kinds:
                raise ValueError(f"the tool's name is one of {', '.join(sorted(kinds))}, as a constant")
            if arguments.dataType != StringType():
                raise ValueError("arguments are a JSON text")
            return AnalyzeResult(kinds[tool.value])

        def eval(self, tool: str, arguments: str | None) -> Iterator[tuple]:
            width = len(kinds[tool]) - 1
            try:
                given = json.loads(arguments or "{}")
                if not isinstance(given, dict):
                    raise ValueError("arguments are no JSON object")
                rows = [(*row, None) for row in runs[tool](given)]
            except Exception as e:
                rows = [(*[None] * width, type(e).__name__)]
            yield from rows

    spark.udtf.register(name, F.udtf(CallTool))
