"""Per-anchor explanations by a user's explainer, as a table function whose columns the explainer declares."""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import Protocol

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tidewatch.config import FEATURES


class Explainer(Protocol):
    """What a user brings: the columns of an explanation, and the rows of one anchor from its history (windows x features)."""

    columns: str

    def explain(self, history: list[list[float]]) -> Iterable[tuple]: ...


class LinearExplainer:
    """The ``top`` features by the size of weight x compressed value in the newest window."""

    columns = "rank int, feature string, value double, contribution double"

    def __init__(self, weights: dict[str, float], top: int = 3):
        self.weights, self.top = weights, top

    def explain(self, history: list[list[float]]) -> Iterable[tuple]:
        found = []
        for i, (name, value) in enumerate(zip(FEATURES, history[-1])):
            contribution = round(self.weights.get(name, 0.0) * math.copysign(math.log1p(abs(value)), value), 6)
            found.append((-abs(contribution), i, name, float(value), contribution))
        for rank, (_, _, name, value, contribution) in enumerate(sorted(found)[:self.top], 1):
            yield rank, name, value, contribution + 0.0


def explanations(anchors: DataFrame, explainer: Explainer, keys: tuple = ("day", "window_index"), history: str = "x") -> DataFrame:
    """``keys`` of each anchor with the explainer's rows for it.

    Spark asks the function for its schema while it plans: the keys as they are in the table, then the columns of the explainer. An anchor is
    one row with a history of bounded size, so nothing is shuffled.
    """
    own = StructType.fromDDL(explainer.columns)

    class Explain:
        @staticmethod
        def analyze(table: AnalyzeArgument) -> AnalyzeResult:
            fields = {f.name: f for f in table.dataType.fields}
            return AnalyzeResult(schema=StructType([*[fields[k] for k in keys], *own.fields]))

        def eval(self, row: Row) -> Iterable[tuple]:
            named = tuple(row[k] for k in keys)
            for found in explainer.explain(row[history]):
                yield (*named, *found)

    return F.udtf(Explain)(anchors.select(*keys, history).asTable())
