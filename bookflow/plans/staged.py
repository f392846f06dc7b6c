"""Catalogues of named expressions in stages. A stage sees the columns of the stages before.

A catalogue compiles to a DataFrame plan, one projection a stage (windows of one specification share an exchange, so a
catalogue shuffles once), or to the text of a query with one common table expression a stage.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from bookflow.schema import GROUP


@dataclass
class Catalogue:
    stages: list[list[tuple[str, str]]] = field(default_factory=list)

    def needed(self, outputs: list[str]) -> Catalogue:
        """Only what the outputs use, so that unused windows never reach the optimizer."""
        wanted, stages = set(outputs), []
        for stage in reversed(self.stages):
            kept = [(n, e) for n, e in stage if n in wanted]
            for _, e in kept:
                wanted |= set(re.findall(r"[a-z_][a-z_0-9]*", e))
            stages.append(kept)
        return Catalogue([s for s in reversed(stages) if s])

    def names(self) -> list[str]:
        return [n for s in self.stages for n, _ in s]

    def apply(self, df: DataFrame, outputs: list[str] | None = None) -> DataFrame:
        """A stage with long or many moving frames takes them from :mod:`bookflow.operators.rolling`, others from Spark. Where the
        ``outputs`` are named, other columns may go before rows pass through Arrow."""
        from bookflow.operators import rolling

        for k, stage in enumerate(self.stages):
            replaced, calls = rolling.calls_of(stage)
            if calls and rolling.worth(calls):
                if outputs is not None:
                    used = {*outputs, *GROUP, "row_nr"} | {word for later in self.stages[k:] for _, e in later for word in re.findall(r"[a-z_][a-z_0-9]*", e)}
                    df = df.select(*(c for c in df.columns if c in used))
                columns = df.columns
                df = rolling.add(df, calls).selectExpr(*columns, *(f"{e} AS {n}" for n, e in replaced))
            else:
                df = df.selectExpr("*", *(f"{e} AS {n}" for n, e in stage))
        return df

    def ctes(self, source: str) -> tuple[list[str], str]:
        """(common table expressions, the name of the last)."""
        out = []
        for k, stage in enumerate(self.stages):
            out.append(f"stage{k} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in stage) + f" FROM {source})")
            source = f"stage{k}"
        return out, source
