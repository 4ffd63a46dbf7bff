"""JSON scan specifications: one document names a kernel and its limits and becomes a DataFrame.

``{"version": 1, "kernel": "hamming" | "cosine" | "dot", "scan": {"threshold": t, "top_k": k}, "pipeline": [{"stage":
"filter", "where": "<predicate>"}, {"stage": "limit", "n": n}]}``
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.functions import vectors as V

#: Distance of a column to a query by kernel name, least first.
KERNELS = {
    "hamming": lambda c, q: V.hamming(c, F.lit(q)),
    "cosine": lambda c, q: 1 - V.cosine(c, F.array(*[F.lit(float(x)) for x in q])),
    "dot": lambda c, q: -V.dot(c, F.array(*[F.lit(float(x)) for x in q])),
}


@dataclass(frozen=True)
class ScanSpec:
    kernel: str
    threshold: float | None = None
    top_k: int | None = None
    stages: list[dict] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> ScanSpec:
        raw = json.loads(text)
        if raw.get("version") != 1:
            raise ValueError("version 1 is known")
        if raw.get("kernel") not in KERNELS:
            raise ValueError(f"kernels are {', '.join(KERNELS)}")
        scan = raw.get("scan", {})
        if scan.get("top_k") is not None and scan["top_k"] < 0:
            raise ValueError("top_k is not negative")
        return cls(raw["kernel"], scan.get("threshold"), scan.get("top_k"), raw.get("pipeline", []))

    def distance(self, column: Column, query) -> Column:
        return KERNELS[self.kernel](column, query)

    def apply(self, base: DataFrame, key: str, column: str, query) -> DataFrame:
        """key, d: rows within the threshold (included), the nearest top_k of them, ties by key."""
        out = base
        for stage in self.stages:
            if stage.get("stage") == "filter":
                out = out.where(stage["where"])
        out = out.select(key, self.distance(F.col(column), query).alias("d"))
        if self.threshold is not None:
            out = out.where(F.col("d") <= self.threshold)
        if self.top_k is not None:
            out = out.orderBy("d", key).limit(self.top_k)
        for stage in self.stages:
            if stage.get("stage") == "limit":
                out = out.orderBy("d", key).limit(int(stage["n"]))
        return out
