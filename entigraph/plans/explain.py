"""What a graph query will do: a logical summary and Spark's own plan."""

from __future__ import annotations

import time
from collections import Counter
from contextlib import contextmanager

from pyspark.sql import DataFrame

from entigraph.operators.graph import Engine
from entigraph.plans import ir
from entigraph.plans.planner import fields_of, plan


def summary(engine: Engine, query: ir.GraphQuery) -> str:
    made = plan(engine.schema, query)
    lines = [f"root {made.entity.name}: filter on {sorted(fields_of(query.where))}, order {[o.field for o in query.order]}, limit {query.limit}, offset {query.offset}"]
    for s in made.includes:
        r = s.relation
        lines.append(f"include {s.path}: {r.from_entity}{list(r.from_fields)} = {r.to_entity}{list(r.to_fields)} ({r.cardinality}), filter on {sorted(fields_of(s.include.where))}, limit per parent {s.include.limit}")
    return "\n".join(lines)


def physical(rows: DataFrame, mode: str = "formatted") -> str:
    return rows.sparkSession._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), mode)


class Metrics:
    """Counts and latencies of queries, as text in the exposition format of common monitoring systems."""

    BOUNDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 60.0)

    def __init__(self) -> None:
        self.counts: Counter = Counter()
        self.latencies: dict[str, list[float]] = {}

    @contextmanager
    def timed(self, kind: str):
        began = time.perf_counter()
        try:
            yield
            self.counts[kind, "ok"] += 1
        except Exception:
            self.counts[kind, "error"] += 1
            raise
        finally:
            self.latencies.setdefault(kind, []).append(time.perf_counter() - began)

    def quantile(self, kind: str, q: float) -> float:
        own = sorted(self.latencies.get(kind, []))
        return own[min(len(own) - 1, int(q * len(own)))] if own else 0.0

    def text(self) -> str:
        out = [f'entigraph_queries_total{{kind="{k}",outcome="{o}"}} {n}' for (k, o), n in sorted(self.counts.items())]
        for kind, own in sorted(self.latencies.items()):
            out += [f'entigraph_query_seconds_bucket{{kind="{kind}",le="{b}"}} {sum(x <= b for x in own)}' for b in self.BOUNDS]
            out.append(f'entigraph_query_seconds_count{{kind="{kind}"}} {len(own)}')
        return "\n".join(out)
