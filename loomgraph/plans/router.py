"""Questions in plain words, golden questions, and comparison of answers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Word tests in order; the first whose tests all hold decides. A test holds if one of its words is in the question.
ROUTES = [
    ("stats", None, [["stat"]]),
    ("subject_publishers", "subject", [["subject", "nats"], ["publish", "producer", "sender"]]),
    ("subject_subscribers", "subject", [["subject", "nats"], ["subscribe", "consumer", "handler", "listener"]]),
    ("queue_producers", "queue", [["queue", "bullmq"], ["produce", "publisher", "sender"]]),
    ("queue_consumers", "queue", [["queue", "bullmq"], ["consume", "processor", "worker"]]),
    ("table_users", "table", [["table", "database", "db "]]),
    ("module_imports", "module", [["module"], ["import", "depend"]]),
    ("service_dependents", "service", [["depended", "callers", "used by", "calls"]]),
    ("service_dependencies", "service", [["depend on", "depends on", "uses", "use"]]),
]


@dataclass(frozen=True)
class Route:
    tool: str
    argument: str | None = None
    target: str | None = None


def route(question: str) -> Route:
    """Which question is meant, and about what: the text in quotes, else the last word."""
    low = question.lower()
    quoted = re.search(r"['\"`]([^'\"`]+)['\"`]", question)
    target = quoted[1] if quoted else re.split(r"\s+", question)[-1]
    for tool, argument, tests in ROUTES:
        if all(any(w in low for w in words) for words in tests):
            return Route(tool, argument, target if argument else None)
    return Route("unknown")


class Shuffle:
    """A small seeded generator for repeatable question sets: 32-bit state, multiply and shift."""

    def __init__(self, seed: str) -> None:
        h = 0x811C9DC5
        for b in seed.encode():
            h = (h ^ b) * 0x01000193 & 0xFFFFFFFF
        self.state = h

    def below(self, n: int) -> int:
        self.state = (self.state * 1664525 + 1013904223) & 0xFFFFFFFF
        return (self.state >> 8) % n

    def order(self, items: list) -> list:
        out = list(items)
        for i in range(len(out) - 1, 0, -1):
            j = self.below(i + 1)
            out[i], out[j] = out[j], out[i]
        return out


CATEGORIES = {"publishers": ("nats-publish", "nats-request"), "subscribers": ("nats-subscribe", "nats-reply"), "queues": ("queue-produce", "queue-consume"), "tables": ("db-access",), "imports": ("lib-usage",), "endpoints": ("endpoint-of",), "modules": ("di-import",)}


def golden_questions(edges: DataFrame, n: int = 10, seed: str = "graph") -> list[dict]:
    """Questions with their answers by category: an equal quota each, what is left over in turns."""
    pools: dict[str, list[dict]] = {}
    for category, kinds in CATEGORIES.items():
        centre, other = ("src", "dst") if category in ("subscribers", "imports", "modules") else ("dst", "src")
        grouped = edges.filter(F.col("kind").isin(*kinds)).groupBy(F.col(centre).alias("about")).agg(F.slice(F.array_sort(F.collect_set(other)), 1, 50).alias("answers"))
        rows = grouped.orderBy(F.xxhash64(F.lit(seed), "about"), "about").limit(n).collect()  # n at most
        pools[category] = Shuffle(f"{seed}:{category}").order([{"category": category, "about": r["about"], "answers": r["answers"]} for r in rows])
    quota, out = max(1, n // len(CATEGORIES)), []
    for pool in pools.values():
        out += [pool.pop() for _ in range(min(quota, len(pool), n - len(out)))]
    while len(out) < n and any(pools.values()):
        for pool in pools.values():
            if pool and len(out) < n:
                out.append(pool.pop())
    return out


def label_scores(found: list[str], expected: list[str]) -> tuple[float, float]:
    """Precision and recall of labels, one inside the other counting as a match."""
    fits = lambda a, b: a.lower() in b.lower() or b.lower() in a.lower()
    precision = sum(any(fits(f, e) for e in expected) for f in found) / len(found) if found else 0.0
    recall = sum(any(fits(f, e) for f in found) for e in expected) / len(expected) if expected else 1.0
    return precision, recall


DOC_CATEGORIES = ("docs", "links")


def routed_buckets(mode: str, category: str) -> list[str]:
    """Which buckets a query of a category is sent to: one for all, by category, code first with the other as fallback, or both."""
    if mode == "single":
        return ["code"]
    if mode == "per-category":
        return ["docs" if any(d in category.lower() for d in DOC_CATEGORIES) else "code"]
    if mode in ("fallback", "both-buckets"):
        return ["code", "docs"]
    raise ValueError(f"no mode {mode!r}")
