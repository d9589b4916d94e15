"""Secrets in texts, found by one automaton for all rules.

``find_secrets`` keeps every input row and adds ``spans``; texts that are null
count as empty and have none. Rules are checked on UTF-8 bytes, spans are in
code points with the end excluded. Repeated rows are scanned each for itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finloom.llm import automaton


@dataclass(frozen=True)
class Rule:
    """``kind`` names the rule; matches with fewer than ``least_tail`` bytes after ``head`` are dropped."""

    kind: str
    pattern: str
    any_case: bool = False
    head: str = ""
    least_tail: int = 0


_HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""

#: The base rules. Runs of fewer bytes than a {n,} asks for hold no other match, so n is in the rule itself.
BASE_RULES = (
    Rule("assign", _HEAD + r"[A-Za-z0-9+/_.=-]+", True, _HEAD, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("prefixed", r"(gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})"),
    Rule("credential_url", r"[a-z][a-z0-9+.-]*://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!$&*-]+@[A-Za-z0-9.-]+"),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _tree(pattern: str, any_case: bool) -> automaton.Node:
    tree = automaton.parse(pattern)
    return automaton.fold_case(tree) if any_case else tree


class SecretFinder:
    """All rules compiled together; one per worker and rule set."""

    _made: dict[tuple[Rule, ...], SecretFinder] = {}

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self._scanner = automaton.Scanner([_tree(r.pattern, r.any_case) for r in rules])
        self._heads = [automaton.Scanner([_tree(r.head, r.any_case)]) if r.head else None for r in rules]

    @classmethod
    def of(cls, rules: tuple[Rule, ...]) -> SecretFinder:
        if rules not in cls._made:
            cls._made[rules] = cls(rules)
        return cls._made[rules]

    def find(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then by the order of the rules."""
        if not text:
            return []
        data = text.encode()
        kept = []
        for k, start, end in self._scanner.spans(data):
            head = self._heads[k]
            if head is None or end - head.longest(0, data, start) >= self.rules[k].least_tail:
                kept.append((start, k, end))
        kept.sort()
        if len(data) != len(text):
            kept = [(len(data[:start].decode()), k, len(data[:end].decode())) for start, k, end in kept]
        return [(self.rules[k].kind, start, end) for start, k, end in kept]


def find_secrets(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "spans") -> DataFrame:
    """``df`` with ``into``: array of (kind, start, end) by start, then by rule; empty where nothing is found.

    A column that is already named ``into`` is replaced.
    """

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = SecretFinder.of(rules)
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in finder.find(t)] for t in texts])

    return df.withColumn(into, F.pandas_udf(find, SPANS)(F.col(f"`{text}`")))


def mask(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``text`` with every span written as ``[kind]``; of spans that overlap, the first one's name stands for all. Null stays null."""
    step = (
        "(a, s) -> CASE WHEN s.start >= a.at THEN named_struct('out', concat(a.out, substr(`{t}`, a.at + 1, int(s.start - a.at)), '[', s.kind, ']'), 'at', s.end)"
        " ELSE named_struct('out', a.out, 'at', greatest(a.at, s.end)) END"
    ).replace("{t}", text)
    masked = F.expr(
        f"aggregate(`{spans}`, named_struct('out', '', 'at', 0L), {step.replace('a.at + 1', 'int(a.at + 1)')},"
        f" a -> concat(a.out, substr(`{text}`, int(a.at + 1))))"
    )
    return df.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(F.col(f"`{text}`")))


def span_text(spans) -> F.Column:
    """``kind:start:end`` of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def digest(df: DataFrame, base_kinds: tuple[str, ...], spans: str = "spans") -> list[F.Column]:
    """Counts per base kind, the hash of the base spans, and all spans as text."""
    all_spans = F.col(spans)
    base = F.filter(all_spans, lambda s: s.kind.isin(*base_kinds))

    def count(kind: str) -> F.Column:  # a default argument of the lambda would be taken for the element's index
        return F.size(F.filter(all_spans, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in base_kinds]
    return [*counts, F.sha2(span_text(base), 256).alias("base_sha256"), span_text(all_spans).alias("spans")]


def sha256_of(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
