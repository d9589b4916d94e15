"""LIKE with sets against a plain matcher, and the index against all pairs."""

import random
import re

import builders as b
import pytest
from pyspark.sql import functions as F

from finloom.functions import patterns as P
from finloom.operators import allocate


def plain(pattern):
    """Regular expression of a pattern, written down character by character; None matches nothing."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                return None
            out += re.escape(pattern[i + 1])
            i += 2
        elif c == "[":
            j, members = i + 1, []
            while j < len(pattern) and pattern[j] != "]":
                members.append(pattern[j + 1] if pattern[j] == "\\" and j + 1 < len(pattern) else pattern[j])
                escaped = pattern[j] == "\\"
                members[-1] = (members[-1], escaped)
                j += 2 if escaped else 1
            if j >= len(pattern):
                return None
            negated = bool(members) and members[0] == ("^", False)
            members, k, chosen = members[1:] if negated else members, 0, set()
            if not members:
                return None
            while k < len(members):
                if k + 2 < len(members) and members[k + 1] == ("-", False):
                    chosen |= {chr(x) for x in range(ord(members[k][0]), ord(members[k + 2][0]) + 1)}
                    k += 3
                else:
                    chosen.add(members[k][0])
                    k += 1
            if not chosen and not negated:
                return None
            body = "".join(map(re.escape, sorted(chosen)))
            out += r"[\s\S]" if not chosen else f"[^{body}]" if negated else f"[{body}]"
            i = j + 1
        else:
            out += {"%": r"[\s\S]*", "_": r"[\s\S]"}.get(c, re.escape(c))
            i += 1
    return re.compile(out)


TEXTS = ["", "a", "b", "abc", "axc", "a%c", "a_c", "a[c", "a]c", "a-c", "a^c", "GL010", "GL104", "R1-N2-S3", "R1-N2-S31", "x\ny", "É1", "\\", "a\\b", "...", "S10", "10"]
PATTERNS = ["", "%", "%%", "_", "___", "%x%", "%x", "a%", "a_c", "a[a-x]c", "a[^a-x]c", "a[%]c", r"a\%c", r"a\_c", "a[[]c", "a]c", "a[-]c", "a[b-]c", "a[^^]c", "a[x^]c", "[a-c]%",
            "%[0-4]", "%[^0-4]", "_%", "%_%", "[^x]%", "[a", "a[c", "a[]c", "a\\", r"\\", r"a[\]]c", "[z-a]", "[^z-a]", "GL[0-1]_[04]", "%-S3", "%S3%", "R_-%-S[1-3]_", "É%", "x_y", ".%", "...", "[.]%",
            "%[É]%", "nowhere%", "S%[1-3]0", None]


@pytest.fixture(scope="module")
def pairs(spark):
    both = spark.createDataFrame([(p, t) for p in PATTERNS for t in [*TEXTS, None]], "pattern string, text string")
    return {(r[0], r[1]): r[2] for r in both.select("pattern", "text", P.like("text", "pattern")).collect()}


@pytest.mark.parametrize("pattern", [p for p in PATTERNS if p is not None])
def test_like(pairs, pattern):
    rule = plain(pattern)
    assert {t for t in TEXTS if pairs[pattern, t]} == {t for t in TEXTS if rule is not None and rule.fullmatch(t)}
    assert pairs[pattern, None] is None


def test_null_pattern(pairs, spark):
    assert {pairs[None, t] for t in [*TEXTS, None]} == {None}
    flags = spark.createDataFrame([(p,) for p in PATTERNS], "p string").select("p", P.matches_all("p")).collect()
    assert {p for p, flag in flags if flag} == {None, "%", "%%"}


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def test_index_finds_all_pairs(spark):
    patterns = spark.createDataFrame([(p,) for p in PATTERNS + PATTERNS], "pattern string")
    got = b.collect(P.pattern_pairs(patterns, frame(spark, [*TEXTS, None, "abc"])), "id", "pattern")
    texts = [*TEXTS, None, "abc"]
    rules = {p: plain(p) for p in PATTERNS if p is not None}
    assert got == sorted((i, p) for i, t in enumerate(texts) for p, rule in rules.items() if t is not None and rule is not None and rule.fullmatch(t))


def test_random_patterns(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab1-", k=rng.randrange(9))) for _ in range(150)]
    parts = ["%", "_", "[ab]", "[^a]", "[1-]", "a", "b", "ab", "1", "-", "ba1"]
    patterns = sorted({"".join(rng.choices(parts, k=rng.randrange(1, 6))) for _ in range(150)})
    got = b.collect(P.pattern_pairs(spark.createDataFrame([(p,) for p in patterns], "pattern string"), frame(spark, texts)), "id", "pattern")
    assert got == sorted((i, p) for i, t in enumerate(texts) for p in patterns if plain(p).fullmatch(t))


def test_ten_thousand_leading_wildcards_share_no_key(spark):
    """Each pattern is found under a piece of its own number; no key holds more than a small part of the patterns or texts."""
    texts = frame(spark, [f"R{i % 5}-N{i % 25}-S{i:05d}" for i in range(10000)])
    patterns = spark.range(10000).selectExpr("concat('%S', lpad(id, 5, '0')) AS pattern")
    keys = P.lookup_keys(patterns)
    assert keys.groupBy("key").count().agg(F.max("count")).first()[0] <= 100
    found = P.pattern_pairs(patterns, texts)
    assert found.count() == 10000 == found.filter("pattern = concat('%S', lpad(id, 5, '0'))").count()
    (bare,) = [P.lookup_keys(spark.createDataFrame([("%_%",), ("[^x]%",)], "pattern string")).groupBy("key").count().collect()]
    assert len(bare) == P.SPREAD and {r["count"] for r in bare} == {2}


def test_rules_with_sets(spark):
    centres = b.cost_centers(spark, [{"cost_center_id": i, "parent_id": None, "code": c} for i, c in enumerate(["R1-A", "R2-B", "R3-C", "X_1"], 1)])
    rules = b.rules(spark, [{"rule_id": 1, "cc_pattern": "R[1-2]-%"}, {"rule_id": 2, "cc_pattern": "%[^A]"}, {"rule_id": 3, "cc_pattern": None}, {"rule_id": 4, "cc_pattern": "%%"}])
    got = allocate.pattern_matches(rules, "cc_pattern", centres, "cost_center_id", "code")
    assert b.collect(got) == [(1, 1), (1, 2), (2, 2), (2, 3), (2, 4), (3, 1), (3, 2), (3, 3), (3, 4), (4, 1), (4, 2), (4, 3), (4, 4)]
