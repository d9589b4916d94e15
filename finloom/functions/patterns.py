"""LIKE patterns held in columns: bracket sets, and matching of many patterns with many texts.

``%`` stands for any string, ``_`` for one character, ``[a-c]`` for one of a
set, ``[^a-c]`` for one outside it; a backslash takes the next character as it
is, also in a set. A set or escape that is not closed, an empty set and a
range that runs backwards match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest pieces of literals that are looked up.
GRAM = 6
#: Patterns without any literal meet the texts in this many groups.
SPREAD = 64

# SQL texts: expressions of this size are parsed faster than they are put together from columns.
_BACKSLASH = "chr(92)"
_TOKENS = r"regexp_extract_all({0}, r'(?s)\\.|\[(?:\\.|[^\]\\])*\]|.', 0)"
_MEMBERS = r"regexp_extract_all({0}, r'(?s)(?:\\.|[^\\])-(?:\\.|[^\\])|\\.|.', 0)"


def _bare(token: str) -> str:
    """The character of an escape, any other token as it is."""
    return f"if(length({token}) = 2 and substr({token}, 1, 1) = {_BACKSLASH}, substr({token}, 2, 1), {token})"


def _quoted(character: str) -> str:
    return rf"if({character} rlike r'^[\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]$', concat({_BACKSLASH}, {character}), {character})"


def _character(token: str) -> str:
    """The character a literal token stands for, null for any other token."""
    return f"if({token} in ('%', '_', '[', {_BACKSLASH}) or (length({token}) > 1 and substr({token}, 1, 1) = '['), null, {_bare(token)})"


def _set_regex(token: str) -> str:
    first = f"if(substr({token}, 2, 1) = '^', 3, 2)"
    inner = f"substr({token}, {first}, length({token}) - {first})"
    low, high = _bare(r"regexp_extract(m, r'(?s)^(\\.|[^\\])-', 1)"), _bare(r"regexp_extract(m, r'(?s)-(\\.|[^\\])$', 1)")
    of_range = f"if({low} <= {high}, concat({_quoted(low)}, '-', {_quoted(high)}), '')"
    member = rf"if(m rlike r'(?s)^(?:\\.|[^\\])-(?:\\.|[^\\])$', {of_range}, {_quoted(_bare('m'))})"
    listed = f"array_join(transform({_MEMBERS.format(inner)}, m -> {member}), '')"
    return rf"""case when {listed} <> '' then concat(if({first} = 3, '[^', '['), {listed}, ']')
                     when {first} = 3 and {inner} <> '' then r'[\s\S]' else '(?!)' end"""


def like_regex(pattern: str) -> Column:
    """The regular expression of a LIKE pattern, a column name, for whole texts."""
    part = rf"""case when t = '%' then r'[\s\S]*' when t = '_' then r'[\s\S]' when t in ('[', {_BACKSLASH}) then '(?!)'
                      when length(t) > 1 and substr(t, 1, 1) = '[' then {_set_regex("t")} else {_quoted(_bare("t"))} end"""
    return F.expr(rf"concat(r'\A', array_join(transform({_TOKENS.format(pattern)}, t -> {part}), ''), r'\z')")


def like(text: str, pattern: str) -> Column:
    """``text LIKE pattern``, both column names; null when either is null."""
    return F.rlike(F.col(text), like_regex(pattern))


def matches_all(pattern: str) -> Column:
    """Whether the pattern is null or made of ``%`` alone, so that every text matches."""
    return F.expr(f"{pattern} is null or {pattern} rlike '^%+$'")


def _longest_fragment(pattern: str) -> Column:
    """The longest run of literal characters, empty if there is none; of equally long ones the first."""
    fragments = f"split(array_join(transform({_TOKENS.format(pattern)}, t -> coalesce({_character('t')}, chr(0))), ''), chr(0))"
    return F.expr(f"reduce({fragments}, '', (best, x) -> if(length(x) > length(best), x, best))")


def _grams(text: str, size: str) -> str:
    """The pieces of ``size`` characters; none if the text is shorter."""
    return f"if(length({text}) >= {size}, transform(sequence(1, length({text}) - {size} + 1), i -> substr({text}, i, {size})), cast(array() as array<string>))"


def lookup_keys(patterns: DataFrame) -> DataFrame:
    """The columns of ``patterns``, all of them different rows, and ``key``: the keys under which a ``pattern`` meets its texts.

    A pattern with a literal has one key: of the pieces of its longest
    fragment the one that the fewest patterns hold. Without ``%`` and literals
    the key is the length. Other patterns have one key per group of texts, so
    they share no key with patterns that have a literal, and no group is as
    large as the texts.
    """
    own = patterns.columns
    named = patterns.withColumn("fragment", _longest_fragment("pattern"))
    grams = F.expr(f"array_distinct({_grams('fragment', f'least(length(fragment), {GRAM})')})")
    wanted = named.filter("fragment <> ''").select(*own, F.explode(grams).alias("gram"))
    held = wanted.groupBy("gram").agg(F.count("*").alias("patterns"))
    rarest = wanted.join(held, "gram").groupBy(*own).agg(F.min_by("gram", F.struct("patterns", "gram")).alias("gram"))
    by_gram = rarest.select(*own, F.expr("concat('g', gram)").alias("key"))
    tokens = _TOKENS.format("pattern")
    places = f"if(array_contains({tokens}, '%'), transform(sequence(0, {SPREAD - 1}), i -> concat('s', i)), array(concat('n', size({tokens}))))"
    return by_gram.unionByName(named.filter("fragment = ''").select(*own, F.explode(F.expr(places)).alias("key")))


def pattern_pairs(patterns: DataFrame, texts: DataFrame, domain: str | None = None) -> DataFrame:
    """The columns of ``texts`` with each ``pattern`` of ``patterns`` that its ``text`` matches.

    ``patterns`` has the column ``pattern``; equal patterns are looked up
    once, null ones and null texts match nothing here. With ``domain``, a
    column of both, patterns meet the texts of their own domain only. Texts
    and patterns meet by equality of keys, and the regular expression decides.
    """
    own = ["pattern"] if domain is None else [domain, "pattern"]
    keys = lookup_keys(patterns.select(*own).filter("pattern IS NOT NULL").distinct()).withColumn("regex", like_regex("pattern"))
    sizes = ", ".join(_grams("text", str(n)) for n in range(1, GRAM + 1))
    places = f"concat('n', length(text)), concat('s', pmod(xxhash64(text), {SPREAD}))"
    own_keys = F.expr(f"concat(transform(array_distinct(concat({sizes})), g -> concat('g', g)), array({places}))")
    keyed = texts.filter("text IS NOT NULL").select("*", F.explode(own_keys).alias("key"))
    found = keyed.join(keys, ["key"] if domain is None else [domain, "key"]).filter(F.rlike("text", F.col("regex")))
    return found.select(*texts.columns, "pattern")
