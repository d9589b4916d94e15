"""Personal data, and terms that reveal whom it belongs to, with DataFrame functions only.

Base kinds are found by patterns. Which words of a document disclose an entity
in it is estimated from the corpus: a word's pointwise mutual information with
the entity, as a share of the entity's own information, over all distinct texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finloom.session import materialise

#: The base patterns, written so that no start inside a tried run is tried again; the result is the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
BASE_KINDS = tuple(PATTERNS)
WORD = r"[^\x20\x09-\x0D]++"
#: A text in pieces of some whole words each, nothing left out; places are added up over pieces first, then within each.
PIECE = r"[\x20\x09-\x0D]*+(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+){1,32}+"
_NO_SPANS = "CAST(array() AS array<struct<start:bigint,end:bigint,value:string>>)"


def _matches(text: Column, pattern: str) -> Column:
    """Every match with its place in code points: the gaps that splitting leaves and the matches alternate."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lengths = F.zip_with(gaps, found, lambda g, m: F.struct(F.char_length(g).cast("long").alias("gap"), m.alias("m")))
    lengths = F.filter(lengths, lambda x: x.m.isNotNull())
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr(_NO_SPANS).alias("out"))

    def step(a, x):
        begin = a["at"] + x["gap"]
        end = begin + F.char_length(x["m"]).cast("long")
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("value")))).alias("out"))

    placed = F.aggregate(lengths, start, step, lambda a: a["out"])
    return F.when(F.size(found) > 0, placed).otherwise(F.expr(_NO_SPANS))


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, r"[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array of (start, kind_no, kind, end, value) of all base kinds, by start and then by kind."""

    def of_kind(number: int, kind: str) -> Column:
        kept = F.filter(_matches(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        return F.transform(
            kept,
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")
            ),
        )

    parts = [of_kind(number, kind) for number, kind in enumerate(BASE_KINDS)]
    return F.array_sort(F.concat(*parts))


def _plain(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"[.,;:!?]+$", ""))


def _words(near: DataFrame) -> DataFrame:
    """(_key, word, places) of every word of the texts of ``near`` that no base span touches; places are (start, end) of the whole word."""
    pieces = near.select("_key", "_base", F.explode(_matches(F.col("_text"), PIECE)).alias("p"))
    words = pieces.select("_key", "_base", F.col("p.start").alias("at"), F.explode(_matches(F.col("p.value"), WORD)).alias("w"))
    words = words.select("_key", "_base", _plain(F.col("w.value")).alias("word"), (F.col("at") + F.col("w.start")).alias("start"), (F.col("at") + F.col("w.end")).alias("end"))
    words = words.where("word <> '' AND NOT exists(_base, b -> b.start < end AND b.end > start)")
    return words.groupBy("_key", "word").agg(F.collect_list(F.struct("start", "end")).alias("places"))


def find_pii(df: DataFrame, text: str = "text", share: float = 0.8) -> DataFrame:
    """``df`` with ``spans``: array of (start, kind_no, kind, end, value), base kinds and ``term``.

    A word is a ``term`` span wherever it stands whole in a text with an entity
    of which it reveals at least ``share`` of the information:
    log((n(word, entity) + n(entity) / N) N / ((n(word) + 1) n(entity))) >=
    share * log(N / n(entity)). All four numbers count distinct texts. The
    estimate is smoothed as if one more text, drawn at random, had the word; so
    entities and words of a single text count too, once the corpus is large
    enough to call a word rare. Null text is empty and has no spans; equal texts
    get equal spans; a column named ``spans`` is replaced; no rows give no rows.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = df.drop("spans").withColumn("_key", F.xxhash64(body))
    texts = keyed.select("_key", body.alias("_text")).dropDuplicates(["_key"])
    near = materialise(texts.withColumn("_base", base_spans(F.col("_text"))).where(F.size("_base") > 0), "pii-near")
    of_word = F.explode(F.array_distinct(F.transform(F.split("_text", r"[\x20\x09-\x0D]+"), _plain)))
    counts = texts.select(of_word.alias("word")).groupBy("word").agg(F.count("*").alias("n_word"))
    total = texts.agg(F.count("*").alias("n"))
    held = near.select("_key", F.explode(F.array_distinct(F.transform("_base", lambda b: F.concat_ws(":", b["kind"], b["value"])))).alias("entity"))
    entities = held.groupBy("entity").agg(F.count("*").alias("n_entity"))
    most = F.broadcast(total.crossJoin(entities.agg(F.max("n_entity").alias("most"))))
    # no more texts than have the word or the entity can have both: words too frequent for any entity, or for this one, drop out before pairs form
    rare = _words(near).join(counts, "word").crossJoin(most).where(f"n_word + 1 <= (n + 1) * pow(most / n, {share}) * 1.000001")
    pairs = rare.join(held.join(entities, "entity"), "_key").where(f"n_word + 1 <= (n + 1) * pow(n_entity / n, {share}) * 1.000001 AND n > n_entity")
    pairs = materialise(pairs.select("_key", "entity", "word", "places", "n_word", "n_entity", "n"), "pii-pairs")
    told = pairs.groupBy("entity", "word", "n_word", "n_entity", "n").agg(F.count("*").alias("n_both"))
    told = told.where(f"ln((n_both + n_entity / n) * n / ((n_word + 1) * n_entity)) >= {share} * ln(n / n_entity)").select("entity", "word")
    places = pairs.join(told, ["entity", "word"], "left_semi").select("_key", F.explode("places").alias("p"))
    terms = places.groupBy("_key").agg(
        F.collect_set(F.struct("p.start", F.lit(len(BASE_KINDS)).alias("kind_no"), F.lit("term").alias("kind"), "p.end", F.lit("").alias("value"))).alias("_terms")
    )
    spans = F.when(F.col("_terms").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", "_terms")))
    spans = near.select("_key", "_base").join(terms, "_key", "left").select("_key", spans.alias("spans"))
    none = F.lit(None).cast(spans.schema["spans"].dataType)
    out = keyed.join(spans, "_key", "left").drop("_key")
    return out.withColumn("spans", F.coalesce("spans", F.filter(F.array(F.element_at(none, 1)), lambda s: F.lit(False))))


def sanitise(df: DataFrame, text: str = "text") -> DataFrame:
    """``text`` with base spans generalised to ``[kind]`` and terms removed; of spans that overlap the first one stands. Null stays null."""
    t = f"`{text}`"
    masked = F.expr(
        f"aggregate(spans, named_struct('out', '', 'at', 0L), (a, s) -> CASE WHEN s.start >= a.at THEN named_struct('out',"
        f" concat(a.out, substr({t}, int(a.at + 1), int(s.start - a.at)), if(s.kind = 'term', '', concat('[', s.kind, ']'))), 'at', s.end)"
        f" ELSE named_struct('out', a.out, 'at', greatest(a.at, s.end)) END, a -> concat(a.out, substr({t}, int(a.at + 1))))"
    )
    return df.withColumn(text, F.when(F.size("spans") > 0, masked).otherwise(F.col(t)))
