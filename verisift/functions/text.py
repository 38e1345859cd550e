"""Column functions over text: normalising, similarity, mentions. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def let(value: Column, then) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def first_seen(values: Column, key=lambda x: x) -> Column:
    """Array values without later ones of an equal key; nulls stay apart from values."""
    return let(values, lambda v: let(F.transform(v, key), lambda keys: F.filter(v, lambda x, i: F.array_position(keys, key(x)) == i + 1)))


def record_name(name: Column) -> Column:
    """Lower case without blanks, hyphens and underscores."""
    return F.regexp_replace(F.lower(name), r"[\s\-_]+", "")


def claim_name(name: Column) -> Column:
    """Like record_name, but the names of the own method all become `ours`."""
    low = F.lower(F.trim(name))
    return F.when(low.isin(*fixed.OWN_METHOD_NAMES), F.lit("ours")).otherwise(F.regexp_replace(low, r"[\s\-_]+", ""))


def similarity(a: Column, b: Column) -> Column:
    """V1: 1 - edit distance / longer length; two empty names 1, one empty name 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when(F.least(F.length(a), F.length(b)) == 0, 0.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def clean_cell(cell: Column) -> Column:
    """T5: blanks collapsed, LaTeX bold marks and closing braces removed."""
    return F.trim(F.replace(F.replace(F.replace(F.trim(F.regexp_replace(cell, r"\s+", " ")), F.lit("\\textbf{"), F.lit("")), F.lit("}"), F.lit("")), F.lit("\\bf "), F.lit("")))


def cell_number(cell: Column) -> Column:
    """(value, unit) of the first number after bold marks, +- parts and brackets are gone; null value if there is none."""
    t = F.regexp_replace(F.trim(cell), r"[*]|\\textbf|\\mathbf|\\bf\b", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[±]\s*\d+\.?\d*", ""), r"\([^)]*\)", "")
    return F.struct(F.nullif(F.regexp_extract(t, fixed.TABLE_NUMBER, 1), F.lit("")).cast("double").alias("value"), F.regexp_extract(t, fixed.TABLE_NUMBER, 2).alias("unit"))


def sentences(text: Column) -> Column:
    """Parts of steps and lists, then sentences before capitals, of more than 15 characters."""
    chunks = F.filter(F.transform(F.split(text, fixed.STEP_SPLIT), F.trim), lambda c: c != "")
    parts = F.flatten(F.transform(chunks, lambda c: F.transform(F.split(c, r"(?<=[.!?])\s+(?=[A-Z])"), F.trim)))
    return F.filter(parts, lambda p: F.length(p) > 15)


def is_meta(sentence: Column) -> Column:
    """C4: a sentence about the answer itself."""
    return F.trim(sentence).rlike(fixed.META_SENTENCE)


def numbers(text: Column) -> Column:
    """(raw, value, unit, is_percentage), one per value, the first kept."""
    raw, value, unit = (all_matches(text, fixed.NUMBER_WITH_UNIT, g) for g in (0, 1, 2))
    each = F.transform(F.arrays_zip(raw.alias("r"), value.alias("v"), unit.alias("u")), lambda x: F.struct(F.trim(x["r"]).alias("raw"), x["v"].cast("double").alias("value"), x["u"].alias("unit"), x["u"].isin("%", "‰").alias("is_percentage")))
    return first_seen(each, lambda x: x["value"])


def _any_of(names) -> str:
    return r"\b(" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")\b"


def metrics(text: Column) -> Column:
    """Long names in any case, then short names as written; one per lower-case name."""
    return first_seen(F.concat(all_matches(text, "(?i)" + _any_of(fixed.LONG_METRICS), 1), all_matches(text, _any_of(fixed.SHORT_METRICS), 1)), F.lower)


def entities(text: Column, without: Column | None = None) -> Column:
    """(name, normalized) by four patterns in turn; no stop words, no metrics in `without`; one per normalised name."""
    names = F.transform(F.concat(*[all_matches(text, p, 1) for p in fixed.ENTITY_PATTERNS]), lambda n: F.struct(F.trim(n).alias("name"), claim_name(n).alias("normalized")))
    names = F.filter(names, lambda x: (F.length(x["name"]) >= 2) & ~x["normalized"].isin(*fixed.ENTITY_STOPWORDS))
    if without is not None:
        other = F.transform(without, record_name)
        names = F.filter(names, lambda x: ~F.array_contains(other, x["normalized"]))
    return first_seen(names, lambda x: x["normalized"])


def direction(word: Column) -> Column:
    """C11."""
    return F.when(F.lower(word).isin("higher", "better", "superior"), "gt").otherwise("lt")


def operator_relation(op: Column, signs_as_strict: bool = True) -> Column:
    """> and <, with = the wide ones. signs_as_strict keeps the old reading in which both wide signs mean `lt`."""
    plain = F.when(op.contains(">"), F.when(op.contains("="), "gte").otherwise("gt")).otherwise(F.when(op.contains("="), "lte").otherwise("lt"))
    return plain if signs_as_strict else F.when(op.startswith("≥"), "gte").when(op.startswith("≤"), "lte").otherwise(plain)


def comparisons(text: Column, first_metric: Column, signs_as_strict: bool = True) -> Column:
    """(entity_a, entity_b, relation, metric) of four families, in their order."""

    def family(pattern: str, a: int, b: int, how: int | None, relation) -> Column:
        cols = [all_matches(text, pattern, a).alias("a"), all_matches(text, pattern, b).alias("b"), all_matches(text, pattern, how or 0).alias("d")]
        return F.transform(F.arrays_zip(*cols), lambda x: F.struct(F.trim(x["a"]).alias("entity_a"), F.trim(x["b"]).alias("entity_b"), relation(x["d"]).alias("relation"), first_metric.alias("metric")))

    return F.concat(
        family(fixed.OUTPERFORM, 1, 2, None, lambda d: F.lit("gt")),
        family(fixed.ACHIEVES_THAN, 1, 3, 2, direction),
        family(fixed.OPERATOR, 1, 3, 2, lambda d: operator_relation(d, signs_as_strict)),
        family(fixed.COMPARED_TO, 2, 1, 3, direction),
    )


def trend(text: Column) -> Column:
    """The first family that the sentence shows, or null: (entity, direction, condition, raw_text)."""
    kind = F.coalesce(*[F.when(text.rlike(p), F.lit(d)) for d, p in fixed.TRENDS])
    who = F.coalesce(F.get(entities(text), 0)["name"], F.lit(""))
    return F.when(kind.isNotNull(), F.struct(who.alias("entity"), kind.alias("direction"), F.regexp_extract(text, fixed.TREND_CONDITION, 1).alias("condition"), F.left(text, F.lit(100)).alias("raw_text")))


def word_set(text: Column, shortest: int = 1) -> Column:
    """Distinct lower-case words (letters, digits, underscore of any script) of at least `shortest` characters."""
    return F.array_distinct(F.filter(all_matches(F.lower(text), r"(?U)\w+"), lambda w: F.length(w) >= shortest))


def set_f1(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when(both == 0, 0.0).otherwise(2.0 * both / (F.size(a) + F.size(b)))


def number_strings(text: Column) -> Column:
    return F.array_distinct(all_matches(text, r"\d+\.?\d*"))


def safe_key(key: Column) -> Column:
    """Letters, digits, - _ . stay, others become _; 160 characters; `unknown` if nothing is left."""
    return F.coalesce(F.nullif(F.left(F.regexp_replace(key, r"[^A-Za-z0-9\-_.]", "_"), F.lit(160)), F.lit("")), F.lit("unknown"))


def label_of(word: Column) -> Column:
    """Support-like 0, contradict- or refute-like 2, else 1."""
    w = F.upper(F.trim(word))
    return F.when(w.rlike("^(SUPPORT|ENTAIL)"), 0).when(w.rlike("^(CONTRADICT|REFUTE)"), 2).otherwise(1)


def hashed_rank(key: Column, salt: str) -> Column:
    """A number from the key and a salt that any SQL engine gives alike: stands for seeded shuffling."""
    return F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(salt))), 1, 8), 16, 10).cast("long")
