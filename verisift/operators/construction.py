"""Data sets for training and evaluation: draws, waterfalls, covered evaluation sets, class mixes."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import hashed_rank
from .sampling import NUMBER_ALONE, mispair, numbered, perturb_numbers, sample_exact, sample_passing, with_first


def sample_with_replacement(df: DataFrame, key: str, k: int, salt: str = "42", replace: bool | None = None) -> DataFrame:
    """S3: k draws. With replacement draw i takes the row at the place of i's hash, without it rows are the first k of the hashed
    order, at most all. replace None: only if k exceeds the rows, as in the original."""
    rows, total = numbered(df, key, salt)
    if replace is False or (replace is None and k <= total):
        return rows.where(F.col("place") < k).withColumn("draw", F.col("place")).drop("place")
    draws = df.sparkSession.range(k).select(F.col("id").alias("draw"), (hashed_rank(F.col("id"), salt) % F.lit(max(total, 1))).alias("place"))
    return rows.join(draws, "place").drop("place")


def priority_sample(df: DataFrame, kind: str, key: str, n: int, priority=fixed.TYPE_PRIORITY, least: int = 500, salt: str = "42") -> DataFrame:
    """All rows if there are at most n; else per kind in turn min(rows, max(a third of what is missing, `least`)), the rest
    from all leftovers in hashed order; at most n rows. Only the counts of the named kinds come to the driver; a kind may be a
    third of all rows, as rows are ranked by hash interval."""
    named = F.when(F.col(kind).isin(*priority), F.col(kind))
    sizes = {r["k"]: r["n"] for r in df.groupBy(named.alias("k")).agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) <= n:
        return df
    quotas, missing = {}, n
    for k in priority:
        take = min(sizes.get(k, 0), max(missing // 3, least), missing)
        if take > 0:
            quotas[k] = take
            missing -= take
    if not quotas:
        return sample_exact(df, key, n, salt)
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    taken = with_first(df.where(F.col(kind).isin(*quotas)), [kind], key, salt, lambda _, __: quota[F.col(kind)])
    left = taken.where("not _first").drop("_first").unionByName(df.where(F.col(kind).isNull() | ~F.col(kind).isin(*quotas)))
    chosen = taken.where("_first").drop("_first")
    return chosen.unionByName(sample_exact(left, key, missing, salt)) if missing else chosen


def coverage_set(df: DataFrame, key: str, label: str, ratio: str, per_class: int = 12, per_level: int = 4, extra: int = 24, levels=fixed.LEVELS) -> DataFrame:
    """Keys of at least `per_class` rows of each class, `per_level` contradicting rows of each level and `extra` others."""
    percent = F.bround(F.col(ratio) * 100).cast("int")
    rows = df.select(key, label, percent.alias("_level"))
    first = lambda some, by, n: with_first(some, [by], key, "42", lambda _, __: F.lit(n), alone=True).where("_first")
    a = first(rows.where(F.col(label).isin(0, 1, 2)), label, per_class)
    b = first(rows.where((F.col(label) == 2) & F.col("_level").isin(*[round(x * 100) for x in levels])), "_level", per_level)
    sure = a.select(key).union(b.select(key)).distinct()
    return sure.union(sample_exact(rows.select(key).join(sure, key, "left_anti"), key, extra))


def seed_rows(df: DataFrame, key: str, text: str, levels: int = len(fixed.LEVELS), per_level: int = 4) -> DataFrame:
    """Rows with a digit, the first max(levels * per_level, 12) in hashed order."""
    return sample_exact(df.where(F.col(text).rlike(r"\d")), key, max(levels * per_level, 12))


def level_counts(n: int, shares: dict[float, float]) -> dict[float, int]:
    """int(n * share) rows per level."""
    return {level: int(n * share) for level, share in shares.items()}


def class_counts(total: int, shares: tuple[float, float, float]) -> tuple[int, int, int]:
    """Rounded rows per class; the last class takes what is left."""
    first, second = round(total * shares[0]), round(total * shares[1])
    return first, second, max(0, total - first - second)


def level_reserve(levels, train: float, least: int) -> dict[float, int]:
    """Rows that each level needs so that its validation part holds `least`: ceil(least / (1 - train)) + 4."""
    return {level: math.ceil(round(least / (1 - train), 9)) + 4 for level in levels}


def level_plan(contradicts: int, levels, train: float, least: int) -> dict[float, int]:
    """The reserve of each level, topped up in turn to the class's rows. Raises if the reserves alone need more."""
    plan = level_reserve(levels, train, least)
    missing = contradicts - sum(plan.values())
    if missing < 0:
        raise ValueError(f"{contradicts} rows can't hold the reserves {plan}")
    each, over = divmod(missing, len(plan))
    return {level: n + each + (i < over) for i, (level, n) in enumerate(plan.items())}


def class_mix(df: DataFrame, key: str, text: str, entails: int, neutral: int, contradicts: dict[float, int]) -> DataFrame:
    """(key, text, label, ratio, place): rows as they are, rows with another row's text, and rows with changed numbers per
    level, permuted: `place` is their order by a hash.

    Each part draws by its own salt and is written once, so that texts are changed for few rows and read once a part. A part that
    can't be filled raises, as a short class would pass unseen."""
    one = df.select(key, text)
    drawn = lambda n, salt, passing=lambda rows: rows.where(F.col(text).isNotNull()): sample_passing(one, key, n, passing, salt)
    parts = [drawn(entails, "entails").select(key, text, F.lit(0).alias("label"), F.lit(0.0).alias("ratio"))]
    other = mispair(drawn(max(neutral, 2), "neutral"), key, text, "pair").select(key, F.col(f"other_{text}").alias(text))
    parts.append(sample_exact(other, key, neutral, "neutral").select(key, text, F.lit(1).alias("label"), F.lit(0.0).alias("ratio")))
    for r, n in contradicts.items():
        new = lambda rows, r=r: rows.where(F.col(text).rlike(NUMBER_ALONE)).withColumn("_new", perturb_numbers(F.col(text), r, f"level{r}")).where(F.col("_new") != F.col(text))
        parts.append(drawn(n, f"level{r}", new).select(key, F.col("_new").alias(text), F.lit(2).alias("label"), F.lit(float(r)).alias("ratio")))
    out = reduce(DataFrame.unionByName, parts)
    want = {(0, 0.0): entails, (1, 0.0): neutral} | {(2, float(r)): n for r, n in contradicts.items()}
    got = {(x["label"], x["ratio"]): x["n"] for x in out.groupBy("label", "ratio").agg(F.count("*").alias("n")).collect()}
    short = {k: (n, got.get(k, 0)) for k, n in want.items() if got.get(k, 0) < n}
    if short:
        raise ValueError(f"too few rows for (label, ratio): (wanted, found) {short}")
    named = out.withColumn("_k", F.concat_ws("#", F.col(key).cast("string"), F.col("label").cast("string"), F.col("ratio").cast("string")))
    return numbered(named, "_k", "permute")[0].drop("_k")


#: Sentences of synthetic rows; their wording is our own.
TEMPLATES = ("Model {i} reaches an accuracy of {v}%.", "The loss of run {i} falls to {v}.", "System {i} needs {v} ms per step.", "Method {i} scores {v} on the test set.", "Variant {i} improves recall by {v} points.")


def synthetic_rows(df: DataFrame, key: str, width: int = 8) -> DataFrame:
    """A row (id, text, label, features) for each row of df, drawn from its key alone: five templates in turn with hashed values,
    and features around the class's centre. Rows without a key give none; repeated keys repeat their row."""
    h = lambda salt: hashed_rank(F.col("id"), salt)
    value = ((h("value") % 1000) / 10.0).cast("string")
    text = F.array(*[F.replace(F.replace(F.lit(t), F.lit("{i}"), F.col("id").cast("string")), F.lit("{v}"), value) for t in TEMPLATES])
    noise = lambda i: F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit("/"), i.cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32) - 0.5
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).withColumn("label", (h("label") % 3).cast("int"))
    return rows.select("id", F.get(text, F.pmod("id", F.lit(len(TEMPLATES))).cast("int")).alias("text"), "label", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.col("label") - 1.0 + noise(i)).alias("features"))


def png_size(content: Column) -> Column:
    """IO16: (width, height) from a PNG's header; null for other files."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def shrunk(width: Column, height: Column, longest: int = 2048) -> Column:
    """IO16: the size after the longest side is cut to `longest`; smaller images stay."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.floor(width * scale)).alias("width"), F.greatest(F.lit(1), F.floor(height * scale)).alias("height"))


def image_status(files: DataFrame, most_bytes: int = 64 << 20, most_pixels: int = 80_000_000) -> DataFrame:
    """IO16: the guards of a safe image scan: path, length and a reason (`missing`, `empty`, `too_many_bytes`, `too_many_pixels`, `ok`).

    With a `content` column PNG sizes are probed; other formats have the byte guard alone."""
    n = F.col("length")
    size = png_size(F.col("content")) if "content" in files.columns else F.lit(None).cast("struct<width:long,height:long>")
    many = F.coalesce(size["width"] * size["height"] > most_pixels, F.lit(False))
    return files.select("path", "length", F.when(n.isNull(), "missing").when(n == 0, "empty").when(n > most_bytes, "too_many_bytes").when(many, "too_many_pixels").otherwise("ok").alias("reason"))
