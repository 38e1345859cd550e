"""Sampling, splitting and windows. Seeded shuffles are an order by a salted hash, the same in every engine."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import fixed_values as fixed
from ..functions.text import hashed_rank, let
from ..sources.shared import kept


def rank_within(df: DataFrame, group: list[str], key: str, salt: str = "42") -> DataFrame:
    """`rank` from 1 in the hashed order of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(hashed_rank(F.col(key), salt), key)))


def sample_exact(df: DataFrame, key: str, k: int, salt: str = "42") -> DataFrame:
    """The first k rows of the hashed order; a top-k, so no global sort."""
    return df.orderBy(hashed_rank(F.col(key), salt), key).limit(k)


#: For each row that is wanted, how many are tested at first; and how much wider each further look is.
LOOKS, WIDER = 64, 16


def sample_passing(df: DataFrame, key: str, k: int, passing, salt: str = "42") -> DataFrame:
    """The first k rows, in hashed order, of passing(df), a costly test that drops or changes each row for itself and leaves its key.

    Rows below a bound of the hash are tested; while too few of them pass, the bound rises and the rows up to it are tested, at last
    all of them, each once. What is found is written once."""
    low, bound, h = 0, max(1, (1 << 32) * LOOKS * k // max(df.count(), 1)), F.coalesce(hashed_rank(F.col(key), salt), F.lit(0))
    found = None
    while True:
        more = kept(sample_exact(passing(df.where((h >= low) & (h < bound))), key, k, salt), "sample")
        found = more if found is None else found.unionByName(more)
        if bound >= 1 << 32:
            return found
        k -= more.count()
        if k <= 0:
            return found
        low, bound = bound, bound * WIDER


#: The hash range falls into 2 ** INTERVAL_BITS equal intervals: so many counts are what numbering and splitting work with.
INTERVAL_BITS = 14


def _interval(h):
    return F.shiftright(h, 32 - INTERVAL_BITS).cast("int")


def _placed(df: DataFrame, key: str, salt: str) -> DataFrame:
    return df.withColumn("_h", F.coalesce(hashed_rank(F.col(key), salt), F.lit(0))).withColumn("_b", _interval(F.col("_h")))


def numbered(df: DataFrame, key: str, salt: str = "42") -> tuple[DataFrame, int]:
    """(df with `place` from 0 in the hashed order, number of rows). Intervals of the hash are fixed, so counts and places that
    are worked out in different jobs agree; the rows before an interval are a running sum over at most 2 ** INTERVAL_BITS counts."""
    at = _placed(df, key, salt)
    sizes = at.groupBy("_b").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n")).first()[0] or 0
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("_b", before.alias("_base"))
    within = at.withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    return within.join(F.broadcast(base), "_b").withColumn("place", (F.col("_base") + F.col("_i") - 1).cast("long")).drop("_h", "_b", "_i", "_base"), total


def with_first(df: DataFrame, strata: list[str], key: str, salt: str, wanted, beside=None, alone: bool = False) -> DataFrame:
    """df with `_first`: the row is among the first `wanted` of its stratum in hashed order. alone: only such rows, and few others.

    wanted(n, b) gives the number from the stratum's rows and the largest value of the column `beside` in it. A stratum may be a
    third of all rows: counts per stratum and hash interval tell in which interval its last wanted row lies, and rows are ranked
    by interval, which only matters in that one."""
    at = _placed(df.select(key, *strata, (F.lit(0) if beside is None else beside).cast("long").alias("_beside")), key, salt)
    sizes = at.groupBy(*strata, "_b").agg(F.count("*").alias("_n"), F.max("_beside").alias("_beside"))
    whole = Window.partitionBy(*strata)
    n = F.sum("_n").over(whole)
    want = F.least(n, wanted(n, F.max("_beside").over(whole)))
    before = F.coalesce(F.sum("_n").over(whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = sizes.select(*strata, "_b", before.alias("_before"), want.alias("_want"), "_n").where("_before < _want and _before + _n >= _want")
    bounds = cut.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col("_b").alias("_cut"), (F.col("_want") - F.col("_before")).alias("_left"))
    on = None
    for i, s in enumerate(strata):
        on = F.col(s).eqNullSafe(F.col(f"_s{i}")) if on is None else on & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    placed = _placed(df, key, salt).join(bounds, on, "left")
    placed = placed.where("_b <= _cut") if alone else placed
    ranked = placed.withColumn("_i", F.row_number().over(Window.partitionBy(*strata, F.when(F.col("_b") == F.col("_cut"), F.lit(-1)).otherwise(F.col("_b"))).orderBy("_h", key)))
    first = (F.col("_b") < F.col("_cut")) | ((F.col("_b") == F.col("_cut")) & (F.col("_i") <= F.col("_left")))
    return ranked.withColumn("_first", F.coalesce(first, F.lit(False))).select(*df.columns, "_first")


def quota_sample(df: DataFrame, group: str, quotas: dict, key: str, salt: str = "42") -> DataFrame:
    """Up to the quota of each group, in hashed order; groups without a quota give none."""
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    return with_first(df.where(F.col(group).isin(*quotas)), [group], key, salt, lambda n, _: quota[F.col(group)], alone=True).where("_first").drop("_first")


def split_train_val(df: DataFrame, key: str, share: float = 0.005, salt: str = "42") -> DataFrame:
    """`val` for the first max(int(n * share), 1) rows of the hashed order. Counts of hash intervals tell in which one the last of
    them lies, and only that interval is ranked."""
    at = _placed(df.select(key), key, salt)
    sizes = at.groupBy("_b").agg(F.count("*").alias("n")).orderBy("_b").collect()  # at most 2 ** INTERVAL_BITS rows
    k, seen = max(int(sum(r["n"] for r in sizes) * share), 1), 0
    for r in sizes:
        if seen + r["n"] >= k:
            break
        seen += r["n"]
    else:
        return df.withColumn("split", F.lit("train"))
    top = at.where(F.col("_b") == r["_b"]).select("_h", F.col(key).alias("k")).orderBy("_h", "k").limit(k - seen).agg(F.max(F.struct("_h", "k")).alias("last")).first()["last"]
    h = F.coalesce(hashed_rank(F.col(key), salt), F.lit(0))
    return df.withColumn("split", F.when((h < top["_h"]) | ((h == top["_h"]) & F.coalesce(F.col(key) <= top["k"], F.lit(True))), "val").otherwise("train"))


def stratified_split(df: DataFrame, strata: list[str], key: str, train: float = 0.9, salt: str = "42", least=None) -> DataFrame:
    """Per stratum max(1, half-even round of n * (1 - train), least) rows for validation, n - 1 at most but one.

    least: a column of the strata's, the fewest validation rows (for changed rows, say)."""
    wanted = lambda n, least: F.greatest(F.lit(1), F.least(F.greatest(F.bround(n * (1 - train)).cast("long"), least), F.greatest(F.lit(1), n - 1)))
    rows = with_first(df, strata, key, salt, wanted, least)
    return rows.withColumn("split", F.when(F.col("_first"), "val").otherwise("train")).drop("_first")


def oversample(df: DataFrame, label: str, key: str, factors: dict | None = None) -> DataFrame:
    """Every class repeated to the size of the largest one, times its factor (at least 1): all its n rows wanted / n times,
    and the first wanted % n in hashed order once more. Rows without a label are left out."""
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    factor = F.lit(1.0)
    for k, f in (factors or {}).items():
        factor = F.when(F.col(label) == k, float(max(1.0, f))).otherwise(factor)
    copies = F.floor(F.lit(most) * factor)
    rows = with_first(df.where(F.col(label).isNotNull()), [label], key, "42", lambda n, _: copies % n).join(sizes, label)
    times = (F.floor(copies / F.col("n")) + F.col("_first").cast("int")).cast("int")
    return rows.where(times >= 1).withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("_first", "n")


def mispair(df: DataFrame, key: str, keep: str, salt: str = "42") -> DataFrame:
    """Each row with the `keep` value of the next row in hashed order, the last with that of the first. Never its own for n > 1."""
    rows, total = numbered(df, key, salt)
    other = rows.select(((F.col("place") + total - 1) % F.lit(max(total, 1))).alias("place"), F.col(keep).alias(f"other_{keep}"), F.col(key).alias(f"other_{key}"))
    return rows.join(other, "place").drop("place")


def normalise_groups(df: DataFrame, group: str, value: str, clip: float | None = 2.0, sample: bool = False) -> DataFrame:
    """W1 (population deviation, clipped) and W2 (sample deviation, clip None): `norm` per candidate group."""
    w = Window.partitionBy(group)
    centred, std = F.col(value) - F.avg(value).over(w), (F.stddev_samp if sample else F.stddev_pop)(value).over(w)
    scaled = centred / (std + 1e-6)
    scaled = scaled if clip is None else F.greatest(F.lit(-clip), F.least(F.lit(clip), scaled))
    return df.withColumn("norm", F.when(F.coalesce(std, F.lit(0.0)) < 1e-6, centred).otherwise(scaled))


def best_of_group(df: DataFrame, group: str, score: str, order: str) -> DataFrame:
    """The highest score of each group, the first on ties."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), order))).where("_r = 1").drop("_r")


#: Steps of a run that are taken together.
BLOCK = 1 << 14


def running_baseline(df: DataFrame, run: str, step: str, value: str, decay: float = fixed.EMA_DECAY, block: int = BLOCK) -> DataFrame:
    """Exponential moving average from 0 over each run's ordered steps. A row without a value has none and leaves it as it is.

    A run may be a third of all rows. Blocks of `block` steps are scanned each by itself, from 0; what is carried into a block is a
    scan over one small row per block, and shrinks by `decay` with each value. Time grows with the rows."""
    on = ["_none", "_run", "_block"]
    keys = [F.col(run).isNull().alias("_none"), F.coalesce(F.col(run).cast("string"), F.lit("")).alias("_run"), F.coalesce(F.floor(F.col(step) / block), F.lit(-(1 << 63))).alias("_block")]
    rows = df.select(*keys, F.col(run).alias("_own"), F.col(step).alias("_step"), F.col(value).alias("_value"), F.col(value).cast("double").alias("_v"))
    rows = rows.repartition(*on).sortWithinPartitions(*on, "_step", F.col("_value").asc_nulls_last())
    share = round(1 - decay, 12)

    def scanned(batches):
        before, k, s = None, 0, 0.0
        for batch in batches:
            places, sums = [], []
            for *of, v in zip(*(batch.column(c).to_pylist() for c in (*on, "_v")), strict=True):
                if of != before:
                    before, k, s = of, 0, 0.0
                if v is not None:
                    k, s = k + 1, s * decay + v * share
                places.append(k)
                sums.append(s)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64()), pa.array(sums, pa.float64())], names=[*batch.schema.names, "_k", "_s"])

    def carried(batches):
        before, state = None, 0.0
        for batch in batches:
            out = []
            for *of, k, s in zip(*(batch.column(c).to_pylist() for c in ("_none", "_run", "_k", "_s")), strict=True):
                state = state if of == before else 0.0
                out.append(state)
                before, state = of, state * decay**k + s
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in on), pa.array(out, pa.float64())], names=[*on, "_carry"])

    each = rows.mapInArrow(scanned, StructType([*rows.schema, StructField("_k", LongType()), StructField("_s", DoubleType())]))
    # rows without a value repeat the place and sum of the one before, so the largest place tells the block's end
    ends = each.groupBy(*on).agg(F.max("_k").alias("_k"), F.max_by("_s", "_k").alias("_s"))
    carries = ends.repartition("_none", "_run").sortWithinPartitions(*on).mapInArrow(carried, "_none boolean, _run string, _block long, _carry double")
    ema = F.when(F.col("_value").isNotNull(), F.col("_s") + F.pow(F.lit(decay), F.col("_k")) * F.col("_carry"))
    return each.join(carries, on).select(F.col("_own").alias(run), F.col("_step").alias(step), F.col("_value").alias(value), ema.alias("ema"))


def interval_means(df: DataFrame, run: str, step: str, value: str, every: int) -> DataFrame:
    """Mean per run over each `every` steps."""
    return df.groupBy(run, F.floor((F.col(step) - 1) / every).alias("interval")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def early_stop(df: DataFrame, run: str, step: str, score: str, patience: int, block: int = BLOCK) -> DataFrame:
    """Per run the step at which `patience` steps in a row brought no better score (null: never) and the best step.

    Rows without a score are no steps. A run may be a third of all rows: blocks of `block` steps are ranked each by itself, and
    carry on their number of rows, best score and last improvement, one small row per block."""
    rows = df.where(F.col(score).isNotNull()).select(F.col(run).isNull().alias("_none"), F.coalesce(F.col(run).cast("string"), F.lit("")).alias("_run"), F.coalesce(F.floor(F.col(step) / block), F.lit(-(1 << 63))).alias("_block"), F.col(run).alias("_own"), F.col(step).alias("_step"), F.col(score).alias("_score"))
    on = ["_none", "_run", "_block"]
    earlier = Window.partitionBy("_none", "_run").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*on).orderBy("_step")
    sizes = rows.groupBy(*on).agg(F.count("*").alias("n"), F.max("_score").alias("top"))
    bases = sizes.select(*on, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"), F.max("top").over(earlier).alias("_top"))
    best = F.greatest("_top", F.max("_score").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    marked = rows.join(bases, on).withColumn("_best", best).withColumn("_at", F.col("_base") + F.row_number().over(inside))
    marked = marked.withColumn("_better", F.when(F.col("_best").isNull() | (F.col("_score") > F.col("_best")), F.col("_at")))
    gains = marked.groupBy(*on).agg(F.max("_better").alias("last"))
    known = gains.select(*on, F.max("last").over(earlier).alias("_last"))
    last = F.greatest("_last", F.max("_better").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    counted = marked.join(known, on).withColumn("_since", F.col("_at") - last)
    out = counted.groupBy("_none", "_run").agg(F.first("_own").alias(run), F.min(F.when(F.col("_since") >= patience, F.col("_step"))).alias("stop_step"), F.max_by("_step", F.struct(F.col("_score"), -F.col("_step"))).alias("best_step"))
    return out.drop("_none", "_run")


#: Numbers from this on are years or ids: they stay.
NUMBER_LIMIT = 2100.0
#: A number that is no part of a word.
NUMBER_ALONE = r"(?<![\w.])\d+(?:\.\d+)?(?![\w.]*\w)"


def perturbation(text, ratio: float, salt: str = "42", most: int = 3, least: float = 0.0):
    """(text, original, changed, num_changed): up to `most` numbers of the text within [least, 2100), chosen and scaled by a hash of
    their place: factor 1 +- (0.5 to 1.5) * ratio. The value lists run from right to left (O6).

    Numbers stand alone (not inside words); decimals keep their places, integers round half-even. The text is split between
    the numbers and put together again."""
    numbers = F.regexp_extract_all(text, F.lit(NUMBER_ALONE), F.lit(0))
    h = lambda i, s: F.conv(F.substring(F.md5(F.concat(text, F.lit(salt + s), i.cast("string"))), 1, 8), 16, 10).cast("double") / (1 << 32)

    def choice(numbers):
        inside = F.filter(F.transform(numbers, lambda n, i: F.struct(i.alias("i"), n.cast("double").alias("v"))), lambda x: (x["v"] >= least) & (x["v"] < NUMBER_LIMIT))
        ranked = F.array_sort(F.transform(inside, lambda x: F.struct(h(x["i"], "pick").alias("h"), x["i"].alias("i"))))
        return F.array_sort(F.transform(F.slice(ranked, 1, most), lambda x: x["i"]))

    def changed(n, i):
        factor = 1 + F.when(h(i, "sign") < 0.5, -1.0).otherwise(1.0) * ratio * (0.5 + h(i, "size"))
        places = F.length(F.regexp_extract(n, r"\.(\d+)$", 1))
        new = n.cast("double") * factor
        return F.when(places == 0, F.bround(new).cast("long").cast("string")).otherwise(F.regexp_extract(F.format_string("%.10f", new), r"^(-?\d+\.\d+?)0*$", 1))

    def result(numbers, chosen, new):
        parts = F.split(text, NUMBER_ALONE)
        whole = F.array_join(F.flatten(F.zip_with(parts, new, lambda p, n: F.array(F.coalesce(p, F.lit("")), F.coalesce(n, F.lit(""))))), "")
        picked = lambda values: F.transform(F.reverse(chosen), lambda i: F.get(values, i).cast("double"))
        return F.struct(whole.alias("text"), picked(numbers).alias("original"), picked(new).alias("changed"), F.size(chosen).alias("num_changed"))

    # what every number's turn needs is worked out once for the text
    replaced = lambda numbers, chosen: F.transform(numbers, lambda n, i: F.when(F.array_contains(chosen, i), changed(n, i)).otherwise(n))
    return let(numbers, lambda n: let(choice(n), lambda c: let(replaced(n, c), lambda new: result(n, c, new))))


def perturb_numbers(text, ratio: float, salt: str = "42", most: int = 3):
    """The text alone."""
    return perturbation(text, ratio, salt, most)["text"]


def layer_quotas(df: DataFrame, layer: str, order: list, quotas: dict = fixed.LAYER_QUOTAS) -> DataFrame:
    """The first claims of each layer in the order (split, hashed record, claim) up to its quota."""
    quota = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    ranked = df.where(F.col(layer).isin(*quotas)).withColumn("_r", F.row_number().over(Window.partitionBy(layer).orderBy(*order)))
    most = max(quotas.values(), default=0)  # a plain number, so that Spark drops the rest before the exchange
    return ranked.where((F.col("_r") <= most) & (F.col("_r") <= quota[F.col(layer)])).drop("_r")


def split_quotas(total: int, shares: dict = fixed.SPLIT_QUOTAS) -> dict:
    """int(total * share) rows per split."""
    return {k: int(total * share) for k, share in shares.items()}


def in_splits(df: DataFrame, split: str, wanted: str) -> DataFrame:
    """Rows of the splits in a comma list, all of them for `all`."""
    names = [x.strip() for x in wanted.split(",") if x.strip()]
    return df if "all" in names else df.where(F.col(split).isin(*names))


def with_required_text(df: DataFrame, answer: str, question: str, least: int = 20) -> DataFrame:
    """Rows with a question, and with an answer of at least `least` characters that isn't blank."""
    full = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return df.where(full(question) & full(answer) & (F.length(answer) >= least))


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """`batch` of `size` rows each in the hashed order, the last one shorter."""
    rows, _ = numbered(df, key)
    return rows.withColumn("batch", F.floor(F.col("place") / size)).drop("place")


def sorted_ids(df: DataFrame, key: str) -> DataFrame:
    """O1: distinct ids that aren't empty, ascending."""
    return df.select(key).where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").distinct().orderBy(key)
