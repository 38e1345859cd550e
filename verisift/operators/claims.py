"""Text to atomic claims, routing and verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as t
from ..sources.shared import kept


def extract_claims(responses: DataFrame) -> DataFrame:
    """(…, claim_ord, sentence, numbers, metrics, entities, relations, trend) of every factual sentence of `text`."""
    parts = responses.select("*", F.posexplode(t.sentences(F.col("text"))).alias("sentence_ord", "sentence")).where(~t.is_meta(F.col("sentence")))
    found = parts.withColumn("numbers", t.numbers(F.col("sentence"))).withColumn("metrics", t.metrics(F.col("sentence")))
    first = F.coalesce(F.get("metrics", 0), F.lit(""))
    found = found.withColumn("entities", t.entities(F.col("sentence"), F.col("metrics"))).withColumn("relations", t.comparisons(F.col("sentence"), first)).withColumn("trend", t.trend(F.col("sentence")))
    some = lambda c: F.size(c) > 0
    return found.where(some("numbers") | some("relations") | F.col("trend").isNotNull() | (some("entities") & some("metrics"))).withColumn("is_qualitative", ~some("numbers") & ~some("relations") & F.col("trend").isNull())


def route(claims: DataFrame) -> DataFrame:
    """Profile flags, layers and the best layer."""
    c = claims.withColumn("has_numeric", F.size("numbers") > 0).withColumn("has_entity_metric", (F.size("entities") > 0) & (F.size("metrics") > 0)).withColumn("has_comparison", F.size("relations") > 0).withColumn("has_trend", F.col("trend").isNotNull())
    exact, relational = F.col("has_numeric") & F.col("has_entity_metric"), F.col("has_comparison") | F.col("has_trend")
    layers = F.array_compact(F.array(F.when(exact, 0), F.when(relational, 1), F.when(~exact & ~relational, 2)))
    return c.withColumn("layers", layers).withColumn("best_layer", F.when(exact, 0).when(relational, 1).otherwise(2))


def lookup_score(entity: Column, metric: Column) -> Column:
    """0.7 of the entity's and 0.3 of the metric's similarity, half of the latter where the probe has no metric."""
    return t.similarity(entity, F.col("entity_norm")) * 0.7 + F.when(metric == "", F.lit(0.5)).otherwise(t.similarity(metric, F.col("metric_norm"))) * 0.3


def _layout(length: Column, slack: float) -> Column:
    """How names of about this length are cut: lengths fall into eight ranges an octave (single ones below 16); names of a range
    allow for `edits` and have one piece more, the first `rest` of them a character longer than `base`."""
    width = F.call_function("shiftleft", F.lit(1), F.greatest(F.lit(0), F.length(F.bin(length.cast("long"))) - 4))
    reach = lambda w: F.struct((length - length % w).alias("low"), (length - length % w + w - 1).alias("high"))
    edits = lambda r: F.struct(r["low"].alias("low"), r["high"].alias("high"), F.floor(r["high"] * slack + 1e-9).cast("int").alias("edits"))
    cut = lambda r: F.struct(r["low"].alias("low"), r["high"].alias("high"), r["edits"].alias("edits"), F.floor(r["low"] / (r["edits"] + 1)).cast("int").alias("base"), (r["low"] % (r["edits"] + 1)).alias("rest"))
    return t.let(width, lambda w: t.let(reach(w), lambda r: t.let(edits(r), cut)))


def _pieces(lay: Column, piece) -> Column:
    """piece(i, start, size) of every piece of a layout."""
    return F.transform(F.sequence(F.lit(0), lay["edits"]), lambda i: piece(i, i * lay["base"] + F.least(i, lay["rest"]), lay["base"] + (i < lay["rest"]).cast("int")))


def own_piece_keys(paper: Column, name: Column, slack: float, side: str) -> Column:
    """Keys of the pieces of a name: of its edits + 1 pieces a name within that many edits leaves one whole."""
    lay = _layout(F.length(name), slack)
    return t.let(lay, lambda at: _pieces(at, lambda i, start, size: F.xxhash64(paper, F.lit(side), at["low"], i, F.substr(name, start + 1, size))))


def reached_piece_keys(paper: Column, name: Column, slack: float, side: str) -> Column:
    """Keys under which a name meets the pieces of names that are as long or longer and may lie within their edits: piece i can
    have moved by at most i places from the left, and by at most edits - i from the right."""
    m = F.length(name)
    layouts = F.array_distinct(F.transform(F.sequence(m, F.floor(m / (1 - slack) + 1e-9).cast("int")), lambda n: _layout(n, slack)))

    def of(at: Column) -> Column:
        def places(i, start, size):
            first = F.greatest(F.lit(0), start - i, start - (at["high"] - m) - (at["edits"] - i))
            last = F.least(m - size, start + i, start - (at["low"] - m) + (at["edits"] - i))
            some = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return F.transform(some, lambda q: F.xxhash64(paper, F.lit(side), at["low"], i, F.substr(name, q + 1, size)))

        return F.flatten(_pieces(at, places))

    return F.array_distinct(F.flatten(F.transform(layouts, of)))


def near_names(asked: DataFrame, known: DataFrame, least: float) -> DataFrame:
    """The pairs of asked(paper_id, probe_entity) and known(paper_id, entity_norm), distinct names of a paper, whose similarity may
    reach `least`: names that share no piece where it could stand never meet. A `least` of 0 or below rules nothing out."""
    if least <= 0:
        return asked.join(known, "paper_id")
    slack = 1 - least

    def keyed(df: DataFrame, name: str, own: str, other: str) -> DataFrame:
        """Pieces of own names meet what the other side reaches, and the other way round."""
        args = F.col("paper_id"), F.col(name), slack
        return df.select("paper_id", name, F.explode(F.concat(own_piece_keys(*args, own), reached_piece_keys(*args, other))).alias("key"))

    met = keyed(asked, "probe_entity", "asked", "known").join(keyed(known, "entity_norm", "known", "asked"), ["paper_id", "key"])
    pairs = met.select("paper_id", "probe_entity", "entity_norm").distinct()
    return pairs.where(t.similarity(F.col("probe_entity"), F.col("entity_norm")) >= least - 1e-9)


def fuzzy_lookup(probes: DataFrame, records: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Per probe (paper_id, probe_entity, probe_metric) and table the best record by score, the first on ties, if it reaches the threshold.

    Many claims ask for one name and many records bear one, so distinct names meet, by an index of their pieces; of the records
    of a table with one name and metric only the first can win. Ranks are a window, which Spark prunes before the exchange.
    Null names meet nothing; repeated rows count once; other columns of records come along."""
    asked = probes.select("paper_id", "probe_entity", "probe_metric").where("probe_entity is not null and probe_metric is not null").distinct()
    names = ["paper_id", "table_ord", "entity_norm", "metric_norm"]
    others = [F.col(f"`{c}`") for c in records.columns if c not in names]
    first = records.where("entity_norm is not null and metric_norm is not null").groupBy(*names).agg(F.min_by(F.struct(*others), "rec_ord").alias("_first")).select(*names, "_first.*")
    near = near_names(asked.select("paper_id", "probe_entity").distinct(), first.select("paper_id", "entity_norm").distinct(), (threshold - 0.3) / 0.7)
    met = asked.join(near, ["paper_id", "probe_entity"]).join(first, ["paper_id", "entity_norm"]).withColumn("score", lookup_score(F.col("probe_entity"), F.col("probe_metric")))
    best = Window.partitionBy("paper_id", "probe_entity", "probe_metric", "table_ord").orderBy(F.desc("score"), "rec_ord")
    ranked = met.withColumn("_rank", F.row_number().over(best)).where((F.col("_rank") == 1) & (F.col("score") >= threshold))
    return ranked.select("paper_id", "probe_entity", "probe_metric", *[f"`{c}`" for c in records.columns if c != "paper_id"], "score")


def best_table(found: DataFrame) -> DataFrame:
    """Of the tables' winners with a value the one with the highest score, the first table on ties."""
    best = Window.partitionBy("paper_id", "probe_entity", "probe_metric").orderBy(F.desc("score"), "table_ord")
    return found.where("value is not null").withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank")


def first_table(found: DataFrame) -> DataFrame:
    """The value of the first table whose winner has one."""
    return found.where("value is not null").groupBy("paper_id", "probe_entity", "probe_metric").agg(F.min_by("value", "table_ord").alias("value"))


def value_verdict(said: Column, true: Column) -> Column:
    """V3: +1 within 0.05, +0.8 within one percent, else -1."""
    off = F.abs(said - true)
    return F.when(off <= fixed.EXACT_TOLERANCE, 1.0).when(off / F.greatest(F.abs(true), F.lit(1e-8)) <= fixed.RELATIVE_TOLERANCE, 0.8).otherwise(-1.0)


def verify_values(claims: DataFrame, records: DataFrame) -> DataFrame:
    """V2 and V4: claims(paper_id, claim_ord, numbers, entities, metrics) with `reward0` and `confidence0`.

    The score does not depend on the number, so the first number of the claim meets the best record of its names."""
    pairs = claims.select("paper_id", "claim_ord", F.get("numbers", 0)["value"].alias("said"), F.posexplode("entities").alias("e", "entity"), "metrics").where("said is not null")
    pairs = pairs.select("paper_id", "claim_ord", "said", "e", F.col("entity.normalized").alias("probe_entity"), F.posexplode(F.when(F.size("metrics") > 0, F.transform("metrics", t.record_name)).otherwise(F.array(F.lit("")))).alias("m", "probe_metric"))
    won = best_table(fuzzy_lookup(pairs, records, 0.7)).select("paper_id", "probe_entity", "probe_metric", "score", "value")
    best = Window.partitionBy("paper_id", "claim_ord").orderBy(F.desc("score"), "e", "m")
    top = pairs.join(won, ["paper_id", "probe_entity", "probe_metric"]).withColumn("_rank", F.row_number().over(best)).where((F.col("_rank") == 1) & (F.col("score") >= fixed.LOOKUP_GATE))
    verdict = top.select("paper_id", "claim_ord", value_verdict(F.col("said"), F.col("value")).alias("reward0"), F.col("score").alias("confidence0"))
    return claims.join(verdict, ["paper_id", "claim_ord"], "left").withColumn("confidence0", F.coalesce("confidence0", F.lit(0.0)))


def relation_verdict(relation: Column, a: Column, b: Column) -> Column:
    """V5: (reward, confidence) of a relation between two values, either of which may be missing."""
    equal = F.abs(a - b) < 1e-8
    holds = F.when(relation == "gt", ~equal & (a > b)).when(relation == "lt", ~equal & (a < b)).when(relation == "gte", equal | (a > b)).when(relation == "lte", equal | (a < b)).otherwise(equal)
    known = a.isNotNull().cast("int") + b.isNotNull().cast("int")
    reward = F.when(known == 2, F.when(holds, 0.8).otherwise(-0.8)).when(known == 1, 0.5).otherwise(0.0)
    return F.struct(reward.alias("reward"), F.when(known == 2, 0.9).when(known == 1, 0.5).otherwise(0.0).alias("confidence"))


def verify_relations(relations: DataFrame, records: DataFrame) -> DataFrame:
    """V5 over relations(paper_id, entity_a, entity_b, relation, metric): `reward1`, `confidence1`."""
    r = relations.withColumn("_a", t.claim_name(F.col("entity_a"))).withColumn("_b", t.claim_name(F.col("entity_b"))).withColumn("_m", t.record_name(F.col("metric")))
    asked = r.select("paper_id", F.explode(F.array("_a", "_b")).alias("probe_entity"), F.col("_m").alias("probe_metric"))
    known = first_table(fuzzy_lookup(asked, records, 0.6))
    side = lambda x: known.select("paper_id", F.col("probe_entity").alias(f"_{x}"), F.col("probe_metric").alias("_m"), F.col("value").alias(f"value_{x}"))
    v = r.join(side("a"), ["paper_id", "_a", "_m"], "left").join(side("b"), ["paper_id", "_b", "_m"], "left")
    v = v.withColumn("_v", relation_verdict(F.col("relation"), F.col("value_a"), F.col("value_b")))
    return v.withColumn("reward1", F.col("_v.reward")).withColumn("confidence1", F.col("_v.confidence")).drop("_v", "_a", "_b", "_m")


def sequence_direction(values: Column) -> Column:
    """V7: the direction of an array of numbers."""
    n = F.size(values)
    pairs = F.zip_with(F.slice(values, 1, F.greatest(n - 1, F.lit(0))), F.slice(values, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: b - a)
    share = lambda keep: F.size(F.filter(pairs, keep)) / F.greatest(n - 1, F.lit(1))
    half = F.slice(values, F.floor(n / 2).cast("int") + 1, n)
    top, low = F.array_max(half), F.array_min(half)
    return F.when(n < 2, "unknown").when(share(lambda d: d > 0) >= 0.8, "increase").when(share(lambda d: d < 0) >= 0.8, "decrease").when((F.size(half) >= 2) & (top > 0) & ((top - low) / top < 0.05), "saturate").otherwise("stable")


def trend_verdict(said: Column, found: Column) -> Column:
    """V8: +0.8 where the directions agree (stable and saturate count as one), else -0.8; null if nothing was found."""
    flat = lambda c: F.when(c == "saturate", "stable").otherwise(c)
    return F.when(found == "unknown", None).when(flat(said) == flat(found), 0.8).otherwise(-0.8)


def numeric_consistency(claim: Column, evidence: Column) -> Column:
    """The share of the claim's numbers, as they are written, that the evidence holds; 0.5 without any, 0.3 if the evidence has none."""
    own, other = t.number_strings(claim), t.number_strings(evidence)
    return F.when(F.size(own) == 0, 0.5).when(F.size(other) == 0, 0.3).otherwise(F.size(F.array_intersect(own, other)) / F.size(own))


def lexical_parts(claim: Column, evidence: Column) -> Column:
    """Token F1, entity coverage, numeric consistency."""
    f1 = t.set_f1(t.word_set(claim), t.word_set(evidence))
    names = F.array_distinct(t.all_matches(claim, r"(?U)\b[A-Z][\w\-]+\b"))
    low = F.lower(evidence)
    coverage = F.when(F.size(names) == 0, 0.5).otherwise(F.size(F.filter(names, lambda e: low.contains(F.lower(e)))) / F.size(names))
    return F.struct(f1.alias("f1"), coverage.alias("coverage"), numeric_consistency(claim, evidence).alias("numeric"))


def lexical_reward(parts: Column, evidence: Column) -> Column:
    """V10."""
    c = parts["f1"] * 0.4 + parts["coverage"] * 0.3 + parts["numeric"] * 0.3
    r = F.when(c >= 0.5, F.least(c * 1.5, F.lit(1.0))).when(c >= 0.2, 0.0).otherwise(-0.8 * (1 - c * 3))
    return F.when(F.trim(F.coalesce(evidence, F.lit(""))) == "", 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def fused_reward(layers: dict[int, Column]) -> Column:
    """A1: weighted mean of the layers that fired (not null)."""
    weight = sum((F.when(r.isNotNull(), F.lit(fixed.LAYER_WEIGHTS[k])).otherwise(0.0) for k, r in layers.items()), F.lit(0.0))
    total = sum((F.coalesce(r * fixed.LAYER_WEIGHTS[k], F.lit(0.0)) for k, r in layers.items()), F.lit(0.0))
    return F.coalesce(F.try_divide(total, weight), F.lit(0.0))


def _parts(name: Column, sizes: Column) -> Column:
    """The distinct parts of a name that have one of these sizes."""
    each = F.transform(F.filter(sizes, lambda n: n <= F.length(name)), lambda n: F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda p: F.substr(name, p, n)))
    return F.array_distinct(F.flatten(each))


def _with_parts(holders: DataFrame, held: DataFrame) -> DataFrame:
    """(paper_id, whole, part) for the names of `holders` that hold a name of `held`, both distinct (paper_id, name).

    A name meets, as keys, its parts of the sizes that the paper's other names have: no pair of names is compared."""
    sizes = held.groupBy("paper_id").agg(F.sort_array(F.collect_set(F.length("name"))).alias("sizes"))
    parts = holders.join(sizes, "paper_id").select("paper_id", F.col("name").alias("whole"), F.explode(_parts(F.col("name"), F.col("sizes"))).alias("part"))
    return parts.join(held.select("paper_id", F.col("name").alias("part")), ["paper_id", "part"], "left_semi").select("paper_id", "whole", "part")


def touched_names(claimed: DataFrame, known: DataFrame) -> DataFrame:
    """The distinct names of known(paper_id, name) that hold one of claimed(paper_id, name), or are held by one. Null names touch
    nothing; an empty name is held by all."""
    asked, there = (x.where("name is not null").distinct() for x in (claimed, known))
    holding = _with_parts(there, asked).select("paper_id", F.col("whole").alias("name"))
    inside = _with_parts(asked, there).select("paper_id", F.col("part").alias("name"))
    return holding.union(inside).distinct()


def covered_share(claimed: DataFrame, records: DataFrame) -> DataFrame:
    """A3: (paper_id, covered): the share of a paper's records whose name is touched by one of claimed(paper_id, name)."""
    hit = touched_names(claimed, records.select("paper_id", F.col("entity_norm").alias("name"))).select("paper_id", F.col("name").alias("entity_norm"), F.lit(1).alias("_hit"))
    # records of one name are one row with a count before they meet the names
    counts = records.groupBy("paper_id", "entity_norm").agg(F.count_distinct("table_ord", "rec_ord").alias("_n"))
    return counts.join(hit, ["paper_id", "entity_norm"], "left").groupBy("paper_id").agg((F.sum(F.coalesce("_hit", F.lit(0)) * F.col("_n")) / F.sum("_n")).alias("covered"))


def reward_by_paper(responses: DataFrame, records: DataFrame) -> DataFrame:
    """A1 to A5 with blank layer-2 evidence: per paper_id of responses base, coverage, specificity and total of its claims; zero
    where it has none, and coverage zero where it has no records.

    responses: (paper_id, claim_ord, text), each text one response part of its paper. Its claims are written once: what reads them
    would else parse every text again."""
    claims = kept(route(extract_claims(responses)).drop("text"), "claims")
    checked = verify_values(claims, records)
    exact = F.when(F.array_contains("layers", 0) & (F.col("confidence0") >= fixed.GATE), F.col("reward0"))
    fused = fused_reward({0: exact, 2: F.when(exact.isNull(), F.lit(0.0))})
    scored = checked.withColumn("claim_reward", fused).groupBy("paper_id").agg(F.avg("claim_reward").alias("base"), F.avg(F.arrays_overlap("layers", F.array(F.lit(0), F.lit(1))).cast("double")).alias("specific"), F.count("*").alias("claims"))
    covered = covered_share(claims.select("paper_id", F.explode("entities.normalized").alias("name")), records)
    both = responses.select("paper_id").distinct().join(scored, "paper_id", "left").join(covered, "paper_id", "left")
    both = both.select("paper_id", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("claims", "base", "specific", "covered")])
    return both.select("paper_id", "claims", "base", (F.col("specific") * 0.05).alias("specificity"), (F.least(F.col("covered"), F.lit(1.0)) * 0.1).alias("coverage")).withColumn("total", F.col("base") + F.col("coverage") + F.col("specificity"))
