"""Benchmark decontamination by template canonicalisation, with DataFrame functions alone.

Numbers, units after numbers and capitalised names become typed placeholders; other words lose their case and punctuation.
Every window of a benchmark item and of a document is hashed by its template; item windows with names, or with few words that
are no placeholder, by their words too, without case; items below the window's length are hashed whole. Windows that meet give
a document, a class of items of one template, and an offset; there the class is laid over the document and matching words are
counted. A verbatim run of PROOF words is a passage; in others each of the item's values must stand for one value of the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

#: Words of a window, words in it that are no placeholder at least, matching words that prove a passage, and their share of a shorter item.
WINDOW, LITERAL, PROOF, SHARE = 7, 3, 13, 0.8
#: Share of a passage's placeholders that may hold a second value for one of the item's.
CONFLICT = 0.15
#: Benchmark windows up to this many rows (about 32 bytes each), and as many hits, are broadcast, more are joined by an exchange.
BROADCAST_ROWS = 500_000
UNITS = ("kg", "g", "mg", "km", "m", "cm", "mm", "mi", "ft", "lb", "oz", "l", "ml", "s", "ms", "min", "h", "hr", "hrs", "hours", "minutes", "seconds", "days", "weeks", "years", "miles", "meters", "metres", "feet", "dollars", "cents", "euros", "percent", "mph", "kmh", "usd", "eur")
_MARKS = ".,;:!?\"'()[]{}"
_SPACE = r"[\x20\x09-\x0D]+"


_UNIT = rf"(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))}|%|\$|€)"


def _plain(text: Column) -> Column:
    """Without punctuation, marks inside words too, and with a space between a number and its unit, so `120km` is `120 km`."""
    return F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _MARKS, ""), rf"(?<=\d)(?={_UNIT}(?![\p{{L}}\p{{N}}]))", " ")


def _words(plain: Column) -> Column:
    """The words of a plain text in lower case; each stands where its template does."""
    return F.filter(F.split(F.lower(plain), _SPACE), lambda w: w != "")


def _template(plain: Column) -> Column:
    units = F.regexp_replace(plain, rf"(?<=\d[\x20\x09-\x0D]){_UNIT}(?![\p{{L}}\p{{N}}])", "<unit>")
    named = F.regexp_replace(units, r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}+", "<name>")
    return F.filter(F.split(F.lower(F.regexp_replace(named, r"\d+", "<num>")), _SPACE), lambda w: w != "")


def _held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that expressions above don't work out again at each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _items(benchmark: DataFrame) -> DataFrame:
    """class, item_id, item_words, item_template, places (of the slots), pattern (for each slot the first one of equal value).

    Items of one template whose values repeat alike form a class: documents meet it once, however many items it has."""
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    rows = rows.select("item_id", _words(_plain(F.col("text"))).alias("item_words"), _template(_plain(F.col("text"))).alias("item_template")).where(F.size("item_template") > 0)
    places = F.filter(F.sequence(F.lit(0), F.size("item_template") - 1), lambda i: F.get("item_template", i).contains("<"))
    values = F.transform("places", lambda i: F.struct(F.get("item_template", i), F.get("item_words", i)))
    pattern = _let(values, lambda all_: F.transform(all_, lambda v: F.array_position(all_, v)))
    rows = rows.withColumn("places", places).withColumn("pattern", pattern)
    return rows.withColumn("class", F.xxhash64("item_template", "pattern"))


def _classes(items: DataFrame) -> DataFrame:
    """class, item_id (the smallest), n_items, and what its items have in common."""
    return items.groupBy("class").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"), *[F.first(c).alias(c) for c in ("item_template", "places", "pattern")])


def _values(items: DataFrame) -> DataFrame:
    """class, i, v: the words that its items have at a slot."""
    return items.select("class", F.explode(F.transform("places", lambda i: F.struct(i.alias("i"), F.get("item_words", i).alias("v")))).alias("s")).select("class", "s.i", "s.v").distinct()


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """class, at, size, raw, key, distinct, for every window; an item below the window's length is one by itself.

    A window with enough words that are no placeholder is keyed by its template. The others, short items, and windows with a
    name, which other case would hide, are keyed by their words (raw)."""
    length = F.size("item_template")
    by_words = F.when(length >= window, _keys(F.col("item_words"), window))
    for n in range(1, window):
        by_words = by_words.when(length == n, _keys(F.col("item_words"), n))
    sized = items.select("class", "item_template", F.least(F.lit(window), length).alias("size"), _keys(F.col("item_template"), window).alias("t"), by_words.alias("w"))
    at = sized.select("class", "item_template", "size", "t", F.posexplode("w").alias("at", "word_key"))
    part = F.slice("item_template", F.col("at") + 1, F.col("size"))
    by_template = (F.size(F.filter(part, lambda w: ~w.contains("<"))) >= LITERAL) & (F.col("size") == window)
    named = F.exists(part, lambda w: w.contains("<name>"))
    each = F.array(F.when(by_template, F.struct(F.lit(False).alias("raw"), F.get("t", F.col("at")).alias("key"))), F.when(~by_template | named, F.struct(F.lit(True).alias("raw"), F.col("word_key").alias("key"))))
    return at.select("class", "at", "size", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("k")).select("class", "at", "size", "k.raw", "k.key").distinct()


def _let(value: Column, then) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def _keys(words: Column, size: int) -> Column:
    """The key of `size` words at every offset, by doubling: two hashes of half windows, which may overlap, make one. Null for shorter texts."""
    beside = lambda p, far: F.zip_with(p, F.slice(p, far + 1, F.size(p)), lambda a, b: F.xxhash64(a, b))

    def grown(p: Column, have: int) -> Column:
        if have * 2 <= size:
            return _let(beside(p, have), lambda q: grown(q, have * 2))
        return beside(p, size - have) if size > have else p

    each = _let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: grown(h, 1))
    return F.when(F.size(words) >= size, F.slice(each, 1, F.size(words) - size + 1))


def _hits(docs: DataFrame, windows: DataFrame, held: list, window: int) -> DataFrame:
    """_row and, for each class and offset at which windows meet, a small hit: texts are joined to it later."""
    raw_sizes = sorted({r["size"] for r in held if r["raw"]})
    texts = _held(docs.select("_row", "text"), "plain", _plain(F.col("text"))).select("_row", "plain")
    texts = _held(texts, "template", _template(F.col("plain")))
    if raw_sizes:
        texts = _held(texts, "words", _words(F.col("plain")))
    at_all = F.explode(F.array(_keys(F.col("template"), window), *[_keys(F.col("words"), n) for n in raw_sizes])).alias("keys")
    keys = texts.select("_row", at_all).select("_row", F.posexplode("keys").alias("place", "key"))
    return keys.join(windows.select("key", "class", "at"), "key").select("_row", "class", (F.col("place") - F.col("at")).alias("offset")).distinct()


def _consistent(slots: Column) -> Column:
    """Each value of the item stands for one value of the document, but for a small share of the slots; the reverse isn't asked."""
    own = F.array_distinct(F.transform(slots, lambda s: s["p"]))
    return F.size(F.array_distinct(slots)) - F.size(own) <= CONFLICT * F.size(slots)


def _runs(places: Column) -> Column:
    """The runs of neighbours among ascending places: first, last."""
    first, last = F.array_except(places, F.transform(places, lambda i: i + 1)), F.array_except(places, F.transform(places, lambda i: i - 1))
    return F.arrays_zip(first.alias("first"), last.alias("last"))


def _cut(docs: DataFrame, hits: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, _row, the class's columns, offset, first (the item's first word inside the document), and the document's words and
    template words under the item: no longer than it."""
    rows = docs.join(hits, "_row").select("doc_id", "_row", "class", "offset", _template(_plain(F.col("text"))).alias("_t"), _words(_plain(F.col("text"))).alias("_w"))
    met = rows.join(classes, "class")
    first, last = F.greatest(F.lit(0), -F.col("offset")), F.least(F.size("item_template"), F.size("_t") - F.col("offset"))
    part = lambda c: F.when(last > first, F.slice(c, first + F.col("offset") + 1, last - first)).otherwise(F.array().cast("array<string>"))
    return met.select("doc_id", "_row", *classes.columns, "offset", first.alias("first"), part("_t").alias("t"), part("_w").alias("w"))


def _laid(met: DataFrame, known: DataFrame) -> DataFrame:
    """Each class laid over a document: `same` are the places of equal words or template words, `verbatim` those of equal words; a
    slot's word is equal to that of any item of the class (known). slots: the class's value there and the document's."""
    t = F.col("item_template")
    doc = lambda c, i: F.get(c, i - F.col("first"))
    slot = lambda i: F.get(t, i).contains("<")
    equal = lambda i: F.when(slot(i), F.coalesce(F.array_contains("known", i), F.lit(False))).otherwise(F.get(t, i) == doc("w", i))
    places = F.when(F.size("t") > 0, F.sequence(F.col("first"), F.col("first") + F.size("t") - 1)).otherwise(F.array().cast("array<int>"))
    same = F.filter(places, lambda i: equal(i) | (F.get(t, i) == doc("t", i)))
    value = lambda i: F.get("pattern", (F.array_position("places", i) - 1).cast("int"))
    slots = F.transform(F.filter("same", slot), lambda i: F.struct(i.alias("i"), value(i).alias("p"), doc("w", i).alias("d")))
    each = met.join(known, ["_row", "class", "offset"], "left")
    return _held(_held(_held(each, "same", same), "verbatim", F.filter("same", equal)), "slots", slots)


def _proved() -> Column:
    """A verbatim run proves a passage whatever lies around it; a run of equal template words, or all of them, if their slots agree."""
    enough = lambda n: (n >= PROOF) | (n >= SHARE * F.size("item_template"))
    values = lambda slots: F.transform(slots, lambda s: F.struct(s["p"].alias("p"), s["d"].alias("d")))
    verbatim = F.exists(_runs(F.col("verbatim")), lambda r: r["last"] - r["first"] + 1 >= PROOF)
    run = F.exists(_runs(F.col("same")), lambda r: enough(r["last"] - r["first"] + 1) & _consistent(values(F.filter("slots", lambda s: s["i"].between(r["first"], r["last"])))))
    return enough(F.size("same")) & (verbatim | _consistent(values(F.col("slots"))) | run)


def _found(docs: DataFrame, benchmark: DataFrame, window: int, broadcast_rows: int) -> DataFrame:
    """(doc_id, _row, figures of one proved hit). _row is a hash of id and text that tells rows apart."""
    items = _items(benchmark)
    windows = benchmark_windows(items, window)
    held = windows.groupBy("raw", "size").count().collect()
    bounded = sum(r["count"] for r in held) <= broadcast_rows
    small = lambda df: F.broadcast(df) if bounded else df
    hits = written(_hits(docs, small(windows), held, window))
    # few hits go to the texts; only if they are many do texts move to them
    few = hits.count() <= broadcast_rows
    met = written(_cut(docs, F.broadcast(hits) if few else hits, small(_classes(items))))
    slots = met.select("_row", "class", "offset", F.explode(F.filter(F.transform("places", lambda i: F.struct(i.alias("i"), F.get("w", i - F.col("first")).alias("v"))), lambda s: s["v"].isNotNull())).alias("s"))
    known = slots.select("_row", "class", "offset", "s.i", "s.v").join(small(_values(items)), ["class", "i", "v"], "left_semi")
    laid = _laid(met, known.groupBy("_row", "class", "offset").agg(F.collect_set("i").alias("known")))
    return laid.where(_proved()).select("doc_id", "_row", "item_id", "n_items", "offset", F.size("item_template").alias("item_size"), F.size("same").alias("matched"), F.size("slots").alias("slots"))


def _row() -> Column:
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit("")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Benchmark items in docs(doc_id, text), verbatim or with other numbers, names and units; benchmark(item_id, text).

    Null and empty texts hold nothing. Case is ignored, and `120km` is `120 km`. Items of fewer than `window` words, and windows
    with fewer than LITERAL words that are no placeholder, are met verbatim only. Items that differ in the values of their
    slots alone, and repeat them alike, count as one: a word of a document is verbatim at a slot if any of them has it there.
    Repeated doc_ids are judged each by its own text, null ones too; equal rows (doc_id and text) give one. A null item_id is
    an item like any other; one item_id with several texts is met by each of them; repeated items count once. Empty tables
    give no rows; other columns are ignored. Up to `broadcast_rows` benchmark windows, and as many hits, are broadcast; more
    are joined by an exchange.
    One row per document row and class of items: doc_id, item_id (the smallest of the class), n_items, item_size, matched
    (words), slots (placeholders among them), offset (of the item's first word in the document's words; of equal matches the first).
    """
    each = _found(docs.select("doc_id", "text").withColumn("_row", _row()), benchmark, window, broadcast_rows)
    best = each.groupBy("doc_id", "_row", "item_id").agg(F.max(F.struct("matched", (-F.col("offset")).alias("back"), "item_size", "slots", "n_items")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_items", "b.item_size", "b.matched", "b.slots", (-F.col("b.back")).alias("offset"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs, with all their columns whatever their names, in which find_contamination finds no item.

    Rows with null or empty texts stay; rows of one doc_id, null ones too, are judged each by its own text, equal rows alike.
    Without items every row stays; an empty table stays empty."""
    own, bad_id, bad_row = (free_name(docs, c) for c in ("row_hash", "bad_id", "bad_row"))
    bad = _found(docs.select("doc_id", "text").withColumn("_row", _row()), benchmark, window, broadcast_rows)
    bad = bad.select(F.col("doc_id").alias(bad_id), F.col("_row").alias(bad_row)).distinct()
    left = docs.withColumn(own, _row()).join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (F.col(own) == F.col(bad_row)), "left_anti")
    return left.drop(own)
