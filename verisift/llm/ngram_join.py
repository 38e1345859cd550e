"""N-gram Jaccard join as a blocked sparse product of documents by n-grams, and the components of its links.

N-grams are ordered by how many documents hold them, rare ones first. Two sets with Jaccard t share an n-gram among the first
n - ceil(t n) + 1 of either, so documents whose first n-grams are all their own have no partner. The others meet at such
n-grams. Products are taken against one hub per n-gram first (the set with the fewest n-grams of its own: the text that the
others are copies of), then exactly between all that still lie in different components and pass the bounds from sizes and
positions. A copy that its original does not reach has lost so many n-grams that these bounds rule out most other copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import first_of_runs, forget, free_name, group_count, quoted, steps, text_bytes, windows, words, written
from .packed import Answers, Group, answered, dealt, sent

SIZE, PERCENT = 5, 75
#: A key is met in parts if it has more rows than this, and more than a HOT_KEYS-th of all rows: so fewer keys than that are.
HOT_ROWS, HOT_KEYS = 10_000, 10_000


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct shingles of each text, ascending; a text with fewer words has its whole sequence as one."""
    h, _, _, first = words(data, off, lower=True)
    n = np.diff(first)
    docs = len(n)
    doc = np.repeat(np.arange(docs), n)
    at = np.arange(len(h))
    at = at[at + size <= first[1:][doc]] if docs else at
    x, d = windows(h, size)[at] if len(at) else np.zeros(0, np.uint64), doc[at]
    for k in range(1, size):
        short = np.flatnonzero(n == k)
        if len(short):
            x, d = np.r_[x, windows(h, k)[first[:-1][short]] ^ np.uint64(k)], np.r_[d, short]
    order = np.lexsort((x, d))
    x, d = x[order], d[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
    x, d = x[new], d[new]
    return x, np.searchsorted(d, np.arange(docs + 1))


def _frequency_class(df: np.ndarray) -> np.ndarray:
    """0 for one document, else 1..255, never falling with df."""
    return np.where(df > 1, np.clip(np.floor(np.log2(np.maximum(df, 1)) * 8), 1, 255), 0).astype(np.uint8)


def _prefix(n, percent: int):
    """How many of the first n-grams of a set of n any partner must meet one of."""
    return n - -(-percent * n // 100) + 1


def incidence(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, groups: int | None = None) -> DataFrame:
    """Rows doc_id, n_shingles, own (n-grams that no other document holds), digest and grams of the sets that can have a partner.

    grams: the n-grams that others hold too, rare ones first. Sets without a possible partner have null digest and grams."""
    groups = groups or group_count(text_bytes(docs))
    rows = dealt(docs, groups)

    def send(table):
        group = Group(table)
        h = np.concatenate([shingle_sets(group.data[group.off[i] : group.off[j]], group.off[i : j + 1] - group.off[i], size)[0] for i, j in steps(group.off)] or [np.zeros(0, np.uint64)])
        h, count = np.unique(h, return_counts=True)
        return sent(group.g, h, {"many": np.minimum(count, 255).astype(np.uint8)}, groups)

    frequencies = lambda starts, per, c: _frequency_class(np.add.reduceat(c["many"].astype(np.int64), starts))
    classes = answered(rows.groupBy("g").applyInArrow(send, "b int, g int, keys binary, many binary"), {"many": "u1"}, frequencies)

    def collect(table, back):
        group, known = Group(table), Answers(back, groups)
        n_all, own_all, digests, grams = [], [], [], []
        for i, j in steps(group.off):
            x, first = shingle_sets(group.data[group.off[i] : group.off[j]], group.off[i : j + 1] - group.off[i], size)
            c = known.of(x)
            n = np.diff(first)
            total = np.r_[0, np.cumsum(c == 0)]
            own = total[first[1:]] - total[first[:-1]]
            can = (n > 0) & (own < _prefix(n, percent))
            n_all.append(n)
            own_all.append(own)
            for d in range(j - i):
                if not can[d]:
                    digests.append(None)
                    grams.append(None)
                    continue
                s, k = x[first[d] : first[d + 1]], c[first[d] : first[d + 1]]
                digests.append(hashlib.md5(s.tobytes()).digest())
                s, k = s[k > 0], k[k > 0]
                grams.append(s[np.lexsort((s, k))].view(np.int64))
        n_all, own_all = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (n_all, own_all))
        return pa.table({"doc_id": pa.array(group.ids, pa.int64(), mask=group.null), "n_shingles": pa.array(n_all, pa.int64()), "own": pa.array(own_all, pa.int64()), "digest": pa.array(digests, pa.binary()), "grams": pa.array(grams, pa.list_(pa.int64()))})

    return rows.groupBy("g").cogroup(classes.groupBy("g")).applyInArrow(collect, "doc_id long, n_shingles long, own long, digest binary, grams array<long>")


def _met(rows: DataFrame, other: DataFrame, counts: DataFrame, key: str, by: str, total: int) -> DataFrame:
    """rows joined with other (one row a key) on key. counts: (key, n), the rows of each key among `total`. Keys of very many rows are
    cut into parts by another column, and other's row goes to each; the broadcast list of them holds fewer than HOT_KEYS."""
    most = max(HOT_ROWS, -(-total // HOT_KEYS))
    hot = F.broadcast(counts.where(F.col("n") > most).select(key, F.ceil(F.col("n") / most).cast("int").alias("parts")))
    parts = F.coalesce("parts", F.lit(1))
    rows = rows.join(hot, key, "left").withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("parts")
    other = other.join(hot, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return rows.join(other, [key, "part"]).drop("part")


def _links(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the Jaccard bound; pairs is a written table. Blocks of the product: runs of pairs with one b;
    each row of a block accumulates the number of its n-grams that b's set holds. A b of very many pairs is spread over parts."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("an"), F.col("grams").alias("ag"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("bn"), F.col("grams").alias("bg"))
    counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
    joined = _met(pairs.join(left, "a"), right, counts, "b", "a", pairs.count()).select("a", "b", "an", "bn", "ag", "bg")

    def product(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, an, bn = (batch.column(i).to_numpy() for i in range(4))
            lists, other = batch.column(4), batch.column(5)
            cut = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            x, y = lists.flatten().to_numpy(), other.flatten().to_numpy()
            ycut = other.offsets.to_numpy() - other.offsets[0].as_py()
            keep = np.zeros(len(a), bool)
            at = first_of_runs(b)
            for i, j in zip(at.tolist(), [*at[1:].tolist(), len(b)], strict=True):
                column = np.sort(y[ycut[i] : ycut[i + 1]])
                block = x[cut[i] : cut[j]]
                if len(column):
                    where = np.minimum(np.searchsorted(column, block), len(column) - 1)
                    c = np.r_[0, np.cumsum(column[where] == block)]
                    both = c[cut[i + 1 : j + 1] - cut[i]] - c[cut[i:j] - cut[i]]
                    keep[i:j] = 100 * both >= percent * (an[i:j] + bn[i:j] - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return joined.mapInArrow(product, "a long, b long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges(a, b), for ids with an edge. Large star and small star until stable."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    old = mark(now)
    while True:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        last, now = now, written(small.where("u <> v"))
        forget(last)
        if (new := mark(now)) == old:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        old = new


def jaccard_components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, groups: int | None = None) -> DataFrame:
    """Links the rows of docs(doc_id, text) whose shingle sets have 100 * intersection >= percent * union, and names components.

    Text is lower-cased (A-Z); words are [^\\x20\\x09-\\x0D]+. Equal sets form a class with one representative; no pair
    inside a class is made. Rows without words (null, empty, blank) link with nothing. A null doc_id takes part but never
    names a component (null if all are). Repeated doc_ids are rows of their own; an empty table gives no rows; other columns
    are ignored. Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by links).
    """
    base = written(incidence(docs, size, percent, groups))
    some = base.where(F.col("digest").isNotNull())
    sets = some.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit((1 << 63) - 1)).alias("least"), F.count("*").alias("rows"), F.first("n_shingles").alias("n"), F.first("own").alias("own"), F.first("grams").alias("grams"))
    # ids of classes: the digest's own number, so that classes without any doc_id have one
    sets = written(sets.withColumn("id", F.xxhash64("digest")))
    index = sets.select("id", "n", F.col("own").alias("before"), F.posexplode(F.slice("grams", 1, F.greatest(F.lit(1), (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("own")).cast("int")))).alias("k", "gram"))
    index = index.select("gram", "id", "n", "before", (F.col("n") - F.col("before") - F.col("k")).alias("rest"))
    met = index.groupBy("gram").agg(F.count("*").alias("held"), F.min(F.struct("before", "n", "id", "rest")).alias("hub")).where("held > 1")
    index = written(index.join(met.select("gram", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.rest").alias("hub_rest")), "gram"))
    fits = lambda n, m, r, s: (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (F.least(r, s) * (100 + percent) >= (n + m) * percent)
    first = index.where(F.col("id") != F.col("hub")).where(fits(F.col("n"), F.col("hub_n"), F.col("rest"), F.col("hub_rest"))).select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    links = written(_links(sets, written(first), percent))
    parts = written(connected_components(links))
    # what still lies apart: n-grams that meet in several components, whose largest one is left out on one side
    placed = index.select("gram", "id", "n", "rest").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    shares = placed.groupBy("gram", "component").agg(F.count("*").alias("c"))
    mixed = shares.groupBy("gram").agg(F.count("*").alias("parts"), F.max(F.struct("c", "component")).alias("top")).where("parts > 1").select("gram", F.col("top.component").alias("largest"))
    apart = written(placed.join(mixed, "gram"))
    a = apart.where("component <> largest").select("gram", F.col("id").alias("a"), F.col("n").alias("an"), F.col("rest").alias("ar"), F.col("component").alias("ac"))
    b = apart.select("gram", F.col("id").alias("b"), F.col("n").alias("bn"), F.col("rest").alias("br"), F.col("component").alias("bc"))
    rest = a.join(b, "gram").where(F.col("ac") != F.col("bc")).where(fits(F.col("an"), F.col("bn"), F.col("ar"), F.col("br")))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = _links(sets, written(rest), percent)
    whole = connected_components(links.union(more))
    members = sets.select("id", "digest", "least").join(whole, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    named = members.join(least, "component").select("digest", "component_id")
    alone = F.when(F.col("component_id") == (1 << 63) - 1, None).otherwise(F.col("component_id"))
    return base.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select("doc_id", "n_shingles", F.coalesce(alone, "doc_id").alias("component_id"))


def keep_one_per_component(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs with all its columns, whatever their names: of each component the first row by doc_id (null last) and the text's digest.

    Rows without words (null, empty, blank) stay, of equal ones (doc_id and text) one; so it is with repeated rows, and one with
    null doc_ids is a row like any other. An empty table stays empty."""
    odd = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    rows, key = docs, "doc_id"
    if not odd.isEmpty():  # doc_id doesn't tell rows apart: their place in the order does
        key = free_name(docs, "place")
        rows = docs.dropDuplicates(["doc_id", "text"]).orderBy(F.col("doc_id").asc_nulls_last(), F.md5("text"))
        rows = written(rows.select("*", F.monotonically_increasing_id().alias(key)))
    named = written(jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"), size, percent))
    stay = named.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key))
    return rows.join(stay, key, "left_semi").select(*map(quoted, docs.columns))
