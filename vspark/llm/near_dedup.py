"""Operator 2: near-duplicate classes by DartMinHash signatures and banded joining."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import with_computed
from .common import cut, doc_key, ship

SHINGLE = 5
SIMILARITY = 0.8
#: Signature of BANDS * ROWS coordinates: two texts of similarity 0.8 share a band with probability 0.9993, of 0.85 with 0.99999.
BANDS, ROWS = 24, 6
#: Texts, and bytes of their stretches' hashes, in a block of a bucket as expected; a bucket of more is dealt by blocks.
BLOCK = 250
BLOCK_BYTES = 8 << 20
#: Texts of a bucket that each of its texts is compared with first.
LEADERS = 4
#: Entries of a task's table of word hashes; when it is full it is emptied, which changes no result.
CACHE = 100_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x):
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)) * 2.0**-53


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: _Hashes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct stretches of SHINGLE words, lower case, and how often each occurs: its weight. Texts of fewer words are one stretch, texts without a word none."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0)
    ids = np.fromiter(map((_Hashes() if hashes is None else hashes).__getitem__, words), np.uint64, len(words))
    n = max(1, len(ids) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(ids))):
        h = h * _A + ids[k : k + n]
    distinct, counts = np.unique(_mixed(h), return_counts=True)
    return distinct, counts.astype(float)


def _cumulative(area: float) -> np.ndarray:
    p, out = np.exp(-area), []
    for n in range(16):
        out.append(p)
        p *= area / (n + 1)
    return np.cumsum(out)


#: Stretches of the rank axis in rising order: first rank, width of a field, number of fields. Fields are at most 1 wide.
_LEVELS = [(0.0, 0.25, 1), (0.25, 0.25, 1), (0.5, 0.5, 1)] + [(float(2**i), 1.0, 2**i) for i in range(16)]
_POISSON = {w: _cumulative(w) for w in (0.25, 0.5, 1.0)}


def dart_signature(elements: np.ndarray, weights: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """DartMinHash: for each of `size` coordinates the rank of the earliest dart within the weighted set.

    An element's region is [0, weight) by ranks. It is cut into fields, one unit of weight by one stretch of ranks; each field of
    an element gets, from hashes alone, a Poisson number of darts, each with a coordinate, a position and a rank. So two sets see the
    same darts where their regions overlap, and a coordinate's earliest darts are the same with a probability of
    the weighted Jaccard similarity. Stretches are thrown in rising order until each coordinate has a dart;
    later ones cannot be earlier. Expected darts: about size * ln(size), whatever the number of elements beyond.
    """
    whole = np.ceil(weights).astype(np.int64)
    cell = np.repeat(np.arange(len(elements)), whole)
    unit = np.arange(len(cell)) - np.repeat(np.cumsum(whole) - whole, whole)
    room = weights[cell] - unit
    seeds = _mixed(elements[cell] + (unit + 1).astype(np.uint64) * _B)
    out = np.full(size, np.inf)
    for level, (low, width, fields) in enumerate(_LEVELS):
        for first in range(0, fields, step := max(1, 200_000 // len(cell))):
            field = np.arange(first, min(fields, first + step), dtype=np.uint64)
            h = _mixed(seeds[:, None] + (field + np.uint64((level + 1) << 20))[None] * _A)
            number = np.searchsorted(_POISSON[width], _unit(h).ravel(), side="right")
            hit = np.flatnonzero(number)
            at = np.repeat(hit, number[hit])
            nth = np.arange(len(at)) - np.repeat(np.cumsum(number[hit]) - number[hit], number[hit])
            dart = _mixed(h.ravel()[at] + (nth + 1).astype(np.uint64) * _C)
            rank = low + width * (at % len(field) + first + _unit(dart))
            coordinate = (_mixed(dart + _A) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)
            inside = _unit(_mixed(dart + _B)) < room[at // len(field)]
            np.minimum.at(out, coordinate[inside].astype(np.int64), rank[inside])
        if np.isfinite(out).all():
            break
    return out


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One key a band, from all of its coordinates and its number."""
    rows = np.ascontiguousarray(signature).view(np.uint64).reshape(bands, -1)
    h = np.arange(1, bands + 1, dtype=np.uint64) * _C
    for k in range(rows.shape[1]):
        h = _mixed(h * _A + rows[:, k])
    return h.view(np.int64)


def _keys_of(text: str | None, hashes: _Hashes | None = None) -> tuple[list[int] | None, int]:
    """Band keys, and the number of stretches."""
    elements, weights = shingles(text, hashes)
    return band_keys(dart_signature(elements, weights)).tolist() if len(elements) else None, int(weights.sum())


def _cells(text: str | None, hashes: _Hashes | None = None) -> bytes:
    """The multiset of stretches as sorted hashes, the nth occurrence of one being an element of its own."""
    elements, weights = shingles(text, hashes)
    counts = weights.astype(np.int64)
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.sort(_mixed(np.repeat(elements, counts) + nth.astype(np.uint64) * _A)).tobytes()


def _per_task(f):
    hashes = _Hashes()
    return lambda text: f(text, hashes)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < similarity * len(b) - 1e-9:
        return False
    at = np.searchsorted(b, a)
    shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return shared >= similarity * (len(a) + len(b) - shared) - 1e-9


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float = SIMILARITY, joined: list | None = None) -> Iterator[tuple[int, int]]:
    """Links that join each set of texts of at least this weighted Jaccard similarity, as positions: among left, or between left and right.

    Every text of the one side is held against all others at once, over an index of their elements; once all are joined the rest is
    known. joined: a name for each text; those of one name are joined already.
    """
    texts = left + (right or [])
    sizes = np.array([len(x) for x in texts])
    first: dict = {}
    parent = [first.setdefault(name, i) for i, name in enumerate(joined)] if joined else list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    parts = len(set(parent))
    if parts < 2:
        return
    vocabulary, ids = np.unique(np.concatenate(texts), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(len(vocabulary), np.int32)
    for i in range(len(left)):
        own = ids[starts[i] : starts[i] + sizes[i]]
        lo = len(left) if right is not None else i + 1
        if lo >= len(texts):
            break
        mark[own] = 1
        shared = np.add.reduceat(mark[ids[starts[lo] :]], starts[lo:] - starts[lo])
        mark[own] = 0
        for k in np.flatnonzero(shared >= similarity * (sizes[lo:] + sizes[i] - shared) - 1e-9):
            a, b = root(i), root(lo + int(k))
            if a != b:
                parent[max(a, b)] = min(a, b)
                parts -= 1
                yield i, lo + int(k)
        if parts == 1:
            return


def _batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([max(x) for x in links], pa.int64()), pa.array([min(x) for x in links], pa.int64())], names=["u", "v"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        columns = [b.column(i) for i in range(b.num_columns)]
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in columns)


def _link_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each text with the first of its bucket's leaders that it is similar to. Rows (key, block, follows, node, cells) come sorted, leaders first; they alone are held."""
    leaders: list[tuple[int, np.ndarray]] = []
    at, out = None, []
    for key, block, follows, node, cells in _rows(batches):
        if (key, block) != at:
            at, leaders = (key, block), []
        own = np.frombuffer(cells, np.uint64)
        met = next((x for x, other in leaders if similar(own, other)), None)
        if met is not None:
            out.append((node, met))
        if not follows:
            leaders.append((node, own))
        if len(out) > 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _link_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (key, low, high, mine, node, part, cells) that come sorted; one group is held at a time, of two blocks at most. Texts of one part are joined already."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        low, high = rows[0][1], rows[0][2]
        left = [r for r in rows if r[3] == low]
        right = None if low == high else [r for r in rows if r[3] == high]
        both = left + (right or [])
        if not left or right == [] or len(both) < 2:
            return []
        cells = lambda rs: [np.frombuffer(r[6], np.uint64) for r in rs]
        return [(both[i][4], both[j][4]) for i, j in linked(cells(left), None if right is None else cells(right), joined=[r[5] for r in both])]

    group, at, out = [], None, []
    for row in _rows(batches):
        if row[:3] != at:
            if group:
                out += links(group)
            group, at = [], row[:3]
        group.append(row)
        if len(out) > 10_000:
            yield _batch(out)
            out = []
    if group:
        out += links(group)
    yield _batch(out)


def components(links: DataFrame) -> DataFrame:
    """(u, root) for the nodes of links (u, v) that are not themselves the least of their component.

    Large-star and small-star steps in turn: each node's larger, then each node's smaller neighbours are tied to the least
    one around it, until nothing changes and all are tied to their root; the number of rounds grows with the logarithm
    of the longest path. Each round is a minimum by node and a join, cut by a checkpoint.
    """

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    edges = cut(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = cut(tied.select("e.*").filter("u <> v").distinct())
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select("u", F.col("v").alias("root"))


def _hashed(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns of docs with the text's hashes h1 and h2, and with doc_id as no_id and id, which are never null. doc_id: a number or text; of any other type its text."""
    own, none = doc_key(docs)
    added = [F.xxhash64("text").alias("__h1"), F.xxhash64(F.lit(7), F.col("text")).alias("__h2"), F.col("doc_id").isNull().alias("__no_id"), F.coalesce(own, none).alias("__id")]
    return docs.select(*[f"`{c}`" for c in columns], *added)


#: What tells a row up to equal texts of one doc_id.
_KEY = ["__h1", "__h2", "__no_id", "__id"]


def _blocks(n: str, size: str, block: int) -> Column:
    """Blocks for n texts of `size` stretches."""
    return F.greatest(F.ceil(F.col(n) / F.lit(float(block))), F.ceil(F.col(size) * 8 / F.lit(float(BLOCK_BYTES)))).cast("int")


def _dealt(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def leader_links(members: DataFrame, cells: DataFrame, block: int) -> DataFrame:
    """Links (u, v) of each node with a leader of the largest bucket it is in: comparisons are linear in the nodes.

    members: key, node, n, size of the bucket. Leaders are the LEADERS least nodes of a bucket; each of its blocks has a copy of them.
    """
    nth = F.row_number().over(Window.partitionBy("key").orderBy("node"))
    leaders = members.withColumn("nth", nth).filter(F.col("nth") <= LEADERS)
    leaders = leaders.withColumn("block", F.explode(F.sequence(F.lit(0), _blocks("n", "size", block) - 1)))
    chosen = members.groupBy("node").agg(F.max(F.struct("n", "size", "key")).alias("b")).select("b.key", "node", "b.n", "b.size")
    chosen = chosen.select("key", _dealt(_blocks("n", "size", block)).alias("block"), F.lit(1).alias("follows"), "node")
    rows = leaders.select("key", "block", F.lit(0).alias("follows"), "node").unionByName(chosen)
    # A leader that chose its own bucket finds itself.
    rows = rows.join(cells, "node").select("key", "block", "follows", "node", "cells")
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "follows", "node")
    return rows.mapInArrow(_link_leaders, "u long, v long").filter("u <> v")


def open_links(members: DataFrame, roots: DataFrame, cells: DataFrame, block: int) -> DataFrame:
    """Links (u, v) between nodes of a bucket that roots (u, root) doesn't join: all of its texts, but those of its largest part are not held against each other.

    The largest part and the rest of a bucket are dealt by blocks of their own; each pair of blocks is a group, but for those within the
    largest part. So a bucket of one large part is linear in its texts; only texts that nothing joins are all held against each other.
    """
    parts = members.join(roots.select(F.col("u").alias("node"), "root"), "node", "left").withColumn("part", F.coalesce("root", "node"))
    sizes = parts.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n_part"), F.sum("own").alias("size_part"))
    whole = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n_part", "part", "size_part")).alias("big"), F.sum("n_part").alias("n_all"), F.sum("size_part").alias("size_all"))
    whole = whole.filter("parts > 1").select("key", F.col("big.part").alias("big"), F.col("big.n_part").alias("n_big"), F.col("big.size_part").alias("size_big"), (F.col("n_all") - F.col("big.n_part")).alias("n_rest"), (F.col("size_all") - F.col("big.size_part")).alias("size_rest"))
    each = parts.select("key", "node", "part").join(whole, "key")
    # Blocks of the largest part count up from 0, those of the rest down from -1.
    bigs, rests = F.sequence(F.lit(0), _blocks("n_big", "size_big", block) - 1), F.sequence(-_blocks("n_rest", "size_rest", block), F.lit(-1))
    inside = F.col("part") == F.col("big")
    each = each.select("key", "node", "part", F.when(inside, _dealt(F.size(bigs))).otherwise(-1 - _dealt(F.size(rests))).alias("mine"), F.explode(F.when(inside, rests).otherwise(F.concat(rests, bigs))).alias("other"))
    rows = each.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "part")
    rows = rows.join(cells, "node").select("key", "low", "high", "mine", "node", "part", "cells")
    rows = rows.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node")
    return rows.mapInArrow(_link_groups, "u long, v long")


def text_classes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """__h1, __h2, representative, class_id of every distinct text but null, and `first`: whether it is the class's text of the least doc_id.

    A text is a node by itself, whatever the doc_ids of its rows; doc_id only gives the order. Texts without doc_id come
    after all others, ties go by the text's hashes, so that each class has just one first text.
    """
    ship(docs.sparkSession)
    named = _hashed(docs.filter("text is not null"), "text")
    keyed = with_computed(named, ["text"], _KEY, T.StructType([T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("own", T.LongType())]), lambda: _per_task(_keys_of))
    found = keyed.groupBy("__h1", "__h2").agg(F.min(F.struct("__no_id", "__id", "keys", "own")).alias("f"))
    # The hashes stay with the representative's id for the last join; texts are not read again for it.
    found = cut(found.select("__h1", "__h2", "f.__no_id", "f.__id", "f.keys", "f.own", F.monotonically_increasing_id().alias("node")))
    banded = found.select(F.explode("keys").alias("key"), "node", "own")
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all"))
    single = buckets.filter("n > 1").groupBy("n", "size", "lo", "hi", "all").agg(F.min("key").alias("key"))
    members = cut(banded.join(single.select("key", "n", "size"), "key"))
    # One row of each text is compared, one with the representative's id.
    representatives = found.select(*_KEY, "node").join(members.select("node").distinct(), "node", "left_semi")
    compared = named.join(representatives, _KEY).dropDuplicates(_KEY)
    cells = cut(with_computed(compared, ["text"], ["node"], T.StructType([T.StructField("cells", T.BinaryType())]), lambda: _per_task(lambda text, hashes: (_cells(text, hashes),))))
    links = cut(leader_links(members, cells, block))
    links = links.unionByName(open_links(members, components(links), cells, block))
    roots = components(links)
    tied = roots.unionByName(roots.select(F.col("root").alias("u"), "root").distinct())
    ids = tied.join(found.select(F.col("node").alias("u"), F.struct("__no_id", "__id", "__h1", "__h2").alias("order")), "u")
    classes = ids.select("u", "order", "root").join(ids.groupBy("root").agg(F.min("order").alias("least")), "root").select("u", "order", "least")
    texts = found.select(*_KEY, "node").join(classes, F.col("node") == F.col("u"), "left")
    id_of = lambda no, i: F.when(~F.col(no), F.col(i))
    alone = F.col("least").isNull()
    class_id = F.when(alone, id_of("__no_id", "__id")).otherwise(id_of("least.__no_id", "least.__id"))
    return texts.select("__h1", "__h2", id_of("__no_id", "__id").alias("representative"), class_id.alias("class_id"), (alone | (F.col("order") == F.col("least"))).alias("first"))


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, representative (least doc_id of equal texts), class_id (least doc_id of the class) of every row.

    Classes are the connected components of the links between texts whose stretches of five words have a weighted Jaccard
    similarity of 0.8 or more. Equal texts are one text from the start: the signatures go through a minimum by text
    hash, so that groups of copies of any size never meet in a task. Texts that share a band are compared exactly,
    over all their stretches: first each text with a few leaders of its largest bucket, then in every bucket the texts that
    are not joined by that. Buckets are dealt by blocks, by number and bytes of texts, so that no task holds a bucket, and none
    is cut short. Buckets of the same members are compared once.

    doc_id: a number or text; of any other type its text is returned. Null text: a class of its own (class_id its doc_id). Texts
    without a word: equal ones are one class, nothing else is. Texts of any length are read whole. Null doc_id: compared like any other; representative and class_id are null where no row of the equal texts,
    or of the class, has one. Several texts of one doc_id: each by itself. Repeated rows: equal texts. Empty
    tables: no rows. Other columns are not read.
    """
    classes = text_classes(docs, block).drop("first")
    with_text = _hashed(docs.filter("text is not null"), "doc_id").join(classes, ["__h1", "__h2"]).select("doc_id", "representative", "class_id")
    own = F.col("doc_id").cast(classes.schema["representative"].dataType)
    without = docs.filter("text is null").select("doc_id", own.alias("representative"), own.alias("class_id"))
    return with_text.unionByName(without)


def one_of_each_class(docs: DataFrame, **kwargs) -> DataFrame:
    """docs with one row of each class: one of its least doc_id, or one without doc_id if the class has no other.

    Null text: a class by doc_id; each row with neither text nor doc_id stays.
    """
    firsts = text_classes(docs, **kwargs).filter("first")
    firsts = firsts.select("__h1", "__h2", F.col("representative").isNull().alias("__no_id"), F.coalesce(F.col("representative"), doc_key(docs)[1]).alias("__id"))
    rows = _hashed(docs.filter("text is not null"), *docs.columns).join(firsts, _KEY, "left_semi").dropDuplicates(_KEY)
    without = docs.filter("text is null")
    columns = [f"`{c}`" for c in docs.columns]
    return rows.select(*columns).unionByName(without.filter("doc_id is not null").dropDuplicates(["doc_id"])).unionByName(without.filter("doc_id is null"))


def deduplicated(docs: DataFrame, **kwargs) -> DataFrame:
    """one_of_each_class(docs) without the rows that have no doc_id, for callers that know documents by it alone."""
    return one_of_each_class(docs, **kwargs).filter("doc_id is not null")


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
