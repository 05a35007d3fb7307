"""N-gram Jaccard self-join by adaptive multi-match prefixes (operator 6).

A document is the set of its distinct shingles; two link when 100 * intersection >= percent * union.

Documents of equal sets form a class, and only one of each goes on. A class orders its shingles from rare to frequent,
by counts over all documents in a hashed table of fixed size. Sets that link share the rarest shingles: with
a = ceil(percent * n / 100), the first n - a + m shingles of both have m in common. m = 1 is the usual prefix; a class
whose prefix holds frequent shingles, and so would have many candidates, takes a longer one and asks for more matches
(m is the one of least estimated cost), and a pair must share the smaller m of the two.

Pairs inside a large group of near copies are not made as rows. Classes that share prefix shingles with the same pivot
are put in one group, which is only a way to divide the work. Inside a large group all classes are compared with one, its
head, that is close to most. Where links are counted, they go on as their differences from it (two intersections with the
head, and that of the differences, give the intersection of two sets), and all pairs of the group then meet in blocks of
bounded size, each block a product of bit matrices, and each class sums the rows of those it links to; where only components are
asked for, the classes that do not link to the head meet the whole group. All other pairs come from the prefixes, and are
compared if the shingles they share there, and all that lie behind the prefixes, would be enough. Nothing is capped: with
links, every pair that can link is compared exactly; without, all but pairs already known to be connected.

Edge cases: a null or empty text has an empty set and links with nothing; shorter texts than a shingle are one; copies
are one class; a null identifier counts as larger than any other; rows of one identifier with different texts are
different documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import forget, join_counted, table, written
from .graph import components
from .marks import marks
from .sums import summed
from .words import WORD_BASE, U, Words, mix, running, signed, slices, spans

SHINGLE, PERCENT = 4, 85
COUNTERS = 1 << 18
#: Matches asked for, and what a comparison costs per shingle against reading a posting.
MATCHES, VERIFY = (1, 2, 3, 4, 6, 8, 12, 16), 1 / 8
BLOCK = 1024
#: Where only components are asked for, whole sets meet, in blocks of at most this many.
WHOLE_BLOCK = 256
#: Groups of more classes than this are compared in blocks.
SMALL_GROUP = 16
NO_ID = (1 << 63) - 1


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every shingle, repeats included. Fewer than k words are one shingle."""
    s = running(w.hashes(), WORD_BASE)
    at, per = w.window_starts(k)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    doc = np.concatenate([np.repeat(np.arange(len(per)), per), short])
    got = np.concatenate([mix(spans(s, at, at + k, WORD_BASE)), mix(mix(spans(s, w.first[short], w.first[short + 1], WORD_BASE)) + w.counts[short].astype(U))])
    return doc, got


def _counts(k: int):
    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(COUNTERS, np.int64)
        for cut in slices(batches, "text"):
            _, h = shingles(Words(cut.column("text"), lower=True), k)
            out += np.bincount((h % U(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        return out

    return count


def sets(w: Words, k: int, freq: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(ends, hashes): each document's distinct shingles, from rare to frequent."""
    doc, h = shingles(w, k)
    f = freq[(h % U(COUNTERS)).astype(np.int64)] if freq is not None else None
    order = np.lexsort((h, doc) if f is None else (h, f, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(w.counts)))]), h[new]


def matches(n: np.ndarray, keep: np.ndarray, ends: np.ndarray, excess: np.ndarray) -> np.ndarray:
    """Number of matches to ask for, per document. excess: estimated other documents of each ordered shingle."""
    run = np.concatenate([[0.0], np.cumsum(excess)])
    best, least = np.ones(len(n), np.int64), np.full(len(n), np.inf)
    for m in MATCHES:
        size = n - keep + m
        ok = (size <= n) | (m == 1)
        met = run[ends[:-1] + np.minimum(size, n)] - run[ends[:-1]]
        cost = np.where(ok, size + met + VERIFY * n * met / m, np.inf)
        best, least = np.where(cost < least, m, best), np.minimum(cost, least)
    return best


def _describe(k: int, percent: int, freq: np.ndarray):
    usual = freq.mean() + 3 * np.sqrt(freq.mean())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, "text", 1 << 20):
            ends, h = sets(Words(cut.column("text"), lower=True), k, freq)
            n = np.diff(ends)
            keep = -(-percent * n // 100)
            m = matches(n, keep, ends, np.maximum(freq[(h % U(COUNTERS)).astype(np.int64)] - usual, 0))
            size = np.minimum(n - keep + m, n)
            run1, run2 = (np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(c)))]) for c in (0x51ED270B, 0xA24BAED4))
            stops = np.concatenate([[0], np.cumsum(size)])
            at = np.arange(stops[-1]) - np.repeat(stops[:-1], size) + np.repeat(ends[:-1], size)
            yield pa.RecordBatch.from_arrays(
                [
                    cut.column("rid"), cut.column("th"), pa.array(n.astype(np.int64)), pa.array(signed(run1[ends[1:]] - run1[ends[:-1]])), pa.array(signed(run2[ends[1:]] - run2[ends[:-1]])),
                    pa.array(m.astype(np.int32)), pa.ListArray.from_arrays(pa.array(stops.astype(np.int32)), pa.array(signed(h[at]))),
                ],
                ["rid", "th", "n", "s1", "s2", "m", "prefix"],
            )

    return run


def _whole_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut in slices(batches, "text"):
            ends, h = sets(Words(cut.column("text"), lower=True), k, None)
            yield pa.RecordBatch.from_arrays([cut.column("node"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(signed(h)))], ["node", "shingles"])

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of left and right sets, by bit matrices over the shingles that recur."""
    lens = [len(x) for x in (*left, *right)]
    _, code, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    place = np.where(times > 1, np.cumsum(times > 1) - 1, -1)[code]
    row = np.repeat(np.arange(len(lens)), lens)
    width = int((times > 1).sum())
    out = np.zeros((len(left), len(right)), np.int32)
    for lo in range(0, width, 4096):
        part = (place >= lo) & (place < lo + 4096)
        m = np.zeros((len(lens), -(-min(4096, width - lo) // 64) * 64), bool)
        m[row[part], place[part] - lo] = True
        bits = np.packbits(m, axis=1).view(U).T.copy()
        for x in bits:
            out += np.bitwise_count(x[: len(left), None] & x[None, len(left) :])
    return out


def _cell_links(percent: int, count: bool):
    """Links of each cell: of its left classes with its right ones. A row (a, b, 0) is a link; of those in a cell only the
    ones are given that connect what was not connected in it. With `count`, a row (a, a, w) says that a links to w rows."""

    def links(rows: list[tuple], same: bool) -> list[tuple[int, int, int]]:
        left, right = [r for r in rows if r[1]], [r for r in rows if not r[1]]
        if not left or not right:
            return []
        column = lambda part, c: np.array([r[c] for r in part])
        (il, cl, nl, ml, wl), (ir, cr, nr, mr, wr) = ([column(part, c) for c in (0, 2, 3, 4, 6)] for part in (left, right))
        common = _shared([r[7] for r in left], [r[7] for r in right]) + ml[:, None] + mr[None] - rows[0][5]
        linked = (100 * common >= percent * (nl[:, None] + nr[None] - common)) & (il[:, None] != ir[None])
        out = []
        if count:
            sums = [(il, linked @ wr)] + [(ir, wl @ linked)] * (not same)
            out = [(x, x, w) for ids, ws in sums for x, w in zip(ids.tolist(), ws.tolist(), strict=True) if w]
        label = np.where(cr, 0, np.arange(1, len(right) + 1))  # of what is connected in the cell; the core is 0
        for i in np.flatnonzero((linked & ~(cl[:, None] & cr[None])).any(axis=1)).tolist():
            js = np.flatnonzero(linked[i])
            roots, at = np.unique(label[js], return_index=True)
            out += [(int(il[i]), int(ir[j]), 0) for r, j in zip(roots.tolist(), js[at].tolist(), strict=True) if r or not cl[i]]
            label[np.isin(label, roots)] = 0 if cl[i] else roots[0]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = (0, 0, 1), []
        for b in batches:
            found: list[tuple[int, int, int]] = []
            keys = list(zip(*(b.column(c).to_pylist() for c in ("grp", "open_block", "block")), strict=True))
            values = b.column("diff")
            ends, flat = values.offsets.to_numpy(), values.values.to_numpy()
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in ("node", "side", "core", "n", "met", "h", "rows")), strict=True)):
                if keys[i] != key:
                    found += links(rows, key[1] == key[2])
                    key, rows = keys[i], []
                rows.append((*row, flat[ends[i] : ends[i + 1]].copy()))
            yield _edges(found)
        yield _edges(links(rows, key[1] == key[2]))

    return run


def _edges(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["a", "b", "w"])


def _linked(percent: int):
    common = F.size(F.array_intersect("x", "y"))
    return 100 * common >= percent * (F.size("x") + F.size("y") - common)


def near_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT, links: bool = False, small_group: int | None = SMALL_GROUP) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, and `first`: whether the row's text is the
    component's representative (the smallest id; of its rows with different texts, the one with the least hash).
    Groups of more classes than `small_group` are compared in blocks; with None all pairs come from the prefixes.
    With `links` also class_id, the smallest id of the rows with the same set, and n_links, the number of other rows that
    the row links to, those of its class among them."""
    small_group = (1 << 62) if small_group is None else small_group
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("rid"), F.xxhash64("text").alias("th"), "text")
    freq = summed(rows.select("text"), _counts(k), COUNTERS)
    described = written(rows.mapInArrow(_describe(k, percent, freq), "rid long, th long, n long, s1 long, s2 long, m int, prefix array<long>"))
    members = written(described.drop("m", "prefix"))
    sets_of = described.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min(F.struct("rid", "th")).alias("rep"), F.first("m").alias("m"), F.first("prefix").alias("prefix"), F.count("*").alias("rows"))
    sets_of = written(sets_of.withColumn("node", F.monotonically_increasing_id()))  # written, so the numbers stay
    forget(described)
    classes = written(sets_of.drop("m", "prefix"))
    postings = sets_of.select("node", "n", "m", F.explode("prefix").alias("tok"))
    pivots = written(postings.groupBy("tok").agg(F.min("node").alias("pivot"), F.count("*").alias("rows")).filter("rows > 1"))
    # postings of tokens that no other class has are left out before anything moves
    hits = written(join_counted(marks(pivots, "tok").keep(postings, "tok"), pivots, ["tok"], pivots.agg(F.sum("rows")).first()[0] or 0))
    forget(sets_of)

    # groups: classes that share prefix shingles with one pivot
    near = hits.filter("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("c"), F.max("m").alias("m"))
    near = near.filter("c >= 2 and c >= m").groupBy("node").agg(F.max(F.struct("c", (-F.col("pivot")).alias("p"))).alias("best"))
    groups = components(near.select(F.col("node").alias("a"), (-F.col("best.p")).alias("b"))).withColumnRenamed("root", "grp")
    large = groups.groupBy("grp").agg(F.count("*").alias("size")).filter(F.col("size") > small_group).select("grp")
    groups = written(groups.join(large, "grp"))
    # the class of a group that is close to most: the one whose prefix is shared the most
    share = hits.join(groups, "node").groupBy("grp", "node").agg((F.count("*") / F.max(F.col("n") - F.ceil(F.col("n") * percent / 100) + F.col("m"))).alias("r"))
    heads = share.groupBy("grp").agg(F.max(F.struct("r", (-F.col("node")).alias("p"))).alias("best")).select("grp", (-F.col("best.p")).alias("head"))

    # pairs outside the large groups that share enough prefix shingles: a class without a group is one of its own
    tagged = hits.join(groups, "node", "left").select("tok", "node", "n", "m", F.coalesce("grp", -F.col("node") - 1).alias("grp"))
    mixed = tagged.groupBy("tok").agg(F.min("grp").alias("g1"), F.max("grp").alias("g2")).filter("g1 < g2").select("tok")
    tagged = written(tagged.join(mixed, "tok", "left_semi"))
    one, two = (tagged.select("tok", *(F.col(c).alias(c + s) for c in ("node", "n", "m", "grp"))) for s in "12")
    fits = (F.col("node1") < F.col("node2")) & (F.col("grp1") != F.col("grp2")) & (percent * F.greatest("n1", "n2") <= 100 * F.least("n1", "n2"))
    # shingles behind the prefix, and the intersection that a link needs: percent * (n1 + n2) / (100 + percent)
    behind = lambda k: F.least(F.floor((percent * F.col(f"n{k}") + 99) / 100), F.col(f"n{k}")) - F.col(f"m{k}")
    needed = F.ceil(percent * (F.col("n1") + F.col("n2")) / F.lit(100 + percent))
    pairs = one.join(two, "tok").filter(fits).groupBy("node1", "node2").agg(F.count("*").alias("c"), F.first(F.least("m1", "m2")).alias("m"), F.first(F.greatest(behind(1), behind(2), F.lit(0))).alias("behind"), F.first(needed).alias("needed"))
    pairs = written(pairs.filter("c >= m and c + behind >= needed").select("node1", "node2"))

    # whole sets of all classes that are compared
    wanted = groups.select("node").unionByName(pairs.select(F.col("node1").alias("node"))).unionByName(pairs.select(F.col("node2").alias("node"))).distinct()
    wanted = written(classes.join(wanted, "node").select("node", F.col("rep.rid").alias("rid"), F.col("rep.th").alias("th")).withColumn("key", F.xxhash64("rid", "th")))
    texts = marks(wanted, "key").keep(rows.select(F.xxhash64("rid", "th").alias("key"), "rid", "th", "text"), "key")
    texts = texts.join(wanted.drop("key"), ["rid", "th"]).select("node", "text")
    if not members.groupBy("rid", "th").agg(F.count("*").alias("rows")).filter("rows > 1").isEmpty():  # repeated rows
        texts = texts.dropDuplicates(["node"])
    whole = written(texts.mapInArrow(_whole_sets(k), "node long, shingles array<long>"))

    xs, ys = whole.select(F.col("node").alias("node1"), F.col("shingles").alias("x")), whole.select(F.col("node").alias("node2"), F.col("shingles").alias("y"))
    across = written(pairs.join(xs, "node1").join(ys, "node2").filter(_linked(percent)).select(F.col("node1").alias("a"), F.col("node2").alias("b")))

    inside = whole.join(groups, "node").join(heads, "grp")
    star = inside.select("grp", "head", "node", F.col("shingles").alias("x")).join(whole.select(F.col("node").alias("head"), F.col("shingles").alias("y")), "head")
    both = (F.size("x").cast("long").alias("n"), F.size(F.array_intersect("x", "y")).cast("long").alias("met"), F.size("y").cast("long").alias("h"))
    differ = (*both, F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("diff")) if links else ()
    core = written(star.select("grp", "node", "head", ((F.col("node") == F.col("head")) | _linked(percent)).alias("core"), *differ))
    block = BLOCK if links else min(BLOCK, WHOLE_BLOCK)
    # blocks: the classes that are still open, or all of them if links are counted, against all classes of their group
    still = F.lit(True) if links else ~F.col("core")
    sizes = core.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.ceil(F.count_if(still) / block).cast("int").alias("open_blocks")).filter("open_blocks > 0")
    weights = classes.select("node", "rows")
    if links:
        ready = core.join(sizes, "grp").join(weights, "node")
    else:  # a whole set is its difference from the empty one
        zero = F.lit(0).cast("long")
        ready = whole.join(core.join(sizes, "grp"), "node").withColumns({"n": F.size("shingles").cast("long"), "met": zero, "h": zero, "rows": zero}).withColumnRenamed("shingles", "diff")
    mod = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    kept = ("grp", "node", "core", "n", "met", "h", "rows", "diff")
    # with links the same classes are on both sides, and a pair of blocks meets once
    lefts = ready.filter(still).select(*kept, F.lit(True).alias("side"), mod("open_blocks").alias("open_block"), F.explode(F.sequence(mod("open_blocks") if links else F.lit(0), F.col("blocks") - 1)).alias("block"))
    rights = ready.select(*kept, F.lit(False).alias("side"), F.explode(F.sequence(F.lit(0), mod("blocks") if links else F.col("open_blocks") - 1)).alias("open_block"), mod("blocks").alias("block"))
    cell = ["grp", "open_block", "block"]
    met = written(lefts.unionByName(rights).repartition(*cell).sortWithinPartitions(*cell).mapInArrow(_cell_links(percent, links), "a long, b long, w long"))

    edges = across.unionByName(core.filter("core and node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))).unionByName(met.filter("a <> b").select("a", "b"))
    roots = components(edges)
    named = classes.select("s1", "s2", "n", "node", "rep", "rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    extra = []
    if links:
        ways = across.unionByName(across.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(weights.withColumnRenamed("node", "b"), "b").select("a", F.col("rows").alias("w"))
        counts = written(ways.unionByName(met.filter("a = b").select("a", "w")).groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("w")))
        named = named.join(counts, "node", "left").withColumn("n_links", F.col("rows") - 1 + F.coalesce("w", F.lit(0)))
        extra = ["rep", "n_links"]
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    ids = named.join(least, "root").select("s1", "s2", "n", "least", *extra)
    found = members.select("rid", "th", "n", "s1", "s2").join(ids, ["s1", "s2", "n"], "left").withColumn("least", F.coalesce("least", F.struct("rid", "th")))
    plain = lambda c: F.when(c != NO_ID, c)
    first = (F.col("rid") == F.col("least.rid")) & (F.col("th") == F.col("least.th"))
    more = (plain(F.coalesce("rep.rid", "rid")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")) if links else ()
    return found.select(plain(F.col("rid")).alias("doc_id"), F.col("n").alias("n_shingles"), plain(F.col("least.rid")).alias("component_id"), F.col("th").alias("text_hash"), first.alias("first"), *more)


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component, all columns as they are. Of repeated rows one stays."""
    from pyspark.sql import Window

    identity = lambda i, th: F.struct(F.coalesce(i.cast("long"), F.lit(NO_ID)).alias("id"), th.alias("th")).alias("key")
    stay = near_components(docs, text, doc_id, k, percent).filter("first").select(identity(F.col("doc_id"), F.col("text_hash")))
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), identity(F.col(doc_id), F.xxhash64(F.coalesce(F.col(text), F.lit("")))))
    one = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(1)))
    return keyed.join(stay, "key", "left_semi").withColumn("n", one).filter("n = 1").select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), links=True).select("doc_id", "n_shingles", "component_id")


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') as g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) as i from w where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
walk as (select doc_id as node, doc_id as root from n union select e.b, walk.root from walk join e on e.a = walk.node)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(r.root, doc_id) as component_id
from documents left join n using (doc_id) left join (select node as doc_id, min(root) as root from walk group by node) r using (doc_id)
"""

QUERIES = {"op6_jaccard_join": op6_jaccard_join}
ORACLES = {"op6_jaccard_join": SQL}
