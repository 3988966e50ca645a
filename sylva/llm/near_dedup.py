"""Near-duplicate documents by ProbMinHash, banding and exact verification (operator 10).

A document is its set of five-word shingles, weighted by how often each occurs. Each shingle is a
Poisson process whose rate is its weight; an arrival picks a register, and a register keeps the
shingle that arrives first. Two registers agree with the probability Jaccard similarity of the
weighted sets. Processing stops early: arrivals later than the latest register's time cannot matter.
Bands of registers give candidate pairs, and a pair is linked if the plain Jaccard similarity of the
two shingle sets, computed exactly, reaches the threshold. Repetition can make the weighted similarity
of such a pair as low as one likes, so a document that repeats a shingle has the bands of its unweighted
signature too; any other document's two signatures are the same. Classes are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import release
from .common import lean, stored, text_slices

WORDS = 5
SIMILARITY = 0.8
#: A pair at plain similarity 0.8 shares some unweighted band with probability 1 - (1 - 0.8**5)**25 > 0.9999.
BANDS, ROWS = 25, 5
#: Up to this many documents to verify are broadcast by their 16-byte digests (about 50 MB); more are joined by a shuffle.
BROADCAST_NODES = 500_000
#: Up to this many pairs to verify are broadcast (about 80 MB), and so are the documents at their first ends.
BROADCAST_PAIRS = 2_000_000
#: A shingle of more documents than this is joined by ranges of their sizes.
FREQUENT = 100
#: Up to this many links are labelled in one task (a few hundred MB); more by rounds of joins.
LOCAL_EDGES = 2_000_000

_MASK = 2**64 - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = np.random.default_rng(11).integers(0, 2**64, 256, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def _forget() -> None:
    """Powers take 16 bytes for each byte of the largest slice of texts so far."""
    _powers[:] = [x[:1].copy() for x in _powers]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for every word ([^ \\t-\\r]+) of all texts, and how many words each text has."""
    raw = b"".join(b"\n%b" % x.encode() for x in texts) + b"\n"
    data = np.frombuffer(raw, np.uint8)
    up, down = _powers_to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])
    edges = np.flatnonzero(np.diff(_SPACE[data].astype(np.int8)))
    starts, ends = edges[::2] + 1, edges[1::2] + 1  # the data begin and end with a space
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    begins = np.cumsum([0, *(len(x.encode()) + 1 for x in texts)])
    return hashes, np.diff(np.searchsorted(starts, begins))


def shingles(texts: list[str], words: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingle hashes, ascending, and how often each occurs.

    A text with fewer words is one shingle of them all; one without words has none.
    """
    hashes, counts = word_hashes(texts)
    scale = [np.uint64(pow(_BASE, 2 * k + 3, 2**64)) for k in range(words)]
    n = len(hashes) - words + 1
    windows = np.zeros(max(0, n), np.uint64)
    for k in range(words if n > 0 else 0):
        windows += hashes[k : k + n] * scale[k]
    windows = mix(windows)
    out, at = [], 0
    for count in counts.tolist():
        if count >= words:
            found = windows[at : at + count - words + 1]
        elif count:
            few = np.sum(hashes[at : at + count] * np.array(scale[:count], np.uint64), keepdims=True)
            found = mix(few + np.uint64(count))
        else:
            found = np.empty(0, np.uint64)
        out.append(np.unique(found, return_counts=True))
        at += count
    return out


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """ProbMinHash signatures: a row of ``size`` shingles for each weighted set (zeros for an empty one).

    A shingle's weight is 1 + ln(occurrences). Every shingle sends its arrivals in runs, longer for
    small sets, and drops out when its next one is later than all registers of its document.
    """
    sizes = np.array([len(s) for s, _ in sets])
    first = np.full(len(sets) * size, np.inf)
    winner = np.zeros(len(sets) * size, np.uint64)
    element = np.concatenate([s for s, _ in sets]) if sets else np.empty(0, np.uint64)
    rate = 1 + np.log(np.concatenate([c for _, c in sets])) if sets else np.empty(0)
    doc = np.repeat(np.arange(len(sets)), sizes)
    run = np.clip(-(-4 * size // np.maximum(sizes, 1)), 1, 256)[doc]
    now, sent = np.zeros(len(element)), np.zeros(len(element), np.int64)
    while len(element):
        ends = np.cumsum(run)
        of = np.repeat(np.arange(len(element)), run)
        number = np.arange(ends[-1]) - np.repeat(ends - run, run) + sent[of]
        draw = mix(element[of] + mix((number + 1).astype(np.uint64) * np.uint64(_BASE)))
        gap = -np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate[of]
        total = np.cumsum(gap)
        base = np.concatenate([[0.0], total[ends[:-1] - 1]])
        when = total - base[of] + now[of]
        register = (mix(draw ^ np.uint64(_BASE)) >> np.uint64(33)).astype(np.int64) % size + doc[of] * size
        early = when < first[register]
        when_e, register_e, of_e = when[early], register[early], of[early]
        np.minimum.at(first, register_e, when_e)
        won = when_e == first[register_e]
        winner[register_e[won]] = element[of_e[won]]
        now, sent = when[ends - 1], sent + run
        live = now < first.reshape(-1, size).max(1)[doc]
        element, rate, doc, run, now, sent = element[live], rate[live], doc[live], run[live], now[live], sent[live]
    return winner.reshape(-1, size)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band of each signature; keys of different bands differ."""
    parts = signature.reshape(len(signature), bands, rows)
    keys = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(_BASE), len(signature), axis=0)
    for k in range(rows):
        keys = mix(keys + parts[:, :, k])
    return keys.view(np.int64)


def all_keys(sets: list[tuple[np.ndarray, np.ndarray]], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct band keys of each weighted set and, where an element occurs more than once, of the set without weights; and the number of each key's set, ascending."""
    some = np.flatnonzero([len(s) > 0 for s, _ in sets])
    again = np.flatnonzero([len(c) > 0 and c.max() > 1 for _, c in sets])
    weighted = band_keys(signatures(sets, bands * rows), bands, rows)
    plain = band_keys(signatures([(sets[i][0], np.ones_like(sets[i][1])) for i in again], bands * rows), bands, rows) if len(again) else weighted[:0]
    new = plain != weighted[again]
    keys = np.concatenate([weighted[some].ravel(), plain[new]])
    owners = np.concatenate([np.repeat(some, bands), np.repeat(again, new.sum(1))])
    order = np.argsort(owners, kind="stable")
    return keys[order], owners[order]


def _digests(docs: DataFrame, text: Column, bands: int, rows: int) -> DataFrame:
    """(doc_id, md5, n, bands) of each row, with a number ``uid``; n is its count of distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(2), rows=128, chars=500_000):
                sets = shingles(texts)
                n = np.array([len(s) for s, _ in sets])
                keys, owners = all_keys(sets, bands, rows)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=len(sets)))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n, pa.int32()), lists], ["doc_id", "md5", "n", "bands"])

    source = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("md5"), text.alias("text"))
    out = source.mapInArrow(lean(run, _forget), "doc_id bigint, md5 binary, n int, bands array<bigint>")
    return stored(out.withColumn("uid", F.monotonically_increasing_id()), "digests")


def _sets(docs: DataFrame, text: Column, wanted: DataFrame) -> DataFrame:
    """(node, shingles) for the nodes of ``wanted`` (node, doc_id, md5); only their texts reach Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(1), rows=128, chars=500_000):
                sets = [s for s, _ in shingles(texts)]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["node", "shingles"])

    wanted = wanted.select("node", F.col("doc_id").alias("_id"), F.col("md5").alias("_md5"))
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    source = docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("md5"), text.alias("text"))
    found = source.join(wanted, (F.col("md5") == F.col("_md5")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return found.select("node", "text").mapInArrow(lean(run, _forget), "node bigint, shingles array<bigint>")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) for every node of an edge (a, b) that is not its component's least node.

    Up to ``local_edges`` edges (16 bytes each) are labelled in one task. Beyond that every task
    contracts the edges that it has to stars, and then large-star and small-star steps alternate
    (Kiveris et al., 2014) until nothing changes: two aggregations and joins over edges, none of which
    gathers a node's neighbours. Least neighbours are stored so that the join with a hub's edges can
    be split. Both ways give the same rows.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "edges")
    if edges.count() <= local_edges:
        return stored(edges.repartition(1).mapInArrow(lean(_contract), "u bigint, v bigint"), "components").select(F.col("u").alias("node"), F.col("v").alias("root"))
    edges = stored(edges.mapInArrow(lean(_contract), "u bigint, v bigint").distinct(), "edges")
    mark = _fingerprint(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-edges")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.distinct(), "edges")
        before, mark = mark, _fingerprint(edges)
        if before == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars around the least node of each of their components."""
    held = list(batches)
    if not held:
        return
    table = pa.Table.from_batches(held)
    nodes, ends = np.unique(np.concatenate([table.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    u, v = ends[: table.num_rows], ends[table.num_rows :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        for x in (label[u], label[v], u, v):
            np.minimum.at(new, x, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[at]), pa.array(nodes[label[at]])], ["u", "v"])


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the similarity. Where pairs are few enough to broadcast, what moves is a set for each pair and one for each document that is first in a pair."""
    firsts = stored(pairs.select(F.col("a").alias("node")).distinct(), "ends")
    held = pairs
    if pairs.count() <= BROADCAST_PAIRS:
        firsts, held = F.broadcast(firsts), F.broadcast(pairs)
    with_b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")).join(held, "b")
    with_a = sets.join(firsts, "node", "left_semi").select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    both = with_b.join(with_a, "a")
    found = both.withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return stored(found.where(F.col("shared") >= F.lit(similarity) * (F.size("sa") + F.size("sb") - F.col("shared"))).select("a", "b"), "linked")


def _prefixes(sets: DataFrame, rest: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """For the documents ``rest`` (node): (s, node, n, p), their prefixes, and (node, n, c), how many of their n shingles another of them has.

    With shingles in ascending order of how many of these documents have them, two sets of n and m
    shingles that reach similarity t have a common one among the first n - ceil(t n) + 1 and
    m - ceil(t m) + 1; p is a shingle's place from 0.
    """
    t = F.lit(similarity)
    each = sets.join(rest, "node").select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    several = stored(each.groupBy("s").agg(F.count("*").alias("k")).where("k > 1"), "several")
    own = Window.partitionBy("node")
    placed = each.join(several, "s").withColumn("c", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("k", "s")))
    placed = placed.withColumn("p", F.col("n") - F.col("c") + F.col("r") - 1).where(F.col("p") < F.col("n") - F.ceil(t * F.col("n") - 1e-9) + 1)
    prefix = stored(placed.select("s", "node", "n", "c", "p"), "prefixes")
    return prefix.drop("c"), prefix.groupBy("node").agg(F.first("n").alias("n"), F.first("c").alias("c"))


def _prefix_pairs(prefix: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of different components: every such pair that reaches the similarity is there.

    Position filter (Xiao et al., 2008): a common shingle at places p and q leaves room for
    min(n - p, m - q) in common, and for the first one that must be enough. So each place bounds the
    size of a partner from above, by ``most``, and of two documents the smaller one needs most >= n.
    Rare shingles come first, so what a document has for itself, or with few others, uses up its
    prefix: documents that share a frequent passage and fall short of the similarity have no room left
    when they come to it. Of a shingle's documents, those in its most common component are only met by
    the others. A shingle of few documents is joined as it is. For one of many the sizes that the
    larger document accepts are cut into dyadic ranges, and the pair meets at the range that holds
    the smaller one's size, so that only pairs within the bound are formed.
    """
    t = F.lit(similarity)
    prefix = stored(prefix.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    counts = prefix.groupBy("s", "root").agg(F.count("*").alias("k")).groupBy("s").agg(F.max(F.struct("k", "root")).alias("m"), F.sum("k").alias("all"))
    counts = counts.where("all > m.k").select("s", F.col("m.root").alias("common"), (F.col("all") > FREQUENT).alias("frequent"))
    most = F.floor((F.col("n") - F.col("p")) * (1 + t) / t + 1e-6).cast("int") - F.col("n")
    dealt = prefix.join(stored(counts, "common"), "s").withColumn("most", most)
    dealt = stored(dealt.select("s", "node", "root", "n", "most", (F.col("root") != F.col("common")).alias("minor"), "frequent"), "dealt")
    release(prefix)
    # the larger document is x; of two equal sizes, the one with the larger number
    x, y = (dealt.select(*(F.col(c).alias(f"{c}_{side}") for c in dealt.columns)) for side in ("x", "y"))
    y = y.where("most_y >= n_y")
    fits = (F.col("root_x") != F.col("root_y")) & (F.col("n_y") <= F.col("most_x")) & (F.col("n_x") <= F.col("most_y")) & (F.col("n_y") >= t * F.col("n_x") - 1e-9)
    fits = fits & ((F.col("n_y") < F.col("n_x")) | ((F.col("n_y") == F.col("n_x")) & (F.col("node_y") < F.col("node_x")))) & (F.col("minor_x") | F.col("minor_y"))
    few = x.where("not frequent_x").join(y.where("not frequent_y"), (F.col("s_x") == F.col("s_y")) & fits)
    x, y = x.where("frequent_x"), y.where("frequent_y")
    low, high = F.ceil(t * F.col("n_x") - 1e-9).cast("int"), F.least("n_x", "most_x")
    x = x.where(low <= high).withColumn("at_x", F.explode(_ranges(low, high + 1)))
    # a range is no longer than (1 - t) n for the larger and so (1 - t) / t n for the smaller document
    y = y.withColumn("at_y", F.explode(_above("n_y", (1 - t) / t * F.col("n_y") + 1)))
    same = (F.col("s_x") == F.col("s_y")) & (F.col("at_x") == F.col("at_y"))
    many = [a.join(b, same & fits) for a, b in ((x.where("minor_x"), y), (x.where("not minor_x"), y.where("minor_y")))]
    pair = F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")
    return few.select(*pair).unionByName(many[0].select(*pair)).unionByName(many[1].select(*pair)).distinct()


def _level(level: Column) -> Column:
    return F.pow(F.lit(2.0), level).cast("int")


def _ranges(low: Column, end: Column) -> Column:
    """The dyadic ranges, as structs (level, pos), whose union is [low, end)."""

    def at(level: Column) -> Column:
        size = _level(level)
        a, b = F.ceil(low / size).cast("int"), F.floor(end / size).cast("int")
        left, right = F.when((a < b) & (a % 2 == 1), a), F.when((a < b) & (b % 2 == 1), b - 1)
        return F.transform(F.array_distinct(F.array_compact(F.array(left, right))), lambda p: F.struct(level.alias("level"), p.alias("pos")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.floor(F.log2(end - low)).cast("int")), at))


def _above(point: str, longest: Column) -> Column:
    """The dyadic ranges that hold the point, up to the given length and one more for rounding."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.log2(longest)).cast("int") + 1), lambda level: F.struct(level.alias("level"), F.floor(F.col(point) / _level(level)).cast("int").alias("pos")))


def links(docs: DataFrame, digests: DataFrame, nodes: DataFrame, text: Column, similarity: float) -> DataFrame:
    """(node, root): the components of all candidate pairs that reach the similarity.

    A document is first compared with the least member of all its buckets, one pair a document. A
    bucket whose members are then in one component is done. In the others, a document is compared
    with the member of its buckets that shares the most with anybody, which in a group of edited
    copies is near the original. Then the documents of these buckets are joined exactly by
    prefixes, whatever buckets they share. So every candidate pair is compared, ruled out by a bound,
    or already joined, and nothing lists the pairs of a bucket.
    """
    keyed = digests.join(nodes.select("node"), F.col("uid") == F.col("node"), "left_semi").select(F.col("uid").alias("node"), "n", F.explode("bands").alias("key"))
    full = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("node", "n")).alias("hub")).where("size > 1")
    full = stored(full.select(F.col("key").alias("k"), F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n")), "buckets")
    members = stored(keyed.join(full, F.col("key") == F.col("k")).select("key", "node", "n", "hub", "hub_n"), "members")
    wanted = digests.join(members.select("node").distinct(), F.col("uid") == F.col("node")).select("node", "doc_id", "md5")
    sets = stored(_sets(docs, text, stored(wanted, "wanted")), "sets")
    t = F.lit(similarity)
    near = F.least("n", "hub_n") >= t * F.greatest("n", "hub_n")  # else they can't reach it
    first = members.where("node <> hub").where(near).groupBy(F.col("node").alias("b")).agg(F.min("hub").alias("a"))
    roots = components(_verified(stored(first.select("a", "b"), "pairs"), sets, similarity))

    placed = stored(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed")
    release(full, members)
    spread = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    placed = stored(placed.join(stored(spread, "spread"), "key", "left_semi"), "rest")
    if placed.isEmpty():
        release(sets)
        return roots
    prefix, shared = _prefixes(sets, placed.select("node").distinct(), similarity)

    share = F.struct((F.col("c") / F.col("n")).alias("share"), (-F.col("node")).alias("minus"), "root", "n")
    able = stored(placed.join(shared, "node").select("key", "node", "root", "n", share.alias("me")), "able")
    best = stored(able.groupBy("key").agg(F.max("me").alias("hub")), "central")
    met = able.join(best, "key").where((F.col("root") != F.col("hub.root")) & (F.least("n", "hub.n") >= t * F.greatest("n", "hub.n")))
    second = met.groupBy(F.col("node").alias("b")).agg(F.max("hub").alias("hub")).select((-F.col("hub.minus")).alias("a"), "b")
    linked = lambda pairs: components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_verified(stored(pairs, "pairs"), sets, similarity)))
    roots = linked(second)
    roots = linked(_prefix_pairs(prefix, roots, similarity))
    release(sets)
    return roots


def classes(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", wordless: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, md5 (of its text), class_id, class_size, kept.

    ``class_id`` is the least doc_id of the class (null ids come last), and ``kept`` marks one row of
    each class, one that has that id. Texts without words are near to nothing: with ``wordless``
    equal ones are a class (a null text is equal to an empty one), else each is a class of its own.
    Equal texts are collapsed before anything else; shorter texts than a shingle are one shingle. An
    empty table gives an empty one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    digests = _digests(docs, text, bands, rows)
    worded = digests.where("n > 0")
    alike = digests if wordless else worded
    nodes = stored(alike.groupBy("md5").agg(F.min("uid").alias("node")), "nodes")
    roots = links(docs, worded, nodes, text, similarity)
    placed = alike.select("uid", "doc_id", "md5").join(nodes, "md5").select("uid", "doc_id", "md5", "node")
    if not wordless:
        placed = placed.unionByName(digests.where("n = 0").select("uid", "doc_id", "md5", F.col("uid").alias("node")))
    placed = stored(placed.join(roots, "node", "left").select("uid", "doc_id", "md5", F.coalesce("root", "node").alias("root")), "placed")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")).alias("best")
    heads = stored(placed.groupBy("root").agg(best, F.count("*").alias("class_size")).select("root", "class_size", F.col("best.doc_id").alias("class_id"), F.col("best.uid").alias("head")), "classes")
    return placed.join(heads, "root").select("doc_id", "md5", "class_id", "class_size", (F.col("uid") == F.col("head")).alias("kept"))


def keep(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", wordless: bool = False) -> DataFrame:
    """One row of each class, all columns unchanged; of rows equal in id and text one stays. See classes."""
    stay = classes(docs, similarity, id_col=id_col, text_col=text_col, wordless=wordless).where("kept").select(F.col("doc_id").alias("id"), F.col("md5").alias("digest"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), docs[id_col].cast("bigint").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("md5"))
    rows = rows.join(stay, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("md5") == F.col("digest")), "left_semi")
    again = Window.partitionBy("doc_id", "md5").orderBy(F.lit(0))
    return rows.withColumn("nth", F.row_number().over(again)).where("nth = 1").select("row.*")
