"""Groups of near copies by similarity, the wide form of simhash.py: documents whose sets of word shingles have a Jaccard
similarity of SIMILARITY or more.

Equal sets are one node. A node's SimHash fingerprint has a bit for each of some thousand positions, set if set in over
half the hashes of its shingles: sets of similarity 0.8 differ in 15 bits of 100, so 64 bits leave keys of a few bits only.
It is cut into segments of EXACT + WILD bits. Nodes meet by equality of deletion-variant signatures: a segment's exact
bits, and its others without the one at a place. So two segments that differ in one of those at most meet, and what meets
is verified by its Hamming distance in CHECK bits that lie elsewhere for each segment. A pair of similarity 0.8 passes both
in none of the segments with a probability of about 2e-6 at most, as computed for independent bits, more similar ones with
less; bits of small sets differ more often, so fingerprints of SMALL hashes or fewer are longer. A link is made only by the
exact similarity of the two sets (of 64-bit hashes), so candidates cost time, never a document.

What meets, over whatever chain of nodes and segments, is one clump: segments give links of a node with one other of those
it meets, a few segments first, so nodes that are known by one of their clump don't meet again, and a group of near copies gives rows in
proportion to its nodes. Members of a clump are first compared with PIVOTS of its nodes. Where a clump's nodes are then of
several roots, those that aren't of its commonest root are compared with all others, block against block, blocks being bounded
by hashes, and only links that connect something leave a task. So a clump whose members aren't that similar costs comparisons
in proportion to its nodes times those that are left out. A set of under 1 / (1 - similarity) - 1 hashes is that similar to
itself alone, and is not looked for.

Signatures are made where nodes of the same exact bits lie together, so a segment is shuffled once, not once a place.

Defined cases: words lie between ASCII blanks, A-Z lower-cased; fewer words than a shingle are one shingle; texts without
words are in no group; repeated rows share one; a null doc_id connects others and owns nothing; an empty table gives an
empty result; columns beyond doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiform.llm.common import maybe_broadcast, written
from lexiform.llm.components import connected_components
from lexiform.llm.simhash import LOWER

SHINGLE = 5
SIMILARITY = 0.8
SEED = 42
#: Bits of a fingerprint that verify what meets in a segment: a word and 30 bits of the next, not those of the segment.
CHECK = 94
#: Differing bits of those up to which nodes meet, and where both sets are small; pairs of similarity 0.8 pass in 80 of 100
#: segments (small ones 95), and are asked for it in each segment where they meet.
DISTANCE, DISTANCE_SMALL = 17, 24
#: Bits of a segment that have to agree, and those of which one may differ.
EXACT, WILD = 8, 16
#: 64-bit words of a fingerprint (224 segments), and of one of a set of SMALL hashes or fewer (424).
WORDS, WORDS_SMALL = 84, 159
SMALL = 62
#: Where the parts of segments are cut that are shuffled at once, by rounds; the second knows for each node one of its clump. Segments
#: that only small sets have go with the last part.
ROUNDS = ((0, 8), (8, 64, 120, 176, None))
#: Shingles whose bits are counted at a time.
STEP = 2048
#: Nodes whose segments are made at a time.
NODES = 128
#: Nodes under one signature that are verified in pairs; more meet without.
PAIRED = 128
#: The nodes of a clump that all others are compared with are the first and the last in so many orders.
PIVOTS = 2
#: Hashes of a clump's nodes that are compared in one piece, with as many others (one node at least).
BLOCK = 65_536


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode().translate(LOWER).split()  # bytes split at ASCII blanks only
    if not found:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(found))
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(found))
    spans = zip(starts[: len(found) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    return np.unique(np.array([xxh64_intdigest(joined[s:e], SEED) for s, e in spans], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def linked(found: list[int], roots: list[int], sets: list[np.ndarray], asks: list[bool], least: float) -> list[tuple[int, int]]:
    """Pairs of a node that asks and a node of another root whose sets have a similarity of least or more; of all such pairs as
    many as connect the same roots."""
    root, sizes = np.array(roots, np.int64), np.array([len(x) for x in sets])
    columns, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    has = np.zeros(len(columns), bool)
    out = []
    for i in np.flatnonzero(asks).tolist():
        own = at[starts[i] : starts[i] + sizes[i]]
        has[own] = True
        both = np.add.reduceat(has[at], starts, dtype=np.int64)
        has[own] = False
        near = np.flatnonzero((both / (sizes + sizes[i] - both) >= least) & (root != root[i]))
        others, first = np.unique(root[near], return_index=True)
        out += [(found[i], found[j]) for j in near[first].tolist()]
        root[np.isin(root, others)] = root[i]
    return out


def _mixed(values: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit values, in place."""
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        values ^= values >> np.uint64(shift)
        values *= np.uint64(odd)
    values ^= values >> np.uint64(31)
    return values


def _counted(levels: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Binary counters of bits, a row of words for each of their places; levels hold rows of bits of the weight 2**level."""
    out = []
    while levels:
        rows, carries = np.concatenate(levels[0]), levels[1] if len(levels) > 1 else []
        while len(rows) > 1:
            third = max(1, len(rows) // 3)
            a, b = rows[:third], rows[third : 2 * third]
            if len(rows) == 2:
                carries.append(a & b)
                rows = a ^ b
                continue
            c, either = rows[2 * third : 3 * third], a ^ b
            carries.append((a & b) | (c & either))
            rows = np.concatenate((either ^ c, rows[3 * third :]))
        out.append(rows)
        levels = ([carries] if carries else []) + levels[2:]
    return out


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """The SimHash of a set that isn't empty: bits set in over half the hashes, each stretched to that many words."""
    steps = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    levels: list[list[np.ndarray]] = []
    for i in range(0, len(hashes), STEP):
        for level, row in enumerate(_counted([[_mixed(hashes[i : i + STEP, None] + steps)]])):
            if level == len(levels):
                levels.append([])
            levels[level].append(row)
    over, equal = np.zeros(words, np.uint64), np.full(words, np.uint64(2**64 - 1))
    planes, half = _counted(levels), len(hashes) // 2
    for level in range(max(len(planes), half.bit_length()) - 1, -1, -1):
        plane = planes[level][0] if level < len(planes) else np.zeros(words, np.uint64)
        if half >> level & 1:
            equal &= plane
        else:
            over |= equal & plane
            equal &= ~plane
    return over


def words_of(size: int) -> int:
    return WORDS if size > SMALL else WORDS_SMALL


def segments_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, checks) of fingerprints of one length, a row each. A code has the segment's number in its upper 9 bits,
    then its bits, then whether the set is small, then 30 bits to verify by; a check is 64 more of these."""
    words = prints.shape[1]
    n = words * 8 // 3
    bits = prints.view(np.uint8)[:, : 3 * n].reshape(len(prints), n, 3).astype(np.uint64)
    bits = bits[:, :, 0] << np.uint64(16) | bits[:, :, 1] << np.uint64(8) | bits[:, :, 2]
    number = np.arange(n)
    # The same words for a segment whatever the fingerprint's length, and three at least behind its own.
    at = (number * 3 // 8 + 3) % np.where(number < WORDS * 8 // 3, WORDS - 1, WORDS_SMALL - 1)
    low = prints[:, at + 1] >> np.uint64(34) | np.uint64((words == WORDS_SMALL) << 30)
    return number.astype(np.uint64) << np.uint64(55) | bits << np.uint64(31) | low, prints[:, at]


def _node(hashes: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(hashes.tobytes(), SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row_hash"), "text")


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, node, size, print) of every row with words; size is the number of its set's hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, sizes, prints = [], [], [], []
            for i, t in enumerate(batch.column("text")):
                hashes = shingle_set(t.as_py())
                if len(hashes):
                    at.append(i)
                    found.append(_node(hashes))
                    sizes.append(len(hashes))
                    prints.append(wide_fingerprint(hashes, words_of(len(hashes))).tobytes())
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("row_hash"), _signed(found), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary())], names=["doc_id", "row_hash", "node", "size", "print"])

    return _rows(docs).mapInArrow(run, "doc_id long, row_hash long, node long, size int, print binary")


def entries(given: DataFrame, segments: slice) -> DataFrame:
    """(code, node, check, root) for each of these segments of (node, print, root); root is null for the node itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(x.as_buffer()) for x in batch.column("print")], np.int64)
            for length in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == length)
                for i in range(0, len(rows), NODES):
                    part = batch.take(pa.array(rows[i : i + NODES]))
                    prints = np.frombuffer(b"".join(part.column("print").to_pylist()), np.uint64).reshape(part.num_rows, -1)
                    found = [np.ascontiguousarray(x[:, segments]) for x in segments_of(prints)]
                    codes, checks = [pa.array(x.reshape(-1).view(np.int64)) for x in found]
                    again = pa.array(np.repeat(np.arange(part.num_rows), found[0].shape[1]))
                    yield pa.RecordBatch.from_arrays([codes, part.column("node").take(again), checks, part.column("root").take(again)], names=["code", "node", "check", "root"])

    return given.select("node", "print", "root").mapInArrow(run, "code long, node long, check long, root long")


def met(code: np.ndarray, node: np.ndarray, check: np.ndarray, root: np.ndarray, joined: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(band, node, root) for nodes that meet one of another root under a signature and pass its check; whole groups of equal exact bits are given.

    A band is a signature's; joined, those that share nodes are one."""
    bits, low = code >> np.uint64(31), code & np.uint64(0x3FFFFFFF)
    limit = np.where(code >> np.uint64(30) & np.uint64(1), DISTANCE_SMALL, DISTANCE)
    found: list[tuple[np.ndarray, np.ndarray]] = []  # rows of a place, and where runs of them start
    for place in range(-1, WILD):  # -1: equal segments, which would meet at every place
        key = bits if place < 0 else bits & ~np.uint64(1 << place)
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], key[order[1:]] != key[order[:-1]])))
        sizes = np.diff(np.append(starts, len(key)))
        at = order[np.repeat(sizes > 1, sizes)]
        if not len(at):
            continue
        sizes = sizes[sizes > 1]
        starts, run = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
        top, seg = root[at], bits[at]
        # Many under a signature meet as they are, if they are of several roots (and segments).
        mixed = (sizes > PAIRED) & (np.minimum.reduceat(top, starts) < np.maximum.reduceat(top, starts))
        if place >= 0:
            mixed &= np.minimum.reduceat(seg, starts) < np.maximum.reduceat(seg, starts)
        near, few = np.repeat(mixed, sizes), np.repeat(sizes <= PAIRED, sizes)
        for shift in range(1, min(int(sizes.max()), PAIRED)):
            i = np.flatnonzero((run[shift:] == run[:-shift]) & few[shift:])
            i = i[top[i] != top[i + shift]]
            if place >= 0:
                i = i[seg[i] != seg[i + shift]]
            x, y = at[i], at[i + shift]
            far = sum(np.bitwise_count(z[x] ^ z[y]).astype(np.int64) for z in (check, low))
            i = i[far <= np.minimum(limit[x], limit[y])]
            near[i] = near[i + shift] = True
        if near.any():
            at, run = at[near], run[near]
            found.append((at, np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))))
    if joined and found:
        label, before = np.arange(len(code)), None
        while before is None or (label != before).any():
            before = label.copy()
            for at, starts in found:
                label[at] = np.repeat(np.minimum.reduceat(label[at], starts), np.diff(np.append(starts, len(at))))
        at = np.unique(np.concatenate([at for at, _ in found]))
        at = at[np.argsort(label[at], kind="stable")]
        found = [(at, np.flatnonzero(np.concatenate(([True], label[at[1:]] != label[at[:-1]]))))]
    # The same nodes are the same band under whatever signature; bands that fall together cost comparisons.
    bands = [np.repeat(np.add.reduceat(_mixed(node[at].view(np.uint64).copy()), starts), np.diff(np.append(starts, len(at)))) for at, starts in found]
    at = np.concatenate([np.empty(0, np.int64), *[at for at, _ in found]])
    return np.concatenate([np.empty(0, np.uint64), *bands]), node[at], root[at]


def bands(given: DataFrame, segments: slice, joined: bool = False) -> DataFrame:
    """(a, b), the root and the least root of a band, for the roots of (node, print, root) that meet another under a signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the last group so far, of which more may come

        def closed(more: list[list[np.ndarray]]) -> pa.RecordBatch:
            keys, _, roots = met(*[np.concatenate(x) for x in zip(*more, strict=True)], joined=joined)
            order = np.argsort(keys, kind="stable")
            keys, roots = keys[order], roots[order]
            starts = np.flatnonzero(np.concatenate((np.ones(len(keys[:1]), bool), keys[1:] != keys[:-1])))
            lowest = np.repeat(np.minimum.reduceat(roots, starts), np.diff(np.append(starts, len(keys)))) if len(keys) else roots
            pairs = np.unique(np.stack((roots, lowest))[:, roots != lowest], axis=1)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            node = batch.column("node").to_numpy()
            root = batch.column("root").is_null().to_numpy(zero_copy_only=False)
            root = np.where(root, node, batch.column("root").fill_null(0).to_numpy())
            rows = [batch.column("code").to_numpy().view(np.uint64), node, batch.column("check").to_numpy().view(np.uint64), root]
            group = rows[0] >> np.uint64(31 + WILD)
            others = np.flatnonzero(group != group[-1])
            cut = int(others[-1]) + 1 if len(others) else 0
            if held and (cut or held[-1][0][-1] >> np.uint64(31 + WILD) != group[-1]):
                yield closed(held + ([[x[:cut] for x in rows]] if cut else []))
                held = []
            elif cut:
                yield closed([[x[:cut] for x in rows]])
            held.append([x[cut:].copy() for x in rows])
        if held:
            yield closed(held)

    rows = entries(given, segments)
    return rows.repartition(F.shiftrightunsigned("code", 31 + WILD)).sortWithinPartitions("code").mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, hashes) of the wanted (node, at): the set of the row that at names, for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([shingle_set(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())], names=["node", "hashes"])

    rows, n = _rows(docs), wanted.count()
    same = rows.doc_id.eqNullSafe(F.col("at.doc_id")) & (rows.row_hash == F.col("at.row_hash"))
    texts = rows.join(maybe_broadcast(wanted, n), same).select("node", "text")
    return texts.mapInArrow(run, "node long, hashes binary").groupBy("node").agg(F.min("hashes").alias("hashes"))


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of a similarity of least or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) >= least for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    joined = joined.where(F.lit(True)).join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    # Sets whose sizes alone rule the similarity out go no further.
    sized = joined.where(F.least(F.length("x"), F.length("y")) >= F.lit(least) * F.greatest(F.length("x"), F.length("y")))
    return sized.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def clumps(given: DataFrame) -> DataFrame:
    """(node, clump) of the nodes of (node, print) that meet others, the clump being the smallest node reachable."""
    found, roots = [], given.select("node", F.col("node").alias("root")).where("false")
    for cuts in ROUNDS:
        rooted = given.join(maybe_broadcast(roots, roots.count()), "node", "left")
        found += [written(bands(rooted, slice(a, b), True), "near-met") for a, b in zip(cuts, cuts[1:])]
        # For the next round a node of the same clump, if not its smallest, is enough, and costs no steps.
        roots = reduce(DataFrame.union, found).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return connected_components(reduce(DataFrame.union, found), "near-clumps").withColumnRenamed("root", "clump")


def near_groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) of every row with words: the smallest doc_id reachable over pairs of that similarity (0.8 or more)."""
    if not SIMILARITY <= least <= 1:
        raise ValueError("the bands are made for a similarity of 0.8 or more")
    prints = written(nodes(docs), "near-prints")
    own = F.struct("doc_id", "row_hash")
    distinct = written(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.min(own).alias("at"), F.first("size").alias("size"), F.first("print").alias("print")), "near-nodes")
    # Of two sets of which the smaller has n hashes, n / (n + 1) is the largest similarity.
    asked = distinct.where(F.col("size") / (F.col("size") + 1) >= F.lit(float(least))).select("node", "print")
    members = written(clumps(asked).join(distinct.select("node", "size", "at"), "node"), "near-members")
    sets = written(_sets(docs, members.select("node", "at")), "near-sets")

    orders = [F.struct(F.xxhash64("node", F.lit(i)).alias("code"), "node") for i in range(PIVOTS)]
    ends = written(members.groupBy("clump").agg(F.array(*[end(x)["node"] for x in orders for end in (F.min, F.max)]).alias("ends")), "near-ends")
    first = members.join(maybe_broadcast(ends, ends.count()), "clump").select(F.col("node").alias("a"), F.explode("ends").alias("b"), F.array_contains("ends", F.col("node")).alias("both"))
    tried = written(first.where("a <> b and (not both or a > b)").select("a", "b").distinct(), "near-pairs")
    links = written(_verified(tried, sets, least), "near-links")
    roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))  # a node that it is connected to

    # Clumps of four nodes or more that their ends don't connect have pairs that weren't compared.
    rooted = members.select("node", "clump", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "near-rooted")
    parts = rooted.groupBy("clump", "root").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"))
    mixed = parts.groupBy("clump").agg(F.max(F.struct("n", "root", "hashes")).alias("usual"), F.sum("n").alias("n"), F.sum("hashes").alias("hashes"))
    mixed = mixed.where("n > 3 and n > usual.n").select("clump", F.col("usual.root").alias("usual"), F.ceil(F.col("hashes") / BLOCK).alias("blocks"), F.ceil((F.col("hashes") - F.col("usual.hashes")) / BLOCK).alias("askers"))
    mixed = written(mixed, "near-mixed")
    rest = rooted.join(maybe_broadcast(mixed, mixed.count()), "clump").withColumn("code", F.xxhash64("node"))
    asker, block = F.pmod("code", "askers"), F.pmod("code", "blocks")
    every = rest.select("clump", "node", "root", F.lit(False).alias("asks"), block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("askers") - 1)).alias("asker"))
    asking = rest.where("root <> usual").select("clump", "node", "root", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), asker.alias("asker"))
    rest = every.union(asking).join(sets, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = linked(pdf["node"].tolist(), pdf["root"].tolist(), [np.frombuffer(x, np.uint64) for x in pdf["hashes"]], pdf["asks"].tolist(), least)
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    more = written(rest.groupBy("clump", "asker", "block").applyInPandas(compare, "a long, b long").distinct(), "near-more")
    roots = connected_components(links.union(more), "near-edges")

    named = distinct.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    owner = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.select("node", "root").join(owner, "root").select("node", "component_id")
    return prints.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")
