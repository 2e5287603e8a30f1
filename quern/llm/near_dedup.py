"""Near-duplicate classes by BagMinHash, banding and exact multiset overlap.

1. One pass over the texts makes, for each document, a digest of its shingle multiset, its size and its
   band keys. Documents with equal multisets form a vertex; from here on copies cost nothing.
2. Vertices that share a band key are candidates. Each key's least vertex leads, and every other vertex of
   the key is verified against the leader by exact multiset overlap, 0.8 or more. That settles groups of near copies of any
   size with a pair per vertex and key.
3. Verified links are contracted to components. A key whose rows are of one component is settled. In every other key,
   rows are held against its rows of other components by signatures, and those within MARGIN (3.6 standard errors)
   of the threshold are verified exactly where they meet, likest first, unless they have become one component meanwhile.
   So a task returns fewer links than it has rows, and no candidate pair is ever written. Bands are taken in the
   groups of GROUPS, with a contraction after each, which leaves few mixed keys for the later ones.
4. In a mixed key the largest component's rows are cut into parts, and so are all others; parts of the first meet parts of the
   others, and the others meet each other. So a row of a hot key is copied once for each part of the others,
   and one shared key is enough at any size.
5. The least doc_id of a component is its class.

Tables on the way are written as Parquet, so that the planner knows their size, and removed when they have been read. Leaders, fingerprints and links stay distributed. Joins on a key, leader, root or vertex that a large share of the rows
may have in common take such keys map-side (`spread_join`) or deal a leader's pairs to several copies of it. Null texts count as empty. Texts without a word are
alike only if they are equal. Rows without an id join classes but never name one unless all of its
rows lack ids. Every row is a document, also one that repeats an id; of each class exactly one row is kept, the one with the
least id, then the least digest of its text. An empty table gives an empty result;
extra columns of any name pass through `drop_near_copies`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bagminhash as B
from quern.llm.common import Passing, release_memory, settle, spread_join, text_or_empty, text_slices, written

SIMILAR = 0.8
#: Bytes of text whose shingles are held at once.
BATCH = 1 << 19
#: How far below the threshold a signature's estimate may lie for a candidate.
MARGIN = 0.12
#: Rows, and shingles of rows, in a part of a mixed key.
BUCKET, PART_ITEMS = 2048, 2_000_000
#: Pairs of a leader that meet one copy of its multiset.
LED = 512
#: Bands that are settled together, in order; every band is in one group.
GROUPS = (range(0, 3), range(3, 10), range(10, B.BANDS))
#: Candidate pairs of a block beyond which overlaps are counted by one matrix product.
MANY = 2000
#: Mixed keys, and leaders of more than LED pairs, beyond this many are joined by a shuffle, not broadcast.
BROADCAST_KEYS = 50_000
#: Edges up to which components are found in one task; more are contracted first.
FEW = 16_384


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column, kept = batch.column("text"), [batch.column(c) for c in ("doc_id", "tkey", "uid")]
        for a, b in text_slices(column, BATCH):
            texts = column.slice(a, b - a).to_pylist()
            doc, h, count = B.shingles(texts)
            sig = B.signatures(doc, h, count, b - a)
            bands, bytes_ = B.band_keys(sig), B.slot_bytes(sig)
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            size = np.array([count[cut[i] : cut[i + 1]].sum() for i in range(b - a)], np.int64)
            digests = [
                B.digest(h[cut[i] : cut[i + 1]], count[cut[i] : cut[i + 1]]) if size[i] else hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=16, key=b"no words").digest()
                for i in range(b - a)
            ]
            offsets = np.concatenate(([0], np.cumsum(np.where(size > 0, B.BANDS, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(a, b - a) for c in kept), pa.array(digests, pa.binary()), pa.array(size), pa.array([r.tobytes() for r in bytes_], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(bands[size > 0].reshape(-1)))],
                ["doc_id", "tkey", "uid", "v", "n", "sig", "bands"],
            )
    release_memory()


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = None
    for batch in batches:
        # The join brings rows that repeat id and text one after another; the first is enough.
        own = batch.column("v").to_pylist()
        batch = batch.take(pa.array([k for k, x in enumerate(own) if x != (own[k - 1] if k else seen)], pa.int64()))
        seen = own[-1] if own else seen
        column, v = batch.column("text"), batch.column("v")
        for a, b in text_slices(column, BATCH):
            doc, h, count = B.shingles(column.slice(a, b - a).to_pylist())
            size = np.bincount(doc, count, b - a).astype(np.int64)
            values = B.elements(h, count)
            offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([v.slice(a, b - a), pa.ListArray.from_arrays(offsets, pa.array(values))], ["v", "items"])
    release_memory()


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, tkey, uid, v, n, sig, bands) of every row: v is its vertex, tkey a digest of its text, uid tells fully repeated rows apart."""
    t = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tkey", F.unhex(F.md5("text"))).withColumn("uid", F.monotonically_increasing_id())
    kind = dict(docs.dtypes)["doc_id"]
    return written(t.mapInArrow(_sign, f"doc_id {kind}, tkey binary, uid long, v binary, n long, sig binary, bands array<long>"))


def vertices(base: DataFrame) -> DataFrame:
    """One row per vertex: v, n, sig, bands, copies, and rid (least id), tkey and uid of its first row."""
    one = F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "tkey", "uid"))
    t = base.groupBy("v").agg(one.alias("one"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    return written(t.select("v", "n", "sig", "bands", "copies", F.col("one.doc_id").alias("rid"), F.col("one.tkey").alias("tkey"), F.col("one.uid").alias("uid")))


def multisets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, items) of the vertices in `wanted` (v, rid, tkey)."""
    t = docs.select("doc_id", text_or_empty().alias("text")).withColumn("tkey", F.unhex(F.md5("text"))).alias("d")
    w = wanted.alias("w")
    rows = t.join(w, (F.col("d.tkey") == F.col("w.tkey")) & F.col("d.doc_id").eqNullSafe(F.col("w.rid")))
    return rows.select("w.v", "d.text").mapInArrow(_elements, "v binary, items array<long>")


def verified(pairs: DataFrame, items: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """Pairs (a, b) whose multisets are alike.

    Members' multisets are joined first, leaders' last. A leader of more than LED pairs has a copy of its multiset for each LED of
    them, so no task holds all pairs of a leader, and copies are fewer than the pairs by that factor.
    """
    many = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / LED).cast("long").alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    few = many.count() <= BROADCAST_KEYS  # else multisets are shuffled once more
    dealt = (pairs.join(F.broadcast(many), "a", "left") if few else spread_join(pairs, many, "a", "left")).select("a", "b", F.pmod(F.xxhash64("b"), parts).alias("part"))
    members = items.select(F.col("v").alias("b"), F.col("items").alias("ib"))
    leaders = items.select(F.col("v").alias("a"), F.col("items").alias("ia")).join(F.broadcast(many) if few else many, "a", "left")
    leaders = leaders.select("a", "ia", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    both = dealt.join(members, "b").join(leaders, ["a", "part"])
    common = F.size(F.array_intersect("ia", "ib"))
    return both.select("a", "b", common.alias("common"), (F.size("ia") + F.size("ib")).alias("both")).where(F.col("common") >= F.lit(similar) * (F.col("both") - F.col("common"))).select("a", "b").distinct()


class _Forest:
    """Components of rows, by union to the least number."""

    def __init__(self, root: np.ndarray) -> None:
        self.up = np.arange(int(root.max(initial=-1)) + 1)
        self.root = root

    def of(self, rows: np.ndarray) -> np.ndarray:
        x = self.root[rows]
        while True:
            y = self.up[x]
            if (x == y).all():
                return x
            x = y

    def join(self, a: int, b: int) -> bool:
        """Whether two rows were of different components, which are one now."""
        x, y = (int(self.of(np.array([k]))[0]) for k in (a, b))
        self.up[max(x, y)] = min(x, y)
        return x != y


def _overlaps(items: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Size of the multiset overlap of each left with each right row, by matrix products over the elements that both sides hold."""
    a, b = [items[k] for k in left], [items[k] for k in right]
    known = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(left), len(right)), np.float32)
    at = [[np.searchsorted(known, np.intersect1d(x, known, assume_unique=True)) for x in side] for side in (a, b)]
    for c in range(0, len(known), 4096):
        dense = []
        for side in at:
            m = np.zeros((len(side), min(4096, len(known) - c)), np.float32)
            for k, x in enumerate(side):
                m[k, x[np.searchsorted(x, c) : np.searchsorted(x, c + 4096)] - c] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out.astype(np.int64)


def _links(sig: np.ndarray, items: list[np.ndarray], root: np.ndarray, similar: float) -> Iterator[tuple[int, int]]:
    """Verified links between rows of different roots that make one component of all rows so linked; fewer than there are roots.

    Every row is held against every row of another root. Equal slots are counted over three bits of a slot first, which
    never counts too few, and then over whole slots; pairs within MARGIN are verified exactly.
    """
    rows, slots = sig.shape
    size = np.array([len(x) for x in items])
    need = int(np.ceil(slots * ((similar - MARGIN) * (1 - 1 / 256) + 1 / 256) - 1e-9))
    width = -(-slots // 64) * 8
    planes = []
    for bit in range(3):
        packed = np.zeros((rows, width), np.uint8)
        packed[:, : -(-slots // 8)] = np.packbits(sig >> bit & 1, axis=1)
        planes.append(packed.view(np.uint64))
    forest = _Forest(root)
    # The largest root's rows come last, so that they are never on the left side.
    order = np.argsort(np.bincount(root)[root] * (int(root.max()) + 1) + root, kind="stable")
    last = rows - int((root == root[order[-1]]).sum())
    for a in range(0, last, 128):
        left = order[a : min(a + 128, last)]
        for c in range(a, rows, 2048):
            right = order[c : c + 2048]
            unlike = np.zeros((len(left), len(right)), np.uint8)
            for w in range(width // 8):
                off = planes[0][left, w][:, None] ^ planes[0][right, w][None, :]
                for plane in planes[1:]:
                    off |= plane[left, w][:, None] ^ plane[right, w][None, :]
                unlike += np.bitwise_count(off)
            i, j = np.nonzero((unlike <= slots - need) & (np.arange(a, a + len(left))[:, None] < np.arange(c, c + len(right))[None, :]))
            x, y = left[i], right[j]
            near = np.minimum(size[x], size[y]) >= similar * np.maximum(size[x], size[y])
            near[near] = forest.of(x[near]) != forest.of(y[near])
            i, j, x, y = i[near], j[near], x[near], y[near]
            equal = np.concatenate([np.zeros(0, np.int64), *((sig[x[k : k + 65536]] == sig[y[k : k + 65536]]).sum(axis=1) for k in range(0, len(x), 65536))])
            by = np.argsort(-equal, kind="stable")
            by = by[equal[by] >= need]
            i, j, x, y = i[by], j[by], x[by], y[by]
            if len(x) > MANY:
                common = _overlaps(items, left, right)[i, j]
                good = common >= similar * (size[x] + size[y] - common)
                for p, q in zip(x[good].tolist(), y[good].tolist()):
                    if forest.join(p, q):
                        yield p, q
                continue
            for k in range(0, len(x), 64):
                now = forest.of(x[k : k + 64]) != forest.of(y[k : k + 64])
                for p, q in zip(x[k : k + 64][now].tolist(), y[k : k + 64][now].tolist()):
                    common = len(np.intersect1d(items[p], items[q], assume_unique=True))
                    if common >= similar * (size[p] + size[q] - common) and forest.join(p, q):
                        yield p, q


def _link_buckets(similar: float):
    """Over rows (key, v, sig, root, items) that are sorted by key: the links (a, b) of `_links` in each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(v: list, sig: list, root: list, items: list) -> Iterator[pa.RecordBatch]:
            if len(set(root)) < 2:
                return
            number = {r: k for k, r in enumerate(dict.fromkeys(root))}
            found = list(_links(np.frombuffer(b"".join(sig), np.uint8).reshape(len(sig), -1), items, np.array([number[r] for r in root]), similar))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([v[k] for k in side], pa.binary()) for side in zip(*found)], ["a", "b"])

        now, bucket = None, ([], [], [], [])
        for batch in batches:
            column = batch.column("items")
            cut, flat = column.offsets.to_numpy(), column.values.to_numpy()
            for at, (key, *row) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "v", "sig", "root")))):
                if key != now:
                    yield from done(*bucket)
                    now, bucket = key, ([], [], [], [])
                for to, x in zip(bucket, (*row, flat[cut[at] : cut[at + 1]].copy())):
                    to.append(x)
        yield from done(*bucket)
        release_memory()

    return run


def _led(rows: DataFrame) -> DataFrame:
    """(key, a, na, b, nb): each row of a key beside the key's least vertex."""
    leads = rows.groupBy("key").agg(F.min(F.struct("v", "n")).alias("lead"), F.count("*").alias("size")).where("size > 1").select("key", F.col("lead.v").alias("a"), F.col("lead.n").alias("na"))
    return spread_join(rows, written(leads), "key").where("v != a").select("key", "a", "na", F.col("v").alias("b"), F.col("n").alias("nb"))


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(v, key, root, main, rows, others, parts of both) of the keys of `members` (v, key, n) whose rows are of several components."""
    held = members.join(roots, "v", "left").select("v", "key", "n", F.coalesce("root", "v").alias("root"))
    by_root = held.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    keys = by_root.groupBy("key").agg(F.max(F.struct("c", "root", "w")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("roots")).where("roots > 1")
    parts = lambda rows, items: F.ceil(F.greatest(rows / BUCKET, items / PART_ITEMS)).cast("long")
    keys = keys.select("key", F.col("top.root").alias("main"), parts(F.col("top.c"), F.col("top.w")).alias("main_parts"), parts(F.col("c") - F.col("top.c"), F.col("w") - F.col("top.w")).alias("other_parts"))
    keys, rows = written(keys), held.select("v", "key", "root")
    return rows.join(F.broadcast(keys), "key") if keys.count() <= BROADCAST_KEYS else spread_join(written(rows), keys, "key")


def _dealt(mixed: DataFrame) -> DataFrame:
    """(v, key, root): rows of mixed keys, each in every bucket where it meets rows of other components."""
    own = lambda n: F.pmod(F.xxhash64("v"), F.greatest(F.col(n), F.lit(1)))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    at = lambda kind, p, q: F.xxhash64("key", F.lit(kind), p, q).alias("key")
    main = mixed.where("root = main").select("*", own("main_parts").alias("p"), upto("other_parts").alias("q")).select("v", at("main", F.col("p"), F.col("q")), "root")
    other = mixed.where("root != main").withColumn("q", own("other_parts"))
    beside = other.select("*", upto("main_parts").alias("p")).select("v", at("main", F.col("p"), F.col("q")), "root")
    # Others of one part meet in the buckets above.
    among = other.where("other_parts > 1").select("*", upto("other_parts").alias("p")).where("p != q").select("v", at("other", F.least("p", "q"), F.greatest("p", "q")), "root")
    return main.unionByName(beside).unionByName(among)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(v, root) when the components of `roots` that `links` (a, b) connect are one."""
    to_a, to_b = roots.select(F.col("v").alias("a"), F.col("root").alias("x")), roots.select(F.col("v").alias("b"), F.col("root").alias("y"))
    n = links.count()
    across = spread_join(spread_join(links, to_a, "a", "left", n), to_b, "b", "left", n).select(F.coalesce("x", "a").alias("x"), F.coalesce("y", "b").alias("y"))
    across = written(across.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    if across.isEmpty():
        return roots
    more = components(across)
    every = written(roots.unionByName(more.join(roots, "v", "left_anti").select("v", F.col("v").alias("root"))))
    return written(spread_join(every, more.select(F.col("v").alias("root"), F.col("root").alias("to")), "root", "left").select("v", F.coalesce("to", "root").alias("root")))


def grouped(docs: DataFrame, verts: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(v, root) of every vertex that has a link."""
    full = verts.where("n > 0")
    with Passing() as whole:
        with Passing() as part:
            led = written(_led(full.select("v", "n", F.explode("bands").alias("key"))))
            first = part.keep(written(led.where(F.least("na", "nb") >= F.lit(similar) * F.greatest("na", "nb")).select("a", "b").distinct()))
            who = led.select(F.col("a").alias("v")).union(led.select(F.col("b").alias("v"))).distinct()
            shared = part.keep(written(verts.join(who, "v", "left_semi").select("v", "n", "sig", "bands", "rid", "tkey")))
        items = settle(multisets(docs, shared.select("v", "rid", "tkey")))  # read row by row, however long
        roots = components(written(verified(first, items, similar)))
        for bands in GROUPS:
            with Passing() as part:
                members = shared.select("v", "n", F.explode(F.slice("bands", bands.start + 1, len(bands))).alias("key"))
                mixed = written(_mixed(members, roots))
                if mixed.isEmpty():
                    continue
                dealt = _dealt(mixed).join(shared.select("v", "sig"), "v").join(items, "v").repartition("key").sortWithinPartitions("key", "v")
                links = dealt.select("key", "v", "sig", "root", "items").mapInArrow(_link_buckets(similar), "a binary, b binary")
                roots = part.keep(_joined(roots, written(links)))
        return whole.keep(roots)


def _least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, root) of the ends of all edges (a, b) of one task."""
    edges = [e for batch in batches for e in zip(*(batch.column(c).to_pylist() for c in ("a", "b")))]
    ends = sorted({v for e in edges for v in e})
    number, up = {v: k for k, v in enumerate(ends)}, list(range(len(ends)))

    def of(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    for a, b in edges:
        x, y = of(number[a]), of(number[b])
        up[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array(ends, pa.binary()), pa.array([ends[of(k)] for k in range(len(ends))], pa.binary())], ["v", "root"])


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for each end of an edge (a, b), by contraction to the least neighbour until there are FEW edges."""
    roots, n = None, edges.count()
    with Passing() as whole:
        while True:
            if n <= FEW:
                up = written(edges.coalesce(1).mapInArrow(_least, "v binary, root binary")).select("v", F.col("root").alias("p"))
            else:
                both = edges.union(edges.select("b", "a")).toDF("v", "w")
                up = both.groupBy("v").agg(F.min("w").alias("p")).select("v", F.least("v", "p").alias("p"))
                up = written(up)
                hop = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
                up = written(spread_join(up, hop, "p", "left").select("v", F.coalesce("q", "p").alias("p")))
            roots = up.select("v", F.col("p").alias("root")) if roots is None else spread_join(roots, up.select(F.col("v").alias("root"), "p"), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
            roots = written(roots)
            if n <= FEW:
                return whole.keep(roots)
            to_a, to_b = up.select(F.col("v").alias("a"), F.col("p").alias("x")), up.select(F.col("v").alias("b"), F.col("p").alias("y"))
            edges = written(spread_join(spread_join(edges, to_a, "a", total=n), to_b, "b", total=n).where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
            n = edges.count()
            if not n:
                return whole.keep(roots)


def decided(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per row of `docs`: doc_id, tkey, class_id, class_size, n_shingles and kept, true once in a class."""
    with Passing() as whole:
        base = signed(docs)
        verts = vertices(base)
        roots = grouped(docs, verts, similar)
        of = written(verts.join(roots, "v", "left").select("v", "rid", "tkey", "uid", "copies", F.coalesce("root", "v").alias("root")))
        first = F.min(F.struct(F.col("rid").isNull().alias("void"), "rid", "tkey", "uid"))
        sums = of.groupBy("root").agg(first.alias("first"), F.sum("copies").alias("class_size"))
        named = written(spread_join(of, written(sums), "root").select("v", F.col("first.rid").alias("class_id"), F.col("first.uid").alias("keep"), "class_size"))
        return whole.keep(written(spread_join(base.select("doc_id", "tkey", "uid", "v", "n"), named, "v").select("doc_id", "tkey", "class_id", "class_size", F.col("n").alias("n_shingles"), (F.col("uid") == F.col("keep")).alias("kept"))))


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its class), class_size, n_shingles, kept."""
    return decided(docs, similar).drop("tkey")


def drop_near_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The rows of `docs` that stay, one of each class. The decision is on rows, so another text under a dropped id stays."""
    with Passing() as whole:
        rows = decided(docs, similar).groupBy("doc_id", "tkey").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
        keep = whole.keep(written(rows.where("kept").select(F.col("doc_id").alias("keep_id"), F.col("tkey").alias("keep_tkey"), "n")))
    own = docs.select(F.struct("*").alias("row"), "doc_id", F.unhex(F.md5(text_or_empty())).alias("tkey"))
    same = (F.col("tkey") == F.col("keep_tkey")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    out = own.join(keep.where("n = 1"), same, "left_semi").select("row.*")
    repeated = keep.where("n > 1")
    if repeated.isEmpty():
        return out
    return out.unionByName(own.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "tkey"]).select("row.*"))
