"""Near-duplicates by a signature-coordinate inverted join.

Each distinct shingle set is a node, numbered when the table of sets is written, and has a MinHash
signature of K = 64 coordinates. A link needs a Jaccard similarity of ``share`` per cent; of two such
sets, fewer than MATCHES = 36 coordinates agree with a probability below 4.3e-6 at 80 %, less above
it. Sets are posted under 32 tokens, each the values of two coordinates, the rarest first: two sets
that share SHARED = 6 tokens share one of their 27 rarest (prefix merging), so the long posting lists
are skipped. Fewer are shared with a probability below 4.3e-6 even together with the miss above.
One coordinate a token would let common shingles alone bring unrelated sets together, the more the
larger the table is; so it is only where ``share`` is less. Tokens that no other set has can't
collide and only use up the prefix. Within a list, collisions are
counted on whole signatures; pairs above the threshold that lengths allow make the candidate graph.
A list of over LIST posts isn't counted in one task: its members become one candidate component.

The components are then verified on full sets: a component is one group of a task, or, when large,
blocks of bounded size. In a large group collisions are counted on 64 coordinates, then on 192 more,
at WIDE of 256 (a miss below 1e-6 at 80 %), and only pairs that pass both meet on full sets, so that
a family of pages with one template, alike to 60 %, costs comparisons of bytes alone. Blocks are
joined through a few leaders that each block gets; after that, rows outside the main class meet every
block, so every pair of different classes is compared, none within a class. Nothing is capped: each
link between different texts is found, but for the probabilities above.

Null and empty texts have empty sets, link with nothing and are their own class. Rows with one doc_id
count as one document, also with different texts, whose classes are then one. Null identifiers come
last; their rows link others, but name no class. Repeated rows are one node. An empty table gives an
empty result. Extra columns don't matter. Very long texts are hashed whole, a task holding a block.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut, map_rows, utf8, written
from .components import components
from .shingles import K, further, shingle_set, signature, tokens

MATCHES = 36
#: Tokens of two coordinates that sets alike to 80 % share at least.
SHARED = 6
#: Longest posting list that is compared pair by pair; all of a longer one counts as candidates.
LIST = 3000
#: A block of a verified group holds about so many shingles or sets at most.
BLOCK_SHINGLES, BLOCK_SETS = 3_000_000, 6000
LEADERS = 4
#: Candidate rows whose table is broadcast at most; with more, texts are shuffled to meet them.
BROADCAST_ROWS = 50_000
#: Groups of so many sets count collisions on further coordinates, where so many of all must agree.
WIDE_FROM, WIDE = 300, 172


def signed(docs: DataFrame, words: int, key: str, text: str, width: int = 1) -> DataFrame:
    """Per row: _id, _th (hash of the text), _n (set size), _key (digest of the set), _sig (a byte a coordinate), _toks (``width`` coordinates each)."""

    def make():
        def work(ids, hashes, texts):
            ns, keys, sigs, toks = [], [], [], []
            for t in texts:
                s = shingle_set(t, words)
                ns.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                sig = signature(s) if len(s) else None
                sigs.append(None if sig is None else (tokens(sig) & np.uint64(255)).astype(np.uint8).tobytes())
                toks.append(None if sig is None else tokens(sig, width).view(np.int64))
            return ids, hashes, ns, keys, sigs, toks

        return work

    return map_rows(docs.select(F.col(key).cast("long"), F.xxhash64(utf8(text)), utf8(text)), make, "_id long, _th long, _n long, _key binary, _sig binary, _toks array<long>")


def postings(reps: DataFrame, least: int) -> DataFrame:
    """(_t, _df, _node, _n, _sig): the rarest tokens of sets that may have a partner, which shares ``least``.

    Spark sizes an exploded table by its rows before, an array as one value: it would broadcast all
    tokens of middling inputs. Hence the hints.
    """
    every = reps.select("_node", F.explode("_toks").alias("_t"))
    df = every.groupBy("_t").agg(F.count("*").alias("_df")).where("_df > 1")
    mine = every.hint("merge").join(df, "_t").groupBy("_node").agg(F.array_sort(F.collect_list(F.struct("_df", "_t"))).alias("_l")).where(F.size("_l") >= least)
    mine = mine.select("_node", F.explode(F.slice("_l", F.lit(1), F.size("_l") - (least - 1))).alias("_p"))
    return mine.hint("merge").join(reps.select("_node", "_n", "_sig"), "_node").select("_p._t", "_p._df", "_node", "_n", "_sig")


class Classes:
    """Union-find over 0..n-1 with labels as an array, the smaller class relabelled."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def union(self, a: int, b: int) -> None:
        a, b = int(self.label[a]), int(self.label[b])
        if a == b:
            return
        if len(self.members[a]) < len(self.members[b]):
            a, b = b, a
        self.label[self.members[b]] = a
        self.members[a] += self.members.pop(b)


def _signatures(sigs) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, K)


def _candidates(i: int, sig: np.ndarray, n: np.ndarray, label: np.ndarray, matches: int, share: int, wide: np.ndarray | None = None) -> np.ndarray:
    """Later rows of other classes that agree in enough coordinates, further ones too, and may be similar by length."""
    rest = slice(i + 1, None)
    at = np.flatnonzero((label[rest] != label[i]) & (100 * np.minimum(n[rest], n[i]) >= share * np.maximum(n[rest], n[i]))) + i + 1
    if len(at):
        count = (sig[at] == sig[i]).sum(1)
        good = count >= matches
        at, count = at[good], count[good]
        if wide is not None and len(at):
            count = count + (wide[at] == wide[i]).sum(1)
            good = count >= WIDE
            at, count = at[good], count[good]
        at = at[np.argsort(-count, kind="stable")]
    return at


def candidate_edges(posts: DataFrame, matches: int, share: int) -> DataFrame:
    """(u, v): a spanning forest of the candidate pairs of each list."""

    def lists(batches):
        for b in batches:
            cols = [c.to_pylist() for c in b.columns]
            yield from zip(*cols)

    def flush(part):
        if len(part) < 2:
            return
        if len(part) == 2:  # most lists
            (_, u, m, a), (_, v, n, b) = part
            if 100 * min(m, n) >= share * max(m, n) and sum(map(eq, a, b)) >= matches:
                yield max(u, v), min(u, v)
            return
        ids = [r[1] for r in part]
        n, sig, found = np.array([r[2] for r in part]), _signatures([r[3] for r in part]), Classes(len(part))
        for i in range(len(part) - 1):
            for j in _candidates(i, sig, n, found.label, matches, share).tolist():
                if found.label[i] != found.label[j]:
                    found.union(i, j)
        for members in found.members.values():
            least = min(ids[m] for m in members)
            yield from ((ids[m], least) for m in members if ids[m] != least)

    def run(batches):
        def rows():
            part = []
            for r in lists(batches):
                if part and part[0][0] != r[0]:
                    yield from flush(part)
                    part = []
                part.append(r)
            yield from flush(part)

        seen = set()
        for e in rows():
            seen.add(e)
            if len(seen) >= 100_000:
                yield _pairs(seen)
                seen = set()
        if seen:
            yield _pairs(seen)

    n = int(posts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cold = posts.where(F.col("_df") <= LIST).select("_t", "_node", "_n", "_sig").repartition(n, "_t").sortWithinPartitions("_t")
    hot = posts.where(F.col("_df") > LIST).select("_t", "_node")
    centre = hot.groupBy("_t").agg(F.min("_node").alias("_c"))
    return cold.mapInArrow(run, "u long, v long").unionByName(hot.join(centre, "_t").where("_node <> _c").select(F.col("_node").alias("u"), F.col("_c").alias("v")))


def _pairs(edges) -> pa.RecordBatch:
    u, v = zip(*edges)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def verified(docs: DataFrame, places: DataFrame, words: int, matches: int, share: int, key: str, text: str) -> DataFrame:
    """(u, v): links on full sets that join different classes, within each group of ``places``.

    ``places`` has _node, _rid and _rth (identifier and text hash of a row with the set), _key, _n,
    _sig, _g (group), _had (the class it is known to be in).
    """
    if places.count() <= BROADCAST_ROWS:  # a checked size
        places = F.broadcast(places)
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.xxhash64(utf8(text)).alias("_th"), utf8(text).alias("_t"))
    rows = rows.join(places, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_th") == F.col("_rth")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("_g", "_node", "_n", "_sig", "_had", "_key", "_t").repartition(n, "_g").sortWithinPartitions("_g", "_n", "_node")

    def flush(part):
        if len(part) < 2:
            return
        ids, n, sig, sets = [r[0] for r in part], np.array([r[1] for r in part]), _signatures([r[2] for r in part]), [r[4] for r in part]
        wide = np.stack([further(s) for s in sets]) if len(part) >= WIDE_FROM and 100 * matches >= 56 * K and share >= 80 else None
        found, first = Classes(len(part)), {}
        for i, r in enumerate(part):
            found.union(i, first.setdefault(r[3], i))
        for i in range(len(part) - 1):
            for j in _candidates(i, sig, n, found.label, matches, share, wide).tolist():
                if found.label[i] != found.label[j]:
                    same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * same >= share * (len(sets[i]) + len(sets[j]) - same):
                        found.union(i, j)
                        yield ids[i], ids[j]

    def run(batches):
        def rows():
            part, group, had = [], None, set()
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    for g, node, n, sig, known, digest, t in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                        if g != group:
                            yield from flush(part)
                            part, group, had = [], g, set()
                        if node in had:  # a repeated row
                            continue
                        s = shingle_set(t, words)
                        if xxhash.xxh3_128_digest(s.tobytes()) == digest:
                            had.add(node)
                            part.append((node, n, sig, known, s))
            yield from flush(part)

        seen = []
        for e in rows():
            seen.append(e)
            if len(seen) >= 100_000:
                yield _pairs(seen)
                seen = []
        if seen:
            yield _pairs(seen)

    return rows.mapInArrow(run, "u long, v long")


#: What a set's row must have to be met again: its node, one row that has it, its digest, size and signature.
_SET = ("_node", "_rid", "_rth", "_key", "_n", "_sig")


def links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame, words: int, matches: int, share: int, key: str, text: str, block_shingles: int = BLOCK_SHINGLES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """(u, v): enough verified links to connect every class. ``nodes``: the columns of _SET; ``candidates``: node, root."""
    placed = nodes.join(candidates, F.col("_node") == F.col("node")).select(*_SET, F.col("root").alias("_c"))
    size = candidates.join(nodes, F.col("_node") == F.col("node")).groupBy("root").agg(F.ceil(F.greatest(F.sum("_n") / block_shingles, F.count("*") / block_sets)).alias("_b"), F.min(F.struct(F.xxhash64("_node"), "_node"))["_node"].alias("_x"))
    placed = cut(placed.join(size.select(F.col("root").alias("_c"), "_b"), "_c").withColumn("_h", F.pmod(F.xxhash64("_node"), F.col("_b"))))
    one = placed.select(*_SET, F.struct("_c", F.lit(0).cast("long").alias("i"), "_h").alias("_g"), F.col("_node").alias("_had"))
    large = placed.where("_b > 1")
    if large.isEmpty():
        return cut(_packed(docs, one, words, matches, share, key, text))
    ranked = large.groupBy("_c", "_b").agg(F.slice(F.array_sort(F.collect_list(F.when(F.pmod(F.xxhash64(F.lit(7), "_node"), F.col("_b")) == 0, F.struct(F.xxhash64("_node").alias("o"), "_node")))), 1, LEADERS).alias("_l"))
    leads = ranked.select("_c", "_b", F.explode("_l").alias("_l")).select("_c", "_b", F.col("_l._node").alias("_lead"))
    leads = leads.join(large.select(*_SET, F.col("_h").alias("_own")), F.col("_lead") == F.col("_node"))
    leads = leads.withColumn("_h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1))).where("_h <> _own")
    one = one.unionByName(leads.select(*_SET, F.struct("_c", F.lit(0).cast("long").alias("i"), "_h").alias("_g"), F.col("_node").alias("_had")))
    first = cut(_packed(docs, one, words, matches, share, key, text))
    classes = components(first)
    known = large.join(classes, F.col("_node") == F.col("node"), "left").withColumn("_k", F.coalesce("root", "_node")).drop("node", "root")
    main = known.groupBy("_c", "_k").agg(F.count("*").alias("_m")).groupBy("_c").agg(F.max_by("_k", F.struct("_m", "_k")).alias("_main"))
    known = cut(known.join(main, "_c"))
    rest = known.where("_k <> _main")
    parts = rest.groupBy("_c").agg(F.ceil(F.greatest(F.sum("_n") / block_shingles, F.count("*") / block_sets)).alias("_r"))
    rest = rest.join(parts, "_c").withColumn("_i", F.pmod(F.xxhash64(F.lit(3), "_node"), F.col("_r")))
    a = known.join(parts, "_c").withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_r") - 1)))
    b = rest.withColumn("_h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_b") - 1)))
    two = a.unionByName(b.select(*a.columns)).select(*_SET, F.struct("_c", (F.col("_i") + 1).alias("i"), "_h").alias("_g"), F.col("_k").alias("_had")).dropDuplicates(["_g", "_node"])
    return cut(first.unionByName(_packed(docs, two, words, matches, share, key, text)))


def _packed(docs, places, words, matches, share, key, text) -> DataFrame:
    name = F.concat_ws(":", *(F.col(f"_g.{c}").cast("string") for c in ("_c", "i", "_h")))
    return verified(docs, places.select(*_SET, name.alias("_g"), "_had"), words, matches, share, key, text)


def near_duplicates(docs: DataFrame, words: int = 5, share: int = 80, matches: int = MATCHES, key: str = "doc_id", text: str = "text", block_shingles: int = BLOCK_SHINGLES, block_sets: int = BLOCK_SETS) -> DataFrame:
    """Per row: ``key``, n_shingles, component_id (smallest identifier reachable), kept.

    ``matches`` must suit ``share``: 36 of 64 coordinates are safe from 80 % on.
    """
    width, least = (2, SHARED) if share >= 80 else (1, matches)
    rows, _ = written(signed(docs, words, key, text, width), "signatures")
    first = F.min(F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("_th").alias("c")))
    sets = rows.where("_n > 0").groupBy("_key").agg(first.alias("_f"), F.count("*").alias("_rows"), F.first("_n").alias("_n"), F.first("_sig").alias("_sig"), F.first("_toks").alias("_toks"))
    nodes, _ = written(sets.select("_key", F.monotonically_increasing_id().alias("_node"), F.col("_f.b").alias("_rid"), F.col("_f.c").alias("_rth"), "_rows", "_n", "_sig", "_toks"), "sets")
    found = components(candidate_edges(postings(nodes, least), matches, share))
    edges = links(docs, nodes.select(*_SET), found, words, matches, share, key, text, block_shingles, block_sets)
    clashes = cut(rows.where("_id is not null").groupBy("_id").agg(F.min("_key").alias("a"), F.max("_key").alias("b")).where("a <> b").select("_id"))
    clashing = not clashes.isEmpty()
    if clashing:  # identifiers over different texts: their sets are one document
        own = cut(rows.where("_n > 0").join(clashes, "_id", "left_semi").select("_id", "_key").distinct().join(nodes.select("_key", "_node"), "_key"))
        edges = edges.unionByName(own.join(own.groupBy("_id").agg(F.min("_node").alias("v")), "_id").where("_node <> v").select(F.col("_node").alias("u"), "v"))
    true = components(edges)
    least = true.join(nodes.select("_node", "_rid"), F.col("node") == F.col("_node")).groupBy("root").agg(F.min("_rid").alias("_least"))
    named = true.join(least, "root").select("node", "_least")
    owner = cut(nodes.join(named, F.col("_node") == F.col("node"), "left").select("_key", "_node", F.when(F.col("node").isNull(), F.col("_rid")).otherwise(F.col("_least")).alias("_root"), "_rows"))
    out = attach(rows.select("_id", "_n", "_key"), "_key", owner, "_key", ("_root",), "_rows")
    if clashing:  # empty texts of such an identifier, too
        of = own.join(owner.select("_node", F.col("_root").alias("_r")), "_node").groupBy("_id").agg(F.min("_r").alias("_r")).withColumnRenamed("_id", "_i")
        out = out.join(of, (F.col("_n") == 0) & (F.col("_id") == F.col("_i")), "left").withColumn("_root", F.coalesce("_root", "_r"))
    own_id = F.coalesce("_root", "_id")
    return out.select(F.col("_id").alias(key), F.col("_n").alias("n_shingles"), own_id.alias("component_id"), F.coalesce(F.col("_id") == own_id, own_id.isNull()).alias("kept"))
