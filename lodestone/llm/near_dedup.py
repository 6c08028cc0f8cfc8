"""Near duplicates by ProbMinHash, banding, and exact verification.

Signatures. A text's distinct shingles (runs of five words) get a ProbMinHash signature: every shingle is a Poisson process whose rate
is its weight; each arrival falls on a random register, a register keeps its earliest arrival, and a process ends when its next arrival
is later than all registers of its text. Two signatures agree in a register with a probability equal to the probability Jaccard of the
weighted sets. All weights are one here: that is the plain Jaccard, which verification takes too, however often a text repeats itself.

Candidates. Registers are hashed in bands. Equal texts are one node first, so a group of copies costs one row. A bucket of a band is dealt
by hashes over parts of about PART_NODES nodes, however alike the nodes are. In a part each node is paired with the part's centre (the node with
the most companions over all bands) and with its neighbour in that order; the parts' centres are paired with the bucket's. That is linear in
the bucket, and no task takes a whole hot one. What a bucket keeps apart even then is compared in full: every node outside the bucket's largest
component with all nodes of other components, by named pairs where they are few, else block by block. So classes are those of all pairs that
share a bucket, with no cap on rounds or partners; only nodes already linked are spared.

Verification. The exact Jaccard of the shingle sets of whole texts, 0.8 or more. The texts that share a bucket with another one are written
once, so later steps read no other. Texts of a centre's pairs meet in one sorted stream; centres with many pairs are split over salts, and
only the centre's text is repeated.

Classes. Connected components of the verified links by alternating large and small stars, each round a table in the shared folder.
A class's id is its smallest doc_id.

Edge cases: a null text is an empty one; texts without a word are alike only if they are equal; texts of one to four words are one shingle;
a null doc_id stays null and counts as larger than any id; repeated rows are copies; an empty table gives no row. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, as_bytes, flat, keep, pieces_of, small_batches, spread
from .wordhash import distinct, mix, shingle_hashes, uniform, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 6
#: Pairs of one centre that go to one task, and nodes of a bucket that are ordered in one.
SALT_PAIRS, PART_NODES = 500, 512
#: Text bytes of a step: a word takes some twenty numbers of eight bytes on its way.
STEP = 512 << 10
#: Buckets of so many nodes, or with so few outside their largest component, have their pairs named; others are compared in blocks of nodes.
NAMED_NODES, NAMED_OTHERS = 32, 2
BLOCK_NODES, BLOCK_SHINGLES = 128, 1_000_000
#: log2 of the bits of a membership map: 4 MB at any size of the input.
MAP_BITS = 25


def signatures(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, docs: int, k: int) -> np.ndarray:
    """ProbMinHash: a row of k registers (the hash that arrived first) for each text; zeros for a text without shingles."""
    first = np.full(docs * k, np.inf)
    value = np.zeros(docs * k, np.uint64)
    time = np.zeros(len(hashes))
    r = 0
    while len(hashes):
        time = time - np.log(uniform(mix(hashes, 2 * r + 11))) / weights
        at = doc * k + (mix(hashes, 2 * r + 12) % np.uint64(k)).astype(np.int64)
        sooner = time < first[at]
        np.minimum.at(first, at[sooner], time[sooner])
        won = sooner & (first[at] == time)
        value[at[won]] = hashes[won]
        lasts = first.reshape(docs, k).max(1) if r < 4 or r % 8 == 0 else lasts  # a late look only costs arrivals
        live = time < lasts[doc]
        doc, hashes, weights, time = doc[live], hashes[live], weights[live], time[live]
        r += 1
    return value.reshape(docs, k)


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band's registers; equal only within the same band."""
    out = np.repeat(np.arange(bands, dtype=np.uint64)[None], len(signature), 0)
    for r in range(rows):
        out = mix(out * np.uint64(5) + signature[:, r::rows][:, :bands], 3)
    return out


def shingles_of(texts: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, shingle hash) with counts, sorted by text and hash."""
    words, hashes = word_hashes(*flat(texts))
    shingles, doc = shingle_hashes(words, hashes, n)
    return distinct(doc, shingles)


def _nodes(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, node (MD5 of the text), size (distinct shingles), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", STEP, 8 * bands * rows):
            texts = as_bytes(batch.column("text"))
            doc, hashes, _ = shingles_of(texts, shingle)
            signed = bands_of(signatures(doc, hashes, np.ones(len(hashes)), len(texts), bands * rows), bands, rows)
            sizes = np.bincount(doc, minlength=len(texts))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]), pa.int32()), pa.array(signed[sizes > 0].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(sizes, pa.int64()), lists], ["doc_id", "node", "size", "bands"])

    return docs.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node binary, size long, bands array<long>")


def _with_node(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(F.encode(text, "UTF-8"))).alias("node"))


def _alike(size_a: Column, size_b: Column, similarity: float) -> Column:
    """Sets of these sizes can have that Jaccard at all."""
    return F.least(size_a, size_b) >= F.greatest(size_a, size_b) * similarity


def may_be_in(rows: DataFrame, key: str, members: DataFrame, member: str) -> DataFrame:
    """Rows whose key may be among the members': all that are, and few others. What isn't needed is so not moved to a join.

    Members set bits of a map of fixed size that goes to all executors; if they are so many that most bits are set, all rows pass.
    """
    place = lambda k: F.pmod(F.xxhash64(k), F.lit(1 << MAP_BITS)) + 1
    bits = members.select(place(F.col(member)).alias("__x"))
    maps = bits.groupBy(F.bitmap_bucket_number("__x").alias("__b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__x")).alias("__m"))
    placed = rows.withColumn("__x", place(F.col(key))).withColumn("__b", F.bitmap_bucket_number("__x")).withColumn("__p", F.bitmap_bit_position("__x"))
    bit = F.expr("shiftright(cast(conv(hex(substring(__m, cast(__p div 8 as int) + 1, 1)), 16, 10) as int), cast(__p % 8 as int)) & 1")
    return placed.join(F.broadcast(maps), "__b").where(bit == 1).select(*rows.columns)


def verify(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose shingle sets have the Jaccard `similarity` at least. texts: node, text."""
    sizes = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    salted = pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / SALT_PAIRS)).cast("long").alias("salt"))
    need = salted.select(F.col("a").alias("node"), F.col("b").alias("centre"), "salt", F.lit(True).alias("member")).unionByName(
        salted.select(F.col("b").alias("node"), F.col("b").alias("centre"), "salt", F.lit(False).alias("member")).distinct()
    )
    met = need.join(texts, "node").select("centre", "salt", "member", "node", "text")
    dealt = met.repartition(spread(pairs.sparkSession), "centre", "salt").sortWithinPartitions("centre", "salt", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, np.empty(0, np.uint64)
        for batch in pieces_of(batches, "text", STEP):
            centres, salts, members, nodes = (batch.column(c).to_pylist() for c in ("centre", "salt", "member", "node"))
            texts = as_bytes(batch.column("text"))
            doc, hashes, _ = shingles_of(texts, shingle)
            edges = np.searchsorted(doc, np.arange(len(texts) + 1))
            found: list[tuple[bytes, bytes]] = []
            for i in range(len(texts)):
                other = hashes[edges[i] : edges[i + 1]]
                if not members[i]:
                    key, own = (centres[i], salts[i]), other
                elif key == (centres[i], salts[i]):
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int((own[at] == other).sum()) if len(own) else 0
                    if both >= similarity * (len(own) + len(other) - both) - 1e-9:
                        found.append((nodes[i], centres[i]))
            columns = [*zip(*found, strict=True)] or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def _to_parts(buckets: DataFrame) -> DataFrame:
    """Each bucket once for each of its parts: what meets a hot bucket's rows by bucket and part meets a bounded number of them."""
    return buckets.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / PART_NODES).cast("long") - 1)))


def _apart(ranked: DataFrame, roots: DataFrame, tmp: Scratch) -> DataFrame:
    """Nodes of buckets that hold several components: bucket, node, size, root, other (not in the bucket's largest one); n and s count nodes and shingles."""
    now = tmp.keep(ranked.join(roots, "node", "left").select("bucket", "part", "node", "size", F.coalesce("root", "node").alias("root")), "rooted")
    parts = now.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    shape = parts.groupBy("bucket").agg(F.max(F.struct("n", "root", "s")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > most.n")
    return now.join(_to_parts(tmp.keep(shape, "shapes")), ["bucket", "part"]).withColumn("other", F.col("root") != F.col("most.root"))


def _named(apart: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of different components of the small buckets of _apart(), each once."""
    small = apart.where((F.col("n") <= NAMED_NODES) | (F.col("n") - F.col("most.n") <= NAMED_OTHERS))
    a = small.where("other").select("bucket", F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("size").alias("a_size"))
    b = small.select("bucket", F.col("node").alias("b"), F.col("root").alias("b_root"), F.col("size").alias("b_size"), F.col("other").alias("b_other"))
    met = a.join(b, "bucket").where("a_root <> b_root and (not b_other or a < b)").where(_alike(F.col("a_size"), F.col("b_size"), similarity))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def alike_sets(sets: list[np.ndarray], group: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of all sets (distinct hashes each) of different groups whose Jaccard is `similarity` at least."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    met = n[at] > 1
    column, row = (np.cumsum(n > 1) - 1)[at[met]], np.repeat(np.arange(len(sets)), sizes)[met]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    for lo in range(0, int((n > 1).sum()), width):
        own = slice(*np.searchsorted(column, [lo, lo + width]))
        has = np.zeros((len(sets), width), np.float32)
        has[row[own], column[own] - lo] = 1
        both += has @ has.T
    shared = both.astype(np.float64)
    return np.nonzero(np.triu((shared >= similarity * (sizes[:, None] + sizes - shared) - 1e-9) & (group[:, None] != group), 1))


def _in_blocks(apart: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The alike pairs (a, b) of different components of the large buckets of _apart(): a task holds two blocks of nodes. texts: node, text.

    Blocks of the largest component meet those of other nodes only, so a settled bucket stays linear.
    """
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces_of(batches, "text", STEP):
            doc, hashes, _ = shingles_of(as_bytes(batch.column("text")), shingle)
            edges = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            own = [hashes[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.binary())], ["node", "shingles"])

    blocks = lambda n, s: F.ceil(F.greatest(n / BLOCK_NODES, s / BLOCK_SHINGLES)).cast("long")
    counted = apart.select("bucket", "node", "root", "other", blocks(F.col("n") - F.col("most.n"), F.col("s") - F.col("most.s")).alias("others"), blocks(F.col("most.n"), F.col("most.s")).alias("mosts"))
    hashed = F.xxhash64("node")
    own = F.when(F.col("other"), F.pmod(hashed, F.col("others"))).otherwise(F.col("others") + F.pmod(hashed, F.col("mosts")))
    last = F.when(F.col("other"), F.col("others") + F.col("mosts") - 1).otherwise(F.col("others") - 1)
    placed = counted.select("bucket", "node", "root", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("with"))
    placed = placed.select("bucket", F.least("own", "with").alias("lo"), F.greatest("own", "with").alias("hi"), "node", "root")
    dealt = placed.join(texts.mapInArrow(sets, "node binary, shingles binary"), "node").repartition(spread(apart.sparkSession), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def found(held: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        nodes, roots, own = zip(*held, strict=True)
        group = np.unique(np.array([r.hex() for r in roots]), return_inverse=True)[1]
        i, j = alike_sets([np.frombuffer(s, np.uint64) for s in own], group, similarity)
        return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in at], pa.binary()) for at in (i, j)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in pieces_of(batches, "shingles"):
            for *at, node, root, own in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lo", "hi", "node", "root", "shingles")), strict=True):
                if at != key:
                    if held:
                        yield found(held)
                    key, held = at, []
                held.append((node, root, own))
        if held:
            yield found(held)

    return dealt.select("bucket", "lo", "hi", "node", "root", "shingles").mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) of all nodes with a link (a, b)."""

    def least(pairs: DataFrame) -> DataFrame:
        """u, v, and m: the least of u and its v's. Minima are pre-aggregated; a node with very many links is a skewed join at most."""
        return pairs.join(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "u")

    with Scratch(links.sparkSession) as tmp:
        links = tmp.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
        seen = None
        for _ in range(most_rounds):
            both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
            large = least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            small = least(large)
            links = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
            links = tmp.keep(links, "links")
            now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
            if now == seen:
                return keep(links.select(F.col("u").alias("node"), F.col("v").alias("root")), "roots")
            seen = now
    raise RuntimeError(f"components are not settled after {most_rounds} rounds")


def _ranked(reps: DataFrame, tmp: Scratch) -> DataFrame:
    """bucket, n (its nodes), part, node, size, rank of the nodes of all buckets that hold several. The node with the most companions is first."""
    placed = reps.where("size > 0").select("node", "size", F.explode("bands").alias("bucket"))
    full = tmp.keep(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "full")
    shared = tmp.keep(may_be_in(placed, "bucket", full, "bucket").join(full, "bucket"), "buckets")
    weight = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / PART_NODES).cast("long"))
    return tmp.keep(shared.join(weight, "node").select("bucket", "n", part.alias("part"), "node", "size", F.struct(-F.col("weight"), F.col("node").alias("node"), F.col("size")).alias("rank")), "ranked")


def _first_pairs(ranked: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b): each node with its part's centre and with the node before it, and parts' centres with their bucket's."""
    in_part = Window.partitionBy("bucket", "part").orderBy("rank")
    order = ranked.select("bucket", "n", "rank", F.lag("rank").over(in_part).alias("before"), F.first("rank").over(in_part).alias("centre"))
    heads = order.where((F.col("n") > PART_NODES) & F.col("before").isNull()).select("bucket", "rank")
    tops = heads.join(heads.groupBy("bucket").agg(F.min("rank").alias("centre")), "bucket").select("rank", "centre")
    near = order.where("before is not null").select("rank", F.explode(F.array_distinct(F.array("before", "centre"))).alias("centre"))
    pairs = near.unionByName(tops).where(F.col("rank.node") != F.col("centre.node")).where(_alike(F.col("rank.size"), F.col("centre.size"), similarity))
    return pairs.select(F.col("rank.node").alias("a"), F.col("centre.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: doc_id, class_id, class_size, n_links (verified links of its text to other texts), node (MD5 of the text), is_first (one document of each class)."""
    spark = docs.sparkSession
    small_batches(spark)
    source = _with_node(docs)
    all_docs = keep(_nodes(source, shingle, bands, rows), "signatures")
    reps = keep(all_docs.groupBy("node", "size", "bands").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "nodes")
    with Scratch(spark) as tmp:
        ranked = _ranked(reps, tmp)
        # One text of each node that shares a bucket. The ids go first, so that other texts are not even hashed.
        wanted = tmp.keep(reps.join(ranked.select("node").distinct(), "node", "left_semi").select("node", "rep"), "wanted")
        read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
        texts = tmp.keep(may_be_in(_with_node(may_be_in(read, "doc_id", wanted, "rep")), "node", wanted, "node").groupBy("node").agg(F.first("text").alias("text")), "texts")

        pairs = tmp.keep(_first_pairs(ranked, similarity), "pairs")
        links = tmp.keep(verify(pairs, texts, shingle, similarity), "verified")
        roots = components(links)
        # The rest, so that no bucket holds two components that have not been compared.
        apart = tmp.keep(_apart(ranked, roots, tmp), "apart")
        named = _named(apart, similarity).join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        more = tmp.keep(verify(tmp.keep(named, "named"), texts, shingle, similarity), "verified")
        large = apart.where((F.col("n") > NAMED_NODES) & (F.col("n") - F.col("most.n") > NAMED_OTHERS))
        if not large.isEmpty():
            more = more.unionByName(tmp.keep(_in_blocks(large, texts, shingle, similarity).distinct(), "verified"))
        if not more.isEmpty():
            roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        both = links.unionByName(more).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        linked = both.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
        rooted = reps.select("node", "rep", "copies").join(roots, "node", "left").join(linked, "node", "left")
        rooted = rooted.select("node", "rep", "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "node").alias("root"))
        classes = rooted.groupBy("root").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"), F.min(F.struct(F.col("rep").isNull(), "rep", "node")).alias("head"))
        of_node = keep(rooted.join(classes, "root").select("node", "class_id", "class_size", "n_links", (F.col("node") == F.col("head.node")).alias("heads")), "classes")
    joined = all_docs.select("doc_id", "node").join(of_node, "node")
    return joined.select("doc_id", "class_id", "class_size", "n_links", "node", (F.col("heads") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("is_first"))


def drop_near_duplicates(docs: DataFrame, **settings: float) -> DataFrame:
    """The documents (all columns) that are the first of their class: one document of each class stays.

    Rows of equal texts are combined before they are moved, so a row is moved at most once.
    """
    heads = near_duplicates(docs, **settings).where("is_first").select(F.col("doc_id").alias("__head"), F.col("node").alias("__node")).distinct()
    heads = keep(heads, "heads")
    text, own = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    placed = may_be_in(docs.select(row, own.alias("__id"), text.alias("__text")), "__id", heads, "__head")
    marked = placed.select("__row", F.struct(F.col("__id").isNull(), F.col("__id")).alias("__order"), F.unhex(F.md5(F.encode("__text", "UTF-8"))).alias("__node"))
    first = marked.groupBy("__node").agg(F.min_by("__row", "__order").alias("__row"))
    return first.join(heads.select("__node"), "__node", "left_semi").select("__row.*")
