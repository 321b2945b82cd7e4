"""N-gram Jaccard self-join of documents by a MinHash LSH forest and exact verification."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import claim, give_back, kept, map_texts, runs_of_key
from tabwright.llm.components import components

WORDS = 5
SIMILARITY = 0.8
TREES = 16
DEEPEST = 8
#: Recall that a pair of just the wanted similarity must have, and that the found pairs of each band of similarities must
#: have by estimate.
LEAST_RECALL = 0.998
TARGET_RECALL = 0.999
BAND = 0.05
#: Members of a bucket that are compared in one task; documents and bytes of hashes of a group that are verified in one block.
CHUNK = 4096
BLOCK = 512
BLOCK_BYTES = 4 * 1024 * 1024
#: Bits of the map that says which doc_ids may be in a candidate group: a fixed 8 MB, whatever the corpus.
MAP_BITS = 1 << 26
CACHED_WORDS = 300_000

_HASHES = TREES * DEEPEST
_draw = np.random.default_rng(20_011)
_MULTIPLY = _draw.integers(1, 2 ** 63, _HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _draw.integers(0, 2 ** 63, _HASHES, dtype=np.uint64)
_PLACE = _draw.integers(1, 2 ** 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = re.compile(r"\w+")
_known: dict[str, int] = {}


def _word_hash(word: str) -> int:
    found = _known.get(word)
    if found is None:
        found = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(_known) < CACHED_WORDS:
            _known[word] = found
    return found


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes, ascending, of the runs of ``width`` lower-case words; a shorter text is one run."""
    words = _WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    width = min(width, len(w))
    h = np.full(len(w) - width + 1, len(w) if len(w) < WORDS else 0, np.uint64)
    for j in range(width):
        h += w[j:len(w) - width + 1 + j] * _PLACE[j]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash signature: for each tree the ``DEEPEST`` values of its label, in order."""
    out = np.full(_HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(hashes), 2048):
        part = (hashes[start:start + 2048, None] * _MULTIPLY + _ADD) >> np.uint64(32)
        np.minimum(out, part.min(axis=0).astype(np.uint32), out=out)
    return out


def recall(similarity, depth: int, trees: int = TREES):
    """Chance that two documents share a prefix of ``depth`` values in some tree."""
    return 1.0 - (1.0 - similarity ** depth) ** trees


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, node (digest of the shingle set, null without words), size of the set, and the signature as ``low`` and
    ``high``: the lowest byte of every value, which also serves as its sketch, and the byte above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles", _known.clear)
        for batch in batches:
            digests, sizes, low, high = [], [], [], []
            for text in batch["text"]:
                h = shingles(text.as_py(), width)
                s = signature(h)
                digests.append(hashlib.md5(h.tobytes()).digest() if len(h) else None)
                sizes.append(len(h))
                low.append((s & np.uint32(0xFF)).astype(np.uint8).tobytes())
                high.append((s >> np.uint32(8) & np.uint32(0xFF)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(low, pa.binary()), pa.array(high, pa.binary())],
                names=["doc_id", "node", "size", "low", "high"])
        give_back()

    return map_texts(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null"),
        run, "doc_id bigint, node binary, size bigint, low binary, high binary")


def _leaders(rows: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b, agree) within each (bucket, chunk) that keep together whatever may be ``similarity`` alike.

    A member starts as leader unless a leader is at most twice the wanted distance away, and is tied to every
    leader at most three times that distance away: so two members at the wanted distance share a leader. ``extra``
    widens both by four standard errors of the sketch. Of the ties only as many are written as keep connected what
    they connect: one per member, and one per leader that meets another group. Leaders of a bucket of several chunks
    are all tied to the bucket's first member."""
    hashes = _HASHES
    far = 1.0 - similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        extra = 4.0 * np.sqrt(0.25 / hashes)
        near, tied = (1.0 - 2.0 * far) * hashes, max(1.0, (1.0 - 3.0 * far - extra) * hashes)
        for group in runs_of_key(batches, "key"):
            nodes = group["id"].to_pylist()
            sketches = np.frombuffer(b"".join(group["low"].to_pylist()), np.uint8).reshape(len(nodes), hashes)
            a, b, agree = [], [], []
            free, owner = np.ones(len(nodes), bool), np.full(len(nodes), -1)
            first, several = group["least"][0].as_py(), group["chunks"][0].as_py() > 1
            while free.any():
                lead = int(free.argmax())
                same = (sketches == sketches[lead]).sum(axis=1)
                ties = np.flatnonzero(same >= tied)
                met = np.unique(owner[ties[owner[ties] >= 0]])
                new = ties[owner[ties] < 0]
                a += [nodes[lead]] * len(new)
                b += [nodes[i] for i in new]
                agree += same[new].tolist()
                for other in met:  # whoever has a member in common becomes one
                    a.append(nodes[lead])
                    b.append(nodes[other])
                    agree.append(0)
                owner[new] = lead
                owner[np.isin(owner, met)] = lead
                if several:
                    a.append(first)
                    b.append(nodes[lead])
                    agree.append(0)
                free &= same < near
                free[lead] = False
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(agree, pa.int32())], names=["a", "b", "agree"])

    return rows.mapInArrow(run, "a bigint, b bigint, agree int")


def _matched(nodes: DataFrame, depth: int, similarity: float) -> DataFrame:
    """Distinct edges between ids of nodes with equal prefixes of ``depth`` values. A prefix is a 64-bit hash here, as
    the id is one of the node: where two of them meet by chance, a candidate more is verified."""
    prefix = lambda t: F.xxhash64(F.lit(t), F.substring("low", t * DEEPEST + 1, depth), F.substring("high", t * DEEPEST + 1, depth))
    tries = nodes.select("id", F.explode(F.array(*map(prefix, range(TREES)))).alias("prefix"))
    buckets = tries.groupBy("prefix").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("least")).where("m > 1")
    chunks = F.ceil(F.col("m") / F.lit(CHUNK)).cast("int")
    members = tries.join(buckets, "prefix").withColumn("chunks", chunks).select(
        "id", "least", "chunks", F.xxhash64("prefix", F.pmod("id", F.col("chunks"))).alias("key"))
    sketched = members.join(nodes.select("id", "low"), "id")
    spread = sketched.repartition("key").sortWithinPartitions("key", "id")
    return _leaders(spread, similarity).where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("agree").alias("agree"))


def candidate_edges(nodes: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, int]:
    """Edges of the forest and the depth they were found at.

    Prefixes are shortened from the deepest: first until a pair of just the wanted similarity is found with
    ``LEAST_RECALL``, then, level by level, until the found pairs of every band of similarities speak for
    ``TARGET_RECALL``: each stands for 1 / recall pairs of its similarity. Bands are judged apart, so that a large
    group of nearly equal texts does not speak for the rare pairs near the threshold."""
    depth = DEEPEST
    while depth > 1 and recall(similarity, depth) < LEAST_RECALL:
        depth -= 1
    while True:
        edges = kept(_matched(nodes, depth, similarity), "edges")
        alike = F.col("agree") / F.lit(float(_HASHES))
        stands_for = 1.0 / (1.0 - F.pow(1.0 - F.pow(alike, F.lit(depth)), F.lit(TREES)))
        bands = edges.where(alike >= similarity).groupBy(F.floor(alike / BAND).alias("band")).agg(
            F.count(F.lit(1)).alias("there"), F.sum(stands_for).alias("wanted")).collect()  # a row per band
        if depth == 1 or all(r["there"] / r["wanted"] >= TARGET_RECALL for r in bands):
            return edges, depth
        depth -= 1


def _pairs_of_block(group: pa.Table, similarity: float) -> tuple[list, list, list]:
    """(node, links, root) of the documents of one cell: one block with itself, or two blocks with each other."""
    nodes, sizes, rows, side = [], [], [], []
    for i, members in enumerate(group["members"].to_pylist()):
        for m in members:
            nodes.append(m["node"])
            sizes.append(m["n"])
            rows.append(np.frombuffer(m["hashes"], np.uint64))
            side.append(i)
    side = np.array(side)
    lengths = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), lengths)
    values, column, seen = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(seen > 1)
    place = np.full(len(values), -1)
    place[shared] = np.arange(len(shared))
    common = np.zeros((len(rows), len(rows)), np.int64)
    at = place[column]
    for start in range(0, len(shared), 4096):
        use = (at >= start) & (at < start + 4096)
        x = np.zeros((len(rows), 4096), np.float32)
        x[owner[use], at[use] - start] = 1
        common += (x @ x.T).astype(np.int64)
    union = lengths[:, None] + lengths[None, :] - common
    link = common >= similarity * union - 1e-9
    np.fill_diagonal(link, False)
    if group.num_rows > 1:
        link &= side[:, None] != side[None, :]
    links = link @ np.array(sizes)
    root = np.arange(len(rows))
    for i in range(len(rows)):  # least root along the links, by repeated relabelling of whole groups
        for j in np.flatnonzero(link[i, :i]):
            if root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root[root == high] = low
    keep = np.flatnonzero(links)
    return [nodes[i] for i in keep], links[keep].tolist(), [nodes[root[i]] for i in keep]


def _verified(blocks: DataFrame, similarity: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs_of_key(batches, "cell"):
            found = _pairs_of_block(group, similarity)
            wide = group["wide"][0].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[0], pa.binary()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.binary()), pa.array([wide] * len(found[0]), pa.bool_())],
                names=["node", "links", "root", "wide"])
        give_back()

    return blocks.mapInArrow(run, "node binary, links bigint, root binary, wide boolean")


def _hashed(rows: DataFrame, width: int) -> DataFrame:
    """The shingle hashes of the node a row was fetched for; rows of other nodes of that doc_id fall away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles", _known.clear)
        for batch in batches:
            hashes = [shingles(t.as_py(), width) for t in batch["text"]]
            own = [hashlib.md5(h.tobytes()).digest() == n for h, n in zip(hashes, batch["node"].to_pylist())]
            batch = batch.drop_columns(["text"]).append_column("hashes", pa.array([h.tobytes() for h in hashes], pa.binary()))
            yield batch.filter(pa.array(own, pa.bool_()))
        give_back()

    return map_texts(rows.select("node", "n", "group", "blocks", "text"), run, "node binary, n bigint, `group` bigint, blocks int, hashes binary")


def _of_wanted(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id may be a ``first_id`` of ``wanted``: a bit of a map of ``MAP_BITS`` bits stands for
    each, so that few other texts are shuffled. The map is broadcast; its size does not depend on the data."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(MAP_BITS))
    bits = wanted.select(bit("first_id").alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    rows = docs.withColumn("bit", bit("doc_id")).withColumn("bucket", F.bitmap_bucket_number("bit"))
    at = F.bitmap_bit_position("bit")
    byte = F.conv(F.hex(F.substring("map", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(bits), "bucket").where(F.bit_get(byte, (at % 8).cast("int")) == 1).drop("bit", "bucket", "map")


def near_classes(docs: DataFrame, similarity: float = SIMILARITY, width: int = WORDS) -> DataFrame:
    """doc_id, class_id and n_links of every row of ``docs`` (needs doc_id and text; other columns are ignored).

    Two rows are linked when the Jaccard similarity of their sets of ``width``-word shingles (lower-case words; a
    shorter text is one shingle) is ``similarity`` or more. n_links counts the linked rows, class_id is the smallest
    doc_id of the rows connected by links. A text that is null or has no words, and a row with null doc_id, has no
    links and its own class (its doc_id). Rows that repeat doc_id and text count as linked copies. No rows give no
    rows.

    Rows of equal shingle sets are one node. The forest ties nodes into candidate groups, whose sets are compared
    exactly and in whole: large groups in cells of two blocks, so that no task holds a whole group and no pair is
    written out; a cell gives each node its number of links and one root.
    """
    rows = _row_classes(docs, similarity, width)[0].select("doc_id", "class_id", "n_links")
    lost = docs.where("doc_id is null").select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return rows.unionByName(lost)


def _row_classes(docs: DataFrame, similarity: float, width: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, node, class_id and n_links of every row with a doc_id; and node, first_id, n and root of every node."""
    signed = kept(_signed(docs, width), "signed")
    nodes = kept(signed.where("node is not null").groupBy("node").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("low").alias("low"),
        F.first("high").alias("high")).withColumn("id", F.xxhash64("node")), "nodes")
    edges, _ = candidate_edges(nodes, similarity)
    groups = components(edges).select("id", F.col("label").alias("group"))
    member = nodes.select("id", "node", "first_id", "n", "size").join(groups, "id").drop("id")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("int")
    wanted = kept(member.join(member.groupBy("group").agg(blocks.alias("blocks")), "group"), "wanted")
    texts = _of_wanted(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null"), wanted)
    hashed = _hashed(texts.withColumnRenamed("doc_id", "first_id").join(wanted, "first_id"), width)
    packed = hashed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).groupBy(
        "group", "blocks", "block", "node").agg(F.first("n").alias("n"), F.first("hashes").alias("hashes")).groupBy("group", "blocks", "block").agg(
        F.collect_list(F.struct("node", "n", "hashes")).alias("members"))
    cells = packed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    name = F.concat_ws(":", "group", F.least("block", "other"), F.greatest("block", "other"))
    placed = cells.select(name.alias("cell"), (F.col("blocks") > 1).alias("wide"), "members").repartition("cell").sortWithinPartitions("cell")
    found = kept(_verified(placed, similarity), "links")
    joined = components(found.where("wide").select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = found.where("not wide").select("node", "root").unionByName(joined.select(F.col("id").alias("node"), F.col("label").alias("root")))
    linked = found.groupBy("node").agg(F.sum("links").alias("links")).join(roots.groupBy("node").agg(F.min("root").alias("root")), "node")
    known = nodes.select("node", "first_id", "n").join(linked, "node", "left").select(
        "node", "first_id", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    named = known.join(known.groupBy("root").agg(F.min("first_id").alias("class_id")), "root").select("node", "class_id", (F.col("links") + F.col("n") - 1).alias("n_links"))
    rows = signed.select("doc_id", "node").join(named, "node", "left").select(
        "doc_id", "node", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return rows, known


def _with_nodes(packed: DataFrame, width: int) -> DataFrame:
    """_row (all columns) and node of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("shingles", _known.clear)
        for batch in batches:
            hashes = [shingles(t.as_py(), width) for t in batch["_row"].field("text")]
            yield batch.append_column("node", pa.array([hashlib.md5(h.tobytes()).digest() if len(h) else None for h in hashes], pa.binary()))
        give_back()

    return map_texts(packed, run, packed.schema.simpleString().removeprefix("struct<")[:-1] + ", node binary")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, width: int = WORDS) -> DataFrame:
    """``docs`` with one document of each class, all columns: that of the smallest doc_id, of several such texts that of
    the smallest shingle digest, and one of the rows that repeat it. Texts without words and rows with null doc_id stay.

    Most doc_ids stay or go as a whole, and their rows are not looked at again; only where a doc_id has rows of both
    kinds, or repeats, each row is judged by its own text."""
    rows, known = _row_classes(docs, similarity, width)
    first = known.groupBy("root").agg(F.min(F.struct("first_id", "node")).alias("keep")).select(F.col("keep.node").alias("node"), F.lit(True).alias("stays"))
    judged = rows.join(first, "node", "left").withColumn("stays", F.col("node").isNull() | (F.coalesce("stays", F.lit(False)) & (F.col("class_id") == F.col("doc_id"))))
    ids = judged.groupBy(F.col("doc_id").alias("_id")).agg(
        F.count_if("stays").alias("stay"), F.count(F.lit(1)).alias("n"), F.count("node").alias("texts")).where("stay < n or n > 1 and texts > 0")
    plan = kept(ids.select("_id", (F.col("stay") > 0).alias("_mixed")), "judged")
    packed = docs.select(F.struct("*").alias("_row"))
    of_id = F.col("_row.doc_id") == F.col("_id")
    whole = packed.join(plan.select("_id"), of_id, "left_anti").select("_row.*")
    if plan.where("_mixed").isEmpty():
        return whole
    mixed = _with_nodes(packed.join(plan.where("_mixed").select("_id"), of_id, "left_semi"), width)
    pairs = judged.where("stays and node is not null").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct()
    chosen = mixed.join(pairs, (F.col("_row.doc_id") == F.col("_id")) & (F.col("node") == F.col("_node")), "left_semi")
    one = mixed.where("node is null").unionByName(chosen.dropDuplicates(["node"]))
    return whole.unionByName(one.select("_row.*"))
