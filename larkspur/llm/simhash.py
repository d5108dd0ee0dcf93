"""SimHash near-duplicates: tiled exact comparison of fingerprints, connected components; links of shingle sets by prefixes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import cut, few, light_batches
from larkspur.llm.hashing import gram_hashes, mix, word_hashes
from larkspur.operators.groups import components

#: Rows of a tile above which it is split into chunks that are compared pair by pair.
TILE_ROWS = 2048
#: Rows of a block inside a tile; blocks whose population counts differ beyond the radius are skipped.
BLOCK_ROWS = 256


def _majority(hashes: np.ndarray) -> int:
    """A bit for each of 64 places that is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def shingle_fingerprint(data: bytes, size: int) -> int:
    """SimHash over word shingles, repeats included, hashed with XXH64 of seed 42; fewer words are one shingle."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return _majority(np.array([digest(s, 42) for s in shingles], np.uint64))


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def fingerprints(docs: DataFrame, size: int) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) for each row of docs."""
    light_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"doc_id": rows["doc_id"], "fp": _signed([shingle_fingerprint(bytes(b), size) for b in rows["data"]])})

    data = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    return data.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


#: 64-bit words of the wide fingerprint over shingles, which decides.
WIDE_WORDS = 8
#: Candidates share one of SKETCH_KEYS keys; each is made of the least hashes in SKETCH_ROWS bins of the shingles.
SKETCH_KEYS, SKETCH_ROWS = 12, 4
#: Texts sampled for the shingles that come last in the order of prefixes, and how many these may be.
SAMPLE_ROWS, COMMON = 10_000, 100_000
#: What rounding may take from a bound.
SLACK = 1e-9


def sketch_keys(grams: np.ndarray) -> np.ndarray:
    """Keys of which sets of hashes with Jaccard similarity s share at least one with probability
    1 - (1 - s ** SKETCH_ROWS) ** SKETCH_KEYS: 0.998 for 0.8. An empty bin takes the next filled one's value."""
    bins = SKETCH_KEYS * SKETCH_ROWS
    least = np.full(bins, np.iinfo(np.uint64).max)
    if len(grams):
        mixed = mix(grams, 51)
        at = (mixed % np.uint64(bins)).astype(np.int64)
        np.minimum.at(least, at, mixed)
        filled = np.flatnonzero(np.bincount(at, minlength=bins))
        least = least[filled[np.searchsorted(filled, np.arange(bins)) % len(filled)]]
    return np.array([gram_hashes(mix(row, i), SKETCH_ROWS)[0] for i, row in enumerate(least.reshape(SKETCH_KEYS, SKETCH_ROWS))], np.uint64)


def _shingles(data: bytes, size: int) -> np.ndarray:
    """The distinct hashes of a text's shingles of `size` words (all words, if it has fewer), ascending."""
    words = word_hashes(data.lower())
    return np.unique(gram_hashes(words, min(size, len(words))) if len(words) else words)


def _kept(n: int, similarity: float) -> int:
    """How many first elements of a set of n, in any fixed order of all elements, hold one in common with each set that
    is alike: at most n - similarity * n elements are not in common."""
    return n - math.ceil(similarity * n - SLACK) + 1 if n else 0


def common_shingles(docs: DataFrame, size: int) -> DataFrame:
    """gram and often (in how many texts) of shingles that recur in a sample of about SAMPLE_ROWS texts, COMMON at most."""
    light_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"gram": np.concatenate([np.empty(0, np.int64), *(_shingles(bytes(b), size).view(np.int64) for b in rows["data"])])})

    data = docs.select(F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data"))
    share = 10**6 * SAMPLE_ROWS // max(SAMPLE_ROWS, docs.count())
    some = data.where(F.pmod(F.xxhash64("data"), F.lit(10**6)) < share).distinct()
    often = some.mapInPandas(run, "gram long").groupBy("gram").agg(F.count("*").alias("often"))
    return often.where("often > 2").orderBy(F.desc("often"), "gram").limit(COMMON)


def wide_fingerprints(docs: DataFrame, size: int, similarity: float, common: pd.DataFrame) -> DataFrame:
    """For each row doc_id, mark (hash of the text), node (hash of the set of distinct shingles of `size` words) and n (its
    size), s0.. (SimHash over the set), keys (for candidates) and prefix: the first shingles of the set, common ones last,
    of which sets with a Jaccard similarity of `similarity` or more have at least one in common."""
    light_batches(docs.sparkSession)
    names = [f"s{i}" for i in range(WIDE_WORDS)]
    common = common.sort_values(["often", "gram"])
    grams, place = common["gram"].to_numpy(np.int64).view(np.uint64), np.arange(1, len(common) + 1)
    place, grams = place[np.argsort(grams)], np.sort(grams)

    def one(data: bytes) -> tuple:
        found = _shingles(data, size)
        n, ordered = len(found), found
        if len(grams) and n:
            at = np.minimum(np.searchsorted(grams, found), len(grams) - 1)
            rank = np.where(grams[at] == found, place[at], 0)
            if rank.any():
                ordered = found[np.argsort(rank, kind="stable")]
        node = mix(mix(found, 77).sum(dtype=np.uint64).reshape(1), n & 0xFFFFFFFF)[0]
        prefix = ordered[: _kept(n, similarity)].view(np.int64)
        return node, n, [_majority(mix(found, i + 101)) for i in range(WIDE_WORDS)], sketch_keys(found).view(np.int64), prefix

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            node, n, bits, keys, prefix = zip(*(one(bytes(b)) for b in rows["data"]), strict=True) if len(rows) else [()] * 5
            bits = np.array(bits, np.uint64).reshape(-1, len(names)).view(np.int64)
            sets = pd.DataFrame({"node": np.array(node, np.uint64).view(np.int64), "n": np.array(n, np.int64)})
            yield pd.concat([rows[["doc_id", "mark"]].reset_index(drop=True), sets, pd.DataFrame(bits, columns=names), pd.DataFrame({"keys": list(keys), "prefix": list(prefix)})], axis=1)

    data = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")).withColumn("mark", F.xxhash64("data"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, node long, n long, "
    return data.mapInPandas(run, schema + ", ".join(f"{n} long" for n in names) + ", keys array<long>, prefix array<long>")


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints (rows of 64-bit words) differ, for each pair of rows of a and b."""
    bits = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.int16)
    for k in range(1, a.shape[1]):
        bits += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
    return bits


def tile_links(fps: np.ndarray, left: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links in one tile: positions (child, root).

    left: which rows are of the first chunk; rows of two chunks are compared across, those of one among themselves.
    Rows are ordered by population count, so that blocks too far apart in it are skipped.
    """
    n = len(fps)
    ones = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    fps, ones = fps[order], ones[order]
    label = np.arange(n)
    sides = [np.arange(n)] * 2 if left.all() else [np.flatnonzero(left[order]), np.flatnonzero(~left[order])]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        nonlocal pairs
        if not pairs:
            return
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        while True:
            low = np.minimum(label[a], label[b])
            if (low == label[a]).all() and (low == label[b]).all():
                break
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while (label[label] != label).any():
                label[:] = label[label]
        pairs = []

    held = 0
    for i in range(0, len(sides[0]), BLOCK_ROWS):
        p = sides[0][i : i + BLOCK_ROWS]
        for j in range(i if left.all() else 0, len(sides[1]), BLOCK_ROWS):
            q = sides[1][j : j + BLOCK_ROWS]
            if ones[q[0]] - ones[p[-1]] > radius or ones[p[0]] - ones[q[-1]] > radius:
                continue
            x, y = np.nonzero(_bits(fps[p], fps[q]) <= radius)
            x, y = p[x], q[y]
            keep = x != y
            if keep.any():
                pairs.append((x[keep], y[keep]))
                held += int(keep.sum())
            if held > 1 << 20:
                settle()
                held = 0
    settle()
    child = np.flatnonzero(label != np.arange(n))
    return order[child], order[label[child]]


def tile_forest(fps: np.ndarray, left: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest of the links in one tile by differing bits, as positions (x, y): links of likelier
    duplicates first. Takes the rows as tile_links does; kept links are thinned to a forest whenever 2^20 are held."""
    n = len(fps)
    ones = np.bitwise_count(fps).sum(axis=1, dtype=np.int64)
    order = np.argsort(ones, kind="stable")
    fps, ones = fps[order], ones[order]
    sides = [np.arange(n)] * 2 if left.all() else [np.flatnonzero(left[order]), np.flatnonzero(~left[order])]
    held: list[np.ndarray] = []  # columns: bits, x, y
    for i in range(0, len(sides[0]), BLOCK_ROWS):
        p = sides[0][i : i + BLOCK_ROWS]
        for j in range(i if left.all() else 0, len(sides[1]), BLOCK_ROWS):
            q = sides[1][j : j + BLOCK_ROWS]
            if ones[q[0]] - ones[p[-1]] > radius or ones[p[0]] - ones[q[-1]] > radius:
                continue
            bits = _bits(fps[p], fps[q])
            x, y = np.nonzero(bits <= radius)
            keep = p[x] < q[y] if left.all() else p[x] != q[y]
            if keep.any():
                held.append(np.stack([bits[x, y][keep].astype(np.int64), p[x[keep]], q[y[keep]]]))
            if sum(h.shape[1] for h in held) > 1 << 20:
                held = [_forest(n, np.concatenate(held, axis=1))]
    kept = _forest(n, np.concatenate(held, axis=1)) if held else np.empty((3, 0), np.int64)
    return order[kept[1]], order[kept[2]]


def _forest(n: int, edges: np.ndarray) -> np.ndarray:
    """The edges (columns: weight, x, y) of a minimum spanning forest of n nodes: each round takes every tree's least edge."""
    edges = edges[:, np.lexsort((edges[2], edges[1], edges[0]))]
    label, taken, rest = np.arange(n), np.zeros(edges.shape[1], bool), np.arange(edges.shape[1])
    while len(rest):
        a, b = label[edges[1, rest]], label[edges[2, rest]]
        rest, a, b = rest[a != b], a[a != b], b[a != b]
        if not len(rest):
            break
        least = np.full(n, edges.shape[1])
        np.minimum.at(least, a, rest)
        np.minimum.at(least, b, rest)
        picked = np.unique(least[least < edges.shape[1]])
        taken[picked] = True
        x, y = edges[1, picked], edges[2, picked]
        while (label[x] != label[y]).any():
            low = np.minimum(label[x], label[y])
            np.minimum.at(label, label[x], low)
            np.minimum.at(label, label[y], low)
            while (label[label] != label).any():
                label = label[label]
    return edges[:, taken]


def _linker(names: list[str], radius: int, forest: bool = False) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Turn rows sorted by tile into links; a tile may go on from one batch to the next."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        fps = rows[names].to_numpy(np.int64).view(np.uint64)
        node, left = rows["node"].to_numpy(), rows["own"].to_numpy(bool)
        tile = rows[["key", "i", "j"]].to_numpy(np.int64)
        new = np.flatnonzero(np.concatenate(([True], (tile[1:] != tile[:-1]).any(axis=1))))
        size = np.diff(np.concatenate((new, [len(rows)])))
        a, b = [], []
        for at, n in zip(new[size > 16], size[size > 16], strict=True):
            child, root = (tile_forest if forest else tile_links)(fps[at : at + n], left[at : at + n], radius)
            a.append(node[at + child])
            b.append(node[at + root])
        small = np.repeat(size <= 16, size)
        number = np.repeat(np.arange(len(new)), size)
        for d in range(1, 16):
            x = np.flatnonzero(small[:-d] & (number[:-d] == number[d:])) if len(rows) > d else []
            if not len(x):
                break
            x = x[np.bitwise_count(fps[x] ^ fps[x + d]).sum(axis=1) <= radius]
            a.append(node[x])
            b.append(node[x + d])
        a, b = (np.concatenate([np.empty(0, np.int64), *v]) for v in (a, b))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for rows in batches:
            rows = rows if rest is None else pd.concat([rest, rows], ignore_index=True)
            tile = rows[["key", "i", "j"]].to_numpy(np.int64)
            same = (tile == tile[-1]).all(axis=1) if len(rows) else np.zeros(0, bool)
            if same.all():
                rest = rows
                continue
            last = len(rows) - int(np.argmin(same[::-1]))
            yield links(rows.iloc[:last])
            rest = rows.iloc[last:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield links(rest)

    return run


def link(nodes: DataFrame, keys: Column, names: list[str], radius: int, forest: bool = False) -> DataFrame:
    """Links (a < b) between nodes whose fingerprints (columns `names`) differ in at most `radius` bits and that share
    one of `keys` (array of longs). They join the same nodes as all links within each tile do, but no more than one for
    each row of a tile is returned. Tiles of one node are left out before fingerprints travel. A tile of m nodes, more
    than TILE_ROWS, is split into m / TILE_ROWS chunks, and each pair of chunks is a task's work of its own, so that each
    of its nodes is sent m / TILE_ROWS times. `forest` picks the links of fewest bits (tile_forest)."""
    tiles = nodes.select("node", F.explode(keys).alias("key"))
    sizes = tiles.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.ceil(F.col("m") / TILE_ROWS).cast("int").alias("parts"))
    chunk = F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("parts")).cast("int")
    dealt = tiles.join(sizes, "key").select("node", "key", "parts", chunk.alias("c")).join(nodes.select("node", *names), "node")
    dealt = dealt.select("node", *names, "key", "c", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    pairs = dealt.select("node", *names, "key", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), (F.col("c") <= F.col("other")).alias("own"))
    sorted_tiles = pairs.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return sorted_tiles.mapInPandas(_linker(names, radius, forest), "a long, b long").distinct()


def pigeonhole_keys(fp: str, radius: int, distinct: int) -> Column:
    """Array of keys of which two fingerprints within `radius` bits share at least one.

    The 64 bits are cut into blocks; of b blocks at least b - radius agree, so each choice of b - radius blocks is a
    key. More blocks make longer keys, and so smaller tiles, at the price of more of them: b follows the row count.
    """
    blocks = next((b for b in (radius + 1, radius + 2) if distinct <= 256 * 2 ** (64 * (b - radius) // b)), radius + 3)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << e) - 1) ^ ((1 << s) - 1) for s, e in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return F.array(*(F.xxhash64(F.col(fp).bitwiseAND(F.lit(signed(sum(c)))), F.lit(i)) for i, c in enumerate(combinations(masks, blocks - radius))))


def simhash_components(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """Near-duplicate classes of documents.

    docs has doc_id (long) and text. Returns a row for each row of docs: doc_id, fp (64 bits as a long), component_id
    (the smallest doc_id that can be reached over links of at most `radius` differing bits, itself included). Null,
    empty and blank texts have fingerprint zero and link like any other; rows with a null id get the class of their
    fingerprint, or null where no row with an id shares it. Repeated rows share a class. Other columns are not read.
    """
    marked = cut(fingerprints(docs.select("doc_id", "text"), size))
    nodes = cut(marked.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("node")).where("node is not null"))
    roots = components(link(nodes, pigeonhole_keys("fp", radius, nodes.count()), ["fp"], radius))
    classes = nodes.join(roots, "node", "left").select(F.col("fp").alias("node_fp"), F.coalesce("root", "node").alias("component_id"))
    return marked.join(classes, F.col("fp") == F.col("node_fp"), "left").select("doc_id", "fp", "component_id")


def verified(links: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The links (a, b) between nodes (node, first: doc_id and mark of a text) whose sets of shingles have a Jaccard
    similarity of `similarity` or more; shingles are compared by 64-bit hashes, two empty sets are alike."""
    light_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"node": rows["node"], "grams": [_shingles(bytes(b), size).view(np.int64) for b in rows["data"]]})

    ends = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = cut(nodes.select("node", "first").join(ends, "node", "left_semi"))
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("data")).withColumn("mark", F.xxhash64("data"))
    texts = texts.join(few(asked), (F.col("mark") == F.col("first.mark")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))).select("node", "data").dropDuplicates(["node"])
    sets = cut(texts.mapInPandas(run, "node long, grams array<long>"))
    both = links.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    enough = shared >= similarity * (F.size("x") + F.size("y") - shared) - SLACK
    return both.where(enough).select("a", "b")


def tile_meetings(node: np.ndarray, root: np.ndarray, n: np.ndarray, left: np.ndarray | None, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (x, y) of all pairs of rows in one tile whose roots differ and whose sizes allow the similarity; left:
    which rows are of the first of two chunks that are compared across. No pair is made inside the largest class."""
    roots, which, count = np.unique(root, return_inverse=True, return_counts=True)
    if len(roots) == 1:
        return
    large = which == np.argmax(count)
    rest, large = np.flatnonzero(~large), np.flatnonzero(large)
    for other, among in ((rest, True), (large, False)):
        other = other[np.argsort(n[other], kind="stable")]
        sizes = n[other]
        low = np.searchsorted(sizes, np.ceil(similarity * n[rest] - SLACK), "left")
        high = np.searchsorted(sizes, np.floor((n[rest] + SLACK) / similarity), "right")
        for at in range(0, len(rest), BLOCK_ROWS):
            width = high[at : at + BLOCK_ROWS] - low[at : at + BLOCK_ROWS]
            x = np.repeat(rest[at : at + BLOCK_ROWS], width)
            y = other[np.arange(width.sum()) + np.repeat(low[at : at + BLOCK_ROWS] - (np.cumsum(width) - width), width)]
            keep = root[x] != root[y]
            if among:
                keep &= node[x] < node[y]
            if left is not None:
                keep &= left[x] != left[y]
            yield x[keep], y[keep]


def _meeter(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turn rows (tile, node, root, n, side) sorted by tile into the pairs that meet there; a tile may go on from one batch
    to the next. side: 0 for rows compared among themselves, 1 and 2 for two chunks compared across."""

    def out(rows: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = np.where(rows[1, x] < rows[1, y], [x, y], [y, x])
        for at in range(0, len(a), 1 << 17):
            p, q = a[at : at + (1 << 17)], b[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (rows[1, p], rows[1, q], rows[3, p], rows[3, q])], ["a", "b", "na", "nb"])

    def meet(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        tile, node, root, n, side = rows
        new = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
        count = np.diff(np.concatenate((new, [len(tile)])))
        for at, m in zip(new[count > 16], count[count > 16], strict=True):
            part = rows[:, at : at + m]
            for x, y in tile_meetings(part[1], part[2], part[3], part[4] == 1 if part[4].any() else None, similarity):
                yield from out(part, x, y)
        few_rows, number = np.repeat(count <= 16, count), np.repeat(np.arange(len(new)), count)
        for d in range(1, min(16, len(tile))):
            x = np.flatnonzero(few_rows[:-d] & (number[:-d] == number[d:]))
            if not len(x):
                break
            y = x + d
            small, big = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            keep = (root[x] != root[y]) & (small >= similarity * big - SLACK) & ((side[x] == 0) | (side[x] != side[y]))
            yield from out(rows, x[keep], y[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]))
            count += batch.num_rows
            if count < 1 << 16:
                continue
            rows = np.concatenate(held, axis=1)
            last = int(np.searchsorted(rows[0], rows[0, -1], "left"))
            if last:
                yield from meet(rows[:, :last])
            held = [rows[:, last:]]
            count = 0 if last == 0 else len(rows[0]) - last
        if held and sum(h.shape[1] for h in held):
            yield from meet(np.concatenate(held, axis=1))

    return run


def meetings(nodes: DataFrame, common: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a < b) of nodes (node, root, n, prefix) with different roots that can have a Jaccard similarity of `similarity`
    or more; none that has is left out.

    Such sets have a prefix shingle in common, so pairs meet at equal shingles. Of two prefixes of the same order, one ends
    first; what its set has behind it bounds what the sets can share beyond the prefix shingles in common, which are
    counted. Shingles of `common` (gram) that one root alone has are left out; if more than TILE_ROWS nodes have one,
    these are dealt to chunks that are compared pair by pair.
    """
    tokens = nodes.select("node", "root", "n", F.explode("prefix").alias("token"))
    grams = F.broadcast(common.select(F.col("gram").alias("token")))
    seen = tokens.join(grams, "token").groupBy("token").agg(F.count("*").alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    seen = cut(seen.select("token", F.when(F.col("lo") < F.col("hi"), F.ceil(F.col("m") / TILE_ROWS).cast("int")).otherwise(0).alias("parts")))
    dealt = tokens.join(F.broadcast(seen), "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).where("parts > 0")
    columns = lambda tile, side: (tile.alias("tile"), "node", "root", "n", side.cast("long").alias("side"))
    single = dealt.where("parts = 1").select(*columns(F.col("token"), F.lit(0)))
    c, other = F.col("c"), F.col("other")
    split = dealt.where("parts > 1").withColumn("c", F.pmod(F.xxhash64("node", F.lit("chunk")), F.col("parts")).cast("int"))
    split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = F.when(c == other, 0).when(c < other, 1).otherwise(2)
    split = split.select(*columns(F.xxhash64("token", F.least(c, other), F.greatest(c, other)), side))
    tiles = single.unionByName(split).repartition("tile").sortWithinPartitions("tile")
    met = tiles.mapInArrow(_meeter(similarity), "a long, b long, na long, nb long").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    behind = lambda n: F.ceil(similarity * F.col(n) - SLACK) - 1
    most = F.col("shared") + F.greatest(behind("na"), behind("nb"))
    return met.where(most >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - SLACK).select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """Near-duplicate classes by the Jaccard similarity of `size`-word shingles: texts linked by `similarity` or more.

    First candidates share a key of a sketch of their shingles (sketch_keys) and differ in few bits of a SimHash of 512 bits
    over shingles: sets with Jaccard similarity s have cosine 2s / (1 + s) when they are of one size, bits differ with
    probability angle / pi, and the radius lies three standard deviations above the expectation. Of each tile's candidates
    those of a minimum spanning forest are compared by their whole sets of shingles. This finds most links, not all; then
    sets of different classes meet by a prefix of their shingles (meetings), which misses none, and are compared likewise.
    The sample behind common_shingles settles the order of shingles only, so costs, not results, depend on it.
    Returns doc_id, mark (XXH64 of the text, to tell rows of one id apart) and component_id: the smallest doc_id that can be
    reached over links, itself included. Rows with a null id link like any other; their component_id is null where no row
    with an id is reached. Rows of one id may have different texts, which are linked by their likeness only. Texts
    without words are alike.
    """
    names = [f"s{i}" for i in range(WIDE_WORDS)]
    common = common_shingles(docs.select("text"), size).toPandas()
    marked = cut(wide_fingerprints(docs.select("doc_id", "text"), size, similarity, common))
    text = F.struct("doc_id", "mark")
    first = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), text)), F.min(text)).alias("first")
    nodes = cut(marked.groupBy("node").agg(first, *(F.first(c).alias(c) for c in ("n", *names, "keys", "prefix"))))
    p = float(np.arccos(min(1.0, 2 * similarity / (1 + similarity))) / np.pi)
    bits = 64 * WIDE_WORDS
    radius = round(bits * p + 3 * (bits * p * (1 - p)) ** 0.5)
    found = cut(link(nodes.select("node", *names, "keys"), F.col("keys"), names, radius, forest=True))
    links = cut(verified(found, nodes, docs, size, similarity))
    classed = lambda roots: nodes.select("node", "n", "first", "prefix").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = components(links)
    grams = docs.sparkSession.createDataFrame(common, "gram long, often long")
    missed = cut(meetings(classed(roots), grams, similarity))
    more = cut(verified(missed, nodes, docs, size, similarity))
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    members = classed(roots).select("node", "root", F.col("first.doc_id").cast("long").alias("least"))
    least = members.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.select("doc_id", "mark", "node").join(members.join(least, "root").select("node", "component_id"), "node").select("doc_id", "mark", "component_id")
