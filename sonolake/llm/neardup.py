"""Near-dedup of the pipeline: SimHash candidates, verified by the exact Jaccard similarity of five-word shingles.

op1's settings find texts that are all but equal; here two texts belong together if the sets of their five-word shingles have a
Jaccard similarity of 0.8 or more. A class is a connected component of verified pairs, and one row of each class stays.

Candidates: a text's fingerprint has 128 bits (a bit is set where over half of the shingles' hashes have it, ties go by the least
hash), so a pair at 0.8 is 19 bits apart on average. Each of several tables groups the fingerprints by a few random bits; bits per
table follow the number of texts, tables follow from the bits, so that a pair at 0.8 shares a bucket with probability REACH. In a
bucket, blocks of 64 are compared in vertical bit planes as in op1, then the second half is counted.

A bucket whose pairs are many returns a least spanning forest of them by distance, not all; what a forest left out between classes that its
verified edges did not join is compared again and verified where it is met, a piece of a bucket with its texts at a time (members_apart,
verified_pieces). Buckets over PIECE members are sorted by
several random choices of bits and compared in pieces of each order (as many as let a pair at the radius share a piece with probability REACH),
and with their medoid as a whole. Candidates that hang together form a group. The texts of a group meet in one task, where each moves once; groups
with over GROUP_BYTES of text are verified pair by pair, each text's nearest candidate and medoid first, of the others only
those that would join two classes. Equal texts are one node. Only texts that have candidates move, found by a Bloom filter of bounded size, and the rows that
stay are told from those that go by two more, so that neither join deals out all texts.

Texts of under five words are one shingle; nulls and texts without words have none and are equal to each other. Null ids come last
in a class. Of repeated rows (equal id and text) one stays; a row whose id repeats with another text is judged by its own text. Empty
tables give empty results; other columns are carried on, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolake.llm.common import bloom, components, cut, join_labels, lookahead, maybe_in, whole
from sonolake.llm.quality import text_key
from sonolake.llm.simhash import near, planes

SHINGLE = 5
#: A pair at the similarity 0.8 shares a bucket of some table with that probability.
REACH = 0.97
#: A bit of both fingerprints agrees with that probability at 0.8: 1 - arccos(2 * 0.8 / 1.8) / pi.
AGREE = 1 - math.acos(1.6 / 1.8) / math.pi
#: Bits that may differ, of 128 and of the first 64 (2.3 and 2.9 standard deviations above the mean at 0.8).
RADIUS, RADIUS_HALF = 29, 18
PIECE = 1024
#: A group of candidates with so much text is verified in one task.
GROUP_BYTES = 8 << 20
#: A bucket's pairs leave as they are up to so many per member.
PAIRS = 8
#: Marks a pair of a forest: others of its bucket were left out.
FOREST = 2
_BLOCK = 64
_TASKS = 1 << 16
_SLICE = 8192


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct XXH64 values of a UTF-8 text's shingles, sorted."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    k = min(SHINGLE, len(found))
    starts = np.concatenate(([0], ends[: len(found) - k])).tolist()
    view, digest = memoryview(line), xxhash.xxh64_intdigest
    return np.unique(np.array([digest(view[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], np.uint64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Two words of 64 bits for the hashes of a text."""
    if not len(hashes):
        return np.zeros(2, np.uint64)
    other = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    both = np.stack([hashes, other ^ (other >> np.uint64(29))], axis=1).astype("<u8")
    counts = np.zeros(128, np.int64)
    for i in range(0, len(both), 1 << 14):
        counts += np.unpackbits(both[i : i + (1 << 14)].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    least = np.unpackbits(both[0].view(np.uint8), bitorder="little").astype(bool)
    return np.packbits((counts * 2 > len(both)) | ((counts * 2 == len(both)) & least), bitorder="little").view("<u8")


def tables(n: int, seed: int = 7) -> list[tuple[int, int]]:
    """For n texts, the masks (of both words, signed) of the bits that each table groups by."""
    bits = min(24, max(8, math.ceil(math.log2(max(n, 1) / 64))))
    count = math.ceil(math.log(1 - REACH) / math.log(1 - AGREE**bits))
    rng = np.random.default_rng(seed)
    chosen = [rng.choice(128, bits, replace=False).tolist() for _ in range(count)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [(signed(sum(1 << b for b in c if b < 64)), signed(sum(1 << b - 64 for b in c if b >= 64))) for c in chosen]


def distance(fps: np.ndarray, i: np.ndarray, j: np.ndarray | int) -> np.ndarray:
    return np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64)


def close_pairs(fps: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i < j of one run (sorted) within the radius, and their distance."""
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    sizes = np.diff(np.append(starts, len(run)))
    blocks = -(-sizes // _BLOCK)
    first_block = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    which = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(len(run)) - starts[which]
    at = (first_block[which] + inside // _BLOCK) * _BLOCK + inside % _BLOCK
    n = int(blocks.sum()) * _BLOCK
    slots, owner = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
    slots[at], owner[at] = fps[:, 0], np.arange(len(run))
    valid = np.packbits(owner.reshape(-1, _BLOCK) >= 0, axis=1, bitorder="little").view("<u8")[:, 0]
    sliced = np.concatenate([planes(slots[i : i + 4096 * _BLOCK]) for i in range(0, n, 4096 * _BLOCK)])
    count = inside // _BLOCK + 1  # a value is compared with its own block and those before
    query = np.repeat(np.arange(len(run)), count)
    block = np.repeat(first_block[which], count) + np.arange(len(query)) - np.repeat(np.cumsum(count) - count, count)
    found = []
    for lo in range(0, len(query), _TASKS):
        q, b = query[lo : lo + _TASKS], block[lo : lo + _TASKS]
        task, hits = near(fps[q, 0], b, sliced, valid, list(range(64)), RADIUS_HALF)
        for k in range(0, len(task), 4096):
            t, bit = np.nonzero(np.unpackbits(hits[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            t = task[k : k + 4096][t]
            j, i = q[t], owner[b[t] * _BLOCK + bit]
            i, j = i[i < j], j[i < j]
            d = distance(fps, i, j)
            found.append(np.stack([i, j, d])[:, d <= RADIUS])
    i, j, d = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    return i, j, d


def forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the pairs of a least spanning forest by d (Boruvka)."""
    order = np.argsort(d, kind="stable")
    i, j = i[order], j[order]
    parent, taken, open_ = np.arange(n), np.zeros(len(i), bool), np.arange(len(i))
    while len(open_ := open_[parent[i[open_]] != parent[j[open_]]]):
        best = np.full(n, len(i))
        np.minimum.at(best, parent[i[open_]], open_)
        np.minimum.at(best, parent[j[open_]], open_)
        chosen = np.unique(best[best < len(i)])
        taken[chosen] = True
        join_labels(parent, i[chosen], j[chosen])
    return order[taken]


def piece_edges(fps: np.ndarray, piece: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """i, j, distance, 0 or FOREST (rows) of the close pairs inside pieces (runs, sorted); of many pairs a least spanning forest, and whether there
    were so many. With labels all pairs that differ in them, and no forest."""
    out, crowded = [], False
    edges = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
    lo = 0
    while lo < len(piece):
        later = edges[edges >= lo + _SLICE]
        hi = int(later[0]) if len(later) else len(piece)
        own = piece[lo:hi] - piece[lo]
        i, j, d = close_pairs(fps[lo:hi], own)
        if label is not None:
            apart = label[lo + i] != label[lo + j]
            out.append(np.stack([i + lo, j + lo, d, np.zeros(len(i), np.int64)])[:, apart])
            lo = hi
            continue
        many = np.bincount(own[i], minlength=own[-1] + 1) > PAIRS * np.bincount(own)
        dense = many[own[i]]
        crowded |= bool(many.any())
        least = np.flatnonzero(dense)
        least = least[forest(hi - lo, i[dense], j[dense], d[dense])]
        keep = np.concatenate((np.flatnonzero(~dense), least))
        out.append(np.stack([i[keep] + lo, j[keep] + lo, d[keep], np.where(dense[keep], FOREST, 0)]))
        lo = hi
    return np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64), crowded


def orders(size: int) -> int:
    """In how many orders a bucket of size members is cut into pieces, so that a pair at RADIUS shares one with probability REACH: a piece is
    named by as many leading bits as halve the bucket down to PIECE, and each agrees with probability 1 - RADIUS / 128."""
    bits = math.ceil(math.log2(max(1.0, size / PIECE)))
    return 1 if not bits else math.ceil(math.log(1 - REACH) / math.log(1 - (1 - RADIUS / 128) ** (bits + 1)))


def piece_orders(fps: np.ndarray) -> Iterator[np.ndarray]:
    """The orders in which a bucket is cut into pieces, the same ones for the same bucket."""
    bits, rng = np.unpackbits(fps.astype("<u8").view(np.uint8), axis=1, bitorder="little"), np.random.default_rng(11)
    for _ in range(orders(len(fps))):
        yield np.lexsort(bits[:, rng.permutation(128)[:24]].T[::-1])


def bucket_edges(fps: np.ndarray, run: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Candidates of buckets (runs, sorted): i, j, distance, and 1 if j is the bucket's medoid, FOREST if the pair is of a forest. With labels all
    pairs that differ in them."""
    of = lambda at: None if label is None else label[at]
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    sizes = np.diff(np.append(starts, len(run)))
    usual = np.flatnonzero(np.repeat(sizes <= PIECE, sizes))
    found, _ = piece_edges(fps[usual], run[usual], of(usual))
    out = [np.stack([usual[found[0]], usual[found[1]], found[2], found[3]])]
    for a, size in zip(starts[sizes > PIECE].tolist(), sizes[sizes > PIECE].tolist(), strict=True):
        met, crowded = [], False
        for order in piece_orders(fps[a : a + size]):
            (i, j, d, _zero), many = piece_edges(fps[a + order], np.arange(size) // PIECE, of(a + order))
            crowded |= many
            i, j = order[i], order[j]
            met.append(np.stack([np.minimum(i, j), np.maximum(i, j), d]))
        i, j, d = np.unique(np.concatenate(met, axis=1), axis=1)
        if crowded:
            i, j, d = (x[forest(size, i, j, d)] for x in (i, j, d))
        out.append(np.stack([i + a, j + a, d, np.full(len(i), FOREST if crowded else 0)]))
    if label is not None:
        return tuple(np.concatenate(out, axis=1))
    for a, size in zip(starts[sizes > PIECE // 2].tolist(), sizes[sizes > PIECE // 2].tolist(), strict=True):
        counts = sum(np.unpackbits(fps[k : min(k + (1 << 14), a + size)].astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64) for k in range(a, a + size, 1 << 14))
        centre = np.packbits(counts * 2 > size, bitorder="little").view("<u8")
        medoid = a + int(np.bitwise_count(fps[a : a + size] ^ centre).sum(axis=1, dtype=np.int64).argmin())
        i = np.setdiff1d(np.arange(a, a + size), [medoid])
        d = distance(fps, i, medoid)
        i, d = i[d <= RADIUS], d[d <= RADIUS]
        out.append(np.stack([i, np.full(len(i), medoid), d, np.ones(len(i), np.int64)]))
    return tuple(np.concatenate(out, axis=1))


def piece_members(fps: np.ndarray, run: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of buckets (runs, sorted) that are close to one of another label in a piece, and the number of the piece in its bucket; the pieces are those of
    bucket_edges()."""
    starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    sizes = np.diff(np.append(starts, len(run)))

    def met(at: np.ndarray, piece: np.ndarray) -> np.ndarray:
        (i, j, _d, _zero), _ = piece_edges(fps[at], piece, label[at])
        return np.unique(np.concatenate((i, j)))

    usual = np.flatnonzero(np.repeat(sizes <= PIECE, sizes))
    on = usual[met(usual, run[usual])]
    out = [np.stack([on, np.zeros(len(on), np.int64)])]
    for a, size in zip(starts[sizes > PIECE].tolist(), sizes[sizes > PIECE].tolist(), strict=True):
        for k, order in enumerate(piece_orders(fps[a : a + size])):
            on = met(a + order, np.arange(size) // PIECE)
            out.append(np.stack([a + order[on], k * (size // PIECE + 1) + on // PIECE]))
    return tuple(np.concatenate(out, axis=1))


def keyed_buckets(nodes: DataFrame, n: int) -> DataFrame:
    """nodes with the key of their bucket in each table for n texts, buckets together."""
    keys = [F.xxhash64(F.lit(c), F.col("f0").bitwiseAND(F.lit(m).cast("long")), F.col("f1").bitwiseAND(F.lit(k).cast("long"))) for c, (m, k) in enumerate(tables(n))]
    keyed = nodes.select(F.explode(F.array(*keys)).alias("key"), "node", "f0", "f1", *[c for c in nodes.columns if c == "label"])
    return keyed.repartition("key").sortWithinPartitions("key", "f0")


def whole_buckets(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows of buckets that have come whole, and the number of each row's bucket."""
    rest = None
    for last, part in lookahead(batches):
        part = pd.concat([rest, part]) if rest is not None else part
        key = part["key"].to_numpy()
        done = len(key) if last else int(np.searchsorted(key, key[-1])) if len(key) else 0
        rest = part.iloc[done:]
        if done:
            yield part.iloc[:done], np.cumsum(np.concatenate(([0], key[1:done] != key[: done - 1])))


def bucket_pairs(nodes: DataFrame, n: int) -> DataFrame:
    """a < b (nodes), d, lead of the pairs of all tables for n texts, repeated ones included. nodes: node, f0, f1 and, if only pairs that differ
    in it are wanted, label."""
    labels = "label" in nodes.columns

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, run in whole_buckets(batches):
            node, fps = part["node"].to_numpy(), part[["f0", "f1"]].to_numpy().view(np.uint64)
            i, j, d, lead = bucket_edges(np.ascontiguousarray(fps), run, part["label"].to_numpy() if labels else None)
            yield pd.DataFrame({"a": np.minimum(node[i], node[j]), "b": np.maximum(node[i], node[j]), "d": d, "lead": lead})

    return keyed_buckets(nodes, n).mapInPandas(compare, "a long, b long, d long, lead long")


def candidates(nodes: DataFrame, n: int) -> DataFrame:
    """a < b (nodes), d, lead (1: to a medoid), forest for the n rows of nodes (node, f0, f1). forest: in some bucket the pair stands for others."""
    found = bucket_pairs(nodes, n)
    return found.groupBy("a", "b").agg(F.min("d").alias("d"), F.max(F.col("lead") % FOREST).alias("lead"), F.max(F.col("lead") == FOREST).alias("forest"))


def open_nodes(nodes: DataFrame, edges: DataFrame, root: DataFrame) -> DataFrame | None:
    """node, f0, f1, label (class) of the nodes whose pairs forests may have left out between two classes (root: node, root) of verified pairs, or None
    if there is no such class. Whatever a forest left out lies between two nodes of its edges, so only those come again, and of them only groups of
    several classes."""
    ends = edges.where("forest").select("a", "b")
    ends = ends.withColumn("node", F.explode(F.array("a", "b"))).select("node").distinct()
    labelled = ends.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("label"))
    both = edges.where("forest").join(labelled.toDF("a", "la"), "a").join(labelled.toDF("b", "lb"), "b").where("la <> lb")
    # classes that forests' edges do not tie together hold nothing back from each other: those that differ across an edge do
    open_ = cut(both.select(F.explode(F.array("la", "lb")).alias("label")).distinct(), "near-open")
    if not open_.head(1):
        return None
    return nodes.join(labelled.join(open_, "label"), "node").select("node", "f0", "f1", "label")


def left_out(nodes: DataFrame, edges: DataFrame, root: DataFrame, n: int) -> DataFrame | None:
    """a < b: the pairs themselves that forests left out between two classes, as many as a group's size squared; None if there is no such class. For
    small tables: roots() has them verified where they are met."""
    again = open_nodes(nodes, edges, root)
    return None if again is None else bucket_pairs(again, n).select("a", "b").distinct().join(edges.select("a", "b"), ["a", "b"], "left_anti")


def members_apart(again: DataFrame, n: int) -> DataFrame:
    """key, piece, node, f0, f1, label: the pieces in which buckets are compared, of each the members that are close to one of another label. No pair leaves
    a task: a member comes once a table at most, in a bucket over PIECE members once an order."""

    def apart(rows: pd.DataFrame, run: np.ndarray) -> pd.DataFrame:
        fps = np.ascontiguousarray(rows[["f0", "f1"]].to_numpy().view(np.uint64))
        at, piece = piece_members(fps, run, rows["label"].to_numpy())
        return rows.iloc[at].assign(piece=piece)[["key", "piece", "node", "f0", "f1", "label"]]

    return keyed_buckets(again, n).mapInPandas(lambda batches: (apart(*x) for x in whole_buckets(batches)), "key long, piece long, node long, f0 long, f1 long, label long")


def verified_pieces(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) of similarity 0.8 or more that join labels: all close pairs of a piece that differ in label, nearest first, are verified until their labels
    are joined. members: as members_apart() gives them; texts: node, text. A task holds the hashes of one piece, PIECE texts at most."""

    def solve(node: list[int], f0: list[int], f1: list[int], label: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        of, size = np.unique(label, return_inverse=True)[1], np.array([len(x) for x in sets])
        parent, found = np.arange(of.max() + 1), []
        i, j, d = close_pairs(np.stack([f0, f1], axis=1).astype(np.int64).view(np.uint64), np.zeros(len(node), np.int64))
        open_ = np.flatnonzero((of[i] != of[j]) & (9 * np.minimum(size[i], size[j]) >= 4 * (size[i] + size[j])))
        open_ = open_[np.argsort(d[open_], kind="stable")]
        while len(open_ := open_[parent[of[i[open_]]] != parent[of[j[open_]]]]):
            for k, at in enumerate(open_.tolist()):  # up to the first that joins two labels
                x, y = int(i[at]), int(j[at])
                if 9 * len(np.intersect1d(sets[x], sets[y], assume_unique=True)) >= 4 * (size[x] + size[y]):
                    found.append((min(node[x], node[y]), max(node[x], node[y])))
                    join_labels(parent, of[[x]], of[[y]])
                    break
            open_ = open_[k + 1 :]
        return found

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = None, [[] for _ in range(5)]
        as_batch = lambda pairs: pa.RecordBatch.from_arrays([pa.array([e[k] for e in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])
        for b in batches:
            found = []
            for key, number, *row, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, number) != piece:
                    found += solve(*held) if held[0] else []
                    piece, held = (key, number), [[] for _ in range(5)]
                for to, x in zip(held, (*row, shingles(text)), strict=True):
                    to.append(x)
            yield as_batch(found)
        if held[0]:
            yield as_batch(solve(*held))

    rows = members.join(texts.select("node", F.col("text").cast("binary").alias("text")), "node").select("key", "piece", "node", "f0", "f1", "label", "text")
    return rows.repartition("key", "piece").sortWithinPartitions("key", "piece").mapInArrow(judge, "a long, b long").distinct()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, node (the text's hash), f0, f1, size (bytes of text) of every row."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(shingles(x)) for x in b.column(2).to_pylist()], np.uint64).reshape(-1, 2).view(np.int64)
            size = pc.fill_null(pc.binary_length(b.column(2)).cast(pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(fps[:, k])) for k in (0, 1)), size], ["doc_id", "node", "f0", "f1", "size"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("node"), F.col("text").cast("binary").alias("text")).mapInArrow(prints, "doc_id long, node long, f0 long, f1 long, size long")


def distinct_texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, text of the texts in nodes: a table bucketed by node, so that its joins move no text of its own. Texts pack better than sets of
    hashes, which are built from them where a pair is judged."""
    spark = docs.sparkSession
    name = f"near_texts_{uuid.uuid4().hex}"
    rows = maybe_in(docs.select(text_key(F.col("text")).alias("node"), "text"), "node", bloom(nodes, "node", "near-wanted"), "wanted").where("wanted").drop("wanted")
    rows = rows.join(nodes, "node", "left_semi").dropDuplicates(["node"])
    rows.write.format("parquet").option("compression", "zstd").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "node").sortBy("node").saveAsTable(name)
    return spark.table(name)


def verified(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """The edges (a, b) of similarity 0.8 or more: 9 x common >= 4 x (sum of both sizes)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, last, other = np.zeros(b.num_rows, bool), None, np.zeros(0, np.uint64)
            for i, (node, one, two) in enumerate(zip(*(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                if node != last:  # rows come in order of b
                    last, other = node, shingles(two)
                own = shingles(one)
                if 9 * min(len(own), len(other)) >= 4 * (len(own) + len(other)):
                    kept[i] = 9 * len(np.intersect1d(own, other, assume_unique=True)) >= 4 * (len(own) + len(other))
            yield pa.RecordBatch.from_arrays([b.column(k).filter(pa.array(kept)) for k in (0, 1)], ["a", "b"])

    of = lambda x: texts.select(F.col("node").alias(x), F.col("text").cast("binary").alias(f"t_{x}"))
    return edges.select("a", "b").join(of("a"), "a").join(of("b"), "b").select("a", "b", "t_a", "t_b").mapInArrow(judge, "a long, b long")


def verified_groups(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Edges (a, b) of similarity 0.8 or more that span each group (root), nearest candidates first. edges: root, a, b, d; texts: root, node, text. A
    group's texts meet in one task, so that each moves once, whatever the number of its candidates."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, text, sets, parent = None, {}, {}, {}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        def set_of(x: int) -> np.ndarray:
            if x not in sets:
                sets[x] = shingles(text[x])
            return sets[x]

        for batch in batches:
            kept = []
            for root, a, b, x in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if root != group:
                    group, text, sets, parent = root, {}, {}, {}
                if b is None:
                    text[a], parent[a] = x, a
                elif find(a) != find(b):
                    p, q = set_of(a), set_of(b)
                    if 9 * min(len(p), len(q)) >= 4 * (len(p) + len(q)) and 9 * len(np.intersect1d(p, q, assume_unique=True)) >= 4 * (len(p) + len(q)):
                        parent[find(a)] = find(b)
                        kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in kept], pa.int64()) for k in (0, 1)], ["a", "b"])

    none = lambda kind: F.lit(None).cast(kind)
    rows = texts.select("root", F.col("node").alias("a"), none("long").alias("b"), F.col("text").cast("binary").alias("text"), F.lit(-1).cast("long").alias("d"))
    rows = rows.unionByName(edges.select("root", "a", "b", none("binary").alias("text"), "d"))
    return rows.repartition("root").sortWithinPartitions("root", "d").select("root", "a", "b", "text").mapInArrow(judge, "a long, b long")


def roots(docs: DataFrame, own: DataFrame) -> DataFrame:
    """node, root of the texts that are near another one. Groups of candidates of up to GROUP_BYTES of text are verified together, larger
    ones pair by pair."""
    nodes = cut(own.groupBy("node").agg(F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first("size").alias("size"), F.min("doc_id").alias("id")), "near-nodes")
    n = nodes.count()
    edges = cut(candidates(nodes.select("node", "f0", "f1"), n), "near-candidates")
    group = cut(components(edges.select("a", "b")).toDF("node", "root").join(nodes.select("node", "size", "id"), "node"), "near-groups")
    small = group.groupBy("root").agg(F.sum("size").alias("bytes")).select("root", (F.col("bytes") <= GROUP_BYTES).alias("small"))
    group = cut(group.join(small, "root"), "near-sized")
    own_edges = edges.join(group.select(F.col("node").alias("a"), "root", "small"), "a")
    # a text is found by its first row's id and its hash, a key that copies do not share
    first = group.where("small").select(F.xxhash64("id", "node").alias("at"), F.col("id").alias("_id"), F.col("node").alias("_node"), "root")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("node"), "text").withColumn("at", F.xxhash64("id", "node"))
    near = maybe_in(rows, "at", bloom(first.select("at"), "at", "near-firsts"), "near").where("near")  # other texts stay where they are
    texts = near.join(first, "at").where("id <=> _id and node = _node").select("root", "node", "text")
    sure = verified_groups(own_edges.where("small").select("root", "a", "b", "d"), texts)
    sure = cut(sure.unionByName(verified_pairs(docs, own_edges.where("not small").select("a", "b", "d", "lead"))), "near-sure")
    root = components(sure)
    again = open_nodes(nodes, edges, root)
    if again is None:
        return root
    more = cut(members_apart(again, n), "near-left-out")
    return components(sure.unionByName(verified_pieces(more, distinct_texts(docs, more.select("node").distinct()))))


def verified_pairs(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of similarity 0.8 or more that keep together what the candidates (a, b, d, lead) may: each text's nearest and its medoid first, then those
    that would join two classes."""
    edges = cut(edges, "near-large")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "d", "lead"))
    texts = distinct_texts(docs, both.select(F.col("a").alias("node")).distinct())
    pick = F.struct("d", F.col("b").alias("v"))
    nearest = both.groupBy("a").agg(F.min(pick).alias("x"), F.min(F.when(F.col("lead") == 1, pick)).alias("y"))
    first = nearest.select(F.col("a").alias("u"), F.explode(F.array("x.v", "y.v")).alias("v")).where("v is not null").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    sure = cut(verified(first, texts), "near-first")
    root = components(sure)
    left = edges.select("a", "b").join(root.toDF("a", "ra"), "a", "left").join(root.toDF("b", "rb"), "b", "left").where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")
    return sure.unionByName(verified(left, texts))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class: the least doc_id (null ids last), then the least text hash; one of repeated rows."""
    own = cut(scan(docs), "near-prints")
    root = roots(docs, own)
    least = own.select("doc_id", "node").join(root, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("m"))
    key = lambda i, k: F.xxhash64(i, k).alias("at")
    first = least.select(key("m.doc_id", "m.node"), F.col("m.doc_id").alias("id"), F.col("m.node").alias("of"), F.lit(True).alias("stays"))
    keys = own.groupBy(key("doc_id", "node"), "doc_id", "node").agg(F.count("*").alias("n")).withColumnRenamed("at", "own_at")
    judged = keys.join(first, F.expr("own_at = at and doc_id <=> id and node = of"), "left").select(F.col("own_at").alias("at"), "doc_id", "node", F.coalesce("stays", F.lit(False)).alias("stays"), (F.col("n") > 1).alias("again"))
    judged = cut(judged, "near-judged")
    # a cascade of filters tells nearly all rows apart where they are: what the first one does not know stays, what the second one does not
    # know of the others goes; rows that both know are moved and judged by the table
    doubt = bloom(judged.where("again or not stays").select("at"), "at", "near-doubt")
    few = cut(maybe_in(judged.where("stays"), "at", doubt, "doubt").where("doubt").select("at", "doc_id", "node"), "near-few")
    saved = bloom(few.select("at"), "at", "near-saved")
    rows = whole(docs, F.col("doc_id").cast("long").alias("own_id"), text_key(F.col("text")).alias("own_node")).withColumn("own_at", F.xxhash64("own_id", "own_node"))
    rows = maybe_in(rows, "own_at", doubt, "doubt")
    met = maybe_in(rows.where("doubt"), "own_at", saved, "saved").where("saved").join(few, F.expr("own_at = at and own_id <=> doc_id and own_node = node"), "left_semi")
    return rows.where("not doubt").select("row.*").union(met.dropDuplicates(["own_at", "own_id", "own_node"]).select("row.*"))
