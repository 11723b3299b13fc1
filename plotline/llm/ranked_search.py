"""The best documents for each item of a query set, by search over two trees.

Documents become narrow vectors over the items' terms.  Within a task, runs of
documents form a tree (batch, chunk, leaf) whose nodes hold the greatest impact
of each term below them; the items form another (set, leaf), whose nodes hold
the greatest repeats.  The product of two nodes' maxima bounds every score
between them, so where it stays under the weakest kth score of the node's items
the whole pair of batches is passed over, and nothing is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotline.llm.arrow import slices, text_bytes
from plotline.llm.decontaminate import NORMAL
from plotline.llm.words import words
from plotline.session import settle

#: Bytes of items searched in one pass over the documents.
BLOCK_BYTES = 4 << 20
#: Items and matrix cells of an item set; items of a leaf of the item tree.
SET_ITEMS, SET_CELLS, ITEM_LEAF = 256, 2 << 20, 8
#: Documents and postings of a task's batch, documents of a chunk and of a leaf.
BATCH_DOCS, BATCH_POSTINGS, CHUNK, LEAF = 4096, 2 << 20, 256, 16
#: Parts in which the tasks' best are merged before all of an item's meet.
MERGES = 64
_NORMAL = np.frombuffer(NORMAL, np.uint8)
_NO_ID = np.iinfo(np.int64).max


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every term of the texts."""
    data, bounds = text_bytes(column)
    return words(_NORMAL[data], bounds)


def _vectors(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """id, n, terms, counts: each document's terms in all, and those of the vocabulary (packed)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            hashes, owner = terms(part.column(1))
            at = np.minimum(np.searchsorted(shared.value, hashes), len(shared.value) - 1)
            hit = shared.value[at] == hashes
            code, often = np.unique(owner[hit] * len(shared.value) + at[hit], return_counts=True)
            bounds = np.searchsorted(code, np.arange(part.num_rows + 1) * len(shared.value)) * 4
            code, often = (code % len(shared.value)).astype(np.int32).tobytes(), often.astype(np.int32).tobytes()
            packed = [pa.array([x[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for x in (code, often)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.bincount(owner, minlength=part.num_rows)), *packed], names=["id", "n", "terms", "counts"])

    return docs.mapInArrow(run, "id long, n long, terms binary, counts binary")


def _holders(vectors: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term; a task hands on one row for each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["term", "n"])

    # One row for each term of a block of items, which BLOCK_BYTES bounds.
    found = vectors.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return out


class ItemSet:
    """Items that are searched together, as a tree: the set, leaves of items, items."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray):
        self.numbers = np.array([number for number, _, _ in items])
        self.columns = np.unique(np.concatenate([at for _, at, _ in items]))
        self.weights = weights[self.columns]
        repeats = np.zeros((len(items), len(self.columns)), np.int64)
        for row, (_, at, often) in zip(repeats, items, strict=True):
            row[np.searchsorted(self.columns, at)] = often
        self.leaves = []
        for start in range(0, len(items), ITEM_LEAF):
            part = repeats[start : start + ITEM_LEAF]
            used = np.flatnonzero(part.any(axis=0))
            self.leaves.append((np.arange(start, start + len(part)), used, part[:, used].T.copy()))
        self.most = np.array([repeats[rows].max(axis=0) for rows, _, _ in self.leaves], float)


def item_sets(items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Items (number, terms, repeats) cut into sets, those with the same commonest terms (mostly one language's) side by side."""
    ordered = sorted(items, key=lambda item: tuple(sorted(item[1].tolist(), key=lambda t: (weights[t], t))[:3]))
    out: list[list] = []
    cells: set[int] = set()
    for item in ordered:
        if not out or len(out[-1]) == SET_ITEMS or (len(out[-1]) + 1) * len(cells | set(item[1].tolist())) > SET_CELLS and out[-1]:
            out.append([])
            cells = set()
        out[-1].append(item)
        cells |= set(item[1].tolist())
    return out


class Best:
    """The k best of each item so far: scores falling, equal ones by ascending document."""

    def __init__(self, items: int, k: int):
        self.scores, self.ids = np.zeros((items, k), np.int64), np.full((items, k), _NO_ID)

    def offer(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        likely = (scores > 0) & (scores >= self.scores[item, -1])
        if likely.any():
            scores, ids = np.r_[self.scores[item], scores[likely]], np.r_[self.ids[item], ids[likely]]
            keep = np.lexsort((ids, -scores))[:k]
            self.scores[item], self.ids[item] = scores[keep], ids[keep]


def search(batch: tuple[np.ndarray, ...], items: ItemSet, best: Best) -> int:
    """Offer a batch (ids, owner, term, impact; postings by owner) to the items of a set; returns how many scores it computed."""
    ids, owner, term, impact = batch
    at = np.minimum(np.searchsorted(items.columns, term), len(items.columns) - 1)
    hit = (items.columns[at] == term) & (impact > 0)
    owner, at, impact = owner[hit], at[hit], impact[hit]
    # Documents with the same commonest term, then the same strongest, come side by side.
    first, none = np.searchsorted(owner, np.arange(len(ids))), np.bincount(owner, minlength=len(ids)) == 0
    keys = []
    for rank in (-impact, items.weights[at]):
        head = at[np.lexsort((at, rank, owner))][np.minimum(first, len(owner) - 1)] if len(owner) else first
        keys.append(np.where(none, -1, head))
    place = np.empty(len(ids), np.int64)
    place[np.lexsort(keys)] = np.arange(len(ids))
    ids = ids[np.argsort(place)]
    order = np.argsort(place[owner], kind="stable")
    owner, at, impact = place[owner][order], at[order], impact[order]
    chunks = -(-len(ids) // CHUNK)
    cuts = np.searchsorted(owner, np.arange(chunks + 1) * CHUNK)
    most = np.zeros((chunks, len(items.columns)))
    np.maximum.at(most, (owner // CHUNK, at), impact)
    # Sums of doubles may come out a little low; whole numbers decide below.
    bounds = most @ items.most.T * (1 + 1e-9)
    members = [items.numbers[rows] for rows, _, _ in items.leaves]
    computed = 0
    for chunk in np.argsort(-bounds.max(axis=1)):
        weakest = np.array([best.scores[rows, -1].min() for rows in members])
        leaves = np.flatnonzero((bounds[chunk] >= weakest) & (bounds[chunk] > 0))
        if not len(leaves):
            continue
        part = slice(cuts[chunk], cuts[chunk + 1])
        begin = chunk * CHUNK
        size = min(CHUNK, len(ids) - begin)
        full = np.zeros((-(-size // LEAF) * LEAF, len(items.columns)), np.int64)
        full[owner[part] - begin, at[part]] = impact[part]
        fine = full.reshape(-1, LEAF, full.shape[1]).max(axis=1) @ items.most[leaves].T * (1 + 1e-9)
        for column, leaf in enumerate(leaves):
            near = np.flatnonzero((fine[:, column] >= weakest[leaf]) & (fine[:, column] > 0))
            if not len(near):
                continue
            docs = (near[:, None] * LEAF + np.arange(LEAF)).ravel()
            docs = docs[docs < size]
            _, used, repeats = items.leaves[leaf]
            scores = full[np.ix_(docs, used)] @ repeats
            computed += scores.size
            for item, row in zip(members[leaf], scores.T, strict=True):
                best.offer(item, row, ids[begin + docs])
    return computed


def _batches(rows: Iterator[pa.RecordBatch], weights: np.ndarray, documents: int, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """ids, owner, term and impact of a bounded number of documents at a time."""

    def made(held):
        ids, n, code, often = (np.concatenate([h[i] for h in held]) for i in range(4))
        sizes = np.concatenate([h[4] for h in held])
        owner = np.repeat(np.arange(len(ids)), sizes)
        scale = 100 - 25 + (25 * n * documents) // length
        often = often.astype(np.int64)
        impact = weights[code] * ((1_000_000_000 * often) // (1000 * often + 12 * scale[owner]))
        return ids, owner, code.astype(np.int64), impact

    held, docs, postings = [], 0, 0
    for batch in rows:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            packed = part.column(2).to_pylist()
            code = np.frombuffer(b"".join(packed), np.int32)
            held.append((part.column(0).fill_null(_NO_ID).to_numpy(), part.column(1).to_numpy(), code, np.frombuffer(b"".join(part.column(3).to_pylist()), np.int32), np.array([len(x) // 4 for x in packed])))
            docs, postings = docs + part.num_rows, postings + len(code)
            if docs >= BATCH_DOCS or postings >= BATCH_POSTINGS:
                yield made(held)
                held, docs, postings = [], 0, 0
    if held:
        yield made(held)


def _found(vectors: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """item, id, score, part: each task's best for each item."""
    shared = vectors.sparkSession.sparkContext.broadcast((item_sets(items, weights), weights))
    last = max(number for number, _, _ in items) + 1

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, w = shared.value
        best = Best(last, k)
        built = ItemSet(sets[0], w) if len(sets) == 1 else None
        for batch in _batches(rows, w, documents, length):
            for part in sets:
                search(batch, built or ItemSet(part, w), best)
        item, at = np.nonzero(best.scores)
        ids = best.ids[item, at]
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids, mask=ids == _NO_ID), pa.array(best.scores[item, at])], names=["item", "id", "score"])

    return vectors.mapInArrow(run, "item long, id long, score long").withColumn("part", F.spark_partition_id() % MERGES)


def _packed_items(rows: list[tuple[int, str | None]]) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """The vocabulary of some items, and each item's terms in it with their repeats."""
    hashes, owner = terms(pa.array([text for _, text in rows], pa.string()))
    vocabulary, at = np.unique(hashes, return_inverse=True)
    cuts = np.searchsorted(owner, np.arange(len(rows) + 1))
    return vocabulary, [(i, *np.unique(at[a:b], return_counts=True)) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item, item_id, rank, id, score: the ``k`` best documents of each row of ``items``.

    Only scores above 0 count; equal scores rank by ascending id (a whole number),
    documents without id last; repeated documents and items rank on their own.
    Null and empty texts have no terms; texts may be of any length.  Empty tables
    give no rows; other columns are ignored.  Documents are read once for every
    ``block_bytes`` of items, which bounds what tasks and driver hold.
    """
    body = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    asked = settle(items.select(F.monotonically_increasing_id().alias("item"), F.col(item_id).alias("item_id"), F.col(item_text).alias("text")))
    blocks = max(1, math.ceil((asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) / block_bytes))
    found = None
    for block in range(blocks):
        rows = [tuple(r) for r in asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).select("item", "text").orderBy("item").collect()]
        vocabulary, packed = _packed_items(rows)
        if not packed:
            continue
        vectors = settle(_vectors(body, vocabulary))
        documents, length = vectors.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if not documents:
            break
        holders = _holders(vectors, len(vocabulary))
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in holders.tolist()], np.int64)
        part = _found(vectors, packed, weights, documents, length, k)
        # Numbers within the block become the items' own.
        names = docs.sparkSession.createDataFrame([(i, number) for i, (number, _) in enumerate(rows)], "item long, number long")
        part = part.join(F.broadcast(names), "item").select(F.col("number").alias("item"), "id", "score", "part")
        found = part if found is None else found.union(part)
    if found is None:
        found = body.select(F.lit(0).cast("long").alias("item"), "id", F.lit(0).cast("long").alias("score"), F.lit(0).alias("part")).limit(0)
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    for keys in (["item", "part"], ["item"]):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return found.join(asked.select("item", "item_id"), "item").select("item", "item_id", "rank", "id", "score")
