"""Byte-context prediction by partial matching, and a word model, learnt from and applied to whole texts.

The contexts' counts are gathered over all training texts.  A text's score is
the sum over its bytes (and one end) of the log probability in the longest known
context, with escapes (method C) to shorter ones and exclusion of the symbols
that a longer context has already ruled out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.llm.arrow import slices, text_bytes
from plotline.llm.words import U, lowered, words
from plotline.session import settle

#: Bytes of context; symbols that UTF-8 text never holds: before the text, and after it.
ORDER, START, END = 5, 0xFF, 0xFE
SYMBOLS = 255
#: The word key of a text's end, and kinds of gathered counts.
END_WORD, WORD, GRAM = 0, 0, 1
#: Bytes of model that one pass over the texts carries; of each word and context in it; counts held by a task; text bytes scored at once.
SHARD_BYTES, WORD_BYTES, GRAM_BYTES, HELD_COUNTS, SCORED_BYTES = 96 << 20, 16, 50, 1 << 20, 3 << 20


def grams(data: np.ndarray, bounds: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each symbol of all texts with its context, packed (context above, symbol below), and its text."""
    texts = len(bounds) - 1
    pad = order + 1
    stream = np.full(len(data) + texts * pad + order, START, np.uint8)
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    stream[np.arange(len(data)) + owner * pad + order] = data
    stream[bounds[1:] + np.arange(texts) * pad + order] = END
    code = np.zeros(len(stream) - order, np.int64)
    for k in range(order + 1):
        code = (code << 8) | stream[k : len(stream) - order + k]
    symbol = stream[order:] != START
    return code[symbol], np.repeat(np.arange(texts), np.diff(bounds) + 1)


def _gathered(docs: DataFrame, order: int) -> DataFrame:
    """kind, key, n: word and context counts of all texts (docs: text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def folded(kind: int) -> tuple[np.ndarray, np.ndarray]:
            code, keys = pd.factorize(np.concatenate([k for k, _ in held[kind]]))
            return keys, np.bincount(code, np.concatenate([n for _, n in held[kind]])).astype(np.int64)

        def batch(kind: int) -> pa.RecordBatch:
            keys, n = folded(kind)
            held[kind] = []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], names=["kind", "key", "n"])

        for part in slices(batches, 0):
            data, bounds = text_bytes(part.column(0))
            data = lowered(data)
            word, _ = words(data, bounds)
            for kind, keys in ((WORD, np.r_[word.view(np.int64), np.full(len(bounds) - 1, END_WORD)]), (GRAM, grams(data, bounds, order)[0])):
                code, keys = pd.factorize(keys)
                held[kind].append((keys, np.bincount(code)))
                if sum(len(k) for k, _ in held[kind]) > HELD_COUNTS:
                    held[kind] = [folded(kind)]
                    if len(held[kind][0][0]) > HELD_COUNTS // 2:
                        yield batch(kind)
        for kind in (WORD, GRAM):
            if held[kind]:
                yield batch(kind)

    return docs.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Trie:
    """Counts of contexts of every length up to ``order``, ready for scoring.

    ``keys`` are packed contexts and symbols of the longest length; ``short``
    holds those of length one over the whole corpus, so that a part of the
    contexts (all that share their last two bytes) scores as the whole would.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, short: tuple[np.ndarray, np.ndarray], order: int = ORDER):
        self.order, self.levels = order, []
        lower = None
        for k in range(order + 1):
            if k == 0:
                at, count = _marginal(*short, 8)
            elif k == 1:
                at, count = _marginal(*short, 16)
            else:
                at, count = _marginal(keys, n, 8 * (k + 1))
            context, first = np.unique(at >> 8, return_index=True)
            total = np.add.reduceat(count, first) if len(at) else count
            different = np.diff(np.r_[first, len(at)])
            ruled = np.zeros(len(context), np.int64)
            if k and len(at):
                parent = lower[1][np.searchsorted(lower[0], at & ((1 << 8 * k) - 1))]
                ruled = np.add.reduceat(parent, first)
            self.levels.append((at, count, context, total, different, ruled))
            lower = at, count

    def size(self) -> int:
        return sum(x.nbytes for level in self.levels for x in level)

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each packed symbol in its context."""
        out, open_ = np.zeros(len(codes)), np.arange(len(codes))
        ruled, less = np.zeros(len(codes), np.int64), np.zeros(len(codes), np.int64)
        for k in range(self.order, -1, -1):
            at, count, context, total, different, gone = self.levels[k]
            if not len(at):
                continue
            code = codes[open_] & ((1 << 8 * (k + 1)) - 1)
            place = np.minimum(np.searchsorted(context, code >> 8), len(context) - 1)
            known = context[place] == code >> 8
            here, place, code = open_[known], place[known], code[known]
            n, d = total[place] - ruled[here], different[place] - less[here]
            slot = np.minimum(np.searchsorted(at, code), len(at) - 1)
            hit = at[slot] == code
            out[here[hit]] += np.log10(count[slot[hit]] / (n[hit] + d[hit]))
            miss = ~hit & (d > 0)
            out[here[miss]] += np.log10(d[miss] / (n[miss] + d[miss]))
            ruled[here], less[here] = gone[place], different[place]
            done = np.zeros(len(codes), bool)
            done[here[hit]] = True
            open_ = open_[~done[open_]]
        out[open_] -= np.log10(SYMBOLS - less[open_])
        return out


def _marginal(keys: np.ndarray, n: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys cut to their low bits, with summed counts."""
    cut, inverse = np.unique(keys & ((1 << bits) - 1), return_inverse=True)
    return cut, np.bincount(inverse, n, minlength=len(cut)).astype(np.int64)


def _columns(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = frame.select("key", "n").toArrow()
    return table.column(0).to_numpy().astype(np.int64), table.column(1).to_numpy().astype(np.int64)


def training(key: str = "doc_id") -> Column:
    """Whether a row trains: crc32 of its id as text, modulo 7, is not 2 (no id: the empty text)."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 7 != 2


def score(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """row, id, train, n_tokens, n_known, train_tokens, base_score, score for every row.

    ``base_score`` is the add-one word model's, ``score`` that of the bytes.
    Texts are lower-cased (A-Z); null counts as empty, which is just an end;
    rows count as often as they are there; without training rows every symbol
    is equally likely.  Words are told apart by 64-bit hashes.  ``row`` numbers
    the rows as read; other columns are ignored.

    The model is cut into shards of at most about ``shard_bytes``; each pass
    over the texts carries one and adds what it knows, so neither driver nor
    task ever holds more of it, however large the corpus.
    """
    body = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), train.alias("train"), F.col(text).alias("text"))
    counts = settle(_gathered(body.where("train").select("text"), order).withColumn(
        "part", F.when(F.col("kind") == WORD, F.col("key")).otherwise(F.shiftright("key", 8).bitwiseAND(0xFFFF))
    ))
    size = {r["kind"]: r for r in counts.groupBy("kind").agg(F.count("*").alias("keys"), F.sum("n").alias("n")).collect()}
    tokens, vocabulary = (size[WORD]["n"], size[WORD]["keys"]) if WORD in size else (0, 0)
    shards = max(1, math.ceil(vocabulary * WORD_BYTES / shard_bytes), math.ceil((size[GRAM]["keys"] if GRAM in size else 0) * GRAM_BYTES / shard_bytes))
    # At most 65,536 pairs of bytes.
    short = _columns(counts.where(F.col("kind") == GRAM).groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")))
    context = docs.sparkSession.sparkContext
    partial = None
    for shard in range(shards):
        mine = counts.where(F.pmod("part", F.lit(shards)) == shard)
        known, often = _columns(mine.where(F.col("kind") == WORD))
        ranked = np.argsort(known)
        trie = Trie(*_columns(mine.where(F.col("kind") == GRAM)), short, order)
        model = context.broadcast((known[ranked], np.log10(often[ranked] + 1.0).astype(np.float64), trie))

        def run(batches: Iterator[pa.RecordBatch], model=model, shard=shard) -> Iterator[pa.RecordBatch]:
            known, logs, trie = model.value
            for part in slices(batches, 3, SCORED_BYTES):
                data, bounds = text_bytes(part.column(3))
                data, texts = lowered(data), len(bounds) - 1
                word, owner = words(data, bounds)
                word, owner = np.r_[word.view(np.int64), np.full(texts, END_WORD)], np.r_[owner, np.arange(texts)]
                code, keys = pd.factorize(word)
                place = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
                found = known[place] == keys if len(known) else np.zeros(len(keys), bool)
                value = np.where(found, logs[place] if len(known) else 0.0, 0.0)
                symbol, text_of = grams(data, bounds, order)
                at, codes = pd.factorize(symbol)
                own = (codes >> 8 & 0xFFFF) % shards == shard
                logp = np.zeros(len(codes))
                logp[own] = trie.scores(codes[own])
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), part.column(2), pa.array(np.bincount(owner, minlength=texts)),
                    pa.array(np.bincount(owner, found[code], minlength=texts).astype(np.int64)),
                    pa.array(np.bincount(owner, value[code], minlength=texts)), pa.array(np.bincount(text_of, logp[at], minlength=texts)),
                ], names=["row", "id", "train", "n_tokens", "n_known", "words", "score"])

        kind = docs.schema[key].dataType.simpleString()
        made = body.mapInArrow(run, f"row long, id {kind}, train boolean, n_tokens long, n_known long, words double, score double")
        partial = made if partial is None else partial.union(made)
    if shards > 1:
        partial = partial.groupBy("row").agg(F.first("id").alias("id"), F.first("train").alias("train"), F.first("n_tokens").alias("n_tokens"), *[F.sum(c).alias(c) for c in ("n_known", "words", "score")])
    base = F.col("words") - F.col("n_tokens") * F.lit(math.log10(tokens + vocabulary + 1))
    return partial.select("row", "id", "train", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
