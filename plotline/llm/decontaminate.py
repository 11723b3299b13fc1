"""Benchmark passages in texts, found by one automaton over normalised word windows."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField

from plotline.llm.arrow import append
from plotline.session import settle

#: Every ASCII byte that is neither a digit nor a letter separates words; A-Z become small.
NORMAL = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Benchmark bytes in one automaton; a larger benchmark is scanned in several blocks.
BLOCK_BYTES = 32 << 20


def windows(text: str | None, size: int) -> list[str]:
    """The word windows of an item, each between two blanks."""
    # Bytes: str.split would cut at blanks beyond ASCII too, which are parts of words.
    words = [word.decode() for word in (text or "").encode().translate(NORMAL).split()]
    count = max(1, len(words) - size + 1) if words else 0
    return [f" {' '.join(words[i : i + size])} " for i in range(count)]


def _automaton(items: list[tuple[str, str | None]], size: int):
    import ahocorasick

    owners: dict[str, set[str]] = {}
    for name, text in items:
        for window in windows(text, size):
            owners.setdefault(window, set()).add(name)
    automaton = ahocorasick.Automaton()
    for window, names in owners.items():
        automaton.add_word(window, (len(window), names))
    if owners:
        automaton.make_automaton()
    return automaton


def _hits(automaton, raw: bytes, before: list[int], names: set[str]) -> tuple[int, list[int], list[int]]:
    """Word count, merged word intervals (flat), and those in code points of the original."""
    normal = raw.translate(NORMAL)
    line = f" {b' '.join(normal.split()).decode()} "
    words = line.count(" ") - 1 if len(line) > 2 else 0
    found = [(before[i], before[i + 1]) for i in range(0, len(before), 2)]
    blanks = None
    if words and len(automaton):
        for end, (length, owners) in automaton.iter(line):
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 32)
            found.append((int(np.searchsorted(blanks, end - length + 1)), int(np.searchsorted(blanks, end))))
            names |= owners
    merged: list[int] = []
    for begin, end in sorted(found):
        if merged and begin <= merged[-1]:
            merged[-1] = max(merged[-1], end)
        else:
            merged += [begin, end]
    if not merged:
        return words, [], []
    data = np.frombuffer(normal, np.uint8)
    inside = np.r_[0, (data != 32).astype(np.int8), 0]
    edges = np.diff(inside)
    points = np.r_[0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)]
    starts, stops = points[np.flatnonzero(edges == 1)], points[np.flatnonzero(edges == -1)]
    return words, merged, [int(x) for b, e in zip(merged[::2], merged[1::2], strict=True) for x in (starts[b], stops[e - 1])]


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the words of each whole text that lie in a benchmark window.

    A window is ``size`` consecutive words of an item, or the whole of a shorter
    item.  Adds n_words, n_hit, n_items, items_sha256, contaminated, hit_items,
    hit_words (merged word intervals, flat: begin, end, begin, ...) and
    hit_spans (the same in code points of the original text).  Null and empty
    texts have no words; items without words match nothing; items that share an
    id count once; an item without id counts as the id "".  Columns of these
    names are replaced.  The text is scanned once for every ``block_bytes`` of
    benchmark, which bounds driver and task memory.
    """
    bench = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(item_text).alias("text"))
    total = bench.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    fields = [
        StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("n_items", LongType()), StructField("items_sha256", StringType()),
        StructField("contaminated", BooleanType()), StructField("hit_items", ArrayType(StringType())), StructField("hit_words", ArrayType(LongType())), StructField("hit_spans", ArrayType(LongType())),
    ]
    made = {f.name for f in fields}
    docs = docs.drop(*made)
    columns = docs.columns
    for block in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block)
        rows = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])
        # What earlier blocks found travels along under names that no column has.
        carried = {}
        for name in ("hit_words", "hit_items") if block else ():
            fresh = name + "_"
            while fresh in columns:
                fresh += "_"
            carried[name] = fresh
        source = docs.withColumnsRenamed(carried).drop(*made) if block else docs
        order = source.columns

        def make(rows=rows, carried=carried, order=order):
            automaton = _automaton(rows.value, size)

            def work(batch: pa.RecordBatch) -> list:
                texts = batch.column(order.index(text)).to_pylist()
                before = [batch.column(order.index(carried[n])).to_pylist() for n in ("hit_words", "hit_items")] if carried else [[[]] * len(texts)] * 2
                out = []
                for value, intervals, names in zip(texts, *before, strict=True):
                    names = set(names)
                    words, merged, spans = _hits(automaton, (value or "").encode(), intervals, names)
                    ids = sorted(names)
                    hit = sum(merged[1::2]) - sum(merged[::2])
                    out.append((words, hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0, ids, merged, spans))
                return [list(column) for column in zip(*out, strict=True)]

            return work

        docs = append(source, text, fields, make).drop(*carried.values())
        if block + 1 < blocks:
            docs = settle(docs)
    return docs
