"""Text quality as perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField

from plotline.llm.arrow import append, released, slices, text_bytes
from plotline.llm.language_score import grams
from plotline.session import settle

#: Bytes of context; symbols that can follow (all bytes but the one before a text, and the end).
ORDER, SYMBOLS = 4, 255
#: The share of trusted texts below a language's threshold, the trusted texts for which all
#: languages' threshold counts in that of one, and the symbols of average text that every text is mixed with.
SHARE, SHRINKAGE, PRIOR = 0.995, 5, 64
#: The words of a passage, and the symbols of average text that each passage is mixed with.
WINDOW, PASSAGE_PRIOR = 1, 2
#: Bytes of text scored at once: each takes some 80 bytes of arrays.
SCORED_BYTES = 1 << 20
#: Bits of the fixed-size map by which most texts that the model is not fitted on are passed over.
MAP_BITS = 1 << 26
#: Bytes of model that one pass over the texts carries, and of each longest context in it.
SHARD_BYTES, KEY_BYTES = 96 << 20, 50


class KneserNey:
    """The model, from packed contexts and symbols of the longest length and their counts.

    Shorter contexts count in how many longer ones a symbol follows them; the
    bytes before a text's start are symbols like others.  A shard holds all
    contexts with the same last two bytes; it scores them as the whole model
    would, given ``often``, how many symbols each level from the second on counts
    once to four times in the whole, and ``short``, its level of one byte.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int = ORDER, often: dict[int, list[int]] | None = None, short: tuple[np.ndarray, np.ndarray] | None = None):
        order_by = np.argsort(keys)
        at, count = keys[order_by], n[order_by]
        self.levels = []
        for k in range(order, -1, -1):
            if k == 1 and short is not None:
                ranked = np.argsort(short[0])
                at, count = short[0][ranked], short[1][ranked]
            self.levels.insert(0, self._level(at, count, (often or {}).get(k)))
            at, count = np.unique(at & ((1 << 8 * k) - 1), return_counts=True)
        # Mean loss over the symbols fitted on; even odds without any.
        self.symbols, self.loss = int(n.sum()), float(-(n * self.scores(keys)).sum())
        self.mean = self.loss / self.symbols if len(n) else float(np.log(SYMBOLS))

    @staticmethod
    def _level(at: np.ndarray, count: np.ndarray, often: list[int] | None = None):
        if not len(at):
            return (at, np.zeros(0), at, np.zeros(0))
        often = often or [np.count_nonzero(count == c) for c in (1, 2, 3, 4)]
        share = often[0] / (often[0] + 2 * often[1]) if often[0] else 0.5
        cut = np.zeros(4)
        for c in (1, 2, 3):
            # Tables too small for the estimate discount by a half, and never by more than the count.
            exact = c - (c + 1) * share * often[c] / often[c - 1] if often[c - 1] else 0.5
            cut[c] = min(max(exact, 0.1), c - 0.1)
        off = cut[np.minimum(count, 3)]
        context, first = np.unique(at >> 8, return_index=True)
        total = np.add.reduceat(count, first)
        back = np.add.reduceat(off, first) / total
        return at, (count - off) / np.repeat(total, np.diff(np.r_[first, len(at)])), context, back

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """Natural log probability of each packed symbol in its context."""
        p = np.full(len(codes), 1 / SYMBOLS)
        for k, (at, share, context, back) in enumerate(self.levels):
            if not len(at):
                continue
            code = codes & ((1 << 8 * (k + 1)) - 1)
            place = np.minimum(np.searchsorted(context, code >> 8), len(context) - 1)
            slot = np.minimum(np.searchsorted(at, code), len(at) - 1)
            mixed = np.where(at[slot] == code, share[slot], 0) + back[place] * p
            p = np.where(context[place] == code >> 8, mixed, p)
        return np.log(p)


def _even(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("fit")), F.lit(2)) == 0


class Shards:
    """A model in parts, each broadcast by itself, so that no task holds more than one of them."""

    def __init__(self, parts: list[Broadcast], mean: float, order: int):
        self.parts, self.mean, self.order = parts, mean, order

    def destroy(self) -> None:
        for part in self.parts:
            part.destroy()


def _shard(codes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each packed symbol, by the last two bytes of its context."""
    return (codes >> 8 & 0xFFFF) % shards


def _marked(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key the map of the ``chosen`` keys has: all of these, and few others.

    The map is at most MAP_BITS / 32768 rows of 4 KiB, whatever the input.
    """
    spot = F.pmod(F.xxhash64("key"), F.lit(MAP_BITS)) + 1
    bits = chosen.select(spot.alias("spot")).groupBy(F.bitmap_bucket_number("spot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("bits"))
    place = F.bitmap_bit_position("spot")
    octet = F.conv(F.hex(F.substring("bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = docs.withColumn("spot", spot).withColumn("bucket", F.bitmap_bucket_number("spot")).join(F.broadcast(bits), "bucket")
    return found.where(F.call_function("getbit", octet, (place % 8).cast("int")) == 1).select(*docs.columns)


def fitted_texts(docs: DataFrame, trusted: DataFrame, key: str, text: str) -> DataFrame:
    """The texts of all trusted documents of one half (by their key), as many times as they occur.

    Joined by shuffles at every size, so that small and large tables have one
    plan; only texts that the map of keys has move.  The keys are different, so
    the join is an inner one, which Spark does not move before the map.
    """
    chosen = trusted.select(F.col(key).alias("key")).where(_even(F.col("key"))).distinct()
    body = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(_even(F.col("key")))
    return _marked(body, chosen).join(chosen.hint("merge"), "key").select("text")


def _columns(frame: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = frame.select("key", "n").toArrow()
    return table.column(0).to_numpy().astype(np.int64), table.column(1).to_numpy().astype(np.int64)


def fit(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, shard_bytes: int = SHARD_BYTES) -> KneserNey | Shards:
    """Fit on all trusted documents of one half (by their key).

    A model of more than about ``shard_bytes`` is cut into shards, which pass through the driver one by one.
    """
    body = fitted_texts(docs, trusted, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            code, keys = pd.factorize(grams(*text_bytes(part.column(0)), order)[0])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(code))], names=["key", "n"])

    counts = settle(body.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    shards = math.ceil(counts.count() * KEY_BYTES / shard_bytes) if order > 1 else 1
    if shards <= 1:
        return KneserNey(*_columns(counts), order)
    # How often each level counts a symbol once to four times, and the level of one byte: at most 65,536 rows.
    often, level = {}, counts
    for k in range(order, 0, -1):
        if k < order:
            level = level.groupBy(F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("key")).agg(F.count("*").alias("n"))
        if k > 1:
            level = settle(level) if k < order else level
            found = {r["n"]: r["count"] for r in level.where("n <= 4").groupBy("n").count().collect()}
            often[k] = [found.get(c, 0) for c in (1, 2, 3, 4)]
    short = _columns(level)
    parts, loss, symbols = [], 0.0, 0
    for shard in range(shards):
        part = KneserNey(*_columns(counts.where(F.shiftright("key", 8).bitwiseAND(0xFFFF) % shards == shard)), order, often, short)
        loss, symbols = loss + part.loss, symbols + part.symbols
        parts.append(docs.sparkSession.sparkContext.broadcast(part))
    return Shards(parts, loss / symbols, order)


def _passages(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of all texts starts among their symbols, and the first word of each text; blanks belong to the word before."""
    texts = np.arange(len(bounds) - 1)
    blank = data <= 32
    seen = np.r_[0, np.cumsum(~blank)]
    at = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    owner = np.searchsorted(bounds, at, "right") - 1
    fresh = seen[at] > seen[bounds[owner]]
    starts = np.unique(np.r_[bounds[:-1] + texts, (at + owner)[fresh]])
    return starts, np.searchsorted(starts, bounds[:-1] + texts)


def worst_passages(loss: np.ndarray, data: np.ndarray, bounds: np.ndarray, mean: float, window: int = WINDOW, prior: float = PASSAGE_PRIOR) -> np.ndarray:
    """Largest mean loss over each text's windows of ``window`` words; blanks belong to the word before.

    ``loss`` holds the symbols of all texts in turn, an end after each.  Words
    end at bytes up to 32; a text of fewer words is one passage.
    """
    starts, first = _passages(data, bounds)
    return _worst(np.r_[0, np.cumsum(loss)], np.r_[starts, len(loss)], first, mean, window, prior)


def _worst(total: np.ndarray, at: np.ndarray, first: np.ndarray, mean: float, window: int = WINDOW, prior: float = PASSAGE_PRIOR) -> np.ndarray:
    """Largest mean of each text, from running losses over symbols, where words start (and the last ends), and each text's first word."""
    starts, stops = at[:-1], at[1:]
    # Words of each text; a window ends at its last word, or the text's last.
    last = np.r_[first[1:], len(starts)] - 1
    word = np.arange(len(starts))
    of = np.repeat(np.arange(len(first)), last - first + 1)
    whole = (word + window - 1 <= last[of]) | (word == first[of])
    end = stops[np.minimum(word + window - 1, last[of])]
    value = np.where(whole, (total[end] - total[starts] + mean * prior) / (end - starts + prior), -np.inf)
    return np.maximum.reduceat(value, first) if len(first) else np.zeros(0)


def losses(docs: DataFrame, model: KneserNey | Broadcast | Shards, text: str = "text", texts: bool = True) -> DataFrame:
    """``docs`` (without texts, if so asked) with symbols (bytes and one end), their total negative log probability, ``loss``, and the ``passage`` of largest mean loss."""
    if isinstance(model, Shards):
        return _losses_of_shards(docs, model, text, texts)
    shared = model if isinstance(model, Broadcast) else docs.sparkSession.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c not in ("symbols", "loss", "passage")]

    def make():
        known = shared.value
        order = len(known.levels) - 1

        def work(part: pa.RecordBatch) -> list:
            data, bounds = text_bytes(part.column(columns.index(text)))
            symbol, owner = grams(data, bounds, order)
            at, codes = pd.factorize(symbol)
            loss = -known.scores(codes)[at]
            return [pa.array(np.diff(bounds) + 1), pa.array(np.bincount(owner, loss, minlength=len(bounds) - 1)), pa.array(worst_passages(loss, data, bounds, known.mean))]

        return work

    scored = append(docs, text, [StructField("symbols", LongType()), StructField("loss", DoubleType()), StructField("passage", DoubleType())], make, SCORED_BYTES)
    return scored if texts else scored.drop(text)


def _losses_of_shards(docs: DataFrame, model: Shards, text: str, texts: bool) -> DataFrame:
    """The same by one pass over the texts for each shard: each gives what it knows of the loss of every word, and these are added.

    Rows are known by their number as read.
    """
    base = docs.drop("symbols", "loss", "passage").withColumn("_row", F.monotonically_increasing_id())
    body, shards, order, mean = base.select("_row", F.col(text).alias("_text")), len(model.parts), model.order, model.mean
    partial = None
    for shard, shared in enumerate(model.parts):

        def run(batches: Iterator[pa.RecordBatch], shard=shard, shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for part in slices(batches, 1, SCORED_BYTES):
                data, bounds = text_bytes(part.column(1))
                at, codes = pd.factorize(grams(data, bounds, order)[0])
                own = _shard(codes, shards) == shard
                loss = np.zeros(len(codes))
                loss[own] = -known.scores(codes[own])
                starts, first = _passages(data, bounds)
                sums = np.add.reduceat(loss[at], starts)
                sizes = np.diff(np.r_[starts, len(at)]) if shard == 0 else np.zeros(0, np.int64)
                cut = np.r_[first, len(starts)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(np.full(part.num_rows, shard, np.int32)), pa.ListArray.from_arrays(pa.array(cut), pa.array(sums)),
                    pa.ListArray.from_arrays(pa.array(cut if shard == 0 else np.zeros_like(cut)), pa.array(sizes)),
                ], names=["_row", "shard", "sums", "sizes"])

        made = body.mapInArrow(lambda batches, run=run: released(run(batches)), "_row long, shard int, sums array<double>, sizes array<long>")
        partial = made if partial is None else partial.union(made)
    # As many small arrays as shards for each text, in the order of the shards, so that sums do not depend on the run.
    words = partial.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("shard", "sums", "sizes"))).alias("w")).select(
        "_row", F.col("w")[0]["sizes"].alias("sizes"),
        F.aggregate(F.slice("w", 2, shards), F.col("w")[0]["sums"], lambda total, w: F.zip_with(total, w["sums"], lambda a, b: a + b)).alias("sums"),
    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes, sums, count = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy(), batch.column(1).value_lengths().to_numpy()
            first = np.r_[0, np.cumsum(count)[:-1]]
            at, total = np.r_[0, np.cumsum(sizes)], np.zeros(int(sizes.sum()) + 1)
            total[at] = np.r_[0, np.cumsum(sums)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.add.reduceat(sizes, first)), pa.array(np.add.reduceat(sums, first)), pa.array(_worst(total, at, first, mean))],
                names=["_row", "symbols", "loss", "passage"],
            )

    scored = words.mapInArrow(add, "_row long, symbols long, loss double, passage double")
    return (base if texts else base.drop(text)).join(scored, "_row").drop("_row")


def perplexity(mean: Column | float) -> Column:
    """Per symbol, mixed with ``PRIOR`` symbols of the mean loss, which steadies very short texts."""
    return F.exp((F.col("loss") + mean * PRIOR) / (F.col("symbols") + PRIOR))


def shrunk(limits: DataFrame, threshold: float, passage_threshold: float, weight: float = SHRINKAGE) -> DataFrame:
    """Each language's thresholds (lang, threshold, passage_threshold, n) drawn to those of all, as if ``weight`` texts more had these.

    Perplexities are averaged by their logarithms, as are the losses of passages, which are logarithms.
    """
    own = F.col("n") / (F.col("n") + weight)
    return limits.select(
        "lang", F.exp(own * F.ln("threshold") + (1 - own) * math.log(threshold)).alias("threshold"),
        (own * F.col("passage_threshold") + (1 - own) * passage_threshold).alias("passage_threshold"),
    )


class Judge:
    """Thresholds: one for each language with trusted texts, and one for the rest."""

    def __init__(self, mean: float, limits: DataFrame, other: tuple[float, float]):
        self.mean, self.limits, self.other = mean, limits, other

    def judged(self, scored: DataFrame, lang: str = "lang") -> DataFrame:
        """Adds perplexity, threshold, passage_threshold and keep to a frame with loss, symbols and passage."""
        scored = scored.drop("perplexity", "threshold", "passage_threshold", "keep")
        # One row for each language that has trusted texts.
        limits = F.broadcast(self.limits.select(F.col("lang").alias("_limit_lang"), "threshold", "passage_threshold"))
        joined = scored.join(limits, F.coalesce(F.col(lang), F.lit("")) == F.col("_limit_lang"), "left").drop("_limit_lang")
        for name, other in zip(("threshold", "passage_threshold"), self.other, strict=True):
            joined = joined.withColumn(name, F.coalesce(name, F.lit(other)))
        joined = joined.withColumn("perplexity", perplexity(F.lit(self.mean)))
        return joined.withColumn("keep", (F.col("perplexity") <= F.col("threshold")) & (F.col("passage") <= F.col("passage_threshold")))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", share: float = SHARE, texts: bool = True, shard_bytes: int = SHARD_BYTES) -> tuple[Judge, DataFrame]:
    """The judge, and ``docs`` (without texts, if so asked) with symbols, loss and passage, written down.

    Trusted are documents labelled quality 1 and toxic 0.  Half of them, all of
    that half, fit the model; the others, all of them, set each language's
    thresholds, of the text and of its worst passage, at their ``share`` quantile,
    drawn to that of all languages (``shrunk``).  Contradictory labels of a document
    make it not trusted.  Without trusted texts everything is kept.  The model
    leaves driver and executors once all documents have been scored.
    """
    trusted = labels.groupBy(F.col("doc_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t")).where("q = 1 and t = 0").select("doc_id")
    model = fit(docs, trusted.withColumnRenamed("doc_id", key), key, text, shard_bytes=shard_bytes)
    if isinstance(model, KneserNey):
        model = docs.sparkSession.sparkContext.broadcast(model)
    scored = settle(losses(docs, model, text, texts))
    model.destroy()
    pa.default_memory_pool().release_unused()
    narrow = scored.select(F.col(key).alias("key"), F.coalesce(lang, F.lit("")).alias("lang"), "symbols", "loss", "passage")
    held = narrow.join(trusted.select(F.col("doc_id").alias("key")).where(~_even(F.col("key"))), "key", "left_semi")
    mean = held.agg(F.sum("loss") / F.sum("symbols")).first()[0] or 0.0
    held = held.withColumn("value", perplexity(F.lit(mean)))
    quantiles = [F.percentile_approx("value", share, 10_000).alias("threshold"), F.percentile_approx("passage", share, 10_000).alias("passage_threshold")]
    other = tuple(float("inf") if limit is None else limit for limit in held.agg(*quantiles).first())
    limits = held.groupBy("lang").agg(*quantiles, F.count("*").alias("n"))
    return Judge(mean, settle(shrunk(limits, *other)), other), scored


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """key, lang, symbols, loss, passage, perplexity, threshold, passage_threshold, keep for every row of ``docs``.

    Null and empty texts are just an end; rows without language share the
    language ""; repeated rows are judged alike; other columns are ignored.
    """
    judge, scored = train(docs.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")), labels, "key", "text", "lang", texts=False)
    return judge.judged(scored)


def kept(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, with their columns, that are not rejected; texts are scored once and do not move."""
    names = {c: f"_kept_{i}" for i, c in enumerate(docs.columns)}
    judge, scored = train(docs.withColumnsRenamed(names), labels, names[key], names[text], names[lang])
    return judge.judged(scored, names[lang]).where("keep").select([F.col(new).alias(old) for old, new in names.items()])
