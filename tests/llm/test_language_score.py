"""Partial matching and the word model against brute force."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.llm import language_score, queries

FOLDER = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def trie(texts, order):
    seen = defaultdict(Counter)
    for t in texts:
        stream = bytes([0xFF] * order) + lower(t).encode() + bytes([0xFE])
        for i in range(order, len(stream)):
            for k in range(order + 1):
                seen[stream[i - k : i]][stream[i]] += 1
    return seen


def log_p(seen, context, symbol):
    gone, total = set(), 0.0
    for k in range(len(context), -1, -1):
        here = {s: n for s, n in seen.get(context[len(context) - k :], {}).items() if s not in gone}
        if not here:
            continue
        n, d = sum(here.values()), len(here)
        if symbol in here:
            return total + math.log10(here[symbol] / (n + d))
        total += math.log10(d / (n + d))
        gone |= set(here)
    return total - math.log10(255 - len(gone))


def brute(seen, text, order):
    stream = bytes([0xFF] * order) + lower(text).encode() + bytes([0xFE])
    return sum(log_p(seen, stream[i - order : i], stream[i]) for i in range(order, len(stream)))


ROWS = [(i, t) for i, t in enumerate(["abra cadabra Abra", "the then there these", "abra the cad", "é è the", "", None, "THE\tabra  zq\n", "unseen ☃ words", "a", "the then there these"])]


@pytest.mark.parametrize(("shard_bytes", "order"), [(64 << 20, 4), (900, 4), (64 << 20, 2)])
def test_scores_against_brute_force(spark, shard_bytes, order):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("row", F.lit("clash"))
    got = language_score.score(frame, F.col("doc_id") % 3 != 1, order=order, shard_bytes=shard_bytes).collect()
    train = [t for d, t in ROWS if d % 3 != 1]
    seen = trie(train, order)
    counts = Counter(w for t in train for w in lower(t).split()) + Counter({None: len(train)})
    total, different = sum(counts.values()), len(counts)
    assert len(got) == len(ROWS)
    for r in got:
        text = dict(ROWS)[r.id]
        tokens = [*lower(text).split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(t in counts for t in tokens), total)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 1) / (total + different + 1)) for t in tokens))
        assert r.score == pytest.approx(brute(seen, text, order))


def test_probabilities_of_a_context_add_up():
    seen = trie(["abra cadabra", "the then"], 2)
    assert sum(10 ** log_p(seen, b"br", s) for s in range(255)) == pytest.approx(1)
    keys, n = zip(*[(int.from_bytes(c + bytes([s]), "big"), m) for c, row in seen.items() if len(c) == 2 for s, m in row.items()])
    keys, n = np.array(keys), np.array(n)
    model = language_score.Trie(keys, n, language_score._marginal(keys, n, 16), 2)
    for context in (b"br", b"zz", b"xa", b"\xff\xff"):
        codes = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(255)])
        assert model.scores(codes) == pytest.approx([log_p(seen, context, s) for s in range(255)])
        assert (10 ** model.scores(codes)).sum() == pytest.approx(1)


def test_no_training_rows_and_no_rows(spark):
    frame = spark.createDataFrame(ROWS[:2], "doc_id long, text string")
    for r in language_score.score(frame, F.lit(False)).collect():
        assert r.score == pytest.approx(-math.log10(255) * (len(dict(ROWS)[r.id]) + 1))
    assert language_score.score(frame.limit(0), F.lit(True)).count() == 0


def test_tables_and_held_out_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.partial_matching(spark, FOLDER).collect()}
    assert got.keys() == texts.keys()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 7 == 2)
    seen = trie([t for d, t in texts.items() if not got[d].held_out], language_score.ORDER)
    held = [d for d in texts if got[d].held_out]
    for d in held[:5]:
        assert got[d].score == pytest.approx(brute(seen, texts[d], language_score.ORDER))
    shorter = language_score.score(spark.read.parquet(f"{FOLDER}/documents.parquet"), language_score.training(), order=2).where("not train")
    assert sum(got[d].score for d in held) > shorter.agg(F.sum("score")).first()[0]
