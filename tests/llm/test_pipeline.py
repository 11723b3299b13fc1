"""Quality model against brute force, and the pipeline stage by stage."""

import math
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plotline.llm import decontaminate, pieces, quality
from plotline.session import checkpoint_folder

FOLDER = "/root/testdata/sf0.001"


def brute_kneser_ney(texts, order):
    """Probabilities by the book, over padded bytes."""
    counts = [Counter() for _ in range(order + 1)]
    for t in texts:
        stream = bytes([0xFF] * order) + (t or "").encode() + bytes([0xFE])
        for i in range(order, len(stream)):
            counts[order][stream[i - order : i + 1]] += 1
    for k in range(order - 1, -1, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, totals, ways = [], [], []
    for table in counts:
        n = [sum(c == j for c in table.values()) for j in (1, 2, 3, 4)]
        share = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        cut = [0.0]
        for j in (1, 2, 3):
            cut.append(min(max(j - (j + 1) * share * n[j] / n[j - 1] if n[j - 1] else 0.5, 0.1), j - 0.1))
        total, gone = Counter(), defaultdict(float)
        for g, c in table.items():
            total[g[:-1]] += c
            gone[g[:-1]] += cut[min(c, 3)]
        cuts.append(cut), totals.append(total), ways.append(gone)

    def p(context, symbol):
        value = 1 / 255
        for k in range(order + 1):
            c = context[len(context) - k :]
            if totals[k][c]:
                n = counts[k][c + bytes([symbol])]
                value = (n - cuts[k][min(n, 3)]) / totals[k][c] + ways[k][c] / totals[k][c] * value
        return value

    return p


def test_model_against_brute_force(spark):
    texts = ["abra cadabra", "the cat and the hat", "abra the cat", "ñandú é", ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    trusted = docs.select("doc_id").where(quality._even(F.col("doc_id")))
    chosen = [texts[r.doc_id] for r in trusted.collect()]
    model = quality.fit(docs, docs.select("doc_id"), order=2)
    p = brute_kneser_ney(chosen, 2)
    for context in (b"ab", b"th", b"zz", b"\xff\xff", b"a "):
        codes = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(255)])
        got = np.exp(model.scores(codes))
        assert got == pytest.approx([p(context, s) for s in range(255)])
        assert got.sum() == pytest.approx(1)
    rows = spark.createDataFrame([("the abra",), (None,), ("",)], "text string").withColumn("loss", F.lit("clash"))
    for r in quality.losses(rows, model).collect():
        stream = b"\xff\xff" + (r.text or "").encode() + b"\xfe"
        assert r.symbols == len(stream) - 2
        assert r.loss == pytest.approx(-sum(math.log(p(stream[i - 2 : i], stream[i])) for i in range(2, len(stream))))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.judged(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels.withColumnRenamed("doc_id", "key"), "key")
    # Only documents that did not fit the model.
    rate = {(r.quality, r.toxic): r.kept for r in rows.where(~quality._even(F.col("key"))).groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()}
    assert rate[1, 0] > 0.985 and rate[0, 0] < 0.1


def test_toxic_passages_in_long_texts(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = quality.judged(docs, labels).join(labels.withColumnRenamed("doc_id", "key"), "key").where("quality = 1").where(~quality._even(F.col("key")))
    rate = {(r.toxic, r.english): (r.kept, r.n) for r in rows.groupBy("toxic", (F.col("lang") == "en").alias("english")).agg(F.avg(F.col("keep").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    # Toxic words outside English are made of common syllables, which no passage tells (README).
    assert rate[0, True][0] > 0.985 and rate[0, False][0] > 0.985 and rate[1, True][0] < 0.1
    # Long texts hide a few words from the mean, not from the worst passage.
    long = rows.where("toxic = 1 and lang = 'en' and symbols > 3000").agg(F.avg(F.col("keep").cast("int")), F.count("*")).first()
    assert long[1] > 10 and long[0] < 0.1


def test_thresholds_of_languages_against_brute_force(spark):
    limits = spark.createDataFrame([("en", 20.0, 3.0, 500), ("fr", 50.0, 4.0, 5), ("", 9.0, 1.0, 1)], "lang string, threshold double, passage_threshold double, n long")
    for r, n in zip(quality.shrunk(limits, 30.0, 3.5, 5).collect(), (500, 5, 1), strict=True):
        own, passage = {"en": (20, 3), "fr": (50, 4), "": (9, 1)}[r.lang]
        assert r.threshold == pytest.approx((own**n * 30**5) ** (1 / (n + 5)) if n < 100 else math.exp((n * math.log(own) + 5 * math.log(30)) / (n + 5)))
        assert r.passage_threshold == pytest.approx((n * passage + 5 * 3.5) / (n + 5))
    # One trusted text of a language: no switch, and few texts do not decide alone.
    docs = spark.createDataFrame([(i, "the quick brown fox " * (i % 7 + 1), "en" if i else "xx") for i in range(60)], "doc_id long, text string, lang string")
    labels = spark.range(60).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    judge, _ = quality.train(docs, labels)
    found = {r.lang: r for r in judge.limits.collect()}
    assert set(found) <= {"en", "xx"} and found["en"].threshold == pytest.approx(judge.other[0], rel=0.1)


@pytest.mark.parametrize("window", [1, 3])
def test_worst_passage_against_brute_force(window):
    texts = ["a bb  ccc\td", "", " ", "  lead word", "one", "x y z w v ", "\n", "tail\n\n"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bounds = np.r_[0, np.cumsum([len(t) for t in texts])]
    loss = np.random.default_rng(1).random(len(data) + len(texts)) * 5
    got = quality.worst_passages(loss, data, bounds, 1.5, window, 2)
    for i, text in enumerate(texts):
        words = re.findall(r"^\s*\S+\s*|\S+\s*", text) or [text]
        sizes = [len(w) for w in words]
        sizes[-1] += 1
        at, places = bounds[i] + i, np.r_[0, np.cumsum(sizes)]
        windows = [(places[j], places[min(j + window, len(sizes))]) for j in range(max(1, len(sizes) - window + 1))]
        assert got[i] == pytest.approx(max((loss[at + a : at + b].sum() + 1.5 * 2) / (b - a + 2) for a, b in windows))


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (1, "x", "en"), (None, "x " * 50_000, "en"), (2, "", "xx")], "doc_id long, text string, lang string").selectExpr("*", "'q' as perplexity", "1 as key")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judged(docs, labels).count() == 4
    kept = quality.kept(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4
    assert quality.kept(docs.limit(0), labels.limit(0)).count() == 0


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frames[-1], FOLDER).write.parquet(f"{tmp_path}/{name}")
        frames.append(spark.read.parquet(f"{tmp_path}/{name}"))
    for frame in frames[:-1]:
        assert frame.columns == columns
    kept = [{r.doc_id: r.text for r in f.select("doc_id", "text").collect()} for f in frames[:-1]]
    for before, after in zip(kept, kept[1:]):
        assert set(after) <= set(before)
    # Near duplicates: no two kept documents are alike, and every dropped one is like some other.
    def shingles(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = {d: shingles(t) for d, t in kept[1].items()}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    stay = list(kept[2])
    assert not any(sets[a] and alike(a, b) for i, a in enumerate(stay) for b in stay[:i])
    for d in set(kept[1]) - set(kept[2]):
        assert any(alike(d, o) for o in sets if o != d)
    # Benchmark passages.
    grams = {w for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect() for w in decontaminate.windows(r.text, 10)}
    for d, text in kept[2].items():
        line = " " + " ".join(text.encode().translate(decontaminate.NORMAL).decode().split()) + " "
        assert (d in kept[3]) == (not any(g in line for g in grams))
    # Secrets: nothing else changes.
    for d, text in kept[4].items():
        assert text == kept[3][d] or "[SECRET]" in text
    # Encoding: an exact round trip.
    library = pieces.Pieces(corpus_pipeline.public_tokenizers.path("piece_bpe_32k.model")).library
    last = {r.doc_id: r.token_ids for r in frames[-1].select("doc_id", "token_ids").collect()}
    assert last.keys() == kept[4].keys() == kept[3].keys()
    for d, ids in last.items():
        assert library.decode(ids) == kept[4][d]


def test_stages_on_odd_documents(spark, tmp_path):
    """Nulls, empty, long and repeated texts, an empty table, and extra columns with the operators' own names."""
    secret = "password = aGVsbG8gd29ybGQgMTIz"
    texts = [None, "", "   ", "one", "one", f"before {secret} after", "word " * 40_000, spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text]
    rows = [(None if i == 3 else i % 6, t, None if i % 2 else "en", None, None if t is None else len(t), 42, "x", "s", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, secrets string, _sure_spans string, row int")
    path = f"{tmp_path}/docs"
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        found = out.collect()
        if name == "token_ids":
            assert len(found) == len(rows)
            continue
        assert out.columns == docs.columns
        assert all((r.n_words, r.secrets, r._sure_spans, r.row) == (42, "x", "s", 7) for r in found)
        assert len(found) == {"without_benchmark": 7, "near_duplicates": 7}.get(name, len(rows)) or name == "trusted_quality"
        if name == "without_secrets":
            assert [r.n_chars for r in found if r.text and "[SECRET]" in r.text] == [len("before [SECRET] after")]
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_all_trusted_texts_fit_the_model_in_shards(spark, monkeypatch):
    """More trusted texts than any sample; a model in shards scores texts and passages as the whole does."""
    docs = spark.range(12_000).selectExpr("id as doc_id", "concat('w', id, ' the word ', id % 7, ' ñ', id % 11) as text", "cast(null as string) as lang", "'x' as loss")
    folder = f"{checkpoint_folder(spark)}/shards-{uuid.uuid4().hex}"
    docs.repartition(3).write.parquet(folder)
    docs = spark.read.parquet(folder)
    model = quality.fit(docs, docs.select("doc_id"))
    half = docs.where(quality._even(F.col("doc_id")))
    assert model.symbols == half.agg(F.sum(F.octet_length("text") + 1)).first()[0] and half.count() > 5_500
    shards = quality.fit(docs, docs.select("doc_id"), shard_bytes=100_000)
    assert len(shards.parts) > 3 and shards.mean == pytest.approx(model.mean)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "  lead word"), (4, "zz\n\n qq the word "), (4, "zz\n\n qq the word ")], "doc_id long, text string")
    folder = f"{checkpoint_folder(spark)}/shards-{uuid.uuid4().hex}"
    docs.drop("loss", "lang").where("doc_id > 11000").union(odd).repartition(5).write.parquet(folder)
    rows = spark.read.parquet(folder)
    for window in (1, 3):
        monkeypatch.setattr(quality._worst, "__defaults__", (window, quality.PASSAGE_PRIOR))
        monkeypatch.setattr(quality.worst_passages, "__defaults__", (window, quality.PASSAGE_PRIOR))
        one, many = (sorted(map(tuple, quality.losses(rows, m).selectExpr("doc_id", "coalesce(text, '-')", "symbols", "loss", "passage").collect())) for m in (model, shards))
        assert len(one) == len(many) == 1_004
        for a, b in zip(one, many, strict=True):
            assert a[:3] == b[:3] and a[3:] == pytest.approx(b[3:])
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    kept = quality.train(docs, labels, shard_bytes=100_000)[1]
    assert kept.count() == 12_000 and "text" in kept.columns


def test_only_texts_that_fit_the_model_move(spark):
    """Few trusted texts among many: one plan at every size, in which the other texts are passed over before the shuffle."""
    rows = [(None, "no key")] + [(i % 5_000, f"text {i}") for i in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    trusted = spark.range(0, 5_000, 50).select(F.col("id").alias("doc_id")).union(spark.createDataFrame([(None,), (100,)], "doc_id long"))
    found = quality.fitted_texts(docs, trusted, "doc_id", "text")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("SortMergeJoin") < plan.index("getbit") and "BroadcastHashJoin [key" not in plan
    chosen = {r.key for r in trusted.select(F.col("doc_id").alias("key")).where(quality._even(F.col("key"))).collect() if r.key is not None}
    assert sorted(r.text for r in found.collect()) == sorted(t for k, t in rows if k in chosen) and 30 < len(chosen) < 70
    body = docs.select(F.col("doc_id").alias("key"), "text")
    marked = quality._marked(body, trusted.select(F.col("doc_id").alias("key")).where("doc_id is not null"))
    assert marked.columns == ["key", "text"] and 100 <= marked.select("key").distinct().count() < 110
