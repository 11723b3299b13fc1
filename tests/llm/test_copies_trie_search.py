"""Exact copies, prefix trie and ranked search against brute force, on odd and on long rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plotline.llm import exact_copies, prefix_trie, ranked_search

SMALL = str.maketrans(exact_copies.UPPER, exact_copies.LOWER)


def test_copies(spark):
    long = "x" * 5_000
    texts = [None, "", "A", "a", "É", "é", "b" * 64, "B" * 64, "b" * 65, "b" * 63 + "é", "b" * 63 + "è", long + "1", long + "1", long + "2", "y" * 70_000, "Y" * 70_000, "y" * 69_999 + "z", "é" * 64 + "a", "é" * 64 + "A", "é" * 64 + "b"]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(None, "A", "n"), (None, "only", "n"), (None, "only", "n"), (3, "a", "n")] + [(1000 + i, "hot " * 30, "n") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string").withColumnRenamed("n", "row").repartition(5)
    # Numbers of rows hold for tables read from files.
    found = exact_copies.exact_copies(exact_copies.settle(docs)).collect()
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[(t or "").translate(SMALL)].append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert Counter(want) == Counter((r.id, r.keep_id, r.group_size, r.text_sha256) for r in found)
    stay = [r for r in found if r.kept]
    assert len(stay) == len(groups) and all(r.id == r.keep_id and r.row == r.keep_row for r in stay)


def test_copies_of_an_empty_table(spark):
    assert exact_copies.exact_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def trie(rows):
    """All nodes of the rebuilt conversations, one by one."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    seqs = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = tuple(convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                kids[seq[: d - 1]].add(seq[:d])
    leaves, saved, out = {}, {}, []
    for seq in sorted(members, key=len, reverse=True):
        leaves[seq] = sum(leaves[k] for k in kids[seq]) or 1
        saved[seq] = sum(saved[k] for k in kids[seq]) + ((len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0)
        ends = ",".join(str(c) for c in sorted(c for c in members[seq] if len(seqs[c]) == len(seq)))
        out.append((min(members[seq]), len(seq), min(members[seq[:-1]]) if seq else None, len(members[seq]), len(kids[seq]), leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def test_trie(spark):
    shared = [("user", f"turn {i % 3}") for i in range(20)]
    rows = [(c, t, *shared[t]) for c in range(10, 15) for t in range(20 if c != 12 else 9)]  # long, alike over three blocks
    rows += [(13, 19, "user", "another end"), (15, None, "user", "first"), (15, None, None, "ß"), (15, 2, "user", None), (15, 2, "user", None), (16, 1, "a", "b"), (17, 1, "ab", "")]
    rows += [(c, t, "user", f"same {t}") for c in range(20, 70, 5) for t in range(3)]  # copies of one conversation
    rows += [(100, t, "user", f"own {t}") for t in range(40)]  # alone and long
    rows += [(None, 1, "user", "nobody's"), (-7, 1, "user", "same 0"), (203, 0, "user", "short"), (204, 0, "", "")]
    turns = prefix_trie.settle(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, key string"))
    found = prefix_trie.prefix_trie(turns)
    assert trie(rows) == Counter(tuple(r) for r in found.select("conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranking(docs, items, k=20):
    """Every score, one by one."""
    docs = [(i, WORD.findall((t or "").translate(SMALL))) for i, t in docs]
    n, length = sum(1 for _, w in docs if w), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for i, w in docs:
            tf, m = Counter(w), 100 - 25 + 25 * len(w) * n // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in WORD.findall((text or "").translate(SMALL)) if tf[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def searched(spark, docs, items, **options):
    frame = spark.createDataFrame([(i, t, 1.5) for i, t in docs], "doc_id long, text string, score double")
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    found = ranked_search.ranked(frame, asked, **options)
    return Counter((r.item_id, r["rank"], r.id, r.score) for r in found.collect())


def test_ranked(spark):
    draw = np.random.default_rng(7)
    names = [f"w{i}" for i in range(300)] + ["É", "ß9", "naïve"]
    weights = 1 / np.arange(1, len(names) + 1)
    text = lambda n: " ".join(draw.choice(names, n, p=weights / weights.sum()))
    docs = [(int(i), text(int(draw.integers(1, 60)))) for i in draw.permutation(900)]
    docs += [(2000 + i, docs[0][1].upper().replace(" ", "-")) for i in range(60)]  # copies: ties by id
    docs += [(None, docs[1][1]), (5, docs[5][1]), (5, docs[5][1]), (3000, None), (3001, ""), (3002, "...   !"), (3003, text(30_000))]
    items = [(i, text(int(draw.integers(1, 40)))) for i in range(30)] + [(3, docs[0][1]), (None, "w1 w1 É"), (50, None), (51, ""), (52, "unknown"), (3, docs[0][1])]
    want = ranking(docs, items)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, block_bytes=600) == want  # several passes


def test_ranked_passes_over_batches():
    """Bounds spare most scores where batches differ, and lose none."""
    draw = np.random.default_rng(3)
    owner, term = np.repeat(np.arange(4096), 8), np.concatenate([g * 50 + draw.integers(0, 50, 8) for g in np.arange(4096) // 256])
    _, keep = np.unique(owner * 1000 + term, return_index=True)
    owner, term = owner[keep], term[keep]
    impact = draw.integers(1, 1000, len(owner))
    items = [(i, np.unique(i // 4 * 50 + draw.integers(0, 50, 10)), None) for i in range(64)]
    items = ranked_search.ItemSet([(i, at, np.ones(len(at), np.int64)) for i, at, _ in items], np.arange(1000))
    best = ranked_search.Best(64, 5)
    computed = ranked_search.search((np.arange(4096), owner, term, impact), items, best)
    full = np.zeros((4096, 1000), np.int64)
    full[owner, term] = impact
    for number, (rows, used, repeats) in enumerate(items.leaves):
        scores = full[:, items.columns[used]] @ repeats
        for item, column in zip(items.numbers[rows], scores.T):
            order = np.lexsort((np.arange(4096), -column))[:5]
            assert best.scores[item].tolist() == column[order].tolist()
            assert best.ids[item].tolist() == order.tolist()
    assert computed < 4096 * 64 / 4


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a b")], []), ([(1, None)], [(1, "a")]), ([], [])])
def test_ranked_of_empty_tables(spark, docs, items):
    assert not searched(spark, docs, items)


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=40))
def test_terms(text):
    import pyarrow as pa

    hashes, owner = ranked_search.terms(pa.array([text, text], pa.string()))
    assert len(hashes) == 2 * len(WORD.findall(text)) and len(set(hashes.tolist())) == len({w.translate(SMALL) for w in WORD.findall(text)})
