"""Role repair against exhaustive search; long conversations over many pieces; odd rows."""

import itertools
import re

import pytest

from plotline.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = {n: r for n, r in enumerate(chat.ROLES, 1)}


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles)) and len(roles) % 2 == 0 and len(roles) > 0


def least_cost(roles):
    """Try every role, merge and number of empty turns for every row."""
    best = 1 << 60
    plans = itertools.product(chat.ROLES, (None, 0, 1, 2))
    fill = {0: [[]], 1: [["user"], ["assistant"], ["system"]], 2: [list(p) for p in itertools.product(chat.ROLES, repeat=2)]}
    for plan in itertools.product(plans, repeat=len(roles)):
        outs, cost = [[]], 0
        for row, (new, empty) in zip(roles, plan):
            cost += 2 * (new != row)
            if empty is None:
                cost += 1
                outs = [o for o in outs if o and o[-1] == new]
            else:
                cost += 3 * empty
                outs = [o + f + [new] for o in outs for f in fill[empty]]
        for o in outs:
            for tail in ([], ["assistant"], ["user", "assistant"]):
                if legal(o + tail):
                    best = min(best, cost + 3 * len(tail))
    return best


def cost(rows):
    price = {"keep": 0, "merge": 1, "relabel": 2, "relabel_merge": 3}
    return sum(price[r.action] + 3 * len(r.inserted) + 3 * len(r.appended) for r in rows)


def rendered(rows):
    return "".join(r.rendered for r in rows)


def read(text):
    return re.findall(r"<\|(system|user|assistant)\|>\n(.*?)<\|end\|>\n", text, re.S)


def grouped(frame):
    out = {}
    for r in frame.collect():
        out.setdefault(r.conv, []).append(r)
    return out


def test_every_short_conversation_is_repaired_at_least_cost(spark):
    cases = [c for n in (1, 2, 3) for c in itertools.product(["system", "user", "assistant", "x"], repeat=n)]
    rows = [(i, t, r, f"{i}.{t}") for i, c in enumerate(cases) for t, r in enumerate(c)]
    got = grouped(chat.repaired(spark.createDataFrame(rows, SCHEMA)))
    assert len(got) == len(cases)
    for i, case in enumerate(cases):
        turns = read(rendered(got[i]))
        assert "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns) == rendered(got[i])
        assert legal([r for r, _ in turns])
        assert [x for _, t in turns for x in t.split("\n") if x] == [f"{i}.{t}" for t in range(len(case))]
        assert cost(got[i]) == least_cost(case), case


@pytest.mark.parametrize("pieces", [1, 7, 40])
def test_long_conversations_do_not_depend_on_pieces(spark, pieces):
    rows = [(1, t, ["user", "user", "assistant", "system", "bot", None, "tool"][t * t % 7], f"t{t}") for t in range(200)] + [(c, t, "user", "u") for c in (2, 3, 4) for t in range(3)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", pieces)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = grouped(chat.repaired(spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    for c, part in got.items():
        roles = [chat.ROLES.index(x) + 1 if x in chat.ROLES else 3 if x == "bot" else None for x in (r[2] for r in rows if r[0] == c)]
        whole = chat.matrix(roles)[chat.NOTHING]
        best = min(whole[s] + chat.ending(s)[0] for s in range(4))
        assert cost(part) == best // chat.COST
        turns = read(rendered(part))
        assert legal([r for r, _ in turns]) and len(turns) == best % chat.COST
        assert max(r.new_turn for r in part) + len(part[-1].appended) == len(turns) - 1


def test_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (1, None, "User ", "hi <|end|> there"), (None, 5, "assistant", ""), (2, 3, "HUMAN", "w " * 50_000), (2, 3, "gpt", "b")]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as conv", "'z' as number", "2 as read")
    got = grouped(chat.repaired(frame))
    assert sum(map(len, got.values())) == len(rows)
    assert all(legal([r for r, _ in read(rendered(part))]) for part in got.values())
    assert read(rendered(got[1]))[0] == ("user", "hi < |end|> there\n") and [r.action for r in got[2]] == ["keep", "keep"]
    assert chat.repaired(frame.limit(0)).count() == 0


def test_tables(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    got = queries.role_repair(spark, "/root/testdata/sf0.01").withColumnRenamed("conv_id", "conv")
    got = grouped(got)
    assert sum(map(len, got.values())) == frame.count()
    assert all(legal([r for r, _ in read(rendered(part))]) for part in got.values())
