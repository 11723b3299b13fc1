"""Conversations made legal at least cost, by dynamic programming over an automaton of turns.

A legal conversation may open with a system turn; then user and assistant turns
alternate, and an assistant has the last word.  Every row of the table is given
a role; it is appended (after empty turns where the automaton needs them) or
merged into the turn before.  Costs of stretches of a conversation combine like
matrices, so a conversation of any length is repaired piece by piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plotline.llm.runs import piece_number, sorted_pieces, stretches

#: States: nothing yet, or the role of the last turn.
ROLES = ("system", "user", "assistant")
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {NOTHING: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Fixed costs; a row whose role is none of the three must be relabelled.
MERGE, RELABEL, INSERT = 1, 2, 3
#: Costs and numbers of new turns travel as one number: fewer turns break ties of cost.
COST = 1 << 40
NEVER = 1 << 62
#: Names under which roles are known (fixed values).
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant"}


def _paths() -> dict[int, dict[int, tuple[int, ...]]]:
    """Empty turns that lead from one state to where a role may follow."""
    found: dict[int, dict[int, tuple[int, ...]]] = {}
    for state in range(4):
        reach, found[state] = [((), state)], {}
        while reach:
            path, at = reach.pop(0)
            for role in FOLLOWS[at]:
                if role not in found[state]:
                    found[state][role] = path
                    reach.append(((*path, role), role))
    return found


PATHS = _paths()


def steps(role: int | None) -> dict[tuple[int, int], tuple[int, bool, tuple[int, ...]]]:
    """From and to state: least cost, whether merged, and empty turns before, for a row of this role."""
    made = {}
    for state in range(4):
        for new in (SYSTEM, USER, ASSISTANT):
            cost = RELABEL if new != role else 0
            choices = []
            if new == state:
                choices.append(((cost + MERGE) * COST, True, ()))
            if new in PATHS[state]:
                path = PATHS[state][new]
                choices.append(((cost + INSERT * len(path)) * COST + len(path) + 1, False, path))
            if choices:
                made[state, new] = min(choices, key=lambda c: c[0])
    return made


STEPS = {role: steps(role) for role in (None, SYSTEM, USER, ASSISTANT)}


def ending(state: int) -> tuple[int, tuple[int, ...]]:
    """Cost and empty turns that give the assistant the last word."""
    if state in (NOTHING, ASSISTANT):
        return 0, ()
    path = (*PATHS[state][ASSISTANT], ASSISTANT)
    return INSERT * len(path) * COST + len(path), path


def matrix(roles: list[int | None]) -> list[list[int]]:
    """Least cost of a stretch between every two states."""
    rows = [[0 if i == j else NEVER for j in range(4)] for i in range(4)]
    for role in roles:
        new = [[NEVER] * 4 for _ in range(4)]
        for (a, b), (cost, _, _) in STEPS[role].items():
            for i in range(4):
                if rows[i][a] + cost < new[i][b]:
                    new[i][b] = rows[i][a] + cost
        rows = new
    return rows


def decode(roles: list[int | None], start: int, end: int | None) -> list[tuple[int, bool, tuple[int, ...]]]:
    """The cheapest steps from ``start`` to ``end`` (None: to where ending is cheapest)."""
    costs, back = [NEVER] * 4, []
    costs[start] = 0
    for role in roles:
        new, came = [NEVER] * 4, [0] * 4
        for (a, b), (cost, _, _) in STEPS[role].items():
            if costs[a] + cost < new[b]:
                new[b], came[b] = costs[a] + cost, a
        costs = new
        back.append(came)
    state = end if end is not None else min(range(4), key=lambda s: costs[s] + ending(s)[0])
    path = []
    for role, came in zip(reversed(roles), reversed(back), strict=True):
        before = came[state]
        _, merged, empty = STEPS[role][before, state]
        path.append((state, merged, empty))
        state = before
    return path[::-1]


def _links(pieces: list[dict]) -> dict[tuple[int, bool], tuple[int, int | None, int, bool]]:
    """For stretches of conversations that span pieces: entry and exit state, turns before, whether it ends.

    Keyed by piece and whether the stretch is the piece's first; a stretch that
    is its whole piece is its first.
    """
    links, i = {}, 0
    while i < len(pieces):
        j = i
        while j + 1 < len(pieces) and pieces[j + 1]["conv"] == pieces[i]["conv"]:
            j += 1
        if j > i:
            forward = [[0, NEVER, NEVER, NEVER]]
            for part in pieces[i : j + 1]:
                forward.append([min(min(NEVER, forward[-1][a] + part["matrix"][a][b]) for a in range(4)) for b in range(4)])
            states = [min(range(4), key=lambda s: forward[-1][s] + ending(s)[0])]
            for part, costs in zip(reversed(pieces[i : j + 1]), reversed(forward[:-1]), strict=True):
                states.append(min(range(4), key=lambda a: costs[a] + part["matrix"][a][states[-1]]))
            states.reverse()
            turns = 0
            for n, part in enumerate(pieces[i : j + 1]):
                links[part["piece"], part["first"]] = (states[n], states[n + 1], turns, i + n == j)
                turns += part["matrix"][states[n]][states[n + 1]] % COST
        i = j + 1
    return links


def _marked(role: int, text: str) -> str:
    return f"<|{ROLES[role - 1]}|>\n{text}"


def normal_role(role: Column) -> Column:
    """The number of a role's name, in any case; none for other names."""
    name = F.lower(F.trim(role))
    for alias, real in ALIASES.items():
        name = F.when(name == alias, real).otherwise(name)
    found = F.lit(None).cast("int")
    for number, real in enumerate(ROLES, 1):
        found = F.when(name == real, number).otherwise(found)
    return found


def repaired(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, turn, role, action, new_role, new_turn, inserted, appended, rendered for every row of ``turns``.

    Rows are ordered by turn (null first), then as read.  ``action`` is keep,
    merge, relabel or relabel_merge; ``new_turn`` counts the repaired turns from
    0; ``inserted`` lists the empty turns put before the row, ``appended`` those
    after a conversation's last row.  ``rendered`` joined in order (new_turn,
    turn) is the whole conversation; a null text counts as empty, and "<|" in a
    text is written "< |" so that no text can pose as a mark.  Rows without
    conversation form one of their own.  Repeated rows are turns like others.
    Of equally cheap repairs the one with fewer turns is taken, then a fixed one.
    """
    kind = turns.schema[conv].dataType.simpleString()
    body = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), normal_role(F.col(role)).alias("number"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"), F.monotonically_increasing_id().alias("read"),
    )
    pieces = sorted_pieces(body, "conv", "turn", "read")

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for conv_id, rows in stretches(batches, lambda r: r["conv"], ["conv", "number"]):
            last = conv_id, [r["number"] for r in rows]
            first = first or last
        if first:
            found = [(True, *first)] + ([(False, *last)] if last is not first else [])
            yield pa.RecordBatch.from_arrays([
                pa.array([piece_number()] * len(found)), pa.array([f for f, _, _ in found]), pa.array([c for _, c, _ in found], pieces_schema), pa.array([[x for row in matrix(r) for x in row] for _, _, r in found]),
            ], names=["piece", "first", "conv", "flat"])

    pieces_schema = to_arrow_type(pieces.schema["conv"].dataType)
    # Two small rows for each piece.
    ends = pieces.select("conv", "number").mapInArrow(edges, f"piece long, first boolean, conv {kind}, flat array<long>").collect()
    ends = sorted(({"piece": r["piece"], "first": r["first"], "conv": r["conv"], "matrix": [list(r["flat"][i : i + 4]) for i in (0, 4, 8, 12)]} for r in ends), key=lambda r: (r["piece"], not r["first"]))
    links = turns.sparkSession.sparkContext.broadcast(_links(ends))
    turn_kind, role_kind = pieces.schema["turn"].dataType.simpleString(), pieces.schema["role"].dataType.simpleString()
    names = ["conv", "turn", "role", "action", "new_role", "new_turn", "inserted", "appended", "rendered"]
    kinds = [pieces_schema, to_arrow_type(pieces.schema["turn"].dataType), to_arrow_type(pieces.schema["role"].dataType), pa.string(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, pending = piece_number(), None

        def made(conv_id, rows, key):
            start, end, count, closes = links.value.get(key, (NOTHING, None, 0, True))
            roles = [r["number"] for r in rows]
            out, state = [], start
            for row, (new, merged, empty) in zip(rows, decode(roles, start, end), strict=True):
                relabelled = new != row["number"]
                action = ("relabel_merge" if relabelled else "merge") if merged else "relabel" if relabelled else "keep"
                chunk = "\n" + row["text"] if merged else "".join(("<|end|>\n" if s else "") + _marked(r, "") for s, r in zip([state, *empty], [*empty], strict=False)) + ("<|end|>\n" if state or empty else "") + _marked(new, row["text"])
                count += 0 if merged else len(empty) + 1
                out.append([conv_id, row["turn"], row["role"], action, ROLES[new - 1], count - 1, [ROLES[r - 1] for r in empty], [], chunk])
                state = new
            if closes:
                _, empty = ending(state)
                out[-1][7] = [ROLES[r - 1] for r in empty]
                out[-1][8] += "<|end|>\n" + "".join(_marked(r, "") + "<|end|>\n" for r in empty)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        # The last stretch is known as such only when no other follows.
        for n, (conv_id, rows) in enumerate(stretches(batches, lambda r: r["conv"], ["conv", "turn", "role", "number", "text"])):
            if pending:
                yield made(*pending, (piece, True) if n == 1 else None)
            pending = conv_id, rows
            last = (piece, n == 0)
        if pending:
            yield made(*pending, last)

    return pieces.select("conv", "turn", "role", "number", "text").mapInArrow(render, f"conv {kind}, turn {turn_kind}, role {role_kind}, action string, new_role string, new_turn long, inserted array<string>, appended array<string>, rendered string")
