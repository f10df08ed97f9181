"""Chat formatting: minimum-cost role repair by dynamic programming, then rendering.

Legal conversations are those of an automaton: an optional system turn, then user and
assistant in turn, ending with the assistant. Every turn of the input gets one of the
three roles; a change of role costs RELABEL (TO_SYSTEM for a turn that becomes the
system turn). Between neighbours

    * the same role again: the turns are merged, which costs MERGE;
    * a legal step: free;
    * a step that lacks a turn: an empty one is inserted, which costs INSERT;
    * back to system: impossible.

The start and the end are steps too: a conversation that starts with the assistant
or ends with the user gets an empty turn there. The program finds the cheapest
assignment of roles; all conversations of a batch advance together, one turn at a time.

Rendering writes ``<|role|>``, a newline, the text and ``<|end|>`` with a newline for
each turn; merged texts are joined by a newline, and ``<|`` inside a text becomes ``< |``.

Defined results
    * null or unknown role: any role costs RELABEL (TO_SYSTEM for system).
    * null text: an empty text. An empty text is a turn like any other.
    * null conversation id: the turn belongs to no conversation and is left out.
    * null turn number: after all numbered turns.
    * ties in the turn number: by role, then text; a repeated row counts once.
    * ties in cost: the later turn's choice comes first: user before assistant before system,
      and going backwards the same for the turn before.
    * empty table: an empty result.
    * extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import id_field, typed

ROLES = ("user", "assistant", "system")
MERGE, RELABEL, TO_SYSTEM, INSERT = 2, 3, 5, 4
NEVER = 1 << 40
#: STEP[from, to]
STEP = np.array([[MERGE, 0, NEVER], [0, MERGE, NEVER], [0, INSERT, MERGE]], np.int64)
START = np.array([0, INSERT, 0], np.int64)
END = np.array([INSERT, 0, 2 * INSERT], np.int64)


def role_costs(role: np.ndarray) -> np.ndarray:
    """Turns x roles; role is an index of ROLES or -1."""
    cost = np.tile(np.array([RELABEL, RELABEL, TO_SYSTEM], np.int64), (len(role), 1))
    known = np.flatnonzero(role >= 0)
    cost[known, role[known]] = 0
    return cost


def repair(role: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(role of each turn, cost of each conversation); conversation c has the turns ptr[c]:ptr[c + 1], at least one."""
    cost, n = role_costs(role), np.diff(ptr)
    order = np.argsort(-n, kind="stable")
    base, length = ptr[:-1][order], n[order]
    longest = int(length[0]) if len(length) else 0
    active = np.searchsorted(-length, -np.arange(longest), side="left")
    back = np.zeros((len(role), 3), np.int8)
    now = START + cost[base]
    for t in range(1, longest):
        a = active[t]
        ways = now[:a, :, None] + STEP
        back[base[:a] + t] = ways.argmin(1)
        now[:a] = ways.min(1) + cost[base[:a] + t]
    total = now + END
    state = total.argmin(1)
    out = np.zeros(len(role), np.int8)
    for t in range(longest - 1, -1, -1):
        a = active[t]
        at = base[:a] + t
        out[at] = state[:a]
        state[:a] = back[at, state[:a]]
    best = np.empty(len(n), np.int64)
    best[order] = total.min(1) if longest else 0
    return out, best


def render(roles: list[int], texts: list[str]) -> tuple[str, int, int, int]:
    """(text, turns, merges, insertions) of one conversation with its repaired roles."""
    turns: list[tuple[int, str]] = []
    merges = inserts = 0
    for role, text in zip(roles, texts, strict=True):
        if turns and turns[-1][0] == role:
            turns[-1] = (role, turns[-1][1] + "\n" + text)
            merges += 1
            continue
        if role == 1 and (not turns or turns[-1][0] == 2):
            turns.append((0, ""))
            inserts += 1
        turns.append((role, text))
    for role in (0, 1):  # what is missing at the end
        if turns[-1][0] == (2 if role == 0 else 0):
            turns.append((role, ""))
            inserts += 1
    return "".join(f"<|{ROLES[r]}|>\n{t}<|end|>\n" for r, t in turns), len(turns), merges, inserts


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        turns = batch.column(1)
        flat = turns.flatten()
        ptr = np.concatenate(([0], np.cumsum(turns.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        names = flat.field("role").to_pylist()
        role = np.array([ROLES.index(r) if r in ROLES else -1 for r in names], np.int64)
        texts = [(t or "").replace("<|", "< |") for t in flat.field("text").to_pylist()]
        new, cost = repair(role, ptr)
        relabels = np.add.reduceat((new != role).astype(np.int64), ptr[:-1])
        given = new.tolist()
        rows = [render(given[lo:hi], texts[lo:hi]) for lo, hi in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True)]
        text, count, merges, inserts = zip(*rows, strict=True)
        numbers = [np.diff(ptr), count, relabels, merges, inserts, cost]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in numbers], pa.array(text, pa.string())], names=["conv_id", "turns_in", "turns_out", "relabels", "merges", "inserts", "cost", "text"])


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns_in, turns_out, relabels, merges, inserts, cost, text) of every conversation."""
    rows = turns.select(turns[conv_id].alias("conv_id"), turns[turn].alias("turn"), F.lower(F.trim(turns[role])).alias("role"), F.coalesce(turns[text], F.lit("")).alias("text")).where("conv_id is not null")
    parts = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_set(parts)).alias("turns"))
    light = grouped.select("conv_id", F.transform("turns", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("turns"))
    return light.mapInArrow(_formatted, typed(id_field(turns, conv_id, "conv_id"), "turns_in long, turns_out long, relabels long, merges long, inserts long, cost long, text string"))


#: The same as DuckDB SQL: costs forwards, roles backwards, then rendering.
ORACLE_SQL = f"""
    WITH RECURSIVE t AS (
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text) AS pos, role, text,
               CASE WHEN role = 'user' THEN 0 ELSE {RELABEL} END AS cu, CASE WHEN role = 'assistant' THEN 0 ELSE {RELABEL} END AS ca, CASE WHEN role = 'system' THEN 0 ELSE {TO_SYSTEM} END AS cs
        FROM (SELECT DISTINCT conv_id, turn, lower(trim(role)) AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
    f AS (
        SELECT conv_id, pos, cu AS u, ca + {INSERT} AS a, cs AS s, '' AS bu, '' AS ba, '' AS bs FROM t WHERE pos = 1
        UNION ALL
        SELECT t.conv_id, t.pos, least(f.u + {MERGE}, f.a, f.s) + cu, least(f.u, f.a + {MERGE}, f.s + {INSERT}) + ca, f.s + {MERGE} + cs,
               CASE least(f.u + {MERGE}, f.a, f.s) WHEN f.u + {MERGE} THEN 'user' WHEN f.a THEN 'assistant' ELSE 'system' END,
               CASE least(f.u, f.a + {MERGE}, f.s + {INSERT}) WHEN f.u THEN 'user' WHEN f.a + {MERGE} THEN 'assistant' ELSE 'system' END, 'system'
        FROM f JOIN t ON t.conv_id = f.conv_id AND t.pos = f.pos + 1),
    z AS (SELECT conv_id, max(pos) AS n FROM t GROUP BY ALL),
    e AS (SELECT f.*, least(u + {INSERT}, a, s + {2 * INSERT}) AS cost, CASE least(u + {INSERT}, a, s + {2 * INSERT}) WHEN u + {INSERT} THEN 'user' WHEN a THEN 'assistant' ELSE 'system' END AS r FROM f JOIN z ON z.conv_id = f.conv_id AND z.n = f.pos),
    b AS (
        SELECT conv_id, pos, r FROM e
        UNION ALL
        SELECT f.conv_id, f.pos - 1, CASE b.r WHEN 'user' THEN f.bu WHEN 'assistant' THEN f.ba ELSE f.bs END FROM b JOIN f ON f.conv_id = b.conv_id AND f.pos = b.pos WHERE b.pos > 1),
    m AS (SELECT b.conv_id, b.pos, b.r, b.r IS DISTINCT FROM t.role AS moved, replace(t.text, '<|', '< |') AS text,
                 lag(b.r) OVER (PARTITION BY b.conv_id ORDER BY b.pos) AS before, lead(b.r) OVER (PARTITION BY b.conv_id ORDER BY b.pos) AS after
          FROM b JOIN t ON t.conv_id = b.conv_id AND t.pos = b.pos),
    p AS (SELECT *, r = 'assistant' AND (before IS NULL OR before = 'system') AS empty_user, coalesce(before = r, false) AS merged,
                 CASE WHEN after IS NULL AND r = 'user' THEN 1 WHEN after IS NULL AND r = 'system' THEN 2 ELSE 0 END AS tail FROM m)
    SELECT p.conv_id, count(*) AS turns_in, (count(*) - sum(merged::INT) + sum(empty_user::INT) + sum(tail))::BIGINT AS turns_out, sum(moved::INT)::BIGINT AS relabels,
           sum(merged::INT)::BIGINT AS merges, (sum(empty_user::INT) + sum(tail))::BIGINT AS inserts, any_value(e.cost)::BIGINT AS cost,
           string_agg(CASE WHEN empty_user THEN '<|user|>' || chr(10) || '<|end|>' || chr(10) ELSE '' END
                      || CASE WHEN merged THEN chr(10) ELSE '<|' || p.r || '|>' || chr(10) END || p.text
                      || CASE WHEN coalesce(after = p.r, false) THEN '' ELSE '<|end|>' || chr(10) END
                      || CASE WHEN tail = 2 THEN '<|user|>' || chr(10) || '<|end|>' || chr(10) ELSE '' END
                      || CASE WHEN tail > 0 THEN '<|assistant|>' || chr(10) || '<|end|>' || chr(10) ELSE '' END, '' ORDER BY p.pos) AS text
    FROM p JOIN e ON e.conv_id = p.conv_id GROUP BY p.conv_id"""
