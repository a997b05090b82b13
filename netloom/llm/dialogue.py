"""Conversation structure repair: the cheapest edits that make the turns of a conversation follow its grammar.

The grammar of role initials is `(s?(ua)+)?`. A backward dynamic programme over turn and grammar state gives each place's
cost to go; a forward walk then takes the ASCII-least edit among those that keep to that cost. Inserted and changed roles
follow from the state, so every edit has one target and the walk finds the ASCII-least sequence of all.

Turns are range-partitioned in their order and cut into pieces of a bounded number of turns and characters, so a
conversation of any length is spread over tasks. A piece that is not a whole conversation gives a 4 x 4 matrix of costs
from state to state; the matrices are combined backwards, then the states forwards, one row a piece. Only the hash of the
repaired turns reads a conversation in one sequence, as a stream.

Edge cases: nulls of role and text, and of conv_id and turn in the key of the damage, are one space; rows with a null conv_id
are one conversation; turns without a number come first; turns of one number go by the MD5 of `role:text`, repeats side by
side; a role without letters has no place in the grammar; empty texts are blank; very long texts are streamed; an empty
table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import cut

#: Costs of the edits; a truncated turn that stays adds one.
REROLE, DELETE, INSERT = 2, 3, 2
#: Grammar states: 0 nothing yet, 1 after s, 2 after u, 3 after a. EXPECTED: the state after the one user or assistant turn that may follow.
EXPECTED = (2, 2, 3, 2)
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "-": (None,) * 4, "x": (None,) * 4}
ROLE = {2: "user", 3: "assistant"}
#: The cost to go behind the last turn.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 60
SPOKEN, CUT_OFF = r"[^\x20\x09-\x0D]", r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\Z"
#: The code of a truncated turn, by its initial.
CUT = {"s": "S", "u": "U", "a": "A", "-": "X"}
Costs = tuple[int, ...]


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with damage dealt by crc32(`conv_id:turn`) % 20, nulls as one space, and `copy`."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    marked = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"), hit.alias("hit")).where("hit != 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def before(code: str, after: Costs, insert: bool = True) -> Costs:
    """Costs to go in front of a turn, from those behind it. code: '.' must go; else the initial, in upper case if truncated."""
    own, extra, out = AFTER[code.lower()] if code != "." else None, int(code.isupper()), []
    for s in range(4):
        best = DELETE + after[s]
        if own is not None:
            best = min(best, REROLE + extra + after[EXPECTED[s]])
            if own[s] is not None:
                best = min(best, extra + after[own[s]])
        out.append(best)
    if insert:
        user, assistant = min(out[2], INSERT + out[3]), min(out[3], INSERT + out[2])
        out = [min(out[0], INSERT + user), min(out[1], INSERT + user), user, assistant]
    return tuple(out)


def walk(codes: str, state: int, end: Costs, last: bool) -> tuple[str, int, int]:
    """(audit, state behind, cost) of the ASCII-least cheapest edits of a piece, given the costs to go behind it."""
    togo = [end]
    for code in reversed(codes):
        togo.append(before(code, togo[-1]))
    togo.reverse()
    audit, i, first = [], 0, togo[0][state]
    while i < len(codes) or last and state not in (0, 3):
        left, code = togo[i][state], codes[i] if i < len(codes) else "!"
        own, extra = AFTER[code.lower()][state] if code not in ".!" else None, int(code.isupper())
        if code != "!" and left == DELETE + togo[i + 1][state]:
            edit, step = "D", 1
        elif left == INSERT + togo[i][EXPECTED[state]]:
            edit, step, state = "I", 0, EXPECTED[state]
        elif own is not None and left == extra + togo[i + 1][own]:
            edit, step, state = "K", 1, own
        else:
            edit, step, state = "R", 1, EXPECTED[state]
        audit.append(edit)
        i += step
    return "".join(audit), state, first - (0 if last else togo[-1][state])


def _ordered(rows: DataFrame) -> DataFrame:
    """Damaged rows with their keys, the number of the first turn that says the same (`said`), in order over the range partitions."""
    key = F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-"))
    keyed = rows.select(key.alias("conv"), F.col("turn").isNotNull().alias("has"), F.coalesce("turn", F.lit(0)).alias("turn"), "role", "text", "copy",
                        F.md5(F.concat("role", F.lit(":"), "text").cast("binary")).alias("sig"))
    firsts = keyed.groupBy("conv", "sig").agg(F.min(F.struct("has", "turn")).alias("said"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = F.coalesce(F.struct("has", "turn") > F.col("said"), F.lit(False))
    out = keyed.join(firsts, ["conv", "sig"], "left").withColumn("again", again).drop("said")
    order = ["conv", "has", "turn", "sig", "copy"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


PIECES = "conv string, piece long, at long, role string, text string, plan string"


def _pieces(most: int, most_chars: int) -> object:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows with their piece and place; each piece's last row is followed by one with at = -1 and the piece's facts as JSON."""
        spoken, cut_off = re.compile(SPOKEN), re.compile(CUT_OFF)
        number, held, prior, out = TaskContext.get().partitionId() << 32, None, None, []

        def fresh(conv: str, opens: bool) -> dict:
            return {"conv": conv, "opens": opens, "codes": [], "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "distinct": 0, "turns": None, "ends": None, "chars": 0}

        def close() -> None:
            nonlocal number
            facts = held | {"codes": "".join(held["codes"]), "head": held["ends"][0], "tail": held["ends"][1]}
            if facts["opens"]:  # another piece may come before
                columns = []
                for s in range(4):
                    costs = tuple(0 if t == s else FAR for t in range(4))
                    for code in reversed(facts["codes"]):
                        costs = before(code, costs)
                    columns.append(costs)
                facts["matrix"] = columns
            out.append((held["conv"], number, -1, "", "", json.dumps(facts)))
            number += 1

        start = True
        for rows in batches:
            for conv, has, turn, sig, role, text, again in zip(rows["conv"], rows["has"], rows["turn"], rows["sig"], rows["role"], rows["text"], rows["again"], strict=True):
                if held is None or held["conv"] != conv:
                    if held is not None:
                        close()
                    held, prior, start = fresh(conv, start), None, False
                elif len(held["codes"]) >= most or held["chars"] >= most_chars:
                    close()
                    held = fresh(conv, True)
                repeat = again or prior == (has, turn, sig)
                if not spoken.search(text):
                    fault = "blank"
                elif repeat:
                    fault = "duplicate"
                else:
                    fault = "truncated" if cut_off.search(text) else ""
                initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
                if fault:
                    held[fault] += 1
                held["codes"].append("." if fault in ("blank", "duplicate") else CUT[initial] if fault else initial)
                if held["ends"] is not None and held["ends"][1] + initial not in ("su", "ua", "au"):
                    held["illegal"] += 1
                held["ends"] = (held["ends"][0] if held["ends"] else initial, initial)
                if has:
                    held["distinct"] += held["turns"] is None or held["turns"][1] != turn
                    held["turns"] = (held["turns"][0] if held["turns"] else turn, turn)
                held["chars"] += len(text)
                out.append((conv, number, len(held["codes"]) - 1, role, text, None))
                prior = (has, turn, sig)
                if len(out) >= 2000:
                    yield pd.DataFrame(out, columns=NAMES)
                    out.clear()
        if held is not None:
            close()
        yield pd.DataFrame(out, columns=NAMES)

    return run


NAMES = [c.split()[0] for c in PIECES.split(", ")]


def _planned(facts: DataFrame) -> DataFrame:
    """(conv, piece, plan): the facts of the pieces with the state in front, the costs behind, and whether no piece follows."""

    def backward(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, costs = None, END
        for rows in batches:
            out = []
            for key, plan in zip(rows["conv"], rows["plan"], strict=True):
                piece = json.loads(plan)
                last = key != conv
                conv, costs = key, END if last else costs
                out.append(json.dumps(piece | {"last": last, "end": costs}))
                if "matrix" in piece:
                    costs = tuple(min(column[s] + costs[t] for t, column in enumerate(piece["matrix"])) for s in range(4))
            yield rows.assign(plan=out)

    def walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for plan in rows["plan"]:
                piece = json.loads(plan)
                piece.pop("matrix", None)
                ways = [walk(piece["codes"], s, tuple(piece["end"]), piece["last"]) for s in (range(4) if piece["opens"] else (0,))]
                out.append(json.dumps(piece | {"ways": ways}))
            yield rows.assign(plan=out)

    shape = facts.schema
    spread = facts.repartition("conv").sortWithinPartitions("conv", F.desc("piece")).mapInPandas(backward, shape)
    return spread.repartition("piece").mapInPandas(walked, shape)


DIGEST = ("conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a conversation, from its pieces in order: the facts of a piece come before its turns."""
    conv, total, out, ready = None, None, [], []
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def done() -> None:
        low, high = total["turns"] or (0, -1)
        line = total["sha"].hexdigest()
        gaps = high - low + 1 - total["distinct"] if total["turns"] else 0
        out.append((conv, gaps, total["blank"], total["duplicate"], total["truncated"], total["illegal"], total["cost"], "".join(total["audit"]), line))

    def say(line: str) -> None:
        total["sha"].update((("\n" if total["lines"] else "") + line).encode("utf-8", "surrogatepass"))
        total["lines"] += 1

    def inserted(edits: list[str]) -> None:
        while edits and edits[-1] == "I":
            edits.pop()
            total["at"] = EXPECTED[total["at"]]
            say(ROLE[total["at"]] + ":")

    for rows in batches:
        for key, _, at, role, text, plan in zip(*(rows[c] for c in NAMES), strict=True):
            if key != conv:
                if conv is not None:
                    inserted(ready)
                    done()
                conv, ready = key, []
                total = {"sha": hashlib.sha256(), "lines": 0, "state": 0, "at": 0, "cost": 0, "audit": [], "turns": None, "distinct": 0, "tail": None, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
            if at == -2:
                continue
            if at == -1:
                inserted(ready)
                piece = json.loads(plan)
                audit, behind, cost = piece["ways"][total["state"] if len(piece["ways"]) > 1 else 0]
                ready = list(reversed(audit))
                total["audit"].append(audit)
                total["cost"] += cost
                for c in ("blank", "duplicate", "truncated", "illegal", "distinct"):
                    total[c] += piece[c]
                if total["tail"] is not None and total["tail"] + piece["head"] not in ("su", "ua", "au"):
                    total["illegal"] += 1
                if piece["turns"]:
                    total["distinct"] -= total["turns"] is not None and total["turns"][1] == piece["turns"][0]
                    total["turns"] = (total["turns"][0] if total["turns"] else piece["turns"][0], piece["turns"][1])
                total["tail"], total["state"] = piece["tail"], behind
                continue
            inserted(ready)
            edit = ready.pop()
            if edit == "K":
                total["at"] = AFTER[role[:1]][total["at"]]
                say(f"{role}:{text}")
            elif edit == "R":
                total["at"] = EXPECTED[total["at"]]
                say(f"{ROLE[total['at']]}:{text}")
        yield pd.DataFrame(out, columns=names)
        out.clear()
    if conv is not None:
        inserted(ready)
        done()
    yield pd.DataFrame(out, columns=names)


def repaired(rows: DataFrame, conversations: DataFrame | None = None, most: int = 10_000, most_chars: int = 64 << 20) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of rows (conv_id, turn, role, text, copy).

    A conversation of `conversations` without rows has an empty repair. `most`, `most_chars`: turns and characters of a piece.
    """
    kind = rows.schema["conv_id"].dataType
    turns = cut(_ordered(rows).select("conv", "has", "turn", "sig", "role", "text", "again").mapInPandas(_pieces(most, most_chars), PIECES), "turns")
    plans = _planned(turns.where("at = -1"))
    key = F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-"))
    named = (rows if conversations is None else conversations).select(key.alias("conv")).distinct()
    blank = named.select("conv", F.lit(-1).cast("long").alias("piece"), F.lit(-2).cast("long").alias("at"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(None).cast("string").alias("plan"))
    whole = turns.where("at >= 0").unionByName(plans).unionByName(blank)
    out = whole.repartition("conv").sortWithinPartitions("conv", "piece", "at").mapInPandas(_hashed, DIGEST)
    conv = F.when(F.col("conv") != "-", F.substring("conv", 2, 1 << 30)).cast(kind).alias("conv_id")
    return out.select(conv, *[c for c in out.columns if c != "conv"])


def digest(rows: DataFrame) -> DataFrame:
    """The repair of `rows` after the damage that the query deals."""
    return repaired(damaged(rows), rows)


ORACLE_SQL = r"""
WITH RECURSIVE base AS (SELECT coalesce('+' || conv_id, '-') AS k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '') AS key FROM conversations),
summed AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(key, lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 20 AS hit FROM base),
hurt AS (SELECT k, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN hit = 1 THEN '' WHEN hit = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM summed WHERE hit <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, md5(role || ':' || text), copy) AS i, role[1] AS ini FROM hurt),
seq AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 'd'
  WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY k ORDER BY i) AS prior FROM placed),
size AS (SELECT k, count(*) AS n, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
  count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM seq GROUP BY k),
back AS (SELECT k, n + 1 AS i, 0::BIGINT AS f0, 4::BIGINT AS f1, 2::BIGINT AS f2, 0::BIGINT AS f3 FROM size
  UNION ALL SELECT k, i, least(n0, 2 + n2, 4 + n3), least(n1, 2 + n2, 4 + n3), least(n2, 2 + n3), least(n3, 2 + n2) FROM (SELECT s.k, s.i,
    least(3 + f0, CASE WHEN stay THEN 2 + cut + f2 END, CASE WHEN stay AND ini = 's' THEN cut + f1 WHEN stay AND ini = 'u' THEN cut + f2 END) AS n0,
    least(3 + f1, CASE WHEN stay THEN 2 + cut + f2 END, CASE WHEN stay AND ini = 'u' THEN cut + f2 END) AS n1,
    least(3 + f2, CASE WHEN stay THEN 2 + cut + f3 END, CASE WHEN stay AND ini = 'a' THEN cut + f3 END) AS n2,
    least(3 + f3, CASE WHEN stay THEN 2 + cut + f2 END, CASE WHEN stay AND ini = 'u' THEN cut + f2 END) AS n3
    FROM back JOIN (SELECT *, fault NOT IN ('b', 'd') AS stay, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cut FROM seq) AS s ON s.k = back.k AND s.i = back.i - 1)),
cost AS MATERIALIZED (SELECT k, i, [f0, f1, f2, f3] AS f FROM back),
walk AS (SELECT k, 1::BIGINT AS i, 0 AS s, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM size
  UNION ALL SELECT k, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN s WHEN e = 'K' THEN own ELSE want END, audit || e,
    CASE WHEN e = 'D' THEN said ELSE list_append(said, CASE WHEN e = 'K' THEN role ELSE CASE WHEN want = 2 THEN 'user' ELSE 'assistant' END END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END) END
    FROM (SELECT *, CASE WHEN f[s + 1] = 3 + g[s + 1] THEN 'D' WHEN f[s + 1] = 2 + f[want + 1] THEN 'I' WHEN stay AND f[s + 1] = cut + g[own + 1] THEN 'K' ELSE 'R' END AS e
      FROM (SELECT w.*, a.f, b.f AS g, q.role, q.text, [2, 2, 3, 2][w.s + 1] AS want, q.fault NOT IN ('b', 'd') AS stay, CASE WHEN q.fault = 't' THEN 1 ELSE 0 END AS cut,
        CASE WHEN q.ini = 's' AND w.s = 0 THEN 1 WHEN q.ini = 'u' AND w.s <> 2 THEN 2 WHEN q.ini = 'a' AND w.s = 2 THEN 3 END AS own
        FROM walk AS w JOIN cost AS a ON a.k = w.k AND a.i = w.i LEFT JOIN cost AS b ON b.k = w.k AND b.i = w.i + 1 LEFT JOIN seq AS q ON q.k = w.k AND q.i = w.i
        WHERE q.k IS NOT NULL OR w.s IN (1, 2)))),
done AS (SELECT w.k, size.* EXCLUDE (k, n), c.f[1] AS cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
  FROM walk AS w JOIN size ON size.k = w.k AND w.i = n + 1 AND s IN (0, 3) JOIN cost AS c ON c.k = w.k AND c.i = 1),
named AS (SELECT DISTINCT conv_id, coalesce('+' || conv_id, '-') AS k FROM conversations)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256 FROM named LEFT JOIN done USING (k)"""
