"""Line frequency, vector codes and conversation repair: brute force, odd rows, workers without the package."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

from netloom.llm import dialogue, linefreq, ngram_join, veccodes

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"

# --- conversation repair -------------------------------------------------------------------------------------------------


def brute_repair(rows):
    """rows (turn, role, text) in order: the contract's columns by trying all edits, least (cost, audit) for each place and state."""
    faults, seen = [], set()
    for _, role, text in rows:
        said = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {(0, 0): (0, "", ())}
    todo = [(0, "", (), 0, 0)]
    while todo:
        todo.sort()
        cost, audit, out, i, s = todo.pop(0)
        if best.get((i, s), (cost, audit, out))[:2] < (cost, audit):
            continue
        ways = [(2, "I", nxt[s, r[0]], i, f"{r}:") for r in ("user", "assistant") if (s, r[0]) in nxt]
        if i < len(rows):
            _, role, text = rows[i]
            ways.append((3, "D", s, i + 1, None))
            if faults[i] not in ("b", "d"):
                extra = faults[i] == "t"
                if (s, role[:1]) in nxt:
                    ways.append((extra, "K", nxt[s, role[:1]], i + 1, f"{role}:{text}"))
                ways += [(2 + extra, "R", nxt[s, r[0]], i + 1, f"{r}:{text}") for r in ("user", "assistant") if (s, r[0]) in nxt]
        for price, edit, state, at, line in ways:
            new = (cost + price, audit + edit, out + ((line,) if line is not None else ()))
            if (at, state) not in best or new[:2] < best[at, state][:2]:
                best[at, state] = new
                todo.append((*new, at, state))
    cost, audit, out = min(best[k] for k in ((len(rows), 0), (len(rows), 3)) if k in best)
    turns = [t for t, _, _ in rows if t is not None]
    heads = [r[:1] for _, r, _ in rows]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:], strict=False)), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def in_order(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{r[1]}:{r[2]}".encode()).hexdigest())
    return sorted(rows, key=key)


@pytest.mark.parametrize("most", [1, 3, 10_000])
def test_repair_equals_trying_all_edits_whole_and_in_pieces(spark, most):
    rng = random.Random(most)
    said = ["Yes.", "No!", "", " \t", "well", "so?", "x. ", "é\x85"]
    roles = ["user", "assistant", "system", "tool", "", "ursula"]
    rows = []
    for conv in [None, 2**60 + 1, *range(30)]:
        rows += [(conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(said), 0) for _ in range(rng.randrange(1, 14))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copy int").repartition(5)
    got = {r["conv_id"]: r.asDict() for r in dialogue.repaired(df, most=most).collect()}
    assert len(got) == len({r[0] for r in rows})
    for conv, found in got.items():
        want = brute_repair(in_order([r[1:4] for r in rows if r[0] == conv]))
        assert {k: found[k] for k in want} == want


def test_repair_of_damage_follows_the_contract_and_keeps_lost_conversations(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Turn {t} of {c}.") for c in range(60) for t in range(3)] + [(None, None, None, None), (7, 3, None, None)]
    hit = lambda c, t: zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    want = {}
    for c, t, role, text in rows:
        role, text, h, kept = role or " ", text or " ", hit(c, t), want.setdefault(c, [])
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        kept += [(t, "user" if h == 4 else role, text)] * (0 if h == 0 else 2 if h == 3 else 1)
    clashing = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copy int, sig string")
    got = {r["conv_id"]: r.asDict() for r in dialogue.digest(clashing).collect()}
    assert set(got) == set(want)
    for conv, found in got.items():
        expected = brute_repair(in_order(want[conv]))
        assert {k: found[k] for k in expected} == expected
    lost = [(c, 0, "user", "a.") for c in range(500) if hit(c, 0) == 0][:1]
    row = dialogue.digest(spark.createDataFrame(lost, "conv_id long, turn long, role string, text string")).first()
    assert (row["cost"], row["audit"], row["repaired_sha256"]) == (0, "", hashlib.sha256(b"").hexdigest())
    assert dialogue.digest(clashing.limit(0)).count() == 0


def test_repair_streams_one_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"n{t}." + "x" * (200_000 if t == 11 else 0), 0) for t in range(4001)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, copy int")
    found = dialogue.repaired(df, most=100, most_chars=10_000).first()
    want = brute_repair([r[1:4] for r in rows[-31:]])
    assert found["truncated"] == 1 and found["cost"] == want["cost"] + 1 and len(found["audit"]) >= 4001


# --- vector codes --------------------------------------------------------------------------------------------------------


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """(code, error) of (vec_id, vector) rows, with unbounded integers."""
    fit = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dims = -(-max((len(v) for _, v in fit), default=0) // parts) * parts
    whole = [[(math.floor(x * 1024) if abs(x) < 1e200 else int(x) * 1024) for x in v] + [0] * (dims - len(v)) for _, v in fit]
    size = dims // parts
    order = sorted(range(len(fit)), key=lambda j: (fit[j][0] is None, fit[j][0] or 0, fit[j][1]))[:entries]
    books = [[whole[j][p * size : (p + 1) * size] for j in order] for p in range(parts)]
    near = lambda q, book: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for w in whole:
                groups.setdefault(near(w[p * size : (p + 1) * size], book)[1], []).append(w[p * size : (p + 1) * size])
            books[p] = [[sum(c) // len(c) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(book)]
    out = []
    for (i, _), w in zip(fit, whole, strict=True):
        found = [near(w[p * size : (p + 1) * size], book) for p, book in enumerate(books)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), min(sum(d for d, _ in found), 2**63 - 1)))
    return out, ",".join(str(x) for b in books for e in b for x in e)


@pytest.mark.parametrize("kind", ["plain", "coarse", "large", "odd lengths"])
def test_codes_equal_a_full_search(spark, kind):
    rng = random.Random(kind)
    draw = {"plain": lambda: rng.gauss(0, 0.4), "coarse": lambda: rng.choice([-0.5, 0.0, 0.001, 0.5]), "large": lambda: rng.choice([1e30, -3e7, 0.25, 1e300, 5.0]), "odd lengths": lambda: rng.gauss(0, 1)}[kind]
    n = 40 if kind == "large" else 330
    rows = [(2**60 + 1 - i, [draw() for _ in range(rng.choice([0, 3, 9]) if kind == "odd lengths" else 16)]) for i in range(n)]
    rows += [(None, [draw() for _ in range(8)]), (5, None), (6, [1.0, None]), (7, [float("nan")] * 16), (8, [float("-inf")] * 16), rows[0], (rows[0][0], [draw() for _ in range(4)])]
    df = spark.createDataFrame([(i, v, j % 3 if j % 4 else None, "x") for j, (i, v) in enumerate(rows)], "vec_id long, embedding array<double>, label int, held string").repartition(4)
    got = veccodes.digest(df).collect()
    want, text = brute_codes(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([(r["vec_id"], r["code"], r["error"]) for r in got], key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(text.encode()).hexdigest()}
    errors = Counter()
    labels = [j % 3 if j % 4 else None for j in range(len(rows))]
    fit = [j for j, (_, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for j, (_, _, e) in zip(fit, want, strict=True):
        errors[labels[j]] += e
    assert {r["label_error"] for r in got} == {min(e, 2**63 - 1) for e in errors.values()}


def test_bounds_never_pass_the_distance():
    rng = np.random.default_rng(3)
    entries, q = rng.integers(-900, 900, (256, 16)), rng.integers(-900, 900, (500, 16))
    exact = ((q[:, None] - entries[None]) ** 2).sum(axis=2)
    for n in veccodes.Codebook.shapes(16):
        (mean, rest), (means, rests) = veccodes.Codebook.blocks(q, n), veccodes.Codebook.blocks(entries, n)
        bound = ((mean[:, None] - means[None]) ** 2).sum(axis=2) + ((rest[:, None] - rests[None]) ** 2).sum(axis=2)
        assert (bound <= exact * (1 + 1e-9) + 1e-6).all()
    code, far = veccodes.Codebook(entries).nearest(q)
    assert (code == exact.argmin(axis=1)).all() and (far == exact.min(axis=1)).all()


def test_codes_of_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert veccodes.digest(empty).count() == 0
    nothing = veccodes.digest(spark.createDataFrame([(1, [], 2), (2, None, 2)], "vec_id long, embedding array<float>, label int")).collect()
    assert [(r["vec_id"], r["code"], r["error"], r["label_error"]) for r in nothing] == [(1, "00000000", 0, 0)]


# --- line frequency ------------------------------------------------------------------------------------------------------


def brute_lines(rows, most=10, share=50, least=10):
    blank = " \t\n\x0b\x0c\r"
    norm = lambda x: re.sub("[1-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(f"[{blank}]+", " ", x.strip(blank))))
    holders = {}
    for doc, source, text in rows:
        for line in (text or "").split("\n"):
            if len(norm(line)) >= least:
                holders.setdefault((source, norm(line)), set()).add((source, text) if doc is None else doc)
    out = []
    for doc, source, text in rows:
        text = text or ""
        w = re.findall(f"[^{blank}]+", text)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.strip(blank)]
        gone = [x for x in lines if len(holders.get((source, norm(x)), ())) > most]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        left = len(w) - sum(len(norm(x).split(" ")) for x in gone)
        out.append((doc, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed, not failed and 100 * left >= share * len(w)))
    return out


def test_line_rules_equal_brute_force_on_odd_rows(spark):
    rng = random.Random(1)
    shared = ["Cookie  settings\tand 12 terms", "cookie settings and 99 terms ", "all rights reserved by us", "short", "É x und   so weiter hier"]
    rows = []
    for i in range(60):
        own = [" ".join(rng.choice("abcdefg") + rng.choice(["", "x", "<#>"]) + str(rng.randrange(30)) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 5))]
        rows.append((2**60 + i if i % 9 else None, rng.choice(["a", "a", "b", None]), "\n".join(own + rng.choices(shared, k=rng.randrange(4)) + ["", " \x0b"])))
    rows += [(1, "a", None), (2, "a", ""), (3, "b", "w " * 30_000), rows[5], rows[5], (4, "a", " ".join("a b c d".split() * 20))]
    rows += [(100 + i, "h", "the same long line of all these documents " * 8 + "\nown words " + str(i)) for i in range(12)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, text string, mark int, key int").repartition(6)
    got = [tuple(r) for r in linefreq.digest(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(got, key=key) == sorted(brute_lines(rows), key=key)
    assert not any(r[-1] for r in got if r[0] is not None and 100 <= r[0] < 112) and linefreq.digest(df.limit(0)).count() == 0


def test_cleaned_texts_lose_the_lines_over_the_limit(spark):
    body = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "h", f"Home 12 About\n{body} {i} x\nHome 7 about") for i in range(11)] + [(50, "other", f"Home 3 About\n{body}")]
    clean = {r["doc_id"]: r["text"] for r in linefreq.cleaned(spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, source string, text string, _mark string")).collect()}
    assert clean[3] == f"{body} 3 x" and clean[50] == rows[-1][2]


# --- workers without the package -----------------------------------------------------------------------------------------

BARE = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
probe = lambda it: (__import__("importlib.util").util.find_spec("netloom") is not None for _ in it)
assert not any(spark.sparkContext.parallelize([1], 1).mapPartitions(probe).collect()), "the workers have the package"
import __spark_entry__
for name in sys.argv[1:]:
    print(name, __spark_entry__.queries()[name](spark, {SF!r}).count())
"""


def test_queries_run_on_workers_without_the_package(tmp_path):
    names = ["op7_ngram_join", "op11_line_frequency", "op12_vector_codes", "op13_conversation_repair"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", BARE, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert dict(line.split() for line in done.stdout.splitlines()) == {"op7_ngram_join": "200", "op11_line_frequency": "200", "op12_vector_codes": "500", "op13_conversation_repair": str(CONVERSATIONS)}


CONVERSATIONS = len(set(__import__("pyarrow.parquet").parquet.read_table(f"{SF}/conversations.parquet")["conv_id"].to_pylist()))


def test_signatures_and_texts_are_not_shuffled_again(spark, monkeypatch):
    plans, cut = {}, ngram_join.cut

    def seen(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, label)

    monkeypatch.setattr(ngram_join, "cut", seen)
    ngram_join.similar_components(spark.read.parquet(f"{SF}/documents.parquet")).count()
    dealt = [p for found in plans.values() for p in found if "explode(sigs" in p]
    assert len(dealt) == 1 and dealt[0].count("explode(sigs") == 1 and dealt[0].count("Exchange hashpartitioning") == 1
    assert all("ArrowEvalPython" in p for p in plans["pool"] + plans["chosen"])


def test_rows_among_ids(spark):
    rows = spark.range(-500, 500).selectExpr("id * 9007199254740993 as id", "repeat('x', 20) as text")
    ids = rows.where("abs(id % 7) = 3").select("id")
    want = sorted(r.id for r in ids.collect())
    for bits in (64, 1 << 12, 1 << 26):  # 64 bits are all set
        assert sorted(r.id for r in ngram_join._among(rows, ids.union(ids), bits).collect()) == want
    assert ngram_join._among(rows, ids.limit(0)).count() == 0
