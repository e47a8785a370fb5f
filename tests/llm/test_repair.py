"""Conversation repair against exhaustive search and plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quern.llm import queries, repair

SIGNS = "suaxSUA?!"


def cheapest(signature):
    """(cost, audit) by trying all edits, two insertions in a row at most: more can't help."""
    best = None

    def go(k, state, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if k == len(signature) and state in repair.ENDS and (best is None or (cost, audit) < best):
            best = cost, audit
        if inserted < 2:
            for r in "ua":
                if r in repair.NEXT[state]:
                    go(k, repair.NEXT[state][r], cost + 5, audit + "I", inserted + 1)
        if k < len(signature):
            sign = signature[k]
            go(k + 1, state, cost + 2, audit + "D", 0)
            late = 5 if sign in "SUA!" else 0
            if sign != "x" and sign.lower() in repair.NEXT[state]:
                go(k + 1, repair.NEXT[state][sign.lower()], cost + late, audit + "K", 0)
            for r in "ua" if sign != "x" else "":
                if r in repair.NEXT[state]:
                    go(k + 1, repair.NEXT[state][r], cost + late + 1, audit + "R", 0)

    go(0, 0, 0, "", 0)
    return best


def test_audits_are_the_cheapest():
    r = random.Random(5)
    given = {"".join(p) for n in range(4) for p in itertools.product(SIGNS, repeat=n)} | {"".join(r.choice("uauas" + SIGNS) for _ in range(r.randrange(4, 10))) for _ in range(300)}
    for signature, cost, audit in repair.answers(sorted(given)):
        assert (cost, audit) == cheapest(signature), signature


def test_order_of_signatures_changes_nothing():
    r = random.Random(6)
    given = ["".join(r.choice(SIGNS) for _ in range(r.randrange(30))) for _ in range(200)]
    assert dict((s, (c, a)) for s, c, a in repair.answers(given)) == dict((s, (c, a)) for s, c, a in repair.answers(sorted(given)))


def test_layers_are_few():
    """However long conversations are, layers repeat: a long signature is walked by what short ones have left."""
    r = random.Random(7)
    long = "".join(r.choice(SIGNS) for _ in range(200_000))
    ((_, cost, audit),) = repair.answers([long])
    assert len(audit) - audit.count("I") == len(long) and repair.layer_after.cache_info().currsize < 2000
    assert cost == 2 * audit.count("D") + audit.count("R") + 5 * audit.count("I") + 5 * sum(e != "D" and s in "SUA!" for e, s in zip(audit.replace("I", ""), long, strict=True))


def plainly(turns):
    """conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha256), one row after the other."""
    out, convs = {}, {}
    for conv, turn, role, text in turns:
        rows = convs.setdefault(conv, [])
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        rows += [(turn, "user" if way == 4 else role, text)] * {0: 0, 3: 2}.get(way, 1)
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        seen, signs, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            body = text.strip(" \t\n\r\x0b\x0c")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            own = role[:1] if role[:1] and role[:1] in "sua" else "?"
            signs += "x" if fault in ("blank", "duplicate") else own if not fault else "!" if own == "?" else own.upper()
            if fault:
                counts[fault] += 1
        cost, audit = cheapest(signs)
        numbers = {r[0] for r in rows} - {None}
        left, at = [], 0
        odd = sum(e != "D" for e in audit) % 2
        for e in audit:
            if e == "I":
                left.append((None, ""))
            else:
                if e != "D":
                    left.append((rows[at][1] if e == "K" else None, rows[at][2]))
                at += 1
        shown = "\n".join(f"{role if role is not None else ('user', 'assistant')[(k - odd) % 2]}:{text}" for k, (role, text) in enumerate(left))
        pairs = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        out[conv] = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *counts.values(), pairs, cost, audit, hashlib.sha256(shown.encode()).hexdigest())
    return out


def test_repair_plainly(spark, tmp_path):
    r = random.Random(8)
    turns = [(c if c else None, t if r.random() > 0.1 else None, r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), r.choice(["Yes.", "No", "", None, " \n", "Why? ", "größer!", "a b c"])) for c in range(60) for t in range(r.randrange(1, 8)) for _ in range(r.choice([1, 1, 1, 2]))]
    spark.createDataFrame([(*t, 1, "x", None, 2) for t in turns], "conv_id bigint, turn bigint, role string, text string, tie int, signature string, sign string, part int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {x.conv_id: tuple(x)[1:] for x in queries.op11_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == plainly(turns)


@pytest.mark.parametrize("n", [0, 20_000])
def test_empty_and_long(spark, tmp_path, n):
    """A conversation of 20,000 turns is repaired whole; an empty table gives no rows."""
    from pyspark.sql import functions as F

    rows = spark.range(n).select(F.lit(7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Text "), "id", F.lit(".")).alias("text"))
    report, left = repair.repair(rows)
    assert [(x.gaps, x.cost, x.audit) for x in report.collect()] == ([(0, 0, "K" * n)] if n else [])
    assert left.count() == n
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_conversation_repair(spark, str(tmp_path)).count() == (1 if n else 0)
