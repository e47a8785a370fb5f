"""Look-ahead chunks with cuts, free rows and parents against a plain walk over whole lists."""

import random

import pytest

from quern.operators import sequences


def walked(rows, window, cut, free, within):
    """rows: (defines, uses, cut, free, parent); chunk numbers in order."""
    chunk, out, number, i = [], [], 0, 0
    related = lambda k: any(set(rows[c][0]) & set(rows[k][1]) for c in chunk)
    while i < len(rows):
        if chunk and not (cut and rows[i][2]) and related(i):
            taken = [i]
        elif chunk and not (cut and rows[i][2]):
            seen, j, left = [], i, window
            while j < len(rows) and (left > 0 or free and rows[j][3]) and not (within and rows[j][4] != rows[chunk[0]][4]):
                seen.append(j)
                left -= not (free and rows[j][3])
                j += 1
            hits = [k for k in seen if related(k)]
            taken = list(range(i, hits[-1] + 1)) if hits else None
        else:
            taken = [i] if not chunk else None
        if taken is None:
            chunk, number = [], number + 1
            continue
        chunk += taken
        out += [number] * len(taken)
        i = taken[-1] + 1
    return out


@pytest.mark.parametrize("window", [0, 1, 2, 4])
@pytest.mark.parametrize("options", [(), ("cut",), ("free",), ("cut", "free", "within")])
def test_chunks(spark, window, options):
    r = random.Random(window)
    some = lambda: [x for x in "abcdef" if r.random() < 0.15]
    keys = {k: [(some(), some(), r.random() < 0.1, r.random() < 0.3, r.choice([None, 1, 1, 1, 2])) for _ in range(60)] for k in range(4)}
    rows = [(k, n, *x) for k, xs in keys.items() for n, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "k int, n int, d array<string>, u array<string>, cut boolean, free boolean, within int")
    got = sequences.look_ahead_chunks(df, ["k"], ["n"], "d", "u", window, **{o: o for o in options})
    want = {(k, n): c for k, xs in keys.items() for n, c in enumerate(walked(xs, window, *(o in options for o in ("cut", "free", "within"))))}
    assert {(x.k, x.n): x.chunk for x in got.collect()} == want
