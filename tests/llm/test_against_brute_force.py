"""Operators against plain versions of what they compute."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import decontaminate, jaccard_join, language_id, line_templates, mixing, order_minhash, pii, queries, sharding, token_counts, wordhash

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_word_hashes():
    for text in ("", " ", "a", "A b\tÜ  b\x0bcc\n", "x" * 70_000 + " y x"):
        words = WORDS.findall(lower(text))
        hashes = wordhash.hash_words(np.frombuffer(text.encode(), np.uint8))
        assert len(hashes) == len(words) and len(set(hashes.tolist())) == len(set(words))
        assert [words.index(w) for w in words] == [hashes.tolist().index(h) for h in hashes.tolist()]


def components(texts, percent=75):
    sets = {}
    for i, t in texts.items():
        w = WORDS.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(seed, groups=8, each=25):
    """Groups of copies with few, some and many words changed, so that links chain and break near the threshold; one group over all short lists."""
    r = random.Random(seed)
    out = {}
    for g in range(groups):
        base = [f"w{r.randrange(60)}" for _ in range(r.choice([3, 8, 40, 120]))]
        for _ in range(each * (4 if g == 0 else 1)):
            words = list(base)
            for _ in range(r.randrange(0, max(1, len(words) // 12) + 1)):
                words[r.randrange(len(words))] = f"n{r.randrange(500)}"
            out[len(out) * 3 + 1] = " ".join(words)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_groups(spark, seed):
    given = copies(seed)
    df = spark.createDataFrame(list(given.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df).collect()}
    assert got == components(given)


def test_jaccard_blocks(spark, monkeypatch):
    """Groups over the size limit, dealt into blocks, lose no link."""
    monkeypatch.setattr(jaccard_join, "GROUP_DOCS", 10)
    given = copies(3, groups=3)
    df = spark.createDataFrame(list(given.items()), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(df).collect()} == components(given)


def test_jaccard_of_shared_ids(spark):
    """Different texts with one doc_id keep their own links."""
    text = lambda k, side, end: " ".join(f"{side}{k}x{j}" for j in range(40)) + f" {end}"
    rows = [(k, text(k, side, "one")) for k in range(12) for side in "ab"] + [(100 * (1 + at) + k, text(k, side, "two")) for k in range(12) for at, side in enumerate("ab")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.component_id) for r in jaccard_join.jaccard_groups(df).collect())
    assert got == sorted((i, i % 100) for i, _ in rows)


def test_jaccard_on_documents(docs, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs).collect()} == components(texts)


def test_mix_by_brute_force(docs, texts):
    rows = mixing.mix(docs).collect()
    sizes = {r.doc_id: len(WORDS.findall(texts[r.doc_id])) for r in rows}
    assert all(r.size == sizes[r.doc_id] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    names = sorted(by)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, held = sum(sizes.values()), {s: sum(r.size for r in by[s]) for s in names}
    target, open_ = {}, set(names)
    while True:  # fill by weight until none is above three times its size
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * held[s]}
        if not over:
            target |= share
            break
        target |= {s: 3 * held[s] for s in over}
        open_ -= over
    for s in names:
        assert by[s][0].target == pytest.approx(target[s])
        assert sum(r.taken for r in by[s]) == int(by[s][0].target)
    assert all(r.taken <= 3 * r.size for r in rows)


def test_mix_caps(spark):
    rows = [(k, " ".join("w" * 1 for _ in range(n)), s) for k, (n, s) in enumerate([(2, "a"), (1, "b"), (1, "c"), (500, "d")])]
    got = {r.source: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert (got["b"].target, got["c"].target) == (3.0, 3.0) and got["a"].target == 6.0 and got["d"].target == 492.0


def test_shards_law(docs):
    rows = sharding.assign_shards(docs, 16).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    share = Counter((r.shard, r.source) for r in rows)
    n = Counter(r.source for r in rows)
    assert all(abs(share[s, x] - n[x] / 16) <= 1.001 for s in by for x in n)
    again = sharding.assign_shards(docs.repartition(5), 16).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_sharded_keeps_rows(docs):
    twice = docs.union(docs.limit(7))
    out = sharding.sharded(twice).collect()
    assert len(out) == len({(r.shard, r.slot) for r in out}) == twice.count()


def fingerprint(text, k=3, size=2, kept=64):
    """Order MinHash from start to end: occurrence numbers, the least hashes, tuples in text order."""
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    one = lambda x, width, seed: xxhash.xxh64_intdigest((x & (1 << 8 * width) - 1).to_bytes(width, "little"), seed)

    def chain(*longs):
        seed = 42
        for x in longs:
            seed = one(x, 8, seed)
        return seed

    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORDS.findall(text)]
    seen, numbered = Counter(), []
    for i in range(len(words)):
        kmer = signed(chain(*words[i : i + k])) >> 32
        numbered.append((signed(one(seen[kmer], 4, one(kmer, 8, 42))) >> 32, i))
        seen[kmer] += 1
    least = sorted(numbered)[: kept + size - 1]
    tuples = [sorted(least[j : j + size], key=lambda x: x[1]) for j in range(max(min(kept, len(least) - size + 1), min(1, len(least))))]
    return sorted({signed(chain(*[h & 0xFFFFFFFF for h, _ in t])) >> 32 for t in tuples})


def test_order_minhash_by_brute_force(spark, docs, texts):
    """Every fingerprint and likeness of whole and edited texts, exactly."""
    extra = [(90_001, "a b c a b c a b c d e f g", None, None, 0), (90_002, "", None, None, 0), (90_003, None, None, None, 0), (90_004, "x", None, None, 0), (90_005, "y y y y y", None, None, 0)]
    both = docs.union(spark.createDataFrame(extra, docs.schema))
    texts = texts | {r[0]: r[1] or "" for r in extra}
    ids = sorted(texts, reverse=True)
    rows = {r.doc_id: r for r in order_minhash.compared(both).collect()}
    near = lambda a, b: 2 * len({*a} & {*b}) / (len(a) + len(b)) if a or b else 1.0
    shown = lambda f: "".join(f"{x & 0xFFFFFFFF:08x}" for x in f)
    own = {i: fingerprint(t) for i, t in texts.items()}
    for k, i in enumerate(ids):
        t, after = texts[i], ids[(k + 1) % len(ids)]
        cut = len(t) // 3
        edited = t[: len(t) - cut] + texts[after][:cut]
        changed = fingerprint(edited)
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (shown(own[i]), shown(changed))
        assert (rows[i].near_edited, rows[i].near_next) == pytest.approx((near(own[i], changed), near(own[i], own[after])))


def test_next_rows_of_any_ids(spark):
    """Strings, nulls and shared ids: one cycle through all rows, ids descending, the same with few and many ranges."""
    rows = [(f"id{k % 40:03}" if k % 5 else None, f"text {k} " * 3) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    out = [(r.doc_id, r.text, r.next_text) for r in order_minhash.with_next(docs, ["text"]).collect()]
    after = {t: n for _, t, n in out}
    assert len(out) == 200 and len(after) == 200
    at, order = rows[0][1], []
    for _ in range(200):
        order.append(at)
        at = after[at]
    assert at == rows[0][1] and len(set(order)) == 200
    ids = {t: i for i, t in rows}
    begin = next(k for k in range(200) if ids[order[k - 1]] is None and ids[order[k]] is not None)
    turned = [ids[t] for t in order[begin:] + order[:begin]]
    assert turned == sorted([x for x in turned if x], reverse=True) + [None] * 40


def test_order_minhash_properties(spark, docs, texts):
    rows = {r.doc_id: r for r in order_minhash.compared(docs).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[(k + 1) % len(ids)]]
        c = len(t) // 3
        assert rows[i].edited_sha256 == hashlib.sha256((t[: len(t) - c] + n[:c]).encode()).hexdigest() and rows[i].n_chars == len(t)
    by_text = defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(rows[i].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    mean = lambda c: np.mean([r[c] for r in rows.values()])
    assert mean("near_edited") > 0.2 > 0.05 > mean("near_next")


def test_order_minhash_steps(spark):
    """Likeness falls with the edit distance, not with the bag of words."""
    near = lambda a, b: spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string").transform(order_minhash.fingerprints).groupBy().pivot("doc_id", [1, 2]).agg(F.first("fingerprint")).select(order_minhash.likeness(F.col("1"), F.col("2"))).first()[0]
    base = [f"w{k}" for k in range(300)]
    moved, dropped = base[150:] + base[:150], base[:-1]
    rotated = [w for k in range(0, 300, 10) for w in reversed(base[k : k + 10])]
    assert near(" ".join(base), " ".join(base)) == 1.0
    assert near(" ".join(base), " ".join(dropped)) > near(" ".join(base), " ".join(moved)) > near(" ".join(base), " ".join(rotated))
    assert near("x " * 5, "x " * 50) < 1.0  # repeats count


def greedy(unit, pieces):
    n = i = 0
    while i < len(unit):
        j = len(unit)
        while j > i + 1 and unit[i:j] not in pieces:
            j -= 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("seed", range(20))
def test_automaton(seed):
    r = random.Random(seed)
    pieces = {bytes(r.choice(b"abc") for _ in range(r.randrange(1, 6))) for _ in range(12)} | (set() if seed % 2 else {b"a", b"b", b"c"})
    automaton = token_counts.Automaton(sorted(pieces))
    for _ in range(300):
        unit = bytes(r.choice(b"abcd") for _ in range(r.randrange(0, 14)))
        assert automaton.count(unit) == greedy(unit, pieces), (unit, pieces)


def test_units_cover_the_text(texts, monkeypatch):
    whole = {i: [u for some in token_counts.units(t.encode()) for u in some] for i, t in texts.items()}
    assert all(b"".join(u) == texts[i].encode() for i, u in whole.items())
    monkeypatch.setattr(token_counts, "BLOCK", 100)
    assert all([u for some in token_counts.units(texts[i].encode()) for u in some] == u for i, u in whole.items())


def plain_templates(text, least=5):
    for k, line in enumerate(text.split("\n")):
        tokens = ["*" if re.search(r"[0-9@/\\]", w) else lower(w) for w in WORDS.findall(line)]
        n = len(tokens)
        for some in ((), *combinations(range(4), 1), *combinations(range(4), 2)):
            spans = [range(1 + (n - 1) * q // 4, 1 + (n - 1) * (q + 1) // 4) for q in some]
            shown = ["?" if any(i in x for x in spans) else t for i, t in enumerate(tokens)]
            stay = sum(t not in "*?" for t in shown)
            if n and all(spans) and 2 * stay >= n and (not some or stay >= least):
                yield k, (some, *shown)
        stay = sum(t not in "*?" for t in tokens)
        for i in range(1, n):
            if tokens[i] not in "*?" and 4 * (stay - 1) >= 3 * n:
                yield k, ("one", i, *tokens[:i], *tokens[i + 1 :])


def test_line_templates(spark, docs, texts):
    extra = [(10_000 + k, f"Served request {k} for user u{k}@x.org in {k} ms by host alpha beta gamma\nunique line number {k} about topic {chr(97 + k)} and more", "en", "s", 1) for k in range(4)]
    both = docs.union(spark.createDataFrame(extra, docs.schema))
    texts = texts | {r[0]: r[1] for r in extra}
    held = defaultdict(set)
    for t in set(texts.values()):
        for _, key in plain_templates(t):
            held[key].add(t)
    for r in line_templates.drop_recurring_lines(both).collect():
        drop = {k for k, key in plain_templates(texts[r.doc_id]) if len(held[key]) >= 3}
        lines = texts[r.doc_id].split("\n")
        assert (r.n_lines, r.n_dropped) == (len(lines), len(drop)) and r.text == "\n".join(x for k, x in enumerate(lines) if k not in drop)


def test_lines_that_vary():
    """Which lines fall together: any field in two quarters at most, short lines as a whole; not tables, not a few common words."""
    names, hosts = "alice bob carol dan eve".split(), "alpha beta gamma delta omega".split()
    same = [
        [f"User {n} logged in from host {h} on the main gateway" for n, h in zip(names, hosts, strict=True)], ["All rights reserved."] * 5, [f"Connection to server closed by user {n}" for n in names],
        [f"Retry {k} of job {k * 7} failed with code {k % 3}" for k in range(5)], ["one two three four five six seven eight nine ten"] * 5,
    ]
    apart = [[f"{k} {k * 3} {k * 5} {k * 7}" for k in range(5)], [f"the {n} of the {h}" for n, h in zip(names, hosts, strict=True)], [f"{n} went to the house of her friends" for n in names], [f"{n} saw {h} and {n}{h} near the {h}{n} house" for n, h in zip(names, hosts, strict=True)], [" \t "] * 5]
    keys = lambda t: set(line_templates.templates(np.frombuffer(t.encode(), np.uint8), 1, 5)[1].tolist())
    assert all(set.intersection(*map(keys, x)) for x in same) and not any(keys(a) & keys(b) for x in apart for i, a in enumerate(x) for b in x[:i])


@pytest.mark.parametrize("line", ["Connection closed by user X today", "Connection closed by user today X", "Connection X closed by user today", "Login failed for X", "Login X failed today", "Connection closed by X", "User X logged in from the main gateway of this house at night", "one two three four five six seven eight nine X eleven twelve"])
def test_one_field_anywhere(spark, line):
    """One word that varies is found wherever it stands after the first, in lines of four words or more; in two texts alone it stays."""
    names = "alice bob carol dan eve".split()
    rows = [(k, f"Opening of text {n} with words of its own\n{line.replace('X', n)}\nand its end {n} {n}x {n}y") for k, n in enumerate(names)]
    for n, dropped in ((5, 1), (2, 0)):
        got = line_templates.drop_recurring_lines(spark.createDataFrame(rows[:n], "doc_id int, text string")).collect()
        assert all((line.replace("X", names[r.doc_id]) in r.text.split("\n")) == (not dropped) for r in got), (n, [r.text for r in got])


def test_surrogates():
    s = pii.Surrogates(b"key")
    given = "Mail a.b@x1.org, Mrs. Emma Brown or Emma Brown, Mr. Karl Braun, +1 (017) 555-7713 and 4845168114407329, 97.51.17.173; token = \"ab12cd34ef\" card 1234567812345678"
    found = [(given[a:b], k, g) for a, b, k, g in s.find(given)]
    assert [k for _, k, _ in found] == ["email", "person", "person", "person", "phone", "card", "ip", "secret"]
    new = [s.replace(k, t, g) for t, k, g in found]
    assert new[1] == new[2] and new[1] != "Emma Brown" and new[1].split()[0] in pii.FEMALE and new[3].split()[0] in pii.MALE
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new[4]) and pii.luhn(new[5]) and new[5][0] == "4" and len(new[5]) == 16
    assert pii.Surrogates(b"key").replace("phone", "+1 (017) 555-7713") == new[4] != pii.Surrogates(b"other").replace("phone", "+1 (017) 555-7713")
    assert re.fullmatch(r"[а-я]+", pii.Surrogates(b"k")._name("привет", ""))


def test_domains_and_families():
    """Addresses of one domain keep one domain, and members of a family one family name, each with the ending of their own."""
    s = pii.Surrogates(b"key")
    bob, sue, other = (s.replace("email", x) for x in ("bob@acme.com", "sue@acme.com", "bob@acme2.com"))
    assert bob.split("@")[1] == sue.split("@")[1] != "acme.com" and bob.split("@")[0] == other.split("@")[0] != "bob" and bob.split("@")[1] != other.split("@")[1]
    for a, b in (("Kowalska", "Kowalski"), ("Nowacka", "Nowacki"), ("Nováková", "Novák"), ("Иванова", "Иванов"), ("Jónsdóttir", "Jónsson")):
        x, y = s._name(a), s._name(b)
        if b != "Novák":  # without an ending it is a name of its own
            assert x[: len(x) - len(pii._ENDING.search(a)[0])] == y[: len(y) - len(pii._ENDING.search(b)[0])]
        assert x != a and y != b and x.endswith(pii._ENDING.search(a)[0])
    names = {f"{x}{y}{e}" for x in "KLMN" for y in "aeiou" for e in ("", "ski", "ska", "bski", "t")}
    assert len({s._name(n) for n in names}) == len(names)


@pytest.mark.parametrize("number", ["+33 1 23 45 67 89", "+33 6 12 34 56 78", "+33 (0)1 23 45 67 89", "+44 (20) 7946 0958", "+49 30 1234567", "555 123 4567", "030 1234567", "01 23 45 67 89", "01.23.45.67.89", "(030) 1234567", "+1 (017) 555-7713"])
def test_phone_numbers(number):
    s = pii.Surrogates(b"key")
    for given in (number, f"call {number}, or", f"{number} 97.51.17.173", f"{number} 4845168114407329 x"):
        assert [given[a:b] for a, b, k, _ in s.find(given) if k == "phone"] == [number], given
    assert s.replace("phone", number) != number


def test_no_phone_numbers():
    s = pii.Surrogates(b"key")
    assert not [x for t in ("on 01.02.2024 12 30", "from 2024-01-02 to 2024-02-03", "05/06/2023 10", "0.123 456 789", "1 + 2 3") for x in s.find(t)]


def test_names_and_their_mentions():
    s = pii.Surrogates(b"key")
    given = "Smith began. Linda Brown, Mark Davis, Richard Miller, Jean-Pierre Dupont, Иван Петрович Сидоров and Mr. John Smith's son; later John and Brown met Smith's dog and Сидоров, not Johnson. Mr. James met Mrs. James"
    found = [(given[a:b], k) for a, b, k, _ in s.find(given)]
    names = "Smith|Linda Brown|Mark Davis|Richard Miller|Jean-Pierre Dupont|Иван Петрович Сидоров|John Smith|John|Brown|Smith|Сидоров|James|James".split("|")
    assert found == [(n, "person") for n in names]
    new = {given[a:b]: s.replace(k, given[a:b], g) for a, b, k, g in s.find(given)}
    assert new["John Smith"] == f"{new['John']} {new['Smith']}" and new["Linda Brown"].endswith(" " + new["Brown"]) and new["Linda Brown"].split()[0] in pii.FEMALE
    assert new["Иван Петрович Сидоров"].split()[0] in pii.MALE_CYRILLIC and len({s.replace("person", given[a:b], g) for a, b, _, g in s.find(given) if given[a:b] == "James"}) == 1


@pytest.mark.parametrize("form", ["0", "a", "00", "000", "a0", "aaa", "ba"])
def test_permutation_is_one_cycle(form):
    """Every value of a form is reached once, and none is its own surrogate."""
    classes = tuple(pii._form(c) for c in form)
    move = pii.Permutation(b"k", "t", classes)
    made = {x: "".join(move(x)) for x in map("".join, product(*[a.values for a in classes]))}
    assert set(made.values()) == set(made) and not any(a == b for a, b in made.items())
    assert made != {x: "".join(pii.Permutation(b"other", "t", classes)(x)) for x in made}


def made_entities(r):
    """One valid entity of each kind."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    card = r.choice("3456") + digits(r.choice([13, 14, 15]) - 1)
    card += next(d for d in "0123456789" if pii.luhn(card + d))
    account = r.choice(["DE", "GB", "FR"]) + "00" + digits(18)
    iban = account[:2] + f"{98 - pii._mod97(account):02}" + account[4:]
    return {
        "ip": ".".join(str(r.randrange(1 if not k else 0, 224 if not k else 256)) for k in range(4)), "card": card, "iban": " ".join(iban[k : k + 4] for k in range(0, len(iban), 4)) if r.random() < 0.5 else iban,
        "ssn": f"{r.choice([x for x in range(1, 1000) if x != 666]):03}-{r.randrange(1, 100):02}-{r.randrange(1, 10000):04}", "email": f"{r.choice('abcxyz')}{digits(3)}.{r.choice(['kim', 'lee'])}@mail{digits(2)}.example.org",
        "phone": f"+1 ({r.randrange(200, 1000)}) {r.randrange(200, 1000)}-{digits(4)}", "secret": "".join(r.choice("abcdef0123456789") for _ in range(24)),
        "person": f"{r.choice([*pii.FEMALE, *pii.MALE])} {r.choice('Brown Smith Keller Novak Moreau Okafor Lindqvist Yamada'.split())}",
    }


def is_valid(kind, text):
    if kind == "ip":
        parts = text.split(".")
        return len(parts) == 4 and all(p == str(int(p)) and int(p) < 256 for p in parts) and 0 < int(parts[0]) < 224
    if kind == "card":
        return pii.luhn(text) and text.isdigit()
    if kind == "iban":
        return pii.mod97(text.replace(" ", ""))
    if kind == "ssn":
        a, b, c = text.split("-")
        return a not in ("000", "666") and b != "00" and c != "0000" and (len(a), len(b), len(c)) == (3, 2, 4)
    if kind == "phone":
        return bool(re.fullmatch(r"\+1 \([2-9]\d\d\) \d{3}-\d{4}", text))
    return bool(text.strip())


def test_surrogates_are_valid():
    """Of thousands of entities of each kind every surrogate is valid, another text, found as the same kind, and no other's."""
    r, s, made = random.Random(3), pii.Surrogates(b"quern surrogate key"), defaultdict(dict)
    for _ in range(4000):
        for kind, text in made_entities(r).items():
            made[kind][text] = s.replace(kind, text)
    for kind, pairs in made.items():
        assert len(set(pairs.values())) == len(pairs) and not any(a == b or len(a) != len(b) for a, b in pairs.items() if kind != "person"), kind
        assert all(is_valid(kind, x) for x in pairs.values()), kind
        again = [x for x in list(pairs.values())[:500] if [x] != [(f"token: {x}" if kind == "secret" else x)[a:b] for a, b, k, _ in s.find(f"token: {x}" if kind == "secret" else x) if k == kind]]
        assert len(again) <= (25 if kind == "person" else 0), (kind, again[:5])
    odd = ["803.1.1.1", "224.0.0.1", "0.0.0.0", "01.2.3.4", "000-00-0000", "666-12-3456"]
    assert s.replace("ip", "224.0.0.1").startswith("2") and len({s.replace("ssn", x) for x in odd[4:]}) == 2


def planted_texts(r, n):
    words = "stone river under green walks often while paper light moves seven other below quiet turns".split()
    for _ in range(n):
        parts, own = [], []
        for kind, text in made_entities(r).items():
            parts += [r.choice(words) for _ in range(r.randrange(3, 60))]
            parts.append(f"{r.choice(['secret', 'API_KEY', 'password'])}={text}" if kind == "secret" else text)
            own.append((kind, text))
        parts += ["then", "the", "version", "1.2.3", "of", "2024-01-02", "costs", "1,234.50", "and", "serial", "1234567812345678", "ends"]
        yield " ".join(parts), own


def test_what_is_found():
    """Recall and precision over planted entities, with numbers between them that are none."""
    r, s = random.Random(9), pii.Surrogates(b"k")
    hit = found = wanted = 0
    for text, own in planted_texts(r, 300):
        got = Counter((k, text[a:b]) for a, b, k, _ in s.find(text))
        hit += sum((got & Counter(own)).values())
        found += sum(got.values())
        wanted += len(own)
    assert hit >= 0.97 * wanted and hit >= 0.97 * found, (hit, wanted, found)


def test_regions_lose_nothing(texts, monkeypatch):
    """What is found around triggers is what is found in the whole text."""
    s, r = pii.Surrogates(b"k"), random.Random(4)
    some = [*texts.values(), *(t for t, _ in planted_texts(r, 30)), "password" + " " * 300 + "= hunter22", "İİİ our secret=abcdefghijkl here", "x" * 200 + "@" + "y" * 200 + ".org"]
    near = [s.find(t) for t in some]
    monkeypatch.setattr(pii, "regions", lambda text: [(0, len(text))])
    assert near == [s.find(t) for t in some] and all(near[-3:])


def test_names_by_context_and_short_secrets():
    s = pii.Surrogates(b"key")
    found = lambda t: [(t[a:b], k) for a, b, k, _ in s.find(t)]
    assert found("Yesterday Ravi Kumar wrote that Author: Ngozi Okafor met Kumar.") == [("Ravi Kumar", "person"), ("Ngozi Okafor", "person"), ("Kumar", "person")]
    assert found("password: short1 and token=\"a1b2\"; the secret: nothing") == [("short1", "secret"), ("a1b2", "secret")]
    assert found("The Big House said nothing. When Time told") == []
    new = [s.replace("person", x) for x in ("Brown", "Петрова", "Сидоров")]
    assert re.fullmatch(r"[B-DF-HJ-NP-TV-Z][b-df-hj-np-tv-z][aeiou][b-df-hj-np-tv-z]{2}", new[0]) and new[1].endswith("ова") and new[2].endswith("ов")


def test_surrogates_over_the_table(spark, docs, texts):
    out = pii.surrogate_text(docs, b"k").cache()
    rows = pii.with_collisions(out).collect()
    assert len(rows) == sum(len(r.entities) for r in out.collect()) and not any(r.collides for r in rows)
    some = out.where("size(entities) > 0").orderBy("doc_id").limit(5)
    twice = out.union(some.withColumn("entities", F.transform("entities", lambda e: e.withField("entity", F.lit("another")))))
    wrong = {r.surrogate for r in some.select(F.explode("entities").alias("e")).select("e.*").collect()}
    assert wrong and {r.surrogate for r in pii.collisions(twice).collect()} >= wrong
    for r in out.collect():
        text, shift = texts[r.doc_id], 0
        for e in r.entities:
            old = texts[r.doc_id][e.start : e.start + e.length]
            assert old != e.surrogate
            text = text[: e.start + shift] + e.surrogate + text[e.start + shift + e.length :]
            shift += len(e.surrogate) - e.length
        assert r.text == text


def plain_alignment(a, b):
    rows, best = [[0] * (len(b) + 1)], 0
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, rows[-1][j] + (2 if x == y else -1), rows[-1][j + 1] - 1, row[-1] - 1))
        rows.append(row)
        best = max(best, max(row))
    return best


def test_alignment():
    r = random.Random(5)
    for _ in range(60):
        a, b = ([r.randrange(5) for _ in range(r.randrange(1, 15))] for _ in range(2))
        assert decontaminate.align(np.array(a), np.array(b))[0] == plain_alignment(a, b)


def test_contamination(spark, docs, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    split = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(t))
    edited = split(items[0])
    for k in range(4, len(edited), 9):
        edited[k] = "changed"
    planted = {90_001: "before it " + " ".join(edited) + " and after", 90_002: items[1].upper() + " tail", 90_003: " ".join(reversed(split(items[2])))}
    both = docs.union(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in planted.items()], docs.schema))
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(both, bench).collect()}
    assert 0.6 < got[90_001, 0] < 1
    assert got[90_002, 1] == 1.0
    assert not any(d == 90_003 for d, _ in got)
    whole = {(i, k) for i, t in texts.items() for k, item in items.items() if " " + " ".join(split(item)) + " " in " " + " ".join(split(t)) + " "}
    assert whole and whole <= set(got)
    sample = dict(list(texts.items())[:40])
    exact = {(i, k) for i, t in sample.items() for k, item in items.items() if plain_alignment(split(item), split(t)[:400]) >= len(split(item))}
    assert exact <= set(got)
    clean = {r.doc_id for r in decontaminate.decontaminated(both, bench).collect()}
    assert clean == {*texts, *planted} - {d for d, _ in got}


def test_contamination_recall(spark):
    """Against exhaustive alignment: of random copies with 10 to 30 % of words replaced, put in or left out, all but a few are found, and no others."""
    r = random.Random(12)
    items = {k: [f"w{r.randrange(400)}" for _ in range(40)] for k in range(25)}
    rows = []
    for i in range(400):
        copy, rate = [], r.choice([0.1, 0.2, 0.3])
        for w in items[r.randrange(25)]:
            turn = r.random()
            copy += [w] if turn > rate else r.choice([[f"w{r.randrange(400)}"], [w, f"w{r.randrange(400)}"], []])
        rows.append((i, " ".join([f"w{r.randrange(400)}" for _ in range(30)] + copy + [f"w{r.randrange(400)}" for _ in range(30)])))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.score for x in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    want = {(i, k): plain_alignment(w, t.split()) / 80 for i, t in rows for k, w in items.items() if len({*w} & {*t.split()}) >= 16}
    want = {k: v for k, v in want.items() if v >= 0.5}
    assert got == {k: v for k, v in want.items() if k in got} and len(got) >= 0.98 * len(want) > 350


@pytest.mark.parametrize("every", [4, 5])
def test_contamination_of_changed_copies(spark, every):
    """The one copy of an item, with every 4th or 5th word changed, is found beside whole copies of it and without them."""
    items = {i: [f"w{i}x{k}" for k in range(40)] for i in range(6)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    changed = {i: ["changed" if k % every == every - 1 else x for k, x in enumerate(w)] for i, w in items.items()}
    apart = items[5][:20] + ["between"] * 35 + items[5][20:]
    rows = [(i, "before it " + " ".join(w) + " after") for i, w in changed.items()] + [(10 + k, " ".join(items[0]) + f" {k}") for k in range(3)] + [(20, " ".join(apart)), (21, " ".join(items[1][:12]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs, bench).collect()}
    least = {(i, i): plain_alignment(w, changed[i]) / 80 for i, w in items.items()}
    assert min(least.values()) >= 0.5 and got == least | {(10 + k, 0): 1.0 for k in range(3)} | {(20, 5): (80 - 35) / 80}
    assert {r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()} == {21}


def test_contamination_of_natural_copies(spark):
    """Of copies with every 3rd to 5th word changed, or a word put in after every second or third, among documents of the same words, nearly all are found that score enough; the corpus has whole copies of half of the items."""
    r = random.Random(21)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(3000)]
    word = lambda: r.choice(common) if r.random() < 0.5 else r.choice(rare)
    items = {k: [word() for _ in range(r.choice([12, 30, 60]))] for k in range(80)}
    edits = {f"every {e}": (lambda w, e=e: [word() if k % e == e - 1 else x for k, x in enumerate(w)]) for e in (3, 4, 5)}
    edits |= {f"into {e}": (lambda w, e=e: [y for k, x in enumerate(w) for y in ([x, word()] if k % e == e - 1 else [x])]) for e in (2, 3)}
    rows = [(i, name, f(w)) for name, f in edits.items() for i, w in items.items()] + [(i, "whole", w) for i, w in items.items() if i % 2]
    texts = [(k, " ".join([word() for _ in range(20)] + w + [word() for _ in range(20)])) for k, (_, _, w) in enumerate(rows)] + [(10**6 + k, " ".join(word() for _ in range(200))) for k in range(300)]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    for name in (*edits, "whole"):
        due = [(k, i) for k, (i, n, w) in enumerate(rows) if n == name and plain_alignment(items[i], texts[k][1].split()) >= len(items[i])]
        share = sum(x in found for x in due) / len(due)
        assert len(due) >= 20 and share >= (0.9 if name == "every 3" else 0.97), (name, len(due), share)
    assert not any(k >= 10**6 for k, _ in found)


def test_contamination_in_capitals(spark):
    """Copies of items beyond ASCII are found in any case, and scored and placed as whole copies."""
    item = "Où êtes-vous allés après l’été, Élodie ? Ça dépend — d’où, наверное, придёт ответ на это"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, item.upper()), (2, f"AVANT !! {item.upper()} APRÈS"), (3, item.lower()), (4, "Ünrelated Wörds ALONE, où êtes-vous"), (5, None), (6, "É")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.score, r.first_word) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {1: (1.0, 0), 2: (1.0, 1), 3: (1.0, 0)}
    assert {r.doc_id for r in decontaminate.decontaminated(docs, bench).collect()} == {4, 5, 6}


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = queries.op10_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_language_of_long_texts_alone(spark):
    """A language is learned even if each of its texts is longer than what the sample takes."""
    one, two = "the cat sat on the mat with that hat ", "der hund und die katze und das haus "
    rows = [(i, one * 3, "en") for i in range(30)] + [(100 + i, two * (400 + i), "de") for i in range(3)] + [(200, "und die katze", "de"), (201, two * 900, "de"), (300, "", "fr"), (301, None, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(docs, use=F.col("doc_id") < 200, train_bytes=8192).collect()}
    assert got[200] == got[201] == "de" and got[0] == "en" and got[300] == got[301] == "und"


def test_texts_in_no_learned_language(spark):
    """Random letters and other languages go, whatever the learned languages say of each other; clean texts stay."""
    r = random.Random(7)
    words = {"en": "the cat sat on mat with that hat and then it ran away from dogs".split(), "de": "der hund und die katze im haus sind nicht mehr da seit gestern".split()}
    rows = [(1000 * k + i, " ".join([*(r.choice(w) for _ in range(r.randrange(20, 60))), *([f"token = {r.randrange(10**15)}"] if i % 4 == 1 else [])]), lang) for k, (lang, w) in enumerate(words.items()) for i in range(60)]
    rows += [(9001, "".join(r.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(900)), None), (9002, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. " * 4, None), (9003, "Все люди рождаются свободными и равными в своем достоинстве и правах. " * 4, None)]
    rows += [(9004, "the cat and the dogs ran away from that mat token = 7844238401328224", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {x.doc_id for x in language_id.identified(docs).collect()}
    assert kept == {x[0] for x in rows} - {9001, 9002, 9003}
    scores = {x.doc_id: x.score for x in language_id.identify(docs).where("doc_id > 9000").collect()}
    assert min(scores.values()) >= 0.5


def test_code_lengths():
    """Costs of the tables against escapes followed one by one."""
    train = {"x": [b"abracadabra abra"], "y": [b"banana bandana"]}
    model = language_id.train(train, 2)
    counts = {}
    for lang, texts in train.items():
        c = defaultdict(Counter)
        data = b"\n\n" + texts[0]
        for i in range(2, len(data)):
            for k in range(3):
                c[data[i - k : i]][data[i]] += 1
        counts[lang] = c

    def plain(lang, text):
        data, total = b"\n\n" + text, 0.0
        for i in range(2, len(data)):
            for k in (2, 1, 0):
                own = counts[lang].get(data[i - k : i])
                if own is None:
                    continue
                n, d = sum(own.values()), len(own)
                if data[i] in own:
                    total -= np.log2(own[data[i]] / (n + d))
                    break
                total -= np.log2(d / (n + d))
            else:
                total += 8
        return total

    for text in (b"abra", b"banana", b"zzz abz", b"\n", b"ndana cad"):
        got = model.bits(np.frombuffer(text, np.uint8))
        assert got == pytest.approx([plain("x", text), plain("y", text)], rel=1e-5)


def test_blocks_of_long_texts(monkeypatch):
    model = language_id.train({"x": [b"hello world " * 9]}, 3)
    data = np.frombuffer(b"world hello " * 50, np.uint8)
    whole = model.bits(data)
    monkeypatch.setattr(language_id, "BLOCK", 17)
    assert model.bits(data) == pytest.approx(whole)


def test_pipeline(spark):
    import corpus_pipeline

    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, DATA).collect()
    ids = {r.doc_id for r in out}
    comps = components({i: r.text for i, r in docs.items()})
    bad = {r.doc_id for r in decontaminate.contaminated(spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")).collect()}
    assert out and not ids & bad and all(Counter(comps[i][1] for i in ids)[c] == 1 for c in {comps[i][1] for i in ids})
    assert all(docs[r.doc_id].text == r.text for r in out)
    # the mix: each source's words are its target to half a document, by the words that came in
    clean = [i for i in docs if i not in bad and i == comps[i][1] or comps[i][0] == 0 and i not in bad]
    came = defaultdict(list)
    for i in clean:
        came[docs[i].source].append(len(WORDS.findall(docs[i].text)))
    mixed = spark.createDataFrame([tuple(docs[i]) for i in clean], spark.read.parquet(f"{DATA}/documents.parquet").schema)
    target = {r.source: r.target for r in mixing.mix(mixed).collect()}
    for source, sizes in came.items():
        assert abs(sum(len(WORDS.findall(r.text)) for r in out if r.source == source) - target[source]) <= max(sizes) / 2 + 1
    # the shards: equal counts, gapless slots, every source in its share
    by = Counter(r.shard for r in out)
    assert sorted(by) == list(range(16)) and max(by.values()) - min(by.values()) <= 1
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s in range(16) for k in range(by[s])]
    share, held = Counter((r.shard, r.source) for r in out), Counter(r.source for r in out)
    assert all(abs(share[s, x] - held[x] / 16) <= 1.001 for s in by for x in held)
