"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Every document is the set of its word shingles, ordered by one global order:
rare shingles first.  Two sets of Jaccard similarity t share at least l
shingles among the first n - ceil(t n) + l of each (n: its size).  Every
document picks its own l: a longer prefix costs more index entries, but asks
for l shared ones before a pair is verified, so documents whose prefixes hold
frequent shingles pick a larger l.  A pair has to share min(l, l') of them.

Nothing is quadratic in a group of copies:

* equal sets are one class from the start;
* prefix shingles travel packed, a row for each task and partition, and only
  those of two classes or more go on;
* lists of up to eight classes go on as pairs, which are counted: a pair that
  meets in such lists alone must do so as often as it has to share shingles;
* longer lists go on as routes to a group, named after the least class of the
  list, so that the many shared shingles of a group of copies lead to few
  groups; a pair that meets in any of them is verified there;
* each document's set travels once to each of its groups, and within a group it
  is verified against those of other components only: the edges that come out
  are a spanning forest;
* a group over the size limit is dealt into blocks.  First a few pivots of the
  group visit all blocks, then, with the components so far, all members outside
  of the group's largest component do.  So in a large group of near-copies a
  set travels twice, and only those that belong to no large component more.

The order needs no exact counts: frequencies come from a sketch of fixed size
over all documents, the only thing that is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, discard, small_batches, unused
from .wordhash import hash_words, mix64, shingle_hashes, text_buffers

_U = np.uint64
SKETCH_BITS = 22
SKETCH_BLOCKS = 64
MOST_MATCHES = 4
SHORT_LIST = 8
FLUSH = 1 << 20
GROUP_DOCS, GROUP_SHINGLES = 4000, 4_000_000
PIVOTS = 8


def shingle_set(data: np.ndarray | None, width: int) -> np.ndarray:
    """The distinct shingles of a text, ascending; none for null."""
    return np.unique(shingle_hashes(hash_words(data), width)) if data is not None else np.zeros(0, _U)


def set_name(shingles: np.ndarray) -> int:
    """A 64-bit name of a set, signed: equal sets have equal names."""
    return int((mix64(mix64(shingles) + _U(len(shingles))).sum(dtype=_U) if len(shingles) else _U(0)).astype(np.int64))


def global_order(shingles: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles by (frequency level, hash), and their levels."""
    level = levels[(shingles >> _U(64 - int(len(levels)).bit_length() + 1)).astype(np.int64)]
    order = np.argsort(level, kind="stable")
    return shingles[order], level[order]


def choose_prefix(level: np.ndarray, percent: int) -> tuple[int, int]:
    """(matches asked for, prefix length) of least estimated cost.

    The pairs that the prefix meets are counted, at one each; of these, l
    matches leave about one in 4**l to verify, at the cost of the whole set.
    """
    n = len(level)
    least = -(-percent * n // 100)
    short = n - least + 1
    most = max(1, min(MOST_MATCHES, least))
    met = np.cumsum(np.exp2(level[: short + most - 1] / 4.0))
    cost = [met[short + m - 2] * (1 + n / 4**m) for m in range(1, most + 1)]
    m = int(np.argmin(cost)) + 1
    return m, short + m - 1


def _read(batch: pa.RecordBatch, column: int, width: int) -> Iterator[np.ndarray]:
    for data in text_buffers(batch.column(column)):
        yield shingle_set(data, width)


COUNTED = "row bigint, text_hash bigint, n bigint, name bigint, block int, cells binary"


def _count(width: int, bits: int):
    """Names and sizes of the sets, and at the end of a task the sketch of its distinct sets, in blocks (n: what the block counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, seen = np.zeros(1 << bits, dtype=np.uint32), set()
        schema = pa.schema([("row", pa.int64()), ("text_hash", pa.int64()), ("n", pa.int64()), ("name", pa.int64()), ("block", pa.int32()), ("cells", pa.binary())])
        for batch in batches:
            n, name = [], []
            for s in _read(batch, 2, width):
                n.append(len(s))
                name.append(set_name(s))
                if len(s) and name[-1] not in seen:
                    seen.add(name[-1])
                    np.add.at(cells, (s >> _U(64 - bits)).astype(np.int64), np.uint32(1))
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(name, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], schema=schema)
        if seen:
            parts = [p.astype(np.uint8) if p.max() < 256 else p for p in np.split(cells, SKETCH_BLOCKS)]
            none, held = pa.nulls(SKETCH_BLOCKS).cast(pa.int64()), [int(p.sum(dtype=np.int64)) for p in parts]
            yield pa.RecordBatch.from_arrays([none, none, pa.array(held, pa.int64()), none, pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=schema)

    return run


def _levels(bits: int, total: int):
    """The sketches of all tasks, summed, as frequency levels: quarter powers of two of what each cell counts over the mean."""
    size = (1 << bits) // SKETCH_BLOCKS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(cells, dtype=np.uint8 if len(cells) == size else np.uint32)
                counts[block] = counts.get(block, 0) + own.astype(np.int64)
        levels = [np.minimum(4 * np.log2(1 + np.maximum(c - total / (1 << bits), 0)), 255).astype(np.uint8).tobytes() for c in counts.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(levels, pa.binary())], ["block", "levels"])

    return run


def frequency_levels(sketches: DataFrame, bits: int, total: int) -> np.ndarray:
    """A byte for each cell of the sketch: 2**bits bytes, whatever the input.  ``total``: what all cells count together."""
    out = np.zeros(1 << bits, dtype=np.uint8)
    size = (1 << bits) // SKETCH_BLOCKS
    for block, levels in sketches.repartition(SKETCH_BLOCKS, "block").mapInArrow(_levels(bits, total), "block int, levels binary").collect():
        out[block * size : (block + 1) * size] = np.frombuffer(bytes(levels), dtype=np.uint8)
    return out


def _index(width: int, percent: int, levels, parts: int):
    """Packed index entries: for each partition the shingles (32 bits of them), their sets, and the sets' names and sizes (with the matches they ask for in the low three bits).

    A shingle's partition and its 32 bits come from different bits of its
    hash.  Two shingles that agree in both lead to a pair that fails its
    verification, no more.
    """
    schema = pa.schema([("part", pa.int32()), ("tokens", pa.binary()), ("owners", pa.binary()), ("names", pa.binary()), ("sizes", pa.binary())])

    def flush(tokens, owners, names, sizes):
        token, owner = np.concatenate(tokens), np.concatenate(owners)
        part = ((token >> _U(32)) * _U(parts) >> _U(32)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        part, token, owner = part[order], (token[order] & _U(0xFFFFFFFF)).astype(np.uint32), owner[order]
        at = np.flatnonzero(np.diff(part, prepend=-1))
        rows = []
        for lo, hi in zip(at, [*at[1:], len(part)], strict=True):
            own, place = np.unique(owner[lo:hi], return_inverse=True)
            place = place.astype(np.uint16 if len(own) < 1 << 16 else np.uint32)
            rows.append((int(part[lo]), token[lo:hi].tobytes(), place.tobytes(), names[own].tobytes(), sizes[own].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        tokens, owners, names, sizes, held = [], [], [], [], 0
        for batch in batches:
            for s in _read(batch, 0, width):
                if not len(s) or (name := set_name(s)) in seen:
                    continue
                seen.add(name)
                token, level = global_order(s, levels.value)
                matches, length = choose_prefix(level, percent)
                tokens.append(token[:length])
                owners.append(np.full(length, len(names), dtype=np.uint32))
                names.append(name)
                sizes.append(len(s) << 3 | matches)
                held += length
                if held >= FLUSH:
                    yield flush(tokens, owners, np.array(names, np.int64), np.array(sizes, np.int64))
                    tokens, owners, names, sizes, held = [], [], [], [], 0
        if held:
            yield flush(tokens, owners, np.array(names, np.int64), np.array(sizes, np.int64))

    return run


LISTS = "grp bigint, name bigint, n bigint, other bigint, other_n bigint, shared bigint, need bigint"


def _lists(percent: int):
    """What the lists of the index lead to: routes (grp, name, n), or pairs (name, n, other, other_n) with how often they met and have to."""

    def lists(rows: list[tuple]) -> list[np.ndarray]:
        token = np.concatenate([np.frombuffer(r[0], np.uint32) for r in rows])
        name, size = [], []
        for tokens, owners, names, sizes in rows:
            at = np.frombuffer(owners, np.uint16 if len(owners) * 2 == len(tokens) else np.uint32)
            name.append(np.frombuffer(names, np.int64)[at])
            size.append(np.frombuffer(sizes, np.int64)[at])
        name, size = np.concatenate(name), np.concatenate(size)
        order = np.argsort(token, kind="stable")
        token, name, size = token[order], name[order], size[order]
        again = np.zeros(len(token), dtype=bool)
        again[1:] = token[1:] == token[:-1]
        often = again.copy()
        often[:-1] |= again[1:]  # drop what one entry has before the finer sort
        token, name, size = token[often], name[often], size[often]
        order = np.lexsort((name, size, token))
        token, name, size = token[order], name[order], size[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (name[1:] != name[:-1])
        token, name, need, size = token[new], name[new], size[new] & 7, size[new] >> 3
        fits = np.zeros(len(token), dtype=bool)
        fits[1:] = (token[1:] == token[:-1]) & (100 * size[:-1] >= percent * size[1:])
        run = np.cumsum(~fits)  # a list falls apart where sizes jump
        count = np.bincount(run)[run] if len(run) else run
        pairs = [np.zeros((0, 5), np.int64)]
        small = count <= SHORT_LIST
        for step in range(1, SHORT_LIST):
            i = np.flatnonzero(small[:-step] & (run[step:] == run[:-step]) & (100 * size[:-step] >= percent * size[step:]))
            turn = name[i] > name[i + step]
            a, b = np.where(turn, i + step, i), np.where(turn, i, i + step)
            pairs.append(np.stack([name[a], size[a], name[b], size[b], np.minimum(need[a], need[b])], axis=1))
        pair = np.concatenate(pairs)
        pair = pair[np.lexsort((pair[:, 2], pair[:, 0]))]
        first = np.flatnonzero(np.append(True, (pair[1:, 0] != pair[:-1, 0]) | (pair[1:, 2] != pair[:-1, 2]))) if len(pair) else np.zeros(0, np.int64)
        shared = np.diff(np.append(first, len(pair)))
        pair = pair[first]
        name, size, run = name[~small], size[~small], run[~small]
        begin = np.flatnonzero(np.diff(run, prepend=-1))
        group = np.zeros(0, np.int64)
        if len(run):
            least = np.minimum.reduceat(mix64(name.view(_U)), begin)
            group = np.repeat(least, np.diff(np.append(begin, len(run)))).view(np.int64)
        order = np.lexsort((name, group))
        group, name, size = group[order], name[order], size[order]
        new = np.ones(len(group), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (name[1:] != name[:-1])
        return [group[new], name[new], size[new], pair, shared]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for part, *rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                parts.setdefault(part, []).append(tuple(rest))
        columns = ["grp", "name", "n", "other", "other_n", "shared", "need"]
        whole = lambda x: pa.array(x, pa.int64())
        while parts:
            _, rows = parts.popitem()
            group, name, size, pair, shared = lists(rows)
            none = pa.nulls(len(group)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([whole(group), whole(name), whole(size), none, none, none, none], columns)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pair)).cast(pa.int64()), *[whole(pair[:, c]) for c in range(4)], whole(shared), whole(pair[:, 4])], columns)

    return run


SENT = "grp bigint, block int, side int, part bigint, name bigint, matches int, prefix int, shingles binary"


def _send(width: int, percent: int, levels):
    """Each set, in the global order, to the groups that its class has routes to."""
    schema = pa.schema([("grp", pa.int64()), ("block", pa.int32()), ("side", pa.int32()), ("part", pa.int64()), ("name", pa.int64()), ("matches", pa.int32()), ("prefix", pa.int32()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for s, name, routes in zip(_read(batch, 0, width), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if set_name(s) != name:  # another text with the doc_id of the class
                    continue
                token, level = global_order(s, levels.value)
                matches, length = choose_prefix(level, percent)
                data = token.tobytes()
                for r in routes:
                    rows.append((r["grp"], r["block"], r["side"], r["part"], name, matches, length, data))
                    held += len(data)
                    if held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def links(members: list[tuple], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the members (side, part, name, matches, prefix length, shingles in global order).

    Members of one part are known to be in one component.  If there are
    visitors (side 1), pairs of a visitor and a member of side 0 are all that is
    asked for, and each visitor is tested.  Otherwise components grow as links
    are found; pairs within one need no test.  A few members are tested against
    all first; then all outside the largest component, each against every
    member that isn't in its own: so each pair is in one component or has been
    tested.
    """
    m = len(members)
    size = np.array([len(x[5]) for x in members])
    name = [x[2] for x in members]
    side = np.array([x[0] for x in members])
    visits = np.flatnonzero(side == 1)
    if m == 2 and not len(visits):
        a, b = members
        if a[2] == b[2] or a[1] == b[1] or 100 * size.min() < percent * size.max():
            return []
        if len(np.intersect1d(a[5][: a[4]], b[5][: b[4]], assume_unique=True)) < min(a[3], b[3]):
            return []
        both = len(np.intersect1d(a[5], b[5], assume_unique=True))
        return [(name[0], name[1])] if 100 * both >= percent * (int(size.sum()) - both) else []
    need, prefix = (np.array([x[i] for x in members]) for i in (3, 4))
    values, token = np.unique(np.concatenate([x[5] for x in members]), return_inverse=True)
    end = np.cumsum(size)
    begin = end - size
    in_prefix = np.concatenate([token[b : b + p] for b, p in zip(begin, prefix, strict=True)])
    owner = np.repeat(np.arange(m), prefix)
    part = np.unique([x[1] for x in members], return_inverse=True)[1]
    mark = np.zeros(len(values), dtype=bool)
    found = []

    def test(x: int) -> None:
        own = token[begin[x] : end[x]]
        mark[own[: prefix[x]]] = True
        shared = np.bincount(owner[mark[in_prefix]], minlength=m)
        can = (shared >= np.minimum(need, need[x])) & (part != part[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
        if len(visits):
            can &= side == 0
        mark[own] = True
        for y in np.flatnonzero(can):
            if part[y] != part[x]:
                both = int(mark[token[begin[y] : end[y]]].sum())
                if 100 * both >= percent * (int(size[x] + size[y]) - both):
                    found.append((name[x], name[y]))
                    part[part == part[y]] = part[x]
        mark[own] = False

    if len(visits):
        for x in visits:
            test(x)
        return found
    for x in range(min(m, 4)):
        test(x)
    inside = np.flatnonzero(part == np.bincount(part).argmax())[0]
    for x in range(min(m, 4), m):
        if part[x] != part[inside]:
            test(x)
    return found


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, out = None, {}, []

        def close() -> None:
            if key is not None and len(members) > 1:
                out.extend(links(list(members.values()), percent))

        for batch in batches:
            for grp, block, side, part, name, matches, prefix, data in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (grp, block) != key:
                    close()
                    key, members = (grp, block), {}
                members[side, name] = (side, part, name, matches, prefix, np.frombuffer(data, dtype=_U))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
            out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _grouped(docs: DataFrame, percent: int, width: int, sketch_bits: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, n, name) of each row, and (_name, _root, _id) of each class: the least name and the least doc_id that links reach."""
    spark = small_batches(docs.sparkSession)
    own = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    hashed = own.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    first = cut(hashed.mapInArrow(_count(width, sketch_bits), COUNTED), "jaccard-count")
    rows = first.where("block IS NULL").select(F.col("row").alias("doc_id"), "text_hash", "n", "name")
    in_sketch = F.col("block").isNotNull()
    held = first.agg(F.coalesce(F.sum(F.when(~in_sketch, F.col("n"))), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.when(in_sketch, F.col("n"))), F.lit(0)).alias("sketch")).first()
    levels = spark.sparkContext.broadcast(frequency_levels(first.where(in_sketch).select("block", "cells"), sketch_bits, held["sketch"]))

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), held["rows"] * (100 - percent) // 100 // 2_000_000)
    index = own.select("text").mapInArrow(_index(width, percent, levels, parts), "part int, tokens binary, owners binary, names binary, sizes binary")
    met = cut(index.repartitionById(parts, F.col("part")).mapInArrow(_lists(percent), LISTS), "jaccard-lists")
    pairs = met.where("grp IS NULL").groupBy("name", "n", "other", "other_n").agg(F.sum("shared").alias("shared"), F.max("need").alias("need")).where("shared >= need")
    # a counted pair is a group of its own, shared with the other pairs of its lesser name
    ends = pairs.select(F.xxhash64("name").alias("grp"), F.explode(F.array(F.struct("name", "n"), F.struct(F.col("other").alias("name"), F.col("other_n").alias("n")))).alias("e")).select("grp", "e.*")
    routes = met.where("grp IS NOT NULL").select("grp", "name", "n").union(ends)
    routes = cut(routes.groupBy("grp", "name").agg(F.max("n").alias("n")), "jaccard-routes")
    spent = [met, routes]
    groups = routes.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("w"))
    blocks = F.greatest(F.ceil(F.col("m") / GROUP_DOCS), F.ceil(F.col("w") / GROUP_SHINGLES)).cast("int")
    members = routes.join(groups.where("m > 1").select("grp", blocks.alias("k")), "grp").select("grp", "name", "k", F.pmod(F.xxhash64("name"), F.col("k")).cast("int").alias("block"))
    members = cut(members, "jaccard-members")
    spent.append(members)
    # one row of each class that has routes gets to send its set
    holder = rows.where("n > 0").groupBy("name").agg(F.min("doc_id").alias("id"))
    nameless = not rows.where("doc_id IS NULL AND n > 0").isEmpty()

    def verified(routes: DataFrame, label: str) -> DataFrame:
        """Links of the groups that the routes (grp, block, side, part, name) lead to."""
        listed = routes.select("name", F.struct("grp", "block", "side", "part").alias("route")).groupBy("name").agg(F.collect_list("route").alias("routes"))
        senders = holder.join(listed, "name").select("name", "routes", F.col("id").alias("_id"))
        wanted = own.join(senders.where("_id IS NOT NULL").hint("shuffle_hash"), F.col("doc_id") == F.col("_id")).select("text", "name", "routes")
        if nameless:  # classes in which no row has a doc_id: found by their texts
            found = own.where("doc_id IS NULL").select("text").mapInArrow(_named(width), "text string, name bigint")
            wanted = wanted.union(found.join(senders.where("_id IS NULL"), "name").select("text", "name", "routes"))
        sent = wanted.mapInArrow(_send(width, percent, levels), SENT)
        edges = cut(sent.repartition(parts, "grp", "block").sortWithinPartitions("grp", "block").mapInArrow(_verify(percent), "a bigint, b bigint"), label)
        spent.append(edges)
        return edges

    home = F.lit(0).alias("side")
    visit = [F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("block"), F.lit(1).alias("side")]
    large = members.where("k > 1")
    routes = members.select("grp", "block", home, F.col("name").alias("part"), "name")
    any_large = not large.isEmpty()
    if any_large:
        pivots = large.withColumn("_h", F.xxhash64(F.lit("pivot"), "name")).groupBy("grp", "k").agg(F.min(F.struct("_h", "name")).alias("p0"), *[F.min(F.when(F.pmod("_h", F.lit(PIVOTS)) == j, F.struct("_h", "name"))).alias(f"p{j + 1}") for j in range(PIVOTS)])
        pivots = pivots.select("grp", "k", F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(f"p{j}.name") for j in range(PIVOTS + 1)])))).alias("name"))
        routes = routes.union(pivots.select("grp", *visit, F.col("name").alias("part"), "name").select("grp", "block", "side", "part", "name"))
    edges = verified(routes, "jaccard-links")
    roots = components(edges, "jaccard")
    if any_large:
        placed = large.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("part", F.coalesce("root", "name"))
        most = placed.groupBy("grp", "part").agg(F.count("*").alias("_c")).groupBy("grp").agg(F.max_by("part", F.struct("_c", "part")).alias("_most"))
        placed = cut(placed.join(most, "grp").select("grp", "k", "block", "name", "part", (F.col("part") != F.col("_most")).alias("outside")), "jaccard-outside")
        spent.append(placed)
        outside = placed.where("outside")
        if not outside.isEmpty():
            open_ = placed.join(outside.select("grp").distinct(), "grp", "left_semi")
            routes = open_.select("grp", "block", home, "part", "name").union(outside.select("grp", *visit, "part", "name"))
            spent.append(roots)
            roots = components(edges.union(verified(routes, "jaccard-links")), "jaccard")
    levels.destroy()
    discard(spent)
    classes = holder.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))
    linked = classes.groupBy(F.col("root").alias("_root")).agg(F.min("id").alias("_id"))
    # a table of its own, so that a join with it can split the rows of a class with very many copies
    ids = cut(classes.join(linked, F.col("root") == F.col("_root")).select(F.col("name").alias("_name"), "_root", "_id"), "jaccard-ids")
    return rows, ids


def jaccard_groups(docs: DataFrame, percent: int = 75, width: int = 5, sketch_bits: int = SKETCH_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id.

    Words are runs of other than ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; a
    document's set has its distinct shingles of ``width`` words (with fewer
    words, the whole sequence as one).  Two documents link when 100 * common >=
    ``percent`` * all; component_id is the least doc_id that links reach, itself
    included.  Without words, or with a null text, a set is empty and links
    with nothing: component_id is then the row's own doc_id.  Rows with a null
    doc_id link like others and don't name a component unless all of it are
    null.  Repeated rows each get their row.  An empty table gives no rows.
    doc_id is an integer; other columns are not read.
    """
    rows, ids = _grouped(docs, percent, width, sketch_bits, doc_id, text)
    found = rows.join(ids, (F.col("name") == F.col("_name")) & (F.col("n") > 0), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _named(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_name(s) for s in _read(batch, 0, width)], pa.int64())], ["text", "name"])

    return run


def keep_one(docs: DataFrame, percent: int = 75, width: int = 5, sketch_bits: int = SKETCH_BITS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with all their columns: of each component one row stays.

    That is a row with the least doc_id of the component, nulls last; of
    different texts with that doc_id the one whose set has the least name.  A
    row is told by doc_id and text, so another text under a doc_id that stays
    or goes is judged by its own links.  Rows without words (null, empty or
    white space) link with nothing and stay.  Of rows with equal doc_id and
    text one stays, whichever of them.  Other columns may have any names.
    An empty table gives no rows.
    """
    rows, ids = _grouped(docs, percent, width, sketch_bits, doc_id, text)
    texts = rows.groupBy("doc_id", "text_hash", "n", "name").agg(F.count("*").alias("times"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "name", "text_hash", "times")).alias("k")
    linked = texts.where("n > 0").join(ids, F.col("name") == F.col("_name")).groupBy("_root").agg(least).select("k.doc_id", "k.text_hash", "k.times")
    kept = linked.union(texts.where("n = 0").select("doc_id", "text_hash", "times"))
    id_, hash_, times = unused(docs, "_kept", "_kept_hash", "_times")
    kept = cut(kept.select(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_), F.col("times").alias(times)), "jaccard-kept")
    own_hash = F.xxhash64(docs[text].cast("string"))
    out = docs.join(kept.hint("shuffle_hash"), docs[doc_id].cast("bigint").eqNullSafe(F.col(id_)) & (own_hash == F.col(hash_)))
    columns = [docs[c] for c in docs.columns]
    if kept.where(F.col(times) > 1).isEmpty():
        return out.select(*columns)
    again = out.where(F.col(times) > 1).select(*columns, id_, hash_).dropDuplicates([id_, hash_])
    return out.where(F.col(times) == 1).select(*columns).union(again.drop(id_, hash_))
