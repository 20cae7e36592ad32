"""N-gram Jaccard join by set-relation skipping.

A text's set is that of its five-word shingles, as 64-bit hashes. Equal sets are one from the start. Sets
at or over the threshold share one of their first ``n - ceil(threshold * n) + 1`` shingles in any common
order; the order used puts frequent shingles last. Those are the inverted lists.

* Index: a list's entries hold set size and position. In the search, a long list is cut into blocks by size (many entries
  of one size by hash). Blocks whose sizes are too far apart are never brought together; of the others a pair of
  smaller blocks, then a pair of entries, is skipped if sizes or positions leave too small an overlap.
* Answers: each set is first compared with one leader, the set of the smallest id that shares a list with it. Links to
  leaders give groups of highly similar sets. The search then takes answers over from the leader: sets
  that are already in one group need no comparison, and two sets whose known distances to their common
  leader differ by more than the threshold allows can't be similar (Jaccard distance is a metric).

What is left is compared exactly on whole sets. No pairs within a group are listed, no list is cut off.

Defined results: empty or null texts have no shingles and link with nothing; shorter texts than a shingle
are one shingle; rows with a null id are returned, with their size, and link with nothing (null component);
rows that share an id are one document, linked by any of their texts. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, stored
from .components import components

WORDS = 5
#: Similar means NUMERATOR * union <= DENOMINATOR * intersection.
NUMERATOR, DENOMINATOR = 80, 100
#: Shingles whose hash is in this lower share are counted over all documents; of the others, those that
#: repeat within a task. Counts only order the shingles; any order gives the same links.
COUNTED = 0.25
#: A shingle that often is frequent; the most frequent ones, up to so many, are known to all tasks.
FREQUENT, MOST_FREQUENT = 16, 1 << 18
#: Bytes of text that are hashed together, and shingles that a task counts together.
CHUNK_BYTES, COUNT_TOGETHER = 500_000, 1_000_000
#: Longer lists are dealt out in blocks of about this size, a task for each pair of blocks.
LIST_BLOCK = 4096
#: Their sizes are known by so many quantiles.
GRID = 256
#: Lists that are known to be longer are gathered in parts of about so many entries.
LIST_PART = 1000
#: Comparisons with one set that one task makes; tables of up to so many rows are sent to all tasks.
MEMBERS, BROADCAST_ROWS = 2000, 400_000
#: Comparisons of one text in a row, and bytes of sets in a batch.
TASKS, SET_BYTES = 1000, 64 << 20

_POWER, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA5A5A5A5B5297A4D, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD], np.uint64)
_powers = [np.ones(0, np.uint64), np.ones(0, np.uint64)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    if len(_powers[0]) < n:
        for k, base in enumerate((_POWER, _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= CHUNK_BYTES):
            size += len(raw[end]) + 1
            end += 1
        out += _chunk_sets(raw[at:end], words)
        at = end
    return out


def _chunk_sets(raw: list[bytes], words: int) -> list[np.ndarray]:
    joined = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    letters = _LOWER[joined]
    gap = _SPACE[letters]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    first, last = edge[::2], edge[1::2]  # it begins and ends with a gap
    _grow(len(letters) + 1)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * _powers[0][: len(letters)])])
    word = _mix((run[last] - run[first]) * _powers[1][first] + (last - first).astype(np.uint64) * _PLACE[4])
    lengths = np.array([len(r) + 1 for r in raw], np.int64)
    ends = np.cumsum(lengths) + 1
    bounds = np.concatenate([[0], np.searchsorted(first, ends)])
    n = len(word) - words + 1
    place = [_PLACE[j % 5] + np.uint64(2 * (j // 5)) for j in range(words)]
    runs = _mix(sum(word[j : n + j] * place[j] for j in range(words))) if n > 0 else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            short = sum(word[a + j : a + j + 1] * place[j] for j in range(b - a))
            out.append(_mix(short + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def least_overlap(a, b):
    """Smallest intersection of similar sets of sizes a and b."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, sorted, ranks (from 1, by rising frequency) and counts of the most frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        size = 0

        def counted() -> pa.RecordBatch:
            seen, n = np.unique(np.concatenate([*kept, np.zeros(0, np.uint64)]), return_counts=True)
            use = (n > 1) | (seen < np.uint64(int(COUNTED * 2**64)))
            return pa.RecordBatch.from_arrays([pa.array(_signed(seen[use])), pa.array(n[use], pa.int64())], ["shingle", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                for own in shingle_sets(batch.column(0).slice(at, 128).to_pylist()):
                    kept.append(own)
                    size += len(own)
                    if size >= COUNT_TOGETHER:
                        yield counted()
                        kept, size = [], 0
        yield counted()

    counts = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    counts = stored(counts, "frequent")
    powers = {r.power: r.n for r in counts.groupBy(F.floor(F.log2("n") * 4).alias("power")).agg(F.count("*").alias("n")).collect()}
    left, least = MOST_FREQUENT, None
    for power in sorted(powers, reverse=True):
        if powers[power] > left:
            break
        left, least = left - powers[power], power
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    top = counts.where(F.floor(F.log2("n") * 4) >= least).toPandas()  # at most MOST_FREQUENT rows
    top = top.sort_values(["n", "shingle"])
    hashes, ranks = top["shingle"].to_numpy(np.int64).view(np.uint64), np.arange(1, len(top) + 1)
    order = np.argsort(hashes)
    return hashes[order], ranks[order], top["n"].to_numpy(np.int64)[order]


def prefixed_sets(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n, s1, s2 (two hashes of the set), its prefix in the common order, and in how many parts the list of
    each shingle of the prefix is dealt out."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks, counts = shared.value
        spread = np.maximum(1, -(-counts // LIST_PART)).astype(np.int32)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                n, s1, s2, prefixes, parts = [], [], [], [], []
                for own in shingle_sets(part.column(1).to_pylist()):
                    size = len(own)
                    n.append(size)
                    s1.append(int(_signed(_mix(own + np.uint64(1)).sum(keepdims=True))[0]))
                    s2.append(int(_signed((_mix(own ^ _PLACE[2]) * _PLACE[0]).sum(keepdims=True))[0]))
                    take = size - -(-NUMERATOR * size // DENOMINATOR) + 1 if size else 0
                    known = np.ones(take, np.int32)
                    if len(hashes) and size:
                        spot = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                        often = hashes[spot] == own
                        rare = own[~often]
                        if len(rare) < take:
                            rest, place = own[often], spot[often]
                            order = np.argsort(ranks[place])
                            known[len(rare) :] = spread[place[order]][: take - len(rare)]
                            rare = np.concatenate([rare, rest[order]])
                        own = rare
                    prefixes.append(_signed(own[:take]))
                    parts.append(known)
                ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]), pa.int32())
                ids = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)]), pa.int64()))
                parts = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), ids, parts], ["doc_id", "n", "s1", "s2", "prefix", "parts"])

    return _texts(docs).mapInArrow(run, "doc_id long, n int, s1 long, s2 long, prefix array<long>, parts array<int>")


def _lists(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of each run of rows that agree in the first ``keys`` columns; rows come sorted by them."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.asarray(c) for c in batch.columns]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now)]
        change = np.zeros(len(now[0]) - 1, bool)
        for k in range(keys):
            change |= now[k][1:] != now[k][:-1]
        ends = (np.flatnonzero(change) + 1).tolist()
        start = 0
        for end in ends:
            if end - start > 1:
                yield [x[start:end] for x in now]
            start = end
        held = [x[start:] for x in now]
    if held is not None and len(held[0]) > 1:
        yield held


def shared_lists(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """token, id, n, at, leader: the entries of all lists with two or more sets, and of those in several parts."""
    entries = sets.join(nodes, "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "n", F.posexplode(F.arrays_zip("prefix", "parts")).alias("at", "t")).select(F.col("t.prefix").alias("token"), F.when(F.col("t.parts") > 1, F.pmod(F.xxhash64("id"), F.col("t.parts").cast("long")) + 1).otherwise(0).cast("int").alias("part"), "id", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("at").cast("long")).alias("n_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # whole batches at once: an entry is kept if a neighbour in order has its token
        # (and each entry of a list that is in several parts)
        held: list[np.ndarray] | None = None
        leader_of: tuple[int, int, int] | None = None
        schema = ["token", "part", "id", "n", "at", "leader"]

        def kept(cols: list[np.ndarray], final: bool) -> pa.RecordBatch:
            nonlocal leader_of
            token, part, ids, n_at = cols
            starts = np.concatenate([[True], (token[1:] != token[:-1]) | (part[1:] != part[:-1])])
            group = np.cumsum(starts) - 1
            first = np.flatnonzero(starts)
            sizes = np.bincount(group)
            leader = ids[first]
            many = sizes > 1
            if leader_of is not None and len(token) and (token[0], part[0]) == leader_of[:2]:
                leader[0], many[0] = leader_of[2], True
            use = many[group] | (part > 0)
            if len(token):
                leader_of = (int(token[-1]), int(part[-1]), int(leader[-1]))
            return pa.RecordBatch.from_arrays([pa.array(token[use]), pa.array(part[use]), pa.array(ids[use]), pa.array((n_at[use] >> 32).astype(np.int32)), pa.array((n_at[use] & 0xFFFFFFFF).astype(np.int32)), pa.array(leader[group][use])], schema)

        for batch in batches:
            now = [np.asarray(c) for c in batch.columns]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if len(now[0]) < 2:
                held = now
                continue
            # the last entry waits: its list may go on; entries of one list that were passed on keep their leader
            cut = len(now[0]) - 1
            whole = [x[:cut] for x in now]
            if now[0][cut] == now[0][cut - 1] and now[1][cut] == now[1][cut - 1]:
                probe = kept(now, False)
                yield probe
                held = [x[:0] for x in now]
            else:
                yield kept(whole, False)
                held = [x[cut:] for x in now]
        if held is not None and len(held[0]):
            yield kept(held, True)

    dealt = entries.repartition("token", "part").sortWithinPartitions("token", "part", "id")
    lists = stored(dealt.mapInArrow(run, "token long, part int, id long, n int, at int, leader long"), "lists")
    # the parts of a list have one leader; there are at most MOST_FREQUENT such lists
    several = stored(lists.where("part > 0").groupBy("token").agg(F.min("leader").alias("first")), "long-lists")
    return lists.join(F.broadcast(several), "token", "left").select("token", "id", "n", "at", F.coalesce("first", "leader").alias("leader"))


def compare(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, overlap, na, nb of distinct pairs (a long, b long), from the whole texts again.

    The texts of b travel to a's task, a few thousand to each; a set is hashed once per text.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("members") / MEMBERS)).cast("int")
    asked = stored(pairs.groupBy("a").agg(F.count("*").alias("members")).select("a", parts.alias("parts")), "asked")
    # only sets with many comparisons are looked up, so that the pairs of one set don't go to one task
    large = asked.where("parts > 1")
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    part = F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")
    seconds = pairs.join(large, "a", "left").select(F.col("b").alias("id"), F.struct(F.col("a").alias("a"), part.alias("part"), F.lit(1).alias("role")).alias("task"))
    firsts = asked.select(F.col("a").alias("id"), F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.col("a").alias("a"), p.alias("part"), F.lit(0).alias("role")))).alias("task"))
    tasks = stored(firsts.unionByName(seconds).groupBy("id").agg(F.collect_list("task").alias("tasks")), "comparisons")
    rows = tasks.agg(F.coalesce(F.sum(F.size("tasks")), F.lit(0))).first()[0]
    texts = _texts(docs)
    wanted = F.broadcast(tasks) if rows <= BROADCAST_ROWS else tasks
    # one row per class, so that copies of a text are not hashed again
    some = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("tasks") - 1) / TASKS).cast("int")), lambda i: F.slice("tasks", i * TASKS + 1, F.lit(TASKS))))
    needed = texts.join(wanted, texts["doc_id"] == wanted["id"]).select("id", "text", some.alias("tasks"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], [], [], []]
        size = 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["a", "part", "role", "id", "hashes"])

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for name, own, work in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist()), part.column(2).to_pylist()):
                    raw = own.tobytes()
                    for t in work:
                        for column, v in zip(out, (t["a"], t["part"], t["role"], name, raw)):
                            column.append(v)
                        size += len(raw)
                        if size >= SET_BYTES:
                            yield rows()
                            out, size = [[], [], [], [], []], 0
                yield rows()
                out, size = [[], [], [], [], []], 0

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, []
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            # one row at a time: the sets of a batch are not held twice
            for a, part, role, name, raw in ([c[i].as_py() for c in batch.columns] for i in range(batch.num_rows)):
                own = np.frombuffer(raw, np.uint64)
                if (a, part) != key:
                    key, first = (a, part), []
                if role == 0:
                    first.append(own)
                    continue
                for x in first:
                    spot = np.minimum(np.searchsorted(x, own), max(0, len(x) - 1))
                    overlap = int((x[spot] == own).sum()) if len(x) else 0
                    for column, v in zip(out, (a, name, overlap, len(x), len(own))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out], ["a", "b", "overlap", "na", "nb"])

    dealt = needed.mapInArrow(sets, "a long, part int, role int, id long, hashes binary").repartition("a", "part").sortWithinPartitions("a", "part", "role")
    return stored(dealt.mapInArrow(overlaps, "a long, b long, overlap long, na long, nb long"), "overlaps")


def similar(compared: DataFrame) -> DataFrame:
    union = F.col("na") + F.col("nb") - F.col("overlap")
    return compared.where(DENOMINATOR * F.col("overlap") >= NUMERATOR * union).select(F.col("a").alias("u"), F.col("b").alias("v"))


def dealt(lists: DataFrame, entries: DataFrame, sizes: DataFrame) -> DataFrame:
    """token, b1, b2, n, at, id, component, apart: the entries of the lists in ``sizes`` (token, blocks), once where a list is
    one block, else once for each pair of blocks b1 <= b2 that has theirs and whose sizes can be similar."""
    rest = ["n", "at", "id", "component", "apart"]
    long = sizes.where("blocks > 2")
    n_long = long.count()
    if not n_long:
        zero = F.lit(0).cast("long")
        return entries.join(sizes, "token", "left_semi").select("token", zero.alias("b1"), zero.alias("b2"), *rest)
    sent = F.broadcast if n_long <= BROADCAST_ROWS else lambda df: df
    shares = [i / GRID for i in range(GRID + 1)]
    seen = lists.join(sent(long), "token").groupBy("token", "blocks").agg(F.percentile_approx("n", shares, 10 * GRID).alias("grid"), F.min("n").alias("least"), F.max("n").alias("most"))
    classes = F.least(F.lit(GRID), F.col("blocks")).cast("int")
    # sizes from bounds[c] to bounds[c + 1] are of class c; a size that fills several classes is dealt out among them by hash
    inner = F.transform(F.sequence(F.lit(1), classes - 1), lambda c: F.get("grid", F.floor(c * GRID / classes).cast("int")))
    bounds = F.concat(F.array("least"), inner, F.array("most"))
    known = stored(seen.select("token", classes.alias("classes"), F.ceil(F.col("blocks") / GRID).cast("int").alias("parts"), bounds.alias("bounds")), "long-list-sizes")
    rows = entries.join(sizes.select("token"), "token").join(sent(known), "token", "left")
    within = lambda test: F.size(F.filter(F.slice("bounds", F.lit(2), F.col("classes") - 1), test))
    low, high = within(lambda x: x < F.col("n")), within(lambda x: x <= F.col("n"))
    hashed = F.xxhash64("id")
    rows = rows.withColumn("class", low + F.pmod(hashed, (high - low + 1).cast("long")).cast("int"))
    rows = rows.withColumn("own", F.col("class").cast("long") * F.col("parts") + F.pmod(F.xxhash64(hashed), F.col("parts").cast("long")))
    at = lambda i: F.get("bounds", i.cast("int"))
    near = lambda c: (NUMERATOR * at(F.col("class")) <= DENOMINATOR * at(c + 1)) & (NUMERATOR * at(c) <= DENOMINATOR * at(F.col("class") + 1))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("classes").cast("long") * F.col("parts") - 1), lambda o: near(F.floor(o / F.col("parts"))))
    pairs = F.transform(others, lambda o: F.struct(F.least("own", o).alias("b1"), F.greatest("own", o).alias("b2")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("b1"), F.lit(0).cast("long").alias("b2")))
    return rows.select("token", F.explode(F.when(F.col("bounds").isNull(), one).otherwise(pairs)).alias("k"), *rest).select("token", "k.b1", "k.b2", *rest)


def search(lists: DataFrame, groups: DataFrame, compared: DataFrame) -> DataFrame:
    """Distinct pairs a < b that share a list, are not in one group, and that nothing rules out."""
    known = compared.groupBy(F.col("a").alias("leader"), F.col("b").alias("id")).agg(F.max(F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("likeness"))
    entries = lists.join(groups.select(F.col("node").alias("id"), "component"), "id", "left").join(known, ["leader", "id"], "left")
    apart = F.when(F.col("id") == F.col("leader"), F.lit(0.0)).otherwise(1.0 - F.col("likeness"))
    entries = entries.select("token", "id", "n", "at", F.coalesce("component", "id").alias("component"), F.coalesce(apart, F.lit(-1.0)).alias("apart"))
    sizes = entries.groupBy("token").agg(F.count("*").alias("entries"), F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("token", F.ceil(F.col("entries") / LIST_BLOCK).alias("blocks"))
    work = dealt(lists, entries, stored(sizes, "list-sizes")).repartition("token", "b1", "b2").sortWithinPartitions("token", "b1", "b2", "n", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, waiting, size = 1.0 - NUMERATOR / DENOMINATOR + 1e-9, [], 0

        def distinct() -> pa.RecordBatch:
            pairs = np.unique(np.concatenate([*waiting, np.zeros((0, 2), np.int64)]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for _, _, _, n, at, ids, component, apart in _lists(batches, 3):
            n, left = n.astype(np.int64), n.astype(np.int64) - at
            step = 256
            for i in range(0, len(n), step):
                for j in range(i, len(n), step):
                    # sizes rise: no later block can be similar to this one
                    if NUMERATOR * n[j] > DENOMINATOR * n[min(i + step, len(n)) - 1]:
                        break
                    x, y = slice(i, i + step), slice(j, j + step)
                    need = least_overlap(n[x, None], n[None, y])
                    if min(int(left[x].max()), int(left[y].max())) < int(need.min()):
                        continue  # positions rule the whole block out
                    use = (component[x, None] != component[None, y]) & (np.minimum(left[x, None], left[None, y]) >= need) & (NUMERATOR * n[None, y] <= DENOMINATOR * n[x, None])
                    p, q = apart[x, None], apart[None, y]
                    use &= (p < 0) | (q < 0) | (np.abs(p - q) <= most)
                    if i == j:
                        use = np.triu(use, 1)
                    a, b = np.nonzero(use)
                    if len(a):
                        a, b = ids[x][a], ids[y][b]
                        waiting.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
                        size += len(a)
            if size >= 500_000:
                yield distinct()
                waiting, size = [], 0
        yield distinct()

    pairs = work.mapInArrow(run, "a long, b long").distinct()
    done = compared.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return stored(pairs.join(done, ["a", "b"], "left_anti"), "pairs")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    sets = stored(prefixed_sets(docs, frequent_shingles(docs)), "sets")
    classes = stored(sets.where("n > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("node")), "classes")
    nodes = classes.select(F.col("node").alias("doc_id")).distinct()
    lists = shared_lists(sets, nodes)
    # one text of a class stands for it
    leaders = lists.where("id <> leader").groupBy("id").agg(F.min("leader").alias("a")).select("a", F.col("id").alias("b"))
    compared = compare(docs, nodes, leaders)
    groups = components(similar(compared))
    rest = compare(docs, nodes, search(lists, groups, compared))
    linked = components(similar(compared).unionByName(similar(rest)).unionByName(_shared_ids(sets, classes)))
    found = classes.join(linked, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("component"))
    rows = sets.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "s1", "s2")
    component = F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id"))
    return rows.join(found, ["s1", "s2"], "left").select("doc_id", "n_shingles", component.alias("component_id"))


def _shared_ids(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id."""
    mine = sets.where("n > 0 and doc_id is not null").join(classes, ["s1", "s2"]).select("doc_id", "node").distinct()
    ends = mine.groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("u")).where("u > v")
    return mine.join(ends.select("doc_id", "v"), "doc_id").select(F.col("node").alias("u"), "v").where("u > v")


ORACLE = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= {WORDS} then list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as shingle from d),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where {DENOMINATOR} * k >= {NUMERATOR} * (x.n + y.n - k)),
reach(a, b) as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, least(d.doc_id, min(reach.b)) as component_id from d left join n using (doc_id) left join reach on reach.a = d.doc_id group by d.doc_id
"""
