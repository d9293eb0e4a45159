"""Exact n-gram Jaccard join by set relations.

Documents become sets of word shingles; equal sets are one set. Links are found in two steps.

*Similar sets first.* MinHash bands name sets that are probably alike; each is compared with four sets of its band, which is
linear in the sets however large a band is: with the most typical one, which has the fewest rare shingles and so lies in the
middle of a group of edited copies, with two arbitrary ones, and with its neighbour in the order of the other bands. Sets joined so need no further comparison with one another, and
each keeps what it differs in from its leader.

*Then all others, exactly.* The inverted index holds the prefix of each set under one global order: shingles that few sets
hold come first (``hot`` ones later, by steps of their frequency), then by hash. A pair of the wanted similarity shares a prefix shingle. Lists are sorted
by set size and cut into blocks; a block is skipped whole if sizes, or the positions behind which too little is left, rule
all its pairs out. Pairs inside one component are skipped; the entries of the component that holds most of a list are not
compared with one another at all. A list of more than LONG entries is not worked off in its task: pairs of its blocks are
dealt over all tasks, where odd sketches (each shingle flips one bit) tell a lower bound of how much two sets differ.

Of the pairs left the index names the leaders only; their overlap is computed once. Leaders that link join their components,
which answers all their members' pairs. For the others ``|y & z| <= |x & w| + |y - x| + |z - w|`` (x, w the leaders of y, z)
is held first against whole groups (the largest differences and the range of sizes of all members), then against the members
of one side, then of both; only the rest is compared.

The order of shingles is a function of fixed-size bit maps, so that any data give a right result, and rarity only speeds it up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .kernel import NOT_SPACE, Words, groups, mix, shingles, view
from .scratch import cut, fresh, release, small_batches, table

WIDTH, NUMERATOR, DENOMINATOR = 4, 85, 100
HASHES, ROWS, HOT, LEAST_LOW, BLOCK = 10, 2, 20, 24, 64
#: A longer list is dealt out in pairs of blocks of DEALT entries; bits of an odd sketch.
LONG, DEALT, SKETCH = 2048, 512, 1024
#: A shingle of more than HOT sets is hot, and more so for each further factor of STEP.
STEP, LEVELS = 4, 4
#: A map has 16 bits for each shingle that it marks, within these powers of two (8 MB at most).
LEAST_BITS, MOST_BITS = 13, 26
#: Rows of ids that a join may broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS = 1 << 20
_SEEDS = mix(np.arange(101, 101 + HASHES, dtype=np.uint64)) | np.uint64(1)


def prefix_size(n: int) -> int:
    """Shingles of a set of n, in any one order, of which a similar set holds at least one."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def needed(a, b):
    """Overlap I links sets of a and b if (NUMERATOR + DENOMINATOR) * I >= this."""
    return NUMERATOR * (a + b)


def sets_of(texts: pa.Array):
    """Per row, the ascending distinct shingle hashes, in groups: (first row, list of arrays)."""
    data, off = view(texts)
    for a, z in groups(off, 1 << 18):
        w = Words(data[off[a] : off[z]], off[a : z + 1] - off[a], NOT_SPACE)
        s, rows = shingles(w.hashes(), w.rows, WIDTH)
        yield a, [np.unique(s[x:y]) for x, y in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]


def set_id(s: np.ndarray) -> int:
    """64-bit digest of a set, signed."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(s ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64) + np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15)], np.uint64)).view(np.int64)[0])


def text_key():
    """Tells rows of one doc_id apart; null and empty texts are alike."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, sid, bands, low) of each row; low: its smallest shingle hashes, at least twice the prefix."""
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", text_key().alias("text_key"), "text")
    ident = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            for a, sets in sets_of(b.column(2)):
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                some = np.flatnonzero(sizes)
                starts = (np.cumsum(sizes) - sizes)[some]
                least = np.zeros((len(sets), HASHES), np.uint64)
                for j, seed in enumerate(_SEEDS):
                    x = flat * seed
                    x ^= x >> np.uint64(31)
                    x *= np.uint64(0x94D049BB133111EB)
                    if len(some):
                        least[some, j] = np.minimum.reduceat(x, starts)
                bands = [mix(least[:, j] + mix(least[:, j + 1] + np.uint64(j))) for j in range(0, HASHES, ROWS)]
                keys = np.stack(bands, 1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(a, len(sets)),
                        b.column(1).slice(a, len(sets)),
                        pa.array(sizes),
                        pa.array([set_id(s) for s in sets], pa.int64()),
                        pa.array([k.tolist() if n else [] for k, n in zip(keys, sizes, strict=True)], pa.list_(pa.int64())),
                        pa.array([s[: max(LEAST_LOW, 2 * prefix_size(len(s)))].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_key", "n", "sid", "bands", "low"],
                )

    return rows.mapInArrow(run, f"doc_id {ident}, text_key long, n long, sid long, bands array<long>, low array<long>")


def fetch(docs: DataFrame, ids: DataFrame, first: DataFrame) -> DataFrame:
    """(sid, n, shingles) of the sets in ids (sid), from one row of each: first (sid, rep, rep_key, several: whether rows may repeat)."""
    wanted = cut(ids.join(first, "sid").select("sid", F.col("rep").alias("doc_id"), F.col("rep_key").alias("text_key")))
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    keyed = docs.select("doc_id", text_key().alias("text_key"), "text")
    on = keyed["doc_id"].eqNullSafe(wanted["doc_id"]) & (keyed["text_key"] == wanted["text_key"])
    rows = keyed.join(F.broadcast(wanted) if few else wanted, on).select("sid", "text")

    def run(batches):
        for b in batches:
            for a, sets in sets_of(b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "n", "shingles"])

    sets = rows.mapInArrow(run, "sid long, n long, shingles binary")
    # Rows repeated with id and text give one set several times.
    return cut(sets.dropDuplicates(["sid"]) if first.filter("several").limit(1).count() else sets)


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with na, nb and overlap."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")

    def run(batches):
        for b in batches:
            out = np.zeros(len(b), np.int64)
            for i, (x, y) in enumerate(zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                if len(x):
                    out[i] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(out)], names=["a", "b", "na", "nb", "overlap"])

    return both.mapInArrow(run, "a long, b long, na long, nb long, overlap long")


def linked() -> F.Column:
    return (NUMERATOR + DENOMINATOR) * F.col("overlap") >= needed(F.col("na"), F.col("nb"))


def bits_for(count: int) -> int:
    return max(LEAST_BITS, min(MOST_BITS, (16 * count).bit_length()))


def bitmap(tokens: DataFrame, bits: int) -> np.ndarray:
    """A map of 2**bits bits, made on the executors, that marks each token's low bits."""
    v = tokens.select((F.pmod("token", F.lit(1 << bits)) + 1).alias("v"))
    parts = v.groupBy(F.bitmap_bucket_number("v").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits")).collect()
    flat = np.zeros(max(4096, (1 << bits) // 8), np.uint8)
    for r in parts:
        flat[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return flat[: (1 << bits) // 8]


def marked(map_: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    v = (tokens & np.uint64(8 * len(map_) - 1)).astype(np.int64)
    return (map_[v // 8] >> (v % 8).astype(np.uint8) & 1).astype(bool)


def lists(col: pa.ListArray) -> list[np.ndarray]:
    """Rows of a column of lists as unsigned arrays, without a Python object for each value."""
    off = col.offsets.to_numpy()
    return np.split(col.values.to_numpy().view(np.uint64)[off[0] : off[-1]], off[1:-1] - off[0]) if len(col) else []


def classes(s: np.ndarray, hot: list[np.ndarray]) -> np.ndarray:
    """Of each shingle, in how many of the maps it is: the more, the more frequent."""
    out = np.zeros(len(s), np.int8)
    at = np.arange(len(s))
    for map_ in hot:
        at = at[marked(map_, s[at])]
        if not len(at):
            break
        out[at] += 1
    return out


def prefix(s: np.ndarray, n: int, hot: list[np.ndarray]) -> np.ndarray | None:
    """The first shingles of a set in the global order; s: its smallest hashes. None if s doesn't reach far enough."""
    p = prefix_size(n)
    c = classes(s, hot)
    rare = s[c == 0]
    if len(rare) >= p:
        return rare[:p]
    return s[np.argsort(c, kind="stable")][:p] if len(s) == n else None


def may_pair(n_a, rest_a, root_a, n_b, rest_b, root_b) -> np.ndarray:
    """Matrix of which pairs sizes, positions and components leave."""
    ok = (NUMERATOR + DENOMINATOR) * np.minimum(rest_a[:, None], rest_b[None]) >= needed(n_a[:, None], n_b[None])
    ok &= NUMERATOR * np.maximum(n_a[:, None], n_b[None]) <= DENOMINATOR * np.minimum(n_a[:, None], n_b[None])
    ok &= root_a[:, None] != root_b[None]
    return ok


def block_pairs(one, two, same: bool):
    """Pairs of places in two lists (n, rest, root; sizes ascending) that may link, block by block; same: both are one list."""
    first_b = two[0][::BLOCK]
    for i in range(0, len(one[0]), BLOCK):
        a = [x[i : i + BLOCK] for x in one]
        room, largest = a[1].max(), a[0][-1]
        for j in range(i if same else 0, len(two[0]), BLOCK):
            if NUMERATOR * first_b[j // BLOCK] > DENOMINATOR * largest:
                break
            b = [x[j : j + BLOCK] for x in two]
            if NUMERATOR * a[0][0] > DENOMINATOR * b[0][-1]:
                continue
            if (NUMERATOR + DENOMINATOR) * min(room, b[1].max()) < needed(a[0][0], b[0][0]):
                continue
            x, y = np.nonzero(may_pair(*a, *b))
            if same and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x + i, y + j


def list_pairs(n: np.ndarray, rest: np.ndarray, root: np.ndarray):
    """Pairs of places in one list (sizes ascending; rest: shingles from the place on) that may link.

    Those of the component with most entries meet the others only.
    """
    values, counts = np.unique(root, return_counts=True)
    if len(values) == 1:
        return
    inside = root == values[np.argmax(counts)]
    most, others = np.flatnonzero(inside), np.flatnonzero(~inside)
    one, two = ([x[at] for x in (n, rest, root)] for at in (others, most))
    for x, y in block_pairs(one, one, True):
        yield others[x], others[y]
    for x, y in block_pairs(one, two, False):
        x, y = others[x], most[y]
        yield np.minimum(x, y), np.maximum(x, y)


def leader_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distinct ordered pairs."""
    return np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0)


def candidates(postings: DataFrame, long: int | None = None) -> DataFrame:
    """Rows of two kinds from postings (token, sid, n, rest, root, lead): pairs (a, b) of leaders of sets that may link, a < b,
    perhaps several times, and the entries of lists of more than ``long`` (a, b null), numbered in blocks. A task holds no
    more than ``long`` entries and a batch.
    """
    most = LONG if long is None else long
    rows = postings.repartition("token").sortWithinPartitions("token", "n", "sid")
    names = ["a", "b", "token", "sid", "n", "rest", "root", "lead", "block"]
    size = 1 << 17

    def run(batches):
        held: list = []  # the entries so far of the last list
        last = None  # its shingle
        passed = 0  # how many of its entries went out
        seen: list[list] = [[], []]
        waiting = 0

        def pairs():
            nonlocal seen, waiting
            if waiting:
                found = leader_rows(np.concatenate(seen[0]), np.concatenate(seen[1]))
                none = pa.nulls(len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0].copy()), pa.array(found[:, 1].copy()), *[none] * 7], names=names)
            seen, waiting = [[], []], 0

        def solve(cols):
            nonlocal waiting
            n, rest, root, lead = cols[2:]
            if len(n) > 1:
                for x, y in list_pairs(n, rest, root):
                    seen[0].append(lead[x])
                    seen[1].append(lead[y])
                    waiting += len(x)
                    if waiting > size:
                        yield from pairs()

        def pass_on(cols):
            nonlocal passed
            none = pa.nulls(len(cols[0]), pa.int64())
            block = (passed + np.arange(len(cols[0]))) // DEALT
            passed += len(block)
            yield pa.RecordBatch.from_arrays([none, none, *map(pa.array, cols), pa.array(block)], names=names)

        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(6)]
            if not len(cols[0]):
                continue
            edges = np.concatenate(([0], np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1, [len(cols[0])]))
            # Lists within the batch of one component, or of one entry, have no pairs.
            several = np.minimum.reduceat(cols[4], edges[:-1]) != np.maximum.reduceat(cols[4], edges[:-1])
            several[0] = several[-1] = True
            for k in np.flatnonzero(several).tolist():
                part = [c[edges[k] : edges[k + 1]] for c in cols]
                if part[0][0] != last:
                    if held:
                        yield from solve(held)
                    held, passed, last = [], 0, part[0][0]
                held = [np.concatenate(x) for x in zip(held, part, strict=True)] if held else [c.copy() for c in part]
                if len(held[0]) > most or passed:
                    yield from pass_on(held)
                    held = []
        if held:
            yield from solve(held)
        yield from pairs()

    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def dealt_pairs(entries: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): leaders of the pairs in long lists that may link; sets: those of the entries."""

    def sketch(batches):
        for b in batches:
            out = []
            for x in b.column(2).to_pylist():
                flips = np.bincount((mix(np.frombuffer(x, np.uint64)) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
                out.append(np.packbits(flips.astype(bool)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["sid", "sketch"])

    known = cut(entries.join(sets.mapInArrow(sketch, "sid long, sketch binary"), "sid"))
    # Which blocks meet is found from a row for each; a block of one component doesn't meet another of the same.
    blocks = known.groupBy("token", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("rest").alias("room"), F.min("root").alias("one"), F.max("root").alias("other"))
    x, y = (blocks.select("token", F.col("block").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("low", "high", "room", "one", "other"))) for k in ("i", "j"))
    fits = (NUMERATOR * F.greatest("low_i", "low_j") <= DENOMINATOR * F.least("high_i", "high_j")) & ((NUMERATOR + DENOMINATOR) * F.least("room_i", "room_j") >= needed(F.col("low_i"), F.col("low_j")))
    several = (F.least("one_i", "one_j") != F.greatest("other_i", "other_j")) & (F.col("i") <= F.col("j"))
    meets = cut(x.join(y, "token").filter(several & fits).select("token", "i", "j"))
    sides = [meets.select("token", "i", "j", F.col("i").alias("block")), meets.filter("i <> j").select("token", "i", "j", F.col("j").alias("block"))]
    rows = known.join(sides[0].union(sides[1]), ["token", "block"]).select("token", "i", "j", "block", "sid", "n", "rest", "root", "lead", "sketch")
    rows = rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "block", "n", "sid")

    def solve(cols):
        i, j, block, n, rest, root, lead = cols[1:8]
        left, right = np.flatnonzero(block == i[0]), np.flatnonzero(block == j[0])
        if not len(left) or not len(right):
            return
        ok = may_pair(*(c[left] for c in (n, rest, root)), *(c[right] for c in (n, rest, root)))
        if i[0] == j[0]:
            ok &= left[:, None] < right[None]
        x, y = np.nonzero(ok)
        bits = np.frombuffer(b"".join(cols[8]), np.uint64).reshape(len(cols[8]), -1)
        keep = [np.zeros(0, np.int64)] * 2
        for k in range(0, len(x), 1 << 14):
            p, q = left[x[k : k + (1 << 14)]], right[y[k : k + (1 << 14)]]
            apart = np.bitwise_count(bits[p] ^ bits[q]).sum(1, dtype=np.int64)
            # What two linked sets differ in is at most (DENOMINATOR - NUMERATOR) / (DENOMINATOR + NUMERATOR) of their sizes.
            may = (NUMERATOR + DENOMINATOR) * apart <= (DENOMINATOR - NUMERATOR) * (n[p] + n[q])
            keep = [np.concatenate((u, lead[v[may]])) for u, v in zip(keep, (p, q), strict=True)]
        if len(keep[0]):
            pairs = leader_rows(*keep)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    def run(batches):
        held = None
        for b in batches:
            cols = [np.array(b.column(k).to_numpy()) for k in (0, 1, 2, 3, 5, 6, 7, 8)]
            cols.append(np.array(b.column(9).to_pylist(), object))
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            edges = [0, *new.tolist()]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                yield from solve([c[a:z] for c in cols])
            held = [c[edges[-1] :] for c in cols]
        if held is not None and len(held[0]):
            yield from solve(held)

    return rows.mapInArrow(run, "a long, b long")


def index(described: DataFrame, deep: DataFrame, hot, multi) -> DataFrame:
    """(token, sid, n, rest) of the prefixes; a set whose lowest hashes don't reach far enough comes from deep (whole sets)."""

    def rows_of(sid, n, sets):
        h, m = hot.value, multi.value
        out = [[], [], [], []]
        for s_id, size, s in zip(sid, n, sets, strict=True):
            p = prefix(s, size, h) if size else None
            if p is None:
                continue
            at = np.flatnonzero(marked(m, p))
            out[0].append(p[at].view(np.int64))
            out[1].append(np.full(len(at), s_id, np.int64))
            out[2].append(np.full(len(at), size, np.int64))
            out[3].append(size - at)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], names=["token", "sid", "n", "rest"])

    def lowest(batches):
        for b in batches:
            yield rows_of(b.column(0).to_pylist(), b.column(1).to_pylist(), lists(b.column(2)))

    def whole(batches):
        for b in batches:
            yield rows_of(b.column(0).to_pylist(), b.column(1).to_pylist(), [np.frombuffer(x, np.uint64) for x in b.column(2).to_pylist()])

    schema = "token long, sid long, n long, rest long"
    both = described.select("sid", "n", "low").mapInArrow(lowest, schema).union(deep.select("sid", "n", "shingles").mapInArrow(whole, schema))
    # Equal sets are one set; a set of both kinds has the same prefix in both.
    return both.groupBy("token", "sid").agg(F.max("n").alias("n"), F.max("rest").alias("rest"))


def banded(described: DataFrame, hot) -> DataFrame:
    """(sid, band, order, then, then2, then3) of each set and band; order: first by the number of rare shingles among the lowest, then by id; then: its next bands."""

    def run(batches):
        h = hot.value
        for b in batches:
            sid, low = b.column(0).to_numpy(), lists(b.column(2))
            rare = np.array([len(x) - int(marked(h[0], x).sum()) for x in low], np.int64)
            bands = lists(b.column(1))
            each = np.array([len(x) for x in bands], np.int64)
            order = np.minimum(rare, 1 << 20) << 40 | sid & (1 << 40) - 1
            turns = [np.concatenate([np.roll(x, -k) for x in bands]).view(np.int64) if len(bands) else np.zeros(0, np.int64) for k in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.repeat(sid, each), turns[0], np.repeat(order, each), *turns[1:])], names=["sid", "band", "order", "then", "then2", "then3"])

    return described.select("sid", "bands", "low").mapInArrow(run, "sid long, band long, order long, then long, then2 long, then3 long")


def too_short(described: DataFrame, hot) -> DataFrame:
    """sid of the sets whose prefix isn't in low."""

    def run(batches):
        h = hot.value
        for b in batches:
            short = [s for s, n, low in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), lists(b.column(2)), strict=True) if n and prefix(low, n, h) is None]
            yield pa.RecordBatch.from_arrays([pa.array(short, pa.int64())], names=["sid"])

    return described.select("sid", "n", "low").mapInArrow(run, "sid long").distinct()


def pair_ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()


def links(docs: DataFrame, described: DataFrame, first: DataFrame) -> DataFrame:
    """(a, b) of set ids: links that connect all linked sets (not each link inside a component)."""
    spark = docs.sparkSession
    tokens = cut(described.select(F.explode("low").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1"))
    counts = tokens.agg(F.count(F.lit(1)), *(F.count_if(F.col("sets") > HOT * STEP**k) for k in range(LEVELS))).first()
    sizes_of = [bits_for(c) for c in counts]
    hot = spark.sparkContext.broadcast([bitmap(tokens.filter(F.col("sets") > HOT * STEP**k), sizes_of[k + 1]) for k in range(LEVELS)])
    # 1. Each set with the most typical, the smallest and the largest of its bands.
    bands = banded(described.filter("n > 0"), hot)
    shared = bands.groupBy("band").agg(F.min_by("sid", "order").alias("typical"), F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low <> high")
    # Neighbours in the order of the other bands are alike in several bands, which follows chains of edits. A band may go on
    # in the next task, so that a large one is no task of its own; at such a place a neighbour is missed, which step 2 makes up for.
    members = bands.join(shared, "band").repartitionByRange("band", "then", "then2", "then3", "sid").sortWithinPartitions("band", "then", "then2", "then3", "sid")
    near = cut(members.select("band", "sid", "typical", "low", "high").mapInArrow(_near, "a long, b long").distinct())
    found = cut(overlaps(near, fetch(docs, pair_ids(near), first)).filter(linked()))
    group = cut(components(found.select("a", "b")).withColumnRenamed("node", "sid"))
    # The leader of a set is the most alike of those it is compared with.
    lead = found.groupBy(F.col("a").alias("sid")).agg(F.max_by("b", F.struct("overlap", "b")).alias("lead"), F.max_by(F.col("na") - F.col("overlap"), F.struct("overlap", "b")).alias("outside"))
    # 2. The index over all sets.
    # Sets that need more than their lowest shingles are read whole, and their common shingles count as hot as well.
    deep = fetch(docs, too_short(described, hot), first)
    common = cut(deep.mapInArrow(_tokens, "token long, sets long").groupBy("token").agg(F.sum("sets").alias("sets")).filter(F.col("sets") > HOT))
    deep_first = deep
    hot = spark.sparkContext.broadcast([m | bitmap(common.filter(F.col("sets") > HOT * STEP**k), sizes_of[k + 1]) for k, m in enumerate(hot.value)])
    deep = deep.union(fetch(docs, too_short(described, hot).join(deep.select("sid"), "sid", "left_anti"), first))
    whole = deep.mapInArrow(_tokens, "token long, sets long")
    wide = max(sizes_of[0], bits_for(deep.agg(F.sum("n")).first()[0] or 0))
    multi = bitmap(tokens, wide) | bitmap(whole, wide)
    postings = index(described, deep, hot, spark.sparkContext.broadcast(multi))
    known = group.join(lead, "sid", "left").select("sid", "root", F.coalesce("lead", "sid").alias("lead"))
    rooted = postings.join(known.withColumnRenamed("sid", "of"), F.col("sid") == F.col("of"), "left").select("token", "sid", "n", "rest", F.coalesce("root", "sid").alias("root"), F.coalesce("lead", "sid").alias("lead"))
    named = cut(candidates(rooted))
    pairs = named.filter("a is not null").select("a", "b")
    entries = named.filter("a is null").drop("a", "b")
    if not entries.isEmpty():
        pairs = pairs.union(dealt_pairs(entries, fetch(docs, entries.select("sid").distinct(), first)))
    leaders = cut(pairs.filter("a <> b").distinct())
    # 3. Answers for the sets of two leaders from the overlap of these.
    between = cut(overlaps(leaders, fetch(docs, pair_ids(leaders), first)))
    more = between.filter(linked()).select("a", "b")
    roots = cut(components(found.select("a", "b").union(more)))
    rest = asked(between, lead, described, roots)
    # What is joined so far is known by one link of each set to its root.
    out = roots.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    if rest is not None:
        out = out.union(overlaps(rest, fetch(docs, pair_ids(rest), first)).filter(linked()).select("a", "b"))
    out = cut(out)
    release(near, found, tokens, group, deep_first, common, named, leaders, between, roots, *([rest] if rest is not None else []))
    return out


def asked(between: DataFrame, lead: DataFrame, described: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Pairs (a, b) of sets that the overlap of their leaders doesn't answer; None if there are none. roots: (node, root) of the links found."""
    open_ = between.filter(~linked())
    if open_.isEmpty():
        return None
    sizes = described.filter("n > 0").groupBy("sid").agg(F.max("n").alias("n"))
    own = lead.select("lead", "sid", "outside").union(lead.select(F.col("lead").alias("sid")).distinct().select(F.col("sid").alias("lead"), "sid", F.lit(0).cast("long").alias("outside")))
    led = cut(own.groupBy("lead", "sid").agg(F.min("outside").alias("outside")).join(sizes, "sid"))
    of = led.groupBy("lead").agg(F.max("outside").alias("most"), F.min("n").alias("least_n"), F.max("n").alias("most_n"))
    # A set that no other one leads to is a group of its own.
    for s in ("a", "b"):
        open_ = open_.join(roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")), s, "left")
        group = of.select(F.col("lead").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("most", "least_n", "most_n")))
        open_ = open_.join(group, s, "left").withColumns({f"most_{s}": F.coalesce(f"most_{s}", F.lit(0)), f"least_n_{s}": F.coalesce(f"least_n_{s}", f"n{s}"), f"most_n_{s}": F.coalesce(f"most_n_{s}", f"n{s}")})
    fits = lambda over, na, nb: (NUMERATOR + DENOMINATOR) * F.least(over, na, nb) >= needed(na, nb)
    near = lambda low_a, high_a, low_b, high_b: (NUMERATOR * F.col(low_a) <= DENOMINATOR * F.col(high_b)) & (NUMERATOR * F.col(low_b) <= DENOMINATOR * F.col(high_a))
    # Groups as wholes: the smallest sizes need the least overlap.
    room = (NUMERATOR + DENOMINATOR) * (F.col("overlap") + F.col("most_a") + F.col("most_b")) >= needed(F.col("least_n_a"), F.col("least_n_b"))
    open_ = open_.filter(F.col("root_a").isNull() | F.col("root_b").isNull() | (F.col("root_a") != F.col("root_b"))).filter(room & near("least_n_a", "most_n_a", "least_n_b", "most_n_b"))

    def with_members(pairs: DataFrame, s: str) -> DataFrame:
        of = led.select(F.col("lead").alias(s), F.col("sid").alias(f"sid_{s}"), F.col("n").alias(f"size_{s}"), F.col("outside").alias(f"outside_{s}"))
        return pairs.join(of, s, "left").withColumns({f"sid_{s}": F.coalesce(f"sid_{s}", s), f"size_{s}": F.coalesce(f"size_{s}", f"n{s}"), f"outside_{s}": F.coalesce(f"outside_{s}", F.lit(0))})

    room = (NUMERATOR + DENOMINATOR) * (F.col("overlap") + F.col("outside_a") + F.col("most_b")) >= needed(F.col("size_a"), F.col("least_n_b"))
    half = with_members(open_, "a").filter(room & near("size_a", "size_a", "least_n_b", "most_n_b"))
    both = with_members(half, "b").filter(fits(F.col("overlap") + F.col("outside_a") + F.col("outside_b"), F.col("size_a"), F.col("size_b")) & near("size_a", "size_a", "size_b", "size_b"))
    both = both.filter((F.col("sid_a") != F.col("a")) | (F.col("sid_b") != F.col("b")))
    rest = cut(both.select(F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b")).distinct())
    release(led)
    return None if rest.isEmpty() else rest


def _near(batches):
    """(a, b) of each row (band, sid, typical, low, high): its set with those three and with the set of the row before in its band."""
    last = None
    for b in batches:
        band, sid, *others = (b.column(i).to_numpy() for i in range(5))
        if not len(sid):
            continue
        before, of = np.concatenate((sid[:1], sid[:-1])), np.concatenate((band[:1], band[:-1]))
        if last is not None:
            before[0], of[0] = last[1], last[0]
        last = band[-1], sid[-1]
        pairs = np.concatenate([np.stack((sid, x), 1) for x in others] + [np.stack((sid, before), 1)[of == band]])
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _tokens(batches):
    """(token, sets): in how many sets of a task each shingle is; a task's counts are summed up to 2**18 shingles at a time."""

    def counted(parts):
        token, sets = np.unique(np.concatenate(parts), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token), pa.array(sets.astype(np.int64))], names=["token", "sets"])

    held, size = [], 0
    for b in batches:
        for x in b.column(2).to_pylist():
            held.append(np.frombuffer(x, np.int64))
            size += len(held[-1])
            if size > 1 << 18:
                yield counted(held)
                held, size = [], 0
    if held:
        yield counted(held)


def groups_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id) of each row of docs.

    Null, empty and wordless texts have no shingles and are their own component. Rows without an id take part; their
    component is the smallest id reached, null if there is none. Rows that share an id are one node.
    """
    described = cut(describe(docs))
    pick = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = cut(described.filter("n > 0").groupBy("sid").agg(F.min(pick).alias("x"), F.count(F.lit(1)).alias("rows"), F.count_distinct(pick).alias("different")).select("sid", F.col("x.doc_id").alias("rep"), F.col("x.text_key").alias("rep_key"), (F.col("rows") > F.col("different")).alias("several")))
    found = links(docs, described, first)
    reps = first.select("sid", "rep").filter("rep is not null")
    edges = found.join(reps.withColumnRenamed("sid", "a").withColumnRenamed("rep", "x"), "a").join(reps.withColumnRenamed("sid", "b").withColumnRenamed("rep", "y"), "b")
    # An id with several texts joins their sets.
    same = described.filter("n > 0 and doc_id is not null").select(F.col("doc_id").alias("b"), "sid").join(first, "sid").filter("rep <> b").groupBy("b").agg(F.min("rep").alias("a"), F.max("rep").alias("c"))
    twins = described.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(F.col("doc_id").alias("b")).join(same, "b")
    edges = edges.select(F.col("x").alias("a"), F.col("y").alias("b")).union(twins.select("a", "b")).union(twins.select(F.col("c").alias("a"), "b"))
    roots = components(edges)
    named = cut(first.select("sid", "rep").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("sid", F.coalesce("root", "rep").alias("component_id")))
    # A hot set is one row of named; the join is on the set.
    rows = described.select("doc_id", "text_key", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
    return rows.join(named, "sid", "left").select("doc_id", "text_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every document, linked at a Jaccard similarity of 0.85 of 4-word shingles."""
    return groups_of(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the smallest id; rows without an id stay, as do texts without words."""
    found = cut(groups_of(docs.select("doc_id", "text")))
    gone = cut(found.filter("component_id <> doc_id").select("doc_id", "text_key").distinct())
    few = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ident, key = fresh(docs, "ident", "key")
    gone = gone.select(F.col("doc_id").alias(ident), F.col("text_key").alias(key))
    out = docs.join(F.broadcast(gone) if few else gone, (F.col("doc_id") == F.col(ident)) & (text_key() == F.col(key)), "left_anti")
    if not found.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").isEmpty():
        some = out.filter("doc_id is null")
        out = out.filter("doc_id is not null").dropDuplicates(["doc_id"]).union(some)
    return out.select(*docs.columns)
