"""N-gram Jaccard join by PartEnum signatures.

Sets of word shingles whose sizes fall in one size band and whose Jaccard
similarity reaches num/den differ in at most k elements, k following from the
band.  The feature domain is partitioned by hash into n1 parts and each of these
into n2 parts of a second level.  Of the n1 = k // (k2 + 1) + 1 + E first-level
parts at least 1 + E hold no more than k2 differences, so two such sets agree on
n2 - k2 second-level parts there: a signature for each part and each way to leave
out k2 of its n2 second-level parts (the band, the choice and the sum of the
chosen parts' hashed features) makes every such pair share a bucket.  A choice
that is empty in both is no evidence, so empty choices give no signature while at
most E parts of a set have one; a set with more also emits those, which keeps the
guarantee.  `plan` picks (n2, k2) for each band by the expected cost.

A set has the signatures of its own band and of the bands of larger sets that it
can be similar to; a pair belongs to the band of its larger set, so two visitors
of a bucket are no candidates there.

Equal sets are one node from the start.  Signatures are worked off in slices of
the first-level parts, and the shuffles of a slice are freed before the next.
Candidates are verified on whole texts by their sets of 64-bit shingle hashes.  A
first round verifies each set against one leader of its buckets
and joins what links into components; the second takes every pair of a bucket
that still lies in different components and drops those that exact lower bounds
on the symmetric difference rule out: the sizes, and the distance of parity
sketches, in which every differing feature flips one bit.  Buckets where pairs
are left are worked off in three waves: the nearest pair of each set, the nearest
pairs of each set in each bucket, and all that still lie in
different components; pairs that a wave has joined need no check.  Buckets are
split into blocks of bounded size, so no task gathers an unbounded group, and no
link between different texts is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, every_salt, salt
from .words import mix, shingle_set, word_hashes
from .workspace import Workspace, join_ids, row_number

GROWTH = 1.5
#: Second-level parts, and how many of them a signature leaves out, to choose from.
SECOND = ((1, 0), (3, 1), *((n, k) for n in range(4, 13) for k in (1, 2, 3) if math.comb(n, k) <= 70))
#: Differences up to which every pair of SECOND is weighed; beyond, a set has too many parts for more than its first two.
FEW = 30
#: Share of the sets that may have more than E parts with an empty choice.
SPILL = 1e-3
#: Slices of the first-level parts whose signatures are shuffled at a time.
SLICES = 3
#: Bits of a parity sketch, at least and (in buckets) at most; a set has as many as it has features, rounded up to a power of two.
LEAST_BITS = 256
MOST_BITS = 4096
#: Members of a bucket that are compared with each other in one group.
BLOCK = 1024
#: Texts of one Arrow batch.
BATCH = 512
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _enough(mean: float) -> int:
    """The least count that a Poisson number of this mean exceeds in a share SPILL of the cases (four deviations for large means)."""
    if mean > 40:
        return int(mean + 4 * mean**0.5)
    term = total = math.exp(-mean)
    n = 0
    while 1 - total > SPILL:
        n += 1
        term *= mean / n
        total += term
    return n


def _spare(k: int, n2: int, k2: int, least: float) -> int | None:
    """E: parts beyond k // (k2 + 1) + 1, as many as have an empty choice in a set of `least` features; none if ever more parts are needed."""
    spare = 0
    while True:
        parts = k // (k2 + 1) + 1 + spare
        need = _enough(parts * min(1.0, math.comb(n2, k2) * (1 - (n2 - k2) / (parts * n2)) ** least))
        if need <= spare:
            return spare
        if spare > 3 * k + 3:
            return None
        spare = max(spare + 1, min(need, spare + spare // 32))


def plan(k: int, least: float, most: float) -> tuple[int, int, int, int]:
    """(n1, n2, k2, E) of a band: the fewest signatures, each weighed by how likely sets that share a quarter agree on it by chance."""
    best = None
    for n2, k2 in SECOND if k <= FEW else SECOND[:2]:
        spare = _spare(k, n2, k2, least) if k2 <= k else None
        if spare is None and (n2, k2) != (1, 0):
            continue
        spare = 3 * k + 3 if spare is None else spare
        n1 = k // (k2 + 1) + 1 + spare
        features = (least + most) / 2 / n1 * (n2 - k2) / n2
        cost = n1 * math.comb(n2, k2) * (1 + 50 * 0.25**features)
        if best is None or cost < best[0]:
            best = cost, (n1, n2, k2, spare)
    return best[1]


@lru_cache(maxsize=None)
def _bands(num: int, den: int) -> tuple[np.ndarray, list[tuple | None]]:
    """Upper sizes of the bands, and the plan of each; none where only equal sets are similar."""
    ups = [1]
    while ups[-1] < 1 << 34:
        ups.append(max(ups[-1] + 1, int(ups[-1] * GROWTH)))
    plans = []
    for j, up in enumerate(ups):
        k = 2 * up * (den - num) // (den + num)
        least = max(1.0, (ups[j - 1] + 1 if j else 1) * num / den)
        if not k:
            plans.append(None)
        elif up > 1 << 24:  # beyond any text of the tables: spares in proportion, planned without a search
            plans.append((k + 1 + int(0.35 * k), 1, 0, int(0.35 * k)))
        else:
            plans.append(plan(k, least, up))
    return np.array(ups), plans


@lru_cache(maxsize=None)
def _choices(n2: int, k2: int) -> np.ndarray:
    """A row of n2 zeros and ones for each way to keep n2 - k2 second-level parts."""
    return np.array([[int(i not in out) for i in range(n2)] for out in combinations(range(n2), k2)], np.uint64)


def signatures(s: np.ndarray, num: int, den: int, slices: int = 1, at: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """PartEnum signatures of a sorted distinct feature set, and whether each is of the set's own band; those of one slice of the parts."""
    m, none = len(s), np.zeros(0, np.uint64)
    ups, plans = _bands(num, den)
    if not m:
        return none, none.astype(bool)
    i = int(np.searchsorted(ups, m))
    bands = [i]
    while (ups[bands[-1]] + 1) * num <= den * m:
        bands.append(bands[-1] + 1)
    weight, place, out, own = mix(s ^ np.uint64(55)), s >> np.uint64(7), [none], [none.astype(bool)]
    for j in bands:
        if plans[j] is None:
            continue
        n1, n2, k2, spare = plans[j]
        part = (place % np.uint64(n1 * n2)).astype(np.int64)
        count = np.bincount(part, minlength=n1 * n2).reshape(n1, n2)
        total = np.zeros(n1 * n2, np.uint64)
        np.add.at(total, part, weight)
        keep = _choices(n2, k2)
        full = count @ keep.T.astype(np.int64) > 0
        sums = total.reshape(n1, n2) @ keep.T
        number = np.arange(sums.size, dtype=np.uint64).reshape(sums.shape)
        wanted = (full if n1 - int(full.all(1).sum()) <= spare else np.ones_like(full)) & (np.arange(n1) % slices == at)[:, None]
        out.append(mix(sums[wanted] + np.array([j], np.uint64) * _A + number[wanted] * _B))
        own.append(np.full(len(out[-1]), j == i))
    return np.concatenate(out), np.concatenate(own)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield batch.slice(at, BATCH)


def _bits(n: int) -> int:
    """The least power of two that is no less than the set, and LEAST_BITS at least."""
    return max(LEAST_BITS, 1 << (n - 1).bit_length())


def _parity(s: np.ndarray) -> np.ndarray:
    """Parity sketch of a set, packed."""
    bits = _bits(len(s))
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits).astype(np.uint8) & 1)


def _folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """Sketches (rows) of so many bytes: parities of the parts that come to lie on each other add up."""
    return np.bitwise_xor.reduce(sketch.reshape(len(sketch), -1, size), axis=1)


def _apart(x: bytes, y: bytes) -> int:
    """Features that differ at least; the longer sketch is folded, whose parities add up."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(a), len(b))
    return int(np.bitwise_count(_folded(a[None], n) ^ _folded(b[None], n)).sum(dtype=np.int64))


def _plausible(num: int, den: int):
    """Pairs (a, b) whose sizes and sketches leave room for a link."""

    def run(batches):
        for batch in _slices(batches):
            t = batch.to_pydict()
            good = []
            for m, n, x, y in zip(t["m"], t["n"], t["x"], t["y"], strict=True):
                limit = (m + n) * (den - num) // (den + num)
                good.append(abs(m - n) <= limit and _apart(x, y) <= limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _described(width: int, seed: int):
    """Size, key, check and sketches of each row's set; keys are even, their last bit marks members of a bucket."""
    salt = np.array([seed], np.uint64) * _A + np.uint64(1)

    def run(batches):
        for batch in _slices(batches):
            h, at = word_hashes(batch.column(1))
            size, key, check, sketch, long = [], [], [], [], []
            for i in range(batch.num_rows):
                s = shingle_set(h[at[i] : at[i + 1]], width)
                size.append(len(s))
                code = mix(s ^ salt)
                key.append(int((mix(code.sum(dtype=np.uint64) + salt * np.uint64(len(s)))).view(np.int64)[0]) & -2)
                check.append(int(np.bitwise_xor.reduce(mix(code + _B)).view(np.int64)) if len(s) else 0)
                bits = _parity(s)
                sketch.append((bits if len(bits) <= MOST_BITS // 8 else _folded(bits[None], MOST_BITS // 8)).tobytes())
                long.append(bits.tobytes() if len(bits) > MOST_BITS // 8 else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(size, pa.int64()), pa.array(key, pa.int64()), pa.array(check, pa.int64()), pa.array(sketch, pa.binary()), pa.array(long, pa.binary())],
                names=["doc_id", "row", "n_shingles", "key", "check", "sketch", "long"],
            )

    return run


def _signed(width: int, num: int, den: int, seed: int, at: int):
    """(sig, member) of each row's signatures of one slice; a member is the key, with its last bit set in the set's own band."""
    salt = np.array([seed], np.uint64) * _A + np.uint64(1)

    def run(batches):
        for batch in _slices(batches):
            h, ends = word_hashes(batch.column(0))
            sigs, members = [], []
            for i in range(batch.num_rows):
                s = shingle_set(h[ends[i] : ends[i + 1]], width)
                sig, own = signatures(s, num, den, SLICES, at)
                if len(sig):
                    key = mix(mix(s ^ salt).sum(dtype=np.uint64) + salt * np.uint64(len(s))).view(np.int64)[0] & -2
                    sigs.append(sig.view(np.int64))
                    members.append(key | own.astype(np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs)), pa.array(np.concatenate(members))], names=["sig", "member"])

    return run


def _verified(width: int, num: int, den: int):
    def run(batches):
        for batch in _slices(batches):
            ha, at = word_hashes(batch.column(2))
            hb, bt = word_hashes(batch.column(3))
            good = []
            for i in range(batch.num_rows):
                x, y = shingle_set(ha[at[i] : at[i + 1]], width), shingle_set(hb[bt[i] : bt[i + 1]], width)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _compared(num: int, den: int, nearest: bool):
    """Pairs of one group (sig, first, second) in different components that no exact bound rules out, and the bound.

    With `nearest` each row gives its nearest partner alone.  Rows come sorted by group; a group holds at most about two blocks.  All groups
    of a batch are compared together: each row with the one `step` places on.
    """

    def pairs(t: pa.Table) -> pa.RecordBatch:
        sig, first, second, part, member, root, size = (t[c].to_numpy() for c in ("sig", "first", "second", "part", "member", "root", "n_shingles"))
        raw = t["sketch"].to_pylist()
        length = np.array([len(x) for x in raw])
        new = np.append(True, (sig[1:] != sig[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1]))
        group = np.cumsum(new) - 1
        narrow = np.minimum.reduceat(length, np.flatnonzero(new))[group]
        left, right, far = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for width in np.unique(narrow).tolist():
            here = np.flatnonzero(narrow == width)
            sketch = np.empty((len(here), width // 8), np.uint64)
            for n in np.unique(length[here]).tolist():
                some = np.flatnonzero(length[here] == n)
                rows = np.frombuffer(b"".join([raw[i] for i in here[some].tolist()]), np.uint64).reshape(len(some), -1)
                sketch[some] = _folded(rows, width // 8)
            rows, step = np.arange(len(here)), 0
            while True:
                step += 1
                rows = rows[rows + step < len(here)]
                rows = rows[group[here[rows + step]] == group[here[rows]]]
                if not len(rows):
                    break
                i, j = here[rows], here[rows + step]
                limit = (size[i] + size[j]) * (den - num) // (den + num)
                ok = (root[i] != root[j]) & (np.abs(size[i] - size[j]) <= limit) & ((first[i] == second[i]) | (part[i] != part[j])) & ((member[i] | member[j]) & 1 == 1)
                i, j, limit = i[ok], j[ok], limit[ok]
                least = np.bitwise_count(sketch[rows[ok]] ^ sketch[rows[ok] + step]).sum(1, dtype=np.int64)
                ok = least <= limit
                left.append(i[ok])
                right.append(j[ok])
                far.append(least[ok] / np.maximum(limit[ok], 1))
        i, j, far = np.concatenate(left), np.concatenate(right), np.concatenate(far)
        if nearest and len(i):
            node, order = np.concatenate((i, j)), np.concatenate((far, far))
            by = np.lexsort((order, node))
            head = by[np.append(True, node[by][1:] != node[by][:-1])]
            pick = np.unique(head % len(i))
            i, j, far = i[pick], j[pick], far[pick]
        a, b = member[i] & -2, member[j] & -2
        return pa.RecordBatch.from_arrays([pa.array(sig[i]), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(far)], names=["sig", "a", "b", "far"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 20_000:
                continue
            tail = [held[c].combine_chunks() for c in ("sig", "first", "second")]
            same = np.logical_and.reduce([c.to_numpy() == c[-1].as_py() for c in tail])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield pairs(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield pairs(held.combine_chunks())

    return run


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", rows: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: components of the links with Jaccard >= num/den.

    Texts are lower-cased in A-Z and cut into words; a text with fewer words than
    `width` has its whole sequence as one shingle.  Null or wordless texts have
    n_shingles 0 and link with nothing, not even with each other.  Rows that
    repeat a doc_id come back as often as they occur.  Ties cannot arise: a
    component is named by its least doc_id, which is null where none of its rows has one.
    Rows of one doc_id with different texts link by their own text.  Other columns
    are ignored.  With `rows`, two columns more: row_number of the row and the number
    of its component, whatever their doc_id is (null without words).
    """
    spark = docs.sparkSession
    work = Workspace(spark, "jaccard")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    slim = slim.withColumn("row", row_number("doc_id", "text"))
    for seed in range(8):
        table = work.keep(slim.mapInArrow(_described(width, seed), "doc_id long, row long, n_shingles long, key long, check long, sketch binary, long binary"), f"sets-{seed}")
        nodes = table.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("row").alias("row"), F.max("n_shingles").alias("n_shingles"), F.min("sketch").alias("sketch"), F.min("long").alias("long"), F.min("check").alias("lo"), F.max("check").alias("hi"), F.min("n_shingles").alias("least"))
        nodes = work.keep(nodes, f"nodes-{seed}")
        if nodes.where("lo <> hi or least <> n_shingles").isEmpty():
            break  # no two different sets share a 63-bit key
    else:
        raise RuntimeError("keys of different sets collided under every seed")
    slim_sets = work.keep(table.select("doc_id", "row", "n_shingles", "key"), "documents")
    work.drop(*(f"sets-{i}" for i in range(seed + 1)))
    work.free()
    live = None
    for at in range(SLICES):
        sigs = work.keep(slim.select("text").mapInArrow(_signed(width, num, den, seed, at), "sig long, member long"), f"sigs-{at}")
        key = F.col("member").bitwiseAND(F.lit(-2))
        # pre-aggregated in the map tasks, so a signature that very many sets share comes as one row of each
        shared = sigs.groupBy("sig").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.min(F.when(F.col("member") % 2 != 0, key)).alias("leader"))
        shared = work.keep(shared.where("lo <> hi and leader is not null").select("sig", "leader"), f"shared-{at}")
        work.free()
        # both sides are tables, so a signature of very many sets is split by adaptive execution
        now = work.keep(sigs.join(shared, "sig").distinct(), f"live-{at}")
        work.drop(f"sigs-{at}", f"shared-{at}")
        work.free()
        live = now if live is None else live.unionByName(now)

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        """Sketches, a fiftieth of the texts, rule pairs out before texts are moved; only texts of pairs that are left are."""
        side = lambda k, size, sketch: nodes.select(F.col("key").alias(k), F.col("n_shingles").alias(size), F.coalesce("long", "sketch").alias(sketch))
        pairs = pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y").mapInArrow(_plausible(num, den), "a long, b long")
        pairs = work.keep(pairs, f"pairs-{name}")
        needed = work.keep(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(nodes.select("key", "row"), "key"), f"needed-{name}")
        texts = work.keep(join_ids(slim.select("row", "text"), needed, "row", needed.count()).dropDuplicates(["key"]).select("key", "text"), f"texts-{name}")
        a, b = texts.select(F.col("key").alias("a"), F.col("text").alias("x")), texts.select(F.col("key").alias("b"), F.col("text").alias("y"))
        return pairs.join(a, "a").join(b, "b").select("a", "b", "x", "y").mapInArrow(_verified(width, num, den), "a long, b long")

    def freed(name: str) -> None:
        work.drop(*(f"{x}-{name}" for x in ("pairs", "needed", "texts")))

    first = live.withColumn("key", F.col("member").bitwiseAND(F.lit(-2))).where("key <> leader").groupBy("key").agg(F.min("leader").alias("b")).select(F.col("key").alias("a"), "b")
    links = work.keep(verify(first, "0"), "links-0")
    freed("0")
    roots = work.keep(components(links, work, "stars"), "roots-0")
    work.drop("stars")

    def grouped(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """Members of buckets that span components, in blocks, sorted by group."""
        keyed = rows.select("sig", "member", F.col("member").bitwiseAND(F.lit(-2)).alias("key"))
        labelled = keyed.join(roots.withColumnRenamed("node", "key"), "key", "left").select("sig", "member", "key", F.coalesce("root", "key").alias("root"))
        mixed = labelled.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("sig", (F.ceil(F.col("n") / BLOCK)).cast("int").alias("parts"))
        split = labelled.join(mixed, "sig").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        pairs_of = F.expr("transform(sequence(0, parts - 1), x -> struct(least(x, part) as first, greatest(x, part) as second))")
        split = split.withColumn("with", F.explode(pairs_of)).select("sig", "member", "key", "root", "part", "with.first", "with.second")
        return split.join(nodes.select("key", "n_shingles", "sketch"), "key").drop("key").repartition("sig", "first", "second").sortWithinPartitions("sig", "first", "second")

    kinds = "sig long, a long, b long, far double"

    def add(pairs: DataFrame, wave: int) -> None:
        nonlocal links, roots
        links = work.keep(verify(pairs, str(wave)).unionByName(links), f"links-{wave}")
        freed(str(wave))
        roots = work.keep(components(links, work, f"wave-{wave}"), f"roots-{wave}")
        work.drop(f"wave-{wave}")

    def apart(pairs: DataFrame) -> DataFrame:
        of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(~F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))).select(*pairs.columns)

    near = work.keep(grouped(live, roots).mapInArrow(_compared(num, den, True), kinds), "near")
    work.free()
    if not near.isEmpty():
        best = near.groupBy("a", "b").agg(F.min("far").alias("far"))
        sides = best.select("a", "b", "far", F.col("a").alias("node")).unionByName(best.select("a", "b", "far", F.col("b").alias("node")))
        add(work.keep(sides.groupBy("node").agg(F.min(F.struct("far", "a", "b")).alias("x")).select("x.a", "x.b").distinct(), "chosen-1"), 1)
        add(work.keep(apart(near.select("a", "b").distinct()), "chosen-2"), 2)
        again = live.join(near.select("sig").distinct(), "sig", "left_semi")
        rest = grouped(again, roots).mapInArrow(_compared(num, den, False), kinds).select("a", "b").distinct()
        rest = work.keep(rest, "chosen-3")
        work.free()
        add(rest, 3)
    joined = nodes.select("key", "rep").join(roots.withColumnRenamed("node", "key"), "key")
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    # a component may hold very many sets: its name is dealt to several tasks
    named = joined.withColumn("salt", salt("key")).join(least.withColumn("salt", every_salt()), ["root", "salt"]).select("key", "component_id", "root")
    named = work.keep(named, "named")
    alone = nodes.select("key", F.col("rep").alias("own"))
    of_key = work.keep(alone.join(named, "key", "left").select("key", F.when(F.col("root").isNull(), F.col("own")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("root", "key").alias("root")), "of_key")
    out = work.keep(slim_sets.join(of_key, "key", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *(["row", F.when(F.col("n_shingles") > 0, F.col("root")).alias("root")] if rows else [])), "out")
    work.drop(*(f"nodes-{i}" for i in range(seed + 1)), *(f"live-{i}" for i in range(SLICES)), "documents", "near", "named", "of_key")
    work.drop(*(f"{name}-{i}" for name in ("links", "roots", "chosen") for i in range(4)))
    return out


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Contract query: 4-word shingles, links where 100 * intersection >= 85 * union."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, num=85, den=100)
