"""Language-model scoring with a weighted backoff automaton.

Every bigram and trigram of the training texts counts, at any size.  The states
are contexts of two words, of one and the root; a state has an arc per n-gram
seen there, weighted with its discounted log-probability, and a failure arc
weighted with its backoff.  As the automaton grows with its texts, it is dealt
over tasks by the last word of a state: a transition from the context (u, v) by
w, its failure to (v) and the arcs there all lie in the part of v, as do the
counts they are made of, so a part is built and walked in one go.  What fails to
the root needs exact counts of words: frequent ones are broadcast, others joined.
A word of more transitions than a part may have gets several parts, dealt by u;
each of them then also gets the word's bigram counts.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mix, word_hashes
from .workspace import Workspace

#: Least share of the training tokens of words that are broadcast; the counts of the others are joined.
WORD_SHARE = 1e-6
DISCOUNT = 0.75
#: Taken off each word's count for the unknown word.
ROOT_DISCOUNT = 0.5
END = np.uint64(0x454E44)
#: Symbols of the start of a row and of what precedes it; others are ids of broadcast words and hashes of the rest.
START, BEFORE = -1, -2
#: Transitions of a part, about.
PART = 1_000_000
#: Rounds in which the parts are dealt and walked, so that the transitions of one round lie on disk at a time; each reads the texts anew.
ROUNDS = 2
#: Transitions of a part that are walked at a time, about: what a walk holds is some forty arrays of them.
SLICE = 200_000
_FLUSH = 4_000_000
#: Transitions that are packed together.
_BLOCK = 1_000_000


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each row with END after each, and the rows' offsets."""
    h, at = word_hashes(column)
    return _signed(np.insert(h, at[1:], END)), at + np.arange(len(at))


def _counted(batches):
    """(h, n): counts of tokens, gathered over some millions at a time."""
    held, n = [], 0

    def flush():
        h, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(c, pa.int64())], names=["h", "n"])

    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            t, _ = _tokens(whole.slice(at, 512).column(0))
            held.append(t)
            n += len(t)
            if n >= _FLUSH:
                yield flush()
                held, n = [], 0
    if n:
        yield flush()


class Vocabulary:
    """The frequent words in ascending order of hash; ids follow their frequency, END included."""

    def __init__(self, h: np.ndarray, c: np.ndarray, total: int):
        order = np.lexsort((h, -c))
        self.count = c[order]
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        by = np.argsort(h)
        self.h, self.id, self._slots = h[by], rank[by], None
        self.total = total
        self.p = (self.count - ROOT_DISCOUNT) / max(1, total)
        self.parts = max(1, math.ceil(total / PART))
        #: Parts of the words that have several, which come first by id, and the number of the first of them.
        end = self.ids(_signed(np.array([END])))[0]
        several = np.ceil(2 * self.count[self.count > PART] / PART).astype(np.int64)
        if 0 <= end < len(several):
            several[end] = 0
        self.several, self.first = several, self.parts + np.cumsum(several) - several

    def wide(self, v: np.ndarray) -> np.ndarray:
        """Which symbols are words of several parts; nothing follows the end token."""
        few = (v >= 0) & (v < len(self.several))
        few[few] = self.several[v[few]] > 0
        return few

    def __getstate__(self):
        return self.__dict__ | {"_slots": None}

    def _table(self) -> tuple[np.uint64, np.ndarray, np.ndarray]:
        """A word by the first bits of its hash, the most frequent one of those that share them; made in each worker."""
        if self._slots is None:
            bits = (2 * len(self.h)).bit_length()
            shift, words, ids = np.uint64(64 - bits), np.zeros(1 << bits, np.int64), np.full(1 << bits, -1, np.int32)
            order = np.argsort(-self.id)
            at = self.h[order].view(np.uint64) >> shift
            words[at], ids[at] = self.h[order], self.id[order]
            self._slots = shift, words, ids
        return self._slots

    def ids(self, t: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.full(len(t), -1, np.int64)
        shift, words, ids = self._table()
        at = t.view(np.uint64) >> shift
        found = np.where(words[at] == t, ids[at], -1).astype(np.int64)
        rest = np.flatnonzero(found < 0)
        at = np.minimum(np.searchsorted(self.h, t[rest]), len(self.h) - 1)
        found[rest] = np.where(self.h[at] == t[rest], self.id[at], -1)
        return found

    def frequent(self, w: np.ndarray) -> np.ndarray:
        return (w >= 0) & (w < len(self.count))


def _packed(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed: small ones and sorted ones take little room."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), codec="zstd", asbytes=True)


def _unpacked(b: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


#: Transitions of a part in a block; without `v`, the numbers of the block's rows in `w`; without `at`, bigram counts of a word in `u`.
_MOVES = "part long, n long, block long, u binary, v binary, w binary, at binary"
_KINDS = [pa.int64()] * 3 + [pa.binary()] * 4


def _blobs(rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=[x.split()[0] for x in _MOVES.split(", ")])


def _moves(vocabulary: Vocabulary, turn: int = 0, rounds: int = 1):
    """Transitions (u, v, w) of each row of (row, use, text), dealt by v; use is 1 for training, 2 for scoring, 3 for both.

    Only the parts of one round; each round numbers the rows on its own, as they need not come in the same order again.
    """

    def run(batches):
        from pyspark import TaskContext

        block = ((TaskContext.get().partitionId() if TaskContext.get() else 0) * rounds + turn) << 40
        held, n, numbers = [], 0, []

        def flush():
            u, v, w, at = (np.concatenate(x) for x in zip(*held, strict=True))
            key = mix(v.view(np.uint64))
            part = ((key >> np.uint64(32)) * np.uint64(vocabulary.parts) >> np.uint64(32)).astype(np.int64)
            wide = vocabulary.wide(v)
            if wide.any():
                x = v[wide]
                part[wide] = vocabulary.first[x] + (mix(u[wide].view(np.uint64)) % vocabulary.several[x].astype(np.uint64)).astype(np.int64)
                key[wide] = part[wide].astype(np.uint64)
                key[~wide] |= np.uint64(1 << 63)
                key[~wide] = part[~wide].astype(np.uint64) << np.uint64(40) | key[~wide] & np.uint64((1 << 40) - 1) | np.uint64(1 << 63)
            mine = np.flatnonzero(part % rounds == turn)
            order = mine[np.argsort(key[mine])]
            u, v, w, at, part = u[order], v[order], w[order], at[order], part[order]
            first = np.flatnonzero(_starts(part))
            out = [(part[lo], hi - lo, block, _packed(u[lo:hi]), _packed(v[lo:hi]), _packed(w[lo:hi]), _packed(at[lo:hi])) for lo, hi in zip(first, np.r_[first[1:], len(part)][: len(first)], strict=True)]
            own = np.concatenate(numbers)
            return _blobs([*out, ((block >> 20) % vocabulary.parts, len(own), block, None, None, _packed(own), None)])

        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                batch = whole.slice(i, 512)
                t, to = _tokens(batch.column(2))
                ids = vocabulary.ids(t)
                s = np.insert(np.where(ids >= 0, ids, t), to[:-1], START)
                at = np.repeat(np.arange(batch.num_rows), np.diff(to) + 1)
                inner = np.flatnonzero(at[1:] == at[:-1]) + 1
                u = np.where(s[inner - 1] == START, BEFORE, s[inner - 2])
                use = batch.column(1).to_numpy(zero_copy_only=False)
                local = (at[inner] + sum(map(len, numbers))) << 2 | use[at[inner]]
                held.append((u, s[inner - 1], s[inner], local.astype(np.int32)))
                numbers.append(batch.column(0).to_numpy(zero_copy_only=False))
                n += len(inner)
                if n >= _BLOCK:
                    yield flush()
                    held, n, numbers = [], 0, []
                    block += 1 << 20
        if n:
            yield flush()

    return run


def _pairs(vocabulary: Vocabulary):
    """(v, w, n): counts of bigrams of the words that have several parts."""

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                t, to = _tokens(whole.slice(i, 4096).column(0))
                ids = vocabulary.ids(t)
                s = np.where(ids >= 0, ids, t)
                at = np.flatnonzero(vocabulary.wide(s))
                v, w = s[at], s[at + 1]
                order = np.lexsort((w, v))
                v, w = v[order], w[order]
                first = np.flatnonzero(_starts(v, w))
                yield pa.RecordBatch.from_arrays([pa.array(v[first]), pa.array(w[first]), pa.array(np.diff(np.r_[first, len(v)]))], names=["v", "w", "n"])

    return run


def _told(vocabulary: Vocabulary, turn: int = 0, rounds: int = 1):
    """Bigram counts (v, w, c) for every part of their words that is in the round."""

    def run(batches):
        for batch in batches:
            v, w, c = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            for x in np.unique(v):
                w_x, c_x = w[v == x], c[v == x]
                packed = _packed(c_x), _packed(np.array([x])), _packed(w_x)
                parts = vocabulary.first[x] + np.arange(vocabulary.several[x])
                if (parts := parts[parts % rounds == turn]).size:
                    yield _blobs([(k, len(w_x), 0, *packed, None) for k in parts])

    return run


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _order(*keys: tuple[np.ndarray, int]) -> np.ndarray:
    """Order by several keys below the given numbers, by one product of them where 64 bits hold it."""
    if math.prod(n for _, n in keys) >= 1 << 63:
        return np.lexsort([k for k, _ in reversed(keys)])
    whole = np.zeros(len(keys[0][0]), np.int64)
    for k, n in keys:
        whole = whole * n + k
    return np.argsort(whole)


def _sums(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    return np.bincount(group, x)


#: What a part gives: 0 weight x of a row, 1 word of a row scored at the root, 2 word whose failure arc a row takes,
#: 5 number h of a row, 3 state of a word (x: the root's share of frequent words seen there, y: mass left for others), 4 infrequent word seen there.
_STEPS = "kind int, row long, v long, h long, times long, x double, y double"


def _slices(u, v, w, use, told):
    """(places, told) of walks that make up a part: all of some words, or, of a word of more transitions than a slice has, all from some contexts.

    `told` has what a word's bigrams count (words, counts), all there are of the word and whether the walk answers
    for its state; it is given where a part has a word in part, and counted here for a word of several walks.
    """
    order = np.argsort(v)
    first = np.flatnonzero(_starts(v[order]))
    last = np.r_[first[1:], len(v)]
    large = last - first > SLICE

    def some(lo, hi):
        i = 0
        while i < len(lo):
            j = max(i + 1, int(np.searchsorted(hi, lo[i] + SLICE, "right")))
            yield lo[i], hi[j - 1]
            i = j

    if not told:
        small = np.flatnonzero(~large)
        for run in np.split(small, np.flatnonzero(np.diff(small) > 1) + 1):
            for lo, hi in some(first[run], last[run]):
                yield order[lo:hi], None
    for k in range(len(first)) if told else np.flatnonzero(large):
        of, tell = order[first[k] : last[k]], told
        if not told:
            known, c = np.unique(w[of[(use[of] & 1) > 0]], return_counts=True)
            tell = known, c, c.sum(), len(c) > 0
        if v[of[0]] == START:  # without contexts before it, each transition is on its own
            at = np.arange(len(of))
        else:
            of = of[np.argsort(u[of])]
            at = np.flatnonzero(_starts(u[of]))
        for lo, hi in some(at, np.r_[at[1:], len(of)]):
            yield of[lo:hi], tell
            tell = (*tell[:3], False)


def _walk(vocabulary: Vocabulary, u, v, w, row, use, told):
    """Arrays of _STEPS of one slice's transitions; `told` as _slices gives it."""
    (words, v), (before, u), (after, w) = (np.unique(x, return_inverse=True) for x in (v, u, w))
    order = _order((v, len(words)), (u, len(before)), (w, len(after)))
    u, v, w, row, use = u[order], v[order], w[order], row[order], use[order]
    new2, new3 = _starts(v, u), _starts(v, u, w)
    third = np.cumsum(new3) - 1
    first3 = np.flatnonzero(new3)
    c3 = _sums(use & 1, third)
    one, two, after3 = v[first3], (np.cumsum(new2) - 1)[first3], w[first3]
    u3, v3, w3 = before[u[first3]], words[one], after[after3]
    c_uv, c_v, n_uv = _sums(c3, two)[two], _sums(c3, one), _sums(c3 > 0, two)[two]
    # bigrams (v, w) over all u
    by = _order((one, len(words)), (after3, len(after)))
    new = _starts(one[by], after3[by])
    pair = np.empty(len(by), np.int64)
    pair[by] = np.cumsum(new) - 1
    first = by[new]
    c_vw = _sums(c3, pair)
    pair_one, pair_w = one[first], w3[first]
    if told:
        known, c_known, c_one, lead = told
        at = np.minimum(np.searchsorted(known, pair_w), len(known) - 1)
        c_vw = np.where(known[at] == pair_w, c_known[at], 0).astype(float) if len(known) else np.zeros(len(pair_w))
        c_v = np.full(len(words), c_one, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        p2 = np.where(c_vw > 0, (c_vw - DISCOUNT) / c_v[pair_one], 0.0)
        lower = _sums(np.where(c3 > 0, p2[pair], 0.0), two)[two]
        fail = np.log10(DISCOUNT * n_uv / c_uv) - np.log10(np.maximum(1e-12, 1 - lower))
        fail = np.where((c_uv > 0) & (u3 != BEFORE), fail, 0.0)
        arc = np.log10((c3 - DISCOUNT) / c_uv)
        low = np.log10(p2)[pair]
    seen2 = (c_vw > 0)[pair]
    frequent = vocabulary.frequent(w3)
    root = np.full(len(w3), 0.0)
    root[frequent] = np.log10(np.maximum(vocabulary.p[w3[frequent]], 1e-300))
    weight = np.where((c3 > 0) & (u3 != BEFORE), arc, fail + np.where(seen2, low, root))
    scored = (use & 2) > 0
    k, r = third[scored], row[scored]
    own, at = np.unique(r, return_inverse=True)
    out = [(0, own, 0, 0, 0, np.bincount(at, weight[k], len(own)), 0.0)]

    def times(mask, value, kind):
        pick = mask[k]
        who, what = r[pick], value[k[pick]]
        by = np.lexsort((what, who))
        who, what = who[by], what[by]
        first = np.flatnonzero(_starts(who, what))
        n = np.diff(np.r_[first, len(who)])
        out.append((kind, who[first], what[first] if kind == 2 else 0, what[first] if kind == 1 else 0, n, 0.0, 0.0))

    times(~seen2 & ~frequent, w3, 1)
    missed = ~seen2 & (c_v > 0)[one]
    times(missed, v3, 2)
    # states of the words that some scored row fails from
    asked = np.zeros(len(c_v), bool)
    asked[one[k[missed[k]]]] = True
    if told:
        # the first part of a word answers for all of them
        asked[:] = lead
        pair_one, pair_w, c_vw = np.zeros(len(known), np.int64), known, c_known
    keep = asked[pair_one] & (c_vw > 0)
    hot = vocabulary.frequent(pair_w)
    mass = np.zeros(len(pair_w))
    mass[hot] = vocabulary.p[pair_w[hot]]
    below = np.bincount(pair_one, np.where(keep, mass, 0.0), len(c_v))
    kinds = np.bincount(pair_one, keep, len(c_v))
    with np.errstate(divide="ignore", invalid="ignore"):
        left = DISCOUNT * kinds / c_v
    out.append((3, 0, words[asked], 0, 0, below[asked], left[asked]))
    rare = keep & ~hot
    out.append((4, 0, words[pair_one[rare]], pair_w[rare], 0, 0.0, 0.0))
    return out


def _steps(vocabulary: Vocabulary):
    """Rows of _STEPS from all blobs of the parts of a task, which come sorted by part."""
    names = [x.split()[0] for x in _STEPS.split(", ")]
    kinds = [np.int32, np.int64, np.int64, np.int64, np.int64, np.float64, np.float64]

    def table(block):
        n = max(np.size(x) for x in block[1:])
        if any(np.ndim(x) and len(x) == 0 for x in block):
            n = 0
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(x, k), n).copy()) for x, k in zip(block, kinds, strict=True)], names=names)

    def run(batches):
        weights, part, blobs, told = [], None, [], []

        def done():
            if not blobs:
                return
            columns, arrays = list(zip(*blobs, strict=True)), []
            blobs.clear()
            while columns:
                arrays.append(np.concatenate(columns.pop(0)))
            u, v, w, row, use = arrays
            tell = None
            if part >= vocabulary.parts:
                lead = part in vocabulary.first
                known, c = (np.concatenate(x) for x in zip(*told, strict=True)) if told else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                if not lead:
                    mine = np.isin(known, w)
                    known, c = known[mine], c[mine]
                order = np.argsort(known)
                tell = known[order], c[order], vocabulary.count[v[0]], lead
            for at, tell in _slices(u, v, w, use, tell):
                head, *rest = _walk(vocabulary, u[at], v[at], w[at], row[at], use[at], tell)
                weights.append((head[1], head[5]))
                if len(weights) > 8:
                    weights[:] = [_merged(weights)]
                for block in rest:
                    out = table(block)
                    if out.num_rows:
                        yield out

        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.slice(i, 1).to_pylist()[0]
                if b["part"] != part:
                    yield from done()
                    part, blobs, told = b["part"], [], []
                n, block = b["n"], b["block"]
                w = _unpacked(b["w"], n, np.int64)
                if b["v"] is None:
                    yield table((5, block + np.arange(n), 0, w, 0, 0.0, 0.0))
                elif b["at"] is None:
                    told.append((w, _unpacked(b["u"], n, np.int64)))
                else:
                    at = _unpacked(b["at"], n, np.int32)
                    blobs.append((_unpacked(b["u"], n, np.int64), _unpacked(b["v"], n, np.int64), w, np.int64(block) + (at >> 2), (at & 3).astype(np.uint8)))
        yield from done()
        if weights:
            row, x = _merged(weights)
            yield table((0, row, 0, 0, 0, x, 0.0))

    return run


def _merged(weights):
    row, at = np.unique(np.concatenate([r for r, _ in weights]), return_inverse=True)
    return row, np.bincount(at, np.concatenate([x for _, x in weights]), len(row))


def _rows(vocabulary: Vocabulary, distinct: int):
    """Rows of a batch: what the frequent words give, and the rare ones left for the join."""
    floor = 0.1 * (distinct + 1) + vocabulary.total
    base = np.log10((vocabulary.count + 0.1) / floor) if len(vocabulary.count) else np.zeros(0)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                t, to = _tokens(batch.column(2))
                w = vocabulary.ids(t)
                out = {k: [] for k in ("n", "known", "base", "h", "times")}
                for i in range(batch.num_rows):
                    own = w[to[i] : to[i + 1]]
                    hot = own[own >= 0]
                    rare, times = np.unique(t[to[i] : to[i + 1]][own < 0], return_counts=True)
                    for k, v in (("n", len(own)), ("known", len(hot)), ("base", float(base[hot].sum())), ("h", rare), ("times", times)):
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(out["n"], pa.int64()), pa.array(out["known"], pa.int64()), pa.array(out["base"], pa.float64()), pa.array(out["h"], pa.list_(pa.int64())), pa.array(out["times"], pa.list_(pa.int64()))],
                    names=["row", "doc_id", "n_tokens", "known", "base", "h", "times"],
                )

    return run


def lm_scores(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row of `docs`, learning from `training`.

    Null texts are empty and hold the end token alone.  Without training rows every
    token is the unknown one: it has all probability in `score`, and c = 0 in
    `base_score`.  Repeated rows count and score one by one; other columns are
    ignored.
    """
    text = F.col(text_col).cast("string").alias("text")
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), text, F.lit(2).alias("use"))
    return _scores(scored.unionByName(training.select(F.lit(None).cast("long").alias("doc_id"), text, F.lit(1).alias("use"))))


def _scores(texts: DataFrame) -> DataFrame:
    """lm_scores of rows (doc_id, text, use), where use is 1 for training, 2 for scoring, 3 for both."""
    spark = texts.sparkSession
    work = Workspace(spark, "lm")
    # equal rows share a number and so one score; their sums are divided by their number
    texts = texts.withColumn("row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    train = texts.where(F.col("use").bitwiseAND(1) > 0).select("text")
    counts = work.keep(train.mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "counts")
    work.free()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    least = max(2, math.ceil(WORD_SHARE * total))
    hot = counts.where(F.col("c") >= least).toArrow()
    vocabulary = Vocabulary(hot["h"].to_numpy(), hot["c"].to_numpy(), total)
    pairs, walks = None, []
    if len(vocabulary.several):
        pairs = work.keep(train.mapInArrow(_pairs(vocabulary), "v long, w long, n long").groupBy("v", "w").agg(F.sum("n").alias("c")), "pairs")
    for turn in range(ROUNDS):
        moves = texts.select("row", "use", "text").mapInArrow(_moves(vocabulary, turn, ROUNDS), _MOVES)
        if pairs:
            moves = moves.unionByName(pairs.mapInArrow(_told(vocabulary, turn, ROUNDS), _MOVES))
        moves = moves.repartition("part").sortWithinPartitions("part")
        walks.append(work.keep(moves.mapInArrow(_steps(vocabulary), _STEPS), f"steps{turn}"))
        del moves
        work.free()
    steps = reduce(DataFrame.unionByName, walks)
    kind = lambda k: steps.where(F.col("kind") == k)
    slim = texts.where(F.col("use").bitwiseAND(2) > 0).select("row", "doc_id", "text")
    part = work.keep(slim.mapInArrow(_rows(vocabulary, distinct), "row long, doc_id long, n_tokens long, known long, base double, h array<long>, times array<long>"), "part")
    floor = 0.1 * (distinct + 1) + total
    n = F.lit(float(max(1, total)))
    c = F.coalesce("c", F.lit(0))
    few = counts.where(F.col("c") < least)
    none, zero = F.lit(0).cast("long"), F.lit(0.0)
    rare = part.where(F.size("h") > 0).select("row", F.explode(F.arrays_zip("h", "times")).alias("x")).select("row", "x.h", "x.times")
    root = F.when(c > 0, F.log10((c - F.lit(ROOT_DISCOUNT)) / n)).otherwise(F.lit(math.log10(ROOT_DISCOUNT * distinct / total if total else 1.0)))
    met = rare.join(few, "h", "left").select("row", (F.col("times") * F.log10((c + F.lit(0.1)) / F.lit(floor))).alias("base2"), F.when(c > 0, F.col("times")).otherwise(none).alias("known2"), zero.alias("score"), none.alias("copies"))
    at_root = kind(1).select("row", "h", "times").join(few, "h", "left").select("row", (F.col("times") * root).alias("x"))
    # weights of the failure arcs to the root
    seen = kind(4).select("v", "h").join(few, "h").groupBy("v").agg(F.sum((F.col("c") - F.lit(ROOT_DISCOUNT)) / n).alias("more"))
    lower = F.col("x") + F.coalesce("more", zero)
    fail = F.log10("y") - F.log10(F.greatest(F.lit(1e-12), 1 - lower))
    states = work.keep(kind(3).select("v", "x", "y").join(seen, "v", "left").select("v", fail.alias("fail")), "states")
    work.free()
    frequent = F.col("v").between(START, len(vocabulary.count) - 1)
    uses = kind(2).select("row", "v", "times")
    # frequent words are bounded in number and broadcast; the others have few rows each
    failed = uses.where(frequent).join(F.broadcast(states.where(frequent)), "v").unionByName(uses.where(~frequent).join(states.where(~frequent), "v"))
    walked = kind(0).select("row", "x").unionByName(at_root).unionByName(failed.select("row", (F.col("times") * F.col("fail")).alias("x"))).groupBy("row").agg(F.sum("x").alias("x"))
    walked = walked.join(kind(5).select("row", F.col("h").alias("number")), "row").select(F.col("number").alias("row"), zero.alias("base2"), none.alias("known2"), F.col("x").alias("score"), none.alias("copies"))
    every = met.unionByName(walked).unionByName(part.select("row", zero.alias("base2"), none.alias("known2"), zero.alias("score"), F.lit(1).cast("long").alias("copies")))
    sums = every.groupBy("row").agg(*[F.sum(x).alias(x) for x in ("base2", "score", "known2", "copies")])
    out = part.select("row", "doc_id", "n_tokens", "known", "base").join(sums, "row")
    return out.select("doc_id", "n_tokens", (F.col("known") + (F.col("known2") / F.col("copies")).cast("long")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.col("base2") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"))


def op3_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Contract query: learns from rows whose crc32(doc_id) mod 10 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    out = _scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.when(fold != 0, 3).otherwise(2).alias("use")))
    return out.withColumn("held_out", fold == 0).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
