"""Small fixtures held against brute force, round trips and edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import bpe, jaccard_join, licences, lm_scoring, mixing, pii, quality_model, quality_rules, toxicity, webp
from tidemark.llm.words import shingle_set, word_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, key long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2) for i, t in enumerate(texts)], SCHEMA)


EDGES = [None, "", "   \n\t", "one", "the " * 3000, "x" * 50000, "the cat sat on the mat " * 30, "the cat sat on the mat " * 30, "é💡 ünï\x00cödé"]


def near_texts():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    out = []
    for n in (3, 6, 10, 40, 200):
        for _ in range(4):
            base = [rnd.choice(words) for _ in range(n)]
            for _ in range(4):
                t = list(base)
                for _ in range(rnd.randint(0, max(1, n // 40))):
                    t[rnd.randrange(n)] = rnd.choice(words)
                out.append(" ".join(t))
    shared = " ".join(rnd.choice(words) for _ in range(30))
    return out + [shared + " " + " ".join(rnd.choice(words) for _ in range(20)) for _ in range(20)] + EDGES


def brute_components(texts, width, num, den):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("width,num,den", [(4, 85, 100), (5, 4, 5)])
def test_jaccard_components(spark, width, num, den):
    texts = near_texts()
    got = jaccard_join.jaccard_components(frame(spark, texts), width, num, den)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts, width, num, den)


def test_jaccard_rows_without_or_with_equal_ids(spark):
    import corpus_pipeline

    one, two, three = (" ".join(f"{k}{i}" for i in range(60)) for k in "abc")
    rows = [(None, one), (None, one + " end"), (7, two), (7, three), (8, three + " end"), (9, "x y"), (9, "x y"), (None, "lone words"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text): r.root for r in jaccard_join.jaccard_components(docs, rows=True).join(docs.withColumn("row", jaccard_join.row_number("doc_id", "text")).drop("doc_id"), "row").collect()}
    assert got[None, one] == got[None, one + " end"] and got[7, three] == got[8, three + " end"] != got[7, two]
    kept = sorted((r.doc_id or 0, (r.text or "")[:2]) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect())
    assert kept == [(0, "a0"), (0, "lo"), (3, ""), (7, "b0"), (7, "c0"), (9, "x ")]


@pytest.mark.parametrize("num,den", [(4, 5), (85, 100), (95, 100)])
def test_signatures_of_similar_sets_meet(num, den):
    rng = np.random.default_rng(num)
    ups, plans = jaccard_join._bands(num, den)
    assert num == 95 or {bool(p[2]) for p in plans if p} == {True, False}  # some bands leave out parts of the second level, others have one level
    for m in [*range(2, 40), 60, 150, 400, 1500]:
        for _ in range(12 if m < 100 else 4):
            x = rng.integers(0, 2**63, m, dtype=np.uint64)
            k = max(1, int(2 * m * (den - num) // (den + num)))
            out, new = rng.integers(0, k + 1), rng.integers(0, k + 1)
            y = np.unique(np.concatenate((x[: m - min(out, m - 1)], rng.integers(0, 2**63, new, dtype=np.uint64))))
            x = np.unique(x)
            both = len(np.intersect1d(x, y))
            if den * both < num * (len(x) + len(y) - both) or both == len(x) == len(y):
                continue
            (a, own_a), (b, own_b) = jaccard_join.signatures(x, num, den), jaccard_join.signatures(y, num, den)
            own = dict(zip(a.tolist(), own_a.tolist(), strict=True))
            assert any(s in own and (own[s] or o) for s, o in zip(b.tolist(), own_b.tolist(), strict=True))
            parts = [jaccard_join.signatures(x, num, den, 3, i)[0] for i in range(3)]
            assert sorted(np.concatenate(parts).tolist()) == sorted(a.tolist())


def test_jaccard_long_sets_and_buckets_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 6)
    rnd = random.Random(9)
    long = [f"w{rnd.randrange(4000)}" for _ in range(5200)]
    texts = [" ".join(long)]
    for i in range(24):  # a chain in which neighbours are similar, its ends are not
        long[i * 200 : i * 200 + 20] = [f"v{i}x{j}" for j in range(20)]
        if i % 3 == 2:
            long[3000 : 3000 + 40 * i] = [f"u{i}x{j}" for j in range(40 * i)]
        texts.append(" ".join(long))
    short = [f"s{i}" for i in range(60)]
    for i in range(40):
        texts.append(" ".join(short[:i] + [f"t{i}"] + short[i + 1 :]) if i % 2 else " ".join(short[:30] + [f"z{i}x{j}" for j in range(30)]))
    got = jaccard_join.jaccard_components(frame(spark, texts), 4, 85, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(texts, 4, 85, 100)


@pytest.mark.parametrize("local", [0, 1_000_000])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, local):
    from tidemark.llm import components as c
    from tidemark.llm.workspace import Workspace

    monkeypatch.setattr(c, "LOCAL_EDGES", local)
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 500 + i) for i in range(1, 80)] + [(rnd.randrange(1000, 1200), rnd.randrange(1000, 1200)) for _ in range(90)] + [(7, 7), (-5, 9), (9, -5)]
    root = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = c.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "t"), "x").collect()
    assert {r.node: r.root for r in got} == root and len(got) == len(root)
    assert c.components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "t"), "y").count() == 0


def test_jaccard_empty_table(spark):
    assert jaccard_join.jaccard_components(frame(spark, ["a"]).limit(0)).count() == 0


def test_word_hashes_follow_words():
    import pyarrow as pa

    texts = [t or "" for t in EDGES]
    h, at = word_hashes(pa.array(EDGES, pa.string()))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert at[i + 1] - at[i] == len(w) and len(set(w)) == len(set(h[at[i] : at[i + 1]].tolist()))
    assert len(shingle_set(h[:0], 4)) == 0


def test_quality_rules_edges(spark):
    got = {r.doc_id: r for r in quality_rules.scored(frame(spark, EDGES)).collect()}
    assert [got[i].n_words for i in range(5)] == [0, 0, 0, 1, 3000]
    assert got[4].n_repeat_words == 3000 and got[4].base_failed and not got[0].kept
    assert quality_rules.scored(frame(spark, ["a"]).limit(0)).count() == 0


def test_quality_rules_repeats(spark):
    texts = ["a b c d a b c e", "a a a a", "a b c", "p q r p q r p"]

    def brute(t):
        w = t.split()
        g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({i + j for i, x in enumerate(g) if g.count(x) > 1 for j in range(3)})

    got = {r.doc_id: r.n_repeat_words for r in quality_rules.scored(frame(spark, texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_bpe_matches_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    lib, own = Tokenizer.from_file(path), bpe.Bpe(path)
    texts = [t or "" for t in EDGES] + ["It's <|endoftext|> they'll ΟΔΥΣΣΕΥΣ ½Ⅷ 漢字 👩‍👧", "ab" * 4000, "aaaa " * 9]
    for t, ids in zip(texts, own.encode_many(texts), strict=True):
        want = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want and own.decoded(np.array(want, np.int64)) == lib.decode(want, skip_special_tokens=False)
        assert "".join(own.decode(iter(want))) == own.decoded(np.array(want, np.int64))
    assert bpe.encoded(frame(spark, EDGES), path, digests=True).count() == len(EDGES)


def test_bpe_transducer_emits_the_same_tokens_at_any_window(monkeypatch):
    own = bpe.Bpe(bpe.vocabulary_path())
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeit") for _ in range(n)).encode() for n in (1, 2, 50, 700, 1900)] + [b"a" * 1500, b""]
    whole = [own._tokens([w], [True])[0].tolist() if w else [] for w in words]
    for window in (17, 400):
        monkeypatch.setattr(own, "lookahead", 600)  # windows shorter than the words, so tokens are emitted before the end
        assert [x.tolist() for x in own.transduce(words, window)] == whole
        assert [list(own.stream((w[i : i + 33] for i in range(0, len(w), 33)), window)) for w in words] == whole
    monkeypatch.setattr(bpe, "CACHE_BYTES", 2000)
    texts = [" ".join(rnd.choice("abcde") * rnd.randrange(1, 9) for _ in range(30)) for _ in range(20)]
    assert own.encode_many(texts) == bpe.Bpe(bpe.vocabulary_path()).encode_many(texts) and own.cached <= 2000


def test_bpe_decoder_waits_for_whole_characters():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary_path("byte_bpe_50k.json"))
    shown = [lib.id_to_token(i) for i in range(lib.get_vocab_size())]
    for text in ("héllo 漢字 👩\u200d👧 x", "", "plain words"):
        ids = lib.encode(text).ids
        for cut in (0, 3):
            machine = bpe.Decoder(shown, False)
            pieces = [machine.feed([i]) for i in ids[cut:]]
            assert "".join(pieces) + machine.finish() == lib.decode(ids[cut:], skip_special_tokens=False)
    machine = bpe.Decoder(shown, False)
    first = lib.encode("漢").ids[:1]
    assert machine.feed(first) == "" and machine.finish() == "\ufffd"


WORDY = [random.Random(n).randbytes(n) for n in (0, 1, 575, 576, 577, 5000)] + [b"ab" * 3000, b"a" * 9000, bytes(range(16)) * 80, b"abc" * 700, bytes(range(256)) * 9, b"\xff" * 576, ("one two three four " * 90).encode()]


def test_webp_round_trip(spark, monkeypatch):
    for raw in WORDY:
        images = webp.restore(webp.store(webp.padded(raw)))
        assert b"".join(x[:, :, 1].tobytes() for x in images) == webp.padded(raw)
    taken = []
    for name in ("_undo_palette", "_several", "_read_code"):
        monkeypatch.setattr(webp, name, lambda *a, f=getattr(webp, name), n=name: (taken.append(n), f(*a))[1])
    media = webp.store(webp.padded(WORDY[-1]))
    webp.restore(media)
    assert {"_undo_palette", "_several", "_read_code"} == set(taken) and len(media) < 300  # prefix codes, references and the palette are read
    rows = webp.media_column(frame(spark, EDGES)).collect()
    assert rows[0].n_bytes == 0 and rows[0].payload_bytes == 576 and rows[6].media_sha256 == rows[7].media_sha256
    assert hashlib.sha256(rows[3].media).hexdigest() == rows[3].media_sha256


def libwebp():
    import ctypes
    import ctypes.util

    name = ctypes.util.find_library("webp")
    if not name:
        pytest.skip("the box has no libwebp")
    lib = ctypes.CDLL(name)
    lib.WebPDecodeRGBA.restype = ctypes.c_void_p
    lib.WebPEncodeLosslessRGBA.restype = ctypes.c_size_t
    lib.WebPFree.argtypes = [ctypes.c_void_p]

    def read(data):
        w, h = ctypes.c_int(), ctypes.c_int()
        at = lib.WebPDecodeRGBA(data, ctypes.c_size_t(len(data)), ctypes.byref(w), ctypes.byref(h))
        out = np.frombuffer(ctypes.string_at(at, w.value * h.value * 4), np.uint8).reshape(h.value, w.value, 4).copy()
        lib.WebPFree(at)
        return out

    def write(px):
        out = ctypes.c_void_p()
        n = lib.WebPEncodeLosslessRGBA(px.tobytes(), px.shape[1], px.shape[0], px.shape[1] * 4, ctypes.byref(out))
        data = ctypes.string_at(out, n)
        lib.WebPFree(out)
        return data

    return read, write


def test_webp_agrees_with_an_independent_codec(spark, monkeypatch):
    read, write = libwebp()
    for raw in WORDY:
        media = webp.store(webp.padded(raw))
        assert (read(media) == webp.pixels(media)).all()
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:61, 0:83]
    photo = np.stack([(np.sin(x / 9) * 60 + y * 2 + rng.integers(0, 6, x.shape)) % 256, (x + y) % 256, x * y / 20 % 256, np.full(x.shape, 255)], 2).astype(np.uint8)
    flat = np.repeat(np.repeat(rng.integers(0, 256, (4, 5, 4), dtype=np.uint8), 9, 0), 11, 1)
    few = (rng.integers(0, 3, (40, 41, 1)) * np.array([9, 70, 100, 0]) + np.array([0, 0, 0, 255])).astype(np.uint8)
    coarse = (photo // 16 * 16).astype(np.uint8)
    taken = set()
    for name in ("_undo_palette", "_undo_predictor", "_undo_cross_colour", "_copy"):
        monkeypatch.setattr(webp, name, lambda *a, f=getattr(webp, name), n=name: (taken.add(n), f(*a))[1])
    made = [photo, rng.integers(0, 256, (20, 31, 4), dtype=np.uint8), flat, few, coarse, np.tile(photo, (3, 3, 1))]
    stored = [write(px) for px in made]
    for px, data in zip(made, stored, strict=True):
        assert (webp.pixels(data) == read(data)).all()
    assert taken == {"_undo_palette", "_undo_predictor", "_undo_cross_colour", "_copy"}
    rows = [(i, data) for i, data in enumerate(stored)] + [(90, None), (91, b"no image"), (92, stored[0][:200])]
    got = {r.doc_id: r for r in webp.decoded_column(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert all(got[i].pixels == read(data).tobytes() and got[i].width == px.shape[1] for i, (px, data) in enumerate(zip(made, stored, strict=True)))
    assert got[90].pixels is None and got[90].error is None and got[91].error and got[92].error and got[92].pixels is None


def test_webp_colour_cache():
    """A hand-made file: two colours as literals, then by their places in the cache."""
    w = webp._header(4, 1)
    w.put(0, 1)
    w.put(1, 1)
    w.put(1, 4)  # a cache of two
    w.put(0, 1)
    colours = [0xFF000000 | g << 8 for g in (10, 20)]
    place = [(0x1E35A7BD * c & 0xFFFFFFFF) >> 31 for c in colours]
    counts = [0] * 282
    for s in (10, 20, 280, 281):
        counts[s] = 1
    bits, size = webp._put_code(w, counts)
    for v in (0, 0, 255, 0):
        webp._put_one(w, v)
    last = {p: c for p, c in zip(place, colours, strict=True)}
    for s in (10, 20, 280 + place[1], 280 + place[0]):
        w.put(int(bits[s]), int(size[s]))
    _, _, p = webp.decode(webp._riff(w.value.to_bytes(w.n // 8 + 1, "little")))
    assert p.tolist() == [*colours, last[place[1]], last[place[0]]]


def test_webp_transforms_and_references():
    """A hand-made file: palette of two colours, one literal row, then a back-reference over the rest."""
    w = webp._header(8, 2)
    for value, n in ((1, 1), (3, 2), (1, 8)):  # palette of two
        w.put(value, n)
    w.put(0, 1)  # no cache; greens 10 and 20, others one symbol
    for symbols in ((10, 20), (0,), (0,), (255, 0), (0,)):
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(1, 1)
        for s in sorted(symbols):
            w.put(s, 8)
    for green, alpha in ((0, 1), (1, 0)):  # first colour green 10 alpha 255, then difference green 20
        w.put(green, 1)
        w.put(alpha, 1)
    w.put(0, 1)  # end of transforms; width packs to one pixel of eight bits
    w.put(0, 1)
    w.put(0, 1)
    for symbols in ((0b01010101, 0b00110011), (0,), (0,), (0,), (0,)):
        w.put(1, 1)
        w.put(len(symbols) - 1, 1)
        w.put(1, 1)
        for s in sorted(symbols):
            w.put(s, 8)
    w.put(1, 1)
    w.put(0, 1)
    width, height, p = webp.decode(webp._riff(w.value.to_bytes(w.n // 8 + 1, "little")))
    assert (width, height) == (8, 2)
    green = (p >> 8 & 255).reshape(2, 8).tolist()
    assert green == [[30, 10] * 4, [30, 30, 10, 10] * 2]


def test_code_lengths_are_best_or_bounded():
    rnd = random.Random(4)
    for n in (1, 2, 3, 40, 280):
        counts = [rnd.choice([0, 1, 2, 1 << rnd.randrange(24)]) for _ in range(n)]
        for longest in (9, 15):
            lengths = webp.code_lengths(counts, longest)
            used = [x for x in lengths if x]
            assert [bool(x) for x in lengths] == [bool(c) for c in counts] and max(used, default=0) <= longest
            assert len(used) < 2 or sum(2.0**-x for x in used) == 1


def test_predictors_invert():
    rng = np.random.default_rng(1)
    px = rng.integers(0, 256, (6, 7, 4), dtype=np.uint8)
    for mode in range(14):
        coded = px.astype(int).copy()
        for y in range(6):
            for x in range(7):
                if not x and not y:
                    g = [0, 0, 0, 255]
                elif not y:
                    g = px[0, x - 1].astype(int).tolist()
                elif not x:
                    g = px[y - 1, 0].astype(int).tolist()
                else:
                    right = px[y - 1, x + 1] if x < 6 else px[y, 0]
                    g = webp._predict(mode, *(v.astype(int).tolist() for v in (px[y, x - 1], px[y - 1, x], px[y - 1, x - 1], right)))
                coded[y, x] = (coded[y, x] - g) & 255
        flat = coded.astype(np.uint8).reshape(-1, 4).copy().view("<u4").ravel()
        back = webp._undo_predictor(flat, 7, np.array([mode << 8] * 2, np.uint32), 3)
        assert (webp._planes(back).reshape(6, 7, 4) == px).all()


def test_pii_bootstraps(spark):
    texts = ["phone: +1 (988) 555-2485", "phone: +1 988 555 2486 x", "phone: +49 170 1234567", "phone: 0170-998877 ok", "a@b.com_x@y.zz 1.2.3.4.5 999.1.1.1", None, "", "card 4111 1111 1111 1111"]
    rows = {r.doc_id: r for r in pii.find_personal_data(frame(spark, texts)).collect()}
    assert [tuple(x) for x in rows[3].spans] == [(7, 4, 18)] and not rows[3].base
    assert [tuple(x) for x in rows[4].base] == [(0, 1, 7), (7, 1, 14), (15, 2, 22)]
    assert [tuple(x) for x in rows[7].base] == [(5, 3, 24)] and not rows[5].base
    masked = {r.doc_id: r.text for r in pii.masked(frame(spark, texts)).collect()}
    assert masked[4] == "<email><email> <ip>.5 999.1.1.1" and masked[5] is None


def test_pii_word_contexts_and_spaced_numbers(spark):
    seeds = ["+1 (988) 555-2485", "+1 988 555 2486", "+49 170 1234567", "+44 20 7946 0958"]
    texts = [f"Call me at {x} tonight" for x in seeds] + [f"{x} is my number" for x in seeds] + [f"phone: {x}" for x in seeds]
    asked = ["please call me at 0170-998877", "call me at 0170 998877", "(0170) 99 88 77 is my number", "phone: 0170 998877", "phone 0170-998877 ok", "built in 1999 100000 times", "phone: 12 34"]
    rows = {r.doc_id - len(texts): r for r in pii.find_personal_data(frame(spark, texts + asked)).collect()}
    found = [[asked[i][x.start : x.end] for x in rows[i].spans if x.kind == 4] for i in range(len(asked))]
    assert found == [["0170-998877"], ["0170 998877"], ["(0170) 99 88 77"], ["0170 998877"], ["0170-998877"], [], []]
    masked = {r.doc_id - len(texts): r.text for r in pii.masked(frame(spark, texts + asked)).collect()}
    assert masked[3] == "phone: <phone>" and masked[0] == "please call me at <phone>"


def test_pii_found_instances_support_new_patterns(spark):
    seeds = ["+1 (988) 555-2485", "+1 988 555 2486", "+49 170 1234567", "+44 20 7946 0958", "+33 1 70 18 99 00", "+1 988 555 2490"]
    local = ["0170-998877", "0171-998866", "0172-112233"]
    texts = [f"phone: {x}" for x in seeds] + [f"phone: {x}" for x in local] + [f"rufnummer: {x}" for x in local]
    asked = ["rufnummer: 0555-443322", "order: 0555-443399", None]
    rows = {r.doc_id - len(texts): r for r in pii.find_personal_data(frame(spark, texts + asked)).collect()}
    found = [[asked[i][x.start : x.end] for x in rows[i].spans if x.kind == 4] if asked[i] else [] for i in range(3)]
    assert found == [["0555-443322"], [], []] and not any(rows[i].base for i in range(3))


def test_language_model_is_a_distribution(spark):
    texts = ["a b a b c", "a b a b d", "b a", None, "a b a b c"] * 3
    out = lm_scoring.lm_scores(frame(spark, texts + ["zzz a"]), frame(spark, texts)).orderBy("doc_id").collect()
    assert all(r.train_tokens == 3 * (6 + 6 + 3 + 1 + 6) for r in out)
    assert out[-1].n_known < out[-1].n_tokens and all(r.score < 0 for r in out)
    none = lm_scoring.lm_scores(frame(spark, ["a b"]), frame(spark, texts).limit(0)).first()
    assert none.score == 0 and none.n_known == 0 and none.train_tokens == 0


def backoff_scores(training, texts):
    """Brute force: every n-gram of `training` counts, discounted absolutely, with backoff to the root."""
    rows = [["<s>", *(t or "").split(), "</s>"] for t in training]
    count = {n: {} for n in (1, 2, 3)}
    for r in rows:
        for n in count:
            for i in range(1 if n == 1 else 0, len(r) - n + 1):
                g = tuple(r[i : i + n])
                count[n][g] = count[n].get(g, 0) + 1
    total = sum(count[1].values())
    after = {}
    for n in (2, 3):
        for g, c in count[n].items():
            after.setdefault(g[:-1], {})[g[-1]] = c

    def p(context, w):
        if not context:
            c = count[1].get((w,), 0)
            return (c - 0.5) / total if c else 0.5 * len(count[1]) / total
        if context not in after:
            return p(context[1:], w)
        seen = after[context]
        n = sum(seen.values())
        if w in seen:
            return (seen[w] - 0.75) / n
        return 0.75 * len(seen) / n / (1 - sum(p(context[1:], x) for x in seen)) * p(context[1:], w)

    out = []
    for t in texts:
        r = ["<s>", *(t or "").split(), "</s>"]
        out.append(sum(np.log10(p(tuple(r[max(0, i - 2) : i]), r[i])) for i in range(1, len(r))))
    return out


def test_language_model_counts_every_ngram(spark, monkeypatch):
    rnd = random.Random(3)
    words = [f"w{int(rnd.paretovariate(0.7)) % 300}" for _ in range(4000)]
    texts = [" ".join(words[i * 25 : i * 25 + 25]) for i in range(160)] + ["lone words here", None, ""]
    asked = texts[100:] + ["w1 w2 w1 never seen w3 lone words w1", "w1 lone words there", "w1 lone words there"]
    for share, flush, part in ((1e-6, 4_000_000, 2_000_000), (1e-2, 500, 300)):
        monkeypatch.setattr(lm_scoring, "WORD_SHARE", share)
        monkeypatch.setattr(lm_scoring, "_BLOCK", flush, raising=False)
        monkeypatch.setattr(lm_scoring, "PART", part, raising=False)
        out = lm_scoring.lm_scores(frame(spark, asked), frame(spark, texts[:120] + texts[160:])).orderBy("doc_id").collect()
        assert [r.score for r in out] == pytest.approx(backoff_scores(texts[:120] + texts[160:], asked), rel=1e-9)
    twice = frame(spark, asked[:3])
    out = lm_scoring.lm_scores(twice.unionByName(twice), frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.score for r in out[::2]] == pytest.approx(backoff_scores(texts, asked[:3])) and out[0] == out[1]


def test_lm_ids_of_words_that_share_a_slot():
    rng = np.random.default_rng(5)
    h = rng.integers(-(2**63), 2**63 - 1, 5000, dtype=np.int64)
    h[:2000] = h[:2000] >> 40  # many in the same slots, around zero too
    h = np.unique(np.r_[h, 0])
    voc = lm_scoring.Vocabulary(h, rng.integers(2, 90, len(h)), 10**6)
    asked = np.r_[h, h + 1, rng.integers(-(2**63), 2**63 - 1, 5000, dtype=np.int64)]
    known = dict(zip(voc.h.tolist(), voc.id.tolist(), strict=True))
    assert voc.ids(asked).tolist() == [known.get(x, -1) for x in asked.tolist()]


def test_lm_rounds_deal_out_every_part_once(spark, monkeypatch):
    """The transitions of one round lie on disk at a time; they once all did."""
    import pyarrow as pa
    import pyarrow.compute as pc

    rng = np.random.default_rng(4)
    names = np.array(["the", *(f"w{i}" for i in range(60))])
    texts = [" ".join(rng.choice(names, 40, p=[0.4, *[0.01] * 60])) for _ in range(100)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([3] * 100, pa.int32()), pa.array(texts)], names=["row", "use", "text"])
    counts = pa.Table.from_batches(list(lm_scoring._counted([rows.select(["text"])]))).to_pandas()
    monkeypatch.setattr(lm_scoring, "PART", 300)
    voc = lm_scoring.Vocabulary(counts["h"].to_numpy(), counts["n"].to_numpy(), int(counts["n"].sum()))
    dealt = lambda *turn: pa.Table.from_batches(list(lm_scoring._moves(voc, *turn)([rows]))).filter(pc.field("v").is_valid()).to_pandas()
    whole, rounds = dealt(), [dealt(k, 3) for k in range(3)]
    assert len(voc.several) and sorted(whole.part) == sorted(p for r in rounds for p in r.part) and all((r.part % 3 == k).all() for k, r in enumerate(rounds))
    assert whole.n.sum() == sum(r.n.sum() for r in rounds) and max(r.n.sum() for r in rounds) < 0.6 * whole.n.sum()
    found = []
    for n in (1, 2, 5):
        monkeypatch.setattr(lm_scoring, "ROUNDS", n)
        found.append([r.score for r in lm_scoring.lm_scores(frame(spark, texts), frame(spark, texts[:80])).orderBy("doc_id").collect()])
    assert np.allclose(found[0], found[1]) and np.allclose(found[0], found[2])


def test_lm_parts_are_walked_in_slices(monkeypatch):
    """A part of any size is walked some words or contexts at a time, with the same results; it once was walked whole."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    names = np.array(["the", "of", *(f"w{i}" for i in range(40))])
    texts = [" ".join(rng.choice(names, 60, p=[0.4, 0.2, *[0.01] * 40])) for _ in range(200)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([2 if i % 10 == 0 else 3 for i in range(200)], pa.int32()), pa.array(texts)], names=["row", "use", "text"])
    learnt = pa.RecordBatch.from_arrays([pa.array([t for i, t in enumerate(texts) if i % 10])], names=["text"])
    counts = pa.Table.from_batches(list(lm_scoring._counted([learnt]))).to_pandas()
    whole, walk = {}, lm_scoring._walk
    for part, slice_ in ((10**6, 10**9), (10**6, 300), (2000, 10**9), (2000, 300)):
        monkeypatch.setattr(lm_scoring, "PART", part)
        monkeypatch.setattr(lm_scoring, "SLICE", slice_, raising=False)
        sizes = []
        monkeypatch.setattr(lm_scoring, "_walk", lambda voc, u, *rest, sizes=sizes: sizes.append((len(u), len(np.unique(u)))) or walk(voc, u, *rest))
        voc = lm_scoring.Vocabulary(counts["h"].to_numpy(), counts["n"].to_numpy(), int(counts["n"].sum()))
        moves = pa.Table.from_batches(list(lm_scoring._moves(voc)([rows])))
        if len(voc.several):
            pairs = pa.Table.from_batches(list(lm_scoring._pairs(voc)([learnt]))).group_by(["v", "w"]).aggregate([("n", "sum")])
            moves = pa.concat_tables([moves, *(pa.Table.from_batches([b]) for b in lm_scoring._told(voc)(pairs.to_batches()))])
        steps = pa.Table.from_batches(list(lm_scoring._steps(voc)(moves.sort_by("part").to_batches()))).to_pandas()
        found = steps[steps.kind < 3].groupby(["kind", "row", "v", "h"])[["times", "x"]].sum()
        whole.setdefault("found", found)
        assert found.index.equals(whole["found"].index) and np.allclose(found, whole["found"])
        if slice_ == 300:
            assert len(sizes) > 20 and all(n <= 300 or contexts == 1 for n, contexts in sizes)


def test_classifiers(spark):
    good = ["the quiet river ran along the old road number %d" % i for i in range(60)]
    bad = ["you idiot scum number %d goes away" % i for i in range(40)]
    docs = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i >= 60)) for i in range(0, 100, 2)], "doc_id long, toxic int")
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert all((scores[i] >= 0.7) == (i >= 60) for i in range(1, 100, 2))
    assert toxicity.swapped("gay men") == "straight girls"
    grades = labels.withColumnRenamed("toxic", "grade")
    model = quality_model.train(docs, grades)
    got = {r.doc_id: r.tails[0] for r in quality_model.score(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i >= 60) for i in range(1, 100, 2)]) > 0.95
    assert toxicity.score(frame(spark, EDGES), toxicity.train(docs, labels.limit(0))).count() == len(EDGES)


def test_ordinal_gradient_is_that_of_the_likelihood():
    from tidemark.llm.linear import Rows

    rng = np.random.default_rng(3)
    width, top = 5, 3
    dense = rng.normal(size=(30, width))
    grades = rng.integers(0, top + 1, 30)
    x = Rows([np.arange(width)] * 30, list(dense), width)

    def loss(p):
        cuts = p[width] + np.concatenate([[0], np.cumsum(np.exp(p[width + 1 :]))])
        total = 0.0
        for row, g in zip(dense, grades, strict=True):
            below = [0.0, *(1 / (1 + np.exp(-(c - row @ p[:width]))) for c in cuts), 1.0]
            total -= np.log(below[g + 1] - below[g])
        return total / 30 + 0.02 * p[:width] @ p[:width] / 2 / 30

    p = rng.normal(size=width + top) * 0.4
    got = quality_model.slope(x, grades, top, 0.02)(p)
    step = 1e-6 * np.eye(len(p))
    assert got == pytest.approx([(loss(p + e) - loss(p - e)) / 2e-6 for e in step], abs=1e-5)


def test_counterfactual_penalty_spares_neutral_mentions():
    """Toxic texts name one group more often; with the penalty naming it is held against a neutral text no more."""
    rnd = random.Random(1)
    filler = [f"word{i}" for i in range(60)]
    texts, labels = [], []
    for i in range(400):
        bad = i % 2
        words = rnd.sample(filler, 6) + (["awful"] if bad and rnd.random() < 0.75 else []) + (["muslims"] if rnd.random() < (0.7 if bad else 0.05) else ["christians"] if rnd.random() < 0.4 else [])
        rnd.shuffle(words)
        texts.append(" ".join(words))
        labels.append(bad)
    import pyarrow as pa

    plain, other = toxicity._pairs(pa.array(texts))
    assert sum(len(x) > 0 for x in other) > 100
    neutral = pa.array([" ".join(rnd.sample(filler, 6) + ["muslims"]) for _ in range(200)])
    toxic = pa.array([" ".join(rnd.sample(filler, 6) + ["awful"]) for _ in range(200)])
    without, with_ = (toxicity.fit(np.array(labels), plain, other, counterfactual=c) for c in (0.0, 30.0))
    wrong = [int((m.score(neutral) >= 0.5).sum()) for m in (without, with_)]
    assert wrong[0] > 150 and wrong[1] < 50 and (with_.score(toxic) >= 0.5).mean() > 0.9


CLASHING = "doc_id long, text string, n_chars int, n_words int, kept boolean, _id long, _rate double, _n int, _copy int, row long, row2 long, box string, spans string, n int, rate double, copy int, lang string"


def clashing_rows():
    long = " ".join(f"the word{i} of" for i in range(40))
    texts = [(1, "Mail a@b.com now. " + long), (1, long + " and the rest is 10.0.0.1 here"), (None, long + " or c@d.org"), (None, None), (5, ""), (6, long + " z"), (6, long + " z"), (7, "lone")]
    return [(i, t, len(t or ""), 1, True, 2, 0.5, 3, 4, 5, 6, "b", "s", 7, 0.1, 8, "en") for i, t in texts]


def test_stages_keep_clashing_columns_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(clashing_rows(), CLASHING)
    masked = {(r.doc_id, r.text) for r in corpus_pipeline.mask_personal_data(spark, docs, "").collect()}
    assert not any(t and ("@" in t or "10.0.0.1" in t) for _, t in masked) and sum(bool(t) and "<ip>" in t for _, t in masked) == 1
    assert {i for i, t in masked if t and "<email>" in t} == {1, None}
    mixed = corpus_pipeline.mix_to_targets(spark, docs, str(tmp_path)).collect()
    assert len(mixed) >= docs.count() and {(r.doc_id, r.text) for r in mixed} == {(r[0], r[1]) for r in clashing_rows()}
    kept = corpus_pipeline.keep_by_rules(spark, docs, "").collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 1, 6, 6]
    one = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    assert sum(r.doc_id == 6 for r in one) <= 1 and {None, 5, 7} <= {r.doc_id for r in one}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    rules = quality_rules.scored(docs, keep=("doc_id", "n_words", "kept"))
    assert {"input_n_words", "input_kept", "n_words", "kept"} <= set(rules.columns) and rules.count() == len(clashing_rows())


def test_operators_on_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame(clashing_rows(), CLASHING)
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    domains = spark.createDataFrame([(1, "en"), (6, "low"), (None, "de"), (7, None)], "doc_id long, domain string")
    path = bpe.vocabulary_path()
    runs = {
        "rules": lambda d: quality_rules.scored(d),
        "quality": lambda d: quality_model.score(d, quality_model.train(d, labels)),
        "lm": lambda d: lm_scoring.lm_scores(d, d),
        "join": lambda d: jaccard_join.jaccard_components(d),
        "pii": lambda d: pii.find_personal_data(d),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "webp": lambda d: webp.media_column(d),
        "bpe": lambda d: bpe.encoded(d, path),
        "mixing": lambda d: mixing.mixed(d, domains),
        "licences": lambda d: licences.licence_scan(d),
    }
    for name, run in runs.items():
        assert run(docs).count() == len(clashing_rows()), name
        assert run(docs.limit(0)).count() == 0, name


def test_mixing_reaches_targets(spark):
    docs = frame(spark, ["the river and the road of stone"] * 60 + ["der fluss und die strasse aus stein"] * 20)
    labelled = spark.createDataFrame([(i, "en" if i < 60 else "de") for i in range(0, 80, 3)], "doc_id long, domain string")
    rows = mixing.mixed(docs, labelled, {"en": 0.5, "de": 0.5}).collect()
    total = {d: sum(r.rate * r.n_tokens for r in rows if r.domain == d) for d in ("en", "de")}
    assert abs(total["en"] - total["de"]) < 0.1 * sum(total.values()) and min(r.rate for r in rows) >= 0
    assert mixing.mixed(docs.limit(0), labelled).count() == 0


@pytest.mark.parametrize("least, budget", [(0.0, 1.0), (1.0, 1.2), (1.0, 4.0)])
def test_mixing_comes_as_near_as_the_bound_allows(spark, least, budget):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([0.3, 0.3, 0.3], 300) * 0.2 + 0.8 * np.eye(3)[rng.choice(3, 300, p=[0.9, 0.08, 0.02])]
    n = rng.integers(5, 2000, 300)
    table = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n_tokens long, p array<double>")
    goal = np.array([0.4, 0.3, 0.3])
    steps, price, before, after = mixing.solve(table, 3, goal, least, budget)
    r = mixing._closed(p, mixing._replay(p, steps, least)[0], price, least)
    assert (n * r) @ p == pytest.approx(after) and r.min() >= least
    # no rate may change alone for the better: zero slope above the bound, none below it at the bound
    want = goal * before.sum() * budget
    slope = p @ (after - want) / want.sum()
    assert slope[r > least + 1e-9] == pytest.approx(0, abs=1e-3) and slope.min() > -1e-3
    if least == 0 or budget == 4:
        assert np.abs(after - want).max() < 1e-3 * want.sum()


def test_licences_of_whole_texts_and_long_lines(spark):
    import pathlib

    texts = ["SPDX-License-Identifier: MIT" + " *" * 2100, "Redistribution is fine\n" + licences._BSD_THIRD, licences._ZLIB.upper(), "x\nLicensed under the zlib Licence.\ny", "released under the cc by-sa 4.0"]
    folder = pathlib.Path("/usr/share/common-licenses")
    known = {"GPL-3": "GPL-3.0", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0", "LGPL-2.1": "LGPL-2.1"}
    found = {k: v for k, v in known.items() if (folder / k).exists()}
    texts += [(folder / k).read_text() for k in found]
    got = [(r.licence, r.line_licences) for r in licences.licence_scan(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == ("MIT", ["MIT"]) and got[1] == (None, []) and got[2][0] == "Zlib" and got[3] == (None, ["Zlib"]) and got[4][1] == ["CC-BY-SA-4.0"]
    assert [x[0] for x in got[5:]] == list(found.values())


def test_licences(spark):
    texts = ["Released under the MIT Licence.\nwords", licences._MIT.replace("the Software", "The  SOFTWARE"), "Copyright (c) 2020 X\n" + licences._BSD_HEAD + "\n" + licences._BSD_END, None, "no"]
    got = {r.doc_id: (r.licence, r.line_licences) for r in licences.licence_scan(frame(spark, texts)).collect()}
    assert got[0] == (None, ["MIT"]) and got[1][0] == "MIT" and got[2][0] == "BSD-2-Clause" and got[3] == (None, [])


def test_pipeline_keeps_columns(spark, tmp_path):
    import corpus_pipeline

    docs = frame(spark, near_texts()).drop("row", "key")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
