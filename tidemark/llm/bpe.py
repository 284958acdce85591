"""BPE encoding as a bounded-lookahead streaming transducer, and incremental decoding.

A pretoken is read left to right, a window at a time.  Tokens are emitted once
they are stable: at its end all are, as no merge crosses it, and before that those
whose boundary lies at least the merge list's sufficient lookahead before the last
symbol read, for no later symbol can move it.  What is emitted is dropped, so
memory stays constant for pretokens of any length.  Many pretokens are read in
lockstep: in each round every one merges its pair of least rank, all of them in a
few array operations.  A merge can only create pairs of a higher rank than its own,
which is checked when the vocabulary is loaded and bounds the lookahead.

Decoding is a state machine too: it takes ids and gives out text as far as the
bytes so far form whole characters.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the words and tokens that a worker remembers, each word taking ENTRY_BYTES besides, and the longest word among them.
CACHE_BYTES = 64 << 20
ENTRY_BYTES = 200
CACHED_WORD = 128
#: Bytes of the pretokens that are read in lockstep.
LOCKSTEP_BYTES = 1 << 20
#: Texts handled together.
BATCH = 256
#: Ids that the decoder takes at a time.
DECODE_IDS = 4096
NO_RANK = np.int64(1 << 40)

#: The printable stand-ins of bytes in byte-level vocabularies.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> list[str]:
    """The character that stands for each byte."""
    other = iter(range(256, 512))
    return [chr(b) if b in _SHOWN else chr(next(other)) for b in range(256)]


class Bpe:
    """A vocabulary file with its merge list, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.lower = '"Lowercase"' in json.dumps(spec["normalizer"])
        self.nfc = '"NFC"' in json.dumps(spec["normalizer"])
        self.plain_decode = spec["decoder"] is None
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.sizes = np.ones(int(max(vocab.values())) + 1, np.int64)
        for a, b, c in zip(left.tolist(), right.tolist(), made.tolist(), strict=True):
            self.sizes[c] = self.sizes[a] + self.sizes[b]
        self._check(left, right, made)
        self._build_table(left, right, made)
        self.lookahead = self._sufficient_lookahead(left, right, made)
        self.shown = [self.names.get(i, "") for i in range(max(self.names) + 1)]
        self.cache: dict[str, bytes] = {}
        self.cached = 0
        specials = "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut = re.compile(f"({specials})") if specials else None
        low = [chr(i) for i in range(0x250)]
        kind = lambda k: "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == k)
        space = "\t\n\x0b\x0c\r \x85\xa0"
        self.simple = re.compile("[\x00-ɏ]*")
        self.fast = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{kind('L')}]+|[{kind('N')}]|[^{space}{kind('L')}{kind('N')}]+")
        self.full = regex.compile(r"'(?:s|t|re|ve|m|ll|d)|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")

    @staticmethod
    def _check(left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        born = np.full(int(max(left.max(), right.max(), made.max())) + 1, -1, np.int64)
        rank = np.arange(len(made))
        born[made[::-1]] = rank[::-1]
        if (born[left] >= rank).any() or (born[right] >= rank).any():
            raise ValueError("the merge list uses a token before it is made")

    def _build_table(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> None:
        """An open-addressed table of pairs: rank and product by (left, right)."""
        size = 1 << max(8, int(len(made) * 4).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.ranks = np.full(size, NO_RANK, np.int64)
        self.made = np.zeros(size, np.int64)
        key = left << 20 | right
        _, first = np.unique(key, return_index=True)
        todo = np.sort(first)
        slot = self._slot(key[todo])
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot] == -1
            self.keys[slot[free]] = key[todo[free]]
            won = self.keys[slot] == key[todo]
            self.ranks[slot[won]], self.made[slot[won]] = todo[won], made[todo[won]]
            todo, slot = todo[~won], (slot[~won] + 1) & int(self.mask)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40) & self.mask).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a << 20 | b
        slot = self._slot(key)
        held = self.keys[slot]
        open_ = np.flatnonzero((held != key) & (held != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & int(self.mask)
            held = self.keys[slot[open_]]
            open_ = open_[(held != key[open_]) & (held != -1)]
        return np.where(self.keys[slot] == key, self.ranks[slot], NO_RANK), slot

    def _sufficient_lookahead(self, left: np.ndarray, right: np.ndarray, made: np.ndarray) -> int:
        """Symbols after which a boundary cannot move any more.

        What follows a boundary reaches back over it only through a chain of rules
        of rising rank, each of which would take the left part of the one before as
        its right part; the longest such chain times the longest token bounds the
        symbols that matter.
        """
        reach = np.zeros(int(max(left.max(), right.max(), made.max())) + 1, np.int64)
        best = 1
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            chain = 1 + reach[b]
            if chain > reach[a]:
                reach[a] = chain
                best = max(best, int(chain))
        longest = int(self.sizes.max())
        return (best + 1) * longest

    def merge(self, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many symbol sequences laid end to end; `word` numbers each symbol's sequence, ascending.

        Each round merges, in every sequence, all occurrences of its pair of least
        rank, from the left; sequences without a pair left are set aside.
        """
        done_ids, done_word = [], []
        rank, slot = self._rank(ids[:-1], ids[1:])
        rank, slot = np.append(np.where(word[:-1] == word[1:], rank, NO_RANK), NO_RANK), np.append(slot, 0)
        while len(ids):
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(start, len(ids)))
            low = np.minimum.reduceat(rank, start)
            if (low == NO_RANK).any():
                active = np.repeat(low < NO_RANK, size)
                done_ids.append(ids[~active])
                done_word.append(word[~active])
                ids, word, rank, slot = ids[active], word[active], rank[active], slot[active]
                size, low = size[low < NO_RANK], low[low < NO_RANK]
                if not len(ids):
                    break
            best = rank == np.repeat(low, size)
            twice = best[1:] & best[:-1]
            if twice.any():  # a run of one pair, such as aaaa: every second one from the left
                first = np.append(best[0], best[1:] & ~best[:-1])
                place = np.arange(len(best)) - np.maximum.accumulate(np.where(first, np.arange(len(best)), 0))
                best &= place % 2 == 0
            at = np.flatnonzero(best)
            ids[at] = self.made[slot[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            rank[at], slot[at] = rank[at + 1], slot[at + 1]
            ids, word, rank, slot = ids[keep], word[keep], rank[keep], slot[keep]
            at = at - np.arange(len(at))
            redo = np.concatenate((at - 1, at))
            redo = redo[(redo >= 0) & (redo < len(ids) - 1)]
            r, slot[redo] = self._rank(ids[redo], ids[redo + 1])
            rank[redo] = np.where(word[redo] == word[redo + 1], r, NO_RANK)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], word[order]

    def _tokens(self, pieces: list[bytes], whole: list[bool]) -> list[np.ndarray]:
        """Token ids of each piece; the last symbol of a whole one carries the word end."""
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(w) for w in pieces], np.int64)
        ids = self.inner[data]
        ends = (np.cumsum(size) - 1)[np.array(whole)]
        ids[ends] = self.last[data[ends]]
        ids, word = self.merge(ids, np.repeat(np.arange(len(pieces)), size))
        return np.split(ids, np.flatnonzero(word[1:] != word[:-1]) + 1)

    def _stable(self, ids: np.ndarray, window: int) -> tuple[np.ndarray, int]:
        """The tokens that end within the window, and how many symbols they take."""
        ends = np.cumsum(self.sizes[ids])
        n = int(np.searchsorted(ends, window, "right"))
        return ids[:n], int(ends[n - 1]) if n else 0

    def transduce(self, words: list[bytes], window: int | None = None) -> list[np.ndarray]:
        """Token ids of each pretoken; all are read in lockstep, at most a window and the lookahead of each at a time."""
        window = window or 4 * self.lookahead
        reach = window + self.lookahead
        out: list[list[np.ndarray]] = [[] for _ in words]
        at = [0] * len(words)
        left = [i for i, w in enumerate(words) if w]
        while left:
            part, total = [], 0
            while left and (not part or total < LOCKSTEP_BYTES):
                part.append(left.pop())
                total += min(reach, len(words[part[-1]]) - at[part[-1]])
            whole = [len(words[i]) - at[i] <= reach for i in part]
            got = self._tokens([words[i][at[i] : at[i] + reach] for i in part], whole)
            for i, ended, ids in zip(part, whole, got, strict=True):
                if ended:
                    out[i].append(ids)
                    continue
                ids, step = self._stable(ids, window)
                out[i].append(ids)
                at[i] += step
                left.append(i)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]

    def stream(self, symbols: Iterator[bytes], window: int | None = None) -> Iterator[int]:
        """Ids of one pretoken given in pieces, emitted as soon as they are stable."""
        window = window or 4 * self.lookahead
        held = b""
        for piece in symbols:
            held += piece
            while len(held) > window + self.lookahead:
                ids, step = self._stable(self._tokens([held[: window + self.lookahead]], [False])[0], window)
                yield from ids.tolist()
                held = held[step:]
        if held:
            yield from self._tokens([held], [True])[0].tolist()

    def normalise(self, text: str) -> str:
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        return text

    def pretokens(self, text: str) -> list[str]:
        text = self.normalise(text)
        return (self.fast if self.simple.fullmatch(text) else self.full).findall(text)

    def parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """Pieces of a text and whether each is a special token."""
        if self.cut is None:
            yield text, False
            return
        for n, piece in enumerate(self.cut.split(text)):
            if piece:
                yield piece, n % 2 == 1

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Tokens of all words as little-endian 32-bit integers: remembered ones, and new ones from the transducer."""
        got = {w: self.cache[w] for w in words if w in self.cache}
        new = [w for w in words if w not in got]
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        for w, b, ids in zip(new, raw, self.transduce(raw), strict=True):
            got[w] = ids.astype("<u4").tobytes()
            if len(b) <= CACHED_WORD:
                size = len(b) + len(got[w]) + ENTRY_BYTES
                if self.cached + size > CACHE_BYTES:
                    self.cache.clear()
                    self.cached = 0
                self.cache[w] = got[w]
                self.cached += size
        return got

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        cut, words = [], set()
        for text in texts:
            found: list[str | int] = []
            for piece, special in self.parts(text or ""):
                if special:
                    found.append(self.special[piece])
                else:
                    got = self.pretokens(piece)
                    found += got
                    words.update(got)
            cut.append(found)
        known = self.learn(words)
        return [b"".join([known[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in found]) for found in cut]

    def decoder(self) -> Decoder:
        """A fresh state machine that decodes a stream of ids."""
        return Decoder(self.shown, self.plain_decode)

    def decoded(self, ids: np.ndarray) -> str:
        """Text of all ids, fed to the decoder in blocks."""
        machine = self.decoder()
        return "".join([*(machine.feed(ids[i : i + DECODE_IDS].tolist()) for i in range(0, len(ids), DECODE_IDS)), machine.finish()])

    def decode(self, ids: Iterator[int]) -> Iterator[str]:
        """Text of a stream of ids, piece by piece."""
        machine = self.decoder()
        for i in ids:
            yield machine.feed([i])
        yield machine.finish()


class Decoder:
    """Text of ids, as far as it is certain.

    Without a decoder in the file, tokens are shown as they are, a space between
    them, and the state is whether one came before.  Otherwise tokens stand for
    bytes, and the state is the start of a character whose end has not come; a
    broken sequence gives U+FFFD.
    """

    def __init__(self, shown: list[str], plain: bool):
        self.shown, self.plain, self.begun = shown, plain, False
        self.bytes = {c: b for b, c in enumerate(byte_letters())}
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def _raw(self, token: str) -> bytes:
        """The bytes of a token; one with a letter that stands for no byte is plain text."""
        try:
            return bytes([self.bytes[c] for c in token])
        except KeyError:
            return token.encode("utf-8", "surrogatepass")

    def feed(self, ids: list[int]) -> str:
        shown = self.shown
        if self.plain:
            text = " ".join([shown[i] for i in ids])
            if ids and self.begun:
                text = " " + text
            self.begun = self.begun or bool(ids)
            return text
        return self.state.decode(b"".join([self._raw(shown[i]) for i in ids]))

    def finish(self) -> str:
        """What is left at the end of the ids."""
        return "" if self.plain else self.state.decode(b"", True)


@lru_cache(maxsize=4)
def loaded(path: str) -> Bpe:
    return Bpe(path)


def _run(path: str, full: bool):
    def run(batches):
        bpe = loaded(path)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                got = [np.frombuffer(x, "<u4") for x in bpe.encode_many(batch.column(1).to_pylist())]
                columns = [batch.column(0), pa.array([len(x) for x in got], pa.int64())]
                if full:
                    columns += [pa.array([x.astype(np.int64) for x in got], pa.list_(pa.int64())), pa.array([bpe.decoded(x) for x in got], pa.string())]
                else:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in got], pa.string()), pa.array([hashlib.sha256(bpe.decoded(x).encode("utf-8", "surrogatepass")).hexdigest() for x in got], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", *(("ids", "decoded") if full else ("ids_sha256", "decoded_sha256"))])

    return run


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(docs: DataFrame, path: str, digests: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded), or digests of the last two.

    The path must be readable on every executor.  Null and empty texts have no
    tokens and decode to an empty text; repeated rows are encoded one by one;
    other columns are ignored.
    """
    kinds = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<long>, decoded string"
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(_run(path, not digests), f"doc_id long, n_tokens long, {kinds}")


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract query over the whole documents table."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(), digests=True)
