"""Byte-level BPE encoding and decoding with a pair occurrence index.

A partition is worked off in blocks of about `BLOCK_CHARS` characters (a longer text is one block).
The distinct space-separated chunks of a block (their pre-tokens cannot reach across the cut) are laid
end to end in one array of token ids with links to the next and previous token. An index maps every mergeable pair to all its
positions in that array. The ranks that occur are applied in ascending order: all positions of the
pair are merged at once and the pairs with the neighbours are entered in the index. A merge can only
make pairs of higher rank, because the merged token did not exist before; so ascending order over the
whole block gives each word the merges that it would get alone.

The vocabulary is a tokenizers JSON file of a byte-level BPE without normaliser; its path is a parameter
and is opened on the executors. Added tokens found in a text become their own ids, as the library does.

Defined results: null counts as the empty text: no ids; repeated rows are encoded alike; empty tables
give empty results; a text is never cut; decoding gives U+FFFD for bytes that are no UTF-8.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from emberline.llm.common import table

#: Characters of text encoded against one index.
BLOCK_CHARS = 5_000_000
#: Rows whose texts are turned into Python strings at once.
ROWS = 2_000
#: Pre-token pattern of byte-level BPE with use_regex.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, merges and added tokens of one file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.bytes_of: dict[int, bytes] = {i: as_bytes(t) for t, i in ids.items()}
        self.added: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.added.items()}
        self.size = max(self.bytes_of) + 1
        self.of_byte = np.zeros(256, dtype=np.int32)
        for i, token in self.bytes_of.items():
            if len(token) == 1:
                self.of_byte[token[0]] = i
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        keys = self.left * self.size + self.right
        self._order = np.argsort(keys)
        self._keys = keys[self._order]
        #: Rank of each pair of bytes, -1 where it doesn't merge.
        self.byte_ranks = self.ranks(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)).astype(np.int32)
        lengths = np.zeros(self.size, dtype=np.int64)
        for i, token in self.bytes_of.items():
            lengths[i] = len(token)
        #: Bytes of all ids laid end to end, where each begins, and how many it has.
        self.flat = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(self.size)), dtype=np.uint8)
        self.at, self.lengths = np.cumsum(lengths) - lengths, lengths
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge."""
        keys = left.astype(np.int64) * self.size + right
        at = self._keys.searchsorted(keys)
        return np.where(self._keys.take(at, mode="clip") == keys, self._order.take(at, mode="clip"), -1)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_all(vocab: Vocabulary, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Apply all merges to words (their bytes laid end to end); their ids and how many each has."""
    n = len(data)
    tokens = vocab.of_byte[data]
    if not n:
        return tokens, lengths
    ends = np.cumsum(lengths)
    # Links have one place more than there are tokens: -1, "none", leads there.
    nxt = np.arange(1, n + 2)
    nxt[ends - 1] = nxt[n] = -1
    prv = np.arange(-1, n)
    prv[ends - lengths] = prv[n] = -1
    tokens = np.append(tokens, np.int32(-1))
    index: dict[int, list[np.ndarray]] = {}
    narrow = np.uint16 if len(vocab.left) < 1 << 16 else np.int64

    def enter(positions: np.ndarray, rank: np.ndarray) -> list[int]:
        """Put pairs into the index; the ranks that it didn't have."""
        known = np.flatnonzero(rank >= 0)
        if not len(known):
            return []
        rank, positions = rank.take(known), positions.take(known)
        if len(rank) > 1:
            order = rank.astype(narrow).argsort(kind="stable")
            rank, positions = rank.take(order), positions.take(order)
        cuts = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(rank)]
        fresh = []
        for r, start, end in zip(rank.take(cuts[:-1]).tolist(), cuts, cuts[1:], strict=False):
            if r in index:
                index[r].append(positions[start:end])
            else:
                index[r] = [positions[start:end]]
                fresh.append(r)
        return fresh

    inside = np.flatnonzero(nxt[:n] >= 0)
    heap = enter(inside, vocab.byte_ranks.take(data.take(inside).astype(np.int64) * 256 + data.take(inside + 1)))
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.concatenate(lists)
        a, b, made = vocab.left[r], vocab.right[r], vocab.made[r]
        after = nxt.take(at)
        still = np.flatnonzero((tokens.take(at) == a) & (tokens.take(after) == b))
        if not len(still):
            continue
        if len(still) < len(at):
            at, after = at.take(still), after.take(still)
        if len(at) > 1 and (at[1:] <= at[:-1]).any():  # entered from both sides, or by several merges
            at = np.unique(at)
            after = nxt.take(at)
        if a == b and len(at) > 1:  # in a run of three the first two merge
            taken, last = [], -1
            for i, (p, q) in enumerate(zip(at.tolist(), after.tolist(), strict=True)):
                if p != last:
                    taken.append(i)
                    last = q
            at, after = at.take(taken), after.take(taken)
        beyond, before = nxt.take(after), prv.take(at)
        tokens[at] = made
        tokens[after] = -1
        nxt[at] = beyond
        prv[beyond] = at
        pairs = np.concatenate([before[before >= 0], at[beyond >= 0]])
        if len(pairs):
            for fresh in enter(pairs, vocab.ranks(tokens.take(pairs), tokens.take(nxt.take(pairs)))):
                heapq.heappush(heap, fresh)
    alive = tokens[:n] >= 0
    return tokens[:n][alive], np.add.reduceat(alive, ends - lengths, dtype=np.int64)


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i], starts[i]+1, ... of all pieces, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not total or starts.max() < 1 << 31) else np.int64
    out = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    out += np.arange(total, dtype=kind)
    return out


def _laid(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of large strings or binaries laid end to end, and the length of each."""
    _, offsets, data = strings.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(data or b"", dtype=np.uint8)[ends[0] : ends[-1]], np.diff(ends)


class Encoder:
    """Encodes blocks of texts to ids; each distinct chunk of a block is encoded once.

    A unit of text is cut before each space that follows no white space, or that is the last of its run and stands before a
    word: the pre-tokens of both sides don't depend on each other there.
    """

    _pretoken = regex.compile(PRETOKEN)
    _space = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    #: Units with a space inside a run of white space or at its end: they are not cut at every space.
    _uneven = rf"{_space} (?:{_space}|\z)"
    _cut = regex.compile(r"(?<!\s) |(?<=\s) (?=\S)")
    _nothing, _one_space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    #: Classes of bytes: 1 letter, 2 digit, 3 sign, 4 line feed, 5 space; others are left to the pattern.
    _class = np.zeros(256, dtype=np.uint8)
    _class[[*range(65, 91), *range(97, 123)]] = 1
    _class[48:58] = 2
    _class[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = 3
    _class[10] = 4
    _class[32] = 5

    def __init__(self, path: str) -> None:
        self.vocab = load(path)

    def _word_starts(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Flags of the bytes at which a pre-token begins, in chunks laid end to end."""
        kind = self._class[data]
        # Letters of U+00C0 to U+00FF: two bytes.
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7))
        kind[lead] = kind[lead + 1] = 1
        first = np.zeros(len(data), dtype=bool)
        first[starts] = True
        flags = first.copy()
        flags[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == 4)
        after_space = np.flatnonzero(kind[:-1] == 5) + 1
        flags[after_space[~first[after_space]]] = False  # a leading space goes with what follows
        odd = kind == 0
        odd[1:] |= (kind[1:] == 4) & (kind[:-1] == 4)
        odd |= (kind == 5) & ~first
        odd[1:] |= (kind[1:] == 4) & (kind[:-1] == 5)
        for i in np.flatnonzero(np.add.reduceat(odd, starts, dtype=np.int64)):
            a, n = starts[i], lengths[i]
            words = self._pretoken.findall(data[a : a + n].tobytes().decode("utf-8", "replace"))
            flags[a : a + n] = False
            flags[a + np.cumsum([0, *[len(w.encode()) for w in words[:-1]]])] = True
        return flags

    def _encode_chunks(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks laid end to end, and how many each has."""
        chunk_at = np.cumsum(lengths) - lengths
        words = np.flatnonzero(self._word_starts(data, chunk_at, lengths))
        # Distinct pre-tokens: a word with other signs after it is merged once.
        offsets = np.r_[words, len(data)]
        found = pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        merged, per = merge_all(self.vocab, *_laid(found.dictionary))
        which = found.indices.to_numpy()
        per_word = per.take(which)
        ids = merged.take(_ragged((np.cumsum(per) - per).take(which), per_word))
        return ids.astype("<u4"), np.add.reduceat(per_word, np.searchsorted(words, chunk_at))

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (large strings without white space), each as after a space in a text, and how many each has."""
        if not len(words):
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        return self._encode_chunks(*_laid(pc.binary_join_element_wise(self._nothing, words, self._one_space)))

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        """Ids of each unit (uint32). Units are not empty."""
        whole = pa.array([u.encode("utf-8", "replace") for u in units], pa.large_binary()).cast(pa.large_string())
        uneven = pc.match_substring_regex(whole, self._uneven).to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(whole.filter(pa.array(~uneven)), " ")
        counts, parts = [np.diff(parts.offsets.to_numpy())], [parts.flatten()]
        for i in np.flatnonzero(uneven):
            found = self._cut.split(whole[int(i)].as_py())
            counts.append(np.array([len(found)]))
            parts.append(pa.array(found, pa.large_string()))
        counts, parts = np.concatenate(counts), pa.concat_arrays(parts)
        starts = np.cumsum(counts) - counts
        # The first chunk of a unit stands without a space, the others after one.
        after = parts.dictionary_encode()
        first = parts.take(pa.array(starts)).dictionary_encode()
        which = after.indices.to_numpy().copy()
        which[starts] = len(after.dictionary) + first.indices.to_numpy()
        data, lengths = _laid(pc.binary_join_element_wise(self._nothing, after.dictionary, self._one_space))
        bare, bare_lengths = _laid(first.dictionary)
        lengths = np.concatenate([lengths, bare_lengths])
        some = np.flatnonzero(lengths)
        ids, found = self._encode_chunks(np.concatenate([data, bare]), lengths[some])
        per = np.zeros(len(lengths), dtype=np.int64)
        per[some] = found
        flat = ids[_ragged((np.cumsum(per) - per)[which], per[which])]
        pieces = np.split(flat, np.cumsum(np.add.reduceat(per[which], starts))[:-1])
        out: list[np.ndarray] = [flat] * len(units)
        for i, x in zip(np.r_[np.flatnonzero(~uneven), np.flatnonzero(uneven)].tolist(), pieces, strict=True):
            out[i] = x
        return out

    def encode(self, texts: list[str | None], specials: bool = True) -> list[np.ndarray]:
        """Ids of each text (uint32). Without `specials` the strings of added tokens are ordinary text."""
        added = self.vocab.added_pattern if specials else None
        plan: list[list[int]] = []  # an added id, or -1 for the next unit
        units: list[str] = []
        for text in texts:
            if not text:
                plan.append([])
            elif added is not None and added.search(text):
                parts = [x for x in added.split(text) if x]
                plan.append([self.vocab.added.get(x, -1) for x in parts])
                units += [x for x in parts if x not in self.vocab.added]
            else:
                plan.append([-1])
                units.append(text)
        pieces = iter(self.encode_units(units) if units else ())
        out = []
        for steps in plan:
            found = [next(pieces) if x < 0 else np.array([x], dtype="<u4") for x in steps]
            out.append(found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, dtype="<u4"))
        return out

    def blocks(self, texts: list[str | None], specials: bool = True) -> Iterator[tuple[int, list[np.ndarray]]]:
        """(index of the first text, ids of each) for blocks of about BLOCK_CHARS characters."""
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= BLOCK_CHARS:
                yield start, self.encode(texts[start : i + 1], specials)
                start, size = i + 1, 0
        if start < len(texts):
            yield start, self.encode(texts[start:], specials)


def decode_bytes(vocab: Vocabulary, ids: Iterable[int]) -> bytes:
    ids = np.asarray(ids, dtype=np.int64)
    return vocab.flat[_ragged(vocab.at[ids], vocab.lengths[ids])].tobytes()


def decode(vocab: Vocabulary, ids: Iterable[int]) -> str:
    return decode_bytes(vocab, ids).decode("utf-8", "replace")


def encode_texts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids binary, decoded string) for each row; ids are packed little-endian unsigned 32-bit."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            texts = batch.column(1).to_pylist()
            for start, packed in encoder.blocks(texts):
                plain = [decode(encoder.vocab, x) for x in packed]
                keys = batch.column(0).slice(start, len(packed))
                yield pa.RecordBatch.from_arrays([keys, pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(plain, pa.string())], names=[key, "ids", "decoded"])

    return df.select(key, text).mapInArrow(run, f"{key} long, ids binary, decoded string")


def op9_digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; digests are taken where the ids are, so no ids travel."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        names = [str(i) for i in range(encoder.vocab.size)]
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            for start, packed in encoder.blocks(batch.column(1).to_pylist()):
                rows = []
                for x in packed:
                    ids = x.tolist()
                    rows.append((len(ids), sha(",".join(map(names.__getitem__, ids)).encode()), sha(decode(encoder.vocab, x).encode())))
                n, ids_sha, text_sha = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, len(packed)), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_digests(table(spark, sf_dir, "documents"))
