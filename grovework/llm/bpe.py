"""Byte-level BPE encoding and decoding by prefix-sharing trie traversal.

BPE has a property that makes prefixes shareable: a token sequence is the
encoding of its text exactly if every token encodes to itself and no merge can
cross a border between neighbours. So each prefix of a word has one last token
that fits the encoding of what precedes it, and the state of a prefix is that
token alone. The distinct words of a batch form a trie; walking it depth first
(words in sorted order, states kept along the current path) finds the last
token of each prefix once, however many words share it. A word's encoding is
read off its path backwards.

Edge cases: null and empty texts give no ids and the empty text. Texts may be
of any length; memory follows the batch. Repeated rows stay repeated. Columns
of `docs` that are not in `keep` are dropped, so names cannot clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from grovework.llm.common import slices

#: Fixed value: the pattern that parts a text into words before merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Parts that need no look at the pattern: letters of the first Latin blocks, and ASCII marks but for the apostrophe.
PLAIN = r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable
    bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class State(NamedTuple):
    """What was read; the states by the next byte; the tokens that end here,
    longest first: their lengths, their ids and what they fit after."""

    read: bytes
    steps: dict[int, State]
    tokens: list[tuple[int, int, dict[int, bool]]]


STEPS, TOKENS = State._fields.index("steps"), State._fields.index("tokens")  # by place is faster than by name


class Tokenizer:
    """A byte-level BPE vocabulary with encodings of words by trie traversal."""

    def __init__(self, path: str, cache_words: int = 400_000, id_bytes: int = 4):
        """Encodings hold `id_bytes` bytes, 4 or 2, for each id. `cache_words` bounds the memory for encodings kept between batches:
        when it is reached, those not met since the last time are dropped,
        which changes no result."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.pieces = [b""] * size
        for token, i in self.ids.items():
            self.pieces[i] = token
        for token, i in self.special.items():
            self.pieces[i] = token.encode()
        self.sizes = [len(piece) for piece in self.pieces]
        self.words = regex.compile(WORDS)
        self.blanks = re.compile(r"\s\s")
        self.plain = re.compile(PLAIN)
        self.whole: dict[int, bool] = {}
        #: rank of a pair; rank and halves of a token (single bytes: -1)
        self.pair_rank: dict[tuple[int, int], int] = {}
        self.rank, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        for rank, merge in enumerate(spec["model"]["merges"]):
            a, b = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            left, right, whole = self.ids[a], self.ids[b], self.ids[a + b]
            self.pair_rank[left, right] = rank
            if self.rank[whole] < 0:
                self.rank[whole], self.left[whole], self.right[whole] = rank, left, right
        if id_bytes not in (2, 4) or size > 1 << 8 * id_bytes:
            raise ValueError(f"{size} ids don't fit in {id_bytes} bytes")
        self.kind = f"<u{id_bytes}"
        self.code = [i.to_bytes(id_bytes, "little") for i in range(size)]
        self.ids = {token: i for token, i in self.ids.items() if self._itself(i)}
        #: an automaton over bytes whose state is the longest suffix of what was
        #: read that begins a token; its states are made when first met
        self.beginnings = {token[:k] for token in self.ids for k in range(len(token) + 1)}
        self.states: dict[bytes, State] = {}
        #: for each token, whether it fits after a given one
        self.fits: dict[int, dict[int, bool]] = {}
        self.pairs_met = 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.parted = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _stays_parted(self, a: int, b: int, limit: float) -> bool:
        """Whether no merge crosses the border between a and b before `limit`:
        the merges on both sides are undone, latest first, and what then meets
        at the border must not merge earlier than what was undone."""
        while True:
            rank = self.pair_rank.get((a, b))
            if rank is not None and rank < limit:
                return False
            if self.rank[a] > self.rank[b]:
                limit, a = self.rank[a], self.right[a]
            elif self.rank[b] >= 0:
                limit, b = self.rank[b] + 1, self.left[b]
            else:
                return True

    def _itself(self, token: int) -> bool:
        """Whether a token encodes to itself."""
        own = self.whole.get(token)
        if own is None:
            own = self.rank[token] < 0 or (
                self._itself(self.left[token])
                and self._itself(self.right[token])
                and self._stays_parted(self.left[token], self.right[token], self.rank[token])
            )
            self.whole[token] = own
        return own

    def _state(self, read: bytes) -> State:
        """The automaton's state after `read`."""
        while read not in self.beginnings:
            read = read[1:]
        state = self.states.get(read)
        if state is None:
            tokens = [(len(read) - k, self.ids[read[k:]]) for k in range(len(read)) if read[k:] in self.ids]
            state = self.states[read] = State(read, {}, [(n, i, self.fits.setdefault(i, {})) for n, i in tokens])
        return state

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Little-endian ids of each distinct word, by one walk of their trie."""
        out: dict[str, bytes] = {}
        code, sizes = self.code, self.sizes
        last: list[int] = [-1]  # last token of each prefix on the path,
        states: list[State] = [self._state(b"")]  # and the automaton's state
        before = b""
        for word in sorted(words):  # code points sort as their bytes do
            key = word.encode()
            shared, most = 0, min(len(key), len(before))
            while shared < most and key[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], states[shared + 1 :]
            state, end = states[-1], shared
            for byte in key[shared:]:
                end += 1
                following = state[STEPS].get(byte)
                if following is None:
                    following = state.steps[byte] = self._state(state.read + bytes((byte,)))
                state = following
                for length, token, after in state[TOKENS]:
                    if length == end:
                        break
                    previous = last[end - length]
                    fit = after.get(previous)
                    if fit is None:
                        fit = after[previous] = self._stays_parted(previous, token, float("inf"))
                        self.pairs_met += 1
                    if fit:
                        break
                last.append(token)
                states.append(state)
            found = []
            while end:
                token = last[end]
                found.append(code[token])
                end -= sizes[token]
            found.reverse()
            out[word] = b"".join(found)
            before = key
        return out

    def segments(self, text: str) -> list[str]:
        """`text` in parts that can be cut into words one by one: a single
        space opens a part and a line end is one. Texts with longer blanks, and
        those with special tokens, are cut at once."""
        if self.parted and any(s in text for s in self.special):
            return [w for p in self.parted.split(text) for w in ([p] if p in self.special else self.words.findall(p))]
        if "\0" in text or self.blanks.search(text):
            return self.words.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def encode_batch(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers."""
        parted = [self.segments(text or "") for text in texts]
        if len(self.known) > self.cache_words:
            self.older, self.known = self.known, {}
        if self.pairs_met > 1_000_000:
            for after in self.fits.values():
                after.clear()
            self.pairs_met = 0
        known, older = self.known, self.older
        if not known:
            known.update({s: self.code[i] for s, i in self.special.items()})
        distinct = set().union(*parted).difference(known)
        again = distinct.intersection(older)
        known.update((part, older[part]) for part in again)
        words, joint = set(), {}
        for part in distinct.difference(again):
            plain = self.plain.fullmatch(part)
            if plain is not None and not plain[2]:
                words.add(part)
            else:
                joint[part] = own = self.words.findall(part) if plain is None else plain.groups()
                words.update(own)
        known.update(self.encode_words(words.difference(known)))
        known.update((part, b"".join(map(known.__getitem__, own))) for part, own in joint.items())
        return [b"".join(map(known.__getitem__, parts)) for parts in parted]

    def decode_batch(self, ids: Sequence[bytes]) -> list[str]:
        piece = self.pieces.__getitem__
        return [b"".join(map(piece, np.frombuffer(i, self.kind).tolist())).decode("utf-8", "replace") for i in ids]


@lru_cache(maxsize=2)
def tokenizer(path: str, cache_words: int = 400_000, id_bytes: int = 4) -> Tokenizer:
    """One per worker process and file."""
    return Tokenizer(path, cache_words, id_bytes)


def encode_documents(
    docs: DataFrame,
    path: str,
    text: str = "text",
    keep: Sequence[str] = ("doc_id",),
    decode: bool = True,
    id_bytes: int = 4,
    cache_words: int = 400_000,
    batch_bytes: int = 8_000_000,
    release: bool = False,
) -> DataFrame:
    """`keep` with token_ids (binary: little-endian unsigned ids of `id_bytes` bytes) and, if
    asked for, decoded (the text that those ids give).

    `path` is a vocabulary file that every executor can open. No shuffle: each
    task encodes its own rows batch by batch. `cache_words` and `batch_bytes`
    trade a worker's memory (some 500 MB at these values) for time, and change
    no result; with `release`, the worker keeps none of it after a task.
    """
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("token_ids", T.BinaryType())])
    if decode:
        schema.add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path, cache_words, id_bytes)
        for batch in slices(batches, 4096, len(keep), batch_bytes):
            ids = coder.encode_batch(batch.column(len(keep)).to_pylist())
            columns = [*batch.columns[: len(keep)], pa.array(ids, pa.binary())]
            if decode:
                columns.append(pa.array(coder.decode_batch(ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        if release:
            coder.older, coder.known = {}, {}

    return docs.select(*keep, docs[text].alias("__text")).mapInArrow(run, schema)
