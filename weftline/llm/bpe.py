"""Byte-level BPE by dynamic programming over prefixes.

The encoding of a prefix ends in exactly one token, and dropping that token
leaves the encoding of a shorter prefix. So for each prefix it suffices to
find the one vocabulary token that (a) is a suffix of the prefix, which an
automaton with suffix links reports in one pass, and (b) can stand next to the
last token of what remains: merging would never have joined the two across
their border. Following the stored last tokens back from the end gives the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Fixed value: the split of byte-level BPE into pieces, before any merge.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space with white space on both sides. The \s of re holds all that the split's does.
INSIDE = re.compile(r" (?=\s)(?<=\s )")
VOCABULARY = "byte_bpe_50k.json"
#: Chunks (words with their punctuation) that a worker remembers; then it forgets all.
REMEMBERED = 500_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A vocabulary file: ids by token bytes, special tokens, and merges in their order."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.merges = [tuple(map(as_bytes, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        self.splits = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None


class Bpe:
    def __init__(self, path: str):
        words = Vocabulary(path)
        ids, self.special, self.splits = words.ids, words.special, words.splits
        self.bytes_of = {i: b for b, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        # Work on birth numbers: the 256 bytes first, then tokens by the merge that makes them.
        born = {bytes([b]): b for b in range(256)}
        self.made_of: list[tuple[int, int] | None] = [None] * 256
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in words.merges:
            born[a + b] = self.pair[born[a], born[b]] = len(self.made_of)
            self.made_of.append((born[a], born[b]))
        self.id_of = [0] * len(self.made_of)
        self.automaton = ahocorasick.Automaton()
        for text, n in born.items():
            self.id_of[n] = ids[text]
            self.automaton.add_word(text.decode("latin-1"), (len(text), n))
        self.automaton.make_automaton()
        self.whole = {text: (ids[text],) for text in born if len(text) == 1}
        self.pieces = regex.compile(PIECES)
        self.apart = lru_cache(maxsize=1 << 18)(self._apart)
        self.known_pieces = Remembered(lambda piece: self.encode_piece(piece.encode()))

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging leaves left and right as they are when they stand side by side.

        Undo the later of the merges inside the two, again and again. A pair
        that meets at the border and has a merge older than the one just
        undone would have been joined first.
        """
        before = len(self.made_of)
        while True:
            met = self.pair.get((left, right), before)
            if met < before:
                return False
            if left > right:
                before, halves = left, self.made_of[left]
                if halves is None:
                    return True
                left = halves[1]
            else:
                # equal numbers: the left one of two equal merges is made first
                before, halves = right + 1, self.made_of[right]
                if halves is None:
                    if self.made_of[left] is None:
                        return True
                    before, left = left, self.made_of[left][1]
                    continue
                right = halves[0]

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        last: list[tuple[int, int] | None] = [None] * len(piece)
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            if last[end] is None:
                start = end - size
                if start < 0 or ((rest := last[start]) is not None and self.apart(rest[1], token)):
                    last[end] = (size, token)
        out, at = [], len(piece) - 1
        while at >= 0:
            size, token = last[at]
            out.append(self.id_of[token])
            at -= size
        return tuple(out[::-1])

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        # words come with and without punctuation: their pieces are remembered too
        return tuple(chain.from_iterable(map(self.known_pieces.__getitem__, self.pieces.findall(chunk))))


class Remembered(dict):
    """make(chunk) of every short chunk asked for, up to a bound."""

    def __init__(self, make, most: int = REMEMBERED):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, chunk):
        out = self.make(chunk)
        if len(chunk) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[chunk] = out
        return out


def chunks_of(text: str, splits, special) -> Iterator[list[str]]:
    """Lists of chunks that can be encoded one by one.

    A piece never runs past the space before a word, nor from a word into the
    space after it, so single spaces at a word are safe places to cut. A space
    between other white space is inside a piece: a segment with one, or with
    other runs of spaces, is left whole. Special tokens come as chunks of
    their own.
    """
    for segment in splits.split(text) if splits and any(s in text for s in special) else (text,):
        if segment in special or "  " in segment or segment[:1] == " " or segment[-1:] == " " or INSIDE.search(segment):
            if segment:
                yield [segment]
        elif segment:
            first, *rest = segment.split(" ")
            yield [first, *[" " + x for x in rest]]


@lru_cache(maxsize=2)
def _loaded(path: str) -> Bpe:
    return Bpe(path)


class Encoder:
    """Encodes whole texts; one for each worker process."""

    def __init__(self, path: str):
        self.bpe = _loaded(path)
        self.known = Remembered(self._entry)

    def _entry(self, chunk: str) -> tuple[int, str, tuple[int, ...]]:
        ids = (self.bpe.special[chunk],) if chunk in self.bpe.special else self.bpe.encode_chunk(chunk)
        return len(ids), ",".join(map(str, ids)), ids

    def entries(self, text: str) -> list[tuple[int, str, tuple[int, ...]]]:
        out = []
        for chunks in chunks_of(text, self.bpe.splits, self.bpe.special):
            # what stands alone is as a rule long or rare: only its pieces are worth remembering
            out += map(self.known.__getitem__, chunks) if len(chunks) > 1 else map(self._entry, chunks)
        return out

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(e[2] for e in self.entries(text)))

    def decode(self, ids) -> str:
        return b"".join(map(self.bpe.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of each row's whole text.

    Null text encodes as empty. Rows are independent: repeated rows, null
    ids and further columns (dropped here) make no difference.
    """
    path = path or vocabulary_path()

    def run(parts):
        enc = encoder(path)
        for part in parts:
            ids = [enc.encode(t or "") for t in part.column("text").to_pandas()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of what encode_documents returns; null ids give a null text."""
    path = path or vocabulary_path()

    def run(parts):
        enc = encoder(path)
        for part in parts:
            texts = [None if x is None else enc.decode(x) for x in part.column("ids").to_pandas()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def bpe_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode each whole text, decode its ids, and return the digests of both (null text: empty)."""
    path = path or vocabulary_path()

    def run(parts):
        enc = encoder(path)
        for part in parts:
            n, ids_sha, decoded_sha = [], [], []
            for text in part.column("text").to_pandas():
                entries = enc.entries(text or "")
                ids = ",".join([e[1] for e in entries])
                decoded = enc.decode(chain.from_iterable([e[2] for e in entries]))
                n.append(sum([e[0] for e in entries]))
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
            arrays = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return bpe_digests(docs)
