"""Byte-level BPE, exact: a backtracking encoder and an offset-table decoder.

Encoding. A pattern splits a text into pieces. Within a piece an Aho-Corasick automaton over the
vocabulary finds the longest token at each byte. The encoder takes the longest token; where it does
not go with the token before it, the next shorter one that is a prefix; where none goes, it steps
back and marks the byte as a dead end. Two tokens go together if merging their bytes on their own
would leave just these two; that is a table, filled when a pair is first met. If each neighbouring
pair goes together, the whole is what the merges give, and each byte is a dead end once at most:
linear time. A token that its own merges would not give never counts.

Decoding. All tokens' bytes lie in one buffer; ids index a table of offsets into it.

Pieces repeat, so a worker keeps what it has encoded, up to a fixed number of pieces.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEPT = 400_000  # pieces whose ids a worker keeps
PAIRS = 400_000  # entries of the pair table that a worker keeps
#: Fixed values of the vocabulary's format: white space and the pattern that splits texts.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

LIBRARY_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Pieces(dict):
    """piece -> its ids as bytes; at KEPT entries it starts anew."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        ids = self.make(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    """A vocabulary of the ``tokenizers`` library's byte-level BPE files."""

    def __init__(self, path: str, library: bool = False) -> None:
        """With ``library`` the pieces that are not kept go to a tokenizer library with the same vocabulary."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        vocab, model = {}, spec["model"]
        for name, i in model["vocab"].items():
            vocab[to_bytes(name)] = i
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = max([*vocab.values(), *special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * n
        for b, i in vocab.items():
            self.token_bytes[i] = b
        for text, i in special.items():
            self.token_bytes[i] = text.encode()
        self.vocab, self.special = vocab, special
        # merges in order: rank -> the two parts; a token's rank says when it comes to be (bytes: before all)
        self.rank, self.parts, self.merged = [-1] * n, [None] * n, {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (vocab[to_bytes(x)] for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = vocab[self.token_bytes[left] + self.token_bytes[right]]
            self.merged.setdefault((left, right), rank)
            if self.parts[whole] is None:
                self.rank[whole], self.parts[whole] = rank, (left, right)
        self.automaton = ahocorasick.Automaton()
        for b, i in vocab.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.lengths = np.fromiter(map(len, self.token_bytes), np.int64, n)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.buffer = np.frombuffer(b"".join(self.token_bytes), np.uint8)
        self._shorter: dict[int, int] = {}
        self._pair: dict[tuple[int, int], bool] = {}
        self._sound: dict[int, bool] = {}
        self.split = regex.compile(PATTERN)
        self.pieces = _Pieces(self._piece)
        self.words = _Pieces(self._word)
        if library:
            import tiktoken

            fast = tiktoken.Encoding("own", pat_str=LIBRARY_PATTERN, mergeable_ranks=vocab, special_tokens={})
            encode = lambda s: np.array(fast.encode_ordinary(s), "<u4").tobytes()
            self.pieces, self.words = _Pieces(encode), _Pieces(lambda w: encode(" " + w))
        self.stops = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    # -- tables -----------------------------------------------------------------------------------

    def shorter(self, token: int) -> int:
        """The longest other token that is a prefix of this one and sound; -1 if none."""
        found = self._shorter.get(token)
        if found is None:
            b, found = self.token_bytes[token], -1
            for end in range(len(b) - 1, 0, -1):
                t = self.vocab.get(b[:end])
                if t is not None and self.sound(t):
                    found = t
                    break
            self._shorter[token] = found
        return found

    def sound(self, token: int) -> bool:
        """Do the merges give this token for its own bytes?"""
        found = self._sound.get(token)
        if found is None:
            parts = self.parts[token]
            if parts is None:
                found = len(self.token_bytes[token]) == 1
            else:
                found = self.sound(parts[0]) and self.sound(parts[1]) and self._meets(*parts, self.rank[token])
            self._sound[token] = found
        return found

    def goes(self, a: int, b: int) -> bool:
        """Would merging the bytes of both leave just these two tokens?"""
        found = self._pair.get((a, b))
        if found is None:
            if len(self._pair) >= PAIRS:
                self._pair.clear()
            found = self._pair[a, b] = self._meets(a, b, len(self.merged))
        return found

    def _meets(self, a: int, b: int, limit: int) -> bool:
        """Before merge ``limit``, does no merge cross the border of a and b?

        Undo the merges of both, the last first. The two tokens at the border stay until the merge
        that was just undone, so their own merge crosses the border if its turn comes before that.
        Of equal merges the left one comes first: it saves the border from its equal to the right.
        """
        rank, parts, merged = self.rank, self.parts, self.merged
        while True:
            crossing = merged.get((a, b))
            if crossing is not None and crossing < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], parts[a][1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, parts[b][0]
            else:
                return True

    # -- encoding ---------------------------------------------------------------------------------

    def _bytes(self, data: bytes) -> list[int]:
        """Ids of one piece's bytes."""
        whole = self.vocab.get(data)
        if whole is not None and self.sound(whole):
            return [whole]
        n = len(data)
        longest = [(0, -1)] * n
        for end, (size, token) in self.automaton.iter(data.decode("latin-1")):
            if size > longest[end - size + 1][0]:
                longest[end - size + 1] = (size, token)
        lengths, goes, shorter = self.token_bytes, self.goes, self.shorter
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        at, token = 0, -1
        while at < n:
            if token < 0:
                token = longest[at][1]
                if not self.sound(token):
                    token = shorter(token)
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(lengths[token])
                if alive[end] and (last < 0 or goes(last, token)):
                    break
                token = shorter(token)
            if token >= 0:
                out.append(token)
                at, token = end, -1
            else:  # nothing goes after the last token: take that back, and never come here again
                alive[at] = 0
                token = out.pop()
                at -= len(lengths[token])
        return out

    def _piece(self, piece: str) -> bytes:
        return np.array(self._bytes(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """What stands between two single spaces, with the space before it."""
        return b"".join(map(self.pieces.__getitem__, self.split.findall(" " + word)))

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; special tokens' strings give their ids."""
        if not text:
            return b""
        if self.stops is None or not self.stops.search(text):
            return self._plain(text)
        out = []
        for k, part in enumerate(self.stops.split(text)):
            out.append(np.array([self.special[part]], "<u4").tobytes() if k % 2 else self._plain(part))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        """A single space between two characters that are none is always a border of pieces."""
        words = text.split(" ")
        if "" in words or any(w[0].isspace() or w[-1].isspace() for w in words):
            return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))
        first = b"".join(map(self.pieces.__getitem__, self.split.findall(words[0])))
        return first + b"".join(map(self.words.__getitem__, words[1:]))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    # -- decoding ---------------------------------------------------------------------------------

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of all ids, gathered by the offset table, a bounded number at a time."""
        out = []
        for begin in range(0, len(ids), 1 << 18):
            part = ids[begin : begin + (1 << 18)].astype(np.int64)
            size = self.lengths[part]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(self.offsets[part] - (ends - size), size)
            out.append(self.buffer[at].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, library: bool = False) -> Codec:
    """One for each worker process and vocabulary."""
    return Codec(path, library)


_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digest(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for text in b.column(1):
                data = own.encode_bytes(text.as_py())
                ids = np.frombuffer(data, "<u4")
                n.append(len(ids))
                ids_sha.append(sha(data))
                text_sha.append(sha(own.decode(ids).encode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode each text and decode it again: the number of ids, and digests of ids and decoded text.

    Null and empty texts have no ids. Repeated rows get a row each; no rows give no rows.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_digest(path), _DIGEST)


def encode_column(docs: DataFrame, path: str, text_col: str = "text", library: bool = False) -> DataFrame:
    """``docs`` with a column ``ids`` (array of ints)."""

    def run(texts: pd.Series) -> pd.Series:
        own = codec(path, library)
        return texts.map(lambda t: own.encode(t).astype(np.int32))

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return docs.withColumn("ids", F.pandas_udf(run, "array<int>")(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
