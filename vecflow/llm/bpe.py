"""Byte-pair encoding and decoding by forced boundaries.

A merge can only ever build a vocabulary token, so two neighbouring bytes that no
token contains side by side are never merged: a cut between them is certain. Each
word is cut at those pairs, every fragment is merged on its own, and the ids are
concatenated; fragments (and the white-space separated chunks built from them)
are remembered in bounded caches, so the merge loop runs once per distinct
fragment. Files of the ``tokenizers`` kind with a byte-level BPE model, an
end-of-word suffix and a splitting pattern are read; the path is a parameter, the
file's bytes go to the executors as one broadcast of bounded size.

Python's Unicode tables and the tokenizer's are of different ages. White-space separated
chunks with a character that Python's hold unassigned, or that combines otherwise in the
file's normaliser, are normalised and split into words by the file's own normaliser and
pre-tokenizer; their words are encoded here like all others.

Defined cases: a null text counts as the empty text (no ids, empty decoding);
texts of any length are handled in windows cut at spaces; repeated rows give
repeated results; an empty table gives an empty result; other columns of the
input are ignored unless asked for with ``keep``, and may bear any name.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecflow.llm.common import kept_between_tasks

#: largest tokenizer file that is broadcast
MAX_FILE_BYTES = 64 << 20
#: bytes per cache, at most (the two share most of what they hold)
CACHE_BYTES = 128 << 20
#: what an entry takes besides its characters and ids
ENTRY_BYTES = 180
#: characters encoded at a time
WINDOW = 1 << 20
_NEVER = 1 << 60
# Unicode White_Space, as the file's normaliser reads \s.
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def byte_alphabet() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in printable:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


@functools.cache
def unassigned() -> list[str]:
    """Characters that this Python's Unicode tables do not know, as ranges of a pattern's class."""
    ranges, start = [], None
    for c in range(sys.maxunicode + 2):
        out = c <= sys.maxunicode and unicodedata.category(chr(c)) == "Cn"
        if out and start is None:
            start = c
        elif not out and start is not None:
            ranges.append(f"{chr(start)}-{chr(c - 1)}")
            start = None
    return ranges


@functools.cache
def combining() -> tuple[list[str], list[str]]:
    """Characters that combine, and those that are canonically a sequence of others."""
    every = list(map(chr, range(sys.maxunicode + 1)))
    return ([c for c in every if unicodedata.combining(c)],
            [c for c in every if (d := unicodedata.decomposition(c)) and d[0] != "<"])


class Cache:
    """A dictionary of bounded size: when its newer half is full, the older half goes; what is found stays."""

    def __init__(self, size: int = CACHE_BYTES):
        self.half, self.held = size // 2, 0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, key: str) -> bytes | None:
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.keep(key, value)
        return value

    def keep(self, key: str, value: bytes) -> None:
        if self.held >= self.half:
            self.old, self.new, self.held = self.new, {}, 0
        self.held += len(key) + len(value) + ENTRY_BYTES
        self.new[key] = value


class ForcedBoundaryBPE:
    """Encoder and decoder for one tokenizer file (its JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("decoder") is not None or not model.get("end_of_word_suffix"):
            raise ValueError("a byte-level BPE file with an end-of-word suffix and no decoder is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self._source = text
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self._pattern = regex.compile(split["pattern"]["Regex"])
        alphabet = byte_alphabet()
        self._byte_of = {c: i for i, c in enumerate(alphabet)}
        # ids of single bytes, within a word and at its end
        self._inner = [self.vocab[c] for c in alphabet]
        self._final = [self.vocab[c + self.suffix] for c in alphabet]
        # merges by the pair of ids: their rank, and what they make
        self._rank: dict[int, int] = {}
        self._made: list[int] = []
        for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self._rank[self.vocab[a] << 32 | self.vocab[b]] = len(self._made)
            self._made.append(self.vocab[a + b])
        # byte pairs seen side by side in some token; all others are certain cuts
        self.inside: set[int] = set()
        for t in self.vocab:
            body = [self._byte_of[c] for c in t.removesuffix(self.suffix)]
            self.inside.update(x << 8 | y for x, y in zip(body, body[1:]))
        self._chunks, self._words = Cache(), Cache()
        self._plain: set[str] = set()  # characters known not to be odd

    # ------------------------------------------------------------ encoding
    def cuts(self, word: bytes) -> list[int]:
        """Where the word is certainly cut: before a byte that follows no such byte inside any token."""
        inside = self.inside
        return [i for i in range(1, len(word)) if word[i - 1] << 8 | word[i] not in inside]

    def _merge(self, parts: list[int], ranks: list[int]) -> list[int]:
        """Merges the ids of one fragment; ranks: of each neighbouring pair."""
        if len(parts) > 200:
            return self._merge_long(parts)
        rank, made = self._rank.get, self._made
        while ranks:
            low = min(ranks)
            if low == _NEVER:
                break
            i = ranks.index(low)
            new = parts[i] = made[low]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 32 | parts[i + 1], _NEVER)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 32 | new, _NEVER)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """The same merges with a heap and linked neighbours, for fragments of any length."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        live = list(parts)
        rank = self._rank.get
        heap = [(r, i) for i in range(n - 1) if (r := rank(live[i] << 32 | live[i + 1], _NEVER)) != _NEVER]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if live[i] >= 0 else n
            if j >= n or rank(live[i] << 32 | live[j], _NEVER) != r:
                continue
            live[i], live[j] = self._made[r], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (q := rank(live[i] << 32 | live[after[i]], _NEVER)) != _NEVER:
                    heapq.heappush(heap, (q, i))
            if (h := before[i]) >= 0 and (q := rank(live[h] << 32 | live[i], _NEVER)) != _NEVER:
                heapq.heappush(heap, (q, h))
        return [x for x in live if x >= 0]

    def _word(self, word: str) -> bytes:
        data = word.encode()
        parts = [self._inner[x] for x in data]
        parts[-1] = self._final[data[-1]]
        rank = self._rank.get
        ranks = [rank(x << 32 | y, _NEVER) for x, y in zip(parts, parts[1:])]
        # a pair that merges is inside the token it makes: only the others can be certain cuts
        if _NEVER in ranks and (cut := self.cuts(data)):
            ids = []
            for a, b in zip([0, *cut], [*cut, len(parts)]):
                ids += self._merge(parts[a:b], ranks[a:b - 1])
        else:
            ids = self._merge(parts, ranks)
        out = array("I", ids).tobytes()
        if len(word) <= 48:
            self._words.keep(word, out)
        return out

    def _chunk(self, chunk: str) -> bytes:
        find = self._words.find
        out = b"".join([find(w) or self._word(w) for w in (chunk,) if chunk.isalpha()] or [find(w) or self._word(w) for w in self._pattern.findall(chunk)])
        if len(chunk) <= 48:
            self._chunks.keep(chunk, out)
        return out

    @functools.cached_property
    def _file(self):
        """The file's own normaliser and pre-tokenizer."""
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(self._source)
        return own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str

    @functools.cached_property
    def _odd(self) -> re.Pattern[str]:
        """One character for which Python's Unicode tables may not be the file's: unassigned, of another combining
        class (it changes places with marks of the lowest or highest class), or composed by one of them only."""
        normal = self._file[0]

        def differs(text: str) -> bool:
            return normal(text) != unicodedata.normalize("NFC", text).lower()

        marks, composed = combining()
        odd = {c for c in marks if differs("\u0345" + c) or differs(c + "\u0334")}
        odd.update(parts[-1] for c in composed if not c.isspace() and differs(parts := unicodedata.normalize("NFD", c)))
        return re.compile("[" + "".join(unassigned() + sorted(map(re.escape, odd))) + "]")

    def _odd_in(self, text: str) -> re.Pattern[str] | None:
        """The odd characters of a text, if any. Each distinct character is tested once: the whole class is slow to search."""
        new = set(text) - self._plain
        odd = set(self._odd.findall("".join(new)))
        self._plain |= new - odd
        return re.compile("[" + "".join(map(re.escape, sorted(odd))) + "]") if odd else None

    def _by_file(self, chunk: str) -> bytes:
        normal, words = self._file
        out = []
        for word, _ in words(normal(chunk)):
            word = bytes(map(self._byte_of.__getitem__, word)).decode()
            out.append(self._words.find(word) or self._word(word))
        return b"".join(out)

    def windows(self, text: str) -> Iterator[bytes]:
        """Ids (little-endian unsigned 32-bit) of consecutive windows of a text."""
        pieces = self._special.split(text) if self._special and "<|" in text else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                yield array("I", [self.special[piece]]).tobytes()
                continue
            lo, strange = 0, None if piece.isascii() else self._odd_in(piece)
            while strange and (odd := strange.search(piece, lo)):
                # the white-space separated chunk around that character
                start, stop = odd.start(), _SPACE.search(piece, odd.end())
                while start > lo and not _SPACE.match(piece, start - 1):
                    start -= 1
                stop = stop.start() if stop else len(piece)
                yield from self._windows(piece[lo:start])
                yield self._by_file(piece[start:stop])
                lo = stop
            yield from self._windows(piece[lo:] if lo else piece)

    def _windows(self, piece: str) -> Iterator[bytes]:
        """Ids of consecutive windows of a text without special tokens and odd characters.

        Normalised as the file says: NFC, white space separates, lower case character
        by character (a final sigma like any other).
        """
        if not piece.isascii():
            piece = unicodedata.normalize("NFC", piece).replace("\u03a3", "\u03c3")
        piece = piece.lower()
        # str.split also parts at four control characters that are not white space here
        odd = any(c in piece for c in "\x1c\x1d\x1e\x1f")
        lo, cache, chunk = 0, self._chunks, self._chunk
        while lo < len(piece):
            cut = _SPACE.search(piece, lo + WINDOW) if len(piece) - lo > WINDOW else None
            hi = cut.start() if cut else len(piece)
            part = piece if hi - lo == len(piece) else piece[lo:hi]
            new = cache.new.get
            got = [new(c) or cache.find(c) or chunk(c) for c in (filter(None, _SPACE.split(part)) if odd else part.split())]
            if got:
                yield b"".join(got)
            lo = hi

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()

    def encode_bytes(self, text: str | None) -> bytes:
        return b"".join(self.windows(text or ""))

    # ------------------------------------------------------------ decoding
    def decode(self, ids) -> str:
        """Token texts joined by a space; special tokens stay."""
        return " ".join(map(self.tokens.__getitem__, ids))


_LOADED: dict[int, ForcedBoundaryBPE] = kept_between_tasks({})


def loaded(text: str) -> ForcedBoundaryBPE:
    """One encoder per Python worker and file."""
    key = hash(text)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ForcedBoundaryBPE(text)
    return _LOADED[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"tokenizer file of {len(text)} characters is larger than {MAX_FILE_BYTES}")
    return text


def encode_documents(docs: DataFrame, tokenizer_path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """(doc id, ids array<int>, decoded string) of each text: the operator's real output."""
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches):
        bpe = loaded(spec.value)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(i) for i in ids], pa.string())],
                names=[id, "ids", "decoded"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id), F.col(text)).mapInArrow(run, f"`{id}` {kind}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, tokenizer_path: str, text: str = "text", id: str = "doc_id") -> DataFrame:
    """Per document: n_tokens, SHA-256 of the ids, SHA-256 of the decoded text. No shuffle."""
    spec = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def run(batches):
        bpe = loaded(spec.value)
        for batch in batches:
            counts, ids_hex, text_hex = [], [], []
            for t in batch.column(1).to_pylist():
                n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
                for data in bpe.windows(t or ""):
                    of_ids.update(data)
                    decoded = bpe.decode(array("I", data))
                    of_text.update((" " + decoded if n else decoded).encode())
                    n += len(data) // 4
                counts.append(n)
                ids_hex.append(of_ids.hexdigest())
                text_hex.append(of_text.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
                names=[id, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id), F.col(text)).mapInArrow(
        run, f"`{id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
