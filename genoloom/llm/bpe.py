"""A byte-level BPE vocabulary as a sentencepiece model, and the encoding of a corpus with it.

The rank file is serialised directly as a sentencepiece BPE model: every token's bytes are
mapped to one character each, the score of a piece is its negative rank, and normalisation is
the identity, so sentencepiece merges exactly the pairs that the ranks order. Texts are cut into
pre-tokens first; each distinct pre-token is encoded once for a worker and looked up after that.

Defined cases: null and empty texts give an empty list; text of any length is encoded whole;
strings that look like special tokens are ordinary text; repeated rows are encoded each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from genoloom.runtime import pick

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
#: Distinct pre-tokens (and their characters) that a worker remembers before it starts afresh.
KNOWN, KNOWN_CHARS = 400_000, 1 << 25
SLICE_BYTES = 1 << 22

#: One character for each byte, none of them a space or changed by any normalisation.
_CHARS = {b: chr(0x100 + b) for b in range(256)}


def read_ranks(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & (1 << 64) - 1)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def piece_model(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece i is the token of rank i, the last piece is the unknown one."""
    # field numbers and enum values of sentencepiece_model.proto
    pieces = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        text = "".join(_CHARS[b] for b in token).encode()
        pieces.append(_field(1, _field(1, text) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank)) + _field(3, 1)))
    unknown = _field(1, _field(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _field(3, 2))
    n = len(ranks) + 1
    trainer = _field(3, 2) + _field(4, n) + _field(40, n - 1) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + unknown + _field(2, trainer) + _field(3, normalizer)


@lru_cache(maxsize=1)
def _classes() -> tuple[str, str]:
    """Letters and numbers as ranges of a character class."""
    out = {"L": [], "N": []}
    for kind, ranges in out.items():
        start = None
        for c in range(0x110001):
            inside = c <= 0x10FFFF and unicodedata.category(chr(c))[0] == kind
            if inside and start is None:
                start = c
            elif not inside and start is not None:
                ranges.append((start, c - 1))
                start = None
    return tuple("".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if a < b else re.escape(chr(a)) for a, b in out[k]) for k in "LN")


def _pattern(letters: str, numbers: str, spaces: str) -> re.Pattern:
    # the public pre-token pattern; letters stand first because the alternatives begin differently
    return re.compile(
        rf" ?[{letters}]+|'(?:s|t|re|ve|m|ll|d)| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


ASCII = _pattern("a-zA-Z", "0-9", "\t-\r ")


@lru_cache(maxsize=1)
def _unicode() -> re.Pattern:
    return _pattern(*_classes(), "\t-\r \x85\xa0  -     　")


def pretokens(text: str) -> list[str]:
    return (ASCII if text.isascii() else _unicode()).findall(text)


class Encoder(dict):
    """Pre-token -> its number in the tables of ids; filled as pre-tokens turn up."""

    def __init__(self, model: bytes):
        import sentencepiece

        super().__init__()
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table = str.maketrans({chr(b): c for b, c in _CHARS.items()})
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.new, self.chars = [], 0
        self.flat, self.starts, self.lens = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, token: str) -> int:
        self.new.append(token)
        self[token] = number = len(self)
        return number

    def _learn(self) -> None:
        mapped = [t.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table) for t in self.new]
        ids = self.pieces.encode(mapped, num_threads=1)
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for row in ids for x in row), np.int32, int(lens.sum()))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(lens) - lens]
        self.lens = np.r_[self.lens, lens]
        self.flat = np.r_[self.flat, flat]
        self.chars += sum(map(len, self.new))
        self.new = []

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and how many each text has."""
        if len(self) > KNOWN or self.chars > KNOWN_CHARS:
            self.forget()
        numbers, counts = [], np.zeros(len(texts), np.int64)
        get = self.__getitem__
        for i, text in enumerate(texts):
            if text:
                tokens = pretokens(text)
                counts[i] = len(tokens)
                numbers.append(np.fromiter(map(get, tokens), np.int64, len(tokens)))
        if self.new:
            self._learn()
        if not numbers:
            return np.zeros(0, np.int32), counts
        at = np.concatenate(numbers)
        lens = self.lens[at]
        ends = np.cumsum(lens)
        where = np.arange(ends[-1]) - np.repeat(ends - lens - self.starts[at], lens)
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(counts)]]
        return self.flat[where], np.diff(bounds)


def decode(ids: list[int], ranks: dict[bytes, int]) -> bytes:
    """The bytes of a list of ids; the inverse of the encoding."""
    tokens = {rank: token for token, rank in ranks.items()}
    return b"".join(tokens[i] for i in ids)


def slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded text size (a single longer text is one part)."""
    sizes = np.diff(np.asarray(_offsets(batch.column(column))))
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > SLICE_BYTES:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    return np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]


_encoders: dict[str, Encoder] = {}


def encoder(model) -> Encoder:
    """This worker's encoder for a broadcast model."""
    if model.id not in _encoders:
        _encoders.clear()
        _encoders[model.id] = Encoder(model.value)
    return _encoders[model.id]


class _Model:
    """A broadcast model with a name that tells workers which encoder fits."""

    def __init__(self, df: DataFrame, folder: str, name: str):
        model = piece_model(read_ranks(folder, name))
        self._b = df.sparkSession.sparkContext.broadcast(model)
        self.id = hashlib.sha256(model).hexdigest()

    @property
    def value(self) -> bytes:
        return self._b.value


def encode_documents(documents: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id, ids: the token ids of every document's whole text, without special tokens."""
    model = _Model(documents, folder, name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            for part in slices(batch, "text"):
                flat, counts = own.encode(part.column("text").to_pylist())
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    return pick(documents, ["doc_id", "text"]).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """doc_id, text of (doc_id, ids): the inverse mapping, a byte table indexed by id; null ids give an empty text.

    Bytes that are no UTF-8, which only cut lists of ids can give, become U+FFFD; an id that the
    vocabulary lacks is an error.
    """
    by_id = sorted((rank, token) for token, rank in read_ranks(folder, name).items())
    if [rank for rank, _ in by_id] != list(range(len(by_id))):
        raise ValueError(f"the ids of {name} are not dense")
    table = encoded.sparkSession.sparkContext.broadcast([token for _, token in by_id])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = table.value
        for batch in batches:
            texts = [b"".join([tokens[i] for i in row or ()]).decode("utf-8", "replace") for row in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return pick(encoded, ["doc_id", "ids"]).mapInArrow(run, "doc_id long, text string")
