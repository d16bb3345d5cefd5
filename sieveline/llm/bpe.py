"""Byte-level BPE encoding and decoding through a sentencepiece model made from the vocabulary.

The model is serialised here from a rank file (base64 token, rank on each line): every token's bytes
are written one character for a byte, its score is minus its rank, normalisation is the identity,
and the model type is BPE, so merging the pair of best score is merging the pair of least rank. A
text is cut into pre-tokens by the vocabulary's pattern, each is byte-mapped and encoded by
the model, and ids decode by mapping pieces back to bytes. Ids equal ranks.

Works on Arrow batches with no shuffle. A worker encodes a distinct pre-token once and keeps its ids
in a table that is emptied when it holds CACHE entries.

Defined cases: a null text has null ids and no count; an empty one has no ids; texts are taken
whole whatever their length; special tokens in a text are ordinary text; pairs that tie do not exist, since ranks
are distinct; rows that repeat and extra columns pass through, but columns named n_tokens, token_ids and
round_trip are replaced; an empty table gives an empty result. Ids decode to the exact bytes of the text.
"""

from __future__ import annotations

import base64
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ODD, chunks, code_points, flags, lean, read, string_buffer, sums

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CACHE = 300_000

#: Pre-tokens of texts that hold no odd character (see ``common.flags``), by the standard library's faster engine.
_FAST = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_EXACT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_characters() -> list[str]:
    """One printable character for each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in keep}
    for k, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + k)
    return [out[b] for b in range(256)]


def load_ranks(path: str) -> list[bytes]:
    """Token bytes by rank; a missing rank is empty."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for t, r in pairs:
        out[int(r)] = base64.b64decode(t)
    return out


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """The model file: pieces in order of rank, one unknown piece after them."""
    chars = byte_characters()
    rows = []
    for rank, t in enumerate(tokens):
        piece = "".join(chars[b] for b in t) or f"<gap {rank}>"
        rows.append(_field(1, _field(1, piece.encode()) + b"\x15" + struct.pack("<f", -float(rank)) + (b"" if t else _number(3, 5))))
    rows.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, 2)))
    trainer = _number(3, 2) + _number(4, len(rows)) + _number(40, len(tokens)) + _number(41, (1 << 64) - 1) + _number(42, (1 << 64) - 1) + _number(43, (1 << 64) - 1)
    normaliser = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(rows) + _field(2, trainer) + _field(3, normaliser)


class Codec(dict):
    """Encodes and decodes; as a dict, ids (little-endian int32 bytes) of pre-tokens seen so far."""

    def __init__(self, path: str = VOCABULARY):
        import sentencepiece

        super().__init__()
        self.tokens = load_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.tokens))
        self.table = {b: c for b, c in enumerate(byte_characters())}
        self.exact = None
        self.size = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)

    def pre_tokens(self, text: str, plain: bool) -> list[str]:
        if plain:
            return _FAST.findall(text)
        if self.exact is None:
            import regex

            self.exact = regex.compile(_EXACT)
        return self.exact.findall(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian int32."""
        raw = np.frombuffer(text.encode(), np.uint8)
        return self.encode_all(np.array([0, len(raw)]), raw)[0]

    def encode_all(self, off: np.ndarray, data: np.ndarray) -> list[bytes]:
        """Ids of consecutive texts; pre-tokens not seen yet are encoded in one call."""
        at, cp = code_points(off, data)
        odd = sums(flags()[cp] & ODD > 0, at) > 0
        raw = data[off[0] : off[-1]].tobytes()
        at = (off - off[0]).tolist()
        pre = [self.pre_tokens(raw[i:j].decode(), not o) for i, j, o in zip(at[:-1], at[1:], odd.tolist())]
        if len(self) >= CACHE:
            self.clear()
        new = list(set().union(*pre).difference(self))
        for p, ids in zip(new, self.model.encode([p.encode().decode("latin-1").translate(self.table) for p in new])):
            self[p] = struct.pack(f"<{len(ids)}i", *ids)
        return [b"".join(map(self.__getitem__, x)) for x in pre]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of these ids."""
        n = self.size[ids]
        total = int(n.sum())
        at = np.repeat(self.start[ids] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        return self.bytes[at].tobytes()


_CODECS: dict[str, Codec] = {}


def codec(path: str = VOCABULARY) -> Codec:
    """The worker's codec of a vocabulary."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``docs`` without ``text``, with n_tokens, token_ids and whether the ids decode to the text."""
    from pyspark.sql.types import StructType

    names = [c for c in docs.columns if c not in ("text", "n_tokens", "token_ids", "round_trip")]
    given = docs.select(*names, "text")
    schema = StructType([*given.schema.fields[:-1], *StructType.fromDDL("n_tokens int, token_ids array<int>, round_trip boolean").fields])

    def run(batches):
        c = codec(path)
        for b in batches:
            text = b.column(len(names))
            off, data = string_buffer(text)
            for i, j in chunks(off):
                got = c.encode_all(off[i : j + 1], data)
                n = np.array([len(x) // 4 for x in got], np.int64)
                flat = np.frombuffer(b"".join(got), np.int32)
                at = np.concatenate([[0], np.cumsum(n)])
                gone = np.array([not v for v in text.slice(i, j - i).is_valid().to_pylist()], bool)
                good = [c.decode(flat[at[k] : at[k + 1]]) == data[off[i + k] : off[i + k + 1]].tobytes() for k in range(j - i)]
                ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32), mask=np.append(gone, False)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*[x.slice(i, j - i) for x in b.columns[:-1]], pa.array(n.astype(np.int32), mask=gone), ids, pa.array(good, pa.bool_(), mask=gone)], names=schema.names)

    return given.mapInArrow(lean(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read(spark, sf_dir, "documents").select("doc_id", "text"))
