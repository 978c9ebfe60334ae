"""Byte-level BPE through a sentencepiece model that is serialised directly from a rank file.

Each byte string of the vocabulary becomes a piece of printable characters, one per byte; its score is the negative rank,
so that sentencepiece's best-scored merge is the lowest-ranked one. Normalisation is the identity. Texts are cut by the
tokenizer's pattern; every pre-token is encoded by itself, distinct ones once per task. Nothing is trained.
"""
from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .hashing import parts_of

# Letters and numbers assigned after Unicode 16, which the tokenizer's pattern engine does not know as such
# and the regex library may; found by splitting every code point with both.
NEWER = ("\u0558 \u058B-\u058C \u088F \u0C5C \u0CDC \u208F \u209D-\u209F \uA7CE-\uA7CF \uA7D2 \uA7D4 \uA7DD \uA7E2 \uA7F1 \uAB6C-\uAB6D "
         "\U000107BB-\U000107BF \U00010940-\U00010959 \U00010EC5-\U00010EC7 \U00010ED9-\U00010EEE \U00011B0A \U00011DB0-\U00011DDB \U00011DE0-\U00011DE9 "
         "\U00011DF1 \U0001246F \U00012475-\U0001247F \U00012550-\U00012686 \U00016EA0-\U00016EB8 \U00016EBB-\U00016ED3 \U00016FF2-\U00016FF6 "
         "\U000187F8-\U000187FF \U00018CD6-\U00018CDA \U00018D09-\U00018D20 \U00018D80-\U00018DF2 \U00018E00-\U00019191 \U000191A0-\U000191D2 "
         "\U0001B123-\U0001B128 \U0001B168 \U0001D6A6 \U0001DF1F-\U0001DF24 \U0001DF2B-\U0001DF81 \U0001DF90-\U0001DF96 \U0001DFCD-\U0001DFFF "
         "\U0001E6C0-\U0001E6DE \U0001E6E0-\U0001E6E2 \U0001E6E4-\U0001E6E5 \U0001E6E7-\U0001E6ED \U0001E6F0-\U0001E6F4 \U0001E6FE-\U0001E6FF "
         "\U0002B73A-\U0002B73F \U0002B81E \U0002CEA2-\U0002CEAD \U000323B0-\U00033479 \U0003D000-\U0003FC3F").replace(" ", "")
#: Stands for them while a text is split: no letter, number or space in any version.
NONCHARACTER = "\uFFFF"
#: Distinct pre-tokens a task remembers before it starts anew, and the longest that is remembered.
CACHE, CACHED_CHARS = 200_000, 64


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where printable and not a space, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary of a rank file in the order of its ranks, which are the ids."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited, by the value's type."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(vocabulary: list[bytes]) -> bytes:
    """A sentencepiece BPE model: piece 0 is the unknown piece, piece i + 1 is the token of rank i."""
    chars = byte_chars()
    unknown, normal, bpe = 2, 1, 2
    pieces = [_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))]
    for rank, token in enumerate(vocabulary):
        piece = "".join(chars[b] for b in token).encode()
        pieces.append(_field(1, _field(1, piece) + _field(2, float(-rank)) + _field(3, normal)))
    trainer = _field(3, bpe) + _field(4, len(vocabulary) + 1) + _field(40, 0) + _field(41, -1 & (1 << 64) - 1) + _field(42, -1 & (1 << 64) - 1) + _field(43, -1 & (1 << 64) - 1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


def decoded(vocabulary: list[bytes], packed: bytes) -> bytes:
    """The bytes of packed ids."""
    return b"".join([vocabulary[i] for i in memoryview(packed).cast("I")])


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, vocabulary: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.vocabulary = vocabulary
        self.whole = {t: i for i, t in enumerate(vocabulary)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.split = self.pattern.findall
        self.newer = regex.compile(f"[{NEWER}]")
        self.map = dict(enumerate(byte_chars()))
        self.cache: dict[str, bytes] = {}

    def piece(self, token: str) -> bytes:
        """Packed ids of one pre-token. A token of the vocabulary is its own id, as merges need not reach every token."""
        raw = token.encode()
        rank = self.whole.get(raw)
        ids = [rank] if rank is not None else [i - 1 for i in self.model.encode(raw.decode("latin-1").translate(self.map))]
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if self.newer.search(token):
            self.resplit = True
        elif len(token) <= CACHED_CHARS:
            if len(self.cache) >= CACHE:
                self.cache.clear()
            self.cache[token] = packed
        return packed

    def encode(self, text: str) -> bytes:
        get, piece = self.cache.get, self.piece
        self.resplit = False
        packed = b"".join([get(t) or piece(t) for t in self.split(text)])
        if self.resplit:
            masked = self.newer.sub(NONCHARACTER, text)
            packed = b"".join([get(t) or piece(t) for t in (text[slice(*m.span())] for m in self.pattern.finditer(masked))])
        return packed

    def decode(self, packed: bytes) -> bytes:
        return decoded(self.vocabulary, packed)


class ByteBPE:
    """Column functions for one rank file; the vocabulary (its size is fixed by the file) is broadcast."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        vocabulary = read_ranks(path)
        shared = spark.sparkContext.broadcast((vocabulary, serialise(vocabulary), pattern))

        @F.pandas_udf("binary")
        def encode(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = Codec(*shared.value)
            for batch in texts:
                yield pd.Series([codec.encode(t) for t in batch], dtype=object)

        @F.pandas_udf("binary")
        def decode(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
            vocabulary = shared.value[0]
            for batch in ids:
                yield pd.Series([decoded(vocabulary, b) for b in batch], dtype=object)

        self._encode, self._decode = encode, decode

    def encode(self, text: Column) -> Column:
        """Ids of the whole text as packed little-endian unsigned 32-bit integers; null counts as empty."""
        return self._encode(F.coalesce(text, F.lit("")))

    def decode(self, ids: Column) -> Column:
        """The text's bytes."""
        return self._decode(F.coalesce(ids, F.lit(b"")))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, token_ids (packed, see `ByteBPE.encode`), n_tokens and the decoded bytes of each row's whole text.

    Null and empty texts have no tokens; repeated rows are encoded each; no rows give no rows; other columns are ignored.
    """
    vocabulary = read_ranks(path)
    # The size of the vocabulary is fixed by the file.
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, serialise(vocabulary), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            for part in parts_of(batch, 1):
                ids = [codec.encode(text or "") for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()),
                                                  pa.array([codec.decode(x) for x in ids], pa.binary())], ["doc_id", "token_ids", "n_tokens", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, token_ids binary, n_tokens bigint, decoded binary")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded bytes, from `encode_documents`."""
    return encoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
