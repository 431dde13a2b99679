"""Byte-level BPE: ids by a file of ranks, offsets in characters, and the way back, over Arrow batches.

The rank file (base64 token, rank) is read once on the driver and broadcast (``max_vocab_bytes`` bounds it). Workers build a ``tokenizers`` model from
it: each byte is written as one printable character, and a merge is listed for every way to split a token into two others, in order of
ranks, so that any neighbours whose union is a token merge, lowest rank first. Decoding reverses the byte table and joins bytes before it
makes characters of them, so characters split over tokens come back whole; a list of ids that ends within a character gives U+FFFD there.

Memory: a text is encoded in slices cut before white space that follows other characters, where a piece of the pattern ends in any case; a batch
is encoded some hundred thousand characters at a time.

Cases: null texts count as empty; empty texts have no tokens. Null ids are null texts; unknown ids are an error. Repeated rows each get the same. A long text without such white space
is one slice. Ties: of equal ranks there are none. An empty table gives an empty result. Extra
columns pass through ``encode`` and ``decode``; an output column of theirs that clashes is an error told before the job starts.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

SLICE = 50_000
"""Characters a text is cut to, and a call's texts add up to, about."""
CUT = re.compile(r"(?<=\S)[ \n]")
VOCABULARY = "byte_bpe_50k.tiktoken"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """A printable character for each byte: itself in the printable Latin-1 ranges, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(free)) for b in range(256)]


def read_ranks(path: str, max_vocab_bytes: int = 64_000_000) -> bytes:
    with open(path, "rb") as f:
        data = f.read(max_vocab_bytes + 1)
    if len(data) > max_vocab_bytes:
        raise ValueError(f"{path} has over {max_vocab_bytes} bytes")
    return data


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks_file: bytes, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        table = byte_characters()
        written = {token: token.decode("latin-1").translate(dict(enumerate(table))) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            merges += [(written[token[:i]], written[token[i:]]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        model = models.BPE(vocab={written[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=10_000)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        reverse = {c: b for b, c in enumerate(table)}
        self.bytes_of: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = bytes(reverse[c] for c in written[token])

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text, in order."""
        slices, owners, size = [], [], 0
        ids: list[int] = []
        at = 0
        for k, text in enumerate(texts):
            for part in _slices(text or ""):
                slices.append(part)
                owners.append(k)
                size += len(part)
                if size >= SLICE:
                    for owner, got in zip(owners, self.tokenizer.encode_batch_fast(slices, add_special_tokens=False), strict=True):
                        while at < owner:
                            yield ids
                            ids, at = [], at + 1
                        ids += got.ids
                    slices, owners, size = [], [], 0
        for owner, got in zip(owners, self.tokenizer.encode_batch_fast(slices, add_special_tokens=False), strict=True):
            while at < owner:
                yield ids
                ids, at = [], at + 1
            ids += got.ids
        while at < len(texts):
            yield ids
            ids, at = [], at + 1

    def decode_bytes(self, ids) -> bytes:
        table = self.bytes_of
        return b"".join([table[i] for i in ids])

    def offsets(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First character and character after the last of each token; tokens that share a character overlap in it."""
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64) - 1
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ids) else ends
        return (character[starts], character[ends - 1] + 1) if len(ids) else (starts, ends)


def _slices(text: str) -> Iterator[str]:
    start = 0
    while start < len(text):
        m = CUT.search(text, start + SLICE) if len(text) - start > SLICE else None
        end = m.start() if m else len(text)
        yield text[start:end]
        start = end


_codecs: dict[tuple[str, str], Codec] = {}


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """One a worker process and rank file."""
    key = (hashlib.md5(ranks_file).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = Codec(ranks_file, pattern)
    return _codecs[key]


def _mapped(df: DataFrame, over, schema: T.StructType, vocabulary: str | None, pattern: str | None) -> DataFrame:
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary or default_vocabulary()))
    pattern = pattern or default_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        own = codec(shared.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                yield over(own, batch.slice(start, 500))

    return df.mapInArrow(run, schema)


def _free(df: DataFrame, *names: str) -> None:
    taken = {c.lower() for c in df.columns} & {*names}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")


def encode(df: DataFrame, text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with ``ids``, ``starts`` and ``ends`` (arrays; offsets in characters)."""
    _free(df, "ids", "starts", "ends")
    schema = T.StructType([*df.schema.fields, *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("ids", "starts", "ends")]])

    def over(own: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        ids = list(own.encode_all(texts))
        spans = [own.offsets(t or "", i) for t, i in zip(texts, ids, strict=True)]
        lists = pa.list_(pa.int32())
        new = [pa.array(ids, lists), pa.array([s.astype(np.int32) for s, _ in spans], lists), pa.array([e.astype(np.int32) for _, e in spans], lists)]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "ids", "starts", "ends"])

    return _mapped(df, over, schema, vocabulary, pattern)


def decode(df: DataFrame, ids: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """``df`` with ``decoded`` (bytes) and ``decoded_text``."""
    _free(df, "decoded", "decoded_text")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())])

    def over(own: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [None if i is None else own.decode_bytes(i) for i in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
        new = [pa.array(raw, pa.binary()), pa.array([None if r is None else r.decode("utf-8", "replace") for r in raw], pa.string())]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "decoded", "decoded_text"])

    return _mapped(df, over, schema, vocabulary, pattern)


def digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: n_tokens, ids_sha256 and decoded_sha256 of a full round trip, without its ids."""
    narrow = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("n_tokens", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("ids_sha256", "decoded_sha256")]])
    numbers: list[str] = []

    def over(own: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        if not numbers:
            numbers.extend(map(str, range(len(own.bytes_of))))
        n, a, b = [], [], []
        for ids in own.encode_all(batch.column(1).to_pylist()):
            n.append(len(ids))
            a.append(hashlib.sha256(" ".join([numbers[i] for i in ids]).encode()).hexdigest())
            b.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _mapped(narrow, over, schema, vocabulary, pattern)
