"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

A text is cut where the splitting pattern is sure to end a match: before white space that follows anything
else.  No alternative of the pattern runs on from one into the other and none looks behind, so the pieces'
matches are the whole text's.  So long texts go through the library in runs of pieces, and white space too long
for its back-tracking regular expressions is cut by hand.

Nulls and empty texts: no tokens; bytes that aren't UTF-8 count as U+FFFD.  Row count, order within a partition and
repeated rows are kept; there is no shuffle, so very long texts and hot sources cost only their own length.  A worker
holds the ids of HELD tokens or of one text, as 32-bit integers.  Other columns are untouched.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import table, texts, use_package

#: White space as Unicode's White_Space property has it, which is what the library's `\s` means (Python's differs).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_LEADING = re.compile(f"[{SPACE}]*")
#: Runs of white space longer than this are split without the library's regular expressions.
LONG_SPACE = 1000
_LONG = re.compile(f"[{SPACE}]{{{LONG_SPACE + 1}}}")
#: Longer texts are encoded in runs of pieces of about this many characters.
RUN = 1 << 16
#: Tokens after which a batch is emitted.
HELD = 1 << 20


class Codec:
    """An encoding by ranks, through the library alone."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._match, self._ordinary, self._decode = library._encode_single_piece, library._core_bpe.encode_ordinary, library._core_bpe.decode_bytes
        names = [f"{i},".encode() for i in range(max(ranks.values()) + 1)]
        width = max(map(len, names))
        self._digits = np.frombuffer(b"".join(n.ljust(width, b"\0") for n in names), np.uint8).reshape(-1, width)

    def runs(self, text: str) -> Iterator[list[int]]:
        """The ids of a text, run by run."""
        if len(text) <= LONG_SPACE or (len(text) <= RUN and not _LONG.search(text)):
            yield self._ordinary(text)
            return
        held: list[str] = []
        size = 0
        for m in _PIECES.finditer(text):
            piece = m.group()
            lead = _LEADING.match(piece).end() if len(piece) > LONG_SPACE else 0
            if lead > LONG_SPACE or size > RUN:
                yield self._ordinary("".join(held))
                held, size = [], 0
            if lead > LONG_SPACE:  # all of it but what the next match takes is one match
                own = lead if lead == len(piece) else lead - 1
                yield self._match(piece[:own])
                piece = piece[own:]
            held.append(piece)
            size += len(piece)
        yield self._ordinary("".join(held))

    def encode(self, text: str) -> np.ndarray:
        made = [np.array(ids, np.int32) for ids in self.runs(text)]
        return made[0] if len(made) == 1 else np.concatenate(made)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self._decode(ids[i : i + RUN].tolist()) for i in range(0, len(ids), RUN))

    def digest(self, text: str) -> tuple[int, str, str]:
        n, named, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.runs(text):
            digits = self._digits[np.array(ids, np.int64)].ravel() if ids else np.zeros(0, np.uint8)
            digits = digits[digits != 0][:-1]
            if n and ids:
                named.update(b",")
            named.update(digits.data)
            decoded.update(self._decode(ids))
            n += len(ids)
        return n, named.hexdigest(), decoded.hexdigest()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def default_ranks() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in columns]
    return pa.RecordBatch.from_arrays([c for _, c in kept] + list(columns.values()), names=[n for n, _ in kept] + list(columns))


def _with(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    new = {f.name for f in fields}
    return T.StructType([f for f in df.schema.fields if f.name not in new] + fields)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`df` with the column `ids` (array<int>), replaced if there is one."""

    def part(b: pa.RecordBatch, held: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
        return _appended(b, {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held), pa.int32()))})

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            begin, held, size = 0, [], 0
            for i, t in enumerate(texts(b.column(b.schema.get_field_index(text)))):
                held.append(c.encode(t))
                size += len(held[-1])
                if size >= HELD or i + 1 == b.num_rows:
                    yield part(b.slice(begin, i + 1 - begin), held)
                    begin, held, size = i + 1, [], 0

    return df.mapInArrow(run, _with(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", raw: str = "decoded") -> DataFrame:
    """`df` with the column `raw`: the bytes that `ids` stand for (null: none)."""

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            rows = (r.values.to_numpy(zero_copy_only=False) if r.is_valid else np.zeros(0, np.int32) for r in b.column(b.schema.get_field_index(ids)))
            yield _appended(b, {raw: pa.array([c.decode(r) for r in rows], pa.binary())})

    return df.mapInArrow(run, _with(df, [T.StructField(raw, T.BinaryType())]))


def digests(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """`df` without its text, with n_tokens, ids_sha256 and decoded_sha256; encodes, then decodes the ids."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([f for f in _with(df, fields).fields if f.name != text])

    def run(batches):
        c = codec(path, pattern)
        for b in batches:
            at = b.schema.get_field_index(text)
            made = [c.digest(t) for t in texts(b.column(at))]
            n, a, d = zip(*made, strict=True) if made else ((), (), ())
            rest = pa.RecordBatch.from_arrays([x for i, x in enumerate(b.columns) if i != at], names=[x for i, x in enumerate(b.schema.names) if i != at])
            yield _appended(rest, {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(d, pa.string())})

    return df.mapInArrow(run, schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), *default_ranks())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's last stage: token ids in place of the text, which they give back byte for byte."""
    use_package(spark)
    path, pattern = default_ranks()
    return encode(docs, path, pattern).withColumn("n_tokens", F.size("ids").cast("long")).drop("text")
