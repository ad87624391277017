"""BAM files as SAM lines.

A file is one row of Spark's binaryFile source and is decoded by one task, member by member
of its BGZF stream; many files run side by side.  A file must stay below that source's limit
of 2 GB: larger ones are better split, or given as SAM text, which Spark reads in pieces.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# fixed values: the BAM format's letters
_CIGAR = "MIDNSHP=X"
_BASES = "=ACMGRSVTWYHKDBN"
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


class _Stream:
    """Bytes of concatenated gzip members, decompressed as they are asked for."""

    def __init__(self, data: bytes):
        self.data, self.at, self.z, self.held = memoryview(data), 0, None, bytearray()

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.at < len(self.data):
            self.z = self.z or zlib.decompressobj(31)
            part = self.data[self.at : self.at + (1 << 16)]
            self.held += self.z.decompress(part)
            self.at += len(part) - len(self.z.unused_data)
            if self.z.eof:
                self.z = None
        if n and len(self.held) < n and self.held:
            raise ValueError("the BAM file ends within a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def int(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def _tags(raw: bytes) -> Iterator[str]:
    at = 0
    while at < len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(raw[at]), at + 1
        elif kind in "ZH":
            end = raw.index(0, at)
            value, at = raw[at:end].decode(), end + 1
        elif kind == "B":
            code, n = chr(raw[at]), struct.unpack_from("<i", raw, at + 1)[0]
            form = f"<{n}{_NUMBERS[code]}"
            value = ",".join([code, *(f"{x:g}" if code == "f" else str(x) for x in struct.unpack_from(form, raw, at + 5))])
            at += 5 + struct.calcsize(form)
        else:
            form = "<" + _NUMBERS[kind]
            x = struct.unpack_from(form, raw, at)[0]
            value, at = (f"{x:g}" if kind == "f" else str(x)), at + struct.calcsize(form)
        yield f"{name}:{'i' if kind in 'cCsSiI' else kind}:{value}"


def _header(s: _Stream) -> tuple[list[str], list[str]]:
    """(text lines, names of references)."""
    if s.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = s.take(s.int()).rstrip(b"\0").decode()
    names = []
    for _ in range(s.int()):
        names.append(s.take(s.int())[:-1].decode())
        s.int()
    return [x for x in text.split("\n") if x], names


def sam_lines(data: bytes) -> Iterator[tuple[str, str]]:
    """(read name, SAM line) of each alignment."""
    s = _Stream(data)
    _, refs = _header(s)
    ref = lambda i: "*" if i < 0 else refs[i]
    while size := s.take(4):
        raw = s.take(struct.unpack("<i", size)[0])
        rid, pos, n_name, mapq, _, n_cigar, flag, n_seq, mate, mate_pos, length = struct.unpack_from("<iiBBHHHiiii", raw)
        name, at = raw[32 : 32 + n_name - 1].decode(), 32 + n_name
        cigar = "".join(f"{x >> 4}{_CIGAR[x & 15]}" for x in struct.unpack_from(f"<{n_cigar}I", raw, at)) or "*"
        at += 4 * n_cigar
        packed = raw[at : at + (n_seq + 1) // 2]
        seq = "".join(_BASES[b >> 4] + _BASES[b & 15] for b in packed)[:n_seq] or "*"
        at += len(packed)
        qual = raw[at : at + n_seq]
        quality = "*" if not qual or qual[0] == 255 else "".join(chr(33 + q) for q in qual)
        next_ref = "=" if mate == rid and mate >= 0 else ref(mate)
        fields = [name, flag, ref(rid), pos + 1, mapq, cigar, next_ref, mate_pos + 1, length, seq, quality, *_tags(raw[at + n_seq :])]
        yield name, "\t".join(map(str, fields))


def read_bam(spark: SparkSession, path: str) -> tuple[list[str], DataFrame]:
    """(header lines, readID and line of each alignment); the header is that of one file."""
    files = spark.read.format("binaryFile").load(path)

    def heads(batches):
        for pdf in batches:
            for data in pdf["content"]:
                yield pd.DataFrame({"h": ["\n".join(_header(_Stream(data))[0])]})

    def rows(batches):
        for pdf in batches:
            for data in pdf["content"]:
                out = []
                for pair in sam_lines(data):
                    out.append(pair)
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["readID", "line"])
                        out = []
                yield pd.DataFrame(out, columns=["readID", "line"])

    head = files.select("content").limit(1).mapInPandas(heads, "h string").first()
    return (head.h.split("\n") if head else []), files.select("content").mapInPandas(rows, "readID string, line string")
