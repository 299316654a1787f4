"""Encoding and decoding with a merge-type sentence-piece vocabulary, through a table of last tokens.

A merge-type encoder joins the best-scored neighbouring pieces until nothing joins. Two facts replace that search:
a sequence of pieces is an encoding exactly when each neighbouring pair of it encodes to itself, and every prefix of a
text has one encoding, hence one last token. An Aho-Corasick automaton reports the pieces ending at each position; the
one whose pair with the last token of the prefix before it is compatible is stored; ids are read off backwards. Pair
compatibility is computed by merging the pair's own text once and remembered.

No piece crosses the start of a space mark after other text, nor the border of letters and other characters (characters
for which a piece does are kept out of the letter class), so a text is encoded in segments between such borders, and a
bounded memory of segments saves repeated work. Characters outside the vocabulary become byte pieces and border every
merge. Texts are handled whole; memory is that of one text and its ids.

Defined cases: null and empty texts have the begin and end ids only and decode to the empty string; very long texts and
runs are handled like others; equal rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.memory import releasing

MARK = "▁"
#: Segments that a worker remembers in each of two generations, the longest that is, and pairs of pieces remembered.
REMEMBERED, LONGEST, PAIRS = 130_000, 48, 150_000


class Vocabulary(NamedTuple):
    """What a model file holds: pieces by id with scores, byte pieces' ids by byte, and special ids."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]
    byte_ids: tuple[int, ...]
    begin: int
    end: int
    unknown: int


def read_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file; it must be a merge-type model with byte fallback and no text normalisation."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
    byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte pieces")
    return Vocabulary(tuple(model.id_to_piece(i) for i in ids), tuple(model.get_score(i) for i in ids), tuple(not s for s in special), tuple(byte_ids[b] for b in range(256)), model.bos_id(), model.eos_id(), model.unk_id())


class Codec:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.ids = {p: i for i, p in enumerate(vocabulary.pieces) if vocabulary.plain[i]}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after other text")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            if self._merge(piece) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.known = re.compile("([" + "".join(re.escape(p) for p in self.ids if len(p) == 1) + "]+)")
        letters = {c for p in self.ids for c in p if re.match(r"[^\W\d_]", c)}
        while mixed := {c for p in self.ids for a, b in zip(p.lstrip(MARK), p.lstrip(MARK)[1:]) if (a in letters) != (b in letters) for c in (a, b) if c in letters}:
            letters -= mixed
        letter = "[" + "".join(map(re.escape, sorted(letters))) + "]"
        other = "[^" + "".join(map(re.escape, sorted(letters | {MARK}))) + "]"
        self.segments = re.compile(f"{MARK}*{letter}+|{MARK}*{other}+|{MARK}+")
        self.compatible: dict[int, bool] = {}
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.surface = np.empty(len(vocabulary.pieces), dtype=object)
        for i, p in enumerate(vocabulary.pieces):
            self.surface[i] = p.replace(MARK, " ").encode() if vocabulary.plain[i] else b""
        for b, i in enumerate(vocabulary.byte_ids):
            self.surface[i] = bytes([b])
        self.surface[vocabulary.unknown] = " ⁇ ".encode()
        self.surface_list = self.surface.tolist()

    def _merge(self, text: str) -> list[str]:
        """The encoder's own definition, for short texts: join the best pair, the leftmost of equals, until none joins."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.v.scores[i] > best):
                    best, at = self.v.scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: int, right: int) -> bool:
        key = left << 20 | right
        known = self.compatible.get(key)
        if known is None:
            a, b = self.v.pieces[left], self.v.pieces[right]
            known = a + b not in self.ids and self._merge(a + b) == [a, b]
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            self.compatible[key] = known
        return known

    def _known_run(self, text: str) -> list[int]:
        last, starts = [-1] * (len(text) + 1), [0] * (len(text) + 1)
        compatible, fits = self.compatible, self._fits
        done = 0
        for end, (token, length) in self.automaton.iter(text):
            end += 1
            if end == done:
                continue
            start = end - length
            if start:
                ok = compatible.get(last[start] << 20 | token)
                if ok is None:
                    ok = fits(last[start], token)
                if not ok:
                    continue
            last[end], starts[end], done = token, start, end
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at = starts[at]
        return out[::-1]

    def _segment(self, text: str) -> bytes:
        packed = self.older.get(text) or self._encoded(text)
        if len(text) <= LONGEST:
            if len(self.memory) >= REMEMBERED:
                self.memory, self.older = {}, self.memory
            self.memory[text] = packed
        return packed

    def _encoded(self, text: str) -> bytes:
        ids: list[int] = []
        for k, part in enumerate(self.known.split(text)):
            if k % 2:
                ids += self._known_run(part)
            else:
                ids += [self.v.byte_ids[b] for b in part.encode()]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> bytes:
        """All ids as little-endian unsigned 32-bit integers, with begin and end."""
        segment = self._segment
        marked = MARK + text.replace(" ", MARK) if text else ""
        parts = [self.memory.get(s) or segment(s) for s in self.segments.findall(marked)]
        return b"".join([struct.pack("<I", self.v.begin), *parts, struct.pack("<I", self.v.end)])

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids: pieces side by side, marks as spaces, less the space put before the first piece."""
        raw = b"".join(map(self.surface_list.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@cache
def codec_of(vocabulary: Vocabulary) -> Codec:
    return Codec(vocabulary)


def encode_documents(docs: DataFrame, model_path: str, with_text: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers), ids_sha256, decoded, decoded_sha256 per row.

    with_text False leaves out the columns ids and decoded. The vocabulary (one model file, a few MB at most) is read
    once by the driver and travels with the function; each worker builds its automaton once.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    if with_text:
        fields += [pa.field("ids", pa.binary()), pa.field("decoded", pa.string())]
    schema = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(vocabulary.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out: list[list] = [[] for _ in schema]
                for text in part.column(1):
                    ids = codec.encode(text.as_py())
                    decoded = codec.decode(ids)
                    row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded]
                    for column, value in zip(out[1:], row):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, f.type) for x, f in zip(out[1:], fields[1:])]], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if with_text else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(run), ddl)
