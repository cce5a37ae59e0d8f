"""SentencePiece encoding that keeps offsets, and decoding.

Texts are normalised here, not by the library: at each place the longest key of the model's compiled character map (a double-array trie
and its replacements) is replaced, spaces become the mark U+2581, and for every normalised byte the source byte is recorded at which
its prefix began. The library then only merges: it is given the normalised text and a model whose own normaliser is switched off. Each
piece covers a run of normalised bytes, whose alignment projects it to a span of bytes of the original text. The bytes of a character that
falls back to byte pieces share its place: all but the last have empty spans.

No piece of such a model holds a mark after another character, so merges never cross from a word to the next mark. A text is therefore cut
before each run of marks, and a worker normalises and merges a distinct word once, for as long as it remembers it (KNOWN_WORDS). Models for
which that need not hold (a piece that crosses, a map, user-defined pieces, extra white space removed) encode whole texts. Nothing is shuffled.

The model's bytes travel with the job, so its path (a parameter) is read on the driver only. Begin and end ids are never produced. A null
text is empty: no pieces. Null ids, repeated rows and ties are kept as they are, other columns are ignored (encode) or carried on
(decode); an empty table gives an empty result. Very long texts are encoded in stretches of STRETCH characters that end where a word
does; what grows with a text are its arrays of ids and spans, some 30 bytes per piece.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from sonolake.llm.bpe import gather

MODEL = "piece_bpe_32k.model"
KNOWN_WORDS = 500_000
STRETCH = 1 << 20
#: Pieces after which a batch of results leaves a worker.
_ROWS, _PIECES = 256, 1 << 20
MARK = "▁"
_MARK = MARK.encode()
_USER_DEFINED, _BYTE = 4, 6


def flattened(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(cells), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in cells], dtype=np.int64)))


class CharMap:
    """A compiled character map: the size of a double-array trie in bytes, the trie, and replacements that end with a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.replacements = blob[4 + size :]

    @staticmethod
    def _base(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that text has at a place."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._base(units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & (1 << 31 | 255) != text[i]:
                break
            node ^= self._base(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & (1 << 31) - 1
        if found is None:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(b"\0", found[1])]


class Normaliser:
    """Longest-prefix normalisation with alignment, by a model's normalizer_spec."""

    def __init__(self, model: proto.ModelProto):
        spec = model.normalizer_spec
        self.map, self.dummy, self.trim = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space, self.suffix = _MARK if spec.escape_whitespaces else b" ", model.trainer_spec.treat_whitespace_as_suffix
        own = sorted((p.piece.encode() for p in model.pieces if p.type == _USER_DEFINED), key=len, reverse=True)
        self.own = re.compile(b"|".join(map(re.escape, own))) if own else None

    def prefix(self, text: bytes, at: int) -> tuple[int, bytes]:
        """Source length and normalised bytes of the prefix at a place: a user-defined piece, the longest key of the map, or a character."""
        if self.own and (m := self.own.match(text, at)):
            return len(m[0]), m[0]
        if found := self.map.longest(text, at):
            return found
        lead = text[at]
        n = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, text[at : at + n]

    def plain(self) -> bool:
        return not self.map.units and self.own is None and not self.trim

    def aligned(self, text: bytes, first: bool = True, last: bool = True) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and for the end) the source byte at which its prefix began. Only the first part
        of a text gets a dummy prefix, only the last one a dummy suffix."""
        if self.plain() and not self.suffix:
            return self._plain(text, first)
        at, end, out, places = 0, len(text), bytearray(), []
        if self.trim:
            while at < end and (p := self.prefix(text, at))[1] == b" ":
                at += p[0]
        if at == end:
            return b"", np.zeros(1, np.int64)
        if first and self.dummy and not self.suffix:
            out += self.space
            places += [at] * len(self.space)
        spaced = self.trim
        while at < end:
            n, new = self.prefix(text, at)
            new = new.lstrip(b" ") if spaced else new
            if new:
                marked = new.replace(b" ", self.space)
                out += marked
                places += [at] * len(marked)
                spaced = self.trim and new.endswith(b" ")
            at += n
        if self.trim:
            while out.endswith(self.space):
                at = places[len(out) - len(self.space)]
                del out[len(out) - len(self.space) :], places[len(places) - len(self.space) :]
        if last and self.dummy and self.suffix:
            out += self.space
            places += [at] * len(self.space)
        return bytes(out), np.array([*places, at], np.int64)

    def _plain(self, text: bytes, first: bool) -> tuple[bytes, np.ndarray]:
        """Without a map, each character is its own prefix."""
        source = np.frombuffer(text, np.uint8)
        start = np.maximum.accumulate(np.where((source & 0xC0) != 0x80, np.arange(len(source)), 0)) if len(source) else np.zeros(0, np.int64)
        places = np.append(np.repeat(start, np.where(source == 0x20, len(self.space), 1)), len(source))
        dummy = self.space if first and self.dummy and text else b""
        return dummy + text.replace(b" ", self.space), np.concatenate((np.zeros(len(dummy), np.int64), places))


class Encoder:
    """Ids and source spans of texts by one model (its serialised bytes)."""

    def __init__(self, blob: bytes):
        model = proto.ModelProto.FromString(blob)
        self.normaliser = Normaliser(model)
        self.n_pieces = len(model.pieces)
        self.lengths = np.array([1 if p.type == _BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = next((i for i, p in enumerate(model.pieces) if p.type == 2), -1)
        crosses = any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces if p.type not in (2, 3))
        self.by_word = self.normaliser.plain() and not self.normaliser.suffix and not crosses
        model.normalizer_spec.Clear()
        spec = model.normalizer_spec
        spec.name, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = "identity", False, False, False
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.decimals = flattened([b"%d," % i for i in range(self.n_pieces)])
        self.forget()

    def forget(self) -> None:
        """Flat arrays of what is known of the words so far: word i has the pieces bounds[i] to bounds[i + 1] and size[i] source bytes."""
        self.heads: dict[str, int] = {}
        self.number: dict[str, int] = {}
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.bounds, self.size = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def pieces(self, normal: list[tuple[bytes, np.ndarray]]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and ends of each of some normalised texts."""
        merged = self.merges.encode([x[0].decode() for x in normal], out_type=int, num_threads=1)
        ids = [np.array(x, np.int64) for x in merged]
        return ids, [self._ends(x[0], x[1], i) for x, i in zip(normal, ids, strict=True)]

    def _ends(self, normal: bytes, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        if self.unknown in ids:  # the one piece whose length its id does not tell
            surface = self.merges.encode(normal.decode(), out_type=str)
            lengths = np.array([n if i != self.unknown else len(p.encode()) for n, i, p in zip(lengths.tolist(), ids.tolist(), surface, strict=True)], np.int64)
        return places[np.cumsum(lengths)]

    def learn(self, words: Iterable[str], first: bool) -> None:
        """Words that are not known yet; those at the beginning of a text are others, as they get the dummy prefix."""
        known = self.heads if first else self.number
        new = [w for w in dict.fromkeys(words) if w not in known]
        if not new:
            return
        known.update(zip(new, range(len(self.size), len(self.size) + len(new)), strict=True))
        size = np.array([len(w.encode()) for w in new], np.int64)
        if first:
            ids, ends = self.pieces([self.normaliser.aligned(w.encode(), first) for w in new])
            counts = np.array([len(x) for x in ids], np.int64)
            ids, ends = np.concatenate(ids), np.concatenate(ends)
        else:  # words one after another have the alignment of their joined text
            normal, places = self.normaliser.aligned("".join(new).encode(), False)
            merged = self.merges.encode([w.replace(" ", MARK) if self.normaliser.space == _MARK else w for w in new], out_type=int, num_threads=1)
            counts = np.array([len(x) for x in merged], np.int64)
            ids = np.fromiter(chain.from_iterable(merged), np.int64, int(counts.sum()))
            if self.unknown in ids:
                parts = [self.normaliser.aligned(w.encode(), False) for w in new]
                ends = np.concatenate([self._ends(*x, np.array(i, np.int64)) for x, i in zip(parts, merged, strict=True)])
            else:
                ends = places[np.cumsum(self.lengths[ids])] - np.repeat(np.cumsum(size) - size, counts)
        self.ids, self.ends = np.append(self.ids, ids.astype(np.int32)), np.append(self.ends, ends)
        self.bounds, self.size = np.append(self.bounds, self.bounds[-1] + np.cumsum(counts)), np.append(self.size, size)

    def words(self, texts: list[str]) -> list[list[list[str]]]:
        """For each text, its stretches as lists of words, all of which are known then."""
        cut = []
        for text in texts:
            parts, at = [], 0
            while at < len(text):
                to = at + STRETCH
                m = _BOUNDARY.search(text, to) if to < len(text) else None
                to = m.end() if m else len(text)
                parts.append(_WORD.findall(text[at:to]))
                at = to
            cut.append(parts)
        if len(self.size) > KNOWN_WORDS:
            self.forget()
        self.learn([parts[0][0] for parts in cut if parts], True)
        self.learn(chain.from_iterable(p for parts in cut for p in parts), False)
        return cut

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, str]]:
        """(ids, ends, SHA-256 of the decimal ids joined by commas) of each text; ends are source bytes, ascending."""
        if not self.by_word:
            for text in texts:
                ids, ends = self.pieces([self.normaliser.aligned(text.encode())])
                yield ids[0].astype(np.int32), ends[0], hashlib.sha256(gather(*self.decimals, ids[0]).tobytes()[:-1]).hexdigest()
            return
        for parts in self.words(texts):
            sha, ids, ends, base, tail = hashlib.sha256(), [], [], 0, b""
            for k, own in enumerate(parts):
                number = np.fromiter(map(self.number.__getitem__, own), np.int64, len(own))
                if not k:
                    number[0] = self.heads[own[0]]
                sizes = self.size[number]
                before = np.cumsum(sizes)
                ids.append(gather(self.ids, self.bounds, number))
                ends.append(gather(self.ends, self.bounds, number) + np.repeat(before - sizes + base, self.bounds[number + 1] - self.bounds[number]))
                base += int(before[-1])
                text = tail + gather(*self.decimals, ids[-1]).tobytes()
                sha.update(text[:-1])
                tail = text[-1:]  # the comma goes before what follows
            join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
            yield join(ids, np.int32), join(ends, np.int64), sha.hexdigest()


#: A word is a run of spaces or marks and what follows up to the next one.
_WORD = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
_BOUNDARY = re.compile(f"[^ {MARK}](?=[ {MARK}])")


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>), ends (array<int>: the byte of the text at which each piece ends; it begins where the one before
    ended, the first at 0), ids_sha256 (of the decimal ids joined by commas) of every row."""
    blob = docs.sparkSession.sparkContext.broadcast(model_bytes(path))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(blob.value)
        for b in batches:
            lo = 0
            while lo < b.num_rows:
                sizes = np.cumsum(np.asarray(b.column(2))[lo : lo + _ROWS])
                hi = lo + max(1, int(np.searchsorted(sizes, _PIECES, "right")))
                found = list(own.encode(b.column(1)[lo:hi].to_pylist()))
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x[0]) for x in found]))), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[k] for x in found]), pa.int32())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], *lists, pa.array([x[2] for x in found], pa.string())], ["doc_id", "ids", "ends", "ids_sha256"])
                lo = hi

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("size"))
    return rows.mapInArrow(scan, "doc_id long, ids array<int>, ends array<int>, ids_sha256 string")


class Decoder:
    """The text of ids: the bytes of their pieces, without the dummy prefix."""

    def __init__(self, blob: bytes):
        model = proto.ModelProto.FromString(blob)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=blob)
        surface = [bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.surface = flattened(surface)
        #: Pieces whose text is not their own bytes: unknown ones, and control pieces.
        self.odd = np.array([p.type in (2, 3) for p in model.pieces])
        self.first = np.array([p.type != _BYTE and p.piece.startswith(MARK) for p in model.pieces])
        self.strips = model.normalizer_spec.add_dummy_prefix and not model.normalizer_spec.remove_extra_whitespaces and not model.denormalizer_spec.precompiled_charsmap

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if self.strips and not self.odd[ids].any():
            out = gather(*self.surface, ids).tobytes()
            try:
                out.decode()
            except UnicodeDecodeError:  # the library has a rule of its own for stray bytes
                pass
            else:
                return out[1:] if self.first[ids[0]] else out
        return self.whole.decode(ids.tolist()).encode()


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens (ids: array<int>, other columns) with decoded (string); null ids give null."""
    blob = tokens.sparkSession.sparkContext.broadcast(model_bytes(path))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Decoder(blob.value)
        for b in batches:
            ids = b.column(b.num_columns - 1)
            for lo in range(0, b.num_rows, _ROWS):
                part = ids.slice(lo, _ROWS)
                out = [own.decode(np.asarray(x.values, np.int64)) if x.is_valid else None for x in part]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, _ROWS) for c in b.columns[:-1]), pa.array(out, pa.binary()).cast(pa.string())], ["row", "decoded"])

    row = F.struct(*[F.col(f"`{c}`") for c in tokens.columns]).alias("row")
    rows = tokens.select(row, F.col("ids"))
    return rows.mapInArrow(scan, f"row {rows.schema['row'].dataType.simpleString()}, decoded string").select("row.*", "decoded")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path(MODEL)
    found = encode(docs, path).withColumn("n_tokens", F.size("ids").cast("long")).withColumn("n_bytes", F.coalesce(F.get("ends", F.size("ids") - 1), F.lit(0)).cast("long")).drop("ends")
    return decode(found, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "n_bytes")
