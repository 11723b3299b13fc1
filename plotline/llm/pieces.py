"""SentencePiece encoding with byte spans, and decoding.

The text goes through the model's compiled character map by longest prefix;
the map records where each normalised byte came from.  The encoder's pieces,
laid over the normalised bytes, thus get spans of the original bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from plotline.llm.arrow import append

#: How the model writes a space (fixed by the format).
SPACE = "▁".encode()


class CharacterMap:
    """A model's normalisation: replacements by longest prefix, with their source.

    The compiled map is a double-array trie followed by the replacement
    strings; an empty map leaves every character as it is.
    """

    def __init__(self, compiled: bytes, dummy_prefix: bool, squeeze: bool, escape: bool):
        self.dummy_prefix, self.squeeze, self.space = dummy_prefix, squeeze, SPACE if escape else b" "
        size = struct.unpack_from("<I", compiled)[0] if compiled else 0
        self.units = np.frombuffer(compiled, "<u4", size // 4, 4).tolist() if size else []
        self.strings = compiled[4 + size :] if size else b""
        heads = bytes(b for b in range(256) if self.units and self._step(self._offset(0), b) is not None)
        self.heads = re.compile(b"[" + re.escape(heads) + b"]") if heads else None

    def _offset(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & (1 << 9)) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & ((1 << 31) | 0xFF) == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest entry that starts at ``at``."""
        base, found, i = self._offset(0), None, at
        while i < len(data) and (node := self._step(base, data[i])) is not None:
            base, i = self._offset(node), i + 1
            if (self.units[node] >> 8) & 1:
                start = self.units[base] & ((1 << 31) - 1)
                found = i - at, self.strings[start : self.strings.index(b"\0", start)]
        return found

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes; for each of them, and for their end, the source offset."""
        data = text.encode()
        out, source = np.frombuffer(data, np.uint8), np.arange(len(data) + 1)
        if self.heads:
            made, came, at = bytearray(), [], 0
            while at < len(data):
                head = self.heads.search(data, at)
                stop = head.start() if head else len(data)
                made += data[at:stop]
                came.extend(range(at, stop))
                if head:
                    length, new = self.longest(data, stop) or (len(data[stop:].decode()[:1].encode()), None)
                    new = data[stop : stop + length] if new is None else new
                    made += new
                    came.extend([stop] * len(new))
                    stop += length
                at = stop
            out, source = np.frombuffer(bytes(made), np.uint8), np.array([*came, len(data)])
        if self.squeeze and len(out):
            blank = out == 32
            keep = ~(blank & np.r_[True, blank[:-1]])
            last = np.flatnonzero(keep & ~blank)
            keep[last[-1] + 1 if len(last) else 0 :] = False
            out, source = out[keep], np.r_[source[:-1][keep], len(data)]
        if not len(out):
            return b"", np.array([len(data)])
        width = np.where(out == 32, len(self.space), 1)
        source = np.r_[np.repeat(source[:-1], width), source[-1]]
        plain = out.tobytes().replace(b" ", self.space)
        if self.dummy_prefix:
            return self.space + plain, np.r_[np.full(len(self.space), source[0]), source]
        return plain, source


class Pieces:
    """A model: ids and byte spans of a text, and the text of ids."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as format

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as file:
            proto = format.ModelProto.FromString(file.read())
        spec, piece = proto.normalizer_spec, proto.pieces
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models that end words with their space are not covered")
        self.map = CharacterMap(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        byte = format.ModelProto.SentencePiece.BYTE
        self.bytes = [bytes([int(p.piece[3:-1], 16)]) if p.type == byte else p.piece.encode() for p in piece]
        self.length = np.array([len(b) for b in self.bytes])
        self.decimal = [str(i) for i in range(len(piece))]
        self.unknown, self.end = self.library.unk_id(), self.library.eos_id()

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids without an end, and the bounds of their source bytes, one more than ids."""
        ids = self.library.encode(text, add_bos=False, add_eos=False, enable_sampling=False)
        normal, source = self.map.normalise(text)
        if self.unknown in ids:
            made = [p.encode() for p in self.library.encode(text, out_type=str)]
            length = np.array([len(p) for p in made])
        else:
            made, length = [self.bytes[i] for i in ids], self.length[ids] if ids else np.zeros(0, int)
        if b"".join(made) != normal:
            raise ValueError("pieces do not spell the normalised text")
        return ids, source[np.r_[0, np.cumsum(length)]]


def encode(docs: DataFrame, model: str, text: str = "text", lists: bool = True) -> DataFrame:
    """``docs`` with the ids of each whole text, their source bytes and the decoded text.

    Adds n_tokens, ids_sha256, decoded_sha256, source_bytes (original bytes
    under some piece) and, with ``lists``, token_ids and token_bounds (token k
    covers the original bytes bounds[k] to bounds[k + 1]).  One end id closes
    every list; null and empty texts have only that.  Repeated rows get equal
    results; columns of these names are replaced.
    """
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), StructField("source_bytes", LongType())]
    if lists:
        fields += [StructField("token_ids", ArrayType(IntegerType())), StructField("token_bounds", ArrayType(LongType()))]

    def make():
        pieces, at = Pieces(model), docs_columns.index(text)

        def work(part: pa.RecordBatch) -> list:
            rows = []
            for value in part.column(at).to_pylist():
                ids, bounds = pieces.encode(value or "")
                ids = [*ids, pieces.end]
                digest = hashlib.sha256(" ".join([pieces.decimal[i] for i in ids]).encode()).hexdigest()
                decoded = hashlib.sha256(pieces.library.decode(ids).encode()).hexdigest()
                row = (len(ids), digest, decoded, int(bounds[-1] - bounds[0]))
                rows.append((*row, ids, [*bounds.tolist(), int(bounds[-1])]) if lists else row)
            return [list(column) for column in zip(*rows, strict=True)]

        return work

    docs_columns = [c for c in docs.columns if c not in {f.name for f in fields}]
    return append(docs, text, fields, make)
