"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece holds a white-space marker after another character, no merge crosses the start of a
marked word, so each distinct chunk (markers, then the characters up to the next marker) is segmented
once and the ids of a text are those of its chunks in order. Line feeds that no piece holds cut chunks
too. Each task keeps its own table, emptied when it is full, so memory is bounded at any input size.
Models without this property are encoded text by text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Chunks that a task's table holds at most.
TABLE_SIZE = 400_000
_CHUNK = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


class ChunkCodec:
    """Encodes and decodes like the library's ``encode(text)`` and ``decode(ids)``, without begin or end ids."""

    def __init__(self, model: str, table_size: int = TABLE_SIZE):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.ids_of: dict[str, str] = {}
        self.text_of: dict[str, str] = {}
        self.table_size = table_size
        self.prefix = self.sp.encode("\n")
        sp = self.sp
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        probe = ["\n", "\n ", "\n  a", "\naé b", " x\n\n y", "ﬁÅ　\t"]
        self.chunked = (
            not any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces)
            and len(self.prefix) == 2
            and self.prefix[0] == sp.piece_to_id(MARK)
            and sp.is_byte(self.prefix[1])
            and all(sp.decode(sp.encode(x)) == x for x in probe)
        )

    def _learn(self, chunks: list[str]) -> None:
        ids = [x[2:] for x in self.sp.encode(["\n" + c for c in chunks], num_threads=1)]
        texts = self.sp.decode([[*self.prefix, *x] for x in ids], num_threads=1)
        self.ids_of.update(zip(chunks, [",".join(map(str, x)) for x in ids], strict=True))
        self.text_of.update(zip(chunks, [t[1:] for t in texts], strict=True))

    def encode(self, text: str) -> tuple[str, int, str]:
        """Decimal ids joined by commas, their number, and the text that they decode to."""
        if not text:
            return "", 0, ""
        if not self.chunked:
            ids = self.sp.encode(text)
            return ",".join(map(str, ids)), len(ids), self.sp.decode(ids)
        chunks = _CHUNK.findall(MARK + text.replace(" ", MARK))
        new = set(chunks).difference(self.ids_of)
        if new:
            if len(self.ids_of) + len(new) > self.table_size:
                self.ids_of.clear()
                self.text_of.clear()
                new = set(chunks)
            self._learn(list(new))
        ids = ",".join(map(self.ids_of.__getitem__, chunks))
        return ids, ids.count(",") + 1, "".join(map(self.text_of.__getitem__, chunks))[1:]


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """One row for each row of ``docs``: doc_id, ids (decimal, comma-joined), n_tokens, decoded and the two digests.

    With ``full`` false, ids and decoded are left out and only n_tokens and the digests return. Null
    text counts as empty: no ids, empty decoded text. Each row is encoded for itself, so repeated rows
    agree; an empty table gives an empty result; no column but the two named is read. Very long texts are encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 256):
                rows = [codec.encode(t or "") for t in texts.slice(at, 256).to_pylist()]
                digest = lambda k, rows=rows: pa.array([hashlib.sha256(r[k].encode()).hexdigest() for r in rows])
                columns = {"doc_id": ids.slice(at, 256), "n_tokens": pa.array([r[1] for r in rows], pa.int64()), "ids_sha256": digest(0), "decoded_sha256": digest(2)}
                if full:
                    columns |= {"ids": pa.array([r[0] for r in rows]), "decoded": pa.array([r[2] for r in rows])}
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * full
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
