"""Token ids in fixed-width bit-packed block files, written, read back and checked."""

from __future__ import annotations

import io
import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oriel.llm.common import shared_path, written

MAGIC = b"OBPK0001"
BLOCK_IDS = 1 << 16
#: Rows of ids that one file holds at most, as a guard for readers that load whole files.
FILE_IDS = 1 << 22
#: Stands in files for a null doc_id.
NO_ID = -(1 << 63)
#: Whitespace-free pieces that a worker remembers; beyond it the memory is emptied.
MEMORY = 400_000


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, least significant bit first, padded to whole bytes."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    wide = ((ids[:, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(wide.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def encode_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """A file: header, offsets of blocks, document table, blocks.

    Header: magic, then as unsigned 64-bit little-endian numbers bits, ids a block, number of ids, of
    blocks and of documents. Then the byte offset of each block and of the
    end, from the first block on; then doc_id (signed) and number of ids of each document.
    """
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    head = struct.pack("<5Q", bits, block_ids, len(ids), len(blocks), len(doc_ids))
    return b"".join([MAGIC, head, offsets.tobytes(), doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), *blocks])


class TokenFile:
    """Random access to one file: ``ids(a, b)`` unpacks only the blocks that it needs."""

    def __init__(self, source):
        self.source = source
        source.seek(0)
        head = source.read(len(MAGIC) + 40)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.block_ids, self.n_ids, n_blocks, n_docs = struct.unpack("<5Q", head[len(MAGIC) :])
        rest = source.read(8 * (n_blocks + 1) + 16 * n_docs)
        self.offsets = np.frombuffer(rest, "<u8", n_blocks + 1)
        self.doc_ids = np.frombuffer(rest, "<i8", n_docs, 8 * (n_blocks + 1))
        self.counts = np.frombuffer(rest, "<u8", n_docs, 8 * (n_blocks + 1) + 8 * n_docs).astype(np.int64)
        self.base = len(head) + len(rest)

    def ids(self, first: int, stop: int) -> np.ndarray:
        if stop <= first:
            return np.empty(0, np.uint32)
        a, b = first // self.block_ids, (stop - 1) // self.block_ids
        self.source.seek(self.base + int(self.offsets[a]))
        data = self.source.read(int(self.offsets[b + 1] - self.offsets[a]))
        parts = []
        for k in range(a, b + 1):
            own = data[int(self.offsets[k] - self.offsets[a]) : int(self.offsets[k + 1] - self.offsets[a])]
            parts.append(unpack(own, min(self.block_ids, self.n_ids - k * self.block_ids), self.bits))
        return np.concatenate(parts)[first - a * self.block_ids : stop - a * self.block_ids]


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts by the tokenizers library, with remembered pieces.

    The vocabulary's own rules never join characters across white space, so a text is cut there and
    each piece is encoded once. Pieces that are plain words, in scripts whose lower-casing doesn't
    depend on what surrounds them, go to the library's model at once; all other pieces go through its whole
    pipeline. Texts in which a cut could change the result are encoded whole.
    """

    #: Characters that str.split() takes for white space and the vocabulary doesn't, and ones whose lower case depends on their neighbours.
    ODD = frozenset("\x1c\x1d\x1e\x1fΣİ")

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.plain = (
            spec["model"]["type"] == "BPE"
            and spec["model"].get("end_of_word_suffix") == "</w>"
            and [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
        )
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.vocabulary = self.library.get_vocab_size()
        self.model, self.memory, self.known = self.library.model, memory, {}
        self.kind = "<u2" if self.vocabulary <= 1 << 16 else "<u4"
        self.width = 2 if self.vocabulary <= 1 << 16 else 4
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.letters = {b: chr(b) if b in keep else chr(next(rest)) for b in range(256)}

    def bytes_of(self, ids) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def word(self, w: str) -> bytes:
        """Ids of a lower-case run of letters, straight from the model."""
        return self.bytes_of([t.id for t in self.model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.letters))])

    def whole(self, text: str) -> bytes:
        return self.bytes_of(self.library.encode(text, add_special_tokens=False).ids)

    def piece(self, p: str) -> bytes:
        if self.plain and max(p) < "ɐ":
            if p.isalpha():
                return self.word(p)
            if p[-1] in ".,;:!?" and p[:-1].isalpha():
                return self.known_piece(p[:-1]) + self.known_piece(p[-1])
        return self.whole(p)

    def known_piece(self, p: str) -> bytes:
        if (out := self.known.get(p)) is None:
            out = self.known[p] = self.piece(p)
        return out

    def text(self, text) -> bytes:
        if not text:
            return b""
        if not self.plain or any(s in text for s in self.special) or not self.ODD.isdisjoint(text):
            return self.whole(text)
        if len(self.known) > self.memory:
            self.known.clear()
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        pieces = text.lower().split()
        get, known = self.known_piece, self.known
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            return b"".join([get(p) for p in pieces])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


MANIFEST = pa.schema([("path", pa.string()), ("part", pa.int32()), ("number", pa.int32()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_token_files(docs: DataFrame, folder: str, vocabulary_file: str | None = None, end_id: int | None = 2, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode ``docs``, write bit-packed files in ascending doc_id order, and return their manifest.

    ``vocabulary_file`` names a file that every executor can open at the same place. Null texts are
    empty; an empty text has only the end id. Equal doc_ids stand next to each other, ordered by a hash of the text,
    then by text; a null doc_id stands first. The one shuffle deals whole texts by range of doc_id, and by those
    hashes and places where one doc_id, or none, holds many rows; each task encodes its range in order, one text
    at a time however long, and writes files of about ``file_ids`` ids. A task that runs again writes under
    new names, and only files of tasks that ended well are in the manifest: path, part, number,
    first_doc, n_docs, n_ids and ``start``, the number of ids in all files before it.
    """
    path = vocabulary_file or tokenizer_file()
    spec = encoder(path)
    bits, width, kind = max(1, (spec.vocabulary - 1).bit_length()), spec.width, spec.kind

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        system, root = filesystem(folder)
        system.create_dir(root, recursive=True)
        code, part = encoder(path), TaskContext.get().partitionId()
        tail = b"" if end_id is None else code.bytes_of([end_id])
        rows: list[dict] = []
        doc_ids: list[int] = []
        packed: list[bytes] = []

        def flush():
            if not doc_ids:
                return
            counts = np.array([len(x) // width for x in packed], np.int64)
            ids = np.frombuffer(b"".join(packed), kind)
            name = f"{root}/ids-{part:06d}-{len(rows):05d}-{uuid.uuid4().hex[:12]}.bits"
            with system.open_output_stream(name) as out:
                out.write(encode_file(np.array(doc_ids, np.int64), counts, ids, bits))
            rows.append({"path": name, "part": part, "number": len(rows), "first_doc": doc_ids[0], "n_docs": len(doc_ids), "n_ids": len(ids)})
            doc_ids.clear()
            packed.clear()

        held = 0
        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                doc_ids.append(NO_ID if d is None else d)
                packed.append(code.text(t) + tail)
                held += len(packed[-1]) // width
                if held >= file_ids:
                    flush()
                    held = 0
        flush()
        yield pa.RecordBatch.from_pylist(rows, schema=MANIFEST)

    rows = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    placed = rows.select("doc_id", "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
    ordered = placed.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    files = written(ordered.mapInArrow(write, "path string, part int, number int, first_doc long, n_docs long, n_ids long"), "manifest")
    # One row for each file of millions of ids.
    earlier = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).cast("long"))


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens and the CRC-32 of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(folder)
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with system.open_input_file(name) as source:
                    f = TokenFile(source)
                    ids = f.ids(0, f.n_ids).astype("<u4")
                ends = np.cumsum(f.counts)
                begins = ends - f.counts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                own = pa.array(f.doc_ids, mask=f.doc_ids == NO_ID)
                yield pa.RecordBatch.from_arrays([own, pa.array(begins + start), pa.array(f.counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "start").repartition(max(1, files.sparkSession.sparkContext.defaultParallelism)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, vocabulary_file: str | None = None, end_id: int | None = 2) -> DataFrame:
    """Write ``docs`` to token files in the shared folder and return what the files hold.

    Ids take ``ceil(log2(vocabulary))`` bits. Null and empty texts have the end id alone; repeated rows
    are encoded each; a null doc_id comes back as null; an empty table gives no file and no row. Other
    columns are left alone.
    """
    folder = shared_path(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, folder, vocabulary_file, end_id), folder)


def whole_file(data: bytes) -> TokenFile:
    return TokenFile(io.BytesIO(data))
