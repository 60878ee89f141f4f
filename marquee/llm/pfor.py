"""Token ids of whole documents in patched frame-of-reference blocks.

Format. A token set is a folder with two Parquet tables (so any store Spark writes to will do, a lost task leaves nothing
half-written, and readers skip what they do not need):

* `frames`: one row per run of whole documents, in ascending doc_id order. `part`, `frame`: its place in the order;
  `first`: position of its first id within the part; `n_ids`; `payload`: its blocks one after the other;
  `block_starts`: the byte at which each block begins; `doc_ids`, `doc_starts`: the documents in it and the position, within
  the frame, of each one's first id.
* `parts`: `part` and `base`, the number of ids in all parts before it.

A block holds `BLOCK` ids (the last of a frame may hold fewer). All numbers are little-endian: count u4, minimum u4, number of
exceptions u4, width u1; then the differences to the minimum, lowest bits first, `width` bits each; then the positions u4 and
the full differences u4 of the exceptions, whose packed bits are zero. The width is that of the `PERCENTILE` difference.
"""

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marquee.llm.common import LATIN, Remembered, checkpoint_root, per_process, with_classes

BLOCK = 1024
PERCENTILE = 95
#: Ids after which a frame is closed; it ends with the document that reaches it.
FRAME = 1 << 18
#: Bytes of text pieces and their ids that a worker remembers.
REMEMBERED = 160 << 20
#: Characters that are looked up at a time.
SLICE = 1 << 20
#: The id that ends a document.
END_ID = 1

HEADER = np.dtype([("count", "<u4"), ("least", "<u4"), ("patched", "<u4"), ("width", "u1")])
FRAMES = ("part INT, frame INT, first LONG, n_ids LONG, payload BINARY, block_starts ARRAY<INT>, doc_ids ARRAY<LONG>, "
          "doc_starts ARRAY<LONG>")


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    least = ids.min()
    rest = (ids - least).astype(np.uint32)
    place = (len(rest) - 1) * percentile // 100
    width = int(np.partition(rest, place)[place]).bit_length()
    patched = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    values, low = rest[patched], rest.copy()
    low[patched] = 0
    if width == 16:  # the same bits, without taking them apart
        packed = low.astype("<u2").tobytes()
    else:
        bits = np.unpackbits(low.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little", count=width)
        packed = np.packbits(bits, bitorder="little").tobytes()
    head = np.array([(len(ids), least, len(patched), width)], dtype=HEADER)
    return b"".join([head.tobytes(), packed, patched.astype("<u4").tobytes(),
                     values.astype("<u4").tobytes()])


def unpack_block(data: memoryview) -> np.ndarray:
    head = np.frombuffer(data, dtype=HEADER, count=1)[0]
    count, width, patched, at = int(head["count"]), int(head["width"]), int(head["patched"]), HEADER.itemsize
    size = (count * width + 7) // 8
    if width == 16:
        rest = np.frombuffer(data, "<u2", count, at).astype(np.uint32)
    else:
        wide = np.zeros((count, 32), np.uint8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count * width, bitorder="little")
        wide[:, :width] = bits.reshape(count, width)
        rest = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()
    at += size
    rest[np.frombuffer(data, "<u4", patched, at)] = np.frombuffer(data, "<u4", patched, at + 4 * patched)
    return rest + head["least"]


def pack(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[bytes, list[int]]:
    """The blocks of `ids`, and the byte at which each begins."""
    blocks = [pack_block(ids[i:i + block], percentile) for i in range(0, len(ids), block)]
    return b"".join(blocks), [0, *np.cumsum([len(b) for b in blocks])[:-1].tolist()] if blocks else []


def unpack(payload: bytes, starts: list[int]) -> np.ndarray:
    """All ids of a frame; with a part of `starts`, those of the blocks that begin there."""
    view = memoryview(payload)
    return np.concatenate([unpack_block(view[s:]) for s in starts]) if len(starts) else np.empty(0, np.uint32)


class Known(dict):
    """Ids of the pieces asked for. A piece not in here comes from the older ones or, if it is new, from `ids_of`."""

    def __init__(self, ids_of: Callable[[str], bytes], older: dict[str, bytes]):
        self.ids_of, self.older, self.held = ids_of, older, 0

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.ids_of(piece)
        self[piece] = ids
        self.held += len(piece) + len(ids) + Remembered.OVERHEAD
        return ids


class PieceEncoder:
    """Ids of texts by a `tokenizers` file, as little-endian u4 bytes.

    A text's ids are those of its pieces, one after the other, and each piece is given to the library once while it is remembered.
    Blanks and line breaks always are borders. If the file lower-cases and splits by a pattern, its matches in the lower-cased text
    are pieces too, in texts where composition and case are sure to be one to one: those without characters beyond U+00FF
    or the sign that begins special tokens. A piece that is one such match of printable lower-case
    characters is, with its bytes spelled by `ByteLevel`, what the steps before the library's model would make of it, so the model gets it.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.known = Known(self._ids, {})
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        steps = [s["type"] for s in (told["normalizer"] or {}).get("normalizers", [])]
        cuts = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        splits = [s for s in cuts if s["type"] == "Split" and s["invert"]]
        sure = steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 1 and splits[0]["behavior"] == "Removed"
        self.pattern = re.compile(with_classes(splits[0]["pattern"]["Regex"], LATIN)) if sure else None
        plain = len(cuts) == 2 and cuts[0] in splits and cuts[1]["type"] == "ByteLevel" and not (cuts[1]["add_prefix_space"] or cuts[1]["use_regex"])
        self.model = self.tokenizer.model if sure and plain else None
        spelled = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {c: spelled.pre_tokenize_str(chr(c))[0][0] for c in range(256)}

    def split(self, text: str) -> list[str]:
        if self.pattern and "<" not in text:
            try:
                text.encode("latin-1")
                return self.pattern.findall(text.lower())
            except UnicodeEncodeError:
                pass
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.known.held > REMEMBERED // 2:
            self.known.older, self.known = {}, Known(self._ids, self.known)
        get = self.known.__getitem__
        return [b"".join(map(get, self.split(t))) for t in texts]

    def _ids(self, piece: str) -> bytes:
        latin = piece.isascii() or max(piece) <= "\xff"
        if self.model and latin and piece.isprintable() and piece == piece.lower() and self.pattern.fullmatch(piece):
            return array("I", [token.id for token in self.model.tokenize(piece.translate(self.spelled))]).tobytes()
        return array("I", self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids).tobytes()


def _sliced(rows, size: int = SLICE) -> Iterator[list]:
    """Lists of rows (key, text) with about `size` characters together, or one longer text."""
    out, held = [], 0
    for key, text in rows:
        out.append((key, text or ""))
        held += len(text or "")
        if held >= size:
            yield out
            out, held = [], 0
    if out:
        yield out


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, block: int = BLOCK,
                 percentile: float = PERCENTILE, frame: int = FRAME) -> None:
    """Encodes the column `text` of `docs` (null: empty) by the `tokenizers` file `vocabulary`, ends each document with
    `end_id`, and writes the format above to `path`.

    Documents go in ascending doc_id order, those without one first; equal doc_ids follow by the text's hash. Repeated rows are written as
    often as they come. An empty table makes an empty token set. Other columns are not read.
    """
    closing = np.array([end_id], dtype="<u4").tobytes()

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("pieces", vocabulary), lambda: PieceEncoder(vocabulary))
        part, number, first = TaskContext.get().partitionId(), 0, 0
        ids, starts, held, size = [], [], [], 0

        def close():
            payload, at = pack(np.frombuffer(b"".join(held), dtype="<u4"), block, percentile)
            row = {"part": part, "frame": number, "first": first, "n_ids": size, "payload": payload, "block_starts": at,
                   "doc_ids": ids, "doc_starts": starts}
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            rows = ((k.as_py(), t.as_py()) for k, t in zip(batch.column(0), batch.column(1)))
            for some in _sliced(rows):
                for (key, _), encoded in zip(some, encoder.encode([t for _, t in some])):
                    ids.append(key)
                    starts.append(size)
                    held += [encoded, closing]
                    size += len(encoded) // 4 + 1
                    if size >= frame:
                        yield close()
                        number, first = number + 1, first + size
                        ids, starts, held, size = [], [], [], 0
        if ids:
            yield close()

    arrow = pa.schema([("part", pa.int32()), ("frame", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()),
                       ("payload", pa.binary()), ("block_starts", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())),
                       ("doc_starts", pa.list_(pa.int64()))])
    order = ["doc_id", "tie", "row"]
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"),
                           F.monotonically_increasing_id().alias("row"))
               .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"))
    ordered.mapInArrow(frames, FRAMES).write.parquet(f"{path}/frames")
    sizes = docs.sparkSession.read.schema(FRAMES).parquet(f"{path}/frames").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    sizes.select("part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, and `ids`, little-endian u4 bytes.
    Frames hold whole documents, so nothing is shuffled but the small table of parts."""
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = unpack(row["payload"], row["block_starts"]).astype("<u4").tobytes()
                starts = row["doc_starts"]
                ends = [*starts[1:], row["n_ids"]]
                before = row["base"] + row["first"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([before + s for s in starts], pa.int64()),
                     pa.array([e - s for s, e in zip(starts, ends)], pa.int64()),
                     pa.array([data[4 * s:4 * e] for s, e in zip(starts, ends)], pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])

    frames = spark.read.schema(FRAMES).parquet(f"{path}/frames")
    parts = spark.read.schema("part INT, base LONG").parquet(f"{path}/parts")
    return frames.join(parts, "part").mapInArrow(documents, "doc_id LONG, start LONG, n_tokens LONG, ids BINARY")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Per document, from files written and read back: doc_id, start, n_tokens, ids_crc32."""
    path = f"{checkpoint_root(docs.sparkSession)}/tokens"
    write_tokens(docs, path, vocabulary)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
