"""Token ids in seekable files: independent zstandard frames with a trailing seek table."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, tasks, written
from .textkit import blocks

#: A space between two characters that aren't white space begins a token of its own.
BREAK = re.compile(r"(?<=\S) (?=\S)")
UNEVEN = re.compile(r"\s\s")
#: Before a piece that no space precedes, and in place of a single line end; no text has these, as they can't be
#: written as UTF-8.
FIRST, LINE = "\ud800", "\ud801"
LINES = f" {LINE} {FIRST}"
#: Pieces that an encoder remembers at most, their characters, and their ids; others are encoded each time.
REMEMBERED, REMEMBERED_CHARS, REMEMBERED_IDS = 600_000, 8 << 20, 4 << 20
#: Documents in a batch that is read from a file.
READ_DOCS = 8_192


class Encoder:
    """A tokenizers file with a memory of the ids of pieces between single spaces and line ends.

    With byte-level pre-tokenization a token never reaches over a single space from before it, and a
    single line end is a token of its own, so a text's ids are those of its pieces in order. Texts
    with an added token's string go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        names = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[i for name, i in names.items() if name.startswith("\u0120")]] = True
        # The id of a line end, if the pre-tokenizer parts it from what stands around it.
        self.line = None
        apart = self.tokenizer.pre_tokenizer.pre_tokenize_str("a\nb") if self.tokenizer.pre_tokenizer else []
        if len(apart) == 3 and apart[1][1] == (1, 2):
            (self.line,) = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.codes, self.chars = Codes(), 0
        # Where the ids of each piece begin, how many there are, and all ids; room is doubled as needed.
        self.begin, self.size, self.ids, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def put(self, known: int, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Notes the ids of the pieces numbered from `known`; those that aren't remembered are overwritten later."""
        while known + len(lengths) > len(self.begin):
            self.begin, self.size = np.resize(self.begin, 2 * len(self.begin)), np.resize(self.size, 2 * len(self.size))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[known : known + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.size[known : known + len(lengths)] = lengths

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def piece_ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each piece; one without a space before it has FIRST there.

        Pieces without white space go to the tokenizer as running text, hundreds at a time: after
        spaces, as just the tokens that begin with a space begin a piece, or after line ends.
        """
        after_space, after_line, rest = [], [], []
        for i, p in enumerate(pieces):
            plain = p.split() == [p] and p != LINE
            (rest if not plain else after_space if p[0] != FIRST else after_line if self.line is not None and len(p) > 1 else rest).append(i)
        lengths, groups = np.zeros(len(pieces), np.int64), []
        for group, mark, skip in ((after_space, " ", 0), (after_line, "\n", 1)):
            words = [pieces[i][skip:] for i in group]
            runs = [mark + mark.join(words[a : a + 128]) for a in range(0, len(words), 128)]
            ids = np.concatenate([np.zeros(0, np.uint32), *self.encoded(runs)])
            begins = ids == self.line if skip else self.spaced[ids]
            begin = np.flatnonzero(begins)
            if len(begin) != len(group):
                raise ValueError("the vocabulary doesn't begin its tokens as expected")
            lengths[group] = np.diff(np.append(begin, len(ids))) - skip
            groups.append((group, ids[~begins] if skip else ids))
        found = self.encoded(["\n" if p == LINE else p[1:] if p[:1] == FIRST else " " + p for p in (pieces[i] for i in rest)])
        lengths[rest] = [len(x) for x in found]
        groups.append((rest, np.concatenate([np.zeros(0, np.uint32), *found])))
        at = np.cumsum(lengths) - lengths
        out = np.zeros(lengths.sum(), np.uint32)
        for group, ids in groups:
            n = lengths[group]
            out[np.repeat(at[group] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the n + 1 offsets of the texts in them."""
        pieces: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                if any(a in text for a in self.added):
                    parts = [text]
                else:
                    parts = BREAK.split(text) if UNEVEN.search(text) else (text if self.line is None else text.replace("\n", LINES)).split(" ")
                parts[0] = FIRST + parts[0]
                pieces += parts
            ends.append(len(pieces))
        known = len(self.codes)
        codes = np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces))
        new = self.codes.new
        if new:
            found, counts = self.piece_ids(new)
            self.put(known, found, counts)
            chars = sum(map(len, new))
            if known + len(new) <= REMEMBERED and self.chars + chars <= REMEMBERED_CHARS and self.used + len(found) <= REMEMBERED_IDS:
                self.used, self.chars = self.used + len(found), self.chars + chars
            else:
                for p in new:
                    del self.codes[p]
            self.codes.new = []
        lengths = self.size[codes]
        total = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(lengths, out=total[1:])
        where = np.repeat(self.begin[codes] - total[:-1], lengths) + np.arange(total[-1])
        return self.ids[where], total[np.array(ends, np.int64)]


class Codes(dict):
    """Numbers its keys as they come; `new` are those since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self.new.append(key)
        self[key] = code = len(self)
        return code


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def is_wide(path: str) -> bool:
    """Whether ids take more than 16 bits."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size() > 1 << 16


# --- the file -----------------------------------------------------------------------------------

SKIPPABLE, INDEX, SEEK_TABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Ids in a frame, if documents are small.
FRAME_IDS = 1 << 16


def put_frame(docs: list[tuple[int, np.ndarray]], width: int) -> bytes:
    """The plain bytes of a frame: number of documents, their ids and lengths, all token ids."""
    head = struct.pack("<II", len(docs), width)
    keys = np.array([d for d, _ in docs], "<i8").tobytes()
    lengths = np.array([len(x) for _, x in docs], "<u4").tobytes()
    return head + keys + lengths + np.concatenate([x for _, x in docs]).astype(f"<u{width}").tobytes()


def get_frame(plain: bytes) -> Iterator[tuple[int, np.ndarray]]:
    n, width = struct.unpack_from("<II", plain)
    keys = np.frombuffer(plain, "<i8", n, 8)
    lengths = np.frombuffer(plain, "<u4", n, 8 + 8 * n)
    ids, at = np.frombuffer(plain, f"<u{width}", offset=8 + 12 * n), 0
    for key, length in zip(keys.tolist(), lengths.tolist(), strict=True):
        yield key, ids[at : at + length]
        at += length


class Writer:
    """Writes documents in order; the index of each frame's first document and the seek table come last."""

    def __init__(self, out, width: int):
        import zstandard

        self.out, self.width, self.pending, self.size = out, width, [], 0
        self.press = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.first: list[tuple[int, int, int]] = []
        self.n_docs = self.n_tokens = 0

    def add(self, doc_id: int, ids: np.ndarray) -> None:
        self.pending.append((doc_id, ids))
        self.size += len(ids)
        if self.size >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        import xxhash

        if self.pending:
            plain = put_frame(self.pending, self.width)
            packed = self.press.compress(plain)
            self.out.write(packed)
            self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self.first.append((self.pending[0][0], self.pending[-1][0], self.n_tokens))
            self.n_docs, self.n_tokens = self.n_docs + len(self.pending), self.n_tokens + self.size
            self.pending, self.size = [], 0

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<qqQ", *x) for x in self.first)
        self.out.write(struct.pack("<II", INDEX, len(index)) + index)
        table = b"".join(struct.pack("<III", *x) for x in [*self.frames, (8 + len(index), 0, 0)])
        table += struct.pack("<IBI", len(self.frames) + 1, 0x80, SEEK_TABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class Reader:
    """Random access to a file that Writer made; `file` can seek and read."""

    def __init__(self, file):
        import zstandard

        self.file, self.expand = file, zstandard.ZstdDecompressor()
        file.seek(0, 2)
        end = file.tell()
        file.seek(end - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_TABLE:
            raise ValueError("no seek table")
        file.seek(end - 9 - 12 * n)
        self.frames = list(struct.iter_unpack("<III", file.read(12 * n)))
        self.at = np.concatenate([[0], np.cumsum([f[0] for f in self.frames])]).tolist()
        file.seek(self.at[n - 1] + 8)
        self.first = list(struct.iter_unpack("<qqQ", file.read(self.frames[-1][0] - 8)))

    def frame(self, i: int) -> bytes:
        import xxhash

        self.file.seek(self.at[i])
        size, plain_size, checksum = self.frames[i]
        plain = self.expand.decompress(self.file.read(size), max_output_size=plain_size)
        if len(plain) != plain_size or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {i} is damaged")
        return plain

    def __iter__(self) -> Iterator[tuple[int, np.ndarray]]:
        for i in range(len(self.first)):
            yield from get_frame(self.frame(i))

    def documents(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """Only the frames that can hold one of `wanted` are decompressed."""
        wanted = set(wanted)
        for i, (low, high, _) in enumerate(self.first):
            if any(low <= w <= high for w in wanted):
                yield from ((d, ids) for d, ids in get_frame(self.frame(i)) if d in wanted)


def open_shared(uri: str, mode: str):
    """A file in the shared folder, whichever file system that is in."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return system.open_output_stream(path, compression=None) if mode == "w" else system.open_input_file(path)


# --- Spark --------------------------------------------------------------------------------------


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text and writes one file a task, documents in ascending id over all files.

    Returns the manifest: path, first_doc, n_docs, n_nulls, n_tokens. A task that is run again writes
    another file; the manifest names the one of the attempt that counted. A null text is empty; a
    null id is written as the least 64-bit number, before all others: the first n_nulls of a file had none; rows that repeat an id stand together,
    ordered by a hash of their texts. An empty table gives no file.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), "tie"]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(tasks(docs.sparkSession), *order).sortWithinPartitions(*order)

    def write(batches):
        coder, out, writer, first, n_nulls = encoder(vocabulary), None, None, None, 0
        name = f"{path}/{uuid.uuid4().hex}.ids.zst"
        for batch in batches:
            for part, _ in blocks(batch, "text"):
                ids, at = coder.encode(part.column("text").to_pylist())
                for i, known in enumerate(part.column("id").to_pylist()):
                    key, n_nulls = (-(2**63), n_nulls + 1) if known is None else (known, n_nulls)
                    if writer is None:
                        out, first = open_shared(name, "w"), key
                        writer = Writer(out, 4 if coder.wide else 2)
                    writer.add(key, np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)))
        if writer:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "first_doc": [first], "n_docs": [writer.n_docs], "n_nulls": [n_nulls], "n_tokens": [writer.n_tokens]})

    return rows.select("id", "text").mapInArrow(write, "path string, first_doc long, n_docs long, n_nulls long, n_tokens long")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From the files: id, start (ids of all documents before), n_tokens, ids_crc32.

    Where a file begins follows from the manifest, which has one row a file.
    """
    before = Window.orderBy("first_doc", F.desc("n_nulls"), "path").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = files.select("path", "base", "n_nulls").repartition(tasks(manifest.sparkSession), "path")

    def told(found):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], [id_col, "start", "n_tokens", "ids_crc32"])

    def read(batches):
        for batch in batches:
            for path, start, nulls in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = []
                with open_shared(path, "r") as file:
                    for i, (key, ids) in enumerate(Reader(file)):
                        found.append((None if i < nulls else key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(found) == READ_DOCS:
                            yield told(found)
                            found = []
                if found:
                    yield told(found)

    return files.mapInArrow(read, f"{id_col} long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Writes token files into a new folder of the shared one and reads them back."""
    from pyarrow import fs

    path = f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(inner, recursive=True)
    return read_token_files(written(write_token_files(docs, path, vocabulary, end_id), "token-manifest"))
