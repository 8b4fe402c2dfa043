"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds one frame per document: its ids as little-endian unsigned 32-bit numbers. Two
skippable frames follow: the documents (id and token count of each), and the seek table of the
zstandard seekable format: compressed size, plain size and checksum (low 32 bits of XXH64 of the
plain bytes) of each frame. A reader takes the last bytes, finds a document's frame and reads and
decompresses only that; any zstandard reader can read the file from its start.
"""

from __future__ import annotations

import functools
import re
import struct
import sys
import uuid
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import col, open_folder, stored, whole

# fixed values of the zstandard seekable format
SEEK_MAGIC, TABLE_FRAME, DOCS_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A5D
HAS_CHECKSUMS = 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("check", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("tokens", "<u8")])

KEPT_WORDS = 1_300_000
PIECE_CHARS = 1 << 20
_BREAK = re.compile(r"(?<=\S) ")
# all white space but space and line feed, and every two of these
_UNUSUAL = (
    *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000", *map(chr, range(0x2000, 0x200B)),
    "  ", "\n\n", " \n", "\n ",
)
_BLANK = re.compile(r"[ \n]")
_PROBES = (
    "hello world foo", "Hello World, it's naïve. End", "one\ntwo Three,\nfour 5 a1 'b' -c- \"d\"", "é Straße (x) #y a_b c.d e,f",
    " begins so", "a", "don't we'll I've",
)
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII marks but for the apostrophe, which may begin a suffix


def _byte_characters() -> dict[int, str]:
    """How a byte-level vocabulary spells bytes: printable ones of Latin-1 as they are, the others, in
    order, by the characters from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(0x100 + n) for n, b in enumerate(others)}


def _packed(ids: list[int]) -> bytes:
    numbers = array("I", ids)
    if sys.byteorder != "little":
        numbers.byteswap()
    return numbers.tobytes()


class Encoder:
    """Ids of whole texts from a tokenizers file with a byte-level model, with the words seen lately
    kept encoded.

    The tokenizer first splits a text by a fixed pattern and never joins what stands on the two
    sides of a split. Single spaces begin a new part, single line feeds are a part of their own,
    and a word of Latin letters is split from marks that follow it; so words met before need not be
    encoded again, and a word of letters goes to the library's model as one part. Everything else
    is given to the library as it stands.
    """

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.part = self.tokenizer.model.tokenize
        self.spelled = _byte_characters()
        self.space = self.spelled[ord(" ")]
        self.known: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.end = b"" if end_id is None else struct.pack("<I", end_id)
        self.feed = self._plain("\n")
        for text in _PROBES:  # a file that splits or spells otherwise would give other ids
            if self._encoded(text) != self._plain(text):
                raise ValueError("this tokenizer file does not split texts as byte-level models do")

    def _plain(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        """A word with a space before it, or with the line feed it begins with."""
        fed = word[:1] == "\n"
        core = (word[1:] if fed else word).rstrip(_MARKS)
        spelled = core
        if not core.isascii() and core.isalpha() and max(core) < "\u0250":
            spelled = core.encode().decode("latin-1").translate(self.spelled)
        elif not (core.isascii() and core.isalpha()):
            return self.feed + self._plain(word[1:]) if fed else self._plain(" " + word)
        ids = _packed([token.id for token in self.part(spelled if fed else self.space + spelled)])
        if marks := word[len(core) + fed :]:
            if marks not in self.marks:
                if len(self.marks) > KEPT_WORDS // 10:
                    self.marks.clear()
                self.marks[marks] = self._plain(marks)
            ids += self.marks[marks]
        return self.feed + ids if fed else ids

    def _words(self, text: str) -> bytes:
        """A piece with single spaces and line feeds only, which begins with one of them."""
        words = text.replace("\n", " \n").split(" ")[1:]
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        found = list(map(known.get, words))
        at = -1
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            word = words[at]
            ids = known.get(word)  # it may have come up a moment ago
            if ids is None:
                ids = known[word] = self._word(word)
            found[at] = ids
        return b"".join(found)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers, with the end id."""
        return self._encoded(text) + self.end

    def _encoded(self, text: str) -> bytes:
        if not text:
            return b""
        usual = not any(map(text.__contains__, _UNUSUAL))
        out, begin = [], 0
        if usual:
            first = _BLANK.search(text)
            begin = first.start() if first else len(text)
            out.append(self._plain(text[:begin]) if begin else b"")
        while begin < len(text):
            at = _BREAK.search(text, begin + PIECE_CHARS) if begin + PIECE_CHARS < len(text) else None
            end = at.start() if at else len(text)
            out.append((self._words if usual else self._plain)(text[begin:end]))
            begin = end
        return b"".join(out)


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int | None) -> Encoder:
    """One per Python worker, so that what is known lasts from task to task."""
    return Encoder(path, end_id)


class Writer:
    """One file: frames as they come, then the documents and the seek table."""

    def __init__(self, out, level: int = 1):
        self.out, self.packer = out, zstandard.ZstdCompressor(level=level)
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        packed = self.packer.compress(ids)
        self.out.write(packed)
        self.entries.append((len(packed), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.docs.append((doc_id or 0, doc_id is not None, len(ids) // 4))

    def close(self) -> None:
        docs = np.array(self.docs, dtype=_DOC).tobytes()
        table = np.array(self.entries, dtype=_ENTRY).tobytes() + struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, SEEK_MAGIC)
        self.out.write(struct.pack("<II", DOCS_FRAME, len(docs)) + docs)
        self.out.write(struct.pack("<II", TABLE_FRAME, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to the documents of one file; only asked-for frames are read and decompressed."""

    def __init__(self, source):
        self.source, self.unpacker = source, zstandard.ZstdDecompressor()
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("not a token file: no seek table at its end")
        begin = size - 9 - count * _ENTRY.itemsize
        self.entries = np.frombuffer(self._at(begin, count * _ENTRY.itemsize), dtype=_ENTRY)
        length = count * _DOC.itemsize
        self.docs = np.frombuffer(self._at(begin - 8 - length, length), dtype=_DOC)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.starts = np.concatenate([[0], np.cumsum(self.docs["tokens"], dtype=np.int64)])

    def _at(self, offset: int, length: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(length)

    def ids(self, n: int) -> bytes:
        """The n-th document's ids; its checksum is compared."""
        packed = self._at(int(self.offsets[n]), int(self.entries["packed"][n]))
        plain = self.unpacker.decompress(packed, max_output_size=max(1, int(self.entries["plain"][n])))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.entries["check"][n]:
            raise ValueError(f"frame {n}: its checksum is wrong")
        return plain


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Encode every whole text and write the files; returns their list: file, docs, tokens, order.

    Documents are dealt by ranges of their key and sorted, NULL first, repeated keys by their text's
    hash, so the files in order hold all documents in ascending order. Only texts are shuffled, once;
    encoding, compressing and writing happen in one pass, document by document. A task writes a file of its
    own name and reports it; the list, stored through Spark, names the files of the tasks that
    counted, so files of lost or repeated attempts are not read. NULL texts are ''. An empty table
    gives no file. ``folder`` is one that all executors share and pyarrow can write.
    """
    keyed = docs.select(col(key).cast("long").alias("doc_id"), whole(col(text)).alias("text"))
    keyed = keyed.withColumn("tie", F.xxhash64("text"))
    dealt = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_folder(folder)
        writer, name, first = None, f"{uuid.uuid4().hex}.ids.zst", None
        for frame in frames:
            for doc_id, text_, tie in zip(frame["doc_id"].astype("Int64"), frame["text"], frame["tie"], strict=True):
                doc = None if doc_id is pd.NA else int(doc_id)
                if writer is None:
                    writer, first = Writer(store.open_output_stream(f"{path}/{name}", compression=None)), (doc, int(tie))
                writer.add(doc, encoder(tokenizer, end_id).encode(text_))
        if writer is not None:
            writer.close()
            tokens = sum(d[2] for d in writer.docs)
            yield pd.DataFrame({
                "file": [name], "docs": [len(writer.docs)], "tokens": [tokens],
                "first_id": pd.array([first[0]], dtype="Int64"), "first_tie": [first[1]],
            })

    return stored(dealt.select("doc_id", "text", "tie").mapInPandas(
        write, "file string, docs long, tokens long, first_id long, first_tie long"
    ))


def read_tokens(
    spark: SparkSession, folder: str, files: DataFrame, column: str, digest: Callable[[bytes], object] | None = None,
) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens, and
    ``column`` (name and type): its ids' bytes, or what ``digest`` makes of them.

    The list has one row per file; the totals of the files before each are summed on the driver.
    """
    listed = files.orderBy(F.col("first_id").asc_nulls_first(), "first_tie").select("file", "tokens").collect()
    begins, before = [], 0
    for row in listed:
        begins.append((row["file"], before))
        before += row["tokens"]
    tasks = spark.createDataFrame(begins, "file string, before long").repartition(max(1, len(begins)), "file")
    name = column.split()[0]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, path = open_folder(folder)
        for frame in frames:
            for row in frame.itertuples():
                with store.open_input_file(f"{path}/{row.file}") as source:
                    reader = Reader(source)
                    for begin in range(0, len(reader.docs), 1000):
                        part = reader.docs[begin : begin + 1000]
                        plain = [reader.ids(begin + i) for i in range(len(part))]
                        ids = pd.array(part["doc_id"], dtype="Int64")
                        ids[part["known"] == 0] = pd.NA
                        yield pd.DataFrame({
                            "doc_id": ids, "start": row.before + reader.starts[begin : begin + len(part)],
                            "n_tokens": part["tokens"].astype(np.int64), name: list(map(digest, plain)) if digest else plain,
                        })

    return tasks.mapInPandas(read, f"doc_id long, start long, n_tokens long, {column}")


def read_documents(folder: str, file: str, positions: Sequence[int]) -> list[np.ndarray]:
    """The ids of single documents of a file, by position; nothing else is decompressed."""
    store, path = open_folder(folder)
    with store.open_input_file(f"{path}/{file}") as source:
        reader = Reader(source)
        return [np.frombuffer(reader.ids(n), dtype="<u4") for n in positions]
