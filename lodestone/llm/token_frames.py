"""Token ids in independent zstandard frames with a trailing seek table.

A file is a run of zstandard frames, each decompressible by itself, then two
skippable frames: the index of documents, and the seek table of the public
zstandard seekable format (compressed size, decompressed size and checksum of
each frame).  A reader fetches the tail, then only the frames that hold the
documents it wants.  Ids are little-endian unsigned 32-bit integers; every
document ends with the end id.  A document of null doc_id has a mark of its own
in the index.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import new_path, text_chunks, worker_state

#: Fixed values of the seekable format and of skippable frames.
SEEK_MAGIC, SKIPPABLE, INDEX_SKIPPABLE = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
#: Ids gathered into one frame before it is closed; a longer document fills a frame of its own.
FRAME_IDS = 65_536
#: Documents that a reader hands on at once.
READ_ROWS = 2_000
#: Bytes of text whose distinct words are looked up at once.
CHUNK_BYTES = 8_000_000
#: Words whose ids a worker remembers.
CACHE_WORDS = 350_000
#: ASCII punctuation other than apostrophes between a letter and white space; the sign comes first, so that the search is one for signs.
_STOP = re.compile(rb"([!-&(-/:-@\[-`{-~])(?<=[a-z].)([!-&(-/:-@\[-`{-~]*)(?=[ \n])", re.S)


class FrameWriter:
    """Writes documents (id, ids as bytes) to a binary file object in ascending order."""

    def __init__(self, sink, frame_ids: int = FRAME_IDS, level: int = 3) -> None:
        self.sink, self.limit, self.level = sink, 4 * frame_ids, level
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.pending: list[bytes] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.limit:
            self._close_frame()
        self.docs.append((doc_id or 0, len(self.frames), len(ids) // 4, doc_id is None))
        self.pending.append(ids)
        self.size += len(ids)

    def _close_frame(self) -> None:
        raw = b"".join(self.pending)
        packed = zstandard.ZstdCompressor(level=self.level, write_checksum=True).compress(raw)
        self.sink.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.size = [], 0

    def finish(self) -> None:
        if self.pending:
            self._close_frame()
        docs = zstandard.ZstdCompressor().compress(np.array(self.docs, dtype="<i8").reshape(-1, 4).T.tobytes())
        self.sink.write(struct.pack("<II", INDEX_SKIPPABLE, len(docs)) + docs)
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)


class FrameReader:
    """Reads single documents, or all, of a file with random access (``seek`` and ``read``)."""

    def __init__(self, source, size: int) -> None:
        self.source = source
        count, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        self.frames = list(struct.iter_unpack("<III", self._at(size - 9 - 12 * count, 12 * count)))
        self.starts = [0]
        for packed, _, _ in self.frames:
            self.starts.append(self.starts[-1] + packed)
        magic, length = struct.unpack("<II", self._at(self.starts[-1], 8))
        if magic != INDEX_SKIPPABLE:
            raise ValueError("no index of documents behind the frames")
        self.doc_ids, self.frame_of, self.n_ids, self.no_id = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._at(self.starts[-1] + 8, length)), dtype="<i8").reshape(4, -1)
        first = np.searchsorted(self.frame_of, self.frame_of)
        ends = np.concatenate([[0], np.cumsum(self.n_ids)])
        self.offset = ends[:-1] - ends[first]

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        found = self.source.read(size)
        if len(found) != size:
            raise ValueError("the file is cut off")
        return found

    def frame(self, k: int) -> bytes:
        """The ids of one frame, held against its checksum."""
        packed, size, check = self.frames[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(self.starts[k], packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def document(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of this id; decompresses no other frames."""
        rows = np.flatnonzero(self.no_id == 1 if doc_id is None else (self.doc_ids == doc_id) & (self.no_id == 0))
        return [np.frombuffer(self.frame(int(self.frame_of[r])), dtype="<u4")[self.offset[r] : self.offset[r] + self.n_ids[r]] for r in rows]

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        """Every document in order, with one frame in memory at a time."""
        at, raw = -1, b""
        for doc_id, k, start, n, none in zip(self.doc_ids.tolist(), self.frame_of.tolist(), self.offset.tolist(), self.n_ids.tolist(), self.no_id.tolist()):
            if k != at:
                at, raw = k, self.frame(k)
            yield None if none else doc_id, raw[4 * start : 4 * (start + n)]


#: Patterns of words by which pre-tokenizers keep words and drop the rest; the first keeps letters apart from stops.
LETTER_RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE_RUNS = r"\s+"


def _flat(part: dict | None, inner: str) -> list[dict]:
    return [] if part is None else [x for p in part[inner] for x in _flat(p, inner)] if part["type"] == "Sequence" else [part]


def word_rules(path: str) -> tuple[bool, bool]:
    """Whether a tokenizer's file says that texts may be encoded word by word, and that words are lower-cased and parted from stops.

    The first needs a normaliser that works on each word by itself, a
    pre-tokenizer that drops white space, and special tokens that the encoder
    can tell (``<|``) from words.  What is not known for sure is encoded whole.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    steps, cuts = _flat(spec.get("normalizer"), "normalizers"), _flat(spec.get("pre_tokenizer"), "pretokenizers")
    blank = lambda s: s["type"] == "Replace" and s["pattern"] == {"Regex": SPACE_RUNS} and s["content"] == " "
    runs = bool(cuts) and cuts[0]["type"] == "Split" and cuts[0]["pattern"] == {"Regex": LETTER_RUNS} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    known = [x.get("add_prefix_space") is False and x.get("use_regex") is False for x in cuts[1:] if x["type"] == "ByteLevel"]
    rest = len(known) == len(cuts) - 1 and all(known)
    apart = all(t["content"].startswith("<|") and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
    by_word = runs and rest and apart and spec.get("truncation") is None and all(s["type"] in ("NFC", "NFD", "Lowercase") or blank(s) for s in steps)
    return bool(by_word), bool(by_word and any(s["type"] == "Lowercase" for s in steps))


class WordEncoder:
    """Encodes texts with a tokenizer of the tokenizers library.

    Where ``word_rules`` allow it the tokenizer never looks across white space,
    so the library encodes each distinct word once and documents are joined
    from the words' ids; where it lower-cases, punctuation between a letter and
    white space is a word of its own.  Other tokenizers encode whole texts.
    Words are remembered in two generations: when the younger is full, the
    older, whose words were not met since, is forgotten.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word, self.lower_case = word_rules(path)
        self.limit = cache_words
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab() if suffix else {}
        self.word_ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool) if suffix else None
        for piece, i in vocabulary.items():
            self.word_ends[i] = piece.endswith(suffix)
        # letters a to z come out of every step of ``word_rules`` as they went in, so the model alone is asked
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _words(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The distinct words of texts, the place of each word among them, and where each text's words begin and the last one's end."""
        if self.lower_case:  # markers of special tokens are case-sensitive
            texts = [t if b"<|" in t else _STOP.sub(rb" \1\2", t.lower()) for t in texts]
        rows = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_utf8(), safe=False))
        coded = rows.flatten().dictionary_encode()
        return coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), rows.offsets.to_numpy()

    def _encode_words(self, words: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Words and their ids.  Words of letters alone go to the library in lines of 50, cut up again behind each word's last piece."""
        rest = []
        plain: dict[bool, list[tuple[bytes, str]]] = {True: [], False: []}
        for word in words:
            text = word.decode("utf-8", "replace")
            if self.word_ends is not None and text.isalpha():
                plain[text.isascii() and text.islower()].append((word, text))
            else:
                rest.append((word, text))
        for letters, found in plain.items():
            lines = [found[k : k + 50] for k in range(0, len(found), 50)]
            encoder = self.letters if letters else self.tokenizer
            for line, coded in zip(lines, encoder.encode_batch_fast([" ".join([t for _, t in x]) for x in lines], add_special_tokens=False)):
                ids = np.array(coded.ids, dtype="<u4")
                ends = (4 * np.flatnonzero(self.word_ends[ids]) + 4).tolist()
                if len(ends) == len(line):
                    raw, at = ids.tobytes(), 0
                    for (word, _), end in zip(line, ends):
                        yield word, raw[at:end]
                        at = end
                else:
                    rest += line
        coded = self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)
        yield from ((word, array("I", e.ids).tobytes()) for (word, _), e in zip(rest, coded))

    def encode(self, texts: list[bytes], end: bytes = b"") -> list[bytes]:
        """Ids as little-endian bytes of each text (UTF-8), and ``end`` behind each."""
        if not self.by_word:
            coded = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [array("I", e.ids).tobytes() + end for e in coded]
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}
        words, places, starts = self._words(texts)
        known = list(map(self.young.get, words))
        missing = [w for w, x in zip(words, known) if x is None]
        if missing:
            again = {w: x for w, x in zip(missing, map(self.old.get, missing)) if x is not None}
            new = [w for w in missing if w not in again]
            self.young.update(again)
            for start in range(0, len(new), 5_000):
                self.young.update(self._encode_words(new[start : start + 5_000]))
            known = list(map(self.young.__getitem__, words))
        ids = np.frombuffer(b"".join(known), dtype="<u4")
        sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        n = sizes[places]
        ends = np.cumsum(n)
        # the id at each place of the output is the k-th of its word, at the word's place among the distinct ones
        at = np.repeat((np.cumsum(sizes) - sizes)[places] - (ends - n), n)
        at += np.arange(len(at))
        raw, cuts = ids[at].tobytes(), (4 * np.concatenate([[0], ends])[starts]).tolist()
        return [raw[a:b] + end for a, b in zip(cuts, cuts[1:])]


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI and the path in it."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + os.path.abspath(path))


def write_token_frames(documents: DataFrame, path: str, tokenizer: str, end_id: int, n_files: int | None = None) -> list[tuple[str, int, int]]:
    """Encode ``documents`` (doc_id, text) into frame files below ``path``, in ascending doc_id order.

    Rows are range-partitioned by doc_id once, as text; each task encodes and
    writes one file under a name of its own attempt, then renames it, so a
    repeated task replaces its file.  Null doc_ids come first and stay null.
    Rows of equal doc_id, null among them, are ordered by a hash of the text and
    then by text, and may be split between files.  Null texts are empty.  Returns
    (file, documents, ids) of each file in order: one small row a file reaches
    the driver.  Of an empty table there are no files.
    """
    rows = documents.selectExpr("cast(doc_id as long) as doc_id", "text", "xxhash64(text) as hash")
    ranged = rows.repartitionByRange(n_files, "doc_id", "hash") if n_files else rows.repartitionByRange("doc_id", "hash")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(path)
        context = TaskContext.get()
        final = f"{folder}/part-{context.partitionId():06d}.tokz"
        draft = f"{folder}/.{context.partitionId():06d}-{context.taskAttemptId()}"
        encoder, end = worker_state(("words", tokenizer), lambda: WordEncoder(tokenizer)), struct.pack("<I", end_id)
        docs = ids = 0
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(draft) as sink:
            writer = FrameWriter(sink)
            for batch in batches:
                for doc_ids, texts in text_chunks(batch, CHUNK_BYTES):
                    for doc_id, raw in zip(doc_ids, encoder.encode(texts, end)):
                        writer.add(doc_id, raw)
                        docs, ids = docs + 1, ids + len(raw) // 4
            writer.finish()
        store.move(draft, final)
        yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "docs": [docs], "ids": [ids]}, pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())]))

    done = ranged.sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text").mapInArrow(write, "part int, docs long, ids long").collect()
    return [(f"{path}/part-{r.part:06d}.tokz", r.docs, r.ids) for r in sorted(done) if r.docs]


def read_token_frames(spark: SparkSession, files: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in ``files``.

    One task a file; the driver only adds up the files' sizes.
    """
    starts, at = [], 0
    for name, _, ids in files:
        starts.append((name, at))
        at += ids

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns)):
                store, path = open_store(name)
                with store.open_input_file(path) as source:
                    documents = iter(FrameReader(source, source.size()))
                    while some := list(islice(documents, READ_ROWS)):
                        rows = []
                        for doc_id, raw in some:
                            rows.append((doc_id, start, len(raw) // 4, zlib.crc32(raw)))
                            start += len(raw) // 4
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not starts:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame(starts, "file string, start long").repartition(len(starts), "file")
    return listed.mapInArrow(read, schema)


def token_frames(documents: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Write ``documents`` as frame files and return what a reader finds in them.

    One row for each row of ``documents``, repeated ones too; a null doc_id
    stays null, a null or empty text has the end id alone, other columns are
    not read.  Empty table: no rows.
    """
    spark = documents.sparkSession
    return read_token_frames(spark, write_token_frames(documents, path or new_path(spark, "token-frames"), tokenizer, end_id))
