"""SentencePiece models run by the tokenizers library.

The model's protobuf is parsed and its parts are built anew: the normaliser,
the metaspace marker, the scores (unigram scores, or the merge order that BPE
scores stand for) and the byte fallback.  Batches are encoded and decoded on
several threads, and the rebuilt tokenizer's ids, which are what is returned,
are held against those of the sentencepiece library.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import text_chunks, trim_memory, worker_state

MARK = "▁"
#: New words that go through the library in one line.
LINE = 64
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6

#: How a piece that stands for one byte is written.
BYTE_PIECE = re.compile("<0x[0-9A-F]{2}>")


def _merges(pieces: list[str], mergeable: list[int]) -> list[tuple[str, str]]:
    """Pairs of pieces that make a piece, in the order of the pieces' scores."""
    at = {pieces[i]: i for i in mergeable}
    found = []
    for rank, i in enumerate(mergeable):
        p = pieces[i]
        splits = [(p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in at and p[k:] in at]
        found += [(rank, at[a], at[b], a, b) for a, b in splits]
    return [(a, b) for *_, a, b in sorted(found)]


def build_tokenizer(model_path: str):
    """A ``tokenizers.Tokenizer`` that encodes as the SentencePiece model at ``model_path`` does."""
    from sentencepiece import sentencepiece_model_pb2
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    proto = sentencepiece_model_pb2.ModelProto()
    with open(model_path, "rb") as f:
        proto.ParseFromString(f.read())
    pieces, scores, kinds = [p.piece for p in proto.pieces], [p.score for p in proto.pieces], [p.type for p in proto.pieces]
    unknown = kinds.index(UNKNOWN)
    spec = proto.normalizer_spec
    kind = proto.trainer_spec.model_type
    if kind == UNIGRAM:
        model = models.Unigram(list(zip(pieces, scores)), unknown, proto.trainer_spec.byte_fallback)
    elif kind == BPE:
        mergeable = sorted((i for i, k in enumerate(kinds) if k in (NORMAL, USER_DEFINED)), key=lambda i: (-scores[i], i))
        model = models.BPE({p: i for i, p in enumerate(pieces)}, _merges(pieces, mergeable), unk_token=pieces[unknown], fuse_unk=True, byte_fallback=proto.trainer_spec.byte_fallback)
    else:
        raise ValueError(f"model type {kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.precompiled_charsmap)] if spec.precompiled_charsmap else []
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if not any(re.search(f"[^{MARK}]{MARK}", p) for p, k in zip(pieces, kinds) if k in (NORMAL, USER_DEFINED)):
        # no piece goes on behind a marker inside it: words can be encoded one by one
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    strip = [decoders.Strip(" ", 1, 0)] if spec.add_dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *strip])
    return tokenizer


class PieceCodec:
    """Encodes and decodes batches with the rebuilt tokenizer, and holds every text's ids against the sentencepiece library's.

    Where no piece has a marker behind another character no merge goes across
    the start of a word: each distinct word is encoded once, and texts are
    joined from the words' ids.  Texts with runs of spaces or with markers of
    their own, and all texts of other models, are encoded whole.  The other
    library encodes all texts whole.
    """

    def __init__(self, model_path: str, threads: int = 2, cache_words: int = 200_000) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece

        self.tokenizer = build_tokenizer(model_path)
        self.truth = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.threads, self.limit = threads, cache_words
        self.by_word = self.tokenizer.pre_tokenizer is not None
        self.cache: dict[str, bytes] = {}
        self.leading = bool(self.truth.encode("a") and self.truth.id_to_piece(self.truth.encode("a")[0]).startswith(MARK))
        # the rebuilt tokenizer's decoder as a table: byte pieces are bytes, markers are spaces
        pieces = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if BYTE_PIECE.fullmatch(p) else p.replace(MARK, " ").encode() for p in pieces]
        self.starts = np.array([self.tokenizer.id_to_token(i).startswith(MARK) for i in range(self.tokenizer.get_vocab_size())])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, words: list[str]) -> list[bytes]:
        """Ids of words, encoded in lines of ``LINE`` and cut up again where a piece starts with the marker."""
        out: list[bytes] = []
        lines = [words[k : k + LINE] for k in range(0, len(words), LINE)]
        for line, raw in zip(lines, self._whole([" ".join(x) for x in lines])):
            cuts = (4 * np.flatnonzero(self.starts[np.frombuffer(raw, dtype="<u4")])).tolist()
            whole = len(cuts) == len(line) and cuts[0] == 0
            out += [raw[i:j] for i, j in zip(cuts, [*cuts[1:], len(raw)])] if whole else self._whole(line)
        return out

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Ids of each text, as little-endian unsigned 32-bit integers, and whether the sentencepiece library has the same."""
        single = [self.by_word and t != "" and "  " not in t and MARK not in t and t[0] != " " and t[-1] != " " for t in texts]
        split = [t.split(" ") for t, ok in zip(texts, single) if ok]
        words = set().union(*split) if split else set()
        if len(self.cache) + len(words) > self.limit:
            # only the words of this batch stay
            self.cache = {w: self.cache[w] for w in words.intersection(self.cache)}
        new = list(words.difference(self.cache))
        self.cache.update(zip(new, self._lines(new)))
        whole = iter(self._whole([t for t, ok in zip(texts, single) if not ok]))
        get, parts = self.cache.__getitem__, iter(split)
        ids = [b"".join(map(get, next(parts))) if ok else next(whole) for ok in single]
        return ids, [a == b for a, b in zip(ids, self.expected(texts))]

    def decode(self, ids: list[bytes]) -> list[str]:
        """Texts of ids, whole: the bytes of the rebuilt tokenizer's pieces in a row.  What is no UTF-8 then is left to its decoder, which marks each odd byte."""
        table, out = self.bytes_of.__getitem__, []
        for raw in ids:
            each = np.frombuffer(raw, dtype="<u4").tolist()
            try:
                text = b"".join(map(table, each)).decode("utf-8")
                out.append(text[1:] if self.leading and text.startswith(" ") else text)
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(each, skip_special_tokens=False))
        return out

    def expected(self, texts: list[str]) -> list[bytes]:
        """What the sentencepiece library makes of the texts."""
        return [array("I", x).tobytes() for x in self.truth.encode(texts, num_threads=self.threads)] if texts else []


def encode_pieces(documents: DataFrame, model_path: str, with_ids: bool = False, threads: int = 2) -> DataFrame:
    """Encode every whole text, decode the ids, and check both, in one pass without a shuffle.

    Returns doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids),
    round_trip (the decoded text equals the text) and parity (the ids equal the
    sentencepiece library's), and with ``with_ids`` the ids.  All ids are the
    rebuilt tokenizer's, also where ``parity`` is false.  Null texts count as
    empty; an empty text has no pieces.  Repeated rows are encoded each for
    itself; a null doc_id stays null; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_state(("pieces", model_path, threads), lambda: PieceCodec(model_path, threads))
        for batch in batches:
            for doc_ids, raw in text_chunks(batch, 1_000_000):
                texts = [t.decode("utf-8", "replace") for t in raw]
                ids, parity = codec.encode(texts)
                back = codec.decode(ids)
                columns = [
                    pa.array(doc_ids, pa.int64()),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(map(zlib.crc32, ids), pa.int64()),
                    pa.array([a == b for a, b in zip(back, texts)], pa.bool_()),
                    pa.array(parity, pa.bool_()),
                ]
                names = ["doc_id", "n_pieces", "ids_crc32", "round_trip", "parity"]
                if with_ids:
                    columns.append(pa.array([np.frombuffer(x, dtype="<i4") for x in ids], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
            trim_memory()

    schema = "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean, parity boolean" + ", ids array<int>" * with_ids
    return documents.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)
