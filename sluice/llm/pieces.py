"""SentencePiece encoding and decoding on the tokenizers library.

A model file is a protobuf: its pieces with scores and types, the trainer's model
type and the normaliser's settings are read from it, and an equal tokenizer is
built: normaliser, metaspace marker, unigram scores or merges in score order, and
byte fallback. Its ids are the result. No piece has a marker behind another
character, so that a text's pieces are those of its chunks (a run of markers and
what follows it); each worker encodes a distinct chunk once, in batches on all its
threads. Beside that every chunk is verified against the SentencePiece library, and
`parity` says whether all chunks of a text agree.
"""

from __future__ import annotations

import os
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sluice.llm.common import Remembered, add_columns, gathered, give_back, kept

MARK = "▁"
#: Types of pieces, and of models, in the file format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Chunks that one Python worker remembers, twice over.
CACHE_CHUNKS = 100_000
#: Chunks of a batch of the tokenizers library, and of a text in it; bytes of text that are encoded at a time.
AT_ONCE, GROUP, SLICE = 4_000, 100, 2 << 20


def wire_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The (number, value) fields of a protobuf message."""
    i = 0

    def number() -> int:
        nonlocal i
        value = shift = 0
        while True:
            c = data[i]
            i += 1
            value |= (c & 127) << shift
            shift += 7
            if c < 128:
                return value

    while i < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[i : i + size]
        i += size


class PieceModel:
    """What a SentencePiece model file says."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        normaliser: dict = {}
        for field, value in wire_fields(data):
            if field == 1:
                x = dict(wire_fields(value))
                self.pieces.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0, x.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(wire_fields(value))
            elif field == 3:
                normaliser = dict(wire_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.squeeze = bool(normaliser.get(4, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError(f"models of type {self.kind} are not supported")

    def tokenizer(self):
        """The equal tokenizer of the tokenizers library."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], unk_id=unknown, byte_fallback=self.byte_fallback)
        else:
            ids = {p: i for i, (p, _, kind) in enumerate(self.pieces)}
            joinable = {p for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED)}
            # Pieces of equal score are joined from the left, as long as they can be: the longer left part goes first.
            merges = [(-s, -i, ids[p[:i]], ids[p[i:]], p[:i], p[i:]) for p, s, kind in self.pieces if kind == NORMAL for i in range(1, len(p)) if p[:i] in joinable and p[i:] in joinable]
            model = models.BPE(ids, [m[4:] for m in sorted(merges)], unk_token=self.pieces[unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        if self.chunked:
            out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return out

    @property
    def chunked(self) -> bool:
        """No piece has a marker behind another character."""
        return not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in self.pieces if kind in (NORMAL, USER_DEFINED))

    def plain(self) -> bool:
        """Chunks can be encoded apart: the normaliser only marks spaces and puts one in front."""
        return self.chunked and self.dummy_prefix and not self.squeeze and not self.charsmap


class PieceCodec:
    """Encodes and decodes with a model file; it lives as long as a worker."""

    def __init__(self, path: str) -> None:
        # as many threads as Spark gives a Python worker (spark.task.cpus)
        os.environ.setdefault("RAYON_NUM_THREADS", os.environ.get("OMP_NUM_THREADS", "1"))
        import sentencepiece

        with open(path, "rb") as f:
            self.model = PieceModel(f.read())
        self.tokenizer, self.threads = self.model.tokenizer(), int(os.environ.get("OMP_NUM_THREADS", "1"))
        self.check = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known, self.apart = Remembered(CACHE_CHUNKS), self.model.plain()
        self.marked = np.array([p.startswith(MARK) for p, _, _ in self.model.pieces])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, where each text's begin (and the last end), whether the SentencePiece library has the same for it, and whether they decode to the text."""
        texts = column.cast(pa.string()).fill_null("")
        if not self.apart:
            made = self._encoded(rows := texts.to_pylist(), rows)
            return *gathered([x[0] for x in made], np.arange(len(made)), np.arange(len(made) + 1)), *(np.array([x[k] for x in made], bool) for k in (1, 2))
        # a text's chunks are what its markers part; only where markers run on are chunks not simply words
        runs = pc.match_substring_regex(pc.replace_substring(texts, MARK, " "), "^ |  | $").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.replace_substring(texts, MARK, " "), " ")
        at = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        number, distinct = np.asarray(coded.indices), coded.dictionary.to_pylist()
        if runs.any():
            place, parts, sizes = {c: i for i, c in enumerate(distinct)}, [], np.diff(at)
            for i in np.flatnonzero(runs).tolist():
                chunks = _joined([distinct[k] for k in number[at[i] : at[i + 1]]])
                parts.append((i, np.array([place.setdefault(c, len(place)) for c in chunks], number.dtype)))
                sizes[i] = len(chunks)
            distinct, pieces = list(place), np.split(number, at[1:-1])
            for i, chunks in parts:
                pieces[i] = chunks
            number, at = np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)])
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        if empty.any():  # an empty text has no chunk
            sizes = np.where(empty, 0, np.diff(at))
            number, at = number[~np.repeat(empty, np.diff(at))], np.concatenate([[0], np.cumsum(sizes)])
        known = self.known.of([distinct], self._new)
        made = [x if isinstance(x := known[c], tuple) else (x, True, True) for c in distinct]
        ids, ends = gathered([x[0] for x in made], number, at)
        # a text's ids decode to what its chunks' ids decode to, one after the other
        flags = []
        for k in (1, 2):
            wrong = np.array([not x[k] for x in made], bool)
            flags.append(np.diff(np.concatenate([[0], np.cumsum(wrong[number])])[at]) == 0 if wrong.any() else np.ones(len(texts), bool))
        return ids, ends, *flags

    def _check(self, texts: list[str]) -> list[list[int]]:
        return self.check.encode(texts, num_threads=self.threads)

    def _checked(self, chunks: list[str], ids: list[list[int]], wanted: list[list[int]]) -> list[tuple[bytes, bool, bool]]:
        """Packed ids of each chunk, whether they are the wanted ones, and whether the rebuilt decoder makes the chunk of them again."""
        texts = self.tokenizer.decode_batch(ids, skip_special_tokens=False)
        return [(array("I", x).tobytes(), x == want, t == c.replace(MARK, " ")) for c, x, want, t in zip(chunks, ids, wanted, texts)]

    def _encoded(self, chunks: list[str], as_checked: list[str]) -> list[tuple[bytes, bool, bool]]:
        """Chunks one by one, verified by the SentencePiece library in the form of as_checked."""
        out = []
        for i in range(0, len(chunks), AT_ONCE):
            some = chunks[i : i + AT_ONCE]
            own = self.tokenizer.encode_batch_fast(some, add_special_tokens=False)
            out += self._checked(some, [e.ids for e in own], self._check(as_checked[i : i + AT_ONCE]))
        return out

    def _new(self, chunks: list[str]) -> list[bytes | tuple[bytes, bool, bool]]:
        """What is remembered of new chunks: of those without a fault the packed ids alone. Those of one marker go as texts of many; their first ids tell them apart."""
        found: dict[str, tuple[bytes, bool, bool]] = {}
        single = [c for c in chunks if c and not c.startswith(MARK)]
        for i in range(0, len(single), AT_ONCE):
            groups = [single[k : k + GROUP] for k in range(i, min(i + AT_ONCE, len(single)), GROUP)]
            texts = [" ".join(g) for g in groups]
            own = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            names, ids = [], []
            for group, e, want in zip(groups, own, self._check(texts)):
                made = e.ids
                first = np.flatnonzero(self.marked[made]).tolist()
                if made == want and len(first) == len(group):
                    names += group
                    ids += [made[a:b] for a, b in zip(first, [*first[1:], None])]
            found.update(zip(names, self._checked(names, ids, ids)))
        rest = [c for c in chunks if c not in found and c]
        found.update(zip(rest, self._encoded(rest, [c.replace(MARK, " ") for c in rest])))
        if "" in chunks:  # a lone marker, at the end of a text: that of a letter and a space, less the letter
            alone, own = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("a", "a "))
            found[""] = array("I", own[len(alone) :]).tobytes(), own == self._check(["a "])[0], self.tokenizer.decode(own, skip_special_tokens=False) == "a "
        return [x[0] if x[1] and x[2] else x for x in map(found.__getitem__, chunks)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of runs of ids, by the rebuilt decoder."""
        ids, at = ids.tolist(), at.tolist()
        return self.tokenizer.decode_batch([ids[a:b] for a, b in zip(at, at[1:])], skip_special_tokens=False)


def _joined(words: list[str]) -> list[str]:
    """The chunks of a text that is split at its markers, each without its first marker: what follows, after further markers."""
    if "" not in words:
        return words
    out, run = [], 0
    for w in words:
        if w:
            out.append(MARK * run + w)
            run = 0
        else:
            run += 1
    return [*out, MARK * (run - 1)] if run else out


def codec(path: str) -> PieceCodec:
    return kept((PieceCodec.__name__, path), lambda: PieceCodec(path))


ENCODED = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("parity", T.BooleanType())]


def encoded(docs: DataFrame, model: str, text: str = "text", verify: bool = False, most: int = SLICE) -> DataFrame:
    """docs with ids, n_tokens and parity (the SentencePiece library gives the same ids) in place of the text.

    The ids are the rebuilt tokenizer's, whatever the library says.

    verify adds round_trip: the ids, decoded, give the text again, with the marker
    itself as a space. As decoding goes chunk by chunk, a worker decodes each distinct
    chunk once, when it encodes it.

    Whole texts are encoded; a null text is empty and has no ids. Other columns pass
    through, and those named as the new ones are replaced. No rows give no rows.
    most: bytes of text at a time; what these have taken goes back to the system.
    """

    def make():
        c = codec(model)

        def encode(batch: pa.RecordBatch) -> list[pa.Array]:
            ids, ends, same, back = c.encode(batch.column(text))
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
            made = [column, pa.array(np.diff(ends), pa.int64()), pa.array(same)]
            if verify:
                made.append(pa.array(back))
            give_back()
            return made

        return encode

    fields = [*ENCODED, T.StructField("round_trip", T.BooleanType())] if verify else ENCODED
    return add_columns(docs, fields, make, drop=(text,), most=most)


def decoded(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """rows with the text that the ids stand for; a null list gives an empty text."""

    def make():
        c = codec(model)

        def decode(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(ids)
            return [pa.array(c.decode(np.asarray(column.values), np.asarray(column.offsets)), pa.string())]

        return decode

    return add_columns(rows, [T.StructField(text, T.StringType())], make, most=SLICE)
