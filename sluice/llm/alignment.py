"""Cross-tokenizer alignment with a dictionary of groups.

Where tokens of both tokenizers end at one byte, a text is cut into groups of A ids and
B ids. A text is a sequence of chunks, a space (or several) and what follows it, at
whose ends both always end; so each worker aligns a distinct chunk once. A task interns
the groups of a block of texts: it writes each text as codes, and each distinct
group of the block once, with how often it stands there. From that come the distinct
groups of the corpus with their frequencies; the links of each are expanded once
and counted as often as the group stands; what a group gives to a text is joined
back to the blocks by the group, and summed over the codes of each text.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Remembered, gathered, kept, mapped, new_path, scratch, slices, written
from sluice.llm.pieces import BYTE, MARK, PieceModel

#: Chunks that one Python worker remembers, twice over, and groups; chunks of a call, and of a text in it; bytes of text of a block.
CACHE_CHUNKS, CACHE_GROUPS, AT_ONCE, TOGETHER, BLOCK = 150_000, 400_000, 4_000, 100, 4 << 20
INTERNED_DDL = "block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, codes array<int>, code int, group string, times long"
RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


class Chunk(NamedTuple):
    """An aligned chunk: the packed numbers of its groups, its ids of either side, whether both stand for its bytes, and its groups as text."""

    codes: bytes
    n_a: int
    n_b: int
    whole: bool
    text: str


BROKEN = Chunk(b"", 0, 0, False, "")


class Aligner:
    """Aligns with a tokenizers file (A) and a SentencePiece model (B); it lives as long as a worker."""

    def __init__(self, a: str, b: str) -> None:
        # as many threads as Spark gives a Python worker (spark.task.cpus)
        os.environ.setdefault("RAYON_NUM_THREADS", os.environ.get("OMP_NUM_THREADS", "1"))
        import sentencepiece
        from tokenizers import Tokenizer

        self.threads = int(os.environ.get("OMP_NUM_THREADS", "1"))
        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        with open(b, "rb") as f:
            model = PieceModel(f.read())
        # A cuts before a space behind another character, as its pattern does; B never joins a marker to what is before it
        self.apart = model.plain() and self.a.normalizer is None and self.a.encode(" a b", add_special_tokens=False).ids == [i for t in (" a", " b") for i in self.a.encode(t, add_special_tokens=False).ids]
        # byte-level form: printable bytes stand for themselves, the others for characters from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in set(plain))}
        size = self.a.get_vocab_size()
        self.a_bytes = [bytes(byte.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(size)]
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in model.pieces]
        self.sizes = [np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes)]
        self.forget()

    def forget(self) -> None:
        """Begin anew with what the worker remembers: chunks, and the groups that their numbers stand for."""
        self.known, self.groups = Remembered(CACHE_CHUNKS), []
        self.numbers: dict[str, int] = {}
        self.pairs: dict[int, int] = {}  # of groups of one id each: a * 2 ** 32 + b

    def _number(self, group: str) -> int:
        n = self.numbers.setdefault(group, len(self.groups))
        if n == len(self.groups):
            self.groups.append(group)
        return n

    def _pair(self, key: int) -> int:
        n = self.pairs.get(key)
        if n is None:
            n = self.pairs[key] = self._number(f"{key >> 32}|{key & 0xFFFFFFFF}")
        return n

    def chunks(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The distinct chunks of the texts, each without its first space; each chunk's number; where those of each text begin (and the last end)."""
        if not self.apart:
            coded = texts.dictionary_encode()
            return coded.dictionary.to_pylist(), np.asarray(coded.indices), np.arange(len(texts) + 1)
        split = pc.split_pattern(texts, " ")
        at = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        number, distinct = np.asarray(coded.indices), coded.dictionary.to_pylist()
        # what ends in white space goes on with the next
        cut = pc.utf8_rtrim_whitespace(coded.dictionary)
        ends = (pc.equal(cut, coded.dictionary).to_numpy(zero_copy_only=False) & (pc.binary_length(cut).to_numpy() > 0))[number]
        ends[at[1:] - 1] = True
        odd = np.flatnonzero(~ends)
        if not len(odd):
            return distinct, number, at
        place, pieces, sizes = {c: i for i, c in enumerate(distinct)}, np.split(number, at[1:-1]), np.diff(at)
        for i in np.unique(np.searchsorted(at, odd, "right") - 1).tolist():
            whole, run = [], []
            for k, last in zip(number[at[i] : at[i + 1]].tolist(), ends[at[i] : at[i + 1]].tolist()):
                run.append(distinct[k])
                if last:
                    whole.append(" ".join(run))
                    run = []
            pieces[i] = np.array([place.setdefault(c, len(place)) for c in whole], number.dtype)
            sizes[i] = len(whole)
        return list(place), np.concatenate(pieces), np.concatenate([[0], np.cumsum(sizes)])

    def _new(self, chunks: list[str]) -> list[Chunk]:
        """Chunks that end in a character go as texts of many, whose ends are chunks' ends on both sides; others one by one."""
        found: dict[str, Chunk] = {}
        if self.apart:
            closed = [c for c in chunks if c and not c[-1].isspace()]
            for i in range(0, len(closed), AT_ONCE):
                parts = [closed[k : k + TOGETHER] for k in range(i, min(i + AT_ONCE, len(closed)), TOGETHER)]
                self._found(found, parts, [" ".join(p) for p in parts])
        rest = [c for c in chunks if c not in found]
        for i in range(0, len(rest), AT_ONCE):
            some = rest[i : i + AT_ONCE]
            self._found(found, [[c] for c in some], some)
        return [found.get(c, BROKEN) for c in chunks]

    def _found(self, found: dict[str, Chunk], parts: list[list[str]], texts: list[str]) -> None:
        """Add the chunks of the parts, each of which is encoded as a text; those of a part whose bytes or ends do not fit are left out."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=self.threads)
        for k in [k for k, t in enumerate(texts) if not t]:  # a lone marker: that behind a letter
            b[k] = self.b.encode("a ")[len(self.b.encode("a")) :]
        same = [b"".join([self.a_bytes[i] for i in x]) == (" " + t).encode() == b"".join([self.b_bytes[i] for i in y]) for t, x, y in zip(texts, a, b)]
        parts, a, b = ([x for x, ok in zip(side, same) if ok] for side in (parts, a, b))
        chunks = list(chain.from_iterable(parts))
        if not chunks:
            return
        ids = [np.array(list(chain.from_iterable(side)), np.int64) for side in (a, b)]
        # where tokens end, all texts one after the other
        both, to_a, to_b = np.intersect1d(*(np.cumsum(size[i]) for size, i in zip(self.sizes, ids)), assume_unique=True, return_indices=True)
        to_a, to_b = to_a + 1, to_b + 1
        n_a, n_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        codes = np.empty(len(both), np.uint32)
        single = (n_a == 1) & (n_b == 1)
        pairs, place = np.unique(ids[0][to_a[single] - 1] << 32 | ids[1][to_b[single] - 1], return_inverse=True)
        codes[single] = np.fromiter(map(self._pair, pairs.tolist()), np.uint32, len(pairs))[place]
        left, right = (list(map(str, x.tolist())) for x in ids)
        for g, i, j, m, n in zip(*(x[~single].tolist() for x in (np.arange(len(both)), to_a, to_b, n_a, n_b))):
            codes[g] = self._number(f"{','.join(left[i - m : i])}|{','.join(right[j - n : j])}")
        ends = np.cumsum([len(c.encode()) + 1 for c in chunks])
        at = np.searchsorted(both, ends)
        fits = both[np.minimum(at, len(both) - 1)] == ends
        fits[1:] &= fits[:-1]
        stop, packed = (at + 1).tolist(), codes.tobytes()
        names = [self.groups[k] for k in codes.tolist()]
        sizes = [np.diff(x[at], prepend=0).tolist() for x in (to_a, to_b)]
        for c, i, j, x, y, ok in zip(chunks, [0, *stop], stop, *sizes, fits.tolist()):
            if ok:
                found[c] = Chunk(packed[4 * i : 4 * j], x, y, True, ";".join(names[i:j]))

    def block(self, column: pa.Array) -> tuple[list[np.ndarray], list[str], pa.Array, list[str], np.ndarray]:
        """Of the texts of a block: n_a, n_b and n_groups; digests; codes; the groups that the codes stand for; how often each stands."""
        if len(self.groups) > CACHE_GROUPS:
            self.forget()
        texts = column.cast(pa.string()).fill_null("")
        distinct, number, at = self.chunks(texts)
        known = self.known.of([distinct], self._new)
        found = [known[c] for c in distinct]
        packed, *counts, whole, shown = zip(*found) if found else ((), (), (), (), ())
        bad = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        if not all(whole):
            broken = np.concatenate([[0], np.cumsum(~np.array(whole, bool)[number])])
            bad |= np.diff(broken[at]) > 0
        if bad.any():  # their chunks go
            sizes = np.where(bad, 0, np.diff(at))
            number, at = number[~np.repeat(bad, np.diff(at))], np.concatenate([[0], np.cumsum(sizes)])
        codes, ends = gathered(list(packed), number, at)
        totals = [np.diff(np.concatenate([[0], np.cumsum(np.array(n, np.int64)[number])])[at]) for n in counts]
        cut, of = at.tolist(), number.tolist()
        digests = [hashlib.sha256(";".join([shown[k] for k in of[i:j]]).encode()).hexdigest() if j > i else "" for i, j in zip(cut, cut[1:])]
        times = np.bincount(codes, minlength=1)
        used = np.flatnonzero(times)
        local = np.zeros(len(times), np.int32)
        local[used] = np.arange(len(used))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(local[codes]))
        return [*totals, np.diff(ends)], digests, lists, [self.groups[k] for k in used.tolist()], times[used]


def aligner(a: str, b: str) -> Aligner:
    return kept((Aligner.__name__, a, b), lambda: Aligner(a, b))


def interned(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """INTERNED_DDL: a row for each text with its codes, and a row for each distinct group of a block with its code and times, in that block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = aligner(a, b)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, BLOCK):
                counts, digests, lists, names, times = made.block(part.column("text"))
                n, k = len(part), len(names)
                of_texts, of_groups = (lambda t: pa.nulls(n, t)), (lambda t: pa.nulls(k, t))
                schema = ["block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes", "code", "group", "times"]
                first = [pa.array(np.full(n, block)), part.column("doc_id"), *(pa.array(x) for x in counts), pa.array(digests, pa.string()), lists]
                yield pa.RecordBatch.from_arrays([*first, of_texts(pa.int32()), of_texts(pa.string()), of_texts(pa.int64())], schema)
                rest = [of_groups(t) for t in (*[pa.int64()] * 4, pa.string(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), *rest, pa.array(np.arange(k), pa.int32()), pa.array(names, pa.string()), pa.array(times)], schema)
                block += 1

    return mapped(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, INTERNED_DDL)


def _expanded(a: str, b: str):
    """Batches (group, times) -> (group, times, a, b, n): the pairs of ids of a group whose bytes overlap, and how often they do in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = (x.tolist() for x in aligner(a, b).sizes)
        for batch in batches:
            out = []
            for group, times in zip(batch.column("group").to_pylist(), batch.column("times").to_pylist()):
                left, right = ([int(i) for i in side.split(",")] for side in group.split("|"))
                found: dict[tuple[int, int], int] = {}
                i = j = 0
                x, y = size_a[left[0]], size_b[right[0]]
                while True:
                    pair = left[i], right[j]
                    found[pair] = found.get(pair, 0) + 1
                    if x == y:  # only at the end of a group
                        break
                    if x < y:
                        i += 1
                        x += size_a[left[i]]
                    else:
                        j += 1
                        y += size_b[right[j]]
                out += [(group, times, p, q, n) for (p, q), n in found.items()]
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], ["group", "times", "a", "b", "n"])

    return run


def group_links(groups: DataFrame, a: str, b: str) -> DataFrame:
    """(group, times, a, b, n) of distinct groups (group, times): each group's links, expanded once."""
    return mapped(groups, _expanded(a, b), "group string, times long, a int, b int, n long")


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, count, best) of group_links: how many links of the corpus hold the pair, and the most that any pair of its B id has."""
    pairs = links.groupBy("a", "b").agg(F.sum(F.col("n") * F.col("times")).alias("count"))
    return pairs.join(pairs.groupBy("b").agg(F.max("count").alias("best")), "b").select("a", "b", "count", "best")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block, a block's groups (code, links, best, total) before its texts -> RESULT_DDL."""
    block, parts, table = None, [], None
    for batch in batches:
        blocks, of_group = np.asarray(batch.column("block")), np.asarray(batch.column("code").is_valid())
        edge = np.flatnonzero(np.concatenate([[True], (blocks[1:] != blocks[:-1]) | (of_group[1:] != of_group[:-1])]))
        for i, j in zip(edge.tolist(), [*edge[1:].tolist(), len(blocks)]):
            rows = batch.slice(i, j - i)
            if block != blocks[i]:
                block, parts, table = blocks[i], [], None
            if of_group[i]:
                parts.append(np.stack([np.asarray(rows.column(c)).astype(np.int64) for c in ("code", "links", "best", "total")]))
                continue
            if table is None:
                found = np.concatenate(parts, axis=1) if parts else np.zeros((4, 0), np.int64)
                table = np.zeros((int(found[0].max(initial=-1)) + 1, 3), np.int64)
                table[found[0]] = found[1:].T
            codes = rows.column("codes")
            sums = np.zeros((len(codes.flatten()) + 1, 3), np.int64)
            np.cumsum(table[np.asarray(codes.flatten())], axis=0, out=sums[1:])
            ends = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(codes)))])
            made = np.diff(sums[ends], axis=0)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")), *(pa.array(made[:, k]) for k in range(3)), rows.column("groups_sha256")],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )


def aligned(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """RESULT_DDL: a row for each row of docs; a: a tokenizers file of byte-level BPE, b: a SentencePiece model.

    A reads a space and the text, B the text, which puts the space in front itself;
    special tokens' strings are plain text. A text that is null or empty, or whose
    tokens' bytes are not the space and the text, has no tokens: zeros and an empty digest.
    n_links: pairs of token occurrences whose bytes overlap; n_best: those whose
    pair of ids has the highest count of its B id, ties included; count_sum: the sum of
    their pairs' counts. Rows without an id, and repeated rows, count like others. No
    rows give no rows.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "aligned")
    with scratch(spark):
        rows = written(interned(docs, a, b, doc_id, text), "interned")
        groups = rows.where("code is not null").select("block", "code", "group", "times")
        links = written(group_links(groups.groupBy("group").agg(F.sum("times").alias("times")), a, b), "links")
        counts = written(pair_counts(links), "pairs")
        best = F.when(F.col("count") == F.col("best"), F.col("n")).otherwise(0)
        values = links.join(counts, ["a", "b"]).groupBy("group").agg(F.sum("n").alias("links"), F.sum(best).alias("best"), F.sum(F.col("n") * F.col("count")).alias("total"))
        texts = rows.where("code is null").drop("code", "group", "times")
        both = groups.join(values, "group").select("block", "code", "links", "best", "total").unionByName(texts, allowMissingColumns=True)
        both = both.repartition("block").sortWithinPartitions("block", F.col("code").desc_nulls_last())
        mapped(both, _summed, RESULT_DDL).write.parquet(path)
    return spark.read.schema(RESULT_DDL).parquet(path)
