"""Repeated word windows through super-k-mer partitioning.

A window is `width` consecutive words. Its minimiser is its rarest word, by how often
the words of a hash bucket stand in all texts (ties by hash), so that a word in every
document gathers nothing but what is made of such words. Consecutive windows of a text
that share their minimiser travel as one packed string (the words they span, one space
between) to the minimiser's partition, so that equal windows of all texts meet there
although each word of a 13-word window travels less than three times. There the windows
are sorted, compared word by word, and each learns the first document that has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import ODD, SPACE, add_columns, mapped, mixed, plain_names, range_sums, slices, summed, utf8, word_hashes, words_of, written

#: Words are counted in 2 ** BITS buckets of their hash; so many classes of rarity for each doubling.
BITS, FINE = 15, 4
#: Windows that a minimiser may have; the windows of one whose bucket could have more are dealt by their second rarest word too.
GROUP_WINDOWS = 2 << 20
#: Where the rarest word of a window is of a bucket with over this share of all words, windows are dealt by their sets of words:
#: nearly one by one, but a text that repeats a few words stays together.
HOT_SHARE = 1 / 64
#: A super-k-mer has at most so many windows; a longer run of one minimiser goes in pieces.
MOST_WINDOWS = 64
#: Pairs of an occurrence and a window that are looked at at a time.
PAIRS = 1 << 20

#: Bytes of strings that are sorted at a time, and of text that is cut: what texts of a slice share is sent once.
SLICE, CUT = 2 << 20, 4 << 20
#: Strings that are objects at a time.
AT_ONCE = 20_000
#: Buckets of the table that tells which documents lose words at most; see _touched.
MOST_BUCKETS = 1 << 26

KEY = "__row_key"
SPANS, DOC, MAYBE = "__spans", "__doc_id", "__maybe"


@dataclass
class WordCounts:
    """What is known of the words of each bucket; its size is fixed."""

    rarity: np.ndarray  # class, 0 for the rarest
    groups: np.ndarray  # that the windows of a minimiser are dealt to
    hot: int  # the least class whose windows are dealt by their sets of words


def word_counts(rows: DataFrame, width: int, most: int = SLICE) -> WordCounts:
    """Counts of all words of the texts of (.., text, ..), by bucket; so many bytes of text at a time."""

    def count(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(1 << BITS)
        for part in slices(batch, most):
            raw, offsets = utf8(part.column(0))
            starts, ends, _ = words_of(raw, offsets)
            total += np.bincount((word_hashes(raw, starts, ends) >> np.uint64(64 - BITS)).view(np.int64), minlength=1 << BITS)
        return total

    n = summed(rows.select("text"), count, 1 << BITS)
    rarity = lambda x: np.minimum(np.log2(x + 1) * FINE, 254).astype(np.uint8)
    groups = np.clip(np.ceil(n * width / GROUP_WINDOWS), 1, 1 << 30).astype(np.int64)
    return WordCounts(rarity(n), groups, int(rarity(n.sum() * HOT_SHARE)) + 1)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    width = 1
    while width * 2 <= n:
        x = np.minimum(x[: len(x) - width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def _super_kmers(raw: np.ndarray, offsets: np.ndarray, width: int, known: WordCounts) -> tuple[np.ndarray, ...]:
    """Of the rows' texts: minimiser, first and last word (of all), row, first word (within its row) of each super-k-mer; first byte and end of each word."""
    starts, ends, row = words_of(raw, offsets)
    none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 4, starts, ends)
    if len(starts) < width:
        return none
    h = word_hashes(raw, starts, ends)
    order = known.rarity[(h >> np.uint64(64 - BITS)).view(np.int64)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)
    window = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
    if not len(window):
        return none
    least = _dealt(_sliding_min(order, width)[window], order, window, width, known)
    new = np.ones(len(window), bool)
    new[1:] = (least[1:] != least[:-1]) | (row[window][1:] != row[window][:-1])
    first = np.flatnonzero(new)
    size = np.diff(first, append=len(window))
    if size.max() > MOST_WINDOWS:
        into = np.arange(len(window)) - np.repeat(first, size)
        first = np.flatnonzero(into % MOST_WINDOWS == 0)
        size = np.diff(first, append=len(window))
    word = window[first]
    return least[first], word, word + size - 1 + width - 1, row[word], word - np.searchsorted(row, row[word]), starts, ends


def _dealt(least: np.ndarray, order: np.ndarray, window: np.ndarray, width: int, known: WordCounts) -> np.ndarray:
    """What deals each window: a number made of its minimiser; with the second rarest word, or of its distinct words, where that alone could gather too much."""
    rarity, out = least >> np.uint64(56), mixed(least)
    parts = known.groups[(least << np.uint64(8) >> np.uint64(64 - BITS)).view(np.int64)]
    some = np.flatnonzero((parts > 1) & (rarity < known.hot))
    if len(some):
        second = np.full(len(some), ~np.uint64(0))
        for k in range(width):
            word = order[window[some] + k]
            second = np.where(word != least[some], np.minimum(second, word), second)
        out[some] = mixed(out[some] + mixed(second) % parts[some].view(np.uint64))
    some = np.flatnonzero(rarity >= known.hot)
    for i in range(0, len(some), 20_000):
        words = np.sort(order[window[some[i : i + 20_000], None] + np.arange(width)], axis=1)
        new = np.ones(words.shape, bool)
        new[:, 1:] = words[:, 1:] != words[:, :-1]
        out[some[i : i + 20_000]] = mixed((mixed(words) * new).sum(axis=1, dtype=np.uint64))
    return out


def _sent(width: int, held, cut: int):
    """Batches (key, doc_id, text) -> super-k-mers with who has them, one row for each distinct string of a slice.

    A string that many rows of a slice share is sent once with its occurrences, so
    that a passage in every document costs WHO bytes for each, not its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, cut):
                yield from slices(_of_part(part, width, held.value))

    return run


#: A further occurrence of a string: document, row key, and the first word's place in the row.
WHO = np.dtype([("doc_id", "<i8"), ("key", "<i8"), ("word", "<i4")])
#: A string with its first occurrence; `more` has the others, in order, null without.
SENT_DDL = "minimiser int, first_doc long, key long, word int, packed binary, more binary"


def _of_part(part: pa.RecordBatch, width: int, known: WordCounts) -> pa.RecordBatch:
    raw, offsets = utf8(part.column("text"))
    minimiser, a, b, row, word, starts, ends = _super_kmers(raw, offsets, width, known)
    space = SPACE[raw]
    kept = ~space
    kept[1:] |= kept[:-1] & space[1:]  # a word, and one space behind it
    at = np.zeros(len(raw) + 1, np.int32 if len(raw) < 1 << 31 else np.int64)
    np.cumsum(kept, out=at[1:])
    begin, end = at[starts[a]], at[ends[b]]
    whole = np.where(space, np.uint8(32), raw)[kept].tobytes()
    del raw, space, kept, at, starts, ends
    strings = [pa.array([whole[x:y] for x, y in zip(begin[i : i + AT_ONCE].tolist(), end[i : i + AT_ONCE].tolist())], pa.binary()) for i in range(0, len(begin), AT_ONCE)]
    packed = pa.concat_arrays(strings or [pa.array([], pa.binary())]).dictionary_encode()
    del whole, strings, begin, end
    who = np.empty(len(a), WHO)
    who["doc_id"], who["key"], who["word"] = np.asarray(part.column("doc_id"))[row], np.asarray(part.column(KEY))[row], word
    number = np.asarray(packed.indices)
    order = np.lexsort((who["doc_id"], number))
    who, at = who[order], np.searchsorted(number[order], np.arange(len(packed.dictionary) + 1))
    first = who[at[:-1]]
    further = np.delete(who, at[:-1])
    ends = ((at - np.arange(len(at))) * WHO.itemsize).astype(np.int32)
    alone = pa.array(ends[1:] == ends[:-1])
    more = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(further.tobytes())])
    least = np.empty(len(first), np.uint64)
    least[number] = minimiser
    dealt = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
    columns = [pa.array(dealt), *(pa.array(np.ascontiguousarray(first[c])) for c in WHO.names), packed.dictionary, pc.if_else(alone, pa.scalar(None, pa.binary()), more)]
    return pa.RecordBatch.from_arrays(columns, ["minimiser", "first_doc", "key", "word", "packed", "more"])


def _found(width: int, most: int = SLICE):
    """Rows of SENT_DDL sorted by (minimiser, first_doc) -> (doc_id, key, a, b): words a to b of the row are in a window that an earlier document has.

    As rows come in order of their first document, the first row with a window has
    the window's first document, and rows leave as they come. Held over are only the
    strings of the minimiser at the end that have a window first; rows are looked at when
    they are `most` bytes, or as many as these, so that none is sorted more than a few times.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting, size
            part = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting, size = [], 0
            made, held = _of_rows(part, held, width)
            if made is not None:
                yield made

        for batch in batches:
            for part in slices(batch, most):
                waiting.append(part)
                size += part.nbytes
                if size >= max(most, held.nbytes if held else 0):
                    yield from done()
        if waiting:
            yield from done()

    return run


OPEN = ["minimiser", "first_doc", "packed"]


def _of_rows(part: pa.RecordBatch, held: pa.RecordBatch | None, width: int) -> tuple[pa.RecordBatch | None, pa.RecordBatch]:
    """The spans of the rows' occurrences, and the rows (OPEN) to hold over; held: those of earlier calls."""
    rows = part.select(OPEN)
    if held is not None and held.num_rows and held.column("minimiser")[0] == part.column("minimiser")[0]:
        rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()[0]
    before = rows.num_rows - part.num_rows
    raw, offsets = utf8(rows.column("packed"))
    starts, ends, row = words_of(raw, offsets)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw[~SPACE[raw]])])
    word = np.asarray(words.dictionary_encode().indices)  # equal words have equal numbers, and no others
    window = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
    first = _first_equal(word, window, width)
    of = row[window]
    docs = np.asarray(rows.column("first_doc"))[of[first]]
    minimiser = np.asarray(rows.column("minimiser"))
    keep = np.zeros(rows.num_rows, bool)
    keep[of[first == np.arange(len(first))]] = True
    keep &= minimiser == minimiser[-1]
    own = int(np.searchsorted(of, before))
    first_word = np.searchsorted(row, of[own:])
    return _spans(part, of[own:] - before, window[own:] - first_word, docs[own:], width), rows.filter(pa.array(keep))


def _first_equal(word: np.ndarray, window: np.ndarray, width: int) -> np.ndarray:
    """For each window the first one that has the same words."""
    h = range_sums(mixed(word.astype(np.uint64) + np.uint64(1)), ODD, window, window + width)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    i, j = window[order[:-1][same]], window[order[1:][same]]
    if not all(np.array_equal(word[i + k], word[j + k]) for k in range(width)):  # different windows of one hash
        order = np.lexsort([word[window + k] for k in range(width)][::-1])
        i, j = window[order[:-1]], window[order[1:]]
        same = np.logical_and.reduce([word[i + k] == word[j + k] for k in range(width)])
    new = np.ones(len(order), bool)
    new[1:] = ~same
    out = np.empty(len(order), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    return out


def _spans(part, of, at, first, width):
    """Spans of words for each occurrence with a window that an earlier document has; at: the window's place in its row."""
    rows, where = np.unique(of, return_index=True)
    if not len(rows):
        return None
    who, begin = _occurrences(part)
    n_occ, n_win = np.diff(begin)[rows], np.diff(np.append(where, len(of)))
    begin = begin[rows]
    latest = np.maximum.reduceat(who["doc_id"], begin)
    least, most = np.minimum.reduceat(first, where), np.maximum.reduceat(first, where)
    found = []
    # All windows of a row have one first document: an occurrence is covered whole or not at all.
    even = np.flatnonzero((least < latest) & (least == most))
    occ = _ranges(begin[even], n_occ[even])
    hit = np.repeat(least[even], n_occ[even]) < who["doc_id"][occ]
    found.append((occ[hit], np.zeros(hit.sum(), np.int64), np.repeat(n_win[even], n_occ[even])[hit]))
    # Else every occurrence is looked at with every window, so many pairs at a time.
    odd = np.flatnonzero((least < latest) & (least != most))
    for some in np.split(odd, np.flatnonzero(np.diff(np.cumsum(n_occ[odd] * n_win[odd]) // PAIRS)) + 1):
        occ = _ranges(begin[some], n_occ[some])
        per = np.repeat(n_win[some], n_occ[some])
        place = _ranges(np.zeros_like(per), per)
        owner = np.repeat(occ, per)
        hit = first[np.repeat(np.repeat(where[some], n_occ[some]), per) + place] < who["doc_id"][owner]
        owner, place = owner[hit], place[hit]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
        a = np.flatnonzero(new)
        found.append((owner[a], place[a], place[np.append(a[1:], len(owner))[: len(a)] - 1] + 1))
    occ, a, b = (np.concatenate(x) for x in zip(*found))
    if not len(occ):
        return None
    who = who[occ]
    spans = [who["doc_id"], who["key"], (who["word"] + a).astype(np.int32), (who["word"] + b - 1 + width).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in spans], ["doc_id", KEY, "a", "b"])


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, .. of each size, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _occurrences(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of the rows' strings, the first of each in front, and where each row's begin (and the last end)."""
    flat, ends = utf8(part.column("more"))
    further, n = np.frombuffer(flat.tobytes(), WHO), ends // WHO.itemsize
    begin = n + np.arange(len(n))
    who = np.empty(begin[-1], WHO)
    for name, column in zip(WHO.names, ("first_doc", "key", "word")):
        who[name][begin[:-1]] = np.asarray(part.column(column))
    who[np.delete(np.arange(len(who)), begin[:-1])] = further
    return who, begin


def repeated_spans(rows: DataFrame, width: int, cut: int = CUT) -> DataFrame:
    """(doc_id, row key, a, b): words a to b of a row of (doc_id, row key, text) that a window of a smaller doc_id covers."""
    rows = rows.where("doc_id is not null").select("doc_id", KEY, "text")
    most = min(SLICE, cut)
    known = rows.sparkSession.sparkContext.broadcast(word_counts(rows, width, most))
    sent = mapped(rows, _sent(width, known, cut), SENT_DDL)
    dealt = sent.repartition("minimiser").sortWithinPartitions("minimiser", "first_doc")
    return mapped(dealt, _found(width, most), f"doc_id long, {KEY} long, a int, b int")


def _touched(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with MAYBE: false only where no span is of the document, whose text then need not be shuffled.

    Ids are hashed to buckets, sixteen for each id with spans and MOST_BUCKETS at most,
    whose bits fill up to MOST_BUCKETS / 64 rows: a bound on what is broadcast. With far
    more ids the buckets fill up, and more documents go through the join in vain.
    """
    n = spans.select(DOC).distinct().count()
    buckets = 64
    while buckets < min(16 * n, MOST_BUCKETS):
        buckets *= 2
    at = F.xxhash64(F.col(DOC), F.lit(1)).bitwiseAND(F.lit(buckets - 1))
    place = {"__word": F.shiftrightunsigned("__at", 6), "__bit": F.expr("shiftleft(1L, cast(__at & 63 as int))")}
    bits = spans.select(DOC, at.alias("__at")).withColumns(place).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    out = docs.withColumn("__at", at).withColumns(place).join(F.broadcast(bits), "__word", "left")
    maybe = F.coalesce(F.col("__bits").bitwiseAND(F.col("__bit")) != 0, F.lit(False))
    return out.withColumn(MAYBE, maybe).drop("__at", "__word", "__bit", "__bits")


def without_repeats(docs: DataFrame, width: int, doc_id: str = "doc_id", text: str = "text", cut: int = CUT) -> DataFrame:
    """docs with n_words, n_removed and kept_text: each word goes that a window covers whose words also start in a smaller doc_id.

    kept_text joins the kept words by one space; the text itself stays as it is.
    Windows are judged on the input. Null and empty texts, and texts shorter than a
    window, lose nothing; rows without a doc_id are kept whole and remove nothing;
    rows of the same doc_id do not remove from each other. Other columns pass through;
    columns named as the three new ones are replaced. No rows give no rows. cut: bytes of
    text that are cut into strings at a time, which a worker holds some thirty times; where it
    is less than SLICE, words are counted, strings sorted and texts joined by as much, too.
    """
    new = ("n_words", "n_removed", "kept_text")
    docs, names = plain_names(docs, doc_id, text, without=new)
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias(KEY))
    several = ids.groupBy("doc_id").agg((F.min(KEY) != F.max(KEY)).alias("differ")).where("differ and doc_id is not null").limit(1).count()
    # Rows are told apart by their text's hash, which is only sent where an id has several texts.
    keyed = docs.withColumns({KEY: F.xxhash64(text) if several else F.lit(0).cast("long"), DOC: F.col(doc_id).cast("long")})
    spans = repeated_spans(keyed.select(F.col(DOC).alias("doc_id"), KEY, F.col(text).alias("text")), width, cut)
    spans = spans.groupBy(F.col("doc_id").alias(DOC), KEY).agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias(SPANS))
    spans = written(spans, "spans")
    keyed = _touched(keyed, spans)
    joined = keyed.where(MAYBE).drop(MAYBE).join(spans, [DOC, KEY], "left")
    joined = joined.unionByName(keyed.where(~F.col(MAYBE)).drop(MAYBE), allowMissingColumns=True)
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())]

    def make():
        def shorter(batch: pa.RecordBatch) -> list[pa.Array]:
            texts = batch.column(text).cast(pa.large_binary()).fill_null(b"").to_pylist()
            spans = batch.column(SPANS)
            n_words, n_removed, kept = [], [], []
            for i, t in enumerate(texts):
                words = t.split()
                left, done = words, 0
                if spans[i].is_valid:
                    left = []
                    for s in spans[i].as_py():
                        left += words[done : max(done, s["a"])]
                        done = max(done, s["b"])
                    left += words[done:]
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            return [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]

        return shorter

    return add_columns(joined, fields, make, (KEY, DOC, SPANS), min(SLICE, cut)).toDF(*names, *new)
