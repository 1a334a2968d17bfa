"""Chat formatting by token-level assembly.

A turn becomes <turn> role <says> text </turn>, where the three marks are reserved
ids behind the tokenizer's own and role and text are encoded apart. No content can
produce a reserved id. In the text form the marks are strings, and content is
escaped: backslashes are doubled, and a backslash goes into each mark string that
occurs in it. The loss mask has the text of assistant turns.

A conversation is a run of rows, one for each turn, so that its length is not
bounded by a row or by memory.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import slices

TURN, SAYS, END = "<turn>", "<says>", "</turn>"
MARKS = (TURN, SAYS, END)
LEARNED = "assistant"
#: The library's matcher fails on white space of far more characters in a run; it gets shorter ones only.
LONG_RUN = 50_000
#: Characters that are encoded at a time; a longer piece of the pattern, a word without any break, is cut there.
AT_ONCE = 1 << 20
#: Ids that are decoded at a time.
DECODED = 1 << 20

_MARK = re.compile("|".join(MARKS))
_ESCAPE = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    return _MARK.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


class TurnCodec:
    """The tokenizer's ids, and the marks' ids behind them."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: the same merges over the whole of what it gets
        self.whole = tiktoken.Encoding("piece", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        self.pieces, self.threads = regex.compile(pattern), int(os.environ.get("OMP_NUM_THREADS", "1"))
        first = max(ranks.values()) + 1
        self.turn, self.says, self.end = first, first + 1, first + 2

    def segments(self, texts: list[str]) -> dict[str, np.ndarray]:
        """The ids of each distinct text, escaped. Common ones go to the library in one batch."""
        escaped = {t: escape(t) for t in texts}
        usual = [t for t, e in escaped.items() if len(e) <= LONG_RUN]
        made = self.encoding.encode_ordinary_batch([escaped[t] for t in usual], num_threads=self.threads)
        out = {t: np.array(ids, np.int32) for t, ids in zip(usual, made)}
        return out | {t: self._long(e) for t, e in escaped.items() if t not in out}

    def _long(self, text: str) -> np.ndarray:
        """The ids of a long text, by parts that end where its pieces by the pattern end.

        A piece of white space alone is encoded on its own; other pieces next to each other
        go together, as nothing in the pattern looks from one into another.
        """
        out, begin, end = [], 0, 0

        def flush() -> None:
            for i in range(begin, end, AT_ONCE):
                out.append(_ids(self.encoding, text[i : min(i + AT_ONCE, end)]))

        for m in self.pieces.finditer(text):
            a, b = m.span()
            blank = text[a].isspace() and text[b - 1].isspace()
            if blank or b - begin > AT_ONCE:
                flush()
                begin = a
            end = b
            if blank:
                out += [_ids(self.whole, text[i : min(i + AT_ONCE, b)]) for i in range(a, b, AT_ONCE)]
                begin = b
        flush()
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def text(self, ids: np.ndarray) -> str:
        decode = self.encoding.decode_bytes
        return b"".join(decode(ids[i : i + DECODED].tolist()) for i in range(0, len(ids), DECODED)).decode()


def _ids(encoding, text: str) -> np.ndarray:
    return encoding.encode_to_numpy(text, allowed_special=set(), disallowed_special=()).astype(np.int32)


_codecs: dict[tuple[str, str], TurnCodec] = {}


def codec(ranks_path: str, pattern: str) -> TurnCodec:
    if (ranks_path, pattern) not in _codecs:
        _codecs[ranks_path, pattern] = TurnCodec(ranks_path, pattern)
    return _codecs[ranks_path, pattern]


FORMATTED = "conv_id long, position long, token_start long, ids array<int>, loss_mask array<boolean>"


def format_conversations(turns: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """FORMATTED rows from (conv_id, turn, role, text), in order within each partition.

    position counts a conversation's turns, token_start its tokens before the turn.
    Null roles and texts are empty; turns come in ascending order, a null one first;
    rows that share a turn are all kept and follow by role, then by the text's hash.
    A null conv_id is a conversation of its own. Other columns are ignored. Texts of any
    length, white space included, are encoded whole; only a piece of the pattern (a word,
    a run of one kind of characters) of over AT_ONCE characters is cut into such parts.

    Segments are encoded where the rows are, before the shuffle; afterwards the rows
    of a conversation pass through one task in order, of which it holds a batch.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        mark = [np.array([i], np.int32) for i in (c.turn, c.says, c.end)]
        for batch in batches:
            for part in slices(batch, 2 << 20):
                roles, texts = part.column("role").to_pylist(), part.column("text").to_pylist()
                known, parts, sizes = c.segments(list({*roles, *texts})), [], []
                for role, text in zip(roles, texts):
                    parts += [mark[0], known[role], mark[1], known[text], mark[2]]
                    sizes.append((len(known[role]) + 2, len(known[text]), 1))
                edges = np.zeros(sum(map(sum, sizes)) + 1, np.int8)  # 1 where the mask begins, -1 where it ends
                begin = np.cumsum(np.array(sizes, np.int64).ravel()).reshape(-1, 3)
                learned = np.flatnonzero([r == LEARNED for r in roles])
                np.add.at(edges, begin[learned, 0], 1)
                np.add.at(edges, begin[learned, 1], -1)
                at = pa.array(np.concatenate([[0], begin[:, 2]]), pa.int32())
                ids = pa.ListArray.from_arrays(at, pa.array(np.concatenate(parts)))
                mask = pa.ListArray.from_arrays(at, pa.array(np.cumsum(edges[:-1]).astype(bool)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), part.column("role"), part.column("h"), ids, mask], ["conv_id", "turn", "role", "h", "ids", "loss_mask"]
                )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, start = (), 0, 0
        for batch in batches:
            positions, starts = [], []
            sizes = np.diff(np.asarray(batch.column("ids").offsets)).tolist()
            for conv, n in zip(batch.column("conv_id").to_pylist(), sizes):
                if (conv,) != now:
                    now, position, start = (conv,), 0, 0
                positions.append(position)
                starts.append(start)
                position, start = position + 1, start + n
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(positions, pa.int64()), pa.array(starts, pa.int64()), batch.column("ids"), batch.column("loss_mask")], ["conv_id", "position", "token_start", "ids", "loss_mask"])

    made = rows.withColumn("h", F.xxhash64("text")).mapInArrow(assemble, "conv_id long, turn long, role string, h long, ids array<int>, loss_mask array<boolean>")
    dealt = made.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "h")
    return dealt.select("conv_id", "ids", "loss_mask").mapInArrow(number, FORMATTED)


def read_turn(c: TurnCodec, ids: np.ndarray) -> tuple[str, str, int]:
    """Role, text, and characters of the text form, of a formatted turn."""
    says = int(np.argmax(ids == c.says))
    if ids[says] != c.says or ids[0] != c.turn or ids[-1] != c.end:
        raise ValueError("not a formatted turn")
    role, text = c.text(ids[1:says]), c.text(ids[says + 1 : -1])
    return unescape(role), unescape(text), len(role) + len(text) + sum(map(len, MARKS))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"


def read_conversations(formatted: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """READ rows, one for each conversation of FORMATTED rows in order: digests of what its ids and mask give back.

    turns_sha256 is of role, newline, text, newline for each turn; loss_sha256 of all
    text under the mask. Digests are fed as rows pass; a conversation holds no more
    than their state.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        now, state = (), None
        for batch in batches:
            done = []
            for conv, ids, mask in zip(batch.column("conv_id").to_pylist(), batch.column("ids"), batch.column("loss_mask")):
                ids = np.asarray(ids.values)
                if (conv,) != now:
                    if state:
                        done.append(_result(now[0], state))
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, text, chars = read_turn(c, ids)
                under = np.asarray(mask.values)
                learned = unescape(c.text(ids[under]))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += chars
                state[5] += len(ids)
                state[6] += int(under.sum())
            if done:
                yield _read_rows(done)
        if state:
            yield _read_rows([_result(now[0], state)])

    return formatted.mapInArrow(read, READ)


def _result(conv, s: list) -> tuple:
    return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4], s[5], s[6]


def _read_rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 3]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], [f.split()[0] for f in READ.split(", ")])
