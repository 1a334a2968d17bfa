from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from conftest import DATA
from tokenizers import Tokenizer

from sluice.llm import alignment
from sluice.llm.queries import BYTE_BPE, PIECES, op13_tokenizer_alignment

SF = f"{DATA}/sf0.001"


def byte_of():
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def brute(texts):
    """The rows of (doc_id, text): each text encoded whole, groups and links from byte ranges."""
    a, b, byte = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES), byte_of()
    a.encode_special_tokens = True
    found, counts = [], Counter()
    for doc, text in texts:
        left = right = []
        if text:
            left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
            right = [(i, bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in pieces]
            if not b"".join(x for _, x in left) == (" " + text).encode() == b"".join(x for _, x in right):
                left = right = []
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (left, right)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups, start = [], 0
        for c in cuts:
            sides = [[str(i) for (i, _), e in zip(side, end) if start < e <= c] for side, end in zip((left, right), ends)]
            groups.append("|".join(",".join(s) for s in sides))
            start = c
        links, j = [], 0
        for (i, x), e in zip(left, ends[0]):
            while j and ends[1][j - 1] > e - len(x):
                j -= 1
            while j < len(right) and (ends[1][j] - len(right[j][1])) < e:
                if ends[1][j] > e - len(x):
                    links.append((i, right[j][0]))
                j += 1
        counts.update(links)
        found.append((doc, len(left), len(right), groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(
        (
            (doc, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
            for doc, n_a, n_b, groups, links in found
        ),
        key=str,
    )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def aligned(spark, data):
    df = spark.createDataFrame(data, "doc_id long, text string")
    return sorted((tuple(r) for r in alignment.aligned(df, BYTE_BPE, PIECES).select(COLUMNS).collect()), key=str)


ODD = [
    "", None, " ", "  ", "a", " a", "a ", "a  ", "  a  b ", "a\nb", "a \n b\n", "\n", "\n\n \n", "\t x", "tab\tand  two", "▁ marker", "a▁b", "<|endoftext|> plain", "<s> </s> <unk> <0x0A>", " wide  x", "x  y", "\x1c x\x1c y", "\u0085 z",
    "日本語 の テキスト", "é́ combining", "👩‍👩‍👧 family", "it's we'll  'tis", "\x00 nul", "3.14159 and 1,000", "…dots… -- dashes", "naïve façade", "a" * 3000, "word " * 2000, "é " * 3000, "\r\n line \r\n", "ﬁ ligature ２ full",
]


def test_odd_texts(spark):
    data = list(enumerate(ODD)) + [(None, "no id here"), (3, "another text of an id"), (3, "another text of an id")]
    got = aligned(spark, data)
    assert got == brute(data)
    assert [r[-1] for r in got if r[0] == 0] == [""] and [r[1:7] for r in got if r[0] == 15] == [(0,) * 6]
    assert aligned(spark, []) == []


def test_blocks_and_partitions_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = ["ab", "abc", "Über", "the", "don't", "x1", "\n", "", "tokenizer", "é"]
    data = [(i, " ".join(rng.choice(words, int(rng.integers(0, 40))))) for i in range(200)]
    want = brute(data)
    assert aligned(spark, data) == want
    monkeypatch.setattr(alignment, "BLOCK", 200)
    monkeypatch.setattr(alignment, "CACHE_GROUPS", 5)
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    assert sorted((tuple(r) for r in alignment.aligned(df, BYTE_BPE, PIECES).select(COLUMNS).collect()), key=str) == want


def test_whole_texts_where_chunks_cannot_be_cut(spark):
    made = alignment.Aligner(BYTE_BPE, PIECES)
    import pyarrow as pa

    texts = pa.array([x or "" for x in ODD])
    counts, digests, *_ = made.block(texts)
    made.apart = False
    made.forget()
    again, same, *_ = made.block(texts)
    assert digests == same and all((x == y).all() for x, y in zip(counts, again))


def test_links_of_a_group(spark):
    import pyarrow as pa

    *_, names, times = alignment.Aligner(BYTE_BPE, PIECES).block(pa.array(["antidisestablishmentarianism naïve 日本語", "naïve the the"]))
    groups = spark.createDataFrame(list(zip(names, times.tolist())), "group string, times long")
    links = [tuple(r) for r in alignment.group_links(groups, BYTE_BPE, PIECES).select("group", "times", "a", "b", "n").collect()]
    for g in names:
        left, right = (side.split(",") for side in g.split("|"))
        own = [x for x in links if x[0] == g]
        # as no two tokens of a group end together before its end, its links are a chain
        assert sum(x[4] for x in own) == len(left) + len(right) - 1 and {x[2] for x in own} == {*map(int, left)} and {x[3] for x in own} == {*map(int, right)}
    assert max(len(g) for g in names) > 20 and times.max() == 2
    pairs = alignment.pair_counts(alignment.group_links(groups, BYTE_BPE, PIECES)).collect()
    counts = Counter()
    for _, t, a, b, n in links:
        counts[a, b] += t * n
    assert {(r.a, r.b): (r["count"], r.best) for r in pairs} == {(a, b): (n, max(m for (_, y), m in counts.items() if y == b)) for (a, b), n in counts.items()}


def test_op13(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op13_tokenizer_alignment(spark, SF).select(COLUMNS).collect()), key=str)
    assert got == brute(texts) and sum(r[4] for r in got) > 10_000


@pytest.mark.parametrize("columns", ["doc_id long, text string, block long, code int, codes string", "text string, doc_id long, `a.b` int, `group` string"])
def test_clashing_columns(spark, columns):
    schema = spark.createDataFrame([], columns).schema
    row = tuple({"doc_id": 4, "text": "some text"}.get(f.name, 1 if f.dataType.simpleString() in ("int", "bigint") else "x") for f in schema)
    df = spark.createDataFrame([row], schema)
    assert [tuple(r) for r in alignment.aligned(df, BYTE_BPE, PIECES).select(COLUMNS).collect()] == brute([(4, "some text")])
