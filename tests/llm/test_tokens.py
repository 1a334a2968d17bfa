from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import common, pieces, tokens
from sluice.llm.queries import PIECES, WORD_BPE, op1_token_counts, op7_sentencepiece, op9_token_files

ODD = ["", " ", "\n\t", "İstanbul ΣΑΣ ς", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>", "don't 's it's,", "12.5, x9", "é́ ﬁ 漢字 🎉🎉", "x" * 300_000, "a b　c", "ÀÉ!! (ok).", "...", "word " * 50_000]
rng = random.Random(3)
ODD += ["".join(rng.choice("aZÉé .,!?'s9ß\n🎉Σσ́ -▁") for _ in range(rng.randrange(60))) for _ in range(500)]


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, t) for i, t in enumerate(ODD)] + [(7, "again"), (7, "again"), (None, "no id"), (900, None)]
    return spark.createDataFrame(data, "doc_id long, text string").withColumn("n_tokens", F.lit("clash")).repartition(5)


def whole(texts):
    return [e.ids for e in Tokenizer.from_file(WORD_BPE).encode_batch(texts, add_special_tokens=False)]


def test_words_apart_are_the_whole():
    ids, at = tokens.WordEncoder(WORD_BPE).encode(pa.array(ODD))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == whole(ODD)


def test_few_words_are_remembered(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 5)
    e = tokens.WordEncoder(WORD_BPE)
    for t in ODD[-60:]:
        assert e.encode(pa.array([t]))[0].tolist() == whole([t])[0]
    assert len(e.words.now) + len(e.words.before) < 100


def test_forms_of_a_word_are_encoded_once(monkeypatch):
    e, asked = tokens.WordEncoder(WORD_BPE), []
    stems = e._stems
    monkeypatch.setattr(e, "_stems", lambda new: asked.extend(new) or stems(new))
    texts = ["Blorple blorple, BLORPLE!? blorple", "\x01 a\x01b \x01", "漢字 x9 \u3000z don't", "blorple. Élan élan;"]
    ids, at = e.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == whole(texts)
    assert sorted(asked) == ["blorple", "élan"]
    words = [w for t in ODD[-300:] for w in t.split()] + ["\x01", "<|endoftext|>"]
    assert e._whole(words) == whole(words) and e._whole(words[:-2]) == whole(words[:-2])


def test_small_batches_are_encoded_together():
    batches = [pa.RecordBatch.from_arrays([pa.array(["x" * 100] * n)], ["text"]) for n in (3, 0, 5, 1, 400)]
    parts = list(common.joined(iter(batches), 5_000))
    assert sum(p.num_rows for p in parts) == 409 and parts[0].num_rows == 9
    assert max(p.nbytes for p in parts) < 6_000 and list(common.joined(iter([]), 5)) == []


def test_histogram(spark, docs):
    sizes = np.array([len(x) for x in whole([r.text or "" for r in docs.collect()])])
    sums = tokens.with_suffix_sums(tokens.length_histogram(docs, WORD_BPE), block=4)
    for r in sums.collect():
        assert r.n_docs == (sizes == r.n_tokens).sum() and r.docs_at_least == (sizes >= r.n_tokens).sum()
        assert r.tokens_at_least == sizes[sizes >= r.n_tokens].sum() and r.truncated_tokens == np.minimum(sizes, r.n_tokens).sum()
        assert abs(r.quantile - (sizes <= r.n_tokens).mean()) < 1e-12 and (r.total_docs, r.total_tokens) == (len(sizes), sizes.sum())
    for limit in (0, 1, 7, 10**7):
        assert tuple(tokens.at_limit(sums, limit).first()) == (len(sizes), (sizes > limit).sum(), np.minimum(sizes, limit).sum())
    assert tokens.length_quantile(sums, 0.5).first()[0] == np.sort(sizes)[-(-len(sizes) // 2) - 1]
    none = tokens.with_suffix_sums(tokens.length_histogram(docs.where("false"), WORD_BPE))
    assert rows(none) == [] and tuple(tokens.at_limit(none, 5).first()) == (0, 0, 0) and tokens.length_quantile(none, 0.5).first()[0] is None


def test_files(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    tokens.write_ids(docs, path, WORD_BPE, 1)
    got = tokens.read_ids(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([r.doc_id for r in docs.collect()], key=lambda d: -1 if d is None else d)
    start = 0
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, set()).add(tuple([*whole([r.text or ""])[0], 1]))
    for r in got:
        assert r.start == start and tuple(r.ids) in texts[r.doc_id] and r.n_tokens == len(r.ids)
        start += r.n_tokens
    assert tokens.read_ids(spark, path).where("doc_id = 7").count() == 3
    crc = tokens.with_crc32(tokens.read_ids(spark, path))
    assert {r.start: r.ids_crc32 for r in crc.collect()} == {r.start: zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    tokens.write_ids(docs.where("false"), path + "0", WORD_BPE, 1)
    assert rows(tokens.with_crc32(tokens.read_ids(spark, path + "0"))) == []


def test_pieces_against_the_library(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    read = pieces.decoded(pieces.encoded(docs.withColumn("own", F.col("text")), PIECES), PIECES)
    assert dict(read.dtypes)["n_tokens"] == "bigint"
    got = read.collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.ids == sp.encode(r.own or "") and r.n_tokens == len(r.ids)
        assert r.text == (r.own or "").replace("▁", " ") == sp.decode(r.ids)
    assert all(r.parity for r in got)
    verified = pieces.encoded(docs, PIECES, verify=True)
    assert verified.where("round_trip").count() == len(got) and "text" not in verified.columns
    assert rows(pieces.encoded(docs.where("false"), PIECES)) == []


def test_ids_are_the_rebuilt_tokenizers(monkeypatch):
    """Whatever the library that verifies says, ids are right, and parity tells."""
    texts = ["Hello world.", "  two  spaces ", "naïve 漢字 🎉\n", " " * 70 + "x", "", "a▁b ", "y" * 5_000]
    monkeypatch.setattr(common, "_kept", {})
    c = pieces.codec(PIECES)
    want = c.check.encode(texts)
    monkeypatch.setattr(c, "_check", lambda rows: [[5] for _ in rows])
    ids, at, same, back = c.encode(pa.array(texts))
    assert back.all() and [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want and same.tolist() == [not t for t in texts]
    assert c.decode(ids, at) == [t.replace("▁", " ") for t in texts]


def test_runs_of_spaces_agree_with_the_library():
    c = pieces.PieceCodec(PIECES)
    texts = [a + " " * n + b for n in range(1, 200) for a in ("", "a") for b in ("", "b")] + [" " * 100_000]
    ids, at, same, back = c.encode(pa.array(texts))
    assert same.all() and back.all() and [ids[a:b].tolist() for a, b in zip(at, at[1:])] == c.check.encode(texts)


def test_parity_of_the_rebuilt_tokenizer():
    import sentencepiece

    with open(PIECES, "rb") as f:
        model = pieces.PieceModel(f.read())
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert model.plain() and model.byte_fallback and len(model.pieces) == sp.vocab_size()
    assert [p for p, _, _ in model.pieces[:5]] == [sp.id_to_piece(i) for i in range(5)]
    rebuilt = model.tokenizer()
    texts = ["Hello world.", "  two  spaces ", "naïve 漢字 🎉\n", "<s> </s>", "a▁b"]
    assert [e.ids for e in rebuilt.encode_batch(texts, add_special_tokens=False)] == sp.encode(texts)
    assert [rebuilt.decode(x) for x in sp.encode(texts)] == sp.decode(sp.encode(texts))


def test_unigram_models_are_rebuilt():
    def message(*fields):
        out = b""
        for n, v in fields:
            if isinstance(v, int):
                out += bytes([n << 3, v])
            elif isinstance(v, float):
                import struct

                out += bytes([n << 3 | 5]) + struct.pack("<f", v)
            else:
                out += bytes([n << 3 | 2, len(v)]) + v
        return out

    vocabulary = [("<unk>", 0.0, 2), ("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("▁ab", -1.0, 1), ("ab", -3.5, 1)]
    data = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in vocabulary)
    model = pieces.PieceModel(data + message((2, message((3, 1)))) + message((3, message((3, 1), (4, 0)))))
    assert model.kind == pieces.UNIGRAM
    t = model.tokenizer()
    assert t.encode("ab b", add_special_tokens=False).tokens == ["▁ab", "▁", "b"]
    assert t.decode(t.encode("ab b").ids) == "ab b"


SF = f"{DATA}/sf0.001"


def test_queries(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    ids = [[*x, 1] for x in whole([d.text for d in docs])]
    got = op9_token_files(spark, SF).orderBy("doc_id").collect()
    starts = np.cumsum([0, *map(len, ids)])
    assert [tuple(r) for r in got] == [(d.doc_id, s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, s, x in zip(docs, starts, ids)]
    sums = op1_token_counts(spark, SF)
    assert sums.agg(F.sum("n_docs")).first()[0] == len(docs) and sums.first().total_tokens == starts[-1] - len(docs)
    assert op7_sentencepiece(spark, SF).where("parity and round_trip").count() == len(docs)
    assert public_tokenizers.path("word_bpe_49k.json")


def test_a_task_drops_the_tables_that_it_has_not_used(monkeypatch):
    """As a worker has it: the function of the tasks comes pickled, the tables are the module's own."""
    from pyspark import cloudpickle

    sent = []

    class Docs:
        class sparkSession:  # noqa: N801
            conf = {}

        def mapInArrow(self, run, schema):  # noqa: N802
            sent.append(cloudpickle.loads(cloudpickle.dumps(run)))

    monkeypatch.setattr(common, "_kept", {"of another operator": 1})
    common.mapped(Docs(), lambda batches: (common.kept("own", list) and b or b for b in batches), "x int")
    for _ in range(2):
        assert list(sent[0](iter([1, 2]))) == [1, 2] and list(common._kept) == ["own"]


def test_pieces_at_a_time(spark, monkeypatch):
    """The bytes that are encoded at a time change no result."""
    texts = ["Hello world.", "  two  spaces ", "naïve 漢字 🎉\n", " " * 70 + "x", "", None, "a▁b ", "y" * 5_000] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted(pieces.encoded(docs, PIECES, verify=True, most=64).collect()) == sorted(pieces.encoded(docs, PIECES, verify=True).collect())
