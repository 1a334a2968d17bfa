from __future__ import annotations

import hashlib
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, rows
from pyspark.sql import functions as F

from sluice.llm import chat, neighbours, quality, urls
from sluice.llm.queries import OP3_SQL, PATTERN, PROBE, RANKS, RULES, op2_url_filter, op3_chat_formatting, op4_permutation_index, op8_quality_classifier

SF = f"{DATA}/sf0.001"


# Quality classifier


def test_statistics():
    x = quality.text_statistics(pa.array(["", None, "A b\nb b!\nA b\n", "é9 " * 3, " ", "x" * 100_000]))
    named = [dict(zip(quality.NAMES, r)) for r in x]
    assert not x[0].any() and not x[1].any() and np.isfinite(x).all()
    a = named[2]
    assert (a["log_words"], a["log_bytes"]) == (np.log1p(6), np.log1p(13)) and a["upper"] == 2 / 33 and a["symbol"] == 1 / 33
    assert a["same_as_previous"] == 1 / 11 and a["top_word"] == 2 / 11 and a["repeated_lines"] == 1 / 9 and a["ends_in_symbol"] == 1 / 11
    assert a["distinct_words"] == 3 / np.sqrt(6) and named[3]["beyond_ascii"] == 6 / 32 and named[3]["digit"] == 3 / 32


def test_pooling():
    y, n = np.array([1.0, 0, 4, 2, 5]), np.array([2.0, 1, 5, 4, 5])
    got = quality._pooled(y, n)
    assert np.allclose(got, [1 / 3, 1 / 3, 6 / 9, 6 / 9, 1.0]) and (np.diff(got) >= 0).all()
    assert len(quality._pooled(y[:0], n[:0])) == 0


def test_normal_equations_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/sf0.01/labels.parquet")
    stats = quality.with_statistics(docs.select("doc_id", "text"))
    a, b = quality.trained(stats.repartition(1), labels), quality.trained(stats.repartition(7), labels)
    assert np.allclose(a.weights, b.weights, atol=1e-6)
    x = np.array([r.stats for r in stats.limit(50).collect()])
    z = quality.features(x, a.mean, a.scale)
    assert z.shape == (50, quality.FEATURES + 1)
    d = (np.clip((x[0] - a.mean) / a.scale, -6, 6) - np.clip((x[1] - a.mean) / a.scale, -6, 6)) ** 2
    assert abs(z[0, :-1] @ z[1, :-1] - np.exp(-d.sum() / 2 / len(d))) < 0.25  # the kernel


def test_held_out_accuracy(spark):
    got = op8_quality_classifier(spark, f"{DATA}/sf0.01").join(spark.read.parquet(f"{DATA}/sf0.01/labels.parquet"), "doc_id")
    held = got.where("held_out").toPandas()
    assert len(held) > 80 and ((held.score >= 0) & (held.score <= 1)).all() and (held.predicted == (held.score >= 0.5)).all()
    assert (held.predicted == held.quality).mean() > 0.95


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x y"), (4, "!! !! !!")], "doc_id long, text string").withColumn("stats", F.lit(0))
    labels = spark.createDataFrame([(1, 1), (1, 1), (3, 0), (4, None), (None, 1), (5, 2)], "doc_id long, quality int")
    for some in (labels, labels.where("false"), labels.where("quality = 1")):
        got = quality.quality_scores(docs, some).collect()
        assert len(got) == 6 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert rows(quality.quality_scores(docs.where("false"), labels)) == []
    kept = quality.keep_good(docs.withColumn("score", F.lit("own")), labels.where("quality = 1"))
    assert kept.columns == ["doc_id", "text", "stats", "score"] and kept.first().score == "own"


def test_held_out_labels_are_not_learned_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.fold() == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.quality_scores(docs, x).orderBy("doc_id").toPandas() for x in (labels, turned))
    assert np.allclose(a.score, b.score, atol=1e-9)


# URL filter

URLS = ["https://A.Example.ORG/en/12?x=1", "http://example.org/es/", "https://org/", "https://org", "http://x.com/fr/#t", "http://com/de/a", "http://xcom/de/", "ftp://u:p@h.net:80/a?b#c", "no scheme", "", None, "://", "http://EXAMPLE.org/es/a://b.com/de/", "http://İ.org/é?q", "http://a.org/" + "x/1" * 30_000, "http://h\n.com/fr/\nx"]


def by_rules(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        rest = re.split("[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, slash, tail = rest.partition("/")
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + tail
    best = None
    for r in RULES:
        name, _, tail = r.pattern.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(r.pattern) > len(best.pattern)):
            best = r
    return host, path, best and best.pattern, best and best.verdict


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS)] + [(1, URLS[1], "again")], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.with_rules(pages, RULES).collect()}
    assert got == {i: by_rules(u) for i, u in enumerate(URLS)}


def test_judged(spark):
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 3)], "page_id long, url string, label string")
    got = urls.judged(pages, RULES).collect()
    assert len(got) == len(URLS) * 3 and {r.label for r in got} == {"clash"}
    for r in got:
        assert r.verdict in ("allow", "block") and (r.rule is None or r.verdict == by_rules(r.url)[3])
    for some, verdict in ((pages.where("false"), "allow"), (spark.createDataFrame([("http://a.b/", "block")], "url string, verdict string"), "block")):
        alone = urls.judged(pages, RULES, labelled=some.select("url", F.lit(verdict).alias("verdict")))
        assert {r.verdict for r in alone.where("rule is null").collect()} == {verdict}
    assert rows(urls.judged(pages.where("false"), RULES)) == []


def test_trees_learn_from_labels(spark):
    rng = np.random.default_rng(2)
    data = [(f"http://{'a' * int(rng.integers(3, 9))}.example.{t}/p/{'9' * int(n)}", "block" if n > 6 else "allow") for t in ("com", "net") for n in rng.integers(0, 14, 150)]
    labelled = spark.createDataFrame(data, "url string, verdict string")
    fresh = spark.createDataFrame([(i, f"http://bbbb.example.net/p/{'9' * i}") for i in range(14)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urls.judged(fresh, [], labelled).collect()}
    assert sum(got[i] == ("block" if i > 6 else "allow") for i in range(14)) >= 13


@pytest.mark.parametrize("broadcast", [0, 20_000])
def test_suffix_shares_cover_all_labelled_urls(spark, monkeypatch, broadcast):
    monkeypatch.setattr(urls, "MAX_TRAINING", 20)
    monkeypatch.setattr(urls, "BROADCAST", broadcast)
    data = [(f"http://x.h{i % 40}.t{i % 7}/{i}", "block" if i % 40 < 15 else "allow") for i in range(400)]
    labelled = spark.createDataFrame(data, "url string, verdict string").withColumns({"host": urls.host_of(), "path": urls.path_of()})
    model = urls.UrlModel(labelled)
    for name, of in (("suffix_1", lambda i: f"t{i % 7}"), ("suffix_2", lambda i: f"h{i % 40}.t{i % 7}"), ("suffix_path", lambda i: f"t{i % 7}/{i}")):
        blocked, n = {}, {}
        for i in range(400):
            n[of(i)] = n.get(of(i), 0) + 1
            blocked[of(i)] = blocked.get(of(i), 0) + (i % 40 < 15)
        got = {r[name]: r[f"{name}_share"] for r in model.statistics[name].collect()}
        assert got == {k: pytest.approx((blocked[k] + urls.PRIOR * 0.375) / (n[k] + urls.PRIOR)) for k in n}
    assert model.verdicts(labelled, "found").where("found in ('allow', 'block')").count() == 400


def test_clashing_columns(spark):
    names = ["judged", "__found", "features", "prediction", "fold", "label", "__judged", "suffix_1", "own", "a.b"]
    pages = spark.createDataFrame([(i, u, *["mine"] * len(names)) for i, u in enumerate(URLS * 4)], ", ".join(f"`{c}` {t}" for c, t in [("page_id", "long"), ("url", "string"), *((c, "string") for c in names)]))
    got = urls.judged(pages, RULES)
    assert got.columns == [*pages.columns, "host", "path", "rule", "verdict"] and {tuple(r)[2:12] for r in got.collect()} == {("mine",) * len(names)}


def test_shares_leave_the_own_fold_out(spark):
    """Labels by chance: nothing can be learned from shares that do not hold a URL's own label."""
    rng = np.random.default_rng(3)
    data = [(f"http://h{i}.net/{'ab'[int(rng.integers(2))]}/p", "allow" if rng.integers(2) else "block") for i in range(2_000)]
    labelled = spark.createDataFrame(data, "url string, verdict string").withColumns({"host": urls.host_of(), "path": urls.path_of()})
    found, base = urls.UrlModel(labelled).held_out_accuracy()
    assert abs(found - 0.5) < 0.1 and base < 0.6
    pages = urls.with_rules(spark.read.parquet(f"{DATA}/sf0.01/pages.parquet"), RULES)
    model = urls.UrlModel(pages)
    if model.constant is None:
        found, base = model.held_out_accuracy()
        print("held out", found, base)
        assert found >= base - 0.05


def test_features(spark):
    df = urls.with_features(urls.with_rules(spark.createDataFrame([("http://a-b.c.org/x/y?p=1&q=2&&#f",), (None,), ("aab",)], "url string"), RULES))
    a, none, plain = df.collect()
    assert (a.depth, a.parameters, a.hyphens, a.host_labels, a.has_fragment, a.suffix_1, a.suffix_2, a.suffix_path) == (2, 2, 1, 3, 1, "org", "c.org", "org/x")
    assert none.entropy == 0 and none.length == 0 and abs(plain.entropy - 0.9182958) < 1e-6


def test_url_query(spark):
    got = op2_url_filter(spark, SF).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = by_rules(pages[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)


# Chat formatting


@pytest.mark.parametrize("text", ["", "\\", "\\\\", "<turn>", "</turn>\\", "\\<says>", "<\\turn>", "<<turn>>", PROBE[1], "é🎉<|endoftext|>"])
def test_escapes(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(m in escaped for m in chat.MARKS)


TURNS = [
    (1, 0, "user", "hi <turn>"), (1, 1, "assistant", "a\\</turn>b"), (1, 2, "assistant", ""), (1, 3, "assistant", "é🎉"), (2, 0, None, None), (3, 1, "assistant", "second"), (3, 0, "system<says>", "first"),
    (None, 0, "user", "lost"), (4, 0, "assistant", "y" * 200_000), (5, 0, "user", "same"), (5, 0, "user", "same"), (5, None, "assistant", "before"),
]


def test_conversations(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash")).repartition(3)
    formatted = chat.format_conversations(df, RANKS, PATTERN)
    got = {r.conv_id: r for r in chat.read_conversations(formatted, RANKS, PATTERN).collect()}
    for conv in {t[0] for t in TURNS}:
        turns = [(r or "", t or "") for c, _, r, t in sorted((x for x in TURNS if x[0] == conv), key=lambda x: -1 if x[1] is None else x[1])]
        learned = "".join(t for r, t in turns if r == "assistant")
        text = "".join(f"<turn>{chat.escape(r)}<says>{chat.escape(t)}</turn>" for r, t in turns)
        want = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text))
        assert tuple(got[conv])[1:6] == want
    parts = formatted.orderBy("conv_id", "position").collect()
    start = {}
    for r in parts:
        assert r.token_start == start.get(r.conv_id, 0) and len(r.ids) == len(r.loss_mask)
        start[r.conv_id] = r.token_start + len(r.ids)
    assert rows(chat.read_conversations(chat.format_conversations(df.where("false"), RANKS, PATTERN), RANKS, PATTERN)) == []


def test_chat_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    df = op3_chat_formatting(spark, SF)
    found = con.execute(OP3_SQL)
    assert rows(df.select(*(d[0] for d in found.description))) == sorted(found.fetchall(), key=str)


# Nearest neighbours


def exact(data, k, every):
    out = []
    for q, v in data:
        if q is not None and q % every == 0:
            score = sorted((-float(np.dot(np.array(v, float), np.array(w, float))), i) for i, w in data if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score[:k])]
    return sorted(out)


def found(spark, data, k, every=20, kind="array<float>"):
    df = spark.createDataFrame(data, f"vec_id long, embedding {kind}").withColumn("score", F.lit("clash")).repartition(3)
    return sorted(tuple(r) for r in neighbours.nearest(df, k, every).collect())


def close(a, b):
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b], atol=1e-12)


def test_small_tables_are_exact_with_ties_and_copies(spark):
    rng = np.random.default_rng(4)
    data = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(150)]
    data = [(i, v) for i, v in data if any(v)]
    odd = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [float("nan")] * 4), (204, [float("inf"), 0.0, 0.0, 0.0]), (205, []), (220, [1.0]), (None, [1.0] * 4)]
    copies = [(300 + i, [1.0, 1.0, -1.0, 0.0]) for i in range(60)]
    close(found(spark, data + odd + copies + data[:5], 7), exact(data + copies, 7, 20))
    assert found(spark, data[:1], 5) == [] and found(spark, [], 5) == [] and found(spark, odd, 5) == []
    close(found(spark, data[:4], 20), exact(data[:4], 20, 20))
    assert found(spark, [(0, [-0.0, 1.0]), (1, [0.0, 1.0])], 3) == [(0, 1, 1, 1.0)]


def recall(got, x, every, k=20):
    hits = []
    for q in range(0, len(x), every):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        mine = [r for r in got if r[0] == q]
        assert [r[1] for r in mine] == list(range(1, k + 1)) and all(a[3] >= b[3] for a, b in zip(mine, mine[1:]))
        hits.append(len({r[2] for r in mine} & set(np.argsort(-score)[:k].tolist())) / k)
    return np.mean(hits), min(hits)


@pytest.mark.parametrize("kind", ["unit", "dense third", "lengths", "large", "small"])
def test_recall_follows_the_data(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "RERANKED", 256)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3_000, 64))
    if kind == "dense third":
        x[::3] = x[1] + 0.1 * x[::3]
    x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "lengths":
        x *= np.exp(rng.normal(scale=0.3, size=len(x)))[:, None]
    x *= {"large": 1e20, "small": 1e-30}.get(kind, 1)
    mean, least = recall(found(spark, [(i, v.tolist()) for i, v in enumerate(x)], 20, 50, "array<double>"), x, 50)
    assert mean >= 0.9 and least >= 0.5


def test_no_query_lacks_neighbours(spark, monkeypatch):
    """Files that hold next to nothing: who finds too few in them is compared with all."""
    for name, n in (("POSTED", 1), ("OPENED", 1), ("RECALL", 0.0), ("RECALL_EACH", 0.0)):
        monkeypatch.setattr(neighbours, name, n)
    rng = np.random.default_rng(3)
    data = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    close(found(spark, data, 20, 20, "array<double>"), exact(data, 20, 20))
    huge = [(i, (rng.normal(size=8) * 1e300).tolist()) for i in range(40)]
    assert len(found(spark, huge, 5, 20, "array<double>")) == 10


def shuffled(spark) -> int:
    """Rows that all stages so far have written for shuffles."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    new = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, new, context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_postings_stay_in_their_tasks(spark):
    """75 queries find over 1,400 of 1,500 vectors each in their files; what is shuffled follows the input nevertheless."""
    rng = np.random.default_rng(5)
    before, data = shuffled(spark), [(i, rng.normal(size=16).tolist()) for i in range(1_500)]
    close(found(spark, data, 20, 20, "array<double>"), exact(data, 20, 20))
    assert shuffled(spark) - before < 20 * len(data)


def test_shards_and_blocks_of_any_size(spark, monkeypatch):
    for name, n in (("SHARD_ROWS", 37), ("BLOCK_ROWS", 3), ("BLOCKS", 5)):
        monkeypatch.setattr(neighbours, name, n)
    rng = np.random.default_rng(6)
    data = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(500)]
    data = [(i, v) for i, v in data if any(v)]
    close(found(spark, data, 20), exact(data, 20, 20))


@pytest.mark.parametrize("kind", ["single", "underflow", "overflow"])
def test_best_of_shards(monkeypatch, kind):
    """Files opened and ranked as the footrule says; the nearest by the product in double precision, ties to the smaller id, whatever stands in which shard."""
    monkeypatch.setattr(neighbours, "PAIRS", 50)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 8)) * {"underflow": 1e-170, "overflow": 1e160}.get(kind, 1)
    x = x.astype(np.float32) if kind == "single" else x
    x[100:120] = x[:20]
    top = np.abs(x).max().astype(float)
    held = neighbours.Pivots(x[:40].astype(float), top, np.sqrt(((x / top) ** 2).sum(1).max()))
    best, whole = (neighbours.Best(np.arange(30), x[:30], 7, held) for _ in range(2))
    wanted, near = held.nearest(x[:30], 12, queries=True), held.nearest(x, 5, queries=False)
    for i in range(0, 300, 110):
        own, part = near[i : i + 110], x[i : i + 110]
        order = np.argsort(own.ravel(), kind="stable")
        first = np.searchsorted(own.ravel()[order], np.arange(41)).astype(np.int32)
        of, at = np.divmod(order, 5)
        names = np.arange(i, i + len(part))
        shard = neighbours.Shard(neighbours._row(neighbours.SHARD, names, 1_000 - names, part, of.astype(np.uint16), at.astype(np.uint8), first), 0, x.dtype)
        for w in wanted:
            saved = [sum(13 - abs(a - w.tolist().index(p)) for a, p in enumerate(mine) if p in w) for mine in own.tolist()]
            want = sorted((n for n in range(len(part)) if saved[n]), key=lambda n: (-saved[n], n))
            assert sorted(shard.ranked(w, 20).tolist()) == sorted(want[:20])
            who, key = shard.found(w)
            assert who[np.argsort(-key)].tolist() == want
        best.search(shard, 110, wanted)
        whole.search(shard, 0, None)
    for b, looks in ((best, lambda q, n: set(near[n].tolist()) & set(wanted[q].tolist())), (whole, lambda q, n: True)):
        for q in range(30):
            with np.errstate(over="ignore", invalid="ignore"):
                product = [float(np.add.accumulate(x[q].astype(float) * v.astype(float))[-1]) for v in x]
            want = sorted((n for n in range(300) if looks(q, n)), key=lambda n: (product[n] != product[n], -product[n] if product[n] == product[n] else 0, -n))[:7]
            mine = b.rows[0] == q
            assert b.rows[3][mine].tolist() == want and np.array_equal(-b.rows[1][mine], [product[n] for n in want], equal_nan=True)
            assert b.rows[2][mine].tolist() == [1_000 - n for n in want]


def test_greatest_columns_in_order():
    rng = np.random.default_rng(9)
    for near in (rng.normal(size=(20, 500)), rng.normal(size=(20, 5_000)), rng.integers(0, 40, (20, 3_000)).astype(float), np.zeros((5, 4_000))):
        for n in (1, 7, 40):
            got = neighbours.greatest(near, n)
            assert np.array_equal(np.take_along_axis(near, got, 1), -np.sort(-near, axis=1)[:, :n]) and all(len(set(r)) == n for r in got.tolist())
    assert neighbours.greatest(rng.normal(size=(3, 6)), 6).shape == (3, 6)


def test_neighbour_query_finds_the_nearest(spark):
    """Through the files, with production parameters."""
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got, want = rows_of(op4_permutation_index(spark, SF)), exact(data, 20, 20)
    scores = {(q, i): s for q, _, i, s in exact(data, len(data), 20)}
    assert len(got) == len(want) and all(abs(s - scores[q, i]) < 1e-12 for q, _, i, s in got)
    assert len({(r[0], r[2]) for r in got} & {(r[0], r[2]) for r in want}) >= 0.9 * len(want)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("letter,n", [*((x, n) for x in " y7." for n in (1_000_000, 5_000_000)), (" ", 50_000_000)])
def test_long_runs_are_encoded(letter, n):
    c = chat.codec(RANKS, PATTERN)
    text = letter * n
    assert c.text(c.segments([text])[text]) == chat.escape(text)


def test_long_texts_have_the_ids_of_the_whole(monkeypatch):
    monkeypatch.setattr(chat, "LONG_RUN", 10)
    c = chat.codec(RANKS, PATTERN)
    rng = np.random.default_rng(9)
    texts = ["".join(rng.choice(list("aZé9.' \n\t漢s,"), rng.integers(11, 80), p=[0.06] * 6 + [0.2, 0.2] + [0.06] * 4)) for _ in range(3_000)] + ["it's   \n\n  x" * 9, " " * 30 + "x", "x" + " " * 30, "\n" * 20 + "a"]
    for t, ids in c.segments(texts).items():
        assert ids.tolist() == c.encoding.encode_ordinary(chat.escape(t))


def test_a_conversation_of_white_space(spark):
    turns = [(1, 0, "user", " " * 1_000_000), (1, 1, "assistant", "\n" * 1_200_000 + "x")]
    formatted = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"), RANKS, PATTERN)
    got = chat.read_conversations(formatted, RANKS, PATTERN).first()
    assert got.loss_sha256 == hashlib.sha256(turns[1][3].encode()).hexdigest() and got.n_turns == 2
