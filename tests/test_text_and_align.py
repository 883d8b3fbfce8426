import datetime as dt
import hashlib
import math

from pyspark.sql import functions as F

from varve.functions import dates, text, urls
from varve.operators import align, lm, metrics, sketch

PROSE = "The river Ardent rose by 12.5 metres in March 2019, and Captain Mira Holst moved the archive uphill before the water came through the lower gate of the town. "


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_renderings_are_equal(spark):
    html = f"<html><head><title>T</title></head><body><nav>Home | About | Contact</nav><script>var a=1</script><p>{PROSE}</p><p>Copyright 2020</p></body></html>"
    rows = spark.createDataFrame([(1, PROSE), (2, html), (3, "> " + PROSE.replace(" the ", "  the ")), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in text.normalise(rows).collect()}
    assert got[1].sha256 == got[2].sha256 == got[3].sha256 and got[4].flat == "" and got[4].tokens == []
    assert got[1].numerals == ["12.5", "2019"] and "Captain Mira Holst" in got[1].entities and got[2].dropped_lines == 2


def test_tokens_and_cjk(spark):
    assert one(spark, "don't stop 42 東京都 x", text.tokens) == ["don't", "stop", "42", "東京", "京都", "x"]


def test_entities_are_decoded(spark):
    assert one(spark, "a &amp;&#233;&lt;b&gt;", text.unescape) == "a &é<b>"


def test_shingles_and_windows(spark):
    row = spark.createDataFrame([(["a", "b", "c"], list(map(str, range(200))))], "s array<string>, l array<string>")
    got = row.select(sketch.word_shingles(F.col("s")).alias("s"), F.size(sketch.word_shingles(F.col("l"))).alias("n"), sketch.windows(F.col("l")).alias("w")).first()
    assert got.s == ["a b c"] and got.n == 196 and [(w.start, w.end) for w in got.w] == [(0, 128), (64, 192), (72, 200)]
    assert one(spark, "ab cdefg", sketch.char_shingles) == ["abcde", "bcdef", "cdefg"] and one(spark, "", sketch.char_shingles) == [] and one(spark, "ab", sketch.char_shingles) == ["ab"]


def test_minhash_paths_agree(spark):
    rows = spark.createDataFrame([(1, [5, 9, 77]), (2, []), (3, [123456789])], "doc_id bigint, h array<bigint>")
    got = sketch.minhash(rows, "h", "m", 16).withColumn("sql", sketch.minhash_sql(F.col("h"), 16)).collect()
    assert all(r.m == r.sql for r in got) and got[1].m == [sketch.PRIME] * 16
    a, b = sketch.coefficients(16, 1)
    assert got[0].m == [min((h * x + y) % sketch.PRIME for h in (5, 9, 77)) for x, y in zip(a, b)]


def test_longest_run_may_repeat():
    assert align.longest_run([1, 1, 2, 0, 3]) == 4 and align.longest_run([]) == 0 and align.longest_run([3, 2, 1]) == 1


def test_ancestor_is_found(spark):
    base = [f"{w}{i % 17}" for i, w in enumerate(("orchard bridge lantern harvest kettle museum violin winter canyon ribbon " * 20).split())]
    copy, other = list(base), [f"zeta{i * 7 % 101}" for i in range(200)]
    copy[50] = "changed"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(other))], "doc_id bigint, text string")
    p = sketch.fingerprints(text.normalise(docs))
    archive = p.where("doc_id <> 2").withColumn("not_after", F.lit(dt.datetime(2015, 1, 1)))
    got = align.oldest_ancestor(align.matches(p.where("doc_id = 2"), archive)).collect()
    assert [(r.doc_id, r.r_id, r.relation) for r in got] == [(2, 1, "near_dup")]


def test_urls(spark):
    assert one(spark, "https://www.Ex.com/a/b/?utm_source=x&b=2&a=1#top", urls.normalise) == "//ex.com/a/b?a=1&b=2"
    assert one(spark, "http://ex.com", urls.normalise) == "//ex.com/" and one(spark, "https://arxiv.org/abs/1706.03762v5", urls.arxiv_id) == "1706.03762"
    assert one(spark, "https://ex.com/x", urls.doi) is None


def test_dates(spark):
    for value, want in (("20190304050607", (2019, 3, 4, 5, 6, 7)), ("2019", (2019, 1, 1)), ("201903", (2019, 3, 1)), ("2019-03-04T05:06:07Z", (2019, 3, 4, 5, 6, 7)), ("March 4, 2019", (2019, 3, 4)), ("4 Mar 2019", (2019, 3, 4)), ("soon", None)):
        assert one(spark, value, dates.to_timestamp) == (dt.datetime(*want) if want else None), value


def test_claims(spark):
    docs = spark.createDataFrame([(1, '<meta name="date" content="2011-05-06">x'), (2, "Published on May 6, 2011\nx"), (3, "nothing"), (4, '<script type="application/ld+json">{"datePublished": "2012-01-02"}</script>'), (6, '{"datePublished": "2012-01-02"}'), (5, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.surface, r.claimed.date().isoformat()) for r in dates.claims(docs).collect())
    assert got == [(1, "meta", "2011-05-06"), (2, "prose", "2011-05-06"), (4, "jsonld", "2012-01-02")]


def test_auc_counts_ties_as_half(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "p double, label int")
    assert metrics.auc(df).first().auc == (0.5 + 1 + 1 + 1) / 4
    assert metrics.auc(df.where("label = 1")).first().auc is None


def test_backoff(spark):
    docs = spark.createDataFrame([(1, "a b a b"), (2, "a c")], "doc_id bigint, text string")
    model = lm.fit(docs, 2)
    got = {(r.doc_id, r.pos): r.logp for r in lm.log_probabilities(spark.createDataFrame([(7, "b c z")], "doc_id bigint, text string"), model, 5, 2).collect()}
    assert abs(got[7, 2] - (math.log(2 / 8) + math.log(0.4))) < 1e-9 and abs(got[7, 3] - (math.log(1 / 8) + math.log(0.4))) < 1e-9
    assert abs(got[7, 4] - (math.log(1 / 1000) + 2 * math.log(0.4))) < 1e-9


def test_md5_hash(spark):
    assert one(spark, "x", sketch.hash28) == int(hashlib.md5(b"x").hexdigest()[:7], 16)


def test_fingerprints_equal_their_definitions(spark):
    long = " ".join(f"word{i * i % 97} Größe{i % 13} 東京{i % 7}" for i in range(150))
    docs = spark.createDataFrame([(1, long), (2, PROSE), (3, "ab"), (4, None), (5, long + " end")], "doc_id bigint, text string")
    normal = text.normalise(docs)
    prints = sketch.fingerprints(normal)
    char = normal.select("doc_id", F.transform(F.array_distinct(sketch.char_shingles(F.col("flat"))), sketch.hash28).alias("h"))
    word = normal.select("doc_id", F.transform(F.array_distinct(sketch.word_shingles(F.col("tokens"))), sketch.hash28).alias("h"))
    got = {r.doc_id: r for r in prints.collect()}
    for rows, c in ((char, "char"), (word, "word")):
        for r in sketch.minhash(rows, "h", "m").collect():
            assert got[r.doc_id][f"m_{c}"] == r.m and got[r.doc_id][f"n_{c}"] == len(r.h), (r.doc_id, c)
    windows = {}
    for r in sorted(sketch.window_sketches(prints).collect(), key=lambda r: (r.doc_id, r.idx)):
        windows.setdefault(r.doc_id, []).extend(r.minhash)
    assert {k: r.w for k, r in got.items()} == {k: windows.get(k, []) for k in got} and len(got[1].w) > 3 * sketch.WINDOW_SLOTS


def test_searches_keep_no_table_in_memory_and_ask_every_twentieth(spark, tmp_path):
    from varve.plans import queries

    rows = [(i, " ".join(f"w{(i % 40) * 1000 + j}x" for j in range(60)), "en", "s", 1) for i in range(80)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.ancestor_match(spark, str(tmp_path))
    assert sorted((r.doc_id, r.r_id, r.relation) for r in got.collect()) == [(40, 0, "identical"), (60, 20, "identical")]
    both = queries.channel_containment(spark, str(tmp_path)).where("same").collect()
    assert sorted((r.q_id, r.r_id) for r in both) == [(0, 40), (20, 60), (40, 0), (60, 20)]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_own_detectability_equals_the_general_way(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 7)
    rows = [(1, "a b a b c a b"), (2, "a c  b a\tb a b"), (3, None), (4, ""), (5, " ".join(["x y"] * 40)), (6, "one two three four five six"), (7, "a b c d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3, "doc_id")
    want = {r.doc_id: r for r in lm.detectability(lm.log_probabilities(docs, lm.fit(docs, 2), lm.vocabulary_size(docs, 2), 2)).collect()}
    got = {r.doc_id: r for r in lm.own_detectability(docs).collect()}
    assert set(got) == set(want) == {1, 2, 5, 6}
    assert all(got[k].n == r.n and abs(got[k].logloss - r.logloss) < 1e-9 and abs(got[k].burstiness - r.burstiness) < 1e-6 for k, r in want.items())


def test_benchmark_items_are_found_with_small_batches(spark, tmp_path):
    from varve.plans import queries

    words = [f"w{j}x" for j in range(60)]
    docs = [(1, " ".join(f"v{j}y" for j in range(80))), (2, " ".join(words))]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    got = queries.benchmark_passages(spark, str(tmp_path)).collect()
    assert [(r.item_id, r.doc_id, r.relation) for r in got] == [(7, 2, "identical")]
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 512
