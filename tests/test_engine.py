"""The search engine on micro-fixtures with answers worked out by hand, and its invariants."""

import hashlib
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textmill.functions.html import text_nodes
from textmill.functions.text import TAG_WEIGHTS, TAGS, hamming, is_strange, raw_terms, safe_name, similarity, tokens
from textmill.operators import postings as po
from textmill.operators import search as se
from textmill.operators import simhash as sh
from textmill.operators import words as wo
from textmill.plans.engine import NO_SUMMARY, Engine
from textmill.sources import index_store as store
from textmill.sources.index_store import IndexOptions, size_kb
from textmill.sources.json_pages import bad_files, catalogue, first_urls, read_pages, read_zipped_pages

PAGES = [
    (1, "a/1", "http://x/1", "<title>Spark engine</title><h1>Spark</h1><p>fast <b>engine</b> engine</p>"),
    (2, "a/2", "http://x/2", "<p>spark spark spark data</p>"),
    (3, "a/3", "http://x/3", "<h1>data <a>engine</a></h1><p>data</p>"),
    (4, "a/4", "http://x/4", "<title>data data</title><p><b>data data</b> fast</p>"),
]
SCHEMA = "doc_id bigint, path string, url string, content string"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    return Engine.build(spark, spark.createDataFrame(PAGES, SCHEMA), str(tmp_path_factory.mktemp("index")))


def ranking(df):
    return [(r.doc_id, round(r.tfidf, 6), round(r.cosine, 6)) for r in df.orderBy("query_id", "rank").collect()]


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("spark engine", [(1, 1.386294, 0.944911)]),
        ("spark", [(2, 0.708377, 0.948683), (1, 0.693147, 0.534522)]),
        ("data", [(4, 0.382400, 0.970143), (3, 0.287682, 0.894427), (2, 0.287682, 0.316228)]),
        ("data data fast", [(4, 1.075547, 0.976187)]),
        ("fast", [(1, 0.693147, 0.267261), (4, 0.693147, 0.242536)]),
        ("missing", []),
        ("", []),
    ],
)
def test_search(engine, query, expected):
    assert ranking(engine.search(query)) == expected


def test_tag_counts(spark):
    rows = {(r.doc_id, r.token): {t: r[f"f_{t}"] for t in TAGS if r[f"f_{t}"]} for r in po.tag_frequencies(spark.createDataFrame(PAGES, SCHEMA), "doc_id").collect()}
    assert rows[1, "spark"] == {"title": 1, "h1": 1}
    assert rows[1, "engine"] == {"title": 1, "b": 1, "other": 1}
    assert rows[3, "engine"] == {"other": 1}  # nested text isn't the heading's own
    assert rows[4, "data"] == {"title": 2, "b": 2}


def test_engine_api(engine, spark):
    assert engine.page_count == 4 and engine.name == "index"
    assert {r.token: r.df for r in engine.document_frequencies().collect()} == {"spark": 2, "engine": 2, "fast": 2, "data": 3}
    assert engine.lookup("missing").count() == 0
    with pytest.raises(TypeError):
        engine.lookup(3)
    assert engine.url_of(2).first().url == "http://x/2" and engine.path_of(3).first().path == "a/3"
    assert engine.id_of_url("http://x/4").first().doc_id == 4 and engine.id_of_path("a/1").first().doc_id == 1
    assert engine.id_of_url("nowhere").count() == 0
    entry = engine.items().where("token = 'data'").first()
    assert entry.df == 3 and [(p.doc_id, p.frequency) for p in entry.postings] == [(2, 1), (3, 2), (4, 4)]
    stats = engine.statistics().first()
    assert (stats.n_docs, stats.n_tokens, stats.n_postings) == (4, 4, 9)
    assert size_kb(spark, engine.path).first().files >= 1
    assert engine.summary(1, spark.createDataFrame(PAGES, SCHEMA)) == NO_SUMMARY


def test_reload_changes_nothing(engine, spark):
    again = Engine(spark, engine.path)
    assert again.page_count == engine.page_count
    assert ranking(again.search("data")) == ranking(engine.search("data"))


def test_lookup_is_pushed_down(engine):
    plan = engine.lookup("data")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(token" in plan or "PushedFilters: [IsNotNull(token), EqualTo(token,data)]" in plan


def test_extended_index(engine, spark, tmp_path):
    more = spark.createDataFrame([(5, "a/5", "http://x/5", "<p>spark data</p>"), (6, "a/6", None, None)], SCHEMA)
    bigger = engine.extended(more, str(tmp_path / "i"))
    assert bigger.page_count == 5
    assert {r.token: r.df for r in bigger.document_frequencies().collect()}["spark"] == 3
    bigger.drop()
    assert not (tmp_path / "i").exists()


def test_batch_equals_single(engine, spark):
    texts = ["spark engine", "data", "fast", "missing", "data data fast"]
    rows = engine.search(spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")).collect()
    for q, text in enumerate(texts):
        assert sorted((r.doc_id, round(r.tfidf, 9)) for r in rows if r.query_id == q) == sorted((r.doc_id, round(r.tfidf, 9)) for r in engine.search(text).collect())


def test_lemmatized_index(spark, tmp_path):
    pages = spark.createDataFrame([(1, "p", "u1", "<p>dog runs</p>"), (2, "q", "u2", "<p>dogs bark</p>")], SCHEMA)
    e = Engine.build(spark, pages, str(tmp_path / "l"), IndexOptions(lemmatize=True))
    assert {r.doc_id for r in e.search("dogs").collect()} == {1, 2}
    assert e.search("dogs", mode="strict").count() == 0  # the surface form itself isn't indexed


def test_extended_index_keeps_its_options(spark, tmp_path):
    def same(rows, split, options, name):
        old, more = (spark.createDataFrame(x, SCHEMA) for x in (rows[:split], rows[split:]))
        got = Engine.build(spark, old, str(tmp_path / f"{name}o"), options).extended(more, str(tmp_path / f"{name}e"))
        whole = Engine.build(spark, old.unionByName(more), str(tmp_path / f"{name}w"), options)
        for t in ("postings", "vectors", "documents"):
            a, b = getattr(got, t), getattr(whole, t)
            assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
        assert got.page_count == whole.page_count
        return got

    texts = ["<p>old queries of horses and <b>horse</b>", "<p>a query", "<h1>queries</h1> again hors", "<p>other"]
    lemmas = same([(i, f"p{i}", f"http://x/{i}", t) for i, t in enumerate(texts)], 1, IndexOptions(lemmatize=True), "l")
    for q in ("query", "queries"):
        assert {r.doc_id for r in lemmas.search(q).collect()} == {0, 1, 2}
    long = " ".join(f"word{i}" for i in range(400))
    texts = {5: long + " one", 6: long + " two", 7: "something else", 3: "new page", 8: long + " three", 9: "new page", 10: "something else", 11: None}
    near = same([(i, f"p{i}", f"http://x/{i}", t) for i, t in texts.items()], 3, IndexOptions(drop_near_duplicates=True), "n")
    assert {r.doc_id for r in near.documents.collect()} == {5, 7, 3}


def test_near_duplicates_are_left_out(spark, tmp_path):
    rows = [(1, "p", "u1", "alpha beta gamma"), (2, "q", "u2", "alpha beta gamma"), (3, "r", "u3", "other words here"), (4, "s", "u4", None)]
    e = Engine.build(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path / "d"), IndexOptions(drop_near_duplicates=True))
    assert e.page_count == 2


def test_pages_and_counts(engine, spark):
    ranked = spark.range(12).select(F.lit(0).alias("query_id"), (F.col("id") + 1).alias("rank"))
    assert se.page(ranked, 3).count() == 2 and se.page(ranked, 4).count() == 0
    with pytest.raises(ValueError):
        se.page(ranked, 0)
    c = se.counts(spark.range(60).select(F.lit(1).alias("query_id"))).first()
    assert (c.n_matched, c.n_ranked, c.pages) == (60, 50, 10)


def test_scalar_functions(spark):
    def one(column):
        return spark.range(1).select(column.alias("v")).first().v

    assert one(tokens(F.lit("abc٣def ½ x²y ñandú 12"))) == ["abc٣def", "x", "y", "and", "12"]
    assert one(tokens(F.lit("C++ end."))) == ["c", "end"] and one(tokens(F.lit(None).cast("string"))) == []
    assert one(raw_terms(F.lit(" To be  OR to be "))) == ["to", "be", "or"]
    assert [one(is_strange(F.lit(w))) for w in ("queue", "aaa", "rhythms", "$$$", "spark")] == [True, True, True, True, False]
    assert one(similarity(F.lit(6))) == 0.953125 and one(similarity(F.lit(7))) == 0.9453125
    assert one(hamming([F.lit(5), F.lit(0)], [F.lit(6), F.lit(1)])) == 3
    assert one(safe_name(F.lit('a<b>:"/\\|?*c'))) == "a_b________c"
    assert abs(sum(TAG_WEIGHTS.values()) - 1) < 1e-12


def simhash_by_hand(text):
    import re

    votes = [0] * 128
    words = [w.lower() for w in re.findall(r"[a-zA-Z\d]+", text)]
    for w, n in Counter(words).items():
        h = int(hashlib.md5(w.encode("ascii", "replace")).hexdigest(), 16)
        for j in range(128):
            votes[j] += n if h >> j & 1 else -n
    return sum(1 << j for j in range(128) if votes[j] > 0) if words else None


def test_simhash_and_banding_against_brute_force(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base if k % 2 else r.sample(base, 60)) + " extra" * (k % 3) + f" x{k % 5}" for k in range(40)] + ["", None, "ñ ½", "same text", "same text"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    hashes = sh.simhashes(docs, "doc_id", "text")
    got = {h.doc_id: None if h.w0 is None else h.w0 | h.w1 << 32 | h.w2 << 64 | h.w3 << 96 for h in hashes.collect()}
    assert got == {i: simhash_by_hand(t or "") for i, t in enumerate(texts)}
    firsts = {}
    for i, h in got.items():
        if h is not None:
            firsts[h] = min(i, firsts.get(h, i))
    expected = {(a, b, bin(x ^ y).count("1")) for x, a in firsts.items() for y, b in firsts.items() if a < b and bin(x ^ y).count("1") <= 6}
    assert {tuple(p) for p in sh.near_class_pairs(sh.classes(hashes)).collect()} == expected
    kept = {i for i, h in got.items() if h is None or not any(j < i and g is not None and bin(h ^ g).count("1") <= 6 for j, g in got.items())}
    assert {k.doc_id for k in sh.kept(hashes).collect()} == kept


def test_no_near_pair_is_missed_by_blocks(spark):
    r = random.Random(9)
    rows, expected = [], set()
    for k in range(200):
        h = r.getrandbits(128)
        g = h
        for bit in r.sample(range(128), 6):
            g ^= 1 << bit
        for i, x in ((2 * k, h), (2 * k + 1, g)):
            rows.append((i, *((x >> 32 * w) & 0xFFFFFFFF for w in range(4))))
        expected.add((2 * k, 2 * k + 1))
    hashes = spark.createDataFrame(rows, "doc_id bigint, w0 bigint, w1 bigint, w2 bigint, w3 bigint")
    assert {(p.id_a, p.id_b) for p in sh.near_class_pairs(sh.classes(hashes)).collect()} >= expected


def test_html_rules():
    assert text_nodes("<h1>a <a>b</a></h1>") == [("h1", "a "), ("a", "b")]
    assert text_nodes("<p><b>x<br>y<p>z") == [("b", "x"), ("b", "y"), ("p", "z")]
    assert text_nodes("<script>var a = '<p>no</p>'</script><!-- no --><style>p{}</style>t&amp;u") == [("", "t&u")]
    assert text_nodes("<ul><li>a<li>b</ul>c</p><b") == [("li", "a"), ("li", "b"), ("", "c")]
    assert text_nodes("") == []


def test_residuals_are_never_negative(spark):
    counted = po.tag_frequencies(spark.createDataFrame([(1, "<b>a<title>a</b></title><h1>a<h1>a"), (2, None)], "page_id bigint, content string"))
    assert po.bad_residuals(counted).count() == 0
    assert counted.where(sum(F.col(f"f_{t}") for t in TAGS) != F.col("tf")).count() == 0


def test_words(spark):
    vocabulary = spark.createDataFrame([(w,) for w in ("dog", "dogs", "glass", "bus", "ponies", "pony", "leaf", "leaves", "men", "man", "has")], "token string")
    lemmas = {r.token: r.lemma for r in wo.lemma_map(vocabulary).collect()}
    assert lemmas == {"dog": "dog", "dogs": "dog", "glass": "glass", "bus": "bus", "ponies": "pony", "pony": "pony", "leaf": "leaf", "leaves": "leaf", "men": "man", "man": "man", "has": "has"}
    dfs = spark.createDataFrame([("query", 5), ("quest", 9), ("index", 1)], "token string, df bigint")
    assert {r.word: r.corrected for r in wo.corrected(spark.createDataFrame([("qury",), ("indx",), ("zzzzzzz",)], "word string"), dfs).collect()} == {"qury": "query", "indx": "index"}


def test_json_pages(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    for name, text in (("b.json", json.dumps({"url": "u", "content": "<p>x</p>", "encoding": "utf-8"})), ("d/a.json", json.dumps({"url": "u", "content": "y"})), ("d/e/c.json", '{"url": "broken"'), ("d/n.json", json.dumps({"url": "v"})), ("skip.txt", "{}")):
        (tmp_path / name).write_text(text)
    pages = catalogue(read_pages(spark, str(tmp_path)))
    rows = {r.path.rsplit("/", 1)[1]: r for r in pages.collect()}
    assert sorted(r.doc_id for r in rows.values()) == [1, 2, 3, 4]
    assert rows["c.json"].bad and rows["c.json"].content is None and not rows["n.json"].bad
    assert [r.path for r in sorted(rows.values(), key=lambda r: r.doc_id)] == sorted(r.path for r in rows.values())
    assert tuple(bad_files(read_pages(spark, str(tmp_path))).first()) == (4, 1, 1)
    assert {(r.url, r.doc_id) for r in first_urls(pages).collect()} == {("u", rows["b.json"].doc_id), ("v", rows["n.json"].doc_id)}


def test_zipped_pages(spark, tmp_path):
    import zipfile

    (tmp_path / "d").mkdir()
    with zipfile.ZipFile(tmp_path / "d/a.zip", "w") as z:
        for name, text in (("x/1.json", '{"url": "u", "content": "é"}'), ("2.json", "[1]"), ("3.json", "no"), ("4.txt", "{}"), ("5.json", '{"url": 7}')):
            z.writestr(name, text)
    (tmp_path / "b.zip").write_bytes(b"no archive")
    rows = {r.path.rsplit("/", 1)[1]: r for r in read_zipped_pages(spark, str(tmp_path)).collect()}
    assert {k: r.bad for k, r in rows.items()} == {"1.json": False, "2.json": True, "3.json": True, "5.json": False, "b.zip": True}
    assert (rows["1.json"].url, rows["1.json"].content, rows["5.json"].url) == ("u", "é", "7") and rows["1.json"].path.endswith("d/a.zip!/x/1.json")
    assert catalogue(read_zipped_pages(spark, str(tmp_path))).count() == 5


def test_partition_count_does_not_matter(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c c") for i in range(30)], "doc_id bigint, text string")
    results = set()
    for n in (1, 2, 8):
        results.add(tuple(sorted((r.token, r.df) for r in po.document_frequencies(po.word_frequencies(docs.repartition(n))).collect())))
    assert len(results) == 1 and dict(next(iter(results)))["a"] == 30


def test_index_rows(spark):
    rows = [("t", 1, 3, {"h1": 1, "other": 2}, 0), ("t", 1, None, {"h1": 5}, 2), ("t", 1, None, {"h1": 5}, 2), ("", 1, 1, {"b": 1}, 0), (None, 2, 1, {"b": 1}, 0), ("u", 2, 1, None, 0)]
    df = spark.createDataFrame(rows, "token string, doc_id bigint, frequency bigint, tag_frequencies map<string,bigint>, run_id bigint")
    assert {(r.token, r.doc_id, r.f_h1, r.f_other, r.tf) for r in po.indexed_postings(df).collect()} == {("t", 1, 5, 0, 5), ("u", 2, 0, 0, 0)}
    assert po.indexed_postings(df.limit(0)).count() == 0
    assert {(r.token, r.run_id) for r in po.stale_frequencies(df).collect()} == {("t", 2), ("u", 0)}


def test_idf_and_score_equal_the_literal_sum(engine):
    row = engine.postings.where("token = 'data' AND doc_id = 4").first()
    idf = math.log(4 / 3)
    literal = sum(TAG_WEIGHTS[t] * (1 + (math.log(row[f"f_{t}"]) if row[f"f_{t}"] > 0 else 0)) * idf for t in TAGS)
    assert abs(literal - engine.search("data").where("doc_id = 4").first().tfidf) < 1e-12


def test_streaming_ingest(spark, tmp_path):
    from textmill.streaming.ingest import ingest, page_stream, without_copies

    schema = "page_id bigint, content string, loaded_at timestamp"
    pages = spark.createDataFrame([(1, "<p>a b</p>"), (2, "<p>a b</p>"), (3, None)], "page_id bigint, content string").withColumn("loaded_at", F.lit("2024-01-01").cast("timestamp"))
    pages.write.parquet(str(tmp_path / "in"))
    ingest(without_copies(page_stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("token").count().count() == 2


def test_catalogue_keeps_every_large_page(spark):
    pages = spark.range(20_000).select(F.concat(F.lit("p/"), F.sha2(F.col("id").cast("string"), 256)).alias("path"), F.repeat(F.lit("x"), 39_000).alias("content"), F.lit(1).alias("_n")).repartition(16)
    rows = catalogue(pages).select("doc_id", "path", F.length("content").alias("n")).collect()
    assert [r.path for r in sorted(rows, key=lambda r: r.doc_id)] == sorted(r.path for r in rows)
    assert sorted(r.doc_id for r in rows) == list(range(1, 20_001)) and {r.n for r in rows} == {39_000}
    assert catalogue(pages.limit(0)).count() == 0
    twice = spark.createDataFrame([("b", "1"), ("a", "2"), ("b", "3"), (None, "4")], "path string, content string")
    assert sorted((r.doc_id, r.content) for r in catalogue(twice).collect()) == [(1, "2"), (2, "1"), (2, "3")]


def test_a_new_build_leaves_what_is_read_alone(spark, tmp_path):
    path = str(tmp_path / "i")
    old = Engine.build(spark, spark.createDataFrame(PAGES[:2], SCHEMA), path)
    new = old.extended(spark.createDataFrame(PAGES[2:], SCHEMA), path)  # onto its own path
    assert (old.page_count, new.page_count) == (2, 4) and old.postings.count() < new.postings.count()
    assert len(store.builds(spark, path)) == 2 and Engine(spark, path).page_count == 4
    (tmp_path / "i/build-99999999999999999999-x/postings").mkdir(parents=True)  # one that never ended
    assert Engine(spark, path).page_count == 4
    store.prune(spark, path)
    assert len(store.builds(spark, path)) == 1 and Engine(spark, path).lookup("data").count() == 3
    assert Engine.build(spark, spark.createDataFrame(PAGES[:1], SCHEMA), path, load_existing=True).page_count == 4
    assert Engine.build(spark, spark.createDataFrame(PAGES[:1], SCHEMA), str(tmp_path / "none"), load_existing=True).page_count == 1
    with pytest.raises(FileNotFoundError):
        Engine(spark, str(tmp_path / "nowhere"))


def test_index_without_files(spark, tmp_path, engine):
    e = Engine.build(spark, spark.createDataFrame(PAGES, SCHEMA), str(tmp_path / "i"), persist=False)
    assert not (tmp_path / "i").exists() and ranking(e.search("data")) == ranking(engine.search("data"))
    assert e.extended(spark.createDataFrame([(5, "a/5", "u", "data")], SCHEMA), None).page_count == 5
    e.drop()


def test_search_with_spelling_and_paths(engine, spark):
    got = engine.search("sparkk enginne", spellcheck=True).collect()
    assert [(r.doc_id, r.url, r.path) for r in got] == [(1, "http://x/1", "a/1")]
    assert engine.search("sparkk enginne").count() == 0
    assert engine.search("spark zzzzzzzz", spellcheck=True).count() == 2  # strange and unknown: left out
    assert engine.search("spark unfindable", spellcheck=True).count() == 0  # unknown and no candidate: kept


def test_lemmas_of_a_lexicon(spark, tmp_path):
    pages = spark.createDataFrame([(1, "p", "u1", "<p>dogs run"), (2, "q", "u2", "<p>cats run, a cat")], SCHEMA)
    lexicon = spark.createDataFrame([("dog",)], "token string")
    e = Engine.build(spark, pages, str(tmp_path / "l"), IndexOptions(lemmatize=True), lexicon=lexicon)
    assert {r.token for r in e.tokens().collect()} == {"dog", "run", "cats", "a", "cat"}


def test_statistics_of_stored_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"p{i}", f"u{i}", f"t{i:03} shared") for i in range(200)], SCHEMA)
    e = Engine.build(spark, docs, str(tmp_path / "s"), IndexOptions(target_rows=30, plain_text=True))
    files = e.partition_statistics().orderBy("partition").collect()
    assert len(files) > 4 and sum(f.postings for f in files) == 400 and [f.partition for f in files] == list(range(1, len(files) + 1))
    assert all(a.last_token <= b.first_token for a, b in zip(files, files[1:])) and files[0].first_token == "shared"


def test_spelling_against_all_pairs(spark):
    r = random.Random(4)
    words = {"".join(r.choice("abc") for _ in range(r.randint(1, 7))) for _ in range(150)}
    asked = list(words)[:40] + ["", "zz", "é"]
    dfs = spark.createDataFrame([(w, len(w)) for w in words], "token string, df bigint")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    expected = {(a, b, edits(a, b)) for a in asked if a for b in words if edits(a, b) <= 2}
    got = wo.spelling_candidates(spark.createDataFrame([(w,) for w in asked] + [(None,)], "word string"), dfs).collect()
    assert {(g.word, g.candidate, g.distance) for g in got} == expected and len(got) == len(expected)


def test_search_with_more_terms_than_a_filter_takes(spark, engine, monkeypatch):
    queries = spark.createDataFrame([(0, "spark engine"), (1, "data fast"), (2, "none")], "query_id int, text string")
    few = sorted(map(str, engine.search(queries).collect()))
    monkeypatch.setattr(se, "FEW_TERMS", 1)
    assert sorted(map(str, engine.search(queries).collect())) == few and len(few) == 2


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace as N

    from textmill.session import ensure_checkpoint_dir

    none = N(isDefined=lambda: False)
    session = N(sparkContext=N(_jsc=N(sc=lambda: N(getCheckpointDir=lambda: none)), master="spark://host:7077", getConf=lambda: N(get=lambda *_: None)))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(session)
