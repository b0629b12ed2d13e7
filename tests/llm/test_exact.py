"""Problems 1, 4, 8, 9 and 10 against brute force on small fixtures, with nulls, empties, ties, repeats and clashing columns."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textmill.llm import distinctive_terms as dt
from textmill.llm import leaks, site_lines, token_ids
from textmill.llm import visual_form as vf

POSTINGS = "token string, doc_id bigint, frequency bigint, tag_frequencies map<string,bigint>, run_id bigint"


# ---- problem 1 --------------------------------------------------------------------------------------------------------


def postings_rows():
    r = random.Random(1)
    rows = []
    for doc in range(60):
        for t in {"the", *(f"w{r.randint(0, 40)}" for _ in range(8))}:
            rows.append((t, doc, None, {"h1": r.randint(0, 2), "other": r.randint(0, 9)}, 0))
            if r.random() < 0.1:
                rows += [(t, doc, 1, {"title": r.randint(1, 9)}, 3)] * 2
    return rows + [("", 1, 1, {"h1": 99}, 9), (None, 2, 1, {"h1": 99}, 9), ("solo", 70, 1, {"h1": 50}, 0), ("pair", 71, 1, {"h1": 4}, 0), ("pair", 72, 1, None, 0), ("x", None, 1, {"b": 1}, 0)]


def by_hand(rows):
    best = {}
    for t, d, _, m, run in rows:
        if t and d is not None:
            best[t, d] = max(best.get((t, d), (-1, -1)), (run, sum((m or {}).values())))
    tf = {k: v[1] for k, v in best.items()}
    df = Counter(t for t, _ in tf)
    n = len({d for _, d in tf})
    return tf, df, n


def test_dominant_terms(spark):
    rows = postings_rows()
    tf, df, n = by_hand(rows)
    per_page = defaultdict(list)
    for (t, d), f in tf.items():
        if df[t] >= 2:
            per_page[d].append((f * math.log(n / df[t]), t))
    expected = set()
    for d, ws in per_page.items():
        ws.sort(reverse=True)
        if ws[0][0] > 0 and (len(ws) == 1 or ws[0][0] >= 2 * ws[1][0]):
            expected.add((d, ws[0][1]))
    table = spark.createDataFrame(rows, POSTINGS).withColumn("df", F.lit("clash")).withColumn("weight", F.lit(1)).withColumn("tf", F.lit(2))
    assert {tuple(x) for x in dt.dominant_terms(table).collect()} == expected
    assert (71, "pair") in expected and not any(d == 70 for d, _ in expected)
    assert dt.dominant_terms(table.limit(0)).count() == 0


def test_log_likelihood_ratio(spark):
    rows = postings_rows()
    tf, df, _ = by_hand(rows)
    docs, tokens = Counter(), Counter()
    for (t, d), f in tf.items():
        docs[d] += f
        tokens[t] += f
    total = sum(tf.values())
    for x in dt.score_terms(spark.createDataFrame(rows, POSTINGS)).collect():
        a = tf[x.token, x.doc_id]
        cells = ((a, docs[x.doc_id], tokens[x.token]), (docs[x.doc_id] - a, docs[x.doc_id], total - tokens[x.token]), (tokens[x.token] - a, total - docs[x.doc_id], tokens[x.token]), (total - docs[x.doc_id] - tokens[x.token] + a, total - docs[x.doc_id], total - tokens[x.token]))
        g2 = 2 * sum(k * math.log(k * total / (r * c)) for k, r, c in cells if k)
        assert abs(abs(x.llr) - g2) < 1e-6 and df[x.token] == x.df >= 2


# ---- problem 4 --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("url", "site"),
    [("http://WWW.A.example:8080/x", "a.example"), ("HTTPS://b.a.example?q", "b.a.example"), ("//c.example./", "c.example"), ("http://u:p@d.example/", "d.example"), ("", None), (None, None), ("nonsense", None), ("http://www.www.e.test", "www.e.test")],
)
def test_site(spark, url, site):
    assert spark.createDataFrame([(url,)], "url string").select(site_lines.site_of(F.col("url")).alias("s")).first().s == site


def line_form(line):
    return re.sub(r"[^\W\d_]+|(.)", lambda m: " " if m.group(1) else m.group(0), line.lower(), flags=re.S).split()


def site_pages():
    r = random.Random(2)
    rows = []
    for p in range(300):
        site = "hot.example" if p % 3 else f"s{p % 9}.example"
        lines = [f"unique line {p} {chr(97 + p % 26) * 5} {r.random()}"]
        if r.random() < 0.5:
            lines += [r.choice(("Legal  notice, 1999!", "LEGAL notice 2024", "  legal-notice"))]
        if r.random() < 0.18:
            lines += ["rare"]
        lines += ["***", "12 34"]
        r.shuffle(lines)
        rows.append((p << 14, f"http://www.{site}/{p}", "\n".join(lines) + "\r"))
    rows += [rows[0], rows[1]] + [(10**7 + i, "http://few.example/", "same\nsame") for i in range(4)] + [(10**7 + 9, None, "same"), (None, "http://few.example/", "same"), (10**7 + 10, "http://hot.example", None), (10**7 + 11, "http://hot.example", "")]
    return rows


def test_repeated_lines(spark):
    rows = site_pages()
    pages, lines, numbered = defaultdict(set), defaultdict(set), []
    for p, url, content in rows:
        if p is None or url is None:
            continue
        site = url.lower().split("//")[1].split("/")[0].removeprefix("www.")
        pages[site].add(p)
        for n, line in enumerate((content or "").split("\n") if content is not None else [], 1):
            form = " ".join(line_form(line))
            if form:
                lines[site, form].add(p)
                numbered.append((p, n, site, form))
    expected = {(p, n) for p, n, s, f in numbered if len(lines[s, f]) >= 4 and 5 * len(lines[s, f]) >= len(pages[s])}
    df = spark.createDataFrame(rows, "page_id bigint, url string, content string").withColumn("site", F.lit("clash")).withColumn("forms", F.lit(0))
    assert {tuple(x) for x in site_lines.repeated_line_numbers(df).collect()} == expected and len(expected) > 50
    clean = {x.page_id: x for x in site_lines.without_repeated_lines(df.where("page_id IS NOT NULL")).collect()}
    for p, _, content in rows:
        if p is not None and content is not None:
            assert clean[p].content == "\n".join(x for n, x in enumerate(content.split("\n"), 1) if (p, n) not in expected)
    assert site_lines.repeated_line_numbers(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [4095, 4096, 4097])
def test_containers_at_the_edge_of_density(n):
    values = np.random.default_rng(n).choice(65536, n, replace=False)
    key = np.zeros(n, np.int64)
    (_, packed, sizes) = site_lines.pack((key,), values)
    rows, got = site_lines.unpack(packed)
    assert sizes.tolist() == [n] and got.tolist() == sorted(values.tolist()) and not rows.any()
    halves = [site_lines._emit(*site_lines.pack((k, k, k), v)) for v in (values[:2000], values[1000:]) for k in [np.zeros(len(v), np.int64)]]
    united = pa.Table.from_batches(site_lines._unite(iter(halves)))
    assert united.column("n").to_pylist() == [n] and site_lines.unpack(united.column("pages").combine_chunks())[1].tolist() == sorted(values.tolist())


def test_containers_round_trip():
    r = np.random.default_rng(1)
    values = np.concatenate([r.choice(65536, 9000, False), r.choice(65536, 5, False)])
    key = np.concatenate([np.zeros(9000, np.int64), np.ones(5, np.int64)])
    keys, packed, sizes = site_lines.pack((key,), values)
    assert sizes.tolist() == [9000, 5] and [len(x) for x in packed.to_pylist()] == [8192, 10]
    rows, got = site_lines.unpack(packed)
    assert set(zip(rows.tolist(), got.tolist(), strict=True)) == set(zip(key.tolist(), values.tolist(), strict=True))
    parts = [site_lines._emit([k, k, k], p, s) for k, p, s in (([key2[0]] and (np.array([7]), *site_lines.pack((np.zeros(100, np.int64),), v)[1:]) for v in (r.choice(65536, 100, False) for _ in range(200)) for key2 in [np.array([0])]))]
    whole = set()
    for b in parts:
        whole |= set(site_lines.unpack(b.column(3))[1].tolist())
    united = pa.Table.from_batches(site_lines._unite(iter(parts)))
    assert united.num_rows == 1 and united.column("n")[0].as_py() == len(whole)


# ---- problem 8 --------------------------------------------------------------------------------------------------------


def test_token_ids(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = token_ids.read_ranks(token_ids._read(token_ids.VOCABULARY))
    other = tiktoken.Encoding("x", pat_str=token_ids.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(8)
    texts = [None, "", " ", "\r\n\r\n  x", "<|endoftext|>", "a" * 3000, "$" * 700 + "é" * 50, "日本語のテキスト", "👩‍🔬 ½ ٣"]
    texts += ["".join(r.choice("ab mno$$==--éñ  \n\n日本'stll0123") for _ in range(r.randrange(300))) for _ in range(100)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {x.doc_id: x.ids for x in token_ids.encode_documents(df).collect()}
    assert got == {i: other.encode_ordinary(t or "") for i, t in enumerate(texts)}
    back = {x.doc_id: x.text for x in token_ids.decode_documents(token_ids.encode_documents(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert token_ids.encode_documents(df.limit(0)).count() == 0


def test_transducer_streams_in_constant_memory():
    machine = token_ids.Transducer(token_ids.read_ranks(token_ids._read(token_ids.VOCABULARY)))
    text = ("ab" * 40 + "-=" * 30 + "$" * 50) * 60
    fed, seen = [], []

    def chunks():
        for i in range(0, len(text), 7):
            fed.append(i)
            yield text[i : i + 7].encode()

    lag = 0
    for i in machine.stream(chunks()):
        seen.append(i)
        lag = max(lag, len(fed) * 7 - sum(len(machine.token[t]) for t in seen))
    assert seen == list(machine.stream([text.encode()])) and lag < 12 * machine.reach
    assert "".join(machine.decode(seen)) == text


# ---- problem 9 --------------------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice((3, 11, 12, 13, 40))))) for i in range(40)] + [(90, None), (91, ""), (92, "Ｗ1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (93, items_text := "one two three four five six seven eight nine ten eleven twelve"), (94, items_text), (None, items_text)]
    docs = []
    for d in range(150):
        t = [r.choice(words) for _ in range(r.randint(0, 80))]
        i, text = r.choice([x for x in items if x[1]])
        if r.random() < 0.6:
            w = text.split()
            a = r.randint(0, max(0, len(w) - 12))
            t[len(t) // 2 : len(t) // 2] = w[a : a + r.randint(10, 20)]
        docs.append((d, r.choice((" ", ", ", " - ")).join(t).upper() if r.random() < 0.2 else " ".join(t)))
    docs += [(900, None), (901, ""), (902, "ｗ1 w2 w3\u200b w4 w5 w6\u00a0w7 w8 w9 w10 w11 w12"), (903, "x One, TWO three four five six seven eight nine ten eleven twelve x"), (903, "y"), (None, items_text)]
    form = vf.FormSql()

    def grams(text):
        w = leaks.words(form.of(pa.array([text])).to_pylist()[0])
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    expected = {(d, i) for d, t in docs if t and d is not None for i, x in items if x and i is not None and grams(t) & grams(x)}
    dd = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(0))
    ii = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    assert {tuple(x) for x in leaks.leaked_items(dd, ii).collect()} == expected
    assert {(902, 92), (903, 93), (903, 94)} <= expected and len(expected) > 30
    assert leaks.leaked_items(dd, ii.limit(0)).count() == 0 and leaks.leaked_items(dd.limit(0), ii).count() == 0


def test_leaks_in_blocks_of_items(spark):
    text = " ".join(f"v{i}" for i in range(30))
    items = spark.createDataFrame([(i, " ".join(f"v{j}" for j in range(i, i + 12))) for i in range(7)], "item_id bigint, text string")
    assert leaks.block_tables(items, block_chars=100).count() > 1
    assert leaks.leaked_items(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), items, block_chars=100).count() == 7


# ---- problem 10 -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Ｈｅｌｌｏ　ｗｏｒｌｄ", "Hello world", True), ("cafe\u0301", "café", True), ("a\u200bb\u00adc", "abc", True), ("a\u00a0b\u2009c", "a b c", True), ("соvеr", "cover", True), ("ΑΒΕ", "ABE", True), ("ｶﾞ", "ガ", True), ("ё", "ë", True), ("Ή", "Η\u0301", True),
        ("Hello", "hello", False), ("café", "cafe", False), ("a b", "a  b", False), ("a\r\nb", "a\nb", False), ("a.b", "a,b", False), ("½", "1/2", False), ("a\tb", "a b", False),
    ],
)
def test_one_form(a, b, same):
    x, y = vf.FormSql().of(pa.array([a, b])).to_pylist()
    assert (x == y) is same


def test_one_form_is_stable():
    texts = ["".join(chr(c) for c in range(s, s + 200) if not 0xD800 <= c < 0xE000) for s in range(0x20, 0x3000, 200)] + ["", None]
    once = vf.FormSql().of(pa.array(texts))
    assert vf.FormSql().of(once).to_pylist() == once.to_pylist()
    assert all(t is None or unicodedata.is_normalized("NFC", t) for t in once.to_pylist())


def test_look_alike_pairs(spark):
    rows = [(1, "Hello"), (2, "Ｈello"), (3, "Hello"), (4, "Hel\u200blo"), (5, "hello"), (6, None), (7, ""), (8, "１２"), (9, "12"), (10, "other"), (10, "other"), (11, "Ｈello")]
    rows += [(100 + i, "copied everywhere") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("form", F.lit("clash"))
    form = vf.FormSql()
    f = {d: (t, form.of(pa.array([t])).to_pylist()[0]) for d, t in rows}
    expected = {(a, b) for a in f for b in f if a < b and f[a][0] is not None and f[b][0] is not None and f[a][0] != f[b][0] and f[a][1] == f[b][1] and any(c.isalpha() for c in f[a][1])}
    assert {tuple(x) for x in vf.look_alike_pairs(df).collect()} == expected and (1, 2) in expected and (2, 11) not in expected
    classes = {x.doc_id: x.class_id for x in vf.form_classes(df).collect()}
    assert classes[4] == 1 and classes[149] == 100 and 6 not in classes
    assert vf.look_alike_pairs(df.limit(0)).count() == 0
