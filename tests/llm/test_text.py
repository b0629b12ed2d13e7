"""Problems 2, 3, 5 and 7: small cases with known answers, held-out accuracy, nulls, empties, repeats and clashing columns."""

import html
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import encoding_repair as er
from textmill.llm import main_content as mc
from textmill.llm import markup, residue

PAGES = "page_id bigint, content string"
SENTENCE = "The river opens a garden near the old market, and every letter waits for the winter bridge."


# ---- problem 2 --------------------------------------------------------------------------------------------------------

RESIDUE = [
    "Welcome to {{ term }}, taught by ${instructor} in %(room)s.", "About [office_hours]", "Dear undefined, your essay for null is due on [object Object].", "Office: @@room@@ Phone: %%phone%%", "[TERM]: [DEPT_NAME]", "About &lt;%= title %&gt;", "[INSERT name]: [INSERT room]",
    "Lorem ipsum dolor sit amet consectetur", "text text text text text text", "foo bar foo bar foo bar foo bar", "asdf jkl asd fghj sdkl asdff", "Your text goes here.", "This is a placeholder for the chapter.",
    "Page not found", "Error 404", "HTTP Status 503 - Unavailable", "Seite nicht gefunden", "The file you requested has been removed.", "Fatal error: call to undefined function x() in /srv/a.php on line 3", "at a.B.run(C.java:17)",
    "You need to enable JavaScript to run this app.", "Your browser blocks scripts; nothing can be shown.", "The catalogue depends on client-side scripts.", "Bitte aktivieren Sie JavaScript, um die Seite anzuzeigen.", "Kindly activate scripting to continue.",
]
FINE = [
    "Template engines fill slots such as {{ room }} when the page is built; this lecture explains how.", "In the shell, ${term} expands to the value, while '%s' is left to the router.", "Designers use lorem ipsum as filler; our group studies why that hides problems.",
    'The exam asks why an error message like "page not found" confuses readers.', "The demo at the end needs JavaScript, but all notes can be read without it.", "A server answers 404 when the page is gone.", "The seminar moved to room 12.", "#1 priority: the grant (5 * 3 = 15) [sic]", "See [[Main|here]] and [a](/notes).", SENTENCE,
]


@pytest.mark.parametrize("line", RESIDUE)
def test_residue_is_found(line):
    assert residue.is_residue(f"Site > Menu\n{line}\nCopyright 2020")
    assert residue.is_residue(f"<html><title>x</title><body><p>Menu<div>{line}</div></body></html>")


@pytest.mark.parametrize("line", FINE)
def test_talk_about_residue_is_not(line):
    assert not residue.is_residue(f"Site > Menu\n{line}\nCopyright 2020")
    assert not residue.is_residue(f"<p>{html.escape(line)}</p>")


def test_no_suspect_is_missed_by_the_quick_test():
    r = random.Random(4)
    seeds = residue.Seeds()
    assert residue.is_residue("Site > Menu\nDorsum pharelis veniat vinculet consectum dorsum. Pharelis elitra tempor vinculet labentis.\nCopyright 2020")
    filler, home, known = sorted(residue.FILLER), ["asdf", "jkl", "a", "las", "fall"], sorted(seeds.vocabulary)
    texts = [*RESIDUE, *FINE, *(" ".join([w, w, "river"]) for w in filler)]
    texts += [sep.join(r.choices(words, k=r.randint(1, 12))) for words in (filler, home, known, [*known, "river", "a.b.C", "x7", "12", "client-side", "(", "{{a}}", "no-one's"], ["foo", "bar"], [*filler[:3], "river"]) for sep in (" ", ", ", ". ", "-") for _ in range(150)]
    suspects = 0
    for t in texts:
        suspect = seeds._label(t)[0]
        assert seeds.possible(t) or not suspect, t
        suspects += suspect
    assert suspects > 500


HELD_OUT = [  # wordings of another hand; none is a seed as it stands
    "The document you requested could not be found.", "Sorry, the page you are looking for could not be found", "You do not have permission to open this directory.", "Please enable JavaScript to use this site.", "You need to enable JavaScript to view this website.", "Your browser does not support scripting.",
    "This portal requires JS.", "The system needs JavaScript.", "This app does not work without client-side scripts", "Please activate scripts to continue", "Fatal error: Uncaught Exception in /www/html/a.php on line 77", "Warning: include(/srv/x/y.php): failed to open stream: No such file or directory in /srv/x/index.php on line 3",
    "The resource you asked for is no longer here!", "Your session has expired. Please try again later.", "We cannot find that document any longer.", "Diese Seite existiert leider nicht mehr.", "Pagina non trovata", "Die angeforderte Seite wurde leider nicht gefunden.", "La page demandée n'existe pas.", "%FIRSTNAME%: %LASTNAME%", "{% block content %} {% endblock %}",
    "Checking your browser before accessing the site", "Click to edit this paragraph.", "Your headline goes here", "Insert the description of the course here.", "Quisque ornatum velit, vestibulum nullam dapibus condimentum pellentesque habitant morbi.", "sdfg jklh asdf fdsa", "Dear [NAME], see [DATE_OF_BIRTH]",
    "The web page you requested could not be located.", "Sorry, you do not have permission to view this page", "Your browser does not currently support JavaScript.", "Please do enable JavaScript to continue", "The page which you requested has been removed.",
]


def test_held_out_wordings_and_what_the_hashes_add():
    whole, exact = residue.Seeds(), residue.Seeds(near=-1)
    exact.near = lambda words: words in exact.words  # without the method: only what is a seed as it stands
    found, alone = (sum(s.label(t)[1] for t in HELD_OUT) for s in (whole, exact))
    assert found >= 0.9 * len(HELD_OUT) and alone <= found - 0.25 * len(HELD_OUT), (found, alone, [t for t in HELD_OUT if not whole.label(t)[1]])


def test_labels_run_along_links(spark):
    words = [f"w{i}x" for i in range(40)]
    a, b, c = (" ".join([*words[:i], "other", *words[i:]]) for i in (3, 4, 5))
    far = " ".join(f"v{i}y" for i in range(40))
    rows = [(1, None, 1, [(b"a", a, True)], []), (2, None, 2, [(b"b", b, False)], []), (3, None, 3, [(b"c", c, False), (b"d", far, False)], []), (4, None, 4, [(b"d", far, False)], [])]
    found = spark.createDataFrame(rows, residue._SUSPECTS.format("bigint"))
    assert {bytes(r.id) for r in residue.labelled_segments(found).collect()} == {b"a", b"b", b"c"}


def test_residue_pages(spark):
    menu = [f"the lines of the menu of this one site number {'abcdefghijklmnopqrstuvwxyz'[i]} come again" for i in range(26)] + [f"another line of the same site, called {'abcdefghijklmnopqrstuvwxyz'[i]}, comes again too" for i in range(26)]
    side = "\n".join(menu)
    rows = [(1, "http://a", "Page not found"), (2, "http://a", "The file you requested has been removed."), (4, "http://a", SENTENCE), (5, "http://a", None), (6, None, ""), (1, "http://a", "Page not found"), (7, "http://a", "Some error happened in the kitchen, and nobody knows")]
    rows += [(8, "http://a", "Page not found\n" + SENTENCE * 30), (9, "http://a", "<noscript>Please enable JavaScript.</noscript><p>x")]
    rows += [(20 + i, "http://b/x", side + "\nPage not found") for i in range(3)] + [(30, "http://c/x", side + "\nPage not found"), (31, None, side + "\nPage not found")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, content string").withColumn("segments", F.lit(1)).withColumn("trusted", F.lit("x"))
    assert {r.page_id for r in residue.residue_pages(df).collect()} == {1, 2, 20, 21, 22}  # lines on several such pages of a site are the site's
    assert {r.page_id for r in residue.without_residue(df).collect()} == {4, 5, 6, 7, 8, 9, 30, 31}
    assert residue.residue_pages(df.limit(0)).count() == 0
    assert residue.residue_pages(df, df.select("page_id", "content")).count() >= 5


def test_residue_is_left_out_of_all_tables(spark, tmp_path):
    from textmill.llm.queries import QUERIES

    columns = "page_id bigint, path string, url string, content string"
    pages = [(1, "The file you requested has been removed."), (2, SENTENCE), (3, "Page not found")]
    texts = [(11, "The folder you requested has been removed!"), (12, SENTENCE), (13, "Page not found"), (14, None)]
    for name, rows in (("pages", pages), ("text_pages", texts)):
        spark.createDataFrame([(i, f"p{i}", None, c) for i, c in rows], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    assert {r.page_id for r in QUERIES["p2_found"](spark, str(tmp_path)).collect()} == {1, 3, 11, 13}
    assert {tuple(r) for r in QUERIES["p2_clean"](spark, str(tmp_path)).collect()} == {(2, "p2"), (12, "p12"), (14, "p14")}


def test_simhash_tables_find_all_near_links(spark):
    r = random.Random(2)
    base = [[f"{r.choice('abcdefgh')}{i}{j}" for i in range(25)] for j in range(30)]
    segs = [(" ".join(b), True) for b in base] + [(" ".join([*b[:k], "x", *b[k + 1 :]]), False) for b in base for k in r.sample(range(25), 4)]
    sims = {s: residue.simhash(s) & (1 << 64) - 1 for s, _ in segs}
    distinct = spark.createDataFrame([(s.encode(), s, t) for s, t in segs], "id binary, text string, trusted boolean")
    tables = residue.tabled(distinct)
    got = {(bytes(x.a).decode(), bytes(x.b).decode()) for x in residue.near_links(tables.where("NOT trusted"), tables.where("trusted"), distinct).collect()}

    def common(a, b):
        return len(set(a.split()) & set(b.split())) / max(len(set(a.split())), len(set(b.split())))

    expected = {(a, b) for a, t in segs if not t for b, u in segs if u and bin(sims[a] ^ sims[b]).count("1") <= residue.NEAR and common(a, b) >= residue.SIMILAR}
    assert expected == got and got


# ---- problem 3 --------------------------------------------------------------------------------------------------------


def test_field_on_held_out_pages():
    model, right, total = markup.trained(), 0, 0
    for lines, labels in markup.labelled_pages(200, seed=777):
        where, feats = markup.features(lines)
        got = markup.viterbi(model, feats)
        right += sum(a == labels[i] for a, i in zip(got, where, strict=True))
        total += len(where)
    assert right / total > 0.98


def test_gradient_of_a_padded_batch():
    from itertools import product

    rng = np.random.default_rng(5)
    w, t = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    pages = [([[0, 1], [2], [0, 3]], [0, 2, 1]), ([[1]], [2]), ([[3], [0, 2]], [1, 1])]

    def loss(w, t):
        total = 0.0
        for feats, gold in pages:
            def score(p, feats=feats):
                return sum(w[f].sum(axis=0)[y] for f, y in zip(feats, p, strict=True)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False))

            total += np.log(sum(np.exp(score(p)) for p in product(range(3), repeat=len(feats)))) - score(gold)
        return total

    gw, gt = np.zeros_like(w), np.zeros_like(t)
    markup._add_gradient([(np.concatenate([np.array(f) for f in x]), np.array([len(f) for f in x]), np.array(y)) for x, y in pages], w, t, gw, gt)
    for x, g in ((w, gw), (t, gt)):
        for i in np.ndindex(*x.shape):
            x[i] += 1e-5
            up = loss(w, t)
            x[i] -= 2e-5
            down = loss(w, t)
            x[i] += 1e-5
            assert abs((up - down) / 2e-5 - g[i]) < 1e-4


def test_viterbi_is_the_best_path():
    from itertools import product

    rng = np.random.default_rng(3)
    w, t = rng.normal(size=(len(markup.FEATURES), 6)), rng.normal(size=(6, 6))
    feats = [[0, 3], [5], [1, 2], [7]]
    e = markup._emissions(w, feats)

    def score(p):
        return sum(e[i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:], strict=False))

    assert tuple(markup.viterbi((w, t), feats)) == max(product(range(6), repeat=4), key=score)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("x\n<b>bold</b> word", {"html"}), ("a&nbsp; b", {"html"}), ("# Title\ntext", {"markdown"}), ("Title\n-----", {"markdown"}), ("see [a](/b)", {"markdown"}), ("== Title ==", {"wiki"}), ("x '''bold''' y", {"wiki"}), ("* [[A]] b", {"wiki"}), ("\\section{T}", {"latex"}), ("a $x_i$ b", {"latex"}), ("\\( \\log i \\)", {"latex"}),
        ("<h1>T</h1>\n\\emph{x} y\n# Z", {"html", "latex", "markdown"}), ("```\n<b>x</b>\n$a_i$ = [[c]]\n```", {"markdown"}), ("<pre>\n# include\n**x**\n</pre>", {"html"}), ("\\begin{verbatim}\n<b>x</b>\n\\end{verbatim}", {"latex"}),
        ("#include <a.h>", set()), ("List<Title> items = load(x);", set()), ("C:\\stream\\label", set()), ("Cost: $5 to $72 per x, about 2 > 1.", set()), ("$a = $b + $step;", set()), ("#1 priority: x (5 * 3 = 15) [sic]", set()), ("• item\n1) item\n- item", set()), ("[A > B > C]\n-- x y --\n+++ x y +++", set()),
        ("Welcome to $(COURSE_TITLE), taught by $(x).", set()), ("About {{ room }} [TERM]: [DEPT]", set()), ("a@b.example has a_b_c files", set()), ("a * b * 2\na == b", set()), ("", set()),
    ],
)
def test_notations(text, found):
    assert {markup.LABELS[y] for y in markup.decode(markup.trained(), text.split("\n"))[1]} == found


@pytest.mark.parametrize("line", ["The {\\it river} opens.", "A {\\bf bold} word", "{\\em x}", "see {\\small the note}", "{\\Large Notes}", "one {\\bfseries two} three", "a {\\tt cut"])
def test_switches_are_latex(line):
    lines = ["Plain words stand here.", line, "And here."]
    labels, found = markup.decode(markup.trained(), lines)
    assert {markup.LABELS[y] for y in found} == {"latex"}
    assert "\\" not in (clean := markup.clean(lines, labels)) and "{" not in clean
    assert "The river opens." in markup.clean(["The {\\it river} opens."], [markup.LABELS.index("latex")])
    for plain in ("{\\item", "a {it} slot", "C:\\it\\bf", "{\\italic x}"):
        assert not markup.decode(markup.trained(), [plain])[1]


def test_markup_pages(spark):
    rows = [(1, "# A\r\ntext"), (1, "# A\r\ntext"), (2, "plain"), (3, None), (4, ""), (5, "<ul>\n<li>x &amp; y</li>\n</ul>\n<h2>H</h2>\n<pre>\na &lt; b\n</pre>\n<p>c<sup>2</sup>")]
    df = spark.createDataFrame(rows, PAGES).withColumn("markup", F.lit(1)).withColumn("clean", F.lit(2))
    assert sorted(map(tuple, markup.markup_pages(df).collect())) == [(1, "markdown"), (5, "html")]
    clean = {r.page_id: r.clean for r in markup.clean_pages(df).collect()}
    assert clean[5] == "• x & y\n\nH\n\n    a < b\nc^2" and clean[2] == "plain" and clean[1] == "A\n\ntext"
    assert markup.markup_pages(df.limit(0)).count() == 0


# ---- problem 5 --------------------------------------------------------------------------------------------------------


def site_page(i, layout):
    r = random.Random(i)
    head = f"Story {i} of the river"
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(8))
    body = [f"Sentence {word()} about {word()} and its consequences for {word()}." for _ in range(4)]
    menu, foot = '<li><a href="/a">Home</a></li>', f"&copy; {2000 + i} Site. All the figures of this site belong to nobody."
    side = ["<p>Related</p>", f'<p><a href="/n/{i}">A teaser sentence number {i % 5} that many pages of the site repeat.</a></p>']
    lines = {
        "semantic": ["<header>", "<nav>", menu, "</nav>", "</header>", "<main>", "<article>", "<p>Home &gt; News &gt; x</p>", f"+<h1>{head}</h1>", '<span class="by">By A Writer, 3 May</span>', *(f"+<p>{b}</p>" for b in body), "<ul>", f"+<li>{word()} item with {word()}", "</ul>", "<p>Tell a friend about this page</p>", "</article>", "</main>", "<aside>", *side, "</aside>", "<footer>", f"<p>{foot}</p>", "</footer>"],
        "misleading": ['<div class="main">', menu, "</div>", '<div class="content">', *side, "</div>", '<div class="sidebar">', f"+<h2>{head}</h2>", *(f"+<div>{b}</div>" for b in body), "+<pre><code>x = 1", "+return y &lt; 2", "</code></pre>", "</div>", f'<div class="article">{foot}</div>'],
        "table": ["<table>", f"<tr><td>{menu}</td></tr>", "<tr><td width=20%>", *side, "</td><td>", f"+<b>{head}</b>", *(f"+{b}<br>" for b in body), "</td></tr>", f"<tr><td>{foot}</td></tr>", "</table>"],
        "soup": ["<p>Home | News | Contact", f"+<h1>{head}</h1>", *(f"+<p>{b}" for b in body), "<p>3 people liked this", *side, f"<p>{foot}"],
    }[layout]
    top = ["<!DOCTYPE html>", "<html>", f"<head><title>{head} | Site</title>", '<script>var x = "<p>no</p>";</script>', "</head>", "<body>"]
    lines = [*top, *lines, "</body>", "</html>"]
    return "\n".join(x[1:] if x.startswith("+") else x for x in lines), {n for n, x in enumerate(lines, 1) if x.startswith("+")}


@pytest.mark.parametrize("layout", ["semantic", "misleading", "table", "soup"])
def test_article_lines(layout):
    pages = [site_page(i, layout) for i in range(40)]
    for got, (_, expected) in zip(mc.article_lines([p for p, _ in pages]), pages, strict=True):
        assert set(got) == expected


def test_main_lines(spark, monkeypatch):
    rows, expected = [], set()
    for i in range(60):
        text, lines = site_page(i, ("semantic", "misleading", "table", "soup")[i % 4])
        rows.append((i, f"http://www.h{i % 4}.example/{i}", text))
        expected |= {(i, n) for n in lines}
    rows += [rows[0], (100, None, None), (101, "", ""), (102, "http://h0.example", "<title>x</title>"), (103, "http://h0.example", "<title>Error | Site</title><body><p>Page not found</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, content string").withColumn("host", F.lit(0)).withColumn("shard", F.lit("x"))
    assert {tuple(x) for x in mc.main_lines(df).collect()} == expected
    monkeypatch.setattr(mc, "SHARD_PAGES", 8)  # a host in several shards
    assert {tuple(x) for x in mc.main_lines(df).collect()} == expected
    assert mc.main_lines(df.limit(0)).count() == 0
    text = {r.page_id: r.article for r in mc.main_text(df).collect()}
    assert text[0].startswith("Story 0 of the river\nSentence") and 103 not in text


def test_runs_are_counted_over_all_shards_of_a_host(spark, monkeypatch):
    notice = "<p>A notice of this site that stands on three of its pages."
    body = lambda i: "".join(chr(97 + int(d)) for d in f"{i:04}")
    rows = [(i, "http://h.example/", f"<title>T {body(i)}</title>\n<h1>T {body(i)}</h1>\n<p>Own words of the page {body(i)} stand here.\n" + notice * (i in (3, 170, 411))) for i in range(450)]
    df = spark.createDataFrame([*rows, rows[3]], "page_id bigint, url string, content string")
    expected = {(i, n) for i in range(450) for n in (2, 3)}
    assert {tuple(x) for x in mc.main_lines(df).collect()} == expected
    monkeypatch.setattr(mc, "SHARD_PAGES", 30)
    assert {tuple(x) for x in mc.main_lines(df).collect()} == expected
    two = df.where("page_id <> 411")  # on two pages only, one of them loaded twice
    assert (3, 4) in {tuple(x) for x in mc.main_lines(two).collect()}


def test_residue_pages_have_no_article(spark):
    trusted = "Dear {{ first_name }}, your enrolment number {{ number }} for {{ course_title }} begins on first winter monday"
    near = trusted + " again"  # residue only by a link to a segment of another table
    assert residue.label(trusted) == (True, True) and residue.label(near) == (True, False)
    rows = [(1, "<title>Page not found | Site</title>\n<h1>Page not found</h1>"), (2, f"<title>x</title>\n<p>{near}"), (3, f"<title>T</title>\n<h1>T</h1>\n<p>{SENTENCE}")]
    pages = spark.createDataFrame([(i, "http://h.example", c) for i, c in rows], "page_id bigint, url string, content string")
    other = spark.createDataFrame([(9, trusted)], PAGES)
    assert {tuple(x) for x in mc.main_lines(pages, other).collect()} == {(3, 2), (3, 3)}
    assert [r.page_id for r in mc.main_text(pages, other).collect()] == [3]


def test_repeated_runs_are_covered():
    pages = [mc.Page(f"<p>menu\n<p>one two three four five\n<p>own words of page number {chr(97 + i)} only\n<p>a b\n<p>c d") for i in range(12)]
    for page, cover in zip(pages, mc.covered_tokens(pages), strict=True):
        assert dict(zip(page.tokens, cover.tolist(), strict=True)) == {"menu": True, "one two three four five": True, page.tokens[2]: False, "a b": True, "c d": True}


# ---- problem 7 --------------------------------------------------------------------------------------------------------

RIGHT = ["La búsqueda añade la enseñanza después.", "Der Überblick prüft die Größe täglich für Anfänger.", "L'élève décrit la forêt où l'on sait, très tôt.", "A coleção compõe a avaliação também.", "Кафедра проверяет рабочий стол иногда.", "Η βιβλιοθήκη εξηγεί το μάθημα σήμερα.", "毎週質問の一覧を更新する。", "Naïve “quotes” — isn’t it? • item", "ÚLTIMA REVISIÓN", "plain ascii text"]


def repairer():
    from textmill.llm.encoding_repair import _pairs
    from collections import Counter

    words = Counter(w for t in RIGHT * 40 for w in er.hard_words(t))
    b = _pairs(words)
    return er.Repairer(dict(zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True), b.column(2).to_pylist(), strict=True)))


def garblings(text):
    for written, read in (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1250"), ("utf-8", "cp1251"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1252", "cp1251"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1253", "cp1252")):
        try:
            bad = text.encode(written).decode(read)
        except UnicodeError:
            continue
        if bad != text:
            yield bad
    try:
        yield text.encode().decode("cp1252").encode().decode("latin-1")
    except UnicodeError:
        pass


def test_round_trip_repair():
    r, seen, restored = repairer(), 0, 0
    for text in RIGHT[:-1]:
        for bad in garblings(text):
            flag, changes = er.judge_text(r, bad)
            assert flag, bad
            words = er._SPLIT.split(bad)
            restored += sum(changes.get(a, a) == b for a, b in zip(words, er._SPLIT.split(text), strict=False))
            seen += len(words)
    assert seen > 300 and restored / seen > 0.8


@pytest.mark.parametrize(("word", "read"), [("compõe", "iso8859_2 latin-1 cp1250"), ("búsqueda", "latin-1 latin-1 cp1252"), ("très", "cp1250 latin-1 cp850"), ("Überblick", "iso8859_2 iso8859_2 mac_roman"), ("проверяет", "iso8859_2 cp850 mac_roman")])
def test_three_layers_are_restored(word, read):
    bad = word
    for encoding in read.split():
        bad = bad.encode().decode(encoding)
    assert repairer().judge(bad) == (True, word)


def test_no_shorter_reading_is_passed_over():
    class Fixed(er.Repairer):
        def cost(self, word):
            return {"éééé": 100.0, "ééé": 99.0, "né": 1.0}.get(word, 96.0)

        def readings(self, word, controls=False):
            if word == "éééé":
                yield from ((x * 4, 0.0) for x in "abcdefghijáàâäãå")  # cheaper, but as long or plain
                yield "ééé", 0.0
            if word == "ééé":
                yield "né", 0.0

    assert Fixed({("a", "b"): 1}).repaired("éééé") == "né"


def test_right_text_is_not_garbled():
    r = repairer()
    assert not any(er.judge_text(r, t)[0] or any(map(r.garbled, er.hard_words(t))) for t in RIGHT)
    for lost in ("f\ufffdr Anf\ufffdnger", "s?lection", "campusвЂ?", "isnât na√?ve"):
        assert any(map(r.garbled, er.hard_words(lost))) or "isn" in lost


def test_names_with_queries_and_look_alikes_are_not_garbled():
    r = repairer()
    for right in ("index.php?id=3", "view.cgi?course=5", "really?yes", "see?it works", "αcell", "s\u0435m\u0430ph\u043er\u0435", "ａｂｃ"):
        assert not er.judge_text(r, right)[0] and not any(map(r.garbled, er.hard_words(right))), right
    for bad in ("sp?t genug", "b?squeda", "Gr??e"):
        assert any(map(r.garbled, er.hard_words(bad))), bad


def test_symbols_are_bounded():
    assert len({er.symbol(chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000}) < 10_000 and er.symbol("é") == "é" and er.symbol("質") == er.symbol("賩")


def test_garbled_pages(spark):
    rows = [(i, t) for i, t in enumerate(RIGHT * 30)]
    bad = [(1000, RIGHT[1].encode().decode("cp1252")), (1001, "Fa\ufffdade"), (1000, RIGHT[1].encode().decode("cp1252")), (1002, None), (1003, "")]
    df = spark.createDataFrame(rows + bad, PAGES).withColumn("garbled", F.lit("x")).withColumn("repaired", F.lit(1))
    assert sorted(r.page_id for r in er.garbled_pages(df).collect()) == [1000, 1001]
    assert {r.page_id: r.content for r in er.repaired_pages(df, df).collect()} == {1000: RIGHT[1]}
    assert er.garbled_pages(df.limit(0)).count() == 0
