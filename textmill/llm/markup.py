"""Markup residue in text documents (problem 3): a linear-chain conditional random field over DOM leaf blocks.

A page is read as a tree: HTML elements and the containers of other notations (fence, verbatim, wikitable, itemize and so on) are its
inner nodes, the stretches of a line between tags its leaf blocks. Each block has features of its ancestors (open elements by kind,
the tags beside it, the container it stands in) and of its text: ``SIGNS``, which tell only that a sign of a notation occurs
(a star, a backslash before letters, double brackets) and not that it is markup, and look-alikes. The field has the labels plain,
html, markdown, wiki, latex and code (the inside of a code container), is trained by maximum likelihood (forward-backward, Adam) on
labelled pages, and decodes by Viterbi. The labelled pages are written here: ``TRAINING_PAGES`` pages with known labels, from a fixed
seed, so every run trains the same field in a few seconds.

A page is written in a notation if a block is decoded as it; nothing else decides.

Defined results: null and empty contents, and pages without any sign, give nothing; a page may have several notations;
exact duplicate rows count once; cut-off constructs count.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES, EPOCHS, SEED = 700, 14, 20  # the bound of the training sample
LABELS = ("plain", "html", "markdown", "wiki", "latex", "code")
NOTATIONS = LABELS[1:5]

# Names of HTML elements, of entities and of LaTeX commands.
_ELEMENTS = (
    "a abbr address article aside b big blockquote body br button caption center cite code dd del details div dl dt em fieldset figcaption figure font footer form "
    "h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main meta nav ol option p pre q s script section select small span strike strong "
    "style sub summary sup table tbody td textarea tfoot th thead title tr tt u ul var"
).replace(" ", "|")
_ENTITIES = "nbsp|lt|gt|amp|quot|apos|mdash|ndash|hellip|copy|reg|eacute|uuml|ouml|auml|szlig|laquo|raquo|ldquo|rdquo|lsquo|rsquo|middot|bull|times|#\\d{2,5}|#x[0-9A-Fa-f]{2,5}"
_COMMANDS = (
    "begin|end|section|subsection|subsubsection|chapter|paragraph|part|title|author|emph|textbf|textit|texttt|textsc|underline|cite|citep|citet|ref|eqref|pageref|label|footnote|href|url|frac|sqrt|mathbf|mathrm|text|caption|includegraphics|usepackage|documentclass|input"
)
_SWITCHES = "it|bf|em|tt|sc|rm|sf|sl|tiny|scriptsize|footnotesize|small|normalsize|large|Large|LARGE|huge|Huge|itshape|slshape|scshape|upshape|bfseries|mdseries|rmfamily|sffamily|ttfamily"

_TAG = re.compile(rf"(?<![<\w])<(/?)({_ELEMENTS})(?=[\s/>])[^<>]*>?(?!>)|(?<=[\w.,;:!?)])(?<!List)<(/?)(sup|sub|b|i|em|strong|span|a|font|br|p|li|div|td|tr|u|s|small|big|tt|code|h[1-6])(?=[\s/>])[^<>]*>?(?!>)", re.I)
_KINDS = {t: k for k, names in {"head": "h1 h2 h3 h4 h5 h6", "list": "ul ol li dl dt dd", "table": "table tr td th tbody thead", "inline": "a b i u s em strong span font sup sub code tt small big q cite kbd var mark"}.items() for t in names.split()}  # all others are blocks
_VOID = frozenset("br hr img input meta link".split())

#: signs of the notations: (notation, name, pattern)
SIGNS = [(g, n, re.compile(p, f)) for g, n, p, f in (
    ("html", "entity", r"&#?\w{2,8};", 0),
    ("html", "known entity", rf"&(?:{_ENTITIES});", 0),
    ("html", "comment", r"<!", 0),
    ("markdown", "hashes", r"^\s*#{1,6} +\S", 0),
    ("markdown", "rule", r"^(?:={3,}|-{3,})\s*$", 0),
    ("markdown", "stars", r"\*{2,}\S|\S\*{2,}", 0),
    ("markdown", "underscores", r"(?<!\w)__+\w|\w__+(?!\w)", 0),
    ("markdown", "tildes", r"~~\S", 0),
    ("markdown", "link", r"\]\(\S+", 0),
    ("markdown", "reference", r"\]\[\w+\]|^\[[^\[\]]+\]: +\S*[/#]", 0),
    ("markdown", "fence", r"^\s*(?:```|~~~)", 0),
    ("markdown", "tick", r"`", 0),
    ("markdown", "ticks around", r"(?<!`)`[^`\s](?:[^`]*[^`\s])?`(?!`)", 0),
    ("markdown", "bars", r"^\s*\|.*\|\s*$", 0),
    ("markdown", "quote", r"^>", 0),
    ("wiki", "equals", r"^={2,6}.*\w.*={2,6}\s*$", 0),
    ("wiki", "quotes", r"(?<!')'{2,3}(?!')", 0),
    ("wiki", "brackets", r"\[\[|\]\]", 0),
    ("wiki", "braces", r"\{\{\s*\w[^{}]*\|", 0),
    ("wiki", "table", r"^\s*(?:\{\||\|\}|\|-|\|\+)", 0),
    ("wiki", "indent", r"^:{1,4} ?\S|^[*#:;]{1,4} ?\[\[", 0),
    ("wiki", "tag", r"<(?:nowiki|ref|math|syntaxhighlight|source)\b|__[A-Z]+__|^#REDIRECT", 0),
    ("latex", "command", r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?\{", 0),
    ("latex", "known command", rf"\\(?:{_COMMANDS})\b", 0),
    ("latex", "switch", rf"\{{\s*\\(?:{_SWITCHES})(?![A-Za-z])", 0),
    ("latex", "item", r"^\s*\\[a-z]+", 0),
    ("latex", "display", r"\\[(\[\])]", 0),
    ("latex", "dollars", r"\$[^$]+\$", 0),
    ("latex", "formula", r"\$(?=[^\s$\d({])[^$=;]*[_^\\][^$;]*\$|\$\$[^$]+\$\$", 0),
    ("latex", "ticks", r"``[^`']+''|''\\,|~\\[a-z]", 0),
)]
#: look-alikes that are no markup
DECOYS = [(n, re.compile(p)) for n, p in (
    ("include", r"^\W*#include"), ("generic", r"\b[A-Z]\w*<[A-Z]\w*>"), ("path", r"\b[A-Z]:\\\w"), ("assign", r"^\W*\$\w+ = "), ("price", r"\$\d"), ("mail", r"\S@\S"), ("hash", r"#\d"),
    ("product", r"\w \* \w"), ("star", r"\d\*|\w\*$|\(\*\)"), ("equal", r"\w == \w"), ("less", r"\w < \d"), ("bracket", r"\[(?:sic|\d+)\]"), ("declare", r"^\W*int \w+ = "), ("bullet", r"^\s*•"),
    ("number", r"^\s*\d+\) "), ("frame", r"^(?:-- .* --|\+\+\+ .* \+\+\+|→ .*|\[[^\[\]]* [^\[\]]*\])$"), ("crumbs", r"\w\s+>\s+\w"), ("bars", r"\w\s+\|\s+\w"),
    ("slot", r"\{\{\s*[\w.]+\s*\}\}|<%|<<\w|%\(\w|[$#]\{\w|\$\(\w|@@\w|%%\w|###\w|\{\w+\}|\[(?:INSERT |insert )?[\w.]+\]|\[object"),
)]
FEATURES = ("bias", "empty", "sentence", "short", "long", "shout", *(f"{g}.{n}" for g, n, _ in SIGNS), *(f"decoy.{n}" for n, _ in DECOYS), "in.pre", "in.fence", "in.verbatim", "in.wikitable", "in.list", "below text", "above rule", *(f"{w}.{k}" for w in ("under", "after", "before") for k in ("block", "head", "list", "table", "inline")), "part of line", "cut tag")
_AT = {f: i for i, f in enumerate(FEATURES)}
_RULE = re.compile(r"(?:={3,}|-{3,})\s*$")
_SIGN = re.compile(r"[<>&#*_`~|\[\]{}\\$='^:@•→+%/-]")
_INLINE_CODE = re.compile(r"`[^`]+`")


def ancestors(lines: list[str]) -> list[str]:
    """The code container or list in which each line stands: "", pre, fence, verbatim, wikitable or list. A container without
    an end (a page may be cut off) holds the lines down to the next empty one."""
    inside, n = [""] * len(lines), len(lines)
    opening = (("pre", re.compile(r"<pre\b", re.I), re.compile(r"</pre", re.I)), ("fence", re.compile(r"^\s*(?:```|~~~)"), re.compile(r"^\s*(?:```|~~~)")),
               ("verbatim", re.compile(r"\\begin\{(?:verbatim|lstlisting|minted|equation|align)"), re.compile(r"\\end\{(?:verbatim|lstlisting|minted|equation|align)")),
               ("wikitable", re.compile(r"^\s*\{\|"), re.compile(r"^\s*\|\}")), ("list", re.compile(r"\\begin\{(?:itemize|enumerate)|<[uo]l\b", re.I), re.compile(r"\\end\{(?:itemize|enumerate)|</[uo]l", re.I)))
    i = 0
    while i < n:
        step = 1
        if _SIGN.search(lines[i]):
            for name, begin, end in opening:
                if m := begin.search(lines[i]):
                    if end is not begin and name != "fence" and end.search(lines[i], m.end()):
                        break
                    stop = next((j for j in range(i + 1, n) if end.search(lines[j])), None)
                    if stop is None:
                        stop = next((j for j in range(i + 1, n) if not lines[j].strip()), n)
                    for j in range(i + 1, stop):
                        inside[j] = name
                    if name != "list":
                        step = max(1, stop - i + (name == "fence"))
                    break
        i += step
    return inside


def leaves(lines: list[str], inside: list[str]) -> list[tuple[int, str, set[str]]]:
    """The leaf blocks in order: line number, text, and what is known from the tree: the kinds of open elements (under), and of the tags
    right before and after the block. A line without text between its tags is one empty block. Within code nothing is a tag."""
    out: list[tuple[int, str, set[str]]] = []
    stack: list[str] = []
    for i, line in enumerate(lines):
        tags = list(_TAG.finditer(line)) if "<" in line and inside[i] not in ("pre", "fence", "verbatim") else ()
        if not tags:
            out.append((i, line, {f"under.{_KINDS.get(t, 'block')}" for t in stack}))
            continue
        at, before, parts = 0, None, []
        for m in [*tags, None]:
            text = line[at : m.start() if m else len(line)]
            kind = _KINDS.get((m[2] or m[4]).lower(), "block") if m else None
            if text.strip() or m is None and not parts:
                known = {f"under.{_KINDS.get(t, 'block')}" for t in stack} | ({f"after.{before}"} if before else set()) | ({f"before.{kind}"} if kind else set())
                parts.append((i, text, known | {"part of line"}))
            if m:
                name = (m[2] or m[4]).lower()
                if m[1] or m[3]:
                    if name in stack:
                        del stack[len(stack) - 1 - stack[::-1].index(name) :]
                elif name not in _VOID:
                    if name in ("p", "li", "td", "tr") and name in stack:
                        del stack[len(stack) - 1 - stack[::-1].index(name) :]
                    stack.append(name)
                at, before = m.end(), kind
                if not m[0].endswith(">"):
                    parts.append((i, "", {f"after.{kind}", "cut tag"}))
        out.extend(parts)
    return out


def features(lines: list[str]) -> tuple[list[int], list[list[int]]]:
    """The line and the feature numbers of each leaf block."""
    inside, out, where = ancestors(lines), [], []
    for i, text, known in leaves(lines, inside):
        t = text.strip()
        f = [0, *(_AT[k] for k in sorted(known))]
        if not t:
            f.append(_AT["empty"])
        else:
            if t[-1] in ".!?;" and t.count(" ") > 3:
                f.append(_AT["sentence"])
            f.append(_AT["short" if len(t) < 25 else "long"])
            if t.isupper():
                f.append(_AT["shout"])
            if inside[i]:
                f.append(_AT[f"in.{inside[i]}"])
            if i and lines[i - 1].strip():
                f.append(_AT["below text"])
            if i + 1 < len(lines) and _RULE.match(lines[i + 1]):
                f.append(_AT["above rule"])
            if _SIGN.search(t) and inside[i] not in ("pre", "fence", "verbatim"):  # code is of no notation
                bare = _INLINE_CODE.sub("`c`", text.rstrip("\r")) if "`" in text else text.rstrip("\r")
                f += [_AT[f"{g}.{n}"] for g, n, p in SIGNS if p.search(bare)]
                f += [_AT[f"decoy.{n}"] for n, p in DECOYS if p.search(bare)]
        out.append(f)
        where.append(i)
    return where, out


# ---- labelled pages -------------------------------------------------------------------------------------------------

# Words of the labelled pages.
_NOUNS = "river engine garden lesson window market letter bridge theory signal mirror island planet pocket winter basket title link source label section item table summary".split()
_VERBS = "builds opens reads follows carries measures finds keeps moves paints".split()


def _sentence(r: random.Random) -> str:
    n = r.sample(_NOUNS, 3)
    return r.choice((f"The {n[0]} {r.choice(_VERBS)} a {n[1]} near the {n[2]}.", f"Each {n[0]} has one {n[1]} and several {n[2]}s.", f"When a {n[0]} {r.choice(_VERBS)} the {n[1]}, every {n[2]} waits!"))


def _head(r: random.Random) -> str:
    head = r.choice((f"Notes on {r.choice(_NOUNS)}", f"{r.choice(_NOUNS).title()} and {r.choice(_NOUNS)}: methods", f"ABC {r.randint(100, 499)} {r.choice(_NOUNS)}"))
    return head.upper() if r.random() < 0.15 else head


def _code(r: random.Random) -> list[str]:
    a, b = r.sample(_NOUNS, 2)
    return r.choice(([f"if ({a[:3]} < {r.randint(1, 9)}) return {b};", f"{a} == {b}"], [f"#include <{a}.h>", f"int {a}_{b} = 0;"], [f"${a} = ${b} + $step;"], [f"List<{a.title()}> items = load({b});"], [f"{a} * {b} * 2", f"C:\\{a}\\{b}"]))


def _wrapped(r: random.Random, text: str, wrap) -> str:
    words = text.split()
    i = r.randrange(1, len(words))
    words[i] = wrap(words[i])
    return " ".join(words)


def _block(r: random.Random, notation: str) -> list[tuple[str, str]]:
    """A block of one notation: its lines with their labels."""
    a, b = r.sample(_NOUNS, 2)
    s, h = _sentence(r) + (" " + _sentence(r)) * r.randint(0, 2), _head(r)
    one = lambda x: [(x, notation)]
    fence = lambda o, c, esc=str, pre="": [(o, notation), *((pre + esc(x), notation if pre else "code") for x in _code(r)), (c, notation)]
    if notation == "html":
        return r.choice((
            lambda: one(f"<h{(n := r.randint(1, 3))}>{h}</h{n}>"), lambda: one(f"<p>{s}{r.choice(('</p>', ''))}"), lambda: one(f'<a href="/{a}/{b}">{h}</a>'), lambda: one(f"<div class='t'>{s}"),
            lambda: [("<ul>", notation), *((f"<li>{_sentence(r)}</li>", notation) for _ in range(2)), ("</ul>", notation)], lambda: fence("<pre>", "</pre>", html.escape),
            lambda: one(_wrapped(r, s, lambda w: r.choice((f"<b>{w}</b>", f"<em>{w}</em>", f"<font color=red>{w}</font>", f'<span style="x">{w}</span>', f"{w}&nbsp;", f"{w}&mdash;", f"{w}<br/>", f"<I>{w}</I>")))),
            lambda: one(f"{s}<BR>"), lambda: one("x<sup>2</sup> + y<sub>3</sub>"), lambda: one("<!-- x -->"),
        ))()
    if notation == "markdown":
        return r.choice((
            lambda: one(f"{'#' * r.randint(1, 4)} {h}"), lambda: [(h, notation), (r.choice("=-") * len(h), notation)], lambda: one(f"[{h}](/{a}/{b})"), lambda: one(f"[{h}][3] is listed below."), lambda: one(f'[3]: /{a}/{b} "{a}"'),
            lambda: [(f"{r.choice(('-', '*', '1.'))} **{(x := _sentence(r)).split()[0]}** {x}", notation) for _ in range(2)], lambda: fence(*r.choice((("```", "```"), ("~~~", "~~~"), ("```text", "```")))),
            lambda: one(_wrapped(r, s, lambda w: r.choice((f"**{w}**", f"~~{w}~~", f"`{w}`", f"[{w}](/notes)", f"__{w}__", f"***{w}***", f"![{w}](fig.png)")))), lambda: one(f"> {s}"), lambda: [("| a | `4` |", notation), ("|---|:--|", notation), ("| b | 5 |", notation)],
        ))()
    if notation == "wiki":
        return r.choice((
            lambda: one(f"{'=' * (n := r.randint(2, 5))} {h} {'=' * n}"), lambda: one(f":: {s}"), lambda: one(f"[[{h}|{a}]] [[Category:{b.title()}]]"), lambda: one(f"[[File:{a}.png|thumb|{h}]]"),
            lambda: [(f"{r.choice(('*', '**', '#', '##'))} [[{(x := _sentence(r)).split()[0]}]] {x}", notation) for _ in range(2)], lambda: fence("{| class=wikitable", "|}", str, "| "), lambda: one("|-"),
            lambda: one(_wrapped(r, s, lambda w: r.choice((f"'''{w}'''", f"''{w}''", f"[[{w}]]", f"[[Main|{w}]]", f"{w}{{{{citation|year=2001}}}}")))), lambda: one(f"{{{{Infobox {a}|name={b}|year=1990}}}}"),
        ))()
    return r.choice((
        lambda: one(f"\\{r.choice(('section', 'section*', 'subsection', 'chapter'))}{{{h}}}"), lambda: one(f"\\href{{/{a}/{b}}}{{{h}}}"), lambda: fence("\\begin{verbatim}", "\\end{verbatim}"),
        lambda: [("\\begin{itemize}", notation), *((f"\\item {_sentence(r)}", notation) for _ in range(2)), ("\\end{itemize}", notation)], lambda: one(f"\\item {s}"),
        lambda: one(_wrapped(r, s, lambda w: r.choice((f"\\textbf{{{w}}}", f"\\emph{{{w}}}", f"{{\\{r.choice(_SWITCHES.split('|'))} {w}}}", f"``{w}''\\,", f"{w}~\\cite{{k}}", f"{w}\\footnote{{see}}", f"${w}_i$", f"{w} (\\ref{{s1}})")))),
        lambda: one(r.choice((r"\[ \sum_{i=1}^{n} a_i^2 \]", r"\( \log i \)", r"$$c = \frac{1}{9}$$", r"where $s^2 \leq 4$ holds"))),
    ))()


def _plain(r: random.Random) -> list[str]:
    a, b = r.sample(_NOUNS, 2)
    s, h = _sentence(r), _head(r)
    line = r.choice((s, s, h, f"• {s}", f"{r.randint(1, 9)}) {s}", f"#1 priority: the {a} (5 * 3 = 15) [sic]", f"Rated 4* by the {a} council*", f"(*) see the {a} note", f"Cost: $5 to $72 per {a}, about 2 > 1.", f"score(s) = f * w and s < 3 [6]", f"Mail {a}@{b}.example, ask for the {a}_{b} file.",
                     f"About [{a}]", "[term]: [room]", f"Welcome to {{{{ {a} }}}}, taught by ${{{b}}} in <<{a}>>.", f"In the shell, ${{{a}}} expands to the value.", f"[{h} and {a}]", f"-- {h} --", f"+++ {h} +++", f"→ {h}", f"{a.title()} > {b.title()} > {h}", f"Share this note: mail | print | {a}", h.upper(), ""))
    return _code(r) if r.random() < 0.15 else [line]


def labelled_pages(pages: int = TRAINING_PAGES, seed: int = SEED) -> list[tuple[list[str], list[int]]]:
    r, out = random.Random(seed), []
    for _ in range(pages):
        used = r.sample(NOTATIONS, r.choice((0, 1, 1, 2, 3, 4)))
        rows: list[tuple[str, str]] = [(_head(r), "plain") for _ in range(r.choice((0, 0, 1, 2, 3)))]
        for _ in range(r.randint(3, 9)):
            rows += _block(r, r.choice(used)) if used and r.random() < 0.6 else [(x, "plain") for x in _plain(r)]
        out.append(([x for x, _ in rows], [LABELS.index(y) for _, y in rows]))
    return out


# ---- the field ------------------------------------------------------------------------------------------------------


def _emissions(weights: np.ndarray, feats: list[list[int]]) -> np.ndarray:
    return np.stack([weights[f].sum(axis=0) for f in feats])


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def _add_gradient(batch: list[tuple[np.ndarray, np.ndarray, np.ndarray]], w: np.ndarray, t: np.ndarray, gw: np.ndarray, gt: np.ndarray) -> None:
    """Forward-backward over a batch of pages (feature numbers of all blocks, their numbers of features, labels) at once; adds to the
    gradients of the negative log-likelihood. Shorter pages are padded and masked."""
    sizes = [len(y) for _, _, y in batch]
    mask = np.arange(max(sizes)) < np.array(sizes)[:, None]
    flat, each, gold = (np.concatenate(c) for c in zip(*batch, strict=True))
    block = np.repeat(np.arange(len(each)), each)
    e = np.zeros((*mask.shape, w.shape[1]))
    e[mask] = np.add.reduceat(w[flat], np.cumsum(each) - each)
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for i in range(1, mask.shape[1]):
        alpha[:, i] = np.where(mask[:, i, None], e[:, i] + _lse(alpha[:, i - 1, :, None] + t, 1), alpha[:, i - 1])
    for i in range(mask.shape[1] - 2, -1, -1):
        beta[:, i] = np.where(mask[:, i + 1, None], _lse(t + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0.0)
    z = _lse(alpha[:, -1], 1)
    marginal = np.exp(alpha + beta - z[:, None, None])[mask]
    np.add.at(gw, flat, marginal[block])
    np.subtract.at(gw, (flat, gold[block]), 1)
    pairs = np.exp(alpha[:, :-1, :, None] + t + (e + beta)[:, 1:, None, :] - z[:, None, None, None])
    gt += pairs[mask[:, 1:]].sum(axis=0)
    labels = np.zeros(mask.shape, np.int64)
    labels[mask] = gold
    np.subtract.at(gt, (labels[:, :-1][mask[:, 1:]], labels[:, 1:][mask[:, 1:]]), 1)


@lru_cache(maxsize=1)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, transition weights) by maximum likelihood with an L2 penalty."""
    data = []
    for lines, labels in labelled_pages(pages, seed):
        where, feats = features(lines)
        data.append((np.concatenate([np.array(f) for f in feats]), np.array([len(f) for f in feats]), np.array([labels[i] for i in where])))
    k, rng = len(LABELS), np.random.default_rng(seed)
    w, t = np.zeros((len(FEATURES), k)), np.zeros((k, k))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(data)), max(1, len(data) // 10)):
            gw, gt = 1e-4 * w, 1e-4 * t
            _add_gradient([data[d] for d in batch], w, t, gw, gt)
            step += 1
            for x, g, m, v in ((w, gw, *moments[:2]), (t, gt, *moments[2:])):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                x -= 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w, t


def viterbi(model: tuple[np.ndarray, np.ndarray], feats: list[list[int]]) -> list[int]:
    w, t = model
    e = _emissions(w, feats)
    back, score = [], e[0]
    for i in range(1, len(e)):
        paths = score[:, None] + t
        back.append(paths.argmax(axis=0))
        score = paths.max(axis=0) + e[i]
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


_TELLING = frozenset(_AT[f"{g}.{n}"] for g, n, _ in SIGNS) | frozenset(i for f, i in _AT.items() if f.startswith(("after.", "before.")) or f == "cut tag")


def decode(model, lines: list[str]) -> tuple[list[int], set[int]]:
    """Labels of the lines (that of its first block which isn't plain), and the notations that a block is decoded as."""
    where, feats = features(lines)
    labels = [0] * len(lines)
    if _TELLING.isdisjoint(f for fs in feats for f in fs):
        return labels, set()
    path = viterbi(model, feats)
    for i, y in zip(where, path, strict=True):
        labels[i] = labels[i] or y
    return labels, {y for y in path if 1 <= y <= 4}


# ---- clean text -----------------------------------------------------------------------------------------------------

_INLINE = [(re.compile(p), s) for p, s in (
    (r"<br\s*/?>", " "), (r"(?i)<sup>([^<]*)</sup>", r"^\1"), (r"(?i)<sub>([^<]*)</sub>", r"_\1"), (r"</?[A-Za-z][^<>]*/?>|<!--[^<>]*(?:-->|$)", ""), (r"!?\[([^\[\]]+)\]\([^()\s]+(?:\s+\"[^\"]*\")?\)", r"\1"), (r"\[([^\[\]]+)\]\[\w{1,4}\]", r"\1"),
    (r"\[\[(?:Category|File|Image):[^\[\]]*?([^\[\]|]*)\]\]", ""), (r"\[\[(?:[^\[\]|]*\|)?([^\[\]]+)\]\]", r"\1"), (r"\{\{[A-Za-z][^{}|]*\|[^{}]*\}\}", ""), (r"'{2,3}([^']+)'{2,3}", r"\1"), (r"\*{2,3}([^*]+)\*{2,3}", r"\1"), (r"~~([^~]+)~~", r"\1"), (r"(?<!\w)__([^_]+)__(?!\w)", r"\1"),
    (r"(?<!`)`([^`]+)`(?!`)", r"\1"), (r"``([^`']+)''(?:\\,)?", "“\\1”"), (r"~?\\(?:cite|ref|label|footnote)\{[^{}]*\}", ""), (r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1"), (r"\\(?:emph|textbf|textit|texttt|underline)\{([^{}]*)\}", r"\1"), (rf"\{{\s*\\(?:{_SWITCHES})(?![A-Za-z])\s*([^{{}}]*?)(?:\\/)?(?:\}}|$)", r"\1"), (r"\\,", " "),
)]
_HEADINGS = re.compile(r"^\s*(?:#{1,6}\s+(.*)|(={2,6})\s*(.*?)\s*\2|\\(?:section|subsection|subsubsection|chapter|paragraph)\*?\{(.*)\}|<h[1-6][^>]*>(.*?)(?:</h[1-6]>)?)\s*$", re.I)
_ITEM = re.compile(r"^\s*(?:<li[^>]*>|\\item\b|[*#]{1,4}(?=\s|\[\[)|[-+*](?=\s)|\d+\.(?=\s))\s*", re.I)
_FRAME = re.compile(r"^\s*(?:</?(?:ul|ol|pre|div|table|tr)\b[^>]*>|\\(?:begin|end)\{[^{}]*\}|```.*|~~~.*|\{\|.*|\|\}|\|-+|\|(?:\s*:?-{2,}:?\s*\|)+|[=-]{4,}|\[[^\[\]]+\]: +\S.*)\s*$", re.I)


def clean(lines: list[str], labels: list[int]) -> str:
    """The text without markup: headings on a line between empty lines, list items after "• ", code lines after four spaces,
    formulas as they are written."""
    inside, out = ancestors(lines), []
    for line, y, where in zip(lines, labels, inside, strict=True):
        code = where in ("pre", "fence", "verbatim", "wikitable")
        if _FRAME.match(line) and (y or code):
            continue
        if code:
            out.append("    " + html.unescape(re.sub(r"^\|\s?", "", line) if where == "wikitable" else line))
        elif not y or y == 5:
            out.append(line)
        else:
            head = _HEADINGS.match(line)
            item = None if head else _ITEM.match(line)
            text = next(g for i, g in enumerate(head.groups(), 1) if g is not None and i != 2) if head else line[item.end() :] if item else re.sub(r"^(?:>+\s?|:+\s)", "", line)
            for p, s in _INLINE:
                text = p.sub(s, text)
            text = html.unescape(text).strip()
            out.extend(["", text, ""] if head else [("• " if item else "") + text])
    return re.sub(r"\n{3,}", "\n\n", "\n".join(out)).strip("\n")


# ---- the operators --------------------------------------------------------------------------------------------------


def markup_pages(pages: DataFrame) -> DataFrame:
    """(page_id, markup): each notation in which a page's text is written."""
    return _decoded(pages, False).select("page_id", "markup").distinct()


def clean_pages(pages: DataFrame) -> DataFrame:
    """(page_id, clean): the clean text of every row with content."""
    return _decoded(pages, True).select("page_id", "clean")


def _decoded(pages: DataFrame, whole: bool) -> DataFrame:
    rows = pages.where(F.col("page_id").isNotNull() & (F.col("content") != "")).select("page_id", "content")
    model = pages.sparkSession.sparkContext.broadcast(trained())
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, values = [], []
            for page, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                lines = content.replace("\r\n", "\n").split("\n")
                labels, found = decode(model.value, lines)
                if whole:
                    ids.append(page)
                    values.append(clean(lines, labels) if found else content)
                else:
                    ids.extend([page] * len(found))
                    values.extend(LABELS[y] for y in sorted(found))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(values, pa.string())], ["page_id", "clean" if whole else "markup"])

    return rows.mapInArrow(run, f"page_id {kind}, {'clean' if whole else 'markup'} string")
