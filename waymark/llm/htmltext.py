"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into its leaf blocks: runs of text between block-level tags, with the open elements above them.
Features are the tags, classes and ids of these ancestors and the block's own text (length, links, punctuation). The
field has two labels, main text or not; it is trained by maximum likelihood (forward-backward) on labelled pages and
decoded by Viterbi. The labelled pages are made here: layouts of many kinds, each block with its label.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_batches

#: Element kinds of HTML.
BLOCKS = frozenset("address article aside blockquote body caption dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea iframe svg object canvas".split())
CLOSES_P = BLOCKS - {"body", "head", "html", "title", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select nav article section div body html".split())
#: Elements that are lines of what they are in: their text counts for that.
LINES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table tbody thead tfoot tr td th figure figcaption caption".split())

#: What ancestors count for a block's features; a deeper page has its innermost ones.
DEPTH = 64
_STOPS = SCOPES | {"p", *SELF_CLOSING}

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_PART = re.compile(r"[a-z]+")


#: What elements of made pages are named by what they hold.
NAMES = {
    "menu": "menu nav navbar main-nav breadcrumb breadcrumbs toc pagination pager toolbar tabs navigation links".split(),
    "head": "site-header header masthead top topbar branding banner".split(),
    "foot": "footer site-footer colophon copyright legal bottom".split(),
    "side": "sidebar side related widget rail recommended more trending popular aside teaser share social tags author".split(),
    "advert": "ad ads advert adverts advertisement banner sponsor sponsored promo promotion".split(),
    "notice": "cookie cookies notice consent alert popup modal overlay newsletter gdpr subscribe paywall".split(),
    "form": "search login subscribe signup contact".split(),
    "comment": "comments comment comment-list commentlist replies reply responses response respond disqus disqus_thread reactions discussion thread".split(),
    "share": "share social tags toolbar".split(),
    "title": "title headline".split(),
    "main": "post article entry content story text body prose single post-content entry-content article-body main page".split(),
}


class Block:
    __slots__ = ("text", "above", "link_chars", "box", "largest")

    def __init__(self, text: str, above: tuple[str, ...], link_chars: int, box: int = 0, largest: bool = False):
        self.text, self.above, self.link_chars, self.box, self.largest = text, above, link_chars, box, largest


class Scanner:
    """The markup of a page, read once from left to right: no part of it is looked at more than a few times."""

    def __init__(self, page: str):
        self.page, self.ended = page, {}

    def find(self, what: str, at: int) -> int:
        """str.find that remembers what doesn't come any more."""
        if at >= self.ended.get(what, len(self.page) + 1):
            return -1
        k = self.page.find(what, at)
        if k < 0:
            self.ended[what] = min(at, self.ended.get(what, at))
        return k

    def attributes(self, at: int) -> tuple[int, list[str], bool]:
        """Where the tag ends that is open at this place, the words of its class, id and role, and whether it closes
        itself. A quote opens a value only after an equals sign, and one that never closes is a character."""
        page, n, said = self.page, len(self.page), []
        while True:
            at = _GAP.match(page, at).end()
            if at >= n or page[at] == ">":
                return at + 1, said, page[at - 1 : at] == "/"
            m = _KEY.match(page, at)
            key, at = m[0].lower(), m.end()
            m = _EQUALS.match(page, at)
            if not m:
                continue
            at = m.end()
            end = self.find(page[at], at + 1) if page[at : at + 1] in ("'", '"') else -1
            if end >= 0:
                value, at = page[at + 1 : end], end + 1
            else:
                m = _BARE.match(page, at)
                value, at = m[0], m.end()
            if key in ("class", "id", "role"):
                said += _PART.findall(value.lower())

    def tokens(self):
        """(text, "", (), ...) and ("", tag, words of class, id and role, closing, self-closing), in order; comments,
        declarations and silent elements are passed over. A tag that the page breaks off in is none."""
        page, at, n = self.page, 0, len(self.page)
        text = at
        while True:
            k = self.find("<", at)
            if k < 0:
                break
            m = _NAME.match(page, k + 1)
            if not m and not page.startswith(("!", "?", "/"), k + 1):
                at = k + 1  # a character
                continue
            if k > text:
                yield page[text:k], "", (), False, False
            if not m:
                comment = page.startswith("!--", k + 1)
                end = self.find("-->" if comment else ">", k + 4 if comment else k + 1)
                at = text = n if end < 0 else end + (3 if comment else 1)
                continue
            at, said, closed = self.attributes(m.end())
            text = at
            if at > n:
                return
            tag = m[2].lower()
            if tag in SILENT:
                if not m[1] and not closed:
                    at = text = self.silence(tag, at)
                continue
            yield "", tag, said, bool(m[1]), closed
        if text < n:
            yield page[text:], "", (), False, False

    def silence(self, tag: str, at: int) -> int:
        """Where the page goes on after a silent element: past its end tag, or nowhere."""
        if at >= self.ended.get(tag, len(self.page) + 1):
            return len(self.page)
        end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(self.page, at)
        if not end:
            self.ended[tag] = at
        return end.end() if end else len(self.page)


def leaf_blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order; text in scripts, styles and comments is none. largest: whether a block is in the
    element that holds most of the page's characters outside links."""
    out: list[Block] = []
    # Of each open element: tag, element, box (a number of its own if it is a block, else that of what it is in), the
    # nearest one at or below it that can stop a search, and the block elements above and with it.
    stack: list[tuple[str, str, int, int, tuple[str, ...]]] = []
    open_tags: dict[str, int] = {}
    plain: dict[int, int] = {}
    parts: list[str] = []
    links = boxes = 0

    def flush():
        nonlocal parts, links
        text = " ".join(html.unescape("".join(parts)).split()) if parts else ""
        if text:
            box = stack[-1][2] if stack else 0
            parent = outer[box] if stack and stack[-1][4] and stack[-1][4][-1].split(" ")[0] in LINES else box
            out.append(Block(text, stack[-1][4] if stack else (), links, parent))
            plain[parent] = plain.get(parent, 0) + max(0, len(text) - links)
        parts, links = [], 0

    def pop_to(k: int):
        for e in stack[k:]:
            open_tags[e[0]] -= 1
        del stack[k:]

    def stop_below(k: int) -> int:
        return stack[k][3] if k >= 0 else -1

    outer = {0: 0}
    for said, tag, words, closing, closed in Scanner(page or "").tokens():
        if not tag:
            parts.append(said)
            if open_tags.get("a"):
                links += len(said.strip())
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            if open_tags.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                pop_to(k)
            continue
        if tag in CLOSES_P and open_tags.get("p"):
            k = stop_below(len(stack) - 1)
            while k >= 0 and stack[k][0] != "p" and stack[k][0] not in SCOPES:
                k = stop_below(k - 1)
            if k >= 0 and stack[k][0] == "p":
                pop_to(k)
        if tag in SELF_CLOSING:
            k = stop_below(len(stack) - 1)
            while k >= 0 and stack[k][0] not in SELF_CLOSING[tag] and stack[k][0] not in SCOPES:
                k = stop_below(k - 1)
            if k >= 0 and stack[k][0] in SELF_CLOSING[tag]:
                pop_to(k)
        if tag not in VOID and not closed:
            element = " ".join([tag, *dict.fromkeys(words)])
            above, box = (stack[-1][4], stack[-1][2]) if stack else ((), 0)
            if tag in BLOCKS:
                boxes += 1
                outer[boxes] = outer[box] if above and above[-1].split(" ")[0] in LINES else box
                above, box = (*above[-DEPTH + 1 :], element), boxes
            stack.append((tag, element, box, len(stack) if tag in _STOPS else stop_below(len(stack) - 1), above))
            open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    most = max(plain.values(), default=0)
    for b in out:
        b.largest = most > 0 and plain[b.box] == most
    return out


def above_features(above: tuple[str, ...]) -> set[str]:
    out = {"parent=" + (above[-1].split(" ")[0] if above else "")}
    for e in above:
        tag, *said = e.split(" ")
        out.add("in=" + tag)
        out.update("named=" + w for w in said)
    return out


def own_features(b: Block) -> list[str]:
    n, words = len(b.text), b.text.count(" ") + 1
    share = b.link_chars / n
    return [f"words={min(6, words.bit_length())}", f"largest={b.largest}", f"linked={0 if share == 0 else 1 if share < 0.4 else 2}", f"ends={b.text[-1] in '.!?:;”\"'}", f"mark={any(c in b.text for c in '©®|»›·')}"]


class Field:
    """Weights for the label main text, and transitions."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.step = np.zeros((2, 2))
        self.known: dict[tuple[str, ...], float] = {}

    def emission(self, b: Block) -> float:
        above = self.known.get(b.above)
        if above is None:
            if len(self.known) > 1 << 16:
                self.known.clear()
            above = self.known[b.above] = sum(self.weight.get(f, 0.0) for f in above_features(b.above))
        return above + sum(self.weight.get(f, 0.0) for f in own_features(b))

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels."""
        if not blocks:
            return []
        s, back = [0.0, self.emission(blocks[0])], []
        t = self.step.tolist()
        for b in blocks[1:]:
            e = self.emission(b)
            come0 = 0 if s[0] + t[0][0] >= s[1] + t[1][0] else 1
            come1 = 0 if s[0] + t[0][1] > s[1] + t[1][1] else 1
            back.append((come0, come1))
            s = [s[come0] + t[come0][0], s[come1] + t[come1][1] + e]
        path = [0 if s[0] > s[1] else 1]
        for pair in reversed(back):
            path.append(pair[path[-1]])
        return path[::-1]

    def expectations(self, e: np.ndarray, page: list[tuple[list[str], int]]) -> tuple[np.ndarray, np.ndarray]:
        """The probability that each block is main text, by forward-backward on emissions e, and the gradient of the
        log-likelihood by the transitions."""
        n = len(page)
        fore, aft = np.zeros((n, 2)), np.zeros((n, 2))
        fore[0] = e[0]
        for i in range(1, n):
            fore[i] = e[i] + np.logaddexp(fore[i - 1, 0] + self.step[0], fore[i - 1, 1] + self.step[1])
        for i in range(n - 2, -1, -1):
            x = e[i + 1] + aft[i + 1]
            aft[i] = np.logaddexp(self.step[:, 0] + x[0], self.step[:, 1] + x[1])
        z = np.logaddexp(*fore[-1])
        pull = np.zeros((2, 2))
        for i in range(1, n):
            pull -= np.exp(fore[i - 1][:, None] + self.step + (e[i] + aft[i])[None] - z)
            pull[page[i - 1][1], page[i][1]] += 1
        return np.exp(fore[:, 1] + aft[:, 1] - z), pull

    def train(self, pages: list[list[tuple[list[str], int]]], rounds: int = 16, rate: float = 0.3, ridge: float = 1e-3) -> None:
        """AdaGrad on the log-likelihood, page by page."""
        seen: dict[str, float] = {}
        step_seen = np.full((2, 2), 1e-6)
        for _ in range(rounds):
            for page in pages:
                e = np.array([[0.0, sum(self.weight.get(f, 0.0) for f in fs)] for fs, _ in page])
                main, pull = self.expectations(e, page)
                pull -= ridge * self.step
                step_seen += pull**2
                self.step += rate * pull / np.sqrt(step_seen)
                for (fs, y), p in zip(page, main.tolist(), strict=True):
                    for f in fs:
                        g = y - p - ridge * self.weight.get(f, 0.0)
                        seen[f] = seen.get(f, 1e-6) + g * g
                        self.weight[f] = self.weight.get(f, 0.0) + rate * g / math.sqrt(seen[f])


def labelled_pages(n: int, seed: int = 5) -> list[tuple[str, list[str]]]:
    """Made pages, each with the texts of its main blocks. Layouts differ in elements, names, order and mistakes."""
    r = random.Random(seed)
    syllables = "an be co de el fi ga hu in jo ka lo mi no or pa qui ra su te um ve wi xa yo zu".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    said = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    line = lambda a=6, b=40: r.choice((" ", " ", " ", " | ")).join(said(a, b).capitalize().split()) + r.choice((".", ".", ".", "!", "?", "", "***", " |", " \u00b7"))
    pick = lambda *x: r.choice(x)
    made = lambda: pick(word(), f"{word()}-{word()}", f"{word()}{r.randint(1, 40)}", f"{word()}_{word()}")

    def named(kind, sure=0.85):
        """A class or id that says what the element is, with or without words of its own, or none."""
        if r.random() >= sure:
            return ""
        name = r.choice(NAMES[kind])
        return f' {pick("class", "id")}="{pick(name, name, f"{name} {made()}", f"{made()}-{name}", f"{name}-{made()}")}"'

    odd = lambda: pick("", "", f' class="{made()}"', f' id="{made()}"', f" class={made()}", f" data-x='{word()}' class=\"{made()} {made()}\"", " title=it's")
    items = lambda a, b: "".join(f'<li{odd() if r.random() < 0.2 else ""}><a href="/{word()}">{said(1, 4)}</a></li>' for _ in range(r.randint(a, b)))

    def menu():
        return pick(f"<nav{named('menu', 0.7)}><ul>{items(3, 9)}</ul></nav>", f"<div{named('menu', 1)}><ul>{items(3, 9)}</ul></div>", f"<header{named('head')}><nav><ul>{items(3, 9)}</ul></nav></header>", f"<ul{odd()}>{items(3, 9)}</ul>")

    def comments():
        each = "".join(pick(f'<div{named("comment", 0.7)}><p>{line()}</p></div>', f"<p>{line()}</p>", f'<div{odd()}><b>{word()}</b><p>{line()}</p><a href="#">{said(1, 2)}</a></div>') for _ in range(r.randint(1, 6)))
        return pick(f'<section{named("comment", 1)}><h2>{said(1, 3)}</h2>{each}</section>', f'<div{named("comment", 1)}>{each}</div>', f'<ol{named("comment", 1)}>{each}</ol>')

    def side():
        inner = pick(f"<h3>{said(1, 3)}</h3><p>{line(3, 25)}</p><ul>{items(1, 5)}</ul>", f"<p>{line(3, 25)}</p>", f"<p>{line(3, 25)}</p><a href='#'>{said(2, 5)}</a>")
        return pick(f"<aside{named('side', 0.5)}>{inner}</aside>", f"<div{named('side', 1)}>{inner}</div>")

    def boiler():
        sentence = line(3, 45)
        return pick(
            menu,
            lambda: f"<div{named('advert', 1)}>{sentence}</div>",
            lambda: f"<div{named('advert', 1)}><p>{sentence}</p></div>",
            side,
            lambda: f"<div{named('notice', 1)}><p>{sentence}</p><button>{word()}</button></div>",
            lambda: f"<div role={pick('dialog', 'alert', 'banner')}{named('notice', 0.5)}><p>{sentence}</p></div>",
            lambda: f"<form{named('form', 0.6)}><label>{said(1, 4)}</label><input name=q><p>{sentence}</p><button>{word()}</button></form>",
            lambda: f"<header{named('head')}><a href='/'>{said(1, 3)}</a><p>{said(2, 6)}</p></header>",
            comments,
            lambda: f"<p><a href='#'>{said(2, 6)}</a> | <a href='#'>{said(1, 3)}</a></p>",
        )()

    def foot():
        return pick(f"<footer{named('foot', 0.6)}>&copy; {word()}.example.com &middot; {line(3, 12)}</footer>", f'<div{named("foot", 1)}><p>&copy; {said(1, 3)} {line(3, 9)}</p><a href="#">{word()}</a></div>', f"<footer><p>{line(3, 20)}</p><ul>{items(1, 4)}</ul></footer>")

    out = []
    for _ in range(n):
        main: list[str] = []

        def say(text, main=main):
            main.append(text)
            return text

        body = []
        short = r.random() < 0.3  # an article of hardly more than its title
        heading = say(said(1, 3).capitalize() + pick("", ".", ".", "!!!", "***", "#") if short else said(2, 12).capitalize())
        body.append(pick(f"<h1>{heading}</h1>", f"<h1{named('title')}>{heading}</h1>", f"<header><h1>{heading}</h1></header>"))
        for _ in range(1 if short else r.randint(1, 12)):
            body.append(pick(
                lambda: f"<p>{say(line(1, 6) if short else line(4, 120))}</p>",
                lambda: f"<p>{say(line(1, 8))}</p>",
                lambda: f"<p>{say(line(4, 60))}",
                lambda: f"<p><b>{say(heading if short else line(2, 30))}<br>",
                lambda: f"<h2>{say(said(1, 7))}</h2>",
                lambda: f"<blockquote>{say(line())}</blockquote>",
                lambda: "<ul>" + "".join(f"<li>{say(line(2, 14))}</li>" for _ in range(r.randint(1, 5))) + "</ul>",
                lambda: f"<div>{say(line(5, 60))}</div>",
                lambda: f"<pre>{say(said(3, 12))}</pre>",
                lambda: "<table><tr>" + "".join(f"<td>{say(said(1, 4))}</td>" for _ in range(r.randint(1, 4))) + "</tr></table>",
                lambda: f"<figure><img src=x><figcaption>{say(line(3, 9))}</figcaption></figure>",
            )())
            if r.random() < 0.06:
                body.append(pick(lambda: f"<div{named('advert', 1)}>{line(3, 12)}</div>", side, lambda: f"<div{named('share', 1)}>{items(2, 4)}</div>", lambda: f"<form{named('form', 0.6)}><p>{line(3, 12)}</p><button>{word()}</button></form>")())
        if r.random() < 0.2:
            body.append(comments())
        frame = pick(
            lambda: f"<article{named('main')}>{{}}</article>",
            lambda: f"<main><article{named('main')}>{{}}</article></main>",
            lambda: f"<main{odd()}>{{}}</main>",
            lambda: f"<div{named('main', 1)}>{{}}</div>",
            lambda: f'<div id="main"><div{named("main", 1)}>{{}}</div></div>',
            lambda: f"<section{named('main', 1)}>{{}}</section>",
            lambda: f'<div id="{made()}"><div id="{made()}">{{}}</div></div>',
            lambda: f"<div{odd()}><div{odd()}><div{odd()}>{{}}</div></div></div>",
        )().format("".join(body))
        before = "".join(boiler() for _ in range(r.randint(0, 3)))
        after = "".join(boiler() for _ in range(r.randint(0, 3)))
        title = f"<head><meta charset=utf-8><title>{heading[:60]}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        page = f"<!DOCTYPE html><html>{title}<body>{menu() if r.random() < 0.8 else ''}<!-- {word()} -->{before}{frame}{after}{foot() if r.random() < 0.9 else ''}" + pick("</body></html>", "")
        out.append((page, main))
    return out


def training_set(pages: list[tuple[str, list[str]]]) -> list[list[tuple[list[str], int]]]:
    """Features and labels of the blocks of labelled pages."""
    out = []
    for page, main in pages:
        rest, rows = list(main), []
        for b in leaf_blocks(page):
            y = int(bool(rest) and b.text == " ".join(html.unescape(rest[0]).split()) and "title" not in b.above[-1:])
            if y:
                rest.pop(0)
            rows.append(([*above_features(b.above), *own_features(b)], y))
        out.append(rows)
    return out


@lru_cache(maxsize=2)
def trained(pages: int = 800, seed: int = 5) -> Field:
    """The field fitted on that many made pages; the same wherever it is fitted."""
    f = Field()
    f.train(training_set(labelled_pages(pages, seed)))
    return f


def main_text(page: str | None, field: Field) -> str:
    """The main blocks of a page, in order, a line each."""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, field.decode(blocks), strict=True) if y)


def extract(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", field: Field | None = None) -> DataFrame:
    """One row per row of pages: id, url, text (empty if there is none), n_chars (code points of the text).

    Null and empty pages have no text; pages are read whole, however long; repeated rows are extracted each; only
    the three columns are read; an empty table gives an empty result."""
    text_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(field or trained())
    narrow = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches):
        for b in batches:
            texts = [main_text(h, shared.value) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["id", "url", "text", "n_chars"])

    schema = T.StructType([narrow.schema["id"], narrow.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
