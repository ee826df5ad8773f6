"""Alignment of tokens, extraction of main texts and periodic runs, against plain code and on odd tables."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from faultgrain.llm import html_extraction as H
from faultgrain.llm import periodic_runs as R
from faultgrain.llm import queries as Q
from faultgrain.llm import token_alignment as T

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, chunk long, n_docs string, pair long, start string"


def sha(x: bytes | str) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


# --- periodic runs


def plain_runs(s: list, least: int = 24, times: int = 3) -> list[tuple]:
    """(start, length, period) by looking at every period."""
    found, n = set(), len(s)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and s[j] == s[j + q]:
                j += 1
            length = j - i + q
            part = s[i : i + length]
            if length >= max(least, times * q) and not any(part[d:] == part[: length - d] for d in range(1, q)):
                found.add((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text) -> tuple:
    words = (text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = (None,) * 4
    if found:
        s, length, q = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        best = (s, length, q, 1000 * length // q)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return len(found), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def repetitive(r: random.Random, n: int) -> list[int]:
    out: list[int] = []
    while len(out) < n:
        u = [r.randrange(r.choice([2, 3, 5])) for _ in range(r.randrange(1, 12))]
        out += u * r.choice([1, 1, 2, 4, 9]) + u[: r.randrange(len(u))]
    return out


def test_lyndon_lengths_equal_their_definition():
    r = random.Random(3)
    for _ in range(200):
        s = [r.randrange(r.choice([1, 2, 4])) for _ in range(r.randrange(1, 25))]
        for sign in (1, -1):
            t = [sign * x for x in s]
            want = [max(j - i for j in range(i + 1, len(t) + 1) if all(t[i:j] < t[k:j] for k in range(i + 1, j))) for i in range(len(t))]
            assert R.lyndon_lengths(s, falling=sign < 0) == want


def test_runs_equal_plain_ones():
    r = random.Random(4)
    for _ in range(300):
        s = repetitive(r, r.randrange(5, 160))
        for least in (24, 6):
            assert list(map(tuple, R.qualified_runs(np.array(s), least=least).tolist())) == plain_runs(s, least)


def test_a_long_stretch_costs_in_proportion():
    import time

    def cost(n: int) -> float:
        s = np.array([hash((i // 7 % 5, i % 11, i // 3000)) % 9 for i in range(n)])
        began = time.process_time()
        R.qualified_runs(np.concatenate((s, s)))
        return time.process_time() - began

    cost(1000)
    assert cost(80_000) < 3.5 * cost(40_000) + 0.5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_runs_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in Q.op13_periodic_runs(spark, DATA).collect()}
    assert len(got) == len(rows) and any(r[0] for r in got.values())
    for doc_id, text in rows:
        if len((text or "").split()) < 3000:
            assert got[doc_id] == plain_row(doc_id, text)


def odd_rows() -> list[tuple]:
    r = random.Random(5)
    again = " ".join(f"w{x}" for x in repetitive(r, 300))
    texts = [None, "", " \n\t", "x", again, again, "a " * 100_000, "é" * 3000, " b  c\r\nd\x0be\x0cf\x1c g", "  nbsp em", "a▁b", "<|endoftext|> <s>"]
    rows = [(i, t, 1, "x", 2, "y") for i, t in enumerate(texts)]
    return [*rows, rows[4], rows[0], (None, again, None, None, None, None), (None, None, None, None, None, None)]


def test_runs_of_odd_rows(spark):
    rows = odd_rows()
    got = R.periodic_runs(spark.createDataFrame(rows, SCHEMA), plant=True).collect()
    small = lambda t: len(t or "") < 100_000
    want = Counter(map(repr, ((d, *plain_row(d, t)) for d, t, *_ in rows if small(t))))
    long = [r for r in got if r.doc_id == 6]
    assert Counter(repr(tuple(r)[:8]) for r in got if r.doc_id != 6) == want
    assert [(r.n_runs, r.start, r.length, r.period, r.collapsed) for r in long] == [(1, 0, 100_000, 1, "a")]
    assert R.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


# --- alignment of tokens


def plain_alignment(rows: list[tuple]) -> dict:
    """(number of the row): results, from whole texts at once."""
    own = T.aligner(Q.model_path("byte_bpe_50k.json"), Q.model_path())
    count, docs = Counter(), []
    for _, t in rows:
        a = own.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = own.b.encode(t) if t else []
        x, y = [own.a_bytes[i] for i in a], [own.b_bytes[i] for i in b]
        if not t or b"".join(x) != (" " + t).encode() or b"".join(y) != (" " + t).encode():
            docs.append(None)
            continue
        ends = [np.cumsum(list(map(len, z))).tolist() for z in (x, y)]
        common = np.array(sorted(set(ends[0]) & set(ends[1])))
        place = lambda e: int(np.searchsorted(common, e))
        groups = [([], []) for _ in common]
        for side, ids in enumerate((a, b)):
            for i, e in zip(ids, ends[side], strict=True):
                groups[place(e)][side].append(str(i))
        links, j = [], 0
        for i, e in zip(range(len(a)), ends[0], strict=True):
            while ends[1][j] <= e - len(x[i]):
                j += 1
            k = j
            while k < len(b) and ends[1][k] - len(y[k]) < e:
                links.append((a[i], b[k]))
                k += 1
        docs.append((len(a), len(b), len(common), links, sha(";".join(",".join(g) + "|" + ",".join(h) for g, h in groups))))
        count.update(set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    none = (0, 0, 0, 0, 0, 0, "")
    return count, best, [none if d is None else (*d[:3], len(d[3]), sum(count[p] == best[p[0]] for p in d[3]), sum(count[p] for p in d[3]), d[4]) for d in docs]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_alignment_of_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in Q.op11_token_alignment(spark, DATA).collect()}
    want = plain_alignment(rows)[2]
    assert got == {d: w for (d, _), w in zip(rows, want, strict=True)}


def test_alignment_of_odd_rows_in_many_chunks(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    paths = Q.model_path("byte_bpe_50k.json"), Q.model_path()
    count, best, want = plain_alignment([(d, t) for d, t, *_ in rows])
    for most in (T.CHUNK_LINKS, 50):
        got = T.align_tokens(df, *paths, chunk_links=most).collect()
        assert Counter(map(repr, map(tuple, got))) == Counter(repr((d, *w)) for (d, *_), w in zip(rows, want, strict=True))
    pairs = T.aligned_pairs(df, *paths, chunk_links=50).collect()
    assert {(r.a, r.b): (r.n_docs, r.best) for r in pairs} == {p: (n, n == best[p[0]]) for p, n in count.items()}
    assert sum(r.n_links for r in pairs) == sum(w[3] for w in want)
    assert T.align_tokens(spark.createDataFrame([], SCHEMA), *paths).count() == 0


def test_packed_bitmaps_come_back():
    r = np.random.default_rng(1)
    flags = r.random((40, T.CHUNK_DOCS)) < r.choice([0.001, 0.05, 0.2, 0.9], (40, 1))
    pair, doc = np.nonzero(flags)
    back = np.zeros_like(flags)
    back[T.unpacked(*T.packed(pair, doc, 40))] = True
    assert (back == flags).all()


# --- main texts


def page(body: str, title: str = "t") -> str:
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style></head><body>{body}</body></html>"


def test_landmarks():
    cases = {
        "<nav><a>menu</a></nav><article><header><h1>A &amp; B</h1></header><p>one<br>two&nbsp;x<p>three <b>four</article><footer>f</footer>": "A & B\n\none two x\n\nthree four",
        "<main><p>keep</p><div class='ad'>buy</div><form><p>name</p></form><section id=comments><article class=comment><p>first!</p></article></section></main>": "keep",
        "<div class='page with-sidebar'><article><p>inside</p></article></div><aside>a</aside>": "inside",
        "<h1>Head</h1><article><p>a body of the article</p></article><div>loose</div>": "Head\n\na body of the article",
        "<p>a < b &lt; c &am d</p><script>if (a<b) x('</p>')</script><p title='>'>e": "a < b < c &am d\n\ne",
        "<div class=cookie-notice>we use cookies</div><p>text</p><div hidden>no</div><!-- <p>never</p> -->": "text",
    }
    for body, want in cases.items():
        assert H.main_text(H.lines_of(page(body)), set()) == want, body
    assert H.main_text(H.lines_of(""), set()) == ""
    assert H.main_text(H.lines_of("<p>cut <b"), set()) == H.main_text(H.lines_of("<p>cut <a href='x"), set()) == "cut"


def test_common_lines_are_longest():
    r = random.Random(6)

    def length(a: list, b: list) -> int:
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for _ in range(500):
        a, b = ([r.randrange(4) for _ in range(r.randrange(14))] for _ in range(2))
        at, rest = H.common_lines(a, b), iter(b)
        assert at == sorted(set(at)) and len(at) == length(a, b) and all(any(y == a[k] for y in rest) for k in at)


def test_what_a_page_shares_with_its_neighbour_goes(spark):
    """Plain blocks without landmarks, over 600 pages of one host: more than a block, so partners cross it."""
    site = lambda k: f"<div>Home</div><div>About the site</div><div>Story {k} begins here with words of its own, number {k * k}.</div><div>Second part of {k}.</div><div>All rights of this site are reserved</div>"
    rows = [(k, f"https://a.example/{k // 50}/{k:04d}?x={k}", page(site(k)), "c") for k in range(600)]
    rows += [(1000, "https://b.example/1", page(site(1)), None), (1001, None, page(site(2)), None), (1002, "https://c.example/1", None, None), (1003, "https://c.example/2", "", None), (1004, "::bad[", "<p>x", None)]
    rows += [rows[5], (None, rows[6][1], rows[6][2], None)]
    got = H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, k_id string").repartition(7)).collect()
    own = lambda k: f"Story {k} begins here with words of its own, number {k * k}.\n\nSecond part of {k}."
    whole = lambda k: f"Home\n\nAbout the site\n\n{own(k)}\n\nAll rights of this site are reserved"
    want = [(k, own(k)) for k in range(600)] + [(1000, whole(1)), (1001, whole(2)), (1002, ""), (1003, ""), (1004, "x"), (5, own(5)), (None, own(6))]
    assert sorted(map(repr, ((r.page_id, r.text) for r in got))) == sorted(map(repr, want))
    assert all(r.n_chars == len(r.text) for r in got) and {r.url for r in got} == {r[1] for r in rows}
    assert H.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_with_landmarks_are_aligned_too(spark):
    """What a site repeats goes before landmarks judge the rest; articles keep what they share."""
    quote = "A saying that every story of this site quotes in full."
    about = "".join(f"<div>Section {x} of all that this site has ever told.</div>" for x in "abcdef")
    own = lambda k: f"Its own words, which are more than any other line of the page has, {k} and {k * k}."
    site = lambda k: f"<h1>The Daily Site</h1>{about}<div>Loose {k}</div><article><h2>Story {k}</h2><p>{quote}</p><p>{own(k)}</p></article>"
    rows = [(k, f"https://a.example/{k:02d}", page(site(k))) for k in range(40)] + [(99, "https://b.example/1", page("<h1>Alone</h1>" + site(99)))]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: got[k] for k in range(40)} == {k: f"Story {k}\n\n{quote}\n\n{own(k)}" for k in range(40)}
    assert got[99].startswith("Alone\n\nThe Daily Site\n\nSection a of")  # without a partner nothing is known to be repeated


def test_copies_are_no_partners(spark):
    body = "<div>Menu</div><div>The whole of a long story that two addresses of one host show alike.</div>"
    rows = [(1, "http://a.example/x/1", page(body)), (2, "http://a.example/x/2", page(body)), (3, "http://a.example/x/3", page("<div>Menu</div><div>Another story, not the one that the others tell.</div>"))]
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == got[2] == "The whole of a long story that two addresses of one host show alike."


@pytest.mark.parametrize("copies", [20, 700])
def test_partners_beyond_any_number_of_copies(spark, copies):
    """What the site repeats goes from every copy, however far the nearest other page is: it was kept where all of the eight next were copies."""
    story = "The whole of a long story that many addresses of one host show alike."
    text = lambda k: story if k < copies else f"Another story, number {k}, not the one that all the others tell."
    rows = [(k, f"http://a.example/x/{k:04d}", page(f"<div>Menu</div><div>{text(k)}</div>")) for k in range(copies + 2)]
    rows += [(-1 - k, f"http://b.example/{k:04d}", page(f"<div>Menu</div><div>{story}</div>")) for k in range(30)]  # copies alone
    got = {r.page_id: r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got == {k: text(k) for k in range(copies + 2)} | {-1 - k: f"Menu\n\n{story}" for k in range(30)}


def test_partners_equal_plain_ones(spark):
    """Runs of copies and near copies of all lengths in folders of several depths, against the best of all pages of the host."""
    r = random.Random(11)
    rows, k = [], 0
    while k < 1600:
        host, folder = f"{r.choice('ab')}.example", "/".join(r.choice(["a", "a-b", "b"]) for _ in range(r.randrange(1, 4)))
        own = [f"line {r.randrange(60)} of it" for _ in range(r.randrange(2, 7))]
        for _ in range(r.choice([1, 2, 30, 500])):
            lines = [f"site {x}" for x in "xyz" if r.random() < 0.9] + (own if r.random() < 0.7 else [f"line {r.randrange(60)} of it", *own[1:]])
            rows.append((k, f"http://{host}/{folder}/{k:05d}", page("".join(f"<div>{x}</div>" for x in lines))))
            k += 1
    for x in rows[::97]:  # a page without text is nobody's copy and has none
        rows.append((k, x[1] + "-none", page("")))
        k += 1
    parsed = {i: ([(len(t), t) for t, _, _ in H.lines_of(html)], *H.place(url)) for i, url, html in rows}
    hashed = {i: [(n, H._hash(t)) for n, t in x[0]] for i, x in parsed.items()}
    order = sorted(parsed, key=lambda i: (parsed[i][1], parsed[i][2].split("/")))
    place = {i: n for n, i in enumerate(order)}

    def copies(a: int, b: int) -> bool:
        there = {h for _, h in hashed[b]}
        return bool(hashed[a]) and max(hashed[a])[1] in there and 4 * sum(n for n, h in hashed[a] if h in there) >= 3 * sum(n for n, _ in hashed[a])

    def rank(a: int, b: int) -> tuple:
        x, y = (parsed[i][2].split("/") for i in (a, b))
        same = next((n for n, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
        return -same, abs(place[a] - place[b]), place[b] > place[a]

    want = {}
    for a in r.sample(order, 400):
        near = min((b for b in order if b != a and parsed[b][1] == parsed[a][1] and not copies(a, b)), key=lambda b: rank(a, b), default=None)
        gone = H.common_lines(*([h for _, h in hashed[i]] for i in (a, near))) if near is not None else []
        want[a] = H.main_text(H.lines_of(rows[a][2]), set(gone))
    got = {x.page_id: x.text for x in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert {i: got[i] for i in want} == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_texts_of_the_whole_table(spark):
    """The given pages have one article each, of a heading and paragraphs, perhaps cut off."""
    import html
    import re

    rows = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = Q.op12_html_extraction(spark, DATA).collect()
    assert len(got) == len(rows)
    for r in got:
        inside = re.search(r"<article>(.*?)(</article>|\Z)", rows[r.page_id].html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:h1|p)>", inside)]
        assert (r.url, r.text) == (rows[r.page_id].url, "\n\n".join(p for p in parts if p))
