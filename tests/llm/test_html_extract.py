import random

import numpy as np
import pytest
from strandloom.llm import html_extract as hx


def kept(page):
    return [t for t, o, m in hx.blocks_of(page) if not o]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a<p>b<br>c</p>d", ["a", "b c", "d"]),
        ("<p><b>x<br><p>y &lt;z&gt; &nbsp; q</p>", ["x", "y <z> q"]),
        ("<nav><ul><li>m</nav><article><h1>t</h1><p>b</p></article><footer>f", ["t", "b"]),
        ("<script>var t='</p>';</script><style>p{}</style><p>ok<!-- no <p> --></p>", ["ok"]),
        ('<div class="ad">x</div><div class="cookie-notice"><p>y</p></div><div class="shadow">keep</div>', ["keep"]),
        ("<form><p>name</p><input></form><aside>s</aside><header><h1>site</h1></header><p>k", ["k"]),
        ('<section id="comments"><p>c</p></section><div role="navigation">n</div><p title="a > b">k</p>', ["k"]),
        ("<head><title>t</title><meta x></head><body class='nav'><p>a</p><p", ["a"]),
        ("5 < 6 <3 > & &#x41;&#66;&unknown;", ["5 < 6 <3 > & AB&unknown;"]),
        ("<table><tr><td>a<td>b</table><pre> x\n y </pre>", ["a", "b", "x y"]),
        ("<!-- open <p>a", []),
        ("<P CLASS=AD>x</P><DIV>y</DIV>", ["y"]),
    ],
)
def test_blocks(page, want):
    assert kept(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ("<datalist><option value=a><option value=b></datalist><article>x</article>", ["x"]),
        ("<div><select><option>a<option>b</select></div><p>x", ["x"]),
        ("<svg><text>i<article>x</article>", ["i", "x"]),
        ("<div><object>i</div><article>x</article><object>j</object>", ["x"]),
        ("<noscript><article>x</article>", ["x"]),
        ("<p>a<svg><text>i</text></svg>b<noscript><p>n</p></noscript>c<template><div>t</div></template></p>", ["ab", "c"]),
        ("<div><svg></div><p>x</p><svg><path/></svg><p>y", ["x", "y"]),
    ],
)
def test_hidden_elements_end_with_their_parents(page, want):
    assert kept(page) == want


def test_runs_match_brute_force():
    rnd = random.Random(4)
    page = np.repeat(np.arange(30), [rnd.randrange(0, 40) for _ in range(30)])
    tokens = np.array([rnd.randrange(3) for _ in page], np.uint64)
    for run in (1, 2, 3, 5, 8):
        inside, again = hx.repeated_runs(tokens, page, run)
        seen = {}
        for i in range(len(page) - run + 1):
            if page[i] == page[i + run - 1]:
                seen.setdefault(tuple(tokens[i : i + run]), set()).add(page[i])
        for i in range(len(page)):
            ok = i + run <= len(page) and page[i] == page[i + run - 1]
            assert inside[i] == ok and again[i] == (ok and len(seen[tuple(tokens[i : i + run])]) > 1)


def pages():
    words = random.Random(2)
    text = lambda n: " ".join(f"w{words.randrange(10**6)}" for _ in range(n))
    rows, want = [], []
    for i in range(40):
        host = "big.example" if i % 3 else f"h{i}.example"
        body, menu = [text(12), text(3), text(20)], "Home About our small company Contact"
        rows.append((i, f"https://{host}/{i}", f"<body><div>{menu}</div><div><p>{body[0]}</p><p>{body[1]}</p></div><p>{body[2]}</p><div>All rights reserved by the owner of this</div>"))
        alone = host != "big.example"
        want.append((i, "\n".join([menu] * alone + body + ["All rights reserved by the owner of this"] * alone)))
    rows += [(100, None, None), (101, "not a url", ""), (102, "https://big.example/x", "<nav>a</nav><article><p>same words in two articles here</p></article>"), (103, "https://big.example/y", "<main><p>same words in two articles here</p></main>")]
    return rows, want + [(100, ""), (101, ""), (102, "same words in two articles here"), (103, "same words in two articles here")]


@pytest.mark.parametrize("tokens", [500_000, 60])
def test_extract(spark, monkeypatch, tokens):
    monkeypatch.setattr(hx, "_GROUP_TOKENS", tokens)
    rows, want = pages()
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string").repartition(3)
    got = hx.extract(df).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got) and {r["url"] for r in got} == {r[1] for r in rows}


def test_empty_and_repeated(spark):
    schema = "page_id long, url string, html string"
    assert hx.extract(spark.createDataFrame([], schema)).count() == 0
    got = hx.extract(spark.createDataFrame([(1, "http://a/", "<article>x y z</article>")] * 2 + [(None, "http://b/", "x" * 200000)], schema)).collect()
    assert sorted(str((r["page_id"], len(r["text"]))) for r in got) == ["(1, 5)", "(1, 5)", "(None, 200000)"]


def prose(rnd, n):
    return " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))


def extracted(spark, rows):
    return {r["page_id"]: r["text"] for r in hx.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}


@pytest.mark.parametrize("tokens", [500_000, 400])
def test_repeats_inside_articles(spark, monkeypatch, tokens):
    monkeypatch.setattr(hx, "_GROUP_TOKENS", tokens)
    rnd = random.Random(7)
    box = prose(rnd, 12)
    rows, want = [], {}
    for i in range(16):  # the host's subscription line, without a telling name, in every article
        body = prose(rnd, 30)
        rows.append((i, "http://a.example/", f"<article><p>{body}</p><div>{box}</div></article>"))
        want[i] = body
    assert extracted(spark, rows) == want


@pytest.mark.parametrize("tokens", [500_000, 150])
def test_splitting_a_host_changes_nothing(spark, monkeypatch, tokens):
    """Three pages of a host share a text, in whatever groups they are."""
    monkeypatch.setattr(hx, "_GROUP_TOKENS", tokens)
    rnd = random.Random(11)
    rows, want = [], {}
    for k in range(12):
        menu = prose(rnd, 8)
        for i in range(3):
            body = prose(rnd, 25)
            rows.append((3 * k + i, "http://d.example/", f"<div>{menu}</div><p>{body}</p>"))
            want[3 * k + i] = body
    assert extracted(spark, rows) == want


def test_only_covered_parts_go_and_copies_stay(spark):
    rnd = random.Random(8)
    quote = prose(rnd, 40)
    rows, want = [], {}
    for i in range(20, 24):  # one block of repeated and new words
        own = prose(rnd, 40)
        rows.append((i, "http://b.example/", f"<p>{quote} {own}</p><p>{prose(rnd, 1)}</p>"))
        want[i] = own + "\n" + rows[-1][2].split("<p>")[-1][:-4]
    copy = prose(rnd, 80)
    for i in range(30, 36):  # copies of one text are no boilerplate
        rows.append((i, "http://c.example/", f"<p>{copy}</p>"))
        want[i] = copy
    assert extracted(spark, rows) == want


def test_packed_values_come_back():
    rnd = random.Random(3)
    for bits in (4, 40, 63):
        values = np.sort(np.array([rnd.randrange(2**bits) for _ in range(300)], np.uint64))
        assert (hx.unpack_sorted(hx.pack_sorted(values)) == values).all()
        for ranges in (1, 7, 1000):
            parts = hx._cut(values, ranges, bits)
            assert (np.concatenate([v for _, v in parts]) == values).all() and all(0 <= r < ranges for r, _ in parts) and len({r for r, _ in parts}) == len(parts)
    assert hx._cut(values[:0], 5, 40) == []


def test_a_host_in_many_groups_gives_what_one_group_gives(spark, monkeypatch):
    """Runs of two to twelve pages, in and outside articles, some of them copies: the same texts whether the host is split or not."""
    rnd = random.Random(19)
    rows, shared = [], [prose(rnd, rnd.choice((6, 25))) for _ in range(12)]
    for i in range(90):
        blocks = [prose(rnd, 15)] + [b for k, b in enumerate(shared) if rnd.random() < (k + 1) / 60]
        rnd.shuffle(blocks)
        page = "".join(f"<p>{b}</p>" for b in blocks)
        rows += [(10 * i + c, "http://e.example/", f"<article>{page}</article>" if i % 2 else page) for c in range(3 if i % 9 == 0 else 1)]
    whole = extracted(spark, rows)
    monkeypatch.setattr(hx, "_GROUP_TOKENS", 200)
    assert extracted(spark, rows) == whole and len({len(t.split()) for t in whole.values()}) > 3


def test_edited_copies_stay(spark):
    """Pages that differ by a word or two from one another have no boilerplate, in or outside articles."""
    rnd = random.Random(23)
    rows, want = [], {}
    for k, form in enumerate(("<p>{}</p>", "<article>{}</article>")):
        base = prose(rnd, 100).split()
        for i in range(30):
            words = list(base)
            words[rnd.randrange(100)] = f"x{i}"
            want[100 * k + i] = " ".join(words)
            rows.append((100 * k + i, "http://f.example/", form.format(want[100 * k + i])))
    assert extracted(spark, rows) == want


@pytest.mark.parametrize("tokens", [500_000, 300])
def test_a_notice_goes_however_much_it_dominates(spark, monkeypatch, tokens):
    """One notice of 60 words on all pages of a host, beside 20 to 200 words of their own, on hosts of three pages and more."""
    monkeypatch.setattr(hx, "_GROUP_TOKENS", tokens)
    rnd = random.Random(29)
    rows, want = [], {}
    for k, (n, pages) in enumerate([(200, 40), (100, 40), (50, 40), (30, 40), (20, 40), (40, 3), (40, 5), (40, 9), (40, 2)]):
        notice = prose(rnd, 60)
        for i in range(pages):
            own = prose(rnd, n)
            rows.append((1000 * k + i, f"http://n{k}.example/", f"<article><p>{own}</p><p>{notice}</p></article>"))
            want[1000 * k + i] = own if pages > 2 else f"{own}\n{notice}"  # two pages do not tell a notice from a quotation
    assert extracted(spark, rows) == want


def test_copies_with_edits_keep_shared_text(spark):
    """Copies with four edits in a hundred words, and a copy with a short addition."""
    rnd = random.Random(31)
    base, rows, want = prose(rnd, 200).split(), [], {}
    for i in range(24):
        words = list(base)
        for k in rnd.sample(range(200), 8):
            words[k] = prose(rnd, 1)
        want[i] = " ".join(words + prose(rnd, i % 12).split())
        rows.append((i, "http://g.example/", f"<article><p>{want[i]}</p></article>"))
    assert extracted(spark, rows) == want


def test_names_inside_articles():
    """Names at headings, passages and sections of an article are content; adverts, comments and menus in it are not."""
    shown = lambda page: [t for t, o, m in hx.blocks_of(page) if m and not o]
    assert shown('<article><h2 id="related-work">Related work</h2><p>a</p><div class="promotion-effects">b</div><p>x</article>') == ["Related work", "a", "b", "x"]
    assert shown('<article><div class="article-header"><h1>Title</h1></div><section id="discussion"><p>d</p></section><header><p>by</p></header></article>') == ["Title", "d", "by"]
    assert shown('<main><p>a</p><div class="ad">b</div><section id="comments"><p>c</p></section><nav>d</nav><form>e</form><footer>f</footer><p class="comments">g</p></main>') == ["a", "g"]
    assert [t for t, o, _ in hx.blocks_of('<div class="site-header">a</div><p>b</p><div id="related-links">c</div>') if not o] == ["b"]

