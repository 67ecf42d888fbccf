import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from recallforge.llm import html, mixing, packing, token_files
from recallforge.llm.common import table
from recallforge.llm.tokenize import Encoder
from tests.conftest import SMALL
from tests.llm.conftest import ODD

FILES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]


@pytest.mark.parametrize("name,spaced", FILES)
def test_ids_equal_those_of_the_whole_text(name, spaced):
    ours, theirs, r = Encoder(P.path(name), spaced), Tokenizer.from_file(P.path(name)), random.Random(1)
    parts = ["a", "don't", "'s", "It's,", "12.", "é́", "́a", "<|endoftext|>", "x<|endoftext|>y!", "\n", "b\nc", "ΑΣ", "\0q", "Straße&&&", "ÀÉÿ|", "the!!", "#$*", "  ", "\t", "ªº²", "İ.", "\x1c", "\x85"]
    texts = [r.choice([" ", "", "\n"]).join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(3000)] + [t for t in ODD if t and len(t) < 999]
    want = [np.array(theirs.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert ours.encode(texts) == want and ours.encode(texts) == want


@pytest.mark.parametrize("name,spaced", FILES)
def test_ids_around_every_white_space(name, spaced):
    ours, theirs = Encoder(P.path(name), spaced), Tokenizer.from_file(P.path(name))
    blanks = ["\0", *(c for c in map(chr, range(0x10000)) if c.isspace())]
    texts = [t for c in blanks for t in (f"one{c}two, three", f"one {c}two", f"one{c}\ntwo", f"{c}one", f"one{c}", c, f"one{c}two{c}the.")] + ["", " ", "\n", "one two\nthree"]
    assert ours.encode(texts) == [np.array(theirs.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert ours.encode([]) == [] and ours.encode(["", ""]) == [b"", b""]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check_packing(rows, ids_of, capacity=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    for i, ids in ids_of.items():
        rs, at = sorted(by_doc[i], key=lambda r: r.piece), 0
        for k, r in enumerate(rs):
            assert (r.piece, r.start, r.ids_crc32) == (k, at, crc(ids[at : at + r.length]))
            assert k == 0 or r.length == capacity
            at += r.length
        assert at == len(ids) and (len(rs) == 1 or len(ids) > capacity) and len(rs) == -(-len(ids) // capacity)
    return len(by_seq)


def test_packing(spark, docs):
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    d = table(spark, SMALL, "documents")
    ids = {r.doc_id: tok.encode(r.text, add_special_tokens=False).ids + [2] for r in d.collect()}
    used = check_packing(packing.pack(d, P.path("byte_bpe_50k.json")).collect(), ids)
    assert used <= -(-sum(map(len, ids.values())) // 1024) + 4
    odd = {i: tok.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(ODD)}
    check_packing(packing.pack(docs(*ODD), P.path("byte_bpe_50k.json")).collect(), odd)
    assert packing.pack(docs("a").where("false"), P.path("byte_bpe_50k.json")).collect() == []
    assert len(packing.pack(docs("a", "a", None, ids=[1, 1, None]), P.path("byte_bpe_50k.json")).collect()) == 3


def test_fullest_combination():
    r = random.Random(0)
    for _ in range(300):
        counts, room = {r.randint(1, 40): r.randint(1, 3) for _ in range(r.randint(1, 6))}, r.randint(0, 60)
        got, sums = packing.fullest(counts, room), {0}
        for k, n in counts.items():
            for _ in range(n):
                sums |= {s + k for s in sums}
        assert sum(got) == max(s for s in sums if s <= room) and all(got.count(k) <= counts[k] for k in got)


def test_plan_uses_every_piece():
    r = random.Random(2)
    counts = {r.randint(1, 1024): r.randint(1, 50) for _ in range(200)}
    bins, used = packing.plan(counts), defaultdict(int)
    for b, n in bins:
        assert sum(b) <= 1024
        for k in b:
            used[k] += n
    assert dict(used) == counts


def test_frames():
    r = np.random.default_rng(0)
    for n in (0, 1, 5, 70_000):
        ids = [r.zipf(1.3, size=int(k)).clip(0, 2**32 - 1).astype("<u4").tobytes() for k in r.multinomial(n, [0.2, 0, 0.5, 0.3])]
        docs = [5, None, -7, 2**62]
        raw = token_files.encode_frame(docs, ids, 3, 9)
        task, frame, names, sizes, got, at = token_files.decode_frame(memoryview(b"xx" + raw + b"\n"), 2)
        assert (task, frame, names, at) == (3, 9, docs, len(raw) + 2)
        assert got.astype("<u4").tobytes() == b"".join(ids) and sizes.tolist() == [len(x) // 4 for x in ids]
    with pytest.raises(ValueError):
        token_files.decode_frame(memoryview(b"\0" * 200))


def test_token_files(spark, docs, monkeypatch):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    monkeypatch.setattr(token_files, "FRAMES_PER_FILE", 2)

    def want(rows):
        at = 0
        for i, t in rows:
            ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
            yield i, at, len(ids), crc(ids)
            at += len(ids)

    d = table(spark, SMALL, "documents")
    rows = sorted((r.doc_id, r.text) for r in d.collect())
    assert sorted(tuple(r) for r in token_files.encode(d, P.path("word_bpe_49k.json")).collect()) == list(want(rows))
    assert sorted(tuple(r) for r in token_files.encode(docs(*ODD), P.path("word_bpe_49k.json")).collect()) == list(want(enumerate(ODD)))
    assert token_files.encode(docs("a").where("false"), P.path("word_bpe_49k.json")).collect() == []
    got = token_files.encode(docs("a", "a b c", None, "a b", ids=[2, None, 2, 2]), P.path("word_bpe_49k.json")).collect()
    assert sum(r.n_tokens for r in got) == 10 and [r.start for r in got if r.doc_id is None] == [0]
    assert {r.start + r.n_tokens for r in got} == {r.start for r in got} - {0} | {10}


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Target words of each source, one source at a time; sources by code point, null last."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight, out, free = {s: weights[i % 3] for i, s in enumerate(order)}, {}, list(order)
    while free:
        share = (sum(sizes.values()) - sum(out.values())) / sum(weight[s] for s in free)
        over = {s: float(cap * sizes[s]) for s in free if weight[s] * share > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * share for s in free}
        out |= over
        free = [s for s in free if s not in out]
    return out


def test_targets(spark):
    r = random.Random(5)
    cases = [{"a": 10, "b": 10, "c": 10}, {None: 1, "a": 100, "b": 100}, {"a": 0}, {"x": 7, None: 0, "é": 5000, "z": 1}]
    cases += [{f"host{r.random()}": int(r.paretovariate(0.5)) for _ in range(500)}]
    for sizes in cases:
        df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(3)
        got, want = {x.source: x.target for x in mixing.with_targets(df).collect()}, targets(sizes)
        assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)
    assert mixing.with_targets(df.where("false")).collect() == []


def test_mixing(spark):
    for sf, near in ((SMALL, 0.03), ("/root/testdata/sf0.1", 0.002)):
        d = table(spark, sf, "documents")
        got = mixing.mix(d).collect()
        words = {r.doc_id: (r.source, len((r.text or "").encode().split())) for r in d.collect()}
        by = defaultdict(lambda: [0, 0, 0.0])
        for r in got:
            source, n = words[r.doc_id]
            assert r["size"] == n and r.taken <= 3 * n and r.taken % max(n, 1) == 0
            by[source][0] += n
            by[source][1] += r.taken
            by[source][2] = r.target
            assert r.source_size == sum(m for s, m in words.values() if s == source) if r.doc_id < 5 else True
        want = targets({s: v[0] for s, v in by.items()})
        for s, (n, taken, target) in by.items():
            assert abs(target - want[s]) < 1e-6 * max(1, target) and abs(taken - target) <= near * target
        assert sorted(tuple(r) for r in mixing.mix(d.repartition(5)).collect()) == sorted(map(tuple, got))


def test_closing_fills_the_gap_best():
    import pandas as pd

    r = np.random.default_rng(3)
    for _ in range(200):
        n = int(r.integers(1, 14))
        f = pd.DataFrame({"row": range(n), "size": r.integers(1, 60, n), "room": float(r.integers(0, 500)) + 0.4, "below": 7, "q": np.sort(r.random(n)), "u": 0.5, "h": 1, "doc_id": range(n)})
        got = set(mixing.close(f.sample(frac=1, random_state=1))["row"])
        room = f["room"][0] - 7
        fits = int((f["size"].cumsum() <= room).sum())
        first = max(0, fits - mixing.BACK)
        sums = {0}
        for k in f["size"][first:]:
            sums |= {x + k for x in sums}
        base = f["size"][:first].sum()
        assert set(range(first)) <= got
        gap = max(0, round(room - base))
        assert abs(f["size"][sorted(got)].sum() - base - gap) == min(abs(x - gap) for x in sums if x <= 2 * gap)


def test_closing_over_wide_gaps():
    import pandas as pd

    f = pd.DataFrame({"row": range(40), "size": [10**9 + 7**i % 10**8 for i in range(40)], "room": 2.5e10, "below": 0, "q": np.arange(40) / 40, "u": 0.5, "h": 1, "doc_id": range(40)})
    got = f["size"][sorted(mixing.close(f)["row"])].sum()
    assert abs(got - 2.5e10) < 72 * 2.5e10 / mixing.GRAIN


def test_the_draw_follows_pareto_ranks(spark):
    """Certain copies and ranks of every document, recomputed from the hashes one by one; the sample is the head of the ranks but for its end."""
    import math

    d = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "source")
    hashed = {x.doc_id: x for x in d.selectExpr("doc_id", "source", f"xxhash64(doc_id, xxhash64(text, {mixing.SEED}), source, {mixing.SEED}) AS u", "text").collect()}
    copies = {x.doc_id: x for x in mixing.copies(d).collect()}
    goal = targets({s: sum(c["size"] for i, c in copies.items() if hashed[i].source == s) for s in {h.source for h in hashed.values()}})
    for s in goal:
        mine = [c for i, c in copies.items() if hashed[i].source == s and c["size"]]
        n = sum(c["size"] for c in mine)
        whole = min(3, math.floor(goal[s] / n + 1e-12))
        room = goal[s] - whole * n
        assert all(c.copies in (whole, whole + 1) for c in mine)
        if whole == 3 or room <= 0:
            continue
        x = {c.doc_id: 2 ** (-math.floor(math.log2(c["size"])) / mixing.TEMPER) for c in mine}
        low, high = 0.0, 1e9
        for _ in range(200):
            k = (low + high) / 2
            low, high = (k, high) if sum(c["size"] * min(1, k * x[c.doc_id]) for c in mine) < room else (low, k)

        def rank(c):
            u, p = (((hashed[c.doc_id].u & (2**64 - 1)) >> 11) + 0.5) / 2**53, min(1, high * x[c.doc_id])
            return (0.0 if p >= 1 else u / (1 - u) * (1 - p) / p), u

        mine.sort(key=rank)
        fits = 0
        while fits < len(mine) and sum(c["size"] for c in mine[: fits + 1]) <= room:
            fits += 1
        assert all(c.copies > whole for c in mine[: max(0, fits - mixing.BACK)]) and all(c.copies == whole for c in mine[fits + mixing.SPARE :])


def test_inclusion_follows_the_odds(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 64)), "a" if i % 2 else "b") for i in range(6000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in mixing.copies(d).collect() if r.doc_id % 2]  # source a: weight 1 of 3: two thirds of its words
    share = lambda rs: sum(r.copies for r in rs) / len(rs)
    short, long = [r for r in got if r["size"] < 8], [r for r in got if r["size"] >= 32]
    assert 0.5 < share(long) < share(short) < 1.0
    assert mixing.scale([(0, 10.0), (3, 80.0)], 90.0) >= 2 ** (3 / mixing.TEMPER)


def test_mixing_odd_rows(docs, spark):
    got = mixing.mix(docs(*ODD, sources=["a", None, "a", "b", "b", "b", None, "a", "é", "b"])).collect()
    assert len(got) == len(ODD) and all(r.taken <= 3 * r["size"] for r in got) and all(r.taken == 0 for r in got if r["size"] == 0)
    assert mixing.mix(docs("a").where("false")).collect() == []
    assert [r.taken for r in mixing.mix(docs(None, "", ids=[None, None])).collect()] == [0, 0]
    d = docs("one two", "one two", "three", ids=[1, 1, None], sources=["a", "a", None])
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns and len(mixing.mix(d).collect()) == 3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><h1>Site name</h1></header>
<nav class="main"><ul><li><a href="/">Home</a><li><a href="/b">News</a></ul></nav><div id="cookie-notice"><p>We use cookies here.</p></div><!-- <p>hidden</p> -->
<main><article><header><h1>Title &lt;x&gt; &amp; more</h1></header><p>First <a href="y">linked</a>  paragraph
with words.<p><b>Second<br>one &eacute;&#233;&#x41;.</b><ul><li>one item<li>two items</ul><form><input><label>Mail</label><button>Go</button></form>
<aside>Related reading</aside><div class="advert">Buy this now</div><p>Last.</p></article><section id="comments"><h2>Comments</h2><p>Nice post, thank you so much for it!</p></section></main>
<div class="sidebar"><p>A long text in the sidebar that goes on for quite a few words, as they do.</p></div><footer>&copy; us</footer></body></html>"""
TEXT = "Title <x> & more\n\nFirst linked paragraph with words.\n\nSecond one ééA.\n\none item\n\ntwo items\n\nLast."


def test_main_text():
    tree = html.train()
    assert html.main_text([PAGE], tree) == [TEXT]
    assert html.main_text(["", "no markup at all here", "<p>a &amp b</p><p", "<div>x<script>y"], tree) == ["", "no markup at all here", "a & b", "x"]
    assert html.main_text([PAGE.replace("<article>", "<div>").replace("</article>", "</div>").replace("<main>", "<div>").replace("</main>", "</div>").replace("<header><h1>Title &lt;x&gt; &amp; more</h1></header>", "<h1>Title &lt;x&gt; &amp; more</h1>")], tree) == [TEXT]


def test_the_tree_knows_its_examples_and_uses_neighbours():
    rows = np.array([x.split() for x in html.EXAMPLES.strip().splitlines()], float)
    tree = html.train()
    assert (html.decide(tree, rows[:, :-1]) == rows[:, -1]).all()
    for name in ("words", "link", "words_before", "link_after", "place", "aside", "share", "heading"):
        assert f"({html.FEATURES.index(name)}, " in str(tree)


PROSE = ["The council met on Tuesday to decide how the old harbour should be used once the last ferries have left for the new terminal.", "Most of the speakers, among them two former mayors, asked for more time, since the plans had been shown to the public only a week before.", "A vote was put off until the autumn."]
PARAGRAPHS = "".join(f"<p>{x}</p>" for x in PROSE)
MENU = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "Sport", "Local news", "About us", "Contact"))
COMMENTS = "".join(f"<div><b>{x}</b><p>I think that they should have asked us first, and not only {x}, before any of this was planned.</p></div>" for x in ("Ann", "Bob", "Cyd"))
TITLE = "What becomes of the harbour"
#: (page, its main text) of templates that have little in common.
TEMPLATES = {
    "wrapper named after its sidebar": (f'<body><nav><ul>{MENU}</ul></nav><div class="content with-sidebar"><article><h1>{TITLE}</h1>{PARAGRAPHS}</article><div class="sidebar"><p>Weather: rain until the evening, then clear.</p></div></div></body>', [TITLE, *PROSE]),
    "body of the page that has a sidebar": (f'<body><div id="menu"><ul>{MENU}</ul></div><div class="has-sidebar"><h1>{TITLE}</h1>{PARAGRAPHS}</div><div id="right-sidebar"><p>Weather: rain until the evening.</p></div><div class="footer">Copyright 2024</div></body>', [TITLE, *PROSE]),
    "header inside the article": (f'<article><div class="post-header"><h1>{TITLE}</h1></div>{PARAGRAPHS}<div class="share-buttons"><a href="a">Mail</a> <a href="b">Print</a></div></article>', [TITLE, *PROSE]),
    "search is its subject": (f'<body><div class="search-engine-intro"><p>{PROSE[0]} {PROSE[1]}</p></div><form class="search"><p>Search the site</p></form></body>', [f"{PROSE[0]} {PROSE[1]}"]),
    "quotes inside a bare attribute": (f"<article><h1 id=it's>{TITLE}</h1><p class=a'b>{PROSE[0]}</p><p title=\"x > y\">{PROSE[1]}</p></article><footer>end</footer>", [TITLE, PROSE[0], PROSE[1]]),
    "tables": (f'<table width=100%><tr><td class="nav"><a href="1">Home</a><br><a href="2">Links</a><td><font size=4>{TITLE}</font><p>{PROSE[0]}<p>{PROSE[1]}<p>{PROSE[2]}</td></tr><tr><td colspan=2><a href="t">Terms</a> | <a href="p">Privacy</a></td></tr></table>', [TITLE, *PROSE]),
    "plain divs": (f'<div><a href="/">Home</a> <a href="/n">News</a> <a href="/s">Sport</a></div><div><h1>{TITLE}</h1><div>{PROSE[0]}</div><div>{PROSE[1]}</div><div>{PROSE[2]}</div></div><div><a href="/t">Terms</a> <a href="/p">Privacy</a></div>', [TITLE, *PROSE]),
    "many comments": (f'<main><h1>{TITLE}</h1>{PARAGRAPHS}<section class="comment-list"><h2>3 comments</h2>{COMMENTS * 4}</section></main>', [TITLE, *PROSE]),
    "comments as articles": (f'<article class="post"><h1>{TITLE}</h1>{PARAGRAPHS}</article><div id="comments">' + "".join(f'<article class="comment"><p>{x} I do not agree at all with this, and never have.</p></article>' for x in "abc") + "</div>", [TITLE, *PROSE]),
    "cards of other articles": (f'<main><article><h1>{TITLE}</h1>{PARAGRAPHS}</article><div class="related-posts"><article><a href="1">Ferries are late again</a></article><article><a href="2">New terminal opens</a></article></div></main>', [TITLE, *PROSE]),
    "a form around the whole page": (f'<body><form id="aspnetForm" action="x"><div class="topbar"><a href="/">Home</a> <a href="/login">Log in</a></div><div id="main"><h1>{TITLE}</h1>{PARAGRAPHS}</div></form></body>', [TITLE, *PROSE]),
    "byline and links in the text": (f'<article><h1>{TITLE}</h1><p>By <a href="/a">Ann Lee</a></p><p>{PROSE[0]} <a href="x">More on this</a>.</p>{PARAGRAPHS[len(PROSE[0]) + 7:]}<ul>{MENU}</ul></article>', [TITLE, "By Ann Lee", f"{PROSE[0]} More on this.", *PROSE[1:]]),
    "notices and adverts in the text": (f'<div class="cookie-banner"><p>We use cookies to improve this site.</p></div><div role="main"><h1>{TITLE}</h1><p>{PROSE[0]}</p><div class="ad-slot"><p>Cheap ferries to the islands, book now and save.</p></div><p>{PROSE[1]}</p><div class="newsletter-signup-box"><p>Get our letter every week.</p></div><p>{PROSE[2]}</p></div>', [TITLE, *PROSE]),
    "unclosed elements": (f'<article><svg><path d="M0 0"><h1>{TITLE}</h1><button>Share<p>{PROSE[0]}</p><p hidden>not shown</p><div style="display: none"><p>nor this</p></div><p>{PROSE[1]}<p>{PROSE[2]}', [TITLE, "Share", *PROSE]),
}


@pytest.mark.parametrize("name", TEMPLATES)
def test_templates(name):
    page, want = TEMPLATES[name]
    assert html.main_text([page], html.train())[0].split("\n\n") == want


def test_markup_that_could_take_long():
    import time

    began = time.time()
    for page in ("<p " + "a " * 200_000, "<p " + "a='" * 100_000, "<a b=" * 100_000, "<svg>" * 3000, "<div>" * 50_000 + "x", "<" * 300_000, "<p class=" + "x-" * 100_000 + ">y"):
        html.main_text([page], html.train())
    assert time.time() - began < 60


def test_pages(spark):
    rows = [(1, "u", PAGE, 5, "t"), (2, None, None, 5, "t"), (None, "u", "", 5, "t"), (1, "u", PAGE, 5, "t"), (3, "u", "<p>" + "word " * 100_000, 5, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")
    got = html.extract(df).collect()
    assert sorted((str(r.page_id), r.n_chars, len(r.text)) for r in got) == sorted([("1", len(TEXT), len(TEXT))] * 2 + [("2", 0, 0), ("None", 0, 0), ("3", 499_999, 499_999)])
    assert html.extract(df.where("false")).collect() == []


def test_pages_of_the_table(spark):
    """Against the template of the test pages: headings and paragraphs of the article."""
    import re
    from html import unescape

    for r, p in zip(html.extract(table(spark, SMALL, "pages")).orderBy("page_id").collect(), table(spark, SMALL, "pages").orderBy("page_id").collect()):
        body = re.search(r"<article>(.*?)(</article>|\Z)", p.html, re.S)[1]
        parts = re.split(r"</?(?:h1|p)\b[^>]*>", re.sub(r"<[^>]*\Z", "", body))
        want = [" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0] == "<br>" else "", x)).split()) for x in parts]
        assert r.text == "\n\n".join(w for w in want if w)
