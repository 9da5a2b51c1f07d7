import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import common, decontam, extract, hashing, jaccard, jpeg, langid, mixing, pii, quality, sharding, suffixes

#: Columns that operators might use inside, to clash with.
EXTRA = "id word doc pos size score h key label sig tid c0 spans set_id copies shard slot level part place rate target".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def with_extra(df):
    return df.select("*", *(F.lit(7).alias(c) for c in EXTRA))


def corpus(seed=1, n=80):
    """Documents with copies, near copies, shared passages, repeats inside, odd ones, and repeated rows."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 6))) for _ in range(120)]
    text = lambda k: " ".join(draw.choice(vocabulary) for _ in range(k))
    passage, rows = text(70), []
    for i in range(n):
        t = text(draw.choice([3, 20, 60, 150]))
        if i % 5 == 1:
            t = rows[draw.randrange(len(rows))][1]
        elif i % 5 == 2:
            w = (rows[draw.randrange(len(rows))][1] or "x").split()
            for _ in range(draw.randint(1, 3)):
                w[draw.randrange(len(w))] = draw.choice(vocabulary)
            t = " ".join(w)
        elif i % 5 == 3:
            w = t.split()
            t = " ".join([*w[: len(w) // 2], passage, *w[len(w) // 2 :]])
        rows.append((i, t, draw.choice(["en", "de", None]), draw.choice(["s1", "s2", "s3", None]), len(t)))
    odd = ["", None, " \n ", "a", "A b", "zq " * 9000, "ab" * 400, " \x1c tail", "é" * 205]
    rows += [(n + i, t, None, None, None) for i, t in enumerate(odd)]
    return rows + [rows[3], rows[4], (None, rows[5][1], "en", "s1", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return with_extra(spark.createDataFrame(rows, DOCS)).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- personal data ------------------------------------------------------------------------------------------------


def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_expressions():
    draw = random.Random(4)
    for letters in ("a1@.-+ 0(", "0123456789 -.+", "@a.", "4 -5+."):
        for _ in range(5000):
            t = "".join(draw.choice(letters) for _ in range(draw.randint(0, 50)))
            assert pii.base_spans(t) == plain_spans(t)


def test_long_runs_stay_linear():
    for t in ("a" * 300_000, "1" * 300_000, "+1" * 150_000, "1." * 150_000, "@" * 300_000, "AB12" * 75_000):
        pii.spans_of(t)


def test_many_spans_stay_linear():
    """Far more than the square of their number would allow."""
    t = "call 030 123 4567, SSN 123-45-6789, phone +49 30 1234567, 10.0.0.1 " * 20_000
    began = time.process_time()
    assert Counter(s[0] for s in pii.spans_of(t)) == {"local_phone": 20_000, "ssn": 20_000, "phone": 20_000, "ip": 20_000}
    assert time.process_time() - began < 60


def test_added_spans_keep_clear_of_others():
    draw = random.Random(14)
    for _ in range(2000):
        t = "phone SSN " + "".join(draw.choice(["12", "345", "-", " ", ".", "+1", "123-45-6789", "030 123 4567"]) for _ in range(draw.randint(0, 12)))
        spans = pii.spans_of(t)
        added = [s for s in spans if s[0] not in pii.BASE]
        assert [s[:3] for s in spans if s[0] in pii.BASE] == [s for k in pii.BASE for s in pii.base_spans(t) if s[0] == k]
        assert all(a is b or a[2] <= b[1] or a[1] >= b[2] for a in added for b in spans)


def test_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89 3704 0044 0532 0130 00") and not pii.mod97("DE88370400440532013000")
    kinds = lambda t: [s[0] for s in pii.spans_of(t)]
    found = lambda t: [t[s[1] : s[2]] for s in pii.spans_of(t) if s[0] == "iban"]
    assert found("DE89 3704 0044 0532 0130 00 EUR please") == ["DE89 3704 0044 0532 0130 00"] and found("an DE89370400440532013000 BIC X") == ["DE89370400440532013000"]
    assert found("NO9386011117947") == ["NO9386011117947"] and found("NO93860111179470") == found("ZZ9386011117947") == found("xNO9386011117947") == []
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"] and kinds("DE88 3704 0044 0532 0130 00") == []
    assert kinds("SSN 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("phone (030) 123 4567") == ["local_phone"] and kinds("order 030 123 4567") == []
    assert pii.spans_of("mail a@b.cd")[0][3] > pii.spans_of("zzzz a@b.cd")[0][3]


def test_pii_rows(spark, docs, rows, empty):
    got = as_rows(pii.find_pii(docs).select("doc_id", F.size("spans")))
    assert got == sorted(((r[0], len(pii.spans_of(r[1]))) for r in rows), key=repr)
    assert pii.find_pii(empty).count() == 0


# --- extraction ---------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><article>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>no</p> --><div class=ad>Buy</div>
<article><h1>Head&amp;line</h1><p>First <b>bold</b>
  text.<p>Second&nbsp;&eacute;</p><aside>Side</aside><form><p>Mail</p></form><blockquote>Quote</blockquote><pre>x
 y</pre><br>loose<br>end{extra}</article><section id="comments"><p>Reader</p></section><footer>F</footer></body></html>"""


def test_main_text():
    want = "Head&line\nFirst bold text.\nSecond é\nQuote\nx y\nloose end"
    assert extract.main_text(PAGE.format(extra="")) == want
    assert extract.main_text(PAGE.format(extra="")[: PAGE.index("{extra}")]) == want
    assert extract.main_text(None) == extract.main_text("") == extract.main_text("<p></p>") == extract.main_text("<nav>x</nav>") == ""
    assert extract.main_text("a &lt; b &#65;&#x42;") == "a < b AB"
    for broken in ("<", "<p", "</", "<!--", "<script>", "<a href='", "&", "<p>x</b></p></div>y", "<table><tr><td>a<td>b<tr><td>c</table>"):
        extract.main_text(broken)
    assert extract.main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"


def test_template_without_tags(spark):
    """Nothing but the template tells the furniture of these pages from their text."""
    page = lambda i: f"<html><body><div><p>Welcome to our site</p><p>All rights kept here</p><p>Call us today for more</p></div><div><p>Own text {i} of page {i * 7}</p><p>More {i}</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(30)] + [(99, None, None), (None, "x", "<p>alone</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("host"), F.lit(2).alias("id"))
    got = {r.page_id: r for r in extract.extract(pages).collect()}
    assert len(got) == 32 and got[3].text == "Own text 3 of page 21\nMore 3" and got[3].n_chars == len(got[3].text)
    assert got[99].text == "" and got[None].text == "alone"
    assert as_rows(extract.extract(pages, options=extract.Options(broadcast_tokens=0, broadcast_hosts=0))) == sorted(map(tuple, got.values()), key=repr)
    assert extract.extract(pages.limit(0)).count() == 0


def test_no_text_of_an_article_goes(spark):
    """Near copies of one article on a host, and articles without names that have parts outside their largest one."""
    shared = "".join(f"<p>Paragraph {k} that every copy has.</p>" for k in range(5))
    pages = [(i, f"http://h.example/{i}", f"<body><nav>x</nav><article><h1>One</h1>{shared}<p>Changed {i}</p><div class=share>Send</div></article></body>") for i in range(12)]
    got = [r.text for r in extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).orderBy("page_id").collect()]
    assert got == ["\n".join(["One", *(f"Paragraph {k} that every copy has." for k in range(5)), f"Changed {i}"]) for i in range(12)]
    page = "<body><p><a>All</a></p><h1><a>Headline</a></h1><p>Lead.</p><div><p>" + "Long text. " * 20 + "</p><h2><a>Linked</a></h2></div><div><p>Last part.</p></div><p><a>More</a></p></body>"
    assert extract.main_text(page) == "\n".join(["Headline", "Lead.", ("Long text. " * 20).strip(), "Linked", "Last part."])


LAYOUT = """<!DOCTYPE html><html><head><meta charset=utf-8><title>{title}</title></head><body><{nav}><ul>{menu}</ul></{nav_}><{ad}>{notice}</{ad_}>
<{main}><h1>{title}</h1>{body}</{main_}><{foot}>&copy; {host} {notice}</{foot_}></body></html>"""


def site(host, n, names, seed):
    """Pages of one host, the names of whose elements are given, and their texts."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(draw.randint(2, 8)))
    tags = {k: v for k, v in names.items()} | {k + "_": v.split()[0] for k, v in names.items()}
    for i in range(n):
        title, paragraphs = " ".join(word() for _ in range(6)), [" ".join(word() for _ in range(draw.randint(1, 60))) for _ in range(draw.randint(1, 6))]
        menu, notice = "".join(f"<li><a href=/{k}>{word()}</a></li>" for k in range(draw.randint(4, 7))), " ".join(word() for _ in range(draw.randint(3, 9)))
        page = LAYOUT.format(title=title, menu=menu, notice=notice, host=host, body="".join(f"<p>{x}</p>" for x in paragraphs), **tags)
        yield f"https://{host}/{i}", page if i % 9 else page[: page.rindex("</body>")], "\n".join([title, *paragraphs])


SCRAMBLED = [{k: f'{e} class="{v}"' for k, e, v in zip(("nav", "ad", "main", "foot"), es, vs, strict=True)} for es, vs in ((("div",) * 4, ("qa", "qb", "qc", "qd")), (("section", "div", "section", "div"), ("zz", "zy", "zx", "zw")), (("div", "section", "aside", "nav"), ("u", "article", "v", "w")))]


def test_the_template_finds_the_text_whatever_tags_are_named(spark):
    """Scrambled names choose nothing; misleading ones veto."""
    plain = {"nav": "nav", "ad": "div class=ad", "main": "article", "foot": "footer"}
    rows = [(h, *x) for h, n, names in (("a.example", 40, plain), ("b.example", 40, SCRAMBLED[0]), ("c.example", 40, SCRAMBLED[1]), *((f"small{k}.example", 1 + k % 3, plain) for k in range(20))) for x in site(h, n, names, len(h) + n)]
    pages = spark.createDataFrame([(i, r[1], r[2]) for i, r in enumerate(rows)], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in extract.extract(pages).collect()}
    assert [got[i].text for i in range(len(rows))] == [r[3] for r in rows] and all(r.by_template for r in got.values())
    misled = [x for x in site("d.example", 20, SCRAMBLED[2], 3)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _) in enumerate(misled)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in extract.extract(pages).collect()}
    assert all(not any(x in got[i] for x in text.split("\n")[1:] if len(x) > 20) for i, (_, _, text) in enumerate(misled))  # the article stands in an aside


def test_comments_longer_than_the_article(spark):
    draw = random.Random(31)
    words = lambda n: " ".join("".join(draw.choice("abcdefg") for _ in range(4)) for _ in range(n))
    pages, want = [], []
    for i in range(12):
        body, notes = [words(20) for _ in range(3)], [words(60) for _ in range(draw.randint(2, 9))]
        comments = "".join(f"<li><b>{words(1)}</b><p>{x}</p></li>" for x in notes)
        pages.append((i, "http://h.example/", f"<html><title>{body[0]}</title><body><nav><a href=x>{words(3)}</a></nav><main><h1>{body[0]}</h1><p>{body[1]}</p><p>{body[2]}</p></main><section id=comments><h2>Comments</h2><ul>{comments}</ul></section></body></html>"))
        want.append("\n".join(body))
    got = extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r.text for r in got] == want and all(r.by_template for r in got)


def plain_classes(pages, o):
    """Tokens by their vector of counts over all pages, in order of mean first place."""
    read = [extract.read(t).tokens for t in pages]
    by = {}
    for token in {t for p in read for t in p}:
        vector = tuple(p.count(token) for p in read)
        have = [p.index(token) for p in read if token in p]
        by.setdefault(vector, []).append((sum(have) / len(have), token))
    frequent = [sorted(v) for k, v in by.items() if sum(map(bool, k)) >= max(o.least_pages, o.share * len(pages)) and len(v) >= o.least_tokens]
    return sorted([t for _, t in c] for c in frequent)


def test_classes_are_those_of_the_whole_vectors(spark):
    o, draw = extract.Options(), random.Random(21)
    hosts = {f"h{k}": [x[1] for x in site(f"h{k}", draw.randint(4, 15), SCRAMBLED[k % 2], k)] for k in range(6)}
    hosts["h0"] += hosts["h0"][:1] * 2  # a page that comes three times
    hosts["h9"] = ["".join(draw.choice(["<p>", "</p>", "<div>", "</div>", "x ", "y"]) for _ in range(30)) for _ in range(8)]
    rows = [(h, p) for h, ps in hosts.items() for p in ps]
    found = extract.classes(extract.vectors(extract.page_tokens(spark.createDataFrame(rows, "host string, html string").repartition(5))))
    got = {}
    for r in found.collect():
        own = {}
        for t in r.tokens:
            own.setdefault(t["class"], []).append((t.place, t.token))
            assert t["size"] == sum(x["class"] == t["class"] for x in r.tokens)
        got[r.host] = sorted([t for _, t in sorted(c)] for c in own.values())
    assert got == {h: c for h, ps in hosts.items() if (c := plain_classes(ps, o))}


def test_hosts_with_few_pages_share_a_template(spark):
    """The pool's vectors are the sums of its hosts', so they are those of all its pages as one host."""
    rows = [(f"h{k}", x[1]) for k in range(9) for x in site(f"h{k}", 1 + k % 3, SCRAMBLED[0], k)]
    df = spark.createDataFrame(rows, "host string, html string").repartition(3)
    pool = extract.classes(extract.vectors(extract.page_tokens(df))).collect()
    whole = extract.classes(extract.vectors(extract.page_tokens(df.withColumn("host", F.lit(extract.POOL))))).collect()
    assert pool == whole and [r.host for r in pool] == [extract.POOL]


def test_classes_out_of_order_are_not_valid():
    """Tokens that change places, or rounds that lie in several gaps, make no part of a template."""
    tokens = [{"token": t, "class": c, "place": i, "size": 3, "once": c == 0, "hint": False} for c, ts in ((0, (1, 2, 3)), (1, (4, 5, 6))) for i, t in enumerate(ts)]
    walk = lambda *ts: extract.Template(tokens).walk(extract.Page(tokens=list(ts)))[1]
    assert walk(1, 4, 5, 6, 4, 5, 6, 2, 3) == {0: (0, [""]), 1: (0, ["0.0", "0.0"])}
    assert walk(1, 3, 2)[0][0] > 0 and walk(1, 4, 2, 5, 6, 3)[1][0] > 0 and walk(1, 4, 6, 2, 3)[1][0] > 0 and walk(1, 2, 3, 4)[1] == (1, ["0.2"])


# --- decontamination ----------------------------------------------------------------------------------------------


def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_hits(text, items):
    w, hit, found = plain_words(text), set(), set()
    for i, t in items:
        x = plain_words(t)
        for k in range(max(len(x) - 13, 0) + 1 if x else 0):
            win = x[k : k + 13]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit.update(range(p, p + len(win)))
                    found |= {str(i)} - {"None"}
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontamination(spark, docs, rows, empty, broadcast):
    long = [r[1] for r in rows if r[1] and len(r[1]) > 200]
    items = [(1, long[0][30:180]), (2, long[1].upper()), (10, long[0][30:180] + " tail"), (3, "zq zq"), (4, "A"), (5, None), (6, "..."), (7, "not there at all in any of these texts whatever they may be"), (None, long[2][:150])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(docs, benchmark, broadcast_windows=broadcast)
    want = {(r[0], *plain_hits(r[1], items)) for r in rows}
    assert {tuple(r) for r in got.where("doc_id IS NOT NULL").collect()} == {w for w in want if w[0] is not None}
    assert decontam.decontaminate(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(empty, benchmark).count() == 0
    left = decontam.drop_contaminated(docs.where("doc_id IS NOT NULL"), benchmark)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {w[0] for w in want if not w[2] and w[0] is not None}


def test_decontamination_tells_rows_apart(spark):
    """Null ids, ids of two texts, and repeated rows."""
    passage, clean = " ".join(f"w{i}" for i in range(15)), "nothing of that is here"
    rows = [(None, passage), (None, clean), (None, None), (1, passage), (1, clean), (2, clean), (2, clean), (3, passage), (3, passage)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert as_rows(decontam.drop_contaminated(docs, benchmark)) == sorted([r for r in rows if r[1] != passage], key=repr)


def test_a_passage_in_a_long_text_is_dropped(spark):
    """18 of 414 words are less than a twentieth: not contaminated by the query's rule, but a leak for the corpus."""
    passage = " ".join(f"item{i}" for i in range(18))
    long = " ".join([*(f"a{i}" for i in range(200)), passage, *(f"b{i}" for i in range(196))])
    docs = spark.createDataFrame([(1, long), (2, long.replace("item9", "other")), (3, passage)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.contaminated) for r in decontam.decontaminate(docs, benchmark).collect()}
    assert got == {1: (414, 18, False), 2: (414, 0, False), 3: (18, 18, True)}
    assert [r.doc_id for r in decontam.drop_contaminated(docs, benchmark).collect()] == [2]


@pytest.mark.parametrize("limit", [100, 3])
def test_windows_that_many_items_share(spark, limit):
    """The bound of the broadcast counts a window once for each item that has it."""
    text = " ".join(f"w{i}" for i in range(13))
    benchmark = spark.createDataFrame([(i, text) for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(1, text), (None, text), (None, text)], "doc_id long, text string")
    got = decontam.decontaminate(docs, benchmark, broadcast_windows=limit)
    assert as_rows(got) == sorted(((i, *plain_hits(text, [(k, text) for k in range(9)])) for i in (1, None, None)), key=repr)


def test_decontamination_returns_every_row(spark, docs, rows):
    items = [(1, rows[3][1]), (2, rows[5][1])]
    got = decontam.decontaminate(docs.union(docs.where("doc_id IS NULL")), spark.createDataFrame(items, "item_id long, text string"))
    assert as_rows(got) == sorted(((r[0], *plain_hits(r[1], items)) for r in [*rows, *(r for r in rows if r[0] is None)]), key=repr)


# --- language and quality -----------------------------------------------------------------------------------------


def test_language(spark, empty):
    words = {"en": "the of and thing", "de": "der und nicht schön", "fr": "le être où ça", "es": "el niño y está", "xx": "qq ww vv"}
    draw = random.Random(1)
    rows = [(i, " ".join(draw.choice(words[v].split()) for _ in range(30)), v, "s", 1) for i in range(400) for v in [draw.choice(list(words))]]
    odd = [(1000, None, None, None, 1), (1001, "", "en", None, 1), (1002, "12 ### !", "en", None, 1), (None, "der und nicht schön", None, None, 1)]
    docs = with_extra(spark.createDataFrame(rows + odd, DOCS))
    model = langid.fit(docs, per_language=60)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert len(got) == 404 and all(got[r[0]].lang_pred == r[2] for r in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and got[None].lang_pred == "de"
    nothing = langid.fit(empty)
    assert langid.identify(empty, nothing).count() == 0 and {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}
    one = langid.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify(docs.where("doc_id < 50"), one).collect()} == {"en"}


def test_samples_are_bounded(spark, monkeypatch):
    """At any size and with any hashes: a draw that takes everything leaves the documented number of rows."""
    rows = [(i % 500, f"text {i % 700} of some words", "en" if i % 3 else "de") for i in range(3000)] + [(i, "junk", f"x{i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    for below in (None, lambda expected, of: 1 << 62):
        if below:
            monkeypatch.setattr(langid, "drawn_below", below)
            monkeypatch.setattr(quality, "drawn_below", below)
        n = {r[0]: r[1] for r in langid.sampled(docs, 20, 2).groupBy("lang").count().collect()}
        assert n == {"en": 20, "de": 20}
        seen = []
        monkeypatch.setattr(quality, "train", lambda x, y, share, seen=seen: seen.append(Counter(y.tolist())) or quality.Model(np.zeros(quality.SIZE), np.ones(quality.SIZE), np.zeros(quality.SIZE), 0.0))
        quality.fit(docs.withColumnRenamed("id", "doc_id"), spark.createDataFrame([(i % 500, i % 2) for i in range(3000)], "doc_id long, quality int"), per_label=15)
        assert seen == [{0: 15, 1: 15}]


def test_family_machines_agree_with_a_plain_fit():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(60, 5)) + np.repeat([[3.0], [-3.0]], 30, axis=0)
    w, b = langid.train_machine(x, np.repeat([1.0, -1.0], 30))
    assert (np.sign(x @ w + b) == np.repeat([1, -1], 30)).all()


def test_quality(spark, empty):
    draw = random.Random(2)
    good = lambda: "This is a calm and proper sentence about " + " ".join(draw.choice("rivers hills towns people books".split()) for _ in range(12)) + "."
    bad = lambda: "BUY!! NOW!! " * draw.randint(2, 9) + "### $$$ "
    rows = [(i, good() if i % 4 else bad(), None, None, 1) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)] + [(3, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = with_extra(spark.createDataFrame([*rows, (500, None, None, None, None), (501, "", None, None, None), (None, "x", None, None, None)], DOCS))
    model = quality.fit(docs, labels)
    out = quality.rated(docs, model)
    got = {r.doc_id: r for r in out.collect()}
    assert all(got[i].predicted == int(i % 4 > 0) for i in range(400)) and all(0 <= r.score <= 1 for r in got.values())
    assert got[500].score == got[501].score and set(out.columns) == set(docs.columns) | {"predicted"}
    for known in (labels, labels.limit(0)):  # the query's shorter way says the same
        two = quality.rated(docs, quality.fit(docs, known)).select("doc_id", F.round("score", 12), "predicted")
        assert as_rows(quality.scored(docs, known).select("doc_id", F.round("score", 12), "predicted")) == as_rows(two)
    assert {r.score for r in quality.scored(docs, labels.limit(0)).collect()} == {0.3}
    none = quality.fit(docs, labels.limit(0))
    assert {r.predicted for r in quality.rated(docs, none).collect()} == {1} and quality.rated(empty, none).count() == 0
    x = np.vstack([np.ones((5, 3)), np.zeros((2, 3))])
    m = quality.train(x, np.array([1] * 5 + [0] * 2), 2 / 7)
    assert m.weights.sum() > 0


def test_quality_threshold_is_the_quantile_of_all_rows(spark):
    """Most rows have no label, and lower scores than those that have one."""
    draw = random.Random(5)
    text = lambda bad: " ".join(draw.choice(["###", "BUY!!"]) if draw.random() < bad else draw.choice("rivers hills towns people".split()) for _ in range(40))
    share = [draw.random() for _ in range(300)] + [0.7 + 0.3 * draw.random() for _ in range(1200)]
    docs = spark.createDataFrame([(i, text(b)) for i, b in enumerate(share)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b < 0.7)) for i, b in enumerate(share[:300])], "doc_id long, quality int")
    known = labels.where(quality.is_training(F.col("doc_id"))).collect()
    bad = sum(r.quality == 0 for r in known) / len(known)
    out = quality.rated(docs, quality.fit(docs, labels)).where("predicted = 0").count() / len(share)
    assert abs(out - bad) <= 2 * (bad * (1 - bad) / len(known)) ** 0.5 + 0.01


# --- repeats ------------------------------------------------------------------------------------------------------


def plain_repeats(texts, length):
    data, seen = [(t or "").encode() for t in texts], Counter()
    for d in data:
        seen.update(d[p : p + length] for p in range(len(d) - length + 1))
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        yield len(d), len(d) - len(kept), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"hot": 2, "broadcast_strings": 5}, {"piece": 300}])
def test_repeats(spark, docs, rows, empty, options):
    got = suffixes.without_repeats(docs, options=suffixes.RepeatOptions(**options))
    assert as_rows(got) == sorted(((r[0], *x) for r, x in zip(rows, plain_repeats([r[1] for r in rows], 200), strict=True)), key=repr)
    if not options:
        assert suffixes.without_repeats(empty).count() == 0
        kept = suffixes.without_repeats(docs.where("doc_id = 3"), with_text=True).first()
        assert hashlib.sha256(kept.kept).hexdigest() == kept.kept_sha256


def test_suffix_order_and_earlier_matches():
    draw = random.Random(8)
    for _ in range(60):
        data = bytes(draw.choice(b"ab") for _ in range(draw.randint(12, 80)))
        length = draw.choice([3, 8, 11])
        starts = np.arange(len(data) - length + 1)
        live, kind, later = suffixes.repeated_suffixes(np.frombuffer(data, np.uint8), starts, length)
        string = lambda p: data[p : p + length]
        counts = Counter(map(string, starts))
        assert sorted(live) == [p for p in starts if counts[string(p)] > 1]
        assert [string(p) for p in live] == sorted(string(p) for p in live)
        assert all(later[i] == any(string(q) == string(p) for q in range(p)) for i, p in enumerate(live))


def test_smaller_neighbours():
    draw = random.Random(9)
    for _ in range(100):
        x = draw.sample(range(100), draw.randint(0, 30))
        before, after = suffixes.smaller_neighbours(np.array(x, np.int64))
        assert before.tolist() == [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(len(x))]
        assert after.tolist() == [min((j for j in range(i + 1, len(x)) if x[j] < x[i]), default=len(x)) for i in range(len(x))]


# --- pictures -----------------------------------------------------------------------------------------------------


def test_pictures_round_trip():
    draw = np.random.default_rng(1)
    payloads = [bytes(64), bytes(range(256)), bytes([255, 0] * 96), draw.integers(0, 256, 64 * 700, dtype=np.uint8).tobytes(), draw.integers(0, 256, jpeg.PICTURE + 64, dtype=np.uint8).tobytes()]
    media = [jpeg.encode(p) for p in payloads]
    assert [p for p, _ in jpeg.read_back(media)] == payloads and len(jpeg.parse(media[-1])) == 2
    assert all(m.startswith(b"\xff\xd8") and m.endswith(b"\xff\xd9") for m in media)


def test_decoder_reads_colour_and_ac():
    """A picture with three components at 2x1 sampling, AC coefficients, no restarts; its DC levels are known."""
    draw = random.Random(6)
    dc = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), tuple(range(12)))
    ac = ((0, 2, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (0x00, 0x01, 0xF0, 0x23))
    codes = [jpeg.code_table(*dc), jpeg.code_table(*ac)]
    bits, wide, high, luma = [], 3, 2, {}

    def put(value, n):
        bits.extend((value >> i) & 1 for i in range(n - 1, -1, -1))

    def number(v):
        n = abs(v).bit_length()
        return n, v if v >= 0 else v + (1 << n) - 1

    last = [0, 0, 0]
    for unit in range(wide * high):
        for block, c in enumerate((0, 0, 1, 2)):
            v = draw.randint(-100, 100)
            if c == 0:
                luma[unit // wide, 2 * (unit % wide) + block] = v
            n, low = number(v - last[c])
            last[c] = v
            put(*codes[0][n])
            put(low, n)
            if draw.random() < 0.5:
                put(*codes[1][0xF0])
                put(*codes[1][0x23])
                put(draw.randint(0, 7), 3)
            if draw.random() < 0.5:
                put(*codes[1][0x01])
                put(1, 1)
            put(*codes[1][0x00])
    bits += [1] * (-len(bits) % 8)
    scan = np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")
    seg = jpeg._segment
    data = (
        b"\xff\xd8" + seg(0xDB, b"\0" + bytes([8] * 64)) + seg(0xC0, b"\x08" + (8 * high).to_bytes(2, "big") + (16 * wide).to_bytes(2, "big") + b"\x03\x01\x21\0\x02\x11\0\x03\x11\0")
        + seg(0xC4, b"\x00" + bytes(dc[0]) + bytes(dc[1]) + b"\x10" + bytes(ac[0]) + bytes(ac[1])) + seg(0xDA, b"\x03\x01\0\x02\0\x03\0\0\x3f\0") + scan + b"\xff\xd9"
    )
    (thumb,) = jpeg.thumbnails(jpeg.parse(data))
    assert thumb.shape == (high, 2 * wide) and all(thumb[y, x] == v + 128 for (y, x), v in luma.items())
    with pytest.raises(ValueError, match="baseline"):
        jpeg.parse(data.replace(b"\xff\xc0", b"\xff\xc2"))


def test_media_rows(spark, docs, rows, empty):
    got = {(r.doc_id, r.n_bytes): r for r in jpeg.media_columns(docs, with_media=True).collect()}
    for i, t, *_ in rows:
        raw = (t or "").encode()
        padded = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i, len(raw)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest() and "x" in r.feature
    assert jpeg.media_columns(docs).count() == len(rows) and jpeg.media_columns(empty).count() == 0


def plain_picture(data):
    """Width, height and samples of each picture of a file of ours, bit by bit."""
    codes = {f"{c:0{n}b}": k for k, (c, n) in jpeg.code_table(jpeg.DC_COUNTS, jpeg.DC_SYMBOLS).items()}
    for part in re.findall(rb"\xff\xd8.*?\xff\xd9", data, re.S):
        frame = part[part.index(b"\xff\xc0") + 4 :]
        high, wide = int.from_bytes(frame[1:3], "big"), int.from_bytes(frame[3:5], "big")
        scan = part[part.index(b"\xff\xda") :]
        grid = []
        for row in re.split(rb"\xff[\xd0-\xd7]", scan[2 + int.from_bytes(scan[2:4], "big") : -2]):
            bits, level, line = iter("".join(f"{b:08b}" for b in row.replace(b"\xff\0", b"\xff"))), 0, []
            while len(line) < wide // 8:
                code = next(bits)
                while code not in codes:
                    code += next(bits)
                n = codes[code]
                raw = "".join(next(bits) for _ in range(n))
                if n:
                    level += int(raw, 2) if raw[0] == "1" else int(raw, 2) - 2**n + 1
                assert next(bits) == "0"  # the end of the block
                line.append(level + 128)
            grid.append(line)
        assert len(grid) == high // 8
        yield wide, high, grid


def plain_hash(grid):
    h, w, cells = len(grid), len(grid[0]), []
    for y in range(8):
        for x in range(8):
            ys = range(min(y * h // 8, h - 1), max((y + 1) * h // 8, y * h // 8 + 1))
            xs = range(min(x * w // 8, w - 1), max((x + 1) * w // 8, x * w // 8 + 1))
            cells.append(sum(grid[b][a] for b in ys for a in xs) / (len(ys) * len(xs)))
    mean = sum(cells) / 64
    return f"{int(''.join('1' if c > mean else '0' for c in cells), 2):016x}"


def test_features_are_those_of_a_plain_decoder(spark, docs, rows):
    for r in jpeg.media_columns(docs.where(F.length("text") < 2000), with_media=True).collect():
        raw = b""
        for mark, (wide, high, grid) in zip(r.feature.split(";"), plain_picture(r.media), strict=True):
            size, own = mark.split(":")
            assert size == f"{wide}x{high}" and own == plain_hash(grid)
            raw += bytes(v for line in grid for v in line)
        assert hashlib.sha256(raw[: r.payload_bytes]).hexdigest() == r.payload_sha256


# --- mixing and sharding ------------------------------------------------------------------------------------------


def test_mixing(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and as_rows(mixing.mix(docs)) == as_rows(mixing.mix(docs.repartition(7)))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = Counter()
    for r in rows:
        by[r[3]] += size(r[1])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    total, capped = 1.5 * sum(by.values()), set()
    while True:  # those above twice their size stop there; the rest is shared again
        left = (total - sum(2 * by[s] for s in capped)) / max(1, sum(weight[s] for s in by if s not in capped))
        more = {s for s in by if s not in capped and weight[s] * left > 2 * by[s]}
        if not more:
            break
        capped |= more
    want = {s: 2.0 * by[s] if s in capped else weight[s] * left for s in by}
    assert sorted({(r.source_size, round(r.target, 6)) for r in got}) == sorted({(by[s], round(want[s], 6)) for s in by})
    assert all(0 <= r.taken <= 2 * r["size"] and r.taken == r.copies * r["size"] for r in got)
    assert abs(sum(r.taken for r in got) - total) < 0.2 * total
    assert mixing.mix(empty).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)


def test_sharding(spark, docs, rows, empty):
    got = sharding.shard(docs, carry=("lang",)).collect()
    assert len(got) == len(rows) and all(r.law == "key" and r.grown_shard in (r.shard, 40) for r in got)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert as_rows(sharding.shard(docs)) == as_rows(sharding.shard(docs.repartition(5))) and sharding.shard(empty).count() == 0


def plain_shard(key, shards, weights={}):
    """The descent once more: regions of four racks of five shards, and each shard from 40 on a region of its own."""
    racks = [[s for s in range(i, i + 5) if s < shards] for i in range(0, 40, 5)]
    node = [[r for r in racks[i : i + 4] if r] for i in range(0, 8, 4)] + [[[s]] for s in range(40, shards)]
    weight = lambda x: sum(map(weight, x)) if isinstance(x, list) else weights.get(x, 1.0)
    for level in range(3):
        drawn = []
        for k, child in enumerate(node):
            name = child
            while isinstance(name, list):
                name = name[0]
            u = (int(hashlib.md5(f"{key}|{level}.{name}".encode()).hexdigest()[:12], 16) + 1) / 2**48
            drawn.append((-math.log(u) / weight(child), k))
        node = node[min(drawn)[1]]
    return node


def test_shards_are_those_of_a_plain_descent(spark, docs, rows, monkeypatch):
    want = Counter()
    for i, t, *_ in rows:
        key = "null" if i is None else str(i)
        want[i, zlib.crc32((t or "").encode()), plain_shard(key, 40), plain_shard(key, 41)] += 1
    got = sharding.shard(docs)
    assert Counter((r.doc_id, r.text_crc32, r.shard, r.grown_shard) for r in got.collect()) == want
    key = lambda r: "null" if r.doc_id is None else str(r.doc_id)
    for s in {r.shard for r in got.collect()}:
        order = [hashlib.md5(f"{key(r)}|slot".encode()).hexdigest() for r in sorted((r for r in got.collect() if r.shard == s), key=lambda r: r.slot)]
        assert order == sorted(order)
    monkeypatch.setattr(sharding, "CELL", 0.001)  # more digits, the same slots
    assert as_rows(sharding.shard(docs)) == as_rows(got)


def test_weights_of_shards(spark):
    ids = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    heavy = sharding.Tree(weights=((7, 3.0),))
    n = {r[0]: r[1] for r in sharding.shard(ids, tree=heavy).groupBy("shard").count().collect()}
    assert 0.85 < n[7] / (3 * 40_000 / 42) < 1.15 and all(0.8 < n[s] / (40_000 / 42) < 1.2 for s in range(40) if s != 7)
    moved = sharding.shard(ids).select("doc_id", F.col("shard").alias("a")).join(sharding.shard(ids, tree=heavy).select("doc_id", F.col("shard").alias("b")), "doc_id").where("a <> b")
    # only into the heavier shard, or into a subtree above it whose weight grew
    assert moved.where("b >= 20").count() == 0


# --- Jaccard join -------------------------------------------------------------------------------------------------


def plain_components(rows, k, percent):
    sets = []
    for _, t, *_ in rows:
        w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    ids: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            ids[find(i)] = min(ids.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), (ids.get(find(i)) if s else r[0])) for i, (r, s) in enumerate(zip(rows, sets, strict=True))), key=repr)


@pytest.mark.parametrize("options", [{}, {"shingle": 1, "percent": 60}, {"shingle": 2, "percent": 70, "small_bucket": 1, "block": 3, "broadcast_ids": 0}, {"shingle": 2, "percent": 70, "small_bucket": 1, "block_items": 100}, {"shingle": 5, "percent": 80}])
def test_jaccard(spark, docs, rows, empty, options):
    o = jaccard.JoinOptions(**options)
    assert as_rows(jaccard.jaccard_components(docs, options=o)) == plain_components(rows, o.shingle, o.percent)
    if not options:
        assert jaccard.jaccard_components(empty).count() == 0
        kept = jaccard.deduplicated(docs.where("doc_id IS NOT NULL"))
        want = {i for i, _, c in plain_components([r for r in rows if r[0] is not None], 4, 85) if i == c}
        assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want


def test_jaccard_links_through_rows_without_id(spark):
    """Near copies, of which those in the middle have no id and no exact copy."""
    w = [f"w{i}" for i in range(200)]
    rows = [(7, " ".join(w)), (None, " ".join([*w, *(f"x{i}" for i in range(20))])), (8, " ".join([*w, *(f"x{i}" for i in range(44))])), (None, "a b c d e f"), (None, "a b c d e f g h"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for o in (jaccard.JoinOptions(), jaccard.JoinOptions(small_bucket=1, block=3, broadcast_ids=0)):
        got = as_rows(jaccard.jaccard_components(docs, options=o))
        assert got == plain_components(rows, 4, 85) and {r[2] for r in got if r[0] in (7, 8)} == {7}


def test_one_row_of_each_component_stays(spark):
    a, b, c = ("a b c d e f g h", "p q r s t u v w", "k l m n o p q r")
    rows = [(5, a, 1), (5, a, 1), (None, a, 1), (5, b, 1), (2, b, 1), (None, c, 1), (None, c, 1), (2, "alone here it is", 1), (None, None, 1), (None, " ", 1), (3, None, 1), (3, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int").repartition(3)
    want = [(5, a, 1), (2, b, 1), (None, c, 1), *rows[7:]]
    assert as_rows(jaccard.deduplicated(docs)) == sorted(want, key=repr)


def test_similar_sets_share_enough_signatures():
    """For random sets of all sizes at the limit of similarity, as many as the candidates are asked for."""
    draw = np.random.default_rng(5)
    for percent in (60, 85, 95):
        o = jaccard.JoinOptions(percent=percent)
        limits, ranges = jaccard.band_limits(o, 5000), jaccard.ranges_by_band(o)
        for _ in range(300):
            n = int(draw.integers(1, 900))
            union = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            lost = int(len(union) * (100 - percent) / 100)
            owner = np.zeros(len(union), int)
            owner[draw.permutation(len(union))[:lost]] = draw.integers(1, 3, lost)
            a, b = union[owner != 1], union[owner != 2]
            if not len(a) or not len(b) or 100 * (len(union) - lost) < percent * len(union):
                continue
            common = set(jaccard.signatures(a, o, limits).tolist()) & set(jaccard.signatures(b, o, limits).tolist())
            band = max(int(np.searchsorted(limits, len(s), side="right")) - 1 for s in (a, b))
            need = max(1, ranges[band] - (len(a) + len(b)) * (100 - percent) // (100 + percent))
            assert sum(int(x) % jaccard.BANDS == band for x in common) >= need


def test_sets_that_share_too_few_signatures_take_no_room(spark, monkeypatch):
    """Sizes at the upper end of a band, and a passage in all of them: no signatures are written, no set is loaded."""
    o, written, real = jaccard.JoinOptions(), [], jaccard.checkpointed
    high = max(x for x in jaccard.band_limits(o, 600) if x <= 600) - 1
    passage = [f"p{i}" for i in range(24)]
    rows = [(d, " ".join(passage + [f"{d}w{i}" for i in range(high + o.shingle - 1 - len(passage))])) for d in range(60)]
    limits = jaccard.band_limits(o, 2 * high)
    sigs = [jaccard.signatures(s, o, limits).tolist() for s in jaccard._sets([t for _, t in rows], o)]
    assert all(high == len(s) for s in jaccard._sets([t for _, t in rows], o)) and len({x for s in sigs for x in s}) < sum(map(len, sigs))

    def watched(df):
        written.append((df.columns, real(df)))
        return written[-1][1]

    for module in (jaccard, common):
        monkeypatch.setattr(module, "checkpointed", watched)
    got = as_rows(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), options=o))
    assert got == plain_components(rows, o.shingle, o.percent) and len({r[2] for r in got}) == 60
    assert sum(t.count() for c, t in written if {"sig", "sigs", "items"} & set(c)) == 0


def test_things_that_share_a_hash_are_told_apart(spark):
    """Hashes of three bits: some salt may do for a few things, none does for many."""
    from lexspark.llm.common import told_apart

    make = lambda n: lambda salt: spark.range(n).select("id", F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(8)).alias("h"))
    rows, salt = told_apart(make(3), "h", "id", tries=50)
    assert rows.select("h").distinct().count() == 3
    with pytest.raises(ValueError, match="h is no hash"):
        told_apart(make(9), "h", "id", tries=3)
    s = np.arange(5, dtype=np.uint64)
    assert len({jaccard._set_id(s, k) for k in (0, 1, jaccard._OTHER)}) == 3


def test_owners_in_parts():
    draw = np.random.default_rng(3)
    for limit in (1, 7, 1000):
        owner = draw.integers(0, 9, 200)
        low = draw.integers(0, 150, 40)
        n = draw.integers(0, 50, 40)
        want = Counter(int(owner[x]) for a, k in zip(low, n, strict=True) for x in range(a, a + k))
        assert jaccard._owners(owner, low, n, 9, limit).tolist() == [want[i] for i in range(9)]
    assert jaccard._owners(owner, low[:0], n[:0], 9).tolist() == [0] * 9


def test_components(spark):
    draw = random.Random(3)
    for n, m in ((1, 0), (40, 25), (60, 59)):
        links = [(i, i + 1) for i in range(n - 1)] if m == n - 1 else [(draw.randrange(n), draw.randrange(n)) for _ in range(m)]
        name = draw.sample(range(n), n)  # nodes are hashes, in no order along a chain
        links = [(name[a], name[b]) for a, b in links]
        parent = {i: i for i in range(n)}

        def find(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in links:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        got = {r.node: r.label for r in jaccard.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {i: find(i) for pair in links if pair[0] != pair[1] for i in pair}


def test_regular_words_do_not_fall_together():
    """Words that every polynomial modulo a power of two takes for equal."""
    one, two = "a", "b"
    while len(one) < 1024:
        one, two = one + two, two + one
    a, b = hashing.word_hashes([one.encode(), two.encode()])
    assert a[0] != b[0]
    many = [bytes([97 + (i >> k) % 2 for k in range(14)]) for i in range(1 << 14)]
    assert len({int(x[0]) for x in hashing.word_hashes(many)}) == len(many)


def test_words_of_long_texts():
    draw = random.Random(4)
    texts = ["".join(draw.choice("ab \n\x0b") for _ in range(n)).encode() for n in (0, 1, 40, hashing.PIECE * 2 + 7)] + [b"x" * (hashing.PIECE * 2), b"A a", b" "]
    short = {w: hashing.word_hashes([w])[0][0] for t in texts[:4] for w in set(t.split())}
    for t, got in zip(texts[:4], hashing.word_hashes(texts), strict=False):
        assert got.tolist() == [short[w] for w in t.split()]
    assert len(hashing.word_hashes(texts)[4]) == 1 and len(set(hashing.word_hashes([b"A a"])[0].tolist())) == 1
