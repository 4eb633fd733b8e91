"""Spelling variants, fill-in-the-middle and page text against brute force, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from loomery.llm import fill_middle, html_text, spelling

CLASHING = "doc_id long, text string, n long, form string, output string, word string, key long"


def frame(spark, rows):
    """rows: (doc_id, text), with columns whose names clash with those of results."""
    return spark.createDataFrame([(*r, 7, "x", "y", "z", 9) for r in rows], CLASHING).repartition(3)


# --- spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, least_chars=5, least_n=3):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_n}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] else None)
    return out


def variants(docs):
    got = spelling.spelling_variants(docs).collect()
    assert len({r["word"] for r in got}) == len(got)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}


def test_spelling_variants_equal_all_pairs(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choices("abé", k=rng.randint(4, 9))) for _ in range(120)]

    def typo(w):
        i, c = rng.randrange(len(w) + 1), rng.choice("abéÿ")
        return rng.choice([w[:i] + c + w[i:], w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :]])

    rows = []
    for i in range(160):
        line = [w if rng.random() < 0.7 else typo(w) for w in rng.choices(stems, weights=range(1, 121), k=80)]
        rows.append((i, rng.choice([" ", "\n", "-", "5"]).join(line)))
    rows += [(None, "ABABA abab ababa Éabab éabab × ababa×"), (500, None), (501, ""), (502, "a" * 3000), (503, "a" * 3000 + " " + "a" * 3001), (504, "a" * 3000 + ". " + "a" * 3001), (505, "a" * 3001), rows[0], rows[0]]
    want = plain_variants(rows)
    assert sum(v[3] > 0 for v in want.values()) > 100 and any(v[0] and v[1] != v[0] for v in want.values())
    assert variants(frame(spark, rows)) == want


def test_spelling_words_of_one_letter_and_without_near_words(spark):
    rows = [(i, "aaaaa aaaaaa aaaaaaa bbbbb zzzzz") for i in range(40)] + [(i, "aaaaaa aaaaaa") for i in range(40, 80)]
    assert variants(frame(spark, rows)) == plain_variants(rows)


def test_spelling_of_nothing(spark):
    assert variants(frame(spark, [])) == {}
    assert variants(frame(spark, [(1, None), (2, "some words twice, words twice")])) == {}
    with pytest.raises(ValueError):
        spelling.spelling_variants(frame(spark, []), least_chars=3)


def test_rare_bigrams_of_near_words_meet():
    """Every pair at one edit shares a key, whatever the order of bigrams."""
    rng = random.Random(5)
    for _ in range(4000):
        a = "".join(rng.choices("ab", k=rng.randint(5, 12)))
        i, c = rng.randrange(len(a) + 1), rng.choice("abc")
        b = rng.choice([a[:i] + c + a[i:], a[:i] + c + a[i + 1 :]])
        if not one_edit(a, b):
            continue
        counts = {x + y: rng.randint(1, 4) for x in "abc" for y in "abc"}
        keys = lambda w, role: {k for at in spelling.rarest(w, counts) for k, r in spelling.meeting_keys(w, at) if r == role}  # noqa: E731,B023
        assert keys(a, 0) & keys(b, len(b) - len(a)), (a, b)


def test_pieces_cut_no_run():
    text = ("word été " * 50 + "x" * 100 + " ÷ 中 ").encode()
    assert b"".join(spelling.pieces(text, 7)) == text
    assert [r for p in spelling.pieces(text, 7) for r in spelling.RUN.findall(p)] == spelling.RUN.findall(text)


# --- fill in the middle


def plain_middle(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("ab Zé\n\t<>PSM中\U0001f600", k=rng.randint(0, 60)))) for i in range(400)]
    rows += [(900, None), (901, ""), (902, "<P> here"), (903, "a<S>"), (904, "<M>"), (None, "no id <here <"), (905, "word " * 60_000), (906, "\U0001f600" * 5000), (907, "<"), (908, "<P"), rows[3], rows[3]]
    got = fill_middle.fill_in_middle(frame(spark, rows)).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in got))) == sorted(repr((d, *plain_middle(d, t))) for d, t in rows)
    text = {d: t or "" for d, t in rows}
    assert all(r["back"] == text[r["doc_id"]] for r in got)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_an_empty_table_and_other_ids(spark):
    assert fill_middle.fill_in_middle(frame(spark, [])).collect() == []
    named = spark.createDataFrame([("a", "one two"), ("b", None)], "text string, body string")
    got = fill_middle.fill_in_middle(named, key="text", text="body").collect()
    assert [(r["text"], r["n"]) for r in got] == [("a", 3), ("b", 0)]


def test_cuts_are_where_units_end():
    text = "ab1 cdé中x".encode()
    ends = [0, *(m.end() for m in fill_middle.UNIT.finditer(text))]
    for a in range(len(ends)):
        for b in range(a, len(ends)):
            assert fill_middle.cuts(text, a, b) == (ends[a], ends[b])


# --- page text

NAV = "<nav><ul><li><a href='/a'>{0}</a></li><li>{1}</li></ul></nav>"
PAGE = "<!DOCTYPE html><html><head><title>T {0}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{1}<article><h1>Title {0}</h1>{2}</article>{3}</body></html>"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "s", 3, "t", 4) for r in rows], "page_id long, url string, html string, site string, n_chars long, text string, own long").repartition(3)


def texts(df, **more):
    out = {}
    for r in html_text.extract_text(df, **more).collect():
        assert r["n_chars"] == len(r["text"])
        out.setdefault(r["page_id"], []).append(r["text"])
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def test_page_text_of_odd_input(spark):
    rows = [
        (1, "http://a.org/", None),
        (2, None, ""),
        (3, "no host", "just <b>text</b> &lt;here&gt;\n\n and\tthere"),
        (4, "http://a.org/x", "<article><p>One<p>Two <b>bold<br>line</p><!-- gone --><script>if (a<b) '</p>'</script>&amp &notit; &#233;&#xe9;</article><p>after"),
        (5, "http://a.org/y", "<body><header>Site</header><div class='cookie-notice'>We use</div><main><header><h1>Head</h1></header><p>a < b</p><aside>side</aside><form><p>in</p></form></main><section id=comments><article class='comment'>hm</article></section>"),
        (6, "http://a.org/z", "<article>a<p title='x > y'>b</article"),
        (7, "http://a.org/z", "<ul><li>one<li>two</ul><table><tr><td>1<td>2</table><a title=\"open"),
        (8, "http://a.org/z", "<div>" * 3000 + "deep" + "<p>x</p>" * 3000),
        (9, "http://a.org/z", "word " * 50_000),
        (10, "http://a.org/z", "<article><p>kept<div class='ad'>sold</div>also</p></article><article><p>second</article>"),
        (None, None, "<p>no id"),
        (11, "u", "<p>twice"),
        (11, "u", "<p>twice"),
    ]
    got = texts(pages(spark, rows))
    assert got[1] == got[2] == ""
    assert got[3] == "just text <here> and there"
    assert got[4] == "One\nTwo bold line\n& ¬it; éé"
    assert got[5] == "Head\na < b"
    assert got[6] == "a\nb"
    assert got[7] == "one\ntwo\n1\n2"
    assert got[8] == "deep\n" + "\n".join(["x"] * 3000)
    assert got[9] == " ".join(["word"] * 50_000)
    assert got[10] == "kept\nalso\nsecond"
    assert got[None] == "no id" and got[11] == ["twice", "twice"]
    assert texts(pages(spark, [])) == {}


def test_template_of_a_host_goes_though_nothing_names_it(spark):
    """Boxes without telling names: one of fixed words within the articles, one of the same shape with other words outside of them."""
    box, rows = "<div class=k1><div>Read</div><div>our paper</div></div>", []
    for i in range(30):
        out = f"<div class=k2><div>offer {i}</div></div>"
        rows.append((i, f"http://one.org/{i}", PAGE.format(i, out, f"<p>Text {i}</p>{box}<p>One line of all</p>", out)))
    rows += [(100, "http://two.org/", PAGE.format("alone", "", f"<p>Text</p>{box}", "<div class=k2><div>offer</div></div>"))]
    plain = "<html><body><div class=top>Our house</div><div class=b{0}><p>Line {0}</p><p>Same</p></div><div class=end>Call us</div></body></html>"
    rows += [(200 + i, f"http://three.org/{i}", plain.format(i)) for i in range(6)] + [(300, "http://four.org/", plain.format(300))]
    got = texts(pages(spark, rows))
    assert all(got[i] == f"Title {i}\nText {i}\nOne line of all" for i in range(30))
    assert got[100] == "Title alone\nText\nRead\nour paper"  # the box recurs on another host only
    assert all(got[200 + i] == f"Line {i}\nSame" for i in range(6))
    assert got[300] == "Our house\nLine 300\nSame\nCall us"


def test_copies_of_a_page_are_no_template(spark):
    page = "<body><div class=x><div>An old story</div><p>told here</p></div></body>"
    rows = [(i, "http://one.org/", page) for i in range(20)]
    assert set(texts(pages(spark, rows)).values()) == {"An old story\ntold here"}


def test_templates_of_few_and_of_unlike_pages_stay(spark):
    box = "<div class=k1><div>Box</div></div>"
    few = [(i, "http://one.org/", PAGE.format(i, "", f"<p>T {i}</p>{box}", "")) for i in range(2)]
    rare = [(10 + i, "http://two.org/", PAGE.format(i, "", f"<p>T {i}</p>{box if i < 4 else ''}", "")) for i in range(10)]
    got = texts(pages(spark, few + rare))
    assert got[0].endswith("Box") and got[13].endswith("Box")
    assert not texts(pages(spark, few + rare), share=0.3)[13].endswith("Box")


class Plain(HTMLParser):
    """What stands in the article of a page without anything to remove there, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.on, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.on = self.on or tag == "article"
        self.blocks += [] if tag in ("b", "i", "a") else [""] if tag != "br" else []
        if tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.on = self.on and tag != "article"
        self.blocks += [] if tag in ("b", "i", "a") else [""]

    def handle_data(self, data):
        if self.on:
            self.blocks[-1] += data


def test_page_text_equals_a_plain_parser(spark):
    rng = random.Random(6)
    words = lambda: " ".join(rng.choices(["uno", "dós", "a&amp;b", "&quot;c&quot;", "&lt;p&gt;", "x\ny", "&nbsp;", "&eacute;"], k=rng.randint(1, 9)))
    rows, want = [], {}
    for i in range(120):
        body = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<h2>{}</h2>", "<p><i>{}</i> <a href=x>{}</a></p>"]).format(words(), words()) for _ in range(rng.randint(0, 12)))
        html = PAGE.format(words(), NAV.format(words(), words()) + f"<div class='ad'>{words()}</div>", body, f"<footer>{words()}</footer>")
        plain = Plain()
        plain.feed(html)
        rows.append((i, f"http://{i % 7}.example.org/{i}", html[: rng.choice([len(html), html.index("</article>") + 10])]))
        want[i] = "\n".join(x for x in (" ".join(b.split()) for b in plain.blocks) if x)
    assert texts(pages(spark, rows)) == want
