"""HTML extraction, periodic runs and fill-in-middle against plain versions, and on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib
from html.parser import HTMLParser

import pytest

from flowlens.llm import line_blocks, middle_frames, periodic_runs
from flowlens.llm.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


class Article(HTMLParser):
    """Plain version for well-marked pages: all text inside ``article``, outside the elements to skip."""

    SKIP = {"script", "style", "nav", "aside", "footer", "form"}

    def __init__(self):
        super().__init__()
        self.inside, self.skipped, self.pieces = 0, 0, []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.skipped += tag in self.SKIP
        self.pieces.append(" " if tag not in ("a", "b", "i", "em", "span") else "")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        self.skipped -= tag in self.SKIP
        self.pieces.append(" " if tag not in ("a", "b", "i", "em", "span") else "")

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.pieces.append(data)


def article_of(page):
    reader = Article()
    reader.feed(page or "")
    reader.close()
    return " ".join("".join(reader.pieces).split())


def test_pages_of_the_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    got = {r["page_id"]: r for r in QUERIES["op11_html_text"](spark, SMALL).collect()}
    assert len(got) == len(pages)
    for page in pages:
        assert got[page["page_id"]]["text"] == article_of(page["html"])
        assert got[page["page_id"]]["url"] == page["url"] and got[page["page_id"]]["n_chars"] == len(article_of(page["html"]))


def test_marked_article_keeps_all_and_only_its_own_text():
    page = """<!doctype html><html><head><title>T</title></head><body class="has-sidebar">
      <header><h1>Site</h1><p>A long slogan of the site that would surge on its own if it were not in the header of the page.</p></header>
      <nav><ul><li><a href=x>One</a><li><a href=y title="a > b">Two</a></ul></nav>
      <div class="cookie-notice"><p>We use cookies for many reasons which this long notice explains at great length to everybody.</p></div>
      <main><article class="post"><header><h2>Title &amp; more</h2></header><p>Short.<p>Two&nbsp;&nbsp;words <b>bo</b>ld<br>next
      <script>if (a < b) document.write("</p>")</script><!-- gone --><ul><li>item<li>other</ul>
      <aside>Not this.</aside><form><p>Nor this <input value="x"></form><div class="share-buttons">Share!</div>
      <p>5 < 6 and 7 > 3 &lt;b&gt; &#x65e5; &eacute; end</p><p></p><p>Im.</article>
      <section id="comments"><article class="comment"><p>A reader's comment that is long enough to surge, were it not marked as such.</p></article></section>
      </main><footer>&copy; us</footer></body></html>"""
    assert line_blocks.main_text(page) == ("Title & more Short. Two words bold next item other "
                                           "5 < 6 and 7 > 3 <b> 日 é end Im.")


def test_unmarked_pages_follow_surge_and_dive():
    text = [f"Sentence {i} of the story is long enough to count as text in any window of lines." for i in range(6)]
    links = "".join(f"<li><a href=/{i}>Some section of the site number {i}</a></li>" for i in range(12))
    page = (f"<body><div id=top><ul>{links}</ul></div><div><div><p>{'</p><p>'.join(text[:3])}</p><p>Brief.</p>"
            f"<p>{'</p><p>'.join(text[3:])}</p></div></div><div><div><ul>{links}</ul></div></div><div>Imprint</div></body>")
    assert line_blocks.main_text(page) == " ".join([*text[:3], "Brief.", *text[3:]])
    assert line_blocks.main_text("<body><div><p>Only a few words.</p></div></body>") == "Only a few words."
    assert line_blocks.main_text("<div class=comments><p>All there is.</p></div>") == "All there is."


@pytest.mark.parametrize("page", ["", "   ", "<", "<b", "</", "<!--", "<script>", "<script>x</scrip", "<p", "&", "&#xD800;", "</p></div>",
                                  "<title>", "<table><tr><td>a<td>b<tr><td>c", "<a <b <c", "<p a='", "<svg><p>x", "<article>", "<xmp><b></xmp>"])
def test_broken_markup_has_some_result(page):
    assert isinstance(line_blocks.main_text(page), str)


def test_random_markup_never_fails():
    random.seed(11)
    parts = ["<p>", "</p>", "<div class=ad>", "</div>", "<b>", "</b>", "text ", "&amp;", "<li>", "<ul>", "</ul>", "<td>", "<table>", "</table>",
             "<article>", "</article>", "<!-- x -->", "<script>", "</script>", "<", ">", "<a href='", "'", "<nav>", "</nav>", "<option>", "<br>"]
    for _ in range(3000):
        page = "".join(random.choices(parts, k=random.randint(0, 40)))
        assert line_blocks.main_text(page) == " ".join(line_blocks.main_text(page).split())


def test_windows_of_lines():
    import numpy as np
    assert line_blocks.between_surge_and_dive(np.array([5, 0, 0, 0, 90, 1, 0, 0, 2, 0, 0, 0, 9])) == [(4, 9)]
    assert line_blocks.between_surge_and_dive(np.array([5, 0, 0, 0, 7, 1])) == [(4, 6)]
    assert line_blocks.between_surge_and_dive(np.zeros(4, int)) == []
    assert line_blocks.between_surge_and_dive(np.array([1, 1, 1, 1, 80])) == [(2, 5)]


def plain_runs(words, periods=4, least=6):
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, periods * q):
                found.setdefault((start, i - start + q), q)
    return sorted([(s, m, q) for (s, m), q in found.items()], key=lambda r: (r[0], r[2]))


def repetitive(n, letters):
    words = []
    while len(words) < n:
        words += random.choices(letters, k=random.randint(1, 6)) * random.randint(1, 6)
        words = words[: max(0, len(words) - random.randint(0, 2))]
    return words


def test_runs_equal_brute_force():
    random.seed(12)
    for i in range(600):
        letters = [b"a", b"b", b"c", b"d"][: random.randint(1, 4)]
        words = repetitive(random.randint(0, 70), letters) if i % 2 else random.choices(letters, k=random.randint(0, 70))
        assert periodic_runs.runs_of_words(words) == plain_runs(words)
        ids = [letters.index(w) for w in words]
        assert periodic_runs.runs_of(ids, 2, 1) == plain_runs(words, 2, 1)
    for words in map(list, itertools.product([b"x", b"y"], repeat=10)):
        assert periodic_runs.runs_of_words(words) == plain_runs(words)


def test_suffix_tree_ranks_and_extensions():
    import numpy as np
    random.seed(13)
    for _ in range(60):
        ids = random.choices(range(3), k=random.randint(1, 40))
        tree = periodic_runs.SuffixTree(ids)
        order = sorted(range(len(ids) + 1), key=lambda i: ids[i:])
        assert [int(r) for r in tree.rank[order]] == list(range(len(ids) + 1))
        pairs = list(itertools.combinations(range(len(ids)), 2))
        if pairs:
            got = tree.extension(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
            for (a, b), g in zip(pairs, got.tolist(), strict=True):
                same = sum(1 for _ in itertools.takewhile(lambda t: t[0] == t[1], zip(ids[a:], ids[b:], strict=False)))
                assert g == same


def test_long_periodic_texts():
    words = [b"w%d" % (i % 977) for i in range(30_000)]
    assert periodic_runs.runs_of_words(words) == [(0, 30_000, 977)]
    assert periodic_runs.runs_of_words([b"a"] * 30_000) == [(0, 30_000, 1)]


def planted(words, key):
    h = zlib.crc32(str(key).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_runs_of_the_query_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op12_periodic_runs"](spark, SMALL).collect()}
    some = 0
    for doc in docs:
        words = planted(re.findall(rb"[^\x20\x09-\x0D]+", (doc["text"] or "").encode()), doc["doc_id"])
        runs, row = plain_runs(words), got[doc["doc_id"]]
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        some += bool(runs)
    assert some > 10


def test_frames_cut_find_and_restore():
    random.seed(14)
    for key in range(800):
        text = "".join(random.choice(["a", "é", "\n", "日", "<", "P", ">", "bcd", "<S>" if key % 7 == 0 else "x"]) for _ in range(random.randint(0, 80)))
        size = random.choice([1, 2, 3, 7, 16, 1000])
        writer = middle_frames.Writer(size)
        writer.write(text.encode())
        stored = writer.close()
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        assert stored.lines == len(units) and stored.total[2] == len(text)
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert stored.after(k, len(units)) == (len(before.encode()), len(before))
        assert stored.find(b"bcd") == text.encode().find(b"bcd")
        form, lines, prefix, middle, out = middle_frames.rearranged(stored, key, size=size)
        first, second, _, order = middle_frames.draws(key)
        a, b = sorted((first % (lines + 1), second % (lines + 1)))
        pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
            want = ("plain", text, None, None)
        elif order % 100 < 50:
            want = ("spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid))
        else:
            want = ("psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid))
        output = out.close()
        raw = b"".join(output.stream(0, output.total[0]))
        assert (form, raw.decode(), prefix, middle) == want
        assert b"".join(middle_frames.restored(output, form)).decode() == text


def test_cuts_decompress_one_frame():
    writer = middle_frames.Writer(64)
    writer.write(b"".join(b"line %d\n" % i for i in range(1000)))
    stored, opened = writer.close(), []
    plain = stored.frame
    stored.frame = lambda i: opened.append(i) or plain(i)
    assert stored.after(500, 1000)[0] == sum(len(b"line %d\n" % i) for i in range(500)) and len(opened) == 1


AWKWARD = [(1, "one two\nthree"), (1, "one two\nthree"), (2, None), (3, ""), (4, " \n\t "), (None, "no id here"),
           (5, " ".join(f"w{i % 97} x{i}" for i in range(30_000))), (6, "Ünï cödé — 日本語 \U0001F600 ok"), (7, "a a a a a a a\n<P>\n"),
           (8, "x\ny\n")]


def test_awkward_documents(spark):
    docs = spark.createDataFrame(AWKWARD, "doc_id long, text string")
    runs = periodic_runs.periodic_runs(docs, texts=True).collect()
    middles = middle_frames.fill_in_middle(docs, size=5).collect()
    stored = middle_frames.store(docs, size=5)
    back = middle_frames.texts(stored).collect()
    whole = middle_frames.texts(middle_frames.transform(stored, size=5, outputs=True), "output_frames", "output").collect()
    ids = sorted(str(k) for k, _ in AWKWARD)
    for rows in (runs, middles, back, whole):
        assert sorted(str(r["doc_id"]) for r in rows) == ids
    assert sorted(r["text"] for r in back) == sorted(t or "" for _, t in AWKWARD)
    for r in whole:
        assert hashlib.sha256(r["output"].encode()).hexdigest() == r["output_sha256"]
    texts = {hashlib.sha256((t or "").encode()).hexdigest() for _, t in AWKWARD}
    assert {r["restored_sha256"] for r in middles} == texts
    assert {r["doc_id"]: (r["form"], r["n"]) for r in middles if r["doc_id"] in (2, 3, 7)} == {2: ("plain", 0), 3: ("plain", 0), 7: ("plain", 2)}
    seven = next(r for r in runs if r["doc_id"] == 7)
    assert [tuple(x) for x in seven["runs"]] == [(0, 7, 1)] and seven["collapsed"] == "a <P>"
    assert all(r["n_runs"] == 0 and r["start"] is None for r in runs if r["doc_id"] != 7)


def test_awkward_pages(spark):
    rows = [(1, "u", "<article>one</article>"), (1, "u", "<article>one</article>"), (2, None, None), (3, "v", ""), (None, "w", "<p>text</p>"),
            (5, "x", "<article>" + "<p>word word</p>" * 50_000), (6, "y", "<p hidden>secret</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = line_blocks.extract_text(pages).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in rows)
    by = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in got}
    assert by[1] == ("u", "one", 3) and by[2] == (None, "", 0) and by[3] == ("v", "", 0) and by[None] == ("w", "text", 4)
    assert by[5][2] == 500_000 - 1 and by[6] == ("y", "", 0)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.periodic_runs(docs).collect() == middle_frames.fill_in_middle(docs).collect() == []
    assert line_blocks.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
    names = ["_id", "_text", "_page", "_k0", "_k1", "n", "form", "frames", "n_bytes", "n_chars", "runs", "length", "period", "start", "output_frames"]
    wide = spark.createDataFrame([(1, "a b", *["q"] * len(names))], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert periodic_runs.periodic_runs(wide, texts=True).first()["n_words"] == 2
    assert middle_frames.fill_in_middle(wide, outputs=True).first()["n"] == 1
    pages = wide.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("n", "url")
    assert line_blocks.extract_text(pages).first()["text"] == "a b"
