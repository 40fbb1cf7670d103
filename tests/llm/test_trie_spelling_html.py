"""Prefix trie, spelling variants and page texts against brute force and written pages."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flockscope.llm import html_extract, prefix_trie, spelling

# 11 prefix trie

TURNS = "conv_id long, turn long, role string, text string, pos long, total long, low string, p1 int, n_bytes string, at string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3, "y", "z") for r in rows], TURNS)


def brute_sequences(rows, rebuild):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append(((t is not None, t or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    if not rebuild:
        return own
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        out[c] = own.get(base, [])[:h] + mine[h:]
    return out


def brute_trie(sequences):
    members = defaultdict(list)
    for c, s in sequences.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    out = {}
    for p, who in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = [q for q in below if len(q) == len(p) + 1]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(who) if len(sequences[c]) == len(p))
        out[min(who), len(p)] = (min(members[p[:-1]]) if p else None, len(who), len(children), sum(not any(len(r) > len(q) and r[: len(q)] == q for r in below) for q in below),
                                 saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def nodes(df):
    rows = df.collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def talk():
    """Shared openings, equal conversations, a long one, nulls, empty texts, repeated rows, negative ids, missing bases."""
    rng = random.Random(11)
    openings = [[("system", "sé"), ("user", f"q{i}")] for i in range(3)]
    rows = []
    for c in [*range(60), 101, 102, -3, -7]:
        turns = list(rng.choice(openings)) + [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "", "ü€"])) for _ in range(rng.randint(0, 6))]
        rows += [(c, i, r, t) for i, (r, t) in enumerate(turns)]
    for c in range(200, 240):  # equal
        rows += [(c, i, "user", "same") for i in range(4)]
    rows += [(300, i, "user", f"long {i}") for i in range(150)] + [(305, i, "user", f"long {i}") for i in range(120)]
    rows += [(400, None, None, None), (400, 0, "user", None), (400, 0, "user", None), (401, 5, None, "x"), (None, 0, "user", "lost"), (402, 1, "user", "y"), (402, None, "user", "first")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("shard_rows", "part"), [(1024, 4096), (12, 4096), (1, 3)])
def test_trie(spark, talk, shard_rows, part, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SLICE", part)
    ranked = prefix_trie.turns(conversations(spark, talk))
    assert nodes(prefix_trie.trie(prefix_trie.rebuilt(ranked), shard_rows)) == brute_trie(brute_sequences(talk, True))
    if part == 3:
        assert nodes(prefix_trie.trie(prefix_trie.whole(ranked), shard_rows)) == brute_trie(brute_sequences(talk, False))


def test_trie_of_an_empty_table(spark, talk):
    ranked = prefix_trie.turns(conversations(spark, talk).limit(0))
    assert prefix_trie.trie(prefix_trie.rebuilt(ranked)).count() == 0


def test_trie_without_turns(spark):
    """A conversation whose base is missing and whose own turns are replaced ends at the root."""
    gone = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(gone, 0, "user", "a")]
    got = nodes(prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.turns(conversations(spark, rows)))))
    assert got == {(gone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(gone).encode()).hexdigest())}


@pytest.mark.parametrize("seed", range(4))
def test_louds(seed):
    rng = random.Random(seed)
    sequences = [[rng.randint(0, 2) for _ in range(rng.randint(1, 7))] for _ in range(40)]
    rows = [(m, d + 1, x) for m, s in enumerate(sequences) for d, x in enumerate(s)]
    rng.shuffle(rows)
    member, level, label = (np.array(c) for c in zip(*rows, strict=True))
    trie, labels, node = prefix_trie.build(member, level, np.stack([label, -label], 1))
    parent = trie.parents()
    prefix = {0: ()}
    for i in range(1, trie.n):
        prefix[i] = (*prefix[parent[i]], labels[i, 0])
    assert set(prefix.values()) == {tuple(s[:d]) for s in sequences for d in range(len(s) + 1)} and len(set(prefix.values())) == trie.n
    assert all(prefix[n] == tuple(sequences[m][:d]) for (m, d, _), n in zip(rows, node, strict=True))
    assert trie.degrees().tolist() == [sum(parent == i) for i in range(trie.n)]
    sums = np.ones(trie.n, np.int64)
    trie.rollup(sums)
    assert sums.tolist() == [sum(q[: len(prefix[i])] == prefix[i] for q in prefix.values()) for i in range(trie.n)]
    assert len(trie.bits) == (2 * trie.n - 1 + 7) // 8


def test_digests_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 7)
    ids = list(range(5000))
    random.Random(1).shuffle(ids)
    ends = spark.createDataFrame([(i % 3, 5, i) for i in ids], "p1 long, p2 long, conv_id long")
    got = {r.d1: r.sha for r in prefix_trie._digests(ends).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(5000) if i % 3 == k).encode()).hexdigest() for k in range(3)}


# 12 spelling variants

def brute_words(rows, every, letters, least):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c < "\x7f" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= letters and n >= least}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words, ratio=5):
    form, near = {}, {}
    for w, n in words.items():
        others = [o for o in words if one_apart(w, o)]
        near[w] = len(others)
        first = min(others, key=lambda o: (-words[o], o), default=None)
        form[w] = first if first is not None and words[first] >= ratio * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, near[w], words.get(form[w])) for w, n in words.items()}


@pytest.mark.parametrize(("every", "letters", "least"), [(3, 4, 1), (199, 6, 5)])
def test_spelling(spark, every, letters, least):
    rng = random.Random(12)
    stems = ["".join(rng.choices("abÉéß", k=rng.randint(3, 8))) for _ in range(40)] + ["Straße", "straßE", "naïve×n", "aaaaaaa", "aaaaaabb", "abbbbbb"]
    texts = [" ".join(rng.choices(stems, weights=[2.0 ** -(i % 12) for i in range(len(stems))], k=300)) for _ in range(25)]
    texts.append("abcdefgh abcdefgx " * 10 + "abcdefgh " * 60 + "abcdefh")
    long = "z" * 3000
    rows = [*enumerate(texts), (3, texts[3]), (None, texts[4]), (None, None), (90, ""), (91, f"{long} 1 {long}q 2 {long}"), (92, f"{long}," * 20), (93, f"{long}q-" * 3)]
    docs = spark.createDataFrame([(i, t, 1, 2, "x", "y") for i, t in rows], "doc_id long, text string, n int, key int, word string, run string")
    out = spelling.variants(spelling.vocabulary(spelling.damaged(spelling.runs(docs), every), letters, least)).collect()
    want = brute_variants(brute_words(rows, every, letters, least))
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == want and len(out) == len(want) > 10
    assert any(v[3] for v in want.values()) and any(v[0] for v in want.values())


def test_spelling_roots_of_chains(spark):
    counts = {"aaaaaa": 5 ** 6, "aaaaab": 5 ** 5, "aaaabb": 5 ** 4, "aaabbb": 5 ** 3, "aabbbb": 25, "abbbbb": 5, "abbbbbc": 1, "zzzzzz": 4}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r.word: (r.form, r.root) for r in spelling.variants(vocab).collect()}
    assert {r for w, (_, r) in got.items() if w[0] == "a"} == {"aaaaaa"} and got["zzzzzz"] == (None, "zzzzzz")
    assert got["abbbbbc"] == ("abbbbb", "aaaaaa") and got["aaaaaa"][0] is None
    assert spelling.variants(vocab.limit(0)).count() == 0


# 13 page texts

def text_of(source):
    page = html_extract.Page(source)
    return page.text([page.best()])


WORDS = "one two three four five six seven eight nine ten eleven twelve".split()


def sentence(rng, n=20):
    return " ".join(rng.choices(WORDS, k=n)) + f" {rng.randint(0, 10 ** 9)}."


@pytest.mark.parametrize(("source", "want"), [
    ("<article><h1>A &amp; B</h1><p><b>one<br><p>two\n  three<p>four</article>", "A & B\none\ntwo three\nfour"),
    ("<body><nav><ul><li><a href=x>menu</a></ul></nav><main><h1>T</h1><p>one two three</p><aside>no</aside><form>name <input></form></main><footer>f</footer>", "T\none two three"),
    ("<article><header><h1>T</h1></header><p>text &lt;b&gt; &#233; &am &copy</p><footer>by</footer></article>", "T\ntext <b> é &am ©"),
    ("<div id=page><div class='site-header'>site</div><div class=post><h1>T</h1><div class=body><p>one two three four five<p>six</div></div><div class=comments><p>nice</p></div></div>",
     "T\none two three four five\nsix"),
    ("<article class=post><p>first and long enough</p><script>var t='</p>';</script><style>p{}</style><!-- c --><noscript>x</noscript><div class=ad>buy</div><p>last</p></article>"
     "<section class=comments><article class=comment><p>" + "reader says a lot " * 30 + "</p></article></section>", "first and long enough\nlast"),
    ("<article><ul><li>a<li>b <i>c</i></ul><table><tr><td>d<td>e</table><pre> f\n g </pre>tail</article> out", "a\nb c\nd\ne\nf g\ntail"),
    ("<article><p>one <a href='x>y'>two</a> three</p><p title=\"a > b\">four < five</p><p>cut <a href=", "one two three\nfour < five\ncut"),
    ("", ""), ("plain", "plain"), ("<div></div>", ""), ("<article><p>one</p></div></article></p><p>two", "one"),
    ("<article><P CLASS=Lead>one</P> <p>two&nbsp;three</p></article>", "one\ntwo three"),
    ("<form id=f><div class=has-sidebar><article><p>one two</p></article></div><p>x</p></form>", "one two"),
    ("<article><p>a<div hidden>no</div><span class=advert>no</span>b</article>", "a\nb"),
])
def test_page(source, want):
    assert text_of(source) == want


def test_pages_of_the_tables(spark):
    """Articles of the test pages, read by a plain pattern."""
    import html

    from oracle import DATA

    rows = html_extract.op13_html_extract(spark, DATA).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert len(rows) == len(source) > 20
    for r in rows:
        inner = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<(?:b|/b|br)>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "x", 2) for i, u, h in rows], "page_id long, url string, html string, host int, path string, paths int")


def test_hosts_agree(spark):
    """Short pages take the container their host has voted for, and lose what stands the same on all pages."""
    rng = random.Random(13)
    rows, want = [], {}
    notice = "<div class=q3><p>We have changed our terms and everyone who reads this page has to accept them now.</p></div>"
    for i in range(40):
        short = i % 8 == 7
        body = [sentence(rng, 4 if short else 60) for _ in range(1 if short else 3)]
        junk = f"<div class='zone x{i}'><p>{sentence(rng, 25)}</p></div>"
        rows.append((i, f"https://User@News.example.org:80/{i}", f"<body>{junk}<div class='text n{i}'>{notice}{''.join(f'<p>{b}' for b in body)}</div></body>"))
        want[i] = "\n".join(body)
    same = sentence(rng, 40)
    for i in range(50, 60):  # copies of one page are no notice
        rows.append((i, "http://copies.example/a", f"<div class=t><div class=u><p>{same}</p></div></div>"))
        want[i] = same
    rows += [(70, None, "<article>one</article>"), (71, "no address", "<article>two</article>"), (72, "http://n.example", None), (None, "http://n.example", ""),
             (73, "http://News.example.org/other", "<article><p>another kind of page</p></article>"), (70, None, "<article>one</article>")]
    want |= {70: "one", 71: "two", 72: "", None: "", 73: "another kind of page"}
    out = html_extract.extract(pages_of(spark, rows))
    assert out.columns == ["page_id", "url", "text"]
    got = out.collect()
    assert len(got) == len(rows) and {r.page_id: r.text for r in got} == want
    assert html_extract.extract(pages_of(spark, rows).limit(0)).count() == 0


def test_long_pages_take_linear_time():
    deep = "<div class=a>" * 20_000 + "<p>x</p>"
    assert text_of(deep) == "x"
    assert text_of("<article>" + "<p>a <b>b " * 20_000 + "</article>").count("\n") == 19_999
    assert text_of("<p title='" * 3_000 + "<a href=\"" * 3_000) == ""
