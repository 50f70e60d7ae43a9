"""Main text, collocations and spelling variants against plain computations and pages made by hand."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_llm_operators import ODD, docs_of, odd_docs

from folioscope.llm import collocations, main_text, queries, spelling
from folioscope.llm.common import read

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11 --------------------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def model(spark):
    return main_text.learn(read(spark, DATA, "pages"))


def article_lines(html):
    """Lines of the article of a page of the test tables, whose markup is known."""
    inner = re.search("<article>(.*?)</article>", html, re.S)[1]
    import html as h

    found = (" ".join(h.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner))
    return "\n".join(x for x in found if x)


def test_main_text_of_all_pages(spark):
    got = {r["page_id"]: r for r in queries.op11_main_text(spark, DATA).collect()}
    for r in read(spark, DATA, "pages").collect():
        assert got[r["page_id"]]["text"] == article_lines(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_main_text_of_held_out_layouts(model):
    made = main_text.Made(4711, ["Ships left the harbour before dawn, as they had done for years. Nobody asked where they went, and nobody told! " * 5])
    whole, right, kept_chars, own_chars = 0, 0, 0, 0
    for _ in range(300):
        page, own = main_text.marked(made.page())
        kept = set(main_text.decode(page, model.log_odds(main_text.features([page]))))
        good = {k for k, yes in own.items() if yes}
        size = lambda ks, page=page: sum(len(page.texts[k]) for k in ks)
        whole, right, kept_chars, own_chars = whole + (kept == good), right + size(kept & good), kept_chars + size(kept), own_chars + size(good)
    assert whole > 0.88 * 300 and right > 0.97 * kept_chars and right > 0.99 * own_chars


LONG = "The river was high that day, and the boats stayed in. We walked along the bank for an hour, until the rain began to fall."
HAND = [
    (f'<body><div id="top"><div class="logo">Site</div><div class="menu"><a href=1>Home</a> <a href=2>News</a></div></div><div class="cookie-consent">We use cookies to improve this site. <button>OK</button></div><div class="post"><h2>A day out</h2><p>{LONG}</p><div class="advertisement">Buy boots now, the best boots in town.</div><p>Then we went home.</p><ul><li>Bring a coat, it is cold.</li><li>Bring food</li></ul></div><div id="comments"><div class="comment"><b>Tom</b><p>{LONG}</p></div></div><div id="footer"><p>Copyright 2020 Site. All rights reserved.</p></div></body>', f"A day out\n{LONG}\nThen we went home.\nBring a coat, it is cold.\nBring food"),
    (f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>", f"Title\n{LONG}\n{LONG}"),
    (f'<header><a href=/>Logo</a><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav></header><main><h1>Caf&eacute; &#38; bar</h1><p>{LONG}<script>var x = "<p>no</p>";</script><style>p{{}}</style><form><p>Sign up for news.</p><input name=e></form><p>End\n\n  of\tit.</main><aside><p>Related: {LONG}</p></aside><footer>Imprint</footer>', f"Café & bar\n{LONG}\nEnd of it."),
]


@pytest.mark.parametrize("k", range(len(HAND)))
def test_main_text_of_pages_made_by_hand(model, k):
    assert main_text.main_texts(model, [HAND[k][0]]) == [HAND[k][1]]


def test_main_text_is_decoded_without_contradiction():
    r = random.Random(5)
    for _ in range(200):
        page, n = main_text.Page(), r.randint(1, 9)
        for _ in range(n):
            page.add(r.randrange(len(page.parent)) if len(page.parent) == 1 or r.random() < 0.5 else len(page.parent) - 1, 1, 0)
        page.texts = {k: "x" for k in range(1, n + 1)}  # decode asks only for the parents
        odds = np.array([r.uniform(-2, 2) for _ in range(n + 1)])
        best, sets = -1e9, None
        for mask in range(1 << n):
            kept = {0} | {k + 1 for k in range(n) if mask >> k & 1}
            if all(page.parent[k] in kept for k in kept if k) and (total := sum(odds[k] for k in kept if k)) > best:
                best, sets = total, kept
        assert set(main_text.decode(page, odds)) == sets - {0}


def test_main_text_of_odd_pages(spark, model):
    deep = "<div>" * 20_000 + "x" + "</p></section></td>" * 20_000
    odd = [None, "", "   ", "no markup at all", "<", "<p", "<!-- open", "<script>", "<p>" * 3000, deep, "</p></div></body>", "<table><tr><td>a<td>b<tr><td>c", f"<article><p>{LONG}</p></article>", f"<article><p>{LONG}</p></article>", "<h1>a</h2><h3>b</h1>", "<a href='>'>x</a>&#99999999999;&bogus;"]
    df = spark.createDataFrame([(i if i != 13 else None, None if i % 2 else "u", x) for i, x in enumerate(odd)], PAGES).withColumns({c: F.lit("x") for c in ("text", "n_chars", "score")})
    rows = main_text.extract(df, model).collect()
    assert len(rows) == len(odd) and all(r["n_chars"] == len(r["text"]) for r in rows)
    got = {r["page_id"]: r["text"] for r in rows}
    assert got[0] == got[1] == got[2] == "" and got[12] == LONG == got[None]
    assert main_text.extract(df.where("false"), main_text.learn(df.where("false"))).count() == 0


def test_boosting_learns_a_rule():
    r = np.random.default_rng(3)
    rows = np.concatenate((r.normal(size=(3000, 3)), r.integers(0, 2, (3000, 2))), axis=1).astype(np.float32)
    labels = ((rows[:, 0] > 0.3) ^ (rows[:, 3] > 0)).astype(float)
    model = main_text.boost(rows[:2000], labels[:2000], 3, n_trees=30)
    assert ((model.log_odds(rows[2000:]) > 0) == labels[2000:]).mean() > 0.97
    assert len(model.log_odds(rows[:0])) == 0


# 12 --------------------------------------------------------------------------------------------------------------------


def grams_of(texts, longest=3):
    out = Counter()
    for t in texts:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (t or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    out[" ".join(words[i : i + n])] += 1
    return out


def test_collocations_count_any_shards():
    """Texts cut anywhere into windows and shards give the counts of the whole."""
    r = random.Random(1)
    words = ["a", "b", "the", "x\x00y", "Ü", "日本", " ", "\t", ".", "\n", "b."]
    for _ in range(300):
        texts = ["".join(r.choice(words) + r.choice([" ", "", "  "]) for _ in range(r.randrange(60))) for _ in range(5)] + [""]
        most, window, total = r.choice([1, 2, 3, 7, 1000]), r.choice([1, 5, 40]), Counter()
        shard, shards = collocations.Shard("en"), []
        for t in texts:
            *full, shard = collocations.added(shard, memoryview(t.encode()), most, window)
            shards += full
        for x in [*shards, shard]:
            phrases, sizes, found = x.counts(np.full(8192, 255, np.uint8))
            assert sizes == [p.count(" ") + 1 for p in phrases]
            for p, n in zip(phrases, found, strict=True):
                total[p.encode("latin-1").decode()] += n
        assert {k: v for k, v in total.items() if v} == dict(grams_of(texts))


@pytest.mark.parametrize("n_cells", [256, 1 << 16])
def test_collocations_of_any_sketch_and_shard(spark, n_cells):
    """A sketch so small that all cells are full lets more through, and changes nothing."""
    docs = read(spark, DATA, "documents").limit(60)
    want = {}
    for lang in {r["lang"] for r in docs.collect()}:
        want |= {(lang, k): v for k, v in grams_of([r["text"] for r in docs.collect() if r["lang"] == lang]).items() if v >= 4}
    rows = collocations.frequencies(docs, least=4, n_cells=n_cells, most=500).where("size > 0").collect()
    assert {(r["lang"], r["phrase"]): r["f"] for r in rows} == want and len(rows) == len(want)


def test_collocations_sketch_grows_with_the_text(spark, monkeypatch):
    """A cell for some bytes of text at any size; where cells share a bit, and where a shard's phrases make several automata, results stay the same."""
    assert all(size / 8 <= collocations.cells_of(size) <= size for size in (10**6, 10**9, 10**10, 10**12))
    docs = read(spark, DATA, "documents").limit(20)
    want = {tuple(r) for r in collocations.frequencies(docs, least=3).collect()}
    monkeypatch.setattr(collocations, "PATTERNS", 50)
    monkeypatch.setattr(collocations, "BITS", 1 << 17)
    assert {tuple(r) for r in collocations.frequencies(docs, least=3, n_cells=1 << 34).collect()} == want and want


def test_collocations_pass_with_all_that_is_in_them():
    """A phrase whose own cell is full isn't counted if a word of it can't be frequent."""
    *_, shard = collocations.added(collocations.Shard("en"), memoryview(b"red tea red tea cup"), 100)
    _, places, hashes = next(iter(collocations._grams("en", shard.parts[1][0].hashes)))
    full = np.full(8192, 255, np.uint8)
    assert "red tea cup" in shard.counts(full)[0]
    cell = int(hashes[4]) % (8192 * 8)
    full[cell // 8] &= 255 - (1 << cell % 8)
    assert set(shard.counts(full)[0]) == {"red", "tea", "red tea", "tea red", "red tea red", "tea red tea"}


def test_words_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(collocations, "_hashes", lambda data, starts, ends: np.full(len(starts), 5, np.uint64))
    *_, shard = collocations.added(collocations.Shard("en"), memoryview(b"ab cd ab, cd"), 100)
    phrases, _, found = shard.counts(np.full(8192, 255, np.uint8))
    assert dict(zip(phrases, found, strict=True)) == {"ab": 2, "cd": 2, "ab cd": 1, "cd ab": 1, "ab cd ab": 1}


def test_collocations_against_sql(spark, duck):
    got = queries.op12_collocations(spark, DATA)
    said = duck.execute(collocations.sql())
    names = [x[0] for x in said.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(said.fetchall())


def test_collocations_of_odd_rows(spark):
    odd = odd_docs(spark).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit(None)).otherwise(F.lit("en"))).withColumns({c: F.lit(1) for c in ("phrase", "size", "f", "rank")})
    got = {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in collocations.collocations(odd, least=2, most=100).collect()}
    texts = [(r["lang"] or "und", r["text"]) for r in odd.select("lang", "text").collect()]
    und = grams_of([t for lang, t in texts if lang == "und"])
    n = sum(v for k, v in und.items() if " " not in k)
    assert got["und", "word word word"][:4] == (und["word word word"], und["word word"], und["word"], n) if ("und", "word word word") in got else ("en", "word word word") in got
    assert not any(" " not in phrase for _, phrase in got)
    assert collocations.collocations(odd.where("false")).count() == 0


def test_collocation_scores_are_exact(spark):
    big = 10**13 - 7
    row = spark.createDataFrame([(big - 11, big - 3, big)], "a long, l long, r long").select(collocations._score(F.col("a"), F.col("l"), F.col("r"))).first()
    assert row[0] == 1_000_000 * (big - 11) ** 2 // ((big - 3) * big)


# 13 --------------------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_variants(rows, least_letters=6, least_times=5, lift=5, every=199):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= least_letters and k >= least_times}
    near = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and edits(w, x) == 1] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= lift * words[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), k, len(near[w]), words[form[w]] if form[w] else None) for w, k in words.items()}


def found_variants(df, **options):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(df, **options).collect()}


def test_spelling_against_all_pairs(spark):
    docs = read(spark, DATA, "documents")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in queries.op13_spelling_variants(spark, DATA).collect()}
    want = plain_variants([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert got == want and any(w[0] for w in want.values())


def test_spelling_of_few_letters(spark):
    """Words of two letters have repeated and tied bigrams in all places, and chains of forms."""
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abÉ") for _ in range(r.randint(5, 8))) for _ in range(r.randrange(900))) for _ in range(30)]
    texts += [" ".join(["aaaaaa"] * 700 + ["aaaaaaa"] * 100 + ["aaaaaaaa"] * 12)]
    got = found_variants(docs_of(spark, texts), least_times=2, lift=2, every=7)
    want = plain_variants(enumerate(texts), least_times=2, lift=2, every=7)
    assert got == want and any(want[w][0] and want[want[w][0]][0] for w in want)


def test_spelling_keys_meet_for_every_edit():
    r = random.Random(9)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(6, 10)))
        k, kind = r.randrange(len(a)), r.randrange(3)
        b = a[:k] + r.choice("abcd") + a[k + 1 :] if kind == 0 else a[:k] + r.choice("abcd") + a[k:] if kind == 1 else a[:k] + a[k + 1 :]
        if a == b or len(b) < 5:
            continue
        rank = {x + y: r.random() for x in "abcd" for y in "abcd"}
        of = [{(role, key) for role, key in spelling.keys(w, rank)} for w in (a, b)]
        meets = lambda x, y: any((role * 2, key) in y for role, key in x if role < 2)
        assert meets(of[0], of[1]) or meets(of[1], of[0])


def test_spelling_of_odd_rows(spark):
    odd = odd_docs(spark).withColumns({c: F.lit("x") for c in ("word", "run", "n", "form", "root")})
    more = odd.where("doc_id = 1").withColumn("text", F.lit("Straße, STRASSE straßen " * 5 + "×÷××÷÷÷ " * 5))
    rows = odd.union(more)
    assert found_variants(rows, least_times=1) == plain_variants([(r["doc_id"], r["text"]) for r in rows.select("doc_id", "text").collect()], least_times=1)
    assert spelling.variants(odd.where("false")).count() == 0
    assert len(ODD) > 10
