"""Each operator against brute force, the library it follows, or held-out labels, and on nulls, empty and odd input."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from folioscope.llm import decontaminate, graph, language, licenses, line_dedup, pieces, queries, simhash, token_counts, toxicity, warc, weighted_sampling
from folioscope.llm.common import read, tokenizer_path

ODD = [None, "", " ", "\n", "a", "A  b\tc", "é" * 7, "日本語 ゼ", "😀 <|endoftext|> x<s>", "don't ﬁ ½", "x" * 5000, "word " * 3000, "\x00 a", "İ ΣΑΣ", "▁▁a ▁"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, clash=False):
    rows = [(i, x, "en", "s", len(x or "")) for i, x in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    if clash:  # names that operators use inside or in their results
        for c in ("fingerprint", "component_id", "score", "h", "lines", "n_tokens", "n_lines", "item_id", "ids", "spot", "top", "lang_pred", "predicted", "rules"):
            df = df.withColumn(c, F.lit("x"))
    return df


def odd_docs(spark):
    df = docs_of(spark, [*ODD, ODD[5], ODD[5]], clash=True)
    null_id = df.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))
    return df.union(null_id).union(df.where("doc_id = 6"))


def texts(spark):
    return {r["doc_id"]: r["text"] for r in read(spark, DATA, "documents").select("doc_id", "text").collect()}


ALL = [
    lambda s, d: decontaminate.contamination(d, read(s, DATA, "benchmark")),
    lambda s, d: decontaminate.clean(d, read(s, DATA, "benchmark")),
    lambda s, d: licenses.scan(d),
    lambda s, d: language.predict(d, language.learn(d)),
    lambda s, d: simhash.near_duplicates(d),
    lambda s, d: weighted_sampling.with_edits(d),
    lambda s, d: weighted_sampling.fingerprints(d),
    lambda s, d: pieces.encode_decode(d),
    lambda s, d: pieces.encode_decode(d, keep_text=True),
    lambda s, d: toxicity.predict(d, toxicity.learn(d, s.createDataFrame([(0, 1), (None, 1), (1, None)], "doc_id long, toxic int"))),
    lambda s, d: token_counts.token_counts(d),
    lambda s, d: line_dedup.deduplicated(d),
]


@pytest.mark.parametrize("k", range(len(ALL)))
def test_odd_rows_and_empty_tables(spark, k):
    odd = odd_docs(spark)
    out = ALL[k](spark, odd)
    rows = out.collect()
    assert k == 0 or len(rows) == odd.count()
    assert ALL[k](spark, odd.where("false")).count() == 0


# 1 ---------------------------------------------------------------------------------------------------------------------


def semi_global(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def plain(chars):
    return chars.tobytes().decode("utf-32-le")


def test_decontamination_against_all_alignments(spark):
    r = random.Random(3)
    items = [(x["item_id"], decontaminate.normalised(x["text"])) for x in read(spark, DATA, "benchmark").orderBy("item_id").limit(12).collect()]
    fill = [plain(decontaminate.normalised(x))[:150] for x in list(texts(spark).values())[:40]]
    index = decontaminate.Index(items, decontaminate.Q, decontaminate.EDIT_RATE)
    hits = 0
    for _ in range(60):
        own = list(plain(items[r.randrange(12)][1]))
        for _ in range(r.randrange(int(len(own) * 0.14) + 1)):
            p, kind = r.randrange(len(own)), r.random()
            if kind < 0.4:
                own[p] = r.choice("abc ")
            elif kind < 0.7:
                del own[p]
            else:
                own.insert(p, r.choice("abc"))
        text = decontaminate.normalised(f"{r.choice(fill)} {''.join(own)} {r.choice(fill)}")
        got = {m[0]: m for m in decontaminate.matches(index, text)}
        for k, (_, pattern) in enumerate(items):
            best = semi_global(plain(pattern), plain(text))
            if best <= int(len(pattern) * decontaminate.EDIT_RATE):
                hits += 1
                _, edits, start, end = got[k]
                assert edits == best == semi_global(plain(pattern), plain(text[start:end]))
            else:
                assert k not in got
    assert hits > 20


def test_decontamination_of_every_length():
    """Items of 1 to 120 characters with every allowed number of edits, spread evenly, at random or as insertions and deletions: all are found, as brute force finds them."""
    r = random.Random(11)
    letters = "abcdefghijklmnopqrst"
    items = [(m, np.array([ord(r.choice(letters)) for _ in range(m)], np.uint32)) for m in range(1, 121)]
    index = decontaminate.Index(items, decontaminate.Q, decontaminate.EDIT_RATE)
    for m, item in items:
        most = int(m * decontaminate.EDIT_RATE)
        for e in range(most + 1):
            for how in range(3):
                own = [chr(c) for c in item]
                spots = [(k + 1) * m // (e + 1) - (k + 1 == e + 1) for k in range(e)] if how == 0 else sorted(r.sample(range(m), e))
                for p in reversed(spots):
                    if how < 2:
                        own[min(p, m - 1)] = "z"
                    elif r.random() < 0.5:
                        del own[p]
                    else:
                        own.insert(p, "z")
                text = "".join(r.choice(letters.upper().lower()[::-1]) for _ in range(30)) + "".join(own) + "".join(r.choice(letters) for _ in range(30))
                got = {index.ids[k]: (edits, a, b) for k, edits, a, b in decontaminate.matches(index, np.array(list(map(ord, text)), np.uint32))}
                best = semi_global(plain(item), text)
                assert best <= e and got[m][0] == best, (m, e, how)
                assert semi_global(plain(item), text[got[m][1] : got[m][2]]) == best


def test_decontamination_of_repeated_letters():
    """Items of one letter or few, in long texts of the same: found, in bounded memory and time."""
    import time
    import tracemalloc

    one, two = np.full(2000, 97, np.uint32), np.array([97, 98] * 300, np.uint32)
    mixed = np.array(list(map(ord, "the quick brown fox jumps over it " + "a" * 60)), np.uint32)
    index = decontaminate.Index([(1, one), (2, two), (3, mixed)], 8, 0.1)
    text = np.full(300_000, 97, np.uint32)
    began = time.time()
    tracemalloc.start()
    assert [m[:2] for m in decontaminate.matches(index, text)] == [(0, 0)]
    text[::15] = 99
    got = decontaminate.matches(index, text[:8400])
    assert [(m[0], m[1]) for m in got] == [(0, 133)]
    broken = two.copy()
    broken[::20] = 120
    assert [(m[0], m[1]) for m in decontaminate.matches(index, np.concatenate([text[:500], broken, text[:500]]))] == [(1, 30)]
    near = mixed.copy()
    near[[5, 20, 50, 70]] = 122
    assert [(m[0], m[1]) for m in decontaminate.matches(index, np.concatenate([text[:500], near, text[:500]]))] == [(2, 4)]
    assert tracemalloc.get_traced_memory()[1] < 200 << 20 and time.time() - began < 60
    tracemalloc.stop()


def test_decontamination_finds_all_passages(spark):
    docs, bench = read(spark, DATA, "documents"), read(spark, DATA, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(docs, bench).collect()}
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    exact = {(i, k) for i, x in texts(spark).items() for k, t in items.items() if t in x}
    assert exact and exact <= got
    blocks = decontaminate.contamination(docs, bench, block_chars=1000)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == got
    left = {r["doc_id"] for r in decontaminate.clean(docs, bench).collect()}
    assert left == set(texts(spark)) - {i for i, _ in got}
    nameless = bench.withColumn("item_id", F.lit(None).cast("long"))
    assert {r["doc_id"] for r in decontaminate.clean(docs, nameless, block_chars=1000).collect()} == left
    assert decontaminate.clean(docs, bench.where("false")).count() == docs.count()


def test_decontamination_over_windows(spark, monkeypatch):
    item = decontaminate.normalised("the quick brown fox jumps over the lazy dog and runs away into the dark wood")
    text = decontaminate.normalised("filler words here " * 60 + plain(item) + " more filler" * 60)
    index = decontaminate.Index([(1, item)], 8, 0.1)
    monkeypatch.setattr(decontaminate, "WINDOW", 100)
    assert [m[1] for m in decontaminate.matches(index, text)] == [0]


# 2 ---------------------------------------------------------------------------------------------------------------------


def test_license_rules(spark, duck):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nunknown words.\nyou may not use this file except in compliance with the License. You may obtain a copy of the License at\n http://www.apache.org/licenses/LICENSE-2.0 \n\n"
    apache += "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and limitations under the License."
    rows = [apache, "a. Licensed under CC BY-NC 4.0.\nb", "Released under the MIT License. Released under the MIT License.", "This is licensed", None, ""]
    got = licenses.scan(docs_of(spark, rows)).orderBy("doc_id").collect()
    assert [r["licenses"] for r in got] == ["Apache-2.0", "CC-BY-NC-4.0", "MIT", "", "", ""] and [r["n_sentences"] for r in got][1:] == [1, 2, 0, 0, 0]
    real = queries.op2_license_scan(spark, DATA)
    assert "Python" not in real._jdf.queryExecution().executedPlan().toString()
    said = duck.execute(queries.oracle_sql()["op2_license_scan"])
    names = [x[0] for x in said.description]
    assert sorted(tuple(r[n] for n in names) for r in real.collect()) == sorted(said.fetchall())


def wrapped(text, mark, width):
    """A text as source files carry it: hard-wrapped, behind comment marks."""
    import textwrap

    lines = [x for part in text.split("\n\n") for x in [*textwrap.wrap(" ".join(part.split()), width, break_long_words=False, break_on_hyphens=False), ""]]
    return "\n".join(f"{mark} {x}".rstrip() for x in lines)


def test_licenses_of_real_notices(spark, duck):
    """Standard texts, wrapped and commented in many ways, among other lines: each is recognised, here and in DuckDB."""
    dressed, want = [], []
    for name, licence, text in licenses.NOTICES:
        if name == "bsd-disclaimer":
            continue
        for mark, width in (("", 72), ("#", 60), ("//", 76), (" *", 40), (";;", 79), ("--", 30), ("", 10_000)):
            body = wrapped(text, mark, width)
            dressed.append(f"/*\n{body}\n*/\nint main() {{}}" if mark == " *" else f"{body}\n\nimport os\nx = 1")
            want.append({licence})
    bsd3, bsd2 = (next(t for n, _, t in licenses.NOTICES if n == x) for x in ("bsd-3-clause", "bsd-2-clause"))
    dressed += [wrapped(bsd3, "#", 70) + "\n\nSecond part.\n\n" + wrapped(bsd2, "#", 70), "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;", "# SPDX-License-Identifier:MIT\nx", "\r\n".join(wrapped(bsd2, "", 70).split("\n"))]
    want += [{"BSD-3-Clause", "BSD-2-Clause"}, {"GPL-2.0-or-later"}, {"MIT"}, {"BSD-2-Clause"}]
    dressed += ["The software permits a following.", "MIT is a university. Zlib. The license was not given. Permission is hereby granted to nobody.", "under the bridge"]
    want += [set()] * 3
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, dressed)).collect()}
    for k, x in enumerate(want):
        assert set(filter(None, got[k]["licenses"].split(","))) == x, (k, dressed[k][:300], got[k])
    import pandas as pd

    duck.register("dressed", pd.DataFrame({"doc_id": range(len(dressed)), "text": dressed}))
    said = duck.execute(licenses.sql("dressed"))
    names = [x[0] for x in said.description]
    assert sorted(said.fetchall()) == sorted(tuple(r[n] for n in names) for r in got.values())


def test_every_license_sentence(spark):
    """No known sentence is lost to the test that spares other texts the cuts; all rules match their own sentences."""
    known, rules = licenses.standard()
    assert len(known) > 300
    spoken = [x.replace("under ", "licensed\n# under the\n# ", 1) if x.startswith("under ") else x for x in known]
    got = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, ["x y.\n\n# " + x for x in spoken])).collect()}
    assert [k for k, x in enumerate(known.values()) if got[k]["sequence"] != x] == []
    text_of = dict(zip(known.values(), spoken, strict=True))
    own = {r["doc_id"]: r for r in licenses.scan(docs_of(spark, [". ".join(text_of[i] for i in ids) for _, _, ids in rules])).collect()}
    assert [(name, own[k]["rules"]) for k, (name, licence, _) in enumerate(rules) if (own[k]["rules"], own[k]["licenses"]) != (name, licence)] == []


# 3 ---------------------------------------------------------------------------------------------------------------------


def test_language_on_held_out_documents(spark):
    rows = queries.op3_language_id(spark, DATA).join(read(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    odd = language.predict(docs_of(spark, [None, "", "123 $%"]), {"en": np.ones(language.DIMENSIONS)}).collect()
    assert [(r["lang_pred"], r["score"]) for r in odd] == [("und", 0.0)] * 3


def test_language_prototypes_and_cosines(spark):
    """Learning and prediction against plain sums over letters."""
    rows = [(1, "der Hund läuft in den Wald hinein", "de"), (2, "die Katze schläft", "de"), (3, "the dog runs into the wood", "en"), (4, "a cat sleeps here", "en"), (5, None, "en"), (6, "no label", None), (7, "123", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    space = language.Space(language.DIMENSIONS)

    def bundle(text):
        letters = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        return sum(np.roll(space.letter(ord(a)), 2) * np.roll(space.letter(ord(b)), 1) * space.letter(ord(c)) for a, b, c in zip(letters, letters[1:], letters[2:], strict=False)).astype(float)

    unit = lambda v: v / np.linalg.norm(v)
    want = {lang: unit(sum(unit(bundle(t)) for _, t, l in rows if l == lang and t and t != "123")) for lang in ("de", "en")}
    got = language.learn(docs)
    assert set(got) == {"de", "en"} and all(np.allclose(got[x], want[x], atol=1e-4) for x in want)
    said = {r["doc_id"]: r for r in language.predict(docs, got).collect()}
    for i, text, _ in rows:
        if text and text != "123":
            cosines = {x: float(unit(bundle(text)) @ want[x]) for x in want}
            assert said[i]["lang_pred"] == max(cosines, key=cosines.get) and abs(said[i]["score"] - max(0, *cosines.values())) < 1e-4
    assert said[5]["lang_pred"] == said[7]["lang_pred"] == "und" and said[5]["score"] == 0


def test_language_bundles_by_plain_sums(monkeypatch):
    space = language.Space(64)
    text = "Éa ab, ab!  x" * 30
    letters = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    total = np.zeros(64)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        total += np.roll(space.letter(ord(a)), 2) * np.roll(space.letter(ord(b)), 1) * space.letter(ord(c))
    assert (space.bundle(*language.grams(text)) == total).all()
    monkeypatch.setattr(language, "WINDOW", 7)
    assert (space.bundle(*language.grams(text)) == total).all()


# 4 ---------------------------------------------------------------------------------------------------------------------


def test_warc_derivatives_and_files(spark, tmp_path):
    html = '<!DOCTYPE html><html lang="en"><head><title>T &amp; x</title><meta name="d" content="c"><script>var a="</p><a href=no>";</script></head><body><!-- no --><p>One<br>two  words</p><a href="/x?a=1&amp;b=2">link</a><img src=i.png></body></html>'
    pages = spark.createDataFrame([(1, "http://a/b", html), (2, None, None), (3, "http://c", "")], "page_id long, url string, html string")
    responses = warc.responses_of(pages)
    rows = warc.derivatives(responses, key="page_id").orderBy("page_id", "type").collect()
    assert [(r["page_id"], r["type"]) for r in rows] == [(i, t) for i in (1, 2, 3) for t in ("conversion", "metadata")]
    source = {r["page_id"]: r for r in responses.collect()}
    assert all(r["refers_to"] == source[r["page_id"]]["record_id"] and r["target_uri"] == source[r["page_id"]]["target_uri"] for r in rows)
    assert rows[0]["block"] == "T & x\nOne\ntwo words\nlink" and rows[0]["n_links"] == 2 and rows[2]["block"] == ""
    assert '["a","href","/x?a=1&b=2"]' in rows[1]["block"] and '"Title":"T & x"' in rows[1]["block"]
    assert rows[0]["headers"]["WARC-Concurrent-To"] == rows[1]["record_id"] and rows[0]["headers"]["WARC-Identified-Content-Language"] == "en"
    assert all(r["block_digest"] == warc.digest(r["block"].encode()) and r["content_length"] == len(r["block"].encode()) for r in rows)
    assert rows[0]["payload_digest"] == "sha256:" + hashlib.sha256(html.encode()).hexdigest() and '"WARC-X-Page-ID":"1"' in rows[1]["block"]
    undigested = warc.derivatives(responses.withColumn("payload_digest", F.lit(None).cast("string")), key="page_id").orderBy("page_id", "type").collect()
    assert undigested[0]["payload_digest"] == warc.digest(html.encode())
    warc.write(responses.drop("page_id"), str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w"))
    key = lambda df: sorted((r["record_id"], r["type"], r["target_uri"] or "", r["block"], r["content_length"], r["payload_digest"]) for r in df.collect())
    assert key(back) == key(responses)
    again = warc.derivatives(back)
    assert sorted(r["record_id"] for r in again.collect()) == sorted(r["record_id"] for r in rows)


def record_of(block: bytes, **head):
    lines = [f"{k.replace('_', '-')}: {v}" for k, v in {"WARC_Type": "response", "Content_Length": len(block), **head}.items()]
    return "\r\n".join(["WARC/1.0", *lines, "", ""]).encode() + block + b"\r\n\r\n"


def test_warc_files(spark, tmp_path):
    import gzip

    inner = record_of(b"HTTP/1.1 200 OK\r\n\r\n<p>inner</p>") * 2
    blocks = [b"", b"", "é <b>x</b>".encode(), b"\xff\xfe raw", inner, b"\r\n\r\n", b"last"]
    records = [record_of(x, WARC_Record_ID=f"<urn:x:{k}>") for k, x in enumerate(blocks)]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "a" / "by_record.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "a" / "whole.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "a" / "broken.warc").write_bytes(b"".join(records[:3]) + records[3][:-9])
    (tmp_path / "a" / "noise.warc").write_bytes(b"no record\r\n\r\nWARC/1.0\r\nContent-Length: \xc2\xb2\r\n\r\nx\r\n\r\n" + records[6])
    (tmp_path / "a" / "empty.warc").write_bytes(b"")
    got = sorted((r["record_id"], r["block"]) for r in warc.read(spark, str(tmp_path / "a")).collect())
    whole = [(f"<urn:x:{k}>", x.decode("utf-8", "replace")) for k, x in enumerate(blocks)]
    assert got == sorted(whole * 3 + whole[:3] + whole[6:])


def test_warc_odd_rows(spark):
    rows = [(1, "u", "<p>a", "x"), (None, None, None, None), (1, "u", "<p>a", "x"), (2, "", "", "x"), (3, "v", "\x00<" * 50, None), (4, "w", "&#" + "9" * 5000 + ";&#65;&#x110000;", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    for c in ("record_id", "type", "headers", "n_links", "key", "date"):
        pages = pages.withColumn(c, F.lit("clash"))
    got = warc.derivatives(warc.responses_of(pages), key="page_id").collect()
    assert len(got) == 12 and {r["block"] for r in got if r["page_id"] == 4 and r["type"] == "conversion"} == {"\ufffdA\ufffd"}
    assert len({r["record_id"] for r in got}) == 10
    assert warc.derivatives(warc.responses_of(pages.where("false")), key="page_id").count() == 0
    odd = [("HTTP/1.1 \u00b2 OK\r\n\r\nbody", None), ("HTTP/1.1 200", None), (None, None), ("HTTP/", {"a": "b"}), ("HTTP/1.1 404 no\r\nA: 1\r\na: 2\r\nnocolon\r\n\r\n", None)]
    assert [warc.split_http(x or "") for x, _ in odd] == [(None, {}, "body"), (200, {}, ""), (None, {}, ""), (None, {}, ""), (404, {"a": "1, 2"}, "")]
    source = spark.createDataFrame([(None, t, None, None, b, h) for (b, h), t in zip(odd, ["response", None, "response", "request", "response"], strict=True)], "record_id string, type string, target_uri string, date string, block string, headers map<string,string>")
    for c, kind in (("refers_to", "string"), ("content_type", "string"), ("block_digest", "string"), ("payload_digest", "string"), ("content_length", "long")):
        source = source.withColumn(c, F.lit(None).cast(kind))
    assert warc.derivatives(source).count() == 6


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a "', "<a '\">", "<!", "<!--", "<?", "<", "</script", "<script>", "<a b=", "&", "<p \n", "<title>", "<a x='>' \"", "</"])
def test_warc_parser_takes_time_in_proportion(piece):
    import time

    text = piece * (1_000_000 // len(piece))
    began = time.time()
    warc.parse_html(text)
    assert time.time() - began < 6


def test_warc_parser_against_another(spark):
    from html.parser import HTMLParser

    class Other(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.out, self.links, self.hidden, self.metas, self.title, self.own = [], [], [], [], None, False

        def handle_starttag(self, tag, attrs):
            attrs = dict(reversed(attrs))
            if tag in warc.LINES or tag == "title":
                self.out.append("\n")
            if self.hidden:
                return
            if tag in warc.LINKS and attrs.get(warc.LINKS[tag]) is not None:
                self.links.append((tag, warc.LINKS[tag], attrs[warc.LINKS[tag]].strip()))
            if tag == "meta" and "content" in attrs and ("name" in attrs or "property" in attrs):
                self.metas.append((attrs.get("name", attrs.get("property")), attrs["content"]))
            if tag in warc.SILENT:
                self.hidden.append(tag)

        def handle_endtag(self, tag):
            if tag in warc.LINES or tag == "title":
                self.out.append("\n")
            if self.hidden and tag == self.hidden[-1]:
                self.hidden.pop()

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data.replace("\n", " "))

    pages = [r["html"] for r in read(spark, DATA, "pages").collect()]
    assert len(pages) > 20
    for x in pages:
        other, own = Other(), warc.parse_html(x)
        other.feed(x)
        other.close()
        assert own["links"] == other.links and own["metas"] == other.metas
        assert own["text"].split() == "".join(other.out).replace("\xa0", " ").split()


# 5 ---------------------------------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", words) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(nodes, linked):
    parent = {n: n for n in nodes}

    def top(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    return {n: top(n) for n in nodes}


def test_simhash_against_all_pairs(spark):
    own = texts(spark)
    got = {r["doc_id"]: r for r in queries.op5_simhash(spark, DATA).collect()}
    fps = {i: slow_fingerprint(x) for i, x in own.items()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    ids = sorted(fps)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert {i: r["component_id"] for i, r in got.items()} == slow_components(ids, linked)


@pytest.mark.parametrize("crowd, few", [(64, 1 << 20), (1, 1 << 20), (1, 0)])
def test_pigeonring_loses_no_pair(spark, monkeypatch, crowd, few):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "FEW", few)
    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    values = set(base)
    for b in base:
        for _ in range(25):
            x = b
            for _ in range(r.randrange(1, 6)):
                x ^= 1 << r.randrange(64)
            values.add(x)
    signed = {v - (1 << 64) if v >> 63 else v for v in values}
    got = [(x["a"], x["b"]) for x in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    ids = sorted(signed)
    want = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 500


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 180)] + [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(7, i) for i in range(300, 340)] + [(5, 5), (100, 101)]
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == slow_components(nodes, edges)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 6 ---------------------------------------------------------------------------------------------------------------------


def test_weighted_sampling_estimates_generalised_jaccard():
    g, errors = np.random.default_rng(0), []
    for _ in range(150):
        names, wa, wb = g.integers(0, 2**63, 50).astype(np.uint64), g.integers(1, 6, 40), g.integers(1, 6, 40)
        both = np.minimum(wa[10:], wb[:30]).sum()
        got = weighted_sampling.likeness(weighted_sampling.signature(np.repeat(names[:40], wa)), weighted_sampling.signature(np.repeat(names[10:], wb)))
        errors.append(got - both / (wa.sum() + wb.sum() - both))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09


def test_weighted_sampling_edits(spark):
    own = texts(spark)
    got = {r["doc_id"]: r for r in queries.op6_weighted_sampling(spark, DATA).collect()}
    ids = sorted(own, reverse=True)
    of = {x: weighted_sampling.fingerprint(x) for x in own.values()}
    for k, i in enumerate(ids):
        text, other = own[i], own[ids[(k + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        changed = weighted_sampling.fingerprint(edited)
        assert (r["fingerprint"], r["edited_fingerprint"]) == (weighted_sampling.hexed(of[text]), weighted_sampling.hexed(changed))
        assert r["near_edited"] == weighted_sampling.likeness(of[text], changed) and r["near_next"] == weighted_sampling.likeness(of[text], of[other])
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values() if r["n_chars"] > 100]) > 0.99


def test_weighted_sampling_of_few_rows(spark):
    one = weighted_sampling.with_edits(docs_of(spark, ["a b c"])).collect()
    assert one[0]["near_next"] == 1.0
    same = weighted_sampling.with_edits(docs_of(spark, ["a", "b", None, ""]).withColumn("doc_id", F.lit(3).cast("long"))).collect()
    assert len(same) == 4
    nulls = weighted_sampling.with_edits(docs_of(spark, ["b", "a", "a"]).withColumn("doc_id", F.lit(None).cast("long"))).collect()
    assert sorted(r["near_next"] for r in nulls) == [0.0, 0.0, 1.0]


@pytest.mark.parametrize("tasks", [4, 13])
def test_weighted_sampling_of_repeated_and_null_ids(spark, tasks):
    """A third of the rows has one id, a third none: every row's next is another one's, in one ring through all, ids descending, nulls last."""
    r = random.Random(3)
    ids = [None] * 80 + [500] * 80 + list(range(450, 530)) + [7, 7, 7]
    rows = [(i, f"{k:04d} " + " ".join(r.choice("abcdefgh") * 3 for _ in range(12))) for k, i in enumerate(ids)]
    r.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        dealt = weighted_sampling._dealt(spark.createDataFrame(rows, "doc_id long, text string"))
        sizes = [x["count"] for x in dealt.groupBy("spot").count().collect()]
        got = weighted_sampling.with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows) and max(sizes) < len(rows) / 2
    own = {}
    for k, (_, text) in enumerate(rows):
        for j, (_, other) in enumerate(rows):
            half = len(text) // 2
            own[hashlib.sha256((text[: len(text) - half] + other[:half]).encode()).hexdigest()] = (k, j)
    after = dict(own[x["edited_sha256"]] for x in got)
    assert len(after) == len(set(after.values())) == len(rows)
    at = next(k for k, (i, _) in enumerate(rows) if i == 529)
    ring = []
    for _ in rows:
        ring.append(rows[at][0])
        at = after[at]
    assert ring == sorted(ids, key=lambda i: -1000 if i is None else i, reverse=True) and rows[at][0] == 529


def test_places_among_bounds(spark):
    bounds = sorted(random.Random(1).sample(range(1000), 37))
    for some in (bounds, bounds[:1], bounds[:2], []):
        got = spark.range(-3, 1003).select("id", weighted_sampling._place(F.col("id"), some).alias("p")).collect()
        assert all(r["p"] == sum(b < r["id"] for b in some) for r in got)


# 7, 9 ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def samples(spark):
    r = random.Random(1)
    made = ["".join(r.choice(" ▁abtheinér\nゼ😀\t<s>.,'") for _ in range(r.randrange(60))) for _ in range(1500)]
    return [x or "" for x in ODD] + made + list(texts(spark).values())[:40]


def test_pieces_against_the_library(samples):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    own, theirs = pieces.model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    want = theirs.encode(samples)
    assert [own.encode(x) for x in samples] == want
    assert own.merge_all([own.escape(x) for x in samples]) == want
    assert [own.decode(ids) for ids in want] == theirs.decode(want)
    r = random.Random(2)
    loose = [[r.randrange(3, 700) for _ in range(r.randrange(12))] for _ in range(300)]
    assert [own.decode(ids) for ids in loose] == theirs.decode(loose)


def test_pieces_query(spark, samples):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = pieces.encode_decode(docs_of(spark, samples), keep_text=True, window_chars=3000).orderBy("doc_id").collect()
    for r, x in zip(got, samples, strict=True):
        ids = theirs.encode(x)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == theirs.decode(ids) and r["matches_library"]
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_against_the_library(spark, samples, name, monkeypatch):
    path = tokenizer_path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        want = [len(e) for e in own.encode_batch(samples, add_special_tokens=False)]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(samples)]
    got = token_counts.token_counts(docs_of(spark, samples), path, limit=100, window_bytes=2000).orderBy("doc_id").collect()
    assert [r["n_tokens"] for r in got] == want and [r["over_limit"] for r in got] == [n > 100 for n in want]
    assert [r["n_bytes"] for r in got] == [len(x.encode()) for x in samples]
    monkeypatch.setattr(token_counts, "CACHE_PIECES", 5)
    counts = token_counts.Counts(path)
    assert [n for k in range(0, len(samples), 50) for n in counts.of(samples[k : k + 50])] == want


@pytest.mark.parametrize("sign", ["", *token_counts.SIGNS, ".,", "'s."])
def test_token_counts_of_every_code_point(sign):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    made = [f"{a}{chr(c)}{sign}" for c in range(0x20000) if not 0xD800 <= c < 0xE000 for a in ("", "a")]
    made += [x + sign for x in "BELEDİYESİ MİLLİ, BİRLİK DENİZLİ İSTANBUL'A é̈ ΣΑΣ ŉ ẖ ß ﬁn x² a\u0301 Ⅷ <|endoftext|> <|endoftext|".split()]
    want = [len(e) for e in Tokenizer.from_file(path).encode_batch(made, add_special_tokens=False)]
    counts = token_counts.Counts(path)
    assert [n for k in range(0, len(made), 20000) for n in counts.of(made[k : k + 20000])] == want


def test_balanced_batches():
    runs = list(token_counts.balanced(["a" * 5, "é" * 4, "b", "c" * 50, "d"], 12))
    assert runs == [["aaaaa"], ["éééé", "b"], ["c" * 50], ["d"]]


# 8 ---------------------------------------------------------------------------------------------------------------------


def test_toxicity_on_held_out_labels(spark):
    data = "/root/testdata/sf0.1"
    rows = queries.op8_toxicity(spark, data).join(read(spark, data, "labels"), "doc_id").where("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    toxic, clean = [r["predicted"] for r in rows if r["toxic"]], [r["predicted"] for r in rows if not r["toxic"]]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.03


def test_nnpu_gradient_against_differences():
    """The step's direction is the derivative of the risk as the papers write it, or of its negative part turned round."""
    g = np.random.default_rng(3)
    rows = [[np.unique(g.integers(0, 6, 3)) for _ in range(n)] for n in (9, 14)]
    w0, b0 = g.normal(size=6), -0.2
    flat = lambda some: (np.concatenate(some), np.repeat(np.arange(len(some)), [len(x) for x in some]), len(some))
    loss = lambda z: 1 / (1 + np.exp(z))
    for prior, positive in ((0.2, True), (3.0, False)):  # so large a prior makes the second part negative

        def parts(w, b, prior=prior):
            zp, zu = (np.array([b + w[x].sum() for x in some]) for some in rows)
            return prior * loss(zp).mean(), loss(-zu).mean() - prior * loss(-zp).mean()

        w, b = w0, b0
        rest, got = toxicity.direction(w, b, flat(rows[0]), flat(rows[1]), prior)
        assert np.isclose(rest, parts(w, b)[1]) and (rest >= 0) == positive
        of = (lambda w, b: sum(parts(w, b))) if positive else (lambda w, b: -parts(w, b)[1])
        e = 1e-6
        want = [(of(w + e * np.eye(6)[k], b) - of(w - e * np.eye(6)[k], b)) / (2 * e) for k in range(6)] + [(of(w, b + e) - of(w, b - e)) / (2 * e)]
        assert np.allclose(got, want, atol=1e-8)


def test_toxicity_samples_of_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "bad word")] * 50 + [(2, "good")] * 50 + [(None, "bad"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.predict(docs, toxicity.learn(docs, labels)).collect()}
    assert all(0 <= x <= 1 for x in scores.values()) and set(scores) == {1, 2, 3, None}


def test_nnpu_without_negatives():
    g = np.random.default_rng(1)
    pos = [np.unique(np.append(g.integers(0, 50, 8), 100 + g.integers(0, 4, 2))) for _ in range(300)]
    unl = [np.unique(g.integers(0, 50, 8)) for _ in range(900)] + pos[:100]
    model = toxicity.train_nnpu(pos, unl, 0.1)
    assert set(model.ids) == {100, 101, 102, 103} and (model.weights > 0).all() and model.bias < 0
    assert len(toxicity.train_nnpu([], unl, 0.1).ids) == 0


# 10 --------------------------------------------------------------------------------------------------------------------


def weight(line):
    import re

    return len(line.split()) + len(re.findall("[\u4e00-\u9fff\u3040-\u30ff\u0e00-\u0e7f]", line)) // 2


def slow_line_dedup(docs):
    """Documents by id to what is left: every pair of distinct texts, every maximal common run of lines of at least BLOCK_WORDS words."""
    first = {}
    for i in sorted(docs):
        first.setdefault(docs[i], i)
    lines = {i: [x.rstrip(" \t\r") for x in t.split("\n")] for t, i in first.items()}
    gone = {i: set() for i in lines}
    for b, late in lines.items():
        for a, early in lines.items():
            for j in range(len(late)) if a < b else ():
                for i in range(len(early)):
                    if late[j] == early[i] and not (i and j and late[j - 1] == early[i - 1]):
                        n = 0
                        while i + n < len(early) and j + n < len(late) and early[i + n] == late[j + n]:
                            n += 1
                        if sum(map(weight, late[j : j + n])) >= line_dedup.BLOCK_WORDS:
                            gone[b].update(range(j, j + n))
    out = {}
    for i, t in docs.items():
        out[i] = "" if t and first[t] != i else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[first[t]])
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_line_dedup_against_all_pairs(spark, duck, seed):
    r = random.Random(seed)
    pool = [" ".join(r.choice("abcde") for _ in range(r.randrange(1, 9))) for _ in range(40)] + ["", "", "short", "x y ", "本日は晴天なり本日も", "本日", "a b c d e\r", "a b c d e"]
    docs = ["\n".join(r.choice([*pool, f"own {r.random()}"]) for _ in range(r.randrange(1, 12))) for _ in range(90)]
    docs += [docs[3], docs[3], docs[10] + "\n" + docs[11], "", "", "\n" * 40, "p a s s e\nx\np a s s e", *(f"{k} y\np a s s e\n{k} z" for k in range(6))]
    docs += ["\n".join(f"{k} v" for k in range(30)), "\n".join(f"{k} v" for k in [*range(20, 30), *range(10)]), "\n".join(f"{k} v" for k in (3, 4, 9, 10, 11, 2))]
    table = docs_of(spark, docs)
    got = {x["doc_id"]: x for x in line_dedup.deduplicated(table).collect()}
    want = slow_line_dedup(dict(enumerate(docs)))
    assert {i: x["text"] for i, x in got.items()} == want
    assert all(x["n_lines"] == len(docs[i].split("\n")) for i, x in got.items())
    import pandas as pd

    duck.register("some_docs", pd.DataFrame({"doc_id": range(len(docs)), "text": docs}))
    said = {x[0]: x[1:] for x in duck.execute(line_dedup.sql("some_docs")).fetchall()}
    assert said == {i: (x["n_lines"], x["n_removed"], hashlib.sha256(x["text"].encode()).hexdigest()) for i, x in got.items()}


def test_line_dedup_query(spark, duck):
    said = duck.execute(queries.oracle_sql()["op10_line_dedup"])
    names = [x[0] for x in said.description]
    assert sorted(tuple(r[n] for n in names) for r in queries.op10_line_dedup(spark, DATA).collect()) == sorted(said.fetchall())


def test_line_dedup_blocks(spark):
    docs = ["a b c d e\nf g\nh i j k l\n1 2 3 4 5", "0\n1 2 3 4 5\na b c d e\nf g\nz", "f g\nh i j k l"]
    blocks = sorted(tuple(b) for r in line_dedup.aligned(line_dedup.texts_of(docs_of(spark, docs))).collect() for b in r["blocks"])
    assert blocks == [(0, 2, 0, 1, False), (1, 1, 0, 3, True), (2, 2, 0, 0, False)]


def test_runs_cover_common_blocks():
    r = random.Random(5)
    names = [r.getrandbits(63) for _ in range(4)]
    for _ in range(300):
        lines = np.array([r.choice(names) for _ in range(r.randrange(12))], np.int64)
        words = np.array([r.choice([0, 1, 2, 5]) for _ in lines], np.int32)
        key, start, n = line_dedup.runs(lines, words)
        want = set()
        for a in range(len(lines)):
            ends = [b for b in range(a, len(lines)) if words[a : b + 1].sum() >= 5]
            want |= {(a, ends[0] - a + 1)} if ends else set()
            begins = [b for b in range(a + 1) if words[b : a + 1].sum() >= 5]
            want |= {(begins[-1], a - begins[-1] + 1)} if begins else set()
        assert sorted(zip(start.tolist(), n.tolist(), strict=True)) == sorted(want)
        by = {}
        for k, a, m in zip(key.tolist(), start, n, strict=True):
            by.setdefault(k, set()).add(tuple(lines[a : a + m]))
        assert all(len(x) == 1 for x in by.values()) and len(by) == len({tuple(lines[a : a + m]) for a, m in zip(start, n, strict=True)})


def test_line_dedup_of_many_short_lines():
    import time

    began = time.time()
    key, start, n = line_dedup.runs(np.zeros(1_000_000, np.int64), np.append(np.zeros(999_999, np.int32), np.int32(9)))
    assert len(key) == 1_000_000 and time.time() - began < 5
    found = line_dedup.patience([(j, 0, 5) for j in range(100_000)])
    assert len(found) == 100_000 and time.time() - began < 10


def test_line_dedup_of_one_id(spark):
    df = docs_of(spark, ["a b c d e\nx", "a b c d e\ny"]).withColumn("doc_id", F.lit(1).cast("long"))
    assert sorted(r["text"] for r in line_dedup.deduplicated(df).collect()) == ["a b c d e\nx", "a b c d e\ny"]


def test_patience():
    assert line_dedup.patience([(0, 0, 2), (1, 1, 2), (3, 5, 1)]) == [(0, 0, 3, False), (3, 5, 1, False)]
    assert line_dedup.patience([(0, 4, 1), (1, 0, 1), (2, 1, 1)]) == [(0, 4, 1, True), (1, 0, 2, False)]
    assert line_dedup.patience([(0, 0, 1), (2, 0, 1)]) == [(0, 0, 1, True), (2, 0, 1, False)]
    assert line_dedup.patience([]) == []


def test_names_of_queries():
    names = set(queries.queries())
    assert len(names) == 13 and {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}
