"""The pipeline's stages on what the one before kept, against plain versions, and on odd rows."""

import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_llm_operators import DOCS, docs_of, odd_docs, semi_global, slow_components, slow_line_dedup

import corpus_pipeline
from folioscope.llm import decontaminate, near_text, toxicity
from folioscope.llm.common import crc_mod, read
from folioscope.llm.simhash import fingerprint, shingles

STAGE = dict(corpus_pipeline.STAGES)


def alike(texts):
    """Pairs of places of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    sets = [set(shingles(x, 5)) for x in texts]
    return [(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]


def leaky(text, items):
    held = decontaminate.normalised(text).tobytes().decode("utf-32-le")
    return any(x in held or (len(held) < 3000 and semi_global(x, held) <= int(len(x) * decontaminate.EDIT_RATE)) for x in items)


def test_stages(spark, tmp_path):
    docs = read(spark, DATA, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"]: r for r in docs.collect()})
        assert name == "sentencepiece" or docs.columns == columns
    start = {r["doc_id"]: r for r in read(spark, DATA, "documents").collect()}
    source, labels = read(spark, DATA, "documents"), read(spark, DATA, "labels")
    model = toxicity.learn(source.where(crc_mod("doc_id", 5) != 0), labels.where(crc_mod("doc_id", 5) != 0))
    features = toxicity.Features(model.ids)
    assert set(kept[0]) == {i for i, r in start.items() if model.score(features, r["text"]) < 0.5}
    want = slow_line_dedup({i: r["text"] for i, r in kept[0].items()})
    assert {i: r["text"] for i, r in kept[1].items()} == {i: t for i, t in want.items() if t.strip(" ") or t == kept[0][i]["text"]}
    assert all(r["n_chars"] == len(r["text"]) for r in kept[1].values())
    ids = sorted(kept[1])
    group = slow_components(list(range(len(ids))), alike([kept[1][i]["text"] for i in ids]))
    assert set(kept[2]) == {i for k, i in enumerate(ids) if group[k] == k}
    items = [decontaminate.normalised(r["text"]).tobytes().decode("utf-32-le") for r in read(spark, DATA, "benchmark").collect()]
    gone = set(kept[2]) - set(kept[3])
    assert gone and {i for i, r in kept[2].items() if any(x in decontaminate.normalised(r["text"]).tobytes().decode("utf-32-le") for x in items)} <= gone
    assert all(leaky(kept[2][i]["text"], items) for i in gone if len(kept[2][i]["text"]) < 2000)
    assert set(kept[4]) == set(kept[3])


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 50 and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", list(STAGE))
def test_stages_on_odd_rows(spark, name):
    """Nulls, empty and very long texts, ties, repeated rows, columns with clashing names, a repeated id; and the empty table."""
    odd = odd_docs(spark)
    out = STAGE[name](spark, odd, DATA)
    rows = out.collect()
    assert STAGE[name](spark, odd.where("false"), DATA).count() == 0
    if name == "sentencepiece":
        assert len(rows) == odd.count()
        return
    assert out.columns == odd.columns and out.dtypes == odd.dtypes
    texts = [r["text"] for r in rows]
    if name in ("toxicity", "decontamination"):
        assert sorted(map(str, rows)) == sorted(map(str, odd.collect()))
    if name == "line dedup":
        # Exact copies lose all and go, the row of a null id stays, and so do null and empty texts.
        assert texts.count("A  b\tc") == 2 and texts.count(None) == 1 and texts.count("") == 1 and sum(r["doc_id"] is None for r in rows) == 1
        assert texts.count("word " * 3000) == 1
    if name == "simhash near-dedup":
        # One row of each text; null, empty and wordless ones are one group; repeated rows and null ids go where another stands.
        assert sorted((r["doc_id"] for r in rows)) == [0, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]


@pytest.mark.parametrize("few", [1 << 20, 0])
def test_near_copies_by_rows(spark, monkeypatch, few):
    monkeypatch.setattr(near_text, "FEW", few)
    rows = [(2, "a b c d e f"), (5, "a b c d e f"), (5, "u v w x y z"), (5, "u v w x y z"), (None, "u v w x y z"), (None, "o p q r s"), (None, "o p q r s"), (7, None), (8, " "), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = STAGE["simhash near-dedup"](spark, docs, DATA).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(2, "a b c d e f"), (5, "u v w x y z"), (None, "o p q r s"), (7, None)], key=str)


@pytest.mark.parametrize("hot", [64, 1])
def test_near_copies_of_similarity(spark, monkeypatch, hot):
    monkeypatch.setattr(near_text, "HOT", hot)
    monkeypatch.setattr(near_text, "RATE", 1)
    r, word = random.Random(12), lambda: f"w{r.randrange(900)}"
    base = [[word() for _ in range(r.randrange(5, 400))] for _ in range(20)]
    passage = [word() for _ in range(60)]
    texts = [None, "", " ", "a b", "a  b"]
    for b in base:
        for _ in range(8):
            x = list(b)
            for _ in range(r.randrange(5)):
                x[r.randrange(len(x))] = word()
            texts.append(" ".join(x + [word() for _ in range(r.randrange(12))]))
    texts += [" ".join([*base[0], *x]) for x in base[1:4]]
    texts += [" ".join([*passage, *(word() for _ in range(r.randrange(60)))]) for _ in range(40)]
    pairs = alike(texts)
    far = [(a, b) for a, b in pairs if (fingerprint(texts[a]) ^ fingerprint(texts[b])).bit_count() > 3]
    group = slow_components(list(range(len(texts))), pairs)
    kept = {x["doc_id"] for x in STAGE["simhash near-dedup"](spark, docs_of(spark, texts), DATA).collect()}
    assert len(far) > 20 and kept == {i for i in group if group[i] == i}


def test_common_shingles(spark, monkeypatch):
    """The table flags the first shingles that texts share and little else."""
    from folioscope.llm.simhash import digests

    monkeypatch.setattr(near_text, "RATE", 1)
    shared = " ".join(f"s{k}" for k in range(60))
    rows = near_text._rows(docs_of(spark, [f"{shared} own{k} x y z q r" for k in range(near_text.HOT)] + ["t u v w x y z"]))
    table = near_text.common_shingles(rows, 5).value
    every, other = near_text.shingle_set(digests(shared, 5)), near_text.shingle_set(digests("t u v w x y z a b c d e f", 5))
    assert near_text.flagged(table, every).sum() > 20 and near_text.flagged(table, other).sum() == 0
    assert near_text.common_shingles(rows.where("doc_id > 0"), 5) is None


def test_empty_tables_end_to_end(spark, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        read(spark, DATA, table).limit(0).write.parquet(str(tmp_path / f"{table}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_folders_of_stages_go(spark):
    import os

    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, DATA)
    new = [x for x in set(os.listdir(folder)) - before if x.startswith("pipeline-")]
    assert len(new) == 1 and os.listdir(f"{folder}/{new[0]}") == ["4"] and out.select(F.count("*")).first()[0] > 0 and DOCS
