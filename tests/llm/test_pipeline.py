"""The pipeline's rows against its stages' operators, applied one by one and checked by hand."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
from tokenizers import Tokenizer

from allelio.llm import bpe, mixing, quality, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline(spark, tmp_path):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near duplicates", "mix", "tokens"]
    want = [r.asDict() for r in docs.collect()]
    for k, (name, fn) in enumerate(corpus_pipeline.STAGES):
        out = fn(spark, docs, SF)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            out.write.parquet(str(tmp_path / str(k)))
            out = spark.read.parquet(str(tmp_path / str(k)))
        texts = [r["text"] or "" for r in want]
        if name == "quality":
            model = quality.train(docs, labels)
            scores = model.scores(np.array([quality.features(t.encode()) for t in texts]))
            want = [r for r, s in zip(want, scores, strict=True) if s >= 0.5]
        elif name == "toxicity":
            scores = toxicity.Scorer(toxicity.train(docs, labels)).scores(texts)
            want = [r for r, s in zip(want, scores, strict=True) if s < 0.5]
        elif name == "near duplicates":
            prints = [simhash.fingerprint(t.encode()) for t in texts]
            root = list(range(len(prints)))
            for i, a in enumerate(prints):
                for j in range(i):
                    if (a ^ prints[j]).bit_count() <= 3 and root[i] != root[j]:
                        old, new = root[i], root[j]
                        root = [new if x == old else x for x in root]
            least = {}
            for x, r in zip(root, want, strict=True):
                least[x] = min(r["doc_id"], least.get(x, r["doc_id"]))
            want = [r for x, r in zip(root, want, strict=True) if least[x] == r["doc_id"]]
        elif name == "mix":
            taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
            got = Counter()
            for r in out.collect():
                got[r["doc_id"]] += len(r["text"].split())
            assert got == Counter({i: n for i, n in taken.items() if n})
            want = [r.asDict() for r in out.collect()]
        if k < 4:
            key = lambda r: (r["doc_id"], r["text"])
            assert sorted(map(key, out.collect())) == sorted(map(key, want))
            assert 0 < len(want)
            docs = out
    library = Tokenizer.from_file(bpe.default_path())
    rows = [(r["doc_id"], np.array(library.encode(r["text"], add_special_tokens=False).ids, "<u4"), r["text"]) for r in want]
    expected = Counter((i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, ids, t in rows)
    assert Counter(map(tuple, out.collect())) == expected
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == expected


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def through(spark, docs, labels, folder):
    labels.write.parquet(f"{folder}/labels.parquet")
    counts = []
    for k, (_, fn) in enumerate(corpus_pipeline.STAGES):
        out = fn(spark, docs, str(folder))
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{folder}/{k}")
            docs = out = spark.read.parquet(f"{folder}/{k}")
        counts.append(out.count())
    return counts, out


def test_odd_rows_and_labels_of_one_class(spark, tmp_path):
    rows = [(i, f"document number {i} has words of its own, such as w{i * 7919} and v{i * 31}", "en", "a" if i % 3 else None, 60) for i in range(30)]
    rows += [(100, None, None, "a", None), (101, "", "en", "a", 0), (102, " \t", "en", "a", 2), rows[3], (3, "another text under the same id", "en", "a", 30), (None, "a text without id", "en", "b", 17)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS h1", "'x' AS fp", "2 AS label", "3 AS _h1")
    only = spark.createDataFrame([(i, 0, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    counts, out = through(spark, docs, only, tmp_path)
    # No label tells good from bad, so nothing goes before the near duplicates.
    assert counts[:2] == [len(rows)] * 2
    assert counts[2] <= len(rows) - 3 and counts[3] == counts[4] > 0
    assert {r["doc_id"] for r in out.collect()} >= {i for i in range(30) if i != 3}


def test_empty_table(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    counts, _ = through(spark, spark.createDataFrame([], SCHEMA), labels, tmp_path)
    assert counts == [0] * 5
