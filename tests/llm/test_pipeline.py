import hashlib
import random
import re

import corpus_pipeline
from trawl.llm import decontam, quality, sp_sampling

from .test_near import changed, components, shingle_set
from .test_texts import hits

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "extra", "score"]


def build(spark, path, rows, labels, items):
    docs = [(i, t, "en", "src0", len(t or ""), None, 1) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, extra string, score int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_against_brute_force(spark, tmp_path, prose, odd):
    rng = random.Random(1)
    item = prose(900, 40)
    rows = list(odd)
    for k in range(100, 160):
        text = prose(k, rng.randrange(20, 90)).capitalize() + "."
        rows += [(k, text), (k + 1000, " ".join(text.split()) + "  "), (k + 2000, changed(text, rng, 1)), (k + 3000, " | ".join(prose(k + 5000, 60).split()))]
    rows += [(5000, prose(1, 40) + " " + item), (5001, prose(2, 40) + " " + " ".join(item.split()[3:15]))]
    labels = [(i, 0 if 3000 <= i < 5000 else 1, 0) for i, _ in rows if i is not None and i >= 100]
    build(spark, str(tmp_path), rows, labels, [(1, item), (2, None)])
    docs, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    whole = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        out = spark.read.parquet(str(tmp_path / f"out{k}"))
        before, after = docs.collect(), out.collect()
        if k < 4:
            assert out.columns == COLUMNS
            left = sorted((str(r.doc_id), r.text or "") for r in after)
            inside = sorted((str(r.doc_id), r.text or "") for r in before)
            assert all(x in inside for x in left)
        if name == "quality classifier":
            rejected = {r.doc_id for r in quality.quality_scores(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).filter("predicted = 0").collect()}
            assert {r.doc_id for r in after} == {r.doc_id for r in before} - rejected
            assert all(r.doc_id is None or not 3000 <= r.doc_id < 5000 for r in after)
        if name == "exact dedup":
            key = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
            assert sorted(key(r.text) for r in after) == sorted({key(r.text) for r in before})
        if name == "MinHash near-dedup":
            sets = [shingle_set(r.text) for r in before]
            groups = {c for c, s in zip(components(sets), sets) if s}
            assert len(after) == len(groups) + sum(not s for s in sets)
        if name == "benchmark decontamination":
            clean = [r.doc_id for r in before if not hits(r.text, [(1, item)], decontam.WINDOW)[1]]
            assert sorted(map(str, clean)) == sorted(str(r.doc_id) for r in after)
        if k == 4:
            own = sp_sampling.lattices(sp_sampling.MODEL, sp_sampling.ALPHA)
            texts = {r.doc_id: r.text or "" for r in before}
            assert all(sp_sampling.decode_pieces(sp_sampling.np.array(r.pieces, "i4"), own) == texts[r.doc_id] if r.pieces else not texts[r.doc_id] for r in after)
            assert all(r.n_pieces == len(r.pieces) for r in after) and len(after) == len(before)
        docs = out
        sizes.append(len(after))
    assert len(rows) > sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r.doc_id or -1 for r in again.select("doc_id").collect()) == sorted(r.doc_id or -1 for r in docs.collect())
    assert whole.count() == len(rows)


def test_no_documents(spark, tmp_path):
    build(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
