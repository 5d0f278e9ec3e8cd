import pytest

from trawl.llm import decontam, minhash, quality


@pytest.mark.parametrize("shared", [None, 7])
def test_stages_decide_by_row(spark, table, prose, shared):
    good, bad = prose(1, 60).capitalize() + ".", " | ".join(prose(2, 60).split())
    rows = [(100 + k, prose(100 + k, 60).capitalize() + "." if k % 2 else " | ".join(prose(100 + k, 50).split())) for k in range(60)]
    labels = spark.createDataFrame([(100 + k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    own = lambda df: sorted(r.text for r in df.filter("doc_id IS NULL OR doc_id = 7").collect())
    assert own(quality.drop_low_quality(table([*rows, (shared, good), (shared, bad)]), labels)) == [good]
    item = prose(3, 40)
    held = good + " " + item
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert own(decontam.decontaminate(table([(shared, good), (shared, held), (1, bad)]), items)) == [good]
    near = good.split()
    near = " ".join([*near[:-1], "changed"])
    other = prose(4, 60)
    out = minhash.drop_near_duplicates(table([(shared, good), (shared, near), (shared, other), (9, other + " x")]))
    assert len([r for r in out.collect() if r.text in (good, near)]) == 1 and out.count() == 2
