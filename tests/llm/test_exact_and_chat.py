import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trawl.llm import chat_format as chat
from trawl.llm.exact_dedup import ExactDedupIndex, exact_dedup


def key(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode()).hexdigest()


def test_exact_against_brute_force(spark, table, odd):
    rows = ExactDedupIndex(spark, buckets=3).add(table(odd)).collect()
    assert len(rows) == len(odd)
    groups = {}
    for i, t in odd:
        groups.setdefault(key(t), []).append((-len(t or ""), i is None, i or 0, i))
    for r in rows:
        own = groups[bytes(r.digest).hex()]
        assert (r.keep_id, r.group_size) == (min(own)[3], len(own))
    assert sum(r.kept for r in rows) == len(groups)


def test_exact_keeps_one_row_of_each_text(spark, table, odd):
    docs = table(odd)
    out = exact_dedup(docs)
    assert out.columns == docs.columns
    assert sorted(key(r.text) for r in out.collect()) == sorted({key(t) for _, t in odd})
    assert exact_dedup(table([])).count() == 0


def test_index_goes_on(spark, table, tmp_path):
    first = ExactDedupIndex(spark, str(tmp_path / "index"), buckets=2)
    assert sum(r.kept for r in first.add(table([(1, "a"), (2, "b")])).collect()) == 2
    again = ExactDedupIndex(spark, str(tmp_path / "index"), buckets=2)
    got = {r.doc_id: (r.keep_id, r.kept) for r in again.add(table([(3, "a   "), (4, "c"), (5, "c ")])).collect()}
    assert got == {3: (1, False), 4: (5, False), 5: (5, True)}
    assert again.entries().count() == 3


def test_hot_group(spark, table):
    docs = table([(k, "same" if k % 3 else f"t{k}") for k in range(3000)])
    rows = ExactDedupIndex(spark).add(docs).collect()
    assert sum(r.kept for r in rows) == 1001 and {r.group_size for r in rows} == {1, 2000}


def test_index_keeps_its_buckets(spark, table, tmp_path):
    texts = [(k, f"text {k}") for k in range(200)]
    assert sum(r.kept for r in ExactDedupIndex(spark, str(tmp_path / "index"), buckets=8).add(table(texts)).collect()) == 200
    again = ExactDedupIndex(spark, str(tmp_path / "index"))
    assert again.buckets == 8
    with pytest.raises(ValueError, match="8 buckets"):
        ExactDedupIndex(spark, str(tmp_path / "index"), buckets=4)
    added = again.add(table(texts))
    rows = added.collect()
    assert len(rows) == 200 and not any(r.kept for r in rows) and all(r.keep_id == r.doc_id for r in rows)
    # Only the batch's hot digests are broadcast, and there are none among two hundred of one row each beyond the rule's floor.
    hot = again.add(table([(1000 + k, "text 7") for k in range(5000)] + [(9000, "new")])).collect()
    assert {(r.keep_id, r.group_size, r.kept) for r in hot} == {(7, 5000, False), (9000, 1, True)}


def test_batches_are_added_once(spark, table, tmp_path, monkeypatch):
    index = ExactDedupIndex(spark, str(tmp_path / "index"), buckets=2)
    docs = table([(1, "a"), (2, "a"), (3, "b"), (None, "b")])
    answer = lambda: sorted((str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in index.add(docs, "monday").collect())
    with monkeypatch.context() as broken:
        broken.setattr("trawl.llm.exact_dedup.write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            answer()
    assert index.entries().count() == 0
    first = answer()
    assert first == answer() == [("1", 1, 2, True), ("2", 1, 2, False), ("3", 3, 2, True), ("None", 3, 2, False)]
    assert index.entries().count() == 2 and set(index.batches()) == {"monday"}


def test_old_batches_are_folded(spark, table, tmp_path, monkeypatch):
    monkeypatch.setattr("trawl.llm.exact_dedup.MOST_OPEN", 4)
    path = tmp_path / "index"
    index = ExactDedupIndex(spark, str(path), buckets=2)
    batch = lambda k: table([(10 * k, f"own {k}"), (10 * k + 1, "shared"), (10 * k + 2, f"own {max(k - 1, 0)}")])
    answer = lambda where, k: sorted((r.doc_id, r.keep_id, r.kept) for r in where.add(batch(k), f"day {k}").collect())
    size = lambda where: len(where.entries()._jdf.queryExecution().optimizedPlan().toString())
    first, sizes = {}, []
    for k in range(14):
        with monkeypatch.context() as broken:
            if k in (3, 5):  # an attempt that is broken off, before it is folded or after
                broken.setattr("trawl.llm.exact_dedup.write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError, match="lost"):
                    answer(index, k)
        first[k] = answer(index, k)
        sizes.append(size(index))
        assert len([*(path / index.folder).glob("part-*")]) <= 2 * (4 + 2) and len(index.batches()) <= 4
    assert first[0] == [(0, 0, True), (1, 1, True), (2, 0, False)] and first[9] == [(90, 90, True), (91, 1, False), (92, 80, False)]
    assert sizes[13] <= max(sizes[:4]) + 100 and index.generation == 3
    again = ExactDedupIndex(spark, str(path))
    assert {k: answer(again, k) for k in (0, 4, 13)} == {k: first[k] for k in (0, 4, 13)}
    assert sorted(r.keep_id for r in again.entries().collect()) == sorted([1, *range(0, 140, 10)]) and again.generation == 3
    # Generations before the last one are gone.
    assert len([n for n in path.iterdir() if n.name[0] == "g"]) == 2
    again.compact()
    assert not again.batches() and again.folded().count() == 14 and answer(again, 13) == first[13]


def test_a_broken_compaction_changes_nothing(spark, table, tmp_path, monkeypatch):
    index = ExactDedupIndex(spark, str(tmp_path / "index"), buckets=2)
    index.add(table([(1, "a"), (2, "b")]), "one").count()
    with monkeypatch.context() as broken:
        broken.setattr("trawl.llm.exact_dedup.write_text", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            index.compact()
    again = ExactDedupIndex(spark, str(tmp_path / "index"))
    for now in (index, again):
        assert {r.keep_id for r in now.entries().collect()} == {1, 2} and set(now.batches()) == {"one"}
    again.compact()
    assert {r.keep_id for r in ExactDedupIndex(spark, str(tmp_path / "index")).entries().collect()} == {1, 2}


def test_rows_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6, 7), (2, "a", 8, 9, 10), (None, "b", 1, 2, 3)], "doc_id long, text string, __row long, __ROW_own int, row_id int")
    out = exact_dedup(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=str) == [(1, "a", 5, 6, 7), (None, "b", 1, 2, 3)]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(["user", "assistant", "system", "", "a]b\\"]), st.text(alphabet="<s>/[INST]ROLE: \\ok\n", max_size=25) | st.text(max_size=20))
def test_round_trip(role, text):
    turns = chat.parse(chat.render(role, text) + chat.render("assistant", text))
    assert [t[:2] for t in turns] == [(role, text), ("assistant", text)]


def test_escapes_only_where_needed():
    assert chat.render("user", "plain < [x] text") == "<s>[INST] plain < [x] text[/INST]"
    assert chat.render("assistant", "a [/INST] b") == " a \\[/INST] b</s>"
    with pytest.raises(ValueError):
        chat.parse("no turn")


def test_conversations(spark):
    trap = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", trap), (1, 0, "user", None), (1, 1, "assistant", trap), (None, 0, None, "x"), (None, None, "user", "y"), (2, 0, "assistant", "é" * 50_000), (3, 0, "user", "")]
    got = {r.conv_id: r for r in chat.conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].n_turns == 3 and got[1].turns_sha256 == sha(f"user\n\nassistant\n{trap}\nassistant\n{trap}\n") and got[1].loss_sha256 == sha(trap * 2)
    assert got[None].turns_sha256 == sha("user\ny\n\nx\n") and got[None].loss_chars == 0
    assert got[2].loss_chars == 50_000 and got[3].n_turns == 1
    whole = {}
    for r in chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.segment
    assert all(len(whole[k]) == got[k].formatted_chars for k in got) and len(chat.parse(whole[1])) == 3
    # Rows of one turn are in the order of their texts, not of what they are rendered to.
    tied = chat.conversation_digests(spark.createDataFrame([(1, 0, "user", "A"), (1, 0, "user", "<s>")], "conv_id long, turn long, role string, text string")).first()
    assert tied.turns_sha256 == sha("user\n<s>\nuser\nA\n")
    assert chat.conversation_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string, segment int")).count() == 0
