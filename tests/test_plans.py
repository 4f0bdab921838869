"""The plans that were meant: few exchanges, pushed filters, no Python and no one-task windows."""

import re

import pytest
from pyspark.sql import functions as F

from textmill.operators import mixture as mx
from textmill.operators.pack import pack
from textmill.operators.position import with_running_total, with_scan_position
from textmill.operators.shuffle import shuffle
from textmill.operators.split import split
from textmill.operators.tokenize import byte_tokenizer, tokenize
from textmill.plans import all_queries, tokens
from textmill.sources.corpus import first_n
from textmill.staging import stage, staged_since, staged_so_far


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("== Initial Plan ==")[0]


@pytest.fixture
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_shuffle_has_one_exchange_and_no_sampling(docs):
    text = plan(shuffle(docs, 4, key="doc_id"))
    assert text.count("Exchange") == 1 and "rangepartitioning" not in text


def test_numbered_shuffle_moves_the_rows_once(docs):
    text = plan(shuffle(docs, 4, key="doc_id", emit_pos=True))
    assert text.count("shufflepartitionidpassthrough") == 1 and text.count("Window [") == 1
    assert "Window [sum(_n" in text, "rows are numbered without a window; only bucket counts are summed"
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert reads[1:] == ["doc_id:bigint"] and "text" in reads[0]


def test_scan_positions_do_not_shuffle_the_rows(docs):
    text = plan(with_scan_position(docs))
    rows, counts = text.split("BroadcastExchange")
    assert "Exchange" not in rows.split("BroadcastHashJoin")[1]
    assert "ReadSchema: struct<>" in counts


def test_split_and_mix_are_map_only(docs):
    assert "Exchange" not in plan(split(docs, "doc_id"))
    plans = mx.mixture_plan(docs, {"en": 0.5, "de": 0.3, "fr": 0.15, "es": 0.05}, 300, "lang")
    text = plan(mx.mix(docs, plans, 1, "doc_id", "lang"))
    assert "SortMergeJoin" not in text
    # All exchanges of rows are below the aggregate of counts or inside the one cut bucket.
    payload = [e for e in re.findall(r"Exchange (hash|range|single)\w*\(([^)]*)\)", text) if "text" in e[1]]
    assert payload == []


def test_first_n_is_a_pushed_filter(docs):
    assert "PushedFilters: [IsNotNull(doc_id), LessThanOrEqual(doc_id,9)]" in plan(first_n(docs, 10, ["doc_id"]))


def test_byte_packing_stays_on_the_jvm_and_reuses_its_exchange(spark, docs):
    made = tokenize(with_scan_position(docs).withColumn("shard", F.col("pos") % 3), byte_tokenizer(), eod=256)
    assert "Python" not in plan(made)
    table = stage(made.select("shard", "pos", "tokens", "n_tokens"), "plan-test")
    text = final_plan(pack(table, 64))
    assert "Python" not in text
    exchanges = [line for line in text.split("\n") if "Exchange hashpartitioning(shard" in line and "_block" in line]
    assert sum("ReusedExchange" not in line for line in exchanges) == 1


def test_lengths_are_read_without_tokens(spark, sf):
    table = tokens.word_tokens(spark, sf)
    text = plan(with_running_total(table.select("pos", "n_tokens"), "n_tokens", "pos"))
    assert "tokens:array" not in text


def below(lines, i):
    """The plan under line ``i``."""

    def depth(line):
        bare = line.replace(":", " ")
        return len(bare) - len(bare.lstrip())

    for other in lines[i + 1 :]:
        if not other.strip(" :") or depth(other) <= depth(lines[i]):
            return
        yield other


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_one_task_sees_only_summaries(spark, sf, name):
    """A single partition may sit above an aggregate or a staged summary, never above rows."""
    lines = plan(all_queries()[name](spark, sf)).split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            body = "\n".join(below(lines, i))
            summaries = ("_block:bigint,_sum:bigint", "file:bigint,start:bigint,number:bigint")
            assert "Aggregate" in body or any(f"ReadSchema: struct<{s}>" in body for s in summaries), line
        assert "CartesianProduct" not in line and "BroadcastNestedLoopJoin" not in line


def test_tokenised_files_do_not_move_their_texts(spark, sf):
    from textmill.operators.indexed import indexed_datasets

    items = indexed_datasets(spark, [f"{sf}/documents.parquet"], byte_tokenizer(), "parquet", schema="text string")
    exchanges = [line for line in plan(items).split("\n") if re.search(r"Exchange (hash|range)", line)]
    assert not any("text" in line for line in exchanges)


def test_shuffle_by_content_moves_each_row_once(spark, docs):
    """Rows without copies only meet the exchange of the shuffle; the counted MD5s carry no column."""
    assert final_plan(shuffle(docs, 4, seed=1)).count("Exchange ") == 1, "no copies, nothing else to move"
    mark = staged_so_far()
    text = final_plan(shuffle(docs.unionByName(docs.where("doc_id < 3")), 4, seed=1))
    lines = text.split("\n")
    alone = [i for i, line in enumerate(lines) if "LeftAnti" in line]
    assert alone and all("BroadcastHashJoin" in lines[i] for i in alone)
    assert not any("Exchange" in x and "Broadcast" not in x for i in alone for x in below(lines, i))
    assert text.count("shufflepartitionidpassthrough") == 1
    assert [spark.read.parquet(p).columns for p in staged_since(mark)] == [["_content"]]


def test_outputs_by_file_move_texts_not_tokens(spark, sf, monkeypatch):
    """Texts are brought together before they are tokenised, in one exchange."""
    from textmill.operators import indexed

    for small in (True, False):
        monkeypatch.setattr(indexed, "is_small", lambda df, small=small: small)
        items = indexed.indexed_datasets(
            spark, [f"{sf}/documents.parquet"], byte_tokenizer(), "parquet", schema="text string", by_file=True
        )
        lines = plan(items).split("\n")
        moved = [i for i, line in enumerate(lines) if re.search(r"Exchange (hash|range|RoundRobin)", line)]
        assert not any("tokens" in lines[i] for i in moved)
        assert any("REBALANCE" in lines[i] for i in moved) is not small


def test_keys_of_an_order_are_not_moved(spark, sf):
    """The exchanges of a shuffle carry the rows' own columns, those of copies one column of signs more."""
    from textmill.plans.ordering import shuffle_lineitem_copies

    df = shuffle_lineitem_copies(spark, sf)
    node = df._jdf.queryExecution().executedPlan().toString().split("\n")
    moved = [i for i, line in enumerate(node) if "shufflepartitionidpassthrough" in line]
    assert len(moved) == 1
    assert "_key" not in "\n".join(below(node, moved[0])), "a key is worked out behind the exchange"
    assert "_negative_zero_" not in "\n".join(node) and "_negative_zeros" in "\n".join(node)
