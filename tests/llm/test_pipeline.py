"""The pipeline against a plain restatement of its stages, and the registry of these queries."""

import re

import tiktoken

import __spark_entry__ as E
import corpus_pipeline as P
from retailcast.llm.common import parse_ranks, rank_pattern, vocabulary_path
from test_decontaminate import naive
from test_secret_scan import plain_base
from test_simhash import naive_components, naive_print

SMALL = "/root/testdata/sf0.001"


def masked(text):
    """Secrets of the fixture are all of the base shapes."""
    out, at = [], 0
    for _, b, e in plain_base(text):
        if b >= at:
            out.append(text[at:b] + "[SECRET]")
        at = max(at, e)
    return "".join([*out, text[at:]])


def test_run_against_plain_stages(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {i: r for i, r in docs.items() if re.search(r"[^\W\d_]", r.text or "")}   # each has one main language
    root = naive_components({naive_print(r.text) for r in kept.values()}, 4)
    first = {}
    for i in sorted(kept):
        first.setdefault(root[naive_print(kept[i].text)], i)
    kept = {i: kept[i] for i in first.values() if not naive(kept[i].text, items, 10)[1]}
    with open(vocabulary_path("byte_bpe_50k.tiktoken"), "rb") as f:
        encoding = tiktoken.Encoding("test", pat_str=rank_pattern(), mergeable_ranks=parse_ranks(f.read()),
                                     special_tokens={})
    got = {r.doc_id: r for r in P.run(spark, SMALL).collect()}
    assert set(got) == set(kept)
    for i, r in kept.items():
        text = masked(r.text)
        assert (got[i].text, got[i].lang, got[i].source, got[i].n_chars) == (text, r.lang, r.source, len(text))
        assert got[i].token_ids == encoding.encode_ordinary(text) and got[i].n_tokens == len(got[i].token_ids)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() == 0, name
    assert P.STAGES[-1][1](spark, docs, SMALL).count() == 0


def test_short_benchmark_items_remove_nothing(spark, tmp_path):
    long = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, "Yes"), (2, "New York"), (3, long), (4, None)], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "yes, in New York"), (2, "New York " * 10), (3, f"yes {long}."), (4, long[:-4])],
                                 "doc_id long, text string")
    assert sorted(r.doc_id for r in P.drop_contaminated(spark, docs, str(tmp_path)).collect()) == [1, 2, 4]


def test_registered():
    names = set(E.queries())
    assert {"pipeline"} | {n for n in names if n.startswith("op")} <= names
    assert sorted(int(n[2:].split("_")[0]) for n in names if re.match(r"op\d", n)) == list(range(1, 14))
    assert {"op2_decontaminate", "op3_url_filter", "op9_chat_format", "op12_source_mix"} <= set(E.oracle_sql())
