"""Registered queries against their SQL at the smallest scale."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from corpusmill.plans import registry

from .conftest import SMALL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["tok_bow", "tok_byte_ngram", "fm_index", "fm_stats", "sp_crossval", "sp_learncurve", "w_infogain", "ft_tfidf", "ds_cosine", "clf_nb_multinomial", "clf_textcat", "mt_replicate", "rs_confusion", "mx_macro", "md_value_counts", "src_jsonl", "snk_libsvm", "entry_language_id"]


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: None if isinstance(v, float) and math.isnan(v) else round(float(v), 6) + 0.0 if isinstance(v, float) else v
    return sorted(repr([value(r[i]) for i in order]) for r in rows)


def agree(spark, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    got = query(spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(names, cur.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, name):
    agree(spark, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", ["tok_perword_ngram", "on_classify_batch", "ex_grid", "mt_ordinal_learn", "clf_class_tree_nodes"])
def test_changed_query_agrees_with_sql(spark, name):
    agree(spark, registry.queries()[name], registry.oracle_sql()[name])


def test_whole_arff_header(spark):
    """The header comes back with the class and every other line, not only the features' attributes."""
    query, sql = registry.queries()["snk_arff_header"], registry.oracle_sql()["snk_arff_header"]
    agree(spark, query, sql)
    rows = query(spark, SMALL).orderBy("line").collect()
    langs = sorted(r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("lang").distinct().collect())
    assert [r.line for r in rows] == list(range(len(rows)))
    assert [r.value for r in rows[:3] + rows[-2:]] == ["@RELATION 'corpus'", "", f"@ATTRIBUTE class {{{','.join(langs)}}}", "", "@DATA"]
    assert [r.idx for r in rows] == [None] * 3 + list(range(len(rows) - 5)) + [None] * 2


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 2


def test_stream_gives_what_the_batch_gives(spark):
    batch = registry.queries()["on_classify_batch"](spark, SMALL).groupBy("label").sum("n").collect()
    stream = registry.queries()["on_stream"](spark, SMALL).collect()
    assert {r[0]: r[1] for r in batch} == {r.label: r.n for r in stream}
