"""The pipeline and the thin queries, on small tables."""

import os
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from gleanery.llm import common, exact_dedup, langid, queries

SF = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: bool(v) if isinstance(v, bool) or type(v).__name__ == "bool_" else v.item() if hasattr(v, "item") else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


def test_all_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "mixing"]


@here
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        at = Path(SF, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    df, want = queries.queries()[name](spark, SF), con.execute(queries.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in want.description], want.fetchall())


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def norm(t):
    return (t or "").translate(LOWER)


def alike(rows):
    """Groups (lists of places) of rows whose sets of word pairs are linked; nothing of the engine is used."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", norm(t)) for t in rows]
    sets = [set(zip(w, w[1:], strict=False)) if len(w) > 1 else set(w) for w in words]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if of[i] != of[j] and n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = of[i], of[j]
                of = [b if x == a else x for x in of]
    groups = {}
    for i, x in enumerate(of):
        groups.setdefault(x, []).append(i)
    return list(groups.values())


def leaks(t, items):
    cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", norm(x))
    w = f" {' '.join(cut(t))} "
    for x in items:
        v = cut(x)
        n = min(10, len(v))
        if v and any(f" {' '.join(v[i : i + n])} " in w for i in range(len(v) - n + 1)):
            return True
    return False


def brute_stage(name, rows, items):
    """Rows (doc_id, text, ...) that a stage keeps, as lists of equally good choices."""
    if name == "language_id":
        return [[r] for r in rows if re.search(r"[^\W\d_]", r[1] or "")]
    if name == "decontamination":
        return [[r] for r in rows if not leaks(r[1], items)]
    least = lambda r: (r[0] is None, r[0] or 0)
    if name == "exact_dedup":
        by = {}
        for r in rows:
            by.setdefault(norm(r[1]), []).append(r)
        best = lambda g: max((x[0] for x in g if x[0] is not None), default=None)
        return [[r for r in g if r[0] == best(g)] for g in by.values()]
    return [[rows[i] for i in g if least(rows[i]) == min(least(rows[j]) for j in g)] for g in alike([r[1] for r in rows])]


def check_stage(name, got, rows, items):
    """Every group of choices keeps one row, and nothing else is kept."""
    want, left = brute_stage(name, rows, items), list(got)
    for choices in want:
        mine = next((r for r in left if r in choices), None)
        assert mine is not None, (name, choices[0])
        left.remove(mine)
    assert not left, (name, left[0])


@here
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(spark.createDataFrame([(10_000, "12 34 !!", "en", "src0", 8), (10_001, None, None, None, None)], docs.schema))
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns, rows = docs.columns, list(map(tuple, docs.collect()))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.staged(stage(spark, docs, SF), name)
        assert docs.columns == columns
        got = list(map(tuple, docs.collect()))
        check_stage(name, got, rows, items)
        rows = got
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r["doc_id"] for r in mixed} == {r[0] for r in rows}
    for size, target in {(r["source_size"], r["target"]) for r in mixed}:
        taken = sum(r["taken"] for r in mixed if (r["source_size"], r["target"]) == (size, target))
        assert abs(taken - target) <= 256 and all(r["taken"] <= 3 * r["size"] for r in mixed)


SHARED = [
    (5, "unique text of five"), (5, "twin text of two rows here"), (7, "TWIN text of two rows here"), (None, "solo twin of one without an id"), (9, "solo twin of one without an id"),
    (1, "a clean row that shares its id"), (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (None, "say alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "another row without an id"),
    (None, "another row without an ID"), (3, "the same row twice over"), (3, "the same row twice over"), (4, "12 34"), (4, "letters beside a row of digits"), (None, None), (8, ""), (None, "99"),
    (20, "near copies have many words in common but for the last one or two of them aye"), (5, "near copies have many words in common but for the last one or two of them nay"), (None, "near copies have many words in common but for the last one or two of them hm"),
]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_rows_that_share_an_id_or_have_none_are_judged_alone(spark, tmp_path, name):
    items = ["Alpha, beta gamma delta epsilon zeta eta theta iota kappa"]
    spark.createDataFrame([(1, items[0])], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(d, t, "en", i, 1.5) for i, (d, t) in enumerate(SHARED)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, row__ long, maybe__ double").repartition(3)
    got = dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    check_stage(name, list(map(tuple, got.collect())), rows, items)


def test_empty_documents(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_keeps_clean_rows_of_all_columns(spark):
    rows = spark.createDataFrame([(i, "the words of this are plain " * 5, "en", i) for i in range(20)], "doc_id long, text string, lang string, at__ long")
    kept = langid.keep_identified(rows.withColumn("extra", F.lit("x")))
    assert kept.count() == 20 and "extra" in kept.columns
    assert exact_dedup.drop_copies(rows).count() == 1


@here
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_thin_queries_without_sql_return_their_contract(spark, name):
    df = queries.queries()[name](spark, SF)
    table = {"op3_url_filter": "pages", "op6_html_extraction": "pages"}.get(name, "documents")
    rows, n = df.collect(), spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert len(rows) == n
    assert set(CONTRACT[name].split()) <= {f"{f.name}:{f.dataType.simpleString()}" for f in df.schema.fields}


CONTRACT = {
    "op1_toxicity": "doc_id:bigint held_out:boolean score:double predicted:int",
    "op2_language_id": "doc_id:bigint held_out:boolean lang_pred:string score:double",
    "op3_url_filter": "page_id:bigint host:string path:string rule:string verdict:string",
    "op5_mixing": "doc_id:bigint size:bigint source_size:bigint target:double taken:bigint",
    "op6_html_extraction": "page_id:bigint url:string text:string n_chars:bigint",
    "op8_line_dedup": "doc_id:bigint n_lines:bigint n_dropped:bigint n_words_dropped:bigint text:string",
}


def test_scratch_tables_go_and_results_stay(spark):
    with common.scratch(spark):
        inner = common.staged(spark.range(5), "inner")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        inner.collect()
    assert [common.size_of(x) for x in ("32m", "64MB", "7", "1g", "2kb")] == [32 << 20, 64 << 20, 7, 1 << 30, 2 << 10]
