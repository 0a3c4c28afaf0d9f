import hashlib

import pytest

from gleanery.llm import common, exact_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, k string, maybe long"
ROWS = [
    (1, "Same", "a", 1), (2, "sAME", None, 2), (3, "same ", "c", None), (4, "É", "d", 1), (5, "é", "d", 1), (6, None, "d", 1), (7, "", "d", 1),
    (8, "long " * 200_000, "d", 1), (9, "LONG " * 200_000, "d", 1), (None, "lone", "d", 1), (None, "pair", "d", 1), (10, "pair", "d", 1), (11, "twice", "d", 1), (11, "twice", "d", 1), (12, "alone", "d", 1),
    *[(100 + i, "hot", "h", i) for i in range(40)],
]


def brute(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for d, t, *_ in rows:
        x = (t or "").translate(LOWER)
        ids = [i for i in groups[x] if i is not None]
        keep = max(ids) if ids else None
        out.append((d, keep, len(groups[x]), d == keep, hashlib.sha256(x.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


@pytest.mark.parametrize("bits", [256, 2])
def test_matches_brute_force_even_when_digests_collide(spark, bits):
    assert found(exact_dedup.dedup(spark.createDataFrame(ROWS, SCHEMA).repartition(3), bits)) == brute(ROWS)


def test_state_spans_batches_and_restarts(spark):
    slim = common.staged(exact_dedup.digests(spark.createDataFrame(ROWS, SCHEMA).repartition(5)), "digests")
    folder = slim.inputFiles()[0].rsplit("/", 1)[0]
    stream = spark.readStream.schema(slim.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    checkpoint = common.stage_path(spark, "state")
    index = exact_dedup.stateful_index(spark, stream, checkpoint)
    assert index.where("n = 40").count() == 1
    exact_dedup.digests(spark.createDataFrame([(500, "HOT", "", 0)], SCHEMA)).write.mode("append").parquet(folder)
    again = exact_dedup.stateful_index(spark, stream, checkpoint)
    assert [(r["keep_id"], r["n"]) for r in again.where("n > 40").collect()] == [(500, 41)]
    assert again.count() == index.count()


def test_empty_table_and_kept_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.dedup(empty).count() == 0
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup.drop_copies(docs)
    assert set(kept.columns) == set(docs.columns)
    want = {}
    for d, t, *_ in ROWS:
        key = (t or "").translate(LOWER)
        want[key] = d if key not in want or want[key] is None or d is not None and d > want[key] else want[key]
    assert sorted((str(r["doc_id"]), (r["text"] or "").translate(LOWER)) for r in kept.collect()) == sorted((str(d), t) for t, d in want.items())
