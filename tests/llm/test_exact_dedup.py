import hashlib
import random
import re

from lattica.llm.exact_dedup import exact_dedup, keep_first

SCHEMA = "doc_id long, text string, sha string, node int, kept string"


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", t or ""), []).append(i)
    out = set()
    for t, ids in groups.items():
        for i in ids:
            out.add((i, min(ids), len(ids), i == min(ids), hashlib.sha256(t.encode()).hexdigest()))
    return out


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in rows], SCHEMA).repartition(parts)


def test_against_brute_force_with_a_hot_group(spark):
    r = random.Random(1)
    rows = [(i, "hot \t copy" if r.random() < 0.35 else r.choice([None, f"own {i}", "a b", "a  b", "a\nb", " a b", "", "é"])) for i in range(600)]
    got = {tuple(x) for x in exact_dedup(frame(spark, rows)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
    assert got == brute(rows)


def test_any_radix_and_width_give_the_same(spark):
    rows = [(i, str(i % 37)) for i in range(300)]
    want = brute(rows)
    for radix, width in ((2, 3), (4, 9), (8, 64)):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", width)
        got = {tuple(x) for x in exact_dedup(frame(spark, rows), radix=radix).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == want


def test_null_ids_repeats_empty_and_long(spark):
    rows = [(None, "a"), (None, "a"), (3, "a"), (3, "a"), (4, None), (5, ""), (None, "only"), (None, "only"), (9, "word " * 200_000)]
    got = exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    kept = [(x["keep_id"], x["group_size"]) for x in got if x["kept"]]
    assert sorted(kept, key=str) == sorted([(3, 4), (4, 2), (None, 2), (9, 1)], key=str)
    assert exact_dedup(frame(spark, [])).count() == 0


def test_keep_first_keeps_columns_and_one_row(spark):
    rows = [(2, "a b"), (1, "a  b"), (1, "a  b"), (7, "c"), (None, None), (None, "")]
    got = keep_first(frame(spark, rows))
    assert got.columns == ["doc_id", "text", "sha", "node", "kept"]
    assert sorted(((x["doc_id"], x["text"] or "") for x in got.collect()), key=str) == sorted([(1, "a  b"), (7, "c"), (None, "")], key=str)
