import random
import zlib

import corpus_pipeline as P
from lattica.llm import langid, packing, quality
from lattica.llm.common import table

from .test_minhash import brute
from .test_quality import bad, good


def corpus(seed=11, n=300):
    r = random.Random(seed)
    rows, texts = [], []
    for i in range(n):
        x = r.random()
        if x < 0.15:
            t = bad(r)
        elif x < 0.3 and texts:
            t = r.choice(texts).replace(" ", "  ", 1) + " "[: r.randint(0, 1)]  # equal but for white space
        elif x < 0.45 and texts:
            w = r.choice(texts).split(" ")
            w[r.randrange(len(w))] = "Changed"
            t = " ".join(w)
        else:
            t = good(r)
            texts.append(t)
        rows.append((i, t, "en", "web", len(t)))
    hot = texts[0]
    rows += [(n + k, hot, "en", "hot", len(hot)) for k in range(80)]
    rows += [(9000, None, None, None, None), (9001, "", "en", "web", 0), (9002, "12 34 . 56", None, "web", 10), (9003, good(r) * 300, "en", "web", None)]
    return rows


def write(spark, tmp_path, rows):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")


def expected(spark, rows, docs):
    """What each stage keeps, by plain loops. The two fitted models are those of the stages."""
    scorer = quality.Scorer(quality.fit(docs))
    rows = [x for x in rows if scorer(x[1]) >= 0.5]
    kept = [{x[0] for x in rows}]
    letters = langid.letters()
    model = langid.learn(spark.createDataFrame(rows, docs.schema))
    rows = [x for x in rows if not model.predict([langid.symbols(x[1], letters)])[0][3]]
    kept.append({x[0] for x in rows})
    first = {}
    for x in sorted(rows):
        first.setdefault(" ".join(("a" + x[1] + "a").split()), x)
    rows = list(first.values())
    kept.append({x[0] for x in rows})
    alone = {i for i, _, _, keep in brute([x[:2] for x in rows], 5, 80) if keep}
    return [*kept, alone]


def test_stages_against_plain_loops(spark, tmp_path):
    rows = corpus()
    write(spark, tmp_path, rows)
    docs = table(spark, str(tmp_path), "documents")
    want = expected(spark, rows, docs)
    assert len({frozenset(x) for x in [set(x[0] for x in rows), want[0], want[2], want[3]]}) == 4  # decisions take effect
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert {x["doc_id"] for x in docs.collect()} == want[k], P.STAGES[k][0]
    texts = {x[0]: x[1] for x in rows}
    encoder = packing.Encoder()
    pieces = {}
    for x in P.run(spark, str(tmp_path)).collect():
        pieces.setdefault(x["doc_id"], []).append(x)
    assert pieces.keys() == want[3]
    for i, found in pieces.items():
        ids = [*encoder.ids(texts[i]), 0]
        assert sum(x["length"] for x in found) == len(ids) == found[0]["doc_tokens"]
        for x in found:
            part = b"".join(t.to_bytes(4, "little") for t in ids[x["start"] : x["start"] + x["length"]])
            assert x["ids_crc32"] == zlib.crc32(part)


def test_stage_names_and_empty_tables(spark, tmp_path):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "language_id", "exact_dedup", "minhash_dedup", "packing"]
    write(spark, tmp_path, [])
    assert P.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Null identifiers, repeated rows, and columns named like those that the operators make: kept as they are, no crash."""
    r = random.Random(5)
    long, other = good(r), good(r)
    rows = [(i, good(r), "en") for i in range(60)] + [(None, long, "en"), (None, long, "en"), (None, other, None), (70, long, "en"), (71, long + " ", None), (71, long + " ", None), (72, None, "en"), (73, "", None), (74, other * 200, "en")]
    names = ["row", "comp", "n", "kept_id", "k", "f1", "quality", "kept", "text_", "keep_id", "rejected"]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", *(f"{k} AS `{c}`" for k, c in enumerate(names)))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for k, (_, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert all(tuple(x)[3:] == tuple(range(len(names))) for x in docs.collect())
    kept = [(x["doc_id"], x["text"]) for x in docs.collect()]
    assert {i for i, _ in kept} >= set(range(60)) and not {72, 73} & {i for i, _ in kept}
    assert sum(" ".join(t.split()) == long for _, t in kept) == 1
    pieces = P.run(spark, str(tmp_path))
    assert sum(x["n"] for x in pieces.where("start = 0").groupBy("doc_id").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()) == len(kept)
