"""The pipeline's stages against their operators."""

import corpus_pipeline
from weftline.llm import mixing, quality_rules, simhash, substring

FOLDER = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_the_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], FOLDER).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(d.columns == columns for d in seen[:-1])
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    assert ids(seen[1]) == ids(quality_rules.score_documents(docs, labels).where("kept"))
    assert ids(seen[2]) == ids(simhash.report(seen[1]).where("doc_id = component_id"))
    removed = {r.doc_id: r.n_words - r.n_removed for r in substring.report(seen[2]).collect()}
    assert {r.doc_id: len(r.text.encode().split()) for r in seen[3].collect()} == removed
    copies = {r.doc_id: r.copies if r["size"] else 1 for r in mixing.report(seen[3]).collect()}
    assert ids(seen[4]) == sorted(d for d, n in copies.items() for _ in range(n))
    assert seen[5].count() == seen[4].count()
    assert corpus_pipeline.run(spark, FOLDER).count() == seen[5].count()


def test_stages_take_nulls_repeats_odd_columns_and_empty_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, columns named like the operators' own, and no rows at all."""
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(k, f"{text} tail{k} " * (k % 3 + 1), "en", ("a", "b", None)[k % 3], k) for k in range(12)]
    rows += [(None, text + " end", None, None, None), (20, None, "en", "a", 0), (21, "", "en", "b", 0), (22, "same again " * 20_000, "en", "a", 9), rows[0], rows[0]]
    names = ["key", "row", "fp", "h", "d", "variant", "size", "runs", "doc", "bucket", "copies", "root", "__text"]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = made.selectExpr("*", *[f"concat('{n}', doc_id) AS `{n}`" for n in names])
    for number, start in enumerate((docs, docs.limit(0))):
        seen = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, seen, FOLDER).write.parquet(f"{tmp_path}/{number}-{k}")
            new = spark.read.parquet(f"{tmp_path}/{number}-{k}")
            if k < 4:
                assert new.columns == docs.columns
                assert new.where("doc_id IS NOT NULL AND h <> concat('h', doc_id)").isEmpty()
            seen = new
        assert seen.columns[0] == "doc_id" and (number == 0 or seen.isEmpty())
