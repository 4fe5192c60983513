"""The pipeline, stage by stage, against the operators' own brute-force versions."""

from test_corpus import HOSTILE, frame
from test_near_dup import brute

import corpus_pipeline as pipeline
from tabscale.llm import decontaminate, mixing, shards
from tabscale.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = table(spark, SF, "documents")
    items = [(r["item_id"], decontaminate.normalise(r["text"])) for r in table(spark, SF, "benchmark").collect()]
    steps = [docs]
    for name, stage in pipeline.STAGES:
        out = stored(stage(spark, steps[-1], SF), name)
        if name != "token_shards":
            assert out.columns == docs.columns
        steps.append(out)
    rows = [{r["doc_id"]: r["text"] for r in s.collect()} for s in steps[:5]]
    assert set(rows[1]) == set(rows[0])  # all of these are clean prose with letters
    assert set(rows[2]) == {i for i, _, _, kept in brute(list(rows[1].items())) if kept}
    block = decontaminate.Block(items)
    assert set(rows[3]) == {i for i, t in rows[2].items() if not list(block.hits(decontaminate.normalise(t)))}
    decided = mixing.mix(steps[3]).collect()
    assert set(rows[4]) == {r["doc_id"] for r in decided if r["kept"]}
    last = steps[5].collect()
    encode = shards.tokens(shards.RANKS).encoding.encode_ordinary
    assert sorted(r["slot"] for r in last) == list(range(len(last)))
    for i, t in rows[4].items():
        assert sum(r["n_tokens"] for r in last if r["doc_id"] == i) == len(encode(t)) + 1
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, last))


def test_stages_take_hostile_and_empty_tables(spark):
    docs = stored(frame(spark, [*HOSTILE, *[(500 + i, f"the cat sat on mat number {i}", "en", "a") for i in range(60)]]), "hostile")
    for table_in in (docs, stored(docs.limit(0), "empty")):
        current = table_in
        for name, stage in pipeline.STAGES:
            current = stored(stage(spark, current, SF), name)
            if table_in is not docs:
                assert current.count() == 0


def test_rejected_documents_go(spark):
    out = {r["doc_id"] for r in pipeline.language(spark, stored(frame(spark, HOSTILE), "hostile"), SF).collect()}
    assert not out & {2, 3, 4, 5}


def test_columns_named_like_predictions_keep_their_values(spark):
    from pyspark.sql import functions as F

    docs = stored(table(spark, SF, "documents").select(
        "*", F.concat(F.lit("quality-"), F.col("doc_id")).alias("score"), F.lit(7).alias("lang_pred"), F.col("doc_id").alias("Rejected"),
        F.lit("x").alias("_own_5")), "clashing")
    out = pipeline.language(spark, docs, SF)
    assert out.schema == docs.schema and out.count() > 150
    assert out.where("score <> concat('quality-', doc_id) OR lang_pred <> 7 OR Rejected <> doc_id OR _own_5 <> 'x'").count() == 0
