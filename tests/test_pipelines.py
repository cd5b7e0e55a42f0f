import json

from pyspark.sql import functions as F

from weftline import schemas
from weftline.plans import discovery, pipelines


def test_run(spark, small):
    texts = spark.createDataFrame([("s1", "s1.txt", "一段落。\n\n" + "Long sentence here. " * 300), ("s2", "s2.txt", "short")], "source_id string, source_file string, text string")
    chunks = pipelines.ingest(texts).orderBy("chunk_index").collect()
    assert {r.source_id for r in chunks} == {"s1"} and [r.chunk_index for r in chunks] == list(range(len(chunks)))
    con = discovery.concepts(spark, small)
    old = con.where("id < 'SCS-00000100'").select(*[F.col("id" if c == "concept_id" else c).alias(c) for c in schemas.CONCEPT_FIELDS])
    new = con.where("id >= 'SCS-00000090'").withColumn("ord", F.col("id")).drop("concept_id", "id")
    merged, relations = pipelines.update_concepts(old, new)
    ids = [r.concept_id for r in merged.select("concept_id").collect()]
    assert len(ids) == len(set(ids)) and None not in ids
    assert relations.where("source = target").count() == 0
    pred = pipelines.predict(con, "id")
    assert pred.count() == con.count() and pred.where("size(labels) = 0 OR dominant_axis IS NULL").count() == 0
    examples = pipelines.condition_examples(discovery.condition_recommend(spark, small)).collect()
    assert 1 <= len(examples) <= 3 and all("recommended" in json.loads(r.output) and len(json.loads(r.input)) == 5 for r in examples)
    edges = discovery.edges(spark, small)
    new_edges = pipelines.infer_hierarchy(con, discovery.candidate_pairs(spark, small).where("cos IS NOT NULL"), edges, "id")
    assert new_edges.where("source = target").count() == 0
    gaps, hypotheses = pipelines.discover(con, edges, id_col="id")
    assert gaps.count() == 50 and hypotheses.count() == 20 and gaps.groupBy("b").count().agg(F.max("count")).first()[0] <= 5
    order = discovery.merge_order(spark, small).withColumn("confidence", F.lit("high"))
    plan, after, redirected = pipelines.merge_duplicates(con, edges.select("source", "target", "type"), order)
    gone = {r.id for r in con.select("id").collect()} - {r.id for r in after.select("id").collect()}
    assert plan.count() and gone and redirected.where(F.col("source").isin(*gone) | F.col("target").isin(*gone)).count() == 0
