"""Single documents are read by the index, without their neighbours' frames."""

import public_tokenizers
from pyspark.sql import functions as F

from bindery.llm import tokenfiles

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_other_frames_are_not_expanded(spark, tmp_path):
    path, rows = f"file://{tmp_path}/ids", [(i % 40, f"text number {i} " * (i % 5)) for i in range(60)]
    rows.append((None, "no identifier"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    tokenfiles.write_token_files(docs.coalesce(1), path, WORDS)
    wanted = spark.createDataFrame([(3,), (3,), (39,), (77,), (None,)], "doc_id long")
    whole = tokenfiles.read_token_files(spark, path).where("doc_id in (3, 39)")
    expected = sorted(map(tuple, whole.collect()))
    assert len(expected) == 3
    assert sorted(map(tuple, tokenfiles.read_some(spark, path, wanted).collect())) == expected
    # Damage every frame but the wanted ones: a reader that expands them fails.
    blocks = spark.read.parquet(f"{path}/blocks")
    spoiled = F.expr(
        "array_join(transform(index, e -> if(e.doc_id in (3, 39), "
        "hex(substring(payload, cast(e.offset + 1 as int), cast(e.size as int))), repeat('00', cast(e.size as int)))), '')"
    )
    bad = f"file://{tmp_path}/bad"
    blocks.withColumn("payload", F.unhex(spoiled)).write.parquet(f"{bad}/blocks")
    spark.read.parquet(f"{path}/dictionary").write.parquet(f"{bad}/dictionary")
    assert sorted(map(tuple, tokenfiles.read_some(spark, bad, wanted).collect())) == expected
