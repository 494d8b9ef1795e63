"""One row of each near-duplicate group stays, whatever the identifiers."""

from collections import Counter

from bindery.llm import vptrees


def test_one_row_of_a_group_stays(spark):
    texts = {c: f"{c} text of group {c * 3} and nothing else {c * 7}" for c in "abcd"}
    rows = [
        (1, texts["a"]), (None, texts["a"]), (2, texts["a"]),
        (None, texts["b"]), (None, texts["b"]),  # null identifiers alone
        (0, texts["c"]), (5, texts["c"]), (5, texts["d"]), (5, texts["d"]),  # 5 is least in d only
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = vptrees.keep_first(docs)
    assert kept.columns == docs.columns
    expected = [(1, texts["a"]), (None, texts["b"]), (0, texts["c"]), (5, texts["d"])]
    assert Counter(map(tuple, kept.collect())) == Counter(expected)
