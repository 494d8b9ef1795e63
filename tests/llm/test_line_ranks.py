"""Line dedup among rows without identifier."""

from bindery.llm import lines


def test_shared_header_of_null_identifiers_stays_once(spark):
    header = "a header line that all of them share"
    rows = [(None, f"{header}\nown text {c * 9}") for c in "abcd"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    texts = [r.text for r in lines.drop_repeated_lines(docs).collect()]
    assert sum(header in t for t in texts) == 1
    assert sorted(t.split("\n")[-1] for t in texts) == sorted(t.split("\n")[-1] for _, t in rows)
    near = [(None, f"{header}{c}\n{c * 5}") for c in "abcd"]
    got = lines.drop_repeated_lines(spark.createDataFrame(near, "doc_id long, text string")).collect()
    assert sum(header in r.text for r in got) == 1
