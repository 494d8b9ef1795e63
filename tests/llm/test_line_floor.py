"""Line dedup offers one edit at most."""

import pytest

from bindery.llm import lines


@pytest.mark.parametrize("edits", [-1, 2])
def test_only_one_edit_is_offered(spark, edits):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        lines.drop_repeated_lines(docs, max_edits=edits)
