"""Short lines meet by one edit as long ones do."""

from bindery.llm import lines


def cleaned(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return [r.text for r in sorted(lines.drop_repeated_lines(docs, **options).collect())]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_short_lines_against_every_pair(spark):
    pool = ["a", "b", "ab", "abc", "abd", "xbc", "bc", "", "wxyz", "wxz", "wxyzz", "Accept cookies!", "Accept cookies.",
            "Accept cookie.", "q" * 7, "q" * 8, "q" * 9, "漢", "漢字", "one two", "one tvo", "o e two", "three"]
    texts = ["\n".join(pool[(i * 5 + k * 7) % len(pool)] for k in range(4)) for i in range(23)]
    order = {}
    for i, t in enumerate(texts):
        for k, line in enumerate(t.split("\n")):
            order.setdefault(line, (i, k))
    want = []
    for i, t in enumerate(texts):
        stay = []
        for k, line in enumerate(t.split("\n")):
            near = any(o < order[line] and edits(line, other) <= 1 for other, o in order.items() if other)
            if not line or (order[line] == (i, k) and not near):
                stay.append(line)
        want.append("\n".join(stay))
    assert cleaned(spark, texts) == want


def test_a_floor_can_be_asked_for(spark):
    texts = ["Accept cookies!", "Accept cookies.", "Accept all of the cookies!", "Accept all of the cookies."]
    assert cleaned(spark, texts) == [texts[0], "", texts[2], ""]
    assert cleaned(spark, texts, near_chars=20) == [texts[0], texts[1], texts[2], ""]
