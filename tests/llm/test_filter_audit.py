"""The filter audit against applying the filters one after another."""

import re
from itertools import permutations

from bindery.llm import filteraudit
from bindery.llm.filteraudit import Diagram, failure_counts, filter_steps, swaps

SCHEMA = "doc_id long, text string, source string, lang string, mask int, `a.b` int, n int"
WORDS = [f"word{i}" for i in range(260)]
LONG = " ".join(WORDS)
TEXTS = [
    None, "", " \n", LONG, LONG + " # ", "Same " * 300, LONG.upper(), "A b c d", "a|b", LONG + "%", LONG.title(),
    LONG * 40, " ".join(WORDS[:100] * 2), " ".join(WORDS[:99] * 2 + ["x", "y"]), " ".join(WORDS[:199]), " ".join(WORDS[:200]),
]


def rows_of():
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}") for i, t in enumerate(TEXTS)]
    rows += [(100 + i, t, "s1") for i, t in enumerate(TEXTS)]
    rows += [(3, LONG, "s0"), (3, LONG, "s2"), (None, LONG, "s2"), (None, None, ""), (None, "fresh", None), (50, "", "")]
    return rows


def fails(rows):
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, part in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        mask = ""
        mask += "A" * (len(words) < 200)
        mask += "B" * (100 * len(set(words)) < 50 * len(words))
        mask += "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text))
        mask += "D" * bool(re.search(r"[#$%&*|]", text))
        mask += "E" * (i is not None and i > first[text])
        yield i, part or "", mask


def expected(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    parts, out = {}, []
    for i, part, mask in fails(rows):
        parts.setdefault(part, []).append((i, mask))
    for part, held in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in permutations("ABCDE"):
            left = held
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[f] += len(gone)
                steps.append(
                    ("".join(order), step, f, len(left), len(gone), sum(f in m for _, m in held) - len(gone),
                     sum(m == f for _, m in held), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
                )
        out += [(part, o, s, *counts, shapley[f]) for o, s, f, *counts in steps]
    return sorted(out)


def test_against_applying_the_filters(spark):
    rows = rows_of()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 120, 2)] + [(4, 1, 0), (None, 1, 1), (6, None, None), (7, 1, 1)]
    docs = spark.createDataFrame([(*r, "en", 1, 2, 3) for r in rows], SCHEMA).repartition(5)
    named = spark.createDataFrame([(*r, "z") for r in labels], "doc_id long, quality int, toxic int, text string")
    counts = failure_counts(docs, named)
    got = sorted(tuple(r) for r in filter_steps(counts, "ABCDE").collect())
    assert got == expected(rows, labels)
    assert len(got) == 600 * 4


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_steps(failure_counts(docs, labels), "ABCDE").count() == 0
    one = spark.createDataFrame([(1, None, None, None, 1, 1, 1)], SCHEMA)
    rows = filter_steps(failure_counts(one, labels), "ABCDE").collect()
    assert len(rows) == 600 and {r.part for r in rows} == {""}
    assert all(r.removed == (r.filter_order[r.step - 1] == "A") for r in rows)


def test_swaps_visit_every_order_once():
    for n in range(1, 7):
        order = list(range(n))
        seen = {tuple(order)}
        for level in swaps(n):
            order[level], order[level + 1] = order[level + 1], order[level]
            assert tuple(order) not in seen
            seen.add(tuple(order))
        assert len(seen) == len(list(permutations(range(n))))


def test_swapping_twice_gives_the_same_diagram():
    masks = {0: (5, 1, 0), 3: (2, 0, 1), 6: (1, 1, 1), 7: (4, 0, 0)}
    diagram = Diagram("ABC", masks)
    before = diagram.root
    diagram.swap(1)
    assert diagram.order == list("ACB") and diagram.root is not before
    diagram.swap(1)
    assert diagram.root is before and diagram.order == list("ABC")


def test_unreached_masks_share_their_nodes():
    diagram = Diagram("ABCDEFGHIJ", {0: (1, 0, 0), 1: (2, 0, 0)})
    assert len(diagram.unique) < 40  # of 2,047


def test_many_parts_are_spread(spark):
    counts = spark.range(500).selectExpr("concat('p', id) as part", "cast(id % 32 as int) as mask", "id as n", "1L as good", "0L as toxic")
    rows = filter_steps(counts.union(counts), "ABCDE")
    assert rows.count() == 500 * 600
    first = rows.where("part = 'p31' and filter_order = 'EDCBA' and step = 1").collect()
    assert [(r.kept, r.removed, r.unique_fails, r.good_lost) for r in first] == [(0, 62, 0, 2)]


def test_copies_fold_before_the_join(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "'copy' as text", "'hot' as source")
    labels = spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r["mask"]: (r.n, r.good) for r in failure_counts(docs, labels).collect()}
    assert found == {1: (1, 0), 17: (19_999, 1)}
