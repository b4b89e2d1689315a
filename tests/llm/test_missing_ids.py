"""Near duplicates among rows of which some have no id."""

from wardspan.llm import jaccard_join
from wardspan.llm.shingle_sets import fingerprint, shingles


def test_row_without_id_hides_no_link(spark):
    """Near copies stay linked if the smallest fingerprint is that of a row without id."""
    smallest = lambda t: fingerprint(shingles(t, 3))
    for k in range(100):
        base = [f"w{k}x{i}" for i in range(80)]
        middle, left, right = " ".join(base), " ".join(["other", *base[1:]]), " ".join([*base[:-1], "other"])
        if smallest(middle) < min(smallest(left), smallest(right)):
            break
    df = spark.createDataFrame([(None, middle), (1, left), (2, right)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.grouped(df).collect()}
    assert got == {None: None, 1: 1, 2: 1}
