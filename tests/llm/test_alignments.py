"""Items with words put in, and items of numbers and names."""

import pytest

from graftwork.llm import decontaminate

WORDS = "take every second stone from the small heap beside the old wall and put them into that large basket until nobody finds any more stones lying there on dry ground"
DENSE = "Rations: 12 kg, 7 days, 93 miles, 41 hours, 8 tons, 66 cents, 25 years, 3 weeks"


@pytest.fixture(scope="module")
def found(spark):
    w = WORDS.split()
    edited = " ".join([*w[:10], "quite", *w[10:20], "really", *w[20:]])
    docs = [(1, f"before it {edited} after it"), (2, f"so we note. {DENSE}. That was all"), (3, DENSE.replace("93", "12").replace("66", "25")), (4, "nothing of them here at all, only other words that nobody asked for")]
    items = spark.createDataFrame([(1, WORDS), (2, DENSE)], "item_id LONG, text STRING")
    assert len(w) == 30
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id LONG, text STRING"), items).collect()}


def test_cover_adds_up_over_shifts(found):
    assert found[1, 1].covered == 1.0 and found[1, 1].reparameterised == 0


def test_exact_copies_of_numbers_are_found(found):
    assert found[2, 2].covered == 1.0 and (3, 2) not in found and not any(d == 4 for d, _ in found)


def test_names_beside_characters_of_other_lengths(spark):
    """A character whose lower case has another length in bytes changes nothing for the rows beside it."""
    import pyarrow as pa

    numbers, units = decontaminate._set(decontaminate.NUMBERS), decontaminate._set(decontaminate.UNITS)
    text = "A train leaves Boston at 60 miles per hour and meets Anna"
    alone = decontaminate.Templates(pa.array([text]), numbers, units)
    for other in ("\u0130stanbul lies by \u0130zmir", "STRA\u1e9eE", "300 \u212a"):
        beside = decontaminate.Templates(pa.array([other, text]), numbers, units)
        assert beside.kind[beside.first[1] :].tolist() == alone.kind.tolist() and beside.value[beside.first[1] :].tolist() == alone.value.tolist()
    assert (alone.kind == decontaminate.NAME).sum() == 2
    odd = decontaminate.Templates(pa.array(["we saw \u0130stanbul today"]), numbers, units)
    assert odd.kind.tolist() == [0, 0, decontaminate.NAME, 0]


def test_short_items(spark):
    items = spark.createDataFrame([(1, "Compute 17 * 23 - 45 + 9 now"), (2, "Paris lies on the river Seine"), (3, "Yes")], "item_id LONG, text STRING")
    docs = [(1, "please compute 17 * 23 - 45 + 9 now or never"), (2, "please compute 18 * 23 - 45 + 9 now or never"), (3, "they say that Paris lies on the river Seine and so on"), (4, "yes, that is so")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id LONG, text STRING"), items).collect()}
    assert {(1, 1), (3, 2)} == got
