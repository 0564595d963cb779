"""Tables that operators store on their way go when nothing reads them any more."""

import os

import pytest

from chainsurf.llm import decontaminate, near_duplicates, warc
from chainsurf.llm.shared import discard, scratch, shared_dir, stored

WORDS = "the harvest of winter apples began early because the frost came down from the hills before anyone had time to pick them".split()


def folders(spark) -> set[str]:
    root = shared_dir(spark).removeprefix("file://")
    return {x for x in os.listdir(root) if not x.startswith(".")}


def test_scratch_keeps_what_it_is_told_to(spark):
    before = folders(spark)
    with scratch(spark) as keep:
        stored(spark.range(3), "gone")
        with scratch(spark) as inner:
            kept, passed = inner(stored(spark.range(4), "inner")), inner(stored(spark.range(5), "passed"))
            stored(spark.range(6), "gone")
        assert passed.count() == 5
        keep(kept)
    assert len(folders(spark) - before) == 1 and kept.count() == 4
    discard(kept)
    assert folders(spark) == before


def test_a_failed_run_leaves_nothing(spark):
    before = folders(spark)
    with pytest.raises(ZeroDivisionError), scratch(spark) as keep:
        keep(stored(spark.range(3), "gone"))
        raise ZeroDivisionError
    assert folders(spark) == before


def test_operators_leave_only_what_their_result_reads(spark):
    texts = [" ".join(WORDS[i % 7:] + WORDS[: i % 5]) for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(WORDS[4:20]))], "item_id long, text string")
    pages = spark.createDataFrame([(i, f"http://a.b/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    for result, most in ((lambda: decontaminate.find(docs, items), 1), (lambda: near_duplicates.groups(docs), 3), (lambda: warc.round_trip(pages), 1)):
        before = folders(spark)
        rows = result()
        assert rows.count() and len(folders(spark) - before) <= most
