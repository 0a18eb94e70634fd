import os

from terrahac.llm import common, warc


def test_tidy_leaves_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a/", "x" * 2000), (2, None, "x" * 2000)], "page_id long, url string, html string")
    first = common.table(pages, "kept")
    assert warc.round_trip(pages).count() == 2 and first.count() == 2
    common.drop_table(common.table(pages, "dropped"))
    made = set(common._MADE[spark.sparkContext.applicationId])
    names = {p.rpartition("/")[2].rpartition("-")[0] for p in made}
    assert {"kept", "copies", "warc"} <= names and "dropped" not in names
    common.tidy(spark)
    assert not common._MADE[spark.sparkContext.applicationId]
    assert not any(os.path.exists(p.removeprefix("file:")) for p in made)
