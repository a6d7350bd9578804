"""Large ids stay exact beside null ones."""

from pyspark.sql import functions as F

from quern.llm.html_text import extract_text
from quern.llm.lang_id import identify
from quern.llm.lm_scoring import score_documents
from quern.llm.near_dedup import near_duplicates
from quern.llm.packing import pack_documents
from quern.llm.quality import score_quality
from quern.llm.transport_stream import read_media, store_media

BIG = 2**62 + 1


def test_ids(spark):
    docs = spark.createDataFrame([(BIG, "one two three", "en"), (None, "four five", "en"), (BIG + 2, "six", "de")], "doc_id long, text string, lang string").coalesce(1)
    labels = spark.createDataFrame([(BIG, 1), (None, 0)], "doc_id long, quality int")
    want = [None, BIG, BIG + 2]
    for out in (
        score_documents(docs, F.lit(False)), score_quality(docs, labels, F.lit(False)), read_media(store_media(docs)), pack_documents(docs), identify(docs, F.lit(False)), near_duplicates(docs),
        extract_text(docs, "doc_id", "text").withColumnRenamed("page_id", "doc_id"),
    ):
        assert sorted((r["doc_id"] for r in out.collect()), key=lambda x: x or 0) == want
