import pyarrow.parquet as pq

from tramline.llm import lexical


def test_a_row_group_of_the_index_has_few_blocks(spark):
    n = 64 * 40
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('word', id % 7) AS text").coalesce(1)
    index = lexical.written_index(docs, n, n)
    assert index.count() == 40
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.inputFiles()]
    assert max(m.row_group(i).num_rows for m in groups for i in range(m.num_row_groups)) <= 16
