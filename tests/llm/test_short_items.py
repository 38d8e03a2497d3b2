"""Benchmark items without template windows are found verbatim."""

from tessera.llm import decontaminate


def test_short_numeric_and_unspaced_items(spark):
    items = ["Compute 12 + 45 - 3 * 7", "日本の首都はどこですか", "Who wrote Emma?", "ประเทศไทย", "...", ""]
    docs = ["so compute 12 + 45 - 3 * 7 now", "compute 12 + 45 - 3 * 8", "問:日本の首都はどこですか?答", "日本の首都", "and who wrote emma? x", "who wrote", "ในประเทศไทยมี", "", None]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    table = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontaminate.contaminated(table, bench).collect()}
    assert got == {(0, 0, "exact"), (2, 1, "exact"), (4, 2, "exact"), (6, 3, "exact")}
