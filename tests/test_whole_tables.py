"""Queries hold their inputs against whole tables; small tables and brute force."""

import __spark_entry__ as entry


def save(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def test_quotes_of_all_documents(spark, tmp_path):
    texts = {
        5: "Nothing that anyone would quote stands here.",
        250: "It was said that every student may remain for as long as study lasts. More.",
        900: "Xx antidisestablishmentarianismus yy and pre-institutionalisationally speaking softly now.",
        901: "An   over-institutionalisationally &amp; speaking softly   nowhere kept text.",
    }
    quotes = [
        (1, "every student may remain for as long as study lasts."),
        (2, "disestablishmentarianismu"),  # one word, inside a longer one
        (3, "institutionalisationally speaking softly now"),
        (4, "nstitutionalisationally & speaking softly now"),  # an entity and white space as read
        (5, "no document holds these words in this order"),
        (6, "too short"),
        (7, "institutionalisationally speaking"),
    ]
    save(spark, tmp_path, "documents", list(texts.items()), "doc_id long, text string")
    save(spark, tmp_path, "benchmark", quotes, "item_id long, text string")
    got = {r.item_id: (r.source, r.kept) for r in entry.queries()["quote_sentence_match"](spark, str(tmp_path)).collect()}
    assert got == {1: (250, True), 2: (900, True), 3: (900, True), 4: (901, True), 5: (-1, False), 6: (-1, False), 7: (900, True)}


def test_editions_by_whole_paragraphs(spark, tmp_path):
    head = "The same forty characters open both texts"
    rows = [(2, "en", f"{head}, old"), (3, "en", f"{head}, new"), (4, "en", "kept"), (5, "en", "kept"), (7, "de", "kept")]
    save(spark, tmp_path, "documents", rows, "doc_id long, lang string, text string")
    got = {tuple(r) for r in entry.queries()["edition_diff_whole"](spark, str(tmp_path)).collect()}
    assert got == {("en", f"{head}, new"), ("de", "kept")}


def test_claims_against_all_documents(spark, tmp_path):
    save(spark, tmp_path, "benchmark", [(1, "students need authorization before working"), (2, "zebra quagga okapi"), (3, "it is")], "item_id long, text string")
    rows = [(1, "Nothing here."), (700, "Other. Students need authorization before any working."), (700, "Students need authorization before any working."), (800, "One zebra.")]
    save(spark, tmp_path, "documents", rows, "doc_id long, text string")
    got = {r.claim: (r.ratio, r.flagged) for r in entry.queries()["word_overlap_support_all"](spark, str(tmp_path)).collect()}
    assert got == {1: (1.0, False), 2: (0.333333, True), 3: (1.0, False)}


def test_ranking_of_empty_tables(spark, tmp_path):
    for name in ("documents", "embeddings", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("dense_topk", "dense_topk_by_label", "relevance_gate", "rrf_hybrid", "usable_limit", "concat_shards"):
        assert entry.queries()[name](spark, str(tmp_path)).count() == 0


def test_shards_keep_documents_without_language(spark, tmp_path):
    rows = [(1, "a text", "en", "s1"), (2, "more", None, "s2")]
    save(spark, tmp_path, "documents", rows, "doc_id long, text string, lang string, source string")
    got = {tuple(r) for r in entry.queries()["concat_shards"](spark, str(tmp_path)).collect()}
    assert got == {("d:1", "en", 2, "s1", 6), ("d:2", None, 2, "s2", 4)}
