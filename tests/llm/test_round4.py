"""The n-gram join fetches the texts it needs by key."""

from pyspark.sql import functions as F

from demandlens.llm import ngram_join


def test_texts_not_asked_for_are_held_back_before_the_shuffle(spark):
    rows = spark.range(20_000).select((F.col("id") - 5_000).alias("did"), F.xxhash64(F.col("id") % 7).alias("tx"),
                                      F.concat(F.lit("text "), "id").alias("text"))
    rows = rows.union(rows.filter("did % 40 = 0"))                  # some rows come twice
    used = rows.filter("did % 20 = 0").select("did", "tx").distinct()
    got = ngram_join.asked_for(rows, used)
    assert got.columns == rows.columns
    count = {r["did"]: r["count"] for r in got.groupBy("did").count().collect()}
    assert all(count[d] == 1 + (d % 40 == 0) for d in range(-5_000, 15_000, 20))        # none lost, none twice
    assert len(count) < 1_000 + 0.06 * 19_000
    assert ngram_join.asked_for(rows, used.limit(0)).count() == 0


def test_more_keys_than_marks_lose_no_text(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "MOST_MARKS", 64)
    rows = spark.range(3_000).select(F.col("id").alias("did"), F.xxhash64("id").alias("tx"), F.lit("t").alias("text"))
    used = rows.filter("did % 3 = 0").select("did", "tx")
    assert ngram_join.asked_for(rows, used).join(used, ["did", "tx"], "left_semi").count() == 1_000


def test_the_texts_of_a_few_sets_are_fetched_without_shuffling_all(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), "id") for k in range(8)]).alias("text"))
    docs = docs.union(docs.filter("doc_id < 20")).union(docs.filter("doc_id = 7").select(F.lit(None).cast("long"), "text"))
    join = ngram_join.ParityJoin(docs)
    seen, original = [], ngram_join.asked_for

    def watched(rows, used):
        out = original(rows, used)
        seen.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "asked_for", watched)
    some = join.sets.filter("doc_id in (7, 8, 300)").select("sid")
    texts = {r["text"] for r in join.texts_of(some).collect()}
    assert texts == {r["text"] for r in docs.filter("doc_id in (7, 8, 300)").collect()}
    assert seen and 5 <= seen[0] < 60                               # of 421 rows
