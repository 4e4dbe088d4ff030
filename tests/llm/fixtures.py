"""Small document tables with the awkward cases: nulls, empty and very long texts, repeated rows, clashing columns."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, key string, shard string, words string"
LONG = "the quick brown fox jumps over the lazy dog number " * 3000


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src0", len(t or ""), "x", "x", "x", "x") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOC_SCHEMA)


def awkward(spark):
    texts = [None, "", "a", "Hello there, it's 42 degrees!\n\n  ok", "ЖЖ Привет 世界 İstanbul ½", LONG, "same text", "same text", "same text", "\x00\x1f \x85\xa0 end", "<|endoftext|> in text"]
    return documents(spark, [*texts, "same text", "nobody's"], [*range(len(texts)), 8, None])
