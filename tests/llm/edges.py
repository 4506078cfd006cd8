"""Tables that every operator must handle."""

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, n_hit string, spans string, kept string, fp string, "
    "component_id string, labels string, score string, importance string, ids string, lang_pred string, bucket string, _text string"
)


def documents(spark, rows):
    """Documents with columns that clash with the names of results; rows are (doc_id, text[, lang])."""
    filled = [(i, t, *(more or ("en",)), "src", len(t or ""), *["x"] * 12) for i, t, *more in rows]
    return spark.createDataFrame(filled, SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}
