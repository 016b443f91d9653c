"""Small tables for the edge cases that every operator handles."""

#: Columns that the operators must not trip over.
EXTRA = ", text string, lang string, source string, n_chars bigint, n_words string, kept string, keep_id string, id string, h64 string, rate string, p string, host string"


def documents(spark, texts, sources=None, ids=None):
    """documents with extra columns whose names operators use themselves."""
    rows = [
        ((i if ids is None else ids[i]), t, "en", (sources[i] if sources else f"s{i % 2}"), len(t or ""), "x", "x", "x", "x", "x", "x", "x", "x") for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, "doc_id bigint" + EXTRA)


PROSE = "the quick brown fox jumps over the lazy dog while many other animals look on from the edge of a wide green field near an old stone bridge that crosses the slow river at noon"
EDGES = [PROSE, PROSE, None, "", " \n\t ", "one", "x" * 70_000, "naïve café — 東京 ١٢٣", PROSE + " again", None]
