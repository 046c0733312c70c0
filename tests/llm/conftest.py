import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, _text string, lang_pred string, block long"
EN = "the quick brown fox jumps over a lazy dog while rain falls on old stone roads near town".split()
DE = "der schnelle braune fuchs springt über den faulen hund während regen auf straßen fällt".split()


def prose(rnd, words, n):
    return " ".join(rnd.choice(words) for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text, lang): prose in two languages, copies, near copies, junk, nulls, empty, one long text, repeated rows."""
    rnd = random.Random(11)
    rows = [(i, prose(rnd, EN if i % 2 else DE, rnd.randint(3, 80)), "en" if i % 2 else "de") for i in range(120)]
    rows += [(200 + i, rows[3][1], "en") for i in range(25)]
    rows += [(300 + i, rows[5][1] + (" more" if i % 2 else "!"), None) for i in range(8)]
    rows += [(400, None, "en"), (401, "", "de"), (402, " \t\n", None), (403, "12 %% 34", "en"), (404, "a", "en"), (405, "\u3000目的 \x1c ok  two\n\n  x", "de")]
    rows += [(406, prose(rnd, EN, 30_000), "en"), (None, "no id here at all", "en"), (407, "again", "en"), (407, "again", "en"), (407, "other text, same id", "de")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('docs')}/documents.parquet"
    spark.createDataFrame([(i, t, g, "s", len(t or ""), 0.5, "clash", "xx", 1) for i, t, g in texts], SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
