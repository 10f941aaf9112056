"""Every registered query of the core against its SQL on the smallest tables."""

import pytest
from conftest import DATA, rows_of, rows_of_sql

from lectern.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, DATA)) == rows_of_sql(duck, SQL[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_windows_target_every_line_once(spark):
    from pyspark.sql import functions as F

    from lectern.plans.views import chained

    planned = QUERIES["chunk_windows"](spark, DATA).agg(F.sum("n_targets")).first()[0]
    assert planned == chained(spark, DATA).count()


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similarity_of_all_lines(spark, tmp_path):
    texts = ["été à la mer\nete a la mer\n\n\U0001d538 naïve Straße", "Äpfel über Öl\nApfel uber Ol\nplain\nplane", "seul"]
    docs = spark.createDataFrame([(i, t, "fr", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["line_id"]: r for r in QUERIES["scan_lines"](spark, str(tmp_path)).collect()}
    after = {(r["page_id"], r["ord"]): r["text"] for r in rows.values()}
    got = {r["line_id"]: r["similarity"] for r in QUERIES["char_similarity"](spark, str(tmp_path)).collect()}
    assert got.keys() == rows.keys()
    for i, r in rows.items():
        a, b = r["text"], after.get((r["page_id"], r["ord"] + 1))
        want = None if b is None else 1.0 - plain_distance(a, b) / max(len(a), len(b)) if a or b else 1.0
        assert got[i] == (want if want is None else pytest.approx(want))
    assert sum(v is not None and not r["text"].isascii() for v, r in ((got[i], rows[i]) for i in rows)) >= 2
