"""Judgements of odd rows, against the SQL in DuckDB."""

import duckdb

from adsentry.queries import ORACLE_SQL, QUERIES


def test_judgements_of_odd_rows(spark, tmp_path):
    """Empty texts have no share of capitals; blanks of other scripts, and rows without a language or a source."""
    texts = ["", None, " ", "\t\t\t\t\tAb", "\n\n\n\n\n", "\xa0\xa0\xa0\xa0\xa0 Hallo Welt", "     ", "　　　　　x", "12345", "ABC", "--a--B--", "ÄÖÜ straße", "😀😀 Xy", "w" * 200 + " zwei"]
    rows = [(i, t, "de", "forum") for i, t in enumerate(texts)]
    rows += [(20, "Hallo Welt", None, "forum"), (21, "Hallo Welt", "de", None), (22, "Hallo Welt", "", ""), (23, "", None, None), (24, None, None, None), (25, "12345", None, "forum"), (26, "     ab", "de", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = dict((k, (line, w)) for k, line, w in con.execute(ORACLE_SQL["txt37_judgement_signals"]).fetchall())
    got = {r.doc_id: (r.line, r.weight) for r in QUERIES["txt37_judgement_signals"](spark, str(tmp_path)).collect()}
    assert got == want and got[0] == ("", 0.0) and len(got) == len(rows)
