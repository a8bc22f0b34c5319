"""The registered queries: names, columns of the contracts, SQL where there is some."""

import duckdb
import pytest

from replenish.llm.queries import ORACLE_SQL, QUERIES

COLUMNS = {
    "op1_suffix_dedup": ["doc_id", "first_word", "end_word", "n_words", "other_doc"],
    "op2_minhash_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op3_html_text": ["page_id", "url", "text"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score", "rejected"],
    "op5_nearest": ["query_id", "rank", "vec_id", "score"],
    "op6_source_mix": ["doc_id", "size", "source_size", "target", "taken"],
    "op7_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op8_secret_scan": ["doc_id", "start", "end", "kind", "score"],
    "op9_decontaminate": ["doc_id", "item_id", "edits", "n_words", "first_word", "end_word"],
    "op10_token_count": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    "op11_periodic_runs": ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"],
    "op12_filter_audit": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    "op13_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
}


def test_every_operator_has_its_query():
    import __spark_entry__ as entry

    assert set(QUERIES) == set(COLUMNS)
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, sf0001, sf001, name):
    df = QUERIES[name](spark, sf001 if name == "op8_secret_scan" else sf0001)  # the smallest table holds no secret
    assert df.columns == COLUMNS[name]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf001, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf001}/{t}.parquet')")
    keys = {"op12_filter_audit": ["part", "filter_order", "step"], "op13_warc": ["page_id"]}.get(name, ["doc_id"])
    want = con.sql(ORACLE_SQL[name]).df().sort_values(keys, ignore_index=True)
    got = QUERIES[name](spark, sf001).toPandas().sort_values(keys, ignore_index=True)
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want) and all(((got[c] == want[c]) | (got[c].isna() & want[c].isna())).all() for c in got.columns)
