import duckdb
import pytest
from oracle import connect, same

from knowmill import catalog

Q, S = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(S))
def test_query_equals_its_sql(spark, sf, con, name):
    same(spark, con, sf, Q[name], S[name])


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_query_without_sql_runs(spark, sf, name):
    assert Q[name](spark, sf).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_pairs_of_parts_do_not_hang_on_sizes(spark, tmp_path):
    """Parts of one brand and type are paired whatever their sizes, and without one."""
    rows = "(1, 'a', 'x', 1), (2, 'a', 'x', 2), (3, 'a', 'x', null), (4, 'a', 'y', 1), (5, 'b', 'x', 1), (6, null, 'x', 1), (7, null, 'x', 1), (8, 'a', null, 1), (9, 'a', null, 1), (null, 'a', 'x', 1)"
    duckdb.sql(f"copy (select p_partkey::bigint as p_partkey, p_brand, p_type, p_size from (values {rows}) t(p_partkey, p_brand, p_type, p_size)) to '{tmp_path}/part.parquet'")
    assert sorted(tuple(r) for r in Q["duplicate_diagram_pairs"](spark, str(tmp_path)).collect()) == [(1, 2), (1, 3), (2, 3)]
    same(spark, connect(str(tmp_path)), str(tmp_path), Q["duplicate_diagram_pairs"], S["duplicate_diagram_pairs"])


def test_texts_with_numbers_are_sanitized(spark, tmp_path):
    """No row is left out for a number in its text; what the SQL takes for a hash goes."""
    texts = ["call 1234567 now", "123456 stays", "1" * 40 + " " + "2" * 41, "x1234567 1234567x é7654321, deadbee 0000001", "a 12345678\nfixed by 1234567\nb", "#12345678 12345678_ 1234-5678901", "plain", "", None]
    want = ["call [sha-removed] now", "123456 stays", "[sha-removed] " + "2" * 41, "x1234567 1234567x é[sha-removed], [sha-removed] [sha-removed]", "a [sha-removed]\n[line-removed]\nb", "#[sha-removed] 12345678_ 1234-[sha-removed]", "plain", "", ""]
    con = duckdb.connect()
    con.execute("create table c (conv_id bigint, turn int, role varchar, text varchar)")
    con.executemany("insert into c values (?, 0, 'user', ?)", list(enumerate(texts)))
    con.sql(f"copy c to '{tmp_path}/conversations.parquet'")
    got = {r.conv_id: r.text for r in Q["sanitize_text"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want))
    same(spark, connect(str(tmp_path)), str(tmp_path), Q["sanitize_text"], S["sanitize_text"])
