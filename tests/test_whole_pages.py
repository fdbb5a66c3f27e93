"""Verdicts of links read pages to their end."""

import duckdb
import pytest

from snarewatch.operators import pages as P
from snarewatch.plans import registry


def one_page(folder, html: str) -> str:
    """Input with page 14, to which its view adds what it poses as."""
    duckdb.sql(f"copy (select 14::bigint as page_id, 'https://www.faceb00k.com/p/14' as url, '{html}' as html) to '{folder}/pages.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["link_verdict_degraded", "link_verdict_full"])
def test_a_page_poses_by_its_whole_text(spark, tmp_path, name):
    said = []
    for html in ("", f'<p class="{"x" * P.MAX_HTML}"></p>'):
        folder = tmp_path / str(len(html))
        folder.mkdir()
        found = registry.queries()[name](spark, one_page(folder, html))
        said.append([tuple(r) for r in found.collect()])
        with duckdb.connect() as db:
            db.execute(f"create view pages as select * from '{folder}/pages.parquet'")
            assert said[-1] == db.execute(f"select {', '.join(found.columns)} from ({registry.oracle_sql()[name]})").fetchall()
    assert said[0] == said[1]
