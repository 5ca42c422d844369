"""Every query with a DuckDB counterpart gives the same rows, and not none."""

import math
import os

import duckdb
import pandas as pd
import pytest

from proselens.plans import catalog

SF = "/root/testdata/sf0.001"
EMPTY = {"struct_density"}  # too few findings a word at this size
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def rows(df):
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(v, 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return c


def test_all_have_counterparts():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    a, b = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
    assert len(a) or name in EMPTY


def test_html_visible_text_on_odd_pages(spark, tmp_path):
    pages = [None, "", "<title>a&amp;&amp</title>b&quot", "&am &copy &AMP; &lt;p&gt; &#39; &nbsp;", "&amp;lt; &amp;amp; &amp;quot; &&quot;amp; &a<b>mp;", "<SCRIPT>a\nb</script >c</Script>d<ſtyle>e</STYLE>f",
             "<script>a</style>b<style>c</script></style>d", "<script", "<a\r\nb>\u2028<>é\U0001f600<i title='>'>\t&middot;", "<style>\U0001f600\n</style>&copy;&middot;&copy;"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = rows(QUERIES["html_visible_text"](spark, str(tmp_path)).toPandas())
    assert got == rows(c.sql(ORACLES["html_visible_text"]).df())
    assert dict(got)[2].split() == ["a&&amp", "b&quot"]
