"""Queries against DuckDB on the smallest tables, causality, and the entry contract without the document operators."""

import glob
import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as contract
from ruleloom.plans import catalog
from ruleloom.plans.views import Views

TABLES = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parent.parent

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(df):
    df = df[sorted(df.columns)]
    cell = lambda x: "" if x is None or x is pd.NA or x != x else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x)
    return sorted(tuple(map(cell, r)) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def results(spark):
    """All queries, a few at a time."""
    with ThreadPoolExecutor(6) as pool:
        yield {name: pool.submit(lambda q: q(spark, TABLES).toPandas(), q) for name, q in sorted(catalog.QUERIES.items())}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(results, duck, name):
    got = results[name].result()
    if name not in catalog.ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_future_rows_change_no_history(spark, tmp_path):
    """Cutting the log after a date leaves all features before it as they were."""
    for t in ("lineitem", "part"):
        os.symlink(f"{TABLES}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{TABLES}/orders.parquet").where("o_orderdate < '1996-01-01'").write.parquet(str(tmp_path / "orders.parquet"))
    whole, cut = Views(spark, TABLES).histories(), Views(spark, str(tmp_path)).histories()
    before = whole.where("ts < '1996-01-01'")
    assert before.count() == cut.count() > 0 and before.exceptAll(cut).count() == 0


def test_entry_runs(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_without_the_document_operators(tmp_path):
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("ruleloom.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "pipeline" not in e.queries() and not any(q.startswith("op") for q in e.queries()) and len(e.queries()) > 100 and e.oracle_sql()
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, timeout=120).returncode == 0


def test_unicode_tokens_of_all_documents_match_brute_force(spark, duck):
    import math
    import re
    import unicodedata
    from collections import Counter

    from ruleloom.functions import text

    texts = duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    fold = lambda x: unicodedata.normalize("NFKC", x).casefold()
    title = [(i, sorted({w for w in re.findall(r"[\w']+", fold(x)) if len(w) > 2 and w not in text.TITLE_STOP})) for i, x in texts]
    got = catalog.QUERIES["prj_title_tokens"](spark, TABLES).collect()
    assert sorted((r.doc_id, r.n_tokens, r.tokens) for r in got) == sorted((i, len(t), " ".join(t)) for i, t in title)
    lexical = {tuple(sorted([w for w in re.findall(r"[^\W_]+(?:'[^\W_]+)?", fold(x[:20_000])) if len(w) > 2 and w not in text.LEXICAL_STOP][:512])) for _, x in texts} - {()}
    df = Counter(w for t in lexical for w in set(t))
    found = {r.token: (r.df, r.idf) for r in catalog.QUERIES["agg_lexical_idf"](spark, TABLES).collect()}
    assert {w: d for w, (d, _) in found.items()} == dict(df)
    assert all(abs(x - math.log(1 + (len(lexical) - d + 0.5) / (d + 0.5))) < 2e-6 for d, x in found.values())
