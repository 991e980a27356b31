"""Every registered engine query against its SQL counterpart in a second engine, over whole tables."""

import glob
import re

import duckdb
import pytest

from lodestone.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {path.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{path}'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(repr(round(v, 6) if isinstance(v, float) else v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = rows(QUERIES[name](spark, SF).toPandas()), rows(duck.execute(ORACLES[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_no_compared_column_is_constant(duck):
    """A column that never varies compares nothing; those few that cannot vary are named."""
    allowed = {("evidence_metrics", "content_depth"), ("quiz_answers", "source_title"), ("kb_status", None), ("kb_index_stats", None), ("kb_sync_stats", None)}
    constant = set()
    for name, sql in ORACLES.items():
        if name.startswith("kb_") or (name, None) in allowed:
            continue  # compared by rows of documents
        frame = duck.execute(sql).df()
        constant |= {(name, c) for c in frame.columns if len(frame) > 1 and frame[c].astype(str).nunique() <= 1}
    assert constant <= allowed | SMALL


#: Columns that vary over the larger tables only.
SMALL = {("evidence_metrics", "independence"), ("ranked_hits", "intent_bonus"), ("evidence_audit", "caution_count"), ("evidence_metrics", "freshness"), ("noise_pages", "noise")}
#: Queries that SQL cannot express, and the table that each has a row for.
ROWS = {"file_texts": "documents", "page_texts": "pages", "fetched_pages": "pages", "guarded_rewrites": None, "enriched_hits": None, "web_evidence": None, "page_blocks": None, "text_blocks": None, "model_contexts": None, "evidence_reports": None, "kb_search_hits": None}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_of_queries_without_sql(spark, duck, name):
    """As many rows as their table has, nothing blank throughout, and the same rows whatever the partitions are."""
    frame = QUERIES[name](spark, SF).toPandas()
    assert len(frame.columns) == len(set(frame.columns)) and len(frame)
    if ROWS[name]:
        assert len(frame) == duck.execute(f"SELECT count(*) FROM {ROWS[name]}").fetchone()[0]
    blank = [c for c in frame.columns if frame[c].map(lambda v: v is None or v == "" or v != v).all()]
    assert set(blank) <= {"paragraph_index", "fetch_error", "error", "kb_paragraph_start", "published_at"}


def test_views_of_pages_equal_a_plain_reading(spark):
    """Blocks and texts of every page against a reading of the same markup without events."""
    from lodestone.sources import html as H

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in QUERIES["page_texts"](spark, SF).collect()}
    for page_id, markup in pages.items():
        plain = re.sub(r"(?is)<(script|style|noscript|svg|canvas|iframe)\b.*?</\1\s*>", "", markup or "")
        plain = re.sub(r"(?i)</?(p|div|br|li|tr|h[1-4]|blockquote)\b[^>]*>", "\n\n", plain)
        plain = H.clean_paragraphs(re.sub(r"<[^>]*>", "", plain))
        assert got[page_id].index_text.split() == plain.split()


def test_entry_without_the_training_data_operators(tmp_path):
    """The entry file and the engine work where the optional subpackage is absent."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lodestone", tmp_path / "lodestone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'kb_search_topk' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
