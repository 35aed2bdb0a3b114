from __future__ import annotations

import re
import sys
from pathlib import Path

import pytest
from compare import duck_rows, spark_rows

sys.path.insert(0, str(Path(__file__).parent))
import corpus_pipeline  # noqa: E402
import test_text_operators as brute  # noqa: E402

from quarry.llm import pii  # noqa: E402
from quarry.llm.queries import oracle_sql, queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_sql(spark, folder, duck, name):
    assert spark_rows(queries()[name](spark, folder)) == duck_rows(duck, oracle_sql()[name])


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries()) == list(range(1, 11))


def test_pipeline_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    verdicts = {i: brute.verdict_brute(t) for i, t in texts.items()}
    texts = {i: left for i, (kept, _, left) in verdicts.items() if kept}
    groups = brute.groups_brute(texts)
    texts = {i: t for i, t in texts.items() if groups[i][1] == i}
    flat = lambda t: " ".join(t.lower().split())
    items = [flat(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    texts = {i: t for i, t in texts.items() if not any(x in flat(t) for x in items)}
    automaton = pii._automaton()
    texts = {i: pii.redacted(t, automaton) for i, t in texts.items()}
    brute.check_packed(corpus_pipeline.run(spark, folder).collect(), texts)


def test_stages_keep_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_stages_on_odd_tables(spark, folder):
    """Nulls, repeats, empty and long texts, extra columns; each stage by itself and one after the other."""
    long = " ".join(f"w{i % 977}x{i % 53}." for i in range(30_000))
    good = "\n".join(f"Line{k} tells of things{k}, and ends." for k in range(9))
    rows = [(None, None), (1, None), (2, ""), (3, good), (3, good), (4, f"{good}\nWe use cookies; read our cookie policy."), (5, long), (6, f"{long} end"), (None, good), (7, f"mail a@b.cd {good.replace('things', 'deeds')}")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _row int")
    counts, docs = [], df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df.limit(0), folder).count() == 0 and stage(spark, df, folder).columns == df.columns
        docs = stage(spark, docs, folder)
        counts.append(sorted((r["doc_id"] or 0) for r in docs.collect()))
    # null and empty texts are too short; 4 becomes 3's text; 6 is nearly 5
    assert counts[0] == [0, 3, 3, 4, 5, 6, 7] and counts[1:] == [[0, 3, 5, 7]] * 3
    assert {r["doc_id"]: "<email>" in r["text"] for r in docs.collect()}[7]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {p["doc_id"] or 0 for p in pieces} == {0, 3, 5, 7}
