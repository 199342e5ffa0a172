"""The queries on the given tables: against SQL, against brute force, and on labels held out."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tonelake.llm import registry

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the given tables are not here")


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].map(lambda v: "null" if v is None or v is pd.NA or isinstance(v, float) and v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    pd.testing.assert_frame_equal(plain(registry.queries()[name](spark, SMALL).toPandas()), plain(con.execute(registry.oracle_sql()[name]).df()))


def test_languages_held_out(spark):
    docs = duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet' WHERE lang IS NOT NULL").df()
    got = registry.op5_byte_cnn(spark, SF).toPandas().merge(docs, on="doc_id")
    held = got[got.held_out]
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.95


def test_quality_held_out(spark):
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").df()
    got = registry.op10_line_crf(spark, SF).toPandas().merge(labels, on="doc_id")
    held = got[got.held_out]
    good, bad = held[held.quality == 1].score.to_numpy(), held[held.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98 and (held.predicted == held.quality).mean() > 0.95


def test_pipeline_decides_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, ids = docs, [{r.doc_id for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SMALL)
        assert kept.columns == docs.columns, name
        kept = kept.checkpoint()
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
        assert ids[-1] <= ids[-2]
    assert len(ids[-1]) >= 0.6 * len(ids[0])
    last = corpus_pipeline.run(spark, SMALL).toPandas()
    assert set(last.doc_id) == ids[-1] and (last.groupby("sequence_id").length.sum() <= 2048).all()
    found = registry.op7_winnowing(spark, SMALL).toPandas()
    assert not set(found[found.contaminated].doc_id) & ids[-1]
    assert np.isfinite(last.ids_crc32).all()


def test_pipeline_of_empty_and_null_documents(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        rows = spark.read.parquet(f"{SMALL}/{name}.parquet")
        rows.limit(0).write.parquet(str(tmp_path / "empty" / f"{name}.parquet"))
        if name == "documents":
            cast = rows.schema["text"].dataType
            from pyspark.sql import functions as F

            rows = rows.limit(3).select(*[F.lit(None).cast(cast).alias("text") if c == "text" else F.col(c) for c in rows.columns])
        rows.write.parquet(str(tmp_path / "null" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    for r in corpus_pipeline.run(spark, str(tmp_path / "null")).collect():
        assert r.length == 1
