"""Registered queries against their SQL, and the pipeline stage by stage against brute force."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import brute_components, brute_fingerprint, brute_overlap, brute_shingles
from trailspark.llm import queries

SMALL = "/root/testdata/sf0.001"


def normal(rows):
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SMALL)
    names = sorted(got.columns)
    want = db.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert normal(tuple(r) for r in got.select(*names).collect()) == normal(want)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        after = [r.doc_id for r in out.collect()]
        assert len(after) == len(set(after)) and set(after) <= set(before)
        if name == "quality classifier":
            wrong = [d for d in before if d in labels and (d in set(after)) != (labels[d] == 1)]
            assert len(wrong) <= 0.05 * len(labels)
        elif name == "language ID":
            assert len(after) >= 0.98 * len(before)
        elif name == "SimHash near-dedup":
            ids = sorted(before)
            parts = brute_components(ids, [brute_fingerprint(before[i].text) for i in ids])
            sets = [brute_shingles(before[i].text) for i in ids]
            for i in range(len(ids)):  # and 0.8 of the five-word shingles
                for j in range(i):
                    if parts[i] != parts[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                        parts = [min(parts[i], parts[j]) if x in (parts[i], parts[j]) else x for x in parts]
            assert sorted(after) == sorted(set(parts))
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            sets = [(i, t) for i, t in items if t]
            clean = {d for d, r in before.items() if not any(t[:40].lower() in r.text.lower() for _, t in sets)}
            dropped = set(before) - set(after)
            assert all(brute_overlap(before[d].text, sets)[4] for d in dropped)
            assert not any(brute_overlap(before[d].text, sets)[4] for d in sorted(set(after) - clean)[:20])
        else:
            assert set(after) == set(before)
            return
        assert out.columns == columns
        docs = spark.createDataFrame([r for r in out.collect()], docs.schema)


def test_run_is_repeatable(spark):
    a, b = ({(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, SMALL).collect()} for _ in range(2))
    assert a == b and len(a) > 100


def test_pipeline_survives_nulls(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    odd = docs.limit(20).select(*(F.lit(None).cast(t).alias(c) if c != "doc_id" else (F.col(c) + 100_000).alias(c) for c, t in docs.dtypes))
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0 if t == "labels" else 5).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


#: Names that stages use inside, as extra columns of strings.
CLASHES = ("found", "gone_id", "gone_hash", "stays", "own_hash", "node", "root", "template_key", "template_host", "template_of", "i", "x", "y", "t", "f", "fp", "key", "table", "size", "bucket", "start", "overlap", "language", "keep", "component_id", "target", "taken", "item_id", "quality", "times", "block")


def odd_documents(spark):
    """Nulls in every column, empty and wordless texts, a very long one, repeated rows and ids, and clashing names."""
    text = "The committee met on Tuesday and agreed to publish the minutes of the earlier meeting in full. " * 3
    data = [(1, text, "en", "web", len(text)), (1, text, "en", "web", len(text)), (2, text, None, None, None), (None, text, "en", "web", 5), (None, None, None, None, None)]
    data += [(3, "", "en", "web", 0), (4, " \n\t ", "en", "web", 4), (5, "...", "de", "", 3), (6, None, "fr", "web", 9), (7, "word " * 200_000, "en", "web", 1_000_000), (8, "\u00e9\u4e2d\U0001f600", "", "books", -1)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars int")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHES))


@pytest.mark.parametrize("side_rows", [0, 40])
def test_stages_take_odd_and_empty_tables(spark, tmp_path, side_rows):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(side_rows).write.parquet(f"{tmp_path}/{t}.parquet")
    docs = odd_documents(spark)
    before = sorted(map(repr, docs.collect()))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        got = stage(spark, docs, str(tmp_path))
        found = got.collect()
        if name == "mixing sources to target weights":
            assert len(found) == len(before)
            continue
        assert got.columns == docs.columns, name
        left = list(before)
        for r in found:
            left.remove(repr(r))  # only rows of the input, each as often at most
        if name == "quality classifier" and not side_rows:
            assert not left
        elif name == "SimHash near-dedup":
            ids = [r.doc_id for r in found]
            assert ids.count(1) == 1 and 2 not in ids and ids.count(None) == 0
            assert len({3, 4, 6} & set(ids)) == 1 and {5, 7, 8} <= set(ids)
        elif name == "benchmark decontamination":
            assert not left or side_rows
