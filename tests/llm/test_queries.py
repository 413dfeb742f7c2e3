"""The registered queries on the smallest tables, against SQL or brute force, and the pipeline."""

import glob
import hashlib
import os
import sys
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from prosegrid.llm import decontam, langid, queries, secrets, simhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from test_decontam import brute as brute_contamination  # noqa: E402
from test_nearcopies import brute as brute_copies  # noqa: E402
from test_simhash import brute as brute_classes  # noqa: E402

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_sharding": "doc_id size text_crc32 law shard slot grown_shard", "op2_simhash": "doc_id fingerprint component_id", "op3_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op4_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated", "op5_language_id": "doc_id held_out lang_pred score",
    "op6_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", "op7_url_filter": "page_id host path rule verdict",
    "op8_warc": "page_id payload_bytes payload_digest record_type refers_to", "op9_token_counts": "doc_id n_bytes n_tokens over_limit", "op10_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
}


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, tables, name):
    df = queries.queries()[name](spark, DATA)
    assert df.columns == COLUMNS[name].split()
    rows = Counter(tuple(r) for r in df.collect())
    table = "pages" if name in ("op7_url_filter", "op8_warc") else "documents"
    assert sum(rows.values()) == tables.execute(f"SELECT count(*) FROM {table}").fetchall()[0][0]
    if name in queries.oracle_sql():
        result = tables.execute(queries.oracle_sql()[name])
        names = [c[0] for c in result.description]
        assert rows == Counter(tuple(dict(zip(names, r))[c] for c in df.columns) for r in result.fetchall())


def test_all_are_registered():
    assert set(queries.queries()) == {*COLUMNS, "pipeline"}


def test_bpe_digests(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = {r["doc_id"]: r for r in queries.op3_bpe(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = library.encode(r["text"], add_special_tokens=False).ids
        own = found[r["doc_id"]]
        assert own["n_tokens"] == len(ids)
        assert own["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_simhash_classes(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert sorted([tuple(r) for r in queries.op2_simhash(spark, DATA).collect()], key=str) == brute_classes(docs)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "secret_scan", "bpe"]
    stage = dict(corpus_pipeline.STAGES)
    one = stage["language_id"](spark, docs, DATA).cache()
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    good = {r["doc_id"] for r in docs.collect() if (p := model.predict(r["text"]))[0] != "und" and p[1] >= 0.5}
    assert {r["doc_id"] for r in one.collect()} == good and one.columns == docs.columns
    two = stage["near_dedup"](spark, one, DATA).cache()
    assert {r["doc_id"] for r in two.collect()} == set(brute_copies([(r["doc_id"], r["text"]) for r in one.collect()]))
    three = stage["decontamination"](spark, two, DATA).cache()
    assert {r["doc_id"] for r in three.collect()} == {r["doc_id"] for r in two.collect() if not brute_contamination(r["text"], items)[3]}
    four = stage["secret_scan"](spark, three, DATA).cache()
    before, after = ({r["doc_id"]: r for r in d.collect()} for d in (three, four))
    assert before.keys() == after.keys() and two.columns == three.columns == four.columns == docs.columns
    scanner = secrets.default_model()
    for key, row in before.items():
        spans = secrets.scan(row["text"], scanner)[1]
        assert (row["text"] == after[key]["text"]) == (not spans)
        assert after[key]["n_chars"] == len(after[key]["text"])
    five = stage["bpe"](spark, four, DATA)
    assert {r["doc_id"] for r in five.collect()} == after.keys()


def test_pipeline_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_stages_take_odd_rows(spark, odd, empty):
    benchmark = f"{DATA}"
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, benchmark)
            assert out.count() <= docs.count()
            if name != "bpe":
                assert out.columns == docs.columns
    assert decontam.WINDOW == 13 and simhash.SEED == 42


def test_stages_pass_columns_of_any_type(spark, odd):
    nested = odd.withColumns({"a b": F.struct(F.lit(1).alias("x y"), F.array(F.lit(2.5)).alias("`z`")), "when": F.current_timestamp(), "m": F.create_map(F.lit("k"), F.lit(1)), "Fp": F.lit(1), "spans": F.lit("s")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, nested, DATA)
        assert out.columns == nested.columns and out.count() > 0, name
