import pytest

from readloom.llm import queries

from .. import oracle
from ..conftest import DATA

SF = f"{DATA}/sf0.001"
COLUMNS = {
    "op1_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op2_neighbours": ["query_id", "rank", "vec_id", "score"],
    "op3_line_dedup": ["doc_id", "text", "n_lines", "n_removed"],
    "op4_near_dedup": ["doc_id", "class_id", "class_size"],
    "op5_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op8_quality": ["doc_id", "held_out", "score", "predicted"],
    "op9_urls": ["page_id", "host", "path", "rule", "verdict"],
    "op10_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_columns_and_oracle(spark, name):
    if name in queries.ORACLES:
        got, want = oracle.both(spark, oracle.connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
        assert got == want
    else:
        got = queries.QUERIES[name](spark, SF)
        assert got.columns == COLUMNS[name] and got.count() > 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).cache()
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert out.select("doc_id", "copy_no").distinct().count() == out.count() and out.columns[:5] == docs.columns
    assert out.filter("copy_no > copies").count() == 0 and out.groupBy("doc_id").count().filter("count > 2").count() == 0


def test_pipeline_stages_catch_what_is_planted(spark, tmp_path):
    """One passage of one item, a near copy, a repeated run and odd rows, on documents that are otherwise kept."""
    import random

    import corpus_pipeline as cp

    rng = random.Random(5)
    vocab = [a + b + c for a in ("ka", "lo", "mi", "ne", "ru", "ta") for b in ("n", "sa", "rel") for c in ("tion", "um", "ix", "")]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    item, run = prose(20), "\n".join(prose(20) for _ in range(4))
    rows = [(i, "\n".join(prose(30) for _ in range(4))) for i in range(40)]
    rows[3] = (3, prose(40) + " " + item + " " + prose(40))
    words = rows[5][1].split(" ")
    rows[6] = (6, " ".join([*words[:50], "changed", *words[51:]]))
    rows[8], rows[9] = (8, run + "\n" + prose(60)), (9, prose(60) + "\n" + run)
    rows += [(100, None), (101, ""), (None, prose(60)), (10, rows[10][1]), (102, prose(30_000))]
    data = [(i, t, "en", f"s{(i or 0) % 3}" if i != 11 else None, None if t is None else len(t), 0.5, 3) for i, t in rows]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, score double, size int")
    folder = f"file://{tmp_path}"
    spark.createDataFrame([("q1", item)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    ids = lambda df: sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())
    every = sorted((i is None, i or 0) for i, *_ in data)
    stage = dict(cp.STAGES)

    good = stage["quality classifier"](spark, docs, folder)
    assert good.columns == docs.columns and ids(good) == every  # without labels nothing is rejected
    lines = stage["line dedup"](spark, docs, folder)
    text = {r.doc_id: r.text for r in lines.collect()}
    assert lines.columns == docs.columns and ids(lines) == every
    assert text[8] == rows[8][1] and text[9] == rows[9][1].split("\n")[0] and text[100] is None and text[101] == "" and text[102] == rows[-1][1]
    near = stage["MinHash near-dedup"](spark, docs, folder)
    assert near.columns == docs.columns and ids(near) == sorted(set(every) - {(False, 6)})
    clean = stage["benchmark decontamination"](spark, docs, folder)
    assert clean.columns == docs.columns and ids(clean) == sorted(i for i in every if i != (False, 3))
    mixed = stage["mixing sources to target weights"](spark, docs, folder)
    assert mixed.groupBy("doc_id", "copy_no", "text").count().filter("count > 2").count() == 0 and mixed.columns[:5] == docs.columns[:5]
    for _, f in cp.STAGES:
        assert f(spark, docs.limit(0), folder).count() == 0
