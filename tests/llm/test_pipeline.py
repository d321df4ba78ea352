"""The pipeline stage by stage on planted documents, its whole run, and the guard of the entry module."""

import random
import re
import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest
from support import SF

from tidemark.llm.common import stash
from tidemark.llm.queries import ORACLE_SQL, QUERIES

REPO = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, duck, same):
    same(QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLE_SQL[name]).df())


def test_contract_columns(spark):
    want = {
        "op1_mixing": "doc_id size source_size target taken", "op2_tokens": "doc_id start n_tokens ids_crc32", "op4_simhash": "doc_id fingerprint component_id", "op5_ann": "query_id rank vec_id score",
        "op7_toxicity": "doc_id held_out score predicted", "op8_blockmax": "query_id rank vec_id score", "op10_suffixes": "doc_id n_bytes n_removed n_spans kept_sha256",
    }
    for name, cols in want.items():
        assert set(cols.split()) <= set(QUERIES[name](spark, SF).columns), name


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9)))
    rows, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rng.randrange(30, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), "vileword")
        rows.append((i, " ".join(words), "en", "ab"[i % 2]))
        labels.append((i, 1, int(toxic)))
    near = rows[1][1].split()
    near[3] = "edited"
    rows += [(1000 + k, rows[1][1], "en", "a") for k in range(50)] + [(2000, " ".join(near), "en", "b"), (2001, rows[7][1] + " a.b@example.com +1 (183) 555-1276", "en", "a"), (2002, None, "en", "a"), (2003, "", "en", None)]
    d = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages(spark, planted):
    docs, kept = spark.read.parquet(f"{planted}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, planted), "test")
        if name != "packing":
            assert docs.columns == columns
        kept[name] = docs.collect()
    ids = {name: {r["doc_id"] for r in rows} for name, rows in kept.items()}
    clean = {i for i in range(600) if i % 6}
    assert not any("vileword" in (r["text"] or "") for r in kept["toxicity"]) and len(clean & ids["toxicity"]) >= 0.99 * len(clean)
    assert {2002, 2003} <= ids["toxicity"] & ids["simhash_near_dedup"]  # texts without a word stay
    gone = ids["toxicity"] - ids["simhash_near_dedup"]
    assert gone == ({*range(1000, 1050), 2000, 2001} & ids["toxicity"])
    assert len(kept["simhash_near_dedup"]) == len(ids["simhash_near_dedup"])
    assert ids["pii"] == ids["simhash_near_dedup"] and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in kept["pii"])
    total = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert abs(total(kept["mixing"]) - 1.5 * total(kept["pii"])) <= 0.02 * total(kept["pii"])
    assert sum(r["n_tokens"] for r in kept["packing"]) == total(kept["mixing"]) + len(kept["mixing"])


def test_filters_keep_texts_without_words(spark, tmp_path):
    """Even where nearly all labelled rows are toxic, and however many such rows there are."""
    rows = [(i, "vile words of hate and spite number " + str(i), "en", "a") for i in range(60)] + [(100 + i, t, "en", "a") for i, t in enumerate([None, None, None, "", "", " \t"])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, int(i < 58)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert {r["doc_id"] for r in stage(spark, docs, str(tmp_path)).collect()} >= set(range(100, 106))


def test_pii_stage_rewrites(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet").where("doc_id = 2001")
    text = corpus_pipeline.pii_stage(spark, docs, planted).first()["text"]
    assert "a.b@example.com" not in text and "555-1276" not in text and re.search(r" \S+@\S+ \+1 \(\d{3}\) \d{3}-\d{4}$", text)


def test_run_and_empty(spark, planted, tmp_path):
    assert corpus_pipeline.run(spark, planted).count() > 0
    for t in ("documents", "labels"):
        spark.read.parquet(f"{planted}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_run_against_a_plain_version(spark, planted):
    """run() row for row: toxicity scored and near copies compared in plain Python over all pairs, the mix by its DuckDB SQL, pieces cut here.

    Surrogate texts are those of the stage (test_pii has their plain version); all decisions on them are taken again.
    """
    import duckdb
    import numpy as np

    from tidemark.llm import toxicity

    docs = spark.read.parquet(f"{planted}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{planted}/labels.parquet"), hold_out=False)
    seen = np.zeros(1 << toxicity.BITS, np.int32)
    rows = [r for r in docs.collect() if not words_of(r["text"]) or model.score(r["text"], seen) < 0.5]

    def grams(text):
        w = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    worded = sorted((r["doc_id"], grams(r["text"])) for r in rows if words_of(r["text"]))
    root = {i: i for i, _ in worded}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(worded):
        for j, b in worded[:k]:
            if len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    kept = {i for i, _ in worded if find(i) == i} | {r["doc_id"] for r in rows if not words_of(r["text"])}
    clean = spark.createDataFrame([r for r in rows if r["doc_id"] in kept], docs.schema)
    told = corpus_pipeline.pii_stage(spark, clean, planted).toPandas()
    duck = duckdb.connect()
    duck.register("documents", told)
    copies = {r[0]: r[-1] for r in duck.sql(f"SELECT doc_id, copies FROM ({ORACLE_SQL['op1_mixing']})").fetchall()}
    most, want = max(corpus_pipeline.packing.CAPACITIES), []
    for i, t in zip(told.doc_id, told.text):
        n = len(words_of(t)) + 1
        want += [(int(i), p, p * most, min(most, n - p * most)) for p in range(-(-n // most))] * copies[i]
    got = [tuple(r[c] for c in ("doc_id", "piece", "piece_start", "n_tokens")) for r in corpus_pipeline.run(spark, planted).collect()]
    assert sorted(got) == sorted(want) and len(got) > 300


def test_the_rest_stands_alone(tmp_path):
    """Without this subpackage and the pipeline the entry module imports and keeps the other queries."""
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(n[:3].strip('op').isdigit() for n in q), sorted(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_release(spark, tmp_path):
    from tidemark.llm.common import own_dir, release

    kept = stash(spark.range(3), "test")
    folder = Path(own_dir(spark).removeprefix("file://"))
    assert kept.count() == 3 and any(folder.iterdir())
    release(spark)
    assert not folder.exists()
