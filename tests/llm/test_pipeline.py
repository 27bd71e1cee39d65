"""The pipeline's rows against plain versions of its stages, and the whole subpackage against its removal."""

import hashlib
import os
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from meltfield.llm import op02_pii, op09_toxicity
from test_brute_force import components_by_pairs, simple_fingerprint

SF = "/root/testdata/sf0.001"


def words(t):
    return re.findall(r"[^\W_]+", t.lower())


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_rows_match_plain_stages(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    model = op09_toxicity.fit(documents, spark.read.parquet(f"{SF}/labels.parquet"))
    up = op09_toxicity.severity(model, pa.array([t for _, t in docs]))
    docs = [d for d, p in zip(docs, up[:, 0]) if p < 0.5]
    fps = [simple_fingerprint(t) for _, t in docs]
    root = components_by_pairs(fps)
    docs = [d for i, d in enumerate(docs) if root[i] == i]
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [d for d in docs if not any(len(q & shingles(d[1])) >= 0.8 * len(q) for q in items)]
    pii = op02_pii.fit(spark.createDataFrame(docs, "doc_id long, text string"))
    docs = [(i, op02_pii._replace(t, [s for part in op02_pii.all_spans(t, pii) for s in part])) for i, t in docs]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == [i for i, _ in docs] and 100 < len(docs) < documents.count()
    for i, t in docs:
        ids = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_the_rest_stands_without_the_subpackage(tmp_path):
    root = Path(corpus_pipeline.__file__).parent
    (tmp_path / "__spark_entry__.py").symlink_to(root / "__spark_entry__.py")
    (tmp_path / "meltfield").mkdir()
    for p in (root / "meltfield").iterdir():
        if p.name != "llm":
            (tmp_path / "meltfield" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'melt_mask_semi' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=env)
