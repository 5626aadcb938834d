import public_tokenizers
import pytest

import corpus_pipeline
from loomgraph.llm.byte_bpe import ByteBPE
from loomgraph.llm.quality import fit, judged
from tests.llm.test_line_dedup import brute as line_brute
from tests.llm.test_near_dedup import brute as near_brute
from tests.llm.test_near_dedup import shingles

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    at = corpus_pipeline.common.checkpoint_folder(spark) + "/stages"
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.mode("overwrite").parquet(f"{at}/{name}")
        out.append((docs, spark.read.parquet(f"{at}/{name}")))
        docs = out[-1][1]
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_each_stage_equals_brute_force_on_its_input(spark, stages):
    columns = spark.read.parquet(f"{SF}/documents.parquet").dtypes
    assert all(after.dtypes == columns for _, after in stages[:-1])
    before, after = map(texts, stages[0])
    trees = fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    ids = list(before)
    assert set(after) == {i for i, k in zip(ids, judged(trees, [before[i] for i in ids])["kept"], strict=True) if k}
    before, after = map(texts, stages[1])
    assert after == {i: t for i, t in line_brute(before.items()).items() if t.strip()}
    assert all(r.n_chars == len(r.text) for r in stages[1][1].collect())
    before, after = map(texts, stages[2])
    assert after == {i: before[i] for i, (_, c) in near_brute(list(before.items())).items() if c == i}
    before, after = map(texts, stages[3])
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert after == {i: t for i, t in before.items() if not any(100 * len(x & shingles(t)) >= 75 * len(x) for x in items)}
    assert 0 < len(after) < len(before)
    coder = ByteBPE.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert {r.doc_id: r.ids for r in stages[4][1].collect()} == {i: coder.encode(t) for i, t in after.items()}


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).exceptAll(stages[4][1]).count() == 0
