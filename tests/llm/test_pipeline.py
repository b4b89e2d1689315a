"""The pipeline as a whole, and the registry."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from wardspan.llm import latent_decontamination  # noqa: E402
from wardspan.llm.queries import QUERIES  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def test_registry():
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == []
    assert len(QUERIES) == 13 and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    texts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(path := str(tmp_path / name))
        before, docs = docs, spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns and 0 < docs.count() <= before.count()
            texts.append({r["doc_id"]: r["text"] for r in docs.collect()})
    quality, lines, single, clean = texts
    assert all(len(brute.SPACED.findall(t)) >= 20 for t in quality.values())
    assert set(clean) <= set(single) <= set(lines) <= set(quality) and all(single[d] == lines[d] for d in single)
    group = brute.groups(list(lines.items()), 5, 80)
    assert set(single) == set(group.values())
    norm = lambda t: " " + " ".join(latent_decontamination.words_of(t)) + " "
    items = [norm(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert not any(x in norm(t) for x in items for t in clean.values())
    assert {r["doc_id"] for r in docs.collect()} == set(clean)
    assert corpus_pipeline.run(spark, SMALL).count() == docs.count()
