"""The pipeline's stages take effect, and the library stands without this subpackage."""

import random
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_pipeline_stages(spark, docs, wide, tmp_path):
    import corpus_pipeline as cp

    assert [n for n, _ in cp.STAGES] == ["quality classifier", "near-duplicates", "decontamination", "source mix", "token output"]
    labels = [(i * 3, 1, 0) for i in range(55)] + [(3003, 0, 0), (3002, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    leak = docs.filter("doc_id = 9").first().text
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = wide
    for k, (_, stage) in enumerate(cp.STAGES):
        before = at.count()
        stage(spark, at, str(tmp_path)).write.parquet(f"{tmp_path}/out-{k}")
        at = spark.read.parquet(f"{tmp_path}/out-{k}")
        if k < 4:
            assert at.columns == wide.columns
        if k in (1, 2):
            assert at.count() < before
        if k == 2:
            assert at.filter("doc_id = 9").count() == 0
    assert at.count() > 0 and at.filter("not verified").count() == 0


def test_rows_equal_a_plain_pipeline(spark, rows, tmp_path):
    """run() against the same five stages in plain Python."""
    import re
    import zlib
    from collections import Counter

    import corpus_pipeline as cp
    import numpy as np
    import public_tokenizers
    import pyarrow as pa
    from conftest import SCHEMA, prose
    from test_operators import brute_classes, coded, plain_leak
    from tokenizers import Tokenizer

    from colonnade.llm import near_dups, quality
    from colonnade.llm.work import read_table

    rng = random.Random(31)
    item = prose(rng, 30)
    made = [r for r in rows if r[1] is None or len(r[1]) < 5000]
    made += [(4000 + i, "BUY NOW!!! $$$ " * (i + 3), "en", "s2", 0) for i in range(12)]
    near = item.split()
    near[4] = near[17] = "changed"
    made += [(5000, prose(rng, 20) + " " + item, "en", "s3", 0), (5001, " ".join(near) + " " + prose(rng, 9), "de", "s1", 0)]
    made += [(None, prose(rng, 25), "en", "s3", 0), (None, None, None, None, 0)]
    folder = str(tmp_path)
    spark.createDataFrame(made, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i * 3, 1, 0) for i in range(60)] + [(4000 + i, 0, 0) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, ""), (3, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    docs = read_table(spark, folder, "documents")
    model = quality.train(docs, read_table(spark, folder, "labels"))
    scores = model.score(quality.features(pa.array([r[1] for r in made], pa.string())))
    kept = [r for r, x in zip(made, scores, strict=True) if x >= 0.5]
    assert len(kept) < len(made)
    # One row of each class: that of the lowest id, null first as in the operator's order.
    lowest = [min((kept[i] for i in g), key=lambda r: (r[0] is not None, r[0] or 0)) for g in brute_classes(kept, near_dups).values()]
    number: dict = {}
    goal = coded(item, number)
    clean = [r for r in lowest if not plain_leak(coded(r[1] or "", number), goal)]
    assert len(lowest) - len(clean) >= 1

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    lots = spark.createDataFrame([(k, r[0], r[1]) for k, r in enumerate(clean)], "k int, doc_id long, text string")
    lot = {r.k: (r.m % 1024, r.m) for r in lots.selectExpr("k", "xxhash64(doc_id, xxhash64(text), 0) as m").collect()}
    sources = sorted({r[3] for r in clean if r[3] is not None}) + ([None] if any(r[3] is None for r in clean) else [])
    words_of = {x: sum(size(r[1]) for r in clean if r[3] == x) for x in sources}
    weight = {x: 1 + k % 3 for k, x in enumerate(sources)}
    target, free, left = {}, set(sources), float(sum(words_of.values()))
    while free:
        level = left / sum(weight[x] for x in free)
        full = {x for x in free if weight[x] * level > 3 * words_of[x]}
        if not full:
            target |= {x: weight[x] * level for x in free}
            break
        for x in full:
            target[x] = 3.0 * words_of[x]
            left -= target[x]
        free -= full
    mixed = []
    for x in sources:
        at, goal_words = 0, int(target[x] + 1e-6)
        for k in sorted((k for k, r in enumerate(clean) if r[3] == x), key=lot.get):
            n = size(clean[k][1])
            taken = sum(max(0, min(n, goal_words - at - p * words_of[x])) for p in range(3))
            mixed += [clean[k]] * (int(taken / max(n, 1) + 0.5) if n else 0)
            at += n
        assert abs(sum(size(r[1]) for r in mixed if r[3] == x) - target[x]) <= max(size(r[1]) for r in clean if r[3] == x) / 2 + 1

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text, *_ in mixed:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = cp.run(spark, folder).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and all(r.verified for r in got)


def test_pipeline_of_empty_tables(spark, none, tmp_path):
    import corpus_pipeline as cp

    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_entry_works_without_llm(tmp_path):
    import shutil

    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'q_pricing_summary' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120)
