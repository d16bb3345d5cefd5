import random

import pytest
from conftest_llm import frame, prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def corpus():
    """(documents, items, what should become of each document)."""
    rng = random.Random(21)
    items = [(i, prose(rng, "en", 12)) for i in range(5)]
    docs, fate = [], {}
    shared = prose(rng, "de", 14)
    for i in range(300):
        text = "\n".join(prose(rng, rng.choice(["en", "de", "fr"]), 12) for _ in range(5))
        kind = i % 10
        if kind == 0:
            text = "#$% @@@ " * 60
        elif kind == 1 and i > 1:
            text = docs[i - 10 + 4][1].replace(" ", "  ") if i > 10 else text
        elif kind == 2:
            text += f"\n{shared}"
        elif kind == 3:
            text = f"{prose(rng, 'en', 30)} {items[i // 10 % 5][1]} {prose(rng, 'en', 30)}"
        fate[i] = "junk" if kind == 0 else "copy" if kind == 1 and i > 10 else "leak" if kind == 3 else "keep"
        docs.append((i, text, "en", "web"))
    return docs, items, fate, shared


def test_pipeline_on_planted_cases(spark, tmp_path):
    import tiktoken

    from sieveline.llm import bpe

    docs, items, fate, shared = corpus()
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i for i in got} == {i for i, f in fate.items() if f == "keep"}
    enc = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks={t: r for r, t in enumerate(bpe.load_ranks(bpe.VOCABULARY)) if t}, special_tokens={})
    text = {i: t for i, t, *_ in docs}
    first = min(i for i in text if shared in text[i])
    for i, r in got.items():
        want = text[i] if i == first else text[i].replace(f"\n{shared}", "")
        assert r.token_ids == enc.encode_ordinary(want) and r.round_trip and r.n_chars == len(want)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, items, *_ = corpus()
    frame(spark, docs[:60]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, df, str(tmp_path))
        assert out.schema == df.schema, name
        out.write.parquet(f"{tmp_path}/{k}")
        df = spark.read.parquet(f"{tmp_path}/{k}")


def test_odd_and_empty(spark, tmp_path, odd_rows):
    for name, rows in (("odd", odd_rows), ("empty", [])):
        frame(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert all(r.round_trip for r in got) and (len(got) > 0) == (name == "odd")
