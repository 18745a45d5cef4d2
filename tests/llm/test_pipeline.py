import random

import corpus_pipeline
from harrow.llm import decontaminate, linededup, minhash, packing, toxicity

from .util import words

DIR_TABLES = ("documents", "labels", "benchmark")


def tables(spark, path, rows, labels, bench):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage_takes_effect(spark, tmp_path):
    rng = random.Random(2)
    texts = {i: words(rng, 60) for i in range(200)}
    labels = [(i, 1, int(i < 40)) for i in range(200)]
    for i in range(40):
        texts[i] += ". you idiot and moron, pathetic worthless clown."
    texts[205] = texts[100]  # an exact copy
    texts[206] = texts[101].replace(" ", "  ", 3) + " end"  # a near copy
    passage = " ".join(words(rng, 12).capitalize() + "." for _ in range(8))
    texts[207], texts[208] = words(rng, 20) + ".\n" + passage, words(rng, 20) + ".\n" + passage
    item = words(rng, 30)
    texts[209] = words(rng, 30) + " " + item.upper() + " " + words(rng, 9)
    texts[210], texts[211] = None, ""
    sf = tables(spark, tmp_path, [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()], labels, [(1, item), (2, "x" * 90)])

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {n: None for n, _ in corpus_pipeline.STAGES}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if n < 4:
            assert out.columns == docs.columns
        kept[name] = {r["doc_id"]: r for r in out.collect()}
        docs = spark.createDataFrame(list(kept[name].values()), out.schema)
    assert set(kept["toxicity"]) == set(range(40, 200)) | set(range(205, 212))
    assert set(kept["line_dedup"]) == set(kept["toxicity"])
    assert passage in kept["line_dedup"][207]["text"] and passage not in kept["line_dedup"][208]["text"]
    near = set(kept["near_dedup"])
    assert 100 in near and 101 in near and not {205, 206} & near and len({210, 211} & near) == 1
    assert set(kept["decontamination"]) == near - {209}
    assert set(kept["packing"]) == set(kept["decontamination"])

    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted(
        (r["doc_id"], r["piece"], r["ids_crc32"]) for r in kept["packing"].values())


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [], [])).count() == 0


def test_stages_are_the_operators(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]
    used = (toxicity.reject_toxic, linededup.dedup_lines, minhash.drop_near_duplicates, decontaminate.drop_leaks, packing.packed)
    for (_, stage), op in zip(corpus_pipeline.STAGES, used):
        assert op.__name__ in stage.__code__.co_names


def test_all_ten_operators_are_registered():
    import __spark_entry__ as e
    names = e.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)
