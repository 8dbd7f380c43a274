"""The corpus pipeline against brute force of each stage, on a small folder of tables."""

import random
import re

import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline

from tickforge.llm import packing
from tickforge.llm._shared import documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(3, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(70)
    texts = [prose(80) + rng.choice([" stupid fool", " you idiot"]) if k % 3 == 0 else prose(90) for k in range(120)]
    copy = texts[1]
    texts += [copy, copy + " more", None, "", prose(40) + " " + passage, passage + " " + prose(40), prose(30) + " password = hunter2hunter2 " + prose(20)]
    place = str(tmp_path_factory.mktemp("tables"))
    rows = [(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place, texts


def test_stages(spark, folder):
    place, texts = folder
    docs = documents(spark, place)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "secrets", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.durable(stage(spark, docs, place), name)
        assert docs.columns == COLUMNS
        kept[name] = {r.doc_id: r for r in docs.collect()}
    toxic = {k for k, t in enumerate(texts) if t and re.search("stupid|idiot", t)}
    assert set(kept["toxicity"]) == set(range(len(texts))) - toxic
    assert set(kept["toxicity"]) - set(kept["near_duplicates"]) == {120, 121}
    assert set(kept["repeated_passages"]) == set(kept["secrets"]) == set(kept["near_duplicates"])
    first, later = kept["repeated_passages"][124], kept["repeated_passages"][125]
    assert first.text == texts[124] and len(later.text) < len(texts[125]) - 300 and later.n_chars == len(later.text)
    assert "[SECRET]" in kept["secrets"][126].text and "hunter2" not in kept["secrets"][126].text
    assert kept["secrets"][122].text is None and kept["secrets"][123].text == ""
    changed = {124, 125, 126}
    assert all(kept["secrets"][k].text == texts[k] for k in kept["secrets"] if k not in changed)

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, place).collect()
    encode = packing.TextIds(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json")).encode
    assert {r.doc_id for r in packed} == set(kept["secrets"])
    assert sum(r.length for r in packed) == sum(len(encode(r.text or "")) // 4 + 1 for r in kept["secrets"].values())
    whole = corpus_pipeline.run(spark, place)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)


def test_empty(spark, folder, tmp_path):
    place, _ = folder
    spark.read.parquet(f"{place}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{place}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
