import shutil
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from test_decontaminate import brute as matches
from test_mixing import targets
from test_simhash import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from lorespark.llm import language

SOURCE = "/root/testdata/sf0.001"


@pytest.mark.parametrize("extra", [False, True])
def test_matches_brute_force(spark, tmp_path, extra):
    docs = spark.read.parquet(f"{SOURCE}/documents.parquet").collect()
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SOURCE}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs] + [(9000, None, None, "src0", 0), (9001, "123 ... 456", "en", "src1", 11), (9002, docs[0].text, "fr", "src2", 0), (9003, "我们在这里写一些中文文本,看看结果如何。" * 5, None, "src1", 0), (9004, " ".join(f"{w}{i % 97}the" for i, w in enumerate(docs[1].text.split() * 300)), "en", "src0", 0)]
    assert len(rows[-1][1].split()) > 10_000
    rows += [(9005, "ж", None, "src1", 0), (9006, "שלום", None, "src1", 0), (9007, "ここ", None, "src1", 0), (9008, "ok नम", None, "src0", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    if extra:  # names that the operators use themselves
        rows, schema = [(*r, *"xyzuvw") for r in rows], schema + ", lang_pred string, _fp string, mix_copies string, h string, SCORE string, block string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{SOURCE}/benchmark.parquet", f"{tmp_path}/benchmark.parquet")
    got = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=lambda r: r[1])

    model = language.train(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"))
    kept = [r for r in rows if r[1] and language._LETTER.search(r[1]) and model.predict(r[1])[1] >= language.LEAST_SCORE]
    assert {r[0] for r in rows} - {r[0] for r in kept} >= {9000, 9001}
    foreign = {9003, 9005, 9006, 9007, 9008}
    assert foreign - {r[0] for r in kept}
    first = {d for d, _, c in brute_components([r[:2] for r in kept]) if d == c}
    kept = [r for r in kept if r[0] in first]
    bad = {m[0] for m in matches([r[:2] for r in kept], bench)}
    assert bad and 9002 not in first
    kept = [r for r in kept if r[0] not in bad]

    by = defaultdict(list)
    for r in kept:
        h = xxhash.xxh64_intdigest(r[1].encode(), xxhash.xxh64_intdigest(struct.pack("<q", r[0]), 42)) >> 16
        by[r[3]].append((h, len(r[1].encode().split()), r))
    sources = sorted(by)
    sizes = [sum(n for _, n, _ in by[s]) for s in sources]
    mixed = []
    for s, size, target in zip(sources, sizes, targets(sizes)):
        whole, sofar = int(target // size), 0
        rest = target - whole * size
        for h, n, r in sorted(by[s]):
            more = sofar < rest and abs(sofar + n - rest) < abs(sofar - rest)
            sofar = sofar + n if more else float("inf")
            mixed += [r] * (whole + more)
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = [], 0
    for r in sorted(mixed, key=lambda r: r[0]):
        ids = [*tool.encode(r[1], add_special_tokens=False).ids, 0]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    shutil.copy(f"{SOURCE}/benchmark.parquet", f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_ids(spark, tmp_path):
    """Rows that repeat an id on other texts are documents of their own."""
    texts = [r.text for r in spark.read.parquet(f"{SOURCE}/documents.parquet").where("lang = 'en' and length(text) between 800 and 4000").limit(6).collect()]
    rows = [(i // 2, t, "en", f"s{i % 2}", 0) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {(i // 2, len(tool.encode(t, add_special_tokens=False).ids) + 1) for i, t in enumerate(texts)}
    assert got and {(r.doc_id, r.n_tokens) for r in got} <= sizes
