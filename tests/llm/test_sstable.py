import io
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lorespark.llm import sstable
from lorespark.llm.tokenize import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a  b", " a", "a ", "a \n b", "\n a", "a\n b", "a \nb", "don't  it's 12 3", "<|endoftext|> x", "hello <|endoftext|> world", "a<|endoftext|>b <|endoftext", "a\t b", "  ", "x   y z", "é è    q", "", "word, word. Word! (word) word's 3rd, x,y",
    "\x0b", "a\x0bb c", "line\nline two\n", "end\n", "a \x0b b", " x  y z  q", "汉字 漢字, 汉。 ok", "🔺 x 🔺, y", " ,", ", .", "1, 2. a1, É, é. ǅ,", "a\r\nb c", "　 x", "x,, y", "²,",
]


@pytest.fixture(scope="module")
def plain():
    tool = Tokenizer.from_file(PATH)
    return lambda t: tool.encode(t or "", add_special_tokens=False).ids


def test_cache_changes_no_id(plain, monkeypatch):
    monkeypatch.setattr("lorespark.llm.tokenize.CACHE_PIECES", 20)
    tool, rng = Encoder(PATH), random.Random(1)
    texts = ODD + ["".join(rng.choice(["a", "b", "É", " ", " ", "\n", ",", ".", "1", "'s", "\t", "-", "b", "\n", "$&", "_", "…", "’", "ß", "!", "²", " "]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for k in range(0, len(texts), 100):
        for t, got in zip(texts[k : k + 100], tool.encode(texts[k : k + 100])):
            assert np.frombuffer(got, dtype=tool.kind).tolist() == plain(t), repr(t)


def test_round_trip(spark, tmp_path, plain, monkeypatch):
    monkeypatch.setattr(sstable, "TASK_BYTES", 20_000)
    monkeypatch.setattr(sstable, "SHARD_DOCS", 20)
    rng = random.Random(4)
    rows = [(rng.randrange(-(10**6), 10**6), " ".join(rng.choice(ODD) for _ in range(rng.randrange(8)))) for _ in range(300)]
    rows += [(None, "no id"), (None, None), (7, "twin"), (7, "twin"), (7, "other"), (2**63 - 1, "last"), (-(2**63), None), (12, "long word " * 5000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, value string").repartition(3)
    shards = sstable.write(spark, docs, f"file://{tmp_path}/out", PATH)
    files = shards.collect()
    assert len(files) > 5 and sum(s.docs for s in files) == len(rows) and max(s.docs for s in files) == 20 and len({s.part for s in files}) > 2
    got = sorted(sstable.read(spark, shards).collect(), key=lambda r: r.start)
    assert [(r.doc_id is None, r.doc_id or 0) for r in got] == sorted((d is None, d or 0) for d, _ in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, dtype="<u4").tolist()) for r in got) == sorted((str(d), [*plain(t), 0]) for d, t in rows)
    start = 0
    for g in got:
        assert g.start == start and g.n_tokens == len(g.ids) // 4
        start += g.n_tokens
    assert sorted(sstable.lookup(shards, 7)) == sorted([plain("twin") + [0]] * 2 + [plain("other") + [0]])
    assert sstable.lookup(shards, 2**63 - 1) == [plain("last") + [0]]
    assert sorted(sstable.lookup(shards, None)) == sorted([plain("no id") + [0], [0]])
    assert sstable.lookup(shards, 10**7) == []
    assert sorted(p.name for p in tmp_path.glob("out/*")) == sorted(["manifest", *(s.path.rsplit("/", 1)[1] for s in files)])
    assert sorted(r.start for r in spark.read.parquet(f"file://{tmp_path}/out/manifest").collect()) == sorted(s.start for s in files)


def test_blocks_bloom_and_damage(monkeypatch):
    monkeypatch.setattr(sstable, "BLOCK_BYTES", 200)
    sink = pa.BufferOutputStream()
    writer = sstable.Writer(sink, 2)
    for i in range(0, 4000, 2):
        writer.add(i // 6, bytes([i % 251, 0] * (i % 5)))
    writer.close()
    data = sink.getvalue().to_pybytes()
    reader = sstable.Reader(pa.BufferReader(data))
    assert len(reader.blocks) > 50 and len(reader.lookup(5)) == 3
    assert all(reader.lookup(i // 6) for i in range(0, 4000, 200))
    assert sum(reader.may_hold(sstable.key_of(10**6 + i)) for i in range(2000)) < 80
    spoiled = bytearray(data)
    spoiled[-70] ^= 1
    with pytest.raises(ValueError):
        sstable.Reader(pa.BufferReader(bytes(spoiled)))
    with pytest.raises(ValueError):
        writer.add(1, b"")
    assert zlib.crc32(data) and io


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sstable.read(spark, sstable.write(spark, docs, f"file://{tmp_path}/none", PATH)).collect() == []
