import zlib

import numpy as np
import pytest

from netweave.llm import token_files as t

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")
ODD = ["", " \n\t ", "A b\x0bc\x0cd\re", "naïve ΑΣͅ ΟΔΟΣ οδος", "é ́e x y z \u0085 \x1c", "don't 's 'll I'm 123 4 5.6!? <|endoftext|> a<|startoftext|>b", "日本語 テキスト", "x" * 50_000, "ab " * 20_000, "가 ᆨ", "İstanbul ﬁ ß İ"]


def whole(texts):
    """What the library makes of whole texts."""
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    return [np.array([*tokenizer.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for x in texts]


def test_words_give_what_whole_texts_give():
    import random

    import pyarrow as pa

    r = random.Random(3)
    pieces = [*"aZé́ΣςßİıⅫ'’<|>0٣ \n\t\r\x0b\x0c  \u0085\x1c\x00‍한日가", "<|endoftext|>", "'s", "'LL", " ", " ", "ing", "The"]
    texts = ODD + ["".join(r.choices(pieces, k=r.randrange(1, 40))) for _ in range(4000)]
    ids, counts = t.WordEncoder(open(PATH).read(), True)(pa.array(texts), 1)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [x.tolist() for x in whole(texts)]


def test_files(spark, tmp_path):
    texts = [*ODD, None, None, *(f"number {i} of the repeated lines, number {i % 7}" for i in range(400))]
    rows = [(3 * i - 30, x, "n", i) for i, x in enumerate(texts)] + [(None, "no id", "n", 0), (None, None, "n", 0)] + [(6, "same id", "n", 0), (6, "same id", "n", 0), (1 << 40, "far", "n", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, nr long")
    folder = str(tmp_path / "tokens")
    t.write(df, "doc_id", "text", folder, PATH, end=1, shard_ids=20_000)
    got = t.read(spark, folder, ids=True).orderBy("start").collect()
    assert [r.doc_id is None for r in got] == [True] * 2 + [False] * (len(rows) - 2)
    assert [r.doc_id for r in got[2:]] == sorted(r[0] for r in rows if r[0] is not None)
    assert [r.start for r in got] == np.concatenate(([0], np.cumsum([r.n_tokens for r in got])[:-1])).tolist()
    want = sorted((r[0] is not None, r[0] or 0, x.tobytes()) for r, x in zip(rows, whole([r[1] for r in rows]), strict=True))
    assert sorted((r.doc_id is not None, r.doc_id or 0, np.array(r.ids, "<u4").tobytes()) for r in got) == want
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_tokens == len(r.ids) for r in got)
    manifest = spark.read.parquet(f"{folder}/manifest").collect()
    assert len(manifest) > 1 and sum(r.n_ids for r in manifest) == sum(r.n_tokens for r in got)
    again = t.read_documents(spark, folder, [-30, 6, 1 << 40, 12345])
    assert set(again) == {-30, 6, 1 << 40} and again[1 << 40].tolist() == whole(["far"])[0].tolist()
    assert again[-30].tolist() == [1]
    # without the words' short way
    other = str(tmp_path / "other")
    t.write(df, "doc_id", "text", other, PATH, end=1, by_words=False)
    assert sorted(map(str, t.read(spark, other).select("doc_id", "n_tokens", "ids_crc32").collect())) == sorted(map(str, t.read(spark, folder).select("doc_id", "n_tokens", "ids_crc32").collect()))


def test_damage_is_noticed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a text of its own, {i}") for i in range(50)], "doc_id long, text string")
    folder = tmp_path / "tokens"
    t.write(df, "doc_id", "text", str(folder), PATH, end=1)
    name = spark.read.parquet(f"{folder}/manifest").first()["name"]
    content = (folder / "dictionary").read_bytes()
    t.Shard(str(folder), name, content)
    with pytest.raises(ValueError, match="another dictionary"):
        t.Shard(str(folder), name, content + b"x")
    (folder / "cut").write_bytes((folder / name).read_bytes()[:-5])
    with pytest.raises(ValueError, match="cut off"):
        t.Shard(str(folder), "cut", content)


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    t.write(df, "doc_id", "text", str(tmp_path / "none"), PATH, end=1)
    assert t.read(spark, str(tmp_path / "none")).count() == 0
