"""Token files: ids equal to those of the tokenizer on whole texts, prefix sums, files of several sizes, edge cases."""
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barengine.llm import token_files as K
from barengine.llm.common import table
from tests.llm.corpus_rows import SF001, docs, empty, rows  # noqa: F401

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def expected(tok, rows):
    """(key, start, n_tokens, crc) of rows in the order of key and checksum."""
    out, at = [], 0
    for key, text in rows:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def in_order(d):
    return [(r.k, r.t) for r in d.select(F.col("doc_id").alias("k"), F.col("text").alias("t")).orderBy("k", F.xxhash64("t")).collect()]


def test_whole_table(spark, tok):
    d = table(spark, SF001, "documents")
    got = sorted(map(tuple, K.token_report(d, PATH).collect()))
    assert got == expected(tok, in_order(d))


def test_small_files_and_random_access(spark, tok):
    """Files of a few ids: bases over many files, both readers, offsets and widths on disk."""
    d = table(spark, SF001, "documents").where("doc_id < 60").repartition(7)
    folder = K.token_folder(spark)
    m = K.write_tokens(d, PATH, folder, file_tokens=500)
    files = m.orderBy("doc_base").collect()
    want = expected(tok, in_order(d))
    assert len(files) > 10 and sum(f.docs for f in files) == 60 and {f.width for f in files} == {2}
    assert sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in K.read_tokens(m).collect()) == want
    reader = K.TokenReader(m)
    assert len(reader) == 60
    assert [zlib.crc32(reader[i].astype("<u4").tobytes()) for i in range(60)] == [w[3] for w in want]
    raw = files[0].path.removeprefix("file://").removeprefix("file:")
    ids, off = np.memmap(raw + ".ids", "<u2", "r"), np.memmap(raw + ".off", "<u8", "r")
    assert len(off) == files[0].docs + 1 and off[0] == 0 and off[-1] == len(ids) == files[0].tokens
    assert ids[int(off[1]) - 1] == 2


def test_special_tokens_and_odd_characters(spark, tok):
    texts = ["a<|endoftext|>b <|startoftext|>", "<|endoftext|>", "x y ́accent é ΣΑΣ ẞ", "  it's I'LL \x1c\x85",
             "don't" * 50, "\U0001f600\U0001f600 zz", "a\x00b", "12 3٣",
             "A <|ENDOFTEXT|> B", "UPPER Lower uPPER", "H\u0331 h\u0331 A\u030a"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert sorted(map(tuple, K.token_report(d, PATH).collect())) == expected(tok, in_order(d))


def test_tokenizer_that_keeps_white_space(spark):
    """Not word by word: an error, unless asked to encode texts whole."""
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    d = spark.createDataFrame([(1, "two words"), (2, "and  more")], "doc_id long, text string").coalesce(1)
    with pytest.raises(Exception, match="by_words=False"):
        K.write_tokens(d, path, K.token_folder(spark))
    m = K.write_tokens(d, path, K.token_folder(spark), end_id=50256, by_words=False)
    t = Tokenizer.from_file(path)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in K.read_tokens(m).collect()}
    assert got == {k: t.encode(x, add_special_tokens=False).ids + [50256] for k, x in ((1, "two words"), (2, "and  more"))}


def test_edges(spark, rows, docs, empty, tok):  # noqa: F811
    """Null and repeated keys, null, empty and long texts, clashing columns, a hot key, an empty table."""
    clash = docs.withColumn("k", docs.node).withColumn("t", docs.node).withColumn("h", docs.node).withColumn("start", docs.node)
    got = sorted(map(tuple, K.token_report(clash, PATH).collect()), key=lambda r: r[1])
    assert got == expected(tok, in_order(docs))
    assert K.token_report(empty, PATH).collect() == []
    hot = spark.createDataFrame([(None if i % 3 else i, f"text {i % 5}") for i in range(600)], "doc_id long, text string")
    m = K.write_tokens(hot, PATH, K.token_folder(spark))
    assert m.count() == 4 and m.agg(F.max("docs")).first()[0] < 300  # a key with two thirds of the rows is cut
    assert sorted(map(tuple, K.token_report(hot, PATH).collect()), key=lambda r: r[1]) == expected(tok, in_order(hot))


def test_cache_starts_anew(spark, tok, monkeypatch):
    monkeypatch.setattr(K, "CACHE_WORDS", 3)
    e = K.Encoder(open(PATH).read(), 2, True)
    for parts in ([b"one two three", b"four"], [b"two four", b""], [b"one"]):
        ids, n = e.encode(parts)
        assert ids.tolist() == [x for p in parts for x in tok.encode(p.decode(), add_special_tokens=False).ids + [2]]


def test_plain_words_are_encoded_together(tok, monkeypatch):
    """Words of letters, with a closing mark or without, need no special token between them; odd ones beside them keep theirs."""
    marked = []
    learn = K.Encoder._learn_marked
    monkeypatch.setattr(K.Encoder, "_learn_marked", lambda self, at, group: (marked.extend(group), learn(self, at, group)))
    e = K.Encoder(open(PATH).read(), 2, True)
    parts = [b"Plain words, each one. Or two: it's a-b x.. ,; 12 .a \xc3\xa9t\xc3\xa9.", b"plain; q! Q? zzzzqx. t s re, . I'll"]
    ids, n = e.encode(parts)
    want = [tok.encode(p.decode(), add_special_tokens=False).ids + [2] for p in parts]
    assert ids.tolist() == sum(want, []) and n.tolist() == [len(w) for w in want]
    assert {b"it's", b"a-b", b"x..", b"12"} <= set(marked) and not {b"plain", b"words,", b"one.", b"two:", b"q!"} & {w.lower() for w in marked}
