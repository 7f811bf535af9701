"""Record files and packing, against whole-text encodings."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from siltstone.llm import packing, records
from siltstone.llm.word_tokens import WordTokens

WORD, BYTE = path("word_bpe_49k.json"), path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n\nb", "\ta", "a\xa0b", "a\x1cb", "it's a test.\nNext", "<|endoftext|>", "a <|endoftext|> b", "é ́x", "Ａ１ ½ ß İI", "x" * 300, "1,234 5", "a\r\nb", " b", "é" * 50 + " " + "日本語 テキスト"]


@pytest.mark.parametrize("file", [WORD, BYTE])
def test_pieces_give_the_ids_of_the_whole(file):
    whole, mine = Tokenizer.from_file(file), WordTokens(file, 2)
    import pyarrow.parquet as pq

    texts = ODD + pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    for _ in range(2):
        for t, got in zip(texts, mine.encode(texts)):
            assert np.frombuffer(got, "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids + [2], t[:80]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_records(edge_docs, edge_rows, spark):
    whole = Tokenizer.from_file(WORD)
    manifest = records.write_tokens(edge_docs, WORD, 2)
    got = records.read_documents(manifest).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    want, at = [], 0
    for i, t in sorted(edge_rows, key=key):
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    mixed = [(i, len(ids), crc(ids)) for i, ids in records.shuffled(spark, manifest, 3)]
    assert sorted(mixed, key=str) == sorted(((i, n, c) for i, _, n, c in want), key=str) and mixed != [(i, n, c) for i, _, n, c in want]


def test_damage_is_found(tmp_path):
    w = records.RecordWriter(f"{tmp_path}/a")
    for i in range(5):
        w.write(records.pack_ids(i, b"\1\0\2\0", 2))
    w.close()
    assert [records.unpack_ids(p)[0] for p in records.read_at(f"{tmp_path}/a", [4, 0])] == [4, 0]
    data = bytearray((tmp_path / "a.rec").read_bytes())
    data[30] ^= 1
    (tmp_path / "a.rec").write_bytes(data)
    with pytest.raises(records.CorruptRecord):
        list(records.read_records(f"{tmp_path}/a"))


def test_no_records(no_docs):
    assert records.token_records(no_docs, WORD, 2).count() == 0


@pytest.mark.parametrize("node", [10, 50_000])
def test_packing(edge_docs, edge_rows, node):
    whole = Tokenizer.from_file(BYTE)
    got = packing.best_fit_packing(edge_docs, BYTE, 0, 256, node_pieces=node, fan_in=3).collect()
    want = []
    for i, t in edge_rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [0]
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        want += [(i, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(r[:5]) for r in got), key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 256
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 256) * 1.08 + 2


def test_packing_nothing(no_docs):
    assert packing.best_fit_packing(no_docs, BYTE).count() == 0
