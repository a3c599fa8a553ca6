from __future__ import annotations

import itertools
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import rows_of
from tripline.llm import rans, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "B", "é", "É", "ß", "İ", "'s", "'", "'LL", "don't", "!", "?!", "<|endoftext|>", "<|", "|>", " ", "\n",
          "\x1c", " ", "é", "1", "23", "²", "日本", "😀", "ΑΣ", "ǅ", "ﬁ", "_", " ", "\u0085", "Å"]


def reference(texts):
    tokenizer = Tokenizer.from_file(PATH)
    return [tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts]


def test_words_encode_as_the_whole_text_does(monkeypatch):
    monkeypatch.setattr(token_files, "_REMEMBERED", 200)
    state, encoder = random.Random(3), token_files.WordEncoder(PATH)
    for _ in range(60):
        texts = ["".join(state.choice(PIECES) for _ in range(state.randint(0, 15))) for _ in range(8)] + [None, ""]
        assert [ids.tolist() for ids in encoder.encode(pa.array(texts, pa.string()))] == reference(texts)
    assert encoder.encode(pa.array([], pa.string())) == []


def test_random_words_and_a_tokenizer_that_prepares_text_in_another_way():
    state, encoder = random.Random(4), token_files.WordEncoder(PATH)
    letters = "abcÉéßZ'.,-<|>1é日"
    texts = [" ".join("".join(state.choices(letters, k=state.randint(1, 9))) for _ in range(40)) for _ in range(150)]
    assert encoder.by_words and [ids.tolist() for ids in encoder.encode(pa.array(texts, pa.string()))] == reference(texts)
    path = public_tokenizers.path("byte_bpe_50k.json")
    other, library = token_files.WordEncoder(path), Tokenizer.from_file(path)
    assert not other.by_words
    wanted = [library.encode(text or "", add_special_tokens=False).ids for text in [*texts, None]]
    assert [ids.tolist() for ids in other.encode(pa.array([*texts, None], pa.string()))] == wanted


def test_many_words_are_learned_once_and_held_in_few_bytes(monkeypatch):
    letters = "abcdefghijklmnopqrst"
    words = ["".join(word) for word in itertools.islice(itertools.product(letters, repeat=5), 260_000)]
    encoder, learned = token_files.WordEncoder(PATH), []
    learn = encoder._learn_pieces
    monkeypatch.setattr(encoder, "_learn_pieces", lambda new: learned.append(len(new)) or learn(new))
    texts = pa.array([" ".join(words[n : n + 1000]) for n in range(0, len(words), 1000)])
    tracemalloc.start()
    first = [ids.tolist() for ids in encoder.encode(texts)[:5]]
    held = tracemalloc.get_traced_memory()[0] + pa.total_allocated_bytes()
    tracemalloc.stop()
    assert [ids.tolist() for ids in encoder.encode(texts[:5])] == first == reference(texts[:5].to_pylist())
    # One more piece: no marks.
    assert sum(learned) <= len(words) + 1
    assert held < 100 * len(words)


def test_loading_and_learning_take_little_python_memory():
    letters = "abcdefghijklmnopqrst"
    words = ["".join(word) for word in itertools.islice(itertools.product(letters, repeat=4), 60_000)]
    texts = pa.array([" ".join(words)])
    tracemalloc.start()
    encoder = token_files.WordEncoder(PATH)
    loaded = tracemalloc.get_traced_memory()[1]
    encoder.encode(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert encoder.by_words and loaded < 2_000_000
    assert most < 10_000_000


@pytest.mark.parametrize("size", [0, 1, 63, 64, 129, 5000, 140_000])
def test_blocks_round_trip_and_decode_by_stretch(size):
    state = np.random.default_rng(size)
    ids = (state.zipf(1.3, size) % 49_000).astype(np.uint32)
    seen, counts = np.unique(ids, return_counts=True)
    table = rans.Table.from_counts(seen, counts)
    assert not size or table.frequencies.sum() == 1 << rans.SCALE_BITS
    data = rans.encode(ids, np.array([size]), table)
    decoder = rans.Decoder(table)
    assert (decoder.decode(data).ids == ids).all()
    step = rans.CHECKPOINT_STEPS * max(1, min(rans.MAX_LANES, size // rans.IDS_PER_LANE))
    for number, start in enumerate(range(0, size, step)):
        assert (decoder.stretch(data, number) == ids[start : start + step]).all()


def test_damage_and_wrong_tables_are_noticed():
    ids = np.arange(500, dtype=np.uint32)
    table = rans.Table.from_counts(ids, np.ones(500))
    data = rans.encode(ids, np.array([500]), table)
    for at in (0, 10, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            rans.Decoder(table).decode(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    with pytest.raises(ValueError):
        rans.Decoder(rans.Table.from_counts(ids, ids + 1.0)).decode(data)
    with pytest.raises(ValueError):
        rans.encode(np.array([501], dtype=np.uint32), np.array([1]), table)


@pytest.mark.parametrize("block_ids", [1, 40, token_files.BLOCK_IDS])
def test_files_hold_every_document_in_order(spark, documents, work, block_ids):
    rows = [(n * 7 % 50, f"Text {n} of many. " * (n % 9)) for n in range(50)]
    rows += [(100, None), (101, ""), (60, "twice"), (60, "twice"), (60, "other"), (None, "no id"), (102, "long " * 3000)]
    docs = documents(rows)
    files = token_files.write(docs, work.new_path("tokens"), work, PATH, block_ids=block_ids)
    read = {}
    for row in token_files.read(spark, files).collect():
        ids = np.frombuffer(row["ids"], "<u4")
        read.setdefault(row["doc_id"], []).append((row["start"], ids.tolist()))
    wanted = {}
    for (doc_id, _), ids in zip(rows, reference([text for _, text in rows])):
        wanted.setdefault(doc_id, []).append([*ids, 1])
    assert {k: sorted(ids for _, ids in v) for k, v in read.items()} == {k: sorted(v) for k, v in wanted.items()}
    at = 0
    for doc_id, start, ids in sorted(((k, s, i) for k, v in read.items() for s, i in v), key=lambda r: r[1]):
        assert start == at
        at += len(ids)
    order = [k for k, _ in sorted(((k, s) for k, v in read.items() for s, _ in v), key=lambda r: r[1])]
    assert order == sorted(order, key=lambda k: (k is not None, k))
    crc = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    assert rows_of(token_files.digests(spark, files), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(
        ((k, s, len(ids), crc(ids)) for k, v in read.items() for s, ids in v), key=repr
    )


def test_empty_table(spark, documents, work):
    files = token_files.write(documents([]), work.new_path("tokens"), work, PATH)
    assert token_files.read(spark, files).count() == token_files.digests(spark, files).count() == 0
