from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tests.conftest import SF_DIR
from tests.llm.conftest import rows_of
from tripline.llm import bpe

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
END = "<|endoftext|>"


def encode(texts, special=True):
    coder, found = bpe.ByteBpe(PATH, special), [[] for _ in texts]
    for rows, ids, begins in coder.encode_texts(pa.array(texts, pa.string())):
        for row, a, b in zip(rows, begins, begins[1:]):
            found[row] += ids[a:b].tolist()
    return found


def wanted(texts, special=True):
    LIBRARY.encode_special_tokens = not special
    ids = [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    LIBRARY.encode_special_tokens = False
    return ids


def random_texts(seed, count):
    state = random.Random(seed)
    parts = ["a", "it", " ", "  ", "\n", "\t ", "'", "'s", "'ll", "'re", "'rest", "'v", "''d", "7", "42", "é", "ß", "日本", "　", "\x1c",
             "\x85", "\xa0", "!", "--", "😀", "́", "½", "aaaa", END, "<|", "x" * 30, "the", " the", "​", "�", "Ⅷ"]
    return ["".join(state.choices(parts, k=state.randint(0, 40))) for _ in range(count)]


def test_every_code_point_has_the_class_the_library_gives_it():
    cutter, kinds = LIBRARY.pre_tokenizer, bpe.character_classes()
    for point in [*range(0xD800), *range(0xE000, 0x110000)]:
        letter = chr(point)
        alone = [len(cutter.pre_tokenize_str(before + letter)) > 1 for before in ("a", "1", "!")]
        assert kinds[point] == (alone.index(False) if False in alone else bpe.SPACE), hex(point)


@pytest.mark.parametrize("special", [True, False])
def test_ids_equal_the_library(special):
    texts = [None, "", " ", "\n\n", END, f"a{END}b {END}{END} ", *random_texts(1, 3000)]
    assert encode(texts, special) == wanted(texts, special)


def test_ids_of_documents_equal_the_library():
    texts = pq.read_table(f"{SF_DIR}/documents.parquet")["text"].to_pylist()
    assert encode(texts) == wanted(texts)


def test_long_texts_in_parts(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE_BYTES", 200)
    texts = [" ".join(random_texts(3, 60)), "no-blank" * 100, "a " * 500, " " * 900, "日" * 700, "", "é " * 300]
    assert encode(texts) == wanted(texts)


def test_one_word_without_an_end():
    texts = ["a" * 50_001, "ab" * 20_000, "".join(random.Random(4).choices("abcdefgh", k=20_000))]
    assert encode(texts) == wanted(texts)


def test_pairs_one_at_a_time_give_the_same():
    coder = bpe.ByteBpe(PATH)
    assert coder._together
    words = [w.encode() for w in ("banana", "aaaaaaa", "international", "xx", "q")]
    flat, counts = np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words)))
    together = coder.merge(coder._byte_ids[flat], counts)
    coder._together = False
    assert all((a == b).all() for a, b in zip(together, coder.merge(coder._byte_ids[flat], counts)))


def test_what_is_forgotten_is_learned_again(monkeypatch):
    monkeypatch.setattr(bpe, "_REMEMBERED", 3)
    monkeypatch.setattr(bpe, "SLICE_BYTES", 300)
    texts = random_texts(5, 200)
    assert encode(texts) == wanted(texts)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_round_trip_and_broken_ids(spark, documents):
    texts = [*random_texts(6, 50), None, "", "x " * 3000]
    rows = [(n, t) for n, t in enumerate(texts)] + [(None, "no id"), (3, "again")]
    tokens = bpe.encode_documents(documents(rows), PATH)
    assert rows_of(bpe.decode_documents(tokens, PATH), "doc_id", "text") == sorted([(n, t or "") for n, t in rows], key=repr)
    broken = encode(["日"])[0][:1]
    frame = spark.createDataFrame([(1, broken), (2, None)], "doc_id long, ids array<int>")
    assert rows_of(bpe.decode_documents(frame, PATH), "doc_id", "text") == sorted(
        [(1, LIBRARY.decode(broken, skip_special_tokens=False)), (2, "")], key=repr
    )


def test_digests(documents, monkeypatch):
    rows = [(1, f"a {END} b's  "), (2, None), (2, ""), (None, "日本 é"), (3, "w " * 5000)]
    found = bpe.digests(documents(rows), PATH)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    ids = wanted([t for _, t in rows])
    expected = [(n, len(i), sha(",".join(map(str, i))), sha(LIBRARY.decode(i, skip_special_tokens=False))) for (n, _), i in zip(rows, ids)]
    assert rows_of(found, *found.columns) == sorted(expected, key=repr)
    assert bpe.digests(documents([]), PATH).count() == 0
