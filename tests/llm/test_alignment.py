from __future__ import annotations

import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.conftest import rows_of
from tests.llm.test_bpe import random_texts
from tripline.llm import alignment

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH_A, PATH_B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
A = Tokenizer.from_file(PATH_A)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
LETTERS = {chr(b): b for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
LETTERS |= {chr(0x100 + n): b for n, b in enumerate(b for b in range(256) if b not in LETTERS.values())}


def spelled_a(number):
    return bytes(LETTERS[letter] for letter in A.id_to_token(number))


def spelled_b(number):
    piece = B.id_to_piece(number)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(number) else piece.replace("▁", " ").encode()


def brute_groups(text):
    """Groups of (A ids, B ids) and the links, token by token; None without tokens."""
    if not text:
        return None
    ids_a, ids_b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    pieces_a, pieces_b = list(map(spelled_a, ids_a)), list(map(spelled_b, ids_b))
    if not b"".join(pieces_a) == b"".join(pieces_b) == (" " + text).encode():
        return None
    ends = lambda pieces: np.cumsum(list(map(len, pieces))).tolist()
    ends_a, ends_b = ends(pieces_a), ends(pieces_b)
    groups, i, j, links = [], 0, 0, []
    for cut in sorted(set(ends_a) & set(ends_b)):
        in_a, in_b = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append((ids_a[i:in_a], ids_b[j:in_b]))
        for x in range(i, in_a):
            for y in range(j, in_b):
                if max(ends_a[x] - len(pieces_a[x]), ends_b[y] - len(pieces_b[y])) < min(ends_a[x], ends_b[y]):
                    links.append((ids_a[x], ids_b[y]))
        i, j = in_a, in_b
    return groups, links


def as_text(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def brute(texts):
    found = [brute_groups(text) for text in texts]
    held = Counter(pair for one in found if one for pair in set(one[1]))
    highest = {}
    for (a, _), count in held.items():
        highest[a] = max(highest.get(a, 0), count)
    rows = []
    for one in found:
        if one is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        groups, links = one
        counts = [held[pair] for pair in links]
        best = sum(count == highest[a] for (a, _), count in zip(links, counts))
        sha = hashlib.sha256(as_text(groups).encode()).hexdigest()
        rows.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), best, sum(counts), sha))
    return rows


TEXTS = [None, "", " ", "   ", "a", "a▁b", "<|endoftext|> <s></s>", "<0x0A>", "日本 é\x00\n", "ends in blanks  ", *random_texts(11, 120)]


def test_labels_are_the_cuts_both_share():
    state = random.Random(1)
    for _ in range(200):
        total = state.randint(1, 60)
        cuts = [sorted({total, *state.sample(range(1, total + 1), state.randint(0, total - 1))}) for _ in range(2)]
        a, b = (np.diff(np.array([0, *c])) for c in cuts)
        shared = np.array(sorted(set(cuts[0]) & set(cuts[1])))
        for labels, ends in zip(alignment.group_labels(a, b), cuts):
            assert labels.tolist() == np.searchsorted(shared, ends).tolist()
        pairs = [(i, j) for i in range(len(a)) for j in range(len(b))
                 if max(cuts[0][i] - a[i], cuts[1][j] - b[j]) < min(cuts[0][i], cuts[1][j])]
        assert list(zip(*(x.tolist() for x in alignment.overlaps(a, b)))) == pairs


def test_words_encoded_apart_equal_whole_texts():
    coder, texts = alignment.PieceBpe(PATH_B), [t for t in TEXTS if t and "▁" not in t]
    data, offsets = alignment.flat_text(pa.array([" " + t for t in texts]))
    ids, begins, same = coder.encode(data, offsets)
    assert same.all() and [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [B.encode(t) for t in texts]


@pytest.mark.parametrize("links, slice_bytes", [(1 << 20, 1 << 20), (50, 64)])
def test_figures_equal_brute_force(documents, work, monkeypatch, links, slice_bytes):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", links)
    monkeypatch.setattr(alignment, "SLICE_BYTES", slice_bytes)
    texts = [*TEXTS, "a", "a", "word " * 400, "word " * 400, "a▁b " * 100, "x" * 3000]
    ids = [*range(len(texts) - 2), None, 3]
    found = alignment.align(documents(list(zip(ids, texts))).repartition(3), work, PATH_A, PATH_B)
    wanted = [(i, *row) for i, row in zip(ids, brute(texts))]
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found.columns == names and rows_of(found, *names) == sorted(wanted, key=repr)


def test_groups_as_text(documents):
    texts = [t for t in TEXTS]
    found = rows_of(alignment.aligned_groups(documents(list(enumerate(texts))), PATH_A, PATH_B), "doc_id", "groups")
    wanted = [(n, as_text(one[0]) if (one := brute_groups(t)) else "") for n, t in enumerate(texts)]
    assert found == sorted(wanted, key=repr)


def test_nothing_to_align(documents, work):
    assert alignment.align(documents([]), work, PATH_A, PATH_B).count() == 0
    found = alignment.align(documents([(1, None), (2, "")]), work, PATH_A, PATH_B)
    assert rows_of(found, "doc_id", "n_links", "groups_sha256") == [(1, 0, ""), (2, 0, "")]
