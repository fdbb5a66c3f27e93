"""Texts encoded in groups: ids as one by one, words merged side by side."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from snarewatch.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def odd_texts() -> list:
    random.seed(9)
    texts = [None, "", " ", "\n", "a", ".", "\n.", "a\n.", "a\nb", " a", "a ", "a  b", "a\n\nb", "a \nb", "x" * 3000, "é" * 70 + " é", "a\x1cb c", "a\x85b", "a b"]
    texts += ["<|endoftext|>", "a<|endoftext|> b", "a <|endoftext|>\nb", "don't I'LL\n's it's", "日本 🙂​", "ab, cd.\nef; gh! (ij) k:", "ª º ² x²", "İı ŉ"]
    for letters in ("ab cd\n\t'.,é日🙂09  ", "ab cdé日\n.,", "thern ", "the and\nof"):
        texts += ["".join(random.choice(letters) for _ in range(random.randint(1, 80))) for _ in range(700)]
    words = ["".join(random.choice("therandingofé") for _ in range(random.randint(1, 70))) for _ in range(2000)]
    return texts + [random.choice(" \n").join(random.choices(words, k=40)) for _ in range(300)]


@pytest.mark.parametrize("memo", [3, 300_000])
def test_groups_equal_the_library(vocabulary, tmp_path, monkeypatch, memo):
    monkeypatch.setattr(bpe, "MEMO", memo)
    library, texts = Tokenizer.from_file(PATH), odd_texts()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon({w: vocabulary.merge(w) for w in (b" the", b" and", b" a", b" ab", "é".encode())}))
    for lexicon in (None, bpe.Lexicon(str(path))):
        encoder = bpe.Encoder(vocabulary, lexicon)
        for size in (1, 7, len(texts)):
            got = []
            for at in range(0, len(texts), size) if size > 1 else range(40):
                ids = encoder.encode_many(pa.array(texts[at : at + size], pa.string()))
                assert vocabulary.decimals_many(ids) == [",".join(map(str, x)).encode() for x in ids.to_pylist()]
                assert vocabulary.decode_many(ids) == [t or "" for t in texts[at : at + size]]
                got += ids.to_pylist()
            assert got == want[: len(got)] and len(got) == (40 if size == 1 else len(texts))
    assert vocabulary.decode_many(pa.array([[vocabulary.unit[195]], []], pa.list_(pa.int32()))) == [vocabulary.decode([vocabulary.unit[195]]), ""]


def test_many_words_equal_one_by_one(vocabulary, tmp_path):
    random.seed(5)
    words = [bytes(random.choice(b" therandingofTHE\xc3\xa9.") for _ in range(random.randint(0, 60))) for _ in range(4000)]
    assert vocabulary.merge_many(words) == [vocabulary.merge(w) for w in words]
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon({w: vocabulary.merge(w) for w in words[::3]}))
    lexicon, asked = bpe.Lexicon(str(path)), words + [w[:-1] for w in words] + [w + b"x" for w in words]
    assert lexicon.get_many(asked) == [lexicon.get(w) for w in asked]
    path.write_bytes(bpe.compile_lexicon({}))
    assert bpe.Lexicon(str(path)).get_many([b"a", b""]) == [None, None]


def test_rare_words_are_not_merged_one_by_one(vocabulary, monkeypatch):
    random.seed(6)
    words = ["".join(random.choice("therandingof") for _ in range(random.randint(4, 14))) for _ in range(5000)]
    encoder, asked, merge = bpe.Encoder(vocabulary, None), [], vocabulary.merge
    monkeypatch.setattr(vocabulary, "merge", lambda word: asked.append(word) or merge(word))
    encoder.encode_many(pa.array([" ".join(words)] * 3))
    assert len(asked) < 100


def test_slices_of_a_batch_cover_it(monkeypatch):
    monkeypatch.setattr(bpe, "GROUP", 10)
    texts = ["abc", None, "x" * 35, "", "é" * 6, "a", "b"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["doc_id", "text"])
    groups = [g.column(1).to_pylist() for g in bpe._groups(batch)]
    assert sum(groups, []) == texts and len(groups) == 3
    assert not list(bpe._groups(batch.slice(0, 0)))
