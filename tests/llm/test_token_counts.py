import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from recordloom.llm import token_counts as C

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_random_texts(library):
    rng = random.Random(5)
    marks = "aabbbccc ''stremlvd<|endoftext|>  \n\t ÉéΣσς Iİıß½中文字🙂é\u0085​\x1c-_!!...ǅКир ไทย"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a<|startoftext|>b<|endoftext|> c", "<|ENDOFTEXT|>", "ΑΣ ΣΑΣ", "a" * 5000, "hahahahaha" * 50, "don't I'LL", "é"]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.randint(2, 26)]) for _ in range(rng.randint(1, 300))) for _ in range(1500)]
    assert C.Counter(PATH).count(texts) == want(library, texts)


def test_documents(library, documents):
    rows = {r["doc_id"]: r for r in C.count_tokens(documents, PATH).collect()}
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    n = dict(zip(texts, want(library, list(texts.values()))))
    assert {i: (r["n_tokens"], r["n_bytes"], r["over_limit"]) for i, r in rows.items()} == {i: (n[i], len(t.encode()), n[i] > 2048) for i, t in texts.items()}


def test_odd_rows(library, odd):
    out = C.count_tokens(odd, PATH).collect()
    assert sorted(r["_n_tokens"] for r in out) == sorted(want(library, [r["text"] or "" for r in odd.collect()]))
    assert {r["n_tokens"] for r in out} == {"own"}


def test_empty(none):
    assert C.count_tokens(none, PATH).count() == 0


def test_forgetting_changes_nothing(library, monkeypatch, documents):
    texts = [r["text"] for r in documents.limit(40).collect()]
    monkeypatch.setattr(C, "REMEMBER", 50)
    monkeypatch.setattr(C, "MERGE_BYTES", 200)
    counter = C.Counter(PATH)
    assert [counter.count([t])[0] for t in texts] == want(library, texts)


@pytest.mark.parametrize("change", [lambda s: s["normalizer"]["normalizers"][1].update(content="_"), lambda s: s["pre_tokenizer"]["pretokenizers"][0].update(invert=False), lambda s: s["pre_tokenizer"]["pretokenizers"][1].update(add_prefix_space=True), lambda s: s["model"].update(byte_fallback=True)])
def test_other_settings_are_refused(tmp_path, change):
    spec = json.loads(open(PATH, encoding="utf8").read())
    change(spec)
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        C.Counter(str(tmp_path / "v.json"))
