"""What the tokenizer library gets from the token store at a time, and that its ids stay those of whole texts."""

import numpy as np
import public_tokenizers

from cairnmark.llm import token_store
from cairnmark.llm.token_store import _Ids

PATH = public_tokenizers.path("word_bpe_49k.json")


class Spy:
    def __init__(self, tokenizer):
        self.tokenizer, self.calls = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch_fast(self, texts, **options):
        self.calls.append(texts)
        return self.tokenizer.encode_batch_fast(texts, **options)


def _coded(ids, texts):
    raw = [t.encode() for t in texts]
    flat, n = ids.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]


def _library(ids, texts):
    return [e.ids for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]


def _many(n):
    return ["".join(chr(97 + int(d)) for d in str(k)) + ("É" if k % 3 == 0 else "") for k in range(n)]


def test_the_library_holds_few_words_at_a_time():
    ids = _Ids(PATH)
    ids.tokenizer = spy = Spy(ids.tokenizer)
    words = _many(30_000)
    assert _coded(ids, [" ".join(words)]) == _library(ids, [" ".join(words)])
    most = token_store.AT_ONCE * token_store.TOGETHER
    assert max(sum(len(t.replace(ids.between, " ").split()) for t in texts) for texts in spy.calls) <= most < len(words) / 3


def test_ids_of_letters_marks_and_special_strings():
    texts = ["Plain WORDS and don't, it's we'LL", "a</w> </w> <|endoftext|> x<|startoftext|>y endoftext", "é É ß İ K ſ ﬁ", "", "!!! ?a! a!b 12 3d", "\u0085a b c a\tb\n\nc"]
    assert _coded(_Ids(PATH), texts) == _library(_Ids(PATH), texts)


def test_words_stay_whole_where_no_token_ends_them():
    ids, words = _Ids(PATH), _many(1000)
    expected = _library(ids, [" ".join(words)])
    ids.ending = np.zeros_like(ids.ending)  # none is found: the special token parts them
    assert _coded(ids, [" ".join(words)]) == expected
    ids = _Ids(PATH)
    ids.ending = None
    assert _coded(ids, [" ".join(words)]) == expected
