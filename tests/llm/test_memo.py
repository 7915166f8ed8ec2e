"""The encoder's memo: fragments still in use outlive it, and results do not hang on it."""

import numpy as np
import public_tokenizers

from corelode.llm import bpe


def test_fragments_in_use_are_learned_once():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = bpe.FragmentEncoder(path, memo_entries=400)
    learned: list[bytes] = []
    learn = own._learn
    own._learn = lambda words, others: (learned.extend([*words, *others]), learn(words, others))[1]
    common = "the drill core, (granite) état-major, “quoted” naïve. x<y é́a 日本 don't"
    for k in range(12):
        texts = [f"{common} w{k}x{i} {'abcdefghij'[i % 10]}q{'klmnopqrst'[k % 10]}z, v{k}.{i}".encode() for i in range(100)]
        want = [np.asarray(own.library.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert own.encode(texts) == want
    assert own.aside and len(own.memo) <= 1200
    assert learned.count(b"granite") == learned.count("naïve".encode()) == learned.count("日本".encode()) == 1


def test_words_of_letters_go_to_the_model():
    """Learned by the model alone or through the whole library, words have the same ids."""
    path = public_tokenizers.path("word_bpe_49k.json")
    own, plain = bpe.FragmentEncoder(path), bpe.FragmentEncoder(path)
    assert own.direct
    plain.direct = False
    words = [f"{a}{b}".encode() for a in ("granit", "x", "qzvw", "hydrothermal", "s") for b in ("", "e", "oid", "zzz", "ly", "s" * 40)]
    assert own.encode([b" ".join(words)]) == plain.encode([b" ".join(words)])
    seen = []
    own._learn([b"drill", b"core"], [])
    own.library = type("Library", (), {"model": own.library.model, "encode_batch_fast": lambda *a, **b: seen.append(a)})()
    own._learn([b"another", b"word"], [])
    assert not seen
