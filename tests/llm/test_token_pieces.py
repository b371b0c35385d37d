import random

import public_tokenizers
from tokenizers import Tokenizer

from attest.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_words_of_known_pieces_are_not_encoded_again(monkeypatch):
    encoder = tokens._Encoder(PATH, "<u2")
    encoder.encoded(["so alphaq; betaq?\nGammaq."])
    asked, plain = [], encoder.plain
    monkeypatch.setattr(encoder, "plain", lambda texts, *more: asked.extend(texts) or plain(texts, *more))
    text = "so alphaq? alphaq;\nGammaq? betaq.\nGammaq; betaq;"
    assert encoder.encoded([text]) == plain([text])
    assert not any("alphaq" in t or "betaq" in t or "Gammaq" in t for t in asked)


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(4)
    parts = ["a", "Zeit", "\xc0nch", "\xdf", "\u01c5", "\u0301", "\u4e2d", "\xaa", "'s", "'", "it's", ".", ",***", "-", "_", "\u2014", "\n", "\n\n", "\t", "\xa0", "\u200b", "7", "\xb2", "\0", "\x7f", "<|endoftext|>", "\u0120", "\xd7", "\u0250", " ", "  "]
    texts = ["".join(rng.choice(parts) + (" " if rng.random() < 0.4 else "") for _ in range(rng.randrange(12))) for _ in range(3000)]
    plain = Tokenizer.from_file(PATH)
    for dtype in ("<u2", "<u4"):
        encoder = tokens._Encoder(PATH, dtype)
        for first in range(0, len(texts), 500):
            some = texts[first : first + 500]
            assert encoder.encoded(some) == [tokens.np.array(e.ids, dtype).tobytes() for e in plain.encode_batch(some, add_special_tokens=False)]
